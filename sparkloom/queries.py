"""The registered queries, and DuckDB SQL for those that SQL can express. Each runs over its whole tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import relational as R
from .plans import analyzer, rewrites
from .session import shared_dir
from .sources import io
from .streaming import ops as T

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: str) -> F.Column:
    """Sums of doubles differ in their last digits by order; sums of cents do not."""
    return F.sum(F.round(F.col(c) * 100).cast("long"))


# --- scans, sources, sinks -------------------------------------------------------------------


@query("SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01' AND l_returnflag IN ('R', 'A') AND l_quantity >= 45")
def s_parquet_pushdown(spark, sf_dir):
    d = io.scan(spark, f"{sf_dir}/lineitem.parquet")
    return d.filter("l_shipdate < timestamp_ntz '1997-01-01' and l_returnflag in ('R', 'A') and l_quantity >= 45").select("l_orderkey", "l_extendedprice")


def _round_trip(spark, df, fmt, by=(), schema=None):
    path = f"{shared_dir(spark)}/{fmt}-{uuid.uuid4().hex}"
    io.write(df, path, fmt, by=by)
    return io.scan(spark, path, fmt, schema=schema)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL")
def s_orc_partitioned(spark, sf_dir):
    """Written to ORC by status, read back with partition pruning."""
    d = _round_trip(spark, t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), "orc", ("o_orderstatus",))
    return d.filter("o_orderstatus <> 'F'").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def s_csv(spark, sf_dir):
    d = t(spark, sf_dir, "customer")
    return _round_trip(spark, d, "csv", schema=d.schema)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def s_json(spark, sf_dir):
    d = t(spark, sf_dir, "supplier")
    return _round_trip(spark, d, "json", schema=d.schema)


@query("SELECT i AS id, i * 2 AS twice FROM range(100000) r(i) WHERE i % 7 = 3")
def s_range(spark, sf_dir):
    return spark.range(100_000).filter("id % 7 = 3").select("id", (F.col("id") * 2).alias("twice"))


@query("SELECT * FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) v(k, s)")
def s_values(spark, sf_dir):
    return spark.sql("SELECT * FROM VALUES (1, 'a'), (2, NULL), (NULL, 'c') v(k, s)")


@query("SELECT event_id, user_id, event_type FROM events")
def s_kafka_json(spark, sf_dir):
    """What the Kafka sink would write, as the Kafka source would read it."""
    d = io.to_kafka(t(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "user_id")
    return io.from_kafka(d, "event_id long, user_id long, event_type string")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND length(c_mktsegment) <= 9")
def s_constraints(spark, sf_dir):
    d = t(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return io.enforced(d, ("c_mktsegment",), {"c_mktsegment": 9})


# --- projection, filter, predicates ----------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS sum_cents,
  round(avg(l_quantity), 6) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def q_pricing_summary(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").filter("l_shipdate <= timestamp_ntz '1998-09-02'")
    return d.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_cents"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query("""
SELECT o_orderkey, o_totalprice * 2 AS twice, -o_custkey AS minus, o_orderkey % 7 AS r, o_orderstatus = 'F' AS is_f
FROM orders WHERE (o_totalprice > 1000 AND NOT (o_orderstatus = 'P')) OR o_orderpriority BETWEEN '1' AND '2' OR o_custkey IN (1, 2, 3)
""")
def p_project_filter(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    f = ((F.col("o_totalprice") > 1000) & ~(F.col("o_orderstatus") == "P")) | F.col("o_orderpriority").between("1", "2") | F.col("o_custkey").isin(1, 2, 3)
    return o.filter(f).select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice"), (-F.col("o_custkey")).alias("minus"), (F.col("o_orderkey") % 7).alias("r"), (F.col("o_orderstatus") == "F").alias("is_f"))


@query("""
SELECT o_orderkey, s IS NULL AS no_s, coalesce(s = 'P', FALSE) AS is_p, s <> 'P' AS not_p, s IN ('P', NULL) AS in_p
FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders)
""")
def p_nulls(spark, sf_dir):
    d = t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("s"))
    return d.select("o_orderkey", F.col("s").isNull().alias("no_s"), S.is_true(F.col("s") == "P").alias("is_p"), (F.col("s") != "P").alias("not_p"), F.expr("s in ('P', null)").alias("in_p"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'P%' OR p_name LIKE '%7' OR contains(p_type, 'A') OR regexp_matches(p_brand, '[1-3]$')")
def p_like(spark, sf_dir):
    c = F.col
    return t(spark, sf_dir, "part").filter(c("p_name").startswith("P") | c("p_name").endswith("7") | c("p_type").contains("A") | c("p_brand").rlike("[1-3]$")).select("p_partkey", "p_name")


@query("""
SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending,
  (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS last_order
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F')
""")
def p_subqueries(spark, sf_dir):
    for n in ("customer", "orders"):
        t(spark, sf_dir, n).createOrReplaceTempView(f"p_subqueries_{n}")
    return spark.sql("""
        SELECT c_custkey, c_acctbal > (SELECT avg(c_acctbal) FROM p_subqueries_customer) AS above,
          EXISTS (SELECT 1 FROM p_subqueries_orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending,
          (SELECT max(o_orderkey) FROM p_subqueries_orders WHERE o_custkey = c_custkey) AS last_order
        FROM p_subqueries_customer c
        WHERE c_custkey NOT IN (SELECT o_custkey FROM p_subqueries_orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F')""")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def p_coalesce(spark, sf_dir):
    return t(spark, sf_dir, "orders").coalesce(2).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


# --- joins -----------------------------------------------------------------------------------

_JOIN = "SELECT c_mktsegment, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def _joined(spark, sf_dir, strategy):
    d = R.join(t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), strategy=strategy)
    return d.groupBy("c_mktsegment").agg(F.count("*").alias("n"), money("o_totalprice").alias("cents"))


@query(_JOIN)
def j_broadcast_hash(spark, sf_dir):
    return _joined(spark, sf_dir, "broadcast_hash")


@query(_JOIN)
def j_shuffled_hash(spark, sf_dir):
    return _joined(spark, sf_dir, "shuffled_hash")


@query(_JOIN)
def j_sort_merge(spark, sf_dir):
    return _joined(spark, sf_dir, "sort_merge")


def _outer(how):
    """All orders with all customers; shifted keys leave rows of both sides without a partner, nullif some without a key."""

    @query(f"""
    WITH o AS (SELECT o_orderkey, nullif(o_custkey, 7) AS k FROM orders), c AS (SELECT nullif(c_custkey + 40, 50) AS ck, c_mktsegment FROM customer)
    SELECT o_orderkey, k, ck, c_mktsegment FROM o {how.upper()} JOIN c ON k = ck
    """)
    def f(spark, sf_dir):
        o = t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_custkey, 7)").alias("k"))
        return o.join(t(spark, sf_dir, "customer").select(F.expr("nullif(c_custkey + 40, 50)").alias("ck"), "c_mktsegment"), F.col("k") == F.col("ck"), how)

    return f


for _how in ("left", "right", "full"):
    _f = _outer(_how)
    QUERIES[f"j_{_how}_outer"], SQL[f"j_{_how}_outer"] = QUERIES.pop("f"), SQL.pop("f")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j_semi(spark, sf_dir):
    o = t(spark, sf_dir, "orders").filter("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return rewrites.semi_join_dedup(t(spark, sf_dir, "customer"), o, ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def j_anti(spark, sf_dir):
    o = t(spark, sf_dir, "orders").filter("o_totalprice > 200000").withColumnRenamed("o_custkey", "c_custkey")
    return rewrites.semi_join_dedup(t(spark, sf_dir, "customer"), o, ["c_custkey"], anti=True).select("c_custkey")


@query("SELECT a.n_name AS n1, b.n_name AS n2 FROM nation a JOIN nation b ON a.n_regionkey <> b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j_theta(spark, sf_dir):
    """A nested-loop join over the 25 nations: both sides have a fixed size."""
    n = t(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.expr("a.n_regionkey <> b.n_regionkey and a.n_nationkey < b.n_nationkey")).select(F.col("a.n_name").alias("n1"), F.col("b.n_name").alias("n2"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def j_cross(spark, sf_dir):
    return t(spark, sf_dir, "region").crossJoin(t(spark, sf_dir, "nation")).select("r_name", "n_name")


@query("SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey AND n > 2")
def j_extra_condition(spark, sf_dir):
    o = t(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return t(spark, sf_dir, "customer").join(o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("n") > 2), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT c_custkey, max(o_orderkey) AS last_order, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def j_cogroup(spark, sf_dir):
    def f(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        orders = b.dropna(subset="k").groupby("k")["o"].agg(["max", "count"])  # a null key has no partner
        d = a.groupby("k", dropna=False).size().reset_index(name="rows").merge(orders, how="left", left_on="k", right_index=True)
        return pd.DataFrame({"c_custkey": d["k"], "last_order": d["max"], "n": d["count"].astype("Int64").fillna(0) * d["rows"]})

    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return R.co_grouped(c, t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o")), "k", f, "c_custkey long, last_order long, n long")


# --- aggregation -----------------------------------------------------------------------------


@query("""
SELECT nullif(l_returnflag, 'N') AS flag, sum(l_quantity) AS s, round(avg(l_tax), 9) AS a, min(l_shipdate) AS lo, max(l_comment_len) AS hi, count(*) AS n, count(nullif(l_linenumber, 1)) AS n_x, round(stddev_samp(l_quantity), 6) AS sd
FROM (SELECT *, length(l_linestatus) AS l_comment_len FROM lineitem) GROUP BY 1
""")
def a_functions(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").groupBy(F.expr("nullif(l_returnflag, 'N')").alias("flag"))
    return d.agg(F.sum("l_quantity").alias("s"), F.round(F.avg("l_tax"), 9).alias("a"), F.min("l_shipdate").alias("lo"), F.max(F.length("l_linestatus")).alias("hi"), F.count("*").alias("n"), F.count(F.expr("nullif(l_linenumber, 1)")).alias("n_x"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"))


@query("SELECT l_linestatus, count(DISTINCT l_suppkey) AS d1, count(DISTINCT l_partkey) AS d2, sum(DISTINCT l_linenumber) AS d3, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS f1, count(*) FILTER (WHERE l_discount > 0.05) AS f2 FROM lineitem GROUP BY 1")
def a_distinct_filter(spark, sf_dir):
    t(spark, sf_dir, "lineitem").createOrReplaceTempView("a_distinct_filter")
    return spark.sql("SELECT l_linestatus, count(DISTINCT l_suppkey) AS d1, count(DISTINCT l_partkey) AS d2, sum(DISTINCT l_linenumber) AS d3, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS f1, count(*) FILTER (WHERE l_discount > 0.05) AS f2 FROM a_distinct_filter GROUP BY 1")


_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _customers(spark, sf_dir):
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).join(t(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))


@query(f"SELECT r_name, n_name, c_mktsegment, grouping(r_name, n_name, c_mktsegment) AS gid, count(*) AS n, max(c_custkey) AS hi FROM {_CUSTOMERS} GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
def a_rollup(spark, sf_dir):
    """Aggregates the finest groups once and rolls those up."""
    return rewrites.rollup_two_phase(_customers(spark, sf_dir), ["r_name", "n_name", "c_mktsegment"], [("count", "*", "n"), ("max", "c_custkey", "hi")])


@query(f"SELECT r_name, c_mktsegment, grouping(r_name, c_mktsegment) AS gid, count(*) AS n, round(avg(c_acctbal), 6) AS a FROM {_CUSTOMERS} GROUP BY CUBE (r_name, c_mktsegment)")
def a_cube(spark, sf_dir):
    return _customers(spark, sf_dir).cube("r_name", "c_mktsegment").agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("a"))


@query(f"SELECT s, c_mktsegment, grouping(s, c_mktsegment) AS gid, count(*) AS n FROM (SELECT nullif(r_name, 'ASIA') AS s, c_mktsegment FROM {_CUSTOMERS}) GROUP BY GROUPING SETS ((s), (c_mktsegment), ())")
def a_grouping_sets(spark, sf_dir):
    _customers(spark, sf_dir).select(F.expr("nullif(r_name, 'ASIA')").alias("s"), "c_mktsegment").createOrReplaceTempView("a_grouping_sets")
    return spark.sql("SELECT s, c_mktsegment, grouping_id(s, c_mktsegment) AS gid, count(*) AS n FROM a_grouping_sets GROUP BY GROUPING SETS ((s), (c_mktsegment), ())")


@query("SELECT c_custkey, coalesce(sum(o_orderkey), 0)::BIGINT AS s, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a_sum0_last(spark, sf_dir):
    d = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.expr("o_custkey = c_custkey"), "left")
    return d.groupBy("c_custkey").agg(R.sum0("o_orderkey").alias("s"), R.last_value("o_orderpriority", "o_orderkey").alias("last_priority"))


@query("SELECT o_orderpriority, round(var_samp(o_totalprice) / 1e6, 4) AS v, list_sort(list(DISTINCT o_orderstatus)) AS st, count(DISTINCT o_custkey) AS nd FROM orders GROUP BY 1")
def a_more(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.round(F.var_samp("o_totalprice") / 1e6, 4).alias("v"), F.array_sort(F.collect_set("o_orderstatus")).alias("st"), F.count_distinct("o_custkey").alias("nd"))


# --- windows ---------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, r, rn FROM (SELECT l_orderkey, l_linenumber, rank() OVER w AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC)) WHERE rn <= 3")
def w_top_rank(spark, sf_dir):
    """Limited before the rank: the rank of the rows that are kept depends on them alone."""
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    d = R.top_per_key(d, ["l_orderkey"], [F.desc("l_quantity"), F.asc("l_linenumber")], 3)
    d = d.withColumn("r", F.rank().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"))))
    return d.select("l_orderkey", "l_linenumber", "r", F.col("rank").alias("rn"))


@query("""
SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS run,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rng, max(o_orderkey) OVER (PARTITION BY o_custkey) AS hi,
  sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS near,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q
FROM orders
""")
def w_running(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    by = w.orderBy("o_orderdate", "o_orderkey")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", F.sum("o_orderkey").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("run"), F.count("*").over(w.orderBy("o_orderdate")).alias("rng"), F.max("o_orderkey").over(w).alias("hi"),
        F.sum("o_orderkey").over(by.rowsBetween(-2, 1)).alias("near"), F.lag("o_orderkey").over(by).alias("prev"), F.dense_rank().over(w.orderBy("o_orderstatus")).alias("dr"), F.ntile(4).over(w.orderBy("o_orderkey")).alias("q"),
    )


# --- order, limit, exchange, sets ------------------------------------------------------------


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 25 OFFSET 5")
def o_top_k(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice").orderBy(F.desc("p_size"), "p_retailprice", "p_partkey").offset(5).limit(25)


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey")
def o_sort_nulls(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderstatus, 'O')").alias("s")).orderBy(F.desc_nulls_last("s"), "o_orderkey")


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def o_union_all(spark, sf_dir):
    return R.union_all(t(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")), t(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


def _sets(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_custkey"), o.filter("o_orderstatus = 'F'").select("o_custkey")


_A, _B = "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'"


@query(f"{_A} UNION {_B}")
def o_union(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.union(b).distinct()


@query(f"{_A} INTERSECT {_B}")
def o_intersect(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}")
def o_except(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.subtract(b)


@query(f"{_A} EXCEPT ALL {_B}")
def o_except_all(spark, sf_dir):
    a, b = _sets(spark, sf_dir)
    return a.exceptAll(b)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def o_exchanges(spark, sf_dir):
    """Hash, range and round-robin exchanges keep every row."""
    d = t(spark, sf_dir, "orders").repartition(4, "o_custkey").repartitionByRange(4, "o_orderkey").repartition(3)
    return d.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT doc_id, unnest(string_split(source, 'c')) AS part FROM documents")
def o_explode(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("source", "c")).alias("part"))


# --- scalar functions ------------------------------------------------------------------------


@query(r"""
SELECT doc_id, substr(text, 3, 20) AS sub, upper(source) AS up, lower(substr(text, 1, 10)) AS low, length(text) AS n, replace(source, 'src', 's-') AS rep, concat(lang, ':', source) AS cat, strpos(text, 'the') AS at,
  starts_with(text, 'The') AS sw, ends_with(text, '.') AS ew, contains(text, 'password') AS co, md5(text) AS m, coalesce(nullif(lang, 'en'), 'x') AS co2, CASE WHEN n_chars > 5000 THEN 'long' WHEN n_chars > 500 THEN 'mid' ELSE 'short' END AS kind, greatest(n_chars, doc_id) AS g
FROM documents
""")
def f_strings(spark, sf_dir):
    c = F.col
    kind = F.when(c("n_chars") > 5000, "long").when(c("n_chars") > 500, "mid").otherwise("short")
    return t(spark, sf_dir, "documents").select(
        "doc_id", F.substring("text", 3, 20).alias("sub"), F.upper("source").alias("up"), F.lower(F.substring("text", 1, 10)).alias("low"), F.length("text").alias("n"), F.replace("source", F.lit("src"), F.lit("s-")).alias("rep"),
        F.concat("lang", F.lit(":"), "source").alias("cat"), F.instr("text", "the").alias("at"), c("text").startswith("The").alias("sw"), c("text").endswith(".").alias("ew"), c("text").contains("password").alias("co"),
        F.md5("text").alias("m"), F.coalesce(F.expr("nullif(lang, 'en')"), F.lit("x")).alias("co2"), kind.alias("kind"), F.greatest("n_chars", "doc_id").alias("g"),
    )


@query("""
SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE::VARCHAR AS m, date_trunc('year', o_orderdate)::DATE::VARCHAR AS y, epoch(o_orderdate)::BIGINT AS secs, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M') AS hm, hour(o_orderdate) AS h,
  epoch_ms(o_orderdate + INTERVAL 3 DAY) AS plus3, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE::VARCHAR AS next_month, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days
FROM orders
""")
def f_dates(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", F.trunc(ts, "MM").cast("string").alias("m"), F.trunc(ts, "year").cast("string").alias("y"), F.unix_timestamp(ts).alias("secs"), F.date_format(ts, "yyyy-MM-dd").alias("d"), F.date_format(ts, "HH:mm").alias("hm"), F.hour(ts).alias("h"),
        S.date_add_days(ts, F.lit(3)).alias("plus3"), F.add_months(ts.cast("date"), 1).cast("string").alias("next_month"), F.datediff(ts.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"),
    )


@query("""
SELECT c_custkey, c_acctbal::DECIMAL(12, 2)::VARCHAR AS d, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, c_custkey::VARCHAR AS s, try_cast(substr(c_name, 10) AS BIGINT) AS n, try_cast(c_name AS INTEGER) AS bad, (c_custkey / nullif(c_nationkey, 0))::DOUBLE AS q, (c_acctbal > 0)::INTEGER AS b
FROM customer
""")
def f_casts(spark, sf_dir):
    c = F.col
    return t(spark, sf_dir, "customer").select(
        "c_custkey", c("c_acctbal").cast("decimal(12,2)").cast("string").alias("d"), F.abs("c_acctbal").alias("a"), F.round("c_acctbal", 1).alias("r"), c("c_custkey").cast("string").alias("s"), F.substring("c_name", 10, 100).try_cast("long").alias("n"),
        c("c_name").try_cast("int").alias("bad"), F.try_divide(c("c_custkey"), c("c_nationkey")).alias("q"), (c("c_acctbal") > 0).cast("int").alias("b"),
    )


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, coalesce(json_extract_string(props, '$.nope'), 'none') AS d, NULL::VARCHAR AS q, '[' || json_extract_string(props, '$.k') || ']' AS w FROM events
""")
def f_json(spark, sf_dir):
    p = F.col("props")
    return t(spark, sf_dir, "events").select("event_id", S.json_value(p, "$.k").alias("k"), S.json_value(p, "$.nope", "none").alias("d"), S.json_query(p, "$.k").alias("q"), S.json_query(p, "$.k", "always").alias("w"))


@query(r"""
SELECT page_id, CASE WHEN regexp_matches(url, '/([a-z]{2})/') THEN regexp_extract(url, '/([a-z]{2})/', 1) END AS lang, CASE WHEN regexp_matches(url, 'page=([0-9]+)') THEN regexp_extract(url, 'page=([0-9]+)', 1) END AS page,
  string_split(url, '/')[3] AS host, string_split(url, '?')[2] AS q, string_split(url, '/')[100] AS none, length(url) - length(replace(url, '/', '')) AS slashes, char_length(url) AS n
FROM pages
""")
def f_stream_scalars(spark, sf_dir):
    u = F.col("url")
    return t(spark, sf_dir, "pages").select(
        "page_id", S.regexp_extract_null(u, "/([a-z]{2})/").alias("lang"), S.regexp_extract_null(u, "page=([0-9]+)").alias("page"), S.split_index(u, "/", 2).alias("host"), S.split_index(u, "?", 1).alias("q"),
        S.split_index(u, "/", 99).alias("none"), S.count_char(u, "/").alias("slashes"), F.char_length(u).alias("n"),
    )


@query()
def f_hashes(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey", S.hash_code(F.col("c_name")).alias("h"), F.xxhash64("c_name").alias("x"))


# --- rewrites --------------------------------------------------------------------------------


@query("SELECT DISTINCT o_orderkey FROM orders WHERE o_orderkey IN (SELECT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)")
def r_self_join_in(spark, sf_dir):
    keys = rewrites.in_self_join_distinct(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey")
    return t(spark, sf_dir, "orders").join(keys, F.expr("o_orderkey = l_orderkey"), "left_semi").select("o_orderkey")


@query("""
SELECT (SELECT count(*) FROM lineitem WHERE l_quantity <= 10) AS n1, (SELECT round(avg(l_discount), 9) FROM lineitem WHERE l_quantity BETWEEN 11 AND 20) AS a2, (SELECT max(l_orderkey) FROM lineitem WHERE l_returnflag = 'R') AS m3
""")
def r_scalar_aggregates(spark, sf_dir):
    c = F.col
    d = rewrites.merge_scalar_aggregates(t(spark, sf_dir, "lineitem"), [(c("l_quantity") <= 10, "count", "*", "n1"), (c("l_quantity").between(11, 20), "avg", "l_discount", "a2"), (c("l_returnflag") == "R", "max", "l_orderkey", "m3")])
    return d.withColumn("a2", F.round("a2", 9))


@query("SELECT * FROM (SELECT count(*) AS n1, sum(l_linenumber)::BIGINT AS s1 FROM lineitem WHERE l_tax > 0.04) CROSS JOIN (SELECT count(*) AS n2, min(l_partkey) AS m2 FROM lineitem WHERE l_tax <= 0.04)")
def r_joined_aggregates(spark, sf_dir):
    c = F.col("l_tax")
    return rewrites.combine_joined_aggregates(t(spark, sf_dir, "lineitem"), [(c > 0.04, [("count", "*", "n1"), ("sum", "l_linenumber", "s1")]), (c <= 0.04, [("count", "*", "n2"), ("min", "l_partkey", "m2")])])


@query("SELECT n_name, r_name, count(*) AS n FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY ALL")
def r_connected_join(spark, sf_dir):
    tables = {k: t(spark, sf_dir, k) for k in ("supplier", "region", "nation")}
    d = rewrites.connected_join(tables, [("supplier", "nation", F.expr("s_nationkey = n_nationkey")), ("nation", "region", F.expr("n_regionkey = r_regionkey"))])
    return d.groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS s FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 100")
def r_topk_aggregate(spark, sf_dir):
    return rewrites.topk_through_aggregate(t(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.count("*").alias("n"), F.sum("l_quantity").alias("s")], ["l_orderkey"], 100)


# --- streaming: each runs the stream over all events and returns its final rows ---------------


def events(spark, sf_dir, delay="30 days"):
    """A delay that no event exceeds: batch and stream agree on every row."""
    schema = t(spark, sf_dir, "events").schema
    return io.event_time(io.stream(spark, f"{sf_dir}/events.parque[t]", schema), "ts", delay)  # a pattern, so that it may be a file


def once(df, mode):
    return T.run_once(df, shared_dir(df.sparkSession), mode)


_AGGS = "count(*) AS n, sum(user_id)::BIGINT AS s, min(event_id) AS lo, max(event_id) AS hi"


def _aggs():
    return F.count("*").alias("n"), F.sum("user_id").alias("s"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi")


def _ntz(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


@query(f"SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, {_AGGS} FROM events GROUP BY 1, 2, 3")
def t_tumble(spark, sf_dir):
    d = once(T.tumbling(events(spark, sf_dir), "ts", "1 hour", ["event_type"], *_aggs()), "update")
    return _ntz(T.upserted(d, ["window_start", "window_end", "event_type"]))


@query(f"""
SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, {_AGGS}
FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1, 2, 3
""")
def t_hop(spark, sf_dir):
    d = once(T.hopping(events(spark, sf_dir), "ts", "1 hour", "30 minutes", ["event_type"], *_aggs()), "update")
    return _ntz(T.upserted(d, ["window_start", "window_end", "event_type"]))


@query(f"""
WITH s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events))
SELECT min(ts) AS window_start, max(ts) + INTERVAL 2 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, g
""")
def t_session(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    d = T.session(io.event_time(spark.read.parquet(path), "ts"), "ts", "2 hours", ["user_id"], F.count("*").alias("n"))
    return _ntz(d)


@query(f"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + to_minutes(15 * i) AS window_end, event_type, count(*) AS n
FROM events, range(1, 5) r(i) WHERE ts < time_bucket(INTERVAL 1 HOUR, ts) + to_minutes(15 * i) GROUP BY 1, 2, 3
""")
def t_cumulate(spark, sf_dir):
    d = once(T.cumulating(events(spark, sf_dir), "ts", 3600, 900, ["event_type"], F.count("*").alias("n")), "update")
    return _ntz(T.upserted(d, ["window_start", "window_end", "event_type"]))


@query("SELECT user_id, count(*) AS n, max(event_id) AS hi, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1")
def t_group_aggregate(spark, sf_dir):
    d = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("hi"), F.count(F.when(F.col("event_type") == "click", 1)).alias("clicks"))
    return T.upserted(once(d, "update"), ["user_id"])


@query("SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def t_dedup_first(spark, sf_dir):
    d = T.ranked(events(spark, sf_dir).withColumn("at", F.unix_micros("ts")), "user_id", "at", 1, ["at", "event_id"], "user_id long, at long, event_id long, rank long", last=False)
    return T.upserted(once(d, "update"), ["user_id"]).select("user_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "event_id")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events QUALIFY rank <= 3")
def t_top_n(spark, sf_dir):
    d = T.ranked(events(spark, sf_dir), "user_id", "event_id", 3, ["event_id"], "user_id long, event_id long, rank long")
    return T.upserted(once(d, "update"), ["user_id", "rank"])


@query("SELECT user_id, max(value) AS value FROM events GROUP BY 1")
def t_keyed_reduce(spark, sf_dir):
    return T.upserted(once(T.reduced(events(spark, sf_dir), "user_id", "value", max, "user_id long, value double"), "update"), ["user_id"])


@query("SELECT event_id, user_id, c_mktsegment FROM events JOIN customer ON c_custkey = user_id")
def t_lookup_join(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return once(T.lookup_join(events(spark, sf_dir).select("event_id", "user_id"), c, "user_id"), "append").drop("_batch")


@query("""
SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 5 MINUTE AND a.ts + INTERVAL 5 MINUTE
WHERE a.event_type <> b.event_type
""")
def t_interval_join(spark, sf_dir):
    a = events(spark, sf_dir).select(F.col("event_id").alias("left_id"), F.col("user_id").alias("u1"), F.col("ts").alias("t1"), F.col("event_type").alias("k1"))
    b = events(spark, sf_dir).select(F.col("event_id").alias("right_id"), F.col("user_id").alias("u2"), F.col("ts").alias("t2"), F.col("event_type").alias("k2"))
    d = T.interval_join(a, b, F.expr("u1 = u2 and k1 <> k2"), ("t1", "t2"), "5 minutes", "5 minutes")
    return once(d.select("left_id", "right_id"), "append").drop("_batch")


@query("SELECT a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b ON a.user_id = b.user_id AND time_bucket(INTERVAL 1 HOUR, a.ts) = time_bucket(INTERVAL 1 HOUR, b.ts) WHERE a.event_type = 'click' AND b.event_type = 'view'")
def t_window_join(spark, sf_dir):
    e = events(spark, sf_dir)
    a = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("t1"))
    b = events(spark, sf_dir).filter("event_type = 'view'").select("user_id", F.col("event_id").alias("right_id"), F.col("ts").alias("t2"))
    return once(T.window_join(a, b, ("t1", "t2"), "1 hour", ["user_id"]).select("left_id", "right_id"), "append").drop("_batch")


@query("SELECT DISTINCT user_id, event_type FROM events")
def t_distinct(spark, sf_dir):
    return once(T.distinct_within(events(spark, sf_dir), ["user_id", "event_type"]).select("user_id", "event_type"), "append").drop("_batch")


# --- user functions, analysis ----------------------------------------------------------------


@query("SELECT p_partkey, p_size * 2 + 1 AS x FROM part")
def u_pandas_udf(spark, sf_dir):
    @F.pandas_udf("int")
    def f(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    return t(spark, sf_dir, "part").select("p_partkey", f("p_size").alias("x"))


@query("SELECT p_brand, round(median(p_retailprice), 6) AS m FROM part GROUP BY 1")
def u_grouped_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def f(v: pd.Series) -> float:
        return float(v.median())

    return t(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(f("p_retailprice"), 6).alias("m"))


@query("SELECT p_partkey, unnest(range(p_size % 4)) AS i FROM part")
def u_table_function(spark, sf_dir):
    def f(batches):
        for b in batches:
            b = b.assign(i=[list(range(n % 4)) for n in b["p_size"]]).explode("i").dropna()
            yield b[["p_partkey", "i"]].astype("int64")

    return t(spark, sf_dir, "part").select("p_partkey", "p_size").mapInPandas(f, "p_partkey long, i long")


@query()
def x_plan_report(spark, sf_dir):
    return analyzer.report(spark, q_pricing_summary(spark, sf_dir))


from . import queries_analytic, queries_more, queries_runs  # noqa: E402, F401  they register their queries
