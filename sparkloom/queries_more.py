"""Further registered queries: joins by strategy and type, aggregates, scalars, user functions by name, streams."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .functions import scalars as S
from .operators import relational as R
from .queries import events, once, query, t
from .streaming import ops as T

# --- joins: each strategy with each type it has -----------------------------------------------

TYPES = {"inner": "INNER JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "full": "FULL JOIN", "left_semi": "SEMI JOIN", "left_anti": "ANTI JOIN"}
#: A broadcast hash join has no full outer form.
LEGAL = {"broadcast_hash": ("inner", "left", "right", "left_semi", "left_anti"), "shuffled_hash": tuple(TYPES), "sort_merge": tuple(TYPES), "nested_loop": tuple(TYPES)}


def _join(strategy: str, how: str) -> None:
    """Null keys on both sides, keys without a partner on both sides, and a condition besides."""
    one = how in ("left_semi", "left_anti")
    if strategy == "nested_loop":
        sql = f"SELECT c_custkey{'' if one else ', n_name'} FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c {TYPES[how]} (SELECT n_name, nullif(n_nationkey, 4) AS nk FROM nation) n ON k + 15 < nk"
    else:
        sql = f"""SELECT o_orderkey{'' if one else ', c_custkey'} FROM (SELECT o_orderkey, o_totalprice, nullif(o_custkey, 51) AS k FROM orders) o
        {TYPES[how]} (SELECT c_custkey, c_acctbal, nullif(c_custkey + 40, 50) AS ck FROM customer) c ON k = ck AND o_totalprice > c_acctbal * 20"""

    def f(spark, sf_dir):
        if strategy == "nested_loop":
            left = t(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("k"))
            right = t(spark, sf_dir, "nation").select("n_name", F.expr("nullif(n_nationkey, 4)").alias("nk"))
            on, out = F.expr("k + 15 < nk"), ["c_custkey", "n_name"]
        else:
            left = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.expr("nullif(o_custkey, 51)").alias("k"))
            right = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.expr("nullif(c_custkey + 40, 50)").alias("ck"))
            on, out = F.expr("k = ck and o_totalprice > c_acctbal * 20"), ["o_orderkey", "c_custkey"]
        if how == "right" and strategy == "broadcast_hash":  # the left side is sent, so it is the small one
            left, right, on = t(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.expr("nullif(c_custkey + 40, 50)").alias("ck")), left, on
        return R.join(left, right, on, how, strategy).select(*out[: 1 if one else 2])

    if how == "right" and strategy == "broadcast_hash":
        sql = sql.replace("RIGHT JOIN", "LEFT JOIN")
    f.__name__, f.__doc__ = f"j_{strategy}_{how}", f"{how} join by {strategy}."
    query(sql)(f)


for _s, _hows in LEGAL.items():
    for _h in _hows:
        _join(_s, _h)


# --- aggregates --------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k, max(CASE WHEN c_nationkey % 2 = 0 THEN 'even' END) AS f, count(*) AS n FROM customer GROUP BY 1")
def a_first_ignore_nulls(spark, sf_dir):
    """The first value that is not null: one value a group, with nulls before and after it."""
    v = F.when((F.col("c_nationkey") % 2 == 0) & (F.col("c_custkey") % 2 == 0), "even")
    some = F.max(F.when(F.col("c_custkey") % 2 == 0, 1))
    d = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.first(v, ignorenulls=True).alias("f"), some.alias("_some"), F.count("*").alias("n"))
    return d.select("k", F.when(F.col("_some").isNull() & (F.col("k") % 2 == 0), "even").otherwise(F.col("f")).alias("f"), "n")


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS med, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv, TRUE AS near, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY 1")
def a_statistics(spark, sf_dir):
    """Three kinds of aggregate apart: beside a distinct count, Spark keeps a state of every other one for each distinct value."""
    d = t(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "flag")
    quantiles = R.quantiles(d, "flag", {"q1": ("l_quantity", 0.25), "med": ("l_extendedprice", 0.5)})
    parts = d.select("flag", "l_partkey").distinct().groupBy("flag").agg(F.count("l_partkey").alias("parts"))
    others = d.groupBy(F.col("flag").alias("l_returnflag")).agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cv"), F.round(F.var_pop("l_quantity"), 6).alias("v"), F.approx_count_distinct("l_partkey", 0.02).alias("about")
    )
    same = F.col("l_returnflag").eqNullSafe(F.col("flag"))
    d = others.join(quantiles, same).drop("flag").join(parts, same)
    near = F.abs(F.col("about") - F.col("parts")) <= 0.1 * F.col("parts")
    return d.select("l_returnflag", F.round("q1", 6).alias("q1"), F.round("med", 6).alias("med"), "c", "cv", near.alias("near"), "v")


@query("SELECT l_linestatus, count(DISTINCT l_discount::DECIMAL(4, 2)) AS n, sum(DISTINCT l_discount::DECIMAL(4, 2))::VARCHAR AS s, sum(l_extendedprice::DECIMAL(12, 2))::VARCHAR AS total FROM lineitem GROUP BY 1")
def a_decimal_distinct(spark, sf_dir):
    d = F.col("l_discount").cast("decimal(4,2)")
    total = F.sum(F.col("l_extendedprice").cast("decimal(12,2)"))
    return t(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count_distinct(d).alias("n"), F.sum_distinct(d).cast("string").alias("s"), total.cast("string").alias("total"))


@query("SELECT CASE l_linenumber % 3 WHEN 0 THEN 'nan' ELSE 'zero' END AS k, count(*) AS n FROM lineitem GROUP BY 1")
def a_nan_and_zero_keys(spark, sf_dir):
    """NaN is one group, and so are 0.0 and -0.0."""
    x = F.when(F.col("l_linenumber") % 3 == 0, F.lit(float("nan"))).when(F.col("l_linenumber") % 3 == 1, F.lit(-0.0)).otherwise(F.lit(0.0))
    return t(spark, sf_dir, "lineitem").groupBy(x.alias("x")).agg(F.count("*").alias("n")).select(F.when(F.isnan("x"), "nan").otherwise("zero").alias("k"), "n")


# --- scalars -----------------------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, (a + b)::VARCHAR AS s, (a - b)::VARCHAR AS d, (a * b)::VARCHAR AS m, round(a::DOUBLE / nullif(b, 0)::DOUBLE, 6) AS q, (-a)::VARCHAR AS neg, abs(b - a)::VARCHAR AS ab
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(12, 2) AS a, l_discount::DECIMAL(4, 2) AS b FROM lineitem)
""")
def f_decimal_arithmetic(spark, sf_dir):
    d = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("a"), F.col("l_discount").cast("decimal(4,2)").alias("b"))
    return d.selectExpr("l_orderkey", "l_linenumber", "cast(a + b as string) s", "cast(a - b as string) d", "cast(a * b as string) m", "round(cast(a as double) / nullif(cast(b as double), 0), 6) q", "cast(-a as string) neg", "cast(abs(b - a) as string) ab")


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS f, epoch(o_orderdate)::BIGINT AS u, strftime(o_orderdate, '%H') AS hh, o_orderdate::DATE::VARCHAR AS d, dayofweek(o_orderdate) + 1 AS dow, quarter(o_orderdate) AS q, last_day(o_orderdate::DATE)::VARCHAR AS l,
  epoch_ms(o_orderdate) AS ltz, TRUE AS now FROM orders
""")
def f_time_formats(spark, sf_dir):
    ts = F.col("o_orderdate").cast("timestamp")
    text = F.date_format(ts, "dd/MM/yyyy HH:mm:ss")
    return t(spark, sf_dir, "orders").select(
        "o_orderkey", F.from_unixtime(F.unix_timestamp(ts), "yyyy-MM-dd HH:mm:ss").alias("f"), F.unix_timestamp(text, "dd/MM/yyyy HH:mm:ss").alias("u"), F.date_format(ts, "HH").alias("hh"), F.to_date(F.date_format(ts, "yyyy-MM-dd")).cast("string").alias("d"),
        F.dayofweek(ts).cast("long").alias("dow"), F.quarter(ts).cast("long").alias("q"), F.last_day(ts.cast("date")).cast("string").alias("l"), F.unix_millis(S.to_timestamp_ltz(F.unix_millis(ts))).alias("ltz"), (F.current_timestamp() > ts).alias("now"),
    )


@query("""
SELECT c_custkey, greatest(nullif(c_nationkey, 5), 7) AS g, least(nullif(c_nationkey, 5), 7) AS l, coalesce(nullif(c_mktsegment, 'FURNITURE'), nullif(c_mktsegment, 'MACHINERY'), 'x') AS c, c_custkey::DOUBLE::VARCHAR AS dv, ('19' || lpad((c_custkey % 90 + 10)::VARCHAR, 2, '0') || '-01-05')::DATE::VARCHAR AS dt,
  CASE WHEN c_acctbal IS NULL THEN 0 ELSE sign(c_acctbal) END::DOUBLE AS sg, floor(c_acctbal)::BIGINT AS fl, ceil(c_acctbal)::BIGINT AS ce, reverse(c_name) AS rv, trim('  ' || c_name || ' ') AS tr, lpad(c_mktsegment, 12, '*') AS lp, repeat('ab', c_nationkey % 3) AS rp
FROM customer
""")
def f_nulls_and_casts(spark, sf_dir):
    c = F.col
    nk = F.expr("nullif(c_nationkey, 5)")
    day = F.concat(F.lit("19"), F.lpad((c("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-01-05"))
    return t(spark, sf_dir, "customer").select(
        "c_custkey", F.greatest(nk, F.lit(7)).alias("g"), F.least(nk, F.lit(7)).alias("l"), F.coalesce(F.expr("nullif(c_mktsegment, 'FURNITURE')"), F.expr("nullif(c_mktsegment, 'MACHINERY')"), F.lit("x")).alias("c"), c("c_custkey").cast("double").cast("string").alias("dv"),
        day.cast("date").cast("string").alias("dt"), F.signum("c_acctbal").alias("sg"), F.floor("c_acctbal").alias("fl"), F.ceil("c_acctbal").alias("ce"), F.reverse("c_name").alias("rv"), F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("tr"),
        F.lpad("c_mktsegment", 12, "*").alias("lp"), F.expr("repeat('ab', c_nationkey % 3)").alias("rp"),
    )


@query("""
SELECT c_custkey, c_nationkey::VARCHAR AS v, NULL::VARCHAR AS vo, '[x]' AS vt, 'none' AS missing, '{"n":' || c_nationkey || '}' AS q, '[1,"b"]' AS a, '["[x]"]' AS w, '[' || c_nationkey || ']' AS wn, '["true"]' AS wt, NULL::VARCHAR AS bad, 'p-q' AS sp FROM customer
""")
def f_json_types(spark, sf_dir):
    """Text that looks like an array, a number or a truth value is still text; bad JSON is NULL."""
    j = F.concat(F.lit('{"v":'), F.col("c_nationkey").cast("string"), F.lit(',"o":{"n":'), F.col("c_nationkey").cast("string"), F.lit('},"a":[1,"b"],"t":"[x]","y":"true"}'))
    return t(spark, sf_dir, "customer").withColumn("j", j).select(
        "c_custkey", S.json_value(F.col("j"), "$.v").alias("v"), S.json_value(F.col("j"), "$.o").alias("vo"), S.json_value(F.col("j"), "$.t").alias("vt"), S.json_value(F.col("j"), "$.zz", "none").alias("missing"), S.json_query(F.col("j"), "$.o").alias("q"),
        S.json_query(F.col("j"), "$.a").alias("a"), S.json_query(F.col("j"), "$.t", "always").alias("w"), S.json_query(F.col("j"), "$.v", "conditional").alias("wn"), S.json_query(F.col("j"), "$.y", "conditional").alias("wt"),
        S.json_value(F.concat(F.lit("{"), "j"), "$.v").alias("bad"), S.json_split(F.lit('["p","q"]'), "-").alias("sp"),
    )


# --- generators and user functions --------------------------------------------------------------


@query("SELECT n_nationkey, unnest([n_regionkey, n_nationkey, NULL]) AS x, unnest([0, 1, 2]) AS pos FROM nation")
def o_posexplode(spark, sf_dir):
    a = F.array("n_regionkey", "n_nationkey", F.lit(None).cast("int"))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(a).alias("pos", "x"))


@query("SELECT n_nationkey, unnest(CASE WHEN n_regionkey = 0 THEN [NULL] ELSE [n_regionkey] END) AS x FROM nation")
def o_explode_outer(spark, sf_dir):
    a = F.when(F.col("n_regionkey") == 0, F.array().cast("array<int>")).otherwise(F.array("n_regionkey"))
    return t(spark, sf_dir, "nation").select("n_nationkey", F.explode_outer(a).alias("x"))


@query("SELECT c_custkey, length(c_name) + length(c_mktsegment) AS n FROM customer")
def u_function_by_name(spark, sf_dir):
    """A vectorised function registered under a name and called from SQL."""

    @F.pandas_udf(LongType())
    def both_lengths(a: pd.Series, b: pd.Series) -> pd.Series:
        return a.str.len() + b.str.len()

    spark.udf.register("sparkloom_both_lengths", both_lengths)
    return spark.sql("SELECT c_custkey, sparkloom_both_lengths(c_name, c_mktsegment) AS n FROM {c}", c=t(spark, sf_dir, "customer"))


@query("SELECT o_orderkey, max(o_orderkey) OVER (PARTITION BY o_custkey) - min(o_orderkey) OVER (PARTITION BY o_custkey) AS spread FROM orders")
def u_window_udf(spark, sf_dir):
    """A vectorised aggregate over whole windows."""

    @F.pandas_udf("long")
    def spread(v: pd.Series) -> int:
        return int(v.max() - v.min())

    return t(spark, sf_dir, "orders").select("o_orderkey", spread("o_orderkey").over(Window.partitionBy("o_custkey")).alias("spread"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders")
def u_apply_in_pandas(spark, sf_dir):
    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o_orderkey")
        return pdf.assign(place=pdf.groupby("o_custkey", dropna=False).cumcount())

    return R.applied_in_pandas(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", f, "o_custkey long, o_orderkey long, place long")


@query("SELECT n_nationkey, unnest(string_split(n_name, '_')) AS part FROM nation")
def u_table_function_by_name(spark, sf_dir):
    @F.udtf(returnType="part string")
    class Parts:
        def eval(self, s: str):
            for p in s.split("_"):
                yield (p,)

    spark.udtf.register("sparkloom_parts", Parts)
    return spark.sql("SELECT n_nationkey, p.part FROM {n}, LATERAL sparkloom_parts(n_name) p", n=t(spark, sf_dir, "nation"))


# --- streams -----------------------------------------------------------------------------------


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def t_dedup_last(spark, sf_dir):
    d = T.latest(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_id", "ts"])
    return T.upserted(once(d, "update"), ["user_id"]).select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("""
WITH s AS (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE, TRUE) AS gap FROM events))
SELECT user_id, epoch_us(min(ts)) AS first_us, count(*) AS n, max(event_id) AS hi FROM s GROUP BY user_id, k
""")
def t_session_stream(spark, sf_dir):
    """Session windows as a stream; complete output, so that the last batch holds every session."""
    d = T.session(events(spark, sf_dir), "ts", "30 minutes", ["user_id"], F.count("*").alias("n"), F.max("event_id").alias("hi"))
    d = once(d, "complete")
    last = d.select(F.max("_batch").alias("_last"))
    return d.join(F.broadcast(last), F.col("_batch") == F.col("_last")).select("user_id", F.unix_micros(F.col("window_start").cast("timestamp")).alias("first_us"), "n", "hi")


@query("SELECT event_type, round(avg(value), 6) AS a, max(event_type) AS hi, count(DISTINCT user_id) AS users, coalesce(sum(CASE WHEN value < 0 THEN 1 END), 0)::BIGINT AS neg FROM events GROUP BY 1")
def t_aggregates(spark, sf_dir):
    """Averages, text maxima, a sum that is 0 over nothing, and a distinct count by a set of users (bounded by users a type)."""
    users = F.size(F.collect_set("user_id")).cast("long")
    d = events(spark, sf_dir).groupBy("event_type").agg(F.avg("value").alias("a"), F.max("event_type").alias("hi"), users.alias("users"), R.sum0(F.when(F.col("value") < 0, 1)).alias("neg"))
    return T.upserted(once(d, "update"), ["event_type"]).withColumn("a", F.round("a", 6))
