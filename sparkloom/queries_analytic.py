"""Analytic query shapes: star joins, HAVING, reused subqueries, year-over-year joins, set operations, rollups over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
CENTS = "sum(CAST(round(l_extendedprice * 100) AS BIGINT))"


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """``text`` over the tables, given as frames: no view is left behind."""
    used = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in TABLES if f"{{{n}}}" in text}
    return spark.sql(text, **used)


def _both(name: str, text: str, duck: str | None = None) -> None:
    """Registers one text for Spark and, with plain table names, for the comparison."""
    plain = duck or text
    for n in TABLES:
        plain = plain.replace(f"{{{n}}}", n)

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _sql(spark, sf_dir, text)

    f.__name__, f.__doc__ = name, f"{name}: one SQL text."
    query(plain)(f)


_both("q_star_join", f"""
SELECT r_name, p_brand, {CENTS} AS cents, count(*) AS n FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey JOIN {{supplier}} ON s_suppkey = l_suppkey
JOIN {{nation}} ON n_nationkey = s_nationkey JOIN {{region}} ON r_regionkey = n_regionkey WHERE p_size BETWEEN 5 AND 30 GROUP BY r_name, p_brand
""")
_both("q_five_joins", f"""
SELECT n_name, {CENTS} AS cents FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey
JOIN {{nation}} ON s_nationkey = n_nationkey WHERE o_orderstatus <> 'P' GROUP BY n_name HAVING count(*) > 3
""")
_both("q_having", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS hi FROM {orders} GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 100000")
_both("q_reused_cte", """
WITH y AS (SELECT o_custkey AS k, year(o_orderdate) AS y, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM {orders} GROUP BY 1, 2)
SELECT a.k, a.y, a.n AS n_now, b.n AS n_before, CAST(a.cents - b.cents AS BIGINT) AS gain FROM y a JOIN y b ON a.k = b.k AND a.y = b.y + 1 WHERE a.cents > b.cents
""")
_both("q_above_average", """
SELECT p_partkey, p_brand FROM {part} p WHERE p_retailprice > (SELECT avg(p_retailprice) + 1e-6 FROM {part} q WHERE q.p_brand = p.p_brand)
""")
_both("q_empty_scalar", "SELECT r_name, (SELECT max(n_nationkey) FROM {nation} WHERE n_name = 'none') AS none FROM {region}")
_both("q_exists_chain", """
SELECT s_suppkey FROM {supplier} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49)
AND NOT EXISTS (SELECT 1 FROM {nation} WHERE n_nationkey = s_nationkey AND n_regionkey = 0)
""")
_both("q_intersect_except", """
SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O' EXCEPT SELECT c_custkey FROM {customer} WHERE c_acctbal < 0
""")
_both("o_intersect_all", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'O'")
_both("q_rollup_join", f"""
SELECT r_name, n_name, {CENTS} AS cents, grouping(r_name) + grouping(n_name) AS lvl FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{nation}} ON n_nationkey = s_nationkey JOIN {{region}} ON r_regionkey = n_regionkey
GROUP BY ROLLUP (r_name, n_name)
""")
_both("q_pivot", """
SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS p FROM {orders} GROUP BY o_orderpriority
""")
_both("q_share_of_total", """
SELECT s_suppkey, n, rank() OVER (PARTITION BY s_nationkey ORDER BY n DESC) AS r, round(n / sum(n) OVER (PARTITION BY s_nationkey), 9) AS share
FROM (SELECT s_suppkey, s_nationkey, CAST(count(*) AS DOUBLE) AS n FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_nationkey)
""")
_both("w_range_frame", """
SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near, lag(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before,
  ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 9) AS cd FROM {orders}
""")
