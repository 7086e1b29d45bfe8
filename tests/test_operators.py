import re
import subprocess
import sys
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom import queries
from sparkloom.functions import scalars as S
from sparkloom.operators import relational as R
from sparkloom.plans import analyzer, rewrites
from sparkloom.sources import io


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_self_join_rewrite_ignores_nulls_and_equal_values(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2), (3, None), (3, 1), (None, 1), (None, 2)], "k int, v int")
    plain = d.alias("a").join(d.alias("b"), F.expr("a.k = b.k and a.v <> b.v")).select("a.k").distinct()
    assert rows(rewrites.in_self_join_distinct(d, "k", "v")) == rows(plain) == [(2,)]


def test_rollup_in_two_phases_is_the_rollup(spark):
    d = spark.createDataFrame([("x", None, 1), ("x", "b", None), (None, "b", 3), ("x", None, 4)], "a string, b string, v int")
    got = rewrites.rollup_two_phase(d, ["a", "b"], [("sum", "v", "s"), ("count", "v", "n"), ("min", "v", "lo")])
    want = d.rollup("a", "b").agg(F.grouping_id().alias("gid"), F.sum("v").alias("s"), F.count("v").alias("n"), F.min("v").alias("lo"))
    assert rows(got) == rows(want)
    with pytest.raises(ValueError):
        rewrites.rollup_two_phase(d, ["a"], [("avg", "v", "a")])


def test_top_groups_keep_null_keys_and_ties(spark):
    d = spark.createDataFrame([(None, 1), (1, 2), (1, 3), (2, 4), (3, 5)], "k int, v int")
    got = rewrites.topk_through_aggregate(d, ["k"], [F.sum("v").alias("s")], ["k"], 2)
    assert rows(got) == rows(d.groupBy("k").agg(F.sum("v").alias("s")).orderBy("k").limit(2))


def test_unconnected_tables_are_crossed_last(spark):
    a, b, c = (spark.createDataFrame([(1,), (2,)], f"{n} int") for n in "abc")
    d = rewrites.connected_join({"a": a, "b": b, "c": c}, [("a", "c", F.expr("a = c"))])
    assert rows(d.select("a", "b", "c")) == [(1, 1, 1), (1, 2, 1), (2, 1, 2), (2, 2, 2)]


def test_join_strategies_show_in_the_plan(spark, data):
    o, c = spark.read.parquet(f"{data}/orders.parquet"), spark.read.parquet(f"{data}/customer.parquet")
    for strategy, node in (("broadcast_hash", "BroadcastHashJoin"), ("shuffled_hash", "ShuffledHashJoin"), ("sort_merge", "SortMergeJoin")):
        assert node in analyzer.plan_text(R.join(o, c, F.expr("o_custkey = c_custkey"), strategy=strategy))


def test_filters_and_columns_reach_the_scan(spark, data):
    text = analyzer.plan_text(io.scan(spark, f"{data}/lineitem.parquet").filter("l_quantity > 40").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


def test_scalars_follow_their_null_rules(spark):
    d = spark.createDataFrame([("a,b", '{"k":{"x":1},"s":"t"}'), (None, None), ("", "bad")], "s string, j string")
    c, j = F.col("s"), F.col("j")
    got = d.select(S.regexp_extract_null(c, "(z)"), S.split_index(c, ",", 1), S.split_index(c, ",", 9), S.count_char(c, ","), S.json_value(j, "$.k", "d"), S.json_query(j, "$.k"), S.json_query(j, "$.s", "conditional")).collect()
    assert tuple(got[0]) == (None, "b", None, 1, "d", '{"x":1}', '["t"]')
    assert tuple(got[1]) == (None, None, None, None, "d", None, None)
    assert tuple(got[2]) == (None, None, None, 0, "d", None, None)


def test_writer_modes_and_partitions(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "v int, p string")
    for mode, n in (("overwrite", 3), ("append", 6), ("ignore", 6), ("overwrite", 3)):
        io.write(d, str(tmp_path / "t"), "orc", mode, ("p",))
        assert io.scan(spark, str(tmp_path / "t"), "orc").count() == n
    assert rows(io.scan(spark, str(tmp_path / "t"), "orc").select("v", "p")) == [(1, "a"), (2, None), (3, None)]


def test_first_per_key_and_ranks(spark):
    d = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (2, 2, "b")], "k int, o int, s string")
    assert rows(R.first_per_key(d, ["k"], "o")) == [(1, 1, "a"), (2, 2, "b")]
    assert rows(R.first_per_key(d, ["k"], "o", last=True)) == [(1, 3, "c"), (2, 2, "b")]


def test_entry_works(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()


NODES = {"broadcast_hash": "BroadcastHashJoin", "shuffled_hash": "ShuffledHashJoin", "sort_merge": "SortMergeJoin", "nested_loop": "BroadcastNestedLoopJoin"}


@pytest.mark.parametrize("strategy", sorted(NODES))
def test_each_join_type_runs_by_the_strategy_named(spark, data, strategy):
    from sparkloom import queries, queries_more

    for how in queries_more.LEGAL[strategy]:
        df = queries.QUERIES[f"j_{strategy}_{how}"](spark, data)
        assert NODES[strategy] in df._jdf.queryExecution().executedPlan().toString(), how


def test_a_large_side_is_not_broadcast(spark, monkeypatch):
    from sparkloom.operators import relational as R

    monkeypatch.setattr(R, "BROADCAST_BYTES", 0)
    a, b = spark.range(10).toDF("k"), spark.range(5).toDF("k")
    for how in ("inner", "right"):
        assert "SortMergeJoin" in R.join(a, b, "k", how, "broadcast_hash")._jdf.queryExecution().executedPlan().toString()


def test_top_per_key_limits_before_the_shuffle(spark, data):
    from sparkloom import queries

    plan = queries.QUERIES["w_top_rank"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan[plan.index("WindowGroupLimit") :]


def test_filters_reach_the_scan(spark, data):
    d = spark.read.parquet(f"{data}/orders.parquet")
    plan = d.filter("o_orderkey = 3 or o_custkey is null").filter("not o_orderstatus = 'F'")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "Or(" in pushed and "Not(" in pushed and "IsNull" in pushed


def test_bucketed_tables_join_without_a_shuffle(spark, data):
    from sparkloom.sources import io

    names = ["sparkloom_b1", "sparkloom_b2"]
    try:
        for n, (table, key) in zip(names, (("orders", "o_custkey"), ("customer", "c_custkey"))):
            io.write_bucketed(spark.read.parquet(f"{data}/{table}.parquet"), n, 4, key)
        a, b = (spark.table(n) for n in names)
        plan = a.hint("merge").join(b, a.o_custkey == b.c_custkey)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "id long, v long"

    def run():
        q = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).groupBy("id").sum("v").writeStream.outputMode("update")
        out = []
        q = q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda d, n: out.extend(map(tuple, d.collect()))).start()
        q.awaitTermination()
        return sorted(out)

    spark.createDataFrame([(1, 1), (2, 5)], schema).write.parquet(str(tmp_path / "in"))
    assert run() == [(1, 1), (2, 5)]
    spark.createDataFrame([(1, 2)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(1, 3)] and run() == []


def test_partitions_are_pruned_by_the_other_side(spark, data):
    assert "dynamicpruning" in analyzer.plan_text(queries.QUERIES["s_dynamic_pruning"](spark, data))


def test_bucketed_tables_join_without_a_shuffle(spark, data):
    d = queries.QUERIES["s_bucketed_join"](spark, data)
    assert "SortMergeJoin" in analyzer.plan_text(d) and "Exchange" not in analyzer.plan_text(d)


def test_ranges_reach_orc_and_either_or_reaches_parquet(spark, data, tmp_path):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    io.write(orders, str(tmp_path / "orc"), "orc")
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # the plan's text cuts long lists
    for d in (io.scan(spark, str(tmp_path / "orc"), "orc"), orders):
        got = analyzer.plan_text(d.filter("(o_orderkey < 10 or o_orderkey > 5000) and not o_orderstatus = 'P' and o_custkey is not null").select("o_orderkey"))
        pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", got)[1]
        assert all(x in pushed for x in ("Or(LessThan(o_orderkey,10),GreaterThan(o_orderkey,5000))", "IsNotNull(o_custkey)", "Not(EqualTo(o_orderstatus,P))"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_bids_repeat_and_keep_to_their_ranges(spark):
    a, b = (sorted(map(tuple, io.bids(spark, 500, auctions=7, bidders=3).collect())) for _ in range(2))
    assert a == b and len(a) == 500
    assert {x[0] for x in a} == set(range(7)) and {x[1] for x in a} == set(range(3)) and all(1 <= x[2] <= 10_000 for x in a)


def test_event_log_of_a_real_session(spark, data, tmp_path):
    code = f"""
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true").config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").config("spark.eventLog.dir", "file:{tmp_path}").getOrCreate()
s.read.parquet("{data}/orders.parquet").groupBy("o_orderstatus").count().collect()
s.read.parquet("{data}/orders.parquet").orderBy("o_totalprice").collect()
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    log = analyzer.event_log(spark, str(tmp_path))
    assert log.filter("ms >= 0 and plan is not null").count() >= 2
    got = {r.name: r for r in analyzer.log_report(spark, str(tmp_path)).collect()}
    assert got["HashAggregate"].executions == 1 and got["HashAggregate"].times == 2 and got["HashAggregate"].covered
    assert got["Sort"].group == "order" and got["Sort"].ms >= 0 and got["Scan"].executions == 2


def test_partitionings_are_no_functions(spark, data):
    d = spark.read.parquet(f"{data}/orders.parquet").groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("s"))
    assert [f for f in analyzer.functions(analyzer.plan_text(d)) if "partition" in f] == []


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, old)


def odd_orders(spark, folder):
    """Customers and orders with null, repeated and unmatched keys, keys over many batches, and numbers beyond 2**53."""
    customers = [(k,) for k in [None, None, 1, 1, *range(2, 60), 2**60]]
    orders = [(None if i % 9 == 0 else 2**60 + i, (i * i) % 70 if i % 5 else None) for i in range(400)] + [(2**60 + 1000 + i, 2**60) for i in range(50)]
    spark.createDataFrame(customers, "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")


def same_as_sql(spark, folder, name, *tables):
    import duckdb

    c = duckdb.connect()
    for n in tables:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet/*.parquet'")
    want = c.execute(queries.SQL[name]).fetchall()
    columns = [d[0] for d in c.description]
    return sorted(map(str, map(tuple, queries.QUERIES[name](spark, str(folder)).select(*columns).collect()))) == sorted(map(str, want))


def test_co_grouped_meets_whole_keys_many_a_call(spark, small_batches):
    a = spark.createDataFrame([(k, k) for k in [None, *range(300)]], "k long, x long")
    b = spark.createDataFrame([(i % 60 if i % 7 else None, str(i)) for i in range(400)], "k long, y string")

    def f(a, b):
        keys = sorted({-1 if v is pd.NA else v for v in [*a["k"], *b["k"]]})
        n, m = a["k"].fillna(-1).value_counts(), b["k"].fillna(-1).value_counts()
        return pd.DataFrame([(k, n.get(k, 0), m.get(k, 0)) for k in keys], columns=["k", "n", "m"]).assign(call=uuid.uuid4().hex)

    got = R.co_grouped(a, b, "k", f, "k long, n long, m long, call string").collect()
    want = {k: [1, sum((i % 60 if i % 7 else -1) == k for i in range(400))] for k in range(-1, 300)}
    assert {r.k: [r.n, r.m] for r in got} == want and len(got) == len(want)
    assert len({r.call for r in got}) < len(want)


def test_j_cogroup_on_odd_keys(spark, small_batches, tmp_path):
    odd_orders(spark, tmp_path)
    assert same_as_sql(spark, tmp_path, "j_cogroup", "customer", "orders")


def test_a_function_in_pandas_gets_whole_keys_many_a_call(spark, small_batches):
    d = spark.createDataFrame([(None if i % 11 == 0 else str(i % 200), i) for i in range(1000)], "k string, v long").union(spark.createDataFrame([("x", i) for i in range(100)], "k string, v long"))

    def f(pdf):
        return pdf.groupby("k", dropna=False)["v"].agg(n="count", s="sum").reset_index().assign(call=uuid.uuid4().hex)

    got = R.applied_in_pandas(d, "k", f, "k string, n long, s long, call string").collect()
    want = d.groupBy("k").agg(F.count("v"), F.sum("v")).collect()
    assert sorted((r[:3] for r in got), key=str) == sorted(map(tuple, want), key=str)
    assert len({r.call for r in got}) < len(want)
    with pytest.raises(ValueError):
        R.applied_in_pandas(d.select(F.col("v").cast("double").alias("k")), "k", f, "k double")


def test_u_apply_in_pandas_on_odd_keys(spark, small_batches, tmp_path):
    odd_orders(spark, tmp_path)
    assert same_as_sql(spark, tmp_path, "u_apply_in_pandas", "orders")


def odd_values(spark):
    rows = [(k, float(i * i % 977 - 300) if i % 13 else None, i % 5 or None) for k in ("a", "b", None) for i in range(700)]
    rows += [("one", 2.5, 7), ("two", -1.0, None), ("two", 4.0, None), ("none", None, None), ("none", None, None), *[("tie", 3.0, 3)] * 50]
    rows += [("nan", v, 1) for v in (float("nan"), 1.0, float("nan"), 2.0, 0.0)] + [("inf", v, 1) for v in (float("inf"), float("-inf"), 1.0, float("inf"))]
    return spark.createDataFrame(rows, "k string, x double, n int").repartition(3)


QUANTILES = {"lo": ("x", 0.0), "q": ("x", 0.37), "mid": ("n", 0.5), "tail": ("x", 0.999), "hi": ("n", 1.0)}


@pytest.mark.parametrize("proposal", ["own", "least", "most", "apart", "crossed"])
def test_quantiles_are_exact_whatever_the_proposal(spark, monkeypatch, proposal):
    d = odd_values(spark)
    want = d.groupBy("k").agg(*[F.percentile(c, q).alias(n) for n, (c, q) in QUANTILES.items()]).collect()
    pair = {"least": (F.min, F.min), "most": (F.max, F.max), "apart": (F.min, F.max), "crossed": (F.max, F.min)}.get(proposal)
    if pair:
        monkeypatch.setattr(F, "percentile_approx", lambda c, _: F.array(*[f(c) for f in pair]))
    got = R.quantiles(d, "k", QUANTILES).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_a_statistics_holds_no_map_of_values(spark, tmp_path):
    rows = [(("A", "R", None)[i % 3], i % 9 if i % 7 else None, i % 50 * 1.0 if i % 11 else None, i * 7919 % 10007 / 100, i % 11 / 100) for i in range(3000)]
    spark.createDataFrame(rows, "l_returnflag string, l_partkey long, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert same_as_sql(spark, tmp_path, "a_statistics", "lineitem")
    assert not re.search(r"\b(percentile|median)\(", analyzer.plan_text(queries.QUERIES["a_statistics"](spark, str(tmp_path))))
