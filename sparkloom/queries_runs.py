"""Registered queries whose point is how they run: pruning, buckets, sinks, restarts, late rows and state that expires."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import relational as R
from .queries import _ntz, query, t
from .session import shared_dir
from .sources import io
from .streaming import ops as T


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- pruning, buckets, sinks --------------------------------------------------------------------


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def s_dynamic_pruning(spark, sf_dir):
    """Only the partitions of the nations that the other side's filter leaves are read."""
    path = _folder(spark, "customers")
    io.write(t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").repartition("c_nationkey"), path, by=("c_nationkey",))
    nations = t(spark, sf_dir, "nation").filter("n_regionkey = 1")
    return io.scan(spark, path).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT o_custkey, any_value(c_name) AS c_name, count(*) AS n, max(o_orderkey) AS hi FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def s_bucketed_join(spark, sf_dir):
    """Two tables bucketed by one key: neither the join nor the aggregate on that key shuffles."""
    names = []
    for name, key, columns in (("orders", "o_custkey", ["o_custkey", "o_orderkey"]), ("customer", "c_custkey", ["c_custkey", "c_name"])):
        names.append(f"sparkloom_{name}_{uuid.uuid4().hex}")
        io.write_bucketed(t(spark, sf_dir, name).select(*columns).repartition(8, key), names[-1], 8, key, path=_folder(spark, names[-1]))
    orders, customers = map(spark.table, names)
    d = R.join(orders, customers, F.col("o_custkey") == F.col("c_custkey"), "inner", "sort_merge")
    return d.groupBy("o_custkey").agg(F.first("c_name").alias("c_name"), F.count("*").alias("n"), F.max("o_orderkey").alias("hi"))


@query("SELECT r_name, n_name, count(*) OVER (PARTITION BY r_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey")
def s_cached_scan(spark, sf_dir):
    """A cached table (25 rows) read twice, beside a table of local rows."""
    nations = t(spark, sf_dir, "nation").select("n_name", "n_regionkey").cache()
    regions = t(spark, sf_dir, "region").select("r_regionkey", "r_name")
    counts = nations.groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("nations"))
    local = spark.createDataFrame([(i,) for i in range(5)], "k int")
    d = nations.join(counts.join(local, "k"), F.col("n_regionkey") == F.col("k")).join(regions, F.col("k") == F.col("r_regionkey"))
    return d.select("r_name", "n_name", "nations")


@query("SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS value, o_orderkey::VARCHAR AS key FROM orders")
def s_kafka_text(spark, sf_dir):
    """Records with a key, their value taken as text."""
    sent = io.to_kafka(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    raw = sent.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    text = io.from_kafka(raw.select("value"))
    return text.select(F.get_json_object("value", "$.o_orderkey").cast("long").alias("o_orderkey"), "value", F.get_json_object("value", "$.o_orderkey").alias("key"))


@query("SELECT event_type, user_id, event_id FROM events WHERE value >= 1")
def s_stream_file_sink(spark, sf_dir):
    """A stream written by the file sink, in partitions, and read back."""
    path = _folder(spark, "sink")
    d = io.stream(spark, f"{sf_dir}/events.parque[t]", t(spark, sf_dir, "events").schema).filter("value >= 1")
    io.file_sink(d.select("event_type", "user_id", "event_id"), path, f"{path}-state", by=("event_type",))
    return io.scan(spark, path, schema="user_id long, event_id long, event_type string").select("event_type", "user_id", "event_id")


# --- streams that stop, start again, and move past what they hold -----------------------------------


def _events(spark, sf_dir):
    return io.event_time(t(spark, sf_dir, "events"), "ts").select("event_id", "user_id", "event_type", "ts")


def _later(rows, days):
    """One row of no user, ``days`` after all of ``rows``: it moves the watermark past them."""
    return rows.agg(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("none").alias("event_type"), (F.max("ts") + F.expr(f"interval {days} days")).alias("ts"))


def _runs(spark, parts, build, mode="append"):
    """Adds each part to a folder and runs the stream that ``build`` makes of the folder, each time from the last checkpoint."""
    path = _folder(spark, "parts")
    for part in parts:
        io.write(part, path, mode="append")
        got = T.run_once(build(io.stream(spark, path, part.schema, files=10_000)), shared_dir(spark), mode, path.rpartition("/")[2])
    return got


@query("SELECT user_id, count(*) AS n, max(event_id) AS hi FROM events GROUP BY 1")
def t_restart(spark, sf_dir):
    """An aggregate that stops and goes on from its checkpoint with the rows that came since."""
    e = _events(spark, sf_dir)
    middle = F.col("event_id") % 2 == 0
    build = lambda d: d.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("hi"))
    return T.upserted(_runs(spark, [e.filter(middle), e.filter(~middle)], build, "update"), ["user_id"])


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM events GROUP BY 1, 2, 3")
def t_late_rows(spark, sf_dir):
    """Every event comes again after the watermark has passed it: late rows change no window, and each window comes out once."""
    e = _events(spark, sf_dir)
    build = lambda d: T.tumbling(d.withWatermark("ts", "10 minutes"), "ts", "1 hour", ["event_type"], F.count("*").alias("n"))
    got = _runs(spark, [e, _later(e, 2), e, _later(e, 4)], build)
    return _ntz(got.filter("event_type <> 'none'").drop("_batch"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(DISTINCT user_id) AS users, count(*) AS n FROM events GROUP BY 1, 2")
def t_split_distinct(spark, sf_dir):
    """A distinct count in two steps: one row a user first, then their count; no set of users is held in one row."""
    e = _events(spark, sf_dir)

    def build(d):
        users = d.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 hour").alias("w"), "event_type", "user_id").agg(F.count("*").alias("n"))
        return users.groupBy(F.window("w", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("users"), F.sum("n").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "users", "n")

    got = _runs(spark, [e, _later(e, 2), _later(e, 4)], build)
    return _ntz(got.filter("event_type <> 'none'").drop("_batch"))


@query("""
SELECT l.event_id AS l_id, r.event_id AS r_id FROM (SELECT * FROM events WHERE event_type = 'click') l
LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND r.ts >= l.ts AND r.ts <= l.ts + INTERVAL 1 HOUR
""")
def t_left_join(spark, sf_dir):
    """Two streams: rows without a partner come out once the watermark says that none can come."""
    e = _events(spark, sf_dir)

    def build(d):
        d = d.withWatermark("ts", "10 minutes")
        left = d.filter("event_type in ('click', 'none')").select(F.col("event_id").alias("l_id"), F.col("user_id").alias("l_user"), F.col("ts").alias("l_ts"))
        right = d.filter("event_type in ('purchase', 'none')").select(F.col("event_id").alias("r_id"), F.col("user_id").alias("r_user"), F.col("ts").alias("r_ts"))
        on = (F.col("l_user") == F.col("r_user")) & (F.col("r_ts") >= F.col("l_ts")) & (F.col("r_ts") <= F.col("l_ts") + F.expr("interval 1 hour"))
        return left.join(right, on, "left").select("l_id", "r_id")

    # Filters go below the watermark: the later rows must pass them, or the last clicks would wait for ever.
    return _runs(spark, [e, _later(e, 2), _later(e, 4)], build).filter("l_id <> -1").drop("_batch")


@query("SELECT user_id, 2::BIGINT AS n FROM events GROUP BY 1")
def t_state_expires(spark, sf_dir):
    """First rows of keys, held for 30 days: every user is new once, and once more a year later."""
    e = _events(spark, sf_dir)
    again = e.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.first("event_type").alias("event_type"), F.max("ts").alias("ts"))
    again = again.select("event_id", "user_id", "event_type", (F.col("ts") + F.expr("interval 365 days")).alias("ts"))
    build = lambda d: T.distinct_within(d.withWatermark("ts", "30 days"), ["user_id"]).select("user_id")
    got = _runs(spark, [e, _later(e, 200), again], build)
    return got.filter("user_id <> -1").groupBy("user_id").agg(F.count("*").alias("n"))
