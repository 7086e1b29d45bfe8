"""Streaming operators. A stream's answer in ``append`` or ``update`` mode is its final rows; there are no retraction records."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import join


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column, offset: str = "0 seconds") -> DataFrame:
    return _windowed(df, F.window(ts, size, size, offset), keys, aggregates)


def hopping(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _windowed(df, F.window(ts, size, slide), keys, aggregates)


def session(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _windowed(df, F.session_window(ts, gap), keys, aggregates)


def _windowed(df: DataFrame, window: Column, keys: list[str], aggregates: tuple[Column, ...]) -> DataFrame:
    out = df.groupBy(window.alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def cumulating(df: DataFrame, ts: str, seconds: int, step: int, keys: list[str], *aggregates: Column) -> DataFrame:
    """Windows that start every ``seconds`` and grow by ``step``: a row is in each that ends after it."""
    at = F.unix_timestamp(ts)
    start = at - F.pmod(at, F.lit(seconds))
    first = start + (F.floor((at - start) / step) + 1) * step
    rows = df.withColumn("_s", start).withColumn("_e", F.explode(F.sequence(first, start + seconds, F.lit(step))))
    out = rows.groupBy("_s", "_e", *keys).agg(*aggregates)
    return out.select(F.timestamp_seconds("_s").alias("window_start"), F.timestamp_seconds("_e").alias("window_end"), *[c for c in out.columns if c not in ("_s", "_e")])


def window_join(left: DataFrame, right: DataFrame, ts: tuple[str, str], size: str, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys in one tumbling window."""
    return left.withColumn("_w", F.window(ts[0], size)).join(right.withColumn("_w", F.window(ts[1], size)), [*keys, "_w"]).drop("_w")


def interval_join(left: DataFrame, right: DataFrame, on: Column, ts: tuple[str, str], before: str, after: str) -> DataFrame:
    """Rows that meet ``on`` with the right time from ``before`` earlier to ``after`` later than the left; both need watermarks."""
    return left.join(right, on & (F.col(ts[1]) >= F.col(ts[0]) - F.expr(f"interval {before}")) & (F.col(ts[1]) <= F.col(ts[0]) + F.expr(f"interval {after}")))


def lookup_join(stream: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Each row with its row of a table; the table is broadcast only within the size that ``relational.join`` allows."""
    return join(stream, dimension, key, strategy="broadcast_hash")


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key by ``order``, by a streaming aggregate; ``complete`` or ``update`` output."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def distinct_within(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first row to arrive of each key while the watermark holds its state."""
    return df.dropDuplicatesWithinWatermark(keys)


def ranked(df: DataFrame, key: str, order: str, n: int, columns: list[str], schema: str, last: bool = True) -> DataFrame:
    """The ``n`` rows of greatest (or least) ``order`` of each key so far, as update rows with ``rank``. State: n rows a key.

    ``schema``: of ``key``, ``columns`` and ``rank``. With n = 1 it is keep-first or keep-last by event time.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(json.loads(state.get[0]) if state.exists else [], columns=columns)
        for b in batches:
            b = b[columns]
            rows = (pd.concat([rows, b]) if len(rows) else b).sort_values([order, *[c for c in columns if c != order]], ascending=not last).head(n)
        state.update((rows.to_json(orient="values", date_format="iso"),))
        out = rows.assign(rank=range(1, len(rows) + 1))
        out.insert(0, key, k[0])
        yield out

    return df.groupBy(key).applyInPandasWithState(step, schema, "rows string", "update", "NoTimeout")


def reduced(df: DataFrame, key: str, value: str, f, schema: str) -> DataFrame:
    """A keyed reduce with user code: ``f(kept, value)`` over all values of a key so far; update rows."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = state.get[0] if state.exists else None
        for b in batches:
            for v in b[value]:
                kept = v if kept is None else f(kept, v)
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]], value: [kept]})

    kind = dict(df.dtypes)[value]
    return df.groupBy(key).applyInPandasWithState(step, schema, f"kept {kind}", "update", "NoTimeout")


def upserted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Update rows of a run (with their batch in ``_batch``) collapsed to the last of each key."""
    rest = [c for c in df.columns if c not in (*keys, "_batch")]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")


def run_once(df: DataFrame, folder: str, mode: str = "append", name: str | None = None) -> DataFrame:
    """Runs a stream over what there is now and returns the rows it wrote, with their batch in ``_batch``.

    Every batch overwrites its own folder, so a batch that is tried again leaves no double row. A run
    with the ``name`` of an earlier one starts from that one's checkpoint and returns the rows of both.
    """
    path = f"{folder.rstrip('/')}/stream-{name or uuid.uuid4().hex}"
    spark = df.sparkSession
    schema = df.schema

    def save(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/_batch={n}")

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/out/_batch=-1")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(schema.add("_batch", "long")).option("basePath", f"{path}/out").parquet(f"{path}/out")
