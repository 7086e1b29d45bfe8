"""Sources and sinks, batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Formats with column pruning and filter pushdown, and those without.
COLUMNAR, ROWS = ("parquet", "orc"), ("csv", "json", "text")


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A file scan; filters, columns and partitions are pruned by Catalyst. CSV and JSON need a schema (no inference pass)."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    r = spark.read.format(fmt).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", by: tuple[str, ...] = (), **options: str) -> None:
    """Writes files, partitioned by ``by``: overwrite, append, ignore or errorifexists. An empty or null partition value is one partition."""
    w = df.write.format(fmt).mode(mode).options(**options)
    (w.partitionBy(*by) if by else w).save(path)


def write_bucketed(df: DataFrame, table: str, buckets: int, *keys: str, path: str | None = None) -> None:
    """A table bucketed and sorted by ``keys``, in the warehouse or at ``path``: later joins and aggregates on them need no shuffle."""
    w = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(table)


def file_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Writes what a stream has now to files; the sink's log commits each batch once, also when it is tried again."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.partitionBy(*by) if by else w).start(path).awaitTermination()


def event_time(df: DataFrame, column: str, delay: str | None = None) -> DataFrame:
    """``column`` as a TIMESTAMP (watermarks reject TIMESTAMP_NTZ), with a watermark if ``delay`` is given."""
    df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.withWatermark(column, delay) if delay else df


def stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", files: int = 1, **options: str) -> DataFrame:
    """Files as a stream, ``files`` a micro-batch."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).options(**options).load(path)


def kafka_options(servers: str, topic: str, **more: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest"} | more


def from_kafka(raw: DataFrame, schema: str | None = None) -> DataFrame:
    """Kafka records as columns of their JSON value, one level of nested rows flattened; without a schema, the value as text."""
    if schema is None:
        return raw.select(F.col("value").cast("string").alias("value"))
    rows = raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")
    flat = []
    for f in rows.schema.fields:
        flat += [F.col(f"{f.name}.{x.name}").alias(f"{f.name}_{x.name}") for x in f.dataType.fields] if isinstance(f.dataType, StructType) else [F.col(f.name)]
    return rows.select(*flat)


def to_kafka(df: DataFrame, key: str | None = None) -> DataFrame:
    """A frame with the ``value`` (JSON of all columns) and ``key`` that the Kafka sink takes."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(value, *([F.col(key).cast("string").alias("key")] if key else []))


def enforced(df: DataFrame, not_null: tuple[str, ...] = (), longest: dict[str, int] | None = None, drop: bool = True) -> DataFrame:
    """Rows that meet NOT NULL and length constraints; others are dropped, or raise."""
    ok: Column = F.lit(True)
    for c in not_null:
        ok &= F.col(c).isNotNull()
    for c, n in (longest or {}).items():
        ok &= F.coalesce(F.length(c) <= n, F.lit(True))
    return df.filter(ok) if drop else df.filter(F.assert_true(ok, "a row breaks a constraint").isNull())


def bids(spark: SparkSession, rows: int, auctions: int = 100, bidders: int = 50) -> DataFrame:
    """A repeatable auction stream: auction, bidder, price, ts (a bid every 100 ms)."""
    h = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    return spark.range(rows).select(h(1, auctions).alias("auction"), h(2, bidders).alias("bidder"), (h(3, 10_000) + 1).alias("price"), F.timestamp_millis(F.lit(1_704_067_200_000) + F.col("id") * 100).alias("ts"))
