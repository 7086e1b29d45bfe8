"""What several of these operators share: shared storage, row keys and connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than these (ASCII white space).
SPACE = r"[\x20\x09-\x0D]+"
#: Ids that are broadcast at most.
FEW = 1_000_000
#: Bytes of an Arrow batch of whole texts at most.
BATCH = 12 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A temporary one is set only where the session names none and is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Bounds the session's Arrow batches by ``most`` bytes: the default counts rows, and texts are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
    if not told or not 0 < int(told[1]) <= most:
        spark.conf.set(key, str(most))


def tidy() -> None:
    """In a worker, once its work is done: gives free memory back to the system, as idle workers stay."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of frames that are no longer referenced: its cleaner waits for a collection.

    Spark keeps the last query, so one row is counted first.
    """
    gc.collect()
    spark.range(1).count()
    spark._jvm.System.gc()


def own_names(*frames: DataFrame):
    """A function from a short name to one that no column of ``frames`` has (case aside)."""
    taken = {c.lower() for f in frames for c in f.columns}
    start = "_own"
    while any(c.startswith(start) for c in taken):
        start += "_"
    return lambda name: f"{start}{name}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder; Spark's context cleaner removes the files after the last
    reference where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text, in order; of null, none. JVM only."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fold(id_: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % modulus


def without(docs: DataFrame, id: str, gone: DataFrame) -> DataFrame:
    """``docs``, its columns, without the rows whose id is among ``gone`` (one column of numbers); null ids stay.

    Ids are broadcast only while there are ``FEW`` of them at most (16 bytes each); beyond, the join shuffles.
    """
    name = own_names(docs)("gone")
    gone = cut(gone.select(F.col(gone.columns[0]).cast("long").alias(name)).filter(F.col(name).isNotNull()).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, F.col(id).cast("long") == F.col(name), "left_anti")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``(node, component)``, component = smallest node.

    ``edges`` has two comparable columns ``a`` and ``b``. Alternating large-star and small-star
    steps. Each is a partial-aggregated minimum and an equi-join back, never a collected
    neighbourhood: a hub's edges can be split over tasks. Rounds are cut by checkpoints.
    Nodes without an edge do not appear; self loops and null ends are ignored.
    """
    edges = cut(
        edges.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )

    def state(e: DataFrame) -> tuple:
        return tuple(e.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(edges)
    for _ in range(max_rounds):
        # Large star: each node sends its larger neighbours to the smallest of its neighbourhood.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: each node sends its smaller neighbours, and itself, to the smallest of them.
        large = large.filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(
            large.join(small, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a <> b")
            .distinct()
        )
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
