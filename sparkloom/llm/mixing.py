"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: By a source's rank (repeating): its weight, and how much it grows over the training run:
#: at time t in [0, 1] a source weighs ``weight * (1 + slope * (2 t - 1))``, slope within [-1, 1].
WEIGHTS = (3.0, 1.0, 2.0)
SLOPES = (-0.5, 0.5, 0.0)
BUDGET, MOST = 1.5, 2
#: Documents of a source that one window frame holds, about.
BUCKET = 512
#: Rows of offsets and of targets (under 100 bytes each, but for a source's name) that are broadcast at most.
FEW = 200_000


def size_of(text: Column) -> Column:
    """Words in a text; null: 0."""
    return F.size(common.words(text)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """``sizes``: source, source_size. Returns source, source_size, target, slope, total.

    Sources in code-point order, null last, take the weights in turn and share ``budget`` times
    all sizes; a target stops at ``most`` times its source, and the excess is shared again by
    weight. With sources sorted by cap per unit of weight, those capped are a prefix, so one
    running sum gives the level. Runs over one row a source.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (rank % n + 1).cast("int"))
    w = sizes.select("source", "source_size", pick(weights).alias("w"), pick(slopes).alias("slope"))
    w = w.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    w = w.withColumn("level", (F.sum("source_size").over(everything) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The first source whose cap is not below its level, and all after it, stay under their caps.
    w = w.withColumn("water", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct(F.col("ratio"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("water").isNull() | (F.col("ratio") < F.col("water")), F.col("cap")).otherwise(F.col("water") * F.col("w"))
    w = w.withColumn("target", target)
    return w.select("source", "source_size", "target", "slope", F.sum("target").over(everything).alias("total"))


def time_of(share: Column, slope: Column) -> Column:
    """When a source's cumulative demand ``t + slope (t^2 - t)`` reaches ``share`` of its target."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(share <= 0, F.lit(0.0)).otherwise(2 * share / ((1 - slope) + root))


def _key(id: Column, text: Column, source: Column) -> Column:
    """A digest of a row's id, text and source; null differs from empty."""
    part = lambda c: F.coalesce(F.md5(c.cast("string").cast("binary")), F.lit("-"))
    return F.md5(F.concat_ws("|", part(id), part(text), part(source)).cast("binary"))


def plan(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", bucket: int = BUCKET, **how) -> DataFrame:
    """One row per document: id, ``_key``, ``_row``, ``size``, ``source``, ``source_size``, ``target``, ``slope``, ``total``, ``start``.

    ``start`` is the number of words of the source's documents before this one in the order of
    md5(id) (of null ids md5(text)), id, size and md5(text). It comes from sums over prefixes of the digest and a window
    within one prefix of one source, so no task orders a whole source. Null texts and texts
    without a word have size 0; the null source is a source.
    """
    slim = docs.select(
        F.col(id).alias("_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"),
        F.coalesce(F.md5(F.col(id).cast("string").cast("binary")), F.md5(F.col(text).cast("binary")), F.lit("")).alias("h"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("")).alias("k"),
        _key(F.col(id), F.col(text), F.col(source)).alias("_key"),
    )
    slim = common.written(slim, "mixing")
    k = max(1, math.ceil(math.log(max(16, slim.count() / bucket), 16)))
    slim = slim.withColumn("b", F.substring("h", 1, k))
    sums = common.cut(slim.groupBy("source", "b").agg(F.sum("size").alias("b_size")))
    aims = targets(sums.groupBy("source").agg(F.sum("b_size").alias("source_size")), **how)
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("b_start", F.coalesce(F.sum("b_size").over(run), F.lit(0))).drop("b_size")
    inside = Window.partitionBy("source", "b").orderBy("h", F.col("_id").asc_nulls_first(), "size", "k").rowsBetween(Window.unboundedPreceding, -1)
    out = slim.withColumn("_row", F.row_number().over(inside.orderBy("h", F.col("_id").asc_nulls_first(), "size", "k").rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    at = offsets.withColumnRenamed("source", "s1").withColumnRenamed("b", "b1")
    out = out.join(F.broadcast(at) if sums.count() <= FEW else at, F.col("source").eqNullSafe(F.col("s1")) & (F.col("b") == F.col("b1")))
    aims = aims.withColumnRenamed("source", "s2")
    out = out.join(F.broadcast(aims) if sums.select("source").distinct().count() <= FEW else aims, F.col("source").eqNullSafe(F.col("s2")))
    return out.select(F.col("_id").alias(id), "_key", "_row", "size", "source", "source_size", "target", "slope", "total", (F.col("b_start") + F.col("inside")).alias("start"))


def words_taken(copy: Column) -> Column:
    """Words that the mix takes of a document's copy 0, 1, ...: its stretch of the source's words, cut at the target."""
    left = F.floor(F.col("target")) - F.col("start") - copy * F.col("source_size")
    return F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")


def position(copy: Column) -> Column:
    """The training position (in words of the whole mix) where a copy starts."""
    share = F.when(F.col("target") > 0, (F.col("start") + copy * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    return time_of(share, F.col("slope")) * F.col("total")


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", most: int = MOST, **how) -> DataFrame:
    """The mix itself: documents of ``docs``, their columns and no other, each as often as it is taken, in training order.

    A source's last copy is kept whole if at least half its words are taken, else left out. Rows
    of size 0 stay once where their place is before the target (always, if the target is 0).
    """
    rows = plan(docs, id, text, source, most=most, **how)
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumn("taken", words_taken(F.col("copy")))
    empty = (F.col("size") == 0) & (F.col("copy") == 0) & ((F.col("start") < F.col("target")) | (F.col("target") == 0))
    copies = copies.filter(((F.col("taken") > 0) & (2 * F.col("taken") >= F.col("size"))) | empty)
    # One list of positions for each row with any copy; rows with one key (repeated rows) take a list each.
    own = common.own_names(docs)
    lists = copies.groupBy("_key", "start", "_row").agg(F.collect_list(position(F.col("copy"))).alias("p"))
    lists = lists.groupBy(F.col("_key").alias(own("key"))).agg(F.collect_list("p").alias(own("p")))
    mine = docs.withColumn(own("key"), _key(F.col(id), F.col(text), F.col(source))).join(lists, own("key"))
    mine = mine.withColumn(own("n"), F.row_number().over(Window.partitionBy(own("key")).orderBy(own("key"))))
    mine = mine.withColumn(own("at"), F.explode(F.get(own("p"), F.col(own("n")) - 1)))
    return mine.orderBy(own("at"), own("key")).select(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = words_taken(F.lit(0)) + words_taken(F.lit(1))
    place = F.when(words_taken(F.lit(0)) > 0, F.floor(position(F.lit(0))).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"), place.alias("position")).orderBy("position", "doc_id")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), md5(text), '') AS h, coalesce(md5(text), '') AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS r FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][r + 1]::DOUBLE AS w, [-0.5, 0.5, 0.0][r + 1]::DOUBLE AS slope, (2 * source_size)::DOUBLE AS cap FROM s
), l AS (
  SELECT *, cap / w AS ratio, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), v AS (SELECT (min({'r': ratio, 'l': level}) FILTER (WHERE ratio >= level)).l AS water FROM l),
t AS (
  SELECT source, source_size, slope, CASE WHEN water IS NULL OR ratio < water THEN cap ELSE water * w END AS target FROM l, v
), a AS (
  SELECT d.*, source_size, slope, target, (SELECT sum(target) FROM t) AS total,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), b AS (
  SELECT *, floor(target)::BIGINT AS aim, CASE WHEN target > 0 THEN start / target ELSE 0 END AS share FROM a
), c AS (
  SELECT *, greatest(0, least(size, aim - start)) AS t0, greatest(0, least(size, aim - start - source_size)) AS t1 FROM b
)
SELECT doc_id, size, source_size, target, (t0 + t1)::BIGINT AS taken,
  CASE WHEN t0 > 0 THEN floor(CASE WHEN share <= 0 THEN 0.0 ELSE 2 * share / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share)) END * total)::BIGINT END AS position
FROM c
"""
