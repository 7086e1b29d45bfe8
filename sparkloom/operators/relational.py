"""Relational operators that Spark has no single call for, and names for those it has."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, StructType

HINTS = {"broadcast_hash": "broadcast", "shuffled_hash": "shuffle_hash", "sort_merge": "merge", "nested_loop": "broadcast"}
#: Bytes of a side that may be broadcast; larger sides shuffle whatever the caller asks for.
BROADCAST_BYTES = 64 << 20


def size_of(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join(left: DataFrame, right: DataFrame, on: str | list[str] | Column, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join by a named strategy; ``nested_loop`` is for conditions without an equality.

    Both broadcast strategies send the side that the join type allows (the left one of right outer
    joins), and only within ``BROADCAST_BYTES``; a larger one leaves the choice to Spark's merge join
    (without an equality, to its planner).
    """
    if not strategy:
        return left.join(right, on, how)
    flip = how in ("right", "right_outer", "rightouter") and HINTS[strategy] == "broadcast"
    if HINTS[strategy] == "broadcast" and size_of(left if flip else right) > BROADCAST_BYTES:
        return left.join(right if strategy == "nested_loop" else right.hint("merge"), on, how)
    return left.hint(HINTS[strategy]).join(right, on, how) if flip else left.join(right.hint(HINTS[strategy]), on, how)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, ties: bool = False) -> DataFrame:
    """The first ``n`` rows of each key (with ``ties``, by rank). Catalyst limits each key before the
    shuffle, unless another window over the same keys comes first."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).withColumnRenamed("_rank", "rank")


def first_per_key(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """The first (or last) row of each key, by an aggregate: one partial row a key and task is shuffled."""
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*rest), F.col(order))
    return df.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")


def sum0(c: Column | str) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(c), F.lit(0))


def last_value(value: str, order: str) -> Column:
    """The last value that is not null, in the order given."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def quantiles(df: DataFrame, key: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """Exact interpolated quantiles (``percentile``; nulls are left out) of columns for each of a few keys:
    ``wanted`` is {name: (column, fraction)}.

    ``percentile`` keeps every value of a key in one map. Here an approximate pass proposes two values
    around each quantile, a second counts the rows below and up to them, and a third ranks the
    values only of the part that holds the quantile. The counts are exact and choose that part, so a poor
    proposal makes the part larger, not the result wrong. A row a key is broadcast.
    """
    df = df.select(F.col(key).alias("_k"), *[F.col(c).cast("double").alias(f"_v{i}") for i, (c, _) in enumerate(wanted.values())])
    fractions = [q for _, q in wanted.values()]
    each = range(len(fractions))

    def beside(small: DataFrame) -> DataFrame:
        return df.join(F.broadcast(small.withColumnRenamed("_k", "_of")), F.col("_k").eqNullSafe(F.col("_of"))).drop("_of")

    near = df.groupBy("_k").agg(*[F.percentile_approx(f"_v{i}", [max(q - 0.0005, 0.0), min(q + 0.0005, 1.0)]).alias(f"_p{i}") for i, q in enumerate(fractions)])
    near = near.select("_k", *[F.col(f"_p{i}")[j].alias(f"_{'ab'[j]}{i}") for i in each for j in (0, 1)])
    counts = beside(near).groupBy("_k").agg(*[x for i in each for x in (
        F.first(f"_a{i}").alias(f"_a{i}"), F.first(f"_b{i}").alias(f"_b{i}"), F.count(f"_v{i}").alias(f"_n{i}"), F.count_if(F.expr(f"_v{i} < _a{i}")).alias(f"_below{i}"), F.count_if(F.expr(f"_v{i} <= _b{i}")).alias(f"_upto{i}"))])
    for i, q in enumerate(fractions):
        counts = counts.withColumn(f"_at{i}", (F.col(f"_n{i}") - 1) * F.lit(q)).withColumn(f"_lo{i}", F.floor(f"_at{i}")).withColumn(f"_hi{i}", F.ceil(f"_at{i}"))
        counts = counts.withColumn(f"_skip{i}", F.expr(f"case when _lo{i} >= _upto{i} then _upto{i} when _lo{i} >= _below{i} then _below{i} else 0 end"))
    part = [F.expr(f"case when _lo{i} >= _upto{i} then _v{i} > _b{i} when _lo{i} >= _below{i} then _v{i} >= _a{i} else true end and case when _hi{i} < _below{i} then _v{i} < _a{i} when _hi{i} < _upto{i} then _v{i} <= _b{i} else true end") for i in each]
    part = [F.col(f"_v{i}").isNotNull() & part[i] for i in each]
    values = [F.when(part[i], F.struct(F.lit(i).alias("i"), *[F.col(f"_{c}{i}").alias(c) for c in ("v", "at", "lo", "hi", "skip")])) for i in each]
    values = beside(counts).filter(reduce(Column.__or__, part)).select("_k", F.inline(F.array_compact(F.array(*values))))
    values = values.groupBy("_k", "i", "at", "lo", "hi", "skip", "v").agg(F.count("*").alias("n"))
    last = F.col("skip") + F.sum("n").over(Window.partitionBy("_k", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    of = values.withColumn("_last", last).groupBy("_k", "i", "at", "lo", "hi").agg(*[F.min(F.when(F.col("_last") > F.col(c), F.col("v"))).alias(f"_{c}") for c in ("lo", "hi")])
    of = of.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise((F.col("hi") - F.col("at")) * F.col("_lo") + (F.col("at") - F.col("lo")) * F.col("_hi")))
    found = of.groupBy("_k").agg(*[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(name) for i, name in enumerate(wanted)])
    keys = near.select(F.col("_k").alias(key))
    return keys.join(found, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _by_whole_keys(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    """What runs in workers is nested here, so that they need not import this package."""
    if isinstance(df.schema[key].dataType, (FloatType, DoubleType)):
        raise ValueError("a key of floating point")
    want = to_arrow_schema(StructType.fromDDL(schema))

    def whole(batches):
        """Batches sorted by the key, as tables of whole keys: the last key of a batch waits for the rest of its rows."""
        kept = []
        for b in batches:
            if not b.num_rows:
                continue
            ends = pc.run_end_encode(b.column(key)).run_ends
            start = ends[-2].as_py() if len(ends) > 1 else 0
            if start:
                kept.append(b.slice(0, start))
            if kept and (start or kept[0].column(key)[0].as_py() != b.column(key)[0].as_py()):
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(start))
        if kept:
            yield pa.Table.from_batches(kept)

    def pandas(rows: pa.Table) -> pd.DataFrame:
        return rows.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get)

    def run(batches):
        for rows in whole(batches):
            yield from pa.Table.from_pandas(f(rows, pandas), want, preserve_index=False).to_batches()

    return df.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(run, schema)


def applied_in_pandas(df: DataFrame, key: str, f, schema: str) -> DataFrame:
    """A function of a key's rows, in pandas. A call gets many whole keys, as one call a key (Spark's
    ``applyInPandas``) costs about a millisecond each; a batch and one key are held at a time. Whole
    numbers arrive as nullable ones."""
    return _by_whole_keys(df, key, lambda rows, pandas: f(pandas(rows)), schema)


def co_grouped(left: DataFrame, right: DataFrame, key: str, f, schema: str) -> DataFrame:
    """A keyed function of two inputs; a key's rows of both meet in one call, which gets many whole keys
    as ``applied_in_pandas`` does."""
    a, b = (F.struct(*[F.col(f"`{c}`") for c in d.columns]) for d in (left, right))
    none_a, none_b = (F.lit(None).cast(d.schema) for d in (left, right))
    rows = left.select(F.col(key).alias("_key"), F.lit(False).alias("_right"), a.alias("_a"), none_b.alias("_b"))
    rows = rows.union(right.select(F.col(key), F.lit(True), none_a, b))

    def both(rows: pa.Table, pandas) -> pd.DataFrame:
        of_right = rows["_right"]
        sides = rows["_a"].filter(pc.invert(of_right)), rows["_b"].filter(of_right)
        return f(*(pandas(pa.Table.from_batches(map(pa.RecordBatch.from_struct_array, s.chunks), pa.schema(list(s.type)))) for s in sides))

    return _by_whole_keys(rows, "_key", both, schema)
