"""Rewrites that Catalyst does not make, as helpers; each has the answer of its plain form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_self_join_distinct(df: DataFrame, key: str, other: str) -> DataFrame:
    """Keys with two different values of ``other``: what an IN over a self-join with ``<>`` selects, in one scan."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(other).alias("_a"), F.max(other).alias("_b")).filter("_a <> _b").select(key)


def merge_scalar_aggregates(df: DataFrame, parts: Sequence[tuple[Column | None, str, str, str]]) -> DataFrame:
    """Several global aggregates under different filters as one row, in one scan.

    ``parts``: (predicate or None, function, column or ``*``, alias). Rows that no predicate takes
    are filtered first, so the filter reaches the scan.
    """
    take = None
    aggregates = []
    for p, f, c, alias in parts:
        value = F.lit(1) if c == "*" else F.col(c)
        aggregates.append(getattr(F, f)(value if p is None else F.when(p, value)).alias(alias))
        take = "all" if p is None or isinstance(take, str) else p if take is None else take | p
    return (df if isinstance(take, str) or take is None else df.filter(take)).agg(*aggregates)


def combine_joined_aggregates(df: DataFrame, sides: Sequence[tuple[Column, Sequence[tuple[str, str, str]]]]) -> DataFrame:
    """A cross join of global aggregates over one source, in one scan: each side keeps its own filter."""
    return merge_scalar_aggregates(df, [(p, f, c, a) for p, parts in sides for f, c, a in parts])


MERGED = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def rollup_two_phase(df: DataFrame, keys: Sequence[str], parts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A rollup that reads the rows once: the finest groups are aggregated, then rolled up.

    ``parts``: (sum, count, min or max; column; alias). Only aggregates that merge are allowed.
    """
    bad = {f for f, *_ in parts} - MERGED.keys()
    if bad:
        raise ValueError(f"these do not merge: {sorted(bad)}")
    fine = df.groupBy(*keys).agg(*[getattr(F, f)("*" if c == "*" else F.col(c)).alias(a) for f, c, a in parts])
    return fine.rollup(*keys).agg(F.grouping_id().alias("gid"), *[MERGED[f](a).alias(a) for f, _, a in parts])


def semi_join_dedup(left: DataFrame, right: DataFrame, keys: Sequence[str], anti: bool = False) -> DataFrame:
    """A semi or anti join whose right side is reduced to its distinct keys before it is shuffled."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti" if anti else "left_semi")


def connected_join(tables: dict[str, DataFrame], predicates: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """Inner joins in an order that follows the predicates; tables no predicate connects are crossed last."""
    left, todo, out = dict(tables), list(predicates), None
    while left:
        name = next(iter(left))
        part, within = left.pop(name), {name}
        grown = True
        while grown:
            grown = False
            for t in list(left):
                on = [p for p in todo if t in p[:2] and ({*p[:2]} - {t}) <= within]
                if on:
                    todo = [p for p in todo if not any(p is x for x in on)]
                    c = on[0][2]
                    for p in on[1:]:
                        c = c & p[2]
                    part, grown = part.join(left.pop(t), c), True
                    within.add(t)
        out = part if out is None else out.crossJoin(part)
    return out


def topk_through_aggregate(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column], order: Sequence[str], k: int) -> DataFrame:
    """The first ``k`` groups by their keys: groups beyond the first k key values are dropped before aggregating.

    Only if every sort key is a group key and the sort keys tell groups apart; else the plain plan.
    """
    if set(order) == set(keys) and k <= 10_000:
        first = df.select(*order).distinct().orderBy(*order).limit(k).select(*[F.col(c).alias(f"_{c}") for c in order])
        same = F.lit(True)
        for c in keys:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        df = df.join(F.broadcast(first), same, "left_semi")  # at most k rows
    return df.groupBy(*keys).agg(*aggregates).orderBy(*order).limit(k)
