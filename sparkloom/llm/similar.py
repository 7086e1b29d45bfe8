"""Near copies by the exact Jaccard similarity of word shingles: near fingerprints first, then a set join on prefixes, every link confirmed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

#: Neighbours under one shingle that are compared at once; longer lists are first joined up, then compared across components.
NEAR = 16
#: One document in ``SAMPLE`` is read for the shingles that go last in the order; ``OFTEN``: such shingles at most. Any order gives the same links.
SAMPLE, OFTEN = 16, 1 << 16
#: Classes under one shingle that one task has of either side, about.
SIDE = 512
#: Parts of a set's sketch.
PARTS = 256
PAIR = "a long, b long"


def shingles(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """Distinct hashes of a text's word shingles, ascending; of no words, none."""
    return np.unique(simhash.hashed(text, size, seed)).astype(np.uint64)


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _class(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """How many of a set's members are in each of ``PARTS`` parts of all hashes, in as few bits as hold the greatest; the lesser counts of two sets bound what they share."""
    n = np.bincount((s & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS)
    if n.max() < 16:
        return (n[::2] | n[1::2] << 4).astype(np.uint8).tobytes()
    return n.astype(np.uint8 if n.max() < 1 << 8 else np.uint16 if n.max() < 1 << 16 else np.uint32).tobytes()


def counts(w: bytes) -> np.ndarray:
    """The counts of a sketch."""
    if len(w) == PARTS // 2:
        x = np.frombuffer(w, np.uint8)
        return np.stack([x & 15, x >> 4], axis=1).ravel().astype(np.int64)
    return np.frombuffer(w, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(w) // PARTS]).astype(np.int64)


def _possible(n: np.ndarray, p: np.ndarray, m: np.ndarray, q: np.ndarray, least: float) -> np.ndarray:
    """Whether sets of n and m members whose first common one is at p and q can be so similar."""
    return np.minimum(n - p, m - q) * (1 + least) >= least * (n + m) - 1e-6


def _last(docs: DataFrame, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, ascending, and the place of each among them: the most frequent is last."""

    def every(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": np.concatenate([shingles(t, size, seed) for t in pdf["_text"]]).view(np.int64)})
        common.tidy()

    some = docs.filter(common.fold(F.col("_id"), SAMPLE) == 0).select("_text").mapInPandas(every, "k long")
    rows = some.groupBy("k").agg(F.count("*").alias("n")).filter("n >= 8").orderBy(F.desc("n"), "k").limit(OFTEN).select("k").toPandas()
    keys = rows["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], len(keys) - 1 - order


def ordered(s: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A set, ascending, in the order that all sets share: what is not in ``last`` by itself, then the rest by its place.

    ``last`` is searched for the set's members: it may be far longer than a set, and must not be walked for each.
    """
    if not len(last):
        return s
    at = np.minimum(np.searchsorted(last, s), len(last) - 1)
    often = last[at] == s
    return np.concatenate([s[~often], s[often][np.argsort(place[at[often]])]])


def _near(least: float):
    """Pairs of neighbours of different components under one shingle, from rows in order of shingle; longer lists give (shingle, null) too."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for pdf in batches:
            new = [pdf[x].to_numpy(np.int64) for x in ("k", "n", "c", "p", "g")]
            old = 0 if tail is None else len(tail[0])
            k, n, c, p, g = new if tail is None else [np.concatenate(x) for x in zip(tail, new)]
            tail = [x[-NEAR:] for x in (k, n, c, p, g)]
            for d in range(1, NEAR + 1):
                j = np.arange(max(old, d), len(k))
                j = j[k[j] == k[j - d]]
                if not len(j):
                    break
                if d == NEAR:
                    yield pd.DataFrame({"a": np.unique(k[j]), "b": pd.array([None] * len(np.unique(k[j])), dtype="Int64")})
                i = j - d
                ok = _possible(n[i], p[i], n[j], p[j], least) & (g[i] != g[j])
                if ok.any():
                    u, v = c[i[ok]], c[j[ok]]
                    yield pd.DataFrame({"a": np.minimum(u, v), "b": pd.array(np.maximum(u, v), dtype="Int64")})
        common.tidy()

    return pairs


def _dealt(lists: DataFrame) -> DataFrame:
    """Rows of ``k``, ``c`` once for each pair of sides (``lo``, ``hi``) that theirs, ``own``, is part of; a side has about ``SIDE`` rows."""
    sides = lists.groupBy("k").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("sides"))
    rows = lists.join(sides, "k").withColumn("own", F.pmod(F.xxhash64("c"), F.col("sides")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return rows.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with")).drop("with", "sides")


def _across(least: float):
    """The pairs of different components under one shingle, of two sides, that sizes, places and sketches leave possible."""

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        n, c, p, g, own = (pdf[x].to_numpy(np.int64) for x in ("n", "c", "p", "g", "own"))
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        out = [np.empty((2, 0), np.int64)]
        if (g != g[0]).any():
            w = np.stack([counts(x) for x in pdf["w"]]).astype(np.int32)
            for i in np.flatnonzero(own == lo):
                j = np.flatnonzero((g != g[i]) & (own == hi) & _possible(n[i], p[i], n, p, least))
                j = j[j > i] if lo == hi else j
                if len(j):
                    j = j[np.minimum(w[i], w[j]).sum(axis=1) * (1 + least) >= least * (n[i] + n[j]) - 1e-6]
                    out.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["a", "b"])

    return pairs


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, least: float = 0.8, seed: int = 42, budget: int = 2) -> DataFrame:
    """One row per document: ``id``, ``component_id`` long, the smallest id of its component.

    Two documents are linked if the Jaccard similarity of their sets of ``size``-word shingles is
    ``least`` or more; none is left out. In any one order of all shingles such sets share one of
    their first n - ceil(least * n) + 1, so documents meet under those; frequent shingles come
    last in the order, to keep lists short. Equal sets are one class. Pairs are confirmed from the
    texts. Classes whose SimHash fingerprints differ by at most ``budget`` bits (``simhash.links``)
    are compared first; under each shingle, then, only classes that this has not joined. Under a
    shingle that many classes have, neighbours are linked before pairs of different components. Rows with a null id get a null component.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    last, place = _last(docs, size, seed)

    @F.pandas_udf("c long, n int, ks array<long>, w binary, fp long")
    def prefixes(texts: pd.Series) -> pd.DataFrame:
        all_ = [simhash.hashed(t, size, seed) for t in texts]
        marks = np.array([simhash.majority(h) for h in all_], np.uint64).view(np.int64)
        sets = [np.unique(h).astype(np.uint64) for h in all_]
        firsts = []
        for s in sets:
            firsts.append(ordered(s, last, place)[: len(s) - int(np.ceil(least * len(s) - 1e-6)) + 1].view(np.int64))
        out = pd.DataFrame({"c": [_class(s) for s in sets], "n": [len(s) for s in sets], "ks": firsts, "w": [sketch(s) for s in sets], "fp": marks})
        del all_, sets, firsts
        common.tidy()
        return out

    found = common.written(docs.select("_id", prefixes("_text").alias("s")).select("_id", "s.*"), "shingles")
    named = found.filter("_id is not null")
    # Equal sets may come with other repeats, and so with other fingerprints: the least serves.
    classes = named.groupBy("c").agg(F.min("_id").alias("id"), F.first("n").alias("n"), F.first("ks").alias("ks"), F.min("fp").alias("fp"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                shared = [int(np.minimum(counts(x), counts(y)).sum()) for x, y in zip(pdf["x"], pdf["y"])]
                yield pdf.loc[np.array(shared) * (1 + least) >= least * pdf["n"].to_numpy() - 1e-6, ["a", "b"]]
            common.tidy()

        # A bound first: whole sets travel only for pairs that it leaves.
        w = named.join(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), "c").select("c", "n", "w").dropDuplicates(["c"])
        both = pairs.join(w.select(F.col("c").alias("a"), F.col("n").alias("m"), F.col("w").alias("x")), "a").join(w.select(F.col("c").alias("b"), "n", F.col("w").alias("y")), "b")
        pairs = common.cut(both.select("a", "b", (F.col("m") + F.col("n")).alias("n"), "x", "y").mapInPandas(likely, PAIR))
        ends = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        ids = common.cut(named.join(ends, "c").groupBy("c").agg(F.min("_id").alias("_id")).select("_id").distinct())
        ids = F.broadcast(ids) if ids.count() <= common.FEW else ids  # few texts take part, as a rule

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                s = [shingles(t, size, seed) for t in pdf["_text"]]
                yield pd.DataFrame({"c": [_class(x) for x in s], "s": [x.tobytes() for x in s]})
            common.tidy()

        def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ok = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(pdf["x"], pdf["y"])]
                yield pdf.loc[np.array(ok, dtype=bool), ["a", "b"]]
            common.tidy()

        s = common.cut(docs.join(ids, "_id").mapInPandas(sets, "c long, s binary").dropDuplicates(["c"]))
        common.released(docs.sparkSession)  # before whole sets are dealt out
        both = pairs.join(s.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(s.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
        return common.cut(both.select("a", "b", "x", "y").mapInPandas(similar, PAIR))

    marked = classes.select("c", F.col("fp").alias("_fp"))
    firsts = common.cut(marked.groupBy("_fp").agg(F.min("c").alias("id")))
    alike = marked.join(firsts, "_fp").filter("c <> id").select(F.col("id").alias("a"), F.col("c").alias("b"))
    edges = confirmed(simhash.links(firsts, budget).unionByName(alike).distinct())
    groups = common.components(edges)
    common.released(docs.sparkSession)

    def listed(groups: DataFrame) -> DataFrame:
        return classes.join(groups, F.col("c") == F.col("node"), "left").select("c", "n", F.coalesce("component", "c").alias("g"), F.posexplode("ks").alias("p", "k"))

    close = common.cut(listed(groups).repartition("k").sortWithinPartitions("k", "n", "c").mapInPandas(_near(least), PAIR).distinct())
    common.released(docs.sparkSession)
    edges = edges.union(confirmed(close.filter("b is not null")))
    common.released(docs.sparkSession)
    groups = common.components(edges)
    long = close.filter("b is null").select(F.col("a").alias("k"))
    many = long.count()
    if many:
        # Kept, as several steps read them; else each would deal out every class's whole prefix again. Few lists are long, as a rule.
        lists = common.cut(listed(groups).join(F.broadcast(long) if many <= common.FEW else long, "k"))
        common.released(docs.sparkSession)
        # Rows carry their sketches, so pairs that these exclude are never made rows.
        sketches = named.join(lists.select("c").distinct(), "c").dropDuplicates(["c"]).select("c", "w")
        more = common.cut(_dealt(lists).join(sketches, "c").groupBy("k", "lo", "hi").applyInPandas(_across(least), PAIR).distinct())
        groups = common.components(edges.union(confirmed(more)))
        common.released(docs.sparkSession)
    grouped = classes.select("c", "id").join(groups, F.col("c") == F.col("node"), "left").select("c", "id", F.coalesce("component", "c").alias("g"))
    firsts = grouped.groupBy("g").agg(F.min("id").alias("component_id"))
    firsts = grouped.join(firsts, "g").select("c", "component_id")
    return found.join(firsts, "c", "left").select(F.col("_id").alias(id), F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id"))
