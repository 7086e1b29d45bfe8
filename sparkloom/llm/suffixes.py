"""Suffix-array dedup: sparse suffixes at minimisers, neighbours with equal starts, matches extended both ways."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that a repeat has at least. A suffix starts with ``length // 2 + 1`` words, and of any
#: ``length - start + 1`` suffixes in a row one at least is kept: a repeat holds a kept suffix's start.
LENGTH = 50
ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Hasher:
    """64-bit hashes of words, remembered up to a bound, and of runs of words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        w = (text or "").encode("utf-8", "surrogatepass").split()
        if len(self.known) > 200_000:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        for x in set(w):
            if x not in known:
                known[x] = digest(x)
        return np.fromiter(map(known.__getitem__, w), dtype=np.uint64, count=len(w))

    @staticmethod
    def runs(h: np.ndarray, k: int) -> np.ndarray:
        """A hash of words i .. i + k - 1, for every i."""
        n = len(h) - k + 1
        out, power = np.zeros(n, np.uint64), np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(k):
                out += h[j : j + n] * power
                power = power * ODD
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
        return out


def _sliding(a: np.ndarray, w: int, least) -> np.ndarray:
    """``least`` over every w neighbours, by doubling."""
    size = 1
    while size * 2 <= w:
        a = least(a[:-size], a[size:])
        size *= 2
    return least(a[: len(a) - (w - size)], a[w - size :]) if w > size else a


def kept_suffixes(keys: np.ndarray, w: int) -> np.ndarray:
    """Positions that are least among some w neighbours (all of equal ones): content alone decides."""
    low = _sliding(keys, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), w, np.maximum) == keys)


def _starts(length: int) -> tuple[int, int]:
    k = length // 2 + 1
    return k, length - k + 1


def spans(at: np.ndarray, length: int) -> list[list[int]]:
    """Word ranges [from, to) that windows starting at ``at`` cover."""
    out: list[list[int]] = []
    for s in np.unique(at).tolist():
        if out and s <= out[-1][1]:
            out[-1][1] = s + length
        else:
            out.append([s, s + length])
    return out


def _text_key(text: Column) -> Column:
    return F.xxhash64(text, F.length(text))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of distinct rows (h, r, t) in order, those whose neighbour has the same h; ``later``: an earlier one has it.

    The first row of a partition may have an equal one before, a last run of one row one after: these
    two come with a null ``later``, and rows without t tell both runs' h, least r and number.
    """

    def out(h, r, t, later, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(r, pa.int64()), pa.array(t, pa.int64()), pa.array(later, pa.bool_()), pa.array(n, pa.int64())], ["h", "r", "t", "later", "n"])

    held, head, tail = None, None, None  # the last row; the first run and the last: h, least r, rows
    for b in batches:
        if not b.num_rows:
            continue
        h, r, t = (b.column(x).to_numpy() for x in ("h", "r", "t"))
        if held is not None:
            h, r, t = (np.concatenate([[x], y]) for x, y in zip(held[:3], (h, r, t)))
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1]) | (t[1:] != t[:-1])])  # equal rows are one
        h, r, t = h[fresh], r[fresh], t[fresh]
        same = h[1:] == h[:-1]
        before = np.concatenate([[held is not None and held[3]], same])  # the row before has the same h
        starts = np.flatnonzero(~before)
        if head is None:
            head = [h[0], r[0], 0]
        fresh = np.arange(len(h)) >= (0 if held is None else 1)
        head[2] += int(((h == head[0]) & fresh).sum())
        last = int((h[-1] == h).sum()) - (0 if held is None or held[0] != h[-1] else 1)
        tail = [h[-1], r[starts[-1]], last] if len(starts) and (tail is None or h[-1] != tail[0]) else [tail[0], tail[1], tail[2] + last]
        first = np.zeros(len(h) - 1, bool)
        first[:1] = held is None or held[4]
        keep = first | before[:-1] | same
        yield out(h[:-1][keep], r[:-1][keep], t[:-1][keep], pa.array(before[:-1][keep], mask=first[keep]), np.zeros(int(keep.sum()), np.int64))
        held = (h[-1], r[-1], t[-1], bool(before[-1]), len(h) == 1 and (held is None or held[4]))
    if held is not None:
        alone = held[4] or tail[2] == 1
        yield out([held[0]], [held[1]], [held[2]], [None if alone else held[3]], [0])
        ends = [head] if head[0] == tail[0] else [head, tail]
        yield out([e[0] for e in ends], [e[1] for e in ends], [None] * len(ends), [None] * len(ends), [e[2] for e in ends])


def repeated(rows: DataFrame) -> DataFrame:
    """The distinct ``rows`` (h, r, t long) whose h comes in several, with ``later``: r is not the least of its h.

    Rows are dealt by ranges of (h, r), sorted and compared with their neighbours, so that a very
    common h is spread over tasks. What happens at the edges of partitions is told by two rows a
    partition, which are broadcast, and bears on two rows a partition.
    """
    rows = common.written(rows, "sorted")
    found = rows.repartitionByRange("h", "r", "t").sortWithinPartitions("h", "r", "t")
    found = common.cut(found.mapInArrow(_compared, "h long, r long, t long, later boolean, n long"))
    common.removed(rows)
    ends = found.filter("t is null").groupBy(F.col("h").alias("h2")).agg(F.min("r").alias("lo"), F.sum("n").alias("n2"))
    open_ = found.filter("t is not null and later is null").join(F.broadcast(ends), F.col("h") == F.col("h2")).filter("n2 > 1")
    return found.filter("later is not null").select("h", "r", "t", "later").unionAll(open_.select("h", "r", "t", (F.col("r") != F.col("lo")).alias("later")))


def repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per distinct text with a repeat: ``t`` (its key), ``first``, ``copies``, ``n_words``, ``again``, ``later``.

    ``again``: the word ranges that occur elsewhere, in this or another text, as part of a run of
    at least ``length`` equal words. ``later``: those of them that occur at an earlier place, by
    id, then position (where ids are negative, null or very large, by a hash of id and text). A
    text held by several documents counts once, under its smallest id.

    1. Suffixes at minimiser positions are sorted by a hash of their first ``length // 2 + 1``
       words and compared with their neighbours; starts found at one place only are dropped.
    2. Matches of those left are extended left and right: every run of ``length`` words around a
       suffix, and of which it is the least one, is hashed, and the runs are sorted and compared with
       their neighbours in turn.
    Null and short texts have no repeat.
    """
    common.small_batches(docs.sparkSession)
    k, w = _starts(length)
    base = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).filter(F.length("text") >= 2 * length - 1).withColumn("t", _text_key(F.col("text")))
    heads = base.select("id", "t", F.size(common.words(F.col("text"))).alias("n_words")).groupBy("t").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.max("n_words").alias("n_words"))
    heads = common.written(heads.filter(F.col("n_words") >= length), "texts")
    ends = heads.agg(F.min("first"), F.max("first"), F.max("n_words"), F.count(F.when(F.col("first").isNull(), 1))).first()
    bits = max(1, int(ends[2] or 1).bit_length())
    plain = ends[0] is not None and not ends[3] and ends[0] >= 0 and int(ends[1]).bit_length() + bits <= 62
    order = F.col("first") if plain else F.xxhash64("first", "t").bitwiseAND((1 << (62 - bits)) - 1)

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = Hasher(), set()
        for pdf in batches:
            ks, ts = [], []
            if len(seen) > 1 << 20:
                seen.clear()
            for t, x in zip(pdf["t"], pdf["text"]):
                if t in seen:  # a copy adds nothing; those of other tasks are dropped when sorted
                    continue
                seen.add(t)
                h = hasher.words(x)
                if len(h) < length:
                    continue
                keys = hasher.runs(h, k)
                at = kept_suffixes(keys, w)
                # A start that comes twice in one text is a repeat as it is: the second has another sign.
                u, n = np.unique(keys[at], return_counts=True)
                ks += [u, u[n > 1]]
                ts += [np.full(len(u), t, np.int64), np.full(int((n > 1).sum()), ~t, np.int64)]
            if ks:
                yield pd.DataFrame({"h": np.concatenate(ks).view(np.int64), "t": np.concatenate(ts)})
        del hasher, seen
        common.tidy()

    found = repeated(base.select("t", "text").mapInPandas(entries, "h long, t long").select("h", F.col("t").alias("r"), "t"))
    # The second of two places in one text only tells that there are two.
    near = found.groupBy("t").agg(F.collect_set("h").alias("ks"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=3)
        for pdf in batches:
            yield pd.DataFrame({"t": pdf["t"], "id": pdf["id"], "z": [c.compress(x.encode("utf-8", "surrogatepass")) for x in pdf["text"]]})

    # Texts travel compressed; of a text's copies the first alone.
    texts = base.mapInPandas(packed, "t long, id long, z binary")
    near = near.join(heads.select("t", "first", order.alias("o")), "t").select(F.col("t").alias("t2"), "first", "o", "ks")
    mine = texts.join(near, (F.col("t") == F.col("t2")) & F.col("id").eqNullSafe(F.col("first"))).select("t", "o", "z", "ks")

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, d = Hasher(), zstandard.ZstdDecompressor()
        for pdf in batches:
            for t, o, z, ks in zip(pdf["t"], pdf["o"], pdf["z"], pdf["ks"]):
                h = hasher.words(d.decompress(z).decode("utf-8", "surrogatepass"))
                if len(h) < length:
                    continue
                # Of a repeated run, the least suffix is kept wherever the run occurs, so it is in ``ks``.
                least = _sliding(hasher.runs(h, k), w, np.minimum)
                s = np.flatnonzero(np.isin(least.view(np.int64), np.asarray(ks, dtype=np.int64)))
                if len(s):
                    runs = hasher.runs(h, length)[s]
                    yield pd.DataFrame({"h": runs.view(np.int64), "r": (int(o) << bits) | s, "t": np.full(len(s), t, np.int64)})
        del hasher
        common.tidy()

    runs = repeated(mine.mapInPandas(windows, "h long, r long, t long"))
    pos = F.col("r").bitwiseAND((1 << bits) - 1).cast("int")
    marked = runs.select("t", pos.alias("p"), "later")
    marked = marked.groupBy("t").agg(F.collect_list("p").alias("p"), F.collect_list(F.when(F.col("later"), F.col("p"))).alias("q"))

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"t": pdf["t"], "again": [spans(x, length) for x in pdf["p"]], "later": [spans(x, length) for x in pdf["q"]]})

    marked = marked.mapInPandas(covered, "t long, again array<array<int>>, later array<array<int>>").withColumnRenamed("t", "t2")
    out = heads.join(marked, F.col("t") == F.col("t2"), "left").filter("copies > 1 or again is not null")
    whole = F.array(F.array(F.lit(0), F.col("n_words")))
    return out.select("t", "first", "copies", "n_words", F.when(F.col("copies") > 1, whole).otherwise(F.col("again")).alias("again"), F.coalesce("later", F.array().cast("array<array<int>>")).alias("later"))


def measured(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: id, n_words, dup_words, removed_words (words within ``again`` and ``later``).

    Repeated rows (equal id and text) each return the row of one. A text shared by documents
    counts as repeated from its first word to its last if it has ``length`` words. Null texts: 0.
    """
    slim = docs.select(F.col(id).alias("_id"), F.size(common.words(F.col(text))).cast("long").alias("_n"), F.coalesce(_text_key(F.col(text)), F.lit(0)).alias("_t"))
    found = repeats(docs, id, text, length)
    total = lambda c: F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + x[1] - x[0]), F.lit(0)).cast("long")
    out = slim.join(found, F.col("_t") == F.col("t"), "left")
    gone = F.when((F.col("copies") > 1) & ~F.col("_id").cast("long").eqNullSafe(F.col("first")), F.col("n_words").cast("long")).otherwise(total(F.col("later")))
    return out.select(F.col("_id").alias(id), F.col("_n").alias("n_words"), total(F.col("again")).alias("dup_words"), F.coalesce(gone, F.lit(0)).cast("long").alias("removed_words"))


def without(text: str, ranges: list[list[int]]) -> str:
    """``text`` without the words in ``ranges`` and the space after each."""
    b = text.encode("utf-8", "surrogatepass")
    begins = [m.start() for m in _WORD.finditer(b)] + [len(b)]
    out, at = [], 0
    for lo, hi in sorted(map(list, ranges)):
        lo, hi = begins[min(lo, len(begins) - 1)], begins[min(hi, len(begins) - 1)]
        out.append(b[at : max(at, lo)])
        at = max(at, hi)
    return b"".join([*out, b[at:]]).decode("utf-8", "surrogatepass")


def trimmed(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` (its columns) with every repeated passage left at its first place only.

    A document none of whose words is left goes; texts without a repeat stay as they are. Other
    columns are kept as they are, whatever their names, but for ``n_chars``, which follows the text.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
        return pd.Series([without(t, r) for t, r in zip(texts, ranges)], index=texts.index, dtype=object)

    own = common.own_names(docs)
    found = repeats(docs, id, text, length).select(*[F.col(c).alias(own(c)) for c in ("t", "first", "copies", "n_words", "later")])
    keyed = docs.withColumn(own("key"), F.coalesce(_text_key(F.col(text)), F.lit(0))).join(found, F.col(own("key")) == F.col(own("t")), "left")
    copy = (F.col(own("copies")) > 1) & ~F.col(id).cast("long").eqNullSafe(F.col(own("first")))
    keyed = keyed.withColumn(own("later"), F.when(copy, F.array(F.array(F.lit(0), F.col(own("n_words"))))).otherwise(F.col(own("later"))))
    new = F.col(own("new"))
    touched = keyed.filter(F.size(own("later")) > 0).withColumn(own("new"), cut(F.col(text), F.col(own("later")))).filter(F.size(common.words(new)) > 0)
    cols = [new.alias(c) if c == text else F.length(new).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return keyed.filter(F.coalesce(F.size(own("later")), F.lit(0)) <= 0).select(*docs.columns).unionByName(touched.select(*cols))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50
), x AS (
  SELECT s.doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM s JOIN d USING (doc_id)
), m AS (
  SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS rn FROM x
), r AS (SELECT doc_id, p, rn > 1 AS later FROM m WHERE n > 1),
c AS (
  SELECT doc_id, q, bool_or(later) AS later FROM (SELECT doc_id, later, unnest(range(p, p + 50)) AS q FROM r) GROUP BY doc_id, q
), k AS (SELECT doc_id, count(*) AS dup, count(*) FILTER (WHERE later) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(dup, 0)::BIGINT AS dup_words, coalesce(gone, 0)::BIGINT AS removed_words FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
