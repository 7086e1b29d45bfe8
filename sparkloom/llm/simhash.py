"""SimHash near-dedup: 64-bit fingerprints, linked by a binary-trie self-join."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .forest import Forest

#: Fingerprints in one packed subtrie: what one task holds of either side.
CHUNK = 16384
#: Node pairs that one traversal step handles at a time, and leaf pairs it expands at a time.
BLOCK = 1 << 18


def hashed(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """A hash of each word shingle, repeats included. Fewer words than ``size``: one shingle; no words: none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z changes, only ASCII white space splits
    if not w:
        return np.empty(0, dtype=">u8")
    grams = [b" ".join(w)] if len(w) < size else map(b" ".join, zip(*(w[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(g, seed) for g in grams), dtype=">u8")


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """SimHash over word shingles, repeats included. Fewer words than ``size``: one shingle; none: 0."""
    return majority(hashed(text, size, seed))


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; of none, 0."""
    if not len(h):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):  # long texts: a bounded bit matrix
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with ``_fp`` (long, the fingerprint's bits). Reads whole texts; one pass, no shuffle."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, size, seed) for t in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return docs.withColumn("_fp", of(F.col(text)))


def _children(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where each trie node (a range of sorted keys with one prefix) splits on the bit."""
    head = (keys[lo] >> (bit + np.uint64(1))) << (bit + np.uint64(1))
    return np.clip(np.searchsorted(keys, head | (np.uint64(1) << bit)), lo, hi)


def trie_links(a: np.ndarray, b: np.ndarray, budget: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into sorted ``a``, sorted ``b``) that differ in at most ``budget`` bits, in blocks.

    A node is a range of sorted keys that agree on their first bits. Node pairs go down
    together: equal bits keep the number of differing bits, unequal ones add one, and pairs
    over the budget end. Small nodes are compared key by key. ``same``: both are one trie,
    and each unordered pair comes once.
    """
    if not len(a) or not len(b):
        return
    todo = [tuple(np.array([x]) for x in (0, len(a), 0, len(b), 0)) + (63,)]
    while todo:
        a0, a1, b0, b1, d, bit = todo.pop()
        leaf = ((a1 - a0) * (b1 - b0) <= 32) | (bit < 0)
        la, lb, na, nb, ld = a0[leaf], b0[leaf], (a1 - a0)[leaf], (b1 - b0)[leaf], d[leaf]
        pairs = na * nb
        ends = np.cumsum(pairs)
        at = 0
        while at < len(pairs):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4 * BLOCK, "right")))
            n = pairs[at:to]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(nb[at:to], n)
            i, j = np.repeat(la[at:to], n) + k // width, np.repeat(lb[at:to], n) + k % width
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                hit &= i < j
            yield i[hit], j[hit]
            at = to
        go = ~leaf
        if not go.any():
            continue
        a0, a1, b0, b1, d = a0[go], a1[go], b0[go], b1[go], d[go]
        if len(a0) > BLOCK:  # depth first in blocks: memory stays bounded
            half = len(a0) // 2
            todo += [tuple(x[:half] for x in (a0, a1, b0, b1, d)) + (bit,), tuple(x[half:] for x in (a0, a1, b0, b1, d)) + (bit,)]
            continue
        sa, sb = _children(a, a0, a1, np.uint64(bit)), _children(b, b0, b1, np.uint64(bit))
        parts = [(a0, sa, b0, sb, d), (sa, a1, sb, b1, d), (a0, sa, sb, b1, d + 1), (sa, a1, b0, sb, d + 1)]
        na0, na1, nb0, nb1, nd = (np.concatenate(x) for x in zip(*parts))
        ok = (na1 > na0) & (nb1 > nb0) & (nd <= budget)
        if same:
            ok &= na0 <= nb0
        if ok.any():
            todo.append((na0[ok], na1[ok], nb0[ok], nb1[ok], nd[ok], bit - 1))


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["_fp"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return pd.DataFrame({"prefix": [pdf["prefix"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "keys": [keys[order].tobytes()], "ids": [pdf["id"].to_numpy(np.int64)[order].tobytes()]})


def links(classes: DataFrame, budget: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Spanning links ``(a, b)`` between the ids of distinct fingerprints within ``budget`` bits.

    ``classes``: ``_fp`` long (distinct), ``id`` long (distinct). The trie is cut at a depth k
    where a subtrie has about ``chunk`` / 4 keys; subtries that hold more are split into chunks,
    each a trie of its own. A task joins one pair of chunks whose k-bit prefixes differ in at
    most ``budget`` bits and returns a spanning forest of its links, not all pairs.
    """
    spark = classes.sparkSession
    n = classes.count()
    k = min(16, max(0, math.ceil(math.log2(max(1, 4 * n / chunk)))))
    masks = [m for m in range(1 << k) if bin(m).count("1") <= budget]
    keyed = classes.withColumn("prefix", F.shiftrightunsigned("_fp", 64 - k).cast("int") if k else F.lit(0))
    sizes = keyed.groupBy("prefix").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))  # at most 2**16 rows
    packed = (
        keyed.join(F.broadcast(sizes), "prefix")
        .withColumn("chunk", F.pmod(F.xxhash64("_fp"), F.col("chunks")).cast("int"))
        .groupBy("prefix", "chunk")
        .applyInPandas(_pack, "prefix int, chunk int, keys binary, ids binary")
    )
    here = F.struct("prefix", "chunk")
    there = F.struct(F.col("q").alias("prefix"), F.col("c").alias("chunk"))
    mask = spark.createDataFrame([(m,) for m in masks], "mask int")  # at most 137 rows
    sized = F.broadcast(sizes.select(F.col("prefix").alias("q"), F.sequence(F.lit(0), F.col("chunks") - 1).alias("cs")))
    dealt = (
        packed.crossJoin(F.broadcast(mask)) if k else packed.withColumn("mask", F.lit(0))
    ).withColumn("q", F.col("prefix").bitwiseXOR(F.col("mask"))).join(sized, "q").withColumn("c", F.explode("cs"))
    dealt = dealt.select(F.least(here, there).alias("lo"), F.greatest(here, there).alias("hi"), "prefix", "chunk", "keys", "ids")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["prefix", "chunk"])
        keys = [np.frombuffer(x, np.uint64) for x in pdf["keys"]]
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
        same = len(keys) == 1
        forest = Forest(len(ids))
        shift = 0 if same else len(keys[0])
        for i, j in trie_links(keys[0], keys[-1], budget, same):
            forest.add(i, j + shift)
        u, v = forest.edges()
        return pd.DataFrame({"a": ids[u], "b": ids[v]})

    return dealt.groupBy("lo", "hi").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, budget: int = 2, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``id``, ``_fp`` long, ``component_id`` long.

    Equal fingerprints collapse to one class before any join, so copies are never paired.
    Null, empty and white-space texts have fingerprint 0 and link like any other. Repeated
    rows each return a row. Rows with a null id keep their fingerprint but get a null
    component. No rows in, no rows out. Other columns are not read.
    """
    fps = common.written(fingerprints(docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text")), "_text", size, seed).drop("_text"), "simhash")
    classes = fps.filter("_id is not null").groupBy("_fp").agg(F.min("_id").alias("id"))
    found = common.components(links(classes, budget, chunk))
    roots = classes.join(found, classes["id"] == found["node"], "left").select("_fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(roots, "_fp", "left").select(F.col("_id").alias(id), "_fp", F.when(F.col("_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 3, budget: int = 2, least: float | None = None, seed: int = 42) -> DataFrame:
    """``docs`` without the rows that are not the first of their component; its columns are kept.

    ``least``: fingerprints within the budget only propose; documents link if the Jaccard similarity of
    their shingle sets is ``least`` or more, and pairs whose fingerprints differ by more bits are found
    by the prefixes of their sets (``similar``). Of rows that share an id all stay or all go. Rows with a
    null id stay.
    """
    if least is None:
        groups = near_duplicates(docs, id, text, size, budget, seed)
    else:
        from . import similar

        groups = similar.near_duplicates(docs, id, text, size, least, seed, budget)
    return common.without(docs, id, groups.filter(F.col(id) != F.col("component_id")).select(id))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")
