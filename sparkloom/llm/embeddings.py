"""Embedding near-dedup: int8 tile products with error bounds, full precision where they can't decide."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .forest import Forest

#: Vectors in one tile, and candidate pairs that are recomputed at a time.
TILE = 2048
BLOCK = 1 << 17


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each vector as float64 bytes with a digest of them; nothing for what cannot link."""
    for pdf in batches:
        out = []
        for v in pdf["vector"]:
            x = None if v is None else np.asarray(v, dtype=np.float64)
            ok = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
            x = (x + 0.0).tobytes() if ok else None  # -0.0 becomes 0.0
            out.append((x, x and blake2b(x, digest_size=16).digest(), len(x) // 8 if x else None))
        vec, key, dim = zip(*out) if out else ((), (), ())
        yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "vec": vec, "key": key, "dim": pd.array(dim, dtype="Int32")})


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as ``scale * int8`` rows, and a bound on each row's Euclidean error."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    error = np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, error * (1 + 1e-9) + 1e-12


def _units(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)  # squares of huge or tiny components stay finite
    x = raw / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows with cosine >= threshold, in blocks.

    With x = s q + r, |r| <= e and |s q| <= 1 + e: x.y <= s_x s_y q_x.q_y + e_x (1 + e_y) + e_y.
    int8 products below 2**24 are exact in float32 (to 1040 dimensions; beyond, float64 is used).
    Only pairs whose bound reaches the threshold are computed again in double precision.
    """
    exact = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64
    qa, sa, ea = quantised(a)
    qb, sb, eb = quantised(b)
    qb = qb.astype(exact).T
    step = max(1, (1 << 21) // max(1, len(b)))
    for at in range(0, len(a), step):
        sl = slice(at, at + step)
        upper = (qa[sl].astype(exact) @ qb).astype(np.float64)
        upper *= sa[sl, None] * sb[None, :]
        upper += ea[sl, None] * (1 + eb[None, :]) + eb[None, :]
        i, j = np.nonzero(upper >= threshold - 1e-9)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), BLOCK):
            u, v = i[k : k + BLOCK], j[k : k + BLOCK]
            hit = (a[u] * b[v]).sum(axis=1) >= threshold
            yield u[hit], v[hit]


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when labels are equal and not null, dimensions are equal and the cosine is at
    least ``threshold``. Null, empty, zero and non-finite vectors, and rows with a null label or
    id, link with nothing: 0 links, their own component, kept. Copies (equal label and
    components) collapse to one class with a count, so a large group of copies costs one row.
    Rows that share an id but not a vector are one node of the graph. No rows in, none out.

    A label's classes are dealt by hash into tiles of about ``tile``; a task multiplies one pair
    of tiles and returns, for each class, how many vectors it links with and a spanning forest.
    """
    raw = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), F.col(label).cast("string").alias("label"))
    rows = common.written(raw.mapInPandas(_read, "id long, label string, vec binary, key binary, dim int"), "vectors")
    able = rows.filter("key is not null and label is not null and id is not null")
    classes = able.groupBy("label", "dim", "key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    # The hash decides the tile within 2**20 slots; the number of tiles follows the label's size.
    sizes = able.groupBy("label", "dim").agg(F.approx_count_distinct("key", 0.02).alias("n")).select("label", "dim", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    few = sizes.count() <= 100_000
    dealt = classes.join(F.broadcast(sizes) if few else sizes, ["label", "dim"]).withColumn("t", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        first = pdf.iloc[0]
        return pd.DataFrame({"label": [first["label"]], "dim": [first["dim"]], "tiles": [first["tiles"]], "t": [first["t"]], "reps": [pdf["rep"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "keys": [b"".join(pdf["key"])], "vecs": [b"".join(pdf["vec"])]})

    packed = dealt.groupBy("label", "dim", "t").applyInPandas(pack, "label string, dim int, tiles int, t int, reps binary, copies binary, keys binary, vecs binary")
    pairs = packed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = pairs.withColumn("lo", F.least("t", "u")).withColumn("hi", F.greatest("t", "u"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("t")
        if len(pdf) == 1 and pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
            return pd.DataFrame(columns=["label", "dim", "key", "links", "a", "b"])  # the other tile is empty
        dim = int(pdf["dim"].iloc[0])
        units = [_units(np.frombuffer(x, np.float64).reshape(-1, dim)) for x in pdf["vecs"]]
        reps = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["reps"]])
        copies = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["copies"]])
        keys = b"".join(pdf["keys"])
        same, n = len(units) == 1, len(reps)
        shift = 0 if same else len(units[0])
        count, forest = np.zeros(n, np.int64), Forest(n)
        for i, j in tile_links(units[0], units[-1], threshold, same):
            j = j + shift
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            forest.add(i, j)
        at = np.flatnonzero(count)
        root = forest.parent
        return pd.DataFrame({"label": pdf["label"].iloc[0], "dim": dim, "key": [keys[16 * x : 16 * x + 16] for x in at], "links": count[at], "a": reps[at], "b": reps[root[at]]})

    found = common.cut(pairs.groupBy("label", "dim", "lo", "hi").applyInPandas(product, "label string, dim int, key binary, links long, a long, b long"))
    # A node is an id: its copies may be rows of other ids, and one id may have several vectors.
    own = able.join(classes.select("label", "dim", "key", "rep", "copies"), ["label", "dim", "key"])
    joined = common.components(found.select("a", "b").union(own.filter("id <> rep").select("id", "rep")))
    counts = found.groupBy("label", "dim", "key").agg(F.sum("links").alias("links"))
    sized = classes.select("label", "dim", "key", "copies").join(counts, ["label", "dim", "key"], "left")
    out = rows.drop("vec").join(sized, ["label", "dim", "key"], "left").join(joined, F.col("id") == F.col("node"), "left")
    n_links = F.when(F.col("id").isNotNull(), F.coalesce(F.col("links"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(0)
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id), n_links.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), comp AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON c.x = v.vec_id LEFT JOIN degree d ON d.x = v.vec_id
"""
