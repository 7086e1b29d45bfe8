"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Each statistic, after its transform: shares per 100 characters or words, with pseudo-counts so
#: that short texts vary little, on a log scale.
FEATURES = ("words", "symbols", "capitals", "bangs", "digits", "stutter", "repeats", "variety", "length", "stops", "lines")
#: Weight of the pooled and spherical targets in each class covariance.
SHRINKAGE = 0.02


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    b = (text or "").encode("utf-8", "surrogatepass")
    w = b.split()
    n, size = len(w), len(b)
    share = lambda k, of, extra: float(np.log1p(100 * k / (of + extra)))
    without = lambda chars: size - len(b.translate(None, chars))
    lines = [x for x in map(bytes.strip, b.split(b"\n")) if x]
    triples = set(zip(w, w[1:], w[2:]))
    return [
        float(np.log1p(n)),
        share(without(b"#*$%&|<>"), size, 30),
        share(without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size, 60),
        share(b.count(b"!"), size, 30),
        share(without(b"0123456789"), size, 60),
        share(sum(map(bytes.__eq__, w[1:], w)), n, 40),
        share(max(0, n - 2) - len(triples), n, 40),
        float(np.log((len(set(w)) + 5) / (n + 5) ** 0.85)),
        (sum(map(len, w)) + 100) / (n + 20),
        share(b.count(b".") + b.count(b","), n, 40),
        share(len(lines) - len(set(lines)), len(lines), 5),
    ]


class Discriminant:
    """Class means and Cholesky factors of shrunk class covariances, over standardised features."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE) -> None:
        """``moments``: class -> count, sum of x, sum of x x'. A class without rows leaves the base rate."""
        d = len(FEATURES)
        n = sum(m[0] for m in moments.values())
        self.prior = (moments.get(1, (0,))[0] + 1) / (n + 2)
        self.classes = {}
        if not all(moments.get(c, (0,))[0] for c in (0, 1)):
            return
        mean = sum(m[1] for m in moments.values()) / n
        cov = sum(m[2] for m in moments.values()) / n - np.outer(mean, mean)
        self.mean, self.scale = mean, np.sqrt(np.maximum(np.diag(cov), 1e-12))
        pooled = cov / np.outer(self.scale, self.scale)
        for c in (0, 1):
            k, s, ss = moments[c]
            m = s / k
            own = (ss / k - np.outer(m, m)) / np.outer(self.scale, self.scale)
            weight = min(1.0, shrinkage + d / (k + d))  # few rows: mostly the pooled shape
            own = (1 - weight) * own + weight * (pooled + np.eye(d)) / 2 + 1e-4 * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.classes[c] = ((m - mean) / self.scale, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the logistic of the difference of the log densities and log priors."""
        if not self.classes:
            return np.full(len(x), self.prior)
        z = (x - self.mean) / self.scale
        log = {c: -0.5 * ((((z - m) @ inv.T) ** 2).sum(axis=1) + det) for c, (m, inv, det) in self.classes.items()}
        gap = log[1] - log[0] + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(gap, -500, 500)))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: count, sums and sums of products of ``x``. Every labelled row counts; 2 rows reach the driver."""
    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i + 1)]
    out = {}
    for r in rows.groupBy("y").agg(F.count("*").alias("k"), *sums).collect():
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        out[r["y"]] = (float(r["k"]), np.array([r[f"s{i}"] for i in range(d)]), p)
    return out


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 4, held: int = 2, cut: float = 0.7) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Learns from all labelled documents whose crc32(id) mod ``modulus`` is not ``held``; scores
    all. Null and empty texts get the score of an empty text. Documents with several labels
    count with the largest; null labels and ids teach nothing. Without both classes the score is
    the smoothed base rate. Repeated rows each return a row. One pass over the texts.
    """

    common.small_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measured(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    x = common.written(docs.select(F.col(id).alias("_id"), measured(F.col(text)).alias("x")), "statistics")
    fold = common.fold(F.col("_id"), modulus)
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_lid")).agg(F.max(label).cast("int").alias("y"))
    known = known.filter(common.fold(F.col("_lid"), modulus) != held)
    model = Discriminant(moments(x.join(known, F.col("_id") == F.col("_lid")).select("x", "y")))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v.to_numpy())) if len(v) else np.zeros(0), index=v.index)

    out = x.select("_id", (fold == held).alias("held_out"), score("x").alias("score"))
    return out.select(F.col("_id").alias(id), "held_out", "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id: str = "doc_id", cut: float = 0.5, **how) -> DataFrame:
    """``docs`` (its columns) without documents that score under ``cut``. Rows with a null id stay.

    The cut is at even odds, so that a clean document is dropped only when junk is likelier.
    """
    return common.without(docs, id, scored(docs, labels, id, **how).filter(F.col("score") < cut).select(id))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
