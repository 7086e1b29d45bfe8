"""Toxicity: zstandard dictionaries of toxic and ordinary text, and what each saves on a text's words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents of each class that the model is fitted on at most (by order of md5(id)).
TOXIC_ROWS, ORDINARY_ROWS = 2000, 5000
#: Bytes of the dictionary trained on toxic text, and of that trained on ordinary text.
TOXIC_BYTES, ORDINARY_BYTES = 2048, 98304
#: A window is one word between a known text and the start of it, so that a frame's fixed costs cancel.
FRAME, TAIL = 64, 24
#: Windows whose lengths a worker remembers.
REMEMBERED = 400_000
EDGE = b".,!?#*$%&;:|\"'()"


def window_words(text: str | None) -> list[bytes]:
    """The distinct words of a whole text in order, A-Z lower-cased, without punctuation at their ends."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return [x for x in dict.fromkeys(v.strip(EDGE) for v in dict.fromkeys(w)) if x]


def _trained(samples: list[bytes], size: int, **how) -> bytes:
    """A zstandard dictionary of the samples; of too few samples to train on, their last bytes."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes]:
    """Two dictionaries of one size from the words of documents.

    Both end in a dictionary trained on ordinary text. Before it, one has a dictionary trained on
    what sets toxic text apart (words that recur in toxic documents and are in no ordinary one),
    the other as many zero bytes: equal offsets, so words that both know cost the same.
    """
    seen = {w for d in ordinary for w in d}
    often = Counter(w for d in toxic for w in d if w not in seen and len(w) > 2)
    least = max(2, round(0.008 * len(toxic)))
    own = [[w for w in d if often.get(w, 0) >= least] for d in toxic]
    told = _trained([b" " + b" ".join(d) + b" " for d in own if len(d) > 1], TOXIC_BYTES, k=20, d=6)
    base = _trained([b" ".join(d) for d in ordinary if d], ORDINARY_BYTES)
    return told + base, bytes(len(told)) + base


class Gauge:
    """How many bytes fewer a window takes with the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes) -> None:
        self.compress = [self._compressor(d) for d in (ordinary, toxic)]
        frame = ordinary[-FRAME:]
        self.before, self.after = frame + b" ", b" " + frame[:TAIL]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        how = zstandard.ZstdCompressionParameters.from_level(12, source_size=FRAME + TAIL + 16, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        if not content:
            return zstandard.ZstdCompressor(compression_params=how).compress
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress

    def saved(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            window = self.before + word + self.after
            ordinary, toxic = self.compress
            found = self.known[word] = len(ordinary(window)) - len(toxic(window))
        return found

    def features(self, words: list[bytes]) -> tuple[float, float, float, float]:
        """Of all windows of a text: the most saved, the three most, the mean saved beyond a byte, and windows over 2 bytes."""
        q = sorted(map(self.saved, words), reverse=True) or [0]
        return float(q[0]), float(sum(q[:3])), sum(x - 1 for x in q if x > 1) / (len(q) + 5), float(np.log1p(sum(x > 2 for x in q)))


class Calibration:
    """Logistic regression with a small ridge and no negative weight (more saved is never less toxic).

    Rows are weighted to the classes' true shares.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, share: float) -> None:
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        self.w = np.zeros(x.shape[1])
        self.offset = np.log(share / (1 - share))
        if len(set(y)) < 2:
            return
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        weight = np.where(y == 1, share / (y == 1).mean(), (1 - share) / (y == 0).mean())
        used = list(range(x.shape[1]))
        while True:
            w = self._fit(z[:, [*used, -1]], y, weight)
            if not used or w[:-1].min() >= 0:
                break
            used.pop(int(w[:-1].argmin()))
        self.w[used], self.offset = w[:-1], w[-1]

    @staticmethod
    def _fit(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        w = np.zeros(z.shape[1])
        ridge = np.full(len(w), 0.5)
        ridge[-1] = 0
        for _ in range(100):
            p = Calibration._sigmoid(z @ w)
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-6), z.T @ (weight * (y - p)) - ridge * w)
            w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-8:
                break
        return w

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -500, 500)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid((x - self.mean) / self.scale @ self.w + self.offset)


def fitted(rows: list[tuple[int, list[bytes]]], share: float) -> tuple[bytes, bytes, Calibration]:
    """The dictionaries of all ``rows`` (class, words) and thresholds calibrated on windows of unseen rows.

    Each half is scored with dictionaries of the other, so no document is judged by its own words.
    """
    x, y = [], []
    for part in (0, 1):
        learn, test = rows[part::2], rows[1 - part :: 2]
        gauge = Gauge(*dictionaries([w for c, w in learn if c], [w for c, w in learn if not c]))
        x += [gauge.features(w) for _, w in test]
        y += [c for c, _ in test]
    both = dictionaries([w for c, w in rows if c], [w for c, w in rows if not c])
    return *both, Calibration(np.array(x, dtype=float).reshape(-1, 4), np.array(y, dtype=float), share)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"y": pdf["y"], "h": pdf["h"], "words": [b" ".join(window_words(t)) for t in pdf["text"]]})


def scored(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, held: int = 1, cut: float = 0.7, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    The model is fitted on at most ``toxic_rows`` and ``ordinary_rows`` labelled documents whose
    crc32(id) mod ``modulus`` is not ``held``, taken by md5(id); of rows that share an id, the one of
    least text. Every whole text is scored. Null
    and empty texts score as a text whose windows save nothing. Documents with several labels
    count with the largest; null labels and ids teach nothing. Without both classes the score is
    the smoothed base rate. Repeated rows each return a row.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_lid")).agg(F.max(label).cast("int").alias("y"))
    known = known.filter(common.fold(F.col("_lid"), modulus) != held).withColumn("h", F.md5(F.col("_lid").cast("string").cast("binary")))
    n = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
    some = known.filter("y = 1").orderBy("h", "_lid").limit(toxic_rows).union(known.filter("y = 0").orderBy("h", "_lid").limit(ordinary_rows))
    sample = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(some), F.col("_id") == F.col("_lid"))  # bounded by the limits
    sample = sample.groupBy("_lid", "y", "h").agg(F.min("text").alias("text"))  # an id teaches once, however often its row is repeated
    got = sample.select("y", "h", "text").mapInPandas(_words, "y int, h string, words binary").collect()
    rows = [(r["y"], bytes(r["words"]).split()) for r in sorted(got, key=lambda r: (r["h"], bytes(r["words"])))]
    model = spark.sparkContext.broadcast(fitted(rows, share))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        toxic, ordinary, calibration = model.value
        gauge = Gauge(toxic, ordinary)
        for t in texts:
            x = np.array([gauge.features(window_words(v)) for v in t], dtype=float).reshape(-1, 4)
            yield pd.Series(calibration.score(x), index=t.index)

    out = docs.select(F.col(id).alias("_id"), score(F.col(text)).alias("score"))
    out = out.select(F.col("_id").alias(id), (common.fold(F.col("_id"), modulus) == held).alias("held_out"), "score")
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
