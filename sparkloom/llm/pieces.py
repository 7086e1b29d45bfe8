"""SentencePiece encoding and decoding as a relational lattice.

Distinct units of text (a word, or a run of other characters, each with the spaces before it) are
exploded into substrings, joined to the piece table, grouped by unit and folded by Spark
higher-order aggregates. A unigram model's fold is Viterbi's: the path of the greatest score. The
greatest sum of a BPE model's ranks is not its encoding; so the fold of a BPE model takes merges,
best score first, leftmost of equal ones, on a state of one number. Longer units than that number
has places for are folded by Viterbi's recurrence over edges that may follow one another. Units are
cut where no piece of the table reaches across, so a text's pieces are those of its units in a row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SPACE = "▁"
UNIT = rf"{SPACE}*[\p{{L}}\p{{M}}]+|{SPACE}*[^{SPACE}\p{{L}}\p{{M}}]+|{SPACE}+"
#: Units whose pieces every worker holds at most, and their bytes at most; others are joined.
HOT, HOT_BYTES = 1 << 19, 64
#: Characters of a unit that one number's bits serve; longer units take the other fold.
FOLD = 48
#: Units that one task folds, about; bytes of text that a worker splits at a time, about.
TASK_UNITS, SLICE = 50_000, 3 << 20
#: Code points in a row of the table of single characters.
CELL = 16
#: Characters that end many words and are units of their own there.
MARKS = frozenset(".,;:!?")


class Model:
    """The piece table of a SentencePiece file: scores, byte pieces and the unknown piece.

    Refuses files that these operators would encode otherwise than the library: a normaliser other
    than ``identity``, extra white space removed, spaces not escaped or put behind words,
    user-defined symbols, and pieces that reach across units or are over ``FOLD`` / 2 long.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        how, trainer = proto.normalizer_spec, proto.trainer_spec
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only files without normalisation, with escaped spaces before words, are supported")
        if any(p.type == p.USER_DEFINED for p in proto.pieces):
            raise ValueError("user-defined symbols are not supported")
        if trainer.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        self.bpe = trainer.model_type == 2
        self.prefix = SPACE if how.add_dummy_prefix else ""
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [(i, m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]
        special = lambda i: m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i)
        self.unknown = m.unk_id()
        byte = {int(p[3:-1], 16): i for i, p, _ in every if m.is_byte(i)}
        self.bytes = [byte[b] for b in range(256)] if len(byte) == 256 else None
        self.pieces = [(i, p, s) for i, p, s in every if not special(i)]
        self.unknown_score = min(s for *_, s in self.pieces) - 10.0
        self.longest = max(len(p) for _, p, _ in self.pieces)
        cut = regex.compile(UNIT)
        across = [p for _, p, _ in self.pieces if cut.fullmatch(p) is None]
        if across or 2 * self.longest > FOLD:
            raise ValueError(f"pieces reach across units or are over {FOLD // 2} characters: {across[:5]}")
        back = {i: b for b, i in enumerate(self.bytes or [])}
        #: Each id's bytes; of special pieces, none.
        self.spelt = [bytes([back[i]]) if i in back else b"" if special(i) else p.replace(SPACE, " ").encode() for i, p, _ in every]
        one = {ord(p): i for i, p, _ in self.pieces if len(p) == 1}
        rows = sorted({c // CELL for c in one})
        #: The ids of characters that are pieces (-1 for others): rows of ``CELL`` code points, and each row's number.
        self.rows = [rows.index(r) if r in rows else -1 for r in range(max(rows, default=0) + 1)]
        self.chars = [one.get(r * CELL + c, -1) for r in rows for c in range(CELL)]


def split(texts: pa.Array, prefix: str = SPACE) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct units of texts, the units' numbers of all texts in a row, and where each text's end (from 0)."""
    units, codes, start, sizes, at, n = split_words(texts, prefix)
    size = sizes[at]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
    return units, codes[_ranges(start[at], size)], ends


def split_words(texts: pa.Array, prefix: str = SPACE) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct units; units' numbers of distinct words in a row, each word's start and size; words' numbers of all texts in a row, words a text.

    Words between spaces are taken once; texts with several spaces in a row, one at an end or
    U+2581 before a space are split as a whole, as one word. Null and empty texts have no unit.
    """
    cut = regex.compile(UNIT)
    lists = pc.split_pattern(texts.fill_null(""), " ")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = lists.flatten().dictionary_encode()
    at, words = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64), enc.dictionary
    first = np.cumsum(n) - n
    if prefix:
        odd = pc.or_(pc.equal(words, ""), pc.ends_with(words, SPACE)).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(odd[at].astype(np.int64), first) > 0 if len(at) else np.zeros(0, bool)
    else:
        whole = np.ones(len(n), bool)
    # Most words are letters, or letters and one mark; a unit of letters only is never cut too little.
    alpha = pc.utf8_is_alpha(words)
    stem, last = pc.utf8_slice_codeunits(words, 0, -1), pc.utf8_slice_codeunits(words, -1)
    mark = pc.and_(pc.and_not(pc.utf8_is_alpha(stem), alpha), pc.is_in(last, value_set=pa.array(sorted(MARKS))))
    other = pc.invert(pc.or_(alpha, mark))
    where = np.flatnonzero(whole)
    found = [cut.findall(prefix + w) for w in words.filter(other).to_pylist()]
    found += [cut.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts.take(pa.array(where)).to_pylist()]
    put = lambda a: pc.binary_join_element_wise(prefix, a, "")
    every = pa.concat_arrays([put(words.filter(alpha)), put(stem.filter(mark)), last.filter(mark), pa.array([u for f in found for u in f], pa.string())]).dictionary_encode()
    code = every.indices.to_numpy(zero_copy_only=False)
    alpha, mark, other = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (alpha, mark, other))
    sizes = np.ones(len(words) + len(where), np.int64)
    sizes[mark] = 2
    other = np.concatenate([other, len(words) + np.arange(len(where))])
    sizes[other] = [len(f) for f in found]
    start = np.cumsum(sizes) - sizes
    codes = np.empty(int(sizes.sum()), np.int32)
    codes[start[alpha]], code = code[: len(alpha)], code[len(alpha) :]
    codes[start[mark]], code = code[: len(mark)], code[len(mark) :]
    codes[start[mark] + 1], code = code[: len(mark)], code[len(mark) :]
    codes[_ranges(start[other], sizes[other])] = code
    # A text split as a whole counts as one word of its own.
    keep = np.repeat(~whole, n)
    keep[first[where]] = True
    at[first[where]] = len(words) + np.arange(len(where))
    return every.dictionary, codes, start, sizes, at[keep], np.where(whole, 1, n)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ..., ``size`` of them, for each in a row."""
    ends = np.cumsum(size)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32 if len(ends) and max(ends[-1], start.max()) < 1 << 31 else np.int64)
    out += np.repeat((start - (ends - size)).astype(out.dtype), size)
    return out


def _lengths(texts: pa.Array) -> np.ndarray:
    return np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)


def _slices(rows: pa.Array, ends: np.ndarray, most: int) -> Iterator[pa.Array]:
    """Runs of rows that hold at most ``most`` by their ``ends``, or one row."""
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield rows.slice(at, to - at)
        at = to


def _table(spark: SparkSession, model: Model) -> DataFrame:
    rank = {s: k for k, s in enumerate(sorted({s for *_, s in model.pieces}))}
    rows = [(p, i, float(s), rank[s]) for i, p, s in model.pieces]
    return spark.createDataFrame(rows, "piece string, id int, score double, rank long").withColumn("ph", F.xxhash64("piece"))


def edges(distinct: DataFrame, model: Model, least: int = 1) -> DataFrame:
    """``unit``, ``n``, ``s``, ``e``, ``sub``, ``piece``, ``id``, ``score``, ``rank``: substrings of ``least`` or more
    characters of each unit of ``distinct`` (unit, n) that are pieces; and each unit's first character, if ``least`` is 1 all.

    Two plain explodes and a projection are compiled. The table is the model's, of fixed size. The
    one equal key is a number, which Spark looks up far faster than a text; that each begins with
    the other is the exact check.
    """
    rows = distinct.select("unit", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("unit") - least))).alias("s"))
    low = F.when(F.col("s") == 0, F.lit(1)).otherwise(F.col("s") + least)
    rows = rows.select("unit", "n", "s", F.explode(F.sequence(low, F.least(F.col("s") + model.longest, F.length("unit")))).alias("e"))
    rows = rows.withColumn("sub", F.substring(F.col("unit"), F.col("s") + 1, F.col("e") - F.col("s")))
    same = (F.xxhash64("sub") == F.col("ph")) & F.col("sub").startswith(F.col("piece")) & F.col("piece").startswith(F.col("sub"))
    rows = rows.join(F.broadcast(_table(distinct.sparkSession, model)), same, "left")
    return rows.filter("piece is not null or e = s + 1").drop("ph")


def lattice(distinct: DataFrame, model: Model) -> DataFrame:
    """``unit``, ``n``, ``edges`` of every row of ``distinct`` (unit, n): all pieces of the table within it.

    Unigram models: struct(e, s, id, score), piece ``id`` from character ``s`` to ``e``; a character
    that is no piece has an edge with id -1. BPE models: struct(key, ends, within) of pieces of
    several characters. A key is a number: the score's rank, 63 - s, e and id + 1 in 24, 6, 6 and 20
    bits, so that the greatest is the best, then leftmost; ``ends`` has the bits s and e, ``within``
    those between. Exploding and joining leave the units where ``distinct`` has them: grouping by
    unit takes no shuffle if it is dealt by unit.
    """
    if model.bpe:
        key = "shiftleft(rank, 32) + shiftleft(cast(63 - s as long), 26) + shiftleft(cast(e as long), 20) + id + 1"
        edge = F.expr(f"if(piece is not null and e > s + 1, struct({key} as key, shiftleft(1L, s) + shiftleft(1L, e) as ends, shiftleft(1L, e) - shiftleft(2L, s) as within), null)")
    else:
        edge = F.struct("e", "s", F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(model.unknown_score)).alias("score"))
    rows = edges(distinct, model, 2 if model.bpe else 1).withColumn("h", F.xxhash64("unit"))
    # Sorted by the hash first: short to compare.
    return rows.groupBy("h", "unit").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges")).drop("h")


def _spelt(model: Model, c: Column) -> Column:
    """The pieces of a character that is no piece: its bytes' or the unknown one."""
    if not model.bytes:
        return F.array(F.lit(model.unknown))
    code = F.array(*map(F.lit, model.bytes))
    return F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda k: F.element_at(code, F.conv(F.substring(F.hex(c), 2 * k + 1, F.lit(2)), 16, 10).cast("int") + 1))


def folded(lattices: DataFrame, model: Model) -> DataFrame:
    """``unit``, ``n``, ``ids``: each lattice's pieces; of a unigram model by two folds (forward scores, then back)."""
    if model.bpe:
        return _joined(_places(lattices), model)
    n = F.length("unit")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("o"), F.lit(-1).alias("id")))
    step = lambda acc, e: F.concat(acc, F.array(F.array_max(F.transform(F.filter("edges", lambda x: x["e"] == e), lambda x: F.struct((F.get(acc, x["s"])["score"] + x["score"]).alias("score"), (-x["s"]).alias("o"), x["id"].alias("id"))))))
    best = lattices.withColumn("best", F.transform(F.aggregate(F.sequence(F.lit(1), n), start, step), lambda x: F.struct((-x["o"]).alias("s"), x["id"].alias("id"))))
    return best.select("unit", "n", _back(model, n))


def _back(model: Model, n: Column) -> Column:
    """The pieces of ``unit`` from ``best``: by end, struct(s, id) of the last piece."""
    begin = F.struct(n.alias("at"), F.array().cast("array<array<int>>").alias("ids"))

    def back(st: Column, _: Column) -> Column:
        b = F.get(F.col("best"), st["at"])
        here = F.when(b["id"] >= 0, F.array(b["id"])).otherwise(_spelt(model, F.substring(F.col("unit"), st["at"], F.lit(1))))
        return F.when(st["at"] > 0, F.struct(b["s"].alias("at"), F.concat(st["ids"], F.array(here)).alias("ids"))).otherwise(st)

    return F.aggregate(F.sequence(F.lit(1), n), begin, back, lambda st: F.flatten(F.reverse(st["ids"]))).alias("ids")


def _let(value: Column, body) -> Column:
    """``body`` of a value computed once: inside a fold a repeated expression is computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(lattices: DataFrame) -> DataFrame:
    """``lattices`` with ``at``, the places where pieces begin or end: merges of edges that span two present pieces, best first.

    The state is one number, a bit for each place (0 to n, at most ``FOLD``) where a piece still
    begins or ends; negated once no merge is left. An edge can merge if both its ends are such
    places and one place lies within it; the merge takes that place away.
    """
    here = lambda x, at: at.bitwiseAND(x["ends"]) == x["ends"]
    can = lambda at: F.filter("edges", lambda x: (F.bit_count(at.bitwiseAND(x["within"])) == 1) & here(x, at))
    merge = lambda at: _let(F.array_max(can(at)), lambda best: F.coalesce(at - at.bitwiseAND(best["within"]), -at))
    step = lambda at, _: F.when(at < 0, at).otherwise(merge(at))
    every = F.expr("shiftleft(1L, length(unit) + 1) - 1")
    return lattices.withColumn("at", F.abs(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length("unit") - 1, F.lit(1))), every, step)))


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """``unit``, ``n``, ``ids``: the edges that have no place within them at the end, and the characters left alone."""
    at = F.col("at")
    left = F.filter("edges", lambda x: (at.bitwiseAND(x["within"]) == 0) & (at.bitwiseAND(x["ends"]) == x["ends"]))
    begin = lambda k: 63 - F.shiftright(k, 26).bitwiseAND(F.lit(63)).cast("int")
    long = F.transform(left, lambda x: F.struct(begin(x["key"]).alias("s"), F.array((x["key"].bitwiseAND(F.lit(0xFFFFF)) - 1).cast("int")).alias("ids")))
    single = F.filter(F.sequence(F.lit(0), F.length("unit") - 1), lambda s: F.call_function("shiftright", at, s).bitwiseAND(F.lit(3)) == 3)
    rows_, chars = (F.split(F.lit(",".join(map(str, x))), ",").cast("array<int>") for x in (model.rows, model.chars))  # constants of the plan

    def alone(s: Column) -> Column:
        c = F.substring(F.col("unit"), s + 1, F.lit(1))
        row = F.coalesce(F.get(rows_, F.floor(F.ascii(c) / CELL).cast("int")), F.lit(-1))
        id = F.when(row >= 0, F.get(chars, row * CELL + F.ascii(c) % CELL)).otherwise(-1)
        return F.struct(s.alias("s"), F.when(id >= 0, F.array(id)).otherwise(_spelt(model, c)).alias("ids"))

    short = F.when(at.bitwiseAND(F.shiftright(at, 1)) != 0, F.transform(single, alone)).otherwise(F.array().cast("array<struct<s: int, ids: array<int>>>"))
    return rows.select("unit", "n", F.flatten(F.transform(F.array_sort(F.concat(long, short)), lambda x: x["ids"])).alias("ids"))


def _folded_long(distinct: DataFrame, model: Model) -> DataFrame:
    """``unit``, ``n``, ``ids`` of units of any length by a BPE model.

    Pieces in a row are the encoding of their text if and only if each two neighbours are that of
    theirs (merges within two neighbours come in one order, whatever is around them). So of the
    edges that end at a place, just one is the last piece up to there: that which may follow the
    last piece up to its start. Which two pieces may follow one another is folded as above, from
    their two texts; the fold over places then keeps the last piece up to each, and goes back.
    """
    every = edges(distinct, model).select("unit", "n", "s", "e", "sub", F.coalesce("id", F.lit(-1)).alias("id"))
    every = common.written(every, "edges")
    a = every.select("unit", F.col("s").alias("r"), F.col("e").alias("s"), F.col("sub").alias("one"))
    pairs = every.join(a, ["unit", "s"]).select("unit", "r", "s", "e", "one", F.col("sub").alias("two"))
    both = pairs.select("one", "two").distinct().withColumn("unit", F.concat("one", "two"))
    places = _places(lattice(both.select("unit").distinct().withColumn("n", F.lit(0).cast("long")), model)).select("unit", "at")
    stay = F.expr("1 + shiftleft(1L, length(one)) + shiftleft(1L, length(unit))")
    both = both.join(places, "unit").filter(F.col("at") == stay).select("one", "two")
    follow = pairs.join(both, ["one", "two"]).groupBy("unit", "s", "e").agg(F.collect_set("r").alias("after"))
    known = every.join(follow, ["unit", "s", "e"], "left").withColumn("after", F.when(F.col("s") == 0, F.array(F.lit(-1))).otherwise(F.col("after")))
    ends = known.filter("after is not null").groupBy("unit", "e").agg(F.first("n").alias("n"), F.collect_list(F.struct("s", "id", "after")).alias("x"))
    ends = ends.groupBy("unit").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda y: y["x"]).alias("ends"))
    step = lambda acc, e: F.concat(acc, F.slice(F.transform(F.filter(F.get(F.col("ends"), e - 1), lambda x: F.array_contains(x["after"], F.get(acc, x["s"])["s"])), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id"))), 1, 1))
    start = F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("id")))
    best = ends.withColumn("best", F.aggregate(F.sequence(F.lit(1), F.length("unit")), start, step))
    return best.select("unit", "n", _back(model, F.length("unit")))


def encoded_units(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``unit``, ``n``, ``ids`` of every distinct unit of all texts, as a table in the shared folder."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in _slices(b.column(0), _lengths(b.column(0)), SLICE):
                units, codes, _, sizes, at, _ = split_words(t, model.prefix)
                times = np.repeat(np.bincount(at, minlength=len(sizes)), sizes)
                n = np.bincount(codes, weights=times, minlength=len(units)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([units, pa.array(n)], ["unit", "n"]).filter(pa.array(n > 0))
            common.tidy()

    counts = docs.select(text).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    counts = common.written(counts, "units")
    # Units are short rows that take much work, so their count decides the tasks, not their bytes.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // TASK_UNITS))
    long = counts.filter(F.length("unit") > FOLD) if model.bpe else counts.limit(0)
    short = counts.filter(F.length("unit") <= FOLD) if model.bpe else counts
    out = folded(lattice(short.repartition(parts, "unit"), model), model)
    if not long.isEmpty():
        out = out.unionByName(_folded_long(long, model))
    out = common.written(out, "encoded")
    common.removed(counts)
    del counts, short, long
    common.released(docs.sparkSession)
    return out


def _hot(table: DataFrame, most: int) -> tuple[pa.Table, DataFrame]:
    """The most frequent units that are short, commonest first, ``most`` at most (all that occur c times, for the least such c); and the others."""
    able = table.filter(F.octet_length("unit") <= HOT_BYTES)
    counts = sorted(((r["n"], r["k"]) for r in able.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, total = math.inf, 0
    for n, k in counts:  # at most 100,000 different counts
        total += k
        if total > most:
            break
        least = n
    hot = (F.octet_length("unit") <= HOT_BYTES) & (F.col("n") >= (least if least < math.inf else 2**62))
    found = table.filter(hot).select("unit", "n", "ids").toArrow()
    return found.sort_by([("n", "descending"), ("unit", "ascending")]).select(["unit", "ids"]).combine_chunks(), table.filter(~hot)


class _Known:
    """The hot units of a broadcast table, and their pieces."""

    def __init__(self, blob: bytes) -> None:
        t = pa.ipc.open_stream(blob).read_all().combine_chunks()
        flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        self.unit, ids = flat(t["unit"]).cast(pa.string()), flat(t["ids"])
        self.offset = ids.offsets.to_numpy().astype(np.int64)
        self.ids = ids.values.to_numpy(zero_copy_only=False).astype(np.int32)

    def looked_up(self, texts: pa.Array, prefix: str, full: bool = True) -> Iterator[tuple]:
        """For slices of the texts: how many texts; of other units text, number in it, unit; if ``full`` all numbers in a row, and where each text's end.

        A number under the table's size is a place in it; from there on the text's other units are
        numbered by their first place in it. Looking up makes a table of all hot units, so the
        units of several slices are looked up at once.
        """
        for some in _slices(texts, _lengths(texts), 2 * common.BATCH):
            parts = [split_words(t, prefix) for t in _slices(some, _lengths(some), SLICE)]
            places = pc.index_in(pa.concat_arrays([p[0] for p in parts]), value_set=self.unit).fill_null(-1).to_numpy(zero_copy_only=False)
            for part in parts:
                mine, places = places[: len(part[0])], places[len(part[0]) :]
                yield self._numbered(*part, mine, full)

    def _numbered(self, units: pa.Array, codes: np.ndarray, start: np.ndarray, sizes: np.ndarray, at: np.ndarray, n: np.ndarray, places: np.ndarray, full: bool) -> tuple:
        words = np.cumsum(n)
        # Only words with a unit that is not hot are looked into for those.
        rare = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=places[codes] < 0, minlength=len(sizes)) > 0
        seen = np.flatnonzero(rare[at])
        mine = codes[_ranges(start[at[seen]], sizes[at[seen]])]
        doc = np.repeat(np.searchsorted(words, seen, "right"), sizes[at[seen]])
        miss = places[mine] < 0
        mine, doc = mine[miss], doc[miss]
        _, first, which = np.unique(doc * len(units) + mine, return_index=True, return_inverse=True)
        order = np.argsort(first)  # by text, then first place
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        doc, names = doc[first[order]], units.take(pa.array(mine[first[order]]))
        j = np.arange(len(order)) - np.searchsorted(doc, doc)
        if not full:
            return len(n), doc, j, names
        size = sizes[at]
        out = places[codes[_ranges(start[at], size)]]
        out[out < 0] = len(self.unit) + j[rank[which]]
        return len(n), doc, j, names, out, np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], words])]


def _packed(at: np.ndarray, ends: np.ndarray, z: zstandard.ZstdCompressor) -> list[bytes]:
    """Each text's numbers from 0, seven bits to a byte, low ones first, the last byte of each under 128; compressed."""
    if not len(at):
        return [b""] * (len(ends) - 1)
    width = max(1, (int(at.max()).bit_length() + 6) // 7)
    bits, keep = np.empty((len(at), width), np.uint8), np.ones((len(at), width), bool)
    for k in range(width):
        bits[:, k] = (at >> (7 * k)) & 127
        if k:
            keep[:, k] = at >> (7 * k) > 0
            bits[:, k - 1] |= keep[:, k].astype(np.uint8) << 7
    to = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])[ends]
    flat = memoryview(bits[keep])
    return [z.compress(flat[i:j]) if j > i else b"" for i, j in zip(to[:-1], to[1:])]


def _unpacked(blobs: list[bytes], d: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts in a row, and how many each has."""
    parts = [d.decompress(x) if x else b"" for x in blobs]
    bits = np.frombuffer(b"".join(parts), np.uint8)
    last = np.flatnonzero(bits < 128)
    first = np.concatenate([[0], last[:-1] + 1]).astype(np.int64)
    out, size = np.zeros(len(last), np.int64), last - first + 1
    for k in range(int(size.max()) if len(size) else 0):
        more = np.flatnonzero(size > k)
        out[more] |= (bits[first[more] + k].astype(np.int64) & 127) << (7 * k)
    ends = np.searchsorted(last, np.cumsum([len(x) for x in parts]))
    return out, np.diff(ends, prepend=0)


class _Speller:
    """The texts of lists of ids."""

    def __init__(self, model: Model) -> None:
        self.spelt, self.prefix = [*model.spelt, b""], model.prefix

    def __call__(self, lists: pa.Array) -> pa.Array:
        spelt, out = pa.array(self.spelt, pa.binary()), [pa.array([], pa.string())]
        ends = np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        out += [self._joined(x, spelt) for x in _slices(lists, ends, SLICE // 8)]
        return pc.if_else(lists.is_valid(), pa.concat_arrays(out), None)

    def _joined(self, lists: pa.Array, spelt: pa.Array) -> pa.Array:
        flat = lists.flatten().fill_null(-1)
        place = pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(spelt))), flat, len(spelt) - 1)
        n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
        out = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), spelt.take(place)), b"")
        try:
            out = out.cast(pa.string())
        except pa.ArrowInvalid:
            out = pa.array([x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())
        return pc.if_else(pc.starts_with(out, " "), pc.utf8_slice_codeunits(out, 1), out) if self.prefix else out


def encoded(docs: DataFrame, model_file: str, id: str = "doc_id", text: str = "text", key: str = "_ids", back: str | None = None, hot: int | None = None) -> DataFrame:
    """``docs``, all its columns, with ``key``: array<int>, the pieces of each whole text. Null and empty texts have none.

    ``hot``: units that workers hold at most (``HOT``); fewer take less memory and more shuffling.
    ``back``: a column for the text decoded again from the pieces, in the same pass (of null texts null).

    Workers look frequent units up in a table of bounded size; the others of a text are joined on
    the unit and gathered by text. Rows with equal id and text share their lookup; null ids and
    texts are values like any other. No row is lost. Columns of the names ``key`` and ``back`` are replaced. The
    decoded text differs from the text only if it holds U+2581. The session's Arrow batches are bounded
    by bytes from here on (``common.BATCH``).
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    model = Model(model_file)
    table = encoded_units(docs, model, text)
    held, others = _hot(table, HOT if hot is None else hot)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, held.schema) as w:
        w.write_table(held)
    known = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    prefix = model.prefix
    own = common.own_names(docs)
    row = [F.xxhash64(F.col(id), F.col(text)), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))]

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = _Known(known.value)
        for b in batches:
            _, once = np.unique(np.stack([b.column(x).to_numpy() for x in ("k", "c")]), axis=1, return_index=True)
            b, done = b if len(once) == b.num_rows else b.take(pa.array(np.sort(once))), 0  # of repeated rows one
            for n, doc, j, names in k.looked_up(b.column("t"), prefix, full=False):
                doc = pa.array(doc + done)
                yield pa.RecordBatch.from_arrays([b.column("k").take(doc), b.column("c").take(doc), pa.array(j.astype(np.int32)), names], ["k", "c", "j", "unit"])
                done += n
            common.tidy()

    cells = docs.select(row[0].alias("k"), row[1].alias("c"), F.col(text).alias("t"))
    small = "array<smallint>" if len(model.spelt) <= 1 << 15 else "array<int>"
    missing = cells.mapInArrow(cold, "k long, c long, j int, unit string").join(others.select("unit", F.col("ids").cast(small).alias("ids")), "unit")
    # Dealt by text before any grouping: a text's units come from everywhere, so there is little to group before.
    missing = missing.drop("unit").repartition("k", "c").groupBy(F.col("k").alias(own("k2")), F.col("c").alias(own("c2")))
    missing = common.written(missing.agg(F.transform(F.array_sort(F.collect_set(F.struct("j", "ids"))), lambda x: x["ids"]).alias(own("cold"))), "missing")
    common.released(spark)

    @F.arrow_udf("binary")
    def skeleton(b: pa.Array) -> pa.Array:
        k, z, out = _Known(known.value), zstandard.ZstdCompressor(level=3), []
        for *_, at, ends in k.looked_up(b, prefix):
            out += _packed(at, ends, z)
        common.tidy()
        return pa.array(out, pa.binary())

    spell = _Speller(model) if back else None

    def filled(packed: pa.Array, colds: pa.Array) -> pa.Array:
        k, d, out = _Known(known.value), zstandard.ZstdDecompressor(), []
        n = len(k.unit)
        first, last = (colds.offsets.to_numpy()[x].astype(np.int64) for x in (slice(None, -1), slice(1, None)))
        begin, ids = colds.values.offsets.to_numpy().astype(np.int64), colds.values.values.to_numpy(zero_copy_only=False)
        start = np.concatenate([k.offset[:-1], len(k.ids) + begin[:-1]])
        size = np.concatenate([np.diff(k.offset), np.diff(begin)])
        ids = np.concatenate([k.ids, ids.astype(np.int32)])
        ends = np.cumsum(pc.binary_length(packed).fill_null(0).to_numpy(zero_copy_only=False))
        done = 0
        for blobs in _slices(packed, ends, SLICE // 4):
            at, count = _unpacked(blobs.to_pylist(), d)
            doc = np.repeat(np.arange(len(blobs)) + done, count)
            at = np.where(at < n, at, at + first[doc])
            if (at >= n + last[doc]).any():
                raise ValueError("a unit's pieces are missing")
            long = size[at]
            to = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[0], np.cumsum(count)])]
            out.append(pa.ListArray.from_arrays(pa.array(to.astype(np.int32)), pa.array(ids[_ranges(start[at], long)])))
            done += len(blobs)
        out = pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))
        if spell:
            out = pa.StructArray.from_arrays([out, spell(out)], ["ids", "text"])
        common.tidy()
        return out

    fill = F.arrow_udf(filled, "struct<ids: array<int>, text: string>" if back else "array<int>")
    rows = docs.withColumns({own("k1"): row[0], own("c1"): row[1], own("there"): F.col(text).isNotNull(), own("packed"): skeleton(F.col(text))})
    out = rows.join(missing, (F.col(own("k1")) == F.col(own("k2"))) & (F.col(own("c1")) == F.col(own("c2"))), "left")
    out = out.withColumn(own("ids"), fill(own("packed"), own("cold")))
    found = {key: F.col(own("ids"))["ids"], back: F.when(F.col(own("there")), F.col(own("ids"))["text"])} if back else {key: F.col(own("ids"))}
    return out.withColumns(found).drop(*map(own, ("k1", "c1", "k2", "c2", "there", "packed", "cold", "ids")))


def decoded(rows: DataFrame, model_file: str, ids: str = "_ids", key: str = "_decoded") -> DataFrame:
    """``rows`` with ``key``: the text of the pieces in ``ids``; null ids give a null, unknown and control pieces nothing.

    Batches of ids are joined to the model's table by number, and each text's bytes put together:
    byte pieces join to UTF-8 (what is not UTF-8 becomes U+FFFD), and the first space goes where
    the model puts one. An id that is null or no number of the model's counts for nothing.
    """
    spell = _Speller(Model(model_file))

    @F.arrow_udf("string")
    def text(lists: pa.Array) -> pa.Array:
        return spell(lists)

    return rows.withColumn(key, text(F.col(ids)))


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op3_pieces(spark: SparkSession, sf_dir: str, model_file: str | None = None) -> DataFrame:
    """Per document: doc_id, n_pieces, ids_hash (of the piece ids in order), round_trip (the decoded text is the text)."""
    model_file = model_file or default_model()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.xxhash64("text").alias("_was"), F.col("text").isNotNull().alias("_there"))
    out = encoded(docs, model_file, back="_decoded")
    same = F.col("_there") == F.col("_decoded").isNotNull()
    return out.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.xxhash64("_ids").alias("ids_hash"), (same & (F.xxhash64("_decoded") == F.col("_was"))).alias("round_trip"))
