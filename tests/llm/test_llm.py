import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import plain
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import common, embeddings, mixing, pieces, quality, queries, rules, similar, simhash, suffixes, toxicity, urls, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, _fp string, t int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", 1) for i, t, s in rows], DOC)


ODD = [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one", "b"), (4, "one", "b"), (None, "two words", "b"), (7, "x" * 3000, None), (8, "ß é 漢字 a.b,c  d " * 400, "a")]
LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_has_the_answer_of_its_sql(spark, tables, data, name):
    got, want = queries.QUERIES[name](spark, data).toPandas(), tables.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_components_of_paths_stars_and_rings(spark):
    e = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    got = dict(map(tuple, common.components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in (200, 201, 202)}


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(20, 16))
    v = np.vstack([base[i % 20] + r.normal(size=16) * s for i, s in enumerate(r.choice([0.0, 0.05, 0.2, 1.0], 300))]).astype(np.float32)
    rows = [(i, [float(x) for x in v[i]], i % 2) for i in range(300)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [1.0] * 16, None), (905, [], 0)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(d, tile=40).collect()}
    x = v.astype(np.float64)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = (x @ x.T >= 0.93) & (np.arange(300)[:, None] % 2 == np.arange(300) % 2)
    low = np.arange(300)
    for _ in range(300):
        low = np.array([low[link[i]].min() for i in range(300)])
    assert got == {i: (int(link[i].sum()) - 1, int(low[i]), bool(low[i] == i)) for i in range(300)} | {i: (0, i, True) for i in range(900, 906)}
    assert embeddings.near_duplicates(d.limit(0)).count() == 0


def test_quantisation_bounds_hold():
    r = np.random.default_rng(2)
    x = r.normal(size=(200, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    q, s, e = embeddings.quantised(x)
    upper = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s + e[:, None] * (1 + e) + e
    assert (x @ x.T <= upper).all()


def test_trie_links_against_all_pairs():
    r = np.random.default_rng(3)
    keys = np.unique(np.concatenate([r.integers(0, 2**63, 300).astype(np.uint64)] + [np.uint64(2**60) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))]))
    for a, b, same in ((keys, keys, True), (keys[:200], keys[200:], False)):
        got = {(int(i), int(j)) for x, y in simhash.trie_links(a, b, 2, same) for i, j in zip(x, y)}
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i] ^ b[j]).item().bit_count() <= 2 and (i < j or not same)}


def test_simhash_query_against_all_pairs(spark, data):
    got = simhash.op2_simhash(spark, data).toPandas()
    fp = np.array([int(x, 16) for x in got.fingerprint], np.uint64)
    low = got.doc_id.to_numpy()
    for _ in range(20):
        low = np.array([low[np.bitwise_count(f ^ fp) <= 2].min() for f in fp])
    assert (low == got.component_id.to_numpy()).all()


def test_simhash_odd_rows(spark):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark, ODD)).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (None, None)} <= got
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    kept = simhash.deduplicated(docs(spark, ODD))
    assert kept.columns == docs(spark, ODD).columns and {r.doc_id for r in kept.collect()} >= {1, 4, None}


def similar_components(texts, least=0.8):
    """Smallest id of each text's component, by all pairs; texts: id to text."""
    grams = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        grams[i] = {" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    low = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and (grams[i] == grams[j] or 5 * len(grams[i] & grams[j]) >= 5 * least * len(grams[i] | grams[j]))]
    for _ in texts:
        new = dict(low)
        for i, j in links:
            new[i] = new[j] = min(new[i], new[j])
        if new == low:
            return low
        low = new


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similar, "NEAR", 3)
    r = np.random.default_rng(7)
    text = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    base, part, texts = text(120), text(90), {}
    for i in range(60):
        w = list(base)
        for at in r.integers(0, 120, int(r.integers(0, 7))):
            w[at] = f"e{i}"
        texts[i] = " ".join(w if i % 3 else part + text(60))  # a third shares a passage only
    texts |= {100: " ".join(base[:40]), 101: "a b c d e f g h i", 102: "A b c d e f  g h i", 103: "a b c d e f g h i j", 104: None, 105: ""}
    want = similar_components(texts)
    assert len(set(want.values())) > 20
    got = similar.near_duplicates(docs(spark, [(i, t, "a") for i, t in texts.items()] + [(None, texts[1], "a")])).collect()
    assert {x.doc_id: x.component_id for x in got} == want | {None: None}
    assert similar.near_duplicates(docs(spark, [])).count() == 0


def test_frequent_shingles_come_last_and_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(similar, "SAMPLE", 1)
    d = spark.createDataFrame([(i, "a b c d e" + " f" * (i > 4) if i < 30 else "g h i j k") for i in range(40)], "_id long, _text string")
    last, place = similar._last(d, 5, 42)
    names = {int(similar.shingles(t, 5)[0]): t for t in ("a b c d e", "b c d e f", "g h i j k", "x y z x y")}
    s = np.sort(np.array(list(names), np.uint64))
    assert [names[int(x)] for x in similar.ordered(s, last, place)] == ["x y z x y", "g h i j k", "b c d e f", "a b c d e"]
    assert (similar.ordered(s, last[:0], place[:0]) == s).all()
    monkeypatch.setattr(similar, "SIDE", 50)
    lists = spark.createDataFrame([(1, i, 10, 0, i) for i in range(400)], "k long, c long, n int, p int, g long")
    rows = similar._dealt(lists).cache()
    sizes = [r["count"] for r in rows.groupBy("lo", "hi").count().collect()]
    assert len(sizes) == 36 and max(sizes) < 200 and sum(sizes) == 400 * 8
    w = similar.sketch(np.arange(10, dtype=np.uint64))  # one sketch: every pair is possible, none is lost or comes twice
    got = rows.withColumn("w", F.lit(bytearray(w))).groupBy("k", "lo", "hi").applyInPandas(similar._across(0.8), similar.PAIR)
    assert got.count() == got.distinct().count() == 400 * 399 // 2


@pytest.mark.parametrize("few", [common.FEW, 0])
def test_rows_of_long_lists_are_dealt_out_once(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "NEAR", 3)
    monkeypatch.setattr(common, "FEW", few)
    r = np.random.default_rng(9)
    text = lambda n: [f"w{x}" for x in r.integers(0, 10**9, n)]
    part, texts = text(90), {i: " ".join(text(60)) for i in range(20, 60)}
    texts |= {i: " ".join(part + text(18 + i % 2)) for i in range(12)}  # long lists, no link but the last
    texts[12] = texts[11] + " more"
    dealt, seen = similar._dealt, []

    def watched(lists):
        seen.append((lists._jdf.queryExecution().optimizedPlan().toString(), lists.groupBy("k").count().collect()))
        return dealt(lists)

    monkeypatch.setattr(similar, "_dealt", watched)
    got = similar.near_duplicates(docs(spark, [(i, t, "a") for i, t in texts.items()])).collect()
    assert {x.doc_id: x.component_id for x in got} == similar_components(texts)
    (plan, lists), = seen
    assert "Generate" not in plan and lists and all(3 < x["count"] <= 13 for x in lists)


def test_pipeline_drops_a_planted_near_copy(spark, data):
    r = np.random.default_rng(8)
    w = [f"w{x}" for x in r.integers(0, 10**9, 104)]
    near, far = list(w), list(w)
    near[10] = near[50] = "other"
    far[10] = far[30] = far[50] = far[70] = far[90] = "other"
    d = docs(spark, [(1, " ".join(w), "a"), (2, " ".join(near), "a"), (3, " ".join(far), "a"), (None, " ".join(near), "a")])
    kept = corpus_pipeline.drop_near_copies(spark, d, data)
    assert kept.columns == d.columns and [x.doc_id for x in kept.orderBy("doc_id").collect()] == [None, 1, 3]


def test_pieces_are_the_librarys(spark, data):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(docs(spark, ODD[3:]).select("doc_id", "text").filter("doc_id is not null").distinct().withColumn("doc_id", F.col("doc_id") + 10**6))
    rows = pieces.decoded(pieces.encoded(d, pieces.default_model()), pieces.default_model()).join(d, "doc_id").collect()
    assert rows and all(list(r._ids) == own.encode(r.text) and r._decoded == r.text for r in rows)


def test_pieces_of_rare_units_are_joined(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "HOT", 0)
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rows = [(1, "a\0b \0\0 c", "a"), (2, "x" + "\0" * 100 + 'y "q" \\ é漢', "a"), (3, "plain words, plain words", "a"), (4, None, "a"), (5, "", "a")]
    got = pieces.decoded(pieces.encoded(docs(spark, rows), pieces.default_model()), pieces.default_model()).collect()
    assert {r.doc_id: list(r._ids) for r in got} == {i: own.encode(t or "") for i, t, _ in rows}


def test_viterbi_is_brute_force(spark):
    m = pieces.Model(pieces.default_model())
    score = {p: x for _, p, x in m.pieces}
    m.bpe = False
    words = ("▁the", "▁hello", "there", "▁▁a", "▁漢x")
    lat = pieces.lattice(spark.createDataFrame([(w, 1) for w in words], "unit string, n long"), m)
    for r in pieces.folded(lat, m).collect():
        w = r.unit
        cuts = [tuple(i + 1 for i in range(len(w) - 1) if k >> i & 1) for k in range(1 << (len(w) - 1))]
        total = lambda c: sum(score.get(x, m.unknown_score if len(x) == 1 else -1e18) for x in (w[i:j] for i, j in zip((0, *c), (*c, len(w)))))
        best = max(cuts, key=total)
        text = {i: p for i, p, _ in m.pieces}
        assert sum(score[text[i]] for i in r.ids if i in text) == pytest.approx(sum(score[x] for x in (w[i:j] for i, j in zip((0, *best), (*best, len(w)))) if x in score))


def test_long_units_and_odd_rows_are_the_librarys(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    r = np.random.default_rng(11)
    rows = [(i, "".join(r.choice(list("abcdethixo"), n)) + " " + "".join(r.choice(list("=-*."), n))) for i, n in enumerate([40, 47, 48, 49, 50, 64, 100, 250, 500])]
    rows += [(90, "x" * 1500), (91, "=" * 700), (None, "two  words"), (None, None), (92, ""), (93, " lead and trail "), (94, "▁ a▁ b"), (95, "same"), (95, "same"), (96, "é漢 😀")]
    d = spark.createDataFrame([(i, t, 1, 2, "c") for i, t in rows], "doc_id long, text string, _own1 long, _OWN_k1 long, cold string")
    for hot in (0, 1 << 19):
        got = pieces.encoded(d, pieces.default_model(), back="again", hot=hot)
        assert got.columns == [*d.columns, "_ids", "again"]
        assert sorted(((x.doc_id or -1, x.text or "", tuple(x._ids), x.again) for x in got.collect()), key=str) == sorted(((i or -1 if i != 0 else -1, t or "", tuple(own.encode(t or "")), None if t is None else own.decode(own.encode(t))) for i, t in rows), key=str)
    assert pieces.encoded(d.limit(0), pieces.default_model()).count() == 0


def test_fingerprints_are_those_of_a_plain_loop(spark):
    import xxhash

    texts = [t for _, t, _ in ODD] + ["One two THREE four five six", "a b c " * 500, "Ärger ÄRGER ärger x"]
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
        assert simhash.fingerprint(t) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_quality_scores_are_those_of_plain_densities(spark, data):
    d, lab = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows, known = d.toPandas(), lab.toPandas().groupby("doc_id").quality.max()
    x = np.array([quality.statistics(t) for t in rows.text])
    learn = np.array([i in known.index and zlib.crc32(str(i).encode()) % 4 != 2 for i in rows.doc_id])
    y = np.array([known.get(i, -1) for i in rows.doc_id])
    every = x[learn]
    mean, scale, k = every.mean(axis=0), every.std(axis=0), x.shape[1]
    z, pooled = (x - mean) / scale, np.corrcoef(every.T)
    gap = np.zeros(len(x))
    for c in (0, 1):
        own = z[learn & (y == c)]
        weight = min(1.0, quality.SHRINKAGE + k / (len(own) + k))
        cov = (1 - weight) * np.cov(own.T, bias=True) + weight * (pooled + np.eye(k)) / 2 + 1e-4 * np.eye(k)
        diff = z - own.mean(axis=0)
        gap += (1 if c else -1) * -0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) + np.linalg.slogdet(cov)[1])
    prior = ((y[learn] == 1).sum() + 1) / (learn.sum() + 2)
    want = 1 / (1 + np.exp(-np.clip(gap + np.log(prior / (1 - prior)), -500, 500)))
    got = quality.scored(d, lab).toPandas().set_index("doc_id").score
    assert np.allclose(got[rows.doc_id].to_numpy(), want, atol=1e-6)


def test_neighbours_over_partition_edges():
    import pyarrow as pa

    r = np.random.default_rng(0)
    for _ in range(300):
        n = int(r.integers(0, 40))
        h, least = np.sort(r.integers(0, int(r.integers(1, 20)), n)), np.arange(n) * 10
        rows = []
        for part in np.split(np.arange(n), np.sort(r.integers(0, n + 1, 3))):
            twice = np.repeat(part, 1 + part % 2)  # equal rows are one
            batches = [pa.RecordBatch.from_arrays([pa.array(h[x]), pa.array(least[x]), pa.array(x)], ["h", "r", "t"]) for x in np.array_split(twice, 3)]
            rows += [x for b in suffixes._compared(iter(batches)) for x in b.to_pylist()]
        ends = {}
        for x in rows:
            if x["t"] is None:
                lo, k = ends.get(x["h"], (x["r"], 0))
                ends[x["h"]] = (min(lo, x["r"]), k + x["n"])
        got = {(x["t"], x["r"] != ends[x["h"]][0] if x["later"] is None else x["later"]) for x in rows if x["t"] is not None and (x["later"] is not None or ends[x["h"]][1] > 1)}
        assert got == {(i, bool((h[:i] == h[i]).any())) for i in range(n) if (h == h[i]).sum() > 1}


def test_a_null_id_with_a_shared_passage(spark):
    w = " ".join(f"w{i}" for i in range(70))
    rows = [(1, f"a b c {w}", "a"), (None, f"{w} d e", "a"), (7, None, "a")]
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.measured(docs(spark, rows)).collect()}
    assert got[1][:2] == (73, 70) and got[None][:2] == (72, 70) and got[7] == (0, 0, 0)
    assert sorted([got[1][2], got[None][2]]) == [0, 70]
    assert suffixes.measured(docs(spark, [])).count() == 0


@pytest.mark.parametrize("outcomes", [[], [("a.com", 1)], [("a.com", 0), ("b.com", 1)], [("a.com", 1)] * 5 + [("a.co.uk", 0)] * 5, [("a.org", 0)] * 3])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_urls_with_few_outcomes(spark, outcomes, ansi, monkeypatch):
    p = spark.createDataFrame([(1, "http://a.com/x", "k"), (2, "http://a.com/" + "y" * 9000, "k"), (3, None, "k"), (None, "http://b.com", "k")], "page_id long, url string, bound string")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        o = spark.createDataFrame(outcomes, "host string, bad int")
        got = sorted(map(str, urls.judged(p, o).collect()))
        monkeypatch.setattr(urls, "FEW_BYTES", -1)  # the join beyond a broadcast gives the same
        assert len(got) == 4 and got == sorted(map(str, urls.judged(p, o).collect()))
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_suffixes_of_two_labels(spark):
    d = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("x.y.com",)], "h string").select(urls.domain_of(F.col("h")), urls.suffix_of(F.col("h"))).collect()
    assert [tuple(r) for r in d] == [("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com")]


def test_callers_columns_keep_their_values(spark, data):
    names = ["_t", "_later", "_new", "_own_t", "_own_first", "_key", "_n", "_at", "_p", "_gone", "_own_key", "_cold", "component_id", "_fp", "_row"]
    text = [" ".join(f"w{j}x{i % 3}" for j in range(60)) + f" end{i}" for i in range(9)]
    d = spark.createDataFrame([(i, text[i], "s", len(text[i]), *[f"{n}{i}" for n in names]) for i in range(9)], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    lab = spark.createDataFrame([(0, 1, 0)], LABELS)
    for out in (suffixes.trimmed(d), mixing.mixed(d), simhash.deduplicated(d), simhash.deduplicated(d, size=5, least=0.8), quality.accepted(d, lab), pieces.encoded(d, pieces.default_model(), key="ids").drop("ids")):
        rows = out.collect()
        assert out.columns == d.columns and rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_the_mix_holds_whole_copies_in_order(spark):
    rows = [(i, " ".join(["w"] * (5 + i % 7)), "abc"[i % 3]) for i in range(60)] + [(3, " ".join(["w"] * 8), "a")] * 2
    d = docs(spark, rows)
    want = Counter()
    for r in mixing.plan(d).collect():
        for copy in range(2):
            took = max(0, min(r["size"], int(r["target"]) - r["start"] - copy * r["source_size"]))
            want[r["doc_id"]] += took > 0 and 2 * took >= r["size"]
    assert Counter(x.doc_id for x in mixing.mixed(d).collect()) == +want


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    n = (y == 1).sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("name, label, modulus, held, least", [("op4_quality", "quality", 4, 2, 0.98), ("op9_toxicity", "toxic", 3, 1, 0.85)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, held, least):
    d = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, d).toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % modulus == held) for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    m = got[got.held_out].merge(spark.read.parquet(f"{d}/labels.parquet").toPandas(), on="doc_id")
    assert auc(m.score.to_numpy(), m[label].to_numpy()) >= least


def test_classifiers_on_odd_rows(spark):
    lab = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (4, None, None), (None, 1, 1)], LABELS)
    for f in (quality.scored, toxicity.scored):
        got = f(docs(spark, ODD), lab).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert f(docs(spark, ODD), lab.limit(0)).count() == len(ODD)
        assert f(docs(spark, []), lab).count() == 0
    assert quality.accepted(docs(spark, ODD), lab).columns == docs(spark, []).columns


def test_toxicity_scores_against_python_and_repeated_rows(spark, data):
    d, lab = (spark.read.parquet(f"{data}/{x}.parquet") for x in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in d.collect()}
    known = {}
    for r in lab.collect():
        if r.toxic in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            known[r.doc_id] = max(r.toxic, known.get(r.doc_id, 0))
    order = sorted((i for i in known if i in texts), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    toxic, ordinary, calibration = toxicity.fitted([(known[i], toxicity.window_words(texts[i])) for i in order], (sum(known.values()) + 1) / (len(known) + 2))
    gauge = toxicity.Gauge(toxic, ordinary)
    want = {}
    for i, s in texts.items():
        words = {w.strip(".,!?#*$%&;:|\"'()") for w in re.split(r"[\x09-\x0D ]+", re.sub("[A-Z]", lambda m: m[0].lower(), s or ""))} - {""}
        saved = sorted((len(gauge.compress[0](x)) - len(gauge.compress[1](x)) for x in (gauge.before + w.encode() + gauge.after for w in words)), reverse=True) or [0]
        x = [saved[0], sum(saved[:3]), sum(v - 1 for v in saved if v > 1) / (len(saved) + 5), np.log1p(len([v for v in saved if v > 2]))]
        want[i] = float(calibration.score(np.array([x], dtype=float))[0])
    for rows in (d, d.union(d).union(d)):
        got = toxicity.scored(rows, lab).collect()
        assert len(got) == rows.count()
        assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)


def test_rules_against_python(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in rules.op5_rules(spark, data).collect():
        s = texts[r.doc_id]
        w = re.findall(r"[^\x20\x09-\x0D]+", s)
        lines = [x for x in s.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(win)
        cover = {j for i, x in enumerate(win) if n[x] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in s), len(lines) - len(set(lines)), len(cover), failed)
        assert not (r.kept and failed)


def test_buckets_follow_the_distinct_ngrams(spark, monkeypatch):
    monkeypatch.setattr(rules, "BUCKETS", 4)
    d = docs(spark, [(i, " ".join(f"w{i}x{j}" for j in range(50)), "a") for i in range(100)])
    assert rules.bucket_count(d) == 512 and rules.bucket_count(d.limit(0)) == 4  # 5,000 words and 4,900 pairs
    assert rules.bucket_count(d.unionAll(d)) == 512
    ids = spark.createDataFrame([(1,)], "doc_id long")
    assert rules.log_ratios(d, ids).count() > 400
    want = {r.doc_id: round(r.score, 9) for r in rules.judged(d, ids).collect()}
    monkeypatch.setattr(rules, "WIDE", 0)
    assert {r.doc_id: round(r.score, 9) for r in rules.judged(d, ids).collect()} == want


def test_rules_make_ngrams_once_and_bound_their_buckets(spark, monkeypatch):
    d = docs(spark, [(i, " ".join(f"w{i}x{j}" for j in range(50)), "a") for i in range(100)])
    plan = rules.ngrams(d.select(F.lit(0).alias("t"), F.col("text").alias("_text")), 64).filter("gram is not null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # a filter on the size of the n-grams would make them again
    monkeypatch.setattr(rules, "BUCKETS", 4)
    assert rules.bucket_count(d, most=128) == 128
    monkeypatch.setattr(rules, "MOST", 64)
    assert rules.bucket_count(d) == 64
    monkeypatch.setattr(rules, "MOST", 1 << 18)
    monkeypatch.setattr(rules, "SAMPLE", 40)  # every second text, about: the estimate holds in proportion
    assert rules.bucket_count(d) in (256, 512)


def test_rules_on_odd_rows(spark):
    ids = spark.createDataFrame([(7,), (None,)], "doc_id long")
    got = rules.judged(docs(spark, ODD), ids).collect()
    assert len(got) == len(ODD) and all(r.base_failed for r in got if r.doc_id in (1, 2, 3, 4))
    assert rules.judged(docs(spark, []), ids).count() == 0 and rules.judged(docs(spark, ODD), ids.limit(0)).count() == len(ODD)


def test_archives_round_trip(spark, tmp_path):
    long = "päge\r\n\r\n" * 300
    rows = [(1, "http://a/\r\nX: y", long), (2, None, long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (9, "u", long), (9, "u", long)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = warc.read(spark, str(tmp_path / "w"))
    kinds = sorted((r.id or 0, r.record_type, r.refers_to or 0) for r in got.collect())
    assert kinds == [(0, "response", 0), (1, "revisit", 9), (2, "revisit", 9), (3, "response", 0), (4, "response", 0), (5, "response", 0), (9, "response", 0), (9, "response", 0)]
    assert {(r.id, r.payload) for r in warc.resolved(got).collect()} == {(i, h or "") for i, _, h in rows}


def test_mix_meets_targets_and_keeps_columns(spark, data):
    r = mixing.op7_mixing(spark, data).join(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "source"), "doc_id").toPandas()
    sums = r.groupby("source").agg({"taken": "sum", "target": "first", "size": "sum"})
    assert (abs(sums.taken - sums.target) <= 1).all() and (r.taken <= 2 * r["size"]).all()
    odd = docs(spark, ODD)
    assert mixing.plan(odd).count() == len(ODD) and mixing.mixed(odd).columns == odd.columns
    assert mixing.plan(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_repeats_are_cut_once(spark):
    r = np.random.default_rng(5)
    word = lambda n: " ".join("w%d" % x for x in r.integers(0, 10**9, n))
    p = word(60)
    rows = [(1, f"{word(70)} {p} {word(30)}", "a"), (2, f"{p}\n{word(80)}", "a"), (3, word(200), "a"), (5, word(49), "a"), (4, f"{word(80)} {p}", "b")]
    rows += [(6, rows[2][1], "c")] + [(100 + i, t, s) for i, t, s in ODD[:4]]
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.measured(docs(spark, rows)).collect() if x.doc_id}
    assert got[1] == (160, 60, 0) and got[2] == (140, 60, 60) and got[4][1:] in ((60, 60), (0, 0)) and got[3] == (200, 200, 0) and got[6] == (200, 200, 200) and got[5] == (49, 0, 0)
    left = {x.doc_id: x.text for x in suffixes.trimmed(docs(spark, rows)).collect()}
    assert left[1] == rows[0][1] and p not in left[2] and len(left[2].split()) == 80 and 6 not in left and left[3] == rows[2][1]


def test_urls_on_odd_rows(spark):
    p = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "HTTP://A.COM/en/x?q#f"), (3, "HTTP://A.COM/en/x?q#f"), (4, "x://net"), (5, "x://a.Example.com/en/7")], "page_id long, url string")
    got = sorted((tuple(r) for r in urls.judged(p, spark.createDataFrame([], "host string, bad int")).collect()))
    assert got[0] == (1, "", "", None, "allow") and got[1] == (2, "", "", None, "allow") and got[2] == got[3] == (3, "a.com", "/en/x", "com/en/", "block")
    assert got[4] == (4, "net", "", None, "allow") and got[5] == (5, "a.example.com", "/en/7", "example.com/en/7", "allow")


def test_pipeline_stages(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = common.written(stage(spark, d, data), "test")
        assert d.columns == columns and d.count() > 0, name
        if name != "mixing sources":
            assert d.count() <= n
            n = d.count()
    last = corpus_pipeline.STAGES[-1][1](spark, d, data)
    assert last.count() == d.count() and last.columns == ["doc_id", "ids"]
