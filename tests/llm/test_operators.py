import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pytest
import xxhash
from pyspark.sql import functions as F

from quirework.llm import licenses, linededup, mixing, packing, quality, queries, rules, shared, simhash, suffixes, tokens, urlfilter, vectors

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, host string, id long, t string"
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rest = (None,) * 5
    rows = [(1, LONG, "en", "a", 1, *rest), (2, LONG, "en", "a", 1, *rest), (2, LONG, "en", "a", 1, *rest), (3, "", None, None, 0, *rest), (4, None, "en", "b", None, *rest), (None, LONG + " x", None, None, None, *rest), (5, "w " * 30_000, "de", "b", 2, *rest), (6, "  \n\n x", "de", "c", 2, *rest), (7, "<|endoftext|> a  b", "", "", 3, *rest)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert oracle.differs(spark, queries.QUERIES[name], queries.SQL[name], SF) == ""


def test_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (5, None), (5, 0), (6, 1)], "doc_id long, quality int")
    for docs, n in ((odd, 9), (odd.where("false"), 0)):
        assert mixing.mix_sources(docs).count() == n
        assert licenses.scan_licenses(docs).count() == n
        assert simhash.dedup_simhash(docs).count() == n
        assert linededup.dedup_lines(docs).count() == n
        model = quality.train(docs, labels)
        assert quality.score_quality(docs, model).count() == n
        assert packing.pack(docs).agg(F.sum((F.col("start") == 0).cast("int"))).first()[0] == (n or None)
        assert rules.apply_rules(docs).count() == n
        assert suffixes.dedup_suffixes(docs).count() == n
        assert urlfilter.filter_urls(docs.withColumn("url", F.col("text")), spark.createDataFrame([("com/", "block")], "rule string, action string")).count() == n
    got = {(r.doc_id, r.n_removed) for r in suffixes.dedup_suffixes(odd).collect()}
    assert {(1, len(LONG)), (2, len(LONG)), (None, 0), (3, 0)} <= got
    assert {r.component_id for r in simhash.dedup_simhash(odd).where("doc_id in (1, 2)").collect()} == {1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 10 for i in range(10, 61)} | {i: 100 for i in range(100, 160)}


def brute_components(n, near):
    lead = list(range(n))
    for i in range(n):
        for j in np.flatnonzero(near(i)):
            a, b = lead[i], lead[j]
            if a != b:
                lead = [min(a, b) if x in (a, b) else x for x in lead]
    return lead


def test_vectors(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(40, 32))
    x = np.concatenate([centre[rng.integers(0, 40, 900)] + rng.normal(size=(900, 32)) * rng.choice([0.05, 0.25, 0.4], 900)[:, None], np.repeat(centre[:1], 30, 0)])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, [1.0])]
    got = {r.vec_id: r for r in vectors.dedup_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= hit.sum(1)).all() and n.sum() >= 0.98 * hit.sum()
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(2000, 2005))


def test_cells_are_recalled_across_borders():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 64))
    y = 0.9 * x / np.linalg.norm(x, axis=1)[:, None] + 0.43 * (z := rng.normal(size=x.shape)) / np.linalg.norm(z, axis=1)[:, None]
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    centres = vectors.fit_cells(x, 24)
    gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2)
    (hx, ax), (hy, ay) = (vectors._assign(v, centres, gaps, vectors.MARGIN) for v in (x, y))
    k = np.arange(len(x))
    assert ((hx == hy) | ax[k, hy] | ay[k, hx]).mean() > 0.98


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.where("crc32(key) % 5 = 0")
    cascade = urlfilter.build_cascade(listed, universe, first_bits=2)
    assert len(cascade.levels) > 2
    wrong = universe.where(cascade.contains(F.col("key")) != F.expr("crc32(key) % 5 = 0"))
    assert wrong.count() == 0


def test_mix(spark):
    got = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    by = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).sort_index()
    size, weight = by["size"].to_numpy(float), np.resize([5, 2, 1], len(by)).astype(float)
    target, left, open_ = np.zeros(len(by)), 1.5 * size.sum(), np.ones(len(by), bool)
    while left > 1e-6:
        target[open_] += left * weight[open_] / weight[open_].sum()
        over = np.maximum(target - 2 * size, 0)
        left, target = over.sum(), np.minimum(target, 2 * size)
        open_ &= target < 2 * size
    assert np.allclose(by["target"], target) and (by["size"] == by["source_size"]).all()
    assert (np.abs(by["taken"] - by["target"]) <= 0.02 * by["target"] + 64).all()
    assert ((got["taken"] >= 0) & (got["taken"] <= 2 * got["size"])).all()


def test_sainte_lague(spark):
    w = [53, 24, 23, 9, 1, 0]
    parties = spark.createDataFrame([("g", i, float(x), float(sum(w))) for i, x in enumerate(w)], "g string, i int, w double, total double")
    for seats in (0, 1, 7, 30, 101):
        quota = [0] * len(w)
        for _ in range(seats):
            quota[max(range(len(w)), key=lambda i: (w[i] / (2 * quota[i] + 1), -i))] += 1
        got = mixing.sainte_lague(parties, F.lit(seats).cast("bigint"), "w", ["g"], [F.col("i")], "total")
        assert [r.quota for r in got.orderBy("i").collect()] == quota


def test_licenses(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "x GNU General Public License, version 3 y gnu general public license", "cc-by", "licensed under CC BY-NC 4.0", "mit licenses", "Copyright (c) 2020 Some Body. All rights reserved"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [(1, 3, 3, "apache"), (2, 1, 8, "gpl"), (1, 0, 0, "cc-by"), (1, 2, 2, "cc-by"), (0, None, None, ""), (0, None, None, "")]
    assert [r.labels for r in got] == ["apache,apache-2.0", "gpl,gpl-3.0", "cc-by", "cc-by,cc-by-nc-4.0", "", "copyright"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for key, text in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = sorted(i for _, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        assert (found[key].n_words, found[key].n_base) == (len(words), len(places))


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    base = [(i, t) for i, t in docs.collect()]
    near = [(10_000 + i, t.replace(" ", "  ", 1)) for i, t in base[:20]] + [(20_000 + i, t[:-1] + "q") for i, t in base[:50]]
    rows = base + near + [(30_000, None), (30_001, " ")]
    got = {r.doc_id: r for r in simhash.dedup_simhash(spark.createDataFrame(rows, "doc_id long, text string")).collect()}

    def brute(t):
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows.sort()
    fp = np.array([brute(t) for _, t in rows], np.uint64)
    lead = brute_components(len(rows), lambda i: np.bitwise_count(fp ^ fp[i]) <= 3)
    for (key, _), f, c in zip(rows, fp, lead):
        assert got[key].fingerprint == f"{int(f):016x}" and got[key].component_id == rows[c][0]


def test_pigeonhole_masks_and_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp] + [fp ^ (np.uint64(1) << np.uint64(a)) ^ (np.uint64(1) << np.uint64(b)) for a, b in ((3, 60), (9, 9), (17, 44))] + [np.arange(400, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fp)], "fp long, node long")
    lead = brute_components(len(fp), lambda i: np.bitwise_count(fp ^ fp[i]) <= 3)
    for cap in (8192, 40):
        monkeypatch.setattr(simhash, "BUCKET", cap)
        comp = dict(map(tuple, shared.components(simhash.links(nodes)).collect()))
        assert [comp.get(i, i) for i in range(len(fp))] == lead


def test_thresholds():
    assert simhash.allocate([{-1: 0, 0: 5, 1: 100}, {-1: 0, 0: 1, 1: 2}], 1) == (7, [0, 1])


def test_lines(spark):
    rows = [(i, "s", f"nav\nbody {i}\n\nnav") for i in range(9)] + [(9, "s", "body x"), (10, None, "nav"), (11, "t", None)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert got[0].text == "body 0\n" and got[0].n_dropped == 2 and got[9].text == "body x" and got[10].text == "nav" and got[11].text is None


def test_quality(spark):
    got = queries.op7_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93 and got["score"].between(0, 1).all()


def test_model_finds_interactions():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9
    assert set(model.score(x[:3] * 0).round(3)) and quality.fit(np.zeros((0, 3)), np.zeros(0)).score(x).std() == 0


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = tokens.ByteBPE(tokens.default_path("byte_bpe_50k.json"), tokens.default_path("byte_bpe_50k.tiktoken"), tokens.default_pattern())
    got = packing.pack(docs, group_pieces=100).toPandas()
    want = {i: model.whole(t) + np.array([1], "<u4").tobytes() for i, t in docs.collect()}
    for key, pieces in got.sort_values("start").groupby("doc_id"):
        ids, at = want[key], 0
        for r in pieces.itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)]) and r.doc_tokens == len(ids) // 4
            at += r.length
        assert 4 * at == len(ids)
    assert set(got["doc_id"]) == set(want)
    used = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 2048
        used += 2048
    assert got["length"].sum() / used > 0.95


def test_first_fit_decreasing():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        b = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert [(b, o) for b, o in zip(bins, offsets)] == [want[i] for i in range(300)]


def test_words_apart_encode_as_whole_texts():
    model = tokens.ByteBPE(tokens.default_path("byte_bpe_50k.json"), tokens.default_path("byte_bpe_50k.tiktoken"), tokens.default_pattern())
    for t in ["a  b", " x", "x ", "a \n b", "a\n\nb  c", "", "é<|endoftext|> x", "don't stop 12 3.4", "a\u00a0 b", "x\u2003y z", "tab\t x", "ünï cödé\n"]:
        assert model.encode(t) == model.whole(t)


def test_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    extra = spark.createDataFrame([(9001, "en", "a b c a b c\nx\nx\n\n \n \nÉé $%"), (9002, "en", None)], docs.schema)
    got = {r.doc_id: r for r in rules.apply_rules(docs.unionByName(extra)).collect()}
    for key, _, text in docs.unionByName(extra).collect():
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        r = got[key]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    # The bands once more, from the sorted bins of each group.
    groups, lang = {}, {r.doc_id: r.lang for r in docs.unionByName(extra).collect()}
    for r in got.values():
        if r.n_tokens >= 64:
            groups.setdefault((lang[r.doc_id], int(np.log2(r.n_tokens))), []).append(r)
    for rows in groups.values():
        odd = np.zeros(len(rows), bool)
        for m, width, least in zip(rules.METRICS, (9.0, 9.0, 6.0), (0.02, 0.01, 0.005)):
            x = np.array([r[m] for r in rows])
            bins = np.sort(np.floor(x / rules.BIN))
            low, mid, high = ((bins[math.ceil(q * len(bins)) - 1] + 0.5) * rules.BIN for q in (0.25, 0.5, 0.75))
            odd |= (x < mid - width * max(mid - low, least)) | (x > mid + width * max(high - mid, least))
        assert [r.kept for r in rows] == [not r.base_failed and not o for r, o in zip(rows, odd.tolist())]


@pytest.mark.parametrize("chunk", [1 << 19, 300])
def test_suffixes(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").limit(60).collect()]
    texts += ["ab" * 400, "ab" * 300 + "é" * 80, texts[3][50:400] + texts[9][:200], "".join(rng.choice(list("xyz"), 150)), "x" * 99, "x" * 100, "x" * 101]
    got = {r.doc_id: r for r in suffixes.dedup_suffixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    seen = set()
    for i, text in enumerate(texts):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            w = raw[at : at + 100]
            if w in seen:
                gone[at : at + 100] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, hashlib.sha256(bytes(got[i].kept)).digest()) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).digest()), i


def test_family_of_indexes_is_the_whole_index():
    rng = np.random.default_rng(7)
    n = 500
    a = {f: rng.integers(0, 30 if f in "gh" else 9, n).astype(t) for f, t in suffixes.FIELDS.items()}
    a["id"] = np.arange(n)
    family = suffixes.IndexFamily()
    for at in range(0, n, 37):
        family.add(suffixes.take(a, slice(at, at + 37)))
    assert [s for s, _ in family.levels] == [8, 4, 2]
    later, _ = family.finish()
    first = {}
    for g, h, i in zip(a["g"], a["h"], a["id"]):
        first.setdefault((g, h), i)
    assert sorted(later["id"]) == sorted(i for g, h, i in zip(a["g"], a["h"], a["id"]) if first[g, h] != i)
    b = suffixes.sort_array(a)
    assert all((suffixes.unpack_array(suffixes.pack_array(b), n)[f] == b[f]).all() for f in suffixes.FIELDS)
