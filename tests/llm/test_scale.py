"""What only shows with repeated ids, hot keys, several passes or long lists, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.llm import linededup, shared, suffixes, urlfilter, vectors


def brute_suffixes(rows, length=100):
    """(id, n_bytes, n_removed, n_spans, kept) of every row; rows of one id and text are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))
    seen, found = set(), {}
    for key, text in order:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - length + 1):
            w = raw[at : at + length]
            if w in seen:
                gone[at : at + length] = True
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        found[key, text] = (key, len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), kept)
    return sorted((found[r] for r in rows), key=repr)


def got_suffixes(spark, rows):
    out = suffixes.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out), key=repr)


def crc_twins(rng):
    """Two different texts of ASCII letters with one CRC32."""
    seen = {}
    while True:
        block = rng.integers(97, 123, (20_000, 120), dtype=np.uint8)
        for row in block:
            raw = row.tobytes()
            other = seen.setdefault(zlib.crc32(raw), raw)
            if other != raw:
                return other.decode(), raw.decode()


def test_digests_are_alike(spark):
    texts = ["", "abc", "é" * 50, "x" * 1000]
    df = spark.createDataFrame([(t, k) for t in texts for k in (True, False)], "t string, k boolean")
    for r in df.select("t", "k", *suffixes.digest_columns(F.col("t").cast("binary"), F.col("k"))).collect():
        assert (r.th, r.tl) == suffixes.digest(r.t.encode(), r.k)


def test_equal_and_null_ids_lose_nothing(spark):
    rng = np.random.default_rng(11)
    a, b = crc_twins(rng)
    assert a != b and zlib.crc32(a.encode()) == zlib.crc32(b.encode())
    rows = [(1, a), (2, a), (2, b), (None, b + a), (None, "".join(rng.choice(list("pqrs"), 300))), (None, None), (-(1 << 63), b), (-(1 << 63), "".join(rng.choice(list("pqrs"), 300)) + b), (5, a), (5, a), (7, "")]
    rows.append((None, rows[4][1] + "tail"))
    assert got_suffixes(spark, rows) == brute_suffixes(rows)
    # Without null ids b's only place is its own, so it stays.
    rows = [(1, a), (2, a), (2, b)]
    assert {r[2] for r in got_suffixes(spark, rows) if r[4] == b.encode()} == {0}


@pytest.mark.parametrize(("step_bits", "shard_rows", "hot_runs"), [(2, 1 << 21, 1024), (1, 1 << 21, 2), (2, 40, 1024), (10, 10, 1), (10, 1 << 21, 30)])
def test_passes_large_shards_and_hot_codes(spark, monkeypatch, step_bits, shard_rows, hot_runs):
    for name, value in (("STEP_BITS", step_bits), ("SHARD_ROWS", shard_rows), ("HOT_RUNS", hot_runs), ("HOT_PIECES", hot_runs), ("STEP_ROWS", 64)):
        monkeypatch.setattr(suffixes, name, value)
    rng = np.random.default_rng(12)
    word = lambda n: "".join(rng.choice(list("abcdef"), n))
    common, long = word(60), word(400)
    rows = [(i, word(int(rng.integers(0, 200))) + common + word(int(rng.integers(0, 200)))) for i in range(150)]
    rows += [(200 + i, word(50) + long[i : i + 250] + word(60)) for i in range(40)] + [(300, "ab" * 300), (301, "ab" * 200 + "c" + "ab" * 90)]
    rows += [(None, rows[3][1]), (3, rows[4][1])]
    assert got_suffixes(spark, rows) == brute_suffixes(rows)


def test_texts_longer_than_a_chunk(spark):
    rng = np.random.default_rng(13)
    text = "".join(rng.choice(list("abcdefgh "), suffixes.CHUNK + 70_000))
    at = suffixes.CHUNK - 300
    rows = [(1, text), (2, "start " + text[at : at + 900]), (3, text[-500:] + "end")]
    assert got_suffixes(spark, rows) == brute_suffixes(rows)


def planted_vectors(rng, dim, n):
    """Vectors without a pattern, partners of some at cosines about 0.9, and two dense groups."""
    x = rng.normal(size=(n, dim))
    y = x[: n // 3] / np.linalg.norm(x[: n // 3], axis=1)[:, None]
    z = rng.normal(size=y.shape)
    z -= (z * y).sum(1)[:, None] * y
    z /= np.linalg.norm(z, axis=1)[:, None]
    c = rng.uniform(0.895, 0.91, len(y))[:, None]
    near = (c * y + np.sqrt(1 - c**2) * z) * rng.uniform(0.1, 9, len(y))[:, None]
    dense = np.concatenate([rng.normal(size=dim) * 3 + rng.normal(size=(n // 4, dim)) * s for s in (0.05, 1.2)])
    return np.concatenate((x, near, dense, dense[:40], 2 * dense[:40]))


@pytest.mark.parametrize(("dim", "kind"), [(8, "double"), (16, "float"), (64, "float")])
@pytest.mark.parametrize("many", [False, True])
def test_vectors_lose_no_link(spark, monkeypatch, dim, kind, many):
    if many:  # several hundred cells, blocks of 256, several parts of guests
        for name, value in (("CELL", 4), ("COPIES", 1e9), ("BLOCK_BYTES", 1)):
            monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(dim)
    x = planted_vectors(rng, dim, 1200)
    if kind == "float":
        x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = unit @ unit.T >= 0.9
    np.fill_diagonal(hit, False)
    lead = np.arange(len(x))
    while (lead != (low := np.minimum(lead, np.where(hit, lead[None, :], len(x)).min(1)))).any():
        lead = low
    got = vectors.dedup_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")).toPandas().sort_values("vec_id")
    assert got["n_links"].tolist() == hit.sum(1).tolist()
    assert got["component_id"].tolist() == lead.tolist()
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()


def test_vectors_over_odd_tables(spark):
    schema = "embedding array<double>, vec_id long, n long, code long, home string, v array<double>, mult int"
    big, rest = 1.7976931348623157e308, (None,) * 5
    rows = [([1.0, 2.0, 3.0], 1), ([1.0, 2.0, 3.0], 2), ([2.0, 4.0, 6.0], 3), ([1.0, 2.0], 4), ([1.0, 2.0], 5), ([1.0, 2.1], 6), ([0.0, -0.0], 7), ([float("inf"), 1.0], 8), ([big, 0.0], 9), ([1.0, 0.0], 10), ([], 11), (None, 12), ([1.0, None], 13), ([1.0, 2.0, 3.0], None), (None, None), ([-1.0, 5.0], 14), ([-1.0, 5.1], 14), ([float("nan"), 1.0], 15), ([7.0], 16), ([7.5], 17), ([-7.5], 18)]
    df = spark.createDataFrame([(*r, *rest) for r in rows], schema)
    got = sorted(map(tuple, vectors.dedup_vectors(df).collect()), key=repr)
    want = [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (7, 0, 7, True), (8, 0, 8, True), (9, 1, 9, True), (10, 1, 9, False), (11, 0, 11, True), (12, 0, 12, True), (13, 0, 13, True), (None, 0, None, True), (None, 0, None, True), (14, 1, 14, True), (14, 1, 14, True), (15, 0, 15, True), (16, 1, 16, True), (17, 1, 16, False), (18, 0, 18, True)]
    assert got == sorted(want, key=repr)
    assert vectors.dedup_vectors(df.where("false")).count() == 0
    assert vectors.dedup_vectors(df.where("embedding is null")).count() == 2


@pytest.mark.parametrize("hub", [256, 3])
def test_components_with_hubs(spark, monkeypatch, hub):
    monkeypatch.setattr(shared, "HUB", hub)
    rng = np.random.default_rng(14)
    edges = [(5000, i) for i in range(600)] + [(700, i) for i in range(701, 1300)] + [(599, 700)] + [(i, i + 1) for i in range(2000, 2060)] + [tuple(map(int, e)) for e in rng.integers(3000, 3400, (250, 2))]
    lead = {}

    def root(k):
        while lead.setdefault(k, k) != k:
            k = lead[k]
        return k

    for u, v in edges:
        a, b = root(u), root(v)
        lead[max(a, b)] = min(a, b)
    got = dict(map(tuple, shared.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {k: root(k) for k in lead if any(k in e and e[0] != e[1] for e in edges)}
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_rule(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"(?s)[^/?#]*", rest)[0])
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    fits = [r for r in rules if (h := r.split("/")[0]) is not None and host and (host == h or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    best = max(fits, key=len, default=None)
    return host, path, best, rules.get(best, "allow")


@pytest.mark.parametrize(("level_bytes", "chunk"), [(1 << 22, 1 << 16), (1500, 97)])
def test_urls_against_long_lists(spark, monkeypatch, level_bytes, chunk):
    for name, value in (("LEVEL_BYTES", level_bytes), ("CHUNK", chunk)):
        monkeypatch.setattr(urlfilter, name, value)
    rng = np.random.default_rng(15)
    tld, word = ["com", "net", "co.uk"], lambda: "".join(rng.choice(list("abc"), 3))
    rules = {}
    for _ in range(1200):
        rules[".".join([word() for _ in range(rng.integers(0, 3))] + [tld[rng.integers(3)]]) + "/" + word()[: rng.integers(0, 4)]] = ["allow", "block"][rng.integers(2)]
    urls = [f"{['http', 'x'][rng.integers(2)]}://" + ".".join([word() for _ in range(rng.integers(0, 4))] + [tld[rng.integers(3)]]) + "/" + word() + ["", "?q=a/b", "#f", "/x"][rng.integers(4)] for _ in range(800)]
    urls += [None, "", "no scheme", "http://", "http:///com/", "HTTP://Www.A.COM/abc", "http://com", "http://" + "a." * 20_000 + "com/abc", "http://a.com/" + "é" * 5000, "ftp://x.com./", "a://b.net://c.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in urlfilter.filter_urls(df, spark.createDataFrame(list(rules.items()), "rule string, action string")).collect()}
    for i, u in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == plain_rule(u, rules), u


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_lines_with_hot_sites_and_odd_columns(spark, monkeypatch, broadcast):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(linededup, "HOT_PAGES", 4)
    schema = "a string, text string, k int, salt string, `no` string, _kept string, t string, n_lines int, `x.y` int"
    rows = [("hot", f" nav\nbody {i % 20}\n\nnav ", i, "s", None, "k", "t", 7, i) for i in range(60)]
    rows += [(None, "nav\nnav", 100, *(None,) * 6)] * 3 + [("", "nav", 101, *(None,) * 6), ("b", None, 102, *(None,) * 6), ("b", "", 103, *(None,) * 6), ("c", "q\n" * 30_000, 104, *(None,) * 6)]
    df = spark.createDataFrame(rows, schema)
    out = linededup.dedup_lines(df, "a")
    assert out.columns == ["a", "text", "k", "salt", "no", "_kept", "t", "x.y", "n_lines", "n_dropped"]
    got = sorted((r.k, r.a, r.text, r.t, r.n_lines, r.n_dropped) for r in out.collect())
    # "nav" stands on all pages of hot, each body on 3 of 60; the null site's lines on all 3.
    want = [(i, "hot", f"body {i % 20}\n", "t", 4, 2) for i in range(60)] + [(100, None, "", None, 2, 2)] * 3
    want += [(101, "", "nav", None, 1, 0), (102, "b", None, None, 0, 0), (103, "b", "", None, 1, 0), (104, "c", "q\n" * 30_000, None, 30_001, 0)]
    assert got == sorted(want, key=lambda r: r[0])
    assert linededup.dedup_lines(df.where("false"), "a").count() == 0
