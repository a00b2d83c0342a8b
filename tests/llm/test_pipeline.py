"""The pipeline held against a plain version of each stage, and over odd tables."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from quirework.llm import quality, simhash, tokens

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_classify(spark, rows):
    model = quality.train(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(np.array([quality.features(r[1]) for r in rows]).reshape(len(rows), -1))
    return [r for r, s in zip(rows, score) if s >= 0.3]


def plain_lines(rows):
    pages, seen = Counter(r[3] for r in rows), Counter()
    for r in rows:
        seen.update((r[3], b) for b in {x.strip(" ") for x in (r[1] or "").split("\n")} if b)
    out = []
    for i, text, lang, source, _ in rows:
        if text is not None:
            text = "\n".join(x for x in text.split("\n") if not (seen[source, x.strip(" ")] >= 3 and seen[source, x.strip(" ")] > 0.1 * pages[source]))
        out.append((i, text, lang, source, None if text is None else len(text)))
    return out


def plain_copies(rows):
    fp = [simhash.fingerprint_words((r[1] or "").encode().lower().split()) for r in rows]
    first = list(range(len(rows)))

    def root(k):
        while first[k] != k:
            k = first[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= 3:
                first[max(root(a), root(b))] = min(root(a), root(b))
    smallest = defaultdict(lambda: float("inf"))
    for k, r in enumerate(rows):
        smallest[root(k)] = min(smallest[root(k)], r[0])
    return [r for k, r in enumerate(rows) if r[0] == smallest[root(k)]]


def plain_pieces(rows):
    model, out = Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json")), []
    for r in rows:
        ids = [*model.encode(r[1] or "", add_special_tokens=False).ids, 1]
        out += [(r[0], s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    return sorted(out)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rows = [tuple(r) for r in docs.collect()]
    for (_, stage), plain in zip(corpus_pipeline.STAGES, (lambda x: plain_classify(spark, x), plain_lines, plain_copies)):
        got = sorted(tuple(r) for r in stage(spark, spark.createDataFrame(rows, SCHEMA), SF).collect())
        assert got == sorted(plain(rows)) and got
        rows = got
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()]
    texts, words = {r[0]: r for r in rows}, Counter()
    for i, text, lang, source, n in mixed:
        whole, some = texts[i], WORD.findall(text)
        assert (lang, source, n) == (whole[2], whole[3], len(text)) and some == WORD.findall(whole[1])[: len(some)] and some
        words[source] += len(some)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    assert abs(sum(words.values()) - 1.5 * sum(sizes.values())) <= 0.05 * sum(sizes.values()) and all(words[s] <= 2 * sizes[s] for s in sizes)
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == plain_pieces(mixed)
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1].tolist()] and sum(n for _, n in p) <= 2048


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here\nonce more", "en", None, 24), (3, "same text here\nonce more", "en", None, 24), (4, "w " * 30_000, None, "a", 60_000), (None, "no id at all", "en", "a", 12), (None, None, None, None, None)]


@pytest.mark.parametrize("rows", [[], ODD])
@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_over_odd_tables(spark, k, rows):
    got = corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, SCHEMA), SF)
    found = got.collect()
    assert k == len(corpus_pipeline.STAGES) - 1 or got.columns == corpus_pipeline.COLUMNS
    if not rows:
        assert not found
    if corpus_pipeline.STAGES[k][0] == "line dedup":
        assert len(found) == len(rows)
    if rows and corpus_pipeline.STAGES[k][0] == "packing":
        assert sum(r.start == 0 for r in found) == len(rows)
