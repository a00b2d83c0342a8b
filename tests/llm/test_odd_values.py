"""Odd tables give the values that the docstrings state: nulls, empty and long texts, ties,
repeated rows, columns with names that the operators use themselves."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quirework.llm import licenses, mixing, packing, rules, simhash, tokens

LONG = " ".join(f"word{k}" for k in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, id long, t string, size long, fp long, node long, start long, sequence_id long, n_words long, score double, _id long, _h long, _g long, row string"
ROWS = [(1, LONG, "en", "a"), (2, LONG, "en", "a"), (2, LONG, "en", "a"), (3, "", None, None), (4, None, "en", "b"), (None, LONG + " more", None, None), (5, "w " * 30_000, "de", "b"), (6, "  \n\n x", "de", "c"), (7, "<|endoftext|> a  b MIT License", "", ""), (None, None, None, None), (8, "ß É\x00  " + "x" * 70_000, "fr", "d")]
WORDS = [re.findall("[^\x20\x09-\x0d]+", r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, *(None,) * 13) for r in ROWS], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_fingerprints(odd):
    got = rows_of(simhash.dedup_simhash(odd), "doc_id", "fingerprint", "component_id")
    fps = [simhash.fingerprint_words((r[1] or "").encode().lower().split()) for r in ROWS]
    reach = lambda f: min((r[0] for r, g in zip(ROWS, fps) if r[0] is not None and (f ^ g).bit_count() <= 3), default=None)
    assert got == sorted(((r[0], f"{f:016x}", reach(f)) for r, f in zip(ROWS, fps)), key=repr)
    assert (4, "0" * 16, 3) in got and (None, "0" * 16, 3) in got


def test_rules(odd):
    got = rows_of(rules.apply_rules(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for r, words in zip(ROWS, WORDS):
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        count = Counter(windows)
        repeats = len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)})
        lines = [x for x in (r[1] or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        want.append((r[0], len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r[1] or "")), len(lines) - len(set(lines)), repeats, len(words) < 50 or 100 * repeats > 50 * len(words)))
    assert got == sorted(want, key=repr)


def test_licenses(odd):
    got = rows_of(licenses.scan_licenses(odd), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for r in ROWS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        at = [i for i in range(len(words)) if words[i : i + 2] == ["mit", "license"]]
        want.append((r[0], len(words), len(at), at[0] if at else None, at[-1] if at else None, "mit" if at else ""))
    assert got == sorted(want, key=repr)


def test_sizes_of_the_mix(odd):
    out = mixing.mix_sources(odd).collect()
    assert sorted(((r.doc_id, r.size) for r in out), key=repr) == sorted(((r[0], len(w)) for r, w in zip(ROWS, WORDS)), key=repr)
    by = Counter()
    for r, w in zip(ROWS, WORDS):
        by[r[3]] += len(w)
    assert all(r.source_size == by[r.source] and 0 <= r.taken <= 2 * r.size for r in out)


def test_pieces(odd):
    model = tokens.ByteBPE(tokens.default_path("byte_bpe_50k.json"), tokens.default_path("byte_bpe_50k.tiktoken"), tokens.default_pattern())
    want = []
    for r in ROWS:
        ids = model.whole(r[1] or "") + np.array([1], "<u4").tobytes()
        want += [(r[0], s // 4, len(ids[s : s + 8192]) // 4, zlib.crc32(ids[s : s + 8192]), len(ids) // 4) for s in range(0, len(ids), 8192)]
    got = packing.pack(odd)
    assert rows_of(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == sorted(want, key=repr)
    assert packing.pack(odd.where("false")).count() == 0
