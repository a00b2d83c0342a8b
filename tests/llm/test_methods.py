"""Methods against plain versions: templates, features and look-up tables, one row of each group."""

import math
import re

import numpy as np
import pytest

from quirework.llm import licenses, mixing, packing, quality, simhash

SF = "/root/testdata/sf0.001"


def as_pattern(template: str) -> re.Pattern:
    """A template as one pattern over words with a space before each."""
    out, at = "", 0
    for m in re.finditer(r"<<(/?)(opt|var|alt):?(.*?)>>", template):
        out += "".join(f" {w}" for w in template[at : m.start()].split())
        at = m.end()
        if m[2] == "opt":
            out += ")?" if m[1] else "(?:"
        elif m[2] == "var":
            out += rf"(?: [^ ]+){{0,{m[3]}}}"
        else:
            out += "(?:" + "|".join("".join(f" {w}" for w in x.split()) for x in m[3].split("|")) + ")"
    return re.compile(out + "".join(f" {w}" for w in template[at:].split()) + "(?= |$)")


def longest(pattern: re.Pattern, words: list[str], at: int) -> int:
    """The end of the longest match at a word, by trying every end."""
    for end in range(len(words), at, -1):
        if pattern.fullmatch("".join(f" {w}" for w in words[at:end])):
            return end
    return -1


def wording(template: str, rng, optional: float) -> list[str]:
    """One wording that a template accepts."""
    out, skip = [], []
    for part in re.findall(r"<<.*?>>|[^<]+", template):
        if part == "<<opt>>":
            skip.append(rng.random() > optional or any(skip))
        elif part == "<</opt>>":
            skip.pop()
        elif any(skip):
            continue
        elif part.startswith("<<var:"):
            out += ["filler"] * int(rng.integers(0, int(part[6:-2]) + 1))
        elif part.startswith("<<alt:"):
            out += str(rng.choice(part[6:-2].split("|"))).split()
        else:
            out += part.split()
    return out


@pytest.mark.parametrize(("label", "template"), licenses.TEMPLATES)
def test_templates(label, template):
    rng = np.random.default_rng(len(template))
    automaton, pattern = licenses.compile_template(label, template), as_pattern(template)
    for k in range(12):
        text = wording(template, rng, k / 11)
        assert automaton.match([w.encode() for w in text], 0) == len(text)
        cases = [["see", *text, "and", "more"]]
        at = int(rng.integers(0, len(text)))
        cases += [text[:at] + text[at + 1 :], text[:at] + ["odd"] + text[at:], [*text[:at], "odd", *text[at + 1 :]], text[: at + 1]]
        for words in cases:
            for start in (0, 1):
                if start < len(words):
                    assert automaton.match([w.encode() for w in words], start) == longest(pattern, words, start)


def test_whole_licenses(spark):
    rng = np.random.default_rng(1)
    named = {label: " ".join(wording(t, rng, 1.0)) for label, t in reversed(licenses.TEMPLATES)}
    two, three, mit = named["bsd-2-clause"], named["bsd-3-clause"], named["mit"]
    texts = [two, three, mit, mit.replace("without restriction including", "without restriction but including"), named["isc"].upper(), "x", None, named["apache-2.0-header"]]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    labels = [set(r.labels.split(",")) - {""} for r in got]
    assert labels == [{"bsd-2-clause", "bsd-opening"}, {"bsd-3-clause", "bsd-opening"}, {"mit", "mit-opening"}, {"mit-opening"}, {"isc"}, set(), set(), {"apache", "apache-2.0", "apache-2.0-header"}]
    assert got[3].score <= 0.5 < got[2].score and all(0 <= r.score <= 1 for r in got)


def test_all_places_of_documents(spark):
    docs = [*map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())]
    found = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    some = 0
    for key, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        base = [(i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        joined = "".join(f" {w}" for w in words)
        more = {label for label, t in licenses.TEMPLATES if as_pattern(t).search(joined)}
        r = found[key]
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base})) and r.labels == ",".join(sorted({b for _, b in base} | more))
        some += bool(more)
    assert some


def plain_features(text):
    raw = list((text or "").encode())
    words, word = [], []
    for c in [*raw, 32]:
        if c in (32, 9, 10, 11, 12, 13):
            if word:
                words.append(tuple(word))
            word = []
        else:
            word.append(c)
    n, size = len(words), len(raw)
    if not n:
        return [0.0] * len(quality.FEATURES)
    of = lambda chars: sum(chr(c) in chars for c in raw)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    lines, line = [], []
    for c in [*raw, 10]:
        if c == 10:
            lines.append(tuple(line))
            line = []
        else:
            line.append(c)
    follow = [(words[i], words[i + 1]) for i in range(n - 1)]
    entropy = -sum(raw.count(c) / size * math.log2(raw.count(c) / size) for c in set(raw))
    return [
        math.log(1 + n), (size - n) / n, len(set(words)) / n, sum(a == b for a, b in follow) / n, len(set(follow)) / n, upper / max(1, upper + lower), of("0123456789") / size, of("#$%&*<>") / n,
        of("!") / n, of("|") / n, of(",.:;?") / n, sum(c >= 128 for c in raw) / size, len(lines) / n, 1 - len(set(lines)) / len(lines), entropy, sum(len(w) > 20 for w in words) / n,
    ]


def test_features_and_scores(spark):
    docs = [*map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60).collect()), (901, None), (902, ""), (903, " \n\t"), (904, "a\x0bb\x1cc d | !!! 12% Ä\n\nÄ\n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for _, text in docs:
        assert np.allclose(quality.features(text), plain_features(text))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    got = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    for key, text in docs:
        x, total = plain_features(text), model.base
        at = [sum(c <= v + 1e-12 * max(1, abs(v)) for c in cuts) for v, cuts in zip(x, model.cuts)]
        total += sum(t[k] for t, k in zip(model.tables, at))
        total += sum(t[model.coarse[i][at[i]], model.coarse[j][at[j]]] for (i, j), t in zip(model.pairs, model.pair_tables))
        assert abs(got[key].score - 1 / (1 + math.exp(-total))) < 1e-6 and got[key].predicted == int(got[key].score >= 0.3)


def test_labels_of_held_out_rows_are_never_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert a.base == b.base and all((s == t).all() for s, t in zip(a.tables + a.pair_tables, b.tables + b.pair_tables))


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"word{k}" for k in range(300))
    near, other, third = text.replace("word7 ", "word7  "), " ".join(f"other{k}" for k in range(300)), " ".join(f"third{k}" for k in range(300))
    rows = [(3, text, "a"), (1, near, "b"), (1, near, "c"), (1, other, "d"), (2, other, "e"), (None, text, "f"), (None, third, "g"), (None, third, "h"), (None, third + " ", "i"), (5, None, "j"), (4, "", "k"), (None, None, "l"), (6, "alone here", "m")]
    got = sorted((r.doc_id or 0, r.text or "") for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, _n string")).collect())
    assert len(got) == 5 and (0, third) in got or (0, third + " ") in got
    assert {(1, near), (1, other), (4, ""), (6, "alone here")} <= set(got)
    assert simhash.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pieces_alike_do_not_meet(spark):
    rows = [(None, "")] * 3000 + [(1, "word " * 9000)] * 3
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), group_pieces=200).toPandas()
    assert len(got) == 3000 + 3 * -(-got["doc_tokens"].max() // 2048)
    assert got.groupby(got["sequence_id"] // (1 << 32)).size().max() < 400
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 2048


def test_mix_of_alike_rows_agrees(spark):
    rows = [(None, f"{'a b c ' * 10} {k}", "s" if k % 2 else None) for k in range(900)] + [(7, None, "t"), (7, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (sorted((r.text or "", r.taken) for r in mixing.mix_sources(d, carry=["text"]).collect()) for d in (df, df.repartition(7)))
    assert first == again and mixing.mix_sources(df).count() == 902
