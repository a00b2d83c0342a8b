"""Each stage and operator does its whole job: what a cheaper version would leave out."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from quirework.llm import vectors

SF = "/root/testdata/sf0.001"


def test_mix_takes_whole_documents(spark):
    text = "\n".join("line %d of a text" % i for i in range(20))
    rows = [(i, f"{i}\n{text}", "en", f"s{i % 2}", None) for i in range(400)]
    got = corpus_pipeline.mix(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(r.text == texts[r.doc_id] and r.n_chars == len(r.text) for r in got)
    # s0 (weight 5) stands twice, s1 (weight 2) gets the rest of 1.5 times all words.
    assert set(Counter(r.doc_id for r in got if r.source == "s0").values()) == {2}
    taken = Counter(r.source for r in got)
    shards = 20
    assert taken["s0"] == 400 and abs(taken["s1"] - 200) <= shards


@pytest.mark.parametrize("threshold", [0.9, 0.75])
def test_no_link_is_lost_between_cells(spark, monkeypatch, threshold):
    monkeypatch.setattr(vectors, "CELL", 32)
    x = np.random.default_rng(4).normal(size=(1500, 8))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= threshold
    np.fill_diagonal(hit, False)
    got = vectors.dedup_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), threshold=threshold)
    n = dict(got.select("vec_id", "n_links").collect())
    assert [n[i] for i in range(len(x))] == hit.sum(1).tolist()
