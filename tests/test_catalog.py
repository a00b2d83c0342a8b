import __spark_entry__
import numpy as np
import oracle
import pytest
from pyspark.sql import functions as F

from quirework.functions import predicates, text
from quirework.operators import grouped, layout, verify, windows
from quirework.plans import catalog

SF = "/root/testdata/sf0.001"
EMPTY_HERE = {"running_header_filter"}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    assert oracle.differs(spark, catalog.QUERIES[name], catalog.SQL[name], SF) in ("", *(["no rows"] if name in EMPTY_HERE else []))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("lines", "joined"), [(["re-", "gion"], "region"), (["the pop\ue000", "ulation"], "the population"), (["three-\ue000", "dimensional"], "three-dimensional"), (["a", "b"], "a b"), ([], "")])
def test_join_lines(spark, lines, joined):
    array = F.array(*map(F.lit, lines)).cast("array<string>")
    assert one(spark, text.join_lines(array)) == joined


def test_text(spark):
    assert one(spark, text.normalise_text(F.lit(" a\u200bb\u00a0c \t d\u00ad"))) == "ab c d\ue000"
    assert one(spark, text.term_key(F.lit(" Crown-root   Fractures "))) == "crown-root fracture"
    assert one(spark, text.term_key(F.lit("glass"))) == "glass"
    assert one(spark, text.fold_digits(F.lit("۱۲"))) == "12"
    assert one(spark, text.collapse_repeats(F.lit("abcdefghij klmnopqrst abcdefghij klmnopqrst end"))) == "abcdefghij klmnopqrst end"
    assert one(spark, predicates.front_matter(F.lit("Received: 1 May | Accepted: 2 June")))
    assert not one(spark, predicates.front_matter(F.lit("The patient was recalled after 3 months.")))


def test_units(spark):
    df = spark.createDataFrame([(1, "A 3 mm gap, 5 mg/dL")], "id long, s string")
    assert {r["token"] for r in verify.tokens(df, "id", "s", verify.units_pattern()).collect()} == {"A", "mm", "mg/dL"}


def test_breaker_and_report(spark):
    calls = spark.createDataFrame([(1, i, True) for i in range(20)] + [(2, i, i < 2) for i in range(8)], "k long, i long, bad boolean")
    out = {r["k"]: r for r in verify.run_report(windows.circuit_breaker(calls, ["k"], ["i"], F.col("bad"), 3), "k").collect()}
    assert (out[1].failed, out[1].skipped, out[1].done) == (3, 17, 0)
    assert (out[2].failed, out[2].skipped, out[2].done) == (2, 0, 6)


BLOCK = "doc_id long, page_number int, ord int, id string, content string, type string, x0 int, y0 int, x1 int, y1 int, font_size int"


def test_reading_order(spark):
    b = [(1, 1, k, i, "x", "paragraph", *box, 9) for k, (i, box) in enumerate([("c2_b1", (320, 150, 550, 250)), ("c1_b2", (50, 260, 280, 360)), ("head", (50, 50, 550, 100)), ("c1_b1", (50, 150, 280, 250)), ("c2_b2", (320, 260, 550, 360))])]
    got = layout.reading_order(spark.createDataFrame(b, BLOCK)).orderBy("reading_ord").collect()
    assert [r["id"] for r in got] == ["head", "c1_b1", "c1_b2", "c2_b1", "c2_b2"]


@pytest.mark.parametrize(("lines", "blocks"), [(["The use of resin", "composite restorations is increasing,", "owing to improvements."], 1), (["The cavity was prepared.", "Then it was applied."], 2)])
def test_reflow(spark, lines, blocks):
    b = [(1, 1, k, str(k), c, "paragraph", 27, 31 + 40 * k, 550, 61 + 40 * k, 25) for k, c in enumerate(lines)]
    assert grouped.reflow(spark.createDataFrame(b, BLOCK)).count() == blocks


def test_overlapping_images(spark):
    rng = np.random.default_rng(3)
    x, y, w, h = (rng.integers(lo, hi, 120).astype(float).tolist() for lo, hi in ((0, 60), (0, 60), (20, 60), (20, 60)))
    rows = [(1, int(i % 3), i, x[i], y[i], x[i] + w[i], y[i] + h[i]) for i in range(120)]
    got = grouped.drop_overlapping(spark.createDataFrame(rows, "doc_id long, page_number int, ord int, x0 double, y0 double, x1 double, y1 double"))
    kept = []
    for r in rows:
        def common(k, r=r):
            return max(0, min(r[5], k[5]) - max(r[3], k[3])) * max(0, min(r[6], k[6]) - max(r[4], k[4]))

        area = lambda k: (k[5] - k[3]) * (k[6] - k[4])
        if all(k[1] != r[1] or common(k) <= 0.8 * min(area(k), area(r)) for k in kept):
            kept.append(r)
    assert sorted(r.ord for r in got.collect()) == [r[2] for r in kept] and len(kept) < 120


@pytest.mark.parametrize(("k", "kind"), [(0, "other"), (1, "other"), (2, "title"), (3, "figure_caption"), (4, "other"), (5, "heading"), (6, "heading"), (7, "heading"), (10, "author"), (11, "author"), (12, "paragraph"), (13, "heading"), (14, "reference"), (15, "reference"), (16, "paragraph")])
def test_block_types(spark, k, kind):
    assert catalog.QUERIES["block_classifier_samples"](spark, SF).where(f"k = {k}").first().block_type == kind


def test_post_process(spark):
    twice = "a line of over twenty letters"
    assert one(spark, text.post_process(F.lit(f" {twice}  {twice}\n x"), F.lit("paragraph"))) == f"{twice} x"
    assert one(spark, text.post_process(F.lit("a  b\n c"), F.lit("table"))) == "a b\n c"
