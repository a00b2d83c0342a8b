"""Article bodies, banners and text layers against plain versions."""

import html
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirework.operators import article, term_pairs
from quirework.plans import articles, catalog
from quirework.sources import spans

SF = "/root/testdata/sf0.001"


def plain_body(rows):
    out, inside, number = [], False, 1
    for r in rows:
        shown = r["translated"] or r["content"]
        if not shown and r["type"] != "figure":
            continue
        mark = term_pairs.marked(shown)
        flag = 'data-untranslated="1" class="untranslated ' if r["failed"] else 'class="'

        def noted(tag, name):
            one = f'<{tag} {flag}{name}" id="{r["id"]}">{mark}</{tag}>'
            if r["content"].strip() and r["content"].strip() != shown.strip():
                one = f'<div class="bilingual-block">{one}<div class="bi-original" dir="ltr" lang="en">{html.escape(r["content"])}</div></div>'
            return one + (article.BADGE_UNTRANSLATED if r["failed"] else "") + "".join(f"{article.BADGE_NUMERIC}{html.escape(w)}</span>" for w in r["warnings"] or [])

        if r["type"] in ("heading", "paragraph", "figure") and inside:
            out.append("</ol></section>")
            inside = False
        if r["type"] == "heading":
            out.append(noted("h2", "section-heading"))
            if "مرجع" in shown or "منابع" in shown or "reference" in r["content"].lower():
                inside = True
                out.append(article.LIST_OPEN)
        elif r["type"] == "paragraph":
            out.append(noted("p", "article-paragraph"))
        elif r["type"] == "figure":
            images = "".join(f'<img src="{s}" alt="شکل {1 if r["figure_num"] is None else r["figure_num"]}" class="figure-img" loading="lazy" />' for s in r["sources"] if s)
            said = f'<figcaption class="figure-caption">{r["caption_markup"]}</figcaption>' if r["caption_markup"] else ""
            out.append(f'<figure class="article-figure" id="{r["id"]}"><div class="figure-image-wrapper">{images}</div>{said}</figure>')
        elif r["type"] == "figure_caption" and not r["figure_id"]:
            out.append(noted("p", "figure-caption standalone-caption"))
        elif r["type"] == "reference":
            n = r["ref_number"] or number
            number = n + 1
            item = f'<li class="reference-item" id="{r["id"]}"><span class="ref-number" dir="ltr">[{n}]</span> {mark}</li>'
            out.append(item if inside else article.LIST_OPEN + item)
            inside = True
        elif r["type"] == "table":
            if r["rows_markup"]:
                head, *rest = r["rows_markup"]
                grid = '<table class="data-table"><thead><tr>' + "".join(f'<th scope="col">{c}</th>' for c in head) + "</tr></thead><tbody>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in x) + "</tr>" for x in rest) + "</tbody></table>"
            else:
                grid = f'<pre class="table-content">{mark}</pre>'
            out.append(f'<div class="table-container" id="{r["id"]}">{grid}</div>')
    return "\n".join(out + ["</ol></section>"] * inside)


def test_article_bodies(spark):
    docs = defaultdict(list)
    for r in articles.article_blocks(catalog.blocks(spark, SF)).collect():
        docs[r.doc_id].append(r.asDict())
    got = {r.doc_id: r.html for r in catalog.QUERIES["article_bodies"](spark, SF).collect()}
    assert len(got) == len(docs)
    for key, rows in docs.items():
        assert got[key] == plain_body(sorted(rows, key=lambda r: r["ord"]))
    assert any("bi-original" in x and "reference-item" in x and "badge-numeric" in x and "figure-img" in x for x in got.values())


def test_banners(spark):
    rows = [(1, 12, 2, 1, True, 3), (2, 5, 0, 0, False, 1), (3, 7, 0, 4, False, 0)]
    df = spark.createDataFrame(rows, "doc_id long, total long, failed long, skipped long, breaker_open boolean, with_warnings long")
    got = {r.doc_id: r.banner.split("\n") for r in article.report_banner(df).collect()}
    assert got[2] == [""] and len(got[1]) == 5 and len(got[3]) == 3
    assert got[1][1] == "  <strong>هشدار:</strong> ۳ از ۱۲ بلوک متنی ترجمه نشد و به زبان اصلی باقی مانده است." and "۳ بلوک" in got[1][3]
    whole = catalog.QUERIES["report_banners"](spark, SF).collect()
    assert any(r.banner for r in whole) and not all(r.banner for r in whole)


def span(text, size=9.0, flags=0, font="Times"):
    return (text, size, flags, font)


def test_text_blocks_and_body_sizes(spark):
    rows = [
        (1, 1, 0, [(0.0, [span("The pop­"), span("")]), (0.0, [span("ulation was re-")]), (None, [span("  treated", 12.25, 0, "Arial-SemiBold")])]),
        (1, 1, 1, [(0.0, [span("­")])]),
        (1, 1, 2, [(0.0, [])]),
        (1, 1, 3, [(0.9, [span("side ways", 20.0, 18)])]),
        (1, 2, 0, [(0.0, [span("i7", 30.0)])]),
        (1, 6, 0, [(0.0, [span("late " * 50, 40.0)])]),
        (2, 1, 0, [(0.0, [span("abc")])]),
    ]
    raw = spark.createDataFrame([(*r, 0.0, 0.0, 1.0, 1.0, 800.0) for r in rows], f"doc_id long, page_number int, block_no int, lines {spans.LINES}, x0 double, y0 double, x1 double, y1 double, page_height double")
    got = [(r.doc_id, r.ord, r.id, r.content, r.font_size, r.is_bold, r.char_count, r.rotated) for r in spans.text_blocks(raw).orderBy("doc_id", "ord").collect()]
    assert got == [
        (1, 0, "p1_b1", "The population was retreated", 12.25, True, 30, False),
        (1, 1, "p1_b2", "side ways", 20.0, True, 9, True),
        (1, 2, "p2_b1", "i7", 30.0, False, 2, False),
        (1, 3, "p6_b1", ("late " * 50).strip(), 40.0, False, 249, False),
        (2, 0, "p1_b1", "abc", 9.0, False, 3, False),
    ]
    assert dict(map(tuple, spans.body_sizes(raw).collect())) == {1: 9.0, 2: 10.0}
    assert dict(map(tuple, spans.body_sizes(raw, None).collect())) == {1: 40.0, 2: 10.0}
    kinds = [r.type for r in spans.classified(raw).orderBy("doc_id", "ord").collect()]
    assert kinds[1] == "other" and len(kinds) == 5
