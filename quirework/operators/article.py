"""A translated document as the body of an article: elements by type, with what a reader needs to
check them, a list around the references, figures and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html, persian_digits, strip
from .windows import running_number

# Elements and their classes, badges and the banner.
HEADING, PARAGRAPH, CAPTION = ("h2", "section-heading"), ("p", "article-paragraph"), ("p", "figure-caption standalone-caption")
LIST_OPEN, LIST_CLOSE = '<section class="references-section"><ol class="references-list">', "</ol></section>"
BADGE_UNTRANSLATED = '<span class="block-badge badge-untranslated">ترجمه نشد — متن اصلی نمایش داده می‌شود</span>'
BADGE_NUMERIC = '<span class="block-badge badge-numeric">بررسی عددی: '
REFERENCE_WORDS = ("مرجع", "منابع")
BANNER = ("  <strong>هشدار:</strong> ", " از ", " بلوک متنی ترجمه نشد و به زبان اصلی باقی مانده است.")
BANNER_OPEN = '  <div class="report-detail">ترجمه پس از چند خطای پیاپی متوقف شد (احتمالاً سرویس ترجمه در دسترس نبوده است).</div>'
BANNER_NUMERIC = ('  <div class="report-detail">', " بلوک اختلاف عددی/واحدی با متن مبدأ دارد و برای بازبینی دستی علامت‌گذاری شده است.</div>")
FIGURE_WORD = "شکل "


def _text(*parts) -> Column:
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def element(kind: tuple[str, str], id_: Column, inside: Column, failed: Column) -> Column:
    """An element with its class; one that was not translated says so."""
    tag, name = kind
    flag = F.when(failed, 'data-untranslated="1" class="untranslated ').otherwise('class="')
    return _text(f"<{tag} ", flag, f'{name}" id="', id_, '">', inside, f"</{tag}>")


def with_notes(html: Column, original: Column, shown: Column, failed: Column, warnings: Column, bilingual: bool) -> Column:
    """html, next to its original where both are wanted and differ, and badges for what to check."""
    badges = _text(F.when(failed, BADGE_UNTRANSLATED), F.array_join(F.transform(warnings, lambda w: _text(BADGE_NUMERIC, escape_html(w), "</span>")), ""))
    both = _text('<div class="bilingual-block">', html, '<div class="bi-original" dir="ltr" lang="en">', escape_html(original), "</div></div>")
    differ = (strip(original) != "") & (strip(original) != strip(F.coalesce(shown, F.lit(""))))
    return _text(F.when(differ, both).otherwise(html) if bilingual else html, badges)


def figure(id_: Column, number: Column, sources: Column, caption: Column) -> Column:
    images = F.array_join(F.transform(F.filter(sources, lambda s: s != ""), lambda s: _text('<img src="', s, f'" alt="{FIGURE_WORD}', F.coalesce(number, F.lit(1)).cast("string"), '" class="figure-img" loading="lazy" />')), "")
    said = F.when(F.coalesce(caption, F.lit("")) != "", _text('<figcaption class="figure-caption">', caption, "</figcaption>"))
    return _text('<figure class="article-figure" id="', id_, '"><div class="figure-image-wrapper">', images, "</div>", said, "</figure>")


def table(id_: Column, rows: Column, plain: Column) -> Column:
    """rows of marked cells, the first the header; without rows the block's own text."""
    cells = lambda row, tag, end: F.array_join(F.transform(row, lambda c: _text(f"<{tag}>", c, f"</{end}>")), "")
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), lambda r: _text("<tr>", cells(r, "td", "td"), "</tr>")), "")
    grid = _text('<table class="data-table"><thead><tr>', cells(F.get(rows, 0), 'th scope="col"', "th"), "</tr></thead><tbody>", body, "</tbody></table>")
    inside = F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, grid).otherwise(_text('<pre class="table-content">', plain, "</pre>"))
    return _text('<div class="table-container" id="', id_, '">', inside, "</div>")


def article_bodies(blocks: DataFrame, bilingual: bool = False) -> DataFrame:
    """doc_id and html of blocks(doc_id, ord, id, type, content, translated, markup, failed, warnings, ref_number,
    figure_id, figure_num, sources, caption_markup, rows_markup); markup is what is shown, with
    its terms marked.

    Titles, authors and others are no part of the body, nor are captions that stand with their
    figure, nor blocks without text but figures. References are numbered by their number, else
    one more than the last. A heading that names them, or the first reference, opens a list;
    headings, paragraphs and figures close it. All windows go by document.
    """
    c = F.col
    shown = F.when(F.coalesce("translated", F.lit("")) != "", c("translated")).otherwise(F.coalesce("content", F.lit("")))
    b = blocks.withColumn("_shown", shown).where((c("type") == "figure") | (c("_shown") != ""))
    ref = c("type") == "reference"
    b = running_number(b.withColumn("_ref", ref), ["doc_id", "_ref"], ["ord"], F.when(ref & (c("ref_number") != 0), c("ref_number")))
    names = reduce(Column.__or__, [c("_shown").contains(w) for w in REFERENCE_WORDS]) | F.lower(F.coalesce("content", F.lit(""))).contains("reference")
    event = F.when(c("type") == "heading", names).when(c("type").isin("paragraph", "figure"), F.lit(False)).when(ref, F.lit(True))
    w = Window.partitionBy("doc_id").orderBy("ord")
    b = b.withColumn("_event", event).withColumn("_open", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    failed, warnings = F.coalesce("failed", F.lit(False)), F.coalesce("warnings", F.array().cast("array<string>"))
    noted = lambda kind: with_notes(element(kind, c("id"), c("markup"), failed), F.coalesce("content", F.lit("")), c("_shown"), failed, warnings, bilingual)
    item = _text('<li class="reference-item" id="', c("id"), '"><span class="ref-number" dir="ltr">[', c("number").cast("string"), "]</span> ", c("markup"), "</li>")
    part = (
        F.when(c("type") == "heading", noted(HEADING))
        .when(c("type") == "paragraph", noted(PARAGRAPH))
        .when(c("type") == "figure", figure(c("id"), c("figure_num"), c("sources"), c("caption_markup")))
        .when((c("type") == "figure_caption") & c("figure_id").isNull(), noted(CAPTION))
        .when(ref, _text(F.when(~c("_open"), LIST_OPEN), item))
        .when(c("type") == "table", table(c("id"), c("rows_markup"), c("markup")))
    )
    close, opens = F.when(c("_open") & c("type").isin("heading", "paragraph", "figure"), LIST_CLOSE), F.when((c("type") == "heading") & c("_event"), LIST_OPEN)
    parts = F.filter(F.array(close, part, opens), lambda x: x.isNotNull())
    got = b.withColumn("_parts", parts).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "_parts"))).alias("p"), F.max(F.when(c("_event").isNotNull(), F.struct("ord", "_event"))).alias("e"))
    lines = F.flatten(F.transform("p", lambda x: x["_parts"]))
    return got.select("doc_id", F.array_join(F.when(c("e._event"), F.concat(lines, F.array(F.lit(LIST_CLOSE)))).otherwise(lines), "\n").alias("html"))


def report_banner(report: DataFrame) -> DataFrame:
    """report with banner: what was not translated, in Persian digits; empty if nothing."""
    left = F.col("failed") + F.col("skipped")
    number = lambda x: persian_digits(x.cast("string"))
    lines = F.array(
        F.lit('<div class="report-banner report-banner-warn">'),
        _text(BANNER[0], number(left), BANNER[1], number(F.col("total")), BANNER[2]),
        F.when(F.col("breaker_open"), BANNER_OPEN),
        F.when(F.col("with_warnings") > 0, _text(BANNER_NUMERIC[0], number(F.col("with_warnings")), BANNER_NUMERIC[1])),
        F.lit("</div>"),
    )
    return report.withColumn("banner", F.when(left > 0, F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")).otherwise(""))
