"""Documents as HTML bodies: fragments of blocks, with a list around the references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import escape_html

OPEN, CLOSE = '<section class="references"><ol>', "</ol></section>"


def fragment(kind: Column, content: Column, id_: Column) -> Column:
    """One block by itself; titles, authors and others have no place in the body."""
    text, name = escape_html(content), escape_html(id_)

    def tag(t: str) -> Column:
        return F.concat(F.lit(f'<{t} id="'), name, F.lit('">'), text, F.lit(f"</{t}>"))

    cases = F.when(kind == "heading", tag("h2")).when(kind == "paragraph", tag("p")).when(kind == "reference", tag("li")).when(kind == "table", tag("pre")).when(kind == "figure_caption", tag("figcaption"))
    return cases.otherwise("")


def html_bodies(blocks: DataFrame, opens: Column) -> DataFrame:
    """doc_id and html: the blocks' fragments in order.

    A heading for which opens holds starts a list, and any heading or paragraph ends the one
    that is open; other blocks leave it as it is. A list open at the end is closed there. The
    window and the aggregate share one partitioning by document. Empty blocks are left out.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    event = F.when(F.col("type") == "heading", opens).when(F.col("type") == "paragraph", F.lit(False))
    b = blocks.where(F.coalesce(F.col("content"), F.lit("")) != "").withColumn("_event", event)
    b = b.withColumn("_before", F.coalesce(F.last("_event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    part = F.concat(
        F.when(F.col("_before") & F.col("_event").isNotNull(), CLOSE).otherwise(""),
        fragment(F.col("type"), F.col("content"), F.col("id")),
        F.when(F.col("_event"), OPEN).otherwise(""),
    )
    got = b.withColumn("_part", part).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "_part"))).alias("p"), F.max(F.when(F.col("_event").isNotNull(), F.struct("ord", "_event"))).alias("e"))
    body = F.array_join(F.transform("p", lambda x: x["_part"]), "\n")
    return got.select("doc_id", F.concat(body, F.when(F.col("e._event"), CLOSE).otherwise("")).alias("html"))


def html_document(title: Column, body: Column, notes: Column) -> Column:
    """A whole page: its title, the body, and notes (JSON that may stand in a script)."""
    name = escape_html(F.coalesce(title, F.lit("")))
    return F.concat(
        F.lit('<!DOCTYPE html>\n<html lang="fa" dir="rtl">\n<head><meta charset="utf-8"><title>'), name, F.lit("</title></head>\n<body>\n<header><h1>"), name,
        F.lit("</h1></header>\n<main>\n"), body, F.lit('\n</main>\n<script type="application/json" id="notes">'), notes, F.lit("</script>\n</body>\n</html>"),
    )
