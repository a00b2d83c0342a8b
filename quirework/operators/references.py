"""Bibliographies: texts cut into numbered entries, and entries put together again over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as p
from ..functions.text import join_lines, strip

CUT = "\x01"


def split_entries(text: Column) -> Column:
    """Array of (number int, body): what stands before the first marker is an entry without a
    number; a text without markers gives an empty array, empty bodies stay out."""
    parts = F.split(F.regexp_replace(text, P.REFERENCE_SPLIT, CUT + "$0" + CUT), CUT)
    number = lambda k: F.regexp_extract(F.get(parts, k), r"(\d+)", 1).try_cast("int")
    entries = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 2).cast("int")), lambda i: F.struct(F.when(i > 0, number(2 * i - 1)).alias("number"), strip(F.get(parts, 2 * i)).alias("body")))
    none = F.array().cast("array<struct<number:int,body:string>>")
    return F.when(F.size(parts) > 1, F.filter(entries, lambda e: e["body"] != "")).otherwise(none)


def entries_of_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks exploded to entries: adds position, ref_number and entry; blocks without a marker
    are one entry without a number. Of the second entry and later ones the id gets a suffix."""
    found = split_entries(F.col("content"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("number"), strip(F.col("content")).alias("body")))
    x = blocks.withColumn("_marked", F.size(found) > 0).select("*", F.posexplode(F.when(F.size(found) > 0, found).otherwise(whole)).alias("position", "_e"))
    id_ = F.when(F.col("position") > 0, F.concat("id", F.lit("_ref"), (F.col("position") + 1).cast("string"))).otherwise(F.col("id"))
    return x.withColumns({"id": id_, "ref_number": F.col("_e.number"), "entry": F.col("_e.body"), "marked": F.col("_marked")}).drop("_e", "_marked")


def bibliography(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, id, ref_number, entry: the entries of each document's section of
    references, in order.

    A heading that names the section opens it, one of another known section closes it. A
    text without a marker goes on the entry before it if it starts small or that entry has no
    end; headings that open, figures, captions and tables come between. Windows and the
    aggregate share the partitioning by document.
    """
    w = Window.partitionBy("doc_id").orderBy("ord")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("type") == "heading"
    opens = head & p.any_matches(F.col("content"), P.REFERENCE_SECTION)
    closes = head & p.any_matches(F.col("content"), P.OTHER_SECTION)
    b = blocks.withColumn("_event", F.when(opens, "opens").when(closes, "closes"))
    b = b.withColumn("_in", F.last(F.col("_event") == "opens", ignorenulls=True).over(so_far)).where("_in")
    b = b.withColumn("_bar", F.col("_event").isNotNull() | F.col("type").isin("figure", "figure_caption", "table"))
    x = entries_of_blocks(b.withColumn("content", F.when(F.col("_bar"), "").otherwise(F.col("content"))))
    in_order = Window.partitionBy("doc_id").orderBy("ord", "position")
    on = ~F.col("marked") & ~F.lag("_bar", 1, True).over(in_order) & p.goes_on(F.col("entry"), F.lag("entry").over(in_order))
    x = x.withColumn("_on", F.coalesce(on, F.lit(False)) & ~F.col("_bar"))
    x = x.withColumn("_entry", F.sum((~F.col("_on")).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).where("not _bar")
    first = F.min(F.struct("ord", "position", "page_number", "id", "ref_number")).alias("f")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "position", "entry"))), lambda e: e["entry"])
    out = x.groupBy("doc_id", "_entry").agg(first, join_lines(parts).alias("entry"))
    return out.select("doc_id", "f.page_number", "f.ord", "f.id", "f.ref_number", "entry")
