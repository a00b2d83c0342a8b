"""Text blocks from what a page's text layer holds: blocks of lines of spans, as nested arrays.

raw(doc_id, page_number, block_no, lines, x0, y0, x1, y1, page_height) with lines an
array of (dir_y, spans), spans an array of (text, size, flags, font). Everything is read off
the arrays in place; nothing is exploded but the spans' sizes, which are summed by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import any_contains, block_type
from ..functions.text import join_lines, normalise_text, strip

LINES = "array<struct<dir_y:double,spans:array<struct<text:string,size:double,flags:int,font:string>>>>"
# The flag and the names of bold type, the slope of turned lines, the default size.
BOLD_FLAG, BOLD_NAMES, TURNED, BODY_SIZE = 16, ("bold", "black", "heavy", "semibold", "demibold"), 0.3, 10.0
LETTERS = r"[^A-Za-z0-9؀-ۿ]"


def _spans(lines: Column) -> Column:
    """All spans that hold text."""
    return F.filter(F.flatten(F.transform(lines, lambda x: x["spans"])), lambda s: s["text"] != "")


def text_blocks(raw: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, id, content, font_size (the largest), is_bold (any), char_count, rotated and the
    box of every block with two letters or digits; ids and ord number the blocks that stay."""
    line = lambda x: normalise_text(F.array_join(F.transform(F.filter(x["spans"], lambda s: s["text"] != ""), lambda s: s["text"]), ""))
    bold = lambda s: (s["flags"].bitwiseAND(F.lit(BOLD_FLAG)) != 0) | any_contains(F.lower(s["font"]), BOLD_NAMES)
    spans = _spans(F.col("lines"))
    b = raw.withColumns(
        {
            "content": join_lines(F.filter(F.transform("lines", line), lambda x: x != "")),
            "font_size": F.coalesce(F.array_max(F.transform(spans, lambda s: s["size"])), F.lit(0.0)),
            "is_bold": F.exists(spans, lambda s: F.coalesce(bold(s), F.lit(False))),
            "char_count": F.aggregate(spans, F.lit(0), lambda n, s: n + F.length(strip(s["text"]))),
            "rotated": F.exists("lines", lambda x: F.coalesce(F.abs(x["dir_y"]) > TURNED, F.lit(False))),
        }
    )
    b = b.where(F.length(F.regexp_replace("content", LETTERS, "")) >= 2)
    page = Window.partitionBy("doc_id", "page_number").orderBy("block_no")
    n = F.row_number().over(page)
    b = b.withColumn("id", F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit("_b"), n.cast("string")))
    b = b.withColumn("ord", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "block_no")) - 1).cast("int"))
    return b.select("doc_id", "page_number", "ord", "id", "content", "font_size", "is_bold", "char_count", "rotated", "x0", "y0", "x1", "y1", "page_height")


def body_sizes(raw: DataFrame, pages: int | None = 5) -> DataFrame:
    """doc_id and body_size: the size, rounded half to even to a tenth, that most characters of the
    first pages have, of equal ones the first seen; 10 where no span has four characters."""
    used = raw if pages is None else raw.where(F.col("page_number") <= pages)
    x = used.select("doc_id", "page_number", "block_no", F.posexplode("lines").alias("line", "l")).select("doc_id", "page_number", "block_no", "line", F.posexplode("l.spans").alias("at", "s"))
    n = F.length(strip(F.col("s.text")))
    sums = x.where(n > 3).groupBy("doc_id", F.bround("s.size", 1).alias("size")).agg(F.sum(n).alias("n"), F.min(F.struct("page_number", "block_no", "line", "at")).alias("first"))
    # The most characters, then the first place: the smallest of (-n, place).
    best = sums.groupBy("doc_id").agg(F.min_by("size", F.struct(-F.col("n"), "first")).alias("body_size"))
    return raw.select("doc_id").distinct().join(best, "doc_id", "left").fillna(BODY_SIZE, ["body_size"])


def classified(raw: DataFrame) -> DataFrame:
    """text_blocks with their type, judged by the document's body size."""
    b = text_blocks(raw).join(body_sizes(raw), "doc_id")
    c = F.col
    return b.withColumn("type", block_type(c("content"), c("font_size"), c("body_size"), c("is_bold"), c("page_number"), c("y0"), c("y1"), c("page_height"), c("rotated"))).drop("body_size")
