"""Blocks derived from text tables, for pages without a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines on a page.
PAGE = 20


def blocks_from_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One block for each line that is not blank, with a place and a type made from the line.

    Order, page, and geometry are arithmetic on the line's number: long lines span the page
    (600 x 800), others alternate between two columns. The types are carriers for the
    operators: short lines are headings, and a fixed rule deals out references and tables.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("ord", "content")).where(F.trim("content") != "")
    n = F.length("content")
    wide = n >= 200
    left = F.pmod("ord", F.lit(2)) == 0
    row = F.pmod("ord", F.lit(PAGE))
    return lines.select(
        "doc_id",
        (F.floor(F.col("ord") / PAGE) + 1).cast("int").alias("page_number"),
        "ord",
        F.concat(F.lit("p"), (F.floor(F.col("ord") / PAGE) + 1).cast("string"), F.lit("_b"), row.cast("string")).alias("id"),
        "content",
        F.when(n < 25, "heading").when(F.pmod(F.col("ord") + F.col("doc_id"), F.lit(5)) < 2, "reference").when(F.pmod(F.col("ord") * 3 + F.col("doc_id"), F.lit(11)) == 4, "table").otherwise("paragraph").alias("type"),
        F.when(wide | left, 50).otherwise(320).alias("x0"),
        (40 + 36 * row).alias("y0"),
        F.when(wide, 550).when(left, 280).otherwise(550).alias("x1"),
        (40 + 36 * row + F.least(F.lit(70), F.lit(12) + F.floor(n / 10).cast("int"))).alias("y1"),
        (8 + F.pmod(n, F.lit(5))).alias("font_size"),
    )
