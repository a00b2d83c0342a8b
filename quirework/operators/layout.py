"""Reading order and spatial operators. Every join keeps the equality on document and page,
so ranges are residual conditions of a hash join and never a product of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_WIDTH, FULL = 600, 0.60


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds reading_ord: bands between full-width blocks, in a band the left column first if both
    are there, else by height. Blocks of type other are left out; ties keep the input order."""
    page = ["doc_id", "page_number"]
    used = blocks.where("type <> 'other'").withColumn("_full", (F.col("x1") - F.col("x0")) >= FULL * PAGE_WIDTH)
    by_y = Window.partitionBy(*page).orderBy("y0", "ord")
    used = used.withColumn("_above", F.coalesce(F.sum(F.col("_full").cast("int")).over(by_y.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    used = used.withColumn("_band", 2 * F.col("_above") + F.col("_full").cast("int"))
    right = ((F.col("x0") + F.col("x1")) / 2 >= PAGE_WIDTH / 2).cast("int")
    band = Window.partitionBy(*page, "_band")
    used = used.withColumn("_side", F.when(F.col("_full"), 0).otherwise(right))
    used = used.withColumn("_side", F.when(F.min("_side").over(band) < F.max("_side").over(band), F.col("_side")).otherwise(0))
    return used.withColumn("reading_ord", F.row_number().over(Window.partitionBy(*page).orderBy("_band", "_side", "y0", "ord"))).drop("_full", "_above", "_band", "_side")


def outside_tables(blocks: DataFrame) -> DataFrame:
    """Blocks whose centre lies in no table of their page."""
    tables = blocks.where("type = 'table'").select(F.col("doc_id").alias("t_doc"), F.col("page_number").alias("t_page"), *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = (F.col("doc_id") == F.col("t_doc")) & (F.col("page_number") == F.col("t_page")) & cx.between(F.col("t_x0"), F.col("t_x1")) & cy.between(F.col("t_y0"), F.col("t_y1"))
    return blocks.where("type <> 'table'").join(tables, inside, "left_anti")


def band_members(blocks: DataFrame, slack: int = 5) -> DataFrame:
    """Each block with the first full-width band, widened by slack, that holds its centre."""
    wide = (F.col("x1") - F.col("x0")) >= FULL * PAGE_WIDTH
    bands = blocks.where(wide).select(F.col("doc_id").alias("b_doc"), F.col("page_number").alias("b_page"), F.col("ord").alias("band_ord"), F.col("y0").alias("top"), F.col("y1").alias("bottom"))
    cy = (F.col("y0") + F.col("y1")) / 2
    near = (F.col("doc_id") == F.col("b_doc")) & (F.col("page_number") == F.col("b_page")) & cy.between(F.col("top") - slack, F.col("bottom") + slack)
    return blocks.where(~wide).join(bands, near).groupBy("doc_id", "page_number", "ord").agg(F.min(F.struct("top", "band_ord"))["band_ord"].alias("band_ord"))


def page_boxes(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("doc_id", "page_number").agg(*[f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def drop_masthead(blocks: DataFrame) -> DataFrame:
    """First pages without the short blocks that end above their largest-type block."""
    first = blocks.where("page_number = 1")
    anchor = first.where("y0 < 400").groupBy("doc_id").agg(F.max(F.struct("font_size", (-F.col("ord")).alias("o"), "y0"))["y0"].alias("top"))
    return first.join(anchor, "doc_id", "left").where(F.col("top").isNull() | (F.col("y1") > F.col("top") + 2) | (F.length("content") >= 300)).drop("top")


def page_breaks(blocks: DataFrame) -> DataFrame:
    """Pairs that go on over a page break: a page's last paragraph that does not end a sentence and
    the next page's first block, if that starts in lower case."""
    last = blocks.where("type = 'paragraph'").groupBy("doc_id", "page_number").agg(F.max(F.struct("ord", "content")).alias("l"))
    first = blocks.where("type not in ('figure', 'figure_caption', 'table')").groupBy("doc_id", "page_number").agg(F.min(F.struct("ord", "content", "type")).alias("f"))
    both = last.join(first.withColumn("page_number", F.col("page_number") - 1), ["doc_id", "page_number"])
    return both.where(~F.col("l.content").rlike(r"[.!?:;»\"]$") & F.col("f.content").rlike(r"^\p{Ll}")).select("doc_id", "page_number", F.col("l.ord").alias("last_ord"), F.col("f.ord").alias("first_ord"))


def absorb_panels(images: DataFrame, primary: Column, height: float = 800.0) -> DataFrame:
    """Images that are panels of a figure, with that figure's ord as primary_ord: of the primary
    images of their page that share 0.4 of the smaller width and are near in height, the first."""
    box = ["x0", "y0", "x1", "y1"]
    figures = images.where(primary).select(F.col("doc_id").alias("f_doc"), F.col("page_number").alias("f_page"), F.col("ord").alias("primary_ord"), *[F.col(c).alias(f"f_{c}") for c in box])
    common = F.least("x1", "f_x1") - F.greatest("x0", "f_x0")
    narrow = F.least(F.col("x1") - F.col("x0"), F.col("f_x1") - F.col("f_x0"))
    gap = F.least(F.abs(F.col("y0") - F.col("f_y1")), F.abs(F.col("f_y0") - F.col("y1")))
    near = (common >= 0.4 * F.when(narrow == 0, 1).otherwise(narrow)) & (gap <= max(120.0, 0.35 * height))
    joined = images.where(~primary).join(figures, (F.col("doc_id") == F.col("f_doc")) & (F.col("page_number") == F.col("f_page")) & near)
    return joined.groupBy("doc_id", "page_number", "ord").agg(F.min("primary_ord").alias("primary_ord"))
