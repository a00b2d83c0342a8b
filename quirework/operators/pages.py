"""Layout over whole pages and documents with real measures: blocks carry page_width and page_height.

What depends on the order in which rows are taken runs as grouped Python on one page, a
bounded group; everything else is windows and aggregates by document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import predicates as p
from ..functions.text import fold_digits, header_key, join_lines, strip
from .grouped import figure_groups
from .windows import section_state

#: Share of a page's width that makes a block full, of its height that is an edge, slack in points.
FULL, EDGE, SLACK = 0.60, 0.09, 5
FLOATS = ("figure", "figure_caption", "table")
BOX = ["x0", "y0", "x1", "y1"]


def order_pages(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, ord, reading_ord. Full blocks, from the top, cut a page into bands;
    a block belongs to the first band that holds its centre, give or take SLACK. In a band the
    left half comes before the right if both have blocks. What lies in no band goes before the
    first block that begins lower. Blocks of type other are left out unless there are no others."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        used = rows[rows["type"] != "other"]
        if used.empty:
            order = rows["ord"].tolist()
        else:
            width, height = float(rows["page_width"].iloc[0]), float(rows["page_height"].iloc[0])
            x0, y0, x1, y1, ords = (used[c].to_numpy(float) for c in (*BOX, "ord"))
            full = np.flatnonzero(x1 - x0 >= FULL * width)
            full = full[np.lexsort((ords[full], y0[full]))]
            above = np.append(0.0, y1[full])
            below = np.append(y0[full], height)
            gap = below > above + np.append(np.full(len(full), SLACK), 0)
            free = np.setdiff1d(np.arange(len(used)), full)
            middle = ((y0 + y1) / 2)[free]
            inside = gap & (middle[:, None] >= above - SLACK) & (middle[:, None] <= below + SLACK)
            placed = inside.any(1)
            band = inside.argmax(1)
            right = ((x0 + x1) / 2)[free] >= width / 2
            sides = {b: len(set(right[placed & (band == b)].tolist())) for b in set(band[placed].tolist())}
            keys = [(2 * k + 1, 0, 0.0, 0.0, int(i)) for k, i in enumerate(full)]
            keys += [(2 * b, int(r and sides[b] > 1), y0[i], ords[i], int(i)) for i, b, r, ok in zip(free.tolist(), band.tolist(), right.tolist(), placed.tolist()) if ok]
            at = [k[-1] for k in sorted(keys)]
            for i in free[~placed].tolist():
                lower = next((k for k, j in enumerate(at) if y0[i] < y0[j]), len(at))
                at.insert(lower, i)
            order = [int(ords[i]) for i in at]
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "page_number": rows["page_number"].iloc[0], "ord": order, "reading_ord": range(1, len(order) + 1)})

    return blocks.groupBy("doc_id", "page_number").applyInPandas(page, "doc_id bigint, page_number int, ord int, reading_ord int")


def _digest(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.hash(key)]


def mark_running_headers(blocks: DataFrame) -> DataFrame:
    """blocks where a text that stands twice or more at a document's page edges is of type other
    wherever it stands; documents of one page stay as they are."""
    text = strip(F.col("content"))
    edge = EDGE * F.col("page_height")
    counted = (F.col("type") != "other") & ((F.col("y1") <= edge) | (F.col("y0") >= F.col("page_height") - edge)) & F.length(text).between(1, 400)
    same = F.count_if(counted).over(Window.partitionBy("doc_id", *_digest(header_key(text))))
    pages = F.max("page_number").over(Window.partitionBy("doc_id"))
    return blocks.withColumn("_n", same).withColumn("type", F.when((pages >= 2) & (F.col("_n") >= 2), "other").otherwise(F.col("type"))).drop("_n")


def drop_above_title(blocks: DataFrame) -> DataFrame:
    """blocks without what stands above the title of page 1: short blocks but for titles, figures,
    captions and tables. Without a title the block of the largest type stands for it; one in
    the lower half of its page, or without a size, drops nothing."""
    w = Window.partitionBy("doc_id")
    first, size = F.col("page_number") == 1, F.coalesce("font_size", F.lit(0.0))
    rank = F.when(F.col("type") == "title", F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("size"), "ord")).when(~F.col("type").isin(*FLOATS), F.struct(F.lit(1).alias("k"), (-size).cast("double").alias("size"), "ord"))
    b = blocks.withColumn("_r", F.when(first, rank))
    b = b.withColumn("_a", F.min(F.when(F.col("_r").isNotNull(), F.struct("_r", "y0"))).over(w))
    trusted = (F.col("_a.y0") < 0.5 * F.col("page_height")) & ((F.col("_a._r.k") == 0) | (F.col("_a._r.size") < 0))
    gone = first & trusted & ~F.col("type").isin("title", *FLOATS) & (F.col("y1") <= F.col("_a.y0") + 2) & (F.length("content") < 300)
    return b.where(~F.coalesce(gone, F.lit(False))).drop("_r", "_a")


def merge_over_pages(blocks: DataFrame) -> DataFrame:
    """blocks where a page's last paragraph that goes on as the next page's first block is one block,
    on the first page; adds merged_page, the page it took its end from.

    Both have one size and one column (or the first reaches down the page), the first ends no
    sentence and the second starts small. A paragraph that was taken cannot go on itself: along
    pages that hold one paragraph each, every other break is closed.
    """
    at = ["doc_id", "page_number"]
    last = F.max(F.when(F.col("type") == "paragraph", F.struct("ord", "content", "font_size", *BOX, "page_height"))).alias("l")
    first = F.min(F.when(~F.col("type").isin(*FLOATS), F.struct("ord", "type", "content", "font_size", *BOX))).alias("f")
    pages = blocks.groupBy(*at).agg(last, first)
    w = Window.partitionBy("doc_id").orderBy("page_number")
    next_page = F.lead("page_number").over(w) == F.col("page_number") + 1
    pages = pages.withColumn("n", F.when(next_page, F.lead("f").over(w)))
    s, t = F.coalesce("l.font_size", F.lit(0.0)), F.coalesce("n.font_size", F.lit(0.0))
    narrow = F.least(F.col("l.x1") - F.col("l.x0"), F.col("n.x1") - F.col("n.x0"))
    shared = F.least("l.x1", "n.x1") - F.greatest("l.x0", "n.x0")
    column = shared / F.when(narrow == 0, 1.0).otherwise(narrow) >= 0.55
    tail = F.regexp_replace("l.content", r"(?U)\s+$", "")
    fits = (F.col("n.type") == "paragraph") & ((s == 0) | (t == 0) | (F.abs(s - t) <= 0.6)) & (column | (F.col("l.y1") >= 0.6 * F.col("l.page_height"))) & (tail != "") & ~tail.rlike(r'[.!?:;،؛»"]$') & F.col("n.content").rlike(r"^\p{Ll}")
    pages = pages.withColumn("fits", F.coalesce(fits, F.lit(False)))
    # A break depends on the one before if its paragraph is what that one would take.
    hangs = (F.col("l.ord") == F.col("f.ord")) & F.coalesce(F.lag(F.col("fits") & F.col("n").isNotNull()).over(w), F.lit(False)) & F.coalesce(F.lag("page_number").over(w) == F.col("page_number") - 1, F.lit(False))
    pages = pages.withColumn("run", F.sum((~F.coalesce(hangs, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("page_number"))
    merges = pages.withColumn("turn", turn).where(F.col("fits") & (F.col("turn") % 2 == 1)).select(*at, F.col("l.ord").alias("ord"), F.col("n.ord").alias("n_ord"), "n")
    out = blocks.join(merges.drop("n_ord"), [*at, "ord"], "left")
    whole = F.when(F.col("n").isNull(), F.col("content")).otherwise(join_lines(F.array("content", "n.content")))
    box = {"content": whole, "x0": F.least("x0", "n.x0"), "x1": F.greatest("x1", "n.x1"), "y1": F.coalesce("n.y1", "y1"), "merged_page": F.when(F.col("n").isNotNull(), F.col("page_number") + 1)}
    taken = merges.select("doc_id", (F.col("page_number") + 1).alias("page_number"), F.col("n_ord").alias("ord"))
    return out.withColumns(box).drop("n").join(taken, [*at, "ord"], "left_anti")


def reference_runs(blocks: DataFrame) -> DataFrame:
    """Adds in_run: references in a run of two or more on their page, and those after a heading that
    names the bibliography and before any other heading."""
    so_far = Window.partitionBy("doc_id", "page_number").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    ref, head = F.col("type") == "reference", F.col("type") == "heading"
    opens = head & p.any_matches(F.col("content"), P.REFERENCE_SECTION)
    b = section_state(blocks, ["doc_id"], ["ord"], opens, head & ~opens)
    b = b.withColumn("_island", F.count_if(~ref).over(so_far))
    run = F.count_if(ref).over(Window.partitionBy("doc_id", "page_number", "_island"))
    return b.withColumn("in_run", ref & ((run >= 2) | F.col("in_section"))).drop("_island", "in_section")


def figures_in_order(blocks: DataFrame, kind: str = "figure") -> DataFrame:
    """The figures of each document with their number in its order."""
    return blocks.where(F.col("type") == kind).withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")))


def caption_number(content: Column) -> Column:
    """The number of a caption, null where content is none."""
    return F.when(content.rlike("(?iu)" + P.CAPTION), fold_digits(F.regexp_extract(content, "(?iu)" + P.CAPTION, 1)).try_cast("int"))


def link_figures(figures: DataFrame, captions: DataFrame) -> DataFrame:
    """figures(doc_id, page_number, ord, figure_num, box, page_height) with caption_ord, caption_num,
    primary_ord (for a panel, the figure it belongs to) and the box, widened by the panels.

    In their order, captions(doc_id, page_number, ord, caption_num, box) take the figure of
    their page and number, else the nearest by height that is left. What then is left and shares
    0.4 of the smaller width, near in height, becomes a panel of that figure and is taken too.
    """
    both = figures.select("doc_id", "page_number", "ord", F.col("figure_num").alias("num"), *BOX, "page_height", F.lit(True).alias("figure"))
    both = both.unionByName(captions.select("doc_id", "page_number", "ord", F.col("caption_num").alias("num"), *BOX, F.lit(None).cast("double").alias("page_height"), F.lit(False).alias("figure")))
    schema = "doc_id bigint, page_number int, ord int, caption_ord int, caption_num int, primary_ord int, x0 double, y0 double, x1 double, y1 double"

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        pics = rows[rows["figure"]].to_dict("records")
        left = list(range(len(pics)))
        out = [{"doc_id": f["doc_id"], "page_number": f["page_number"], "ord": f["ord"], "caption_ord": None, "caption_num": None, "primary_ord": None} | {c: f[c] for c in BOX} for f in pics]
        for c in rows[~rows["figure"]].to_dict("records"):
            if not left:
                break
            far = lambda k: abs(pics[k]["y0"] + pics[k]["y1"] - c["y0"] - c["y1"])
            best = next((k for k in left if pics[k]["num"] == c["num"]), None)
            best = min(left, key=far) if best is None else best
            left.remove(best)
            out[best] |= {"caption_ord": c["ord"], "caption_num": c["num"]}
            a, window = pics[best], max(120.0, 0.35 * pics[best]["page_height"])
            for k in list(left):
                b = pics[k]
                shared = min(a["x1"], b["x1"]) - max(a["x0"], b["x0"])
                narrow = min(max(0.0, a["x1"] - a["x0"]), max(0.0, b["x1"] - b["x0"])) or 1.0
                if shared / narrow >= 0.4 and min(abs(b["y0"] - a["y1"]), abs(a["y0"] - b["y1"])) <= window:
                    left.remove(k)
                    out[k]["primary_ord"] = a["ord"]
                    out[best] |= {"x0": min(out[best]["x0"], b["x0"]), "y0": min(out[best]["y0"], b["y0"]), "x1": max(out[best]["x1"], b["x1"]), "y1": max(out[best]["y1"], b["y1"])}
        names = [f.split()[0] for f in schema.split(", ")]
        return pd.DataFrame(out, columns=names).astype({k: "Int64" for k in ("caption_ord", "caption_num", "primary_ord")})

    return both.groupBy("doc_id", "page_number").applyInPandas(page, schema)


def unite_figures(figures: DataFrame) -> DataFrame:
    """Groups of touching figures as one: doc_id, page_number, ord of the first by place, n_figures,
    sub_images (the others' ids, by place) and the box around all."""
    groups = figures.join(figure_groups(figures), ["doc_id", "page_number", "ord"])
    others = F.array_sort(F.collect_list(F.when(F.col("ord") != F.col("primary_ord"), F.struct("y0", "x0", "ord", "id"))))
    box = [f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))]
    return groups.groupBy("doc_id", "page_number", F.col("primary_ord").alias("ord")).agg(F.count("*").alias("n_figures"), F.array_join(F.transform(others, lambda x: x["id"]), ",").alias("sub_images"), *box)
