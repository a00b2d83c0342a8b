"""Matching that depends on the order in which rows are taken: grouped Python per page.

A page is a bounded group; documents never meet in one task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from ..functions.patterns import HYPHEN_BREAK


def _merge(left: str, right: str) -> str:
    if left.endswith(HYPHEN_BREAK):
        return left[:-1] + right
    if left.endswith("-") and left[-2:-1].isalpha() and right[:1].isalpha():
        return left[:-1] + right
    return f"{left} {right}"


def reflow(blocks: DataFrame) -> DataFrame:
    """Lines of one paragraph become a block: next to each other in a column, of one size, and the
    first does not end a sentence. Each line is held against all that was gathered before."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in rows.sort_values("ord").to_dict("records"):
            if out and r["type"] == out[-1]["type"] == "paragraph":
                a = out[-1]
                shared = min(a["x1"], r["x1"]) - max(a["x0"], r["x0"])
                narrow = max(1, min(a["x1"] - a["x0"], r["x1"] - r["x0"]))
                gap = r["y0"] - a["y1"]
                if abs(a["font_size"] - r["font_size"]) <= 0.6 and shared / narrow >= 0.55 and -2 <= gap <= 1.9 * r["font_size"] and a["content"][-1:] not in ".!?:;،؛»\"":
                    a["content"] = _merge(a["content"], r["content"])
                    a["x0"], a["x1"], a["y1"] = min(a["x0"], r["x0"]), max(a["x1"], r["x1"]), max(a["y1"], r["y1"])
                    a["merged"] += 1
                    continue
            out.append(r | {"merged": 1})
        return pd.DataFrame(out)[["doc_id", "page_number", "ord", "type", "content", "merged"]]

    return blocks.groupBy("doc_id", "page_number").applyInPandas(page, "doc_id bigint, page_number int, ord int, type string, content string, merged int")


def figure_groups(figures: DataFrame, gap: int = 6) -> DataFrame:
    """Figures that touch, directly or over others, with the first of their group."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y0", "x0", "ord"]).reset_index(drop=True)
        boxes = rows[["x0", "y0", "x1", "y1"]].to_numpy()
        lead = list(range(len(rows)))

        def find(i: int) -> int:
            while lead[i] != i:
                i = lead[i]
            return i

        for i, a in enumerate(boxes):
            for j in range(i):
                b = boxes[j]
                if max(a[0] - b[2], b[0] - a[2], 0) <= gap and max(a[1] - b[3], b[1] - a[3], 0) <= gap:
                    x, y = sorted((find(i), find(j)))
                    lead[y] = x
        return rows.assign(primary_ord=[rows["ord"][find(i)] for i in range(len(rows))])[["doc_id", "page_number", "ord", "primary_ord"]]

    return figures.groupBy("doc_id", "page_number").applyInPandas(page, "doc_id bigint, page_number int, ord int, primary_ord int")


def match_captions(blocks: DataFrame, caption_number: Column, figure_number: Column) -> DataFrame:
    """Captions and figures of a page, one to one: in their order a caption takes the figure of its
    number, else the nearest by height that is left. The numbers tell what a block is: captions
    have a caption's number, figures (numbered or not) a figure's, -1 for none; others null."""

    def page(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        figures = rows[rows["figure"].notna()].to_dict("records")
        found = []
        for c in rows[rows["caption"].notna()].to_dict("records"):
            if not figures:
                break
            middle = lambda r: (r["y0"] + r["y1"]) / 2
            best = min(figures, key=lambda f: (f["figure"] != c["caption"], abs(middle(f) - middle(c)), f["ord"]))
            figures.remove(best)
            found.append((c["doc_id"], c["page_number"], c["ord"], best["ord"]))
        return pd.DataFrame(found, columns=["doc_id", "page_number", "caption_ord", "figure_ord"])

    used = blocks.select("doc_id", "page_number", "ord", "y0", "y1", caption_number.cast("int").alias("caption"), figure_number.cast("int").alias("figure"))
    return used.where("caption is not null or figure is not null").groupBy("doc_id", "page_number").applyInPandas(page, "doc_id bigint, page_number int, caption_ord int, figure_ord int")


def drop_overlapping(images: DataFrame, share: float = 0.8) -> DataFrame:
    """images without those that lie over share of the smaller area on one kept before them,
    in order of ord on each page. Which stay depends on which stayed, so a page is one group."""

    def keep(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("ord", kind="stable")
        box = page[["x0", "y0", "x1", "y1"]].to_numpy(float)
        area = np.prod(box[:, 2:] - box[:, :2], axis=1)
        kept: list[int] = []
        for i in range(len(box)):
            b = box[kept]
            common = np.prod(np.maximum(0, np.minimum(b[:, 2:], box[i, 2:]) - np.maximum(b[:, :2], box[i, :2])), axis=1)
            if not (common > share * np.minimum(area[kept], area[i])).any():
                kept.append(i)
        return page.iloc[kept]

    return images.groupBy("doc_id", "page_number").applyInPandas(keep, images.schema)
