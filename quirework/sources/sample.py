"""A small document with a real layout, for tests and trials: two pages of two columns, a title
over both, figures with captions, a bibliography. Its texts are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_WIDTH, PAGE_HEIGHT = 595.0, 842.0
LEFT, RIGHT, BOTH = (50.0, 285.0), (310.0, 545.0), (50.0, 545.0)
SCHEMA = "doc_id bigint, page_number int, ord int, id string, type string, content string, x0 double, y0 double, x1 double, y1 double, font_size double, page_width double, page_height double"

#: page, type, content, columns, top, bottom, size: in the order in which a parser meets them.
PARTS = (
    (1, "other", "Annals of Invented Cases", BOTH, 20.0, 32.0, 8.0),
    (1, "title", "A repaired crown in one visit", BOTH, 60.0, 84.0, 16.0),
    (1, "paragraph", "Abstract. One tooth was treated and seen again after 3, 6 and 12 months.", BOTH, 100.0, 150.0, 9.0),
    (1, "heading", "Discussion", RIGHT, 170.0, 184.0, 11.0),
    (1, "heading", "Introduction", LEFT, 170.0, 184.0, 11.0),
    (1, "paragraph", "A crown-root fracture is seldom seen [1].", LEFT, 190.0, 400.0, 9.0),
    (1, "paragraph", "The pulp stayed vital and the fragment was", RIGHT, 190.0, 700.0, 9.0),
    (1, "figure", "", (55.0, 280.0), 420.0, 560.0, None),
    (1, "figure_caption", "Figure 1. The tooth before treatment.", LEFT, 565.0, 580.0, 8.5),
    (2, "other", "Annals of Invented Cases", BOTH, 20.0, 32.0, 8.0),
    (2, "paragraph", "put back with resin after 2 mm were removed.", LEFT, 60.0, 200.0, 9.0),
    (2, "figure", "", (55.0, 280.0), 220.0, 360.0, None),
    (2, "figure_caption", "Fig 2: The tooth after a year.", LEFT, 365.0, 380.0, 8.5),
    (2, "heading", "References", RIGHT, 60.0, 74.0, 11.0),
    (2, "reference", "[1] A. Author, On crowns, 2001.", RIGHT, 80.0, 100.0, 8.0),
    (2, "reference", "[2] B. Writer, On roots, 2011,", RIGHT, 104.0, 124.0, 8.0),
    (2, "reference", "second edition. [3] C. Scribe, On resin, 2017.", RIGHT, 128.0, 148.0, 8.0),
)


def sample_blocks(spark: SparkSession) -> DataFrame:
    rows = [(1, page, k, f"p{page}_b{k}", kind, text, x[0], top, x[1], bottom, size, PAGE_WIDTH, PAGE_HEIGHT) for k, (page, kind, text, x, top, bottom, size) in enumerate(PARTS)]
    return spark.createDataFrame(rows, SCHEMA)
