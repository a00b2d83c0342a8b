"""Terms put into texts: each term's first place in a document also names the original."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def term_pattern(terms: dict[str, str]) -> str:
    """One alternation, longest first, so that one pass finds the longest term at each place."""
    return rf"\b(?:{'|'.join(re.escape(t) for t in sorted(terms, key=len, reverse=True))})\b"


def rendering_of(term: Column, terms: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*map(F.lit, chain(*terms.items()))), F.lower(term))


def inject_terms(blocks: DataFrame, terms: dict[str, str], key: str = "doc_id", order: str = "ord", text: str = "content") -> DataFrame:
    """key, order and text with every term replaced by its rendering, the first place of each
    term in a document followed by the term in parentheses.

    Texts are cut at the terms; only the cut places meet in a window, by document and term,
    and the pieces of a text are joined again by its key and order, which must be unique.
    """
    pattern = "(?i)" + term_pattern(terms)
    hits = F.regexp_extract_all(F.col(text), F.lit(f"({pattern})"), 1)
    pieces = F.transform(F.split(text, pattern, -1), lambda x, i: F.struct(x.alias("before"), F.get(hits, i).alias("hit")))
    cut = blocks.select(key, order, F.posexplode(pieces).alias("pos", "x")).select(key, order, "pos", "x.*").withColumn("term", F.lower("hit"))
    first = F.row_number().over(Window.partitionBy(key, "term").orderBy(order, "pos")) == 1
    put = rendering_of(F.col("hit"), terms)
    piece = F.concat("before", F.when(F.col("hit").isNull(), "").when(first, F.concat(put, F.lit(" ("), F.col("term"), F.lit(")"))).otherwise(put))
    joined = cut.withColumn("piece", piece).groupBy(key, order).agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return joined.select(key, order, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias(text))
