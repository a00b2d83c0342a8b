"""Providers of translations. Only the offline one is here: fixed headings, given replies to
known passages, citations as they are, and terms put into everything else.

A provider takes texts(key, order, kind, text) and adds reply. Remote providers have the same
shape and belong into a mapInPandas with a client for each partition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import any_contains
from ..functions.text import persian_digits, strip
from .terms import inject_terms, rendering_of

#: Known passages: any of the markers (lower case), and the reply. A run brings its own.
Canned = tuple[tuple[tuple[str, ...], str], ...]


def known_passage(text: Column, canned: Canned) -> Column:
    """The reply of the first passage one of whose markers text holds; null if there is none."""
    low = F.lower(text)
    cases = [(any_contains(low, markers), reply) for markers, reply in canned]
    return reduce(lambda c, case: c.when(*case), cases[1:], F.when(*cases[0])) if cases else F.lit(None).cast("string")


def offline(texts: DataFrame, terms: dict[str, str] = P.GLOSSARY, passages: Canned = (), captions: Canned = (), key: str = "doc_id", order: str = "ord") -> DataFrame:
    """texts with reply. kind caption: a figure's number in Persian digits before its text; any
    other kind is running text. Terms name their original where the document has them first."""
    clean = strip(F.coalesce("text", F.lit("")))
    caption = (F.col("kind") == "caption") & clean.rlike("(?iu)" + P.CAPTION_PARTS)
    number, rest = (F.regexp_extract(clean, "(?iu)" + P.CAPTION_PARTS, k) for k in (1, 2))
    head = F.when(caption, F.concat(F.lit(P.FIGURE_WORD + " "), persian_digits(number), F.lit(". "))).otherwise("")
    known = F.coalesce(rendering_of(clean, P.HEADING_RENDERINGS), known_passage(clean, passages), F.when(clean.rlike(r"^\s*\[\d+\]"), clean))
    said = F.when(clean == "", "").when(caption, known_passage(rest, captions)).when(F.col("kind") != "caption", known)
    t = texts.withColumns({"_head": head, "_said": said, "_rest": F.when(caption, strip(rest)).otherwise(clean)})
    put = inject_terms(t.where("_said is null").select(key, order, "_rest"), terms, key, order, "_rest").withColumnRenamed("_rest", "_put")
    return t.join(put, [key, order], "left").withColumn("reply", F.concat("_head", F.coalesce("_said", "_put"))).drop("_head", "_said", "_rest", "_put")


PROVIDERS: dict[str, Callable[..., DataFrame]] = dict.fromkeys(("mock", "offline", "test"), offline)


def provider(name: str) -> Callable[..., DataFrame]:
    """The provider of that name, in any case."""
    try:
        return PROVIDERS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"no provider {name!r}; there are {', '.join(sorted(PROVIDERS))}") from None
