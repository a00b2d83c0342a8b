"""Term pairs in running text: a rendering with its English name in parentheses behind it.

The name has a shape that can be found; the rendering is what stands before it, back to the
nearest boundary. Both are read off one text at a time, in Arrow batches; what is done with
the pairs (first renderings, notes) are aggregates and joins.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import anatomical_pattern
from ..functions.text import term_key

NAME = re.compile(P.NAME_IN_PARENTHESES)
STAYS = re.compile("(?i)" + anatomical_pattern())
NO_TERM = [re.compile(p, re.IGNORECASE) for p in P.LABEL_PATTERNS]
STOPS = set(P.SENTENCE_END + P.TERM_BOUNDARY + P.TERM_BARRIER)


def term_before(text: str) -> tuple[str, int]:
    """The rendering at the end of text, and how many characters it takes; ("", 0) if there is
    none: a quote or bracket comes first, no boundary is near, or it has too many words."""
    reach = P.TERM_CHARS + 1
    near = text[-reach - 1 :]
    at = next((k for k in range(len(near) - 1, -1, -1) if near[k] in STOPS), None)
    if at is None and len(near) > reach:
        return "", 0
    if at is not None and near[at] in P.TERM_BARRIER:
        return "", 0
    run = near[0 if at is None else at + 1 :]
    words = run.split()
    first = next((k for k, w in enumerate(words) if w not in P.TERM_STOPWORDS), max(0, len(words) - 1))
    words = words[first:]
    if not words or len(words) > P.TERM_WORDS:
        return "", 0
    term = " ".join(words)
    return term, len(term) + len(run) - len(run.rstrip())


def pairs_of(text: str) -> list[tuple[int, int, str, str]]:
    """Start, end, English name and rendering of each pair; names that stay English and labels
    are no terms. A rendering never reaches into the pair before it."""
    found, done = [], 0
    for m in NAME.finditer(text):
        term, taken = term_before(text[done : m.start()])
        name = " ".join(m[1].split())
        if not term or STAYS.search(name) or name.lower() in P.LABELS or any(p.search(name) for p in NO_TERM):
            continue
        found.append((m.start() - taken, m.end(), name, term))
        done = m.end()
    return found


def marked(text: str) -> str:
    """text as HTML: pairs as terms that can be chosen, other names in parentheses as English."""
    text = html.escape(text)
    english = lambda part: re.sub(P.PLAIN_PARENTHESES, lambda m: P.NAME_OPEN + m[0] + P.NAME_CLOSE, part)
    out, at = [], 0
    for start, end, name, term in pairs_of(text):
        out += [english(text[at:start]), P.TERM_OPEN, name, P.TERM_MIDDLE, term, P.TERM_NAME, name, P.TERM_CLOSE]
        at = end
    return "".join([*out, english(text[at:])])


def mark_terms(blocks: DataFrame, text: str = "content", out: str = "markup") -> DataFrame:
    """blocks with text as marked HTML in out; null texts give empty ones."""
    fields = blocks.schema.simpleString()[len("struct<") : -1]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([marked(x or "") for x in b.column(text).to_pylist()], pa.string())], names=[*b.schema.names, out])

    return blocks.mapInArrow(mark, f"{fields},{out}:string")


def term_pairs(blocks: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """keys, pos, english and rendering of every pair in every text, as its HTML has them."""
    kept = blocks.select(*keys, F.col(text).alias("_text"))
    fields = kept.select(*keys).schema.simpleString()[len("struct<") : -1]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, name, term) for i, x in enumerate(b.column("_text").to_pylist()) for k, (_, _, name, term) in enumerate(pairs_of(html.escape(x or "")))]
            at = pa.array([r[0] for r in rows], pa.int32())
            cols = [b.column(k).take(at) for k in keys] + [pa.array([r[c] for r in rows], t) for c, t in ((1, pa.int32()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "pos", "english", "rendering"])

    return kept.mapInArrow(find, f"{fields},pos:int,english:string,rendering:string")


def first_renderings(pairs: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, term_key, english and rendering: each term of a document as first written there."""
    by = pairs.groupBy(key, term_key(F.col("english")).alias("term_key"))
    first = by.agg(F.min_by(F.struct("english", "rendering"), F.struct(*order, "pos")).alias("f"))
    return first.select(key, "term_key", "f.*")


def notes_for(terms: DataFrame, authored: DataFrame, fallback: str) -> DataFrame:
    """terms with their note: that of authored(term, note), whose last spelling of a key counts;
    else a sentence with the rendering; else fallback. authored is a dimension of some hundred
    rows, left to the optimiser to broadcast."""
    a = authored.groupBy(term_key(F.col("term")).alias("term_key")).agg(F.max_by("note", "place").alias("authored"))
    before, between, after = (F.lit(x) for x in P.TERM_NOTE)
    sentence = F.when(F.coalesce("rendering", F.lit("")) != "", F.concat(before, "english", between, "rendering", after))
    return terms.join(a, "term_key", "left").withColumn("note", F.coalesce("authored", sentence, F.lit(fallback))).drop("authored")
