"""A translation run: what needs translating, the cache, the provider, checks, breaker, report.

Each distinct text is asked for once; everything else is joins on the cache's key and
windows by document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import asks_for_text
from ..functions.text import cache_key, fold_digits, strip
from .verify import units_pattern
from .windows import circuit_breaker

Provider = Callable[[DataFrame], DataFrame]


def translatable(kind: Column, content: Column) -> Column:
    """Whether a block holds text that can be translated."""
    return kind.isin(*P.TRANSLATABLE) & (strip(F.coalesce(content, F.lit(""))) != "")


def _less(a: Column, b: Column) -> Column:
    """Tokens of array a that b has less often, in order: struct(token, n)."""
    count = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    return F.filter(F.transform(F.array_sort(F.array_distinct(a)), lambda x: F.struct(x.alias("token"), (count(a, x) - count(b, x)).alias("n"))), lambda s: s["n"] > 0)


def number_warnings(source: Column, target: Column, most: int = 4) -> Column:
    """What numbers and units differ, as an array of sentences: numbers that lack, numbers that
    are added, units that lack; tokens in order of their code points."""
    find = lambda c, pattern: F.regexp_extract_all(fold_digits(F.coalesce(c, F.lit(""))), F.lit(f"({pattern})"), 1)
    (a, b), (u, v) = ((find(source, pattern), find(target, pattern)) for pattern in (P.NUMBER, units_pattern()))

    def sentence(intro: str, tokens: Column, times: bool) -> Column:
        show = F.transform(tokens, lambda s: F.concat(s["token"], F.lit(P.TIMES), s["n"].cast("string")) if times else s["token"])
        return F.when(F.size(tokens) > 0, F.concat(F.lit(intro), F.array_join(show, P.LIST_COMMA)))

    all_ = F.array(sentence(P.MISSING_NUMBERS, _less(a, b), True), sentence(P.ADDED_NUMBERS, _less(b, a), True), sentence(P.MISSING_UNITS, _less(u, v), False))
    return F.slice(F.filter(all_, lambda x: x.isNotNull()), 1, most)


@dataclass
class Run:
    """blocks with translated, outcome (done, failed, skipped, kept or null), reason, hit and
    warnings; the rows that the cache gets; a report row for each document."""

    blocks: DataFrame
    cache: DataFrame
    report: DataFrame


def translation_run(blocks: DataFrame, cache: DataFrame, ask: Provider, model: str, limit: int = 5, fails: Column | None = None) -> Run:
    """Translates blocks(doc_id, ord, id, page_number, type, content, in_run) with cache(key, model, source, value).

    Titles, headings, paragraphs and references are jobs, captions are jobs of a second pass with
    a breaker of its own; references in a run of the bibliography are kept as they are. The key is that of model, kind and text, and equal texts
    are asked for once, by the first document that has them. A reply that asks for the text
    or is empty fails, as does a job for which fails holds; so many failures in a row in a
    document skip the rest of it. Replies are checked before the cache gets them, and those of
    skipped jobs are dropped. Blocks that were not translated keep their text.
    """
    job = F.col("type").isin("title", "heading", "paragraph", "reference", "figure_caption") & (strip(F.coalesce("content", F.lit(""))) != "")
    kept = job & (F.col("type") == "reference") & F.coalesce("in_run", F.lit(False))
    kind = F.when(F.col("type") == "reference", "reference").when(F.col("type") == "figure_caption", "caption").otherwise("text")
    b = blocks.withColumns({"_kept": kept, "_job": job & ~kept, "_kind": kind})
    b = b.withColumn("key", F.when(F.col("_job"), cache_key(F.lit(model), F.col("_kind"), F.lit(""), F.col("content"))))
    known = cache.where("value is not null").groupBy("key").agg(F.min("value").alias("_cached"))
    jobs = b.where("_job").join(known, "key", "left")
    asked = jobs.where("_cached is null").groupBy("key").agg(F.min_by(F.struct("doc_id", "ord", F.col("_kind").alias("kind"), F.col("content").alias("text")), F.struct("doc_id", "ord")).alias("q"))
    replies = ask(asked.select("key", "q.*")).select("key", F.col("reply").alias("_reply"))
    jobs = jobs.join(replies, "key", "left")
    value = F.coalesce("_cached", "_reply")
    error = F.when(fails if fails is not None else F.lit(False), "provider failed").when(asks_for_text(F.col("content"), value), "asked for the text").when(strip(F.coalesce(value, F.lit(""))) == "", "empty reply")
    jobs = jobs.withColumns({"value": value, "_error": error, "hit": F.col("_cached").isNotNull()})
    jobs = circuit_breaker(jobs.withColumn("_pass", F.col("_kind") == "caption"), ["doc_id", "_pass"], ["ord"], F.col("_error").isNotNull(), limit)
    done = F.col("outcome") == "done"
    checked = done & (F.col("_kind") == "text") & F.col("type").isin("paragraph", "title")
    reason = F.when(F.col("outcome") == "skipped", "breaker open").when(F.col("outcome") == "failed", F.left("_error", F.lit(300)))
    jobs = jobs.select("doc_id", "ord", "key", "value", "outcome", "hit", reason.alias("reason"), F.when(checked, number_warnings(F.col("content"), F.col("value"))).alias("warnings"))
    out = b.drop("key").join(jobs.drop("key"), ["doc_id", "ord"], "left")
    out = out.withColumn("outcome", F.when(F.col("_kept"), "kept").otherwise(F.col("outcome")))
    translated = F.when(F.col("outcome") == "done", F.col("value")).when(F.col("outcome").isNotNull(), F.col("content"))
    out = out.withColumn("translated", translated).drop("_kept", "_job", "_kind", "value")
    fresh = jobs.where("outcome = 'done' and not hit").groupBy("key").agg(F.min("value").alias("value"))
    fresh = fresh.join(asked.select("key", F.left("q.text", F.lit(400)).alias("source")), "key").select("key", F.lit(model).alias("model"), "source", "value")
    return Run(out, fresh, report_of(out))


def report_of(blocks: DataFrame) -> DataFrame:
    """A row for each document: total = translated + failed + skipped, blocks that were kept, hits,
    blocks with warnings, whether the breaker opened, and the first three failures."""
    n = lambda name, *kinds: F.count_if(F.col("outcome").isin(*kinds)).alias(name)
    failures = F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.struct("ord", "id"))))
    return blocks.groupBy("doc_id").agg(
        n("total", "done", "failed", "skipped"),
        n("translated", "done"),
        n("failed", "failed"),
        n("skipped", "skipped"),
        n("kept_original", "kept"),
        F.count_if("hit").alias("cache_hits"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"),
        F.coalesce(F.max(F.col("outcome") == "skipped"), F.lit(False)).alias("breaker_open"),
        F.array_join(F.transform(F.slice(failures, 1, 3), lambda x: x["id"]), ",").alias("first_failures"),
    )


def translate_tables(grids: DataFrame, ask: Provider) -> DataFrame:
    """grids(doc_id, ord, rows) with translated rows: cells that hold a word are asked for, equal
    ones once; others, and those with an empty reply, stay. Rows may differ in length; adds
    n_cells and n_failed."""
    cells = grids.select("doc_id", "ord", F.posexplode("rows").alias("row", "cells")).select("doc_id", "ord", "row", F.posexplode("cells").alias("col", "cell"))
    asked = cells.where(F.col("cell").rlike(P.TEXTUAL_CELL)).groupBy("cell").agg(F.min(F.struct("doc_id", "ord", "row", "col")).alias("q"))
    # A cell is a document of its own for the provider: terms are named in each.
    texts = asked.select("cell", F.xxhash64("cell").alias("doc_id"), F.lit(0).alias("ord"), F.lit("text").alias("kind"), F.col("cell").alias("text"))
    replies = ask(texts).select("cell", F.lit(True).alias("_asked"), F.when((strip(F.col("reply")) != "") & ~asks_for_text(F.col("cell"), F.col("reply")), F.col("reply")).alias("_reply"))
    put = cells.join(replies, "cell", "left").withColumn("_cell", F.coalesce("_reply", "cell"))
    rows = put.groupBy("doc_id", "ord", "row").agg(F.array_sort(F.collect_list(F.struct("col", "_cell"))).alias("c"), F.count("_asked").alias("n"), F.count_if(F.col("_asked") & F.col("_reply").isNull()).alias("bad"))
    whole = rows.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("row", F.transform("c", lambda x: x["_cell"]).alias("c")))).alias("r"), F.sum("n").alias("n_cells"), F.sum("bad").alias("n_failed"))
    # Rows without cells come back from the grid itself.
    by_row = F.map_from_entries(F.col("r"))
    back = F.transform("rows", lambda row, i: F.coalesce(F.try_element_at(by_row, i), row))
    out = grids.join(whole, ["doc_id", "ord"], "left").withColumn("translated", F.when(F.col("r").isNull(), F.col("rows")).otherwise(back))
    return out.drop("r").fillna(0, ["n_cells", "n_failed"])


def grid_html(rows: Column) -> Column:
    """A grid as an HTML table; its first row is the header."""
    from ..functions.text import escape_html

    row = lambda cells, tag: F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escape_html(c), F.lit(f"</{tag.split()[0]}>"))), "")
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: F.concat(F.lit("<tr>"), row(r, "td"), F.lit("</tr>"))), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table><thead><tr>"), row(F.get(rows, 0), 'th scope="col"'), F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>")))


def parse_requests(requests: DataFrame, key: str, body: str) -> DataFrame:
    """key, system, prompt and stream of JSON bodies with messages(role, content). A content is a
    JSON list, of strings or of parts, whose texts are joined by lines; parts of a type other than
    text have none. A body that is no JSON has null for all of them."""
    seen = F.from_json(body, "messages array<struct<role:string,content:string>>, stream boolean")
    text = lambda c: F.coalesce(F.from_json(c, "array<struct<type:string,text:string>>"), F.transform(F.from_json(c, "array<string>"), lambda x: F.struct(F.lit("text").alias("type"), x.alias("text"))))
    said = lambda c: F.array_join(F.transform(F.filter(text(c), lambda p: F.coalesce(p["type"], F.lit("text")) == "text"), lambda p: p["text"]), "\n")
    messages = F.transform(F.col("_r.messages"), lambda m: F.struct(m["role"].alias("role"), said(m["content"]).alias("text")))
    of = lambda keep, show: F.array_join(F.transform(F.filter("_m", keep), show), "\n\n")
    line = lambda m: F.when(m["role"] == "assistant", F.concat(F.lit("Assistant: "), m["text"])).otherwise(m["text"])
    parsed = requests.withColumn("_r", seen).withColumn("_m", messages)
    return parsed.select(key, of(lambda m: m["role"] == "system", lambda m: m["text"]).alias("system"), of(lambda m: m["role"] != "system", line).alias("prompt"), F.col("_r.stream").alias("stream"))
