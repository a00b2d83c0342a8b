"""Predicates and classifiers as native columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def any_matches(c: Column, patterns: tuple[str, ...]) -> Column:
    """One expression a pattern, so each keeps its own flags; all match without case but those
    that begin with (?-i)."""
    return reduce(Column.__or__, [c.rlike(p[5:] if p.startswith("(?-i)") else "(?iu)" + p) for p in patterns])


def any_contains(c: Column, markers: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [c.contains(m) for m in markers])


def front_matter(c: Column) -> Column:
    return (c != "") & (F.length(c) <= 600) & any_matches(c, P.FRONT_MATTER)


def running_header(c: Column) -> Column:
    return any_matches(c, P.RUNNING_HEADER)


def affiliation(c: Column) -> Column:
    return c.rlike("(?iu)" + P.AFFILIATION)


def asks_for_text(source: Column, reply: Column) -> Column:
    """A short source got a reply that asks for the text instead."""
    return (F.length(source) <= 60) & ~source.contains(".") & (F.length(reply) <= 160) & any_contains(F.lower(reply), P.ASKING_MARKERS)


def error_class(message: Column, status: Column) -> Column:
    """retryable or permanent; what may pass wins over the status, unknown failures are retried."""
    text = F.lower(message)
    return (
        F.when(any_contains(text, P.TRANSIENT_MARKERS), "retryable")
        .when((status == 429) | (status >= 500), "retryable")
        .when(status.isin(*P.PERMANENT_STATUS), "permanent")
        .when(any_contains(text, P.PERMANENT_MARKERS), "permanent")
        .otherwise("retryable")
    )


def retry_delay(attempt: Column) -> Column:
    return F.least(F.lit(12.0), F.lit(1.5) * F.pow(F.lit(2.0), attempt - 1))


def url_kind(url: Column) -> Column:
    return F.when(F.lower(url).rlike("^https?:"), "url").otherwise("path")


def sniff(content: Column) -> Column:
    """What the first bytes of a download are."""
    head = F.lower(F.substring(content, 1, 1024))
    return F.when(F.length(content) < 100, "too small").when(F.substring(content, 1, 1024).contains("%PDF-"), "pdf").when(head.contains("<html") | head.contains("<!doctype html"), "inaccessible").otherwise("invalid")


def section_heading(c: Column) -> Column:
    return (F.length(c) < 100) & any_matches(c, P.HEADING)


def section_event(c: Column) -> Column:
    """opens or closes: what a heading does to the bibliography; else null."""
    return F.when(any_matches(c, P.REFERENCE_SECTION), "opens").when(any_matches(c, P.OTHER_SECTION), "closes")


def byline(c: Column) -> Column:
    """A run of personal names with separators, and no sentence."""
    words = F.filter(F.split(c, "(?U)" + P.BYLINE_SPLIT), lambda w: w != "")
    named = F.filter(words, lambda w: w.rlike(f"^{P.NAMEY_TOKEN}$") | F.lower(w).isin(*P.PARTICLES))
    separated = c.contains("|") | c.contains("•") | (F.regexp_count(c, F.lit(",")) >= 2)
    names = F.regexp_count(c, F.lit(P.NAME_TOKEN))
    shape = F.size(words).between(3, 60) & (F.size(named) >= 0.6 * F.size(words)) & (names >= 3)
    return F.length(c).between(1, 400) & ~c.rlike(r"(?U)(?<![A-Z])[.!?]\s+[A-Z]") & separated & shape


def label(c: Column) -> Column:
    """A name of a part of a document or of an institution, so no term."""
    return F.lower(c).isin(*P.LABELS) | any_matches(c, P.LABEL_PATTERNS)


def anatomical_pattern() -> str:
    """The terms, longest first."""
    return rf"\b(?:{'|'.join(sorted(P.ANATOMICAL_TERMS, key=len, reverse=True))})\b"


def block_type(content: Column, size: Column, body: Column, bold: Column, page: Column, y0: Column, y1: Column, height: Column, rotated: Column) -> Column:
    """The type of a block; the first case that holds counts."""
    n, first, edge = F.length(content), page == 1, 0.09 * height
    return (
        F.when(rotated | front_matter(content), "other")
        .when(((y1 <= edge) | (y0 >= height - edge)) & (n < 300) & running_header(content), "other")
        .when(first & (size >= 1.35 * body) & (n < 300) & (y0 < 300), "title")
        .when(content.rlike("(?iu)" + P.CAPTION), "figure_caption")
        .when(affiliation(content) & (n < 500), "other")
        .when(section_heading(content), "heading")
        .when(first & byline(content), "author")
        .when((bold | (size >= 1.15 * body)) & (n < 120) & ~content.endswith("."), "heading")
        .when(content.rlike(P.REFERENCE_ITEM), "reference")
        .otherwise("paragraph")
    )


def goes_on(text: Column, before: Column) -> Column:
    """Whether text is the rest of the entry before it: it starts small, or that entry has no end."""
    tail = F.rtrim(before)
    return (F.trim(text) != "") & (F.ltrim(text).rlike(r"^\p{Ll}") | F.coalesce((tail != "") & ~tail.rlike(r'[.!?»"]$'), F.lit(False)))


def admission(host: Column, origin: Column, auth: Column, kind: Column, stream: Column, text: Column, token: str) -> Column:
    """The status a request gets: 200, or that of the first rule it breaks."""
    media = F.lower(F.trim(F.split_part(F.coalesce(kind, F.lit("")), F.lit(";"), F.lit(1))))
    bearer = F.lower(F.coalesce(auth, F.lit(""))).startswith("bearer ") & (F.trim(F.substring(auth, 8, 1 << 20)) == token)
    return (
        F.when(~F.lower(F.trim(F.split_part(F.coalesce(host, F.lit("")), F.lit(":"), F.lit(1)))).isin(*P.LOOPBACK), 403)
        .when(F.coalesce(origin, F.lit("")) != "", 403)
        .when(~F.coalesce(bearer, F.lit(False)), 401)
        .when(~media.isin("", "application/json"), 415)
        .when((F.coalesce(text, F.lit("")) == "") | F.coalesce(stream, F.lit(False)), 400)
        .otherwise(200)
    )


def model_rejected(message: Column, status: Column) -> Column:
    return (status == 400) & any_contains(F.lower(message), ("inference_failed", "model", "not found"))


def image_type(extension: Column) -> Column:
    return F.concat(F.lit("image/"), F.when(extension.isin(*P.IMAGE_TYPES), extension).otherwise("png"))


def download_outcome(status: Column, kind: Column, head: Column, declared: Column, size: Column) -> Column:
    """What a download comes to: ok, inaccessible, invalid, or failed; head are its first bytes."""
    start = F.substring(head, 1, P.FIRST_CHUNK)
    page = F.lower(start).contains("<html") | F.lower(F.coalesce(kind, F.lit(""))).contains("text/html")
    return (
        F.when(status.isin(401, 403), "inaccessible")
        .when(status >= 400, "failed")
        .when(page, "inaccessible")
        .when(~start.contains("%PDF-"), "invalid")
        .when((declared > P.DOWNLOAD_LIMIT) | (size > P.DOWNLOAD_LIMIT), "failed")
        .when(size < P.LEAST_FILE, "invalid")
        .otherwise("ok")
    )


def local_endpoint(url: Column) -> Column:
    return any_contains(F.coalesce(url, F.lit("")), P.LOCAL_HOSTS)


def own_asset(name: Column) -> Column:
    """Whether a file is one of the figures that a run writes, and may go before the next."""
    return name.rlike("^figure-")


def source_path(source: Column) -> Column:
    """A source as it was meant: without blanks and quotes around it."""
    return F.regexp_replace(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")
