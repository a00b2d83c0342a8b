"""Text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_text(c: Column) -> Column:
    """Invisible characters go, exotic spaces become plain, a soft hyphen at the end becomes a
    break marker and others go with the space behind them, blanks collapse, ends are stripped."""
    c = F.translate(c, P.ZERO_WIDTH, "")
    c = F.translate(c, P.EXOTIC_SPACES, " " * len(P.EXOTIC_SPACES))
    c = F.regexp_replace(c, P.SOFT_HYPHEN + r"\s*$", P.HYPHEN_BREAK)
    c = F.regexp_replace(c, P.SOFT_HYPHEN + r"\s*", "")
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


def join_lines(lines: Column) -> Column:
    """Lines folded into one: broken words join, others get a space."""
    broken = F.lit(P.HYPHEN_BREAK)

    def step(left: Column, right: Column) -> Column:
        cut = F.left(left, F.length(left) - 1)
        return (
            F.when(left == "", right)
            .when(F.endswith(left, broken), F.concat(cut, right))
            .when(left.rlike(r"\p{L}-$") & right.rlike(r"^\p{L}"), F.concat(cut, right))
            .otherwise(F.concat(left, F.lit(" "), right))
        )

    return F.aggregate(lines, F.lit(""), step)


def collapse_repeats(c: Column) -> Column:
    """Runs of 20 characters and more that stand twice in a row stand once, over and over until
    nothing changes. Texts without such a run are looked at once; each turn takes at least 21
    characters out, so there are at most so many turns as 21 goes into the length."""
    twice = r"(\b.{20,}?)\s+\1\b"

    def turn(state: Column, _: Column) -> Column:
        less = F.regexp_replace(state["s"], twice, "$1")
        return F.when(state["done"], state).otherwise(F.struct(less.alias("s"), (less == state["s"]).alias("done")))

    turns = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(c) / 21).cast("int")))
    start = F.struct(c.alias("s"), F.lit(False).alias("done"))
    return F.when(c.rlike(twice), F.aggregate(turns, start, turn)["s"]).otherwise(c)


def fold_digits(c: Column) -> Column:
    return F.translate(c, P.EASTERN_DIGITS, "01234567890123456789")


def persian_digits(c: Column) -> Column:
    return F.translate(c, "0123456789", P.PERSIAN_DIGITS)


def term_key(c: Column) -> Column:
    """Lower case, single spaces, no plural s."""
    key = F.lower(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    plural = (F.length(key) > 3) & key.rlike("s$") & ~key.rlike("(ss|is|us)$")
    return F.when(plural, F.left(key, F.length(key) - 1)).otherwise(key)


def header_key(c: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(c, r"\s+", " ")))


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts with NUL between them; null parts count as empty."""
    return F.sha2(F.concat_ws("\0", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def safe_filename(url: Column) -> Column:
    """A digest of the URL, then its last path segment with odd characters replaced, as .pdf."""
    path = F.rtrim(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#;]*)", 1), F.lit("/"))
    name = F.when(path == "", "article").otherwise(F.substring_index(path, "/", -1))
    name = F.regexp_replace(name, r"[^a-zA-Z0-9_\-\.]", "_")
    name = F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))
    return F.concat(F.left(F.sha1(url), F.lit(10)), F.lit("_"), name)


def strip_provider(model: Column) -> Column:
    return F.regexp_replace(model, "^[^/]*/", "")


def script_safe_json(c: Column) -> Column:
    """JSON that may stand in an HTML script."""
    for bad, good in (("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def escape_html(c: Column) -> Column:
    for bad, good in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def post_process(c: Column, kind: Column) -> Column:
    """Single spaces (tables keep their lines), no break markers, and runs that stand twice once."""
    c = F.replace(c, F.lit(P.HYPHEN_BREAK), F.lit(""))
    plain = F.when(kind == "table", strip(F.regexp_replace(c, r"[ \t]+", " "))).otherwise(strip(F.regexp_replace(c, r"(?U)\s+", " ")))
    return F.when(kind.isin("paragraph", "heading", "title"), collapse_repeats(plain)).otherwise(plain)
