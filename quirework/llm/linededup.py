"""Line dedup by site-relative frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import materialise

#: Pages of a site beyond which its rows are salted, unless so many sites have more that the
#: list of them would outgrow MOST_HOT.
HOT_PAGES, MOST_HOT = 10_000, 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _code(line: Column) -> Column:
    """96 bits that stand for a line without the spaces at its ends; blank lines have none."""
    bare = F.trim(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b")))


def _join_site(left: DataFrame, right: DataFrame, sites: DataFrame, total: int, small: bool, how: str, salt: Column) -> DataFrame:
    """left joined with right(site, ...) on the site, null a site too. A small right is
    broadcast; else rows of a hot site are salted, and right's row is repeated for each salt."""
    marked = lambda d: d.withColumns({"k": F.coalesce("site", F.lit("")), "no": F.col("site").isNull()})
    keys = ["k", "no"]
    left, right = marked(left), marked(right).drop("site")
    if small:
        return left.join(F.broadcast(right), keys, how).drop(*keys)
    most = max(HOT_PAGES, -(-total // MOST_HOT))
    # Fewer than MOST_HOT rows, since each has over a MOST_HOT-th of all pages.
    hot = F.broadcast(marked(sites.where(F.col("pages") > most)).select(*keys, F.ceil(F.col("pages") / most).alias("salts")))
    salts = F.coalesce("salts", F.lit(1))
    left = left.join(hot, keys, "left").withColumn("salt", F.pmod(salt, salts)).drop("salts")
    right = right.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
    return left.join(right, [*keys, "salt"], how).drop(*keys, "salt")


def dedup_lines(docs: DataFrame, site: str = "source", text: str = "text", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """docs with the site's boilerplate lines taken out of text; adds n_lines and n_dropped.

    A line goes if it stands on at least min_pages of the site's pages and on more than
    ratio of them; a page counts once for a line; lines are compared, by 96 bits of hash,
    without the spaces at their ends. Blank lines stay. Null texts stay null and count as
    pages; null sites are one site; a text of dropped lines alone becomes empty; repeated rows
    are separate pages; columns named n_lines or n_dropped are replaced, any other column
    stays whatever its name; an empty table gives no rows.

    What is shuffled are codes, summed up before; a site has less than (lines of a mean page) /
    ratio codes that go. They are broadcast while there are few over all sites; else texts
    are joined by site, those of hot sites salted.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{site}`").cast("string").alias("site"), F.col(f"`{text}`").alias("t"))
    sites = materialise(rows.groupBy("site").agg(F.count("*").alias("pages")), "sites")
    n_sites, total = sites.agg(F.count("*"), F.sum("pages")).first()
    codes = F.array_distinct(F.filter(F.transform(_lines(F.col("t")), _code), lambda c: c.isNotNull()))
    seen = rows.select("site", F.explode(codes).alias("line")).select("site", "line.*").groupBy("site", "a", "b").agg(F.count("*").alias("n"))
    often = _join_site(seen.where(F.col("n") >= min_pages), sites, sites, total or 0, n_sites <= shared.BROADCAST_ROWS, "inner", F.col("a"))
    found = materialise(often.where(F.col("n") > ratio * F.col("pages")).select("site", "a", "b"), "boilerplate")
    drops = found.groupBy("site").agg(F.collect_list(F.struct("a", "b")).alias("drops"))
    out = _join_site(rows, drops, sites, total or 0, found.count() <= shared.BROADCAST_ROWS, "left", F.xxhash64("t"))
    kept = F.filter(_lines(F.col("t")), lambda x: ~F.coalesce(F.array_contains(F.col("drops"), _code(x)), F.lit(False)))
    out = out.withColumn("kept", F.when(F.col("drops").isNull(), _lines(F.col("t"))).otherwise(kept))
    size = lambda c: F.when(F.col("t").isNull(), 0).otherwise(F.size(c)).cast("bigint")
    n = size(_lines(F.col("t")))
    given = [F.array_join("kept", "\n").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*given, n.alias("n_lines"), (n - size(F.col("kept"))).alias("n_dropped"))


def visible_lines(html: Column) -> Column:
    """The text between a page's tags, a line for each piece; scripts, styles and comments go."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", "\n"), r"\n[ \n\t\r]*", "\n"))
