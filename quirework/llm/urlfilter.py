"""URL filter by a cascade of Bloom filters, all in DataFrame functions.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that level 1
takes for listed but which are not; level 3 the listed keys that level 2 takes for
those, and so on until a level takes nothing wrongly. Over that key universe the
cascade answers membership exactly, with no join against the corpus: each key asks
the levels in turn, and the first level that denies it settles the answer.

A level is one literal of bounded size. A longer list is split into shards by the keys' hash,
each with a cascade of its own; where the shards do not fit into one pass over the corpus,
passes follow each other. An expression names a level once, as the argument of a function
over all its uses, so that neither plans nor tasks hold it more often.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, materialise, release

#: (rule, action) of the production query: host, then the path's first characters.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Bytes of a shard's first level, some 1.8 million keys; shards that one pass over the corpus asks.
LEVEL_BYTES, SHARDS_A_PASS = 1 << 22, 2
#: Bits in a byte of a level: bytes below 128 are characters, which Spark reads at any place.
BYTE = 7
#: Bytes of a level that the driver gets as one row.
CHUNK = 1 << 16
FIRST_BITS, BITS = 16.0, 3.0


@dataclass
class Cascade:
    """levels: the bytes of each, with its number of bits and hashes."""

    levels: list[tuple[Column, int, int]] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """Exact for listed keys and for every key of the universe the cascade was built over."""
        return F.exists(F.array(self.bundle()), lambda held: self.within(held, key))

    def bundle(self) -> Column:
        return F.struct(*[level.alias(f"l{k}") for k, (level, _, _) in enumerate(self.levels)], F.lit(0).alias("none"))

    def within(self, held: Column, key: Column) -> Column:
        """contains, with the levels in held, which bundle gave."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            _, bits, hashes = self.levels[depth]
            hit = _might_contain(key, held[f"l{depth}"], bits, hashes, depth)
            out = F.when(hit, out).otherwise(F.lit(depth % 2 == 1))
        return F.coalesce(out, F.lit(False))


def _slots(key: Column, bits: int, hashes: int, depth: int) -> list[Column]:
    both = F.xxhash64(F.lit(depth), key)
    one, two = F.shiftrightunsigned(both, 33), both.bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.pmod(one + F.lit(i) * two, F.lit(bits)) for i in range(hashes)]


def _might_contain(key: Column, level: Column, bits: int, hashes: int, depth: int) -> Column:
    out = F.lit(True)
    for slot in reversed(_slots(key, bits, hashes, depth)):
        byte = F.ascii(F.substring(level, F.floor(slot / BYTE).cast("int") + 1, F.lit(1)).cast("string"))
        out = F.when(F.getbit(byte, (slot % BYTE).cast("int")) == 1, out).otherwise(F.lit(False))
    return out


def _passing(keys: DataFrame, level: Column, bits: int, hashes: int, depth: int) -> DataFrame:
    """keys(key) that a level may contain."""
    return keys.where(F.exists(F.array(level), lambda held: _might_contain(F.col("key"), held, bits, hashes, depth))).select("key")


def _level(keys: DataFrame, n: int, bits_per_key: float, hashes: int, depth: int) -> tuple[Column, int, int]:
    size = max(1, -(-int(max(1, n) * bits_per_key) // BYTE))
    bits = BYTE * size
    slots = keys.select(F.explode(F.array(*_slots(F.col("key"), bits, hashes, depth))).alias("slot"))
    slots = slots.select(F.floor(F.col("slot") / BYTE).alias("at"), F.call_function("shiftleft", F.lit(1), (F.col("slot") % BYTE).cast("int")).alias("bit"))
    found = slots.groupBy("at").agg(F.bit_or("bit").alias("byte")).select(F.floor(F.col("at") / CHUNK).alias("chunk"), (F.col("at") % CHUNK).cast("int").alias("at"), "byte")
    before = F.lag("at", 1, -1).over(Window.partitionBy("chunk").orderBy("at"))
    digits = F.concat(F.repeat(F.lit("00"), F.col("at") - before - 1), F.lpad(F.hex("byte"), 2, "0"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "digits"))), lambda x: x["digits"])
    rows = found.withColumn("digits", digits).groupBy("chunk").agg(F.array_join(pieces, "").alias("digits"))
    # The driver gets one level, bounded whatever the list and the corpus, CHUNK bytes a row.
    level = bytearray(size)
    for chunk, text in rows.collect():
        part = bytes.fromhex(text)
        level[chunk * CHUNK : chunk * CHUNK + len(part)] = part
    return F.lit(bytes(level)), bits, hashes


def build_cascade(listed: DataFrame, universe: DataFrame, first_bits: float = FIRST_BITS, bits: float = BITS, max_depth: int = 40) -> Cascade:
    """A cascade over listed(key) that is exact for every key of universe(key).

    universe is read once, in full, and may repeat keys; null keys are ignored. What
    passes level 1 wrongly is set apart by grouping it with the listed keys, and only
    that small table is looked at for the deeper levels. Each level leaves less than half
    of the keys open, so max_depth is out of reach.
    """
    listed = materialise(listed.where("key is not null").select("key").distinct(), "listed")
    n, cascade, done = listed.count(), Cascade(), [listed]
    if not n:
        return cascade
    cascade.levels.append(_level(listed, n, first_bits, max(1, round(first_bits * 0.69)), 0))
    level, size, hashes = cascade.levels[0]
    passed = _passing(universe.where("key is not null"), level, size, hashes, 0)
    marked = listed.withColumn("own", F.lit(1)).unionByName(passed.withColumn("own", F.lit(0)))
    # within: the keys the newest level encodes; without: those it must not take for its own.
    within, without = listed, materialise(marked.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key"), "passed")
    done.append(without)
    while (m := without.count()) and len(cascade.levels) < max_depth:
        depth = len(cascade.levels)
        cascade.levels.append(_level(without, m, bits, max(1, round(bits * 0.69)), depth))
        level, size, hashes = cascade.levels[-1]
        wrong = _passing(within, level, size, hashes, depth)
        within, without = without, materialise(wrong, "passed")
        done.append(without)
    if m:
        raise RuntimeError(f"{m} keys are still mistaken after {max_depth} levels")
    release(*done)
    return cascade


def build_shards(listed: DataFrame, universe: DataFrame) -> list[tuple[Cascade, int, int]]:
    """Cascades with their shard and the number of shards: as many as keep each level within
    LEVEL_BYTES, the second too, which holds what the first mistakes of the universe."""
    listed = materialise(listed.where("key is not null").select("key").distinct(), "keys")
    n = listed.count()
    if not n:
        return []
    most = BYTE * LEVEL_BYTES
    shards = max(1, -(-int(n * FIRST_BITS) // most))
    others = universe.agg(F.approx_count_distinct("key")).first()[0] or 0
    shards = max(shards, -(-int(others * 0.6185**FIRST_BITS * BITS) // most))
    out = []
    for k in range(shards):
        mine = [t if shards == 1 else t.where(_shard(F.col("key"), shards) == k) for t in (listed, universe)]
        out.append((build_cascade(*mine), k, shards))
    release(listed)
    return out


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(shards))


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty for null or no ://."""
    host = ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every rule that could fit: shapes are the numbers of host labels and path characters
    that rules have, so there are no more keys than shapes, however long the url."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    asked = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p")) for h, p in shapes]) if shapes else F.array().cast("array<struct<h:int,p:int>>")
    fits = F.filter(asked, lambda s: (host != "") & (s["h"] <= labels) & (s["p"] <= F.length(path)))
    return F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["h"]), F.substring(path, F.lit(1), s["p"])))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages.

    rules(rule string, action allow or block): a rule is a host and the beginning of a
    path, fits that host and its subdomains, and the longest that fits decides; of one
    rule given both actions, block counts. Where none fits, the keys are not listed and
    verdict is default. rules may hold any number of rows; each action has its own
    cascades, built over all candidate keys of pages.

    Null urls and urls without :// have empty host and path and no rule. Repeated rows
    stay. Columns of pages named host, path, rule or verdict are replaced. An empty rules
    table gives every row the default.
    """
    rules = materialise(rules.where("rule is not null").groupBy("rule").agg(F.max("action").alias("action")), "rules")
    rule_host = F.regexp_extract("rule", r"(?s)^([^/]*)", 1)
    shape = [(F.length(rule_host) - F.length(F.replace(rule_host, F.lit("."), F.lit(""))) + 1).alias("h"), (F.length("rule") - F.length(rule_host)).alias("p")]
    # Distinct lengths, as few as the rules' authors use whatever their number.
    shapes = sorted(map(tuple, rules.select(*shape).distinct().collect()))
    host, path = url_parts(F.col(url))
    split = pages.withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), shapes)
    universe = split.select("host", "path").select(F.explode(keys).alias("key"))
    asked = [(action, *shard) for action in ("block", "allow") for shard in build_shards(rules.where(F.col("action") == action).select(F.col("rule").alias("key")), universe)]
    out = split.withColumn("_best", F.lit(None).cast("struct<n:int,rule:string,action:string>"))
    for at in range(0, len(asked), SHARDS_A_PASS):
        some, done = asked[at : at + SHARDS_A_PASS], out

        def action_of(held: Column, key: Column, some: list = some) -> Column:
            action = F.lit(None).cast("string")
            for i, (name, cascade, k, shards) in reversed([*enumerate(some)]):
                mine = F.lit(True) if shards == 1 else _shard(key, shards) == k
                action = F.when(mine & cascade.within(held[f"c{i}"], key), name).otherwise(action)
            return action

        bundles = F.struct(*[cascade.bundle().alias(f"c{i}") for i, (_, cascade, _, _) in enumerate(some)])
        hits = F.transform(F.array(bundles), lambda held: F.array_max(F.filter(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), action_of(held, k).alias("action"))), lambda x: x["action"].isNotNull())))
        # Of equal lengths the rules are equal, and each has one action.
        out = out.withColumn("_best", F.greatest(F.col("_best"), F.get(hits, F.lit(0))))
        if at + SHARDS_A_PASS < len(asked):
            out = materialise(out, "judged")
            release(done)
    return out.withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.action"), F.lit(default))}).drop("_best")
