"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_dimension, materialise

WORD = r"[^\x20\x09-\x0D]+"


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def capped_targets(sources: DataFrame, cycle: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """Adds weight and target to sources(source, source_size).

    Weights go round the cycle by the source's code points, null last. All targets are
    weight x level, but at most cap x source_size, with one level such that they sum up
    to share x all sizes: what sharing the excess again and again leads to. The table has
    a row for each source, and its windows run over no more than that.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    rank = F.pmod(F.row_number().over(order) - 1, F.lit(len(cycle)))
    out = sources.withColumn("weight", F.get(F.array(*map(F.lit, cycle)), rank.cast("int")))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
    out = out.withColumn("_level", (F.col("_total") - before * F.lit(float(cap))) / rest)
    # The level is that of the first source, in order of size / weight, which it leaves below its cap.
    fits = F.col("_level") <= F.col("source_size") * F.lit(float(cap)) / F.col("weight")
    out = out.withColumn("_found", F.max(F.when(fits, F.struct(-F.col("source_size") / F.col("weight"), F.col("_level").alias("level")))).over(everything)["level"])
    capped = F.col("source_size") * F.lit(float(cap))
    return out.withColumn("target", F.least(capped, F.coalesce(F.col("weight") * F.col("_found"), capped))).drop("_total", "_level", "_found")


def sainte_lague(parties: DataFrame, seats: Column, weight: str, group: list[str], ties: list[Column], total: str) -> DataFrame:
    """Adds quota: seats dealt to the parties of each group by the highest quotients weight / (2k + 1).

    Two divisors bracket the one that fits: every party gets what the larger one gives it
    for sure, and only the quotients between both, about two for each party, are ranked.
    parties must hold the group's sum of weights in total.
    """
    w, n = Window.partitionBy(*group), F.col("_n")
    out = parties.withColumns({"_n": F.count("*").over(w), "_seats": seats})
    x = F.col(weight) / F.col(total)
    low = F.when((F.col(total) > 0) & (F.col("_seats") > n / 2), F.floor(x * (F.col("_seats") - n / 2) - 0.5 - 1e-9)).otherwise(0)
    low = F.greatest(F.lit(0).cast("bigint"), low)
    high = F.when(F.col(total) > 0, F.ceil(x * (F.col("_seats") + n / 2) + 0.5 + 1e-9)).otherwise(0)
    out = out.withColumns({"_low": low, "_high": F.greatest(low, high)})
    out = out.withColumn("_left", F.col("_seats") - F.sum("_low").over(w))
    asked = out.where("_high > _low").select("*", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"))
    ranked = asked.withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.col(weight) / (2 * F.col("_k") + 1)), *ties, F.col("_k"))))
    keys = [c for c in parties.columns]
    won = ranked.where(F.col("_rank") <= F.col("_left")).groupBy(*keys).agg(F.count("*").alias("_won"))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
    out = out.alias("p").join(won.alias("q"), same, "left").select(*[F.col(f"p.{c}").alias(c) for c in keys], (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cycle: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    block: int = 32,
    seed: int = 17,
    carry: list[str] | None = None,
    whole: bool = False,
) -> DataFrame:
    """For every document how many of its words the mix takes, repeats counted.

    The documents of a source are dealt to shards by a seeded hash and laid end to end in
    a seeded order; each shard's line of words is cut into blocks of equal length.
    Sainte-Lague apportionment deals the mix's blocks to the sources by target, then each
    source's blocks to its shards by size. A quota beyond the shard's blocks takes each once
    more; the rest of it is chosen evenly along the line from a seeded start, which is a
    random choice of documents as their order is random. How many chosen blocks lie before
    a position is a formula, so nothing is exploded or joined block by block.

    The number of shards of a source follows its share of the words and the square root of
    the number of documents: neither the shards of a source nor the documents of a shard
    outgrow one task, and a source with a third of all rows has a third of all shards.

    With whole, the rest of a shard's quota is chosen by documents: along the seeded order,
    those whose middle lies within it. So taken is always a multiple of size, and a shard
    misses its quota by half a document and half a block at most.

    Returns id, size, source_size, target, taken and the columns named in carry. Null texts
    have size 0 and take 0; a null source is one source, the last; rows with equal ids are
    separate documents, told apart by a hash of their text, so reruns agree on ties too (rows
    alike in id, size and text may swap); an empty table gives no rows.
    """
    kept = [c for c in (carry or []) if c not in (id_col, source_col)]
    docs = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), size_in_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("_h"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)])
    sizes = materialise(docs, "sizes")
    sources = materialise(capped_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs")), cycle, share, cap), "sources")
    n_sources, n_docs, total, wanted = sources.agg(F.count("*"), F.sum("_docs"), F.sum("source_size"), F.sum("target")).first()
    shards = max(1, math.isqrt(n_docs or 0))
    seats = F.lit(round((wanted or 0) / block)).cast("bigint")
    by_code = [F.col("source").isNull(), F.col("source").cast("binary")]
    sources = sources.withColumns({"_all": F.lit(float(wanted or 0)), "_shards": F.greatest(F.lit(1), F.round(F.col("source_size") * F.lit(shards / max(1, total or 1)))).cast("int"), "_one": F.lit(1)})
    sources = materialise(sainte_lague(sources, seats, "target", ["_one"], by_code, "_all").withColumnRenamed("quota", "_source_quota"), "quotas")
    dim = sources.select("source", "source_size", "target", "_shards", "_source_quota")
    placed = join_dimension(sizes, dim, "source", n_sources)
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "_id", "size", "_h"), F.col("_shards")).cast("int"))
    tokens = placed.groupBy("source", "_shard", "source_size", "_source_quota").agg(F.sum("size").alias("_tokens"))
    tokens = materialise(tokens, "shards")
    quotas = sainte_lague(tokens, F.col("_source_quota"), "_tokens", ["source"], [F.col("_shard")], "source_size")
    quotas = quotas.select(F.col("source").alias("_s"), F.col("_shard").alias("_sh"), "_tokens", "quota")
    line = Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(seed + 1), "_id", "size", "_h"), "_id", "size", "_h").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("_end", F.sum("size").over(line)).join(quotas, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_sh")), "left")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_tokens") / block)).cast("bigint")
    quota = F.least(F.col("quota"), blocks * cap)
    laid = laid.withColumns({"_blocks": blocks, "_rounds": F.floor(quota / blocks).cast("bigint"), "_rest": F.pmod(quota, blocks)})
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "_shard"), F.col("_blocks"))

    def chosen(k: Column) -> Column:
        """Of the first k blocks, those chosen beyond the full rounds."""
        return F.floor((k * F.col("_rest") + F.col("_start")) / F.col("_blocks")).cast("bigint")

    def words(x: Column) -> Column:
        """Of the first x words, those chosen."""
        k = F.floor(x / block).cast("bigint")
        return chosen(k) * block + (x - k * block) * (chosen(k + 1) - chosen(k))

    laid = laid.withColumn("_start", start)
    if whole:
        part = F.when(2 * F.col("_end") - F.col("size") <= 2 * block * F.col("_rest"), F.col("size")).otherwise(0)
    else:
        part = words(F.col("_end")) - words(F.col("_end") - F.col("size"))
    taken = F.when(F.col("size") > 0, F.col("_rounds") * F.col("size") + part).otherwise(0).cast("bigint")
    return laid.select(F.col("_id").alias(id_col), F.col("size"), "source_size", "target", taken.alias("taken"), F.col("source").alias(source_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)])

