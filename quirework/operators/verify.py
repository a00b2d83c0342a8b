"""Nothing may be lost: multisets of numbers and units, reports, caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import fold_digits


def tokens(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, token, n: the multiset of what the pattern finds, digits folded to ASCII."""
    found = F.regexp_extract_all(fold_digits(F.col(text)), F.lit(f"({pattern})"), 1)
    return df.select(key, F.explode(found).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def multiset_difference(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """key, token, missing, added: where the counts differ."""
    a, b = source.withColumnRenamed("n", "_a"), target.withColumnRenamed("n", "_b")
    both = a.join(b, [key, "token"], "full").fillna(0, ["_a", "_b"])
    d = F.col("_a") - F.col("_b")
    return both.where(d != 0).select(key, "token", F.greatest(d, F.lit(0)).alias("missing"), F.greatest(-d, F.lit(0)).alias("added"))


def units_pattern() -> str:
    longest = sorted(P.UNITS, key=len, reverse=True)
    return "(?<![A-Za-z])(?:" + "|".join(map(re.escape, longest)) + ")(?![A-Za-z])"


def run_report(outcomes: DataFrame, key: str) -> DataFrame:
    """total = done + failed + skipped for each key, with the first three failures."""
    of = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    failures = F.slice(F.array_sort(F.collect_list(F.when(F.col("outcome") == "failed", F.col("rn")))), 1, 3)
    return outcomes.groupBy(key).agg(F.count("*").alias("total"), of("done"), of("failed"), of("skipped"), F.array_join(failures, ",").alias("first_failures"))


def cached_work(items: DataFrame, cache: DataFrame, key: Column) -> DataFrame:
    """Items with key and hit; misses are what has to be computed and appended."""
    keyed = items.withColumn("key", key)
    known = cache.select("key").distinct().withColumn("hit", F.lit(True))
    return keyed.join(known, "key", "left").fillna(False, ["hit"])
