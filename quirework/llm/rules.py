"""Quality rules: tokenizer fertility with rejection bands per language."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, materialise, small_batches
from .tokens import Kept, PieceBPE, default_path

SYMBOLS = "#*$%&|<>"
METRICS = ("chars_per_token", "fallback_share", "token_entropy")
#: Width of the bins in which metrics are counted over all documents.
BIN = 0.01
COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, n_tokens bigint, chars_per_token double, fallback_share double, token_entropy double"


def repeat_words(codes: np.ndarray, window: int = 3) -> int:
    """How many words lie in windows that stand twice or more; codes number the words."""
    n = len(codes) - window + 1
    if n < 2:
        return 0
    key = codes[:n].astype(np.int64)
    for k in range(1, window):
        # Renumbered at each step, so that keys stay exact whatever the number of words.
        key = np.unique(key, return_inverse=True)[1] * (int(codes.max()) + 1) + codes[k : k + n] if int(codes.max()) >= 1 << 20 else (key << 20) + codes[k : k + n]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(counts[inverse] > 1)
    covered = np.zeros(len(codes), bool)
    for k in range(window):
        covered[hit + k] = True
    return int(covered.sum())


def measure(docs: DataFrame, keep: list[str], text_col: str, path: str) -> DataFrame:
    """keep and the measures of every whole text."""
    from pyspark.sql.types import StructType

    schema = StructType(docs.select(*keep).schema.fields).add("_m", StructType.fromDDL(COLUMNS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceBPE(path)
        continuing = np.arange(256) & 0xC0 == 0x80
        spaces, symbols = [9, 10, 11, 12, 13, 32], [ord(c) for c in SYMBOLS]
        codes = Kept(lambda w: len(codes))
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = []
                for text in batch.column(batch.num_columns - 1):
                    t = (text.as_py() or "").encode()
                    words = t.split()
                    ids = model.encode(words)
                    codes.trim()
                    seq = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
                    count = np.bincount(np.frombuffer(t, np.uint8), minlength=256)
                    chars = int(count.sum() - count[continuing].sum() - count[spaces].sum())
                    lines = [x for x in t.split(b"\n") if x.strip()]
                    n = len(ids)
                    freq = np.bincount(ids) if n else np.zeros(1)
                    p = freq[freq > 0] / max(1, n)
                    entropy = float(-(p * np.log2(p)).sum() / np.log2(n)) if n > 1 else 1.0
                    rows.append((len(words), chars, int(count[symbols].sum()), len(lines) - len(set(lines)), repeat_words(seq), n, chars / n if n else 0.0, float(model.is_byte[ids].mean()) if n else 0.0, max(0.0, entropy)))
                kinds = [pa.int64()] * 6 + [pa.float64()] * 3
                names = [c.split()[0] for c in COLUMNS.split(", ")]
                cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.StructArray.from_arrays(cols, names=names)], names=[*keep, "_m"])

    return docs.select(*keep, F.col(text_col).alias("_t")).mapInArrow(scan, schema).select(*keep, "_m.*")


def group_of(lang_col: str) -> Column:
    """The language and the power of two of the number of tokens."""
    return F.concat_ws("|", F.floor(F.log2(F.greatest(F.lit(1), F.col("n_tokens")))).cast("string"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")))


def rejection_bands(measured: DataFrame, group: str, min_tokens: int, width: dict[str, float], floor: dict[str, float]) -> DataFrame:
    """group and, for each metric, low_ and high_: from which value to which a text passes.
    One row for each group that has a text of at least min_tokens tokens.

    Each metric is counted in bins over all texts of at least min_tokens tokens; the band
    goes width times the distance from the median to the first and third quartile beyond the
    median, and the distance counts as at least floor. Windows run over bins, never texts.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.floor(F.col(m) / BIN).alias("bin")) for m in METRICS])).alias("e")
    bins = measured.where(F.col("n_tokens") >= min_tokens).select(group, each).groupBy(group, "e.metric", "e.bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy(group, "metric")
    share = F.sum("n").over(whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(whole)
    bins = bins.withColumns({"share": share, "at": (F.col("bin") + 0.5) * BIN})

    def band(m: str) -> list[Column]:
        low, mid, high = (F.min(F.when((F.col("metric") == m) & (F.col("share") >= q), F.col("at"))) for q in (0.25, 0.5, 0.75))
        return [(mid - width[m] * F.greatest(mid - low, F.lit(floor[m]))).alias(f"low_{m}"), (mid + width[m] * F.greatest(high - mid, F.lit(floor[m]))).alias(f"high_{m}")]

    return bins.groupBy(group).agg(*[c for m in METRICS for c in band(m)])


def apply_rules(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    path: str | None = None,
    keep: list[str] | None = None,
    min_tokens: int = 64,
    width: tuple[float, float, float] = (9.0, 9.0, 6.0),
    floor: tuple[float, float, float] = (0.02, 0.01, 0.005),
) -> DataFrame:
    """Columns of docs (those in keep, all but the text by default) with the measures, base_failed and kept.

    base_failed: under 50 words, or over half of them in repeated 3-word windows. Other texts
    are kept unless a metric of the public vocabulary lies outside the band of its language and size:
    characters per token, the share of byte-fallback tokens, and the tokens' entropy as a
    share of the largest their number allows. Texts under min_tokens tokens have no band.
    Null texts have no words; null languages are one language; columns with the name of a
    measure or of a band (low_, high_) are replaced; repeated rows stay; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    path = path or default_path("piece_bpe_32k.model")
    own = {c.split()[0] for c in COLUMNS.split(", ")} | {f"{side}_{m}" for m in METRICS for side in ("low", "high")} | {"base_failed", "kept", "_t", "_m", "_lang", "_group"}
    keep = [c for c in (keep or docs.columns) if c not in own and c != text_col]
    lang = F.col(lang_col) if lang_col in docs.columns else F.lit(None).cast("string")
    measured = materialise(measure(docs.withColumn("_lang", lang), [*keep, "_lang"], text_col, path), "measures").withColumn("_group", group_of("_lang"))
    bands = materialise(rejection_bands(measured, "_group", min_tokens, dict(zip(METRICS, width)), dict(zip(METRICS, floor))), "bands")

    def outside(m: str) -> Column:
        return F.coalesce(~F.col(m).between(F.col(f"low_{m}"), F.col(f"high_{m}")), F.lit(False))

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = (F.col("n_tokens") >= min_tokens) & (outside(METRICS[0]) | outside(METRICS[1]) | outside(METRICS[2]))
    judged = join_small(measured, bands, ["_group"], "left", bands.count())
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~odd)
    return judged.drop("_lang", "_group", *[f"{side}_{m}" for m in METRICS for side in ("low", "high")])
