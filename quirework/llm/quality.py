"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature in turn gets a shallow tree over its bins,
fitted to the gradient that all others leave; then pairs of features get trees over pairs of
coarse bins. What remains is one lookup table for each feature and pair: a score is a sum
of table entries, added up for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

#: Labelled rows the model is fitted on, at most: those with the smallest hash of their id.
SAMPLE = 20_000
FEATURES = ("log_words", "word_bytes", "distinct", "adjacent", "pairs", "upper", "digits", "symbols", "bangs", "bars", "stops", "other", "lines", "repeated_lines", "byte_entropy", "long_words")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; all zero for null and empty ones."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    letters = max(1, int(count[65:91].sum() + count[97:123].sum()))
    share = count[count > 0] / size
    lines = raw.split(b"\n")
    return [
        float(np.log1p(n)),
        (size - n) / n,
        len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / n,
        float(count[65:91].sum()) / letters,
        float(count[48:58].sum()) / size,
        float(count[[35, 36, 37, 38, 42, 60, 62]].sum()) / n,
        float(count[33]) / n,
        float(count[124]) / n,
        float(count[[44, 46, 58, 59, 63]].sum()) / n,
        float(count[128:].sum()) / size,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        float(-(share * np.log2(share)).sum()),
        sum(len(w) > 20 for w in words) / n,
    ]


@dataclass
class AdditiveModel:
    """cuts: inner edges of each feature's bins; tables: its values; coarse: for each feature the
    coarse bin of each bin; pairs: (i, j) with a table over their coarse bins."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)]

    def raw(self, x: np.ndarray) -> np.ndarray:
        at = self.bins(x)
        out = np.full(len(x), self.base)
        for table, b in zip(self.tables, at):
            out += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[self.coarse[i][at[i]], self.coarse[j][at[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """The gain and place of the best cut through summed gradients and weights."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    ok = (ch >= least) & (th - ch >= least)
    gain = np.where(ok, cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1), 0.0)
    k = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[k]), k + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """The values of a tree with so many leaves over ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*_best_cut(g[a:b], h[a:b], least), a, b) for a, b in parts]
        gain, cut, a, b = max(found, key=lambda f: (f[0], -f[2]))
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The gain and values of a tree that cuts one axis, then each side along the other."""
    best = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        _, cut = _best_cut(gg.sum(1), hh.sum(1), least)
        # Interactions often show in no single axis, so the middle cuts are tried as well.
        for c in sorted({cut, len(gg) // 2, len(gg) // 4, 3 * len(gg) // 4} - {0, len(gg)}):
            out, gain = np.zeros_like(gg), -gg.sum() ** 2 / (hh.sum() + 1)
            for rows in (slice(0, c), slice(c, None)):
                _, k = _best_cut(gg[rows].sum(0), hh[rows].sum(0), least)
                for cols in (slice(0, k), slice(k, None)) if k else (slice(None),):
                    sg, sh = gg[rows, cols].sum(), hh[rows, cols].sum()
                    out[rows, cols] = sg / (sh + 1)
                    gain += sg**2 / (sh + 1)
            if gain > best[0] + 1e-12:
                best = (float(gain), out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1, n_bins: int = 64, n_coarse: int = 8, n_pairs: int = 8, pair_rounds: int = 60, leaves: int = 4, least: float = 3.0) -> AdditiveModel:
    """A model for labels y of 0 and 1. Deterministic; without rows, or with rows of one label,
    it scores all alike."""
    n, d = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_bins + 1)[1:-1])) if n else np.zeros(0) for k in range(d)]
    model = AdditiveModel(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [np.arange(len(c) + 1) * n_coarse // (len(c) + 1) for c in cuts], [], [])
    if not n or y.min() == y.max():
        return model
    at = model.bins(x)
    raw = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k in range(d):
            g, h = slopes()
            size = len(model.tables[k])
            step = rate * np.clip(_tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size), leaves, least), -4, 4)
            model.tables[k] += step
            raw += step[at[k]]
    low = [model.coarse[k][at[k]] for k in range(d)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        cell = low[i] * n_coarse + low[j]
        return tuple(np.bincount(cell, v, n_coarse**2).reshape(n_coarse, n_coarse) for v in (g, h))

    gains = sorted(((_pair_tree(*grid(i, j), least)[0], i, j) for i in range(d) for j in range(i)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((n_coarse, n_coarse)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = rate * np.clip(_pair_tree(*grid(i, j), least)[1], -4, 4)
            table += step
            raw += step[low[i], low[j]]
    return model


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32(id as text) mod folds is 0; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> AdditiveModel:
    """A model fitted on at most sample labelled rows that are not held out.

    Ids labelled twice count with their smallest label; null ids and labels do not count. The
    sample has the ids with the smallest hashes, so it is the same on every run; its ids are
    at most sample rows, which is what the broadcast and the driver get. Of rows with equal
    ids one counts.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    chosen = usable.groupBy(id_col).agg(F.min(label_col).cast("double").alias("_y")).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id2")), F.col("_id") == F.col("_id2"))
    wide = ", ".join(f"f{k} double" for k in range(len(FEATURES)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(2)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, x.T.copy())], names=["id", "y", *[f"f{k}" for k in range(len(FEATURES))]])

    kind = docs.schema[id_col].dataType.simpleString()
    made = rows.select("_id", "_y", "_t").mapInArrow(scan, f"id {kind}, y double, {wide}")
    got = made.groupBy("id").agg(F.min(F.struct("y", *[f"f{k}" for k in range(len(FEATURES))])).alias("r")).select("id", "r.*").toPandas().sort_values("id")
    return fit(got.iloc[:, 2:].to_numpy(float), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on), for every whole text.

    Null texts score as empty ones. All columns stay, but older ones named score or
    predicted; repeated rows stay; an empty table gives no rows.
    """
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields, *StructType.fromDDL("score double, predicted int").fields])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(at)]).reshape(-1, len(FEATURES))
            score = model.score(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(scan, schema)
