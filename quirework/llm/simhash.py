"""SimHash near-dedup with the generalised pigeonhole principle.

Fingerprints within 3 bits agree closely on at least one of m parts of the 64 bits:
with thresholds t_1..t_m that sum up to 3 - m + 1, some part differs by at most its
t_i. Bits that go together are put into one part, so the parts are selective; the
thresholds come from dynamic programming over estimated candidate counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, join_hubs, materialise, small_batches

BITS = 64
#: Members of a bucket that one task compares; larger ones are split by further bits.
BUCKET = 8192
#: What one more signature for each fingerprint costs, in candidate pairs.
SIGNATURE_COST = 4.0


def fingerprint_words(words: list[bytes], shingle: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    """The SimHash of a sequence of words; 0 if there are none."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    ends = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, chunk):
        h = np.fromiter([xxh64_intdigest(text[a:b], seed) for a, b in zip(starts[at : at + chunk], ends[at : at + chunk])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, carry: dict | None = None) -> DataFrame:
    """id_col, fp bigint (the 64 bits) and the columns of carry (name: bigint column) of every whole
    text; null texts have no words."""
    carry = carry or {}
    more = list(carry)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_words((t.as_py() or "").encode().lower().split()) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *more])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *[c.cast("bigint").alias(k) for k, c in carry.items()]).mapInArrow(scan, ", ".join([f"id {kind}", "fp bigint", *[f"{k} bigint" for k in more]]))
    return out.withColumnRenamed("id", id_col)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and for each two bits how many have both (64 x 64)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both, n = both + bits.T @ bits, n + len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(both.ravel(), n).astype(np.int64))], names=["cell", "n"])

    rows = fps.select("fp").mapInArrow(scan, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for cell, n in rows:
        flat[cell] = n
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """The bits in m parts of almost equal size, each grown by the bit that goes with it most."""
    share = np.diag(both) / max(1, n)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    corr = np.abs(both / max(1, n) - np.outer(share, share)) / np.outer(spread, spread)
    left, parts = set(range(BITS)), []
    for k in range(m):
        size = len(left) // (m - k)
        pool = sorted(left)
        part = [max(pool, key=lambda b: (corr[b, pool].sum(), -b))]
        while len(part) < size:
            rest = sorted(left - set(part))
            part.append(max(rest, key=lambda b: (corr[b, part].mean(), -b)))
        parts.append(sorted(part))
        left -= set(part)
    return parts


def to_mask(bits: list[int]) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >= 1 << 63 else x


def same_pairs(fps: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, how many pairs of fingerprints agree under it, counted over all of them."""
    keyed = fps.select(F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("part", "mask"), "fp").select("part", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))
    n = F.col("n").cast("double")
    rows = keyed.groupBy("part", "value").agg(F.count("*").alias("n")).groupBy("part").agg(F.sum(n * (n - 1) / 2)).collect()
    found = dict(map(tuple, rows))
    return [found.get(k, 0.0) for k in range(len(masks))]


def allocate(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1: the part is not asked) that sum up to total at the least cost, by
    dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, x in cost.items():
                if used + t not in new or c + x < new[used + t][0]:
                    new[used + t] = (c + x, [*chosen, t])
        best = new
    return best[total]


def plan_masks(fps: DataFrame, distance: int = 3) -> list[int]:
    """The signatures: two fingerprints within distance agree under at least one mask."""
    n, both = bit_counts(fps)
    share = np.diag(both) / max(1, n)
    agree = np.clip(share**2 + (1 - share) ** 2, 0.5, 1.0)
    choices = {m: correlated_parts(n, both, m) for m in range(2, distance + 2)}
    flat = [p for parts in choices.values() for p in parts]
    found = iter(same_pairs(fps, [to_mask(p) for p in flat]))
    best = None
    for m, parts in choices.items():
        costs = []
        for p in parts:
            zero, odds = next(found), (1 - agree[p]) / agree[p]
            s1, s2, s3 = odds.sum(), (odds**2).sum(), (odds**3).sum()
            sums = [1.0, s1, (s1**2 - s2) / 2, (s1**3 - 3 * s1 * s2 + 2 * s3) / 6]
            w, costs_p = len(p), {-1: 0.0}
            signatures = [1, w, w * (w - 1) / 2, w * (w - 1) * (w - 2) / 6]
            for t in range(distance + 1):
                costs_p[t] = zero * sum(sums[: t + 1]) + SIGNATURE_COST * n * signatures[t]
            costs.append(costs_p)
        cost, thresholds = allocate(costs, distance - m + 1)
        if best is None or cost < best[0]:
            best = cost, parts, thresholds
    masks = []
    for p, t in zip(best[1], best[2]):
        if t >= 0:
            masks += [to_mask([b for b in p if b not in out]) for out in combinations(p, t)]
    return masks


def narrower(mask: int, distance: int) -> list[int]:
    """Masks for pairs that agree under mask: the other bits in distance + 1 parts."""
    free = [b for b in range(BITS) if not (mask >> b) & 1]
    fixed = [b for b in range(BITS) if (mask >> b) & 1]
    return [to_mask(sorted(fixed + free[k :: distance + 1])) for k in range(distance + 1)] if len(free) > distance else []


def close_pairs(fp: np.ndarray, run: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that join up everything within distance in the runs of equal run numbers.

    Short runs are compared shift by shift across all of them; in a long one, components
    grow from their first member, so it gives fewer pairs than members.
    """
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
    sizes = np.diff(np.append(starts, len(run)))
    short = np.repeat(sizes <= 64, sizes)
    for d in range(1, min(64, int(sizes.max(initial=1)))):
        i = np.flatnonzero(short[:-d] & (run[:-d] == run[d:]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= distance]
        yield i, i + d
    for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
        left = np.arange(s, s + n)
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                at = queue.pop()
                near = np.bitwise_count(fp[left] ^ fp[at]) <= distance
                if near.any():
                    got, left = left[near], left[~near]
                    queue += got.tolist()
                    yield np.full(len(got), at), got


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """u, v: pairs of nodes(fp, node) that join up all within distance. fp must be distinct."""
    masks = plan_masks(nodes, distance)

    def keyed(rows: DataFrame, masks: list) -> DataFrame:
        return rows.select("fp", "node", F.explode(masks).alias("mask")).select("fp", "node", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"))

    rows, parts = keyed(nodes, F.array(*[F.lit(m).cast("bigint") for m in masks])), []
    while True:
        hot = materialise(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).drop("n"), "hot")
        asked = [r[0] for r in hot.select("mask").distinct().collect()]
        deeper = {m: narrower(m, distance) for m in asked}
        if not any(deeper.values()):
            parts.append(rows)
            break
        # With so many bits fixed that no part is left, a bucket holds at most 2^3 fingerprints.
        parts.append(rows.join(hot, ["mask", "value"], "left_anti"))
        cases = F.create_map(*[x for m, ms in deeper.items() for x in (F.lit(m).cast("bigint"), F.array(*[F.lit(k).cast("bigint") for k in ms]))])
        rows = keyed(rows.join(hot, ["mask", "value"], "left_semi").withColumn("masks", F.try_element_at(cases, F.col("mask"))).drop("mask", "value"), F.col("masks"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        empty = np.zeros((0, 4), np.int64)

        def done(x: np.ndarray) -> Iterator[pa.RecordBatch]:
            run = np.cumsum(np.append(False, (x[1:, :2] != x[:-1, :2]).any(1)))
            for i, j in close_pairs(x[:, 2].view(np.uint64), run, distance):
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(x[i, 3]), pa.array(x[j, 3])], names=["u", "v"])

        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy() for k in range(4)]) if batch.num_rows else empty
            if not len(x):
                continue
            # The last run may go on in the next batch.
            other = np.flatnonzero((x[:, :2] != x[-1, :2]).any(1))
            cut = other[-1] + 1 if len(other) else 0
            if held and (cut or (x[0, :2] != held[-1][0, :2]).any()):
                yield from done(np.concatenate([*held, x[:cut]]))
                held = [np.ascontiguousarray(x[cut:])]
            elif cut:
                yield from done(x[:cut])
                held = [np.ascontiguousarray(x[cut:])]
            else:
                held.append(x)
        if held:
            yield from done(np.concatenate(held))

    found = [p.select("mask", "value", "fp", "node").repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(compare, "u bigint, v bigint") for p in parts]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def dedup_simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (smallest id reachable) of every document.

    Null and empty texts have fingerprint zero, which links like any other. Rows with equal
    ids are separate documents of one id; rows with a null id are documents too, and have the
    component of what they reach, null if nothing there has an id. Other columns are ignored;
    an empty table gives no rows. Ids must be integers.
    """
    small_batches(docs.sparkSession)
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    groups, n = group_fingerprints(fps, id_col, distance)
    out = join_hubs(fps, groups.drop("group"), ["fp"], n)
    return out.select(F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id").cast(docs.schema[id_col].dataType))


def group_fingerprints(fps: DataFrame, id_col: str, distance: int) -> tuple[DataFrame, int]:
    """For each fingerprint its group (the smallest fingerprint reachable), component_id (the smallest
    id of the group, null if it has none) and pairs, its documents; and the number of all."""
    nodes = materialise(fps.groupBy("fp").agg(F.min(id_col).cast("bigint").alias("first"), F.count("*").alias("pairs")), "nodes")
    found = components(links(nodes.select("fp", F.col("fp").alias("node")), distance)).select(F.col("node").alias("fp"), F.col("component").alias("group"))
    groups = materialise(nodes.join(found, "fp", "left").withColumn("group", F.coalesce("group", "fp")), "groups")
    total, n = groups.agg(F.count("*"), F.sum("pairs")).first()
    least = materialise(groups.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("pairs")), "least")
    marked = join_hubs(groups.select("group", "fp", F.col("pairs").alias("docs")), least, ["group"], total)
    return materialise(marked.withColumnRenamed("docs", "pairs"), "groups"), n or 0


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest id, of equal ids that of the smallest
    hash of its text. Rows without an id come after all others. Of rows that repeat id and text
    one stays.

    Rows are told by id and 96 bits of hash of their text. Only keys move, and the texts of
    rows that stand more than once; the keys that go are joined back.
    """
    small_batches(docs.sparkSession)
    told = {"_h1": F.xxhash64(text_col), "_h2": F.hash(text_col).cast("bigint")}
    fps = materialise(fingerprints(docs, id_col, text_col, told), "fingerprints")
    groups, n = group_fingerprints(fps, id_col, distance)
    rows = fps.groupBy(id_col, "fp", *told).agg(F.count("*").alias("_n"))
    rows = materialise(join_hubs(rows, groups.drop("component_id"), ["fp"], n), "rows")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *told)
    best = materialise(rows.groupBy("group").agg(F.min(key).alias("_first"), F.count("*").alias("pairs")), "best")
    judged = join_hubs(rows, best, ["group"], n).select(id_col, *told, "_n", (key == F.col("_first")).alias("_stays"))
    judged = materialise(judged, "judged")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_i"), *[c.alias(k) for k, c in told.items()])

    def among(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col(id_col).alias("_id"), *[F.col(c).alias("_k" + c) for c in told])
        same = F.col("_i").eqNullSafe(F.col("_id"))
        for c in told:
            same = same & (F.col(c) == F.col("_k" + c))
        return left.join(k, same, how)

    first = among(keyed, judged.where("not _stays"), "left_anti")
    again = judged.where("_stays and _n > 1")
    if again.limit(1).count():
        one = among(first, again, "left_semi").dropDuplicates(["_i", *told])
        first = among(first, again, "left_anti").unionByName(one)
    return first.select("row.*")
