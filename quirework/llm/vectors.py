"""Embedding near-dedup: spherical k-means cells, blocked cosine products within them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, join_hubs, materialise, release

#: Vectors the cells are fitted on, at most: those with the smallest hashes; and their bytes.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: Vectors that share a cell on average at least, cells at most, bytes of one side of a product.
CELL, MAX_CELLS, BLOCK_BYTES = 512, 1024, 32 << 20
#: Products that a vector is dealt to on average; beyond that, fewer cells are made.
COPIES = 3.0
#: Cores at most, and vectors of the sample that make one.
MAX_CORES, CORE = 256, 8
#: Vectors that are placed at once, bytes that are dealt at once, cosines that are looked at once.
SLICE, DEALT_BYTES, LOOK = 512, 8 << 20, 1 << 22


def margin_for(threshold: float) -> float:
    """How far beyond the border of its own cell a vector must be looked for.

    Vectors at a cosine of threshold are sqrt(2 - 2 threshold) apart, so of two on both
    sides of a border one is within half of that; rounding is left some room.
    """
    return float(np.sqrt(max(0.0, (1 - threshold) / 2))) + 1e-6


MARGIN = margin_for(0.9)


def fit_cells(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k unit centres, or fewer if there are fewer vectors; deterministic."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1)
        good = norm > 1e-9
        centres[good] = sums[good] / norm[good, None]
    return centres


def fit_cores(x: np.ndarray, threshold: float) -> np.ndarray:
    """Unit centres of the sample's dense groups, largest first: each has CORE vectors within
    half the threshold's angle, and no vector is counted for two."""
    near = np.sqrt((1 + threshold) / 2)
    y = x[:16_384].astype(np.float32)
    count = np.concatenate([(y[at : at + 1024] @ y.T >= near).sum(1) for at in range(0, len(y), 1024)]) if len(y) else np.zeros(0)
    free, cores = np.ones(len(y), bool), []
    for i in np.argsort(-count, kind="stable"):
        if count[i] < CORE or len(cores) == MAX_CORES:
            break
        if free[i]:
            group = free & (y @ y[i] >= near)
            if group.sum() >= CORE:
                centre = x[: len(y)][group].sum(0)
                cores.append(centre / np.linalg.norm(centre))
                free &= y @ cores[-1].astype(np.float32) < near
    return np.array(cores).reshape(-1, x.shape[1])


def _assign(x: np.ndarray, centres: np.ndarray, gaps: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """home cell of each vector, and for each vector and cell whether it is looked for there:
    where the border to that cell is nearer than margin."""
    sims = x @ centres.T
    home = sims.argmax(1)
    ahead = sims[np.arange(len(x)), home][:, None] - sims
    asked = ahead <= margin * gaps[home]
    asked[np.arange(len(x)), home] = False
    return home, asked


def _gaps(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (centres @ centres.T))) + 1e-7


@dataclass
class Cells:
    """centres of the cells and, numbered after them, the cores: groups so dense that any two
    of their vectors link, which need no products among themselves."""

    centres: np.ndarray
    cores: np.ndarray
    threshold: float
    margin: float

    def __post_init__(self) -> None:
        self.gaps = _gaps(self.centres)
        angle = np.arccos(np.clip(self.threshold, -1, 1))
        self.inside = np.cos(angle / 2) + 1e-9
        # A vector that links with one of a core lies within the threshold's angle of it.
        self.reach = np.cos(min(np.pi, 1.5 * angle)) - 1e-9

    def place(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """home and asked, as _assign gives them, over cells and cores. Of a vector in a core and
        one outside, the latter asks; of two in different cores, the one in the later core."""
        k = len(self.centres)
        home, asked = _assign(y, self.centres, self.gaps, self.margin)
        if not len(self.cores):
            return home, asked
        sims = y @ self.cores.T
        best = sims.argmax(1)
        inside = sims[np.arange(len(y)), best] >= self.inside
        home = np.where(inside, k + best, home)
        asked[inside] = False
        at_core = sims >= self.reach
        at_core[inside] &= np.arange(len(self.cores))[None, :] < best[inside, None]
        return home, np.concatenate((asked, at_core), axis=1)


def choose_cells(x: np.ndarray, n: int, threshold: float, margin: float) -> Cells:
    """The most cells for which a vector of the sample is dealt to no more than COPIES
    products; one cell (and plain blocks) where vectors have no such pattern."""
    cores = fit_cores(x, threshold)
    k = int(min(MAX_CELLS, n // CELL, len(x) // 8))
    while k > 1:
        cells = Cells(fit_cells(x, k), cores, threshold, margin)
        if 1 + cells.place(x[:2000])[1].sum(1).mean() <= COPIES:
            return cells
        k //= 2
    return Cells(fit_cells(x, 1), cores, threshold, margin)


def _unit(y: np.ndarray) -> np.ndarray:
    y = y.astype(float)
    y /= np.abs(y).max(1, keepdims=True)
    return y / np.linalg.norm(y, axis=1, keepdims=True)


def _forest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that join up what the hits between left and right link; fewer than ids."""
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    hit = hit[np.ix_(rows, cols)]
    a, b = left[rows].copy(), right[cols].copy()
    top = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(a, np.where(hit, b[None, :], top).min(1, initial=top))
        new_b = np.minimum(b, np.where(hit, new_a[:, None], top).min(0, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    u, v = np.concatenate((left[rows], right[cols])), np.concatenate((a, b))
    return u[u != v], v[u != v]


def hits(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For slices of a's rows, from which row, and which rows of b have a cosine of at least
    threshold. Single precision finds them; what it cannot settle is looked at in double."""
    room = 1e-7 * (a.shape[1] + 8)
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    step = max(1, LOOK // max(1, len(b)))
    for at in range(0, len(a), step):
        sims = a32[at : at + step] @ b32.T
        hit = sims >= threshold - room
        if not hit.any():
            continue
        i, j = np.nonzero(hit & (sims <= threshold + room))
        for k in range(0, len(i), 1 << 16):
            some = slice(k, k + (1 << 16))
            hit[i[some], j[some]] = np.einsum("ij,ij->i", a[at + i[some]], b[j[some]]) >= threshold
        yield at, hit


def _spans(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row n times its number, and 0, 1, ... n - 1."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    width = data.shape[1] * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data)])


LINKS = "u bigint, code bigint, v bigint, n bigint"


def find_links(one: DataFrame, dim: int, n: int, real: type, threshold: float, margin: float) -> DataFrame:
    """For vectors one(v, code, node, mult) of one length: rows (u, code, null, n) for how many
    others link with a vector, and rows (u, null, v, 0) that join up what links."""
    least = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = one.orderBy("code", "node").limit(least).select("v").toPandas()
    cells = choose_cells(_unit(np.array(sample["v"].tolist(), real).reshape(-1, dim)), n, threshold, margin)
    k = len(cells.centres)
    every = k + len(cells.cores)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                y = batch.column(0).flatten().to_numpy().reshape(-1, dim)
                yield batch, y, *cells.place(_unit(y))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, other = np.zeros(every, np.int64), np.zeros(every, np.int64)
        for _, _, home, asked in placed(batches):
            own += np.bincount(home, minlength=every)
            other += asked.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(every)), pa.array(own), pa.array(other)], names=["cell", "own", "other"])

    counts = np.zeros((every, 2), np.int64)
    for cell, own, other in one.select("v").mapInArrow(tally, "cell bigint, own bigint, other bigint").groupBy("cell").agg(F.sum("own"), F.sum("other")).collect():
        counts[cell] = own, other
    block = max(256, BLOCK_BYTES // (dim * np.dtype(real).itemsize))
    members, guests = np.maximum(1, -(-counts // block)).T
    if k < 8:  # few cells: their blocks keep the cores busy
        members[:k] = np.maximum(members[:k], np.clip(counts[:k, 0] // 2048, 1, 2))
    core = np.arange(every) >= k
    # Products that a member takes part in: with its cell's blocks, and with further parts of the guests.
    with_blocks = np.where(core, (counts[:, 1] > 0).astype(np.int64), members)
    with_all = with_blocks + np.maximum(0, guests - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to every product that it takes part in. Block b of a cell is compared
        with itself and the cell's first part of guests (b, b), with later blocks (b, other)
        and with further parts of the guests (b, blocks + part)."""
        for batch, y, home, asked in placed(batches):
            code = batch.column("code").to_numpy()
            mixed = code.view(np.uint64)
            mine = (mixed % members[home].astype(np.uint64)).astype(np.int64)
            row, step = _spans(with_all[home])
            cell, b = home[row], mine[row]
            other = np.where(core[cell], b, step)
            block_now = step < with_blocks[cell]
            low, high = np.where(block_now, np.minimum(b, other), b), np.where(block_now, np.maximum(b, other), members[cell] + 1 + step - with_blocks[cell])
            side = (block_now & (b > other)).astype(np.int64)
            i, c = np.nonzero(asked)
            some = counts[c, 0] > 0
            i, c = i[some], c[some]
            part = ((mixed[i] // np.uint64(7)) % guests[c].astype(np.uint64)).astype(np.int64)
            r, at_block = _spans(members[c])
            guest_high = np.where(part[r] == 0, at_block, members[c[r]] + part[r])
            where = [np.concatenate(p) for p in ((row, i[r]), (cell, c[r]), (low, at_block), (high, guest_high), (side, np.full(len(r), 2)))]
            ask_row, ask_cell = np.nonzero(asked[:, :k])
            starts = np.append(0, np.cumsum(np.bincount(ask_row, minlength=len(home)))).astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(home), [None, pa.py_buffer((2 * starts).astype(np.int32)), pa.py_buffer(ask_cell.astype(np.uint16))])
            node, mult = batch.column("node"), batch.column("mult")
            most = max(1, DEALT_BYTES // (y.shape[1] * y.itemsize))
            for s in range(0, len(where[0]), most):
                at, *key = (w[s : s + most] for w in where)
                pick = pa.array(at)
                cols = [*map(pa.array, key), node.take(pick), mult.take(pick), pa.array(code[at]), pa.array(home[at]), _binary(y[at]), lists.take(pick)]
                yield pa.RecordBatch.from_arrays(cols, names=["cell", "b1", "b2", "side", "node", "mult", "code", "home", "y", "asked"])

    def product(group: pd.DataFrame) -> pd.DataFrame:
        cell = int(group["cell"].iloc[0])
        own = bool(group["b1"].iloc[0] == group["b2"].iloc[0])
        rows = {s: g for s, g in group.groupby("side")}
        unit = {s: _unit(np.frombuffer(b"".join(g["y"]), real).reshape(-1, dim)) for s, g in rows.items()}
        found: list[tuple] = []
        total = {s: np.zeros(len(g)) for s, g in rows.items()}

        def compare(s: int, t: int) -> None:
            if s not in rows or t not in rows:
                return
            a, b = rows[s], rows[t]
            ia, ib, ma, mb = a["node"].to_numpy(), b["node"].to_numpy(), a["mult"].to_numpy(), b["mult"].to_numpy()
            away = b["home"].to_numpy()
            for at, hit in hits(unit[s], unit[t], threshold):
                if s == t:
                    i = np.arange(len(hit))
                    hit[i, at + i] = False
                i, j = np.nonzero(hit)
                if t == 2 and cell < k and len(i):
                    # If the member is looked for in the other's home as well, the lower cell counts.
                    for r in np.unique(i).tolist():
                        asks = np.zeros(every, bool)
                        asks[np.frombuffer(a["asked"].iloc[at + r], np.uint16)] = True
                        hit[r] &= ~(asks[away] & (away < cell))
                    i, j = np.nonzero(hit)
                if not len(i):
                    continue
                total[s][at : at + len(hit)] += np.bincount(i, weights=mb[j], minlength=len(hit))
                if s != t:
                    total[t] += np.bincount(j, weights=ma[at + i], minlength=len(ib))
                found.append(_forest(hit, ia[at : at + len(hit)], ib))

        if not own:
            compare(0, 1)
        elif cell < k:
            compare(0, 0)
        compare(0, 2)
        out = []
        if found:
            pairs = np.unique(np.concatenate([np.stack(f, 1) for f in found]), axis=0)
            out.append(pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1], "n": 0}))
        for s, g in rows.items():
            some = total[s] > 0
            if some.any():
                out.append(pd.DataFrame({"u": g["node"].to_numpy()[some], "code": g["code"].to_numpy()[some], "n": total[s][some].astype(np.int64)}))
        if not out:
            return pd.DataFrame({"u": [], "code": [], "v": [], "n": []}, dtype="int64")
        out = pd.concat([o.astype("Int64") for o in out], ignore_index=True)
        return out.reindex(columns=["u", "code", "v", "n"])

    dealt = one.select("v", "code", "node", "mult").mapInArrow(deal, "cell bigint, b1 bigint, b2 bigint, side bigint, node bigint, mult bigint, code bigint, home bigint, y binary, asked binary")
    found = dealt.groupBy("cell", "b1", "b2").applyInPandas(product, LINKS)
    if len(cells.cores):
        found = found.unionByName(_core_links(one, placed, k))
    return materialise(found, "products")


def _core_links(one: DataFrame, placed, k: int) -> DataFrame:
    """What links within cores, in rows as find_links gives them: everything with everything."""

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, home, _ in placed(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "mult", "code")), pa.array(home)], names=["node", "mult", "code", "core"]).filter(pa.array(home >= k))

    inside = materialise(one.select("v", "node", "mult", "code").mapInArrow(homes, "node bigint, mult bigint, code bigint, core bigint"), "cores")
    # At most MAX_CORES rows.
    whole = inside.groupBy("core").agg(F.sum("mult").alias("all"), F.min("node").alias("first"))
    both = inside.join(F.broadcast(whole), "core")
    none = F.lit(None).cast("bigint")
    counts = both.select(F.col("node").alias("u"), "code", none.alias("v"), (F.col("all") - F.col("mult")).alias("n")).where("n > 0")
    return counts.unionByName(both.where("node <> first").select(F.col("node").alias("u"), none.alias("code"), F.col("first").alias("v"), F.lit(0).cast("bigint").alias("n")))


def dedup_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, margin: float | None = None) -> DataFrame:
    """id, n_links, component_id and kept for every vector, by cosine >= threshold.

    Exact copies (equal in 128 bits of hash) are one vector from the start. Cells are fitted on
    a bounded sample, every vector has a home, and it is also compared with the cells whose
    border is nearer than margin. Unless margin is given, it is wide enough that no link is
    lost (margin_for); vectors without any pattern are then all compared, in one cell. Dense
    groups of the sample become cores, whose vectors all link and are counted without products.
    The cells' members are dealt to blocks of bounded size, a hot cell to many; each pair of
    blocks is one product, which gives counts and a spanning forest, never its pairs.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.
    Vectors of different lengths do not link; each length has its own cells, one after
    the other. Rows with null ids link with nothing and have no component. Rows with equal ids
    are separate vectors of one id. Extra columns are ignored; an empty table gives no rows.
    """
    margin = margin_for(threshold) if margin is None else margin
    kind = vectors.schema[id_col].dataType
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    largest = F.lit(float(np.finfo(float).max))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= largest), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("v", F.when(F.coalesce(fine, F.lit(False)), F.transform("v", lambda x: x + F.lit(0.0).cast("float" if single else "double"))))
    keyed = rows.withColumns({"code": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")), "code2": F.xxhash64(F.lit(2), "v")})
    one = keyed.where("v is not null").groupBy("code", "code2").agg(F.first("v").alias("v"), F.min("id").alias("node"), F.count("*").alias("mult"))
    one = materialise(one, "distinct")
    found = None
    for dim, n in sorted(one.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where("n > 1").collect()):
        part = find_links(one.where(F.size("v") == dim), dim, n, np.float32 if single else np.float64, threshold, margin)
        found = part if found is None else found.unionByName(part)
    nodes = one.select("code", "code2", "node", "mult")
    if found is None:
        nodes = nodes.withColumns({"others": F.lit(0), "component": F.lit(None).cast("bigint")})
    else:
        counted = found.where("n > 0").groupBy(F.col("u").alias("node"), "code").agg(F.sum("n").alias("others"))
        nodes = nodes.join(counted, ["node", "code"], "left").join(components(found.where("n = 0").select("u", "v")), "node", "left")
    nodes = materialise(nodes.select("code", "code2", F.col("mult").alias("pairs"), (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "nodes")
    release(one, *([] if found is None else [found]))
    out = join_hubs(keyed.select("id", "code", "code2"), nodes, ["code", "code2"], nodes.agg(F.sum("pairs")).first()[0] or 0, "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").cast(kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
