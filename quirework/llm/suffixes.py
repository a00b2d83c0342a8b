"""Suffix-array dedup with a logarithmic family of indexes.

A string of min_bytes bytes holds w = min_bytes - K + 1 places where K bytes start. The
leftmost of those with the smallest code is the string's anchor, and equal strings have
equal anchors at equal distances; so suffixes need indexing at anchors only, some 2.5 % of
all places. Consecutive strings with one anchor are a run.

An array is a batch's anchor suffixes sorted by the code of their first K bytes, then by
the code of the run's bytes. Arrays are cut into shards by the first bits of the code. In a
shard every new batch is merge-scanned against the existing levels: of equal runs the
earliest stays and the later are long matches, known without a look at the text. Levels of
equal size merge, as a binary counter carries. In the end suffixes that agree in their
first K bytes but not in their runs are what the ends of matches look like; for those
alone the runs' bytes are fetched and compared string by string.

A batch is cut by a few bits only; where there are more shards than that, further passes
cut on, so the number of pieces grows with the input and not with its square. A K-byte
string that very many different runs share is hot, and makes its shard large: such a shard is
split by the runs' codes. Hot runs are cut into pieces by the distance from their anchor.
Equal pieces are found by an aggregation, and only different ones that agree in what all
their strings share are compared string by string, by an aggregation again if they are many.
"""

from __future__ import annotations

import ctypes
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hubs, join_small, materialise, release, small_batches

#: Bytes whose code orders suffixes; bytes of text that are coded at once, and in one batch of the index.
K, CHUNK, BATCH = 24, 1 << 19, 1 << 24
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
#: Bits of the code by which one pass cuts; suffixes that a pass holds at once.
STEP_BITS, STEP_ROWS = 10, 400_000
#: Suffixes of a shard beyond which it is split by the runs' codes, and runs beyond which
#: those of one first code are compared piece by piece.
SHARD_ROWS, HOT_RUNS = 1 << 21, 1000
#: Neighbouring strings that a hot run's pieces hold at most; pieces alike in what their strings
#: share beyond which the strings are told by their codes.
PIECE, HOT_PIECES = 16, 400
#: The columns of an array: two codes, the document (id and 127 bits of its digest), the
#: run's first string, how many more it has, and how far from the first the anchor lies.
FIELDS = {"g": np.uint64, "h": np.uint64, "id": np.int64, "th": np.int64, "tl": np.int64, "lo": np.int64, "more": np.uint8, "off": np.uint8}
#: What tells a document from others of its id.
DOC = ["id", "th", "tl"]
Array = dict[str, np.ndarray]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0..n and its inverses, modulo 2^64."""
    size = max(CHUNK, 1 << int(n).bit_length())
    if size not in _powers:
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(size + 1, base, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        _powers.clear()
        _powers[size] = tuple(both)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_codes(text: np.ndarray) -> np.ndarray:
    """Sums from which the code of any part of text follows; text are bytes."""
    out = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers(len(text))[0][: len(text)], out=out[1:])
    return out


def part_codes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def anchors(pieces: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Of the strings of so many bytes in each piece, the runs with one anchor: piece, first
    start in it, number of further starts, the anchor's distance, its code, the run's code."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces])
    n, strings = len(text), len(text) - length + 1
    sums = prefix_codes(text)
    code = mix((sums[K:] - sums[:-K]) * powers(n)[1][: n - K + 1])
    low = (code & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(code), dtype=np.uint64)
    width, w = 1, length - K + 1
    while 2 * width <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:strings], low[w - width : w - width + strings])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    piece = np.repeat(np.arange(len(pieces)), sizes)[:strings]
    ends = np.cumsum(sizes)
    inside = np.arange(strings) + length <= ends[piece]
    new = np.ones(strings, bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (inside[1:] != inside[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], strings) - 1
    lo, hi = lo[inside[lo]], hi[inside[lo]]
    p = piece[lo]
    # Anchors have small codes; mixed once more, these spread evenly over the shards.
    return p, lo - (ends - sizes)[p], hi - lo, at[lo] - lo, mix(~code[at[lo]]), part_codes(sums, lo, hi + length)


def take(a: Array, at: np.ndarray) -> Array:
    return {k: v[at] for k, v in a.items()}


def join_up(parts: list[Array]) -> Array:
    return {k: np.concatenate([p[k] for p in parts]).astype(t) for k, t in FIELDS.items()}


def sort_array(a: Array) -> Array:
    """By codes, then by place. Sorted parts merge in linear time; only ties in the first code
    are sorted by the rest."""
    a = take(a, np.argsort(a["g"], kind="stable"))
    same = a["g"][1:] == a["g"][:-1]
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    if len(tied):
        order = np.lexsort([a[k][tied] for k in ("lo", "tl", "th", "id", "h", "g")])
        for k in a:
            a[k][tied] = a[k][tied[order]]
    return a


def first_of_equal(a: Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted array: which are the first with their codes, and which are later ones in
    another place. (The same place twice is a repeated row, neither of both.)"""
    again = np.append(False, (a["g"][1:] == a["g"][:-1]) & (a["h"][1:] == a["h"][:-1]))
    first = np.flatnonzero(~again)
    lead = np.repeat(first, np.diff(np.append(first, len(again))))
    other = np.zeros(len(again), bool)
    for k in (*DOC, "lo"):
        other |= a[k] != a[k][lead]
    return ~again, again & other


class IndexFamily:
    """Levels of sorted arrays, of 1, 2, 4... batches; matches: what was found to be later."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, Array]] = []
        self.matches: list[Array] = []

    def _settle(self, a: Array) -> Array:
        first, later = first_of_equal(a)
        if later.any():
            self.matches.append(take(a, later))
        return a if first.all() else take(a, first)

    def add(self, batch: Array) -> None:
        batch = self._settle(sort_array(batch))
        for k, (size, level) in enumerate(self.levels):
            if not len(batch["g"]) or not len(level["g"]):
                continue
            # The scan looks at the suffixes that batch and level share by code.
            left = np.searchsorted(level["g"], batch["g"], "left")
            right = np.searchsorted(level["g"], batch["g"], "right")
            hit = right > left
            if not hit.any():
                continue
            in_level = np.zeros(len(level["g"]) + 1, np.int64)
            np.add.at(in_level, left[hit], 1)
            np.add.at(in_level, right[hit], -1)
            mine = np.cumsum(in_level)[:-1] > 0
            both = sort_array(join_up([take(level, mine), take(batch, hit)]) | {"src": np.repeat([0, 1], [mine.sum(), hit.sum()])})
            first, later = first_of_equal(both)
            if first.all():
                continue
            self.matches.append({f: both[f][later] for f in FIELDS})
            keep = [{f: both[f][first & (both["src"] == s)] for f in FIELDS} for s in (0, 1)]
            self.levels[k] = (size, sort_array(join_up([take(level, ~mine), keep[0]])))
            batch = sort_array(join_up([take(batch, ~hit), keep[1]]))
        self.levels.append((1, batch))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, sort_array(join_up([b, a]))))

    def finish(self, every: bool = False) -> tuple[Array, Array]:
        """All later runs, and the runs whose first K bytes also begin another run, or every run."""
        a = sort_array(join_up([x for _, x in self.levels]))
        same = a["g"][1:] == a["g"][:-1]
        open_ends = a if every else take(a, np.append(False, same) | np.append(same, False))
        return join_up(self.matches or [take(a, np.zeros(len(a["g"]), bool))]), open_ends


def pack_array(a: Array) -> bytes:
    """A sorted array as bytes: steps of the first code, every column byte plane by byte plane."""
    from zstandard import ZstdCompressor

    cols = [np.diff(a["g"], prepend=np.uint64(0)), *[a[f] for f in list(FIELDS)[1:]]]
    raw = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in cols)
    return ZstdCompressor(level=1).compress(raw)


def unpack_array(blob: bytes, n: int) -> Array:
    from zstandard import ZstdDecompressor

    raw, at, out = ZstdDecompressor().decompress(blob), 0, {}
    for f, t in FIELDS.items():
        size = np.dtype(t).itemsize
        out[f] = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(t).ravel()
        at += n * size
    out["g"] = np.cumsum(out["g"], dtype=np.uint64)
    return out


def digest(raw: bytes, known: bool) -> tuple[int, int]:
    """127 bits of a text's SHA-256 as two longs; the first is negative for a null id."""
    th, tl = struct.unpack(">qq", hashlib.sha256(raw).digest()[:16])
    return th & ((1 << 63) - 1) if known else th | -(1 << 63), tl


def digest_columns(raw: Column, known: Column) -> list[Column]:
    """What digest gives, in Spark."""
    code = F.sha2(raw, 256)
    th, tl = (F.conv(F.substring(code, at, 16), 16, -10).cast("bigint") for at in (1, 17))
    return [F.when(known, th.bitwiseAND(F.lit((1 << 63) - 1))).otherwise(th.bitwiseOR(F.lit(-(1 << 63)).cast("bigint"))).alias("th"), tl.alias("tl")]


ARRAYS = "shard bigint, kind int, n bigint, array binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["shard", "kind", "n", "array"])


def cut_array(a: Array, kind: int, bits: int) -> list[tuple]:
    """A sorted array by the first bits of the code: shard, kind, n, array."""
    if not len(a["g"]):
        return []
    shard = (a["g"] >> np.uint64(64 - bits)).astype(np.int64)
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    return [(int(shard[s]), kind, int(e - s), pack_array(take(a, slice(s, e)))) for s, e in zip(cut, [*cut[1:], len(shard)])]


def settle_and_cut(parts: list[Array], bits: int) -> Iterator[pa.RecordBatch]:
    """Kind 0 are the runs that go on, kind 1 those that are later than another one here."""
    if parts:
        a = sort_array(join_up(parts))
        first, later = first_of_equal(a)
        yield _rows(cut_array(take(a, first), 0, bits) + cut_array(take(a, later), 1, bits))


def index_batches(docs: DataFrame, length: int, bits: int, checked: bool) -> DataFrame:
    """shard, n, array and matches of every batch of docs(id, known, text): its suffix array by
    shards, and the runs that another document of the batch has earlier, which need no shard."""
    chunk, batch_bytes = CHUNK, BATCH

    def coded(held: list[tuple]) -> Array:
        p, lo, more, off, g, h = anchors([x[4] for x in held], length)
        ids, ths, tls, base = (np.array([x[k] for x in held], np.int64) for k in range(4))
        return {"g": g, "h": h >> np.uint64(24), "id": ids[p], "th": ths[p], "tl": tls[p], "lo": base[p] + lo, "more": more.astype(np.uint8), "off": off.astype(np.uint8)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size, all_size = [], [], 0, 0
        for batch in batches:
            for key, known, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                raw = (text.as_py() or "").encode()
                th, tl = digest(raw, known) if checked else (0, 0)
                # A long text goes in pieces that share length - 1 bytes: no string is lost or told twice.
                for at in range(0, max(0, len(raw) - length + 1), chunk):
                    piece = raw[at : at + chunk + length - 1]
                    held.append((key, th, tl, at, piece))
                    size += len(piece)
                    if size >= chunk:
                        parts.append(coded(held))
                        all_size += size
                        held, size = [], 0
                    if all_size >= batch_bytes:
                        yield from settle_and_cut(parts, bits)
                        parts, all_size = [], 0
                        give_back()
        yield from settle_and_cut(parts + ([coded(held)] if held else []), bits)
        give_back()

    return docs.select("id", "known", "text").mapInArrow(scan, ARRAYS)


def cut_further(arrays: DataFrame, bits: int) -> DataFrame:
    """The arrays (kind 0) of fewer, larger shards by more bits. Arrays of one shard are put
    together first, as many as a pass holds, so pieces do not get smaller from pass to pass."""
    most = STEP_ROWS

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            for shard, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if shard != last or size >= most:
                    yield from settle_and_cut(parts, bits)
                    parts, size, last = [], 0, shard
                parts.append(unpack_array(blob.as_py(), n))
                size += n
        yield from settle_and_cut(parts, bits)
        give_back()

    rows = arrays.where("kind = 0").select("shard", "n", "array")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(refine, ARRAYS)


def split_shards(arrays: DataFrame) -> DataFrame:
    """Adds part (null, or which of a large shard's parts an array belongs to)."""
    most = SHARD_ROWS
    sizes = arrays.where("kind = 0").groupBy("shard").agg(F.sum("n").alias("rows")).where(F.col("rows") > most)
    large = sizes.select("shard", F.ceil(F.col("rows") / most).cast("bigint").alias("parts"))
    n = large.count()
    schema = "shard bigint, part bigint, kind int, n bigint, array binary"
    if not n:
        return arrays.select("shard", F.lit(None).cast("bigint").alias("part"), "kind", "n", "array")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for shard, kind, size, blob, parts in zip(*(batch.column(k).to_pylist() for k in ("shard", "kind", "n", "array", "parts"))):
                if parts is None or kind:
                    rows.append((shard, None, kind, size, blob))
                    continue
                a = unpack_array(blob, size)
                part = (mix(a["h"]) % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part).tolist():
                    some = take(a, part == p)
                    rows.append((shard, p, kind, len(some["g"]), pack_array(some)))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["shard", "part", "kind", "n", "array"])

    return join_small(arrays, large, ["shard"], "left", n).mapInArrow(split, schema)


#: g is null for a run that goes as a whole; hot: its strings are compared by their codes.
MARKS = "id bigint, th bigint, tl bigint, g bigint, lo bigint, more int, off int, hot boolean"


def _marks(a: Array, closed: bool, hot: np.ndarray | bool = False) -> pd.DataFrame:
    """Rows of MARKS."""
    g = pd.array(a["g"].view(np.int64), dtype="Int64")
    if closed:
        g[:] = pd.NA
    return pd.DataFrame({**{k: a[k] for k in DOC}, "g": g, "lo": a["lo"], "more": a["more"].astype(np.int32), "off": a["off"].astype(np.int32), "hot": np.broadcast_to(hot, len(a["g"]))})


def give_back() -> None:
    """Freed memory that malloc holds on to returns to the system; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _merge(hot_runs: int):
    def merge_shard(rows: pd.DataFrame) -> pd.DataFrame:
        """One shard's family over its batches, or that of a part of a large shard: there the
        other runs of a code are elsewhere, so every run may be the end of a match."""
        family, known = IndexFamily(), []
        for kind, n, blob in zip(rows["kind"], rows["n"], rows["array"]):
            a = unpack_array(blob, n)
            known.append(a) if kind else family.add(a)
        whole = rows["part"].isna().all()
        del rows
        matches, open_ends = family.finish(every=not whole) if family.levels else (join_up(known), join_up([take(known[0], slice(0))]))
        hot = True
        if whole:
            first = np.flatnonzero(np.append(True, open_ends["g"][1:] != open_ends["g"][:-1])) if len(open_ends["g"]) else np.zeros(0, np.int64)
            runs = np.diff(np.append(first, len(open_ends["g"])))
            hot = np.repeat(runs > hot_runs, runs)
        out = pd.concat([_marks(join_up([matches, *known]), True), _marks(open_ends, False, hot)], ignore_index=True)
        del family, known, matches, open_ends
        give_back()
        return out

    return merge_shard


def _compare(length: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by g and place; within a g, of equal strings all but the first go."""
        seen, last = np.zeros(0, np.uint64), None
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                g = batch.column("g").to_numpy()
                runs = batch.column("run").to_pylist()
                sizes = np.array([len(r) for r in runs])
                count = sizes - length + 1
                base = np.cumsum(sizes) - sizes
                row = np.repeat(np.arange(len(runs)), count)
                shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                start = base[row] + shift
                sums = prefix_codes(np.frombuffer(b"".join(runs), np.uint8))
                # A string's code goes with that of its g, so that only strings of one g are equal.
                code = mix(part_codes(sums, start, start + length) + mix(g.view(np.uint64))[row])
                order = np.argsort(code, kind="stable")
                again = np.zeros(len(code), bool)
                again[order[1:]] = code[order[1:]] == code[order[:-1]]
                if last is not None and g[0] == last and len(seen):
                    mine = g[row] == last
                    again[mine] |= np.isin(code[mine], seen)
                if g[-1] != last:
                    seen = np.zeros(0, np.uint64)
                last = g[-1]
                seen = np.unique(np.concatenate((seen, code[g[row] == last])))
                gone = np.flatnonzero(again)
                cut = np.flatnonzero(np.append(True, (row[gone][1:] != row[gone][:-1]) | (np.diff(gone) != 1))) if len(gone) else np.zeros(0, np.int64)
                stop = np.append(cut[1:], len(gone)) - 1 if len(gone) else cut
                r = row[gone[cut]]
                lo = batch.column("lo").to_numpy()[r] + shift[gone[cut]]
                more = shift[gone[stop]] - shift[gone[cut]]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(r)) for k in DOC), pa.array(lo), pa.array(more.astype(np.int32))], names=[*DOC, "lo", "more"])

    return compare


#: dist: how far a piece's first string starts before the anchor; code: of its bytes; core: of g
#: and of the bytes that all strings of a piece with its distance share; all null for a run as
#: it is.
PIECES = "g bigint, id bigint, th bigint, tl bigint, lo bigint, more int, dist int, code binary, core bigint, run binary"


def _fetch(length: int, piece: int):
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the open runs of each text, of hot ones in pieces."""
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for key, th, tl, text, marks in zip(*(batch.column(c) for c in (*DOC, "text", "marks"))):
                todo = [m for m in marks.as_py() or () if m["g"] is not None]
                if not todo:
                    continue
                raw, doc = (text.as_py() or "").encode(), (key.as_py(), th.as_py(), tl.as_py())
                for m in todo:
                    anchor, end, lo = m["lo"] + m["off"], m["lo"] + m["more"], m["lo"]
                    if not m["hot"]:
                        rows.append((m["g"], *doc, lo, m["more"], None, None, None, raw[lo : end + length]))
                        continue
                    while lo <= end:
                        least = (anchor - lo) // piece * piece
                        last = min(end, anchor - least)
                        run = raw[lo : last + length]
                        shared = raw[anchor - least : anchor - least - piece + 1 + length]
                        core = hashlib.blake2b(struct.pack(">qq", m["g"], least) + shared, digest_size=8).digest()
                        rows.append((m["g"], *doc, lo, last - lo, anchor - lo, hashlib.blake2b(run, digest_size=16).digest(), struct.unpack(">q", core)[0], run))
                        lo = last + 1
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[f.split()[0] for f in PIECES.split(", ")])

    return fetch


def _later(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with later: whether an earlier place has the same keys. Hot keys are joined apart."""
    place = F.struct(*DOC, "lo")
    first = materialise(rows.groupBy(*keys).agg(F.min(place).alias("_first"), F.count("*").alias("pairs")), "first")
    n = first.agg(F.sum("pairs")).first()[0] or 0
    return join_hubs(rows, first, keys, n).withColumn("later", place != F.col("_first")).drop("_first")


def compare_pieces(pieces: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Ends (DOC, lo, more) that are certain, and what is left to be compared as runs of core."""
    pieces = materialise(_later(pieces, ["g", "dist", "more", "code"]), "pieces")
    ends = pieces.where("later").select(*DOC, "lo", "more")
    other = pieces.where("not later").drop("later", "g")
    counts = materialise(other.groupBy("core").agg(F.count("*").alias("pairs")).withColumn("many", F.col("pairs") > HOT_RUNS), "cores")
    other = materialise(join_hubs(other, counts, ["core"], counts.agg(F.sum("pairs")).first()[0] or 0), "pieces")
    if counts.where("many").limit(1).count():
        at = other.where("many").select("core", *DOC, "lo", "dist", "run", F.explode(F.sequence(F.lit(0), "more")).alias("k"))
        string = F.md5(F.substring("run", F.col("k") + 1, F.lit(length)))
        strings = materialise(at.select("core", (F.col("dist") - F.col("k")).alias("dist"), string.alias("code"), *DOC, (F.col("lo") + F.col("k")).alias("lo")), "strings")
        ends = ends.unionByName(_later(strings, ["core", "dist", "code"]).where("later").select(*DOC, "lo", F.lit(0).alias("more")))
    return ends, other.where("not many").select(F.col("core").alias("g"), *DOC, "lo", "run")


def _cut(length: int, position: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, marks, more in zip(*(batch.column(c) for c in ("text", "marks", "ends"))):
                raw = (text.as_py() or "").encode()
                runs = sorted([(m["lo"], m["lo"] + m["more"] + length) for m in marks.as_py() or () if m["g"] is None] + [(m["lo"], m["lo"] + m["more"] + length) for m in more.as_py() or ()])
                spans: list[list[int]] = []
                for s, e in runs:
                    if spans and s <= spans[-1][1]:
                        spans[-1][1] = max(e, spans[-1][1])
                    else:
                        spans.append([s, e])
                kept, at = [], 0
                for s, e in spans:
                    kept.append(raw[at:s])
                    at = e
                kept.append(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in spans), len(spans), [{"start": s, "stop": e} for s, e in spans], b"".join(kept)))
            kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(position), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["given", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return cut


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, spans and kept (binary) of every whole text's UTF-8 bytes.

    Each byte goes that lies in a string of length bytes which also starts earlier: in a
    document with a smaller id, or before in the same one. Strings never cross documents and
    are judged on the input. Rows with equal ids and different texts are different documents,
    ordered by their SHA-256; identical rows are one document and get equal answers; rows
    with null ids come first, ordered by their SHA-256 too. Null and empty texts have no bytes.
    Ids must be integers. Other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    lowest = F.lit(-(1 << 63)).cast("bigint")
    given = F.col(id_col)
    source = docs.select(given.alias("given"), F.coalesce(given.cast("bigint"), lowest).alias("id"), given.isNotNull().alias("known"), F.col(text_col).alias("text"))
    # Digests take room in the index, so they are left out where ids alone tell documents apart.
    checked = bool(source.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Shards of some 8 MB of text, 200,000 suffixes: neither one nor its family outgrows a task.
    bits = min(40, max(4, int(total >> 23).bit_length()))
    steps = -(-bits // STEP_BITS)
    arrays = materialise(index_batches(source, length, -(-bits // steps), checked), "arrays")
    known = []
    for step in range(2, steps + 1):
        # What is known to be later needs no shard and goes on as it is.
        known.append(arrays.where("kind = 1"))
        arrays = materialise(cut_further(arrays, -(-bits * step // steps)), "arrays")
    for k in known:
        arrays = arrays.unionByName(k)
    marks = materialise(split_shards(arrays).groupBy("shard", "part").applyInPandas(_merge(HOT_RUNS), MARKS), "marks")
    release(arrays)
    per_doc = marks.groupBy(*DOC).agg(F.collect_list(F.struct("g", "lo", "more", "off", "hot")).alias("marks"))
    # One shuffle of the texts serves all passes over them.
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    told = digest_columns(raw, F.col("known")) if checked else [F.lit(0).cast("bigint").alias(k) for k in DOC[1:]]
    texts = source.select("given", "id", *told, "text")
    marked = texts.join(per_doc, DOC, "left").select("given", *DOC, "text", "marks")

    fetched, certain = marked.mapInArrow(_fetch(length, PIECE), PIECES), None
    if checked:  # a repeated row is no earlier document
        fetched = fetched.dropDuplicates(["g", *DOC, "lo"])
    runs = fetched.select("g", *DOC, "lo", "run")
    if marks.where("hot").limit(1).count():
        fetched = materialise(fetched, "runs")
        certain, left = compare_pieces(fetched.where("dist is not null"), length)
        runs = fetched.where("dist is null").select("g", *DOC, "lo", "run").unionByName(left)
    ends = runs.repartition("g").sortWithinPartitions("g", *DOC, "lo").mapInArrow(_compare(length), "id bigint, th bigint, tl bigint, lo bigint, more int")
    ends = ends if certain is None else ends.unionByName(certain)
    ends = ends.groupBy(*DOC).agg(F.collect_list(F.struct("lo", "more")).alias("ends"))
    both = marked.join(ends, DOC, "left").select("given", "text", "marks", "ends")
    out = both.mapInArrow(_cut(length, 0), f"given {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return out.withColumnRenamed("given", id_col)
