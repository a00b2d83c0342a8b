"""Packing: first-fit decreasing with a tournament tree of bin capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, small_batches
from .tokens import ByteBPE, default_path, default_pattern


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """bin and offset of every item: items by falling length, each into the first bin with room.

    A tournament tree holds the free room of the bins; the larger child wins, so a walk from
    the root to the leftmost winner with enough room finds the bin in log(bins) steps.
    Lengths must lie between 0 and capacity; equal lengths go in their order.
    """
    n = len(lengths)
    width = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * width)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    for item, size in zip(order.tolist(), lengths[order].tolist()):
        node = 1
        while node < width:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item] = node - width
        offsets[item] = capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            won = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == won:
                break
            tree[node] = won
    return bins, offsets


def cut_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, files: tuple[str, str, str], end_id: int) -> DataFrame:
    """One row for each piece: all but a document's last have capacity tokens. place counts the
    documents of a task, so that pieces alike in everything else differ."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, end, rows = ByteBPE(*files), np.array([end_id], "<u4").tobytes(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                row, start, length, crc, total, place = [], [], [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    ids = model.encode(text.as_py() or "") + end
                    n = len(ids) // 4
                    for s in range(0, n, capacity):
                        part = ids[4 * s : 4 * (s + capacity)]
                        row.append(i)
                        start.append(s)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        total.append(n)
                        place.append(rows + i)
                rows += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total, place)]], names=["id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(scan, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, place bigint")


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    files: tuple[str, str, str] | None = None,
    end_id: int = 1,
    group_pieces: int = 2000,
    seed: int = 23,
) -> DataFrame:
    """Every document's token ids and the end id, in pieces dealt to sequences of capacity tokens.

    Pieces are dealt to groups of about group_pieces pieces by a seeded hash of all that is
    known of them and their place, so neither a giant document nor many that are alike (null
    ids, empty texts) meet in one; each group is packed by itself, first fit decreasing, of
    equal lengths by id, start and checksum. Lengths, positions and a checksum of the ids
    move, never the ids. Null texts are empty: the end id alone.
    Repeated rows are packed as often as they stand; rows with null ids too. Other columns
    are ignored; files are the tokenizer, its ranks and its pattern; an empty table gives no rows. sequence_id is the group times 2^32 plus the bin.
    """
    small_batches(docs.sparkSession)
    files = files or (default_path("byte_bpe_50k.json"), default_path("byte_bpe_50k.tiktoken"), default_pattern())
    pieces = materialise(cut_pieces(docs, id_col, text_col, capacity, files, end_id), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=(group["grp"].to_numpy() << 32) + bins, offset=offsets).drop(columns=["grp", "place"])

    kind = docs.schema[id_col].dataType.simpleString()
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "id", "doc_tokens", "start", "ids_crc32", "place"), F.lit(groups)).cast("bigint"))
    out = dealt.groupBy("grp").applyInPandas(fill, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.withColumnRenamed("id", id_col)
