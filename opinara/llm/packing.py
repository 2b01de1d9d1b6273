"""Packing of tokenised documents into windows by Karmarkar-Karp multiway differencing.

A document longer than a window is cut into full windows and a rest, and a rest into equal parts of at most
``REST_LIMIT`` tokens, since large pieces cannot be balanced. The pieces are dealt into blocks of bounded size. In a block, the differencing method splits the pieces into k windows: every
piece starts as a partition of its own (one filled window, the others empty); the two partitions with
the largest imbalance are merged, the fullest window of one with the emptiest of the other, until one
is left. k starts at the least number of windows that can hold the block and rises whenever a window
exceeds the capacity.

Defined results: a null or empty text is a document of its end token alone. Repeated rows and ids are
packed row by row. An empty table gives an empty table. Further columns of the input play no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Scratch
from .tokens import encoder, text_batches

BLOCK_PIECES = 1_500  # pieces split together in one task
REST_LIMIT = 1_024  # longest piece that is not a full window: large rests would leave windows uneven
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split item numbers into k windows of nearly equal total size."""
    # A partition is (imbalance, turn, windows); a window is (size above the emptiest, items). Empty windows
    # are left out while a partition has fewer than k others.
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        if len(a) + len(b) <= k:
            merged = a + b
        else:
            # Opposing ends meet: the fullest of one with the emptiest of the other.
            over = len(a) + len(b) - k
            a.sort(key=lambda w: w[0])
            b.sort(key=lambda w: -w[0])
            fused = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[:over], b[len(b) - over:], strict=True)]
            merged = a[over:] + b[: len(b) - over] + fused
        if len(merged) == k:
            least = min(w[0] for w in merged)
            merged = [(s - least, items) for s, items in merged] if least else merged
        heapq.heappush(heap, (-max(w[0] for w in merged), turn, merged))
        turn += 1
    return [items for _, items in heap[0][2]] if heap else []


def pack_block(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; windows are numbered from 0."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths >= capacity)
    window[full] = np.arange(len(full))
    rest = np.flatnonzero(lengths < capacity)
    sizes = lengths[rest].tolist()
    k = -(-sum(sizes) // capacity)
    while sizes:
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            break
        k += 1
    for number, group in enumerate(groups if sizes else []):
        at = rest[group]
        window[at] = len(full) + number
        offset[at] = np.cumsum(lengths[at]) - lengths[at]
    return window, offset


def cuts(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full windows, then the rest in equal parts."""
    full, rest = divmod(tokens, capacity)
    out = [(i * capacity, capacity) for i in range(full)]
    if rest:
        count = -(-rest // min(REST_LIMIT, capacity))
        start = full * capacity
        for i in range(count):
            length = rest // count + (i < rest % count)
            out.append((start, length))
            start += length
    return out


def _piece_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int,
                   with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), int(end_id).to_bytes(4, "little")
    for batch in text_batches(batches):
        ids_in = batch.column("id").to_pylist()
        encoded = encode(batch.column("text").cast(pa.binary()).to_pylist())
        rows, tokens = [], []
        for doc_id, ids in zip(ids_in, encoded, strict=True):
            held, count = ids.astype("<u4", copy=False).tobytes() + end, len(ids) + 1
            for start, length in cuts(count, capacity):
                piece = held[4 * start : 4 * (start + length)]
                rows.append((doc_id, start, length, zlib.crc32(piece), count))
                if with_ids:
                    tokens.append(np.frombuffer(piece, "<u4").astype(np.int64))
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            arrays.append(pa.array(tokens, pa.list_(pa.int64())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id",
         text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = _PIECES + (", ids array<long>" if with_ids else "")
    pieces = rows.mapInArrow(lambda it: _piece_batches(it, tokenizer, end_id, capacity, with_ids), schema)
    pieces = scratch.write(pieces, "pieces")
    blocks = -(-pieces.count() // BLOCK_PIECES) or 1
    placed = pieces.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))

    def place(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        window, offset = pack_block(block["length"].to_numpy(np.int64), capacity)
        block = block.assign(sequence_id=block["_block"].astype("int64") * (1 << 24) + window, offset=offset)
        return block.drop(columns="_block")

    return placed.groupBy("_block").applyInPandas(place, f"{schema}, sequence_id long, offset long")
