"""Packing documents into sequences of at most 2048 tokens by Karmarkar-Karp multiway differencing.

Each document's ids are cut into whole sequences and a rest, the rest into graded pieces: 512 ids while
more are left, then half of what is left, down to 32, so that small pieces can even out the windows.
Pieces are dealt at random into blocks of about 256 sequences. In a block every piece begins as
a partial partition with one loaded window; the two partial partitions of largest spread are merged with
opposing imbalances, again and again, until one partition is left. If its fullest window is over the
capacity, the number of windows rises by one and differencing begins anew.

Cases: a null text counts as empty and gives the end id alone; repeated rows are packed each; a null
doc_id is kept; a document of any length is cut; an empty table gives an empty result; other columns are
ignored. Only piece sizes are shuffled, never ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_crc, parts_for, pick, small_batches, written
from .tokens import encoder

CAPACITY, LARGE, SMALL, BLOCK_SEQUENCES = 2048, 512, 32, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, lot long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cuts(n: int, capacity: int = CAPACITY, large: int = LARGE, small: int = SMALL) -> list[int]:
    """Start of each piece of a document of n ids, and n at the end."""
    at = list(range(0, n // capacity * capacity + 1, capacity))
    while n - at[-1] >= 2 * small:
        left = n - at[-1]
        at.append(at[-1] + (large if left > large else -(-left // 2)))
    return at if at[-1] == n else [*at, n]


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window of each size: multiway differencing into so many windows."""
    n = len(sizes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    # Loads of a part's windows that hold something, falling; a single piece is its size alone.
    loads: dict[int, np.ndarray] = {}
    heap = [(-size, i) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        left = loads.pop(a) if a >= n else np.asarray([-x])
        right = loads.pop(b) if b >= n else np.asarray([-y])
        # The fullest window of one meets the emptiest of the other: an empty one as long as there are enough.
        met = max(0, len(left) + len(right) - windows)
        alone = len(right) - met
        both = np.concatenate([left, right[:alone][::-1]])
        if met:
            both[len(left) - met : len(left)] += right[alone:][::-1]
        order = np.argsort(-both, kind="stable")
        at = np.empty(len(order), dtype=np.int16 if windows < 1 << 15 else np.int64)
        at[order] = np.arange(len(order))
        node = n + len(merges)
        loads[node] = both[order]
        # Window i of a is at[i] of the merged part; window k of b, from its fullest, lies at the end and backwards.
        merges.append((a, b, at[: len(left)], at[::-1][: len(right)]))
        heapq.heappush(heap, (-int(both[order[0]] - (both[order[-1]] if len(both) == windows else 0)), node))
    # From the last merge down: at which window of the final partition each window of a part ends up.
    out = np.zeros(n, dtype=np.int64)
    place = {n + len(merges) - 1: np.arange(windows)} if merges else {}
    for k in range(len(merges) - 1, -1, -1):
        a, b, of_a, of_b = merges.pop()
        at = place.pop(n + k)
        for part, own in ((a, of_a), (b, of_b)):
            if part < n:
                out[part] = at[own[0]]
            else:
                place[part] = at[own]
    return out


def pack_block(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size, none over capacity: whole sequences stand alone, after the others."""
    out = np.empty(len(sizes), dtype=np.int64)
    part = np.flatnonzero(sizes < capacity)
    windows = int(-(-sizes[part].sum() // capacity))
    while len(part):
        at = difference(sizes[part], windows)
        if np.bincount(at, weights=sizes[part]).max() <= capacity:
            out[part] = np.unique(at, return_inverse=True)[1]
            break
        windows += 1
    used = int(out[part].max()) + 1 if len(part) else 0
    whole = np.flatnonzero(sizes >= capacity)
    out[whole] = used + np.arange(len(whole))
    return out


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    codec, part, count = encoder(path), TaskContext.get().partitionId(), 0
    end = np.asarray([end_id], dtype="<u4").tobytes()
    for batch in small_batches(batches, "text"):
        rows: list[tuple] = []
        raw = codec.encode_all([t or "" for t in batch.column("text").to_pylist()])
        for doc_id, own in zip(batch.column("doc_id").to_pylist(), raw, strict=True):
            ids = np.frombuffer(own + end, dtype="<u4")
            at = cuts(len(ids))
            for a, b in zip(at, at[1:], strict=False):
                rows.append((doc_id, a, b - a, ids_crc(ids[a:b]), len(ids), (part << 40) + count))
                count += 1
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "lot"])


def _packed(block: pd.DataFrame) -> pd.DataFrame:
    block = block.sort_values("lot", ignore_index=True)
    window = pack_block(block["length"].to_numpy())
    block["sequence_id"] = (block["block"].to_numpy() << 32) + window
    block = block.sort_values(["sequence_id", "lot"], ignore_index=True)
    block["offset"] = block.groupby("sequence_id")["length"].cumsum() - block["length"]
    return block[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    pieces = written(rows.mapInArrow(lambda batches: _pieces(batches, tokenizer, end_id), PIECES), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = parts_for(total, CAPACITY * BLOCK_SEQUENCES)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("lot"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_packed, PACKED)
