"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised apart, each by its own codebook of 64 centroids; a pair of
centroids is a cell. For a query the cells are visited by falling sum of the two inner products with a
heap (the multi-sequence order) until they hold a share of all rows; the entries of these cells, and no
others, are reranked by the exact inner product in double precision.

The codebooks are fitted on a bounded sample, and so is the share: it is the least at which the visited
cells hold RECALL of the exact nearest of PROBES sample rows among the sample. A larger table has nearer
neighbours than its sample, so the share errs upwards. Every row is indexed.

Cells of neighbouring first centroids make up shards of about SHARD_ROWS rows; a centroid with more is
split by a hash. Queries make up blocks in order of their first centroid. A query is sent to the shards
that hold a cell it visits, with a bit for each of their cells; a shard's rows are sent to the blocks
that visit it. A task multiplies, cell by cell, only the queries that visit a cell with its rows, and
returns no more than k rows a query; so a cell that holds a third of all rows is shared by many tasks.

Measured recall at 20 against brute force: see README.

Cases: vectors that are null, zero, or hold null or non-finite components, or are not of the table's
most frequent length, take no part; rows with a null id neither; of repeated rows with one id one stays,
the one with the smallest vector; ties go to the smaller id; with fewer than k candidates all are given;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts_for, pick, written

CENTROIDS, SAMPLE, NEAREST = 64, 20_000, 20
RECALL, PROBES = 0.95, 200
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024
#: Queries whose cells are visited in one task.
VISITORS = 256


def valid(rows: DataFrame) -> DataFrame:
    """One row per id with a usable vector, as array<double>."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vector") == (length.n if length else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def codebook(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k-means centroids of half vectors."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.argmin((centres * centres).sum(axis=1) - 2 * rows @ centres.T, axis=1)
        for j in range(len(centres)):
            own = rows[nearest == j]
            if len(own):
                centres[j] = own.mean(axis=0)
    return centres


def cells_of(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = books[0].shape[1]
    a, b = (np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1) for c, x in ((books[0], vectors[:, :half]), (books[1], vectors[:, half:])))
    return a * len(books[1]) + b


def traverse(query: np.ndarray, books: tuple[np.ndarray, np.ndarray], sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of distance (the negative sum of inner products) until they hold the wanted number of rows."""
    half = books[0].shape[1]
    far = [-(books[0] @ query[:half]), -(books[1] @ query[half:])]
    order = [np.argsort(d, kind="stable").tolist() for d in far]
    a, b = (d[o].tolist() for d, o in zip(far, order, strict=True))
    heap, pushed, out, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = order[0][i] * len(b) + order[1][j]
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _assigned(batches: Iterator[pa.RecordBatch], books) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            cells = cells_of(_matrix(batch.column("vector")), books).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(cells)], names=["vec_id", "vector", "cell"])


@dataclass
class Shards:
    """Where the cells of each first centroid are: in splits shards from number base on, at bit place of these shards' masks."""

    base: np.ndarray
    splits: np.ndarray
    place: np.ndarray
    width: int

    @staticmethod
    def of(sizes: np.ndarray, width: int, most: int) -> Shards:
        """sizes: rows of each cell, width cells to a first centroid."""
        rows = sizes.reshape(-1, width).sum(axis=1)
        base, splits, place = (np.zeros(len(rows), dtype=np.int64) for _ in range(3))
        number, held, cells = 0, 0, 0
        for i, n in enumerate(rows.tolist()):
            if held and held + n > most:
                number, held, cells = number + 1, 0, 0
            base[i], splits[i], place[i] = number, max(1, -(-n // most)), cells
            held, cells = held + n, cells + width
            if splits[i] > 1:
                number, held, cells = number + int(splits[i]), 0, 0
        return Shards(base, splits, place, width)

    def number(self, first: np.ndarray, ids: pa.Array) -> np.ndarray:
        """The shard of rows with these first centroids: one of the centroid's, by a hash of the id."""
        spread = (ids.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.base[first] + spread.astype(np.int64) % self.splits[first]


def share_for(sample: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float = RECALL, probes: int = PROBES, seed: int = 7) -> float:
    """The least share of rows at which visited cells hold this part of the probes' exact nearest, within the sample."""
    cells = cells_of(sample, books)
    sizes = np.bincount(cells, minlength=len(books[0]) * len(books[1]))
    needed = []
    for i in np.random.default_rng(seed).permutation(len(sample))[:probes].tolist():
        score = sample @ sample[i]
        score[i] = -np.inf
        order = traverse(sample[i], books, sizes, len(sample))
        reached = np.zeros(len(sizes))
        reached[order] = np.cumsum(sizes[order])
        needed.append(reached[cells[np.argsort(-score)[: min(k, len(sample) - 1)]]])
    need = np.sort(np.concatenate(needed)) if needed else np.zeros(0)
    return float(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) / len(sample) if len(need) else 1.0


VISITS = "block int, shard int, query_id long, query array<double>, mask binary"


def _visits(batches: Iterator[pa.RecordBatch], books, sizes: np.ndarray, wanted: int, shards: Shards, blocks: Shards) -> Iterator[pa.RecordBatch]:
    """Each query once for each shard that holds a cell it visits."""
    for batch in batches:
        rows, numbers, masks = [], [], []
        for i, q in enumerate(_matrix(batch.column("vector"))):
            visited = np.asarray(traverse(q, books, sizes, wanted), dtype=np.int64)
            first = visited // shards.width
            for number in np.unique(shards.base[first]).tolist():
                own = shards.base[first] == number
                bits = np.zeros(int(shards.place[shards.base == number].max()) + shards.width, dtype=bool)
                bits[shards.place[first[own]] + visited[own] % shards.width] = True
                packed = np.packbits(bits).tobytes()
                for split in range(int(shards.splits[first[own][0]])):
                    rows.append(i)
                    numbers.append(number + split)
                    masks.append(packed)
        take = pa.array(np.asarray(rows, dtype=np.int64))
        block = blocks.number(batch.column("cell").to_numpy() // shards.width, batch.column("vec_id"))[np.asarray(rows, dtype=np.int64)]
        columns = [pa.array(block.astype(np.int32)), pa.array(np.asarray(numbers, dtype=np.int32)), batch.column("vec_id").take(take), batch.column("vector").take(take), pa.array(masks, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "shard", "query_id", "query", "mask"])


def _placed(batches: Iterator[pa.RecordBatch], shards: Shards) -> Iterator[pa.RecordBatch]:
    """Rows of the index with their shard and their cell's bit in its masks."""
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        first = cell // shards.width
        shard = shards.number(first, batch.column("vec_id"))
        bit = shards.place[first] + cell % shards.width
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(shard.astype(np.int32)), pa.array(bit.astype(np.int32))], names=["vec_id", "vector", "s", "bit"])


def _best(scores: np.ndarray, query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and exact scores of the k nearest: sums in one fixed order, so that equal vectors tie."""
    known = np.flatnonzero(scores > -np.inf)
    if len(known) > k:
        least = np.partition(scores[known], len(known) - k)[len(known) - k]
        known = known[scores[known] >= least - 1e-9 * (1 + abs(least))]
    exact = (vectors[known] * query).sum(axis=1)
    order = np.lexsort((ids[known], -exact))[:k]
    return ids[known][order], exact[order]


def _reranked(k: int):
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(entries):
            return empty
        entries = entries.sort_values(["bit", "vec_id"], ignore_index=True)
        vectors, ids = np.stack(entries["vector"].to_numpy()), entries["vec_id"].to_numpy()
        bit, asked = entries["bit"].to_numpy(), np.stack(queries["query"].to_numpy())
        cuts = [0, *(np.flatnonzero(np.diff(bit)) + 1).tolist(), len(bit)]
        names = queries["query_id"].to_numpy()
        out = []
        for at in range(0, len(queries), 128):
            part = slice(at, at + 128)
            masks = np.unpackbits(np.frombuffer(b"".join(queries["mask"].iloc[part]), dtype=np.uint8).reshape(len(names[part]), -1), axis=1)
            scores = np.full((len(masks), len(ids)), -np.inf)
            for a, b in zip(cuts, cuts[1:], strict=False):
                visitors = np.flatnonzero(masks[:, bit[a]])
                if len(visitors):
                    scores[visitors, a:b] = asked[at + visitors] @ vectors[a:b].T
            scores[names[part][:, None] == ids[None, :]] = -np.inf
            for name, query, row in zip(names[part], asked[part], scores, strict=True):
                found, exact = _best(row, query, vectors, ids, k)
                out.append(pd.DataFrame({"query_id": np.full(len(found), name), "vec_id": found, "score": exact}))
        return pd.concat(out, ignore_index=True) if out else empty

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = NEAREST, share: float | None = None, centroids: int = CENTROIDS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, its own row left out.

    queries: ids (query_id) that are looked up among the valid rows. share: of all rows to visit; by default fitted.
    """
    spark = rows.sparkSession
    clean = written(valid(pick(rows, vec_id=id_col, vector=vector_col)), "vectors")
    total = clean.count()
    out_schema = "query_id long, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    share_of = F.pmod(F.xxhash64("vec_id", F.lit("codebook")), F.lit(1 << 30)) / float(1 << 30)
    sample = clean.where(share_of * total < SAMPLE).orderBy(F.xxhash64("vec_id"), "vec_id").limit(2 * SAMPLE).collect() or clean.orderBy("vec_id").limit(1).collect()
    fit = np.asarray([r.vector for r in sample])
    half = fit.shape[1] // 2
    books = (codebook(fit[:, :half], centroids), codebook(fit[:, half:], centroids))
    index = written(clean.mapInArrow(lambda b: _assigned(b, books), "vec_id long, vector array<double>, cell int"), "index")
    sizes = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for r in index.groupBy("cell").count().collect():  # 4096 cells at most
        sizes[r.cell] = r["count"]
    share = share if share is not None else share_for(fit, books, k)
    wanted = max(int(np.ceil(share * total)), 10 * k)
    width = len(books[1])
    shards = Shards.of(sizes, width, SHARD_ROWS)
    asked = index.join(queries.select(F.col("query_id").alias("q")).distinct(), F.col("vec_id") == F.col("q"), "left_semi").select("vec_id", "vector", "cell")
    asked = written(asked, "asked")
    many = np.zeros(len(books[0]), dtype=np.int64)
    for r in asked.groupBy(F.floor(F.col("cell") / width).cast("int").alias("first")).count().collect():  # 64 rows at most
        many[r["first"]] = r["count"]
    blocks = Shards.of(many, 1, BLOCK_QUERIES)
    visiting = asked.repartition(parts_for(int(many.sum()), VISITORS)).mapInArrow(lambda b: _visits(b, books, sizes, wanted, shards, blocks), VISITS)
    left = written(visiting, "visits")
    rows_at = index.mapInArrow(lambda b: _placed(b, shards), "vec_id long, vector array<double>, s int, bit int")
    met = left.select(F.col("block").alias("b"), F.col("shard").alias("h")).distinct()
    right = rows_at.join(met, F.col("s") == F.col("h")).select("b", "s", "vec_id", "vector", "bit")
    found = left.groupBy("block", "shard").cogroup(right.groupBy("b", "s")).applyInPandas(_reranked(k), out_schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
