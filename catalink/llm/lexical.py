"""Ranked lexical search by Block-Max WAND over an index of the documents.

The index is cut by documents: a task numbers its documents in order of their ids, gathers postings until
a shard has SHARD_POSTINGS of them and writes the shard, one row for each term. Nothing is shuffled to
build it. A term's postings are cut into blocks of BLOCK; a block's document numbers are differences in
as few bytes as the list needs, its impacts (the part of a score that depends on term frequency and
length only) take three bytes; the last document and the greatest impact of each block stand beside them.

A search joins the items' terms with the index rows on the term, so only asked lists are moved, and meets
them by shard and block of items. There the blocks' ends cut the documents into intervals, each with the
sum of the weighted greatest impacts of the blocks that reach it: pointers move over these bounds alone,
and intervals at or below the threshold (the score of the last kept document) are left without opening a
block. Of the others the document numbers are opened; a document is a pivot if the greatest impacts of
the lists that hold it still exceed the threshold; only blocks with a pivot have their impacts opened.
Documents are met in order, so that of equal scores the smaller id stays. The shards' best documents
are ranked together. All sums are 64-bit integers, and results are those of scoring every document.

Cases: a null, empty or wordless text is no document of the counts and never found; an item without a
known term has no rows; texts of any length are taken whole; repeated documents, ids and items are rows of
their own; equal scores go by id, null ids last; empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, small_batches, written

#: Postings of a block and, about, of a shard; items that are searched together.
BLOCK, SHARD_POSTINGS, ITEMS = 64, 4_000_000, 1000
#: Intervals looked into at a time: a few as long as the threshold is low.
FEW, MANY = 16, 512
#: Letters and digits (of ASCII) stay, A-Z as a-z, and all bytes of other characters; the rest parts terms.
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
INDEX = "shard long, term string, n int, width int, last binary, top binary, docs binary, low binary, high binary, ids array<long>"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_KEPT).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        sizes = [len(terms_of(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["documents", "terms"])


def corpus_size(rows: DataFrame) -> tuple[int, int]:
    """How many rows (with a column text) have a term, and all their terms."""
    found = rows.select("text").mapInArrow(_counted, "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    return found[0] or 0, found[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The part of a score that one document adds per unit of a term's weight."""
    m = 75 + (25 * n.astype(np.int64) * documents) // terms if 25 * int(n.max(initial=0)) * documents < 1 << 62 else np.asarray([75 + 25 * int(x) * documents // terms for x in n], dtype=np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def posting_row(docs: np.ndarray, impact: np.ndarray, block: int) -> tuple:
    """(n, width, last, top, docs, low, high) of one list; docs ascending."""
    n = len(docs)
    cuts = np.arange(0, n, block)
    last = docs[np.minimum(cuts + block, n) - 1]
    top = np.maximum.reduceat(impact, cuts)
    steps = np.diff(docs, prepend=-1) - 1
    width = 1 if steps.max() < 1 << 8 else 2 if steps.max() < 1 << 16 else 4
    room = n if n <= block else len(cuts) * block
    padded = np.zeros((2, room), dtype=np.int64)
    padded[:, :n] = steps, impact
    return n, width, last.astype("<i4").tobytes(), top.astype("<i4").tobytes(), padded[0].astype(f"<u{width}").tobytes(), (padded[1] & 0xFFFF).astype("<u2").tobytes(), (padded[1] >> 16).astype(np.uint8).tobytes()


class Shard:
    """Postings of a task's documents, gathered until they are written."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts, numbers = Counter(words), self.numbers
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in counts), dtype=np.int32, count=len(counts)))
        self.counts.append(np.fromiter(counts.values(), dtype=np.int32, count=len(counts)))
        self.postings += len(counts)

    def rows(self, shard: int, documents: int, terms: int, block: int) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("width", pa.int32()), *((x, pa.binary()) for x in ("last", "top", "docs", "low", "high")), ("ids", pa.list_(pa.int64()))])
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([shard, *[None] * 8, [self.ids[i] for i in order]], schema, strict=True)], schema=schema)
        sizes = [len(x) for x in self.terms]
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        doc, n = np.repeat(place, sizes), np.repeat(np.asarray(self.lengths, dtype=np.int64), sizes)
        impact = impacts(tf, n, documents, terms)
        sort = np.lexsort((doc, term))
        doc, impact = doc[sort].astype(np.int64), impact[sort]
        ends = np.cumsum(np.bincount(term, minlength=len(self.numbers)))
        starts = np.concatenate([[0], ends[:-1]])
        # Of lists of one block, which most are, all parts are slices of the whole shard's.
        steps = doc - 1
        steps[1:] -= doc[:-1]
        steps[starts] = doc[starts]
        widest, tops = np.maximum.reduceat(steps, starts), np.maximum.reduceat(impact, starts)
        widths = np.where(widest < 1 << 8, 1, np.where(widest < 1 << 16, 2, 4)).tolist()
        last, top = doc[ends - 1].astype("<i4").tobytes(), tops.astype("<i4").tobytes()
        low, high = (impact & 0xFFFF).astype("<u2").tobytes(), (impact >> 16).astype(np.uint8).tobytes()
        narrow = {w: steps.astype(f"<u{w}").tobytes() for w in (1, 2, 4)}
        words, starts, ends = list(self.numbers), starts.tolist(), ends.tolist()

        def one(t: int) -> tuple:
            a, b, w = starts[t], ends[t], widths[t]
            if b - a > block:
                return posting_row(doc[a:b], impact[a:b], block)
            return b - a, w, last[4 * t : 4 * t + 4], top[4 * t : 4 * t + 4], narrow[w][w * a : w * b], low[2 * a : 2 * b], high[a:b]

        for at in range(0, len(words), 5000):
            lists = list(map(one, range(at, min(at + 5000, len(words)))))
            columns = [[shard] * len(lists), [w.decode("utf-8", "replace") for w in words[at : at + 5000]], *map(list, zip(*lists, strict=True)), [None] * len(lists)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _indexed(batches: Iterator[pa.RecordBatch], documents: int, terms: int, most: int, block: int) -> Iterator[pa.RecordBatch]:
    shard, name = Shard(), TaskContext.get().partitionId() << 24
    for batch in small_batches(batches, "text"):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = terms_of(text)
            if words:
                shard.add(doc_id, words)
                if shard.postings >= most:
                    yield from shard.rows(name, documents, terms, block)
                    shard, name = Shard(), name + 1
    if shard.ids:
        yield from shard.rows(name, documents, terms, block)


def index(docs: DataFrame, shard_postings: int = SHARD_POSTINGS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The written index of docs, a row for each term of each shard and one for the ids of each shard, and the number of documents with a term."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    documents, terms = corpus_size(rows)
    return written(rows.mapInArrow(lambda b: _indexed(b, documents, terms, shard_postings, block), INDEX), "lexical-index"), documents


class List:
    """One term's postings in a shard, opened as needed; weight is that of the term times its repeats in the item."""

    def __init__(self, row: dict, block: int):
        self.n, self.block = row["n"], block
        self.last, self.top = np.frombuffer(row["last"], "<i4").astype(np.int64), np.frombuffer(row["top"], "<i4").astype(np.int64)
        across = min(self.n, block)
        self.steps = np.frombuffer(row["docs"], f"<u{row['width']}").reshape(-1, across)
        self.low, self.high = np.frombuffer(row["low"], "<u2").reshape(-1, across), np.frombuffer(row["high"], np.uint8).reshape(-1, across)
        self.base = np.concatenate([[-1], self.last[:-1]])
        # A list of one block is opened at once: its documents are blocks of their own.
        self.single = self.docs(np.zeros(1, dtype=np.int64))[0] if len(self.last) == 1 else None

    def docs(self, blocks: np.ndarray) -> np.ndarray:
        """Document numbers of some blocks, a row each; beyond the list's end they go on past its last one."""
        return np.cumsum(self.steps[blocks].astype(np.int64) + 1, axis=1) + self.base[blocks][:, None]

    def impacts(self, blocks: np.ndarray, columns: np.ndarray) -> np.ndarray:
        return self.low[blocks, columns].astype(np.int64) | self.high[blocks, columns].astype(np.int64) << 16

    def ends(self) -> np.ndarray:
        return self.last if self.single is None else np.unique(np.concatenate([self.single, self.single - 1]))

    def bound(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For intervals that end there: the block that reaches it, and its greatest impact (0 and none beyond the list)."""
        if self.single is not None:
            at = np.minimum(np.searchsorted(self.single, ends), self.n - 1)
            return np.where(self.single[at] == ends, 0, -1), np.where(self.single[at] == ends, self.impacts(np.zeros_like(at), at), 0)
        at = np.searchsorted(self.last, ends)
        inside = at < len(self.last)
        return np.where(inside, at, -1), np.where(inside, self.top[np.minimum(at, len(self.last) - 1)], 0)


def best(lists: list[List], weights: list[int], most: int, told: Counter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and scores of the most best documents above 0, by score, then number.

    told counts the blocks of the lists, and those whose numbers and impacts were opened.
    """
    kept_docs, kept = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    used = [(x, w) for x, w in zip(lists, weights, strict=True) if w > 0]
    if not used:
        return kept_docs, kept
    ends = np.unique(np.concatenate([x.ends() for x, _ in used]))
    ends = ends[ends >= 0]
    blocks, bounds = [], np.zeros(len(ends), dtype=np.int64)
    for x, w in used:
        block, top = x.bound(ends)
        blocks.append(block)
        bounds += w * top
    begins = np.concatenate([[0], ends[:-1] + 1])
    threshold, at, take = 0, 0, FEW
    while at < len(ends):
        live = np.flatnonzero(bounds[at:] > threshold)[:take] + at
        if not len(live):
            break
        at, take = int(live[-1]) + 1, min(2 * take, MANY)
        numbers, limits, where = [], [], []
        for k, (x, w) in enumerate(used):
            asked = np.unique(blocks[k][live])
            asked = asked[asked >= 0]
            if not len(asked):
                continue
            docs = x.docs(asked)
            inside = np.minimum(np.searchsorted(ends[live], docs), len(live) - 1)
            row, column = np.nonzero((docs <= ends[live][inside]) & (docs >= begins[live][inside]) & (docs <= x.last[-1]))
            numbers.append(docs[row, column])
            limits.append(w * x.top[asked[row]])
            where.append((k, asked[row], column))
            if told is not None:
                told["numbers"] += len(asked)
        if not numbers:
            continue
        number = np.concatenate(numbers)
        seen, inverse = np.unique(number, return_inverse=True)
        limit = np.zeros(len(seen), dtype=np.int64)
        np.add.at(limit, inverse, np.concatenate(limits))
        pivot = limit > threshold
        scores = np.zeros(len(seen), dtype=np.int64)
        start = 0
        for (k, block, column), docs in zip(where, numbers, strict=True):
            places = inverse[start : start + len(docs)]
            start += len(docs)
            some = pivot[places]
            if some.any():
                x, w = used[k]
                np.add.at(scores, places[some], w * x.impacts(block[some], column[some]))
                if told is not None:
                    told["impacts"] += len(np.unique(block[some]))
        good = pivot & (scores > threshold)
        kept_docs, kept = np.concatenate([kept_docs, seen[good]]), np.concatenate([kept, scores[good]])
        order = np.lexsort((kept_docs, -kept))[:most]
        kept_docs, kept = kept_docs[order], kept[order]
        if len(kept) == most:
            threshold = int(kept[-1])
    if told is not None:
        told["blocks"] += sum(len(x.last) for x, _ in used)
    return kept_docs, kept


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        rows = [(key, term.decode("utf-8", "replace"), n) for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True) for term, n in Counter(terms_of(text)).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64()))], names=["key", "term", "repeats"])


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _searched(documents: int, most: int, block: int):
    def search(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lists = [List(r, block) for r in rows]
        weights = [weight(documents, r["df"]) for r in rows]
        of_item: dict[int, tuple[list[List], list[int]]] = {}
        for x, w, r in zip(lists, weights, rows, strict=True):
            for item in r["items"]:
                mine = of_item.setdefault(item["key"], ([], []))
                mine[0].append(x)
                mine[1].append(w * item["repeats"])
        found = [(key, *best(*mine, most)) for key, mine in of_item.items()]
        keys = np.repeat(np.asarray([f[0] for f in found], dtype=np.int64), [len(f[1]) for f in found])
        shard = np.full(len(keys), rows[0]["shard"], dtype=np.int64)
        return pa.table({"key": keys, "shard": shard, "number": np.concatenate([f[1] for f in found]), "score": np.concatenate([f[2] for f in found])})

    return search


def search(indexed: DataFrame, documents: int, items: DataFrame, most: int = 20, items_together: int = ITEMS, block: int = BLOCK, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the most best documents of each item (rows of items), by what `index` gave."""
    asked = written(pick(items, item_id=id_col, text=text_col).withColumn("key", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-asked.count() // items_together))
    words = asked.select("key", "text").mapInArrow(_asked, "key long, term string, repeats long").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    wanted = written(words.groupBy("part", "term").agg(F.collect_list(F.struct("key", "repeats")).alias("items")), "asked-terms")
    lists = indexed.where("term IS NOT NULL")
    dfs = lists.select("term", "n").join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    known = written(wanted.join(dfs, "term"), "weighed-terms")
    met = lists.drop("ids").join(known, "term")
    found = met.groupBy("shard", "part").applyInArrow(_searched(documents, most, block), "key long, shard long, number long, score long")
    ids = indexed.where("term IS NULL").select("shard", F.posexplode("ids").alias("number", "doc_id"))
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "shard", "number")
    ranked = found.join(ids, ["shard", "number"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return ranked.join(asked.select("key", "item_id"), "key").select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the most best of all docs for each item."""
    indexed, documents = index(docs)
    return search(indexed, documents, items, most)
