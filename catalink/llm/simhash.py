"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is cut into segments of 32 bits. Bit b of its first 64 is 1 if it is set in over half of
the XXH64 values (seed 42) of the text's shingles; further bits come from values mixed from these. Each
fingerprint enters the Hamming ball of radius 1 around each of its segments into that segment's table, so
fingerprints meet that differ in at most 2 bits of some segment; those that meet are verified over all
bits. With two segments that finds every pair at 4 or fewer bits (op6).

A table is dealt into blocks by the low bits of a segment's value (few at first, more for more
fingerprints), so that only flips of these bits are sent elsewhere; all other entries are made, sorted
and met within a block's task, which gives the edges of a minimum spanning forest by distance, never all
pairs. Where very many fingerprints share one entry the forest is grown without listing their pairs.

Cases: a null, empty or blank text has fingerprint zero, linked like any other; fewer words than a
shingle make one shingle; repeated rows share a fingerprint and so a component; texts of any length are
hashed whole, in slices; an empty table gives an empty result; other columns are ignored; a null doc_id
takes part and never is a component's id unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, written
from .components import components

SEED = 42
#: Fingerprints to a block, as far as they are spread evenly; to a part of a block whose entries are made at a time.
BLOCK, PART = 20_000, 1 << 15
#: Pairs of one entry that are listed; a forest is grown without a list beyond. Pairs held before they are thinned to a forest.
LISTED, HELD = 1 << 22, 1 << 21
#: Keys of a filter that is sent to all executors (2.3 bytes a key); beyond, a plain join does the same.
SENT_KEYS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """words to a shingle, segments of 32 bits, and the most bits in which linked fingerprints differ."""

    words: int = 4
    segments: int = 2
    most: int = 4


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, repeats included, in slices."""
    found = (text or "").encode("utf-8", "replace").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take = min(words, len(found))
    digest, n = xxhash.xxh64_intdigest, len(found) - take + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        spans = zip(starts[at:to].tolist(), ends[at + take - 1 : to + take - 1].tolist(), strict=True)
        yield np.fromiter([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8", count=to - at)


def fingerprint(text: str | None, rule: Rule = Rule()) -> np.ndarray:
    """The fingerprint of one text, as unsigned 64-bit lanes."""
    lanes = rule.segments // 2
    counts, n = np.zeros((lanes, 64), dtype=np.int64), 0
    for h in shingles(text, rule.words):
        n += len(h)
        for k in range(lanes):
            x = _mixed(h + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))) if k else h
            counts[k] += np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]


def node_of(lanes: np.ndarray) -> np.ndarray:
    """One number for each fingerprint (rows of lanes): itself if it has 64 bits, else a hash."""
    out = lanes[:, 0].copy()
    for k in range(1, lanes.shape[1]):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + lanes[:, k])
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text"):
        lanes = np.stack([fingerprint(t, rule) for t in batch.column("text").to_pylist()])
        columns = [batch.column("doc_id"), batch.column("tag"), pa.array(node_of(lanes).view(np.int64)), *(pa.array(lanes[:, k].view(np.int64)) for k in range(lanes.shape[1]))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "fp", *_lanes(rule)])


def _lanes(rule: Rule) -> list[str]:
    return [f"f{k}" for k in range(rule.segments // 2)]


def _matrix(batch: pa.RecordBatch, rule: Rule) -> np.ndarray:
    return np.stack([batch.column(name).to_numpy().view(np.uint64) for name in _lanes(rule)], axis=1)


def _segment(lanes: np.ndarray, at: int) -> np.ndarray:
    return (lanes[:, at // 2] >> np.uint64(32 * (at % 2))) & np.uint64(0xFFFFFFFF)


def _routed(batches: Iterator[pa.RecordBatch], rule: Rule, bits: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for each segment and block: that of its own low bits, and those one flip away."""
    for batch in batches:
        lanes = _matrix(batch, rule)
        for at in range(rule.segments):
            own = _segment(lanes, at).astype(np.int64) & ((1 << bits) - 1)
            for flip in range(-1, bits):
                block = (at << bits) + (own if flip < 0 else own ^ (1 << flip))
                yield pa.RecordBatch.from_arrays([pa.array(block), *(batch.column(name) for name in _lanes(rule))], names=["block", *_lanes(rule)])


def _distance(lanes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(lanes[i] ^ lanes[j]).sum(axis=1, dtype=np.int64)


def forest(i: np.ndarray, j: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Places of the edges (i, j of n nodes, length d) of a minimum spanning forest, by Boruvka's rounds."""
    order = np.lexsort((j, i, d))
    i, j = i[order], j[order]
    label, live, chosen = np.arange(n), np.arange(len(order)), []
    while True:
        a, b = label[i[live]], label[j[live]]
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            break
        first = np.full(n, len(order))
        first[a[::-1]] = live[::-1]  # the last write is the shortest edge
        other = np.full(n, len(order))
        other[b[::-1]] = live[::-1]
        take = np.unique(np.minimum(first, other))
        take = take[take < len(order)]
        chosen.append(take)
        u, v, new = label[i[take]], label[j[take]], np.arange(n)
        while True:
            low = np.minimum(new[u], new[v])
            before = new.copy()
            np.minimum.at(new, u, low)
            np.minimum.at(new, v, low)
            new = new[new]
            if (new == before).all():
                break
        label = new[label]
    return order[np.concatenate(chosen)] if chosen else order[:0]


def _grown(lanes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same over all pairs within most bits of few lanes, grown node by node without listing pairs."""
    n = len(lanes)
    left, near, to = np.arange(1, n), np.full(n, most + 1), np.zeros(n, dtype=np.int64)
    out, now = [], 0
    while len(left):
        d = np.bitwise_count(lanes[left] ^ lanes[now]).sum(axis=1, dtype=np.int64)
        closer = d < near[left]
        near[left[closer]], to[left[closer]] = d[closer], now
        at = int(np.argmin(near[left]))
        now = int(left[at])
        if near[now] <= most:
            out.append((now, to[now], near[now]))
        left = np.delete(left, at)
    i, j, d = (np.asarray(x, dtype=np.int64) for x in (zip(*out, strict=True) if out else ([], [], [])))
    return i, j, d


class _Block:
    """Links among the fingerprints of one block."""

    def __init__(self, lanes: np.ndarray, rule: Rule):
        self.lanes, self.rule = lanes, rule
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), HELD):
            a, b = i[at : at + HELD], j[at : at + HELD]
            d = _distance(self.lanes, a, b)
            near = (d <= self.rule.most) & (a != b)
            self.found.append((a[near], b[near], d[near]))
            self.held += int(near.sum())
            if self.held > HELD:
                self.thin()

    def thin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d = (np.concatenate([x[k] for x in self.found]) if self.found else np.zeros(0, np.int64) for k in range(3))
        used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        keep = forest(at[: len(i)], at[len(i) :], d, len(used))
        self.found = [(i[keep], j[keep], d[keep])]
        self.held = len(keep)
        return self.found[0]

    def meet(self, value: np.ndarray, rows: np.ndarray, own: np.ndarray, low: int) -> None:
        """Fingerprints rows, of entries value in this block; own ones may turn one bit from low on."""
        if len(rows) < 2:
            return
        if len(rows) > PART and low < 32:
            to = min(32, low + 4)
            mask, part = np.uint64((1 << to) - (1 << low)), (value >> np.uint64(low)) & np.uint64((1 << (to - low)) - 1)
            for k in range(1 << (to - low)):
                at = [np.flatnonzero(part == k)]
                turned = [np.flatnonzero((part == k ^ (1 << b)) & own) for b in range(to - low)]
                here = np.concatenate(at + turned)
                still = np.concatenate([own[at[0]], np.zeros(sum(map(len, turned)), bool)])
                self.meet((value[here] & ~mask) | np.uint64(k << low), rows[here], still, to)
            return
        free, bits = np.flatnonzero(own), np.uint64(1) << np.arange(low, 32, dtype=np.uint64)
        entry = np.concatenate([value, (value[free][:, None] ^ bits[None, :]).ravel()])
        row = np.concatenate([rows, np.repeat(rows[free], len(bits))])
        flip = np.concatenate([np.full(len(rows), -1), np.tile(np.arange(len(bits)), len(free))])
        order = np.lexsort((flip, entry))
        entry, row, flip = entry[order], row[order], flip[order]
        cuts = np.concatenate([[0], np.flatnonzero(entry[1:] != entry[:-1]) + 1, [len(entry)]])
        size, start = np.diff(cuts), cuts[:-1]
        # Fingerprints that all turn the same bit also meet at their own value.
        some = (size > 1) & ((flip[start] != flip[cuts[1:] - 1]) | (flip[start] < 0))
        size, start = size[some], start[some]
        for n in np.unique(size[size <= 32]).tolist():
            at = start[size == n]
            i, j = np.triu_indices(n, 1)
            for a in range(0, len(at), max(1, HELD // len(i))):
                x = at[a : a + max(1, HELD // len(i))]
                left, right = (x[:, None] + i[None, :]).ravel(), (x[:, None] + j[None, :]).ravel()
                use = (flip[left] != flip[right]) | (flip[left] < 0)
                self.add(row[left[use]], row[right[use]])
        for n, a in zip(size[size > 32].tolist(), start[size > 32].tolist(), strict=True):
            members, turned = row[a : a + n], flip[a : a + n]
            groups = np.unique(turned, return_counts=True)[1]
            same = int((groups[1 if turned[0] < 0 else 0 :].astype(np.int64) ** 2).sum())
            if (n * n - same) // 2 > LISTED:
                members = np.unique(members)
                i, j, _ = _grown(self.lanes[members], self.rule.most)
                self.add(members[i], members[j])
                continue
            edge = 0
            for k, m in enumerate(groups.tolist()):
                if k == 0 and turned[0] < 0:
                    i, j = np.triu_indices(m, 1)
                    self.add(members[i], members[j])
                mine, others = members[edge : edge + m], members[edge + m :]
                self.add(np.repeat(mine, len(others)), np.tile(others, m))
                edge += m


def block_links(block: int, lanes: np.ndarray, rule: Rule, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (places in lanes, distance) among one block's fingerprints."""
    value = _segment(lanes, block >> bits)
    mask, route = np.uint64((1 << bits) - 1), np.uint64(block & ((1 << bits) - 1))
    found = _Block(lanes, rule)
    found.meet((value & ~mask) | route, np.arange(len(lanes)), (value & mask) == route, bits)
    return found.thin()


def _linked(batches: Iterator[pa.RecordBatch], rule: Rule, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by block; a block may go over several batches."""
    blocks: list[np.ndarray] = []
    current = -1

    def done() -> Iterator[pa.RecordBatch]:
        if blocks:
            lanes = np.concatenate(blocks)
            i, j, d = block_links(current, lanes, rule, bits)
            nodes = node_of(lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[j]), pa.array(d)], names=["u", "v", "d"])

    for batch in batches:
        block, lanes = batch.column("block").to_numpy(), _matrix(batch, rule)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                if block[a] != current:
                    yield from done()
                    blocks, current = [], int(block[a])
                blocks.append(lanes[a:b])
    yield from done()


def links(fps: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Links (u, v, d) that join all distinct fingerprints (lanes f0, ...) that meet within rule.most bits, though not every such pair."""
    n = fps.count()
    bits = min(24, max(0, (-(-n // BLOCK) - 1).bit_length()))
    schema = "block long, " + ", ".join(f"{name} long" for name in _lanes(rule))
    # Dealt out by their number: a small table read back is one or two partitions.
    dealt = fps.select(*_lanes(rule)).repartition(max(1, -(-n // BLOCK))).mapInArrow(lambda b: _routed(b, rule, bits), schema)
    blocked = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _linked(b, rule, bits), "u long, v long, d long")
    u, v = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    return blocked.where("u != v").select(u, v, "d").distinct()


def _marks(docs: DataFrame, rule: Rule, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, fp, lanes) of every row, tag being a hash of the text; written."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("tag", F.xxhash64("text"))
    schema = "doc_id long, tag long, fp long, " + ", ".join(f"{name} long" for name in _lanes(rule))
    marks = rows.mapInArrow(lambda batches: _fingerprints(batches, rule), schema)
    return written(marks if rule.segments > 2 else marks.drop("f0"), "fingerprints")


def _distinct(marks: DataFrame, rule: Rule) -> DataFrame:
    fps = marks.select("fp").distinct().withColumn("f0", F.col("fp")) if rule.segments == 2 else marks.dropDuplicates(["fp"]).select("fp", *_lanes(rule))
    return written(fps, "distinct-fingerprints")


def _roots(fps: DataFrame, edges: DataFrame) -> DataFrame:
    """(f, root) of every fingerprint."""
    roots = components(edges.select("u", "v"))
    return written(fps.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits a lane), component_id."""
    marks = _marks(docs, rule, id_col, text_col)
    fps = _distinct(marks, rule)
    roots = _roots(fps, links(fps, rule))
    first = marks.groupBy("fp").agg(F.min("doc_id").alias("first"))
    known = written(first.join(roots, F.col("fp") == F.col("f")).select("f", "root", "first"), "first-ids")
    ids = known.groupBy("root").agg(F.min("first").alias("component_id")).select(F.col("root").alias("r"), "component_id")
    named = written(known.join(ids, F.col("root") == F.col("r")).select("f", "component_id"), "named")
    out = marks.join(named, F.col("fp") == F.col("f"))
    lanes = ["fp"] if rule.segments == 2 else _lanes(rule)
    return out.select("doc_id", F.concat(*(F.lower(F.lpad(F.hex(x), 16, "0")) for x in lanes)).alias("fingerprint"), "component_id")
