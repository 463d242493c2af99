"""Removal of long repeated strings, by distributed prefix doubling on sampled positions.

Every window of 400 bytes names one position in it, the leftmost smallest hash of a gram among its first
160 positions. Equal windows name equal positions, and all windows of one position share the 240 bytes
from there on, so ranks are needed at named positions only (about one in 70 bytes). A position's first
rank is that of its 60 bytes; positions whose rank is unique are dropped. Positions of equal windows
throughout are one class, as in whole copies: their windows are all repeated. Spark then sorts the
pairs (rank at a position, rank at the offset 60), for the classes' positions and, of what is left, for
those 120 bytes on, and ranks them anew by their order; in the second round the rank at the offset 120 is
looked up by a join on document and position, and the pairs are sorted and ranked again. After each
round goes what is unique, and what has no class left that is alone. What is left shares 240 bytes:
there, classes of one rank are compared window by window, up to the threshold.

Ranks before a sort are 64-bit fingerprints of the bytes; strings that are taken as equal agree in the
fingerprints of their start and of the whole (128 bits) or, compared window by window, in their rank and one
64-bit fingerprint. Two screens are static fuse filters, sent to all executors only up to a stated
number of keys; beyond, plain joins do the same. A rank shared by very many classes is compared through
one row per window instead of in one task.

The unit may be words instead of bytes: `trimmed` also marks documents that hold a passage of over 50
words, in their order, that another document holds, too.

Cases: a null text counts as empty; texts under 400 bytes lose nothing; repeated rows repeat each
other; rows of one doc_id with different texts are kept apart; a null doc_id is kept; an empty table
gives an empty result; other columns are ignored; texts of any length are one row, read in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches, written
from .screens import held, held_udf, screen_of

#: Keys of a filter that is sent to all executors (2.3 bytes a key).
SENT_KEYS = 4_000_000
#: Classes of one rank that are compared in one task.
CLASSES = 4096
#: Symbols that are hashed at a time.
SLICE = 1 << 20


@dataclass(frozen=True)
class Unit:
    """Strings of length symbols, bytes or words; ranks begin at base symbols. across: only strings of different documents repeat each other."""

    length: int
    base: int
    gram: int
    words: bool = False
    across: bool = False

    @property
    def span(self) -> int:
        return self.length - 4 * self.base

    @property
    def width(self) -> int:
        """Bytes to a symbol."""
        return 8 if self.words else 1


BYTES, PASSAGES = Unit(400, 60, 8), Unit(51, 8, 3, words=True, across=True)
LENGTH = BYTES.length
_FACTOR = 0xD1342543DE82EF95
_rng = np.random.default_rng(400)
_BYTES = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Fingerprints of all stretches of a sequence of 64-bit values: sums of values by powers, turned back to the stretch's start."""

    def __init__(self, values: np.ndarray):
        if not _powers or len(_powers[0]) <= len(values):
            n = max(SLICE + 1024, len(values) + 1)
            _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, dtype=np.uint64)])) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * _powers[0][: len(values)], dtype=np.uint64)])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[first]) * _powers[1][first])


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint of each word, and its first byte, in the text's order; hashed in slices cut at blanks."""
    blank = _BLANK[raw]
    edge = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    first, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    codes, at = np.zeros(len(first), dtype=np.uint64), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(end, first[at] + SLICE)))
        a, b = first[at], end[to - 1]
        codes[at:to] = Prefixes(_BYTES[raw[a:b]]).of(first[at:to] - a, end[at:to] - a)
        at = to
    return codes, first


@dataclass
class Texts:
    """The symbols of several texts one after another: text i has those from edges[i] to edges[i + 1]."""

    codes: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(column: pa.Array, unit: Unit) -> Texts:
        texts = column.to_pylist()
        raw = np.frombuffer(b" ".join(texts), dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes + 1)
        if unit.words:
            codes, first = words_of(raw)
            return Texts(codes, np.concatenate([[0], np.searchsorted(first, ends)]))
        # The blank between two texts belongs to neither: it is taken out.
        keep = np.ones(len(raw), dtype=bool)
        keep[ends[:-1] - 1] = False
        return Texts(raw[keep], np.concatenate([[0], np.cumsum(sizes)]))


def _gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit mix of the eight bytes, or three words, from each position on."""
    if codes.dtype == np.uint64:
        x = codes[:-2] * np.uint64(0xD6E8FEB86659FD93) + codes[1:-1] * np.uint64(0xA0761D6478BD642F) + codes[2:]
    else:
        x = codes.astype(np.uint64)
        x = (x[:-1] << np.uint64(8)) | x[1:]
        x = (x[:-2] << np.uint64(16)) | x[2:]
        x = (x[:-4] << np.uint64(32)) | x[4:]
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value (by its upper half) in each window of so many values."""
    n = len(values) - width + 1
    best, size = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        best = np.minimum(best[: len(best) - step], best[step:])
        size += step
    return (best[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Named:
    """Named positions of several texts: text, place in it, first and last window start that it stands for, and fingerprints from it on."""

    text: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    ranks: list[np.ndarray]


def named(texts: Texts, unit: Unit, all_ranks: bool) -> Iterator[Named]:
    """Slice by slice; a position whose windows lie in two slices is named in both, each time with some of them."""
    codes, edges, b = texts.codes, texts.edges, unit.base
    for a in range(0, len(codes) - unit.length + 1, SLICE):
        part = codes[a : a + SLICE + unit.length - 1]
        # Windows that would end beyond their text: the last starts of each.
        n = len(part) - unit.length + 1
        ends = edges[1:][(edges[1:] > a) & (edges[1:] < a + len(part))] - a
        over = np.zeros(n + 1, dtype=np.int32)
        np.add.at(over, np.clip(ends - unit.length + 1, 0, n), 1)
        np.add.at(over, np.clip(ends, 0, n), -1)
        start = np.flatnonzero(np.cumsum(over[:n]) == 0)
        if not len(start):
            continue
        at = window_minima(_gram_hashes(part[: n + unit.span + unit.gram - 2]), unit.span)[start]
        cuts = np.flatnonzero(np.diff(at)) + 1
        begin, finish = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1
        at, first, last = at[begin], start[begin], start[finish]
        text = np.searchsorted(edges, first + a, side="right") - 1
        sums = Prefixes(part if unit.words else _BYTES[part])
        ranks = [sums.of(at, at + b)]
        if all_ranks:
            ranks += [sums.of(at + k * b, at + (k + 1) * b) for k in (1, 2, 3)] + [sums.of(first, last + unit.length)]
        shift = a - edges[text]
        yield Named(text, at + shift, first + shift, last + shift, ranks)


def _keys(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """First rank of every named position."""
    for batch in small_batches(batches, "raw"):
        for x in named(Texts.of(batch.column("raw"), unit), unit, False):
            yield pa.RecordBatch.from_arrays([pa.array(x.ranks[0].view(np.int64))], names=["key"])


#: base1 to base3: the first ranks at the offsets base, 2 * base and 3 * base.
POSITIONS = "doc long, tag long, rank long, base1 long, base2 long, base3 long, whole long, place long"


def _positions(batches: Iterator[pa.RecordBatch], screen: list[bytes] | None, unit: Unit) -> Iterator[pa.RecordBatch]:
    """Ranks of the named positions that the filter lets through; place packs the position with its windows' reach."""
    for batch in small_batches(batches, "raw"):
        for x in named(Texts.of(batch.column("raw"), unit), unit, True):
            some = np.flatnonzero(held(screen, x.ranks[0])) if screen is not None else np.arange(len(x.at))
            place = (x.at << 16) | ((x.at - x.first) << 8) | (x.at - x.last)
            text = pa.array(x.text[some])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(text), batch.column("tag").take(text), *(pa.array(r[some].view(np.int64)) for r in x.ranks), pa.array(place[some])], names=["doc", "tag", "rank", "base1", "base2", "base3", "whole", "place"])


CONTEXTS = "rank long, classes long, alone boolean, doc long, tag long, place long, left binary, right binary"


def _contexts(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """The symbols before each asked position that its windows reach, and those after its 4 * base."""
    names, w = ["rank", "classes", "alone", "doc", "tag", "place", "left", "right"], unit.width
    for batch in small_batches(batches, "raw", 1 << 20):
        rows = []
        for doc, tag, text, asked in zip(*(batch.column(i).to_pylist() for i in ("doc", "tag", "raw", "asked")), strict=True):
            raw = words_of(np.frombuffer(text, np.uint8))[0].tobytes() if unit.words else text
            for x in asked:
                a, back, least = x["place"] >> 16, x["place"] >> 8 & 255, x["place"] & 255
                rows.append((x["rank"], x["classes"], x["alone"], doc, tag, x["place"], raw[(a - back) * w : a * w], raw[(a + 4 * unit.base) * w : (a - least + unit.length) * w]))
        kinds = [pa.int64()] * 2 + [pa.bool_()] + [pa.int64()] * 3 + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)


def window_hashes(batch: pa.RecordBatch, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of each row: row, distance before the position, and a hash of rank, symbols before and symbols after."""
    n, span = batch.num_rows, unit.span
    powers = np.cumprod(np.full(span, _FACTOR, dtype=np.uint64))
    place = batch.column("place").to_numpy()
    back, least = (place >> 8) & 255, place & 255
    sides = []
    for name, turned in (("left", True), ("right", False)):
        table = np.zeros((n, span), dtype=np.uint64)
        for i, x in enumerate(batch.column(name).to_pylist()):
            if x:
                own = np.frombuffer(x, np.uint64) if unit.words else _BYTES[np.frombuffer(x, np.uint8)]
                table[i, : len(own)] = own[::-1] if turned else own
        sums = np.cumsum(table * powers, axis=1, dtype=np.uint64)
        sides.append(np.concatenate([np.zeros((n, 1), np.uint64), sums], axis=1))
    count = back - least + 1
    rows = np.repeat(np.arange(n), count)
    x = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count) + least[rows]
    rank = batch.column("rank").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = rank[rows] ^ (sides[0][rows, x] * np.uint64(0xBF58476D1CE4E5B9) + sides[1][rows, span - x] * np.uint64(0x94D049BB133111EB) + x.astype(np.uint64))
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return rows, x, h ^ (h >> np.uint64(32))


def _owner(batch: pa.RecordBatch, unit: Unit) -> np.ndarray:
    """Tells apart what may repeat each other: documents, or positions."""
    out = batch.column("doc").to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + batch.column("tag").to_numpy().view(np.uint64)
    if not unit.across:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + batch.column("place").to_numpy().view(np.uint64)
    return ((out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)).view(np.int64)


RANGES = "doc long, tag long, start long, end long"


def _ranges(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray, unit: Unit) -> pa.RecordBatch:
    """Symbols covered by the given windows, runs of windows as one range; rows and x ascend."""
    place = batch.column("place").to_numpy() >> 16
    cut = np.flatnonzero((np.diff(rows) != 0) | (np.diff(x) != 1)) + 1
    first, last = (np.concatenate([[0], cut]), np.concatenate([cut, [len(x)]]) - 1) if len(x) else (np.zeros(0, int), np.zeros(0, int))
    own = rows[first]
    take = pa.array(own)
    return pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("tag").take(take), pa.array(place[own] - x[last]), pa.array(place[own] - x[first] + unit.length)], names=["doc", "tag", "start", "end"])


def _shared_windows(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """Ranges of repeated windows of positions alone in their class; rows arrive sorted by rank, a rank may go over several batches."""
    rest: pa.RecordBatch | None = None

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, x, h = window_hashes(batch, unit)
        owner = _owner(batch, unit)[rows]
        order = np.argsort(h, kind="stable")
        start = np.concatenate([[0], np.flatnonzero(np.diff(h[order])) + 1])
        several = np.minimum.reduceat(owner[order], start) != np.maximum.reduceat(owner[order], start)
        some = np.zeros(len(h), bool)
        some[order] = np.repeat(several, np.diff(np.append(start, len(h))))
        some &= batch.column("alone").to_numpy(zero_copy_only=False)[rows]
        return _ranges(batch, rows[some], x[some], unit)

    for batch in batches:
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        rank = batch.column("rank").to_numpy()
        before = np.flatnonzero(rank != rank[-1])
        cut = int(before[-1]) + 1 if len(before) else 0
        rest = batch.slice(cut)
        if cut:
            yield found(batch.slice(0, cut))
    if rest is not None and rest.num_rows:
        yield found(rest)


def _window_rows(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    """One row per window, for ranks of very many classes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            rows, x, h = window_hashes(part, unit)
            take = pa.array(rows)
            start = (part.column("place").to_numpy() >> 16)[rows] - x
            columns = [part.column(name).take(take) for name in ("doc", "tag", "alone")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(_owner(part, unit)[rows]), pa.array(start), pa.array(h.view(np.int64))], names=["doc", "tag", "alone", "owner", "start", "window"])


def _trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text without its covered ranges."""
    for batch in small_batches(batches, "raw"):
        rows = []
        for doc_id, text, ranges, passage in zip(*(batch.column(i).to_pylist() for i in ("doc_id", "raw", "ranges", "passage")), strict=True):
            kept, at, runs = hashlib.sha256(), 0, 0
            for start, end in sorted((x["start"], x["end"]) for x in ranges or ()):
                if start > at or not runs:
                    runs += 1
                    kept.update(text[at:start])
                at = max(at, end)
            removed = covered(ranges or ())
            kept.update(text[at:])
            rows.append((doc_id, len(text), removed, runs, kept.hexdigest(), passage))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "shared_passage"])


def covered(ranges) -> int:
    """Bytes in the union of ranges."""
    total = at = 0
    for start, end in sorted((x["start"], x["end"]) for x in ranges):
        total += max(0, end - max(start, at))
        at = max(at, end)
    return total


def _screened(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs that may be among keys (doc, tag), and those that certainly are not."""
    screen = screen_of(keys.select(F.xxhash64("doc", "tag").alias("k")).distinct(), SENT_KEYS)
    if screen is None:
        return docs, docs.where("false")
    may = held_udf(docs, screen)(F.xxhash64("doc", "tag"))
    return docs.where(may), docs.where(~may)


def _reranked(live: DataFrame, name: str) -> DataFrame:
    """One doubling: pairs (rank, next) that several rows share, one of them alone in its class, ranked anew by their order; all other rows go.

    live: rows with rank, next (the rank at the offset) and n (of their class). Only shared pairs are sorted, one row each.
    """
    shared = live.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("least")).where("classes > 1 AND least = 1")
    ordered = shared.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next")
    ranks = written(ordered.select(F.col("rank").alias("p0"), F.col("next").alias("p1"), "classes", F.monotonically_increasing_id().alias("new")), f"ranks-{name}")
    paired = live.join(ranks, (F.col("rank") == F.col("p0")) & (F.col("next") == F.col("p1")))
    rest = [c for c in live.columns if c not in ("rank", "next")]
    return written(paired.select(F.col("new").alias("rank"), "classes", *rest), f"live-{name}")


def _doubled(classes: DataFrame, unit: Unit) -> DataFrame:
    """Classes (doc, tag, place, n, rank, base1 to base3) that share 4 * base symbols with others: doc, tag, place, n, rank, classes.

    Round one pairs each position's first rank with that at the offset base; then, of what is left, the
    first ranks at the offsets 2 * base and 3 * base. Round two looks the rank at the offset 2 * base up
    among the latter by document and position.
    """
    at = F.shiftright("place", 16)
    once = _reranked(classes.withColumnRenamed("base1", "next"), "1").drop("classes")
    far = once.select("doc", "tag", (at + 2 * unit.base).alias("pos"), "n", F.col("base2").alias("rank"), F.col("base3").alias("next"))
    ahead = _reranked(far, "1-ahead").select(F.col("doc").alias("d"), F.col("tag").alias("t"), F.col("pos").alias("p"), F.col("rank").alias("next")).distinct()
    met = once.join(ahead, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t")) & (at + 2 * unit.base == F.col("p")))
    return _reranked(met.select("doc", "tag", "place", "n", "rank", "next"), "2")


def repeated_ranges(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """Ranges (doc, tag, start, end), in symbols, that repeated strings cover; docs has doc, tag, raw.

    With unit.across, of several equal positions in one document only one need be given.
    """
    spark = docs.sparkSession
    keys = docs.select("raw").mapInArrow(lambda b: _keys(b, unit), "key long")
    repeated = written(keys.groupBy("key").count().where("count > 1").select("key"), "ranks-first")
    screen = screen_of(repeated, SENT_KEYS)
    sent = spark.sparkContext.broadcast(screen)
    positions = docs.select("doc", "tag", "raw").mapInArrow(lambda b: _positions(b, sent.value, unit), POSITIONS)
    if screen is None:
        positions = positions.join(repeated.withColumnRenamed("key", "rank"), "rank", "left_semi")
    names = [c.split()[0] for c in POSITIONS.split(", ")]
    positions = written(positions.select(*names), "positions")
    reach = F.col("place").bitwiseAND(F.lit(0xFFFF))
    # The fingerprint of all bytes that the windows cover stands for the ranks at the offsets, too.
    alike = ["rank", "whole", "reach"]
    owner = F.struct("doc", "tag")
    one = F.min(F.struct("doc", "tag", "place", "base1", "base2", "base3")).alias("one")
    n = F.when(F.min(owner) == F.max(owner), 1).otherwise(2) if unit.across else F.count(F.lit(1))
    classes = written(positions.withColumn("reach", reach).groupBy(*alike).agg(n.cast("long").alias("n"), one), "classes")
    several = positions.select("doc", "tag", "rank", "whole", "place", reach.alias("reach")).join(classes.where("n > 1").select(*alike), alike, "left_semi")
    at = F.shiftright("place", 16)
    whole = several.select("doc", "tag", (at - F.shiftright("reach", 8)).alias("start"), (at - F.col("reach").bitwiseAND(F.lit(255)) + unit.length).alias("end"))
    live = _doubled(classes.select("rank", "n", "one.*"), unit)
    asked = live.select("rank", "classes", (F.col("n") == 1).alias("alone"), "doc", "tag", "place")
    by_doc = asked.groupBy("doc", "tag").agg(F.collect_list(F.struct("rank", "classes", "alone", "place")).alias("asked"))
    some, _ = _screened(docs, asked)
    contexts = written(some.join(by_doc, ["doc", "tag"]).select("doc", "tag", "raw", "asked").mapInArrow(lambda b: _contexts(b, unit), CONTEXTS), "contexts")
    few = contexts.where(F.col("classes") <= CLASSES).repartition("rank").sortWithinPartitions("rank").mapInArrow(lambda b: _shared_windows(b, unit), RANGES)
    every = contexts.where(F.col("classes") > CLASSES).mapInArrow(lambda b: _window_rows(b, unit), "doc long, tag long, alone boolean, owner long, start long, window long")
    shared = every.groupBy("window").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a != b").select("window")
    many = every.where("alone").join(shared, "window", "left_semi").select("doc", "tag", "start", (F.col("start") + unit.length).alias("end"))
    return whole.unionByName(few).unionByName(many)


def trimmed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared_passage (whether it holds over 50 words in a row that another document holds, too)."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    tag = F.crc32(raw) + F.when(F.col("doc_id").isNull(), F.lit(1 << 32)).otherwise(F.lit(0))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc"), tag.cast("long").alias("tag"), raw.alias("raw"))
    kinds = "array<struct<start:bigint,end:bigint>>"
    covers = repeated_ranges(rows).select("doc", "tag", F.struct("start", "end").alias("cover"), F.lit(False).alias("passage"))
    passages = repeated_ranges(rows, PASSAGES).select("doc", "tag", F.lit(None).cast("struct<start:bigint,end:bigint>").alias("cover"), F.lit(True).alias("passage")).distinct()
    ranges = written(covers.unionByName(passages).groupBy("doc", "tag").agg(F.collect_list("cover").alias("ranges"), F.max("passage").alias("passage")), "ranges")
    some, others = _screened(rows, ranges)
    joined = some.join(ranges, ["doc", "tag"], "left").select("doc_id", "raw", "ranges", F.coalesce("passage", F.lit(False)).alias("passage"))
    clean = others.select("doc_id", "raw", F.lit(None).cast(kinds).alias("ranges"), F.lit(False).alias("passage"))
    return joined.unionByName(clean).mapInArrow(_trimmed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shared_passage boolean")
