"""Voltages, dimensions, amperages and number pairs as arrays of values, and their comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound, fold, once, plausible_fraction

#: Patterns of the measures.
VOLTAGE = (
    r"(?i)(?<![A-Z0-9])(\d+(?:\.\d+)?)(?:\s*KVAC(?:\s*AC)?|\s*KVDC(?:\s*DC)?|\s*KV(?![A-Z])(?:\s*(?:AC|DC))?"
    r"|\s+(?:KILOVOLTS|KILOVOLT)(?:\s*(?:AC|DC))?|\s*VAC(?:\s*AC)?|\s*VDC(?:\s*DC)?|\s*V(?![A-Z])\s*(AC|DC)?|\s+(?:VOLTS|VOLT|VOLTAGE)\s*(AC|DC)?)(?![A-Z0-9])"
)
AMPERAGE = r"(?i)(?<![A-Z0-9])(\d+(?:\.\d+)?)(?:\s*A(?![A-Z])|\s+(?:AMPS|AMPERES|AMPERE|AMP)\b)(?![A-Z0-9])"
PAIR = r"(?i)(?<![A-Z0-9.])(\d+(?:\.\d+)?)\s*[\"″”'′]?\s*x\s*(\d+(?:\.\d+)?)\s*[\"″”'′]?(?![A-Z0-9])"
_WORD_NUMBER = r"(?:(\d+)(?:\s*-\s*|\s+)(\d+)\s*/\s*(\d+)|(\d+)\s*/\s*(\d+)|(\d*\.\d+)|(\d+))"
_MARK_NUMBER = r"(?:(\d{1,2})(?:\s*-\s*|\s+)(\d{1,2})\s*/\s*(\d{1,2})|(\d{1,2})\s*/\s*(\d{1,2})|(\d{0,2}\.\d{1,2})|(\d{1,2}))"
DIMENSION = (
    rf"(?i)(?:(?<![A-Z0-9]){_WORD_NUMBER}\s*(?:INCHES|INCH|INS|\bIN\b|FEET|FOOT|FT)(?![A-Z0-9])"
    rf"|(?<!\d){_MARK_NUMBER}\s*(?:[\"″”]|['′])"
    r"|(?<![A-Z0-9])(\d{1,2})-(\d{1,2})/(\d{1,2})(?![A-Z0-9])|(?<![A-Z0-9])(\d+)\s*/\s*(\d+)(?![A-Z0-9]))"
)


#: What sets hits and their groups apart while a text is cut, and what stands for these two in a text; no pattern meets any of them.
_HIT, _GROUP, _OTHER = "\x01", "\x02", "\x03"


def _groups(text: Column, pattern: str, indices: list[int]) -> Column:
    """For each hit an array of the asked groups; a group that took no part is empty. The text is searched once, whatever the number of groups and hits."""
    marked = F.regexp_replace(F.translate(text, _HIT + _GROUP, _OTHER * 2), pattern, _HIT + _GROUP.join(f"${i}" for i in indices) + _HIT)
    hits = F.filter(F.split(marked, _HIT, -1), lambda _, i: i % 2 == 1)
    return F.transform(hits, lambda x: F.split(x, _GROUP, -1))


def _rewritten(source: Column, pattern: str, word: Callable[[Column], Column]) -> Column:
    """source with each hit replaced by word of it."""
    pieces = F.zip_with(F.split(source, pattern, -1), F.transform(F.regexp_extract_all(source, F.lit(pattern), F.lit(0)), word), lambda b, w: F.concat(b, F.coalesce(w, F.lit(""))))
    return fold(F.array_join(pieces, ""))


def voltages(text: Column) -> Column:
    """Distinct (volts, polarity) in order; kilovolts count as thousands."""

    def one(g: Column) -> Column:
        body = F.upper(F.regexp_replace(g[0], " ", ""))
        kilo = F.contains(body, F.lit("KV")) | F.contains(body, F.lit("KILOVOLT"))
        volts = F.round(g[1].cast("double") * F.when(kilo, 1000).otherwise(1)).cast("long")
        stated = F.upper(F.concat(g[2], g[3]))
        polarity = F.when(stated != "", stated).when(body.endswith("AC") | F.contains(body, F.lit("VAC")), "AC").when(body.endswith("DC") | F.contains(body, F.lit("VDC")), "DC")
        return F.struct(volts.alias("volts"), polarity.alias("polarity"))

    return F.array_distinct(F.transform(_groups(fold(text), VOLTAGE, [0, 1, 2, 3]), one))


def amperages(text: Column) -> Column:
    """Distinct amperes as doubles, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(fold(text), F.lit(AMPERAGE), F.lit(1)), lambda a: a.cast("double")))


def number_pairs(text: Column) -> Column:
    """Pairs such as `2 x 3` without a unit, in order."""
    return F.transform(_groups(fold(text), PAIR, [1, 2]), lambda g: F.struct(g[0].cast("double").alias("a"), g[1].cast("double").alias("b")))


def dimensions(text: Column) -> Column:
    """Distinct (key, inches, unit) in order: key is the value with six places and its unit; feet are not converted."""

    def one(g: Column) -> Column:
        n = lambda i: F.when(g[i] != "", g[i].cast("double"))
        mixed = lambda a: n(a) + n(a + 1) / F.when(n(a + 2) != 0, n(a + 2))
        ratio = lambda a: n(a) / F.when(n(a + 1) != 0, n(a + 1))
        bare_mixed = F.when(plausible_fraction(n(16).cast("long"), n(17).cast("long")), mixed(15))
        bare = F.when(plausible_fraction(n(18).cast("long"), n(19).cast("long")), ratio(18))
        value = F.coalesce(mixed(1), mixed(8), ratio(4), ratio(11), n(6), n(13), n(7), n(14), bare_mixed, bare)
        unit = F.when(g[0].rlike(r"(?i)FEET|FOOT|FT|['′]"), "FT").otherwise("IN")
        return F.struct(F.concat(F.format_string("%.6f", value), unit).alias("key"), value.alias("inches"), unit.alias("unit"))

    found = F.transform(_groups(fold(text), DIMENSION, list(range(20))), one)
    return F.array_distinct(F.filter(found, lambda d: d["inches"].isNotNull()))


def dimension_words(text: Column) -> Column:
    """The text with each dimension written as its value and unit, for comparable tokens."""

    def word(hit: Column) -> Column:
        value = lambda d: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", d["inches"]), "0+$", ""), r"\.$", "")
        return once(F.get(dimensions(hit), F.lit(0)), lambda d: F.coalesce(F.concat(F.lit(" "), value(d), F.lit(" "), d["unit"], F.lit(" ")), hit))

    return once(fold(text), lambda source: _rewritten(source, DIMENSION, word))


def voltage_words(text: Column) -> Column:
    """The text with each voltage written as volts, V and polarity."""

    def word(hit: Column) -> Column:
        said = lambda v: F.concat(F.lit(" "), v["volts"].cast("string"), F.lit(" V "), F.coalesce(F.concat(v["polarity"], F.lit(" ")), F.lit("")))
        return once(F.get(voltages(hit), F.lit(0)), lambda v: F.coalesce(said(v), hit))

    return once(fold(text), lambda source: _rewritten(source, VOLTAGE, word))


def unit_words(text: Column) -> Column:
    """The text with dimensions, then voltages, written as comparable tokens."""
    return voltage_words(dimension_words(text))


def decimal_text(value: Column, places: int = 4) -> Column:
    """A number with so many places at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{places}f", value), "0+$", ""), r"\.$", "")


def _first_of_each(found: Column, kind: str, key: str) -> Column:
    """Structs of an array, each key once, in order."""
    none = F.expr(f"CAST(array() AS array<{kind}>)")
    return F.aggregate(found, none, lambda seen, x: F.when(F.exists(seen, lambda y: y[key].eqNullSafe(x[key])), seen).otherwise(F.concat(seen, F.array(x))))


def said(text: Column) -> Column:
    """What a text says of voltages, dimensions and amperages: struct of three arrays of (key, raw, display), each value once."""
    kind = "struct<key:string,raw:string,display:string>"

    def spec(key: Column, raw: Column, display: Column) -> Column:
        return F.struct(key.alias("key"), F.trim(raw).alias("raw"), display.alias("display"))

    def volt(raw: Column) -> Column:
        kilo = raw.rlike(r"(?i)K\s*V|KILOVOLT")
        base = lambda v: F.when(kilo, F.concat(decimal_text(v["volts"] / 1000.0, 3), F.lit("KV"))).otherwise(F.concat(v["volts"].cast("string"), F.lit("V")))
        return once(F.get(voltages(raw), F.lit(0)), lambda v: spec(F.concat_ws("|", v["volts"].cast("string"), v["polarity"]), raw, F.concat_ws(" ", base(v), v["polarity"])))

    def size(raw: Column) -> Column:
        return spec(F.get(dimensions(raw), F.lit(0))["key"], raw, F.trim(raw))

    def amp(raw: Column) -> Column:
        return once(F.get(amperages(raw), F.lit(0)), lambda a: spec(decimal_text(a, 6), raw, F.concat(decimal_text(a), F.lit("A"))))

    hits = lambda source, pattern: F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    known = lambda array: F.filter(array, lambda x: x["key"].isNotNull() & (x["key"] != ""))
    found = (("volts", VOLTAGE, volt), ("dims", DIMENSION, size), ("amps", AMPERAGE, amp))
    return once(fold(text), lambda source: F.struct(*(_first_of_each(known(F.transform(hits(source, pattern), one)), kind, "key").alias(name) for name, pattern, one in found)))


def unit_lines(asked: Column, row: Column, voltage: Column, dimension: Column, amperage: Column) -> Column:
    """One line for each kind of measure that both sides state, from their `said` and the states of comparison."""
    return bound(_unit_lines, asked, row, voltage, dimension, amperage)


def _unit_lines(asked: Column, row: Column, voltage: Column, dimension: Column, amperage: Column) -> Column:
    def line(kind: str, name: str, state: Column, shown: str, every: bool) -> Column:
        a, b = F.get(asked[kind], F.lit(0)), F.get(row[kind], F.lit(0))
        listed = lambda side: F.array_join(F.transform(side[kind], lambda x: x["display"]), ", ")
        both = (listed(asked), listed(row)) if every else (a["raw"], b["raw"])
        apart = F.concat(F.lit(f"{name} mismatch: requested "), both[0], F.lit(", catalog "), both[1])
        return F.when(a.isNotNull() & b.isNotNull(), F.when(state == "match", F.concat(F.lit(f"{name}: "), b[shown], F.lit(" ↔ "), a["raw"], F.lit(" — Match"))).when(state == "conflict", apart))

    lines = (line("volts", "Voltage", voltage, "display", True), line("dims", "Dimension", dimension, "raw", False), line("amps", "Amperage", amperage, "display", True))
    return F.array_distinct(F.array_compact(F.array(*lines)))


def overlap_status(query: Column, candidate: Column) -> Column:
    """none if either side states nothing, match if they share a value, else conflict."""
    return bound(_overlap, query, candidate)


def _overlap(query: Column, candidate: Column) -> Column:
    return F.when((F.size(query) == 0) | (F.size(candidate) == 0), "none").when(F.arrays_overlap(query, candidate), "match").otherwise("conflict")


def voltage_status(query: Column, candidate: Column) -> Column:
    """By volts; a match becomes a conflict when both sides state polarities and share none."""
    volts = lambda x: F.transform(x, lambda v: v["volts"])
    stated = lambda x: F.filter(F.transform(x, lambda v: v["polarity"]), lambda p: p.isNotNull())
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    state = lambda q, c: F.when((overlap_status(volts(q), volts(c)) == "match") & bound(apart, stated(q), stated(c)), "conflict").otherwise(overlap_status(volts(q), volts(c)))
    return bound(state, query, candidate)


def dimension_status(query: Column, candidate: Column) -> Column:
    """As overlap_status, but two or more dimensions on both sides must be equal in order."""
    equal = lambda q, c: F.when(q == c, "match").otherwise("conflict")
    return bound(lambda q, c: F.when((F.size(q) >= 2) & (F.size(c) >= 2), equal(q, c)).otherwise(_overlap(q, c)), query, candidate)


def pair_status(query: Column, candidate: Column) -> Column:
    """Whether the query's first number pair is among the candidate's."""
    state = lambda q, c: F.when((F.size(q) == 0) | (F.size(c) == 0), "none").when(F.array_contains(c, F.get(q, F.lit(0))), "match").otherwise("conflict")
    return bound(state, query, candidate)


def numeric_component(voltage: Column, dimension: Column, amperage: Column) -> Column:
    """Struct of score (0, 100 or null), conflict and label over the three states."""
    any_of = lambda state: (voltage == state) | (dimension == state) | (amperage == state)
    score = F.when(any_of("conflict"), 0.0).when(any_of("match"), 100.0)
    label = F.when(any_of("conflict"), "Conflict").when(any_of("match"), "Match").otherwise("Not Found")
    return F.struct(score.alias("score"), any_of("conflict").alias("conflict"), label.alias("label"))
