"""Text rules as column expressions; nothing here leaves the JVM but NFC of non-ASCII text."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import vocab

SPACE = r"(?U)[\s\x1c-\x1f\x85]+"


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once; Catalyst copies a large x into each of its uses in f."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def bound(f: Callable[..., Column], *xs: Column) -> Column:
    """f(*xs) with each of xs evaluated once, as `once` for several."""
    held = F.struct(*(x.alias(f"x{i}") for i, x in enumerate(xs)))
    return F.get(F.transform(F.array(held), lambda s: f(*(s[f"x{i}"] for i in range(len(xs))))), F.lit(0))


def words(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def lookup(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def fold(text: Column, compose: bool = False) -> Column:
    """Hyphens to one kind, white space collapsed and trimmed; compose adds NFC, for text beyond ASCII."""
    source = F.coalesce(text, F.lit(""))
    if compose:
        source = nfc(source)
    source = F.translate(source, "‐‑‒–—−", "------")
    return F.trim(F.regexp_replace(source, SPACE, " "))


def normalize_text(text: Column) -> Column:
    """Upper case, joined separators squeezed, other punctuation to blanks, decimals kept."""
    x = F.regexp_replace(F.upper(fold(text)), "&", " AND ")
    x = F.regexp_replace(x, r"\s*([/\-_.+])\s*", "$1")
    x = F.regexp_replace(x, r"(?<![A-Z0-9])(\d+)\.(\d+)(?![A-Z0-9])", "$1§$2")
    x = F.regexp_replace(x, r"(?U)[^\w\s/§]+", " ")
    return F.trim(F.regexp_replace(F.translate(x, "§", "."), r"\s+", " "))


def code_as_given(value: Column) -> Column:
    """A product code as text: no grouping of thousands, no trailing .0; folded."""
    x = F.trim(F.coalesce(value.cast("string"), F.lit("")))
    x = F.when(x.rlike(r"^\d{1,3}(,\d{3})+$"), F.translate(x, ",", "")).otherwise(F.regexp_replace(x, r"^([+-]?\d+)\.0+$", "$1"))
    return fold(x)


def code_text(value: Column) -> Column:
    """The same in upper case."""
    return F.upper(code_as_given(value))


def compact(value: Column) -> Column:
    return F.regexp_replace(code_text(value), "[^A-Z0-9]+", "")


def compact_word(word: Column) -> Column:
    return F.regexp_replace(F.upper(word), "[^A-Z0-9]+", "")


def code_words(value: Column) -> Column:
    return F.filter(F.split(code_text(value), " "), lambda w: w != "")


def is_generic(word: Column) -> Column:
    """No digit and at most two letters."""
    c = compact_word(word)
    return ~c.rlike("[0-9]") & (F.length(c) <= 2)


def _prose(w: Column) -> Column:
    return F.array_contains(words(vocab.PROSE), F.regexp_replace(w, r"^[:,;.]+|[:,;.]+$", ""))


def is_code_query(value: Column) -> Column:
    w = code_words(value)
    return (F.size(w) >= 1) & (F.size(w) <= 6) & ~F.exists(w, _prose)


def is_code_like(value: Column) -> Column:
    w = code_words(value)
    return (F.size(w) >= 1) & (F.size(w) <= 8) & ~F.exists(w, _prose) & compact(value).rlike("[0-9]")


def embedded_hits(query: Column, value: Column) -> Column:
    """Words of the query whose compact form is part of the value's."""
    return once(compact(value), lambda c: F.filter(code_words(query), lambda w: (F.length(compact_word(w)) >= 2) & F.contains(c, compact_word(w))))


def part_number(value: Column) -> Column:
    """Folded, upper, quotes and brackets around removed, separators squeezed, no blanks."""
    x = F.upper(fold(value))
    x = F.regexp_replace(x, r"^[\s\"'()\[\]{},;:.]+|[\s\"'()\[\]{},;:.]+$", "")
    return F.regexp_replace(F.regexp_replace(x, r"\s*([/\-_.+])\s*", "$1"), r"\s+", "")


def lookup_keys(value: Column) -> Column:
    """The key and its form with or without the prefix NA1-."""
    key = part_number(value)
    other = F.when(key.startswith("NA1-"), F.substring(key, 5, 1 << 20)).otherwise(F.concat(F.lit("NA1-"), key))
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(key, other)))


def same_part(left: Column, right: Column) -> Column:
    """Whether two part numbers have one, not empty, key."""
    return (part_number(left) != "") & (part_number(left) == part_number(right))


def looks_like_part(value: Column) -> Column:
    """One word with a key."""
    return (fold(value) != "") & ~F.contains(fold(value), F.lit(" ")) & (part_number(value) != "")


def without_prefix(value: Column) -> Column:
    """What follows NA1- in a part number's key; empty without that prefix."""
    key = part_number(value)
    return F.when(key.startswith("NA1-"), F.substring(key, 5, 1 << 20)).otherwise("")


def label_words(text: Column) -> Column:
    """Words of a leading label such as `Cable Tray:`; empty if there is none."""
    label = F.regexp_extract(text, r"^\s*([A-Za-z]+(?:\s+[A-Za-z]+){0,2})\s*:\s*", 1)
    return F.when(label == "", F.array().cast("array<string>")).otherwise(F.split(F.upper(label), r"\s+"))


def without_label(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*[A-Za-z]+(?:\s+[A-Za-z]+){0,2}\s*:\s*", "")


def strut_codes(text: Column) -> Column:
    """`B-22SS` style codes: the dash goes, a finish is set apart."""
    finish = "|".join(vocab.FINISHES)
    x = F.regexp_replace(text, rf"\b([A-Za-z]{{1,3}})-(\d{{3,5}})((?i:{finish}))\b", "$1$2 $3")
    return F.regexp_replace(x, r"\b([A-Za-z]{1,3})-(\d{3,5})([A-Za-z]{1,3})?\b", "$1$2$3")


def acronyms(text: Column) -> Column:
    for pattern, new in vocab.ACRONYMS:
        text = F.regexp_replace(text, f"(?i){pattern}", new)
    return text


def hole_count(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?i)\b1[\s-]?H\b", "ONE HOLE"), r"(?i)\b2[\s-]?H\b", "TWO HOLE")


def plausible_fraction(num: Column, den: Column) -> Column:
    return (den != 0) & (F.try_mod(num, den) != 0) & den.isin(2, 4, 8, 16, 32, 64)


def gauge_variant(word: Column) -> Column:
    """10/3 as 10-3 and back, unless it is a plausible size; else null."""
    a, sep, b = (F.regexp_extract(word, r"^(\d{1,2})([/-])(\d{1,2})$", i) for i in (1, 2, 3))
    size = F.coalesce(plausible_fraction(a.try_cast("int"), b.try_cast("int")), F.lit(False))
    return F.when((sep != "") & ~size, F.concat(a, F.when(sep == "/", "-").otherwise("/"), b))


def strip_zero(word: Column) -> Column:
    return F.when(word.rlike("^[0-9]+$"), F.regexp_replace(word, r"^0+(\d)", "$1")).otherwise(word)


def distinctive(tokens: Column) -> Column:
    """Tokens that narrow a search: numbers of two digits, one digit unless before a fraction, words of three letters."""

    def kept(found: Column) -> Column:
        def keep(w: Column, i: Column) -> Column:
            bare = F.regexp_replace(w, r"^([^.]*)\.", "$1")
            following = F.coalesce(F.get(found, i + 1), F.lit(""))
            return F.when(bare.rlike("^[0-9]+$"), (F.length(bare) >= 2) | ~F.contains(following, F.lit("/"))).otherwise(F.length(w) >= 3)

        return F.filter(found, keep)

    return once(tokens, kept)


def quantity(source: Column) -> Column:
    """The first quantity phrase's number in folded text, unless it reads as a voltage or fraction."""

    def one(pattern: str) -> Column:
        hit = F.regexp_extract(source, f"(?i){pattern}", 1)
        # what stands around the number of the first hit
        before = F.regexp_extract(source, f"(?i)^(.*?){pattern}", 0)
        whole = F.regexp_extract(source, f"(?i){pattern}", 0)
        start = F.length(before) - F.length(whole) + F.position(hit, whole)
        window = F.substring(source, F.greatest(start - 1, F.lit(1)), F.length(hit) + F.when(start > 1, 3).otherwise(2))
        rest = F.ltrim(F.substring(source, start + F.length(hit), F.lit(8)))
        bad = window.rlike(r"(?i)\d+V") | F.contains(window, F.lit("/")) | rest.rlike(r"(?i)^V(?:$|[^A-Za-z]|OLT)")
        # Nearly all texts fail the first test, and only it is run for them.
        return F.when(source.rlike(f"(?i){pattern}") & (hit != "") & ~bad, hit.cast("int"))

    return F.coalesce(*(one(p) for p in vocab.QUANTITIES))


def without_quantity(text: Column) -> Column:
    """Quantity phrases blanked out, but for those whose number reads as a voltage or fraction."""
    x = fold(text)
    for p in vocab.QUANTITIES:
        guarded = p.replace(r"(\d+)", r"(?<!/)(\d+)(?![\d/]|.?/|\s*V(?:[^A-Za-z]|$|OLT))", 1)
        x = F.regexp_replace(x, f"(?i){guarded}", " ")
    return fold(x)


def without_noise(text: Column) -> Column:
    """Only meaningful word spans, single-spaced; inch and foot marks stay."""
    x = F.regexp_replace(fold(text), r"([\"″”'′])([xX])([0-9.])", "$1 $2 $3")
    spans = F.regexp_extract_all(x, F.lit(r"\.?[A-Za-z0-9]+(?:/[A-Za-z0-9]+)*(?:[\"″”'′])?"), F.lit(0))
    return F.array_join(F.filter(spans, lambda w: ~F.array_contains(words(vocab.NOISE), F.upper(w))), " ")


def raw_tokens(text: Column) -> Column:
    """Upper-case tokens of a text before synonyms, without unit rewriting: sizes kept or cut, units set apart."""
    raw = F.regexp_extract_all(normalize_text(text), F.lit(r"[A-Z0-9]+(?:\.[0-9]+)?(?:/[A-Z0-9]+)*"), F.lit(0))

    def cut(w: Column) -> Column:
        box = r"^(\d+(?:X\d+){1,2})(FT|IN)?$"
        unit = F.regexp_extract(w, box, 2)
        boxed = F.split(F.regexp_extract(w, box, 1), "X")
        return (
            F.when(w.rlike(r"^\d+/\d+$"), F.array(w))
            .when(w.rlike(box), F.concat(boxed, F.when(unit != "", F.array(unit)).otherwise(F.array().cast("array<string>"))))
            .otherwise(F.split(w, "/"))
        )

    return F.filter(F.flatten(F.transform(F.flatten(F.transform(raw, cut)), attached_unit)), lambda w: w != "")


def attached_unit(w: Column) -> Column:
    """A token with its unit set apart, as an array: 120V, VAC, 30A."""
    measure = r"^(\d+)(VAC|VDC|KV|V|A)$"
    number, unit = F.regexp_extract(w, measure, 1), F.regexp_extract(w, measure, 2)
    named = F.when(unit == "VAC", F.array(F.lit("V"), F.lit("AC"))).when(unit == "VDC", F.array(F.lit("V"), F.lit("DC"))).when(unit == "A", F.array(F.lit("AMP"))).otherwise(F.array(unit))
    return F.when(w.rlike(measure), F.concat(F.array(number), named)).when(w == "VAC", F.array(F.lit("V"), F.lit("AC"))).when(w == "VDC", F.array(F.lit("V"), F.lit("DC"))).otherwise(F.array(w))


def tokens(text: Column) -> Column:
    """Canonical tokens of a text: raw ones with synonyms mapped and stopwords dropped."""
    mapped = lookup(vocab.CANONICAL)
    kept = F.filter(raw_tokens(text), lambda w: (w != "W") & (mapped[w].isNotNull() | ~F.array_contains(words(vocab.STOPWORDS), w)))
    return F.transform(kept, lambda w: F.coalesce(mapped[w], w))


def abbreviations(asked: Column, row: Column) -> Column:
    """Which words of a request stand in a row by their short form: `extension → EXT`, `120 volts → 120V`.

    asked: the request's `raw_tokens`; row: the canonical tokens of a catalog text. A number before a word for
    volts is told with it; any other synonym counts if the row holds its canonical form.
    """
    return bound(_abbreviations, asked, row)


def _abbreviations(asked: Column, row: Column) -> Column:
    mapped = lookup(vocab.CANONICAL)
    short = lambda w: F.coalesce(mapped[w], w)
    none = F.array().cast("array<string>")
    arrow = F.lit(" → ")

    def at(w: Column, i: Column) -> Column:
        after, before = F.coalesce(F.get(asked, i + 1), F.lit("")), F.coalesce(F.get(asked, i - 1), F.lit(""))
        volts = w.rlike("^[0-9]+$") & (short(after) == "V")
        told = F.lower(after)
        both = F.array(F.concat(told, arrow, F.lit("V")), F.concat(w, F.lit(" "), told, arrow, w, F.lit("V")))
        alone = mapped[w].isNotNull() & (w != short(w)) & F.array_contains(row, short(w))
        return (
            F.when(volts, F.when(F.array_contains(row, w) | F.array_contains(row, "V"), both).otherwise(none))
            .when((short(w) == "V") & before.rlike("^[0-9]+$"), none)
            .when(alone, F.array(F.concat(F.lower(w), arrow, short(w))))
            .otherwise(none)
        )

    return F.array_distinct(F.flatten(F.transform(asked, at)))


def search_steps(text: Column) -> Column:
    """How a request becomes search text: struct of original, quantity, text without it, without noise, canonical text and tokens."""

    def told(original: Column, plain: Column, clean: Column, found: Column) -> Column:
        return F.struct(
            original.alias("original_input"), quantity(original).alias("extracted_quantity"), plain.alias("after_quantity_removal"), clean.alias("after_noise_removal"),
            F.lower(F.array_join(found, " ")).alias("after_terminology_normalization"), F.transform(found, F.lower).alias("tokens"),
        )

    step = lambda original, plain: once(without_noise(plain), lambda clean: once(tokens(clean), lambda found: told(original, plain, clean, found)))
    return once(fold(text), lambda original: once(without_quantity(original), lambda plain: step(original, plain)))


def canonical(text: Column) -> Column:
    """All canonical tokens as one text."""
    return F.array_join(tokens(text), " ")


def has_all(array: Column, values: list[str]) -> Column:
    return F.size(F.array_intersect(array, words(values))) == len(values)


def expand_phrases(text: Column, found: Column) -> Column:
    """The text with each known phrase appended whose words are all among the tokens found."""
    return F.concat_ws(" ", text, *(F.when(has_all(found, need), F.lit(new)) for need, new in vocab.PHRASES))


def _default_tokens() -> Column:
    return lookup({k: " ".join(vocab.CANONICAL.get(w, w) for w in v.split()) for k, v in vocab.CATEGORY_DEFAULTS.items()})


def bare_category(found: Column) -> Column:
    """The one category word, if every other descriptive token belongs to its default or is compatible; else null."""

    def single(descriptive: Column, category: Column) -> Column:
        def fitting(one: Column, default: Column) -> Column:
            return F.when(F.forall(descriptive, lambda w: (w == one) | F.array_contains(default, w) | w.isin(vocab.COMPATIBLE)), one)

        one = F.get(category, F.lit(0))
        return F.when(F.size(category) == 1, bound(fitting, one, F.split(_default_tokens()[one], " ")))

    told = F.filter(found, lambda w: w.rlike("[A-Za-z]") & ~w.isin(vocab.UNIT_WORDS))
    return once(told, lambda descriptive: once(F.filter(descriptive, lambda w: w.isin(list(vocab.CATEGORY_DEFAULTS))), lambda category: single(descriptive, category)))


def expand_category(text: Column, category: Column) -> Column:
    return F.concat_ws(" ", text, lookup(vocab.CATEGORY_DEFAULTS)[category])


def reduce_category(found: Column, category: Column) -> Column:
    """Tokens without those that the bare category's default repeats."""

    def reduced(found: Column, category: Column) -> Column:
        left = lambda default: F.filter(found, lambda w: (w == category) | ~(F.array_contains(default, w) & w.rlike("[A-Za-z]") & ~w.isin(vocab.UNIT_WORDS)))
        return F.when(category.isNull(), found).otherwise(once(F.split(_default_tokens()[category], " "), left))

    return bound(reduced, found, category)


def reduce_tray(found: Column) -> Column:
    return once(found, _reduce_tray)


def _reduce_tray(found: Column) -> Column:
    def keep(w: Column, i: Column) -> Column:
        size = F.coalesce(F.get(found, i - 1), F.lit("")).rlike(r"^(\d+\.?\d*|\d*\.\d+|[\d.]+/\d+)$")
        return ~w.isin("LADDER", "BASKET") & ~(w.isin("WIDE", "LONG", "TALL", "DEEP", "HIGH") & (i > 0) & size)

    return F.when(F.array_contains(found, "TRAY"), F.filter(found, keep)).otherwise(found)


def marker_text(candidate: Column) -> Column:
    """What of a catalog text counts as naming a special variant: upper case, without two phrases of classification."""
    x = F.regexp_replace(F.upper(candidate), r"ELBOWS,?\s*COUPLINGS,?\s*AND\s*NIPPLES\s*\(ECN\)", " ")
    return F.regexp_replace(x, r"\bRMC\s+THREADED\s+CONDUIT\s*&\s*CABLE\s+FITTINGS\b", " ")


def canonical_words(text: Column) -> Column:
    mapped = lookup(vocab.CANONICAL)
    return F.transform(F.regexp_extract_all(F.upper(text), F.lit("[A-Z]+"), F.lit(0)), lambda w: F.coalesce(mapped[w], w))


def specialty_marker(query: Column, words_of_query: Column, marked: Column) -> Column:
    """The first marker of a special variant in marker_text that the query neither asks for nor implies; else null."""

    def unasked(marker: str) -> Column:
        asked = "|".join([marker, *(k for k, v in vocab.CATEGORY_DEFAULTS.items() if marker in v)])
        named = query.rlike(rf"(?i)\b(?:{asked})\b") | F.array_contains(words_of_query, marker)
        return F.when(F.contains(marked, F.lit(marker)) & ~named, F.lit(marker))

    return F.coalesce(*(unasked(m) for m in vocab.MARKERS))


def variant_conflict(query: Column, words_of_query: Column, tokens_of_query: Column, candidate: Column, marked: Column) -> Column:
    """Stainless on one side only, an unwanted spring, or an unasked special variant."""
    steel = F.contains(F.upper(query), F.lit("STAINLESS")) != F.contains(F.upper(candidate), F.lit("STAINLESS"))
    spring = has_all(tokens_of_query, ["SPRING", "NUT"]) & F.contains(F.upper(candidate), F.lit("NO SPRING"))
    return steel | spring | specialty_marker(query, words_of_query, marked).isNotNull()


def default_color(found: Column) -> Column:
    """The colour that the first category of a request implies, null if it names one itself."""
    implied = F.get(F.filter(F.transform(found, lambda w: lookup(vocab.DEFAULT_COLORS)[F.upper(w)]), lambda c: c.isNotNull()), F.lit(0))
    return F.when(~F.arrays_overlap(found, words(vocab.COLORS)), implied)


def color_conflict(found: Column, color: Column) -> Column:
    """Whether a candidate's tokens name another colour than the implied one."""
    return F.exists(found, lambda w: F.upper(w).isin(vocab.COLORS) & (F.upper(w) != F.upper(color)))


def percent_text(value: Column) -> Column:
    """A score for display: whole numbers plain, others with two places at most, N/A for null."""
    two = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), "0+$", ""), r"\.$", "")
    return F.when(value.isNull(), "N/A").when(value == F.floor(value), value.cast("long").cast("string")).otherwise(two)
