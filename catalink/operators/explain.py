"""Reasons, headlines and evidence of candidates and results, as column expressions.

Texts are fixed values of the results' format; the word for the maker of the products is left out of them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..vocab import MatchingConfig
from .score import round_even

#: Reasons of part numbers, results and headlines.
CODE_EXACT, CODE_NORMALIZED, CODE_PREFIX = "Exact Productcode match", "Normalized Productcode match", "Productcode match with NA1 prefix equivalence"
OWN_EXACT, PART_EXACT = "Exact Salsify ID match", "Exact part number match"
PART_COMPATIBLE, PART_CONFLICT = "Exact part number match and compatible product description.", "Exact part number found, but the requested description conflicts with the catalog description. Review required."
TEXT_UNIQUE, TEXT_SEVERAL = "Description matched a unique catalog product.", "Description matched multiple catalog products. A part number or additional product attributes are required."
PART_UNKNOWN, PART_SEVERAL = "Requested part number was not found in the catalog. Description candidates require review.", "Multiple catalog products share this part number. Review required."
NOTHING_SAID, COMPETING, COMPETING_CANDIDATES = "No identifier or description candidate could be found.", "Multiple possible Productcode matches", "Multiple possible Productcode candidates"
UNIQUE, ABOVE, SAME_TEXT = "Unique exact normalized description match", "Top candidate is above the high-confidence threshold", "Multiple products have the same description"
UNDECIDED, NO_WINNER = "Insufficient information to choose a single part number", "Good candidates exist but a unique winner was not established"
NOTHING, ONE_TEXT = "No catalog product reached the candidate floor", "Exactly one product shares this normalized description"


def _listed(*items: Column) -> Column:
    """The items that are not null, each once, in order."""
    return F.array_distinct(F.array_compact(F.array(*items)))


def code_reason(asked: Column, stored: Column, own: Column | None = None) -> Column:
    """How a requested part number meets a stored one, or the row's own identifier, if that is another."""
    left, right = T.part_number(asked), T.part_number(stored)
    same = F.array_contains(T.lookup_keys(stored), left)
    by_code = F.when(left == right, CODE_EXACT).when(same & (left.startswith("NA1-") != right.startswith("NA1-")), CODE_PREFIX).otherwise(CODE_NORMALIZED)
    if own is None:
        return by_code
    mine = T.part_number(own)
    by_own = F.when(left == mine, OWN_EXACT).when(left == right, PART_EXACT).when(F.array_contains(T.lookup_keys(own), left), OWN_EXACT).otherwise(PART_EXACT)
    return F.when((mine != "") & (right != "") & (mine != right), by_own).otherwise(by_code)


def result_reasons(state: Column, unique: Column, duplicate: Column, top: Column, gap: Column, candidates: Column, c: MatchingConfig = MatchingConfig()) -> Column:
    """Why a line has its status, most telling first."""
    two = lambda x: F.format_string("%.2f", round_even(x, 2))
    exact, high, review, none = (state == s for s in ("EXACT_MATCH", "HIGH_CONFIDENCE", "REVIEW_REQUIRED", "NO_MATCH"))
    close = F.coalesce(gap < c.min_gap, F.lit(False))
    return _listed(
        F.when(exact, UNIQUE),
        F.when(high, ABOVE),
        F.when(high & gap.isNotNull(), F.concat(F.lit("Score gap "), two(gap), F.lit(" is large enough to select a winner"))),
        F.when(review & duplicate, SAME_TEXT),
        F.when(review & duplicate, UNDECIDED),
        F.when(review & ~duplicate & close, F.concat(F.lit("Score gap "), two(gap), F.lit(f" is below the configured separation {c.min_gap:.2f}"))),
        F.when(review & ~duplicate & ~close, NO_WINNER),
        F.when(none & (candidates == 0), NOTHING),
        F.when(none & (candidates != 0), F.concat(F.lit("Top score "), two(top), F.lit(f" is below the minimum match threshold {c.min_match:.2f}"))),
        F.when(unique, ONE_TEXT),
    )


def contribution(score: Column, partial: Column | None = None) -> Column:
    """Struct of level, label and score of a field; partial marks a code that is matched in part only."""
    part = F.lit(False) if partial is None else partial
    level = F.when(part, "partial").when(score >= 99.5, "exact").when(score >= 70, "strong").when(score >= 40, "partial").otherwise("none")
    label = F.when(level == "none", "No match").otherwise(F.concat(F.initcap(level), F.lit(" match")))
    return F.struct(level.alias("level"), label.alias("label"), round_even(score, 2).alias("score"))


#: Fields whose part in a match is shown, under their names for readers.
SHOWN_FIELDS = {"name": "Part Number", "description": "Part Description", "description2": "Catalog Description"}


def shown_fields(scores: Column) -> Column:
    """Array of (field, level, label, score) of the fields of a struct of field scores."""
    one = lambda name, label: F.struct(F.lit(label).alias("field"), *(contribution(F.coalesce(scores[name], F.lit(0.0)))[x].alias(x) for x in ("level", "label", "score")))
    return F.array(*(one(n, x) for n, x in SHOWN_FIELDS.items()))


def candidate_headline(kind: Column, terms: Column, reasons: Column) -> Column:
    """Why a candidate is shown, in one line."""
    return F.coalesce(identifier_headline(kind), F.when(F.size(terms) > 0, F.lit(ABBREVIATED)), F.get(reasons, F.lit(0)), F.lit("Catalog candidate"))


def headline(state: Column, ident: Column, code: Column, name: Column, description: Column, second: Column, gap: Column, picked: Column, code_match: Column, text_match: Column, abbreviated: Column | None = None) -> Column:
    """One line that sums a result up: a person's pick, competing codes, a partial code, abbreviations, else the strongest fields."""
    abbreviated = F.lit(False) if abbreviated is None else abbreviated
    review = state == "REVIEW_REQUIRED"
    tight = gap.isNull() | (gap < 8.0)
    several = review & second.isNotNull() & ((tight & (code > 0)) | ident.isin("partial", "exact", "normalized_exact"))
    exact, text = code_match | (code >= 99.5), text_match | (description >= 70.0)
    some = F.array_compact(F.array(F.when(code >= 40.0, "Productcode"), F.when(name >= 40.0, "name"), F.when(description >= 40.0, "Description")))
    return (
        F.when(picked, "User Selected Match")
        .when(several, "Multiple possible Productcode matches")
        .when(ident == "partial", "Partial Productcode / Name Match")
        .when(review, "Multiple products have equivalent description matches")
        .when(state == "NO_MATCH", "No sufficiently similar product found")
        .when(abbreviated & ~exact & text, ABBREVIATED)
        .when(exact & text, "Exact Productcode + Description Match")
        .when(ident == "normalized_exact", "Normalized Productcode Match")
        .when(exact | ident.isin("exact", "normalized_exact"), "Exact Productcode Match")
        .when(text, "Description Match")
        .when(name >= 99.5, "Exact name Match")
        .when(name >= 70.0, "name Match")
        .when(F.size(some) > 0, F.concat(F.array_join(some, " + "), F.lit(" Match")))
        .otherwise("Catalog match")
    )


#: Words of a request that are told by themselves.
NOTABLE = ["MOLEX", "PAULEX", "DBL", "EXT", "DIST", "HEAD", "END", "WHIP", "CABLE", "SWITCH", "MODULE", "LIGHTING"]
ABBREVIATED, STRONGEST = "Normalized Description Match", {"productcode": "Productcode", "name": "name", "description": "description", "description2": "description2"}


def identifier_headline(kind: Column) -> Column:
    return F.when(kind == "exact", "Exact Productcode Match").when(kind == "normalized_exact", "Normalized Productcode Match").when(kind == "partial", "Partial Productcode / Name Match")


def matching_tokens(asked: Column, asked_small: Column, kind: Column, query: Column, row: Column, row_words: Column) -> Column:
    """Which words of a code query stand where: `AB → AB12`, or a prefix.

    asked and row_words are code words, asked_small the compact forms of the first; query and row the compact codes.
    """
    arrow = F.lit(" → ")
    same = F.when(F.size(asked) > 0, F.transform(asked, lambda w: F.concat(w, arrow, w))).otherwise(F.array(query))
    hits = F.filter(asked, lambda w: (F.length(T.compact_word(w)) >= 2) & F.contains(row, T.compact_word(w)))
    host = lambda w: F.coalesce(F.get(F.filter(row_words, lambda x: F.contains(T.compact_word(x), T.compact_word(w))), F.lit(0)), row)
    prefix = F.startswith(row, query) & (F.length(query) < F.length(row))
    part = F.when(prefix, F.array(F.concat(query, arrow, row, F.lit(" (prefix)")))).otherwise(F.transform(hits, lambda w: F.concat(w, arrow, host(w))))
    return F.when(kind.isin("exact", "normalized_exact"), same).when(kind == "partial", part).otherwise(F.array().cast("array<string>"))


def strongest(scores: Column) -> Column:
    """The first field (of productcode, name, description, description2) with the best score, null if all are 0."""
    best = F.greatest(*(scores[f] for f in STRONGEST))
    first = F.coalesce(*(F.when(scores[f] == best, F.lit(f)) for f in STRONGEST))
    return F.when(best > 0, first)


def candidate_reasons(asked: Column, row: Column, scores: Column, exact: Column, token: Column, fuzzy: Column, duplicate: Column, same_text: Column, kind: Column, told: Column, abbreviated: Column, lines: Column, field: Column) -> Column:
    """Why a candidate was found, most telling first.

    asked and row: tag arrays of `score.attributes` of request and description; scores: struct of the four
    field scores (null if none); exact, token, fuzzy: the pair's scores; kind and told: type and words of the
    identity; abbreviated: `text.abbreviations`; lines: `units.unit_lines`; field: the strongest field.
    """
    shared = F.array_intersect(asked, row)
    of = lambda sort: F.array_sort(F.transform(F.filter(shared, lambda t: t.startswith(f"{sort}:")), lambda t: F.substring(t, len(sort) + 2, 1 << 20)))
    said = lambda sort, words: F.transform(of(sort), lambda v: F.concat(F.lit(words), v))
    none = F.array().cast("array<string>")
    some = lambda test, *texts: F.when(test, F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts))).otherwise(none)
    code = F.coalesce(scores["productcode"], F.lit(0.0))
    whole = lambda f: F.format_string("%.0f", round_even(F.coalesce(scores[f], F.lit(0.0)), 0))
    numbers = F.concat(F.lit("Productcode match: "), whole("productcode"), F.lit("; Name match: "), whole("name"), F.lit("; Description match: "), whole("description"), F.lit("; Description2 match: "), whole("description2"))
    tokens = of("token")
    reasons = F.array_distinct(F.concat(
        some(kind.isin("exact", "normalized_exact", "partial") & (code > 0), identifier_headline(kind)),
        some((F.size(told) > 0) & (code > 0), F.concat(F.lit("Matching tokens: "), F.array_join(told, ", "))),
        some((F.size(abbreviated) > 0) & (code < 40), ABBREVIATED, F.concat(F.lit("Normalized terms: "), F.array_join(abbreviated, "; "))),
        some(field.isNotNull(), F.concat(F.lit("Strongest text evidence from "), T.lookup(STRONGEST)[field])),
        some(scores.isNotNull(), numbers),
        some(exact >= 100, F.when(same_text, "Exact normalized description match").otherwise("Exact match after synonym/abbreviation normalization")),
        some((exact >= 100) & ~same_text, "Description differs only by abbreviation"),
        some(duplicate, SAME_TEXT),
        said("voltage", "Voltage matched: "),
        F.coalesce(lines, none),
        said("phrase", "Product type matched: "),
        F.transform(F.filter(tokens, lambda t: t.isin(NOTABLE)), lambda t: F.concat(t, F.lit(" attribute matched"))),
        said("size", "Size matched: "),
        some((token > 0) & (exact < 100) & (F.size(tokens) > 0), F.concat(F.lit("Shared tokens: "), F.array_join(F.slice(tokens, 1, 6), ", "))),
        some((exact < 100) & (fuzzy > 0), F.concat(F.lit("Character similarity "), F.format_string("%.1f", round_even(fuzzy, 1)), F.lit("%"))),
    ))
    return F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("Partial description similarity")))


def breakdown(code: Column, name: Column, description: Column, description2: Column, overall: Column, reason: Column, conflict: Column, kind: Column) -> Column:
    """The scores of a candidate as one struct; missing ones are 0."""
    number = lambda x, as_: round_even(F.coalesce(x.cast("double"), F.lit(0.0))).alias(as_)
    return F.struct(
        number(code, "productcode_score"), number(name, "name_score"), number(description, "description_score"), number(description2, "description2_score"), number(overall, "overall_score"),
        reason.alias("match_reason"), F.coalesce(conflict, F.lit(False)).alias("numeric_conflict"), F.coalesce(kind, F.lit("none")).alias("productcode_match_type"),
    )


def descriptions_conflict(asked: Column, row: Column, variant: Column, exact: Column, final: Column, c: MatchingConfig = MatchingConfig()) -> Column:
    """Whether two texts' tags disagree in a measure or phrase, their variants do, or their score is below conflict_cap."""
    of = lambda tags, kind: F.filter(tags, lambda t: t.startswith(f"{kind}:"))
    apart = F.lit(False)
    for kind in ("voltage", "amperage", "size", "phrase"):
        a, b = of(asked, kind), of(row, kind)
        apart = apart | ((F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b))
    return apart | variant | ((exact < 100) & (final < c.conflict_cap))


def descriptions_compatible(conflict: Column, exact: Column, final: Column, c: MatchingConfig = MatchingConfig()) -> Column:
    return (exact >= 100) | (~conflict & (final >= c.compatible_min))


def identifier_spans(text: Column) -> Column:
    """Every run of segments of letters and digits joined by - / _ . +, as structs (length, start, text), longest first, then by place; start counts from 0.

    text is upper case already.
    """
    runs = F.regexp_extract_all(text, F.lit("[A-Z0-9]+(?:[-/_.+][A-Z0-9]+)*"), F.lit(0))
    gaps = F.split(text, "[A-Z0-9]+(?:[-/_.+][A-Z0-9]+)*", -1)

    def of_run(run: Column, at: Column) -> Column:
        begin = F.aggregate(F.slice(gaps, F.lit(1), at + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(runs, F.lit(1), at), F.lit(0), lambda n, x: n + F.length(x))
        parts = F.regexp_extract_all(run, F.lit("[-/_.+]?[A-Z0-9]+"), F.lit(0))
        ends = F.sequence(F.lit(1), F.size(parts))

        def span(i: Column, j: Column) -> Column:
            joined = F.array_join(F.slice(parts, i, j - i + 1), "")
            mark = F.when(joined.rlike("^[-/_.+]"), 1).otherwise(0)
            start = begin + F.aggregate(F.slice(parts, F.lit(1), i - 1), F.lit(0), lambda n, x: n + F.length(x)) + mark
            return F.struct((F.length(joined) - mark).alias("length"), start.alias("start"), F.regexp_replace(joined, "^[-/_.+]", "").alias("text"))

        return F.flatten(F.transform(ends, lambda i: F.transform(F.sequence(i, F.size(parts)), lambda j: span(i, j))))

    order = F.transform(F.flatten(F.transform(runs, of_run)), lambda s: F.struct((-s["length"]).alias("order"), s["start"].alias("start"), s["text"].alias("text")))
    return F.transform(F.array_sort(order), lambda s: F.struct((-s["order"]).alias("length"), s["start"].alias("start"), s["text"].alias("text")))
