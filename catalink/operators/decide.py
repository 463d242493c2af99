"""Ranking, decisions and evidence per request line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import percent_text
from ..vocab import MatchingConfig
from . import explain
from ..plans.stages import staged
from .score import overall as overall_score
from .score import round_even

KNOWN = ("exact", "normalized_exact", "partial")


def _order() -> WindowSpec:
    return Window.partitionBy("line_id").orderBy(F.when(F.col("ident_type").isin(*KNOWN), 0).otherwise(1), F.desc("score"), "product_code", "product_id")


def ranked(candidates: DataFrame) -> DataFrame:
    """rank per line_id: identities first, then score, code and id."""
    return candidates.withColumn("rank", F.row_number().over(_order()))


def gaps(candidates: DataFrame) -> DataFrame:
    """Per line the best and second-best score over all candidates, and their gap."""
    order = Window.partitionBy("line_id").orderBy(F.desc("score"))
    place = candidates.withColumn("place", F.row_number().over(order)).groupBy("line_id")
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("score")))
    rows = place.agg(F.count(F.lit(1)).alias("scored"), at(1).alias("top_score"), at(2).alias("second_score"))
    return rows.withColumn("score_gap", round_even(F.col("top_score") - F.col("second_score")))


def status(top: Column, second: Column, gap: Column, exact_unique: Column, duplicate: Column, candidates: Column, ident: Column, competing: Column, conflict: Column, c: MatchingConfig = MatchingConfig()) -> Column:
    """The first rule that holds."""
    close = (second >= c.min_match) & (gap.isNull() | (gap <= c.tie) | (gap < c.min_gap))
    return (
        F.when(candidates == 0, "NO_MATCH")
        .when(conflict & (top < c.min_match), "NO_MATCH")
        .when((top < c.min_match) & ~ident.isin(*KNOWN), "NO_MATCH")
        .when((top < c.min_match) & (ident == "partial"), "REVIEW_REQUIRED")
        .when(competing | duplicate, "REVIEW_REQUIRED")
        .when(exact_unique & ident.isin("exact", "normalized_exact"), "EXACT_MATCH")
        .when(exact_unique & (top >= 99.0) & (ident != "partial"), "EXACT_MATCH")
        .when(ident == "partial", "REVIEW_REQUIRED")
        .when(conflict, "REVIEW_REQUIRED")
        .when(F.coalesce(close, F.lit(False)), "REVIEW_REQUIRED")
        .when(top >= c.high, "HIGH_CONFIDENCE")
        .when(top >= c.min_match, "REVIEW_REQUIRED")
        .otherwise("NO_MATCH")
    )


def competing(first: Column, second: Column) -> Column:
    """Two identities of one query that share it as a prefix, or have different additional words."""
    same_query = (first["query_compact"] != "") & (first["query_compact"] == second["query_compact"]) & (first["catalog_compact"] != second["catalog_compact"])
    shared = F.startswith(first["catalog_compact"], first["query_compact"]) & F.startswith(second["catalog_compact"], second["query_compact"])
    a, b = F.sort_array(F.array_distinct(first["extra"])), F.sort_array(F.array_distinct(second["extra"]))
    return F.coalesce((same_query & shared) | ((F.size(a) > 0) & (F.size(b) > 0) & (a != b)), F.lit(False))


def capped(value: Column, state: Column, contested: Column, c: MatchingConfig = MatchingConfig()) -> Column:
    return round_even(F.when(contested | (state == "REVIEW_REQUIRED"), F.least(value, F.lit(c.ambiguous_cap))).otherwise(value))


#: What a published candidate holds.
CANDIDATE = (
    "rank int, product_code string, product_id string, catalog_id string, name string, orderable string, description string, description2 string, canonical string, score double, match_reason string, reasons array<string>, "
    "field_scores struct<productcode:double,name:double,description:double,description2:double>, "
    "fields array<struct<field:string,level:string,label:string,score:double>>, "
    "evidence struct<match_type:string,matching_tokens:array<string>,additional_catalog_tokens:array<string>,normalized_terms:array<string>,unit_lines:array<string>,numeric_unit_score:double,numeric_conflict:boolean>"
)


def shaped(rows: DataFrame) -> DataFrame:
    """Adds to candidates (see `plans.match.candidates_of`), ranked, the struct `shape` of what is published of each."""
    kind = F.col("ident_type")
    columns = {
        "rank": F.col("rank"), "product_code": F.col("product_code"), "product_id": F.col("external_id"), "catalog_id": F.col("product_id").cast("string"), "name": F.col("name"), "orderable": F.col("orderable"), "description": F.col("description"),
        "description2": F.col("description2"), "canonical": F.col("canonical"), "score": F.col("score"), "match_reason": explain.candidate_headline(kind, F.col("evidence.normalized_terms"), F.col("reasons")), "reasons": F.col("reasons"),
        "field_scores": F.col("fields"), "fields": explain.shown_fields(F.col("fields")), "evidence": F.col("evidence"),
    }
    return rows.withColumn("shape", F.struct(*(x.alias(n) for n, x in columns.items())).cast(f"struct<{_ddl(CANDIDATE)}>"))


def _ddl(fields: str) -> str:
    """Fields of a table as those of a struct."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", fields)


def decided(candidates: DataFrame, lines: DataFrame, c: MatchingConfig = MatchingConfig()) -> DataFrame:
    """One row per line (line_id, force_review, stated_score, extra) that text decides: status, match, scores, reasons and candidates.

    candidates: those of `plans.match.by_text`. force_review keeps a line from being matched; stated_score
    is the part number's, null where none is stated; extra are reasons that come first.
    All that a line's candidates tell is taken in one grouping, and joined to the lines without a broadcast: by
    the tables' files Spark takes candidates for far smaller than they are.
    """
    by_score = Window.partitionBy("line_id").orderBy(F.desc("score"))
    rows = ranked(candidates).withColumn("alike", F.col("canonical") == F.first("canonical").over(_order())).withColumn("place", F.row_number().over(by_score))
    rows = shaped(rows)
    at = lambda i: F.max(F.when(F.col("place") == i, F.col("score")))
    place = F.when(F.col("alike"), F.col("rank"))
    known = F.col("ident_type").isin(*KNOWN)
    per = rows.groupBy("line_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("rank") <= c.max_candidates, F.col("shape")))).alias("listed"),
        F.slice(F.sort_array(F.collect_list(F.when(known & (F.col("rank") <= c.max_candidates), F.struct("rank", "product_code", "ident")))), 1, 2).alias("ids"),
        F.count_if(F.col("exact") >= 100).alias("exact_rows"),
        F.count_if(F.col("ident_type").isin("exact", "normalized_exact")).alias("exact_ids"),
        F.max(F.when(F.col("rank") == 1, F.struct("product_code", "exact", "ident_type", "ident_field", "numeric_conflict"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("product_code"))).alias("second_code"),
        at(1).alias("top_score"), at(2).alias("second_score"),
        F.count(place).alias("same"), F.min_by("score", place).alias("one"), F.max_by("score", place).alias("last"),
    )
    per = per.withColumn("score_gap", round_even(F.col("top_score") - F.col("second_score")))
    first = F.col("first")
    led, sure = first["ident_type"].isin(*KNOWN), first["ident_type"].isin("exact", "normalized_exact")
    by_code = first["ident_field"].isin("productcode", "name")
    one, two = F.get("ids", F.lit(0)), F.get("ids", F.lit(1))
    contested = F.coalesce(two.isNotNull() & (one["product_code"] != two["product_code"]) & competing(one["ident"], two["ident"]), F.lit(False))
    tight = led & by_code & F.col("second_code").isNotNull() & (F.col("score_gap").isNull() | (F.col("score_gap") < c.min_gap)) & (first["product_code"] != F.col("second_code"))
    per = per.withColumns({"competing": contested | F.coalesce(tight, F.lit(False)), "count": F.size("listed"), "led": led, "code_match": sure & F.coalesce(by_code, F.lit(False)), "duplicate": F.coalesce((F.col("same") > 1) & (F.abs(F.col("one") - F.col("last")) <= c.tie), F.lit(False))})
    per = per.withColumn("unique", ((F.col("exact_rows") == 1) | ((F.col("exact_ids") == 1) & F.col("code_match"))) & ~F.col("competing"))
    found = lines.join(per.hint("merge"), "line_id", "left")
    no = lambda name: F.coalesce(F.col(name), F.lit(False))
    top, count = F.coalesce("top_score", F.lit(0.0)), F.coalesce("count", F.lit(0))
    ident = F.coalesce(F.col("first.ident_type"), F.lit("none"))
    state = status(top, F.col("second_score"), F.col("score_gap"), no("unique"), no("duplicate"), count, ident, no("competing"), F.coalesce(F.col("first.numeric_conflict"), F.lit(False)), c)
    state = F.when((ident == "partial") & state.isin("EXACT_MATCH", "HIGH_CONFIDENCE"), "REVIEW_REQUIRED").when((state == "NO_MATCH") & no("led"), "REVIEW_REQUIRED").otherwise(state)
    found = found.withColumn("status", state)
    held = (no("competing") | F.col("force_review")) & (F.col("status") != "NO_MATCH")
    found = found.withColumn("status", F.when(held, "REVIEW_REQUIRED").otherwise(F.col("status")))
    won = F.col("status").isin("EXACT_MATCH", "HIGH_CONFIDENCE")
    review = F.col("status") == "REVIEW_REQUIRED"
    head = F.get("listed", F.lit(0))
    none = F.array().cast("array<string>")
    some = lambda test, *texts: F.when(test, F.array(*(F.lit(t) if isinstance(t, str) else t for t in texts))).otherwise(none)
    code = F.coalesce(head["field_scores"]["productcode"], F.lit(0.0))
    told = head["evidence"]["matching_tokens"]
    base = explain.result_reasons(F.col("status"), no("unique"), no("duplicate"), top, F.col("score_gap"), count, c)
    reasons = F.array_distinct(F.concat(
        some(no("competing"), explain.COMPETING),
        some(~no("competing") & (ident == "partial") & (code > 0), explain.identifier_headline(ident)),
        some(~no("competing") & (ident == "partial") & (code > 0) & (F.size(told) > 0), F.concat(F.lit("Matching tokens: "), F.array_join(told, ", "))),
        some(~no("competing") & ident.isin("exact", "normalized_exact") & (code > 0), explain.identifier_headline(ident)),
        F.col("extra"),
        some(no("competing"), explain.COMPETING, explain.COMPETING_CANDIDATES),
        some(~no("competing") & won, explain.TEXT_UNIQUE),
        some(~no("competing") & review & no("duplicate"), explain.TEXT_SEVERAL),
        base,
        F.coalesce(F.slice(head["reasons"], 1, 4), none),
    ))
    text_match = (count > 0) & ~no("code_match") & ((F.col("first.exact") >= 100) | ((F.coalesce(head["field_scores"]["description"], F.lit(0.0)) >= 70) & ~no("led")))
    overall = capped(F.when(F.col("stated_score").isNotNull(), overall_score(F.col("stated_score"), top)).otherwise(top), F.col("status"), no("competing"), c)
    return found.select(
        "line_id", "status", *_of_winner(won, head), F.when((F.col("status") == "NO_MATCH") & (count == 0), 0.0).otherwise(overall).alias("percentage"), reasons.alias("reasons"), top.alias("top_score"), "second_score", "score_gap",
        F.when(no("code_match"), 100.0).otherwise(F.col("stated_score")).alias("part_number_score"), top.alias("description_score"), no("code_match").alias("part_number_match"), F.coalesce(text_match, F.lit(False)).alias("description_match"), F.coalesce("listed", F.expr(f"CAST(array() AS array<struct<{_ddl(CANDIDATE)}>>)")).alias("candidates"),
    )


def _of_winner(won: Column, head: Column) -> list[Column]:
    return [F.when(won, head[x]).alias(n) for n, x in (("matched_part", "product_code"), ("matched_orderable", "orderable"), ("matched_description", "description"), ("matched_id", "product_id"))]


def named(parts: DataFrame, others: DataFrame, c: MatchingConfig = MatchingConfig()) -> DataFrame:
    """One row per line whose identifier names one row (parts, those of `plans.match.by_identity`), as `decided`.

    A text beside the identifier that is compatible, or none, makes an exact match; else the row comes first for
    review, before the candidates by text (others: line_id, candidates).
    """
    rows = shaped(parts.withColumn("rank", F.lit(1))).join(others.select("line_id", F.col("candidates").alias("rest")).hint("merge"), "line_id", "left")
    good = ~F.col("conflict") & F.col("compatible")
    more = F.filter(F.coalesce("rest", F.expr(f"CAST(array() AS array<struct<{_ddl(CANDIDATE)}>>)")), lambda x: x["product_code"] != F.col("product_code"))
    rows = rows.withColumn("listed", F.when(good, F.array("shape")).otherwise(F.slice(F.concat(F.array("shape"), more), 1, c.max_candidates)))
    scores = F.reverse(F.array_sort(F.transform("listed", lambda x: x["score"])))
    rows = rows.withColumns({"top_score": F.get(scores, F.lit(0)), "second_score": F.get(scores, F.lit(1))})
    own = F.col("external_id") != F.col("product_code")
    none = F.array().cast("array<string>")
    said = (
        F.when(~good, F.array(F.lit(explain.PART_CONFLICT)))
        .when(F.col("blank"), F.array("why"))
        .when(own, F.array(F.when(F.col("why") == explain.OWN_EXACT, F.lit(explain.OWN_EXACT)).otherwise(F.lit(explain.PART_COMPATIBLE))))
        .otherwise(F.array(F.col("why"), F.lit("Compatible name/description evidence")))
    )
    return rows.select(
        "line_id", F.when(good, "EXACT_MATCH").otherwise("REVIEW_REQUIRED").alias("status"), *_of_winner(good, F.col("shape")), overall_score(F.lit(100.0), F.col("description_score")).alias("percentage"),
        F.array_distinct(F.concat(said, F.coalesce(F.slice("reasons", 1, 4), none))).alias("reasons"), "top_score", "second_score", round_even(F.col("top_score") - F.col("second_score")).alias("score_gap"),
        F.lit(100.0).alias("part_number_score"), "description_score", F.lit(True).alias("part_number_match"), (~F.col("blank") & good).alias("description_match"), F.col("listed").alias("candidates"),
    )


def results(asked: DataFrame, found: DataFrame, parts: DataFrame | None, c: MatchingConfig = MatchingConfig()) -> DataFrame:
    """One row per line of asked (those of `plans.match.interpreted`): what was decided, labelled, with published candidates and evidence."""
    none = F.array().cast("array<string>")
    extra = F.when(F.col("route") == "ambiguous", F.array(F.lit(explain.PART_SEVERAL), F.lit(explain.PART_UNKNOWN))).when(F.col("route") == "unknown", F.array(F.lit(explain.PART_UNKNOWN))).otherwise(none)
    stated = F.col("route").isin("ambiguous", "unknown")
    lines = asked.where("route IN ('ambiguous', 'unknown', 'text', 'identity')").select("line_id", "route", stated.alias("force_review"), F.when(stated, 0.0).alias("stated_score"), extra.alias("extra"))
    text = staged(decided(found, lines, c).join(lines.select("line_id", "route").hint("merge"), "line_id"))
    done = text.where("route <> 'identity'").drop("route")
    if parts is not None:
        done = done.unionByName(named(parts, text.where("route = 'identity'"), c))
    rows = asked.select("line_id", "route", F.get("identifiers", F.lit(0)).alias("requested_identifier"), F.get("ids", F.lit(0)).alias("detected_id"), F.get("codes", F.lit(0)).alias("detected_part_number")).join(done.hint("merge"), "line_id", "left")
    empty = F.col("status").isNull()
    silent = F.when(F.col("route") == "unknown_only", F.array(F.lit(explain.PART_UNKNOWN))).otherwise(F.array(F.lit(explain.NOTHING_SAID)))
    rows = rows.withColumns({
        "reasons": F.when(empty, silent).otherwise(F.col("reasons")), "percentage": F.coalesce("percentage", F.lit(0.0)), "top_score": F.coalesce("top_score", F.lit(0.0)), "part_number_score": F.when(empty & (F.col("route") == "unknown_only"), 0.0).otherwise(F.col("part_number_score")),
        "part_number_match": F.coalesce("part_number_match", F.lit(False)), "description_match": F.coalesce("description_match", F.lit(False)), "status": F.coalesce("status", F.lit("NO_MATCH")),
    })
    return published(rows, c)


def published(rows: DataFrame, c: MatchingConfig = MatchingConfig()) -> DataFrame:
    """The best candidates of each line, none of a line without a match; their number; labels of matches; evidence of the result."""
    nothing = F.expr(f"CAST(array() AS array<struct<{_ddl(CANDIDATE)}>>)")
    kept = F.when(F.col("status") == "NO_MATCH", nothing).otherwise(F.coalesce(F.slice("candidates", 1, c.published), nothing))
    # Places are those of the published list.
    head = F.get("candidates", F.lit(0))
    rows = rows.withColumn("head", head).withColumn("candidates", F.transform(kept, lambda x, i: x.withField("rank", (i + 1).cast("int"))))
    ident = F.coalesce(F.col("head.evidence.match_type"), F.lit("none"))
    won = F.col("status").isin("EXACT_MATCH", "HIGH_CONFIDENCE")
    label = automatic_label(ident, F.col("part_number_match"), F.col("description_match"))
    of = lambda name: F.coalesce(F.col(f"head.field_scores.{name}"), F.lit(0.0))
    line = explain.headline(F.col("status"), ident, of("productcode"), of("name"), F.greatest(of("description"), of("description2")), F.col("second_score"), F.col("score_gap"), F.lit(False), F.col("part_number_match"), F.col("description_match"), F.coalesce(F.size("head.evidence.normalized_terms") > 0, F.lit(False)))
    scores = [of(n) for n in ("productcode", "name", "description", "description2")]
    rows = rows.withColumns({
        "candidate_count": F.size("candidates"), "original_confidence": F.col("percentage"), "selection_type": F.when(won, "AUTOMATIC"), "match_type_label": F.when(won, label), "headline": line,
        "breakdown": explain.breakdown(*scores, F.col("percentage"), F.array_join(F.slice("reasons", 1, 3), "; "), F.col("head.evidence.numeric_conflict"), ident), "fields": explain.shown_fields(F.struct(*(x.alias(n) for x, n in zip(scores, ("productcode", "name", "description", "description2"), strict=True)))),
    })
    return rows.drop("head")


def line_key(file: Column, sheet: Column, row: Column, text: Column) -> Column:
    return F.concat_ws("|", F.coalesce(file, F.lit("")), F.coalesce(sheet, F.lit("")), F.coalesce(row.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))


def level(score: Column) -> Column:
    """How much a field contributes, in words."""
    return F.when(score >= 99.5, "exact").when(score >= 70, "strong").when(score >= 40, "partial").otherwise("none")


def confidence_word(state: Column) -> Column:
    return F.when(state.isin("EXACT_MATCH", "HIGH_CONFIDENCE", "CONFIDENT_MATCH"), "HIGH").when(state == "REVIEW_REQUIRED", "REVIEW").when(state == "NO_MATCH", "LOW").otherwise("MEDIUM")


def top_string(candidates: Column, n: int = 5) -> Column:
    return F.array_join(F.transform(F.slice(candidates, 1, n), lambda x: F.concat(x["product_code"], F.lit(" ("), percent_text(x["score"]), F.lit(")"))), "; ")


def selected(results: DataFrame, picks: DataFrame) -> DataFrame:
    """results with manual picks (line_id, product_code) applied to lines under review whose candidates hold the pick.

    A picked line is a match of its user: part, orderable number, description and reasons are those of the pick,
    the confidence is that from before, and selection_type and match_type_label say who chose. Of several good
    picks of a line the smallest code counts; all others are those of `refused_picks`.
    """
    wanted = picks.select("line_id", T.code_as_given(F.col("product_code")).alias("picked")).distinct()
    listed = results.where("status = 'REVIEW_REQUIRED'").select("line_id", F.explode("candidates").alias("x"))
    listed = listed.select("line_id", F.col("x.product_code").alias("picked"), F.struct("x.orderable", "x.description").alias("chosen"))
    good = wanted.join(listed, ["line_id", "picked"]).groupBy("line_id").agg(F.min("picked").alias("picked"), F.min_by("chosen", "picked").alias("chosen"))
    rows = results.join(good, "line_id", "left")
    done = F.col("picked").isNotNull()
    said = F.concat(F.lit("User selected Productcode "), F.col("picked"))
    rows = rows.withColumn("reasons", F.when(done, F.array_distinct(F.concat(F.array(said), F.coalesce("reasons", F.array().cast("array<string>"))))).otherwise(F.col("reasons")))
    new = {
        "matched_part": F.when(done, F.col("picked")).otherwise(F.col("matched_part")),
        "matched_orderable": F.when(done, F.col("chosen.orderable")).otherwise(F.col("matched_orderable")),
        "matched_description": F.when(done, F.col("chosen.description")).otherwise(F.col("matched_description")),
        "original_confidence": F.col("percentage"),
        "part_number_match": done | F.coalesce("part_number_match", F.lit(False)),
        "selection_type": F.when(done, "USER_SELECTED").when(F.col("status").isin("EXACT_MATCH", "HIGH_CONFIDENCE"), "AUTOMATIC"),
        "match_type_label": F.when(done, "User Selected").otherwise(F.col("match_type_label")),
        "status": F.when(done, "HIGH_CONFIDENCE").otherwise(F.col("status")),
    }
    return rows.withColumns(new).drop("picked", "chosen")


def refused_picks(results: DataFrame, picks: DataFrame) -> DataFrame:
    """(line_id, product_code, reason) of picks that can't be applied: of lines not under review, or of parts not listed."""
    rows = picks.select("line_id", "product_code").join(results.select("line_id", "status", "candidates"), "line_id", "left")
    held = F.exists("candidates", lambda x: x["product_code"] == T.code_as_given(F.col("product_code")))
    reason = F.when(~F.col("status").eqNullSafe(F.lit("REVIEW_REQUIRED")), "Only REVIEW_REQUIRED lines can be selected.").when(~F.coalesce(held, F.lit(False)), "Productcode is not in the candidate list.")
    return rows.select("line_id", "product_code", reason.alias("reason")).where("reason IS NOT NULL")


def automatic_label(ident: Column, part_number_match: Column, description_match: Column) -> Column:
    """How a match came about that no person chose."""
    return F.when(ident.isin("exact", "normalized_exact") | part_number_match, "Automatic — Exact Productcode").when(ident == "partial", "Automatic — Partial Productcode").when(description_match, "Automatic — Description Match").otherwise("Automatic")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Lines of a run against an earlier one by requested_description: NEW, CHANGED or SAME, with what it was before.

    Of several earlier lines of one text the last (by line_id) counts; each line of the new run gives one row.
    """
    last = F.max_by(F.struct("status", "matched_part"), "line_id")
    old = before.groupBy("requested_description").agg(last.alias("x")).select(F.col("requested_description").alias("text"), F.col("x.status").alias("old_status"), F.col("x.matched_part").alias("old_part"), F.lit(True).alias("known"))
    joined = after.join(old, F.col("requested_description").eqNullSafe(F.col("text")), "left")
    same = F.col("status").eqNullSafe(F.col("old_status")) & F.col("matched_part").eqNullSafe(F.col("old_part"))
    return joined.select("line_id", "requested_description", "status", "matched_part", "old_status", "old_part", F.when(F.col("known").isNull(), "NEW").when(same, "SAME").otherwise("CHANGED").alias("change"))


def summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin("EXACT_MATCH", "HIGH_CONFIDENCE")).alias("matched"),
        F.count_if(F.col("status") == "REVIEW_REQUIRED").alias("review"),
        F.count_if(F.col("status") == "NO_MATCH").alias("no_match"),
    )
