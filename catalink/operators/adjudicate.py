"""A second opinion on ranked candidates: requests, a rule-based opinion, policy, checks and audit record.

results are those of `plans.match.match_lines` or alike: line_id, requested_description, quantity, status,
part_number_match, percentage, top_score, candidates (structs with product_code, product_id, score,
orderable, description, canonical, reasons).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .score import round_even

#: Decisions, thresholds of the policy, version of the request's wording.
CONFIDENT, REVIEW, NONE = "CONFIDENT_MATCH", "REVIEW_REQUIRED", "NO_MATCH"
CONFIDENT_FROM, REVIEW_FROM, MOST_CANDIDATES, VERSION = 90.0, 50.0, 6, "v2"
#: Why a chosen part is refused, and summaries of the rule-based opinion; the word for the maker is left out.
NO_PART, MALFORMED, FAMILY = "AI returned no part number", "AI returned a malformed part number", "AI returned a family/parent identifier"
NOT_LISTED = "AI selected a part number that was not in the candidate list"
NOT_KNOWN = "AI selected a part number that is not in the approved product catalog"
BELOW = "AI confidence is below the review threshold."
SUMMARIES = {
    "none": "No deterministic candidates were supplied.",
    "equal": "Multiple products have equivalent descriptions and the supplied quote does not contain enough information to distinguish them.",
    "single": "A single high-scoring candidate is semantically consistent with the request.",
    "weak": "No candidate is sufficiently relevant.",
    "open": "Candidates exist but evidence is insufficient for a confident match.",
}


def needed(results: DataFrame) -> DataFrame:
    """Lines worth a second opinion: with candidates, and not settled by an exact part number."""
    settled = F.coalesce(F.col("part_number_match"), F.lit(False)) & (F.col("status") == "EXACT_MATCH")
    return results.where((F.size("candidates") > 0) & ~settled)


def heuristic(candidates: Column, canonical: Column) -> Column:
    """Struct of decision, part, confidence and summary by fixed rules over the candidates' scores and canonical texts.

    Leaders are within half a point of the best. Several leaders that say the same as the request, or score
    99.5 and more, can't be told apart; a single one from 90 on is taken; a best below 50 is none.
    """
    best = F.array_max(F.transform(candidates, lambda x: x["score"]))
    leaders = F.filter(candidates, lambda x: F.abs(x["score"] - best) <= 0.5)
    equal = F.filter(leaders, lambda x: (x["canonical"] == canonical) | (F.abs(x["score"] - 100.0) <= 0.5))
    first = F.get(leaders, F.lit(0))["product_code"]
    nobody = F.lit(None).cast("string")

    def out(decision: str, part: Column, value: float, summary: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), part.alias("part"), F.lit(float(value)).alias("confidence"), F.lit(SUMMARIES[summary]).alias("summary"))

    return (
        F.when(F.size(candidates) == 0, out(NONE, nobody, 0, "none"))
        .when(F.size(equal) > 1, out(REVIEW, nobody, 40, "equal"))
        .when((F.size(leaders) == 1) & (best >= 90), out(CONFIDENT, first, 95, "single"))
        .when(best < 50, out(NONE, nobody, 10, "weak"))
        .otherwise(out(REVIEW, nobody, 55, "open"))
    )


def policy(decision: Column, part: Column, accepted: Column, confidence: Column, has_candidates: Column) -> Column:
    """Status by an opinion: no match only without a part; a part must be accepted, and confident from 90 on."""
    return (
        F.when(~has_candidates | ((decision == NONE) & part.isNull()), NONE)
        .when(part.isNull() | ~accepted | confidence.isNull() | (confidence < REVIEW_FROM), REVIEW)
        .when((decision == CONFIDENT) & (confidence >= CONFIDENT_FROM), CONFIDENT)
        .otherwise(REVIEW)
    )


def combined(deterministic: Column, opinion: Column, status: Column) -> Column:
    """The smaller of both for a confident match, else the opinion's; without an opinion the deterministic one."""
    return F.when(opinion.isNull(), deterministic).when(status == CONFIDENT, round_even(F.least(deterministic, opinion))).otherwise(round_even(opinion))


def rejection(part: Column, listed: Column, known: Column, family: Column) -> Column:
    """Why a chosen part is refused; null if it is fine."""
    return F.when(part.isNull(), NO_PART).when((F.trim(part) != part) | F.contains(part, F.lit("\n")), MALFORMED).when(family, FAMILY).when(~listed, NOT_LISTED).when(~known, NOT_KNOWN)


def adjudicated(results: DataFrame, catalog_codes: DataFrame, families: DataFrame, opinions: DataFrame | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """One row per line that needs an opinion: what was chosen, why it was refused, final status, part and confidence.

    catalog_codes and families hold a column code; both are joined by equality. opinions are those of
    `parsed_opinions` for the lines (one each); without them the fixed rules decide. A line whose opinion is
    missing or malformed stays with the deterministic score, for review.
    """
    rows = needed(results).withColumn("top", F.slice("candidates", 1, most))
    if opinions is None:
        told = heuristic(F.col("top"), T.canonical(F.col("requested_description")))
        rows = rows.withColumn("opinion", told).withColumn("valid", F.lit(True))
    else:
        said = opinions.dropDuplicates(["line_id"]).select("line_id", F.struct("decision", "part", "confidence", "summary").alias("opinion"), "valid")
        rows = rows.join(said, "line_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    part, confidence = F.col("opinion.part"), F.col("opinion.confidence")
    known = catalog_codes.select(F.col("code").alias("k")).distinct().withColumn("is_known", F.lit(True))
    kin = families.select(F.col("code").alias("f")).distinct().withColumn("is_family", F.lit(True))
    rows = rows.join(known, part == F.col("k"), "left").join(kin, part == F.col("f"), "left")
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    chosen = F.get(F.filter("top", lambda x: x["product_code"] == F.col("opinion.part")), F.lit(0))
    rows = rows.withColumn("chosen", chosen).withColumn("reason", rejection(part, F.col("chosen").isNotNull(), yes("is_known"), yes("is_family")))
    status = F.when(~F.col("valid"), REVIEW).otherwise(policy(F.col("opinion.decision"), part, F.col("reason").isNull(), confidence, F.size("top") > 0))
    rows = rows.withColumn("final", status)
    won = F.col("final") == CONFIDENT
    summary = (
        F.when(~F.col("valid"), F.lit("Malformed AI response"))
        .when(part.isNotNull() & F.col("reason").isNotNull(), F.col("reason"))
        .when(part.isNotNull() & (F.col("final") == REVIEW) & (confidence.isNull() | (confidence < REVIEW_FROM)), F.lit(BELOW))
        .otherwise(F.col("opinion.summary"))
    )
    score = F.when(won, F.col("chosen.score")).otherwise(F.col("top_score"))
    return rows.select(
        "line_id",
        F.col("status").alias("before"),
        F.col("opinion.decision").alias("decision"),
        part.alias("part"),
        confidence.alias("opinion_confidence"),
        F.when(part.isNotNull(), F.col("reason")).alias("rejected"),
        (~F.col("valid") | (part.isNotNull() & F.col("reason").isNotNull())).alias("validation_rejected"),
        F.col("final").alias("status"),
        F.when(won, part).alias("matched_part"),
        F.when(won, F.col("chosen.orderable")).alias("matched_orderable"),
        F.when(won, F.col("chosen.description")).alias("matched_description"),
        F.when(F.col("valid"), combined(score, confidence, F.col("final"))).otherwise(F.col("top_score")).alias("confidence"),
        summary.alias("summary"),
        F.when(won, "Automatic — AI Confirmed").alias("match_type_label"),
    )


def audit(results: DataFrame, adjudged: DataFrame, provider: str, model: str | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """The append-only record of each opinion: what was offered at which score, what was chosen and by whom."""
    offered = results.select("line_id", "requested_description", F.slice("candidates", 1, most).alias("top"))
    pairs = F.map_from_entries(F.transform("top", lambda x: F.struct(x["product_code"], x["score"])))
    return offered.join(adjudged, "line_id").select(
        "line_id", "requested_description", F.transform("top", lambda x: x["product_code"]).alias("candidate_part_numbers"), pairs.alias("deterministic_scores"),
        F.col("decision").alias("ai_decision"), F.coalesce("matched_part", "part").alias("selected_part_number"), F.col("opinion_confidence").alias("ai_confidence"), F.col("summary").alias("reasoning_summary"),
        F.lit(provider).alias("provider"), F.lit(model).cast("string").alias("model"), F.lit(VERSION).alias("prompt_version"), "validation_rejected", F.current_timestamp().alias("timestamp"),
    )


def requests(results: DataFrame, note: Column | None = None, most: int = 5) -> DataFrame:
    """(line_id, request): for each line that needs an opinion one JSON document of its text, quantity, best candidates and, if it tells more, the catalog's wording.

    note: the expanded text of a line, null where it adds nothing (see `retrieve.terminology_note`).
    """
    top = F.transform(F.slice("candidates", 1, most), lambda x: F.struct(x["product_code"].alias("official_part_number"), x["description"].alias("description"), x["product_id"].alias("salsify_id"), x["score"].alias("deterministic_score"), x["reasons"].alias("match_reasons")))
    body = F.struct("requested_description", "quantity", top.alias("candidates"), (F.lit(None).cast("string") if note is None else note).alias("catalog_terminology_note"))
    return needed(results).select("line_id", F.to_json(body).alias("request"))


#: The wording of a request to a language model; {maker} is given by the caller.
PROMPT = (
    "Determine whether the customer's requested product can be confidently matched to ONE of the supplied {maker} candidate products.\n\n",
    "requested_description: ", "\nquantity: ", " (do not use quantity to choose a product)\n", "catalog_terminology_note: ", "\ncandidates:\n",
    "\n\nRespond with JSON using keys: decision, selected_part_number, confidence_percentage, reasoning_summary, matched_attributes, conflicting_attributes, candidate_evaluations.\n"
    "candidate_evaluations items must include official_part_number, assessment, score.\n"
    "If multiple candidates are equivalent and nothing distinguishes them, decision must be REVIEW_REQUIRED and selected_part_number must be null.\n",
)


def prompt(request: Column, maker: str = "") -> Column:
    """The text of a request (JSON of `requests`) for a language model."""
    schema = "requested_description string, quantity double, candidates string, catalog_terminology_note string"
    said = F.from_json(request, schema)
    opening = PROMPT[0].replace("{maker} ", f"{maker} " if maker else "")
    quantity = F.when(said["quantity"].isNull(), "null").when(said["quantity"] == F.floor(said["quantity"]), said["quantity"].cast("long").cast("string")).otherwise(said["quantity"].cast("string"))
    note = F.when(said["catalog_terminology_note"].isNotNull(), F.concat(F.lit(PROMPT[4]), said["catalog_terminology_note"], F.lit("\n"))).otherwise("")
    return F.concat(F.lit(opening + PROMPT[1]), said["requested_description"], F.lit(PROMPT[2]), quantity, F.lit(PROMPT[3]), note, F.lit(PROMPT[5]), said["candidates"], F.lit(PROMPT[6]))


def _attributes(raw: Column) -> Column:
    """A list of attributes as plain texts from JSON: of texts, of objects, or one object of notes by attribute."""

    def value(x: Column) -> Column:
        return F.when(x.startswith("["), F.array_join(F.from_json(x, "array<string>"), ", ")).otherwise(x)

    def pairs(x: Column) -> Column:
        return F.transform(F.map_entries(F.from_json(x, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), value(e["value"])))

    def item(x: Column) -> Column:
        return F.when(x.startswith("{"), F.array_join(pairs(x), "; ")).otherwise(value(x))

    noted = F.transform(F.map_entries(F.from_json(raw, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), item(e["value"])))
    return F.coalesce(F.when(raw.startswith("{"), noted).when(raw.startswith("["), F.transform(F.from_json(raw, "array<string>"), item)), F.array().cast("array<string>"))


def parsed_opinions(responses: DataFrame) -> DataFrame:
    """Opinions from JSON text (line_id, body).

    valid tells whether a known decision, a summary and, if stated, a confidence of 0 to 100 are there; a
    confidence may be missing, a blank part is none.
    """
    said = F.from_json("body", "decision string, selected_part_number string, confidence_percentage double, reasoning_summary string, matched_attributes string, conflicting_attributes string")
    rows = responses.select("line_id", said.alias("x")).select("line_id", "x.*")
    good = F.col("decision").isin(CONFIDENT, REVIEW, NONE) & F.col("reasoning_summary").isNotNull() & (F.col("confidence_percentage").isNull() | F.col("confidence_percentage").between(0, 100))
    valid = F.coalesce(good, F.lit(False))
    return rows.select(
        "line_id",
        F.when(valid, F.col("decision")).otherwise(REVIEW).alias("decision"),
        F.when(valid & (F.trim("selected_part_number") != ""), F.col("selected_part_number")).alias("part"),
        F.when(valid, F.col("confidence_percentage")).alias("confidence"),
        F.when(valid, F.col("reasoning_summary")).alias("summary"),
        F.when(valid, _attributes(F.col("matched_attributes"))).alias("matched"),
        F.when(valid, _attributes(F.col("conflicting_attributes"))).alias("conflicting"),
        valid.alias("valid"),
    )
