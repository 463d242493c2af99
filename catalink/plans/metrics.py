"""Counts of a stage taken in the pass that computes it, by DataFrame.observe: no second scan, and nothing is counted unless an action runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed_lines(lines: DataFrame, name: str = "lines") -> tuple[DataFrame, Observation]:
    """Quote lines (those of `ingest.quote_lines`) and how many there are, how many lack a quantity or a text, and how many have an error."""
    seen = Observation(name)
    text = F.trim(F.coalesce("requested_description", F.lit(""))) == ""
    counts = [F.count(F.lit(1)).alias("lines"), F.count_if(F.col("quantity").isNull()).alias("without_quantity"), F.count_if(text).alias("without_text"), F.count_if(F.col("error").isNotNull()).alias("errors")]
    return lines.observe(seen, *counts), seen


def observed_results(results: DataFrame, name: str = "results") -> tuple[DataFrame, Observation]:
    """Results (those of `plans.match.match_lines`) and how many there are of each status, and of published candidates."""
    seen = Observation(name)
    states = {"matched": ("EXACT_MATCH", "HIGH_CONFIDENCE"), "review": ("REVIEW_REQUIRED",), "no_match": ("NO_MATCH",)}
    counts = [F.count(F.lit(1)).alias("lines"), *(F.count_if(F.col("status").isin(*s)).alias(n) for n, s in states.items()), F.coalesce(F.sum("candidate_count"), F.lit(0)).alias("candidates")]
    return results.observe(seen, *counts), seen
