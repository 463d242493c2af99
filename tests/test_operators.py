"""Exports, picks, differences and second opinions on small rows."""

from __future__ import annotations

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalink.functions import text as T
from catalink.operators import adjudicate, decide, export, history

CANDIDATE = "struct<rank:int,product_code:string,score:double,orderable:string,description:string,product_id:string,canonical:string,reasons:array<string>>"
RESULT = f"line_id long, requested_description string, quantity double, status string, matched_part string, matched_orderable string, percentage double, candidates array<{CANDIDATE}>, matched_description string, part_number_match boolean, top_score double, match_type_label string, reasons array<string>"


def _candidate(rank, code, score, orderable, description):
    return (rank, code, score, orderable, description, f"id-{code}", description.upper(), ["why"])


_MORE = (None, False, 90.0, None, ["first"])
ROWS = [
    (1, "bolt", 2.0, "EXACT_MATCH", "A", "A1", 100.0, [_candidate(1, "A", 100.0, "A1", "x")], None, True, 100.0, None, ["first"]),
    (2, "rod", None, "REVIEW_REQUIRED", None, None, 86.0, [_candidate(1, "B", 91.0, None, "x"), _candidate(2, "C", 90.75, "C1", "y")], *_MORE),
    (3, "", 1.0, "NO_MATCH", None, None, 0.0, [], *_MORE),
    (4, "nut", None, "HIGH_CONFIDENCE", "D", None, 92.5, [_candidate(1, "D", 92.5, None, "x")], *_MORE),
]


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


@pytest.fixture(scope="module")
def results():
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
    return spark.createDataFrame(ROWS, RESULT)


def test_order_rows_are_the_matched_lines(results):
    assert sorted(map(tuple, export.order_rows(results).collect())) == [(1, "A1", 2.0), (4, "D", None)]


def test_csv_rows(results):
    out = export.csv_rows(results.withColumn("candidate_count", F.size("candidates")), "Maker")
    rows = {r["Requested Description"]: r for r in out.collect()}
    assert [rows[t]["Confidence"] for t in ("bolt", "rod", "", "nut")] == ["HIGH", "REVIEW", "LOW", "HIGH"]
    assert rows["rod"]["Top Candidates"] == "B (91); C (90.75)" and rows[""]["Top Candidates"] == ""
    assert rows["nut"]["Matching Percentage"] == "92.5" and rows["nut"]["Source File"] == "" and rows["nut"]["Part Number Match %"] == "N/A"
    assert len(out.columns) == 18 and rows["bolt"]["Matched Maker Description"] == "x" and rows["rod"]["Matched Maker Part Number"] == ""


def test_csv_files_are_quoted_as_needed_after_a_mark(results, tmp_path):
    import csv
    import io

    rows = results.sparkSession.createDataFrame([(' 3/4" rod, long ', ""), ("plain", "x")], "text string, other string").coalesce(1)
    export.write_csv(rows, str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*.csv")
    raw = file.read_bytes()
    assert raw.startswith(b"\xef\xbb\xbftext,other\r\n") and b"plain,x\r\n" in raw
    assert list(csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""))) == [["text", "other"], [' 3/4" rod, long ', ""], ["plain", "x"]]


def test_rounding_is_that_of_the_binary_value(results):
    import random

    from catalink.operators.score import round_even

    rng = random.Random(1)
    values = [rng.randrange(10**7) / 10**5 for _ in range(3000)] + [(2 * k + 1) * 5 / 10**5 for k in range(3000)] + [k / 32 for k in range(2000)] + [rng.random() * 100 for _ in range(2000)]
    found = results.sparkSession.createDataFrame([(v,) for v in values] + [(None,)], "v double").select("v", round_even(F.col("v")).alias("r"), round_even(F.col("v"), 2).alias("t")).collect()
    assert all((x.r, x.t) == ((round(x.v, 4), round(x.v, 2)) if x.v is not None else (None, None)) for x in found)


def test_full_rows(results):
    rows = {r.line_id: r for r in export.full_rows(results).collect()}
    assert [rows[i]["Status"] for i in (1, 2, 3, 4)] == ["EXACT_MATCH", "Validation Required", "NO_MATCH", "HIGH_CONFIDENCE"]
    assert [rows[2][n] for n in export.ADDED] == ["Validation Required", "B", "C1", "", "", "", "", ""]
    assert (rows[1]["Matched Part Number"], rows[1]["Orderable Part Number"]) == ("A", "A1")


def test_input_columns_lose_no_cell(results, tmp_path):
    spark = results.sparkSession
    cells = [(1, f"h{i:03}", i, f"a{i}") for i in range(510)] + [(2, "h001", 0, "b1"), (2, "z", 1, "b2"), (2, "h505", 2, None)]
    raw = spark.createDataFrame(cells, "line_id long, header string, col int, text string")
    full = export.full_rows(results)
    out = export.with_input_columns(full, raw, 500)
    assert out.columns == [*(f"h{i:03}" for i in range(500)), "other_cells", "line_id", *export.ADDED]
    rows = {r.line_id: r for r in out.collect()}
    assert all(rows[1][f"h{i:03}"] == f"a{i}" for i in range(500)) and rows[1].other_cells == {f"h{i}": f"a{i}" for i in range(500, 510)}
    assert (rows[2].h001, rows[2].h000, rows[2].other_cells) == ("b1", "", {"z": "b2", "h505": ""})
    assert rows[4].other_cells == {"Requested Description": "nut", "Quantity": ""} and rows[4].h000 == ""
    few = export.with_input_columns(full, raw.where("col < 2"), 500)
    assert few.columns == ["h000", "h001", "z", "Requested Description", "Quantity", "other_cells", "line_id", *export.ADDED]
    export.write_csv(out.select("line_id", "other_cells"), str(tmp_path / "csv"))
    assert "h505" in spark.read.option("header", True).option("escape", "\"").csv(str(tmp_path / "csv")).where("line_id = 1").first().other_cells


def test_picks_need_a_listed_candidate_of_a_line_under_review(results):
    picks = results.sparkSession.createDataFrame([(2, "C"), (1, "C"), (3, "C")], "line_id long, product_code string")
    rows = {r.line_id: (r.status, r.matched_part) for r in decide.selected(results, picks).collect()}
    assert rows == {1: ("EXACT_MATCH", "A"), 2: ("HIGH_CONFIDENCE", "C"), 3: ("NO_MATCH", None), 4: ("HIGH_CONFIDENCE", "D")}
    (two,) = decide.selected(results, picks).where("line_id = 2").collect()
    assert (two.matched_orderable, two.matched_description, two.percentage, two.original_confidence, two.selection_type) == ("C1", "y", 86.0, 86.0, "USER_SELECTED")
    assert export.order_rows(decide.selected(results, picks)).where("line_id = 2").first().item == "C1"
    assert {(r.line_id, r.reason[:4]) for r in decide.refused_picks(results, picks).collect()} == {(1, "Only"), (3, "Only")}


def test_differences_and_summary(results):
    before = results.where("line_id < 4").withColumn("status", F.when(F.col("line_id") == 2, "NO_MATCH").otherwise(F.col("status")))
    found = {r.requested_description: r.change for r in decide.differences(before, results).collect()}
    assert found == {"bolt": "SAME", "rod": "CHANGED", "": "SAME", "nut": "NEW"}
    assert tuple(decide.summary(results).first()) == (4, 2, 1, 1)


def test_second_opinion(results):
    spark = results.sparkSession
    codes = spark.createDataFrame([("A",), ("B",), ("D",)], "code string")
    kin = spark.createDataFrame([("D",)], "code string")
    done = adjudicate.adjudicated(results, codes, kin)
    rows = {r.line_id: (r.decision, r.rejected, r.status, r.confidence) for r in done.collect()}
    assert rows == {2: ("REVIEW_REQUIRED", None, "REVIEW_REQUIRED", 55.0), 4: ("CONFIDENT_MATCH", adjudicate.FAMILY, "REVIEW_REQUIRED", 95.0)}
    record = {r.line_id: r for r in adjudicate.audit(results, done, "rules").collect()}
    assert record[2].candidate_part_numbers == ["B", "C"] and record[2].deterministic_scores == {"B": 91.0, "C": 90.75}
    assert record[4].validation_rejected and record[4].provider == "rules"


def test_opinions_combine_as_stated(spark):
    rows = [(30.0, 55.0, "REVIEW_REQUIRED"), (92.0, 95.0, "CONFIDENT_MATCH"), (97.0, 95.0, "CONFIDENT_MATCH"), (60.0, None, "NO_MATCH")]
    got = [r[0] for r in spark.createDataFrame(rows, "d double, o double, s string").select(adjudicate.combined(F.col("d"), F.col("o"), F.col("s"))).collect()]
    assert got == [55.0, 92.0, 95.0, 60.0]


def test_opinions_from_text(results):
    said = '"reasoning_summary": "s"'
    bodies = [(1, f'{{"decision": "CONFIDENT_MATCH", "selected_part_number": "A", "confidence_percentage": 95, {said}}}'), (2, "no json"), (3, f'{{"decision": "SURE", "selected_part_number": "A", {said}}}'), (4, None), (5, f'{{"decision": "REVIEW_REQUIRED", "confidence_percentage": null, {said}, "conflicting_attributes": {{"volts": "120"}}}}')]
    found = adjudicate.parsed_opinions(results.sparkSession.createDataFrame(bodies, "line_id long, body string")).collect()
    rows = {r.line_id: (r.decision, r.part, r.confidence, r.valid) for r in found}
    review = ("REVIEW_REQUIRED", None, None, False)
    assert rows == {1: ("CONFIDENT_MATCH", "A", 95.0, True), 2: review, 3: review, 4: review, 5: ("REVIEW_REQUIRED", None, None, True)}
    assert {r.line_id: r.conflicting for r in found}[5] == ["volts: 120"]


def test_quantity_needs_a_blank_before_its_unit(spark):
    rows = [("EMT 10EA",), ("EMT 10 EA",), ("12 units of pipe",)]
    got = [r.q for r in spark.createDataFrame(rows, "t string").select(T.quantity(T.fold(F.col("t"))).alias("q")).collect()]
    assert got == [None, 10, 12]


def test_gaps_over_all_candidates(spark):
    rows = [(1, 70.0), (1, 72.0), (1, None), (1, 50.5), (2, 9.0), (3, 5.0), (3, 5.0)]
    got = {r.line_id: tuple(r)[1:] for r in decide.gaps(spark.createDataFrame(rows, "line_id int, score double")).collect()}
    assert got == {1: (4, 72.0, 70.0, 2.0), 2: (1, 9.0, None, None), 3: (2, 5.0, 5.0, 0.0)}


def test_names_held_by_names(spark):
    names = ["ACME Corp", "acme", "Big Acme Ltd", "ab", "É-x", "xyz"]
    parts = ["acme", "AC", "b", "corp", "é-", "nothing", "zz", "Big Acme Ltd and more"]
    got = {tuple(r) for r in history.contained(spark.createDataFrame([(p,) for p in parts], "who string"), spark.createDataFrame([(n,) for n in names], "billtoname string")).collect()}
    assert got == {(p, n) for p in parts for n in names if p.lower() in n.lower()}
