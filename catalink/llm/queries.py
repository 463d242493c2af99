"""The queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import align, exact_dedup, language, lexical, neighbours, packing, pieces, pii, prefix_bpe, repeats, simhash, token_files, toxicity
from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays of texts that are equal but for the case of A-Z, for every document."""
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as ORC and read back, as places and digests."""
    path = token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(token_files.read_tokens(spark, path))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by nearest centroid."""
    return language.predictions(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts by kind, base spans as a digest, all spans."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector among all others."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.where("vec_id % 20 = 0").selectExpr("vec_id AS query_id"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings of 400 that stand anywhere else."""
    return repeats.trimmed(table(spark, sf_dir, "documents"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document and the text they give back, as digests."""
    return pieces.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids and decoded text of every document, as digests."""
    return prefix_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of every document by two tokenizers, as counts and digests."""
    return align.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_bpe": op11_bpe, "op12_search": op12_search, "op13_alignment": op13_alignment, "op4_pieces": op4_pieces, "op5_repeats": op5_repeats, "op10_neighbours": op10_neighbours, "op1_toxicity": op1_toxicity, "op3_pii": op3_pii, "op9_language": op9_language, "op2_token_files": op2_token_files, "op6_simhash": op6_simhash, "op8_packing": op8_packing, "op7_exact_dedup": op7_exact_dedup}

_TERMS = rf"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"

ORACLE_SQL = {
    "op12_search": f"""
        WITH w AS (SELECT doc_id, {_TERMS} AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY 1, 2),
             n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1), c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
             d AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, docs),
             q AS (SELECT item_id, {_TERMS} AS term FROM benchmark), a AS (SELECT item_id, term, count(*) AS repeats FROM q GROUP BY 1, 2),
             s AS (SELECT item_id, doc_id, sum(repeats * weight * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * docs // terms))))::BIGINT AS score
                   FROM a JOIN d USING (term) JOIN p USING (term) JOIN n USING (doc_id), c GROUP BY 1, 2),
             r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
    """,
    "op7_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)
    """,
}
