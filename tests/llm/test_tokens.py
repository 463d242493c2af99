"""Token files and packing against whole-text encoding by the tokenizers library."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalink.llm import packing, token_files
from catalink.llm.tokens import Encoder

TEXTS = [None, "", " ", "\n", "a b\nc d's'S", "It's  two  blanks\n\nand lines ", "don't 'Ll STOP 1234 x", "Straße, ÉTÉ. naïve", "日本語 text 12", "é", "İx ok", "<|endoftext|> z", "tab\tbed", "x " * 5000, "q" * 3000, "a b c", "Dots. And, commas.", ".start", "a ,b", "x.,y z..", "_.a b.c,d", "3.5, v2.0.", "été, ÑU.\nOk. ", "don't. I'LL, q", "a\n.b", "Ünder.%%% x"]
SCHEMA = "doc_id long, text string, ids string, start int"


def docs_of(spark):
    return spark.createDataFrame([(i * 7 % 29, t, "c", None) for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_is_whole_text_encoding(name):
    codec = Encoder(public_tokenizers.path(name))
    for t in TEXTS * 2:
        assert codec.encode(t or "") == codec.direct(t or ""), t


def expected(name, end_id):
    tok = Tokenizer.from_file(public_tokenizers.path(name))
    return {i * 7 % 29: [*tok.encode(t or "", add_special_tokens=False).ids, end_id] for i, t in enumerate(TEXTS)}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark):
    path = token_files.write_tokens(docs_of(spark), public_tokenizers.path("byte_bpe_50k.json"))
    want = expected("byte_bpe_50k.json", 0)
    rows = token_files.read_tokens(spark, path)
    assert {r.doc_id: r.ids for r in rows.collect()} == want
    start = 0
    for r in sorted(token_files.digests(rows).collect(), key=lambda r: r.doc_id):
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want[r.doc_id]), crc(want[r.doc_id]))
        start += r.n_tokens
    some = token_files.read_tokens(spark, path, 3, 5)
    assert sorted(r.doc_id for r in some.collect()) == [3, 4, 5]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,3)" in some._jdf.queryExecution().toString()


def test_token_files_empty(spark):
    path = token_files.write_tokens(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.digests(token_files.read_tokens(spark, path)).count() == 0


def test_packing(spark):
    want = expected("word_bpe_49k.json", 1)
    rows = packing.pack(docs_of(spark), public_tokenizers.path("word_bpe_49k.json")).collect()
    windows, docs = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id])
    for pieces, total in [*((p, None) for p in windows.values()), *((p, len(want[i])) for i, p in docs.items())]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at <= 2048 if total is None else at == total
    assert docs.keys() == want.keys()
    assert len(windows) == -(-sum(map(len, want.values())) // 2048)


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_windows_are_near_equal():
    rng = np.random.default_rng(0)
    sizes = np.concatenate([np.diff(packing.cuts(int(n))) for n in rng.integers(1, 6000, 300)])
    loads = np.bincount(packing.pack_block(sizes), weights=sizes)
    assert loads.max() <= 2048 and loads.min() > 1950 and len(loads) <= 1.01 * sizes.sum() / 2048


def _rows_read(df):
    """Rows that the scan of tokens gave, after stripes and row groups were skipped by their metadata."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.size())]
    return [s.metrics().apply("numOutputRows").value() for s in scans if "ids" in s.toString()]


def test_a_lookup_reads_one_row_group(spark):
    path = token_files.write_tokens(spark.range(30_000).selectExpr("id * 2 AS doc_id", "'some words ' || id AS text"), public_tokenizers.path("byte_bpe_50k.json"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        (read,) = _rows_read(token_files.read_tokens(spark, path, 24_690, 24_690))
        assert 0 < read <= 1000
        assert _rows_read(token_files.read_tokens(spark, path, 24_691, 24_691))[0] <= 1000
        assert _rows_read(token_files.read_tokens(spark, path, 70_000, 70_001)) == [0]
        assert _rows_read(token_files.read_tokens(spark, path)) == [30_000]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
