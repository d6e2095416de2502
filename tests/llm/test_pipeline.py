"""The corpus pipeline: stages keep their promises, and the whole equals its stages."""

import os

import pytest

import corpus_pipeline
from textpipe.llm import langid

DATA = os.environ.get("TEXTPIPE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    from test_operators import plain_components, plain_contamination, plain_fingerprint

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if name != "tokens":
            assert docs.columns == COLUMNS
        now = {r.doc_id: (None if name == "tokens" else r.text) for r in docs.collect()}
        assert set(now) <= set(kept) and len(now) == docs.count()
        if name == "language":
            assert len(now) >= 0.97 * len(kept)
        elif name == "near_duplicates":
            groups = plain_components([(d, plain_fingerprint(t)) for d, t in kept.items()])
            assert set(now) == set(groups.values())
        elif name == "benchmark":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            for doc, text in kept.items():
                n, hit, _ = plain_contamination(text, items)
                assert (doc in now) == (not (hit and 20 * hit >= n))
        kept = now
    whole = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == {r.doc_id: r.ids_sha256 for r in docs.collect()}


def test_near_duplicates_of_null_and_shared_ids(spark):
    """Unrelated texts under a null or shared id stay; of near copies one row stays whatever the ids."""
    text = lambda k: " ".join(f"{k}word{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("d")), (5, text("e")), (7, text("e")), (None, text("e"))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.text, r.doc_id) for r in corpus_pipeline.near_duplicates(spark, docs, DATA).collect())
    assert got == [(text("a"), None), (text("b"), None), (text("c"), 7), (text("d"), 7), (text("e"), 5)]


def test_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "123 456", "en", "s", 7), (4, "plain words of some text", "en", "s", 3), (4, "plain words of some text", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        assert "doc_id" in docs.columns
    assert {r.doc_id for r in docs.collect()} == {4}
    assert langid.has_letter("1a") and not langid.has_letter("12 !") and not langid.has_letter(None)
