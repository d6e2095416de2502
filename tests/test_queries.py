"""All registered queries of the text engine against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from textpipe import queries
from textpipe.functions import interpreter
from textpipe.plans.config import Config, op
from textpipe.sources import text as sources
from textpipe.streaming import clipboard

DATA = os.environ.get("TEXTPIPE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(map(str, r)) for r in df[names].itertuples(index=False))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in queries.ORACLES:
        assert rows(got) == rows(duck.execute(queries.ORACLES[name]).df())


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree\n\xff")
    path = str(tmp_path / "a.txt")
    assert sources.read_texts(spark, path).first().text == "one\r\ntwo\rthree\n�"
    assert [r.content for r in sources.read_lines(spark, path).orderBy("line_no").collect()] == ["one", "two\rthree", "�"]
    raw = spark.createDataFrame([("é".encode(),), ("é".encode("utf-16"),), (None,)], "b binary")
    assert [r[0] for r in raw.select(sources.decode_ladder(raw["b"])).collect()] == ["é", "é", None]
    sources.write_texts(spark.createDataFrame([("x",), ("y",)], "text string").coalesce(1), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_sql_functions_equal_columns(spark):
    names = ["id", "masked", "round", "square", "back", "falling", "falling_ci", "unwrapped", "emails", "urls", "lower"]
    got, expected = (sorted(map(tuple, f(spark, DATA).select(*names).collect())) for f in (queries.sql_operations, queries.sql_as_columns))
    assert got == expected
    odd = spark.createDataFrame([("b\r\nA\n\na\u03a3 ",), (None,), ("",), ("(x@y.zz), 'http://q.r?a=1\u00a0www.s",)], "text string")
    odd.createOrReplaceTempView("tp_odd")
    calls = {
        "sort_lines": ["", ", true", ", false, true", ", true, true"], "unwrap_lines": [""], "extract_emails": [""], "extract_urls": [""], "defang": ["", ", 'round'"],
        "mask_identifiers": [", true", ", false, true, true"], "change_case": [", 'upper'", ", 'title'", ", 'sentence'"], "clean_urls": [""], "strip_html": [""], "strip_markdown": [""],
        "html_to_markdown": [""], "dedupe_lines": [""], "prefix_lines": [", '> '"], "suffix_lines": [", ';'"], "join_with": [", '-'"], "split_on": [", 'x'"], "refang": [""],
        "collapse_whitespace": [""], "trim_trailing_whitespace": [""], "remove_blank_lines": [""],
    }
    assert len(calls) == 20
    for name, given in calls.items():
        for rest in given:
            values = [{"true": True, "false": False}.get(v, v.strip("'")) for v in rest.split(", ")[1:]]
            for r in spark.sql(f"SELECT text, tp_{name}(text{rest}) AS out FROM tp_odd").collect():
                assert r.out == (None if r.text is None else getattr(interpreter, name)(r.text, *values)), (name, rest, r.text)


def test_stream_keeps_the_latest(spark, tmp_path):
    """A micro-batch's latest record is done; the baseline and stale ones are not."""
    schema = clipboard.SCHEMA
    row = lambda g, text: (g, None, None, text, None, None)
    got = []
    for step, rows in enumerate(([row(1, "a  b")], [row(2, "c  d"), row(4, "e  f"), row(3, "g  h")], [row(3, "i  j")], [row(5, "k  l")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sink = lambda batch, epoch: got.extend((r.generation, r.out) for r in batch.collect())
        clipboard.start(stream, Config((op("collapse_whitespace"),)), sink, str(tmp_path / "checkpoint"), {"availableNow": True}, baseline=True).awaitTermination()
    assert got == [(4, "e f"), (5, "k l")]


def test_lines_keep_open_returns(spark, tmp_path):
    """Carriage returns belong to the newline after them; without one they stay."""
    (tmp_path / "open.txt").write_bytes(b"one\r\ntwo\r\r")
    (tmp_path / "closed.txt").write_bytes(b"one\r\r\ntwo\r\n")
    for name, expected in (("open.txt", ["one", "two\r\r"]), ("closed.txt", ["one", "two"])):
        assert [r.content for r in sources.read_lines(spark, str(tmp_path / name)).orderBy("line_no").collect()] == expected


def test_large_results_become_files(spark, tmp_path):
    given = [(1, "a" * 1025), (2, "b" * 1024), (3, None), (None, "c\n" * 1000)]
    rows_ = sources.write_routed(spark.createDataFrame([(None if i is None else f"{i}/x", t) for i, t in given], "id string, out string"), str(tmp_path / "files"), threshold_kb=0).collect()
    assert {r.id: (r.route, r.out) for r in rows_} == {"1/x": ("file", None), "2/x": ("inline", "b" * 1024), "3/x": ("inline", None), None: ("file", None)}
    for row, text in ((r, {"1/x": given[0][1], None: given[3][1]}[r.id]) for r in rows_ if r.route == "file"):
        assert [r.value for r in spark.read.text(row.file, wholetext=True).collect()] == [text + "\n"]
    empty = sources.write_routed(spark.createDataFrame([], "id string, out string"), str(tmp_path / "none"))
    assert empty.collect() == []


@pytest.mark.parametrize("name", ["default_log_pipeline", "html_to_markdown", "strip_html", "strip_markdown"])
def test_markup_keeps_empty_lines(spark, tmp_path, name):
    """Lines that have no letter are empty lines of the markup queries' input, at the start, between others and at the end."""
    texts = ["12\nab", "ab\n12", "ab\n1 2\ncd\n3 4\n5 6\n7 8\nef", "1 2\n3 4", "1 2\n3 4\n5 6\nab cd\n1\n2 3\n4", "ab\ncd", "12", "é", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = rows(con.execute(queries.ORACLES[name]).df())
    assert len(expected) == 6
    assert rows(queries.QUERIES[name](spark, str(tmp_path)).toPandas()) == expected
