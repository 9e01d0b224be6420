"""Operators that the catalog doesn't reach: cells, records, readers, writers, streams, plans."""

import dataclasses
import datetime
import decimal

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF
from docweave.__main__ import results as jq_results
from docweave.functions import cells as C
from docweave.functions import decoders as D
from docweave.functions import items as I
from docweave.functions import layout as L
from docweave.functions import msgpack as M
from docweave.functions import records
from docweave.operators import binary as B
from docweave.operators import csv as V
from docweave.operators import json as J
from docweave.operators import xml as X
from docweave.sources import readers, writers
from docweave.streaming import streams


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cell", "kind", "want"),
    [("TRUE", "boolean", True), ("t", "boolean", None), ("1", "boolean", None), ("300", "tinyint", None), (" 3", "int", None), ("-3", "int", -3), ("1.5", "int", None), ("1e3", "double", 1000.0), ("x", "double", None), ("ab", "char", None), ("", "unit", True), ("2 minutes", "duration", 120_000_000_000), ("soon", "duration", None), ("2024-02-30", "date", None), ("2024-02-29", "date", datetime.date(2024, 2, 29)), ("00000000-0000-0000-0000-00000000000A", "uuid", "00000000-0000-0000-0000-00000000000a"), ("http://a/b", "url", "http://a/b"), ("a b", "uri", None)],
)
def test_cells(spark, cell, kind, want):
    assert _one(spark, C.decode(F.lit(cell), kind)) == want


def test_cell_combinators(spark):
    assert _one(spark, C.decode_or_error(F.lit("x"), "int")) == (None, "unable to decode 'x' as an integer")
    assert _one(spark, C.decode_optional(F.lit(""), "int")) == (None, None)
    assert _one(spark, C.first_of(F.lit("2.5"), "int", "double")) == "2.5"
    assert _one(spark, C.one_of(F.lit("b"), "a")) is None
    assert _one(spark, C.escape(F.lit("a\rb"))) == "a\rb" and _one(spark, C.escape(F.lit('a"\n'))) == '"a""\n"'


@dataclasses.dataclass
class Row:
    i: int = 0
    s: str | None = None
    j: int = dataclasses.field(default=7, metadata={"name": "jay"})


def test_records(spark):
    assert records.schema(Row) == "`i` bigint, `s` string, `jay` bigint"
    df = V.with_headers(spark.createDataFrame([(["1", "", ""],), (["", "a", "x"],)], "cells array<string>"), ["i", "s", "jay"])
    got = [(r["i"], r["s"], r["j"], r["decode_error"]) for r in records.decode(df, Row).collect()]
    assert got == [(1, None, 7, None), (0, "a", None, "unable to decode 'x' as a long")]


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"x'), ("é", "1\n2")], "a string, b string")
    writers.csv(df, f"{tmp_path}/c")
    assert sorted(readers.csv(spark, f"{tmp_path}/c", header=True).collect()) == sorted(df.collect())
    writers.json_lines(df, f"{tmp_path}/j")
    assert readers.json_lines(spark, f"{tmp_path}/j").count() == 2
    writers.csv_text(df.where("a = 'é'"), f"{tmp_path}/t", ["a", "b"])
    assert V.rows(readers.whole_texts(spark, f"{tmp_path}/t/part*"), "doc").where("size(cells) = 2").first()["cells"] == ["é", "1\n2"]
    (tmp_path / "l9").write_bytes("€é".encode("iso8859-15"))
    assert readers.whole_texts(spark, f"{tmp_path}/l9", "latin9").first()["doc"] == "€é"
    (tmp_path / "x.xml").write_text("<r><i a='1'>x</i><i a='2'>y</i></r>")
    assert readers.xml_rows(spark, f"{tmp_path}/x.xml", "i").count() == 2
    assert readers.literal(spark, "{}", "[]").count() == 2


def test_strict_selection_raises(spark):
    df = readers.literal(spark, '{"a":1}')
    with pytest.raises(Exception, match="cannot index number with string"):
        J.selector_filter(df, "doc", ".a.b", strict=True).collect()


def test_matches_before_a_failure_stay(spark):
    got = readers.literal(spark, '{"a":1} {"a":2} {"a":').select(J.match_column(F.col("doc"), J.jsonpath.parse("$.a")).alias("m")).collect()
    assert [x["value"] for x in got[0]["m"]["matches"]] == ["1", "2"] and got[0]["m"]["error"]


def test_native_paths_need_no_python(spark):
    plan = J.jsonpath_values(spark.read.parquet(f"{SF}/events.parquet"), "props", "$.k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema" in plan


def test_wrap_and_xml_events(spark):
    df = spark.createDataFrame([('{"a":1}',), ("2",)], "d string")
    assert df.coalesce(1).agg(J.wrap_array(F.col("d")).alias("x")).first()["x"] == '[{"a":1},2]'
    assert _one(spark, J.value_in_object(F.lit("[1]"), "k")) == '{"k":[1]}'
    got = _one(spark, X.events(F.lit("<a>x<b></a>")))
    assert [e["kind"] for e in got["events"]] == ["start_doc", "start", "text", "start"] and "GIMatch" in got["error"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"a":[1,2]}\nnot json\n{"a":[3]}\n')
    stream = streams.read_documents(spark, f"{tmp_path}/in")
    streams.write(J.jsonpath_filter(stream, "doc", "$.a[*]").select("value"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["1", "2", "3"]
    seen = []
    streams.consume(J.jsonpath_values(stream, "doc", "$.a[0]"), lambda df, _: seen.append(df.count()), f"{tmp_path}/cp2").awaitTermination(60)
    assert sum(seen) == 2


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_layout(spark):
    got = L.render(L.group([*L.text("["), *L.indented([*L.linebreak(), *L.text("1,"), *L.line(), *L.text("2")]), *L.linebreak(), *L.text("]")]), 80)
    assert got == "[1, 2]"
    assert L.render(L.group([*L.text("["), *L.indented([*L.linebreak(), *L.text("1,"), *L.line(), *L.text("2")]), *L.linebreak(), *L.text("]")]), 4) == "[\n  1,\n  2\n]"
    assert L.render(L.words("aa bb cc dd"), 5) == "aa bb\ncc dd" and L.render([]) == ""
    with pytest.raises(L.LayoutError):
        L.render([("open", "")])


def test_decoders(spark):
    number = D.of("int")
    cases = [
        (number.map(lambda v: v + 1), "4", (5, None)),
        (number.either(D.of("boolean")), "true", ((None, True), None)),
        (number.emap(lambda v: F.struct((v * 2).alias("value"), F.when(v > 9, "big").alias("error"))), "11", (22, "big")),
        (number.flat_map(lambda v: D.of("string")), "7", ("7", None)),
        (number.handle_error(lambda e: F.length(e)), "x", (34, None)),
        (D.const(3), "x", (3, None)),
        (D.enum("a", "b"), "c", (None, "'c' is none of a, b")),
        (D.optional("int"), "", (None, None)),
        (number.check(lambda v: v > 3, lambda v: F.lit("small")), "2", (None, "small")),
    ]
    for decoder, cell, want in cases:
        assert _one(spark, decoder(F.lit(cell))) == want


def test_items():
    for text in ("83010203", "9f0102ff", "bf6161f5ff", "c249010000000000000000", "5f4101ff", "f97e00", "fb3ff199999999999a", "f8ff", "20", "f7"):
        raw = bytes.fromhex(text)
        assert I.to_cbor(I.cbor(raw)) == raw
    with pytest.raises(Exception, match="unexpected end"):
        I.to_cbor([("array", "2"), ("uint", "1")])
    assert I.to_cbor([("array", "2"), ("uint", "1")], checked=False) == b"\x82\x01"
    for x in (None, [1, -40, "a", b"\1", 1.5, M.Float32(0.5), M.Timestamp(1, 2), M.Ext(3, b"ab"), M.Pairs((("k", True),))]):
        raw = M.encode(x)
        assert I.to_msgpack(I.msgpack(raw)) == raw
    with pytest.raises(M.MsgpackError):
        I.to_msgpack([("map", "1"), ("nil", None)])


def test_typed_msgpack(spark):
    schema = "name string, age bigint, aliases array<string>, balance double, f float, things map<string,int>, raw binary, created timestamp, day date, price decimal(9,2), inner struct<a:int,b:string>"
    at = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)
    rows = [("é", 5, ["a", None], 1.5, 0.5, {"x": 1}, bytearray(b"\0\xff"), at, at.date(), decimal.Decimal("1.25"), (1, "q")), (None,) * 11]
    df = spark.createDataFrame(rows, schema)
    back = B.msgpack_deserialize(B.msgpack_serialize(df, df.columns).select("data"), "data", schema)
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, df.collect()))
    bad = spark.createDataFrame([(b"\x81\xa1a\xa1b",), (b"\xc1",), (None,), (b"\x80",)], "data binary")
    got = [(r["row"], r["msgpack_error"]) for r in B.msgpack_deserialize(bad, "data", "a int").collect()]
    assert got == [(None, "str where int is expected"), (None, "0xc1 is reserved (at 0)"), (None, None), ((None,), None)]


def test_changes_and_bad_documents(spark):
    df = spark.createDataFrame([(1, '{"a":1}{"a":2}'), (2, "{"), (3, None), (4, '{"b":1}'), (5, '{"a":9}')], "k int, doc string")
    seen = []
    got = J.transform_batches(df.coalesce(1), "doc", ".a", lambda vs: [None if v == 9 else 10 * v for v in vs], delete=True)
    assert [r["doc"] for r in got.orderBy("k").collect()] == ['{"a":10}\n{"a":20}', None, None, '{"b":1}', "{}"]
    assert [r["x"] for r in df.orderBy("k").select(J.transform(F.col("doc"), ".a", lambda v: v + 1).alias("x")).collect()][1:] == [None, None, '{"b":1}', '{"a":10}']
    assert _one(spark, J.merge_patch(F.lit("{"), F.lit("{}"))) is None and _one(spark, J.selector_enclosed(F.lit("["), ".a")) is None
    assert sorted(r["doc"] for r in J.strip_array(readers.literal(spark, "[1,[2]]", '{"a":3}', "x"), "doc").collect()) == ["1", "[2]", '{"a":3}']
    with pytest.raises(Exception, match="top-level array"):
        J.strip_array(readers.literal(spark, "{}"), "doc", strict=True).collect()
    J.consume(df, "doc", "$.a", lambda rows: seen.extend(rows))


def test_csv_headers(spark):
    df = spark.createDataFrame([(1, "a,b\n1,2\n3\n"), (2, "b\nx\n"), (3, ""), (4, None), (5, "a,a\n1,2\n"), (6, 'a\n1\n"')], "k int, t string")
    got = [(r["k"], r["row"], r["header_error"]) for r in V.first_headers(df, "t").orderBy("k", "line").collect()]
    assert got == [(1, {"a": "1", "b": "2"}, None), (1, None, "row has 1 cells, headers are 2"), (2, {"b": "x"}, None), (5, None, "duplicate headers"), (6, {"a": "1"}, None)]
    assert [r["cells"] for r in V.skip_headers(df, "t").orderBy("k", "line").collect()] == [["1", "2"], ["3"], ["x"], ["1", "2"], ["1"]]


def test_jq_command(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":[1,2]} {"a":[3]}')
    assert list(jq_results(spark, '.a[] | {"v": .}', f"{tmp_path}/a.json")) == ['{"v":1}', '{"v":2}', '{"v":3}']


def test_xml_events_written_again(spark):
    doc = '<?xml version="1.0"?><!DOCTYPE r><r a="x&lt;&#x0041;"><!--c--><?p q?><b/>t&amp;u<![CDATA[<z>]]></r>'
    assert _one(spark, X.from_events(X.events(F.lit(doc))["events"])) == doc
    assert _one(spark, X.from_events(X.events(F.lit('<r a="1 &amp; 2"/>'), resolve=True)["events"])) == '<r a="1 &amp; 2"/>'
    assert _one(spark, X.from_events(X.events(F.lit("<a><b></a>"))["events"])) is None


def test_xpath_matches_used(spark):
    df = readers.literal(spark, '<r><g i="1"><x/><y>t</y></g><g i="2"/></r>', "<r>", "<r>\x01</r>")
    assert [(r["n"], r["name"], r["depth"]) for r in X.xpath_dom(df, "doc", "//g").orderBy("n", "node_id").collect()] == [(0, "g", 0), (0, "x", 1), (0, "y", 1), (1, "g", 0)]
    assert X.xpath_through(df, "doc", "//g", lambda m: m.where("attrs['i'] = '2'")).count() == 1
    X.xpath_consume(df, "doc", "//g", lambda rows: sum(1 for _ in rows))
    assert _one(spark, X.well_formed(F.lit("<r>\x01</r>"))) == "[2] 1 is no character"


def test_tokens_in_bounded_parts(spark):
    """An Arrow batch of 10,000 texts, one of them large, doesn't become tokens all at once; rows keep their order."""
    some = ['{"o":1,"lines":[{"n":1,"p":2},{"n":2,"p":null}]}', None, '["x","\\/"] 2', "[1", "", "[" + "3," * 2 * J.TOKENS_AT_ONCE + "4]"]
    texts = [some[5 if i == 5000 else i % 5] for i in range(10_000)]
    most, parts = 0, []
    for part in J.token_arrays(iter([pa.array(texts)])):
        sizes = [n for n in part.field(0).value_lengths().to_pylist() if n < J.TOKENS_AT_ONCE]
        most = max(most, sum(sizes))
        parts.append(part)
    assert len(parts) > 2 and most < J.TOKENS_AT_ONCE + 20 and sum(map(len, parts)) == len(texts)
    back = list(J.text_arrays(iter([pa.concat_arrays(parts).field(0)])))
    assert len(back) > 2 and sum(map(len, back)) == len(texts)
    want = [[some[0]], [], ['["x","\\/"]', "2"], [], [], [some[5]]]
    assert [t for b in back for t in b.to_pylist()] == [want[some.index(t)] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).withColumn("x", J.tokens(F.col("t")))
    got = df.select("i", F.size("x.tokens"), F.col("x.error").isNotNull(), J.from_tokens(F.col("x.tokens"))).where("t is null or t != '[1'").orderBy("i").collect()
    assert [r[3] for r in got] == [want[some.index(t)] for t in texts if t != "[1"]
