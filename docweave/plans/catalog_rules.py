"""Queries for the rules of texts and wire formats: what is accepted, what is an error, and how it is written."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import cells as C
from docweave.functions import records
from docweave.operators import binary as B
from docweave.operators import csv as V
from docweave.operators import json as J
from docweave.operators import xml as X
from docweave.plans.catalog import _LINES, _nation_cells, _region_xml, _t, order_docs, query


def _nations(spark, d, **columns) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), *[c.alias(n) for n, c in columns.items()])


def _text(*parts) -> Column:
    """Literals and, where a part is a column, its text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _key() -> Column:
    return F.col("n_nationkey")


def _odd() -> Column:
    return _key() % 2 == 1


def _bytes(*parts) -> Column:
    """Hex digits and, where a part is a column, its number as one byte."""
    return F.unhex(F.concat(*[F.lit(p) if isinstance(p, str) else F.lpad(F.hex(p.cast("bigint")), 2, "0") for p in parts]))


# CSV


@query("SELECT n_nationkey AS k, 'a' || chr(13) || n_name AS c FROM nation")
def csv_lone_cr(spark, d):
    """A carriage return alone is data, before a line feed it ends the row."""
    docs = _nations(spark, d, t=_text("a\r", F.col("n_name"), ",b\r\n"))
    return V.rows(docs, "t").select("k", V.at(F.col("cells"), 0).alias("c"))


@query("SELECT n_nationkey AS k, 'ok' AS c, CASE WHEN n_nationkey % 2 = 0 THEN 'unexpected character after a quoted cell (line 2)' END AS error FROM nation UNION ALL SELECT n_nationkey, 'x', NULL FROM nation WHERE n_nationkey % 2 = 1")
def csv_malformed_quote(spark, d):
    """Rows before the failure stay."""
    docs = _nations(spark, d, t=F.when(_odd(), 'ok,1\n"x",2').otherwise('ok,1\n"x"2'))
    return V.rows(docs, "t").select("k", V.at(F.col("cells"), 0).alias("c"), F.col("csv_error").alias("error"))


@query("SELECT n_regionkey AS r, n_name AS name, CAST(n_nationkey AS BIGINT) AS key FROM nation")
def csv_skip_headers(spark, d):
    """A text a region, its header line left out and its cells decoded by position."""
    lines = V.encode(_t(spark, d, "nation"), ["n_name", "n_nationkey"])
    whole = lines.groupBy("n_regionkey").agg(V.collect_text(F.col("csv"), F.col("n_nationkey"), V.header_line(["x", "y"])).alias("t"))
    rows = V.decode_positions(V.skip_headers(whole, "t"), ["string", "bigint"])
    return rows.select(F.col("n_regionkey").alias("r"), F.col("_0").alias("name"), F.col("_1").alias("key"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, CASE WHEN p_size % 2 = 1 THEN 'unable to decode ''s' || p_size || ''' as an integer' END AS error FROM part")
def csv_decode_positions(spark, d):
    """Rows without headers; a cell that doesn't decode is an error beside its row."""
    size = F.col("p_size").cast("string")
    docs = _t(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(","), F.when(F.col("p_size") % 2 == 0, size).otherwise(F.concat(F.lit("s"), size))).alias("t"))
    return V.decode_positions(V.rows(docs, "t"), ["bigint", "int"]).select(F.col("_0").alias("k"), F.col("_1").alias("size"), F.col("decode_error").alias("error"))


@dataclasses.dataclass
class Nation:
    key: int
    region: int = dataclasses.field(metadata={"name": "reg"})
    name: str | None = None


@query("SELECT n_nationkey AS k, CAST(n_nationkey AS BIGINT) AS key, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def csv_static_headers(spark, d):
    """The columns of a dataclass."""
    return records.decode(V.with_headers(_nation_cells(spark, d), ["key", "name", "reg"]), Nation).select("k", "key", "name", "region")


@query("SELECT n_nationkey AS k, n_name AS name, n_nationkey AS key, 'unknown index 7' AS missing, 'unable to decode ''' || n_name || ''' as an integer' AS bad FROM nation")
def csv_cell_access(spark, d):
    row, cells = _nation_cells(spark, d), F.col("cells")
    return row.select("k", V.at(cells, 1).alias("name"), V.as_type(cells, 0, "int")["value"].alias("key"), V.as_type(cells, 7, "int")["error"].alias("missing"), V.as_type(cells, 1, "int")["error"].alias("bad"))


@query("SELECT c_custkey, c_custkey || ';' || c_name || ';\"' AS csv FROM customer")
def csv_encode_never(spark, d):
    c = _t(spark, d, "customer").withColumn("q", F.lit('"'))
    return V.encode(c, ["c_custkey", "c_name", "q"], ";", "never").select("c_custkey", "csv")


@query("SELECT n_nationkey AS k, 'http://h/' || n_nationkey AS url, 'unable to decode ''a b'' as url' AS error FROM nation")
def cell_urls(spark, d):
    return _nations(spark, d, url=C.decode(_text("http://h/", _key()), "url"), error=C.decode_or_error(F.lit("a b"), "url")["error"])


# JSON


@query("SELECT n_nationkey AS k, 'é' || chr(10) || '\"' || n_name || '/' AS v FROM nation")
def json_string_escapes(spark, d):
    docs = _nations(spark, d, doc=_text('{"a":"\\u00e9\\n\\"', F.col("n_name"), '\\/"}'))
    return J.jsonpath_filter(docs, "doc", "$.a").select("k", F.col("value").alias("v"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '-0|1.50|2E+3|' || n_nationkey ELSE '' END AS numbers, n_nationkey % 2 = 1 AS bad FROM nation")
def json_number_texts(spark, d):
    """Numbers keep their text; a leading zero is an error."""
    docs = _nations(spark, d, x=J.tokens(F.when(_odd(), "[01]").otherwise(_text("[-0, 1.50,2E+3,", _key(), "]"))))
    numbers = F.transform(F.filter("x.tokens", lambda t: t["kind"] == "number"), lambda t: t["value"])
    return docs.select("k", F.array_join(numbers, "|").alias("numbers"), F.col("x.error").isNotNull().alias("bad"))


@query("SELECT n_nationkey AS k, '1' AS v FROM nation UNION ALL SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) FROM nation")
def json_duplicate_keys(spark, d):
    docs = _nations(spark, d, doc=_text('{"k":1,"k":', _key(), "}"))
    return J.jsonpath_filter(docs, "doc", "$.k").select("k", F.col("value").alias("v"))


@query("SELECT n_nationkey AS k, n_nationkey % 2 = 1 AS bad FROM nation")
def json_trailing_commas(spark, d):
    docs = _nations(spark, d, x=J.tokens(F.when(_odd(), '{"a":[1,]}').otherwise('{"a":[1]}')))
    return docs.select("k", F.col("x.error").isNotNull().alias("bad"))


@query("SELECT event_id, '{\"v\":' || props || '}' AS doc FROM events")
def json_wrap_value(spark, d):
    return _t(spark, d, "events").select("event_id", J.value_in_object(F.col("props"), "v").alias("doc"))


@query("SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS doc FROM events")
def selector_this(spark, d):
    return J.selector_filter(_t(spark, d, "events"), "props", ".").select("event_id", F.col("json").alias("doc"))


@query("SELECT event_id, '{\"k\":' || (props->>'$.k') || '}' AS doc FROM events")
def jq_identity(spark, d):
    return J.jq_run(_t(spark, d, "events"), "props", ".").select("event_id", F.col("result").alias("doc"))


@query(f"SELECT k, p FROM {_LINES} WHERE i = 1")
def jq_index(spark, d):
    return J.jq_values(order_docs(spark, d), "doc", ".lines[1].p").select("k", F.col("result").cast("bigint").alias("p"))


@query(f"SELECT k, i AS n, CAST(p AS VARCHAR) AS v FROM {_LINES}")
def jsonpath_match_order(spark, d):
    """Matches are numbered in document order."""
    return J.jsonpath_filter(order_docs(spark, d), "doc", "$.lines[*].p").select("k", F.col("n").cast("bigint").alias("n"), F.col("value").alias("v"))


# XML


@query("SELECT n_regionkey AS r, string_agg(n_name || ' & A<', '|' ORDER BY CAST(n_nationkey AS VARCHAR)) AS names FROM nation GROUP BY n_regionkey")
def xpath_collect(spark, d):
    return _region_xml(spark, d).select("r", F.array_join(X.xpath_collect(F.col("doc"), "//name"), "|").alias("names"))


@query("SELECT n_regionkey AS r, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 2 = 0")
def xpath_through(spark, d):
    """Each match through a function of DataFrames."""
    even = lambda m: m.where("attrs['even'] = 'y'").select("r", F.col("attrs")["id"].alias("id"))
    return X.xpath_through(_region_xml(spark, d), "doc", "/region/nation", even)


@query("SELECT n_nationkey AS k, '1 2 3' AS x, 'l' || chr(10) || n_name AS text FROM nation")
def xml_white_space(spark, d):
    """White space in attributes is spaces; line ends in texts are line feeds."""
    docs = _nations(spark, d, doc=_text('<a x="1\t2\n3">l\r\n', F.col("n_name"), "</a>"))
    return X.xpath_filter(docs, "doc", "/a").select("k", F.col("attrs")["x"].alias("x"), "text")


@query("""SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 = 0 THEN '[66] 0 is no character' END AS malformed,
CASE n_nationkey % 5 WHEN 0 THEN '[66] 0 is no character' WHEN 1 THEN '[WFCEntityDeclared] entity x isn''t declared' WHEN 2 THEN '[NSCPrefixDeclared] prefix p isn''t declared'
WHEN 3 THEN '[NSCAttributesUnique] an attribute of a stands twice' ELSE '[NSCNoPrefixUndeclaring] prefix p has no uri' END AS error FROM nation""")
def xml_errors(spark, d):
    """Characters are checked while parsing; entities, prefixes and attributes that stand twice when they are resolved."""
    docs = ["<a>&#0;</a>", '<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', "<p:a/>", '<a x="1" x="2"/>', '<a xmlns:p=""/>']
    docs = _nations(spark, d, doc=F.element_at(F.array(*map(F.lit, docs)), (_key() % 5 + 1).cast("int")))
    return docs.select("k", X.well_formed(F.col("doc")).alias("malformed"), X.events(F.col("doc"), resolve=True, namespaces=True)["error"].alias("error"))


# CBOR and MessagePack


@query("SELECT n_nationkey AS k, '(_ h''0102'', h''' || printf('%02X', n_nationkey) || ''')' AS text, 'a chunk of the same kind and definite length is expected' AS nested FROM nation")
def cbor_indefinite_strings(spark, d):
    return _nations(spark, d, text=B.cbor_diagnostic(_bytes("5F42010241", _key(), "FF")), nested=B.cbor_validate(_bytes("5F5F41", _key(), "FFFF")))


@query("SELECT n_nationkey AS k, '[' || n_nationkey || ',[\"' || printf('%02X', n_nationkey) || '\"],273.15]' AS doc FROM nation")
def cbor_tags_to_json(spark, d):
    """A bignum, base16 asked for around an array, a decimal fraction."""
    return _nations(spark, d, doc=B.cbor_to_json(_bytes("83C241", _key(), "D78141", _key(), "C48221196AB3")))


@query("SELECT n_nationkey AS k, '\"' || rtrim(replace(replace(to_base64(unhex('FB' || printf('%02X', n_nationkey))), '+', '-'), '/', '_'), '=') || '\"' AS doc FROM nation")
def cbor_bytes_to_json(spark, d):
    return _nations(spark, d, doc=B.cbor_to_json(_bytes("42FB", _key())))


@query("SELECT n_nationkey AS k, '[simple(0), undefined, simple(32), ' || n_nationkey || ']' AS text, 'additional information 28 is reserved' AS error FROM nation")
def cbor_simple_values(spark, d):
    key = F.when(_key() < 24, _bytes("84E0F7F820", _key())).otherwise(_bytes("84E0F7F82018", _key()))
    return _nations(spark, d, text=B.cbor_diagnostic(key), error=B.cbor_validate(F.unhex(F.lit("FC"))))


@query("SELECT n_nationkey AS k, '[_ ' || n_nationkey || ', -' || (n_nationkey + 1) || ', 1.5_2, 2(h''010000000000000000'')]' AS text FROM nation")
def json_numbers_to_cbor(spark, d):
    docs = _nations(spark, d, doc=_text("[", _key(), ",-", _key() + 1, ",1.5,18446744073709551616]"))
    return docs.select("k", B.cbor_diagnostic(B.json_to_cbor(F.col("doc"))).alias("text"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 1 THEN '0xc1 is reserved (at 1)' END AS error FROM nation")
def msgpack_validate(spark, d):
    return _nations(spark, d, error=B.msgpack_validate(F.when(_odd(), _bytes("91C1")).otherwise(_bytes("91", _key()))))


@query("SELECT n_nationkey AS k, '[' || n_nationkey || ',-32,\"a\",{\"k\":' || n_nationkey || '}]' AS doc FROM nation")
def msgpack_fixed_formats(spark, d):
    return _nations(spark, d, doc=B.msgpack_to_json(_bytes("94", _key(), "E0A16181A16B", _key())))


@query("SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 9 WHEN 1 THEN 13 ELSE 18 END AS n FROM nation")
def msgpack_timestamp_formats(spark, d):
    """Whole seconds take 4 bytes, nanoseconds 8, a time before 1970 takes 12; heads and the field's name besides."""
    micros = F.when(_key() % 3 == 0, _key() * 1_000_000).when(_key() % 3 == 1, _key() * 1_000_000 + 5).otherwise(-_key() * 1_000_000 - 5)
    rows = _nations(spark, d, t=F.timestamp_micros(micros.cast("bigint")))
    return B.msgpack_serialize(rows, ["t"]).select("k", F.octet_length("data").alias("n"))
