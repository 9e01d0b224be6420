"""One query for each operator over the test tables, and the SQL that gives the same rows.

Documents are built in the queries from base tables, so that the SQL can stay relational.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import cells as C
from docweave.functions import decoders as D
from docweave.functions import layout as L
from docweave.operators import binary as B
from docweave.operators import csv as V
from docweave.operators import json as J
from docweave.operators import xml as X
from docweave.plans import jsonpath, native, selector

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{"o": key, "lines": [{"n", "p", "s"}, ...]} of each order, lines in the order of n, p, s."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")))).alias("lines"))
    return lines.select(F.col("l_orderkey").alias("k"), F.to_json(F.struct(F.col("l_orderkey").alias("o"), "lines")).alias("doc"))


_LINES = "(SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)"


def region_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region's nations and their suppliers, nested: objects all the way, keyed by name."""
    s = _t(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("s_name", F.struct(F.col("s_suppkey").alias("key")))))).alias("suppliers"))
    n = _t(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"))
    n = n.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_nationkey").alias("key"), "suppliers")))).alias("nations"))
    r = _t(spark, sf_dir, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    return r.select(F.col("r_regionkey").alias("r"), F.to_json(F.struct(F.col("r_regionkey").alias("key"), "nations")).alias("doc"))


_NEST = "(SELECT r_regionkey AS r, n_nationkey AS n, n_name, s_suppkey AS s, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey)"
_KEYS = f"(SELECT DISTINCT r, r AS v, '/key' AS path FROM {_NEST} UNION ALL SELECT DISTINCT r, n, '/nations/' || n_name || '/key' FROM {_NEST} UNION ALL SELECT r, s, '/nations/' || n_name || '/suppliers/' || s_name || '/key' FROM {_NEST})"


def _int(c: str) -> Column:
    return F.col(c).cast("bigint")


# JSONPath


@query("SELECT event_type, sum(CAST(props->>'$.k' AS BIGINT)) AS sum_k, count(*) AS n FROM events GROUP BY event_type")
def jsonpath_child_agg(spark, d):
    return _t(spark, d, "events").select("event_type", native.first(F.col("props"), "$.k", "bigint").alias("k")).groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("*").alias("n"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def jsonpath_child(spark, d):
    return J.jsonpath_deserialize(_t(spark, d, "events"), "props", "$.k", "bigint", "k").select("event_id", "k")


@query(f"SELECT k, p FROM {_LINES} WHERE i = 1")
def jsonpath_index(spark, d):
    return J.jsonpath_deserialize(order_docs(spark, d), "doc", "$.lines[1].p", "bigint", "p").select("k", "p")


@query(f"SELECT k, p FROM {_LINES} WHERE i BETWEEN 1 AND 2")
def jsonpath_range_inclusive(spark, d):
    return J.jsonpath_deserialize(order_docs(spark, d), "doc", "$.lines[1:2].p", "bigint", "p").select("k", "p")


@query(f"SELECT k, p FROM {_LINES} WHERE i >= 2")
def jsonpath_range_open(spark, d):
    return J.jsonpath_deserialize(order_docs(spark, d), "doc", "$.lines[2:].p", "bigint", "p").select("k", "p")


@query(f"SELECT s, count(*) AS n, sum(p) AS sum_p FROM {_LINES} GROUP BY s")
def jsonpath_wildcard_agg(spark, d):
    v = J.jsonpath_values(order_docs(spark, d), "doc", "$.lines[*]")
    v = v.select(F.variant_get("value", "$.s", "bigint").alias("s"), F.variant_get("value", "$.p", "bigint").alias("p"))
    return v.groupBy("s").agg(F.count("*").alias("n"), F.sum("p").alias("sum_p"))


@query("SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS v FROM nation UNION ALL SELECT n_nationkey, n_name FROM nation UNION ALL SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) FROM nation")
def jsonpath_object_wildcard(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.to_json(F.struct("*")).alias("doc"))
    return J.jsonpath_deserialize(docs, "doc", "$.*", "string", "v").select("k", "v")


@query(f"SELECT r, path, CAST(v AS VARCHAR) AS v FROM {_KEYS}")
def jsonpath_descendant(spark, d):
    return J.jsonpath_filter(region_docs(spark, d), "doc", "$..key").select("r", "path", F.col("value").alias("v"))


@query(f"SELECT DISTINCT r, n_name FROM {_NEST}")
def jsonpath_topmost(spark, d):
    """The topmost objects below nations; the suppliers inside them aren't given again."""
    return J.jsonpath_filter(region_docs(spark, d), "doc", "$.nations..*", max_nesting=0).select("r", F.split("path", "/")[2].alias("n_name"))


@query("SELECT r_regionkey AS r, CAST(r_regionkey AS VARCHAR) AS v FROM region")
def jsonpath_first(spark, d):
    return J.jsonpath_first(region_docs(spark, d), "doc", "$..key").select("r", F.col("value").alias("v"))


@query(f"SELECT r, least(3, count(*)) AS n FROM {_KEYS} GROUP BY r")
def jsonpath_max_matches(spark, d):
    return J.jsonpath_filter(region_docs(spark, d), "doc", "$..key", max_matches=3).groupBy("r").agg(F.count("*").alias("n"))


@query(f"SELECT k, n, p, s FROM {_LINES}")
def jsonpath_deserialize(spark, d):
    return J.jsonpath_deserialize(order_docs(spark, d), "doc", "$.lines[*]", "struct<n:int,p:bigint,s:bigint>", "x").select("k", "x.n", "x.p", "x.s")


@query(f"SELECT k, '[' || string_agg(CAST(p AS VARCHAR), ',' ORDER BY i) || ']' AS collected FROM {_LINES} GROUP BY k")
def jsonpath_collect(spark, d):
    return J.jsonpath_collect(order_docs(spark, d), ["k"], "doc", "$.lines[*].p")


# Selectors


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, CAST(n_regionkey AS VARCHAR) FROM nation")
def selector_names(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.to_json(F.struct("*")).alias("doc"))
    return J.selector_filter(docs, "doc", '.["n_name","n_regionkey"]', strict=True).select("k", F.col("value").alias("v"))


@query(f"SELECT k, CAST(p AS VARCHAR) AS p FROM {_LINES} WHERE i IN (0, 2)")
def selector_indices(spark, d):
    return J.selector_filter(order_docs(spark, d), "doc", ".lines.[0,2].p").select("k", F.col("value").alias("p"))


@query(f"SELECT k, CAST(p AS VARCHAR) AS p FROM {_LINES} WHERE i BETWEEN 1 AND 3")
def selector_range_builder(spark, d):
    return J.selector_filter(order_docs(spark, d), "doc", selector.root.field("lines").range(1, 3).field("p")).select("k", F.col("value").alias("p"))


@query(f"SELECT k, CAST(v AS VARCHAR) AS v FROM (SELECT k, n AS v FROM {_LINES} UNION ALL SELECT k, p FROM {_LINES} UNION ALL SELECT k, s FROM {_LINES})")
def selector_iterate(spark, d):
    return J.selector_filter(order_docs(spark, d), "doc", ".lines.[].[]").select("k", F.col("value").alias("v"))


@query("SELECT event_id FROM events WHERE false")
def selector_lenient(spark, d):
    return J.selector_filter(_t(spark, d, "events"), "props", ".k.z?").select("event_id")


@query("SELECT event_id, 'cannot index number with string' AS error FROM events")
def selector_strict_error(spark, d):
    return _t(spark, d, "events").select("event_id", J.match_column(F.col("props"), selector.parse(".k.z"))["error"].alias("error"))


@query("SELECT event_id, 'missing mandatory fields: z' AS error FROM events")
def selector_mandatory(spark, d):
    return _t(spark, d, "events").select("event_id", J.match_column(F.col("props"), selector.parse(".z!"))["error"].alias("error"))


@query(f"SELECT k, '{{\"lines\":[{{\"p\":' || p || '}}]}}' AS doc FROM {_LINES} WHERE i = 0")
def selector_enclosed(spark, d):
    return order_docs(spark, d).select("k", J.selector_enclosed(F.col("doc"), ".lines.[0].p").alias("doc"))


# jq


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def jq_field(spark, d):
    return J.jq_values(_t(spark, d, "events"), "props", ".k").select("event_id", F.col("result").cast("bigint").alias("k"))


@query(f"SELECT k, p FROM {_LINES} WHERE i >= 1 AND i < 3")
def jq_slice_exclusive(spark, d):
    return J.jq_values(order_docs(spark, d), "doc", ".lines[1:3].p").select("k", F.col("result").cast("bigint").alias("p"))


@query(f"SELECT k, s FROM {_LINES}")
def jq_iterate_pipe(spark, d):
    return J.jq_values(order_docs(spark, d), "doc", ".lines[] | .s").select("k", F.col("result").cast("bigint").alias("s"))


@query(f"SELECT k, 3 + 4 * count(*) AS n FROM {_LINES} GROUP BY k")
def jq_recursive_count(spark, d):
    return J.jq_run(order_docs(spark, d), "doc", "..").groupBy("k").agg(F.count("*").alias("n"))


@query(f"SELECT k, '{{\"order\":' || k || ',\"part\":' || p || ',\"none\":null}}' AS result FROM {_LINES}")
def jq_object_iterator(spark, d):
    return J.jq_run(order_docs(spark, d), "doc", '{"order": .o, "part": .lines[].p, "none": .zz}').select("k", "result")


@query(f"SELECT k, '[' || k || ',' || string_agg(CAST(p AS VARCHAR), ',' ORDER BY i) || ',true]' AS result FROM {_LINES} GROUP BY k")
def jq_array_constructor(spark, d):
    return J.jq_run(order_docs(spark, d), "doc", "[.o, .lines[].p, .zz, true]").select("k", "result")


@query(f"SELECT k, '{{\"p\":' || p || '}}' AS result FROM {_LINES}")
def jq_filter_constructor(spark, d):
    return J.jq_run(order_docs(spark, d), "doc", '.lines[] | {"p": .p}').select("k", "result")


# JSON tokens, node table, rendering, transformations


@query(f"SELECT k, 7 + 8 * count(*) AS n FROM {_LINES} GROUP BY k")
def json_tokens_count(spark, d):
    return order_docs(spark, d).select("k", F.size(J.tokens(F.col("doc"))["tokens"]).cast("long").alias("n"))


@query(f"SELECT k, count(*) AS n FROM {_LINES} GROUP BY k")
def json_tokens_roundtrip(spark, d):
    """The generator keeps the filter above it: pushed below, it would tokenize and rebuild each document twice."""
    back = order_docs(spark, d).select("k", F.inline(F.array(F.struct("doc", J.from_tokens(J.tokens(F.col("doc"))["tokens"])[0].alias("back")))))
    return back.where("doc = back").select("k", F.size(F.from_json("back", "struct<lines:array<struct<n:int>>>")["lines"]).cast("long").alias("n"))


@query(f"SELECT r, 3 + count(DISTINCT n) * 3 + 2 * count(s) AS n, 5 AS depth FROM {_NEST} GROUP BY r")
def json_node_table(spark, d):
    return J.shred(region_docs(spark, d), "doc").groupBy("r").agg(F.count("*").alias("n"), F.max("depth").cast("int").alias("depth"))


@query(f"SELECT r, count(*) AS n FROM {_NEST} GROUP BY r")
def json_node_interval_join(spark, d):
    """Supplier keys below `nations`, by preorder intervals within a document."""
    nodes = J.shred(region_docs(spark, d), "doc")
    top = nodes.where("depth = 1 and key = 'nations'").select("r", F.col("node_id").alias("a"), F.col("end_id").alias("z"))
    return nodes.where("key = 'key' and depth = 5").join(top, "r").where("node_id > a and node_id <= z").groupBy("r").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey AS k, '{\"name\":\"' || n_name || '\",\"u\":\"a\\/b\"}' AS doc FROM nation")
def json_render_compact(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit('{ "name" : "'), "n_name", F.lit('", "u": "a/b"}')).alias("doc"))
    return docs.select("k", J.render(F.col("doc")).alias("doc"))


@query("SELECT n_nationkey AS k, '{' || chr(10) || '  \"name\": \"' || n_name || '\",' || chr(10) || '  \"region\": ' || n_regionkey || chr(10) || '}' AS doc FROM nation")
def json_render_pretty(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("doc"))
    return docs.select("k", J.render(F.col("doc"), width=20).alias("doc"))


@query("SELECT event_id, '{\"k\":' || (2 * CAST(props->>'$.k' AS BIGINT)) || '}' AS doc FROM events")
def json_transform(spark, d):
    return _t(spark, d, "events").select("event_id", J.transform(F.col("props"), ".k", lambda k: 2 * k).alias("doc"))


@query("SELECT event_id, CASE WHEN CAST(props->>'$.k' AS BIGINT) >= 50 THEN '{}' ELSE '{\"k\":' || (props->>'$.k') || '}' END AS doc FROM events")
def json_transform_delete(spark, d):
    return _t(spark, d, "events").select("event_id", J.transform(F.col("props"), ".k", lambda k: k if k < 50 else None, delete=True).alias("doc"))


@query("SELECT event_id, '{\"type\":\"' || event_type || '\"}' AS doc FROM events")
def json_merge_patch(spark, d):
    patch = F.concat(F.lit('{"k":null,"type":"'), "event_type", F.lit('"}'))
    return _t(spark, d, "events").select("event_id", J.merge_patch(F.col("props"), patch).alias("doc"))


@query("SELECT event_type, count(*) AS n, sum(CAST(props->>'$.k' AS BIGINT)) AS sum_k FROM events GROUP BY event_type")
def json_wrap_array(spark, d):
    """All documents of a type as one array, unwrapped again."""
    whole = _t(spark, d, "events").groupBy("event_type").agg(J.wrap_object(F.col("props"), "all", {"v": "1"}).alias("doc"))
    return J.jsonpath_deserialize(whole, "doc", "$.all[*].k", "bigint", "k").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("sum_k"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def json_split_documents(spark, d):
    whole = _t(spark, d, "events").groupBy("event_type").agg(F.array_join(F.collect_list("props"), "").alias("docs"))
    return J.split_documents(whole, "docs").groupBy("event_type").agg(F.count("*").alias("n"))


# CSV


def _customer_csv(spark, d) -> DataFrame:
    c = _t(spark, d, "customer").select("c_custkey", F.concat("c_name", F.lit(', "x"')).alias("name"), "c_nationkey")
    return V.encode(c, ["c_custkey", "name", "c_nationkey"])


@query("SELECT c_custkey, c_custkey || ',\"' || c_name || ', \"\"x\"\"\",' || c_nationkey AS csv FROM customer")
def csv_encode_auto(spark, d):
    return _customer_csv(spark, d).select("c_custkey", "csv")


@query("SELECT c_custkey, '\"' || c_custkey || '\";\"' || c_name || '\"' AS csv FROM customer")
def csv_encode_always(spark, d):
    return V.encode(_t(spark, d, "customer"), ["c_custkey", "c_name"], ";", "always").select("c_custkey", "csv")


@query("SELECT c_custkey, c_name || ', \"x\"' AS name, c_nationkey FROM customer")
def csv_roundtrip(spark, d):
    rows = V.rows(_customer_csv(spark, d).select(F.col("csv")), "csv")
    rows = V.decode_columns(V.with_headers(rows, ["c_custkey", "name", "c_nationkey"]), {"c_custkey": "bigint", "name": "string", "c_nationkey": "int"}, strict=True)
    return rows.select("c_custkey", "name", "c_nationkey")


@query("SELECT c_custkey, c_name || ', \"x\"' AS name, c_nationkey FROM customer")
def csv_native_decode(spark, d):
    """The same through Spark's own parser."""
    x = _customer_csv(spark, d).select(F.from_csv("csv", "c_custkey bigint, name string, c_nationkey int", {"escape": '"'}).alias("x"))
    return x.select("x.*")


@query("SELECT n_nationkey AS k, 4 AS n_cells FROM nation")
def csv_literal_quotes(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit('"a,b",'), "n_name", F.lit(',c"')).alias("t"))
    return V.rows(docs, "t", literal_quotes=True).select("k", F.size("cells").alias("n_cells"))


@query("SELECT n_nationkey AS k, CAST(1 AS BIGINT) AS line, 'a' AS c FROM nation UNION ALL SELECT n_nationkey, 3, 'x' || chr(10) || 'y' FROM nation UNION ALL SELECT n_nationkey, 5, n_name FROM nation")
def csv_line_numbers(spark, d):
    docs = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit('a,b\r\n\r\n"x\ny",2\r\n'), "n_name", F.lit(",3")).alias("t"))
    return V.rows(docs, "t").select("k", "line", F.get("cells", F.lit(0)).alias("c"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'row has 3 cells, headers are 2' END AS error FROM nation")
def csv_header_errors(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 3 == 0, F.array(F.lit("1"), F.lit("2"), F.lit("3"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("cells"))
    return V.with_headers(n, ["a", "b"]).select("k", F.col("header_error").alias("error"))


@query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_size END AS size, CASE WHEN p_size % 2 = 1 THEN 'unable to decode ''s' || p_size || ''' as an integer' END AS error FROM part")
def csv_lenient_errors(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.concat(F.lit("s"), F.col("p_size").cast("string")))).alias("cells"))
    return V.decode_columns(V.with_headers(p, ["size"]), {"size": "int"}).select("k", "size", F.col("decode_error").alias("error"))


@query("SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN p_size END AS size FROM part")
def csv_optional_empty(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array(F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).otherwise("")).alias("cells"))
    return V.decode_columns(V.with_headers(p, ["size"]), {"size": "int?"}, strict=True).select("k", "size")


def _nation_cells(spark, d) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")).alias("cells"))


@query("SELECT n_nationkey AS k, n_nationkey || '|' || lower(n_name) || '|9|new' AS row FROM nation")
def csv_modify_set(spark, d):
    cells = V.updated_at(V.modify_at(F.col("cells"), 1, F.lower), 2, "9")
    _, cells = V.set_cell(["a", "b", "c"], cells, "d", F.lit("new"))
    return _nation_cells(spark, d).select("k", F.array_join(cells, "|").alias("row"))


@query("SELECT n_nationkey AS k, n_nationkey || ',' || n_regionkey AS row FROM nation")
def csv_delete_column(spark, d):
    return _nation_cells(spark, d).select("k", V.encode_row(V.delete_at(F.col("cells"), 1)).alias("row"))


@query("SELECT n_nationkey AS k, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation")
def csv_to_map(spark, d):
    m = V.to_map(["k", "name", "region"], F.col("cells"))
    return _nation_cells(spark, d).select("k", m["name"].alias("name"), m["region"].cast("bigint").alias("region"))


@query("SELECT event_id AS k, value > 10 AS flag, CAST(ts AS DATE) AS day, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at FROM events")
def cell_decoders(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("k"), F.upper((F.col("value") > 10).cast("string")).alias("f"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy/MM/dd HH:mm:ss").alias("at"))
    return e.select("k", C.decode(F.col("f"), "boolean").alias("flag"), C.decode(F.col("day"), "date").alias("day"), F.unix_timestamp(C.decode(F.col("at"), "timestamp", "yyyy/MM/dd HH:mm:ss")).alias("at"))


# XML


def _region_xml(spark, d) -> DataFrame:
    n = _t(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit('<n:nation xmlns:n="u" id="'), F.col("n_nationkey").cast("string"), F.lit('"'), F.when(F.col("n_nationkey") % 2 == 0, ' even="y"').otherwise(""), F.lit("><name>"), "n_name", F.lit(" &amp; &#65;<![CDATA[<]]></name></n:nation>")))), "").alias("kids"))
    return n.select(F.col("n_regionkey").alias("r"), F.concat(F.lit('<?xml version="1.0"?><region>'), "kids", F.lit("<empty/></region>")).alias("doc"))


@query("SELECT n_regionkey AS r, CAST(n_nationkey AS VARCHAR) AS id FROM nation")
def xpath_child(spark, d):
    return X.xpath_filter(_region_xml(spark, d), "doc", "/region/nation").select("r", F.col("attrs")["id"].alias("id"))


@query("SELECT n_regionkey AS r, n_name || ' & A<' AS text FROM nation")
def xpath_descendant(spark, d):
    """Text with references and CDATA resolved and joined."""
    return X.xpath_filter(_region_xml(spark, d), "doc", "//name").select("r", "text")


@query("SELECT n_regionkey AS r, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey = 7")
def xpath_attribute_eq(spark, d):
    return X.xpath_filter(_region_xml(spark, d), "doc", '//n:nation[@id == "7"]').select("r", F.col("attrs")["id"].alias("id"))


@query("SELECT n_regionkey AS r, CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 2 = 1 AND n_nationkey <> 7 OR n_nationkey = 4")
def xpath_attribute_bool(spark, d):
    return X.xpath_filter(_region_xml(spark, d), "doc", '//*:nation[!@even && @id != "7" || @id == "4"]').select("r", F.col("attrs")["id"].alias("id"))


@query("SELECT n_regionkey AS r, 'name' AS name FROM nation UNION ALL SELECT DISTINCT n_regionkey, 'empty' FROM nation")
def xpath_union(spark, d):
    return X.xpath_filter(_region_xml(spark, d), "doc", "//name|/region/empty|//*:empty").select("r", "name")


@query("SELECT DISTINCT n_regionkey AS r, 1 AS n FROM nation")
def xpath_first(spark, d):
    return X.xpath_first(_region_xml(spark, d), "doc", "//n:*").groupBy("r").agg(F.count("*").cast("int").alias("n"))


@query("SELECT n_regionkey AS r, 7 + 5 * count(*) AS n FROM nation GROUP BY n_regionkey")
def xml_events_normalized(spark, d):
    """start_doc, decl, region's and empty's tags, end_doc: 7; for each nation two tags, two tags of name, and
    the text before its CDATA and that (two events)."""
    ev = X.events(F.col("doc"), resolve=True, normalize=True)["events"]
    return _region_xml(spark, d).select("r", (F.size(ev) - F.size(F.filter(ev, lambda e: e["kind"] == "cdata"))).cast("long").alias("n"))


@query("SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
def xml_namespaces(spark, d):
    ev = X.events(F.col("doc"), resolve=True, namespaces=True)["events"]
    return _region_xml(spark, d).select("r", F.size(F.filter(ev, lambda e: (e["kind"] == "start") & (e["name"] == "{u}nation"))).cast("long").alias("n"))


@query("SELECT n_regionkey AS r, 2 * count(*) + 2 AS n FROM nation GROUP BY n_regionkey")
def xml_node_table(spark, d):
    return X.shred(_region_xml(spark, d), "doc").groupBy("r").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_regionkey AS r, true AS same FROM nation")
def xml_render_roundtrip(spark, d):
    docs = _region_xml(spark, d)
    return docs.select("r", (X.render(F.col("doc")) == F.replace("doc", F.lit("&#65;"), F.lit("&#x0041;"))).alias("same"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN '[GIMatch] unexpected closing tag </a>' END AS error FROM nation")
def xml_well_formed(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, "<a><b></a>").otherwise("<a><b/></a>").alias("doc"))
    return n.select("k", X.well_formed(F.col("doc")).alias("error"))


@query("SELECT n_nationkey AS k, '<a>' || n_name || '</a>' AS doc FROM nation UNION ALL SELECT n_nationkey, '<b/>' FROM nation")
def xml_split_roots(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("<a>"), "n_name", F.lit("</a> <b></b>")).alias("t"))
    return X.split_roots(n, "t").select("k", "doc")


# Binary formats


def _order_rows(spark, d) -> DataFrame:
    return _t(spark, d, "orders").select("o_orderkey", F.struct(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).alias("row"))


@query("SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders")
def cbor_roundtrip(spark, d):
    return _order_rows(spark, d).select(B.decode_as(B.cbor_to_json(B.cbor_encode(F.col("row"))), "k bigint, c bigint, s string").alias("x")).select("x.*")


_SIZE = "CASE WHEN {0} < {1} THEN 1 WHEN {0} < 256 THEN 2 WHEN {0} < 65536 THEN 3 ELSE 5 END"


@query(f"SELECT o_orderkey AS k, CAST(1 + 6 + 2 + {_SIZE.format('o_orderkey', 24)} + {_SIZE.format('o_custkey', 24)} AS INTEGER) AS n FROM orders")
def cbor_size(spark, d):
    return _order_rows(spark, d).select(F.col("o_orderkey").alias("k"), F.octet_length(B.cbor_encode(F.col("row"))).alias("n"))


@query("SELECT event_id, '{_ \"k\": ' || (props->>'$.k') || '}' AS diagnostic FROM events")
def json_to_cbor_diagnostic(spark, d):
    return _t(spark, d, "events").select("event_id", B.cbor_diagnostic(B.json_to_cbor(F.col("props"))).alias("diagnostic"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN 'unexpected end of input' END AS error FROM nation")
def cbor_validate(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_nationkey") % 2 == 0, F.unhex(F.lit("8301"))).otherwise(F.unhex(F.lit("8101"))).alias("b"))
    return n.select("k", B.cbor_validate(F.col("b")).alias("error"))


@query("SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders")
def msgpack_roundtrip(spark, d):
    return _order_rows(spark, d).select(B.decode_as(B.msgpack_to_json(B.msgpack_encode(F.col("row"))), "k bigint, c bigint, s string").alias("x")).select("x.*")


@query(f"SELECT o_orderkey AS k, CAST(1 + 6 + 2 + {_SIZE.format('o_orderkey', 128)} + {_SIZE.format('o_custkey', 128)} AS INTEGER) AS n FROM orders")
def msgpack_size(spark, d):
    return _order_rows(spark, d).select(F.col("o_orderkey").alias("k"), F.octet_length(B.msgpack_encode(F.col("row"))).alias("n"))


@query()
def pages_well_formed(spark, d):
    """HTML isn't XML: errors are values beside the rows."""
    return _t(spark, d, "pages").select("page_id", X.well_formed(F.col("html")).alias("error"))


# Arrays taken apart, typed and batched changes, layouts


@query(f"SELECT k, p FROM {_LINES}")
def json_strip_array(spark, d):
    """Top-level arrays taken apart."""
    docs = order_docs(spark, d).select("k", F.get_json_object("doc", "$.lines").alias("doc"))
    return J.strip_array(docs, "doc").select("k", F.get_json_object("doc", "$.p").cast("bigint").alias("p"))


@query(f"SELECT k, p FROM {_LINES} WHERE p % 2 = 0")
def jsonpath_through(spark, d):
    """Each match through a function of DataFrames."""
    even = lambda m: m.select("k", F.col("value").cast("bigint").alias("p")).where("p % 2 = 0")
    return J.through(order_docs(spark, d), "doc", "$.lines[*].p", even)


@dataclasses.dataclass
class Line:
    n: int
    p: int
    s: int


@query(f"SELECT k, n, p + s AS p FROM {_LINES} WHERE n > 1")
def json_transform_typed(spark, d):
    """Lines as dataclasses: the first goes, the others' part becomes a sum."""
    change = lambda x: dataclasses.replace(x, p=x.p + x.s) if x.n > 1 else None
    docs = order_docs(spark, d).select("k", J.transform_typed(F.col("doc"), ".lines.[]", Line, change, delete=True).alias("doc"))
    return J.jsonpath_deserialize(docs, "doc", "$.lines[*]", "struct<n:int,p:bigint>", "x").select("k", "x.n", "x.p")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) + 1 AS k FROM events")
def json_transform_batches(spark, d):
    """Matches of a whole batch changed at once."""
    docs = J.transform_batches(_t(spark, d, "events").select("event_id", "props"), "props", ".k", lambda ks: [k + 1 for k in ks])
    return docs.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("SELECT n_nationkey AS k, 'name' || chr(10) || '  ' || n_name || chr(10) || '  region ' || n_regionkey AS text FROM nation")
def layout_render(spark, d):
    """A group too wide for its line breaks at its lines; the one inside fits."""

    def event(e):
        return F.struct(F.lit(e[0]).alias("kind"), (e[1] if isinstance(e[1], Column) else F.lit(e[1])).alias("text"))

    inner = L.group([*L.text("region"), *L.line(), ("text", F.col("n_regionkey").cast("string"))])
    events = L.group([*L.text("name"), *L.indented([*L.line(), ("text", F.col("n_name")), *L.line(), *inner])])
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), J.layout(F.array(*map(event, events)), 12).alias("text"))


# Headers from the text, checked widths, decoders that combine


@query("SELECT n_regionkey AS r, CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM nation")
def csv_first_headers(spark, d):
    """A text a region, a header line and a line a nation; the columns are found by name."""
    lines = V.encode(_t(spark, d, "nation"), ["n_name", "n_nationkey"])
    whole = lines.groupBy("n_regionkey").agg(V.collect_text(F.col("csv"), F.col("n_nationkey"), V.header_line(["name", "key"])).alias("t"))
    return V.first_headers(whole, "t").select(F.col("n_regionkey").alias("r"), F.col("row")["key"].cast("bigint").alias("key"), F.col("row")["name"].alias("name"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey || ',' || n_name END AS csv, CASE WHEN n_nationkey % 2 = 1 THEN 'row has 1 cells, headers are 2' END AS error FROM nation")
def csv_checked_rows(spark, d):
    cells = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))).otherwise(F.array("n_name"))
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), V.checked_row(cells, ["a", "b"]).alias("x")).select("k", "x.*")


@query("SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 2 * p_size WHEN p_size % 3 = 0 THEN -1 END AS v, CASE WHEN p_size % 2 = 1 AND p_size % 3 > 0 THEN '''s' || p_size || ''' is none of none' END AS error FROM part")
def decoder_combinators(spark, d):
    """An integer doubled, or the word none as -1, or an error."""
    size = F.col("p_size").cast("string")
    cell = F.when(F.col("p_size") % 2 == 0, size).when(F.col("p_size") % 3 == 0, "none").otherwise(F.concat(F.lit("s"), size))
    decoder = D.of("int").map(lambda v: 2 * v).or_else(D.enum("none").map(lambda v: F.lit(-1)))
    return _t(spark, d, "part").select(F.col("p_partkey").alias("k"), decoder(cell).alias("x")).select("k", F.col("x.value").alias("v"), "x.error")


# Flat items and typed MessagePack


@query("SELECT o_orderkey AS k, 7 AS n, CAST(o_custkey AS VARCHAR) AS c FROM orders")
def cbor_items(spark, d):
    """Flat items of a map of three fields, written again and read once more."""
    items = B.cbor_items(B.cbor_encode(F.col("row")))
    again = _order_rows(spark, d).select("o_orderkey", B.cbor_items(B.cbor_from_items(items)).alias("x"))
    return again.select(F.col("o_orderkey").alias("k"), F.size("x").alias("n"), F.col("x")[4]["value"].alias("c"))


@query("SELECT o_orderkey AS k, 7 AS n, CAST(o_custkey AS VARCHAR) AS c FROM orders")
def msgpack_items(spark, d):
    items = B.msgpack_items(B.msgpack_encode(F.col("row")))
    again = _order_rows(spark, d).select("o_orderkey", B.msgpack_items(B.msgpack_from_items(items)).alias("x"))
    return again.select(F.col("o_orderkey").alias("k"), F.size("x").alias("n"), F.col("x")[4]["value"].alias("c"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def msgpack_typed_roundtrip(spark, d):
    """Typed fields, a timestamp among them."""
    names = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    orders = _t(spark, d, "orders").select(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in orders.schema)
    return B.msgpack_deserialize(B.msgpack_serialize(orders, names).select("data"), "data", schema).select("row.*")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS TINYINT) END AS v, CASE WHEN event_id % 2 = 1 THEN (1000 + event_id) || ' exceeds tinyint' END AS error FROM events")
def msgpack_overflow(spark, d):
    """Numbers beyond the type are errors beside the rows."""
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 100).otherwise(1000 + F.col("event_id")).alias("v"))
    return B.msgpack_deserialize(B.msgpack_serialize(e, ["v"]), "data", "v tinyint").select("event_id", "row.v", F.col("msgpack_error").alias("error"))


@query("SELECT n_regionkey AS r, name, count(*) AS n FROM (SELECT n_regionkey, unnest(['n:nation', 'name']) AS name FROM nation) GROUP BY ALL")
def xpath_dom(spark, d):
    """The elements of matched subtrees."""
    return X.xpath_dom(_region_xml(spark, d), "doc", "/region/nation").groupBy("r", "name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT n_regionkey AS r, true AS same FROM nation")
def xml_events_written(spark, d):
    """Events written as text give the events once more."""
    first = X.events(F.col("doc"))["events"]
    again = X.events(X.from_events(first))["events"]
    same = F.transform(first, lambda e: F.struct(e["kind"], e["name"], e["value"])) == F.transform(again, lambda e: F.struct(e["kind"], e["name"], e["value"]))
    return _region_xml(spark, d).select("r", same.alias("same"))


from docweave.plans import catalog_rules  # noqa: E402, F401  (registers its queries)
