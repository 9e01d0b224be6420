"""JSON operators on a column of documents. Python runs only where VARIANT can't keep what is asked: document
order, duplicate keys, number text, descent, and rendering; always in Arrow batches, never with a shuffle."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docweave.functions import jsontext as J
from docweave.functions import layout as layouts
from docweave.plans import jq, jsonpath, native, selector, steps

MATCHES = "struct<matches:array<struct<n:int,path:string,kind:string,value:string,json:string>>,error:string>"
NODES = "array<struct<node_id:int,end_id:int,parent_id:int,depth:int,kind:string,key:string,idx:int,raw:string>>"
TOKENS = "struct<tokens:array<struct<pos:int,kind:string,value:string,depth:int>>,error:string>"


def _udf(f: Callable, kind: str):
    return F.udf(f, kind, useArrow=True)


def path_text(path: tuple) -> str:
    """/a/0 for the element 0 of a."""
    return "".join(f"/{p}" for p in path)


def _matched(found: list) -> list[tuple]:
    return [(i, path_text(p), J.kind(v), J.scalar(v), J.compact(v)) for i, (p, v) in enumerate(found)]


def match_column(doc: Column, path: tuple[steps.Step, ...], max_matches: int | None = None, max_nesting: int | None = None) -> Column:
    """struct(matches, error): all matches in each of a text's documents, or why there are none."""

    def run(text):
        if text is None:
            return [], None
        out = []
        try:
            for v in J.values(text):
                out += steps.select(v, path, max_matches, max_nesting)
        except (J.JsonError, RecursionError) as e:
            return _matched(out), str(e)  # what came before the failure stays
        return _matched(out), None

    return _udf(run, MATCHES)(doc)


def select(df: DataFrame, doc: str, path: tuple[steps.Step, ...], max_matches: int | None = None, max_nesting: int | None = None, strict: bool = False) -> DataFrame:
    """A row for each match: columns of df and n, path, kind, value (scalar text), json. strict raises errors."""
    df = df.withColumn("dw_m", match_column(F.col(doc), path, max_matches, max_nesting))
    if strict:
        df = df.withColumn("dw_m", F.when(F.col("dw_m.error").isNull(), F.col("dw_m")).otherwise(F.raise_error(F.col("dw_m.error")).cast(MATCHES)))
    return df.withColumn("dw_x", F.explode("dw_m.matches")).select("*", "dw_x.*").drop("dw_m", "dw_x")


def jsonpath_filter(df: DataFrame, doc: str, path: str, **how) -> DataFrame:
    return select(df, doc, jsonpath.parse(path), **how)


def jsonpath_first(df: DataFrame, doc: str, path: str) -> DataFrame:
    return select(df, doc, jsonpath.parse(path), max_matches=1)


def jsonpath_values(df: DataFrame, doc: str, path: str, out: str = "value") -> DataFrame:
    """Matches as VARIANT: a Catalyst plan where the path allows, else through the document walker."""
    parsed = jsonpath.parse(path)
    if native.expressible(parsed):
        return native.select(df, doc, parsed, out)
    return select(df, doc, parsed).withColumn(out, F.parse_json("json")).drop("n", "path", "kind", "json", *(["value"] if out != "value" else []))


def jsonpath_deserialize(df: DataFrame, doc: str, path: str, schema: str, out: str = "value") -> DataFrame:
    """Matches cast to a type; what doesn't fit is null."""
    return jsonpath_values(df, doc, path, "dw_t").withColumn(out, F.try_variant_get("dw_t", F.lit("$"), schema)).drop("dw_t")


def jsonpath_collect(df: DataFrame, keys: list[str], doc: str, path: str) -> DataFrame:
    """Each row's matches as one JSON array in document order."""
    return df.select(*keys, F.transform(match_column(F.col(doc), jsonpath.parse(path))["matches"], lambda m: m["json"]).alias("dw_a")).withColumn("collected", F.concat(F.lit("["), F.array_join("dw_a", ","), F.lit("]"))).drop("dw_a")


def selector_filter(df: DataFrame, doc: str, text: str | selector.Builder, **how) -> DataFrame:
    return select(df, doc, text.steps if isinstance(text, selector.Builder) else selector.parse(text), **how)


def selector_enclosed(doc: Column, text: str) -> Column:
    """Documents cut down to what the selector keeps and what encloses it; null without a match."""
    path = selector.parse(text)

    def run(t):
        try:
            got = steps.DELETE if t is None else steps.enclosed(J.parse(t), path)
        except (J.JsonError, RecursionError):
            return None
        return None if got is steps.DELETE else J.compact(got)

    return _udf(run, "string")(doc)


def jq_run(df: DataFrame, doc: str, query: str, out: str = "result") -> DataFrame:
    """A row for each result of a jq query, as compact JSON; a document that isn't JSON gives none."""
    q = jq.parse(query)

    def run(text):
        try:
            return [] if text is None else [J.compact(r) for v in J.values(text) for r in jq.run(q, v)]
        except (J.JsonError, RecursionError):
            return []

    return df.withColumn(out, F.explode(_udf(run, "array<string>")(F.col(doc))))


def jq_values(df: DataFrame, doc: str, query: str, out: str = "result") -> DataFrame:
    """The same for a query without constructors, as VARIANT and, where no descent is asked for, without Python."""
    q = jq.parse(query)
    if not isinstance(q, jq.Path) or q.then is not None:
        raise ValueError("constructors give JSON text: use jq_run")
    if native.expressible(q.steps):
        return native.select(df, doc, q.steps, out)
    return jq_run(df, doc, query, "dw_r").withColumn(out, F.parse_json("dw_r")).drop("dw_r")


#: Tokens that a Python worker holds at once, besides those of one text.
TOKENS_AT_ONCE = 20_000


def tokens(doc: Column) -> Column:
    """struct(tokens, error) of a text of any number of documents."""
    return F.arrow_udf(token_arrays, TOKENS)(doc)


def token_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """TOKENS of texts, as arrays of TOKENS_AT_ONCE tokens and one text's more at most."""
    for batch in batches:
        pos, kinds, values, depths, ends, errors = [], [], [], [], [0], []
        for i in range(len(batch)):
            depth, error, start = 0, None, len(pos)
            try:
                for v in J.values(batch[i].as_py() or ""):
                    for k, t in J.tokens(v):
                        depth -= k.startswith("end_")
                        pos.append(len(pos) - start)
                        kinds.append(k)
                        values.append(t)
                        depths.append(depth)
                        depth += k.startswith("start_")
            except (J.JsonError, RecursionError) as e:
                error = str(e)
            ends.append(len(pos))
            errors.append(error)
            if len(pos) + len(errors) >= TOKENS_AT_ONCE or i == len(batch) - 1:
                rows = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(depths, pa.int32())], ["pos", "kind", "value", "depth"])
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows), pa.array(errors, pa.string())], ["tokens", "error"])
                pos, kinds, values, depths, ends, errors = [], [], [], [], [0], []


def from_tokens(stream: Column) -> Column:
    """JSON texts of the values of an array of tokens."""
    return F.arrow_udf(text_arrays, "array<string>")(stream)


def text_arrays(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The texts, a few rows at a time, as in token_arrays."""
    for batch in batches:
        start = held = 0
        for i, n in enumerate(batch.value_lengths().to_pylist(), 1):
            held += 1 + (n or 0)
            if held >= TOKENS_AT_ONCE or i == len(batch):
                part = batch.slice(start, i - start)
                _, kinds, values, *_ = part.flatten().flatten()
                each = zip(kinds.to_pylist(), values.to_pylist())
                yield pa.array([[J.compact(v) for v in J.from_tokens(islice(each, m or 0))] for m in part.value_lengths().to_pylist()], pa.list_(pa.string()))
                start, held = i, 0


def shred(df: DataFrame, doc: str) -> DataFrame:
    """The node table: a row for each value of each document, in preorder. A descendant's node_id is from
    node_id + 1 to end_id."""

    def run(text):
        try:
            return [] if text is None else nodes(J.parse(text))
        except (J.JsonError, RecursionError):
            return []

    return df.withColumn("dw_n", F.explode(_udf(run, NODES)(F.col(doc)))).select("*", "dw_n.*").drop("dw_n")


def nodes(value) -> list[tuple]:
    out: list[list] = []

    def walk(v, parent, depth, key, idx):
        me = len(out)
        out.append([me, me, parent, depth, J.kind(v), key, idx, J.scalar(v)])
        if isinstance(v, J.Obj):
            for k, x in v:
                walk(x, me, depth + 1, k, None)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, me, depth + 1, None, i)
        out[me][1] = len(out) - 1

    walk(value, None, 0, None, None)
    return [tuple(r) for r in out]


def split_documents(df: DataFrame, doc: str, out: str = "doc") -> DataFrame:
    """A row for each of the JSON values that a text holds one after another."""

    def run(text):
        got = []
        try:
            for v in J.values(text or ""):
                got.append(J.compact(v))
        except (J.JsonError, RecursionError):
            pass
        return got

    return df.withColumn(out, F.explode(_udf(run, "array<string>")(F.col(doc))))


def render(doc: Column, width: int | None = None, indent: int = 2) -> Column:
    """Compact text (/ and non-ASCII escaped), or laid out for a width. Null where the text isn't JSON."""

    def run(text):
        try:
            return None if text is None else "\n".join(J.compact(v) if width is None else J.pretty(v, width, indent) for v in J.values(text))
        except (J.JsonError, RecursionError):
            return None

    return _udf(run, "string")(doc)


def transform(doc: Column, path: str, f: Callable, delete: bool = False) -> Column:
    """Documents with f (from plain Python data to such) applied where the selector matches; with delete, a
    result of None takes the value and its key away."""
    parsed = selector.parse(path)

    def change(v):
        got = f(J.to_python(v))
        return steps.DELETE if delete and got is None else J.from_python(got)

    return _udf(_rewritten(parsed, change), "string")(doc)


def _rewritten(parsed: tuple[steps.Step, ...], change: Callable) -> Callable:
    """Each of a text's documents with its matches changed, one a line; null where the text isn't JSON or the path is strict and fails."""

    def run(text):
        try:
            return None if text is None else "\n".join(J.compact(steps.transform(v, parsed, change)) for v in J.values(text))
        except (J.JsonError, RecursionError):
            return None

    return run


def transform_typed(doc: Column, path: str, cls: type, f: Callable, delete: bool = False) -> Column:
    """The same where f takes a dataclass made from the matched object and gives one, plain data or None. A match
    whose fields aren't those of the class stays as it is."""
    parsed = selector.parse(path)

    def change(v):
        data = J.to_python(v)
        try:
            typed = cls(**data)
        except TypeError:
            return v
        got = f(typed)
        if delete and got is None:
            return steps.DELETE
        return J.from_python(dataclasses.asdict(got) if dataclasses.is_dataclass(got) else got)

    return _udf(_rewritten(parsed, change), "string")(doc)


def transform_batches(df: DataFrame, doc: str, path: str, f: Callable[[list], list], delete: bool = False) -> DataFrame:
    """The same where f has effects (a lookup elsewhere, say): it takes the matches of a whole Arrow batch at once
    and gives as many results. A task that runs again calls it again."""
    parsed = selector.parse(path)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(doc)
            taken: list = []
            keep = _rewritten(parsed, lambda v: taken.append(J.to_python(v)) or v)
            texts = batch.column(at).to_pylist()
            counts = []
            for t in texts:
                before = len(taken)
                if keep(t) is None:
                    del taken[before:]
                counts.append(len(taken) - before)
            results = iter(f(taken) if taken else [])

            def change(v):
                got = next(results)
                return steps.DELETE if delete and got is None else J.from_python(got)

            put = _rewritten(parsed, change)
            out = [keep(t) if not n else put(t) for t, n in zip(texts, counts)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def through(df: DataFrame, doc: str, path: str, f: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """Each match as a row (see select) through a function of DataFrames."""
    return f(jsonpath_filter(df, doc, path, **how))


def consume(df: DataFrame, doc: str, path: str, sink: Callable, **how) -> None:
    """Hands the matches of each partition to a sink, an iterator of rows at a time; nothing comes back."""
    jsonpath_filter(df, doc, path, **how).foreachPartition(sink)


def merge_patch(doc: Column, patch: Column, keep_nulls: bool = False) -> Column:
    """RFC 7396; null where one of the texts isn't JSON."""

    def run(a, b):
        if b is None:
            return a
        try:
            return J.compact(J.merge_patch(J.parse(a) if a is not None else None, J.parse(b), keep_nulls))
        except (J.JsonError, RecursionError):
            return None

    return _udf(run, "string")(doc, patch)


def wrap_array(docs: Column) -> Column:
    """An aggregate: all documents of a group as one JSON array, in no set order (order an array of structs to set one)."""
    return F.concat(F.lit("["), F.array_join(F.collect_list(docs), ","), F.lit("]"))


def wrap_object(docs: Column, at: str, fields: dict[str, str] | None = None) -> Column:
    """An aggregate: {fields..., at: [documents]}; fields are JSON texts."""
    head = "".join(f"{J.quote(k)}:{v}," for k, v in (fields or {}).items())
    return F.concat(F.lit("{" + head + J.quote(at) + ":"), wrap_array(docs), F.lit("}"))


def strip_array(df: DataFrame, doc: str, strict: bool = False, out: str = "doc") -> DataFrame:
    """The elements of top-level arrays, as JSON texts; other documents as they are or, with strict, an error."""

    def run(text):
        got = []
        try:
            for v in J.values(text or ""):
                if strict and type(v) is not list:
                    return None
                got += [J.compact(x) for x in (v if type(v) is list else [v])]
        except (J.JsonError, RecursionError):
            if strict:
                return None
        return got

    got = _udf(run, "array<string>")(F.col(doc))
    if strict:
        got = F.coalesce(got, F.raise_error(F.lit("a top-level array is expected")).cast("array<string>"))
    return df.withColumn(out, F.explode(got))


def layout(events: Column, width: int = 100, indent: int = 2) -> Column:
    """Text of an array of layout events (structs of kind and text); null where groups don't close."""

    def run(es):
        try:
            return None if es is None else layouts.render([(e[0], e[1] or "") for e in es], width, indent)
        except layouts.LayoutError:
            return None

    return _udf(run, "string")(events)


def value_in_object(doc: Column, at: str) -> Column:
    return F.concat(F.lit("{" + J.quote(at) + ":"), doc.cast(StringType()), F.lit("}"))
