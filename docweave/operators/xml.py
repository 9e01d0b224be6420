"""XML operators on a column of texts, in Arrow batches; errors are values beside the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import xmltext as X
from docweave.plans import xpath

EVENTS = "struct<events:array<struct<pos:int,kind:string,name:string,value:string,attrs:map<string,string>,empty:boolean>>,error:string>"
MATCHES = "struct<matches:array<struct<n:int,path:string,name:string,attrs:map<string,string>,text:string,xml:string>>,error:string>"
NODES = "array<struct<node_id:int,end_id:int,parent_id:int,depth:int,name:string,attrs:map<string,string>,text:string>>"


def _udf(f: Callable, kind: str):
    return F.udf(f, kind, useArrow=True)


def _stream(text: str, resolved: bool, entities: dict[str, str] | None, uris: bool, merged: bool, comments: bool = True):
    s = X.events(text, comments)
    s = X.resolve(s, entities) if resolved else s
    s = X.namespaces(s) if uris else s
    return X.normalize(s) if merged else s


def events(doc: Column, comments: bool = True, resolve: bool = False, namespaces: bool = False, normalize: bool = False, entities: dict[str, str] | None = None) -> Column:
    """struct(events, error): the events up to the first failure. Attributes show references as written."""

    def row(i, e):
        kind = e[0]
        if kind == "start":
            return i, kind, e[1], None, {n: "".join(X._out(x) if x[0] != "text" else x[1] for x in v) for n, v in e[2]}, e[3]
        name = e[1] if kind in ("end", "entity", "pi", "doctype") else None
        value = {"pi": lambda: e[2], "charref": lambda: str(e[1]), "text": lambda: e[1], "cdata": lambda: e[1], "comment": lambda: e[1], "decl": lambda: e[1]}.get(kind, lambda: None)()
        return i, kind, name, value, None, None

    def run(text):
        out = []
        try:
            for e in _stream(text or "", resolve, entities, namespaces, normalize, comments):
                out.append(row(len(out), e))
        except (X.XmlError, RecursionError) as err:
            return out, str(err)
        return out, None

    return _udf(run, EVENTS)(doc)


def well_formed(doc: Column) -> Column:
    """Null for well-formed text, else what is wrong."""

    def run(text):
        try:
            for _ in X.events(text or ""):
                pass
        except (X.XmlError, RecursionError) as e:
            return str(e)
        return None

    return _udf(run, "string")(doc)


def xpath_column(doc: Column, path: str, max_matches: int | None = None, max_nesting: int | None = None, entities: dict[str, str] | None = None) -> Column:
    parsed = xpath.parse(path)

    def run(text):
        out = []
        try:
            for root in X.trees(_stream(text or "", True, entities, False, True)):
                for trail, e in xpath.select(root, parsed, max_matches, max_nesting):
                    out.append((len(out), trail, e.name, e.attrs, e.text(), X.render(X.tree_events(e))))
        except (X.XmlError, RecursionError) as err:
            return out, str(err)
        return out, None

    return _udf(run, MATCHES)(doc)


def xpath_filter(df: DataFrame, doc: str, path: str, **how) -> DataFrame:
    """A row for each match: columns of df and n, path, name, attrs, text, xml."""
    return df.withColumn("dw_x", F.explode(xpath_column(F.col(doc), path, **how)["matches"])).select("*", "dw_x.*").drop("dw_x")


def xpath_first(df: DataFrame, doc: str, path: str) -> DataFrame:
    return xpath_filter(df, doc, path, max_matches=1)


def xpath_through(df: DataFrame, doc: str, path: str, f: Callable[[DataFrame], DataFrame], **how) -> DataFrame:
    """Each match as a row (see xpath_filter) through a function of DataFrames."""
    return f(xpath_filter(df, doc, path, **how))


def xpath_consume(df: DataFrame, doc: str, path: str, sink: Callable, **how) -> None:
    """Hands the matches of each partition to a sink, an iterator of rows at a time; nothing comes back."""
    xpath_filter(df, doc, path, **how).foreachPartition(sink)


def xpath_dom(df: DataFrame, doc: str, path: str, **how) -> DataFrame:
    """The node tables of the matched elements: a row for each element below a match n, columns as of shred()."""
    found = xpath_filter(df, doc, path, **how).select(*df.columns, "n", F.col("xml").alias("dw_d"))
    return shred(found, "dw_d").drop("dw_d")


def from_events(stream: Column, collapse_empty: bool = True) -> Column:
    """Text of an array of events (see events()), of unresolved ones as it was but for the encoding in a
    declaration; null where tags don't match. An & in an attribute that starts no reference is escaped."""

    def run(es):
        if es is None:
            return None
        out, open_ = [], []
        for _, kind, name, value, attrs, empty in es:
            if kind == "start":
                open_.append(name)
                shown = [(k, [("raw", X.bare(v))]) for k, v in (attrs.items() if isinstance(attrs, dict) else attrs or [])]
                out.append((kind, name, shown, bool(empty)))
            elif kind == "end":
                if not open_ or open_.pop() != name:
                    return None
                out.append((kind, name))
            elif kind == "pi":
                out.append((kind, name, value))
            elif kind == "charref":
                out.append((kind, int(value)))
            elif kind in ("entity", "doctype"):
                out.append((kind, name))
            elif kind == "decl":
                out.append((kind, value, None, None))
            else:
                out.append((kind, value))
        return None if open_ else X.render(out, collapse_empty)

    return _udf(run, "string")(stream)


def xpath_collect(doc: Column, path: str) -> Column:
    """Texts of the matches, in document order."""
    return F.transform(xpath_column(doc, path)["matches"], lambda m: m["text"])


def shred(df: DataFrame, doc: str) -> DataFrame:
    """The node table of elements in preorder; a descendant's node_id is from node_id + 1 to end_id."""

    def run(text):
        out: list[list] = []

        def walk(e, parent, depth):
            me = len(out)
            out.append([me, me, parent, depth, e.name, e.attrs, "".join(k for k in e.kids if isinstance(k, str))])
            for k in e.kids:
                if isinstance(k, X.Element):
                    walk(k, me, depth + 1)
            out[me][1] = len(out) - 1

        try:
            for root in X.trees(_stream(text or "", True, None, False, True)):
                walk(root, None, 0)
        except (X.XmlError, RecursionError):
            return []
        return [tuple(r) for r in out]

    return df.withColumn("dw_n", F.explode(_udf(run, NODES)(F.col(doc)))).select("*", "dw_n.*").drop("dw_n")


def render(doc: Column, collapse_empty: bool = True, pretty: bool = False, indent: int = 2, width: int = 60) -> Column:
    """The text written anew; null if it isn't well-formed."""

    def run(text):
        try:
            return None if text is None else X.pretty(X.events(text), indent, width) if pretty else X.render(X.events(text), collapse_empty)
        except (X.XmlError, RecursionError):
            return None

    return _udf(run, "string")(doc)


def split_roots(df: DataFrame, doc: str, out: str = "doc") -> DataFrame:
    """A row for each root of a text of several."""

    def run(text):
        try:
            return [X.render(X.tree_events(t)) for t in X.trees(X.resolve(X.events(text or "")))]
        except (X.XmlError, RecursionError):
            return []

    return df.withColumn(out, F.explode(_udf(run, "array<string>")(F.col(doc))))
