"""Parsers and evaluation of the path languages, codecs and text rules, without Spark."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.functions import cbor, jsontext, msgpack, xmltext
from docweave.operators import csv
from docweave.plans import jq, jsonpath, selector, steps, xpath

DOC = jsontext.parse('{"a":{"a":{"c":1.50},"b":[1,2,{"a":3}]},"x":[10,20,30,40],"d":1,"d":2}')


def _select(path, **how):
    return [jsontext.compact(v) for _, v in steps.select(DOC, path, **how)]


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("$.x[1]", ["20"]), ("$.x[1:2]", ["20", "30"]), ("$.x[2:]", ["30", "40"]), ("$.x[:1]", ["10", "20"]), ("$.x[9]", []), ("$.x[*]", ["10", "20", "30", "40"]), ("$.a[*]", []), ('$["a"].b[2].a', ["3"]),
        ("$..c", ["1.50"]), ("$..a", ['{"a":{"c":1.50},"b":[1,2,{"a":3}]}', '{"c":1.50}']), ("$.d", ["1", "2"]), ("$.d.z", []),
    ],
)
def test_jsonpath(path, want):
    assert _select(jsonpath.parse(path)) == want


def test_jsonpath_limits():
    assert _select(jsonpath.parse("$..a"), max_nesting=0) == ['{"a":{"c":1.50},"b":[1,2,{"a":3}]}']
    assert len(_select(jsonpath.parse("$..*"), max_matches=2)) == 2


@pytest.mark.parametrize("text", ["", "$", "a", "$.", "$[", "$.a[", "$.a[-1]", "$. a", "$.a[1:2", '$["a]', "$.a]"])
def test_jsonpath_errors(text):
    with pytest.raises(steps.PathError):
        jsonpath.parse(text)


def test_selectors():
    assert _select(selector.parse(".")) == [jsontext.compact(DOC)]
    assert _select(selector.parse('.["x","d"].[]?')) == ["10", "20", "30", "40"]
    assert _select(selector.parse(".x.[0,3]")) == ["10", "40"]
    assert _select(selector.parse(" . x . [1 : 2] ")) == ["20", "30"]
    assert _select(selector.parse(".x.[3:1]")) == []
    assert selector.parse(".a.[]?.[1]!.[0:2]") == selector.Builder().field("a").iterate.lenient.index(1).mandatory.range(0, 2).steps
    for bad in (".a.b.z.z", ".x.k", ".zz!", ".x.[7]!", ".d.[]"):
        with pytest.raises(jsontext.JsonError):
            _select(selector.parse(bad) if bad != ".a.b.z.z" else selector.parse(".a.b.z"))
    for bad in ("", "a", ".a.", ".[1", '.["a",]', ".a?!", "..a"):
        with pytest.raises(steps.PathError):
            selector.parse(bad)


@pytest.mark.parametrize(
    ("query", "want"),
    [
        (".", [jsontext.compact(DOC)]), (".x[1:3]", ["20", "30"]), (".x[1:1]", ["20"]), (".x[:2]", ["10", "20"]), (".x[3:]", ["40"]), (".a.b[2] | .a", ["3"]), ('.["a"]["b"][0]', ["1"]), (".x[]", ["10", "20", "30", "40"]),
        ("[.x[0], .zz, true, null, -1.5e2]", ["[10,true,null,-1.5e2]"]), ('{"k": .x[0:2], "m": .zz, "s": "a\\"b"}', ['{"k":10,"m":null,"s":"a\\"b"}', '{"k":20,"m":null,"s":"a\\"b"}']), (".a | {\"c\": .a.c}", ['{"c":1.50}']), ("[]", ["[]"]), ("{}", ["{}"]),
    ],
)
def test_jq(query, want):
    assert [jsontext.compact(r) for r in jq.run(jq.parse(query), DOC)] == want


def test_jq_descends_through_arrays():
    assert len(list(jq.run(jq.parse(".."), DOC))) == 16  # both values of the key that stands twice


@pytest.mark.parametrize("text", ["", "a", ".x[3:1]", ".x[", '{"a" .b}', '{"a": .x[], "b": .x[]}', "[.a", ".a |", "{a: 1}", ".a extra"])
def test_jq_errors(text):
    with pytest.raises(steps.PathError):
        jq.parse(text)


XML = '<a x="1&amp;2"><b z="3">t&#x41;<![CDATA[<r>]]></b><b/><c:d xmlns:c="u"><b z="4"><b/></b></c:d></a>'


def _xpath(path, **how):
    roots = xmltext.trees(xmltext.normalize(xmltext.resolve(xmltext.events(XML))))
    return [xmltext.render(xmltext.tree_events(e)) for r in roots for _, e in xpath.select(r, xpath.parse(path), **how)]


@pytest.mark.parametrize(
    ("path", "n"),
    [("/a", 1), ("/b", 0), ("//b", 4), ("/a/b", 2), ("/a/*", 3), ("//c:*", 1), ("//*:d", 1), ("//q:d", 0), ('//b[@z]', 2), ('//b[@z == "3"]', 1), ('//b[@z != "3"]', 1), ("//b[!@z]", 2), ('//b[(@z == "3" || @z == "4") && !(@z == "4")]', 1), ("//b|/a/b", 4), ("//b/b|/a", 2)],
)
def test_xpath(path, n):
    assert len(_xpath(path)) == n


def test_xpath_limits_and_errors():
    assert len(_xpath("//b", max_nesting=0)) == 3 and len(_xpath("//b", max_matches=1)) == 1
    for bad in ("", "a", "/", "/a[", "/a[@]", '/a[@b == 1]', "/a||/b", "/a[@b][@c]"):
        with pytest.raises(steps.PathError):
            xpath.parse(bad)


@pytest.mark.parametrize("text", ["<a>", "<a></b>", "<a", "<a b></a>", "<a b=c/>", '<a b="<"/>', "<a>&x</a>", "<a>&#0;</a>", "x", "<a/>x", "<!-- <a/>", "<a>]]></a>", "<![CDATA[x]]>", "<a><?p</a>", "<a b='1'c='2'/>"])
def test_xml_errors(text):
    with pytest.raises(xmltext.XmlError):
        list(xmltext.events(text))


def test_xml_rules():
    kinds = [e[0] for e in xmltext.events('<?xml version="1.0" standalone="yes"?><!DOCTYPE a [<!ENTITY x "y">]><a>\r\n</a><b/>')]
    assert kinds == ["start_doc", "decl", "doctype", "start", "text", "end", "end_doc", "start_doc", "start", "end", "end_doc"]
    with pytest.raises(xmltext.XmlError, match="WFCEntityDeclared"):
        list(xmltext.resolve(xmltext.events("<a>&x;</a>")))
    with pytest.raises(xmltext.XmlError, match="NSCPrefixDeclared"):
        list(xmltext.namespaces(xmltext.events("<p:a/>")))
    with pytest.raises(xmltext.XmlError, match="NSCAttributesUnique"):
        list(xmltext.namespaces(xmltext.events('<a xmlns:p="u" xmlns:q="u" p:x="1" q:x="2"/>')))
    assert xmltext.render(xmltext.events("<a><b/></a>"), collapse_empty=False) == "<a><b></b></a>"


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(-1e15, 1e15) | st.text(st.characters(codec="utf-8")), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=5), x, max_size=4), max_leaves=12)


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_json_and_cbor_roundtrip(data):
    value = jsontext.from_python(data)
    text = jsontext.compact(value)
    assert text.isascii() and jsontext.parse(text) == value
    assert jsontext.parse(jsontext.pretty(value, 20)) == value
    assert list(jsontext.from_tokens(jsontext.tokens(value))) == [value]
    back = list(cbor.items(cbor.encode(cbor.from_json(value))))
    assert jsontext.to_python(cbor.to_json(back[0])) == data


@settings(max_examples=150, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(st.characters(codec="utf-8")) | st.binary(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(codec="utf-8"), max_size=5), x, max_size=4), max_leaves=12))
def test_msgpack_roundtrip(data):
    def plain(x):
        return {k: plain(v) for k, v in x.items} if isinstance(x, msgpack.Pairs) else [plain(v) for v in x] if isinstance(x, list) else x

    assert plain(next(msgpack.values(msgpack.encode(data)))) == data


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40))
def test_codecs_never_crash(data):
    cbor.validate(data)
    msgpack.validate(data)


@pytest.mark.parametrize(
    ("hexed", "want"),
    [("1bffffffffffffffff", "18446744073709551615"), ("c249010000000000000000", "2(h'010000000000000000')"), ("f93c00", "1.0_1"), ("9f018202039f0405ffff", "[_ 1, [2, 3], [_ 4, 5]]"), ("bf6161f5ff", '{_ "a": true}'), ("5f42010243030405ff", "(_ h'0102', h'030405')"), ("f7", "undefined"), ("f8ff", "simple(255)")],
)
def test_cbor_diagnostic(hexed, want):
    data = bytes.fromhex(hexed)
    item = next(cbor.items(data))
    assert cbor.diagnostic(item) == want and cbor.encode(item) == data


def test_msgpack_timestamps():
    for t, size in ((msgpack.Timestamp(1), 6), (msgpack.Timestamp(1, 5), 10), (msgpack.Timestamp(-1, 5), 15)):
        raw = msgpack.encode(t)
        assert len(raw) == size and next(msgpack.values(raw)) == t
    assert msgpack.validate(b"\xc1") and msgpack.validate(b"\xd7\xff" + b"\xff" * 8)


def test_merge_patch():
    case = lambda a, b, **how: jsontext.compact(jsontext.merge_patch(jsontext.parse(a), jsontext.parse(b), **how))
    assert case('{"a":"b","c":{"d":1,"e":2}}', '{"a":null,"c":{"e":null,"f":{"g":null}}}') == '{"c":{"d":1,"f":{}}}'
    assert case("[1]", '{"a":1}') == '{"a":1}' and case('{"a":1}', "null") == "null"
    assert case("{}", '{"a":null}', keep_nulls=True) == '{"a":null}'


@pytest.mark.parametrize(
    ("text", "want"),
    [("", []), ("\n\n", []), ("a,b", [(1, ["a", "b"])]), ('"",b\r\n', [(1, ["", "b"])]), ('""', [(1, [""])]), ("a\rb,c\n", [(1, ["a\rb", "c"])]), ('"x ""q""\ny",2\nz,', [(1, ['x "q"\ny', "2"]), (3, ["z", ""])]), (",\n", [(1, ["", ""])])],
)
def test_csv_rows(text, want):
    assert list(csv.parse_rows(text)) == want


def test_csv_errors_and_literal_quotes():
    for bad in ('"a"b', '"a', 'a,"b\n'):
        with pytest.raises(csv.CsvError):
            list(csv.parse_rows(bad))
    assert list(csv.parse_rows('"a;b"', ";", True)) == [(1, ['"a', 'b"'])]


def test_deep_documents():
    """Nested documents are walked with stacks; what no walker can take is an error of the text."""
    from docweave.functions import jsontext as J
    from docweave.functions import xmltext as X
    from docweave.plans import jsonpath, steps

    deep = J.Obj([("b", J.Num("1"))])
    for _ in range(3000):
        deep = J.Obj([("a", [deep])])
    assert J.compact(deep).count("[") == 3000 and len(list(J.tokens(deep))) == 3000 * 5 + 4
    assert len(list(steps.below((), deep))) == 3000 * 2 + 2
    nested = J.Num("1")
    for _ in range(2000):
        nested = J.Obj([("a", nested)])
    assert len(steps.select(nested, jsonpath.parse("$..a"))) == 2000
    root = next(X.trees(X.events("<a>" * 2000 + "x" + "</a>" * 2000)))
    assert root.text() == "x" and sum(e[0] == "start" for e in X.tree_events(root)) == 2000
    for text in ('[{"a":1},{"b":[2,"x",null]}]', '{"a":{},"b":[]}', '"s"', "3"):
        assert J.compact(J.parse(text)) == text
