"""XML texts as events and trees.

Events are tuples: ("decl", version, encoding, standalone), ("start", name, attrs, empty), ("end", name),
("text", s), ("cdata", s), ("charref", n), ("entity", name), ("pi", target, s), ("comment", s),
("doctype", name), ("start_doc",), ("end_doc",). An attribute is (name, [texty events]). A text may hold many
roots; each is a document of its own. `<a/>` gives a start and an end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

NAME = r"[A-Za-z_:À-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�\U00010000-\U000EFFFF][-.0-9·̀-ͯ‿-⁀\w:]*"
_NAME, _WS = re.compile(NAME), re.compile(r"[ \t\r\n]*")
_REF = re.compile(rf"&(?:#x([0-9a-fA-F]+)|#([0-9]+)|({NAME}));")
PREDEFINED = {"lt": "<", "gt": ">", "amp": "&", "apos": "'", "quot": '"'}


class XmlError(ValueError):
    """What is wrong, and the number of the production that fails."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"[{rule}] {message}")
        self.rule = rule


#: What XML 1.0 doesn't take as characters (fixed values).
_NO_CHAR = re.compile("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uD800-\\uDFFF\\uFFFE\\uFFFF]")


def _texty(s: str, attribute: bool) -> list[tuple]:
    out, at = [], 0
    if m := _NO_CHAR.search(s):
        raise XmlError("2", f"{ord(m[0])} is no character")
    s = s.replace("\r\n", "\n").replace("\r", "\n")
    if attribute:
        if "<" in s:
            raise XmlError("10", "< in an attribute value")
        s = s.replace("\t", " ").replace("\n", " ")
    for m in _REF.finditer(s):
        if "&" in (plain := s[at : m.start()]):
            raise XmlError("68", "a reference is expected after &")
        if plain:
            out.append(("text", plain))
        if m[3]:
            out.append(("entity", m[3]))
        else:
            n = int(m[1], 16) if m[1] else int(m[2])
            if not (n in (9, 10, 13) or 32 <= n <= 0xD7FF or 0xE000 <= n <= 0xFFFD or 0x10000 <= n <= 0x10FFFF):
                raise XmlError("66", f"{n} is no character")
            out.append(("charref", n))
        at = m.end()
    if "&" in s[at:]:
        raise XmlError("68", "a reference is expected after &")
    if s[at:]:
        out.append(("text", s[at:]))
    return out


def events(text: str, comments: bool = True) -> Iterator[tuple]:
    at, end, stack, seen_root = 0, len(text), [], False
    at += text.startswith("﻿")
    opened = False
    while at < end:
        lt = text.find("<", at)
        chars = text[at : lt if lt >= 0 else end]
        if stack:
            if "]]>" in chars:
                raise XmlError("14", "]]> in character data")
            yield from _texty(chars, False)
        elif chars.strip(" \t\r\n"):
            raise XmlError("22" if not seen_root else "1", "text outside of the root")
        if lt < 0:
            break
        if not opened:
            yield ("start_doc",)
            opened = True
        at = lt
        if text.startswith("<!--", at):
            stop = text.find("-->", at + 4)
            if stop < 0 or "--" in text[at + 4 : stop]:
                raise XmlError("15", "a comment isn't closed")
            if comments:
                yield ("comment", text[at + 4 : stop])
            at = stop + 3
        elif text.startswith("<![CDATA[", at):
            stop = text.find("]]>", at)
            if stop < 0 or not stack:
                raise XmlError("20", "misplaced or unclosed CDATA")
            yield ("cdata", text[at + 9 : stop])
            at = stop + 3
        elif text.startswith("<?", at):
            stop = text.find("?>", at)
            m = _NAME.match(text, at + 2)
            if stop < 0 or not m:
                raise XmlError("16", "a processing instruction isn't closed")
            body = text[m.end() : stop].strip()
            if m[0].lower() == "xml":
                if stack:
                    raise XmlError("17", "xml is no target")
                a = {k: v[0][1] if v else "" for k, v in _attributes(text[m.end() : stop])}
                if "version" not in a:
                    raise XmlError("24", "a version is expected")
                yield ("decl", a["version"], a.get("encoding"), {"yes": True, "no": False}.get(a.get("standalone", "")))
            else:
                yield ("pi", m[0], body)
            at = stop + 2
        elif text.startswith("<!DOCTYPE", at):
            m = _NAME.match(text, _WS.match(text, at + 9).end())
            if not m or stack:
                raise XmlError("28", "misplaced or unnamed DOCTYPE")
            yield ("doctype", m[0])
            stop = text.find(">", at)
            subset = text.find("[", at, stop)
            if subset >= 0:
                stop = re.compile(r"\]\s*>").search(text, subset)
                stop = stop.end() - 1 if stop else -1
            if stop < 0:
                raise XmlError("28", "a DOCTYPE isn't closed")
            at = stop + 1
        elif text.startswith("</", at):
            m = _NAME.match(text, at + 2)
            stop = _WS.match(text, m.end()).end() if m else -1
            if not m or not text.startswith(">", stop):
                raise XmlError("42", "malformed end tag")
            if not stack or stack[-1] != m[0]:
                raise XmlError("GIMatch", f"unexpected closing tag </{m[0]}>")
            stack.pop()
            yield ("end", m[0])
            at = stop + 1
        else:
            m = _NAME.match(text, at + 1)
            stop = _tag_end(text, at)
            if not m or stop < 0:
                raise XmlError("40", "malformed tag")
            empty = text[stop - 1] == "/"
            if not stack and seen_root:
                yield ("end_doc",)
                yield ("start_doc",)
            seen_root = True
            yield ("start", m[0], _attributes(text[m.end() : stop - empty]), empty)
            if empty:
                yield ("end", m[0])
            else:
                stack.append(m[0])
            at = stop + 1
    if stack:
        raise XmlError("1", f"unexpected end of input, <{stack[-1]}> is open")
    if opened:
        yield ("end_doc",)


def _tag_end(text: str, at: int) -> int:
    quote = None
    for m in re.compile(r"[\"'>]").finditer(text, at):
        c = m[0]
        if quote:
            quote = None if c == quote else quote
        elif c == ">":
            return m.start()
        else:
            quote = c
    return -1


def _attributes(s: str) -> list[tuple[str, list[tuple]]]:
    out, at = [], 0
    while True:
        after = _WS.match(s, at).end()
        if after >= len(s):
            return out
        m = _NAME.match(s, after)
        if not m or (after == at and out):
            raise XmlError("40", "an attribute is expected")
        eq = _WS.match(s, m.end()).end()
        if not s.startswith("=", eq):
            raise XmlError("25", "= is expected")
        q = _WS.match(s, eq + 1).end()
        if q >= len(s) or s[q] not in "\"'" or (stop := s.find(s[q], q + 1)) < 0:
            raise XmlError("10", "a quoted value is expected")
        out.append((m[0], _texty(s[q + 1 : stop], True)))
        at = stop + 1


def resolve(stream: Iterator[tuple], entities: dict[str, str] | None = None) -> Iterator[tuple]:
    """Character and entity references as text."""
    known = PREDEFINED | (entities or {})

    def text(e: tuple) -> tuple:
        if e[0] == "charref":
            return ("text", chr(e[1]))
        if e[0] == "entity":
            if e[1] not in known:
                raise XmlError("WFCEntityDeclared", f"entity {e[1]} isn't declared")
            return ("text", known[e[1]])
        return e

    for e in stream:
        yield ("start", e[1], [(n, [text(x) for x in v]) for n, v in e[2]], e[3]) if e[0] == "start" else text(e)


def normalize(stream: Iterator[tuple]) -> Iterator[tuple]:
    """Adjacent texts (not CDATA) as one, in attributes, too."""
    held: str | None = None

    def joined(parts: list[tuple]) -> list[tuple]:
        return list(normalize(iter(parts)))

    for e in stream:
        if e[0] == "text":
            held = (held or "") + e[1]
            continue
        if held is not None:
            yield ("text", held)
            held = None
        yield ("start", e[1], [(n, joined(v)) for n, v in e[2]], e[3]) if e[0] == "start" else e
    if held is not None:
        yield ("text", held)


def namespaces(stream: Iterator[tuple]) -> Iterator[tuple]:
    """Prefixes replaced by {uri}. Unprefixed elements take the default namespace, if one is declared."""
    scopes: list[dict[str, str]] = [{"xml": "http://www.w3.org/XML/1998/namespace", "xmlns": "http://www.w3.org/2000/xmlns/"}]

    def name(n: str, attribute: bool) -> str:
        prefix, _, local = n.rpartition(":")
        if not prefix:
            uri = "" if attribute else scopes[-1].get("", "")
            return f"{{{uri}}}{local}" if uri else local
        if prefix not in scopes[-1]:
            raise XmlError("NSCPrefixDeclared", f"prefix {prefix} isn't declared")
        return f"{{{scopes[-1][prefix]}}}{local}"

    for e in stream:
        if e[0] == "start":
            scope = dict(scopes[-1])
            for n, v in e[2]:
                if n == "xmlns" or n.startswith("xmlns:"):
                    prefix, uri = n[6:], "".join(x[1] for x in v)
                    if prefix and not uri:
                        raise XmlError("NSCNoPrefixUndeclaring", f"prefix {prefix} has no uri")
                    if prefix == "xmlns" or prefix == "xml" and uri != scopes[0]["xml"]:
                        raise XmlError("NSCReservedPrefix", f"prefix {prefix} is reserved")
                    scope[prefix] = uri
            scopes.append(scope)
            attrs = [(n if n == "xmlns" or n.startswith("xmlns:") else name(n, True), v) for n, v in e[2]]
            if len({n for n, _ in attrs}) < len(attrs):
                raise XmlError("NSCAttributesUnique", f"an attribute of {e[1]} stands twice")
            yield ("start", name(e[1], False), attrs, e[3])
        elif e[0] == "end":
            out = name(e[1], False)
            scopes.pop()
            yield ("end", out)
        else:
            yield e


@dataclass
class Element:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    kids: list[Element | str] = field(default_factory=list)

    @property
    def prefix(self) -> str:
        return self.name.rpartition(":")[0]

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            else:
                todo += reversed(k.kids)
        return "".join(out)


def trees(stream: Iterator[tuple]) -> Iterator[Element]:
    """The root element of each document; give it resolved events."""
    stack: list[Element] = []
    for e in stream:
        if e[0] == "start":
            stack.append(Element(e[1], {n: "".join(x[1] for x in v) for n, v in e[2]}))
        elif e[0] == "end":
            done = stack.pop()
            if stack:
                stack[-1].kids.append(done)
            else:
                yield done
        elif e[0] in ("text", "cdata") and stack:
            if stack[-1].kids and isinstance(stack[-1].kids[-1], str):
                stack[-1].kids[-1] += e[1]
            else:
                stack[-1].kids.append(e[1])


def tree_events(root: Element) -> Iterator[tuple]:
    """The inverse of trees()."""
    todo: list[Element | str | tuple] = [root]
    while todo:
        k = todo.pop()
        if isinstance(k, tuple):
            yield k
        elif isinstance(k, str):
            yield ("text", k)
        else:
            yield ("start", k.name, [(n, [("text", v)]) for n, v in k.attrs.items()], not k.kids)
            todo.append(("end", k.name))
            todo += reversed(k.kids)


def _out(e: tuple) -> str:
    match e[0]:
        case "cdata":
            return f"<![CDATA[{e[1]}]]>"
        case "charref":
            return f"&#x{e[1]:04x};"
        case "entity":
            return f"&{e[1]};"
        case "raw":
            return e[1]
        case "text":
            return e[1].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        case "comment":
            return f"<!--{e[1]}-->"
        case "pi":
            return f"<?{e[1]} {e[2]}?>"
        case "doctype":
            return f"<!DOCTYPE {e[1]}>"
        case "decl":
            standalone = "" if e[3] is None else f' standalone="{"yes" if e[3] else "no"}"'
            return f'<?xml version="{e[1]}"' + (f' encoding="{e[2]}"' if e[2] else "") + standalone + "?>"
        case "end":
            return f"</{e[1]}>"
    return ""


def bare(s: str) -> str:
    """A text with references as written, fit to be one: < and an & that starts no reference are escaped."""
    return re.sub(rf"&(?!#x[0-9a-fA-F]+;|#[0-9]+;|{NAME};)", "&amp;", s).replace("<", "&lt;")


def _start(e: tuple, collapse: bool) -> str:
    attrs = "".join(f' {n}="' + "".join(_out(x).replace('"', "&quot;") for x in v) + '"' for n, v in e[2])
    return f"<{e[1]}{attrs}" + ("/>" if collapse and e[3] else ">")


def render(stream: Iterator[tuple], collapse_empty: bool = True) -> str:
    """Text without added white space."""
    out, skip = [], False
    for e in stream:
        if e[0] == "start":
            out.append(_start(e, collapse_empty))
            skip = collapse_empty and e[3]
        elif e[0] == "end" and skip:
            skip = False
        else:
            out.append(_out(e))
    return "".join(out)


def pretty(stream: Iterator[tuple], indent: int = 2, width: int = 60) -> str:
    """An element a line, indented; an element that fits in the width stays on one."""

    def lay(e: Element, level: int) -> list[str]:
        pad, one = " " * (indent * level), render(tree_events(e))
        if not e.kids or len(pad) + len(one) <= width or not any(isinstance(k, Element) for k in e.kids):
            return [pad + one]
        lines = [pad + _start(("start", e.name, [(n, [("text", v)]) for n, v in e.attrs.items()], False), False)]
        for k in e.kids:
            lines += lay(k, level + 1) if isinstance(k, Element) else [" " * (indent * (level + 1)) + _out(("text", k.strip()))] if k.strip() else []
        return [*lines, f"{pad}</{e.name}>"]

    return "\n".join(x for t in trees(resolve(stream)) for x in lay(t, 0))
