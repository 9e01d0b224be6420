"""Operator 4: HTML main-text extraction with gradient-boosted trees over DOM nodes.

A page is read into a tree of elements. Each element has features: own and ancestor tag, words of its id,
class and role attributes that tell content from furniture, depth, text, link and markup densities of its
subtree, position and likeness among siblings. Boosted regression trees (logistic loss, trained here) give
each element the log-odds that its text belongs to the article. Decoding goes from the root down (see decode);
elements that are never article text by the language (nav, form, footer, aside, dialog, menu) are furniture
whatever the trees say; what is decided to be furniture can't hold content, so no descendant contradicts it.

Labels are weak: in a sample of SAMPLE_PAGES pages at most, elements under <article> or <main> are content,
and everything else is not. As one site's mark-up teaches one rule, each sample page is rendered anew in
VARIANTS layouts with other tags, class names and furniture before training.

Defined cases: null, empty and textless html give an empty text; unclosed, misnested and cut-off mark-up is
read as browsers do for blocks (a new block closes an open paragraph); script, style, comments, forms and what
HELD elements hold are never text (one without its end tag holds what comes before the next block); text
outside any element, or in <html> alone, is the body's, which is made if there is none; very long pages are read whole; white space inside a block, <br> included, is one space.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import lean, small_batches

SAMPLE_PAGES, VARIANTS = 300, 2
#: Blocks of a sample page that its random layouts are made of, for training alone.
TRAIN_BLOCKS = 60
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 32
PARENT_WEIGHT = 0.25

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Ordinary mark-up whose text isn't the page's; end tags may be missing.
HELD = frozenset("svg option select button object canvas".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img label".split())
FURNITURE = frozenset("nav footer aside form header menu dialog head".split())
CONTENT = frozenset("article main".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt figure".split())
TAGS = ("div section article main p h1 h2 h3 ul li a nav header footer aside form table td span b blockquote pre figure dialog".split())
GOOD = re.compile(r"article|content|entry|story|post|main|body|text|prose|paragraph|headline|title", re.I)
BAD = re.compile(r"nav|menu|header|footer|side|\bad\b|ads|advert|banner|sponsor|promo|cookie|consent|notice|popup|modal|overlay|newsletter|subscribe|comment|reply|respons|discuss|form|login|search|share|social|related|recommend|breadcrumb|widget|copyright|legal|masthead|toolbar|alert|gdpr|signup|pagination|tags|meta|byline", re.I)
COMMENT = re.compile(r"comment|reply|respons|discuss|disqus|thread", re.I)
AD = re.compile(r"(^|[\s_-])ads?([\s_-]|$)|advert|sponsor|promo|banner", re.I)
NOTICE = re.compile(r"cookie|consent|notice|popup|modal|alert|gdpr|newsletter|subscribe", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    tag: str
    words: str
    parent: int
    depth: int
    place: int = 0
    kids: list[int] = field(default_factory=list)
    chars: int = 0
    linked: int = 0
    nodes: int = 1
    blocks: int = 0
    stops: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, bool]]]:
    """Elements, and the page's text in order: (element, text, whether a new block starts here)."""
    nodes, out, loose = _read(page, frozenset())
    if loose:
        nodes, out, _ = _read(page, loose)
    return nodes, out


def _read(page: str, loose: frozenset[int]) -> tuple[list[Node], list[tuple[int, str, bool]], frozenset[int]]:
    """As parse; and where HELD elements start whose end tag is missing. Those in `loose` end at the next block."""
    nodes, open_, out, at = [Node("#root", "", -1, 0)], [0], [], 0
    tags = ["#root"]  # of open_; inside a HELD element all stand for that one
    live = Counter()  # of tags
    held, missing = [], set()  # open HELD elements: their places in open_ and in the page
    fresh, body = True, 0
    end = len(page)

    def bodied() -> int:
        """The body, for what hangs on the root or on <html>; one is made if the page has none."""
        nonlocal body
        if not body:
            nodes.append(Node("body", "", open_[-1], len(open_), len(nodes[open_[-1]].kids)))
            body = len(nodes) - 1
            nodes[open_[-1]].kids.append(body)
        return body

    def cut(k: int, own: bool = False) -> None:
        live.subtract(tags[k:])
        del open_[k:], tags[k:]
        while held and held[-1][0] >= k:
            level, start = held.pop()
            if not own or level > k:
                missing.add(start)

    while at <= end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        bare = len(open_) == 1 or tags[-1] == "html"
        if text and not held:
            out.append((bodied() if bare and (body or text.strip("\ufeff \t\n\r\f")) else open_[-1], text, fresh))
            fresh = False
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            fresh = True
        if tag == "br" and not held:
            out.append((bodied() if bare else open_[-1], " ", False))
        if m[1]:
            for k in range(len(open_) - 1 if live[tag] > 0 else 0, 0, -1):
                if tags[k] == tag:
                    cut(k, own=True)
                    break
                if tag in INLINE and tags[k] not in INLINE:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in CLOSES_P:
            while held and held[-1][1] in loose:
                cut(held[-1][0])
            for k in range(len(open_) - 1, 0, -1):
                if (t := tags[k]) == "p" or tag == t == "li":
                    cut(k)
                    break
                if t not in INLINE:
                    break
        elif tag == "option" and tags[-1] == tag:
            cut(len(tags) - 1)
        if not held:
            words = ""
            if m[3]:
                words = " ".join((a or b or c) for n, a, b, c in _ATTR.findall(m[3]) if n.lower() in ("class", "id", "role"))
            bare = len(open_) == 1 or tags[-1] == "html"
            parent = bodied() if bare and tag in INLINE else open_[-1]
            nodes.append(Node(tag, words, parent, nodes[parent].depth + 1, len(nodes[parent].kids)))
            nodes[parent].kids.append(len(nodes) - 1)
            if tag == "body":
                body = len(nodes) - 1
        empty = m[3].endswith("/")
        if tag in RAW and not (empty and held and "svg" in tags):
            close = re.compile(f"</{tag}", re.I | re.A).search(page, at)
            at = (page.find(">", close.end()) + 1 or end) if close else end
            if at >= end:
                break
        elif tag not in VOID and not empty:
            open_.append(open_[-1] if held else len(nodes) - 1)
            tags.append(tag)
            live[tag] += 1
            if tag in HELD:
                held.append((len(open_) - 1, m.start()))
    cut(1)
    return nodes, out, frozenset(missing)


def blocks(nodes: list[Node], texts: list[tuple[int, str, bool]]) -> list[tuple[int, str]]:
    """Text blocks in page order, each with the element that holds it: the nearest that isn't inline."""
    out: list[tuple[int, list[str]]] = []
    holder = [0] * len(nodes)
    for i, n in enumerate(nodes):
        holder[i] = holder[n.parent] if n.tag in INLINE and n.parent >= 0 else i
    for node, text, fresh in texts:
        node = holder[node]
        if fresh or not out or out[-1][0] != node:
            out.append((node, []))
        out[-1][1].append(text)
    done = ((n, _SPACE.sub(" ", html.unescape("".join(t))).strip()) for n, t in out)
    return [(n, t) for n, t in done if t]


def features(nodes: list[Node], found: list[tuple[int, str]], texts: list[tuple[int, str, bool]]) -> np.ndarray:
    """A row for each element."""
    link, alike = [-1] * len(nodes), Counter((n.parent, n.tag) for n in nodes)
    for i, n in enumerate(nodes):
        link[i] = i if n.tag == "a" else link[n.parent] if i else -1
    for node, text, _ in texts:
        if link[node] >= 0:
            nodes[link[node]].linked += len(text)
    for node, text in found:
        nodes[node].chars += len(text)
        nodes[node].blocks += 1
        nodes[node].stops += text.count(".") + text.count(",")
    for i in range(len(nodes) - 1, 0, -1):
        n, p = nodes[i], nodes[nodes[i].parent]
        p.chars, p.nodes, p.blocks, p.stops, p.linked = p.chars + n.chars, p.nodes + n.nodes, p.blocks + n.blocks, p.stops + n.stops, p.linked + n.linked
    total = max(1, nodes[0].chars)
    rows = np.zeros((len(nodes), len(TAGS) + 25), np.float32)
    above: list[tuple] = []
    for i, n in enumerate(nodes):
        good, bad, comment, ad, notice = (len(r.findall(n.words)) if n.words else 0 for r in (GOOD, BAD, COMMENT, AD, NOTICE))
        good += n.tag in CONTENT
        bad += n.tag in FURNITURE
        up = above[n.parent] if i else (0, 0, 0, 0, 0, 0)
        here = (up[0] + min(good, 1), up[1] + min(bad, 1), up[2] + min(comment, 1), up[3] + min(ad, 1), up[4] + min(notice, 1), up[5] + (n.tag in CONTENT))
        above.append(here)
        mates = nodes[n.parent].kids if i else [0]
        p = nodes[n.parent] if i else n
        same = alike[n.parent, n.tag]
        rows[i, : len(TAGS)] = [n.tag == t for t in TAGS]
        rows[i, len(TAGS) :] = (
            n.depth, min(good, 3), min(bad, 3), min(comment, 1), min(ad, 1), min(notice, 1), *here, n.chars, n.chars / total, n.chars / n.nodes, n.linked / (n.chars + 1), n.stops / (n.chars + 1),
            n.blocks, n.nodes, n.place, len(mates), same, n.place / len(mates), n.chars / (p.chars + 1), n.tag in FURNITURE,
        )
    return rows


class Boosted:
    """Gradient-boosted regression trees for a yes-or-no label, on features cut into BINS quantiles."""

    def __init__(self) -> None:
        self.base, self.edges, self.trees = 0.0, [], []

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        b, rate = self.bins(x), np.clip((w @ y) / w.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        flat = b + np.arange(b.shape[1]) * BINS
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self._tree(flat, b, w * (y - p), w * p * (1 - p))
            self.trees.append(tree)
            score += leaf
        return self

    def _tree(self, flat, b, g, h):
        """Nodes in heap order: feature (-1 for a leaf), bin, value."""
        size = 2 ** (DEPTH + 1) - 1
        feat, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        where, width = np.zeros(len(g), int), b.shape[1] * BINS
        for node in range(size):
            rows = np.flatnonzero(where == node)
            if not len(rows):
                continue
            sg, sh = g[rows].sum(), h[rows].sum()
            value[node] = RATE * sg / (sh + 1.0)
            if node >= 2**DEPTH - 1 or len(rows) < 20:
                continue
            at = flat[rows].ravel()
            hg = np.bincount(at, np.repeat(g[rows], b.shape[1]), width).reshape(-1, BINS).cumsum(1)
            hh = np.bincount(at, np.repeat(h[rows], b.shape[1]), width).reshape(-1, BINS).cumsum(1)
            gain = hg**2 / (hh + 1) + (sg - hg) ** 2 / (sh - hh + 1) - sg**2 / (sh + 1)
            gain[(hh < 0.5) | (sh - hh < 0.5)] = 0
            j, k = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[j, k] > 1e-3:
                feat[node], cut[node] = j, k
                where[rows] = 2 * node + 1 + (b[rows, j] > k)
        return (feat, cut, value), value[where]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of each row; all trees go down together."""
        feat, cut, value = (np.stack(t) for t in zip(*self.trees))
        out, tree = np.empty(len(x)), np.arange(len(feat))
        for start in range(0, len(x), 2048):
            b = self.bins(x[start : start + 2048])
            rows, at = np.arange(len(b))[:, None], np.zeros((len(b), len(feat)), int)
            for _ in range(DEPTH):
                f = feat[tree, at]
                at = np.where(f < 0, at, 2 * at + 1 + (b[rows, f] > cut[tree, at]))
            out[start : start + 2048] = self.base + value[tree, at].sum(1)
        return out


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Whether each element's own text is article text, from the root down: an element goes by its own log-odds and
    PARENT_WEIGHT of its parent's. Below furniture nothing is content; below content, only a sure refusal counts."""
    state = np.zeros(len(nodes), int)  # 1 content, -1 furniture, 0 open
    both = score + PARENT_WEIGHT * np.clip(score[[max(n.parent, 0) for n in nodes]], -6, 6)
    for i in range(1, len(nodes)):
        n = nodes[i]
        up = state[n.parent]
        if up < 0 or n.tag in ("nav", "form", "footer", "aside", "dialog", "menu") or n.tag in RAW or n.tag in HELD:
            state[i] = -1
        elif up > 0:
            state[i] = -1 if score[i] < -2.0 and n.tag not in INLINE else 1
        elif both[i] > 0:
            state[i] = 1
    return state > 0


def extract_all(pages: list[str | None], model: Boosted) -> list[str]:
    """Article texts of some pages."""
    read, rows = [], []
    for page in pages:
        nodes, texts = parse(page or "")
        found = blocks(nodes, texts)
        read.append((nodes, found))
        if found:
            rows.append(features(nodes, found, texts))
    score, at, out = model.log_odds(np.concatenate(rows)) if rows else np.zeros(0), 0, []
    for nodes, found in read:
        if not found:
            out.append("")
            continue
        keep = decode(nodes, score[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n".join([t for n, t in found if keep[n]]))
    return out


def extract(page: str | None, model: Boosted) -> str:
    return extract_all([page], model)[0]


_WRAPS = [
    ('<article class="post">', "</article>"), ("<main>", "</main>"), ('<div class="article-body">', "</div>"), ('<div id="content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story">', "</section>"),
    ('<div class="post-content"><div class="text">', "</div></div>"), ("<main><article>", "</article></main>"), ('<div role="main">', "</div>"), ("<article>", "</article>"), ('<div class="main-content"><section>', "</section></div>"), ("<div><div><div>", "</div></div></div>"),
]
_MENUS = ["<nav><ul>{li}</ul></nav>", '<div class="menu"><ul>{li}</ul></div>', '<ul class="navigation">{li}</ul>', '<div id="nav">{a}</div>', '<header class="site-header"><a href="/">{t}</a><nav>{a}</nav></header>', '<div class="breadcrumbs">{a}</div>', '<div class="top-bar">{a}</div>']
_BOXES = [
    '<div class="ad">{t}</div>', '<div class="advert"><p>{t}</p></div>', '<div class="sponsored">{t}</div>', '<aside><h3>{t}</h3><ul>{li}</ul></aside>', '<div class="sidebar"><h3>{t}</h3><p>{u}</p></div>', '<div class="cookie-notice"><p>{t}</p></div>',
    '<div id="cookie-banner">{u}</div>', '<form action="/s"><label>{t}</label><input name="q"></form>', '<div class="newsletter"><p>{t}</p><form><input></form></div>', '<div class="related"><h3>{t}</h3><ul>{li}</ul></div>', '<div class="share">{a}</div>', '<div class="promo"><p>{u}</p></div>', '<div class="notice">{t}</div>', '<div class="widget"><p>{u}</p></div>',
]
_TALK = ['<div class="comments"><h3>{t}</h3><div class="comment"><p>{u}</p></div><div class="comment"><p>{t}</p></div></div>', '<section id="comments"><ol><li><b>{t}</b><p>{u}</p></li><li><p>{t}</p></li></ol></section>', '<ul class="comment-list"><li class="comment">{u}</li></ul>', '<div id="discussion"><div class="reply"><p>{u}</p></div></div>']
_FEET = ["<footer><p>{t}</p></footer>", '<div class="footer">{t} {a}</div>', '<div id="footer"><p>&copy; {t}</p></div>', '<footer class="site-footer">{a}<p>{u}</p></footer>']


def variant(lines: list[str], rng: random.Random) -> str:
    """A page of these text blocks in a layout drawn at random; article text stands in elements marked data-a."""
    short = lambda: html.escape(" ".join(rng.choice(lines).split()[: rng.randint(2, 14)]))
    long = lambda: html.escape(rng.choice(lines))
    fill = lambda s: s.format(t=short(), u=long(), li="".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(rng.randint(2, 7))), a="".join(f'<a href="/y">{short()}</a> ' for _ in range(rng.randint(2, 5))))
    start, stop = rng.choice(_WRAPS)
    inner = [f"<h1>{html.escape(lines[0])}</h1>"] if rng.random() < 0.8 else []
    for line in lines:
        tag = rng.choice(["p", "p", "p", "p", "div", "blockquote", "h2", "li"])
        text = html.escape(line)
        if rng.random() < 0.15:
            text = f"<b>{text}</b>"
        inner.append({"li": f"<ul><li>{text}</li></ul>"}.get(tag, f"<{tag}>{text}</{tag}>"))
        if rng.random() < 0.06:
            inner.append("\x00" + fill(rng.choice(_BOXES)) + "\x01")
    head = [fill(rng.choice(_MENUS))] + [fill(rng.choice(_BOXES)) for _ in range(rng.randint(0, 2))]
    tail = [fill(rng.choice(_BOXES)) for _ in range(rng.randint(0, 2))] + ([fill(rng.choice(_TALK))] if rng.random() < 0.6 else []) + [fill(rng.choice(_FEET))]
    if rng.random() < 0.3:
        inner.append("\x00" + fill(rng.choice(_TALK)) + "\x01")
    body = "".join(head) + start + "<!--a-->" + "".join(inner).replace("\x00", "<!--b-->").replace("\x01", "<!--a-->") + "<!--b-->" + stop + "".join(tail)
    return f'<html><head><title>{short()}</title></head><body>{"<div id=page>" if rng.random() < 0.5 else ""}{body}</body></html>'


def labelled(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a variant's elements: those between the marks <!--a--> and <!--b--> are content, and
    so is what holds nothing but them."""
    marked = page.replace("<!--a-->", "<mark-a></mark-a>").replace("<!--b-->", "<mark-b></mark-b>")
    nodes, _ = parse(marked)
    inside, on = [], False
    for n in nodes:
        on = True if n.tag == "mark-a" else False if n.tag == "mark-b" else on
        inside.append(on)
    label = [float(x) for x, n in zip(inside, nodes) if n.tag not in ("mark-a", "mark-b")]
    clean, texts = parse(page.replace("<!--a-->", "").replace("<!--b-->", ""))
    found = blocks(clean, texts)
    x = features(clean, found, texts)
    y = np.array(label[: len(clean)], np.float64)
    return x, y


def train(pages: list[str], seed: int = 7) -> Boosted:
    """Trees fitted on VARIANTS layouts of each page, whose blocks under <article> or <main> are the article."""
    rng = random.Random(seed)
    xs, ys = [], []
    for page in pages:
        nodes, texts = parse(page)
        own = [t for n, t in blocks(nodes, texts) if _under(nodes, n)][:TRAIN_BLOCKS]
        for _ in range(VARIANTS if own else 0):
            x, y = labelled(variant(own, rng))
            xs.append(x), ys.append(y)
        if own:
            found = blocks(nodes, texts)
            x = features(nodes, found, texts)
            xs.append(x), ys.append(np.array([float(_under(nodes, i)) for i in range(len(nodes))]))
    if not xs:
        for k in range(40):  # no page to learn layouts' text from: plain filler
            x, y = labelled(variant([" ".join(f"word{i}" for i in range(j, j + 12)) + "." for j in range(k, k + 8)], rng))
            xs.append(x), ys.append(y)
    x, y = np.concatenate(xs), np.concatenate(ys)
    return Boosted().fit(x, y, np.concatenate([np.full(len(v), 1 / np.sqrt(len(v))) for v in ys]))


def _under(nodes: list[Node], i: int) -> bool:
    while i >= 0:
        if nodes[i].tag in CONTENT:
            return True
        i = nodes[i].parent
    return False


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Boosted:
    """The model of a sample: the pages whose ids hash least, SAMPLE_PAGES at most, each up to 200,000 characters."""
    page, key = F.col(f"`{id_col}`"), F.col(f"`{html_col}`").cast("string")
    rows = pages.where(F.length(key).between(1, 200_000)).select(page.cast("long").alias("id"), key.alias("html"), F.xxhash64(page).alias("h"), F.xxhash64(key).alias("k"))
    chosen = rows.select("id", "h", "k").orderBy("h", "id", "k").limit(sample).collect()
    if not chosen:
        return train([])
    known = F.broadcast(pages.sparkSession.createDataFrame(chosen, "id bigint, h bigint, k bigint").distinct().withColumnRenamed("id", "i"))
    # of rows repeated whole, one
    got = rows.join(known, ["h", "k"]).where(F.col("id").eqNullSafe(F.col("i"))).groupBy("h", "id", "k").agg(F.first("html").alias("html")).orderBy("h", "id", "k")
    return train([r["html"] for r in got.collect()])


def extract_text(pages: DataFrame, model: Boosted, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row; no shuffle."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(model)  # TREES trees of 31 nodes, whatever the input

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = []
            for start in range(0, batch.num_rows, 50):
                text += extract_all(batch.column(2).slice(start, 50).to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
