"""Operator 3: main text of web pages by site style trees.

The pages of one host are merged into a style tree: an element node is a path of block
elements (tag, id and classes) of that host; for each node the pages that have it, the
pages that show each presentation style of it (its row of children) and the pages that
show each content feature of it (the text of a leaf) are counted.  A page's branch then has

* presentation importance: the surprisal of its style, log base m of m / pages (m: pages
  with the node), whose mean over the pages is the style entropy;
* content importance of a leaf: 1 - the mean over its features of log pages / log m;
* composite importance: (1 - g^l) presentation + g^l mean of its l children, g = 0.9.

Branches go if they and all their descendants are under ``LEAST``.  Pages of one host with
equal trees are copies, counted once, and are extracted each.  A host with few pages says little, and copies of an article
on one host say the wrong thing, so elements speak first: navigation, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles and comments go by tag, role,
id or class (words of ids and classes alone remove no main element, nor, where no article or
main element lies elsewhere, an article or most of the page's text outside links); where a page has article (else main) elements the text is what they hold,
and inside them only branches that are both unimportant and mostly links go.

The counts are packed questions (see ``packed``): one entry a block and key however many
pages of the block share a host.  Null html is empty and gives '' ; null urls are one host.
Broken markup is read as browsers would:
paragraphs, list items, rows and cells end where the next begins, and all ends at the end.
Reading takes time in proportion to the page, however deep it is nested.  Repeated rows get a row
each, an empty table gives none, a very long page is a block of its own, and columns other than
page_id, url and html are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quillframe.llm.common import U64
from quillframe.llm.packed import Distinct, answer, ask, bits, cut, meet, pack, parse, partitions, unbits

LEAST, DECAY = 0.4, 0.9

# Fixed values of HTML: elements by kind.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math", "select", "object", "audio", "video", "canvas", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: An open element of the second set ends where one of the first begins, unless one of the third is in between.
ENDS = [
    ({"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul"}, {"p"}, {"button", "td", "th", "caption"}),
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"tr", "tbody", "thead", "tfoot"}, {"tr"}, {"table"}),
    ({"td", "th", "tr", "tbody", "tfoot"}, {"td", "th"}, {"table"}),
    ({"option"}, {"option"}, {"select"}),
    ({"h1", "h2", "h3", "h4", "h5", "h6"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"div", "section", "article"}),
]
NOISE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
NOISE_WORD = re.compile(
    r"(ad|ads|adv|advert\w*|adbox|adslot|banner\w*|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice\w*|notification\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|sidebar\w*|"
    r"widget\w*|menu\w*|nav|navbar|navigation|breadcrumb\w*|comment\w*|respond|repl(y|ies)|discussion|disqus|footer\w*|masthead|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|"
    r"toolbar|disclaimer|alert\w*|login|skip|copyright)"
)
NOISE_OUTSIDE = re.compile(r"(header|side|search|toc|top|topbar|bottom|legal|meta)")

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_BREAK = re.compile(r"([a-z0-9])([A-Z])")


class Node:
    __slots__ = ("tag", "name", "noise", "main", "children", "links", "size", "key", "word")

    def __init__(self, tag: str, name: str, noise: int, main: bool):
        self.tag, self.name, self.noise, self.main = tag, name, noise, main
        self.children: list = []  # nodes, and (text, characters inside links)
        self.key = 0
        self.word = False  # noise by words of its id or class alone


def _attributes(tag: str, raw: str) -> tuple[str, int, bool, bool]:
    """Name in the style tree; 2: noise, 1: noise outside an article; whether it holds the main text; whether words alone make it noise."""
    sure = 2 if tag in NOISE_TAGS else 1 if tag == "header" else 0
    noise, main, name = sure, False, tag
    if raw and not raw.isspace():
        for key, value in _ATTR.findall(raw):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                name += ("." if key == "class" else "#") + value
                if tag not in ("body", "html", "article", "main"):
                    words = _SPLIT.split(_BREAK.sub(r"\1 \2", value).lower())
                    if any(NOISE_WORD.fullmatch(w) for w in words):
                        noise = 2
                    elif any(NOISE_OUTSIDE.fullmatch(w) for w in words):
                        noise = max(noise, 1)
                elif tag == "article" and re.search(r"comment|repl(y|ies)\b", value, re.I):
                    noise = sure = 2
            elif key == "role":
                main |= value == "main"
                noise, sure = (2, 2) if value in NOISE_ROLES else (noise, sure)
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                noise = sure = 2
    return name, noise, main, noise > sure


class Page:
    """Block tree of one page."""

    def __init__(self, source: str):
        self.root, self.mark = Node("html", "html", 0, False), 0
        stack = [self.root]
        places: dict[str, list[int]] = {}  # of each tag: where it is open in the stack
        text: list[str] = []
        linked = anchors = 0  # characters inside links of this block; links open
        at, n = 0, len(source)

        def top(tags) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=0)

        def flush() -> None:
            nonlocal linked
            if text:
                block = " ".join("".join(text).split())
                if block:
                    stack[-1].children.append((block, linked))
                text.clear()
            linked = 0

        def add(raw: str) -> None:
            nonlocal linked
            if raw:
                raw = html_lib.unescape(raw) if "&" in raw else raw
                text.append(raw)
                if anchors:
                    linked += len(raw.strip())

        def close(upto: int) -> None:
            nonlocal anchors
            flush()
            for node in stack[upto:]:
                places[node.tag].pop()
            del stack[upto:]
            anchors = 0

        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in INLINE:
                    if tag == "a" and anchors:
                        anchors -= 1
                    continue
                if k := top((tag,)):
                    close(k)
                elif tag == "p":
                    flush()
                continue
            if tag in RAW and not m[3].endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                text.append(" ")
                at = end.end() if end else n
                continue
            if tag in INLINE:
                if tag in ("br", "wbr", "img"):
                    text.append(" " if tag == "br" else "")
                elif tag == "a":
                    anchors += 1
                continue
            if tag in ("html", "body", "head"):
                flush()
                continue
            for starts, closed, fence in ENDS:
                if tag in starts and (k := top(closed)) > top(fence):
                    close(k)
            flush()
            if tag in VOID:
                continue
            name, noise, main, word = _attributes(tag, m[3])
            node = Node(tag, name, noise, main)
            node.word = word
            stack[-1].children.append(node)
            anchors = 0
            if not m[3].endswith("/"):
                places.setdefault(tag, []).append(len(stack))
                stack.append(node)
        flush()

    def keys(self, host: int) -> list[int]:
        """Hashes of the page's nodes, their styles and their features; sets node.key and mark, which copies share."""
        out: list[int] = []

        def walk(node: Node, path: int) -> None:
            node.key = key = xxhash.xxh64_intdigest(node.name, path)
            out.append(key)
            names = []
            for c in node.children:
                name = c.name if c.__class__ is Node else "text"
                if not names or names[-1] != name:
                    names.append(name)
                if c.__class__ is not Node:
                    out.append(_feature(key, c[0]))
            out.append(_style(key, names))
            for c in node.children:
                if c.__class__ is Node:
                    walk(c, key)

        def whole() -> None:
            out.clear()  # of a walk that ran out of room
            walk(self.root, host)

        _deep(whole)
        self.mark = xxhash.xxh64_intdigest(np.array(out, U64).tobytes())
        return out

    def _clear(self) -> None:
        """Words of ids and classes give way where they would remove the main text."""
        held: list[tuple[Node, int, bool, bool]] = []  # noise by words: text outside links, holds a main element, an article

        def walk(node: Node, outside: bool) -> tuple[int, bool, bool, bool]:
            """The same of any node, and whether it holds an article or main element that no words remove."""
            outside = outside and not (node.word and node.noise == 2)
            main, article = node.tag == "main" or node.main, node.tag == "article"
            size, free = 0, (article or main) and outside
            for c in node.children:
                if c.__class__ is not Node:
                    size += max(0, len(c[0]) - c[1])
                elif c.noise < 2 or c.word:
                    a, b, d, e = walk(c, outside)
                    size, main, article, free = size + a, main or b, article or d, free or e
            if node.word:
                held.append((node, size, main, article))
            return size, main, article, free

        size, _, _, free = walk(self.root, True)
        for node, own, main, article in held:
            if main or ((article or 2 * own > size) and not free):
                node.noise, node.word = 0, False

    def text(self, seen) -> str:
        """seen(key): pages of the host that have a node, style or feature."""
        importance: dict[int, float] = {}
        best: dict[int, float] = {}  # the most important of a node and its descendants

        def weigh(node: Node) -> float:
            m = seen(node.key)
            base = math.log(m) if m > 1 else 0.0
            names, parts = [], []
            for c in node.children:
                is_node = c.__class__ is Node
                name = c.name if is_node else "text"
                if not names or names[-1] != name:
                    names.append(name)
                parts.append(weigh(c) if is_node else 1.0 if not base else 1 - min(1.0, math.log(max(1, seen(_feature(node.key, c[0])))) / base))
            look = 1.0 if not base else 1 - min(1.0, math.log(max(1, seen(_style(node.key, names)))) / base)
            inner = sum(parts) / len(parts) if parts else 0.0
            own = inner if not any(c.__class__ is Node for c in node.children) else (1 - DECAY ** len(parts)) * look + DECAY ** len(parts) * inner
            importance[id(node)] = own
            best[id(node)] = max(own, *(best.setdefault(id(c), w) for c, w in zip(node.children, parts, strict=True)), 0.0)
            return own

        _deep(weigh, self.root)
        _deep(self._clear)
        found: list[Node] = []

        def seek(node: Node, wanted) -> None:
            if node.noise == 2:
                return
            if wanted(node):
                found.append(node)
                return
            for c in node.children:
                if c.__class__ is Node:
                    seek(c, wanted)

        _deep(seek, self.root, lambda x: x.tag == "article")
        if not found:
            _deep(seek, self.root, lambda x: x.tag == "main" or x.main)
        inside = bool(found)
        blocks: list[str] = []

        def measure(node: Node) -> tuple[int, int]:
            size = links = 0
            for c in node.children:
                a, b = measure(c) if c.__class__ is Node else (len(c[0]), c[1])
                size, links = size + a, links + b
            node.size, node.links = size, links
            return size, links

        def take(node: Node) -> None:
            for c in node.children:
                if c.__class__ is not Node:
                    if inside or node is self.root or max(importance[id(node)], best[id(c)]) >= LEAST:
                        blocks.append(c[0])
                    continue
                if c.noise == 2 or (c.noise == 1 and not inside):
                    continue
                low, linked = best[id(c)] < LEAST, c.links > 0.5 * max(1, c.size)
                if (low and linked) or (not inside and (low or c.links > 0.8 * max(1, c.size))):
                    continue
                take(c)

        for root in found or [self.root]:
            _deep(measure, root)
            _deep(take, root)
        return "\n".join(blocks)


def _deep(f, *args):
    """Call f with room for markup nested thousands of levels deep."""
    import sys
    import threading

    limit = sys.getrecursionlimit()
    try:
        return f(*args)
    except RecursionError:
        pass
    out: list = []
    sys.setrecursionlimit(1_000_000)
    old = threading.stack_size(256 << 20)
    try:
        worker = threading.Thread(target=lambda: out.append(f(*args)))
        worker.start()
        worker.join()
    finally:
        threading.stack_size(old)
        sys.setrecursionlimit(limit)
    return out[0]


def _feature(key: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, key ^ 0x5EED)


def _style(key: int, names: list[str]) -> int:
    return xxhash.xxh64_intdigest("|".join(names), key ^ 0x57A1)


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages(page_id, url, html)."""
    table = pack(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").alias("text")), "style-pages")
    parts = partitions(table)

    def read(batch):
        for url, source in zip(batch.column("url").to_pylist(), batch.column("text").to_pylist(), strict=True):
            yield Page(source or ""), xxhash.xxh64_intdigest(host_of(url))

    def all_keys(batch) -> tuple[list[Page], Distinct, np.ndarray]:
        out, keys = [], []
        for page, host in read(batch):
            keys.append(np.fromiter(set(page.keys(host)), U64))
            out.append(page)
        return out, Distinct(np.concatenate(keys or [np.zeros(0, U64)])), np.array([len(k) for k in keys], np.int64)

    def marks(batch, _):
        pages = list(read(batch))
        for page, host in pages:
            page.keys(host)
        m = Distinct(np.array([page.mark for page, _ in pages], U64))
        ends = cut(m.values, parts)
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            yield p, m.values[ends[p] : ends[p + 1]].tobytes()

    def elect(bodies):
        """One block of those that have a page is told to count it."""
        sizes = [len(x) // 8 for x in bodies]
        m = Distinct(np.concatenate([np.frombuffer(x, U64) for x in bodies]))
        counts = np.zeros(sum(sizes), bool)
        counts[m.order[m.at]] = True
        ends = np.cumsum([0, *sizes])
        return [bits(counts[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]

    def merge(batch, answers):
        pages, d, size = all_keys(batch)
        m = Distinct(np.array([page.mark for page in pages], U64))
        ends = cut(m.values, parts)
        counts = np.zeros(len(pages), np.int64)
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            a, z = ends[p], ends[p + 1]
            counts[m.order[m.at[a:z]]] = unbits(answers[p], int(z - a))
        seen = np.add.reduceat(np.repeat(counts, size)[d.order], d.at) if len(d.at) else d.at
        ends = cut(d.values, parts)
        for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            a, z = ends[p], ends[p + 1]
            yield p, d.values[a:z].tobytes() + seen[a:z].astype("<u4").tobytes()

    def count(bodies):
        sizes = [len(x) // 12 for x in bodies]
        d = Distinct(np.concatenate([np.frombuffer(x, U64, n) for n, x in zip(sizes, bodies, strict=True)]))
        pages = np.concatenate([np.frombuffer(x, "<u4", n, 8 * n) for n, x in zip(sizes, bodies, strict=True)]).astype(np.int64)
        total = d.spread(np.add.reduceat(pages[d.order], d.at)).astype("<i8")
        ends = np.cumsum([0, *sizes])
        return [total[a:z].tobytes() for a, z in zip(ends[:-1], ends[1:], strict=True)]

    counted = answer(ask(table, marks, parts, of=lambda batch: batch), elect, parts, "style-copies")
    seen = answer(ask((table, counted), merge, parts, of=lambda batch: batch), count, parts, "style-trees")

    def run(groups):
        for _, body, answers in groups:
            batch = parse(body)
            pages, d, _ = all_keys(batch)
            ends = cut(d.values, parts)
            counts = np.concatenate([np.frombuffer(answers[p], "<i8") for p in np.flatnonzero(ends[1:] > ends[:-1]).tolist()] or [np.zeros(0, np.int64)])
            known = dict(zip(d.values.tolist(), counts.tolist(), strict=True))
            texts = [page.text(lambda k: known.get(k, 1)) for page in pages]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return meet(table, seen, run, "page_id long, url string, text string, n_chars long")
