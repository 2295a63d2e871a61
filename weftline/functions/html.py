"""HTML scalars: a small tolerant tree, extraction of text and links, Markdown.

The tree is built from the standard library's tokenizer: void elements never open, a new paragraph
closes an open one, list items and table cells close their like, and end tags close what they match.
Formatting elements left open are not reopened in the next block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StringType

from .charset import decode
from .url import absolute

#: Elements that are page furniture, mount points of script applications, elements
#: dropped from Markdown, places where a document's body usually is, inline elements.
FURNITURE = "script style noscript template svg nav header footer aside form".split()
DROPPED = "script style noscript template svg iframe form button nav header footer aside".split()
INLINE = frozenset("a strong b em i code span small sub sup img br abbr cite mark u s time label kbd samp var q wbr font".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
_SKIP = re.compile(r"^(mailto:|javascript:|tel:|data:|#)", re.I)


class Node:
    """An element; children are nodes and strings."""

    __slots__ = ("tag", "attrs", "children", "source")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None, source: str = ""):
        self.tag, self.attrs, self.children, self.source = tag, attrs or {}, [], source

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self, without: frozenset[str] | set[str] = frozenset()):
        stack: list = [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif n.tag not in without:
                stack += reversed(n.children)

    def text(self, without=frozenset()) -> str:
        return " ".join(" ".join(self.strings(without)).split())

    def first(self, *tags: str) -> "Node | None":
        return next((n for n in self.walk() if n.tag in tags), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCK:
            self._close_to({"p"}, _BLOCK - {"p"} | {"#root", "body", "html", "td", "th", "li"})
        if tag in _CLOSES:
            self._close_to(*_CLOSES[tag])
        node = Node(tag, dict(attrs), self.get_starttag_text() or "")
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def _close_to(self, close: set[str], stop) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in close:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _is_mount(n: Node) -> bool:
    a = n.attrs
    return a.get("id") in ("app", "root", "__next", "___gatsby") or "data-reactroot" in a or n.tag == "app-root" or "ng-app" in a or "data-vue-root" in a


def extract(html: str, url: str) -> dict:
    """Title, links, canonical address, text with and without furniture, and script signals."""
    root = tree(html)
    nodes = list(root.walk())
    base = url
    for n in nodes:
        if n.tag == "base" and n.attrs.get("href"):
            base = urljoin(url, n.attrs["href"])
            break
    links: dict[str, None] = {}
    mark = None
    for n in nodes:
        href = (n.attrs.get("href") or "").strip()
        if n.tag == "a" and href and not _SKIP.match(href):
            if (to := absolute(href, base)) is not None:
                links.setdefault(to)
        elif n.tag == "link" and mark is None and n.attrs.get("rel") == "canonical" and "href" in n.attrs:
            mark = n
    title, body = root.first("title"), root.first("body")
    return {
        "title": title.text() if title else "",
        "links": list(links),
        "canonical": absolute(mark.attrs.get("href") or "", base) if mark else None,
        "text": body.text() if body else "",
        "main_text": body.text(set(FURNITURE)) if body else "",
        "script_bytes": sum(len(n.source) + len("".join(n.strings())) + len("</script>") for n in nodes if n.tag == "script"),
        "empty_app_root": any(_is_mount(n) and not n.text() and n.first("a") is None for n in nodes),
        "noscript_hint": any(n.tag == "noscript" and "javascript" in n.text().lower() for n in nodes),
    }


# -- Markdown ------------------------------------------------------------------

_WIDE = re.compile(r"[ \t]+")


def _flat(t: str) -> str:
    return _WIDE.sub(" ", t.replace("\xa0", " "))


class _Markdown:
    """Walks a document and writes blocks; an unknown element is a container."""

    def __init__(self, base: str):
        self.base = base

    def inside(self, n: Node) -> str:
        return "".join(self.inline(c) for c in n.children)

    def inline(self, c) -> str:
        if isinstance(c, str):
            return _flat(c)
        if c.tag in DROPPED:
            return ""
        if c.tag == "br":
            return "  \n"
        if c.tag == "img":
            src = (c.attrs.get("src") or "").strip()
            return f"![{(c.attrs.get('alt') or '').strip()}]({urljoin(self.base, src)})" if src else ""
        body = self.inside(c)
        for tags, mark in ((("strong", "b"), "**"), (("em", "i"), "*"), (("code",), "`")):
            if c.tag in tags:
                return f"{mark}{body.strip()}{mark}" if body.strip() else ""
        if c.tag == "a":
            href = (c.attrs.get("href") or "").strip()
            body = body.strip()
            return f"[{body}]({urljoin(self.base, href)})" if body and href and not href.startswith(("javascript:", "#")) else body
        return body

    def block(self, n: Node, depth: int = 0) -> str:
        if n.tag in DROPPED:
            return ""
        if n.tag == "hr":
            return "\n---\n"
        if re.fullmatch("h[1-6]", n.tag):
            t = self.inside(n).strip()
            return f"\n{'#' * int(n.tag[1])} {t}\n" if t else ""
        if n.tag == "pre":
            t = "".join(n.strings()).strip()
            return f"\n```\n{t}\n```\n" if t else ""
        if n.tag == "blockquote":
            t = self.flow(n, depth).strip()
            return "\n" + "\n".join(f"> {x}" for x in t.splitlines()) + "\n" if t else ""
        if n.tag in ("ul", "ol"):
            return self.items(n, depth)
        if n.tag == "table":
            return self.table(n)
        if n.tag in INLINE:
            return self.inside(n)
        t = self.flow(n, depth).strip()
        return f"\n{t}\n" if t else ""

    def flow(self, n: Node, depth: int) -> str:
        out = []
        for c in n.children:
            if isinstance(c, str):
                if c.strip():
                    out.append(_flat(c))
            else:
                out.append(self.inline(c) if c.tag in INLINE else self.block(c, depth))
        return "".join(out)

    def items(self, n: Node, depth: int) -> str:
        out = []
        for k, li in enumerate((c for c in n.children if isinstance(c, Node) and c.tag == "li"), 1):
            words, below = [], []
            for c in li.children:
                if isinstance(c, Node) and c.tag in ("ul", "ol"):
                    below.append(self.block(c, depth + 1).strip("\n"))
                elif isinstance(c, str) or c.tag in INLINE:
                    words.append(self.inline(c))
                else:
                    words.append(self.block(c, depth).strip() + " ")
            body = "\n".join([" ".join("".join(words).split()), *(b for b in below if b)])
            if body:
                out.append("  " * depth + (f"{k}. " if n.tag == "ol" else "- ") + body)
        return "\n" + "\n".join(out) + "\n" if out else ""

    def table(self, n: Node) -> str:
        rows = []
        for tr in n.walk():
            if tr.tag == "tr":
                cells = [self.inside(c).strip().replace("|", "\\|") for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
                if cells:
                    rows.append(cells)
        if not rows:
            return ""
        width = max(map(len, rows))
        line = lambda r: "| " + " | ".join(r + [""] * (width - len(r))) + " |"
        return "\n" + "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) + "\n"


def _body(root: Node) -> Node:
    """The document: the first usual place with more than 200 characters, else the body."""
    classes = lambda n: (n.attrs.get("class") or "").split()
    tests = (
        lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main",
        lambda n: n.attrs.get("id") == "content", lambda n: n.attrs.get("id") == "main",
        lambda n: "post-content" in classes(n), lambda n: "entry-content" in classes(n), lambda n: "article-body" in classes(n),
    )
    nodes = list(root.walk())
    for test in tests:
        n = next((x for x in nodes if test(x)), None)
        if n is not None and len("".join(s.strip() for s in n.strings(set(DROPPED)))) > 200:
            return n
    return root.first("body") or root


def markdown(html: str, url: str) -> str:
    """The document of a page as Markdown; furniture is left out, links are absolute."""
    out = _Markdown(url).block(_body(tree(html)))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


# -- columns -------------------------------------------------------------------

EXTRACTED = pa.struct([
    ("title", pa.string()), ("links", pa.list_(pa.string())), ("canonical", pa.string()), ("text", pa.string()), ("main_text", pa.string()),
    ("script_bytes", pa.int32()), ("empty_app_root", pa.bool_()), ("noscript_hint", pa.bool_()), ("encoding", pa.string()), ("encoding_source", pa.string()),
])


@arrow_udf(from_arrow_type(EXTRACTED))
def extracted(body: pa.Array, url: pa.Array, content_type: pa.Array) -> pa.Array:
    """All of a page from its bytes, parsed once; null for a null body."""
    out = []
    for b, u, c in zip(body.to_pylist(), url.to_pylist(), content_type.to_pylist()):
        if b is None:
            out.append(None)
            continue
        text, name, source = decode(b, c)
        out.append(extract(text, u or "") | {"encoding": name, "encoding_source": source})
    return pa.array(out, EXTRACTED)


@arrow_udf(StringType())
def to_markdown(body: pa.Array, url: pa.Array, content_type: pa.Array) -> pa.Array:
    return pa.array(
        [None if b is None else markdown(decode(b, c)[0], u or "") for b, u, c in zip(body.to_pylist(), url.to_pylist(), content_type.to_pylist())], pa.string()
    )
