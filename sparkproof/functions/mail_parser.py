"""One pass over mail HTML: the facts that need element nesting. Everything else stays in Spark."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINK = T.StructType(
    [
        T.StructField("href", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("in_mso", T.BooleanType()),
    ]
)
IMAGE = T.StructType(
    [
        T.StructField("src", T.StringType()),
        T.StructField("alt", T.StringType()),
        T.StructField("width", T.StringType()),
        T.StructField("height", T.StringType()),
        T.StructField("style", T.StringType()),
    ]
)
RAW_FACTS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("html_lang", T.StringType()),
        T.StructField("preheader", T.StringType()),
        T.StructField("links", T.ArrayType(LINK)),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("unsub_context", T.BooleanType()),
    ]
)
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "li", "td"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
# Start tags that end an open paragraph (HTML standard).
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div",
            "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
            "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
# Start tag -> open tags it ends, and the ancestors at which the search stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "a": ({"a"}, {"td", "th", "table"}),
}
#: Mails of an Arrow batch that are Python objects at once.
SLICE_ROWS = 64
ZERO_WIDTH = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad\u200e\u200f]")
SPACE = re.compile("[\\s\ufeff]+")
HIDDEN = re.compile(r"display\s*:\s*none|max-height\s*:\s*0|font-size\s*:\s*[01]px")
REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)(;?)")
MSO = re.compile(r"<!--\[if[^\]]*mso[^\]]*\]>(.*?)<!\[endif\]-->", re.I | re.S)


def clean(text: str) -> str:
    return SPACE.sub(" ", ZERO_WIDTH.sub("", text)).strip()


def unmarked(text: str) -> str:
    return text


def mark_bare(html: str):
    """The HTML with another character for each & that starts no whole reference (`&amp` without its semicolon,
    unknown names), and the function that takes this back."""

    def kept(m):
        whole = m[2] and (m[1][0] == "#" or m[1] + ";" in html5)
        return m[0] if whole else mark + m[0][1:]

    mark = next(c for c in map(chr, range(0xF0000, 0xFFFFE)) if c not in html)
    marked = REFERENCE.sub(kept, html)
    return (marked, lambda text: text.replace(mark, "&")) if mark in marked else (html, unmarked)


class _Node:
    __slots__ = ("tag", "attrs", "start", "end", "rstart", "rend", "has_block", "parent")

    def __init__(self, tag, attrs, start, rstart, parent):
        self.tag, self.attrs, self.start, self.rstart, self.parent = tag, attrs, start, rstart, parent
        self.end = self.rend = None
        self.has_block = False


class _Reader(HTMLParser):
    """Keeps two text streams: as written, and without style/script and with <br> as a blank."""

    def __init__(self, restore=unmarked):
        super().__init__(convert_charrefs=True)
        self.restore = restore
        self.raw, self.shown, self.open, self.nodes, self.images = [], [], [], [], []
        self.html_lang = None

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, self.restore(v) if v is not None else "")
        if tag == "html" and self.html_lang is None:
            self.html_lang = a.get("lang")
        if tag == "br":
            self.shown.append(" ")
        if tag in CLOSES_P:
            self._close_open({"p"}, {"table", "td", "th"})
        if tag in IMPLIED:
            self._close_open(*IMPLIED[tag])
        if tag in TEXT_TAGS or tag == "table":
            for n in self.open:
                if n.tag == "td":
                    n.has_block = True
        if tag == "img":
            self.images.append(a)
        parent = self.open[-1] if self.open else None
        node = _Node(tag, a, len(self.shown), len(self.raw), parent)
        if tag in TEXT_TAGS or tag in ("a", "title", "div") or "style" in a:
            self.nodes.append(node)
        if tag in VOID:
            node.end, node.rend = node.start, node.rstart
        else:
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag not in ("html", "body"):
            self._close_open({tag}, {"table"} if tag not in ("table", "div") else set())

    def _close_open(self, tags, stop):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in tags:
                for n in self.open[i:]:
                    n.end, n.rend = len(self.shown), len(self.raw)
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_data(self, data):
        data = self.restore(data)
        self.raw.append(data)
        if not (self.open and self.open[-1].tag in ("style", "script")):
            self.shown.append(data)

    def read(self, html):
        self.feed(html)
        self.close()
        for n in self.open:
            n.end, n.rend = len(self.shown), len(self.raw)
        return self

    def raw_text(self, n):
        return clean("".join(self.raw[n.rstart : n.rend]))

    def shown_text(self, n):
        return clean("".join(self.shown[n.start : n.end]))


def read_facts(html: str | None, is_unsub, bare: bool = True) -> dict:
    """Facts of a mail. References without their semicolon are read as HTML does, or, unless `bare`, as text."""
    html, restore = (html or "", unmarked) if bare else mark_bare(html or "")
    mso_blocks = MSO.findall(html)
    main = _Reader(restore).read(html)
    mso = _Reader(restore).read("\n".join(mso_blocks)) if mso_blocks else None

    links, seen = [], set()
    for reader, in_mso in ((main, False), (mso, True)):
        for n in reader.nodes if reader else ():
            if n.tag == "a" and "href" in n.attrs:
                key = (n.attrs["href"].strip(), reader.raw_text(n))
                if key not in seen:
                    seen.add(key)
                    links.append({"href": key[0], "text": key[1], "in_mso": in_mso})

    texts, known = [], set()
    for n in main.nodes:
        if n.tag in TEXT_TAGS and not (n.tag == "td" and n.has_block):
            t = main.shown_text(n)
            if len(t) > 2 and t not in known:
                known.add(t)
                texts.append(t)

    preheader = None
    for n in main.nodes:
        style = n.attrs.get("style")
        if style and HIDDEN.search(style.lower()):
            t = main.shown_text(n)
            if len(t) > 5:
                preheader = t
                break

    def context_says_unsub():
        for n in main.nodes:
            href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
            if not href or href.startswith(("#", "mailto:")):
                continue
            around = n.parent
            while around is not None and around.tag not in ("td", "p", "div"):
                around = around.parent
            if around is not None and is_unsub(main.raw_text(around)):
                return True
        return False

    titles = [n for n in main.nodes if n.tag == "title"]
    return {
        "title": "".join("".join(main.raw[n.rstart : n.rend]) for n in titles).strip(),
        "html_lang": main.html_lang or None,
        "preheader": preheader,
        "links": links,
        "images": [
            {k: im.get(k) for k in ("src", "alt", "width", "height", "style")} for im in main.images
        ],
        "texts": texts,
        "unsub_context": context_says_unsub(),
    }


LINK_T = pa.struct([("href", pa.string()), ("text", pa.string()), ("in_mso", pa.bool_())])
IMAGE_T = pa.struct([(k, pa.string()) for k in ("src", "alt", "width", "height", "style")])
FACTS_T = pa.struct(
    [
        ("title", pa.string()),
        ("html_lang", pa.string()),
        ("preheader", pa.string()),
        ("links", pa.list_(LINK_T)),
        ("images", pa.list_(IMAGE_T)),
        ("texts", pa.list_(pa.string())),
        ("unsub_context", pa.bool_()),
    ]
)


def facts_of(mails: pa.Array, is_unsub, bare: bool = True) -> pa.Array:
    """Facts of a batch, a slice at a time: the HTML and facts of all its mails as Python objects take
    several times its bytes."""
    parts = [
        pa.array([read_facts(h, is_unsub, bare) for h in mails.slice(at, SLICE_ROWS).to_pylist()], type=FACTS_T)
        for at in range(0, len(mails), SLICE_ROWS)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], type=FACTS_T)


def raw_facts(html: Column, bare: bool = True) -> Column:
    """Arrow-batched call of the reader; only the HTML column travels to Python."""
    from sparkproof.functions.urls import UNSUB_FACTS

    unsub = UNSUB_FACTS

    def read_batch(col: pa.Array) -> pa.Array:
        pattern = re.compile(unsub)
        return facts_of(col, lambda t: pattern.search(t) is not None, bare)

    # Non-deterministic keeps the optimiser from repeating the parse when its fields are filtered.
    return F.arrow_udf(read_batch, returnType=RAW_FACTS).asNondeterministic()(html)
