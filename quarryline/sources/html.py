"""HTML pages by the standard library's parser, a batch of pages at a time: text, title, anchors and job data in JSON-LD scripts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_VOID = {"br", "hr", "img", "input", "link", "meta"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.title, self.links, self.scripts = "", [], []
        self.within: list[str] = []
        self.href, self.anchor, self.script = None, [], None

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.close_anchor()
            self.href, self.anchor = dict(attrs).get("href"), []
        elif tag in ("script", "style", "title"):
            self.within.append(tag)
            if tag == "script" and dict(attrs).get("type") == "application/ld+json":
                self.script = []

    def handle_endtag(self, tag):
        if tag == "a":
            self.close_anchor()
        elif tag in self.within:
            self.within.remove(tag)
            if tag == "script" and self.script is not None:
                self.scripts.append("".join(self.script))
                self.script = None

    def close_anchor(self):
        if self.href is not None:
            self.links.append({"href": self.href, "text": " ".join(" ".join(self.anchor).split())})
        self.href = None

    def handle_data(self, data):
        if "script" in self.within or "style" in self.within:
            if self.script is not None:
                self.script.append(data)
            return
        if "title" in self.within:
            self.title += data
        if self.href is not None:
            self.anchor.append(data)
        self.texts.append(data)


def read(markup: str | None) -> dict:
    """text (lines trimmed, blank ones dropped), title, links, scripts (JSON-LD)."""
    page = _Page()
    page.feed(markup or "")
    page.close()
    page.close_anchor()
    lines = (line.strip() for line in "\n".join(page.texts).splitlines())
    return {"text": "\n".join(x for x in lines if x), "title": page.title.strip(), "links": page.links, "scripts": page.scripts}


def parsed(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """A row for each page: id, text, title, links (array of href and text), scripts (array of JSON-LD texts)."""
    links = pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = [read(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r["text"] for r in rows], pa.string()), pa.array([r["title"] for r in rows], pa.string()), pa.array([r["links"] for r in rows], links), pa.array([r["scripts"] for r in rows], pa.list_(pa.string()))], [id_col, "text", "title", "links", "scripts"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, title string, links array<struct<href:string,text:string>>, scripts array<string>")


def _plain(posting: dict) -> dict:
    """A posting whose places are a list, and whose organisation and identifier are objects."""
    out = dict(posting)
    if isinstance(out.get("jobLocation"), dict):
        out["jobLocation"] = [out["jobLocation"]]
    for name, inner in (("hiringOrganization", "name"), ("identifier", "value")):
        if isinstance(out.get(name), str | int):
            out[name] = {inner: str(out[name])}
    return out


def _postings(node, depth: int = 0) -> list[dict]:
    if depth > 12:
        return []
    if isinstance(node, list):
        return [x for n in node for x in _postings(n, depth + 1)]
    if isinstance(node, dict):
        kind = node.get("@type")
        if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
            return [_plain(node)]
        return [x for n in node.values() if isinstance(n, dict | list) for x in _postings(n, depth + 1)]
    return []


def _parsed_postings(scripts) -> list[str]:
    out = []
    for s in [] if scripts is None else scripts:
        try:
            out += [json.dumps(p) for p in _postings(json.loads(s))]
        except ValueError:
            continue
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def job_postings(scripts: pd.Series) -> pd.Series:
    """JSON of every JobPosting in JSON-LD texts; malformed texts are left out."""
    return scripts.map(_parsed_postings)


def _embedded(page: str | None, marker: str) -> str | None:
    page = page or ""
    at = page.find(marker)
    starts = [i for i in (page.find("{", at), page.find("[", at)) if i >= 0] if at >= 0 else []
    try:
        return json.dumps(json.JSONDecoder().raw_decode(page, min(starts))[0]) if starts else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def embedded_json(page: pd.Series, marker: pd.Series) -> pd.Series:
    """The JSON value that follows a marker, such as a variable's name, in a page's script."""
    return pd.Series([_embedded(p, m) for p, m in zip(page, marker, strict=True)], dtype=object)


def _last_object(reply: str | None) -> str | None:
    reply = reply or ""
    decoder, best, at = json.JSONDecoder(), None, reply.find("{")
    while at >= 0:
        try:
            value, to = decoder.raw_decode(reply, at)
        except ValueError:
            at = reply.find("{", at + 1)
            continue
        best, at = json.dumps(value), reply.find("{", to)
    return best


@F.pandas_udf(T.StringType())
def last_json_object(reply: pd.Series) -> pd.Series:
    """The last balanced {...} of a reply that parses to an object, null if none does."""
    return reply.map(_last_object)


class _Node:
    __slots__ = ("tag", "attrs", "start", "end", "children", "up")

    def __init__(self, tag: str, attrs: dict, start: int, up):
        self.tag, self.attrs, self.start, self.end, self.children, self.up = tag, attrs, start, start, [], up


class _Tree(HTMLParser):
    """Elements of a page with their place in the markup; an element left open ends where the one around it does."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=True)
        self.markup, self.lines = markup, [0]
        for i, c in enumerate(markup):
            if c == "\n":
                self.lines.append(i + 1)
        self.root = self.now = _Node("", {}, 0, None)
        self.feed(markup)
        self.close()
        while self.now is not self.root:
            self.now.end, self.now = len(markup), self.now.up
        self.root.end = len(markup)

    def at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.now.tag == "li":
            self.handle_endtag("li")
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at(), self.now)
        self.now.children.append(node)
        node.end = self.at() + len(self.get_starttag_text() or "")
        if tag not in _VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        found = self.now
        while found is not self.root and found.tag != tag:
            found = found.up
        if found is self.root:
            return
        end = self.markup.find(">", self.at()) + 1 or len(self.markup)
        while self.now is not found:
            self.now.end, self.now = self.at(), self.now.up
        found.end, self.now = end, found.up

    def handle_data(self, data):
        if self.now.tag not in ("script", "style"):
            self.now.children.append(data)


_COMPOUND = re.compile(r"""(?P<tag>[a-z][a-z0-9]*)|\.(?P<cls>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)["']?(?P<value>[^"'\]]*)["']?)?\]""", re.I)


def _fits(node: _Node, compound: str) -> bool:
    for m in _COMPOUND.finditer(compound):
        if m["tag"] and node.tag != m["tag"].lower():
            return False
        if m["cls"] and m["cls"] not in node.attrs.get("class", "").split():
            return False
        if m["attr"]:
            held = node.attrs.get(m["attr"].lower())
            if held is None or m["op"] == "=" and held != m["value"] or m["op"] == "*=" and m["value"] not in held:
                return False
    return True


def _chosen(node: _Node, selector: str):
    """Elements below a node that a selector fits, in order: alternatives by commas, compounds of tag, .class and [attr], [attr=x],
    [attr*=x], and descendants by spaces."""
    chains = [part.split() for part in re.findall(r"(?:[^,\[]|\[[^\]]*\])+", selector)]
    stack = [x for x in reversed(node.children) if isinstance(x, _Node)]
    while stack:
        own = stack.pop()
        for chain in chains:
            if _fits(own, chain[-1]):
                up, left = own.up, list(chain[:-1])
                while left and up is not None and up is not node:
                    if _fits(up, left[-1]):
                        left.pop()
                    up = up.up
                if not left:
                    yield own
                    break
        stack += [x for x in reversed(own.children) if isinstance(x, _Node)]


def _strings(node: _Node) -> list[str]:
    out, stack = [], list(reversed(node.children))
    while stack:
        own = stack.pop()
        if isinstance(own, str):
            if own.strip():
                out.append(own.strip())
        else:
            stack += reversed(own.children)
    return out


def cards(markup: str | None, card: str, fields: dict[str, tuple[list[str], str]]) -> list[dict[str, str]]:
    """A dict for each element that `card` selects. A field is (selectors, tried in order; "" is the card itself; what: text, spaced text,
    markup or @attribute); one that isn't found is left out."""
    tree = _Tree(markup or "")
    out = []
    for own in _chosen(tree.root, card):
        row = {}
        for name, (selectors, what) in fields.items():
            node = next((n for s in selectors for n in ([own] if not s else _chosen(own, s))), None)
            if node is None:
                continue
            if what.startswith("@"):
                value = node.attrs.get(what[1:])
            elif what == "markup":
                value = tree.markup[node.start : node.end]
            else:
                value = (" " if what == "spaced" else "").join(_strings(node))
            if value is not None:
                row[name] = value
        out.append(row)
    return out


def card_rows(card: str, fields: dict[str, tuple[list[str], str]]):
    """A function from a column of markup to ARRAY<MAP<STRING, STRING>>: cards() of each page."""

    @F.pandas_udf(T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    def rows(markup: pd.Series) -> pd.Series:
        return markup.map(lambda x: cards(x, card, fields))

    return rows
