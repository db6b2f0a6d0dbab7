"""Documents in Markdown or HTML: front matter, title, summary, headings and links, and links resolved against a page's address."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: So many documents are parsed at once: what they say is held as Python objects until they are written.
_ROWS = 256

_LINK = pa.struct([("target", pa.string()), ("text", pa.string()), ("kind", pa.string()), ("page", pa.string())])
_HEADING = pa.struct([("level", pa.int32()), ("text", pa.string())])
_FIELDS = [("error", pa.string()), ("title", pa.string()), ("summary", pa.string()), ("headings", pa.list_(_HEADING)), ("links", pa.list_(_LINK))]
_SCHEMA = "error string, title string, summary string, headings array<struct<level: int, text: string>>, links array<struct<target: string, text: string, kind: string, page: string>>"

_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})")
_HEAD = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_ITEM = re.compile(r"(?: {0,3}(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)| {0,3}>[ ]?)+")
_DEFINED = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(<[^<>]*>|\S+)(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:[A-Za-z/!?])")
_TABLE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$")
_MARK = re.compile(r"\\[!-/:-@\[-`{-~]|`+|!?\[|\]|<")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_WIKI = re.compile(r"\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_TARGET = re.compile(r"\(\s*(<[^<>\n]*>|(?:[^\s()<>\\]|\\.|\([^\s()]*\))*)(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.){0,999})\]")
_LONGEST = 999  # fixed value: characters of a link label in CommonMark
_NULL = ("", "~", "null", "Null", "NULL")  # fixed values: plain scalars that stand for no value

#: Elements of HTML that a paragraph doesn't reach into or beyond.
_BLOCKS = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html main menu nav ol pre search section table td th ul li".split())


def _key(label: str) -> str:
    return " ".join(label.split()).casefold()


def _unescaped(x: str) -> str:
    return re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", x[1:-1] if x.startswith("<") else x)


def spans(text: str, defined: dict[str, str]) -> tuple[str, list[tuple[str, str, str]]]:
    """(plain text, [(target, text, kind)]) of a paragraph: code spans, images and tags hold no links, and no link holds another."""
    ticks: dict[int, list[int]] = {}
    for m in re.finditer("`+", text):
        ticks.setdefault(len(m[0]), []).append(m.start())
    out: list[str] = []
    links: list[tuple[str, str, str]] = []
    opens: list[tuple[int, bool, int]] = []  # (pieces before it, image, place after it)
    dead = 0  # openers below this one hold a link already
    last = text.rfind("-->")  # no comment begins after this
    i = 0
    while m := _MARK.search(text, i):
        out.append(text[i : m.start()])
        mark, i = m[0], m.end()
        if mark[0] == "\\":
            out.append(mark[1])
        elif mark[0] == "`":
            at = ticks[len(mark)] if len(mark) in ticks else []  # a run after a backslash is shorter than it was counted
            k = bisect_left(at, i)
            if k < len(at):
                out.append(text[i : at[k]].replace("\n", " ").strip())
                i = at[k] + len(mark)
            else:
                out.append(mark)
        elif mark == "<":
            if a := _AUTO.match(text, m.start()):
                links.append((a[1], a[1], "autolink"))
                out.append(a[1])
                i = a.end()
            elif a := _TAG.match(text, m.start()):
                i = a.end()
            elif m.start() < last and text.startswith("!--", i) and (end := text.find("-->", i + 3)) >= 0:
                i = end + 3
            else:
                out.append(mark)
        elif mark == "[" and (a := _WIKI.match(text, m.start())):
            shown = a[2] or a[1]
            links.append((a[1].strip(), shown.strip(), "wiki"))
            out.append(shown)
            i = a.end()
        elif mark != "]":
            opens.append((len(out), mark[0] == "!", i))
            out.append(mark)
        elif not opens:
            out.append(mark)
        else:
            place, image, start = opens.pop()
            live = image or len(opens) >= dead
            dead = min(dead, len(opens))
            raw, target, kind, end = text[start : min(m.start(), start + _LONGEST + 1)], None, "inline", i
            if a := _TARGET.match(text, i):
                target, end = _unescaped(a[1]), a.end()
            else:
                a = _LABEL.match(text, i)
                label = a[1] if a and a[1].strip() else raw
                target, kind = defined.get(_key(label)) if len(label) <= _LONGEST else None, "reference"
                end = a.end() if a else i
            if target is None or not live:
                out.append("]")
                continue
            shown = "".join(out[place + 1 :])
            out[place:] = [shown]
            i = end
            if not image:
                links.append((target, " ".join(shown.split()), kind))
                dead = len(opens)
    out.append(text[i:])
    return " ".join("".join(out).split()), links


def _front(lines: list[str]) -> tuple[str | None, dict[str, str], int]:
    """(error, plain top-level values, lines used)."""
    if not lines or lines[0] != "---":
        return None, {}, 0
    end = next((k for k in range(1, len(lines)) if lines[k] in ("---", "...")), None)
    if end is None:
        return "UnclosedFrontmatter", {}, len(lines)
    values: dict[str, str] = {}
    for line in lines[1:end]:
        m = re.match(r"([^\s:#\-\"'\[{][^:]*?)[ \t]*:(?:[ \t]+(.*))?$", line)
        if not m:
            continue
        if m[1] in values:
            return "DuplicateKey", {}, len(lines)
        x = (m[2] or "").strip()
        if q := re.match(r"\"((?:[^\"\\]|\\.)*)\"[ \t]*(?:#.*)?$", x):
            x = re.sub(r"\\(.)", lambda c: {"n": "\n", "t": "\t"}.get(c[1], c[1]), q[1])
        elif q := re.match(r"'((?:[^']|'')*)'[ \t]*(?:#.*)?$", x):
            x = q[1].replace("''", "'")
        else:
            x = re.sub(r"(?:^|[ \t]+)#.*$", "", x)
            x = "" if x in _NULL or x[:1] in ("[", "{", "|", ">") else x
        values[m[1]] = x
    return None, values, end + 1


def markdown(text: str) -> dict:
    """The parts of a Markdown document; a front matter that isn't closed, or has a name twice, is an error without parts.

    The title is the front matter's, else the first heading of level 1 with text; the summary is its description, else
    the first paragraph that is no table and no HTML.  Fenced and indented code and HTML blocks hold no links.
    """
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").split("\n")
    error, front, used = _front(lines)
    if error:
        return {"error": error, "title": None, "summary": None, "headings": [], "links": []}
    blocks: list[tuple[str, str]] = []  # (p, t, or 1 to 6; text)
    defined: dict[str, str] = {}
    para: list[str] = []

    def close(kind: str | None = None) -> None:
        if para:
            blocks.append((kind or ("t" if len(para) > 1 and _TABLE.match(para[1]) else "p"), "\n".join(para)))
            para.clear()

    fence, html = "", False
    for line in lines[used:]:
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = ""
            continue
        if html:
            html = bool(line.strip())
            continue
        if not line.strip():
            close()
        elif m:
            close()
            fence = m[1]
        elif not para and (line.startswith(("    ", "\t"))):
            continue
        elif h := _HEAD.match(line):
            close()
            blocks.append((str(len(h[1])), h[2] or ""))
        elif para and (u := _UNDER.match(line)):
            close("1" if u[1][0] == "=" else "2")
        elif _RULE.match(line):
            close()
        elif not para and (d := _DEFINED.match(line)):
            defined.setdefault(_key(d[1]), _unescaped(d[2]))
        elif not para and _HTML.match(line) and not _AUTO.match(line.lstrip()):
            html = True
        else:
            if k := _ITEM.match(line):
                close()
                line = line[k.end() :]
            if line.strip():
                para.append(line.strip())
    close()
    headings, links, prose = [], [], None
    for kind, block in blocks:
        plain, found = spans(block, defined)
        links += found
        if kind.isdigit():
            headings.append((int(kind), plain))
        elif kind == "p" and prose is None:
            prose = plain
    title = front.get("title", "").strip() or next((t for n, t in headings if n == 1 and t), None)
    return {"error": None, "title": title, "summary": front.get("description", "").strip() or prose or "", "headings": headings, "links": links}


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title = self.base = self.summary = None
        self.headings: list[tuple[int, str]] = []
        self.links: list[tuple[str, str, str]] = []
        self.open: dict[str, list] = {}  # what gathers text: a link, a heading, the title, the first paragraph

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._end("p")
        at = dict(reversed(attrs))  # of a repeated attribute the first counts
        if tag == "base" and self.base is None:
            self.base = at.get("href")
        elif tag == "meta" and (at.get("name") or "").lower() == "description" and (at.get("content") or "").strip():
            self.summary = self.summary or " ".join(at["content"].split())
        elif tag == "a":
            self._end("a")
            if at.get("href") is not None:
                self.open["a"] = [at["href"].strip()]
        elif re.fullmatch("h[1-6]|title|p", tag):
            self._end(tag)
            self.open[tag] = []

    def _end(self, tag: str) -> None:
        if (got := self.open.pop(tag, None)) is None:
            return
        if tag == "a":
            self.links.append((got[0], " ".join("".join(got[1:]).split()), "html"))
            return
        text = " ".join("".join(got).split())
        if tag == "title":
            self.title = self.title or text
        elif tag == "p":
            self.summary = text if self.summary is None else self.summary
        else:
            self.headings.append((int(tag[1]), text))

    def handle_endtag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self._end("p")
        self._end(tag)

    def handle_data(self, data: str) -> None:
        if self.cdata_elem in (None, "title"):  # not of scripts and styles
            for got in self.open.values():
                got.append(data)


def html(text: str) -> dict:
    """The parts of a web page: title, else first h1; the described summary, else the first paragraph; what scripts, styles and comments hold is nothing."""
    p = _Page()
    p.feed(text)
    p.close()
    for tag in list(p.open):
        p._end(tag)
    return {"error": None, "title": p.title or next((t for n, t in p.headings if n == 1 and t), None), "summary": p.summary or "", "headings": p.headings, "links": p.links, "base": p.base}


def page_of(url: str | None) -> str | None:
    """The address of a page without query and fragment; null unless it is http or https with a host."""
    try:
        u = urlsplit((url or "").strip())
        return f"{u.scheme}://{u.netloc.lower()}{u.path or '/'}" if u.scheme in ("http", "https") and u.netloc else None
    except ValueError:
        return None


def _resolved(base: str | None, target: str) -> str | None:
    try:
        return page_of(urljoin(base or "", target))
    except ValueError:
        return None


def parsed(docs: DataFrame, key: str, body: str, url: str, kind: str) -> DataFrame:
    """(key, page, error, title, summary, headings, links): a row for each document; kind is markdown or html.

    page is the document's address without query and fragment.  A link has its target as written, its text, how it was
    written, and the page that it leads to: null if that isn't on the web (mail, scripts, relative without an address).
    Null bodies are empty documents.  Documents are parsed one at a time within batches, whole.
    """
    read = {"markdown": markdown, "html": html}[kind]
    one = docs.select(F.col(key).alias(key), F.col(url).cast("string").alias("_url"), F.coalesce(F.col(body), F.lit("")).alias("_body"))
    kinds = one.schema[key].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (one.slice(k, _ROWS) for one in batches for k in range(0, one.num_rows, _ROWS)):
            urls, out = b.column(1).to_pylist(), []
            for u, x in zip(urls, b.column(2).to_pylist(), strict=True):
                d = read(x)
                base = urljoin(u or "", d["base"]) if d.get("base") else u
                d["headings"] = [{"level": n, "text": t} for n, t in d["headings"]]
                d["links"] = [{"target": t, "text": s, "kind": k, "page": _resolved(base, t)} for t, s, k in d["links"]]
                out.append(d)
            columns = [b.column(0), pa.array([page_of(u) for u in urls], pa.string())]
            columns += [pa.array([d[n] for d in out], t) for n, t in _FIELDS]
            yield pa.RecordBatch.from_arrays(columns, [key, "page", *[n for n, _ in _FIELDS]])

    return one.mapInArrow(go, f"`{key}` {kinds}, page string, {_SCHEMA}")


def page_links(docs: DataFrame) -> DataFrame:
    """(source, target, text, kind): the links of parsed documents that lead to pages, repeats and links to the page itself included."""
    return docs.where("page is not null").select(F.col("page").alias("source"), F.explode("links").alias("l")).where("l.page is not null").select("source", F.col("l.page").alias("target"), "l.text", "l.kind")
