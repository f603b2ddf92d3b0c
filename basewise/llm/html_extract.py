"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines (one for each block of the page, in page order). Tag rules give some lines length 0, in
their place: those in a menu, header, footer, sidebar, notice, advert, form, comment list or the like, those outside
<article> or <main> where the page has text inside one, and else those that are mostly links. Lengths are summed over
windows of WINDOW lines. A surge is where the sum reaches SHARE of the page's largest, a dive where it falls to 0; the
main text is every region with a surge, with its neighbours from where the sum left 0 up to the dive.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

WINDOW, SHARE, LINKS = 3, 0.2, 0.5

#: Elements whose content is no text of the page.
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")
TOKEN = re.compile(rf"<(?:!--.*?(?:-->|$)|[!?][^>]*>|({'|'.join(RAW)})(?=[\s/>])[^>]*>.*?(?:</\1(?=[\s/>])[^>]*>|$)|(/?)([a-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)>)", re.S | re.I)
ATTRIBUTE = re.compile(r"(?:\s|^)(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements around the main text, or apart from it.
APART = {"nav", "footer", "aside", "form", "menu", "button", "select", "option", "dialog", "svg", "canvas", "object", "audio", "video", "template", "head", "label", "fieldset", "datalist"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | (APART - {"button", "select", "option", "label", "svg", "canvas", "object", "audio", "video"})
#: Words in a class, id or role that tell the same.
TOLD = {
    *"ad ads adv advert advertisement advertising adbox adslot adsense banner sponsor sponsored promo promotion".split(),
    *"nav navbar navigation menu topbar breadcrumb breadcrumbs pagination pager toolbar masthead header footer foot".split(),
    *"sidebar side aside widget widgets related recommended recommendations trending share sharing social".split(),
    *"cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login search searchbox form".split(),
    *"comment comments commentlist disqus reply replies respond discussion contentinfo complementary".split(),
}
#: Words that make an element the page's content, whatever else it is called.
CONTENT = {"articlebody", "main"}


@dataclass
class Line:
    text: str
    links: int
    apart: bool
    inside: bool


def _kind(name: str, attributes: str, inside: bool) -> str:
    """apart, content or nothing, by name and attributes."""
    if name in APART or (name == "header" and not inside):
        return "apart"
    told: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return "apart"
        if key in ("class", "id", "role", "itemprop"):
            told.update(WORDS.findall(value))
    if name in ("article", "main") or told & CONTENT:
        return "apart" if told & {"comment", "comments", "reply"} else "content"
    # A whole page or a heading may well be called "header"; only boxes count.
    if told & TOLD and name not in ("html", "body") and not (inside and re.fullmatch("h[1-6]|header", name)):
        return "apart"
    return ""


def lines(html: str) -> list[Line]:
    """The page's blocks in order; one without text is left out."""
    out: list[Line] = []
    parts: list[str] = []
    # Open elements that matter: name, kind, and how many of the same name are open inside.
    stack: list[list] = []
    links = linked = apart = inside = at = 0

    def flush() -> None:
        nonlocal links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(Line(text, links, apart > 0, inside > 0))
        parts.clear()
        links = 0

    def count() -> tuple[int, int]:
        return sum(x[1] == "apart" for x in stack), sum(x[1] == "content" for x in stack)

    for m in TOKEN.finditer(html):
        begin = m.start()
        if begin > at:
            parts.append(html[at:begin])
            if linked:
                links += len(parts[-1].strip())
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        block = name in BLOCK
        if name in VOID:
            if block:
                flush()
            else:
                parts.append(" " if name in ("br", "img", "input") else "")
        elif m[2]:
            if name == "a":
                linked = 0
            if not block and not any(x[0] == name for x in stack):
                continue
            if parts:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][2]:
                        stack[i][2] -= 1
                    else:
                        del stack[i:]
                        apart, inside = count()
                    break
        else:
            if name == "a":
                linked = 1
            kind = _kind(name, m[4], inside > 0) if m[4] or name in APART or name in ("header", "article", "main") else ""
            if (block or kind) and parts:
                flush()
            if kind:
                if name in ("article", "main") and kind == "content":
                    # What was left open before the content ends here.
                    stack = [x for x in stack if x[1] == "content" or x[0] in ("aside", "form", "template", name)]
                stack.append([name, kind, 0])
                apart, inside = count()
            elif stack and stack[-1][0] == name:
                stack[-1][2] += 1
    parts.append(html[at:])
    flush()
    return out


def regions(lengths: list[int], window: int = WINDOW, share: float = 0) -> list[tuple[int, int]]:
    """Runs of lines, first to last with text, from where the window sums leave 0 to where they dive to it again, if they surge between."""
    sums = [sum(lengths[i : i + window]) for i in range(len(lengths))]
    surge = share * max(sums, default=0)
    out, begin, most = [], None, 0
    for i, s in enumerate([*sums, 0]):
        if s:
            begin, most = i if begin is None else begin, max(most, s)
        elif begin is not None:
            if most >= surge:
                held = [j for j in range(begin, min(i + window, len(lengths))) if lengths[j]]
                out.append((held[0], held[-1]))
            begin, most = None, 0
    return out


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by line breaks; empty for a page without any."""
    found = lines(html or "")
    content = any(x.inside and not x.apart for x in found)
    lengths = [0 if x.apart or (content and not x.inside) or (not content and x.links > LINKS * len(x.text)) else len(x.text) for x in found]
    return "\n".join(found[i].text for a, b in regions(lengths, WINDOW, SHARE) for i in range(a, b + 1) if lengths[i])


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns keep, text and n_chars of every page.

    A null or empty page has an empty text; repeated rows give repeated rows; an empty table gives no rows; other
    columns are not read."""
    names = [key, *keep]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(len(names)).to_pylist()]
        new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *new], names=[*names, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(pages.select(*names, html), run, f"{kinds}, text string, n_chars bigint")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
