"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text they hold themselves, without links. A page votes for the generalised
tag-class path of the smallest one around its best that holds nearly all its text; Spark counts votes by host and path, and every page is read again at its host's winning path
(at its own best container where it has no such path or no text there, at the whole body where it has no container). Menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, dialogs and reader comments are left out wherever they stand, by tag, role, class or id; what a class or id says doesn't
count for a container around the page's article (nor a form around it, nor words like has-sidebar), and an article's own header stays.

Character references are decoded, white space is one space, blocks are joined by one space in page order. Null or empty html gives "".
Pages without tags are one block. Unclosed and stray tags are tolerated; a page of any length and depth takes time and memory in proportion to it.
A null url is a host of its own, like any other without one. Rows that repeat, and rows without page_id, each come back; an empty table gives an empty one;
further columns are left alone. One host may have a third of all pages (votes are partial sums, winners are attached, not grouped).
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewatch.llm.tables import attached, saved

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag: a quoted value may hold ">"; a quote that is never closed is a character. No part is read twice.
REST = re.compile(r"(?:[^\"'>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
WANTED = {"class", "id", "role", "hidden", "aria-hidden"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINERS = {"body", "main", "article", "section", "div", "td", "table", "blockquote", "center", "figure", "dl", "ul", "ol", "fieldset", "details"}
LEFT_OUT = {"nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "head", "object", "audio", "video", "canvas"}
FIELDS = {"input", "select", "textarea", "button"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id (parted at signs and capitals) that mark what is left out, whatever stands beside them.
SURE = re.compile(r"ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|sidebars?|navbar|breadcrumbs?|masthead|cookies?|consent|gdpr|popups?|modals?|newsletter|subscribe|signup|disqus|commentlist|pagination|pager|toolbar")
#: Those that mark it where all words beside them are such words too or say no more than that it is a box, whose, or where.
MARKS = re.compile(SURE.pattern + r"|banners?|menus?|nav|navs|navigation|headers?|footers?|notices?|overlay|comments?|replies|respond|share|sharing|social|related|recommended|login|search|widgets?|skip")
BOXES = re.compile(
    r"[0-9]+|[a-z]|site|page|global|main|primary|secondary|user|reader|readers|mobile|desktop|article|articles|entry|post|posts|story|stories|blog|left|right|top|bottom|upper|lower|inner|outer|sub|fixed|sticky|"
    r"box|boxes|wrap|wrapper|container|area|block|blocks|panel|section|sections|unit|slot|bar|row|col|column|item|items|list|lists|group|holder|module|zone|region|content|body|form|field|input|btn|button|buttons|icon|icons|link|links|media|text|message|title|heading|thread|count|tools|us|to|js|id|wp|div|new|more"
)
#: Words that say how something else is laid out.
MODIFIERS = {"has", "no", "not", "with", "without", "layout", "open", "closed", "is", "enabled", "disabled", "toggled", "visible"}
HEADS = {"header", "headers"}
#: Words beside which a header is the article's own.
TITLED = {"article", "entry", "post", "story", "content", "main", "title", "section"}
#: Characters of text for each field (and one more) from which on a form is no form but what stands around a page's text.
FORM_TEXT = 200
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
NUMBERS = re.compile(r"[0-9]+")
#: The share of a page's text without links that its main container holds at least.
NEARLY = 0.95


def marked(name: str, whole: bool) -> bool:
    """Whether a class or id marks what is left out (if whole: all of its words must); an article's own header does not count, nor does how a page is laid out."""
    words = [w.lower() for w in PARTS.findall(name)]
    if not MODIFIERS.isdisjoint(words):
        return False
    marks = [bool(MARKS.fullmatch(w)) and not (w in HEADS and not TITLED.isdisjoint(words)) for w in words]
    if whole or not any(marks):
        return any(marks) and all(marks)
    return any(SURE.fullmatch(w) for w in words) or all(m or BOXES.fullmatch(w) for m, w in zip(marks, words, strict=True))


def left_out(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether a tag is left out for its own sake; an article's header is part of it."""
    return tag in LEFT_OUT and not (tag == "header" and in_article) or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"


def named(tag: str, attributes: dict[str, str]) -> bool:
    """Whether a class or id says so; paragraphs, headings and parts of lines are left out only where all words of one do."""
    return tag not in ("body", "html") and any(marked(name, tag not in CONTAINERS) for of in ("class", "id") for name in attributes.get(of, "").split())


def attributes_of(text: str) -> dict[str, str]:
    """The attributes that matter, of each name the first."""
    out: dict[str, str] = {}
    if text and not text.isspace():
        for m in ATTRIBUTE.finditer(text):
            if (name := m[1].lower()) in WANTED:
                out.setdefault(name, references.unescape(m[2] or m[3] or m[4] or ""))
    return out


def step(tag: str, attributes: dict[str, str]) -> str:
    """A path's step: the tag and its first class, numbers generalised."""
    first = attributes.get("class", "").split()
    return tag + ("." + NUMBERS.sub("#", first[0]).replace("/", "_") if first else "")


class Page:
    """A page's containers, each with its parent (0 is the page itself) and path, and its kept text in order.

    found holds (container, text, whether in a link); a text of one blank parts blocks. Paths are numbers, so that deep pages stay small.
    doubtful are containers whose name or kind (a form) says that they are left out, unless they stand around the page's main one; said are articles
    and mains whose own name says so.
    """

    def __init__(self) -> None:
        self.parent = [0]
        self.path = [0]
        self.steps: list[tuple[int, str]] = [(0, "")]  # of each path: the path before it and the last step
        self.known: dict[tuple[int, str], int] = {}
        self.found: list[tuple[int, str, bool]] = []
        self.doubtful: set[int] = set()
        self.said: set[int] = set()
        self.title = -1  # the container of the first h1
        self.fields: Counter[int] = Counter()

    def opened(self, inside: int, name: str) -> int:
        key = (self.path[inside], name)
        if key not in self.known:
            self.known[key] = len(self.steps)
            self.steps.append(key)
        self.parent.append(inside)
        self.path.append(self.known[key])
        return len(self.parent) - 1

    def tag(self, container: int) -> str:
        return self.steps[self.path[container]][1].split(".")[0]

    def text_of(self, path: int) -> str:
        names = []
        while path:
            path, name = self.steps[path]
            names.append(name)
        return "".join(f"/{n}" for n in reversed(names))

    def number_of(self, text: str) -> int | None:
        path: int | None = 0
        for name in text.split("/")[1:]:
            path = self.known.get((path, name)) if path is not None else None
        return path


def blocks(page: str) -> Page:
    """Reads a page once, from left to right."""
    out = Page()
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, container
    open_tags: Counter[str] = Counter()
    inside = hidden = links = at = 0
    n = len(page)
    while at < n:
        end = page.find("<", at)
        m = None
        while end >= 0 and not (m := TAG.match(page, end)) and not page.startswith(("<!", "<?"), end):
            end = page.find("<", end + 1)  # a sign, not a tag
        end = n if end < 0 else end
        if end > at and not hidden:
            out.found.append((inside, page[at:end], links > 0))
        if end == n:
            break
        if m is None:
            close = page.find("-->", end + 4) if page.startswith("<!--", end) else page.find(">", end)
            at = n if close < 0 else close + (3 if page.startswith("-->", close) else 1)
            continue
        rest = REST.match(page, m.end())
        at = rest.end() + 1
        tag, closing, inner = m[2].lower(), bool(m[1]), rest[0]
        if tag not in INLINE and not hidden:
            out.found.append((inside, " ", False))
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
            continue
        if not closing and tag in RAW and not inner.endswith("/"):
            close = re.compile(rf"</{tag}(?![a-z0-9:-])", re.I).search(page, at)
            close = page.find(">", close.end()) if close else -1
            at = close + 1 if close >= 0 else n
            continue
        if tag in VOID or (not closing and inner.endswith("/") and tag not in CONTAINERS):
            continue
        if closing:
            while open_tags[tag]:
                t, out_of, box = stack.pop()
                open_tags[t] -= 1
                hidden -= out_of
                if box:
                    inside = out.parent[inside]
                if t == tag:
                    break
            continue
        if tag in FIELDS:
            out.fields[inside] += 1
        if tag == "h1" and not hidden and out.title < 0:
            out.title = inside
        attributes = attributes_of(inner)
        drop = left_out(tag, attributes, open_tags["article"] > 0)
        doubt = not drop and (tag == "form" or named(tag, attributes))
        box = tag in CONTAINERS or tag == "form"
        drop = drop or doubt and not box
        if not drop and not box:
            continue  # paragraphs and inline tags need no closing
        hidden += drop
        stack.append((tag, drop, not drop))
        open_tags[tag] += 1
        if not drop:
            inside = out.opened(inside, step(tag, attributes))
            if doubt:
                (out.said if tag in ("article", "main") else out.doubtful).add(inside)
    settled(out)
    return out


def settled(page: Page) -> None:
    """Leaves out the text of doubtful containers, but for those around the page's main container and for forms that are mostly text.

    The main one is the article or main of the most text, one outside doubtful containers before others unless it has under a quarter of theirs; without any it is that of the first heading.
    """
    if not page.doubtful:
        return
    n = len(page.parent)
    size, fields = [0] * n, [page.fields[i] for i in range(n)]
    for inside, text, link in page.found:
        size[inside] += 0 if link else len(text.strip())
    for i in range(n - 1, 0, -1):
        size[page.parent[i]] += size[i]
        fields[page.parent[i]] += fields[i]
    form = {i for i in page.doubtful if page.tag(i) == "form"}
    kept = {i for i in form if size[i] >= FORM_TEXT * (fields[i] + 1)}
    inner = [False] * n
    for i in range(1, n):
        inner[i] = inner[page.parent[i]] or (i in page.doubtful and i not in kept)
    mains = [i for i in range(1, n) if page.tag(i) in ("article", "main") and not (i in page.said and inner[i])]
    most = max((size[i] for i in mains), default=0)
    first = max((i for i in mains if not inner[i] and 4 * size[i] >= most), key=lambda i: size[i], default=max(mains, key=lambda i: size[i], default=page.title))
    while first > 0:
        kept.add(first)
        first = page.parent[first]
    gone = [False] * n
    for i in range(1, n):
        gone[i] = gone[page.parent[i]] or (i in page.doubtful and i not in kept)
    page.found = [x for x in page.found if not gone[x[0]] or x[1] == " "]


#: Containers that don't stand alone as the main one.
PARTIAL = {"ul", "ol", "dl", "td", "table", "blockquote", "figure", "details"}


def best_path(page: Page) -> str:
    """The path of the smallest container around the one with the most text of its own (lists and tables don't stand alone) that holds NEARLY all text without links.

    Within an article or main only such ones are taken, and the outermost one's text is all there is to hold. Containers of one path count together.
    """
    n = len(page.parent)
    tags = [page.tag(i) for i in range(n)]
    whole, score, size = [0] * n, [0.0] * n, [0] * n  # whole: the container itself, or the first around it that may stand alone
    for i in range(1, n):
        whole[i] = whole[page.parent[i]] if tags[i] in PARTIAL else i
    for inside, text, link in page.found:
        k, long = whole[inside], len(text.strip())
        score[k] += -long if link else long
        if page.parent[k]:
            score[page.parent[k]] += 0.5 * (-long if link else long)
        size[inside] += 0 if link else long
    best = max(range(n), key=lambda i: (score[i] * (1.2 if tags[i] in ("article", "main") else 1), -i))
    if score[best] <= 0:
        return ""
    for i in range(n - 1, 0, -1):  # a container stands behind its parent
        size[page.parent[i]] += size[i]
    held = [0] * len(page.steps)
    for i in range(n):
        held[page.path[i]] += size[i]
    way = [best]
    while way[-1]:
        way.append(page.parent[way[-1]])
    way = [i for i in way if tags[i] in ("article", "main")] or way
    return page.text_of(page.path[next(i for i in way if held[page.path[i]] >= NEARLY * held[page.path[way[-1]]])])


def text_at(page: Page, path: str | None) -> str:
    """The text in all containers of a path; without it, or if there is none, in the page's own best."""

    def inner(path: str) -> str:
        number = page.number_of(path)
        if number is None:
            return ""
        chosen = [p == number for p in page.path]
        for i in range(1, len(chosen)):
            chosen[i] = chosen[i] or chosen[page.parent[i]]
        return " ".join(references.unescape("".join(t for inside, t, _ in page.found if chosen[inside])).split())

    return (inner(path) if path else "") or inner(best_path(page))


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.coalesce(url, F.lit("")), "#", 1)
    return F.lower(F.regexp_extract(rest, r"://([^/?#]*)", 1))


def main_texts(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) to (page_id, url, text, n_chars, path), a row for each page; path is its host's winner."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                best = [best_path(blocks(h or "")) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("_host"), pa.array(best, pa.string())], ["_host", "path"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 500):
                part = b.slice(s, 500)
                text = [text_at(blocks(h or ""), p) for h, p in zip(part.column("html").to_pylist(), part.column("path").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), part.column("path")], ["page_id", "url", "text", "n_chars", "path"])

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("_host"))
    votes = pages.select("_host", "html").mapInArrow(vote, "_host string, path string").where("path != ''").groupBy("_host", "path").agg(F.count("*").alias("n"))
    winners = saved(votes.groupBy("_host").agg(F.max_by("path", F.struct("n", "path")).alias("path")), "winners")
    return attached(pages, winners, "_host").mapInArrow(extract, "page_id long, url string, text string, n_chars long, path string")
