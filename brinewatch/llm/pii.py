"""Personal data in whole texts: plain spans, and disguised ones found through offset-preserving transducers.

Plain spans are leftmost non-overlapping matches per kind, checked afterwards (address parts, Luhn, digit counts);
what fails is dropped. A second pass rewrites the text: look-alike characters and invisible ones (characters), then
spelled digits, disguised dots and at signs (tokens). Each rewrite keeps a map of pieces, so a match in the rewritten
text maps back to source characters. Matches that touch a rewritten piece are added if they overlap no plain span of their kind, or hold
those that they overlap and more (the plain ones stay). Null text is empty and has no spans; a text of any length and make-up takes time and
memory in proportion to it. Rows that repeat, and rows without doc_id, each come back by their own texts. An empty table gives an empty table;
further columns are left alone by personal_data and kept by redacted.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # one that fails at a run's first digit fails at all of them
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")

# Letters of other scripts drawn like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
}
INVISIBLE = "­͏᠎​‌‍⁠⁡⁢⁣⁤﻿"
# How digits are spelled.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}


def _folded(c: str) -> str:
    """A single character in plain ASCII if it is a look-alike, a digit of any script or a compatibility form."""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(int(d))
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and "!" <= k <= "~" else c


#: Characters of blocks with forms of ASCII: superscripts, enclosed, full width, mathematical, and digits of all scripts.
FOLDS = {c: f for r in (range(0x00B2, 0x00BA), range(0x0300, 0x2C00), range(0x3000, 0x3003), range(0xA600, 0xAC00), range(0xFE50, 0xFF60), range(0x1D400, 0x1D800), range(0x1FBF0, 0x1FBFA)) for i in r if (f := _folded(c := chr(i))) != c}
FOLDS |= {c: "" for c in INVISIBLE}
FOLD_SET = frozenset(FOLDS)
LATIN_FOLDS = tuple(c for c in FOLDS if c < "\u0100")
# a letter drawn like a digit counts as one only between digits
INNER = re.compile(r"(?<=[0-9])[OoIl]+(?=[ -]?[0-9])")
INNER_TABLE = str.maketrans("OoIl", "0011")
_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
# a sign's blanks are taken from their first one on, so a long run of them is read once
_DOT = r"(?:(?<![ \t])[ \t]*[\[({<][ \t]*(?:dot|\.)[ \t]*[\])}>][ \t]*|(?<![ \t])[ \t]+dot[ \t]+|(?<=[a-z0-9])[_-]dot[_-])"
_AT = r"(?:(?<![ \t])[ \t]*[\[({<][ \t]*(?:at|@)[ \t]*[\])}>][ \t]*|(?<![ \t])[ \t]+at[ \t]+|(?<=[a-z0-9])[_-]at[_-]|(?<![ \t])[ \t]+@[ \t]*|(?<![ \t])[ \t]*@[ \t]+)"
#: Runs of at least three spelled digits or digits, parted as numbers are; one spelled digit at least is checked later.
SPELLED_RUN = re.compile(rf"(?i)(?<![A-Za-z])(?:\+[ \t]*|plus[ \t]+)?(?:{_DIGIT}(?![A-Za-z])|[0-9])(?:(?:[ \t.()-]{{0,3}}|[ \t]*,[ \t]*|[ \t]+(?:dot|dash|point|hyphen)[ \t]+)(?:{_DIGIT}(?![A-Za-z])|[0-9])){{2,}}")
SPELLED_TOKEN = re.compile(rf"(?i)(?P<digit>{_DIGIT})|(?P<plus>plus[ \t]+|\+[ \t]+)|(?P<dot>[ \t]*(?:\b(?:dot|point)\b)[ \t]*)|(?P<dash>[ \t]*\b(?:dash|hyphen)\b[ \t]*)|(?P<comma>[ \t]*,[ \t]*)")
#: What addresses with written-out signs are made of. Words end before a sign of underscores or hyphens.
ADDRESS_TOKEN = re.compile(rf"(?i)(?P<dot>{_DOT})|(?P<at>{_AT}|@)|(?P<word>(?:(?!(?<=[a-z0-9])[_-](?:dot|at)[_-])[a-z0-9._%+-])++)")
LABELS = re.compile(r"(?i)[a-z0-9-]++(?:\.[a-z0-9-]++)*+")
BRACKETED_AT = re.compile(r"(?i)[\[({<][ \t]*(?:at|@)|[_-]at[_-]|@")
# Last labels that make a bare "at ... dot ..." an address.
LAST_LABELS = frozenset(
    "com org net edu gov mil int info biz name pro dev app io co me tv ai uk us ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg se no dk fi ee lv lt ru ua tr il in cn jp kr tw hk sg br mx ar cl za eu example test".split()
)
#: What a written-out sign holds, and how far from it the rest of an address may be.
SIGN = re.compile(r"(?i)dot|@|[\[({<_-][ \t]*at[ \t]*[\])}>_-]|[\[({<][ \t]*\.[ \t]*[\])}>]")
REACH = 320
DOTTED_IP = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping addresses, found from their at signs outwards, so that each character is read a bounded number of times."""
    at, end = text.find("@"), 0
    while at >= 0:
        s, width = at, 64
        while s > end:
            low = max(end, s - width)
            kept = len(text[low:s].rstrip(LOCAL))
            s, width = low + kept, 2 * width
            if kept:
                break
        if s < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield s, end
        at = text.find("@", max(at + 1, end))


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that pass its check, in time proportional to the text."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(emails(text))
    if DIGITS.search(text):
        if "." in text:
            out["ip"] = [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(DIGITS.findall(m[0])) <= 15]
    return out


class Rewritten:
    """A text with pieces replaced; every piece knows its source span, so spans can be mapped back through any number of steps."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.steps: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def replace(self, pieces: list[tuple[int, int, str]]) -> None:
        """pieces: (start, end, new) in the present text, ascending, none overlapping."""
        if not pieces:
            return
        parts, moved, at, new_at = [], [], 0, 0
        for s, e, new in pieces:
            parts += [self.text[at:s], new]
            new_at += s - at
            moved.append((new_at, new_at + len(new), s, e))
            new_at += len(new)
            at = e
        parts.append(self.text[at:])
        self.text = "".join(parts)
        self.steps.append(([m[0] for m in moved], moved))

    def source(self, s: int, e: int) -> tuple[int, int, bool]:
        """The source span of a span, and whether it holds anything replaced."""
        touched = False
        for starts, moved in reversed(self.steps):
            k = bisect_right(starts, s) - 1  # the last piece that begins at or before s
            while k + 1 < len(moved) and moved[k + 1][0] == s and moved[k + 1][1] > s:
                k += 1
            j = bisect_right(starts, e - 1) - 1
            touched = touched or any(moved[x][1] > s for x in range(max(k, 0), j + 1))
            s, e = self._back(moved, k, s, first=True), self._back(moved, j, e, first=False)
        return s, e, touched

    @staticmethod
    def _back(moved: list[tuple[int, int, int, int]], k: int, x: int, first: bool) -> int:
        if k < 0:
            return x
        ns, ne, s, e = moved[k]
        if x < ne or (x == ne and not first and ne > ns):
            if ne - ns == e - s:
                return s + x - ns  # one for one
            return s if first and x < ne else e
        return e + x - ne


def _fold_pieces(text: str) -> list[tuple[int, int, str]]:
    return [(i, i + 1, FOLDS[c]) for i, c in enumerate(text) if c in FOLD_SET]


def _spelled_pieces(text: str) -> list[tuple[int, int, str]]:
    out = []
    for run in SPELLED_RUN.finditer(text):
        if not re.search(r"(?i)[a-z]", run[0]):
            continue
        for m in SPELLED_TOKEN.finditer(text, *run.span()):
            new = SPELLED[m[0].lower()] if m.lastgroup == "digit" else {"plus": "+", "dot": ".", "dash": "-", "comma": " "}[m.lastgroup]
            out.append((m.start(), m.end(), new))
    return out


def _joined_pieces(text: str) -> list[tuple[int, int, str]]:
    """Blanks between spelled digits of an address part go: only between single digits."""
    return [(m.start(), m.end(), "") for m in re.finditer(r"(?<=[0-9])[ \t]+(?=[0-9])", text)]


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Merged stretches of REACH characters, out to the next blank, around whatever may stand for a dot or an at sign."""
    at, end = -1, -1
    for m in SIGN.finditer(text):
        s, e = max(0, m.start() - REACH), m.end() + REACH
        s = max(text.rfind(" ", max(end, 0), s), end, 0)  # what lies before the last stretch's end is in it already
        if s > end:
            if end >= 0:
                yield at, end
            at = s
        end = e
    if end >= 0:
        yield at, end


def _addresses(text: str, at: int, end: int) -> Iterator[list[re.Match]]:
    """The written-out signs of each address in a stretch: up to four words parted by dots, an at sign, and words parted by dots."""
    run: list[re.Match] = []
    for m in [*ADDRESS_TOKEN.finditer(text, at, end), None]:
        if m is not None and (not run or m.start() == run[-1].end()):
            run.append(m)
            continue
        kinds = [x.lastgroup for x in run]
        for k in (i for i, kind in enumerate(kinds) if kind == "at"):
            if kinds[k - 1 : k] != ["word"] or kinds[k + 1 : k + 2] != ["word"]:
                continue
            s, e = k - 1, k + 1
            while s >= 2 and k - s < 7 and kinds[s - 2 : s] == ["word", "dot"]:
                s -= 2
            labels = LABELS.match(run[e][0])
            while labels and labels.end() == len(run[e][0]) and kinds[e + 1 : e + 3] == ["dot", "word"] and (more := LABELS.match(run[e + 2][0])):
                e, labels = e + 2, more
            signs = [x for x in run[s:e] if x.lastgroup != "word" and x[0] != "@"]
            if e == k + 1 and not (labels and "." in labels[0]):
                continue  # no dot in the domain
            # a bare " at " is a common word: it needs a dot that is written out, and a known last label
            if not BRACKETED_AT.search(run[k][0]) and not (any(x.lastgroup == "dot" for x in signs) and labels[0].rsplit(".", 1)[-1].lower() in LAST_LABELS):
                continue
            yield signs
        run = [] if m is None else [m]


def _address_pieces(text: str) -> list[tuple[int, int, str]]:
    found = {}
    for at, end in _windows(text):
        for signs in _addresses(text, at, end):
            for m in signs:
                found[m.start()] = (m.start(), m.end(), "@" if m.lastgroup == "at" else ".")
        for run in DOTTED_IP.finditer(text, at, end):
            for m in ADDRESS_TOKEN.finditer(text, *run.span()):
                if m.lastgroup == "dot":
                    found.setdefault(m.start(), (m.start(), m.end(), "."))
    out: list[tuple[int, int, str]] = []
    for piece in sorted(found.values()):
        if not out or piece[0] >= out[-1][1]:
            out.append(piece)
    return out


def spelled_digit(low: str) -> bool:
    """Whether a lower-cased text has a digit spelled as a whole word."""
    for w in SPELLED:
        i = low.find(w)
        while i >= 0:
            if not low[i - 1 : i].isalpha() and not low[i + len(w) : i + len(w) + 1].isalpha():
                return True
            i = low.find(w, i + 1)
    return False


def folds(text: str) -> bool:
    """Whether a text has characters to fold."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not FOLD_SET.isdisjoint(text)
    return any(c in text for c in LATIN_FOLDS)


def may_hide(text: str) -> tuple[bool, bool, bool]:
    """Whether look-alikes, spelled digits or disguised signs can be there at all (cheap; never misses one)."""
    low = text.lower()
    spelled = spelled_digit(low) or DIGITS.search(text) is not None and INNER.search(text) is not None
    return folds(text), spelled, SIGN.search(text) is not None


def _adds(spans: list[Span], a: int, b: int, wider: bool) -> bool:
    """Whether (a, b) overlaps none of the spans (ascending, none overlapping), or, if wider, holds all that it overlaps and more."""
    k = bisect_left(spans, a, key=lambda x: x[1])
    k += k < len(spans) and spans[k][1] <= a
    over = []
    while k < len(spans) and spans[k][0] < b:
        over.append(spans[k])
        k += 1
    return not over or wider and all(a <= x and y <= b for x, y in over) and over != [(a, b)]


def hidden_spans(text: str, plain: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans of the source that show only in the rewritten text."""
    fold, spelled, signs = may_hide(text)
    if not (fold or spelled or signs):
        return {}
    out: dict[str, list[Span]] = {}

    def look(r: Rewritten) -> None:
        if not r.steps:
            return
        for kind, spans in plain_spans(r.text).items():
            for s, e in spans:
                a, b, touched = r.source(s, e)
                if touched and _adds(plain[kind], a, b, wider=True) and _adds(out.get(kind, []), a, b, wider=False):
                    insort(out.setdefault(kind, []), (a, b))

    r = Rewritten(text)
    if fold:
        r.replace(_fold_pieces(text))
    if spelled or fold:
        r.replace([(m.start(), m.end(), m[0].translate(INNER_TABLE)) for m in INNER.finditer(r.text)])
        r.replace(_spelled_pieces(r.text))
    if signs or fold:
        r.replace(_address_pieces(r.text))
    look(r)
    if spelled:  # addresses of spelled digits, whose blanks go
        r.replace(_joined_pieces(r.text))
        r.replace(_address_pieces(r.text))
        look(r)
    return {k: sorted(v) for k, v in out.items()}


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in sorted(spans.get(k, [])))


def find_spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The plain and the hidden spans of a text."""
    plain = plain_spans(text)
    return plain, hidden_spans(text, plain)


def redact(text: str) -> str:
    """The text with every span, plain or hidden, replaced by its kind; overlapping spans are one, under the first kind."""
    plain, hidden = find_spans(text)
    spans = sorted((s, -e, k) for found in (plain, hidden) for k, v in found.items() for s, e in v)
    if not spans:
        return text
    parts, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            parts += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, -e)
    return "".join(parts) + text[at:]


def _batch(texts: list[str | None]) -> dict[str, list]:
    out: dict[str, list] = {f"n_{k}": [] for k in KINDS} | {"base_sha256": [], "spans": [], "n_hidden": []}
    for t in texts:
        plain, hidden = find_spans(t or "")
        for k in KINDS:
            out[f"n_{k}"].append(len(plain[k]))
        out["base_sha256"].append(hashlib.sha256(joined(plain).encode()).hexdigest())
        out["spans"].append(joined({k: plain[k] + hidden.get(k, []) for k in KINDS}))
        out["n_hidden"].append(sum(map(len, hidden.values())))
    return out


def _map_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = _batch(b.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(found[f"n_{k}"], pa.int64()) for k in KINDS), pa.array(found["base_sha256"], pa.string()), pa.array(found["spans"], pa.string()), pa.array(found["n_hidden"], pa.int64())],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_hidden"],
        )


def personal_data(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to counts of plain spans by kind, their digest, all spans as text and the number of hidden ones; a row for each of docs."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_hidden long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_map_spans, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced by <EMAIL>, <IP>, <CARD> or <PHONE>; all other columns as they are (null text stays null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            clean = pa.array([None if t is None else redact(t) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([clean if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
