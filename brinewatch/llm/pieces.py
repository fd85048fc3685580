"""SentencePiece encoding and decoding by a max-plus scan, equal to the public library's results piece for piece.

For a BPE model a sequence of pieces is a text's encoding exactly if every two neighbours are the encoding of their own
two strings. So a lattice of pieces in which such neighbours weigh 0 and all others -inf has one best path: that encoding.
Short texts are solved from their start. Giant ones are split into chunks at any character. A chunk's transfer matrix says, for each state at its left
end (the piece that crosses or ends there and how many of its characters lie before) and each at its right end, the
weight of the best path between. Only finite entries are stored. Matrices combine associatively (max, +): in a tree of Spark stages upwards, and
down it again, which fixes the state at every cut; then each chunk is traced by itself, wherever it lies.

No piece holds a blank sign after another sign, and some characters are in no longer piece: paths there are independent,
so words repeat and their paths are kept (a bounded number of them) within a task. Words not known yet are scanned together in numpy:
a step goes one place on in all of them.

Null and empty texts have no pieces. Characters that the model lacks become byte pieces. The blank sign itself (U+2581) decodes to a
blank, as in the library. Texts of any length work: memory is bounded by one text, which is in one row of the input and of the result. Rows that repeat,
and rows without doc_id, each come back; an empty table gives an empty table; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewatch.llm.tables import saved, sorted_groups

BLANK = "▁"
CHUNK = 32_768
FAN = 32  # matrices that a task combines
KEPT_WORDS = 250_000  # of each of two generations
PART = 500  # texts whose words a task holds
KEPT_PAIRS = 1_000_000
LONGEST_KEPT = 48
WAVE = 16_384  # words that are scanned together, of at most LONGEST_KEPT characters
CHUNKS = 16  # chunks whose words are scanned together
SIGNS = 0x110000  # code points
START = ""  # the state before the first piece

Matrix = dict[tuple[str, str], float]
Edge = tuple[tuple[float, str], ...]  # tuples all through: the garbage collector passes over them


class Pieces:
    """A BPE model with byte fallback and no normalisation but blanks as signs and one in front."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not (n.add_dummy_prefix and n.escape_whitespaces):
            raise ValueError("a BPE model with byte fallback and without normalisation is needed")
        self.id = {p.piece: i for i, p in enumerate(m.pieces) if p.type == 1}
        self.score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.code = Codes({t: struct.pack("<i", i) for t, i in self.id.items()})
        self.code.byte = [struct.pack("<i", self.byte[b]) for b in range(256)]
        self.raw = [p.piece.replace(BLANK, " ").encode() if p.type == 1 else b"" for p in m.pieces]
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.longest = max(map(len, self.id))
        by_end: dict[str, set[int]] = {}
        for p in self.id:
            if len(p) > 2:
                by_end.setdefault(p[-3:], set()).add(len(p))
        self.lengths = {e: (*sorted(n, reverse=True), 2, 1) for e, n in by_end.items()}  # of the pieces that end so, longest first
        joined = {c for p in self.id if len(p) > 1 for c in p} - {BLANK}
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece spans the start of a word")
        inner = "".join(map(re.escape, sorted(joined)))
        self.word = re.compile(f"{BLANK}+[{inner}]*|[{inner}]+|[^{inner}{BLANK}]")
        self.pairs: dict[str, dict[str, bool]] = {}  # by the first, then the second piece
        self.n_pairs = 0
        self.edges: dict[int, dict[str, Edge | None]] = {0: {}, -1: {}}  # of the model's pieces and single characters only
        self.known = Known(self)
        self.names = [p.piece for p in m.pieces]
        nodes = {"": 0}  # of a tree of the pieces' beginnings
        for t in self.id:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes))
        self.steps = Table(len(nodes))
        self.steps.put(np.array([nodes[t[:-1]] * SIGNS + ord(t[-1]) for t in nodes if t]), np.array([i for t, i in nodes.items() if t]))
        self.at_node = np.array([self.id.get(t, -1) for t in nodes])
        self.size = np.array([len(t) for t in self.names])
        self.neighbours = Table(KEPT_PAIRS)

    def merged(self, s: str) -> list[str]:
        """BPE by definition: the best-scored neighbours join first, the leftmost of equals."""
        return list(self.joins(s)[-1][1])

    def joins(self, s: str) -> list[tuple[float, list[str]]]:
        """The parts of a string before each of its joins, with that join's score, and those that stay (score -inf)."""
        parts, score, none, out = list(s), self.score, float("-inf"), []
        gains = [score.get(x + y, none) for x, y in zip(parts[:-1], parts[1:], strict=True)]
        while gains:
            best = max(gains)
            if best == none:
                break
            out.append((best, parts[:]))
            i = gains.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del gains[i]
            if i:
                gains[i - 1] = score.get(parts[i - 1] + parts[i], none)
            if i < len(gains):
                gains[i] = score.get(parts[i] + parts[i + 1], none)
        return [*out, (none, parts)]

    def edge(self, t: str, place: int) -> Edge | None:
        """The first (place 0) or last (-1) part of a piece before each of its own joins, with that join's score; None if it is not its own encoding."""
        edges = self.edges[place]
        if t not in edges:
            steps = self.joins(t)
            edges[t] = tuple((gain, parts[place]) for gain, parts in steps) if len(steps[-1][1]) == 1 else None
        return edges[t]

    def apart(self, a: str, b: str) -> bool:
        """Whether a and b are the encoding of a + b. Each one's own joins don't hang on the other until one crosses the border, so both run side by side."""
        left, right, get, none = self.edge(a, -1), self.edge(b, 0), self.score.get, float("-inf")
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            (gain, x), (other, y) = left[i], right[j]
            across = get(x + y, none)
            if across > gain and across >= other:  # of equals the leftmost joins
                return False
            if gain >= other:
                if gain == none:
                    return True
                i += 1
            else:
                j += 1

    def follows(self, a: str, b: str) -> bool:
        """Whether b may come after a (START: first)."""
        after = self.pairs.get(a)
        ok = None if after is None else after.get(b)
        if ok is None:
            if self.n_pairs >= KEPT_PAIRS:
                self.pairs.clear()
                self.n_pairs = 0
            self.n_pairs += 1
            ok = self.pairs.setdefault(a, {})[b] = self.fits(a, b)
        return ok

    def fits(self, a: str, b: str) -> bool:
        return self.apart(a, b) if a else self.edge(b, 0) is not None

    def scan(self, s: str, at: int, state: str) -> list[str | None]:
        """For every place after at, the piece that ends there on the one path of finite weight from state, or None."""
        best: list[str | None] = [None] * (len(s) + 1)
        best[at] = state
        return self.scanned(s, at, best, at)

    def scanned(self, s: str, at: int, best: list[str | None], done: int) -> list[str | None]:
        """The same, where places up to done are known."""
        pieces, pairs, follows, lengths, short, none = self.id, self.pairs, self.follows, self.lengths, (2, 1), {}
        for j in range(done + 1, len(s) + 1):
            for n in lengths.get(s[j - 3 : j], short) if j > 3 else range(j, 0, -1):
                i = j - n
                if i < at or (came := best[i]) is None:
                    continue
                t = s[i:j]
                if n > 1 and t not in pieces:
                    continue
                ok = pairs.get(came, none).get(t)
                if follows(came, t) if ok is None else ok:
                    best[j] = t
                    break
        return best

    @staticmethod
    def trace(best: list[str | None], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            t = best[end]
            if t is None:
                raise ValueError("no path")
            out.append(t)
            end -= len(t)
        return out[::-1]

    def ids(self, parts: list[str]) -> bytes:
        return b"".join(map(self.code.__getitem__, parts))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return b"".join(map(self.known.__getitem__, self.word.findall(signs(text)))) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of many texts."""
        words = [self.word.findall(signs(t)) if t else [] for t in texts]
        self.learn(words)
        return [b"".join(map(self.known.__getitem__, ws)) for ws in words]

    def learn(self, words: list[list[str]]) -> None:
        """The words that aren't known yet become known, many in one scan."""
        known = self.known
        new = known.asked({w for w in set().union(*words) if len(w) <= LONGEST_KEPT})
        for s in range(0, len(new), WAVE):
            part = new[s : s + WAVE]
            for w, ids in zip(part, self.waves(part), strict=True):
                known.keep(w, ids)

    def waves(self, words: list[str]) -> list[bytes]:
        """The ids of words: the scan from START in all of them at once, place by place.

        A piece has its id's number, any other character its code point's beyond those. Each beginning of a word has one path of
        finite weight, so of the pieces that end at a place one fits.
        """
        other, start = len(self.names), len(self.names) + SIGNS
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        long = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(long + 1) - long - 1  # the place before each word
        offset = np.arange(len(codes)) - np.repeat(np.cumsum(long) - long, long)
        left, place = np.repeat(long, long) - offset, np.repeat(first, long) + offset
        at, node, n, found = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            node = self.steps.get(node * SIGNS + codes[at + n])
            piece = np.where(node >= 0, self.at_node[node], -1)
            if n == 0:
                piece = np.where(piece >= 0, piece, other + codes)
            n += 1
            ends = piece >= 0
            found.append((at[ends], piece[ends], np.full(np.count_nonzero(ends), n)))
            on = (node >= 0) & (left[at] > n)
            at, node = at[on], node[on]
        at, piece, n = map(np.concatenate, zip(*found, strict=True))
        end = (offset[at] + n).astype(np.uint16)  # a short type, which is sorted in one pass
        order = np.argsort(end, kind="stable")
        at, piece, n = at[order], piece[order], n[order]
        before = place[at]
        best = np.full(len(codes) + len(words), -1)
        best[first] = start
        bounds = np.cumsum(np.bincount(end)).tolist()
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            t, i = piece[s:e], before[s:e]
            ok = self.fit(best[i], t)
            best[i[ok] + n[s:e][ok]] = t[ok]
        return self.followed(best, first, long)

    def fit(self, came: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Whether each t may come after came."""
        if came.size and came.min() < 0:
            raise ValueError("no path")
        base = len(self.names) + SIGNS + 1
        pairs = came * base + t
        ok = self.neighbours.get(pairs)
        if (asked := ok < 0).any():
            new, back = np.unique(pairs[asked], return_inverse=True)
            fits = np.array([self.fits(self.named(a), self.named(b)) for a, b in zip(*(x.tolist() for x in np.divmod(new, base)), strict=True)], np.int64)
            ok[asked] = fits[back]
            self.neighbours.put(new, fits)
        return ok > 0

    def named(self, number: int) -> str:
        n = number - len(self.names)
        return self.names[number] if n < 0 else START if n == SIGNS else chr(n)

    def followed(self, best: np.ndarray, first: np.ndarray, long: np.ndarray) -> list[bytes]:
        """The ids of all words' paths, from their ends back."""
        at, rows, steps = first + long, np.arange(len(first)), []
        count = np.zeros(len(first), np.int64)
        while len(rows):
            t = best[at]
            if t.min() < 0:
                raise ValueError("no path")
            steps.append((rows, t))
            count[rows] += 1
            at = at - np.where(t < len(self.names), self.size[np.minimum(t, len(self.names) - 1)], 1)
            on = at > first[rows]
            rows, at = rows[on], at[on]
        ends = np.cumsum(count)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (rows, t) in enumerate(steps):
            ids[ends[rows] - 1 - k] = t
        raw, bounds = ids.astype("<i4").tobytes(), [0, *(4 * ends).tolist()]
        out = [raw[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        for w in np.unique(np.searchsorted(ends, np.flatnonzero(ids >= len(self.names)), side="right")).tolist():  # with characters that the model lacks
            out[w] = self.ids(list(map(self.named, ids[bounds[w] // 4 : bounds[w + 1] // 4].tolist())))
        return out

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist()))
        return raw.decode(errors="replace")[1:]  # without the blank in front

    # giant texts

    def states(self, before: str, after: str) -> list[tuple[str, int]]:
        """Pieces that may cross or end at a cut, with how many of their characters lie before it."""
        out = []
        for k in range(1, min(self.longest, len(before)) + 1):
            for x in range(min(self.longest - k, len(after)) + 1):
                t = before[len(before) - k :] + after[:x]
                if t in self.id or len(t) == 1:
                    out.append((t, k))
        return out

    def begins(self, left: str, s: str) -> list[int]:
        """Where words begin in s, which follows left."""
        return [w for m in self.word.finditer(left + s) if (w := m.start() - len(left)) >= 0]

    def transfer(self, left: str, core: str, right: str, first: bool, last: bool) -> Matrix:
        """Weights between the states at both ends of a chunk; left and right are longest - 1 characters around it."""
        s = core + right
        ends = [] if last else [(t, k) for t, k in self.states(core, right)]
        out: Matrix = {}
        tail: dict[int, list[str | None]] = {}
        words = self.begins(left, s)
        for t, k in [(START, 0)] if first else self.states(left, core):
            at = len(t) - k if t else 0
            stop = next((w for w in words if w >= at), len(core))
            stop = min(stop, len(core))
            head = self.scan(s[:stop] if stop < len(core) else s, at, t)
            if stop < len(core):  # a word begins here: what comes after doesn't depend on how we came
                if head[stop] is None and stop > at:
                    continue
                begin = max((w for w in words if w <= len(core) - 1), default=stop)
                begin = max(begin, stop)
                if begin not in tail:
                    tail[begin] = self.scan(s[begin:], 0, START)
                best, shift = tail[begin], begin
            else:
                best, shift = head, 0
            if last:
                if best[len(core) - shift] is not None:
                    out[key(t, k), key(START, 0)] = 0.0
                continue
            for e, n in ends:
                i = len(core) - n - shift
                if i < 0 or (i < at and not shift):
                    continue
                came = best[i]
                # at a word's start any piece that may stand first may follow
                if came is not None and self.follows(START if (i == 0 and shift) else came, e):
                    out[key(t, k), key(e, n)] = 0.0
        return out

    def traced(self, left: str, core: str, right: str, entry: str, leave: str) -> bytes:
        """Ids of the pieces that begin in a chunk, between two known states."""
        head, words = self.between(left, core, right, entry, leave)
        return head + b"".join(map(self.known.__getitem__, words))

    def between(self, left: str, core: str, right: str, entry: str, leave: str) -> tuple[bytes, list[str]]:
        """The same up to where a word begins, and the words from there."""
        (t, k), (e, n) = unkey(entry), unkey(leave)
        at = len(t) - k if t else 0
        s = core + right[: len(e) - n] if e else core
        stop = next((w for m in self.word.finditer(left + s) if (w := m.start() - len(left)) >= at), len(s))
        return self.ids(self.trace(self.scan(s[:stop], at, t), at, stop)), self.word.findall(s, stop)

    def traced_all(self, rows: list[dict]) -> list[bytes]:
        """traced for many chunks."""
        parts = [self.between(*(r[c] for c in ("left", "core", "right", "entry", "exit"))) for r in rows]
        self.learn([words for _, words in parts])
        return [head + b"".join(map(self.known.__getitem__, words)) for head, words in parts]


class Table:
    """Numbers from 0 on by non-negative keys, in numpy; -1 where there is none. Of at most so many keys: before it would hold more it is emptied."""

    def __init__(self, most: int) -> None:
        self.bits, self.most, self.n = max(4, (2 * most).bit_length()), most, 0
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots(keys)
        there = self.keys[at]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return self.values[at].astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that differ from one another and aren't held yet."""
        if self.n + len(keys) > self.most:
            self.keys.fill(-1)
            self.values.fill(-1)
            self.n = 0
            keys, values = keys[: self.most], values[: self.most]
        self.n += len(keys)
        at = self.slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of several for one slot the last stays
            mine = self.keys[at] == keys
            self.values[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & ((1 << self.bits) - 1)


class Codes(dict):
    """Ids of pieces as bytes; a character that the model lacks has those of its bytes, which aren't kept."""

    byte: list[bytes]

    def __missing__(self, t: str) -> bytes:
        return b"".join(map(self.byte.__getitem__, t.encode()))


class Known(dict):
    """Ids of words, found when first asked for, in two generations of at most KEPT_WORDS: once the young one is full it becomes the old one.

    A word of the old one that is asked for again comes into the young one, so frequent words stay and memory is bounded.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.old: dict[str, bytes] = {}

    def keep(self, word: str, ids: bytes) -> None:
        if len(self) >= KEPT_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids

    def asked(self, words: set[str]) -> list[str]:
        """Those of the words that neither generation has; the old one's become young."""
        new = []
        for w in words:
            if w not in self:
                if (ids := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.keep(w, ids)
        return new

    def __missing__(self, word: str) -> bytes:
        p = self.pieces
        out = self.old.get(word)
        if out is None:
            out = p.ids(p.trace(p.scan(word, 0, START), 0, len(word)))
        if len(word) <= LONGEST_KEPT:
            self.keep(word, out)
        return out


def signs(text: str) -> str:
    return BLANK + text.replace(" ", BLANK)


def key(t: str, k: int) -> str:
    return f"{k}:{t}"


def unkey(s: str) -> tuple[str, int]:
    k, _, t = s.partition(":")
    return t, int(k)


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The max-plus product: associative."""
    by: dict[str, list[tuple[str, float]]] = {}
    for (x, y), w in b.items():
        by.setdefault(x, []).append((y, w))
    out: Matrix = {}
    for (x, y), w in a.items():
        for z, v in by.get(y, ()):
            if w + v > out.get((x, z), float("-inf")):
                out[x, z] = w + v
    return out


def cuts(matrices: list[Matrix], begin: str = f"0:{START}", end: str = f"0:{START}") -> list[str]:
    """The states at all cuts on the best path between two states, from the first chunk's left end to the last one's right end."""
    prefix = [{k: w for k, w in matrices[0].items() if k[0] == begin}]
    for m in matrices[1:]:
        prefix.append(combine(prefix[-1], m))
    states = [end]
    for k in range(len(matrices) - 1, 0, -1):
        ways = [(prefix[k - 1][begin, x] + w, x) for (x, y), w in matrices[k].items() if y == states[0] and (begin, x) in prefix[k - 1]]
        if not ways:
            raise ValueError("no path")
        states.insert(0, max(ways)[1])
    if (begin, states[0]) not in matrices[0]:
        raise ValueError("no path")
    return [begin, *states]


_models: dict[bytes, Pieces] = {}


def pieces(model) -> Pieces:
    """The model of a broadcast, made once a worker."""
    digest = hashlib.sha256(model.value).digest()
    if digest not in _models:
        _models[digest] = Pieces(model.value)
    return _models[digest]


def encode_mapper(model, text_out: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for s in range(0, b.num_rows, PART):
                part = b.slice(s, PART)
                texts = part.column("text").to_pylist()
                ids = p.encode_all(texts)
                yield _row_batch(part.column("doc_id"), ids, [(p.decode(i) if i else "") == (t or "") for i, t in zip(ids, texts, strict=True)], text_out)

    return run


def _row_batch(doc_ids: pa.Array, ids: list[bytes], same: list[bool], whole: bool) -> pa.RecordBatch:
    columns = [doc_ids, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array(same, pa.bool_())]
    names = ["doc_id", "n_pieces", "ids_sha256", "round_trip"]
    if whole:
        columns.append(pa.array([np.frombuffer(i, "<i4") for i in ids], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def chunk_mapper(size: int, halo: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                s = signs(text)
                n = -(-len(s) // size)
                for k in range(n):
                    i, j = k * size, min(len(s), (k + 1) * size)
                    yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "doc_id": pa.array([doc], pa.int64()), "part": pa.array([k], pa.int32()), "parts": pa.array([n], pa.int32()), "left": [s[max(0, i - halo) : i]], "core": [s[i:j]], "right": [s[j : j + halo]]})

    return run


def transfer_mapper(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for r in b.to_pylist():
                yield _matrix_batch(r["row"], r["part"], p.transfer(r["left"], r["core"], r["right"], r["part"] == 0, r["part"] == r["parts"] - 1))

    return run


def _matrix(r: dict) -> Matrix:
    return dict(zip(zip(r["enter"], r["leave"], strict=True), r["weight"], strict=True))


def _matrix_batch(row: int, part: int, m: Matrix) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int64()), "part": pa.array([part], pa.int32()), "enter": [[x for x, _ in m]], "leave": [[y for _, y in m]], "weight": [list(m.values())]})


def _combined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One matrix for each group of neighbouring ones."""
    for t in sorted_groups(batches, ["row", "group"]):
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        yield _matrix_batch(rows[0]["row"], rows[0]["group"], reduce(combine, map(_matrix, rows)))


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states at both ends of each matrix of a group, from those at the group's ends."""
    for t in sorted_groups(batches, ["row", "group"]):
        rows = sorted(t.to_pylist(), key=lambda r: r["part"])
        states = cuts(list(map(_matrix, rows)), rows[0]["begin"], rows[0]["end"])
        n = len(rows)
        yield pa.RecordBatch.from_pydict({"row": pa.array([rows[0]["row"]] * n, pa.int64()), "part": pa.array([r["part"] for r in rows], pa.int32()), "entry": states[:-1], "exit": states[1:]})


MATRIX = "row long, part int, enter array<string>, leave array<string>, weight array<double>"


def states_at_cuts(matrices: DataFrame, parts: int, fan: int) -> DataFrame:
    """(row, part, entry, exit) from each row's matrices, of which a row has at most so many parts: a scan in Spark.

    Upwards, fan neighbouring matrices become one, level by level, until a row has at most fan. Downwards, the states at a combined matrix's ends
    give those at the ends of the ones it is made of. So a task never holds more than fan matrices of a text, however long the text is.
    """

    def grouped(df: DataFrame) -> DataFrame:
        return df.repartition("row", "group").sortWithinPartitions("row", "group", "part")

    group = F.floor(F.col("part") / fan).cast("int").alias("group")
    levels = [matrices]
    while parts > fan:
        parts = -(-parts // fan)
        levels.append(saved(grouped(levels[-1].select("*", group)).mapInArrow(_combined_rows, MATRIX), f"matrices-{len(levels)}"))
    schema, ends = "row long, part int, entry string, exit string", [F.lit(key(START, 0)).alias(c) for c in ("begin", "end")]
    states = grouped(levels.pop().select("*", F.lit(0).alias("group"), *ends)).mapInArrow(_cut_rows, schema)
    while levels:
        above = states.select("row", F.col("part").alias("group"), F.col("entry").alias("begin"), F.col("exit").alias("end"))
        states = grouped(levels.pop().select("*", group).join(above, ["row", "group"])).mapInArrow(_cut_rows, schema)
    return states


def trace_mapper(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            for s in range(0, b.num_rows, CHUNKS):
                rows = b.slice(s, CHUNKS).to_pylist()
                for r, ids in zip(rows, p.traced_all(rows), strict=True):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([r["row"]], pa.int64()), "doc_id": pa.array([r["doc_id"]], pa.int64()), "part": pa.array([r["part"]], pa.int32()), "core": [r["core"]], "ids": [ids]})

    return run


def gather_mapper(model, text_out: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for t in sorted_groups(batches, ["row"]):
            ids = b"".join(t.column("ids").to_pylist())
            s = "".join(t.column("core").to_pylist())
            doc = t.column("doc_id").combine_chunks().slice(0, 1)
            yield _row_batch(pa.array(doc.to_pylist(), pa.int64()), [ids], [signs(p.decode(ids)) == s], text_out)

    return run


def encoded(docs: DataFrame, model_path: str, chunk: int = CHUNK, ids: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_pieces, ids_sha256, round_trip) and, if asked, ids array<int>; a row for each of docs.

    ids_sha256 is of the ids as little-endian 32-bit integers; round_trip says that decoding gives the text again. The
    model file is read on the driver and broadcast: half a megabyte, whatever the data.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    halo = pieces(model).longest - 1
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_pieces long, ids_sha256 string, round_trip boolean" + ", ids array<int>" * ids
    giant = F.coalesce(F.length("text") >= chunk, F.lit(False))
    small = docs.where(~giant).mapInArrow(encode_mapper(model, ids), schema)
    rows = docs.where(giant).withColumn("row", F.monotonically_increasing_id())
    chunks = saved(rows.mapInArrow(chunk_mapper(chunk, halo), "row long, doc_id long, part int, parts int, left string, core string, right string"), "chunks")
    parts = chunks.agg(F.max("parts")).first()[0] or 0
    matrices = chunks.repartition("row", "part").mapInArrow(transfer_mapper(model), MATRIX)
    states = states_at_cuts(saved(matrices, "matrices") if parts > FAN else matrices, parts, FAN)
    traced = chunks.join(states, ["row", "part"]).select("row", "doc_id", "part", "left", "core", "right", "entry", "exit").mapInArrow(trace_mapper(model), "row long, doc_id long, part int, core string, ids binary")
    giants = traced.repartition("row").sortWithinPartitions("row", "part").mapInArrow(gather_mapper(model, ids), schema)
    return small.unionAll(giants)
