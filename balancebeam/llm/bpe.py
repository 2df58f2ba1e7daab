"""Byte-level BPE: a lazily determinised transducer for the merges, and a streaming decoder over an incremental UTF-8 state machine.

Which tokens can follow each other decides BPE: a token sequence is the encoding of its bytes exactly when every token encodes to itself and every neighbouring
pair encodes to itself. So each prefix of a piece has one possible last token, and walking back from it gives the encoding of that prefix. The transducer reads
bytes; its state is what later bytes can still change: the pending bytes since the last settled boundary and the settled token before them. A token leaves as
soon as the walks back from every place where a longer token could still begin agree on it, so lookahead is bounded by the longest token.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancebeam.llm.wordids import WordEncoder

PAIRS = 300_000  # remembered answers of the pair test, and
STATES = 250_000  # states of the transducer, before either is built anew
FOLLOWERS = 24  # tokens tried to tell settled tokens apart
NEVER = 1 << 62
BLOCK = 128  # tokens that the decoder takes at a time


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class State:
    """``pending``: bytes read since the last settled boundary. ``lasts[i]``: the last token of the first i of them (0: the settled token before them), None
    where no sequence ends or none that matters. ``live``: the places before the end at which a longer token may have begun. ``steps``: the moves found so far."""

    __slots__ = ("pending", "lasts", "live", "steps")

    def __init__(self, pending: bytes, lasts: tuple[bytes | None, ...], live: tuple[int, ...]):
        self.pending, self.lasts, self.live, self.steps = pending, lasts, live, {}


class Transducer:
    """Encodes one piece (one match of the splitting pattern) at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.starts = {t[:k] for t in ranks for k in range(1, len(t))}  # proper prefixes: a longer token may still begin here
        self.names = sorted(ranks)
        self.memo_pair: dict[tuple[bytes, bytes], bool] = {}
        self.memo_spine: dict[bytes, tuple[tuple[list, list], tuple[list, list]] | None] = {}
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = State(b"", (b"",), ())

    def merge(self, text: bytes, most: int = 1) -> list[bytes]:
        """The merges of ``text`` by rank, until ``most`` parts are left or none merges."""
        parts, ranks = [text[i : i + 1] for i in range(len(text))], self.ranks
        while len(parts) > most:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: bytes) -> tuple[tuple[list, list], tuple[list, list]] | None:
        """What stands at the left edge while the token is being merged, byte first, and the rank at which each next one forms; the same of the right edge.
        None for a token that does not encode to itself."""
        if token not in self.memo_spine:
            last = self.merge(token, 2)
            if len(last) == 1:
                edges = (([token], [NEVER]), ([token], [NEVER]))
            elif len(last) == 2 and last[0] + last[1] in self.ranks and all(self.spine(t) for t in last):
                (l, lr), (r, rr) = self.spine(last[0])[0], self.spine(last[1])[1]
                own = [self.ranks[token], NEVER]
                edges = (([*l, token], [*lr[:-1], *own]), ([*r, token], [*rr[:-1], *own]))
            else:
                edges = None
            self.memo_spine[token] = edges
        return self.memo_spine[token]

    def pair(self, a: bytes, b: bytes) -> bool:
        """Whether b can follow a: while both are being merged, nothing merges across their border first. Equal ranks merge from the left."""
        if not a:
            return self.spine(b) is not None
        ok = self.memo_pair.get((a, b))
        if ok is None:
            if len(self.memo_pair) >= PAIRS:
                self.memo_pair.clear()
            left, right = self.spine(a), self.spine(b)
            ok = left is not None and right is not None and self._apart(*left[1], *right[0])
            self.memo_pair[a, b] = ok
        return ok

    def _apart(self, x: list, x_next: list, y: list, y_next: list) -> bool:
        i = j = 0
        while True:
            r, p, q = self.ranks.get(x[i] + y[j], NEVER), x_next[i], y_next[j]
            if r < p and r <= q:
                return False
            if p == q == NEVER:
                return True
            if p <= q:
                i += 1
            else:
                j += 1

    def back(self, lasts: tuple[bytes | None, ...], i: int) -> tuple[int, ...]:
        """The tokens up to place i, first to last."""
        out = []
        while i:
            out.append(self.ranks[lasts[i]])
            i -= len(lasts[i])
        return tuple(out[::-1])

    def before(self, last: bytes, pending: bytes) -> object:
        """What of the settled token still matters: which tokens that begin with ``pending`` cannot follow it. Where these are many, the token itself."""
        i, j = bisect_left(self.names, pending), bisect_left(self.names, pending + b"\xff" * 8)
        if j - i > FOLLOWERS:
            return last
        return tuple(k for k in range(i, j) if not self.pair(last, self.names[k]))

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        lasts = state.lasts
        begins = state.live if lasts[-1] is None else (*state.live, len(state.pending))
        pending = state.pending + bytes((byte,))
        last, live = None, []
        for j in begins:
            t = pending[j:]
            if last is None and t in self.ranks and self.pair(lasts[j], t):
                last = t  # the one token that follows soundly on what is before it
            if t in self.starts:
                live.append(j)
        walks = live if last is None else [*live, len(pending)]
        lasts = (*lasts, last)
        settled = walks[-1]
        while settled != walks[0]:  # back to the last place that all walks share
            walks = sorted({*walks[:-1], settled - len(lasts[settled])})
            settled = walks[-1]
        out = ()
        if settled:
            out = self.back(lasts, settled)
            pending, lasts, live = pending[settled:], lasts[settled:], [j - settled for j in live]
        needed = set()
        for j in (*live, len(pending)):  # what no walk passes cannot matter any more
            while j and j not in needed and lasts[j] is not None:
                needed.add(j)
                j -= len(lasts[j])
        lasts = (lasts[0], *(t if k in needed else None for k, t in enumerate(lasts[1:], 1)))
        known = None if live and live[0] else self.before(lasts[0], pending) if live else lasts[0]
        key = (known, pending, lasts[1:])
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= STATES:
                self.reset()
            to = self.states[key] = State(pending, lasts, tuple(live))
        return to, out

    def encode(self, piece: bytes) -> list[int]:
        """A piece that is a token is that token; any other goes through the transducer byte by byte."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        s, out = self.start, []
        for byte in piece:
            move = s.steps.get(byte)
            if move is None:
                move = s.steps[byte] = self.step(s, byte)
            s = move[0]
            if move[1]:
                out.extend(move[1])
        out.extend(self.back(s.lasts, len(s.pending)))
        return out


class Encoder:
    """Whole texts: every match of ``pattern`` goes through the transducer by itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer, self.find = Transducer(ranks), regex.compile(pattern).findall
        self.words = WordEncoder(self.chunk)

    def chunk(self, text: str) -> bytes:
        encode = self.transducer.encode
        return b"".join(i.to_bytes(4, "little") for piece in self.find(text) for i in encode(piece.encode("utf-8", "surrogatepass")))

    def encode(self, text: str | None) -> bytes:
        return self.words.encode(text) if text else b""


class Utf8:
    """Incremental UTF-8: ``state`` is the bytes of a character that is not complete yet; moves are determinised lazily per (state, token)."""

    def __init__(self, tokens: dict[int, bytes], size: int = 10_000):
        self.tokens, self.size = tokens, size
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {}
        self.closed: dict[int, str] = {}  # the moves from between characters to between characters

    @staticmethod
    def advance(state: bytes, data: bytes) -> tuple[bytes, str]:
        """The next state and the characters completed. A byte that fits no character becomes U+FFFD."""
        data = state + data
        for k in range(1, min(3, len(data)) + 1):  # an unfinished character has at most three bytes
            lead = data[-k]
            if lead >= 0xC0:
                need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF8 else 1
                if need > k:
                    return data[-k:], data[:-k].decode("utf-8", "replace")
                break
            if lead < 0x80:
                break
        return b"", data.decode("utf-8", "replace")

    def move(self, state: bytes, token: int) -> tuple[bytes, str]:
        table = self.moves.setdefault(state, {})
        to = table.get(token)
        if to is None:
            to = table[token] = self.advance(state, self.tokens[token])
            if not state and not to[0]:
                self.closed[token] = to[1]
        return to

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text as it becomes complete. Between characters a block of tokens that all end a character is one lookup each; others move one by one."""
        state, ids = b"", iter(ids)
        while block := list(islice(ids, BLOCK)):
            if not state:
                try:
                    yield "".join(map(self.closed.__getitem__, block))
                    continue
                except KeyError:
                    pass
            out = []
            for i in block:
                state, text = self.move(state, i)
                out.append(text)
            if len(self.moves) > self.size:
                self.moves = {b"": self.moves[b""]}
            yield "".join(out)
        if state:
            yield state.decode("utf-8", "replace")


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_TOKENS: dict[str, dict[int, bytes]] = {}


def _encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def _tokens(path: str) -> dict[int, bytes]:
    """Bytes by id; decoding needs no transducer."""
    if path not in _TOKENS:
        _TOKENS[path] = {r: t for t, r in read_ranks(path).items()}
    return _TOKENS[path]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): ids is the whole text's encoding as little-endian unsigned 32-bit integers (null or empty text: none). ``path`` is read on each executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([enc.encode(t.as_py()) for t in part.column(1)], pa.binary())], names=["id", "ids"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, text) from (id, ids): the decoded text of each row.

    Its workers have an environment of their own: workers are reused for any function of the same environment, and one that encodes and decodes by turns would hold an encoder's memos all the time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        utf8 = Utf8(_tokens(path))
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                texts = ["".join(utf8.stream(memoryview(x.as_buffer()).cast("I"))) if x.is_valid else None for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["id", "ids", "text"])

    kind = dict(encoded.dtypes)["id"]
    environment = encoded.sparkSession.sparkContext.environment
    environment["BALANCEBEAM_WORKERS"] = "decode"
    try:
        return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, text string")
    finally:
        del environment["BALANCEBEAM_WORKERS"]


