"""Lexical retrieval packing: a sharded BM25 index over token ids gives each seed document its neighbours, which fill the seed's window.

A document first fills whole windows of its own; what is left of it (its tail) is packed. Tails are dealt to shards by the BM25 scores of all their tokens
against sampled tails (pivots), similar pivots next to each other, so related documents meet. A shard holds a bounded number of tails and indexes them; the first unused tail seeds a window, the index returns unused neighbours, best
first, and they fill the window exactly, the last one cut. What is cut off stays in the index and seeds the next window. Only the last window of a task may stay
open, so padding does not follow the data. Document frequencies are counted over the tails of all documents; their table has one entry per id of the vocabulary.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from balancebeam.llm.common import cut, release_memory
from balancebeam.llm.wordids import file_encoder

K1, B = 1.2, 0.75
SHARD = 2048  # tails indexed together
PIVOTS = 256  # tails that route the others; the index itself never reads them
PIECE = "doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

_ENCODERS: dict[str, Callable[[str], array]] = {}


def _encoder(path: str) -> Callable[[str], array]:
    if path not in _ENCODERS:
        _ENCODERS[path] = file_encoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    return Tokenizer.from_file(path).get_vocab_size()


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids): the ids of the whole text and ``end_id`` after them, two bytes an id where the vocabulary allows it; null text: ``end_id`` alone."""
    kind, narrow = dict(docs.dtypes)[id_col], id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        enc, end = _encoder(path), array("I", [end_id])
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                ids = [np.frombuffer(enc(t or "") + end, np.uintc).astype(narrow) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id {kind}, n long, ids binary")


def id_type(path: str) -> str:
    return "<u2" if vocabulary_size(path) <= 65536 else "<u4"


def document_frequencies(tails: DataFrame, vocabulary: int, narrow: str) -> tuple[np.ndarray, int, float]:
    """How many tails hold each id, the number of tails and their mean length. Each task adds up its own table; one row per id is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total, count = np.zeros(vocabulary, np.int64), 0, 0
        for b in batches:
            for parts in _slices(b.column(0), narrow):
                df += np.bincount(term_counts(parts)[1], minlength=vocabulary)
                total, count = total + sum(map(len, parts)), count + len(parts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, (-1, -2))), pa.array(np.append(df[at], (total, count)))], names=["term", "n"])

    rows = tails.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    terms, n = rows.column("term").to_numpy(), rows.column("n").to_numpy()
    table = np.zeros(vocabulary, np.int64)
    table[terms[terms >= 0]] = n[terms >= 0]
    total, count = int(n[terms == -1].sum()), int(n[terms == -2].sum())
    return table, count, total / max(1, count)


def _slices(column: pa.Array, narrow: str, size: int = 512) -> Iterator[list[np.ndarray]]:
    """The id arrays of a column, some hundred at a time."""
    for k in range(0, len(column), size):
        yield [np.frombuffer(x.as_buffer(), narrow) for x in column.slice(k, size)]


def term_counts(tails: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tail, id, occurrences) of each distinct id of each tail, sorted."""
    flat = np.concatenate([np.zeros(0, np.int64), *tails]).astype(np.int64)
    key = np.sort(np.repeat(np.arange(len(tails)), [len(x) for x in tails]) << 32 | flat)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(first, append=len(key))


class Postings:
    """The weights of terms in ``n`` tails. A term that an eighth of the tails hold is a dense row of ``n`` numbers, so rows take at most eight times the postings; others are lists."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int):
        order, self.n = np.argsort(term, kind="stable"), n
        self.doc, self.weight = doc[order], weight[order]
        self.names, first, many = np.unique(term[order], return_index=True, return_counts=True)
        self.ptr = np.append(first, len(order))
        common = np.flatnonzero(many * 8 >= n)
        self.row = np.full(len(self.names), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n))
        at = np.repeat(self.row, many)
        self.dense[at[at >= 0], self.doc[at >= 0]] = self.weight[at >= 0]

    def find(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term and whether any tail holds it."""
        if not len(self.names):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        return at, self.names[at] == terms

    def _lists(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the lists of these places lie one after another, and how long each is."""
        many = self.ptr[at + 1] - self.ptr[at]
        return np.repeat(self.ptr[at] - np.cumsum(many) + many, many) + np.arange(many.sum()), many

    def scores(self, at: np.ndarray) -> np.ndarray:
        """The sum of the weights of the terms at these places, for each tail."""
        rows, out = self.row[at], np.zeros(self.n)
        flat, _ = self._lists(at[rows < 0])
        out += np.bincount(self.doc[flat], self.weight[flat], self.n)
        for r in rows[rows >= 0].tolist():
            out += self.dense[r]
        return out

    def scores_of(self, asker: np.ndarray, at: np.ndarray, factor: np.ndarray, askers: int) -> np.ndarray:
        """One row of such sums for each asker, its term at each place times its factor."""
        rows, common = self.row[at], self.row[at] >= 0
        ask = np.zeros((askers, len(self.dense)))
        ask[asker[common], rows[common]] = factor[common]
        flat, many = self._lists(at[~common])
        out = ask @ self.dense
        cell = np.repeat(asker[~common] * self.n, many) + self.doc[flat]
        return out + np.bincount(cell, self.weight[flat] * np.repeat(factor[~common], many), askers * self.n).reshape(askers, self.n)


def bm25_idf(df: np.ndarray, count: int) -> np.ndarray:
    return np.log1p((count - df + 0.5) / (df + 0.5))


def bm25_weights(tf: np.ndarray, idf: np.ndarray, length, mean: float) -> np.ndarray:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1)))


class Router:
    """Ranks the pivots for a tail by BM25 over all terms of both, a pivot's score divided by the root of its summed idf so that long ones do not take all."""

    def __init__(self, pivots: list[np.ndarray], idf: np.ndarray, mean: float):
        doc, term, tf = term_counts(pivots)
        self.idf, self.mean, self.n = idf, mean, len(pivots)
        self.norm = np.sqrt(np.maximum(np.bincount(doc, idf[term], self.n), 1e-9))
        self.index = Postings(doc, term, np.ones(len(doc)), self.n)
        self.place = np.arange(self.n)
        if self.n:
            self.place = self._chain(self.scores(pivots))

    def _chain(self, near: np.ndarray) -> np.ndarray:
        """The place of each pivot in a chain that goes on with the most similar one left."""
        near, left, at, place = near + near.T, np.ones(self.n, bool), 0, np.zeros(self.n, np.int64)
        for k in range(self.n):
            left[at], place[at] = False, k
            at = int(np.argmax(np.where(left, near[at], -1.0)))
        return place

    def scores(self, tails: list[np.ndarray]) -> np.ndarray:
        """One row per tail, one column per pivot."""
        doc, term, tf = term_counts(tails)
        at, known = self.index.find(term)
        doc, at = doc[known], at[known]
        length = np.array([len(x) for x in tails], float)
        weight = bm25_weights(tf[known], self.idf[term[known]], length[doc], self.mean)
        return self.index.scores_of(doc, at, weight, len(tails)) / self.norm

    def route(self, tails: list[np.ndarray]) -> np.ndarray:
        """The places of the best and the second pivot of each tail; -1: none."""
        to = np.full((len(tails), 2), -1, np.int32)
        if self.n < 2 or not tails:
            return to
        score, each = self.scores(tails), np.arange(len(tails))
        for k in range(2):
            best = score.argmax(1)
            to[:, k] = np.where(score[each, best] > 0, self.place[best], -1)
            score[each, best] = -1.0
        return to


class Shard:
    """A BM25 index of the tails of one shard, and the greedy packing of its windows."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        self.n = len(tails)
        doc, term, tf = term_counts(tails)
        length = np.array([len(x) for x in tails], float)
        self.index = Postings(doc, term, bm25_weights(tf, idf[term], length[doc], mean), self.n)
        self.at, self.row = self.index.find(term)[0], np.searchsorted(doc, np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all tails for all terms of the seed."""
        return self.index.scores(self.at[self.row[seed] : self.row[seed + 1]])

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused tails, best score first (ties: shard order), then those without a common term in shard order."""
        score = np.where(unused, self.scores(seed), -1.0)
        score[seed] = -1.0
        want = 8
        if self.n > want:
            top = np.argpartition(-score, want)[:want]
            top = top[score[top] > 0]
            for d in top[np.lexsort((top, -score[top]))].tolist():
                yield d
                score[d] = -1.0
        order = np.argsort(-score, kind="stable")
        yield from order[score[order] >= 0].tolist()


def pack_shard(rows: list[tuple], idf: np.ndarray, mean: float, window: int, last: bool) -> tuple[list[list[tuple]], list[tuple]]:
    """Windows of the rows (doc_id, start, doc_tokens, ids) in a shard, each a list of such pieces, and what is left open unless this is the last shard."""
    index = Shard([r[3] for r in rows], idf, mean)
    unused, taken, windows = np.ones(len(rows), bool), [0] * len(rows), []
    cursor, cut_off = 0, None
    while True:
        while cursor < len(rows) and not unused[cursor]:
            cursor += 1
        if cut_off is None and cursor == len(rows):
            return windows, []
        d = cursor if cut_off is None else cut_off
        queue, pieces, room = index.neighbours(d, unused), [], window
        while room and d is not None:
            doc_id, start, doc_tokens, ids = rows[d]
            piece = ids[taken[d] : taken[d] + room]
            pieces.append((doc_id, start + taken[d], doc_tokens, piece))
            taken[d] += len(piece)
            room -= len(piece)
            unused[d] = taken[d] < len(ids)
            cut_off = d if unused[d] else None
            d = next(queue, None) if room else None
        if room and not last:
            return windows, pieces
        windows.append(pieces)


def pivots(tails: DataFrame, narrow: str) -> list[np.ndarray]:
    """Sampled tails, drawn by hash; copies count once."""
    h = F.xxhash64("ids")
    drawn = [r.h for r in tails.select(h.alias("h")).distinct().orderBy("h").limit(PIVOTS).collect()]
    rows = tails.select("ids", h.alias("h")).where(F.col("h").isin(drawn)).dropDuplicates(["h"]).orderBy("h").select("ids").toArrow()
    return [np.frombuffer(x.as_buffer(), narrow) for x in rows.column("ids")]


def pack(docs: DataFrame, path: str, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit). Every id of every document, and ``end_id``
    after it, lies in exactly one piece. A sequence is the pieces of one sequence_id by offset, without gaps, of at most ``window`` ids.

    Whole windows of one document get even sequence ids, packed windows odd ones. Empty and null texts are one-id documents. Rows that repeat a doc_id are
    documents of their own. An empty table gives no rows. Other columns are not read. A task holds one shard of ``shard`` tails, however many rows it is dealt.
    """
    kind, narrow = dict(docs.dtypes)[id_col], id_type(path)
    arrow = to_arrow_type(docs.schema[id_col].dataType)
    width, vocabulary = int(narrow[-1]), vocabulary_size(path)
    schema = PIECE.format(kind=kind)
    table = cut(tokenise(docs, path, end_id, id_col, text_col))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            out = []
            for doc_id, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = np.frombuffer(ids.as_buffer(), narrow)
                for start in range(0, n - window + 1, window):
                    out.append((doc_id, start, window, n, (base + k) * 2, 0, ids[start : start + window].astype("<u4").tobytes()))
                    k += 1
                if len(out) >= 2000:
                    yield _batch(out, arrow)
                    out = []
            yield _batch(out, arrow)

    tails = table.where(F.expr(f"n % {window} > 0")).select("doc_id", "n", F.expr(f"(n div {window}) * {window}").alias("start"), F.expr(f"substring(ids, cast((n div {window}) * {window * width} + 1 as int), {window * width})").alias("ids"))
    df, count, mean = document_frequencies(tails, vocabulary, narrow)
    idf = bm25_idf(df, count)
    router = Router(pivots(tails, narrow), idf, mean)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            to = np.concatenate([np.zeros((0, 2), np.int32), *(router.route(x) for x in _slices(b.column(3), narrow))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to[:, 0]), pa.array(to[:, 1])], names=["doc_id", "n", "start", "ids", "p1", "p2"])

    dealt = cut(tails.mapInArrow(routed, f"doc_id {kind}, n long, start long, ids binary, p1 int, p2 int"))  # read twice: for the bounds of the ranges and for the rows

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k, held = TaskContext.get().partitionId() << 33, 0, []

        def emit(last: bool, size: int):
            nonlocal k, held
            windows, left = pack_shard(held[:size], idf, mean, window, last)
            out = []
            for pieces in windows:
                offset = 0
                for doc_id, start, n, ids in pieces:
                    out.append((doc_id, start, len(ids), n, (base + k) * 2 + 1, offset, ids.astype("<u4").tobytes()))
                    offset += len(ids)
                k += 1
            held = left + held[size:]
            return _batch(out, arrow)

        for b in batches:
            for doc_id, n, start, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                held.append((doc_id, start, n, np.frombuffer(ids.as_py(), narrow)))
                if len(held) > 2 * shard:
                    yield emit(False, shard)
        while len(held) > shard:
            yield emit(False, shard)
        if held:
            yield emit(True, len(held))

    by = ("p1", "p2", "doc_id", F.crc32("ids"))
    shards = dealt.repartitionByRange(*by).sortWithinPartitions(*by)
    packed = shards.select("doc_id", "n", "start", "ids").mapInArrow(fill, schema)
    return table.where(F.col("n") >= window).mapInArrow(whole, schema).unionAll(packed)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds, names = [kind, *[pa.int64()] * 5, pa.binary()], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)
