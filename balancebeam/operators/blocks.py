"""Positions of many metrics of a wide panel at once, in blocks of values instead of a row per value.

1. The panel's rows lie in ranges of the entity key. A task cuts its rows into chunks, and a chunk's values of one peer group (a cell) become pieces: one per range of values.
2. All pieces of a range meet in one task, in the order of the chunks, are sorted and numbered, and each goes back with the positions of its values (``placed``).
3. The sizes of all ranges, few numbers per cell, give each range its offset; a chunk's pieces meet again with the keys of its rows (``assembled``).

Bounds of the ranges come from a sample of entities, as those of Spark's range partitioning do: only the balance of tasks hangs on it. A value that many entities share is a range of its own, which is
dealt by chunks, since its order is theirs. No cell, and no range of it, meets in one task for being large.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from balancebeam.session import stored, workers_import

CHUNK = 32_768  # rows of a panel
RANGE = 3_000_000  # values
SAMPLE = 64  # one of so many entities
HEADER, PIECE, SIZES, EARLIER = range(4)  # kinds of rows
PLACED = "kind int, chunk long, cell string, m int, rng int, sub int, at int, n int, n_pos int, rows binary, vals binary"
KEY = ["cell", "rng", "sub"]


def encode(a: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, so that the high bytes, which are alike, lie together."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return pa.Codec("zstd", compression_level=1).compress(np.ascontiguousarray(planes), asbytes=True)


def decode(data: bytes, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, decompressed_size=n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).reshape(n)


def rising(a: np.ndarray) -> bytes:
    return encode(np.diff(a, prepend=0).astype(np.uint32))


def risen(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(decode(data, n, np.uint32), dtype=np.int64)


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [pa.field(*(c.split()[0], kinds[c.split()[1]])) for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), fields, strict=True)], schema=pa.schema(fields))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


# --- what a sample says of the ranges -----------------------------------------------------------------------------------------------


def _ranges(wide: DataFrame, by: Sequence[str], numbers: Sequence[int], relative: Sequence[bool]) -> tuple[dict, int]:
    """cell -> (bounds, which of them are values of their own, task of each range), and the number of tasks."""
    spark = wide.sparkSession
    keys, names = [*by, "year_index"], [f"c{k}" for k in range(len(relative))]
    drawn = stored(wide.where(F.pmod(F.xxhash64("ticker"), F.lit(SAMPLE)) == 0).select(*keys, "peer", *names))
    sides = [([c for c, r in zip(names, relative) if not r], keys), ([c for c, r in zip(names, relative) if r], [*keys, "peer"])]
    held = {}
    for cells, group in sides:
        for row in drawn.groupBy(*group).agg(*[F.count(c).alias(c) for c in cells]).collect() if cells else []:
            held.update({_cell([row[k] for k in keys], row["peer"] if "peer" in group else "", numbers[int(c[1:])]): row[c] * SAMPLE for c in cells})
    most = max(held.values(), default=0) // RANGE + 1
    bounds = {}
    if most > 1:
        at = [k / most for k in range(1, most)]
        for cells, group in sides:
            for row in drawn.groupBy(*group).agg(*[F.percentile_approx(c, at).alias(c) for c in cells]).collect() if cells else []:
                bounds.update({_cell([row[k] for k in keys], row["peer"] if "peer" in group else "", numbers[int(c[1:])]): row[c] for c in cells})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(held.values()) // (2 * RANGE) + 1)
    share, seen, out = max(1, sum(held.values()) // tasks + 1), 0, {}
    for cell, n in sorted(held.items()):
        parts = n // RANGE + 1
        ends = [bounds[cell][k * most // parts - 1] for k in range(1, parts)] if parts > 1 and bounds.get(cell) else []
        single, times = np.unique(np.array(ends, np.float64), return_counts=True)
        out[cell] = (single, times > 1, [(seen + k * n // parts) // share for k in range(parts)], parts)
        seen += n
    return out, tasks


def _cell(keys: list, peer: str, m: int) -> str:
    return repr((*keys, peer, m))


# --- chunks and pieces --------------------------------------------------------------------------------------------------------------


def _pieces(by: Sequence[str], numbers: list[int], relative: Sequence[bool], ranges: dict, tasks: int, turn: int, spread: int) -> Callable:
    keys = [*by, "year_index"]

    def chunk_rows(t: pa.Table, chunk: int, place: int) -> list[tuple]:
        code = np.zeros(t.num_rows, np.int64)
        for k in keys:
            d = pc.dictionary_encode(t[k].combine_chunks(), null_encoding="encode")
            code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # within equal keys the entities stay in their order
        t, code = t.take(pa.array(order)), code[order]
        peers = pc.dictionary_encode(t["peer"].combine_chunks(), null_encoding="encode")
        names, of = peers.dictionary.to_pylist(), peers.indices.to_numpy(zero_copy_only=False)
        columns = [t[f"c{k}"].to_numpy() for k in range(len(numbers))]
        header = t.select([*by, "ticker", "year_index"]).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, header.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(header)
        ends = [str(t["ticker"][k].as_py() or "") for k in (int(order.argmin()), int(order.argmax()))]
        out = [(zlib.crc32(str(chunk).encode()) % tasks, HEADER, chunk, ends[0], -1, 0, 0, 0, t.num_rows, 0, ends[1].encode(), sink.getvalue().to_pybytes())]
        starts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for lo, hi in zip(starts, starts[1:]):
            key = [t[k][lo].as_py() for k in keys]
            inside = np.unique(of[lo:hi]).tolist()
            for k, m in enumerate(numbers):
                v = columns[k][lo:hi]
                have = np.flatnonzero(~np.isnan(v))
                for peer in inside if relative[k] else [None]:
                    idx = have if peer is None else have[of[lo:hi][have] == peer]
                    if len(idx):
                        out += cut(_cell(key, "" if peer is None else names[peer], m), m, v[idx], idx, chunk, lo, place)
        return out

    def cut(cell: str, m: int, v: np.ndarray, idx: np.ndarray, chunk: int, lo: int, place: int) -> list[tuple]:
        bounds, alone, parts, n = ranges.get(cell, ((), (), [zlib.crc32(cell.encode()) % tasks], 1))
        if not len(bounds):
            return [piece(parts[0], cell, m, 0, 0, v, idx, chunk, lo)]
        below = np.searchsorted(bounds, v, "left")
        at = np.minimum(below, len(bounds) - 1)
        rng = 2 * below + (alone[at] & (below < len(bounds)) & (bounds[at] == v))
        out = []
        for r in np.unique(rng).tolist():
            mine = rng == r
            sub = place * n // spread if r % 2 else 0
            out.append(piece(parts[min((r // 2 + sub) % n, len(parts) - 1)], cell, m, r, sub, v[mine], idx[mine], chunk, lo))
        return out

    def piece(part: int, cell: str, m: int, rng: int, sub: int, v: np.ndarray, idx: np.ndarray, chunk: int, lo: int) -> tuple:
        return part, PIECE, chunk, cell, m, rng, sub, lo, len(v), int((v > 0).sum()), rising(idx), encode(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, made, rest, entity = TaskContext.get().partitionId(), 0, None, [*by, "ticker"]
        columns = f"part int, {PLACED}"
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            rest = t
            if t.num_rows >= CHUNK:
                end = t.num_rows  # an entity's rows stay in one chunk
                last = [t[k][end - 1] for k in entity]
                while end and all(t[k][end - 1].equals(x) for k, x in zip(entity, last)):
                    end -= 1
                if end:
                    rest = t.slice(end)
                    yield _batch(chunk_rows(t.slice(0, end), (turn << 54) | (place << 32) | made, place), columns)
                    made += 1
        if rest is not None and rest.num_rows:
            yield _batch(chunk_rows(rest, (turn << 54) | (place << 32) | made, place), columns)

    return run


def _numbered(keep_values: bool) -> Callable:
    """Positions of a range's values by (value, chunk, row). ``keep_values``: instead of them the sorted values, in pieces of as many."""

    def number(group: list[tuple]) -> list[tuple]:
        _, _, cell, m, rng, sub = group[0][:6]
        v = np.concatenate([decode(g[10], g[7], np.float64) for g in group])
        order = np.argsort(v, kind="stable")  # pieces come in the order of the entities
        w = v[order]
        total = (SIZES, -1, cell, m, rng, sub, 0, len(v), sum(g[8] for g in group), encode(np.packbits(np.concatenate([[True], w[1:] != w[:-1]]))), None)
        if keep_values:
            return [total, *[(PIECE, -1, cell, m, rng, sub, k, len(x), 0, None, encode(x)) for k in range(0, len(w), CHUNK) for x in [w[k : k + CHUNK]]]]
        place = np.empty(len(v), np.uint32)
        place[order] = np.arange(len(v), dtype=np.uint32)
        ends = np.cumsum([g[7] for g in group])
        return [total, *[(*g[:10], encode(place[e - g[7] : e])) for g, e in zip(group, ends.tolist())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, group in groupby(_rows(batches), key=lambda r: (r[0], *([r[2], *r[4:6]] if r[0] == PIECE else [r[1]]))):
            if key[0] == HEADER:
                out += [] if keep_values else [(*r[:11],) for r in group]
            else:
                out += number(list(group))
            size = sum(len(r[10] or b"") for r in out)
            if size > 1 << 22:
                yield _batch(out, PLACED)
                out = []
        if out:
            yield _batch(out, PLACED)

    return run


def placed(wide: DataFrame, cells: dict[int, Column], by: Sequence[str], relative: Sequence[bool], peer: Column, turn: int = 0, ordered: bool = False, keep_values: bool = False) -> DataFrame:
    """The positions of the values of ``cells`` (metric number -> column; NULL, NaN and infinite are missing) within (by, year_index) and, where ``relative``, ``peer``; ties by ticker.

    Rows are chunk headers, pieces with positions, and sizes of ranges: the caller stores them. ``ordered``: the rows of ``wide`` lie in ranges of (by, ticker) and sorted by it, from task to task as well
    (which is checked by ``Sizes``); else they are dealt so.
    """
    spark, by = wide.sparkSession, list(by)
    workers_import(spark)
    ordered = ordered and not by and wide.schema["ticker"].dataType.typeName() == "string"
    rows = wide.select(*by, "ticker", "year_index", peer.alias("peer"), *[F.when(F.abs(c) < float("inf"), c).alias(f"c{k}") for k, c in enumerate(cells.values())])
    ranges, tasks = _ranges(rows, by, list(cells), relative)
    if not ordered:
        keys = [F.col(k).asc_nulls_first() for k in (*by, "ticker")]
        rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = rows.mapInArrow(_pieces(by, list(cells), list(relative), ranges, tasks, turn, spread), f"part int, {PLACED}")
    met = pieces.repartitionById(tasks, "part").drop("part").sortWithinPartitions("kind", *KEY, "chunk", "at")
    return met.mapInArrow(_numbered(keep_values), PLACED)


# --- the sizes of all ranges, on the driver: few numbers per cell --------------------------------------------------------------------


@dataclass
class Cell:
    """A peer group of a metric: its size, the ranges in order, and its sides as (values before it, its size, last position of the low tail, first of the high tail)."""

    m: int
    n: int = 0
    n_pos: int = 0
    ranges: list[tuple[int, int]] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    split: bool = False
    sides: list[tuple[int, int, int, int]] = field(default_factory=list)

    def offset(self, rng: int, sub: int) -> int:
        return self.offsets[bisect_right(self.ranges, (rng, sub)) - 1]

    def at(self, position: int) -> tuple[int, int, int]:
        """(range, part of it, place inside) of a position from 0."""
        k = bisect_right(self.offsets, position) - 1
        return *self.ranges[k], position - self.offsets[k]


def in_order(found: DataFrame) -> None:
    """Fails where chunks do not follow each other in the order of the entities."""
    ends = sorted((r.chunk, r.cell.encode(), bytes(r.rows)) for r in found.where(F.col("kind") == HEADER).select("chunk", "cell", "rows").toLocalIterator())
    for (a, _, last), (b, first, _) in zip(ends, ends[1:]):
        if a >> 54 == b >> 54 and not last < first:
            raise ValueError("the panel's rows do not lie in the order of their entities")


def sized(found: DataFrame) -> dict[str, Cell]:
    """The cells of stored ``placed`` rows."""
    cells: dict[str, Cell] = {}
    rows = found.where(F.col("kind") == SIZES).select("cell", "rng", "sub", "m", "n", "n_pos").toArrow()
    for cell, rng, sub, m, n, n_pos in sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)):
        c = cells.setdefault(cell, Cell(m))
        c.ranges.append((rng, sub))
        c.offsets.append(c.n)
        c.n, c.n_pos = c.n + n, c.n_pos + n_pos
    return cells


def with_tails(cells: dict[str, Cell], found: DataFrame, lower: float, upper: float, signed: Callable[[int], bool]) -> None:
    """Fill in the sides (one, or the values up to zero and those above where ``signed``) and their tails: what is not strictly between two order statistics of the side."""
    asked: dict[tuple, list] = defaultdict(list)
    for name, c in cells.items():
        c.split = signed(c.m) and 0 < c.n_pos < c.n
        low = c.n - c.n_pos
        for before, n in [(0, low), (low, c.n_pos)] if c.split else [(0, c.n)]:
            for position in (before + math.floor(lower * (n - 1)), before + math.ceil(upper * (n - 1))):
                rng, sub, place = c.at(position)
                if rng % 2 == 0:
                    asked[name, rng, sub].append(place)
    runs = {(r.cell, r.rng, r.sub, r.place): (r.first, r.last) for r in _runs(found, asked).collect()} if asked else {}

    def run(name: str, c: Cell, position: int) -> tuple[int, int]:
        """First and last position of the values equal to that at ``position``."""
        rng, sub, place = c.at(position)
        if rng % 2:
            return c.offsets[bisect_right(c.ranges, (rng, -1))], [*c.offsets, c.n][bisect_right(c.ranges, (rng, 1 << 31))] - 1
        first, last = runs[name, rng, sub, place]
        return c.offset(rng, sub) + first, c.offset(rng, sub) + last

    for name, c in cells.items():
        low = c.n - c.n_pos
        for before, n in [(0, low), (low, c.n_pos)] if c.split else [(0, c.n)]:
            a = run(name, c, before + math.floor(lower * (n - 1)))
            b = run(name, c, before + math.ceil(upper * (n - 1)))
            c.sides.append((before, n, before + n if a == b else a[1] + 1, c.n + 1 if a == b else b[0] + 1))


def _runs(found: DataFrame, asked: dict[tuple, list]) -> DataFrame:
    targets = found.sparkSession.createDataFrame([(*k, sorted(set(v))) for k, v in asked.items()], "cell string, rng int, sub int, places array<long>")
    held = found.where(F.col("kind") == SIZES).select(*KEY, "n", "rows").join(F.broadcast(targets), KEY)  # a row per peer group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rng, sub, n, bits, places in _rows(batches):
            starts = np.flatnonzero(np.unpackbits(decode(bits, (n + 7) // 8, np.uint8), count=n))
            k = np.searchsorted(starts, places, "right")
            last = np.append(starts, n)[k] - 1
            yield _batch([(cell, rng, sub, p, int(a), int(b)) for p, a, b in zip(places, starts[k - 1], last)], "cell string, rng int, sub int, place long, first long, last long")

    return held.mapInArrow(run, "cell string, rng int, sub int, place long, first long, last long")


def values_at(found: DataFrame, cells: dict[str, Cell], positions: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at some positions (from 0) of each cell; ``found`` was placed with ``keep_values``."""
    asked = []
    for name, wanted in positions.items():
        for p in wanted:
            rng, sub, place = cells[name].at(p)
            asked.append((name, rng, sub, place // CHUNK * CHUNK, place % CHUNK, p))
    targets = found.sparkSession.createDataFrame(asked, "cell string, rng int, sub int, at int, place int, position long")
    held = found.where(F.col("kind") == PIECE).select(*KEY, "at", "n", "vals").join(F.broadcast(targets), [*KEY, "at"]).select("cell", "position", "place", "n", "vals")  # a few rows per peer group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, position, place, n, vals in _rows(batches):
            yield pa.RecordBatch.from_pydict({"cell": [cell], "position": [position], "v": [float(decode(vals, n, np.float64)[place])]})

    return {(r.cell, r.position): r.v for r in held.mapInArrow(run, "cell string, position long, v double").collect()}


# --- pieces meet the keys of their rows again ---------------------------------------------------------------------------------------


def earlier(found: DataFrame, cells: dict[str, Cell]) -> DataFrame:
    """Per chunk and cell, how many values of each tail lie in earlier chunks: within a tail entities stand in their own order, which is that of the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for chunk, cell, rng, sub, n, vals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c, counts, r = cells[cell], [0] * 4, None
                first = c.offset(rng, sub) + 1
                last = [*c.offsets, c.n][bisect_right(c.ranges, (rng, sub))]
                for k, (before, size, low, high) in enumerate(c.sides):
                    for j, (a, z) in enumerate([(before + 1, low), (high, before + size)]):
                        if a <= z and first <= z and a <= last:
                            r = decode(vals, n, np.uint32).astype(np.int64) + first if r is None else r
                            counts[2 * k + j] = int(((a <= r) & (r <= z)).sum())
                if any(counts):
                    out.append((chunk, cell, *counts))
            if out:
                yield _batch(out, "chunk long, cell string, rng int, sub int, at int, n int")

    names = ["rng", "sub", "at", "n"]
    counts = found.where(F.col("kind") == PIECE).select("chunk", "cell", "rng", "sub", "n", "vals").mapInArrow(run, "chunk long, cell string, rng int, sub int, at int, n int")
    per_chunk = counts.groupBy("chunk", "cell").agg(*[F.sum(c).alias(c) for c in names])
    before = Window.partitionBy("cell").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return per_chunk.select(F.lit(EARLIER).alias("kind"), "chunk", "cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int").alias(c) for c in names])


def assembled(found: DataFrame, cells: dict[str, Cell], tails: DataFrame | None, make: Callable, schema: str) -> DataFrame:
    """``make(header, cells)`` per chunk: the keys of its rows as a table, and an iterator of (cell, rows, positions from 1, counts of earlier tails), rows ascending. It yields record batches."""
    rows = found.where(F.col("kind") <= PIECE)
    if tails is not None:
        rows = rows.unionByName(tails, allowMissingColumns=True)
    rows = rows.select("chunk", "kind", "cell", "rng", "sub", "at", "n", "rows", "vals").repartition("chunk").sortWithinPartitions("chunk", "kind", "cell")

    def held(rows: list[tuple]) -> Iterator[tuple]:
        before = {r[2]: r[3:7] for r in rows if r[1] == EARLIER}
        for cell, group in groupby((r for r in rows if r[1] == PIECE), key=lambda r: r[2]):
            pieces, c = list(group), cells[cell]
            idx = np.concatenate([risen(p[7], p[6]) + p[5] for p in pieces])
            place = np.concatenate([decode(p[8], p[6], np.uint32).astype(np.int64) + (c.offset(p[3], p[4]) + 1) for p in pieces])
            if len(pieces) > 1:
                order = np.argsort(idx, kind="stable")
                idx, place = idx[order], place[order]
            yield c, idx, place, before.get(cell, (0, 0, 0, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_rows(batches), key=lambda r: r[0]):
            rows = list(group)
            if rows[0][1] == HEADER:
                yield from make(pa.ipc.open_stream(rows[0][8]).read_all().combine_chunks(), held(rows))

    return rows.mapInArrow(run, schema)
