"""Exact top-k inner products with multi-resolution segment statistics.

Each vector is cut into segments; the mean and deviation of every segment bound
the inner product of two vectors from above (and so their distance from below):
within a segment of length n it is at most ``n * (m1 * m2 + s1 * s2)``.  What
still could enter the top k is scored exactly in integers.

Candidates are dealt over groups of bounded bytes by a hash of their components,
so that equal vectors meet; of those only rows that can be among the k best stay.
Each group meets all blocks of queries, which are copied to every group; no side
is broadcast or collected.  A group's candidates are taken by tiles, in order of
their ids.  The range of a tile's statistics bounds all of it for a query, at 1,
4 and 16 segments; queries that a tile can't improve skip it.  Where there are
several groups, a sample of candidates of bounded bytes gives each query its
first threshold, so that a group doesn't start from nothing.  For the others,
bounds of single pairs go first at the level that costs least by a probe, if any
costs less than the scores; else the tile is scored.  Scores are products of
matrices in the narrowest type that holds every partial sum exactly.

Defined results: null vectors, vectors holding null, NaN or an infinity, and
rows without an id take no part.  Vectors of another length than the query's
are not compared with it.  Rows that carry the query's id are not candidates
for it; other repeated rows each count, and query rows of one id with different
vectors share one ranking.  Components may have any finite size: scores are exact
integers and ranked as such; ``score`` shows the nearest 64-bit value of one that
64 bits can't hold.  Ties go to the smaller id.  An empty
table gives an empty result; a query without candidates gives no row.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLOCK = "part int, kind int, dim int, narrow boolean, ids binary, data binary, floor binary"
_FOUND = "query_id long, vec_id long, score long, beyond string"
_FOUND_ARROW = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.string())])
_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("dim", pa.int32()), ("narrow", pa.bool_()), ("ids", pa.binary()), ("data", pa.binary()), ("floor", pa.binary())])
#: Bytes of 16-bit components that a group of candidates holds, about.
GROUP_BYTES = 64 << 20
#: Bytes of 16-bit components, about, of the sampled candidates that give queries their first thresholds.
SEED_BYTES = 8 << 20
#: Rows of a tile; the first, which gives the first thresholds, has half as many.
_TILE = 1024
#: Queries whose scores with a tile are made at a time.
_ROWS = 256
_LEVELS = (1, 4, 16)
#: Cost of scoring one surviving pair by itself, in components of a matrix product.
_SINGLE = 2500
#: Bound of the sums of products that 64-bit integers hold; beyond it Python's integers take over.
_NARROW = 2.0**62
_LONG = (1 << 63) - 1


def _trim(ids: np.ndarray, data: np.ndarray, k: int) -> np.ndarray:
    """Rows, in order of their ids, without copies of a vector that can't be among the k best.

    Of equal vectors the k + 1 smallest ids stay, as one may be the query's own,
    and of one id k rows.
    """
    whole = np.ascontiguousarray(data).view(np.dtype((np.void, data.shape[1] * data.itemsize))).ravel()
    by_id = np.argsort(ids, kind="stable")
    _, kind, copies = np.unique(whole[by_id], return_inverse=True, return_counts=True)
    if copies.max() <= k:
        return by_id
    order = np.argsort(kind, kind="stable")
    kind, own = kind[order], ids[by_id][order]
    new_kind = np.append(True, kind[1:] != kind[:-1])
    new_id = new_kind | np.append(True, own[1:] != own[:-1])
    at = np.arange(len(own))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    id_number = np.cumsum(new_id)
    nth_id = id_number - np.maximum.accumulate(np.where(new_kind, id_number, 0))
    return by_id[np.sort(order[(nth_id <= k) & (nth_row < k)])]


def _pack(rows: DataFrame, kind: int, parts: int, k: int, scale: int, size: int, seeds: Broadcast | None = None) -> DataFrame:
    """Rows (id, v) as blocks of equal-length vectors: candidates (kind 0) by part, queries (kind 1) of at most ``size``.

    Components are floor(scale * x) in 16 bits (narrow) if all of a vector's fit, else as they were.
    Narrow queries carry a floor: one less than their k-th best score among ``seeds``, which are candidates too.
    """
    groups: dict[int, Group] = {}

    def floors(dim: int, ids: np.ndarray, q: np.ndarray) -> bytes | None:
        if seeds is None or dim not in seeds.value:
            return None
        if dim not in groups:
            groups[dim] = Group(*seeds.value[dim], _TILE)
        row, _, score = groups[dim].best(ids, q, k)
        last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
        out = np.full(len(ids), np.iinfo(np.int64).min)
        out[row[last]] = score[last] - 1
        return out.tobytes()

    def blocks(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        dim = x.shape[1]
        scaled = np.floor(x * scale)
        fits = (np.abs(scaled) < 2**15).all(axis=1) if dim else np.zeros(len(x), dtype=bool)
        for narrow, rows_of, values in ((True, fits, scaled), (False, ~fits, x)):
            own, data = ids[rows_of], values[rows_of].astype(np.int16 if narrow else np.float64)
            if not len(own):
                continue
            if kind:
                for a in range(0, len(own), size):
                    some, q = own[a : a + size], data[a : a + size]
                    yield 0, kind, dim, narrow, some.tobytes(), q.tobytes(), floors(dim, some, q) if narrow else None
                continue
            if dim:
                left = _trim(own, data, k)
                own, data = own[left], data[left]
            digest = _digest(data)
            part = (digest % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p] : cuts[p + 1]]
                yield int(p), kind, dim, narrow, own[at].tobytes(), data[at].tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _by_length(batches, size if kind else 1):
            with np.errstate(over="ignore"):
                made = list(blocks(ids, x))
            for a in range(0, len(made), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made[a : a + 64]), _BLOCK_ARROW)], schema=_BLOCK_ARROW)

    return rows.mapInArrow(run, _BLOCK)


def _digest(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row."""
    out = np.full(len(data), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for column in (data.view(np.uint16) if data.dtype == np.int16 else data.view(np.uint64)).T:
        out = (out ^ column.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _by_length(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and float64 matrices of the sound vectors, by length, gathered to ``least`` rows where there are so many."""
    held: dict[int, list] = {}

    def emit(dim: int) -> tuple[np.ndarray, np.ndarray]:
        ids, parts = zip(*held.pop(dim))
        return np.concatenate(ids), np.concatenate(parts)

    for batch in batches:
        ids, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        flat = lists.flatten()
        null = np.asarray(flat.is_null()) if flat.null_count else None
        values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        bad = ~np.isfinite(values)
        if null is not None:
            bad |= null
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            at = starts[rows][:, None] + np.arange(dim)
            rows_sound = ~bad[at].any(axis=1)
            if rows_sound.any():
                held.setdefault(dim, []).append((ids[rows][rows_sound], values[at[rows_sound]]))
                if sum(len(i) for i, _ in held[dim]) >= least:
                    yield emit(dim)
    for dim in list(held):
        yield emit(dim)


def _statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment means and deviations, each times the root of the length: their dot products add up to the bound."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    n = np.diff(cuts)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / n
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / n
    return mean * np.sqrt(n), np.sqrt(np.maximum(0, square - mean * mean) * n)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what holds; faster than nonzero of a matrix where little does."""
    return np.divmod(np.flatnonzero(mask), mask.shape[1])


class Group:
    """Candidates of one length in order of their ids, as whole numbers, with the statistics of their tiles."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, tile: int) -> None:
        self.ids, self.x, n = ids, x, len(ids)
        first = max(1, tile // 2)
        self.tiles = [(0, min(first, n)), *((a, min(a + tile, n)) for a in range(first, n, tile))]
        self.levels = [s for s in _LEVELS if 2 * s <= x.shape[1]] or [1]
        self.norm = 0.0
        ranges: list[list] = [[] for _ in self.levels]
        for a, b in self.tiles:
            part = x[a:b].astype(np.float64)
            self.norm = max(self.norm, float(np.sqrt(np.einsum("ij,ij->i", part, part).max())))
            for s, out in zip(self.levels, ranges):
                mean, deviation = _statistics(part, s)
                out.append(np.concatenate([mean.max(axis=0), mean.min(axis=0), deviation.max(axis=0)]))
        self.ranges = [np.array(r) for r in ranges]

    def tile_bounds(self, statistics: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """No candidate of a tile scores more with a query (queries x tiles)."""
        found = [np.concatenate([np.maximum(m, 0), np.minimum(m, 0), d], axis=1) @ r.T for (m, d), r in zip(statistics, self.ranges)]
        return np.minimum.reduce(found)

    def best(self, q_ids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Exact best k for every row of ``q`` (whole numbers): number of the row, id and score.

        With ``floor``, scores of at most that, a whole number for every row, are left out.
        """
        qf = q.astype(np.float64)
        reach = float(np.sqrt(np.einsum("ij,ij->i", qf, qf).max())) * self.norm
        # By Cauchy and Schwarz no partial sum exceeds this, in whatever order it is made.
        kind = np.float32 if reach < 2**23 else np.float64 if reach < 2**52 else np.int64
        slack = 1e-4 * reach + 1
        typed, nothing = q.astype(kind), (-np.inf if kind != np.int64 else np.iinfo(np.int64).min)
        statistics = [_statistics(qf, s) for s in self.levels]
        joint = [np.concatenate(s, axis=1) for s in statistics]
        bounds = self.tile_bounds(statistics)
        low, high = np.searchsorted(self.ids, q_ids, "left"), np.searchsorted(self.ids, q_ids, "right")
        seeded = floor is not None
        least = np.full(len(q), nothing, dtype=kind)
        if seeded:
            # No score is beyond the reach; what asks for more leaves all out either way, in whatever type.
            least[:] = np.clip(floor, -int(reach) - 2, int(reach) + 2)
        state = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind))
        waiting: list[tuple] = []
        level: int | None = -1
        widest = max(b - a for a, b in self.tiles)
        room = np.empty(_ROWS * widest, dtype=kind)

        def merge() -> None:
            nonlocal state
            row, at, score = (np.concatenate(c) for c in zip(state, *waiting))
            waiting.clear()
            order = np.lexsort((at, -score, row))
            row, at, score = row[order], at[order], score[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            kept = nth < k
            state = (row[kept], at[kept], score[kept])
            last = nth == k - 1
            least[row[last]] = score[last]

        for number, (a, b) in enumerate(self.tiles):
            rows = np.flatnonzero(bounds[:, number] + slack > least)
            if not len(rows):
                continue
            part = self.x[a:b].astype(kind)
            if number and level == -1:
                level = self._probe(joint, part, rows, least, slack, q.shape[1])
            if number and level is not None:
                bound = joint[level][rows] @ np.concatenate(_statistics(part.astype(np.float64), self.levels[level]), axis=1).T
                r, c = _where(bound + slack > least[rows][:, None])
                r = rows[r]
                score = np.concatenate([np.einsum("ij,ij->i", typed[r[i : i + 65536]], part[c[i : i + 65536]]) for i in range(0, len(r), 65536)] or [least[:0]])
                better = (score > least[r]) & ((a + c < low[r]) | (a + c >= high[r]))
                r, c, score = r[better], c[better], score[better]
            else:
                # Few queries at a time, so that their scores are still in the processor's cache when they are compared.
                some = [rows[i : i + _ROWS] for i in range(0, len(rows), _ROWS)]
                found = [self._scored(typed, own, part, a, least, low, high, nothing, 0 if number or seeded else k, room) for own in some]
                r, c, score = (np.concatenate(e) for e in zip(*found))
            if len(r):
                waiting.append((r, a + c, score))
            if waiting and (not number or sum(len(w[0]) for w in waiting) > 2 * len(q)):
                merge()
        if waiting:
            merge()
        row, at, score = state
        return row, self.ids[at], score.astype(np.int64)

    def _scored(self, typed: np.ndarray, rows: np.ndarray, part: np.ndarray, a: int, least: np.ndarray, low: np.ndarray, high: np.ndarray, nothing: float, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place in the tile from ``a`` on and score of all pairs above their query's least, without its own id.

        With ``k``, the tile gives the first thresholds: only its k best of a query and their equals stay.
        """
        n = len(part)
        scores = room[: len(rows) * n].reshape(len(rows), n)
        np.matmul(typed[rows], part.T, out=scores)
        if n > k > 0:
            for i in np.flatnonzero((low[rows] < a + n) & (high[rows] > a) & (low[rows] < high[rows])):
                scores[i, max(low[rows[i]] - a, 0) : high[rows[i]] - a] = nothing
            r, c = _where(scores >= np.partition(scores, n - k, axis=1)[:, n - k, None])
            score = scores[r, c]
        else:
            some = np.flatnonzero(scores.max(axis=1) > least[rows])
            scores, rows = scores[some], rows[some]
            r, c = _where(scores > least[rows][:, None])
            score = scores[r, c]
        r = rows[r]
        kept = (score > least[r]) & ((a + c < low[r]) | (a + c >= high[r]))
        return r[kept], c[kept], score[kept]

    def _probe(self, joint: list[np.ndarray], part: np.ndarray, rows: np.ndarray, least: np.ndarray, slack: float, dim: int) -> int | None:
        """The level whose bounds and survivors cost least; None if scoring all pairs costs less."""
        some = rows[:: max(1, len(rows) // 64)]
        costs = [float(dim)]
        for s, own in zip(self.levels, joint):
            bound = own[some] @ np.concatenate(_statistics(part.astype(np.float64), s), axis=1).T
            # Bounds are in doubles, which take twice as long, and each tile's statistics are made again.
            costs.append(8 + 4 * s + _SINGLE * float((bound + slack > least[some][:, None]).mean()))
        cheapest = int(np.argmin(costs))
        return cheapest - 1 if cheapest else None


def _wide(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of all components as Python integers; whole doubles are scaled as integers, so none overflows."""
    whole = [int(e) * scale if abs(e) >= 2.0**53 else int(np.floor(e * scale)) for e in v.ravel().tolist()]
    return np.array([*whole, None], dtype=object)[:-1].reshape(v.shape)


def _magnitude(score: int) -> str | None:
    """What orders scores that a long can't hold: digits after their number, complemented below zero."""
    if abs(score) < _LONG:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"1{len(digits):06d}{digits}"
    return f"0{999_999 - len(digits):06d}" + "".join(str(9 - int(c)) for c in digits)


class _Held:
    """The candidates of one group and length: narrow ones together, others block by block."""

    def __init__(self, tile: int) -> None:
        self.tile = tile
        self.narrow: list[tuple] = []
        self.wide: list[tuple] = []
        self.group: Group | None = None

    def add(self, narrow: bool, ids: np.ndarray, x: np.ndarray) -> None:
        (self.narrow if narrow else self.wide).append((ids, x))

    def search(self, narrow: bool, q_ids: np.ndarray, q: np.ndarray, k: int, scale: int, floor: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if self.narrow and self.group is None:
            ids, x = (np.concatenate(c) for c in zip(*self.narrow))
            self.narrow[1:] = []
            order = _trim(ids, x, k)
            self.group = Group(ids[order], x[order], self.tile)
            self.narrow[0] = (self.group.ids, self.group.x)
        if self.group is not None and narrow:
            yield _found(q_ids, *self.group.best(q_ids, q, k, floor))
        others = self.wide if narrow else [*((*n, True) for n in self.narrow), *self.wide]
        for ids, x, *small in others:
            yield _searched(q_ids, q, narrow, ids, x, bool(small), k, scale, self.tile)


def _found(q_ids: np.ndarray, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids), pa.array(score), pa.nulls(len(ids), pa.string())], schema=_FOUND_ARROW)


def _searched(q_ids: np.ndarray, q: np.ndarray, q_narrow: bool, ids: np.ndarray, x: np.ndarray, x_narrow: bool, k: int, scale: int, tile: int) -> pa.RecordBatch:
    """Best k of a block of which not all fits 16 bits: by bounds where 64 bits hold all scores, else one by one."""
    with np.errstate(over="ignore", invalid="ignore"):
        qw, xw = (v.astype(np.float64) if small else np.floor(v * scale) for v, small in ((q, q_narrow), (x, x_narrow)))
        room = max(1, q.shape[1]) * np.abs(qw).max(initial=1) * np.abs(xw).max(initial=1)
    if room < _NARROW and q.shape[1]:
        order = np.argsort(ids, kind="stable")
        return _found(q_ids, *Group(ids[order], xw[order].astype(np.int64), tile).best(q_ids, qw.astype(np.int64), k))
    qw, xw = (v.astype(object) if small else _wide(v, scale) for v, small in ((q, q_narrow), (x, x_narrow)))
    rows = []
    for i, own in enumerate(q_ids.tolist()):
        scores = [(-sum(map(mul, map(int, qw[i]), map(int, v))), other) for other, v in zip(ids.tolist(), xw) if other != own]
        rows += [(own, other, max(-_LONG, min(_LONG, -s)), _magnitude(-s)) for s, other in heapq.nsmallest(k, scores)]
    columns = zip(*rows) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _FOUND_ARROW)], schema=_FOUND_ARROW)


def _seeds(rows: DataFrame, k: int, scale: int) -> Broadcast:
    """Ids, in order, and 16-bit components of the narrow rows, by their length."""
    found: dict[int, list] = {}
    for r in _pack(rows, 0, 1, k, scale, 0).where("narrow").select("dim", "ids", "data").collect():
        ids = np.frombuffer(r["ids"], dtype=np.int64)
        found.setdefault(r["dim"], []).append((ids, np.frombuffer(r["data"], dtype=np.int16).reshape(len(ids), r["dim"])))
    sorted_by_id = {}
    for dim, parts in found.items():
        ids, x = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(ids, kind="stable")
        sorted_by_id[dim] = ids[order], x[order]
    return rows.sparkSession.sparkContext.broadcast(sorted_by_id)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = 1024, block: int = _TILE, group_bytes: int = GROUP_BYTES, seed_bytes: int = SEED_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best candidates."""
    spark = vectors.sparkSession
    kind = vectors.select(F.col(vector_col).alias("v")).schema["v"].dataType.elementType.simpleString()
    v = F.col(vector_col) if kind in ("float", "double") else F.col(vector_col).cast("array<double>")
    known = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull())
    own = [F.col(id_col).cast("long").alias("id"), v.alias("v")]
    held = known.agg(F.sum(F.size(F.col(vector_col)).cast("long")).alias("n")).first()["n"] or 0
    parts = max(2 * spark.sparkContext.defaultParallelism, math.ceil(2 * held / group_bytes))
    data = _pack(known.select(*own), 0, parts, k, scale, 0)
    # Whatever the sample, no result changes: a threshold is a score of rows that take part.
    seeds = _seeds(known.select(*own).where(F.rand(7) < seed_bytes / (2 * held)), k, scale) if 2 * held > group_bytes else None
    asked = _pack(known.where(is_query).select(*own).distinct(), 1, parts, k, scale, query_block, seeds)
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = data.unionByName(asked).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held_of = None, {}
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if r[0] != part:
                    part, held_of = r[0], {}
                ids = np.frombuffer(r[4], dtype=np.int64)
                x = np.frombuffer(r[5], dtype=np.int16 if r[3] else np.float64).reshape(len(ids), r[2])
                if r[1] == 0:
                    held_of.setdefault(r[2], _Held(block)).add(r[3], ids, x)
                elif r[2] in held_of:
                    floor = None if r[6] is None else np.frombuffer(r[6], dtype=np.int64)
                    yield from held_of[r[2]].search(r[3], ids, x, k, scale, floor)

    found = met.mapInArrow(run, _FOUND)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
