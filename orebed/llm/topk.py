"""Exact top-k search on an impact-ordered index, score at a time.

Components are integers floor(scale * x). The index of a block of vectors holds a posting
(dimension, vector, component) for each component that is not zero, in segments of equal
dimension and impact, the component's magnitude quantised to ``levels`` steps that hold
about as many postings each; segments lie by falling impact. For
every vector it also holds the length of what segments below each impact can still add.

A query adds segments to its accumulators by falling impact. After each impact, a vector's
score exceeds its sum so far by no more than the length of its unread components times the
length of the query's components at these places. The k vectors with the greatest sums are
scored exactly, and with them the k-th best score from blocks before: the best of these is a
floor, and a vector may be a member only if its upper bound reaches it. The rest of the segments is left unread when
scoring the possible members exactly costs less than reading on, which the bounds make
safe at any point; the possible members are then scored exactly over whole vectors. Blocks
whose greatest components cannot reach the k-th best score so far are not opened at all.

Query blocks and index blocks are dealt to groups by hash, a few index blocks to each, and
every query group meets every index group; each meeting leaves at most k rows a query, merged by rank.

Defined cases: vectors null or holding null, NaN or infinite components take no part, as
queries or candidates; shorter vectors count as ending in zeros; an empty vector scores 0
with all; a null id takes no part; repeated rows are vectors of their own, but none is
returned for a query of the same id; ties go to the smaller id; extra columns are ignored;
empty tables give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

RESULT = "query_id long, vec_id long, score long"


@dataclass(frozen=True)
class TopkParams:
    k: int = 5
    scale: int = 256
    block: int = 4096  # vectors in a block of the index
    queries: int = 512  # vectors in a block of queries
    levels: int = 8  # impacts
    lane: int = 8  # blocks of the index in one group, about
    rescore_cost: float = 4.0  # of one component of a candidate, fetched and scored, in postings read


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(id, v) with integer components; only vectors that take part."""
    x = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("v"))


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, width, data) rows of at most ``size`` vectors each, packed task by task."""

    def run(batches):
        ids, flat = [], []

        def out():
            width = max(map(len, flat), default=0)
            m = np.zeros((len(flat), width), np.int64)
            for r, v in enumerate(flat):
                m[r, : len(v)] = v
            return pa.record_batch([pa.array([np.array(ids, np.int64).tobytes()]), pa.array([width], pa.int64()), pa.array([m.tobytes()])], names=["ids", "width", "data"])

        for batch in batches:
            col = batch.column(1)
            values, offsets = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            offsets = offsets - offsets[0]
            for r, i in enumerate(batch.column(0).to_pylist()):
                ids.append(i)
                flat.append(values[offsets[r] : offsets[r + 1]])
                if len(ids) == size:
                    yield out()
                    ids, flat = [], []
        if ids:
            yield out()

    return rows.mapInArrow(run, "ids binary, width long, data binary")


class Segments:
    """The impact-ordered postings of one block of vectors."""

    def __init__(self, m: np.ndarray, levels: int) -> None:
        self.whole, self.levels = m, levels
        n, width = m.shape
        size = np.abs(m).astype(np.float64)
        some = size[size > 0]
        steps = np.quantile(some, np.arange(1, levels) / levels) if len(some) else np.zeros(levels - 1)
        impact = np.searchsorted(steps, size, "right")
        self.low, self.high = (f(axis=0, initial=0) if n else np.zeros(width, np.int64) for f in (m.min, m.max))
        order = np.argsort((levels - 1 - impact) * width + np.arange(width), axis=None, kind="stable")
        order = order[m.ravel()[order] != 0]
        self.place, self.dim = order // max(1, width), order % max(1, width)
        self.value = m.ravel()[order].astype(np.float64)
        level = levels - 1 - impact.ravel()[order]
        self.cuts = np.searchsorted(level, np.arange(levels + 1))  # postings before each impact
        squares = size**2
        self.length = np.sqrt(squares.sum(1))
        self.left = [np.sqrt((squares * (impact < levels - 1 - k)).sum(1)) for k in range(levels)]

    def reach(self, q: np.ndarray) -> np.ndarray:
        """What the greatest components could add up to, for each query."""
        wide = q.astype(np.float64)
        return np.maximum(wide, 0) @ self.high.astype(np.float64) + np.minimum(wide, 0) @ self.low.astype(np.float64)

    def search(self, q: np.ndarray, own: np.ndarray, k: int, floor: float, rescore_cost: float) -> tuple[np.ndarray, int]:
        """Places that may be among the k best and reach ``floor``, and the postings read. own: places that take no part."""
        n, width = self.whole.shape
        wide = q.astype(np.float64)
        square = wide**2
        length, unread = float(np.sqrt(square.sum())), np.full(n, square.sum())
        sums = np.zeros(n)
        sums[own] = -np.inf
        k, total, may = min(k, n), len(self.place), np.ones(n, bool)
        for level in range(self.levels):
            lo, hi = self.cuts[level], self.cuts[level + 1]
            if lo < hi:
                place, dim = self.place[lo:hi], self.dim[lo:hi]
                sums += np.bincount(place, weights=wide[dim] * self.value[lo:hi], minlength=n)
                unread -= np.bincount(place, weights=square[dim], minlength=n)
            slack = np.sqrt(np.maximum(unread, 0)) * self.left[level] + 1e-9 * length * self.length + 1e-6
            first = np.argpartition(sums, n - k)[n - k :]  # scored exactly, they set a floor
            scores = np.where(sums[first] > -np.inf, exact_products(self.whole[first], q).astype(np.float64), -np.inf)
            floor = max(floor, float(scores.min()) * (1 - 1e-12 * np.sign(scores.min())) if scores.min() > -np.inf else -np.inf)
            may = (sums + slack >= floor) & (sums > -np.inf)
            if may.sum() * width * rescore_cost <= total - hi:
                return np.flatnonzero(may), int(hi)
        return np.flatnonzero(may), total


def exact_products(whole: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products; by Python's integers where 64 bits could overflow."""
    top = float(np.abs(whole).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, whole.shape[1])
    return whole @ q if top < 2**62 else np.array([int(sum(int(a) * int(b) for a, b in zip(row, q, strict=True))) for row in whole], object)


def meet(p: TopkParams):
    """Scores the query blocks of a group against its index blocks; at most k rows a query."""

    def matrix(data: bytes, rows: int, width: int, to: int) -> np.ndarray:
        m = np.frombuffer(data, np.int64).reshape(rows, width)
        return np.pad(m, ((0, 0), (0, to - width)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max([0, *left.column("qwidth").to_pylist(), *right.column("width").to_pylist()])
        index = []
        for ids, w, data in zip(*(right.column(c).to_pylist() for c in ("ids", "width", "data")), strict=True):
            ids = np.frombuffer(ids, np.int64)
            index.append((ids, Segments(matrix(data, len(ids), w, width), p.levels)))
        out: list[list] = [[], [], []]
        for qids, w, data in zip(*(left.column(c).to_pylist() for c in ("qids", "qwidth", "qdata")), strict=True) if len(index) else ():
            qids = np.frombuffer(qids, np.int64)
            q = matrix(data, len(qids), w, width)
            reach = np.stack([seg.reach(q) for _, seg in index])
            for i, own in enumerate(qids.tolist()):
                found_s: list[int] = []
                found_v: list[int] = []
                for b in np.argsort(-reach[:, i], kind="stable"):
                    ids, seg = index[b]
                    floor = float(found_s[-1]) if len(found_s) == p.k else -np.inf
                    if reach[b, i] + 1e-9 * abs(reach[b, i]) + 1e-6 < floor:
                        break  # nor can any block after it
                    at, _ = seg.search(q[i], np.flatnonzero(ids == own), p.k, floor, p.rescore_cost)
                    s, v = [*found_s, *exact_products(seg.whole[at], q[i]).tolist()], [*found_v, *ids[at].tolist()]
                    pick = sorted(range(len(s)), key=lambda x, s=s, v=v: (-s[x], v[x]))[: p.k]
                    found_s, found_v = [s[x] for x in pick], [v[x] for x in pick]
                out[0] += [own] * len(found_s)
                out[1] += found_v
                out[2] += found_s
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, p: TopkParams = TopkParams()) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all vectors but its own. Both have vec_id, embedding."""
    scratch = Scratch(vectors.sparkSession, "topk")
    packed = scratch.keep(blocks(usable(vectors, p.scale), p.block), "blocks")
    asked = scratch.keep(blocks(usable(queries, p.scale), p.queries).toDF("qids", "qwidth", "qdata"), "queries")
    lanes, groups = max(1, -(-packed.count() // p.lane)), max(1, asked.count())

    def every(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.withColumn("a", F.pmod(F.xxhash64("qids"), F.lit(groups)).cast("int")).withColumn("b", every(lanes))
    right = packed.withColumn("b", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int")).withColumn("a", every(groups))
    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(meet(p), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
