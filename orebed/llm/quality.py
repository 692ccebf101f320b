"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network.

Random indexing: a unit (a word, its ending, its shape, or its shape with what follows) has
a sparse random index vector, drawn by hash. Its context vector is the sum, over all texts
outside the held-out fold, of the index vectors of its neighbours up to ``reach`` words away,
added up task by task in tables of hashed units. A unit's vector is its context vector at length one;
a unit without context there has its index vector, at length one too. A document's vector is the mean of
its units' vectors, block by block, with each block's length, the share of words that
repeat the one before, and the lengths of text and words. A network of two layers, trained
with numpy on all labelled rows outside the held-out fold, gives a logit; a temperature fitted on the sixth of
them that is kept apart makes it a probability. Labels, lang, source and doc_id are no inputs.

Training: labelled rows are dealt by hash into groups of about ``group`` rows, which stay in
the shared folder. In each of ``epochs`` passes every group goes on from the same weights in
small batches, and the weights (and the moments of the gradient) they reach are averaged by rows.
Averages are sums of whole numbers, so neither the order nor the place of the work changes them.
The driver holds the weights and two sums a feature of each group, never the rows. Every document is scored whole.

Defined cases: null or empty text is the zero vector and gets a score like any other; a
null doc_id counts as not held out; repeated rows get equal scores; several labels of one
document are all used, null labels are not; extra columns are ignored; an empty table
gives an empty result; with no labels at all every score is 0.5. Whole texts are pooled;
a tie of scores needs no rule, as each score stands for itself.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch

#: Kinds of units, the width of their vectors, and the places of their hashed tables.
BLOCKS = (("word", 32, 1 << 15), ("end", 32, 1 << 12), ("shape", 48, 1 << 12), ("follow", 48, 1 << 14))
BATCH = 1 << 19  # bytes of text worked on at once
PAIRS = 1 << 18  # pairs of neighbours added up at once
SHRINK = 16  # words' worth of nothing that every mean holds, so that few words weigh little
TEMPERATURES = np.geomspace(0.5, 8, 41)
ONE = float(1 << 40)  # what stands for 1 in sums of whole numbers
WIDTH = sum(d for _, d, _ in BLOCKS) + len(BLOCKS) + 3
SCHEMA = "doc_id long, score double"
_KIND = np.full(256, 4, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 common punctuation, 4 other signs, 5 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 5
_KIND[np.frombuffer(b".,;:'\"()-?", np.uint8)] = 3


@dataclass(frozen=True)
class QualityParams:
    group: int = 4096  # labelled rows that are worked on in one place, about
    reach: int = 2  # words to either side that are a word's context
    rows: int = 128  # table rows in one piece of a task's sums
    hidden: int = 32
    epochs: int = 30
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    threshold: float = 0.3
    seed: int = 5


def word_keys(data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray, same_row: np.ndarray) -> list[np.ndarray]:
    """The hash of each word's unit, block by block; it draws the unit's index vector and its place."""
    kind = _KIND[data]
    n = (e - s).astype(np.uint64)
    shape = np.minimum(n // np.uint64(3), np.uint64(6)) * np.uint64(6) + kind[s]
    shape = shape * np.uint64(6) + kind[e - 1]
    for k in (1, 2, 4):
        total = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        shape = shape * np.uint64(3) + np.minimum(total[e] - total[s], 2).astype(np.uint64)
    end = data[e - 1].astype(np.uint64) * np.uint64(256) + data[np.maximum(e - 2, s)]
    after, repeat = np.zeros_like(shape), np.zeros(len(h), bool)
    if len(h) > 1:
        after[:-1] = np.where(same_row[:-1], shape[1:] + np.uint64(1), np.uint64(0))
        repeat[:-1] = same_row[:-1] & (h[1:] == h[:-1])
    context = tk.mix(shape * np.uint64(0x9E3779B97F4A7C15) + after) * np.uint64(2) + repeat
    return [h, tk.mix(end + np.uint64(1 << 40)), tk.mix(shape + np.uint64(1 << 41)), tk.mix(context)]


def places(key: np.ndarray, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two places of an index vector of width d that are not zero, with their signs."""
    out = []
    for k in range(2):
        part = key >> np.uint64(20 * k)
        out.append(((part % np.uint64(d)).astype(np.int64), 1.0 - 2.0 * ((part >> np.uint64(12)) & np.uint64(1)).astype(float)))
    return out


def bucket(key: np.ndarray, size: int) -> np.ndarray:
    return (tk.mix(key) % np.uint64(size)).astype(np.int64)


def unit_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Row and hash of each word, its units block by block, and words before each row."""
    h, s, e, at = tk.words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    same_row = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
    return row, h, word_keys(data, h, s, e, same_row) if len(h) else [h] * len(BLOCKS), at


def context_sums(data: np.ndarray, offsets: np.ndarray, reach: int) -> list[np.ndarray]:
    """For each block the sums of the neighbours' index vectors at the places of its units."""
    row, h, keys, _ = unit_rows(data, offsets)
    pairs = []
    for step in range(1, reach + 1):
        first = np.flatnonzero(row[step:] == row[:-step])
        pairs += [(first[lo : lo + PAIRS], first[lo : lo + PAIRS] + step) for lo in range(0, len(first), PAIRS)]
    out = []
    for (_, d, size), key in zip(BLOCKS, keys, strict=True):
        total = np.zeros(size * d)
        own = bucket(key, size) * d
        index = places(key, d)
        for a, b in pairs:
            at = [own[i] + place[j] for place, _ in index for i, j in ((a, b), (b, a))]
            total += np.bincount(np.concatenate(at), np.concatenate([sign[j] for _, sign in index for j in (b, a)]), size * d)
        out.append(total.reshape(size, d))
    return out


def unit_vectors(sums: list[np.ndarray]) -> list[np.ndarray]:
    """Context vectors at length one; zero where there is no context."""
    return [(x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)).astype(np.float32) for x in sums]


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: list[np.ndarray]) -> np.ndarray:
    """One vector per row."""
    rows = len(offsets) - 1
    row, h, keys, at = unit_rows(data, offsets)
    out = np.zeros((rows, WIDTH), np.float32)
    counts = np.diff(at)
    if not len(h):
        return out
    per = counts[:, None] + SHRINK
    lo = 0
    for b, ((_, d, size), key, table) in enumerate(zip(BLOCKS, keys, vectors, strict=True)):
        own = bucket(key, size)
        vector = np.zeros((rows, d))
        for at_word in range(0, len(h), 1 << 16):  # a bounded number of words at a time
            part = slice(at_word, at_word + (1 << 16))
            heads = np.flatnonzero(np.concatenate([[True], row[part][1:] != row[part][:-1]]))
            np.add.at(vector, row[part][heads], np.add.reduceat(table[own[part]], heads, axis=0))
        lone = ~table.any(1)[own]  # no context in the sample: the index vector
        if lone.any():
            for place, sign in places(key[lone], d):
                vector += np.bincount(row[lone] * d + place, sign / np.sqrt(2), rows * d).reshape(rows, d)
        vector /= per
        out[:, lo : lo + d] = vector
        out[:, WIDTH - 3 - len(BLOCKS) + b] = np.sqrt((vector**2).sum(1))
        lo += d
    again = np.zeros(len(h), bool)
    again[1:] = (row[1:] == row[:-1]) & (h[1:] == h[:-1])
    out[:, -3] = np.bincount(row, weights=again, minlength=rows) / per[:, 0]
    out[:, -2] = np.log1p(counts) / 5
    out[:, -1] = np.diff(offsets) / (per[:, 0] * 10)
    return out


def moments(x: np.ndarray) -> np.ndarray:
    """Rows, sums and sums of squares."""
    x = x.astype(float)
    return np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)])


def apart(group: int, n: int, q: QualityParams) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a group that are kept apart for the temperature, and those that are trained on."""
    order = np.random.default_rng([q.seed, group]).permutation(n)
    cut = max(1, n // 6)
    return order[:cut], order[cut:] if n > 1 else order


def split(state: np.ndarray, q: QualityParams) -> list[np.ndarray]:
    """The weights w1, b1, w2, b2, their first moments, the roots of their second ones, and what both lack to be unbiased."""
    shapes = [(WIDTH, q.hidden), (q.hidden,), (q.hidden,), (1,)] * 3 + [(2,)]
    ends = np.cumsum([int(np.prod(k)) for k in shapes])
    return [part.reshape(k).copy() for part, k in zip(np.split(state, ends[:-1]), shapes, strict=True)]


def passed(state: np.ndarray, mean: np.ndarray, scale: np.ndarray, q: QualityParams, epoch: int, group: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What one pass over a group makes of the state, times the group's rows, and these rows; in whole numbers."""
    *parts, lack = split(state, q)
    params, m, v = parts[:4], parts[4:8], [r**2 for r in parts[8:]]
    used = np.random.default_rng([q.seed, group, epoch]).permutation(apart(group, len(x), q)[1])
    z, y = np.clip((x[used] - mean) / scale, -8, 8), y[used]
    for lo in range(0, len(used), q.batch):
        zs, ys = z[lo : lo + q.batch], y[lo : lo + q.batch]
        hid = np.tanh(zs @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(hid @ params[2] + params[3], -30, 30)))
        d = (p - ys) / len(ys)
        dh = np.outer(d, params[2]) * (1 - hid**2)
        lack = lack * (0.9, 0.999)
        for k, g in enumerate((zs.T @ dh, dh.sum(0), hid.T @ d, np.array([d.sum()]))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g**2
            params[k] -= q.rate * ((m[k] / (1 - lack[0])) / (np.sqrt(v[k] / (1 - lack[1])) + 1e-8) + q.decay * params[k])
    reached = np.concatenate([np.ravel(k) for k in (*params, *m, *map(np.sqrt, v), lack, 1.0)])
    return np.rint(reached * (len(used) / q.group * ONE)).astype(np.int64)


class Network:
    """The units' vectors and the layers over pooled rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, q: QualityParams, vectors: list[np.ndarray] | None = None) -> None:
        """Trained on rows that are all here; fit() trains on groups of rows elsewhere."""
        self.vectors = vectors if vectors is not None else [np.zeros((size, d), np.float32) for _, d, size in BLOCKS]
        rng = np.random.default_rng(q.seed)
        self.mean, self.scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        self.w1 = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, q.hidden))
        self.b1, self.w2, self.b2 = np.zeros(q.hidden), rng.normal(0, 1 / np.sqrt(q.hidden), q.hidden), 0.0
        self.temperature, self.blank = 1.0, True
        if len(x):
            self.train(moments(x), lambda work: work(0, x, y), q)

    def train(self, sums: np.ndarray, total: Callable, q: QualityParams) -> None:
        """sums: moments of all rows; total(work): the sum of work(group, x, y) over all groups of rows."""
        n, first, second = sums[0], sums[1 : 1 + WIDTH], sums[1 + WIDTH :]
        self.mean = (first / n).astype(np.float32)
        self.scale = (np.sqrt(np.maximum(second / n - (first / n) ** 2, 0)) + 1e-3).astype(np.float32)
        params = [self.w1, self.b1, self.w2, np.array([self.b2])]
        state = np.concatenate([np.ravel(k) for k in (*params, *[np.zeros_like(k) for k in params * 2], np.ones(2))])
        for epoch in range(q.epochs):
            got = total(partial(passed, state, self.mean, self.scale, q, epoch))
            state = got[:-1] / got[-1]
        self.w1, self.b1, self.w2, b2 = split(state, q)[:4]
        self.b2, self.blank = float(b2[0]), False
        self.temperature = float(TEMPERATURES[np.argmin(total(partial(losses, self.layers(), q)))])

    def layers(self) -> Network:
        """The same network without the units' vectors."""
        out = Network(np.zeros((0, WIDTH), np.float32), np.zeros(0), QualityParams(), [])
        out.__dict__.update({k: x for k, x in self.__dict__.items() if k != "vectors"})
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score_texts(self, texts: pa.Array) -> np.ndarray:
        return self.score(pooled(*tk.text_buffers(texts), self.vectors))

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.blank else 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def losses(net: Network, q: QualityParams, group: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The loss of the group's rows kept apart by each temperature, in whole numbers."""
    held = apart(group, len(x), q)[0]
    logit = net.logit(x[held])
    signed = np.where(y[held] > 0, -logit, logit)
    return np.rint([np.logaddexp(0, signed / t).sum() * (1 << 30) for t in TEMPERATURES]).astype(np.int64)


def remainder(modulus: int) -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def fit(documents: DataFrame, labels: DataFrame, q: QualityParams = QualityParams()) -> Network:
    """Fits context vectors on all texts and the network on all labelled rows outside the held-out fold."""
    known = labels.where("quality is not null and doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(quality as float) y").where(remainder(5) != 0)
    model, rows = Network(np.zeros((0, WIDTH), np.float32), np.zeros(0), q), known.count()
    if not rows:
        return model
    texts = documents.selectExpr("cast(doc_id as long) doc_id", "text").where(F.coalesce(remainder(5) != 0, F.lit(True)))
    scratch = Scratch(documents.sparkSession, "quality")
    model.vectors = unit_vectors(corpus_sums(texts.select("text"), q))
    scratch.free_shuffles()
    shared = documents.sparkSession.sparkContext.broadcast(model.vectors)

    def run(batches):
        for batch in tk.sized_batches(batches, BATCH):
            x = pooled(*tk.text_buffers(batch.column(1)), shared.value)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    # Vectors meet the labels, as they take less room than texts; labels grow with the corpus, so neither side is sent to all tasks.
    rows_x = texts.where("doc_id is not null").mapInArrow(run, "doc_id long, x binary").join(known.hint("merge"), "doc_id")
    rows_x = rows_x.withColumn("g", F.pmod(F.xxhash64("doc_id", "y", "x"), F.lit(-(-rows // q.group))))
    groups = scratch.keep(rows_x.groupBy("g").applyInArrow(grouped, "g long, y binary, x binary, sums binary"), "groups")  # read in each pass
    sums = {r["g"]: np.frombuffer(r["sums"]) for r in groups.select("g", "sums").collect()}
    if sums:
        model.train(np.sum([sums[g] for g in sorted(sums)], axis=0), partial(over_groups, groups), q)
    shared.unpersist()
    scratch.drop("groups")
    return model


def grouped(rows: pa.Table) -> pa.Table:
    """The rows of a group as one, in an order that does not depend on how they arrive."""
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    y = rows.column("y").to_numpy().astype(np.float32)
    order = np.lexsort((*x.T[:4], y, rows.column("doc_id").to_numpy()))
    x, y = x[order], y[order]
    return pa.table({"g": rows.column("g")[:1], "y": pa.array([y.tobytes()], pa.binary()), "x": pa.array([x.tobytes()], pa.binary()), "sums": pa.array([moments(x).tobytes()], pa.binary())})


def over_groups(groups: DataFrame, work: Callable) -> np.ndarray:
    """The sum of work(group, x, y) over all groups; whole numbers, so any order of adding gives the same sums."""

    def run(batches):
        total = None
        for batch in batches:
            for g, y, x in zip(*batch.columns, strict=True):
                got = work(g.as_py(), np.frombuffer(x.as_buffer(), np.float32).reshape(-1, WIDTH), np.frombuffer(y.as_buffer(), np.float32).astype(float))
                total = got if total is None else total + got
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return np.sum([np.frombuffer(r["total"], np.int64) for r in groups.select("g", "y", "x").mapInArrow(run, "total binary").collect()], axis=0)


def corpus_sums(texts: DataFrame, q: QualityParams) -> list[np.ndarray]:
    """Context sums over all texts: each task sends its tables in pieces, which are added up by piece as they come."""

    def run(batches):
        total = None
        for batch in tk.sized_batches(batches, 2 * BATCH):
            got = context_sums(*tk.text_buffers(batch.column(0)), q.reach)
            if total is None:
                total = got
            else:
                for into, more in zip(total, got, strict=True):
                    into += more
        for b, table in enumerate(total or ()):
            for lo in range(0, len(table), q.rows):
                some = np.flatnonzero(table[lo : lo + q.rows].any(1)).astype(np.int32)
                if len(some):  # whole numbers, so any order of adding gives the same sums
                    yield pa.record_batch([pa.array([b], pa.int32()), pa.array([lo], pa.int32()), pa.array([some.tobytes()]), pa.array([table[lo + some].astype(np.int64).tobytes()])], names=["b", "lo", "at", "sums"])

    def add(batches):
        tables: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, lo, at, sums in zip(*batch.columns, strict=True):
                b, lo = b.as_py(), lo.as_py()
                _, d, size = BLOCKS[b]
                total = tables.setdefault((b, lo), np.zeros((min(q.rows, size - lo), d), np.int64))
                total[np.frombuffer(at.as_buffer(), np.int32)] += np.frombuffer(sums.as_buffer(), np.int64).reshape(-1, d)
        for (b, lo), total in tables.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([lo], pa.int32()), pa.array([total.tobytes()])], names=["b", "lo", "sums"])

    out = [np.zeros((size, d)) for _, d, size in BLOCKS]
    pieces = texts.mapInArrow(run, "b int, lo int, at binary, sums binary").repartition("b", "lo").mapInArrow(add, "b int, lo int, sums binary")
    for r in pieces.collect():  # as many rows as the tables have pieces
        got = np.frombuffer(r["sums"], np.int64).reshape(-1, BLOCKS[r["b"]][1])
        out[r["b"]][r["lo"] : r["lo"] + len(got)] = got
    return out


sample_sums = corpus_sums  # the name of old, for texts of any choice


def score(documents: DataFrame, model: Network) -> DataFrame:
    """doc_id and score of every document; one pass over the scan."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in tk.sized_batches(batches, BATCH):
            yield pa.record_batch([batch.column(0), pa.array(shared.value.score_texts(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def classify(documents: DataFrame, labels: DataFrame, q: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score(documents, fit(documents, labels, q))
    return out.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= q.threshold).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, q: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, q))
    schema, at = documents.schema, documents.columns.index("text")

    def run(batches):
        for batch in tk.sized_batches(batches, BATCH):
            good = shared.value.score_texts(batch.column(at)) >= q.threshold
            yield batch.filter(pa.array(good))

    return documents.mapInArrow(run, schema)
