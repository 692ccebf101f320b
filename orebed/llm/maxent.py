"""LM scoring with a hashed maximum-entropy model and a class-factored softmax.

Tokens are lower-cased words and one end token per text. The most frequent training tokens
are the model's own words, in classes of equal size by rank; all others form one more
class. P(token | history) = P(class | history) P(token | class, history). Class scores add
hashed weights of the previous token, of the one before it (a skip feature) and of both;
word scores add hashed weights of the previous token and of the skip. Within the last
class tokens follow their smoothed counts, so every token has a probability and all
probabilities of a history add up to one.

Weights start at the counts' logarithms. Every task runs minibatch gradient steps over its
own training texts from the same weights and sends the update it made, cut into blocks;
updates are added tree-wise, each weight by the gradients it has seen. Counts cover all training texts and grow
with the corpus: they stay a distributed table, of which only the most frequent ``hot``
tokens are broadcast. Rarer tokens of a text meet their counts in a join.

Defined cases: null or empty text is the end token alone; a null doc_id counts as not held
out; repeated rows count and score each; extra columns are ignored; an empty table gives
an empty result; with no training token every count is 0 and the model is uniform over
its classes. Whole texts are read, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch, most_frequent

END = np.uint64(0x656E645F6F665F74)
LOG10 = np.log(10.0)


@dataclass(frozen=True)
class LmParams:
    hot: int = 262_144  # most frequent tokens whose counts are broadcast
    classes: int = 32
    members: int = 64  # words of each class
    prev_slots: int = 2_048
    both_slots: int = 8_192
    word_slots: int = 256
    rate: float = 0.4
    batch: int = 2_048
    smooth: float = 0.1
    block: int = 32_768  # weights in one block of an update
    fan_in: int = 64


def token_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, each row closed by the end token, and row starts (rows + 1)."""
    h, _, _, at = tk.words(data, offsets)
    starts = at + np.arange(len(at))
    out = np.empty(len(h) + len(at) - 1, np.uint64)
    ends = starts[1:] - 1
    body = np.ones(len(out), bool)
    body[ends] = False
    out[body], out[ends] = h, END
    return out, starts


class Weights:
    """All weights as one vector, with views of its parts."""

    def __init__(self, q: LmParams, flat: np.ndarray | None = None) -> None:
        c, w = q.classes + 1, q.classes * q.members
        shapes = {"class_bias": (c,), "class_prev": (q.prev_slots, c), "class_skip": (q.prev_slots, c), "class_both": (q.both_slots, c), "word_bias": (w,), "word_prev": (q.word_slots, w), "word_skip": (q.word_slots, w)}
        sizes = {k: int(np.prod(s)) for k, s in shapes.items()}
        self.flat = np.zeros(sum(sizes.values()), np.float32) if flat is None else flat
        at = 0
        for k, s in shapes.items():
            setattr(self, k, self.flat[at : at + sizes[k]].reshape(s))
            at += sizes[k]


class Model:
    """Vocabulary, counts of the hot tokens and weights; scores texts in numpy batches."""

    def __init__(self, q: LmParams, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int) -> None:
        self.q, self.total, self.distinct = q, total, distinct
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        own = q.classes * q.members
        self.slot = order  # hashes come by falling count, so this is the rank of the token at each sorted place
        self.word = np.where(order < own, order, -1)
        top = counts[:own].astype(float)
        self.rare_total, self.rare_distinct = total - float(top.sum()), max(0, distinct - len(top))
        mass = np.full(own, 1e-9)  # places without a word
        mass[: len(top)] += top
        by_class = mass.reshape(q.classes, q.members)
        weights = Weights(q)
        weights.class_bias[:-1] = np.log(by_class.sum(1))
        weights.class_bias[-1] = np.log(self.rare_total + q.smooth * (self.rare_distinct + 1))
        weights.class_bias -= weights.class_bias.max()
        weights.word_bias[:] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel()
        self.flat = weights.flat

    def find(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place among the hot tokens, and whether it is one."""
        if not len(self.hashes):
            return np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        i = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return i, self.hashes[i] == tokens

    def histories(self, tokens: np.ndarray, starts: np.ndarray, place: np.ndarray, hot: np.ndarray) -> dict[str, np.ndarray]:
        """Hashed features of each token's history; before a text stands the end token."""
        q = self.q
        first = np.zeros(len(tokens), bool)
        first[starts[:-1]] = True
        second = np.zeros(len(tokens), bool)
        second[np.minimum(starts[:-1] + 1, len(tokens) - 1)] = True
        prev, skip = np.roll(tokens, 1), np.roll(tokens, 2)
        prev[first] = END
        skip[first | second] = END
        slot = np.where(hot, self.slot[place] if len(self.slot) else 0, 1 << 40)

        def bucket(slots: int) -> tuple[np.ndarray, np.ndarray]:
            half = slots // 2  # frequent tokens have a slot of their own, others share the second half
            own = np.where(slot < half, slot, half + (tokens >> np.uint64(7)).astype(np.int64) % (slots - half))
            end_place, end_hot = self.find(np.array([END]))
            end = int(self.slot[end_place[0]]) if end_hot[0] and self.slot[end_place[0]] < half else half
            a, b = np.roll(own, 1), np.roll(own, 2)
            a[first] = end
            b[first | second] = end
            return a, b

        class_prev, class_skip = bucket(q.prev_slots)
        word_prev, word_skip = bucket(q.word_slots)
        both = (tk.mix(prev * tk.MULS[0] + skip * tk.MULS[1]) % np.uint64(q.both_slots)).astype(np.int64)
        return {"class_prev": class_prev, "class_skip": class_skip, "class_both": both, "word_prev": word_prev, "word_skip": word_skip}

    def forward(self, w: Weights, f: dict[str, np.ndarray], cls: np.ndarray, pick: np.ndarray):
        """Log-probabilities of classes, and of the members of each own token's class."""
        q = self.q
        logit = w.class_bias + w.class_prev[f["class_prev"][pick]] + w.class_skip[f["class_skip"][pick]] + w.class_both[f["class_both"][pick]]
        logit -= logit.max(1, keepdims=True)
        logit -= np.log(np.exp(logit).sum(1, keepdims=True))
        own = np.flatnonzero(cls[pick] < q.classes)
        c = cls[pick][own]
        member = w.word_bias.reshape(q.classes, q.members)[c]
        member = member + w.word_prev.reshape(q.word_slots, q.classes, q.members)[f["word_prev"][pick][own], c]
        member += w.word_skip.reshape(q.word_slots, q.classes, q.members)[f["word_skip"][pick][own], c]
        member -= member.max(1, keepdims=True)
        member -= np.log(np.exp(member).sum(1, keepdims=True))
        return logit, own, c, member

    def targets(self, place: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and member of each token; the last class holds all that are no own words."""
        word = np.where(hot, self.word[place], -1) if len(self.word) else np.full(len(place), -1)
        return np.where(word >= 0, word // self.q.members, self.q.classes), word % self.q.members

    def train(self, w: Weights, squares: np.ndarray, tokens: np.ndarray, starts: np.ndarray) -> None:
        """Gradient steps (with per-weight rates) over texts, batch by batch."""
        q = self.q
        place, hot = self.find(tokens)
        cls, member = self.targets(place, hot)
        f = self.histories(tokens, starts, place, hot)
        grown = Weights(q, squares)
        for lo in range(0, len(tokens), q.batch):
            pick = np.arange(lo, min(lo + q.batch, len(tokens)))
            logit, own, c, inner = self.forward(w, f, cls, pick)
            g = -np.exp(logit)
            g[np.arange(len(pick)), cls[pick]] += 1
            gi = -np.exp(inner)
            gi[np.arange(len(own)), member[pick][own]] += 1
            self._step(w, grown, "class_prev", f["class_prev"][pick], g)
            self._step(w, grown, "class_skip", f["class_skip"][pick], g)
            self._step(w, grown, "class_both", f["class_both"][pick], g)
            for part in ("word_prev", "word_skip"):
                self._step(w, grown, part, f[part][pick][own] * q.classes + c, gi, q.members)

    def _step(self, w: Weights, grown: Weights, part: str, rows: np.ndarray, g: np.ndarray, width: int | None = None) -> None:
        table, sums = getattr(w, part), getattr(grown, part)
        if width:
            table, sums = table.reshape(-1, width), sums.reshape(-1, width)
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        if not len(rows):
            return
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total = np.add.reduceat(g[order], heads, axis=0)
        at = rows[heads]
        count = np.diff(np.concatenate([heads, [len(rows)]]))[:, None]
        sums[at] += total**2
        table[at] += (self.q.rate * total / np.sqrt(1.0 + sums[at])) * np.minimum(1.0, count / 2.0).astype(np.float32)

    def score(self, w: Weights, tokens: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Sums of each row over all tokens but the counts of tokens that are not hot."""
        q, rows = self.q, len(starts) - 1
        place, hot = self.find(tokens)
        cls, member = self.targets(place, hot)
        f = self.histories(tokens, starts, place, hot)
        count = np.where(hot, self.counts[place] if len(self.counts) else 0, 0)
        base = np.where(hot, np.log10(count + q.smooth), 0.0)
        got = np.zeros(len(tokens))
        for lo in range(0, len(tokens), q.batch):
            pick = np.arange(lo, min(lo + q.batch, len(tokens)))
            logit, own, _, inner = self.forward(w, f, cls, pick)
            got[pick] = logit[np.arange(len(pick)), cls[pick]] / LOG10
            got[pick[own]] += inner[np.arange(len(own)), member[pick][own]] / LOG10
        rare = cls == q.classes
        got += np.where(rare, base - np.log10(self.rare_total + q.smooth * (self.rare_distinct + 1)), 0.0)
        at = np.minimum(starts[:-1], max(0, len(tokens) - 1))

        def per(x):
            return np.add.reduceat(x, at) if rows else np.zeros(0)

        return {"base": per(base), "score": per(got), "known": per(hot.astype(np.int64)), "cold": ~hot}


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


class MaxentScorer:
    def __init__(self, documents: DataFrame, q: LmParams = LmParams()) -> None:
        self.spark: SparkSession = documents.sparkSession
        self.q, self.scratch = q, Scratch(self.spark, "maxent")
        self.docs = documents.selectExpr("cast(doc_id as long) doc_id", "text").select("doc_id", "text", held_out().alias("held_out"))

    def count(self) -> tuple[DataFrame, Model]:
        """Counts (h, c) of all training tokens, and the model that starts from them."""

        def run(batches):
            held, size = [], 0

            def out():
                k, c = np.unique(np.concatenate(held), return_counts=True)
                return pa.record_batch([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

            for batch in tk.sized_batches(batches):
                held.append(token_rows(*tk.text_buffers(batch.column(0)))[0])
                size += len(held[-1])
                if size > 3_000_000:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

        seen = Observation()
        counts = self.docs.where("not held_out").select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
        counts = self.scratch.keep(counts.observe(seen, F.sum("c").alias("n"), F.count("*").alias("v")), "counts")
        top = most_frequent(counts, "c", self.q.hot).toPandas().sort_values(["c", "h"], ascending=[False, True])
        return counts, Model(self.q, top["h"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), seen.get["n"] or 0, seen.get["v"] or 0)

    def learn(self, model: Model) -> None:
        """One pass of distributed gradient updates over all training texts."""
        q, shared = self.q, self.spark.sparkContext.broadcast(model)

        def run(batches):
            start = shared.value
            w, squares, seen = Weights(q, start.flat.copy()), np.zeros_like(start.flat), 0
            for batch in tk.sized_batches(batches):
                tokens, starts = token_rows(*tk.text_buffers(batch.column(0)))
                start.train(w, squares, tokens, starts)
                seen += len(tokens)
            if not seen:
                return
            # a weight's update counts with the gradient it has seen, so rare features are not watered down
            update, trust = (w.flat - start.flat) * np.sqrt(squares), np.sqrt(squares)
            task = TaskContext.get().partitionId()
            for k, lo in enumerate(range(0, len(update), q.block)):
                yield pa.record_batch(
                    [pa.array([k], pa.int64()), pa.array([task], pa.int64()), pa.array([update[lo : lo + q.block].tobytes()]), pa.array([trust[lo : lo + q.block].tobytes()])], names=["k", "task", "u", "t"])

        schema = "k long, task long, u binary, t binary"

        def add(table):
            u, t = (np.sum([np.frombuffer(x, np.float32) for x in table.column(c).to_pylist()], axis=0, dtype=np.float32) for c in ("u", "t"))
            return pa.table({"k": table.column("k")[:1], "task": table.column("task")[:1], "u": pa.array([u.tobytes()]), "t": pa.array([t.tobytes()])})

        rows = self.docs.where("not held_out").select("text").mapInArrow(run, schema)
        rows = self.scratch.keep(rows, "updates-0")
        tasks, level = rows.agg(F.max("task")).first()[0], 0
        while tasks:
            rows = rows.selectExpr("k", f"task div {q.fan_in} task", "u", "t").groupBy("k", "task").applyInArrow(add, schema)
            level += 1
            rows = self.scratch.keep(rows, f"updates-{level}")
            self.scratch.drop(f"updates-{level - 1}")
            tasks //= q.fan_in
        for r in rows.select("k", "u", "t").toLocalIterator():  # as many rows as the model has blocks
            u, t = np.frombuffer(r["u"], np.float32), np.frombuffer(r["t"], np.float32)
            model.flat[r["k"] * q.block : r["k"] * q.block + len(u)] += u / np.maximum(t, 1e-6)
        shared.destroy()

    def score(self) -> DataFrame:
        q = self.q
        counts, model = self.count()
        self.learn(model)
        shared = self.spark.sparkContext.broadcast(model)
        schema = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, n_cold long, cold array<long>"

        def run(batches):
            m = shared.value
            w, key = Weights(q, m.flat), TaskContext.get().partitionId() << 40
            for batch in tk.sized_batches(batches):
                tokens, starts = token_rows(*tk.text_buffers(batch.column(1)))
                got = m.score(w, tokens, starts)
                cold = np.concatenate([[0], np.cumsum(got["cold"])])[starts]
                lists = pa.ListArray.from_arrays(pa.array(cold, pa.int32()), pa.array(tokens[got["cold"]].view(np.int64)))
                keys = key + np.arange(batch.num_rows)
                key += batch.num_rows
                yield pa.record_batch(
                    [pa.array(keys), batch.column(0), batch.column(2), pa.array(np.diff(starts)), pa.array(got["known"], pa.int64()), pa.array(got["base"]), pa.array(got["score"]), pa.array(np.diff(cold)), lists],
                    names=[p.split()[0] for p in schema.split(", ")])

        docs = self.scratch.keep(self.docs.mapInArrow(run, schema), "scored")
        self.scratch.free_shuffles()
        rare = docs.selectExpr("key", "explode(cold) h").groupBy("key", "h").agg(F.count("*").alias("f"))
        met = rare.join(counts, "h").groupBy("key").agg(F.sum(F.col("f") * F.log10(F.col("c") + q.smooth)).alias("part"), F.sum("f").alias("met"))
        unseen = f"(n_cold - coalesce(met, 0L)) * log10({q.smooth}D)"
        norm = float(np.log10(model.total + q.smooth * (model.distinct + 1)))
        return docs.drop("cold").join(met, "key", "left").selectExpr(
            "doc_id", "held_out", "n_tokens", "n_known + coalesce(met, 0L) n_known", f"{model.total}L train_tokens",
            f"base + coalesce(part, 0D) + {unseen} - n_tokens * {norm!r}D base_score",
            f"score + coalesce(part, 0D) + {unseen} score")


def lm_scores(documents: DataFrame, q: LmParams = LmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    return MaxentScorer(documents, q).score()
