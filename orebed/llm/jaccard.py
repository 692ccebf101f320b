"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

A document is its set of distinct word shingles. Two documents link when
``den * |A and B| >= num * |A or B|``. Documents with equal sets are one class, and the
join runs over classes.

All sets are read in one total order: rare shingles by hash first, then the most frequent
ones by rising frequency. Two linked sets of n and m shingles share at least
o = ceil(num (n + m) / (num + den)) of them, so they share c shingles among the first
n - o + c of each. Small sets enumerate every pair of their prefix (c = 2) and meet where
a pair is equal; large sets are entries in the inverted lists of their prefix (c = 1) and
scan them. Sets near the boundary are in both, so every pair of sizes meets. The boundary
is the size up to which enumerating pairs costs less than scanning lists of the length
that the corpus shows.

Long lists are never expanded into pairs of rows. Classes that long lists tie together form
a dense group; its sets are dealt by size into blocks of bounded bytes, and all
intersections of two blocks come from matrix products over their common
shingles. A meeting of blocks sends on a spanning forest of its links, not all links. First
every block meets the first blocks of fitting sizes, the leaders, which is linear in the
group. Sets of the group's largest component by then need no look at each other; the sets
outside it meet all blocks of fitting sizes. So a group of near copies, however large, costs its
size times the few that the leaders do not reach. Pairs
in short lists are counted by the keys they share, which bounds their overlap, and verified
on their whole sets, unless they are in one component by then. So every link between
different sets is looked at, and the components are exact, whatever the group sizes.

Defined cases: null or empty text has an empty set, 0 shingles, and is its own component;
a text of fewer words than a shingle is one shingle; repeated rows share a class; rows
with a null doc_id take part but never name a component; extra columns are ignored; an
empty table gives an empty result. Whole texts are read, however long.
Classes are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected_components
from .scratch import Scratch, most_frequent


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    num: int = 80
    den: int = 100
    frequent: int = 8  # shingles of longer lists are moved to the end of the order
    order_entries: int = 600_000  # most frequent shingles ranked by count; others by hash. Any order is exact
    verify_cost: float = 4.0  # of a candidate, against one list entry
    small_side: int = 500_000  # rows up to which a side is broadcast
    long: int = 32  # a list of more classes is scanned in blocks
    block_items: int = 262_144  # shingles of the sets in one block, about
    block_sets: int = 1024  # sets in one block, about


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, _, _, at = tk.words(data, offsets)
    win, _ = tk.windows(h, at, k)
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= k:
            a = np.sort(win[lo : hi - k + 1])
            out.append(a[np.concatenate([[True], a[1:] != a[:-1]])])
        elif hi > lo:
            out.append(tk.mix(np.array([(h[lo:hi] * tk.MULS[: hi - lo]).sum() + np.uint64(hi - lo)], np.uint64)))
        else:
            out.append(h[:0])
    return out


def fingerprint(a: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(a.tobytes())).astype(np.int64))


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-num * n // den)


def prefix(a: np.ndarray, p: int, hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first p shingles of a sorted set in the order (rare by hash, frequent by count)."""

    def found(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(hashes, x), max(0, len(hashes) - 1))
        return i, hashes[i] == x if len(hashes) else np.zeros(len(x), bool)

    head = a[: p + 16]
    _, often = found(head)
    rare = head[~often]
    if len(rare) >= p or len(head) == len(a) and not often.any():
        return rare[:p]
    i, often = found(a)
    return np.concatenate([a[~often], a[often][np.argsort(ranks[i[often]], kind="stable")]])[:p]


def boundary(mean_list: float, q: JoinParams) -> int:
    """The largest size whose pairs cost less to enumerate than its lists to scan."""
    best = 0
    for n in range(4, 1000):
        p = n - least_overlap(n, q.num, q.den) + 1
        if (p + 1) * p / 2 <= p * (1 + q.verify_cost * (mean_list - 1)):
            best = n
    return best


class JaccardJoin:
    def __init__(self, spark: SparkSession, documents: DataFrame, q: JoinParams = JoinParams()) -> None:
        self.spark, self.q = spark, q
        self.classes: DataFrame | None = None  # (fp, lead): the smallest doc_id of each class
        self.docs = documents.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) th")
        self.scratch = Scratch(spark, "jaccard")

    # ---- keys -------------------------------------------------------------------------

    def frequencies(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Hashes of the most frequent prefix shingles and their ranks; mean length of the list an entry is in."""
        q = self.q

        def count(batches):
            seen: set[int] = set()
            held, size = [], 0

            def out():
                k, c = np.unique(np.concatenate(held), return_counts=True)
                return pa.record_batch([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["k", "c"])

            for batch in tk.sized_batches(batches, column="text"):
                for a in shingle_sets(*tk.text_buffers(batch.column(0)), q.words):
                    if len(a) and (f := fingerprint(a)) not in seen:
                        seen.add(f)
                        held.append(a[: len(a) - least_overlap(len(a), q.num, q.den) + 1])
                        size += len(held[-1])
                if size > 500_000:
                    yield out()
                    held, size = [], 0
            if held:
                yield out()

        lists = self.docs.select("text").mapInArrow(count, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))
        seen = Observation()
        lists = lists.observe(seen, F.sum("c").alias("entries"), F.sum(F.col("c") * F.least("c", F.lit(q.frequent))).alias("met"))
        often = self.scratch.keep(lists.where(F.col("c") > q.frequent), "often")
        top = most_frequent(often, "c", q.order_entries).toPandas()
        hashes, counts = top["k"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
        order = np.argsort(hashes)
        entries = seen.get["entries"] or 1
        return hashes[order], counts[order], (seen.get["met"] or 1) / entries

    def prefixes(self, hashes: np.ndarray, ranks: np.ndarray, small: int) -> DataFrame:
        """doc_id, n, fp and, once for each class and task, the prefix (one longer for small sets)."""
        q, ranked = self.q, self.spark.sparkContext.broadcast((hashes, ranks))

        def keys(batches):
            seen: set[int] = set()
            order = ranked.value
            for batch in tk.sized_batches(batches):
                ns, fps, heads = [], [], []
                for a in shingle_sets(*tk.text_buffers(batch.column(1)), q.words):
                    f, n = fingerprint(a), len(a)
                    ns.append(n)
                    fps.append(f)
                    if not n or f in seen:
                        heads.append(None)
                        continue
                    seen.add(f)
                    heads.append(prefix(a, n - least_overlap(n, q.num, q.den) + 1 + (n <= small), *order).view(np.int64))
                sizes = np.array([0 if x is None else len(x) for x in heads])
                flat = [x for x in heads if x is not None]
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
                yield pa.record_batch([batch.column(0), pa.array(ns, pa.int64()), pa.array(fps, pa.int64()), batch.column(2), lists], names=["doc_id", "n", "fp", "th", "pre"])

        return self.docs.mapInArrow(keys, "doc_id long, n long, fp long, th long, pre array<long>")

    def entries(self, heads: DataFrame, small: int) -> DataFrame:
        """(k, light, fp, n) of every key that at least two classes hold; light keys are pairs of shingles."""
        q = self.q
        single = f"case when {q.den} * n > {q.num * small} then transform(slice(pre, 1, cast(n - ceil({q.num} * n / {q.den}) + 1 as int)), x -> named_struct('k', x, 'light', false)) else array() end"
        pairs = f"case when n <= {small} and n > 3 then flatten(transform(pre, (x, i) -> transform(slice(pre, i + 2, size(pre)), y -> named_struct('k', xxhash64(least(x, y), greatest(x, y), 2), 'light', true)))) else array() end"
        rows = heads.where("size(pre) > 0").selectExpr(f"explode(concat({single}, {pairs})) e", "fp", "n").select("e.k", "e.light", "fp", "n")
        lists = rows.groupBy("k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("k")
        return rows.join(lists, "k").dropDuplicates(["k", "fp"])

    # ---- verification -----------------------------------------------------------------

    def sets_of(self, wanted: DataFrame, name: str) -> DataFrame:
        """(fp, items): the whole sets of wanted(fp), each read from its lead's text, told by hash where ids are null or repeat."""
        q = self.q
        wanted = self.scratch.keep(wanted.select("fp").distinct().join(self.classes, "fp"), f"wanted-{name}")
        side = F.broadcast(wanted) if wanted.count() <= q.small_side else wanted
        texts = self.docs.join(side, (self.docs["th"] == side["lead_th"]) & self.docs["doc_id"].eqNullSafe(side["lead"])).select("fp", "text")

        def sets(batches):
            for batch in tk.sized_batches(batches):
                fps, items = [], []
                for f, a in zip(batch.column(0).to_pylist(), shingle_sets(*tk.text_buffers(batch.column(1)), q.words), strict=True):
                    if fingerprint(a) == f:  # another text may have the same hash
                        fps.append(f)
                        items.append(a.view(np.int64))
                sizes = np.cumsum([0, *map(len, items)])
                lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(items) if items else np.zeros(0, np.int64)))
                yield pa.record_batch([pa.array(fps, pa.int64()), lists], names=["fp", "items"])

        return self.scratch.keep(texts.mapInArrow(sets, "fp long, items array<long>").dropDuplicates(["fp"]), f"sets-{name}")

    def dense_groups(self, members: DataFrame) -> DataFrame:
        """(fp, n, dense): classes that long lists tie together."""
        lists = members.groupBy("k").agg(F.count("*").alias("s"), F.min("fp").alias("lead")).where(F.col("s") > self.q.long).select("k", "lead")
        ties = members.join(lists, "k").select(F.col("fp").alias("a"), F.col("lead").alias("b")).distinct()
        groups = connected_components(ties, self.scratch, "dense").toDF("fp", "dense")
        return self.scratch.keep(groups.join(members.select("fp", "n").distinct(), "fp"), "dense")

    def dense_links(self, dense: DataFrame) -> DataFrame:
        """Links within dense groups: a spanning forest of each meeting of two blocks."""
        q, keep = self.q, self.scratch.keep
        # sets that link differ by at most one class of size
        level = F.floor(F.log("n") / F.log(F.lit(q.den / q.num)) + 1e-9).cast("int")
        rows = dense.withColumn("level", level)
        sets = self.sets_of(dense, "dense")

        def pack(table):
            lists = table.column("items").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            key = {c: table.column(c)[:1] for c in ("dense", "level", "block")}
            return pa.table({**key, "fps": pa.array([table.column("fp").to_numpy().astype(np.int64).tobytes()]), "sizes": pa.array([sizes.astype(np.int64).tobytes()]), "flat": pa.array([flat.astype(np.int64).tobytes()])})

        def packed(some: DataFrame, name: str) -> DataFrame:
            """Blocks of the sets of some(fp, n, dense, level)."""
            counts = some.groupBy("dense", "level").agg(F.ceil(F.greatest(F.sum("n") / q.block_items, F.count("*") / q.block_sets)).cast("int").alias("blocks"))
            dealt = some.join(counts, ["dense", "level"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            dealt = dealt.join(sets, "fp").select("dense", "level", "block", "fp", "items")
            return keep(dealt.groupBy("dense", "level", "block").applyInArrow(pack, "dense long, level int, block int, fps binary, sizes binary, flat binary"), name)

        def met(left: DataFrame, right: DataFrame, pairs: str) -> DataFrame:
            """Links between blocks of left and right of fitting sizes for which ``pairs`` holds."""
            x = left.select("dense", "level", "block").withColumn("level2", F.explode(F.array(*[F.col("level") + d for d in (-1, 0, 1)])))
            y = right.selectExpr("dense", "level level2", "block block2")
            fits = x.join(y, ["dense", "level2"]).where(pairs)
            fits = fits.join(left, ["dense", "level", "block"]).join(right.toDF("dense", "level2", "block2", "fps2", "sizes2", "flat2"), ["dense", "level2", "block2"])
            return fits.selectExpr("fps", "sizes", "flat", "fps2", "sizes2", "flat2").repartition(F.xxhash64("fps", "fps2")).mapInArrow(meet, "a long, b long")

        def meet(batches):
            for batch in batches:
                for r in range(batch.num_rows):
                    one = [np.frombuffer(batch.column(c)[r].as_py(), np.int64) for c in range(6)]
                    a, b = block_links(*one, q.num, q.den)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            tk.hand_back()

        blocks = packed(rows, "blocks")
        first = keep(met(blocks, blocks, "block2 = 0 and (block > 0 or level >= level2)"), "leader-links")
        known = rows.join(connected_components(first, self.scratch, "leaders").toDF("fp", "comp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
        known = keep(known.select("fp", "n", "dense", "level", "comp"), "led")
        sizes = known.groupBy("dense", "comp").agg(F.count("*").alias("s"))
        main = sizes.groupBy("dense").agg(F.max(F.struct("s", "comp")).alias("m")).selectExpr("dense", "m.comp main")
        rest = known.join(main, "dense").where("comp <> main").select("fp", "n", "dense", "level")
        later = met(packed(rest, "rest"), blocks, "block2 > 0")  # the first blocks have been met
        out = keep(first.union(later), "dense-links")
        self.scratch.drop("blocks", "rest", "led", "leader-links", "sets-dense", "wanted-dense")
        return out

    def open_pairs(self, members: DataFrame) -> DataFrame:
        """Pairs of short lists that may link, of different components and dense groups.

        Two classes that are in no dense group together share short lists only, so the count
        of their shared keys is whole, and bounds their overlap.
        """
        q = self.q
        x, y = members.toDF("k", "light", "a", "n", "ca", "da"), members.drop("light").toDF("k", "b", "ln", "cb", "db")
        fits = f"{q.den} * least(n, ln) >= {q.num} * greatest(n, ln)"
        met = x.join(y, "k").where("a < b and ca <> cb and coalesce(da <> db, true)").where(fits)
        met = met.groupBy("a", "b").agg(F.first("n").alias("n"), F.first("ln").alias("ln"), F.sum(F.when(F.col("light"), 1).otherwise(0)).alias("pairs"), F.sum(F.when(F.col("light"), 0).otherwise(1)).alias("ones"))
        rest = f"greatest(ceil({q.num} * n / {q.den}) - 1, ceil({q.num} * ln / {q.den}) - 1)"  # beyond the prefix
        need = f"ceil({q.num} * (n + ln) / {q.num + q.den})"
        light = f"pairs > 0 and (1 + sqrt(1 + 8 * pairs)) / 2 + 0.001 + {rest} - 1 >= {need}"
        return met.where(f"ones > 0 and ones + {rest} >= {need} or {light}").select("a", "b")

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of pairs(a, b) that link, by their whole sets."""
        q = self.q
        pairs = self.scratch.keep(pairs, "pairs")
        whole = self.sets_of(pairs.selectExpr("a fp").union(pairs.selectExpr("b fp")), "open")
        both = pairs.join(whole.toDF("a", "xa"), "a").join(whole.toDF("b", "xb"), "b")
        both = both.selectExpr("a", "b", "cast(size(xa) + size(xb) as long) n", "cast(size(array_intersect(xa, xb)) as long) i")
        out = self.scratch.keep(both.where(f"{q.den} * i >= {q.num} * (n - i)").select("a", "b"), "open-links")
        self.scratch.drop("sets-open", "wanted-open", "pairs")
        return out

    def components(self) -> DataFrame:
        q, keep = self.q, self.scratch.keep
        hashes, ranks, mean_list = self.frequencies()
        small = boundary(mean_list, q)
        heads = keep(self.prefixes(hashes, ranks, small), "heads")
        self.scratch.free_shuffles()
        self.classes = classes = keep(heads.where("n > 0").groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th")).alias("m")).selectExpr("fp", "m.doc_id lead", "m.th lead_th"), "classes")
        members = keep(self.entries(heads, small), "members")
        heads = keep(heads.select("doc_id", "n", "fp"), "rows")
        self.scratch.drop("heads", "often")  # prefixes have done their work
        self.scratch.free_shuffles()
        dense = self.dense_groups(members)
        inner = connected_components(self.dense_links(dense), self.scratch, "inner").toDF("fp", "comp")
        self.scratch.free_shuffles()
        short = members.groupBy("k").agg(F.count("*").alias("s")).where(F.col("s") <= q.long).select("k")
        known = keep(dense.select("fp", "dense").join(inner, "fp", "left"), "known")
        open_ = members.join(short, "k").join(known, "fp", "left").selectExpr("k", "light", "fp", "n", "coalesce(comp, fp) comp", "dense")
        links = self.similar(self.open_pairs(open_))
        self.scratch.free_shuffles()
        labels = connected_components(links.union(inner.select("fp", "comp")), self.scratch, "whole").toDF("fp", "comp")
        named = labels.join(classes, "fp")
        least = named.groupBy("comp").agg(F.min("lead").alias("cid"))
        self.scratch.drop("members", "known", "open-links", "dense-links")
        ids = classes.join(named.join(least, "comp").select("fp", "cid"), "fp", "left").selectExpr("fp", "coalesce(cid, lead) cid")
        return heads.select("doc_id", "n", "fp").join(ids, "fp", "left").selectExpr("doc_id", "n n_shingles", "case when n = 0 then doc_id else cid end component_id")


def block_links(fps, sizes, flat, fps2, sizes2, flat2, num: int, den: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two blocks of sets (given flat, one after another)."""
    shared = np.intersect1d(flat, flat2)
    row, row2 = np.repeat(np.arange(len(fps)), sizes), np.repeat(np.arange(len(fps2)), sizes2)
    place, place2 = np.searchsorted(shared, flat), np.searchsorted(shared, flat2)
    if len(shared):
        ok = shared[np.minimum(place, len(shared) - 1)] == flat
        ok2 = shared[np.minimum(place2, len(shared) - 1)] == flat2
        row, place, row2, place2 = row[ok], place[ok], row2[ok2], place2[ok2]
        order, order2 = np.argsort(place, kind="stable"), np.argsort(place2, kind="stable")
        row, place, row2, place2 = row[order], place[order], row2[order2], place2[order2]
    common = np.zeros((len(fps), len(fps2)), np.float32)  # counts below 2**24 are exact
    for lo in range(0, len(shared), width):
        i, j = np.searchsorted(place, [lo, lo + width])
        i2, j2 = np.searchsorted(place2, [lo, lo + width])
        x = np.zeros((len(fps), min(width, len(shared) - lo)), np.float32)
        y = np.zeros((len(fps2), x.shape[1]), np.float32)
        x[row[i:j], place[i:j] - lo] = 1
        y[row2[i2:j2], place2[i2:j2] - lo] = 1
        common += x @ y.T
    total = sizes[:, None] + sizes2[None, :]
    a, b = np.nonzero(den * common.astype(np.int64) >= num * (total - common.astype(np.int64)))
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.get(v, v) != v:
            up[v] = up.get(up[v], up[v])
            v = up[v]
        return v

    out: list[tuple[int, int]] = []
    for u, v in zip(fps[a].tolist(), fps2[b].tolist(), strict=True):
        ru, rv = find(u), find(v)
        if ru != rv:
            up[ru] = rv
            out.append((u, v))
    got = np.array(out, np.int64).reshape(-1, 2)
    return got[:, 0], got[:, 1]


def jaccard_components(documents: DataFrame, q: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    return JaccardJoin(documents.sparkSession, documents, q).components()
