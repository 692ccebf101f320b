"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents, by doc_id, form blocks. With integer weights w that add up to a
period P, block b of a source is released at floor(b P / w) and due at ceil((b + 1) P / w).
Slots go, one block each, to the released block with the earliest deadline (ties: the
first source). As the weights add up to the period, no deadline is missed, and after t
slots a source has had t w / P blocks, less than one more or fewer. The schedule repeats
after P slots, so it is found once, by a fold over one period, and every block's slot
follows by arithmetic. When a source has run out its slots stay empty; the others' order
among each other is unchanged. All documents are kept, unless a weights table is given: then
documents of sources that it lacks, or whose weight is null, zero or negative, are left out.

Documents are numbered without a window over a whole source: blocks of ids are counted,
their counts added up, and rows numbered inside blocks of ids. The schedule has one row a
source and max(period, sources) + sources slots at most in all; it is broadcast when the sources were
counted and are few. The fold takes slots times sources steps in one task, so sources should be
names of collections, thousands rather than millions.

Defined cases: a null source is a source of its own; a null doc_id comes first in its
source, by the hash of the row, in spans of that hash; rows of equal doc_id follow by the hash of the row; null texts are documents like
others; extra columns, of any name, are kept by ``mixed`` and ignored by ``schedule``; an empty table
gives an empty result. Weights without documents get their slots, which stay empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


@dataclass(frozen=True)
class MixParams:
    block_rows: int = 16  # documents in a block
    period: int = 1024  # slots after which the schedule repeats, about
    id_span: int = 4096  # ids whose rows are numbered by one task
    small_side: int = 10_000  # sources up to which the schedule is broadcast
    power: float = 0.5  # default target weight of a source: its documents to this power


def key_of(source: str = "source") -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))


def integer_weights(documents: DataFrame, weights: DataFrame | None, q: MixParams) -> DataFrame:
    """(mix_key, w): whole weights, at least 1, about q.period in all. weights: (source, weight)."""
    if weights is None:
        weights = documents.groupBy("source").agg(F.count("*").alias("n")).selectExpr("source", f"pow(n, {q.power!r}D) weight")
    keyed = weights.where("weight > 0").select(key_of().alias("mix_key"), F.col("weight").cast("double").alias("weight"))
    keyed = keyed.groupBy("mix_key").agg(F.sum("weight").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy(F.lit(0)))  # one row a source
    return keyed.select("mix_key", F.greatest(F.lit(1), F.floor(F.col("weight") / total * q.period + 0.5)).cast("long").alias("w"))


def period_schedule(weights: DataFrame) -> DataFrame:
    """(mix_key, nth, slot0, w, p): the slot of each source's nth block in one period."""
    one = weights.agg(F.array_sort(F.collect_list(F.struct("mix_key", "w"))).alias("s")).where("size(s) > 0")
    one = one.selectExpr("transform(s, x -> x.mix_key) ks", "transform(s, x -> x.w) ws", "aggregate(s, 0L, (a, x) -> a + x.w) p")
    # due[i]: the deadline of source i's next block if it is released at slot t, else beyond the period
    due = "transform(ws, (w, i) -> if((a.had[i] * p) div w <= t and a.had[i] < w, ((a.had[i] + 1) * p + w - 1) div w, 2 * p + 2))"
    first = f"cast(array_position({due}, array_min({due})) - 1 as int)"
    step = f"""named_struct('had', transform(a.had, (h, i) -> if(i = {first}, h + 1L, h)), 'out', concat(a.out, array({first})))"""
    start = "named_struct('had', transform(ws, w -> 0L), 'out', cast(array() as array<int>))"
    slots = one.selectExpr("ks", "ws", "p", f"posexplode(aggregate(sequence(0L, p - 1), {start}, (a, t) -> {step}).out) (slot0, i)")
    slots = slots.selectExpr("ks[i] mix_key", "ws[i] w", "p", "cast(slot0 as long) slot0")
    return slots.withColumn("nth", F.row_number().over(Window.partitionBy("mix_key").orderBy("slot0")).cast("long") - 1)


def placed(documents: DataFrame, weights: DataFrame | None = None, q: MixParams = MixParams()) -> DataFrame:
    """mix_row (the document's columns as a struct) with mix_block, mix_release, mix_deadline, mix_slot and mix_place (the order of the mixture)."""
    rows = documents.select(F.struct("*").alias("mix_row"), key_of().alias("mix_key"), F.col("doc_id").cast("long").alias("mix_id"), F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]).alias("mix_hash"))
    # null ids come first and are dealt by the hash that orders them
    rows = rows.withColumn("mix_span", F.expr(f"if(mix_id is null, shiftright(mix_hash, 43) - {1 << 60}L, mix_id div {q.id_span}L - if(mix_id < 0 and mix_id % {q.id_span}L <> 0, 1L, 0L))"))
    counts = rows.groupBy("mix_key", "mix_span").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_key").orderBy("mix_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("mix_key", "mix_span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    inside = Window.partitionBy("mix_key", "mix_span").orderBy(F.asc_nulls_first("mix_id"), "mix_hash")
    rows = rows.withColumn("mix_nth", F.row_number().over(inside) - 1).drop("mix_id", "mix_hash")
    rows = rows.join(counts, ["mix_key", "mix_span"]).withColumn("mix_nth", F.col("mix_before") + F.col("mix_nth"))
    shares = Scratch(documents.sparkSession, "mixing").keep(integer_weights(documents, weights, q), "weights")
    plan = period_schedule(shares).groupBy("mix_key").agg(F.first("w").alias("mix_w"), F.first("p").alias("mix_p"), F.sort_array(F.collect_list(F.struct("nth", "slot0"))).alias("mix_slots"))
    if shares.count() <= q.small_side:
        plan = F.broadcast(plan)
    out = rows.join(plan, "mix_key").withColumn("mix_block", F.expr(f"mix_nth div {q.block_rows}"))
    out = out.withColumn("mix_slot", F.expr("(mix_block div mix_w) * mix_p + mix_slots[cast(mix_block % mix_w as int)].slot0"))
    return out.selectExpr(
        "mix_row", "mix_block", "(mix_block * mix_p) div mix_w mix_release", "((mix_block + 1) * mix_p + mix_w - 1) div mix_w mix_deadline", "mix_slot",
        f"mix_slot * {q.block_rows} + mix_nth % {q.block_rows} mix_place")


def schedule(documents: DataFrame, weights: DataFrame | None = None, q: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, block, release, deadline, slot and place of every document."""
    narrow = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source")
    return placed(narrow, weights, q).selectExpr("mix_row.doc_id", "mix_row.source", "mix_block block", "mix_release release", "mix_deadline deadline", "mix_slot slot", "mix_place place")


def mixed(documents: DataFrame, weights: DataFrame | None = None, q: MixParams = MixParams(), partitions: int | None = None) -> DataFrame:
    """All documents, with their columns, in the order of the mixture (ranges of places, sorted)."""
    out = placed(documents, weights, q)
    ranged = out.repartitionByRange(partitions, "mix_place") if partitions else out.repartitionByRange("mix_place")
    return ranged.sortWithinPartitions("mix_place").select("mix_row.*")


def oracle_sql(q: MixParams = MixParams()) -> str:
    """The same result in DuckDB's SQL."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, 'null') k,
    row_number() OVER (PARTITION BY coalesce('=' || source, 'null') ORDER BY doc_id NULLS FIRST) - 1 j FROM documents),
c AS (SELECT k, pow(count(*), {q.power}) x FROM d GROUP BY k),
w AS (SELECT k, greatest(1, cast(floor(x / (SELECT sum(x) FROM c) * {q.period} + 0.5) AS BIGINT)) w FROM c),
a AS (SELECT list(k ORDER BY k) ks, list(w ORDER BY k) ws, cast(sum(w) AS BIGINT) p FROM w),
e AS (SELECT cast(-1 AS BIGINT) t, list_transform(ws, lambda v: cast(0 AS BIGINT)) had, cast(0 AS BIGINT) pick FROM a
  UNION ALL
  SELECT t + 1, list_transform(range(1, len(ws) + 1), lambda i: had[i] + CASE WHEN i = nxt THEN 1 ELSE 0 END), nxt FROM (
    SELECT t, had, ws, p, list_position(due, list_min(due)) nxt FROM (
      SELECT t, had, ws, p, list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN (had[i] * p) // ws[i] <= t + 1 AND had[i] < ws[i]
        THEN ((had[i] + 1) * p + ws[i] - 1) // ws[i] ELSE 2 * p + 2 END) due FROM e, a WHERE t + 1 < p))),
s AS (SELECT ks[pick] k, ws[pick] w, p, t slot0, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 nth FROM e, a WHERE t >= 0)
SELECT doc_id, source, b AS block, (b * p) // w AS release, ((b + 1) * p + w - 1) // w AS deadline, (b // w) * p + slot0 AS slot,
  ((b // w) * p + slot0) * {q.block_rows} + j % {q.block_rows} AS place
FROM (SELECT *, j // {q.block_rows} b FROM d) d JOIN w USING (k) JOIN (SELECT k, p, slot0, nth FROM s) s USING (k)
WHERE nth = b % w
"""
