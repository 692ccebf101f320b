"""Preference formatting in DataFrame operations only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns (role
and text) is rendered once, as the prompt; each side's other turns are its completion, with
a mask of one character per character of the completion: 1 where an assistant's text
or its end mark stands, 0 elsewhere.

``pair_up`` pairs all conversations of equal first turn, two by two by the digest of
conv_id: these are two conversations of one prompt. Of a first turn with an odd number of conversations the
last one is left; those are paired two by two by digest with each other: the rejected
side is the chosen one with its last turn replaced by the last turn of the other, a reply to
another prompt, and the other way round, so each is the chosen one once. A last one
of all that has no partner is listed with rejected_id null and an empty rejected side.

Conversations are numbered exactly without a window over a whole group: rows are numbered
within ranges of the digest (24 bits), and counts are added up over these and over ranges of
12 bits, so a group that holds a third of all rows is spread over all ranges, and no window holds more than
4,096 counts or the rows of one range.

Defined cases: turns are ordered by turn, null first, then role and text; a null role is
rendered as an empty role and a null text as empty, and null equals null in comparisons;
rows without a conversation id take no part, as they name no conversation; repeated rows are turns like
others; equal conversations have empty completions; extra columns are ignored; an empty
table gives an empty result. Turns and texts are whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINE, WIDE = 6, 3  # hex digits of the digest that name a range, and a range of ranges
TURNS = "array_sort(collect_list(named_struct('turn', turn, 'role', role, 'text', text)))"


def _head(x: str) -> str:
    return f"concat('<|', coalesce({x}.role, ''), '|>\\n')"


def _body(x: str) -> str:
    return f"concat(coalesce({x}.text, ''), '<|end|>\\n')"


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat({_head('x')}, {_body('x')})), '')"


def _mask(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat(repeat('0', length({_head('x')})), repeat(if(x.role <=> 'assistant', '1', '0'), length({_body('x')})))), '')"


def conversations_of(turns: DataFrame, key: str) -> DataFrame:
    """(key, turns): each conversation's turns in order."""
    return turns.groupBy(key).agg(F.expr(TURNS).alias("turns"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pair columns plus prompt, completions and masks; pairs hold arrays ``c`` and ``r`` of (turn, role, text)."""
    keep = [x for x in pairs.columns if x not in ("c", "r")]
    least = "least(size(c), size(r))"
    differ = f"if({least} = 0, cast(array() as array<boolean>), transform(sequence(1, greatest(1, {least})), i -> (element_at(c, i).role <=> element_at(r, i).role) and (element_at(c, i).text <=> element_at(r, i).text)))"
    shared = pairs.withColumn("same", F.expr(differ)).withColumn("n", F.expr(f"cast(if(array_position(same, false) = 0, {least}, array_position(same, false) - 1) as int)"))
    parts = shared.selectExpr(*keep, "n", "slice(c, 1, n) p", "slice(c, n + 1, size(c)) c", "slice(r, n + 1, size(r)) r")
    return parts.selectExpr(
        *keep, "cast(n as long) prompt_turns", f"{_render('p')} prompt", f"{_render('c')} chosen", f"{_mask('c')} chosen_mask", f"{_render('r')} rejected", f"{_mask('r')} rejected_mask")


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """Prompt and completions of each pair; both tables hold (key, turn, role, text). A side without turns is empty."""
    c, r = conversations_of(chosen, key).toDF(key, "c"), conversations_of(rejected, key).toDF(key, "r")
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    return format_pairs(c.join(r, key, "full").select(key, F.coalesce("c", none).alias("c"), F.coalesce("r", none).alias("r")))


def numbered(keys: DataFrame) -> DataFrame:
    """conv_id, g, i and n: each id's place among those of its group, by digest, from 0, and the group's size. keys: (conv_id, g), distinct ids."""
    rows = keys.select("conv_id", "g", F.md5(F.col("conv_id").cast("string").cast("binary")).alias("h"))
    rows = rows.select("*", F.substring("h", 1, WIDE).alias("wide"), F.substring("h", 1, FINE).alias("fine"))
    nth = F.row_number().over(Window.partitionBy("g", "fine").orderBy("h", "conv_id")).cast("long") - 1
    rows = rows.select("conv_id", "g", "wide", "fine", nth.alias("nth"))
    fine = rows.groupBy("g", "wide", "fine").agg(F.count("*").alias("c"))
    wide = fine.groupBy("g", "wide").agg(F.sum("c").alias("c"))

    def before(*group, order):
        return F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    whole = F.sum("c").over(Window.partitionBy("g"))
    wide = wide.select("g", "wide", before("g", order="wide").alias("wb"), whole.alias("n"))
    fine = fine.select("g", "wide", "fine", before("g", "wide", order="fine").alias("fb")).join(wide, ["g", "wide"])
    return rows.join(fine.select("g", "fine", "wb", "fb", "n"), ["g", "fine"]).selectExpr("conv_id", "g", "wb + fb + nth i", "n")


def pair_up(conversations: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, c and r: both sides' turns; rejected_id is null where no partner is left."""
    turns = conversations.where("conv_id is not null").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    whole = conversations_of(turns, "conv_id")
    first = whole.selectExpr("conv_id", "sha2(concat(coalesce(concat('=', turns[0].role), ''), '\\n', coalesce(concat('=', turns[0].text), '')), 256) g")
    places = numbered(first).selectExpr("conv_id", "g", "i div 2 pair", "i = n - 1 and i % 2 = 0 odd")
    rest = numbered(places.where("odd").selectExpr("conv_id", "'' g")).selectExpr("conv_id", "g", "i div 2 pair", "true odd")
    places = places.where("not odd").unionByName(rest)
    paired = whole.join(places, "conv_id").selectExpr("g", "pair", "odd", "struct(md5(cast(cast(conv_id as string) as binary)) h, conv_id, turns) x")
    two = paired.groupBy("g", "pair", "odd").agg(F.sort_array(F.collect_list("x")).alias("two"))
    two = two.selectExpr("odd", "two[0].conv_id a", "two[0].turns ta", "try_element_at(two, 2).conv_id b", "try_element_at(two, 2).turns tb")
    other = "concat(slice({x}, 1, size({x}) - 1), slice({y}, size({y}), 1))"
    one, back = other.format(x="ta", y="tb"), other.format(x="tb", y="ta")

    def row(*values: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(("chosen_id", "rejected_id", "c", "r"), values, strict=True)) + ")"

    sides = f"case when not odd then array({row('a', 'b', 'ta', 'tb')}) when b is null then array({row('a', 'b', 'ta', 'slice(ta, 1, 0)')}) else array({row('a', 'b', 'ta', one)}, {row('b', 'a', 'tb', back)}) end"
    return two.selectExpr(f"inline({sides})")


def preferences(conversations: DataFrame) -> DataFrame:
    """One row a pair over all conversations."""
    return format_pairs(pair_up(conversations))


def oracle_sql() -> str:
    """The same result in DuckDB's SQL."""
    head, body = "'<|' || coalesce(x.role, '') || '|>' || chr(10)", "coalesce(x.text, '') || '<|end|>' || chr(10)"

    def render(t):
        return f"coalesce(array_to_string(list_transform({t}, lambda x: {head} || {body}), ''), '')"

    def mask(t):
        return f"coalesce(array_to_string(list_transform({t}, lambda x: repeat('0', length({head})) || repeat(CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END, length({body}))), ''), '')"

    swap = "list_concat({x}[1:len({x}) - 1], {y}[len({y}):])"
    return f"""
WITH v AS (SELECT conv_id, md5(cast(conv_id AS VARCHAR)) h, list({{'turn': turn, 'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
o AS (SELECT *, row_number() OVER g i, count(*) OVER (PARTITION BY t[1].role, t[1].text) n, lead(conv_id) OVER g nid, lead(t) OVER g nt FROM v
  WINDOW g AS (PARTITION BY t[1].role, t[1].text ORDER BY h, conv_id)),
l AS (SELECT conv_id, t, row_number() OVER w i, lead(conv_id) OVER w nid, lead(t) OVER w nt FROM o WHERE i = n AND n % 2 = 1 WINDOW w AS (ORDER BY h, conv_id)),
p AS (SELECT conv_id chosen_id, nid rejected_id, t c, nt r FROM o WHERE i % 2 = 1 AND i < n
  UNION ALL SELECT conv_id, nid, t, CASE WHEN nid IS NULL THEN t[1:0] ELSE {swap.format(x='t', y='nt')} END FROM l WHERE i % 2 = 1
  UNION ALL SELECT nid, conv_id, nt, {swap.format(x='nt', y='t')} FROM l WHERE i % 2 = 1 AND nid IS NOT NULL),
n AS (SELECT *, coalesce((SELECT min(j) - 1 FROM range(1, 1 + least(len(c), len(r))) q(j) WHERE c[j].role IS DISTINCT FROM r[j].role OR c[j].text IS DISTINCT FROM r[j].text), least(len(c), len(r))) n FROM p)
SELECT chosen_id, rejected_id, cast(n AS BIGINT) prompt_turns, {render('c[1:n]')} AS prompt, {render('c[n + 1:]')} AS chosen, {mask('c[n + 1:]')} AS chosen_mask,
  {render('r[n + 1:]')} AS rejected, {mask('r[n + 1:]')} AS rejected_mask FROM n
"""
