"""Mixing and preference formatting against plain Python."""

import hashlib
import random
from collections import defaultdict

from orebed.llm import mixing, preference
from tests.llm.fixtures import doc_frame, doc_rows


def edf(ws):
    p, had, out = sum(ws), [0] * len(ws), []
    for t in range(p):
        due = [((h + 1) * p + w - 1) // w if h * p // w <= t and h < w else 10**9 for h, w in zip(had, ws, strict=True)]
        i = due.index(min(due))
        assert due[i] < 10**9 and t < due[i]  # a block is released, and no deadline is missed
        had[i] += 1
        out.append(i)
    return out


def test_schedule_is_earliest_deadline_first(spark):
    for ws in ([1], [1, 1, 1], [5, 1, 3, 7], [600, 200, 100, 124]):
        w = spark.createDataFrame([(f"=s{i:02}", x) for i, x in enumerate(ws)], "mix_key string, w long")
        got = mixing.period_schedule(w).orderBy("slot0").collect()
        want = edf(ws)
        assert [int(r.mix_key[2:]) for r in got] == want
        had = [0] * len(ws)
        for t, r in enumerate(got):
            assert r.nth == had[want[t]]
            had[want[t]] += 1
            assert all(abs(h - (t + 1) * x / sum(ws)) < 1 for h, x in zip(had, ws, strict=True))


def test_mix_keeps_all_rows_and_follows_the_slots(spark):
    rng = random.Random(5)
    rows = [(i, f"t{i}", "en", rng.choice(["a", "a", "a", "b", "c", None]), i, "x", "y", "z", "w") for i in range(900)]
    rows += [(None, None, None, None, None, "x", "y", "z", "w")] + rows[:5]
    df = spark.createDataFrame(rows, doc_frame(spark, []).schema).repartition(4)
    q = mixing.MixParams(block_rows=4, period=32, id_span=50)
    got = mixing.schedule(df, None, q).collect()
    assert len(got) == len(rows) and len({r.place for r in got}) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for own in by.values():
        own.sort(key=lambda r: r.place)
        ids = [r.doc_id for r in own]
        assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
        for n, r in enumerate(own):
            assert r.block == n // 4 and r.release <= r.slot < r.deadline
    weights = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 0.0), ("none", 2.0)], "source string, weight double")
    assert {r.source for r in mixing.schedule(df, weights, q).collect()} == {"a", "b"}  # only sources with a weight are mixed
    out = mixing.mixed(df, None, q)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert mixing.mixed(doc_frame(spark, [])).count() == 0 and mixing.schedule(doc_frame(spark, doc_rows())).count() == len(doc_rows())


def test_mix_bears_clashing_names_and_many_null_ids(spark):
    names = ["p", "w", "n", "nth", "slot0", "ks", "mix_nth", "mix_key", "mix_row", "mix_hash", "mix_place", "plan_key", "weight"]
    rows = [(i if i % 4 else None, f"t{i % 7}", "s%d" % (i % 3), *([i % 2] * len(names))) for i in range(-100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{x} int" for x in names))
    out = mixing.mixed(df, None, mixing.MixParams(block_rows=4, period=16, id_span=32))
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, rows_of(df)))
    got = mixing.schedule(df).collect()
    assert len({r.place for r in got}) == len(rows)
    first = {}
    for r in sorted(got, key=lambda r: r.place):
        first.setdefault(r.source, []).append(r.doc_id)
    assert all(ids == sorted(ids, key=lambda x: (x is not None, x or 0)) for ids in first.values())


def rows_of(df):
    return df.collect()


TURNS = "conv_id long, turn long, role string, text string, prompt string"


def turns_of(rows):
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t, r, x))
    key = lambda t: tuple((v is not None, v if v is not None else 0) for v in t)
    return {c: [(r, x) for _, r, x in sorted(v, key=key)] for c, v in by.items()}


def render(turns):
    return "".join(f"<|{r or ''}|>\n{x or ''}<|end|>\n" for r, x in turns)


def mask(turns):
    return "".join("0" * len(f"<|{r or ''}|>\n") + ("1" if r == "assistant" else "0") * len(f"{x or ''}<|end|>\n") for r, x in turns)


def formatted(c, r):
    n = next((i for i, (a, b) in enumerate(zip(c, r, strict=False)) if a != b), min(len(c), len(r)))
    return n, render(c[:n]), render(c[n:]), mask(c[n:]), render(r[n:]), mask(r[n:])


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            role = "user" if t % 2 == 0 else "assistant"
            text = rng.choice(["hé", "ok", "sure\n", None, ""]) if t else rng.choice(["same", f"own{c}"])
            rows.append((c, t, role, text, "x"))
    rows += [(70, 0, None, None, "x"), (70, None, "user", "z", "x"), (None, 0, "user", "same", "x"), rows[0], (71, 0, "user", "x" * 300_000, "y")]
    return rows


def digest(c):
    return hashlib.md5(str(c).encode()).hexdigest(), c


def pairs_of(by):
    """(chosen id, rejected id, chosen turns, rejected turns), by the definition."""
    groups, rest, out = defaultdict(list), [], []
    for c in sorted(by, key=digest):
        groups[by[c][0]].append(c)
    for ids in groups.values():
        out += [(ids[k], ids[k + 1], by[ids[k]], by[ids[k + 1]]) for k in range(0, len(ids) - 1, 2)]
        rest += ids[-1:] if len(ids) % 2 else []
    rest.sort(key=digest)
    for k in range(0, len(rest) - 1, 2):
        a, b = rest[k], rest[k + 1]
        out += [(a, b, by[a], by[a][:-1] + by[b][-1:]), (b, a, by[b], by[b][:-1] + by[a][-1:])]
    return out + [(c, None, by[c], []) for c in rest[len(rest) // 2 * 2 :]]


def test_preferences_equal_brute_force(spark):
    rows = conversations()
    by = turns_of([r for r in rows if r[0] is not None])
    want = [(c, r, *formatted(x, y)) for c, r, x, y in pairs_of(by)]
    got = preference.preferences(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert any(r.prompt_turns == 1 for r in got) and any(r.prompt_turns > 1 for r in got)


def test_pairs_reach_across_all_ids(spark):
    rng = random.Random(8)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(150)} | {k * 65_536 + rng.randrange(3) for k in range(-20, 40)} | set(range(300, 321)))
    rows = [(c, t, "user", f"first{c % 3}" if t == 0 else f"turn{c}", "x") for c in ids for t in range(2)]
    got = preference.preferences(spark.createDataFrame(rows, TURNS).repartition(4)).collect()
    want = {(c, r) for c, r, *_ in pairs_of(turns_of(rows))}
    assert len(got) == len(want) and {(r.chosen_id, r.rejected_id) for r in got} == want
    assert all(r.prompt_turns == 1 for r in got if r.rejected_id is not None)


def test_registered_pairs_are_two_conversations(spark):
    got = preference.preferences(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).collect()
    ids = sorted(r.chosen_id for r in got)
    assert sum(r.rejected_id is None for r in got) <= 1 and len(set(ids)) == len(ids)
    for r in got:
        if r.rejected_id is not None:
            assert r.chosen and r.rejected and r.chosen != r.rejected and r.rejected_id != r.chosen_id
            assert len(r.chosen) == len(r.chosen_mask) and len(r.rejected) == len(r.rejected_mask)


def test_format_of_two_tables(spark):
    c = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "good"), (2, 0, "user", "only")], "pair_id long, turn long, role string, text string")
    r = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "bad"), (3, 0, "user", "x")], "pair_id long, turn long, role string, text string")
    got = {x.pair_id: x for x in preference.format_preferences(c, r).collect()}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].chosen == "<|assistant|>\ngood<|end|>\n" and got[1].rejected_mask == "0" * 14 + "1" * 11
    assert got[2].rejected == "" and got[3].chosen == "" and got[3].prompt_turns == 0
    assert preference.preferences(spark.createDataFrame([], TURNS)).count() == 0


def test_plans_run_no_python(spark):
    for df in (mixing.schedule(doc_frame(spark, doc_rows())), preference.preferences(spark.createDataFrame(conversations(), TURNS))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))
