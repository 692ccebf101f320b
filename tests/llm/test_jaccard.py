from itertools import combinations

import numpy as np
import pytest

from orebed.llm import jaccard
from tests.llm.fixtures import doc_frame, doc_rows


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        inter, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if sets[i] and sets[j] and 100 * inter >= 80 * union:
            at[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("q", [jaccard.JoinParams(), jaccard.JoinParams(frequent=2, small_side=0, long=2, block_items=300), jaccard.JoinParams(verify_cost=0.0, long=1)])
def test_components_equal_brute_force(spark, q):
    rows = doc_rows()
    got = jaccard.jaccard_components(doc_frame(spark, rows), q).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    out = jaccard.jaccard_components(doc_frame(spark, []))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_prefix_follows_one_order():
    a = np.array([3, 5, 8, 13, 21], np.uint64)
    none = np.zeros(0, np.uint64)
    assert jaccard.prefix(a, 2, none, none).tolist() == [3, 5]
    assert jaccard.prefix(a, 3, np.array([3, 8], np.uint64), np.array([9, 4])).tolist() == [5, 13, 21]
    assert jaccard.prefix(a, 5, np.array([3, 8], np.uint64), np.array([9, 4])).tolist() == [5, 13, 21, 8, 3]


def test_boundary_grows_with_list_length():
    q = jaccard.JoinParams()
    assert jaccard.boundary(1.0, q) <= jaccard.boundary(3.0, q)


def test_block_links_span_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 10**6, 40)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.93], rng.integers(0, 10**6, int(rng.integers(0, 4)))])) for _ in range(60)]
    sizes, flat, fps = np.array([len(s) for s in sets]), np.concatenate(sets), np.arange(60)
    a, b = jaccard.block_links(fps, sizes, flat, fps, sizes, flat, 80, 100, width=16)
    def close(links):
        up = list(range(60))
        for x, y in links:
            p, q = up[x], up[y]
            up = [q if u == p else u for u in up]
        return {frozenset(i for i in range(60) if up[i] == u) for u in up}
    want = [(i, j) for i in range(60) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    assert close(zip(a.tolist(), b.tolist(), strict=True)) == close(want) and len(a) < 60 <= len(want)


def test_a_group_beyond_the_leaders_equals_brute_force(spark):
    """Chains and clusters tied by a common passage: blocks of three sets, so most links lie outside the leaders."""
    import random

    from tests.llm.fixtures import prose

    rng = random.Random(13)
    passage = prose(rng, 14).split()
    rows = []
    for c in range(6):
        own = passage + prose(rng, 40).split()
        for k in range(14):
            rows.append((100 * c + k, " ".join(own)))
            own = [*own]
            own[rng.randrange(16, len(own))] = prose(rng, 1)  # each links to the next, the ends do not meet
    rows += [(None, rows[3][1] + " a b"), (None, rows[3][1] + " a b"), (None, rows[20][1] + " q"), (None, prose(rng, 9))] + [(None, prose(rng, 30))] * 5
    q = jaccard.JoinParams(long=2, block_sets=3, frequent=0)
    got = jaccard.jaccard_components(doc_frame(spark, rows), q).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
