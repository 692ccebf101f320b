import math
import random

import numpy as np
import pytest

from orebed.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, ids string"


def brute(rows, k=5):
    ok = []
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(256.0 * float(np.float32(x))) for x in v]))
    out = []
    for qi, q in ok:
        if qi % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), i) for i, v in ok if i != qi)
            out += [(qi, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


def rows(n=700, dim=16, seed=1):
    rng = random.Random(seed)
    out = [(i, [rng.gauss(0, 0.2) for _ in range(dim)], 1, 2, "z") for i in range(n)]
    out += [(1000 + i, list(out[7][1]), 1, 2, "z") for i in range(12)]  # ties
    out += [(2000, None, 1, 2, "z"), (2050, [1.0, None], 1, 2, "z"), (2100, [float("nan")], 1, 2, "z"), (2150, [float("inf")] * 3, 1, 2, "z"), (2200, [], 1, 2, "z"), (2250, [0.5], 1, 2, "z"), (None, [1.0] * dim, 1, 2, "z")]
    return out


@pytest.mark.parametrize("p", [topk.TopkParams(), topk.TopkParams(block=60, queries=4, levels=6, lane=2), topk.TopkParams(block=50, levels=16, rescore_cost=0.01), topk.TopkParams(block=90, levels=1, rescore_cost=1e9)])
def test_equal_to_brute_force(spark, p):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), p).collect()
    assert sorted(tuple(r) for r in got) == brute(data)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [0.1, 0.2], 1, 2, "z"), (1, [0.3, -0.2], 1, 2, "z")], SCHEMA)
    assert [tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0")).collect()] == [(0, 1, 1, 25 * 76 + 51 * -52)]
    none = df.where("vec_id > 5")
    assert topk.top_k(none, none).count() == 0 and topk.top_k(df, none).count() == 0
    twice = df.union(df)
    got = sorted(tuple(r) for r in topk.top_k(twice, df.where("vec_id = 0")).collect())
    assert got == [(0, 1, 1, 25 * 76 + 51 * -52), (0, 2, 1, 25 * 76 + 51 * -52)]


def test_stops_on_proof():
    rng = np.random.default_rng(3)
    m = np.zeros((500, 40), np.int64)
    m[np.arange(500), rng.integers(0, 40, 500)] = rng.integers(100, 256, 500)
    m += rng.integers(-2, 3, m.shape)
    seg = topk.Segments(m, 8)
    exact = m[:50] @ m.T
    for i in range(50):
        at, read = seg.search(m[i], np.array([i]), 3, -np.inf, 4.0)
        assert read < 0.6 * len(seg.place) and len(at) < 100 and i not in at
        others = np.delete(np.arange(500), i)
        assert set(others[np.argsort(-exact[i, others], kind="stable")[:3]]) <= set(at)
        none, first = seg.search(m[i], np.array([i]), 3, 1e9, 4.0)
        assert not len(none) and first < len(seg.place)  # a floor from other blocks closes this one


def test_segments_hold_every_posting_by_falling_impact():
    rng = np.random.default_rng(4)
    m = rng.integers(-30, 31, (60, 9)) * (rng.random((60, 9)) < 0.5)
    seg = topk.Segments(m, 5)
    back = np.zeros_like(m)
    back[seg.place, seg.dim] = seg.value
    assert (back == m).all() and len(seg.place) == (m != 0).sum()
    tops = [np.abs(seg.value[lo:hi]) for lo, hi in zip(seg.cuts[:-1], seg.cuts[1:], strict=True)]
    tops = [t for t in tops if len(t)]
    assert all(a.min() >= b.max() for a, b in zip(tops, tops[1:], strict=False))
    assert (seg.reach(m[:5])[:, None] >= m[:5] @ m.T).all()
    assert np.allclose(seg.left[-1], 0)


def test_registered_vectors_stop_before_the_end():
    import pyarrow.parquet as pq

    v = np.floor(256 * np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist(), np.float64)).astype(np.int64)
    seg = topk.Segments(v, topk.TopkParams().levels)
    read = [seg.search(v[i], np.array([i]), 5, -np.inf, topk.TopkParams().rescore_cost)[1] for i in range(0, len(v), 50)]
    assert max(read) < len(seg.place) and np.mean(read) < 0.8 * len(seg.place)
    print(np.mean(read) / len(seg.place))
