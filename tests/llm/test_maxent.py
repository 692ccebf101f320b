import math
import zlib
from collections import Counter

import numpy as np
import pytest

from orebed.llm import maxent
from tests.llm.fixtures import doc_frame, doc_rows

SMALL = maxent.LmParams(hot=40, classes=4, members=4, prev_slots=16, both_slots=32, word_slots=8, batch=64, block=100, fan_in=2)


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("q", [maxent.LmParams(), SMALL])
def test_counts_and_base_score(spark, q):
    rows = doc_rows()
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in maxent.lm_scores(doc_frame(spark, rows), q).collect()))
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = []
    for i, x in rows:
        t = tokens(x)
        want.append((str(i), held(i), len(t), sum(c[k] > 0 for k in t), n, round(sum(math.log10((c[k] + 0.1) / (n + 0.1 * (v + 1))) for k in t), 6)))
    assert got == sorted(want)


def test_probabilities_of_a_history_add_up():
    q = SMALL
    rng = np.random.default_rng(1)
    hashes, counts = rng.integers(1, 2**63, 40).astype(np.uint64), np.sort(rng.integers(3, 99, 40))[::-1].astype(np.int64)
    total, distinct = int(counts.sum()) + 100, 90  # 50 more tokens that are not hot, 2 each
    m = maxent.Model(q, hashes, counts, total, distinct)
    w = maxent.Weights(q, m.flat)
    w.flat[:] += rng.normal(0, 0.5, len(w.flat)).astype(np.float32)
    cold = rng.integers(1, 2**63, 51).astype(np.uint64)  # the last was never seen
    history = hashes[[3, 30]]
    mass = 0.0
    for k, t in enumerate([*hashes, *cold]):
        toks = np.array([*history, t, maxent.END], np.uint64)
        both = m.score(w, toks, np.array([0, 4]))["score"][0]
        place, hot = m.find(toks)
        cls, member = m.targets(place, hot)
        f = m.histories(toks, np.array([0, 4]), place, hot)
        logit, own, _, inner = m.forward(w, f, cls, np.array([2]))
        p = logit[0, cls[2]] + (inner[0, member[2]] if len(own) else 0.0)
        if cls[2] == q.classes:
            count = counts[k] if k < 40 else (2 if k < 90 else 0)
            p += math.log((count + 0.1) / (m.rare_total + 0.1 * (m.rare_distinct + 1)))
        mass += math.exp(p)
        assert np.isfinite(both)
    assert abs(mass - 1) < 1e-4


def test_training_beats_counts_on_held_out_text(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):  # words follow each other in a ring
        k, out = int(rng.integers(30)), []
        for _ in range(60):
            out.append(f"w{k}")
            k = (k + 1) % 30 if rng.random() < 0.8 else int(rng.integers(30))
        rows.append((i, " ".join(out)))
    got = [r for r in maxent.lm_scores(doc_frame(spark, rows), maxent.LmParams(batch=256)).collect() if r.held_out]
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


def test_gradient_is_that_of_the_likelihood():
    q = SMALL
    rng = np.random.default_rng(2)
    hashes, counts = rng.integers(1, 2**63, 40).astype(np.uint64), np.sort(rng.integers(3, 99, 40))[::-1].astype(np.int64)
    m = maxent.Model(q, hashes, counts, int(counts.sum()), 40)
    toks, starts = np.concatenate([rng.choice(hashes, 30), [maxent.END]]).astype(np.uint64), np.array([0, 31])
    before = m.score(maxent.Weights(q, m.flat.copy()), toks, starts)["score"][0]
    flat, squares = m.flat.copy(), np.zeros_like(m.flat)
    for _ in range(20):
        m.train(maxent.Weights(q, flat), squares, toks, starts)
    assert m.score(maxent.Weights(q, flat), toks, starts)["score"][0] > before


def test_empty(spark):
    assert maxent.lm_scores(doc_frame(spark, [])).count() == 0
    only = maxent.lm_scores(doc_frame(spark, [(i, None) for i in range(30) if held(i)])).collect()  # no training text
    assert only and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in only)
