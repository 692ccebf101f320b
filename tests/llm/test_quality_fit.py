"""The classifier is fitted on all labelled rows, wherever they lie."""

import random
import zlib
from functools import partial

import numpy as np
import pyarrow as pa

from orebed.llm import quality
from orebed.llm import textkit as tk
from tests.llm.fixtures import prose

LABELS = "doc_id long, quality int, toxic int"


def rows(n):
    rng = random.Random(9)
    words = prose(rng, 400).split()
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))
        out.append((i, text.upper() if i % 3 == 0 else text, int(i % 3 != 0)))
    return out


def test_every_row_outside_the_fold_is_fitted_on(spark):
    data = rows(27_000)
    used = [r for r in data if zlib.crc32(str(r[0]).encode()) % 5]
    assert len(used) > 21_000
    model = quality.fit(spark.createDataFrame([r[:2] for r in data], "doc_id long, text string"), spark.createDataFrame([(i, y, 0) for i, _, y in data], LABELS), quality.QualityParams(epochs=2))
    buffers = tk.text_buffers(pa.array([t for _, t, _ in used]))
    vectors = quality.unit_vectors(quality.context_sums(*buffers, 2))
    assert all((a == b).all() for a, b in zip(model.vectors, vectors, strict=True))
    assert np.allclose(model.mean, quality.pooled(*buffers, vectors).mean(0, dtype=float), atol=1e-6)


def test_training_over_groups_equals_training_in_one_place(spark):
    data = rows(900)
    q = quality.QualityParams(group=64, epochs=5)
    docs = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in data], LABELS)
    seen = []

    def spied(groups, work, over=quality.over_groups):
        if not seen:
            seen.extend((r.g, np.frombuffer(r.x, np.float32).reshape(-1, quality.WIDTH), np.frombuffer(r.y, np.float32).astype(float)) for r in groups.collect())
        return over(groups, work)

    over, quality.over_groups = quality.over_groups, spied
    try:
        one = quality.fit(docs.repartition(5), labels, q)
    finally:
        quality.over_groups = over
    two = quality.fit(docs.orderBy("text").coalesce(1), labels.repartition(3), q)
    here = quality.Network(np.zeros((0, quality.WIDTH), np.float32), np.zeros(0), q)
    assert len(seen) > 5 and sum(len(y) for _, _, y in seen) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _, _ in data)
    here.train(sum(quality.moments(x) for _, x, _ in seen), lambda work: sum(work(*r) for r in reversed(seen)), q)
    for name in ("w1", "b1", "w2", "b2", "temperature"):
        assert np.allclose(getattr(one, name), getattr(here, name), atol=1e-6), name
        assert np.allclose(getattr(one, name), getattr(two, name), atol=1e-3), name


def test_a_pass_equals_plain_steps():
    q = quality.QualityParams(group=50, batch=16)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(40, quality.WIDTH)).astype(np.float32), (rng.random(40) > 0.5).astype(float)
    net = quality.Network(np.zeros((0, quality.WIDTH), np.float32), np.zeros(0), q)
    params = [net.w1.copy(), net.b1.copy(), net.w2.copy(), np.zeros(1)]
    state = np.concatenate([np.ravel(k) for k in (*params, *[np.zeros_like(k) for k in params * 2], np.ones(2))])
    got = quality.passed(state, net.mean, net.scale, q, 3, 7, x, y)
    held, used = quality.apart(7, 40, q)
    assert sorted([*held, *used]) == list(range(40)) and len(held) == 6
    order = np.random.default_rng([q.seed, 7, 3]).permutation(used)
    m, v = [0 * p for p in params], [0 * p for p in params]
    for step, lo in enumerate(range(0, len(order), 16), 1):
        pick = order[lo : lo + 16]
        grads = [0 * p for p in params]
        for i in pick:
            z = np.clip(x[i].astype(float), -8, 8)
            hid = np.tanh(z @ params[0] + params[1])
            d = (1 / (1 + np.exp(-(hid @ params[2] + params[3][0]))) - y[i]) / len(pick)
            for k, g in enumerate((np.outer(z, d * params[2] * (1 - hid**2)), d * params[2] * (1 - hid**2), d * hid, np.array([d]))):
                grads[k] += g
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            params[k] = params[k] - q.rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + q.decay * params[k])
    parts = quality.split(got[:-1] / got[-1], q)
    for have, want in zip(parts, [*params, *m, *map(np.sqrt, v)], strict=False):
        assert np.allclose(have, want, atol=1e-6)
    assert np.allclose(parts[-1], [0.9**3, 0.999**3]) and got[-1] == round(34 / 50 * quality.ONE)
    total = partial(quality.losses, net, q)
    assert (total(7, x, y) > 0).all()
