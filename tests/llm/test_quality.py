import random
import zlib

import numpy as np

from orebed.llm import quality
from tests.llm.fixtures import doc_frame, doc_rows, prose


def labelled(n=700):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randint(20, 120))
        if not good:
            text = rng.choice([" | ".join(text.split()), " ".join(w + "***" for w in text.split()), text.upper() + "!!", (text.split()[0] + " ") * 60])
        docs.append((i, text))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(doc_frame(spark, docs), lab).collect()}
    assert len(got) == len(docs)
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.3) for i, _ in docs)
    right = np.mean([got[i].predicted == labels[i][1] for i in held])
    assert right > 0.95
    for i in held:
        labels[i] = (i, 1 - labels[i][1], 0)
    again = {r.doc_id: r.score for r in quality.classify(doc_frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-9 for i, _ in docs)  # held-out labels are not read


def test_awkward_rows(spark):
    rows = doc_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(doc_frame(spark, rows), none).collect()} == {0.5}
    lab = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(doc_frame(spark, rows), lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(doc_frame(spark, rows), lab)
    assert kept.columns == doc_frame(spark, rows).columns
    assert quality.classify(doc_frame(spark, []), lab).count() == 0


def plain_index(key, d):
    """An index vector by the definition: two places with signs, from the bits of the hash."""
    out = np.zeros(d)
    for k in (0, 20):
        part = int(key) >> k
        out[part % d] += -1.0 if part >> 12 & 1 else 1.0
    return out


def test_context_vectors_and_pooling_equal_plain_sums():
    import pyarrow as pa

    from orebed.llm import textkit as tk

    rng = random.Random(4)
    texts = ["a b c", "", "B b! ünï", "x", None, prose(rng, 200), "a a a a"] + [prose(rng, 12) for _ in range(5)]
    data, offsets = tk.text_buffers(pa.array(texts))
    sums = quality.context_sums(data, offsets, 2)
    row, h, keys, _ = quality.unit_rows(data, offsets)
    for (_, d, size), key, got in zip(quality.BLOCKS, keys, sums, strict=True):
        want = np.zeros((size, d))
        own = quality.bucket(key, size)
        for i in range(len(h)):
            for j in range(max(0, i - 2), min(len(h), i + 3)):
                if i != j and row[i] == row[j]:
                    want[own[i]] += plain_index(key[j], d)
        assert np.allclose(got, want)
    part = quality.context_sums(*tk.text_buffers(pa.array(texts[:6])), 2)  # a sample: later texts hold units without context
    vectors = quality.unit_vectors(part)
    whole = quality.pooled(data, offsets, vectors)
    lo = 0
    for (_, d, size), key, total in zip(quality.BLOCKS, keys, part, strict=True):
        own = quality.bucket(key, size)
        for r in range(len(texts)):
            want = np.zeros(d)
            for i in np.flatnonzero(row == r):
                v = total[own[i]] if total[own[i]].any() else plain_index(key[i], d)
                want += v / np.sqrt(2 if v is not total[own[i]] and not total[own[i]].any() else (v**2).sum())
            assert np.allclose(whole[r, lo : lo + d], want / ((row == r).sum() + quality.SHRINK), atol=1e-5)
        lo += d
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], quality.pooled(*tk.text_buffers(pa.array([t], pa.string())), vectors)[0], atol=1e-5)


def test_sums_over_tasks_equal_sums_in_one_place(spark):
    import pyarrow as pa

    from orebed.llm import textkit as tk

    rows = doc_rows()
    got = quality.sample_sums(doc_frame(spark, rows).select("text"), quality.QualityParams(rows=1000))
    want = quality.context_sums(*tk.text_buffers(pa.array([t for _, t in rows])), 2)
    assert all((a == b).all() for a, b in zip(got, want, strict=True)) and all(w.any() for w in want)


def test_network_equals_plain_arithmetic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, quality.WIDTH)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = quality.Network(x, y, quality.QualityParams())
    for r in range(20):
        z = [min(8.0, max(-8.0, (float(a) - m) / s)) for a, m, s in zip(x[r], net.mean, net.scale, strict=True)]
        hid = [np.tanh(sum(a * w for a, w in zip(z, net.w1[:, k], strict=True)) + net.b1[k]) for k in range(len(net.w2))]
        logit = sum(a * w for a, w in zip(hid, net.w2, strict=True)) + net.b2
        assert np.isclose(net.score(x[r : r + 1])[0], 1 / (1 + np.exp(-logit / net.temperature)), atol=1e-6)
    assert np.mean((net.score(x) >= 0.5) == y) > 0.85


def test_one_very_long_word_and_the_context_tables_matter(spark):
    docs, labels = labelled(200)
    docs += [(5000, "z" * 2_500_000), (5001, "z" * 40 + " a")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = doc_frame(spark, docs)
    model = quality.fit(frame, lab)
    got = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert len(got) == len(docs) and all(0 <= s <= 1 for s in got.values())
    model.vectors = [np.zeros_like(v) for v in model.vectors]
    off = {r.doc_id: r.score for r in quality.score(frame, model).collect()}
    assert sum(abs(got[i] - off[i]) > 0.01 for i in got) > 20
