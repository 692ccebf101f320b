import random

import corpus_pipeline
from orebed.llm import jaccard, mixing, packing, quality, queries, secrets
from orebed.llm.scratch import Scratch
from tests.llm.fixtures import prose
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import base


def make(spark, tmp_path, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(300):
        text, good = prose(rng, rng.randint(30, 90)), rng.random() < 0.75
        if not good:
            text = " | ".join(text.split())
        elif i % 20 == 0:
            text += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(rng, 4)
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(good), 0))
    good = [r for r in rows if labels[r[0]][1]]
    rows += [(1000 + k, r[1], "en", "s0", len(r[1])) for k, r in enumerate(good[:15])]
    rows += [(1100 + k, r[1] + " end", "en", "s1", len(r[1]) + 4) for k, r in enumerate(good[15:30])]
    docs = make(spark, tmp_path, rows, labels)
    state, scratch = docs, Scratch(spark, "t")
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        state = scratch.keep(stage(spark, state, str(tmp_path)), str(k))
        tables.append(state.collect())
    assert all(sorted(t[0].asDict()) == sorted(docs.columns) for t in tables[:-1])
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    first = {r.doc_id for r in tables[0]}
    assert first == {i for i, s in scores.items() if s >= 0.3} and {r[0] for r in good} <= first and len(first) < len(rows)
    kept = {i for i, _, c in brute([(r.doc_id, r.text) for r in tables[0]]) if i == c}
    assert {r.doc_id for r in tables[1]} == kept and not kept & set(range(1000, 1015))
    assert {r.doc_id for r in tables[2]} == kept
    before = {r.doc_id: r.text for r in tables[1]}
    for r in tables[2]:
        assert (r.text == before[r.doc_id]) == (not base(before[r.doc_id])) and not base(r.text) and r.n_chars == len(r.text)
    assert sorted(map(str, tables[3])) == sorted(map(str, tables[2]))
    places = {r.doc_id: r.place for r in mixing.schedule(scratch.spark.createDataFrame(tables[2])).collect()}
    assert [places[r.doc_id] for r in tables[3]] == sorted(places.values())
    enc = packing.encoder(queries.tokenizer_path())
    total = {}
    for r in tables[4]:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {r.doc_id: len(enc.model.encode(r.text, add_special_tokens=False).ids) + 1 for r in tables[3]}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in got if r.start == 0)[0][0] == min(total) and {r.doc_id for r in got} == set(total)
    assert jaccard and secrets


def test_awkward_and_empty_tables(spark, tmp_path):
    text = prose(random.Random(1), 60)
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (None, None, None, None, None), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (4, text, "en", "s", 1)]
    make(spark, tmp_path / "a", rows, [])
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "3", "None"]
    make(spark, tmp_path / "b", [], [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_packing_follows_the_mixture_over_several_files(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 30)), "en", f"s{i % 5}", 0) for i in range(2600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        mixed = Scratch(spark, "t").keep(corpus_pipeline.source_mix(spark, docs.repartition(6), ""), "mixed")
        got = corpus_pipeline.pack_sequences(spark, mixed.repartition(7), "").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    places = {r.doc_id: r.place for r in mixing.schedule(docs).collect()}
    by = {}
    for r in got:
        by.setdefault(r.sequence_id >> 36, set()).add(places[r.doc_id])
    ranges = [(min(v), max(v)) for _, v in sorted(by.items())]
    assert len(ranges) > 1 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert {r.doc_id for r in got} == set(places)


def test_long_texts_and_clashing_columns(spark, tmp_path):
    text = prose(random.Random(2), 60_000)
    rows = [(1, text, "en", "s", 1, 7, 8), (2, text + " x", "en", "s", 1, 7, 8), (3, prose(random.Random(3), 50), None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, w int, mix_place int")
    state = docs
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")  # every score is 0.5
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = Scratch(spark, "t").keep(stage(spark, state, str(tmp_path)), name)
        assert state.columns == docs.columns
    assert {r.doc_id for r in state.collect()} == {1, 3}
    assert {r.doc_id for r in corpus_pipeline.pack_sequences(spark, state, "").collect()} == {1, 3}
