import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orebed.llm import packing, queries
from tests.llm.fixtures import doc_frame, doc_rows


def direct(text):
    enc = packing.encoder(queries.tokenizer_path())
    return enc.model.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kw", [{}, {"block_rows": 7, "grain": 64}, {"capacity": 64, "grain": 16}])
def test_round_trip(spark, kw):
    rows = [r for r in doc_rows() if r[0] is not None]
    rows = list(dict(rows).items())
    got = packing.pack(doc_frame(spark, rows), queries.tokenizer_path(), **kw).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for doc, text in rows:
        ids = np.array([*direct(text or ""), 1], dtype="<u4")
        at = 0
        for p in sorted(by[doc], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= kw.get("capacity", 2048)


def test_nulls_repeats_and_empty(spark):
    got = packing.pack(doc_frame(spark, [(None, None), (1, "a"), (1, "a")]), queries.tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.length) for r in got) == [("1", 2), ("1", 2), ("None", 1)]
    assert packing.pack(doc_frame(spark, []), queries.tokenizer_path()).count() == 0


def test_little_padding():
    rng = np.random.default_rng(0)
    sizes = np.minimum(512, rng.integers(1, 900, 2000))
    window, m = packing.spread(sizes, 2048)
    sums = np.bincount(window, sizes, m)
    assert sums.max() <= 2048 and m <= 1.01 * sizes.sum() / 2048 + 1


def test_window_count_rises():
    window, m = packing.spread(np.array([3, 3, 3]), 5)
    assert m == 3 and sorted(window) == [0, 1, 2]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'sab1.<|>")), max_size=40))
def test_encoder_equals_tokenizers(text):
    enc = packing.encoder(queries.tokenizer_path())
    assert np.frombuffer(enc(text), "<u4").tolist() == direct(text)
