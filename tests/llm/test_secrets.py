import hashlib
import random
import re

import pyarrow as pa

from orebed.llm import secrets
from orebed.llm import textkit as tk
from tests.llm.fixtures import doc_frame, doc_rows


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


def rows():
    rng = random.Random(4)
    bits = ["password: hunter22 ", 'Api_Key = "abc" ', "TOKEN='zzzzzzz' ", "AKIA" + "A1" * 9 + " ", "AKIAABC ", "deadbeef" * 4 + " ", "é", "\n", "deadbeef" * 2, " token=token: abcdefg ", "secretsecret:=:x ", "4242424242424242 ", "K", "ſecret: abcdefgh "]
    mixed = [(700 + i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    return [*doc_rows(), *mixed]


def test_base_spans_equal_brute_force(spark):
    data = rows()
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digest(secrets.find_secrets(doc_frame(spark, data))).collect()), key=str)
    want = []
    for i, t in data:
        spans = base(t)
        n = [sum(k == s[0] for s in spans) for k in secrets.KINDS]
        want.append((i, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_field_on_unseen_lines():
    source = secrets._lines(random.Random(77))
    texts, gold = zip(*(next(source) for _ in range(600)), strict=True)
    found = secrets.scan_rows(*tk.text_buffers(pa.array(texts)), secrets.field())
    hit = total = wrong = 0
    for text, want, got in zip(texts, gold, found, strict=True):
        total += len(want)
        hit += sum(any(s < e2 and s2 < e for _, s, e in got) for s2, e2 in want)
        wrong += sum(k == "crf" and not any(s < e2 and s2 < e for s2, e2 in want) for k, s, e in got)
    assert hit >= 0.9 * total and wrong <= 0.02 * total


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    model, rng = secrets.field(), np.random.default_rng(2)
    for _ in range(30):
        emit = rng.normal(0, 3, (int(rng.integers(1, 6)), 2))

        def value(path, emit=emit):
            full = [0, *path, 0]
            return sum(model.moves[a, b] for a, b in zip(full, full[1:], strict=False)) + sum([0, *e][t] for e, t in zip(emit, path, strict=True))

        best = max(map(value, itertools.product(range(3), repeat=len(emit))))
        assert np.isclose(value(model.decode(emit)), best)


def test_runs_give_what_the_whole_chain_gives():
    """Every token of every row decoded as one chain, against scan_rows and its certificates."""
    model, source = secrets.field(), secrets._lines(random.Random(31))
    texts = [" ".join(next(source)[0] for _ in range(4)) for _ in range(150)]
    data, offsets = tk.text_buffers(pa.array(texts))
    t = secrets.Tokens(data, offsets)
    emit = model.emissions(t.features())
    got = secrets.scan_rows(data, offsets, model)
    inside = 0
    for r, text in enumerate(texts):
        tags = model.decode(emit[t.first[r] : t.last[r]].astype(float)) if t.last[r] > t.first[r] else []
        found, before = [], 0
        for i, tag in zip(range(t.first[r], t.last[r]), tags, strict=True):
            lo, hi = (len(data[offsets[r] : x].tobytes().decode()) for x in (t.start[i], t.end[i]))
            if tag == secrets.I and before:
                found[-1][1] = hi
            elif tag:
                found.append([lo, hi])
            before = tag
            inside += tag != 0
        taken = [(s, e) for _, s, e in base(text)]
        want = [("crf", s, e) for s, e in found if not any(s < y and x < e for x, y in taken)]
        assert [x for x in got[r] if x[0] == "crf"] == want
    assert inside > 100


def test_features_do_not_depend_on_the_batch():
    """Each text alone gives the features that it has among others."""
    import numpy as np

    source = secrets._lines(random.Random(5))
    texts = [next(source)[0] for _ in range(60)] + ["", "é", "a", "==a=b== c=", "x" * 3000 + " pwd=" + "9" * 70]
    t = secrets.Tokens(*tk.text_buffers(pa.array(texts)))
    whole = np.stack(t.features(), axis=1)
    for r, text in enumerate(texts):
        alone = np.stack(secrets.Tokens(*tk.text_buffers(pa.array([text]))).features(), axis=1)
        assert (whole[t.first[r] : t.last[r]] == alone).all()
    assert (whole < list(secrets.FEATURES.values())).all() and (whole >= 0).all()


def planted(n=400):
    """Secrets of shapes that no template has, planted into documents' texts."""
    import string

    import pyarrow.parquet as pq

    rng = random.Random(19)
    take = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alnum = string.ascii_letters + string.digits
    shapes = [
        lambda: ("GOOGLE_CLIENT_AUTH: ", "GOCSPX-" + take(alnum, 28)), lambda: ("connection ", "AccountKey" + take(alnum + "+/", 86) + "=="), lambda: ("hook ", "dapi" + take("0123456789abcdef", 8) + take("XYZUVW01", 24)),
        lambda: ("stripe ", "rk_test_" + take(alnum, 24)), lambda: ("mailer SG key ", "SG." + take(alnum, 22) + "." + take(alnum, 43)), lambda: ("jwt ", "eyJ" + take(alnum, 33) + "." + take(alnum, 60) + "." + take(alnum + "-_", 43)),
        lambda: ("wifi passphrase: ", take(string.ascii_lowercase, 3) + take(string.digits, 4) + take(string.ascii_uppercase, 4)), lambda: ("credentials = ", take(string.ascii_letters, 16)), lambda: ("certificate pin: ", take(alnum + "+/", 43) + "="),
        lambda: ("PRIVATE_KEY='", take(alnum, 10) + "-" + take(alnum, 10) + "-" + take(alnum, 12)), lambda: ("db pwd ", take(alnum, 9) + "7" + take(alnum, 6) + "Q")]
    texts = [r for r in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if r and len(r) > 200]
    for k in range(n):
        text = texts[k % len(texts)]
        at = text.find(" ", rng.randrange(len(text) - 100)) + 1
        name, value = shapes[k % len(shapes)]()
        yield text[:at] + name + value + " " + text[at:], at + len(name), at + len(name) + len(value), texts[k % len(texts)]


def test_recall_on_unknown_shapes_planted_into_documents():
    model, found, cases = secrets.field(), 0, list(planted())
    got = secrets.scan_rows(*tk.text_buffers(pa.array([c[0] for c in cases])), model)
    for (_, lo, hi, _), spans in zip(cases, got, strict=True):
        found += any(s < hi and lo < e for _, s, e in spans)
    by_base = sum(any(s < hi and lo < e for _, s, e in base(text)) for text, lo, hi, _ in cases)
    plain = secrets.scan_rows(*tk.text_buffers(pa.array(sorted({c[3] for c in cases}))), model)
    assert found >= 0.9 * len(cases) and by_base < 0.3 * len(cases), (found, by_base)
    assert not any(k == "crf" for spans in plain for k, _, _ in spans)  # nothing in the texts as they were


def test_personal_data_and_prose_stay(spark):
    clean = [(1, "call (487) 555-7209 or +14155550123, card 4929348385146306, und.34@mail7.example.com at 97.51.17.173"), (2, "the quick onmentarianism of-the-world rest"), (3, "")]
    assert all(r.spans == "" for r in secrets.digest(secrets.find_secrets(doc_frame(spark, clean))).collect())


def test_redaction(spark):
    data = rows()
    df = doc_frame(spark, data)
    got = secrets.redact(df)
    assert got.columns == df.columns and got.count() == len(data)
    for r in got.collect():
        assert not base((r.text or "").replace("[secret]", " "))
        assert r.text is None or r.n_chars == len(r.text)
    assert secrets.redact(doc_frame(spark, [])).count() == 0 and secrets.find_secrets(doc_frame(spark, [])).count() == 0
