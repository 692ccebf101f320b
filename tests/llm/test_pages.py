import random

import numpy as np

from orebed.llm import pages

SCHEMA = "page_id long, url string, html string, host string, text string"


def tokens_of(pages_):
    """Token hashes, block starts and page starts of pages given as lists of texts."""
    return pages.page_tokens(pages_)


def shared_keys(pages_, hosts, q, bits=0):
    """Each page's shared keys, by a plain dictionary of sampled suffixes."""
    h, at, begins = tokens_of(pages_)
    where, w = pages.sampled(h, at, begins, q.long, q.reach)
    page = np.searchsorted(begins, where, "right") - 1
    keys = pages.host_keys(w, hosts[page], bits)
    held = {}
    for k, p in zip(keys.tolist(), page.tolist(), strict=True):
        held.setdefault(k, set()).add(tuple(" ".join(pages_[p]).lower().split()))
    return [np.array([k for k, p2 in zip(keys.tolist(), page.tolist(), strict=True) if p2 == p and len(held[k]) > 1], np.uint64) for p in range(len(pages_))]


def repeats(pages_, long):
    """Positions (page, i) whose next ``long`` tokens stand on another distinct page of the host, by brute force."""
    words = [" ".join(p).lower().split() for p in pages_]
    at = {}
    for p, w in enumerate(words):
        for i in range(len(w) - long + 1):
            at.setdefault(tuple(w[i : i + long]), set()).add((p, i))
    return {x for where in at.values() if len({tuple(words[p]) for p, _ in where}) > 1 for x in where}


def test_coverage_against_brute_force():
    rng, q = random.Random(2), pages.PageParams()
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    for _ in range(25):
        pool = [[word() for _ in range(rng.randint(5, 60))] for _ in range(4)]
        made = []
        for _ in range(rng.randint(0, 7)):
            blocks = []
            for _ in range(rng.randint(0, 4)):
                x = rng.choice(pool)
                kind = rng.random()
                body = x if kind < 0.3 else [word() for _ in range(rng.randint(0, 9))] + x + [word()] if kind < 0.6 else [word() for _ in range(rng.randint(1, 40))]
                if body:
                    blocks.append(" ".join(body))
            made.append(blocks)
        hosts = np.zeros(len(made), np.uint64)
        h, at, begins = tokens_of(made)
        got = pages.covered_tokens(h, at, begins, hosts, shared_keys(made, hosts, q), q, 0)
        true = repeats(made, q.long)
        sure = {(p, i + k) for p, i in true for k in range(q.long)}
        for p in range(len(made)):
            lo, n = int(begins[p]), int(begins[p + 1] - begins[p])
            own = got[lo : lo + n]
            assert all((p, i) in sure for i in np.flatnonzero(own).tolist())  # what is covered is repeated
        edges = set(at.tolist())
        words = [" ".join(x).lower().split() for x in made]
        for p, x in enumerate(words):
            for p2, y in enumerate(words):
                if x == y:
                    continue
                for i in range(len(x)):  # every longest common run of the two pages
                    for k in range(len(y)):
                        if x[i] != y[k] or i and k and x[i - 1] == y[k - 1]:
                            continue
                        n = next((d for d in range(min(len(x) - i, len(y) - k)) if x[i + d] != y[k + d]), min(len(x) - i, len(y) - k))
                        if n >= q.long + q.reach - 1:
                            here, there = int(begins[p]) + i, int(begins[p2]) + k
                            first = 0 if {here, there} <= edges else q.reach - 1
                            last = n if {here + n, there + n} <= edges else n - q.reach + 1
                            assert got[here + first : here + last].all()


def brute_extract(rows, q=pages.PageParams()):
    """Texts of (html, host) rows, by the definition."""
    out = [None] * len(rows)
    for host in {h for _, h in rows}:
        mine = [i for i, (_, h) in enumerate(rows) if h == host]
        seen = [pages.visible(rows[i][0] or "")[0] for i in mine]
        texts = [[t for t, _ in b] for b in seen]
        hosts = np.zeros(len(mine), np.uint64)
        h, at, begins = tokens_of(texts)
        got = pages.covered_tokens(h, at, begins, hosts, shared_keys(texts, hosts, q), q, 0).tolist()
        for n, i in enumerate(mine):
            pos, parts = int(begins[n]), []
            for t, k in seen[n]:
                size = len(t.split())
                parts.append((t, k, size, sum(got[pos : pos + size])))
                pos += size
            inside = [(s, c) for _, k, s, c in parts if k == pages.KEEP]
            rooted, met = sum(s for s, _ in inside), sum(c for _, c in inside)
            copy = met > 0 and met >= q.copied * rooted
            alone = not rooted and sum(c for *_, c in parts) >= q.whole * max(1, sum(s for _, _, s, _ in parts))
            out[i] = "\n\n".join(t for t, k, s, c in parts if c < q.covered * max(1, s) or k == pages.KEEP and copy or alone)
    return out


def test_whole_result_equals_brute_force_and_needs_the_array(spark):
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    rng = random.Random(8)
    host = lambda u: u.split("/")[2] if u else ""
    line = "<p>" + " ".join(rng.choice("abcdefgh") * 3 + str(k) for k in range(12)) + "</p>"
    rows = [(r["page_id"], r["url"], r["html"].replace("</article>", line + "</article>") if k % 3 == 0 else r["html"], "x", "y") for k, r in enumerate(table)]
    rows += [(1000 + k, "http://hot.example/%d" % k, rows[k % 7][2], "x", "y") for k in range(30)]
    want = brute_extract([(h, host(u)) for _, u, h, *_ in rows])
    for size in (10**9, 20_000):
        got = pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(5), pages.PageParams(range_bytes=size)).collect()
        assert {r.page_id: r.text for r in got} == {r[0]: w for r, w in zip(rows, want, strict=True)}
    plain = ["\n\n".join(t for t, _ in pages.visible(r[2])[0]) for r in rows]
    assert sum(a != b for a, b in zip(plain, want, strict=True)) >= 5  # without the array the result is another


def test_parse():
    one = lambda x: [t for t, k in pages.parse(x)]
    assert one('<html><head><title>x</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">buy</div><article><h1>T &amp; t</h1><p><b>one\n two<br><p>th<i>re</i>e&nbsp;x</p></article><footer>f</footer>') == ["T & t", "one two", "three x"]
    assert one("<main><header><h1>H</h1></header><p>a</p><aside>no</aside><div class='comments'><p>c</p></div><form>f</form><section>z</section></main><div>out</div>") == ["H", "a", "z"]
    assert one("plain <b>text</b> only") == ["plain text only"]
    assert one("<div hidden>x</div><div style='display:none'>y</div><p>z") == ["z"]
    assert one("<article>a < b and <b class='x>y'>c</b></article") == ["a < b and c"]
    assert one("<article><p>unclosed <div class=share>s<div>t</div></div>rest") == ["unclosed", "rest"]
    assert one('<p class="x>hello') == ["hello"] and one("<p title='a>b' class=\"c>one</p>two") == ["one", "two"]
    assert one("") == [] and one("<!-- never closed <p>x") == []


def test_repeated_blocks_go_and_unique_runs_stay(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    legal = " ".join(word() for _ in range(30))
    rows, want = [], {}
    for i in range(20):
        body = " ".join(word() for _ in range(40))
        rows.append((i, f"http://h.example/{i}", f"<body><div>{legal}</div><div>{body}</div><div>{legal}</div></body>", "x", "y"))
        want[i] = body
    rows += [(30, "http://other.example/", f"<div>{legal}</div>", "x", "y"), (31, None, None, "x", "y"), (None, "u", "", "x", "y"), rows[0]]
    article = "<article><p>" + " ".join(word() for _ in range(50)) + "</p></article>"
    rows += [(40 + k, f"http://h.example/copy{k}", f"<nav>{word()}</nav>{article}", "x", "y") for k in range(3)]
    got = pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert all(r.n_chars == len(r.text) for r in got)
    assert all(by[i].text == want[i] for i in range(1, 20))
    assert by[30].text == legal and by[31].text == "" and by[None].text == ""
    assert all(by[40 + k].text == article[12:-14] for k in range(3))
    parts = pages.extract(spark.createDataFrame(rows, SCHEMA), pages.PageParams(range_bytes=3000)).collect()
    assert sorted(map(str, parts)) == sorted(map(str, got))
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def solved(blocks):
    hosts, q = np.zeros(len(blocks), np.uint64), pages.PageParams()
    return pages.select_blocks(blocks, hosts, shared_keys([t for t, _ in blocks], hosts, q), q, 0)


def test_repetition_decides_inside_and_outside_the_article():
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    line, around, copied = text(9), text(12), text(60)
    own, out = [text(40) for _ in range(5)], [text(10) for _ in range(5)]
    rows = [f"<nav>{text(9)}</nav><div>{around}</div><article><p>{own[i]}</p><p>{line}</p></article><div>{out[i]}</div>" for i in range(5)]
    rows += [f"<article><p>{copied}</p><p>{text(5)}</p></article>" for _ in range(2)]
    blocks = [pages.visible(r)[0] for r in rows]
    got = solved([([t for t, _ in b], "".join(str(k) for _, k in b)) for b in blocks])
    assert got[:5] == [f"{own[i]}\n\n{out[i]}" for i in range(5)]  # the shared line goes though inside, unique text stays though outside
    assert all(g.startswith(copied) for g in got[5:])  # a copied article stays


def test_copies_without_an_article_keep_their_text():
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    legal, copied, own = text(20), text(40), text(40)
    one = ([legal, copied], str(pages.SILENT) * 2)
    got = solved([one, ([], ""), one, ([own, legal], str(pages.SILENT) * 2), one])
    assert got == [copied, "", copied, own, copied]
    assert solved([one, one]) == [f"{legal}\n\n{copied}"] * 2


def test_ranges_give_what_one_range_gives(spark):
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for i in range(40):
        if i % 2 == 0:
            pair = text(20)  # on two pages of the host only
        own = text(30)
        rows.append((i, f"http://h.example/{i}", f"<div>{own}</div><div>{pair}</div>", "x", "y"))
        want[i] = own
    copied = text(50)
    rows += [(50 + k, f"http://h.example/copy{k}", f"<p>{copied}</p>", "x", "y") for k in range(4)]
    want |= {50 + k: copied for k in range(4)}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for size in (300, 3000, 10**6):
        got = pages.extract(frame, pages.PageParams(range_bytes=size)).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
