"""HTML extraction with a sampled host suffix array.

Pages are parsed into blocks of text, and a host's pages form one stream of tokens. Its
suffixes are compared by their first ``long`` tokens: two suffixes that agree there, on
two distinct pages of the host, are a repeated substring. Suffixes are sampled, by the
content alone: the least window hash among every ``reach`` windows in a row, and the first
and last window of each block and page. So every repeat of ``long + reach - 1`` tokens or
more holds a sampled suffix on both pages, sampled suffixes of one repeat overlap or touch,
and what they span is covered; a repeat that begins or ends with a block on both pages is
covered up to there, elsewhere it may lose up to ``reach - 1`` tokens at an end. A block
whose tokens are mostly covered is boilerplate.

Suffixes are dealt by ranges of their hash with the host mixed in, and sorted within
their range (told apart there by 36 bits of hash, and their pages by 28 bits: a mix-up is
rare, not impossible). The result does not depend on how many pages a host has or where
they lie. A suffix that a task sees on two pages is known to be shared and sent on for
matching twice only, so a line on all pages of a host makes no hot range. What is shared goes
back to its pages by the hash of their tokens, in a join that can be split where one page has many copies.

Repetition decides over every visible block, inside and outside article or main. Two
things it cannot tell: menus or adverts may be unique, so blocks that markup names
navigation, headers, footers, asides, forms, adverts, notices or comments are not visible;
and copies of an article repeat across pages and must stay, so when at least the share
``copied`` of all tokens inside a page's article or main is covered, those blocks stay; so
do all blocks of a page without article or main of which the share ``whole`` is covered.

Defined cases: null or empty html has an empty text; a null url is a host of its own; a
null page_id stays null; pages of equal visible tokens on one host are copies, which count as one page
where repeats are sought and have equal text each; extra columns are ignored; an empty table gives an empty result; unclosed or stray tags, comments and quotes
are read as far as they go (a tag with an unclosed quote ends at its first ``>``); whole pages are parsed, however long.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

KEEP, DROP, SILENT = 1, 0, 2
HASH_BITS, LOW = np.uint64(36), np.uint64((1 << 36) - 1)  # of a window within its range
SIGN_BITS, SIGN = np.uint64(28), np.uint64((1 << 28) - 1)  # of a page's tokens
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+[^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"\s+")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
OPTIONAL = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot", "colgroup", "rt", "rp"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "template", "svg", "head", "object", "canvas", "audio", "video", "math", "fieldset"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "form"}
HINT = re.compile(r"(?:^|[\s_-])(nav|navbar|navigation|menu|footer|sidebar|cookies?|consent|gdpr|notices?|banner|ads?|adv|advert|adverts|advertisement|sponsor|sponsored|promo|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|breadcrumbs?|comments?|commentlist|reply|replies|respond|disqus|login|signup|pagination|pager|toolbar|skip|masthead)(?:$|[\s_-])", re.I)
HEADER = re.compile(r"(?:^|[\s_-])(header|topbar|site-title)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?:has|with|no|without)[-_](?:sidebar|nav|menu|ads?|banner|comments?|footer|header)", re.I)


@dataclass(frozen=True)
class PageParams:
    long: int = 8  # tokens of a substring that counts
    covered: float = 0.8  # share of covered tokens from which a block goes
    copied: float = 0.5  # share of covered tokens from which an article or main is a copy and stays whole
    whole: float = 0.9  # share of covered tokens from which a page without article or main is a copy
    reach: int = 8  # windows in a row of which one is sampled, at most ``long``
    range_bytes: int = 8_000_000  # html whose suffixes are matched in one range, about


def _kind(tag: str, attributes: str, in_root: bool) -> int:
    """What an element says of its content: KEEP, DROP, or SILENT (nothing)."""
    if tag in CHROME:
        return DROP
    if tag == "header":
        return SILENT if in_root else DROP
    root = tag in ("article", "main")
    if not attributes or attributes.isspace():
        return KEEP if root else SILENT
    got = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
    if "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", got.get("style", ""), re.I):
        return DROP
    role = got.get("role", "").lower()
    if role in ROLES:
        return DROP
    if tag not in ("body", "html"):
        names = LAYOUT.sub(" ", f"{got.get('class', '')} {got.get('id', '')}")
        if HINT.search(re.search(r"(?i)\bcomments?\b", names).group() if root and re.search(r"(?i)\bcomments?\b", names) else "" if root else names):
            return DROP
        if not in_root and not root and HEADER.search(names):
            return DROP
    return KEEP if root or role == "main" or got.get("itemprop", "").lower() == "articlebody" else SILENT


def visible(page: str) -> tuple[list[tuple[str, int]], bool]:
    """Blocks of a page in order (text, KEEP or SILENT), and whether it has an article or main."""
    blocks: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    state, pos, end = SILENT, 0, len(page)
    roots = False

    def flush() -> None:
        if held:
            text = SPACES.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                blocks.append((text, state))

    while pos < end:
        m = MARK.search(page, pos)
        at = m.start() if m else end
        if at > pos and state != DROP:
            held.append(html.unescape(page[pos:at]))
        if not m:
            break
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        if tag in VOID:
            if tag == "br":
                held.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            flush()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag in INLINE and stack[k][1] != state:
                        flush()
                    del stack[k:]
                    state = stack[-1][1] if stack else SILENT
                    break
            continue
        if m[3] and m[3].endswith("/") and tag not in INLINE:
            continue
        if tag in OPTIONAL and stack and stack[-1][0] == tag:
            stack.pop()
            state = stack[-1][1] if stack else SILENT
        kind = DROP if state == DROP else _kind(tag, m[3], state == KEEP)
        inner = kind if kind != SILENT else state
        if tag in OPTIONAL and inner == state:
            continue
        if inner != state and tag in INLINE:
            flush()
        roots |= inner == KEEP
        stack.append((tag, inner))
        state = inner
    flush()
    return [(t, k) for t, k in blocks if k != DROP], roots


def parse(page: str) -> list[tuple[str, int]]:
    """Blocks of a page by markup alone: those inside article or main, or all visible ones of a page without."""
    blocks, roots = visible(page)
    return [(t, k) for t, k in blocks if k == KEEP or not roots]


def signatures(h: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each page's token stream; begins: first token of each page (pages + 1)."""
    size = np.diff(begins)
    up = np.cumprod(np.full(int(size.max(initial=0)) + 1, tk.MULS[0] | np.uint64(1)))
    inside = np.arange(len(h)) - np.repeat(begins[:-1], size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[inside], dtype=np.uint64)])
    return tk.mix(total[begins[1:]] - total[begins[:-1]] + size.astype(np.uint64))


def page_tokens(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of all pages; tokens before each block (blocks + 1) and before each page (pages + 1)."""
    data, offsets = tk.text_buffers(pa.array([t for texts in pages for t in texts], pa.string()))
    h, _, _, at = tk.words(data, offsets)
    return h, at, at[np.concatenate([[0], np.cumsum([len(texts) for texts in pages])]).astype(np.int64)]


def sampled(h: np.ndarray, at: np.ndarray, begins: np.ndarray, long: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Where sampled suffixes start, ascending, and the hashes of their first ``long`` tokens.

    at: tokens before each block; begins: tokens before each page.
    """
    w, whole = tk.windows(h, begins, long)
    if not whole.any():
        return np.zeros(0, np.int64), w[:0]
    marks = np.zeros(len(h), bool)
    for edges in (at, begins):
        long_enough = np.diff(edges) >= long
        marks[edges[:-1][long_enough]] = True
        marks[edges[1:][long_enough] - long] = True
    n = len(h) - reach + 1
    if n > 0:
        # windows i to i + reach - 1 lie in one page when the last one does
        best, arg = w[:n].copy(), np.arange(n)
        for k in range(1, reach):
            less = w[k : n + k] < best
            best[less] = w[k : n + k][less]
            arg[less] = np.flatnonzero(less) + k
        page_end = np.repeat(begins[1:], np.diff(begins))[:n]
        marks[arg[np.arange(n) + reach - 1 + long <= page_end]] = True
    where = np.flatnonzero(marks & whole)
    return where, w[where]


def host_keys(w: np.ndarray, hosts: np.ndarray, bits: int) -> np.ndarray:
    """Range (``bits`` bits) and hash (36 bits) of windows; hosts: the host's hash for each."""
    mixed = tk.mix(w ^ hosts)
    return (mixed >> np.uint64(64 - bits) if bits else np.zeros_like(mixed)) << HASH_BITS | mixed & LOW


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end place of each run of equal values."""
    heads = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)
    return heads, np.append(heads[1:], len(sorted_values)).astype(np.int64) if len(heads) else heads


def by_sign(signs: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """One row for each sign: its keys."""
    order = np.argsort(signs, kind="stable")
    signs, keys = signs[order], keys[order]
    heads, tails = runs(signs)
    return pa.record_batch([pa.array(signs[heads].astype(np.int64)), pa.array([np.unique(keys[lo:hi]).tobytes() for lo, hi in zip(heads, tails, strict=True)], pa.binary())], names=["sign", "keys"])


def covered_tokens(h: np.ndarray, at: np.ndarray, begins: np.ndarray, hosts: np.ndarray, shared: list[np.ndarray], q: PageParams, bits: int) -> np.ndarray:
    """Which tokens lie in the first ``long`` tokens of a shared suffix; shared: keys by page."""
    where, w = sampled(h, at, begins, q.long, q.reach)
    page = np.searchsorted(begins, where, "right") - 1
    keys = host_keys(w, hosts[page], bits)
    marks = np.zeros(len(h) + 1, np.int64)
    cuts = np.searchsorted(page, np.arange(len(begins)))
    for r, own in enumerate(shared):
        if len(own) and cuts[r] < cuts[r + 1]:
            hit = where[cuts[r] : cuts[r + 1]][np.isin(keys[cuts[r] : cuts[r + 1]], own)]
            marks[hit] += 1
            marks[hit + q.long] -= 1
    return np.cumsum(marks[:-1]) > 0


def select_blocks(pages: list[tuple[list[str], str]], hosts: np.ndarray, shared: list[np.ndarray], q: PageParams, bits: int) -> list[str]:
    """The main text of each page. pages: block texts, and their kinds as digits."""
    h, at, begins = page_tokens([texts for texts, _ in pages])
    count = np.diff(begins)
    cover = np.concatenate([[0], np.cumsum(covered_tokens(h, at, begins, hosts, shared, q, bits))])
    size, seen = np.diff(at), cover[at[1:]] - cover[at[:-1]]
    page_of_block = np.repeat(np.arange(len(pages)), [len(t) for t, _ in pages])
    inside = np.array([k == str(KEEP) for _, kinds in pages for k in kinds], bool)
    rooted, met = (np.bincount(page_of_block[inside], x[inside], len(pages)) for x in (size, seen))
    copy = (met >= q.copied * rooted) & (met > 0)
    alone = (rooted == 0) & (np.bincount(page_of_block, seen, len(pages)) >= q.whole * np.maximum(1, count))
    stays = (seen < q.covered * np.maximum(1, size)) | inside & copy[page_of_block] | alone[page_of_block]
    out, b = [], 0
    for texts, _ in pages:
        out.append("\n\n".join(t for i, t in enumerate(texts) if stays[b + i]))
        b += len(texts)
    return out


def shared_suffixes(source: DataFrame, q: PageParams, bits: int) -> DataFrame:
    """(sign, keys): sampled suffixes on two distinct pages of a host or more, for the pages that hold them.

    source: (html, host). A page is known by the hash of its tokens.
    """
    schema = "r long, codes binary, known binary"

    def read(batches):
        held: list[np.ndarray] = []
        size = turn = 0

        def out(turn):
            keys, signs = np.concatenate(held, axis=1)
            order = np.lexsort((signs, keys))
            keys, signs = keys[order], signs[order]
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (signs[1:] != signs[:-1])])
            keys, signs = keys[new], signs[new]
            heads, tails = runs(keys)
            length = np.repeat(tails - heads, tails - heads)
            place = np.arange(len(keys)) - np.repeat(heads, tails - heads)
            send, known = place < 2, length > 1
            r, codes = (keys >> HASH_BITS)[send], ((keys & LOW) << SIGN_BITS | signs)[send]
            cuts, ends = runs(r)
            yield pa.record_batch([pa.array(r[cuts].astype(np.int64)), pa.array([codes[lo:hi].tobytes() for lo, hi in zip(cuts, ends, strict=True)], pa.binary()), pa.array([b""] * len(cuts), pa.binary())], names=["r", "codes", "known"])
            if known.any():  # needs no matching, so it may go to any range
                pairs = np.stack([signs[known], keys[known]])
                to = int(xxhash.xxh3_64_intdigest(pairs.tobytes())) >> (64 - bits) if bits else 0
                yield pa.record_batch([pa.array([to], pa.int64()), pa.array([b""], pa.binary()), pa.array([pairs.tobytes()], pa.binary())], names=["r", "codes", "known"])

        for batch in tk.sized_batches(batches, column="html"):
            h, at, begins = page_tokens([[t for t, _ in visible(page or "")[0]] for page in batch.column(0).to_pylist()])
            where, w = sampled(h, at, begins, q.long, q.reach)
            page = np.searchsorted(begins, where, "right") - 1
            held.append(np.stack([host_keys(w, host_hashes(batch.column(1))[page], bits), (signatures(h, begins) & SIGN)[page]]))
            size += len(w)
            if size > 1_000_000:
                yield from out(turn)
                held.clear()
                size, turn = 0, turn + 1
        if size:
            yield from out(turn)

    def meet(table):
        codes = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]))
        w = codes >> SIGN_BITS
        again = w[1:] == w[:-1]
        codes = codes[np.concatenate([[False], again]) | np.concatenate([again, [False]])] if len(codes) else codes
        known = np.concatenate([np.zeros((2, 0), np.uint64), *(np.frombuffer(x, np.uint64).reshape(2, -1) for x in table.column("known").to_pylist())], axis=1)
        r = np.uint64(table.column("r")[0].as_py())
        return pa.Table.from_batches([by_sign(np.concatenate([codes & SIGN, known[0]]), np.concatenate([r << HASH_BITS | codes >> SIGN_BITS, known[1]]))])

    rows = source.select("html", "host").mapInArrow(read, schema).groupBy("r").applyInArrow(meet, "sign long, keys binary")
    return rows.groupBy("sign").agg(F.collect_set("keys").alias("keys"))


def host_hashes(hosts: pa.Array) -> np.ndarray:
    names = hosts.dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(x) for x in names.dictionary.to_pylist()] or [0], np.uint64)
    return table[names.indices.to_numpy(zero_copy_only=False)]


def extract(pages: DataFrame, q: PageParams = PageParams()) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    bits = min(28, max(0, -(-total // q.range_bytes) - 1).bit_length())

    def read(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in tk.sized_batches(batches, column="html"):
            texts, kinds = [], []
            for page in batch.column(2).to_pylist():
                got, _ = visible(page or "")
                texts.append([t for t, _ in got])
                kinds.append("".join(str(k) for _, k in got))
            h, _, begins = page_tokens(texts)
            # blocks hold no line break, so one parts them
            packed = [press.compress("\n".join(t).encode("utf-8", "replace")) for t in texts]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(host_hashes(batch.column(3)).view(np.int64)), pa.array((signatures(h, begins) & SIGN).astype(np.int64)), pa.array(packed, pa.binary()), pa.array(kinds, pa.string())], names=["page_id", "url", "host", "sign", "blocks", "kinds"])

    def solve(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = batch.to_pydict()
            lo = size = 0
            for r in range(batch.num_rows):
                size += len(rows["blocks"][r]) + sum(map(len, rows["keys"][r] or ()))
                if size >= 1 << 20 or r + 1 == batch.num_rows:
                    some = range(lo, r + 1)
                    held = [(unpack.decompress(rows["blocks"][i]).decode().split("\n") if rows["kinds"][i] else [], rows["kinds"][i]) for i in some]
                    shared = [np.frombuffer(b"".join(rows["keys"][i] or ()), np.uint64) for i in some]
                    got = select_blocks(held, np.array([rows["host"][i] for i in some], np.int64).view(np.uint64), shared, q, bits)
                    yield pa.record_batch([pa.array(rows["page_id"][lo : r + 1], pa.int64()), pa.array(rows["url"][lo : r + 1], pa.string()), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])
                    lo, size = r + 1, 0
        tk.hand_back()

    parsed = source.mapInArrow(read, "page_id long, url string, host long, sign long, blocks binary, kinds string")
    joined = parsed.join(shared_suffixes(source, q, bits).hint("merge"), "sign", "left")
    return joined.select("page_id", "url", "host", "blocks", "kinds", "keys").mapInArrow(solve, "page_id long, url string, text string, n_chars long")
