"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

Documents are packed block by block (a bounded number of rows and tokens). Whole windows
are cut off each document's front; what is left is cut into pieces of at most ``grain``
tokens. The block's pieces, sorted by size, form partial partitions of one piece per
window; the two partial partitions with the largest imbalance are merged largest against
smallest until one is left. If a window then exceeds the capacity, the window count rises
by one and the differencing starts anew.

Defined cases: null text counts as empty and yields the end id alone; a null doc_id stays
null; repeated rows are packed as often as they come; extra columns are ignored; an empty
table gives an empty result; a very long document fills windows of its own first. The
result is a function of the input's partitions, so a task that runs again yields the same
rows. Texts hold no special tokens: their strings are ordinary text.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import textkit as tk

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CACHE_ENTRIES = 200_000
#: Fixed value: the pattern by which byte-level BPE cuts a text into units.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ODD_SPACE = re.compile(r"\s\s|^\s|\s$")


class Units(dict):
    """Ids of ' ' + unit, kept until the table is full; the words met first and most are in it."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(" " + unit)
        if len(self) < CACHE_ENTRIES and len(unit) < 64:
            self[unit] = ids
        return ids


class Encoder:
    """Ids of whole texts, as the tokenizer file defines them.

    A text is cut where a single space stands between two inked characters: there the
    tokenizer's own pattern always starts a new unit, so units can be encoded and kept by
    themselves. Texts with other white space around a space are encoded in one piece.
    A byte-level BPE file is run by tiktoken on the file's own vocabulary (the same ids,
    several times as fast); any other file by the tokenizers library.
    """

    def __init__(self, path: str) -> None:
        self.path, self.core = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] == "BPE" and kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and not spec.get("normalizer"):
            import tiktoken

            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
            hidden = [b for b in range(256) if b not in shown]
            byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
            special = {t["content"] for t in spec["added_tokens"]}
            ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.units = Units(self.plain)

    @cached_property
    def model(self):
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(self.path)
        model.encode_special_tokens = True
        return model

    def plain(self, text: str) -> bytes:
        ids = self.core.encode_ordinary(text) if self.core else self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        head, _, rest = text.partition(" ")
        if self.core is None or not rest or ODD_SPACE.search(text):
            return self.plain(text)
        return self.plain(head) + b"".join(map(self.units.__getitem__, rest.split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process; its units stay known from task to task."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def difference(sizes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece when the pieces are spread over m windows, and the windows' sums."""
    order = np.argsort(-sizes, kind="stable")
    n = len(order)
    tuples = []
    for k, lo in enumerate(range(0, n, m)):
        members = np.full(m, -1)
        members[: min(m, n - lo)] = order[lo : lo + m]
        sums = np.where(members >= 0, sizes[members], 0)
        tuples.append((-int(sums.max() - sums.min()), k, sums, members[:, None]))
    heapq.heapify(tuples)
    k = len(tuples)
    while len(tuples) > 1:
        _, _, a, ma = heapq.heappop(tuples)
        _, _, b, mb = heapq.heappop(tuples)
        down, up = np.argsort(-a, kind="stable"), np.argsort(b, kind="stable")
        sums = a[down] + b[up]
        heapq.heappush(tuples, (-int(sums.max() - sums.min()), k, sums, np.concatenate([ma[down], mb[up]], axis=1)))
        k += 1
    _, _, sums, members = tuples[0]
    window = np.zeros(n, dtype=np.int64)
    for w in range(m):
        window[members[w][members[w] >= 0]] = w
    return window, sums


def spread(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Fewest windows, from the least possible upwards, for which differencing fits the capacity."""
    m = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = difference(sizes, m)
        if sums.max() <= capacity:
            return window, m
        m += 1


def pack(documents: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 1, grain: int = 512, block_rows: int = 1024, block_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece. One pass over the scan, no shuffle; sequence ids are unique over the whole table."""

    def run(batches):
        encode = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4").tobytes()
        base, used = TaskContext.get().partitionId() << 36, 0
        rows: list[tuple[int | None, bytes]] = []

        def flush():
            nonlocal used
            out, tails = [], []
            for doc, ids in rows:
                n = len(ids) // 4
                full = n // capacity * capacity
                for at in range(0, full, capacity):
                    out.append((doc, at, capacity, zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n, base + used, 0))
                    used += 1
                for at in range(full, n, grain):
                    tails.append((doc, at, min(grain, n - at), zlib.crc32(ids[4 * at : 4 * min(n, at + grain)]), n))
            if tails:
                window, m = spread(np.array([t[2] for t in tails]), capacity)
                filled = [0] * m
                for t, w in zip(tails, window.tolist(), strict=True):
                    out.append((*t, base + used + w, filled[w]))
                    filled[w] += t[2]
                used += m
            rows.clear()
            columns = list(zip(*out, strict=True))
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=[p.split()[0] for p in SCHEMA.split(", ")])

        held = 0
        for batch in tk.sized_batches(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows.append((doc, (encode(text) if text else b"") + end))
                held += len(rows[-1][1]) // 4
                if len(rows) >= block_rows or held >= block_tokens:
                    yield flush()
                    held = 0
        if rows:
            yield flush()

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
