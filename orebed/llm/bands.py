"""Quality rules by compression bands.

zstandard ratios (bytes over compressed bytes) of the whole text and of fixed chunks
(the last one aligned to the end, so that every byte of a text of a chunk or more is
judged) are held against limits that depend on the text's length: a ratio above the band means
repetition or marks that recur, one below it means noise that no prose shows. Prose compresses
better the longer it is, so limits rise with length, by classes of about half an octave. The
default limits were set from labelled prose in four languages: the upper ones stand 2 to 10
percent above the greatest ratio of good texts in each class, the lower ones well under the
least (random letters, base64 and the like fall below). Chunks have limits of
their own, tighter in longer texts, where one odd chunk among many is allowed.

Defined cases: null or empty text has no words, all counts 0, base_failed true, kept
false; a null doc_id stays null; repeated rows are judged row by row; extra columns are
ignored; an empty table gives an empty result. Every text is compressed whole, however long.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import textkit as tk

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"[#*$%&|<>]"[1:-1], np.uint8))


@dataclass(frozen=True)
class Bands:
    """(text bytes from which a band holds, least ratio, greatest ratio), longest first; the first that fits holds."""

    whole: tuple[tuple[int, float, float], ...] = (
        (256_000, 1.7, 3.0), (128_000, 1.7, 2.9), (64_000, 1.7, 2.8), (32_000, 1.7, 2.7), (22_000, 1.7, 2.62), (16_000, 1.7, 2.57), (11_000, 1.7, 2.52), (8_000, 1.7, 2.46),
        (5_600, 1.7, 2.42), (4_000, 1.6, 2.36), (2_800, 1.6, 2.3), (2_000, 1.5, 2.24), (1_400, 1.5, 2.18), (1_000, 1.35, 2.1), (700, 1.35, 2.03), (500, 1.2, 2.0), (400, 1.2, 1.95),
        (300, 1.2, 1.9), (100, 1.05, 1.9), (0, 0.0, 1e9))
    chunk_bytes: int = 1024
    chunks: tuple[tuple[int, float, float], ...] = ((16_000, 1.45, 2.02), (4_000, 1.45, 2.04), (0, 1.4, 2.08))
    bad_share: float = 0.2  # of chunks outside their band, at most
    level: int = 3


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Word, symbol, repeated-line and repeated-window counts of each row."""
    n = len(offsets) - 1
    h, s, e, at = tk.words(data, offsets, lower=False)
    points = tk.code_points(data)
    per = np.concatenate([[0], np.cumsum(points[e] - points[s])])
    out = {"n_words": np.diff(at), "word_chars": per[at[1:]] - per[at[:-1]]}
    sym = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    out["n_symbols"] = sym[offsets[1:]] - sym[offsets[:-1]]
    tri, whole = tk.windows(h, at, 3)
    repeat, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    breaks = np.flatnonzero(data == 10)
    # a line is the words between two line breaks; its text, not its words, decides equality
    for r in range(n):
        lo, hi = at[r], at[r + 1]
        if hi - lo >= 4:
            w = tri[lo : hi - 2]
            order = np.argsort(w, kind="stable")
            sw = w[order]
            same = sw[1:] == sw[:-1]
            if same.any():
                twice = np.zeros(len(w), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(hi - lo, bool)
                for k in range(3):
                    cover[k : k + len(w)] |= twice
                repeat[r] = int(cover.sum())
        b0, b1 = np.searchsorted(breaks, [offsets[r], offsets[r + 1]])
        if b1 > b0:
            lines = data[offsets[r] : offsets[r + 1]].tobytes().split(b"\n")
            seen: set[bytes] = set()
            for line in lines:
                if line in seen:
                    dup[r] += 1
                elif line.split():
                    seen.add(line)
    return out | {"n_dup_lines": dup, "n_repeat_words": repeat}


def band(classes: tuple[tuple[int, float, float], ...], size: int) -> tuple[float, float]:
    """Least and greatest ratio for a text of so many bytes."""
    return next((low, high) for least, low, high in classes if size >= least)


def verdict(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole text, chunks outside their band, chunks, and whether the text passes."""
    ratio = len(raw) / len(press.compress(raw)) if raw else 0.0
    (low, high), (chunk_low, chunk_high) = band(bands.whole, len(raw)), band(bands.chunks, len(raw))
    size, bad, n = bands.chunk_bytes, 0, 0
    starts = list(range(0, len(raw) - size + 1, size))
    if starts and starts[-1] + size < len(raw):
        starts.append(len(raw) - size)  # the tail is judged by a last chunk that ends with the text
    for i in starts:
        r = size / len(press.compress(raw[i : i + size]))
        bad += not chunk_low <= r <= chunk_high
        n += 1
    return ratio, bad, n, low <= ratio <= high and bad <= bands.bad_share * n


def compression_rules(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per document: base counts, base verdict, ratios, and kept. No shuffle: one pass over the scan."""

    def judge(batches):
        press = zstandard.ZstdCompressor(level=bands.level)
        for batch in tk.sized_batches(batches):
            data, offsets = tk.text_buffers(batch.column(1))
            c = counts(data, offsets)
            failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
            got = [verdict(data[offsets[r] : offsets[r + 1]].tobytes(), bands, press) for r in range(batch.num_rows)]
            ratio, bad, n, ok = zip(*got, strict=True)
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array(failed), pa.array(~failed & np.array(ok)), pa.array(ratio, pa.float64()), pa.array(bad, pa.int64()), pa.array(n, pa.int64())],
                names=[p.split()[0] for p in SCHEMA.split(", ")],
            )

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, SCHEMA)
