"""Secret scans with a linear-chain conditional random field.

Three fixed patterns give the base spans. A conditional random field then tags every token
as beginning, inside or outside a secret, from the token's shape, its neighbouring words and
separators, and features of the whole file, and is decoded by Viterbi. Tokens are runs of
``[A-Za-z0-9+/_.=-]``; a ``=`` before a letter parts two tokens. Features are small
numbers worked out for all tokens of a batch at once, and a token's score is a sum of table rows.

Most tokens need no lattice: if a path with token t inside a secret gains by putting t
outside (and starting what follows anew), whatever the other tags are, then t is outside in
the best path. This is checked with the token's own scores, its successor's and the worst
change of transitions, for all tokens at once. The chain falls into runs of the other tokens, which are
decoded between outside tokens; the result is that of decoding the whole chain.

The field is trained here, by full-batch gradient steps on the conditional likelihood of
lines made from templates with a fixed seed; no document is used for it.

Defined cases: null or empty text has no spans (the digest is that of the empty string);
null doc_ids stay null; repeated rows are scanned row by row; extra columns are ignored; an
empty table gives an empty result; whole texts are scanned, however long. Spans count code
points. A field's span that meets a base span is dropped; base spans always stay.
"""

from __future__ import annotations

import itertools
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as tk

#: The base patterns, their order and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

def _set(chars: str | bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars.encode() if isinstance(chars, str) else chars, np.uint8))


TOKEN, HEX, DIGIT = _set(string.ascii_letters + string.digits + "+/_.=-"), _set("0123456789abcdef"), _set(string.digits)
LOWER, UPPER, VOWEL, HEXISH = _set(string.ascii_lowercase), _set(string.ascii_uppercase), _set("aeiouyAEIOUY"), _set(string.hexdigits)
NUMERIC, QUOTE, PAREN = _set(string.digits + ".+-"), _set("\"'`"), _set("()")
CLASS = LOWER.astype(np.uint8) + 2 * UPPER.astype(np.uint8) + 3 * DIGIT.astype(np.uint8)
#: Beginnings, of three and four letters, of words that name secrets.
NAMES3 = (b"pwd", b"key", b"sig")
NAMES4 = (b"pass", b"secr", b"toke", b"auth", b"bear", b"cred", b"priv", b"cert")
#: Beginnings of tokens that well-known services issue.
ISSUED = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"sk-", b"sk_", b"pk_", b"rk_", b"xox", b"eyJ", b"AIza", b"glpat-", b"npm_", b"SG.", b"MII")
LENGTHS = np.digitize(np.arange(80), [2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64])
O, B, I = 0, 1, 2
SCHEMA = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
#: Features and their numbers of values; tables of up to GROUP values are added up from several features.
FEATURES = {"length": 16, "kinds": 32, "turns": 28, "vowels": 40, "hex": 2, "number": 2, "issued": 2, "marks": 16, "title": 2, "before": 8, "edges": 16, "named": 8, "named_size": 64, "next": 4, "size_kinds": 96, "changes": 12, "file": 4}
GROUP = 4096
BATCH = 1 << 19  # bytes of text worked on at once: features take some dozen arrays of that length


def cut_runs(mask: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a mask; a run that crosses rows is several runs."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    s, e = edge[::2], edge[1::2]
    if len(inner) and len(s):
        k = np.searchsorted(s, inner, "right") - 1
        over = (k >= 0) & (e[np.maximum(k, 0)] > inner) & (s[np.maximum(k, 0)] < inner)
        s, e = np.sort(np.concatenate([s, inner[over]])), np.sort(np.concatenate([e, inner[over]]))
    return s, e


class Tokens:
    """All tokens of a batch of rows (bytes ``b``, row offsets ``at`` from 0) and their features."""

    def __init__(self, b: np.ndarray, at: np.ndarray) -> None:
        self.b, self.at = b, at
        self.inner = np.unique(at[(at > 0) & (at < len(b))])
        mask = TOKEN[b]
        sign = b == 61
        if len(b) > 1:
            parts = sign[:-1] & TOKEN[b[1:]] & ~sign[1:]
            parts[self.inner - 1] = False  # what follows is another row
            mask[:-1] &= ~parts
        self.start, self.end = cut_runs(mask, self.inner)
        self.first = np.searchsorted(self.start, at[:-1], "left")
        self.last = np.searchsorted(self.start, at[1:], "left")
        self.row = np.repeat(np.arange(len(at) - 1), self.last - self.first)
        self.digits = self._before(DIGIT[b])
        self.sets = self._before(sign | (b == 58))

    @staticmethod
    def _before(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=out[1:])
        return out

    def _named(self) -> np.ndarray:
        """Tokens under 40 bytes that hold the beginning of a word that names secrets."""
        small = (self.b | 0x20).astype(np.uint32)
        hit = np.zeros(len(small), bool)
        if len(small) > 2:
            three = small[:-2] << 16 | small[1:-1] << 8 | small[2:]
            for name in NAMES3:
                hit[:-2] |= three == int.from_bytes(name, "big")
            hit[self.inner - 1] = hit[np.maximum(0, self.inner - 2)] = False  # names end in their row
            if len(small) > 3:
                four = three[:-1] << 8 | small[3:]
                long = np.zeros(len(four), bool)
                for name in NAMES4:
                    long |= four == int.from_bytes(name, "big")
                for k in (1, 2, 3):
                    long[np.minimum(np.maximum(0, self.inner - k), len(long) - 1)] = False
                hit[:-3] |= long
        seen = self._before(hit)
        return (seen[self.end] > seen[self.start]) & (self.end - self.start < 40)

    def _issued(self) -> np.ndarray:
        out = np.zeros(len(self.start), bool)
        maybe = np.flatnonzero(_set(bytes({x[0] for x in ISSUED}))[self.b[self.start]] & (self.end - self.start >= 8))
        raw = self.b.tobytes()
        for i in maybe.tolist():
            out[i] = raw.startswith(ISSUED, int(self.start[i]))
        return out

    def features(self) -> list[np.ndarray]:
        """The value of each feature of FEATURES for every token."""
        b, s, e = self.b, self.start, self.end
        if not len(s):
            return [np.zeros(0, np.int64) for _ in FEATURES]
        n = e - s
        count = lambda mask: (lambda c: c[e] - c[s])(self._before(mask))
        lower, upper, digit, vowel = count(LOWER[b]), count(UPPER[b]), self.digits[e] - self.digits[s], count(VOWEL[b])
        letters = lower + upper
        kind = CLASS[b]
        differ, other = np.zeros(len(b), bool), np.zeros(len(b), bool)
        differ[1:], other[1:] = kind[1:] != kind[:-1], b[1:] != b[:-1]
        turn, change = self._before(differ), self._before(other)
        turn, change = turn[e] - turn[s + 1], change[e] - change[s + 1]
        gaps = np.maximum(1, n - 1)
        size = LENGTHS[np.minimum(n, 79)]
        five = np.minimum(4, n // 6)
        kinds = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (lower + upper + digit < n)
        left, right = np.where(s > 0, b[s - 1], 32), np.where(e < len(b), b[np.minimum(e, len(b) - 1)], 32)
        row_start = self.at[self.row]
        left = np.where(s > row_start, left, 32)
        right = np.where(e < self.at[self.row + 1], right, 32)
        alone = np.zeros(len(s), bool)
        alone[self.first[self.first < self.last]] = True
        gap = np.where(alone, np.maximum(row_start, s - 8), np.concatenate([[0], e[:-1]]))
        between = lambda c: c[s] > c[gap]
        line, at_sign = self._before(b == 10), self._before(b == 64)
        assigned = between(self.sets)
        named = self._named()
        p1 = np.concatenate([[False], named[:-1]]) & ~alone
        second = np.concatenate([[False], alone[:-1]]) | alone
        p2 = np.concatenate([[False, False], named[:-2]])[: len(s)] & ~second
        follow = np.concatenate([n[1:], [0]])
        follow[self.last[self.first < self.last] - 1] = 0
        dots = [count(b == ord(c)) > 0 for c in "/.-_"]
        share = np.diff(self.at)
        file = (20 * np.diff(self.digits[self.at]) > share) + 2 * (60 * np.diff(self.sets[self.at]) > share)
        long = np.minimum(3, n // 8)
        return [
            size, kinds + 16 * ((left >= 128) | (right >= 128)), np.minimum(6, 10 * turn // gaps) * 4 + long, np.where(letters > 0, np.minimum(8, 10 * vowel // np.maximum(1, letters)), 9) * 4 + long,
            (letters > 0) & (digit > 0) & (count(HEXISH[b]) == n) & ((lower == 0) | (upper == 0)), count(NUMERIC[b]) == n, self._issued(), dots[0] + 2 * dots[1] + 4 * dots[2] + 8 * dots[3],
            (upper == 1) & UPPER[b[s]], between(line) + 2 * assigned + 4 * (between(at_sign) | (right == 64)), QUOTE[left] + 2 * QUOTE[right] + 4 * PAREN[left] + 8 * PAREN[right], p1 + 2 * p2 + 4 * named,
            (p1 + 2 * (assigned & (p1 | p2))) * 16 + size, np.minimum(3, follow // 12), kinds * 6 + five + (five == 4) * (n >= 40), np.minimum(3, 4 * change // gaps) * 3 + np.minimum(2, n // 6), file[self.row]]


# ---- the field ----------------------------------------------------------------------------


def _lines(rng: random.Random):
    """Template lines: (text, spans of secrets)."""

    def word(lo=2, hi=11):
        """Syllables, as in prose, or letters in the proportions of prose."""
        if rng.random() < 0.3:
            return "".join(rng.choice("eaiotnrshlducmeaiotnrshlducmgpfbvwykqxz") for _ in range(rng.randint(lo, hi)))
        out = ""
        while len(out) < lo:
            out += "".join(rng.choice(["th", "st", "ing", "er", "an", "ch", "qu", "tion", "ent", "ou", "re", "le", "zu", "ver", "ment", "ar", "os", "ble", "wh", "sh", "on", "es", "a", "b", "in", "ly", "heit", "pf", "tz", "ió"]) for _ in range(rng.randint(1, 4)))
        return out[:hi].replace("ió", "io")

    def take(chars, lo, hi):
        return "".join(rng.choice(chars) for _ in range(rng.randint(lo, hi)))

    alnum = string.ascii_letters + string.digits
    made = {
        "b64": lambda: take(alnum + "+/", 24, 64) + rng.choice(["", "=", "=="]),
        "mixed": lambda: take(alnum, 20, 48) + rng.choice(string.digits) + rng.choice(string.ascii_uppercase) + rng.choice(string.ascii_lowercase),
        "pre": lambda: rng.choice(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "AIza", "glpat-", "npm_", "eyJ", "ASIA"]) + take(alnum, 20, 44),
        "HEX": lambda: take("0123456789ABCDEF", 24, 64),
        "hex": lambda: take("0123456789abcdef", 24, 64),
        "short": lambda: take(alnum, 6, 14) + rng.choice(string.digits) + take(alnum, 1, 5),
        "letters": lambda: take(string.ascii_letters, 10, 28),
        "low": lambda: take("bcdfghjklmnpqrstvwxzaeiou", 9, 24),
        "parts": lambda: "-".join(take(alnum, 4, 8) for _ in range(rng.randint(3, 5))),
        "dotted": lambda: ".".join(take(alnum + "_-", 16, 50) for _ in range(rng.randint(2, 3))),
    }
    plain = {
        "card": lambda: take(string.digits, 13, 19),
        "phone": lambda: f"({take(string.digits, 3, 3)}) {take(string.digits, 3, 3)}-{take(string.digits, 4, 4)}",
        "plus": lambda: f"+{take(string.digits, 10, 12)}",
        "mail": lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.{word()}.com",
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "year": lambda: rng.choice([str(rng.randint(1, 3000)), f"{rng.randint(1, 99)}.{rng.randint(0, 99)}", f"{rng.randint(1, 12)}-{rng.randint(1, 28)}-{rng.randint(1900, 2030)}"]),
        "long": lambda: word(16, 40),
        "compound": lambda: "-".join(word(3, 9) for _ in range(rng.randint(2, 5))),
        "name9": lambda: word() + str(rng.randint(0, 999)),
        "url": lambda: "www." + word() + ".com/" + "/".join(word() + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 3))),
        "uuid": lambda: "-".join(take("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)),
        "rule": lambda: rng.choice("-=_.") * rng.randint(3, 60),
        "camel": lambda: "".join(word(3, 8).title() for _ in range(rng.randint(2, 5))),
        "const": lambda: "_".join(word(3, 8).upper() for _ in range(rng.randint(2, 5))),
        "title": lambda: word().title(),
        "upper": lambda: word().upper(),
        "version": lambda: f"v{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        "number": lambda: rng.choice([f"{rng.randint(0, 10**6):,}", f"{rng.random() * 100:.2f}", f"{rng.randint(1, 12)}:{rng.randint(10, 59)}", f"#{rng.randint(1, 9999)}"]),
        "mail2": lambda: f"{word()}{rng.randint(0, 999)}@{word()}.{rng.choice(['com', 'org', 'example.com'])}",
        "path": lambda: "/" + "/".join(word(2, 8) for _ in range(rng.randint(2, 5))) + rng.choice(["", ".py", ".html"]),
        "term": lambda: rng.choice(["SPDX-License-Identifier", "Apache-2.0", "BSD-3-Clause", "ISO-8859-1", "UTF-8", "COVID-19", "http://www.w3.org/1999/xhtml", "2019-2024"]),
        "marked": lambda: rng.choice("#*$%&|") * rng.randint(1, 3) + word() + rng.choice("#*$%&|") * 3,
        "accent": lambda: word(1, 4) + rng.choice("éèüöñçóß") + word(0, 6) + rng.choice("éüñaeo") + word(0, 4),
        "file": lambda: f"{word()}_{rng.randint(0, 9999)}.{rng.choice(['png', 'csv', 'tar.gz'])}",
    }
    names = ["auth", "private_key", "access_key", "credential", "client_secret", "bearer", "signature", "pwd", "API-KEY", "authorization", "passphrase", "auth_key", "signing key", "session_cert", "PWD", "DB_PASS"]
    while True:
        parts, spans, at = [], [], 0

        def put(s, secret=False):
            nonlocal at
            parts.append(s)
            if secret:
                spans.append((at, at + len(s)))
            at += len(s)

        def prose(most):
            for _ in range(rng.randint(0, most)):
                x = word() if rng.random() < 0.8 else plain[rng.choice(["title", "accent", "upper", "compound", "marked", "number", "camel"])]()
                put(x + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", " | ", "; ", ": ", " - "]))

        prose(10)
        kind = rng.random()
        if kind < 0.42:
            q = rng.choice(['"', "'", "", ""])
            put(rng.choice(names) + rng.choice(['"', "", "", ""]) + rng.choice([" = ", "=", ": ", " : ", " ", " is "]) + q)
            put(made[rng.choice(list(made))](), True)
            put(q)
        elif kind < 0.52:
            put(made[rng.choice(["b64", "mixed", "pre", "dotted"])](), True)
        elif kind < 0.6:
            for _ in range(rng.randint(2, 4)):
                put("\n")
                put(take(alnum + "+/", 64, 64), True)
            if rng.random() < 0.5:
                put("\n")
                put(take(alnum + "+/", 5, 40) + rng.choice(["", "=", "=="]), True)
            spans[:] = [(spans[0][0], spans[-1][1])]
        else:
            for _ in range(rng.randint(1, 4)):
                if rng.random() < 0.25:
                    put(rng.choice([*names, "key", "token", "author", "passed", "certain", "signs", "keys"]) + rng.choice([" ", ": ", " = ", ", "]))
                put(plain[rng.choice(list(plain))]() + rng.choice([" ", ", ", ". ", "\n", ") "]))
        put(rng.choice([" ", "\n", ", ", "; ", ""]))
        prose(8)
        yield "".join(parts), spans


class Field:
    """Weights of the linear chain: emissions by feature value and (3, 3) transitions."""

    def __init__(self, lines: int = 2200, steps: int = 60, seed: int = 11) -> None:
        source = _lines(random.Random(seed))
        texts, gold = zip(*(next(source) for _ in range(lines)), strict=True)
        t = Tokens(*tk.text_buffers(pa.array(texts)))
        # template lines are short, so features of the whole text are drawn anew for each
        drawn = np.random.default_rng(seed).choice(4, len(texts), p=[0.55, 0.15, 0.15, 0.15])[t.row]
        values = np.stack([*t.features()[:-1], drawn], axis=1) + np.cumsum([0, *FEATURES.values()])[:-1]
        kinds, self_of = np.unique(values, axis=0, return_inverse=True)
        tags = np.zeros(len(t.start), np.int64)
        for r, spans in enumerate(gold):
            if spans:
                points = tk.code_points(t.b[t.at[r] : t.at[r + 1]])
                own = np.arange(t.first[r], t.last[r])
                begin = points[t.start[own] - t.at[r]]
                for lo, hi in spans:
                    hit = own[(begin >= lo) & (begin < hi)]
                    tags[hit] = I
                    tags[hit[:1]] = B
        self.flat, self.moves = np.zeros((sum(FEATURES.values()), 3)), np.zeros((3, 3))
        self.moves[O, I] = -30.0  # a secret begins with B
        self._fit(kinds, self_of.ravel(), tags, t.first, t.last, steps)
        self._tables()

    def _fit(self, kinds, kind_of, tags, first, last, steps: int) -> None:
        size = last - first
        order = np.flatnonzero(size > 0)
        first, size = first[order], size[order]
        longest, n = int(size.max()), len(order)
        place = np.minimum(first[:, None] + np.arange(longest), len(tags) - 1)
        live = np.arange(longest) < size[:, None]
        y, rows = tags[place], np.arange(n)
        m, v = ([np.zeros_like(self.flat), np.zeros_like(self.moves)] for _ in range(2))
        for step in range(1, steps + 1):
            emit = self.flat[kinds].sum(1)[kind_of][place]
            # chains start from and end in O; steps past a chain's end are neutral
            alpha, beta = np.zeros((longest, n, 3)), np.zeros((longest, n, 3))
            alpha[0] = self.moves[O] + emit[:, 0]
            for t in range(1, longest):
                nxt = np.logaddexp.reduce(alpha[t - 1][:, :, None] + self.moves, axis=1) + emit[:, t]
                alpha[t] = np.where(live[:, t, None], nxt, alpha[t - 1])
            beta[longest - 1] = self.moves[:, O]
            for t in range(longest - 2, -1, -1):
                prev = np.logaddexp.reduce(self.moves + (emit[:, t + 1] + beta[t + 1])[:, None, :], axis=2)
                beta[t] = np.where(live[:, t + 1, None], prev, self.moves[:, O])
            z = np.logaddexp.reduce(alpha[0] + beta[0], axis=1)
            post = np.exp(np.swapaxes(alpha + beta, 0, 1) - z[:, None, None]) * live[:, :, None]
            rest = (np.eye(3)[y] * live[:, :, None] - post)[live]
            which = kind_of[place[live]]
            per_kind = np.stack([np.bincount(which, rest[:, k], len(kinds)) for k in range(3)], axis=1)
            g = np.stack([np.bincount(kinds.ravel(), np.repeat(per_kind[:, k], kinds.shape[1]), len(self.flat)) for k in range(3)], axis=1)
            gm = np.zeros((3, 3))
            np.add.at(gm, (np.zeros(n, int), y[:, 0]), 1)
            gm[O] -= post[:, 0].sum(0)
            np.add.at(gm, (y[rows, size - 1], np.zeros(n, int)), 1)
            gm[:, O] -= post[rows, size - 1].sum(0)
            for t in range(1, longest):
                on = live[:, t]
                np.add.at(gm, (y[on, t - 1], y[on, t]), 1)
                gm -= np.exp(alpha[t - 1][on][:, :, None] + self.moves + (emit[on, t] + beta[t][on])[:, None, :] - z[on, None, None]).sum(0)
            for k, (w, grad) in enumerate(((self.flat, g / n - 2e-4 * self.flat), (self.moves, gm / n))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad**2
                w += 0.2 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            self.moves[O, I] = -30.0

    def _tables(self) -> None:
        """Tables of score differences from outside, over groups of features, and the worst change of transitions."""
        self.groups: list[tuple[list[int], np.ndarray]] = []
        own = np.split(self.flat, np.cumsum(list(FEATURES.values()))[:-1])
        for k, table in enumerate(own):
            table = (table[:, 1:] - table[:, :1]).astype(np.float32)
            if self.groups and len(self.groups[-1][1]) * len(table) <= GROUP:
                held, sums = self.groups[-1]
                self.groups[-1] = ([*held, k], (sums[:, None] + table[None]).reshape(-1, 2))
            else:
                self.groups.append(([k], table))
        t, worst = self.moves, 0.0
        for p, now, nxt, after in itertools.product((O, B, I), (B, I), (O, B, I), (O, B, I)):
            if (p, now) != (O, I) and (nxt, after) != (O, I):
                new = B if nxt == I else nxt
                worst = max(worst, t[p, now] + t[now, nxt] + t[nxt, after] - t[p, O] - t[O, new] - t[new, after])
        self.worst = worst

    def emissions(self, values: list[np.ndarray]) -> np.ndarray:
        """Scores of B and I over O for every token."""
        out = np.zeros((len(values[0]), 2), np.float32)
        sizes = list(FEATURES.values())
        for members, table in self.groups:
            code = np.zeros(len(out), np.int64)
            for k in members:
                code = code * sizes[k] + values[k]
            out += table[code]
        return out

    def undecided(self, emit: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Tokens that are not surely outside; last: the last token of each row that has any."""
        gain = np.maximum(0, emit[1:, 1] - emit[1:, 0])
        gain = np.append(gain, np.float32(0))[: len(emit)]
        gain[last] = 0
        return emit.max(1) + gain + self.worst + 1e-3 >= 0 if len(emit) else np.zeros(0, bool)

    def decode(self, emit: np.ndarray) -> list[int]:
        """The best tags of one run of tokens between two outside tokens; emit: scores of B and I over O."""
        best, back = None, []
        for row in emit:
            score = np.array([0.0, row[0], row[1]])
            if best is None:
                best = self.moves[O] + score
            else:
                total = best[:, None] + self.moves
                back.append(total.argmax(0))
                best = total.max(0) + score
        tag = int((best + self.moves[:, O]).argmax())
        out = [tag]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


@lru_cache(maxsize=1)
def field() -> Field:
    return Field()


# ---- scanning -----------------------------------------------------------------------------


def base_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start and then kind; hex_runs are those long enough."""
    out = []
    if "=" in text or ":" in text:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [("hex", s, e) for s, e in hex_runs]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_rows(data: np.ndarray, offsets: np.ndarray, model: Field) -> list[list[tuple[str, int, int]]]:
    """All spans of each row, in code points."""
    base = int(offsets[0])
    b, at = data[base : int(offsets[-1])], offsets - base
    t = Tokens(b, at)
    hs, he = cut_runs(HEX[b], t.inner)
    keep = he - hs >= LEAST_HEX
    hs, he = hs[keep], he[keep]
    h0, h1 = np.searchsorted(hs, at[:-1], "left"), np.searchsorted(hs, at[1:], "left")
    emit = model.emissions(t.features())
    open_ = np.flatnonzero(model.undecided(emit, t.last[t.last > t.first] - 1))
    own = np.searchsorted(open_, t.first), np.searchsorted(open_, t.last)
    # a run of one token is inside a secret if that beats staying outside
    lone = emit[open_, 0] + model.moves[O, B] + model.moves[B, O] - 2 * model.moves[O, O] > 0
    out = []
    for r in range(len(at) - 1):
        lo, hi = int(at[r]), int(at[r + 1])
        mine = open_[own[0][r] : own[1][r]]
        raw = b[lo:hi]
        if not (h1[r] > h0[r] or len(mine) or t.sets[hi] > t.sets[lo] or raw.tobytes().find(b"AKIA") >= 0):
            out.append([])
            continue
        text = raw.tobytes().decode("utf-8", "replace")
        points = None if len(text) == len(raw) else tk.code_points(raw)
        place = (lambda p, lo=lo: int(p - lo)) if points is None else (lambda p, points=points, lo=lo: int(points[p - lo]))
        spans = base_spans(text, [(place(s), place(e)) for s, e in zip(hs[h0[r] : h1[r]], he[h0[r] : h1[r]], strict=True)])
        taken = [(s, e) for _, s, e in spans]
        found: list[list[int]] = []
        cuts = np.flatnonzero(np.diff(mine) > 1) + 1 if len(mine) else mine
        for lo_, hi_ in zip([0, *cuts], [*cuts, len(mine)], strict=True):
            if hi_ - lo_ == 1:
                if lone[own[0][r] + lo_]:
                    found.append([int(t.start[mine[lo_]]), int(t.end[mine[lo_]])])
                continue
            inside = False
            for k, tag in zip(mine[lo_:hi_], model.decode(emit[mine[lo_:hi_]]) if hi_ > lo_ else [], strict=True):
                if tag == I and inside:
                    found[-1][1] = int(t.end[k])
                elif tag != O:
                    found.append([int(t.start[k]), int(t.end[k])])
                inside = tag != O
        field_spans = [(place(s), place(e)) for s, e in found]
        spans += [("crf", s, e) for s, e in field_spans if not any(s < y and x < e for x, y in taken)]
        order = (*KINDS, "crf")
        out.append(sorted(spans, key=lambda x: (x[1], order.index(x[0]))))
    return out


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and all spans of every document. One pass over the scan, no shuffle."""

    model = field()

    def run(batches):
        for batch in tk.sized_batches(batches, BATCH):
            got = scan_rows(*tk.text_buffers(batch.column(1)), model)
            spans = pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in row] for row in got], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.record_batch([batch.column(0), spans], names=["doc_id", "spans"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans, the digest of the base spans, and all spans as one string."""
    base = "filter(spans, x -> x.kind <> 'crf')"
    text = "array_join(transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    return found.selectExpr(
        "doc_id", *(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long) n_{k}" for k in KINDS),
        f"sha2({text.format(base)}, 256) base_sha256", f"{text.format('spans')} spans")


def redact(documents: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; each stretch of text under spans becomes ``mark``, n_chars follows."""
    schema = documents.schema
    at = documents.columns.index("text")
    model = field()

    def run(batches):
        for batch in tk.sized_batches(batches, BATCH):
            rows = scan_rows(*tk.text_buffers(batch.column(at)), model)
            texts = batch.column(at).to_pylist()
            for r, spans in enumerate(rows):
                if spans:
                    out, pos = [], 0
                    for _, s, e in spans:
                        if s >= pos:
                            out += [texts[r][pos:s], mark]
                        pos = max(pos, e)
                    texts[r] = "".join([*out, texts[r][pos:]])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            if "n_chars" in schema.names:
                k = schema.names.index("n_chars")
                kept = batch.column(k).to_pylist()
                columns[k] = pa.array([len(t) if spans and t is not None else n for t, spans, n in zip(texts, rows, kept, strict=True)], batch.schema.field(k).type)
            yield pa.record_batch(columns, names=schema.names)

    return documents.mapInArrow(run, schema)
