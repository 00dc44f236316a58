"""Personal data: fixed rules, and a character BiLSTM with CRF transitions that adds spans.

All four kinds hold a digit or an "@". So the network reads windows of a fixed grid, each with its neighbours
half overlapping, first those that hold such a character, since a span without one is no span, then their
neighbours for as long as labels run on into them. Every place takes its label from the window where it
lies nearest to the middle; the labels of a text are then joined to spans, which are those of decoding
every window, and may cross any number of windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Work, table

KINDS = ("email", "ip", "card", "phone")
SIGN = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each "@", left over the local part and right over the domain; linear however long a run is."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed rules by kind, then start; a match that fails its test is dropped, not tried again."""
    if not SIGN.search(text):
        return []
    found = [("email", a, b) for a, b in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m.groups())]
    for m in CARD.finditer(text):
        digits = NO_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return found


# The network. Labels: 0 outside, 1 + 2k the first character of kind k, 2 + 2k a later one.

LABELS = 1 + 2 * len(KINDS)
WIDTH, STRIDE = 64, 32
HIDDEN, EMBED = 24, 12
SYMBOLS = "0123456789@.+-_%() \n\"':;,=/[]#$&*"
OTHER, LOWER, UPPER, PAD = len(SYMBOLS), len(SYMBOLS) + 1, len(SYMBOLS) + 2, len(SYMBOLS) + 3


def _classes() -> np.ndarray:
    out = np.full(0x300, OTHER, np.int8)
    for c in range(0x300):
        out[c] = UPPER if chr(c).isupper() else LOWER if chr(c).isalpha() else OTHER
    for k, c in enumerate(SYMBOLS):
        out[ord(c)] = k
    for d in range(10):  # digits are told apart only as digits
        out[ord("0") + d] = 0
    return out


CLASSES = _classes()


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return CLASSES[np.minimum(points, 0x2FF)]


def allowed() -> np.ndarray:
    """Score added to a transition: none where the CRF may go, much against where it may not."""
    out = np.zeros((LABELS + 1, LABELS))
    for before in range(LABELS + 1):  # the last row: before the window
        for after in range(2, LABELS, 2):
            if before not in (after, after - 1, LABELS):
                out[before, after] = -1e4
    return out


class Tagger:
    """BiLSTM over character classes, a linear layer, and CRF transitions; all in numpy."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": f(PAD + 1, EMBED), "o": f(2 * HIDDEN, LABELS), "c": np.zeros(LABELS, np.float32), "t": np.zeros((LABELS + 1, LABELS), np.float32)}
        for d in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN : 2 * HIDDEN] = 1
            self.p |= {f"w{d}": f(EMBED, 4 * HIDDEN), f"u{d}": f(HIDDEN, 4 * HIDDEN), f"b{d}": bias}
        self.mask = allowed().astype(np.float32)

    def lstm(self, x: np.ndarray, d: str, keep: bool = False):
        """States (steps, rows, hidden) over classes x (steps, rows), in the order given; with ``keep``, also gates, candidates, cells and their tanh."""
        into = (self.p["e"] @ self.p[f"w{d}"] + self.p[f"b{d}"])[x]
        h = c = np.zeros((x.shape[1], HIDDEN), into.dtype)
        states = np.empty((*x.shape, HIDDEN), into.dtype)
        past = (np.empty((*x.shape, 3 * HIDDEN), into.dtype), *(np.empty_like(states) for _ in range(3))) if keep else ()
        for t in range(len(x)):
            z = into[t] + h @ self.p[f"u{d}"]
            s = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            n = np.tanh(z[:, 3 * HIDDEN :])
            c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * n
            k = np.tanh(c)
            h = s[:, 2 * HIDDEN :] * k
            states[t] = h
            for kept, value in zip(past, (s, n, c, k), strict=False):
                kept[t] = value
        return (states, past) if keep else states

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.lstm(x, "f"), self.lstm(x[::-1], "b")[::-1]], 2)
        return h @ self.p["o"] + self.p["c"]

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best labels (steps, rows) by Viterbi."""
        e, trans = self.emissions(x), self.p["t"] + self.mask
        score, back = e[0] + trans[LABELS], []
        for t in range(1, len(x)):
            by = score[:, :, None] + trans[:LABELS]
            back.append(by.argmax(1))
            score = by.max(1) + e[t]
        out = np.empty(x.shape, np.int8)
        out[-1] = score.argmax(1)
        rows = np.arange(x.shape[1])
        for t in range(len(x) - 2, -1, -1):
            out[t] = back[t][rows, out[t + 1]]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood per character, by forward-backward (scaled at each step) and back-propagation."""
        p, steps, rows = self.p, *x.shape
        (hf, pf), (hb, pb) = self.lstm(x, "f", True), self.lstm(x[::-1], "b", True)
        h = np.concatenate([hf, hb[::-1]], 2)
        e, trans = (h @ p["o"] + p["c"]).astype(np.float64), (p["t"] + self.mask).astype(np.float64)
        own, go = np.exp(e - e.max(2, keepdims=True)), np.exp(trans[:LABELS])
        alpha, beta, scale = np.empty_like(own), np.ones_like(own), np.empty((steps, rows, 1))
        for t in range(steps):
            now = own[t] * (alpha[t - 1] @ go if t else np.exp(trans[LABELS]))
            scale[t] = np.maximum(now.sum(1, keepdims=True), 1e-300)
            alpha[t] = now / scale[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = (own[t + 1] * beta[t + 1] / scale[t + 1]) @ go.T
        de, gt = alpha * beta, np.zeros((LABELS + 1, LABELS))
        gt[LABELS] = de[0].sum(0)
        gt[:LABELS] = go * (alpha[:-1].reshape(-1, LABELS).T @ (own[1:] * beta[1:] / scale[1:]).reshape(-1, LABELS))
        de[np.arange(steps)[:, None], np.arange(rows), y] -= 1
        np.subtract.at(gt, (np.concatenate([np.full((1, rows), LABELS), y[:-1]]), y), 1)
        n = 1 / (steps * rows)
        de, g = (de * n).astype(h.dtype), {"t": (gt * n).astype(h.dtype)}
        g["o"], g["c"] = h.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, LABELS), de.sum((0, 1))
        dh, g["e"] = de @ p["o"].T, np.zeros_like(p["e"])
        for d, states, past, own, xs in (("f", hf, pf, dh[:, :, :HIDDEN], x), ("b", hb, pb, dh[::-1, :, HIDDEN:], x[::-1])):
            i, f, o = (past[0][:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
            m, cell, k = past[1:]
            was, old = (np.concatenate([np.zeros_like(v[:1]), v[:-1]]) for v in (states, cell))
            by_cell, by_state = (m * i * (1 - i), old * f * (1 - f), i * (1 - m * m)), k * o * (1 - o)
            through, dz = o * (1 - k * k), np.empty((*x.shape, 4 * HIDDEN), h.dtype)
            next_h = next_c = np.zeros((rows, HIDDEN), h.dtype)
            for t in range(steps - 1, -1, -1):
                a = own[t] + next_h
                c = next_c + a * through[t]
                for at, part in ((0, c * by_cell[0][t]), (1, c * by_cell[1][t]), (2, a * by_state[t]), (3, c * by_cell[2][t])):
                    dz[t, :, at * HIDDEN : (at + 1) * HIDDEN] = part
                next_h, next_c = dz[t] @ p[f"u{d}"].T, c * f[t]
            flat, which = dz.reshape(-1, 4 * HIDDEN), np.zeros((PAD + 1, steps * rows), h.dtype)
            which[xs.ravel(), np.arange(steps * rows)] = 1
            into = which @ flat
            g[f"u{d}"], g[f"w{d}"], g[f"b{d}"] = was.reshape(-1, HIDDEN).T @ flat, p["e"].T @ into, into.sum(0)
            g["e"] += into @ p[f"w{d}"].T
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.02, rows: int = 64, seed: int = 7) -> Tagger:
        """Adam over shuffled batches of windows x, y (windows, steps)."""
        r, m, v, t = np.random.default_rng(seed), {}, {}, 0
        total = epochs * -(-len(x) // rows)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for k in range(0, len(x), rows):
                t += 1
                pick = order[k : k + rows]
                step = rate * min(1, 2 * (1 - t / (total + 1)))
                for name, g in self.gradients(x[pick].T, y[pick].T).items():
                    m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                    v[name] = 0.99 * v.get(name, 0) + 0.01 * g * g
                    self.p[name] -= (step * m[name] / (1 - 0.9**t) / (np.sqrt(v[name] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def labels_of(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(size, np.int8)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def grid(text: str) -> np.ndarray:
    """Starts of the windows that hold a digit or an "@"; a window starts half a width before its own part."""
    at = np.array([m.start() for m in SIGN.finditer(text)], np.int64)
    first = at // STRIDE
    return np.unique(np.concatenate([first - 1, first])) * STRIDE


def windows(text: str, starts: np.ndarray) -> np.ndarray:
    """Classes (windows, WIDTH); places outside the text are padding."""
    padded = np.concatenate([np.full(WIDTH, PAD, np.int8), codes(text), np.full(2 * WIDTH, PAD, np.int8)])
    return padded[(starts + WIDTH)[:, None] + np.arange(WIDTH)]


# Labelled spans for the training: prose of invented words, with personal data and look-alikes at known places.


def labelled_texts(n: int, seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` short texts with their spans; the forms of personal data go beyond those that the rules match."""
    r = np.random.default_rng(seed)
    one = lambda *x: x[r.integers(len(x))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    letters = lambda k: "".join(chr(97 + c) for c in r.integers(0, 26, k))
    hexes = lambda k: "".join("0123456789abcdef"[c] for c in r.integers(0, 16, k))

    def accented(w: str) -> str:
        """Now and then with other letters than ASCII has."""
        return "".join(one(*"áéíóúüñçöä") if c.isalpha() and r.random() < 0.15 else c for c in w) if r.random() < 0.2 else w

    def word() -> str:
        w = accented(letters(r.integers(2, 10)))
        return w.capitalize() if r.random() < 0.12 else w.upper() if r.random() < 0.04 else w

    def email() -> str:
        name = one(letters(5), f"{letters(4)}.{digits(2)}", f"{letters(5)}_{letters(4)}", f"{letters(1)}.{letters(6)}", f"{letters(6)}{digits(3)}")
        host = f"{one(letters(6), 'mail' + digits(1), letters(4) + '-' + letters(3), letters(r.integers(4, 9)) + '-' + letters(r.integers(5, 15)))}.{one('com', 'org', 'net', 'example.com', 'co.uk', 'de')}"
        return accented(f"{name}@{host}")

    def card() -> str:
        body = one("4", "5", "37", "6011")
        body += digits(15 - len(body))
        d = next(body + str(k) for k in range(10) if luhn(body + str(k)))
        return one(d, d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return one(f"+{digits(one(1, 2))} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"+{digits(2)}{a}{b}{c}", f"({a}) {b}-{c}", f"+1-{a}-{b}-{c}")

    def other() -> str:
        return one(
            f"{digits(one(1, 2, 3))}.", f"{digits(1)}.{digits(1)}.", digits(one(1, 2, 3, 4, 5, 6)), f"AKIA{hexes(16).upper()}", f"password={hexes(18)}", f'token = "{hexes(40)}"',
            f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"({digits(4)})", f"@{letters(6)}", f"$ {digits(3)},{digits(3)}.{digits(2)}", f"{digits(2)}%", f"{digits(9)}x{digits(3)}", hexes(32),
        )

    make = {"email": email, "ip": lambda: ".".join(str(x) for x in r.integers(0, 256, 4)), "card": card, "phone": phone}
    out = []
    for _ in range(n):
        text, spans, junk = "", [], one("", "", "", "%%%", "***")
        for _ in range(r.integers(6, 20)):
            u = r.random()
            kind = KINDS[r.integers(4)] if u < 0.16 else ""
            piece = make[kind]() if kind else other() if u < 0.32 else word()
            text += one("", "", "", "(", '"', ": ") if r.random() < 0.15 and kind != "phone" else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece + (one("%%%", "***", "$$$", "&&&", "###") if junk else "") + (one(",", ".", ";") if r.random() < 0.12 and not kind else "") + one(" ", " ", " ", " ", "\n")
        out.append((text, spans))
    return out


@lru_cache(1)
def trained(texts: int = 1500, epochs: int = 5) -> Tagger:
    """The tagger after a fixed course of training; some seconds, once a process."""
    xs, ys = [], []
    for text, spans in labelled_texts(texts):
        starts, y = grid(text), labels_of(len(text), spans)
        if len(starts):
            padded = np.concatenate([np.zeros(WIDTH, np.int8), y, np.zeros(2 * WIDTH, np.int8)])
            xs.append(windows(text, starts))
            ys.append(padded[(starts + WIDTH)[:, None] + np.arange(WIDTH)])
    return Tagger().fit(np.concatenate(xs), np.concatenate(ys), epochs)


def tagged(model: Tagger, texts: list[str], rows: int = 512) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by the network: its windows are decoded in blocks, stitched and reconciled."""
    labels = [np.zeros(len(t), np.int8) for t in texts]
    new = {i: grid(t) for i, t in enumerate(texts) if t}
    done, reach = {i: np.zeros(len(texts[i]) // STRIDE + 3, bool) for i, own in new.items() if len(own)}, 1
    while new := {i: own for i, own in new.items() if len(own)}:
        decode(model, texts, new, labels, rows)
        for i, own in new.items():
            done[i][own // STRIDE + 1] = True
        new, reach = {i: beyond(labels[i], own, done[i], reach) for i, own in new.items()}, 2 * reach
    return [joined(t, y) for t, y in zip(texts, labels, strict=True)]


def beyond(labels: np.ndarray, starts: np.ndarray, done: np.ndarray, reach: int) -> np.ndarray:
    """Starts of windows, ``reach`` on each side at most, into which a run at the edge of the own parts at ``starts`` may go on."""
    first, last, end = starts + WIDTH // 4, starts + WIDTH // 4 + STRIDE - 1, len(labels) - 1
    left = starts[(first > 0) & (first <= end) & (labels[np.clip(first, 0, end)] > 0)]
    right = starts[(last < end) & (labels[np.minimum(last, end)] > 0)]
    steps = np.arange(1, reach + 1)
    # A neighbour that is decoded has its own edges, which were looked at or are in ``starts``.
    left, right = left[~done[left // STRIDE]], right[~done[right // STRIDE + 2]]
    at = np.unique(np.concatenate([(left[:, None] // STRIDE - steps).ravel(), (right[:, None] // STRIDE + steps).ravel()]))
    at = at[(at >= -1) & (at * STRIDE + WIDTH // 4 < len(labels))]
    return at[~done[at + 1]] * STRIDE


def decode(model: Tagger, texts: list[str], starts: dict[int, np.ndarray], labels: list[np.ndarray], rows: int) -> None:
    """Puts the labels of the own parts of the windows at ``starts`` (by text) into ``labels``."""
    queue = [(i, s) for i, own in starts.items() for s in np.array_split(own, -(-len(own) // rows)) if len(s)]
    k = 0
    while k < len(queue):
        block, size = [], 0
        while k < len(queue) and (not block or size + len(queue[k][1]) <= rows):
            block.append(queue[k])
            size += len(queue[k][1])
            k += 1
        best = model.decode(np.concatenate([windows(texts[i], s) for i, s in block]).T).T
        for i, s in block:
            own, best = best[: len(s)], best[len(s) :]
            # The middle half of a window is nearer to its centre than to any other window's.
            at = (s[:, None] + np.arange(WIDTH // 4, WIDTH // 4 + STRIDE)).ravel()
            value = own[:, WIDTH // 4 : WIDTH // 4 + STRIDE].ravel()
            inside = (at >= 0) & (at < len(texts[i]))
            labels[i][at[inside]] = value[inside]


def joined(text: str, labels: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind as spans, without white space at the ends; a run needs a digit or an "@"."""
    kind = (labels.astype(np.int16) + 1) // 2
    edge = np.flatnonzero((np.diff(kind, prepend=0) != 0) | ((labels % 2 == 1) & (labels > 0)))
    out = []
    for a, b in zip(edge, np.append(edge, len(labels))[1:], strict=True):
        if kind[a]:
            span = text[a:b]
            a, b = a + len(span) - len(span.lstrip()), b - (len(span) - len(span.rstrip()))
            if a < b and SIGN.search(text, a, b):
                out.append((KINDS[kind[a] - 1], int(a), int(b)))
    return out


def plausible(kind: str, value: str) -> bool:
    """What an added span must hold to count as its kind; spans that the rules have looked at and dropped stay dropped."""
    digits = NO_DIGIT.sub("", value)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@.]{2,}", value))
    if kind == "ip":
        return bool(re.fullmatch(r"(?:[0-9]{1,3}[.\s]){3}[0-9]{1,3}", value)) and all(int(x) < 256 for x in re.findall(r"[0-9]+", value))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"[0-9+(][0-9 ().\-]+[0-9]", value)) and bool(re.search(r"[ ().-]", value))


def all_spans(model: Tagger, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, in the order of kinds, then start.

    An added span is plausible for its kind and covers something that no base span does. Where it overlaps base
    spans, what it covers beyond them must hold a letter or digit, lest it only adds a full stop or a bracket.
    """
    base = [base_spans(t) for t in texts]
    out = []
    for text, fixed, more in zip(texts, base, tagged(model, texts), strict=True):
        new = [s for s in more if plausible(s[0], text[s[1] : s[2]])]
        if new and fixed:
            covered = np.zeros(len(text), bool)
            for _, a, b in fixed:
                covered[a:b] = True
            new = [s for s in new if adds(text, covered, s)]
        out.append((fixed, sorted(fixed + new, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def adds(text: str, covered: np.ndarray, span: tuple[str, int, int]) -> bool:
    """Does a span go beyond the covered places by a letter or digit, if it touches them?"""
    _, a, b = span
    own = covered[a:b]
    return not own.any() or any(text[k].isalnum() for k in (a + np.flatnonzero(~own)).tolist())


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span, or overlapping spans together, replaced by the name of the first one's kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out.append(f"{text[end:a]}<{kind.upper()}>")
        end = max(end, b)
    return "".join(out) + text[end:]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, and all spans, of every row (doc_id, text), repeated ones too; a null text is empty.

    Texts without a digit or an "@" have no spans and never leave the JVM. Runs after its return.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sign = F.col("text").rlike("[0-9@]")
    zero = F.lit(0).cast("long")
    clean = rows.filter(~sign).select(
        "doc_id", *[zero.alias(f"n_{k}") for k in KINDS], F.lit(sha256(b"").hexdigest()).alias("base_sha256"), F.lit("").alias("spans")
    )
    shared = docs.sparkSession.sparkContext.broadcast(trained())  # 60 kB

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = all_spans(shared.value, b.text.tolist())
            counts = {f"n_{k}": [sum(s[0] == k for s in base) for base, _ in got] for k in KINDS}
            yield pd.DataFrame({"doc_id": b.doc_id, **counts, "base_sha256": [sha256(digest(x).encode()).hexdigest() for x, _ in got], "spans": [digest(x) for _, x in got]})

    return rows.filter(sign).mapInPandas(run, FOUND).unionAll(clean)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs``, in its columns, with all spans of ``text`` replaced; null texts stay null. Runs after its return."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        return pd.Series([redact(t, spans) for t, (_, spans) in zip(texts, all_spans(shared.value, texts), strict=True)])

    sign = F.col("text").rlike("[0-9@]")
    return docs.filter(sign).withColumn("text", clean("text")).unionByName(docs.filter(F.coalesce(~sign, F.lit(True))))


def op5_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return Work(spark).save(find(table(spark, sf_dir, "documents")), "found")
