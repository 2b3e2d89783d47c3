"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

A candidate is what base findings leave of a run of token characters, of six or more (the contract's
shortest value). The network reads it in overlapping windows, from its start and from each part after a
separator, with their surrounding context, and its score is the greatest of these. It reads character
classes: embedding, one convolution, maximum over positions, logistic output, all in numpy. It is trained on
labelled findings: all spans that the patterns found in the corpus and generated secrets, against a candidate
of every kind that the corpus has and generated harmless tokens. Then a pass over the whole corpus sums the
derivatives of the loss over all candidates that no pattern finds, and a damped Newton step fits the output
layer to them. The score is calibrated by Platt scaling and cut, for each shape of a window, at the highest threshold
that keeps the wanted recall on all held-out findings. What the patterns find always stays.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, materialise, small_batches
from .vectext import buffers, slices

# Fixed values of the contract: kinds in order, and the pattern of assignments.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
KEYWORDS = (b"passw", b"secret", b"token", b"api")

BEFORE, WITHIN, AFTER = 20, 32, 6
#: Windows of a long part begin every STRIDE characters.
STRIDE = 16
#: Characters of text whose convolutions are held at a time.
BLOCK = 4096
#: Characters of the shortest candidate.
SHORTEST = 6
WIDTH = BEFORE + WITHIN + AFTER
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"+/_.=-" + string.ascii_letters.encode() + string.digits.encode())] = True
_SEPARATOR = np.zeros(256, np.int8)
_SEPARATOR[list(b"+/_.=-")] = 1
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(string.ascii_letters.encode())] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(string.digits.encode())] = True
#: What a character is, as bits: letter, digit, separator, lower-case letter.
LETTER, DIGIT, MARK, LOWER_CASE = 1, 2, 4, 8
_BITS = (LETTER * _LETTER + DIGIT * _DIGIT + MARK * _SEPARATOR).astype(np.uint8)
_BITS[list(string.ascii_lowercase.encode())] |= LOWER_CASE


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True of at least least places; the first and the last place are False."""
    turns = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    a, b = turns[::2], turns[1::2]
    keep = b - a >= least
    return a[keep], b[keep]



def window(text: str, start: int, end: int) -> bytes:
    """The characters around and in a span, as bytes of fixed number: 0 pads, 1 is any character beyond ASCII."""
    part = lambda s: bytes(ord(x) if ord(x) < 128 else 1 for x in s)
    return part(text[max(0, start - BEFORE) : start]).rjust(BEFORE, b"\0") + part(text[start : min(end, start + WITHIN)]).ljust(WITHIN, b"\0") + part(text[end : end + AFTER]).ljust(AFTER, b"\0")


def starts_of(codes: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the ends of what they read, and the span of each; every character of a span is in a window.

    A span is read from its start and from the starts of its parts after a separator, every STRIDE characters.
    """
    # Short spans without separators are one window; only the others are read by the character.
    parted = (spans[:, 1] - spans[:, 0] > WITHIN) | (bits_in(codes, spans[:, 0], spans[:, 1]) & MARK > 0)
    whole, of = np.flatnonzero(~parted), np.flatnonzero(parted)
    n = spans[of, 1] - spans[of, 0]
    which = np.repeat(of, n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    place = at + spans[which, 0]
    parts = (at == 0) | (_SEPARATOR[codes[place]] < _SEPARATOR[codes[np.maximum(place - 1, 0)]])
    part = np.maximum.accumulate(np.where(parts, np.arange(len(place)), 0))
    off = np.arange(len(place)) - part
    # A later window of the same part is needed only where the one before it stops short of the span's end.
    take = (off % STRIDE == 0) & ((off == 0) | (place - STRIDE + WITHIN < spans[which, 1]))
    place, which = np.concatenate([spans[whole, 0], place[take]]), np.concatenate([whole, which[take]])
    order = np.argsort(place, kind="stable")
    place, which = place[order], which[order]
    return place, np.minimum(place + WITHIN, spans[which, 1]), which


def windows_of(codes: np.ndarray, edges: tuple[np.ndarray, np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same as window() for many spans at once, in codes of one byte; edges: where the texts of the spans begin and end."""
    lo, hi = (x[:, None] for x in edges)
    b, w, a = (np.arange(k) for k in (BEFORE, WITHIN, AFTER))
    at = np.concatenate([starts[:, None] - BEFORE + b, starts[:, None] + w, ends[:, None] + a], axis=1)
    live = (at >= lo) & (at < hi)
    live[:, BEFORE : BEFORE + WITHIN] &= at[:, BEFORE : BEFORE + WITHIN] < ends[:, None]
    return np.where(live, codes[np.clip(at, 0, max(len(codes) - 1, 0))], 0).astype(np.uint8)


def base_spans(text: str, hexes: list[tuple[int, int]], lowered: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, sorted."""
    spans = [(a, 2, b) for a, b in hexes]
    if any(k in lowered for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return sorted(spans)


class Scanned(NamedTuple):
    """Texts laid out in codes of one byte, 0 between them and 1 beyond ASCII: where each begins, what patterns find in each
    (start, kind, end, in code points of the text), all other candidates' spans in the codes, and the text of each."""

    texts: list[str]
    codes: np.ndarray
    first: np.ndarray
    base: list[list[tuple[int, int, int]]]
    spans: np.ndarray
    of: np.ndarray


def laid(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in codes with zeros between them, so that no window reads two texts; and where each begins."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    if len(lead) < len(data):
        data, offsets = data[lead], np.searchsorted(lead, offsets)
    first = offsets[:-1] + BEFORE * np.arange(1, len(offsets))
    codes = np.zeros(len(data) + BEFORE * len(first) + WIDTH, np.uint8)
    for at, a, b in zip(first.tolist(), offsets[:-1].tolist(), offsets[1:].tolist()):
        codes[at : at + b - a] = data[a:b]
    codes[codes > 127] = 1
    return codes, first


def scan(texts: pa.Array) -> Scanned:
    data, offsets = buffers(texts)
    codes, first = laid(data, offsets)
    a, b = runs(_HEX[codes], 24)
    hexes: dict[int, list[tuple[int, int]]] = {}
    for i, at, end in zip((np.searchsorted(first, a, "right") - 1).tolist(), a.tolist(), b.tolist()):
        hexes.setdefault(i, []).append((at - int(first[i]), end - int(first[i])))
    token, low, edges = _TOKEN[codes], data.tobytes().lower(), offsets.tolist()
    rows, base = texts.fill_null("").to_pylist(), []
    for i, text in enumerate(rows):
        base.append(base_spans(text, hexes.get(i, []), low[edges[i] : edges[i + 1]]))
        for at, _, end in base[-1]:
            token[first[i] + at : first[i] + end] = False
    a, b = runs(token, SHORTEST)
    return Scanned(rows, codes, first, base, np.stack([a, b], axis=1), np.searchsorted(first, a, "right") - 1)


def candidates(scanned: Scanned) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts laid out, the spans of all their candidates there, and the row of each."""
    _, codes, _, _, spans, of = scanned
    return codes, spans, of


def bits_in(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bits of all characters of each span; spans have a character or more and end before the codes do."""
    if not len(starts):
        return np.zeros(0, np.uint8)
    return np.bitwise_or.reduceat(_BITS[codes], np.stack([starts, ends], axis=1).ravel())[::2]


def shapes_in(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The same as shape_of() for spans in codes."""
    bits = bits_in(codes, starts, ends)
    return np.where(bits & MARK, 2, (bits & (LETTER | DIGIT) == LETTER | DIGIT).astype(np.int64))


def kinds_of(codes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """A number for what a candidate is like: its window's shape, upper case and length, its first and last character."""
    a, b = spans[:, 0], np.minimum(spans[:, 1], spans[:, 0] + WITHIN)
    upper = bits_in(codes, a, spans[:, 1]) & (LETTER | LOWER_CASE) == LETTER
    return (((shapes_in(codes, a, b) * 2 + upper) * (WITHIN + 1) + b - a) * 128 + codes[a]) * 128 + codes[spans[:, 1] - 1]


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_doc, _text) -> (_kind, _doc, _window): base findings (kind null), and of each kind of other candidates the one of the task's smallest document."""
    kept: dict[int, tuple] = {}
    names = ["_kind", "_doc", "_window"]
    for batch in (x for y in batches for x in slices(y, "_text")):
        docs, rows = batch.column("_doc").to_pylist(), scan(batch.column("_text"))
        base = [(d, window(t, a, b)) for d, own, t in zip(docs, rows.base, rows.texts) for a, _, b in own]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(base), pa.int64()), pa.array([d for d, _ in base], pa.int64()), pa.array([w for _, w in base], pa.binary())], names)
        codes, spans, of = candidates(rows)
        if not len(spans):
            continue
        rank = np.argsort(np.argsort([(1 << 63) - 1 if d is None else d for d in docs], kind="stable"), kind="stable")
        order = np.argsort(rank[of], kind="stable")
        kinds, first = np.unique(kinds_of(codes, spans)[order], return_index=True)
        at = spans[order[first]]
        read = windows_of(codes, (np.zeros(len(at), np.int64), np.full(len(at), len(codes))), at[:, 0], at[:, 1])
        for kind, i, own in zip(kinds.tolist(), of[order[first]].tolist(), read):
            new = (docs[i] is None, docs[i] or 0, own.tobytes())
            kept[kind] = min(kept.get(kind, new), new)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(kept), pa.int64()), pa.array([None if none else d for none, d, _ in kept.values()], pa.int64()), pa.array([w for _, _, w in kept.values()], pa.binary())], names
    )


def shape_of(windows: np.ndarray) -> np.ndarray:
    """By what is in a window's candidate: 0 one kind of characters, 1 letters and digits, 2 separators too."""
    body = windows[:, BEFORE : BEFORE + WITHIN]
    letter, digit, mark = (x[body].any(axis=1) for x in (_LETTER, _DIGIT, _SEPARATOR.astype(bool)))
    return np.where(mark, 2, letter & digit)


# ---- the network


def _classes() -> np.ndarray:
    """Character classes: pad, beyond ASCII, white, lower a-f, lower g-z, upper, digit, then single marks."""
    out = np.full(256, 7, np.int64)
    out[0], out[1] = 0, 1
    out[[9, 10, 11, 12, 13, 32]] = 2
    for c in string.ascii_lowercase:
        out[ord(c)] = 8 + ord(c) - 97
    for c in string.ascii_uppercase:
        out[ord(c)] = 34 + ord(c) - 65
    for c in string.digits:
        out[ord(c)] = 60 + ord(c) - 48
    for i, c in enumerate("=:\"'_-./+@&?%#"):
        out[ord(c)] = 70 + i
    return out


N_CLASSES = 84


class CharNet:
    """Embedding, convolution of width 5 with ReLU, maximum over positions, logistic output."""

    def __init__(self, seed: int, dim: int = 8, filters: int = 16):
        rng = np.random.default_rng(seed)
        self.classes = _classes()
        self.p = {
            "emb": rng.normal(0, 0.3, (N_CLASSES, dim)),
            "conv": rng.normal(0, (2 / (5 * dim)) ** 0.5, (5 * dim, filters)),
            "bias": np.zeros(filters),
            "out": rng.normal(0, 0.2, 2 * filters),
            "off": np.zeros(1),
        }
        self.platt = (1.0, 0.0)
        self.thresholds = np.full(3, 0.5)
        self.examples: tuple = ([], np.zeros(0), np.zeros(0, bool), np.zeros(0))

    def __getstate__(self) -> dict:
        """Tasks get the network without what it was trained on."""
        return {k: v for k, v in self.__dict__.items() if k != "examples"}

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["emb"][x]
        n, w, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, 5, axis=1).transpose(0, 1, 3, 2).reshape(n, w - 4, 5 * d)
        a = np.maximum(cols @ self.p["conv"] + self.p["bias"], 0)
        # The context's and the candidate's positions are pooled apart.
        split = BEFORE - 2
        top = [a[:, :split].argmax(axis=1), split + a[:, split:].argmax(axis=1)]
        pooled = np.concatenate([np.take_along_axis(a, t[:, None], 1)[:, 0] for t in top], axis=1)
        return cols, top, pooled, pooled @ self.p["out"] + self.p["off"][0]

    def logits(self, windows: list[bytes] | np.ndarray) -> np.ndarray:
        raw = windows if isinstance(windows, np.ndarray) else np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)
        x = self.classes[raw]
        return np.concatenate([self._score(x[i : i + 512]) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def _score(self, x: np.ndarray) -> np.ndarray:
        """The logits of _forward, in single precision and without what only training needs."""
        return (self._pooled(x) @ self.p["out"].astype(np.float32) + np.float32(self.p["off"][0])).astype(float)

    def _pooled(self, x: np.ndarray) -> np.ndarray:
        """What the output layer reads."""
        p = {k: v.astype(np.float32) for k, v in self.p.items()}
        e = p["emb"][x].reshape(len(x), -1)
        d = p["emb"].shape[1]
        cols = np.lib.stride_tricks.sliding_window_view(e, 5 * d, axis=1)[:, ::d].reshape(-1, 5 * d)
        a = (cols @ p["conv"]).reshape(len(x), WIDTH - 4, -1)
        split = BEFORE - 2
        return np.maximum(np.concatenate([a[:, :split].max(axis=1), a[:, split:].max(axis=1)], axis=1) + np.tile(p["bias"], 2), 0)

    def _tables(self) -> tuple[np.ndarray, ...]:
        """What classes and pairs of classes add to a convolution, by their place in it.

        One class in the first or last place, pads alone; pairs in the first two, the third and fourth and the last
        two places. Then for the last two characters of a candidate, before pads: the greater of the convolutions with
        one and with two characters, and their share of those with three and with four; and the same for the first two after it.
        """
        d = self.p["emb"].shape[1]
        share = [self.p["emb"].astype(np.float32) @ self.p["conv"].astype(np.float32)[j * d : (j + 1) * d] for j in range(5)]
        pad = [x[0] for x in share]
        pair = lambda i, j: (share[i][:, None] + share[j][None]).reshape(N_CLASSES**2, -1)
        alone = lambda i, second: np.tile(share[i], (N_CLASSES, 1)) if second else np.repeat(share[i], N_CLASSES, axis=0)
        left = [np.maximum(alone(0, True) + sum(pad[1:]), pair(0, 1) + sum(pad[2:])), pair(1, 2) + sum(pad[3:]), pair(2, 3) + pad[4]]
        right = [np.maximum(alone(4, False) + sum(pad[:4]), pair(3, 4) + sum(pad[:3])), pair(2, 3) + sum(pad[:2]), pair(1, 2) + pad[0]]
        return share[0], share[4], sum(pad), pair(0, 1), pair(2, 3), pair(3, 4), np.concatenate(left, axis=1), np.concatenate(right, axis=1)

    def pooled_in(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of windows, what the output layer reads of them), for windows of texts laid out, whose starts ascend.

        The convolutions inside texts are computed once for all windows over them, with maxima over 1, 2, 4, 8 and 16
        places, of which two cover any range; only those that reach beyond a window's candidate are its own. All are
        sums of rows of tables by pairs of characters.
        """
        head, last, pads, begin, middle, end, left, right = self._tables()
        bias, classes = np.tile(self.p["bias"].astype(np.float32), 2), self.classes[codes]
        f = len(pads)
        pairs = classes[:-1] * N_CLASSES + classes[1:]
        n = ends - starts
        # Very short candidates have no convolution of their own, very long ones no place of pads alone.
        other = np.flatnonzero((n < 3) | (n > WITHIN - 5))
        for i in range(0, len(other), 512):
            at = other[i : i + 512]
            raw = windows_of(codes, (np.zeros(len(at), np.int64), np.full(len(at), len(codes))), starts[at], ends[at])
            yield at, self._pooled(self.classes[raw])
        usual = np.flatnonzero((n >= 3) & (n <= WITHIN - 5))
        for at in np.split(usual, np.flatnonzero(np.diff(starts[usual] // BLOCK)) + 1):
            if not len(at):
                continue
            lo, hi = starts[at[0]] - BEFORE, starts[at[-1]] + WITHIN + AFTER
            one, two, m = classes[lo:hi], pairs[lo:hi], hi - lo - 4
            most = np.empty((5, m, f), np.float32)
            np.add(begin.take(two[:m], axis=0), middle.take(two[2 : m + 2], axis=0), out=most[0])
            most[0] += last.take(one[4:], axis=0)
            for k in range(1, 5):
                w = m - (1 << k) + 1
                np.maximum(most[k - 1, :w], most[k - 1, 1 << (k - 1) : w + (1 << (k - 1))], out=most[k, :w])
            flat, s, e = most.reshape(-1, f), starts[at] - lo, ends[at] - lo
            k = np.log2(e - s - 2).astype(np.int64)
            x = np.empty((len(at), 2 * f), np.float32)
            context, own = x[:, :f], x[:, f:]
            np.maximum(most[4].take(s - BEFORE, axis=0), most[4].take(s - BEFORE + 2, axis=0), out=context)
            np.maximum(flat.take(k * m + s - 2, axis=0), flat.take(k * m + e - 4 - (1 << k), axis=0), out=own)
            before, after = left.take(two[e - 2], axis=0), right.take(two[e], axis=0)
            for y in (
                most[0].take(e, axis=0),
                most[0].take(e + 1, axis=0),
                pads,
                before[:, :f],
                before[:, f : 2 * f] + head.take(one[e - 3], axis=0),
                before[:, 2 * f :] + begin.take(two[e - 4], axis=0),
                after[:, :f],
                after[:, f : 2 * f] + last.take(one[e + 2], axis=0),
                after[:, 2 * f :] + end.take(two[e + 2], axis=0),
            ):
                np.maximum(own, y, out=own)
            x += bias
            yield at, np.maximum(x, 0, out=x)

    def margins_in(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The same as margin() for windows of texts laid out."""
        z, (a, b) = np.zeros(len(starts)), self.platt
        for at, x in self.pooled_in(codes, starts, ends):
            z[at] = x @ self.p["out"].astype(np.float32) + np.float32(self.p["off"][0])
        return 1 / (1 + np.exp(-(a * z + b))) - self.thresholds[shapes_in(codes, starts, ends)]

    def derivatives(self, x: np.ndarray, y: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
        """The count, gradient and second derivatives of the loss in the output layer, summed over what it reads.

        Without labels they are candidates of the corpus: each is harmless by the chance that the network gives it,
        and counts so much, as a few may be secrets.
        """
        x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
        p = 1 / (1 + np.exp(-(x @ np.append(self.p["out"], self.p["off"]).astype(np.float32))))
        y, weight = (0, 1 - p) if y is None else (y, weight)
        g, h = x.T @ (weight * (p - y)), (x * np.asarray(weight * p * (1 - p), np.float32)[:, None]).T @ x
        return np.concatenate([[len(x)], g, h.ravel()]).astype(float)

    def refit(self, sums: np.ndarray, recall: float) -> None:
        """A damped Newton step of the output layer over the examples and all candidates of the corpus, by their derivatives' sums; then calibrated again."""
        windows, y, held, weight = self.examples
        raw = np.frombuffer(b"".join(w for w, h in zip(windows, held) if not h), np.uint8).reshape(-1, WIDTH)
        y, weight, k = y[~held], weight[~held], len(self.p["out"]) + 1
        # All candidates together weigh as much as the harmless examples, or as many if they are fewer.
        total = sums * min(1.0, (y == 0).sum() / max(sums[0], 1))
        for i in range(0, len(raw), 512):
            s = slice(i, i + 512)
            total = total + self.derivatives(self._pooled(self.classes[raw[s]]), y[s], weight[s])
        move = np.linalg.solve(total[k + 1 :].reshape(k, k) + 0.1 * len(y) * np.eye(k), total[1 : k + 1]).round(6)
        self.p["out"], self.p["off"] = self.p["out"] - move[:-1], self.p["off"] - move[-1:]
        self.calibrate([w for w, h in zip(windows, held) if h], self.examples[1][held], recall)

    def probability(self, windows: list[bytes] | np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-(a * self.logits(windows) + b)))

    def margin(self, windows: list[bytes] | np.ndarray) -> np.ndarray:
        """What the score has above the threshold of the window's shape; findings have 0 or more."""
        raw = windows if isinstance(windows, np.ndarray) else np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)
        return self.probability(raw) - self.thresholds[shape_of(raw)]

    def fit(self, windows: list[bytes], y: np.ndarray, weight: np.ndarray | None = None, *, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 3) -> None:
        x = self.classes[np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH)]
        rng, moments, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                cols, top, pooled, z = self._forward(x[part])
                n, f = len(part), self.p["conv"].shape[1]
                dz = (1 / (1 + np.exp(-z)) - y[part]) / n * (1 if weight is None else weight[part])
                dp = dz[:, None] * self.p["out"] * (pooled > 0)
                demb, dconv, dbias = np.zeros_like(self.p["emb"]), np.zeros_like(self.p["conv"]), np.zeros(f)
                for half, at in enumerate(top):
                    d = dp[:, half * f : (half + 1) * f]
                    dbias += d.sum(axis=0)
                    picked = cols[np.arange(n)[:, None], at]  # (n, f, 5 * dim)
                    dconv += np.einsum("nf,nfk->kf", d, picked)
                    back = (d[:, :, None] * self.p["conv"].T).reshape(n, f, 5, -1)
                    for j in range(5):
                        np.add.at(demb, x[part][np.arange(n)[:, None], at + j], back[:, :, j])
                step += 1
                for k, g in (("emb", demb), ("conv", dconv), ("bias", dbias), ("out", pooled.T @ dz), ("off", np.array([dz.sum()]))):
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, windows: list[bytes], y: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton steps; for each shape the highest threshold with the recall."""
        z, a, b = self.logits(windows), 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * z + b)))
            w = p * (1 - p) + 1e-9
            g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
            move = np.linalg.solve(hess, g)
            a, b = a - move[0], b - move[1]
        self.platt = (float(a), float(b))
        found = [w for w, t in zip(windows, y) if t == 1]
        if found:
            scores, shapes = self.probability(found), shape_of(np.frombuffer(b"".join(found), np.uint8).reshape(-1, WIDTH))
            for i in range(3):
                # A shape without held-out findings is judged by all of them.
                own = np.sort(scores[shapes == i] if (shapes == i).any() else scores)
                self.thresholds[i] = own[int((1 - recall) * len(own))]
        else:
            self.thresholds[:] = 1.0


def labelled_findings(seed: int, n: int) -> tuple[list[bytes], list[int]]:
    """Generated findings in context: secrets of common shapes, and harmless tokens that resemble them."""
    rng = np.random.default_rng(seed)
    pick = lambda letters, k: "".join(rng.choice(list(letters), k))
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(2, 9)))
    some = lambda x: x[int(rng.integers(len(x)))]
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    keys = ("client_key", "auth", "private_key", "credential", "access_key", "bearer", "pwd", "signing_key", "session", "key", "license_key", "webhook")
    out, y = [], []
    for i in range(n):
        if i % 2:
            body = some((lambda: pick(alnum, int(rng.integers(20, 48))), lambda: pick(hexes, int(rng.integers(20, 64))), lambda: pick(alnum + "+/", 38) + "==", lambda: some(("ghp_", "sk_live_", "xoxb-", "glpat-")) + pick(alnum, 30), lambda: pick(string.ascii_letters, int(rng.integers(20, 48))), lambda: ".".join(("eyJ" + pick(alnum, 17), "eyJ" + pick(alnum, 40), pick(alnum + "_-", 43)))))()
            lead = some((f"{word()}_{word()} = \"", f"{word()}: ", f"{word()} ", f"{some(keys)} = \"", f"{some(keys)}: ", f"{some(keys).upper()}=", f"Authorization: Bearer ", f"{some(keys)}='", f"{word()}/{word()}/{word()}/{word()}/", f"/{some(keys)}/"))
        else:
            body = some((
                lambda: f"www.{word()}{word()}.com/{word()}/{int(rng.integers(1, 9999))}",
                lambda: f"{word()}.{word()}{int(rng.integers(1, 99))}.example.com",
                lambda: f"{word()}-{word()}-{int(rng.integers(1000, 9999))}-{word()}",
                lambda: f"20{int(rng.integers(10, 30))}-{int(rng.integers(10, 13))}-{int(rng.integers(10, 29))}-{word()}{word()}",
                lambda: f"{word()}/{word()}/{word()}_{int(rng.integers(1, 99))}.txt",
                lambda: word() + word() + word() + str(int(rng.integers(1, 9))),
                lambda: pick(string.digits, 10) + "-" + word(),
                lambda: word() + word() + word(),
                lambda: word().capitalize() + word() + ".",
                lambda: (word() + word()).upper() + some((".", "")),
                lambda: "/".join(word() for _ in range(int(rng.integers(3, 9)))),
                lambda: pick(string.digits, int(rng.integers(6, 12))),
            ))()
            lead = some((word() + " ", "", f"see https://", f"{word()}: ", "\n", f"{word()}, (", f"{word()}/{word()}/{word()}/{word()}/"))
        left, right = " ".join(word() for _ in range(4)) + " " + lead, some(("\" ", " ", "\n", "'", ", ")) + word()
        out.append(window(left + body + right, len(left), len(left) + len(body)))
        y.append(i % 2)
    return out, y


def train(corpus: list[bytes], plain: list[bytes] = [], *, seed: int = 5, generated: int = 6000, recall: float = 0.99) -> CharNet:  # noqa: B006
    """corpus: windows of findings; plain: windows of candidates that are taken as harmless. If findings are more, both classes weigh the same."""
    made, y = labelled_findings(seed, generated)
    windows, y = made + corpus + plain, np.array(y + [1] * len(corpus) + [0] * len(plain), float)
    held = np.random.default_rng(seed).random(len(y)) < 0.25
    weight = np.where(y == 1, min(1.0, (y == 0).sum() / max((y == 1).sum(), 1)), 1.0)
    net = CharNet(seed)
    net.examples = (windows, y, held, weight)
    net.fit([w for w, h in zip(windows, held) if not h], y[~held], weight[~held])
    net.calibrate([w for w, h in zip(windows, held) if h], y[held], recall)
    return net


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def greatest_margins(net: CharNet, scanned: Scanned) -> np.ndarray:
    """The margin of each candidate of the texts, in order: the greatest of its windows."""
    codes, spans, _ = candidates(scanned)
    out = np.full(len(spans), -np.inf)
    if len(spans):
        starts, ends, which = starts_of(codes, spans)
        np.maximum.at(out, which, net.margins_in(codes, starts, ends))
    return out


def summed(net: CharNet) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_doc, _text) -> (_sums): a task's sums of derivatives over the windows of all its candidates that no pattern finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1)
        for batch in (x for y in batches for x in slices(y, "_text")):
            codes, spans, _ = candidates(scan(batch.column("_text")))
            if len(spans):
                for _, x in net.pooled_in(codes, *starts_of(codes, spans)[:2]):
                    total = total + net.derivatives(x)
        if len(total) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["_sums"])

    return run


def reported(net: CharNet) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_doc, _text) -> the result's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for y in batches for x in slices(y, "_text")):
            scanned = scan(batch.column("_text"))
            found = np.flatnonzero(greatest_margins(net, scanned) >= 0)
            of, more = scanned.of[found], [[] for _ in scanned.texts]
            for i, (a, b) in zip(of.tolist(), (scanned.spans[found] - scanned.first[of][:, None]).tolist()):
                more[i].append((a, 3, b))
            rows = []
            for base, own in zip(scanned.base, more):
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, len(own), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + own)))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("_doc"), *[pa.array(x, pa.int64()) for x in cols[:4]], *[pa.array(x, pa.string()) for x in cols[4:]]],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_cnn", "base_sha256", "spans"],
            )

    return run


def scan_secrets(docs: DataFrame, *, recall: float = 0.99, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_cnn, base_sha256, spans (kind:start:end).

    Spans are in code points, end exclusive. Null texts count as empty and have no spans. Repeated rows
    come back as often and get equal spans; other columns are not carried, so none clashes. A very long text
    is one row in a task's memory. All base findings train the network and set its thresholds (the driver holds a
    window of 58 bytes of each), with one candidate of each kind; the output layer is fitted to all candidates.
    Without any the generated ones alone are used.
    """
    small_batches(docs.sparkSession)
    c = Carried(docs, doc=id_col, text=text_col)
    texts = c.df.select(c.col("doc").cast("long").alias("_doc"), c.col("text").alias("_text"))
    table = materialise(texts.mapInArrow(found, "_kind long, _doc long, _window binary"), "findings")
    # In the order of their bytes, so that no task's or file's order counts.
    findings = sorted(table.filter(F.col("_kind").isNull()).select("_window").toArrow().column(0).to_pylist())
    first = F.min(F.struct(F.col("_doc").isNull().alias("none"), "_doc", "_window")).getField("_window")
    plain = sorted(table.filter(F.col("_kind").isNotNull()).groupBy("_kind").agg(first.alias("_window")).select("_window").toArrow().column(0).to_pylist())
    net = train(findings, plain, recall=recall)
    sums = [np.array(r["_sums"]) for r in texts.mapInArrow(summed(net), "_sums array<double>").collect()]
    if sums:
        net.refit(np.sum(sums, axis=0), recall)
    return texts.mapInArrow(
        reported(net), "doc_id long, n_assign long, n_access long, n_hex long, n_cnn long, base_sha256 string, spans string"
    ).withColumnRenamed("doc_id", id_col)
