"""Vectorised text tokenising: word and shingle hashes of many texts at once, in numpy over Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

from .common import per_process

SLICE_BYTES = 2_000_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_AS_IS = np.arange(256, dtype=np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 5
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(base: int, n: int) -> np.ndarray:
    def table(size: int) -> np.ndarray:
        have = np.full(size, base, np.uint64)
        have[0] = 1
        return np.cumprod(have, dtype=np.uint64)

    # A text longer than a slice gets a table of its own.
    return per_process(("powers", base), lambda: table(SLICE_BYTES + 2))[:n] if n <= SLICE_BYTES + 2 else table(n)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts have about ``most`` bytes; a longer text stands alone."""
    sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), float))
    begin, total = 0, 0.0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0.0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and len + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each text the index of its first word (len + 1)."""
    n = len(data)
    word = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens = word.copy()
    opens[1:] &= ~word[:-1] | edge[1:n]
    closes = word.copy()
    closes[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span's bytes, with A-Z lower-cased if asked: differences of one polynomial prefix sum."""
    n = len(data)
    terms = (_LOWER if lower else _AS_IS)[data].astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power(_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    h = (total[ends] - total[starts]) * _power(_BASE_INVERSE, n + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and for each text the index of its first word (len + 1)."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    return hash_spans(data, starts, ends, lower), first


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, none an empty set."""
    h, first = word_hashes(texts)
    whole = np.zeros(len(h), np.uint64)
    if len(h) >= k:
        weights = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        runs = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            runs += h[j : len(h) - k + 1 + j] * weights[j]
        whole[: len(runs)] = mix(runs)
    sets = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            short = mix(h[a:b] + np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
            sets.append(mix(np.array([short ^ np.uint64(b - a)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
