"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed from the text alone, vectorised over Arrow buffers. Training takes a bounded
sample of labelled rows to the driver; the trees are complete, flattened into arrays of features,
thresholds and leaf values, and scored by vectorised numpy traversal where the documents lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, bounded, lowest_hashes, materialise, small_batches
from .vectext import buffers, hash_spans, mix, slices, word_spans

#: Classes of bytes whose shares are statistics.
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"!", b"|", b"#*$%&<>", b".,;:?", b"\"'()[]{}-_/\\@+=~^`")
N_STATISTICS = len(KINDS) + 18


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _repeats(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of distinct values and the count of the most frequent."""
    distinct, most = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
        if b > a:
            s = np.sort(h[a:b])
            at = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]])
            distinct[i], most[i] = len(at) - 1, np.diff(at).max()
    return distinct, most


def statistics(texts: pa.Array) -> np.ndarray:
    """(texts, N_STATISTICS) statistics; null counts as empty."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    n_bytes, n_words = np.diff(offsets).astype(float), np.diff(first).astype(float)
    kind = np.full(256, len(KINDS), np.uint8)
    for i, k in enumerate(KINDS):
        kind[list(k)] = i
    of = kind[data]
    upto = lambda x: np.concatenate([[0], np.cumsum(x)])
    per_text = lambda x: np.diff(upto(x)[first])  # noqa: E731  over words
    totals = [upto(of == i) for i in range(len(KINDS))]
    out = [_share(np.diff(t[offsets]), n_bytes) for t in totals]
    length = (ends - starts).astype(float)
    h = hash_spans(data, starts, ends, lower=False)
    mean = _share(per_text(length), n_words)
    upper, lower = (totals[i][ends] - totals[i][starts] for i in (0, 1))
    plain = sum(totals[i][ends] - totals[i][starts] for i in (0, 1, 2))
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    last = of[ends - 1] if len(ends) else of[:0]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][first[:-1] < len(h)]] = False
    triple = np.zeros(len(h), np.uint64)
    if len(h) > 2:
        triple[:-2] = mix(h[:-2] + mix(h[1:-1] + mix(h[2:])))
    inner = np.maximum(n_words - 2, 0)
    distinct, most = _repeats(h, first)
    thrice = np.array([len(np.unique(triple[a : b - 2])) if b - a > 2 else 0 for a, b in zip(first[:-1], first[1:])], float)
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)] if len(data) else line_starts[:0]
    line_ends = np.append(line_starts[1:], len(data))[: len(line_starts)]
    line_first = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_first).astype(float)
    unlike, _ = _repeats(hash_spans(data, line_starts, line_ends, lower=False), line_first)
    longest = np.zeros(len(n_words))
    some = np.flatnonzero(n_words > 0)
    if len(some):
        longest[some] = np.maximum.reduceat(length, first[:-1][some])
    out += [
        np.log1p(n_bytes),
        np.log1p(n_words),
        mean,
        np.sqrt(np.maximum(_share(per_text(length * length), n_words) - mean * mean, 0)),
        np.log1p(longest),
        _share(per_text((last >= 5) & (last <= 7)), n_words),
        _share(per_text((upper > 1) & (lower == 0)), n_words),
        _share(per_text(same), n_words),
        _share(distinct, n_words),
        _share(most, n_words),
        np.where(inner > 0, thrice / np.maximum(inner, 1), 1.0),
        1 - _share(unlike, lines) * (lines > 0),
        np.log1p(lines),
        _share(n_words, lines),
        _share(per_text(length <= 3), n_words),
        _share(per_text(upper > 0), n_words),
        _share(per_text((plain == 0) & (wide[ends] == wide[starts])), n_words),
        _share(np.diff(wide[offsets]), n_bytes),
    ]
    return np.stack([np.asarray(x, float) for x in out], axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 2.0, least: float = 2.0) -> dict[str, np.ndarray]:
    """Boosted complete trees for log loss: node arrays in level order, and leaf values."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)  # bin b: cuts[b-1] < x <= cuts[b]
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, 1 << depth))
    base = np.log((y.sum() + 1) / (n - y.sum() + 1))
    score = np.full(n, base)
    column = np.arange(m) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 1 << level
            index = ((node * m * bins)[:, None] + column + binned).ravel()
            sums = [np.bincount(index, np.repeat(v, m), width * m * bins).reshape(width, m, bins).cumsum(axis=2) for v in (g, h)]
            gl, hl = (s[:, :, :-1] for s in sums)
            gt, ht = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = -1
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            worth = gain.reshape(width, -1).max(axis=1) > 1e-9
            f, b = best // (bins - 1), best % (bins - 1)
            at = width - 1 + np.arange(width)
            feature[t, at] = f
            threshold[t, at] = [cuts[f[i]][b[i]] if worth[i] else np.inf for i in range(width)]
            node = 2 * node + (worth[node] & (binned[np.arange(n), f[node]] > b[node]))
        gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
        leaf[t] = -rate * gs / (hs + l2)
        score += leaf[t][node]
    return {"feature": feature, "threshold": threshold, "leaf": leaf, "base": np.array(base)}


def traverse(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probabilities: all trees are walked at once, a level at a time."""
    feature, threshold, leaf = model["feature"], model["threshold"], model["leaf"]
    trees, inner = feature.shape
    at, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
    while trees and at.size and at[0, 0] < inner:
        at = 2 * at + 1 + (x[row, feature[tree, at]] > threshold[tree, at])
    total = model["base"] + (leaf[tree, at - inner].sum(axis=1) if trees else 0)
    return 1 / (1 + np.exp(-total))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for y in batches for x in slices(y, "_text")):
        yield pa.RecordBatch.from_arrays([batch.column("_doc"), pa.array(list(statistics(batch.column("_text"))), pa.list_(pa.float64()))], ["_doc", "_stats"])


def _scored(model: dict[str, np.ndarray] | None, text: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for y in batches for x in slices(y, text)):
            score = np.ones(batch.num_rows) if model is None else traverse(model, statistics(batch.column(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*names, "_score"])

    return run


def fold(doc: str, folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.7,
    folds: int = 4,
    held_fold: int = 2,
    train_rows: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """Returns the rows of docs with held_out, score and predicted.

    Learns from at most train_rows labelled documents (a fixed, hash-ordered sample), none of fold
    held_fold of crc32(doc_id as text); a null doc_id counts as ''. Null labels do not count; an id labelled
    both ways is 1 if most of its labels are. Null and empty texts have a score like any other. Without labels every score is 1:
    nothing is known against any document. Columns named like the new ones are replaced. Repeated rows get
    equal scores; a score does not depend on other rows, so there are no ties. A very long text is one row in a
    task's memory, with some 60 bytes for each of its words.
    """
    small_batches(docs.sparkSession)
    c, known = Carried(docs, doc=id_col, text=text_col), Carried(labels, doc=label_id_col, label=label_col)
    told = (
        known.df.filter(known.col("label").isNotNull() & known.col("doc").isNotNull())
        .groupBy(known.col("doc").alias("_id"))
        .agg((F.avg(known.col("label").cast("double")) >= 0.5).cast("double").alias("_y"))
    )
    # Only documents that the sample can hold are measured for it; their ids are few, so no text is shuffled.
    known_rows = told.filter(fold("_id", folds) != held_fold).count()
    wanted = materialise(told.filter((fold("_id", folds) != held_fold) & lowest_hashes(F.col("_id"), known_rows, train_rows)), "labelled")
    sample = (
        c.df.select(c.col("doc").alias("_doc"), c.col("text").alias("_text"))
        .join(bounded(wanted.select(F.col("_id").alias("_wanted")), 2 * train_rows + 10_000), F.col("_doc") == F.col("_wanted"), "left_semi")
        .mapInArrow(_measured, f"_doc {dict(c.df.dtypes)[c.at['doc']]}, _stats array<double>")
        .join(wanted, F.col("_doc") == F.col("_id"))
        .orderBy(F.xxhash64("_doc"), "_doc", "_stats")
        .limit(train_rows)
        .select("_y", "_stats")
        .toPandas()
    )
    model = fit_trees(np.stack(sample["_stats"].to_numpy()), sample["_y"].to_numpy(float)) if len(sample) else None
    schema = T.StructType([*c.df.schema.fields, T.StructField("_score", T.DoubleType())])
    scored = c.df.mapInArrow(_scored(model, c.at["text"], c.df.columns), schema)
    return c.restore(
        scored,
        {
            "held_out": fold(c.at["doc"], folds) == held_fold,
            "score": F.col("_score"),
            "predicted": (F.col("_score") >= threshold).cast("int"),
        },
    )
