"""Hidden Markov language model over words, with a unigram base.

Every word that the training rows hold own_count times or more is a class of its own, so the emissions that
Baum-Welch learns grow with the corpus; rarer words fall into classes by their shape. A state emits a class
and the class emits the word by its training count, so that every word has a probability and the sequence
likelihood splits into the scaled forward recursion over classes and a sum over words.

Counts, Baum-Welch and scores cover the whole corpus, and a document is one sequence, however long: alpha
is kept at the starts of segments and formed again within them while beta comes back. E-step counts are
summed per task, then across partitions by an aggregate over classes and words. Only a head of the
vocabulary of fixed size is sent to the tasks, with its emissions; the emissions of all other words are
joined to the blocks of documents that hold them, and their counts to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, materialise, small_batches
from .mixing import size_class
from .vectext import buffers, hash_spans, mix, slices, word_spans

#: The token that ends each text; words hash to other values but for chance.
END = np.uint64(0x454E44)
SHAPES = 96
#: Tokens of sequences that go step by step together, and steps of which the states are held.
GROUP_TOKENS, SEGMENT = 200_000, 50_000
#: Classes of one array of expected counts.
CHUNK = 4096


def shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A class from 0 to SHAPES - 1 by length, last byte and presence of digits or bytes beyond ASCII."""
    n = ends - starts
    length = np.digitize(n, (3, 5, 7, 9, 11, 14, 18))  # 8 classes
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    tail = np.where((last >= 97) & (last <= 122) | (last >= 65) & (last <= 90), 0, np.where(last >= 128, 1, np.where((last >= 48) & (last <= 57), 2, 3)))
    wide = np.concatenate([[0], np.cumsum(data >= 128)])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    inner = np.where(digit[ends] > digit[starts], 2, np.where(wide[ends] > wide[starts], 1, 0))
    return length * 12 + tail * 3 + inner


def token_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token, END after each text, and for each text the index of its first token."""
    data, offsets = buffers(texts)
    starts, ends, first = word_spans(data, offsets)
    at = first[1:] + np.arange(len(texts))
    h, shape = np.empty(len(starts) + len(texts), np.uint64), np.zeros(len(starts) + len(texts), np.int64)
    body = np.ones(len(h), bool)
    body[at] = False
    h[body], h[at] = hash_spans(data, starts, ends), END
    shape[body] = shapes(data, starts, ends)
    return h, shape, np.concatenate([[0], at + 1])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_text) -> (word, shape, n), summed over runs of batches."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        h, s, n = (np.concatenate(x) for x in zip(*kept))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, s[first], np.bincount(back, n, len(u)).astype(np.int64)

    for batch in (x for y in batches for x in slices(y, "_text")):
        h, s, _ = token_table(batch.column("_text"))
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        kept.append((u, s[first], n))
        if sum(len(x[0]) for x in kept) > 2_000_000:
            kept[:] = [summed()]
            if len(kept[0][0]) > 1_000_000:
                u, s, n = kept.pop()
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])
    if kept:
        u, s, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(n)], ["word", "shape", "n"])


def encode(head: np.ndarray, logs: np.ndarray, own: np.ndarray, classes: int, block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """head: sorted hashes; logs: log10(count + 1) of each; own: its class, or -1 for the shape's class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, tokens = TaskContext.get().partitionId(), 0, 0
        for batch in (x for y in batches for x in slices(y, "_text")):
            h, shape, first = token_table(batch.column("_text"))
            at = np.minimum(np.searchsorted(head, h), len(head) - 1)
            hit = head[at] == h
            cls = np.where(hit & (own[at] >= 0), own[at], classes - SHAPES + shape).astype("<i4")
            value, alone = np.where(hit, logs[at], 0.0), hit & (own[at] >= 0)
            totals = [np.concatenate([[0], np.cumsum(x)]) for x in (value, hit, np.where(alone, value, 0.0))]
            rows = list(zip(first[:-1], first[1:]))
            rare = h.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_doc"),
                    pa.array(np.full(len(rows), (part << 30) + tokens // block_tokens)),
                    pa.array((np.int64(part) << 40) + row + np.arange(len(rows))),
                    pa.array([cls[a:b].tobytes() for a, b in rows], pa.binary()),
                    pa.array([np.flatnonzero(~hit[a:b]).astype("<i4").tobytes() for a, b in rows], pa.binary()),
                    pa.array([rare[a:b][~hit[a:b]] for a, b in rows], pa.list_(pa.int64())),
                    pa.array(np.diff(totals[0][first])),
                    pa.array(np.diff(totals[1][first]).astype(np.int64)),
                    pa.array(np.diff(totals[2][first])),
                ],
                ["_doc", "_blk", "_row", "_cls", "_at", "_rare", "_head", "_known", "_alone"],
            )
            row += len(rows)
            tokens += len(h)

    return run


def starting(word: np.ndarray, n: np.ndarray, states: int) -> np.ndarray:
    """The first emissions of words or classes by state, not yet divided by their sums: (len(word), states)."""
    z = np.arange(1, states + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    u = mix(word.astype(np.uint64)[:, None] ^ z) >> np.uint64(11)
    return n[:, None] * (0.5 + u.astype(float) / 2.0**53)


def sequences(table: pa.RecordBatch | pa.Table, classes: int, words: np.ndarray) -> list[np.ndarray]:
    """The classes of each row's tokens; words (sorted) have the classes from ``classes`` on."""
    out = []
    for i in range(table.num_rows):
        s = np.frombuffer(table.column("_cls")[i].as_buffer(), "<i4")
        if len(words):
            rare, at = np.asarray(table.column("_rare")[i].values, np.int64), np.frombuffer(table.column("_at")[i].as_buffer(), "<i4")
            to = np.minimum(np.searchsorted(words, rare), len(words) - 1)
            hit = words[to] == rare
            s = s.copy()
            s[at[hit]] = classes + to[hit]
        out.append(s)
    return out


class Steps:
    """Some sequences (sorted by falling length, none empty), step by step: the classes at step t are x[o[t]:o[t + 1]]."""

    def __init__(self, seqs: list[np.ndarray], first: int = 0, last: int | None = None):
        lengths = np.array([len(s) for s in seqs])
        last = int(lengths[0]) if last is None else min(last, int(lengths[0]))
        self.alive = np.searchsorted(-lengths, -np.arange(first, last), side="left")  # sequences longer than t
        self.o = np.concatenate([[0], np.cumsum(self.alive)])
        n = int(self.alive[0])
        sizes = np.minimum(lengths[:n], last) - first
        step = np.arange(self.o[-1]) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.x = np.empty(self.o[-1], np.int64)
        self.x[self.o[step] + np.repeat(np.arange(n), sizes)] = np.concatenate([s[first:last] for s in seqs[:n]])

    def forward(self, model: dict, now: np.ndarray, opens: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the state before: emissions, scaled alphas and scales of all steps. opens: the first step begins the sequences."""
        e = model["b"][self.x]
        alpha, sums, a, ones = np.empty_like(e), np.empty(len(e)), model["a"], np.ones(len(model["a"]))
        for t, n in enumerate(self.alive.tolist()):
            here = slice(self.o[t], self.o[t + 1])
            to = alpha[here]
            if t or not opens:
                np.matmul(now[:n], a, out=to)
                to *= e[here]
            else:
                np.multiply(now[:n], e[here], out=to)
            total = np.matmul(to, ones, out=sums[here])
            to /= total[:, None]
            now = to
        return e, alpha, sums

    def backward(self, model: dict, e: np.ndarray, alpha: np.ndarray, sums: np.ndarray, before: np.ndarray, beta: np.ndarray, opens: bool, counts: dict) -> None:
        """Adds the expected counts of these steps; beta is that behind them and becomes that before them."""
        e /= sums[:, None]
        betas, back = np.empty_like(e), e
        up = np.ascontiguousarray(model["a"].T)
        for t in range(len(self.alive) - 1, -1, -1):
            here, n = slice(self.o[t], self.o[t + 1]), self.alive[t]
            betas[here] = beta[:n]
            back[here] *= beta[:n]
            if t or not opens:
                np.matmul(back[here], up, out=beta[:n])
        at = np.repeat(self.o[:-1][:-1] - self.o[1:-1], self.alive[1:]) + np.arange(self.o[1], self.o[-1])
        counts["a"] += model["a"] * (alpha[at].T @ back[self.o[1] :])
        if not opens:
            counts["a"] += model["a"] * (before[: self.o[1]].T @ back[: self.o[1]])
        gamma = alpha * betas
        if opens:
            counts["start"] += gamma[: self.o[1]].sum(axis=0)
        for z in range(gamma.shape[1]):
            counts["b"][:, z] += np.bincount(self.x, gamma[:, z], len(counts["b"]))


def forward_backward(model: dict, seqs: list[np.ndarray], counts: dict, segment: int) -> None:
    """Adds the expected counts of whole sequences (sorted by falling length, none empty) to counts, and their log likelihood.

    Alpha is kept where a segment begins; from the last segment back, it is formed again within the segment while beta is carried on.
    """
    top = len(seqs[0])
    now, kept, last = np.tile(model["start"], (len(seqs), 1)), [], None
    for first in range(0, top, segment):
        steps = Steps(seqs, first, first + segment)
        kept.append(now)
        last = (steps, *steps.forward(model, now, first == 0))
        counts["ll"] += np.log(last[3]).sum()
        now = last[2][steps.o[-2] :]
    beta = np.ones((len(seqs), len(model["a"])))
    for i in range(len(kept) - 1, -1, -1):
        if last is None:
            steps = Steps(seqs, i * segment, (i + 1) * segment)
            last = (steps, *steps.forward(model, kept[i], i == 0))
        last[0].backward(model, *last[1:], kept[i], beta, i == 0, counts)
        last = None


def spans(lengths: np.ndarray, most: int, rows: int) -> Iterator[slice]:
    """Runs of lengths in falling order that hold about ``most`` in all and at most ``rows``."""
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and (total + n > most or i - begin == rows):
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def expected(model: dict, seqs: list[np.ndarray], words: np.ndarray, segment: int) -> pa.RecordBatch:
    """The E-step over some sequences: arrays v, of transitions, starts and likelihood (at -1) or of CHUNK classes by state, and rows (word, c0, c1, ...)."""
    k, classes = len(model["a"]), len(model["b"]) - len(words)
    counts = {"a": np.zeros((k, k)), "b": np.zeros(model["b"].shape), "start": np.zeros(k), "ll": 0.0}
    seqs = sorted(seqs, key=lambda s: -len(s))
    for part in spans(np.array([len(s) for s in seqs]), GROUP_TOKENS, 4096):
        forward_backward(model, seqs[part], counts, segment)
    whole = np.concatenate([counts["a"], counts["start"][None], np.full((1, k), counts["ll"] / k)])
    rows = [(-1, whole.astype("<f8").tobytes())]  # only the sums of classes go in single precision
    for i in range(0, classes, CHUNK):
        part = counts["b"][i : min(i + CHUNK, classes)]
        if part.any():
            rows.append((i // CHUNK, part.astype("<f4").tobytes()))
    used = np.flatnonzero(counts["b"][classes:].any(axis=1))
    at, v = (list(x) for x in zip(*rows))
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(at + [None] * len(used), pa.int64()),
            pa.array(v + [None] * len(used), pa.binary()),
            pa.array([None] * len(at) + words[used].tolist(), pa.int64()),
            pa.array(np.full(len(at) + len(used), task, np.int64)),
            *[pa.array(np.concatenate([np.zeros(len(at)), counts["b"][classes + used, z]])) for z in range(k)],
        ],
        ["at", "v", "word", "task", *[f"c{z}" for z in range(k)]],
    )


def kind_of(at: int) -> str:
    return "<f8" if at < 0 else "<f4"


def summed(table: pa.Table) -> pa.Table:
    """Rows (at, task, v) of one at: the sum of their arrays, in order of tasks."""
    table = table.sort_by("task")
    kind = kind_of(table.column("at")[0].as_py())
    total = sum(np.frombuffer(x.as_buffer(), kind).astype(float) for x in table.column("v").combine_chunks())
    return pa.table({"at": table.column("at").slice(0, 1), "task": table.column("task").slice(0, 1), "v": pa.array([total.astype(kind).tobytes()], pa.binary())})


def held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they hold most bytes of classes."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
        if sum(x.column("_cls").nbytes for x in kept) >= most:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept:
        yield pa.Table.from_batches(kept)


NO_WORDS = np.zeros(0, np.int64)


def joined_model(model: dict, right: pa.Table) -> tuple[dict, np.ndarray]:
    """The model with the emissions of a block's other words, (word, b), behind its classes, and these words."""
    words = right.column("word").to_numpy()
    order = np.argsort(words)
    more = np.array(right.column("b").to_pylist(), float).reshape(len(words), len(model["a"]))[order]
    return model | {"b": np.concatenate([model["b"], more]), "below": np.concatenate([model["below"], np.zeros(len(words))])}, words[order]


def log_likelihoods(model: dict, seqs: list[np.ndarray], segment: int = SEGMENT) -> np.ndarray:
    """log10 of the exact probability of each sequence, by the scaled forward recursion; the longest first."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    out = np.zeros(len(seqs))
    for part in spans(np.array([len(seqs[i]) for i in order]), GROUP_TOKENS, 4096):
        some = order[part]
        group, now = [seqs[i] for i in some], np.tile(model["start"], (len(some), 1))
        for first in range(0, len(group[0]), segment):
            steps = Steps(group, first, first + segment)
            _, alpha, sums = steps.forward(model, now, first == 0)
            now = alpha[steps.o[-2] :]
            row = np.arange(steps.o[-1]) - np.repeat(steps.o[:-1], steps.alive)
            out[some] += np.bincount(row, np.log10(sums), len(some))
    return out


SCORED = "_doc long, _row long, _head double, _known long, _alone double, _n long, _hmm double, _below double"


def scored(model: dict, table: pa.Table, words: np.ndarray) -> pa.RecordBatch:
    """Adds _hmm and _below (the sum of log10 of the classes' word totals) to encoded documents."""
    seqs = sequences(table, len(model["b"]) - len(words), words)
    cols = [table.column(c).combine_chunks() for c in ("_doc", "_row", "_head", "_known", "_alone")]
    cols = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in cols]
    cols += [pa.array([len(s) for s in seqs], pa.int64()), pa.array(log_likelihoods(model, seqs)), pa.array([float(model["below"][s].sum()) for s in seqs], pa.float64())]
    return pa.RecordBatch.from_arrays(cols, ["_doc", "_row", "_head", "_known", "_alone", "_n", "_hmm", "_below"])


def over_blocks(docs: DataFrame, right: DataFrame | None, model: dict, work: Callable[[dict, pa.Table, np.ndarray], pa.RecordBatch], schema: str, most: int) -> DataFrame:
    """work over encoded documents with the model; with right (_blk, word, b), over each block with its words' emissions as well."""
    if right is None:
        return docs.mapInArrow(lambda batches: (work(model, x, NO_WORDS) for x in held(batches, most)), schema)

    def block(left: pa.Table, more: pa.Table) -> pa.Table:
        own, words = joined_model(model, more)
        return pa.Table.from_batches([work(own, left, words)]) if left.num_rows else pa.schema(work(own, left, words).schema).empty_table()

    return docs.groupBy("_blk").cogroup(right.groupBy("_blk")).applyInArrow(block, schema)


def head_of(counts: DataFrame, most: int) -> pa.Table:
    """The most frequent words, at most ``most``: whole classes of frequency, from the highest down.

    Only the number of words of each class reaches the driver before the words do.
    """
    classed = counts.withColumn("_class", size_class(F.col("n")))
    left, floor = most, 0
    for r in sorted(classed.groupBy("_class").count().collect(), key=lambda r: -r["_class"]):
        left -= r["count"]
        if left < 0:
            floor = r["_class"] + 1
            break
    return classed.filter(F.col("_class") >= floor).select("word", "n", "shape").orderBy(F.desc("n"), "word").toArrow()


def score_documents(
    docs: DataFrame,
    *,
    folds: int = 7,
    held_fold: int = 2,
    states: int = 8,
    own_count: int = 256,
    head_words: int = 262_144,
    rounds: int = 4,
    settled: float = 0.002,
    segment: int = SEGMENT,
    block_tokens: int = 4_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Returns the rows' doc_id with held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    A document is held out if crc32(doc_id as text) mod folds is held_fold; a null doc_id counts as ''.
    Null and empty texts are the end token alone. Without any training document all counts are 0. One
    row comes back for each input row, repeated ones as well; other columns are not carried, so none clashes.
    A very long text is one row in a task's memory, with some 20 bytes for each of its tokens.
    Baum-Welch ends when a round adds less than settled (nats a token) to the likelihood, at the latest
    after ``rounds``. head_words bounds what is sent to every task (8 * states + 16 bytes a word); all other
    words, and the emissions of those among them that occur own_count times, are joined. segment only
    bounds the memory of an E-step. The head's size changes nothing in the results.
    """
    spark = docs.sparkSession
    small_batches(spark)
    c = Carried(docs, doc=id_col, text=text_col)
    fold = F.pmod(F.crc32(F.coalesce(c.col("doc").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    base = c.df.select(c.col("doc").cast("long").alias("_doc"), (fold == held_fold).alias("_out"), c.col("text").alias("_text"))
    counts = materialise(
        base.filter(~F.col("_out")).select("_text").mapInArrow(count_words, "word long, shape int, n long")
        .groupBy("word").agg(F.sum("n").alias("n"), F.min("shape").alias("shape")),
        "counts",
    )
    n_all, vocabulary = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = head_of(counts, head_words)
    words, seen = (top.column(c).to_numpy() for c in ("word", "n"))
    # No word after these is more frequent; ties are wholly in the head or wholly out of it.
    floor = int(seen.min()) if len(seen) else 0
    words = words.view(np.uint64)
    if END not in words:
        words, seen = np.append(words, END), np.append(seen, counts.filter(F.col("word") == int(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    # The end token has a class of its own in any case.
    order = np.argsort(words, kind="stable")
    words, seen = words[order], seen[order]
    own = np.full(len(words), -1, np.int64)
    chosen = np.flatnonzero((seen >= own_count) | (words == END))
    own[chosen] = np.arange(len(chosen))
    classes = len(chosen) + SHAPES
    encoded = materialise(
        base.select("_doc", "_text").mapInArrow(
            encode(words, np.log10(seen + 1.0), own, classes, block_tokens),
            "_doc long, _blk long, _row long, _cls binary, _at binary, _rare array<long>, _head double, _known long, _alone double",
        ),
        "encoded",
    )
    # Words of each shape's class: all that have no class of their own.
    mass, below = np.ones(classes), np.zeros(classes)
    mass[: len(chosen)] = seen[chosen] + 1.0
    plain = counts.filter((F.col("n") < own_count) & (F.col("word") != int(END)))
    for r in plain.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[len(chosen) + r["shape"]] = r["n"] + r["v"] + 1.0
    below[len(chosen) :] = np.log10(mass[len(chosen) :])
    # The other words with emissions of their own, and which blocks hold them.
    tail = blocks = None
    if floor > own_count:
        tail = counts.filter((F.col("n") >= own_count) & (F.col("n") < floor) & (F.col("word") != int(END))).select("word", "n")
        tail = materialise(tail, "tail")
        blocks = materialise(encoded.select("_blk", F.explode("_rare").alias("word")).join(tail.select("word"), "word", "left_semi").distinct(), "tail-blocks")
    names = np.concatenate([words[chosen], np.arange(SHAPES, dtype=np.uint64)])
    states_of = [f"c{z}" for z in range(states)]
    b, other = starting(names, mass, states), np.zeros(states)
    weights = None
    if tail is not None:

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                c = starting(x.column("word").to_numpy().view(np.uint64), x.column("n").to_numpy() + 1.0, states)
                yield pa.RecordBatch.from_arrays([x.column("word"), *[pa.array(np.ascontiguousarray(c[:, z])) for z in range(states)]], ["word", *states_of])

        weights = materialise(tail.mapInArrow(begun, "word long, " + ", ".join(f"{x} double" for x in states_of)), "tail-start")

    def emissions(b: np.ndarray, weights: DataFrame | None) -> tuple[np.ndarray, DataFrame | None]:
        """Weights of all classes and words, divided by their sums over both."""
        total = b.sum(axis=0)
        if weights is None:
            return b / total, None
        total = total + np.array([x or 0.0 for x in weights.agg(*[F.sum(x) for x in states_of]).first()])
        right = blocks.join(weights, "word").select("_blk", "word", F.array(*[(F.col(x) / float(t)) for x, t in zip(states_of, total)]).alias("b"))
        return b / total, right

    model = {"start": np.full(states, 1 / states), "a": np.full((states, states), 0.2 / states) + 0.8 * np.eye(states), "below": below}
    model["b"], right = emissions(b, weights)
    fold_of = F.pmod(F.crc32(F.coalesce(F.col("_doc").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    train = encoded.filter(fold_of != held_fold).select("_blk", "_cls", "_at", "_rare") if tail is not None else encoded.filter(fold_of != held_fold).select("_cls")
    unit, last = 200.0 / (mass.sum() + (0 if tail is None else tail.agg(F.sum(F.col("n") + 1.0)).first()[0] or 0)), -math.inf
    e_step = "at long, v binary, word long, task long, " + ", ".join(f"{x} double" for x in states_of)
    pair = "at long, task long, v binary"
    if tail is None:
        # Each task sends the sums of all classes it has met: four splits a task, as long as all cores have work.
        train = train.coalesce(max(2 * spark.sparkContext.defaultParallelism, train.rdd.getNumPartitions() // 4))
    for _ in range(rounds):
        got = over_blocks(train, right, model, lambda m, x, w: expected(m, sequences(x, len(m["b"]) - len(w), w), w, segment), e_step, 16_000_000)
        got = materialise(got, "expected") if tail is not None else got
        # Arrays are summed in runs of tasks, then these sums. As many numbers reach the driver as there are classes, times the states.
        some = got.filter(F.col("at").isNotNull()).select("at", "task", "v").groupBy("at", F.floor(F.col("task") / 16)).applyInArrow(summed, pair)
        rows = some.groupBy("at").applyInArrow(summed, pair).select("at", "v").toArrow().to_pylist()
        few = {r["at"]: np.frombuffer(r["v"], kind_of(r["at"])).reshape(-1, states) for r in rows}
        if -1 not in few:
            break
        whole, learnt_b = few[-1], np.zeros((classes, states))
        for i, v in few.items():
            if i >= 0:
                learnt_b[i * CHUNK : i * CHUNK + len(v)] = v
        model = model | {"a": _rows(whole[:states] + 0.1), "start": _rows(whole[states : states + 1] + 0.1)[0]}
        if tail is not None:
            learnt = got.filter(F.col("word").isNotNull()).groupBy("word").agg(*[F.sum(x).alias(x) for x in states_of])
            prior = F.lit(unit) * (F.col("n") + 1.0) + 1e-3
            weights = materialise(tail.join(learnt, "word", "left").select("word", *[(F.coalesce(x, F.lit(0.0)) + prior).alias(x) for x in states_of]), "tail-weights")
        model["b"], right = emissions(learnt_b + unit * mass[:, None] + 1e-3, weights)
        likelihood = float(whole[states + 1].sum())
        if likelihood - last < settled * max(n_all, 1):
            break
        last = likelihood
    told = over_blocks(encoded, right, model, scored, SCORED, 16_000_000)
    heavy = F.lit(False) if tail is None else (F.col("n") >= own_count)
    rare = (
        encoded.select("_row", F.explode("_rare").alias("word"))
        .join(counts.select("word", "n"), "word", "left")
        .groupBy("_row")
        .agg(
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("_rlog"),
            F.count("n").alias("_rknown"),
            F.sum(F.when(heavy, F.log10(F.col("n") + 1.0))).alias("_tlog"),
        )
    )
    r_log = F.coalesce("_rlog", F.lit(0.0))
    return told.join(rare, "_row", "left").select(
        F.col("_doc").alias(id_col),
        (fold_of == held_fold).alias("held_out"),
        F.col("_n").alias("n_tokens"),
        (F.col("_known") + F.coalesce("_rknown", F.lit(0))).alias("n_known"),
        F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("_head") + r_log - F.col("_n") * math.log10(n_all + vocabulary + 1)).alias("base_score"),
        # A word alone in its class has probability 1 given the class.
        (F.col("_hmm") + F.col("_head") - F.col("_alone") + r_log - F.coalesce("_tlog", F.lit(0.0)) - F.col("_below")).alias("score"),
    )


def _rows(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)
