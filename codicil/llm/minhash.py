"""MinHash near-dedup with tensored banding.

Two small collections of half keys are hashed per document (ROWS minhashes each); a table key joins one
half key of either collection, so HALVES * HALVES tables cost 2 * HALVES * ROWS minhashes. With 10
halves of 3 rows a pair of similarity 0.85 meets in a table with probability 0.9998. Half keys that no
other document has are left out before tables are formed, as no key that they are part of is shared.

Work is done on classes of documents with equal shingle sets, so groups of exact copies of any size cost
nothing. Candidates are first the links of each bucket's members to one member of it (linear in the
bucket), verified on full sets. Members of one bucket that are then still in different components are
compared every one with every other, in blocks of bounded size: a task gets two blocks, first of
signatures and then of texts, and gives back only who has a likely partner, and then links that join
components, fewer than it has rows; so no row is made for a pair. A pair that meets in several buckets is
left to the first of its tables, which its half keys tell. Signatures drop pairs far below the threshold
before any text is moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, grouped, halves as halved
from .common import Carried, bounded, materialise
from .components import components
from .vectext import mix, shingle_sets, slices

HALVES, ROWS = 10, 3
#: A pair at the threshold has at most this much less of equal minhashes, but for a chance of 6e-7 at 0.85 and 3e-6 at 0.80.
SLACK = 0.25
#: Rows of one part of a block of signatures, and of texts; shingles of one part of a block of texts.
BLOCK, TEXTS, SHINGLES = 1024, 256, 1_000_000
BLOCK_KEY = ("_table", "_key", "_lo", "_hi")
LIKELY = ("_table", "_key", "_node", "_group", "_n", "_sig")
#: Rows of ids that are sent to all tasks; more are joined by a shuffle.
SENT_ROWS = 200_000
#: A bucket's head is its lowest member in one of these orders.
ORDERS = (0, 0x2AAAAAAAAAAAAAAA, 0x5555555555555555)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.arange(1, n + 1, dtype=np.uint64)
    return mix(base * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1), mix(base * np.uint64(0x5851F42D4C957F2D))


def minhashes(members: np.ndarray, n: int) -> np.ndarray:
    """n minhashes (32 bits) of a set of 64-bit hashes; long sets go in blocks."""
    a, b = _seeds(n)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(members), 4096):
        low = np.minimum(low, (members[at : at + 4096, None] * a + b).min(axis=0))
    return low >> np.uint64(32)


def sign(k: int, halves: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_doc, _text) -> what the search needs of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = mix(np.arange(1, 2 * halves + 1, dtype=np.uint64))
        for batch in (x for y in batches for x in slices(y, "_text")):
            sets = shingle_sets(batch.column("_text"), k)
            n = 2 * halves * rows
            low = np.stack([minhashes(s, n) for s in sets])
            keys = tag + np.zeros((len(sets), 1), np.uint64)
            for r in range(rows):
                keys = mix(keys ^ low.reshape(len(sets), 2 * halves, rows)[:, :, r])
            # What tells in which table two documents first meet: all half keys, in 32 bits.
            short = np.ascontiguousarray((keys >> np.uint64(32)).astype("<u4"))
            keys = keys.view(np.int64)
            total = [[int(x.sum(dtype=np.uint64).astype(np.int64)), int(mix(x ^ np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64).astype(np.int64))] for x in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_doc"),
                    batch.column("_mark"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([t[0] for t in total], pa.int64()),
                    pa.array([t[1] for t in total], pa.int64()),
                    pa.array(list(keys[:, :halves]), pa.list_(pa.int64())),
                    pa.array(list(keys[:, halves:]), pa.list_(pa.int64())),
                    pa.array([x.astype(np.uint8).tobytes() + y.tobytes() for x, y in zip(low, short)], pa.binary()),
                ],
                ["_doc", "_mark", "_n", "_s1", "_s2", "_a", "_b", "_sig"],
            )

    return run


def _unpacked(raw: list[bytes], minhashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Minhashes of 8 bits and half keys of 32 bits, (rows, 2, halves), of packed signatures."""
    flat = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return flat[:, :minhashes], np.ascontiguousarray(flat[:, minhashes:]).view("<u4").reshape(len(raw), 2, -1)


def _alike(most_unlike: float, minhashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps pairs (x, y, _sx, _sy) whose signatures agree in enough places, with the share of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unpacked(batch.column(c).to_pylist(), minhashes)[0] for c in ("_sx", "_sy"))
                share = (a == b).mean(axis=1)
                keep = pa.array(share >= most_unlike)
                yield pa.RecordBatch.from_arrays([batch.column("x").filter(keep), batch.column("y").filter(keep), pa.array(share).filter(keep)], ["x", "y", "likeness"])

    return run


def _asked(block: pa.RecordBatch, floor: float, minhashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block's rows that are to be compared: of both parts, in different components, alike, first met in this table."""
    half, group = (block.column(c).to_numpy(zero_copy_only=False) for c in ("_half", "_group"))
    sig, short = _unpacked(block.column("_sig").to_pylist(), minhashes)
    lo, hi, table = (block.column(c)[0].as_py() for c in ("_lo", "_hi", "_table"))
    a, b = np.flatnonzero(half == lo), np.flatnonzero(half == hi)
    equal = np.zeros((len(a), len(b)), np.uint8)
    for column in np.ascontiguousarray(sig.T):
        equal += column[a][:, None] == column[b][None, :]
    i, j = np.nonzero(equal >= np.ceil(floor * minhashes))
    i, j = a[i], b[j]
    ask = group[i] != group[j]
    if lo == hi:
        ask &= i < j
    i, j = i[ask], j[ask]
    first = np.zeros(len(i), bool)
    for at in range(0, len(i), 65536):
        p = slice(at, at + 65536)
        same = short[i[p]] == short[j[p]]
        first[p] = same[:, 0].argmax(axis=1) * short.shape[2] + same[:, 1].argmax(axis=1) == table
    return i[first], j[first]


def _likely(floor: float, minhashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of signatures -> the rows that have a partner in the block to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, BLOCK_KEY):
            at = pa.array(np.unique(np.concatenate(_asked(block, floor, minhashes))))
            yield pa.RecordBatch.from_arrays([block.column(c).take(at) for c in LIKELY], list(LIKELY))

    return run


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one by one if they are few, else by a product over the shingles that two sets share."""
    a, b = np.unique(i), np.unique(j)
    if 16 * len(i) < len(a) * len(b):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i, j)], np.int64)
    used = np.unique(np.concatenate([a, b]))
    _, at, often = np.unique(np.concatenate([sets[x] for x in used]), return_inverse=True, return_counts=True)
    shared = np.cumsum(often > 1) - 1
    row = np.repeat(np.arange(len(used)), [len(sets[x]) for x in used])
    keep = often[at] > 1
    row, column = row[keep], shared[at[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    a, b, width = np.searchsorted(used, a), np.searchsorted(used, b), 4096
    both = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        begin, end = np.searchsorted(column, (first, first + width))
        part = np.zeros((len(used), width), np.float32)
        part[row[begin:end], column[begin:end] - first] = 1
        both += part[a] @ part[b].T
    return both[np.searchsorted(used[a], i), np.searchsorted(used[b], j)].astype(np.int64)


def _linked(k: int, percent: int, floor: float, minhashes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of texts -> links (x, y): of all that are confirmed in a block, as many as join its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, BLOCK_KEY):
            i, j = _asked(block, floor, minhashes)
            sets = [s for part in slices(block, "_text") for s in shingle_sets(part.column("_text"), k)]
            sizes = np.array([len(s) for s in sets], np.int64)
            both = _common(sets, i, j)
            good = 100 * both >= percent * (sizes[i] + sizes[j] - both)
            node = block.column("_node").to_numpy(zero_copy_only=False)
            names, group = np.unique(block.column("_group").to_numpy(zero_copy_only=False), return_inverse=True)
            forest = Forest(len(names))
            forest.join(group[i[good]], group[j[good]])
            # A link between a component's first row here and the first of what it is joined to does for all of them.
            one = np.zeros(len(names), np.int64)
            one[group[::-1]] = np.arange(len(group))[::-1]
            low = forest.roots()
            at = np.flatnonzero(low != np.arange(len(names)))
            yield pa.RecordBatch.from_arrays([pa.array(node[one[at]]), pa.array(node[one[low[at]]])], ["x", "y"])

    return run


def _confirm(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps pairs (x, y, _tx, _ty) that reach the threshold on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            for part in slices(batch, "_tx"):
                own = shingle_sets(part.column("_tx"), k)
                keep = []
                for i, y in enumerate(part.column("y").to_pylist()):
                    if last[0] != y:  # rows come sorted by y
                        last = (y, shingle_sets(part.column("_ty").slice(i, 1), k)[0])
                    both = len(np.intersect1d(own[i], last[1], assume_unique=True))
                    keep.append(100 * both >= percent * (len(own[i]) + len(last[1]) - both))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("x").filter(keep), part.column("y").filter(keep)], ["x", "y"])

    return run


def near_duplicates(
    docs: DataFrame,
    *,
    percent: int = 85,
    k: int = 5,
    halves: int = HALVES,
    rows: int = ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Returns the rows of docs with n_shingles, component_id and kept.

    Documents are linked at 100 * intersection >= percent * union of their shingle sets. Null, empty and
    blank texts have empty sets and link with nothing. Rows with one doc_id and different texts are
    separate documents of that id, and rows equal in both stay as they are. A null doc_id takes part, but
    never names a component of which another document has an id. Clashing columns are replaced. A very
    long text is one row in a task's memory, with 8 bytes for each of its shingles. No result depends on
    an order, so there are no ties.
    """
    c = Carried(docs, doc=id_col, text=text_col)
    text = F.coalesce(c.col("text"), F.lit(""))
    base = c.df.withColumn("_mark", F.xxhash64(text))
    signed = materialise(
        base.select(c.col("doc").cast("long").alias("_doc"), "_mark", text.alias("_text")).mapInArrow(
            sign(k, halves, rows),
            "_doc long, _mark long, _n long, _s1 long, _s2 long, _a array<long>, _b array<long>, _sig binary",
        ),
        "minhash",
    )
    # A class: documents with one and the same set, named by its row in the table that is written here, with one of their texts.
    classes = materialise(
        signed.filter(F.col("_n") > 0)
        .groupBy("_n", "_s1", "_s2")
        .agg(
            F.min("_doc").alias("_low"),
            F.min(F.struct("_doc", "_mark")).alias("_one"),
            F.first("_a").alias("_a"),
            F.first("_b").alias("_b"),
            F.first("_sig").alias("_sig"),
        )
        .withColumn("_node", F.monotonically_increasing_id()),
        "classes",
    )
    half = classes.select("_node", F.posexplode(F.concat("_a", "_b")).alias("_i", "_half"))
    shared = materialise(half.groupBy("_half").agg(F.count(F.lit(1)).alias("_many")).filter("_many > 1").select("_half"), "shared")
    own = half.join(shared, "_half", "left_semi").groupBy("_node").agg(F.collect_list(F.struct("_i", "_half")).alias("_own"))
    # All pairs of a half of either collection, of those that are left: at most halves * halves a document.
    first, second = F.filter("_own", lambda x: x["_i"] < halves), F.filter("_own", lambda x: x["_i"] >= halves)
    table = lambda x, y: F.struct((x["_i"] * halves + y["_i"] - halves).alias("_table"), F.xxhash64(x["_half"], y["_half"]).alias("_key"))
    keys = materialise(
        own.select("_node", F.explode(F.flatten(F.transform(first, lambda x: F.transform(second, lambda y: table(x, y))))).alias("_k")).select(
            F.col("_k._table").alias("_table"), F.col("_k._key").alias("_key"), "_node"
        ),
        "keys",
    )
    turned = F.col("_node").bitwiseXOR(F.element_at(F.array(*[F.lit(x).cast("long") for x in ORDERS]), F.pmod("_key", F.lit(len(ORDERS))).cast("int") + 1))
    met = materialise(
        keys.groupBy("_table", "_key")
        .agg(F.min(turned).alias("_node"), F.count(F.lit(1)).alias("_many"))
        .filter(F.col("_many") > 1)
        .select(F.col("_table").alias("_t"), F.col("_key").alias("_k"), turned.alias("_head"), "_many"),
        "met",
    )
    buckets = materialise(
        keys.join(met, (F.col("_table") == F.col("_t")) & (F.col("_key") == F.col("_k"))).select("_table", "_key", "_node", "_head", "_many"), "buckets"
    )

    signatures = classes.select("_node", "_sig")
    minhashes, floor = 2 * halves * rows, percent / 100 - SLACK

    def alike(pairs: DataFrame) -> DataFrame:
        with_x = pairs.join(signatures.select(F.col("_node").alias("x"), F.col("_sig").alias("_sx")), "x")
        with_y = with_x.join(signatures.select(F.col("_node").alias("y"), F.col("_sig").alias("_sy")), "y")
        return with_y.select("x", "y", "_sx", "_sy").mapInArrow(_alike(floor, minhashes), "x long, y long, likeness double")

    def texts_of(nodes: DataFrame, name: str) -> DataFrame:
        ones = materialise(
            classes.join(nodes.distinct(), "_node", "left_semi").select("_node", F.col("_one._doc").alias("_odoc"), F.col("_one._mark").alias("_omark")), f"{name}-ones"
        )
        return materialise(
            base.select(c.col("doc").cast("long").alias("_doc"), "_mark", text.alias("_text"))
            .join(bounded(ones, SENT_ROWS), F.col("_doc").eqNullSafe(F.col("_odoc")) & (F.col("_mark") == F.col("_omark")))
            .dropDuplicates(["_node"])
            .select("_node", "_text"),
            f"{name}-texts",
        )

    def with_groups(members: DataFrame, groups: DataFrame) -> DataFrame:
        return members.join(groups.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn("_group", F.coalesce("component", "_node")).drop("component")

    stars = alike(buckets.filter(F.col("_node") != F.col("_head")).select(F.col("_node").alias("x"), F.col("_head").alias("y")).distinct())
    best = materialise(stars.groupBy("x").agg(F.max(F.struct("likeness", "y"))["y"].alias("y")), "stars")
    texts = texts_of(best.select(F.explode(F.array("x", "y")).alias("_node")), "star")
    joined = best.join(texts.select(F.col("_node").alias("x"), F.col("_text").alias("_tx")), "x").join(
        texts.select(F.col("_node").alias("y"), F.col("_text").alias("_ty")), "y"
    )
    links = materialise(joined.select("x", "y", "_tx", "_ty").mapInArrow(_confirm(k, percent), "x long, y long"), "star-links")
    groups = materialise(components(links, "x", "y"), "groups")
    # Members of one bucket that are still apart: every pair of them, in blocks. Buckets of equal members count once, in the first of their tables.
    placed = with_groups(buckets.select("_table", "_key", "_node", "_many"), groups)
    mixed = (
        placed.groupBy("_table", "_key")
        .agg(F.min("_group").alias("_g0"), F.max("_group").alias("_g1"), F.max("_many").alias("_many"), F.sum(F.xxhash64("_node").cast("decimal(38,0)")).alias("_all"))
        .filter("_g0 <> _g1")
        .groupBy("_all", "_many")
        .agg(F.min(F.struct("_table", "_key")).alias("_b"))
        .select(F.col("_b._table").alias("_t"), F.col("_b._key").alias("_k"))
    )
    mixed = materialise(mixed, "mixed")
    rest = placed.join(mixed, (F.col("_table") == F.col("_t")) & (F.col("_key") == F.col("_k")))
    parts = F.ceil(F.col("_many") / BLOCK)
    likely = materialise(
        halved(rest.withColumn("_parts", parts).join(classes.select("_node", "_n", "_sig"), "_node"), BLOCK_KEY, "_node", "_group", "_n", "_sig")
        .mapInArrow(_likely(floor, minhashes), "_table int, _key long, _node long, _group long, _n long, _sig binary")
        .dropDuplicates(["_table", "_key", "_node"]),
        "likely",
    )
    texts = texts_of(likely.select("_node"), "block")
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / TEXTS, F.sum("_n") / SHINGLES))
    counted = likely.join(likely.groupBy("_table", "_key").agg(parts.alias("_parts")), ["_table", "_key"])
    blocks = halved(counted.join(texts, "_node"), BLOCK_KEY, "_node", "_group", "_sig", "_text")
    links = links.unionByName(materialise(blocks.mapInArrow(_linked(k, percent, floor, minhashes), "x long, y long"), "block-links"))
    groups = materialise(components(links, "x", "y"), "groups")

    labelled = with_groups(classes.select("_n", "_s1", "_s2", "_node", "_low"), groups)
    named = labelled.join(labelled.groupBy("_group").agg(F.min("_low").alias("_least")), "_group").select("_n", "_s1", "_s2", "_least")
    found = (
        signed.select("_doc", "_mark", "_n", "_s1", "_s2")
        .dropDuplicates(["_doc", "_mark"])
        .join(named, ["_n", "_s1", "_s2"], "left")
        .select(
            F.col("_doc").alias("_fdoc"),
            F.col("_mark").alias("_fmark"),
            "_n",
            F.when(F.col("_n") > 0, F.col("_least")).otherwise(F.col("_doc")).alias("_component"),
        )
    )
    rowed = base.join(found, c.col("doc").cast("long").eqNullSafe(F.col("_fdoc")) & (F.col("_mark") == F.col("_fmark")))
    return c.restore(
        rowed,
        {
            "n_shingles": F.col("_n"),
            "component_id": F.col("_component"),
            "kept": c.col("doc").cast("long").eqNullSafe(F.col("_component")),
        },
    )
