"""Embedding near-dedup by cross-polytope hashing.

Each table turns a unit vector by three rounds of random signs and a fast Hadamard transform, TURNS times,
and the nearest signed axes of all turns make its key. A vector looks into its own bucket and, for each
turn, into that of the second nearest axis (multiprobe). Candidates are verified by their cosine in
double precision. Vectors equal in every component form one class and are compared once.

The vectors that meet in a bucket are compared in blocks of bounded size by one matrix product inside a
task, which gives back one row per vector: how many links it has there, and one vector that it is joined
to. So no row is made for a pair. A pair that meets in several buckets is counted in one of them only:
that of the first table in which it meets, which the vectors' axes tell without another join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Forest, grouped, halves
from .common import Carried, materialise, small_batches
from .components import components
from .vectext import mix

TURNS, TABLES = 3, 10
#: Rows of one half of a block.
BLOCK = 512
BLOCK_KEY = ("_table", "_bucket", "_lo", "_hi")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x


def axes(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest and second nearest signed axis of each turned row."""
    n = 1 << max(1, (unit.shape[1] - 1).bit_length())
    y = np.zeros((len(unit), n))
    y[:, : unit.shape[1]] = unit
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice((-1.0, 1.0), n)) / np.sqrt(n)
    two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
    at = np.take_along_axis(y, two, 1)
    swap = np.abs(at[:, 1]) > np.abs(at[:, 0])
    two[swap], at[swap] = two[swap][:, ::-1], at[swap][:, ::-1]
    code = 2 * two + (at < 0)
    return code[:, 0], code[:, 1]


def rows_of(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of vectors; null and empty ones and those with a null component are left out."""
    n = len(vectors)
    if not n:
        return
    values, offsets = vectors.values, np.asarray(vectors.offsets)
    flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), float)
    size = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), offsets[1:] - offsets[:-1], 0)
    holes = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    size = np.where(holes[offsets[1:]] > holes[offsets[:-1]], 0, size)
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        yield at, flat[offsets[at][:, None] + np.arange(d)]


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _label, _v) -> also a 128-bit mark of the vector, null where it links with nothing."""
    for batch in batches:
        marks, good = np.zeros((2, batch.num_rows), np.int64), np.zeros(batch.num_rows, bool)
        for at, x in rows_of(batch.column("_v")):
            x = x + 0.0  # no negative zero
            bits = x.view(np.uint64) + mix(np.arange(1, x.shape[1] + 1, dtype=np.uint64))
            for i, s in enumerate((0x51ED27, 0xB4B82E39)):
                marks[i, at] = mix(bits ^ np.uint64(s)).sum(axis=1, dtype=np.uint64).astype(np.int64)
            good[at] = np.isfinite(x).all(axis=1) & x.any(axis=1)
        good &= batch.column("_label").is_valid().to_numpy(zero_copy_only=False)
        cols = [pa.array(m, pa.int64(), mask=~good) for m in marks]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_label"), batch.column("_v"), *cols], ["_id", "_label", "_v", "_m1", "_m2"])


def axes_of(unit: np.ndarray, tables: int, seed: int) -> np.ndarray:
    """(n, tables, 2, TURNS): the nearest and the second nearest axes of all turns of all tables."""
    return np.stack([np.stack([np.stack(axes(unit, seed + t * TURNS + i), 1) for i in range(TURNS)], 2) for t in range(tables)], 1)


def bucket_keys(code: np.ndarray) -> np.ndarray:
    """axes_of(...) -> (n, tables, 1 + TURNS): the key of the own bucket, and those of the others to look into."""
    out = []
    for flip in range(-1, TURNS):
        key = np.arange(1, code.shape[1] + 1, dtype=np.uint64) + np.zeros((len(code), 1), np.uint64)
        for i in range(TURNS):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) ^ code[:, :, int(i == flip), i].astype(np.uint64))
        out.append(key)
    return np.stack(out, 2).view(np.int64)


def hashed(tables: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_node, _label, _v) -> (_node, _label, _code, _keys): axes as uint16, and the keys to look into, 1 + TURNS a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, keys = [b""] * batch.num_rows, [np.zeros(0, np.int64)] * batch.num_rows
            for at, x in rows_of(batch.column("_v")):
                c = axes_of(units(x), tables, seed)
                # Vectors of another length are never compared.
                k = bucket_keys(c) ^ np.int64(x.shape[1])
                for j, i in enumerate(at.tolist()):
                    code[i], keys[i] = c[j].astype("<u2").tobytes(), k[j].ravel()
            yield pa.RecordBatch.from_arrays([batch.column("_node"), batch.column("_label"), pa.array(code, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["_node", "_label", "_code", "_keys"])

    return run


def visits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether y looks into the own bucket of x, for pairs of axes in one table: (n, 2, TURNS) twice -> (n,)."""
    other = x[:, 0] != y[:, 0]
    second = x[:, 0] == y[:, 1]
    n = other.sum(axis=1)
    return (n == 0) | (n == 1) & (other & second).any(axis=1)


def counted_here(code: np.ndarray, node: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Which pairs of rows i and j, met in a bucket of a table, count there: that is the first of their tables, and the first bucket in it."""
    live = np.arange(len(i))
    for t in range(table):
        x, y = code[i[live], t], code[j[live], t]
        live = live[~(visits(x, y) | visits(y, x))]
    x, y = code[i[live], table], code[j[live], table]
    to_x, to_y = visits(x, y), visits(y, x)
    of_x, of_y = own[i[live]] & to_x, own[j[live]] & to_y
    # Where either looks into the other's bucket, that of the lesser node counts.
    return live[np.where(to_x & to_y, np.where(node[i[live]] < node[j[live]], of_x, of_y), of_x | of_y)]


def linked(least: float, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of vectors -> (_node, _others, _to): links counted here, and one vector that it is joined to or itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in grouped(batches, BLOCK_KEY):
            half, node, size, own = (block.column(c).to_numpy(zero_copy_only=False) for c in ("_half", "_node", "_k", "_own"))
            code = np.frombuffer(b"".join(block.column("_code").to_pylist()), "<u2").reshape(len(node), tables, 2, TURNS)
            ((_, v),) = rows_of(block.column("_v"))
            unit = units(v)
            lo, hi, table = (block.column(c)[0].as_py() for c in ("_lo", "_hi", "_table"))
            a, b = np.flatnonzero(half == lo), np.flatnonzero(half == hi)
            near = unit[a] @ unit[b].T
            # Sums in another order differ in the last places: pairs that near to the threshold are summed plainly.
            i, j = np.nonzero(near >= least - 1e-9)
            near, i, j = near[i, j], a[i], b[j]
            ask = (own[i] | own[j]) & ((i < j) if lo == hi else (i != j))
            near, i, j = near[ask], i[ask], j[ask]
            close = near < least + 1e-9
            near[close] = (unit[i[close]] * unit[j[close]]).sum(axis=1)
            i, j = i[near >= least], j[near >= least]
            others, forest = np.zeros(len(node), np.int64), Forest(len(node))
            for at in range(0, len(i), 65536):
                x, y = i[at : at + 65536], j[at : at + 65536]
                here = counted_here(code, node, own, x, y, table)
                x, y = x[here], y[here]
                others += np.bincount(x, size[y], len(node)).astype(np.int64) + np.bincount(y, size[x], len(node)).astype(np.int64)
                forest.join(x, y)
            keep = np.flatnonzero(others)
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(others[keep]), pa.array(node[forest.roots()[keep]])], ["_node", "_others", "_to"])

    return run


def near_vectors(
    vectors: DataFrame,
    *,
    least: float = 0.98,
    tables: int = TABLES,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Returns per row vec_id, n_links, component_id, kept. Other columns are not carried.

    Only vectors of one label and length are compared. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without a label, link with nothing. Rows that share an id and a vector
    count as separate vectors. n_links counts copies. A null id takes part and names no component of which
    another vector has an id. No result depends on an order, so there are no ties. A clash of names with other
    columns does no harm.
    """
    small_batches(vectors.sparkSession, 2048)
    c = Carried(vectors, id=id_col, vector=vector_col, label=label_col)
    rows = materialise(
        c.df.select(c.col("id").cast("long").alias("_id"), c.col("label").cast("string").alias("_label"), c.col("vector").alias("_v")).mapInArrow(
            usable, f"_id long, _label string, _v {dict(c.df.dtypes)[c.at['vector']]}, _m1 long, _m2 long"
        ),
        "vectors",
    )
    # A class is named by its row in the table that is written here: no two have one name.
    classes = materialise(
        rows.filter(F.col("_m1").isNotNull())
        .groupBy("_label", "_m1", "_m2")
        .agg(F.count(F.lit(1)).alias("_k"), F.min("_id").alias("_low"), F.first("_v").alias("_v"))
        .withColumn("_node", F.monotonically_increasing_id()),
        "vector-classes",
    )
    keys = materialise(
        classes.select("_node", "_label", "_v").mapInArrow(hashed(tables, seed), "_node long, _label string, _code binary, _keys array<long>"),
        "vector-keys",
    )
    placed = keys.select("_node", "_label", F.posexplode("_keys").alias("_at", "_key")).select(
        "_node",
        F.xxhash64("_label", "_key").alias("_bucket"),
        F.floor(F.col("_at") / (1 + TURNS)).cast("int").alias("_table"),
        (F.col("_at") % (1 + TURNS) == 0).alias("_own"),
    )
    met = materialise(
        placed.groupBy("_bucket", "_table")
        .agg(F.count(F.lit(1)).alias("_many"), F.max("_own").alias("_any"))
        .filter("_many > 1 and _any")
        .select(F.col("_bucket").alias("_b"), F.col("_table").alias("_t"), "_many"),
        "vector-buckets",
    )
    members = materialise(
        placed.join(met, (F.col("_bucket") == F.col("_b")) & (F.col("_table") == F.col("_t"))).select("_bucket", "_table", "_own", "_node", "_many"),
        "vector-members",
    )
    load = classes.select("_node", "_k", "_v").join(keys.select("_node", "_code"), "_node")
    counted = materialise(
        halves(members.withColumn("_parts", F.ceil(F.col("_many") / BLOCK)).join(load, "_node"), BLOCK_KEY, "_own", "_node", "_k", "_code", "_v").mapInArrow(
            linked(least, tables), "_node long, _others long, _to long"
        ),
        "vector-links",
    )
    groups = materialise(components(counted, "_node", "_to"), "vector-groups")
    degrees = counted.groupBy("_node").agg(F.sum("_others").alias("_others"))
    labelled = (
        classes.drop("_v")
        .join(degrees, "_node", "left")
        .join(groups.select(F.col("node").alias("_node"), "component"), "_node", "left")
        .select(
            F.col("_label").alias("_l"),
            F.col("_m1").alias("_a"),
            F.col("_m2").alias("_b"),
            "_low",
            (F.col("_k") - 1 + F.coalesce("_others", F.lit(0))).alias("_links"),
            F.coalesce("component", "_node").alias("_group"),
        )
    )
    named = labelled.join(labelled.groupBy("_group").agg(F.min("_low").alias("_least")), "_group").select("_l", "_a", "_b", "_links", "_least")
    ours = F.col("_m1").isNotNull()
    found = rows.drop("_v").join(named, (F.col("_label") == F.col("_l")) & (F.col("_m1") == F.col("_a")) & (F.col("_m2") == F.col("_b")), "left")
    component = F.when(ours, F.col("_least")).otherwise(F.col("_id"))
    return found.select(
        F.col("_id").alias(id_col),
        F.when(ours, F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
