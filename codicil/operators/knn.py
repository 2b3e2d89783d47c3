"""Exact nearest neighbours by cosine.

Query vectors are a stated set. A small one (at most SENT numbers) is sent to all tasks; a greater one meets
the rows in cells of at most about BLOCK queries and CELL rows. Either way a matrix product scores a batch,
a task keeps the k best of each query over all its rows, and only those are shuffled. Where even that is too
much, ``score`` gives the plain join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from codicil.functions.similarity import cosine

#: Query vectors in one cell or one matrix product.
BLOCK = 2048
#: Rows in one cell.
CELL = 65536
#: Numbers in the query vectors (32 MB as doubles) up to which they are sent to all tasks.
SENT = 4_000_000


def score(vectors: DataFrame, queries: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of every query and vector of equal length."""
    rows = vectors if scope is None else vectors.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")
    asked = queries.select("query_id", F.col("vector").alias("_q"))
    return rows.crossJoin(asked).filter(F.size("vector") == F.size("_q")).select("query_id", "chunk_id", F.round(cosine(F.col("vector"), F.col("_q")), 6).alias("score"))


def _matrices(vectors: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: the places of those vectors, and they as unit rows; null and empty vectors have none."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    length = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for d in np.unique(length[length > 0]):
        at = np.flatnonzero(length == d)
        x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield at, np.divide(x, n, out=np.zeros_like(x), where=n != 0)


class _Best:
    """The k best rows of each query so far: by score, then by id."""

    def __init__(self, ids: pa.Array, vectors: pa.Array, k: int):
        self.ids, self.k = ids, k
        self.blocks = [(at[i : i + BLOCK], x[i : i + BLOCK]) for at, x in _matrices(vectors) for i in range(0, len(at), BLOCK)]
        self.found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.cut = np.full(len(ids), -np.inf)

    def add(self, ids: pa.Array, vectors: pa.Array) -> None:
        names = ids.to_numpy(zero_copy_only=False)
        names = names.astype(str) if names.dtype == object else names
        for rows, x in _matrices(vectors):
            for asked, q in self.blocks:
                if q.shape[1] != x.shape[1]:
                    continue
                for i, s in zip(asked, np.round(q @ x.T, 6) + 0.0):
                    # NaN is at least nothing: a vector with null or NaN components is no neighbour.
                    if len(near := np.flatnonzero(s >= self.cut[i])):
                        self._keep(i, s[near], names[rows[near]])

    def _keep(self, i: int, s: np.ndarray, names: np.ndarray) -> None:
        if i in self.found:
            s, names = np.concatenate([self.found[i][0], s]), np.concatenate([self.found[i][1], names])
        order = np.lexsort((names, -s))[: self.k]
        self.found[i] = s[order], names[order]
        if len(order) == self.k:
            self.cut[i] = s[order[-1]]

    def table(self, out: pa.Schema) -> pa.RecordBatch:
        at = sorted(self.found)
        queries = self.ids.take(pa.array(np.repeat(at, [len(self.found[i][0]) for i in at]).astype("int64")))
        names = pa.array(np.concatenate([self.found[i][1] for i in at]).tolist() if at else [], out.field("chunk_id").type)
        scores = pa.array(np.concatenate([self.found[i][0] for i in at]) if at else [], pa.float64())
        return pa.RecordBatch.from_arrays([queries.cast(out.field("query_id").type), names, scores], schema=out)


def _sent(rows: DataFrame, asked: pa.Table, k: int, schema) -> DataFrame:
    """Scores of the k best a task, the queries being part of the task."""
    out = to_arrow_schema(schema)
    ids, block = asked.column("query_id").combine_chunks(), asked.column("vector").combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, block, k)
        for batch in batches:
            best.add(batch.column("chunk_id"), batch.column("vector"))
        yield best.table(out)

    return rows.mapInArrow(run, schema)


def _in_cells(rows: DataFrame, asked: DataFrame, n_rows: int, n_asked: int, k: int, schema) -> DataFrame:
    """Scores of the k best a cell: queries and rows are dealt by hash, and each pair of hashes is a cell."""
    out = to_arrow_schema(schema)
    across, down = -(-n_asked // BLOCK), -(-n_rows // CELL)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("query_id", "vector", deal("query_id", across).alias("_a"), every(down).alias("_b"))
    right = rows.select("chunk_id", "vector", deal("chunk_id", down).alias("_b"), every(across).alias("_a"))

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        if not queries.num_rows or not found.num_rows:
            return out.empty_table()
        best = _Best(queries.column("query_id").combine_chunks(), queries.column("vector").combine_chunks(), k)
        for batch in found.to_batches(8192):
            best.add(batch.column("chunk_id"), batch.column("vector"))
        return pa.Table.from_batches([best.table(out)])

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(run, schema)


def block_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, scope: DataFrame | None = None, least: float | None = None, most_sent: int = SENT) -> DataFrame:
    """(query_id, chunk_id, score, rank), as top_k of score, by matrix products.

    Query vectors of at most most_sent numbers in all are sent to the tasks, others meet the rows in cells.
    k under 1 finds nothing; vectors with null or NaN components are no neighbours of any.
    """
    rows = (vectors if scope is None else vectors.join(scope.select("chunk_id").distinct(), "chunk_id", "left_semi")).select("chunk_id", "vector")
    asked = queries.select("query_id", "vector").filter(F.size("vector") > 0)
    kinds = {"query_id": asked.schema["query_id"].dataType.simpleString(), "chunk_id": rows.schema["chunk_id"].dataType.simpleString()}
    schema = rows.sparkSession.createDataFrame([], f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double").schema
    if k < 1:
        return rows.sparkSession.createDataFrame([], schema).withColumn("rank", F.lit(0))
    n, numbers = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if numbers <= most_sent:
        scored = _sent(rows, asked.toArrow(), k, schema)
    else:
        scored = _in_cells(rows, asked, max(rows.count(), 1), n, k, schema)
    if least is not None:
        scored = scored.filter(F.col("score") >= least)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
