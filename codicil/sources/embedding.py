"""Embedding providers: an injected function over batches of texts, and a deterministic stand-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.text import strip, tokens

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
#: Gives the function that embeds a batch; called once per task.
Loader = Callable[[], Callable[[list[str]], list[list[float]]]]


def embed(texts: DataFrame, load: Loader, *, text_col: str = "text", dim: int, prefix: str = "") -> DataFrame:
    """Adds vector, of length one. Blank texts and vectors of another length raise."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            if batch.isna().any() or (batch.str.strip() == "").any():
                raise ValueError("a text to embed is blank")
            out = [np.asarray(v, float) for v in model((prefix + batch).tolist())]
            if len(out) != len(batch) or any(len(v) != dim for v in out):
                raise ValueError(f"the model did not give one vector of length {dim} a text")
            norms = [np.sqrt((v * v).sum()) for v in out]
            yield pd.Series([(v / n if n else v).tolist() for v, n in zip(out, norms)])

    return texts.withColumn("vector", run(F.col(text_col)))


def hashed_vector(text: Column, dim: int = 64) -> Column:
    """A stand-in without a model: signed counts of hashed tokens, of length one, computed in the JVM."""
    hashes = F.transform(tokens(text), lambda t: F.xxhash64(t))
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: F.aggregate(hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dim)) == i, F.when(h < 0, -1.0).otherwise(1.0)).otherwise(0.0)),
    )
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def embeddable(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    return chunks.filter(strip(F.coalesce(F.col(text_col), F.lit(""))) != "")
