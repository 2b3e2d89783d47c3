"""Connected components by alternating large-star and small-star rounds over DataFrames.

Links never leave the executors; each round's links are written to the shared folder, which cuts the
lineage. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Undirected links (a, b) -> (node, component): component is the smallest node that links reach.

    Self links, repeated links and null ends do no harm; nodes without a link to another node are left out.
    """
    now = materialise(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "links",
    )
    seen = None
    for _ in range(most_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        # Large star: each node's larger neighbours go to the smallest of its neighbours and itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter(F.col("u") != F.col("v"))
            .distinct()
        )
        now = materialise(small, "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
