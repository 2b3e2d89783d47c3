"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source_size copies. The documents of a source are put in an
order, expected copies are prefix-summed along it, a random offset per source is added, and a document
is emitted once per integer boundary that its interval crosses. The order is by size class, so that
long and short documents are taken alike and the words taken come near the target.

The prefix sum is distributed: a document's rank is the number of documents before its cell (source,
size class, salt) plus its rank within the cell. Cells hold counts only; 256 salts split a hot source
or one size shared by many copies. No task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Carried, materialise, words_of


def size_class(size: Column) -> Column:
    """Grows with size: the number of binary digits, then the leading five of them."""
    digits = F.length(F.bin(size))
    return (digits * 64 + F.floor(size / F.pow(F.lit(2.0), F.greatest(digits - 5, F.lit(0))))).cast("long")


def md5_int(c: Column, n: int) -> Column:
    """The first n hexadecimal digits of the md5 of c as text."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), 1, n), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(_source, _total) -> also _target: weights by order of the source, capped, the excess reshared.

    One row per source goes through a single window. Sources are taken by cap / weight; those before the
    first that stays below its cap are capped, the rest share what is left by weight.
    """
    everyone, ordered = Window.orderBy("_source"), Window.orderBy("_ratio", "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(everyone) - 1) % len(weights) + 1))
    before, whole = ordered.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("_total") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.sum("_total").over(whole) * F.lit(float(share)) - F.col("_capped")) / F.col("_left"))
        .withColumn("_level", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_source", "_level"))).over(whole)["_level"])
        .select("_source", "_total", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("_target"))
    )


def mix_sources(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Returns the rows of docs with size, source_size, target, copies and taken (copies * size).

    Null text has size 0; a null source is a source of its own, last in order. Rows that are equal are
    separate documents. Documents of size 0 are dealt copies like others of their source. A source
    without words has target 0 and no copies. Columns with the names of the new ones are replaced. Documents
    that tie in size, salt and id are equal in all that is returned but columns beside; which of them is drawn is
    left open. A very long text is one row in a task's memory.
    """
    c = Carried(docs, doc=id_col, text=text_col, source=source_col)
    base = (
        c.df.withColumn("_source", F.when(c.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c.col("source").cast("string"))))
        .withColumn("_size", F.size(words_of(c.col("text"))).cast("long"))
        .withColumn("_class", size_class(F.col("_size")))
        .withColumn("_salt", md5_int(c.col("doc"), 2))
    )
    # The texts are read once for the cells' counts and once for the ranks; all between works on counts.
    cells = materialise(base.groupBy("_source", "_class", "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_sum")), "mix-cells")
    classes = cells.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    targets = source_targets(classes.groupBy("_source").agg(F.sum("_sum").alias("_total")), weights, share, cap)
    up_to = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = (
        cells.withColumn("_inner", up_to(Window.partitionBy("_source", "_class").orderBy("_salt")))
        .select("_source", "_class", "_salt", "_inner")
        .join(classes.withColumn("_outer", up_to(Window.partitionBy("_source").orderBy("_class"))).select("_source", "_class", "_outer"), ["_source", "_class"])
        .join(targets, "_source")
        .select("_source", "_class", "_salt", (F.col("_inner") + F.col("_outer")).alias("_start"), "_total", "_target")
    )
    rank = F.row_number().over(Window.partitionBy("_source", "_class", "_salt").orderBy("_size", c.col("doc")))
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    ranked = base.withColumn("_rank", rank).join(starts, ["_source", "_class", "_salt"])
    at = F.col("_start") + F.col("_rank")
    offset = md5_int(F.col("_source"), 3) / F.lit(4096.0)
    copies = F.floor(at * rate + offset) - F.floor((at - 1) * rate + offset)
    return c.restore(
        ranked.withColumn("_copies", copies.cast("long")),
        {
            "size": F.col("_size"),
            "source_size": F.col("_total"),
            "target": F.col("_target"),
            "copies": F.col("_copies"),
            "taken": F.col("_copies") * F.col("_size"),
        },
    )


def emit_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each document of mix_sources as often as it was drawn, with the given columns, whatever their names."""
    names = [f"_o{i}" for i in range(len(columns))]
    copies = mixed.filter(F.col("copies") > 0).select(*[F.col(f"`{x}`").alias(n) for x, n in zip(columns, names)], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n"))
    return copies.select(*names).toDF(*columns)
