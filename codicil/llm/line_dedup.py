"""Line dedup, DataFrame functions only.

Lines are exploded and normalised, a 128-bit hash stands for each key, distinct documents are counted
per hash, and the lines of frequent keys go, except in the largest doc_id that holds the key. Only
hashes and positions are shuffled for the counts; the texts move once, when each document meets the
positions of its dropped lines.

Skew: the count is a two-step partial aggregate (by key and document, then by key). Frequent keys are written
as a table; if it has few rows it is sent to all tasks and the lines are not shuffled for it, else lines and
table meet in an equi join of two plain tables, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE_CHARS, Carried, ascii_lower, bounded, materialise

#: Frequent keys (24 bytes each) that are sent to all tasks.
SENT_ROWS = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE_CHARS)))


def drop_repeated_lines(
    docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Returns the rows of docs with the kept text, n_lines (before), n_dropped.

    Null text counts as one empty line and stays null. A null doc_id is one unnamed document, smaller
    than any other. Rows that share a doc_id count as one document; each row comes back. An empty table
    gives an empty table. Columns called n_lines or n_dropped are replaced. A very long text is one row in a
    task's memory, with its lines. Of a line that repeats in its document all occurrences go or stay, so there are no ties.
    """
    c = Carried(docs, doc=id_col, text=text_col)
    text = F.coalesce(c.col("text"), F.lit(""))
    # doc_id and the text's hash name a row: rows equal in both get equal decisions.
    base = c.df.withColumn("_mark", F.xxhash64(text))
    lines = (
        base.select(c.col("doc").alias("_doc"), "_mark", F.posexplode(F.split(text, "\n", -1)).alias("_pos", "_line"))
        .select("_doc", "_mark", "_pos", line_key(F.col("_line")).alias("_key"))
        .filter(F.char_length("_key") >= min_chars)
        .select("_doc", "_mark", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    )
    frequent = materialise(
        lines.select("_h1", "_h2", "_doc")
        .distinct()
        .groupBy("_h1", "_h2")
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_doc").alias("_keep"))
        .filter(F.col("_n") >= min_docs)
        .drop("_n"),
        "frequent-lines",
    )
    # In pos order, true for each line that stays and false for each that goes; lines after the last drop are left out.
    gone = (
        lines.join(bounded(frequent, SENT_ROWS), ["_h1", "_h2"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_keep")))
        .groupBy("_doc", "_mark")
        .agg(F.sort_array(F.collect_set("_pos")).alias("_gone"))
        .withColumn("_before", F.concat(F.array(F.lit(-1)), F.expr("slice(_gone, 1, size(_gone) - 1)")))
        .select(
            F.col("_doc").alias("_gdoc"),
            F.col("_mark").alias("_gmark"),
            F.size("_gone").alias("_ngone"),
            F.flatten(
                F.zip_with(
                    "_before", "_gone", lambda a, b: F.concat(F.array_repeat(F.lit(True), b - a - 1), F.array(F.lit(False)))
                )
            ).alias("_mask"),
        )
    )
    joined = base.join(gone, c.col("doc").eqNullSafe(F.col("_gdoc")) & (F.col("_mark") == F.col("_gmark")), "left")
    kept = F.array_join(
        F.filter(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.get(F.col("_mask"), i), F.lit(True))), "\n"
    )
    return c.restore(
        joined,
        {
            "n_lines": F.size(F.split(text, "\n", -1)).cast("long"),
            "n_dropped": F.coalesce(F.col("_ngone"), F.lit(0)).cast("long"),
        },
        {"text": F.when(F.col("_mask").isNull(), c.col("text")).otherwise(kept)},
    )
