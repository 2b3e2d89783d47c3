"""Answer contexts and citations: packing sources, rendering, prompts, resolving references."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import source_numbers, strip, truncated

REFUSAL = "I could not find sufficient information in the provided documents."


def source_block(rank: str = "rank"):
    """The text of one source as the model reads it."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[SOURCE_"), F.col(rank).cast("string"), F.lit("]")),
        F.concat(F.lit("Document: "), F.coalesce(F.nullif(F.col("document_name"), F.lit("")), F.col("document_id").cast("string"))),
        F.concat(F.lit("Chunk: "), F.col("chunk_id").cast("string")),
        line("Section/Heading: ", "heading"),
        line("Category: ", "section"),
        F.concat(F.lit("Page: "), F.col("page_number").cast("string")),
        F.lit(""),
        F.col("text"),
    )


def pack(results: DataFrame, *, most_sources: int = 6, most_chars: int = 8000) -> DataFrame:
    """Ranked results (question_id, rank, ...) -> the sources that fit, in order, with their block.

    The first source that does not fit ends the list, but the very first is cut to fit. Blank lines between
    blocks are not charged.
    """
    order = Window.partitionBy("question_id").orderBy("rank")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ranked = results.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most_sources).withColumn("block", source_block())
    used = ranked.withColumn("_used", F.sum(F.length("block")).over(upto))
    fits = used.withColumn("_fits", F.min((F.col("_used") <= most_chars).cast("int")).over(upto) == 1)
    kept = fits.filter(F.col("_fits") | (F.col("rank") == 1))
    return kept.withColumn("block", F.when(F.col("_fits"), F.col("block")).otherwise(truncated(F.col("block"), F.lit(most_chars)))).drop("_used", "_fits")


def contexts(packed: DataFrame) -> DataFrame:
    """(question_id, sources, context): the blocks of a question, a blank line between."""
    return packed.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("sources"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context")
    )


def prompts(questions: DataFrame, context: DataFrame, instructions: str) -> DataFrame:
    """(question_id, prompt): instructions, context, question. Questions without a context have none."""
    return questions.join(context, "question_id").select(
        "question_id", F.concat(F.lit(instructions.strip() + "\n\nSources:\n\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"), F.lit("\nAnswer:")).alias("prompt")
    )


def generate(asked: DataFrame, answer: Callable[[list[str]], list[str]]) -> DataFrame:
    """(question_id, prompt) -> (question_id, answer): the injected model gets the prompts of a batch."""
    kind = asked.schema["question_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("question_id"), pa.array(answer(batch.column("prompt").to_pylist()), pa.string())], ["question_id", "answer"])

    return asked.select("question_id", "prompt").mapInArrow(run, f"question_id {kind}, answer string")


def citations(answers: DataFrame, packed: DataFrame) -> DataFrame:
    """(question_id, answer) -> one row per reference that counts: place, source, resolved, chunk_id, ...

    A resolved source counts where it is named first; each unresolved reference counts.
    """
    refs = answers.select("question_id", F.posexplode(source_numbers(F.col("answer"))).alias("place", "number"))
    sources = packed.select("question_id", F.col("rank").cast("string").alias("number"), "chunk_id", "document_id", "document_name", "page_number", "section", "heading")
    met = refs.join(sources, ["question_id", "number"], "left").withColumn("resolved", F.col("chunk_id").isNotNull())
    nth = F.row_number().over(Window.partitionBy("question_id", "number").orderBy("place"))
    return met.withColumn("_nth", nth).filter(~F.col("resolved") | (F.col("_nth") == 1)).select(
        "question_id", "place", F.concat(F.lit("SOURCE_"), F.col("number")).alias("source_id"), "resolved", "chunk_id", "document_id",
        F.coalesce(F.nullif(F.col("document_name"), F.lit("")), F.when(F.col("resolved"), F.col("document_id").cast("string"))).alias("document_name"), "page_number", "section", "heading",
    )


def answer_status(answers: DataFrame, cited: DataFrame, packed: DataFrame) -> DataFrame:
    """refused (no sources), error_empty, error_unresolved (references, none of which resolves), answered."""
    counts = cited.groupBy("question_id").agg(F.count_if("resolved").alias("_ok"), F.count_if(~F.col("resolved")).alias("_lost"))
    sources = packed.groupBy("question_id").agg(F.count(F.lit(1)).alias("_sources"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    status = (
        F.when(n("_sources") == 0, "refused").when(strip(F.coalesce("answer", F.lit(""))) == "", "error_empty").when((n("_lost") > 0) & (n("_ok") == 0), "error_unresolved").otherwise("answered")
    )
    return answers.join(sources, "question_id", "left").join(counts, "question_id", "left").select(
        "question_id", status.alias("status"), n("_ok").alias("citations"), n("_lost").alias("unresolved"), F.when(status == "refused", F.lit(REFUSAL)).otherwise(F.col("answer")).alias("answer")
    )


def trace(packed: DataFrame) -> DataFrame:
    """What a caller is shown of each source: score to four places, the first hundred characters, N/A for what is missing."""
    shown = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("N/A"))
    return packed.select(
        "question_id", "rank", "chunk_id", F.format_string("%.4f", F.col("score")).alias("score"), shown("section").alias("section"), shown("heading").alias("heading"),
        F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")).alias("snippet"),
    )
