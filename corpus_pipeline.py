"""The corpus pipeline: raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir) whose result is written as Parquet and read again as
the next stage's docs. All stages but the last return the columns of documents, in their order, whatever
they are; an empty table passes through. Nulls, very long texts, ties and repeated rows are taken as the
operators take them: a null text is empty, a row that comes twice is two documents of one id, of which the
near-dedup stage keeps both (they are one document to it), and a document without an id stays only where no
other of its group has one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.common import materialise, small_batches
from codicil.llm.line_dedup import drop_repeated_lines
from codicil.llm.minhash import near_duplicates
from codicil.llm.mixing import emit_copies, mix_sources
from codicil.llm.packing import pack_documents
from codicil.llm.quality import score_quality
from codicil.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.7 go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs, labels, threshold=0.7).filter("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three or more documents share stay in one document; n_chars follows the text."""
    kept = drop_repeated_lines(docs, min_chars=20, min_docs=3).select(docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8 or more) stays, that with the smallest id."""
    small_batches(spark)
    return near_duplicates(docs, percent=80, k=5).filter("kept").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them."""
    return emit_copies(mix_sources(docs, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, placed into windows of 2048."""
    return pack_documents(docs, tokenizer_path=tokenizer_path(), window=2048, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash near-dedup", minhash_near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage learns a model, which SQL can't express; tests/llm/test_pipeline.py does all stages again in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
