"""Catalogs and stores as tables: documents, cases, vector records. All changes are joins that give a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str | list[str], by: str) -> DataFrame:
    """One row per key, the one with the greatest ``by``."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def last_of(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, the last in the order in which the rows are read."""
    return latest(rows.withColumn("_at", F.monotonically_increasing_id()), key, "_at").drop("_at")


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new replaces what has its keys; of rows of new that share a key the last stays."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(last_of(new, key), allowMissingColumns=True)


def delete(current: DataFrame, keys: DataFrame, key: str = "document_id") -> tuple[DataFrame, DataFrame]:
    """What is left, and per key how many rows went."""
    gone = keys.select(key).distinct()
    counts = gone.join(current.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, "left").select(key, F.coalesce("_n", F.lit(0)).alias("deleted"))
    return current.join(gone, key, "left_anti"), counts


def replace_document(current: DataFrame, chunks: DataFrame) -> DataFrame:
    """All chunks of the new documents replace all that were there, so none of an earlier cut stays behind."""
    return delete(current, chunks)[0].unionByName(chunks, allowMissingColumns=True)


# ---- cases


def add_to_case(links: DataFrame, cases: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and new (case_id, document_id) -> links with the new ones, each once; and those of unknown cases."""
    known = new.join(cases.select("case_id"), "case_id", "left_semi")
    return links.unionByName(known.select(*links.columns)).dropDuplicates(["case_id", "document_id"]), new.join(cases.select("case_id"), "case_id", "left_anti")


def remove_from_case(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone, ["case_id", "document_id"], "left_anti")


def case_list(cases: DataFrame, links: DataFrame) -> DataFrame:
    """Cases with their documents, sorted."""
    docs = links.groupBy("case_id").agg(F.sort_array(F.collect_set("document_id")).alias("document_ids"))
    return cases.join(docs, "case_id", "left").withColumn("document_ids", F.coalesce("document_ids", F.array().cast(docs.schema["document_ids"].dataType)))


def scoped(queries: DataFrame, cases: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, case_id) -> (query_id, status, documents): unknown and empty cases are refused, never searched without a scope."""
    n = links.groupBy("case_id").agg(F.countDistinct("document_id").alias("_n"))
    known = cases.select("case_id", F.lit(True).alias("_known"))
    return queries.join(known, "case_id", "left").join(n, "case_id", "left").select(
        "query_id", "case_id",
        F.when(F.col("_known").isNull(), "unknown_case").when(F.coalesce("_n", F.lit(0)) == 0, "empty_case").otherwise("searched").alias("status"),
        F.when(F.col("_known"), F.coalesce("_n", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("documents"),
    )


# ---- vector records


class VectorTable:
    """Chunk vectors in Parquet, a directory for each chunking method, so that a method is read without the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, records: DataFrame, method: str, dim: int) -> None:
        """Replaces the method's index. Vectors of another length fail the write."""
        checked = records.withColumn("vector", F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of length "), F.size("vector").cast("string")))))
        last_of(checked, "chunk_id").withColumn("chunking_method", F.lit(method)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunking_method").parquet(self.path)

    def read(self, method: str) -> DataFrame:
        return self.spark.read.parquet(self.path).filter(F.col("chunking_method") == method).drop("chunking_method")

    def export(self, method: str) -> DataFrame:
        """All but the vectors, which are then not read."""
        return self.read(method).drop("vector")

    def get(self, method: str, chunk_id: str) -> DataFrame:
        return self.read(method).filter(F.col("chunk_id") == chunk_id)

    def document_ids(self, method: str) -> DataFrame:
        return self.read(method).select("document_id").distinct().orderBy("document_id")
