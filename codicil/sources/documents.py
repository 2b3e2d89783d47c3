"""Reading documents: directory scans, upload checks, pages, evaluation datasets and run artifacts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.text import category, strip

MOST_BYTES = 50 * 1024 * 1024
#: A parser of one file: content -> texts of its pages. Raises ValueError(reason) for what it can't read.
PageParser = Callable[[bytes], list[str]]


def scan_directory(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files under root, at any depth: path, filename, category (the directory above, made safe), content, file_size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    above = F.element_at(parts, -2)
    inside = F.rtrim(F.lit(root.split("://")[-1]), F.lit("/"))
    direct = F.endswith(F.regexp_replace("path", r"/[^/]*$", ""), inside)
    return files.select(
        "path", F.element_at(parts, -1).alias("filename"), F.when(direct, F.lit("uncategorized")).otherwise(category(above)).alias("category"), "content", F.col("length").alias("file_size")
    )


def validated(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Adds error: the first check that fails, null if none does. Parsing checks come from parse_pages."""
    name = strip(F.coalesce("filename", F.lit("")))
    return files.withColumn(
        "error",
        F.when(name == "", "missing_filename")
        .when(~F.lower(name).endswith(".pdf"), "not_a_pdf")
        .when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty_file")
        .when(F.octet_length("content") > most_bytes, "too_large"),
    )


def identified(files: DataFrame) -> DataFrame:
    """Adds document_id, the hash of the content: the same file is the same document wherever it lies."""
    return files.withColumn("document_id", F.sha2("content", 256))


def storage_path(category_col: str = "category", id_col: str = "document_id", name_col: str = "filename"):
    """category/document_id-basename; directories in the file name are dropped."""
    base = F.element_at(F.split(F.replace(F.col(name_col), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.concat_ws("/", category(F.col(category_col)), F.concat_ws("-", F.col(id_col), base))


def parse_pages(files: DataFrame, parser: PageParser) -> tuple[DataFrame, DataFrame]:
    """files (document_id, filename, category, content) -> pages, and the files that the parser turned away with its reason."""
    names = ["document_id", "filename", "category", "page_number", "text", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, name, cat, content in zip(*[batch.column(c).to_pylist() for c in ("document_id", "filename", "category", "content")]):
                try:
                    texts = parser(content)
                    out += [(doc, name, cat, i, t, None) for i, t in enumerate(texts, 1)] or [(doc, name, cat, None, None, "no_pages")]
                except ValueError as e:
                    out.append((doc, name, cat, None, None, str(e) or "unreadable"))
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)], names)

    rows = files.select("document_id", "filename", "category", "content").mapInArrow(run, "document_id string, filename string, category string, page_number int, text string, error string")
    good, bad = rows.filter("error IS NULL"), rows.filter("error IS NOT NULL")
    return with_status(good.drop("error")), bad.select("document_id", "filename", "error")


def with_status(pages: DataFrame) -> DataFrame:
    """Pages of white space stay, marked no_text."""
    return pages.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("extraction_status", F.when(strip(F.col("text")) != "", "extracted").otherwise("no_text"))


def text_pages(text_rows: DataFrame, *, id_col: str, text_col: str, page_break: str = "\f") -> DataFrame:
    """Pages from whole texts: a form feed ends a page."""
    split = text_rows.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), page_break, -1)).alias("_p", "text"))
    return with_status(split.select("document_id", (F.col("_p") + 1).alias("page_number"), "text"))


def evaluation_questions(spark: SparkSession, path: str) -> DataFrame:
    """The questions of a dataset file {"metadata": .., "questions": [..]}."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("questions").alias("q")).select("q.*")


def run_id(at=None):
    return F.date_format(F.coalesce(at, F.current_timestamp()) if at is not None else F.current_timestamp(), "yyyyMMdd'T'HHmmss'Z'")


def write_run(summary: DataFrame, cases: DataFrame, root: str, name: str, manifest: dict[str, str]) -> None:
    """One directory per run under root: manifest and summary as JSON, the cases beside them."""
    told = summary.withColumns({k: F.lit(v) for k, v in manifest.items()})
    told.write.mode("overwrite").json(f"{root}/{name}/summary")
    cases.write.mode("overwrite").json(f"{root}/{name}/cases")


def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of all runs with their run id, the latest first; unreadable ones are left out."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(f"{root}/*/summary")
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)).orderBy(F.desc("run"))
