"""Scans, checks, catalogs, stores, embeddings and continuous ingest."""

import json

import pytest
from pyspark.sql import functions as F

from codicil.sources import catalog, documents, embedding
from codicil.streaming import ingest


def test_directory_scan(spark, tmp_path):
    for path, content in (("a.pdf", b"one"), ("deeds?/b.pdf", b"two\ftwo"), ("x/y/c.PDF", b"three"), ("x/d.txt", b"no"), ("x/y/e.pdf", b"four")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    files = documents.identified(documents.validated(documents.scan_directory(spark, str(tmp_path))))
    rows = {r["filename"]: (r["category"], r["error"]) for r in files.collect()}
    assert rows == {"a.pdf": ("uncategorized", None), "b.pdf": (rows["b.pdf"][0], None), "e.pdf": ("y", None)}

    def parse(content):
        if content == b"one":
            raise ValueError("encrypted")
        return content.decode().split("\f")

    pages, bad = documents.parse_pages(files.filter("error IS NULL AND filename <> 'e.pdf'"), parse)
    assert [(r["page_number"], r["text"], r["extraction_status"]) for r in pages.orderBy("page_number").collect()] == [(1, "two", "extracted"), (2, "two", "extracted")]
    assert [(r["filename"], r["error"]) for r in bad.collect()] == [("a.pdf", "encrypted")]


def test_upload_checks(spark):
    rows = spark.createDataFrame([(" ", b"x"), ("a.txt", b"x"), ("a.Pdf", b""), ("a.Pdf", b"12345"), ("a.pdf", b"x"), (None, None)], "filename string, content binary")
    assert [r["error"] for r in documents.validated(rows, most_bytes=4).collect()] == ["missing_filename", "not_a_pdf", "empty_file", "too_large", None, "missing_filename"]


def test_storage_path(spark):
    row = spark.createDataFrame([("x/y", "id", "..\\evil/../n.pdf")], "category string, document_id string, filename string")
    assert row.select(documents.storage_path().alias("p")).first()["p"] == "x_y/id-n.pdf"


def test_blank_pages_stay(spark):
    out = documents.text_pages(spark.createDataFrame([("d", "a\f \fb"), ("e", None)], "id string, t string"), id_col="id", text_col="t").orderBy("document_id", "page_number").collect()
    assert [(r["document_id"], r["page_number"], r["extraction_status"]) for r in out] == [("d", 1, "extracted"), ("d", 2, "no_text"), ("d", 3, "extracted"), ("e", 1, "no_text")]


def test_datasets_and_runs(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"metadata": {"version": "1"}, "questions": [{"id": "1", "question": "why"}, {"id": "2", "question": "how"}]}))
    assert documents.evaluation_questions(spark, str(tmp_path / "q.json")).count() == 2
    summary, cases = spark.createDataFrame([(0.5,)], "recall double"), spark.createDataFrame([("1", True)], "id string, ok boolean")
    for name in ("20260101T000000Z", "20260201T000000Z"):
        documents.write_run(summary, cases, str(tmp_path / "runs"), name, {"model": "none"})
    assert [r["run"] for r in documents.list_runs(spark, str(tmp_path / "runs")).collect()] == ["20260201T000000Z", "20260101T000000Z"]


def test_upsert_and_delete(spark):
    now = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "document_id string, v int")
    assert sorted(map(tuple, catalog.upsert(now, new, "document_id").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    left, gone = catalog.delete(now, spark.createDataFrame([("b",), ("x",)], "document_id string"))
    assert left.count() == 1 and {r["document_id"]: r["deleted"] for r in gone.collect()} == {"b": 1, "x": 0}
    again = catalog.replace_document(spark.createDataFrame([("a:0", "a"), ("a:1", "a")], "chunk_id string, document_id string"), spark.createDataFrame([("a:0", "a")], "chunk_id string, document_id string"))
    assert again.count() == 1  # no chunk of the earlier cut stays
    seen = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "document_id string, at int, v string")
    assert catalog.latest(seen, "document_id", "at").first()["v"] == "new"


def test_cases(spark):
    cases = spark.createDataFrame([("k", "name"), ("e", "empty")], "case_id string, name string")
    links = spark.createDataFrame([("k", "d1")], "case_id string, document_id string")
    links, unknown = catalog.add_to_case(links, cases, spark.createDataFrame([("k", "d1"), ("k", "d2"), ("z", "d1")], "case_id string, document_id string"))
    assert links.count() == 2 and unknown.first()["case_id"] == "z"
    assert {r["case_id"]: r["document_ids"] for r in catalog.case_list(cases, links).collect()} == {"k": ["d1", "d2"], "e": []}
    assert catalog.remove_from_case(links, links.filter("document_id = 'd1'")).count() == 1
    asked = spark.createDataFrame([(1, "k"), (2, "e"), (3, "z")], "query_id int, case_id string")
    assert {r["query_id"]: r["status"] for r in catalog.scoped(asked, cases, links).collect()} == {1: "searched", 2: "empty_case", 3: "unknown_case"}


def test_vector_table(spark, tmp_path):
    store = catalog.VectorTable(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("c1", "d1", [1.0, 0.0]), ("c1", "d1", [1.0, 0.0]), ("c2", "d2", [0.0, 1.0])], "chunk_id string, document_id string, vector array<double>")
    store.write(rows, "legal", 2)
    store.write(rows.limit(1), "recursive", 2)
    assert store.read("legal").count() == 2 and store.read("recursive").count() == 1
    assert "vector" not in store.export("legal").columns
    assert store.get("legal", "c2").first()["document_id"] == "d2"
    assert [r[0] for r in store.document_ids("legal").collect()] == ["d1", "d2"]
    with pytest.raises(Exception, match="length 2"):
        store.write(rows, "legal", 3)
    plan = store.export("legal")._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan.split("ReadSchema")[1] and "PartitionFilters" in plan


def test_embedding(spark):
    rows = spark.createDataFrame([("Pay the fee",), ("End it",)], "text string")

    def load():
        return lambda texts: [[float(len(x)), 0.0, 1.0] for x in texts]

    out = embedding.embed(rows, load, dim=3, prefix=embedding.QUERY_PREFIX).select(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert [r["n"] for r in out] == [pytest.approx(1.0)] * 2
    with pytest.raises(Exception, match="blank"):
        embedding.embed(spark.createDataFrame([(" ",)], "text string"), load, dim=3).collect()
    with pytest.raises(Exception, match="length 4"):
        embedding.embed(rows, load, dim=4).collect()
    a, b = (r["v"] for r in rows.select(embedding.hashed_vector(F.col("text"), 16).alias("v")).collect())
    assert len(a) == 16 and a != b and sum(x * x for x in a) == pytest.approx(1.0)


def test_continuous_ingest(spark, tmp_path):
    inbox, target, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    inbox.mkdir()

    def drop(name, *rows):
        (inbox / name).write_text("\n".join(json.dumps({"document_id": d, "page_number": p, "text": t}) for d, p, t in rows))

    def run():
        ingest.ingest(ingest.page_stream(spark, str(inbox)), target, mark, size=40, overlap=0).awaitTermination()
        return {r["chunk_id"]: r["text"] for r in ingest.current_chunks(spark, target).collect()}

    drop("1.json", ("a", 1, "First text of a. It goes on for a while. And more of it."), ("b", 1, "Text of b."))
    first = run()
    assert len([k for k in first if k.startswith("a:")]) == 2 and first["b:0000"] == "Text of b."
    drop("2.json", ("a", 1, "Short now."))
    assert run() == {"a:0000": "Short now.", "b:0000": "Text of b."}
    assert run() == {"a:0000": "Short now.", "b:0000": "Text of b."}  # nothing new


def test_the_last_of_repeated_keys_stays(spark):
    from codicil.sources import catalog

    schema = "document_id string, title string"
    old = spark.createDataFrame([("a", "old"), ("b", "kept")], schema)
    new = spark.createDataFrame([("a", "first"), ("c", "one"), ("a", "second"), ("a", "third"), ("c", "two")], schema)
    assert {tuple(r) for r in catalog.upsert(old, new, "document_id").collect()} == {("a", "third"), ("b", "kept"), ("c", "two")}
