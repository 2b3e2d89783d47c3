"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

from codicil.llm.emb_dedup import near_vectors
from codicil.llm.hmm import score_documents
from codicil.llm.kd_shards import shard_documents
from codicil.llm.line_dedup import drop_repeated_lines
from codicil.llm.minhash import near_duplicates
from codicil.llm.mixing import emit_copies, mix_sources
from codicil.llm.packing import pack_documents
from codicil.llm.quality import score_quality
from codicil.llm.quality_rules import judge_documents
from codicil.llm.queries import tokenizer_path
from codicil.llm.secret_scan import scan_secrets

LONG = "word and word again " * 20_000
SHARED = "This line stands in many documents, word for word."
ROWS = [
    (1, "a short text", "en", "s1"),
    (2, None, "en", "s1"),
    (3, "", None, "s2"),
    (4, "   \n\t ", "de", None),
    (5, SHARED + "\nown line five", "en", "s1"),
    (6, SHARED.upper() + "  \nown line six", "en", "s1"),
    (7, "  " + SHARED + "\nown line seven\n", None, None),
    (7, "  " + SHARED + "\nown line seven\n", None, None),  # a repeated row
    (8, LONG, "en", "s2"),
    (None, "no id but text of five words", "en", "s2"),
    (9, "no id but text of five words", "fr", "s2"),
    (10, 'token = "abcdef123456" é', "fr", "s2"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Columns that the operators themselves use or return.
CLASH = ("n_lines", "size", "taken", "copies", "score", "kept", "shard", "component_id", "_text", "_doc", "_mark", "_c0", "_key", "_node", "word", "distance")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def labels(spark, n=0):
    return spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")


RUNS = {
    "line_dedup": drop_repeated_lines,
    "mixing": mix_sources,
    "quality": lambda d: score_quality(d, labels(d.sparkSession, 10)),
    "unlabelled": lambda d: score_quality(d, labels(d.sparkSession)),
    "sharding": shard_documents,
    "secrets": scan_secrets,
    "rules": judge_documents,
    "lm": score_documents,
    "minhash": near_duplicates,
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_comes_back(docs, name):
    out = RUNS[name](docs)
    assert out.count() == len(ROWS)
    assert len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(empty, name):
    assert RUNS[name](empty).count() == 0


@pytest.mark.parametrize("sent", [0, 1000])
def test_lines_with_keys_sent_or_joined(docs, sent, monkeypatch):
    from codicil.llm import line_dedup

    monkeypatch.setattr(line_dedup, "SENT_ROWS", sent)
    out = by_id(drop_repeated_lines(docs))
    assert [out[i]["n_dropped"] for i in (5, 6, 7)] == [1, 1, 0]


def test_pipeline_edges(spark, docs, empty, tmp_path):
    """Nulls, repeated rows, a long text and columns of the operators' names; every stage takes and returns them, an empty table too."""
    import corpus_pipeline as p

    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")  # without any label all documents pass the first stage
    for some in (docs, empty):
        now = some
        for name, stage in p.STAGES:
            out = stage(spark, now, str(tmp_path))
            if name != "packing":
                assert out.columns == now.columns, name
                now = out.cache()
            assert (out.count() > 0) == (some is docs), name
        if some is docs:
            pieces = {r["doc_id"]: r["doc_tokens"] for r in out.collect()}
            assert max(pieces.values()) > 80_000 and None not in pieces  # a null id gives way to the same text under an id


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_lines(docs):
    out = by_id(drop_repeated_lines(docs))
    assert out[5]["text"] == "own line five" and out[5]["n_dropped"] == 1
    assert out[7]["text"] == "  " + SHARED + "\nown line seven\n" and out[7]["n_lines"] == 3  # the largest id keeps the line
    assert out[2]["text"] is None and out[2]["n_lines"] == 1
    assert out[4]["n_lines"] == 2 and out[None]["n_dropped"] == 0


def test_mix(docs):
    out = mix_sources(docs)
    rows = by_id(out)
    assert rows[2]["size"] == 0 and rows[8]["size"] == 80_000
    assert all(r["taken"] <= 2 * r["size"] for r in rows.values())
    assert emit_copies(out, ["doc_id", "text"]).count() == out.agg(F.sum("copies")).first()[0]


def test_unlabelled_keeps_everything(docs):
    assert {r["predicted"] for r in score_quality(docs, labels(docs.sparkSession)).collect()} == {1}


def test_shards(docs):
    rows = shard_documents(docs).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] in (None, 9)}) == 1  # equal texts
    assert len({r["shard"] for r in rows if r["doc_id"] in (2, 3)}) == 1  # null is as empty
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_one_document_in_many_copies(spark):
    df = spark.createDataFrame([(i, "the very same text of every row here", "en", "s") for i in range(50)], SCHEMA)
    assert shard_documents(df).select("shard").distinct().count() == 1
    out = near_duplicates(df).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_secret_spans(docs):
    out = by_id(scan_secrets(docs))
    assert out[10]["spans"].startswith("assign:0:21") and out[10]["n_assign"] == 1
    assert out[2]["spans"] == "" and out[8]["n_hex"] == 0


def test_rules(docs):
    out = by_id(judge_documents(docs))
    assert out[8]["base_failed"] and out[8]["n_repeat_words"] == 80_000
    assert out[2]["n_words"] == 0 and not out[2]["kept"]


def test_lm(docs):
    out = by_id(score_documents(docs))
    assert out[2]["n_tokens"] == 1 and out[8]["n_tokens"] == 80_001
    assert all(r["score"] < 0 for r in out.values())


def test_near(docs):
    out = by_id(near_duplicates(docs))
    assert out[9]["component_id"] == 9 and out[None]["component_id"] == 9  # a null id names nothing
    assert out[2]["n_shingles"] == 0 and out[3]["component_id"] == 3 and out[4]["n_shingles"] == 0
    assert out[1]["n_shingles"] == 1


def test_pack(docs, empty):
    pieces = pack_documents(docs, tokenizer_path=tokenizer_path()).collect()
    assert sum(r["length"] for r in pieces if r["doc_id"] == 2) == 1
    assert sum(r["length"] for r in pieces if r["doc_id"] == 8) == max(r["doc_tokens"] for r in pieces)
    assert all(len(r["ids"]) == r["length"] <= 2048 for r in pieces)
    assert pack_documents(empty, tokenizer_path=tokenizer_path()).count() == 0


def test_vectors(spark):
    up, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [
        (1, up, 0), (2, up, 0), (2, up, 0), (3, [2.0, 0.0, 0.0], 0), (4, up, 1), (5, up, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0),
        (8, [nan, 1.0, 0.0], 0), (9, [None, 1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, [], 0), (None, [0.999, 0.01, 0.0], 0),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = near_vectors(df).collect()
    told = {r["vec_id"]: r for r in out}
    assert len(out) == len(rows)
    assert told[1]["n_links"] == 4 and told[2]["component_id"] == 1 and told[3]["component_id"] == 1 and told[None]["component_id"] == 1
    assert all(told[i]["n_links"] == 0 and told[i]["component_id"] == i for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert near_vectors(df.limit(0)).count() == 0
