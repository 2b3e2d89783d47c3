"""Facts that the operators must hold, on small authored inputs."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from codicil.functions import sections, similarity
from codicil.functions import text as t
from codicil.operators import bm25, chunking, evaluation, extraction, fusion, generation, knn, queries, rerank, retrieve, structure
from codicil.settings import Settings


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Section 12.4 of ERR-4821, a ISO-27001.", ["section", "12.4", "of", "err-4821", "iso-27001"]),
        (None, []),
        ("Über_all x", ["über_all"]),
    ],
)
def test_tokens(spark, text, want):
    assert one(spark, t.tokens(F.col("a")), a=text) == want


@pytest.mark.parametrize(
    ("section", "want"),
    [
        ("2", ("2", None, None, ["2"])),
        ("2(D)(II)", ("2", "d", "ii", ["2", "d", "ii"])),
        ("10A", ("10A", None, None, ["10A"])),
        ("FRONTMATTER:PREAMBLE", ("FRONTMATTER:PREAMBLE", None, None, ["FRONTMATTER:PREAMBLE"])),
        ("", (None, None, None, [])),
        (None, (None, None, None, [])),
    ],
)
def test_sections(spark, section, want):
    assert tuple(one(spark, sections.parsed(F.col("a")), a=section)) == want


def test_text_functions(spark):
    assert one(spark, t.normalized(F.col("a")), a=" “It’s” –\n ok ") == "\"it's\" - ok"
    assert one(spark, t.span_matches(F.col("a"), F.col("b")), a="The  CAT sat", b="cat sat") is True
    assert one(spark, t.span_matches(F.col("a"), F.col("b")), a="The", b="") is False
    assert one(spark, t.sentences(F.col("a")), a="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, t.lines(F.col("a")), a="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, t.lines(F.col("a")), a="") == []
    assert one(spark, t.category(F.col("a")), a="../x?y ") == "_x_y"
    assert one(spark, t.category(F.col("a")), a=" .. ") == "uncategorized"
    assert one(spark, t.actor_name(F.col("a")), a="the  SENIOR partner") == "Senior Partner"
    assert one(spark, t.source_numbers(F.col("a")), a="[SOURCE_2] [SOURCE_10] SOURCE_3") == ["2", "10"]
    assert one(spark, t.json_anchors(F.col("a")), a='Sure: ["a b", "c"] done') == ["a b", "c"]
    assert one(spark, t.json_anchors(F.col("a")), a='["a", " "]') is None
    assert one(spark, similarity.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0.0


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, text string")


def test_bm25_prefers_the_identifier_and_counts_all_chunks(spark):
    rows = [(f"c{i}", f"filler text number {i}") for i in range(5)] + [("hit", "see clause ABC-2026-0042 here"), ("none", "!!!")]
    index = bm25.build(chunks(spark, rows + [rows[0]]))
    assert bm25.index_stats(index).first()["chunks"] == 7
    q = spark.createDataFrame([("q", "ABC-2026-0042"), ("r", "nothing known")], "query_id string, query string")
    found = bm25.search(index, q, 3).collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"]) for r in found] == [("q", "hit", 1)]
    assert bm25.search(index, q, 0).count() == 0


def test_repeated_query_tokens_count(spark):
    index = bm25.build(chunks(spark, [("a", "red blue"), ("b", "green")]))
    q = spark.createDataFrame([(1, "red"), (2, "red red")], "query_id int, query string")
    s = {r["query_id"]: r["score"] for r in bm25.score(index, q).collect()}
    assert s[2] == pytest.approx(2 * s[1], abs=2e-6)


def test_a_saved_index_finds_the_same(spark, tmp_path):
    rng = random.Random(3)
    words = ["red", "blue", "green", "a1", "b-2", "of", "the"]
    rows = chunks(spark, [(f"c{i}", " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(60)] + [("null", None)])
    q = spark.createDataFrame([(1, "red the"), (2, "b-2 of of"), (3, "absent"), (4, "")], "query_id int, query string")
    built = bm25.build(rows, unique=True)
    built.save(str(tmp_path / "ix"), parts=4)
    saved = bm25.load(spark, str(tmp_path / "ix"))
    scope = rows.filter("chunk_id > 'c3'")
    for kept in (None, scope):
        want = sorted(map(tuple, bm25.search(built, q, 7, scope=kept).collect()))
        assert want and sorted(map(tuple, bm25.search(saved, q, 7, scope=kept).collect())) == want
    assert bm25.index_stats(saved).first() == bm25.index_stats(built).first()
    bm25.build(rows.limit(0)).save(str(tmp_path / "none"))
    assert bm25.search(bm25.load(spark, str(tmp_path / "none")), q, 7).count() == 0


def test_knn_blocks_agree_with_the_join(spark):
    rng = random.Random(1)
    v = [(f"c{i:03d}", [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(80)] + [("odd", [1.0]), ("zero", [0.0] * 4)]
    rows = spark.createDataFrame(v, "chunk_id string, vector array<double>")
    q = spark.createDataFrame([(i, v[i][1]) for i in range(7)] + [(9, [0.0] * 4)], "query_id int, vector array<double>")
    a = knn.block_top_k(rows, q, 5).select("query_id", "chunk_id", "score", "rank")
    b = bm25.top_k(knn.score(rows, q), 5).select("query_id", "chunk_id", "score", "rank")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    none = rows.limit(0)
    assert knn.block_top_k(rows, q, 5, scope=none).count() == 0  # an empty scope finds nothing
    assert knn.block_top_k(rows, q, 0).count() == 0


def test_knn_in_cells_and_over_small_batches(spark, monkeypatch):
    rng = random.Random(2)
    v = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(200)] + [(900, [1.0, None, 0.0, 0.0]), (901, None), (902, [])]
    rows = spark.createDataFrame(v, "chunk_id int, vector array<double>")
    q = spark.createDataFrame([(f"q{i:02d}", v[i][1]) for i in range(30)] + [("none", None)], "query_id string, vector array<double>")
    want = sorted(map(tuple, bm25.top_k(knn.score(rows.filter("chunk_id < 900"), q), 7).select("query_id", "chunk_id", "score", "rank").collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)  # the best are kept over batches, not by batch
    try:
        sent = knn.block_top_k(rows.coalesce(1), q, 7)
        assert sorted(map(tuple, sent.collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    monkeypatch.setattr(knn, "BLOCK", 8)
    monkeypatch.setattr(knn, "CELL", 50)
    assert sorted(map(tuple, knn.block_top_k(rows, q, 7, most_sent=0).collect())) == want


def ranked(spark, rows):
    return spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")


def test_fusion_and_gate(spark):
    dense = ranked(spark, [(1, "a", 0.9, 1), (1, "b", 0.3, 2)])
    sparse = ranked(spark, [(1, "b", 7.0, 1), (1, "c", 3.5, 2)])
    rrf = fusion.fuse(dense, sparse, 3)
    assert [r["chunk_id"] for r in rrf.orderBy("rank").collect()] == ["b", "a", "c"]
    mean = {r["chunk_id"]: r["score"] for r in fusion.fuse(dense, sparse, 3, strategy="simple_average").collect()}
    assert mean == {"a": 0.5, "b": pytest.approx(0.5 / 3 + 0.5, abs=1e-6), "c": 0.25}
    gated = fusion.gate(rrf, 0.35).collect()
    assert [(r["chunk_id"], r["rank"]) for r in gated] == [("a", 1)]  # c has no dense score, b too low a one
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    assert {(r["query_id"], r["refused"]) for r in fusion.refusals(asked, rrf).collect()} == {(1, False), (2, True)}
    with pytest.raises(ValueError):
        fusion.fuse(dense, sparse, 3, strategy="best")


def test_rerank_keeps_order_of_equals(spark):
    rows = spark.createDataFrame(
        [(1, "give notice now", "a", "nothing here", 0.9, 1), (1, "give notice now", "b", "a notice. was sent", 0.8, 2), (1, "give notice now", "c", "notice notice give", 0.7, 3)],
        "query_id int, query string, chunk_id string, text string, score double, rank int",
    )
    out = rerank.rerank(rows, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["c", "a", "b"]  # "notice." is not the word notice
    assert out[0]["score"] == pytest.approx((1 + 1 + 0.5 / 3) / 3, abs=1e-6)
    assert [r["chunk_id"] for r in rerank.rerank(rows, 2, method="none").orderBy("rank").collect()] == ["a", "b"]


def test_overfetch_can_leave_fewer(spark):
    rows = ranked(spark, [(1, f"c{i}", 1.0 - i / 100, 0) for i in range(20)])
    out = rerank.overfetch_filter(rows, 2, F.col("chunk_id").isin("c3", "c9", "c15"), factor=4)
    assert [(r["chunk_id"], r["rank"]) for r in out.collect()] == [("c3", 1)]


def test_requests_are_checked(spark):
    for blank in (None, "", " \t\n"):
        with pytest.raises(retrieve.BlankQuery):
            retrieve.checked(blank)
    assert retrieve.checked("rent") == "rent"
    with pytest.raises(NotImplementedError):
        retrieve.Request(date_range=(1, 2))
    with pytest.raises(NotImplementedError, match="author, year"):
        retrieve.document_filter({"year": 1, "document_ids": [], "author": 2})
    assert retrieve.document_filter(None) is None and retrieve.document_filter({"document_ids": []}) == []
    batch = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "query_id int, query string")
    assert [r["query_id"] for r in retrieve.answerable(batch).collect()] == [1]


def test_dense_retriever_filters_after_the_fetch(spark):
    rows = spark.createDataFrame([(f"c{i}", f"d{i % 2}", "x" if i < 8 else "y", "the rent", None, [1.0, float(i)]) for i in range(12)], "chunk_id string, document_id string, category string, text string, section string, vector array<double>")
    q = spark.createDataFrame([(1, "rent", [1.0, 0.0]), (2, "", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    run = lambda **kw: [r["chunk_id"] for r in retrieve.dense(rows, q, retrieve.Request(2, **kw), least=0.1).orderBy("rank").collect()]
    assert run() == ["c0", "c1"]
    assert run(document_ids=("d1",)) == ["c1", "c3"]
    assert run(categories=("y",)) == []  # beyond the eight that are fetched
    assert [r["chunk_id"] for r in retrieve.dense(rows, q, retrieve.Request(5), least=0.6).collect()] == ["c0", "c1"]


def test_settings():
    assert Settings.from_env({}) == Settings()
    told = Settings.from_env({"SIMILARITY_THRESHOLD": "0.5", "RECURSIVE_CHUNK_SIZE": "900", "DEEPSEEK_API_KEY": " key "})
    assert (told.similarity_threshold, told.chunk_size, told.api_key) == (0.5, 900, "key") and "key " not in repr(told)
    with pytest.raises(ValueError, match="LLM_CHUNKER_WINDOW_PAGES"):
        Settings.from_env({"LLM_CHUNKER_WINDOW_PAGES": "three"})


def test_metrics(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = spark.createDataFrame([(1, c, i) for i, c in enumerate("1xx5x", 1)] + [(2, "z", 1)], "query_id int, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, "1"), (1, "2"), (1, "3")], "query_id int, chunk_id string")
    m = {(r["query_id"], r["k"]): r for r in evaluation.metrics_at(q, got, rel, (5,)).collect()}
    assert m[1, 5]["recall"] == pytest.approx(1 / 3, abs=1e-6) and m[1, 5]["precision"] == 0.2 and m[1, 5]["first_relevant_rank"] == 1
    assert m[2, 5]["recall"] == 1.0 and m[2, 5]["ndcg"] == 1.0 and m[2, 5]["first_relevant_rank"] is None  # nothing is relevant


def test_ground_truth_is_the_whole_index(spark):
    raw = spark.createDataFrame([("q", "a.pdf", "the rent is due ||| on Monday")], "query_id string, expected_document string, expected_answer_span string")
    rows = spark.createDataFrame([("1", "a.pdf", "The  RENT is due"), ("2", "a.pdf", "paid on monday."), ("3", "b.pdf", "the rent is due")], "chunk_id string, document_name string, text string")
    truth = evaluation.ground_truth(evaluation.parsed_questions(raw), rows)
    assert {r["chunk_id"] for r in truth.collect()} == {"1", "2"}
    typed = spark.createDataFrame([("q", "x", False), ("r", "x", False), ("s", "x", True)], "query_id string, question_type string, is_out_of_corpus boolean")
    got = spark.createDataFrame([("q", "1", 0.5, 1)], "query_id string, chunk_id string, score double, rank int")
    cases = {r["query_id"]: r for r in evaluation.score_cases(typed, got, truth).collect()}
    assert cases["q"]["recall_at_5"] == 0.5
    assert cases["r"]["recall_at_5"] == 0.0 and cases["r"]["refused"]  # no relevant chunk is no recall
    assert cases["s"]["recall_at_5"] is None
    assert evaluation.gate_rate(evaluation.score_cases(typed, got, truth), 0.35).first()["gate_rate"] == 1.0


def test_spans_everywhere_agrees_with_comparing_all(spark):
    rng = random.Random(7)
    words = ["ab", "abc", "b", "ca"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(1, 14)))) for i in range(60)]
    spans = [(i, " ".join(rng.choices(words, k=rng.randint(1, 5)))[rng.randint(0, 1) :]) for i in range(40)] + [(99, "")]
    out = evaluation.spans_everywhere(
        spark.createDataFrame(spans, "span_id int, span string"), spark.createDataFrame(texts, "chunk_id int, text string"), words_in_key=2
    )
    clean = {i: " ".join(s.split()) for i, s in spans}
    want = {(i, j) for (i, s), (j, x) in itertools.product(clean.items(), texts) if s and s in x}
    assert {(r["span_id"], r["chunk_id"]) for r in out.collect()} == want


def pages(spark, *texts):
    return spark.createDataFrame([("d", i, x) for i, x in enumerate(texts, 1)], "document_id string, page_number int, text string")


def paragraphs(spark, *texts):
    return [(r["text"], r["section"], r["heading"], r["page_number"], r["end_page_number"]) for r in structure.paragraphs(pages(spark, *texts)).orderBy("para").collect()]


def test_sub_clauses_inherit_and_titles_stand_alone(spark):
    out = paragraphs(spark, "1. DEFINITIONS\n1.1 A fee is money.\n1.2 A term is a year.\n2. TERMINATION\nIt may end.\n\n7.1 Governing Law\nThat of France.")
    assert [(s, h) for _, s, h, _, _ in out] == [("1.1", "DEFINITIONS"), ("1.2", "DEFINITIONS"), ("2", "TERMINATION"), ("7.1", "Governing Law")]


def test_chapter_and_its_title_are_one_heading(spark):
    out = paragraphs(spark, "CHAPTER I\nPRELIMINARY\n1. In this Act words have meanings\nmore")
    assert out == [("1. In this Act words have meanings\nmore", "1", "CHAPTER I PRELIMINARY", 1, 1)]


def test_paragraph_over_two_pages_and_blank_pages(spark):
    assert paragraphs(spark, "It begins\nand goes on", "to the next page.") == [("It begins\nand goes on\nto the next page.", None, None, 1, 2)]
    assert paragraphs(spark, " \n ", "") == []


def test_definition_clauses(spark):
    out = paragraphs(spark, "2(a) one is meant\n(b) two is meant\n(ii) three is meant\n3 plain\n3. Every agreement is a contract")
    assert [(s, h) for _, s, h, _, _ in out] == [("2(a)", "2(a). one is meant"), ("2(b)", "2(b). two is meant"), ("2(ii)", "2(ii). three is meant"), ("3", None)]


def test_numbered_prose_is_no_section(spark):
    out = paragraphs(spark, "1. The plaintiff came to the court and said so.\n12\n01/02/2020\nAIR 1950 SC 27")
    assert len(out) == 1 and out[0][1] is None


def test_statute_sections_keep_their_text(spark):
    out = paragraphs(spark, "15. “Coercion” defined.—It is what it is.\n19. Voidable agreements.—They may be set aside.")
    assert [(s, x[:3]) for x, s, _, _, _ in out] == [("15", "15."), ("19", "19.")]


def test_packing_of_paragraphs():
    p = [("x" * 100, 1, 1), ("y" * 90, 1, 2), ("z" * 30, 2, 2), ("w " * 200, 3, 3)]
    out = chunking.pack_paragraphs(p, target=200, most=280, least=40, overlap=10)
    assert [(a, b) for _, a, b in out] == [(1, 2), (3, 3), (3, 3)]  # the short piece is folded into the one before
    assert out[0][0] == "\n\n".join(("x" * 100, "y" * 90, "z" * 30))
    assert out[2][0].startswith("w w w w w ") and all(len(t) <= 200 + 11 for t, _, _ in out[1:])
    assert chunking.pack_paragraphs([("a" * 50, 1, 1), ("b" * 10, 1, 1)], target=55, most=280, least=40, overlap=0) == [("a" * 50 + "\n\n" + "b" * 10, 1, 1)]


def test_recursive_pieces_cover_the_text_within_the_size():
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choices(["a", "bc", " ", "\n", "\n\n", ". ", "de" * 20], k=120))
        spans = chunking.cut_points(text, 0, len(text), 40, chunking.SEPARATORS)
        assert all(b - a <= 40 for a, b in spans)
        held = sorted(i for a, b in spans for i in range(a, b))
        assert len(held) == len(set(held))
        assert all(text[i].isspace() for i in set(range(len(text))) - set(held))
    assert chunking.recursive_pieces([(1, "aaa"), (2, "bbb")], size=5, overlap=0) == [("aaa\n\n", 1, 1), ("bbb", 2, 2)]


def test_anchors():
    text = "First part  here.\nSecond “part” follows."
    assert chunking.anchored_pieces(text, ["First part here", 'second "part"']) == (["First part  here.\n", "Second “part” follows."], 0)
    assert chunking.anchored_pieces(text, []) == ([text], 0)
    assert chunking.anchored_pieces(text, ["Second", "First"]) == (["First part  here.\n", "Second “part” follows."], 1)


def test_anchors_at_lines():
    text = "It is a rent.\nRent. Rent. Rent.\n\n  a rent."
    assert chunking.anchored_pieces(text, ["It is", "Rent. Rent.", "A rent"], True) == (["It is a rent.\n", "Rent. Rent. Rent.\n\n  ", "a rent."], 0)
    assert chunking.anchored_pieces(text, ["It is", "is a"], True) == ([text], 1)


def test_semantic_query_gives_its_sql(spark, tmp_path):
    import oracle

    from codicil.plans.documents import CATALOG

    rng = random.Random(7)
    texts = ["It is a rent.\nRent. Rent. Rent.", "Hello World\nhello world", "ab\nA", "x “y” z\n\"Y\" z", "One\n" + "\n" * 60 + "Two", " " * 50 + "One\nTwo", "a b\nb" + " " * 60 + "c", "one line", "", None, "\n\n", "a\n--"]
    texts += ["".join(rng.choices(["a", "A", "ab ", " ", "\n", ".", "B", "é", "-"], k=rng.randint(1, 30))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert oracle.differences(CATALOG.queries["chunk_semantic"](spark, str(tmp_path)), oracle.connect(str(tmp_path)), CATALOG.sql["chunk_semantic"]) == []


def test_semantic_budget(spark):
    p = pages(spark, *[f"Page {i} begins here." for i in range(7)])
    good = spark.createDataFrame([("d", 0, ["Page 0 begins", "Page 1 begins"])], "document_id string, window_index int, anchors array<string>")
    kept, gone = chunking.chunk_semantic(p, good)
    assert [(r["chunk_id"], r["page_number"], r["end_page_number"]) for r in kept.orderBy("chunk_id").collect()] == [("d:0000", 1, 3), ("d:0001", 1, 3), ("d:0002", 4, 6), ("d:0003", 7, 7)]
    assert gone.count() == 0
    kept, gone = chunking.chunk_semantic(p, good.withColumn("anchors", F.array(F.lit("not there"))))
    assert kept.count() == 0 and gone.first()["skipped"] == 1


def test_chunk_methods(spark):
    with pytest.raises(ValueError):
        chunking.chunk(pages(spark, "x"), "other")
    with pytest.raises(ValueError):
        chunking.chunk(pages(spark, "x"), "llm_semantic")
    assert chunking.chunk(pages(spark, "--- !!! ---"), "recursive").count() == 0


def clause(spark, text):
    return spark.createDataFrame([("c", text)], "chunk_id string, text string")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The Buyer shall pay the sum.", [("Buyer", "pay the sum", "MUST")]),
        ("Seller should act; Agent must not.", [("Agent", "not", "MUST"), ("Seller", "act", "SHOULD")]),
        ("The firm shall provide support.", [("Firm", "provide supp", "MUST")]),  # ends need no word boundary
        ("He shall go", [("He", "go", "MUST")][:0]),  # too short an action
        ("Tenant is liable for harm.", [("Tenant", "harm", "MUST")]),
    ],
)
def test_obligations(spark, text, want):
    out = extraction.obligations(clause(spark, text)).orderBy("n").collect()
    assert [(r["actor"], r["action"], r["severity"]) for r in out] == want
    assert [r["obligation_id"] for r in out] == [f"c-ob-{i}" for i in range(len(want))]


def test_evidence_and_terms(spark):
    text = "Intro line.\nThe Agent shall tell us within 5 business days, with a late fee of 2% per week.\nThe Agent shall tell us again"
    a, b = extraction.obligations(clause(spark, text)).orderBy("n").collect()
    assert (a["line_number"], a["deadline_type"], a["deadline"], a["penalty"]) == (2, "relative", "5 business days", "2% per week")
    assert b["quote"].endswith("shall tell us again") and b["line_number"] == 3 and len(b["quote"]) <= 100 + len("The Agent shall tell us again")


def test_risk_levels(spark):
    rows = clause(spark, "Ann shall hold unlimited stock and pay fees. Bob may terminate it. Cat shall sleep well. Dan shall keep it secret within days.")
    both = extraction.both(extraction.obligations(rows), extraction.rights(rows))
    out = {r["description"]: (r["risk_level"], r["risk_categories"], r["obligation_id"]) for r in extraction.risks(both).collect()}
    assert out["Risk in: hold unlimited stock and pay fees"] == ("HIGH", ["legal", "financial"], "c-ob-0")
    assert out["Risk in: terminate it"] == ("CRITICAL", ["termination"], None)
    assert out["Risk in: sleep well"][0:2] == ("MEDIUM", ["operational"])
    assert out["Risk in: keep it secret within days"][0] == "MEDIUM"


@pytest.mark.parametrize(
    ("query", "intent"),
    [("What must the seller do?", "obligation"), ("notify them", "condition"), ("what now", "general_inquiry"), ("which one", "scope"), ("xyz", "general_inquiry")],
)
def test_intent(spark, query, intent):
    q = spark.createDataFrame([(1, query), (2, "  "), (3, None)], "query_id int, query string")
    out = queries.analyse(q).collect()
    assert len(out) == 1 and out[0]["intent"] == intent


def test_blank_query_raises_if_strict(spark):
    with pytest.raises(Exception, match="blank"):
        queries.analyse(spark.createDataFrame([(1, " ")], "query_id int, query string"), strict=True).collect()


def results(spark, *texts):
    rows = [("q", i, f"c{i}", "d", "a.pdf", 1, None, None, x, 0.5) for i, x in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "question_id string, rank int, chunk_id string, document_id string, document_name string, page_number int, section string, heading string, text string, score double")


def test_context_stops_at_the_first_that_does_not_fit(spark):
    packed = generation.pack(results(spark, "a" * 60, "b" * 200, "c"), most_chars=150)
    assert [r["chunk_id"] for r in packed.collect()] == ["c1"]
    cut = generation.pack(results(spark, "a" * 500), most_chars=150).first()["block"]
    assert len(cut) == 150 and cut.endswith("...")
    assert generation.pack(results(spark, *["x"] * 9)).count() == 6


def test_citations(spark):
    packed = generation.pack(results(spark, "x", "y"))
    a = spark.createDataFrame([("q", "[SOURCE_2] [SOURCE_1] [SOURCE_2] [SOURCE_7] [SOURCE_7]")], "question_id string, answer string")
    out = generation.citations(a, packed).orderBy("place").collect()
    assert [(r["source_id"], r["resolved"]) for r in out] == [("SOURCE_2", True), ("SOURCE_1", True), ("SOURCE_7", False), ("SOURCE_7", False)]
    asked = spark.createDataFrame([("q", "x [SOURCE_9]"), ("e", " "), ("n", "plain")], "question_id string, answer string")
    told = {r["question_id"]: r["status"] for r in generation.answer_status(asked, generation.citations(asked, packed), packed).collect()}
    assert told == {"q": "error_unresolved", "e": "refused", "n": "refused"}


def test_generate_uses_the_given_model(spark):
    packed = generation.pack(results(spark, "x"))
    prompts = generation.prompts(spark.createDataFrame([("q", "Why?")], "question_id string, question string"), generation.contexts(packed), "Answer from the sources.")
    out = generation.generate(prompts, lambda ps: [f"{len(p)} [SOURCE_1]" for p in ps]).first()
    assert out["answer"].endswith("[SOURCE_1]")
