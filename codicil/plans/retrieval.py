"""Queries of the retrieval operators. A document is a chunk of its own; benchmark passages are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.text import normalized
from codicil.operators import bm25, fusion, knn, rerank, retrieve
from codicil.registry import Catalog, spread, table

CATALOG = Catalog()
K = 10
LEAST = 0.3
GATE = 0.35

# ---- SQL parts

TOKENS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_.\-]*[\p{{L}}\p{{N}}_])?'), lambda t: length(t) >= 2)"
INDEX = f"""tok AS (SELECT doc_id AS chunk_id, {TOKENS.format('text')} AS t FROM documents),
post AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM tok)"""
ASKED = f"qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM benchmark) GROUP BY ALL)"
WEIGHT = "round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6)"
SCORED = f"sc AS (SELECT query_id, chunk_id, {WEIGHT} AS score FROM post JOIN qt USING (term) JOIN df USING (term), st GROUP BY ALL)"
RANK = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)"


def cosine_sql(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


VECTORS = f"""dn AS (SELECT b.item_id AS query_id, v.vec_id AS chunk_id, {cosine_sql('v.embedding', 'q.embedding')} AS score
FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v)"""


def both_sql(least: float = LEAST) -> str:
    """d and b: the 2K best of either list; j: their full join."""
    return f"""WITH {INDEX}, {ASKED}, {SCORED}, {VECTORS},
d AS (SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} AS rank FROM dn) WHERE rank <= {2 * K} AND score >= {least}),
b AS (SELECT * FROM (SELECT query_id, chunk_id, score, {RANK} AS rank FROM sc) WHERE rank <= {2 * K}),
j AS (SELECT coalesce(d.query_id, b.query_id) AS query_id, coalesce(d.chunk_id, b.chunk_id) AS chunk_id,
 d.rank AS dense_rank, d.score AS dense_score, b.rank AS bm25_rank, b.score AS bm25_score
 FROM d FULL JOIN b ON d.query_id = b.query_id AND d.chunk_id = b.chunk_id)"""


RRF = "round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 6)"


def mean_sql(a: float, b: float) -> str:
    part = lambda c: f"CASE WHEN max({c}) OVER w > 0 THEN coalesce({c} / max({c}) OVER w, 0) ELSE 0 END"
    return f"round({a}::DOUBLE * ({part('dense_score')}) + {b}::DOUBLE * ({part('bm25_score')}), 6)"


def fused_sql(score: str, columns: str = "query_id, chunk_id, score, rank::INT AS rank, dense_rank::INT AS dense_rank, dense_score, bm25_rank::INT AS bm25_rank, bm25_score") -> str:
    return f"""{both_sql()}, s AS (SELECT *, {score} AS score FROM j WINDOW w AS (PARTITION BY query_id)),
f AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= {K})
SELECT {columns} FROM f"""


# ---- inputs


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches: every vector whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector", "label")


def question_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question has the vector of its number."""
    return questions(spark, sf_dir).join(vectors(spark, sf_dir), F.col("query_id") == F.col("chunk_id")).select("query_id", "vector")


def lists(spark: SparkSession, sf_dir: str, k: int = K) -> tuple[DataFrame, DataFrame]:
    """The dense and the BM25 list, twice as long as what is fused."""
    found = bm25.search(bm25.build(chunks(spark, sf_dir), unique=True), questions(spark, sf_dir), 2 * k)
    near = knn.block_top_k(vectors(spark, sf_dir), question_vectors(spark, sf_dir), 2 * k)
    return near.filter(F.col("score") >= LEAST), found


def _fused(spark: SparkSession, sf_dir: str, strategy: str, **weights: float) -> DataFrame:
    return fusion.fuse(*lists(spark, sf_dir), K, strategy=strategy, **weights)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


# ---- BM25


@CATALOG.add(f"WITH {INDEX} SELECT n::BIGINT AS chunks, (SELECT count(*) FROM df) AS vocabulary, round(avgdl, 6) AS avg_length FROM st")
def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.index_stats(bm25.build(chunks(spark, sf_dir), unique=True))


ONE_QUERY = "the of tion and 2.0 license"


@CATALOG.add(
    f"""WITH {INDEX}, qt AS (SELECT 0 AS query_id, unnest(['the', 'of', 'tion', 'and', '2.0', 'license']) AS term, 1 AS qtf), {SCORED}
SELECT query_id::BIGINT AS query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, {RANK} AS rank FROM sc) WHERE rank <= {K}"""
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = spark.range(1).select(F.col("id").alias("query_id"), F.lit(ONE_QUERY).alias("query"))
    return _shown(bm25.search(bm25.build(chunks(spark, sf_dir), unique=True), query, K))


@CATALOG.add(f"WITH {INDEX}, {ASKED}, {SCORED} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, {RANK} AS rank FROM sc) WHERE rank <= {K}")
def bm25_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(bm25.search(bm25.build(chunks(spark, sf_dir), unique=True), questions(spark, sf_dir), K))


@CATALOG.add(
    f"""WITH {INDEX}, {ASKED}, {SCORED} SELECT query_id, chunk_id, score, rank::INT AS rank FROM
(SELECT sc.*, {RANK} AS rank FROM sc JOIN documents ON doc_id = chunk_id WHERE lang = 'de') WHERE rank <= {K}"""
)
def bm25_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics stay those of all documents."""
    rows = chunks(spark, sf_dir)
    return _shown(bm25.search(bm25.build(rows, unique=True), questions(spark, sf_dir), K, scope=rows.filter("lang = 'de'")))


# ---- vectors

PROBES = f"""p AS (SELECT q.vec_id AS query_id, q.label AS query_label, v.vec_id AS chunk_id, v.label, {cosine_sql('v.embedding', 'q.embedding')} AS score
FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id % 50 = 0)"""


@CATALOG.add(
    f"""WITH p AS (SELECT 0 AS query_id, v.vec_id AS chunk_id, {cosine_sql('v.embedding', 'q.embedding')} AS score FROM embeddings q CROSS JOIN embeddings v WHERE q.vec_id = 0)
SELECT query_id::BIGINT AS query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, {RANK} AS rank FROM p) WHERE rank <= {K}"""
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = vectors(spark, sf_dir).filter("chunk_id = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    return _shown(bm25.top_k(knn.score(vectors(spark, sf_dir), one), K))


@CATALOG.add(f"WITH {PROBES} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, {RANK} AS rank FROM p) WHERE rank <= {K}")
def knn_multi_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(knn.block_top_k(vectors(spark, sf_dir), probes(spark, sf_dir), K))


@CATALOG.add(f"WITH {PROBES} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, {RANK} AS rank FROM p WHERE label = 3) WHERE rank <= {K}")
def knn_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return _shown(knn.block_top_k(rows, probes(spark, sf_dir), K, scope=rows.filter("label = 3")))


@CATALOG.add(f"WITH {PROBES} SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, {RANK} AS rank FROM p) WHERE rank <= {K} AND score >= {LEAST}")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(knn.block_top_k(vectors(spark, sf_dir), probes(spark, sf_dir), K, least=LEAST))


@CATALOG.add(
    f"""WITH {PROBES}, o AS (SELECT *, {RANK} AS pos FROM p), k AS (SELECT * FROM o WHERE pos <= {4 * K} AND label IN (3, 4, 5) AND score >= -1.0)
SELECT query_id, chunk_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM k) WHERE rank <= {K}"""
)
def legacy_overfetch_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label stands for the category that is filtered after the fetch."""
    near = knn.block_top_k(vectors(spark, sf_dir), probes(spark, sf_dir), 4 * K).drop("rank").join(vectors(spark, sf_dir).select("chunk_id", "label"), "chunk_id")
    return _shown(rerank.overfetch_filter(near, K, F.col("label").isin(3, 4, 5), least=-1.0))


WORDS_SQL = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"


@CATALOG.add(
    f"""WITH {INDEX}, {ASKED}, {SCORED}, r AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM sc) WHERE rank <= {K}),
x AS (SELECT r.query_id, r.chunk_id, round(r.score, 0) AS score, r.rank, lower(b.text) AS q, lower(d.text) AS t, d.source = 'src0' AS front
 FROM r JOIN benchmark b ON b.item_id = r.query_id JOIN documents d ON d.doc_id = r.chunk_id),
y AS (SELECT *, len(list_filter(list_distinct({WORDS_SQL.format('q')}), lambda w: length(w) > 3 AND contains(t, w))) AS m,
 (contains(q, 'purpose') OR contains(q, 'intent') OR contains(q, 'object') OR contains(q, 'aim') OR contains(q, 'goal') OR contains(q, 'why')) AS purpose FROM x)
SELECT query_id, chunk_id, score, m::INT AS terms_met, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN purpose AND front THEN 0 ELSE 1 END, score DESC, m DESC,
 CASE WHEN front THEN 0 ELSE 1 END, rank))::INT AS rank FROM y"""
)
def legacy_relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to whole numbers, so that the later keys decide; one source plays the front matter."""
    rows = chunks(spark, sf_dir)
    found = bm25.search(bm25.build(rows, unique=True), questions(spark, sf_dir), K).withColumn("score", F.round("score", 0))
    full = found.join(rows.select("chunk_id", "text", F.when(F.col("source") == "src0", F.lit("FRONTMATTER:PREAMBLE")).alias("section")), "chunk_id").join(questions(spark, sf_dir), "query_id")
    return rerank.by_relevance(full).select("query_id", "chunk_id", "score", "terms_met", F.col("rank").cast("int").alias("rank"))


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the vector of their number; one source plays the front matter, the language is the category."""
    rows = chunks(spark, sf_dir).join(vectors(spark, sf_dir).drop("label"), "chunk_id")
    return rows.select("chunk_id", "text", "vector", F.col("lang").alias("category"), F.when(F.col("source") == "src0", F.lit("FRONTMATTER:PREAMBLE")).alias("section"))


def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_vectors(spark, sf_dir).join(questions(spark, sf_dir), "query_id")


@CATALOG.add(
    f"""WITH dn AS (SELECT b.item_id AS query_id, v.vec_id AS chunk_id, lower(b.text) AS q, lower(d.text) AS t, d.lang, d.source = 'src0' AS front, {cosine_sql('v.embedding', 'q.embedding')} AS score
 FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE regexp_matches(b.text, '\\S')),
o AS (SELECT *, {RANK} AS pos FROM dn), x AS (SELECT * FROM o WHERE pos <= {4 * K} AND score >= 0.1 AND lang IN ('en', 'fr')),
y AS (SELECT *, len(list_filter(list_distinct({WORDS_SQL.format('q')}), lambda w: length(w) > 3 AND contains(t, w))) AS m,
 (contains(q, 'purpose') OR contains(q, 'intent') OR contains(q, 'object') OR contains(q, 'aim') OR contains(q, 'goal') OR contains(q, 'why')) AS purpose FROM x),
z AS (SELECT query_id, chunk_id, score, m::INT AS terms_met, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN purpose AND front THEN 0 ELSE 1 END, score DESC, m DESC,
 CASE WHEN front THEN 0 ELSE 1 END, pos))::INT AS rank FROM y) SELECT * FROM z WHERE rank <= {K}"""
)
def dense_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch, filter by category, threshold and relevance order in one."""
    found = retrieve.dense(embedded_chunks(spark, sf_dir), embedded_questions(spark, sf_dir), retrieve.Request(K, categories=("en", "fr")), least=0.1)
    return found.withColumn("rank", F.col("rank").cast("int"))


# ---- fusion


@CATALOG.add(fused_sql(RRF))
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "rrf")


@CATALOG.add(fused_sql(mean_sql(0.5, 0.5)))
def hybrid_simple_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "simple_average")


@CATALOG.add(fused_sql(mean_sql(2.0 / 3.0, 1.0 / 3.0)))
def hybrid_weighted_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir, "weighted_average", dense_weight=2.0, bm25_weight=1.0)


@CATALOG.add(fused_sql(RRF, "query_id, chunk_id, score, dense_score, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS rank") + f" WHERE dense_score >= {GATE}")
def hybrid_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = fusion.gate(_fused(spark, sf_dir, "rrf"), GATE)
    return gated.select("query_id", "chunk_id", "score", "dense_score", F.col("rank").cast("int").alias("rank"))


@CATALOG.add(
    fused_sql(RRF, "query_id, dense_score")
    .replace("SELECT query_id, dense_score FROM f", f"SELECT b.item_id AS query_id, count(f.chunk_id) AS found, count(f.chunk_id) = 0 AS refused FROM benchmark b LEFT JOIN f ON f.query_id = b.item_id AND f.dense_score >= 0.999 GROUP BY b.item_id")
)
def hybrid_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.refusals(questions(spark, sf_dir), fusion.gate(_fused(spark, sf_dir, "rrf"), 0.999))


# ---- reranking

CANDIDATES = f"""{both_sql()}, s AS (SELECT *, {RRF} AS score FROM j), f AS (SELECT * FROM (SELECT *, {RANK} AS rank FROM s) WHERE rank <= {K}),
c AS (SELECT f.query_id, f.chunk_id, f.score AS original_score, f.rank AS original_rank, lower(d.text) AS t, {WORDS_SQL.format('lower(b.text)')} AS qw
 FROM f JOIN documents d ON d.doc_id = f.chunk_id JOIN benchmark b ON b.item_id = f.query_id),
c2 AS (SELECT *, list_filter(list_distinct(qw), lambda w: length(w) > 2) AS asked FROM c),
c3 AS (SELECT *, list_intersect(asked, {WORDS_SQL.format('t')}) AS shared FROM c2),
c4 AS (SELECT *, round(coalesce(list_sum(list_transform(shared, lambda w: 1.0::DOUBLE + 0.5::DOUBLE * ((length(t) - length(replace(t, w, ''))) / length(w) - 1) / ((length(t) - length(replace(t, w, ''))) / length(w) + 1))), 0)
 / greatest(len(asked), 1), 6) AS score FROM c3),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, original_rank) AS rank FROM c4)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused lists whose chunks have a text, with the question."""
    return _fused(spark, sf_dir, "rrf").join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(questions(spark, sf_dir), "query_id")


@CATALOG.add(f"{CANDIDATES} SELECT query_id, chunk_id, score, rank::INT AS rank, original_rank::INT AS original_rank FROM rr WHERE rank <= 5")
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = rerank.rerank(candidates(spark, sf_dir), 5)
    return best.select("query_id", "chunk_id", "score", F.col("rank").cast("int").alias("rank"), F.col("original_rank").cast("int").alias("original_rank"))


@CATALOG.add(
    f"""{CANDIDATES}
SELECT query_id, count(*) AS candidates, count(*) FILTER (rank <= 5) AS returned, round(avg(original_score), 6) AS avg_before, round(avg(score) FILTER (rank <= 5), 6) AS avg_after,
round(count(*) FILTER (rank <= 5 AND original_rank <= 5) / greatest(count(*) FILTER (original_rank <= 5), 1), 6) AS retention FROM rr GROUP BY query_id"""
)
def rerank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return rerank.rerank_metrics(rows, rerank.rerank(rows, 5))


def retriever(method: str, spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    """(query_id, chunk_id, score, rank) of the questions by one of the named methods."""
    if method == "dense":
        return retrieve.dense(embedded_chunks(spark, sf_dir), embedded_questions(spark, sf_dir), retrieve.Request(k), least=GATE).drop("terms_met")
    if method == "bm25":
        return bm25.search(bm25.build(chunks(spark, sf_dir), unique=True), questions(spark, sf_dir), k)
    if method == "hybrid":
        return fusion.fuse(*lists(spark, sf_dir, k), k)
    if method == "hybrid_rerank":
        deep = fusion.fuse(*lists(spark, sf_dir, 3 * k), 3 * k)
        return rerank.rerank(deep.join(chunks(spark, sf_dir).select("chunk_id", "text"), "chunk_id").join(questions(spark, sf_dir), "query_id"), k)
    raise ValueError(f"method {method} is none of dense, bm25, hybrid, hybrid_rerank")


@CATALOG.add(
    r"""SELECT doc_id AS chunk_id, md5(lower(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '\s+', ' ', 'g')))) AS text_md5 FROM documents
UNION ALL SELECT -1, md5('"it''s" - the - end')"""
)
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, and one row with typographic quotes and dashes, which documents lack."""
    fancy = spark.range(1).select(F.lit(-1).cast("long").alias("chunk_id"), F.lit(" “It’s” – the\n —  End\t").alias("text"))
    return chunks(spark, sf_dir).select("chunk_id", "text").unionByName(fancy).select("chunk_id", F.md5(normalized(F.col("text")).cast("binary")).alias("text_md5"))
