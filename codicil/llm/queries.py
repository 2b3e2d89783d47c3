"""Named queries of the corpus operators, over the tables in sf_dir, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_repeated_lines

    kept = drop_repeated_lines(_table(spark, sf_dir, "documents"), min_chars=20, min_docs=3)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_quality

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_documents

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge_documents(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .emb_dedup import near_vectors

    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path=tokenizer_path(), window=2048, end_id=1, with_ids=False)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import small_batches
    from .minhash import near_duplicates

    small_batches(spark)
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, k=5).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_mixing,
        op3_quality,
        op4_sharding,
        op5_secrets,
        op6_quality_rules,
        op7_lm_scoring,
        op8_embedding_dedup,
        op9_packing,
        op10_minhash,
    )
}

# ---- the same in SQL, by plain counting and comparing of all with all

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

_LINE_DEDUP = f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {_LOW.format(f'trim(line, {_WHITE})')} AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""

_MIXING = f"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src, len({_WORDS.format('text')})::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
t AS (SELECT src, sum(size)::BIGINT AS total, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY src),
r AS (SELECT *, 2.0::DOUBLE * total AS cap, 2.0::DOUBLE * total / w AS ratio FROM t),
v AS (SELECT *, ((sum(total) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM r WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT src, total, least(cap, (SELECT level FROM v WHERE ratio >= level ORDER BY ratio, src LIMIT 1) * w) AS target FROM v),
o AS (SELECT d.*, total, target, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate, ('0x' || substr(md5(src), 1, 3))::INT / 4096.0::DOUBLE AS u,
 row_number() OVER (PARTITION BY src ORDER BY length(bin(size)) * 64 + floor(size / pow(2, greatest(length(bin(size)) - 5, 0))), ('0x' || substr(h, 1, 2))::INT, size, doc_id) AS place FROM d JOIN g USING (src))
SELECT doc_id, size, total AS source_size, target, ((floor(place * rate + u) - floor((place - 1) * rate + u)) * size)::BIGINT AS taken FROM o"""

_COMPONENTS = """e AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links), reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
c AS (SELECT u, least(u, min(v)) AS component FROM reach GROUP BY u)"""

_VECTORS = f"""WITH RECURSIVE n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.label = b.label AND a.vec_id < b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98), {_COMPONENTS},
k AS (SELECT u, count(*) AS n FROM e GROUP BY u)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.component, vec_id) AS component_id, vec_id = coalesce(c.component, vec_id) AS kept FROM embeddings LEFT JOIN c ON c.u = vec_id LEFT JOIN k ON k.u = vec_id"""

_MINHASH = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOW.format('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 85 * (a.n + b.n - common)), {_COMPONENTS}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id = coalesce(c.component, d.doc_id) AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.u = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _LINE_DEDUP,
    "op2_mixing": _MIXING,
    "op8_embedding_dedup": _VECTORS,
    "op10_minhash": _MINHASH,
}
