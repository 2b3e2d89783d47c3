"""Queries of the document operators: structure, chunks, extraction, question analysis, contexts, catalogs.

The prose of the test tables has no legal structure, so clauses are written from the columns of the other
tables; their SQL computes the expected rows from the same columns, without any pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.sections import parsed
from codicil.functions.text import category
from codicil.operators import chunking, extraction, generation, queries, structure
from codicil.registry import Catalog, spread, table
from codicil.sources import catalog, documents

CATALOG = Catalog()

# ---- sections and structure


@CATALOG.add(
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber::VARCHAR AS n, chr((97 + l_orderkey % 26)::INT) AS a,
 ['i', 'ii', 'iv', 'x'][(l_partkey % 4 + 1)::INT] AS r, l_suppkey % 4 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN k = 3 THEN 'X-' || n ELSE n END AS section_number, CASE WHEN k IN (1, 2) THEN a END AS subsection,
 CASE WHEN k = 2 THEN r END AS clause, CASE k WHEN 0 THEN [n] WHEN 1 THEN [n, a] WHEN 2 THEN [n, a, r] ELSE ['X-' || n] END AS structure_path FROM x"""
)
def section_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("l_linenumber").cast("string"), F.col("l_suppkey") % 4
    letter = F.char(97 + F.col("l_orderkey") % 26)
    roman = F.element_at(F.array(*map(F.lit, ("i", "ii", "iv", "x"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    section = (
        F.when(k == 0, n)
        .when(k == 1, F.concat(n, F.lit("("), F.upper(letter), F.lit(")")))
        .when(k == 2, F.concat(n, F.lit("("), letter, F.lit(")("), roman, F.lit(")")))
        .otherwise(F.concat(F.lit("X-"), n))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", parsed(section).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


LINES = (  # line, type, identifier, title, confidence; $ is the customer's name, # the segment
    ("CHAPTER IV: $", "chapter", "IV", "$", 1.0),
    ("12(B) $", "section", "12(b)", "$", 1.0),
    ("(c) $", "subsection", "(c)", "$", 1.0),
    ("(iii) $", "nested_clause", "(iii)", "$", 1.0),
    ("Article 7 - #", "article", "7", "#", 1.0),
    ("3.2 $", "section", "3.2", "$", 1.0),
    ("$ shall pay, it says here.", None, None, None, None),
    ("# NOTICE", "heading", None, "# NOTICE", 0.7),
    ("8. #", "section", "8", "#", 1.0),
    ("9. A Title.— as to # it says", "section", "9", "A Title", 0.95),
    ("The First Schedule", "schedule", "FIRST", "The First Schedule", 1.0),
    ("Section 4A: $", "section", "4A", "$", 1.0),
    ("Table of Contents", "frontmatter", "TABLE_OF_CONTENTS", "Table of Contents", 1.0),
    ("10. The $ is what it is said to be", None, None, None, None),
    ("12/03/2020", None, None, None, None),
    ("HELD", "judgment_heading", None, "HELD", 1.0),
)


def _quote(x: object) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'"


LINES_SQL = ", ".join(f"({i}, {_quote(t)}, {_quote(d)}, {_quote(n)}, {_quote(c)})" for i, (_, t, d, n, c) in enumerate(LINES))


@CATALOG.add(
    f"""SELECT c_custkey, t.type, t.identifier, replace(replace(t.title, '$', c_name), '#', c_mktsegment) AS title, t.confidence::DOUBLE AS confidence
FROM customer JOIN (VALUES {LINES_SQL}) AS t(i, type, identifier, title, confidence) ON c_custkey % {len(LINES)} = t.i"""
)
def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(x[0]) for x in LINES]), (F.col("c_custkey") % len(LINES) + 1).cast("int"))
    line = F.replace(F.replace(text, F.lit("$"), F.col("c_name")), F.lit("#"), F.col("c_mktsegment"))
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.lit(1).alias("page_number"), line.alias("text"))
    return structure.classify_lines(pages).select(F.col("document_id").alias("c_custkey"), "structure.type", "structure.identifier", "structure.title", "structure.confidence")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A contract of two pages for every customer."""
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    pages = F.array(
        F.struct(F.lit(1).alias("page_number"), F.concat(F.lit("CHAPTER I\nPRELIMINARY\n1. DEFINITIONS\nThe word "), segment, F.lit(" is used here.\n\n1.1 Each "), name, F.lit(" is a party to this, as is said.\n(a) one of them;\nmore of")).alias("text")),
        F.struct(F.lit(2).alias("page_number"), F.concat(F.lit("the same.\n\n2. Payment\nThe sum is "), F.col("c_custkey").cast("string"), F.lit(" in all.\nWHEREAS it is so\nit is "), segment).alias("text")),
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_id"), F.concat(name, F.lit(".pdf")).alias("filename"), segment.alias("category"), F.explode(pages).alias("p"))
    return rows.select("document_id", "filename", "category", "p.*")


PARAGRAPHS = """(1, 'The word ' || c_mktsegment || ' is used here.', 1, 1, '1', 'DEFINITIONS'),
 (2, '1.1 Each ' || c_name || ' is a party to this, as is said.', 1, 1, '1.1', 'DEFINITIONS'),
 (3, '(a) one of them;' || chr(10) || 'more of' || chr(10) || 'the same.', 1, 2, '1(a)', '1(a). one of them;'),
 (4, 'The sum is ' || c_custkey || ' in all.', 2, 2, '2', 'Payment'),
 (5, 'WHEREAS it is so' || chr(10) || 'it is ' || c_mktsegment, 2, 2, 'FRONTMATTER:WHEREAS', 'WHEREAS it is so')"""


@CATALOG.add(
    f"""SELECT c_custkey::VARCHAR AS document_id, p.n::BIGINT AS n, p.text, p.page_number, p.end_page_number, p.section, p.heading
FROM customer, LATERAL (SELECT * FROM (VALUES {PARAGRAPHS}) AS v(n, text, page_number, end_page_number, section, heading)) AS p"""
)
def structure_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("document_id").orderBy("para")).cast("long")
    return structure.paragraphs(contracts(spark, sf_dir)).select("document_id", n.alias("n"), "text", "page_number", "end_page_number", "section", "heading")


@CATALOG.add(
    f"""SELECT c_custkey::VARCHAR || ':' || lpad((p.n - 1)::VARCHAR, 4, '0') AS chunk_id, p.text, p.page_number, p.end_page_number, p.section, p.heading, c_name || '.pdf' AS document_name,
 CASE p.n WHEN 3 THEN '1' ELSE p.section END AS section_number, CASE p.n WHEN 3 THEN 'a' END AS subsection
FROM customer, LATERAL (SELECT * FROM (VALUES {PARAGRAPHS}) AS v(n, text, page_number, end_page_number, section, heading)) AS p"""
)
def chunk_legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph has a heading or section of its own, so each is a chunk."""
    return chunking.chunk(contracts(spark, sf_dir), "legal").select("chunk_id", "text", "page_number", "end_page_number", "section", "heading", "document_name", "section_number", "subsection")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.text_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), id_col="doc_id", text_col="text")


@CATALOG.add()
def chunk_legal_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' own prose: packing, sentence and size cuts, folding and overlap all take place."""
    return chunking.chunk(prose(spark, sf_dir), "legal").select("chunk_id", "heading", "page_number", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@CATALOG.add()
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk(prose(spark, sf_dir), "recursive").select("chunk_id", "page_number", F.length("text").alias("chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@CATALOG.add(
    """WITH d AS (SELECT doc_id, text, strpos(text, chr(10)) AS k FROM documents),
c AS (SELECT *, k > 0 AND regexp_matches(left(text, k), '[\\p{L}\\p{N}]') AND regexp_matches(substr(text, k + 1), '[\\p{L}\\p{N}]') AND strpos(left(text, k), left(substr(text, k + 1), 40)) = 0 AS cut FROM d),
p AS (SELECT doc_id, unnest(CASE WHEN cut THEN [left(text, k), substr(text, k + 1)] ELSE [text] END) AS t, unnest(CASE WHEN cut THEN [1, 2] ELSE [1] END) AS i FROM c)
SELECT doc_id::VARCHAR || ':' || lpad((i - 1)::VARCHAR, 4, '0') AS chunk_id, md5(trim(t, ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM p WHERE regexp_matches(t, '[\\p{L}\\p{N}]')"""
)
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document of several lines a cut is proposed before its second line, if its beginning is not in the first; the others have no proposal and stay whole.

    Anchors count only where lines begin: in any case, spacing or overlap of the two lines the second one is met at its own beginning.
    """
    at = F.locate("\n", F.col("text"))
    rest = F.substring("text", at + 1, F.length("text"))
    head = F.substring("text", F.lit(1), at)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")
    cut = docs.filter((at > 0) & head.rlike(r"[\p{L}\p{N}]") & rest.rlike(r"[\p{L}\p{N}]") & (F.position(F.substring(rest, 1, 40), head) == 0))
    anchor = lambda line: F.substring(F.regexp_replace(line, r"(?U)^[\s\x1C-\x1F]+", ""), 1, 40)
    anchors = cut.select("document_id", F.lit(0).alias("window_index"), F.array(anchor(head), anchor(rest)).alias("anchors"))
    return chunking.chunk(docs, "llm_semantic", anchors=anchors, lines=True).select("chunk_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@CATALOG.add(
    """WITH w AS (SELECT *, right(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 150) AS tail FROM conversations),
l AS (SELECT *, CASE WHEN strpos(tail, ' ') > 0 THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END AS lead FROM w)
SELECT conv_id, turn, CASE WHEN coalesce(lead, '') <> '' THEN trim(lead || ' ' || text, ' ' || chr(9) || chr(10) || chr(13)) ELSE text END AS text FROM l"""
)
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlapped(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], ["turn"])


@CATALOG.add(
    """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, island::BIGINT AS island, event_type, count(*) AS events, min(event_id) AS first_event FROM i GROUP BY ALL"""
)
def group_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = structure.islands(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["event_type"])
    return runs.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


# ---- extraction


def clauses(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A clause for every customer; $ is the segment, # the customer's number, % its remainder by 60 plus 1."""
    key = F.col("c_custkey")
    text = F.replace(F.replace(F.replace(F.lit(template), F.lit("$"), F.initcap(F.lower("c_mktsegment"))), F.lit("#"), key.cast("string")), F.lit("%"), (key % 60 + 1).cast("string"))
    return table(spark, sf_dir, "customer").select(key.cast("string").alias("chunk_id"), text.alias("text"))


DUTY = "See here:\nThe $ shall pay # dollars within % days. Then the $ may sell item # except on day %."
NAME = "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"
ACTION = "'pay ' || c_custkey || ' dollars within ' || (c_custkey % 60 + 1) || ' days'"
RIGHT = "'sell item ' || c_custkey || ' except on day ' || (c_custkey % 60 + 1)"


@CATALOG.add(
    f"""SELECT c_custkey || '-ob-0' AS obligation_id, {NAME} AS actor, {ACTION} AS action, 'MUST' AS severity, 'relative' AS deadline_type,
 (c_custkey % 60 + 1) || ' days' AS deadline, NULL::VARCHAR AS penalty, 0::INT AS conditions, 1::BIGINT AS line_number FROM customer"""
)
def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.obligations(clauses(spark, sf_dir, DUTY.replace(":\n", ": ")))
    # "See here: The X": a colon is no part of an actor, so the actor begins after it.
    return found.select("obligation_id", "actor", "action", "severity", "deadline_type", "deadline", "penalty", F.size("conditions").alias("conditions"), F.col("line_number").cast("long").alias("line_number"))


@CATALOG.add(f"""SELECT c_custkey || '-rt-0' AS right_id, 'Then The ' || {NAME} AS actor, {RIGHT} AS action, 'on day ' || (c_custkey % 60 + 1) AS limitation, 2::BIGINT AS line_number FROM customer""")
def rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.rights(clauses(spark, sf_dir, DUTY)).select("right_id", "actor", "action", "limitation", F.col("line_number").cast("long").alias("line_number"))


@CATALOG.add(
    """SELECT c_custkey::VARCHAR AS chunk_id, v.* FROM customer, LATERAL (SELECT * FROM (VALUES
 ('condition_unless', 'limitation', 'claim ' || c_custkey || ' is open'), ('condition_contingent', 'concurrent', 'audit by ' || c_mktsegment), ('condition_in_event', 'trigger', 'fire')) AS t(pattern, condition_type, description)) AS v"""
)
def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("chunk_id"),
        F.concat(F.lit("It is due unless claim "), F.col("c_custkey").cast("string"), F.lit(" is open. It is subject to audit by "), F.col("c_mktsegment"), F.lit(". It ends in case of fire. It ends in case of fire.")).alias("text"),
    )
    return extraction.conditions(rows).select("chunk_id", "pattern", "condition_type", "description")


@CATALOG.add(
    """SELECT c_custkey::VARCHAR AS chunk_id, v.* FROM customer, LATERAL (SELECT * FROM (VALUES
 ('deadline_by_date', 'by ' || (c_custkey % 28 + 1) || ' May 2026', 9), ('deadline_within', 'within ' || c_custkey || ' days', 23 + length((c_custkey % 28 + 1)::VARCHAR)),
 ('deadline_quarterly', 'weekly', 42 + length((c_custkey % 28 + 1)::VARCHAR) + length(c_custkey::VARCHAR))) AS t(pattern, match, start)) AS v"""
)
def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    day = (F.col("c_custkey") % 28 + 1).cast("string")
    rows = table(spark, sf_dir, "customer").select(key.alias("chunk_id"), F.concat(F.lit("It ends by "), day, F.lit(" May 2026, within "), key, F.lit(" days, told weekly.")).alias("text"))
    return extraction.deadlines(rows).select("chunk_id", "pattern", "match", "start")


@CATALOG.add(
    """SELECT c_custkey::VARCHAR AS chunk_id, v.* FROM customer, LATERAL (SELECT * FROM (VALUES
 ('penalty_late_fee', 'late fee of ' || (c_custkey % 9) || '.5% per week'), ('penalty_termination', 'breach shall result in termination'), ('penalty_liability', 'liable for all damage')) AS t(pattern, match)) AS v"""
)
def penalties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("chunk_id"),
        F.concat(F.lit("A late fee of "), (F.col("c_custkey") % 9).cast("string"), F.lit(".5% per week; any breach shall result in termination; he is liable for all damage.")).alias("text"),
    )
    return extraction.penalties(rows).select("chunk_id", "pattern", "match")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir, DUTY)
    return extraction.both(extraction.obligations(rows), extraction.rights(rows))


@CATALOG.add(
    f"""SELECT c_custkey || '-risk-0' AS risk_id, c_custkey || '-ob-0' AS obligation_id, 'MEDIUM' AS risk_level, ['financial', 'operational'] AS risk_categories, 'Risk in: ' || left({ACTION}, 50) AS description FROM customer
UNION ALL SELECT c_custkey || '-risk-1', NULL, 'MEDIUM', ['operational'], 'Risk in: ' || left({RIGHT}, 50) FROM customer"""
)
def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.risks(_found(spark, sf_dir)).select("risk_id", "obligation_id", "risk_level", "risk_categories", "description")


@CATALOG.add("SELECT c_custkey::VARCHAR AS chunk_id, 0::BIGINT AS critical, 0::BIGINT AS high, 2::BIGINT AS medium, 0::BIGINT AS low FROM customer")
def risk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.risk_summary(extraction.risks(_found(spark, sf_dir)))


@CATALOG.add(f"SELECT c_custkey::VARCHAR AS chunk_id, unnest(['See Here The ' || {NAME}, 'Then The ' || {NAME}]) AS actor FROM customer")
def actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clauses(spark, sf_dir, DUTY.replace(":\n", "\n"))
    return extraction.actors(extraction.both(extraction.obligations(rows), extraction.rights(rows))).select("chunk_id", "actor")


@CATALOG.add("SELECT c_custkey::VARCHAR AS chunk_id, 0.8::DOUBLE AS confidence FROM customer")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.overall_confidence(clauses(spark, sf_dir, DUTY), _found(spark, sf_dir))


# ---- questions

ASKED = (
    'When must part # be paid under section 4.2(b)?',
    'What is the definition of "part #"?',
    'Which steps apply to part #, and how does the process run?',
    'Is nobody entitled to part #, or may its license lapse?',
    '  Tell   us about   part # ',
    'Where are great parts like # kept?',
)
ASKED_SQL = ", ".join(f"({i}, {_quote(x)})" for i, x in enumerate(ASKED))
QUESTIONS = f"q AS (SELECT p_partkey AS query_id, replace(t.x, '#', p_partkey::VARCHAR) AS query FROM part JOIN (VALUES {ASKED_SQL}) AS t(i, x) ON p_partkey % {len(ASKED)} = t.i)"
LOW = "q2 AS (SELECT query_id, query, trim(regexp_replace(query, '\\s+', ' ', 'g')) AS normalized, lower(trim(regexp_replace(query, '\\s+', ' ', 'g'))) AS low FROM q)"
TERMS_SQL = "t AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {j}, {_quote(t)}, {_quote(n)})" for i, (n, ts) in enumerate(queries.TERMS.items()) for j, t in enumerate(ts)) + ") AS v(i, j, term, intent))"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ASKED)), (F.col("p_partkey") % len(ASKED) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), F.replace(text, F.lit("#"), F.col("p_partkey").cast("string")).alias("query"))


@CATALOG.add(
    f"""WITH {QUESTIONS}, {LOW}, {TERMS_SQL},
v AS (SELECT query_id, i, intent, count(*) AS n, min(strpos(low, term)) AS place FROM q2 CROSS JOIN t WHERE strpos(low, term) > 0 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, place, i) AS r FROM v)
SELECT q2.query_id, normalized, coalesce(b.intent, CASE WHEN contains(low, 'how') OR contains(low, 'what') OR contains(low, 'why') THEN 'general_inquiry'
 WHEN contains(low, 'which') OR contains(low, 'where') THEN 'scope' WHEN contains(low, 'when') THEN 'temporal' ELSE 'general_inquiry' END) AS intent
FROM q2 LEFT JOIN b ON b.query_id = q2.query_id AND r = 1"""
)
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.analyse(asked(spark, sf_dir)).select("query_id", "normalized", "intent")


@CATALOG.add(
    f"""WITH {QUESTIONS}, {LOW}, {TERMS_SQL},
m AS (SELECT query_id, list(term ORDER BY i, j) AS legal_terms FROM q2 CROSS JOIN t WHERE regexp_matches(low, '\\b' || term) GROUP BY query_id)
SELECT q2.query_id, coalesce(legal_terms, []) AS legal_terms, CASE WHEN legal_terms IS NOT NULL THEN nullif(regexp_extract(normalized, '\\b(\\d+(?:\\.\\d+)*(?:\\([a-z]\\))?)\\b', 1), '') END AS potential_section,
 regexp_extract_all(query, '"([^"]+)"', 1) AS exact_matches FROM q2 LEFT JOIN m USING (query_id)"""
)
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.analyse(asked(spark, sf_dir)).select("query_id", "legal_terms", "potential_section", "exact_matches")


def _contains_sql(parts: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(low, {_quote(p)})" for p in parts)


@CATALOG.add(
    f"""WITH {QUESTIONS}, {LOW} SELECT query_id, ({_contains_sql(queries.NEGATIONS)}) AS has_negation, ({_contains_sql(queries.TEMPORAL)}) AS has_temporal_constraint,
 len(string_split(normalized, ' '))::INT AS query_length FROM q2"""
)
def query_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.analyse(asked(spark, sf_dir)).select("query_id", "has_negation", "has_temporal_constraint", "query_length")


@CATALOG.add()
def query_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.analyse(asked(spark, sf_dir)).select("query_id", F.explode_outer("signals").alias("s")).select("query_id", "s.*")


# ---- contexts and citations


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a question; its documents, by id, are the results."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("question_id"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rank"), F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"),
        F.concat(F.col("lang"), F.lit(".pdf")).alias("document_name"), F.lit(1).alias("page_number"), F.lit(None).cast("string").alias("section"), F.col("lang").alias("heading"), "text", F.lit(0.5).alias("score"),
    )


PACKED = """r AS (SELECT source AS question_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank, doc_id, lang, text FROM documents),
k AS (SELECT *, '[SOURCE_' || rank || ']' || chr(10) || 'Document: ' || lang || '.pdf' || chr(10) || 'Chunk: ' || doc_id || chr(10) || 'Section/Heading: ' || lang || chr(10) || 'Page: 1' || chr(10) || chr(10) || text AS block FROM r WHERE rank <= 6),
u AS (SELECT *, sum(length(block)) OVER (PARTITION BY question_id ORDER BY rank) AS used FROM k),
p AS (SELECT question_id, rank, doc_id, CASE WHEN used <= 8000 THEN block ELSE left(block, 7997) || '...' END AS block FROM u WHERE used <= 8000 OR rank = 1)"""


@CATALOG.add(f"WITH {PACKED} SELECT question_id, count(*) AS sources, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context_md5 FROM p GROUP BY question_id")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = generation.contexts(generation.pack(ranked(spark, sf_dir)))
    return packed.select("question_id", "sources", F.md5(F.col("context").cast("binary")).alias("context_md5"))


ANSWER = "By [SOURCE_2] and [SOURCE_1], as [SOURCE_2] says; not [SOURCE_9] nor [SOURCE_9]."


@CATALOG.add(
    f"""WITH {PACKED}, a AS (SELECT DISTINCT question_id FROM p), x AS (SELECT question_id, unnest([0, 1, 2, 3, 4]) AS place, unnest(['2', '1', '2', '9', '9']) AS number FROM a),
m AS (SELECT x.*, p.doc_id, row_number() OVER (PARTITION BY x.question_id, number ORDER BY place) AS nth FROM x LEFT JOIN p ON p.question_id = x.question_id AND p.rank::VARCHAR = number)
SELECT question_id, place::INT AS place, 'SOURCE_' || number AS source_id, doc_id IS NOT NULL AS resolved, doc_id AS chunk_id FROM m WHERE doc_id IS NULL OR nth = 1"""
)
def citations_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = generation.pack(ranked(spark, sf_dir))
    answers = packed.select("question_id").distinct().withColumn("answer", F.lit(ANSWER))
    return generation.citations(answers, packed).select("question_id", "place", "source_id", "resolved", "chunk_id")


@CATALOG.add(
    f"""WITH {PACKED}, n AS (SELECT question_id, count(*) FILTER (rank <= 2) AS c FROM p GROUP BY question_id)
SELECT question_id, 'answered' AS status, c AS citations, (2 + (2 - c) + CASE WHEN c < 2 THEN 1 ELSE 0 END)::BIGINT AS unresolved FROM n"""
)
def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = generation.pack(ranked(spark, sf_dir))
    answers = packed.select("question_id").distinct().withColumn("answer", F.lit(ANSWER))
    told = generation.answer_status(answers, generation.citations(answers, packed), packed)
    return told.select("question_id", "status", F.col("citations").cast("long").alias("citations"), F.col("unresolved").cast("long").alias("unresolved"))


@CATALOG.add(f"WITH {PACKED} SELECT p.question_id, p.rank::INT AS rank, '0.5000' AS score, 'N/A' AS section, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS snippet FROM p JOIN r ON r.doc_id = p.doc_id")
def source_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.trace(generation.pack(ranked(spark, sf_dir))).select("question_id", F.col("rank").cast("int").alias("rank"), "score", "section", "snippet")


# ---- catalogs


@CATALOG.add(
    """SELECT doc_id, sha256(text) AS document_id, CASE WHEN lang = 'de' THEN 'moved_' || source ELSE source END AS category FROM documents"""
)
def doc_catalog_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_id"), category(F.col("source")).alias("category"))
    moved = table(spark, sf_dir, "documents").filter("lang = 'de'").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_id"), category(F.concat(F.lit("moved?!"), F.col("source"))).alias("category"))
    return catalog.upsert(rows, moved, "doc_id")


@CATALOG.add("SELECT source AS document_id, count(*) AS deleted FROM documents WHERE source IN ('src1', 'src2') GROUP BY source UNION ALL SELECT 'none', 0 UNION ALL SELECT 'left', count(*) FROM documents WHERE source NOT IN ('src1', 'src2')")
def doc_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("document_id"), "doc_id")
    gone = spark.createDataFrame([("src1",), ("src2",), ("none",)], "document_id string")
    left, counts = catalog.delete(rows, gone)
    return counts.unionByName(left.agg(F.lit("left").alias("document_id"), F.count(F.lit(1)).alias("deleted")))


@CATALOG.add(
    """SELECT c_custkey AS query_id, c_mktsegment AS case_id, CASE WHEN n IS NULL THEN 'unknown_case' WHEN n = 0 THEN 'empty_case' ELSE 'searched' END AS status, coalesce(n, 0)::BIGINT AS documents
FROM customer LEFT JOIN (SELECT seg, count(doc_id) AS n FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer WHERE c_mktsegment <> 'BUILDING') LEFT JOIN documents ON seg = 'MACHINERY' AND lang = 'fr' OR seg = 'HOUSEHOLD' AND lang = 'es' GROUP BY seg) ON seg = c_mktsegment"""
)
def case_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are cases: one unknown, two with documents, the others empty."""
    people = table(spark, sf_dir, "customer")
    cases = people.filter("c_mktsegment <> 'BUILDING'").select(F.col("c_mktsegment").alias("case_id")).distinct()
    docs = table(spark, sf_dir, "documents")
    new = docs.filter("lang IN ('fr', 'es')").select(F.when(F.col("lang") == "fr", "MACHINERY").otherwise("HOUSEHOLD").alias("case_id"), F.col("doc_id").alias("document_id"))
    links, _ = catalog.add_to_case(new.limit(0), cases, new.unionByName(new))
    return catalog.scoped(people.select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("case_id")), cases, links)


@CATALOG.add("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'missing_filename' WHEN page_id % 5 = 1 THEN 'not_a_pdf' WHEN page_id % 5 = 2 THEN 'empty_file' END AS error, sha256(CASE WHEN page_id % 5 = 2 THEN '' ELSE html END) AS document_id FROM pages")
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    files = table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k == 0, " ").when(k == 1, "page.html").otherwise(F.lit("Page.PDF")).alias("filename"),
        F.when(k == 2, F.lit("")).otherwise(F.col("html")).cast("binary").alias("content"),
    )
    return documents.identified(documents.validated(files)).select("page_id", "error", "document_id")


@CATALOG.add(r"SELECT doc_id::VARCHAR AS document_id, 1 AS page_number, CASE WHEN regexp_matches(text, '\S') THEN 'extracted' ELSE 'no_text' END AS extraction_status FROM documents")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose(spark, sf_dir).select("document_id", "page_number", "extraction_status")
