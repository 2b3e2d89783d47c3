"""Legal structure of page text: lines are classified, and document state is carried by windows.

Classification is one first-match CASE chain. What a sequential reader would keep in variables (current
heading, section, front matter) are running aggregates over a document's lines, so the whole step is one
shuffle by document, sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.sections import composed
from codicil.functions.text import lines, strip, words

# The words and patterns that mark structure, in order of precedence.
NUMERAL = r"([IVXLCDM]+|\d+[A-Za-z]?)"
TAIL = r"\b\s*[:.\-]?\s*(.*)$"
SECTION_LETTER = r"(?iU)^(\d+[A-Za-z]?)\(([a-z])\)\s+(.+)$"
NESTED = r"(?iU)^\((ii|iii|iv|ix|vi|vii|viii|xi|xii|xiii|xiv|xv|xvi|xvii|xviii|xix|xx)\)\s+(.+)$"
LETTERED = r"(?U)^\(([a-z])\)\s+(.+)$"
NAMED = {
    "chapter": (1, rf"(?iU)^CHAPTER\s+{NUMERAL}{TAIL}"),
    "part": (1, rf"(?iU)^PART\s+{NUMERAL}{TAIL}"),
    "article": (2, rf"(?iU)^Article\s+{NUMERAL}{TAIL}"),
    "rule": (2, rf"(?iU)^Rule\s+{NUMERAL}{TAIL}"),
    "regulation": (2, rf"(?iU)^Regulation\s+{NUMERAL}{TAIL}"),
}
SCHEDULE_ORDINAL = rf"(?iU)^(?:THE\s+)?(FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH)\s+SCHEDULE{TAIL}"
SCHEDULE_NUMBER = rf"(?iU)^(?:THE\s+)?SCHEDULE\s+([IVXLCDM]+|\d+[A-Za-z]?|[A-Z]){TAIL}"
SCHEDULE_BARE = r"(?iU)^SCHEDULE\b\s*[:.—–-]?\s*(.*)$"
ANNEXURE = rf"(?iU)^ANNEXURE\s+([IVXLCDM]+|\d+[A-Za-z]?|[A-Z]){TAIL}"
KEYWORD = rf"(?iU)^(Section|Clause|Appendix)\s+{NUMERAL}{TAIL}"
FRONT = r"(?iU)^(PREAMBLE|WHEREAS|RECITALS?|OBJECT OF THE ACT|LONG TITLE|PURPOSES|FINDINGS|INTENT|TABLE OF CONTENTS|INTRODUCTORY REMARKS)\b"
DOTTED = r"(?U)^(\d{1,3}(?:\.\d{1,3}){1,4})\.?\s+(.+)$"
NUMBERED = "(?U)^(\\d{1,3}[A-Za-z]?)\\.(?:\\s+|(?=[A-Z“\"']))(.+)$"
DASH = "(?U)\\s*\\.\\s*[—–]\\s*|\\s*[—–]\\s*"
PAGE_NUMBER = r"(?iU)^(?:Page\s+)?\d{1,4}$"
DATE_LINE = r"(?U)^\[?\d{1,2}[./-]\d{1,2}[./-]\d{2,4}\]?$"
REPORTER = r"(?iU)^(AIR|SCC|SCR|All\s+ER)\b"
RULED = "^[_\\-—–. ]+$"
FOOTNOTE = r"(?iU)^(Subs\.|Ins\.|Omitted|Added|Vide\b|For the Statement|See e\.g)"
NARRATIVE = r"(?U)^(The|This|It|We|I|A|An)\b"
SMALL_WORDS = ("a", "an", "and", "as", "at", "but", "by", "for", "in", "of", "on", "or", "the", "to", "vs")
JUDGMENT_WORDS = ("FACTS", "ISSUES", "JUDGMENT", "ORDER", "REASONS", "ANALYSIS", "HELD")
KNOWN_HEADINGS = (
    "DEFINITIONS", "CONFIDENTIALITY", "TERMINATION", "GOVERNING LAW", "PAYMENT", "NOTICES", "INDEMNITY", "REPRESENTATIONS", "WARRANTIES", *JUDGMENT_WORDS,
)
HEADING_TYPES = ("chapter", "part", "article", "rule", "regulation", "schedule", "annexure", "clause")


def shaped(text: Column) -> Column:
    """Short enough, and not ending as a sentence does."""
    n = F.size(words(text))
    return (F.length(text) <= 70) & (n >= 1) & (n <= 10) & ~text.rlike(r"[.,;:]$")


def all_caps(text: Column) -> Column:
    return shaped(text) & text.rlike(r"\p{L}") & ~text.rlike(r"[\p{L}&&[^\p{Lu}]]")


def heading_like(text: Column) -> Column:
    """All capitals, or every word capitalised but for small ones."""

    def capital(word: Column) -> Column:
        core = F.btrim(word, F.lit("\"'()"))
        return (core == "") | F.lower(core).isin(*SMALL_WORDS) | core.rlike(r"^\p{Lu}")

    return all_caps(text) | (shaped(text) & F.forall(words(text), capital))


def noise(line: Column) -> Column:
    return (line == "") | line.rlike(RULED) | line.rlike(PAGE_NUMBER) | line.rlike(DATE_LINE) | line.rlike(REPORTER)


def statute_title(rest: Column) -> tuple[Column, Column]:
    """Title and body on either side of a dash; body is null where there is no such pair."""
    parts = F.split(rest, DASH, 2)
    title, body = F.btrim(F.element_at(parts, 1), F.lit(" .")), strip(F.get(parts, F.lit(1)))
    good = (F.size(parts) == 2) & (title != "") & (body != "") & (F.size(words(title)) <= 20)
    return F.when(good, title).otherwise(strip(rest)), F.when(good, body)


def narrative(rest: Column) -> Column:
    title, _ = statute_title(rest)
    n = F.size(words(title))
    return title.rlike(FOOTNOTE) | (n > 22) | (title.rlike(NARRATIVE) & (n >= 6))


def classified(line: Column) -> Column:
    """struct(type, identifier, title, level, confidence) of a stripped line; null for body text."""
    group = lambda p, i: F.regexp_extract(line, p, i)

    def found(kind: Column | str, identifier: Column, title: Column, level: int, confidence: Column | float = 1.0) -> Column:
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("type"),
            identifier.cast("string").alias("identifier"),
            title.alias("title"),
            F.lit(level).alias("level"),
            (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        )

    titled = lambda p, i: F.coalesce(F.nullif(strip(group(p, i)), F.lit("")), line)
    out = F.when(noise(line), F.lit(None))
    out = out.when(line.rlike(SECTION_LETTER), found("section", F.concat(group(SECTION_LETTER, 1), F.lit("("), F.lower(group(SECTION_LETTER, 2)), F.lit(")")), strip(group(SECTION_LETTER, 3)), 2))
    out = out.when(line.rlike(NESTED), found("nested_clause", F.concat(F.lit("("), F.lower(group(NESTED, 1)), F.lit(")")), strip(group(NESTED, 2)), 4))
    out = out.when(line.rlike(LETTERED), found("subsection", F.concat(F.lit("("), group(LETTERED, 1), F.lit(")")), strip(group(LETTERED, 2)), 3))
    for kind, (level, pattern) in NAMED.items():
        out = out.when(line.rlike(pattern), found(kind, group(pattern, 1), titled(pattern, 2), level))
    out = out.when(line.rlike(SCHEDULE_ORDINAL), found("schedule", F.upper(group(SCHEDULE_ORDINAL, 1)), titled(SCHEDULE_ORDINAL, 2), 1))
    out = out.when(line.rlike(SCHEDULE_NUMBER), found("schedule", group(SCHEDULE_NUMBER, 1), titled(SCHEDULE_NUMBER, 2), 1))
    out = out.when(line.rlike(SCHEDULE_BARE), found("schedule", F.lit("SCHEDULE"), titled(SCHEDULE_BARE, 1), 1))
    out = out.when(line.rlike(ANNEXURE), found("annexure", group(ANNEXURE, 1), titled(ANNEXURE, 2), 1))
    clause = F.when(F.lower(group(KEYWORD, 1)) == "clause", "clause").otherwise("section")
    out = out.when(line.rlike(KEYWORD), found(clause, group(KEYWORD, 2), titled(KEYWORD, 3), 2))
    out = out.when(line.rlike(FRONT), found("frontmatter", F.replace(F.upper(group(FRONT, 1)), F.lit(" "), F.lit("_")), line, 0))
    out = out.when(line.rlike(DOTTED), found("section", group(DOTTED, 1), strip(group(DOTTED, 2)), 2))
    rest = strip(group(NUMBERED, 2))
    title, body = statute_title(rest)
    sure = F.when(body.isNotNull(), 0.95).when(heading_like(rest), 1.0).otherwise(0.8)
    out = out.when(line.rlike(NUMBERED) & ~narrative(rest), found("section", group(NUMBERED, 1), title, 2, sure))
    heading = F.when(line.isin(*JUDGMENT_WORDS), "judgment_heading").otherwise("heading")
    return out.when(all_caps(line), found(heading, F.lit(None), line, 1, F.when(line.isin(*KNOWN_HEADINGS), 1.0).otherwise(0.7)))


def statutory_line(line: Column) -> Column:
    """Whether a line speaks for a statute: chapters, parts, articles, rules, sections; schedules do not."""
    named = [p for _, p in NAMED.values()]
    hit = line.rlike(named[0])
    for p in named[1:]:
        hit = hit | line.rlike(p)
    schedule = line.rlike(SCHEDULE_ORDINAL) | line.rlike(SCHEDULE_NUMBER) | line.rlike(SCHEDULE_BARE) | line.rlike(ANNEXURE)
    return hit | (~schedule & (line.rlike(KEYWORD) | line.rlike(SECTION_LETTER)))


def classify_lines(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text) -> one row per line: pos, line, structure. Lines are stripped."""
    each = pages.select("document_id", "page_number", F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("pos", "_raw"))
    return each.select("document_id", "page_number", "pos", strip(F.col("_raw")).alias("line")).withColumn("structure", classified(F.col("line")))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(document_id, para, text, page_number, end_page_number, section, heading): paragraphs in reading order.

    A page's end does not end a paragraph; a blank line and every structural line do.
    """
    doc = Window.partitionBy("document_id")
    order = doc.orderBy("page_number", "pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    s, kind = F.col("structure"), F.col("kind")
    dotted, nested = F.contains(F.coalesce(s["identifier"], F.lit("")), F.lit(".")), F.contains(F.coalesce(s["identifier"], F.lit("")), F.lit("("))
    like = heading_like(s["title"])
    accepted = nested | dotted | (s["confidence"] >= 0.95) | like | F.col("statutory")
    kinds = (
        F.when(F.col("line") == "", "BLANK")
        .when(s.isNull(), "BODY")
        .when(s["type"].isin("subsection", "nested_clause"), "CHILD_PART")
        .when((s["type"] == "section") & nested, "CHILD_WHOLE")
        .when(s["type"] == "frontmatter", "FRONT")
        .when(s["type"].isin("heading", "judgment_heading"), "HEADING")
        .when(s["type"].isin(*HEADING_TYPES), "NUMBERED_HEADING")
        .when(~accepted, "BODY")
        .when(like, "SECTION_HEADING")
        .when((s["confidence"] == 0.95) & ~dotted, "SECTION_INLINE")
        .when(dotted, "SECTION_DOTTED")
        .otherwise("SECTION_TOP")
    )
    lined = classify_lines(pages).withColumn("statutory", F.max(statutory_line(F.col("line"))).over(doc)).withColumn("kind", kinds)
    leading = kind.isin("CHILD_PART", "CHILD_WHOLE", "FRONT", "HEADING", "NUMBERED_HEADING", "SECTION_HEADING", "SECTION_INLINE")
    # Titles that follow each other without a break: the later can become part of the earlier.
    runs = (
        lined.withColumn("_lead", leading)
        .withColumn("_after", F.col("_lead") & F.coalesce(F.lag(kind.isin("HEADING", "NUMBERED_HEADING", "SECTION_HEADING")).over(order), F.lit(False)))
        .withColumn("_run", F.sum((F.col("_lead") & ~F.col("_after")).cast("int")).over(upto))
    )
    in_run = Window.partitionBy("document_id", "_run").orderBy("page_number", "pos").rowsBetween(Window.unboundedPreceding, -1)
    bare = kind.isin("FRONT", "HEADING")
    sets = (
        runs.withColumn("_joins", bare & F.col("_after") & F.coalesce(F.max(F.col("_lead") & ~bare).over(in_run), F.lit(False)))
        .withColumn("_set", F.col("_lead") & ~F.col("_joins"))
        .withColumn("_state", F.col("_set") | kind.isin("SECTION_TOP", "SECTION_DOTTED"))
    )
    own = F.when(~bare, s["identifier"])
    parent = F.last(F.when(F.col("_state") & (kind != "CHILD_PART"), F.struct(own.alias("id"))), ignorenulls=True).over(upto)["id"]
    identified = sets.withColumn("_id", F.when(kind == "CHILD_PART", composed(parent, s["identifier"])).otherwise(own))
    label = F.when(kind == "FRONT", F.concat(F.lit("FRONTMATTER:"), s["identifier"])).otherwise(F.col("_id"))
    title = F.when(kind.startswith("CHILD"), F.concat("_id", F.lit(". "), s["title"])).otherwise(s["title"])
    stated = (
        identified.withColumn("section", F.last(F.when(F.col("_state"), F.struct(label.alias("v"))), ignorenulls=True).over(upto)["v"])
        .withColumn("_nth", F.sum(F.col("_set").cast("int")).over(upto))
        .withColumn("_title", F.when(F.col("_set") | F.col("_joins"), title))
        .withColumn("para", F.sum((kind != "BODY").cast("long")).over(upto))
    )
    within = Window.partitionBy("document_id", "_nth").orderBy("page_number", "pos").rowsBetween(Window.unboundedPreceding, 0)
    dropped = F.max((kind == "SECTION_TOP") & (F.col("_nth") > 0)).over(within) & F.first(kind.startswith("CHILD")).over(within)
    headed = stated.withColumn("heading", F.when((F.col("_nth") > 0) & ~dropped, F.array_join(F.collect_list("_title").over(within), " ")))
    carried = headed.filter(~kind.isin("BLANK", "HEADING", "NUMBERED_HEADING", "SECTION_HEADING"))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "pos", "line")))
    return (
        carried.groupBy("document_id", "para")
        .agg(
            strip(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"),
            F.min("page_number").alias("page_number"),
            F.max("page_number").alias("end_page_number"),
            F.any_value("section").alias("section"),
            F.any_value("heading").alias("heading"),
        )
        .filter("text <> ''")
    )


def islands(rows: DataFrame, by: list[str], order: list[str], same: list[str]) -> DataFrame:
    """Numbers runs of neighbours (within by, along order) that agree in all of same, null equal to null: ``island`` from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = F.row_number().over(w) == 1
    change = first
    for c in same:
        change = change | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return rows.withColumn("_new", change.cast("long")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
