"""Obligations, rights, conditions, deadlines, penalties and risks from clause text, by patterns in the JVM.

Matches of all patterns of a family come out of one projection per clause and are exploded once. Where a
match begins is found by searching its own text from the end of the match before it: the leftmost match
is the first occurrence of its text, so no position is needed from the pattern engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import actor_name, strip

# The patterns. Ends have no word boundary, and actors are any run of letters and spaces.
FLAGS = "(?isUd)"
ACTOR = r"([A-Z][A-Za-z\s]+?)\s+"
END = r"(.+?)(?=(?:unless|if|provided|;|or|\.|\n|$))"
OBLIGATIONS = (
    ("obligation_shall", ACTOR + r"shall\s+" + END, "MUST"),
    ("obligation_must", ACTOR + r"must\s+" + END, "MUST"),
    ("obligation_will", ACTOR + r"will\s+" + END, "MUST"),
    ("obligation_agrees", ACTOR + r"agrees?\s+to\s+" + END, "MUST"),
    ("obligation_responsible", ACTOR + r"is\s+responsible\s+for\s+" + END, "MUST"),
    ("obligation_required", ACTOR + r"(?:is\s+)?required\s+to\s+" + END, "MUST"),
    ("obligation_required_within", ACTOR + r"(?:is\s+)?required\s+(within\s+.+?)(?=(?:unless|if|provided|;|or|\.|\n|$))", "MUST"),
    ("obligation_should", ACTOR + r"should\s+" + END, "SHOULD"),
    ("obligation_liable", ACTOR + r"(?:is\s+|shall\s+be\s+)?liable\s+for\s+" + END, "MUST"),
)
RIGHTS = (
    ("right_may", ACTOR + r"may\s+" + END, "MAY"),
    ("right_can", ACTOR + r"can\s+" + END, "MAY"),
    ("right_has_right_to", ACTOR + r"has\s+the\s+right\s+to\s+" + END, "MAY"),
    ("right_entitled", ACTOR + r"(?:is\s+)?entitled\s+to\s+" + END, "MAY"),
    ("right_permitted", ACTOR + r"(?:is\s+)?permitted\s+to\s+" + END, "MAY"),
)
CONDITIONS = (
    ("condition_if", r"(?:if|when)\s+(.+?)(?:,?\s+then|\s+the|\.|\n|$)", "trigger"),
    ("condition_unless", r"(?:unless|except\s+(?:if|that)|except\s+when)\s+(.+?)(?:\.|,|$|\n)", "limitation"),
    ("condition_provided", r"provided\s+(?:that)?\s+(.+?)(?:\.|,|$|\n)", "concurrent"),
    ("condition_upon", r"(?:upon|on)\s+(.+?)(?:,?\s+(?:the|[A-Z])|\.|\n|$)", "trigger"),
    ("condition_in_event", r"(?:in\s+(?:the\s+)?event\s+of|in\s+case\s+of)\s+(.+?)(?:,|\.|$|\n)", "trigger"),
    ("condition_contingent", r"(?:contingent\s+upon|subject\s+to|conditioned\s+(?:upon|on))\s+(.+?)(?:,|\.|$|\n)", "concurrent"),
)
OWN_CONDITIONS = (
    ("unless", r"(?iU)unless\s+(.+?)(?:\.|$)", "limitation"),
    ("if", r"(?iU)if\s+(.+?)(?:,|\.|\s+then|$)", "trigger"),
    ("provided that", r"(?iU)provided\s+(?:that)?\s+(.+?)(?:\.|$)", "concurrent"),
)
WITHIN = r"(?iU)within\s+(\d+)\s+(business\s+)?days?(?:\s+of)?"
BY_DATE = r"(?iU)by\s+(\w+\s+\d{1,2},?\s+\d{4})"
LATE_FEE = r"(?iU)(?:late\s+)?(?:fee|penalty|interest)\s+(?:of|at|is)?\s+([0-9.]+)%\s*(?:per\s+)?(\w+)?"
LIMITATION = r"(?iU)(?:only\s+)?(?:if|except)\s+(.+?)(?:\.|,|$|\n)"
DEADLINES = (
    ("deadline_by_date", r"(?iU)(?:by|before|on|no\s+later\s+than)\s+(\d{1,2})\s+([A-Za-z]+)\s+,?\s*(\d{4})"),
    ("deadline_within", r"(?iU)(?:within|in)\s+(\d+)\s+(business\s+)?days?(?:\s+of)?"),
    ("deadline_after", r"(?iU)(?:after|following)\s+(\d+)\s+(business\s+)?days?(?:\s+of)?"),
    ("deadline_of_event", r"(?isUd)(?:within|within\s+\d+\s+days\s+of|upon)\s+([A-Za-z\s]+?)(?:\.|,|$|\n)"),
    ("deadline_quarterly", r"(?iU)(?:quarterly|semi-annually?|annually?|monthly?|weekly?)"),
)
PENALTIES = (
    ("penalty_late_fee", r"(?iU)(?:late\s+)?(?:fee|charge|penalty|interest)\s+(?:of|at|is)?\s+([0-9.]+)%\s*(?:per\s+)?(\w+)?"),
    ("penalty_termination", r"(?iU)(?:breach|failure|non-compliance)\s+(?:shall\s+)?(?:result\s+)?(?:in|allows?)\s+(?:immediate\s+)?termination"),
    ("penalty_liability", r"(?iU)(?:liable|responsible)\s+(?:for\s+)?(.+?)(?:damages?|liability|losses?)"),
)
#: In order; the last rule that holds names the level, and all that hold give their categories.
RISKS = (
    (("unlimited", "indemnify", "liable", "responsible"), "CRITICAL", "legal"),
    (("pay", "payment", "fee", "cost", "liability"), "HIGH", "financial"),
    (("terminate", "termination", "breach"), "CRITICAL", "termination"),
    (("confidential", "secret", "proprietary"), "HIGH", "compliance"),
    (("deadline", "within", "days", "must"), "MEDIUM", "operational"),
)
#: Words of which one is in every match of a pattern: clauses without them are not searched.
SIGNS = {
    "obligation_shall": ("shall",), "obligation_must": ("must",), "obligation_will": ("will",), "obligation_agrees": ("agree",),
    "obligation_responsible": ("responsible",), "obligation_required": ("required",), "obligation_required_within": ("required",),
    "obligation_should": ("should",), "obligation_liable": ("liable",), "right_may": ("may",), "right_can": ("can",),
    "right_has_right_to": ("right",), "right_entitled": ("entitled",), "right_permitted": ("permitted",), "condition_if": ("if", "when"),
    "condition_unless": ("unless", "except"), "condition_provided": ("provided",), "condition_upon": ("on",),
    "condition_in_event": ("event", "case"), "condition_contingent": ("contingent", "subject", "conditioned"),
}
LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _starts(text: Column, found: Column) -> Column:
    """1-based starts of successive matches, given their texts."""
    begin = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, match: Column) -> Column:
        start = F.position(match, text, state["at"])
        return F.struct((start + F.length(match)).alias("at"), F.concat(state["starts"], F.array(start)).alias("starts"))

    return F.aggregate(found, begin, step, lambda s: s["starts"])


def _matches(clauses: DataFrame, patterns: tuple, groups: int, flags: str = "") -> DataFrame:
    """One row per match of each pattern, in order of patterns and places: pattern, tag, g0.., start, _order.

    Each pattern is searched once, for whole matches; groups come from those. A match ends where its
    pattern's look-ahead first holds, so the pattern matches the match alone in the same way.
    """
    text = F.coalesce("text", F.lit(""))

    def searched(name: str, pattern: str) -> Column:
        found, signs = _all(text, flags + pattern, 0), SIGNS.get(name, ())
        return F.when(_holds(F.lower(text), signs), found).otherwise(F.array().cast("array<string>")) if signs else found

    def of(i: int, name: str, pattern: str, tag: str | None = None) -> Column:
        zipped = F.arrays_zip(F.col(f"_p{i}").alias("g0"), _starts(text, F.col(f"_p{i}")).alias("start"))
        fixed = {"pattern_no": F.lit(i), "pattern": F.lit(name), "tag": F.lit(tag).cast("string")}
        group = lambda m, g: F.regexp_extract(m["g0"], flags + pattern, g).alias(f"g{g}")
        return F.transform(
            zipped, lambda m: F.struct(*[c.alias(k) for k, c in fixed.items()], m["g0"].alias("g0"), *[group(m, g) for g in range(1, groups + 1)], m["start"].alias("start"))
        )

    found = clauses.withColumns({f"_p{i}": searched(p[0], p[1]) for i, p in enumerate(patterns)})
    parts = [of(i, *p) for i, p in enumerate(patterns)]
    rows = found.select(*clauses.columns, F.posexplode(F.concat(*parts)).alias("_order", "_m"))
    return rows.select("*", "_m.*").drop("_m")


def _holds(low: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(low, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(low, F.lit(p))
    return out


def deadline(action: Column) -> Column:
    """struct(type, value) of a term in days, else of a date; null without."""
    days = F.regexp_extract(action, WITHIN, 1)
    business = F.contains(F.regexp_extract(action, WITHIN, 2), F.lit("business"))
    date = F.regexp_extract(action, BY_DATE, 1)
    return (
        F.when(days != "", F.struct(F.lit("relative").alias("type"), F.concat(days, F.when(business, " business days").otherwise(" days")).alias("value")))
        .when(date != "", F.struct(F.lit("absolute").alias("type"), date.alias("value")))
    )


def penalty(action: Column) -> Column:
    rate, period = F.regexp_extract(action, LATE_FEE, 1), F.regexp_extract(action, LATE_FEE, 2)
    return F.when(rate != "", F.concat(rate, F.lit("% per "), F.coalesce(F.nullif(period, F.lit("")), F.lit("month"))))


def own_conditions(action: Column) -> Column:
    """array of struct(type, description) named in the action itself."""
    found = [
        F.when(
            F.contains(F.lower(action), F.lit(word)) & action.rlike(pattern),
            F.struct(F.lit(kind).alias("type"), strip(F.regexp_extract(action, pattern, 1)).alias("description")),
        )
        for word, pattern, kind in OWN_CONDITIONS
    ]
    return F.array_compact(F.array(*found))


def _deontic(clauses: DataFrame, patterns: tuple, mark: str) -> DataFrame:
    """Actor, action, evidence of each match; ids count the matches that are kept, across patterns."""
    found = _matches(clauses, patterns, 2, FLAGS).withColumns({"actor": actor_name(F.col("g1")), "action": strip(F.col("g2"))}).filter(F.length("action") >= 3)
    begin = F.col("start") - 1
    text = F.col("text")
    quote_from = F.greatest(begin - 100, F.lit(0))
    quote = F.substring(text, quote_from + 1, begin + F.length("g0") + 100 - quote_from)
    order = Window.partitionBy("chunk_id").orderBy("_order")
    return found.withColumns(
        {
            "n": F.row_number().over(order) - 1,
            "line_number": (F.regexp_count(F.substring(text, F.lit(1), begin), F.lit("\n")) + 1),
            "quote": strip(quote),
        }
    ).withColumn("id", F.concat("chunk_id", F.lit(f"-{mark}-"), F.col("n").cast("string")))


def obligations(clauses: DataFrame) -> DataFrame:
    """clauses (chunk_id, text) -> obligations with severity, deadline, penalty, conditions and evidence."""
    return _deontic(clauses, OBLIGATIONS, "ob").select(
        F.col("id").alias("obligation_id"), "chunk_id", "n", "pattern", "actor", "action", F.col("tag").alias("severity"),
        deadline(F.col("action"))["type"].alias("deadline_type"), deadline(F.col("action"))["value"].alias("deadline"),
        penalty(F.col("action")).alias("penalty"), own_conditions(F.col("action")).alias("conditions"), "line_number", "quote",
        F.lit(0.8).alias("confidence"),
    )


def rights(clauses: DataFrame) -> DataFrame:
    """clauses -> rights with conditions, limitation and evidence."""
    limit = F.when(F.col("action").rlike(LIMITATION), strip(F.regexp_extract("action", LIMITATION, 1)))
    return _deontic(clauses, RIGHTS, "rt").select(
        F.col("id").alias("right_id"), "chunk_id", "n", "pattern", "actor", "action", own_conditions(F.col("action")).alias("conditions"),
        limit.alias("limitation"), "line_number", "quote", F.lit(0.8).alias("confidence"),
    )


def _firsts(rows: DataFrame, by: list, order: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def conditions(clauses: DataFrame) -> DataFrame:
    """Standalone conditions, the first of each description and type of a clause."""
    found = _matches(clauses, CONDITIONS, 1, FLAGS).withColumn("description", strip(F.col("g1")))
    first = _firsts(found, ["chunk_id", F.lower("description"), "tag"], "_order")
    return first.select("chunk_id", F.col("_order").alias("n"), "pattern", F.col("tag").alias("condition_type"), "description", F.lit(0.75).alias("confidence"))


def deadlines(clauses: DataFrame) -> DataFrame:
    return _matches(clauses, DEADLINES, 0).select("chunk_id", F.col("_order").alias("n"), "pattern", F.col("g0").alias("match"), "start")


def penalties(clauses: DataFrame) -> DataFrame:
    return _matches(clauses, PENALTIES, 0).select("chunk_id", F.col("_order").alias("n"), "pattern", F.col("g0").alias("match"), "start")


def both(obligation_rows: DataFrame, right_rows: DataFrame) -> DataFrame:
    """Obligations, then rights, of each clause: source, n, obligation_id (null for rights), actor, action, confidence."""
    common = lambda df, source, oid: df.select("chunk_id", F.lit(source).alias("source"), "n", oid.alias("obligation_id"), "actor", "action", "confidence")
    return common(obligation_rows, 0, F.col("obligation_id")).unionByName(common(right_rows, 1, F.lit(None).cast("string")))


def actors(rows: DataFrame) -> DataFrame:
    """Distinct actors of a clause, in order of their first mention."""
    return _firsts(rows.withColumn("_at", F.struct("source", "n")), ["chunk_id", "actor"], "_at").select("chunk_id", "actor", F.col("_at.source").alias("source"), F.col("_at.n").alias("n"))


def risks(rows: DataFrame) -> DataFrame:
    """A risk for every obligation and right."""
    low = F.lower("action")

    level = F.lit("MEDIUM")
    for words, name, _ in RISKS:  # a later rule stands outside the earlier ones
        level = F.when(_holds(low, words), name).otherwise(level)
    found = F.array_compact(F.array(*[F.when(_holds(low, words), F.lit(cat)) for words, _, cat in RISKS]))
    order = Window.partitionBy("chunk_id").orderBy("source", "n")
    return rows.withColumn("_i", F.row_number().over(order) - 1).select(
        F.concat("chunk_id", F.lit("-risk-"), F.col("_i").cast("string")).alias("risk_id"), "chunk_id", "obligation_id", level.alias("risk_level"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("operational"))).alias("risk_categories"), F.lit("POSSIBLE").alias("probability"),
        F.concat(F.lit("Risk in: "), F.substring("action", 1, 50)).alias("description"), F.lit(0.7).alias("confidence"),
    )


def risk_summary(rows: DataFrame) -> DataFrame:
    """Per clause the number of risks of each of the four levels."""
    return rows.groupBy("chunk_id").agg(*[F.count_if(F.col("risk_level") == x).alias(x.lower()) for x in LEVELS])


def overall_confidence(clauses: DataFrame, rows: DataFrame) -> DataFrame:
    """Mean confidence of a clause's obligations and rights; 0.7 where it has none."""
    mean = rows.groupBy("chunk_id").agg(F.avg("confidence").alias("_c"))
    return clauses.select("chunk_id").join(mean, "chunk_id", "left").select("chunk_id", F.round(F.coalesce("_c", F.lit(0.7)), 6).alias("confidence"))
