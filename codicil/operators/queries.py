"""Rule-based analysis of questions: intent, legal terms, phrases, flags. One projection, no join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.functions.text import quoted, squeeze, words

# Terms in order, with the intent that each speaks for.
TERMS = {
    "obligation": ("shall", "must", "required", "obligation", "duty", "liable", "responsible", "disclose"),
    "right": ("right", "entitled", "may", "permission", "authority", "license"),
    "condition": ("if", "condition", "conditional", "provided", "subject to", "upon"),
    "procedure": ("procedure", "process", "steps", "how", "method", "implement"),
    "definition": ("definition", "means", "mean", "defined", "definition of", "what is"),
    "scope": ("scope", "apply", "applicable", "covers", "extent"),
    "temporal": ("when", "time", "period", "duration", "effective", "date", "terminate", "expiration"),
}
NEGATIONS = ("not", "no", "never", "cannot", "can't", "won't", "shouldn't", "doesn't", "don't")
TEMPORAL = ("when", "after", "before", "during", "until", "since", "upon", "date", "time", "period", "terminate")
SECTION_NUMBER = r"(?iU)\b(\d+(?:\.\d+)*(?:\([a-z]\))?)\b"
NOT_A_PHRASE = ("that", "this", "then", "when", "what", "which")


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    out = F.contains(text, F.lit(parts[0]))
    for p in parts[1:]:
        out = out | F.contains(text, F.lit(p))
    return out


def intent(low: Column) -> Column:
    """The intent with most terms in the text, found as substrings; ties go to the earliest, then to the listed order."""
    votes = []
    for i, (name, terms) in enumerate(TERMS.items()):
        count = sum((F.contains(low, F.lit(t)).cast("int") for t in terms[1:]), F.contains(low, F.lit(terms[0])).cast("int"))
        first = F.least(*[F.when(F.contains(low, F.lit(t)), F.locate(t, low)) for t in terms])
        votes.append(F.when(count > 0, F.struct(count.alias("n"), (-first).alias("at"), F.lit(-i).alias("order"), F.lit(name).alias("name"))))
    best = F.array_max(F.array_compact(F.array(*votes)))["name"]
    fallback = F.when(_any(low, ("how", "what", "why")), "general_inquiry").when(_any(low, ("which", "where")), "scope").when(_any(low, ("when",)), "temporal").otherwise("general_inquiry")
    return F.coalesce(best, fallback)


def legal_terms(low: Column) -> Column:
    """The terms that begin a word of the text, in listed order."""
    listed = [t for terms in TERMS.values() for t in terms]
    return F.array_compact(F.array(*[F.when(low.rlike(rf"(?U)\b{t}"), F.lit(t)) for t in listed]))


def phrase(low: Column) -> Column:
    """The first two neighbouring words that are long and telling; null without."""
    w = words(low)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    listed = [t for terms in TERMS.values() for t in terms]
    good = F.filter(pairs, lambda p: (F.length(p["a"]) > 4) & ~p["a"].isin(*NOT_A_PHRASE) & (F.length(p["b"]) > 3) & ~p["b"].isin(*listed))
    first = F.get(good, F.lit(0))
    return F.when(first.isNotNull(), F.concat(first["a"], F.lit(" "), first["b"]))


def analyse(queries: DataFrame, *, strict: bool = False) -> DataFrame:
    """(query_id, query) -> the query's analysis. Blank queries are left out, or raise if strict."""
    text = squeeze(F.coalesce("query", F.lit("")))
    rows = queries.withColumn("normalized", text)
    if strict:
        rows = rows.withColumn("normalized", F.when(F.col("normalized") == "", F.raise_error(F.lit("query must not be blank"))).otherwise(F.col("normalized")))
    low = F.lower("normalized")
    terms = legal_terms(low)
    bigram = phrase(low)
    signals = F.concat(
        F.transform(terms, lambda t: F.struct(t.alias("signal"), F.lit(0.9).alias("weight"), F.lit("legal_term").alias("category"))),
        F.array_compact(F.array(F.when(bigram.isNotNull(), F.struct(bigram.alias("signal"), F.lit(0.6).alias("weight"), F.lit("noun_phrase").alias("category"))))),
    )
    return rows.filter("normalized <> ''").select(
        "query_id", "query", "normalized", intent(low).alias("intent"), terms.alias("legal_terms"),
        F.when(F.size(terms) > 0, F.nullif(F.regexp_extract("normalized", SECTION_NUMBER, 1), F.lit(""))).alias("potential_section"),
        signals.alias("signals"), quoted(F.col("query")).alias("exact_matches"), _any(low, NEGATIONS).alias("has_negation"),
        _any(low, TEMPORAL).alias("has_temporal_constraint"), F.size(words(F.col("query"))).alias("query_length"),
    )
