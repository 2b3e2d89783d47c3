"""Text functions as Column expressions; all run inside the JVM.

Patterns carry ``(?U)`` so that \\w, \\s and \\b follow Unicode, and ``(?d)`` where only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern, typographic characters and their plain forms, line ends.
TOKEN = r"(?U)\b[\w\-.]+\b"
FANCY = "\u2018\u2019\u201c\u201d\u2013\u2014"
PLAIN = "''\"\"--"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"


def tokens(text: Column) -> Column:
    """Lower-cased search tokens of two or more characters; identifiers such as 12.4 stay whole. Null gives []."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= 2)


def squeeze(text: Column) -> Column:
    """White-space runs become one space, ends are stripped."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """The form in which spans are compared: plain quotes and dashes, single spaces, lower case."""
    return F.lower(squeeze(F.translate(text, FANCY, PLAIN)))


def split_spans(spans: Column) -> Column:
    return F.transform(F.split(spans, r" \|\|\| "), lambda s: F.btrim(s))


def span_matches(text: Column, span: Column) -> Column:
    """Whether the normalised span lies in the normalised text; false where either is empty or null."""
    t, s = normalized(F.coalesce(text, F.lit(""))), normalized(F.coalesce(span, F.lit("")))
    return (t != "") & (s != "") & F.contains(t, s)


def any_span_matches(text: Column, spans: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: span_matches(text, s)), F.lit(False))


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])(?U:\s)+"), lambda s: strip(s))
    return F.filter(parts, lambda s: s != "")


def lines(text: Column) -> Column:
    """Lines without their ends; a trailing line end opens no further line, and an empty text has none."""
    parts = F.split(text, LINE_END, -1)
    whole = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(text) > 0, whole).otherwise(F.array().cast("array<string>"))


def has_alnum(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{N}]")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def occurrences(text: Column, term: Column) -> Column:
    """How often term occurs in text without overlap; 0 for an empty term."""
    gone = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, gone / F.length(term)).otherwise(F.lit(0)).cast("int")


def truncated(text: Column, most: Column) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, F.lit(1), F.greatest(most - 3, F.lit(0))), F.lit("...")))


def source_numbers(answer: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[SOURCE_(\d+)\]"), F.lit(1))


def quoted(query: Column) -> Column:
    return F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))


def line_number(text: Column, before: Column) -> Column:
    """1-based line of a position, before which there are so many characters."""
    return F.regexp_count(F.substring(text, F.lit(1), before), F.lit("\n")) + 1


def actor_name(name: Column) -> Column:
    bare = F.regexp_replace(squeeze(name), r"(?i)^(the|a|an)\s+", "")
    return F.array_join(F.transform(F.split(bare, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " ")


def category(raw: Column) -> Column:
    """A directory-safe category name."""
    safe = F.btrim(F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"[^A-Za-z0-9._ -]+", "_"), F.lit(" ."))
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("uncategorized"))


def refused(answer: Column) -> Column:
    return F.contains(F.lower(F.coalesce(answer, F.lit(""))), F.lit("could not find this information"))


def json_anchors(reply: Column) -> Column:
    """The list of non-blank strings between the first [ and the last ]; null if there is none."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<string>")
    return F.when(F.forall(found, lambda a: F.coalesce(strip(a) != "", F.lit(False))), found)
