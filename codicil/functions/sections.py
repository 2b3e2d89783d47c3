"""Section identifiers: 2, 2A, 2(d), 2(d)(ii)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: number, letter, roman numeral.
SECTION = r"(?i)^(\d+[A-Za-z]?)(?:\(([a-z])\))?(?:\(([ivxlcdm]+)\))?$"


def parsed(section: Column) -> Column:
    """struct(section_number, subsection, clause, structure_path); what is no such identifier is all number."""
    part = lambda i: F.nullif(F.regexp_extract(section, SECTION, i), F.lit(""))
    known = section.isNotNull() & (section != "")
    number = F.when(known, F.coalesce(part(1), section))
    sub, clause = F.lower(part(2)), F.lower(part(3))
    return F.struct(
        number.alias("section_number"),
        sub.alias("subsection"),
        clause.alias("clause"),
        F.array_compact(F.array(number, sub, clause)).alias("structure_path"),
    )


def composed(parent: Column, child: Column) -> Column:
    """The child's identifier under the number that the parent begins with; the bare child without one."""
    return F.concat(F.regexp_extract(F.coalesce(parent, F.lit("")), r"^(\d+[A-Za-z]?)", 1), child)
