"""Years and source rules read from loose citation text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Year and century patterns.
YEAR = r"(?i)(\d{1,4})\s*(BCE|BC|CE|AD)\b"
CENTURY = r"(?i)(\d{1,2})(?:st|nd|rd|th)?\s*(?:c\.|century)\s*(BCE|BC|CE|AD)\b"

# Evidence strata, inclusive year bounds.
STRATA = (
    ("archaic", None, -480),
    ("classical", -479, -323),
    ("hellenistic", -322, -31),
    ("early_imperial", -30, 170),
)
NEVER_EARLY, NEVER_LATE = 200, -1400


def latest_year(text: Column) -> Column:
    """Latest year named in the text (BCE negative), null when none is."""

    def hits(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    def before(era: Column) -> Column:
        return F.upper(era).isin("BCE", "BC")

    years = F.zip_with(
        hits(YEAR, 1), hits(YEAR, 2), lambda n, e: F.when(before(e), -n.cast("int")).otherwise(n.cast("int"))
    )
    centuries = F.zip_with(
        hits(CENTURY, 1),
        hits(CENTURY, 2),
        lambda n, e: F.when(before(e), -((n.cast("int") - 1) * 100 + 1)).otherwise(n.cast("int") * 100),
    )
    return F.array_max(F.concat(years, centuries))


def stratum(year: Column, strata=STRATA) -> Column:
    """Name of the stratum a year falls in; null outside all of them."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, low, high in strata:
        inside = year <= high if low is None else (year >= low) & (year <= high)
        out = out.when(inside, F.lit(name))
    return out


def evidence_reason(source: Column, year: Column, excluded: list[str], name: str, cutoff: int) -> Column:
    """Why a dated source is not usable evidence; null when it is."""
    low = F.lower(F.coalesce(source, F.lit("")))
    banned = F.lit(False)
    for word in excluded:
        banned = banned | F.contains(low, F.lit(word))
    return (
        F.when(banned, f"{name}_source")
        .when(year.isNull(), "unknown_source_date")
        .when(year >= cutoff, f"source_not_pre_{name}")
    )
