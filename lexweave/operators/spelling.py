"""Scanning and rewriting texts by spelling policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

HEAD = r"[A-Za-z]+|[^A-Za-z]"
BEFORE, AFTER = r"(?<![A-Za-z])", r"(?![A-Za-z])"


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), term, F.lit(r"\E"))


def _first_piece(term: Column) -> Column:
    return F.regexp_substr(term, F.lit(HEAD))


def _relevant(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """(key, variant, …) for the rules whose first word occurs in the text.

    Texts and rules meet on that word, so the cost follows the matches, not
    texts × rules, and the dictionary may be of any size.
    """
    pieces = F.array_distinct(F.regexp_extract_all(text, F.lit(HEAD), F.lit(0)))
    words = texts.select(key, F.explode(pieces).alias("_head"))
    return words.join(rules.withColumn("_head", _first_piece(F.col("variant"))), "_head").drop("_head")


def replace_many(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """Replace every rule's variant (variant, target) as a whole word in one
    pass, longest variant first.  Adds ``replaced``; each text only sees the
    rules that can occur in it."""
    rel = _relevant(texts, key, text, rules).groupBy(key).agg(
        F.array_sort(F.collect_set(F.struct((-F.length("variant")).alias("l"), "variant", "target"))).alias("_rules"))
    joined = texts.join(rel, key, "left")
    alternatives = F.array_join(F.transform("_rules", lambda r: _quoted(r["variant"])), "|")
    pattern = F.concat(F.lit(BEFORE + "(?:"), alternatives, F.lit(")" + AFTER))
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(F.col(text), pattern, F.lit(-1))
    lookup = F.map_from_entries(F.transform("_rules", lambda r: F.struct(r["variant"], r["target"])))
    prepared = joined.withColumn("_hits", hits).withColumn("_gaps", gaps).withColumn("_map", lookup)
    fixed = F.array_join(
        F.zip_with(F.col("_gaps"), F.col("_hits"), lambda g, h: F.concat(g, F.coalesce(F.col("_map")[h], F.lit("")))), "")
    has = F.col("_rules").isNotNull()
    return prepared.select(
        *[F.when(has, fixed).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in texts.columns],
        F.when(has, F.size("_hits")).otherwise(0).alias("replaced"))


def findings(texts: DataFrame, key: str, text: str, policies: DataFrame, width: int = 80) -> DataFrame:
    """Every occurrence of a deprecated variant (variant, target): position and snippet."""
    rel = _relevant(texts, key, text, policies).distinct().join(texts, key)
    pattern = F.concat(F.lit(BEFORE), _quoted(F.col("variant")), F.lit(AFTER))
    gaps = F.split(F.col(text), pattern, F.lit(-1))
    # start of the i-th hit: lengths of the gaps before it plus earlier hits,
    # as running sums over the gap lengths
    width_of = F.length("variant")
    starts = tx.let(
        F.transform(gaps, lambda g: F.length(g)),
        lambda ls: F.aggregate(
            F.slice(ls, F.lit(1), F.size(ls) - 1),
            F.array().cast("array<int>"),
            lambda acc, x: F.concat(
                acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)) + width_of, F.lit(0)) + x)),
        ),
    )
    rows = rel.where(F.rlike(text, pattern)).select(key, "variant", "target", text, F.explode(starts).alias("start"))
    end = F.col("start") + F.length("variant")
    return rows.select(key, "variant", "target", "start", tx.snippet(F.col(text), F.col("start"), end, width).alias("snippet"))


def apply_policy(texts: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """Only the rows a policy changes, with old and new text."""
    after = replace_many(texts.select(key, text), key, text, rules).where("replaced > 0")
    return after.select(key, F.col(text).alias("new_text"), "replaced").join(
        texts.select(key, F.col(text).alias("old_text")), key).where("new_text <> old_text")
