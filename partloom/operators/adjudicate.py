"""Competing values: grouping by normalised value, scoring by evidence, ranking, and conflict between equals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.text import categorical, is_not_stated

# The constants of the evidence score.
LOCATOR_SCORE = {"table_cell": 1.00, "structured_field": 0.85, "prose": 0.55, "inferred": 0.25}
TIER_SCORE = {"table": 1.00, "llm": 0.75, "rule": 0.70}
AUTHORITY_SCORE = {1: 1.00, 2: 0.80, 3: 0.65, 4: 0.45, 5: 0.30, 6: 0.15}
WEIGHTS = {"locator": 0.40, "authority": 0.35, "agreement": 0.15, "tier": 0.10}
MARGIN = 0.15


def _scored(c: Column, table: dict, default: float) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def evidence_score(locator: Column, authority: Column, tier: Column) -> Column:
    return WEIGHTS["locator"] * _scored(locator, LOCATOR_SCORE, 0.2) + WEIGHTS["authority"] * _scored(authority, AUTHORITY_SCORE, 0.1) + WEIGHTS["tier"] * _scored(tier, TIER_SCORE, 0.5)


def value_key(number: Column, text: Column, dimension: Column | None = None) -> Column:
    """``q:``, the canonical number to 6 decimals and its dimension, else ``c:`` and the text in one spelling; null when nothing is stated.

    ``dimension`` null is a bare number.
    """
    dim = F.coalesce(dimension, F.lit("dimensionless")) if dimension is not None else F.lit("dimensionless")
    return F.when(number.isNotNull(), F.concat(F.lit("q:"), F.format_string("%.6f", F.round(number, 6) + 0.0), F.lit(":"), dim)).when(~is_not_stated(text), F.concat(F.lit("c:"), categorical(text)))


def adjudicate(claims: DataFrame, group: list[str], key: str, item: str, source: str, authority: str, locator: str, tier: str) -> DataFrame:
    """One row per group: the winning value and how it won.

    ``key`` is the normalised value (rows with a null key take no part). A value's score is that of its best claim plus an
    agreement bonus of up to three independent sources; values are ranked by score, then key. Two leading values that
    both rest on authority 1 are a conflict (``winner`` null); a lead below 0.15 is a close call. ``winner`` is the item of the
    best claim (ties: the smallest item). Two aggregations and a window over the distinct values of a group.
    """
    score = evidence_score(F.col(locator), F.col(authority), F.col(tier))
    rows = claims.where(F.col(key).isNotNull()).select(*group, F.col(key).alias("vkey"), F.col(item).alias("item"), F.col(source).alias("source"), F.col(authority).alias("authority"), F.round(score, 6).alias("s"))
    values = rows.groupBy(*group, "vkey").agg(
        F.max("s").alias("best"), F.countDistinct("source").alias("n_sources"), F.min("authority").alias("authority"), F.count(F.lit(1)).alias("agreement"), F.min(F.struct((-F.col("s")).alias("o"), "item")).alias("b")
    )
    values = values.withColumn("score", F.round(F.col("best") + WEIGHTS["agreement"] * F.least("n_sources", F.lit(3)) / 3, 6))
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "vkey")
    ranked = values.withColumns({"rank": F.row_number().over(w), "next": F.lead("score").over(w), "next_authority": F.lead("authority").over(w), "n_values": F.count(F.lit(1)).over(Window.partitionBy(*group))}).where("rank = 1")
    conflict = F.coalesce((F.col("authority") == 1) & (F.col("next_authority") == 1), F.lit(False))
    lead = F.round(F.col("score") - F.col("next"), 6)
    return ranked.select(
        *group, F.when(~conflict, F.col("b.item")).alias("winner"), F.when(~conflict, F.col("vkey")).alias("value_key"), F.col("score").alias("top_score"), "agreement", "n_sources", "n_values",
        conflict.alias("conflict"), (~conflict & F.coalesce(lead < MARGIN, F.lit(False))).alias("close_call"),
    )


def rejected(claims: DataFrame, decided: DataFrame, group: list[str], key: str) -> DataFrame:
    """Claims of adjudicated groups whose value did not win, with the reason."""
    d = decided.select(*group, "value_key", "conflict", "close_call")
    reason = F.when(F.col("conflict"), F.lit("two sources of the first rank disagree")).when(F.col("close_call"), F.lit("close behind the winner")).otherwise(F.lit("weaker evidence"))
    return claims.join(d, group).where(F.col(key).isNotNull() & ~F.col(key).eqNullSafe(F.col("value_key"))).withColumn("reason", reason).drop("value_key", "conflict", "close_call")
