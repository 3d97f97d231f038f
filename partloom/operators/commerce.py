"""Titles, display values, facets, completeness and the licence of numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_text(c: Column) -> Column:
    """A number without trailing zeros: 3.0 gives ``3``, 0.25 gives ``0.25``."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")


def catalogue_fraction(c: Column, denominator: int = 16, tolerance: float = 0.01) -> Column:
    """A positive number as the nearest mixed fraction with a denominator of at most 16 (the smallest of equally near ones), within the tolerance; else as a number.

    Zero and negative numbers stay numbers; null stays null.
    """
    tries = [F.struct(F.round(F.abs(c - F.round(c * d) / d), 12).alias("gap"), F.lit(d).alias("d"), F.round(c * d).cast("bigint").alias("n")) for d in range(1, denominator + 1)]
    best = F.least(*tries)
    whole, rest, d = F.floor(best["n"] / best["d"]).cast("bigint"), best["n"] % best["d"], best["d"]
    part = F.concat(rest.cast("string"), F.lit("/"), d.cast("string"))
    text = F.when(rest == 0, whole.cast("string")).when(whole == 0, part).otherwise(F.concat(whole.cast("string"), F.lit("-"), part))
    return F.when(c.isNotNull(), F.when((c > 0) & (best["gap"] <= tolerance * c) & (best["n"] > 0), text).otherwise(number_text(c)))


def display_words(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """A title from a template; slots without a value vanish together with the blanks and commas around them."""
    out: Column = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    out = F.regexp_replace(out, r"\s+", " ")
    out = F.regexp_replace(out, r"(\s*,)+\s*(,|$)", "$2")
    return F.regexp_replace(F.regexp_replace(out, r"\s+,", ","), r"^[\s,]+|[\s,]+$", "")


def facets(cells: DataFrame, entity: str, key: str, number: str, text: str) -> DataFrame:
    """``entity, numbers, texts``: two maps per entity; of several cells of a key the greatest value is kept."""
    one = cells.groupBy(entity, key).agg(F.max(number).alias("n"), F.max(text).alias("t"))
    as_map = lambda c: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.struct(F.col(key).alias("k"), F.col(c).alias("v"))), lambda x: x["v"].isNotNull())))
    return one.groupBy(entity).agg(as_map("n").alias("numbers"), as_map("t").alias("texts"))  # as many entries as the schema has keys


def completeness(entities: DataFrame, entity: str, scope: str, cells: DataFrame, specs: DataFrame) -> DataFrame:
    """``entity, n_required, n_filled, ratio, missing, blocking``: the required keys of each entity's category that have a value.

    ``cells`` has one row per entity and filled key. ``blocking`` are the missing keys of criticality safety.
    """
    required = specs.where("required").select(F.col("category_code").alias("_scope"), F.col("canonical_key").alias("_key"), "criticality").distinct()
    need = entities.select(F.col(entity).alias("_e"), F.col(scope).alias("_s")).join(F.broadcast(required), F.col("_s") == F.col("_scope"))
    have = cells.select(F.col(entity).alias("_e"), F.col("canonical_key").alias("_key"), F.lit(1).alias("have")).distinct()
    x = need.join(have, ["_e", "_key"], "left")
    gone = F.col("have").isNull()
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("_key"))))
    return x.groupBy("_e").agg(
        F.count(F.lit(1)).alias("n_required"), F.count("have").alias("n_filled"), listed(gone).alias("missing"), listed(gone & (F.col("criticality") == "safety")).alias("blocking")
    ).select(F.col("_e").alias(entity), "n_required", "n_filled", F.round(F.col("n_filled") / F.col("n_required"), 4).alias("ratio"), "missing", "blocking")


def numbers_in(c: Column) -> Column:
    """Distinct numbers of a text in canonical form (without leading zeros before and trailing zeros behind the point)."""
    found = F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: number_text(n.cast("double"))))


def unlicensed_numbers(text: Column, licensed: Column) -> Column:
    """Numbers of a text that none of the licensed texts states."""
    return F.array_sort(F.array_except(numbers_in(text), F.coalesce(licensed, F.array().cast("array<string>"))))
