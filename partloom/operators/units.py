"""Quantities recorded in different units, converted to the canonical unit of their key.

Plain SQL expressions: one regular expression finds the number, one the unit; the unit's spelling is normalised by a
broadcast join with the alias table (a fixed table of under 200 rows), then value * factor + offset is applied.
No shuffle takes place, so no key, source or value can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.numbers import NUMBER, parse_number
from partloom.functions.text import attribute_key
from partloom.functions.units import UNIT_TOKEN, join_unit, unit_alias, unit_table

#: the first number (group 1) and the unit right behind it (group 2)
_NUMBER_UNIT = rf"({NUMBER})\s*({UNIT_TOKEN})?"
_BRACKET = r"\[([^\]]*)\]"


def _plain(c: Column) -> Column:
    """Nothing but digits and points: the common case, which needs no regular expression."""
    return F.translate(c, "0123456789.", "") == ""


def _number_text(c: Column) -> Column:
    t = F.when(c.contains("["), F.regexp_replace(c, _BRACKET, " ")).otherwise(c)
    x = F.regexp_extract(t, _NUMBER_UNIT, 1)
    return F.when(_plain(c) & (c != ""), c).otherwise(F.when(x != "", x))


def first_number(c: Column) -> Column:
    """The first number of a text, remarks in square brackets left out; null where there is none."""
    return parse_number(_number_text(c))


def _unit_text(c: Column) -> Column:
    inside = unit_alias(F.regexp_extract(c, _BRACKET, 1))
    behind = unit_alias(F.regexp_extract(c, _NUMBER_UNIT, 2))
    return F.when(~_plain(c), F.when(c.contains("["), inside).otherwise(behind))


def stated_quantity(df: DataFrame, value: str, unit: str | None, raw_text: str | None, source_default: str | None = None, only: Column | None = None) -> DataFrame:
    """Number, dimension, factor and offset stated by a row; adds ``q_number q_dim q_factor q_offset``.

    ``value`` gives the number, or ``raw_text`` when ``value`` states none. The unit is the first known one of: the one
    in ``raw_text``, the one in ``value``, the ``unit`` column, the column ``source_default``. A token that is no known
    unit counts as no unit. Rows where ``only`` is not true are not read (all four columns null). Rows keep their other columns; a null, blank or filler text states nothing.
    """
    units = unit_table(df.sparkSession)
    read = lambda c: F.when(only, F.col(c)) if only is not None else F.col(c)
    v = read(value)
    r = read(raw_text) if raw_text else F.lit(None).cast("string")
    out = df.withColumn("_v", v).withColumn("_r", r)
    out = out.withColumn("_num", F.coalesce(_number_text(F.col("_v")), _number_text(F.col("_r"))))
    tokens = {"_ru": _unit_text(F.col("_r")), "_vu": _unit_text(F.col("_v"))}
    tokens["_uu"] = unit_alias(F.col(unit)) if unit else F.lit(None).cast("string")
    tokens["_du"] = unit_alias(F.col(source_default)) if source_default else F.lit(None).cast("string")
    used = [k for k in tokens if not (k == "_uu" and unit is None or k == "_du" and source_default is None or k == "_ru" and raw_text is None)]
    out = out.withColumns({k: tokens[k] for k in used})
    for k in used:
        out = join_unit(out, k, units, f"q{k}")
    pick = lambda what: F.coalesce(*[F.col(f"q{k}_{what}") for k in used])
    out = out.withColumns({"q_number": parse_number(F.col("_num")), "q_dim": pick("dim"), "q_factor": pick("factor"), "q_offset": pick("offset")})
    return out.drop("_v", "_r", "_num", *used, *[f"q{k}_{w}" for k in used for w in ("dim", "factor", "offset")])


def canonical_units(specs: DataFrame) -> DataFrame:
    """One row per attribute key that has a canonical unit: key, dimension, factor and offset of that unit."""
    units = unit_table(specs.sparkSession)
    keys = specs.where(F.col("canonical_unit").isNotNull()).select(attribute_key(F.col("canonical_key")).alias("c_key"), "canonical_unit").dropDuplicates(["c_key"])
    return join_unit(keys, "canonical_unit", units, "c").where(F.col("c_dim").isNotNull())


def to_canonical_units(df: DataFrame, specs: DataFrame, key: str, value: str, unit: str | None = "unit", raw_text: str | None = "raw_text", source_default: str | None = None) -> DataFrame:
    """Every row of ``df`` with ``canonical_value`` (double) and ``canonical_unit`` of its key.

    Both are null when the key has no canonical unit, no number can be read, or no unit of the right dimension is
    stated. Repeated rows stay repeated; columns of ``df`` named like the working columns (``q_*``, ``c_*``, ``_*``)
    must not occur, ``canonical_value`` and ``canonical_unit`` are replaced if they do. An empty table gives an empty table.
    """
    base = df.drop("canonical_value", "canonical_unit").withColumn("_key", attribute_key(F.col(key)))
    joined = base.join(F.broadcast(canonical_units(specs)), F.col("_key") == F.col("c_key"), "left")
    x = stated_quantity(joined, value, unit, raw_text, source_default, only=F.col("c_key").isNotNull())
    ok = F.col("q_dim") == F.col("c_dim")
    # the difference of the offsets first: the same unit then gives the number itself
    same = (F.col("q_factor") == F.col("c_factor")) & (F.col("q_offset") == F.col("c_offset"))
    converted = (F.col("q_number") * F.col("q_factor") + (F.col("q_offset") - F.col("c_offset"))) / F.col("c_factor")
    return x.withColumn("canonical_value", F.when(ok, F.when(same, F.col("q_number")).otherwise(converted))).drop(
        "_key", "c_key", "c_dim", "c_factor", "c_offset", "q_number", "q_dim", "q_factor", "q_offset"
    )


def value_milli(c: Column) -> Column:
    """1000 times a value, to the nearest integer; the tenth decimal is cut first, so that 2.0004999999 counts as 2.0005."""
    return F.round(F.round(c * 1000, 7), 0).cast("bigint")
