"""Checks of single values, of rules between attributes, and of values against their family."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.functions.text import compact_code, is_not_stated
from partloom.operators.wide import FALSE_WORDS, TRUE_WORDS

MIN_SIBLINGS, MAX_DEVIATION, TYPICAL_SHARE = 5, 5.0, 0.9


def span_present(df: DataFrame, chunks: DataFrame, chunk_key: Column, own_key: Column, span: str, text: str) -> DataFrame:
    """``df`` with ``span_present``: the quoted span stands in the cited chunk; false for a missing chunk or empty span."""
    c = chunks.select(own_key.alias("_ck"), F.col(text).alias("_ct")).where("_ck is not null").dropDuplicates(["_ck"])
    x = df.withColumn("_fk", chunk_key).join(c, F.col("_fk") == F.col("_ck"), "left")
    ok = F.coalesce((F.col(span) != "") & F.contains(F.col("_ct"), F.col(span)), F.lit(False))
    return x.withColumn("span_present", ok).drop("_fk", "_ck", "_ct")


def value_checks(kind: Column, number: Column, text: Column, allowed: Column, low: Column, high: Column, unit_ok: Column) -> dict[str, Column]:
    """Null where a check does not apply. Bounds are inclusive and may be given in either order."""
    lo, hi = F.least(low, high), F.greatest(low, high)
    code = compact_code(text)
    return {
        "type_ok": F.when(kind == "quantity", number.isNotNull()).when(kind == "enum", code != "").when(kind == "bool", F.lower(F.trim(text)).isin(*TRUE_WORDS, *FALSE_WORDS)).when(kind == "text", ~is_not_stated(text)),
        "unit_ok": F.when(kind == "quantity", unit_ok),
        "enum_ok": F.when(kind == "enum", F.exists(allowed, lambda a: compact_code(a) == code)),
        "range_ok": F.when((kind == "quantity") & number.isNotNull(), number.between(lo, hi)),
    }


class RuleError(ValueError):
    """A rule that uses more than comparisons of names and constants."""


_COMPARE = {ast.Eq: "=", ast.NotEq: "<>", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_ARITHMETIC = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/"}


def compile_rule(expression: str) -> tuple[str, list[str]]:
    """A rule in Python syntax as (SQL expression, names used). Anything but a whitelist of nodes raises ``RuleError``."""
    names: list[str] = []

    def go(n: ast.AST) -> str:
        if isinstance(n, ast.Expression):
            return go(n.body)
        if isinstance(n, ast.BoolOp):
            return "(" + (" AND " if isinstance(n.op, ast.And) else " OR ").join(map(go, n.values)) + ")"
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.Not, ast.USub)):
            return f"({'NOT ' if isinstance(n.op, ast.Not) else '-'}{go(n.operand)})"
        if isinstance(n, ast.BinOp) and type(n.op) in _ARITHMETIC:
            return f"({go(n.left)} {_ARITHMETIC[type(n.op)]} {go(n.right)})"
        if isinstance(n, ast.Compare):
            parts, left = [], n.left
            for op, right in zip(n.ops, n.comparators):
                if isinstance(op, (ast.In, ast.NotIn)) and isinstance(right, (ast.List, ast.Tuple)) and right.elts:
                    parts.append(f"{go(left)} {'NOT ' if isinstance(op, ast.NotIn) else ''}IN ({', '.join(map(go, right.elts))})")
                elif type(op) in _COMPARE:
                    parts.append(f"{go(left)} {_COMPARE[type(op)]} {go(right)}")
                else:
                    raise RuleError(ast.dump(n))
                left = right
            return "(" + " AND ".join(parts) + ")"
        if isinstance(n, ast.Name):
            if n.id not in names:
                names.append(n.id)
            return f"`{n.id}`"
        if isinstance(n, ast.Constant) and isinstance(n.value, (bool, int, float, str)):
            if isinstance(n.value, str):
                return "'" + n.value.replace("\\", "\\\\").replace("'", "\\'") + "'"
            return str(n.value).lower() if isinstance(n.value, bool) else repr(n.value)
        raise RuleError(ast.dump(n))

    try:
        tree = ast.parse(expression, mode="eval")
    except SyntaxError as e:
        raise RuleError(str(e)) from e
    return go(tree), names


def apply_rules(wide: DataFrame, entity: str, rules: list[dict]) -> DataFrame:
    """``entity, rule_id, severity, passed, key``: one row per entity, evaluable rule and key the rule names.

    A rule (``id, expr``, optional ``when, severity``) is evaluated where its condition holds and none of its names is null or
    absent; elsewhere it gives no row (unknown is not a failure).
    """
    found = []
    for rule in rules:
        sql, names = compile_rule(rule["expr"])
        cond, more = compile_rule(rule["when"]) if rule.get("when") else ("true", [])
        if set(names + more) - set(wide.columns):
            continue
        known = " AND ".join(f"`{n}` IS NOT NULL" for n in [*names, *more]) or "true"
        found.append(F.struct(F.lit(rule["id"]).alias("rule_id"), F.lit(rule.get("severity", "error")).alias("severity"), F.expr(f"CASE WHEN {known} THEN CASE WHEN {cond} THEN {sql} END END").alias("passed"), F.array(*[F.lit(n) for n in names]).alias("keys")))
    kind = "array<struct<rule_id:string,severity:string,passed:boolean,keys:array<string>>>"
    rows = wide.select(entity, F.inline(F.array(*found).cast(kind))).where("passed is not null")
    return rows.select(entity, "rule_id", "severity", "passed", F.explode("keys").alias("key"))


def _median_of_others(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """``df`` (with ``n``, the rows of the group) and ``name``: the median of ``x`` over the other rows of the group.

    Rows are ranked once; without the own row each place from the own one on moves by one, so three values settle a group.
    """
    ranked = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(x)))
    low, high = F.floor(F.col("n") / 2), F.floor((F.col("n") + 1) / 2)
    at = lambda i: F.max(F.when(F.col("_r") == low + i, F.col(x)))
    places = ranked.groupBy(*by).agg(F.array(at(0), at(1), at(2)).alias("_p"))
    place = lambda p: F.get("_p", (p - low + F.when(F.col("_r") > p, 0).otherwise(1)).cast("int"))
    return ranked.join(places, by).withColumn(name, (place(low) + place(high)) / 2).drop("_r", "_p")


def family_outliers(values: DataFrame, family: str, key: str, member: str, value: str) -> DataFrame:
    """``family, key, member, median, mad, deviation, coherent``: each value against the others of its family.

    Median and median absolute deviation leave the member itself out; fewer than five other values give no row. Without
    spread, any other value is incoherent. Families of every size are ranked by value, and then by the deviation from each of
    their at most three medians; nothing of a family is gathered. Null values take no part; repeated rows count as often as
    they stand.
    """
    rows = values.where(F.col(value).isNotNull()).select(family, key, F.col(member).alias("member"), F.col(value).cast("double").alias("v"))
    sizes = rows.groupBy(family, key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MIN_SIBLINGS)
    rows = _median_of_others(rows.join(sizes, [family, key]), [family, key], "v", "median")
    centres = rows.select(family, key, F.col("median").alias("centre")).distinct()
    each = rows.join(centres, [family, key]).withColumn("d", F.abs(F.col("v") - F.col("centre")))
    each = _median_of_others(each, [family, key, "centre"], "d", "mad").where(F.col("median") == F.col("centre"))
    deviation = F.when(F.col("mad") > 0, F.round(F.abs(F.col("v") - F.col("median")) / F.col("mad"), 6))
    coherent = F.when(F.col("mad") > 0, deviation <= MAX_DEVIATION).otherwise(F.col("v") == F.col("median"))
    return each.select(family, key, "member", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), deviation.alias("deviation"), coherent.alias("coherent"))


def family_strangers(values: DataFrame, family: str, key: str, member: str, value: str) -> DataFrame:
    """Categorical values that no other member of a family of more than five has; two aggregations instead of a self-join."""
    rows = values.where(F.col(value).isNotNull())
    n = rows.groupBy(family, key).agg(F.count(F.lit(1)).alias("n"))
    own = rows.groupBy(family, key, value).agg(F.count(F.lit(1)).alias("same"), F.min(member).alias("member"))
    return own.where("same = 1").join(n.where(F.col("n") > MIN_SIBLINGS), [family, key]).select(family, key, "member", F.col(value).alias("value"), (F.col("n") - 1).alias("n_peers"))


def coverage_gaps(members: DataFrame, cells: DataFrame, family: str, member: str, key: str) -> DataFrame:
    """``family, member, key, share``: attributes that more than 90 % of a member's siblings have and the member has not."""
    size = members.groupBy(family).agg(F.countDistinct(member).alias("n")).where(F.col("n") > MIN_SIBLINGS)
    have = cells.select(family, member, key).distinct()
    typical = have.groupBy(family, key).agg(F.count(F.lit(1)).alias("have")).join(size, family)
    typical = typical.where(F.col("have") / (F.col("n") - 1) > TYPICAL_SHARE)
    expected = members.select(family, member).distinct().join(typical, family)
    return expected.join(have, [family, member, key], "left_anti").select(family, member, key, F.round(F.col("have") / (F.col("n") - 1), 4).alias("share"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that several rows share, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def window_rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def with_lookups(wide: DataFrame, lookups: dict[str, tuple[str, dict]]) -> DataFrame:
    """``wide`` with a column per lookup: ``name -> (column, table)``, the table's value for the column's text; null where it has none.

    A lookup whose column the table does not have is left out, so that rules on it are not evaluated.
    """
    for name, (column, values) in lookups.items():
        if column in wide.columns:
            found = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
            wide = wide.withColumn(name, found[F.col(column).cast("string")])
    return wide


def rule_messages(wide: DataFrame, entity: str, rules: list[dict]) -> DataFrame:
    """``entity, rule_id, message``: the message of each failed rule with the values of its names filled in; a rule without a message gives its id."""
    out = apply_rules(wide, entity, rules).where("not passed").select(entity, "rule_id").distinct()
    texts = F.lit(None).cast("string")
    for rule in rules:
        text = F.lit(rule.get("message", rule["id"]))
        for n in wide.columns:
            if "{" + n + "}" in rule.get("message", ""):
                value = F.col(n).cast("string")
                text = F.replace(text, F.lit("{" + n + "}"), F.coalesce(F.regexp_replace(value, r"\.0+$", "") if dict(wide.dtypes)[n] == "double" else value, F.lit("")))
        texts = F.when(F.col("rule_id") == rule["id"], text).otherwise(texts)
    return out.join(wide, entity).select(entity, "rule_id", texts.alias("message"))


def supported_by(tier: Column, value: Column, texts: list[Column], same) -> Column:
    """Whether a value follows from one of the texts it cites (``same(value, text)``); values that were computed from the text follow by construction, so only asserted ones are compared."""
    found = F.lit(False)
    for t in texts:
        found = found | F.coalesce(same(value, t), F.lit(False))
    return (tier != "llm") | found
