"""Candidates from abbreviations, table cells and headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.text import trimmed


def lexicon_tokens(rows: DataFrame, row_id: str, text: str, lexicon: DataFrame, longest: int | None = None) -> DataFrame:
    """``row_id, token, canonical_key, value``: abbreviations of the lexicon that stand as whole tokens in a text.

    Texts are split once and the distinct tokens meet the lexicon by an equi-join (no row is compared with every entry);
    entries of several words are looked up among runs of as many tokens as the longest entry has (``longest``, else counted). Null texts give nothing.
    """
    words = F.filter(F.split(F.upper(F.col(text)), r"[^A-Z0-9./#-]+"), lambda w: w != "")
    x = rows.select(F.col(row_id).alias("row_id"), words.alias("w")).where("w is not null and size(w) > 0")

    def run(n: int) -> Column:
        pos = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(pos, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    longest = longest or lexicon.agg(F.max(F.size(F.split(F.trim("token"), " +")))).first()[0] or 1  # metadata
    runs = F.concat(*[run(n) for n in range(1, longest + 1)])
    tokens = x.select("row_id", F.explode(F.array_distinct(runs)).alias("token"))
    return tokens.join(lexicon.select(F.upper("token").alias("token"), "canonical_key", "value"), "token").select("row_id", "token", "canonical_key", "value").distinct()


def pattern_values(rows: DataFrame, row_id: str, text: str, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """``row_id, canonical_key, number, unit`` for (key, unit, pattern with the number in group 1): the first match of each pattern."""
    found = F.array(*[F.struct(F.lit(k).alias("canonical_key"), F.regexp_extract(F.upper(F.col(text)), p, 1).alias("number"), F.lit(u).alias("unit")) for k, u, p in patterns])
    return rows.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.inline(found)).where("number <> ''")


def schema_votes(tokens: DataFrame, owners: DataFrame) -> DataFrame:
    """``row_id, category_code, votes``: decoded keys per category; keys that every category has don't vote."""
    n = owners.select(F.countDistinct("category_code").alias("n"))
    telling = owners.select("category_code", "canonical_key").distinct().join(
        owners.groupBy("canonical_key").agg(F.countDistinct("category_code").alias("c")).join(F.broadcast(n)).where("c < n").select("canonical_key"), "canonical_key"
    )
    keys = tokens.select("row_id", "canonical_key").distinct()
    return keys.join(telling, "canonical_key").groupBy("row_id", "category_code").agg(F.count(F.lit(1)).alias("votes"))


def cells_of(chunks: DataFrame, chunk_id: str, cells: str, keep: list[str]) -> DataFrame:
    """One row per cell: ``chunk_id, cell_ord, header, value`` and the ``keep`` columns; chunks without cells have none."""
    return chunks.select(chunk_id, *keep, F.posexplode(cells).alias("cell_ord", "cell")).select(chunk_id, *keep, "cell_ord", F.col("cell.header").alias("header"), F.col("cell.value").alias("value"))


def self_describing(cells: Column) -> Column:
    """Cells as one line: ``header: value | header: value``; blank cells are left out."""
    kept = F.filter(cells, lambda c: trimmed(F.coalesce(c["value"], F.lit(""))) != "")
    return F.array_join(F.transform(kept, lambda c: F.concat(c["header"], F.lit(": "), c["value"])), " | ")


def header_form(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "), " +", " "))


def token_sort_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence of the token-sorted texts over their summed length."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not x and not y:
        return 100.0
    row = [0] * (len(y) + 1)
    for c in x:
        last = 0
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if c == d else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(x) + len(y))


def _bigrams(c: Column) -> Column:
    """Distinct pairs of neighbouring characters of the sorted words, with an end mark on either side."""
    t = F.concat(F.lit("^"), F.array_join(F.array_sort(F.split(c, " ")), " "), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2)))


def match_headers(headers: DataFrame, header: str, aliases: DataFrame, floor: float = 90.0, scope: tuple[str, ...] = ()) -> DataFrame:
    """``header, canonical_key, score``: each distinct header's key, by an equal alias, else the most similar one of at least ``floor``.

    ``aliases`` has (alias, canonical_key). Columns in ``scope`` stand in both tables and in the result, and have to be equal. Equal forms meet by an equi-join; for the others pairs that share enough pairs of
    letters are compared: e inserted or deleted letters change at most 2 e of them, and the floor bounds e by the two lengths, so
    no pair that reaches the floor is left out. Ties: the first key by name. Headers without a match have null key and score;
    null headers give no row. Only distinct headers are compared.
    """
    by = [*scope]
    known = aliases.select(*by, header_form(F.col("alias")).alias("a"), "canonical_key").where("a <> ''").distinct()
    distinct = headers.select(*by, F.col(header).alias("header")).where("header is not null").distinct()
    formed = distinct.withColumn("form", header_form(F.col("header")))
    exact = formed.join(known.withColumnRenamed("a", "form"), [*by, "form"]).groupBy(*by, "header").agg(F.min("canonical_key").alias("canonical_key")).withColumn("score", F.lit(100.0))
    rest = formed.join(exact, [*by, "header"], "left_anti").where("form <> ''").select(*by, "form").distinct()

    def grams(df: DataFrame, c: str) -> DataFrame:
        return df.select(*by, c, _bigrams(F.col(c)).alias("g")).select(*by, c, F.size("g").alias(f"{c}_n"), F.explode("g").alias("gram"))

    shared = grams(rest, "form").join(grams(known.select(*by, "a").distinct(), "a"), [*by, "gram"]).groupBy(*by, "form", "a").agg(F.count(F.lit(1)).alias("same"), F.first("form_n").alias("fn"), F.first("a_n").alias("an"))
    edits = F.floor((F.length("form") + F.length("a")) * (100.0 - floor) / 100)
    near = shared.where(F.col("same") >= F.greatest("fn", "an") - 2 * edits)

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([round(token_sort_ratio(i, j), 4) for i, j in zip(x, y)])

    scored = near.select(*by, "form", "a", ratio("form", "a").alias("score")).where(F.col("score") >= floor).join(known, [*by, "a"])
    best = scored.groupBy(*by, "form").agg(F.min(F.struct((-F.col("score")).alias("o"), "canonical_key")).alias("b")).select(*by, "form", "b.canonical_key", (-F.col("b.o")).alias("score"))
    fuzzy = formed.join(exact, [*by, "header"], "left_anti").join(best, [*by, "form"], "left").select(*by, "header", "canonical_key", "score")
    return exact.unionByName(fuzzy)


# Headers of the cells that name the part, the parameter, its value and the condition under which it holds.
PART_HEADERS = ["part number", "part no", "partnumber", "mpn", "manufacturer part number", "ordering code", "order code", "catalog number", "model"]
PARAM_HEADERS = ["parameter", "attribute", "specification", "spec", "property", "characteristic", "item"]
VALUE_HEADERS = ["value", "rating", "spec value", "typ", "nominal", "min max"]
CONDITION_HEADERS = ["conditions", "condition", "notes", "remarks"]


def _named(cells: Column, headers: list[str]) -> Column:
    """The values of the cells with one of the headers."""
    return F.transform(F.filter(cells, lambda c: header_form(c["header"]).isin(*headers)), lambda c: c["value"])


def part_names(cells: Column) -> Column:
    """The part numbers a row gives itself, apart by a sign that no identifier goes across; null for a row that holds for a whole family."""
    own = _named(cells, PART_HEADERS)
    return F.when(F.size(own) > 0, F.array_join(own, " ; "))


def stated_pairs(cells: Column) -> Column:
    """What a row states, as array of (header, value): one pair if it has a parameter and a value cell, else its cells."""
    param, value = F.get(_named(cells, PARAM_HEADERS), F.lit(0)), F.get(_named(cells, VALUE_HEADERS), F.lit(0))
    plain = F.transform(cells, lambda c: F.struct(c["header"].alias("header"), c["value"].alias("value")))
    return F.when(param.isNotNull() & value.isNotNull(), F.array(F.struct(param.alias("header"), value.alias("value")))).otherwise(plain)


def condition_of(cells: Column) -> Column:
    return F.get(F.filter(F.transform(_named(cells, CONDITION_HEADERS), trimmed), lambda v: v != ""), F.lit(0))


def alternatives(value: Column) -> Column:
    """The values of a cell, set apart by a slash between blanks (a slash without blanks is part of a number)."""
    return F.filter(F.split(trimmed(value), r"\s+/\s+"), lambda v: v != "")


def _side(boxes: Column, i: int) -> Column:
    return F.transform(boxes, lambda b: F.get(b, F.lit(i)))


def box_union(boxes: Column) -> Column:
    """The box around boxes (x0, y0, x1, y1)."""
    return F.array(*[f(_side(boxes, i)) for i, f in ((0, F.array_min), (1, F.array_min), (2, F.array_max), (3, F.array_max))])
