"""Which texts name which part: identifiers as whole units, found by an equi-join instead of one pattern per pair."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_PIECE = re.compile("[A-Z0-9]+")
_SEPARATORS = set(" \t\n\x0b\x0c\r-_./,")


def whole_codes(text: str | None, least: int, most: int) -> list[str]:
    """Distinct codes (letters and digits only) of the identifiers that stand whole in a text.

    An identifier is a run of pieces of letters and digits, as many as ``most`` characters allow, with nothing but blanks and
    ``-_./,`` between them. It neither goes on behind separators nor follows one directly; codes shorter than ``least`` or
    longer than ``most`` are left out. A null text has none.
    """
    if not text:
        return []
    t = text.upper()
    found = list(_PIECE.finditer(t))
    pieces = [m.group() for m in found]
    n = len(pieces)
    # gap i is before piece i; what may go on inside an identifier, begin one behind it, end one before it
    inner, lead, trail = [False] * (n + 1), [True] * (n + 1), [True] * (n + 1)
    ends = [0, *[m.end() for m in found]]
    for i, begin in enumerate([*[m.start() for m in found], len(t)]):
        gap = t[ends[i] : begin]
        if not _SEPARATORS.issuperset(gap):
            continue
        inner[i] = 0 < i < n
        tight = gap != "" and not any(c.isspace() for c in gap)
        lead[i] = not (tight and len(gap) == 1)
        trail[i] = not tight
    trail[n], lead[0] = True, True
    out: dict[str, None] = {}
    for i in range(n):
        if not lead[i]:
            continue
        code, j = "", i
        while True:
            code += pieces[j]
            j += 1
            if len(code) > most:
                break
            if len(code) >= least and (j == n or trail[j]):
                out[code] = None
            if j == n or not inner[j]:
                break
    return list(out)


def identifier_codes(text: Column, least: int, most: int) -> Column:
    """``whole_codes`` of a column of texts, in Arrow batches: one loop over the pieces of a text, for which SQL would nest folds."""

    @F.pandas_udf("array<string>")
    def codes(t: pd.Series) -> pd.Series:
        return pd.Series([whole_codes(x, least, most) for x in t], dtype=object)

    return codes(text)


def code_bounds(parts: DataFrame, code: str) -> tuple[int, int]:
    """The least and the greatest length of the codes that are not empty."""
    sizes = parts.where(F.col(code) != "").agg(F.min(F.length(code)).alias("lo"), F.max(F.length(code)).alias("hi")).first()
    return sizes["lo"] or 1, sizes["hi"] or 0


def naming_chunks(chunks: DataFrame, source: Column, text: str, keep: list[str], parts: DataFrame, part_source: str, code: str, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Rows of ``parts`` (with the columns ``part_source`` and ``code``, a normalised part number) joined to the chunks of that source that name the part.

    Texts are read once; pairs come from an equi-join on source and code, so a source with a third of all chunks costs no
    more than its matches. ``bounds`` are the least and greatest length of a code, else they are counted. Parts with an empty code match nothing; repeated chunks match as often as they stand.
    """
    lo, hi = bounds or code_bounds(parts, code)
    codes = chunks.select(source.alias("_source"), *keep, F.explode(identifier_codes(F.col(text), lo, hi)).alias("_found"))
    return parts.join(codes, (F.col(part_source) == F.col("_source")) & (F.col(code) == F.col("_found"))).drop("_source", "_found")


def maker_form(c: Column) -> Column:
    """Company names and texts as upper-case words of ASCII letters and digits with one blank between them; other signs vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9\s]", ""), r"\s+", " "))


def maker_names(products: DataFrame, product: str, manufacturer: str, entries: DataFrame, entry_id: str, name: str, aliases: str) -> DataFrame:
    """``product, name``: the forms under which a product's maker may stand in a text: as typed, and each name of the entry that the typed one equals.

    A null or blank manufacturer has none. (Names that only resemble an entry are resolved by the mapping of typed names.)
    """
    typed = products.select(product, maker_form(F.col(manufacturer)).alias("name")).where("name <> ''").distinct()
    known = entries.select(F.col(entry_id).alias("_e"), F.explode(F.array_union(F.coalesce(aliases, F.array().cast("array<string>")), F.array(name))).alias("name")).select("_e", maker_form(F.col("name")).alias("name")).where("name <> ''").distinct()
    other = typed.join(known, "name").select(product, "_e").join(known, "_e").select(product, "name")
    return typed.union(other).distinct()


def makers_in_sources(chunks: DataFrame, source: str, text: str, names: DataFrame) -> DataFrame:
    """``source, name, found``: names whose words stand together in a chunk of a source.

    Runs of words, up to the length of the longest name, meet the names by an equi-join; each text is read once.
    """
    wanted = names.select("name").distinct()
    longest = wanted.agg(F.max(F.size(F.split("name", " ")))).first()[0] or 1
    words = F.split(maker_form(F.col(text)), " ")

    def run(n: int) -> Column:
        at = F.when(F.size("_w") >= n, F.sequence(F.lit(1), F.size("_w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice("_w", i, F.lit(n)), " "))

    x = chunks.select(source, words.alias("_w")).where("_w is not null")
    runs = x.select(source, F.explode(F.array_distinct(F.concat(*[run(n) for n in range(1, longest + 1)]))).alias("name"))
    return runs.join(wanted, "name", "left_semi").distinct().withColumn("found", F.lit(True))
