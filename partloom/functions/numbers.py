"""Numbers as they are written in catalogues: signs, mixed fractions, digit grouping, decimal commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vulgar fraction signs and their values.
VULGAR = {"½": 0.5, "¼": 0.25, "¾": 0.75, "⅛": 0.125, "⅜": 0.375, "⅝": 0.625, "⅞": 0.875, "⅓": 1 / 3, "⅔": 2 / 3}
_V = "".join(VULGAR)
_GAP = " \u00a0\u2009\u202f'"

SIGN = r"(?:[-+−–]\s?)?"
#: One unsigned number; the alternatives run from the most to the least specific.
UNSIGNED = (
    rf"(?:\d+[ -]\d+/\d+|\d+/\d+|\d*\s?[{_V}]"
    rf"|\d{{1,3}}(?:[{_GAP}]\d{{3}})+(?!\d)(?:[.,]\d+)?|\d+(?:[.,]\d+)*|[.,]\d+)"
)
NUMBER = SIGN + UNSIGNED

# Words that qualify a number and do not change it.
QUALIFIERS = r"(?:max|min|approx|typ|nom|ca|circa|about|appr|env|aprox|etwa|bis|up to|at least|at most|≈|~|≤|≥|<|>|±|=)"


def parse_number(token: Column) -> Column:
    """The value (double) of a text that matches ``NUMBER``; null for a null or unreadable text.

    A comma before exactly three digits groups thousands, any other comma is a decimal comma.
    """
    negative = token.rlike(r"^\s*[-−–]")
    t = F.regexp_replace(F.trim(token), r"^[-+−–]\s?", "")
    top = F.regexp_extract(t, r"(\d+)/(\d+)$", 1).try_cast("double")
    bottom = F.regexp_extract(t, r"(\d+)/(\d+)$", 2).try_cast("double")
    whole = F.coalesce(F.regexp_extract(t, r"^(\d+)[ -]", 1).try_cast("double"), F.lit(0.0))
    slash = F.when(bottom > 0, whole + top / bottom)
    vulgar = F.coalesce(F.regexp_extract(t, r"^(\d+)", 1).try_cast("double"), F.lit(0.0))
    part = F.lit(0.0)
    for sign, value in VULGAR.items():
        part = F.when(t.endswith(sign), F.lit(value)).otherwise(part)
    plain = F.translate(t, _GAP, "")
    plain = F.when(plain.contains(","), F.translate(F.regexp_replace(plain, r",(?=\d{3}(?!\d))", ""), ",", ".")).otherwise(plain)
    out = F.when(F.translate(t, "0123456789.", "") == "", t.try_cast("double")).when(t.contains("/"), slash).when(t.rlike(f"[{_V}]$"), vulgar + part).otherwise(plain.try_cast("double"))
    return F.when(negative, -out).otherwise(out)
