"""Text normalisation as Column expressions (JVM side, no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notes that say that no value is stated, in lower case.
NOT_STATED = ["n/a", "n.a.", "-", "--", "---", "?", "tbc", "tbd", "unknown", "not stated", "k. a.", "k.a.", "on request", "see drawing", "auf anfrage"]

#: Blanks other than U+0020 that occur in typed text: tab, line ends, no-break, narrow no-break, thin and ideographic.
ODD_BLANKS = "\t\n\r\u00a0\u2007\u2009\u202f\u3000\ufeff"

#: Unicode's space separators (Zs): what trim() takes off in the SQL of the queries.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """``c`` with odd blanks turned into spaces and without surrounding ones; null stays null."""
    return F.trim(F.translate(c, ODD_BLANKS, " " * len(ODD_BLANKS)))


def non_blank(c: Column) -> Column:
    """``c`` trimmed, null where nothing but blanks is left."""
    t = trimmed(c)
    return F.when(t != "", t)


def reference_key(c: Column) -> Column:
    """The form in which text references between tables are compared: no case, no surrounding blanks, blank is null."""
    return F.lower(non_blank(c))


def attribute_key(c: Column) -> Column:
    """Attribute names apart from case, blanks and separators: ``' Temp-Max'`` gives ``temp_max``."""
    return F.regexp_replace(F.lower(trimmed(c)), r"[\s\-_./]+", "_")


def compact_code(c: Column) -> Column:
    """Letters and digits only, lower case: the form in which enumerated values are compared."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def mpn_normalise(c: Column) -> Column:
    """Part numbers in normal form: upper case, ASCII letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def is_not_stated(c: Column) -> Column:
    """True for a null, a blank or a note that nothing is stated."""
    t = F.lower(trimmed(c))
    return c.isNull() | (t == "") | t.isin(*NOT_STATED)


def mpn_variants(c: Column) -> Column:
    """Sorted spellings of a part number: as typed, normalised, and with each run of separators as '-', '_', '.', blank."""
    t = F.upper(trimmed(c))
    forms = F.array(t, mpn_normalise(t), *[F.regexp_replace(t, r"[\s\-_./,]+", s) for s in ("-", "_", ".", " ")])
    return F.sort_array(F.array_except(F.array_distinct(forms), F.array(F.lit(""))))


def family_prefix(c: Column, n: int = 8) -> Column:
    return F.left(mpn_normalise(c), F.lit(n))


def search_tokens(c: Column) -> Column:
    """Runs of ASCII letters or of digits, lower case: the terms of full-text search."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+|[0-9]+"), F.lit(0))


def word_set(c: Column, least: int = 2) -> Column:
    """Distinct lower-case ASCII words of at least ``least`` characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= least))


def categorical(c: Column) -> Column:
    """Enumerated values in one spelling: lower case, words joined by one underscore, other signs dropped."""
    t = F.regexp_replace(F.lower(trimmed(c)), r"[\s\-/]+", "_")
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9_]", ""), "^_+|_+$", "")


def percent_bucket(c: Column, prefix: str) -> Column:
    """A number from 0 to 99 that depends only on the text: SHA-256 of prefix and text, modulo 100."""
    digest = F.sha2(F.concat(F.lit(prefix), c), 256)
    step = lambda acc, i: F.pmod(acc * 96 + F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"), F.lit(100)).cast("bigint")
    return F.when(c.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0).cast("bigint"), step)).cast("int")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
