"""SQL of the wide-table and unit queries, from the same fixed values as the operators."""

from __future__ import annotations

from partloom.functions.numbers import NUMBER, VULGAR
from partloom.functions.text import NOT_STATED
from partloom.functions.units import UNIT_TOKEN, unit_rows
from partloom.operators.wide import _STATED_NUMBER, FALSE_WORDS, TRUE_WORDS


def _re2(pattern: str) -> str:
    """The pattern for an engine without look-ahead; the one used only guards runs of grouped digits."""
    return pattern.replace(r"(?!\d)", "").replace("'", "''")


def _quoted(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_NU = _re2(rf"({NUMBER})\s*({UNIT_TOKEN})?")
_UNITS = ", ".join("('{}', '{}', {!r}::DOUBLE, {!r}::DOUBLE)".format(a.replace("'", "''"), d, f, o) for a, _, d, f, o in unit_rows())
_KEY = r"regexp_replace(lower(trim({0})), '[\s\-_./]+', '_', 'g')"
_WITHOUT = r"regexp_replace({0}, '\[[^\]]*\]', ' ', 'g')"
_BARE = r"regexp_replace(trim({0}), '^[-+−–]\s?', '')"
_GROUP = r"regexp_replace({0}, ',([0-9]{{3}})($|[^0-9])', '\1\2', 'g')"
_UNGROUPED = _GROUP.format(_GROUP.format("translate(t, '    ''', '')"))
_PARTS = " ".join(f"WHEN ends_with(t, '{c}') THEN {v!r}::DOUBLE" for c, v in VULGAR.items())
_ALL_PARTS = "".join(VULGAR)


def _unit_in(c: str) -> str:
    return rf"nullif(trim(CASE WHEN contains({c}, '[') THEN regexp_extract({c}, '\[([^\]]*)\]', 1) ELSE regexp_extract({c}, '{_NU}', 2) END), '')"


def canonical(rows: str) -> str:
    """CTEs that end with ``cv``: the rows (with columns k, value, unit, raw_text) and their ``canonical_value``."""
    return rf"""unit(alias, dim, factor, shift) AS (VALUES {_UNITS}),
spec AS (SELECT canonical_key AS k, any_value(u.dim) AS sdim, any_value(u.factor) AS sf, any_value(u.shift) AS ss FROM attribute_specs s JOIN unit u ON u.alias = s.canonical_unit GROUP BY 1),
c0 AS ({rows}),
n0 AS (SELECT c0.*, coalesce(nullif(regexp_extract({_WITHOUT.format('value')}, '{_NU}', 1), ''), nullif(regexp_extract({_WITHOUT.format('raw_text')}, '{_NU}', 1), '')) AS num,
  {_unit_in('raw_text')} AS ru, {_unit_in('value')} AS vu, nullif(trim(unit), '') AS uu FROM c0),
u0 AS (SELECT n0.*, sdim, sf, ss, coalesce(a.dim, b.dim, d.dim) AS dim, coalesce(a.factor, b.factor, d.factor) AS f, coalesce(a.shift, b.shift, d.shift) AS o, {_BARE.format('num')} AS t
  FROM n0 LEFT JOIN spec USING (k) LEFT JOIN unit a ON a.alias = ru LEFT JOIN unit b ON b.alias = vu LEFT JOIN unit d ON d.alias = uu),
v0 AS (SELECT *, CASE WHEN regexp_matches(num, '^\s*[-−–]') THEN -1 ELSE 1 END * CASE
  WHEN contains(t, '/') THEN coalesce(try_cast(nullif(regexp_extract(t, '^([0-9]+)[ -]', 1), '') AS DOUBLE), 0)
    + try_cast(regexp_extract(t, '([0-9]+)/([0-9]+)$', 1) AS DOUBLE) / nullif(try_cast(regexp_extract(t, '([0-9]+)/([0-9]+)$', 2) AS DOUBLE), 0)
  WHEN regexp_matches(t, '[{_ALL_PARTS}]$') THEN coalesce(try_cast(nullif(regexp_extract(t, '^([0-9]+)', 1), '') AS DOUBLE), 0) + CASE {_PARTS} END
  ELSE try_cast(replace({_UNGROUPED}, ',', '.') AS DOUBLE) END AS x FROM u0),
cv AS (SELECT *, CASE WHEN dim = sdim THEN CASE WHEN f = sf AND o = ss THEN x ELSE (x * f + (o - ss)) / sf END END AS canonical_value FROM v0)"""


P5_FOUND = f"""
WITH {canonical(f"SELECT DISTINCT candidate_id, {_KEY.format('canonical_key')} AS k, value, unit, raw_text FROM candidates")}
SELECT DISTINCT candidate_id, round(round(canonical_value * 1000, 7))::BIGINT AS value_milli FROM cv WHERE canonical_value IS NOT NULL
"""

_PLAIN = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"
P1_FOUND = rf"""
WITH r AS (SELECT p.id, p.category_code, {_KEY.format('v.canonical_key')} AS k, trim(translate(v.value_text, '{chr(0xa0)}{chr(0x202f)}', '  ')) AS t
  FROM provenance v JOIN products p ON lower(trim(p.id)) = lower(trim(v.product_id)) WHERE trim(v.value_text) <> ''),
x AS (SELECT r.id, s.canonical_key, CASE s.value_type WHEN 'quantity' THEN regexp_matches(t, '{_re2(_STATED_NUMBER)}') WHEN 'bool' THEN lower(t) IN {_quoted(TRUE_WORDS + FALSE_WORDS)}
  WHEN 'enum' THEN len([a FOR a IN s.allowed_values IF {_PLAIN.format('a')} = {_PLAIN.format('t')}]) > 0 ELSE lower(t) NOT IN {_quoted(NOT_STATED)} END AS ok
  FROM r JOIN attribute_specs s ON s.category_code = r.category_code AND s.canonical_key = r.k)
SELECT id AS product_id, canonical_key FROM x GROUP BY ALL HAVING NOT bool_or(ok)
"""


#: ``wide``: product, key and number of the quantities of a product's category, the last readable one of each key
WIDE_NUMBERS = rf"""
WITH {canonical(f"SELECT p.id AS product_id, p.category_code, {_KEY.format('v.canonical_key')} AS k, v.value_text AS value, v.unit, NULL::VARCHAR AS raw_text, v.created_at, v.loaded_at FROM provenance v JOIN products p ON lower(trim(p.id)) = lower(trim(v.product_id)) WHERE trim(v.value_text) <> ''")},
wide AS (SELECT product_id, k, arg_max(coalesce(canonical_value, x), (created_at, loaded_at, coalesce(canonical_value, x))) AS q FROM cv
  JOIN attribute_specs s ON s.category_code = cv.category_code AND s.canonical_key = cv.k AND s.value_type = 'quantity'
  WHERE regexp_matches(trim(translate(value, '{chr(0xa0)}{chr(0x202f)}', '  ')), '{_re2(_STATED_NUMBER)}') GROUP BY ALL)
"""
