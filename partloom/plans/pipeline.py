"""Enrichment of sparse product rows end to end, as one plan over whole tables.

verified links -> table rows of the part or its family -> attribute keys -> candidates, together with candidates decoded from
the short descriptions -> values by type and in canonical units (what cannot be read or is not allowed is dropped) ->
adjudication -> one row per product and key with its evidence, check and confidence; conflicts stay, with their status. A
single product is the same plan on a one-row input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import text as X
from partloom.operators import adjudicate as A
from partloom.operators import confidence as C
from partloom.operators import extract as E
from partloom.operators import wide as W
from partloom.operators.units import first_number, to_canonical_units
from partloom.operators.verify import naming_chunks
from partloom.plans import catalogue_queries as Q
from partloom.session import cut_lineage
from partloom.sources.tables import spread, table


def attribute_names(specs: DataFrame) -> DataFrame:
    """``alias, canonical_key``: what a header may say for each key."""
    return specs.select(F.explode(F.concat("aliases", F.array(F.replace("canonical_key", F.lit("_"), F.lit(" "))))).alias("alias"), "canonical_key")


def table_candidates(chunks: DataFrame, parts: DataFrame, names: DataFrame, bounds: tuple[int, int] | None = None) -> DataFrame:
    """``product_id, canonical_key, value, alternatives, condition, source, chunk_id, locator`` from the rows of verified sources.

    ``parts`` has ``_p, _s, _code``. A row that names parts holds for those alone, a row that names none for every part that is
    linked to its source; of the latter a source's equal statements are one before they meet the parts. A row with a
    parameter and a value cell states that one pair, any other row its cells. Rows without cells give nothing.
    """
    rows = chunks.where("cells is not null and locator in ('table_cell', 'structured_field')")
    rows = rows.select(X.reference_key(F.col("source_id")).alias("_s"), "chunk_id", "locator", "cells", E.part_names(F.col("cells")).alias("_own"))
    said = rows.select("_s", "chunk_id", "locator", "_own", E.condition_of(F.col("cells")).alias("condition"), F.inline(E.stated_pairs(F.col("cells"))))
    # the few distinct headers are matched once; the plan that uses them then has no Python in it
    keys = cut_lineage(E.match_headers(said, "header", names).where("canonical_key is not null").select("header", "canonical_key"))
    said = said.join(keys, "header").select("_s", "chunk_id", "locator", "_own", "canonical_key", "condition", E.alternatives(F.col("value")).alias("v"))
    said = said.select("_s", "chunk_id", "locator", "_own", "canonical_key", "condition", F.get("v", F.lit(0)).alias("value"), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))).alias("alternatives"))
    owned = naming_chunks(rows.where("_own is not null"), F.col("_s"), "_own", ["chunk_id"], parts, "_s", "_code", bounds).select("_p", F.col("_s").alias("source"), "chunk_id").distinct()
    own = owned.join(said.drop("_s"), "chunk_id")
    shared = said.where("_own is null").groupBy("_s", "locator", "canonical_key", "value", "alternatives", "condition").agg(F.min("chunk_id").alias("chunk_id"))
    wide = shared.join(parts.select("_p", "_s").distinct(), "_s").withColumnRenamed("_s", "source")
    columns = [F.col("_p").alias("product_id"), "canonical_key", "value", "alternatives", "condition", "source", "chunk_id", "locator"]
    return own.select(*columns).unionByName(wide.select(*columns))


def rule_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates from the short descriptions: abbreviations and numbers with units."""
    sku = table(spark, folder, "sku_inputs")
    words = Q._tokens(spark, folder).select("row_id", "canonical_key", "value", F.lit(None).cast("string").alias("unit"))
    numbers = E.pattern_values(sku, "sku_id", "description_fragment", Q.PATTERNS).select("row_id", "canonical_key", F.col("number").alias("value"), "unit")
    part = sku.select(F.col("sku_id").alias("row_id"), X.mpn_normalise(F.col("mpn")).alias("part"))
    product = table(spark, folder, "products").select(X.reference_key(F.col("id")).alias("product_id"), X.mpn_normalise(F.col("mpn")).alias("part"))
    found = words.unionByName(numbers).join(part, "row_id").join(product, "part")
    return found.select("product_id", "canonical_key", "value", "unit", F.concat(F.lit("sku:"), F.col("row_id").cast("string")).alias("source"))


def typed_claims(claims: DataFrame, specs: DataFrame) -> DataFrame:
    """Claims (``category_code, canonical_key, value, unit``) with ``typed`` and ``canonical_value``; those that cannot be read by their key's type are dropped.

    Quantities: the number in the canonical unit, which also stands for a missing one; whole numbers where the key has no
    unit. Enumerations: the allowed value that is equal apart from case, blanks and separators, else the most similar one of at
    least 88. Booleans: true or false. Texts as they stand.
    """
    scope = ["category_code", "canonical_key"]
    known = specs.select(*scope, "value_type", "dimension", F.col("canonical_unit").alias("spec_unit"), "allowed_values", "plausible_min", "plausible_max")
    x = claims.join(F.broadcast(known), scope).withColumn("unit", F.coalesce("unit", "spec_unit"))
    x = to_canonical_units(x, specs, "canonical_key", "value", raw_text=None)
    number = F.when(F.col("spec_unit").isNotNull(), F.round("canonical_value", 6)).otherwise(F.round(first_number(F.col("value"))))
    x = x.withColumn("canonical_value", F.when(F.col("value_type") == "quantity", number))
    enum = x.where("value_type = 'enum'")
    allowed = specs.where("value_type = 'enum'").select(*scope, F.explode("allowed_values").alias("a")).select(*scope, F.replace("a", F.lit("_"), F.lit(" ")).alias("alias"), F.col("a").alias("key"))
    unread = enum.where(W.read_enum(F.col("value"), F.col("allowed_values")).isNull())
    like = E.match_headers(unread.withColumnRenamed("canonical_key", "spec_key"), "value", allowed.select("category_code", F.col("canonical_key").alias("spec_key"), "alias", F.col("key").alias("canonical_key")), 88.0, ("category_code", "spec_key"))
    like = cut_lineage(like.where("canonical_key is not null").select("category_code", F.col("spec_key").alias("canonical_key"), F.col("header").alias("value"), F.col("canonical_key").alias("_like")))
    x = x.join(like, [*scope, "value"], "left")
    kind, v = F.col("value_type"), F.col("value")
    typed = F.when(kind == "quantity", F.format_string("%.6f", F.col("canonical_value"))).when(kind == "enum", F.coalesce(W.read_enum(v, F.col("allowed_values")), F.col("_like")))
    typed = typed.when(kind == "bool", W.read_bool(v).cast("string")).when(~X.is_not_stated(v), X.trimmed(v))
    return x.withColumn("typed", F.when((kind != "quantity") | F.col("canonical_value").isNotNull(), typed)).where("typed is not null").drop("_like", "canonical_unit")


def enrich(spark: SparkSession, folder: str) -> DataFrame:
    """One row per product and key that anything is stated for: ``value, canonical_value, n_sources, n_values, status, range_ok, confidence``.

    ``status`` is ``decided``, ``close`` (a narrow lead) or ``conflict`` (two sources of the first rank disagree; value null).
    """
    specs, none = table(spark, folder, "attribute_specs"), F.lit(None).cast("string")
    naming = cut_lineage(Q._naming(spark, folder))  # used by the signals and by the gate
    verified = Q._verified(spark, folder, naming).where("matched").select(F.col("product_id").alias("_p"), F.col("source_id").alias("_s"))
    parts = cut_lineage(Q._parts(spark, folder).join(verified, ["_p", "_s"]))
    cells = table_candidates(spread(table(spark, folder, "chunks").select("source_id", "chunk_id", "locator", "cells")), parts, attribute_names(specs), Q._bounds(spark, folder))
    cells = cells.join(Q._authority(spark, folder).withColumnRenamed("_s", "source"), "source", "left")
    cells = cells.select("product_id", "canonical_key", "value", none.alias("unit"), "source", "chunk_id", "locator", F.lit("table").alias("tier"), F.coalesce("authority", F.lit(9)).alias("authority"))
    rules = rule_candidates(spark, folder).select("product_id", "canonical_key", "value", "unit", "source", F.lit("").alias("chunk_id"), F.lit("inferred").alias("locator"), F.lit("rule").alias("tier"), F.lit(6).alias("authority"))
    category = table(spark, folder, "products").select(X.reference_key(F.col("id")).alias("product_id"), "category_code")
    every = typed_claims(cut_lineage(cells.unionByName(rules).distinct().join(category, "product_id")), specs)  # read twice
    every = every.withColumn("value_key", A.value_key(F.col("canonical_value"), F.col("typed"), F.col("dimension")))
    every = every.withColumn("item", F.struct("chunk_id", "typed", "canonical_value", "locator", "tier", "authority", "plausible_min", "plausible_max"))
    won = A.adjudicate(every, ["product_id", "canonical_key"], "value_key", "item", "source", "authority", "locator", "tier")
    w = lambda c: F.col(f"winner.{c}")
    low, high = F.least(w("plausible_min"), w("plausible_max")), F.greatest(w("plausible_min"), w("plausible_max"))
    score = C.heuristic(w("locator"), w("tier"), F.col("n_sources"), w("authority"), F.lit(True))  # values are read from the text they cite
    status = F.when(F.col("conflict"), "conflict").when(F.col("close_call"), "close").otherwise("decided")
    return won.select(
        "product_id", "canonical_key", w("typed").alias("value"), w("canonical_value").alias("canonical_value"), "n_sources", "n_values", status.alias("status"),
        w("canonical_value").between(low, high).alias("range_ok"), F.when(~F.col("conflict"), score).alias("confidence"),
    )


_HEADER = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_CODE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _of(headers: list[str]) -> str:
    return f"[x.value FOR x IN cells IF {_HEADER.format('x.header')} IN {_listed(headers)}]"


# the exact legs of headers and enumerations only; no header or value of the tables needs the other one
_ENRICH = rf"""
WITH vl AS (SELECT product_id AS pid, source_id AS sid FROM ({Q._VERIFIED}) WHERE matched),
al AS (SELECT {_HEADER.format('a')} AS form, min(canonical_key) AS ckey FROM (SELECT unnest(list_append(aliases, replace(canonical_key, '_', ' '))) AS a, canonical_key FROM attribute_specs) GROUP BY 1),
ch AS (SELECT {Q._REF.format('source_id')} AS sid, chunk_id, locator, {_of(E.PART_HEADERS)} AS own, {_of(E.PARAM_HEADERS)}[1] AS pn, {_of(E.VALUE_HEADERS)}[1] AS pv, cells FROM chunks
  WHERE cells IS NOT NULL AND locator IN ('table_cell', 'structured_field')),
sa AS (SELECT sid, chunk_id, locator, own, unnest(CASE WHEN pn IS NOT NULL AND pv IS NOT NULL THEN [{{'header': pn, 'value': pv}}] ELSE cells END) AS c FROM ch),
st AS (SELECT sid, chunk_id, locator, own, ckey, [x FOR x IN regexp_split_to_array(trim(c.value), '\s+/\s+') IF x <> ''][1] AS value FROM sa JOIN al ON al.form = {_HEADER.format('c.header')}),
pr AS (SELECT {Q._REF.format('id')} AS pid, mpn, category_code FROM products),
tc AS (SELECT DISTINCT p.pid, st.ckey, st.value, NULL::VARCHAR AS unit, st.sid AS source, c.chunk_id, c.locator, 'table' AS tier FROM vl JOIN pr p USING (pid) JOIN st ON st.sid = vl.sid
  JOIN (SELECT chunk_id, locator, sid, array_to_string(own, ' ; ') AS text, len(own) AS n FROM ch) c ON c.chunk_id = st.chunk_id WHERE c.n = 0 OR {Q._FOUND}),
ku AS (SELECT row_id, canonical_key, value, NULL AS unit FROM ({Q._TOKENS} SELECT * FROM k) UNION ALL SELECT row_id, canonical_key, number, unit FROM ({Q.ORACLE['pattern_values']})),
rc AS (SELECT DISTINCT p.pid, ku.canonical_key, ku.value, ku.unit, 'sku:' || row_id, '', 'inferred', 'rule' FROM ku JOIN sku_inputs s ON s.sku_id = ku.row_id JOIN pr p ON {Q._NORM.format('p.mpn')} = {Q._NORM.format('s.mpn')}),
al2 AS (SELECT * FROM tc UNION ALL SELECT * FROM rc),
cl AS (SELECT a.*, p.category_code, s.value_type, s.dimension, s.canonical_unit AS cu, s.allowed_values, s.plausible_min, s.plausible_max FROM al2 a JOIN pr p USING (pid) JOIN attribute_specs s ON s.category_code = p.category_code AND s.canonical_key = a.ckey),
{Q.canonical("SELECT cl.* REPLACE (coalesce(unit, cu) AS unit), ckey AS k, NULL::VARCHAR AS raw_text FROM cl")},
ty AS (SELECT *, CASE WHEN value_type = 'quantity' THEN CASE WHEN cu IS NOT NULL THEN round(canonical_value, 6) ELSE round(x) END END AS q,
  CASE value_type WHEN 'enum' THEN [a FOR a IN allowed_values IF {_CODE.format('a')} = {_CODE.format('value')}][1]
    WHEN 'bool' THEN CASE WHEN lower(trim(value)) IN {_listed(W.TRUE_WORDS)} THEN 'true' WHEN lower(trim(value)) IN {_listed(W.FALSE_WORDS)} THEN 'false' END
    WHEN 'text' THEN CASE WHEN lower(trim(value)) NOT IN {Q._FILLER} THEN trim(value) END END AS tx FROM cv),
au AS ({Q._RANKED_SOURCES}),
c AS (SELECT pid AS product_id, ckey AS canonical_key, source AS sid, chunk_id, locator, tier, CASE WHEN tier = 'rule' THEN 6 ELSE coalesce(authority, 9) END AS authority,
  CASE WHEN q IS NOT NULL THEN printf('%.6f', q) ELSE tx END AS typed, q, least(plausible_min, plausible_max) AS lo, greatest(plausible_min, plausible_max) AS hi,
  CASE WHEN q IS NOT NULL THEN 'q:' || printf('%.6f', q + 0.0) || ':' || coalesce(dimension, 'dimensionless') ELSE 'c:' || {Q._CAT.format('tx')} END AS vkey,
  {{'chunk_id': chunk_id, 'typed': CASE WHEN q IS NOT NULL THEN printf('%.6f', q) ELSE tx END, 'locator': locator}} AS candidate_id
  FROM ty LEFT JOIN au ON au.sid = ty.source WHERE q IS NOT NULL OR tx IS NOT NULL),
{Q._ADJUDICATED},
z AS (SELECT t.*, c2.typed, c2.q, c2.lo, c2.hi, c2.locator, c2.tier, c2.rank1 FROM t LEFT JOIN (SELECT product_id, canonical_key, vkey, candidate_id, any_value(typed) AS typed, any_value(q) AS q, any_value(lo) AS lo, any_value(hi) AS hi,
  any_value(locator) AS locator, any_value(tier) AS tier, min(authority) AS rank1 FROM c GROUP BY ALL) c2 ON c2.product_id = t.product_id AND c2.canonical_key = t.canonical_key AND c2.vkey = t.vkey AND c2.candidate_id = t.item)
SELECT product_id, canonical_key, CASE WHEN NOT conflict THEN typed END AS value, CASE WHEN NOT conflict THEN q END AS canonical_value, n_sources, n_values,
  CASE WHEN conflict THEN 'conflict' WHEN coalesce(round(score - nxt, 6) < 0.15, false) THEN 'close' ELSE 'decided' END AS status, CASE WHEN NOT conflict THEN q BETWEEN lo AND hi END AS range_ok,
  CASE WHEN NOT conflict THEN round(least(greatest(.55 + CASE locator WHEN 'table_cell' THEN .2 WHEN 'structured_field' THEN .1 WHEN 'inferred' THEN -.15 ELSE 0 END + CASE tier WHEN 'table' THEN .1 ELSE 0 END
    + .1 * least(n_sources, 3) / 3 + .1 / greatest(rank1, 1), 0), .999)::DOUBLE, 6) END AS confidence FROM z
"""

QUERIES = {"enrich_batch": enrich}
ORACLE: dict[str, str] = {"enrich_batch": _ENRICH}
