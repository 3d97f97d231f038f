"""Queries of evaluation, probes, decoding and service reads over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from partloom.functions import text as X
from partloom.operators import decoder as D
from partloom.operators import extract as E
from partloom.operators import store as S
from partloom.operators import validate as V
from partloom.plans import catalogue_queries as Q
from partloom.plans.prep_queries import p1_wide
from partloom.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---- decoding of part numbers -----------------------------------------------------------------------------------

_RULES = f"""
l AS (SELECT {Q._NORM.format('mpn_normalised')} AS part, manufacturer_resolved AS maker, canonical_key AS key, value_text AS value, regexp_extract_all(upper({Q._NORM.format('mpn_normalised')}), '[0-9]+|[A-Z]+') AS s FROM eval_labels WHERE mpn_normalised IS NOT NULL),
f AS (SELECT *, coalesce(maker, '?') || '|' || coalesce(s[1], '') || '|' || len(s) AS family FROM l),
b AS (SELECT family FROM f GROUP BY 1 HAVING count(DISTINCT part) >= 5),
g AS (SELECT DISTINCT family, i - 1 AS idx, key, s[i] AS segment, value FROM f JOIN b USING (family), range(1, len(s) + 1) t(i) WHERE key IS NOT NULL AND value IS NOT NULL),
p AS (SELECT family, idx, key, segment, count(*) AS n, min(value) AS value FROM g GROUP BY ALL),
k AS (SELECT family, idx, key FROM p GROUP BY ALL HAVING count(*) >= 2 AND count(*) FILTER (n = 1) / count(*) >= 0.9),
rules AS (SELECT family, idx::INTEGER AS idx, key, segment, value FROM p JOIN k USING (family, idx, key) WHERE n = 1)
"""


def _rules(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "eval_labels").withColumn("part", X.mpn_normalise(F.col("mpn_normalised")))
    return D.fit_decoder(labels, "part", "manufacturer_resolved", "canonical_key", "value_text")


@query(f"WITH {_RULES} SELECT * FROM rules")
def mpn_decoder(spark: SparkSession, d: str) -> DataFrame:
    """What the segments of part numbers stand for, learnt from the labels."""
    return _rules(spark, d)


@query(f"""
WITH {_RULES}, q AS (SELECT id, coalesce(manufacturer_resolved, '?') AS maker, regexp_extract_all({Q._NORM.format('mpn')}, '[0-9]+|[A-Z]+') AS s FROM products),
x AS (SELECT id, maker || '|' || coalesce(s[1], '') || '|' || len(s) AS family, (i - 1)::INTEGER AS idx, s[i] AS segment FROM q, range(1, len(s) + 1) t(i))
SELECT id AS item, idx, key, segment, value FROM x JOIN rules USING (family, idx, segment)
""")
def decoded_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of the products' keys read from their part numbers."""
    p = table(spark, d, "products").select("id", X.mpn_normalise(F.col("mpn")).alias("part"), "manufacturer_resolved")
    return D.decode(p, "id", "part", "manufacturer_resolved", _rules(spark, d))


# ---- gates and probes -------------------------------------------------------------------------------------------

_SAME = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g') = regexp_replace(lower({1}), '[^a-z0-9]', '', 'g')"


@query(f"""
WITH c AS (SELECT {Q._REF.format('chunk_id')} AS cid, any_value(text) AS text FROM chunks GROUP BY 1),
x AS (SELECT coalesce(tier, 'none') AS tier, c.cid IS NOT NULL AS cited, coalesce(span <> '' AND contains(c.text, span), false) AS present,
  coalesce(tier <> 'llm' OR coalesce({_SAME.format('value', 'raw_text')}, false) OR coalesce({_SAME.format('value', 'span')}, false), false) AS supported, lower(trim(coalesce(value, ''))) NOT IN {Q._FILLER} AS stated
  FROM (SELECT DISTINCT candidate_id, tier, value, raw_text, span, chunk_id FROM candidates) k LEFT JOIN c ON c.cid = {Q._REF.format('k.chunk_id')})
SELECT tier, count(*) AS n, count(*) FILTER (cited) AS n_cited, count(*) FILTER (present) AS n_present, count(*) FILTER (supported) AS n_supported, count(*) FILTER (stated) AS n_stated, count(*) FILTER (present AND supported AND stated) AS n_kept FROM x GROUP BY 1
""")
def gate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates of each tier pass the gates: the cited chunk exists, it has the span, the value follows from the cited text, a value is stated."""
    k = table(spark, d, "candidates").select("candidate_id", "tier", "value", "raw_text", "span", "chunk_id").distinct().withColumn("_c", X.reference_key(F.col("chunk_id")))
    c = table(spark, d, "chunks").select(X.reference_key(F.col("chunk_id")).alias("_c"), "text").where("_c is not null").dropDuplicates(["_c"]).withColumn("_there", F.lit(True))
    plain = lambda v: F.regexp_replace(F.lower(v), "[^a-z0-9]", "")
    x = k.join(c, "_c", "left")
    supported = F.coalesce(V.supported_by(F.col("tier"), F.col("value"), [F.col("raw_text"), F.col("span")], lambda a, b: plain(a) == plain(b)), F.lit(False))
    present = F.coalesce((F.col("span") != "") & F.contains("text", F.col("span")), F.lit(False))
    x = x.select(F.coalesce("tier", F.lit("none")).alias("tier"), F.col("_there").isNotNull().alias("cited"), present.alias("present"), supported.alias("supported"), (~X.is_not_stated(F.col("value"))).alias("stated"))
    n = lambda c: F.sum(c.cast("int"))
    return x.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), *[n(F.col(c)).alias(f"n_{c}") for c in ("cited", "present", "supported", "stated")], n(F.col("present") & F.col("supported") & F.col("stated")).alias("n_kept"))


_PROBES = f"""
l AS (SELECT {Q._NORM.format('mpn_normalised')} AS part, canonical_key AS key, max(value_text) AS v FROM eval_labels GROUP BY ALL),
p AS (SELECT {Q._NORM.format('mpn')} AS part, min(category_code) AS cat FROM products GROUP BY 1),
a AS (SELECT l.part, l.key, l.v, try_cast(l.v AS DOUBLE) AS q, s.value_type AS kind, s.allowed_values AS vals, least(plausible_min, plausible_max) AS lo, greatest(plausible_min, plausible_max) AS hi, cat FROM l JOIN p USING (part) JOIN attribute_specs s ON s.category_code = cat AND s.canonical_key = l.key WHERE l.v IS NOT NULL),
b AS (SELECT *, (SELECT min(x) FROM unnest(vals) t(x) WHERE x > v) AS after, list_min(vals) AS first FROM a)
"""


@query(f"""
WITH {_PROBES}, x AS (
SELECT 'unit' AS probe, q, q * 1000 AS bad, NULL AS bad_text, kind, vals, lo, hi, v FROM b WHERE kind = 'quantity' AND q IS NOT NULL
UNION ALL SELECT 'range', q, hi * 10, NULL, kind, vals, lo, hi, v FROM b WHERE kind = 'quantity' AND q IS NOT NULL AND hi IS NOT NULL
UNION ALL SELECT 'adjacent', NULL, NULL, coalesce(after, first), kind, vals, lo, hi, v FROM b WHERE kind = 'enum'
UNION ALL SELECT 'unknown', NULL, NULL, v || 'x', kind, vals, lo, hi, v FROM b WHERE kind = 'enum')
SELECT probe, count(*) AS n, count(*) FILTER (bad IS NOT NULL AND NOT (bad BETWEEN lo AND hi)) AS by_range, count(*) FILTER (bad_text IS NOT NULL AND NOT list_contains(vals, bad_text)) AS by_allowed,
  count(*) FILTER (CASE WHEN bad IS NOT NULL THEN abs(bad - q) > 0.01 * greatest(abs(bad), abs(q)) ELSE bad_text <> v END) AS by_evidence FROM x GROUP BY 1
""")
def probe_interception(spark: SparkSession, d: str) -> DataFrame:
    """False values made from labels (a wrong unit, out of range, the next allowed value, an unknown one) and which check stops them, each asked alone."""
    lab = table(spark, d, "eval_labels").groupBy(X.mpn_normalise(F.col("mpn_normalised")).alias("part"), F.col("canonical_key")).agg(F.max("value_text").alias("v")).where("v is not null")
    cat = table(spark, d, "products").groupBy(X.mpn_normalise(F.col("mpn")).alias("part")).agg(F.min("category_code").alias("category_code"))
    specs = table(spark, d, "attribute_specs").select("category_code", "canonical_key", "value_type", "allowed_values", F.least("plausible_min", "plausible_max").alias("lo"), F.greatest("plausible_min", "plausible_max").alias("hi"))
    x = lab.join(cat, "part").join(F.broadcast(specs), ["category_code", "canonical_key"]).withColumn("q", F.col("v").try_cast("double"))
    after = F.coalesce(F.array_min(F.filter("allowed_values", lambda a: a > F.col("v"))), F.array_min("allowed_values"))
    none, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    made = lambda probe, when, bad, bad_text: F.when(when, F.struct(F.lit(probe).alias("probe"), bad.alias("bad"), bad_text.alias("bad_text")))
    number, enum = (F.col("value_type") == "quantity") & F.col("q").isNotNull(), F.col("value_type") == "enum"
    probes = F.array(made("unit", number, F.col("q") * 1000, text), made("range", number & F.col("hi").isNotNull(), F.col("hi") * 10, text), made("adjacent", enum, none, after), made("unknown", enum, none, F.concat("v", F.lit("x"))))
    x = x.select("q", "v", "lo", "hi", "allowed_values", F.inline(F.filter(probes, lambda p: p.isNotNull())))
    far = F.when(F.col("bad").isNotNull(), F.abs(F.col("bad") - F.col("q")) > 0.01 * F.greatest(F.abs("bad"), F.abs("q"))).otherwise(F.col("bad_text") != F.col("v"))
    n = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    return x.groupBy("probe").agg(F.count(F.lit(1)).alias("n"), n(~F.col("bad").between(F.col("lo"), F.col("hi"))).alias("by_range"), n(~F.array_contains("allowed_values", F.col("bad_text"))).alias("by_allowed"), n(far).alias("by_evidence"))


@query(f"""
WITH k AS (SELECT DISTINCT {Q._NORM.format('x.value')} AS code FROM (SELECT unnest(cells) AS x FROM chunks) WHERE x.header = 'Part Number'),
v AS (SELECT unnest(['baseline', 'no_manufacturer', 'no_description', 'malformed_mpn', 'truncated_mpn']) AS variant, mpn, manufacturer, description_fragment FROM sku_inputs),
m AS (SELECT variant, CASE variant WHEN 'malformed_mpn' THEN replace(lower(mpn), '-', ' ') WHEN 'truncated_mpn' THEN left(mpn, greatest(length(mpn) - 2, 0)) ELSE mpn END AS mpn,
  variant <> 'no_manufacturer' AND trim(manufacturer) <> '' AS maker, variant <> 'no_description' AND trim(description_fragment) <> '' AS described FROM v)
SELECT variant, count(*) AS n, count(k.code) AS located, count(*) FILTER (maker) AS with_maker, count(*) FILTER (described) AS described, round(count(k.code) / count(*), 4) AS rate FROM m LEFT JOIN k ON k.code = {Q._NORM.format('m.mpn')} GROUP BY 1
""")
def degraded_inputs(spark: SparkSession, d: str) -> DataFrame:
    """How many inputs are located in the sources when something is missing or damaged; all variants in one pass."""
    code = E.cells_of(table(spark, d, "chunks"), "chunk_id", "cells", []).where("header = 'Part Number'").select(X.mpn_normalise(F.col("value")).alias("code")).distinct().withColumn("hit", F.lit(1))
    s, mpn = table(spark, d, "sku_inputs"), F.col("mpn")
    stated = lambda c: F.coalesce(X.non_blank(F.col(c)).isNotNull(), F.lit(False))
    variant = lambda name, m, maker=True, text=True: F.struct(F.lit(name).alias("variant"), m.alias("mpn"), (stated("manufacturer") & F.lit(maker)).alias("maker"), (stated("description_fragment") & F.lit(text)).alias("text"))
    all_ = F.array(variant("baseline", mpn), variant("no_manufacturer", mpn, maker=False), variant("no_description", mpn, text=False), variant("malformed_mpn", F.replace(F.lower(mpn), F.lit("-"), F.lit(" "))), variant("truncated_mpn", F.left(mpn, F.greatest(F.length(mpn) - 2, F.lit(0)))))
    x = s.select(F.inline(all_)).withColumn("code", X.mpn_normalise(F.col("mpn"))).join(code, "code", "left")
    return x.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("located"), F.sum(F.col("maker").cast("int")).alias("with_maker"), F.sum(F.col("text").cast("int")).alias("described"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("rate"))


# ---- rules with lookups -----------------------------------------------------------------------------------------

# The second digit of an ingress rating.
LOOKUPS = {"water_digit": ("ingress_rating", {"ip_54": 4.0, "ip_65": 5.0, "ip_66": 6.0, "ip_68": 8.0, "ip_69k": 9.0})}
LOOKUP_RULES = [
    {"id": "sealed_for_small_cables", "when": "clamp_min < 4", "expr": "water_digit >= 6", "severity": "warn", "message": "{ingress_rating} is little for cables of {clamp_min} mm"},
    {"id": "clamping_order", "expr": "clamp_min <= clamp_max", "message": "clamps from {clamp_min} to {clamp_max} mm"},
]


@query()
def lookup_rules(spark: SparkSession, d: str) -> DataFrame:
    """Failed rules, one of them on a value found in a lookup table, with their messages."""
    return V.rule_messages(V.with_lookups(p1_wide(spark, d), LOOKUPS), "product_id", LOOKUP_RULES)


# ---- metrics ----------------------------------------------------------------------------------------------------


@query(f"""
SELECT coalesce(tier, 'all') AS tier, count(*) AS n, round(count(*) FILTER (resolution = 'published') / count(*), 4) AS publish_rate, round(count(*) FILTER (resolution = 'abstained') / count(*), 4) AS abstention_rate,
  round(count(*) FILTER (resolution = 'abstained' AND correct) / nullif(count(*) FILTER (resolution = 'abstained'), 0), 4) AS false_abstention_rate, count(*) FILTER (resolution = 'review') AS n_review FROM {Q._OUTCOMES} WHERE label IS NOT NULL GROUP BY ROLLUP (tier)
""")
def validation_metrics(spark: SparkSession, d: str) -> DataFrame:
    """How labelled values were resolved, per tier and in all; false abstentions are right values that were withheld."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    is_ = lambda r: F.col("resolution") == r
    x = Q._outcomes(spark, d).where("label is not null").rollup("tier").agg(F.count(F.lit(1)).alias("n"), n(is_("published")).alias("p"), n(is_("abstained")).alias("a"), n(is_("abstained") & F.col("correct")).alias("f"), n(is_("review")).cast("bigint").alias("n_review"))
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    return x.select(F.coalesce("tier", F.lit("all")).alias("tier"), "n", rate("p", "n").alias("publish_rate"), rate("a", "n").alias("abstention_rate"), rate("f", "a").alias("false_abstention_rate"), "n_review")


@query(f"SELECT abstention_code, criticality, count(*) AS n, count(DISTINCT {Q._REF.format('product_id')}) AS n_products FROM (SELECT DISTINCT * FROM provenance) WHERE resolution = 'abstained' GROUP BY ALL")
def abstention_reasons(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "provenance").distinct().where("resolution = 'abstained'").groupBy("abstention_code", "criticality")
    return x.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(X.reference_key(F.col("product_id"))).alias("n_products"))


@query(f"""
WITH v AS (SELECT DISTINCT product_id FROM ({Q._VERIFIED}) WHERE matched)
SELECT source_status, count(*) AS n, count(v.product_id) AS located, round(count(v.product_id) / count(*), 4) AS rate FROM products p LEFT JOIN v ON v.product_id = {Q._REF.format('p.id')} GROUP BY 1
""")
def location_rates(spark: SparkSession, d: str) -> DataFrame:
    """The share of products with a verified source, by the status an earlier run gave them."""
    v = Q.verify_links(spark, d).where("matched").select(F.col("product_id").alias("_p")).distinct().withColumn("hit", F.lit(1))
    x = table(spark, d, "products").select("source_status", X.reference_key(F.col("id")).alias("_p")).join(v, "_p", "left").groupBy("source_status")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("located"), F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("rate"))


@query(f"""
WITH v AS (SELECT v.*, coalesce(a.authority, 9) AS authority FROM ({Q._VERIFIED}) v LEFT JOIN ({Q._RANKED_SOURCES}) a ON a.sid = v.source_id WHERE matched)
SELECT product_id, source_id, score, row_number() OVER (PARTITION BY product_id ORDER BY authority, score DESC, source_id) AS place FROM v QUALIFY place <= 3
""")
def verified_sources(spark: SparkSession, d: str) -> DataFrame:
    """The first three verified sources of each product in order of authority and score (the cut is the feature)."""
    v = Q.verify_links(spark, d).where("matched").join(Q._authority(spark, d).withColumnRenamed("_s", "source_id"), "source_id", "left").withColumn("authority", F.coalesce("authority", F.lit(9)))
    return V.window_rank(v, ["product_id"], [F.col("authority"), F.desc("score"), F.col("source_id")], "place").where("place <= 3").select("product_id", "source_id", "score", "place")


@query(f"""
WITH g AS (SELECT {Q._REF.format('product_id')} AS pid, canonical_key, {Q._CAT.format('value')} AS value FROM (SELECT DISTINCT candidate_id, product_id, canonical_key, value FROM candidates WHERE tier = 'llm') WHERE lower(trim(coalesce(value, ''))) NOT IN {Q._FILLER} AND trim(product_id) <> ''),
v AS (SELECT pid, canonical_key, value, count(*) AS votes FROM g GROUP BY ALL), c AS (SELECT *, sum(votes) OVER (PARTITION BY pid, canonical_key) AS samples FROM v)
SELECT pid AS product_id, canonical_key, value, votes, samples::BIGINT AS samples, round(votes / samples, 4) AS ratio FROM c WHERE NOT (samples > 1 AND votes = 1) QUALIFY row_number() OVER (PARTITION BY pid, canonical_key ORDER BY votes DESC, value) = 1
""")
def proposal_majority(spark: SparkSession, d: str) -> DataFrame:
    """The value that most proposals of a product and key give, with its share; where every proposal says something else there is none."""
    g = table(spark, d, "candidates").where("tier = 'llm'").select("candidate_id", X.reference_key(F.col("product_id")).alias("product_id"), "canonical_key", "value").distinct()
    g = g.where(F.col("product_id").isNotNull() & ~X.is_not_stated(F.col("value"))).groupBy("product_id", "canonical_key", X.categorical(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("votes"))
    best = g.groupBy("product_id", "canonical_key").agg(F.sum("votes").alias("samples"), F.min(F.struct((-F.col("votes")).alias("o"), "value")).alias("b"))
    votes = -F.col("b.o")
    return best.where(~((F.col("samples") > 1) & (votes == 1))).select("product_id", "canonical_key", "b.value", votes.alias("votes"), "samples", F.round(votes / F.col("samples"), 4).alias("ratio"))


# ---- texts ------------------------------------------------------------------------------------------------------


@query(Q._TOKENS + """, f AS (SELECT row_id, list_distinct(list(value)) AS v FROM k GROUP BY 1)
SELECT sku_id, trim(coalesce(mpn, '') || ' ' || coalesce(description_fragment, '') || ' ' || coalesce(array_to_string(list_sort([replace(x, '_', ' ') FOR x IN v]), ' '), '')) AS text FROM sku_inputs LEFT JOIN f ON f.row_id = sku_id""")
def expanded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Part number and description with what their abbreviations stand for: the text that is looked up in a taxonomy."""
    f = Q._tokens(spark, d).groupBy(F.col("row_id").alias("sku_id")).agg(F.array_join(F.array_sort(F.transform(F.collect_set("value"), lambda v: F.replace(v, F.lit("_"), F.lit(" ")))), " ").alias("v"))  # at most the lexicon
    e = lambda c: F.coalesce(c, F.lit(""))
    return table(spark, d, "sku_inputs").join(f, "sku_id", "left").select("sku_id", F.trim(F.concat_ws(" ", e("mpn"), e("description_fragment"), e("v"))).alias("text"))


@query(f"""
WITH l AS (SELECT DISTINCT {Q._NORM.format('mpn_normalised')} AS part, canonical_key AS key, value_text AS v FROM eval_labels WHERE length(trim(value_text)) > 1),
s AS (SELECT sku_id, {Q._NORM.format('mpn')} AS part, regexp_split_to_array(description_fragment, '[.!?] +') AS s FROM sku_inputs WHERE description_fragment IS NOT NULL),
x AS (SELECT sku_id, part, (i - 1)::INTEGER AS sentence, s[i] AS t FROM s, range(1, len(s) + 1) t(i))
SELECT sku_id, sentence, min(key) AS canonical_key, count(*) AS n_claims FROM x JOIN l USING (part) WHERE contains(lower(t), lower(replace(v, '_', ' '))) OR contains(lower(t), replace(key, '_', ' ')) GROUP BY ALL
""")
def claims_of_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of a description that state a labelled value of the part or name its key: the first key by name, and how many labels they touch."""
    lab = table(spark, d, "eval_labels").where(F.length(F.trim("value_text")) > 1).select(X.mpn_normalise(F.col("mpn_normalised")).alias("part"), "canonical_key", "value_text").distinct()
    s = table(spark, d, "sku_inputs").where("description_fragment is not null").select("sku_id", X.mpn_normalise(F.col("mpn")).alias("part"), F.posexplode(F.split("description_fragment", "[.!?] +")).alias("sentence", "t"))
    words = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    x = s.join(lab, "part").where(F.contains(F.lower("t"), F.lower(words("value_text"))) | F.contains(F.lower("t"), words("canonical_key")))
    return x.groupBy("sku_id", "sentence").agg(F.min("canonical_key").alias("canonical_key"), F.count(F.lit(1)).alias("n_claims"))


@query(f"WITH c AS (SELECT DISTINCT {Q._NORM.format('mpn')} AS code FROM products WHERE length({Q._NORM.format('mpn')}) >= 4) SELECT a.code AS part, b.code AS longer FROM c a JOIN c b ON a.code <> b.code AND contains(b.code, a.code)")
def contained_parts(spark: SparkSession, d: str) -> DataFrame:
    """Part numbers of at least four signs that stand inside another one: the stretches of each number meet the numbers by an equi-join."""
    c = table(spark, d, "products").select(X.mpn_normalise(F.col("mpn")).alias("code")).where("length(code) >= 4").distinct()
    size = F.length("code")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), size - 3), lambda i: F.transform(F.sequence(F.lit(4), size - i + 1), lambda n: F.substring(F.col("code"), i, n))))
    return c.select(F.col("code").alias("longer"), F.explode(F.array_distinct(parts)).alias("part")).where("part <> longer").join(c.withColumnRenamed("code", "part"), "part").select("part", "longer")


# ---- storing and reading ----------------------------------------------------------------------------------------

_DIM = "id, source_type, authority_rank, uri, content_hash"


@query(f"""
WITH s AS (SELECT DISTINCT {_DIM}, fetched_at FROM sources WHERE id IS NOT NULL), o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at, coalesce(content_hash, '')) = 1),
n AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC, coalesce(content_hash, '') DESC) = 1)
SELECT id, coalesce(n.source_type, o.source_type) AS source_type, coalesce(n.authority_rank, o.authority_rank) AS authority_rank, coalesce(n.uri, o.uri) AS uri, coalesce(n.content_hash, o.content_hash) AS content_hash FROM o FULL JOIN n USING (id)
""")
def upsert_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources as first fetched, brought up to date by the last fetch; a null never replaces a value."""
    s = table(spark, d, "sources").select("id", "source_type", "authority_rank", "uri", "content_hash", "fetched_at").where("id is not null").distinct()
    w = lambda *o: F.row_number().over(Window.partitionBy("id").orderBy(*o))
    h = F.coalesce("content_hash", F.lit(""))
    s = s.withColumns({"a": w("fetched_at", h), "b": w(F.desc("fetched_at"), h.desc())})
    return S.coalesce_dimension(s.where("a = 1").drop("a", "b", "fetched_at"), s.where("b = 1").drop("a", "b", "fetched_at"), "id")


@query(f"SELECT {Q._NORM.format('mpn_normalised')} AS part, canonical_key AS key, max(value_text) AS value FROM eval_labels WHERE value_text IS NOT NULL GROUP BY ALL")
def refreshed_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of each part as one map (the form of a labelled record) and back as rows, as a full refresh writes them."""
    x = table(spark, d, "eval_labels").where("value_text is not null").groupBy(X.mpn_normalise(F.col("mpn_normalised")).alias("part"), F.col("canonical_key").alias("key")).agg(F.max("value_text").alias("value"))
    maps = x.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("labels"))  # one part's keys
    return S.map_rows(maps, "part", "labels")


@query(f"""
SELECT p.mpn, v.canonical_key, count(*) AS n_rows, arg_max(v.value_text, (v.loaded_at, v.prov_id)) AS value_text, arg_max(v.resolution, (v.loaded_at, v.prov_id)) AS resolution
FROM products p JOIN (SELECT DISTINCT * FROM provenance WHERE value_text IS NOT NULL AND resolution IS NOT NULL) v ON {Q._REF.format('v.product_id')} = {Q._REF.format('p.id')} GROUP BY ALL
""")
def provenance_lookup(spark: SparkSession, d: str) -> DataFrame:
    """What the service gives for a part number and key: the last value and how it was resolved."""
    v = table(spark, d, "provenance").where("value_text is not null and resolution is not null").distinct().withColumn("_p", X.reference_key(F.col("product_id")))
    x = table(spark, d, "products").select("mpn", X.reference_key(F.col("id")).alias("_p")).join(v, "_p").groupBy("mpn", "canonical_key")
    return x.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.struct("loaded_at", "prov_id", "value_text", "resolution")).alias("m")).select("mpn", "canonical_key", "n_rows", "m.value_text", "m.resolution")


@query("SELECT id, mpn, manufacturer FROM products WHERE contains(lower(mpn), 'kx') OR contains(lower(manufacturer), 'kx')")
def search_products(spark: SparkSession, d: str) -> DataFrame:
    """The list filter of the service: a piece of the part number or the maker."""
    p = table(spark, d, "products")
    return p.where(F.contains(F.lower("mpn"), F.lit("kx")) | F.contains(F.lower("manufacturer"), F.lit("kx"))).select("id", "mpn", "manufacturer")


@query("""
WITH p AS (SELECT id, category_code, count(*) OVER (PARTITION BY category_code) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY category_code ORDER BY md5('7:' || id)) AS r FROM products)
SELECT id, category_code FROM p WHERE r <= greatest(1, round(100 * n / total))
""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """About 100 products, as many of each category as its share is (the sample is the feature); the order is a seeded hash."""
    p = table(spark, d, "products").select("id", "category_code")
    n = p.groupBy("category_code").agg(F.count(F.lit(1)).alias("n"))
    n = n.join(F.broadcast(n.agg(F.sum("n").alias("total"))))
    x = p.withColumn("r", F.row_number().over(Window.partitionBy("category_code").orderBy(F.md5(F.concat(F.lit("7:"), "id")))))
    return x.where("r <= 100").join(F.broadcast(n), "category_code").where(F.col("r") <= F.greatest(F.lit(1), F.round(100 * F.col("n") / F.col("total")))).select("id", "category_code")
