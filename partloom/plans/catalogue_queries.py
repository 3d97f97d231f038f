"""Queries of the catalogue operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions import text as X
from partloom.operators import adjudicate as A
from partloom.operators import commerce as M
from partloom.operators import confidence as C
from partloom.operators import extract as E
from partloom.operators import retrieval as R
from partloom.operators import store as S
from partloom.operators import validate as V
from partloom.operators.units import to_canonical_units
from partloom.operators import verify as VF
from partloom.operators.verify import naming_chunks
from partloom.plans.prep_queries import p1_wide
from partloom.operators.wide import FALSE_WORDS, TRUE_WORDS
from partloom.plans.prep_sql import WIDE_NUMBERS, _quoted, canonical
from partloom.sources.tables import spread, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_REF = "lower(trim({0}))"
_NORM = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
_CAT = "regexp_replace(regexp_replace(regexp_replace(lower(trim(translate({0}, '\u00a0\u2007\u2009\u202f\u3000', '     '))), '[\\s\\-/]+', '_', 'g'), '[^a-z0-9_]', '', 'g'), '^_+|_+$', '', 'g')"
_FILLER = "(" + ", ".join(f"'{x}'" for x in ["", *X.NOT_STATED]) + ")"


# ---- scalar functions -------------------------------------------------------------------------------------------


@query(f"SELECT id, {_NORM.format('mpn')} AS normalised, substr({_NORM.format('mpn')}, 1, 8) AS family, regexp_replace(regexp_replace(lower(mpn), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM products")
def mpn_forms(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("mpn")
    return table(spark, d, "products").select("id", X.mpn_normalise(m).alias("normalised"), X.family_prefix(m).alias("family"), X.slug(m).alias("slug"))


_SEP = ", ".join(f"regexp_replace(upper(trim(mpn)), '[\\s\\-_./,]+', '{s}', 'g')" for s in ("-", "_", ".", " "))


@query(f"SELECT id, list_sort([x FOR x IN list_distinct([upper(trim(mpn)), {_NORM.format('mpn')}, {_SEP}]) IF x <> '']) AS variants FROM products")
def mpn_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "products").select("id", X.mpn_variants(F.col("mpn")).alias("variants"))


@query(f"SELECT canonical_key, {_CAT.format('value_text')} AS value, count(*) AS n FROM provenance WHERE value_text IS NOT NULL GROUP BY ALL")
def categorical_values(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "provenance").where("value_text is not null")
    return x.groupBy("canonical_key", X.categorical(F.col("value_text")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(description_fragment), '[a-z]+|[0-9]+')) AS token FROM sku_inputs) GROUP BY 1")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "sku_inputs").select(F.explode(X.search_tokens(F.col("description_fragment"))).alias("token"))
    return x.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


# the digest's eight 32-bit words, weighted by the powers of 2^32 modulo 100
_BUCKET = "(" + " + ".join(f"('0x' || substr(sha256('split:' || {{0}}), {i * 8 + 1}, 8))::BIGINT * {pow(2, 32 * (7 - i), 100)}" for i in range(8)) + ") % 100"


@query(f"SELECT sku_id, b::INTEGER AS bucket, CASE WHEN b < 40 THEN 'dev' WHEN b < 70 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT sku_id, {_BUCKET.format('mpn')} AS b FROM sku_inputs)")
def split_hash(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("bucket")
    x = table(spark, d, "sku_inputs").select("sku_id", X.percent_bucket(F.col("mpn"), "split:").alias("bucket"))
    return x.withColumn("split", F.when(b < 40, "dev").when(b < 70, "calibration").when(b.isNotNull(), "test"))


@query("SELECT doc_id, sha256(text) AS content_hash, md5(lower(trim(text))) AS loose_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null")
    return x.select("doc_id", F.sha2("text", 256).alias("content_hash"), F.md5(F.lower(F.btrim("text", F.lit(X.SPACES)))).alias("loose_hash"))


# ---- chunks and cells -------------------------------------------------------------------------------------------


@query("SELECT chunk_id, source_id, (i - 1)::INTEGER AS cell_ord, cells[i].header AS header, cells[i].value AS value FROM chunks, range(1, len(cells) + 1) t(i)")
def listing_cells(spark: SparkSession, d: str) -> DataFrame:
    return E.cells_of(table(spark, d, "chunks"), "chunk_id", "cells", ["source_id"])


@query("SELECT chunk_id, list_aggregate([c.header || ': ' || c.value FOR c IN cells IF trim(coalesce(c.value, '')) <> ''], 'string_agg', ' | ') AS line FROM chunks WHERE cells IS NOT NULL")
def cells_as_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("cells is not null").select("chunk_id", E.self_describing(F.col("cells")).alias("line"))


@query("SELECT source_id, page, count(*) AS n, [min(bbox[1]), min(bbox[2]), max(bbox[3]), max(bbox[4])] AS box FROM chunks WHERE bbox IS NOT NULL GROUP BY ALL")
def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    at = lambda i: F.get("bbox", F.lit(i))
    x = table(spark, d, "chunks").where("bbox is not null").groupBy("source_id", "page")
    return x.agg(F.count(F.lit(1)).alias("n"), F.array(F.min(at(0)), F.min(at(1)), F.max(at(2)), F.max(at(3))).alias("box"))


@query("""
SELECT p.chunk_id FROM chunks p WHERE p.locator = 'prose' AND p.bbox IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM chunks t WHERE t.source_id = p.source_id AND t.page = p.page AND t.locator = 'table_cell' AND t.bbox IS NOT NULL
    AND p.bbox[1] >= t.bbox[1] - 1 AND p.bbox[2] >= t.bbox[2] - 1 AND p.bbox[3] <= t.bbox[3] + 1 AND p.bbox[4] <= t.bbox[4] + 1)
""")
def prose_outside_tables(spark: SparkSession, d: str) -> DataFrame:
    """Spatial anti-join on the page."""
    c = table(spark, d, "chunks").where("bbox is not null")
    # prose in no table: equal pages meet, the four comparisons are part of the anti-join
    p, t = c.where("locator = 'prose'").alias("p"), c.where("locator = 'table_cell'").alias("t")
    b = lambda a, i: F.get(f"{a}.bbox", F.lit(i))
    inside = (b("p", 0) >= b("t", 0) - 1) & (b("p", 1) >= b("t", 1) - 1) & (b("p", 2) <= b("t", 2) + 1) & (b("p", 3) <= b("t", 3) + 1)
    return p.join(t, (F.col("p.source_id") == F.col("t.source_id")) & (F.col("p.page") == F.col("t.page")) & inside, "left_anti").select("chunk_id")


@query()
def header_keys(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct header with its attribute key, equal or most similar alias."""
    specs = table(spark, d, "attribute_specs")
    names = specs.select(F.explode(F.concat("aliases", F.array(F.replace("canonical_key", F.lit("_"), F.lit(" "))))).alias("alias"), "canonical_key")
    return E.match_headers(E.cells_of(table(spark, d, "chunks"), "chunk_id", "cells", []), "header", names)


@query("""
WITH a AS (SELECT lower(unnest(aliases)) AS alias, canonical_key FROM attribute_specs),
k AS (SELECT alias, min(canonical_key) AS canonical_key FROM a GROUP BY 1 HAVING count(DISTINCT canonical_key) = 1)
SELECT k.canonical_key, count(*) AS n, count(DISTINCT c.source_id) AS n_sources FROM (SELECT source_id, unnest(cells).header AS header FROM chunks) c JOIN k ON k.alias = lower(c.header) GROUP BY 1
""")
def exact_headers(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "attribute_specs").select(F.explode("aliases").alias("alias"), "canonical_key").withColumn("alias", F.lower("alias"))
    k = a.groupBy("alias").agg(F.min("canonical_key").alias("canonical_key"), F.countDistinct("canonical_key").alias("n")).where("n = 1").drop("n")
    cells = E.cells_of(table(spark, d, "chunks"), "chunk_id", "cells", ["source_id"]).withColumn("alias", F.lower("header"))
    return cells.join(F.broadcast(k), "alias").groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source_id").alias("n_sources"))


# ---- retrieval and verification ---------------------------------------------------------------------------------

_BM25 = """
WITH q AS (SELECT sku_id AS query_id, unnest(regexp_extract_all(lower(description_fragment), '[a-z]+|[0-9]+')) AS token FROM sku_inputs WHERE sku_id % 100 = 0),
qt AS (SELECT query_id, token, count(*) AS qtf FROM q GROUP BY ALL),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+|[0-9]+') AS t FROM documents),
p AS (SELECT doc_id, token, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS token FROM d) GROUP BY ALL),
n AS (SELECT count(DISTINCT doc_id) AS n, avg(coalesce(len(t), 0)) AS avgdl FROM d),
i AS (SELECT token, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, n GROUP BY token, n),
f AS (SELECT token, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM i),
s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN f USING (token) JOIN p USING (token), n GROUP BY ALL),
bm AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 50)
"""


@query(_BM25 + "SELECT query_id, doc_id, round(score, 4) AS score FROM bm WHERE rank <= 20")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "sku_inputs").where("sku_id % 100 = 0")
    found = R.bm25_topk(table(spark, d, "documents"), "doc_id", "text", asked, "sku_id", "description_fragment")
    return found.where("rank <= 20").select("query_id", "doc_id", (F.round(F.col("score") * 10000) / 10000).alias("score"))  # as SQL rounds


_SPACE = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def _gram_sql(rows: str, key: str, text: str) -> str:
    words = f"SELECT k, w, count(*) AS c FROM (SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), '{_SPACE}')) AS w FROM {rows}) WHERE w <> '' GROUP BY ALL"
    return f"SELECT k, substr(' ' || w || ' ', i, n) AS g, sum(c) AS tf FROM ({words}), range(3, 6) a(n), range(1, length(w) + 4 - n) b(i) GROUP BY ALL"


@query(_BM25.replace(" WHERE sku_id % 100 = 0", "") + f""", dg AS ({_gram_sql('documents', 'doc_id', 'text')}), asked AS (SELECT sku_id, coalesce(nullif(description_fragment, ''), mpn) AS t FROM sku_inputs), qg AS ({_gram_sql('asked', 'sku_id', 't')}),
vo AS (SELECT g, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM (SELECT g, sum(tf) AS n, count(*) AS df FROM dg GROUP BY 1 ORDER BY n DESC, g LIMIT {R.MAX_GRAMS})),
dv AS (SELECT k, g, tf * idf AS v FROM dg JOIN vo USING (g)), qv AS (SELECT k, g, tf * idf AS v FROM qg JOIN vo USING (g)),
dn AS (SELECT k, sqrt(sum(v * v)) AS n FROM dv GROUP BY 1), qn AS (SELECT k, sqrt(sum(v * v)) AS n FROM qv GROUP BY 1),
co AS (SELECT q.k AS query_id, d.k AS doc_id, round(sum(q.v * d.v / qn.n / dn.n), 6) AS score FROM qv q JOIN dv d USING (g) JOIN qn ON qn.k = q.k JOIN dn ON dn.k = d.k GROUP BY ALL),
o AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM co WHERE score > 0 QUALIFY rank <= 50),
u AS (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rank) AS s FROM bm UNION ALL SELECT query_id, doc_id, 0.3::DOUBLE / (60 + rank) FROM o),
r AS (SELECT query_id, doc_id, round(sum(s), 8) AS score FROM u GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY r.score DESC, doc_id) AS rank FROM r QUALIFY rank <= 25
""")
def fused_topk(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of the full-text ranking with an independent one by character grams: all inputs, each over all documents.

    The second list asks with the part number where there is no description, as the behaviour studied does.
    """
    asked = table(spark, d, "sku_inputs").withColumn("asked", F.coalesce(F.when(F.col("description_fragment") != "", F.col("description_fragment")), "mpn"))
    return R.fused_topk(table(spark, d, "documents"), "doc_id", "text", asked, "sku_id", "description_fragment", "asked").withColumn("score", F.round("score", 6))


@query("""
SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 50
""")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return R.dense_topk(e, "vec_id", "embedding", e.where("vec_id % 100 = 0"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Each product with its linked sources: ``_p, _s, _code``."""
    p = table(spark, d, "products").select(X.reference_key(F.col("id")).alias("_p"), X.mpn_normalise(F.col("mpn")).alias("_code"))
    links = table(spark, d, "product_sources").select(X.reference_key(F.col("product_id")).alias("_p"), X.reference_key(F.col("source_id")).alias("_s")).distinct()
    return p.join(links, "_p").where("_s is not null")


def _bounds(spark: SparkSession, d: str) -> tuple[int, int]:
    return VF.code_bounds(table(spark, d, "products").select(X.mpn_normalise(F.col("mpn")).alias("_code")), "_code")


def _naming(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of linked sources that name the product's part: ``_p, _s, chunk_id, chunk_ord, locator``."""
    c = spread(table(spark, d, "chunks").select("chunk_id", "source_id", "chunk_ord", "locator", "text"))
    return naming_chunks(c, X.reference_key(F.col("source_id")), "text", ["chunk_id", "chunk_ord", "locator"], _parts(spark, d), "_s", "_code", _bounds(spark, d)).drop("_code")


_CHARS = "array_to_string(string_split(" + _NORM.format("p.mpn") + ", ''), '[\\s\\-_./,]*')"
_FOUND = f"regexp_matches(upper(c.text), '(^|[^A-Z0-9\\-_./,]|[^A-Z0-9][\\-_./,]|^[\\-_./,])' || {_CHARS} || '([\\-_./,]*([^A-Z0-9\\-_./,]|$))')"
_LINKED = f"""
SELECT {_REF.format('p.id')} AS product_id, {_REF.format('c.source_id')} AS source_id, c.chunk_id, c.chunk_ord, c.locator, {_FOUND} AS present
FROM products p JOIN (SELECT DISTINCT {_REF.format('product_id')} AS pid, {_REF.format('source_id')} AS sid FROM product_sources) l ON l.pid = {_REF.format('p.id')}
JOIN chunks c ON {_REF.format('c.source_id')} = l.sid
"""


@query(f"SELECT product_id, source_id, count(*) AS n_chunks, count(*) FILTER (present) AS n_naming FROM ({_LINKED}) GROUP BY ALL")
def mpn_presence(spark: SparkSession, d: str) -> DataFrame:
    """The hard gate: in how many chunks of a linked source the part stands as a whole identifier."""
    size = table(spark, d, "chunks").groupBy(X.reference_key(F.col("source_id")).alias("_s")).agg(F.count(F.lit(1)).alias("n_chunks"))
    named = _naming(spark, d).groupBy("_p", "_s").agg(F.count(F.lit(1)).alias("n_naming"))
    x = _parts(spark, d).join(size, "_s").join(named, ["_p", "_s"], "left")
    return x.select(F.col("_p").alias("product_id"), F.col("_s").alias("source_id"), "n_chunks", F.coalesce("n_naming", F.lit(0)).alias("n_naming"))


@query(f"""
SELECT product_id, source_id, chunk_id FROM ({_LINKED}) WHERE present QUALIFY row_number() OVER (PARTITION BY product_id, source_id
  ORDER BY CASE locator WHEN 'table_cell' THEN 0 WHEN 'structured_field' THEN 1 WHEN 'prose' THEN 2 ELSE 3 END, chunk_ord, chunk_id) = 1
""")
def naming_chunk(spark: SparkSession, d: str) -> DataFrame:
    """The chunk that names the part best: table before field before prose, then document order."""
    rank = F.when(F.col("locator") == "table_cell", 0).when(F.col("locator") == "structured_field", 1).when(F.col("locator") == "prose", 2).otherwise(3)
    x = _naming(spark, d).groupBy(F.col("_p").alias("product_id"), F.col("_s").alias("source_id"))
    return x.agg(F.min(F.struct(rank, "chunk_ord", "chunk_id")).alias("b")).select("product_id", "source_id", "b.chunk_id")


_RANKED_SOURCES = "SELECT lower(trim(id)) AS sid, arg_max(coalesce(authority_rank, 9), (fetched_at, -coalesce(authority_rank, 9))) AS authority FROM sources GROUP BY 1"


def _authority(spark: SparkSession, d: str) -> DataFrame:
    rank = F.coalesce(F.col("authority_rank").cast("int"), F.lit(9))
    x = table(spark, d, "sources").groupBy(X.reference_key(F.col("id")).alias("_s")).agg(F.max(F.struct("fetched_at", (-rank).alias("r"))).alias("m"))
    return x.select("_s", (-F.col("m.r")).alias("authority"))


# The weights of a link's signals, the signal of each authority rank and the least score of a verified link.
LINK_WEIGHTS = {"slot": 0.45, "manufacturer": 0.20, "overlap": 0.20, "authority": 0.15}
AUTHORITY_SIGNAL, OTHER_SIGNAL, LINK_THRESHOLD = {1: 1.0, 2: 0.9, 3: 0.8, 4: 0.75, 5: 0.6}, 0.5, 0.70

_MAKER = "trim(regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'))"


_VERIFIED = f"""
WITH t AS ({_LINKED}), a AS ({_RANKED_SOURCES}),
g AS (SELECT t.product_id, t.source_id, max((present AND locator IN ('table_cell', 'structured_field'))::INT) AS slot, any_value(coalesce(authority, 9)) AS rank FROM t LEFT JOIN a ON a.sid = t.source_id GROUP BY ALL HAVING bool_or(present)),
h AS (SELECT {_REF.format('source_id')} AS sid, list(' ' || {_MAKER.format('text')} || ' ') AS hays, list_distinct(flatten(list(regexp_extract_all(lower(text), '[a-z0-9]+')))) AS words FROM chunks GROUP BY 1),
m AS (SELECT manufacturer_id, {_MAKER.format('n')} AS name FROM (SELECT manufacturer_id, unnest(list_append(aliases, canonical_name)) AS n FROM manufacturers)),
p AS (SELECT {_REF.format('id')} AS pid, {_NORM.format('mpn')} AS part, nullif({_MAKER.format('manufacturer')}, '') AS maker FROM products),
k AS (SELECT {_NORM.format('mpn')} AS part, arg_max(description_fragment, (received_at, sku_id)) AS fragment FROM sku_inputs WHERE trim(description_fragment) <> '' AND received_at IS NOT NULL GROUP BY 1),
w AS (SELECT part, list_distinct([x FOR x IN regexp_extract_all(lower(fragment), '[a-z0-9]+') IF length(x) > 1]) AS words FROM k),
n AS (SELECT pid, list(DISTINCT name) AS names FROM (SELECT pid, maker AS name FROM p WHERE maker IS NOT NULL UNION ALL SELECT pid, b.name FROM p JOIN m a ON a.name = maker JOIN m b USING (manufacturer_id)) WHERE name <> '' GROUP BY 1),
s AS (SELECT g.product_id, g.source_id, slot, n.pid IS NOT NULL AS named, coalesce(len([1 FOR x IN n.names IF len([1 FOR y IN h.hays IF contains(y, ' ' || x || ' ')]) > 0]) > 0, false)::INT AS manufacturer,
  coalesce(len(list_intersect(w.words, h.words)) / nullif(len(w.words), 0), 0) AS overlap, CASE rank WHEN 1 THEN 1.0 WHEN 2 THEN .9 WHEN 3 THEN .8 WHEN 4 THEN .75 WHEN 5 THEN .6 ELSE .5 END::DOUBLE AS authority
  FROM g JOIN p ON p.pid = g.product_id JOIN h ON h.sid = g.source_id LEFT JOIN n ON n.pid = p.pid LEFT JOIN w ON w.part = p.part),
r AS (SELECT *, round(CASE WHEN named THEN .45 * slot + .2 * manufacturer + .2 * overlap + .15 * authority ELSE (.45 * slot + .2 * overlap + .15 * authority) / .8 END, 4) AS score FROM s)
SELECT product_id, source_id, slot, manufacturer, round(overlap, 4) AS overlap, round(authority, 4) AS authority_signal, score, score >= 0.7 AS matched FROM r
"""


@query(_VERIFIED)
def verify_links(spark: SparkSession, d: str) -> DataFrame:
    """Product and source pairs that pass the gate, with four signals, their score and whether it reaches the threshold.

    The manufacturer (as typed, or any name of the entry it equals) counts where its words stand together in a chunk of the
    source; the overlap is the share of the words of the part's newest description that the source has. Without a
    manufacturer its weight is shared out. All signals come from equi-joins on source and word, so a hot source costs its words.
    """
    return _verified(spark, d, _naming(spark, d))


def _verified(spark: SparkSession, d: str, naming: DataFrame) -> DataFrame:
    named = naming.groupBy("_p", "_s").agg(F.max(F.col("locator").isin("table_cell", "structured_field").cast("int")).alias("slot"))
    chunks = spread(table(spark, d, "chunks").select(X.reference_key(F.col("source_id")).alias("_s"), "text"))
    products = table(spark, d, "products").select(X.reference_key(F.col("id")).alias("_p"), X.mpn_normalise(F.col("mpn")).alias("part"), "manufacturer")
    names = VF.maker_names(products, "_p", "manufacturer", table(spark, d, "manufacturers"), "manufacturer_id", "canonical_name", "aliases")
    makers = VF.makers_in_sources(chunks, "_s", "text", names.select("name"))
    maker = named.join(names, "_p").join(makers, ["_s", "name"], "left").groupBy("_p", "_s").agg(F.max(F.col("found").isNotNull().cast("int")).alias("manufacturer"))
    newest = table(spark, d, "sku_inputs").where(X.non_blank(F.col("description_fragment")).isNotNull() & F.col("received_at").isNotNull())
    newest = newest.groupBy(X.mpn_normalise(F.col("mpn")).alias("part")).agg(F.max(F.struct("received_at", "sku_id", "description_fragment")).alias("m"))
    asked = products.join(newest.select("part", X.word_set(F.col("m.description_fragment")).alias("words")), "part").where(F.size("words") > 0).select("_p", "words")
    words = chunks.select("_s", F.explode(X.word_set(F.col("text"), 1)).alias("word")).distinct()
    shared = named.join(asked, "_p").select("_p", "_s", F.size("words").alias("n"), F.explode("words").alias("word")).join(words.withColumn("hit", F.lit(1)), ["_s", "word"], "left")
    shared = shared.groupBy("_p", "_s").agg((F.count("hit") / F.first("n")).alias("overlap"))
    x = named.join(maker, ["_p", "_s"], "left").join(shared, ["_p", "_s"], "left").join(_authority(spark, d), "_s", "left")
    signal = F.lit(OTHER_SIGNAL)
    for rank, v in AUTHORITY_SIGNAL.items():
        signal = F.when(F.col("authority") == rank, F.lit(v)).otherwise(signal)
    w, overlap = LINK_WEIGHTS, F.coalesce("overlap", F.lit(0.0))
    rest = w["slot"] * F.col("slot") + w["overlap"] * overlap + w["authority"] * signal
    score = F.round(F.when(F.col("manufacturer").isNotNull(), rest + w["manufacturer"] * F.col("manufacturer")).otherwise(rest / (1 - w["manufacturer"])), 4)
    return x.select(F.col("_p").alias("product_id"), F.col("_s").alias("source_id"), "slot", F.coalesce("manufacturer", F.lit(0)).alias("manufacturer"), F.round(overlap, 4).alias("overlap"), F.round(signal, 4).alias("authority_signal"), score.alias("score"), (score >= LINK_THRESHOLD).alias("matched"))


# ---- candidates from text ---------------------------------------------------------------------------------------

# Abbreviations of the short descriptions and what they stand for.
LEXICON = [
    ("PA66", "body_material", "polyamide_66"), ("PBT", "body_material", "pbt_gf30"), ("CERAMIC", "body_material", "ceramic"), ("TIN", "contact_finish", "matte_tin"), ("SILVER", "contact_finish", "silver"),
    ("NICKEL BRASS", "body_material", "nickel_plated_brass"), ("PVDF", "body_material", "pvdf"), ("BRASS", "body_material", "forged_brass"), ("BRONZE", "body_material", "cast_bronze"),
    ("NBR", "seal_material", "nbr"), ("FKM", "seal_material", "fkm"), ("EPDM", "seal_material", "epdm"), ("NC", "valve_function", "normally_closed"), ("NO", "valve_function", "normally_open"),
    ("IP54", "ingress_rating", "ip_54"), ("IP66", "ingress_rating", "ip_66"), ("IP68", "ingress_rating", "ip_68"), ("GREY", "body_colour", "light_grey"), ("BLACK", "body_colour", "jet_black"),
    ("HALOGEN FREE", "halogen_free", "true"), ("POTABLE WATER", "potable_water", "true"), ("W/ LOCKNUT", "locknut_included", "true"),
]
# Fixed values: (key, unit, pattern) of numbers in short descriptions.
PATTERNS = [
    ("way_count", "", r"\b([0-9]+)(?:WAY|POL|P)\b"), ("pitch", "mm", r"(?:^| )([0-9.]+)MM\b"), ("rated_current", "A", r"(?:^| )([0-9.]+)A\b"), ("rated_voltage", "V", r"(?:^| )([0-9]+)V\b"),
    ("coil_voltage", "V", r"(?:^| )([0-9]+)VDC\b"), ("port_size", "inch", r"(?:^| )([0-9.]+)IN\b"), ("max_pressure", "bar", r"(?:^| )([0-9.]+)BAR\b"), ("clamp_max", "mm", r"(?:^| )[0-9]+-([0-9]+)MM\b"),
]
_LEX_ROWS = ", ".join(f"('{t}', '{k}', '{v}')" for t, k, v in LEXICON)
_TOKENS = f"""
WITH lex(token, canonical_key, value) AS (VALUES {_LEX_ROWS}),
w AS (SELECT sku_id AS row_id, [x FOR x IN regexp_split_to_array(upper(description_fragment), '[^A-Z0-9./#-]+') IF x <> ''] AS w FROM sku_inputs WHERE description_fragment IS NOT NULL),
r AS (SELECT row_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) AS token FROM w),
k AS (SELECT DISTINCT row_id, token, canonical_key, value FROM r JOIN lex USING (token))
"""


def _lexicon(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(LEXICON, "token string, canonical_key string, value string"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return E.lexicon_tokens(table(spark, d, "sku_inputs"), "sku_id", "description_fragment", _lexicon(spark), max(len(t.split()) for t, *_ in LEXICON))


@query(_TOKENS + "SELECT * FROM k")
def lexicon_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d)


@query(" UNION ALL ".join(f"SELECT sku_id AS row_id, '{k}' AS canonical_key, regexp_extract(upper(description_fragment), '{p}', 1) AS number, '{u}' AS unit FROM sku_inputs WHERE regexp_extract(upper(description_fragment), '{p}', 1) <> ''" for k, u, p in PATTERNS))
def pattern_values(spark: SparkSession, d: str) -> DataFrame:
    return E.pattern_values(table(spark, d, "sku_inputs"), "sku_id", "description_fragment", PATTERNS)


@query(_TOKENS + """, o AS (SELECT canonical_key FROM attribute_specs GROUP BY 1 HAVING count(DISTINCT category_code) < (SELECT count(DISTINCT category_code) FROM attribute_specs))
SELECT row_id, category_code, count(*) AS votes FROM (SELECT DISTINCT row_id, canonical_key FROM k) JOIN o USING (canonical_key) JOIN (SELECT DISTINCT category_code, canonical_key FROM attribute_specs) USING (canonical_key) GROUP BY ALL
""")
def schema_votes(spark: SparkSession, d: str) -> DataFrame:
    return E.schema_votes(_tokens(spark, d), table(spark, d, "attribute_specs").select("category_code", "canonical_key"))


@query(_TOKENS + """, o AS (SELECT canonical_key FROM attribute_specs GROUP BY 1 HAVING count(DISTINCT category_code) < (SELECT count(DISTINCT category_code) FROM attribute_specs)),
v AS (SELECT row_id, category_code, count(*) AS votes FROM (SELECT DISTINCT row_id, canonical_key FROM k) JOIN o USING (canonical_key) JOIN (SELECT DISTINCT category_code, canonical_key FROM attribute_specs) USING (canonical_key) GROUP BY ALL),
c AS (SELECT row_id, category_code FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY votes DESC, category_code) = 1),
p AS (SELECT regexp_replace(upper(mpn), '[^A-Z0-9]', '', 'g') AS mpn, min(category_code) AS actual FROM products GROUP BY 1 HAVING count(DISTINCT category_code) = 1)
SELECT actual, coalesce(category_code, 'none') AS chosen, count(*) AS n FROM sku_inputs s JOIN p ON p.mpn = regexp_replace(upper(s.mpn), '[^A-Z0-9]', '', 'g') LEFT JOIN c ON c.row_id = s.sku_id GROUP BY ALL
""")
def routing_confusion(spark: SparkSession, d: str) -> DataFrame:
    """How the category chosen by votes compares with the product's."""
    votes = E.schema_votes(_tokens(spark, d), table(spark, d, "attribute_specs").select("category_code", "canonical_key"))
    chosen = votes.groupBy("row_id").agg(F.min(F.struct((-F.col("votes")).alias("v"), "category_code")).alias("b")).select("row_id", "b.category_code")
    p = table(spark, d, "products").groupBy(X.mpn_normalise(F.col("mpn")).alias("_m")).agg(F.min("category_code").alias("actual"), F.countDistinct("category_code").alias("n")).where("n = 1").drop("n")
    s = table(spark, d, "sku_inputs").select("sku_id", X.mpn_normalise(F.col("mpn")).alias("_m")).join(p, "_m").join(chosen, F.col("sku_id") == F.col("row_id"), "left")
    return s.groupBy("actual", F.coalesce("category_code", F.lit("none")).alias("chosen")).agg(F.count(F.lit(1)).alias("n"))


# ---- value checks and adjudication ------------------------------------------------------------------------------


@query(f"""
SELECT canonical_key, count(*) AS n, count(*) FILTER (c.chunk_id IS NOT NULL) AS n_cited, count(*) FILTER (c.chunk_id IS NOT NULL AND span <> '' AND contains(c.text, span)) AS n_present
FROM candidates x LEFT JOIN (SELECT {_REF.format('chunk_id')} AS chunk_id, any_value(text) AS text FROM chunks GROUP BY 1) c ON c.chunk_id = {_REF.format('x.chunk_id')} GROUP BY 1
""")
def span_containment(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    x = V.span_present(table(spark, d, "candidates").select("canonical_key", "chunk_id", "span"), c, X.reference_key(F.col("chunk_id")), X.reference_key(F.col("chunk_id")), "span", "text")
    known = c.select(X.reference_key(F.col("chunk_id")).alias("_c"), F.lit(1).alias("_there")).distinct()
    x = x.withColumn("_c", X.reference_key(F.col("chunk_id"))).join(known, "_c", "left")
    return x.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("n"), F.count("_there").alias("n_cited"), F.sum(F.col("span_present").cast("int")).alias("n_present"))


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their canonical number, category and specification, and the authority of their source."""
    specs = table(spark, d, "attribute_specs")
    c = table(spark, d, "candidates").select("candidate_id", X.reference_key(F.col("product_id")).alias("product_id"), "canonical_key", "value", "unit", "raw_text", "tier", "locator", X.reference_key(F.col("source_id")).alias("_s"), "agreement_count", "consistency_ratio", "chunk_id", "span").distinct()
    c = to_canonical_units(c, specs, "canonical_key", "value").join(_authority(spark, d), "_s", "left")
    dims = specs.groupBy("canonical_key").agg(F.min("dimension").alias("dimension"))
    c = c.join(F.broadcast(dims), "canonical_key", "left")  # a key has one dimension
    return c.withColumn("authority", F.coalesce("authority", F.lit(9))).withColumn("value_key", A.value_key(F.col("canonical_value"), F.col("value"), F.col("dimension"))).drop("dimension")


_ADJUDICATED = f"""
s AS (SELECT *,
  round(0.40 * CASE locator WHEN 'table_cell' THEN 1.0 WHEN 'structured_field' THEN .85 WHEN 'prose' THEN .55 WHEN 'inferred' THEN .25 ELSE .2 END
  + 0.35 * CASE authority WHEN 1 THEN 1.0 WHEN 2 THEN .8 WHEN 3 THEN .65 WHEN 4 THEN .45 WHEN 5 THEN .3 WHEN 6 THEN .15 ELSE .1 END
  + 0.10 * CASE tier WHEN 'table' THEN 1.0 WHEN 'llm' THEN .75 WHEN 'rule' THEN .7 ELSE .5 END, 6) AS s FROM c),
v AS (SELECT product_id, canonical_key, vkey, round(max(s) + 0.15 * least(count(DISTINCT sid), 3) / 3, 6) AS score, count(DISTINCT sid) AS n_sources, min(authority) AS authority, count(*) AS agreement, arg_min(candidate_id, (-s, candidate_id)) AS item FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt, lead(authority) OVER w AS nxta, count(*) OVER (PARTITION BY product_id, canonical_key) AS n_values FROM v WINDOW w AS (PARTITION BY product_id, canonical_key ORDER BY score DESC, vkey)),
t AS (SELECT *, coalesce(authority = 1 AND nxta = 1, false) AS conflict FROM r WHERE rank = 1)
"""
_CLAIM = f"SELECT DISTINCT {_REF.format('product_id')} AS product_id, canonical_key, candidate_id, {_REF.format('source_id')} AS sid, tier, locator, value"
_TEXT_CLAIMS = f"""
WITH a AS ({_RANKED_SOURCES}),
c AS (SELECT x.*, 'c:' || {_CAT.format('value')} AS vkey, coalesce(authority, 9) AS authority FROM ({_CLAIM} FROM candidates WHERE canonical_key IN (SELECT canonical_key FROM attribute_specs WHERE value_type = 'enum')) x
  LEFT JOIN a USING (sid) WHERE value IS NOT NULL AND lower(trim(value)) NOT IN {_FILLER}),
{_ADJUDICATED}"""
_ALL_CLAIMS = f"""
WITH {canonical(f"{_CLAIM}, canonical_key AS k, unit, raw_text, agreement_count, consistency_ratio, chunk_id, span FROM candidates")},
a AS ({_RANKED_SOURCES}),
c1 AS (SELECT cv.*, coalesce(authority, 9) AS authority, CASE WHEN canonical_value IS NOT NULL THEN 'q:' || printf('%.6f', round(canonical_value, 6) + 0.0) || ':' || coalesce((SELECT min(dimension) FROM attribute_specs s WHERE s.canonical_key = cv.canonical_key), 'dimensionless')
  WHEN value IS NOT NULL AND lower(trim(value)) NOT IN {_FILLER} THEN 'c:' || {_CAT.format('value')} END AS vkey FROM cv LEFT JOIN a USING (sid)),
c AS (SELECT * FROM c1 WHERE vkey IS NOT NULL),
{_ADJUDICATED}"""
_DECIDED = """SELECT product_id, canonical_key, CASE WHEN NOT conflict THEN item END AS winner, CASE WHEN NOT conflict THEN vkey END AS value_key, round(score, 4) AS top_score, agreement, n_sources, n_values, conflict,
  NOT conflict AND coalesce(round(score - nxt, 6) < 0.15, false) AS close_call FROM t"""


@query(_ALL_CLAIMS + _DECIDED)
def adjudicate_claims(spark: SparkSession, d: str) -> DataFrame:
    """The winning value per product and key, with conflict and close-call flags."""
    x = A.adjudicate(_claims(spark, d), ["product_id", "canonical_key"], "value_key", "candidate_id", "_s", "authority", "locator", "tier")
    return x.withColumn("top_score", F.round("top_score", 4))


@query(_TEXT_CLAIMS + _DECIDED)
def adjudicate_enums(spark: SparkSession, d: str) -> DataFrame:
    """Adjudication of the enumerated keys, whose values need no unit."""
    enums = table(spark, d, "attribute_specs").where("value_type = 'enum'").select("canonical_key").distinct()
    x = A.adjudicate(_claims(spark, d).join(F.broadcast(enums), "canonical_key", "left_semi"), ["product_id", "canonical_key"], "value_key", "candidate_id", "_s", "authority", "locator", "tier")
    return x.withColumn("top_score", F.round("top_score", 4))


@query(_ALL_CLAIMS + "SELECT CASE WHEN n_values = 1 THEN 'single' WHEN conflict THEN 'conflict' WHEN coalesce(round(score - nxt, 6) < 0.15, false) THEN 'close' ELSE 'clear' END AS outcome, canonical_key, count(*) AS n FROM t GROUP BY ALL")
def adjudication_outcomes(spark: SparkSession, d: str) -> DataFrame:
    o = F.when(F.col("n_values") == 1, "single").when(F.col("conflict"), "conflict").when(F.col("close_call"), "close").otherwise("clear")
    return adjudicate_claims(spark, d).groupBy(o.alias("outcome"), "canonical_key").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {canonical(f"{_CLAIM}, canonical_key AS k, unit, raw_text, agreement_count, consistency_ratio, chunk_id, span FROM candidates")},
x AS (SELECT p.category_code, s.*, cv.value, cv.canonical_value AS q, regexp_replace(lower(cv.value), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS code FROM cv JOIN products p ON {_REF.format('p.id')} = cv.product_id
  JOIN attribute_specs s ON s.category_code = p.category_code AND s.canonical_key = cv.canonical_key)
SELECT category_code, canonical_key, count(*) AS n, sum(CASE value_type WHEN 'quantity' THEN (q IS NOT NULL)::INT WHEN 'enum' THEN (code <> '')::INT WHEN 'bool' THEN (lower(trim(value)) IN {_quoted(TRUE_WORDS + FALSE_WORDS)})::INT ELSE (lower(trim(coalesce(value, ''))) NOT IN {_FILLER})::INT END)::BIGINT AS type_ok,
  sum(CASE WHEN value_type = 'quantity' THEN (q IS NOT NULL)::INT END)::BIGINT AS unit_ok,
  sum(CASE WHEN value_type = 'enum' THEN list_contains([regexp_replace(lower(a), '[^\\p{{L}}\\p{{N}}]+', '', 'g') FOR a IN allowed_values], code)::INT END)::BIGINT AS enum_ok,
  sum(CASE WHEN value_type = 'quantity' AND q IS NOT NULL THEN (q BETWEEN least(plausible_min, plausible_max) AND greatest(plausible_min, plausible_max))::INT END)::BIGINT AS range_ok
FROM x GROUP BY ALL
""")
def value_checks(spark: SparkSession, d: str) -> DataFrame:
    """Type, unit, enumeration and range checks of every candidate, counted per category and key."""
    specs = table(spark, d, "attribute_specs")
    p = table(spark, d, "products").select(X.reference_key(F.col("id")).alias("product_id"), "category_code")
    x = _claims(spark, d).drop("canonical_unit").join(p, "product_id").join(F.broadcast(specs), ["category_code", "canonical_key"])
    checks = V.value_checks(F.col("value_type"), F.col("canonical_value"), F.col("value"), F.col("allowed_values"), F.col("plausible_min"), F.col("plausible_max"), F.col("canonical_value").isNotNull())
    return x.withColumns(checks).groupBy("category_code", "canonical_key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("int")).alias(c) for c in checks])


# ---- rules and families -----------------------------------------------------------------------------------------

RULES = [
    {"id": "temperature_order", "expr": "temp_min < temp_max", "severity": "error"},
    {"id": "clamping_order", "expr": "clamp_min <= clamp_max", "severity": "error"},
    {"id": "power_with_voltage", "when": "coil_voltage >= 110", "expr": "coil_power > 2 and coil_power < 60", "severity": "warn"},
    {"id": "weight_in_range", "when": "weight > 0", "expr": "weight <= 24000", "severity": "warn"},
]


_PIVOT = "pv AS (SELECT product_id, " + ", ".join(f"max(q) FILTER (k = '{k}') AS {k}" for k in ("temp_min", "temp_max", "clamp_min", "clamp_max", "coil_voltage", "coil_power", "weight")) + " FROM wide GROUP BY 1)"


@query(f"""
{WIDE_NUMBERS}, {_PIVOT},
r AS (SELECT product_id, 'temperature_order' AS rule_id, 'error' AS severity, temp_min < temp_max AS passed, ['temp_min', 'temp_max'] AS keys FROM pv
UNION ALL SELECT product_id, 'clamping_order', 'error', clamp_min <= clamp_max, ['clamp_min', 'clamp_max'] FROM pv
UNION ALL SELECT product_id, 'power_with_voltage', 'warn', CASE WHEN coil_power IS NOT NULL AND coil_voltage >= 110 THEN coil_power > 2 AND coil_power < 60 END, ['coil_power'] FROM pv
UNION ALL SELECT product_id, 'weight_in_range', 'warn', CASE WHEN weight > 0 THEN weight <= 24000 END, ['weight'] FROM pv)
SELECT product_id, rule_id, severity, passed, unnest(keys) AS key FROM r WHERE passed IS NOT NULL
""")
def relational_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules between attributes of a product, on the wide table."""
    return V.apply_rules(p1_wide(spark, d), "product_id", RULES)


def _labels(spark: SparkSession, d: str) -> DataFrame:
    part = X.mpn_normalise(F.col("mpn_normalised"))
    return table(spark, d, "eval_labels").select(part.alias("part"), F.concat(F.coalesce("manufacturer_resolved", F.lit("?")), F.lit("|"), X.family_prefix(part)).alias("family"), "canonical_key", "value_text", F.lower(F.trim("split")).alias("split"), "audited", "label_source").distinct()


_LABELS = f"(SELECT DISTINCT {_NORM.format('mpn_normalised')} AS part, coalesce(manufacturer_resolved, '?') || '|' || substr({_NORM.format('mpn_normalised')}, 1, 8) AS family, canonical_key, value_text, lower(trim(split)) AS split, audited, label_source FROM eval_labels)"


@query(f"""
WITH v AS (SELECT family, canonical_key, part AS member, max(try_cast(value_text AS DOUBLE)) AS v FROM {_LABELS} GROUP BY ALL HAVING max(try_cast(value_text AS DOUBLE)) IS NOT NULL),
m AS (SELECT a.family, a.canonical_key, a.member, a.v, median(b.v) AS med FROM v a JOIN v b ON a.family = b.family AND a.canonical_key = b.canonical_key AND a.member <> b.member GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT m.*, (SELECT median(abs(b.v - m.med)) FROM v b WHERE b.family = m.family AND b.canonical_key = m.canonical_key AND b.member <> m.member) AS mad FROM m)
SELECT family, canonical_key, member, round(med, 6) AS median, round(mad, 6) AS mad, CASE WHEN mad > 0 THEN round(abs(v - med) / mad, 6) END AS deviation,
  CASE WHEN mad > 0 THEN round(abs(v - med) / mad, 6) <= 5 ELSE v = med END AS coherent FROM d
""")
def family_outliers(spark: SparkSession, d: str) -> DataFrame:
    v = _labels(spark, d).groupBy("family", "canonical_key", F.col("part").alias("member")).agg(F.max(F.col("value_text").try_cast("double")).alias("v"))
    return V.family_outliers(v, "family", "canonical_key", "member", "v")


_ENUM_VALUES = f"""(SELECT coalesce(p.manufacturer_resolved, '?') || '|' || substr({_NORM.format('p.mpn')}, 1, 8) AS family, v.canonical_key, p.id, max({_CAT.format('v.value_text')}) AS value
FROM provenance v JOIN products p ON {_REF.format('p.id')} = {_REF.format('v.product_id')} WHERE v.resolution = 'published' AND v.canonical_key IN (SELECT canonical_key FROM attribute_specs WHERE value_type = 'enum')
  AND lower(trim(v.value_text)) NOT IN {_FILLER} GROUP BY ALL)"""


@query(f"""
WITH v AS {_ENUM_VALUES}, n AS (SELECT family, canonical_key, count(*) AS n FROM v GROUP BY ALL HAVING count(*) > 5)
SELECT family, canonical_key, min(id) AS member, value, n - 1 AS n_peers FROM v JOIN n USING (family, canonical_key) GROUP BY family, canonical_key, value, n HAVING count(*) = 1
""")
def family_strangers(spark: SparkSession, d: str) -> DataFrame:
    """Published values of enumerated keys that no other member of the family (maker and prefix) has."""
    enums = table(spark, d, "attribute_specs").where("value_type = 'enum'").select("canonical_key").distinct()
    v = table(spark, d, "provenance").where("resolution = 'published'").where(~X.is_not_stated(F.col("value_text"))).join(F.broadcast(enums), "canonical_key", "left_semi")
    v = v.select(X.reference_key(F.col("product_id")).alias("_p"), "canonical_key", X.categorical(F.col("value_text")).alias("value"))
    p = table(spark, d, "products").select("id", X.reference_key(F.col("id")).alias("_p"), F.concat(F.coalesce("manufacturer_resolved", F.lit("?")), F.lit("|"), X.family_prefix(F.col("mpn"))).alias("family"))
    v = v.join(p, "_p").groupBy("family", "canonical_key", "id").agg(F.max("value").alias("value"))
    return V.family_strangers(v, "family", "canonical_key", "id", "value")


@query(f"""
WITH m AS (SELECT DISTINCT family, part FROM {_LABELS}), s AS (SELECT family, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 5),
h AS (SELECT DISTINCT family, part, canonical_key FROM {_LABELS} WHERE value_text IS NOT NULL),
t AS (SELECT family, canonical_key, count(*) AS have, n FROM h JOIN s USING (family) GROUP BY ALL HAVING count(*) / (n - 1) > 0.9)
SELECT m.family, m.part, t.canonical_key, round(have / (n - 1), 4) AS share FROM m JOIN t USING (family) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.family = m.family AND h.part = m.part AND h.canonical_key = t.canonical_key)
""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d)
    return V.coverage_gaps(x.select("family", "part").distinct(), x.where("value_text is not null"), "family", "part", "canonical_key")


# ---- confidence and evaluation ----------------------------------------------------------------------------------


_OUTCOMES = f"""
(SELECT p.prov_id, p.criticality, p.confidence, p.tier, p.resolution, p.canonical_key, l.value_text AS label, p.value_text AS predicted,
  CASE WHEN l.part IS NULL OR p.value_text IS NULL THEN NULL WHEN try_cast(p.value_text AS DOUBLE) IS NOT NULL AND try_cast(l.value_text AS DOUBLE) IS NOT NULL
    THEN abs(try_cast(p.value_text AS DOUBLE) - try_cast(l.value_text AS DOUBLE)) <= greatest(0.01 * greatest(abs(try_cast(p.value_text AS DOUBLE)), abs(try_cast(l.value_text AS DOUBLE))), 1e-9)
    ELSE regexp_replace(lower(p.value_text), '[^a-z0-9]', '', 'g') = regexp_replace(lower(l.value_text), '[^a-z0-9]', '', 'g') END AS correct
FROM (SELECT DISTINCT * FROM provenance) p JOIN (SELECT {_REF.format('id')} AS pid, {_NORM.format('mpn')} AS part FROM products) x ON x.pid = {_REF.format('p.product_id')}
LEFT JOIN (SELECT part, canonical_key, max(value_text) AS value_text FROM {_LABELS} GROUP BY ALL) l ON l.part = x.part AND l.canonical_key = p.canonical_key)
"""


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Stored values against labels: a tolerance of 1 % for numbers, letters and digits for the rest; null without a label."""
    p = table(spark, d, "provenance").distinct().withColumn("_p", X.reference_key(F.col("product_id")))
    x = table(spark, d, "products").select(X.reference_key(F.col("id")).alias("_p"), X.mpn_normalise(F.col("mpn")).alias("part"))
    lab = _labels(spark, d).groupBy("part", "canonical_key").agg(F.max("value_text").alias("label"), F.lit(True).alias("_labelled"))
    o = p.join(x, "_p").join(lab, ["part", "canonical_key"], "left")
    a, b = F.col("value_text").try_cast("double"), F.col("label").try_cast("double")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    close = F.abs(a - b) <= F.greatest(0.01 * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-9))
    correct = F.when(F.col("_labelled") & F.col("value_text").isNotNull(), F.when(a.isNotNull() & b.isNotNull(), close).otherwise(plain(F.col("value_text")) == plain(F.col("label"))))
    return o.select("prov_id", "criticality", "confidence", "tier", "resolution", "canonical_key", "label", F.col("value_text").alias("predicted"), correct.alias("correct"))


@query(f"SELECT coalesce(criticality, 'all') AS criticality, count(*) AS n, round(avg(correct::INT), 4) AS precision FROM {_OUTCOMES} WHERE resolution = 'published' AND correct IS NOT NULL GROUP BY ROLLUP (criticality)")
def precision_by_criticality(spark: SparkSession, d: str) -> DataFrame:
    x = _outcomes(spark, d).where("resolution = 'published' and correct is not null").rollup("criticality")
    return x.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("correct").cast("int")), 4).alias("precision")).withColumn("criticality", F.coalesce("criticality", F.lit("all")))


@query(f"""
WITH o AS (SELECT canonical_key, abs(try_cast(predicted AS DOUBLE) / nullif(try_cast(label AS DOUBLE), 0)) AS r FROM {_OUTCOMES} WHERE correct = false)
SELECT canonical_key, CASE WHEN r BETWEEN 0.9 AND 1.1 THEN 'near_miss' WHEN r BETWEEN 20 AND 2000 OR r BETWEEN 0.0005 AND 0.05 THEN 'wrong_unit' ELSE 'wrong_value' END AS error, count(*) AS n FROM o GROUP BY ALL
""")
def error_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    r = F.abs(F.try_divide(F.col("predicted").try_cast("double"), F.col("label").try_cast("double")))
    e = F.when(r.between(0.9, 1.1), "near_miss").when(r.between(20, 2000) | r.between(0.0005, 0.05), "wrong_unit").otherwise("wrong_value")
    return _outcomes(spark, d).where("correct = false").groupBy("canonical_key", e.alias("error")).agg(F.count(F.lit(1)).alias("n"))


_BINS = f"(SELECT criticality, least(floor(round(confidence * 10, 9)), 9)::INT AS bin, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, round(avg(correct::INT), 4) AS observed_accuracy FROM {_OUTCOMES} WHERE correct IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL)"


@query(f"SELECT * FROM {_BINS}")
def reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    return C.reliability(_outcomes(spark, d), "confidence", "correct", by=["criticality"])


@query(f"SELECT criticality, sum(n)::BIGINT AS n, round(sum(n * abs(mean_confidence - observed_accuracy)) / sum(n), 4) AS ece FROM {_BINS} GROUP BY 1")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return C.calibration_error(reliability_bins(spark, d), by=["criticality"])


@query(f"""
WITH o AS (SELECT confidence, correct FROM {_OUTCOMES} WHERE correct IS NOT NULL AND confidence IS NOT NULL), s AS (SELECT range AS i FROM range(21))
SELECT round(i / 20, 3) AS threshold, count(o.correct) AS n, round(count(o.correct) / (SELECT count(*) FROM o), 4) AS coverage, round(avg(correct::INT), 4) AS precision FROM s LEFT JOIN o ON floor(round(confidence * 20, 9)) >= i GROUP BY i
""")
def abstention_curve(spark: SparkSession, d: str) -> DataFrame:
    return C.abstention_curve(_outcomes(spark, d), "confidence", "correct")


_FEATURES = ["tier_table", "tier_rule", "tier_llm", "f_confidence"]


@query()
def calibrator(spark: SparkSession, d: str) -> DataFrame:
    """The logistic calibration per criticality: coefficients, or the base rate where nothing can be fitted."""
    o = _outcomes(spark, d).withColumns({**{f"tier_{t}": (F.col("tier") == t).cast("double") for t in ("table", "rule", "llm")}, "f_confidence": F.coalesce("confidence", F.lit(0.0))})
    return C.fit_calibrator(o, "criticality", _FEATURES, "correct")


@query(f"""
SELECT category_code, source_status, split, count(*) AS n, grouping(source_status) AS no_status, grouping(split) AS no_split FROM
  (SELECT DISTINCT p.id, p.category_code, p.source_status, l.split FROM products p JOIN {_LABELS} l ON l.part = {_NORM.format('p.mpn')})
GROUP BY GROUPING SETS ((), (category_code), (category_code, source_status), (category_code, split))
""")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").select("id", "category_code", "source_status", X.mpn_normalise(F.col("mpn")).alias("part"))
    x = p.join(_labels(spark, d).select("part", "split"), "part").select("id", "category_code", "source_status", "split").distinct()
    sets = [[], ["category_code"], ["category_code", "source_status"], ["category_code", "split"]]
    out = x.groupingSets([[F.col(c) for c in s] for s in sets], "category_code", "source_status", "split")
    return out.agg(F.count(F.lit(1)).alias("n"), F.grouping("source_status").cast("bigint").alias("no_status"), F.grouping("split").cast("bigint").alias("no_split"))


@query(f"""
WITH r AS (SELECT category_code, count(DISTINCT canonical_key) AS n FROM attribute_specs WHERE required GROUP BY 1),
f AS (SELECT p.id, substr({_NORM.format('p.mpn')}, 1, 8) AS family, r.n, count(DISTINCT s.canonical_key) AS k FROM products p JOIN r USING (category_code)
  LEFT JOIN (SELECT DISTINCT {_REF.format('product_id')} AS pid, canonical_key FROM provenance WHERE resolution = 'published') v ON v.pid = {_REF.format('p.id')}
  LEFT JOIN attribute_specs s ON s.category_code = p.category_code AND s.canonical_key = v.canonical_key AND s.required GROUP BY ALL)
SELECT family, count(*) AS members, round(avg(k / n), 4) AS coverage, round(stddev_pop(k / n), 4) AS spread FROM f GROUP BY 1 HAVING count(*) >= 3
""")
def coverage_spread(spark: SparkSession, d: str) -> DataFrame:
    """How evenly the members of a family are covered."""
    c = _completeness(spark, d).join(table(spark, d, "products").select("id", X.family_prefix(F.col("mpn")).alias("family")), "id")
    r = F.col("n_filled") / F.col("n_required")
    return c.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.round(F.avg(r), 4).alias("coverage"), F.round(F.stddev_pop(r), 4).alias("spread")).where("members >= 3")


@query("SELECT canonical_key, label_source, count(*) AS n, count(*) FILTER (audited) AS n_audited, count(DISTINCT value_text) AS n_values FROM eval_labels GROUP BY ALL")
def label_summary(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "eval_labels").groupBy("canonical_key", "label_source")
    return x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("audited").cast("int")).alias("n_audited"), F.countDistinct("value_text").alias("n_values"))


@query(f"SELECT {_NORM.format('mpn')} AS part, count(*) AS n FROM products GROUP BY 1 HAVING count(*) > 1")
def duplicate_parts(spark: SparkSession, d: str) -> DataFrame:
    return V.duplicates(table(spark, d, "products").select(X.mpn_normalise(F.col("mpn")).alias("part")), ["part"])


# ---- records for the shop ---------------------------------------------------------------------------------------


def _completeness(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").select("id", "category_code", X.reference_key(F.col("id")).alias("_p"))
    cells = table(spark, d, "provenance").where("resolution = 'published'").select(X.reference_key(F.col("product_id")).alias("_p"), "canonical_key").distinct().join(p.select("id", "_p"), "_p")
    return M.completeness(p, "id", "category_code", cells, table(spark, d, "attribute_specs"))


@query(f"""
WITH n AS (SELECT p.id, s.canonical_key, any_value(s.criticality) AS criticality, max(v.pid IS NOT NULL) AS have FROM products p JOIN attribute_specs s ON s.category_code = p.category_code AND s.required
  LEFT JOIN (SELECT DISTINCT {_REF.format('product_id')} AS pid, canonical_key FROM provenance WHERE resolution = 'published') v ON v.pid = {_REF.format('p.id')} AND v.canonical_key = s.canonical_key GROUP BY ALL)
SELECT id, count(*) AS n_required, count(*) FILTER (have) AS n_filled, round(count(*) FILTER (have) / count(*), 4) AS ratio,
  coalesce(list_sort(list(canonical_key) FILTER (NOT have)), []) AS missing, coalesce(list_sort(list(canonical_key) FILTER (NOT have AND criticality = 'safety')), []) AS blocking FROM n GROUP BY 1
""")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    return _completeness(spark, d)


@query()
def facet_maps(spark: SparkSession, d: str) -> DataFrame:
    """Two maps per product: numbers in canonical units and texts."""
    specs = table(spark, d, "attribute_specs")
    x = to_canonical_units(table(spark, d, "provenance").where("resolution = 'published'"), specs, "canonical_key", "value_text", raw_text=None)
    x = x.withColumn("_t", F.when(F.col("canonical_value").isNull() & ~X.is_not_stated(F.col("value_text")), X.categorical(F.col("value_text")))).withColumn("product_id", X.reference_key(F.col("product_id")))
    return M.facets(x, "product_id", "canonical_key", "canonical_value", "_t")


@query(f"""
SELECT id, trim(regexp_replace(concat_ws(' ', initcap_cat, coalesce(manufacturer_resolved, '')) || ' ' || mpn, ' +', ' ', 'g')) AS title FROM
  (SELECT id, manufacturer_resolved, mpn, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(category_code, '_')], ' ') AS initcap_cat FROM products)
""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    slots = {"category": M.display_words(F.col("category_code")), "manufacturer": F.col("manufacturer_resolved"), "mpn": F.col("mpn")}
    return table(spark, d, "products").select("id", M.fill_template("{category} {manufacturer} {mpn}", slots).alias("title"))


@query(f"""
WITH n AS (SELECT sku_id, {_NORM.format('mpn')} AS part, list_distinct(regexp_extract_all(description_fragment, '[0-9]+(?:\\.[0-9]+)?')) AS found FROM sku_inputs WHERE description_fragment IS NOT NULL),
u AS (SELECT sku_id, part, unnest(found) AS x FROM n), k AS (SELECT DISTINCT sku_id, part, rtrim(rtrim(printf('%.6f', x::DOUBLE), '0'), '.') AS x FROM u),
l AS (SELECT DISTINCT part, rtrim(rtrim(printf('%.6f', v::DOUBLE), '0'), '.') AS x FROM (SELECT part, unnest(regexp_extract_all(value_text, '[0-9]+(?:\\.[0-9]+)?')) AS v FROM {_LABELS}))
SELECT sku_id, list_sort(list(k.x)) AS numbers FROM k WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.part = k.part AND l.x = k.x) GROUP BY 1
""")
def unlicensed_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a short description that none of the part's labels states."""
    lic = _labels(spark, d).groupBy("part").agg(F.array_distinct(F.flatten(F.collect_set(M.numbers_in(F.col("value_text"))))).alias("licensed"))  # one part's labels
    s = table(spark, d, "sku_inputs").where("description_fragment is not null").select("sku_id", X.mpn_normalise(F.col("mpn")).alias("part"), "description_fragment").join(lic, "part", "left")
    return s.select("sku_id", M.unlicensed_numbers(F.col("description_fragment"), F.col("licensed")).alias("numbers")).where(F.size("numbers") > 0)


# ---- storing ----------------------------------------------------------------------------------------------------


@query("SELECT id, arg_max(content_hash, (fetched_at, coalesce(content_hash, ''))) AS content_hash, max(fetched_at) AS fetched_at, count(*) AS n_rows FROM sources GROUP BY 1")
def newest_sources(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "sources")
    n = x.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))
    return S.newest(x, [F.col("id")], [F.col("fetched_at"), F.coalesce("content_hash", F.lit(""))]).select("id", "content_hash", "fetched_at").join(n, "id")


@query("""
WITH s AS (SELECT DISTINCT id AS source, fetched_at, content_hash AS c FROM sources), l AS (SELECT *, lag(c) OVER (PARTITION BY source ORDER BY fetched_at, c) AS before FROM s)
SELECT source, fetched_at AS "at", row_number() OVER (PARTITION BY source ORDER BY fetched_at, c) AS revision FROM l WHERE before IS NULL OR before <> c
""")
def source_revisions(spark: SparkSession, d: str) -> DataFrame:
    return S.revisions(table(spark, d, "sources"), F.col("id"), F.col("fetched_at"), F.col("content_hash"))


@query(f"""
WITH s AS (SELECT DISTINCT id, fetched_at, content_hash FROM sources), c AS (SELECT {_REF.format('id')} AS sid FROM s GROUP BY 1 HAVING count(DISTINCT content_hash) > 1)
SELECT DISTINCT {_REF.format('l.product_id')} AS product_id, {_REF.format('l.source_id')} AS source_id FROM product_sources l JOIN c ON c.sid = {_REF.format('l.source_id')} WHERE trim(l.product_id) <> ''
""")
def products_to_recheck(spark: SparkSession, d: str) -> DataFrame:
    """Products linked to a source whose content changed."""
    changed = S.revisions(table(spark, d, "sources"), F.col("id"), F.col("fetched_at"), F.col("content_hash")).groupBy(X.reference_key(F.col("source")).alias("source_id")).agg(F.max("revision").alias("r")).where("r > 1").select("source_id")
    links = table(spark, d, "product_sources").select(X.reference_key(F.col("product_id")).alias("product_id"), X.reference_key(F.col("source_id")).alias("source_id")).where("product_id is not null")
    return links.join(changed, "source_id", "left_semi").select("product_id", "source_id").distinct()


@query(f"""
SELECT l.pid AS product_id, sha256(list_aggregate(list_sort(list(DISTINCT l.sid || ':' || coalesce(s.content_hash, ''))), 'string_agg', '|')) AS combined
FROM (SELECT DISTINCT {_REF.format('product_id')} AS pid, {_REF.format('source_id')} AS sid FROM product_sources WHERE trim(product_id) <> '') l JOIN sources s ON {_REF.format('s.id')} = l.sid GROUP BY 1
""")
def combined_hash(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sources").select(X.reference_key(F.col("id")).alias("_s"), "content_hash").distinct()
    links = table(spark, d, "product_sources").select(X.reference_key(F.col("product_id")).alias("product_id"), X.reference_key(F.col("source_id")).alias("_s")).where("product_id is not null").distinct()
    return S.combined_hash(links.join(s, "_s"), "product_id", "_s", "content_hash")


_HALF = "SELECT id, manufacturer_resolved, mpn_normalised, source_content_hash, created_at FROM products"


@query(f"""
WITH o AS ({_HALF} QUALIFY row_number() OVER (PARTITION BY manufacturer_resolved, mpn_normalised ORDER BY created_at, id) = 1),
n AS ({_HALF} QUALIFY row_number() OVER (PARTITION BY manufacturer_resolved, mpn_normalised ORDER BY created_at DESC, id DESC) = 1)
SELECT o.id, n.manufacturer_resolved, n.mpn_normalised, n.source_content_hash, o.created_at FROM n JOIN o ON o.mpn_normalised = n.mpn_normalised AND o.manufacturer_resolved IS NOT DISTINCT FROM n.manufacturer_resolved
""")
def upsert_products(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of each part, brought up to date by the last ones; identifier and creation time stay."""
    p = table(spark, d, "products").select("id", "manufacturer_resolved", "mpn_normalised", "source_content_hash", "created_at")
    keys = [F.col("manufacturer_resolved"), F.col("mpn_normalised")]
    new = S.newest(p, keys, [F.col("created_at"), F.col("id")])
    old = p.groupBy("manufacturer_resolved", "mpn_normalised").agg(F.min(F.struct("created_at", "id", "source_content_hash")).alias("m")).select("m.id", "manufacturer_resolved", "mpn_normalised", "m.source_content_hash", "m.created_at")
    return S.upsert(old, new, ["manufacturer_resolved", "mpn_normalised"], ["id", "created_at"])


@query(f"""
WITH r AS (SELECT DISTINCT prov_id, {_REF.format('product_id')} AS product_id, canonical_key, value_text, unit, resolution, loaded_at FROM provenance WHERE trim(product_id) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id, canonical_key ORDER BY loaded_at DESC, prov_id DESC) AS i FROM r)
SELECT a.product_id, a.canonical_key, CASE WHEN b.prov_id IS NULL THEN 'new' ELSE 'changed' END AS change FROM k a LEFT JOIN k b ON b.product_id = a.product_id AND b.canonical_key = a.canonical_key AND b.i = 2
WHERE a.i = 1 AND (b.prov_id IS NULL OR a.value_text IS DISTINCT FROM b.value_text OR a.unit IS DISTINCT FROM b.unit OR a.resolution IS DISTINCT FROM b.resolution)
""")
def changed_values(spark: SparkSession, d: str) -> DataFrame:
    """Product and key pairs whose last run brought something else than the run before."""
    x = table(spark, d, "provenance").select("prov_id", X.reference_key(F.col("product_id")).alias("product_id"), "canonical_key", "value_text", "unit", "resolution", "loaded_at").where("product_id is not null").distinct()
    k = V.window_rank(x, ["product_id", "canonical_key"], [F.desc("loaded_at"), F.desc("prov_id")], "i").where("i <= 2")
    return S.changed_keys(k.where("i = 2"), k.where("i = 1"), ["product_id", "canonical_key"], ["value_text", "unit", "resolution"])


@query("SELECT id, mpn, manufacturer, source_status FROM products WHERE source_status = 'verified' ORDER BY mpn, id LIMIT 100 OFFSET 50")
def list_products(spark: SparkSession, d: str) -> DataFrame:
    """A page of the list, as the service shows it (the limit is the feature)."""
    return table(spark, d, "products").where("source_status = 'verified'").orderBy("mpn", "id").offset(50).limit(100).select("id", "mpn", "manufacturer", "source_status")


