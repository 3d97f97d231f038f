"""Queries of the operators on text and training corpora (problems 2, 4 and 6 to 10) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.text import attribute_key, is_not_stated, mpn_normalise, non_blank, reference_key
from partloom.llm.bpe import encode_column, token_counts
from partloom.llm.mapping import match_names
from partloom.llm.packing import fill_containers
from partloom.llm.sentences import split_sentences
from partloom.llm.splits import assign_split, related_groups, split_leaks
from partloom.llm.survivors import survivors
from partloom.llm.truncation import score_truncation, truncated_share
from partloom.sources.tables import table

#: Shares of the splits: the constants of the evaluation (40 / 30 / 30).
SPLITS = {"dev": 0.4, "calibration": 0.3, "test": 0.3}
CAPACITY = 2048


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    part = mpn_normalise(F.col("mpn_normalised"))
    return table(spark, folder, "eval_labels").select(F.when(part != "", part).alias("part"), F.lower(non_blank(F.col("split"))).alias("split"))


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    part = mpn_normalise(F.coalesce(non_blank(F.col("mpn_normalised")), F.col("mpn")))
    links = table(spark, folder, "products").select(F.when(part != "", part).alias("part"), F.upper(non_blank(F.col("mpn_family"))).alias("family"))
    return related_groups(_labels(spark, folder), "part", links, "part", "family")


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    typed = table(spark, folder, "products").select(non_blank(F.col("manufacturer")).alias("manufacturer"))
    return match_names(typed, "manufacturer", table(spark, folder, "manufacturers"), "manufacturer_id", "canonical_name", "aliases")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The manufacturer that each product's typed name means, 0 for none."""
    products = table(spark, folder, "products").select(F.col("id").alias("product_id"), non_blank(F.col("manufacturer")).alias("value")).where("value is not null")
    return products.join(_matches(spark, folder), "value", "left").select("product_id", F.coalesce("entry_id", F.lit(0)).alias("manufacturer_id"))


def p2_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Typed names that mean no entry, with the best one they were compared with."""
    return _matches(spark, folder).where("entry_id is null").select("value", "form", "best_id", F.round("score", 6).alias("score"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled parts whose group of related parts carries more than one split."""
    return split_leaks(_groups(spark, folder), _labels(spark, folder), "part", "split").select(F.col("record").alias("mpn_normalised"))


def p4_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Each labelled part with its group and the split that keeps the group together."""
    g = _groups(spark, folder)
    return g.select(F.col("record").alias("mpn_normalised"), "group_id", assign_split(F.col("group_id"), SPLITS).alias("split"))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return score_truncation(table(spark, folder, "sku_inputs"), "sku_id", "description_fragment", "feed")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose description lost its end."""
    return _scored(spark, folder).where("score >= 0.5").select(F.col("row_id").alias("sku_id"))


def p6_by_feed(spark: SparkSession, folder: str) -> DataFrame:
    """How often each feed truncates."""
    return truncated_share(_scored(spark, folder)).withColumnRenamed("source", "feed")


def _trusted(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates with the rank of their source's newest row and the confidence of the link to their product."""
    rank = F.coalesce(F.col("authority_rank").cast("int"), F.lit(9))
    newest = F.max(F.struct("fetched_at", (-rank).alias("r")))
    sources = table(spark, folder, "sources").select(reference_key(F.col("id")).alias("_s"), "fetched_at", "authority_rank").where("_s is not null").groupBy("_s").agg((-newest["r"]).alias("_rank"))
    links = table(spark, folder, "product_sources").select(reference_key(F.col("product_id")).alias("_p"), reference_key(F.col("source_id")).alias("_s"), "match_confidence")
    links = links.where("_p is not null and _s is not null").groupBy("_p", "_s").agg(F.max("match_confidence").alias("_conf"))
    rows = table(spark, folder, "candidates").select("candidate_id", reference_key(F.col("product_id")).alias("_p"), attribute_key(F.col("canonical_key")).alias("_k"), "value", "agreement_count", reference_key(F.col("source_id")).alias("_s"))
    return rows.where("_p is not null and _k is not null").join(sources, "_s", "left").join(links, ["_p", "_s"], "left")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate of each product and key that is most to be trusted: the first in order, as no weights add up here."""
    order = [is_not_stated(F.col("value")).cast("int"), F.coalesce("_rank", F.lit(9)), -F.coalesce("_conf", F.lit(0.0)), -F.coalesce(F.col("agreement_count").cast("int"), F.lit(0))]
    out = survivors(_trusted(spark, folder), {"product_id": F.col("_p"), "canonical_key": F.col("_k")}, F.col("candidate_id"), F.trim("value"), order)
    return out.withColumnRenamed("item", "candidate_id")


def p7_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """The same with weights that add up: agreement of several sources may outvote one of higher authority."""
    stated = (~is_not_stated(F.col("value"))).cast("double")
    trust = (10 - F.coalesce("_rank", F.lit(9))) / 9 + F.coalesce("_conf", F.lit(0.0)) + F.least(F.coalesce(F.col("agreement_count"), F.lit(0)), F.lit(5)) / 5
    order = [-stated, -F.round(trust, 6)]
    out = survivors(_trusted(spark, folder), {"product_id": F.col("_p"), "canonical_key": F.col("_k")}, F.col("candidate_id"), F.lower(F.trim("value")), order, weight=stated * F.round(trust, 6))
    return out.withColumnRenamed("item", "candidate_id")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_column(table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "ids")


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Each piece of a document with its container of 2,048 tokens."""
    sizes = token_counts(table(spark, folder, "documents"), "doc_id", "text")
    return fill_containers(sizes, "doc_id", "n_tokens", CAPACITY).withColumnsRenamed({"item": "doc_id", "start": "start_token", "n": "n_tokens"})


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of every document."""
    return split_sentences(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")


QUERIES = {"p2_found": p2_found, "p2_unmatched": p2_unmatched, "p4_found": p4_found, "p4_splits": p4_splits, "p6_found": p6_found, "p6_by_feed": p6_by_feed, "p7_found": p7_found, "p7_consensus": p7_consensus, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}

_PART = "regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g')"
ORACLE: dict[str, str] = {
    "p7_found": """
WITH s AS (SELECT lower(trim(id)) AS s, arg_max(coalesce(authority_rank, 9), (fetched_at, -coalesce(authority_rank, 9))) AS rank FROM sources GROUP BY 1),
l AS (SELECT lower(trim(product_id)) AS p, lower(trim(source_id)) AS s, max(match_confidence) AS conf FROM product_sources GROUP BY 1, 2),
c AS (SELECT DISTINCT lower(trim(product_id)) AS p, regexp_replace(lower(trim(canonical_key)), '[\\s\\-_./]+', '_', 'g') AS k, candidate_id, source_id, agreement_count, value FROM candidates WHERE trim(product_id) <> ''),
r AS (SELECT c.p, c.k, c.candidate_id, count(*) OVER (PARTITION BY c.p, c.k) AS n,
  row_number() OVER (PARTITION BY c.p, c.k ORDER BY
    (value IS NULL OR lower(trim(value)) IN ('', 'n/a', 'n.a.', '-', '--', '---', '?', 'tbc', 'tbd', 'unknown', 'not stated', 'k. a.', 'k.a.', 'on request', 'see drawing', 'auf anfrage')),
    coalesce(rank, 9), coalesce(conf, 0) DESC, coalesce(agreement_count, 0) DESC, candidate_id) AS rn
  FROM c LEFT JOIN s ON s.s = lower(trim(c.source_id)) LEFT JOIN l ON l.p = c.p AND l.s = lower(trim(c.source_id)))
SELECT p AS product_id, k AS canonical_key, candidate_id FROM r WHERE rn = 1 AND n > 1
""",
    "p4_found": f"""
WITH RECURSIVE link AS (
  SELECT DISTINCT {_PART.format('mpn_normalised')} AS part, upper(trim(mpn_family)) AS family FROM products WHERE trim(mpn_family) <> ''),
tie AS (SELECT DISTINCT a.part AS x, b.part AS y FROM link a JOIN link b USING (family)),
reach AS (SELECT x, y FROM tie UNION SELECT r.x, t.y FROM reach r JOIN tie t ON r.y = t.x),
label AS (SELECT DISTINCT {_PART.format('mpn_normalised')} AS part, lower(trim(split)) AS split FROM eval_labels),
own AS (SELECT part, coalesce((SELECT min(y) FROM reach WHERE x = part), part) AS grp FROM (SELECT DISTINCT part FROM label)),
torn AS (SELECT grp FROM label JOIN own USING (part) GROUP BY grp HAVING count(DISTINCT nullif(split, '')) > 1)
SELECT part AS mpn_normalised FROM own WHERE grp IN (SELECT grp FROM torn)
"""
}
