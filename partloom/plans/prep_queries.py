"""Queries of the general data-preparation operators (problems 1, 3 and 5) over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.functions.text import attribute_key, reference_key
from partloom.operators.references import broken_by_period, broken_references
from partloom.operators.units import to_canonical_units, value_milli
from partloom.operators.wide import scoped_specs, to_wide, typed_cells, wide_columns
from partloom.plans import prep_sql
from partloom.sources.tables import table


def _wide(spark: SparkSession, folder: str) -> DataFrame:
    specs = table(spark, folder, "attribute_specs")
    products = table(spark, folder, "products").select(F.col("id").alias("_pid"), F.col("category_code").alias("_cat"), reference_key(F.col("id")).alias("_ref"))
    rows = table(spark, folder, "provenance").select(reference_key(F.col("product_id")).alias("_ref"), "canonical_key", "value_text", "unit", "created_at", "loaded_at")
    rows = to_canonical_units(rows.where("value_text is not null").join(products, "_ref"), specs, "canonical_key", "value_text", unit="unit", raw_text=None)
    cells = typed_cells(
        rows, F.col("_pid"), F.col("_cat"), attribute_key(F.col("canonical_key")), F.col("value_text"), [F.col("created_at"), F.col("loaded_at")], scoped_specs(specs), F.col("canonical_value")
    )
    kinds = specs.select(attribute_key(F.col("canonical_key")).alias("a"), "value_type").distinct().collect()  # metadata: one row per key of the schema
    return to_wide(cells, wide_columns([(r["a"], r["value_type"]) for r in kinds]), entity="product_id")


def p1_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per product with a typed column per canonical key (quantities in the canonical unit)."""
    return _wide(spark, folder)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Product and key pairs whose values are all unreadable."""
    names = table(spark, folder, "attribute_specs").select("canonical_key", attribute_key(F.col("canonical_key")).alias("a")).distinct()
    bad = _wide(spark, folder).select("product_id", F.explode("unread").alias("a"))
    return bad.join(F.broadcast(names), "a").select("product_id", "canonical_key")


# table, field, row id, time of the reference, target table, target key, time of the target
_REFERENCES = [
    ("provenance", "product_id", "prov_id", "created_at", "products", "id", "created_at"),
    ("provenance", "source_id", "prov_id", "created_at", "sources", "id", "fetched_at"),
    ("product_sources", "source_id", "link_id", "linked_at", "sources", "id", "fetched_at"),
    ("candidates", "chunk_id", "candidate_id", None, "chunks", "chunk_id", None),
]


def _broken(spark: SparkSession, folder: str, month: bool) -> DataFrame:
    out = None
    for ref, field, row_id, at, target, key, first in _REFERENCES:
        refs = table(spark, folder, ref)
        period = F.date_trunc("month", F.col(at or "extracted_at")).cast("timestamp_ntz")
        part = broken_references(
            refs,
            [reference_key(F.col(field))],
            table(spark, folder, target),
            [reference_key(F.col(key))],
            F.col(row_id),
            F.col(at) if at else None,
            F.col(first) if first else None,
            keep={"month": period} if month else None,
        ).withColumns({"ref_table": F.lit(ref), "ref_field": F.lit(field)})
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each missing or late reference once (repeated rows are one row)."""
    return _broken(spark, folder, month=False).select("ref_table", "ref_field", "row_id", "kind").distinct()


def p3_by_month(spark: SparkSession, folder: str) -> DataFrame:
    """References, missing and late ones per table, field and month of the referring row."""
    checked = None
    for ref, field, row_id, at, *_ in _REFERENCES:
        part = table(spark, folder, ref).where(reference_key(F.col(field)).isNotNull()).select(
            F.lit(ref).alias("ref_table"), F.lit(field).alias("ref_field"), F.date_trunc("month", F.col(at or "extracted_at")).cast("timestamp_ntz").alias("month")
        )
        checked = part if checked is None else checked.unionByName(part)
    return broken_by_period(checked, _broken(spark, folder, month=True))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates whose quantity can be converted, with 1000 times the value in the canonical unit."""
    specs = table(spark, folder, "attribute_specs")
    rows = table(spark, folder, "candidates").select("candidate_id", "canonical_key", "value", "unit", "raw_text")
    out = to_canonical_units(rows, specs, "canonical_key", "value")
    return out.where("canonical_value is not null").select("candidate_id", value_milli(F.col("canonical_value")).alias("value_milli")).distinct()


QUERIES = {"p1_found": p1_found, "p1_wide": p1_wide, "p3_found": p3_found, "p3_by_month": p3_by_month, "p5_found": p5_found}

_REF_SQL = """
SELECT '{ref}' AS ref_table, '{field}' AS ref_field, r.{row_id} AS row_id, {month} AS month,
       CASE WHEN t.k IS NULL THEN 'missing' WHEN {late} THEN 'late' END AS kind
FROM {ref} r LEFT JOIN (SELECT lower(trim({key})) AS k, {first} AS first_at FROM {target} GROUP BY 1) t ON t.k = lower(trim(r.{field}))
WHERE trim(r.{field}) <> ''
"""


def _ref_sql() -> str:
    return " UNION ALL ".join(
        _REF_SQL.format(
            ref=ref, field=field, row_id=row_id, key=key, target=target, month=f"date_trunc('month', r.{at or 'extracted_at'})::TIMESTAMP",
            first=f"min({first})" if first else "NULL::TIMESTAMP", late=f"t.first_at > r.{at}" if at else "false",
        )
        for ref, field, row_id, at, target, key, first in _REFERENCES
    )


ORACLE = {
    "p3_found": f"SELECT DISTINCT ref_table, ref_field, row_id, kind FROM ({_ref_sql()}) WHERE kind IS NOT NULL",
    "p3_by_month": f"SELECT ref_table, ref_field, month, count(*) AS n_refs, count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'late') AS n_late FROM ({_ref_sql()}) GROUP BY ALL",
}
ORACLE |= {"p1_found": prep_sql.P1_FOUND, "p5_found": prep_sql.P5_FOUND}
