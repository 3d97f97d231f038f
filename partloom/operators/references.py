"""References to records that do not exist, or that exist only later.

Composite keys may be partly null. References are grouped by their null mask (which key columns are null); each mask is
anti-joined on its non-null columns only, under the declared match semantics:

* ``simple``   a reference with any null column is satisfied;
* ``full``     all columns null is satisfied, some null is a violation, none null must match;
* ``partial``  the non-null columns must match some target row; all null is satisfied.

The target side of each join is one pre-aggregated row per key, so only the referring side can be skewed; adaptive
execution splits its hot partitions (a sort-merge left join may always split its left side). Nothing is collected.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, LATE, PARTLY_NULL = "missing", "late", "partly_null"


def broken_references(
    refs: DataFrame,
    ref_keys: list[Column],
    target: DataFrame,
    target_keys: list[Column],
    row_id: Column,
    ref_time: Column | None = None,
    target_time: Column | None = None,
    semantics: str = "simple",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """One row (``row_id``, ``kind``, ``keep`` columns) for each reference that is not satisfied.

    ``kind`` is ``missing`` when no target row matches, ``late`` when the earliest ``target_time`` of the matching target
    rows is after ``ref_time`` (both given and not null), ``partly_null`` for a half-null key under ``full``. Target rows
    with a null key column match only masks that leave this column out. Repeated reference rows are reported as often as
    they stand; columns of either table may clash in name, for only the given expressions are read. Empty tables: an
    empty target makes every checked reference missing.
    """
    if semantics not in ("simple", "full", "partial"):
        raise ValueError(f"unknown match semantics: {semantics}")
    if len(ref_keys) != len(target_keys) or not ref_keys:
        raise ValueError("as many reference as target key columns are needed")
    n = len(ref_keys)
    keep = keep or {}
    none_t = F.lit(None).cast("timestamp_ntz")
    left = refs.select(
        row_id.alias("row_id"),
        *[c.alias(f"_k{i}") for i, c in enumerate(ref_keys)],
        (ref_time if ref_time is not None else none_t).alias("_at"),
        *[c.alias(k) for k, c in keep.items()],
    )
    right = target.select(*[c.alias(f"_k{i}") for i, c in enumerate(target_keys)], (target_time if target_time is not None else none_t).alias("_first"))
    parts = []
    for mask in product((False, True), repeat=n):  # True: null; at most 2^n joins, n is the width of the key
        kept = [f"_k{i}" for i in range(n) if not mask[i]]
        if not kept or (semantics == "simple" and any(mask)):
            continue
        of_mask = left
        for i in range(n):
            of_mask = of_mask.where(F.col(f"_k{i}").isNull() if mask[i] else F.col(f"_k{i}").isNotNull())
        if semantics == "full" and any(mask):
            parts.append(of_mask.select("row_id", F.lit(PARTLY_NULL).alias("kind"), *keep))
            continue
        keys = right.dropna(subset=kept).groupBy(*kept).agg(F.min("_first").alias("_first"), F.lit(True).alias("_there"))
        kind = F.when(F.col("_there").isNull(), F.lit(MISSING)).when(F.col("_first") > F.col("_at"), F.lit(LATE))
        parts.append(of_mask.join(keys, kept, "left").select("row_id", kind.alias("kind"), *keep).where(F.col("kind").isNotNull()))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def broken_by_period(checked: DataFrame, broken: DataFrame) -> DataFrame:
    """References and broken ones per table, field and month.

    ``checked`` has one row per reference (``ref_table ref_field month``), ``broken`` one per broken reference with its
    ``kind``; both are counted before they meet, so the join is between two small count tables.
    """
    by = ["ref_table", "ref_field", "month"]
    totals = checked.groupBy(*by).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = broken.groupBy(*by).agg(
        F.count(F.when(F.col("kind") == MISSING, 1)).alias("n_missing"), F.count(F.when(F.col("kind") == LATE, 1)).alias("n_late")
    )
    # a null month must meet a null month
    on = [totals[c].eqNullSafe(bad[c]) for c in by]
    joined = totals.join(bad, on, "left")
    zero = lambda c: F.coalesce(bad[c], F.lit(0)).alias(c)
    return joined.select(*[totals[c] for c in by], "n_refs", zero("n_missing"), zero("n_late"))
