"""Keeping tables up to date: NULL-safe upsert, replacing child rows, revisions and what they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(rows: DataFrame, keys: list[Column], order: list[Column], item: Column | None = None) -> DataFrame:
    """One row per key: the last in ``order`` (nulls first). A partial aggregation, so a hot key is no hot task."""
    names = [f"_k{i}" for i in range(len(keys))]
    x = rows.groupBy(*[k.alias(n) for k, n in zip(keys, names)]).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"))).alias("m"))
    return x.select("m.row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with an equal key; nulls equal nulls.

    Columns in ``keep`` (identifiers, creation times) stay as they were in the old row. ``new`` must have one row per key. Written by
    the caller to a new path that then takes the old one's place, so that a retry changes nothing.
    """
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    untouched = old.join(new, same, "left_anti")
    o = old.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[F.col(c).alias(f"_old_{c}") for c in keep], F.lit(True).alias("_was"))
    merged = new.join(o, [new[k].eqNullSafe(o[f"_o_{k}"]) for k in keys], "left")
    merged = merged.select(*[F.when(F.col("_was"), F.col(f"_old_{c}")).otherwise(new[c]).alias(c) if c in keep else new[c] for c in old.columns])
    return untouched.unionByName(merged)


def replace_children(children: DataFrame, parent: str, fresh: DataFrame) -> DataFrame:
    """Child rows with those of the parents in ``fresh`` replaced as a whole."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(fresh)


def changed_keys(stored: DataFrame, fresh: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Keys of ``fresh`` that are new or differ from ``stored`` in any compared column; nulls equal nulls."""
    s = stored.select(*keys, *[F.col(c).alias(f"_s_{c}") for c in compared], F.lit(True).alias("_was"))
    differs = F.col("_was").isNull()
    for c in compared:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return fresh.join(s, keys, "left").where(differs).select(*keys, F.when(F.col("_was").isNull(), F.lit("new")).otherwise(F.lit("changed")).alias("change"))


def revisions(rows: DataFrame, source: Column, at: Column, content: Column) -> DataFrame:
    """``source, at, revision``: fetches that brought other content than the one before (the first one counts)."""
    from pyspark.sql import Window

    x = rows.select(source.alias("source"), at.alias("at"), content.alias("content")).distinct()
    w = Window.partitionBy("source").orderBy("at", "content")
    x = x.withColumn("before", F.lag("content").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("content")))
    return x.select("source", "at", F.row_number().over(w).alias("revision"))


def combined_hash(links: DataFrame, parent: str, source: str, content: str) -> DataFrame:
    """``parent, combined``: SHA-256 of the sorted distinct ``source:content`` pairs of a parent's sources; a null content is an empty one."""
    pair = F.concat_ws(":", F.col(source), F.coalesce(F.col(content), F.lit("")))
    return links.groupBy(parent).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(pair)), "|"), 256).alias("combined"))


def coalesce_dimension(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of a dimension brought up to date: of each column the new value, or the old one where the new one is null; keys of both sides stay."""
    o = old.select(*[F.col(c).alias(f"_o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in old.columns])
    x = o.join(n, F.col(f"_o_{key}") == F.col(f"_n_{key}"), "full")
    return x.select(*[F.coalesce(f"_n_{c}", f"_o_{c}").alias(c) for c in old.columns])


def map_rows(df: DataFrame, entity: str, values: str) -> DataFrame:
    """A table of maps as rows: ``entity, key, value``; null and empty maps give none."""
    return df.select(entity, F.explode(values).alias("key", "value"))
