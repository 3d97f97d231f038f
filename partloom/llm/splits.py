"""Splits that keep related records together.

Records that share an entity, also over several steps, form one component. Components are found by alternating large-star
and small-star steps on the edges (record, entity); the component's identifier is hashed into proportional ranges. Minima
are taken with partial aggregation and joined back (the side of the minima has one row per node), so a node that holds a
third of all edges is never gathered in one task. Each round is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node's smaller neighbours, and the node itself, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for each node of the undirected ``edges`` (columns ``u``, ``v``); the component is its least node.

    Edges with a null end and loops are left out (a node that has only such edges has no row); repeated edges count once.
    An empty table gives an empty table. The rounds grow with the logarithm of the longest path; ``max_rounds`` only
    guards against a defect and raises.
    """
    now = cut_lineage(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        now = cut_lineage(_small_star(_large_star(now)))
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sign) == state:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
        state = tuple(sign)
    raise RuntimeError("the components did not settle")


def related_groups(records: DataFrame, record: str, links: DataFrame, link_record: str, link_entity: str) -> DataFrame:
    """``record, group_id`` for each distinct non-null value of ``records[record]``.

    ``links`` ties records to entities; null or missing ties leave a record in a group of its own.
    """
    edges = links.select(F.concat(F.lit("r:"), F.col(link_record)).alias("u"), F.concat(F.lit("e:"), F.col(link_entity)).alias("v"))
    # identifiers of entities sort before those of records: the component's name is an entity's
    found = components(edges).where(F.col("node").startswith("r:"))
    own = records.select(F.col(record).alias("record")).where("record is not null").distinct().withColumn("node", F.concat(F.lit("r:"), F.col("record")))
    return own.join(found, "node", "left").select("record", F.coalesce("component", "node").alias("group_id"))


def assign_split(group: Column, proportions: dict[str, float], seed: str = "split") -> Column:
    """The split of a group: its hash in [0, 1) against the cumulated proportions, which must add up to 1."""
    if abs(sum(proportions.values()) - 1) > 1e-9 or min(proportions.values()) < 0:
        raise ValueError("proportions must be non-negative and add up to 1")
    at = F.pmod(F.xxhash64(F.lit(seed), group), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    names = list(proportions)
    out, total = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        total = sum(proportions[x] for x in names[: names.index(name) + 1])
        out = F.when(at < total, F.lit(name)).otherwise(out)
    return F.when(group.isNotNull(), out)


def split_leaks(groups: DataFrame, labels: DataFrame, record: str, split: str) -> DataFrame:
    """Records of groups that carry more than one split; ``groups`` as made by ``related_groups``. Null splits do not count."""
    named = labels.select(F.col(record).alias("record"), F.col(split).alias("split")).where("split is not null").distinct().join(groups, "record")
    torn = named.groupBy("group_id").agg((F.min("split") != F.max("split")).alias("torn")).where("torn").select("group_id")
    return groups.join(torn, "group_id", "left_semi").select("record", "group_id")
