"""Filling containers of fixed capacity with items of varying size.

1. Items larger than a container are cut into full pieces and a rest; no other item is split.
2. The piece sizes are counted: at most ``capacity`` counts, whatever the number of items, so the plan is made on the driver.
3. Shallow combinations of sizes that fill a container up to a small window are enumerated; non-negative least squares
   finds how often each is to be repeated so that together they use up the counts; the repeats are rounded down.
4. What is left of the counts is packed greedily, largest size first, each time with the largest size that still fits.
5. Each piece finds its container from its rank among the pieces of its size. Ranks are numbered within salted parts of
   a size, so that a size held by a third of all items is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import cut_lineage

#: pieces of one size that are numbered in one task
RANK_ROWS = 1_000_000


def enumerate_patterns(counts: np.ndarray, capacity: int, window: int) -> list[dict[int, int]]:
    """Combinations of up to three sizes, each repeated, that leave at most ``window`` unused.

    ``counts[s]`` is the number of pieces of size ``s``. For each present size and number of repeats the gap is closed by
    one further size, or by a size of the histogram's quantiles and one further size.
    """
    present = np.flatnonzero(counts)
    if not len(present):
        return []
    below = np.zeros(capacity + 1, dtype=np.int64)  # the largest present size of at most i
    below[present] = present
    below = np.maximum.accumulate(below)
    share = np.cumsum(counts[present]) / counts[present].sum()
    middle = np.unique(present[np.searchsorted(share, np.linspace(0.02, 0.98, 25)).clip(0, len(present) - 1)])
    seen: set[tuple] = set()
    out = []

    def add(pattern: dict[int, int]) -> None:
        key = tuple(sorted(pattern.items()))
        if key not in seen and all(counts[s] >= m for s, m in key):
            seen.add(key)
            out.append(pattern)

    def close(base: dict[int, int], gap: int) -> None:
        if 0 <= gap <= window:
            add(dict(base))
        for times in range(1, 9):
            s = int(below[gap // times]) if gap > 0 else 0
            if s <= 0:
                break
            if gap - s * times <= window:
                p = dict(base)
                p[s] = p.get(s, 0) + times
                add(p)

    for s in present.tolist():
        for times in sorted({1, 2, 3, 4, capacity // s}):
            gap = capacity - s * times
            if times < 1 or gap < 0:
                continue
            close({s: times}, gap)
            if times == 1:
                for m in middle.tolist():
                    for more in (1, 2, 3):
                        if gap - m * more >= 0:
                            p = {s: 1}
                            p[m] = p.get(m, 0) + more
                            close(p, gap - m * more)
    return out


def solve_repeats(patterns: list[dict[int, int]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeats x that minimise the squared error of patterns * x against the counts.

    Accelerated projected gradient on the sparse matrix; each row is weighted by the size, so that the error is one of
    used capacity.
    """
    rows = np.array([s for p in patterns for s in p], dtype=np.int64)
    cols = np.array([j for j, p in enumerate(patterns) for _ in p], dtype=np.int64)
    vals = np.array([m for p in patterns for m in p.values()], dtype=float)
    weight = np.sqrt(np.maximum(np.arange(len(counts), dtype=float), 1.0))
    a = vals * weight[rows]
    b = counts.astype(float) * weight
    scale = np.sqrt(np.bincount(cols, a * a, minlength=len(patterns)))  # columns of length one
    a = a / scale[cols]
    n, m = len(patterns), len(counts)
    x = np.random.default_rng(7).random(n)
    for _ in range(30):  # the largest eigenvalue, for the step
        x = np.bincount(cols, a * np.bincount(rows, a * x[cols], minlength=m)[rows], minlength=n)
        top = np.linalg.norm(x)
        x = x / top
    step = 1.0 / (1.02 * top)
    x = np.zeros(n)
    y, t = x, 1.0
    for _ in range(rounds):
        error = np.bincount(rows, a * y[cols], minlength=m) - b
        new = np.maximum(0.0, y - step * np.bincount(cols, a * error[rows], minlength=n))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x / scale


def plan_containers(counts: np.ndarray, capacity: int, window: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, repeats) that use each piece exactly once; ``counts[s]`` pieces of size s, s = 1 .. capacity."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    plan: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        plan.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    patterns = enumerate_patterns(left, capacity, window)
    if patterns:
        repeats = np.floor(solve_repeats(patterns, left) + 1e-9).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable"):
            if repeats[j] <= 0:
                break
            p = patterns[j]
            r = min(int(repeats[j]), *(int(left[s]) // m for s, m in p.items()))
            if r > 0:
                plan.append((p, r))
                for s, m in p.items():
                    left[s] -= r * m
    # the rest: largest first, each gap closed with the largest size that fits
    size = capacity
    while True:
        while size > 0 and left[size] == 0:
            size -= 1
        if size == 0:
            return plan
        p, gap, s = {size: 1}, capacity - size, size
        while gap > 0:
            s = min(s, gap)
            while s > 0 and left[s] - p.get(s, 0) <= 0:
                s -= 1
            if s == 0:
                break
            take = min(gap // s, int(left[s]) - p.get(s, 0))
            p[s] = p.get(s, 0) + take
            gap -= take * s
        r = min(int(left[s]) // m for s, m in p.items())
        plan.append((p, r))
        for s, m in p.items():
            left[s] -= r * m


def fill_containers(items: DataFrame, item: str, size: str, capacity: int, window: int = 8) -> DataFrame:
    """One row per piece: ``item, piece, start, n, container_id``.

    ``item`` identifies a row (a repeated row gets the same key and is packed again), ``size`` its size. ``piece`` counts
    the pieces of an item from 0, ``start`` is where it begins, ``n`` its size. An item of null or zero size takes no room:
    one piece with ``container_id`` null. Container ids run from 0 without gaps; no container exceeds ``capacity``.
    An empty table gives an empty table.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    spark = items.sparkSession
    n = F.coalesce(F.col(size), F.lit(0)).cast("bigint")
    base = items.select(F.col(item).alias("item"), n.alias("size"))
    last = F.greatest(F.ceil(F.col("size") / capacity).cast("bigint"), F.lit(1)) - 1
    pieces = base.select("item", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece"))
    start = F.col("piece") * capacity
    pieces = pieces.select("item", F.col("piece").cast("int").alias("piece"), start.alias("start"), F.least(F.lit(capacity).cast("bigint"), F.col("size") - start).cast("int").alias("n"))
    pieces = cut_lineage(pieces)

    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.where("n > 0").groupBy("n").count().collect():  # at most `capacity` rows
        counts[r["n"]] = r["count"]
    plan = plan_containers(counts, capacity, window)

    # where each pattern's containers begin, and which ranks of a size it takes
    first, taken, entries = 0, np.zeros(capacity + 1, dtype=np.int64), []
    for p, repeats in plan:
        for s, m in p.items():
            entries.append((s, int(taken[s]), first, m))
            taken[s] += m * repeats
        first += repeats
    assert (taken[1:] == counts[1:]).all()
    slots = spark.createDataFrame(entries or [(0, 0, 0, 1)], "n int, from_rank bigint, first bigint, times int")
    slots = slots.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("from_rank", "first", "times"))).alias("slots"))

    salts = spark.createDataFrame([(int(s), int(-(-counts[s] // RANK_ROWS))) for s in np.flatnonzero(counts)] or [(0, 1)], "n int, salts int")
    salted = pieces.where("n > 0").join(F.broadcast(salts), "n").withColumn("salt", F.pmod(F.xxhash64("item", "piece"), F.col("salts")).cast("int"))
    per_salt = salted.groupBy("n", "salt").count().collect()  # at most capacity + pieces / RANK_ROWS rows
    offsets, at = [], {}
    for r in sorted(per_salt, key=lambda r: (r["n"], r["salt"])):
        offsets.append((r["n"], r["salt"], at.get(r["n"], 0)))
        at[r["n"]] = at.get(r["n"], 0) + r["count"]
    offset = spark.createDataFrame(offsets or [(0, 0, 0)], "n int, salt int, before bigint")
    rank = F.row_number().over(Window.partitionBy("n", "salt").orderBy("item", "piece")) - 1
    ranked = salted.withColumn("_r", rank).join(F.broadcast(offset), ["n", "salt"]).withColumn("rank", F.col("_r") + F.col("before"))
    slot = F.element_at(F.filter(F.col("slots"), lambda x: x["from_rank"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(slots), "n").withColumn("slot", slot)
    container = F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.from_rank")) / F.col("slot.times"))
    placed = placed.select("item", "piece", "start", "n", container.cast("bigint").alias("container_id"))
    return placed.unionByName(pieces.where("n <= 0").select("item", "piece", "start", F.lit(0).alias("n"), F.lit(None).cast("bigint").alias("container_id")))
