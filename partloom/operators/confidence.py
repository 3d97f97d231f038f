"""Confidence: heuristic score, reliability of predictions, and a logistic calibration per group."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The weights of the heuristic score.
BASE, BONUS, PENALTY, CEILING = 0.55, {"table_cell": 0.20, "structured_field": 0.10, "tier_table": 0.10, "agreement": 0.10, "authority": 0.10}, {"no_span": 0.25, "inferred": 0.15}, 0.999


def heuristic(locator: Column, tier: Column, agreement: Column, authority: Column, span_present: Column) -> Column:
    """A base score with bonuses for where and how a value was found, for up to three agreeing claims and for 1 over the authority rank, and penalties.

    A null span check counts as passed, a null agreement as none, a null authority as rank 9; the result lies within 0 and .999.
    """
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    s = F.lit(BASE) + BONUS["table_cell"] * flag(locator == "table_cell") + BONUS["structured_field"] * flag(locator == "structured_field") + BONUS["tier_table"] * flag(tier == "table")
    s = s + BONUS["agreement"] * F.least(F.coalesce(agreement, F.lit(0)), F.lit(3)) / 3 + BONUS["authority"] / F.greatest(F.coalesce(authority, F.lit(9)), F.lit(1))
    s = s - PENALTY["no_span"] * flag(~span_present) - PENALTY["inferred"] * flag(locator == "inferred")
    return F.round(F.least(F.greatest(s, F.lit(0.0)), F.lit(CEILING)), 6)


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Equal bins of confidence (the last one closed): ``bin, n, mean_confidence, observed_accuracy``; rows with a null are left out."""
    by = by or []
    x = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull()).withColumn("bin", F.least(F.floor(F.round(F.col(confidence) * bins, 9)), F.lit(bins - 1)).cast("int"))
    return x.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence), 4).alias("mean_confidence"), F.round(F.avg(F.col(correct).cast("int")), 4).alias("observed_accuracy"))


def calibration_error(bins: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Expected calibration error from reliability rows: the mean gap of the bins, weighted by their rows."""
    by = by or []
    return bins.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("mean_confidence") - F.col("observed_accuracy"))) / F.sum("n"), 4).alias("ece"))


def abstention_curve(df: DataFrame, confidence: str, correct: str, steps: int = 21) -> DataFrame:
    """``threshold, n, coverage, precision`` for evenly spaced thresholds.

    Rows are counted per step of the highest threshold they reach (partial aggregation, at most ``steps`` rows); the curve
    is the running sum from above. An empty input gives the thresholds with no rows.
    """
    x = df.where(F.col(confidence).isNotNull() & F.col(correct).isNotNull())
    level = F.least(F.floor(F.round(F.col(confidence) * (steps - 1), 9)), F.lit(steps - 1)).cast("int")
    per = x.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("int")).alias("ok"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    kept = grid.join(F.broadcast(per), F.col("level") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("ok").alias("ok"))
    total = per.agg(F.sum("n").alias("total"))
    return kept.join(F.broadcast(total)).select(F.round(F.col("step") / (steps - 1), 3).alias("threshold"), "n", F.round(F.try_divide("n", "total"), 4).alias("coverage"), F.round(F.try_divide("ok", "n"), 4).alias("precision"))


def fit_calibrator(df: DataFrame, group: str, features: list[str], correct: str, least: int = 30) -> DataFrame:
    """``group, n, base_rate, intercept, weights`` (weights null where only the base rate is known).

    One unregularised-intercept logistic regression per group with both outcomes and at least ``least`` rows. Groups are the
    few combinations of category and tier; each fit runs distributed over its rows.
    """
    x = df.where(F.col(correct).isNotNull()).select(F.col(group).alias("g"), F.col(correct).cast("double").alias("label"), *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features])
    rows = []
    data = VectorAssembler(inputCols=features, outputCol="features").transform(x).select("g", "label", "features")
    for r in data.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).collect():  # one row per category and tier
        weights, intercept = None, None
        if r["n"] >= least and 0 < r["rate"] < 1:
            m = LogisticRegression(regParam=1.0 / r["n"], elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(data.where(F.col("g").eqNullSafe(r["g"])))
            weights, intercept = [float(v) for v in m.coefficients], float(m.intercept)
        rows.append((r["g"], r["n"], float(r["rate"]), intercept, weights))
    return df.sparkSession.createDataFrame(rows, "g string, n bigint, base_rate double, intercept double, weights array<double>").withColumnRenamed("g", group)


def predict(df: DataFrame, model: DataFrame, group: str, features: list[str], prior: float = 0.5) -> DataFrame:
    """``df`` with ``probability``: the group's regression, else its base rate, else ``prior``."""
    m = model.select(F.col(group).alias("_g"), "base_rate", "intercept", "weights")
    z = F.col("intercept")
    for i, f in enumerate(features):
        z = z + F.get("weights", F.lit(i)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    x = df.join(F.broadcast(m), F.col(group).eqNullSafe(F.col("_g")), "left")  # the model has one row per category and tier
    return x.withColumn("probability", F.coalesce(1 / (1 + F.exp(-z)), F.col("base_rate"), F.lit(prior))).drop("_g", "base_rate", "intercept", "weights")
