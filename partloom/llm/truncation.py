"""Texts that lost their end, at the length limit of their source or in mid-transfer.

No labels are needed. The length limit of each source shows as a pile-up at the upper end of its lengths (in characters
or in bytes). Values that look intact are cut artificially, at the limits found and at random places, which gives
positives; a logistic regression on hashed features (closing characters, punctuation, last words, distance to the
limit) is trained on them and scores every record. Values the first model finds cut are taken out of the intact ones
before the second, final fit. The fit uses a bounded sample (``train_rows``); lengths, limits and word counts are taken
over all rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import cut_lineage

#: rows the classifier is fitted on, at most (about); and the width of the hashed feature space
TRAIN_ROWS = 40_000
HASHED = 1 << 16
#: share of the training values that are cut at a random place
CUT_SHARE = 0.12

# Endings that look like a cut and may be none; the first one are notes that a text goes on elsewhere.
_MARKS = [
    ("cont", r"(?i)\s*[(\[](?:cont|contd|continued|more|forts|fortsetzung|weiter|suite|sigue|continúa|продолж)\b[^()\[\]]*[)\]]\s*$"),
    ("etc", r"\s*etc\.{3}\s*$"),
    ("dots_apart", r"\s+(?:\.{3}|…)\s*$"),
    ("dots", r"(?:\.{3})\s*$"),
    ("ellipsis", r"…\s*$"),
    ("broken", "�\\s*$"),
    ("hyphen", r"-\s*$"),
]


def source_limits(rows: DataFrame, text: str, source: str) -> DataFrame:
    """``source, unit, limit_n``: the length limit of each source that has one.

    A limit is a length that hardly any text exceeds (at most 2 % of the source's texts) and that at least 2 % of them
    have, twice as many as the five lengths below it on average. ``unit`` is ``chars`` or ``bytes``, whichever piles
    up higher. Lengths are counted over all rows first; the window runs over the distinct lengths of a source.
    """
    base = rows.select(F.col(source).alias("source"), F.col(text).alias("t")).where("trim(t) <> ''")
    by = base.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length("t").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.octet_length("t").alias("n")))).alias("x"))
    hist = by.groupBy("source", "x.unit", "x.n").count()
    w = Window.partitionBy("source", "unit").orderBy("n")
    below = F.sum("count").over(w.rangeBetween(-5, -1))
    upto = F.sum("count").over(w.rangeBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(Window.partitionBy("source", "unit"))
    piled = hist.withColumns({"below": F.coalesce(below, F.lit(0)), "upto": upto, "total": total}).where((F.col("total") - F.col("upto") <= 0.02 * F.col("total")) & (F.col("count") >= 0.02 * F.col("total")) & (F.col("count") * 5 >= 2 * F.col("below")) & (F.col("count") >= 8))
    best = piled.groupBy("source").agg(F.max(F.struct("count", F.col("unit"), "n")).alias("b"))
    return best.select("source", F.col("b.unit").alias("unit"), F.col("b.n").alias("limit_n"))


def _shape(word: Column) -> Column:
    return F.regexp_replace(word, r"\d+", "9")


_ANY_MARK = "|".join(f"(?:{p})" for _, p in _MARKS)


def _bare(word: Column) -> Column:
    """A word as it is looked up: digits folded, without punctuation around it."""
    return F.regexp_replace(_shape(word), r"^[(\"'„“«]+|[.,;:!?)\"'”»]+$", "")


def complete_words(known: DataFrame, least: int = 5, share: float = 0.005) -> DataFrame:
    """``word``: what stands for a whole word, from all rows of ``known`` (t, size, limit_n).

    Words followed by another one at least ``least`` times, and words that end at least ``share`` of the texts that stay
    clear of their source's limit. Counted with partial aggregation; joined, not collected.
    """
    words = F.filter(F.split(F.regexp_replace(F.col("t"), _ANY_MARK, ""), r"\s+"), lambda w: w != "")
    x = known.select(words.alias("w"), (F.col("limit_n").isNull() | (F.col("size") < F.col("limit_n") - 3)).alias("clear"))
    inner = x.select(F.explode(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0)))).alias("word")).groupBy(_bare(F.col("word")).alias("word")).count().where(F.col("count") >= least)
    last = x.where("clear and size(w) > 0").groupBy(_bare(F.element_at("w", F.lit(-1))).alias("word")).count()
    total = last.agg(F.sum("count").alias("n"))
    last = last.join(F.broadcast(total)).where(F.col("count") >= F.greatest(F.lit(share) * F.col("n"), F.lit(least)))
    return inner.select("word").union(last.select("word")).where("word <> ''").distinct()


def _with_features(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``df`` (t, size, limit_n, cut_mark) with ``f``, the array of feature names; in layers, so that nothing is computed twice."""
    t = F.col("t")
    mark = F.when(t.rlike(r"\s$"), F.lit("blank")).when(t.rlike(r"[.!?][\"'”)]?$"), F.lit("stop")).when(t.rlike(r"[,;:/&(+]$"), F.lit("open")).when(t.rlike(r"\d$"), F.lit("digit")).otherwise(F.lit("letter"))
    for name, pattern in reversed(_MARKS):
        mark = F.when(t.rlike(pattern), F.lit(name)).otherwise(mark)
    gap = F.col("limit_n") - F.col("size")
    near = F.when(F.col("limit_n").isNull(), F.lit("none")).when(gap <= 0, F.lit("at")).when(gap <= 3, gap.cast("string")).when(gap < 12, F.lit("near")).otherwise(F.lit("far"))
    x = df.withColumns({"_mark": mark, "_near": near, "_body": F.rtrim(F.regexp_replace(t, _ANY_MARK, ""))})
    x = x.withColumn("_tail", F.split(F.right(F.col("_body"), F.lit(80)), r"\s+"))
    word = lambda i: _shape(F.coalesce(F.try_element_at("_tail", F.lit(-i)), F.lit("")))
    style = F.when(F.col("_body") == F.upper("_body"), F.lit("code")).otherwise(F.lit("prose"))
    x = x.withColumns({"_last": word(1), "_second": word(2), "_style": style, "_word": _bare(F.coalesce(F.try_element_at("_tail", F.lit(-1)), F.lit("")))})
    x = x.join(vocabulary.withColumn("_whole", F.lit("whole")), F.col("_word") == F.col("word"), "left").withColumn("_whole", F.coalesce("_whole", F.lit("part")))
    k, cm = F.col("_whole"), F.coalesce("cut_mark", F.lit("-"))
    m, s, n, last, two = F.col("_mark"), F.col("_style"), F.col("_near"), F.col("_last"), F.concat_ws(" ", "_second", "_last")
    c = lambda *v: F.concat_ws("|", *v)
    f = F.array(
        c(F.lit("mark"), m), c(F.lit("style"), s, m), c(F.lit("near"), n), c(F.lit("near"), n, s), c(F.lit("near"), n, m),
        c(F.lit("last"), last), c(F.lit("two"), two), c(F.lit("last"), last, n), c(F.lit("last"), last, m), c(F.lit("two"), two, m),
        c(F.lit("end1"), s, F.right("_body", F.lit(1))), c(F.lit("end2"), F.right("_body", F.lit(2))), c(F.lit("end3"), F.right("_body", F.lit(3))), c(F.lit("end4"), F.right("_body", F.lit(4)), m),
        c(F.lit("len"), s, F.length(last).cast("string")), c(F.lit("word"), k), c(F.lit("word"), k, m), c(F.lit("word"), k, n), c(F.lit("cm"), cm, n, m), c(F.lit("cm"), cm, n, k),
    )
    return x.withColumn("f", f).drop("_mark", "_near", "_body", "_tail", "_last", "_second", "_style", "_word", "_whole", "word")


def _part(salt: str) -> Column:
    """A number in [0, 1) that depends only on the row."""
    return F.pmod(F.xxhash64("row_id", F.lit(salt)), F.lit(100_003)) / F.lit(100_003.0)


def score_truncation(rows: DataFrame, row_id: str, text: str, source: str, train_rows: int = TRAIN_ROWS, cut_share: float = CUT_SHARE) -> DataFrame:
    """``row_id, source, score``: the probability that the text lost its end, for each row with a non-blank text.

    Null and blank texts have no row; repeated rows are scored each. With no non-blank text the result is empty. A source
    without a limit (or null) is judged by its endings only. Columns of ``rows`` other than the three are not read.
    """
    base = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("t"), F.col(source).alias("source")).where("trim(t) <> ''")
    limits = source_limits(rows, text, source)
    size = F.when(F.col("unit") == "bytes", F.octet_length("t")).otherwise(F.length("t"))
    at = base.join(limits, "source").where(size >= F.col("limit_n"))
    mark = F.when(F.avg(F.col("t").endswith("...").cast("int")) > 0.5, F.lit("dots")).when(F.avg(F.col("t").endswith("…").cast("int")) > 0.5, F.lit("ellipsis")).otherwise(F.lit("-"))
    # one row per source that has a limit; it is joined by shuffle unless Spark measures it small
    limits = cut_lineage(at.groupBy("source", "unit", "limit_n").agg(mark.alias("cut_mark"), F.avg(F.col("t").rlike(r"\s$").cast("int")).alias("blank")))
    known = base.join(limits, "source", "left").withColumn("size", size)
    n = base.count()
    if n == 0:
        return base.select("row_id", "source", F.lit(0.0).alias("score"))
    vocabulary = cut_lineage(complete_words(known))
    share = min(1.0, train_rows / n)
    sure = F.col("t").rlike("(?:[^\\s.]\\.{3}|[^\\s]…|-|�|\\s|[/,;:&(])$") & ~F.col("t").rlike(r"etc\.{3}$")
    sample = known.where((_part("sample") < share) & ~sure & (F.col("limit_n").isNull() | (F.col("size") < F.col("limit_n") - 1)))
    last = _bare(F.element_at(F.split(F.rtrim(F.regexp_replace("t", _ANY_MARK, "")), r"\s+"), -1))
    sample = sample.withColumn("word", last).join(vocabulary, "word", "left_semi")  # ends with a whole word
    intact = cut_lineage(sample.select("row_id", "t", "source", "unit", "limit_n", "cut_mark", "size"))
    # sources that have a limit, numbered: a sample row is cut at the limit of one of them
    kinds = limits.withColumn("k", F.row_number().over(Window.orderBy("source")) - 1)
    n_kinds = kinds.count()

    def training(pool: DataFrame) -> DataFrame:
        own = pool.select("t", "size", "limit_n", "cut_mark", F.lit(0.0).alias("label"))
        at = F.greatest(F.lit(3), F.floor(F.length("t") * (0.2 + 0.79 * _part("where"))).cast("int"))
        kept = F.substring(F.col("t"), F.lit(1), at)
        how = _part("how")
        cut = F.when(how < 0.6, kept).when(how < 0.8, F.concat(F.rtrim(kept), F.lit("-"))).otherwise(F.concat(F.rtrim(kept), F.lit("�")))
        torn = pool.where((_part("torn") < cut_share) & (F.length("t") > 6)).withColumn("t2", cut)
        torn = torn.select(F.col("t2").alias("t"), F.least(F.length("t2"), "size").alias("size"), "limit_n", "cut_mark", F.lit(1.0).alias("label"))
        out = own.unionByName(torn)
        if n_kinds:
            text_ = pool.select("row_id", "t", F.pmod(F.xxhash64("row_id", F.lit("kind")), F.lit(n_kinds)).cast("int").alias("k"))
            lim = text_.join(kinds, "k")
            added = F.when(F.col("cut_mark") == "dots", F.lit("...")).when(F.col("cut_mark") == "ellipsis", F.lit("…")).otherwise(F.lit(""))
            room = F.col("limit_n") - F.length(added)
            # bytes are cut as characters; only the size at the limit is kept as such
            head = F.substring(F.col("t"), F.lit(1), room.cast("int"))
            head = F.when((F.col("blank") > 0) & (_part("blank") < 0.5), head).otherwise(F.rtrim(head))
            head = F.when(_part("mark") < 0.75, F.concat(head, added)).otherwise(head)  # some systems cut again and lose the mark
            over = F.length("t") > F.col("limit_n")
            lim = lim.where(F.length("t") * 2 > F.col("limit_n")).select(F.when(over, head).otherwise(F.col("t")).alias("t"), "limit_n", "cut_mark", over.cast("double").alias("label"))
            out = out.unionByName(lim.select("t", F.length("t").alias("size"), "limit_n", "cut_mark", "label"))
        return out

    tf = HashingTF(numFeatures=HASHED, binary=True, inputCol="f", outputCol="features")
    vectors = lambda d: tf.transform(_with_features(d, vocabulary))
    lr = LogisticRegression(maxIter=100, tol=1e-4, regParam=1e-6, elasticNetParam=0.0, standardization=False)

    def fit(pool: DataFrame) -> LogisticRegressionModel:
        # the sample has a fixed size, and each of the fit's passes is a task per partition
        data = vectors(training(pool)).select("features", "label").coalesce(max(1, train_rows // 10_000)).persist()
        try:
            return lr.fit(data)
        finally:
            data.unpersist()

    p = lambda model, d: model.transform(vectors(d)).withColumn("score", vector_to_array("probability")[1])
    first = fit(intact)
    cleaner = cut_lineage(p(first, intact).where("score < 0.5").select(*intact.columns))
    model = fit(cleaner)
    return p(model, known).select("row_id", "source", "score")


def truncated_share(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``source, n_texts, n_truncated, share`` per source."""
    bad = (F.col("score") >= threshold).cast("int")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(bad).alias("n_truncated"), F.round(F.avg(bad), 6).alias("share"))
