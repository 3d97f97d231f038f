"""Mapping of freely typed names to the entries of a reference list.

Values are first deduplicated (most rows repeat few spellings), then normalised and deduplicated again; only distinct
normal forms go on. Words that many names of the reference list share (general words) count little and are recognised in
their short forms, which are derived from the list. Candidates come from an inverted index of character n-grams of the reference list (an equi-join on
the gram); the score is the cosine of the gram vectors, weighted by inverse document frequency in the reference list, so
that words shared by many entries count little. The best entry is accepted when its score reaches a threshold and its
lead over the next entry a margin; an exact normal form needs no threshold, but still has to be unambiguous.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.session import cut_lineage

# Letters with marks and look-alike Cyrillic and Greek letters, and the plain letters they stand for.
_MARKED = "äàáâãåāăąæçćčďđèéêëēěęğìíîïīłñńňòóôõöøōőřśšşťùúûüūůűýÿžźż"
_PLAIN = "aaaaaaaaaacccddeeeeeeegiiiiilnnnoooooooorsssttuuuuuuuyyzzz"
_ALIKE = "авекмнорстухіјѕԁһԛԝοαερτυικνχ"
_LATIN = "abekmhopctyxijsdhqwoaeptuikvx"

# Legal forms and remarks that stand beside a name.
LEGAL = ["gmbh", "co", "kg", "ltd", "limited", "inc", "llc", "corp", "corporation", "oy", "bv", "nv", "sa", "sas", "sarl", "ag", "as", "ab", "kk", "spa", "srl", "plc", "und", "and"]
# Notes instead of a name.
NO_NAME = ["", "na", "n a", "unknown", "various", "no name", "noname", "tbd", "tbc", "generic", "none", "null", "unbranded", "other", "misc", "not stated", "k a"]
#: rows of the reference list's gram index (about 60 bytes each) up to which it is broadcast
BROADCAST_ROWS = 300_000


def normalise_name(c: Column) -> Column:
    """A typed company name in comparable form: plain lower-case Latin words without remarks, numbers and legal forms.

    Null stays null; a name of nothing but remarks gives an empty string.
    """
    t = F.regexp_replace(F.translate(F.trim(c), "_\u00a0\t\n\r", "     "), r"\p{M}+", "")
    t = F.regexp_replace(t, r"(\p{Ll})(\p{Lu}\p{Ll}|\p{Lu}{2,}\b)", "$1 $2")  # words written together
    t = F.translate(F.translate(F.lower(t), _MARKED, _PLAIN), _ALIKE, _LATIN)
    t = F.regexp_replace(F.regexp_replace(t, "ß", "ss"), "[’'`]", "")
    t = F.regexp_replace(t, r"\[[^\]]*\]|\([^)]*\)|^\s*\d+\s*[-:/]\s*|\s+-+\s+[a-z]{2}\s*$", " ")
    t = F.regexp_replace(t, r"\b([a-z])\.(?=[a-z0-9]\b|\s|$)", "$1")  # s.p.a. gives spa
    t = F.regexp_replace(t, r"(?<=[a-z])0|0(?=[a-z])", "o")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=[a-z])1|1(?=[a-z])", "l"), r"(?<=[a-z])5(?=[a-z])", "s")
    words = F.filter(F.split(F.regexp_replace(t, r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    # legal forms only at the end (or alone after a comma they were moved to the front)
    legal = F.array(*[F.lit(x) for x in LEGAL])
    count = F.size(words)
    tail = F.aggregate(F.reverse(words), F.lit(0), lambda n, w: F.when((n >= 0) & F.array_contains(legal, w), n + 1).when(n >= 0, -n - 1).otherwise(n))
    drop = F.when(tail < 0, -tail - 1).otherwise(tail)
    words = F.when(drop < count, F.slice(words, 1, F.greatest(count - drop, F.lit(1)))).otherwise(words)
    return F.array_join(words, " ")


def _grams(c: Column) -> Column:
    """Distinct bigrams and trigrams of each word, its two ends marked; the order of words doesn't matter."""
    words = F.filter(F.split(c, " "), lambda w: w != "")

    def of(w: Column, n: int) -> Column:
        p = F.concat(F.lit("^"), w, F.lit("$"))
        return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, n))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.concat(of(w, 2), of(w, 3)))))


def name_words(entries: DataFrame, name: str) -> DataFrame:
    """``w, n``: each word of the reference list's names and how many names have it."""
    words = entries.select(normalise_name(F.col(name)).alias("form")).distinct().select(F.explode(F.array_distinct(F.split("form", " "))).alias("w"))
    return words.where("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


def short_forms(words: DataFrame, known: DataFrame, shared_by: int = 3) -> DataFrame:
    """``w, full``: words of ``words`` (w) that are short for a general word, one that at least ``shared_by`` names have in common.

    A short form has at least two letters, begins with the same one, leaves out others of the general word and changes none
    (the edit distance is the difference in length), and is itself no word of a name. A beginning counts before a word
    with letters left out in between; where several general words come into question it stands for none.
    """
    general = known.where(F.col("n") >= shared_by).select(F.col("w").alias("full"))
    x = words.select("w").where("length(w) >= 2").distinct().join(known.select("w"), "w", "left_anti").withColumn("_a", F.left("w", F.lit(1)))
    x = x.join(general.withColumn("_a", F.left("full", F.lit(1))), "_a").where((F.length("w") < F.length("full")) & (F.levenshtein("w", "full") == F.length("full") - F.length("w")))
    begins = F.when(F.startswith("full", F.col("w")), F.col("full"))
    x = x.groupBy("w").agg(F.count(begins).alias("b"), F.min(begins).alias("begin"), F.count(F.lit(1)).alias("n"), F.min("full").alias("any"))
    return x.select("w", F.when(F.col("b") == 1, F.col("begin")).when((F.col("b") == 0) & (F.col("n") == 1), F.col("any")).alias("full")).where("full is not null")


def spelled_out(forms: DataFrame, known: DataFrame, shared_by: int = 3) -> DataFrame:
    """``form, full, core`` of distinct forms: with general words spelled out, and without them."""
    words = forms.select("form").distinct().select("form", F.posexplode(F.split("form", " ")).alias("i", "w"))
    x = words.join(short_forms(words, known, shared_by), "w", "left").select("form", "i", F.coalesce("full", "w").alias("w"))
    x = x.join(known.where(F.col("n") >= shared_by).select("w", F.lit(True).alias("g")), "w", "left")
    ordered = F.array_sort(F.collect_list(F.struct("i", "w", F.col("g").isNull().alias("own"))))  # the words of one name
    text = lambda a: F.array_join(F.transform(a, lambda p: p["w"]), " ")
    return x.groupBy("form").agg(ordered.alias("a")).select("form", text(F.col("a")).alias("full"), text(F.array_distinct(F.filter("a", lambda p: p["own"]))).alias("core"))


def _joined(form: Column) -> Column:
    return F.array_join(F.array_sort(F.split(form, " ")), "")


def _whole(a: Column, b: Column) -> Column:
    """The likeness of two forms without blanks, in their own and in sorted order of words."""
    return F.greatest(_likeness(_joined(a), _joined(b)), _likeness(F.translate(a, " ", ""), F.translate(b, " ", "")))


def _likeness(a: Column, b: Column) -> Column:
    """1 less the edit distance as a share of the longer text."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def reference_names(entries: DataFrame, entry_id: str, name: str, aliases: str | None, known: DataFrame) -> DataFrame:
    """``entry_id, form, core`` of the reference list: each name, each alias, and the name without its general words.

    The latter stands for an entry only as far as it is no other entry's, which the margin sees to.
    """
    base = entries.select(F.col(entry_id).alias("entry_id"), normalise_name(F.col(name)).alias("form"), F.lit(True).alias("own"))
    if aliases:
        base = base.union(entries.select(F.col(entry_id).alias("entry_id"), F.explode(aliases).alias("form")).select("entry_id", normalise_name(F.col("form")), F.lit(False)))
    x = base.where("form is not null").join(spelled_out(base.where("form is not null"), known), "form")
    out = x.select("entry_id", F.col("full").alias("form"), "core").union(x.where("own").select("entry_id", "core", "core"))
    return out.where("form <> ''").distinct()


def match_names(
    values: DataFrame, value: str, entries: DataFrame, entry_id: str, name: str, aliases: str | None = None,
    threshold: float = 0.3, margin: float = 0.03, core_likeness: float = 0.58, full_likeness: float = 0.8,
) -> DataFrame:
    """One row per distinct non-null ``value``: ``value, form, entry_id, best_id, score, lead``.

    All entries that share a gram are candidates and are scored by cosine; those of at least ``threshold`` are checked by
    edit distance: either the words that are not general agree to ``core_likeness``, or the whole names, written without
    blanks, to ``full_likeness``; a reference form of under 6 letters (a code) has to agree exactly. Among the entries that
    pass, the best mean of cosine and likeness is ``best_id``; ``entry_id`` is the same, or null when no entry passes or
    the lead over the next one is below ``margin``. Repeated values give one row; an empty reference list maps nothing.
    The gram index has a few rows per character of the reference list; it is broadcast when it is counted to have at most
    ``BROADCAST_ROWS`` rows and joined by shuffle otherwise. Nothing about the values is collected.
    """
    # written once: the long normalising expressions would otherwise stand in every branch of the plan
    known = cut_lineage(name_words(entries, name))
    forms = cut_lineage(reference_names(entries, entry_id, name, aliases, known))
    postings = forms.select("entry_id", "form", F.explode(_grams(F.col("form"))).alias("gram"))
    total = forms.select(F.countDistinct("entry_id").alias("n_entries"))
    frequency = postings.groupBy("gram").agg(F.countDistinct("entry_id").alias("df"))
    w = F.log((F.col("n_entries") + 1) / F.col("df"))
    weight = frequency.join(F.broadcast(total)).select("gram", (w * w).alias("w2"))
    weight = cut_lineage(weight)
    index = cut_lineage(postings.join(weight, "gram"))
    small = index.count() <= BROADCAST_ROWS
    spark = values.sparkSession
    # a number of tasks of their own: the distinct forms are few bytes, but each meets many postings; another number than
    # that of other shuffles, for an equal one is taken for redundant and then made into one task
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism) + 1
    size = index.groupBy("entry_id", "form").agg(F.sqrt(F.sum("w2")).alias("ref_norm")).join(forms.groupBy("entry_id", "form").agg(F.min("core").alias("ref_core")), ["entry_id", "form"]).withColumnRenamed("form", "ref_form")
    unknown = total.select((F.log(F.col("n_entries") + 1.0) ** 2).alias("w_unknown"))

    distinct = cut_lineage(values.select(F.col(value).alias("value")).where("value is not null").distinct().withColumn("form", normalise_name(F.col("value"))))
    spelled = spelled_out(distinct.where(~F.col("form").isin(*NO_NAME)), known)
    distinct = cut_lineage(distinct.join(spelled, "form", "left").select("value", F.coalesce("full", "form").alias("form"), "core"))
    queries = distinct.where("core is not null").groupBy("form").agg(F.min("core").alias("core")).repartition(tasks, "form")
    grams = queries.select("form", "core", F.explode(_grams(F.col("form"))).alias("gram"))
    # the index has at least as many rows as there are weights
    grams = grams.join(F.broadcast(weight), "gram", "left") if small else grams.repartition(tasks, "gram").join(weight.repartition(tasks, "gram"), "gram", "left")
    grams = grams.join(F.broadcast(unknown))
    norms = grams.groupBy("form", "core").agg(F.sqrt(F.sum(F.coalesce("w2", "w_unknown"))).alias("norm"))
    found, entry = grams.where("w2 is not null").select("form", "gram", "w2"), index.select("gram", "entry_id", F.col("form").alias("ref_form"))
    shared = found.join(F.broadcast(entry), "gram") if small else found.repartition(tasks, "gram").join(entry.repartition(tasks, "gram"), "gram")
    dots = shared.groupBy("form", "entry_id", "ref_form").agg(F.sum("w2").alias("dot"))
    scored = dots.join(F.broadcast(size) if small else size, ["entry_id", "ref_form"]).join(norms, "form").withColumn("cosine", F.col("dot") / (F.col("norm") * F.col("ref_norm")))
    core = _likeness(F.col("core"), F.col("ref_core"))
    near = scored.where(F.col("cosine") >= threshold).select("form", "entry_id", "ref_form", "cosine", core.alias("core"), _whole(F.col("form"), F.col("ref_form")).alias("full"))
    same = F.col("full") == 1
    passed = near.where(same | ((F.length("ref_form") >= 6) & ((F.col("core") >= core_likeness) | (F.col("full") >= full_likeness))))
    best = passed.groupBy("form", "entry_id").agg(F.max((F.col("cosine") + F.col("full")) / 2).alias("score"))
    order = Window.partitionBy("form").orderBy(F.desc("score"), "entry_id")  # at most as many rows as the list has entries
    ranked = best.withColumns({"rn": F.row_number().over(order), "next": F.lead("score").over(order)}).where("rn = 1")
    top = ranked.select("form", F.col("entry_id").alias("best_id"), "score", (F.col("score") - F.coalesce("next", F.lit(0.0))).alias("lead"))
    return distinct.join(top, "form", "left").select("value", "form", F.when(F.col("lead") >= margin, F.col("best_id")).alias("entry_id"), "best_id", "score", "lead")
