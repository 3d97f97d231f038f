"""Full-text, vector and fused retrieval with explicit tie-breaking."""

from __future__ import annotations

import math
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from partloom.functions.text import search_tokens, word_set
from partloom.operators.ranking import Asked, GramIds, encode, fused, pack, tokens, word_grams
from partloom.sources.tables import spread


def bm25_topk(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int = 50, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25, block: int = 4096) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k best documents of each query by BM25; ties by document id.

    Terms in more than half of the documents get ``epsilon`` times the mean inverse document frequency. Statistics are
    taken over all documents. A null or empty query finds nothing. ``doc_id`` is a whole number and unique.
    """
    asked = queries.select(F.col(query_id).alias("id"), F.col(query).alias("t"), F.lit(None).cast("string").alias("g"))
    terms = _term_weights(docs, text, asked, epsilon)
    return _met(docs, doc_id, text, asked, lambda x: x.result("tokens"), terms, None, k, k1, b, block)


def _term_weights(docs: DataFrame, text: str, asked: DataFrame, epsilon: float) -> tuple[dict[str, tuple[int, float]], float]:
    """Number and weight of each term of the queries that any document has, and the mean length of documents."""

    def counted(batches):
        df, n, size = Counter(), 0, 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found = tokens(t)
                n, size = n + 1, size + len(found)
                df.update(set(found))
            if len(df) > 500_000:
                yield pa.RecordBatch.from_pydict({"token": list(df), "df": list(df.values()), "l": [0] * len(df)})
                df.clear()
        yield pa.RecordBatch.from_pydict({"token": pa.array([None, *df], pa.string()), "df": [n, *df.values()], "l": [size] + [0] * len(df)})  # no token: the documents

    each = spread(docs.select(F.col(text).alias("t"))).mapInArrow(counted, "token string, df long, l long")
    seen = each.groupBy("token").agg(F.sum("df").alias("df"), F.sum("l").alias("l")).persist()  # read three times, a row for each term
    every = seen.where("token is null").select(F.col("df").alias("n"), (F.col("l") / F.col("df")).alias("average"))
    idf = seen.where("token is not null").join(F.broadcast(every)).select("token", "average", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    low = idf.agg((F.avg("idf") * epsilon).alias("low"))
    have = asked.select(F.explode(search_tokens(F.col("t"))).alias("token")).distinct()
    rows = idf.join(F.broadcast(low)).join(have, "token").select("token", F.when(F.col("idf") < 0, F.col("low")).otherwise(F.col("idf")).alias("w"), "average").collect()
    seen.unpersist()
    return {r["token"]: (i, r["w"]) for i, r in enumerate(sorted(rows))}, rows[0]["average"] if rows else 0.0


def _met(docs: DataFrame, doc_id: str, text: str, asked: DataFrame, finish, terms, grams, k: int, k1: float = 1.5, b: float = 0.75, block: int = 4096, most: int = 24_000) -> DataFrame:
    """What ``finish`` gives for blocks of queries (``id``, text for terms ``t``, text for grams ``g``) that have met all documents.

    Each document is encoded once, to the postings of what any query asks for. A task holds one block of at most about
    ``most`` queries with their k best so far and reads the encoded documents block by block: nothing but them, the queries
    and what ``finish`` gives is moved or stored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((terms, grams))

    def encoded(batches):
        known, numbers = shared.value[0], shared.value[1]
        numbers = numbers and (GramIds(numbers[0]), numbers[1], numbers[2])
        ids, texts = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            while len(ids) >= block:
                yield pa.RecordBatch.from_pydict({"data": [encode(ids[:block], texts[:block], numbers, known and known[0])]}, schema=data)
                del ids[:block], texts[:block]
        if ids:
            yield pa.RecordBatch.from_pydict({"data": [encode(ids, texts, numbers, known and known[0])]}, schema=data)

    def packed(batches):
        rows = [b.to_pydict() for b in batches]
        if any(r["id"] for r in rows):
            yield pa.RecordBatch.from_pydict({"name": [str(uuid.uuid4())], "asked": [pack([[x for r in rows for x in r[c]] for c in ("id", "t", "g")])]})

    def best(batches):
        (known, numbers), held = shared.value, {}
        for batch in batches:
            for i, name in enumerate(batch.column("name").to_pylist()):
                if name not in held:
                    held[name] = Asked(batch.column("asked")[i].as_py(), numbers and numbers[:2], known and known[0], known[1] if known else 0.0, k, k1, b)
                held[name].add(batch.column("data")[i].as_py())
        for x in held.values():
            at, *rest = finish(x)
            for a in range(0, len(at), 100_000):
                some = slice(a, a + 100_000)
                doc, score, rank = (r[some] for r in rest)
                yield pa.RecordBatch.from_arrays([pa.array([x.ids[j] for j in at[some]], made.field(0).type), pa.array(doc).cast(made.field(1).type), pa.array(score, pa.float64()), pa.array(rank, pa.int32())], schema=made)

    data = pa.schema([("data", pa.binary())])
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    made = pa.schema([("query_id", to_arrow_type(asked.schema["id"].dataType)), ("doc_id", to_arrow_type(rows.schema["id"].dataType)), ("score", pa.float64()), ("rank", pa.int32())])
    wide = spark.sparkContext.defaultParallelism
    parts = wide * max(1, -(-asked.count() // (most * wide)))
    left = spread(rows).mapInArrow(encoded, "data binary").repartition(1)
    right = asked.repartition(parts).mapInArrow(packed, "name string, asked binary")
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)  # a task for each block of queries; nothing is sent to the driver
    return pairs.mapInArrow(best, f"query_id {dict(asked.dtypes)['id']}, doc_id {dict(rows.dtypes)['id']}, score double, rank int")


def top_ranked(scored: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each ``by``, ranked from 1; Spark keeps only k rows per group while sorting."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, float]], k: int = 25, c: int = 60) -> DataFrame:
    """``query_id, doc_id, score, rank`` from rankings (query_id, doc_id, rank) with weights."""
    parts = [r.select("query_id", "doc_id", (F.lit(w) / (F.lit(c) + F.col("rank"))).alias("s")) for r, w in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    fused = every.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 8).alias("score"))
    return top_ranked(fused, "query_id", "score", "doc_id", k)


def overlap_share(fragment: Column, text: Column) -> Column:
    """The share of a fragment's distinct words that occur in a text; 0 for a fragment without words."""
    words = word_set(fragment)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, word_set(text, 1))) / F.size(words)).otherwise(F.lit(0.0))


def dense_topk(rows: DataFrame, row_id: str, vector: str, queries: DataFrame, k: int = 50, block: int = 4096) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k nearest rows of each query by cosine, exact.

    Queries and rows are put into blocks of about ``block`` vectors; each pair of blocks is one matrix product that keeps
    k rows per query, and the block winners are ranked. Nothing larger than two blocks is in one place. Null vectors and
    vectors of zero length take no part.
    """
    spark = rows.sparkSession

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = max(1, -(-df.count() // block))
        x = df.select(F.col(row_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
        return x.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("v").alias(f"{name}_vectors"))

    pairs = blocks(queries, "q").repartition(max(1, spark.sparkContext.defaultParallelism)).join(blocks(rows, "d"))

    def best(batches):
        for pdf in batches:
            for q_ids, q_v, d_ids, d_v in zip(pdf["q_ids"], pdf["q_vectors"], pdf["d_ids"], pdf["d_vectors"]):
                q, d = np.stack([np.asarray(v) for v in q_v]), np.stack([np.asarray(v) for v in d_v])
                qn, dn = np.linalg.norm(q, axis=1), np.linalg.norm(d, axis=1)
                d_ids = np.asarray(d_ids)
                use = dn > 0
                s = np.round((q / np.where(qn > 0, qn, 1)[:, None]) @ (d[use] / dn[use][:, None]).T, 6)
                for i in np.flatnonzero(qn > 0):
                    order = np.lexsort((d_ids[use], -s[i]))[:k]
                    yield pd.DataFrame({"query_id": q_ids[i], "doc_id": d_ids[use][order], "score": s[i][order]})

    kind = dict(rows.dtypes)[row_id]
    found = pairs.mapInPandas(best, f"query_id {kind}, doc_id {kind}, score double")
    return top_ranked(found, "query_id", "score", "doc_id", k)


#: the most frequent grams of a corpus that make up its vectors, as in the behaviour studied
MAX_GRAMS = 60_000


def char_grams(text: str | None) -> Counter:
    """The 3- to 5-character grams of each blank-separated word with one blank on either side, lower case, counted."""
    return Counter(g for w in (text or "").lower().split() for g in word_grams(w))


def gram_topk(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, k: int = 50, block: int = 4096) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k documents of each query that are nearest by cosine over all documents; ties by document id.

    Vectors hold counts of the corpus's ``MAX_GRAMS`` most frequent character grams (ties by gram) times the smoothed inverse
    document frequency ln((1 + n) / (1 + df)) + 1, exact, not projected. What shares no gram with a query is not found.
    ``doc_id`` is a whole number and unique.
    """
    asked = queries.select(F.col(query_id).alias("id"), F.lit(None).cast("string").alias("t"), F.col(query).alias("g"))
    return _met(docs, doc_id, text, asked, lambda x: x.result("grams"), None, _gram_weights(docs, text, asked), k, block=block)


def fused_topk(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, query_id: str, query: str, query_grams: str, weights: tuple[float, float] = (0.7, 0.3), k: int = 25, depth: int = 50, c: int = 60) -> DataFrame:
    """``query_id, doc_id, score, rank``: reciprocal rank fusion of the ``depth`` best by BM25 and by grams, fused where both lists are made."""
    asked = queries.select(F.col(query_id).alias("id"), F.col(query).alias("t"), F.col(query_grams).alias("g"))

    def finish(x: Asked):
        lists = [(at, doc, rank, w) for (at, doc, _, rank), w in zip((x.result("tokens"), x.result("grams")), weights)]
        return fused(lists, k, c)

    return _met(docs, doc_id, text, asked, finish, _term_weights(docs, text, asked, 0.25), _gram_weights(docs, text, asked), depth)


def _gram_weights(docs: DataFrame, text: str, asked: DataFrame, most: int = 2_000_000) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The numbers of the vocabulary's grams, their inverse document frequencies, and which of them any query has.

    Only the vocabulary, of fixed size, comes to the driver; it is ranked in one task, not there.
    """

    def counted(batches):
        numbers, n, df = GramIds({}, grow=True), np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flushed():
            names = list(numbers.known)
            for a in range(0, len(names), 100_000):
                yield pa.RecordBatch.from_pydict({"gram": names[a : a + 100_000], "n": n[a : a + 100_000], "df": df[a : a + 100_000]})

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a in range(0, len(texts), 2000):
                found = [numbers.counts(t) for t in texts[a : a + 2000]]
                g, times = (np.concatenate(x) for x in zip(*found))
                size = len(numbers.known)
                n = np.append(n, np.zeros(size - len(n), np.int64)) + np.bincount(g, times, minlength=size).astype(np.int64)
                df = np.append(df, np.zeros(size - len(df), np.int64)) + np.bincount(g, minlength=size)
                if size > most:
                    yield from flushed()
                    numbers, n, df = GramIds({}, grow=True), np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from flushed()

    def had(batches):
        numbers = GramIds(shared.value)
        seen = np.zeros(len(shared.value), bool)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen[numbers.counts(t)[0]] = True
        yield pa.RecordBatch.from_pydict({"g": pa.array(np.flatnonzero(seen), pa.int64())})

    seen = spread(docs.select(F.col(text).alias("t"))).mapInArrow(counted, "gram string, n long, df long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    n_docs = docs.count()
    first = seen.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "gram"))).where(F.col("r") <= MAX_GRAMS).select("gram", "df").collect()
    idf = np.array([math.log((1 + n_docs) / (1 + r["df"])) + 1 for r in first])
    known = {r["gram"]: i for i, r in enumerate(first)}
    shared = docs.sparkSession.sparkContext.broadcast(known)
    wanted = np.zeros(len(known), bool)
    wanted[[r["g"] for r in asked.select("g").mapInArrow(had, "g long").distinct().collect()]] = True
    return known, idf, wanted
