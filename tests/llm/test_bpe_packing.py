import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from partloom.llm.bpe import PRE_TOKEN, TOKENIZERS, Encoder, PerfectHash, encode_column, token_counts
from partloom.llm.packing import fill_containers, plan_containers

VOCABULARY = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary files here")


def reference_encoder():
    import tiktoken

    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal():
    keys = [str(i).encode() for i in range(5000)]
    h = PerfectHash(keys)
    assert sorted(h.slot(k) for k in keys) == list(range(5000))
    assert 0 <= h.slot(b"no key") < 5000


def test_merge_against_brute_force():
    rng = random.Random(5)
    ranks = {bytes([b]): i for i, b in enumerate(b"abcd")}
    for n in (2, 2, 2, 3, 3, 4, 4, 5):
        ranks.setdefault(bytes(rng.choice(b"abcd") for _ in range(n)), len(ranks))
    e = Encoder(ranks)

    def slow(token):
        parts = [bytes([b]) for b in token]
        while True:
            best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    for _ in range(500):
        token = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 20)))
        assert e.merge(token) == slow(token)


@needs_vocabulary
def test_ids_of_a_column(spark):
    texts = [None, "", " ", "Rated 5.3 mm², e.g. <|endoftext|>", "密封圈的重量是15克……不含外盖。", "ขั้วต่อสาย", "don't  stop\r\n\x1c\x85 x", "ab" * 50_000, "é" * 3000, "\x00�", "Rated 5.3 mm²"]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts * 2)], "id int, text string, ids array<int>")
    own = reference_encoder()
    got = {r["id"]: list(r["ids"]) for r in encode_column(df, "text").collect()}
    assert got == {i: own.encode_ordinary(t) if t else [] for i, t in enumerate(texts * 2)}
    assert all(own.decode(got[i]) == (t or "") for i, t in enumerate(texts))
    assert encode_column(df.limit(0), "text").collect() == []
    assert {r["id"]: r["n_tokens"] for r in token_counts(df, "id", "text").collect()} == {i: len(v) for i, v in got.items()}


def check_plan(counts, capacity, window=8):
    plan = plan_containers(counts, capacity, window)
    used = np.zeros_like(counts)
    for pattern, repeats in plan:
        assert repeats > 0 and sum(s * m for s, m in pattern.items()) <= capacity
        for s, m in pattern.items():
            used[s] += m * repeats
    assert (used == counts).all()
    return sum(r for _, r in plan)


def test_plan_is_close_to_the_lower_bound():
    rng = np.random.default_rng(3)
    for n in (0, 1, 40, 3000):
        sizes = np.minimum(512, np.maximum(1, rng.lognormal(4.2, 0.9, n).astype(int)))
        counts = np.bincount(sizes, minlength=513)
        bound = -(-int(sizes.sum()) // 512) if n else 0
        assert bound <= check_plan(counts, 512) <= bound + 2 + n // 400
    only = np.zeros(101, dtype=np.int64)
    only[60] = 7
    assert check_plan(only, 100) == 7


def test_containers(spark, monkeypatch):
    from partloom.llm import packing

    monkeypatch.setattr(packing, "RANK_ROWS", 40)  # a hot size is numbered in several parts
    sizes = [(i, s) for i, s in enumerate([0, None, 100, 101, 250, 300, 1] + [33] * 300 + list(range(1, 90)))]
    df = spark.createDataFrame(sizes, "id int, size int").withColumn("n", F.lit("x"))
    rows = fill_containers(df, "id", "size", 100).collect()
    fill, pieces = {}, {}
    for r in rows:
        if r["container_id"] is None:
            assert r["n"] == 0 and r["item"] in (0, 1)
            continue
        fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["n"]
        pieces.setdefault(r["item"], []).append((r["piece"], r["start"], r["n"]))
    assert max(fill.values()) <= 100 and sorted(fill) == list(range(len(fill)))
    total = sum(s or 0 for _, s in sizes)
    assert sum(fill.values()) == total and len(fill) <= -(-total // 100) + 4
    for i, s in sizes:
        if s:
            p = sorted(pieces[i])
            assert sum(x[2] for x in p) == s and [x[1] for x in p] == [100 * k for k in range(len(p))] and len(p) == -(-s // 100)
    assert fill_containers(df.limit(0), "id", "size", 100).collect() == []
    with pytest.raises(ValueError):
        fill_containers(df, "id", "size", 0)


def test_pattern_has_no_gaps():
    import regex

    for t in ("a  b\n\n c'll 12x", "\x85\x1c ", "  "):
        assert "".join(regex.findall(PRE_TOKEN, t)) == t
