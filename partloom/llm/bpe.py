"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Two tiers per pre-token: a minimal perfect hash over the vocabulary resolves pre-tokens that are vocabulary entries;
the others are merged with a heap of candidate pairs over a linked list of bytes, O(n log n) in the length of the
pre-token, so that very long runs of letters cost no more than their length. Nothing is trained. The vocabulary
(under 60,000 entries, a fixed file) is read by the driver and broadcast once.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

# Fixed value: the pre-token pattern that belongs to the vocabulary; white space as Unicode defines it.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)

_MASK = (1 << 64) - 1
#: pre-tokens remembered by a worker; when full, the memory starts anew (only speed depends on it)
MEMORY = 400_000


def _mix(h: int, d: int) -> int:
    """A second hash of the 64-bit value ``h``, another one for each displacement ``d``."""
    x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _MASK
    return x ^ (x >> 32)


class PerfectHash:
    """A minimal perfect hash (hash, displace) of byte strings: n keys, n slots.

    Keys fall into n/3 buckets; the buckets are placed from the largest to the smallest, each with the first displacement
    that sends all its keys to free slots. Buckets of one key take a free slot directly (stored as a negative number).
    """

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.m = n, max(1, n // 3)
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for i, h in enumerate(hashes):
            buckets[h % self.m].append(i)
        disp, slots = [0] * self.m, [-1] * n
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        free = 0
        for b in order:
            mine = buckets[b]
            if not mine:
                break
            if len(mine) == 1:
                while slots[free] >= 0:
                    free += 1
                slots[free] = mine[0]
                disp[b] = -free - 1
                continue
            d = 0
            while True:
                at = [_mix(hashes[i], d) % n for i in mine]
                if len(set(at)) == len(at) and all(slots[s] < 0 for s in at):
                    break
                d += 1
            for i, s in zip(mine, at):
                slots[s] = i
            disp[b] = d
        self.disp, self.order = disp, slots

    def slot(self, key: bytes) -> int:
        """The slot of ``key``; any slot for a byte string that is no key (the caller compares the stored key)."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.disp[h % self.m]
        return -d - 1 if d < 0 else _mix(h, d) % self.n


class Encoder:
    """Byte-level BPE with ranks as ids."""

    def __init__(self, ranks: dict[bytes, int]):
        if not ranks:
            raise ValueError("the vocabulary is empty")
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.order]
        self.ids = [ranks[k] for k in self.keys]

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def rank(self, token: bytes) -> int:
        """The id of a vocabulary entry, -1 for other byte strings."""
        s = self.hash.slot(token)
        return self.ids[s] if self.keys[s] == token else -1

    def pre_token(self, token: bytes) -> list[int]:
        whole = self.rank(token)
        return [whole] if whole >= 0 else self.merge(token)

    def merge(self, token: bytes) -> list[int]:
        """Merge the pair of least rank, leftmost first, until no neighbouring pair is in the vocabulary."""
        n = len(token)
        end = list(range(1, n + 1))  # end[i]: where the piece that starts at i ends
        before = list(range(-1, n - 1))  # before[i]: where the piece before it starts
        rank = self.rank
        heap = []
        for i in range(n - 1):
            r = rank(token[i : i + 2])
            if r >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i]:
                continue
            j = end[i]
            if j >= n or end[j] != stop:
                continue  # one of the two pieces has changed since
            end[i] = stop
            gone[j] = 1
            if stop < n:
                before[stop] = i
                r = rank(token[i : end[stop]])
                if r >= 0:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0:
                r = rank(token[p:stop])
                if r >= 0:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank(token[i : end[i]]))
            i = end[i]
        return out


class _Memory(dict):
    """Ids by pre-token, filled when asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, token: str) -> list[int]:
        if len(self) >= MEMORY:
            self.clear()
        ids = self.encoder.pre_token(token.encode())
        if len(token) <= 64:
            self[token] = ids
        return ids


def encode_column(df: DataFrame, text: str, out: str = "ids", vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """``df`` with the array<int> column ``out``: the ids of ``text`` without special tokens.

    A null and an empty text give an empty list. Strings of special tokens in a text are ordinary text. Other columns,
    repeated rows and the order within a partition are kept; a column named ``out`` is replaced. An empty table gives an
    empty table. Only the columns of ``df`` travel to Python, so select the few that are needed first.
    """
    df = df.drop(out)
    shared = df.sparkSession.sparkContext.broadcast(Encoder.from_file(f"{folder}/{vocabulary}"))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])
    field = pa.field(out, pa.list_(pa.field("element", pa.int32(), nullable=False)), nullable=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memory = regex.compile(PRE_TOKEN).findall, _Memory(shared.value)
        for b in batches:
            flat: list[int] = []
            offsets = np.zeros(b.num_rows + 1, dtype=np.int32)
            for i, t in enumerate(b.column(text).to_pylist()):
                if t:
                    for token in find(t):
                        flat += memory[token]
                offsets[i + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()), type=field.type)
            yield pa.RecordBatch.from_arrays([*b.columns, ids], schema=pa.schema([*b.schema, field]))

    return df.mapInArrow(run, schema)


def token_counts(df: DataFrame, row_id: str, text: str, vocabulary: str = BYTE_BPE_50K, folder: str = TOKENIZERS) -> DataFrame:
    """``row_id`` and ``n_tokens`` (0 for a null or empty text), one row per row of ``df``."""
    return encode_column(df.select(row_id, text), text, "ids", vocabulary, folder).select(row_id, F.size("ids").alias("n_tokens"))
