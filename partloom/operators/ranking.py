"""The k best documents of each query, exactly: postings of a block of documents, and sums of rows for bags of units.

A query is a bag of units (words or tokens), a unit a few weighted terms (grams or tokens). In a block of documents each
unit has one row of scores; bags in the order of their units share the sums of their common beginnings.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter

import numpy as np

_TOKEN = re.compile("[a-z]+|[0-9]+")
#: rows of scores held at once, entries expanded at once, bags filtered at once, cached words
ROWS, ENTRIES, CHUNK, WORDS = 1024, 1_000_000, 64, 200_000
_ROUND = 1e-6


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def word_grams(word: str) -> list[str]:
    """The 3- to 5-character grams of a word with one blank on either side, with repeats."""
    w = f" {word} "
    return [w[i : i + n] for n in range(3, min(5, len(w)) + 1) for i in range(len(w) - n + 1)]


class GramIds:
    """The numbers of the grams of a text's words; ``known`` gives them, or takes new grams if ``grow``."""

    def __init__(self, known: dict[str, int], grow: bool = False):
        self.known, self.grow, self.cache = known, grow, {}

    def word(self, w: str) -> np.ndarray:
        if (a := self.cache.get(w)) is None:
            if len(self.cache) >= WORDS:
                self.cache.clear()
            k = self.known
            a = np.array([k.setdefault(g, len(k)) for g in word_grams(w)] if self.grow else [k[g] for g in word_grams(w) if g in k], dtype=np.int32)
            self.cache[w] = a
        return a

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct numbers in order, and how often each occurs."""
        parts = [self.word(w) for w in (text or "").lower().split()]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        a = np.sort(np.concatenate(parts))
        at = np.flatnonzero(np.diff(a, prepend=-1))
        return a[at], np.diff(at, append=len(a))


def pack(x: object) -> bytes:
    return zlib.compress(pickle.dumps(x, protocol=5), 1)


def unpack(data: bytes) -> object:
    return pickle.loads(zlib.decompress(data))


def _least_type(a: np.ndarray) -> np.ndarray:
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _postings(terms: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct terms, where the entries of each start, and document and count of each entry."""
    t = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    order = np.argsort(t, kind="stable")
    t = t[order]
    at = np.flatnonzero(np.diff(t, prepend=-1))
    doc = np.repeat(np.arange(len(terms)), [len(x) for x in terms])[order]
    return _least_type(t[at]), np.append(at, len(t)).astype(np.int32), _least_type(doc), _least_type(np.concatenate(times)[order] if times else t)


def encode(ids: list[int], texts: list[str | None], grams: tuple[GramIds, np.ndarray, np.ndarray] | None, known: dict[str, tuple[int, float]] | None) -> bytes:
    """A block of documents: ids, gram norms, lengths, and postings of what queries ask for.

    ``grams``: numbers, inverse document frequencies and which of them any query has; the norm is over all of them.
    """
    made: dict = {"ids": np.array(ids, np.int64)}
    if grams:
        numbers, idf, wanted = grams
        terms, times, norm = [], [], np.zeros(len(ids))
        for i, t in enumerate(texts):
            g, n = numbers.counts(t)
            norm[i] = np.sqrt(((n * idf[g]) ** 2).sum())
            keep = wanted[g]
            terms.append(g[keep])
            times.append(n[keep])
        made |= {"norm": norm, "grams": _postings(terms, times)}
    if known is not None:
        terms, times, length = [], [], np.zeros(len(ids))
        for i, t in enumerate(texts):
            found = tokens(t)
            length[i] = len(found)
            c = Counter(x for x in found if x in known)
            terms.append(np.array([known[x][0] for x in c], np.int64))
            times.append(np.array(list(c.values()), np.int64))
        made |= {"length": length, "tokens": _postings(terms, times)}
    return pack(made)


class Ranking:
    """The k best documents of each bag so far. Scores are rounded to 6 digits, ties go by document id.

    ``units`` gives each unit's terms and weights, ``scale`` divides a bag's sums. Only documents with a term of the bag
    count; with ``positive`` only those with a score above 0 after rounding.
    """

    def __init__(self, bags: list[tuple], units: dict, scale: np.ndarray, k: int, positive: bool):
        often = Counter(u for b in bags for u in b)
        place = {u: i for i, (u, _) in enumerate(sorted(often.items(), key=lambda x: (-x[1], x[0])))}
        self.units = [units[u] for u in place]
        bags = [sorted(place[u] for u in b) for b in bags]
        self.order = sorted((i for i, b in enumerate(bags) if b), key=bags.__getitem__)
        self.bags, self.scale, self.k, self.positive = bags, scale, k, positive
        self.signed = any((w <= 0).any() for _, w in self.units)
        self.least = np.full(len(bags), -np.inf)
        self.best = [np.zeros(0, np.int64)] * 3  # bag, document, score in millionths
        self.new: list[tuple[np.ndarray, ...]] = []
        self.n_new = 0
        self.parts = list(self._parts())

    def _parts(self):
        """Runs of bags that have at most ROWS units: the units, and each bag with its rows and what it shares with the one before."""
        run, row, before = [], {}, []
        for i in self.order:
            b = self.bags[i]
            if run and len(row) + len(b) > ROWS:
                yield list(row), run
                run, row, before = [], {}, []
            same = 0
            while same < min(len(b), len(before)) and b[same] == before[same]:
                same += 1
            run.append((i, [row.setdefault(u, len(row)) for u in b], same))
            before = b
        if run:
            yield list(row), run

    def _rows(self, numbers: list[int], postings: tuple[np.ndarray, ...], value: np.ndarray, n_docs: int) -> np.ndarray:
        terms, starts, doc, _ = postings
        out = np.zeros((len(numbers), n_docs))
        if not len(terms):
            return out
        t = np.concatenate([self.units[u][0] for u in numbers])
        w = np.concatenate([self.units[u][1] for u in numbers])
        unit = np.repeat(np.arange(len(numbers)), [len(self.units[u][0]) for u in numbers])
        at = np.minimum(np.searchsorted(terms, t), len(terms) - 1)
        hit = terms[at] == t
        at, w, unit = at[hit], w[hit], unit[hit]
        size = (starts[at + 1] - starts[at]).astype(np.int64)
        done = np.cumsum(size)
        cuts = [0]
        while cuts[-1] < len(at):
            a = cuts[-1]
            b = max(a + 1, int(np.searchsorted(done, (done[a - 1] if a else 0) + ENTRIES, side="right")))
            n = size[a:b]
            e = np.arange(n.sum()) + np.repeat(starts[at[a:b]] - np.cumsum(n) + n, n)
            low, high = int(unit[a]), int(unit[b - 1]) + 1
            flat = np.repeat((unit[a:b] - low) * n_docs, n) + doc[e]
            out[low:high] += np.bincount(flat, np.repeat(w[a:b], n) * value[e], minlength=(high - low) * n_docs).reshape(-1, n_docs)
            cuts.append(b)
        return out

    def add(self, ids: np.ndarray, postings: tuple[np.ndarray, ...], value: np.ndarray) -> None:
        """Score a block of documents; ``value`` is what each entry of the postings counts."""
        n = len(ids)
        out = np.empty((CHUNK, n))
        for numbers, run in self.parts:
            rows = self._rows(numbers, postings, value, n)
            met = self._rows(numbers, postings, np.ones(len(value)), n) != 0 if self.signed else None
            sums: list[np.ndarray] = []
            for a in range(0, len(run), CHUNK):
                some = run[a : a + CHUNK]
                sums = [s.copy() if s.base is out else s for s in sums]
                for j, (_, units, same) in enumerate(some):
                    if self.signed:
                        out[j] = np.where(met[units].any(axis=0), rows[units].sum(axis=0), -np.inf)
                        continue
                    del sums[same:]
                    for u in units[same:-1]:
                        sums.append(sums[-1] + rows[u] if sums else rows[u])
                    if len(sums) == len(units):  # the same bag again
                        out[j] = sums[-1]
                    elif sums:
                        sums.append(np.add(sums[-1], rows[units[-1]], out=out[j]))
                    else:
                        out[j] = rows[units[-1]]
                        sums.append(rows[units[-1]])
                self._filter(np.array([i for i, _, _ in some]), out[: len(some)], ids)
        if self.n_new > max(100_000, len(self.order) * self.k):
            self._merge()

    def _filter(self, bags: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
        least, scale = self.least[bags], self.scale[bags]
        limit = (least - 0.6 * _ROUND) * scale
        fresh = np.flatnonzero(least == -np.inf)
        if len(fresh) and len(ids) > self.k:  # the block's own k-th best is a first bound
            limit[fresh] = np.partition(s[fresh], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 1.1 * _ROUND * scale[fresh]
        limit = np.maximum(limit, -np.finfo(float).max if self.signed else np.finfo(float).tiny)
        flat = np.flatnonzero(s >= limit[:, None])
        if len(flat):
            row, col = np.divmod(flat, len(ids))
            score = np.rint(s.ravel()[flat] / scale[row] / _ROUND).astype(np.int64)
            if self.positive:
                row, col, score = (x[score > 0] for x in (row, col, score))
            self.new.append((bags[row], ids[col], score))
            self.n_new += len(row)

    def _merge(self) -> None:
        if not self.new:
            return
        bag, doc, score = (np.concatenate(x) for x in zip(self.best, *self.new, strict=True))
        self.new, self.n_new = [], 0
        order, rank = ranked(bag, doc, score)
        keep = rank <= self.k
        self.best = [x[order][keep] for x in (bag, doc, score)]
        last = rank[keep] == self.k
        self.least[self.best[0][last]] = self.best[2][last] * _ROUND

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bag, document, score and rank, in the order of bag and rank."""
        self._merge()
        bag, doc, score = self.best
        return bag, doc, score / 1e6, ranked(bag, doc, score)[1]


def ranked(by: np.ndarray, doc: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by (by, score descending, doc) and the rank from 1 within each ``by``; scores are whole numbers."""
    if not len(by):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    high = int(score.max())
    key = by * (high - int(score.min()) + 1) + (high - score)
    order = np.argsort(key)
    same = np.diff(key[order]) == 0
    if same.any():
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        sub = order[tied]
        order[tied] = sub[np.lexsort((doc[sub], key[sub]))]
    by = by[order]
    first = np.flatnonzero(np.diff(by, prepend=by[0] - 1))
    return order, np.arange(len(by)) - np.repeat(first, np.diff(first, append=len(by))) + 1


def fused(rankings: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], k: int, c: int) -> tuple[np.ndarray, ...]:
    """Reciprocal rank fusion of (by, document, rank, weight): by, document, score rounded to 8 digits, rank, the k best of each."""
    by, doc, s = (np.concatenate(x) for x in zip(*((b, d, w / (c + r)) for b, d, r, w in rankings), strict=True))
    order = np.lexsort((doc, by))
    by, doc, s = by[order], doc[order], s[order]
    first = np.flatnonzero(np.append(True, (by[1:] != by[:-1]) | (doc[1:] != doc[:-1]))) if len(by) else np.zeros(0, np.int64)
    by, doc, s = by[first], doc[first], np.rint((np.add.reduceat(s, first) if len(first) else s) * 1e8).astype(np.int64)
    order, rank = ranked(by, doc, s)
    keep = rank <= k
    return by[order][keep], doc[order][keep], s[order][keep] / 1e8, rank[keep]


class Asked:
    """A block of queries (ids, texts for tokens, texts for grams) with their rankings."""

    def __init__(self, data: bytes, grams: tuple[dict[str, int], np.ndarray] | None, weights: dict[str, tuple[int, float]] | None, average: float, k: int, k1: float, b: float):
        self.ids, *texts = unpack(data)
        self.average, self.k1, self.b, self.lists = average, k1, b, {}
        if weights is not None:
            bags = [tuple(sorted((weights[t][0], n) for t, n in Counter(tokens(x)).items() if t in weights)) for x in texts[0]]
            weight = dict(weights.values())
            units = {(t, n): (np.array([t]), np.array([n * weight[t]])) for bag in bags for t, n in bag}
            self._list("tokens", bags, units, lambda bag: 1.0, k, False)
        if grams is not None:
            numbers, idf = GramIds(grams[0]), grams[1]
            bags = [tuple(sorted((w, n) for w, n in Counter((x or "").lower().split()).items() if len(numbers.word(w)))) for x in texts[1]]
            units = {}
            for w, n in {u for bag in bags for u in bag}:
                t, times = np.unique(numbers.word(w), return_counts=True)
                units[w, n] = t, n * times * idf[t] ** 2

            def norm(bag: tuple) -> float:
                t, at = np.unique(np.concatenate([np.repeat(numbers.word(w), n) for w, n in bag]), return_counts=True)
                return float(np.sqrt(((at * idf[t]) ** 2).sum()))

            self._list("grams", bags, units, norm, k, True)

    def _list(self, name: str, bags: list[tuple], units: dict, scale, k: int, positive: bool) -> None:
        distinct = list(dict.fromkeys(bags))
        place = {bag: i for i, bag in enumerate(distinct)}
        found = Ranking(distinct, units, np.array([scale(bag) if bag else 1.0 for bag in distinct]), k, positive)
        self.lists[name] = found, np.array([place[bag] for bag in bags], np.int64)

    def add(self, data: bytes) -> None:
        d = unpack(data)
        if "tokens" in self.lists:
            _, starts, doc, times = d["tokens"]
            value = times * (self.k1 + 1) / (times + self.k1 * (1 - self.b + self.b * d["length"][doc] / self.average))
            self.lists["tokens"][0].add(d["ids"], d["tokens"], value)
        if "grams" in self.lists:
            _, starts, doc, times = d["grams"]
            self.lists["grams"][0].add(d["ids"], d["grams"], times / d["norm"][doc])

    def result(self, name: str) -> tuple[np.ndarray, ...]:
        """Place of the query, document, score and rank."""
        found, bag_of = self.lists[name]
        bag, doc, score, rank = found.result()
        first = np.searchsorted(bag, np.arange(len(found.bags) + 1))
        n = np.diff(first)[bag_of]
        at = np.arange(n.sum()) + np.repeat(first[bag_of] - np.cumsum(n) + n, n)
        return np.repeat(np.arange(len(bag_of)), n), doc[at], score[at], rank[at]
