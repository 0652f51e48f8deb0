"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits (ASCII punctuation and white space separate, A-Z lower-cased). For each benchmark item of n
words, the windows of n words of a document are fingerprinted (64-bit SimHash of their k-word shingles, each with its count as
weight). Fingerprints are cut into 4 blocks of 16 bits: if two differ in at most RADIUS = 19 bits, one of the blocks differs in
at most 4 bits, so the tables of all block values within 4 bits of an item's block hold every fingerprint within the radius. The
candidates inside the radius are verified by the exact weighted similarity: sum of minima over sum of maxima of shingle counts.
Near the threshold a fingerprint may lie beyond the radius, so items without a candidate are verified too where a stretch of windows
holds as many of their shingles as the threshold asks for: no passing window is lost.

A window that shares no shingle with an item has similarity 0; only windows that hold a shingle of the benchmark are
fingerprinted, and a document without any is done after one look-up per shingle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shingle_hashes, sliced, word_hashes

BLOCKS, BLOCK_BITS, NEAR = 4, 16, 4
RADIUS = BLOCKS * (NEAR + 1) - 1
ITEMS_AT_ONCE = 1024  # the query set is sent out in blocks of this many items
CHUNK = 4096  # windows that are looked at together

_TABLE = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
_BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).lower().split()


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] >> _BITS) & np.uint64(1)).astype(np.int32) * 2 - 1


def window_sums(shingles: np.ndarray, m: int) -> np.ndarray:
    """Sums of the signs of each bit over all windows of m shingles: the first one's, then what enters less what leaves."""
    first = sum((_signs(shingles[i : min(i + CHUNK, m)]).sum(axis=0, dtype=np.int32) for i in range(0, m, CHUNK)), np.zeros(64, np.int32))
    n = len(shingles) - m
    return np.cumsum(np.vstack([first[None, :], _signs(shingles[m:]) - _signs(shingles[:n])]), axis=0, dtype=np.int32)


def pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _BITS).sum(axis=-1, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two lists of shingles; a shingle's weight is its count."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (len(a) + len(b) - both)) if len(a) + len(b) else 0.0


def similarities(shingles: np.ndarray, m: int, own: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Weighted Jaccard of all windows of m shingles with an item that holds its sorted distinct shingles `own` so many `times`.

    A shingle at place p counts for a window that begins at x <= p, unless the window holds as many of the same before p as the item has
    in all. So it counts for a range of windows, and one running sum over the ends of these ranges gives all intersections.
    """
    at = np.minimum(np.searchsorted(own, shingles), len(own) - 1)
    p = np.flatnonzero(own[at] == shingles)
    p = p[np.argsort(at[p], kind="stable")]
    which = at[p]
    before = np.arange(len(p)) - times[which]
    there = np.maximum(before, 0)
    low = np.maximum(np.where((before >= 0) & (which[there] == which), p[there] + 1, 0), p - m + 1)
    n = len(shingles) - m + 1
    low, high = np.clip(low, 0, n), np.clip(p + 1, 0, n)
    both = np.cumsum(np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1))[:n]
    return both / (m + times.sum() - both)


class Index:
    """The items of one block of the query set, by their lengths."""

    def __init__(self, items: list[tuple[int, str | None]], k: int):
        self.k, self.items = k, []
        for item, text in items:
            w = word_hashes(words_of(text))
            if len(w):
                self.items.append((item, len(w), shingle_hashes(w, k)))
        self.prints = np.array([pack(window_sums(s, len(s))[0]) for _, _, s in self.items], np.uint64)
        self.counts = [np.unique(s, return_counts=True) for _, _, s in self.items]
        self.sizes = np.array([n for _, n, _ in self.items], np.int64)
        own = [x for x, _ in self.counts]
        self.shingles = np.unique(np.concatenate(own)) if own else np.empty(0, np.uint64)
        flat = np.concatenate(own) if own else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(own)), [len(x) for x in own])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        # A bit per hash prefix: most shingles of the corpus are settled by one look-up.
        self.gate = np.zeros(1 << 20, bool)
        self.gate[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        # A table per block: for each of its values, the items whose block differs in at most NEAR bits.
        masks = np.array([i for i in range(1 << BLOCK_BITS) if i.bit_count() <= NEAR], np.int64)
        self.tables = []
        for b in range(BLOCKS):
            values = (((self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)[:, None] ^ masks).ravel()
            order = np.argsort(values, kind="stable")
            ends = np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS))
            self.tables.append((np.concatenate([[0], ends]).astype(np.int32), (order // max(len(masks), 1)).astype(np.int16)))

    def within(self, prints: np.ndarray, which: np.ndarray) -> np.ndarray:
        """(window, item) pairs, both as indices, within the radius: a look-up in each block's table, then the whole distance."""
        wanted = np.zeros(len(self.items), bool)
        wanted[which] = True
        pairs = []
        for b, (ends, items) in enumerate(self.tables):
            v = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            n = ends[v + 1] - ends[v]
            x = np.repeat(np.arange(len(v)), n)
            y = items[np.repeat(ends[v] - np.cumsum(n) + n, n) + np.arange(len(x))].astype(np.int64)
            keep = wanted[y]
            x, y = x[keep], y[keep]
            near = np.bitwise_count(prints[x] ^ self.prints[y]) <= RADIUS
            pairs.append(x[near] * len(self.items) + y[near])
        found = np.unique(np.concatenate(pairs))
        return np.stack([found // len(self.items), found % len(self.items)], axis=1)

    def matches(self, words: np.ndarray, threshold: float):
        """(item, start, length, similarity) of the windows of one document that pass, one after the other."""
        if not len(words) or not len(self.items):
            return
        shorter = self.sizes < self.k
        for size in np.unique(self.sizes[shorter]):  # whole items of fewer than k words are single shingles
            s = shingle_hashes(words, int(size)) if len(words) >= size else words[:0]
            for i in np.flatnonzero(self.sizes == size):
                yield from ((self.items[i][0], int(p), int(size), 1.0) for p in np.flatnonzero(s == self.items[i][2][0]))
        if len(words) < self.k:
            return
        s = shingle_hashes(words, self.k)
        hit = np.flatnonzero(self.gate[(s >> np.uint64(44)).astype(np.int64)])
        if not len(hit):
            return
        lo, hi = np.searchsorted(self.flat, s[hit], "left"), np.searchsorted(self.flat, s[hit], "right")
        hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
        if not len(hit):
            return
        shared = np.zeros(len(self.items), bool)
        for a, b in np.unique(np.stack([lo, hi], axis=1), axis=0):
            shared[self.owner[a:b]] = True
        items = np.flatnonzero(shared & (self.sizes <= len(words) + (self.sizes // 4)))
        for size in np.unique(self.sizes[items]):
            n = int(min(size, len(words)))  # a document a little shorter than the item is one window
            m = n - self.k + 1
            if m < 1:
                continue
            which = items[self.sizes[items] == size]
            # Windows that hold a hit, as stretches [a, b) of their first words.
            first, last = np.maximum(hit - m + 1, 0), np.minimum(hit, len(words) - n)
            new = np.append(True, first[1:] > last[:-1] + 1)
            for a, b in zip(first[new], np.append(last[:-1][new[1:]], last[-1:]) + 1):
                for x in range(a, b, CHUNK):
                    part = s[x : min(x + CHUNK, b) + m - 1]
                    u, v = np.searchsorted(hit, [x, x + len(part)])
                    for item, i, score in self._passing(part, m, which, lo[u:v], hi[u:v], threshold):
                        yield self.items[item][0], int(x + i), n, score

    def _passing(self, part: np.ndarray, m: int, which: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float):
        """(item, window, similarity) of the windows of m shingles of a stretch that pass; lo and hi bound its hits in the index.

        Items with a window within the radius are verified. Fingerprints may miss an item, so one that is not among them is verified too,
        if the stretch holds as many of its shingles as a passing window needs.
        """
        near = np.zeros(len(self.items), bool)
        near[self.within(pack(window_sums(part, m)), which)[:, 1]] = True
        times = np.zeros(len(self.items), np.int64)
        for (a, b), n in zip(*np.unique(np.stack([lo, hi], axis=1), axis=0, return_counts=True)):
            times[self.owner[a:b]] += n  # no item holds a shingle twice in the index
        both = m + np.array([len(self.items[i][2]) for i in which])
        missed = ~near[which] & (times[which] * (1 + threshold) >= threshold * both - 1e-6)
        for item in np.concatenate([which[near[which]], which[missed]]):
            scores = similarities(part, m, *self.counts[item])
            for i in np.flatnonzero(scores >= threshold):
                yield int(item), int(i), float(scores[i])


def _scan(index, k: int, threshold: float):
    def run(batches):
        own = index.value
        for pdf in sliced(batches):
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                best: dict[int, list] = {}
                for item, start, n, score in own.matches(word_hashes(words_of(text)), threshold):
                    b = best.setdefault(item, [start, n, score, 0])
                    b[3] += 1
                    if (-score, start) < (-b[2], b[0]):
                        b[:3] = start, n, score
                rows += [(doc, item, b[3], b[0], b[1], b[2]) for item, b in sorted(best.items(), key=lambda x: (x[0] is not None, x[0] or 0))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_windows", "start_word", "n_words", "similarity"])

    return run


SCHEMA = "doc_id long, item_id long, n_windows long, start_word long, n_words long, similarity double"


def _indexes(docs: DataFrame, benchmark: DataFrame, k: int):
    """The query set as broadcast indexes of at most ITEMS_AT_ONCE texts; rows that repeat both id and text are taken once."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    last, key = None, F.struct(F.coalesce("item_id", F.lit(-(2**63))).alias("a"), F.sha1(F.col("text").cast("binary")).alias("b"))
    items = items.withColumn("key", key)
    while True:
        block = (items if last is None else items.where(F.col("key") > F.struct(F.lit(last.a).alias("a"), F.lit(last.b).alias("b")))).orderBy("key").limit(ITEMS_AT_ONCE).collect()
        yield docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in block], k))
        if len(block) < ITEMS_AT_ONCE:
            return
        last = block[-1].key


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document and benchmark item that has a window in it: the number of passing windows, the best one's first word,
    its words and its similarity (the first of equally good ones).

    Null and empty texts, on either side, match nothing. Repeated document rows give repeated results; repeated items are
    taken once, and texts that share an item_id, or have none, are each searched (items without an id as null). Items of fewer than k
    words match exact repeats. Other columns are ignored. Empty tables give an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for index in _indexes(docs, benchmark, k):
        found = docs.mapInPandas(_scan(index, k, threshold), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` without any benchmark passage, all columns kept.

    Null and empty texts stay; repeated rows stay or go together; items without an id count like others; an empty table on either side
    drops nothing. Columns of `docs` may have any names beside `text`.
    """
    indexes = list(_indexes(docs, benchmark, k))

    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        def one(text):
            words = word_hashes(words_of(text))
            return not any(True for i in indexes for _ in i.value.matches(words, threshold))

        return texts.map(one)

    return docs.where(clean(F.coalesce(F.col("text").cast("string"), F.lit(""))))
