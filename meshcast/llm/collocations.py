"""Phrases whose words stand together more often than apart, by direct-address tiling.

Texts are read once into chunks of word numbers. Words that occur often enough are ranked by frequency; a pair of neighbours is then an address in a square of
tiles of TILE x TILE ranks. Full tiles are counted densely by numpy.bincount, the others as sorted coordinates. Pairs that occur often enough
are ranked in turn, and a pair and the word after it are the next square's address, and so on up to the longest phrase: a phrase is frequent only if both of its
parts without one end are.

Each task counts its own tiles; Spark adds the counts up. Per chunk, each word and each frequent pair meets the table of ranks once, so no word is a hot key.
"""

from __future__ import annotations

import zlib
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import UPPER, staged

SEPARATORS = ".,;:!?\n\x0b\x0c\r"
LOWER = str.maketrans(UPPER, UPPER.lower())
CHUNK_WORDS, AT_ONCE = 1_000_000, 2_000_000
NOTHING, BREAK = 0, 1
TILE_BITS = 9
#: A tile with so many pairs at once is counted densely.
DENSE = 1 << (2 * TILE_BITS - 3)
FILTER_BITS = 26


class _Numbers(dict):
    """Numbers of strings in the order of their coming."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _split(text: str):
    """Lists of words and "." for breaks, an end included; empty strings beside them."""
    start = 0
    while start < len(text):
        end = min(start + AT_ONCE, len(text))
        while end < len(text) and text[end] not in " \t" and text[end] not in SEPARATORS:  # not within a word
            end += 1
        part = text[start:end].replace("\t", " ")
        for c in SEPARATORS:
            if c in part:
                part = part.replace(c, " . ")
        yield (part if end < len(text) else part + " .").split(" ")
        start = end


CHUNKS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("stream", pa.binary())])


def _chunks(batches):
    """Rows (chunk, lang, n, words, counts, stream): the distinct words of some documents of a language, and their texts as numbers of these, -1 at breaks."""
    serial = count()
    open_: dict[str, tuple[_Numbers, list[np.ndarray], list[int]]] = {}

    def emit(lang: str):
        numbers, streams, _ = open_.pop(lang)
        lowered = _Numbers()
        to = np.array([lowered[w.lower() if w.isascii() else w.translate(LOWER)] if i > BREAK else -1 for i, w in enumerate(numbers)], np.int32)
        stream = to[np.concatenate(streams)]
        counts = np.bincount(stream[stream >= 0], minlength=len(lowered))
        row = {"chunk": TaskContext.get().partitionId() << 32 | next(serial), "lang": lang, "n": int(counts.sum()), "words": list(lowered), "counts": counts.tolist(), "stream": _packed(stream)}
        return pa.RecordBatch.from_pylist([row], CHUNKS)

    for batch in batches:
        for text, lang in zip(batch["text"], batch["lang"]):
            lang, text = lang.as_py(), text.as_py()
            if not text:
                continue
            if lang not in open_:
                open_[lang] = _Numbers({"": NOTHING, ".": BREAK}), [], [0]
            numbers, streams, size = open_[lang]
            for some in _split(text):
                ids = np.fromiter(map(numbers.__getitem__, some), np.int32, len(some))
                streams.append(ids[ids != NOTHING])
                size[0] += len(some)
            if size[0] >= CHUNK_WORDS:
                yield emit(lang)
        # Few languages hold much of a task's texts; many small ones are passed on before they fill memory.
        while sum(size[0] for *_, size in open_.values()) >= 4 * CHUNK_WORDS or len(open_) > 1000:
            yield emit(max(open_, key=lambda x: open_[x][2][0]))
    for lang in list(open_):
        yield emit(lang)


CODED = "chunk long, words binary, grams binary"


def _recoded(batches):
    """Streams of word numbers as streams of ranks, -1 for breaks and words without one. Phrases of one word are the words themselves: grams is null."""
    for batch in batches:
        for chunk, stream, at, rank in zip(*(batch[c] for c in ("chunk", "stream", "at", "rank"))):
            stream = _unpacked(stream.as_py(), np.int32)
            to = np.full(int(stream.max(initial=-1)) + 2, -1, np.int64)
            to[at.values.to_numpy()] = rank.values.to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()]), pa.array([_packed(to[stream])]), pa.array([None], pa.binary())], ["chunk", "words", "grams"])


def tile_counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of ranks (below 2^40) and how often each occurs."""
    if not len(a):
        return a, a, a
    mask, area = (1 << TILE_BITS) - 1, 2 * TILE_BITS
    rows, columns = a >> TILE_BITS, b >> TILE_BITS
    local = (a & mask) << TILE_BITS | b & mask
    width = int(columns.max()) + 1
    if (int(rows.max()) + 1) * width <= AT_ONCE:  # tiles have addresses, too
        tile = rows * width + columns
        sizes = np.bincount(tile)
        tiles = np.arange(len(sizes))
    else:
        tiles, tile, sizes = np.unique(rows << 31 | columns, return_inverse=True, return_counts=True)
        width = 1 << 31
    full = np.flatnonzero(sizes >= DENSE)
    slot = np.full(len(sizes), -1)
    slot[full] = np.arange(len(full))
    own = slot[tile]
    keys, counts = [], []
    for lo in range(0, len(full), 8):  # eight tiles at a time
        some = (own >= lo) & (own < lo + 8)
        dense = np.bincount(own[some] - lo << area | local[some], minlength=0)
        hit = np.flatnonzero(dense)
        keys.append(full[lo + (hit >> area)] << area | hit & (1 << area) - 1)
        counts.append(dense[hit])
    rest = own < 0
    coordinates = np.sort(tile[rest] << area | local[rest])
    starts = np.flatnonzero(np.diff(coordinates, prepend=-1))
    key = np.concatenate([*keys, coordinates[starts]])
    corner, inside = tiles[key >> area], key & (1 << area) - 1
    return corner // width << TILE_BITS | inside >> TILE_BITS, corner % width << TILE_BITS | inside & mask, np.concatenate([*counts, np.diff(starts, append=len(coordinates))])


def _neighbours(words: np.ndarray, grams: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a frequent phrase of `size` words and the one a word later both stand: places, the first's rank and the rank of the word after it."""
    places = np.flatnonzero((grams[:-1] >= 0) & (grams[1:] >= 0)) if len(grams) else np.zeros(0, np.int64)
    places = places[places + size < len(words)]
    return places, grams[places], words[places + size]


def _streams(words, grams) -> tuple[np.ndarray, np.ndarray]:
    w = _unpacked(words.as_py(), np.int64)
    return w, _unpacked(grams.as_py(), np.int64) if grams.is_valid else w


def _counted(size: int):
    def run(batches):
        a, b, waiting = [], [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in tile_counts(np.concatenate(a), np.concatenate(b))], ["a", "b", "n"])
        for batch in batches:
            for words, grams in zip(batch["words"], batch["grams"]):
                _, x, y = _neighbours(*_streams(words, grams), size)
                a.append(x)
                b.append(y)
                waiting += len(x)
                if waiting >= AT_ONCE:
                    yield flush()
                    a, b, waiting = [], [], 0
        if waiting:
            yield flush()

    return run


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bits of the hashes of the frequent pairs in 64-bit words: 8 MB, whatever their number. A set bit says "look it up", so nothing is lost when many are set."""

    def places(batches):
        for batch in batches:
            h = _bits(batch["a"].to_numpy(), batch["b"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h >> 6), pa.array(np.left_shift(np.uint64(1), (h & 63).astype(np.uint64)).view(np.int64))], ["at", "bits"])

    found = frequent.select("a", "b").mapInArrow(places, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _looked_up(size: int, shared):
    """(chunk, a, b, k): the distinct neighbours of a chunk that may be frequent, numbered in order."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            for chunk, words, grams in zip(*(batch[c] for c in ("chunk", "words", "grams"))):
                _, a, b = _neighbours(*_streams(words, grams), size)
                h = _bits(a, b)
                hit = (bits[h >> 6] >> (h & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                a, b, _ = tile_counts(a[hit], b[hit])
                for lo in range(0, len(a), 50_000):
                    part = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[part]), chunk.as_py(), np.int64)), pa.array(a[part]), pa.array(b[part])], ["chunk", "a", "b"])

    return run


def _advanced(size: int):
    """Streams of the ranks of phrases of size + 1 words, from those of `size` and the chunk's own table (a, b) -> rank."""

    def run(batches):
        for batch in batches:
            for chunk, words, grams, a, b, rank in zip(*(batch[c] for c in ("chunk", "words", "grams", "a", "b", "rank"))):
                w, g = _streams(words, grams)
                places, x, y = _neighbours(w, g, size)
                ta, tb, tr = (c.values.to_numpy() for c in (a, b, rank))
                codes, width = np.concatenate([ta, x]), int(max(tb.max(initial=0), y.max(initial=0))) + 1
                if int(codes.max(initial=0)) * width >= 1 << 62:
                    codes = np.unique(codes, return_inverse=True)[1]
                key = codes * width + np.concatenate([tb, y])
                order = np.argsort(key[: len(ta)])
                known = key[: len(ta)][order]
                at = np.minimum(np.searchsorted(known, key[len(ta) :]), len(known) - 1)
                out = np.full(len(g), -1, np.int64)
                out[places] = np.where(known[at] == key[len(ta) :], tr[order][at], -1)
                yield pa.RecordBatch.from_pydict({"chunk": [chunk.as_py()], "words": [words.as_py()], "grams": [_packed(out)]})

    return run


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of 2 to `longest` words of each language by score, a, and phrase.

    Texts are cut at .,;:!? and line ends into pieces, these at blanks and tabs into words, A-Z lower-cased. a, l and r count the phrase and the two parts of its
    lowest-scoring cut, n all words of the language; score is floor(1000000 * a * a / (l * r)), exactly. Phrases under `least` are no candidates; those inside a
    longer candidate with at least `inside_percent` % of their own count are left out. Null texts are empty, a null lang is `und`; repeated rows and
    texts count each time; no documents, no rows. Columns other than text and lang are not read.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    chunks = staged(texts.mapInArrow(_chunks, "chunk long, lang string, n long, words array<string>, counts array<long>, stream binary"), "chunks")
    own = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "w")).select("chunk", "lang", "at", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    vocabulary = staged(own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "vocabulary")
    vocabulary = staged(numbered(vocabulary, "lang", -F.col("f"), "word", name="rank"), "ranks")
    tables = own.join(vocabulary.select("lang", "word", "rank"), ["lang", "word"]).groupBy("chunk").agg(F.collect_list(F.struct("at", "rank")).alias("t"))
    streams = chunks.select("chunk", "stream").join(tables, "chunk").select("chunk", "stream", F.col("t.at").alias("at"), F.col("t.rank").alias("rank"))
    coded = staged(streams.mapInArrow(_recoded, CODED), "coded")
    # Every frequent phrase: its rank among those of its size, its words' ranks, and its count.
    grams = vocabulary.select("rank", F.array("rank").alias("gram"), "f")
    every = [grams.select("gram", "f")]
    for size in range(1, longest):
        counts = coded.mapInArrow(_counted(size), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        frequent = staged(counts, "frequent")
        if size + 1 < longest:
            frequent = staged(numbered(frequent, -F.col("f"), "a", "b", name="rank"), "ranks")
            bits = coded.sparkSession.sparkContext.broadcast(_filter(frequent))
            asked = coded.mapInArrow(_looked_up(size, bits), "chunk long, a long, b long")
            tables = asked.join(frequent.select("a", "b", "rank"), ["a", "b"]).groupBy("chunk").agg(F.collect_list(F.struct("a", "b", "rank")).alias("t"))
            streams = coded.join(tables, "chunk").select("chunk", "words", "grams", *(F.col(f"t.{c}").alias(c) for c in ("a", "b", "rank")))
            coded = staged(streams.mapInArrow(_advanced(size), CODED), "coded")
        else:
            frequent = frequent.withColumn("rank", F.lit(None).cast("long"))
        grams = frequent.join(grams.select(F.col("rank").alias("a"), "gram"), "a").select("rank", F.concat("gram", F.array("b")).alias("gram"), "f")
        every.append(grams.select("gram", "f"))
    grams = staged(reduce(DataFrame.union, every), "grams")
    phrases = grams.where(F.size("gram") > 1)
    inner = phrases.where(F.size("gram") > 2).select("f", F.explode(F.expr("flatten(transform(sequence(2, size(gram) - 1), k -> transform(sequence(1, size(gram) - k + 1), i -> slice(gram, i, k))))")).alias("gram"))
    inner = inner.groupBy("gram").agg(F.max("f").alias("longer"))
    left = phrases.join(inner, "gram", "left").where(f"longer is null or 100 * longer < {int(inside_percent)} * f").select("gram", F.col("f").alias("a"))
    cuts = left.select("gram", "a", F.explode(F.expr("sequence(1, size(gram) - 1)")).alias("k")).select("gram", "a", "k", F.expr("slice(gram, 1, k)").alias("x"), F.expr("slice(gram, k + 1, size(gram) - k)").alias("y"))
    cuts = cuts.join(grams.select(F.col("gram").alias("x"), F.col("f").alias("l")), "x").join(grams.select(F.col("gram").alias("y"), F.col("f").alias("r")), "y")
    # Products of two counts can pass 64 bits: decimals of 38 digits hold them.
    cuts = cuts.withColumn("score", F.expr("cast(1000000 * (cast(a as decimal(16,0)) * cast(a as decimal(15,0))) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    best = cuts.groupBy("gram", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best")).select("gram", "a", "best.*")
    words = best.select("gram", F.posexplode("gram").alias("i", "rank")).join(vocabulary.select("rank", "lang", "word"), "rank")
    words = words.groupBy("gram").agg(F.first("lang").alias("lang"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    out = best.join(words, "gram").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(64)))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    for keys in (("lang", "part"), ("lang",)):  # first per part, so no window holds more than 64 tops
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    return out.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

