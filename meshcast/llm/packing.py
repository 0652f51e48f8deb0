"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Only lengths decide how pieces are packed, so the plan is made on the histogram of lengths (at most `capacity` numbers, whatever
the input): a bin is filled greedily with the longest pieces that fit, then its smallest piece is replaced by two unpacked ones
that fill the gap more tightly; a bin's pattern is repeated as often as its lengths allow. Every piece then finds its place by
its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sliced, staged

def _ranks(path: str) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file without normaliser whose merges stand in the order of their ids; None for any other file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec.get("normalizer") and model.get("type") == "BPE"
    if not plain or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # Byte-level files write each byte as a printable character: itself if it is one, else the next from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    return ranks if len({b for b in ranks if len(b) == 1}) == 256 and merged == sorted(merged) and merged[:1] != [-1] else None


class Encoder:
    """Ids of whole texts with a `tokenizers` file.

    Byte-level BPE files are encoded by their ranks, with the same ids (compared over every code point) in a third of the time. Texts
    that hold an added token, such as an end-of-text mark, and other kinds of files go to the file's own tokenizer.
    """

    # The words of byte-level BPE: fixed pattern.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = _ranks(path)
        self.fast = ranks and tiktoken.Encoding("ranks", pat_str=self.WORDS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # a run of about a million white-space characters is beyond its pattern's stack
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


END = np.array([2], "<u4").tobytes()
_encoders: dict[str, Encoder] = {}


def _pieces(path: str, capacity: int):
    def run(batches):
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        encoder = _encoders[path]
        for pdf in sliced(batches, 500):
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = encoder.encode(text or "") + END
                n = len(ids) // 4
                start, length, piece = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    rows.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start, length, piece = start + length, capacity, piece + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents (ids, then 2) over `capacity` tokens are cut, their first piece takes the rest."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(_pieces(tokenizer_path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in a bin, number of such bins) for counts[n] pieces of n tokens each."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []

    def longest(gap: int) -> int:
        found = np.flatnonzero(left[: gap + 1])
        return int(found[-1]) if len(found) else 0

    while True:
        n = longest(capacity)
        if not n:
            return out
        bin_, gap = [], capacity
        while n:
            bin_.append(n)
            left[n] -= 1
            gap -= n
            n = longest(gap)
        small = bin_[-1]
        if gap and len(bin_) > 1:
            # Two unpacked pieces a <= b in place of the smallest: the largest a + b that fits and leaves less room than before.
            room, best = gap + small, (small, 0, 0)
            for a in np.flatnonzero(left[: room // 2 + 1])[::-1]:
                a = int(a)
                left[a] -= 1
                b = longest(room - a)
                left[a] += 1
                if b >= a and a + b > best[0]:
                    best = (a + b, b, a)
                if best[0] == room:
                    break
            if best[1]:
                left[small] += 1
                bin_[-1:] = best[1:]
                for x in best[1:]:
                    left[x] -= 1
        use = np.bincount(bin_, minlength=len(left))
        kinds = np.flatnonzero(use)
        more = int((left[kinds] // use[kinds]).min())
        left[kinds] -= more * use[kinds]
        out.append((bin_, 1 + more))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, bucket_rows: int = 1 << 16) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty (one token); repeated rows are packed as documents of their own; an empty table gives no rows; other columns
    are ignored. The pieces of a length are numbered in buckets of about `bucket_rows`, dealt by a stored row number, so that neither one
    length nor copies of one document make a large group.
    """
    spark = docs.sparkSession
    p = staged(pieces(docs, tokenizer_path, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    # At most `capacity` rows.
    totals = p.groupBy("length").count().toPandas()
    counts = np.zeros(capacity + 1, np.int64)
    counts[totals.length.to_numpy(np.int64)] = totals["count"].to_numpy(np.int64)
    slots, first = [], np.zeros(capacity + 1, np.int64)
    sequence = 0
    for lengths, times in plan(counts, capacity):
        for n in sorted(set(lengths)):
            at = [o for o, x in zip(np.cumsum([0, *lengths]), lengths) if x == n]
            slots.append((n, int(first[n]), sequence, [int(o) for o in at]))
            first[n] += times * len(at)
        sequence += times
    p = p.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(max(64, int(counts.sum()) // bucket_rows))).cast("int"))
    sizes = p.groupBy("length", "bucket").count()
    ahead = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "bucket", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket", "row")
    return _place(ranked, slots)


def _place(ranked: DataFrame, slots) -> DataFrame:
    """Give each (length, rank) its sequence and offset. The table of slots depends on the distinct lengths only."""
    by: dict[int, tuple] = {}
    for n in {s[0] for s in slots}:
        own = [s for s in slots if s[0] == n]
        by[n] = (np.array([s[1] for s in own]), [s[2] for s in own], [s[3] for s in own])
    table = ranked.sparkSession.sparkContext.broadcast(by)

    def run(batches):
        for pdf in batches:
            seqs, offsets = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            rank = pdf["rank"].to_numpy(np.int64)
            for i, (n, r) in enumerate(zip(pdf.length.to_numpy(), rank)):
                lo, seq, at = table.value[int(n)]
                k = int(np.searchsorted(lo, r, "right")) - 1
                turn, place = divmod(int(r - lo[k]), len(at[k]))
                seqs[i], offsets[i] = seq[k] + turn, at[k][place]
            yield pdf.drop(columns="rank").assign(sequence_id=seqs, offset=offsets)

    return ranked.mapInPandas(run, "length long, doc_id long, piece int, start long, ids_crc32 long, sequence_id long, offset long").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
