"""Exact token counts at every prefix of a text, by dynamic programming over its bytes.

In byte-level BPE a sequence of tokens is the encoding of its bytes exactly when each two neighbours are that of theirs. So the
encoding of a prefix ends with the one token that stands before its end and fits the last token of the shorter prefix in front of it,
and counts[end] = counts[end - its length] + 1. A word of the tokenizer's pattern is encoded alone, so its counts are made once and
kept; those of a text are sums over its words, with three exceptions that depend on what follows: the last white space before a word, an
unfinished contraction and an unfinished added token such as an end-of-text mark.

A prefix can have fewer tokens than a shorter one. "Longest prefix within a budget" is the longest of all whose own encoding fits.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
import zlib
from itertools import count, groupby, islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import sliced
from .packing import Encoder, _ranks

# White space of the tokenizer's pattern: fixed code points.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_STEPS = np.dtype("<i4")


class PrefixCounter:
    """Counts of a byte-level BPE file of the `tokenizers` library. Other kinds of files are an error."""

    KEPT_WORDS, KEPT_PAIRS, KEPT_LENGTH = 400_000, 500_000, 64
    WORDS_AT_ONCE, WHITES = 200_000, frozenset(WHITE)
    LETTER_OR_DIGIT = regex.compile(r"[\p{L}\p{N}]")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        ranks = _ranks(path)
        tokenizer = Tokenizer.from_file(path)
        added = list(tokenizer.get_added_tokens_decoder().values())
        odd = [t.content for t in added if t.lstrip or t.rstrip or t.single_word or not t.content or any(t.content in u.content for u in added if u is not t)]
        if ranks is None or odd:
            raise ValueError(f"prefix counts need a byte-level BPE file with plain added tokens: {path}")
        self.ranks, self.tokens = ranks, {i: b for b, i in ranks.items()}
        self.ends = {b[i:] for b in ranks for i in range(len(b))}
        self.encode = tiktoken.Encoding("ranks", pat_str=Encoder.WORDS, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.words = self._pattern(regex, r"\p{L}", r"\p{N}", WHITE)
        letters, digits = ("".join(c for c in map(chr, range(256)) if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}"))
        self.latin = self._pattern(re, letters, digits, "".join(c for c in WHITE if c < "\u0100"))
        # Libraries differ on letters and digits of late Unicode versions; texts with these are cut by the file's own tokenizer.
        late = [c for c in map(chr, range(0x500, sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and self.LETTER_OR_DIGIT.match(c)]
        runs = [list(g) for _, g in groupby(late, lambda c, n=count(): ord(c) - next(n))]
        self.late = re.compile("[" + "".join(f"{g[0]}-{g[-1]}" for g in runs) + "]") if late else None
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = regex.compile("(" + "|".join(regex.escape(t.content) for t in added) + ")") if added else None
        self.pairs: dict[int, bool] = {}
        self.moves: dict[tuple, bytes | None] = {}
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _pattern(library, letters: str, digits: str, white: str):
        """The tokenizer's pattern of words with classes written out."""
        out = Encoder.WORDS.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{digits}]").replace(r"\p{L}+", f"[{letters}]+").replace(r"\p{N}+", f"[{digits}]+")
        return library.compile(out.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]"))

    def _fits(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.encode(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """The number of tokens of each prefix of a word, by bytes, from the empty one, and its first token."""
        ranks, ends = self.ranks, self.ends
        last, first, counts = [-1], [-1], [0]
        for end in range(1, len(word) + 1):
            found, start = [], end - 1
            while start >= 0 and (s := word[start:end]) in ends:
                if s in ranks:
                    found.append((start, ranks[s]))
                start -= 1
            for start, token in reversed(found):
                if not start or self._fits(last[start], token):
                    last.append(token)
                    first.append(first[start] if start else token)
                    counts.append(counts[start] + 1)
                    break
        return counts, first

    def _within(self, tokens: list[int], i: int) -> bytes:
        """What each byte of tokens[i] adds to the count. Prefixes that end within it mostly leave the tokens before it as they are, so the answer is kept by
        it and the one before; by as many more as it takes where they do not."""
        for back in range(1, i + 2):
            some = tuple(tokens[i - back : i + 1]) if back <= i else tuple(tokens[: i + 1])
            key = (back > i, some)
            found = self.moves.get(key, 0)
            if found == 0:
                own = some if back > i else some[1:]
                head = sum(len(self.tokens[t]) for t in own[:-1])
                counts, first = self.prefixes(b"".join(self.tokens[t] for t in own))
                fit = back > i or all(self._fits(some[0], t) for t in first[head + 1 :])
                found = np.diff(np.array(counts[head:], _STEPS)).tobytes() if fit else None
                if len(self.moves) >= self.KEPT_PAIRS:
                    self.moves.clear()
                self.moves[key] = found
            if found is not None:
                return found
        raise AssertionError("a word's own beginning always fits")

    def _steps(self, word: str) -> bytes:
        """What each character of a word adds to the count."""
        raw = word.encode()
        tokens = self.encode(raw)
        found = b"".join([self._within(tokens, i) for i in range(len(tokens))])
        if len(raw) > len(word):
            starts = np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)
            found = np.add.reduceat(np.frombuffer(found, _STEPS), starts).astype(_STEPS).tobytes()
        if len(word) == 3 and word[0] == "'" and word[1].isalpha():  # cut after two characters, a contraction is an apostrophe and a letter
            found = np.diff(np.array([0, 1, 2, len(tokens)], _STEPS)).tobytes()
        if len(word) <= self.KEPT_LENGTH:
            if len(self.kept) >= self.KEPT_WORDS:
                self.kept.clear()
            self.kept[word] = found
        return found

    def _cut(self, text: str):
        words = self.words
        try:
            text.encode("latin-1")
            words = self.latin
        except UnicodeEncodeError:
            if self.late is not None and self.late.search(text):
                return (text[a:b] for _, (a, b) in self.cut(text))
        return (m[0] for m in words.finditer(text)) if len(text) > 4 * self.WORDS_AT_ONCE else iter(words.findall(text))

    def _plain(self, text: str, base: int):
        """Arrays of counts at each prefix of a text without added tokens, after `base` tokens before it."""
        kept, before, words = self.kept, "", self._cut(text)
        while some := list(islice(words, self.WORDS_AT_ONCE)):
            counts = np.cumsum(np.frombuffer(b"".join([kept.get(w) or self._steps(w) for w in some]), _STEPS), dtype=np.int64) + base
            total = int(counts[-1])
            # White space in front of a word, after more of it: a text that ends here has all of that white space as one word.
            after = [i for i, w in enumerate(some) if w[0] in WHITE and (some[i - 1] if i else before)[-1:] in self.WHITES]
            if after:
                at = np.cumsum([0, *map(len, some)])
                for i in after:
                    run = some[i - 1] if i else before
                    whole, less = (int(np.frombuffer(self._steps(x), _STEPS).sum()) for x in (run + some[i][0], run))
                    counts[at[i]] = (counts[at[i] - 1] if i else base) - less + whole
            base, before = total, some[-1]
            yield counts

    def counts(self, text: str):
        """Arrays of the number of tokens of each prefix, of one character, of two and so on; nothing for an empty text."""
        parts, base = self.added.split(text) if self.added is not None else [text], 0
        for i in range(0, len(parts), 2):
            mark = parts[i + 1] if i + 1 < len(parts) else ""
            at, left = base, len(parts[i])
            for found in self._plain(parts[i] + mark[:-1], base):  # a text that ends within a mark has its beginning as plain text
                if 0 < left <= len(found):
                    at = int(found[left - 1])
                left -= len(found)
                yield found
            if mark:
                base = at + 1
                yield np.array([base])


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fits: tokens of each text, whether they are over `limit`, and the characters of its longest prefix
    of at most `limit` tokens.

    One row per row of `docs`, whose other columns are not read. A null text counts as an empty one: no bytes, no tokens, fits 0. Repeated rows, null
    and repeated doc_ids are rows like others; an empty table gives an empty one. Texts are counted in steps of some 200,000 words.
    """

    def run(batches):
        counter = _counter(tokenizer_path)
        for pdf in sliced(batches, 500):
            rows = []
            for text in pdf.text:
                done = total = fits = 0
                for found in counter.counts(text or ""):
                    within = np.flatnonzero(found <= limit)
                    fits = done + int(within[-1]) + 1 if len(within) else fits
                    done, total = done + len(found), int(found[-1])
                rows.append((total, fits))
            n = np.array(rows, np.int64).reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": pdf.n_bytes, "n_tokens": n[:, 0], "over_limit": n[:, 0] > limit, "fits": n[:, 1]})

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits long")


BLOCK = 65_536


def prefix_table(docs: DataFrame, tokenizer_path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, block, chars, least, counts): the counts at all prefixes of each text, to be stored. Row b holds those of b * block + 1 characters and on, at
    most `block` of them: `least` is the smallest, `counts` the deflated differences from one to the next, the first one from 0.

    A null text is an empty one; an empty text has one row without counts. Rows that share a doc_id cannot be told apart and are an error of the caller.
    """

    def blocks(text: str, counter: PrefixCounter):
        waiting, number = np.zeros(0, np.int64), 0
        for found in counter.counts(text):
            waiting = np.concatenate([waiting, found])
            while len(waiting) > block:
                yield number, waiting[:block]
                waiting, number = waiting[block:], number + 1
        yield number, waiting

    def run(batches):
        counter = _counter(tokenizer_path)
        for pdf in sliced(batches, 100):
            for doc, text in zip(pdf.doc_id, pdf.text):
                some = [(doc, b, len(c), int(c.min()) if len(c) else 0, zlib.compress(np.diff(c, prepend=0).astype("<i8").tobytes(), 1)) for b, c in blocks(text or "", counter)]
                yield pd.DataFrame(some, columns=["doc_id", "block", "chars", "least", "counts"]).astype({"doc_id": pdf.doc_id.dtype})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, block int, chars int, least long, counts binary")


def _counts_of(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), "<i8"))


@F.pandas_udf(LongType())
def at_index(counts: pd.Series, chars: pd.Series, at: pd.Series) -> pd.Series:
    """The number at an index of a block of counts; null where there is none."""
    return pd.Series([int(_counts_of(c)[int(i)]) if c is not None and i is not None and i < n else None for c, n, i in zip(counts, chars, at)], dtype="Int64")


@F.pandas_udf(LongType())
def last_within(counts: pd.Series, budget: pd.Series) -> pd.Series:
    """How many characters the longest prefix has whose count is at most `budget`."""
    return pd.Series([int(np.flatnonzero(_counts_of(c) <= b)[-1]) + 1 if c is not None else None for c, b in zip(counts, budget)], dtype="Int64")


def tokens_of_prefixes(table: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """`asked` (doc_id, chars, and any other columns) with n_tokens: that of the document's first `chars` characters, from a stored prefix table and without
    encoding. 0 characters have 0 tokens; null for unknown documents, null or negative numbers and those beyond the text."""

    own = asked.select(F.struct("*").alias("asked"), F.col("doc_id").alias("doc"), F.col("chars").cast("long").alias("want"))
    places = own.withColumn("b", F.when(F.col("want") > 0, F.floor((F.col("want") - 1) / block)).otherwise(0).cast("int")).withColumn("at", F.greatest(F.col("want") - 1, F.lit(0)) % block)
    stored = table.select(F.col("doc_id").alias("doc"), F.col("block").alias("b"), "chars", "counts")
    found = places.join(stored, ["doc", "b"], "left")
    number = F.when(F.col("want") == 0, F.when(F.col("chars").isNotNull(), F.lit(0))).when(F.col("want") > 0, at_index("counts", "chars", "at"))
    return found.select("asked.*", number.cast("long").alias("n_tokens"))


def prefixes_within(table: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """`asked` (doc_id, budget, and any other columns) with fits: the characters of the document's longest prefix of at most `budget` tokens, from a stored
    prefix table and without encoding. 0 if only the empty one is; null for unknown documents and null or negative budgets."""
    own = asked.select(F.struct("*").alias("asked"), F.col("doc_id").alias("doc"), F.col("budget").cast("long").alias("most"))
    wanted = own.select("doc", "most").distinct().where("doc is not null and most >= 0")
    sizes = table.select(F.col("doc_id").alias("doc"), "block", "least", "chars")
    last = wanted.join(sizes, "doc").groupBy("doc", "most").agg(F.max(F.when((F.col("least") <= F.col("most")) & (F.col("chars") > 0), F.col("block"))).alias("block"))
    found = last.join(table.select(F.col("doc_id").alias("doc"), "block", "counts"), ["doc", "block"], "left")
    answer = found.select("doc", "most", F.coalesce(last_within("counts", "most") + F.col("block").cast("long") * block, F.lit(0)).alias("fits"))
    return own.join(answer, ["doc", "most"], "left").select("asked.*", "fits")
