"""Prefix counts against the tokenizer's own encoding of every prefix."""

import random

import numpy as np
import pytest

from meshcast.llm import queries
from meshcast.llm import token_counts as T

PARTS = ["a", "b", "the", " ", "  ", "\n", "\n\n", "'", "'re", "'ll", "'s", "1", "23", "é", "日本", "　", "\U0001f600", "!", "...", "<|endoftext|>", "<|endo", "\t", "\U0001e6c0", "xxxxxxxxx", "ÃÂÃÂ", "\x85", " don't", "_", "ciónheit", " chscherber"]


@pytest.fixture(scope="module")
def own():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def lengths(own, texts):
    return [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]


def test_every_prefix(own, monkeypatch):
    counter, rng = T.PrefixCounter(queries.tokenizer_path()), random.Random(3)
    for at_once in (3, 200_000):
        monkeypatch.setattr(T.PrefixCounter, "WORDS_AT_ONCE", at_once)
        for _ in range(600):
            text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
            got = np.concatenate([np.zeros(0, int), *counter.counts(text)]).tolist()
            assert got == lengths(own, [text[: i + 1] for i in range(len(text))]), text
    assert counter.prefixes(b"heit")[0] == [0, *lengths(own, ["h", "he", "hei", "heit"])]


def test_kept_words_may_be_dropped(own, monkeypatch):
    monkeypatch.setattr(T.PrefixCounter, "KEPT_WORDS", 2)
    monkeypatch.setattr(T.PrefixCounter, "KEPT_PAIRS", 2)
    text = "ciónheit keitlichen scherber'll " * 40 + "x" * 3000
    counter = T.PrefixCounter(queries.tokenizer_path())
    assert [int(c[-1]) for c in counter.counts(text)] == lengths(own, [text])


def test_other_files_are_an_error():
    with pytest.raises(ValueError, match="byte-level"):
        T.PrefixCounter(queries.tokenizer_path("word_bpe_49k.json"))


def test_counts_and_answers_without_encoding(spark, own):
    texts = [None, "", " \n ", "one two", "one two", "don'll " * 50, "<|endoftext|>" * 3, "a" * 1000 + "　　b", "word " * 500]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, "no id", 7, "x"), (3, "one two", 7, "x")], "doc_id long, text string, n_tokens int, block string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in T.token_counts(docs, queries.tokenizer_path(), limit=100).collect())
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip([*enumerate(texts), (-1, "no id"), (3, "one two")], lengths(own, [t or "" for t in [*texts, "no id", "one two"]]))]
    assert got == sorted(want)
    assert T.token_counts(docs.limit(0), queries.tokenizer_path()).count() == 0

    stored = T.prefix_table(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), queries.tokenizer_path(), block=16).cache()
    every = [lengths(own, [(t or "")[:n] for n in range(len(t or "") + 1)]) for t in texts]
    asked = [(d, n, "k") for d, c in enumerate(every) for n in range(len(c))]
    found = T.tokens_of_prefixes(stored, spark.createDataFrame([*asked, (3, 99, "k"), (3, None, "k"), (77, 0, "k")], "doc_id long, chars long, at string"), block=16).collect()
    assert {(r.doc_id, r.chars, r.n_tokens) for r in found} == {(d, n, every[d][n]) for d, n, _ in asked} | {(3, 99, None), (3, None, None), (77, 0, None)}
    budgets = [(d, b) for d in range(len(texts)) for b in (0, 1, 2, 5, 50, 10_000)]
    found = T.prefixes_within(stored, spark.createDataFrame([*budgets, (3, -1), (77, 5)], "doc_id long, budget long"), block=16).collect()
    want = {(d, b, max(n for n, c in enumerate(every[d]) if c <= b)) for d, b in budgets}
    assert {tuple(r) for r in found} == want | {(3, -1, None), (77, 5, None)}


def test_fits_is_the_longest_prefix(spark, own):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in T.token_counts(docs, queries.tokenizer_path(), limit=60).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == lengths(own, [text])[0]
        assert lengths(own, [text[: r.fits]])[0] <= 60 and (r.fits == len(text) or all(n > 60 for n in lengths(own, [text[: r.fits + i] for i in range(1, min(30, len(text) - r.fits) + 1)])))
