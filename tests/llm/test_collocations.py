"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meshcast.llm import collocations as C


def brute(rows, longest, least, top, percent):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(C.LOWER)):
            ws = [w for w in re.split("[ \t]", piece) if w]
            words[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.setdefault(lang, Counter()).update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for g, a in found.items():
            inside = [b for h, b in found.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * b >= percent * a for b in inside):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top,percent", [(3, 3, 2000, 50), (4, 3, 7, 80), (2, 5, 50, 50)])
def test_counts(spark, longest, least, top, percent):
    rng = random.Random(longest)
    words = ["New", "york", "city", "é", "\U0001f600", "the", "of", "a\xa0b", "x-y", *(f"w{i}" for i in range(40))]

    def text(n):
        return "".join(rng.choice(words[: rng.choice([4, 9, 49])]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(n))

    rows = [(text(rng.randint(0, 60)), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", "fr"), (" \t.\n", "fr"), ("only", "it"), (text(4000), "en"), ("New York city. " * 9, "fr")] + [rows[0]] * 3
    docs = spark.createDataFrame([(i, t, lang, 5, "x") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, rank int, word string").repartition(3)
    found = sorted(tuple(r) for r in C.collocations(docs, longest, least, top, percent).collect())
    assert found == brute(rows, longest, least, top, percent)
    assert C.collocations(docs.limit(0)).count() == 0


def test_chunks_hold_every_word(monkeypatch):
    monkeypatch.setattr(C, "CHUNK_WORDS", 100)
    monkeypatch.setattr(C, "AT_ONCE", 64)
    monkeypatch.setattr(C.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    texts = [("A b c a b. " * 300 + "a b", "en"), ("b c " * 40, "de"), (None, "de"), ("b\tc\x0bd", "en")] * 2
    batch = pa.RecordBatch.from_pylist([{"text": t, "lang": lang} for t, lang in texts])
    found: dict = {}
    rows = [r for b in C._chunks([batch]) for r in b.to_pylist()]
    assert [r["chunk"] for r in rows] == [(3 << 32) + i for i in range(len(rows))]
    for r in rows:
        stream = C._unpacked(r["stream"], np.int32)
        assert r["counts"] == np.bincount(stream[stream >= 0]).tolist() and r["n"] == sum(r["counts"])
        found.setdefault(r["lang"], []).append(" ".join("." if i < 0 else r["words"][i] for i in stream))
    plain = lambda t: re.sub("[.\x0b]", " . ", t.lower()) + " ."
    for lang in ("en", "de"):
        assert " ".join(found[lang]).split() == " ".join(plain(t) for t, x in texts if x == lang and t).split()


def test_tiles():
    rng = np.random.default_rng(1)
    a = np.concatenate([rng.integers(0, 300, 100_000), rng.integers(0, 1 << 39, 500), np.array([(1 << 40) - 1])])
    b = np.concatenate([rng.integers(0, 300, 100_000), rng.integers(0, 1 << 39, 500), np.array([0])])
    x, y, n = C.tile_counts(a, b)
    assert Counter(zip(a.tolist(), b.tolist())) == dict(zip(zip(x.tolist(), y.tolist()), n.tolist())) and len(x) == len(set(zip(x.tolist(), y.tolist())))
    assert [len(z) for z in C.tile_counts(a[:0], b[:0])] == [0, 0, 0]


def test_scores_past_64_bits(spark):
    row = spark.sql("select cast(1000000 * (cast(a as decimal(16,0)) * cast(a as decimal(15,0))) as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) x from values (900000000000000L, 900000000000001L, 900000000000002L) t(a, l, r)").first()
    assert row.x == 1_000_000 * 900000000000000**2 // (900000000000001 * 900000000000002)
