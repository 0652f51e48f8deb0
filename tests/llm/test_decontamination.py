"""Windows of decontamination against a plain comparison of every window with every item; memory on long texts."""

import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from meshcast.llm import decontamination as D


def plain(doc: str, items, k: int, least: float):
    """(item, start) of the windows that pass, by counting shingles."""

    def bag(words):
        return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))

    words, out = doc.split(), set()
    for item, text in items:
        own = bag(text.split())
        n = min(len(text.split()), len(words))
        for p in range(len(words) - n + 1):
            b = bag(words[p : p + n])
            both = sum((b & own).values())
            if both and both >= least * (sum(b.values()) + sum(own.values()) - both):
                out.add((item, p))
    return out


def found(index, doc: str, least: float):
    rows = list(index.matches(D.word_hashes(D.words_of(doc)), least))
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2] for r in rows}


@pytest.fixture(scope="module")
def cases():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(8, 60))))) for i in range(20)]
    items += [(20, "a b " * 12), (21, "tick tock " * 20 + "boom"), (22, items[0][1] + " " + items[1][1])]
    docs = []
    for _ in range(120):
        parts = []
        for _ in range(int(rng.integers(1, 4))):
            part = items[int(rng.integers(len(items)))][1].split()
            for p in rng.integers(0, len(part), int(rng.integers(0, 3))):
                part[p] = "new"
            parts += [*rng.choice(words, int(rng.integers(0, 12))), *part]
        docs.append(" ".join(parts))
    # A repeated item, an item without its end, and texts without any.
    docs += [" ".join([items[3][1]] * 7), items[5][1].rsplit(" ", 1)[0], "a b " * 40, " ".join(words), "w1"]
    return items, docs


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_every_passing_window_is_found(cases, least):
    items, docs = cases
    index, total = D.Index(items, 5), 0
    for doc in docs:
        exact = plain(doc, items, 5, least)
        assert found(index, doc, least) == exact
        total += len(exact)
    assert total > 200


def test_items_without_a_candidate_are_verified_by_their_shingles(cases, monkeypatch):
    items, docs = cases
    index = D.Index(items, 5)
    monkeypatch.setattr(D.Index, "within", lambda self, prints, which: np.empty((0, 2), np.int64))
    assert all(found(index, doc, 0.8) == plain(doc, items, 5, 0.8) for doc in docs[:40])


def test_stretches_longer_than_a_chunk(cases, monkeypatch):
    items, docs = cases
    index = D.Index(items, 5)
    monkeypatch.setattr(D, "CHUNK", 7)
    assert all(found(index, doc, 0.8) == plain(doc, items, 5, 0.8) for doc in docs[:40] + docs[-5:])


def test_sums_of_windows():
    s = np.random.default_rng(6).integers(0, 2**63, 50).astype(np.uint64)
    for m in (1, 7, 50):
        plain = [sum(2 * ((s[i : i + m, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int) - 1) for i in range(50 - m + 1)]
        assert np.array_equal(D.window_sums(s, m), plain)


def test_memory_on_a_long_text_of_repeated_items():
    """Two megabytes of one benchmark passage in a row: what the scan adds stays under 300 MB."""
    code = """
import resource, time
from meshcast.llm import decontamination as D
item = " ".join(f"w{i}" for i in range(200))
index = D.Index([(1, item)], 5)
words = D.word_hashes(D.words_of(" ".join([item] * 2000)))
before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
n = sum(1 for _ in index.matches(words, 0.8))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024, time.time() - t)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert int(out[0]) >= 1999 * 200
    assert float(out[1]) < 300 and float(out[2]) < 30
