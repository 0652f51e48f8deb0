"""The network of the personal data operator, and the linear form of the fixed patterns."""

import random
import time

import numpy as np
import pytest

from meshcast.llm import pii

SENTENCE = "please write to us by way of the usual channel {} and wait for an answer"


@pytest.fixture(scope="module")
def tagger(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()]
    return pii.trained(list({tuple(codes): (codes, tags) for t in texts for codes, tags in pii.labelled(t)}.values()))


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind in pii.KINDS for m in pii.PATTERNS[kind].finditer(text) if pii._passes(kind, m.group())]


def test_linear_patterns_give_the_spans_of_the_plain_ones():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(rng.choice("aA1.. 23+@-_%()9\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_patterns_take_linear_time():
    for text in ("1" * 1_000_000, "@ " + "a" * 1_000_000, "a" * 1_000_000 + "@" + "a" * 1_000_000, "1." * 500_000, "+1" + " " * 1_000_000):
        start = time.process_time()
        pii.base_spans(text)
        assert time.process_time() - start < 2


def test_forms_that_the_patterns_miss_are_found(tagger):
    rng = np.random.default_rng(99)
    for kind in pii.KINDS:
        found = asked = 0
        while asked < 100:
            form = pii.made_up(rng, kind)
            text, at = SENTENCE.format(form), SENTENCE.index("{}")
            if not any(k == kind for k, _, _ in pii.base_spans(text)):
                asked += 1
                found += any(s[1:] == (kind, at, at + len(form)) for s in pii.added_spans(tagger, [text])[0])
        assert found >= 50, kind


def test_clean_texts_stay_clean(tagger, spark):
    rng = np.random.default_rng(4)
    texts = [SENTENCE.format(pii.no_span(rng)) for _ in range(300)]
    touched = sum(pii.reconciled(b, a, len(t)) != b for t, a, b in ((t, a, pii.base_spans(t)) for t, a in zip(texts, pii.added_spans(tagger, texts))))
    assert touched <= 9
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").collect()]
    clean = [t for t in docs if not pii.base_spans(t)]
    assert sum(map(bool, pii.added_spans(tagger, clean))) <= len(clean) // 200


def test_a_run_is_one_path_whatever_stands_beside_it(tagger):
    long = " ".join(f"call 020 7946 0{i:03d} or mail jo{i} [at] post [dot] org" for i in range(300))
    texts = [long, "", "no trigger", SENTENCE.format("10 . 20 . 30 . 40"), "1" * 5000]
    together = pii.added_spans(tagger, texts)
    assert together[1] == together[2] == []
    for text, spans in zip(texts, together):
        assert [s[1:] for s in pii.added_spans(tagger, [text])[0]] == [s[1:] for s in spans]
    # Spans across the edges of windows are whole.
    mails = {(a, b) for _, kind, a, b in together[0] if kind == "email"}
    wanted = {(long.index(m), long.index(m) + len(m)) for m in (f"jo{i} [at] post [dot] org" for i in range(300))}
    assert len(mails & wanted) >= 270


def test_without_training_no_spans_are_added():
    assert pii.added_spans(pii.trained([]), [SENTENCE.format("10 . 20 . 30 . 40")]) == [[]]
