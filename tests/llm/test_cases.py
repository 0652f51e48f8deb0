"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator; pieces of methods against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshcast.llm import chat, decontamination, embeddings, license_scan, ngram_jaccard, packing, pii, queries, toxicity, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, row long, id string, n long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns whose names the operators use inside."""
    long = " ".join(f"word{i % 5000} 4111-1111-1111-1111" for i in range(30_000))
    texts = [None, "", " \t\n", "one", long, "same text here again now", "same text here again now", "mit license", "a@b.de \U0001f600 +49 30 1234567 10.0.0.1"]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1, 7, "x", 3) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "same text here again now", *[None] * 8), (5, "another text under a known id", *[None] * 8), tuple([None] * 10)]
    return spark.createDataFrame(rows, DOCS).cache()


def test_operators_on_odd_documents(spark, odd):
    labels = spark.createDataFrame([(3, 1), (0, 0), (None, 1), (7, None), (3, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(None, "same text here again now"), (1, "same text here again now"), (1, "other words for the same item"), (2, None), (3, "")], "item_id long, text string")
    n = odd.count()
    path = queries.tokenizer_path()
    for result in (pii.pii_spans(odd), toxicity.toxicity_scores(odd, labels), license_scan.license_scan(odd), ngram_jaccard.ngram_jaccard_join(odd)):
        assert result.count() == n
    assert {r.item_id for r in decontamination.contaminated_windows(odd, bench).collect()} == {None, 1}
    assert decontamination.decontaminate(odd, bench).columns == odd.columns
    assert decontamination.decontaminate(odd, bench).count() == n - 4
    packed = packing.packed(odd, path).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert Counter(r.doc_id for r in packed if r.piece == 0)[5] == 3
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(odd).where("text is null").count() == odd.where("text is null").count()
    none = odd.limit(0)
    assert pii.pii_spans(none).count() == license_scan.license_scan(none).count() == packing.packed(none, path).count() == ngram_jaccard.ngram_jaccard_join(none).count() == 0
    assert toxicity.toxicity_scores(none, labels).count() == toxicity.toxicity_scores(none, labels.limit(0)).count() == 0
    assert decontamination.contaminated_windows(none, bench).count() == decontamination.contaminated_windows(odd, bench.limit(0)).count() == 0
    assert decontamination.decontaminate(odd, bench.limit(0)).count() == n


def test_shared_ids_are_compared_each_for_itself(odd):
    rows = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in ngram_jaccard.ngram_jaccard_join(odd).collect())
    assert rows.count((5, 2, 5)) == 2 and (5, 3, 5) in rows and (6, 2, 5) in rows and (-1, 2, -1) in rows and (-1, 0, -1) in rows


def test_pages_with_ties_and_repeats(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (0, "u", "x"), (None, None, None), (2, "u v", ""), (3, "u", "y")]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archived_pages(pages).collect()
    assert sorted((r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got if r.payload_bytes == 1) == [("response", -1), ("response", -1), ("revisit", 1), ("revisit", 1)]
    assert len(got) == 6 and sum(r.record_type == "response" for r in got if r.payload_bytes == 0) == 1
    assert warc.archived_pages(pages.limit(0)).count() == 0
    urls = url_filter.url_verdicts(pages.withColumn("score", F.lit(1)))
    assert urls.count() == 6 and all(r.host == "" and r.verdict in ("allow", "block") for r in urls.collect())
    assert url_filter.url_verdicts(pages.limit(0)).count() == 0


def test_archives_of_many_members(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1 not a record") for i in range(40)], "page_id long, url string, html string").coalesce(2)
    warc.write_warc(pages, str(tmp_path / "w"), pages_per_file=6)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 7
    rows = warc.read_captures(spark, str(tmp_path / "w")).collect()
    assert len(rows) == 40 and all(r.request.http.startswith("GET http://h/") and r.metadata.fields.startswith("payloadBytes: ") for r in rows)
    assert sum(r.kind == "response" for r in rows) == 7 and all((r.original or r.response).payload_bytes > 0 for r in rows)


def test_conversations_with_nulls(spark):
    turns = spark.createDataFrame([(1, 0, None, None, "z"), (None, 0, "user", "q", "z"), (1, None, "assistant", "a", None)], "conv_id long, turn long, role string, text string, segment string")
    assert chat.read_back(chat.formatted_chats(turns)).count() == 2
    assert chat.read_back(chat.formatted_chats(turns.limit(0))).count() == 0


def test_vectors_that_link_with_nothing(spark):
    rows = [(1, None, "a"), (2, [], "a"), (3, [0.0, 0.0], "a"), (4, [1.0, None], "a"), (5, [1.0, float("nan")], "a"), (6, [1.0, 2.0], None), (7, [1.0, 2.0], "a"), (8, [2.0, 4.0], "a"), (9, [1.0, 2.0], "b")]
    v = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label string, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicate_vectors(v).collect()}
    assert got == {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)} | {7: (1, 7, True), 8: (1, 7, False)}
    assert embeddings.near_duplicate_vectors(v.limit(0)).count() == 0


def test_block_tables_hold_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, 30))) for i in range(40)]
    index = decontamination.Index(items, 5)
    flips = rng.integers(0, 30, 4000)
    prints = index.prints[rng.integers(0, 40, 4000)]
    for i, n in enumerate(flips):
        for b in rng.choice(64, n, replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    exact = {(i, j) for i in range(4000) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ index.prints) <= decontamination.RADIUS)}
    assert {tuple(map(int, p)) for p in index.within(prints, np.arange(40))} == exact
    some = np.array([3, 9])
    assert {tuple(map(int, p)) for p in index.within(prints, some)} == {p for p in exact if p[1] in (3, 9)}


def test_windows_against_all_items():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(20, 120))))) for i in range(60)]
    index, lost, total = decontamination.Index(items, 5), 0, 0
    for _ in range(300):
        item, text = items[int(rng.integers(60))]
        part = text.split()
        for p in rng.integers(0, len(part), int(rng.integers(0, 1 + len(part) // 40))):
            part[p] = "new"
        doc = " ".join([*rng.choice(words, 30), *part, *rng.choice(words, 30)])
        hashes = decontamination.word_hashes(decontamination.words_of(doc))
        got = {(i, s) for i, s, _, _ in index.matches(hashes, 0.8)}
        s = decontamination.shingle_hashes(hashes, 5)
        exact = set()
        for i, n, own in index.items:
            m = n - 4
            exact |= {(i, p) for p in range(len(hashes) - n + 1) if decontamination.similarity(s[p : p + m], own) >= 0.8}
        assert got <= exact
        lost, total = lost + len(exact - got), total + len(exact)
    assert total > 200 and lost <= 0.01 * total


def test_risk_gradients():
    rng = np.random.default_rng(3)
    sets = [toxicity._csr([np.unique(rng.integers(0, 6, 4)).astype(np.int32) for _ in range(n)]) for n in (7, 11)]
    x = rng.normal(size=7)
    parts = toxicity.risk(x, *sets, 0.3, 0.1)
    for k in range(7):
        e = np.eye(7)[k] * 1e-6
        up, down = toxicity.risk(x + e, *sets, 0.3, 0.1), toxicity.risk(x - e, *sets, 0.3, 0.1)
        for i in (0, 1):
            assert parts[2 + i][k] == pytest.approx((up[i] - down[i]) / 2e-6, abs=1e-6)


def test_training_does_not_depend_on_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a, b = (pii.fit(docs.repartition(p), rows=200, most_windows=60) for p in (1, 5))
    assert all((a.w[k] == b.w[k]).all() for k in a.w)


def test_base_spans_by_other_code():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}

    def passes(kind, text):
        digits = [int(c) for c in text if c in "0123456789"]
        if kind == "card":
            total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits)))
            return 16 <= len(digits) <= 19 and total % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in text.split(".")) if kind == "ip" else True, "phone": 8 <= len(digits) <= 15}[kind]

    rng = np.random.default_rng(4)
    alphabet = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+49 30 1234567", "+1", "1.2.3.4", "256.1.1.1", "a@b.de", "@", ".", " ", "é", "9", "x", "-", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 12))))
        wanted = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if passes(k, m.group())]
        assert list(pii.base_spans(text)) == wanted, text
