"""Training-data operators against brute force on a small table with nulls, empty texts, ties and repeats."""

import base64
import hashlib
import re
import zlib
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshcast.llm import chat, decontamination, embeddings, license_scan, ngram_jaccard, packing, pii, queries, url_filter, warc

SF = "/root/testdata/sf0.01"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def shingles(text, k=4):
    words = SPACE.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 400").select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "  \t "), (6, "mit license mit license " * 3), (6, "mit license mit license " * 3), (None, "no id at all"), (7, "é \U0001f600 +1 (555) 010-9999 a.b@c.de 1.2.3.4 999.1.1.1, 4111 1111 1111 1111")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, id string")


def test_ngram_jaccard(docs, odd):
    rows = docs.collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    wanted = components(sets, links)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.ngram_jaccard_join(docs).collect()}
    assert found == {d: (len(sets[d]), wanted[d]) for d in sets}
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_jaccard.ngram_jaccard_join(odd).collect())
    assert [g for g in got if g[0] in (3, 4)] == [(3, 1, 3), (4, 1, 3)]
    assert len(got) == 9 and (1, 0, 1) in got and (5, 0, 5) in got
    assert ngram_jaccard.ngram_jaccard_join(odd.limit(0)).count() == 0


def test_licenses(docs, odd):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    both = docs.union(odd.select("doc_id", "text"))
    wanted = []
    for doc, text in both.collect():
        words = word.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        at = [(i, lab) for p, lab in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        wanted.append((doc or -1, len(words), len(at), min((a for a, _ in at), default=-1), max((a for a, _ in at), default=-1), ",".join(sorted({lab for _, lab in at}))))
    rows = license_scan.license_scan(both).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_base, -1 if r.first_word is None else r.first_word, -1 if r.last_word is None else r.last_word, r.base_labels) for r in rows) == sorted(wanted)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_licence_templates(spark):
    text = "Redistribution and use, in source and binary forms; GNU Lesser General Public License"
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.base_labels, row.labels) == ("gpl", "bsd,gpl,lgpl")


def test_licence_votes_of_every_alignment(spark):
    mit = "permission is hereby granted free of charge to any person getting a copy"
    texts = [mit, f"{mit} before obtaining more", f"obtaining {mit} obtaining " * 3, "permission is hereby granted to nobody, obtaining a copy", "granted hereby"]
    docs = spark.createDataFrame([*enumerate(texts), *((i, "other words") for i in range(10, 60))], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    idf = {w: np.log((len(rows) + 1) / (sum(w in t.split() for t in texts) + 1)) + 1e-3 for w in license_scan.vocabulary()}
    word = re.compile(r"[a-z]+")
    for i, text in enumerate(texts):
        shares = []
        words = word.findall(text)
        for _, template, key in license_scan.TEMPLATES:
            own, key, at = license_scan.searched(template, key), key.split(), template.split()
            first = next(j for j in range(len(at)) if at[j : j + len(key)] == key)
            rare = license_scan.index_words(own, idf, license_scan.LEAST)
            sums = {}
            for start in range(-len(at), len(words)):
                agree = [(w, j) for w, j in own if 0 <= start + j < len(words) and words[start + j] == w]
                if start + first >= 0 and words[start + first : start + first + len(key)] == key and set(agree) & set(rare):
                    sums[start] = sum(idf[w] for w, _ in agree)
            shares.append(max(sums.values(), default=0) / sum(idf[w] for w, _ in own))
        assert rows[i].score == pytest.approx(max(shares), abs=1e-8)
    assert [rows[i].labels for i in range(5)] == ["mit", "mit", "mit", "", ""] and rows[4].score == 0


def test_licence_clauses(spark):
    """Each clause alone gives its own label and none of another licence, also among other words; a word lost in the middle costs its votes only."""
    cases = [(f"before {t} after", lab) for lab, t, _ in license_scan.TEMPLATES]
    cases += [("Licensed under CC BY-NC 4.0", "cc-by"), ("licensed under terms", ""), ("Permission was granted to copy the software and to merge", "")]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in enumerate(cases)), *((i, "other words of this text") for i in range(100, 200))], "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(docs).collect()}
    for i, (text, label) in enumerate(cases):
        also = {"gpl"} if "general public license" in text else set()  # its base phrase is part of the names of its kin
        assert set(got[i]) == {label} | also, text


def test_pii(odd, docs):
    rows = pii.pii_spans(docs.union(odd.select("doc_id", "text"))).collect()
    assert len(rows) == docs.count() + 9
    row = next(r for r in rows if r.doc_id == 7 and r.n_card)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1)
    base = pii.base_spans(odd.where("doc_id = 7").first().text)
    assert row.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
    assert set(pii.written(base).split(",")) <= set(row.spans.split(","))


def test_warc(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    pages = pages.unionByName(spark.createDataFrame([(9001, None, None), (9002, "http://a b", "")], "page_id long, url string, html string"))
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    last = {}
    for p, h in html.items():
        last[h] = max(last.get(h, p), p)
    wanted = {p: (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if last[h] == p else "revisit", None if last[h] == p else last[h]) for p, h in html.items()}
    rows = warc.archived_pages(pages).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == wanted
    assert all(r.has_request and r.has_metadata for r in rows)


def test_chat(spark):
    rows = {r.conv_id: r for r in queries.op3_chat(spark, SF).collect()}
    turns = {-1: [("user", queries.CONTROL), ("assistant", queries.CONTROL)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert rows.keys() == turns.keys()
    for c, t in turns.items():
        learnt = "".join(x for role, x in t if role == "assistant")
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(t), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_streams_long_and_odd_conversations(spark):
    # One row per turn: no row grows with its conversation.
    n, big = 5000, 2**60 + 1
    turns = [(None, i, "assistant" if i % 2 else "user", f"{i} </s> é") for i in range(n)]
    turns += [(big, 0, "user", "a"), (big, 0, "user", "a"), (big, None, None, None), (big + 1, 0, "user", "q"), (big + 1, 1, "assistant", None), (3, 0, "user", "only")]
    formatted = chat.formatted_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert formatted.count() == len(turns) and all(len(r.segments) == 3 for r in formatted.collect())
    rows = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    wanted = {None: [(r, t) for _, _, r, t in turns[:n]], big: [("", ""), ("user", "a"), ("user", "a")], big + 1: [("user", "q"), ("assistant", "")], 3: [("user", "only")]}
    assert rows.keys() == wanted.keys()
    for c, t in wanted.items():
        parts = list(chat.segments(t, chat.Template()))
        learnt = "".join(x for role, x in t if role == "assistant")
        error = chat.first_error([role for role, _ in t], chat.Template())
        assert rows[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (rows[c].n_turns, rows[c].loss_chars, rows[c].loss_sha256) == (len(t), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert rows[c].formatted_chars == sum(len(x) for x, _ in parts)
        assert (rows[c].valid, rows[c].first_error) == (error < 0, None if error < 0 else error)


def test_chat_escapes_round_trip():
    turns = [("user", "\\<s>[INST] a\\"), ("tool<|text|>", "<|end|>\\\\"), ("assistant", "</s>")]
    text = "".join(t for t, _ in chat.segments(turns, chat.Template()))
    assert [(a, b) for a, b, _ in chat.parsed(text, chat.Template())] == turns


def test_packing(docs, odd):
    from tokenizers import Tokenizer

    both = docs.union(odd.where("doc_id <> 6").select(F.col("doc_id") + 10_000, "text"))
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r.doc_id: np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4") for r in both.collect()}
    rows = packing.packed(both, queries.tokenizer_path()).collect()
    bins, seen = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    for d, x in ids.items():
        assert sum(n for _, _, n in seen[d]) == len(x) and len(seen[d]) == -(-len(x) // 1024)
    least = -(-sum(map(len, ids.values())) // 1024)
    assert len(bins) <= least * 1.01 + 1


def test_embeddings(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label")
    extra = [(9001, None, "a"), (9002, [0.0] * 4, "a"), (9003, [1.0, None, 0.0, 0.0], "a"), (9004, [1.0, 2.0, 3.0, 4.0], None), (9005, [1.0, 2.0, 3.0, 4.0], "zz"), (9006, [2.0, 4.0, 6.0, 8.0], "zz")]
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label")).union(spark.createDataFrame(extra, "vec_id long, embedding array<double>, label string"))
    good = {}
    for r in v.collect():
        x = None if r.embedding is None or None in r.embedding or r.label is None else np.array(r.embedding)
        good[r.vec_id] = None if x is None or not np.isfinite(x).all() or not x.any() else (r.label, x / np.linalg.norm(x))
    links = [(a, b) for a, b in combinations([i for i in good if good[i]], 2) if good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.93]
    wanted = components(good, links)
    n = {i: sum(i in p for p in links) for i in good}
    rows = embeddings.near_duplicate_vectors(v).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows} == {i: (n[i], wanted[i], wanted[i] == i) for i in good}


def planted_vectors(spark, each):
    """Real vectors under one label, each with a noisy copy at cosine 0.93 to 0.97 that differs in all components, in one half, or towards another vector: (rows, pairs)."""
    rng = np.random.default_rng(5)
    x = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").limit(each).collect()], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    h = x.shape[1] // 2
    z[1::4, :h], z[2::4, h:], z[3::4] = 0, 0, np.roll(x, 1, axis=0)[3::4]
    z -= (z * x).sum(1)[:, None] * x
    c = rng.uniform(0.9301, 0.97, len(x))[:, None]
    y = c * x + np.sqrt(1 - c**2) * z / np.linalg.norm(z, axis=1)[:, None]
    rows = [(i, [float(f) for f in v], "a") for i, v in enumerate(np.vstack([x, y]))]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), np.vstack([x, y])


def test_embedding_links_count_at_both_ends(spark, monkeypatch):
    # With small blocks and a lower target recall some links are found from one side only.
    monkeypatch.setattr(embeddings, "CHUNK", 4)
    v, x = planted_vectors(spark, 400)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    rows = {r.vec_id: r for r in embeddings.near_duplicate_vectors(v, recall=0.9).collect()}
    pairs = [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b and near[a].sum() == near[b].sum() == 1]
    assert len(pairs) > 300
    found = [(rows[a].n_links, rows[b].n_links, rows[a].component_id == rows[b].component_id) for a, b in pairs]
    assert set(found) <= {(0, 0, False), (1, 1, True)} and (1, 1, True) in found


def test_traversal_visits_cells_in_order():
    rng = np.random.default_rng(5)
    s1, s2 = (np.sort(rng.random((40, n)), 1) for n in (7, 9))
    s1[:, 0], s2[:, 0] = 0, 0
    s1[0], s2[0] = 0, 0  # ties everywhere
    for most in (-1.0, 0.0, 0.4, 9.0):
        n, a, b = embeddings.traversal(s1, s2, most)
        sums = s1[:, :, None] + s2[:, None, :]
        assert len(n) == (sums <= most).sum() == len(set(zip(n.tolist(), a.tolist(), b.tolist())))
        for i in range(40):
            seen = sums[i, a[n == i], b[n == i]]
            assert (np.diff(seen) >= 0).all() and (seen <= most).all()


def test_codebooks_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 1)
    v, _ = planted_vectors(spark, 150)
    rows = embeddings.near_duplicate_vectors(v, centroids=4).collect()
    assert sum(r.n_links >= 1 for r in rows) >= 0.99 * len(rows)


def test_embedding_recall(spark):
    v, x = planted_vectors(spark, 500)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    rows = {r.vec_id: r for r in embeddings.near_duplicate_vectors(v).collect()}
    found, wanted = sum(r.n_links for r in rows.values()), int(near.sum())
    print(f"recall {found} of {wanted} ends of links")
    assert all(r.n_links <= near[i].sum() for i, r in rows.items())
    assert wanted >= 900 and found >= 0.99 * wanted


def test_urls(spark):
    rows = [(1, "http://A.example.org/es/x?y", None), (2, "https://example.org/en/12", ""), (3, "http://x.com/fr/", None), (4, "x.com/de/", None), (5, None, None), (6, "ftp://example.com/de/1#z", None), (7, "http://b.org", None)]
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert out[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[3] == ("x.com", "/fr/", "com/fr/", "allow")
    assert out[4][:3] == ("", "", None) and out[5][:3] == ("", "", None)
    assert out[6] == ("example.com", "/de/1", "com/de/", "block")


def test_url_scores(spark):
    # Blocked and undecided pages under one domain, and a ring of links that a blocked host belongs to.
    rows = [(1, "http://a.example.com/de/1", None), (2, "http://b.example.com/x", None), (3, "http://example.com/x", None), (4, "http://sub.c.com/x", None), (5, "http://c.com/de/1", None)]
    ring = [f"h{i}.net" for i in range(12)]
    rows += [(10 + i, f"http://{h}/x", f"<a href='http://{ring[(i + 1) % 12]}/y'>") for i, h in enumerate(ring)] + [(40, "http://h0.net.com/de/", '<a href="//h3.net/">')]
    rows += [(41, "http://h5.net/y", "<a href=http://h0.net.com/>")]
    got = {r.host: (r.verdict, r.host_score) for r in url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), damping=0.6).where("rule is null").collect()}
    assert got["b.example.com"] == ("allow", 0.0) and got["example.com"] == ("allow", 0.0)
    assert got["sub.c.com"][0] == "block" and got["sub.c.com"][1] < 0
    # Distrust by a dense solution: all seeds are 1; links are walked backwards, parents down.
    edges = [(ring[(i + 1) % 12], h) for i, h in enumerate(ring)] + [("h0.net.com", "h5.net"), ("h3.net", "h0.net.com"), ("c.com", "sub.c.com"), ("example.com", "a.example.com"), ("example.com", "b.example.com")]
    edges += [("net.com", "h0.net.com")]
    hosts = sorted({x for e in edges for x in e})
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        m[hosts.index(b), hosts.index(a)] = 1 / sum(e[0] == a for e in edges)
    seed = np.array([h in ("a.example.com", "c.com", "h0.net.com") for h in hosts], float)
    exact = dict(zip(hosts, np.linalg.solve(np.eye(len(hosts)) - 0.6 * m, 0.4 * seed)))
    assert all(score == pytest.approx(-exact[h], abs=1e-8) for h, (_, score) in got.items())


def test_decontamination(spark):
    item = " ".join(f"word{i}" for i in range(40))
    near = item.replace("word39", "other")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, f"x {near} y"), (3, "nothing here"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(5, item), (6, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated_windows(docs, bench).collect()} == {(1, 5), (2, 5)}
    assert {r.doc_id for r in decontamination.decontaminate(docs, bench).collect()} == {3, 4}


def test_toxicity_held_out(spark):
    scored = queries.op9_toxicity(spark, SF.replace("sf0.01", "sf0.1"))
    labels = spark.read.parquet(SF.replace("sf0.01", "sf0.1") + "/labels.parquet")
    r = scored.join(labels, "doc_id").where("held_out").agg(*(F.expr(f"count_if({c})") for c in ("predicted = 1 and toxic = 1", "toxic = 1", "predicted = 1 and toxic = 0", "toxic = 0"))).first()
    assert r[0] >= 0.8 * r[1] and r[2] <= 0.05 * r[3], tuple(r)
    assert Path(SF).exists()
