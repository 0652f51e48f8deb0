"""Stages of the corpus pipeline on a small table."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    extra = base.limit(3).withColumn("doc_id", F.lit(None).cast("long")).union(base.limit(2)).union(base.limit(1).withColumn("text", F.lit(None).cast("string")))
    return base.union(extra).withColumn("row", F.lit(1)).withColumn("score", F.lit("x")).withColumn("predicted", F.lit(1)).withColumn("own", F.lit(0)).cache()


def sets(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_one_of_each_group_stays(spark, docs):
    rows = docs.collect()
    own = [sets(r.text) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append((r.doc_id is None, r.doc_id or 0))
    kept = P.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted(min(g) for g in groups.values())


def test_filters_keep_columns_and_clean_documents(spark, docs):
    toxic = P.toxicity(spark, docs, SF)
    assert toxic.columns == docs.columns and 0.7 * docs.count() <= toxic.count() <= docs.count()
    clean = P.decontamination(spark, docs, SF)
    items = [sets(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [sets(r.text) for r in clean.collect()]
    assert clean.columns == docs.columns and len(left) < docs.count()
    assert not any(len(i & d) == len(i) for i in items for d in left if len(i) > 5)
    redacted = P.personal_data(spark, docs, SF)
    assert redacted.columns == docs.columns and redacted.count() == docs.count()
    assert redacted.where("n_chars <> length(text)").count() == 0


def test_whole_run(spark):
    rows = P.run(spark, SF).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert rows and max(ends.values()) <= 1024
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("stage", ["near_duplicates", "decontamination", "personal_data"])
def test_columns_of_any_name_stay(spark, stage):
    odd = ["a.b", "with space", "tick`s", "row", "x.y.z"]
    rows = [(1, "one text of some words and more of them", 39, 1, "p", None, 2, 3.0), (1, "one text of some words and more of them", 39, 1, "p", None, 2, 3.0), (None, None, None, None, None, "q", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `a.b` int, `with space` string, `tick``s` string, row int, `x.y.z` double")
    got = dict(P.STAGES)[stage](spark, docs, SF)
    assert got.columns == docs.columns == ["doc_id", "text", "n_chars", *odd]
    assert got.count() == (2 if stage == "near_duplicates" else 3)
    empty = dict(P.STAGES)[stage](spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.count() == 0
