"""Partitions are pruned; buckets by node spare exchanges."""

import pytest
from pyspark.sql import functions as F

from meshcast.operators import stats
from meshcast.plans import curation, fixtures
from meshcast.sources import layout

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    obs = fixtures.view(spark, SF, "obs").withColumn("region", F.when(F.col("nodo_id") % 2 == 0, "even").otherwise("odd"))
    layout.write_bucketed(obs, "layout_obs", str(where / "obs"), buckets=4)
    extra = fixtures.complement(fixtures.view(spark, SF, "obs"))
    layout.write_bucketed(extra, "layout_extra", str(where / "extra"), buckets=4, partitions=())
    yield spark.table("layout_obs"), spark.table("layout_extra"), obs, extra, where
    for t in ("layout_obs", "layout_extra", "layout_again"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_same_rows_and_few_files(tables):
    stored, _, obs, _, where = tables
    assert stored.select(*obs.columns).exceptAll(obs).isEmpty() and stored.count() == obs.count()
    folders = {p.parent for p in (where / "obs").rglob("*.parquet")}
    assert {p.parent.name for p in folders} == {"region=even", "region=odd"}
    assert all(len(list(f.glob("*.parquet"))) <= 4 for f in folders)


def test_partitions_are_pruned(tables):
    some = tables[0].where("region = 'even' AND year = 1996")
    text = plan(some)
    assert "PartitionFilters: [isnotnull(region" in text and "(region#" in text and "1996" in text.split("PartitionFilters")[1].split("]")[0]
    assert len(some.inputFiles()) <= 4 < len(tables[0].inputFiles())


def test_aggregates_by_node_need_no_exchange(tables):
    stored = tables[0]
    for df in (stats.node_summary(stored, "ghi"), stats.daily_sums(stored, "ghi").groupBy("nodo_id").agg(F.avg("total").alias("m")), stats.resample(stored, "ghi", by_node=True)):
        assert "Exchange" not in plan(df) and df.count() > 0
    a = {tuple(r) for r in stats.daily_sums(stored, "ghi").collect()}
    assert a == {tuple(r) for r in stats.daily_sums(tables[2], "ghi").collect()}


def test_fusion_needs_no_exchange(spark, tables):
    stored, more, obs, extra, _ = tables
    with layout.colocated(spark):
        fused = curation.fused(stored, more)
        text = plan(fused)
        assert "Join" in text and "Exchange" not in text
        rows = fused.count()
    assert rows == curation.fused(obs, extra).count() > 0
    assert "Exchange" in plan(curation.fused(obs, extra))
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_opened_in_another_session(spark, tables):
    stored, *_, where = tables
    again = layout.open_bucketed(spark, "layout_again", str(where / "obs"), stored.schema, buckets=4)
    assert again.count() == stored.count() and "Exchange" not in plan(stats.node_summary(again, "ghi"))


def test_only_written_partitions_are_replaced(spark, tables, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "nodo_id int, datetime timestamp_ntz, region string, year int, v int")
    path = str(tmp_path / "t")
    layout.write_bucketed(rows((1, None, "a", 1, 1), (2, None, "b", 1, 2)), "layout_parts", path, buckets=2)
    try:
        layout.replace_partitions(rows((3, None, "b", 1, 30)), "layout_parts", buckets=2)
        assert sorted(r.v for r in spark.table("layout_parts").collect()) == [1, 30]
    finally:
        spark.sql("DROP TABLE layout_parts")
