"""Footers in one job; ingest over crashes, broken files and late columns."""

import shutil

import pytest

from meshcast.sources import files, footers
from meshcast.streaming import ingest


def node_file(spark, folder, node, year=2023, hours=5, more="", name=None):
    df = spark.range(hours).selectExpr(f"{year} AS year", "cast(id as int) AS hour", f"id * {node} AS ghi", *([more] if more else []))
    df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/.tmp")
    part = next((folder / ".tmp").glob("part*.parquet"))
    part.rename(folder / (name or f"nodo_{node}_{year}_v4.parquet"))
    shutil.rmtree(folder / ".tmp")


def cut_short(path):
    path.write_bytes(path.read_bytes()[:-20])


@pytest.fixture
def folder(tmp_path):
    out = tmp_path / "in"
    out.mkdir()
    return out


def test_footers(spark, folder):
    for n in (1, 2, 3):
        node_file(spark, folder, n, hours=n, more="1.5 AS late" if n == 3 else "")
    cut_short(folder / "nodo_2_2023_v4.parquet")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = footers.footers(spark, str(folder)).collect()
    assert len(set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)) <= 2
    good = {(r.file[-17], r.column, r.type, r.rows) for r in found if r.error is None}
    assert good == {(str(n), c, t, n) for n in (1, 3) for c, t in (("year", "int32"), ("hour", "int32"), ("ghi", "int64"))} | {("3", "late", "decimal128(2, 1)", 3)}
    assert [(r.file[-17], r.rows, r.column) for r in found if r.error] == [("2", None, None)]
    facts = footers.dataset_facts(spark, str(folder)).first()
    assert (facts.files, facts.unreadable, facts.rows, facts.row_groups) == (3, 1, 4, 2) and facts.bytes == sum(p.stat().st_size for p in folder.glob("*.parquet"))
    assert {(r.column, r.files) for r in footers.column_types(spark, str(folder)).collect()} == {("year", 2), ("hour", 2), ("ghi", 2), ("late", 1)}
    audit = files.schema_audit(spark, [str(p) for p in folder.glob("*.parquet")], ["year", "hour", "ghi", "dni"]).collect()
    assert sorted((r.file[-17], r.side) for r in audit) == [("1", "missing"), ("2", "unreadable"), ("3", "extra"), ("3", "missing")]
    (folder / "none").mkdir()
    assert footers.footers(spark, str(folder / "none")).count() == 0


def test_ingest_over_crashes_and_broken_files(spark, folder, tmp_path, monkeypatch):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: ingest.ingest_node_files(spark, str(folder), out, check)
    for n in (1, 2, 3):
        node_file(spark, folder, n)
    cut_short(folder / "nodo_2_2023_v4.parquet")
    node_file(spark, folder, 9, name="nodo_x.parquet")
    publish, calls = ingest.versions.publish, []

    def crashing(df, path, keys=()):
        version = publish(df, path, keys)
        calls.append(path)
        if path.endswith("/rows") and len(calls) == 1:
            raise RuntimeError("lost between write and commit")
        return version

    monkeypatch.setattr(ingest.versions, "publish", crashing)
    with pytest.raises(Exception, match="lost"):
        run()
    assert ingest.rows(spark, out).count() == 10 and ingest.ledger(spark, out).count() == 0
    run()
    assert ingest.rows(spark, out).count() == 10  # the batch has replaced its own rows
    assert sorted((r.nodo_id, r.year, r.rows) for r in ingest.ledger(spark, out).collect()) == [(1, 2023, 5), (3, 2023, 5)]
    aside = {r.file.rpartition("/")[2]: r.reason for r in ingest.set_aside(spark, out).collect()}
    assert set(aside) == {"nodo_2_2023_v4.parquet", "nodo_x.parquet"} and aside["nodo_x.parquet"].startswith("no node") and "Arrow" in aside["nodo_2_2023_v4.parquet"]
    run()
    assert ingest.rows(spark, out).count() == 10
    node_file(spark, folder, 2, name="nodo_2_2023_v5.parquet")
    node_file(spark, folder, 1, name="nodo_1_2023_v5.parquet")
    node_file(spark, folder, 4, more="2.5D AS late")
    run()
    table = ingest.rows(spark, out)
    assert table.count() == 20 and table.where("nodo_id = 4 and late = 2.5").count() == 5 and table.where("nodo_id < 4 and late is null").count() == 15
    assert "batch" in {r.file.rpartition("/")[2]: r.reason for r in ingest.set_aside(spark, out).collect()}["nodo_1_2023_v5.parquet"]
    assert sorted(r.nodo_id for r in ingest.ledger(spark, out).collect()) == [1, 2, 3, 4]
