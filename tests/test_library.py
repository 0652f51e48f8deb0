"""What SQL does not cover: files, streams, errors, traps of the data model and order."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meshcast import inventory, queries
from meshcast.functions import scalars as S
from meshcast.operators import filters, grid, quality, stats
from meshcast.plans import curation, fixtures
from meshcast.sources import files
from meshcast.streaming.ingest import ingest_new_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def obs(spark):
    return fixtures.view(spark, SF, "obs").cache()


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_inventory_names_registered_queries():
    assert all(n == "tests" or n in queries.QUERIES for names in inventory.BY_ID.values() for n in names.split())


# Sources and sinks
def node_folder(spark, folder, nodes=(3, 11), hours=24):
    for n in nodes:
        rows = [(2023, 1, 1, h, 30, 10 * h, float(n)) for h in range(hours)]
        df = table(spark, rows, "Year int, Month int, Day int, Hour int, Minute int, GHI int, `Global Horizontal UV Irradiance (280-400nm)` double")
        df.coalesce(1).write.parquet(f"{folder}/tmp{n}")
        part = next((folder / f"tmp{n}").glob("part*.parquet"))
        part.rename(folder / f"nodo_{n}_2023_v4.parquet")
    return folder


def test_year_from_node_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    gate = curation.consolidate_year(spark, str(node_folder(spark, folder)), str(tmp_path / "out"), hours=24, partitions=2).first()
    assert (gate.rows, gate.nodes, gate.expected, gate.complete) == (48, 2, 48, True)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.columns[:2] == ["nodo_id", "datetime"] and "minute" not in out.columns and "ghi_uv_280_400" in out.columns
    assert dict(out.dtypes)["nodo_id"] == "smallint"
    parts = [[(r.nodo_id, r.datetime) for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "out").glob("*.parquet"))]
    assert all(p == sorted(p) for p in parts)
    info = files.dataset_info(spark.read.parquet(str(tmp_path / "out"))).first()
    assert info.rows == 48 and info.bytes > 0 and {c["column"] for c in info.columns} == set(out.columns)
    with pytest.raises(ValueError, match="48 rows"):
        curation.master(files.node_files(spark, str(folder)), nodes=3, hours=24)


def test_schema_audit_and_dimension(spark, tmp_path):
    table(spark, [(1, 2)], "a int, b int").write.parquet(str(tmp_path / "x"))
    table(spark, [(1, 2)], "a int, c int").write.parquet(str(tmp_path / "y"))
    found = files.schema_audit(spark, [str(tmp_path / "x"), str(tmp_path / "y")], ["a", "b"]).collect()
    assert sorted((r.file[-1], r.column, r.side) for r in found) == [("y", "b", "missing"), ("y", "c", "extra")]
    (tmp_path / "n.csv").write_text("nodo_id,latitude,longitude,msnm\n1,2.5,-3.5,\n")
    row = files.node_dimension(spark, str(tmp_path / "n.csv")).first()
    assert (row.nodo_id, row.latitude, row.msnm) == (1, 2.5, None)


def test_payloads(spark, tmp_path):
    (tmp_path / "p.csv").write_text("Source,Location ID,Latitude,Longitude,Elevation\nX,77,18.1,-66.2,12\nYear,Month,GHI,Cloud Type\n2023,1,5,3\n2023,2,,4\n")
    rows = files.payload_table(spark, str(tmp_path), "year int, month int, ghi double, cloud_type int").orderBy("month").collect()
    assert [(r.year, r.month, r.ghi, r.cloud_type) for r in rows] == [(2023, 1, 5.0, 3), (2023, 2, None, 4)]
    assert rows[0].header == {"location_id": "77", "latitude": "18.1", "longitude": "-66.2", "elevation": "12"}
    assert files.payload_table(spark, str(tmp_path), "year int", header="todos").first().header["source"] == "X"
    with pytest.raises(ValueError):
        files.payload_table(spark, str(tmp_path), "year int", header="other")


def test_export(spark, tmp_path, obs):
    files.export(obs, str(tmp_path / "a.csv"), decode=True, nodes=[1], columns=["nodo_id", "cloud_type", "fill_flag"])
    back = spark.read.csv(str(tmp_path / "a.csv"), header=True)
    assert back.columns == ["nodo_id", "cloud_type", "fill_flag", "cloud_label", "fill_label", "filled"]
    assert back.count() == obs.where("nodo_id = 1").count()
    files.export(obs.limit(3), str(tmp_path / "b"), fmt="parquet")
    with pytest.raises(ValueError):
        files.export(obs, str(tmp_path / "c.xlsx"))


def test_write_replacing(spark, tmp_path):
    path, old = str(tmp_path / "t"), str(tmp_path / "old")
    files.write_replacing(spark.range(3).toDF("a"), path)
    files.write_replacing(spark.read.parquet(path).selectExpr("a + 10 AS a"), path, history=old)
    assert sorted(r.a for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert spark.read.parquet(old).count() == 3
    files.write_replacing(spark.range(1).toDF("a"), path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["old", "t"]


def test_stream_reads_each_file_once(spark, tmp_path):
    for i in range(2):
        spark.range(i * 10, i * 10 + 5).write.mode("append").parquet(str(tmp_path / "in"))
        ingest_new_files(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "check"))
        assert spark.read.parquet(str(tmp_path / "out")).count() == 5 * (i + 1)


def test_pushdown_and_pruning(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").withColumnsRenamed({"l_suppkey": "nodo_id", "l_linenumber": "month"})
    plan = filters.filtered(rows, nodes=[3], months=[1, 2], columns=["nodo_id"])._jdf.queryExecution().executedPlan().toString()
    assert "In(l_linenumber, [1,2])" in plan and "EqualTo(l_suppkey,3)" in plan
    assert "ReadSchema: struct<l_suppkey:bigint,l_linenumber" in plan and "l_comment" not in plan


# Filters
def test_periods_and_checks(obs):
    for bad in ({"period": "monthly"}, {"period": "daily"}, {"period": "weekly"}):
        with pytest.raises(ValueError):
            filters.in_period(obs, **bad)
    with pytest.raises(ValueError, match="no rows"):
        filters.in_period(obs, "monthly", month=13)
    with pytest.raises(ValueError, match="variable"):
        filters.checked(obs, "nothing")
    with pytest.raises(ValueError, match="aggregate"):
        filters.checked(obs, "ghi", "mode")
    with pytest.raises(ValueError):
        filters.on_days(obs, "March 3")


def test_sample_is_reproducible(spark):
    nodes = spark.range(100).toDF("nodo_id")
    a, b = ([r.nodo_id for r in filters.sample_nodes(nodes.repartition(p), 10).collect()] for p in (1, 7))
    assert a == b and len(set(a)) == 10 and a != sorted(a)


def test_polygon_of_many_edges(spark):
    n = 5000
    ring = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    edges = [(*ring[i], *ring[(i + 1) % n]) for i in range(n)]
    points = table(spark, [(0.0, 0.0), (0.7, 0.7), (0.71, 0.71), (2.0, 0.0)], "longitude double, latitude double")
    assert sorted((r.longitude, r.latitude) for r in filters.in_polygon(points, edges).collect()) == [(0.0, 0.0), (0.7, 0.7)]
    assert filters.in_polygon(points, []).count() == 0


# Traps
def test_clearness_is_null_at_night(spark):
    rows = table(spark, [(5.0, 10.0), (0.0, 0.0), (3.0, -1.0)], "ghi double, clearsky_ghi double")
    assert [r[0] for r in rows.select(S.clearness()).collect()] == [0.5, None, None]
    assert rows.agg(F.avg(S.clearness())).first()[0] == 0.5


def test_zero_base_gives_no_percentage(spark):
    rows = table(spark, [(1, 1, 2000, 0.0), (1, 1, 2001, 5.0)], "nodo_id int, month int, year int, ghi double")
    row = stats.compare_years(rows, "ghi", (2000, 2001)).first()
    assert (row.delta, row.delta_pct) == (5.0, None)


def test_range_ends_at_midnight(spark):
    rows = table(spark, [(datetime(2020, 1, 2, h),) for h in (0, 1)], "datetime timestamp_ntz")
    assert filters.filtered(rows, between=("2020-01-01", "2020-01-02")).count() == 1


def test_wind_bins_and_totals(spark):
    rows = table(spark, [(1, 0.0, 0.0), (1, 2.0, 355.0), (1, None, 90.0), (1, 2.1, -90.0)], "month int, wind_speed double, wind_direction double")
    rose = {(r.sector, r.speed_bin): r.pct for r in stats.wind_rose(rows).collect()}
    assert len(rose) == 16 * 6 and rose[(0, 0)] == 25.0 and rose[(12, 1)] == 25.0 and sum(rose.values()) == 50.0
    assert stats.wind_rose(rows.limit(0)).count() == 0


def test_quantiles_deviations_and_sums(spark):
    rows = table(spark, [(1, float(v)) for v in (1, 2, 3, 10)] + [(2, None)], "nodo_id int, ghi double")
    row = stats.describe(rows, ["ghi"], percentiles=(0.25,)).first()
    assert (row.p25, row.nulls, row.null_pct) == (1.75, 1, 20.0)
    assert stats.node_summary(rows, "ghi", aggs=("sum", "std")).where("nodo_id = 2").first()[1:] == (0.0, None)
    assert stats.describe(rows, ["ghi"], percentiles=(0.5,), accuracy=1000).first().p50 == 2.0


def test_histogram_ends(spark):
    h = stats.histogram(table(spark, [(float(v),) for v in (1, 2, 3, 4)], "v double"), "v", 3).orderBy("bin").collect()
    assert [r.n for r in h] == [1, 1, 2]
    one = stats.histogram(table(spark, [(2.0,), (2.0,)], "v double"), "v", 2).orderBy("bin").collect()
    assert [(r.low, r.high, r.n) for r in one] == [(1.5, 2.0, 0), (2.0, 2.5, 2)]
    assert stats.histogram(table(spark, [(None,)], "v double"), "v").count() == 0


def test_mode_of_equals_is_the_smallest(spark):
    rows = table(spark, [(1, datetime(2020, 1, 1, 3, m), 1.0, c) for m, c in ((0, 7), (10, 2), (20, 7), (30, 2))], "nodo_id int, ts timestamp_ntz, value double, code int")
    assert stats.hourly(rows).first().mode == 2


def test_golden_values(spark):
    one = spark.range(1)
    snap = lambda v, o: one.select(S.snapped(F.lit(v), o, 0.04)).first()[0]
    assert [snap(v, 0.01) for v in (22.38, 22.40, 17.66, 17.68)] == [22.37, 22.41, 17.65, 17.69]
    assert [snap(v, 0.02) for v in (-99.05, -99.03, -64.89, -67.93)] == [-99.06, -99.02, -64.90, -67.94]
    pressure = [round(one.select(S.surface_pressure(F.lit(float(h)))).first()[0], 3) for h in (0, 500, 1000, 2000, 3000)]
    assert pressure == [1013.25, 954.608, 898.746, 794.952, 701.085]
    hours = [one.select(S.hours_in_year(F.lit(y), leap)).first()[0] for y, leap in ((2023, True), (2024, True), (2024, False))]
    assert hours == [8760, 8784, 8760]
    bins = [one.select(S.banded(F.lit(v).cast("double"), (0, 2, 4, 6, 8, 10, float("inf")))).first()[0] for v in (0.0, 0.5, 2.0, 2.1, 12.0, None)]
    assert bins == [None, 0, 0, 1, 5, None]


def test_strict_and_lenient_types(spark):
    raw = table(spark, [(40000, 2020, 1, 1, 0)], "nodo_id int, year int, month int, day int, hour int")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        curation.consolidated(raw).collect()
    assert curation.consolidated(raw, lenient=True).first().nodo_id is None
    with pytest.raises(Exception):
        curation.consolidated(raw.withColumn("day", F.lit(31)).withColumn("month", F.lit(2)).withColumn("nodo_id", F.lit(1))).collect()


# Grid and curation
def test_cells_conserve_nodes(spark):
    nodes = grid.snap_nodes(fixtures.view(spark, SF, "solicitados"))
    m = grid.multiplicity(nodes).agg(F.sum(F.col("nodes_in_cell") * F.col("cells"))).first()[0]
    assert m == nodes.count()
    ids = grid.id_map(nodes).select("representative", "new_id").distinct().collect()
    assert sorted(r.new_id for r in ids) == list(range(len(ids)))


def test_reconstruction_validates_itself(spark):
    asked = table(spark, [(1, 22.38, -99.05), (2, 22.371, -99.061)], "nodo_id int, lat_local double, lon_local double")
    good = table(spark, [(1, 22.37, -99.06)], "nodo_id int, lat_nrel double, lon_nrel double")
    rows = curation.reconstructed(asked, good).orderBy("nodo_id").collect()
    assert [(r.celda_id, r.is_duplicate) for r in rows] == [(0, False), (0, True)]
    with pytest.raises(ValueError, match="1 of 1"):
        curation.reconstructed(asked, good.withColumn("lat_nrel", F.lit(23.0)))


def test_regrid_stops_at_differing_nodes(spark):
    nodes = table(spark, [(1, 1.0, 1.0), (2, 1.0, 1.0)], "nodo_id int, lat_real double, lon_real double")
    facts = table(spark, [(1, datetime(2020, 1, 1), 1.0), (2, datetime(2020, 1, 1), 2.0)], "nodo_id int, datetime timestamp_ntz, v double")
    with pytest.raises(ValueError, match="differ"):
        curation.regridded(facts, nodes, ["v"])


def test_empty_tables(spark, obs):
    none = obs.limit(0)
    nodes = fixtures.view(spark, SF, "nodos").limit(0)
    assert grid.elevation_summary(nodes).first().candidate_pct is None
    assert quality.integrity_row(none, nodes).first().rows == 0
    assert stats.duration_curve(none, "ghi").count() == 0 and stats.outlier_nodes(none, "ghi").count() == 0
    assert stats.outlier_nodes(none, "ghi", "iqr").count() == 0 and quality.incomplete_nodes(none).count() == 0
    assert filters.near_focus(nodes, (1,), 0.1).count() == 0


def test_mask_of_fused_day_is_fused_daylight(obs):
    extra = fixtures.complement(obs)
    a = curation.fused(filters.daylight_mask(obs), extra)
    b = filters.daylight_mask(curation.fused(obs, extra))
    assert a.count() == b.count() > 0 and a.exceptAll(b.select(*a.columns)).count() == 0


def test_ordered_results(spark, obs):
    days = [(r.month, r.day) for r in stats.classify_days(obs).collect()]
    assert days == sorted(days)
    flags = [(r.flag, r.code) for r in stats.flag_distribution(obs).collect()]
    assert flags == sorted(flags)
    nodes = fixtures.view(spark, SF, "nodos")
    up = [r.nodo_id for r in grid.upserted(nodes, nodes.where("nodo_id = 5")).collect()]
    assert up == sorted(up)


def test_report_holds_what_exists(spark, obs):
    nodes = fixtures.view(spark, SF, "nodos")
    assert set(curation.report(obs, nodes)) == {"info", "integrity", "histogram", "profile", "pivot", "resource", "correlations", "rose"}
    assert set(curation.report(obs.drop("ghi", "wind_speed", "temperature", "dni", "pressure", "relative_humidity", "clearsky_ghi"), nodes)) == {"info", "integrity"}
