"""Queries on tables with more nodes than the given ones: ids beyond a smallint, values at a limit, shared series."""

import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from meshcast import queries
from meshcast.operators import grid, quality, stats
from meshcast.plans import curation, fixtures

SF = "/root/testdata/sf0.001"
HOURS = [datetime(2020, 1, 1, h) for h in range(6)]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """sf0.001 with suppliers from 40,000."""
    folder = tmp_path_factory.mktemp("far")
    for table, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")):
        spark.read.parquet(f"{SF}/{table}.parquet").withColumn(key, F.col(key) + 40000).write.parquet(f"{folder}/{table}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def beside(spark, tmp_path_factory):
    """Suppliers from 9,990, so that the added node's id is taken."""
    folder = tmp_path_factory.mktemp("beside")
    spark.read.parquet(f"{SF}/supplier.parquet").withColumn("s_suppkey", F.col("s_suppkey") + 9990).union(spark.read.parquet(f"{SF}/supplier.parquet")).write.parquet(f"{folder}/supplier.parquet")
    return str(folder)


def asked(name, folder, *tables):
    """The query's SQL in DuckDB."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in {"lineitem", "supplier", "customer", "events"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder if t in tables else SF}/{t}.parquet{'/*.parquet' if t in tables else ''}'")
    return con.execute(queries.ORACLE_SQL[name])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_consolidated_ids_beyond_smallint(spark, far):
    found = queries.QUERIES["dq03_consolidated"](spark, far)
    stored = fixtures.view(spark, far, "obs").withColumn("datetime", F.make_timestamp_ntz("year", "month", "day", "hour", F.lit(0), F.lit(0))).select(*found.columns)
    assert found.agg(F.min("nodo_id")).first()[0] == 40000 and rows(found) == rows(stored)


def test_master_ids_beyond_smallint(spark, far):
    found = queries.QUERIES["dq05_master"](spark, far)
    nodes = fixtures.view(spark, far, "nodos")
    assert found.count() == 24 * nodes.count() and rows(found.select("nodo_id").distinct()) == rows(nodes.select("nodo_id"))


def test_gate_counts_ids_beyond_smallint(spark, far):
    gate, obs = queries.QUERIES["dq05_master_gate"](spark, far).first(), fixtures.view(spark, far, "obs")
    assert (gate.rows, gate.nodes) == (obs.count(), obs.select("nodo_id").distinct().count()) and gate.expected == 600 * gate.nodes


def test_class_is_that_of_the_rounded_mean(spark):
    values = [(1, 6.49999997e8, 1e9), (2, 6.4999999e8, 1e9), (3, 3.49999997e8, 1e9), (4, 3.5e8, 1e9), (5, 6.5e8, 1e9)]
    given = [(n, 1, 1, ghi, clear, 30.0) for n, ghi, clear in values]
    obs = spark.createDataFrame(given, "nodo_id int, month int, day int, ghi double, clearsky_ghi double, solar_zenith_angle double")
    con = duckdb.connect()
    con.execute("CREATE TABLE obs (nodo_id INT, month INT, day INT, ghi DOUBLE, clearsky_ghi DOUBLE, solar_zenith_angle DOUBLE)")
    con.executemany("INSERT INTO obs VALUES (?, ?, ?, ?, ?, ?)", given)
    wanted = con.execute(queries._days_sql("month, day, nodo_id")).fetchall()
    assert rows(stats.classify_days(obs, by_node=True)) == sorted(wanted, key=str)
    assert {r[2]: r[4] for r in wanted} == {1: "clear", 2: "partial", 3: "partial", 4: "partial", 5: "clear"}


def test_upsert_adds_a_row_whose_id_is_taken(spark, beside):
    found = queries.QUERIES["set05_upsert"](spark, beside)
    wanted = asked("set05_upsert", beside, "supplier")
    assert found.columns == [c[0] for c in wanted.description]
    wanted = wanted.fetchall()
    assert [r[0] for r in wanted].count(9999) == 2 and rows(found) == sorted(wanted, key=str)


def test_shared_series_are_compared_once(spark):
    rng = random.Random(3)
    nodes = [(n, float(n % 7), 0.0, rng.randrange(4)) for n in range(60)]
    shared = [(s, HOURS[h], float(h + (s == 1 and h == 3)), None if h == 2 else h) for s in range(3) for h in range(6 - (s == 2))] + [(2, HOURS[0], 0.0, 0)]
    facts = spark.createDataFrame(shared, "series int, datetime timestamp_ntz, v double, w int")
    at = spark.createDataFrame(nodes, "nodo_id int, lat_real double, lon_real double, series int")  # nobody has facts of series 3
    own = facts.join(at.select("nodo_id", "series"), "series").drop("series")
    for compare in (grid.differing_twins, grid.differing_cells):
        found = rows(compare(facts, at, ["v", "w"], "series"))
        assert found and found == rows(compare(own, at, ["v", "w"]))
    same = at.withColumn("series", F.lit(0))
    kept = curation.regridded(facts, same, ["v", "w"], "series")
    assert rows(kept) == rows(curation.regridded(facts.where("series = 0").join(same.select("nodo_id", "series"), "series").drop("series"), same, ["v", "w"]).select(*kept.columns))


@pytest.mark.parametrize("name", ["dq13_twins", "dq14_gate"])
def test_series_do_not_grow_with_nodes(spark, tmp_path, name):
    c = spark.read.parquet(f"{SF}/customer.parquet")
    c.union(c.withColumn("c_custkey", F.col("c_custkey") + c.count())).write.parquet(f"{tmp_path}/customer.parquet")
    wanted = asked(name, str(tmp_path), "customer").fetchall()
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert rows(queries.QUERIES[name](spark, str(tmp_path))) == sorted(wanted, key=str)
    o = fixtures.view(spark, str(tmp_path), "obs")
    assert queries._series(o, True).count() <= 3 * o.where("nodo_id BETWEEN 1 AND 100").count()


def test_hours_are_counted_in_hash_tables(spark):
    base, rng = datetime(1901, 5, 6, 7), random.Random(5)
    given = [(rng.choice([None, *range(9)]), rng.choice([None, *(base + timedelta(hours=rng.choice([h, h * 999]), microseconds=rng.choice([0, 0, 1, 3_599_999_999])) for h in range(300))])) for _ in range(2000)]
    obs = spark.createDataFrame(given * 2, "nodo_id int, datetime timestamp_ntz").withColumns({"month": F.month("datetime"), "day": F.dayofmonth("datetime"), "hour": F.hour("datetime")})
    assert quality.duplicate_count(obs).first().duplicates == 2 * len(given) - len(set(given))
    times = {r.nodo_id: (r.rows, r.times) for r in quality.node_completeness(obs).collect()}
    assert times == {n: (2 * len(own := [t for m, t in given if m == n]), len(set(own))) for n in {m for m, _ in given}}
    whole = quality.integrity_row(obs).first()
    assert (whole.rows, whole.duplicates, whole.nodes) == (2 * len(given), 2 * len(given) - len(set(given)), 9)
    # Bitmaps of years were sorted, 4 KB for each node, task and 32,768 hours, however few of them were there.
    for df in (quality.duplicate_count(obs), quality.node_completeness(obs), quality.integrity_row(obs)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in text and "SortAggregate" not in text and "bitmap" not in text
    full = spark.range(64 * 50).select(F.lit(1).alias("nodo_id"), F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(0, id)").alias("datetime"))
    assert quality.hours_of_nodes(full).count() <= 51


def test_sparse_series_share_groups(spark):
    # Both sides of 1970, every bit of every number; node 1 has all hours, node 2 one in each 64, node 3 each hour at two times, node 4 the last bit of each number.
    hours = spark.range(-1100, 1100).select(F.explode(F.sequence(F.lit(1), F.lit(4))).alias("nodo_id"), "id").where("CASE nodo_id WHEN 2 THEN id % 64 = 0 WHEN 4 THEN pmod(id, 64) = 63 ELSE true END")
    obs = hours.select("nodo_id", F.expr("timestamp_ntz'1970-01-01' + make_dt_interval(0, id)").alias("datetime"))
    obs = obs.union(obs.where("nodo_id = 3").withColumn("datetime", F.expr("datetime + INTERVAL '30' MINUTE"))).union(obs.where("nodo_id <> 4 AND hour(datetime) = 23"))
    wanted = {r.nodo_id: (r.n, r.times) for r in obs.groupBy("nodo_id").agg(F.count("*").alias("n"), F.count_distinct("datetime").alias("times")).collect()}
    assert {r.nodo_id: (r.rows, r.times) for r in quality.times_of_nodes(obs).collect()} == wanted and wanted[3][1] == 4400 and wanted[4] == (35, 35)
    assert quality.duplicate_count(obs).first().duplicates == sum(n - times for n, times in wanted.values()) > 0
    # Node 2 had a group for each of its 35 times.
    groups = {r.nodo_id: r["count"] for r in quality.hours_of_nodes(obs).groupBy("nodo_id").count().collect()}
    assert max(groups[n] for n in (1, 2, 4)) <= 6 and groups[3] <= 12
