"""Global orders by bands, bitmaps of hours, twins of cells and strict polygons: against plain Python, and their plans."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from meshcast.operators import filters, grid, order, quality
from meshcast.plans import curation, fixtures

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_in_any_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(40)]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "a string, b int, band long").repartition(5)
    found = {r.band: r.place for r in order.numbered(df, "a", -F.col("b"), "band", name="place", bands=16).collect()}
    first = lambda r: (r[0] is not None, r[0] or "", r[1] is not None, -(r[1] or 0), r[2])
    assert found == {r[2]: n for n, r in enumerate(sorted(rows, key=first))}
    again = order.numbered(df.drop("band").where("a = 'a'"), "a", name="b", bands=16)  # all keys equal, and the name is taken
    assert again.columns == ["a", "b"] and sorted(r.b for r in again.collect()) == list(range(sum(r[0] == "a" for r in rows)))
    assert order.numbered(df.limit(0), "a").count() == 0
    few = order.numbered(df.where("band < 3"), "band", name="n", bands=64).orderBy("band").collect()
    assert [r.n for r in few] == [0, 1, 2]


def test_predecessors_cross_bands(spark):
    df = spark.range(0, 3000, 3).selectExpr("id * 1.5 AS v", "id AS border").repartition(7)
    rows = order.preceded(df, "v", bands=32).orderBy("v").collect()
    assert [r.previous for r in rows] == [None, *(r.v for r in rows[:-1])] and [r.border for r in rows] == list(range(0, 3000, 3))


def test_only_band_counts_meet_in_one_task(spark):
    text = plan(order.numbered(spark.range(5000), "id"))
    assert text.count("Window") and "SinglePartition" in text
    single = [i for i, line in enumerate(text.splitlines()) if "Exchange SinglePartition" in line]
    assert len(single) == 1 and any("HashAggregate" in line and "count(1)" in line for line in text.splitlines()[single[0] + 1 : single[0] + 4])


def test_bitmaps_of_hours(spark):
    base, rng = datetime(1969, 12, 30), random.Random(2)
    times = [base + timedelta(hours=rng.randrange(0, 90_000), minutes=rng.choice([0, 0, 30])) for _ in range(900)]
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *times[:200], *times])) for _ in range(3000)]
    df = spark.createDataFrame(rows, "nodo_id int, datetime timestamp_ntz")
    df = df.withColumns({"month": F.month("datetime"), "day": F.dayofmonth("datetime"), "hour": F.hour("datetime")})
    keys, days = set(rows), {(t.month, t.day) for _, t in rows if t}
    assert quality.duplicate_count(df).first().duplicates == len(rows) - len(keys)
    hours = {t.hour for _, t in rows if t}
    row = quality.completeness(df).first()
    assert (row.rows, row.nodes, row.days, row.hours) == (len(rows), 3, len(days), len(hours))
    whole = quality.integrity_row(df).first()
    assert (whole.rows, whole.duplicates, whole.days, whole.hours, whole.nodes, whole.nulls_datetime) == (len(rows), len(rows) - len(keys), len(days), len(hours), 3, sum(t is None for _, t in rows))
    for r in quality.node_completeness(df).collect():
        own = [t for n, t in rows if n == r.nodo_id]
        assert (r.rows, r.times, r.surplus) == (len(own), len(set(own)), len(own) - len(set(own)))
    assert quality.node_completeness(df.limit(0)).count() == 0


def test_rows_are_not_shuffled_for_completeness(spark):
    obs = fixtures.view(spark, SF, "obs")
    buckets = quality.times_of_nodes(obs).count()
    years = obs.select("nodo_id", F.year("datetime")).distinct().count()
    assert buckets <= years < obs.count() / 5
    for df, keys in ((quality.completeness(obs), "nodo_id"), (quality.duplicate_count(obs), "nodo_id, bucket")):
        text = plan(df)
        exchanges = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
        assert len(exchanges) == 1 and all(k.strip() in exchanges[0] for k in keys.split(","))


NODES = "nodo_id int, lat_real double, lon_real double"
HOURS = [datetime(2020, 1, 1, h) for h in range(6)]


def test_twins(spark):
    nodes = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 1.0), (4, 1.0, 1.0), (5, 2.0, 2.0), (6, 2.0, 2.0), (7, 3.0, 3.0)], NODES)
    base = [(h, float(i), None if i == 2 else i) for i, h in enumerate(HOURS)]
    rows = [(1, *r) for r in base] + [(2, *r) for r in reversed(base)] + [(3, *r) for r in base[:-1]] + [(4, h, v, w) if h != HOURS[2] else (4, h, None, 2) for h, v, w in base] + [(5, *r) for r in base] * 2 + [(6, *r) for r in base] + [(7, *base[0])]
    facts = spark.createDataFrame(rows, "nodo_id int, datetime timestamp_ntz, v double, w int")
    assert sorted((r.nodo_id, r.twin) for r in grid.differing_twins(facts, nodes, ["v", "w"]).collect()) == [(1, 3), (1, 4), (5, 6)]
    found = sorted((r.twin, r.datetime, r.kind) for r in grid.differing_cells(facts, nodes, ["v", "w"]).collect())
    assert found == [(3, HOURS[5], "lacking"), (4, HOURS[2], "different"), *((6, h, "lacking") for h in HOURS)]
    with pytest.raises(ValueError, match=r"nodes 1 and 3 of cell \(1.0, 1.0\) differ at 2020-01-01 05:00:00: lacking"):
        curation.regridded(facts, nodes, ["v", "w"])
    with pytest.raises(ValueError, match="nodes 1 and 2"):  # a node without any rows
        curation.regridded(facts.where("nodo_id = 1"), nodes.where("nodo_id < 3"), ["v", "w"])
    same = curation.regridded(facts.where("nodo_id < 3"), nodes.where("nodo_id < 3"), ["v", "w"])
    assert sorted((r.nodo_id, r.datetime) for r in same.collect()) == [(0, h) for h in HOURS]
    text = plan(grid.differing_twins(facts, nodes, ["v", "w"]))
    assert "datetime" not in "".join(line for line in text.splitlines() if "Exchange hashpartitioning" in line)


def points(spark, rows):
    return spark.createDataFrame(rows, "longitude double, latitude double")


def test_border_points_are_outside(spark):
    square = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    border = [(x / 4, y) for x in range(5) for y in (0.0, 1.0)] + [(x, y / 4) for x in (0.0, 1.0) for y in range(5)]
    found = filters.in_polygon(points(spark, [*border, (0.5, 0.5), (1e-9, 0.5), (2.0, 0.5), (None, 0.5), (0.5, None)]), square)
    assert sorted((r.longitude, r.latitude) for r in found.collect()) == [(1e-9, 0.5), (0.5, 0.5)]
    kite = [(0, 0, 2, 1), (2, 1, 0, 2), (0, 2, -2, 1), (-2, 1, 0, 0)]
    found = filters.in_polygon(points(spark, [(1.0, 0.5), (1.0, 1.5), (-1.0, 0.5), (2.0, 1.0), (-2.0, 1.0), (0.0, 1.0), (1.99, 1.0), (0.6, 0.3), (0.3, 0.15)]), kite)
    assert sorted((r.longitude, r.latitude) for r in found.collect()) == [(0.0, 1.0), (1.99, 1.0)]


def test_points_meet_their_band_only(spark):
    n = 5000
    ring = [(math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)) for i in range(n)]
    edges = [(*ring[i], *ring[(i + 1) % n]) for i in range(n)]
    low, height, bands, index = filters.edge_bands(edges)
    assert max(len(e) for _, e in index) < 100 and sum(len(e) for _, e in index) <= 8 * n and bands > 1000
    tall = [(i / 10, 0.0, i / 10 + 0.05, 1.0) for i in range(500)]
    assert sum(len(e) for _, e in filters.edge_bands(tall)[3]) <= 8 * len(tall)
    assert filters.edge_bands([(0, 1.0, 2, 1.0)])[1:3] == (1.0, 1)


def test_winding_agrees(spark):
    rng = random.Random(4)
    ring = [((3 + (i % 2)) * math.cos(i * 0.37), (3 + (i % 3)) * math.sin(i * 0.37)) for i in range(17)]
    edges = [(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]])]
    spots = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(2000)]
    crossed = lambda x, y: sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in edges) % 2
    assert {tuple(r) for r in filters.in_polygon(points(spark, spots), edges).collect()} == {p for p in spots if crossed(*p)}


def test_time_axis_and_grid(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "nodo_id int")
    steps = spark.createDataFrame([(h,) for h in HOURS] * 2, "ts timestamp_ntz")
    axis = grid.time_axis(nodes, steps)
    assert sorted(tuple(r) for r in axis.collect()) == [(n, h) for n in (1, 2) for h in HOURS] and "collect_set" not in plan(axis)
    none = spark.createDataFrame([], "nodo_id int, latitude double, longitude double")
    assert curation.grid_over(none, 0.04).count() == 0
    one = spark.createDataFrame([(1, 1.0, 2.0)], "nodo_id int, latitude double, longitude double")
    assert [tuple(r) for r in curation.grid_over(one, 0.5, margin=0.5).orderBy("nodo_id").collect()][:2] == [(0, 0.5, 1.5), (1, 0.5, 2.0)]
