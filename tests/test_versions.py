"""Tables in parts: readers during replaces, writers that die, two writers, gates."""

import threading

import pytest
from pyspark.sql import functions as F

from meshcast.plans import curation
from meshcast.sources import versions as V


def values(df):
    return sorted(r.a for r in df.collect())


def test_replace_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    assert V.parts(spark, path) == []
    with pytest.raises(FileNotFoundError):
        V.current(spark, path)
    assert V.publish(spark.range(3).toDF("a"), path) == 1
    old = V.current(spark, path)
    assert V.publish(V.current(spark, path).selectExpr("a + 10 AS a"), path) == 2
    assert values(V.current(spark, path)) == [10, 11, 12] and values(old) == [0, 1, 2]  # begun readers keep their version
    V.publish(spark.range(1).toDF("a"), path)
    assert V.tidy(spark, path, keep=1, older_than=0) == 2 and values(V.current(spark, path)) == [0]


def test_readers_never_fail(spark, tmp_path):
    path, stop, seen, failed = str(tmp_path / "t"), threading.Event(), set(), []
    V.publish(spark.range(40).selectExpr("0 AS a"), path)

    def read():
        while not stop.is_set():
            try:
                rows = {(r.a, r.n) for r in V.current(spark, path).groupBy("a").agg(F.count("*").alias("n")).collect()}
                assert len(rows) == 1 and rows.pop()[1] == 40
                seen.add(1)
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 8):
        V.publish(spark.range(40).selectExpr(f"{i} AS a"), path)
    stop.set()
    reader.join()
    assert not failed and seen


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.publish(spark.range(2).toDF("a"), path)
    with pytest.raises(Exception, match="boom"):
        V.publish(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).alias("a")), path)
    monkeypatch.setattr(V._Folder, "create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):  # killed between write and publication
        V.publish(spark.range(9).toDF("a"), path)
    monkeypatch.undo()
    assert values(V.current(spark, path)) == [0, 1]
    assert V.tidy(spark, path, older_than=0) >= 1 and values(V.current(spark, path)) == [0, 1]


def rows(spark, *some):
    return spark.createDataFrame(some, "region string, year int, a int")


def test_parts_are_replaced_alone_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    V.publish(rows(spark, ("x/y", 2020, 1), ("x/y", 2021, 2), ("z", 2020, 3), (None, 2020, 4)), path, ["region", "year"])
    V.publish(rows(spark, ("x/y", 2021, 20), ("z", 2022, 5)), path, ["region", "year"])
    assert values(V.current(spark, path)) == [1, 3, 4, 5, 20]
    one = V.current(spark, path, region="x/y", year=2021)
    assert values(one) == [20] and len(one.inputFiles()) == 1 and set(one.columns) >= {"region", "year", "a"}
    assert len(V.parts(spark, path)) == 5 and {"region": None, "year": 2020} in V.parts(spark, path)
    V.publish(rows(spark, ("q", 1, 9)), path, ["region", "year"], replace_all=True)
    assert values(V.current(spark, path)) == [9]


def test_two_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    V.publish(rows(spark, ("x", 1, 1)), path, ["region", "year"])
    create, first = V._Folder.create, [True]

    def late(self, name, text, other):
        if name.startswith("manifests") and first:
            first.clear()
            V.publish(other, path, ["region", "year"])
        return create(self, name, text)

    monkeypatch.setattr(V._Folder, "create", lambda s, n, t: late(s, n, t, rows(spark, ("y", 1, 2))))
    V.publish(rows(spark, ("z", 1, 3)), path, ["region", "year"])
    assert values(V.current(spark, path)) == [1, 2, 3]  # other parts are merged
    first.append(True)
    monkeypatch.setattr(V._Folder, "create", lambda s, n, t: late(s, n, t, rows(spark, ("x", 1, 7))))
    with pytest.raises(V.Taken):
        V.publish(rows(spark, ("x", 1, 8)), path, ["region", "year"])
    assert values(V.current(spark, path)) == [2, 3, 7]


def test_claims(spark, tmp_path):
    path = str(tmp_path / "t")
    with V.claim(spark, path, "a"):
        with pytest.raises(V.Taken), V.claim(spark, path, "a"):
            pass
        with V.claim(spark, path, "b"), V.claim(spark, path, "a", expires=0):  # of a run that died
            pass
    with V.claim(spark, path, "a"):
        pass


def test_consolidate_complete_parts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    nodes = spark.createDataFrame([("x", 2023, n) for n in (1, 2)] + [("y", 2023, n) for n in (3, 4)], "region string, year int, nodo_id int")
    raw = spark.createDataFrame([(r, 2023, n, 1, 1, h, 30, h * n) for r, n in (("x", 1), ("x", 2), ("y", 3)) for h in range(24)], "region string, year int, nodo_id int, Month int, Day int, Hour int, Minute int, GHI int")
    done, ready = [], threading.Barrier(2)

    def run():
        ready.wait()
        done.extend(curation.consolidate_complete(nodes, raw, path))

    both = [threading.Thread(target=run) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert done == [{"region": "x", "year": 2023}]
    out = V.current(spark, path)
    assert out.count() == 48 and out.columns[:2] == ["nodo_id", "datetime"] and "minute" not in out.columns
    more = raw.union(raw.where("nodo_id = 3").withColumn("nodo_id", F.lit(4)))
    assert curation.consolidate_complete(nodes, more, path) == [{"region": "y", "year": 2023}]
    assert curation.consolidate_complete(nodes, more, path) == [] and V.current(spark, path).count() == 96
