"""Test views over the driver's tables: observations, nodes, a complement, sub-hourly rows and requested points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_HOUR = "(l_orderkey*7+l_linenumber)%24"
_OBS = [
    ("nodo_id", "CAST(l_suppkey AS INT)"),
    ("datetime", f"l_shipdate + to_hours(CAST({_HOUR} AS INT))"),
    ("year", "CAST(year(l_shipdate) AS INT)"),
    ("month", "CAST(month(l_shipdate) AS INT)"),
    ("day", "CAST(day(l_shipdate) AS INT)"),
    ("hour", f"CAST({_HOUR} AS INT)"),
    ("ghi", f"CASE WHEN {_HOUR} BETWEEN 6 AND 18 THEN CAST(l_partkey*13%1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"),
    ("clearsky_ghi", f"CASE WHEN {_HOUR} BETWEEN 6 AND 18 THEN CAST(l_partkey*13%1000 AS DOUBLE)*(1.0+l_discount*10)-20.0*l_tax ELSE CAST(0 AS DOUBLE) END"),
    ("dni", "CASE WHEN l_returnflag='A' THEN CAST(0 AS DOUBLE) ELSE CAST(l_quantity*20 AS DOUBLE) END"),
    ("solar_zenith_angle", f"CAST(abs(12-{_HOUR})*15 AS DOUBLE)"),
    ("cloud_type", "CAST(l_partkey%13 AS INT)"),
    ("cloud_fill_flag", "CAST(l_linenumber%3 AS INT)"),
    ("fill_flag", "CAST(l_orderkey%6 AS INT)"),
    ("temperature", "CASE WHEN l_partkey%50=0 THEN NULL ELSE CAST(l_quantity AS DOUBLE)*1.5-5.0 END"),
    ("pressure", "CAST(950+l_partkey%80 AS DOUBLE)"),
    ("wind_speed", "CAST(l_partkey%121 AS DOUBLE)/10.0"),
    ("wind_direction", "CAST(l_orderkey*37%360 AS DOUBLE)"),
    ("relative_humidity", "CAST(l_discount AS DOUBLE)*1000"),
]
_NODES = [
    ("nodo_id", "CAST(s_suppkey AS INT)"),
    ("latitude", "CAST(17.65+0.04*(s_suppkey%29) AS DOUBLE)"),
    ("longitude", "CAST(-67.94+0.04*(s_suppkey*7%93) AS DOUBLE)"),
    ("msnm", "CASE WHEN s_suppkey%17=3 THEN NULL WHEN s_suppkey%5=0 THEN CAST(0 AS DOUBLE) ELSE CAST(s_suppkey*11%960 AS DOUBLE) END"),
]
_SUB = [("nodo_id", "CAST(user_id AS INT)"), ("ts", "ts"), ("value", "value"), ("code", "CAST(event_id%4 AS INT)")]
_ASKED = [
    ("nodo_id", "CAST(c_custkey AS INT)"),
    ("lat_local", "CAST(22.0+0.0191*(c_custkey%50) AS DOUBLE)"),
    ("lon_local", "CAST(-98.99+0.0191*(c_custkey%37) AS DOUBLE)"),
    ("msnm", "CASE WHEN c_custkey%9=0 THEN CAST(0 AS DOUBLE) ELSE CAST(c_acctbal AS DOUBLE)/10 END"),
]
VIEWS = {"obs": ("lineitem", _OBS), "nodos": ("supplier", _NODES), "subhora": ("events", _SUB), "solicitados": ("customer", _ASKED)}
_COMPLEMENT = "SELECT nodo_id, year, month, day, hour, min(cloud_type) AS cloud_type_api, max(relative_humidity) AS rh_api FROM obs WHERE nodo_id % 10 <> 0 GROUP BY nodo_id, year, month, day, hour"
#: Fixed test polygon.
POLYGON = ((-67.0, 17.8, -65.2, 17.8), (-65.2, 17.8, -64.9, 18.5), (-64.9, 18.5, -66.4, 18.75), (-66.4, 18.75, -67.6, 18.2), (-67.6, 18.2, -67.0, 17.8))

WITH = "WITH " + ", ".join(f"{v} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols) + f" FROM {t})" for v, (t, cols) in VIEWS.items()) + f", complemento AS ({_COMPLEMENT}) "


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e.replace('to_hours(', 'make_dt_interval(0, ')} AS {c}" for c, e in columns))


def complement(obs: DataFrame) -> DataFrame:
    return obs.where("nodo_id % 10 <> 0").groupBy("nodo_id", "year", "month", "day", "hour").agg({"cloud_type": "min", "relative_humidity": "max"}).withColumnsRenamed({"min(cloud_type)": "cloud_type_api", "max(relative_humidity)": "rh_api"})
