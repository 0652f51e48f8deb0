"""One registered query per operator over the test views, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import filters, grid, quality, stats
from .plans import curation, fixtures
from .plans.fixtures import WITH
from .sources.files import decoded, matrix_rows

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str):
    """Register f(*views as DataFrames)."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(fixtures.view(spark, sf_dir, v) for v in views))
        if sql:
            ORACLE_SQL[name] = WITH + sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 8) -> DataFrame:
    """Sums of doubles depend on their order, so results are compared to `digits` decimals."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def r(expr: str, name: str, digits: int = 8) -> str:
    return f"round({expr}, {digits}) AS {name}"


# Scalars and filters
query("prj_clearness", "SELECT nodo_id, datetime, " + r("CASE WHEN clearsky_ghi > 0 THEN ghi / clearsky_ghi END", "kt") + " FROM obs", "obs")(lambda o: rounded(o.select("nodo_id", "datetime", S.clearness().alias("kt")), "kt"))
query("prj_timestamp", "SELECT nodo_id, make_timestamp(year, month, day, hour, 0, 0) AS t, CAST(year(datetime) AS INT) AS y, CAST(month(datetime) AS INT) AS m, CAST(day(datetime) AS INT) AS d, CAST(hour(datetime) AS INT) AS h FROM obs", "obs")(
    lambda o: o.select("nodo_id", S.timestamp_of().alias("t"), F.year("datetime").alias("y"), F.month("datetime").alias("m"), F.dayofmonth("datetime").alias("d"), F.hour("datetime").alias("h"))
)
_CASES = "CASE cloud_type " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.CLOUD_TYPE.items()) + " END"
query("prj_decode", f"SELECT nodo_id, {_CASES} AS cloud, fill_flag <> 0 AS filled, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2, 3", "obs")(
    lambda o: o.groupBy("nodo_id", S.label_of("cloud_type", S.CLOUD_TYPE).alias("cloud"), (F.col("fill_flag") != 0).alias("filled")).agg(F.count("*").alias("n"))
)
query("prj_surface_pressure", "SELECT nodo_id, " + r("1013.25 * pow(1 - 2.25577e-5 * msnm, 5.25588)", "mbar") + " FROM nodos", "nodos")(lambda n: rounded(n.select("nodo_id", S.surface_pressure(F.col("msnm")).alias("mbar")), "mbar"))
_SNAP = lambda c, o: f"round(sign(({c} - {o}) / 0.04) * floor(abs(({c} - {o}) / 0.04) + 0.5) * 0.04 + {o}, 4)"
_SNAPPED = f"(SELECT *, {_SNAP('lat_local', 0.01)} AS lat_real, {_SNAP('lon_local', 0.02)} AS lon_real FROM solicitados)"
query("prj_snap", f"SELECT nodo_id, lat_real, lon_real FROM {_SNAPPED}", "solicitados")(lambda s: grid.snap_nodes(s).select("nodo_id", "lat_real", "lon_real"))
query("prj_hours_in_year", "SELECT DISTINCT year, CAST((make_date(year + 1, 1, 1) - make_date(year, 1, 1)) * 24 AS INT) AS hours FROM obs", "obs")(lambda o: o.select("year").distinct().select("year", S.hours_in_year(F.col("year")).alias("hours")))
query("prj_mercator", "SELECT nodo_id, " + r("radians(longitude) * 6378137.0", "x", 3) + ", " + r("ln(tan(0.7853981633974483 + radians(latitude) / 2)) * 6378137.0", "y", 3) + ", format('POINT({:.4f} {:.4f})', longitude, latitude) AS wkt FROM nodos", "nodos")(
    lambda n: rounded(n.select("nodo_id", S.mercator_x(F.col("longitude")).alias("x"), S.mercator_y(F.col("latitude")).alias("y"), S.wkt_point(F.col("longitude"), F.col("latitude")).alias("wkt")), "x", "y", digits=3)
)
query("prj_month_name", "SELECT month, " + "CASE month " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(S.MONTHS, 1)) + " END AS name, CAST(count(*) AS BIGINT) AS n FROM obs GROUP BY 1, 2", "obs")(
    lambda o: o.groupBy("month").agg(F.count("*").alias("n")).select("month", S.month_name("month").alias("name"), "n")
)
query("flt_filter", "SELECT nodo_id, datetime, ghi, " + r("CASE WHEN clearsky_ghi > 0 THEN ghi / clearsky_ghi END", "kt") + " FROM obs WHERE nodo_id IN (3, 7, 11) AND month IN (1, 6, 7) AND hour IN (9, 10, 11, 12) AND solar_zenith_angle < 90 AND cloud_type IN (0, 1, 2, 3, 4, 5) AND temperature > 10", "obs")(
    lambda o: rounded(filters.filtered(o, nodes=[3, 7, 11], months=[1, 6, 7], hours=range(9, 13), daylight=True, cloud=range(6), where="temperature > 10", columns=["nodo_id", "datetime", "ghi", "kt"]), "kt")
)
query("flt_days", "SELECT nodo_id, datetime FROM obs WHERE day = 5 OR (month = 3 AND day = 14) OR (year = 1997 AND month = 6 AND day = 21)", "obs")(lambda o: filters.on_days(o, [5, "03-14", "1997-06-21"]).select("nodo_id", "datetime"))
query("flt_between", "SELECT nodo_id, datetime, ghi FROM obs WHERE datetime BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-03-31 23:00:00'", "obs")(lambda o: filters.filtered(o, between=("1996-01-01", "1996-03-31 23:00:00"), columns=["nodo_id", "datetime", "ghi"]))
query("flt_daylight_mask", "SELECT nodo_id, datetime, ghi FROM obs WHERE clearsky_ghi > 0 AND solar_zenith_angle < 85", "obs")(lambda o: filters.daylight_mask(o).select("nodo_id", "datetime", "ghi"))
# The winding number, unlike the library's parity of crossings; points on an edge are outside.
_SIDE = [(f"(({x2 - x1!r}) * (latitude - ({y1})) - (longitude - ({x1})) * ({y2 - y1!r}))", x1, y1, x2, y2) for x1, y1, x2, y2 in fixtures.POLYGON]
_TURNS = " + ".join(f"CASE WHEN {y1} <= latitude AND {y2} > latitude AND {side} > 0 THEN 1 WHEN {y1} > latitude AND {y2} <= latitude AND {side} < 0 THEN -1 ELSE 0 END" for side, x1, y1, x2, y2 in _SIDE)
_NEAR = [f"abs({side}) <= 1e-12 * (abs({x2 - x1!r} * (latitude - ({y1}))) + abs((longitude - ({x1})) * {y2 - y1!r}))" for side, x1, y1, x2, y2 in _SIDE]
_ON_EDGE = " OR ".join(f"({near} AND longitude BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND latitude BETWEEN {min(y1, y2)} AND {max(y1, y2)})" for near, (_, x1, y1, x2, y2) in zip(_NEAR, _SIDE))
_INSIDE = f"({_TURNS}) <> 0 AND NOT ({_ON_EDGE})"
query("flt_polygon", f"SELECT nodo_id FROM nodos WHERE {_INSIDE}", "nodos")(lambda n: filters.in_polygon(n, fixtures.POLYGON).select("nodo_id"))
query("flt_near_focus", "SELECT n.nodo_id FROM nodos n, (SELECT min(longitude) a, max(longitude) b, min(latitude) c, max(latitude) d FROM nodos WHERE nodo_id IN (4, 8)) WHERE longitude BETWEEN a - 0.3 AND b + 0.3 AND latitude BETWEEN c - 0.3 AND d + 0.3 AND nodo_id NOT IN (4, 8)", "nodos")(
    lambda n: filters.near_focus(n, (4, 8), 0.3).select("nodo_id")
)
query("flt_water_nodes", "SELECT nodo_id, msnm FROM nodos WHERE msnm <= 0", "nodos")(lambda n: filters.water_nodes(n).select("nodo_id", "msnm"))
# An L whose sides run through nodes.
_L = ((-67.54, 17.85), (-65.14, 17.85), (-65.14, 18.17), (-66.34, 18.17), (-66.34, 18.49), (-67.54, 18.49))
query("flt14_border", "SELECT nodo_id FROM nodos WHERE longitude > -67.54 AND latitude > 17.85 AND (longitude < -65.14 AND latitude < 18.17 OR longitude < -66.34 AND latitude < 18.49)", "nodos")(lambda n: filters.in_polygon(n, [(*a, *b) for a, b in zip(_L, (*_L[1:], _L[0]))]).select("nodo_id"))
query("set_selection", f"SELECT nodo_id FROM nodos WHERE {_INSIDE} AND NOT coalesce(msnm <= 0, false)", "nodos")(lambda n: filters.selection(n, [("add_ids", [1, 2]), ("reset", None), ("add", fixtures.POLYGON), ("remove_water", 0.0)]))

# Statistics
_P = ((0.05, "p05"), (0.25, "p25"), (0.5, "p50"), (0.75, "p75"), (0.95, "p95"))


def _describe_sql(v: str) -> str:
    parts = [f"'{v}' AS variable", f"count({v}) AS count", r(f"avg({v})", "mean"), r(f"stddev_samp({v})", "std"), f"min({v}) AS min"]
    parts += [r(f"quantile_cont({v}, {p})", n) for p, n in _P] + [f"max({v}) AS max", f"count(*) - count({v}) AS nulls", r(f"(count(*) - count({v})) * 100.0 / count(*)", "null_pct", 2)]
    return "SELECT " + ", ".join(parts) + " FROM obs"


_VARS = ("ghi", "temperature", "pressure")
query("agg_describe", " UNION ALL ".join(map(_describe_sql, _VARS)), "obs")(lambda o: rounded(stats.describe(o, _VARS), "mean", "std", *(n for _, n in _P)))
_SUMMARY = "SELECT o.nodo_id, " + ", ".join([r("avg(ghi)", "mean"), r("stddev_samp(ghi)", "std"), "min(ghi) AS min", "max(ghi) AS max"]) + ", any_value(latitude) AS latitude, any_value(longitude) AS longitude FROM obs o LEFT JOIN nodos n ON o.nodo_id = n.nodo_id GROUP BY o.nodo_id"
query("agg_node_summary", _SUMMARY, "obs", "nodos")(lambda o, n: rounded(stats.node_summary(o, "ghi", nodes=n), "mean", "std"))
query("agg_flags", " UNION ALL ".join(f"SELECT '{f}' AS flag, {f} AS code, count(*) AS n, " + r("count(*) * 100.0 / (SELECT count(*) FROM obs)", "pct", 3) + f", {_CASES if f == 'cloud_type' else 'NULL'} AS label FROM obs GROUP BY {f}" for f in stats.FLAGS), "obs")(stats.flag_distribution)


def _days_sql(keys: str) -> str:
    return f"SELECT *, CASE WHEN kt >= 0.65 THEN 'clear' WHEN kt >= 0.35 THEN 'partial' ELSE 'overcast' END AS category FROM (SELECT {keys}, " + r("avg(CASE WHEN clearsky_ghi > 0 THEN ghi / clearsky_ghi END)", "kt") + f" FROM obs WHERE solar_zenith_angle < 90 GROUP BY {keys}) WHERE kt IS NOT NULL"


query("agg_day_classes", _days_sql("month, day"), "obs")(stats.classify_days)
query("agg_day_classes_by_node", _days_sql("month, day, nodo_id"), "obs")(lambda o: stats.classify_days(o, by_node=True))
query("agg_day_counts", f"SELECT category, count(*) AS days FROM ({_days_sql('month, day')}) GROUP BY category", "obs")(lambda o: stats.day_counts(stats.classify_days(o)))


def _years_sql(by: str, years) -> str:
    avg = {y: f"avg(CASE WHEN year = {y} THEN ghi END)" for y in years}
    cols = [r(avg[y], f"y{y}") for y in years]
    if len(years) == 2:
        a, b = avg.values()
        cols += [r(f"{b} - {a}", "delta"), r(f"CASE WHEN {a} <> 0 THEN ({b} - {a}) * 100 / {a} END", "delta_pct")]
    return f"SELECT {by}, " + ", ".join(cols) + f" FROM obs WHERE year IN ({', '.join(map(str, years))}) GROUP BY {by}"


query("agg_years_by_month", _years_sql("month", (1996, 1997, 1998)), "obs")(lambda o: rounded(stats.compare_years(o, "ghi", (1996, 1997, 1998)), "y1996", "y1997", "y1998"))
query("agg_years_by_node", _years_sql("nodo_id", (1996, 1997)), "obs")(lambda o: rounded(stats.compare_years(o, "ghi", (1996, 1997), by="nodo_id"), "y1996", "y1997", "delta", "delta_pct"))
query("agg_years_total", "SELECT year, " + r("avg(ghi)", "value") + " FROM obs WHERE year IN (1996, 1997) GROUP BY year", "obs")(lambda o: rounded(stats.compare_years(o, "ghi", (1996, 1997), by="total"), "value"))
_ENDS = "(SELECT CASE WHEN min(ghi) = max(ghi) THEN min(ghi) - 0.5 ELSE min(ghi) END AS lo, CASE WHEN min(ghi) = max(ghi) THEN max(ghi) + 0.5 ELSE max(ghi) END AS hi FROM obs)"
query("agg_histogram", "SELECT CAST(b.range AS INT) AS bin, " + r("b.range * ((hi - lo) / 60) + lo", "low") + ", " + r("(b.range + 1) * ((hi - lo) / 60) + lo", "high") + f", coalesce(n, 0) AS n FROM range(60) b JOIN {_ENDS} ON true LEFT JOIN (SELECT least(CAST(floor((ghi - lo) / ((hi - lo) / 60)) AS INT), 59) AS bin, count(*) AS n FROM obs, {_ENDS} WHERE ghi IS NOT NULL GROUP BY 1) h ON h.bin = b.range", "obs")(
    lambda o: rounded(stats.histogram(o, "ghi"), "low", "high")
)
query("agg16_centre", "SELECT " + r("avg(ghi)", "mean") + ", median(ghi) AS median FROM obs", "obs")(lambda o: rounded(stats.centre(o, "ghi"), "mean"))
query("agg_time_series", "SELECT datetime, " + r("avg(temperature)", "value") + " FROM obs GROUP BY datetime", "obs")(lambda o: rounded(stats.time_series(o, "temperature"), "value"))
query("agg_daily_profile", "SELECT hour, " + ", ".join([r("avg(temperature)", "mean"), r("stddev_samp(temperature)", "std"), r("avg(temperature) - stddev_samp(temperature)", "low"), r("avg(temperature) + stddev_samp(temperature)", "high")]) + " FROM obs GROUP BY hour", "obs")(
    lambda o: rounded(stats.daily_profile(o, "temperature"), "mean", "std", "low", "high")
)
_CORR = ("ghi", "temperature", "pressure", "wind_speed")
query("agg_correlations", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + r(f"corr({a}, {b})", "r", 6) + " FROM obs" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :]), "obs")(lambda o: rounded(stats.correlations(o, _CORR), "r", digits=6))
_RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
_SEVEN = ("ghi", "dni", "clearsky_ghi", "temperature", "relative_humidity", "pressure", "wind_speed")
_PAIRS = [(a, b) for i, a in enumerate(_SEVEN) for b in _SEVEN[i + 1 :]]
_RANKED = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"
query("agg20_spearman_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + r("corr(x, y)", "r", 6) + f" FROM (SELECT {_RANKED(a)} AS x, {_RANKED(b)} AS y FROM obs WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in _PAIRS), "obs")(lambda o: rounded(stats.spearman_matrix(o, _SEVEN), "r", digits=6))
query("agg_spearman", "SELECT 'ghi' AS a, 'temperature' AS b, " + r("corr(x, y)", "r", 6) + f" FROM (SELECT {_RANK('ghi')} AS x, {_RANK('temperature')} AS y FROM obs WHERE ghi IS NOT NULL AND temperature IS NOT NULL)", "obs")(lambda o: rounded(stats.spearman(o, "ghi", "temperature"), "r", digits=6))


def _resample_sql(unit: str, by_node: bool) -> str:
    inner = f"SELECT nodo_id, date_trunc('{unit}', datetime) AS period, sum(ghi) * 0.001 AS value FROM obs GROUP BY 1, 2"
    return f"SELECT nodo_id, period, " + r("value", "value") + f" FROM ({inner})" if by_node else f"SELECT period, " + r("avg(value)", "value") + f" FROM ({inner}) GROUP BY period"


query("agg_resample_day", _resample_sql("day", False), "obs")(lambda o: rounded(stats.resample(o, "ghi", "day", factor=0.001), "value"))
query("agg_resample_month_by_node", _resample_sql("month", True), "obs")(lambda o: rounded(stats.resample(o, "ghi", "month", factor=0.001, by_node=True), "value"))
_PER = "(SELECT nodo_id, avg(ghi) AS value FROM obs GROUP BY nodo_id)"
query("agg_outliers_zscore", "SELECT nodo_id, " + r("value", "value") + ", " + r("(value - m) / s", "z") + f" FROM {_PER}, (SELECT avg(value) m, stddev_pop(value) s FROM {_PER}) WHERE abs((value - m) / s) > 2", "obs")(lambda o: rounded(stats.outlier_nodes(o, "ghi", threshold=2.0), "value", "z"))
query("agg_outliers_iqr", "SELECT nodo_id, " + r("value", "value") + f" FROM {_PER}, (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM {_PER}) WHERE value < q1 - (q3 - q1) OR value > q3 + (q3 - q1)", "obs")(
    lambda o: rounded(stats.outlier_nodes(o, "ghi", method="iqr", threshold=1.0), "value")
)
_SPEED = "CASE " + " ".join(f"WHEN wind_speed > {a} AND wind_speed <= {a + 2} THEN {i}" for i, a in enumerate((0, 2, 4, 6, 8))) + " WHEN wind_speed > 10 THEN 5 END"
_SECTOR = "CAST(floor(((wind_direction + 11.25) % 360.0) / 22.5) AS INT)"


def _rose_sql(key: str) -> str:
    """All sectors and bins; the total is all rows (of the month)."""
    on = "s.range = o.sector AND b.range = o.bin" + (" AND m.month = o.month" if key else "")
    months = "(SELECT month, count(*) AS total FROM obs GROUP BY month)" if key else "(SELECT count(*) AS total FROM obs)"
    cells = f"(SELECT {key}{_SECTOR} AS sector, {_SPEED} AS bin, count(*) AS n FROM obs GROUP BY ALL)"
    return f"SELECT {'m.month, ' if key else ''}CAST(s.range AS INT) AS sector, CAST(b.range AS INT) AS speed_bin, " + r("coalesce(n, 0) * 100.0 / total", "pct") + f" FROM range(16) s JOIN range(6) b ON true JOIN {months} m ON true LEFT JOIN {cells} o ON {on}"


query("agg_wind_rose", _rose_sql(""), "obs")(lambda o: rounded(stats.wind_rose(o), "pct"))
query("agg_wind_rose_by_month", _rose_sql("month, "), "obs")(lambda o: rounded(stats.wind_rose(o, by_month=True), "pct"))
query("agg_boxplot", "SELECT month, q1, median, q3, min(v) AS low, max(v) AS high FROM (SELECT month, temperature AS v FROM obs) JOIN (SELECT month AS k, quantile_cont(temperature, 0.25) q1, quantile_cont(temperature, 0.5) median, quantile_cont(temperature, 0.75) q3 FROM obs GROUP BY month) ON month = k WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL", "obs")(
    lambda o: stats.boxplot(o, "temperature")
)
query("agg_month_hour", "SELECT month, " + ", ".join(r(f"avg(CASE WHEN hour = {h} THEN ghi END)", f"h{h:02d}") for h in range(24)) + " FROM obs GROUP BY month", "obs")(lambda o: rounded(stats.month_hour(o, "ghi"), *(f"h{h:02d}" for h in range(24))))
_DAILY = "(SELECT nodo_id, year, month, day, sum(ghi) AS total FROM obs GROUP BY ALL)"
query("agg_resource_map", "SELECT d.nodo_id, " + r("avg(total) * 0.001", "value") + f", any_value(latitude) AS latitude, any_value(longitude) AS longitude FROM {_DAILY} d JOIN nodos n ON d.nodo_id = n.nodo_id GROUP BY d.nodo_id", "obs", "nodos")(lambda o, n: rounded(stats.resource_map(o, "ghi", n), "value"))
query("agg_twelve_months", "SELECT nodo_id, month, " + r("avg(ghi)", "value") + " FROM obs GROUP BY nodo_id, month", "obs")(lambda o: rounded(stats.twelve_months(o, "ghi"), "value"))
query("agg_daily_spatial", "SELECT year, month, day, " + ", ".join([r("avg(total / 1000)", "mean"), r("stddev_samp(total / 1000)", "std"), "min(total / 1000) AS min", "max(total / 1000) AS max"]) + f" FROM {_DAILY} GROUP BY year, month, day", "obs")(lambda o: rounded(stats.daily_spatial(o, "ghi"), "mean", "std"))
_HOURLY = "(SELECT nodo_id, hour_ts, avg(value) AS mean, max(value) AS max, max(CASE WHEN minute(ts) = 30 THEN value END) AS minute_30, (SELECT NULL) AS x FROM (SELECT *, date_trunc('hour', ts) AS hour_ts FROM subhora) GROUP BY nodo_id, hour_ts)"
_MODE = "(SELECT nodo_id, hour_ts, code AS mode FROM (SELECT nodo_id, date_trunc('hour', ts) AS hour_ts, code, row_number() OVER (PARTITION BY nodo_id, date_trunc('hour', ts) ORDER BY count(*) DESC, code) AS i FROM subhora GROUP BY nodo_id, date_trunc('hour', ts), code) WHERE i = 1)"
query("agg_hourly_rules", "SELECT h.nodo_id, h.hour_ts, " + r("mean", "mean") + f", max, minute_30, mode FROM {_HOURLY} h JOIN {_MODE} m ON h.nodo_id = m.nodo_id AND h.hour_ts = m.hour_ts", "subhora")(lambda s: rounded(stats.hourly(s), "mean"))
query("agg_summary", "SELECT count(*) AS rows, count(DISTINCT nodo_id) AS nodes, count(DISTINCT (year, month, day)) AS days, min(datetime) AS first_time, max(datetime) AS last_time FROM obs", "obs")(quality.summary)
query("agg_extent", "SELECT min(longitude) AS x0, max(longitude) AS x1, min(latitude) AS y0, max(latitude) AS y1, " + r("avg(longitude)", "cx") + ", " + r("avg(latitude)", "cy") + " FROM nodos", "nodos")(
    lambda n: rounded(stats.extent(n), "cx", "cy")
)
query("agg_retention", "SELECT count(*) AS rows_before, count(*) FILTER (clearsky_ghi > 0 AND solar_zenith_angle < 85) AS rows_after, " + r("count(*) FILTER (clearsky_ghi > 0 AND solar_zenith_angle < 85) * 100.0 / count(*)", "kept_pct", 3) + " FROM obs", "obs")(lambda o: quality.retention(o, F.expr("clearsky_ghi > 0 AND solar_zenith_angle < 85")))
query("win_duration_curve", "SELECT ghi AS value, count(*) AS n, " + r("sum(count(*)) OVER (ORDER BY ghi DESC) * 100.0 / sum(count(*)) OVER ()", "exceedance_pct") + " FROM obs WHERE solar_zenith_angle < 90 GROUP BY ghi", "obs")(lambda o: rounded(stats.duration_curve(o.where("solar_zenith_angle < 90"), "ghi"), "exceedance_pct"))

# Integrity
_COUNTS = "(SELECT count(*) AS rows, count(DISTINCT nodo_id) AS nodes, count(DISTINCT (month, day)) AS days, count(DISTINCT hour) AS hours FROM obs)"
query("dq_completeness", "SELECT CAST(rows AS BIGINT) AS rows, nodes, days, hours, nodes * days * hours AS expected, nodes * days * hours - rows AS missing, " + r("(nodes * days * hours - rows) * 100.0 / (nodes * days * hours)", "missing_pct", 3) + f" FROM {_COUNTS}", "obs")(quality.completeness)
query("dq_duplicate_count", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM obs GROUP BY nodo_id, datetime)", "obs")(quality.duplicate_count)
query("dq_duplicate_rows", "SELECT nodo_id, datetime, ghi, copies FROM (SELECT *, count(*) OVER (PARTITION BY nodo_id, datetime) AS copies FROM obs) WHERE copies > 1", "obs")(lambda o: quality.duplicate_rows(o).select("nodo_id", "datetime", "ghi", "copies"))
query("agg09_node_completeness", f"SELECT nodo_id, rows, times, rows - times AS surplus, days * hours AS expected, days * hours - times AS missing FROM (SELECT nodo_id, count(*) AS rows, count(DISTINCT datetime) AS times FROM obs GROUP BY nodo_id) n, (SELECT days, hours FROM {_COUNTS}) c", "obs")(quality.node_completeness)
query("dq_incomplete_nodes", f"SELECT nodo_id, n, days * hours AS expected FROM (SELECT nodo_id, count(*) AS n FROM obs GROUP BY nodo_id), {_COUNTS} WHERE n <> days * hours", "obs")(quality.incomplete_nodes)
_OBS_COLUMNS = [c for c, _ in fixtures.VIEWS["obs"][1]]
query("dq_null_counts", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n FROM obs" for c in _OBS_COLUMNS) + ") WHERE n > 0", "obs")(quality.null_counts)
_LIMITS = {c: f"{c} < {S.RANGES[c][0]} OR {c} > {S.RANGES[c][1]}" for c in ("ghi", "dni", "clearsky_ghi", "temperature", "relative_humidity", "wind_speed", "wind_direction", "solar_zenith_angle")}
_LIMITS["pressure"] = "CASE WHEN msnm IS NULL THEN pressure < 700 OR pressure > 1100 ELSE abs(pressure - 1013.25 * pow(1 - 2.25577e-5 * msnm, 5.25588)) > 60 END"
_KINDS = {f"rango_{c}": t for c, t in _LIMITS.items()} | {"ghi_over_clearsky": "ghi > clearsky_ghi", "ghi_zero_by_day": "ghi = 0 AND solar_zenith_angle < 90", "dni_zero_by_day": "dni = 0 AND solar_zenith_angle < 90", "ghi_negative": "ghi < 0"}
_JOINED = "(SELECT o.*, n.msnm FROM obs o LEFT JOIN nodos n ON o.nodo_id = n.nodo_id)"
query("dq_anomaly_counts", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({t}) AS n FROM {_JOINED}" for k, t in _KINDS.items()), "obs", "nodos")(quality.anomaly_counts)
query("dq_anomalies", " UNION ALL ".join(f"SELECT nodo_id, datetime, '{k}' AS kind FROM {_JOINED} WHERE {t}" for k, t in _KINDS.items()) + " UNION ALL SELECT nodo_id, datetime, 'duplicate' FROM (SELECT *, count(*) OVER (PARTITION BY nodo_id, datetime) AS c FROM obs) WHERE c > 1", "obs", "nodos")(
    lambda o, n: quality.anomalies(o, n)
)
query("dq_filled", "SELECT count(*) FILTER (fill_flag <> 0) AS filled, " + r("count(*) FILTER (fill_flag <> 0) * 100.0 / count(*)", "filled_pct", 3) + " FROM obs", "obs")(quality.filled)

# Grid
_FIRST = f"(SELECT *, row_number() OVER (PARTITION BY lat_real, lon_real ORDER BY nodo_id) AS i FROM {_SNAPPED})"
query("grid_first_per_cell", f"SELECT nodo_id, lat_real, lon_real FROM {_FIRST} WHERE i = 1", "solicitados")(lambda s: grid.first_per_cell(grid.snap_nodes(s)).select("nodo_id", "lat_real", "lon_real"))
query("grid_duplicate_flags", f"SELECT nodo_id, i > 1 AS is_duplicate FROM {_FIRST}", "solicitados")(lambda s: grid.duplicate_flags(grid.snap_nodes(s)).select("nodo_id", "is_duplicate"))
query("grid_id_map", f"SELECT f.nodo_id, r.nodo_id AS representative, r.new_id FROM {_FIRST} f JOIN (SELECT *, row_number() OVER (ORDER BY nodo_id) - 1 AS new_id FROM {_FIRST} WHERE i = 1) r ON f.lat_real = r.lat_real AND f.lon_real = r.lon_real", "solicitados")(lambda s: grid.id_map(grid.snap_nodes(s)))
query("grid_multiplicity", f"SELECT k AS nodes_in_cell, count(*) AS cells FROM (SELECT count(*) AS k FROM {_SNAPPED} GROUP BY lat_real, lon_real) GROUP BY k", "solicitados")(lambda s: grid.multiplicity(grid.snap_nodes(s)))
query("grid_steps", f"SELECT DISTINCT step FROM (SELECT round(c - lag(c) OVER (ORDER BY c), 4) AS step FROM (SELECT DISTINCT round(lat_real, 4) AS c FROM {_SNAPPED})) WHERE step IS NOT NULL", "solicitados")(lambda s: grid.grid_steps(grid.snap_nodes(s)))
_MATCH = ["count(*) AS nodes", "count(*) FILTER (a < 1e-6 AND b < 1e-6) AS matching", r("avg(a)", "mean_dlat", 6), r("avg(b)", "mean_dlon", 6), r("max(a)", "max_dlat", 6), r("max(b)", "max_dlon", 6), "max(a) < 0.001 AND max(b) < 0.001 AS aligned"]
query("grid_match_report", "SELECT " + ", ".join(_MATCH) + f" FROM (SELECT abs(lat_real - lat_local) AS a, abs(lon_real - lon_local) AS b FROM {_SNAPPED})", "solicitados")(lambda s: rounded(grid.match_report(grid.snap_nodes(s)), "mean_dlat", "mean_dlon", "max_dlat", "max_dlon", digits=6))
query("grid_elevation_summary", "SELECT min(msnm) AS min, quantile_cont(msnm, 0.5) AS median, max(msnm) AS max, count(*) FILTER (msnm = 0) AS at_zero, " + r("count(*) FILTER (msnm <= 0) * 100.0 / count(*)", "candidate_pct", 3) + ", min(longitude) AS lon_min, max(longitude) AS lon_max FROM nodos", "nodos")(grid.elevation_summary)
query("grid_upsert", "SELECT nodo_id, latitude, longitude, CASE WHEN nodo_id % 3 = 0 THEN 1.5 ELSE msnm END AS msnm FROM nodos", "nodos")(lambda n: grid.upserted(n, n.where("nodo_id % 3 = 0").withColumn("msnm", F.lit(1.5))))
query("grid_pending", "SELECT nodo_id FROM solicitados WHERE nodo_id NOT IN (SELECT nodo_id FROM obs)", "solicitados", "obs")(lambda s, o: grid.pending(s.select("nodo_id"), o))
query("grid_ingest_state", "SELECT count(*) AS total, count(o.nodo_id) AS present, count(*) - count(o.nodo_id) AS missing, count(*) = count(o.nodo_id) AS complete FROM solicitados s LEFT JOIN (SELECT DISTINCT nodo_id FROM obs) o ON s.nodo_id = o.nodo_id", "solicitados", "obs")(grid.ingest_state)

# Curation
query("plan_fusion", "SELECT o.nodo_id, o.datetime, o.ghi, c.cloud_type_api, c.rh_api FROM obs o JOIN complemento c ON o.nodo_id = c.nodo_id AND o.year = c.year AND o.month = c.month AND o.day = c.day AND o.hour = c.hour", "obs")(
    lambda o: curation.fused(o, fixtures.complement(o)).select("nodo_id", "datetime", "ghi", "cloud_type_api", "rh_api")
)
query("plan_daylight_set", "SELECT nodo_id, datetime, ghi, temperature, relative_humidity AS rh_mean FROM obs WHERE clearsky_ghi > 0 AND solar_zenith_angle < 85", "obs")(lambda o: curation.daylight_set(o).select("nodo_id", "datetime", "ghi", "temperature", "rh_mean"))
query("plan_hour_audit", f"SELECT nodo_id, hour_ts, " + r("mean", "mean") + " FROM " + _HOURLY + " WHERE max - 1 > mean + 1e-6", "subhora")(
    lambda s: rounded(curation.hour_audit(s, stats.hourly(s).select("nodo_id", "hour_ts", F.when(F.col("max") - 1 > F.col("mean") + 1e-6, F.col("max")).otherwise(F.col("mean")).alias("stored"))).select("nodo_id", "hour_ts", "mean"), "mean")
)
query("win_node_order", "SELECT nodo_id, row_number() OVER (ORDER BY nodo_id) - 1 AS new_id FROM nodos", "nodos")(lambda n: grid.reindexed(n.select("nodo_id")))
query("srt_limited_anomalies", "SELECT nodo_id, datetime, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY nodo_id, datetime) AS i FROM (" + ORACLE_SQL["dq_anomalies"].removeprefix(WITH) + ")) WHERE i <= 5", "obs", "nodos")(lambda o, n: quality.anomalies(o, n, limit=5))

# Further operators, named by their number in the survey
query("agg07_years_by_node_with_places", "SELECT y.*, latitude, longitude FROM (" + _years_sql("nodo_id", (1996, 1997)) + ") y LEFT JOIN nodos n ON y.nodo_id = n.nodo_id", "obs", "nodos")(
    lambda o, n: rounded(stats.with_coordinates(stats.compare_years(o, "ghi", (1996, 1997), by="nodo_id"), n), "y1996", "y1997", "delta", "delta_pct")
)
_KT = "CASE WHEN clearsky_ghi > 0 THEN ghi / clearsky_ghi END"
query("agg06_clearness_by_year", "SELECT month, " + ", ".join(r(f"avg(CASE WHEN year = {y} THEN {_KT} END)", f"y{y}") for y in (1996, 1997, 1998)) + " FROM obs WHERE year IN (1996, 1997, 1998) AND solar_zenith_angle < 90 GROUP BY month", "obs")(
    lambda o: rounded(stats.compare_years(o, "kt", (1996, 1997, 1998)), "y1996", "y1997", "y1998")
)
query("agg21_resample_hour", "SELECT period, " + r("avg(value)", "value") + " FROM (SELECT nodo_id, date_trunc('hour', datetime) AS period, coalesce(sum(temperature), 0) AS value FROM obs GROUP BY 1, 2) GROUP BY period", "obs")(lambda o: rounded(stats.resample(o, "temperature", "hour"), "value"))
query("agg23_outliers_default", "SELECT nodo_id, " + r("value", "value") + f" FROM {_PER}, (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM {_PER}) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)", "obs")(lambda o: rounded(stats.outlier_nodes(o, "ghi", method="iqr"), "value"))
query("agg26_boxplot_by_hour", ORACLE_SQL["agg_boxplot"].removeprefix(WITH).replace("month", "hour"), "obs")(lambda o: stats.boxplot(o, "temperature", by="hour"))
_DELTA = "(SELECT nodo_id, avg(CASE WHEN year = 1997 THEN ghi END) AS b, avg(CASE WHEN year = 1996 THEN ghi END) AS a FROM obs WHERE year IN (1996, 1997) GROUP BY nodo_id)"
query("agg29_delta_map", "SELECT d.nodo_id, " + r("b - a", "value") + f", latitude, longitude, " + r("max(abs(b - a)) OVER ()", "scale") + f" FROM {_DELTA} d JOIN nodos n ON d.nodo_id = n.nodo_id WHERE b - a IS NOT NULL", "obs", "nodos")(lambda o, n: rounded(stats.delta_map(o, "ghi", (1996, 1997), n), "value", "scale"))
query("agg29_delta_map_relative", "SELECT d.nodo_id, " + r("(b - a) * 100 / a", "value") + ", latitude, longitude, " + r("max(abs((b - a) * 100 / a)) OVER ()", "scale") + f" FROM {_DELTA} d JOIN nodos n ON d.nodo_id = n.nodo_id WHERE b IS NOT NULL AND a <> 0", "obs", "nodos")(lambda o, n: rounded(stats.delta_map(o, "ghi", (1996, 1997), n, relative=True), "value", "scale"))
query("agg33_map_summary", "SELECT count(value) AS nodes, " + ", ".join(r(f"{f}(value)", n) for f, n in (("avg", "mean"), ("min", "min"), ("max", "max"))) + f" FROM {_PER}", "obs")(lambda o: rounded(stats.map_summary(stats.node_summary(o, "ghi", aggs=("mean",)), "mean"), "mean", "min", "max"))
_TWELVE = "(SELECT nodo_id, month, avg(ghi) AS value FROM obs GROUP BY nodo_id, month)"
query("agg32_panel", "SELECT nodo_id, month, " + ", ".join([r("value", "value"), r("avg(value) OVER (PARTITION BY month)", "month_mean"), r("min(value) OVER ()", "low"), r("max(value) OVER ()", "high")]) + f" FROM {_TWELVE}", "obs")(lambda o: rounded(stats.twelve_month_panel(o, "ghi"), "value", "month_mean", "low", "high"))
_DAYS = f"(SELECT year, month, day, avg(total / 1000) AS mean FROM {_DAILY} GROUP BY year, month, day)"
query("agg34_monthly_mean", "SELECT year, month, " + r("avg(mean)", "mean") + f" FROM {_DAYS} GROUP BY year, month", "obs")(lambda o: rounded(stats.daily_means(stats.daily_spatial(o, "ghi"), by_month=True), "mean"))
query("agg34_yearly_mean", "SELECT year, " + r("avg(mean)", "mean") + f" FROM {_DAYS} GROUP BY year", "obs")(lambda o: rounded(stats.daily_means(stats.daily_spatial(o, "ghi")), "mean"))
query("agg39_hourly_means", "SELECT nodo_id, date_trunc('hour', ts) AS hour_ts, " + r("avg(value)", "value") + ", " + r("avg(code)", "code") + " FROM subhora GROUP BY 1, 2", "subhora")(lambda s: rounded(stats.hourly_means(s, ("value", "code")), "value", "code"))
query("agg41_node_list", "SELECT DISTINCT nodo_id FROM obs", "obs")(stats.node_list)
query("agg41_row_counts", "SELECT rows, count(*) AS nodes FROM (SELECT count(*) AS rows FROM obs GROUP BY nodo_id) GROUP BY rows", "obs")(stats.row_counts)
query("agg42_extent_of_focus", "SELECT min(longitude) - 0.25 AS x0, max(longitude) + 0.25 AS x1, min(latitude) - 0.25 AS y0, max(latitude) + 0.25 AS y1, " + r("avg(longitude) FILTER (nodo_id IN (4, 8))", "cx") + ", " + r("avg(latitude) FILTER (nodo_id IN (4, 8))", "cy") + " FROM nodos", "nodos")(lambda n: rounded(stats.extent(n, 0.25, (4, 8)), "cx", "cy"))
query("prj08_labels", "SELECT nodo_id, datetime, cloud_type, " + _CASES + " AS cloud_label, CASE fill_flag " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in S.FILL_FLAG.items()) + " END AS fill_label, fill_flag <> 0 AS filled FROM obs", "obs")(lambda o: decoded(o.select("nodo_id", "datetime", "cloud_type", "fill_flag")).drop("fill_flag"))
query("prj19_variables", " UNION ALL ".join(f"SELECT '{c}' AS variable, '{S.UNITS.get(c, '')}' AS unit, count({c}) AS n FROM obs" for c in _OBS_COLUMNS if c not in S.KEY_COLUMNS + S.FLAG_COLUMNS), "obs")(
    lambda o: S.with_units(o).agg(F.array(*(F.struct(F.lit(c).alias("variable"), F.lit(S.with_units(o).schema[c].metadata.get("unit", "")).alias("unit"), F.count(c).alias("n")) for c in S.analysable(o))).alias("x")).select(F.inline("x"))
)
query("prj20_bytes", "SELECT nodo_id, CAST(latitude AS DOUBLE) AS latitude, CAST(nodo_id AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS number FROM nodos", "nodos")(
    lambda n: n.withColumns({"a": F.col("latitude").cast("string").cast("binary"), "b": F.col("nodo_id").cast("string").cast("binary"), "c": F.concat(F.lit("node "), F.col("nodo_id").cast("string")).cast("binary")}).select("nodo_id", S.decoded_number("a").alias("latitude"), S.decoded_text("b").alias("name"), S.decoded_number("c").alias("number"))
)
query("prj21_mean_and_max", "SELECT nodo_id, date_trunc('hour', ts) AS hour_ts, " + r("avg(value)", "rh_mean") + ", max(value) AS rh_max FROM subhora GROUP BY 1, 2", "subhora")(lambda s: rounded(stats.hourly_features(s, {"rh_mean": ("value", "mean"), "rh_max": ("value", "max"), "none": ("missing", "max")}), "rh_mean"))
query("flt11_month", "SELECT nodo_id, datetime FROM obs WHERE month = 3", "obs")(lambda o: filters.in_period(o, "monthly", month=3).select("nodo_id", "datetime"))
query("flt11_day", "SELECT nodo_id, datetime FROM obs WHERE month = 3 AND day = 14", "obs")(lambda o: filters.in_period(o, "daily", day="03-14").select("nodo_id", "datetime"))
query("flt12_checked", "SELECT nodo_id, max(ghi) AS value FROM obs GROUP BY nodo_id", "obs")(lambda o: filters.checked(o, "ghi", "max").groupBy("nodo_id").agg(S.aggregate("max", "ghi").alias("value")))
query("flt16_complete", "SELECT nodo_id, datetime, temperature FROM obs WHERE temperature IS NOT NULL AND nodo_id IS NOT NULL", "obs")(lambda o: filters.complete_rows(o, ("nodo_id", "temperature")).select("nodo_id", "datetime", "temperature"))
query("flt17_hour", "SELECT nodo_id, ts, value FROM subhora WHERE date_trunc('hour', ts) = (SELECT date_trunc('hour', TIMESTAMP '2024-01-10 13:20:00'))", "subhora")(lambda s: filters.within_hour(s, "2024-01-10 13:20:00").select("nodo_id", "ts", "value"))
query("jn06_renumbered", f"SELECT r.new_id AS nodo_id, o.datetime, o.ghi FROM obs o JOIN (SELECT nodo_id, 1000 - nodo_id AS new_id FROM nodos WHERE nodo_id % 4 <> 0) r ON o.nodo_id = r.nodo_id", "obs", "nodos")(lambda o, n: grid.renumbered(o.select("nodo_id", "datetime", "ghi"), n.where("nodo_id % 4 <> 0").select("nodo_id", (1000 - F.col("nodo_id")).alias("new_id"))))
query("jn07_kept_ids", "SELECT nodo_id, datetime FROM obs WHERE nodo_id IN (SELECT nodo_id FROM nodos WHERE msnm <= 0)", "obs", "nodos")(lambda o, n: filters.keep_ids(o, filters.water_nodes(n)).select("nodo_id", "datetime"))
query("jn08_dropped_ids", "SELECT nodo_id, datetime FROM obs WHERE nodo_id NOT IN (SELECT nodo_id FROM nodos WHERE msnm <= 0)", "obs", "nodos")(lambda o, n: filters.drop_ids(o, filters.water_nodes(n)).select("nodo_id", "datetime"))
query("jn10_time_axis", "SELECT n.nodo_id, s.ts FROM nodos n JOIN (SELECT DISTINCT date_trunc('day', ts) AS ts FROM subhora) s ON true", "nodos", "subhora")(lambda n, s: grid.time_axis(n, s.select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))))
query("win01_by_place", "SELECT nodo_id, row_number() OVER (ORDER BY latitude, longitude, nodo_id) - 1 AS new_id FROM nodos", "nodos")(lambda n: grid.numbered(n, "latitude", "longitude", "nodo_id").select("nodo_id", "new_id"))
query("win03_cell_numbers", f"SELECT nodo_id, dense_rank() OVER (ORDER BY lat_real, lon_real) - 1 AS celda_id FROM {_SNAPPED}", "solicitados")(lambda s: grid.cell_numbers(grid.snap_nodes(s)).select("nodo_id", "celda_id"))
query("win06_duration_rows", "SELECT temperature AS value, row_number() OVER (ORDER BY temperature DESC) AS position, " + r("row_number() OVER (ORDER BY temperature DESC) * 100.0 / count(*) OVER ()", "exceedance_pct") + " FROM obs WHERE temperature IS NOT NULL", "obs")(lambda o: rounded(stats.duration_rows(o, "temperature"), "exceedance_pct"))
query("srt02_days", ORACLE_SQL["agg_day_classes"].removeprefix(WITH) + " ORDER BY month, day", "obs")(stats.classify_days)
query("srt04_first_pending", "SELECT nodo_id FROM solicitados WHERE nodo_id NOT IN (SELECT nodo_id FROM obs) ORDER BY nodo_id LIMIT 25", "solicitados", "obs")(lambda s, o: grid.first_pending(s.select("nodo_id"), o, 25))
query("srt05_preview", "SELECT nodo_id, datetime FROM obs WHERE nodo_id = 7 ORDER BY datetime LIMIT 12", "obs")(lambda o: filters.preview(o, 7, 12).select("nodo_id", "datetime"))
query("srt06_flags_in_order", ORACLE_SQL["agg_flags"].removeprefix(WITH), "obs")(stats.flag_distribution)
query("set02_without_metadata", "SELECT DISTINCT nodo_id FROM obs WHERE nodo_id NOT IN (SELECT nodo_id FROM nodos WHERE nodo_id % 3 = 0)", "obs", "nodos")(lambda o, n: grid.without_metadata(o, n.where("nodo_id % 3 = 0")))
def _third_upserted(n: DataFrame) -> DataFrame:
    """Every third node twice anew (the last stays) and one that is added. The added row is new whatever nodes there are, as in the SQL, so it has a key of its own, not its id."""
    old = n.withColumn("key", F.col("nodo_id"))
    added = n.sparkSession.range(1).select(*(F.lit(v).cast(n.schema[c].dataType).alias(c) for c, v in (("nodo_id", 9999), ("latitude", 1.0), ("longitude", 2.0), ("msnm", 2.5))), F.lit(-1).alias("key"))
    new = old.where("nodo_id % 3 = 0").withColumn("msnm", F.lit(2.5)).unionByName(added).withColumn("source", F.lit("b"))
    return grid.upserted(old, new.union(new.withColumn("source", F.lit("a"))), key="key").select(*n.columns, "source")


query("set05_upsert", "SELECT nodo_id, latitude, longitude, CASE WHEN nodo_id % 3 = 0 THEN 2.5 ELSE msnm END AS msnm, CASE WHEN nodo_id % 3 = 0 THEN 'b' END AS source FROM nodos UNION ALL SELECT 9999, 1.0, 2.0, 2.5, 'b'", "nodos")(
    _third_upserted
)
query("set06_wide", "SELECT datetime, nodo_id, max(ghi) AS ghi, max(temperature) AS temperature FROM obs GROUP BY 1, 2", "obs")(lambda o: stats.wide(o.select("datetime", "nodo_id", F.inline(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).alias("value")) for v in ("ghi", "temperature"))))), ("ghi", "temperature")))

# Curation jobs
_WIDE = ["CAST(sum(rows) AS BIGINT) AS rows", "CAST(sum(rows - 1) AS BIGINT) AS duplicates", "count(DISTINCT nodo_id) AS nodes", "count(DISTINCT (month, day)) AS days", "count(DISTINCT hour) AS hours"]
_WIDE += [f"CAST(sum(n_{k}) AS BIGINT) AS n_{k}" for k in _KINDS] + [f"CAST(sum(nulls_{c}) AS BIGINT) AS nulls_{c}" for c in _OBS_COLUMNS] + ["CAST(sum(filled) AS BIGINT) AS filled"]
_PER_KEY = f"(SELECT nodo_id, datetime, any_value(month) AS month, any_value(day) AS day, any_value(hour) AS hour, count(*) AS rows, " + ", ".join([f"count(*) FILTER ({t}) AS n_{k}" for k, t in _KINDS.items()] + [f"count(*) - count({c}) AS nulls_{c}" for c in _OBS_COLUMNS] + ["count(*) FILTER (fill_flag <> 0) AS filled"]) + f" FROM {_JOINED} GROUP BY nodo_id, datetime)"
query("dq01_integrity", "SELECT *, nodes * days * hours AS expected, nodes * days * hours - rows AS missing, " + r("(nodes * days * hours - rows) * 100.0 / (nodes * days * hours)", "missing_pct", 3) + " FROM (SELECT " + ", ".join(_WIDE) + f" FROM {_PER_KEY})", "obs", "nodos")(quality.integrity_row)
_RAW = lambda o: o.drop("datetime").withColumn("minute", F.lit(30)).withColumnsRenamed({"nodo_id": " Nodo ID", "solar_zenith_angle": "Solar Zenith Angle", "year": "Year "})
_STORED = "CAST(nodo_id AS SMALLINT) AS nodo_id, make_timestamp(year, month, day, hour, 0, 0) AS datetime, CAST(year AS SMALLINT) AS year, CAST(month AS TINYINT) AS month, CAST(day AS TINYINT) AS day, CAST(hour AS TINYINT) AS hour"
query("dq03_consolidated", f"SELECT {_STORED}, ghi, solar_zenith_angle, CAST(cloud_type AS TINYINT) AS cloud_type FROM obs", "obs")(lambda o: curation.consolidated(_RAW(o), curation.WIDE).select("nodo_id", "datetime", "year", "month", "day", "hour", "ghi", "solar_zenith_angle", "cloud_type"))
_GATE = "SELECT rows, nodes, nodes * 600 AS expected, rows = nodes * 600 AS complete FROM (SELECT count(*) AS rows, count(DISTINCT nodo_id) AS nodes FROM {})"
query("dq04_complement_gate", _GATE.format("complemento"), "obs")(lambda o: curation.complement_set(fixtures.complement(o).withColumn("Minute", F.lit(30)), hours=600)[1])
_PROFILE = "SELECT hour, max(ghi) AS ghi FROM obs GROUP BY hour"


def _typical_day(n: DataFrame, o: DataFrame) -> DataFrame:
    """Raw rows of a typical day of each node: the highest value of each hour, with a minute and untidy names."""
    day = n.select("nodo_id", F.lit(2023).alias("Year"), F.lit(6).alias("Month"), F.lit(21).alias("Day"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("Hour"), F.lit(30).alias("Minute"))
    return day.join(o.groupBy(F.col("hour").alias("Hour")).agg(F.max("ghi").alias("GHI")), "Hour", "left")


query("dq05_master", f"SELECT n.nodo_id, TIMESTAMP '2023-06-21' + to_hours(CAST(h.range AS INT)) AS datetime, 2023 AS year, 6 AS month, 21 AS day, CAST(h.range AS INT) AS hour, p.ghi FROM nodos n JOIN range(24) h ON true LEFT JOIN ({_PROFILE}) p ON p.hour = h.range", "nodos", "obs")(
    lambda n, o: curation.master(_typical_day(n, o), nodes=n.count(), hours=24, types=curation.WIDE).select("nodo_id", "datetime", "year", "month", "day", "hour", "ghi")
)
query("dq05_master_gate", _GATE.format("obs"), "obs")(lambda o: curation.count_gate(curation.consolidated(_RAW(o), curation.WIDE), hours=600))
query("dq06_feature_year", "SELECT h.nodo_id, h.hour_ts AS datetime, " + r("mean", "mean") + ", max, minute_30 AS solar_zenith_angle, mode AS cloud_type, CAST(year(h.hour_ts) AS INT) AS year, CAST(month(h.hour_ts) AS INT) AS month, CAST(day(h.hour_ts) AS INT) AS day, CAST(hour(h.hour_ts) AS INT) AS hour" + f" FROM {_HOURLY} h JOIN {_MODE} m ON h.nodo_id = m.nodo_id AND h.hour_ts = m.hour_ts WHERE minute_30 < 85", "subhora")(
    lambda s: rounded(curation.feature_year(s, {"mean": ("value", "mean"), "max": ("value", "max"), "solar_zenith_angle": ("value", "minute_30"), "cloud_type": ("code", "mode")}), "mean")
)
_FUSED = "(SELECT o.* FROM obs o JOIN complemento c ON o.nodo_id = c.nodo_id AND o.year = c.year AND o.month = c.month AND o.day = c.day AND o.hour = c.hour)"
query("dq07_fusion_audit", f"SELECT b AS rows_before, a AS rows_after, b - a AS lost, " + r("a * 100.0 / b", "kept_pct", 3) + f" FROM (SELECT (SELECT count(*) FROM obs) AS b, (SELECT count(*) FROM {_FUSED}) AS a)", "obs")(lambda o: curation.fusion_audit(o, curation.fused(o, fixtures.complement(o))))
query("dq08_fused_24h", "SELECT h.nodo_id, year, month, day, hour, " + r("mean", "mean") + f", max, minute_30, mode, cloud FROM (SELECT *, CAST(year(hour_ts) AS INT) AS year, CAST(month(hour_ts) AS INT) AS month, CAST(day(hour_ts) AS INT) AS day, CAST(hour(hour_ts) AS INT) AS hour FROM {_HOURLY}) h JOIN (SELECT nodo_id, hour_ts, mode, mode + 1 AS cloud FROM {_MODE} WHERE nodo_id % 10 <> 0) m ON h.nodo_id = m.nodo_id AND h.hour_ts = m.hour_ts", "subhora")(
    lambda s: rounded(curation.fused_24h(s, curation.feature_year(s, {"cloud": ("code", "mode")}).where("nodo_id % 10 <> 0").select(*curation.KEYS, (F.col("cloud") + 1).alias("cloud"))), "mean")
)
_ASKED = "SELECT nodo_id, nodo_id % 3 AS region, 2017 + nodo_id % 2 AS year FROM"
query("dq09_states", f"SELECT s.region, s.year, count(*) AS total, count(o.nodo_id) AS present, count(*) - count(o.nodo_id) AS missing, count(*) = count(o.nodo_id) AS complete FROM ({_ASKED} solicitados) s LEFT JOIN (SELECT DISTINCT nodo_id FROM obs WHERE nodo_id % 7 <> 0) o ON s.nodo_id = o.nodo_id GROUP BY s.region, s.year", "solicitados", "obs")(
    lambda s, o: grid.ingest_states(*(x.selectExpr("nodo_id", "nodo_id % 3 AS region", "2017 + nodo_id % 2 AS year") for x in (s, o.where("nodo_id % 7 <> 0"))))
)
query("dq10_without_metadata", "SELECT DISTINCT nodo_id FROM obs WHERE nodo_id NOT IN (SELECT nodo_id FROM nodos WHERE nodo_id % 2 = 0) AND nodo_id <= 40", "obs", "nodos")(lambda o, n: grid.without_metadata(o, n.where("nodo_id % 2 = 0"), n.where("nodo_id <= 40")))
query("dq11_daylight_dataset", "SELECT nodo_id, make_timestamp(year, month, day, hour, 0, 0) AS datetime, year, month, day, hour, ghi, dni, clearsky_ghi, temperature, pressure, wind_speed, cloud_type, solar_zenith_angle, relative_humidity AS rh_mean FROM obs WHERE clearsky_ghi > 0 AND solar_zenith_angle < 85", "obs")(lambda o: curation.daylight_dataset(o)[0])
query("dq11_daylight_report", ORACLE_SQL["agg_retention"].removeprefix(WITH), "obs")(lambda o: curation.daylight_dataset(o)[1])
_FACTS = f"(SELECT nodo_id, lat_real, lon_real, CASE WHEN nodo_id = 77 THEN 1.0 ELSE 0.0 END AS v, TIMESTAMP '2020-01-01' AS datetime FROM {_SNAPPED})"
_facts = lambda s: s.select("nodo_id", F.when(F.col("nodo_id") == 77, 1.0).otherwise(0.0).alias("v"), F.lit("2020-01-01").cast("timestamp_ntz").alias("datetime"))
query("dq13_differing_cells", f"SELECT lat_real, lon_real, datetime FROM {_FACTS} GROUP BY lat_real, lon_real, datetime HAVING count(DISTINCT v) > 1", "solicitados")(lambda s: grid.differing_cells(_facts(s), grid.snap_nodes(s), ["v"]).select("lat_real", "lon_real", "datetime").distinct())
query("dq14_regridded", f"SELECT row_number() OVER (ORDER BY nodo_id) - 1 AS nodo_id, CAST(0 AS DOUBLE) AS v, TIMESTAMP '2020-01-01' AS datetime FROM {_FIRST} WHERE i = 1", "solicitados")(lambda s: curation.regridded(_facts(s).withColumn("v", F.lit(0.0)), grid.snap_nodes(s), ["v"]).select("nodo_id", "v", "datetime"))
# Nodes of a cell share one station's series; planted: some nodes lack the evening, others have another value at noon.
_TWINS = f"(SELECT s.nodo_id, o.datetime, o.hour, o.ghi, o.temperature FROM (SELECT nodo_id, min(nodo_id) OVER (PARTITION BY lat_real, lon_real) AS head FROM {_SNAPPED}) s JOIN obs o ON o.nodo_id = s.head % 100 + 1)"
_PLANTED = f"(SELECT nodo_id, datetime, CASE WHEN nodo_id % 50 = 9 AND hour = 12 THEN ghi + 1 ELSE ghi END AS ghi, temperature FROM {_TWINS} WHERE NOT (nodo_id % 50 = 7 AND hour >= 20))"
_HEADS = f"(SELECT nodo_id AS twin, lat_real, lon_real, min(nodo_id) OVER (PARTITION BY lat_real, lon_real) AS nodo_id FROM {_SNAPPED})"
_HOURS_OF = f"(SELECT h.lat_real, h.lon_real, h.nodo_id, h.twin, p.datetime, count(*) AS n, list_sort(list({{{{'g': p.ghi, 't': p.temperature}}}})) AS l FROM {_HEADS} h JOIN {_PLANTED} p ON p.nodo_id = h.{{}} WHERE h.twin <> h.nodo_id GROUP BY ALL)"
_KEYS_OF = ("lat_real", "lon_real", "nodo_id", "twin", "datetime")
_DIFFER = "SELECT " + ", ".join(f"coalesce(a.{c}, b.{c}) AS {c}" for c in _KEYS_OF) + ", CASE WHEN coalesce(b.n, 0) < coalesce(a.n, 0) THEN 'lacking' WHEN coalesce(b.n, 0) > coalesce(a.n, 0) THEN 'surplus' ELSE 'different' END AS kind FROM " + f"{_HOURS_OF.format('nodo_id')} a FULL JOIN {_HOURS_OF.format('twin')} b ON " + " AND ".join(f"a.{c} = b.{c}" for c in _KEYS_OF) + " WHERE a.l IS DISTINCT FROM b.l"


#: Nodes by what is planted in their series: 7 lacks the evening, 9 has another noon; the others (0) have their station's own.
_PLANT = (0, 7, 9)


def _series(o: DataFrame, planted: bool) -> DataFrame:
    """The series of all stations, each once for every kind of node that has it: (series, datetime, ghi, temperature). Nodes name theirs, so its rows do not grow with them."""
    rows = o.where("nodo_id BETWEEN 1 AND 100").select(F.col("nodo_id").alias("station"), "datetime", "hour", "ghi", "temperature")
    rows = rows.withColumn("plant", F.explode(F.array(*map(F.lit, _PLANT))) if planted else F.lit(0))
    out = rows.where("NOT (plant = 7 AND hour >= 20)").withColumn("ghi", F.when((F.col("plant") == 9) & (F.col("hour") == 12), F.col("ghi") + 1).otherwise(F.col("ghi")))
    return out.select((F.col("station") * 50 + F.col("plant")).alias("series"), "datetime", "ghi", "temperature")


def _sharing(asked: DataFrame, planted: bool) -> DataFrame:
    """Snapped nodes with the series of the station that their cell's first node has."""
    nodes = grid.snap_nodes(asked)
    first = nodes.groupBy(*grid.CELL).agg(F.min("nodo_id").alias("head"))
    kind = F.col("nodo_id") % 50
    plant = F.when(kind.isin(*_PLANT), kind).otherwise(0) if planted else F.lit(0)
    return nodes.join(first, list(grid.CELL)).withColumn("series", (F.col("head") % 100 + 1) * 50 + plant).drop("head")


query("dq13_twins", _DIFFER, "solicitados", "obs")(lambda s, o: grid.differing_cells(_series(o, True), _sharing(s, True), ["ghi", "temperature"], "series"))
query("dq14_gate", f"SELECT DISTINCT lat_real, lon_real, nodo_id, twin FROM ({_DIFFER})", "solicitados", "obs")(lambda s, o: grid.differing_twins(_series(o, True), _sharing(s, True), ["ghi", "temperature"], "series"))
query("dq14_regridded_series", f"SELECT r.new_id AS nodo_id, t.datetime, t.ghi, t.temperature FROM {_TWINS} t JOIN (SELECT nodo_id, row_number() OVER (ORDER BY nodo_id) - 1 AS new_id FROM {_FIRST} WHERE i = 1) r ON r.nodo_id = t.nodo_id", "solicitados", "obs")(
    lambda s, o: curation.regridded(_series(o, False), _sharing(s, False), ["ghi", "temperature"], "series").select("nodo_id", "datetime", "ghi", "temperature")
)
_CANON = f"(SELECT nodo_id, lat_real, lon_real, row_number() OVER (ORDER BY nodo_id) - 1 AS new_id FROM {_FIRST} WHERE i = 1)"
query("dq15_lineage", f"SELECT new_id AS nodo_id, nodo_id AS nodo_id_original, lat_real, lon_real FROM {_CANON}", "solicitados", "obs")(lambda s, o: curation.deduplicated(grid.duplicate_flags(grid.snap_nodes(s)), o)[0].select("nodo_id", "nodo_id_original", "lat_real", "lon_real"))
query("dq15_facts", f"SELECT CAST(c.new_id AS INT) AS nodo_id, o.datetime, o.ghi FROM obs o JOIN {_CANON} c ON o.nodo_id = c.nodo_id", "solicitados", "obs")(lambda s, o: curation.deduplicated(grid.duplicate_flags(grid.snap_nodes(s)), o.select("nodo_id", "datetime", "ghi"))[1])
query("dq15_missing_sources", f"SELECT nodo_id FROM {_CANON} WHERE nodo_id NOT IN (SELECT nodo_id FROM obs)", "solicitados", "obs")(lambda s, o: curation.deduplicated(grid.duplicate_flags(grid.snap_nodes(s)), o)[2])
_KEPT = "(SELECT *, row_number() OVER (ORDER BY nodo_id) - 1 AS new_id FROM nodos WHERE NOT coalesce(msnm <= 0, false))"
query("dq16_nodes", f"SELECT new_id AS nodo_id, nodo_id AS nodo_id_4501, latitude, longitude, msnm FROM {_KEPT}", "nodos", "obs")(lambda n, o: curation.without_nodes(n, o, filters.water_nodes(n))[0])
query("dq16_facts", f"SELECT CAST(k.new_id AS INT) AS nodo_id, o.datetime, o.ghi FROM obs o JOIN {_KEPT} k ON o.nodo_id = k.nodo_id", "nodos", "obs")(lambda n, o: curation.without_nodes(n, o.select("nodo_id", "datetime", "ghi"), filters.water_nodes(n))[1])
query("dq17_candidates", "SELECT nodo_id, msnm FROM nodos WHERE msnm <= 100", "nodos")(lambda n: curation.water_candidates(n, 100.0)[0].select("nodo_id", "msnm"))
query("dq17_statistics", ORACLE_SQL["grid_elevation_summary"].removeprefix(WITH).replace("msnm <= 0", "msnm <= 100"), "nodos")(lambda n: curation.water_candidates(n, 100.0)[1])
query("dq18_reconstructed", f"SELECT f.nodo_id, f.lat_real, f.lon_real, dense_rank() OVER (ORDER BY f.lat_real, f.lon_real) - 1 AS celda_id, i > 1 AS is_duplicate FROM {_FIRST} f", "solicitados")(lambda s: curation.reconstructed(s).select("nodo_id", "lat_real", "lon_real", "celda_id", "is_duplicate"))
_STEP = "CAST(0.04 AS DOUBLE)"
_ENDS_OF = "SELECT " + ", ".join(f"round(floor(min({c}) / {_STEP}) * {_STEP}, 4) AS low_{c}, round(ceil(max({c}) / {_STEP}) * {_STEP}, 4) AS high_{c}" for c in ("latitude", "longitude")) + " FROM nodos"
_AXES = [f"(SELECT unnest(range(0, CAST(round((high_{c} - low_{c}) / {_STEP}) AS BIGINT) + 1)) AS k, low_{c} FROM ({_ENDS_OF})) {c[:3]}" for c in ("latitude", "longitude")]
_GRID = "(SELECT " + ", ".join(f"round(CAST({c[:3]}.k AS DOUBLE) * {_STEP} + {c[:3]}.low_{c}, 4) AS {c}" for c in ("latitude", "longitude")) + f" FROM {_AXES[0]} JOIN {_AXES[1]} ON true)"
query("dq19_calibrated_grid", f"SELECT row_number() OVER (ORDER BY latitude, longitude) - 1 AS nodo_id, latitude, longitude FROM {_GRID} WHERE {_INSIDE}", "nodos")(lambda n: curation.grid_over(n, 0.04, fixtures.POLYGON))
_ZERO = "(SELECT nodo_id, CASE WHEN nodo_id % 9 = 0 THEN 0 ELSE latitude END AS latitude, longitude FROM nodos)"
_zero = lambda n: n.select("nodo_id", F.when(F.col("nodo_id") % 9 == 0, 0.0).otherwise(F.col("latitude")).alias("latitude"), "longitude")
query("dq20_pending", f"SELECT nodo_id FROM {_ZERO} WHERE latitude = 0 OR longitude = 0", "nodos")(lambda n: curation.pending_coordinates(_zero(n)).select("nodo_id"))
query("dq20_confirmed", f"SELECT z.nodo_id, z.latitude AS lat_local, z.longitude AS lon_local, coalesce(c.latitude, z.latitude) AS latitude, coalesce(c.longitude, z.longitude) AS longitude, c.latitude IS NOT NULL AS corregido FROM {_ZERO} z LEFT JOIN (SELECT * FROM nodos WHERE nodo_id % 9 = 0) c ON z.nodo_id = c.nodo_id", "nodos")(
    lambda n: curation.with_confirmed(_zero(n), n.where("nodo_id % 9 = 0").withColumnsRenamed({"latitude": "lat_nrel", "longitude": "lon_nrel"}))
)
query("dq22_node_audit", "SELECT count(*) AS rows, count(*) = 8760 AS complete, CAST(18 AS INT) AS columns, " + "CAST(" + " + ".join(f"count(*) - count({c})" for c in _OBS_COLUMNS) + " AS BIGINT) AS nulls FROM obs WHERE nodo_id = 5", "obs")(lambda o: quality.node_audit(o, 5).drop("types"))
query("dq23_report_profile", ORACLE_SQL["agg_daily_profile"].removeprefix(WITH).replace("temperature", "ghi"), "obs", "nodos")(lambda o, n: rounded(curation.report(o, n)["profile"], "mean", "std", "low", "high"))
query("dq23_report_resource", ORACLE_SQL["agg_resource_map"].removeprefix(WITH), "obs", "nodos")(lambda o, n: rounded(curation.report(o, n)["resource"], "value"))
query("dq24_topology", "SELECT CAST(row_number() OVER (ORDER BY nodo_id) - 1 AS INT) AS nodo_id, latitude, longitude, msnm FROM nodos", "nodos")(
    lambda n: curation.topology(n.agg(F.transform(F.sort_array(F.collect_list(F.struct("nodo_id", "latitude", "longitude", "msnm"))), lambda x: F.struct(x["latitude"].cast("string").cast("binary").alias("latitude"), x["longitude"].alias("longitude"), x["msnm"].cast("string").cast("binary").alias("elevation"))).alias("meta")))
)
QUERIES["src08_matrix_steps"] = lambda spark, sf_dir: matrix_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=10.0, steps=(100, 119))
ORACLE_SQL["src08_matrix_steps"] = "SELECT vec_id AS step, CAST(i - 1 AS INT) AS nodo_id, CAST(embedding[i] AS DOUBLE) / 10 AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings WHERE vec_id BETWEEN 100 AND 119)"

QUERIES["src_matrix"] = lambda spark, sf_dir: matrix_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=10.0)
ORACLE_SQL["src_matrix"] = "SELECT vec_id AS step, CAST(i - 1 AS INT) AS nodo_id, CAST(embedding[i] AS DOUBLE) / 10 AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"
