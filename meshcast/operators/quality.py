"""Integrity metrics and anomalies of observations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import PRESSURE_TOLERANCE, RANGES, surface_pressure

KEY = ("nodo_id", "datetime")
#: Slices of the nodes in which their hours are counted.
SLICES = 4
#: Numbers of 64 bits that hold the hours of a group.
WORDS = 8


# Days of a year as bits of six numbers, two months in each, and the hours of a day as those of a seventh.
_DAYS = [f"bit_or(CASE WHEN month IN ({m}, {m + 1}) AND day BETWEEN 1 AND 31 THEN shiftleft(1L, CAST((month - {m}) * 32 + day AS INT)) END)" for m in range(1, 12, 2)]
_HOURS = "bit_or(CASE WHEN hour BETWEEN 0 AND 23 THEN shiftleft(1L, CAST(hour AS INT)) END)"


def calendar_bits() -> list:
    """Aggregates day_bits0 to day_bits5 and hour_bits: the distinct (month, day) and hours of a group in 56 bytes. Values outside the calendar are not counted."""
    return [F.expr(e).alias(f"day_bits{i}") for i, e in enumerate(_DAYS)] + [F.expr(_HOURS).alias("hour_bits")]


def _calendar(days, hours) -> list:
    ones = lambda bits: F.coalesce(F.bit_count(bits), F.lit(0)).cast("long")
    return [sum(map(ones, days[1:]), ones(days[0])).alias("days"), ones(hours).alias("hours")]


def united_bits() -> list:
    """Aggregates days and hours over rows of calendar_bits."""
    return _calendar([F.bit_or(f"day_bits{i}") for i in range(len(_DAYS))], F.bit_or("hour_bits"))


def calendar_counts() -> list:
    """Aggregates days and hours over rows."""
    return _calendar([F.expr(e) for e in _DAYS], F.expr(_HOURS))


def hours_of_nodes(df: DataFrame) -> DataFrame:
    """(nodo_id, bucket, rows, times): rows and distinct times per node and bucket of 64 * WORDS hours.

    The hours are bits of WORDS numbers, so a group is a few numbers of fixed size in a hash table, however many of its hours are there: full series shuffle a row for
    64 * WORDS hours, sparse ones no more rows than they have. Most of what a group of one number takes is its key and place in the table, so one of eight takes
    about half as much again, and series with an hour in each 64 have an eighth of the groups. Times need not be whole hours: each time within the hour has buckets of
    its own. Rows without a time are a group with one time, the null.
    """
    # Each slice of the nodes is a scan and tasks of its own, so that the hash table of a task holds a slice of its rows' groups.
    part = F.pmod(F.xxhash64("nodo_id"), F.lit(SLICES))
    df = reduce(DataFrame.union, (df.select(*KEY).where(part == i) for i in range(SLICES)))
    micros, hour = F.unix_micros(F.col("datetime").cast("timestamp")), F.lit(3_600_000_000)
    offset = F.pmod(micros, hour)
    rows = df.select("nodo_id", offset.alias("offset"), F.call_function("div", micros - offset, hour).alias("hour_number"))
    span = F.lit(64 * WORDS)
    at = F.pmod("hour_number", span)
    bucket = F.call_function("div", F.col("hour_number") - at, span) * hour + F.col("offset")
    rows = rows.select("nodo_id", bucket.alias("bucket"), F.call_function("div", at, F.lit(64)).alias("word"), F.expr("shiftleft(1L, CAST(pmod(hour_number, 64) AS INT))").alias("bit"))
    out = rows.groupBy("nodo_id", "bucket").agg(F.count("*").alias("rows"), *(F.expr(f"bit_or(CASE WHEN word = {i} THEN bit ELSE 0L END)").alias(f"bits{i}") for i in range(WORDS)))
    times = sum((F.bit_count(f"bits{i}") for i in range(1, WORDS)), F.bit_count("bits0"))
    return out.select("nodo_id", "bucket", "rows", F.when(F.col("bucket").isNull(), 1).otherwise(times).cast("long").alias("times"))


def times_of_nodes(df: DataFrame) -> DataFrame:
    """(nodo_id, rows, times): rows and distinct times per node."""
    return hours_of_nodes(df).groupBy("nodo_id").agg(F.sum("rows").alias("rows"), F.sum("times").alias("times"))


def _expected(out: DataFrame) -> DataFrame:
    out = out.withColumn("expected", F.col("nodes") * F.col("days") * F.col("hours")).withColumn("missing", F.col("expected") - F.col("rows"))
    return out.withColumn("missing_pct", F.round(F.try_divide(F.col("missing") * 100.0, F.col("expected")), 3))


def completeness(df: DataFrame) -> DataFrame:
    """One row: rows, nodes, days (month and day), hours, expected = their product, missing and missing_pct. One row per node is shuffled."""
    per = df.groupBy("nodo_id").agg(F.count("*").alias("rows"), *calendar_bits())
    return _expected(per.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("nodo_id").alias("nodes"), *united_bits()))


def node_completeness(df: DataFrame) -> DataFrame:
    """(nodo_id, rows, times, surplus, expected, missing): per node its distinct times, the rows beyond them, and how many times it lacks of all days x hours of
    the table. Buckets of hours are shuffled, not rows."""
    all_ = df.agg(*calendar_counts()).select((F.col("days") * F.col("hours")).alias("expected"))
    return times_of_nodes(df).withColumn("surplus", F.col("rows") - F.col("times")).withColumn("expected", all_.scalar()).withColumn("missing", F.col("expected") - F.col("times"))


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each node and time."""
    return hours_of_nodes(df).agg(F.coalesce(F.sum(F.col("rows") - F.col("times")), F.lit(0)).alias("duplicates"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """All rows of repeated keys."""
    return df.withColumn("copies", F.count("*").over(Window.partitionBy(*KEY))).where("copies > 1")


def incomplete_nodes(df: DataFrame) -> DataFrame:
    """Nodes whose row count differs from days x hours."""
    keys = df.select("month", "day", "hour").distinct()
    expected = keys.agg((F.count_distinct("month", "day") * F.count_distinct("hour")).alias("expected")).scalar()
    return df.groupBy("nodo_id").agg(F.count("*").alias("n")).withColumn("expected", expected).where("n <> expected")


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    """(column, n) of the columns that hold nulls."""
    columns = columns or df.columns
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n")) for c in columns]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x")).where("n > 0")


def _outside(column: str):
    lo, hi = RANGES[column]
    return (F.col(column) < lo) | (F.col(column) > hi)


def with_elevation(df: DataFrame, nodes: DataFrame) -> DataFrame:
    return df.join(nodes.select("nodo_id", "msnm"), "nodo_id", "left")


def pressure_outside():
    """Over the tolerance around the pressure expected at the node's elevation; the fixed range where that is unknown."""
    return F.when(F.col("msnm").isNull(), _outside("pressure")).otherwise(F.abs(F.col("pressure") - surface_pressure(F.col("msnm"))) > PRESSURE_TOLERANCE)


def _tests(df: DataFrame) -> dict:
    out = {f"rango_{c}": pressure_outside() if c == "pressure" and "msnm" in df.columns else _outside(c) for c in RANGES if c in df.columns}
    sun = F.col("solar_zenith_angle") < 90
    physical = {
        "ghi_over_clearsky": (("ghi", "clearsky_ghi"), F.col("ghi") > F.col("clearsky_ghi")),
        "ghi_zero_by_day": (("ghi",), (F.col("ghi") == 0) & sun),
        "dni_zero_by_day": (("dni",), (F.col("dni") == 0) & sun),
        "ghi_negative": (("ghi",), F.col("ghi") < 0),
    }
    return out | {k: test for k, (need, test) in physical.items() if set(need) <= set(df.columns)}


def anomaly_counts(df: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(kind, n) of every range and physical test, one pass."""
    if nodes is not None:
        df = with_elevation(df, nodes)
    parts = [F.struct(F.lit(k).alias("kind"), F.count_if(t).alias("n")) for k, t in _tests(df).items()]
    return df.agg(F.array(*parts).alias("x")).select(F.inline("x"))


def anomalies(df: DataFrame, nodes: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(nodo_id, datetime, kind) of every failed test and repeated key, at most `limit` per kind if it is given (by node and time)."""
    rows = df if nodes is None else with_elevation(df, nodes)
    tags = F.array_compact(F.array(*(F.when(t, F.lit(k)) for k, t in _tests(rows).items())))
    out = rows.select(*KEY, F.explode(tags).alias("kind")).union(duplicate_rows(df).select(*KEY, F.lit("duplicate")))
    if limit is None:
        return out
    # First per (kind, node), then per kind: no window holds more than limit rows of a node.
    for keys in (("kind", "nodo_id"), ("kind",)):
        out = out.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy(*KEY))).where(F.col("i") <= limit).drop("i")
    return out


def integrity_row(df: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All integrity metrics as one wide row: completeness, duplicates, filled rows, nulls_<column> and n_<kind> of anomalies.

    The counts come from one scan that shuffles a row per task; nodes and duplicates from another, of nodes and times alone.
    """
    rows = df if nodes is None else with_elevation(df, nodes)
    tests = {f"n_{k}": F.count_if(t) for k, t in _tests(rows).items()} | {f"nulls_{c}": F.count_if(F.col(c).isNull()) for c in df.columns}
    tests |= {"filled": F.count_if(F.col("fill_flag") != 0)} if "fill_flag" in df.columns else {}
    counts = rows.agg(F.count("*").alias("rows"), *calendar_counts(), *(e.alias(k) for k, e in tests.items()))
    keys = times_of_nodes(rows).agg(F.coalesce(F.sum(F.col("rows") - F.col("times")), F.lit(0)).alias("duplicates"), F.count("nodo_id").alias("nodes"))
    return _expected(counts.crossJoin(keys).select("rows", "duplicates", "nodes", "days", "hours", *tests))


def node_audit(df: DataFrame, node: int, expected: int = 8760) -> DataFrame:
    """One row of a node: rows, whether they are as many as expected, columns, nulls of all columns together, and the types."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    types = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return df.where(F.col("nodo_id") == node).agg(F.count("*").alias("rows"), (F.count("*") == expected).alias("complete"), F.lit(len(df.columns)).alias("columns"), nulls.cast("long").alias("nulls"), F.lit(types).alias("types"))


def integrity(df: DataFrame, nodes: DataFrame) -> dict[str, DataFrame]:
    """The wide row and its details."""
    return {"row": integrity_row(df, nodes), "completeness": completeness(df), "duplicates": duplicate_count(df), "incomplete_nodes": incomplete_nodes(df), "nulls": null_counts(df), "anomalies": anomaly_counts(df, nodes), "filled": filled(df)}


def filled(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("fill_flag") != 0).alias("filled"), F.round(F.try_divide(F.count_if(F.col("fill_flag") != 0) * 100.0, F.count("*")), 3).alias("filled_pct"))


def summary(df: DataFrame) -> DataFrame:
    keys = df.groupBy("nodo_id", "year", "month", "day").agg(F.count("*").alias("n"), F.min("datetime").alias("lo"), F.max("datetime").alias("hi"))
    return keys.agg(F.sum("n").alias("rows"), F.count_distinct("nodo_id").alias("nodes"), F.count_distinct("year", "month", "day").alias("days"), F.min("lo").alias("first_time"), F.max("hi").alias("last_time"))


def retention(df: DataFrame, kept) -> DataFrame:
    """Rows before and after a condition."""
    return df.agg(F.count("*").alias("rows_before"), F.count_if(kept).alias("rows_after"), F.round(F.try_divide(F.count_if(kept) * 100.0, F.count("*")), 3).alias("kept_pct"))
