"""Curation jobs: consolidation, daylight sets, fusion of two sources, audits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import decoded_number, tidy_name, timestamp_of
from ..operators.filters import daylight_mask
from ..operators.grid import CELL, differing_cells, differing_twins, id_map
from ..operators import filters, quality, stats
from ..operators.filters import in_polygon
from ..operators.grid import candidate_grid, cell_numbers, duplicate_flags, elevation_summary, ingest_states, match_report, reindexed, renumbered, snap_nodes
from ..operators.order import numbered
from ..operators.stats import hourly, hourly_features
from ..sources import versions
from ..sources.files import node_files, write_ordered

KEYS = ["nodo_id", "year", "month", "day", "hour"]
# Fixed names.
RENAMES = {"global_horizontal_uv_irradiance_(280-400nm)": "ghi_uv_280_400", "global_horizontal_uv_irradiance_(295-385nm)": "ghi_uv_295_385"}
COMPACT = {"nodo_id": "smallint", "year": "smallint", "month": "tinyint", "day": "tinyint", "hour": "tinyint", "cloud_type": "tinyint", "cloud_fill_flag": "tinyint", "fill_flag": "tinyint"}
#: For grids with ids beyond 32,767. Parquet stores both types as 32 bits, so this takes no more room on disk.
WIDE = COMPACT | {"nodo_id": "int"}


def consolidated(raw: DataFrame, types: dict = COMPACT, lenient: bool = False) -> DataFrame:
    """Tidy names, timestamp in second place, no minute, compact types. A value that does not fit its type is an error, or null if lenient;
    WIDE has room for ids that COMPACT has not."""
    df = raw.toDF(*(tidy_name(c) for c in raw.columns)).withColumnsRenamed(RENAMES)
    df = df.withColumn("datetime", timestamp_of()).drop("minute")
    df = df.withColumns({c: F.col(c).try_cast(t) if lenient else F.col(c).cast(t) for c, t in types.items() if c in df.columns})
    return df.select("nodo_id", "datetime", *(c for c in df.columns if c not in ("nodo_id", "datetime")))


def daylight_set(df: DataFrame) -> DataFrame:
    return daylight_mask(df).withColumnRenamed("relative_humidity", "rh_mean")


def fused(physical: DataFrame, extra: DataFrame, drop=("cloud_type",)) -> DataFrame:
    """Inner join on node and hour; columns that the second source knows better are dropped from the first. Both sides shuffle once."""
    return physical.drop(*drop).join(extra, KEYS)


def fused_24h(sub: DataFrame, extra: DataFrame) -> DataFrame:
    """Sub-hourly rows to hours, with calendar columns, joined with the complement."""
    h = hourly(sub)
    h = h.select("nodo_id", *(getattr(F, f)("hour_ts").alias(n) for f, n in (("year", "year"), ("month", "month"), ("dayofmonth", "day"), ("hour", "hour"))), "mean", "max", "minute_30", "mode")
    return h.join(extra, KEYS)


def hour_audit(sub: DataFrame, stored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """All hours whose stored mean (nodo_id, hour_ts, stored) differs from the recomputed one, or that only one side has."""
    both = hourly(sub).select("nodo_id", "hour_ts", "mean").join(stored, ["nodo_id", "hour_ts"], "full")
    return both.where(F.col("mean").isNull() | F.col("stored").isNull() | (F.abs(F.col("mean") - F.col("stored")) > tolerance))


def regridded(facts: DataFrame, nodes: DataFrame, variables, series: str = "nodo_id") -> DataFrame:
    """Keep one node per cell, under its new number; an error names a cell, two of its nodes and an hour where they differ. Runs a job to see that.
    `series` is the column of both tables that says which facts are a node's; nodes can share one."""
    bad = differing_twins(facts, nodes, variables, series).orderBy(*CELL, "twin").first()
    if bad is not None:
        hour = differing_cells(facts, nodes.where(F.col("nodo_id").isin(bad.nodo_id, bad.twin)), variables, series).orderBy("datetime").first()
        raise ValueError(f"nodes {bad.nodo_id} and {bad.twin} of cell {tuple(bad[c] for c in CELL)} differ" + (f" at {hour.datetime}: {hour.kind}" if hour else ""))
    ids = id_map(nodes).where("nodo_id = representative").select("nodo_id", "new_id")
    if series != "nodo_id":
        ids = ids.join(nodes.select("nodo_id", series), "nodo_id").drop("nodo_id")
    return facts.join(ids, series).drop(series).withColumnRenamed("new_id", "nodo_id")


# Fixed names: the columns of the daylight dataset.
DAYLIGHT = ("nodo_id", "year", "month", "day", "hour", "ghi", "dni", "dhi", "clearsky_ghi", "temperature", "pressure", "wind_speed", "precipitable_water", "cloud_type", "solar_zenith_angle", "relative_humidity")
NODE_ORDER = ("nodo_id", "datetime")


def count_gate(df: DataFrame, hours: int = 8760, nodes: int | None = None) -> DataFrame:
    """One row: rows, nodes, expected = nodes x hours, and whether they agree; only then may sources be cleaned up."""
    n = F.count_distinct("nodo_id") if nodes is None else F.lit(nodes).cast("long")
    out = df.groupBy("nodo_id").agg(F.count("*").alias("rows")).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), n.alias("nodes"))
    return out.withColumn("expected", F.col("nodes") * hours).withColumn("complete", F.col("rows") == F.col("expected"))


def consolidate_year(spark, folder: str, out: str, hours: int = 8760, partitions: int | None = None, types: dict = COMPACT) -> DataFrame:
    """Node files of a year to one ordered table at `out`; returns the count gate of what was written."""
    write_ordered(consolidated(node_files(spark, folder), types), out, partitions)
    return count_gate(spark.read.parquet(out), hours)


def consolidate_complete(nodes: DataFrame, raw: DataFrame, out: str, keys=("region", "year"), types: dict = COMPACT) -> list[dict]:
    """Consolidate each (region, year) of `raw` whose nodes are all there and that the table at `out` does not hold yet; the keys done now.

    `nodes` and `raw` have the keys and nodo_id. Each part is claimed before it is written, and looked for again under the claim, so of two runs at once one writes
    it and the other leaves it; a run that dies leaves no part. Regions and years are few: their states come to the driver.
    """
    spark, keys = raw.sparkSession, list(keys)
    done = []
    for state in ingest_states(nodes, raw, keys).where("complete").select(*keys).collect():
        own = state.asDict()
        text = {k: str(v) for k, v in own.items()}
        here = lambda: any({k: str(v) for k, v in part.items()} == text for part in versions.parts(spark, out))  # noqa: B023, E731
        if here():
            continue
        try:
            with versions.claim(spark, out, "-".join(f"{k}={v}" for k, v in text.items())):
                if not here():
                    some = raw.where(" and ".join(f"`{k}` <=> '{v}'" for k, v in text.items())).join(nodes.select(*keys, "nodo_id").distinct(), [*keys, "nodo_id"], "left_semi")
                    versions.publish(consolidated(some, types).repartitionByRange("nodo_id", "datetime").sortWithinPartitions("nodo_id", "datetime"), out, keys)
                    done.append(own)
        except versions.Taken:
            continue
    return done


def complement_set(raw: DataFrame, hours: int = 8760) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Complement files: tidied rows without minute, their count gate and their null counts."""
    df = raw.toDF(*(tidy_name(c) for c in raw.columns)).drop("minute")
    return df, count_gate(df, hours), quality.null_counts(df)


def master(raw: DataFrame, nodes: int, hours: int = 8760, types: dict = COMPACT) -> DataFrame:
    """The consolidated rows of a whole directory; an error if they are not nodes x hours. Runs a job to count them."""
    df = consolidated(raw, types)
    gate = count_gate(df, hours, nodes).first()
    if not gate.complete:
        raise ValueError(f"{gate.rows} rows, {gate.expected} expected")
    return df


def feature_year(sub: DataFrame, rules: dict, zenith_max: float = 85.0) -> DataFrame:
    """Sub-hourly rows to hourly features with calendar columns, by daylight (conditions whose column is missing are left out)."""
    h = hourly_features(sub, rules)
    h = h.withColumnRenamed("hour_ts", "datetime").withColumns({"year": F.year("datetime"), "month": F.month("datetime"), "day": F.dayofmonth("datetime"), "hour": F.hour("datetime")})
    return daylight_mask(h, zenith_max)


def fusion_audit(physical: DataFrame, fused_rows: DataFrame) -> DataFrame:
    """One row: rows before, rows after the fusion, how many were lost, and the share kept."""
    before = physical.agg(F.count("*").alias("rows_before"))
    out = before.withColumn("rows_after", fused_rows.agg(F.count("*")).scalar()).withColumn("lost", F.col("rows_before") - F.col("rows_after"))
    return out.withColumn("kept_pct", F.round(F.try_divide(F.col("rows_after") * 100.0, "rows_before"), 3))


def daylight_dataset(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The daylight dataset (its columns, time index second, humidity renamed, ordered by node and time) and the retention report."""
    kept = F.lit(True)
    if "clearsky_ghi" in df.columns:
        kept = kept & (F.col("clearsky_ghi") > 0)
    if "solar_zenith_angle" in df.columns:
        kept = kept & (F.col("solar_zenith_angle") < 85)
    out = df.select(*(c for c in DAYLIGHT if c in df.columns)).withColumn("datetime", timestamp_of())
    out = out.select("nodo_id", "datetime", *(c for c in out.columns if c not in NODE_ORDER))
    return daylight_set(out).orderBy(*NODE_ORDER), quality.retention(df, kept)


def deduplicated(nodes: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Canonical nodes (not is_duplicate) under gapless ids with nodo_id_original, their facts under the new ids, and canonical ids without facts."""
    canon = reindexed(nodes.where(~F.col("is_duplicate")).drop("is_duplicate"))
    lineage = canon.withColumnRenamed("nodo_id", "nodo_id_original").withColumnRenamed("new_id", "nodo_id")
    missing = canon.select("nodo_id").join(facts.select("nodo_id"), "nodo_id", "left_anti")
    return lineage, renumbered(facts, canon), missing


def without_nodes(nodes: DataFrame, facts: DataFrame, dropped: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the listed ids under gapless ids, with the ids of the version before (nodo_id_4501) and of any earlier one, and their facts."""
    kept = reindexed(filters.drop_ids(nodes, dropped))
    return kept.withColumnRenamed("nodo_id", "nodo_id_4501").withColumnRenamed("new_id", "nodo_id"), renumbered(facts, kept)


def water_candidates(nodes: DataFrame, threshold: float = 0.0, ids=None) -> tuple[DataFrame, DataFrame]:
    """Candidates by elevation, or the listed ids, and the elevation summary of all nodes."""
    found = filters.water_nodes(nodes, threshold) if ids is None else nodes.where(F.col("nodo_id").isin(list(ids)))
    return found, elevation_summary(nodes, threshold)


def reconstructed(requested: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Snapped coordinates with cell number and duplicate flag. With confirmed ones (nodo_id, lat_nrel, lon_nrel), all of those nodes must snap
    to them within 1e-6, or it is an error; that runs a job."""
    nodes = snap_nodes(requested)
    if confirmed is not None:
        pairs = nodes.select("nodo_id", *CELL).join(confirmed, "nodo_id").withColumnsRenamed({"lat_nrel": "lat_local", "lon_nrel": "lon_local"})
        report = match_report(pairs).first()
        if report.matching != report.nodes:
            raise ValueError(f"{report.nodes - report.matching} of {report.nodes} confirmed nodes do not snap to their coordinates")
    return duplicate_flags(cell_numbers(nodes))


def calibrated_grid(spark, lat_range, lon_range, step: float, edges) -> DataFrame:
    """The candidate grid of an extent, clipped by a polygon, with gapless ids by latitude and longitude."""
    inside = in_polygon(candidate_grid(spark, lat_range, lon_range, step), edges)
    return numbered(inside.drop("nodo_id"), "latitude", "longitude", name="nodo_id").select("nodo_id", "latitude", "longitude")


def grid_over(nodes: DataFrame, step: float, edges=None, margin: float = 0.0) -> DataFrame:
    """The candidate grid over the extent of a table's nodes and a margin, anchored at multiples of the step, clipped by a polygon if one is given, with gapless ids
    by latitude and longitude. Runs a job for the extent; nodes without coordinates give an empty grid."""
    ends = nodes.agg(*(f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("low", F.min), ("high", F.max)))).first()
    if ends.low_latitude is None or ends.low_longitude is None:
        return nodes.sparkSession.createDataFrame([], "nodo_id long, latitude double, longitude double")
    anchored = lambda low, high: (round(math.floor((low - margin) / step) * step, 4), round(math.ceil((high + margin) / step) * step, 4))
    grid = candidate_grid(nodes.sparkSession, anchored(ends.low_latitude, ends.high_latitude), anchored(ends.low_longitude, ends.high_longitude), step)
    clipped = grid if edges is None else in_polygon(grid, edges)
    return numbered(clipped.drop("nodo_id"), "latitude", "longitude", name="nodo_id").select("nodo_id", "latitude", "longitude")


def pending_coordinates(nodes: DataFrame) -> DataFrame:
    """Nodes with a zero coordinate, or not corrected yet where the table says."""
    test = (F.col("latitude") == 0) | (F.col("longitude") == 0)
    return nodes.where(test | ~F.coalesce("corregido", F.lit(False)) if "corregido" in nodes.columns else test)


def with_confirmed(nodes: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Confirmed coordinates (nodo_id, lat_nrel, lon_nrel) in place of the requested ones, which stay as lat_local and lon_local."""
    both = nodes.withColumnsRenamed({"latitude": "lat_local", "longitude": "lon_local"}).join(confirmed.select("nodo_id", "lat_nrel", "lon_nrel"), "nodo_id", "left")
    out = both.withColumns({"latitude": F.coalesce("lat_nrel", "lat_local"), "longitude": F.coalesce("lon_nrel", "lon_local"), "corregido": F.col("lat_nrel").isNotNull()})
    return out.drop("lat_nrel", "lon_nrel")


def topology(meta: DataFrame, column: str = "meta") -> DataFrame:
    """Node dimension from one row of an array of records whose values are bytes or numbers: the id is the position, elevation becomes msnm."""
    rows = meta.select(F.posexplode(column).alias("nodo_id", "row")).select("nodo_id", "row.*")
    fields = {f.name: decoded_number(f"`{f.name}`") for f in rows.schema if f.dataType.typeName() == "binary"}
    return rows.withColumns(fields).withColumnRenamed("elevation", "msnm")


def report(df: DataFrame, nodes: DataFrame, variable: str = "ghi") -> dict[str, DataFrame]:
    """The tables of a report in one call, only those whose variables exist; lazy, so `df.persist()` first if all are read."""
    have = set(df.columns)
    out = {"info": quality.summary(df), "integrity": quality.integrity_row(df, nodes)}
    if variable in have:
        out |= {"histogram": stats.histogram(df, variable), "profile": stats.daily_profile(df, variable), "pivot": stats.month_hour(df, variable), "resource": stats.resource_map(df, variable, nodes)}
    numbers = [v for v in ("ghi", "dni", "dhi", "temperature", "relative_humidity", "pressure", "wind_speed") if v in have]
    if len(numbers) > 1:
        out["correlations"] = stats.correlations(df, numbers)
    if {"wind_speed", "wind_direction"} <= have:
        out["rose"] = stats.wind_rose(df)
    return out
