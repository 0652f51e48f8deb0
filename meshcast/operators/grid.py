"""The node grid: snapping, cells, duplicates, reindexing and upserts. Node tables are dimensions; facts only join them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import snapped
from .order import numbered, preceded

CELL = ("lat_real", "lon_real")


def snap_nodes(requested: DataFrame, step: float = 0.04, lat_offset: float = 0.01, lon_offset: float = 0.02) -> DataFrame:
    return requested.withColumn("lat_real", snapped(F.col("lat_local"), lat_offset, step)).withColumn("lon_real", snapped(F.col("lon_local"), lon_offset, step))


def first_per_cell(nodes: DataFrame) -> DataFrame:
    """The node with the smallest id of each cell."""
    return nodes.withColumn("i", F.row_number().over(Window.partitionBy(*CELL).orderBy("nodo_id"))).where("i = 1").drop("i")


def duplicate_flags(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*CELL).orderBy("nodo_id")) > 1)


def reindexed(nodes: DataFrame, column: str = "nodo_id", name: str = "new_id") -> DataFrame:
    """A gapless number from 0 in the order of a unique numeric column."""
    return numbered(nodes, column, name=name)


def id_map(nodes: DataFrame) -> DataFrame:
    """(nodo_id, representative, new_id): every node's cell representative and that one's new number."""
    reps = reindexed(first_per_cell(nodes).select(*CELL, F.col("nodo_id").alias("representative")), "representative")
    return nodes.select("nodo_id", *CELL).join(reps, list(CELL)).select("nodo_id", "representative", "new_id")


def multiplicity(nodes: DataFrame) -> DataFrame:
    """How many cells hold how many nodes."""
    return nodes.groupBy(*CELL).agg(F.count("*").alias("nodes_in_cell")).groupBy("nodes_in_cell").agg(F.count("*").alias("cells"))


def grid_steps(nodes: DataFrame, column: str = "lat_real") -> DataFrame:
    """Distinct differences of neighbouring distinct coordinates; neighbours meet across bands of the order, too."""
    d = nodes.select(F.round(column, 4).alias("c")).where("c is not null").distinct()
    return preceded(d, "c").select(F.round(F.col("c") - F.col("previous"), 4).alias("step")).where("step is not null").distinct()


def match_report(nodes: DataFrame) -> DataFrame:
    dlat, dlon = F.abs(F.col("lat_real") - F.col("lat_local")), F.abs(F.col("lon_real") - F.col("lon_local"))
    return nodes.agg(F.count("*").alias("nodes"), F.count_if((dlat < 1e-6) & (dlon < 1e-6)).alias("matching"), F.avg(dlat).alias("mean_dlat"), F.avg(dlon).alias("mean_dlon"), F.max(dlat).alias("max_dlat"), F.max(dlon).alias("max_dlon")).withColumn(
        "aligned", (F.col("max_dlat") < 0.001) & (F.col("max_dlon") < 0.001)
    )


def elevation_summary(nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    e = F.col("msnm")
    return nodes.agg(F.min(e).alias("min"), F.percentile(e, F.lit(0.5)).alias("median"), F.max(e).alias("max"), F.count_if(e == 0).alias("at_zero"), F.round(F.try_divide(F.count_if(e <= threshold) * 100.0, F.count("*")), 3).alias("candidate_pct"), *((f("longitude").alias(n) for f, n in ((F.min, "lon_min"), (F.max, "lon_max"))) if "longitude" in nodes.columns else ()))


def candidate_grid(spark, lat_range, lon_range, step: float) -> DataFrame:
    """All grid points of an extent with ids by latitude, then longitude; one range, no join."""
    rows, cols = (int(round((b - a) / step)) + 1 for a, b in (lat_range, lon_range))
    i = F.col("id")
    return spark.range(rows * cols).select(i.alias("nodo_id"), F.round(F.floor(i / cols) * step + lat_range[0], 4).alias("latitude"), F.round(i % cols * step + lon_range[0], 4).alias("longitude"))


def upserted(old: DataFrame, new: DataFrame, key: str = "nodo_id") -> DataFrame:
    """Rows of `new` win, whole; columns are united; sorted by key. Of equal keys in `new`, the last of the given order stays: the row whose
    fields are largest, compared in turn."""
    fields = [F.col(c) for c in new.columns if c != key]
    if fields:
        new = new.groupBy(key).agg(F.max(F.struct(*fields)).alias("row")).select(key, "row.*")
    else:
        new = new.distinct()
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(key)


def pending(nodes: DataFrame, present: DataFrame) -> DataFrame:
    return nodes.join(present.select("nodo_id").distinct(), "nodo_id", "left_anti")


def ingest_state(nodes: DataFrame, present: DataFrame) -> DataFrame:
    """One row: total, present, missing and whether the set is complete."""
    seen = present.select("nodo_id").distinct().withColumn("seen", F.lit(True))
    return nodes.select("nodo_id").distinct().join(seen, "nodo_id", "left").agg(F.count("*").alias("total"), F.count("seen").alias("present"), F.count_if(F.col("seen").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def _row_hash(variables, seed: str, *more):
    """64 bits of a row's values, as a decimal that sums exactly; a null is told from every value and place."""
    values = [x for v in variables for x in (F.col(v).isNull(), F.col(v))]
    return F.xxhash64(F.lit(seed), *more, *values).cast("decimal(38,0)")


def fingerprints(facts: DataFrame, variables, *keys) -> list:
    """Aggregates n, sum_a and sum_b that equal multisets of rows share in any order: their number and the sums of two 64-bit hashes."""
    return [F.count("*").alias("n"), F.sum(_row_hash(variables, "a", *keys)).alias("sum_a"), F.sum(_row_hash(variables, "b", *keys)).alias("sum_b")]


def _unequal(facts: DataFrame, nodes: DataFrame, variables, series: str) -> DataFrame:
    """(lat_real, lon_real, nodo_id, twin, first_series, twin_series) of the nodes whose series is not that of the first node of their cell."""
    found = facts.groupBy(F.col(series).alias("series")).agg(*fingerprints(facts, variables, "datetime"))
    prints = nodes.select("nodo_id", *CELL, F.col(series).alias("series")).join(found, "series", "left").withColumn("print", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "sum_a", "sum_b"))
    first = prints.groupBy(*CELL).agg(F.min_by(F.struct("nodo_id", "series", "print"), "nodo_id").alias("first"))
    both = prints.join(first, list(CELL))
    same = (F.col("print.n") == F.col("first.print.n")) & F.col("print.sum_a").eqNullSafe(F.col("first.print.sum_a")) & F.col("print.sum_b").eqNullSafe(F.col("first.print.sum_b"))
    return both.where(~same).select(*CELL, F.col("first.nodo_id").alias("nodo_id"), F.col("nodo_id").alias("twin"), F.col("first.series").alias("first_series"), F.col("series").alias("twin_series"))


def differing_twins(facts: DataFrame, nodes: DataFrame, variables, series: str = "nodo_id") -> DataFrame:
    """(lat_real, lon_real, nodo_id, twin): nodes whose series is not that of the first node of their cell, in any variable, hour or number of rows.

    `series` is the column of both tables that says which facts are a node's; nodes can share one, which is then stored and read once. One row per series and
    node is shuffled, not the facts; nodes without facts have an empty series.
    """
    return _unequal(facts, nodes, variables, series).drop("first_series", "twin_series")


def differing_cells(facts: DataFrame, nodes: DataFrame, variables, series: str = "nodo_id") -> DataFrame:
    """(lat_real, lon_real, nodo_id, twin, datetime, kind) where a node's series differs from that of the first node of its cell: its hour is `lacking`, `surplus`
    (also by the number of repeated rows) or `different`. Only series that differ as a whole are compared hour by hour, each pair of series once; `series` as in
    `differing_twins`."""
    bad = _unequal(facts, nodes, variables, series)
    pair = ("first_series", "twin_series")
    sides = bad.select(*pair).distinct().select(*pair, F.explode(F.array(*(F.struct(F.col(c).alias("series"), F.lit(c == pair[0]).alias("is_first")) for c in pair))).alias("x")).select(*pair, "x.*")
    rows = facts.select(F.col(series).alias("series"), "datetime", *(_row_hash(variables, seed).alias(f"h_{seed}") for seed in "ab")).join(sides, "series")
    side = lambda c, first: F.sum(F.when(F.col("is_first") == first, c).otherwise(0))
    hours = rows.groupBy(*pair, "datetime").agg(*(side(F.col(c) if c != "n" else F.lit(1), f).alias(f"{c}_{int(f)}") for c in ("n", "h_a", "h_b") for f in (True, False)))
    kind = F.when(F.col("n_0") < F.col("n_1"), "lacking").when(F.col("n_0") > F.col("n_1"), "surplus").when((F.col("h_a_0") != F.col("h_a_1")) | (F.col("h_b_0") != F.col("h_b_1")), "different")
    hours = hours.withColumn("kind", kind).where("kind is not null").select(*pair, "datetime", "kind")
    return bad.join(hours, list(pair)).select(*CELL, "nodo_id", "twin", "datetime", "kind")


def cell_numbers(nodes: DataFrame, name: str = "celda_id") -> DataFrame:
    """The number of each coordinate pair, from 0 by latitude and longitude; nodes of a cell share it."""
    cells = numbered(nodes.select(*CELL).distinct(), *CELL, name=name)
    return nodes.join(cells, list(CELL), "left")


def time_axis(nodes: DataFrame, steps: DataFrame, time: str = "ts", slices: int = 64) -> DataFrame:
    """Every node at every distinct step of a time axis. Steps are dealt into slices by their hash and each node goes to every slice, so neither side of
    the join is held whole; the result has nodes x steps rows by its meaning."""
    axis = steps.select(time).distinct().withColumn("slice", F.pmod(F.xxhash64(time), F.lit(slices)).cast("int"))
    spread = nodes.select("nodo_id", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    return spread.join(axis, "slice").select("nodo_id", time)


def renumbered(facts: DataFrame, ids: DataFrame, old: str = "nodo_id", new: str = "new_id") -> DataFrame:
    """Facts under the new ids of a map (old, new); rows of unmapped ids drop out."""
    return facts.join(ids.select(F.col(old).alias("nodo_id"), F.col(new).alias("renamed")), "nodo_id").withColumn("nodo_id", F.col("renamed").cast(facts.schema["nodo_id"].dataType)).drop("renamed").select(*facts.columns)


def first_pending(nodes: DataFrame, present: DataFrame, n: int) -> DataFrame:
    return pending(nodes, present).orderBy("nodo_id").limit(n)


def ingest_states(nodes: DataFrame, present: DataFrame, keys=("region", "year")) -> DataFrame:
    """Per region and year: total, present, missing, and whether the year can be consolidated."""
    keys = list(keys)
    seen = present.select(*keys, "nodo_id").distinct().withColumn("seen", F.lit(True))
    out = nodes.select(*keys, "nodo_id").distinct().join(seen, [*keys, "nodo_id"], "left").groupBy(*keys)
    return out.agg(F.count("*").alias("total"), F.count("seen").alias("present"), F.count_if(F.col("seen").isNull()).alias("missing")).withColumn("complete", F.col("missing") == 0)


def without_metadata(present: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Ids that have data but no row in the node dimension; of `known` ids only, if they are given."""
    ids = present.select("nodo_id").distinct().join(nodes.select("nodo_id"), "nodo_id", "left_anti")
    return ids if known is None else ids.join(known.select("nodo_id"), "nodo_id", "left_semi")
