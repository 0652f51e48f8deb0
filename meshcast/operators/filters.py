"""Predicates on observations; all of them reach the scan, except those on derived columns."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import aggregate, analysable, clearness


def _list(x):
    return list(x) if isinstance(x, (list, tuple, set, range)) else [x]


def on_days(df: DataFrame, day) -> DataFrame:
    """day: a day of the month, 'MM-DD', 'YYYY-MM-DD', or a list of these."""
    keep = F.lit(False)
    for d in _list(day):
        if isinstance(d, int):
            keep = keep | (F.col("day") == d)
            continue
        m = re.fullmatch(r"(?:(\d{4})-)?(\d{2})-(\d{2})", d)
        if not m:
            raise ValueError(f"not a day: {d!r}")
        one = (F.col("month") == int(m[2])) & (F.col("day") == int(m[3]))
        keep = keep | (one & (F.col("year") == int(m[1])) if m[1] else one)
    return df.where(keep)


def filtered(df: DataFrame, nodes=None, months=None, hours=None, day=None, between=None, daylight=False, zenith_max=90.0, cloud=None, where=None, columns=None, with_kt=False) -> DataFrame:
    """All filters in one; `where` is SQL text and comes last. kt is added on request, or if `columns` names it."""
    for name, values in (("nodo_id", nodes), ("month", months), ("hour", hours), ("cloud_type", cloud)):
        if values is not None:
            df = df.where(F.col(name).isin(_list(values)))
    if day is not None:
        df = on_days(df, day)
    if between is not None:
        df = df.where(F.col("datetime").between(*(F.lit(x).cast("timestamp_ntz") for x in between)))
    if daylight:
        df = df.where(F.col("solar_zenith_angle") < zenith_max)
    if with_kt or columns and "kt" in columns:
        df = df.withColumn("kt", clearness())
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df


def daylight_mask(df: DataFrame, zenith_max: float = 85.0) -> DataFrame:
    """clearsky_ghi > 0 and zenith < zenith_max; a condition whose column is missing is left out."""
    if "clearsky_ghi" in df.columns:
        df = df.where("clearsky_ghi > 0")
    if "solar_zenith_angle" in df.columns:
        df = df.where(F.col("solar_zenith_angle") < zenith_max)
    return df


#: Coordinates with decimals are no exact doubles: a point is on an edge if its two products agree to this share.
BORDER = 1e-12


def edge_bands(edges, most: int = 4096) -> tuple[float, float, int, list]:
    """(lowest latitude, band height, bands, [(band, edges)]): which (x1, y1, x2, y2) edges touch which of equal bands of latitude.

    As many bands as edges, but fewer where edges are so tall that they would stand in more than eight bands on average.
    """
    low, high = min(min(e[1], e[3]) for e in edges), max(max(e[1], e[3]) for e in edges)
    bands = max(1, min(len(edges), most))
    while True:
        height = (high - low) / bands or 1.0
        spans = [[min(math.floor((y - low) / height), bands - 1) for y in (min(e[1], e[3]), max(e[1], e[3]))] for e in edges]
        if bands == 1 or sum(b - a + 1 for a, b in spans) <= 8 * len(edges):
            break
        bands = (bands + 1) // 2
    index: dict[int, list] = {}
    for e, (a, b) in zip(edges, spans):
        for band in range(a, b + 1):
            index.setdefault(band, []).append(e)
    return low, height, bands, sorted(index.items())


def in_polygon(points: DataFrame, edges, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Points strictly inside a polygon, given as (x1, y1, x2, y2) edges, by the parity of crossings; points on an edge or a corner are outside.

    A box filter comes first and reaches the scan. Each remaining point then meets the edges of its band of latitude only. That index is broadcast: at most eight
    rows of five numbers for each edge of the caller's list. Points without coordinates are outside.
    """
    edges = [tuple(map(float, e)) for e in edges]
    if not edges:
        return points.limit(0)
    x, y = F.col(lon), F.col(lat)
    xs, ys = [e[i] for e in edges for i in (0, 2)], [e[i] for e in edges for i in (1, 3)]
    low, height, bands, index = edge_bands(edges)
    inside = points.where((x > min(xs)) & (x < max(xs)) & (y > min(ys)) & (y < max(ys)))
    table = points.sparkSession.createDataFrame(index, "band_of_edges int, edges_of_band array<struct<x1: double, y1: double, x2: double, y2: double>>")

    def crosses(e):
        return ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)

    def touches(e):
        across, along = (e.x2 - e.x1) * (y - e.y1), (e.y2 - e.y1) * (x - e.x1)
        on_line = F.abs(across - along) <= (F.abs(across) + F.abs(along)) * BORDER
        return on_line & x.between(F.least(e.x1, e.x2), F.greatest(e.x1, e.x2)) & y.between(F.least(e.y1, e.y2), F.greatest(e.y1, e.y2))

    band = F.least(F.floor((y - low) / height), F.lit(bands - 1)).cast("int")
    met = inside.join(F.broadcast(table), band == F.col("band_of_edges"))
    own = F.col("edges_of_band")
    return met.where((F.size(F.filter(own, crosses)) % 2 == 1) & ~F.exists(own, touches)).drop("band_of_edges", "edges_of_band")


def near_focus(nodes: DataFrame, focus, margin: float) -> DataFrame:
    """Neighbours of a set of node ids within its bounding box and a margin, without the set itself."""
    inside = nodes.where(F.col("nodo_id").isin(list(focus)))
    lo_x, hi_x, lo_y, hi_y = (inside.agg(f(c)).scalar() for c in ("longitude", "latitude") for f in (F.min, F.max))
    box = F.col("longitude").between(lo_x - margin, hi_x + margin) & F.col("latitude").between(lo_y - margin, hi_y + margin)
    return nodes.where(box & ~F.col("nodo_id").isin(list(focus)))


def sample_nodes(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    return nodes.orderBy(F.xxhash64("nodo_id", F.lit(seed)), "nodo_id").limit(n)


#: Periods: the argument that each one needs, and its filter.
_PERIODS = {
    "annual": (None, lambda df, _: df),
    "monthly": ("month", lambda df, month: df.where(F.col("month") == int(month))),
    "daily": ("day", on_days),
}


def in_period(df: DataFrame, period: str = "annual", month: int | None = None, day: str | None = None) -> DataFrame:
    """Rows of a year, a month (1 to 12) or a day ('MM-DD' or 'YYYY-MM-DD'). Unknown periods, a lacking argument and periods without rows are errors; a job looks
    for the first row."""
    if period not in _PERIODS:
        raise ValueError(f"{period!r} is no period; known: {', '.join(_PERIODS)}")
    argument, chosen = _PERIODS[period]
    value = {"month": month, "day": day}.get(argument)
    if argument and not value:
        raise ValueError(f"{period} rows are chosen by {argument}=")
    out = chosen(df, value)
    if out.isEmpty():
        raise ValueError(f"no rows in this {period} period")
    return out


def checked(df: DataFrame, variable: str, agg: str = "mean") -> DataFrame:
    """df itself, if it has the variable and the aggregate is known; kt counts where its parts are there."""
    if variable not in df.columns and not (variable == "kt" and {"ghi", "clearsky_ghi"} <= set(df.columns)):
        raise ValueError(f"unknown variable {variable!r}; one of {', '.join(analysable(df))}")
    aggregate(agg, F.lit(0))
    return df


def water_nodes(nodes: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Nodes at or below an elevation; unknown elevations are left out."""
    return nodes.where(F.col("msnm") <= threshold)


def complete_rows(df: DataFrame, columns) -> DataFrame:
    return df.na.drop(subset=list(columns))


def within_hour(sub: DataFrame, hour, ts: str = "ts") -> DataFrame:
    """Sub-hourly rows of one hour, as a range that reaches the scan."""
    lo = F.date_trunc("hour", F.lit(hour).cast("timestamp_ntz")).cast("timestamp_ntz")
    return sub.where((F.col(ts) >= lo) & (F.col(ts) < lo + F.expr("INTERVAL 1 HOUR")))


def keep_ids(df: DataFrame, ids: DataFrame, key: str = "nodo_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str = "nodo_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def preview(df: DataFrame, node: int, n: int = 5) -> DataFrame:
    return df.where(F.col("nodo_id") == node).orderBy("datetime").limit(n)


def selection(nodes: DataFrame, steps) -> DataFrame:
    """Node ids chosen by steps in order: ("add", edges), ("remove", edges), ("add_ids", ids), ("remove_ids", ids), ("add_water", m), ("reset", None)."""
    chosen = nodes.select("nodo_id").limit(0)
    for what, value in steps:
        kind = what.partition("_")[2]
        if what == "reset":
            chosen = nodes.select("nodo_id").limit(0)
            continue
        part = {"": lambda: in_polygon(nodes, value), "ids": lambda: nodes.where(F.col("nodo_id").isin(_list(value))), "water": lambda: water_nodes(nodes, value)}[kind]().select("nodo_id")
        chosen = chosen.union(part).distinct() if what.startswith("add") else chosen.subtract(part)
    return chosen
