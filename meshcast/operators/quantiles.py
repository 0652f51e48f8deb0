"""Exact quantiles by refinement: no buffer of all values, no shuffle of rows.

A pass counts the values of each group in equal bins of an interval, with the least and largest value of each bin. The bins that hold wanted ranks become the
intervals of the next pass, until an interval is a single value. Passes read the rows; only the counts of bins are shuffled, and only those of wanted bins come to
the driver: at most CELLS of them a pass.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 256
CELLS = 1 << 18


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    return math.floor(at), math.ceil(at), at - math.floor(at)


def exact_quantiles(df: DataFrame, value: str, percentages, by: str | None = None, bins: int = BINS) -> DataFrame:
    """One row per group of `by` (or one of all rows): by, and q0, q1, ... for each of `percentages`, interpolated as `percentile` does; the groups without a value are left
    out. Nulls do not count; NaN is larger than every number. Runs jobs: one for counts and ends, then one per refinement.

    Groups x percentages x bins may be at most CELLS, or it is an error: many groups have `percentile` on their own small buffers.
    """
    spark, percentages = df.sparkSession, list(percentages)
    group = F.lit(0) if by is None else F.col(by)
    x = F.col("x")
    rows = df.select(group.alias("g"), F.col(value).cast("double").alias("x")).where("x is not null")
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    counts = rows.groupBy("g").agg(
        F.count("*").alias("n"), F.count_if(x == float("-inf")).alias("under"), F.count_if(finite).alias("finite"), F.count_if(x == float("inf")).alias("over"), F.min(F.when(finite, x)).alias("low"), F.max(F.when(finite, x)).alias("high")
    )
    ends = counts.limit(CELLS).collect()
    if len(ends) * max(1, len(percentages)) * bins > CELLS:
        raise ValueError(f"{len(ends)} groups of {len(percentages)} percentages pass the bound of {CELLS} counts")
    wanted: dict = {}  # (group, rank among its finite values) -> value
    intervals: dict = {}  # (group, low, high) -> values below it
    own = {r.g: r for r in ends}

    def fixed(r, rank: int):
        """The value of a rank that is no finite one, else None."""
        if rank < r.under:
            return float("-inf")
        return None if rank < r.under + r.finite else float("inf") if rank < r.under + r.finite + r.over else float("nan")

    for r in ends:
        for p in percentages:
            for rank in _ranks(r.n, p)[:2]:
                if fixed(r, rank) is None:
                    wanted[r.g, rank - r.under] = r.low if r.low == r.high else None
        if r.finite:
            intervals[r.g, r.low, r.high] = 0
    at = {(g, rank): (own[g].low, own[g].high) for (g, rank), v in wanted.items() if v is None}
    types = f"g {rows.schema['g'].dataType.simpleString()}, low double, high double"
    while at:
        open_ = sorted({(g, *ends_) for (g, _), ends_ in at.items()}, key=str)
        table = F.broadcast(spark.createDataFrame(open_, types).withColumnRenamed("g", "at"))
        # Halves, as a difference of two doubles can pass the largest one. Intervals are disjoint, so a value is in one at most.
        share = (x / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        found = rows.where(finite).join(table, F.col("g").eqNullSafe(F.col("at")) & x.between(F.col("low"), F.col("high")))
        found = found.groupBy("g", "low", "high", F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        parts: dict = {}
        for r in found.collect():
            parts.setdefault((r.g, r.low, r.high), []).append((r.bin, r.n, r.least, r.most))
        below: dict = {}
        for key, some in parts.items():
            before = intervals[key]
            for _, n, least, most in sorted(some):
                below[key[0], before, n] = (least, most, key)
                before += n
        for (g, rank), ends_ in list(at.items()):
            for (h, before, n), (least, most, key) in below.items():
                if h == g and key[1:] == ends_ and before <= rank < before + n:
                    intervals[g, least, most] = before
                    if least == most:
                        wanted[g, rank] = least
                        del at[g, rank]
                    else:
                        at[g, rank] = (least, most)
                    break
    out = []
    for r in ends:
        values = []
        for p in percentages:
            lower, upper, part = _ranks(r.n, p)
            a, b = (fixed(r, k) if fixed(r, k) is not None else wanted[r.g, k - r.under] for k in (lower, upper))
            values.append(a if lower == upper or a == b else (upper - (lower + part)) * a + part * b)
        out.append((r.g, *map(float, values)))
    table = spark.createDataFrame(out, f"g {rows.schema['g'].dataType.simpleString()}, " + ", ".join(f"q{i} double" for i in range(len(percentages))))
    return table.drop("g") if by is None else table.withColumnRenamed("g", by)
