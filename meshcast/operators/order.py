"""Numbers and predecessors in a global order, without a window over all rows.

Rows are dealt into bands of the order, cut at keys of a bounded sample; each band is sorted by itself, and only one row per band (its count, or its
last row) meets in one task. Choosing the cuts runs one job over the keys when the DataFrame is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = 64
SAMPLE = 20  # keys per band


def banded_by(df: DataFrame, order, bands: int = BANDS, name: str = "band") -> DataFrame:
    """df with the number of each row's band in the order of columns or expressions, nulls first; rows of equal keys share a band."""
    named = lambda: F.struct(*(c.alias(f"k{i}") if isinstance(c, Column) else F.col(c).alias(f"k{i}") for i, c in enumerate(order)))
    keys = df.select(named().alias("key"))
    types = keys.schema["key"].dataType
    # The keys of smallest hash: the same ones for the same rows, however they are dealt.
    drawn = keys.distinct().orderBy(F.xxhash64("key")).limit(bands * SAMPLE).agg(F.sort_array(F.collect_list("key")).alias("keys")).first()["keys"]
    cuts = [drawn[i * len(drawn) // bands] for i in range(1, bands)] if len(drawn) >= bands else drawn[1:]
    if not cuts:
        return df.withColumn(name, F.lit(0))
    table = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, types))) for cut in cuts))
    key = _spare(df, "key_of_" + name)
    out = df.withColumns({key: named(), name: F.lit(0)})
    # By halving in a table of the cuts, a column at a time: the compiled code stays small, whatever the number of bands.
    for half in (2**i for i in reversed(range(len(cuts).bit_length()))):
        out = out.withColumn(name, F.col(name) + F.when(F.col(key) >= F.get(table, F.col(name) + (half - 1)), half).otherwise(0))
    return out.drop(key)


def _keys(order):
    return [c if isinstance(c, Column) else F.col(c) for c in order]


def _spare(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def numbered(df: DataFrame, *order, name: str = "new_id", bands: int = BANDS) -> DataFrame:
    """Gapless numbers from 0 in the order of any columns or expressions, nulls first; rows of equal keys take theirs in any order."""
    band, at, before, place = (_spare(df, c) for c in ("band", "at", "before", "place"))
    dealt = banded_by(df, order, bands, band)
    # One row per band.
    ahead = dealt.groupBy(band).agg(F.count("*").alias("rows")).select(F.col(band).alias(at), F.coalesce(F.sum("rows").over(Window.orderBy(band).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    dealt = dealt.withColumn(place, F.row_number().over(Window.partitionBy(band).orderBy(*_keys(order))).cast("long") - 1)
    out = dealt.join(F.broadcast(ahead), F.col(band) == F.col(at))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col(place) + F.col(before)).cast("long").alias(name))


def preceded(df: DataFrame, column: str, name: str = "previous", bands: int = BANDS) -> DataFrame:
    """df with the value before each one in the order of a column without nulls; null for the first. Each band's first row takes the last one of the bands before."""
    band, at, border, own = (_spare(df, c) for c in ("band", "at", "border", "own"))
    dealt = banded_by(df, [column], bands, band)
    last = dealt.groupBy(band).agg(F.max(column).alias("last"))
    # One row per band.
    borders = last.select(F.col(band).alias(at), F.last("last", True).over(Window.orderBy(band).rowsBetween(Window.unboundedPreceding, -1)).alias(border))
    lagged = dealt.withColumn(own, F.lag(column).over(Window.partitionBy(band).orderBy(column)))
    out = lagged.join(F.broadcast(borders), F.col(band) == F.col(at))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != name), F.coalesce(own, border).alias(name))


def running_sum(df: DataFrame, n: str, *order, name: str = "before", bands: int = BANDS) -> DataFrame:
    """df with the sum of the whole number `n` over all rows ahead of each one in an order without equal keys; 0 for the first."""
    band, at, ahead, own = (_spare(df, c) for c in ("band", "at", "ahead", "own"))
    dealt = banded_by(df, order, bands, band)
    # One row per band.
    sums = dealt.groupBy(band).agg(F.sum(n).alias("sum")).select(F.col(band).alias(at), F.coalesce(F.sum("sum").over(Window.orderBy(band).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(ahead))
    upto = F.sum(n).over(Window.partitionBy(band).orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, -1))
    out = dealt.withColumn(own, F.coalesce(upto, F.lit(0))).join(F.broadcast(sums), F.col(band) == F.col(at))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c != name), (F.col(own) + F.col(ahead)).alias(name))
