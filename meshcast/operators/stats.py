"""Grouped statistics of observations. All of them aggregate partially before the one shuffle on their key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import CLOUD_TYPE, aggregate, banded, clearness, label_of, labelled_bands, sector
from .order import running_sum
from .quantiles import exact_quantiles

FLAGS = ("cloud_type", "cloud_fill_flag", "fill_flag")


def with_coordinates(df: DataFrame, nodes: DataFrame, how: str = "left") -> DataFrame:
    """Join the node dimension by nodo_id. Spark broadcasts it by its measured size."""
    return df.join(nodes.select("nodo_id", "latitude", "longitude"), "nodo_id", how)


#: Distinct values of a variable (of a group) up to which `percentile`, which keeps them all in a buffer, is used; beyond, quantiles are found by refinement.
BUFFERED = 50_000


def _buffered(df: DataFrame, variables, by: str | None = None) -> bool:
    """Whether no variable (in no group of `by`) has more than about BUFFERED distinct values. Runs a job."""
    seen = df.groupBy(*([by] if by else [])).agg(F.greatest(F.lit(0), *(F.approx_count_distinct(v) for v in variables)).alias("n")).agg(F.max("n").alias("n")).first()
    return (seen.n or 0) <= BUFFERED


def describe(df: DataFrame, variables, percentiles=(0.05, 0.25, 0.5, 0.75, 0.95), accuracy: int | None = None) -> DataFrame:
    """One row per variable. Percentiles are exact: in one pass for variables of few distinct values, else by refinement (jobs run at once), so no
    buffer holds more than about BUFFERED values; `accuracy` gives approximate ones in one pass."""
    names = [f"p{round(p * 100):02d}" for p in percentiles]
    one_pass = accuracy is not None or not percentiles or _buffered(df, variables)
    quantile = lambda c, p: F.percentile(c, F.lit(p)) if accuracy is None else F.percentile_approx(c, p, accuracy).cast("double")
    cols = []
    for v in variables:
        c = F.col(v)
        parts = [F.lit(v).alias("variable"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min")]
        parts += [(quantile(c, p) if one_pass else F.lit(None).cast("double")).alias(n) for p, n in zip(percentiles, names)]
        parts += [F.max(c).cast("double").alias("max"), F.count_if(c.isNull()).alias("nulls"), F.round(F.try_divide(F.count_if(c.isNull()) * 100.0, F.count("*")), 2).alias("null_pct")]
        cols.append(F.struct(*parts))
    out = df.agg(F.array(*cols).alias("rows")).select(F.inline("rows"))
    if one_pass:
        return out
    long = df.select(F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value")) for v in variables))).alias("x")).select("x.*")
    found = exact_quantiles(long, "value", percentiles, by="variable")
    return out.drop(*names).join(F.broadcast(found.withColumnsRenamed({f"q{i}": n for i, n in enumerate(names)})), "variable", "left").select(*out.columns)


def node_summary(df: DataFrame, variable: str, aggs=("mean", "std", "min", "max"), nodes: DataFrame | None = None) -> DataFrame:
    out = df.groupBy("nodo_id").agg(*(aggregate(a, variable).alias(a) for a in aggs))
    return out if nodes is None else with_coordinates(out, nodes)


def flag_distribution(df: DataFrame) -> DataFrame:
    """(flag, code, n, pct, label), ordered by flag and code."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(f).alias("flag"), F.col(f).cast("int").alias("code")) for f in FLAGS))).alias("x")).select("x.*")
    counts = long.groupBy("flag", "code").agg(F.count("*").alias("n"))
    # Every row has each flag once, so the rows of a flag are all rows.
    total = F.sum("n").over(Window.partitionBy("flag"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 3)).withColumn("label", F.when(F.col("flag") == "cloud_type", label_of("code", CLOUD_TYPE))).orderBy("flag", "code")


def classify_days(df: DataFrame, by_node: bool = False, clear: float = 0.65, overcast: float = 0.35, digits: int = 8) -> DataFrame:
    """Mean daylight kt per day (or node and day) and its class; days alone come in their order. The mean is rounded to `digits` decimals and classed as such:
    at a limit, the order in which doubles were added decides nothing."""
    keys = ["month", "day"] + (["nodo_id"] if by_node else [])
    out = df.where("solar_zenith_angle < 90").groupBy(*keys).agg(F.round(F.avg(clearness()), digits).alias("kt"))
    out = out.where("kt is not null").withColumn("category", labelled_bands(F.col("kt"), ((clear, "clear"), (overcast, "partial")), "overcast"))
    return out if by_node else out.orderBy(*keys)


def day_counts(days: DataFrame) -> DataFrame:
    """Days per class."""
    return days.groupBy("category").agg(F.count("*").alias("days"))


def compare_years(df: DataFrame, variable: str, years, by: str = "month", agg: str = "mean") -> DataFrame:
    """by 'month' or 'nodo_id': a column per year, and for two years delta and delta_pct; by 'total': a row per year. kt is compared by daylight only."""
    if variable == "kt":
        df = df.where("solar_zenith_angle < 90").withColumn("kt", clearness())
    if by == "total":
        return df.where(F.col("year").isin(list(years))).groupBy("year").agg(aggregate(agg, variable).alias("value"))
    out = df.where(F.col("year").isin(list(years))).groupBy(by).agg(*(aggregate(agg, F.when(F.col("year") == y, F.col(variable))).alias(f"y{y}") for y in years))
    if len(years) == 2:
        a, b = (F.col(f"y{y}") for y in years)
        out = out.withColumn("delta", b - a).withColumn("delta_pct", F.try_divide((b - a) * 100, a))
    return out


def histogram(df: DataFrame, variable: str, bins: int = 60) -> DataFrame:
    """(bin, low, high, n) of equal bins from the minimum to the maximum, empty bins included; the last one is closed."""
    v = F.col(variable).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    flat = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select((F.col("lo") - flat).alias("lo"), (F.col("hi") + flat).alias("hi"))
    lo, width = ends.select("lo").scalar(), ends.select((F.col("hi") - F.col("lo")) / bins).scalar()
    at = F.least(F.floor((v - lo) / width).cast("int"), F.lit(bins - 1))
    counts = df.where(v.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), lo.alias("lo"), width.alias("width")).where("lo is not null")
    grid = grid.join(counts, "bin", "left")
    return grid.select("bin", (F.col("bin") * F.col("width") + F.col("lo")).alias("low"), ((F.col("bin") + 1) * F.col("width") + F.col("lo")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def centre(df: DataFrame, variable: str) -> DataFrame:
    """Mean and median, the marks of a histogram. The median is exact and found as in `describe`."""
    mean = F.avg(variable).alias("mean")
    if _buffered(df, [variable]):
        return df.agg(mean, F.median(variable).alias("median"))
    return df.agg(mean).withColumn("median", exact_quantiles(df, variable, [0.5]).scalar())


def time_series(df: DataFrame, variable: str, agg: str = "mean") -> DataFrame:
    return df.groupBy("datetime").agg(aggregate(agg, variable).alias("value"))


def daily_profile(df: DataFrame, variable: str) -> DataFrame:
    out = df.groupBy("hour").agg(F.avg(variable).alias("mean"), F.stddev_samp(variable).alias("std"))
    return out.withColumn("low", F.col("mean") - F.col("std")).withColumn("high", F.col("mean") + F.col("std"))


def correlations(df: DataFrame, variables) -> DataFrame:
    """Pearson, pairwise complete, one pass: (a, b, r)."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias("r")) for i, a in enumerate(variables) for b in variables[i + 1 :]]
    return df.agg(F.array(*pairs).alias("rows")).select(F.inline("rows"))


def running_total(df: DataFrame, key: str, n: str, descending: bool = False) -> DataFrame:
    """`before`: the sum of n over the rows ahead of each in the order of the number `key` (unique, not null), and `all`: that of all rows, without a global window."""
    order = -F.col(key) if descending else F.col(key)
    return running_sum(df, n, order).withColumn("all", df.agg(F.sum(n)).scalar())


def spearman_matrix(df: DataFrame, variables) -> DataFrame:
    """(a, b, r): rank correlations of all pairs, each over the rows that have both values, with average ranks for ties; null where a variable does not vary.
    NaN counts as missing.

    One unpivoted count of the values of each pair is scanned; ranks of all sides come from its sums by one pass in ranges of (side, value), and all pairs are one
    aggregate. Choosing the ranges runs a job.
    """
    variables = list(variables)
    pairs = [(a, b) for i, a in enumerate(variables) for b in variables[i + 1 :]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, r double")
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    both = [F.when(known(a) & known(b), F.struct(F.lit(k).alias("pair"), (F.col(a).cast("double") + 0.0).alias("x"), (F.col(b).cast("double") + 0.0).alias("y"))) for k, (a, b) in enumerate(pairs)]
    counts = df.select(F.explode(F.array_compact(F.array(*both))).alias("v")).select("v.*").groupBy("pair", "x", "y").agg(F.count("*").alias("n"))
    sides = counts.select(F.explode(F.array(F.struct((F.col("pair") * 2).alias("side"), F.col("x").alias("v")), F.struct((F.col("pair") * 2 + 1).alias("side"), F.col("y").alias("v")))).alias("s"), "n")
    sides = sides.groupBy("s.side", "s.v").agg(F.sum("n").alias("n"))
    # One row per side: what stands ahead of it.
    starts = sides.groupBy("side").agg(F.sum("n").alias("n")).select(F.col("side").alias("of"), F.coalesce(F.sum("n").over(Window.orderBy("side").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    ranks = running_sum(sides, "n", "side", "v").join(F.broadcast(starts), F.col("side") == F.col("of")).select("side", "v", (F.col("before") - F.col("start") + (F.col("n") + 1) / 2.0).alias("rank"))
    ranked = counts
    for side, value in ((0, "x"), (1, "y")):
        own = ranks.where(F.col("side") % 2 == side).select(F.floor(F.col("side") / 2).cast("int").alias("pair"), F.col("v").alias(value), F.col("rank").alias(f"r{value}"))
        ranked = ranked.join(own, ["pair", value])
    n, x, y = F.col("n"), F.col("rx"), F.col("ry")
    s = ranked.groupBy("pair").agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    r = F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.sqrt((F.col("n") * F.col("xx") - F.col("x") * F.col("x")) * (F.col("n") * F.col("yy") - F.col("y") * F.col("y"))))
    names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    return names.join(s.select("pair", r.alias("r")), "pair", "left").select("a", "b", "r")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation of the complete pairs, average ranks for ties; one row (a, b, r)."""
    return spearman_matrix(df, [a, b])


def resample(df: DataFrame, variable: str, unit: str = "day", agg: str = "sum", factor: float = 1.0, by_node: bool = False) -> DataFrame:
    """Aggregate per node and period, times factor; then the mean over nodes, unless by_node."""
    period = F.date_trunc(unit, "datetime").cast("timestamp_ntz").alias("period")
    out = df.groupBy("nodo_id", period).agg((aggregate(agg, variable) * factor).alias("value"))
    return out if by_node else out.groupBy("period").agg(F.avg("value").alias("value"))


def outlier_nodes(df: DataFrame, variable: str, method: str = "zscore", threshold: float = 3.0, agg: str = "mean") -> DataFrame:
    """Nodes whose aggregate lies outside; zscore with the population deviation, iqr with k = 1.5 where the threshold is the default 3."""
    per = df.groupBy("nodo_id").agg(aggregate(agg, variable).alias("value"))
    if method == "zscore":
        mean, sd = per.agg(F.avg("value")).scalar(), per.agg(F.stddev_pop("value")).scalar()
        return per.withColumn("z", F.try_divide(F.col("value") - mean, sd)).where(F.abs("z") > threshold)
    if method != "iqr":
        raise ValueError(f"unknown method {method!r}")
    q1, q3 = (per.agg(F.percentile("value", F.lit(p))).scalar() for p in (0.25, 0.75))
    k = 1.5 if threshold == 3.0 else threshold
    return per.where((F.col("value") < q1 - k * (q3 - q1)) | (F.col("value") > q3 + k * (q3 - q1)))


def wind_rose(df: DataFrame, sectors: int = 16, edges=(0, 2, 4, 6, 8, 10, float("inf")), by_month: bool = False) -> DataFrame:
    """(month,) sector, speed_bin, pct of all rows (of the month); every sector and bin is there, with 0 where it has no rows.

    Calm and missing winds are in no bin, but in the total. A month without rows has none.
    """
    keys = ["month"] if by_month else []
    rows = df.select(*keys, sector(F.col("wind_direction"), sectors).alias("sector"), banded(F.col("wind_speed"), edges).alias("speed_bin"))
    counts = rows.groupBy(*keys, "sector", "speed_bin").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("total")).where("total > 0")
    cells = F.explode(F.array(*(F.struct(F.lit(s).alias("sector"), F.lit(b).alias("speed_bin")) for s in range(sectors) for b in range(len(edges) - 1))))
    grid = total.select("*", cells.alias("cell")).select(*keys, "total", "cell.*")
    out = grid.join(counts, [*keys, "sector", "speed_bin"], "left")
    return out.select(*keys, "sector", "speed_bin", (F.coalesce("n", F.lit(0)) * 100.0 / F.col("total")).alias("pct"))


def boxplot(df: DataFrame, variable: str, by: str = "month") -> DataFrame:
    """Quartiles, and whiskers at the last values inside 1.5 IQR. Quartiles are exact, from value counts where these are few, else by refinement; whiskers take one more
    pass, in which only a group's least and largest value are kept."""
    rows = df.where(F.col(variable).isNotNull()).select(F.col(by), F.col(variable).alias("v"))
    names = ("q1", "median", "q3")
    if _buffered(rows, ["v"], by):
        rows = rows.groupBy(by, "v").agg(F.count("*").alias("n"))
        q = rows.groupBy(by).agg(*(F.percentile("v", F.lit(p), F.col("n")).alias(c) for p, c in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))))
    else:
        q = F.broadcast(exact_quantiles(rows, "v", (0.25, 0.5, 0.75), by).withColumnsRenamed({f"q{i}": f"quartile{i}" for i in range(3)}).withColumnsRenamed({f"quartile{i}": n for i, n in enumerate(names)}))
    inside = F.col("v").between(F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    return rows.join(q, by).groupBy(by, *names).agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"))


def month_hour(df: DataFrame, variable: str, agg: str = "mean") -> DataFrame:
    return df.groupBy("month").agg(*(aggregate(agg, F.when(F.col("hour") == h, F.col(variable))).alias(f"h{h:02d}") for h in range(24)))


def daily_sums(df: DataFrame, variable: str) -> DataFrame:
    return df.groupBy("nodo_id", "year", "month", "day").agg(aggregate("sum", variable).alias("total"))


def resource_map(df: DataFrame, variable: str, nodes: DataFrame, factor: float = 0.001) -> DataFrame:
    """Mean over days of each node's daily sum, times factor; nodes without coordinates are left out."""
    return with_coordinates(daily_sums(df, variable).groupBy("nodo_id").agg((F.avg("total") * factor).alias("value")), nodes, "inner")


def twelve_months(df: DataFrame, variable: str, agg: str = "mean") -> DataFrame:
    return df.groupBy("nodo_id", "month").agg(aggregate(agg, variable).alias("value"))


def daily_spatial(df: DataFrame, variable: str) -> DataFrame:
    """Daily sums per node / 1000, then mean, std, min and max over nodes."""
    per = daily_sums(df, variable).withColumn("kwh", F.col("total") / 1000)
    return per.groupBy("year", "month", "day").agg(F.avg("kwh").alias("mean"), F.stddev_samp("kwh").alias("std"), F.min("kwh").alias("min"), F.max("kwh").alias("max"))


def hourly(df: DataFrame, value: str = "value", code: str = "code", ts: str = "ts") -> DataFrame:
    """Sub-hourly rows to hours: mean, maximum, the value at minute 30, and the mode of a code (the smallest of equally frequent)."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_ts")
    return df.groupBy("nodo_id", hour).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.max(F.when(F.minute(ts) == 30, F.col(value))).alias("minute_30"), F.mode(code, True).alias("mode"))


def duration_curve(df: DataFrame, variable: str) -> DataFrame:
    """Compact duration curve: (value, n, exceedance_pct), where the last of n equal values has position / all * 100."""
    counts = df.where(F.col(variable).isNotNull()).groupBy(F.col(variable).alias("value")).agg(F.count("*").alias("n"))
    return running_total(counts, "value", "n", descending=True).select("value", "n", ((F.col("before") + F.col("n")) * 100.0 / F.col("all")).alias("exceedance_pct"))


def duration_rows(df: DataFrame, variable: str) -> DataFrame:
    """Row-level duration curve: (value, position, exceedance_pct), a row per observation in descending order, numbered from 1."""
    counts = df.where(F.col(variable).isNotNull()).groupBy(F.col(variable).alias("value")).agg(F.count("*").alias("n"))
    at = running_total(counts, "value", "n", descending=True)
    rows = at.select("value", "all", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("n"))).alias("position"))
    return rows.select("value", "position", (F.col("position") * 100.0 / F.col("all")).alias("exceedance_pct"))


def delta_map(df: DataFrame, variable: str, years, nodes: DataFrame, agg: str = "mean", relative: bool = False) -> DataFrame:
    """(nodo_id, value, latitude, longitude, scale) of the difference between two years; scale is the largest absolute one."""
    column = "delta_pct" if relative else "delta"
    out = compare_years(df, variable, years, "nodo_id", agg).where(F.col(column).isNotNull()).select("nodo_id", F.col(column).alias("value"))
    out = with_coordinates(out, nodes, "inner")
    return out.withColumn("scale", out.agg(F.max(F.abs("value"))).scalar())


def map_summary(values: DataFrame, value: str = "value") -> DataFrame:
    """One row: nodes, mean, min and max of a map."""
    return values.agg(F.count(value).alias("nodes"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))


def twelve_month_panel(df: DataFrame, variable: str, agg: str = "mean") -> DataFrame:
    """(nodo_id, month, value, month_mean, low, high): the shared ends of all panels and each month's mean."""
    per = twelve_months(df, variable, agg)
    months = per.groupBy("month").agg(F.avg("value").alias("month_mean"))
    return per.join(months, "month").withColumn("low", per.agg(F.min("value")).scalar()).withColumn("high", per.agg(F.max("value")).scalar())


def daily_means(days: DataFrame, by_month: bool = False) -> DataFrame:
    """Mean of the daily means of daily_spatial, of a year or of a month."""
    return days.groupBy("year", *(["month"] if by_month else [])).agg(F.avg("mean").alias("mean"))


def hourly_means(sub: DataFrame, variables, ts: str = "ts") -> DataFrame:
    """Hourly means of all variables in one pass."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_ts")
    return sub.groupBy("nodo_id", hour).agg(*(F.avg(v).alias(v) for v in variables))


def hourly_features(sub: DataFrame, rules: dict, ts: str = "ts") -> DataFrame:
    """(nodo_id, hour_ts, ...): each name's (column, rule), the rule mean, max, minute_30 or mode (smallest of equally frequent); one variable may
    come under several names. Variables that the table lacks are left out."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour_ts")
    known = {"mean": F.avg, "max": F.max, "minute_30": lambda c: F.max(F.when(F.minute(ts) == 30, F.col(c))), "mode": lambda c: F.mode(c, True)}
    return sub.groupBy("nodo_id", hour).agg(*(known[rule](c).alias(name) for name, (c, rule) in rules.items() if c in sub.columns))


def node_list(df: DataFrame) -> DataFrame:
    return df.select("nodo_id").distinct().orderBy("nodo_id")


def row_counts(df: DataFrame) -> DataFrame:
    """How many nodes have how many rows."""
    return df.groupBy("nodo_id").agg(F.count("*").alias("rows")).groupBy("rows").agg(F.count("*").alias("nodes"))


def extent(nodes: DataFrame, padding: float = 0.0, focus=None) -> DataFrame:
    """Padded extent of all nodes, and the centre of a focus set (or of all)."""
    inside = F.lit(True) if focus is None else F.col("nodo_id").isin(list(focus))
    x, y = F.col("longitude"), F.col("latitude")
    return nodes.agg(
        (F.min(x) - padding).alias("x0"), (F.max(x) + padding).alias("x1"), (F.min(y) - padding).alias("y0"), (F.max(y) + padding).alias("y1"), F.avg(F.when(inside, x)).alias("cx"), F.avg(F.when(inside, y)).alias("cy")
    )


def wide(long: DataFrame, variables, time: str = "datetime") -> DataFrame:
    """(time, nodo_id, variable, value) rows as one column per named variable; the last of repeated values by size."""
    return long.groupBy(time, "nodo_id").agg(*(F.max(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in variables))
