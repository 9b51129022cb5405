"""Numbers of regions: over ranges, chromosomes, bins and columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import interval
from .scan import scan

#: Columns that are not scaled by the overlapping share of a region.
UNSCALED = ("start", "end")


def upper_median(column: str) -> Column:
    """Of sorted values the one at place n // 2 from 0."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


FUNCTIONS = {
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "sum": lambda v: F.sum(v),
    "mean": lambda v: F.avg(v),
    "var": lambda v: F.var_pop(v),
    "sd": lambda v: F.stddev_pop(v),
    "median": upper_median,
    "count": lambda v: F.count(v),
    "boolean": lambda v: F.count(v) > 0,
    "acc": lambda v: F.array_join(F.transform(F.sort_array(F.collect_list(v)), lambda x: F.format_string("%.4f", x)), "|"),
}


def _values(ranges: DataFrame, data: DataFrame, column: str, *more: str) -> DataFrame:
    """_v for each overlap of a distinct range: the data's value, scaled by the share of the data region that lies in the range."""
    places = ranges.select("chrom", "start", "end").distinct()
    met = interval.pairs(places, data.select("chrom", "start", "end", F.col(column).cast("double").alias("_value"), *more))
    if column in UNSCALED:
        return met.withColumn("_v", F.col("r__value"))
    width = F.col("r_end") - F.col("r_start")
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return met.withColumn("_v", F.when(width > 0, F.col("r__value") * shared / width).otherwise(F.col("r__value")))


def _statistics(values: DataFrame, *by: str) -> DataFrame:
    """agg_min, max, sum, median, mean, var, sd and count of _v for each group.

    Equal values of a group are counted before they are put in order, so an order holds each value once and is sorted on disk if it must be; no
    group is held in a buffer.
    """
    times = values.where("_v IS NOT NULL").groupBy(*by, "_v").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*by).orderBy("_v")
    before, whole = up.rowsBetween(Window.unboundedPreceding, 0), up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = times.withColumns({"_to": F.sum("_n").over(before), "_all": F.sum("_n").over(whole), "_sum": F.sum(F.col("_v") * F.col("_n")).over(whole)})
    off = F.col("_v") - F.col("_sum") / F.col("_all")
    var = F.sum(off * off * F.col("_n")) / F.first("_all")
    out = {
        "min": F.min("_v"),
        "max": F.max("_v"),
        "sum": F.first("_sum"),
        "median": F.min(F.when(F.col("_to") > F.floor(F.col("_all") / 2), F.col("_v"))),
        "mean": F.first(F.col("_sum") / F.col("_all")),
        "var": var,
        "sd": F.sqrt(var),
        "count": F.first("_all"),
    }
    return seen.groupBy(*by).agg(*[v.alias(f"agg_{name}") for name, v in out.items()])


def aggregate(data: DataFrame, ranges: DataFrame, column: str, keep_empty_chrom: bool = False) -> DataFrame:
    """ranges with agg_min, max, sum, median, mean, var, sd and count of column over the overlapping data; zeros where there is none.

    Chromosomes without data give no rows, unless keep_empty_chrom.
    """
    found = _statistics(_values(ranges, data, column), "chrom", "start", "end")
    if not keep_empty_chrom:
        ranges = ranges.join(data.select("chrom").distinct(), "chrom", "left_semi")
    return ranges.join(found, ["chrom", "start", "end"], "left").fillna(0, [c for c in found.columns if c.startswith("agg_")])


def score_matrix(data: DataFrame, ranges: DataFrame, experiments: dict[str, str], function: str = "mean", name: str = "experiment") -> DataFrame:
    """One row for each distinct range with a column for each experiment: function of its column over the experiment's overlapping regions, or null.

    experiments: experiment -> column; all are joined at once where their column is the same.
    """
    if function not in FUNCTIONS:
        raise ValueError(f"function is one of {', '.join(FUNCTIONS)}")
    place = ["chrom", "start", "end"]
    out = ranges.select(*place).distinct()
    by: dict[str, list[str]] = {}
    for e, c in experiments.items():
        by.setdefault(c, []).append(e)
    for column, some in by.items():
        values = _values(out, data.where(F.col(name).isin(*some)), column, name)
        result = FUNCTIONS[function]("_v")
        if function == "median":
            values, result = _statistics(values, *place, f"r_{name}"), F.first("agg_median")
        out = out.join(values.groupBy(*place).pivot(f"r_{name}", some).agg(result), place, "left")
    return out.select(*place, *experiments)


def count_regions(data: DataFrame) -> DataFrame:
    return data.agg(F.count("*").alias("count"))


def distinct_values(data: DataFrame, column: str) -> DataFrame:
    return data.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))


def binning(data: DataFrame, column: str, bars: int) -> DataFrame:
    """bin, lower, upper and count of bars equal bins over the values of column; a bin holds its upper edge, the first both."""
    if not 1 <= bars <= 65535:
        raise ValueError("bars is from 1 to 65535")
    v = data.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    edges = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo IS NOT NULL")
    step = (F.col("hi") - F.col("lo")) / bars
    at = F.when(step > 0, F.greatest(F.lit(0), F.least(F.lit(bars - 1), F.ceil((F.col("v") - F.col("lo")) / step) - 1))).otherwise(F.lit(0))
    counts = v.crossJoin(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))  # edges is one row
    bins = edges.select(F.explode(F.sequence(F.lit(0), F.lit(bars - 1))).alias("bin"), (F.col("lo") + step * F.col("bin")).alias("lower"), (F.col("lo") + step * (F.col("bin") + 1)).alias("upper"))
    return bins.join(counts, "bin", "left").fillna(0, ["count"])


def coverage(data: DataFrame, sizes: DataFrame) -> DataFrame:
    """chrom, size, covered bases and their percentage, for chromosomes with data."""
    seen = scan(data.select("chrom", "start", "end"), F.col("start"), ["start", "end"], {"_before": (F.max, "end", "before")})
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce("_before", F.lit(0))))
    covered = seen.groupBy("chrom").agg(F.sum(new).alias("total"))
    return covered.join(sizes, "chrom").select("chrom", "size", "total", (F.col("total") * 100.0 / F.col("size")).alias("percent"))


def acc(values: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    return values.groupBy(*by).agg(FUNCTIONS["acc"](column).alias("acc"))
