"""Joins of regions by overlap. Regions are rows with chrom, start and end, half open from 0.

Pairs come from an equi-join on bins. A region belongs to the least level whose bins are as wide as it is, so it touches at most two bins of any
level from its own upwards; two regions meet at the higher of their levels, in the bin where their overlap starts, and so exactly
once. Whatever the widths, a region is copied at most twice for each level that occurs. Questions about existence need no pairs: they are ordered scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import scan

#: Bin width of each level.
LEVELS = tuple(256 * 16**i for i in range(6))


def _level(levels: tuple[int, ...]) -> Column:
    width = F.col("end") - F.col("start")
    out = F.lit(len(levels) - 1)
    for i in reversed(range(len(levels) - 1)):
        out = F.when(width <= levels[i], F.lit(i)).otherwise(out)
    return out


def _present(df: DataFrame, levels: tuple[int, ...]) -> Column:
    """The levels that occur, as bits of a number, by a subquery: nothing is looked at before the result is asked for."""
    bits = F.array(*[F.lit(1 << i) for i in range(len(levels))])
    return df.agg(F.bit_or(F.get(bits, _level(levels))).alias("levels")).scalar()


def _binned(df: DataFrame, levels: tuple[int, ...], other: Column) -> DataFrame:
    """A row for each bin in which the region can meet one of the other side."""
    df = df.withColumn("_own", _level(levels))
    bins = []
    for i, width in enumerate(levels):
        b = F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))
        # at a level of the other side a region meets all that are as wide or wider than itself; at one of its own side only, those of lower levels
        useful = F.when(other.bitwiseAND(1 << i) != 0, F.col("_own") <= i).otherwise(F.col("_own") == i)
        bins.append(F.when(useful, F.transform(b, lambda x: F.struct(F.lit(i).alias("level"), x.alias("bin")))).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>")))
    return df.withColumn("_at", F.explode(F.concat(*bins))).select("*", F.col("_at.level").alias("_level"), F.col("_at.bin").alias("_bin")).drop("_at")


def pairs(left: DataFrame, right: DataFrame, prefix: str = "r_", levels: tuple[int, ...] = LEVELS, single_level: bool = False) -> DataFrame:
    """Every pair of a left and a right region that share a base, as left's columns and right's with prefix; chrom once.

    Repeated regions give repeated pairs. single_level skips the look at the widths that occur and puts all regions into bins of the first level.
    """
    if single_level:
        levels = levels[:1]
        a = b = F.lit(1)
    else:
        a, b = _present(left, levels), _present(right, levels)
    l = _binned(left, levels, b)
    r = _binned(right, levels, a)
    r = r.select(*[F.col(c).alias(c if c in ("chrom", "_level", "_bin") else f"{prefix}{c}") for c in r.columns])
    joined = l.join(r, ["chrom", "_level", "_bin"])
    s, e = F.col(f"{prefix}start"), F.col(f"{prefix}end")
    width = F.element_at(F.array(*[F.lit(x) for x in levels]), F.col("_level") + 1)
    here = F.floor(F.greatest("start", s) / width) == F.col("_bin")
    met = F.greatest("_own", f"{prefix}_own") == F.col("_level")
    out = joined.where((F.col("start") < e) & (F.col("end") > s) & here & met)
    return out.drop("_level", "_bin", "_own", f"{prefix}_own")


def _with_reach(data: DataFrame, ranges: DataFrame, extra: dict | None = None) -> DataFrame:
    """data with _reach, the furthest end of the ranges that start before the region ends, and results of extra."""
    columns = data.columns
    a = data.select(F.struct(*columns).alias("_row"), "chrom", F.col("end").alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_e"))
    b = ranges.select(F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), "chrom", F.col("start").alias("_at"), F.lit(1).alias("_kind"), F.col("start").cast("long").alias("_s"), F.col("end").cast("long").alias("_e"))
    out = scan(a.unionByName(b), F.col("_at"), ["_at", "_kind"], {"_reach": (F.max, "_e", "before")} | (extra or {}))
    return out.where("_kind = 0")


def intersection(data: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of data that share a base with some range."""
    found = _with_reach(data, ranges).where(F.col("_reach") > F.col("_row.start"))
    return found.select("_row.*")


def marked(data: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """data with a column name: whether the row shares a base with some range."""
    return _with_reach(data, ranges).select("_row.*", F.coalesce(F.col("_reach") > F.col("_row.start"), F.lit(False)).alias(name))


def subtraction(data: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows of data that share no base with any range."""
    found = _with_reach(data, ranges).where(F.coalesce(F.col("_reach") <= F.col("_row.start"), F.lit(True)))
    return found.select("_row.*")


def _least(start: Column, end: Column, amount: float, kind: str) -> Column:
    if kind not in ("bp", "%"):
        raise ValueError("amount_type is 'bp' or '%'")
    return F.lit(int(amount)) if kind == "bp" else F.ceil((end - start) * float(amount) / 100)


def overlap(data: DataFrame, ranges: DataFrame, overlapping: bool = True, amount: float = 0, amount_type: str = "bp", mode: str = "reach") -> DataFrame:
    """The rows of data that overlap a range by an amount, or that overlap none and keep a distance.

    Overlapping: the longer of (range end - region start) and (region end - range start) must be amount or more: base pairs, or a percentage of the
    wider demand of both; mode 'shared' takes the shared length instead. Not overlapping: the next range that starts at or after
    the region's end must be that far away; where none follows, the last range of the chromosome must be. A chromosome without ranges
    keeps all its rows.
    """
    if overlapping:
        if amount == 0:
            return intersection(data, ranges)
        return _overlap_pairs(data, ranges, amount, amount_type, mode)
    nxt = F.when(F.col("_s").isNotNull(), F.struct("_s", "_e"))
    found = _with_reach(data, ranges, {"_next": (F.min, nxt, "after")})
    last = ranges.groupBy("chrom").agg(F.max(F.struct(F.col("start").cast("long").alias("s"), F.col("end").cast("long").alias("e"))).alias("_last"))
    found = found.join(last, "chrom", "left")
    start, end = F.col("_row.start"), F.col("_row.end")
    mine = _least(start, end, amount, amount_type)
    ahead = F.col("_next._s") - end >= F.greatest(mine, _least(F.col("_next._s"), F.col("_next._e"), amount, amount_type))
    behind = start - F.col("_last.e") >= _least(F.col("_last.s"), F.col("_last.e"), amount, amount_type)
    far = F.when(F.col("_next").isNotNull(), ahead).when(F.col("_last").isNotNull(), behind).otherwise(F.lit(True))
    free = F.coalesce(F.col("_reach") <= start, F.lit(True))
    return found.where(free & far).select("_row.*")


def _overlap_pairs(data: DataFrame, ranges: DataFrame, amount: float, amount_type: str, mode: str) -> DataFrame:
    """Distinct rows are joined and their number put back, so repeated rows stay repeated."""
    row = F.struct(*data.columns)
    counted = data.groupBy(*data.columns).agg(F.count("*").alias("_times")).withColumn("_row", row)
    met = pairs(counted.select("chrom", "start", "end", "_row", "_times"), ranges.select("chrom", "start", "end"))
    s, e = F.col("r_start"), F.col("r_end")
    if mode == "shared":
        reached = F.least("end", e) - F.greatest("start", s)
    else:
        reached = F.greatest(e - F.col("start"), F.col("end") - s)
    demand = F.greatest(_least(s, e, amount, amount_type), _least(F.col("start"), F.col("end"), amount, amount_type))
    kept = met.where(reached >= demand).select("_row", "_times").distinct()
    return kept.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select("_row.*")


def count_overlaps(data: DataFrame, ranges: DataFrame, overlapping: bool = True, amount: float = 0, amount_type: str = "bp") -> DataFrame:
    return overlap(data, ranges, overlapping, amount, amount_type).agg(F.count("*").alias("count"))


def gene_location(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """regions with the gene of the same place, and strand unless the gene's is '.'."""
    g = genes.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("strand").alias("_t"), "gene_id", "gene_name")
    same = (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")) & ((F.col("_t") == ".") | (F.col("strand") == F.col("_t")))
    return regions.join(g, same).drop("_c", "_s", "_e", "_t")
