"""Regions made from regions or from a genome."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import interval
from .scan import scan


def tiling(sizes: DataFrame, size: int, chromosomes: Sequence[str] | None = None) -> DataFrame:
    """Tiles of size from each chromosome (chrom, size) that end before it does; the rest, and a tile that would just fit, are left out."""
    if chromosomes is not None:
        sizes = sizes.where(F.col("chrom").isin(*chromosomes))
    n = F.floor((F.col("size") - 1) / size)
    tiles = sizes.where(F.col("size") > size).select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("_i"))
    return tiles.select("chrom", (F.col("_i") * size).alias("start"), ((F.col("_i") + 1) * size).alias("end"))


def _minus(use_strand: bool):
    return (F.col("strand") == "-") if use_strand else F.lit(False)


def extend(regions: DataFrame, length: int, direction: str = "BOTH", use_strand: bool = False) -> DataFrame:
    """Wider regions: FORWARD adds at the end, BACKWARD at the start, not below 0, BOTH at both; on strand '-' the sides change places."""
    direction = direction.upper()
    if direction not in ("FORWARD", "BACKWARD", "BOTH"):
        raise ValueError("direction is FORWARD, BACKWARD or BOTH")
    back = F.lit(direction == "BOTH") | (_minus(use_strand) if direction == "FORWARD" else ~_minus(use_strand) if direction == "BACKWARD" else F.lit(True))
    ahead = F.lit(direction == "BOTH") | (~_minus(use_strand) if direction == "FORWARD" else _minus(use_strand) if direction == "BACKWARD" else F.lit(True))
    back, ahead = F.coalesce(back, F.lit(direction != "FORWARD")), F.coalesce(ahead, F.lit(direction != "BACKWARD"))
    start = F.when(back, F.greatest(F.lit(0).cast("long"), F.col("start") - length)).otherwise(F.col("start"))
    end = F.when(ahead, F.col("end") + length).otherwise(F.col("end"))
    return regions.withColumns({"start": F.least(start, end), "end": F.greatest(start, end)})


def flank(regions: DataFrame, start: int, length: int, use_strand: bool = False) -> DataFrame:
    """A region of length beside each region: start bases after its end, or, if negative, before its start; mirrored on strand '-'; not below 0."""
    minus = F.coalesce(_minus(use_strand), F.lit(False))
    if start >= 0:
        plain = F.col("end") + start
        mirrored = F.col("start") - start - length
    else:
        plain = F.col("start") + start
        mirrored = F.col("end") - start - length
    begin = F.when(minus, mirrored).otherwise(plain)
    zero = F.lit(0).cast("long")
    return regions.withColumns({"start": F.greatest(zero, begin), "end": F.greatest(zero, begin + length)})


def merge(*sets: DataFrame) -> DataFrame:
    """All regions of all sets, one of those equal in chrom, start, end and dataset_id."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    return both.dropDuplicates([c for c in ("chrom", "start", "end", "dataset_id") if c in both.columns])


def disjoin(regions: DataFrame) -> DataFrame:
    """The pieces between neighbouring ends of regions that some region covers."""
    ends = regions.select("chrom", F.explode(F.array("start", "end")).alias("start")).distinct()
    after = scan(ends, F.col("start"), ["start"], {"end": (F.min, "start", "after")})
    return interval.intersection(after.where("end IS NOT NULL").select("chrom", "start", "end"), regions.select("chrom", "start", "end"))
