"""Signal tracks as blocks of arrays, and back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of one block.
SPAN = 1 << 16


def blocks(track: DataFrame, span: int = SPAN) -> DataFrame:
    """(chrom, block, first, last, starts, ends, scores): rows (chrom, start, end, value) in blocks by where they start, sorted; first and last bound a block's bases."""
    one = F.struct("start", "end", "value")
    grouped = track.groupBy("chrom", F.floor(F.col("start") / span).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("x"), F.min("start").alias("first"), F.max("end").alias("last"))
    return grouped.select("chrom", "block", "first", "last", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"), F.col("x.value").alias("scores"))


def rows(packed: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """The rows of blocks, of which those outside [start, end) aren't unpacked."""
    if end is not None:
        packed = packed.where(F.col("first") < end)
    if start is not None:
        packed = packed.where(F.col("last") > start)
    out = packed.select("chrom", F.explode(F.arrays_zip("starts", "ends", "scores")).alias("x"))
    out = out.select("chrom", F.col("x.starts").alias("start"), F.col("x.ends").alias("end"), F.col("x.scores").alias("value"))
    if end is not None:
        out = out.where(F.col("start") < end)
    return out if start is None else out.where(F.col("end") > start)


def fixed_steps(packed: DataFrame) -> DataFrame:
    """Rows of blocks (chrom, start, step, span, scores) with equal steps."""
    out = packed.select("chrom", "start", "step", "span", F.posexplode("scores").alias("i", "value"))
    at = F.col("start") + F.col("i") * F.col("step")
    return out.select("chrom", at.alias("start"), (at + F.col("span")).alias("end"), "value")
