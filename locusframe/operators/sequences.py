"""Sequences in chunks, motifs in them and the sequence of a region."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scan import scan


def find_motif(sequences: DataFrame, motif: str, chromosomes=None, start: int = 0, end: int | None = None, overlap: bool = False, longest: int | None = None, size: int = 1 << 16) -> DataFrame:
    """chrom, start and end of each match of a regular expression in sequences (chrom, bases), in [start, end); overlap restarts one base after a match's start.

    longest: no match is longer, and the pattern doesn't look at what stands around it. Then pieces of size bases are searched, each with what follows it; without it
    each sequence is searched as one.
    """
    if chromosomes:
        sequences = sequences.where(F.col("chrom").isin(*([chromosomes] if isinstance(chromosomes, str) else chromosomes)))
    if longest:
        pieces = chunked(sequences, max(size, longest), longest).select("chrom", "offset", F.concat("bases", "after").alias("bases"), F.length("bases").alias("own"))
    else:
        pieces = sequences.select("chrom", F.lit(0).cast("long").alias("offset"), "bases", F.length("bases").alias("own"))
    ahead = overlap or bool(longest)
    pattern = f"(?=({motif}))" if ahead else motif

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        find = re.compile(pattern)
        for part in parts:
            rows = []
            for chrom, offset, bases, own in zip(part["chrom"], part["offset"], part["bases"], part["own"], strict=True):
                text = bases or ""
                stop = len(text) if end is None else max(min(end - offset, len(text)), 0)
                for m in find.finditer(text[:stop], max(start - offset, 0)):
                    a, b = m.span(1) if ahead else m.span()
                    if b > a and (a < own or not longest):
                        rows.append((chrom, a + offset, b + offset))
            yield pd.DataFrame(rows, columns=["chrom", "start", "end"]).astype({"chrom": object, "start": "int64", "end": "int64"})

    found = pieces.mapInPandas(run, "chrom string, start long, end long")
    return found if overlap or not longest else _apart(found)


def _apart(found: DataFrame) -> DataFrame:
    """Of the matches at every start those that a search from left to right meets: each starts at or after the end of the one before.

    Matches that overlap in a chain are a group; nothing outside decides on what is in it.
    """
    seen = scan(found, F.col("start"), ["start"], {"_before": (F.max, "end", "before")})
    first = seen.withColumn("_head", F.when(F.coalesce(F.col("_before") <= F.col("start"), F.lit(True)), F.col("start")))
    groups = scan(first, F.col("start"), ["start"], {"_group": (F.max, "_head", "upto")})
    lists = groups.groupBy("chrom", "_group").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_all"))
    kind = "struct<kept:array<struct<start:bigint,end:bigint>>,to:bigint>"
    begin = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("kept"), F.lit(-1).cast("long").alias("to")).cast(kind)
    step = lambda s, x: F.when(x["start"] >= s["to"], F.struct(F.concat(s["kept"], F.array(x)).alias("kept"), x["end"].alias("to"))).otherwise(s).cast(kind)
    return lists.select("chrom", F.explode(F.aggregate("_all", begin, step)["kept"]).alias("x")).select("chrom", "x.start", "x.end")


def chunked(sequences: DataFrame, size: int = 1 << 16, after: int = 0) -> DataFrame:
    """(chrom, chunk, offset, bases, after): sequences (chrom, bases) cut into pieces of size in one pass, each with up to so many bases of the next one."""
    pieces = F.regexp_extract_all("bases", F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    rows = sequences.where(F.length("bases") > 0).select("chrom", pieces.alias("_p"))
    both = F.transform("_p", lambda x, i: F.struct(x.alias("bases"), F.substring(F.coalesce(F.get("_p", i + 1), F.lit("")), 1, after).alias("after")))
    out = rows.select("chrom", F.posexplode(both).alias("chunk", "x"))
    return out.select("chrom", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk").cast("long") * size).alias("offset"), "x.bases", "x.after")


def with_sequence(regions: DataFrame, chunks: DataFrame, size: int = 1 << 16) -> DataFrame:
    """regions with sequence: the bases from start to end, put together from the chunks they touch; none beyond the end, and none where there is no sequence. Repeated regions stay."""
    place = ["chrom", "start", "end"]
    touched = F.sequence(F.floor(F.col("start") / size), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / size))
    rows = regions.select(*place).distinct().withColumn("chunk", F.explode(touched)).join(chunks, ["chrom", "chunk"])
    begin = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    length = F.greatest(F.least(F.col("end") - F.col("offset"), F.lit(size)) - begin, F.lit(0))
    piece = F.struct("chunk", F.substring(F.col("bases"), (begin + 1).cast("int"), length.cast("int")).alias("piece"))
    whole = rows.groupBy(*place).agg(F.array_join(F.sort_array(F.collect_list(piece)).getField("piece"), "").alias("sequence"))
    return regions.join(whole, place, "left").withColumn("sequence", F.coalesce("sequence", F.lit(""))).select(*regions.columns, "sequence")


def filter_by_motif(regions: DataFrame, chunks: DataFrame, motif: str, size: int = 1 << 16) -> DataFrame:
    """The regions whose sequence holds a match."""
    return with_sequence(regions, chunks, size).where(F.col("sequence").rlike(motif)).drop("sequence")
