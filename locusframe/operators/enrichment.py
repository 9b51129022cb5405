"""Enrichment of a set of regions against data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statistics
from . import genes as genes_
from . import interval, transform

#: Tiles of a genome signature.
SIGNATURE = 1 << 20


def overlap_tables(query: DataFrame, databases: DataFrame, universe: DataFrame, by: str = "dataset_id") -> DataFrame:
    """For each data set the table of universe pieces: a those that overlap query and data set, b only the data set, c only the query, d neither.

    The universe is made disjoint first, but d is counted against its number of regions before that.
    """
    place = ["chrom", "start", "end"]
    pieces = interval.marked(transform.disjoin(universe), query.select(*place), "_in").persist()  # read for its widths, for the join and for its sums
    met = interval.pairs(pieces, databases.select(*place, by)).select(*place, "_in", F.col(f"r_{by}").alias(by)).distinct()
    hits = met.groupBy(by).agg(F.count_if("_in").alias("a"), F.count("*").alias("_u"))
    totals = universe.agg(F.count("*").alias("_total")).crossJoin(pieces.agg(F.count_if("_in").alias("_q")))  # one row
    t = databases.select(by).distinct().join(hits, by, "left").fillna(0, ["_u", "a"]).crossJoin(F.broadcast(totals))
    b, c = F.col("_u") - F.col("a"), F.col("_q") - F.col("a")
    return t.select(by, "a", b.alias("b"), c.alias("c"), (F.col("_total") - F.col("a") - b - c).alias("d"))


def enrich_overlap(query: DataFrame, databases: DataFrame, universe: DataFrame, by: str = "dataset_id") -> DataFrame:
    return statistics.ranked(statistics.tested(overlap_tables(query, databases, universe, by)))


def tiles_touched(regions: DataFrame, sizes: DataFrame, bits: int = SIGNATURE) -> DataFrame:
    """regions' columns with word and tiles: the genome in bits equal tiles, chromosome after chromosome, 64 of them a word; a region touches its tiles, both ends included, which are bits of one number a word."""
    one = sizes.agg(F.floor(F.sum("size") / bits + F.count("*") + 1).cast("long").alias("_width"), F.sort_array(F.collect_list(F.struct("chrom", "size"))).alias("_all"))  # one row: the chromosomes of a genome
    before = F.expr("transform(_all, (x, i) -> struct(x.chrom AS chrom, aggregate(slice(_all, 1, i), 0L, (s, y) -> s + y.size div _width + 1) AS _first))")
    first = one.select("_width", F.explode(before).alias("x")).select("_width", "x.*")
    at = lambda c: F.expr(f"_first + {c} div _width")
    rows = regions.join(F.broadcast(first), "chrom").withColumns({"_from": at("start"), "_to": at("end")}).where("_from <= _to")
    rows = rows.withColumn("word", F.explode(F.sequence(F.floor(F.col("_from") / 64), F.floor(F.col("_to") / 64))))
    since = F.expr("shiftleft(-1L, CAST(greatest(_from - word * 64, 0) AS INT))")
    until = F.expr("shiftrightunsigned(-1L, CAST(greatest(word * 64 + 63 - _to, 0) AS INT))")
    return rows.withColumn("tiles", since.bitwiseAND(until)).drop("_width", "_first", "_from", "_to")


def signatures(regions: DataFrame, sizes: DataFrame, by: str = "dataset_id", bits: int = SIGNATURE) -> DataFrame:
    """(by, word, tiles): the tiles that each data set touches, as the bits of its words; words without a tile have no row, so there are no more rows than regions have words."""
    t = tiles_touched(regions.select("chrom", "start", "end", by), sizes, bits)
    return t.groupBy(by, "word").agg(F.bit_or("tiles").alias("tiles"))


def fast_tables(query: DataFrame, databases: DataFrame, sizes: DataFrame, by: str = "dataset_id", bits: int = SIGNATURE) -> DataFrame:
    """For each data set the table of tiles: a touched by both, b only by the data set, c only by the query, d by neither.

    The query is bits / 64 words at most on a genome of these sizes, so it goes to the signatures, which are dealt out by word once.
    """
    q = tiles_touched(query.select("chrom", "start", "end"), sizes, bits).groupBy("word").agg(F.bit_or("tiles").alias("_query"))
    shared = F.coalesce(F.bit_count(F.col("tiles").bitwiseAND(F.col("_query"))), F.lit(0))
    both = signatures(databases, sizes, by, bits).join(F.broadcast(q), "word", "left").groupBy(by).agg(F.sum(shared).alias("a"), F.sum(F.bit_count("tiles")).alias("_e"))
    t = both.crossJoin(F.broadcast(q.agg(F.coalesce(F.sum(F.bit_count("_query")), F.lit(0)).alias("_q"))))
    b, c = F.col("_e") - F.col("a"), F.col("_q") - F.col("a")
    return t.select(by, "a", b.alias("b"), c.alias("c"), (F.lit(bits).cast("long") - F.col("a") - b - c).alias("d"))


def enrich_fast(query: DataFrame, databases: DataFrame, sizes: DataFrame, by: str = "dataset_id", bits: int = SIGNATURE) -> DataFrame:
    return statistics.ranked(statistics.tested(fast_tables(query, databases, sizes, by, bits)))


def enrich_terms(genes: DataFrame, regions: DataFrame) -> DataFrame:
    return statistics.ranked(statistics.tested(genes_.term_tables(genes, regions)))
