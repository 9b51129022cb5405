"""Sharding by rendezvous hashing of stable record keys over weighted shards; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that make a draw; 52 bits are exact in a double.
DIGITS = 13
#: Parts of a shard that are numbered on their own.
PARTS = 1024


def _draw(key: Column, shard: int) -> Column:
    """A number strictly between 0 and 1, from key and shard alone."""
    digest = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, DIGITS)
    return (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score weight / -ln(draw); equal scores go to the lower shard.

    A shard of weight 0 takes nothing. A further shard only takes records whose new score is the highest, so records move
    into it and nowhere else.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must not be negative, and one must be positive")
    scores = [F.struct((F.lit(float(w)) / -F.log(_draw(key, i))).alias("score"), F.lit(-i).alias("back")) for i, w in enumerate(weights) if w > 0]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["back"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown: float | None = None, key: str = "doc_id", text: str = "text", overhead: int = 8, parts: int = PARTS) -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot and grown_shard (the shard with one more shard of weight grown).

    A null key counts as the key 'null'; repeated keys share a shard and get slots of their own. Null texts have only the
    overhead as size and the checksum of the empty text. An empty table gives no rows. Columns of docs beyond key and text
    are not read, so their names cannot clash. Slots are numbered within (shard, part by the hash of key and text, so rows of one key are many parts), then shifted by
    the number of rows in the parts before: no task orders a whole shard, and the joined offsets have at most
    len(weights) * parts rows, whatever the input.
    """
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit(""))
    placed = docs.select(
        F.col(key),
        (F.octet_length(body).cast("long") + overhead).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(name, weights).alias("shard"),
        (shard_of(name, [*weights, grown]) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(name, body), F.lit(parts)).cast("int").alias("_part"),
    )
    counts = placed.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    # at most len(weights) * parts numbers: one array of parts for each shard, summed from the left
    arrays = counts.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("_part", "_n"))).alias("_all"))
    before = F.expr("transform(_all, (x, i) -> struct(x._part AS _part, aggregate(slice(_all, 1, i), 0L, (s, y) -> s + y._n) AS _before))")
    offsets = arrays.select("shard", F.explode(before).alias("_o")).select("shard", "_o._part", "_o._before")
    order = Window.partitionBy("shard", "_part").orderBy(key, "text_crc32", "size")
    numbered = placed.withColumn("_rank", F.row_number().over(order).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "_part"]).select(key, "size", "text_crc32", "law", "shard", (F.col("_before") + F.col("_rank")).alias("slot"), "grown_shard")
