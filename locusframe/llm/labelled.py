"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(divisor: int = 5, rest: int = 0, key: str = "doc_id") -> Column:
    """Whether the key's checksum leaves this rest; such rows teach nothing. A null key isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % divisor == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str], key: str = "doc_id") -> DataFrame:
    """Up to per_class rows of each class with columns and label: of the keys that come first by their hash, one row each, that of the least hash; keys with contradicting labels are left out.

    The keys are chosen from labels alone, so at most 2 * per_class of them are sent to the scan of docs.
    """
    known = labels.where(~held_out(key=key) & F.col(label).isin(0, 1) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.min(label).alias("_y"), F.max(label).alias("_z")).where("_y = _z").select(key, "_y")
    first = [known.where(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(per_class) for y in (0, 1)]
    chosen = first[0].unionByName(first[1])
    rows = docs.select(key, *columns).join(F.broadcast(chosen), key).withColumnRenamed("_y", "label")
    return one_row_each(rows, key)


def one_row_each(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of each key the one of the least hash."""
    rest = [c for c in rows.columns if c != key]
    least = rows.groupBy(key).agg(F.min(F.struct(F.xxhash64(*rest).alias("_h"), *rest)).alias("_one"))
    return least.select(key, *[F.col(f"_one.{c}").alias(c) for c in rest])
