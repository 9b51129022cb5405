"""Region tables on disk: Parquet by genome and chromosome, sorted by start, so scans skip what a range doesn't touch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.metafields import as_text, formatted
from ..operators import metadata
from ..schema import all_or_nothing, located


def save(regions: DataFrame, path: str, genome: str, mode: str = "append") -> None:
    """Dealt by chromosome and range of starts, so a large chromosome is many files."""
    rows = regions.withColumn("genome", F.lit(genome))
    rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start", "end").write.mode(mode).partitionBy("genome", "chrom").parquet(path)


def load(spark: SparkSession, path: str, genome: str, chromosomes=None, start: int | None = None, end: int | None = None) -> DataFrame:
    from ..operators.filters import in_range

    return in_range(spark.read.parquet(path).where(F.col("genome") == genome), chromosomes, start, end)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; on a local master without one a temporary folder."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/locusframe-{uuid.uuid4().hex}"


def ingest(parsed: DataFrame, sizes: DataFrame, path: str, genome: str, dataset: dict, datasets: DataFrame, ignore_unknown: bool = False, trim: bool = False) -> DataFrame:
    """Parsed lines (with error) as a stored data set: checked, all or nothing, appended to the store; the catalogue with its row comes back.

    dataset has dataset_id, name and further columns of datasets; a name that exists already is an error before anything is written.
    """
    spark = parsed.sparkSession
    kinds = StructType([StructField(f.name, f.dataType) for f in datasets.schema])
    row = spark.createDataFrame([tuple(dataset.get(f.name) for f in kinds)], kinds)
    catalogue = metadata.added(datasets, row)
    rows = all_or_nothing(located(all_or_nothing(parsed), sizes, ignore_unknown, trim))
    save(rows.withColumn("dataset_id", F.lit(dataset["dataset_id"]).cast("long")), path, genome)
    return catalogue


def write_text(regions: DataFrame, path: str, fields: str = "CHROMOSOME,START,END", compression: str = "bzip2") -> None:
    """Tab-separated lines in the order of chromosome, start and end."""
    as_text(formatted(regions.orderBy("chrom", "start", "end"), fields)).write.mode("overwrite").option("compression", compression).text(path)


def preview(regions: DataFrame, n: int = 100) -> DataFrame:
    """The first regions of a data set; of equal places in the order of the other columns."""
    rest = [c for c, kind in regions.dtypes if c not in ("chrom", "start", "end") and not kind.startswith("map")]
    return regions.orderBy("chrom", "start", "end", *rest).limit(n)
