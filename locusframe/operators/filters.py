"""Selections of regions and filters of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metafields
from ..functions.naming import normalised, normalised_mark

#: Numbers closer than this are equal.
EPSILON = 1.1920929e-7


def as_list(x) -> list:
    """A parameter that may be nothing, one value or several."""
    return [] if x is None or x == "" else [x] if isinstance(x, str) or not isinstance(x, Sequence) else list(x)


def _checked(field: str) -> str:
    if not field or "$" in field:
        raise ValueError(f"bad field name {field!r}")
    return field


def filter_regions(df: DataFrame, field: str, operation: str, value, kind: str = "string") -> DataFrame:
    """The rows whose field compares to value; kind is 'string' (== and !=) or 'number'. A missing cell differs from every text; text that is no number never compares."""
    c = metafields.column(df, _checked(field))
    if kind == "string":
        if operation not in ("==", "!="):
            raise ValueError("strings compare by == or !=")
        same = c.cast("string").eqNullSafe(F.lit(str(value)))
        return df.where(same if operation == "==" else ~same)
    v = F.lit(float(value))
    n = c.try_cast("double")
    near = F.abs(n - v) < EPSILON
    tests: dict[str, Column] = {"==": near, "!=": ~near, ">": n > v, ">=": n >= v, "<": n < v, "<=": n <= v}
    if operation not in tests:
        raise ValueError("numbers compare by == != > >= < <=")
    return df.where(tests[operation])


def in_range(df: DataFrame, chromosomes=None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows that share a base with [start, end) of the chromosomes."""
    if names := as_list(chromosomes):
        df = df.where(F.col("chrom").isin(*names))
    if end is not None:
        df = df.where(F.col("start") < end)
    if start is not None:
        df = df.where(F.col("end") > start)
    return df


def select_datasets(datasets: DataFrame, visible=None, **wanted) -> DataFrame:
    """The data sets that match every given column: any of its values, by normalised name; visible: projects that may be seen."""
    for name, values in wanted.items():
        if values := as_list(values):
            norm = normalised_mark if name == "epigenetic_mark" else normalised
            exact = name in ("sample_id", "dataset_id", "content_format")
            of = F.array(*[F.lit(v) if exact else norm(F.lit(v)) for v in values])
            datasets = datasets.where(F.array_contains(of, F.col(name) if exact else norm(F.col(name))))
    return datasets.where(F.col("project").isin(*as_list(visible))) if visible is not None else datasets


def select_regions(regions: DataFrame, datasets: DataFrame, experiment_name=None, genome=None, epigenetic_mark=None, sample_id=None, technique=None, project=None, chromosomes=None, start=None, end=None, visible=None) -> DataFrame:
    """The regions of the data sets that match all filters; an experiment or a genome must be given."""
    if not as_list(experiment_name) and not as_list(genome):
        raise ValueError("give an experiment or a genome")
    found = select_datasets(datasets, visible, name=experiment_name, genome=genome, epigenetic_mark=epigenetic_mark, sample_id=sample_id, technique=technique, project=project)
    return in_range(regions, chromosomes, start, end).join(found.select("dataset_id"), "dataset_id", "left_semi")


def select_annotations(regions: DataFrame, annotations: DataFrame, name, genome=None, chromosomes=None, start=None, end=None) -> DataFrame:
    """The regions of finished annotations by normalised name."""
    found = select_datasets(annotations, name=name, genome=genome)
    if "done" in annotations.columns:
        found = found.where("done")
    return in_range(regions, chromosomes, start, end).join(found.select("dataset_id"), "dataset_id", "left_semi")


def experiment_type(regions: DataFrame, datasets: DataFrame, kind: str) -> DataFrame:
    """The regions of data sets with content_format kind: 'peaks' or 'signal'."""
    if kind not in ("peaks", "signal"):
        raise ValueError("kind is peaks or signal")
    return regions.join(datasets.where(F.col("content_format") == kind).select("dataset_id"), "dataset_id", "left_semi")


def experiments_of(regions: DataFrame, datasets: DataFrame) -> DataFrame:
    """dataset_id and name of the data sets that have a region."""
    return datasets.join(regions.select("dataset_id").distinct(), "dataset_id", "left_semi").select("dataset_id", "name")
