"""Lazy queries over regions: a DataFrame with its genome and the steps that made it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import metafields
from ..operators import aggregate, enrichment, filters, interval, sequences, transform


@dataclass(frozen=True)
class RegionSet:
    """Every method gives a new query; nothing runs before rows(), count() or a write."""

    df: DataFrame
    genome: str | None = None
    steps: tuple[str, ...] = field(default=())

    def _next(self, df: DataFrame, step: str) -> RegionSet:
        return RegionSet(df, self.genome, (*self.steps, step))

    @classmethod
    def select(cls, regions: DataFrame, datasets: DataFrame, genome: str | None = None, **wanted) -> RegionSet:
        return cls(filters.select_regions(regions, datasets, genome=genome, **wanted), genome, ("select_regions",))

    @classmethod
    def tiling(cls, sizes: DataFrame, size: int, genome: str | None = None, chromosomes=None) -> RegionSet:
        return cls(transform.tiling(sizes, size, chromosomes), genome, (f"tiling({size})",))

    def filter(self, column: str, operation: str, value, kind: str = "string") -> RegionSet:
        return self._next(filters.filter_regions(self.df, column, operation, value, kind), f"filter({column} {operation} {value})")

    def intersection(self, other: RegionSet) -> RegionSet:
        return self._next(interval.intersection(self.df, other.df), "intersection")

    def overlap(self, other: RegionSet, overlapping: bool = True, amount: float = 0, amount_type: str = "bp") -> RegionSet:
        return self._next(interval.overlap(self.df, other.df, overlapping, amount, amount_type), f"overlap({overlapping}, {amount} {amount_type})")

    def merge(self, *others: RegionSet) -> RegionSet:
        return self._next(transform.merge(self.df, *[o.df for o in others]), "merge")

    def extend(self, length: int, direction: str = "BOTH", use_strand: bool = False) -> RegionSet:
        return self._next(transform.extend(self.df, length, direction, use_strand), f"extend({length}, {direction})")

    def flank(self, start: int, length: int, use_strand: bool = False) -> RegionSet:
        return self._next(transform.flank(self.df, start, length, use_strand), f"flank({start}, {length})")

    def aggregate(self, ranges: RegionSet, column: str) -> RegionSet:
        return self._next(aggregate.aggregate(self.df, ranges.df, column), f"aggregate({column})")

    def filter_by_motif(self, chunks: DataFrame, motif: str) -> RegionSet:
        return self._next(sequences.filter_by_motif(self.df, chunks, motif), f"filter_by_motif({motif})")

    def experiment_type(self, datasets: DataFrame, kind: str) -> RegionSet:
        return self._next(filters.experiment_type(self.df, datasets, kind), f"experiment_type({kind})")

    def cache(self, keep: bool = True) -> RegionSet:
        return self._next(self.df.persist() if keep else self.df.unpersist(), f"cache({keep})")

    def count(self) -> int:
        return self.df.count()

    def rows(self, fields: str = "CHROMOSOME,START,END") -> DataFrame:
        """The columns of fields in the order of chromosome, start and end."""
        return metafields.formatted(self.df.orderBy("chrom", "start", "end"), fields)

    def coverage(self, sizes: DataFrame) -> DataFrame:
        return aggregate.coverage(self.df, sizes)

    def binning(self, column: str, bars: int) -> DataFrame:
        return aggregate.binning(self.df, column, bars)

    def distinct_values(self, column: str) -> DataFrame:
        return aggregate.distinct_values(self.df, column)

    def enrich_overlap(self, databases: DataFrame, universe: RegionSet) -> DataFrame:
        return enrichment.enrich_overlap(self.df, databases, universe.df)
