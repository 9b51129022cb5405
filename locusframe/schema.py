"""Types of region columns, their registry and the validation of rows before they are stored."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("string", "integer", "double", "range", "category", "calculated")

#: Kinds that a column may be turned into when a data set is cloned.
COMPATIBLE = {
    "string": {"string"},
    "integer": {"string", "integer"},
    "double": {"string", "double"},
    "range": {"string", "double", "range"},
    "category": {"string", "category"},
    "calculated": {"string", "calculated"},
}


@dataclass(frozen=True)
class ColumnType:
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    items: tuple[str, ...] = field(default=())
    code: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")

    @property
    def sql(self) -> str:
        return {"integer": "bigint", "double": "double", "range": "double"}.get(self.kind, "string")

    def typed(self, raw: Column) -> Column:
        """The value of a token, null where it doesn't parse; a lone dot is missing where a number is due."""
        if self.kind == "calculated":
            return F.expr(self.code)
        return raw if self.sql == "string" else raw.try_cast(self.sql)

    def valid(self, raw: Column) -> Column:
        v = self.typed(raw)
        if self.kind == "range":
            return v.isNotNull() & v.between(self.low, self.high)
        if self.kind == "category":
            return raw.isin(*self.items)
        return v.isNotNull() if self.sql != "string" else raw.isNotNull()


class Registry:
    """Column types by name, case aside."""

    def __init__(self, types: Sequence[ColumnType] = ()):
        self.types: dict[str, ColumnType] = {}
        for t in (*BUILT_IN, *types):
            self.types[t.name.upper()] = t

    def add(self, t: ColumnType) -> None:
        if t.name.upper() in self.types:
            raise ValueError(f"column {t.name} exists already")
        self.types[t.name.upper()] = t

    def __getitem__(self, name: str) -> ColumnType:
        return self.types[name.upper()]

    def format(self, text: str) -> list[ColumnType]:
        """The types of a comma-separated format."""
        return [self[name.strip()] for name in text.split(",")]

    def may_become(self, old: str, new: str) -> bool:
        return self[new].kind in COMPATIBLE[self[old].kind]


BUILT_IN = (
    ColumnType("CHROMOSOME", "string"),
    ColumnType("START", "integer"),
    ColumnType("END", "integer"),
    ColumnType("VALUE", "double"),
    ColumnType("NAME", "string"),
    ColumnType("SCORE", "double"),
    ColumnType("STRAND", "category", items=("+", "-", ".")),
    ColumnType("SIGNAL_VALUE", "double"),
    ColumnType("P_VALUE", "double"),
    ColumnType("Q_VALUE", "double"),
    ColumnType("PEAK", "integer"),
    ColumnType("THICK_START", "integer"),
    ColumnType("THICK_END", "integer"),
    ColumnType("ITEM_RGB", "string"),
    ColumnType("BLOCK_COUNT", "string"),
    ColumnType("BLOCK_SIZES", "string"),
    ColumnType("BLOCK_STARTS", "string"),
)

#: Formats by the number of tokens of a line.
INFERRED = {
    3: "CHROMOSOME,START,END",
    4: "CHROMOSOME,START,END,NAME",
    5: "CHROMOSOME,START,END,SCORE,NAME",
    9: "CHROMOSOME,START,END,NAME,SCORE,STRAND,SIGNAL_VALUE,P_VALUE,Q_VALUE",
    10: "CHROMOSOME,START,END,NAME,SCORE,STRAND,SIGNAL_VALUE,P_VALUE,Q_VALUE,PEAK",
    12: "CHROMOSOME,START,END,NAME,SCORE,STRAND,THICK_START,THICK_END,ITEM_RGB,BLOCK_COUNT,BLOCK_SIZES,BLOCK_STARTS",
}

#: The format of four tokens whose last is a number.
FOUR_WITH_SCORE = "CHROMOSOME,START,END,SCORE"

OUTPUT = {"CHROMOSOME": "chrom", "START": "start", "END": "end"}


def located(regions: DataFrame, sizes: DataFrame, ignore_unknown: bool = False, trim: bool = False) -> DataFrame:
    """regions on the chromosomes of a genome (chrom, size), with error: null, or what is wrong with the row.

    A name is looked up as it is, then without 'chr', then with it. ignore_unknown leaves out rows on other chromosomes; trim cuts
    rows at the chromosome's end and leaves out those beyond it.
    """
    known = sizes.select(F.col("chrom").alias("_known"), "size")
    ways = F.array(F.col("chrom"), F.regexp_replace("chrom", "^chr", ""), F.concat(F.lit("chr"), "chrom"))
    names = regions.select("chrom").distinct().select("chrom", F.posexplode(ways).alias("_way", "_name"))
    found = names.join(known, F.col("_name") == F.col("_known")).groupBy("chrom").agg(F.min(F.struct("_way", "_known", "size")).alias("_found"))
    out = regions.join(found, "chrom", "left")
    if ignore_unknown:
        out = out.where("_found IS NOT NULL")
    size = F.col("_found.size")
    if trim:
        out = out.where(F.coalesce(F.col("start") < size, F.lit(True))).withColumn("end", F.least(F.col("end"), F.coalesce(size, F.col("end"))))
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("unknown chromosome "), "chrom")).when(F.col("start").isNull() | F.col("end").isNull(), "no position").when(F.col("start") > F.col("end"), "start after end").when((F.col("start") < 0) | (F.col("end") > size), "outside the chromosome")
    return out.withColumns({"error": error, "chrom": F.coalesce("_found._known", "chrom")}).drop("_found")


def all_or_nothing(checked: DataFrame) -> DataFrame:
    """The rows without their column error; one bad row is an error for all."""
    if bad := checked.where("error IS NOT NULL").select("error").first():
        raise ValueError(bad["error"])
    return checked.drop("error")
