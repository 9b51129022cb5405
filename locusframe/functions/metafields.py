"""Derived columns of regions by name, such as @LENGTH or @AGG.MEAN, and calculated columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATASET = {"@NAME": "name", "@EPIGENETIC_MARK": "epigenetic_mark", "@PROJECT": "project", "@BIOSOURCE": "biosource", "@GENOME": "genome", "@SAMPLE_ID": "sample_id"}
_AGG = {"@AGG." + n: "agg_" + n.lower() for n in ("MIN", "MAX", "SUM", "MEDIAN", "MEAN", "VAR", "SD", "COUNT")}
_CALL = re.compile(r"^(@[A-Z_.]+)\((.*)\)$", re.S)


def column(df: DataFrame, field: str) -> Column:
    """The column that field names: CHROMOSOME, START, END, a column of df or a metafield. Fields of the data set need with_datasets()."""
    plain = {"CHROMOSOME": "chrom", "START": "start", "END": "end"}
    if field in plain:
        return F.col(plain[field])
    if field == "@LENGTH":
        return F.col("end") - F.col("start")
    if field == "@STRAND":
        return F.coalesce(F.col("strand"), F.lit("")) if "strand" in df.columns else F.lit("")
    if field in DATASET:
        return F.col(f"dataset_{DATASET[field]}")
    if field in _AGG:
        return F.col(_AGG[field]) if _AGG[field] in df.columns else F.lit(None).cast("double")
    if field == "@SEQUENCE":
        return F.col("sequence")
    if field == "@GENE_EXPRESSION":
        return F.lit(None).cast("double")
    if m := _CALL.match(field):
        name, argument = m.groups()
        if name == "@COUNT.MOTIF":
            return F.regexp_count("sequence", F.lit(argument))
        if name == "@CALCULATED":
            return calculated(argument, df)
        if name == "@GENE_ATTRIBUTE":
            return F.coalesce(F.try_element_at("attributes", F.lit(argument)), F.lit(""))
        if name in ("@GENE_ID", "@GENE_NAME"):
            return F.col(name[1:].lower())
        if name in ("@GO_IDS", "@GO_LABELS"):
            return F.array_join(F.transform("go_terms", lambda t: t["go_id" if name == "@GO_IDS" else "go_label"]), ",")
        raise ValueError(f"unknown metafield {name}")
    name = next((c for c in df.columns if c.upper() == field.upper()), None)
    if name is None:
        raise ValueError(f"unknown column {field}")
    return F.col(name)


def _in_sql(df: DataFrame, field: str) -> str:
    """The SQL of a metafield inside calculated code."""
    plain = {"@LENGTH": "(`end` - `start`)", "@SEQUENCE": "sequence", "@STRAND": "coalesce(strand, '')" if "strand" in df.columns else "''"}
    if field in plain:
        return plain[field]
    if field in DATASET:
        return f"dataset_{DATASET[field]}"
    if field in _AGG:
        return _AGG[field] if _AGG[field] in df.columns else "CAST(NULL AS double)"
    if (m := _CALL.match(field)) and m[1] in ("@COUNT.MOTIF", "@GENE_ID", "@GENE_NAME"):
        text = m[2].replace("\\", "\\\\").replace("'", "\\'")
        return f"regexp_count(sequence, '{text}')" if m[1] == "@COUNT.MOTIF" else m[1][1:].lower()
    raise ValueError(f"unknown metafield {field}")


def calculated(code: str, df: DataFrame | None = None) -> Column:
    """A calculated column: a SQL expression over the columns and the metafields of df, such as @LENGTH; numbers with six decimals, text and truth values as they are."""
    if df is not None:
        code = re.sub(r"@[A-Z_]+(?:\.[A-Z]+)?(?:\([^()]*\))?", lambda m: _in_sql(df, m[0]), code)
        if df.select(F.expr(code)).schema[0].dataType.simpleString() in ("string", "boolean"):
            return F.expr(code).cast("string")
    return F.format_string("%.6f", F.expr(code).cast("double"))


def with_genes(regions: DataFrame, genes: DataFrame) -> DataFrame:
    """regions with gene_id, gene_name and go_terms of the gene of a model (genes) at the same place, for @GENE_ID and its like; null and no terms where there is none.

    Of several genes at one place the one of the least id counts; repeated regions stay.
    """
    place = ["chrom", "start", "end"]
    one = genes.groupBy(*place).agg(F.min(F.struct("gene_id", "gene_name", "go_terms")).alias("_gene"))
    rows = regions.drop("gene_id", "gene_name", "go_terms").join(one, place, "left")
    return rows.select("*", "_gene.gene_id", "_gene.gene_name", F.coalesce("_gene.go_terms", F.array().cast(genes.schema["go_terms"].dataType)).alias("go_terms")).drop("_gene")


def with_datasets(regions: DataFrame, datasets: DataFrame) -> DataFrame:
    """regions with the metadata of their data set as columns dataset_*."""
    dimension = datasets.select("dataset_id", *[F.col(c).alias(f"dataset_{c}") for c in datasets.columns if c != "dataset_id"])
    return regions.join(dimension, "dataset_id", "left")


def formatted(df: DataFrame, fields: str = "CHROMOSOME,START,END") -> DataFrame:
    """The columns of a comma-separated format, in its order; a field may come twice. Commas in parentheses belong to a field."""
    names = [x.strip() for x in re.findall(r"(?:[^,(]|\([^()]*(?:\([^()]*\)[^()]*)*\))+", fields or "CHROMOSOME,START,END")]
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        out.append(column(df, name).alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return df.select(*out)


def as_text(df: DataFrame) -> DataFrame:
    """One tab-separated line for each row: four decimals, Infinity, empty for missing."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind in ("double", "float"):
            text = F.when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").otherwise(F.format_string("%.4f", c))
        else:
            text = c.cast("string")
        return F.when(c.isNull(), "").otherwise(text)

    return df.select(F.concat_ws("\t", *[cell(n, k) for n, k in df.dtypes]).alias("line"))
