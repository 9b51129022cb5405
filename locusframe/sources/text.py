"""Region and gene files as DataFrames. Lines that don't parse become rows with an error, never exceptions in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FOUR_WITH_SCORE, INFERRED, OUTPUT, Registry

_HEADER = r"^(#|track|browser|chr\tstart)"

#: Rows of one frame of a wiggle reader.
FRAME = 20_000


def lines_of(spark: SparkSession, source: str | list[str] | DataFrame) -> DataFrame:
    """Column value with the lines of a path, a list or a DataFrame."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, list):
        return spark.createDataFrame([(x,) for x in source], "value string")
    return spark.read.text(source)


def _is_number(token: str) -> bool:
    try:
        float(token)
    except ValueError:
        return False
    return True


def _once(column: Column) -> Column:
    """A column that later expressions refer to and don't repeat."""
    return F.explode(F.array(column))


def bed(spark: SparkSession, source, format: str | None = None, registry: Registry | None = None) -> DataFrame:
    """Rows of tab-separated lines by format (or by the number of tokens of the first line), and error.

    Headers and blank lines are left out, and one useless column before the chromosome is passed over.
    """
    registry = registry or Registry()
    lines = lines_of(spark, source).where(~F.col("value").rlike(_HEADER) & (F.trim("value") != ""))
    tokens = F.split(F.rtrim(F.regexp_replace("value", r"\r$", "")), r"\t| +(?=\S)") if format is None else F.split(F.regexp_replace("value", r"\r$", ""), "\t")
    rows = lines.select("value", _once(tokens).alias("t"))
    if format is None:
        first = rows.first()
        n = len(first["t"]) if first else 3
        if n not in INFERRED:
            raise ValueError(f"no format has {n} columns")
        numeric = n == 4 and first is not None and _is_number(first["t"][3])
        format = FOUR_WITH_SCORE if numeric else INFERRED[n]
    types = registry.format(format)
    stored = [t for t in types if t.kind != "calculated"]
    n = len(stored)
    useless = (F.size("t") == n + 1) & F.get("t", F.lit(1)).rlike("^(chr|[A-Za-z])") & F.get("t", F.lit(2)).rlike(r"^\d+$")
    rows = rows.select("value", _once(F.when(useless, F.slice("t", 2, n)).otherwise(F.col("t"))).alias("t"))
    out = {OUTPUT.get(t.name, t.name.lower()): t.typed(F.get("t", F.lit(i))) for i, t in enumerate(stored)}
    bad = [F.when(~F.coalesce(t.valid(F.get("t", F.lit(i))), F.lit(False)) & (F.get("t", F.lit(i)) != "."), F.concat(F.lit(f"bad {t.name}: "), F.coalesce(F.get("t", F.lit(i)), F.lit("nothing")))) for i, t in enumerate(stored)]
    error = F.coalesce(F.when(F.size("t") != n, F.concat(F.lit(f"not {n} columns: "), "value")), *bad)
    parsed = rows.select(*[c.alias(name) for name, c in out.items()], error.alias("error"))
    return parsed.withColumns({t.name.lower(): F.expr(t.code) for t in types if t.kind == "calculated"})


def bedgraph(spark: SparkSession, source) -> DataFrame:
    return bed(spark, lines_of(spark, source).select(F.regexp_replace(F.trim("value"), r"\s+", "\t").alias("value")), "CHROMOSOME,START,END,VALUE")


def _steps(text: str) -> Iterator[tuple]:
    """chrom, start, end and value of a wiggle file; coordinates from 0. A broken rule gives one row with an error and ends the file."""
    mode, chrom, at, step, span, tracks = None, None, 0, 1, 1, 0
    seen: dict[str, list[tuple[int, int]]] = {}
    rows: list[tuple] = []
    for line in re.sub(r"\\\r?\n", " ", text).splitlines():
        line = line.strip()
        if not line or line.startswith(("#", "browser")):
            continue
        word = line.split()[0]
        if word == "track":
            tracks += 1
            if tracks > 1:
                yield (None, None, None, None, "more than one track")
                return
            continue
        if word in ("fixedStep", "variableStep"):
            given = dict(re.findall(r"(\w+)=(\S+)", line))
            try:
                mode, chrom, span = word, given["chrom"], int(given.get("span", 1))
                if mode == "fixedStep":
                    at, step = int(given["start"]) - 1, int(given.get("step", 1))
                if span < 1 or mode == "fixedStep" and (step < 1 or span > step or at < 0):
                    raise ValueError
                if set(given) - {"chrom", "start", "step", "span"} or mode == "variableStep" and set(given) & {"start", "step"}:
                    raise ValueError
            except (KeyError, ValueError):
                yield (None, None, None, None, f"bad line: {line}")
                return
            continue
        try:
            parts = line.split()
            if mode == "fixedStep" and len(parts) == 1:
                row = (chrom, at, at + span, float(parts[0]))
                at += step
            elif mode == "variableStep" and len(parts) == 2:
                row = (chrom, int(parts[0]) - 1, int(parts[0]) - 1 + span, float(parts[1]))
            else:
                raise ValueError
        except ValueError:
            yield (None, None, None, None, f"bad line: {line}")
            return
        rows.append((*row, None))
        seen.setdefault(chrom, []).append(row[1:3])
    for chrom, places in seen.items():
        places.sort()
        if any(b[0] < a[1] for a, b in zip(places, places[1:], strict=False)):
            yield (None, None, None, None, f"overlap on {chrom}")
            return
    yield from rows


def _wiggles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of wiggle files, those of many files in one frame: a frame costs far more than a short file."""
    rows = (row for part in parts for text in part["value"] for row in _steps(text))
    while some := list(islice(rows, FRAME)):
        frame = pd.DataFrame(some, columns=["chrom", "start", "end", "value", "error"])
        yield frame.astype({"start": "Int64", "end": "Int64", "value": "float64"})


def wig(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Rows (chrom, start, end, value, error) of wiggle files: positions follow from the lines before, so a file is read as one.

    Files of a DataFrame are dealt out in turn first: a small table of many short files would be one task.
    """
    if isinstance(source, DataFrame):
        files = source.select("value").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    else:
        files = spark.read.text(source, wholetext=True)
    return files.select("value").mapInPandas(_wiggles, "chrom string, start long, end long, value double, error string")


def gtf(spark: SparkSession, source, feature: str = "gene") -> DataFrame:
    """Genes of a GTF file: positions, score, strand, frame, attributes, gene_id and gene_name."""
    t = F.split("value", "\t")
    rows = lines_of(spark, source).where(~F.col("value").startswith("#")).select(t.alias("t")).where((F.size("t") >= 9) & (F.get("t", F.lit(2)) == feature))
    pairs = F.filter(F.transform(F.split(F.get("t", F.lit(8)), r";\s*"), lambda x: F.split(F.trim(x), r"\s+", 2)), lambda x: F.size(x) == 2)
    attributes = F.map_from_entries(F.transform(pairs, lambda x: F.struct(x[0].alias("key"), F.regexp_replace(x[1], '^"|"$', "").alias("value"))))
    get = lambda i: F.get("t", F.lit(i))
    out = rows.select(get(0).alias("chrom"), get(1).alias("source"), get(2).alias("feature"), get(3).try_cast("long").alias("start"), get(4).try_cast("long").alias("end"), F.when(get(5) != ".", get(5).try_cast("double")).alias("score"), get(6).alias("strand"), get(7).alias("frame"), attributes.alias("attributes"))
    return out.withColumns({"gene_id": F.try_element_at("attributes", F.lit("gene_id")), "gene_name": F.try_element_at("attributes", F.lit("gene_name"))})


#: Expression formats, each field's place and type.
EXPRESSIONS = {
    "cufflinks": {"tracking_id": (0, "string"), "gene_id": (3, "string"), "gene_name": (4, "string"), "fpkm": (9, "double"), "fpkm_lo": (10, "double"), "fpkm_hi": (11, "double"), "fpkm_status": (12, "string")},
    "grape2": {"tracking_id": (0, "string"), "transcript_ids": (1, "string"), "length": (2, "double"), "effective_length": (3, "double"), "expected_count": (4, "double"), "tpm": (5, "double"), "fpkm": (6, "double"), "posterior_mean_count": (7, "double"), "posterior_sd": (8, "double"), "pme_tpm": (9, "double"), "pme_fpkm": (10, "double"), "tpm_ci_lower": (11, "double"), "tpm_ci_upper": (12, "double"), "fpkm_ci_lower": (13, "double"), "fpkm_ci_upper": (14, "double")},
    "salmon": {"tracking_id": (0, "string"), "length": (1, "double"), "effective_length": (2, "double"), "tpm": (3, "double"), "num_reads": (4, "double")},
}


def expressions(spark: SparkSession, source, format: str) -> DataFrame:
    """Rows of an expression file; its header is the line whose first number doesn't parse."""
    fields = EXPRESSIONS[format]
    number = next(i for i, kind in fields.values() if kind == "double")
    rows = lines_of(spark, source).select(F.split("value", "\t").alias("t"))
    rows = rows.where((F.size("t") > max(i for i, _ in fields.values())) & F.get("t", F.lit(number)).try_cast("double").isNotNull())
    return rows.select(*[F.get("t", F.lit(i)).try_cast(kind).alias(name) for name, (i, kind) in fields.items()])


def fasta(spark: SparkSession, source: str | DataFrame, chrom: str | None = None) -> DataFrame:
    """(chrom, bases) of files with one sequence each."""
    files = source if isinstance(source, DataFrame) else spark.read.text(source, wholetext=True)
    name = F.lit(chrom) if chrom else F.regexp_extract("value", r"^>\s*(\S+)", 1)
    return files.select(name.alias("chrom"), F.regexp_replace(F.regexp_replace("value", r"^>[^\n]*\n", ""), r"\s+", "").alias("bases"))


def chromosome_sizes(spark: SparkSession, source) -> DataFrame:
    """(chrom, size) of lines of name and size; commas in numbers are left out."""
    t = F.split(F.trim("value"), r"\s+")
    rows = lines_of(spark, source).where(F.trim("value") != "")
    return rows.select(t[0].alias("chrom"), F.regexp_replace(t[1], ",", "").try_cast("long").alias("size")).where("size IS NOT NULL")
