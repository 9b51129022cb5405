"""Genes, their ontology terms and expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import interval, metadata
from .filters import as_list


def select_genes(genes: DataFrame, names=None, go_terms=None, chromosomes=None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Genes by name or id, or by id or label of a term; a range takes genes that touch it, both ends included."""
    names, terms = as_list(names), as_list(go_terms)
    if names or terms:
        by_name = F.col("gene_name").isin(*names) | F.col("gene_id").isin(*names) if names else F.lit(False)
        by_term = F.exists("go_terms", lambda t: t["go_id"].isin(*terms) | t["go_label"].isin(*terms)) if terms else F.lit(False)
        genes = genes.where(by_name | by_term)
    if chosen := as_list(chromosomes):
        genes = genes.where(F.col("chrom").isin(*chosen))
    if start is not None:
        genes = genes.where(F.col("end") >= start)
    if end is not None:
        genes = genes.where(F.col("start") <= end)
    return genes


def select_expressions(expressions: DataFrame, genes: DataFrame, sample_ids=None, replicas=None, identifiers=None, projects=None, strict: bool = True) -> DataFrame:
    """Expressions with the place of their gene: by id up to the first '.', or else by name. strict: an expression without gene is an error."""
    for name, values in (("sample_id", sample_ids), ("replica", replicas), ("project", projects)):
        if values := as_list(values):
            expressions = expressions.where(F.col(name).isin(*values))
    if values := as_list(identifiers):
        expressions = expressions.where(F.col("tracking_id").isin(*values) | F.col("gene_name").isin(*values))
    place = ["chrom", "start", "end", "strand"]
    ids = genes.groupBy(F.substring_index("gene_id", ".", 1).alias("_id")).agg(F.min(F.struct(*place)).alias("_by_id"))
    named = genes.groupBy(F.col("gene_name").alias("_name")).agg(F.min(F.struct(*place)).alias("_by_name"))
    out = expressions.join(ids, F.substring_index("tracking_id", ".", 1) == F.col("_id"), "left").join(named, F.col("gene_name") == F.col("_name"), "left")
    found = F.coalesce("_by_id", "_by_name")
    if strict:
        out = out.withColumn("_ok", F.when(found.isNull(), F.raise_error(F.concat(F.lit("no gene for "), F.coalesce("tracking_id", F.lit("null"))))).otherwise(True)).where("_ok OR _ok IS NULL").drop("_ok")
    return out.withColumn("_place", found).select("_place.*", *expressions.columns)


def count_terms(genes: DataFrame) -> DataFrame:
    """Genes of each ontology term."""
    one = genes.select("gene_id", F.explode("go_terms").alias("t")).select("gene_id", "t.go_id", "t.go_label").distinct()
    return one.groupBy("go_id", "go_label").agg(F.count("*").alias("count"))


def annotated(genes: DataFrame, gene: str, term: tuple[str, str, str]) -> DataFrame:
    """genes with one more term (go_id, go_label, go_namespace) for the gene of that id or name, if it has it not yet."""
    new = F.struct(*[F.lit(v).alias(k) for k, v in zip(("go_id", "go_label", "go_namespace"), term, strict=True)])
    mine = ((F.col("gene_id") == gene) | (F.col("gene_name") == gene)) & ~F.exists("go_terms", lambda t: t["go_id"] == term[0])
    return genes.withColumn("go_terms", F.when(mine, F.concat("go_terms", F.array(new))).otherwise(F.col("go_terms")))


def closure(edges: DataFrame, terms: DataFrame) -> DataFrame:
    """(child, ancestor) of all terms (go_id) by edges (parent, child); each term is its own ancestor."""
    below = metadata.descendants(edges, terms.select(F.col("go_id").alias("node")))
    return below.select(F.col("node").alias("child"), F.col("root").alias("ancestor"))


def terms_upwards(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(gene_id, go_id) annotations with all ancestors of each term; closure is (child, ancestor) with each term its own ancestor."""
    return annotations.join(closure, annotations["go_id"] == closure["child"]).select("gene_id", F.col("ancestor").alias("go_id")).distinct()


def term_tables(genes: DataFrame, regions: DataFrame) -> DataFrame:
    """For each term the two-by-two table of genes that overlap the regions: a with the term, b its other genes, c other overlapping genes, d the rest."""
    place = ["gene_id", "chrom", "start", "end", "go_terms"]
    met = interval.intersection(genes.select(*place), regions.select("chrom", "start", "end"))
    totals = genes.agg(F.countDistinct("gene_id").alias("_all")).crossJoin(met.agg(F.countDistinct("gene_id").alias("_met")))  # one row
    whole = count_terms(genes).select("go_id", "go_label", F.col("count").alias("_total"))
    mine = count_terms(met).select("go_id", F.col("count").alias("a"))
    t = whole.join(mine, "go_id").crossJoin(F.broadcast(totals))
    a, b, c = F.col("a"), F.col("_total") - F.col("a"), F.col("_met") - F.col("a")
    return t.select("go_id", "go_label", a, b.alias("b"), c.alias("c"), (F.col("_all") - (a + b + c)).alias("d"), (a / F.col("_total")).alias("ratio"))
