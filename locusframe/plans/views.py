"""Regions, genes, data sets and vocabularies as views of business tables, in words that any SQL engine has."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 200_500

#: The same views in SQL.
SQL = {
    "a": "SELECT 'chr' || (l_suppkey % 5) AS chrom, l_partkey * 100 + l_linenumber * 10 AS start, l_partkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS \"end\", l_extendedprice AS score, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_suppkey AS dataset_id FROM lineitem",
    "b": "SELECT 'chr' || (o_custkey % 5) AS chrom, (o_orderkey * 131) % 200000 AS start, (o_orderkey * 131) % 200000 + 50 + o_orderkey % 100 AS \"end\", o_custkey AS dataset_id FROM orders",
    "sizes": f"SELECT 'chr' || r_regionkey AS chrom, CAST({SIZE} AS BIGINT) AS size FROM region",
    "datasets": "SELECT s_suppkey AS dataset_id, s_name AS name, r_name AS genome, n_name AS biosource, 'project' || (s_nationkey % 3) AS project, CASE WHEN s_suppkey % 2 = 0 THEN 'peaks' ELSE 'signal' END AS content_format, 'H3K' || (s_suppkey % 4) || 'me' || (s_suppkey % 3) AS epigenetic_mark FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "genes": "SELECT 'G' || p_partkey AS gene_id, p_name AS gene_name, 'chr' || (p_partkey % 5) AS chrom, p_partkey * 97 % 200000 AS start, p_partkey * 97 % 200000 + 200 + p_size AS \"end\", CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_brand AS brand, p_type AS type FROM part",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") * 100 + F.col("l_linenumber") * 10
    return _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey") % 5).alias("chrom"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long")).alias("end"),
        F.col("l_extendedprice").alias("score"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"),
        F.col("l_suppkey").alias("dataset_id"),
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("o_orderkey") * 131) % 200000
    return _read(spark, sf_dir, "orders").select(F.concat(F.lit("chr"), F.col("o_custkey") % 5).alias("chrom"), start.alias("start"), (start + 50 + F.col("o_orderkey") % 100).alias("end"), F.col("o_custkey").alias("dataset_id"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "region").select(F.concat(F.lit("chr"), "r_regionkey").alias("chrom"), F.lit(SIZE).cast("long").alias("size"))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (_read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        k.alias("dataset_id"),
        F.col("s_name").alias("name"),
        F.col("r_name").alias("genome"),
        F.col("n_name").alias("biosource"),
        F.concat(F.lit("project"), F.col("s_nationkey") % 3).alias("project"),
        F.when(k % 2 == 0, "peaks").otherwise("signal").alias("content_format"),
        F.concat(F.lit("H3K"), k % 4, F.lit("me"), k % 3).alias("epigenetic_mark"),
    )


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with the brand and the type as ontology terms."""
    k = F.col("p_partkey")
    start = k * 97 % 200000
    return _read(spark, sf_dir, "part").select(
        F.concat(F.lit("G"), k).alias("gene_id"),
        F.col("p_name").alias("gene_name"),
        F.concat(F.lit("chr"), k % 5).alias("chrom"),
        start.alias("start"),
        (start + 200 + F.col("p_size")).alias("end"),
        F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.array(*[F.struct(F.col(c).alias("go_id"), F.col(c).alias("go_label"), F.lit(n).alias("go_namespace")) for c, n in (("p_brand", "brand"), ("p_type", "type"))]).alias("go_terms"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("attributes"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("chrom"), F.col("text").alias("bases"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and customer as parent and child."""
    n, c = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "customer")
    name = lambda kind, k: F.concat(F.lit(kind), F.col(k))
    return n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionByName(c.select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child")))


EDGES = "SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer"
