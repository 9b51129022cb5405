"""The catalogue of data sets: lists, facets, search, similarity, vocabularies with synonyms and parents."""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import LEAST, normalised, similarity
from .filters import as_list, select_datasets

FACETS = ("genome", "biosource", "epigenetic_mark", "project", "sample_id", "technique", "type")
SEARCH_LIMIT = 50


def listed(datasets: DataFrame, visible=None, **wanted) -> DataFrame:
    """dataset_id and name of the data sets that match."""
    return select_datasets(datasets, visible, **wanted).select("dataset_id", "name")


def recent(datasets: DataFrame, days: float, now) -> DataFrame:
    """Data sets whose upload ended at most days before now."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(days * 86400.0))
    return datasets.where(F.col("upload_end") >= since).orderBy(F.col("upload_end").desc())


def facet(datasets: DataFrame, name: str, visible=None, **wanted) -> DataFrame:
    """value and count of one column over the matching data sets."""
    found = select_datasets(datasets, visible, **wanted)
    return found.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("count"))


def facets(datasets: DataFrame, visible=None, names: Sequence[str] = FACETS, **wanted) -> DataFrame:
    """facet, value and count for each column, in one pass."""
    found = select_datasets(datasets, visible, **wanted)
    have = [n for n in names if n in datasets.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).cast("string").alias("value")) for n in have]))
    return found.select(rows.alias("x")).select("x.*").where("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("count"))


def similar(names: DataFrame, name: str, total: int = 20, column: str = "name") -> DataFrame:
    """The names most like name, from a similarity of LEAST on."""
    target = names.sparkSession.range(1).select(normalised(F.lit(name))).first()[0]
    scored = names.select(column).distinct().withColumn("similarity", similarity(normalised(F.col(column)), target))
    return scored.where(F.col("similarity") >= LEAST).orderBy(F.col("similarity").desc(), column).limit(total)


def search(datasets: DataFrame, keyword: str, kind: str | None = None, visible=None, limit: int = SEARCH_LIMIT) -> DataFrame:
    """Data sets that hold a word of keyword in name, description or metadata, by the number of hits; -word excludes."""
    text = F.lower(F.concat_ws(" ", *[F.array_join(F.map_values(c), " ") if t.startswith("map") else F.col(c).cast("string") for c, t in datasets.dtypes if c != "dataset_id"]))
    tokens = F.split(text, r"[^\p{L}\p{N}_+]+")
    wanted = [w.lower() for w in re.findall(r"(?<![\w-])[\w+]+", keyword)]
    banned = [w.lower() for w in re.findall(r"(?<!\w)-([\w+]+)", keyword)]
    rows = select_datasets(datasets, visible).withColumn("_tokens", tokens)
    if kind:
        rows = rows.where(F.col("type") == kind)
    if banned:
        rows = rows.where(~F.arrays_overlap("_tokens", F.array(*map(F.lit, banned))))
    score = F.size(F.filter("_tokens", lambda t: t.isin(*wanted))) if wanted else F.lit(0)
    return rows.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "dataset_id").limit(limit).select("dataset_id", "name", "score")


def datatable(rows: DataFrame, start: int, length: int, sort: str, descending: bool = False, filters: dict[str, str] | None = None) -> DataFrame:
    """A page of rows in order, after filters: column -> regular expression, case aside."""
    for name, pattern in (filters or {}).items():
        rows = rows.where(F.col(name).cast("string").rlike(f"(?i){pattern}"))
    order = F.col(sort).desc() if descending else F.col(sort).asc()
    rest = [c for c in rows.columns if c != sort]
    return rows.orderBy(order, *rest).offset(start).limit(length)


def info(rows: DataFrame, ids) -> DataFrame:
    return rows.where(F.col("id").isin(*as_list(ids)))


def is_biosource(table: DataFrame, name: str) -> bool:
    """Whether name is a biosource or a synonym of one; table is (root, synonym)."""
    return not table.where(normalised(F.col("synonym")) == normalised(F.lit(name))).isEmpty()


def list_expressions(expressions: DataFrame, visible=None, **wanted) -> DataFrame:
    """dataset_id and name of the expression data sets that match."""
    return select_datasets(expressions, visible, **wanted).select("dataset_id", "name")


def create_set(sets: DataFrame, name: str, datasets: DataFrame, members) -> DataFrame:
    """sets (set_name, name) and one more of the named data sets; an unknown name or a set of that name is an error."""
    wanted = F.array(*[normalised(F.lit(n)) for n in as_list(members)])
    found = datasets.where(F.array_contains(wanted, normalised(F.col("name")))).select(F.lit(name).alias("set_name"), "name")
    if found.select(normalised(F.col("name"))).distinct().count() < len({m.lower() for m in as_list(members)}):
        raise ValueError("a data set is not known")
    if not sets.where(normalised(F.col("set_name")) == normalised(F.lit(name))).isEmpty():
        raise ValueError(f"{name} exists already")
    return sets.unionByName(found)


def of_set(datasets: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """The data sets of a set."""
    mine = sets.where(normalised(F.col("set_name")) == normalised(F.lit(name))).select(normalised(F.col("name")).alias("_n"))
    return datasets.join(mine, normalised(F.col("name")) == F.col("_n"), "left_semi")


def name_to_id(rows: DataFrame, names) -> DataFrame:
    wanted = F.array(*[normalised(F.lit(n)) for n in as_list(names)])
    return rows.where(F.array_contains(wanted, normalised(F.col("name")))).select("id", "name")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): all nodes below each root through edges (parent, child), itself at depth 0; repeated ways and cycles count once.

    One join for each depth; each depth is checkpointed where the session has a checkpoint folder, so plans stay small.
    """
    found = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct()
    front, parts = found, [found]
    for depth in itertools.count(1):
        nxt = front.join(edges, front["node"] == edges["parent"]).select("root", F.col("child").alias("node"), F.lit(depth).alias("depth")).distinct()
        for seen in parts:
            nxt = nxt.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = nxt.checkpoint() if front.sparkSession.sparkContext.getCheckpointDir() else nxt.persist()
        if front.isEmpty():
            break
        parts.append(front)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def parents(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("child") == node).select(F.col("parent").alias("node"))


def synonyms(table: DataFrame, name: str) -> DataFrame:
    """All names of the root that name belongs to; table is (root, synonym) with each root its own synonym."""
    mine = table.where(normalised(F.col("synonym")) == normalised(F.lit(name))).select("root").distinct()
    return table.join(mine, "root", "left_semi").select(F.col("synonym").alias("name"))


def related(table: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """name's synonyms and all below its root, with theirs."""
    mine = table.where(normalised(F.col("synonym")) == normalised(F.lit(name))).select(F.col("root").alias("node")).distinct()
    below = descendants(edges, mine)
    return table.join(below.select(F.col("node").alias("root")).distinct(), "root", "left_semi").select(F.col("synonym").alias("name"))


def with_edge(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """edges and one more; an edge that would close a cycle is an error."""
    spark = edges.sparkSession
    new = spark.createDataFrame([(parent, child)], "parent string, child string")
    below = descendants(edges, spark.createDataFrame([(child,)], "node string"))
    if parent == child or not below.where(F.col("node") == parent).isEmpty():
        raise ValueError(f"{parent} is {child} or below it")
    return edges.select("parent", "child").unionByName(new)


def change_extra(datasets: DataFrame, dataset_id, key: str, value: str) -> DataFrame:
    """datasets with one entry of extra_metadata set; an empty value takes it away."""
    without = F.map_filter("extra_metadata", lambda k, _: k != key)
    new = F.map_concat(without, F.create_map(F.lit(key), F.lit(value))) if value else without
    return datasets.withColumn("extra_metadata", F.when(F.col("dataset_id") == dataset_id, new).otherwise(F.col("extra_metadata")))


def clone(datasets: DataFrame, dataset_id, new_id, **changes: str) -> DataFrame:
    """datasets and a copy of one under a new id, with changes; empty ones leave the value as it is. Its regions are the original's."""
    copy = datasets.where(F.col("dataset_id") == dataset_id).withColumn("dataset_id", F.lit(new_id).cast(datasets.schema["dataset_id"].dataType))
    copy = copy.withColumns({k: F.lit(v) for k, v in changes.items() if v})
    return datasets.unionByName(copy)


def added(table: DataFrame, rows: DataFrame, unique: str = "name") -> DataFrame:
    """table and rows; a normalised name that exists already, or twice in rows, is an error."""
    both = table.select(unique).unionByName(rows.select(unique)).groupBy(normalised(F.col(unique)).alias("n")).count().where("count > 1")
    taken = both.join(rows.select(normalised(F.col(unique)).alias("n")).distinct(), "n", "left_semi").first()
    if taken:
        raise ValueError(f"{taken['n']} exists already")
    return table.unionByName(rows, allowMissingColumns=True)


def removed(table: DataFrame, ids, references: Sequence[tuple[DataFrame, str]] = ()) -> DataFrame:
    """table without ids; an id that another table refers to is an error."""
    ids = as_list(ids)
    for other, column in references:
        if used := other.where(F.col(column).isin(*ids)).first():
            raise ValueError(f"{used[column]} is in use")
    return table.where(~F.col("id").isin(*ids))
