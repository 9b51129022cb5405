"""Joins, transforms and aggregates against literals and brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.functions import metafields, naming, statistics
from locusframe.operators import aggregate, enrichment, filters, genes, interval, metadata, sequences, transform
from locusframe.plans.region_set import RegionSet


def regions(spark, items, extra=""):
    return spark.createDataFrame(items, "chrom string, start long, end long" + extra)


def some(seed, n, widths=(0, 1, 5, 40, 300, 5000, 70_000)):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        s = draw.randrange(0, 400_000)
        out.append((f"chr{draw.randrange(3)}", s, s + draw.choice(widths)))
    return out + out[:3]


def hits(a, b):
    return a[0] == b[0] and a[1] < b[2] and a[2] > b[1]


@pytest.fixture(scope="module")
def sets():
    return some(1, 250), some(2, 120)


def test_pairs_are_those_of_brute_force(spark, sets, as_rows):
    a, b = sets
    want = sorted((*x, *y[1:]) for x in a for y in b if hits(x, y))
    assert as_rows(interval.pairs(regions(spark, a), regions(spark, b)), "chrom", "start", "end", "r_start", "r_end") == want


def test_semi_and_anti_join_add_up(spark, sets, as_rows):
    a, b = sets
    da, db = regions(spark, a), regions(spark, b)
    met, free = as_rows(interval.intersection(da, db)), as_rows(interval.subtraction(da, db))
    assert met == sorted(x for x in a if any(hits(x, y) for y in b))
    assert sorted(met + free) == sorted(a)
    assert interval.count_overlaps(da, db).first()["count"] == len(met)


@pytest.mark.parametrize("amount,kind", [(10, "bp"), (165, "bp"), (50, "%"), (110, "%")])
def test_thresholds(spark, sets, as_rows, amount, kind):
    a, b = sets

    def least(r):
        return amount if kind == "bp" else -(-(r[2] - r[1]) * amount // 100)

    want = sorted(x for x in a if any(hits(x, y) and max(y[2] - x[1], x[2] - y[1]) >= max(least(x), least(y)) for y in b))
    assert as_rows(interval.overlap(regions(spark, a), regions(spark, b), True, amount, kind)) == want

    def far(x):
        mine = [y for y in b if y[0] == x[0]]
        if any(hits(x, y) for y in mine):
            return False
        after = [y for y in mine if y[1] >= x[2]]
        if after:
            y = min(after, key=lambda y: y[1:])
            return y[1] - x[2] >= max(least(x), least(y))
        if mine:
            y = max(mine, key=lambda y: y[1:])
            return x[1] - y[2] >= least(y)
        return True

    assert as_rows(interval.overlap(regions(spark, a), regions(spark, b), False, amount, kind)) == sorted(x for x in a if far(x))


def test_no_ranges(spark, as_rows):
    a = [("chr1", 5, 9)]
    none = regions(spark, [])
    assert as_rows(interval.intersection(regions(spark, a), none)) == []
    assert as_rows(interval.overlap(regions(spark, a), none, False, 100)) == a
    assert interval.pairs(none, regions(spark, a)).count() == 0


def test_abutting_regions(spark, as_rows):
    data = [("chr1", 3050000, 3050022), ("chr1", 3050022, 3050051), ("chr1", 3050051, 3050080), ("chr1", 3050040, 3050100)]
    met = interval.intersection(regions(spark, data), regions(spark, [("chr1", 3050022, 3050100)]))
    assert as_rows(met) == sorted(data[1:])


def test_disjoin_covers_what_was_covered(spark, sets, as_rows):
    a = [x for x in sets[0] if x[2] > x[1]]
    ends = {}
    for c, s, e in a:
        ends.setdefault(c, set()).update((s, e))
    want = sorted((c, s, e) for c, x in ends.items() for s, e in zip(sorted(x), sorted(x)[1:]) if any(hits((c, s, e), y) for y in a))
    assert as_rows(transform.disjoin(regions(spark, a))) == want


def test_coverage(spark, sets):
    a = [x for x in sets[0] if x[2] > x[1]]
    sizes = spark.createDataFrame([(f"chr{i}", 500_000) for i in range(3)], "chrom string, size long")
    got = {r["chrom"]: r["total"] for r in aggregate.coverage(regions(spark, a), sizes).collect()}
    for c in got:
        bases = set()
        for _, s, e in (x for x in a if x[0] == c):
            bases.update(range(s, e))
        assert got[c] == len(bases)


def test_tiles_leave_out_the_last(spark, as_rows):
    sizes = spark.createDataFrame([("chr1", 30), ("chr2", 31), ("chr3", 5)], "chrom string, size long")
    assert as_rows(transform.tiling(sizes, 10)) == [("chr1", 0, 10), ("chr1", 10, 20), ("chr2", 0, 10), ("chr2", 10, 20), ("chr2", 20, 30)]


def test_extend_and_flank(spark, as_rows):
    r = regions(spark, [("c", 1000, 2000, "+"), ("c", 1000, 2000, "-"), ("c", 5, 10, ".")], ", strand string")
    pick = ["strand", "start", "end"]
    assert as_rows(transform.extend(r, 100, "FORWARD", True), *pick) == [("+", 1000, 2100), ("-", 900, 2000), (".", 5, 110)]
    assert as_rows(transform.extend(r, 100, "BACKWARD", True), *pick) == [("+", 900, 2000), ("-", 1000, 2100), (".", 0, 10)]
    assert as_rows(transform.extend(r, 100), *pick) == [("+", 900, 2100), ("-", 900, 2100), (".", 0, 110)]
    assert as_rows(transform.flank(r, 500, 200, True), *pick) == [("+", 2500, 2700), ("-", 300, 500), (".", 510, 710)]
    assert as_rows(transform.flank(r, -500, 200, True), *pick) == [("+", 500, 700), ("-", 2300, 2500), (".", 0, 0)]


def test_aggregate_statistics(spark):
    data = regions(spark, [("chr1", 0, 10, 4.0), ("chr1", 5, 15, 8.0), ("chr1", 12, 20, 1.0), ("chr2", 0, 10, 1.0)], ", value double")
    out = aggregate.aggregate(data, regions(spark, [("chr1", 0, 10), ("chr1", 100, 110), ("chr9", 0, 5)]), "value")
    got = {(r["chrom"], r["start"]): r for r in out.collect()}
    assert set(got) == {("chr1", 0), ("chr1", 100)}
    r = got["chr1", 0]
    assert (r["agg_min"], r["agg_max"], r["agg_sum"], r["agg_median"], r["agg_var"], r["agg_count"]) == (4, 4, 8, 4, 0, 2)
    assert got["chr1", 100]["agg_count"] == 0
    starts = aggregate.aggregate(data, regions(spark, [("chr1", 0, 20)]), "start").first()
    assert (starts["agg_min"], starts["agg_max"], starts["agg_median"]) == (0, 12, 5)


def test_upper_median_and_binning(spark):
    v = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 10)], "v double")
    assert v.agg(aggregate.upper_median("v").alias("m")).first()["m"] == 3
    bins = {r["bin"]: r["count"] for r in aggregate.binning(v, "v", 3).collect()}
    assert bins == {0: 3, 1: 0, 2: 1}
    assert aggregate.binning(v.limit(0), "v", 3).count() == 0
    with pytest.raises(ValueError):
        aggregate.binning(v, "v", 0)


def test_score_matrix(spark, as_rows):
    data = regions(spark, [("c", 0, 10, 2.0, "x"), ("c", 5, 10, 4.0, "x"), ("c", 0, 10, 6.0, "y")], ", value double, experiment string")
    tiles = regions(spark, [("c", 0, 10), ("c", 10, 20)])
    assert as_rows(aggregate.score_matrix(data, tiles, {"x": "value", "y": "value"}, "mean")) == [("c", 0, 10, 3.0, 6.0), ("c", 10, 20, None, None)]
    assert as_rows(aggregate.score_matrix(data, tiles, {"x": "value"}, "acc"))[0][3] == "2.0000|4.0000"


def test_merge_keeps_one_of_equal_rows(spark):
    a = regions(spark, [("c", 0, 10, 1), ("c", 0, 10, 1)], ", dataset_id int")
    b = regions(spark, [("c", 0, 10, 1), ("c", 0, 10, 2)], ", dataset_id int")
    assert transform.merge(a, b).count() == 2


def test_filters(spark, as_rows):
    r = regions(spark, [("c", 0, 10, "x", "1.5"), ("d", 0, 3, "y", "word")], ", name string, raw string")
    assert as_rows(filters.filter_regions(r, "NAME", "!=", "x"), "chrom") == [("d",)]
    assert as_rows(filters.filter_regions(r, "@LENGTH", ">=", 10, "number"), "chrom") == [("c",)]
    assert as_rows(filters.filter_regions(r, "RAW", "<", 2, "number"), "chrom") == [("c",)]
    for bad in ("", "a$b", "nowhere"):
        with pytest.raises(ValueError):
            filters.filter_regions(r, bad, "==", "x")


def test_fisher():
    assert statistics.fisher_p(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert statistics.fisher_p(8, 2, 1, 5) == pytest.approx(0.03496503496)
    assert statistics.fisher_p(0, 0, 0, 0) == 1.0


def test_enrichment_by_tiles(spark):
    sizes = spark.createDataFrame([("c", 1000)], "chrom string, size long")
    q = regions(spark, [("c", 0, 100)])
    db = regions(spark, [("c", 50, 250, 1), ("c", 900, 950, 2)], ", dataset_id int")
    t = {r["dataset_id"]: (r["a"], r["b"], r["c"], r["d"]) for r in enrichment.fast_tables(q, db, sizes, bits=100).collect()}
    width = 1000 // 100 + 1 + 1
    touch = lambda s, e: set(range(s // width, e // width + 1))
    for k, (s, e) in {1: (50, 250), 2: (900, 950)}.items():
        x, y = touch(s, e), touch(0, 100)
        assert t[k] == (len(x & y), len(x - y), len(y - x), 100 - len(x | y))
    out = enrichment.enrich_overlap(q, db, transform.tiling(sizes, 10))
    assert {r["dataset_id"]: r["a"] for r in out.collect()} == {1: 5, 2: 0}


def test_signatures_hold_only_words_with_tiles(spark):
    sizes = spark.createDataFrame([("c", 300_000), ("d", 200_000)], "chrom string, size long")
    width = 500_000 // 100_000 + 2 + 1
    first = {"c": 0, "d": 300_000 // width + 1}
    draw = random.Random(5)
    items = [("d", 0, 0, 1), ("c", 63 * width, 64 * width, 1), ("c", 0, 200 * width, 2)]
    for _ in range(300):
        start = draw.randrange(290_000)
        items.append((draw.choice("cd"), start, start + draw.choice([0, 3, 70, 4000]), draw.randrange(1, 4)))
    want = {}
    for chrom, start, end, k in items:
        want.setdefault(k, set()).update(range(first[chrom] + start // width, first[chrom] + end // width + 1))
    got, found = {}, enrichment.signatures(regions(spark, items, ", dataset_id int"), sizes, bits=100_000)
    for k, word, tiles in found.collect():
        assert tiles
        got.setdefault(k, set()).update(word * 64 + i for i in range(64) if tiles >> i & 1)
    assert got == want
    # bitmaps of whole buckets held 4096 bytes each
    assert dict(found.dtypes)["tiles"] == "bigint" and found.count() == sum(len({t // 64 for t in x}) for x in want.values())


@pytest.mark.parametrize("ahead", [0, 17, 63, 64, 100])
def test_tables_of_tiles_by_words(spark, ahead):
    sizes = spark.createDataFrame([("c", 100_000)], "chrom string, size long")
    width = 100_000 // 20_000 + 1 + 1
    q, items = [("c", ahead * width, (ahead + 70) * width)], [("c", 0, 40 * width, 1), ("c", 20 * width, 90 * width, 1), ("c", 99_000, 99_001, 2)]
    got = {r[0]: tuple(r)[1:] for r in enrichment.fast_tables(regions(spark, q), regions(spark, items, ", dataset_id int"), sizes, bits=20_000).collect()}
    y = set(range(ahead, ahead + 71))
    for k, x in {1: set(range(91)), 2: {99_000 // width, 99_001 // width}}.items():
        assert got[k] == (len(x & y), len(x - y), len(y - x), 20_000 - len(x | y))


def test_signatures_are_dealt_out_once(spark):
    sizes = spark.createDataFrame([("c", 100_000)], "chrom string, size long")
    items = [("c", k * 400, k * 400 + 900, k % 3) for k in range(200)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where Spark takes the query's words for large
    try:
        found = enrichment.fast_tables(regions(spark, items[::7], ", dataset_id int").drop("dataset_id"), regions(spark, items, ", dataset_id int"), sizes, bits=20_000)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r[0]: tuple(r)[1:] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "hashpartitioning(dataset_id" in plan
    width = 100_000 // 20_000 + 1 + 1
    touched = lambda some: {t for _, start, end, _ in some for t in range(start // width, end // width + 1)}
    y = touched(items[::7])
    for k in range(3):
        x = touched([i for i in items if i[3] == k])
        assert got[k] == (len(x & y), len(x - y), len(y - x), 20_000 - len(x | y))


def test_names():
    assert naming.alignment("abc", "abc") == 1
    assert naming.alignment("abcd", "xbcx") == 0.5
    assert naming.alignment("", "x") == 0


def test_normalised_names(spark):
    df = spark.createDataFrame([("H3K04me3",), ("A b-C+",)], "n string")
    assert [r[0] for r in df.select(naming.normalised_mark(F.col("n"))).collect()] == ["h3k4me3", "abc+"]


def test_sequences_over_chunks(spark, as_rows):
    s = spark.createDataFrame([("c", "AAATTTGGGCCC" * 5)], "chrom string, bases string")
    chunks = sequences.chunked(s, 7)
    r = regions(spark, [("c", 5, 20), ("c", 55, 99)])
    assert as_rows(sequences.with_sequence(r, chunks, 7), "start", "sequence") == [(5, ("AAATTTGGGCCC" * 5)[5:20]), (55, ("AAATTTGGGCCC" * 5)[55:])]
    assert as_rows(sequences.find_motif(spark.createDataFrame([("c", "AAAA")], "chrom string, bases string"), "AA")) == [("c", 0, 2), ("c", 2, 4)]
    assert len(as_rows(sequences.find_motif(spark.createDataFrame([("c", "AAAA")], "chrom string, bases string"), "AA", overlap=True))) == 3


def test_hierarchy(spark, as_rows):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "parent string, child string")
    out = metadata.descendants(edges, spark.createDataFrame([("a",)], "node string"))
    assert as_rows(out, "node", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    with pytest.raises(ValueError):
        metadata.with_edge(edges, "c", "a")


def test_vocabulary(spark):
    t = spark.createDataFrame([("e1", "Cell A")], "id string, name string")
    assert metadata.name_to_id(t, "cell a").first()["id"] == "e1"
    with pytest.raises(ValueError):
        metadata.added(t, spark.createDataFrame([("e2", "cell-A")], "id string, name string"))
    with pytest.raises(ValueError):
        metadata.removed(t, "e1", [(spark.createDataFrame([("e1",)], "ref string"), "ref")])
    assert metadata.removed(t, "e1").count() == 0


def test_expressions_need_genes(spark, as_rows):
    g = spark.createDataFrame([("G1.3", "abc", "c", 1, 5, "+")], "gene_id string, gene_name string, chrom string, start long, end long, strand string")
    e = spark.createDataFrame([("G1.9", None, 1.0), ("zz", "abc", 2.0)], "tracking_id string, gene_name string, fpkm double")
    assert as_rows(genes.select_expressions(e, g), "chrom", "fpkm") == [("c", 1.0), ("c", 2.0)]
    bad = e.unionByName(spark.createDataFrame([("none", None, 3.0)], e.schema))
    with pytest.raises(Exception, match="no gene"):
        genes.select_expressions(bad, g).collect()


def test_formats(spark):
    r = regions(spark, [("c", 1, 5, 2.5, None)], ", value double, strand string")
    line = metafields.as_text(metafields.formatted(r, "CHROMOSOME,VALUE,@CALCULATED(greatest(start, 3)),START,START,@STRAND")).first()[0]
    assert line == "c\t2.5000\t3.000000\t1\t1\t"


def test_region_set_is_lazy_and_remembers(spark):
    a = RegionSet(regions(spark, [("c", 1, 5), ("c", 10, 20)]))
    q = a.extend(2).intersection(RegionSet(regions(spark, [("c", 6, 8)]))).filter("@LENGTH", ">", 1, "number")
    assert q.count() == 1
    assert q.steps == ("extend(2, BOTH)", "intersection", "filter(@LENGTH > 1)")


def test_no_job_runs_while_a_join_is_built(spark):
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        data = regions(spark, [("c", 1, 5, 1.0)], ", value double")
        ranges = regions(spark, [("c", 0, 10), ("c", 0, 100_000)])
        made = [interval.pairs(data, ranges), aggregate.aggregate(data, ranges, "value"), interval.overlap(data, ranges, amount=2)]
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("building")
        assert [d.count() for d in made] == [2, 2, 1]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_statistics_are_those_of_all_values(spark):
    draw = random.Random(11)
    values = [draw.choice([-1.5, 0.0, 2.0, 2.25, 7.0, 1e6 + draw.random()]) for _ in range(301)]
    data = regions(spark, [("c", i % 90, i % 90 + 10, v) for i, v in enumerate(values)] + [("c", 5, 9, None)], ", value double")
    r = aggregate.aggregate(data, regions(spark, [("c", 0, 100)]), "value").first()
    ordered = sorted(values)
    assert (r["agg_min"], r["agg_max"], r["agg_median"], r["agg_count"]) == (ordered[0], ordered[-1], ordered[150], 301)
    assert r["agg_mean"] == pytest.approx(np.mean(values)) and r["agg_sum"] == pytest.approx(sum(values))
    assert r["agg_var"] == pytest.approx(np.var(values)) and r["agg_sd"] == pytest.approx(np.std(values))
    wide = aggregate.score_matrix(data.withColumn("experiment", F.lit("e")), regions(spark, [("c", 0, 100), ("d", 0, 9)]), {"e": "value"}, "median")
    assert {(x["chrom"], x["e"]) for x in wide.collect()} == {("c", ordered[150]), ("d", None)}


@pytest.mark.parametrize("motif", ["ab", "a+b?", "(ab|ba)+"])
def test_motifs_in_pieces_as_in_whole(spark, as_rows, motif):
    draw = random.Random(3)
    bases = spark.createDataFrame([(f"c{i}", "".join(draw.choice("abc") for _ in range(n))) for i, n in enumerate((0, 1, 50, 1000))] + [("none", None)], "chrom string, bases string")
    for start, end in ((0, None), (7, 400)):
        whole = as_rows(sequences.find_motif(bases, motif, start=start, end=end))
        assert as_rows(sequences.find_motif(bases, motif, start=start, end=end, longest=40, size=50)) == whole
    assert as_rows(sequences.find_motif(bases, motif, overlap=True)) == as_rows(sequences.find_motif(bases, motif, overlap=True, longest=40, size=64))


def test_repeated_regions_and_missing_sequences(spark, as_rows):
    s = spark.createDataFrame([("c", "abcdefghij")], "chrom string, bases string")
    r = spark.createDataFrame([("c", 2, 5), ("c", 2, 5), ("c", 8, 20), ("d", 0, 3)], "chrom string, start long, end long")
    out = as_rows(sequences.with_sequence(r, sequences.chunked(s, 4), 4))
    assert out == [("c", 2, 5, "cde"), ("c", 2, 5, "cde"), ("c", 8, 20, "ij"), ("d", 0, 3, "")]


def test_deep_trees_are_walked_to_the_end(spark):
    edges = spark.createDataFrame([(str(i), str(i + 1)) for i in range(12)] + [("12", "0")], "parent string, child string")
    assert metadata.descendants(edges, spark.createDataFrame([("0",)], "node string")).count() == 13
