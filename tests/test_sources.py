"""Files, schemas, storage and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from locusframe.schema import ColumnType, Registry, all_or_nothing, located
from locusframe.sources import store, text
from locusframe.streaming import tiles


def test_bed(spark, as_rows):
    lines = ["# x", "track y", "", "chr1\t1\t5\t2.5\tn", "chr1\t1\t5\t1", "chr1\tx\t5\t1\tn"]
    out = text.bed(spark, lines)
    assert as_rows(out.where("error IS NULL"), "chrom", "start", "end", "name", "score") == [("chr1", 1, 5, "n", 2.5)]
    assert out.where("error IS NOT NULL").count() == 2


def test_formats_of_four_tokens(spark):
    assert text.bed(spark, ["chr1\t1\t5\t2.5"]).columns == ["chrom", "start", "end", "score", "error"]
    assert text.bed(spark, ["chr1\t1\t5\tn1"]).columns == ["chrom", "start", "end", "name", "error"]


def test_useless_first_column(spark, as_rows):
    out = text.bed(spark, ["585\tchr1\t10\t20"], "CHROMOSOME,START,END")
    assert as_rows(out, "chrom", "start", "end", "error") == [("chr1", 10, 20, None)]


def wiggle(spark, body):
    return text.wig(spark, spark.createDataFrame([(body,)], "value string"))


def test_wiggle(spark, as_rows):
    good = "track type=wiggle_0\nfixedStep chrom=c start=1 step=10 span=5\n1\n2\nvariableStep chrom=c span=2\n100 7\n"
    assert as_rows(wiggle(spark, good), "chrom", "start", "end", "value") == [("c", 0, 5, 1.0), ("c", 10, 15, 2.0), ("c", 99, 101, 7.0)]
    for bad in ("fixedStep chrom=c step=1\n1", "fixedStep chrom=c start=1 step=1 span=2\n1", "track a\ntrack b\n", "variableStep chrom=c span=5\n1 1\n3 1", "5\n"):
        assert wiggle(spark, bad).where("error IS NOT NULL").count() == 1, bad


@pytest.mark.parametrize("head", ["fixedStep chrom=c start={} step=10\n1\n2\n3", "variableStep chrom=c\n{} 1\n{}1 2\n{}2 3"])
def test_many_wiggle_files_share_a_frame(head, monkeypatch):
    monkeypatch.setattr(text, "FRAME", 400)
    files = pd.DataFrame({"value": [head.replace("{}", str(k)) for k in range(1, 300)] + ["5"]})
    frames = list(text._wiggles(iter([files[:150], files[150:]])))
    assert [len(f) for f in frames] == [400, 400, 98]
    every = pd.concat(frames)
    assert every["value"].tolist()[:-1] == [1.0, 2.0, 3.0] * 299 and every["error"].tolist()[-1] == "bad line: 5"
    assert every["start"].tolist()[::3][:299] == list(range(299))


def test_wiggle_files_of_one_partition_are_many_tasks(spark, as_rows):
    files = spark.range(400, numPartitions=1).selectExpr("concat('variableStep chrom=c span=3\n', id * 10 + 1, ' ', id, '\n', id * 10 + 5, ' 1') AS value")
    found = text.wig(spark, files.union(spark.createDataFrame([("5",)], "value string")).coalesce(1))
    assert sorted(r[0] for r in found.groupBy(F.spark_partition_id()).count().select("count").collect())[0] >= 100  # 801 rows, 4 shuffle partitions
    assert found.select(F.spark_partition_id()).distinct().count() == 4
    assert [x[0] for x in as_rows(found.where("error IS NOT NULL"), "error")] == ["bad line: 5"]
    want = [("c", k * 10 + i, k * 10 + i + 3, float(k if i == 0 else 1)) for k in range(400) for i in (0, 4)]
    assert as_rows(found.where("error IS NULL"), "chrom", "start", "end", "value") == want


def test_gtf_and_expressions(spark, as_rows):
    lines = ['c\tsrc\tgene\t5\t9\t.\t+\t.\tgene_id "G1.2"; gene_name "abc";', 'c\tsrc\texon\t5\t9\t.\t+\t.\tgene_id "G1.2";']
    assert as_rows(text.gtf(spark, lines), "chrom", "start", "score", "gene_id", "gene_name") == [("c", 5, None, "G1.2", "abc")]
    salmon = ["Name\tLength\tEffectiveLength\tTPM\tNumReads", "t1\t10\t9.5\t3\t7"]
    assert as_rows(text.expressions(spark, salmon, "salmon"), "tracking_id", "tpm") == [("t1", 3.0)]


def test_sequences_and_sizes(spark, as_rows):
    assert as_rows(text.fasta(spark, spark.createDataFrame([(">c x\nACG\nT\n",)], "value string"))) == [("c", "ACGT")]
    assert as_rows(text.chromosome_sizes(spark, ["c 1,000", "", "d\t5"])) == [("c", 1000), ("d", 5)]
    assert as_rows(text.bedgraph(spark, ["c 1 2 0.5"]), "start", "value") == [(1, 0.5)]


def test_validation(spark, as_rows):
    sizes = spark.createDataFrame([("chr1", 100), ("M", 10)], "chrom string, size long")
    r = spark.createDataFrame([("1", 0, 10), ("chrM", 0, 20), ("z", 0, 1), ("chr1", 9, 3)], "chrom string, start long, end long")
    errors = {(x["chrom"], x["error"]) for x in located(r, sizes).collect()}
    assert errors == {("chr1", None), ("M", "outside the chromosome"), ("z", "unknown chromosome z"), ("chr1", "start after end")}
    fixed = located(r.where("start < end"), sizes, ignore_unknown=True, trim=True)
    assert as_rows(all_or_nothing(fixed), "chrom", "start", "end") == [("M", 0, 10), ("chr1", 0, 10)]
    with pytest.raises(ValueError):
        all_or_nothing(located(r, sizes))


def test_registry(spark):
    reg = Registry([ColumnType("LEVEL", "range", 0, 1), ColumnType("KIND", "category", items=("a", "b"))])
    df = spark.createDataFrame([("0.5", "a"), ("2", "c"), ("x", None)], "level string, kind string")
    assert [r[0] for r in df.select(F.coalesce(reg["level"].valid(F.col("level")), F.lit(False))).collect()] == [True, False, False]
    assert reg.may_become("LEVEL", "SCORE") and not reg.may_become("KIND", "SCORE")
    with pytest.raises(ValueError):
        reg.add(ColumnType("level", "double"))


def test_store_prunes(spark, tmp_path, as_rows):
    r = spark.createDataFrame([("c", i * 10, i * 10 + 5) for i in range(50)] + [("d", 0, 5)], "chrom string, start long, end long")
    store.save(r, str(tmp_path / "r"), "hg")
    got = store.load(spark, str(tmp_path / "r"), "hg", "c", 100, 120)
    assert as_rows(got, "start") == [(100,), (110,)]
    plan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(genome" in plan and "LessThan(start,120)" in plan
    store.write_text(r, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 51


def test_tiles_of_a_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 2.0), ("2024-01-01 01:10:00", 5.0), ("2024-01-03 00:00:00", 9.0)]
    df = spark.createDataFrame(rows, "t string, value double").select(F.col("t").cast("timestamp").alias("ts"), "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = tiles.aggregate_tiles(stream, "1 hour", late="1 hour").writeStream.format("memory").queryName("tiles_out").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(str(r["start"])[11:16], r["agg_sum"], r["agg_count"]) for r in spark.sql("SELECT * FROM tiles_out").collect()}
    batch = {(str(r["start"])[11:16], r["agg_sum"], r["agg_count"]) for r in tiles.aggregate_tiles(df, "1 hour").collect()}
    assert got == {("00:00", 3.0, 2), ("01:00", 5.0, 1)} and got < batch
