"""Quality rules with thresholds that follow the data: quantile sketches by language and source; DataFrame functions only.

A sketch counts the whole values of a metric: values of four and more digits by their first three digits. So it has a bounded number of counts,
is merged by adding them up and is the same whatever the order and the partitions. A group's threshold is the value at the rank TAIL of its own
sketch, drawn to its language's threshold, and that one to the one of all rows, as if by PRIOR further rows: the fewer rows a group has, the more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

SPACE = r"[\x20\x09-\x0D]+"
WIDTH = 8
METRICS = ("symbols", "dup_lines", "repeats", "word_length")
#: The rank of the threshold: a rule rejects no more than the rest of a group, in hundredths.
TAIL = 97
#: Rows that a group's parent counts for.
PRIOR = 100


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of its whole texts (null: none).

    Repeated windows are found by 64-bit hashes, built by doubling; equal hashes count as equal windows.
    """
    pairs = lambda a, n, d: F.zip_with(F.slice(a, F.lit(1), n - d), F.slice(a, F.lit(1 + d), n - d), lambda x, y: F.xxhash64(x, y))
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", F.filter(F.split(body, SPACE), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("_joined", F.concat_ws("", "_words")).withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("word_chars", F.char_length("_joined").cast("long"))
    out = out.withColumn("n_symbols", (F.char_length("_joined") - F.char_length(F.regexp_replace("_joined", r"[#*$%&|<>]+", ""))).cast("long"))
    out = out.withColumn("n_lines", F.size("_lines").cast("long")).withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    n = F.greatest(F.col("n_words").cast("int"), F.lit(WIDTH - 1))
    hashes = F.when(F.col("n_words") >= WIDTH, F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_h", pairs(hashes, n, 1))
    out = out.withColumn("_h", pairs(F.col("_h"), n - 1, 2)).withColumn("_h", pairs(F.col("_h"), n - 3, 4))
    out = out.withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
    out = out.withColumn("_s", F.when(F.col("_twice"), F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    m = F.size("_s")
    same = F.zip_with(F.slice("_s", F.lit(1), m - 1), F.slice("_s", F.lit(2), m - 1), lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"])))
    out = out.withColumn("_p", F.when(F.col("_twice"), F.sort_array(F.array_distinct(F.flatten(F.array_compact(same))))))
    k = F.size("_p")
    gaps = F.zip_with(F.slice("_p", F.lit(1), k - 1), F.slice("_p", F.lit(2), k - 1), lambda a, b: F.least(b - a, F.lit(WIDTH)).cast("long"))
    total = F.aggregate(gaps, F.lit(WIDTH).cast("long"), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(F.col("_twice"), total), F.lit(0).cast("long")))
    return out.drop("_words", "_lines", "_joined", "_h", "_twice", "_s", "_p")


def _metrics() -> dict[str, Column]:
    """Whole numbers: shares in thousandths, the mean word length in tenths, of larger ones the first three digits; 0 where there is nothing to divide by."""
    whole = lambda a, b, k: f"coalesce({k} * {a} div nullif({b}, 0), 0L)"
    values = {"symbols": whole("n_symbols", "word_chars", 1000), "dup_lines": whole("n_dup_lines", "n_lines", 1000), "repeats": whole("n_repeat_words", "n_words", 1000), "word_length": whole("word_chars", "n_words", 10)}
    return {m: F.expr(f"{v} - {v} % cast(pow(10, greatest(length(cast({v} AS string)) - 3, 0)) AS bigint)") for m, v in values.items()}


def base_failed() -> Column:
    """Under 20 words, or more than 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n): the sketch of every metric for every language and source, of rows that don't fail the base rules; nulls are values."""
    rows = F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("bucket")) for name, value in _metrics().items()])
    flat = measured.where(~base_failed()).select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(rows).alias("m"))
    return flat.groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, metric, rows, q): of each group the least bucket that TAIL hundredths of its rows don't exceed."""
    up = Window.partitionBy(*by, "metric").orderBy("bucket")
    whole = Window.partitionBy(*by, "metric")
    ranked = sketch.withColumn("_to", F.sum("n").over(up)).withColumn("_all", F.sum("n").over(whole))
    return ranked.groupBy(*by, "metric").agg(F.min(F.when(F.col("_to") * 100 >= F.col("_all") * TAIL, F.col("bucket"))).alias("q"), F.max("_all").alias("rows"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source, max_<metric>...): every group's thresholds."""
    drawn = lambda n, q, parent: (n * q + PRIOR * parent) / (n + PRIOR)
    whole = quantiles(merged(sketch), *()).select("metric", F.col("q").cast("double").alias("_whole"))
    tongue = quantiles(merged(sketch, "lang"), "lang").join(F.broadcast(whole), "metric")  # one row a metric
    tongue = tongue.select(F.col("lang").alias("_lang"), F.col("metric").alias("_metric"), drawn(F.col("rows"), F.col("q"), F.col("_whole")).alias("_tongue"))
    own = quantiles(sketch, "lang", "source")
    own = own.join(tongue, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("metric") == F.col("_metric")))
    own = own.withColumn("cut", drawn(F.col("rows"), F.col("q"), F.col("_tongue")))
    return own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == name, F.col("cut"))).alias(f"max_{name}") for name in METRICS])


def judge(docs: DataFrame) -> DataFrame:
    """docs' doc_id, the measures, base_failed and kept.

    base_failed: under 20 words, or more than 30 % of the words in repeated windows. kept: not base_failed, and no metric above its group's
    threshold. Null texts have no words and fail; null languages and sources are groups; repeated rows are judged alike; an
    empty table gives no rows.
    """
    work = Work(docs.sparkSession)
    columns = docs.select("doc_id", "lang", "source", "text")
    measured = work.put(text_measures(columns).drop("text"), "measured")
    cuts = work.put(thresholds(work.put(sketches(measured), "sketch")).withColumnsRenamed({"lang": "_lang", "source": "_source"}), "cuts")
    fine = ~base_failed()
    for name, value in _metrics().items():
        fine &= F.coalesce(value <= F.col(f"max_{name}"), F.lit(True))
    joined = measured.join(cuts, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), fine.alias("kept"))
