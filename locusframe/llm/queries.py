"""The numbered queries over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, cotraining, decontam, labelled, langid, neardup, quality_rules, sharding, suffixes, toxicity
from .common import Work, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


SHARDS = 24
VOCABULARY = "byte_bpe_50k.tiktoken"


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 equal shards by the law key."""
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=1.0)


def _escaped(x: str) -> str:
    return f"replace(replace({x}, '\\', '\\b'), '<|', '<\\p')"


@query(rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(17 + length(replace({_escaped('role')}, chr(10), '\n')) + length({_escaped('text')}))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id""")
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a reply tree of one branch, formatted and read back."""
    same = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.format_trees(chat.reply_tree(turns))
    out = out.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    whole = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


_METRICS = {"symbols": ("1000 * n_symbols", "word_chars"), "dup_lines": ("1000 * n_dup_lines", "n_lines"), "repeats": ("1000 * n_repeat_words", "n_words"), "word_length": ("10 * word_chars", "n_words")}


def _rules_sql() -> str:
    whole = {m: f"coalesce({a} // nullif({b}, 0), 0)::BIGINT" for m, (a, b) in _METRICS.items()}
    value = {m: f"({v} - {v} % (10 ** greatest(length({v}::VARCHAR) - 3, 0))::BIGINT)" for m, v in whole.items()}
    flat = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {v} AS v FROM f WHERE NOT base_failed" for m, v in value.items())

    def quantiles(name: str, *by: str) -> str:
        w = f"PARTITION BY {', '.join([*by, 'metric'])}"
        return f"""{name} AS (SELECT {', '.join([*by, 'metric'])}, min(v) FILTER (r * 100 >= n * {quality_rules.TAIL}) AS q, max(n) AS n
            FROM (SELECT *, row_number() OVER ({w} ORDER BY v) AS r, count(*) OVER ({w}) AS n FROM flat) GROUP BY ALL)"""

    drawn = lambda t, parent: f"({t}.n * {t}.q + {quality_rules.PRIOR} * {parent})::DOUBLE / ({t}.n + {quality_rules.PRIOR})"
    tests = " AND ".join(f"coalesce({v} <= (SELECT cut FROM best b WHERE b.metric = '{m}' AND b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source), true)" for m, v in value.items())
    return rf"""
    WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
    r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
    l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
    f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM (SELECT w.doc_id, w.lang, w.source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
        FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))),
    flat AS ({flat}),
    {quantiles('o', 'lang', 'source')}, {quantiles('t', 'lang')}, {quantiles('a')},
    tc AS (SELECT t.lang, t.metric, {drawn('t', 'a.q::DOUBLE')} AS cut FROM t JOIN a USING (metric)),
    best AS (SELECT o.lang, o.source, o.metric, {drawn('o', 'tc.cut')} AS cut FROM o JOIN tc ON tc.metric = o.metric AND tc.lang IS NOT DISTINCT FROM o.lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM (
        SELECT *, {tests} AS fine FROM f)"""


@query(_rules_sql())
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against thresholds of their language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def bpe_digests(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return decoded.select(
        "doc_id",
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as ids of the public 50k vocabulary, and back."""
    path = public_tokenizers.path(VOCABULARY)
    return bpe_digests(bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, back=True))


def remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


@query()
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; every third document, by checksum, is held out of training."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(3) == 1, F.lit(False))
    docs = docs.withColumns({"held_out": held_out, "fold": ~held_out & langid.held_back()})
    models = langid.fit(docs.where(~F.col("held_out") & ~F.col("fold")))
    found = Work(spark).put(langid.identify(docs, models, keep=("held_out", "fold", "lang")), "found")
    return langid.calibrated(found, F.col("fold")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, as it stands or with other numbers, names and units."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.array_join(F.col("items").cast("array<string>"), " ").alias("item_ids"), "matched_words", "reparameterised")


@query()
def op2_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least doc_id of its class of exact and near copies."""
    found = neardup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query()
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 100-byte strings that also start earlier."""
    out = suffixes.deduplicate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", suffixes.removed_bytes(F.col("spans")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; every fifth document, by checksum, is held out of learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.withColumn("held_out", labelled.held_out()), model, keep=("held_out",))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op1_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; every fifth document, by checksum, is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"))
    scored = cotraining.score(docs.withColumn("held_out", labelled.held_out()), model, keep=("doc_id", "held_out"))
    return scored.withColumns({"predicted": (F.col("score") >= 0.5).cast("int"), "kept": F.col("score") >= 0.5})
