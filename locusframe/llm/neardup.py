"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text's weights are tf * idf over hashes of its shingles of five words. Document frequencies are counted in hashed
features over all rows, a table of fixed size. Equal texts are one text from the signatures on. A bucket of a band is
never expanded into pairs: first each text is compared with one leader and verified links are joined to classes. Then, in buckets that still hold several classes,
every member is compared with all members outside the largest class, in blocks that are products of matrices and give as few links as join the classes.
So all texts of different classes that share a bucket have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, RangeHash, Work, arrow_batches, grouped, join_hot, mix, text_bytes, word_spans
from .components import components

WORDS, THRESHOLD = 5, 0.8
LEAST = THRESHOLD - 1e-9
BUCKET_BITS, RISE = 20, 0.25
BANDS, ROWS = 16, 4
SAMPLES, STEP = BANDS * ROWS, 256
#: Members of a leader that one comparing group holds at most on average.
TOGETHER = 400
#: Shingles of a block, on average, and columns of a matrix at a time.
BLOCK, COLUMNS = 250_000, 1024
CHUNK = 300_000
#: Digests that may be broadcast (some 64 MB).
FEW = 1_000_000
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts (lower-cased already), and how many each text has; a shorter text with words has one, of all its words."""
    starts, ends, row = word_spans(data, offsets, ~SPACES)
    words = np.bincount(row, minlength=len(offsets) - 1)
    hashes = RangeHash(RangeHash(data)(starts, ends))
    counts = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    first = np.cumsum(words) - words
    ends_ = np.cumsum(counts)
    at = np.repeat(first - (ends_ - counts), counts) + np.arange(ends_[-1] if len(ends_) else 0)
    width = np.repeat(np.minimum(words, WORDS), counts)
    return hashes(at, at + width), counts


def _each(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct shingles and their counts of each text."""
    import pyarrow.compute as pc

    data, offsets = text_bytes(pc.utf8_lower(column))
    for part in grouped(np.diff(offsets).tolist(), CHUNK):
        edges = offsets[part.start : part.stop + 1]
        hashes, counts = shingles(data[edges[0] : edges[-1]], edges - edges[0])
        for piece in np.split(hashes, np.cumsum(counts)[:-1]):
            yield np.unique(piece, return_counts=True)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - BUCKET_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """For each hashed feature the number of texts with a shingle in it, counting each distinct shingle of a text once, and at the end the number of texts.

    Each task adds up its own table; tables are summed in pieces, streamed, so that no task holds more than one table. With 2^20
    features a shingle's share of the texts is too high by some 5e-4 on average, whatever their number.
    """
    arrow_batches(docs.sparkSession)
    piece, pieces = 4096, (1 << BUCKET_BITS) // 4096 + 1
    schema = "piece int, sums binary"

    def rows(table: np.ndarray):
        parts = table.reshape(pieces, piece)
        keep = np.flatnonzero(parts.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(keep, pa.int32()), pa.array([parts[i].tobytes() for i in keep], pa.binary())], ["piece", "sums"])

    def count(batches):
        table = np.zeros(piece * pieces, np.int32)
        for batch in batches:
            found = [_bucket(hashes) for hashes, _ in _each(batch.column(0))]
            where, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), 0)
            table[where] += n
            table[1 << BUCKET_BITS] += batch.num_rows
        yield rows(table)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "sums"])

    sums = docs.select(text).mapInArrow(count, schema).repartition(pieces, "piece").mapInArrow(add, schema).toArrow()
    out = np.zeros((pieces, piece), np.int64)
    for i, x in zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True):
        out[i] += np.frombuffer(x, np.int64)
    return out.ravel()[: (1 << BUCKET_BITS) + 1]


def idf_of(frequencies: np.ndarray) -> np.ndarray:
    """Weights from 1, for features in all texts, to 1 + RISE, for features in none.

    Within a large group of near copies what they share is frequent and what sets them apart is rare; with a steeper rise their
    similarity would fall as the group grows.
    """
    n = max(int(frequencies[-1]), 1)
    return (1 + RISE * np.log((1 + n) / (1 + np.minimum(frequencies[:-1], n))) / np.log(1 + n)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling. Gamma and uniform draws of a shingle come from tables, by its hash and the sample's."""

    BITS = 12

    def __init__(self, seed: int = 7):
        draw = np.random.Generator(np.random.PCG64(seed))
        size = (1 << self.BITS, )
        self.r = draw.gamma(2.0, 1.0, size).astype(np.float32)
        self.beta = draw.uniform(0.0, 1.0, size).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, 1.0, size)).astype(np.float32)
        self.salt = draw.integers(1, 1 << 63, (2, SAMPLES), dtype=np.uint64) * _U(2) + _U(1)

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A value for each sample: equal for two texts with the probability of their weighted Jaccard similarity."""
        best = np.full(SAMPLES, np.inf, np.float32)
        out = np.zeros(SAMPLES, _U)
        shift = _U(64 - self.BITS)
        columns = np.arange(SAMPLES)
        for k in range(0, len(hashes), STEP):
            h = hashes[k : k + STEP, None]
            log_w = np.log(weights[k : k + STEP, None]).astype(np.float32)
            i = (h * self.salt[0] >> shift).astype(np.intp)
            r, beta = self.r[i], self.beta[i]
            t = np.floor(log_w / r + beta)
            a = self.log_c[(h * self.salt[1] >> shift).astype(np.intp)] - r * (t + 1 - beta)
            j = a.argmin(axis=0)  # equal ones: the least hash, as hashes are sorted
            low = a[j, columns]
            better = low < best
            best[better] = low[better]
            out[better] = mix(hashes[k + j] ^ mix(t[j, columns].astype(np.int64).astype(_U) + _U(1)))[better]
        return out

    def bands(self, values: np.ndarray) -> np.ndarray:
        edges = np.arange(0, SAMPLES, ROWS)
        return RangeHash(values)(edges, edges + ROWS).view(np.int64)


def signatures(docs: DataFrame, idf, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, node, bands, size): node is the digest of the text, bands has no entries for a text without words, size is its number of shingles."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        sampler = Sampler()
        for batch in batches:
            lists, sizes = [], []
            for hashes, counts in _each(batch.column(0)):
                sizes.append(counts.sum())
                lists.append(sampler.bands(sampler(hashes, counts * idf.value[_bucket(hashes)])) if len(hashes) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            bands = pa.ListArray.from_arrays(offsets, np.concatenate(lists) if lists else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], bands, pa.array(sizes, pa.int64())], [*keep, "node", "bands", "size"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(text, *keep, digest(text).alias("node")).mapInArrow(run, f"{kinds}node binary, bands array<long>, size long")


def digest(text: str) -> Column:
    """Equal for equal texts only; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def verify(pairs: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) have a weighted Jaccard similarity of THRESHOLD or more.

    The rows of one a are dealt to as many groups as its number of pairs asks for, each led by a's text; a group is a stream
    of sorted rows of which only a's text is kept.
    """
    spark = pairs.sparkSession
    arrow_batches(spark)
    groups = pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("groups", F.ceil(F.col("n") / TOGETHER).cast("int"))
    leaders = groups.join(texts, F.col("a") == F.col("node")).select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(None).cast("binary").alias("b"), "text")
    members = join_hot(pairs, groups, ["a"], "n", pairs.count()).join(texts, F.col("b") == F.col("node")).select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), "b", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = leaders.unionByName(members).repartition(parts, "a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def run(batches):
        led = None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = [], []
            for i, (hashes, counts) in enumerate(_each(batch.column(2))):
                weights = counts * idf.value[_bucket(hashes)].astype(float)
                if b[i] is None:
                    led = (hashes, weights)
                    continue
                at = np.minimum(np.searchsorted(led[0], hashes), max(len(led[0]) - 1, 0))
                both = led[0][at] == hashes if len(led[0]) else np.zeros(len(hashes), bool)
                shared = np.minimum(weights[both], led[1][at[both]]).sum()
                if shared >= LEAST * (weights.sum() + led[1].sum() - shared):
                    left.append(a[i])
                    right.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a binary, b binary")


def _blocks(mixed: DataFrame, work: Work) -> DataFrame:
    """mixed (band, bucket, node, root, size) with the groups in which its buckets' classes meet: l, r, and whether the row is on the group's left and right.

    Left are the members outside the bucket's largest class, right all members. Both are dealt to blocks of BLOCK shingles on average, and every left
    block meets every right one: once, then, where the others are few, whatever the largest class. A bucket of one class gives no rows.
    """
    kinds = mixed.groupBy("band", "bucket", "root").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    buckets = kinds.groupBy("band", "bucket").agg(F.sum("n").alias("m"), F.sum("s").alias("all"), F.max(F.struct("s", "n", "root")).alias("x"), F.count("*").alias("kinds")).where("kinds > 1")
    number = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    buckets = buckets.select("band", "bucket", "m", number(F.col("all") - F.col("x.s")).alias("ls"), number(F.col("all")).alias("rs"), F.col("x.root").alias("main"))
    rows = join_hot(mixed, work.put(buckets, "mixed-buckets"), ["band", "bucket"], "m", mixed.count())
    outside = F.col("root") != F.col("main")
    l, r = (F.pmod(F.xxhash64("node", F.lit(i)), F.col(c)).cast("int") for i, c in ((1, "ls"), (2, "rs")))
    place = lambda a, b, left, right: F.struct(a.alias("l"), b.alias("r"), left.alias("left"), right.alias("right"))
    right = F.transform(F.sequence(F.lit(0), F.col("ls") - 1), lambda i: place(i, F.col("_r"), outside & (i == F.col("_l")), F.lit(True)))
    left = F.filter(F.transform(F.sequence(F.lit(0), F.col("rs") - 1), lambda i: place(F.col("_l"), i, outside, F.lit(False))), lambda x: x["left"] & (x["r"] != F.col("_r")))
    rows = rows.withColumns({"_l": l, "_r": r}).withColumn("x", F.explode(F.concat(right, left)))
    return rows.select("band", "bucket", "x.*", "node", "root")


def _group_links(nodes: list, roots: list, left: np.ndarray, right: np.ndarray, hashes: list[np.ndarray], counts: list[np.ndarray], idf: np.ndarray) -> list[tuple]:
    """Links of similar texts on different sides, as few as join all the classes that they join.

    A shingle of count c is c features of its weight, so shared weights are products of matrices of marks; only features of two texts are columns.
    """
    sizes = [int(c.sum()) for c in counts]
    owner = np.repeat(np.arange(len(nodes)), sizes)
    flat, flat_counts = np.concatenate(hashes), np.concatenate(counts)
    weights = idf[_bucket(flat)].astype(float)
    total = np.bincount(np.repeat(np.arange(len(nodes)), [len(h) for h in hashes]), weights * flat_counts, len(nodes))
    copy = np.arange(len(owner)) - np.repeat(np.cumsum(flat_counts) - flat_counts, flat_counts)
    _, column, seen = np.unique(np.repeat(flat, flat_counts) + mix(copy.astype(_U)), return_inverse=True, return_counts=True)
    often = seen[column] > 1
    owner, weights = owner[often], np.repeat(weights, flat_counts)[often]
    _, column = np.unique(column[often], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, weights, column = owner[order], weights[order], column[order]
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    row_a, row_b = np.full(len(nodes), -1), np.full(len(nodes), -1)
    row_a[a], row_b[b] = np.arange(len(a)), np.arange(len(b))
    shared = np.zeros((len(a), len(b)))
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + COLUMNS, COLUMNS))
    for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        at, to = owner[x:y], column[x:y] - k * COLUMNS
        ours, theirs = np.zeros((len(a), COLUMNS)), np.zeros((len(b), COLUMNS))
        ours[row_a[at[left[at]]], to[left[at]]] = weights[x:y][left[at]]
        theirs[row_b[at[right[at]]], to[right[at]]] = 1
        shared += ours @ theirs.T
    near = shared >= LEAST * (total[a][:, None] + total[b][None, :] - shared)
    kind = np.unique(np.array(roots, object), return_inverse=True)[1]
    out = []
    for i, x in enumerate(a):
        others, first = np.unique(np.where(near[i], kind[b], kind[x]), return_index=True)
        new = others != kind[x]
        out += [(nodes[x], nodes[b[j]]) for j in first[new]]
        kind[np.isin(kind, others[new])] = kind[x]
    return out


def block_links(blocks: DataFrame, texts: DataFrame, idf) -> DataFrame:
    """Links (a, b) of similar texts of different classes in each group of blocks; a group is one stream of sorted rows, held as hashes."""
    spark = blocks.sparkSession
    arrow_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    by = ["band", "bucket", "l", "r"]
    rows = blocks.join(texts, "node").repartition(parts, *by).sortWithinPartitions(*by, "node").select(*by, "node", "root", "left", "right", "text")

    def run(batches):
        now, held = None, []

        def finish():
            nodes, roots, left, right, hashes, counts = zip(*held, strict=True)
            links = _group_links(nodes, roots, np.array(left), np.array(right), hashes, counts, idf.value)
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.binary()), pa.array([y for _, y in links], pa.binary())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            fields = [batch.column(i).to_pylist() for i in range(4, 8)]
            for i, (hashes, counts) in enumerate(_each(batch.column(8))):
                if keys[i] != now:
                    if held:
                        yield finish()
                    now, held = keys[i], []
                held.append((*(f[i] for f in fields), hashes, counts))
        if held:
            yield finish()

    return rows.mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, class_size) for every row: class_id is the least key of the rows linked by equal texts, similarities of THRESHOLD or more, or equal keys.

    key is an integer. Null and empty texts are equal texts; so are texts without words only if they are the same text. A text of
    fewer than five words is one shingle. Rows with a null key are compared like others, and each is a row of its class; a class of null keys alone has a
    null class_id. Rows with the same key and different texts are in one class, each compared by its own text. An empty table
    gives no rows, and further columns are not read.
    """
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{key} is not a column of integers")
    spark = docs.sparkSession
    work = Work(spark)
    arrow_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    idf = spark.sparkContext.broadcast(idf_of(document_frequencies(rows)))  # 2^BUCKET_BITS numbers
    signed = work.put(signatures(rows, idf, "text", ("id",)), "signed")
    one = work.put(signed.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("size").alias("size")), "one")
    members = one.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    sizes = work.put(members.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = work.put(join_hot(members, sizes, ["band", "bucket"], "n", one.count() * BANDS), "shared")
    # each text meets the leader of its largest bucket: of those who come there, the one with the most company in all its buckets
    chosen = work.put(shared.groupBy("node").agg(F.sum("n").alias("reach"), F.max(F.struct("n", "band", "bucket")).alias("x")).select("node", "reach", "x.band", "x.bucket"), "chosen")
    nodes = chosen.select("node")
    nodes = F.broadcast(nodes) if chosen.count() <= FEW else nodes  # else texts are shuffled
    texts = work.put(rows.select(digest("text").alias("node"), "text").join(nodes, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts")
    top = chosen.groupBy("band", "bucket").agg(F.max(F.struct("reach", "node")).alias("top"), F.count("*").alias("m"))
    pairs = join_hot(chosen, work.put(top, "top"), ["band", "bucket"], "m", chosen.count()).select(F.col("top.node").alias("a"), F.col("node").alias("b")).where("a <> b")
    found = work.put(verify(work.put(pairs, "pairs"), texts, idf), "found")
    twice = signed.where("id IS NOT NULL").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    same_key = signed.join(twice, "id").select("a", F.col("node").alias("b")).where("a <> b")
    roots = work.put(components(found.unionByName(same_key), work, "first"), "roots-1")
    now = work.put(shared.join(roots, "node", "left").select("band", "bucket", "node", F.coalesce("root", "node").alias("root"), "size"), "now")
    met = block_links(_blocks(now, work), texts, idf).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = work.put(components(met, work, "last"), "roots-2")
    rooted = work.put(one.join(roots, "node", "left").select("node", "least", "copies", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"), F.count("*").alias("n"))
    of = work.put(join_hot(rooted.select("root", "node", "copies"), work.put(named, "named"), ["root"], "n", rooted.count()), "of")
    out = join_hot(signed.select("id", "node"), of.select("node", "class_id", "class_size", "copies"), ["node"], "copies", signed.count())
    out = work.put(out.select(F.col("id").alias(key), "class_id", "class_size"), "classes")
    work.keep("classes")
    return out


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose key is their class's least; of rows with the same key, and of rows with a null key, all stay."""
    gone = classes(docs, key, text).where(F.col(key) != F.col("class_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == F.col("_gone"), "left_anti")
