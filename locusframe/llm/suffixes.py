"""Removal of long repeated byte strings by hashed runs at content-defined anchors, in place of suffix arrays.

Only some suffixes are indexed: each string of MATCH bytes is represented by the suffix at its anchor, the place of the least
hash among its GRAM-byte strings, which depends on the string alone and so is the same in every copy. Neighbouring strings mostly share
an anchor; an entry stands for such a run of strings: key is the hash of the suffix's first GRAM bytes, same the hash of all bytes of the run and
of the anchor's place in it, (doc, copy, start, n) the place of the run. An array is a table of entries that is not
sorted: the order of suffixes has no use here, as only equal strings matter, so hashes stand in for it.

Batches of documents come in the order of doc. Each gets its array, which is grouped with all levels by key and same: entries whose bytes occurred before are matches as a whole, the others become a new level, and levels of one size become one by union. Runs
with equal keys but different bytes, at the edges of copies, are compared string by string at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeHash, Work, arrow_batches, grouped, mix, text_bytes

MATCH, GRAM = 100, 24
REACH = MATCH - GRAM + 1
BATCHES = 3
#: Strings of keys with more different runs than this are dealt one by one, so no key is compared in one task.
HOT = 16
CHUNK = 1 << 19
FIRST = -(1 << 63)
_U = np.uint64
PLACE = "struct<doc: bigint, start: int, n: int, copy: int>"


def runs(data: np.ndarray, offsets: np.ndarray):
    """Entries of the texts: row, start in the text, n (strings of MATCH bytes in the run), key and same."""
    low = len(data) - MATCH + 1
    if low <= 0:
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.int64)] * 2
    hashes = RangeHash(data)
    grams = hashes.windows(GRAM)
    packed = mix(grams) >> _U(32) << _U(32) | np.arange(len(grams), dtype=_U)
    width, least = 1, packed
    while width * 2 <= REACH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < REACH:
        least = np.minimum(least[: low], least[REACH - width : REACH - width + low])
    anchor = (least[:low] & _U(0xFFFFFFFF)).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:low] == row[MATCH - 1 :]
    first = inside.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return [np.zeros(0, np.int64)] * 5
    to = np.concatenate([starts[1:], [low]])
    n = np.add.reduceat(inside, starts, dtype=np.int64)  # strings up to the next run, without those that cross texts
    n = np.minimum(n, to - starts)
    at = anchor[starts]
    same = mix(hashes(starts, starts + n + MATCH - 1) ^ (at - starts).astype(_U) * _U(0xD6E8FEB86659FD93))
    return row[starts], starts - offsets[row[starts]], n, grams[at].view(np.int64), same.view(np.int64)


def array_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, same, place) of all entries of docs (doc, copy, text)."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, edges = text_bytes(batch.column(2))
            docs_, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for part in grouped(np.diff(edges).tolist(), CHUNK):
                offsets = edges[part.start : part.stop + 1]
                for a in range(int(offsets[0]), max(int(offsets[-1]) - MATCH + 1, int(offsets[0]) + 1), CHUNK if part.stop - part.start == 1 else 1 << 62):
                    b = min(a + CHUNK + MATCH - 1, int(offsets[-1])) if part.stop - part.start == 1 else int(offsets[-1])
                    cut = np.clip(offsets, a, b) - a
                    row, start, n, key, same = runs(data[a:b], cut)
                    start = start + (a - int(offsets[0]) if part.stop - part.start == 1 else 0)
                    place = pa.StructArray.from_arrays([pa.array(docs_[part][row]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(copies[part][row])], ["doc", "start", "n", "copy"])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(same), place], ["key", "same", "place"])

    return docs.select("doc", "copy", text).mapInArrow(run, f"key long, same long, place {PLACE}")


class IndexFamily:
    """Levels of arrays; a level of size 2k holds the entries of two of size k. Only the first entry of each same is kept."""

    def __init__(self, work: Work):
        self.work, self.levels, self.batches = work, [], 0

    def add(self, docs: DataFrame) -> DataFrame:
        """Scans a batch against all levels and adds it; the places of its entries whose bytes occurred before."""
        work, k = self.work, self.batches
        self.batches += 1
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels[-2:]
            both = work.put(self._read(a).unionByName(self._read(b)), f"level-{k}-{2 * size}")
            del both
            work.drop(a, b)
            self.levels[-2:] = [(2 * size, f"level-{k}-{2 * size}")]
        new = work.put(array_of(docs), f"array-{k}")
        entries = new.select("key", "same", "place", F.lit(True).alias("new"))
        for _, level in self.levels:
            entries = entries.unionByName(self._read(level).select("key", "same", "place", F.lit(False).alias("new")))
        scan = entries.groupBy("key", "same").agg(F.min("place").alias("first"), F.min("new").alias("fresh"), F.max("new").alias("met"), F.count("*").alias("n")).where("met")
        scan = work.put(scan.select("key", "same", "first", "fresh", (F.col("n") > 1).alias("again")), f"scan-{k}")
        work.put(scan.where("fresh").select("key", "same", F.col("first").alias("place")), f"level-{k}-1")
        self.levels.append((1, f"level-{k}-1"))
        known = scan.where("again").select("key", "same", "first")
        found = new.join(known, ["key", "same"]).where((F.col("place.doc") != F.col("first.doc")) | (F.col("place.start") != F.col("first.start")))
        out = work.put(found.select("place"), f"matches-{k}")
        work.drop(f"array-{k}", f"scan-{k}")
        return out

    def _read(self, name: str) -> DataFrame:
        return self.work.spark.read.parquet(f"{self.work.path}/{name}")

    def entries(self) -> DataFrame:
        out = self._read(self.levels[0][1])
        for _, level in self.levels[1:]:
            out = out.unionByName(self._read(level))
        return out


def _strings(flat: np.ndarray, starts: np.ndarray, n: np.ndarray):
    """The hash of each string of the runs, laid end to end, with its run and its place in the run."""
    which = np.repeat(np.arange(len(n)), n)
    ends = np.cumsum(n)
    t = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
    at = starts[which] + t
    return RangeHash(flat)(at, at + MATCH), which, t


def _edge_texts(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """edges (key, place, many) with the bytes of each run."""
    arrow_batches(edges.sparkSession)
    lists = edges.groupBy(F.col("place.doc").alias("doc"), F.col("place.copy").alias("copy")).agg(F.collect_list(F.struct("key", F.col("place.start").alias("start"), F.col("place.n").alias("n"), "many")).alias("runs"))

    def run(batches):
        for batch in batches:
            data, edges_ = text_bytes(batch.column(2))
            lists = batch.column(3)
            parts = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(batch.num_rows), sizes)
            key, start, n, many = (parts.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            for a in range(0, len(of), 20_000):
                o = of[a : a + 20_000]
                begin = edges_[o] + start[a : a + 20_000]
                lengths = n[a : a + 20_000].astype(np.int64) + MATCH - 1
                ends = np.cumsum(lengths)
                raw = data[np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1])]
                blob = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 20_000]), batch.column(0).take(pa.array(o)), batch.column(1).take(pa.array(o)), pa.array(start[a : a + 20_000]), pa.array(n[a : a + 20_000]), pa.array(many[a : a + 20_000]), blob], ["key", "doc", "copy", "start", "n", "many", "bytes"])

    rows = docs.join(lists, ["doc", "copy"]).select("doc", "copy", "text", "runs")
    return rows.mapInArrow(run, "key long, doc long, copy int, start int, n int, many boolean, bytes binary")


def _spans(docs_: np.ndarray, copies: np.ndarray, begin: np.ndarray, covered: np.ndarray, which: np.ndarray):
    """Covered strings as spans; neighbours of one run are one."""
    at = np.flatnonzero(covered)
    if not len(at):
        return None
    new = np.ones(len(at), bool)
    new[1:] = (which[at[1:]] != which[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
    w = which[first]
    return pa.RecordBatch.from_arrays([pa.array(docs_[w]), pa.array(copies[w]), pa.array(begin[first].astype(np.int32)), pa.array((begin[last] + MATCH).astype(np.int32))], ["doc", "copy", "start", "end"])


def _compare(batches):
    """Rows sorted by key, doc and start: spans of the strings that an earlier row of the key has too."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest, batch])
        keys = table.column(0).to_numpy()
        cut = len(keys) - int((keys[::-1] != keys[-1]).argmax()) if len(keys) and (keys != keys[-1]).any() else 0
        if cut:
            yield from _compared(table.slice(0, cut))
        rest = table.slice(cut).to_batches()
    if rest:
        yield from _compared(pa.Table.from_batches(rest))


def _compared(table: pa.Table):
    table = table.combine_chunks()
    docs_, copies, start, n = (table.column(i).to_numpy() for i in (1, 2, 3, 4))
    flat, offsets = text_bytes_of_binary(table.column(6))
    for part in _key_groups(table.column(0).to_numpy(), n):
        edges = offsets[part.start : part.stop + 1]
        h, which, t = _strings(flat[edges[0] : edges[-1]], edges[:-1] - edges[0], n[part].astype(np.int64))
        begin = start[part][which] + t
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        lead = first[back]
        d = docs_[part][which]
        covered = (d != d[lead]) | (begin != begin[lead])
        if (out := _spans(docs_[part], copies[part], begin, covered, which)) is not None:
            yield out


def _key_groups(keys: np.ndarray, n: np.ndarray):
    """Slices of whole keys with about a million strings each."""
    bounds = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
    sums = np.concatenate([[0], np.cumsum(n.astype(np.int64))])
    start = 0
    for i in range(1, len(bounds)):
        if i == len(bounds) - 1 or sums[bounds[i + 1]] - sums[bounds[start]] > 1_000_000:
            yield slice(int(bounds[start]), int(bounds[i]))
            start = i


def text_bytes_of_binary(column) -> tuple[np.ndarray, np.ndarray]:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_binary())
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _one_by_one(batches):
    for batch in batches:
        docs_, copies, start, n = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
        flat, offsets = text_bytes_of_binary(batch.column(6))
        h, which, t = _strings(flat, offsets[:-1], n.astype(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(h.view(np.int64)), pa.array(docs_[which]), pa.array(copies[which]), pa.array((start[which] + t).astype(np.int32))], ["key", "h", "doc", "copy", "start"])


def _edge_spans(contexts: DataFrame) -> DataFrame:
    parts = max(int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    schema = "doc long, copy int, start int, end int"
    few = contexts.where("NOT many").repartition(parts, "key").sortWithinPartitions("key", "doc", "start", "copy").mapInArrow(_compare, schema)
    strings = contexts.where("many").mapInArrow(_one_by_one, "key long, h long, doc long, copy int, start int")
    first = strings.groupBy("key", "h").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = strings.join(first.select("key", "h", "first"), ["key", "h"]).where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return few.unionByName(later.select("doc", "copy", "start", (F.col("start") + MATCH).alias("end")))


def identified(docs: DataFrame) -> DataFrame:
    """docs (doc, text, ...) with copy, which numbers the rows of one doc, if any doc has more; a null doc comes first, a null text is empty."""
    docs = docs.withColumns({"doc": F.coalesce(F.col("doc").cast("long"), F.lit(FIRST)), "text": F.coalesce("text", F.lit(""))})
    if docs.groupBy("doc").count().where("count > 1").isEmpty():
        return docs.withColumn("copy", F.lit(0))
    return docs.withColumn("copy", F.row_number().over(Window.partitionBy("doc").orderBy("text")))


def repeated(rows: DataFrame, work: Work, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """(doc, copy, start, end): byte spans of rows (doc, copy, text) that hold every string of MATCH bytes that also starts earlier."""
    cuts = sorted(set(rows.approxQuantile("doc", [i / batches for i in range(1, batches)], 0.001))) if batches > 1 else []
    family, matches = IndexFamily(work), []
    bounds = [None, *[int(c) for c in cuts], None]
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        part = rows if low is None else rows.where(F.col("doc") > low)
        matches.append(family.add(part if high is None else part.where(F.col("doc") <= high)))
    entries = family.entries()
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", (F.col("n") > hot).alias("many"))
    edges = work.put(entries.join(shared, "key").select("key", "place", "many"), "edges")
    work.drop(*[name for _, name in family.levels])
    contexts = work.put(_edge_texts(edges, rows), "contexts")
    work.put(_edge_spans(contexts), "spans")
    work.drop("contexts", "edges")
    spans = work.spark.read.parquet(f"{work.path}/spans")
    for m in matches:
        whole = m.select("place.doc", "place.copy", "place.start", (F.col("place.start") + F.col("place.n") + MATCH - 1).cast("int").alias("end"))
        spans = spans.unionByName(whole)
    return spans


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = BATCHES, hot: int = HOT, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """(key, keep, n_bytes, spans, kept) for every row: the maximal removed runs of bytes and the bytes that are left.

    Texts are judged as they are, whole and as UTF-8 bytes: a string of MATCH bytes counts as repeated if it also starts in a row of a
    smaller key, or earlier in a row of the same key. A null key comes before all others; null texts are empty; texts shorter than MATCH bytes lose
    nothing; an empty table gives no rows. Other columns are not read. With as_text kept is a string without characters that lost a byte.
    """
    spark, work = docs.sparkSession, Work(docs.sparkSession)
    names = [key, *keep]
    inner = [f"_c{i}" for i in range(len(names))]
    rows = identified(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), *[F.col(c).alias(i) for c, i in zip(names, inner, strict=True)]))
    spans = repeated(rows.select("doc", "copy", "text"), work, batches, hot)
    lists = work.put(spans.groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "lists")

    def cut(text_: np.ndarray, x) -> tuple[list[dict], bytes]:
        merged, body, at = [], [], 0
        if x.is_valid:
            pairs = np.stack([x.values.field(0).to_numpy(), x.values.field(1).to_numpy()], axis=1)
            pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
            to = np.maximum.accumulate(pairs[:, 1])
            new = np.concatenate([[True], pairs[1:, 0] > to[:-1]])
            for a, b in zip(pairs[new, 0].tolist(), to[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(to) - 1]])].tolist(), strict=True):
                merged.append({"start": a, "end": b})
                body.append(text_[at:a].tobytes())
                at = b
        body.append(text_[at:].tobytes())
        return merged, b"".join(body)

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            out = [cut(data[a:b], x) for a, b, x in zip(offsets[:-1], offsets[1:], batch.column(1), strict=True)]
            kept = pa.array([k.decode(errors="ignore") for _, k in out], pa.string()) if as_text else pa.array([k for _, k in out], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(np.diff(offsets)), pa.array([m for m, _ in out], kind), kept], [*names, "n_bytes", "spans", "kept"])

    arrow_batches(spark)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    joined = rows.join(lists, ["doc", "copy"], "left").select("text", "spans", *inner)
    return joined.mapInArrow(run, f"{kinds}, n_bytes long, spans array<struct<start: int, end: int>>, kept {'string' if as_text else 'binary'}")


def removed_bytes(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + (x["end"] - x["start"]).cast("long"))
