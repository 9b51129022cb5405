"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of the templates are
hash-joined, and the values in the slots must agree along a run of windows. So questions with other numbers or names are found too. Windows of the
words as they stand are joined alike, so verbatim copies are found whatever their words are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, Work, arrow_batches, grouped, lowered, mix, text_bytes, word_spans

WINDOW = 8
#: Of a template window's words so many at least are no placeholders; items of fewer words match nothing.
PLAIN = 4
#: Runs count from so many matched words on, or from this share of the item's words if that is less.
RUN, SHARE = 13, 0.6
#: Words put in or left out between two runs of one passage, at most.
EDIT = 4
#: Bits of window hashes in the table that keeps documents' other windows from the join: at least, and at most (128 MB).
FILTER_BITS, MOST_BITS = 22, 30
#: Parts that the document windows of one hash are dealt to.
SALTS = 16
#: Unit words, placeholders only after a number.
UNITS = "mm cm m km g kg mg t l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents eur usd mile miles inch inches foot feet pound pounds ounce ounces hz khz mhz w kw v kb mb gb"
CHUNK = 4_000_000

_WORD = np.array([chr(i).isalnum() and i < 128 or i >= 128 for i in range(256)])
_DIGIT = np.array([48 <= i <= 57 for i in range(256)])
_U = np.uint64
NUMBER, NAME, UNIT, AS_IT_STANDS = (mix(np.array([k], _U)) for k in (101, 102, 103, 104))


def _hash_words(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words, pa.string()))
    return RangeHash(data)(offsets[:-1], offsets[1:])


def templates(data: np.ndarray, offsets: np.ndarray):
    """Of texts' words (runs of letters and digits): starts, ends, row, hash of the lower-case word, template value and kind (0 plain, 1 number, 2 name, 3 unit).

    A number is all digits; a unit is a unit word right after a number; a name starts with a capital and goes on in lower case, wherever it stands.
    """
    low, capital = lowered(data)
    starts, ends, row = word_spans(data, offsets, _WORD)
    words = RangeHash(low)(starts, ends)
    values, kind = words, np.zeros(len(starts), np.int8)
    if len(starts):
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        capitals = np.concatenate([[0], np.cumsum(capital)])
        number = digits[ends] - digits[starts] == ends - starts
        follows = np.concatenate([[False], row[1:] == row[:-1]])
        name = capital[starts] & (capitals[ends] - capitals[starts] == 1)
        unit = follows & np.concatenate([[False], number[:-1]]) & np.isin(words, _hash_words(UNITS.split()))
        kind[name], kind[unit], kind[number] = 2, 3, 1
        values = np.where(kind == 0, words, np.choose(kind, [NUMBER, NUMBER, NAME, UNIT]))
    return starts, ends, row, words, values, kind


def _windows(data: np.ndarray, offsets: np.ndarray, widths: list[int], wanted: tuple[np.ndarray, int] | None, whole: bool):
    """Rows (row, position, width, words of the text, hash, slots) of the windows, with null slots where the words count as they stand; whole: a short text is one window of its width.

    wanted: the filter's marks by hash; windows without a mark are left out.
    """
    starts, ends, row, plain_words, values, kind = templates(data, offsets)
    words = np.bincount(row, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(words)[:-1]])
    plain = np.concatenate([[0], np.cumsum(kind == 0)])
    for typed, hashes in ((True, RangeHash(values)), (False, RangeHash(plain_words ^ AS_IT_STANDS))):
        for width in widths:
            if len(starts) < width:
                continue
            at = np.arange(len(starts) - width + 1)
            good = row[: len(at)] == row[width - 1 :]
            if typed:
                held = plain[width:] - plain[: len(at)]
                good &= (held >= min(PLAIN, width)) & (held < width)  # without placeholders the words as they stand say the same
            if whole:
                good &= words[row[: len(at)]] == width if width < WINDOW else words[row[: len(at)]] >= WINDOW
            at = at[good]
            h = hashes(at, at + width)
            if wanted is not None:
                code = h >> _U(64 - wanted[1])
                hit = wanted[0][(code >> _U(3)).astype(np.int64)] >> (code & _U(7)).astype(np.uint8) & 1 == 1
                at, h = at[hit], h[hit]
            for i, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                slots = [data[starts[j] : ends[j]].tobytes().decode(errors="replace").lower() for j in range(i, i + width) if kind[j]] if typed else None
                r = int(row[i])
                yield r, i - int(first[r]), width, int(words[r]), x, slots


def runs(windows: list[tuple]) -> list[tuple]:
    """(shift, start and end in the item, slots) of the maximal runs of windows (at in the document, at in the item, width, our slots, their slots).

    A run is a chain of windows of one shift, each starting in or right after those before, in which each slot value of the item has one
    value in the document; slots is that map. Windows without slots hold the words as they stand.
    """
    out = []
    by_shift: dict[int, list] = {}
    for d, i, width, ours, theirs in windows:
        slots = list(zip(ours or (), theirs or (), strict=True))
        if all(dict(slots)[a] == b for a, b in slots):  # a window may contradict itself
            by_shift.setdefault(d - i, []).append((i, i + width, slots))
    for shift, rows in by_shift.items():
        rows.sort(key=lambda x: x[:2])
        begin, end, map_of, uses = 0, -1, {}, {}

        def leave(k: int, rows=rows) -> None:
            for a, _ in rows[k][2]:
                uses[a] -= 1
                if not uses[a]:
                    del uses[a], map_of[a]

        def note(k: int, shift=shift, rows=rows) -> None:
            if begin < k:
                out.append((shift, rows[begin][0], max(r[1] for r in rows[begin:k]), dict(map_of)))

        for k, (start, stop, slots) in enumerate(rows):
            apart, clash = start > end, any(map_of.get(a, b) != b for a, b in slots)
            if apart or clash:
                note(k)
                while begin < k and (apart or any(map_of.get(a, b) != b for a, b in slots)):
                    leave(begin)
                    begin += 1
            for a, b in slots:
                map_of[a], uses[a] = b, uses.get(a, 0) + 1
            end = max(end, stop) if begin < k else stop
        note(len(rows))
    return out


def matched(windows: list[tuple], words: int) -> tuple[int, bool]:
    """The most words that a passage of the document shares with the item, and whether some slot of it was changed.

    A passage is a run, or several in the item's order whose shifts differ by EDIT words or less from one to the next and whose slots agree.
    """
    best = (0, False)
    found = sorted(set((s, a, b, tuple(sorted(m.items()))) for s, a, b, m in runs(windows)), key=lambda r: (r[1], r[2], r[0]))
    chains: dict[int, list] = {}
    for shift, a, b, slots in found:
        mine, top = dict(slots), (b - a, b, dict(slots))
        for total, to, theirs in (c for s in range(shift - EDIT, shift + EDIT + 1) for c in chains.get(s, ())):
            if b > to and a >= to - WINDOW and total + b - max(a, to) > top[0] and all(theirs.get(k, v) == v for k, v in mine.items()):
                top = (total + b - max(a, to), b, theirs | mine)
        chains.setdefault(shift, []).append(top)
        best = max(best, (top[0], all(k == v for k, v in top[2].items())))
    return best[0], bool(best[0]) and not best[1]


_SCHEMA = "at long, width int, words int, hash long, slots array<string>"


def _window_rows(df: DataFrame, key: str, text: str, widths: list[int], wanted, whole: bool) -> DataFrame:
    arrow_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        marks = wanted.value if wanted is not None else None
        for batch in batches:
            all_bytes, edges = text_bytes(batch.column(1))
            for part in grouped(np.diff(edges).tolist(), CHUNK):
                offsets = edges[part.start : part.stop + 1]
                rows = list(_windows(all_bytes[offsets[0] : offsets[-1]], offsets - offsets[0], widths, marks, whole))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    keys = batch.column(0)[part].take(pa.array(columns[0]))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(columns[1], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[2:4]), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.list_(pa.string()))], [key, "at", "width", "words", "hash", "slots"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, {_SCHEMA}")


def _filter(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """One bit for each hash's leading bits, in a table of some eight bits a hash within its limits."""
    bits = min(max(int(8 * len(hashes)).bit_length(), FILTER_BITS), MOST_BITS)
    marks = np.zeros(1 << (bits - 3), np.uint8)
    code = hashes.view(_U) >> _U(64 - bits)
    np.bitwise_or.at(marks, (code >> _U(3)).astype(np.int64), np.left_shift(1, (code & _U(7)).astype(np.uint8)).astype(np.uint8))
    return marks, bits


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(key, item, matched_words, item_words, reparameterised) of every document row and benchmark item that share a passage that counts.

    A passage counts from RUN words on, or from SHARE of the item's words if that is less; a slot value of the item with two values in the document ends
    a run of windows, and runs that an edit parts are added up. Null and empty texts match nothing, nor do items with fewer than PLAIN words or tables without
    rows. Rows of null or repeated keys are compared each on their own; equal rows give one row. Long items need windows of WINDOW words, short ones all
    their words. Further columns are not read. Only windows that pass a filter built from the benchmark are joined.
    """
    spark = docs.sparkSession
    work = Work(spark)
    items = work.put(_window_rows(benchmark.select(item, text), item, text, list(range(PLAIN, WINDOW + 1)), None, True), "items")
    codes = items.select("hash", "width").distinct().toArrow()  # of the benchmark, not of the documents
    widths = sorted(set(codes.column(1).to_pylist()))
    wanted = spark.sparkContext.broadcast(_filter(codes.column(0).to_numpy().astype(np.int64)))
    rows = docs.select(F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text")).select(F.struct("_key", "_row").alias("_doc"), "_text")
    found = _window_rows(rows, "_doc", "_text", widths, wanted, False)
    d = found.select("_doc", F.col("at").alias("_at"), "hash", "width", F.col("slots").alias("_theirs"), F.pmod(F.xxhash64("_doc"), F.lit(SALTS)).alias("_salt"))
    i = items.select(F.col(item).alias("_item"), "at", "hash", "width", "words", F.col("slots").alias("_ours"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    same_kind = F.col("_ours").isNull() == F.col("_theirs").isNull()
    joined = d.join(i, ["hash", "width", "_salt"]).where(same_kind)
    windows = joined.groupBy("_doc", "_item", "words").agg(F.collect_set(F.struct("_at", "at", "width", "_ours", "_theirs")).alias("w"))
    kinds = f"_doc struct<_key: {docs.schema[key].dataType.simpleString()}, _row: bigint>, _item {benchmark.schema[item].dataType.simpleString()}"

    def run(batches):
        for batch in batches:
            out = [matched([tuple(x.values()) for x in w], n) for w, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m for m, _ in out], pa.int64()), batch.column(3), pa.array([c for _, c in out], pa.bool_())], ["_doc", "_item", "matched_words", "item_words", "reparameterised"])

    scored = windows.select("_doc", "_item", "w", F.col("words").cast("long")).mapInArrow(run, f"{kinds}, matched_words long, item_words long, reparameterised boolean")
    enough = F.least(F.lit(float(RUN)), F.col("item_words") * F.lit(SHARE))
    return scored.where(F.col("matched_words") >= enough).select(F.col("_doc._key").alias(key), F.col("_item").alias(item), "matched_words", "item_words", "reparameterised")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each contaminated key: its items, the most matched words and whether all its matches are re-parameterised."""
    m = matches(docs, benchmark, key, item, text)
    return m.groupBy(key).agg(F.sort_array(F.collect_set(item)).alias("items"), F.max("matched_words").alias("matched_words"), F.min("reparameterised").alias("reparameterised"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, that match no benchmark item; rows with a null key are kept only if clean themselves."""
    found = contaminated(docs, benchmark, key).select(F.col(key).alias("_found"))
    return docs.join(found, docs[key].eqNullSafe(F.col("_found")), "left_anti")
