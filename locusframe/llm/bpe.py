"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces of a text (matches of a pattern) that are new to a worker are sorted into buckets by length. A bucket is one matrix with a
row for each piece; in each round every row merges its leftmost pair of least rank, found in an open-addressing hash table of
pairs, and closes the gap; finished rows leave the matrix. Pieces of more than LONGEST bytes, where a round for each merge would
take quadratic time, merge by a heap instead, in the same order.
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, mix

WIDTHS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
LONGEST = WIDTHS[-1]
WIDTH_OF = [next(w for w in WIDTHS if w >= n) for n in range(LONGEST + 1)]
NONE, EMPTY = np.int32((1 << 31) - 1), np.uint64((1 << 64) - 1)
#: Pieces that a worker remembers, and characters or pieces that it takes at a time.
REMEMBERED, AT_A_TIME = 250_000, 50_000


class PairTable:
    """Ranks of pairs of ids by hash, with linear probing."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.mask, self.reach = size - 1, 0
        self.keys, self.ranks = np.full(size, EMPTY), np.full(size, NONE)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == EMPTY
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.ranks[slots] = keys[todo[won]], rank[todo[won]]
            left_over = np.ones(len(todo), bool)
            left_over[won] = False
            todo, at = todo[left_over], at[left_over] + 1 & self.mask
            self.reach += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it has none; ids below 0 are padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        out = np.full(keys.shape, NONE)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, keys = out.ravel(), keys.ravel()
        at = self._home(keys[todo])
        for _ in range(self.reach):
            if not len(todo):
                break
            there = self.keys[at]
            hit = there == keys[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            going = ~hit & (there != EMPTY)
            todo, at = todo[going], at[going] + 1 & self.mask
        return flat.reshape(out.shape)


class Vocabulary:
    """Ranks of byte strings, as lines of base64 and rank; ids are ranks. Every single byte must have one."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(self.ranks[a], self.ranks[b], rank) for token, rank in self.ranks.items() for i in range(1, len(token)) if (a := token[:i]) in self.ranks and (b := token[i:]) in self.ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece; a piece that is a token is that token."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[i] = [rank]
            elif len(piece) > LONGEST:
                out[i] = self._by_heap(piece)
            elif piece:
                buckets.setdefault(WIDTH_OF[len(piece)], []).append(i)
        for width, rows in buckets.items():
            step = max(1, AT_A_TIME // width)
            for k in range(0, len(rows), step):
                part = rows[k : k + step]
                for i, ids in zip(part, self._by_matrix([pieces[j] for j in part], width), strict=True):
                    out[i] = ids
        return out

    def _by_matrix(self, pieces: list[bytes], width: int) -> list[list[int]]:
        sizes = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        column = np.arange(width)
        ids = np.where(column < sizes[:, None], self.single[raw], np.int32(-1))
        ranks = self.pairs(ids[:, :-1], ids[:, 1:])
        row_of, out = np.arange(len(pieces)), [[]] * len(pieces)
        while len(row_of):
            at = ranks.argmin(axis=1)  # the leftmost of equal ranks
            best = ranks[np.arange(len(at)), at]
            done = best == NONE
            for r, line, n in zip(row_of[done].tolist(), ids[done].tolist(), sizes[done].tolist(), strict=True):
                out[r] = line[:n]
            more = ~done
            row_of, ids, sizes, at, best, ranks = row_of[more], ids[more], sizes[more] - 1, at[more], best[more], ranks[more]
            if not len(row_of):
                break
            rows = np.arange(len(at))
            ids[rows, at] = best
            gap = column[None, : ids.shape[1] - 1] > at[:, None]
            ids = np.concatenate([np.where(gap, ids[:, 1:], ids[:, :-1]), np.full((len(at), 1), -1, np.int32)], axis=1)
            gap = gap[:, : ranks.shape[1]]
            shifted = np.concatenate([ranks[:, 1:], np.full((len(at), 1), NONE)], axis=1)
            ranks = np.where(gap, shifted, ranks)
            right = np.where(at + 1 < ids.shape[1], ids[rows, np.minimum(at + 1, ids.shape[1] - 1)], np.int32(-1))
            here = at < ranks.shape[1]
            ranks[rows[here], at[here]] = self.pairs(best[here], right[here])
            back = at > 0
            ranks[rows[back], at[back] - 1] = self.pairs(ids[rows[back], at[back] - 1], best[back])
        return out

    def _by_heap(self, piece: bytes) -> list[int]:
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(r), i) for i, r in enumerate(self.pairs(np.array(ids[:-1]), np.array(ids[1:]))) if r != NONE]
        heapq.heapify(heap)
        ranks, tokens = self.ranks, self.bytes_of
        rank_at = dict((i, r) for r, i in heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if rank_at.get(i) != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            rank_at.pop(j, None)
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k < 0:
                    continue
                new = ranks.get(tokens[ids[k]] + tokens[ids[after[k]]]) if after[k] < n else None
                if new is None:
                    rank_at.pop(k, None)
                else:
                    rank_at[k] = new
                    heapq.heappush(heap, (new, k))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after another."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.all_bytes[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]


class _Worker:
    """Known pieces by number; the ids of piece k are flat[starts[k] : starts[k] + counts[k]]."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.pattern, self.vocabulary = regex.compile(pattern), vocabulary
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = list(pieces)
        if not new:
            return
        ids = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, counts.sum())])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; long texts are taken in runs of pieces."""
        out, waiting, size = [], [], 0
        for text in texts:
            if len(text) > 5 * AT_A_TIME:
                out += self._together(waiting)
                waiting, size, runs = [], 0, []
                pieces = (m.group() for m in self.pattern.finditer(text))
                while run := list(islice(pieces, AT_A_TIME)):
                    runs += self._together([run])
                out.append(np.concatenate(runs) if runs else np.zeros(0, np.int32))
                continue
            waiting.append(self.pattern.findall(text))
            size += len(waiting[-1])
            if size > AT_A_TIME:
                out += self._together(waiting)
                waiting, size = [], 0
        return out + self._together(waiting)

    def _together(self, texts: list[list[str]]) -> list[np.ndarray]:
        self._learn(set(chain.from_iterable(texts)))
        lengths = [len(t) for t in texts]
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64, sum(lengths))
        counts = self.counts[which]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[which] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.concatenate([[0], ends])[np.cumsum(lengths)[:-1]]) if texts else []


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(path: str, lines) -> Vocabulary:
    """One vocabulary for each file and Python worker."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(lines.value)
    return _vocabularies[path]


def _shared(docs: DataFrame, path: str):
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size does not depend on the input


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", back: bool = False) -> DataFrame:
    """(key, ids): the ids of each whole text by the ranks in the file at path, each match of pattern on its own, no special tokens.

    Null and empty texts have no ids; a null key stays null; repeated rows are encoded alike; an empty table gives no rows;
    further columns are not read. Pieces are remembered by each worker up to REMEMBERED, then forgotten. With back the same
    workers also decode the ids, as decode() does, and decoded is one more column.
    """
    lines = _shared(docs, path)
    arrow_batches(docs.sparkSession)

    def run(batches):
        vocabulary = _vocabulary(path, lines)
        worker = _Worker(vocabulary, pattern)
        for batch in batches:
            ids = worker.ids([x or "" for x in batch.column(1).to_pylist()])
            columns = [batch.column(0), _lists(ids)]
            if back:
                columns.append(pa.array([vocabulary.decode(x).tobytes() for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>" + ", decoded binary" * back)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.zeros(0, np.int32))


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded): the bytes that the ids stand for."""
    lines = _shared(encoded, path)

    def run(batches):
        vocabulary = _vocabulary(path, lines)
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy(zero_copy_only=False)
            out = [vocabulary.decode(ids[a:b]).tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], [key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded binary")
