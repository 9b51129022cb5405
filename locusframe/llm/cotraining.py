"""A quality classifier by co-training: a view of the text's content and a view of the page's metadata teach each other.

Each view has a logistic model. In every round each model, calibrated on labelled rows that neither learns from, is asked about all
rows without a label, on the executors, and the other view learns those that it is surest of. In the end a logistic combination of both calibrated views,
fitted on the same rows, scores all documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, RangeHash, Work, arrow_batches, grouped, lowered, text_bytes, word_spans
from .labelled import sample

#: Labelled rows of each class that the models learn from, at most.
PER_CLASS = 2000
#: Rounds, the least probability of a pseudo-label, and pseudo-labels that a view hands over in a round.
ROUNDS, SURE, EACH_ROUND = 5, 0.95, 200
RIDGE = 1.0
SOURCES, LANGUAGES = 64, 16
CHUNK = 300_000
META = ("lang", "source", "n_chars")


def _classes() -> np.ndarray:
    """Marks of byte values by kind, one row each: upper case, digits, sentence marks, other ASCII signs, bars, exclamation marks, newlines, non-ASCII."""
    kinds = [lambda c: "A" <= c <= "Z", str.isdigit, lambda c: c in ".,;:?'\"()-", lambda c: c in "#*$%&<>@^~_=+\\/[]{}`", lambda c: c == "|", lambda c: c == "!", lambda c: c == "\n"]
    return np.array([[i < 128 and k(chr(i)) for i in range(256)] for k in kinds] + [[i >= 128 for i in range(256)]], np.float32)


CLASSES = _classes()
TEXT_FEATURES, META_FEATURES = len(CLASSES) + 8, SOURCES + LANGUAGES + 3


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: shares of kinds of bytes, word lengths, repetition of words, neighbours, triples and lines, and size."""
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    low, _ = lowered(data)
    row = np.repeat(np.arange(n), sizes)
    counts = np.bincount(row * 256 + data, minlength=n * 256).reshape(n, 256)
    shares = counts @ CLASSES.T / np.maximum(sizes, 1)[:, None]
    starts, ends, of = word_spans(low, offsets, ~SPACES)
    words = np.bincount(of, minlength=n)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / some - mean**2, 0))
    hashes = RangeHash(low)(starts, ends)

    def distinct(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, rows))
        v, r = values[order], rows[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[new], minlength=n)

    again = np.bincount(of[1:][(hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])], minlength=n) / some
    kinds = distinct(hashes, of) / np.sqrt(some)
    if len(hashes) > 2:
        inner = of[2:] == of[:-2]
        at = np.flatnonzero(inner)
        triples = distinct(RangeHash(hashes)(at, at + 3), of[:-2][inner]) / np.maximum(np.bincount(of[:-2][inner], minlength=n), 1)
    else:
        triples = np.ones(n)
    triples = np.where(words < 3, 1, triples)
    a, b, lines_of = word_spans(low, offsets, np.arange(256) != 10)
    lines = np.maximum(np.bincount(lines_of, minlength=n), 1)
    line_kinds = distinct(RangeHash(low)(a, b), lines_of) / lines
    out = np.column_stack([shares, mean, spread, again, kinds, triples, line_kinds, np.log1p(words), np.log1p(words / lines)])
    return np.where(words[:, None] > 0, out, 0)


def _texts(column) -> np.ndarray:
    data, offsets = text_bytes(column)
    parts = []
    for part in grouped(np.diff(offsets).tolist(), CHUNK):
        edges = offsets[part.start : part.stop + 1]
        parts.append(text_features(data[edges[0] : edges[-1]], edges - edges[0]))
    return np.concatenate(parts) if parts else np.zeros((0, TEXT_FEATURES))


def meta_features(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Of each row: its hashed language and source, a null being a value, and its stated size."""
    out = np.zeros((len(lang), META_FEATURES))
    rows = np.arange(len(lang))
    out[rows, [zlib.crc32(str(x).encode()) % LANGUAGES for x in lang]] = 1
    out[rows, [LANGUAGES + zlib.crc32(str(x).encode()) % SOURCES for x in source]] = 1
    size = np.log1p(np.array([max(float(x), 0) if x is not None and x == x else 0.0 for x in n_chars]))
    out[:, -3:] = np.column_stack([size, size**2 / 10, size == 0])
    return out


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients with an intercept at the end, by damped Newton steps."""
    rows = np.column_stack([x, np.ones(len(x))])
    pull = np.full(rows.shape[1], ridge)
    pull[-1] = 1e-3
    theta = np.zeros(rows.shape[1])
    for _ in range(30):
        p = _sigmoid(rows @ theta)
        gradient = rows.T @ (weight * (p - y)) + pull * theta
        hessian = (rows * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ rows + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        theta -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return theta


class View:
    """Standardised features with their squares, a logistic model and its calibration."""

    def __init__(self, squares: bool):
        self.squares = squares

    def _prepare(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([x, x**2]) if self.squares else x

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        self.theta = _logistic(self._prepare(x), y, weight, RIDGE)
        self.calibration = np.array([1.0, 0.0])
        self.calibration = _logistic(self.logit(cx)[:, None], cy, np.ones(len(cy)), 0.1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = self._prepare(x) @ self.theta[:-1] + self.theta[-1]
        return np.clip(raw * self.calibration[0] + self.calibration[1], -30, 30)


class Model:
    """Both views and their combination; without rows of both classes every score is 1.

    surest(views, taken, counts) gives for each view the unlabelled rows that it is surest of, by id: (label, both views' features). Ids in
    taken[v] have been handed over by view v before; counts are the most poor and good rows.
    """

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest, rate: float):
        self.views = None
        learns = np.arange(len(y)) % 4 != 3
        if min(np.bincount(y[learns], minlength=2)[:2].tolist() + np.bincount(y[~learns], minlength=2)[:2].tolist()) < 1:
            return
        x, self.views = (text, meta), (View(True), View(False))
        balance = np.where(y == 1, rate / max(y.mean(), 1e-9), (1 - rate) / max(1 - y.mean(), 1e-9))
        counts = (max(round(EACH_ROUND * (1 - rate)), 1), round(EACH_ROUND * rate))
        given: list[dict] = [{}, {}]
        self.shared = []
        for _ in range(ROUNDS):
            self._fit(x, y, balance, learns, given)
            new = surest(self.views, [set(g) for g in given], counts)
            for v in (0, 1):
                given[v] |= new[v]
            self.shared.append((len(new[0]), len(new[1])))
            if not new[0] and not new[1]:
                break
        self._fit(x, y, balance, learns, given)
        c = ~learns
        both = np.column_stack([v.logit(f[c]) for v, f in zip(self.views, x, strict=True)])
        self.combined = _logistic(both, y[c], balance[c], 0.1)

    def _fit(self, x, y, balance, learns, given) -> None:
        for v, view in enumerate(self.views):
            more = [given[1 - v][i] for i in sorted(given[1 - v])]
            rows = np.concatenate([x[v][learns], [f[v] for _, f in more]]) if more else x[v][learns]
            target = np.concatenate([y[learns], [label for label, _ in more]])
            weight = np.concatenate([balance[learns], np.full(len(more), 0.5)])
            view.fit(rows, target, weight, x[v][~learns], y[~learns])

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.views is None:
            return np.ones(len(text))
        both = np.column_stack([self.views[0].logit(text), self.views[1].logit(meta)])
        return _sigmoid(both @ self.combined[:-1] + self.combined[-1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text") -> Model:
    """A model from at most per_class labelled rows of each class that are not held out, and all rows without a label.

    The classes keep the weights they have among all labels. Nulls in lang, source and n_chars are values, null texts empty. Rows with a null
    key have no label. Unlabelled rows whose features are equal, copies above all, count as one.
    """
    out = _featured(sample(docs, labels, "quality", per_class, [text, *META], key), text, (key, "label")).toPandas()
    out = out.iloc[sorted(range(len(out)), key=lambda i: (out[key].iloc[i], list(out["_text"].iloc[i])))]
    views = [np.array(out[c].tolist(), float).reshape(len(out), n) for c, n in (("_text", TEXT_FEATURES), ("_meta", META_FEATURES))]
    rate = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0] or 0.5
    work = Work(docs.sparkSession)
    model = Model(*views, out["label"].to_numpy(dtype=int), Pool(docs, labels, work, key, text).surest, float(rate))
    work.keep()
    return model


class Pool:
    """The features of all rows without a label: a table that is written when it is first asked."""

    def __init__(self, docs: DataFrame, labels: DataFrame, work: Work, key: str = "doc_id", text: str = "text"):
        self.docs, self.labels, self.work, self.key, self.text, self.rows = docs, labels, work, key, text, None

    def table(self) -> DataFrame:
        if self.rows is None:
            known = self.labels.select(F.col(self.key).alias("_known")).distinct()
            free = _featured(self.docs, self.text, (self.key,)).join(known, F.col(self.key) == F.col("_known"), "left_anti")
            once = free.groupBy(F.xxhash64("_text", "_meta").alias("_id")).agg(F.min(F.struct("_text", "_meta")).alias("_f"))
            self.rows = self.work.put(once.select("_id", "_f.*"), "pool")
        return self.rows

    def surest(self, views, taken: list[set], counts: tuple[int, int]) -> list[dict]:
        """Every row is asked; each task sends its surest rows of both views and labels, the surest of those come to the driver."""
        most = max(counts)

        def run(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = [batch.column(i).flatten().to_numpy().reshape(len(ids), -1) for i in (1, 2)]
                for v in (0, 1):
                    p = _sigmoid(views[v].logit(x[v].astype(float)))
                    p[np.isin(ids, list(taken[v]))] = 0.5
                    for label, sure in enumerate((1 - p, p)):
                        at = np.flatnonzero(sure >= SURE)
                        at = at[np.lexsort((ids[at], -sure[at]))][:most]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)), pa.array(np.full(len(at), label, np.int32)), pa.array(sure[at]), *batch.take(pa.array(at)).columns], ["_view", "_label", "_sure", "_id", "_text", "_meta"])

        rows = self.table().select("_id", "_text", "_meta")
        found = rows.mapInArrow(run, "_view int, _label int, _sure double, _id long, _text array<float>, _meta array<float>")
        rank = F.row_number().over(Window.partitionBy("_view", "_label").orderBy(F.desc("_sure"), "_id"))
        best = found.withColumn("_rank", rank).where(F.col("_rank") <= F.when(F.col("_label") == 1, counts[1]).otherwise(counts[0]))
        new: list[dict] = [{}, {}]
        for r in best.where(F.col("_rank") <= most).collect():  # at most 2 * EACH_ROUND rows
            new[r["_view"]][r["_id"]] = (r["_label"], (np.array(r["_text"]), np.array(r["_meta"])))
        return new


def _featured(rows: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """keep with both views' features, _text and _meta, made on the executors."""
    arrow_batches(rows.sparkSession)

    def run(batches):
        for batch in batches:
            views = _texts(batch.column(0)), meta_features(*[batch.column(i).to_pylist() for i in (1, 2, 3)])
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], *[pa.array(list(v.astype(np.float32)), pa.list_(pa.float32())) for v in views]], [*keep, "_text", "_meta"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(text, *META, *keep).mapInArrow(run, f"{kinds}, _text array<float>, _meta array<float>")


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """docs' columns (or keep) and name: the probability of good quality of each row, from its whole text and metadata.

    Null and empty texts have no features but their metadata. Repeated rows are scored alike; an empty table gives no rows; other columns pass
    unread, whatever their names but name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_batches(docs.sparkSession)
    keep = tuple(docs.columns) if keep is None else keep
    names = [f"_in{i}" for i in range(len(META) + 1)]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip((text, *META), names, strict=True)], *keep)

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(_texts(batch.column(0)), meta_features(*[batch.column(i).to_pylist() for i in (1, 2, 3)]))
            yield pa.RecordBatch.from_arrays([*batch.columns[4:], pa.array(scores, pa.float64())], [*keep, name])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, `{name}` double")
