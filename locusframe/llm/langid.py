"""Language identification by interpolated Kneser-Ney character models, one for each language, in sorted hash arrays.

Training counts all 4-grams of the training texts as Spark aggregates; the distinct ones are the models. At most about PER_LANGUAGE texts of
a language are learned from, chosen by a hash: the bound of the models' size. Every tenth training text is held back from the
models: how sharply cross-entropies tell languages apart, and from which cross-entropy on a text is rejected, are fitted on those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, mix

ORDER = 4
#: Texts of each language that the models learn from: all up to this number, beyond it a share by hash that gives about as many.
PER_LANGUAGE = 1_000_000
#: One training text in so many is held back for calibration.
HELD_BACK = 10
#: A language's texts whose cross-entropy lies above this quantile of its held-back texts' are marked rejected.
REJECT_ABOVE = 0.999
#: Factors of cross-entropies that calibration chooses from.
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0, 64.0)
SPACE = 32
_U = np.uint64


_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams of lower-cased texts, packed 16 bits a character; the number of 4-grams of each text and whether it has a letter.

    Whatever isn't a letter is a space, runs of spaces are one, and each text stands between spaces. Characters beyond 16 bits
    are folded into them.
    """
    joined = ("   " + "\n   ".join(x.replace("\n", " ").lower() for x in texts) + "\n").encode("utf-32-le", "surrogatepass") if texts else b""
    points = np.frombuffer(joined, np.uint32)
    ends = points == 10
    letter = letters()[points]
    row = np.cumsum(ends) - ends
    has = np.bincount(row[letter], minlength=len(texts)) > 0
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the one space after a word
    starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1]) if len(texts) else np.zeros(0, np.int64)
    for i in range(ORDER - 1):
        kept[starts + i] = True
    kept &= ~ends | np.concatenate([[False], letter[:-1]]) if len(points) else kept
    row = row[kept]
    points = np.where(letter, points, SPACE)[kept].astype(_U) & _U(0xFFFF)
    if len(points) < ORDER:
        return np.zeros(0, _U), np.zeros(len(texts), np.int64), has
    packed = points[:-3] << _U(48) | points[1:-2] << _U(32) | points[2:-1] << _U(16) | points[3:]
    same = row[:-3] == row[3:]
    return packed[same], np.bincount(row[:-3][same], minlength=len(texts)), has


def count_grams(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, gram, n) over all texts whose language is known; summed in each task first."""
    arrow_batches(docs.sparkSession)

    def run(batches):
        sums: dict[str, tuple] = {}
        for batch in batches:
            groups: dict[str, list] = {}
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                groups.setdefault(l, []).append(t or "")
            for l, texts in groups.items():
                new = np.unique(grams(texts)[0], return_counts=True)
                if l in sums:
                    old = sums[l]
                    keys, back = np.unique(np.concatenate([old[0], new[0]]), return_inverse=True)
                    new = (keys, np.bincount(back, np.concatenate([old[1], new[1]])).astype(np.int64))
                sums[l] = new
                if len(new[0]) > 500_000:
                    yield _counts(l, *sums.pop(l))
        for l, x in sums.items():
            yield _counts(l, *x)

    known = docs.where(F.col(lang).isNotNull()).select(lang, text)
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _counts(l: str, keys: np.ndarray, n: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array([l] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


class _Level:
    """One order of a model: sorted grams with log-probabilities, sorted contexts with back-off weights."""

    def __init__(self, width: int, keys: np.ndarray, counts: np.ndarray, lower: "_Level | None", vocabulary: int):
        self.mask = _U((1 << 16 * width) - 1)
        order = np.argsort(keys)
        self.keys, counts = keys[order], counts[order].astype(float)
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        contexts, where = np.unique(self.keys >> _U(16), return_inverse=True)
        total = np.bincount(where, counts)
        kinds = np.bincount(where)
        self.contexts, self.back_off = contexts, discount * kinds / total
        self.lower, self.floor = lower, 1.0 / vocabulary
        rest = self._lower(self.keys)
        self.probabilities = (counts - discount) / total[where] + self.back_off[where] * rest

    def _lower(self, grams: np.ndarray) -> np.ndarray:
        return self.lower(grams) if self.lower else np.full(len(grams), self.floor)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        grams = grams & self.mask
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hit = self.keys[at] == grams
        out = self.probabilities[at].copy()
        if not hit.all():
            miss = grams[~hit]
            context = miss >> _U(16)
            c = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            weight = np.where(self.contexts[c] == context, self.back_off[c], 1.0)
            out[~hit] = weight * self._lower(miss)
        return out


class Model:
    """Interpolated Kneser-Ney: raw counts for the highest order, numbers of different left neighbours below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        tables = {ORDER: (keys.astype(_U), counts)}
        for width in range(ORDER - 1, 0, -1):
            longer = tables[width + 1][0]
            tables[width] = np.unique(longer & _U((1 << 16 * width) - 1), return_counts=True)
        vocabulary = len(tables[1][0]) + 1
        level = None
        for width in range(1, ORDER + 1):
            level = _Level(width, *tables[width], level, vocabulary)
        self.top = level

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        return np.log(self.top(grams))


class Scorer:
    """Cross-entropies of texts under all models; a direct-mapped table keeps the values of recent 4-grams."""

    BITS = 17

    def __init__(self, models: list[Model]):
        self.models = models
        self.keys = np.zeros(1 << self.BITS, _U)
        self.values = np.zeros((1 << self.BITS, len(models)), np.float32)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        packed, sizes, has = grams(texts)
        at = (mix(packed) >> _U(64 - self.BITS)).astype(np.int64)
        values = np.empty((len(packed), len(self.models)), np.float32)
        hit = self.keys[at] == packed
        values[hit] = self.values[at[hit]]
        if not hit.all():
            new, back = np.unique(packed[~hit], return_inverse=True)
            fresh = np.stack([m.log_probability(new) for m in self.models], axis=1).astype(np.float32)
            values[~hit] = fresh[back]
            place = (mix(new) >> _U(64 - self.BITS)).astype(np.int64)
            _, one = np.unique(place, return_index=True)  # of several grams at one place one stays
            self.keys[place[one]], self.values[place[one]] = new[one], fresh[one]
        edges = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.zeros((len(texts), len(self.models)))
        full = sizes > 0
        if full.any():
            sums[full] = np.add.reduceat(values, edges[:-1][full], axis=0, dtype=np.float64)
        return -sums / np.maximum(sizes, 1)[:, None], has


def fit(training: DataFrame, lang: str = "lang", text: str = "text", per_language: int = PER_LANGUAGE) -> dict[str, Model]:
    """A model for each language from about per_language of its rows, or all if there are no more; rows without a language or a 4-gram teach nothing."""
    known = training.where(F.col(lang).isNotNull())
    sizes = known.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n"))  # one row a language
    draw = F.pmod(F.xxhash64(text, F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    rows = known.join(F.broadcast(sizes), F.col(lang) == F.col("_lang")).where(draw * F.col("_n") < per_language)
    found = count_grams(rows, lang, text).toArrow()
    langs, keys, n = (found.column(i).to_numpy() for i in range(3))
    return {l: Model(keys[langs == l].view(np.uint64), n[langs == l]) for l in sorted(set(langs))}


def held_back(text: str = "text") -> Column:
    """Whether a training text is kept for calibration, by a hash of the text, so copies are on one side."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit(5)), F.lit(HELD_BACK)) == 0


def identify(docs: DataFrame, models: dict[str, Model], key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, lang_pred, score, entropy, rest): the language of the lowest mean cross-entropy of each whole text.

    Equal ones go to the first name. rest are the other languages' cross-entropies above the lowest; score is the language's share of the likelihoods at sharpness 1. Null texts and texts without a
    letter, and all texts if there is no model, are 'und' with score 0 and no entropy. Repeated rows and null keys are
    treated alike; further columns are not read.
    """
    names = list(models)
    shared = docs.sparkSession.sparkContext.broadcast(list(models.values()))
    arrow_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(shared.value) if names else None
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            pred, score, best, rest = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), [None] * len(texts)
            if scorer and texts:
                parts = []
                step = 0
                while step < len(texts):  # long texts come in smaller groups
                    to, size = step, 0
                    while to < len(texts) and (to == step or size + len(texts[to]) < 1_000_000):
                        size += len(texts[to])
                        to += 1
                    parts.append(scorer(texts[step:to]))
                    step = to
                h, has = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                first = h.argmin(axis=1)
                low = h[np.arange(len(h)), first]
                share = 1 / np.exp(low[:, None] - h).sum(axis=1)
                for i in np.flatnonzero(has).tolist():
                    pred[i], rest[i] = names[first[i]], np.delete(h[i] - low[i], first[i])
                score, best = np.where(has, share, 0.0), np.where(has, low, np.nan)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred), pa.array(score), pa.array(best, from_pandas=True), pa.array(rest, pa.list_(pa.float64()))], [key, *keep, "lang_pred", "score", "entropy", "rest"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(text, key, *keep).mapInArrow(run, f"{kinds}, lang_pred string, score double, entropy double, rest array<double>")


def _share(sharpness: float) -> Column:
    return 1 / F.aggregate("rest", F.lit(1.0), lambda s, x: s + F.exp(-sharpness * x))


def calibrated(found: DataFrame, fold: Column, lang: str = "lang", above: float = REJECT_ABOVE) -> DataFrame:
    """found with score at the sharpness that makes the languages of the rows in fold likeliest, and rejected; without entropy and rest.

    rejected: a text without a letter, or its cross-entropy is above this quantile of the fold's texts of the same predicted language. Without rows
    in fold the score stays and only texts without a letter are rejected.
    """
    rows = found.where(fold & F.col("entropy").isNotNull() & F.col(lang).isNotNull())
    right = F.col("lang_pred") == F.col(lang)
    likely = lambda p: F.log(F.greatest(F.when(right, p).otherwise((1 - p) / F.greatest(F.size("rest"), F.lit(1))), F.lit(1e-12)))
    sums = rows.agg(*[F.sum(likely(_share(k))).alias(f"s{i}") for i, k in enumerate(SHARPNESS)]).first()  # one row
    best = max((i for i in range(len(SHARPNESS)) if sums[i] is not None), key=lambda i: sums[i], default=None)
    score = F.col("score") if best is None else F.when(F.col("entropy").isNotNull(), _share(SHARPNESS[best])).otherwise(0.0)
    limits = rows.groupBy("lang_pred").agg(F.percentile_approx("entropy", above, 10000).alias("_limit"))  # one row a language
    out = found.join(F.broadcast(limits), "lang_pred", "left").withColumn("score", score)
    return out.withColumn("rejected", F.col("entropy").isNull() | F.coalesce(F.col("entropy") > F.col("_limit"), F.lit(False))).drop("_limit", "entropy", "rest")
