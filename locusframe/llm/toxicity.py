"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy, over all overlapping windows.

A word's inputs are an embedding of the word, the mean embedding of its character n-grams, with marks at its ends, so unseen forms of known
stems count, and class log-odds of both. The embeddings are hashed tables that the network learns with its other weights. Log-odds are counted in
hashed tables too, on the half of the sample that a text isn't in while the network learns. The network sees windows of WINDOW words; a text's score is that of its highest window, calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import RangeHash, arrow_batches, grouped, lowered, text_bytes, word_spans
from .labelled import sample

WINDOW, STRIDE = 32, 16
HIDDEN, ATTENTION = 8, 8
#: Rows of each class that the network learns from, at most.
PER_CLASS = 2000
TABLE_BITS, SMOOTHING, NGRAMS = 17, 3.0, (3, 4, 5, 6)
EPOCHS, BATCH, RATE = 6, 256, 0.01
#: The embeddings' share of RATE, and the pull of their values to 0.
EMBEDDED_RATE, DECAY = 0.1, 0.001
CHUNK, BLOCK = 1_500_000, 2048
#: Log-odds features and numbers of an embedding; rows of the embeddings' tables, in bits.
ODDS, EMBEDDED, ROW_BITS = 7, 8, 14
INPUTS = ODDS + 2 * EMBEDDED
_U = np.uint64
_INSIDE = np.array([chr(i).isalnum() and i < 128 or i >= 128 for i in range(256)])


def _place(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - TABLE_BITS)).astype(np.int64)


class Inputs:
    """What the network sees of distinct words: log-odds, the place of the word's embedding and those of its counts n-grams, end to end."""

    def __init__(self, odds: np.ndarray, words: np.ndarray, grams: np.ndarray, counts: np.ndarray):
        self.odds, self.words, self.grams, self.counts = odds, words, grams, counts

    def take(self, rows: np.ndarray) -> Inputs:
        n = self.counts[rows]
        begin = (np.cumsum(self.counts) - self.counts)[rows]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Inputs(self.odds[rows], self.words[rows], self.grams[at], n)

    @staticmethod
    def joined(parts: list[Inputs]) -> Inputs:
        return Inputs(*[np.concatenate([getattr(x, name) for x in parts]) for name in ("odds", "words", "grams", "counts")])


class Words:
    """The words of texts: rows, which distinct word each is, and the distinct words' features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data, _ = lowered(data)
        starts, ends, self.row = word_spans(data, offsets, _INSIDE)
        self.count = np.bincount(self.row, minlength=len(offsets) - 1)
        hashes, first, self.which = np.unique(RangeHash(data)(starts, ends), return_index=True, return_inverse=True)
        self.words = _place(hashes)
        starts, lengths = starts[first], (ends - starts)[first]
        # the distinct words once more, each between marks
        size = lengths + 2
        to = np.cumsum(size)
        marked = np.zeros(to[-1] if len(to) else 0, np.uint8)
        at = np.repeat(to - size + 1 - np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(to) else to, lengths) + np.arange(lengths.sum())
        marked[at] = data[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())]
        marked[to - size], marked[to - 1] = 1, 2
        owner = np.repeat(np.arange(len(size)), size)
        hash_of = RangeHash(marked)
        grams, owners = [], []
        for n in NGRAMS:
            if len(marked) >= n:
                same = owner[: len(marked) - n + 1] == owner[n - 1 :]
                grams.append(_place(hash_of.windows(n)[same]))
                owners.append(owner[: len(marked) - n + 1][same])
        self.grams = np.concatenate(grams) if grams else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.owner, kind="stable")
        self.grams, self.owner = self.grams[order], self.owner[order]
        self.lengths = lengths

    def inputs(self, words: np.ndarray, grams: np.ndarray) -> Inputs:
        """Of each distinct word, with its log-odds by the tables."""
        n = len(self.words)
        out = np.zeros((n, ODDS), np.float32)
        counts = np.bincount(self.owner, minlength=n)  # a marked word has 3 bytes or more, so one n-gram
        places = [(x >> (TABLE_BITS - ROW_BITS)).astype(np.int32) for x in (self.words, self.grams)]
        if not n:
            return Inputs(out, *places, counts)
        values = grams[self.grams]
        begin = np.cumsum(counts) - counts
        out[:, 0] = words[self.words]
        out[:, 1] = np.maximum.reduceat(values, begin)
        out[:, 2] = np.add.reduceat(values, begin) / counts
        out[:, 3] = np.minimum.reduceat(values, begin)
        out[:, 4] = np.add.reduceat((values > 1.5).astype(np.float32), begin) / 4
        out[:, 5] = np.minimum(self.lengths, 20) / 10
        out[:, 6] = np.abs(out[:, 0]) > 0.5
        return Inputs(out, *places, counts)


class Odds:
    """Tables of log-odds of hashed words and n-grams, from the numbers of texts of each class that hold them."""

    def __init__(self):
        self.words = np.zeros((2, 1 << TABLE_BITS), np.float32)
        self.grams = np.zeros((2, 1 << TABLE_BITS), np.float32)
        self.texts = np.zeros(2)

    def add(self, w: Words, labels: np.ndarray) -> None:
        pairs = np.unique(w.row.astype(np.int64) * (len(w.words) + 1) + w.which)
        row, which = pairs // (len(w.words) + 1), pairs % (len(w.words) + 1)
        begin = np.searchsorted(w.owner, np.arange(len(w.words) + 1))
        for y in (0, 1):
            mine = labels[row] == y
            self.words[y] += np.bincount(w.words[which[mine]], minlength=1 << TABLE_BITS)
            for r in np.unique(row[mine]):
                own = which[mine & (row == r)] if len(labels) == 1 else which[np.searchsorted(row, r) : np.searchsorted(row, r, "right")]
                lengths = begin[own + 1] - begin[own]
                g = np.unique(w.grams[np.repeat(begin[own] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())])
                self.grams[y][g] += 1
            self.texts[y] += (labels == y).sum()

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        share = max(self.texts[1], 1) / max(self.texts[0], 1)
        odds = lambda t: np.log((t[1] + SMOOTHING) / (t[0] * share + SMOOTHING)).astype(np.float32)
        return odds(self.words), odds(self.grams)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (of all texts' words), length and row of every window: each STRIDE words until a window ends the text."""
    number = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE), 0) + 1, 0)
    row = np.repeat(np.arange(len(counts)), number)
    k = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    begin = (np.cumsum(counts) - counts)[row] + k * STRIDE
    return begin, np.minimum(counts[row] - k * STRIDE, WINDOW), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Embeddings, two gated recurrent layers, forwards and backwards, attention over their states, and one output."""

    def __init__(self, seed: int = 5):
        draw = np.random.Generator(np.random.PCG64(seed))
        new = lambda *shape: (draw.normal(0, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"va": new(ATTENTION, 1), "wa": new(2 * HIDDEN, ATTENTION), "ba": np.zeros(ATTENTION, np.float32), "w": new(2 * HIDDEN, 1), "b": np.zeros(1, np.float32)}
        self.p |= {k: (draw.normal(0, 0.1, (1 << ROW_BITS, EMBEDDED))).astype(np.float32) for k in ("words", "grams")}
        for d in "fb":
            self.p |= {f"x{d}": new(INPUTS, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"u{d}": new(HIDDEN, 3 * HIDDEN), f"n{d}": np.zeros(HIDDEN, np.float32)}

    def features(self, x: Inputs) -> np.ndarray:
        """The inputs of each distinct word, and zeros for no word at the end."""
        n = len(x.words)
        out = np.zeros((n + 1, INPUTS), self.p["words"].dtype)
        if n:
            out[:n, :ODDS], out[:n, ODDS : ODDS + EMBEDDED] = x.odds, self.p["words"][x.words]
            out[:n, ODDS + EMBEDDED :] = np.add.reduceat(self.p["grams"][x.grams], np.cumsum(x.counts) - x.counts) / x.counts[:, None]
        return out

    def project(self, x: Inputs) -> dict[str, np.ndarray]:
        """The inputs' part of all gates for each distinct word, and for no word at the end."""
        return self._project(self.features(x))

    def _project(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        return {d: rows @ self.p[f"x{d}"] + self.p[f"c{d}"] for d in "fb"}

    def states(self, projected, ids: np.ndarray, full: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, window, 2 * HIDDEN) for ids (window, step); full marks the steps that have a word."""
        n, steps = ids.shape
        out = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        for d in "fb":
            h, u, c = np.zeros((n, HIDDEN), np.float32), self.p[f"u{d}"], self.p[f"n{d}"]
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                x, g = projected[d][ids[:, t]], h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                inner = g[:, 2 * HIDDEN :] + c
                cand = np.tanh(x[:, 2 * HIDDEN :] + r * inner)
                new = np.where(full[:, t, None], cand + z * (h - cand), h)
                if keep is not None:
                    keep.append((d, t, h, z, r, inner, cand))
                h = new
                out[t][:, slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)] = h
        return out

    def pool(self, states: np.ndarray, full: np.ndarray):
        p = self.p
        a = np.tanh(states @ p["wa"] + p["ba"])
        e = np.where(full.T, (a @ p["va"])[:, :, 0], -1e9)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        return (pooled @ p["w"])[:, 0] + p["b"][0], pooled, alpha, a

    def logits(self, projected, ids: np.ndarray, full: np.ndarray) -> np.ndarray:
        return self.pool(self.states(projected, ids, full), full)[0]

    def gradients(self, x: Inputs, ids: np.ndarray, full: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy."""
        p, keep = self.p, []
        used, back = np.unique(ids, return_inverse=True)  # -1, no word, is the last row
        x, ids = x.take(used[used >= 0]), back.reshape(ids.shape) - (used[0] < 0)
        ids = np.where(ids < 0, len(x.words), ids)
        rows = self.features(x)
        states = self.states(self._project(rows), ids, full, keep)
        logit, pooled, alpha, a = self.pool(states, full)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        g["w"], g["b"] = pooled.T @ dl[:, None], np.array([dl.sum()], np.float32)
        dp = dl[:, None] * p["w"][:, 0]
        ds = alpha[:, :, None] * dp
        da = np.einsum("nh,tnh->tn", dp, states)
        de = alpha * (da - (alpha * da).sum(axis=0))
        du = de[:, :, None] * p["va"][:, 0] * (1 - a * a)
        g["va"] = np.einsum("tn,tna->a", de, a)[:, None]
        g["wa"], g["ba"] = np.einsum("tnh,tna->ha", states, du), du.sum(axis=(0, 1))
        ds += du @ p["wa"].T
        dh = {d: np.zeros((len(y), HIDDEN), np.float32) for d in "fb"}
        of_gates = {d: np.zeros((*ids.T.shape, 3 * HIDDEN), rows.dtype) for d in "fb"}
        for d, t, h, z, r, inner, cand in reversed(keep):
            out = dh[d] + ds[t][:, slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)]
            live = np.where(full[:, t, None], out, 0)
            dc = live * (1 - z) * (1 - cand * cand)
            dz = live * (h - cand) * z * (1 - z)
            dr = dc * inner * r * (1 - r)
            of_gates[d][t] = np.concatenate([dz, dr, dc], axis=1)
            back = np.concatenate([dz, dr, dc * r], axis=1)
            g[f"u{d}"] += h.T @ back
            g[f"n{d}"] += back[:, 2 * HIDDEN :].sum(axis=0)
            dh[d] = np.where(full[:, t, None], live * z + back @ p[f"u{d}"].T, out)
        order = np.argsort(ids.T, axis=None, kind="stable")
        which, begin = np.unique(ids.T.ravel()[order], return_index=True)
        dx = np.zeros_like(rows)
        for d in "fb":
            by_word = np.add.reduceat(of_gates[d].reshape(-1, 3 * HIDDEN)[order], begin)
            g[f"x{d}"], g[f"c{d}"] = rows[which].T @ by_word, by_word.sum(axis=0)
            dx[which] += by_word @ p[f"x{d}"].T
        n = len(x.words)
        grams = np.repeat(dx[:n, ODDS + EMBEDDED :] / x.counts[:, None], x.counts, axis=0)
        for i in range(EMBEDDED):
            g["words"][:, i] = np.bincount(x.words, dx[:n, ODDS + i], 1 << ROW_BITS)
            g["grams"][:, i] = np.bincount(x.grams, grams[:, i], 1 << ROW_BITS)
        return g

    def fit(self, x: Inputs, ids: np.ndarray, full: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(y))
            for k in range(0, len(y), BATCH):
                part = order[k : k + BATCH]
                step += 1
                for name, grad in self.gradients(x, ids[part], full[part], y[part]).items():
                    a, b = m[name]
                    a += 0.1 * (grad - a)
                    b += 0.001 * (grad * grad - b)
                    move = (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
                    if name in ("words", "grams"):
                        move = EMBEDDED_RATE * (move + DECAY / RATE * self.p[name])
                    self.p[name] -= RATE * move


def _ids(w: Words, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(WINDOW)
    full = steps < length[:, None]
    if not len(w.which):
        return np.zeros((len(begin), WINDOW), np.int64), full
    return np.where(full, w.which[np.minimum(begin[:, None] + steps, len(w.which) - 1)], len(w.words)), full


class Model:
    """Tables, network and calibration; without rows of both classes every score is 0."""

    def __init__(self, texts: list[str], labels: list[int], seed: int = 3):
        y = np.array(labels, np.float32)
        self.network, self.slope, self.shift = None, 1.0, 0.0
        if len(set(labels)) < 2:
            return
        fold = np.arange(len(y)) % 2
        words = lambda i: Words(*text_bytes(pa.array([texts[i]], pa.string())))  # noqa: E731  made anew in each pass, so that one text's n-grams are held at a time
        odds = [Odds(), Odds()]
        for i in range(len(texts)):
            odds[fold[i]].add(words(i), y[i : i + 1])
        tables = [o.tables() for o in odds]
        both = Odds()
        both.words, both.grams, both.texts = (sum(getattr(o, name) for o in odds) for name in ("words", "grams", "texts"))
        self.words, self.grams = both.tables()
        draw = np.random.Generator(np.random.PCG64(seed))
        inputs, ids, full, target, size = [], [], [], [], 0
        learns = np.arange(len(y)) % 5 != 4  # the others calibrate
        for i in np.flatnonzero(learns):
            w = words(i)
            begin, length, _ = windows(w.count)
            if not len(begin):
                continue
            x = w.inputs(*tables[1 - fold[i]])
            value = np.concatenate([x.odds[:, 1], [0]])
            a, b = _ids(w, begin, length)
            top = np.argsort(-value[a].max(axis=1) - 0.1 * np.maximum(value[a], 0).sum(axis=1), kind="stable")[: 2 if len(a) > 1 else 1]
            if not y[i]:
                top = np.unique(np.concatenate([top, draw.integers(0, len(a), 1)]))
            used, back = np.unique(a[top][b[top]], return_inverse=True)
            mine = np.full(b[top].shape, -1)
            mine[b[top]] = back + size
            ids.append(mine)
            full.append(b[top])
            inputs.append(x.take(used))
            target += [y[i]] * len(top)
            size += len(used)
        self.network = Network()
        self.network.fit(Inputs.joined(inputs), np.concatenate(ids), np.concatenate(full), np.array(target, np.float32))
        rest = np.flatnonzero(~learns)
        scores = np.array([self._highest(words(i), tables[1 - fold[i]])[0] for i in rest])
        self._calibrate(scores, y[rest])

    def _calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's scaling by Newton steps, with a weak pull to slope 1."""
        if len(set(y.tolist())) < 2:
            return
        theta = np.array([1.0, 0.0])
        rows = np.stack([x, np.ones_like(x)], axis=1).astype(float)
        for _ in range(50):
            p = _sigmoid(rows @ theta)
            gradient = rows.T @ (p - y) + 0.1 * (theta - [1.0, 0.0])
            hessian = (rows * (p * (1 - p))[:, None]).T @ rows + 0.1 * np.eye(2)
            theta = theta - np.linalg.solve(hessian, gradient)
        if theta[0] > 0:
            self.slope, self.shift = float(theta[0]), float(theta[1])

    def _highest(self, w: Words, tables) -> np.ndarray:
        """The highest logit of each text's windows; a text without words has -20."""
        out = np.full(len(w.count), -20.0, np.float32)
        begin, length, row = windows(w.count)
        projected = self.network.project(w.inputs(*tables))
        for k in range(0, len(begin), BLOCK):
            ids, full = _ids(w, begin[k : k + BLOCK], length[k : k + BLOCK])
            np.maximum.at(out, row[k : k + BLOCK], self.network.logits(projected, ids, full))
        return out

    def scores(self, column) -> np.ndarray:
        data, offsets = text_bytes(column)
        if not self.network:
            return np.zeros(len(offsets) - 1)
        out = []
        for part in grouped(np.diff(offsets).tolist(), CHUNK):
            edges = offsets[part.start : part.stop + 1]
            if edges[-1] - edges[0] > 2 * CHUNK:  # one long text: in pieces that overlap by a window and end between words
                out.append(self._long(data[edges[0] : edges[-1]]))
            else:
                out.append(self._highest(Words(data[edges[0] : edges[-1]], edges - edges[0]), (self.words, self.grams)))
        logits = np.concatenate(out) if out else np.zeros(0)
        return _sigmoid(self.slope * logits.astype(float) + self.shift)

    def _long(self, data: np.ndarray) -> np.ndarray:
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), _INSIDE)
        best, step = np.float32(-20), 64_000 // STRIDE * STRIDE
        for k in range(0, max(len(starts), 1), step):
            a, b = k, min(k + step + WINDOW - STRIDE, len(starts))
            if a < b:
                piece = data[starts[a] : ends[b - 1]]
                best = max(best, self._highest(Words(piece, np.array([0, len(piece)])), (self.words, self.grams))[0])
        return np.array([best], np.float32)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from at most per_class labelled rows of each class that are not held out; rows with a null text teach as empty ones."""
    rows = sample(docs, labels, label, per_class, [text], key).toPandas().sort_values([key, text], kind="stable")
    return Model([t or "" for t in rows[text]], [int(y) for y in rows["label"]])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, score): the probability that each whole text is toxic.

    Null and empty texts and texts without words get the lowest score. Repeated rows and null keys are scored alike; an empty table
    gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size and the network
    arrow_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(shared.value.scores(batch.column(0)), pa.float64())], [key, *keep, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return docs.select(text, key, *keep).mapInArrow(run, f"{kinds}, score double")
