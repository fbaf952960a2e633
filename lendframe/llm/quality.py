"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from
its character-class transitions and repetition figures, gated attention weighs the
encodings, and the weighted sum gives the document's score. Only document labels are
needed. Parameters are trained on a bounded sample of labelled rows: in each round
every partition takes minibatch steps from the common parameters, and the results
are averaged by row count. Every passage of every document is scored.

Defined results: null and empty texts are one empty passage and get a score like any other.
Repeated rows are scored one by one. Null labels are not used; without usable labels of both kinds every
score is the share of ones among the labels, or one half without any. Columns of the
input that have the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lendframe.llm.common import annotate, stored, utf8
from lendframe.llm.training import PARTS, Adam, labelled_sample, sigmoid, sum_vectors

#: Bound of the labelled rows that the model is fitted on.
TRAIN_ROWS = 8000
PASSAGE = 64
BLOCK = 2048  # passages encoded at a time
ROUNDS, EPOCHS, BATCH, RATE, DECAY = 5, 6, 64, 0.01, 1e-4
HIDDEN, GATE = 16, 8
EXTRA = 8
WIDTH = 64 + EXTRA
_SPACE = [0x20, *range(9, 14)]


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, space, line break, mark, symbol, non-ASCII."""
    c = np.full(256, 6, np.uint8)
    c[0x61:0x7B], c[0x41:0x5B], c[0x30:0x3A], c[0x80:] = 0, 1, 2, 7
    c[[0x20, 9]] = 3
    c[10:14] = 4
    c[[ord(x) for x in ".,;:?'\"()-"]] = 5
    return c


CLASSES = _classes()
IS_SPACE = np.isin(np.arange(256), _SPACE)


def encode(text: bytes) -> np.ndarray:
    """Feature rows of the passages of a text."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros((1, WIDTH), np.float32)
    space = IS_SPACE[raw]
    first = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))[::PASSAGE]
    edge = np.append(first, len(raw))
    lines = text.split(b"\n")
    whole = (len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(n))
    out = np.empty((len(first), WIDTH), np.float32)
    for lo in range(0, len(first), BLOCK):
        hi = min(lo + BLOCK, len(first))
        part = CLASSES[raw[edge[lo]:edge[hi]]].astype(np.int32)
        at = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(edge[lo:hi + 1]))
        pair = at[:-1] * 64 + part[:-1] * 8 + part[1:]
        size = np.maximum(np.diff(edge[lo:hi + 1]), 1)[:, None]
        out[lo:hi, :64] = np.bincount(pair, minlength=(hi - lo) * 64).reshape(hi - lo, 64) / size
    for k in range(len(first)):
        w = words[k * PASSAGE:(k + 1) * PASSAGE]
        m = len(w)
        out[k, 64:] = (len(set(w)) / m, sum(map(bytes.__eq__, w, w[1:])) / m, sum(map(len, w)) / m / 8,
                       sum(map(bytes.isupper, w)) / m, m / PASSAGE, *whole)
    return out


def _shapes():
    return [(WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, GATE), (HIDDEN, GATE), (GATE,), (HIDDEN,), (1,)]


def _split(theta: np.ndarray) -> list[np.ndarray]:
    out, i = [], 0
    for s in _shapes():
        k = int(np.prod(s))
        out.append(theta[i:i + k].reshape(s))
        i += k
    return out


def _initial() -> np.ndarray:
    r = np.random.default_rng(11)
    return np.concatenate([(r.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 else np.zeros(s) if s != (GATE,)
                            else r.normal(0, 0.3, s)).ravel() for s in _shapes()] )


def forward(theta: np.ndarray, x: np.ndarray, starts: np.ndarray):
    """Logits of the bags that begin at ``starts``, and what the gradient needs."""
    w, b, v, u, g, c, b0 = _split(theta)
    h = np.tanh(x @ w + b)
    tv, su = np.tanh(h @ v), sigmoid(h @ u)
    s = (tv * su) @ g
    bag = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
    e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts)
    return z @ c + b0[0], (h, tv, su, a, z, bag)


def gradient(theta, x, starts, y):
    w, b, v, u, g, c, b0 = _split(theta)
    logit, (h, tv, su, a, z, bag) = forward(theta, x, starts)
    d = (sigmoid(logit) - y) / len(y)
    dz = d[:, None] * c
    hz = np.einsum("ij,ij->i", h, dz[bag])
    ds = a * (hz - np.add.reduceat(a * hz, starts)[bag])
    dq = ds[:, None] * g
    dtv, dsu = dq * su * (1 - tv * tv), dq * tv * su * (1 - su)
    dh = a[:, None] * dz[bag] + dtv @ v.T + dsu @ u.T
    dx = dh * (1 - h * h)
    parts = [x.T @ dx, dx.sum(0), h.T @ dtv, h.T @ dsu, (tv * su).T @ ds, z.T @ d, np.array([d.sum()])]
    return np.concatenate([p.ravel() for p in parts]) + DECAY * theta


def _bags(rows: list[bytes], mean, scale):
    x = [np.frombuffer(r, np.float32).reshape(-1, WIDTH) for r in rows]
    starts = np.concatenate(([0], np.cumsum([len(i) for i in x])[:-1]))
    return (np.concatenate(x) - mean) / scale, starts


class QualityModel:
    """Parameters; ``rate`` alone where training was not possible."""

    def __init__(self, rate: float, theta=None, mean=None, scale=None):
        self.rate, self.theta, self.mean, self.scale = rate, theta, mean, scale

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.theta is None:
            return np.full(len(texts), self.rate)
        out = np.empty(len(texts))
        rows: list[bytes] = []
        size = lo = 0
        for i, t in enumerate(texts):
            rows.append(encode(t).tobytes())
            size += len(rows[-1])
            if size > 8_000_000 or i + 1 == len(texts):
                x, starts = _bags(rows, self.mean, self.scale)
                out[lo:i + 1] = sigmoid(forward(self.theta, x, starts)[0])
                rows, size, lo = [], 0, i + 1
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", rows: int = TRAIN_ROWS) -> QualityModel:
    """Train on at most ``rows`` of the labelled rows given."""
    chosen = labelled_sample(labels, label_col, id_col, rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "id")

    def start():
        return lambda text: [pa.array([encode(t).tobytes() for t in utf8(text)])]
    bags = stored(annotate(found, ["t"], [("x", T.BinaryType())], start, ["id", "y"]).repartition(PARTS, "id"), "bags")

    def moments(batches):
        s = np.zeros(2 + 2 * WIDTH + 1)
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(np.float64)
                s += np.concatenate(([1, y, len(x)], x.sum(0), (x * x).sum(0)))
        return s
    s = sum_vectors(bags.select("x", "y"), moments)
    if s is None or s[0] == 0:
        return QualityModel(0.5)
    rate = s[1] / s[0]
    if rate in (0.0, 1.0):
        return QualityModel(float(rate))
    mean = s[3:3 + WIDTH] / s[2]
    scale = np.sqrt(np.maximum(s[3 + WIDTH:] / s[2] - mean * mean, 0)) + 1e-3
    theta = _initial()
    for k in range(ROUNDS):
        def local(batches, theta=theta, k=k):
            xs, ys = [], []
            for b in batches:
                xs += b.column(0).to_pylist()
                ys += b.column(1).to_pylist()
            if not ys:
                return None
            t, opt, y = theta.copy(), Adam(len(theta), RATE * 0.6 ** k), np.array(ys, float)
            order = np.random.default_rng(k)
            for _ in range(EPOCHS):
                p = order.permutation(len(ys))
                for i in range(0, len(p), BATCH):
                    q = p[i:i + BATCH]
                    x, st = _bags([xs[j] for j in q], mean, scale)
                    t += opt.step(gradient(t, x, st, y[q]))
            return np.concatenate(([len(ys)], len(ys) * t))
        r = sum_vectors(bags.select("x", "y"), local)
        theta = r[1:] / r[0]
    return QualityModel(float(rate), theta, mean, scale)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns plus ``score`` (higher: label 1 likelier) and ``predicted``."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def start():
        def run(text):
            s = held.value.score(utf8(text))
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
        return run
    return annotate(docs, [text_col], [("score", T.DoubleType()), ("predicted", T.IntegerType())], start, carry)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of quality, with all their columns."""
    names = docs.columns
    own = {n: f"_own_{n}" for n in ("score", "predicted") if n in names}
    d = score(docs.withColumnsRenamed(own), model, text_col).filter("predicted = 1").drop("score", "predicted")
    return d.withColumnsRenamed({v: k for k, v in own.items()}).select(*names)
