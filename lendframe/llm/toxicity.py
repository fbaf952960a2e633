"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from document labels: in a toxic document the words whose log-odds (the greatest of the
word and its beginnings) come close to its most telling word are toxic, in other documents none is. The field has two
tags, features for the word and its beginnings, the same of its two neighbours and a bias, and tag transitions. It
is trained by full gradients summed over partitions of a bounded sample of labelled
rows. Forward-backward marginals give the offending spans (offsets into the original
text) and three figures from which a logistic model makes the document's score.

Marginals of a whole batch are computed together: the chain is cut into rows of equal
length whose transfer matrices are multiplied column by column, so that numpy works on
long vectors and memory stays bounded for texts of any length.

Defined results: null and empty texts, and texts without words, have no spans and get a score from
the same logistic model. Repeated rows are scored one by one. Null labels are
not used; without usable labels of both kinds every score is the share of ones among the labels, or one half
without any. Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lendframe.llm.common import annotate, stored, utf8
from lendframe.llm.decontaminate import WORD, words
from lendframe.llm.training import PARTS, Adam, labelled_sample, sigmoid, sum_vectors

#: Bounds of the labelled rows of either kind that the model is fitted on, and of its vocabulary.
TRAIN_ROWS = 4000
VOCABULARY = 40_000
MIN_DOCS, MIN_ODDS, NEAR = 3, 2.5, 1.0
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are features of their own
STEPS, RATE, L2, SHARE = 12, 0.3, 1e-4, 0.4
REMEMBERED = 300_000  # words whose features a task remembers
COLS = 64  # length of a row of the cut chain
GROUP = 300_000  # tokens tagged together


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, told apart by a first byte."""
    return [b"=" + word] + [b"%d" % k + word[:k] for k in PREFIXES if len(word) >= k]


class Field:
    """Weights of the field. ``index``: feature -> 1.. ; 0 stands for no feature. ``n``: size of one feature block.

    Tokens are numbered by word: ``kinds`` gives the features of each word met, row 0 those of none.
    """

    def __init__(self, index: dict[bytes, int], theta: np.ndarray | None = None):
        self.index, self.n = index, len(index) + 1
        self.theta = np.zeros(3 * self.n + 5) if theta is None else theta
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows: list[list[int]] = [[0] * (1 + len(PREFIXES))]

    def kinds(self) -> np.ndarray:
        return np.array(self.rows, np.int32)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        get = self.number.get
        out = [get(w) for w in tokens]
        if None in out:
            for i, k in enumerate(out):
                if k is None:
                    out[i] = self._learn(tokens[i])
        return np.array(out, np.int32)

    def _learn(self, word: bytes) -> int:
        if word not in self.number:
            f = [self.index.get(x, 0) for x in features(word)]
            if any(f):
                self.number[word] = len(self.rows)
                self.rows.append(f + [0] * (1 + len(PREFIXES) - len(f)))
            else:
                self.number[word] = 0
        return self.number[word]

    def marginals(self, ids: np.ndarray, first: np.ndarray, kinds: np.ndarray | None = None):
        """Probability of the toxic tag for each token, of toxic-toxic and of other-toxic pairs with the token before.

        ``first`` marks the first token of each document.
        """
        n, th = self.n, self.theta
        kinds = self.kinds() if kinds is None else kinds
        prev, nxt = neighbours(ids, first)
        w = th[:3 * n].reshape(3, n).copy()
        w[:, 0] = 0
        # one number per word and place; the extra last one is "no neighbour"
        known = np.append(w[:, kinds].sum(axis=2), np.zeros((3, 1)), axis=1)
        e = th[3 * n] + known[0][ids] + known[1][prev] + known[2][nxt]
        e = np.exp(np.clip(e, -25, 25))
        oo, ot, to, tt = np.exp(np.clip([0.0, th[3 * n + 2], th[3 * n + 3], th[3 * n + 4]], -10, 10))
        begin = np.exp(np.clip(th[3 * n + 1], -10, 10))
        return chain(e, first, oo, ot, to, tt, begin)


def neighbours(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids before and after within the document; -1 (the last column) where there is none."""
    prev, nxt = np.full(len(ids), -1, ids.dtype), np.full(len(ids), -1, ids.dtype)
    inner = ~first[1:]
    prev[1:][inner] = ids[:-1][inner]
    nxt[:-1][inner] = ids[1:][inner]
    return prev, nxt


def chain(e, first, oo, ot, to, tt, begin):
    """Forward-backward over documents laid end to end; a first token forgets what was before it."""
    n = len(e)
    rows = -(-n // COLS)
    pad = rows * COLS - n
    m = np.empty((2, 2, n + pad))
    m[0, 0, :n], m[0, 1, :n], m[1, 0, :n], m[1, 1, :n] = oo, ot * e, to, tt * e
    at = np.flatnonzero(first)
    m[:, 0, at], m[:, 1, at] = 1.0, begin * e[at]
    m[:, :, n:] = np.eye(2)[:, :, None]
    m /= m.sum(axis=(0, 1))
    m = m.reshape(2, 2, rows, COLS)

    p = np.repeat(np.eye(2)[:, :, None], rows, axis=2)
    for t in range(COLS):
        p = np.einsum("ijr,jkr->ikr", p, m[:, :, :, t])
        p /= p.sum(axis=(0, 1))
    whole = p.transpose(2, 0, 1).tolist()
    fwd, bwd = np.empty((2, rows)), np.empty((2, rows))
    a0, a1 = 0.5, 0.5
    for r, ((x, y), (z, w)) in enumerate(whole):
        fwd[0, r], fwd[1, r] = a0, a1
        a0, a1 = a0 * x + a1 * z, a0 * y + a1 * w
        s = a0 + a1
        a0, a1 = a0 / s, a1 / s
    b0, b1 = 0.5, 0.5
    for r in range(rows - 1, -1, -1):
        (x, y), (z, w) = whole[r]
        bwd[0, r], bwd[1, r] = b0, b1
        b0, b1 = x * b0 + y * b1, z * b0 + w * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s

    before = np.empty((2, rows, COLS))  # forward vector ahead of each token
    a = fwd
    for t in range(COLS):
        before[:, :, t] = a
        a = np.einsum("ir,ijr->jr", a, m[:, :, :, t])
        a = a / a.sum(axis=0)
    marg, tt_, ot_ = np.empty((rows, COLS)), np.empty((rows, COLS)), np.empty((rows, COLS))
    b = bwd
    for t in range(COLS - 1, -1, -1):
        pair = before[:, None, :, t] * m[:, :, :, t] * b[None, :, :]
        pair /= pair.sum(axis=(0, 1))
        marg[:, t] = pair[0, 1] + pair[1, 1]
        tt_[:, t], ot_[:, t] = pair[1, 1], pair[0, 1]
        b = np.einsum("ijr,jr->ir", m[:, :, :, t], b)
        b = b / b.sum(axis=0)
    return marg.ravel()[:n], tt_.ravel()[:n], ot_.ravel()[:n]


def gradient(field: Field, ids: np.ndarray, first: np.ndarray, tags: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Ascent direction of the log-likelihood: observed less expected features."""
    n = field.n
    p, tt, ot = field.marginals(ids, first, kinds)
    d = tags - p
    prev, nxt = neighbours(ids, first)
    g = np.zeros(3 * n + 5)
    for i, k in enumerate((ids, prev, nxt)):
        ok = k >= 0
        by_word = np.bincount(k[ok], d[ok], len(kinds))
        for column in kinds.T:
            g[i * n:(i + 1) * n] += np.bincount(column, by_word, n)
        g[i * n] = 0
    g[3 * n] = d.sum()
    g[3 * n + 1] = d[first].sum()
    inner = ~first
    was = np.concatenate(([0.0], tags[:-1]))
    p_was = np.concatenate(([0.0], p[:-1]))
    g[3 * n + 2] = ((1 - was) * tags - ot)[inner].sum()
    g[3 * n + 3] = (was * (1 - tags) - (p_was - tt))[inner].sum()
    g[3 * n + 4] = (was * tags - tt)[inner].sum()
    return g


def figures(p: np.ndarray) -> tuple[float, float, float]:
    """Document figures: greatest marginal (as log-odds), total marginal, length."""
    if not len(p):
        return (-12.0, -12.0, 0.0)
    top = float(min(max(p.max(), 6e-6), 1 - 6e-6))
    return (float(np.log(top / (1 - top))), float(np.log(p.sum() + 6e-6)), float(np.log1p(len(p))))


class ToxicModel:
    """Field, and the logistic weights of the document figures; ``rate`` alone where training was not possible."""

    def __init__(self, rate: float, field: Field | None = None, doc: np.ndarray | None = None):
        self.rate, self.field, self.doc = rate, field, doc

    def tag(self, texts: list[bytes]) -> list[np.ndarray]:
        """Marginals of every token of every text."""
        if self.field is None:
            return [np.zeros(0) for _ in texts]
        out, group, size = [], [], 0
        if len(self.field.number) > REMEMBERED:
            self.field.forget()
        for i, t in enumerate(texts):
            group.append(self.field.ids(words(t)))
            size += len(group[-1])
            if size >= GROUP or i + 1 == len(texts):
                out += self._tag_group(group)
                group, size = [], 0
        return out

    def _tag_group(self, group: list[np.ndarray]) -> list[np.ndarray]:
        ids = np.concatenate(group)
        if not len(ids):
            return [np.zeros(0) for _ in group]
        p = self.field.marginals(ids, first_marks(group))[0]
        return np.split(p, np.cumsum([len(g) for g in group])[:-1])

    def scores(self, marginals: list[np.ndarray]) -> np.ndarray:
        if self.field is None:
            return np.full(len(marginals), self.rate)
        x = np.array([(1.0, *figures(p)) for p in marginals]).reshape(-1, 4)
        return sigmoid(x @ self.doc)


def unpack(rows: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Stored feature rows as documents, word numbers and the features of each number."""
    docs = [np.frombuffer(x, np.int32).reshape(-1, 1 + len(PREFIXES)) for x in rows]
    flat = np.concatenate(docs)
    odd = np.random.default_rng(5).integers(0, 1 << 63, flat.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
    _, at, ids = np.unique(flat.astype(np.uint64) @ odd, return_index=True, return_inverse=True)
    return docs, ids.astype(np.int32), flat[at]


def first_marks(group: list[np.ndarray]) -> np.ndarray:
    first = np.zeros(sum(map(len, group)), bool)
    at = np.cumsum([0, *map(len, group)])[:-1]
    first[[i for i, g in zip(at, group, strict=True) if len(g)]] = True
    return first


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", rows: int = TRAIN_ROWS) -> ToxicModel:
    """Train on at most ``rows`` labelled rows of either kind."""
    lab = labels.filter(F.col(label_col).isin(0, 1))
    size = {r[0]: r[1] for r in lab.groupBy(F.col(label_col).cast("int")).count().collect()}
    total = sum(size.values())
    if len(size) < 2:
        return ToxicModel(next(iter(size)) * 1.0 if size else 0.5)
    chosen = labelled_sample(lab.filter(F.col(label_col) == 1), label_col, id_col, rows).unionByName(
        labelled_sample(lab.filter(F.col(label_col) == 0), label_col, id_col, rows))
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(
        F.broadcast(chosen), "id").dropDuplicates(["t", "y"])
    train = stored(found.repartition(PARTS, "id"), "toxic_train")

    def start():
        return lambda t: [[sorted({f for w in set(words(x)) for f in features(w)}) for x in utf8(t)]]
    seen = annotate(train, ["t"], [("w", T.ArrayType(T.BinaryType()))], start, ["y"])
    by = train.groupBy().agg(F.sum("y"), F.count(F.lit(1))).first()
    n1, n0 = by[0] or 0, (by[1] or 0) - (by[0] or 0)
    if not n1 or not n0:
        return ToxicModel(size.get(1, 0) / total)
    stat = seen.select("y", F.explode("w").alias("w")).groupBy("w").agg(
        F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")).filter(F.col("n1") + F.col("n0") >= MIN_DOCS)
    odds = F.log((F.col("n1") + 0.5) / (n1 + 1)) - F.log((F.col("n0") + 0.5) / (n0 + 1))
    top = stat.select("w", odds.alias("odds")).orderBy(F.abs("odds").desc(), "w").limit(VOCABULARY).collect()
    index = {bytes(r.w): i for i, r in enumerate(top, 1)}
    strength = np.array([-99.0, *(r.odds for r in top)])
    field = Field(index)
    weight = {1: size[1] / n1, 0: size[0] / n0}

    held = train.sparkSession.sparkContext.broadcast((field, strength))

    def prepare():
        def run(text, y):
            f, s = held.value
            ids = [f.ids(words(t)) for t in utf8(text)]
            kinds = f.kinds()
            force = s[kinds].max(axis=1)
            tags = [(force[k] >= max(MIN_ODDS, force[k].max() - NEAR)).astype(np.int8) if label and len(k)
                    else np.zeros(len(k), np.int8) for k, label in zip(ids, y.to_pylist(), strict=True)]
            return [pa.array([kinds[k].tobytes() for k in ids]), pa.array([g.tobytes() for g in tags])]
        return run
    tokens = stored(annotate(train, ["t", "y"], [("k", T.BinaryType()), ("g", T.BinaryType())], prepare, ["y"]),
                    "toxic_tokens")

    def tag_counts(batches):
        n, c = held.value[0].n, 0
        for b in batches:
            k = np.frombuffer(b"".join(b.column(0).to_pylist()), np.int32).reshape(-1, 1 + len(PREFIXES))
            g = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int8)
            for column in k.T:
                c = c + np.concatenate((np.bincount(column, g, n), np.bincount(column, 1 - g, n), [0]))
            c[-1] += g.sum()
        return c if len(np.shape(c)) else None
    counts = sum_vectors(tokens.select("k", "g"), tag_counts)
    on, off = counts[:-1].reshape(2, -1)
    n_on = counts[-1]
    n_all = (on.sum() + off.sum()) / (1 + len(PREFIXES))
    prior = np.log((n_on + 0.5) / (n_all - n_on + 0.5))
    # for a single feature the best weight is this log ratio; gradients go on from a share of it
    field.theta[:field.n] = SHARE * (np.log((on + 0.1) / (off + 0.1)) - prior)
    field.theta[0], field.theta[3 * field.n] = 0, prior

    opt = Adam(len(field.theta), RATE)
    for step in range(STEPS):
        sent = train.sparkSession.sparkContext.broadcast(field.theta)

        def local(batches, sent=sent):
            f = held.value[0]
            f.theta = sent.value
            g = np.zeros(len(f.theta) + 1)
            for b in batches:
                k, ids, kinds = unpack(b.column(0).to_pylist())
                tags = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int8).astype(float)
                if len(tags):
                    g[:-1] += gradient(f, ids, first_marks(k), tags, kinds)
                    g[-1] += len(tags)
            return g
        g = sum_vectors(tokens.select("k", "g"), local)
        sent.unpersist()
        opt.rate = RATE / (1 + step)
        field.theta = field.theta + opt.step(L2 / field.n * field.theta - g[:-1] / max(g[-1], 1))

    doc = np.zeros(4)
    final = train.sparkSession.sparkContext.broadcast(field)
    for _ in range(8):  # Newton steps
        def newton(batches, doc=doc):
            out = np.zeros(20)
            for b in batches:
                k, ids, kinds = unpack(b.column(0).to_pylist())
                p = final.value.marginals(ids, first_marks(k), kinds)[0] if len(ids) else np.zeros(0)
                p = np.split(p, np.cumsum([len(x) for x in k])[:-1])
                y = np.array(b.column(1).to_pylist(), float)
                x = np.array([(1.0, *figures(q)) for q in p]).reshape(-1, 4)
                w = np.where(y == 1, weight[1], weight[0])
                q = sigmoid(x @ doc)
                out += np.concatenate((((w * q * (1 - q))[:, None] * x).T @ x, (x.T @ (w * (y - q)))[None])).ravel()
            return out
        s = sum_vectors(tokens.select("k", "y"), newton)
        doc = doc + np.clip(np.linalg.solve(s[:16].reshape(4, 4) + 0.5 * np.eye(4), s[16:] - 0.5 * doc), -3, 3)
    return ToxicModel(size[1] / total, field, doc)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns plus ``score``, ``predicted`` and ``spans`` (character ranges of tokens tagged toxic)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by VOCABULARY

    def start():
        def run(text):
            raw = utf8(text)
            tagged = held.value.tag(raw)
            s = held.value.scores(tagged)
            spans = [_spans(r, p) for r, p in zip(raw, tagged, strict=True)]
            return [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), spans]
        return run
    return annotate(docs, [text_col], [("score", T.DoubleType()), ("predicted", T.IntegerType()), ("spans", SPAN)],
                    start, carry)


def _spans(raw: bytes, p: np.ndarray) -> list[dict]:
    hit = np.flatnonzero(p >= 0.5)
    if not len(hit):
        return []
    at = [m.span() for m in WORD.finditer(raw.decode("utf-8", "replace"))]
    runs = np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)
    return [{"start": at[r[0]][0], "stop": at[r[-1]][1]} for r in runs]
