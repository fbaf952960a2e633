"""Language-model scores from a hashed maximum-entropy model.

The probability of a token is that of its class given the words before it, times that of the
word within its class. The class factor is a softmax over ``CLASSES`` classes whose features are hashed rows: the
previous word, the word before that (a skip feature), and the two together. Its weights start at smoothed log
ratios of counts over the whole training text and are then moved by gradient updates. A gradient is observed less
expected counts, and the expectation depends on the two hashed words before a token only, so the training text is gathered
once into a distributed table of such contexts (at most ``WORD_ROWS`` squared) and each update sums over that table: exactly the
gradient of the whole training text. The word
factor has the word itself as its only feature, for which smoothed relative counts are the
solution in closed form. The commonest words and the end mark are classes of their own, all others are
classed by their last letters and marks.

Words: A-Z lower-cased, cut at spaces and the characters 9 to 13; each text ends with one end mark.

Counts of all words are kept in a distributed table. Tasks get the ``HEAD`` commonest words only; the rarer
words of each document are joined with the table, which is safe from hot keys because a word outside the
head occurs at most as often as each word inside.

Defined results: null text is empty and has the end mark only. Repeated rows are scored one by one (and all
count in training). Without training rows all counts are zero and every class has the same probability, so that scores stay
finite. An empty table gives an empty result. A very long text is tokenised and scored as one group. Words of equal count have a fixed order. Columns beside id
and text are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lendframe.llm.common import slices, stored, utf8
from lendframe.llm.training import sum_vectors

#: Bound of what tasks hold: the commonest words and their counts.
HEAD = 1 << 16
CLASSES, SINGLE = 64, 27  # classes; commonest words with a class of their own
WORD_ROWS, OWN_ROWS, PAIR_ROWS = 2048, 1536, 4096
ROWS = 2 * WORD_ROWS + PAIR_ROWS
BLOCKS_OF_ROWS = ((0, WORD_ROWS), (WORD_ROWS, 2 * WORD_ROWS), (2 * WORD_ROWS, ROWS))
STEP = 1 << 14  # tokens scored together
ROUNDS, SHARE, DAMP, SMOOTH = 6, 0.6, 0.4, 20.0
CONTEXTS = WORD_ROWS * WORD_ROWS
PARTS = 6  # of the context table, whose size is bounded
FLUSH = 200_000  # words counted in a task before their counts are sent on
LN10 = math.log(10)


def shape_class(word: bytes) -> int:
    """Class of a word that has no class of its own."""
    last = word[-1]
    if 97 <= last <= 122 or last >= 128:
        return SINGLE + 1 + zlib.crc32(word[-2:]) % 16
    if 48 <= last <= 57:
        return SINGLE + 17
    core = word.rstrip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    if not core:
        return SINGLE + 18
    if last in b".,":
        return SINGLE + 19 + (6 if last == 44 else 0) + zlib.crc32(core[-2:]) % 6
    return SINGLE + 31 + last % 5


def _count(docs: DataFrame) -> DataFrame:
    """``w, n, n_all, k``: occurrences of each word in training texts and in all texts, and its shape class."""
    def run(batches):
        train, rest = Counter(), Counter()

        def out():
            words = list(train.keys() | rest.keys())
            n = [train[w] for w in words]
            r = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(
                [a + rest[w] for a, w in zip(n, words, strict=True)], pa.int64())], names=["w", "n", "n_all"])
            train.clear()
            rest.clear()
            return r
        for b in batches:
            for start, k in slices(b.column(0)):
                for t, held in zip(utf8(b.column(0).slice(start, k)), b.column(1).slice(start, k).to_pylist(), strict=True):
                    (rest if held else train).update(t.lower().split())
                    if len(train) + len(rest) > FLUSH:
                        yield out()
        if train or rest:
            yield out()
    parts = docs.select("t", "held").mapInArrow(run, "w binary, n bigint, n_all bigint")
    total = parts.groupBy("w").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"))

    def classed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([shape_class(w) for w in b.column(0).to_pylist()], pa.int32())],
                names=["w", "n", "n_all", "k"])
    return stored(total.mapInArrow(classed, "w binary, n bigint, n_all bigint, k int"), "word_counts")


class Weights:
    """The class factor."""

    bias: np.ndarray
    weight: np.ndarray

    def logits(self, context: np.ndarray) -> np.ndarray:
        """Class scores of contexts (row of the previous word times WORD_ROWS, plus the row before it)."""
        w, rows = self.weight, feature_rows(context)
        return w[rows[0]] + w[rows[1]] + w[rows[2]] + self.bias

    def class_log10(self, kind: np.ndarray, context: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """log10 of each token's class probability; ``norms`` remembers the log sums of contexts (NaN: not known)."""
        new = np.unique(context[np.isnan(norms[context])])
        for lo in range(0, len(new), STEP):
            z = self.logits(new[lo:lo + STEP])
            top = z.max(axis=1)
            norms[new[lo:lo + STEP]] = top + np.log(np.exp(z - top[:, None]).sum(axis=1))
        w = self.weight
        own = self.bias[kind] + sum(w[r, kind] for r in feature_rows(context))
        return (own - norms[context]).astype(np.float64) / LN10

    def expected(self, context: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected occurrences of (feature row, class) in contexts that occur n times."""
        g = np.zeros((CLASSES, ROWS))
        for lo in range(0, len(context), STEP):
            c = context[lo:lo + STEP]
            z = self.logits(c)
            z = np.exp(z - z.max(axis=1)[:, None])
            d = (z * (n[lo:lo + STEP] / z.sum(axis=1))[:, None]).T.astype(np.float64)
            for r, (a, b) in zip(feature_rows(c), BLOCKS_OF_ROWS, strict=True):
                for k in range(CLASSES):
                    g[k, a:b] += np.bincount(r - a, d[k], b - a)
        return g.T.ravel()


class Model(Weights):
    """What tasks need: the head words, class sums, and the weights of the class factor."""

    def __init__(self, words: list[bytes], n: np.ndarray, kinds: np.ndarray, ends: int, class_n, class_v, total: int,
                 distinct: int):
        self.index = {w: i for i, w in enumerate(words)}
        m = len(words)
        self.m, self.total, self.distinct = m, total, distinct
        # the last two numbers stand for the end mark and for words outside the head
        self.kind = np.concatenate((kinds, [0, 0])).astype(np.int32)
        self.kind[:min(SINGLE, m)] = np.arange(1, min(SINGLE, m) + 1)
        count = np.concatenate((n, [ends, 0]))
        self.known = np.concatenate((n > 0, [ends > 0, False]))
        self.base = np.log10((count + 0.5) / (total + 0.5 * (distinct + 1)))
        self.base[-1] = 0.0
        self.class_n, self.class_v = class_n, class_v
        self.within = np.log10((count + 0.5) / (class_n[self.kind] + 0.5 * (class_v[self.kind] + 1)))
        self.within[:min(SINGLE, m)] = 0.0
        self.within[-2:] = 0.0
        row = np.array([i if i < OWN_ROWS else hashed_row(w) for i, w in enumerate(words)] + [WORD_ROWS - 2, 0], np.int64)
        self.row = row
        self.bias = np.zeros(CLASSES, np.float32)
        self.weight = np.zeros((ROWS, CLASSES), np.float32)

    def read(self, texts: list[bytes]):
        """Tokens end to end: number, class, context; the size of each document; and the words outside the head."""
        get, m = self.index.get, self.m
        flat: list[bytes | None] = []
        size: list[int] = []
        for t in texts:
            w = t.lower().split()
            flat += w
            flat.append(None)  # the end mark
            size.append(len(w) + 1)
        code = np.array([get(w, m + 1) for w in flat], np.int64)
        code[np.cumsum(size) - 1] = m
        kind, row = self.kind[code], self.row[code]
        at = np.flatnonzero(code > m)
        outside = [(i, flat[i]) for i in at.tolist()]
        kind[at] = [shape_class(w) for _, w in outside]
        row[at] = [hashed_row(w) for _, w in outside]
        first = np.cumsum([0, *size])[:-1]
        one = np.concatenate(([0], row[:-1]))
        two = np.concatenate(([0, 0], row[:-2]))[:len(row)]
        start = WORD_ROWS - 1
        one[first] = start
        two[first] = start
        second = first + 1
        two[second[second < len(two)]] = start
        return code, kind, one * WORD_ROWS + two, np.array(size), outside


def feature_rows(context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    one, two = context // WORD_ROWS, context % WORD_ROWS
    return one, WORD_ROWS + two, 2 * WORD_ROWS + (one * 2654435761 + two * 40503) % PAIR_ROWS


def hashed_row(word: bytes) -> int:
    return OWN_ROWS + zlib.crc32(word) % (WORD_ROWS - OWN_ROWS - 2)


def _gathered(train: DataFrame, held) -> DataFrame:
    """``key, n``: a context and how often it occurs, or -1 - x where x numbers a (feature row, class) and its occurrences.

    Counted in the tasks first; at most CONTEXTS + ROWS * CLASSES keys in all.
    """
    def run(batches):
        model, counts, seen = held.value, np.zeros(CONTEXTS, np.int32), np.zeros(ROWS * CLASSES)

        def out(key, n):
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "n"])
        for b in batches:
            for start, k in slices(b.column(0)):
                _, kind, context, _, _ = model.read(utf8(b.column(0).slice(start, k)))
                seen += sum(np.bincount(r * CLASSES + kind, minlength=ROWS * CLASSES) for r in feature_rows(context))
                key, n = np.unique(context, return_counts=True)
                counts[key] += n.astype(np.int32)
        found = np.flatnonzero(counts)
        if len(found):
            yield out(found, counts[found])
            x = np.flatnonzero(seen)
            yield out(-1 - x, seen[x])
    c = train.select("t").mapInArrow(run, "key int, n bigint")
    return stored(c.groupBy("key").agg(F.sum("n").alias("n")).repartition(PARTS, "key"), "contexts")


def _table_sum(table: DataFrame, fn) -> np.ndarray:
    """Sum over the gathered table of a (ROWS x CLASSES) table that ``fn(key, n)`` gives."""
    def run(batches):
        total = np.zeros(ROWS * CLASSES)
        for b in batches:
            if b.num_rows:
                total += fn(*(b.column(i).to_numpy().astype(np.int64) for i in range(2)))
        return total
    return sum_vectors(table.coalesce(PARTS), run).reshape(ROWS, CLASSES)


def _observed(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(-1 - key, n, ROWS * CLASSES)


def _head(counts: DataFrame) -> pa.Table:
    """The commonest words, HEAD at most: all those whose count is in the highest classes of counts that fit together."""
    level = F.floor(F.log2("n_all") * 16).cast("int")
    sizes = dict(counts.groupBy(level.alias("level")).count().collect())  # at most 16 per power of two
    cut, held = None, 0
    for k in sorted(sizes, reverse=True):
        held += sizes[k]
        if held > HEAD:
            break
        cut = k
    rows = counts.filter(level >= cut) if cut is not None else counts.limit(0)
    return rows.select("w", "n", "n_all", "k").toArrow().sort_by([("n_all", "descending"), ("w", "ascending")])


def fit(rows: DataFrame) -> tuple[Model, DataFrame]:
    """Model and word counts from ``t`` and ``held`` (true: not for training)."""
    counts = _count(rows)
    ends = rows.filter("not held").count()
    sums = {r.k: r for r in counts.groupBy("k").agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v")).collect()}
    total = sum(r.n for r in sums.values()) + ends
    distinct = sum(r.v for r in sums.values()) + (ends > 0)
    head = _head(counts)
    words, n, kinds = (head.column(c).to_pylist() if c == "w" else head.column(c).to_numpy() for c in ("w", "n", "k"))
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, r in sums.items():
        class_n[k], class_v[k] = r.n, r.v
    single = slice(0, SINGLE)  # these have left their shape classes
    class_n -= np.bincount(kinds[single], n[single], CLASSES)
    class_v -= np.bincount(kinds[single], n[single] > 0, CLASSES)
    model = Model(words, n, kinds, ends, class_n, class_v, total, distinct)
    if not ends:
        return model, counts
    train = rows.filter("not held")
    sc = rows.sparkSession.sparkContext

    held = sc.broadcast(model)
    gathered = _gathered(train, held)
    held.destroy()
    seen = _table_sum(gathered.filter("key < 0"), _observed)
    contexts = gathered.filter("key >= 0")
    by_class = seen[:WORD_ROWS].sum(axis=0)
    p = (by_class + 0.5) / (by_class.sum() + 0.5 * CLASSES)
    row_n = seen.sum(axis=1, keepdims=True)
    model.bias = np.log(p).astype(np.float32)
    model.weight = (SHARE * np.log((seen + SMOOTH * p) / (row_n + SMOOTH) / p)).astype(np.float32)
    curve = row_n * p * (1 - p) + SMOOTH
    for _ in range(ROUNDS):
        held = sc.broadcast((model.weight, model.bias))

        def local(context, n, held=held):
            m = Weights()
            m.weight, m.bias = held.value
            return m.expected(context, n)
        g = seen - _table_sum(contexts, local)
        held.destroy()
        model.weight = (model.weight + np.clip(DAMP * g / curve, -1, 1)).astype(np.float32)
    return model, counts


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), held_out.alias("held"))
    model, counts = fit(rows)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        mod, part, n_row = sent.value, TaskContext.get().partitionId(), 0
        norms = np.full(CONTEXTS, np.nan, np.float32)
        for b in batches:
            for start, k in slices(b.column(1)):  # one group of texts at a time, sent on before the next is read
                code, kind, context, size, outside = mod.read(utf8(b.column(1).slice(start, k)))
                at = np.cumsum(size) - size
                total = np.add.reduceat(mod.class_log10(kind, context, norms) + mod.within[code], at)
                # words outside the head: counted per document and word
                words = pa.array([w for _, w in outside], pa.binary()).dictionary_encode()
                doc = np.searchsorted(at, np.array([i for i, _ in outside], np.int64), "right") - 1
                m = max(1, len(words.dictionary))
                pair, tf = np.unique(doc * m + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
                entry = pa.StructArray.from_arrays([words.dictionary.take(pa.array(pair % m)), pa.array(tf, pa.int32())], names=["w", "tf"])
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair // m, np.arange(k + 1)), pa.int32()), entry)
                uid = (np.int64(part) << 40) + np.arange(n_row, n_row + k)
                n_row += k
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(start, k), b.column(2).slice(start, k), pa.array(uid), pa.array(size),
                     pa.array(np.add.reduceat(mod.known[code].astype(np.int64), at)), pa.array(np.add.reduceat(mod.base[code], at)),
                     pa.array(total), tail], names=["id", "held", "uid", "n_tokens", "n_known", "base", "total", "tail"])
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, held boolean, uid bigint, n_tokens bigint, n_known bigint, "
              "base double, total double, tail array<struct<w:binary,tf:int>>")
    part = stored(rows.select("id", "t", "held").mapInArrow(run, schema), "partial_scores")
    sent.destroy()

    # words outside the head, with their counts; the denominators are one number per class
    denominator = F.element_at(F.array(*[F.lit(float(a + 0.5 * (b + 1))) for a, b in zip(model.class_n, model.class_v, strict=True)]),
                               F.col("k") + 1)
    c = F.col("n") + 0.5
    tail = part.select("uid", F.explode("tail").alias("x")).select("uid", "x.w", "x.tf").join(
        counts.select("w", "n", "k").hint("merge"), "w")
    extra = tail.groupBy("uid").agg(
        F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more_known"),
        F.sum(F.col("tf") * F.log10(c / F.lit(model.total + 0.5 * (model.distinct + 1)))).alias("more_base"),
        F.sum(F.col("tf") * F.log10(c / denominator)).alias("more_total"))
    return part.drop("tail").join(extra, "uid", "left").select(
        F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("total") + F.coalesce("more_total", F.lit(0.0))).alias("score"))
