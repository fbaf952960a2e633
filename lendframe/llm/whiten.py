"""Whitening of embeddings through the exact characteristic polynomial of their integer scatter.

Entries are scaled and rounded down to integers, so that the scatter ``n * sum(x x') - S S'`` of the distinct vectors is an
integer matrix, summed without rounding in the tasks. Its characteristic polynomial is computed exactly: modulo
many primes, one row each of a distributed table, by reduction to Hessenberg form, and put together by Chinese remainders.
All its roots are real, so the sign changes of its coefficients, shifted by ``a``, count exactly the roots above ``a``;
halving brackets with that count isolates the largest roots, ties included, to ``ROOT_BITS`` bits. Components come from inverse iteration on the
nearly singular shifted matrix in fixed-point numbers of ``FIXED_BITS`` bits, each kept at right angles to those before it.

What reaches the driver is bounded by the dimension d, not by the rows: d * d sums, and d + 1 remainders for each of the primes,
whose number is about d * (log2 of the largest variance and of the number of vectors) / 31.

Defined results: rows are dropped whose vector is null or holds null or non-finite entries, and rows whose length is not the commonest
one (of tied lengths the longest). Repeated rows are all returned and count once in the fit. Entries too large for a long are
held at its ends; where variances differ by more than doubles resolve, ``identity_error`` says so. ``deviation`` is null where it does not fit a long. Components without
variance can't be whitened and are left out, so one distinct vector, or none, gives an empty result; equal eigenvalues give some orthonormal basis
of their space. The entry of a component with the largest size (the first of ties) is positive. Null ids stay null. Columns beside id
and vector are not read, whatever their names.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendframe.llm.common import stored, tasks

ROOT_BITS, FIXED_BITS, ITERATIONS = 128, 384, 3
LIMB, LIMBS = 40, 4  # parts in which exact sums are sent
OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``id, x`` of the rows that remain, with entries floor(scale * c)."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * scale))
    rows = stored(df.filter(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), x.alias("x")), "integers")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int], np.ndarray]:
    """Number, sum, and sum of outer products of the vectors, as Python integers."""
    upper = np.triu_indices(d)

    def run(batches):
        n, s, m = 0, np.zeros(d, object), np.zeros((d, d), object)
        for b in batches:
            x = _matrix(b.column(0), d)
            if not len(x):
                continue
            top = max(int(x.max()), -int(x.min()))
            if top * top * len(x) < 1 << 53:  # whole numbers below that are exact in doubles
                f = x.astype(np.float64)
                m = m + (f.T @ f).astype(np.int64).astype(object)
                s = s + f.sum(axis=0).astype(np.int64).astype(object)
            else:
                o = x.astype(object)
                m = m + o.T @ o
                s = s + o.sum(axis=0)
            n += len(x)
        if n:
            values = [n, *s.tolist(), *m[upper].tolist()]
            low = (1 << LIMB) - 1
            parts = [[v >> LIMB * i & low if i + 1 < LIMBS else v >> LIMB * i for v in values] for i in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), *(pa.array(p, pa.int64()) for p in parts)],
                                             names=["k", *(f"p{i}" for i in range(LIMBS))])
    parts = fit.mapInArrow(run, "k int, " + ", ".join(f"p{i} bigint" for i in range(LIMBS)))
    rows = parts.groupBy("k").agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(LIMBS)]).collect()
    got = {r["k"]: sum(r[f"p{i}"] << LIMB * i for i in range(LIMBS)) for r in rows}
    m = np.zeros((d, d), object)
    m[upper] = [got[1 + d + i] for i in range(len(upper[0]))]
    m = m + np.triu(m, 1).T
    return got[0], [got[1 + i] for i in range(d)], m


def primes_below(top: int):
    """Primes in falling order (exact for numbers below 3 474 749 660 383)."""
    for p in range(top - 1 + top % 2, 2, -2):
        r, odd = 0, p - 1
        while odd % 2 == 0:
            r, odd = r + 1, odd // 2

        def passes(a, p=p, r=r, odd=odd):
            y = pow(a, odd, p)
            return y in (1, p - 1) or any((y := y * y % p) == p - 1 for _ in range(r - 1))
        if all(p == a or passes(a) for a in (2, 3, 5, 7, 11, 13)):
            yield p


def polynomial_mod(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients, lowest first, of det(x - a) modulo a prime below 2^31, through the Hessenberg form."""
    h = np.array(a % p, np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks
    poly[0, 0] = 1
    for k in range(1, d + 1):
        c = -h[k - 1, k - 1] * poly[k - 1] % p
        c[1:] += poly[k - 1, :-1]
        t = 1
        for i in range(1, k):
            t = t * int(h[k - i, k - i - 1]) % p
            if not t:
                break
            c -= int(h[k - i - 1, k - 1]) * t % p * poly[k - i - 1] % p
        poly[k] = c % p
    return poly[d]


def characteristic_polynomial(spark, a: np.ndarray) -> list[int]:
    """Exact coefficients, lowest first, of a symmetric integer matrix without negative eigenvalues."""
    d = len(a)
    # a coefficient is a sum of principal minors, each at most the product of its diagonal
    bits = sum(int(a[i, i] + 1).bit_length() for i in range(d)) + 2
    chosen, product = [], 1
    for p in primes_below(1 << 31):
        if product.bit_length() > bits:
            break
        chosen.append(p)
        product *= p

    def run(batches):
        for b in batches:
            p = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([polynomial_mod(a, q).tolist() for q in p], pa.list_(pa.int64()))],
                                             names=["p", "c"])
    table = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(min(len(chosen), tasks(spark)))
    total = [0] * (d + 1)
    for r in table.mapInArrow(run, "p bigint, c array<bigint>").collect():
        rest = product // r["p"]
        one = rest * pow(rest, -1, r["p"])
        total = [t + one * c for t, c in zip(total, r["c"], strict=True)]
    total = [t % product for t in total]
    return [t - product if 2 * t > product else t for t in total]


def roots_above(c: list[int], a: int) -> int:
    """Roots above ``a`` of a polynomial whose roots are all real: sign changes after a shift by ``a``."""
    b = list(c)
    for i in range(len(b) - 1):
        for j in range(len(b) - 2, i - 1, -1):
            b[j] += a * b[j + 1]
    signs = [x > 0 for x in b if x]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def largest_roots(c: list[int], count: int, top: int) -> list[Fraction]:
    """The positive ones of the ``count`` largest roots (ties repeated), to ROOT_BITS bits; none is above ``top``."""
    d, out = len(c) - 1, []
    for j in range(1, min(count, d) + 1):
        if roots_above(c, 0) < j:
            break
        lo, hi, s, scaled = 0, top, 0, c
        while True:
            while hi - lo > 1:  # at least j roots above lo, fewer above hi
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if roots_above(scaled, mid) >= j else (lo, mid)
            more = ROOT_BITS - lo.bit_length()
            if more <= 0 or (lo and s):
                break
            s += more
            scaled = [x << s * (d - k) for k, x in enumerate(c)]
            lo, hi = lo << more, hi << more
        out.append(Fraction(2 * lo + 1, 1 << s + 1))
    return out


class Shifted:
    """Fixed-point elimination of ``a - root``, scaled by ``unit``."""

    def __init__(self, a: np.ndarray, root: Fraction, unit: int):
        one = 1 << FIXED_BITS
        d = len(a)
        m = np.array([[x * one // unit for x in row] for row in a.tolist()], object)
        shift = root.numerator * one // (root.denominator * unit)
        for i in range(d):
            m[i, i] -= shift
        self.order, self.factors = [], []
        for k in range(d):
            i = max(range(k, d), key=lambda r: abs(m[r, k]))
            if i != k:
                m[[i, k]] = m[[k, i]]
            if not m[k, k]:
                m[k, k] = 1  # singular to the last bit
            f = (m[k + 1:, k] << FIXED_BITS) // m[k, k]
            m[k + 1:, k:] -= (f[:, None] * m[k, k:]) >> FIXED_BITS
            self.order.append(i)
            self.factors.append(f)
        self.m = m

    def solve(self, b: np.ndarray) -> np.ndarray:
        b, m, d = b.copy(), self.m, len(b)
        for k, (i, f) in enumerate(zip(self.order, self.factors, strict=True)):
            b[k], b[i] = b[i], b[k]
            b[k + 1:] -= (f * b[k]) >> FIXED_BITS
        for k in range(d - 1, -1, -1):
            b[k] = ((b[k] - (int((m[k, k + 1:] * b[k + 1:]).sum() if k + 1 < d else 0) >> FIXED_BITS)) << FIXED_BITS) // m[k, k]
        return b


def _unit(v: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Fixed-point vector of length one at right angles to the earlier ones."""
    for _ in range(2):
        v = (v << FIXED_BITS) // math.isqrt(int((v * v).sum()))
        for u in before:
            v = v - ((int((u * v).sum()) >> FIXED_BITS) * u >> FIXED_BITS)
    return (v << FIXED_BITS) // math.isqrt(int((v * v).sum()))


def eigenvectors(a: np.ndarray, roots: list[Fraction]) -> np.ndarray:
    """Unit vectors, one a row, by inverse iteration."""
    d, unit = len(a), max(1, int(sum(a[i, i] for i in range(len(a)))))
    rng = np.random.default_rng(0)
    found: list[np.ndarray] = []
    for root in roots:
        solver = Shifted(a, root, unit)
        v = np.array([int(x) << FIXED_BITS - 32 for x in rng.integers(-1 << 31, 1 << 31, d)], object)
        for _ in range(ITERATIONS):
            v = _unit(solver.solve(_unit(v, found)), found)
        found.append(v)
    out = np.array([[x / (1 << FIXED_BITS) for x in v.tolist()] for v in found], np.float64)
    for v in out:
        v *= np.sign(v[np.abs(v).argmax()])
    return out


class Projection:
    """Components, eigenvalues of the scatter, and the centre (as sums)."""

    def __init__(self, n: int, sums: list[int], vectors: np.ndarray, roots: list[Fraction], trace: int):
        self.n, self.sums, self.vectors = n, sums, vectors
        self.top = max(map(abs, sums))
        self.scale = np.array([1 / math.sqrt(r) for r in roots])
        self.explained = [float(r / trace) for r in roots]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        top = max(int(x.max()), -int(x.min())) * self.n + self.top if len(x) else 0
        if top < 1 << 62:
            return x * np.int64(self.n) - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        # the scatter's eigenvalues are n * n times those of the covariance, and n * n times the squares cancels
        return (centred.astype(np.float64) @ self.vectors.T) * self.scale

    def deviation(self, centred: np.ndarray) -> list[int | None]:
        top = max(int(centred.max()), -int(centred.min())) if centred.size else 0
        if top * top * centred.shape[1] < 1 << 63:
            return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [x if x < 1 << 63 else None for x in (centred.astype(object) ** 2).sum(axis=1).tolist()]


def _float_sums(fit: DataFrame, fn, size: int) -> np.ndarray:
    """Sum over all rows of the ``size`` numbers that ``fn`` gives for an Arrow column of vectors."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += fn(b.column(0)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["k", "v"])
    out = np.zeros(size)
    for r in fit.mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def identity_error(fit: DataFrame, proj: Projection) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    m, d = len(proj.vectors), len(proj.sums)

    def values(col):
        return proj.whitened(proj.centred(_matrix(col, d)))
    mean = _float_sums(fit, lambda c: values(c).sum(axis=0), m) / proj.n

    def products(col):
        w = values(col) - mean
        return w.T @ w
    cov = _float_sums(fit, products, m * m).reshape(m, m) / proj.n
    return float(np.abs(cov - np.eye(m)).max())


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error`` of every remaining row and component."""
    spark = df.sparkSession
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, {OUT}"
    rows = integer_vectors(df, id_col, vector_col, scale)
    first = rows.select(F.size("x").alias("d")).first()
    if first is None or not first["d"]:
        return spark.createDataFrame([], schema)
    d = first["d"]
    fit = stored(rows.select("x").distinct(), "fit")
    n, sums, products = _exact_sums(fit, d)
    scatter = n * products - np.outer(np.array(sums, object), np.array(sums, object))
    trace = int(sum(scatter[i, i] for i in range(d)))
    if not trace:
        return spark.createDataFrame([], schema)
    roots = largest_roots(characteristic_polynomial(spark, scatter), components, trace + 1)
    proj = Projection(n, sums, eigenvectors(scatter, roots), roots, trace)
    error, m = identity_error(fit, proj), len(roots)

    def run(batches):
        for b in batches:
            k = b.num_rows
            c = proj.centred(_matrix(b.column(1), d))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(k), m))), pa.array(np.tile(np.arange(1, m + 1), k), pa.int32()),
                 pa.array([n] * (k * m), pa.int64()), pa.array([x for x in proj.deviation(c) for _ in range(m)], pa.int64()),
                 pa.array(proj.whitened(c).ravel()), pa.array(proj.explained * k, pa.float64()), pa.array([error] * (k * m), pa.float64())],
                names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select("id", "x").mapInArrow(run, schema)
