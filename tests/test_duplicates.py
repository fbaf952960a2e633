"""Fuzzy leaders and neighbours against brute force, with hot cells and copies."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lendframe.operators import duplicates as dup
from lendframe.operators import knn


def lev(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def sim(r, s, kinds):
    tot = acc = 0.0
    for a, b, k in zip(r, s, kinds):
        w = 1.0 if k == "n" else 0.8
        tot += w
        if a is None and b is None:
            v = 1.0
        elif a is None or b is None:
            v = 0.0
        elif a == b:
            v = 1.0
        elif k == "n":
            v = max(0.0, 1 - abs(a - b) / max(abs(a), abs(b)))
        else:
            v = 1 - lev(a.lower(), b.lower()) / max(len(a), len(b), 1)
        acc += v * w
    return acc / tot


def brute(rows, kinds, t):
    leaders, out = [], {}
    for r in sorted(rows):
        for q in leaders:
            if sim(r[1:], q[1:], kinds) >= t:
                out[r[0]] = q[0]
                break
        else:
            leaders.append(r)
            out[r[0]] = r[0]
    return out


def make(n, seed):
    rnd = random.Random(seed)
    names = ["Anna Schmidt", "Anna Schmitt", "Bob Jones", "Rob Jones", "Carla Diaz"]
    rows = []
    for i in range(n):
        hot = rnd.random() < 0.4  # a third or more of the rows in one place
        a = round(rnd.uniform(100, 108), 1) if hot else round(rnd.uniform(-50, 900), 1)
        b = round(rnd.uniform(10, 11), 2) if hot else round(rnd.uniform(0, 60), 1)
        rows.append((i, None if rnd.random() < 0.03 else a, 0.0 if rnd.random() < 0.03 else b, rnd.choice(names)))
    return rows + [(n + i, *rows[i][1:]) for i in range(0, n, 9)]


def test_fuzzy_leaders_match_greedy_order(spark, monkeypatch):
    monkeypatch.setattr(dup, "CELL_ROWS", 16)  # forces slices of the hot cell
    for seed, t in ((1, 0.9), (2, 0.95)):
        rows = make(220, seed)
        df = spark.createDataFrame(rows, "id bigint, a double, b double, name string")
        got = {r["id"]: r["leader"] for r in dup.fuzzy_leaders(df, "id", ["a", "b", "name"], t, grid=["a", "b"], pivots=4).collect()}
        want = brute([r for r in rows], "nnt", t)
        # copies share the leader of their first row
        assert got == want


def test_fuzzy_over_many_columns(spark):
    """One column's weight is less than what a pair may lose: several grids find the same groups."""
    rnd = random.Random(5)
    rows = []
    for i in range(90):
        base = rnd.choice(rows)[1:] if rows and rnd.random() < 0.7 else [
            *(round(rnd.uniform(1, 900), 1) for _ in range(8)), *(rnd.choice(["red", "blue", "pale green"]) for _ in range(6))]
        row = list(base)
        for _ in range(rnd.randrange(3)):
            j = rnd.randrange(14)
            row[j] = None if rnd.random() < 0.2 else (round(rnd.uniform(1, 900), 1) if j < 8 else rnd.choice(["red", "blue", "x"]))
        rows.append((i, *row))
    cols = [f"c{j}" for j in range(14)]
    df = spark.createDataFrame(rows, "id bigint, " + ", ".join(f"c{j} {'double' if j < 8 else 'string'}" for j in range(14)))
    got = {r["id"]: r["leader"] for r in dup.fuzzy_leaders(df, "id", cols, 0.9, pivots=3).collect()}
    assert got == brute(rows, "n" * 8 + "t" * 6, 0.9)
    assert len(set(got.values())) < 90


def test_fuzzy_goes_on_until_settled(spark):
    """More rounds than any limit of old: one cell, one pivot, all rows unlike."""
    names = ["".join(random.Random(i).choices("abcdefgh", k=12)) for i in range(25)]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    got = {r["id"]: r["leader"] for r in dup.fuzzy_leaders(df, "id", ["name"], 0.95, pivots=1).collect()}
    assert got == {i: i for i in range(25)}
    assert dup.fuzzy_leaders(df.limit(0), "id", ["name"], 0.95).count() == 0



def brute_texts(rows, t, q):
    def cut(x):
        w = x.lower().split()
        return frozenset(tuple(w[i:i + q]) for i in range(len(w) - q + 1)) if len(w) >= q else frozenset([tuple(w)] if w else [])
    sets = {i: None if x is None else cut(x) for i, x in rows}

    def similar(a, b):
        if a is None or b is None or not a or not b:
            return a == b
        return len(a & b) >= t * len(a | b) - 1e-9
    leaders, out = [], {}
    for i in sorted(sets):
        out[i] = next((j for j in leaders if similar(sets[i], sets[j])), i)
        if out[i] == i:
            leaders.append(i)
    return out


def test_text_leaders_match_greedy_order(spark, monkeypatch):
    """A hot cluster, a passage in a third of the texts, copies, nulls, empty and one-word texts, few pivots, known and unknown frequencies."""
    monkeypatch.setattr(dup, "CELL_ROWS", 16)
    rnd = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(12))
    hot = [f"h{i}" for i in range(40)]
    rows = []
    for i in range(160):
        if rnd.random() < 0.4:
            w = list(hot)
            for _ in range(rnd.randrange(4)):
                w[rnd.randrange(40)] = f"x{rnd.randrange(9)}"
        else:
            w = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([1, 2, 5, 30, 60]))] + ([passage] if rnd.random() < 0.5 else [])
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[i][1].upper()) for i in range(0, 160, 7)] + [(400, None), (401, None), (402, ""), (403, "  "), (404, "one"), (405, "One")]
    df = spark.createDataFrame(rows, "id bigint, body string")
    for t, q, frequent in ((0.9, 2, 1 << 16), (0.7, 1, 20), (0.9, 1, 0)):
        monkeypatch.setattr(dup, "FREQUENT", frequent)
        got = {r["id"]: r["leader"] for r in dup.text_leaders(df, "id", "body", t, q=q, pivots=2).collect()}
        assert got == brute_texts(rows, t, q)
        assert len(set(got.values())) < len(got) - 40
    assert dup.text_leaders(df.limit(0), "id", "body").count() == 0


def test_followers_are_not_paired(spark):
    """A hot cell of similar rows: a round lists pairs inside its batch and with leaders, not every row with every pivot."""
    listed = []

    def verify(pairs):
        listed.append(pairs.count())
        return pairs
    rows = spark.range(300).select("id", F.struct("id").alias("v"))
    cell = F.array(F.struct(F.lit(1).cast("bigint").alias("cell"), F.lit(0).alias("pos")))
    got = dup.greedy_leaders(rows, cell, cell, F.lit(True), verify, pivots=4)
    assert {r["leader"] for r in got.collect()} == {0}
    assert sum(listed) == 4 * 3 // 2 + 296


def test_bucket_counts_keep_similar_sets():
    rnd = np.random.default_rng(4)
    kept = {}
    for n, spare in ((5, 1), (300, 10), (300, 200), (9000, 300), (9000, 8000)):
        a = rnd.integers(-2**62, 2**62, n)
        b = np.concatenate([a[spare:], rnd.integers(-2**62, 2**62, spare // 2)])
        shared = len(np.intersect1d(a, b))
        row = [pa.array([1]), pa.array([2]), pa.array([len(a)]), pa.array([len(b)]), pa.array([dup._bucket_counts(a)]), pa.array([dup._bucket_counts(b)])]
        out = next(dup._close_counts([pa.RecordBatch.from_arrays(row, names=["id", "pid", "na", "nb", "a", "b"])], 0.9)).num_rows
        assert out or shared < 0.9 * (len(a) + len(b) - shared)
        kept[n, spare] = out
    assert not kept[300, 200] and not kept[9000, 8000]
    # hash values that share a bucket: its count is capped, and nothing is refuted by it
    a, b = np.arange(4000) << 20, np.arange(4100) << 20
    row = [pa.array([1]), pa.array([2]), pa.array([4000]), pa.array([4100]), pa.array([dup._bucket_counts(a)]), pa.array([dup._bucket_counts(b)])]
    assert next(dup._close_counts([pa.RecordBatch.from_arrays(row, names=["id", "pid", "na", "nb", "a", "b"])], 0.9)).num_rows == 1


def test_hot_cells_are_sliced(spark, monkeypatch):
    """No cell of a comparison has more rows than a slice may have by much, though one cell has all rows."""
    monkeypatch.setattr(dup, "CELL_ROWS", 50)
    rows = spark.range(2000).select("id", F.lit(7).cast("bigint").alias("cell"))
    offers = spark.range(3).select(F.col("id").alias("pid"), F.lit(7).cast("bigint").alias("cell"))
    met = dup._meet(rows, offers)
    assert met.count() == 6000
    assert met.groupBy("_slice").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0] < 100


def test_no_cross_join_in_pair_step(spark):
    rows = spark.createDataFrame([(1, 5), (2, 5)], "id bigint, cell bigint")
    offers = rows.select(F.col("id").alias("pid"), "cell")
    plan = dup._meet(rows, offers)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_keep_last_best_and_examples(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "y"), (4, None, "z"), (5, None, "w")], "id bigint, k string, v string")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(dup.drop_duplicates(df, "id", ["k"])) == [1, 3, 4]
    assert ids(dup.drop_duplicates(df, "id", ["k"], "last")) == [2, 3, 5]
    assert ids(dup.keep_best(df, "id", ["k"])) == [2, 3, 5]
    s = dup.summary(df, "id", ["k"]).first()
    assert (s["total"], s["members"], s["surplus"], s["groups"]) == (5, 4, 2, 2)
    assert [r["example"] for r in dup.examples(df, "id", ["k"], 1).collect()] == [1, 1]


def test_knn_matches_brute_force_with_copies(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_POINTS", 20)
    rnd = random.Random(5)
    rows = [(i, 3.0, 4.0, 1.0) if rnd.random() < 0.35 else (i, round(rnd.uniform(0, 100), 2), round(rnd.uniform(0, 100), 2),
            None if rnd.random() < 0.2 else round(rnd.uniform(0, 9), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double")

    def dist(r, s):
        pairs = [(x, y) for x, y in zip(r[1:], s[1:]) if x is not None and y is not None]
        return math.sqrt(3 * sum((x - y) ** 2 for x, y in pairs) / len(pairs))

    got = {}
    for r in knn.knn_join(df, df, ["a", "b", "c"], 4, exclude_self=True).collect():
        got.setdefault(r["qid"], []).append(round(r["distance"], 9))
    assert len(got) == 400
    for r in rows:
        want = sorted(round(dist(r, s), 9) for s in rows if s[0] != r[0])[:4]
        assert sorted(got[r[0]]) == want
