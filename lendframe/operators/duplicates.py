"""Exact and fuzzy duplicates.

Copies of one record may be a third of the table, so nothing here gathers a
group in one task or lists its pairs: exact operators aggregate by a row hash
(combined before the shuffle), and fuzzy grouping compares rows only with a
bounded number of leading rows of their neighbourhood per round.
"""

import functools
import itertools
import math
from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lendframe.operators.stats import distinct_counts, long_cells
from lendframe.session import saved

#: Rows of one grid cell that one task compares.
CELL_ROWS = 4096
# Column weights by kind.
WEIGHTS = {"numeric": 1.0, "text": 0.8, "date": 1.2, "other": 1.0}


def row_key(columns: list[str]) -> Column:
    """128-bit hash of the key values; nulls equal nulls."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in columns])))


def duplicate_groups(df: DataFrame, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """One row per group with more than one member: ``group_id, members, first_id``."""
    keys = keys or [c for c in df.columns if c != id_col]
    return df.groupBy(row_key(keys).alias("group_id")).agg(
        F.count(F.lit(1)).alias("members"), F.min(id_col).alias("first_id")).where("members > 1")


def duplicate_members(df: DataFrame, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """Every row of every duplicate group with its group. A hot group only widens the probe side of the join."""
    keys = keys or [c for c in df.columns if c != id_col]
    g = duplicate_groups(df, id_col, keys)
    return df.withColumn("group_id", row_key(keys)).join(g, "group_id")


def summary(df: DataFrame, id_col: str, keys: list[str] | None = None) -> DataFrame:
    """Rows, group members, surplus rows, groups and the member share in percent."""
    keys = keys or [c for c in df.columns if c != id_col]
    g = df.groupBy(row_key(keys).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").alias("total"),
                 F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("members"),
                 F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
                 F.count_if(F.col("n") > 1).alias("groups")).withColumn(
        "pct", F.round(F.col("members") * 100.0 / F.col("total"), 4)).withColumn(
        "columns_checked", F.lit(len(keys)))


def drop_duplicates(df: DataFrame, id_col: str, keys: list[str] | None = None, keep: str = "first") -> DataFrame:
    """Keep the first or last row of each group by id; the survivor is chosen in the aggregate's map side too."""
    keys = keys or [c for c in df.columns if c != id_col]
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.min_by(row, F.col(id_col)) if keep == "first" else F.max_by(row, F.col(id_col))
    return df.groupBy(row_key(keys).alias("_k")).agg(pick.alias("_r")).select("_r.*")


def record_score(df: DataFrame, id_col: str, date_col: str | None, max_id: int) -> Column:
    """0.5 x completeness, 0.3 for a date, 0.2 x id / largest id."""
    filled = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    s = filled / F.lit(float(len(df.columns))) * 0.5
    if date_col:
        s = s + F.when(F.col(date_col).isNotNull(), 0.3).otherwise(0.0)
    if max_id and max_id > 0:
        s = s + F.coalesce(F.col(id_col) / F.lit(float(max_id)) * 0.2, F.lit(0.0))
    return s


def keep_best(df: DataFrame, id_col: str, keys: list[str], date_col: str | None = None) -> DataFrame:
    """The best-scored row of each group; equal scores keep the smaller id."""
    max_id = df.agg(F.max(id_col)).first()[0]
    row = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(record_score(df, id_col, date_col, max_id).alias("s"), (-F.col(id_col)).alias("i"))
    return df.groupBy(row_key(keys).alias("_k")).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


def group_size_histogram(df: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    return duplicate_groups(df, id_col, keys).groupBy("members").agg(F.count(F.lit(1)).alias("groups"))


def field_agreement(df: DataFrame, id_col: str, keys: list[str], columns: list[str], top: int = 5) -> DataFrame:
    """Pairs inside duplicate groups that agree per field, most first.

    Pairs are counted as n(n-1)/2 per (group, field, value), never listed.
    """
    m = duplicate_members(df, id_col, keys)
    cells = m.select("group_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("e")
    ).select("group_id", "e.*").where("value is not null")
    n = cells.groupBy("group_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("field").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("bigint").alias("pairs")).where(
        "pairs > 0").orderBy(F.desc("pairs"), "field").limit(top)


def examples(df: DataFrame, id_col: str, keys: list[str], n: int = 5) -> DataFrame:
    """Members of the ``n`` groups with the smallest first id, numbered from 1."""
    g = duplicate_groups(df, id_col, keys).orderBy("first_id", "group_id").limit(n)
    w = Window.orderBy("first_id", "group_id")  # n rows
    g = g.withColumn("example", F.row_number().over(w)).select("group_id", "example")
    return df.withColumn("group_id", row_key(keys)).join(g, "group_id").orderBy("example", id_col)


# --- similarity ---------------------------------------------------------------------------------

def kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, T.StringType):
        return "text"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def column_similarity(a: Column, b: Column, k: str) -> Column:
    """1 for equal values or two nulls, 0 for one null; numbers by relative difference; text by edit distance."""
    if k == "numeric":
        x, y = a.cast("double"), b.cast("double")
        s = F.when(x == y, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))))
    else:
        x, y = F.lower(a.cast("string")), F.lower(b.cast("string"))
        s = F.when(x == y, 1.0).otherwise(
            1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)).cast("double"))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(s)


def row_similarity(types: dict[str, T.DataType], columns: list[str], left: str, right: str,
                   weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the column similarities of two aliased rows."""
    w = {**WEIGHTS, **(weights or {})}
    total, s = 0.0, F.lit(0.0)
    for c in columns:
        k = kind(types[c])
        total += w[k]
        s = s + column_similarity(F.col(f"{left}.{c}"), F.col(f"{right}.{c}"), k) * w[k]
    return s / total


def sequence_ratio(pairs: DataFrame, left: str, right: str, out: str = "ratio") -> DataFrame:
    """Ratcliff-Obershelp ratio of two text columns of given candidate pairs (Arrow batches)."""
    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else SequenceMatcher(None, x.lower(), y.lower()).ratio()
                          for x, y in zip(a, b)], dtype="float64")

    return pairs.withColumn(out, ratio(F.col(left), F.col(right)))


# --- greedy leaders -----------------------------------------------------------------------------

def greedy_leaders(rows: DataFrame, cells: Column, offered: Column, similar: Column,
                   verify: Callable[[DataFrame], DataFrame] | None = None, pivots: int = 32) -> DataFrame:
    """``(id, leader)``, exact: by rising id, a row joins the smallest leader similar to it, else becomes a leader itself.

    ``rows``, a stored table, has ``id``, ``v`` and what the expressions read. ``cells`` and ``offered`` are arrays of ``(cell, pos)``: where a row is, and where rows
    similar to it can be. ``similar`` is a condition on ``v, pos`` and ``pv, ppos`` of two rows that meet in a cell; ``verify`` may
    then filter pairs ``(id, pid)`` once more.

    A round takes the undecided rows below some id, as many as leave at most ``pivots`` of them in any cell, and four times as many a cell in the next round. Only rows
    of that batch are compared with each other; the larger rows then meet the batch's leaders alone, and those similar to one are settled. All leaders of earlier rounds have
    smaller ids and are unlike every row that is left, so the smallest leader found in the round that settles a row is the smallest of all.
    Pairs of two rows that both follow a leader are thus mostly never met, and a hot cell of m rows costs m x pivots comparisons a round, never m x m.
    """
    def placed(part: DataFrame) -> DataFrame:
        return part.select("id", "v", F.explode(cells).alias("c")).select("id", "v", "c.cell", "c.pos")

    def offers(part: DataFrame) -> DataFrame:
        o = part.select(F.col("id").alias("pid"), F.col("v").alias("pv"), F.explode(offered).alias("c"))
        return o.select("pid", "pv", "c.cell", F.col("c.pos").alias("ppos"))

    def pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
        met = _meet(left, right).where(condition & similar).select("id", "pid").distinct()
        return saved(verify(saved(met, "met")) if verify else met, "hits")
    first = Window.partitionBy("cell").orderBy("id")
    live, found = rows.where((F.size(cells) > 0) & F.col("id").isNotNull()), []  # a row without cells leads itself
    while not live.isEmpty():
        # row_number with a limit keeps only the smallest rows of a cell in every task before the shuffle
        ranked = placed(live).select("id", "cell").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= pivots + 1)
        stop = ranked.where(F.col("_r") == pivots + 1).agg(F.min("id")).first()[0]
        batch = live if stop is None else live.where(F.col("id") < F.lit(stop))
        hits = pairs(placed(batch), offers(batch), F.col("pid") < F.col("id"))
        leaders = _first_leaders(batch.select("id").distinct(), hits)
        found.append(hits.join(leaders.withColumnRenamed("id", "pid"), "pid", "left_semi").select("id", "pid"))
        if stop is None:
            break
        rest = live.where(F.col("id") >= F.lit(stop))
        new = pairs(placed(rest), offers(batch.join(leaders, "id", "left_semi")), F.lit(True))
        found.append(new)
        live = saved(rest.join(new.select("id").distinct(), "id", "left_anti"), "live")
        pivots *= 4
    if not found:
        return rows.select("id", F.col("id").alias("leader"))
    best = functools.reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("pid").alias("pid"))
    return saved(rows.select("id").join(best, "id", "left").select("id", F.coalesce("pid", "id").alias("leader")), "leaders")


def _first_leaders(ids: DataFrame, hits: DataFrame) -> DataFrame:
    """The leaders among ``ids`` by their similar pairs ``hits`` (``pid`` below ``id``), decided on that list alone.

    A row without a smaller undecided similar row leads, rows similar to a leader are settled, and so on until no pair is left.
    """
    edges, lost = hits.select(F.col("pid").alias("lo"), F.col("id").alias("hi")), []
    while not edges.isEmpty():
        lead = edges.select(F.col("lo").alias("id")).distinct().join(edges.select(F.col("hi").alias("id")).distinct(), "id", "left_anti")
        out = saved(edges.join(lead.withColumnRenamed("id", "lo"), "lo", "left_semi").select(F.col("hi").alias("id")).distinct(), "lost")
        lost.append(out)
        edges = saved(edges.join(out.withColumnRenamed("id", "hi"), "hi", "left_anti").join(out.withColumnRenamed("id", "lo"), "lo", "left_anti"), "edges")
    return saved(ids.join(functools.reduce(DataFrame.unionByName, lost), "id", "left_anti") if lost else ids, "leaders")


def _meet(rows: DataFrame, offers: DataFrame) -> DataFrame:
    """Rows with the offers addressed to their cell.

    Cells above ``CELL_ROWS`` rows are cut into that many slices, and an offer goes to every slice of its cell, so
    no task gets a whole hot cell. Offers to empty cells fall away. The partition number is fixed because the work
    grows with pairs, which size-based merging of partitions does not see.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    occupied = saved(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CELL_ROWS))).cast("int").alias("_s")), "occupied")
    left = rows.join(occupied.where("_s > 1"), "cell", "left").withColumn(
        "_slice", F.coalesce(F.pmod(F.xxhash64("id"), F.col("_s")).cast("int"), F.lit(0))).drop("_s")
    right = offers.join(occupied, "cell").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_s") - 1))).drop("_s")
    return left.repartition(n, "cell", "_slice").join(right.repartition(n, "cell", "_slice"), ["cell", "_slice"])


# --- fuzzy groups of rows -----------------------------------------------------------------------

#: Grid cells per dissimilarity bound.
FINENESS = 2
#: Text columns with at most that many values of at most that many letters are cells by value, not by length.
DICTIONARY, DICTIONARY_LETTERS = 64, 64


def _cell(c: str, k: str, drop: float) -> Column:
    """Grid coordinate in which rows with dissimilarity up to ``drop`` differ by at most ``FINENESS``.

    Numbers: sign and log of the size. Text: log of the length (edit distance is at least
    the length difference). Null has a coordinate of its own: 0 against 1 would cost 1.
    """
    step = -math.log(1.0 - drop) / FINENESS
    if k == "numeric":
        x = F.col(c).cast("double")
        # 1e9 keeps the positive and the negative branch and zero far apart
        g = F.when(x == 0, F.lit(0.0)).otherwise(
            F.signum(x) * (F.floor(F.log(F.abs(x)) / step) + F.lit(10 ** 9)))
    else:
        n = F.length(F.lower(F.col(c).cast("string")))
        g = F.when(n == 0, F.lit(-(10.0 ** 9))).otherwise(F.floor(F.log(n.cast("double")) / step))
    return F.coalesce(g.cast("bigint"), F.lit(-(10 ** 15)))


def _grids(columns: list[str], types, w: dict[str, float], budget: float, grid: list[str] | None) -> list[list[str]]:
    """Disjoint column groups of which one must be close in any similar pair.

    A pair may lose ``budget`` in all. With one group, its columns share that loss; if a column could lose all its
    weight within it, the columns are dealt to s groups: at least one group then loses no more than budget / s.
    """
    first = grid or [c for c in columns if kind(types[c]) == "numeric"][:3] or columns[:1]
    if all(budget / w[kind(types[c])] < 1.0 for c in first):
        return [first]
    ranked = sorted(columns, key=lambda c: kind(types[c]) != "numeric")
    for s in range(2, len(columns) + 1):
        groups = [ranked[i::s][:3] for i in range(s)]
        if all(budget / s / w[kind(types[c])] < 0.7 for g in groups for c in g):
            return groups
    return [[]]  # no column bounds a pair: one cell for all rows


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _dictionaries(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values of the columns that have few and short ones."""
    cells = df.select(*[F.lower(F.col(c).cast("string")).alias(c) for c in columns])
    if not columns:
        return {}
    counts = distinct_counts(cells, columns)
    few = [c for c in columns if counts[c] <= DICTIONARY]
    out: dict[str, list[str]] = {c: [] for c in few}
    for r in long_cells(cells, few).where("value is not null").distinct().collect() if few else ():  # bounded a column
        out[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in out.items() if all(len(x) <= DICTIONARY_LETTERS for x in v)}


def _near_codes(values: list[str], drop: float) -> Column:
    """For every code (the last one is null's) the codes of values whose dissimilarity is at most ``drop``."""
    near = [[j for j, b in enumerate(values) if abs(len(a) - len(b)) <= drop * max(len(a), len(b), 1) and (
        edit_distance(a, b) <= drop * max(len(a), len(b), 1))] for a in values]
    return F.array(*[F.array(*[F.lit(j).cast("bigint") for j in n]) for n in [*near, [len(values)]]])


def _times(places: Column, values: Column) -> Column:
    """Every coordinate list with every value after it."""
    return F.flatten(F.transform(places, lambda p: F.transform(values, lambda x: F.concat(p, F.array(x)))))


def _hashed(places: Column, grid: int) -> Column:
    return F.transform(places, lambda p: F.xxhash64(F.lit(grid), p))


def fuzzy_leaders(df: DataFrame, id_col: str, columns: list[str], threshold: float = 0.9,
                  grid: list[str] | None = None, weights: dict[str, float] | None = None,
                  pivots: int = 32) -> DataFrame:
    """Greedy leader groups as ``(id, leader)``, exact: by rising id, a row joins the smallest leader that is
    at least ``threshold`` similar, else becomes a leader itself.

    Equal rows are folded first. A pair above the threshold can lose at most ``(1 - t) x total weight``, so it lies
    in the same or a close cell of a grid over a few columns (of one of several grids, if one column's weight is less
    than that loss); no other pair is looked at. Columns with few values are coordinates too: rows meet only if their values are close enough.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    w = {**WEIGHTS, **(weights or {})}
    total = sum(w[kind(types[c])] for c in columns)
    whole = (1.0 - threshold) * total
    groups = _grids(columns, types, w, whole, grid)
    budget = whole / len(groups)
    slack = lambda x: x * (1 + 1e-9) + 1e-12
    known = _dictionaries(df, [c for c in columns if kind(types[c]) != "numeric" and whole / w[kind(types[c])] < 1.0])
    # copies: one representative per distinct row, with its smallest id
    reps = df.groupBy(row_key(columns).alias("_k")).agg(
        F.min(id_col).alias("id"), F.min_by(F.struct(*[
            (F.col(c).cast("double") if kind(types[c]) == "numeric" else F.lower(F.col(c).cast("string"))).alias(c)
            for c in columns]), id_col).alias("v"))
    empty = F.array().cast("array<bigint>")
    here, near = [], []
    for i, g in enumerate(groups):
        plain = [c for c in g if c not in known]
        loss = {c: budget / w[kind(types[c])] for c in plain}
        at = [_cell(f"v.{c}", kind(types[c]), slack(loss[c])) for c in plain]
        moves = []
        for m in itertools.product(range(-FINENESS, FINENESS + 1), repeat=len(plain)):
            # cells m apart differ by at least (|m| - 1) steps; drop moves that already cost more than the budget
            least = sum(w[kind(types[c])] * (1.0 - (1.0 - loss[c]) ** (max(abs(d) - 1, 0) / FINENESS)) for c, d in zip(plain, m))
            if least <= budget * (1 + 1e-9):
                moves.append(F.array(*[x + d for x, d in zip(at, m)]) if m else empty)
        places = F.array(*moves)
        for c, values in known.items():
            # outside the group a column may lose the whole budget
            drop = slack((budget if c in g else whole) / w[kind(types[c])])
            code = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in values]).cast("array<string>"), F.col(f"v.{c}")) - 1, F.lit(len(values)))
            at.append(code)
            close = F.get(_near_codes(values, drop), code.cast("int"))
            places = _times(places, close)
        here.append(F.xxhash64(F.lit(i), F.array(*at) if at else empty))
        near.append(_hashed(places, i))
    # cells are 64-bit hashes of grid and coordinates; a collision only adds a pair that is then compared
    point = lambda x: F.struct(x.alias("cell"), F.lit(0).alias("pos"))
    # the cheap numeric part alone already refutes most pairs before any edit distance is computed
    sim = _struct_similarity(types, [c for c in columns if kind(types[c]) == "numeric"], w, total)
    similar = (sim >= threshold) & (_struct_similarity(types, columns, w, total) >= threshold)
    reps = saved(reps, "distinct")
    lead = greedy_leaders(reps.select("id", "v"), F.transform(F.array(*here), point), F.transform(F.concat(*near), point), similar, pivots=pivots)
    best = reps.select("_k", "id").join(lead, "id").select("_k", "leader")
    return df.select(F.col(id_col), row_key(columns).alias("_k")).join(best, "_k").select(id_col, "leader")


def _struct_similarity(types, columns, w, total) -> Column:
    """Similarity of ``v`` and ``pv`` with full marks for the columns left out."""
    rest, s = total, F.lit(0.0)
    for c in columns:
        k = kind(types[c])
        rest -= w[k]
        s = s + column_similarity(F.col(f"v.{c}"), F.col(f"pv.{c}"), k) * w[k]
    return (s + max(rest, 0.0)) / total


# --- fuzzy groups of texts ----------------------------------------------------------------------

#: Grams whose frequency tasks know; all others are rarer.
FREQUENT = 1 << 16


def grams(text: Column, q: int, unit: str = "word") -> Column:
    """Distinct grams of ``q`` words or letters, lower-cased, as hashes; a shorter text is one gram, an empty one none."""
    t = F.lower(text)
    parts = F.filter(F.split(t, r"\s+"), lambda x: x != "") if unit == "word" else F.split(t, "")

    def cut(p: Column) -> Column:
        n = F.size(p)
        return F.when(n >= q, F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(p, i, q)))).when(
            n > 0, F.array(F.xxhash64(p)))
    # as the variable of a lambda the parts are made once a text, not once a gram
    found = F.get(F.transform(F.array(parts), cut), F.lit(0))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<bigint>")))


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent grams, at most ``FREQUENT``, and their numbers of texts: whole classes of frequency, the highest first."""
    n = sets.select(F.explode("g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    n = saved(n.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "grams")
    held, cut = 0, None
    for r in sorted(n.groupBy("level").count().collect(), reverse=True):  # at most 8 a power of two
        held += r["count"]
        if held > FREQUENT:
            break
        cut = r["level"]
    rows = n.where(F.col("level") >= cut).select("g", "n").toArrow().sort_by("g") if cut is not None else None
    return tuple(rows.column(i).to_numpy() for i in range(2)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_counts(h: np.ndarray) -> bytes:
    """Numbers of grams by their last bits, up to 255 each, in a power of two of buckets: an eighth of the grams at least."""
    size = 1 << max(0, len(h) - 1).bit_length() >> 3 or 1
    return np.minimum(np.bincount(h & (size - 1), minlength=size), 255).astype(np.uint8).tobytes()


def _close_counts(batches, threshold: float):
    """Pairs ``(id, pid, na, nb, a, b)`` whose bucket counts do not show more grams of one set alone than similar sets may have."""
    for batch in batches:
        keep = []
        for na, nb, a, b in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            a, b = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
            size = min(len(a), len(b))  # the longer one is folded
            if len(a) != len(b) and max(a.max(), b.max()) == 255:  # sums of capped counts bound nothing
                keep.append(True)
                continue
            apart = np.abs(a.reshape(-1, size).sum(axis=0) - b.reshape(-1, size).sum(axis=0)).sum()
            keep.append(apart <= (1 - threshold) / (1 + threshold) * (na + nb) + 1e-6)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(2)], names=["id", "pid"])


def text_leaders(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.9, q: int = 2, unit: str = "word",
                 pivots: int = 32) -> DataFrame:
    """Greedy leader groups of texts as ``(id, leader)``, exact, by the Jaccard similarity of their sets of grams.

    Equal sets are folded first. Grams are ordered from rare to frequent; two similar sets share one of their first ``n - ceil(t n) + 1`` grams, so an inverted index
    of these prefixes has all pairs. Sizes and places bound the overlap before the sets themselves are joined and compared.
    Nulls are equal to each other and empty texts too, but neither is similar to anything else.
    """
    g = grams(F.col(text_col), q, unit)
    key = F.when(F.col(text_col).isNull(), F.lit("null")).otherwise(F.md5(F.to_json(F.struct(F.array_sort(g).alias("g")))))
    keyed = saved(df.select(F.col(id_col).alias("id"), key.alias("_k"), F.coalesce(g, F.array().cast("array<bigint>")).alias("g")), "grams")
    reps = saved(keyed.groupBy("_k").agg(F.min("id").alias("id"), F.first("g").alias("g")), "sets")
    frequent = df.sparkSession.sparkContext.broadcast(_frequent(reps))

    def run(batches):
        names, count = frequent.value
        for b in batches:
            prefixes, counts = [], []
            for x in b.column(1):
                h = np.array(x.as_py(), np.int64)
                n = len(h)
                if n and len(names):
                    at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                    h = h[np.lexsort((h, np.where(names[at] == h, count[at], 0)))]
                else:
                    h.sort()
                prefixes.append(h[:n - math.ceil(threshold * n - 1e-9) + 1] if n else h)
                counts.append(_bucket_counts(h))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in b.column(1)], pa.int32()),
                                              pa.array(prefixes, pa.list_(pa.int64())), pa.array(counts, pa.binary())], names=["id", "n", "prefix", "counts"])
    id_type = reps.schema["id"].dataType.simpleString()
    rows = saved(reps.select("id", "g").mapInArrow(run, f"id {id_type}, n int, prefix array<bigint>, counts binary").select(
        "id", F.struct("n").alias("v"), "prefix", "counts"), "rows")
    cells = F.transform("prefix", lambda x, i: F.struct(x.alias("cell"), i.alias("pos")))
    a, b = F.col("v.n"), F.col("pv.n")
    most = F.least(a - F.col("pos"), b - F.col("ppos"))  # overlap from the shared gram on; grams before it are in prefixes and met earlier
    need = threshold / (1 + threshold) * (a + b) - 1e-9
    similar = (F.least(a, b) >= threshold * F.greatest(a, b) - 1e-9) & (most + F.least("pos", "ppos") >= need)

    def verify(pairs: DataFrame) -> DataFrame:
        """Similar pairs: the counts of buckets refute most of the others, so few sets travel."""
        x, y = rows.select("id", F.col("v.n").alias("na"), F.col("counts").alias("a")), rows.select(
            F.col("id").alias("pid"), F.col("v.n").alias("nb"), F.col("counts").alias("b"))
        close = saved(pairs.join(x, "id").join(y, "pid").select("id", "pid", "na", "nb", "a", "b").mapInArrow(
            lambda batches: _close_counts(batches, threshold), f"id {id_type}, pid {id_type}").distinct(), "close")
        sets = reps.join(saved(close.select("id").union(close.select("pid")).distinct(), "wanted"), "id", "left_semi")
        x, y = sets.select("id", F.col("g").alias("ga")), sets.select(F.col("id").alias("pid"), F.col("g").alias("gb"))
        shared = F.size(F.array_intersect("ga", "gb"))
        union = F.size("ga") + F.size("gb") - shared
        return close.join(x, "id").join(y, "pid").where(shared >= threshold * union - 1e-9).select("id", "pid")
    lead = greedy_leaders(rows, cells, cells, similar, verify, pivots)
    best = reps.select("_k", "id").join(lead, "id").select("_k", "leader")
    return keyed.select(F.col("id").alias(id_col), "_k").join(best, "_k").select(id_col, "leader")


def fuzzy_summary(groups: DataFrame, id_col: str) -> DataFrame:
    """Group sizes of leader groups with more than one member."""
    g = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"),
                 F.coalesce(F.max("members"), F.lit(0)).alias("largest"))


