"""Exact duplicates by 128-bit content hash, with a byte comparison inside the groups.

All of it is DataFrame code. Rows are counted per (hash, salt) before they are
counted per hash, and every join is on (hash, salt), so a text that fills a third
of the table is spread over all tasks.

Defined results: null text equals empty text. Repeated rows with one id and one
text are members of one group and agree on every column. A null id never beats
another id; a group with null ids only has a null ``keep_id``. An empty table gives
an empty result. A very long text is hashed and compared as a whole; ties between equal ids don't matter here. :func:`drop_copies`
leaves one row of each group: of rows with one id the one with the smallest row hash, a row repeated whole once, a null id only where
the group has no other. Columns beside id and text are read by :func:`drop_copies` alone, which returns them; their names may clash with any used here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from lendframe.llm.common import stored, tasks
from lendframe.llm.survivors import ROW, keep_one_row, row_key


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                 hash_fn: Callable[[Column], Column] = content_hash, row: Column | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``, and ``row`` if it is given.

    ``keep``: "min" or "max", the id of a group that stays.
    """
    also = [] if row is None else [ROW]
    best = {"min": F.min, "max": F.max}[keep]
    n_salt = tasks(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([] if row is None else [row.alias(ROW)]))
    rows = rows.select("id", "t", *also, hash_fn(F.col("t")).alias("h"), F.pmod(F.xxhash64("id"), F.lit(n_salt)).alias("s"))
    ids = stored(rows.select("id", "h", "s", F.sha2("t", 256).alias("sha"), *also), "hashes")

    part = ids.groupBy("h", "s").agg(F.count(F.lit(1)).alias("n"), best("id").alias("k"))
    whole = part.groupBy("h").agg(F.sum("n").alias("group_size"), best("k").alias("keep_id"))
    groups = stored(part.select("h", "s").join(whole, "h"), "groups")  # one row per hash and salt

    collided = stored(_collisions(rows, groups), "collided")
    plain = ids
    extra = None
    if not collided.isEmpty():  # hashes that stand for several texts: group these rows by the text itself
        plain = ids.join(collided, "h", "left_anti")
        hit = rows.join(collided, "h", "left_semi")
        p = hit.groupBy("t", "s").agg(F.count(F.lit(1)).alias("n"), best("id").alias("k"))
        w = p.groupBy("t").agg(F.sum("n").alias("group_size"), best("k").alias("keep_id"))
        extra = hit.select("id", "t", "s", F.sha2("t", 256).alias("sha"), *also).join(
            p.select("t", "s").join(w, "t"), ["t", "s"]).select("id", "keep_id", "group_size", "sha", *also)
    out = plain.join(groups, ["h", "s"]).select("id", "keep_id", "group_size", "sha", *also)
    out = out if extra is None else out.unionByName(extra)
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size",
                      F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), *also)


def _collisions(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes whose rows are not all the same bytes: least and greatest text differ."""
    shared = groups.filter("group_size > 1").select("h", "s")
    one = rows.select("h", "s", "t").join(shared, ["h", "s"]).groupBy("h", "s").agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"))
    one = one.select("h", "lo", F.when(F.col("hi") != F.col("lo"), F.col("hi")).alias("hi"))
    return one.groupBy("h").agg(F.min("lo").alias("lo"), F.max("lo").alias("mid"), F.max("hi").alias("hi")).filter(
        "mid > lo or hi > lo").select("h")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = exact_groups(docs, id_col, text_col, keep, row=row_key(docs))
    return keep_one_row(docs, groups.select(F.col("text_sha256").alias("grp"), F.col(id_col).alias("id"), ROW), keep)
