"""One row of every group stays, whatever ids the rows have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendframe.llm.common import stored

ROW = "_row_key"


def row_key(df: DataFrame) -> Column:
    """128 bits of all values of a row, nulls marked: rows with one key are the same row repeated."""
    values = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        values += [F.to_json(c) if isinstance(f.dataType, T.MapType) else c, c.isNull()]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


def keep_one_row(docs: DataFrame, members: DataFrame, keep: str = "min") -> DataFrame:
    """The row of each group with the smallest (``min``) or largest (``max``) id, with all its columns; once if it is repeated.

    ``members``: ``grp``, ``id`` and ``ROW`` of every row. Null ids come last; of rows with one id the one with the smallest key stays.
    """
    m = stored(members.select("grp", "id", ROW), "members")
    value = F.struct("id", ROW)
    best = {"min": F.min, "max": F.max}[keep]
    # a group may hold a third of all rows: its best id is found with partial sums, then its best key
    ids = m.groupBy("grp").agg(best("id").alias("best_id"))
    first = m.join(stored(ids, "best_ids").hint("merge"), "grp").filter(F.col("id").eqNullSafe(F.col("best_id"))).groupBy("grp").agg(
        F.min(value).alias("v")).select(F.col(f"v.{ROW}").alias(ROW))
    stay = stored(first.distinct(), "stay")
    repeated = stored(m.groupBy(ROW).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(ROW), "repeated")
    # the lists grow with the corpus: never broadcast, at any size
    gone = m.select(ROW).distinct().join(stay.hint("merge"), ROW, "left_anti").unionByName(repeated).distinct()
    keyed = docs.withColumn(ROW, row_key(docs))
    out = keyed.join(stored(gone, "gone").hint("merge"), ROW, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    again = stored(repeated.join(stay, ROW), "again")
    if again.isEmpty():
        return out
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = keyed.join(again.hint("merge"), ROW).groupBy(ROW).agg(F.first(row).alias("r")).select("r.*")
    return out.unionByName(once)
