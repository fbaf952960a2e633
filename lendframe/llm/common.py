"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lendframe.session import scratch_path

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate table to the shared folder once and read it back.

    Cuts the lineage in a way that survives lost executors, and gives later joins
    plain scans on both sides, so that adaptive execution may split hot keys.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Number of shuffle partitions, used as the number of salts."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def annotate(df: DataFrame, inputs: list[str], fields: list[tuple[str, T.DataType]],
             start: Callable[[], Callable[..., list]], carry: list[str] | None = None) -> DataFrame:
    """Append columns computed per Arrow batch; a carried column that has the name of a new one is replaced.

    ``start`` runs once per task and gives a function from the input arrays to the
    list of new arrays (or lists) of the same length.
    """
    carry = df.columns if carry is None else carry
    new = {n for n, _ in fields}
    carry = [c for c in carry if c not in new]
    out = T.StructType([df.schema[c] for c in carry] + [T.StructField(n, t) for n, t in fields])
    # positions, not names: a computed column may share a name with an input that is not carried
    sel = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
                    *[F.col(f"`{c}`").alias(f"i{i}") for i, c in enumerate(inputs)])
    n_carry, types, names = len(carry), [_arrow(t) for _, t in fields], [f.name for f in out.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = start()
        for b in batches:
            cols = fn(*[b.column(i) for i in range(n_carry, b.num_columns)])
            cols = [c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_carry)] + cols, names=names)

    return sel.mapInArrow(run, out)


def _arrow(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(t)


def utf8(col: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % m


def slices(col: pa.Array, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive texts of about ``limit`` bytes together, one text at least."""
    size = np.cumsum([0, *pc.fill_null(pc.binary_length(col.cast(pa.binary())), 0).to_pylist()])
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield at, end - at
        at = end
