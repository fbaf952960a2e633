"""Token sequences in a keyed random order, in fixed-stride shards.

Texts become ids of a public byte-level vocabulary, an end mark follows each text, and every text is cut into sequences of
``length`` ids (two bytes each, little-endian, the last one padded with end marks). The sequences are numbered
without gaps, and a keyed Feistel network over the next even number of bits, walked along its cycle until the number
is in range, gives every sequence its slot: a permutation that any task can compute alone. ``slots // per_shard`` is the shard, so shards
are ranges of the slot order, and each shard but the last holds the same number of equally long records: reading
can start at any slot by arithmetic.

Texts are tokenised once, into a stored table from which numbers and payloads are read; sequences are shuffled once, to
tasks that hold ranges of slots of equal size (the slots are even by construction, so nothing is sampled), written ones in compressed blocks. A task writes its
shards one after another, so their number may grow without more tasks. Only one count per stored partition passes through the driver.

A written record is ``head`` and ``payload``: length of the id as text (4 bytes, all ones for null), the id in UTF-8 padded with zeros to the
longest id's length, and the number of the sequence within its text (8 bytes), all big-endian. A layout row beside
the shards says what a reader needs. Very long ids make all records long, for the stride is fixed.

Defined results: null and empty texts give one sequence, the end mark alone. Repeated rows give sequences of
their own. An empty table gives no sequences and no shards. The numbering follows the stored partitions, so the same table layout and key give the same order.
A very long text is tokenised whole and cut. Bytes that are not valid UTF-8 become replacement characters. There are no ties: every
sequence has a number of its own. Columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendframe.llm.common import slices, tasks
from lendframe.llm.vocabulary import RANKS, tokenizer
from lendframe.session import scratch_path

END = 50256  # the free id of the vocabulary
LENGTH = 256
PER_SHARD = 4096  # more at scale: shards of a gigabyte can be read as well, in pieces of READ_ROWS
READ_ROWS = 2048
TASK_BYTES = 512 << 20  # payload that one task sorts and writes
BLOCK_ROWS = 2048  # records that are compressed together on their way to the shards
PAGE_BYTES = 16 << 20  # ids of texts that are compressed together in the stored table
HELD_BYTES = 96 << 20  # records that a task holds until their blocks are full
ROUNDS = 4


def encoded(texts: list[str], enc) -> list[bytes]:
    """Two-byte ids of each text."""
    return [np.array(enc.encode_ordinary(t), "<u2").tobytes() for t in texts]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(numbers: np.ndarray, total: int, key: int) -> np.ndarray:
    """Places of the numbers in the keyed permutation of ``range(total)``."""
    half = max(1, ((max(total - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % (1 << 64)) for r in range(ROUNDS)]

    def network(x):
        left, right = x >> shift, x & mask
        with np.errstate(over="ignore"):
            for k in keys:
                left, right = right, left ^ (_mix(_mix(right + k) + k) & mask)
        return (left << shift) | right
    out = network(numbers.astype(np.uint64))
    while len(at := np.flatnonzero(out >= np.uint64(total))):  # walk on along the cycle; it returns into range
        out[at] = network(out[at])
    return out.astype(np.int64)


def _token_table(docs: DataFrame, id_col: str, text_col: str, length: int, path: str) -> DataFrame:
    """One row per text: stored partition, sequences before it in there, their number, and the ids."""
    src = docs.select(F.col(id_col).cast("string").alias("doc"), F.make_valid_utf8(F.col(text_col)).alias("t"))

    def run(batches):
        enc, n, part = tokenizer(path), 0, TaskContext.get().partitionId()
        end = np.array([END], np.uint16).tobytes()
        for b in batches:
            for at, size in slices(b.column(1)):
                ids = [x + end for x in encoded([t or "" for t in b.column(1).slice(at, size).to_pylist()], enc)]
                counts = [-(-len(x) // (2 * length)) for x in ids]
                before = np.cumsum([n, *counts])
                n = int(before[-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, size), pa.array([part] * len(ids), pa.int32()), pa.array(before[:-1], pa.int64()),
                     pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names=["doc", "part", "before", "n", "ids"])
    schema = "doc string, part int, before bigint, n bigint, ids binary"
    out = scratch_path(docs.sparkSession, "tokens")
    # a page is compressed by itself: the usual megabyte ends before most of what repeats, and before the window of the level
    src.mapInArrow(run, schema).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "9").option(
        "parquet.page.size", PAGE_BYTES).parquet(out)
    return docs.sparkSession.read.schema(schema).parquet(out)


def _sequences(docs: DataFrame, key: int, id_col: str, text_col: str, length: int, path: str) -> tuple[DataFrame, int]:
    """``slot, doc`` (the id as text), ``part, n_ids, payload`` of all sequences, unordered, and their number."""
    spark = docs.sparkSession
    table = _token_table(docs, id_col, text_col, length, path)
    sizes = {r.part: r.n for r in table.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one per partition
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    held = spark.sparkContext.broadcast(offsets)

    def run(batches):
        width = 2 * length
        for b in batches:
            doc, part, before, n, ids = (b.column(i) for i in range(5))
            n = n.to_numpy()
            if not len(n):
                continue
            base = before.to_numpy() + np.array([held.value[p] for p in part.to_pylist()], np.int64)
            row = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            slot = slots(base[row] + inner, total, key)
            raw = ids.to_pylist()
            pad = np.full(length, END, np.uint16).tobytes()
            cut, used = [], []
            for x in raw:
                for i in range(0, len(x), width):
                    y = x[i:i + width]
                    used.append(len(y) // 2)
                    cut.append(y if len(y) == width else y + pad[len(y):])
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), doc.take(pa.array(row)), pa.array(inner), pa.array(used, pa.int64()), pa.array(cut, pa.binary())],
                names=["slot", "doc", "part", "n_ids", "payload"])
    return table.mapInArrow(run, "slot bigint, doc string, part bigint, n_ids bigint, payload binary"), total


def _ranges(spark: SparkSession, total: int, per_shard: int, length: int) -> tuple[int, int]:
    """Number of shards, and of the ranges of whole shards that tasks write."""
    shards = max(1, -(-total // per_shard))
    return shards, min(shards, max(tasks(spark), -(-total * 2 * length // TASK_BYTES)))


def _dealt_blocks(records: DataFrame, stride: int, total: int, per_shard: int, length: int) -> DataFrame:
    """Records (``slot, value``, all of ``stride`` bytes) in the tasks of ``_by_shard``, as ``slot, shard, value`` in the same order.

    They travel in compressed blocks of up to ``BLOCK_ROWS`` of one range: records one by one, in random order, hardly compress.
    """
    shards, parts = _ranges(records.sparkSession, total, per_shard, length)

    def block(to: int, held: list) -> pa.RecordBatch:
        slot, rec = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
        packed = pa.Codec("zstd", compression_level=6).compress(slot.astype("<i8").tobytes() + rec.tobytes(), asbytes=True)
        return pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([len(slot)], pa.int32()), pa.array([packed], pa.binary())],
                                          names=["to", "n", "block"])

    def pack(batches):
        held, sizes, rows = {}, {}, 0
        for b in batches:
            slot = b.column(0).to_numpy()
            if not len(slot):
                continue
            rec = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, stride)
            to = slot // per_shard * parts // shards
            order = np.argsort(to, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
                r = int(to[at[0]])
                held.setdefault(r, []).append((slot[at], rec[at]))
                sizes[r] = sizes.get(r, 0) + len(at)
                rows += len(at)
                if sizes[r] >= BLOCK_ROWS:
                    rows -= sizes.pop(r)
                    yield block(r, held.pop(r))
            if rows * stride > HELD_BYTES:
                for r in list(held):
                    yield block(r, held.pop(r))
                sizes, rows = {}, 0
        for r, x in held.items():
            yield block(r, x)

    def unpack(batches):
        for b in batches:
            for n, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = pa.decompress(packed, n * (8 + stride), "zstd", asbytes=True)
                ends = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(stride))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(raw, "<i8", n)), pa.Array.from_buffers(
                    pa.binary(), n, [None, ends, pa.py_buffer(raw[8 * n:])])], names=["slot", "value"])
    packed = records.select("slot", "value").mapInArrow(pack, "to int, n int, block binary").repartitionById(parts, "to")
    back = packed.select("n", "block").mapInArrow(unpack, "slot bigint, value binary")
    return back.withColumn("shard", F.floor(F.col("slot") / per_shard)).sortWithinPartitions("shard", "slot")


def _by_shard(df: DataFrame, total: int, per_shard: int, length: int) -> DataFrame:
    """Rows with ``shard``, in slot order within ranges of whole shards; the number of ranges follows the bytes, not the shards.

    The order begins with the shard itself, so that a write by shard need not sort again (and lose the order of slots).
    """
    shards, parts = _ranges(df.sparkSession, total, per_shard, length)
    df = df.withColumn("shard", F.floor(F.col("slot") / per_shard))
    return df.repartitionById(parts, F.floor(F.col("shard") * parts / shards).cast("int")).sortWithinPartitions("shard", "slot")


def ordered_sequences(docs: DataFrame, key: int, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                      per_shard: int = PER_SHARD, tokenizer_file: str = RANKS) -> DataFrame:
    """``slot, shard, row`` (place in the shard), id, ``part`` (of the text), ``n_ids`` (without padding), ``payload``.

    Rows lie in slot order within their partition, each shard in one partition.
    """
    s, total = _sequences(docs, key, id_col, text_col, length, tokenizer_file)
    return _by_shard(s, total, per_shard, length).select(
        "slot", "shard", (F.col("slot") % per_shard).alias("row"),
        F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "part", "n_ids", "payload")


def _number(x: Column, size: int) -> Column:
    """A whole number as ``size`` big-endian bytes."""
    return F.unhex(F.lpad(F.hex(x), 2 * size, "0"))


def write_shards(docs: DataFrame, key: int, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                 per_shard: int = PER_SHARD, tokenizer_file: str = RANKS) -> int:
    """One binary file per shard under ``path/shards/shard=N``: records in slot order, each with one line feed; returns their number.

    Byte ``row * (head + payload + 1)`` of a shard's file is the start of its record ``row``. ``path/layout`` holds one row:
    ``total, length, per_shard, id_width``.
    """
    spark = docs.sparkSession
    s, total = _sequences(docs, key, id_col, text_col, length, tokenizer_file)
    width = docs.agg(F.max(F.octet_length(F.col(id_col).cast("string")))).first()[0] or 0
    doc = F.coalesce(F.col("doc"), F.lit("")).cast("binary")
    size = F.when(F.col("doc").isNull(), F.lit(0xFFFFFFFF)).otherwise(F.octet_length("doc").cast("bigint"))
    padded = F.rpad(doc, width, F.lit(b"\0")) if width else F.lit(b"")
    record = F.concat(_number(size, 4), padded, _number(F.col("part"), 8), "payload")
    _dealt_blocks(s.select("slot", record.alias("value")), 4 + width + 8 + 2 * length, total, per_shard, length).select(
        "shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(f"{path}/shards")
    spark.createDataFrame([(total, length, per_shard, width)], LAYOUT).coalesce(1).write.json(f"{path}/layout")
    return total


LAYOUT = "total bigint, length int, per_shard bigint, id_width int"
RECORD = "slot bigint, shard bigint, row bigint, id string, part bigint, n_ids bigint, payload binary"


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """``slot, shard, row, id`` (as text), ``part, n_ids, payload`` of the slots from ``start`` up to ``stop`` (default: the end).

    Only the files of their shards are opened.
    """
    total, length, per_shard, id_width = spark.read.schema(LAYOUT).json(f"{path}/layout").first()
    stop = total if stop is None else min(stop, total)
    if start >= stop:
        return spark.createDataFrame([], RECORD)
    files = spark.read.format("binaryFile").load(f"{path}/shards").filter(
        F.col("shard").between(start // per_shard, (stop - 1) // per_shard))
    head = 4 + id_width + 8

    def run(batches):
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                first = max(0, start - shard * per_shard)
                last = min(stop - shard * per_shard, per_shard)
                stride = head + 2 * length + 1
                rec = np.frombuffer(content.as_buffer(), np.uint8).reshape(-1, stride)[first:last]
                for at in range(0, len(rec), READ_ROWS):
                    yield pa.RecordBatch.from_arrays(
                        _columns(rec[at:at + READ_ROWS], shard, first + at, per_shard, id_width, length), names=names)
    names = [x.split()[0] for x in RECORD.split(", ")]
    return files.select(F.col("shard").cast("bigint"), "content").mapInArrow(run, RECORD)


def _columns(rec: np.ndarray, shard: int, first: int, per_shard: int, id_width: int, length: int) -> list[pa.Array]:
    """The records of one shard, from its place ``first`` on, as columns."""
    at, n = 4 + id_width, len(rec)
    size = np.ascontiguousarray(rec[:, :4]).view(">u4").ravel().astype(np.int64)
    null = size == 0xFFFFFFFF
    size[null] = 0
    ids = rec[:, 4:at][np.arange(id_width) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    part = np.ascontiguousarray(rec[:, at:at + 8]).view(">i8").ravel().astype(np.int64)
    payload = np.ascontiguousarray(rec[:, at + 8:-1])
    over = payload.view("<u2") == END  # no text holds the end mark itself
    used = np.where(over.any(axis=1), over.argmax(axis=1) + 1, length)
    row = np.arange(first, first + n)
    doc = pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(ids.tobytes()),
                                      pa.py_buffer(np.packbits(~null, bitorder="little").tobytes()), int(null.sum()))
    whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * length), n, [None, pa.py_buffer(payload)])
    return [pa.array(shard * per_shard + row), pa.array(np.full(n, shard)), pa.array(row), doc, pa.array(part), pa.array(used),
            whole.cast(pa.binary())]
