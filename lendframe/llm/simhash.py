"""Near-duplicates by SimHash, found through deletion-variant signatures.

A fingerprint of 64 bits is cut into ``bits // 2 + 1`` segments, fewer than the usual
``bits + 1``. If two fingerprints differ in at most ``bits`` places, one segment differs
in at most one place. Each segment is therefore indexed under its one-wildcard
variants (one position masked out), variants are joined on equality and the full
distance is verified. Equal fingerprints are folded first.

A variant that many different fingerprints share is never paired out. Its members
are met at the points of their balls of radius one instead: two fingerprints are
within two bits exactly if such balls share a point, and at most 65 fingerprints lie
around one point. Both ways find every link.

Defined results: null text counts as empty; texts without words have fingerprint zero
and link like any other; ties and repeated rows take the same component, repeated rows
are all returned. Null ids take the component of their fingerprint, and null where it has no other id. A very long text is read whole, its shingles
in blocks. Bytes that are not valid UTF-8 are compared as bytes. An empty table gives an empty result. :func:`keep_one` leaves
one row of each group: of rows with one id the one with the smallest row hash, a row repeated whole once, a null id only where
the group has no other. Columns beside id and text are read by :func:`keep_one` alone, which returns them; their names may clash with any used here.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lendframe.llm.common import annotate, stored, tasks, utf8
from lendframe.llm.components import connected_components
from lendframe.llm.survivors import ROW, keep_one_row, row_key

SEED = 42
#: Largest bucket whose members are compared pair by pair.
PAIRED = 32
BLOCK = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """Majority bit of the XXH64 values of all word shingles, repeats included."""
    words = text.lower().split()  # bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - width + 1
    if n < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n]
    ends = ends[width - 1:] - 1
    count = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        cut = map(joined.__getitem__, map(slice, starts[i:i + BLOCK].tolist(), ends[i:i + BLOCK].tolist()))
        raw = np.frombuffer(b"".join(map(xxhash.xxh64_digest, cut, repeat(SEED))), np.uint8).reshape(-1, 8)
        count += np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, width: int = 3) -> DataFrame:
    """Carried columns plus ``fp`` (the bits as a long) and ``fingerprint`` (16 hex digits)."""
    def start():
        def run(text):
            f = np.array([fingerprint(x, width) for x in utf8(text)], np.uint64)
            return [pa.array(f.view(np.int64)), [f"{x:016x}" for x in f.tolist()]]
        return run
    return annotate(docs, [text_col], [("fp", T.LongType()), ("fingerprint", T.StringType())], start, carry)


def links(fps: DataFrame, bits: int = 2, paired: int = PAIRED) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of distinct ``fp`` at most ``bits`` apart (1 or 2)."""
    if bits not in (1, 2):
        raise ValueError("bits must be 1 or 2")
    one = fps.select("fp").repartition(tasks(fps.sparkSession), "fp")  # 64 rows are made of each
    variants = one.select("fp", F.explode(F.array(*_variants(bits))).alias("key"))
    shared = variants.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # the table of shared variants grows with the corpus: never broadcast, and both sides may be split
    members = stored(variants.join(stored(shared, "shared").hint("merge"), "key"), "members")

    small = members.filter(F.col("n") <= paired).select("key", "fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    pairs = small.withColumnRenamed("fp", "a").join(small.withColumnRenamed("fp", "b"), "key").filter(
        (F.col("a") < F.col("b")) & near).select("a", "b")

    crowded = members.filter(F.col("n") > paired).select("fp").distinct()
    points = crowded.select("fp", F.explode(F.array(F.col("fp"), *_flips())).alias("point"))
    around = points.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("near"))  # 65 at most
    around = around.filter(F.size("near") > 1)
    if bits == 2:
        stars = around.select(F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, 64)).alias("b"))
    else:
        stars = around.select("near", F.explode("near").alias("a")).select(
            "a", F.explode("near").alias("b")).filter((F.col("a") < F.col("b")) & near)
    return pairs.unionByName(stars)


def _variants(bits: int) -> list:
    m = bits // 2 + 1
    edges = [64 * i // m for i in range(m + 1)]
    out = []
    for lo, hi in zip(edges, edges[1:]):
        mask = (1 << (hi - lo)) - 1
        part = F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit(mask if hi - lo < 64 else -1))
        for i in range(lo, hi):
            wild = part.bitwiseAND(F.lit(_signed(~(1 << (i - lo)) & ((1 << 64) - 1))))
            # 64 positions name segment and wildcard; a segment of 32 bits fits beside them in one long
            out.append(wild.bitwiseOR(F.lit(i << 32)) if m > 1 else F.xxhash64(wild, F.lit(i)))
    return out


def _flips() -> list:
    return [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _grouped(docs: DataFrame, bits: int, width: int, paired: int) -> DataFrame:
    """The columns of ``id, t, ...`` but ``t``, with ``fingerprint``, ``component_id``, and ``grp``, one fingerprint of the group."""
    fp = stored(fingerprints(docs, "t", [c for c in docs.columns if c != "t"], width), "fingerprints")
    distinct = stored(fp.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = connected_components(links(distinct, bits, paired)).withColumnRenamed("node", "fp")
    linked = stored(distinct.join(roots, "fp"), "linked")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("all_least")), "least")
    known = linked.join(least, "root").select("fp", "root", "all_least")
    owner = stored(distinct.join(known, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("grp"), F.coalesce("all_least", "least").alias("component_id")), "owner")
    return fp.join(owner, "fp").drop("fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3,
                paired: int = PAIRED) -> DataFrame:
    """id, ``fingerprint`` and ``component_id`` (smallest id that links reach, the own one included) of every row."""
    g = _grouped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), bits, width, paired)
    return g.select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2, width: int = 3) -> DataFrame:
    """One row of each group, that with the smallest id, with all its columns."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), row_key(docs).alias(ROW))
    return keep_one_row(docs, _grouped(rows, bits, width, PAIRED).select("grp", "id", ROW))
