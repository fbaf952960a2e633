"""Benchmark passages in documents, found with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words; the benchmark gives windows of
``width`` consecutive words (a shorter item is one window). The automaton of all
windows scans each normalised text once; word positions are mapped back to
offsets in the original text.

Windows are made, freed of repetitions and dealt to blocks in Spark, as pairs of a window and an item id. A block holds a
bounded number of characters, those of the ids included, so a window that many items share is spread over blocks. One
block at a time is collected and sent to the tasks. A benchmark beyond one block is scanned in several passes, whose hits
are merged row by row between stored tables; nothing is dropped.

Defined results: null and empty texts, and texts without words, have no words and no
hits. A very long document is scanned whole; a very long item gives its windows in pieces. There are no ties. Repeated rows are judged one by one. Repeated items, and items with a
null id (shown as ``""``), count as ids once each. An empty benchmark hits nothing.
Columns of the input that have the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lendframe.llm.common import annotate, stored, utf8

WIDTH = 10
#: Bound on what one broadcast automaton holds, in characters of windows (a trie node each at most) and of item ids.
BLOCK_CHARS = 4_000_000
SENT = 10_000  # windows of an item that a task sends on at once

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Bytes outside 0-9, a-z and the non-ASCII range separate words; A-Z become a-z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def window_pairs(bench: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> DataFrame:
    """Distinct ``window`` (words joined by spaces), ``item`` (id as text, ``""`` for null) and the ``size`` of both; stored."""
    src = bench.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))

    def run(batches):
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                w = words(text.as_py())
                n = max(1, len(w) - width + 1) if w else 0
                for at in range(0, n, SENT):
                    found = [b" ".join(w[i:i + width]) for i in range(at, min(n, at + SENT))]
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found))], names=["window", "item"])
    pairs = src.mapInArrow(run, "window binary, item string").distinct()
    return stored(pairs.withColumn("size", F.octet_length("window") + F.octet_length("item") + 2), "windows")


def _blocks(bench: DataFrame, id_col: str, text_col: str, width: int, block_chars: int) -> Iterator[dict]:
    """Window -> item ids, block by block; no block is larger than the bound (or than twice the largest pair)."""
    pairs = window_pairs(bench, id_col, text_col, width)
    total, largest = pairs.agg(F.sum("size"), F.max("size")).first()
    bound = max(block_chars, 2 * (largest or 0))
    n = -(-(total or 0) // bound)

    def place(n):
        return F.pmod(F.xxhash64("window", "item"), F.lit(n))
    while n > 1 and pairs.groupBy(place(n).alias("k")).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] > bound:
        n += -(-n // 4)
    for k in range(n):
        block: dict[str, list[str]] = {}
        rows = pairs.filter(place(n) == k).select("window", "item").toArrow()
        for window, item in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            block.setdefault(f" {window.decode('utf-8', 'surrogateescape')} ", []).append(item)
        if block:
            yield block


def annotate_hits(docs: DataFrame, bench: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", carry: list[str] | None = None, width: int = WIDTH,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Carried columns plus ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings), ``hits``
    (half-open word ranges) and ``spans`` (half-open character ranges of the original text)."""
    sc = docs.sparkSession.sparkContext
    carry = docs.columns if carry is None else carry
    carry = [c for c in carry if c not in {n for n, _ in FIELDS}]
    scan, sent = docs, None
    # the text column stays while passes remain; its name is kept apart from the carried ones
    held = scan.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text_col}`").alias("_scan_text"),
                       F.lit(None).cast(SPAN).alias("hits"), F.lit(None).cast(ITEMS).alias("items"))
    for block in _blocks(bench, item_col, item_text_col, width, block_chars):
        if sent:
            held = stored(held, "hits")
            sent.destroy()  # its pass is stored
        sent = sc.broadcast(block)
        held = _scan(held, sent, carry)
    if not sent:
        held = _scan(held, sc.broadcast({}), carry)
    return held.drop("_scan_text").select(*carry, *[n for n, _ in FIELDS])


SPAN = "array<struct<start:int,stop:int>>"
ITEMS = "array<string>"
FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("n_items", "bigint"), ("items", ITEMS), ("hits", SPAN),
          ("spans", SPAN)]


def _scan(held: DataFrame, block, carry: list[str]) -> DataFrame:
    fields = [(n, T.DataType.fromDDL(t)) for n, t in FIELDS]

    def start():
        auto = ahocorasick.Automaton()
        for pattern, items in block.value.items():
            auto.add_word(pattern, (pattern.count(" ") - 1, items))
        if len(auto):
            auto.make_automaton()

        def one(raw: bytes, ranges, items):
            w = words(raw)
            ranges = [(r["start"], r["stop"]) for r in ranges or ()]
            found = set(items or ())
            if w and len(auto):
                text = f" {b' '.join(w).decode('utf-8', 'surrogateescape')} "
                matches = list(auto.iter(text))
                if matches:
                    gaps = [i for i, c in enumerate(text) if c == " "]
                    for end, (n, ids) in matches:
                        stop = bisect_right(gaps, end) - 1  # gaps before the closing one = words up to here
                        ranges.append((stop - n, stop))
                        found.update(ids)
            merged = _merge(ranges)
            spans = []
            if merged:
                at = [m.span() for m in WORD.finditer(raw.decode("utf-8", "surrogateescape"))]
                spans = [{"start": at[a][0], "stop": at[b - 1][1]} for a, b in merged]
            return (len(w), sum(b - a for a, b in merged), len(found), sorted(found),
                    [{"start": a, "stop": b} for a, b in merged], spans)

        def run(text, ranges, items):
            return list(zip(*map(one, utf8(text), ranges.to_pylist(), items.to_pylist()), strict=True)) or [[]] * 6
        return run
    return annotate(held, ["_scan_text", "hits", "items"], fields, start, [*carry, "_scan_text"])


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges joined."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def report(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per document: word and hit counts and a digest of the sorted item ids."""
    d = annotate_hits(docs, bench, carry=[id_col], **kw)
    return d.select(id_col, "n_words", "n_hit", "n_items",
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, bench: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    clash = {n: f"_own_{n}" for n, _ in FIELDS if n in docs.columns}
    d = annotate_hits(docs.withColumnsRenamed(clash), bench, **kw).filter("n_hit = 0")
    return d.drop(*[n for n, _ in FIELDS]).withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
