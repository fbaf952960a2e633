"""Similarity join on sets of word shingles: size-banded tiles, bitmap signatures, exact intersections.

Two documents link when ``100 * |intersection| >= percent * |union|``. Equal sets are folded into classes first (128-bit
sum of the shingle hashes, and the size). Sizes are cut into bands so wide that a set finds partners in its own band and
the next ones only.

* Which sets may meet: two linked sets whose smaller one lies in a band differ in at most ``k`` shingles, where ``k`` follows from
  the band's upper end. The hash range is cut into ``k + 1`` parts; at least one part holds the same shingles in both. Every set is
  filed under its parts, and sets that share a part are candidates. Parts without shingles say nothing: a set with such a
  part is filed once more under a second, independent cut (two linked sets that agree in empty parts only both are), and so on;
  the last cut counts its empty parts too. No link can be lost.
* Tiles: candidates that hang together are dealt to tiles of two slices, (band, slice) against (band or next band, slice), of a bounded number of
  shingles and documents each. Each pair of sets has one tile. Inside a tile every set has a hashed bitmap; differing bits bound the overlap
  from above, and only pairs whose bound suffices get the exact intersection of their sorted arrays.
* A tile returns the number of links of each set and one link to its group, never its pairs; :func:`similar_pairs` returns pairs.

Shingles are compared as 64-bit hashes. A tile's work grows with the square of its slices: groups of many candidates cost that many bitmap
comparisons, over many tiles. Documents that consist almost wholly of one shared passage become candidates of each other more often.

Defined results: null and empty texts, and texts without words, have ``n_shingles`` 0 and link with nothing, not with
each other. Texts with fewer words than ``width`` have one shingle, the whole sequence. Equal sets link. Repeated rows and rows with one id count one by
one; a null id is the smallest of a group only if it has no other, and then ``component_id`` is null. Very long texts are read whole, one at a time;
a set larger than a tile's bound has slices of its own. Bytes that are not valid UTF-8 are compared as bytes. An empty table gives an
empty result. Columns beside id and text are not read, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lendframe.llm.common import slices, stored, utf8
from lendframe.llm.components import connected_components

#: Bounds of one slice of a tile: shingles and sets.
SLICE_SHINGLES, SLICE_SETS = 1 << 20, 1024
CUTS = 4  # independent cuts for sets with empty parts
WORDS_KEPT = 1 << 18  # word hashes a task remembers
ODD = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31, _S32 = (np.uint64(x) for x in (30, 27, 31, 32))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((seed * ODD + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


class WordHashes(dict):
    """Remembers the hashes of words, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().split()  # bytes: A-Z only, and exactly 0x20 and 0x09 to 0x0D
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(w) - width + 1
    if n < 1:
        return mix(np.array([int(sum((i + 2) * int(x) for i, x in enumerate(w))) & (1 << 64) - 1], np.uint64), 100 + len(w)) if len(w) else w
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h += w[i:i + n] * np.uint64(pow(ODD, 2 * i + 1, 1 << 64))
    return np.unique(mix(h))


class Bands:
    """Size bands for a least similarity, and the cuts of each band."""

    def __init__(self, percent: int, most: int):
        self.percent, self.most = percent, most
        ratio, edges = max(1.25, 100 / percent), [1]
        while edges[-1] <= most * 100 // percent + 1:
            edges.append(max(edges[-1] + 1, math.ceil(edges[-1] * ratio)))
        self.edges = np.array(edges, np.int64)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def parts(self, band: int) -> int:
        """One more than the number of shingles in which linked sets differ, if the smaller one is in the band."""
        return (int(self.edges[band + 1]) - 1) * (100 - self.percent) // self.percent + 1

    def filed(self, n: int) -> list[int]:
        """Bands under which a set of that size is filed: its own, and those below that hold smaller partners."""
        b = self.of(n)
        out = [b]
        while b and n * self.percent <= (int(self.edges[b]) - 1) * 100:
            b -= 1
            out.append(b)
        return out


@lru_cache(maxsize=4096)
def _limits(m: int) -> np.ndarray:
    """Smallest hash of parts 1 to m - 1 of the hash range."""
    return np.array([(-(-(j << 32) // m)) << 32 for j in range(1, m)], np.uint64)


def keys(h: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set's parts, in all bands under which it is filed; none where only equal sets link."""
    out = []
    for band in bands.filed(len(h)) if len(h) else ():
        m = bands.parts(band)
        if m == 1:
            continue
        for cut in range(CUTS):
            g = np.sort(mix(h, 1 + cut))
            at = np.concatenate(([0], np.searchsorted(g, _limits(m)), [len(g)]))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g, 20 + cut))))
            name = np.arange(m, dtype=np.uint64) + np.uint64((band * CUTS + cut) << 40)
            key = mix(total[at[1:]] - total[at[:-1]] + mix(name, 40), 41)
            full = at[1:] > at[:-1]
            if cut == CUTS - 1 or full.all():
                out.append(key)
                break
            out.append(key[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _binary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("th"))


def _signed(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """``id, th, n, lo, hi, keys``: size and identity of each row's set, and the keys of its parts."""
    def run(batches):
        hashes, bands = WordHashes(), Bands(percent, 1 << 12)
        for b in batches:
            for at, k in slices(b.column(1)):
                n, lo, hi, found = [], [], [], []
                for t in utf8(b.column(1).slice(at, k)):
                    h = shingles(t, width, hashes)
                    if len(h) > bands.most:
                        bands = Bands(percent, 2 * len(h))
                    n.append(len(h))
                    lo.append(mix(h, 60).sum(dtype=np.uint64))
                    hi.append(mix(h, 61).sum(dtype=np.uint64))
                    found.append(keys(h, bands))
                offsets = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, k), b.column(2).slice(at, k), pa.array(n, pa.int64()),
                     *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (lo, hi)),
                     pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))],
                    names=["id", "th", "n", "lo", "hi", "keys"])
    id_type = rows.schema["id"].dataType.simpleString()
    return stored(rows.mapInArrow(run, f"id {id_type}, th bigint, n bigint, lo bigint, hi bigint, keys array<bigint>"), "signed")


def _candidates(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes that share a part with another one, with ``grp``, the same for all that hang together, and a number ``node``."""
    filed = signed.select("lo", F.explode("keys").alias("key"))
    shared = filed.groupBy("key").agg(F.min("lo").alias("a"), F.max("lo").alias("z")).filter("a < z").select("key", "a")
    # the tables grow with the corpus: never broadcast, and both sides may be split
    edges = filed.join(stored(shared, "shared").hint("merge"), "key").filter("lo > a").select("a", F.col("lo").alias("b")).distinct()
    roots = connected_components(edges)
    c = classes.join(roots.select(F.col("node").alias("lo"), F.col("root").alias("grp")).hint("merge"), "lo")
    return stored(c.withColumn("node", F.monotonically_increasing_id()), "candidates")


def _tiles(cand: DataFrame, percent: int, shingles_held: int, sets_held: int) -> DataFrame:
    """Candidates with ``tiles``, an array of tiles and the side of the tile on which the set is."""
    most = cand.agg(F.max("n")).first()[0] or 1
    bands = Bands(percent, most)
    edges = bands.edges[bands.edges <= most].tolist()
    # a logarithmic number of band edges, as literals
    band = sum((F.col("n") >= e).cast("int") for e in edges) - 1
    c = cand.withColumn("band", band)
    size = lambda: (F.sum("n") / shingles_held, F.count(F.lit(1)) / sets_held)
    whole = c.groupBy("grp").agg((F.greatest(*size()) <= 1).alias("fits"))
    slices = stored(c.groupBy("grp", "band").agg(F.ceil(F.greatest(*size())).cast("int").alias("k")), "slices")

    def of(shift: int, name: str) -> DataFrame:
        return slices.select("grp", (F.col("band") + shift).alias("band"), F.col("k").alias(name))
    c = c.join(whole, "grp").join(of(0, "k"), ["grp", "band"]).join(of(-1, "above"), ["grp", "band"], "left").join(
        of(1, "below"), ["grp", "band"], "left")
    own = F.pmod(F.xxhash64("lo", "hi"), F.col("k")).cast("int").alias("own")
    c = c.withColumn("own", own)

    def tile(b1: Column, s1: Column, b2: Column, s2: Column, side: Column) -> Column:
        return F.struct(F.col("grp").alias("grp"), b1.cast("int").alias("b1"), s1.cast("int").alias("s1"), b2.cast("int").alias("b2"),
                        s2.cast("int").alias("s2"), side.cast("int").alias("side"))
    mine, b = F.col("own"), F.col("band")

    def to(k: str) -> Column:
        return F.sequence(F.lit(0), F.col(k) - 1)
    inside = F.transform(to("k"), lambda t: tile(b, F.least(mine, t), b, F.greatest(mine, t), (mine > t)))
    higher = F.when(F.col("above").isNotNull(), F.transform(to("above"), lambda t: tile(b, mine, b + 1, t, F.lit(0))))
    lower = F.when(F.col("below").isNotNull(), F.transform(to("below"), lambda t: tile(b - 1, t, b, mine, F.lit(1))))
    one = F.array(tile(F.lit(-1), F.lit(0), F.lit(-1), F.lit(0), F.lit(0)))
    empty = F.slice(one, 1, 0)
    tiles = F.when(F.col("fits"), one).otherwise(F.concat(inside, F.coalesce(higher, empty), F.coalesce(lower, empty)))
    return c.select("node", "n", "size", "src", tiles.alias("tiles"))


TILE = "grp bigint, b1 int, s1 int, b2 int, s2 int, side int"


def _placed(rows: DataFrame, tiled: DataFrame, width: int) -> DataFrame:
    """The sets as sorted arrays, once for each tile: one text of every class is read again."""
    t = rows.withColumnRenamed("th", "text_hash").join(
        tiled.select(F.col("src.th").alias("th"), F.col("src.id").alias("sid"), "node", "size", "tiles").hint("merge"),
        (F.col("text_hash") == F.col("th")) & F.col("id").eqNullSafe(F.col("sid"))).select("t", "node", "size", "tiles")

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            node, size, tiles = (b.column(i).to_pylist() for i in range(1, 4))
            out, held = [], 0
            for i in range(b.num_rows):
                h = shingles(utf8(b.column(0).slice(i, 1))[0], width, hashes)
                for t in tiles[i]:
                    out.append((*t.values(), node[i], size[i], len(h), h.tobytes()))
                    held += h.nbytes
                    if held > 1 << 23:
                        yield batch(out)
                        out, held = [], 0
            if out:
                yield batch(out)

    kinds = [pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["grp", "b1", "s1", "b2", "s2", "side", "node", "size", "n", "h"]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names=names)
    return t.mapInArrow(run, TILE + ", node bigint, size bigint, n bigint, h binary")


class Tile:
    """Sets of one tile, by rising size: arrays of distinct hashes, their sides, and bitmaps."""

    def __init__(self, sets: list[np.ndarray], side: np.ndarray, cross: bool, percent: int):
        self.n = np.array([len(s) for s in sets], np.int64)
        self.side, self.cross, self.percent = side, cross, percent
        flat = np.concatenate(sets)
        self.start = np.cumsum(self.n) - self.n
        bits = 1 << max(9, int(2 * self.n.max()).bit_length())
        owner = np.repeat(np.arange(len(sets)), self.n)
        bit = (mix(flat, 80) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
        self.bitmap = np.zeros((len(sets), bits // 64), np.uint64)
        np.bitwise_or.at(self.bitmap, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
        found, self.rank = np.unique(flat, return_inverse=True)
        self.mark = np.zeros(len(found), bool)

    def links(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Later sets that link with set i, and the sizes of the intersections."""
        n, p = self.n, self.percent
        end = int(np.searchsorted(n, n[i] * 100 // p, "right"))
        j = np.arange(i + 1, end)
        if self.cross:
            j = j[self.side[j] != self.side[i]]
        if not len(j):
            return j, j
        differ = np.bitwise_count(self.bitmap[j] ^ self.bitmap[i]).sum(axis=1, dtype=np.int64)
        both = n[i] + n[j]
        j = j[((both - differ) // 2) * (100 + p) >= p * both]  # the most that the two can share
        if not len(j):
            return j, j
        mine = self.rank[self.start[i]:self.start[i] + n[i]]
        self.mark[mine] = True
        first = np.cumsum(n[j]) - n[j]
        flat = np.repeat(self.start[j] - first, n[j]) + np.arange(int(n[j].sum()))
        shared = np.add.reduceat(self.mark[self.rank[flat]], first, dtype=np.int64)
        self.mark[mine] = False
        hit = shared * (100 + p) >= p * (n[i] + n[j])
        return j[hit], shared[hit]


def _groups(batches):
    """Rows of one tile at a time, from batches sorted by tile."""
    last, held = None, []
    for b in batches:
        where = list(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
        lo = 0
        for hi in range(1, len(where) + 1):
            if hi < len(where) and where[hi] == where[lo]:
                continue
            if where[lo] != last and held:
                yield last, held
                held = []
            last = where[lo]
            held.append(b.slice(lo, hi - lo))
            lo = hi
    if held:
        yield last, held


def _met(placed: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Links of every tile: ``node, links, root`` of the sets that have any, or all ``a, b, shared``."""
    key = ["grp", "b1", "s1", "b2", "s2"]
    rows = placed.repartition(*key).sortWithinPartitions(*key, "n", "node")

    def run(batches):
        for where, held in _groups(batches):
            side, node, size = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (5, 6, 7))
            sets = [np.frombuffer(s, np.uint64) for x in held for s in x.column(9).to_pylist()]
            one = np.concatenate(([True], node[1:] != node[:-1]))  # a row stored twice is one set
            side, node, size, sets = side[one], node[one], size[one], [s for s, k in zip(sets, one, strict=True) if k]
            if len(sets) < 2:
                continue
            tile = Tile(sets, side, where[1:3] != where[3:5], percent)
            links, label = np.zeros(len(sets), np.int64), np.arange(len(sets))
            for i in range(len(sets)):
                j, shared = tile.links(i)
                if not len(j):
                    continue
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([node[i]] * len(j), pa.int64()), pa.array(node[j]), pa.array(shared)],
                                                     names=["a", "b", "shared"])
                    continue
                links[i] += size[j].sum()
                links[j] += size[i]
                known = np.unique(label[np.append(j, i)])
                if len(known) > 1:
                    label[np.isin(label, known)] = known[0]
            hit = links > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[label[hit]])],
                                                 names=["node", "links", "root"])
    return rows.mapInArrow(run, "a bigint, b bigint, shared bigint" if pairs else "node bigint, links bigint, root bigint")


def _classes(signed: DataFrame) -> DataFrame:
    return stored(signed.filter("n > 0").groupBy("lo", "hi", "n").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.min(F.struct("th", "id")).alias("src")), "classes")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90,
               shingles_held: int = SLICE_SHINGLES, sets_held: int = SLICE_SETS) -> DataFrame:
    """id, ``n_shingles``, ``component_id`` (smallest id that links reach, the own one included) and ``n_links`` of every row."""
    rows = _binary(docs, id_col, text_col)
    signed = _signed(rows, width, percent)
    classes = _classes(signed)
    cand = _candidates(signed, classes)
    placed = _placed(rows, _tiles(cand, percent, shingles_held, sets_held), width)
    found = stored(_met(placed, percent, False), "found")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    more = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = stored(cand.select("lo", "hi", "n", "node", "least").join(more, "node").join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")), "linked")
    least = stored(linked.groupBy("root").agg(F.min("least").alias("all_least")), "least")
    known = linked.join(least, "root").select("lo", "hi", "n", "links", "all_least")
    owner = stored(classes.join(known.hint("merge"), ["lo", "hi", "n"], "left").select(
        "lo", "hi", "n", F.coalesce("all_least", "least").alias("component_id"),
        (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "owner")
    out = signed.select("id", "n", "lo", "hi").join(owner.hint("merge"), ["lo", "hi", "n"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
                      F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90,
                  shingles_held: int = SLICE_SHINGLES, sets_held: int = SLICE_SETS) -> tuple[DataFrame, DataFrame]:
    """All linked pairs of different sets (``a, b, shared, total``: class numbers, sizes of intersection and union), and the members of each class.

    Members are ``class, id, n_shingles``; classes that link with no other are left out.
    """
    rows = _binary(docs, id_col, text_col)
    signed = _signed(rows, width, percent)
    cand = _candidates(signed, _classes(signed))
    found = stored(_met(_placed(rows, _tiles(cand, percent, shingles_held, sets_held), width), percent, True), "pairs")
    sizes = cand.select("node", "n")
    pairs = found.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").select(
        "a", "b", "shared", (F.col("na") + F.col("nb") - F.col("shared")).alias("total"))
    used = found.select("a").union(found.select("b")).distinct().withColumnRenamed("a", "node")
    members = signed.join(cand.join(used, "node").select("lo", "hi", "n", "node").hint("merge"), ["lo", "hi", "n"])
    return pairs, members.select(F.col("node").alias("class"), F.col("id").alias(id_col), F.col("n").alias("n_shingles"))
