"""Spelling variants: all words one insertion, deletion or replacement apart, by a dictionary of trie-node pairs.

The nodes of a trie over all words (one node a prefix) and of a trie over all reversed words (one node a suffix) are
numbered. A word is then known at each of its cuts by a pair of integers (prefix node, suffix node), and a word with
one position skipped is known by such a pair too. Two skipped words share a pair exactly if they differ in that one
position; a skipped word and a whole word share a pair exactly if the second is the first without that position. An
equality join on pairs therefore finds all neighbours and nothing else, without a comparison of letters.
A letter out of a run of equal letters is skipped at the first of them only, so that every neighbour is met once.

A pair has at most one whole word, and at most one skipped word for each letter of the alphabet: groups are small
whatever the data, and no key can be hot. Neighbours are counted inside these groups; no list of pairs is made.

Numbering goes over words in sorted order, range by range: a word adds one node for each position past the prefix
that it shares with the word before. What reaches the driver is one row a range, with its first and last word, to give the
prefixes that cross a border one number.

Defined results: null texts have no words; a null id counts as empty text in the id; repeated rows count once each; bytes that
are not valid UTF-8 end a word. Ties between neighbours of one count go to the word that is smaller in code-point order. A very long text
is read run by run; a very long word costs memory in proportion to its length. An empty table gives an empty result. Columns beside id and
text are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lendframe.llm.common import stored, tasks, utf8

#: A word: letters of the basic alphabet and U+00C0 to U+00FF, after A-Z were lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
FLUSH = 200_000  # words counted in a task before their counts are sent on
LONG_TEXT = 1 << 22  # longer texts are not listed word by word at once
ROOT = -1  # node of the empty prefix
RANGE = 1 << 40  # nodes or words a range may have


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least_n: int = 3,
                typo_every: int | None = None) -> DataFrame:
    """``word, n`` of the words of at least that length and number.

    ``typo_every``: one in that many (id, word) pairs, chosen by CRC-32 of ``<id>:<word>``, loses the letter that the hash names.
    """
    def run(batches):
        counts: Counter[str] = Counter()

        def out():
            words = [w for w in counts if len(w) >= least_length]
            r = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())],
                                           names=["word", "n"])
            counts.clear()
            return r
        for b in batches:
            for key, raw in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                text = raw.lower().decode("utf-8", "replace")
                found = Counter(RUN.findall(text) if len(text) < LONG_TEXT else (m.group() for m in RUN.finditer(text)))
                if typo_every is None:
                    counts.update(found)
                else:
                    seed = zlib.crc32(f"{key}:".encode())
                    for w, n in found.items():
                        h = zlib.crc32(w.encode(), seed)
                        if h % typo_every == 0:
                            i = h % len(w)
                            w = w[:i] + w[i + 1:]
                        counts[w] += n
                if len(counts) > FLUSH:
                    yield out()
        if counts:
            yield out()
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    parts = rows.mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def number_nodes(words: DataFrame, name: str) -> DataFrame:
    """``word, at, nodes`` and the other columns of distinct ``word``: its place in sorted order, and the numbers of its prefixes by length."""
    def run(batches):
        part, last, stack, n_nodes, n_words = TaskContext.get().partitionId(), "", [], 0, 0
        for b in batches:
            nodes = []
            for w in b.column(0).to_pylist():
                keep = shared_prefix(last, w)
                stack = stack[:keep] + list(range(n_nodes, n_nodes + len(w) - keep))
                n_nodes += len(w) - keep
                last = w
                nodes.append(stack)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([part] * k, pa.int64()), pa.array(range(n_words, n_words + k), pa.int64()),
                 pa.array(nodes, pa.list_(pa.int64()))], names=[*cols, "part", "row", "nodes"])
            n_words += k
    cols = ["word", *[c for c in words.columns if c != "word"]]
    fields = ", ".join(f"{c} {t}" for c, t in words.select(*cols).dtypes)
    ordered = words.select(*cols).repartitionByRange(tasks(words.sparkSession), "word").sortWithinPartitions("word")
    local = stored(ordered.mapInArrow(run, f"{fields}, part bigint, row bigint, nodes array<bigint>"), name)

    ends = local.groupBy("part").agg(F.min("word").alias("first"), F.max("word").alias("last"), F.max_by("nodes", "word").alias("stack"))
    border, last, stack = [], "", []
    for r in sorted(ends.collect()):  # one row a range
        # the first word of a range numbers its prefixes 0, 1, ...; those it shares with the range before have a number already
        known = stack[:shared_prefix(last, r["first"])]
        border.append((r["part"], known))
        stack = [known[x] if x < len(known) else r["part"] * RANGE + x for x in r["stack"]]
        last = r["last"]
    known = F.broadcast(words.sparkSession.createDataFrame(border, "part bigint, known array<bigint>"))  # one row a range
    nodes = F.transform("nodes", lambda x: F.when(x < F.size("known"), F.get("known", x.cast("int"))).otherwise(F.col("part") * RANGE + x))
    return local.join(known, "part").select(*cols, (F.col("part") * RANGE + F.col("row")).alias("at"), nodes.alias("nodes"))


def neighbours(words: DataFrame) -> DataFrame:
    """``at, word, n, n_near, best`` of distinct ``word, n``: the number of near words, and (-n, at) of the commonest."""
    forward = stored(number_nodes(words.select("word", "n"), "forward"), "prefixes")
    back = number_nodes(forward.select(F.reverse("word").alias("word"), F.col("at").alias("id")), "backward")
    both = forward.join(back.select(F.col("id").alias("at"), F.col("nodes").alias("suffixes")), "at")

    root = F.array(F.lit(ROOT).cast("bigint"))
    both = both.select("at", "n", F.split("word", "").alias("l"), F.concat(root, "nodes").alias("p"), F.concat(root, "suffixes").alias("s"))
    length = F.size("p") - 1

    def first_of_run(i: Column) -> Column:
        return (i == 0) | (F.get("l", i) != F.get("l", i - 1))
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("p", i).alias("p"), F.get("s", length - i).alias("s"), F.lit(0).alias("kind")))
    skipped = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("p", i).alias("p"), F.get("s", length - 1 - i).alias("s"), F.when(first_of_run(i), 2).otherwise(1).alias("kind")))
    pairs = both.select("at", "n", F.explode(F.concat(whole, skipped)).alias("x")).select("x.p", "x.s", "at", "n", "x.kind")

    member = F.struct((-F.col("n")).alias("o"), "at", "kind")
    met = pairs.groupBy("p", "s").agg(F.collect_list(member).alias("m")).filter(F.size("m") > 1)  # one whole word, one a letter
    met = met.select(F.sort_array("m").alias("m")).select(
        "m", F.filter("m", lambda x: x["kind"] > 0).alias("swapped"), F.filter("m", lambda x: x["kind"] == 2).alias("longer"))

    def met_by(x: Column, group: str) -> Column:
        return F.struct(x["at"].alias("at"), F.size(group).alias("near"), F.get(group, F.lit(0)).alias("best"))

    def met_inside(x: Column, group: str) -> Column:
        best = F.when(F.get(group, F.lit(0))["at"] == x["at"], F.get(group, F.lit(1))).otherwise(F.get(group, F.lit(0)))
        return F.struct(x["at"].alias("at"), (F.size(group) - 1).alias("near"), best.alias("best"))
    # a whole word meets those skipped at the first of a run, these meet all members, and the other skipped words meet all skipped ones
    found = met.select(F.explode(F.transform("m", lambda x: F.when(x["kind"] == 0, met_by(x, "longer")).when(
        x["kind"] == 1, met_inside(x, "swapped")).otherwise(met_inside(x, "m")))).alias("y"))
    found = found.filter("y.near > 0").groupBy("y.at").agg(
        F.sum("y.near").alias("n_near"), F.min(F.struct("y.best.o", "y.best.at")).alias("best"))
    return forward.select("at", "word", "n").join(found, "at", "left").select(
        "at", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "best")


def forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: the commonest near word if it is ``ratio`` times as common, and the last form of the chain."""
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")  # chains then rise and end
    near = neighbours(words)
    form_n = -F.col("best.o")
    near = stored(near.select("at", "word", "n", "n_near", F.when(form_n >= ratio * F.col("n"), F.struct(
        F.col("best.at").alias("at"), form_n.alias("n"))).alias("f")), "near")
    # pointer jumps: counts at least double along a chain, so it has at most 63 steps and needs 6 jumps
    up = near.filter("f is not null").select("at", F.col("f.at").alias("up"))
    while True:
        ahead = up.select(F.col("at").alias("up"), F.col("up").alias("next"))
        up = stored(up.join(ahead, "up", "left").select("at", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
        if up.filter("moved").isEmpty():
            break
        up = up.select("at", "up")
    names = near.select("at", "word")
    out = near.join(up.select("at", "up"), "at", "left")
    out = out.join(names.toDF("form_at", "form"), F.col("f.at") == F.col("form_at"), "left")
    out = out.join(names.toDF("root_at", "root"), F.col("up") == F.col("root_at"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", F.col("f.n").alias("form_n"))
