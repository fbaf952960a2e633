"""Conversations as a prefix tree of formatted turns.

Conversations that share their first turns share nodes: a node is a distinct sequence of turns from the start. Every
node's tokens are emitted once, in depth-first order, with the position its tokens have in the conversation
and the intervals of the emitted stream that it may attend to (its ancestors), so that a packed batch trains each
shared turn once.

A node belongs to the smallest conversation id that has it. The nodes of one owner form a
chain, and a chain hangs below a node of another owner, so the depth-first order is the order of
``path``: the owners met on the way down, with the depth at which each begins, deepest branch first. Chains, not nodes, are
numbered along the stream, and an ancestor set is one interval per owner on the path.

Template: ``<|role|>``, a line break, the text, ``<|end|>`` and a line break. In texts ``<^*|`` gets one more caret, in
roles ``%``, ``<``, ``>``, ``|`` and line breaks become ``%XX``, so control strings of the template never occur inside and
escapes can be undone.

Rows of one conversation are read in the order of turn, then role and text, as a stream of constant memory; a
shared first turn or a conversation that a third of the ids repeat is only ever counted in partial aggregates or met in
joins of stored tables.

Defined results: null text and null role count as empty. Repeated (conversation, turn) rows are turns of their
own, in order of role and text; null turns come first. Rows with a null conversation id form one conversation. Bytes that are not valid UTF-8 become replacement characters. A very long text is one node, a very long
conversation a stream of rows in one task. An empty table gives an empty tree. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lendframe.llm.common import stored
from lendframe.llm.vocabulary import RANKS, token_bytes, tokenizer

TRAINED_ROLE = "assistant"
END = "<|end|>\n"
_OPEN, _SHUT = re.compile(r"<(\^*)\|"), re.compile(r"<\^(\^*)\|")
_ROLE = re.compile(r"[%<>|\n\r]")
_TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\1^|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def head(role: str) -> str:
    return "<|" + _ROLE.sub(lambda m: f"%{ord(m[0]):02X}", role) + "|>\n"


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    back = lambda r: re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), r)
    return [(back(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _by_conversation(df: DataFrame, order: list) -> DataFrame:
    return df.repartition("conv").sortWithinPartitions("conv", *order)


def _turns(turns: DataFrame) -> DataFrame:
    """Rows with their depth and the hash of all turns up to them: ``conv, depth, role, text, node, parent``."""
    src = turns.select(
        F.col("conv_id").alias("conv"), "turn", F.make_valid_utf8(F.coalesce("role", F.lit(""))).alias("role"),
        F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))
    src = _by_conversation(src, ["turn", "role", "text"]).select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, state, parent = object(), 0, None, None
        for b in batches:
            depths, nodes, parents = [], [], []
            for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != conv or state is None:
                    conv, depth, state, parent = c, 0, hashlib.blake2b(digest_size=16), None
                role, text = r.encode(), t.encode()
                state.update(b"%d:%d:" % (len(role), len(text)) + role + text)
                node = state.digest()
                depths.append(depth)
                nodes.append(node)
                parents.append(parent)
                depth, parent = depth + 1, node
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(depths, pa.int32()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary())],
                names=["conv", "role", "text", "depth", "node", "parent"])
    return src.mapInArrow(run, "conv bigint, role string, text string, depth int, node binary, parent binary")


def _tokens(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``tokens`` of the formatted turn (two bytes each, little-endian) and the half-open token range of its trained text."""
    names = rows.columns

    def run(batches):
        enc = tokenizer(path)
        for b in batches:
            ids, lo, hi = [], [], []
            for r, t in zip(b.column(names.index("role")).to_pylist(), b.column(names.index("text")).to_pylist(), strict=True):
                a, m, z = map(enc.encode_ordinary, (head(r), escape(t), END))
                ids.append(np.array(a + m + z, np.uint16).tobytes())
                lo.append(len(a))
                hi.append(len(a) + (len(m) if r == TRAINED_ROLE else 0))
            keep = [b.column(i) for i, n in enumerate(names) if n not in ("role", "text")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(ids, pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                names=[*[n for n in names if n not in ("role", "text")], "tokens", "loss_start", "loss_stop"])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("role", "text"))
    return rows.mapInArrow(run, kept + ", tokens binary, loss_start int, loss_stop int")


class Tree:
    """``nodes``: the emitted stream, one row per node. ``paths``: node of each conversation at each depth."""

    def __init__(self, nodes: DataFrame, paths: DataFrame):
        self.nodes, self.paths = nodes, paths


def build(turns: DataFrame, tokenizer_file: str = RANKS) -> Tree:
    """``turns``: conv_id, turn, role, text.

    Nodes: ``node, parent, owner, depth, tokens`` (two bytes each, little-endian), ``loss_start, loss_stop`` (token range under the loss mask),
    ``position`` (of the first token in its conversation), ``emit_start`` (in the stream) and
    ``attends`` (half-open stream intervals of all ancestors, top down).
    """
    rows = stored(_turns(turns), "turns")
    owners = stored(rows.groupBy("node").agg(F.min("conv").alias("owner")), "owners")
    own = rows.join(owners, (rows.node == owners.node) & rows.conv.eqNullSafe(owners.owner)).drop(owners.node)
    content = stored(_tokens(own.select("node", "parent", "owner", "depth", "role", "text"), tokenizer_file), "content")

    # each conversation's way down: where a new owner begins, and the positions
    way = rows.select("conv", "depth", "node").join(
        content.select("node", "owner", (F.octet_length("tokens") / 2).cast("int").alias("n")), "node")
    way = stored(_walk(way), "walk")
    mine = way.filter(F.col("conv").eqNullSafe(F.col("owner")))
    chains = mine.groupBy("owner", "path").agg(F.sum("n").alias("n"), F.min("position").alias("first"))
    chains = stored(_emission(chains), "chains")
    begun = mine.select("node", F.explode("begins").alias("b")).select(
        "node", F.col("b.owner").alias("owner"), F.col("b.start").alias("start"), F.col("b.stop").alias("stop"))
    at = chains.select(F.col("owner").alias("c"), "emit", "first")
    spans = begun.join(at, F.col("owner").eqNullSafe(F.col("c"))).select(
        "node", "start", (F.col("emit") + F.col("start") - F.col("first")).alias("lo"),
        (F.col("emit") + F.col("stop") - F.col("first")).alias("hi"))
    spans = spans.filter("hi > lo").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("start", "lo", "hi"))).alias("s"))
    spans = spans.select("node", F.transform("s", lambda x: F.struct(x.lo.alias("start"), x.hi.alias("stop"))).alias("attends"))
    place = mine.select("node", "position", F.col("owner").alias("o")).join(
        at, F.col("o").eqNullSafe(F.col("c"))).select(
        "node", "position", (F.col("emit") + F.col("position") - F.col("first")).alias("emit_start"))
    nodes = content.join(place, "node").join(spans, "node", "left").withColumn(
        "attends", F.coalesce("attends", F.array().cast("array<struct<start:bigint,stop:bigint>>")))
    return Tree(stored(nodes, "nodes"), rows.select("conv", "depth", "node"))


_WALK = ("conv bigint, depth int, node binary, owner bigint, n int, position bigint, "
         "path array<struct<up:int,owner:bigint>>, begins array<struct<owner:bigint,start:bigint,stop:bigint>>")


def _walk(way: DataFrame) -> DataFrame:
    """Positions, owner path and ancestor intervals (in positions) of each row, in one pass per conversation."""
    src = _by_conversation(way.select("conv", "depth", "node", "owner", "n"), ["depth"])

    def run(batches):
        conv, pos, path, begins, started = object(), 0, [], [], False
        for b in batches:
            p_, path_, begins_ = [], [], []
            for c, d, _, o, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if c != conv or not started:
                    conv, pos, path, begins, started = c, 0, [], [], True
                if not path or path[-1]["owner"] != o:
                    path = path + [{"up": -d, "owner": o}]
                    begins = begins + [{"owner": o, "start": pos, "stop": pos}]
                p_.append(pos)
                path_.append(path)
                begins_.append(begins)
                pos += n
                begins = begins[:-1] + [begins[-1] | {"stop": pos}]
            t = pa.list_(pa.struct([("up", pa.int32()), ("owner", pa.int64())]))
            u = pa.list_(pa.struct([("owner", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(p_, pa.int64()), pa.array(path_, t), pa.array(begins_, u)],
                names=["conv", "depth", "node", "owner", "n", "position", "path", "begins"])
    return src.mapInArrow(run, _WALK)


def _emission(chains: DataFrame) -> DataFrame:
    """Stream offset ``emit`` of each chain in path order; sums of the range partitions are the only global step."""
    s = chains.orderBy("path").select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq"))
    s = stored(s, "ordered")
    inside = F.sum("n").over(Window.partitionBy("pid").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    total = s.groupBy("pid").agg(F.sum("n").alias("t"))
    before = total.select("pid", F.coalesce(F.sum("t").over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return s.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "pid").select(
        "owner", "first", (F.col("before") + F.col("inside")).alias("emit"))


def read_back(tree: Tree, tokenizer_file: str = RANKS) -> DataFrame:
    """Each conversation rebuilt from the emitted tokens: counts and digests of turns and of the text under the loss mask."""
    src = tree.paths.join(tree.nodes.select("node", "tokens", "loss_start", "loss_stop"), "node")
    src = _by_conversation(src.select("conv", "depth", "tokens", "loss_start", "loss_stop"), ["depth"])

    def run(batches):
        spelled = token_bytes(tokenizer_file)
        conv, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def row():
            n, turns, chars, loss, formatted = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
        for b in batches:
            done = []
            for c, _, tokens, lo, hi in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        done.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                parts = list(map(spelled.__getitem__, np.frombuffer(tokens, np.uint16).tolist()))
                formatted = b"".join(parts).decode()
                for r, t in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{r}\n{t}\n".encode())
                trained = unescape(b"".join(parts[lo:hi]).decode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += len(formatted)
            if done:
                yield batch(done)
        if state is not None:
            yield batch([row()])
    return src.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
                               "formatted_chars bigint")
