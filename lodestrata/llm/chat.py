"""Chat formatting into a prefix tree: conversations that begin with the same turns share those turns' tokens.

A turn is written ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts (these, and the
``<s> </s> [INST] [/INST]`` of other templates) get one backslash after their first character; strings that already
look escaped get one more, so reading back is exact. A token is a code point of the written text.

A node of the tree is a conversation's first turns up to one turn; its key is a hash chained over those turns. Nodes
are emitted once, in depth-first order over the whole forest, with the offset of their first token in that stream,
the position id that token has in its conversations (the next tokens have the next ids; ``tokens`` writes them out),
and the intervals of the stream that it attends to: those of its ancestors (merged where they touch) and its own,
causally. A conversation is read back from the stream by the intervals of its last node alone.

Nodes that follow each other without branching are a chain. A node's place in the order is the path of the chains on
its way and its depth, so a long conversation that shares nothing has a path of one chain, not of all its turns: a
path gets longer only where other conversations branch off.

Everything is sorted and scanned in ranges, so a first turn that very many conversations share is no single group:
the tree is never held, only the chains on the way to the current node. A conversation's own turns are read in order
by one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, task_count

TURN, TEXT, STOP = "<|turn|>", "<|text|>", "<|end|>"
CONTROL = re.compile(r"([<\[])(\\*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(\||/?s>|/?INST\])")
WRITTEN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(STOP), re.DOTALL)
#: Bytes of each chain's hash in the key that sorts the nodes.
STEP = 8
#: Code points of the stream that share a key where intervals look up their nodes.
REACH = 1 << 12


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def write_turn(role: str, text: str) -> str:
    return TURN + escape(role) + TEXT + escape(text) + STOP


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns arrive sorted by conversation and turn; each gets its node's key, the key of the node before it (null for a
    first turn) and its place in the conversation."""
    names = ["conv_id", "place", "node", "parent", "written", "position", "loss"]
    conv, started = None, False
    node, place, position = None, 0, 0
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for own, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not started or own != conv:
                conv, started, node, place, position = own, True, None, 0, 0
            written = write_turn(role, text)
            parent, node = node, hashlib.sha256((node or b"") + written.encode("utf-8", "surrogatepass")).digest()[:16]
            for column, value in zip(out, (own, place, node, parent, written, position, role == "assistant"), strict=True):
                column.append(value)
            place, position = place + 1, position + len(written)
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, node, parent, written, position, loss): each turn written out, with the keys of its node and of
    the node before it.

    Turns follow each other by ``turn_col`` (null first), those of equal number by role and text; null roles and texts
    are empty; null conversation ids are one conversation. Other columns are not read.
    """
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_chain, "conv_id long, place long, node binary, parent binary, written string, position long, loss boolean")


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns (conv_id, node, head) arrive in order; those that stand for their node get the path of chains up to it."""
    names = ["node", "path"]
    conv, started, path = None, False, b""
    for batch in batches:
        nodes, paths = [], []
        for own, node, head, first in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if not started or own != conv:
                conv, started, path = own, True, b""
            if head:
                path += node[:STEP]
            if first:
                nodes.append(node)
                paths.append(path)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(paths, pa.binary())], names)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _join_touching(spans: Column) -> Column:
    def step(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), s["end"].alias("end"))))
        return F.when(last["end"] == s["start"], longer).otherwise(F.concat(out, F.array(s)))

    return F.aggregate(spans, F.slice(spans, 1, 0), step)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (node, levels of its path, head of its chain, size) arrive in depth-first order. Offsets and the chains on
    the way are counted from this task's first node; ``before`` is the number of chains of the way that begin in
    earlier tasks, the last of which may go on here (``goes_on``). The last row (node null) tells where the task ended."""
    names = ["node", "part", "start", "size", "before", "goes_on", "ancestors"]
    part, at, seen = TaskContext.get().partitionId(), 0, False
    stack: list[tuple[int, int]] = []  # of each chain on the way what this task has seen of it
    before, goes_on = 0, False
    for batch in batches:
        out: list[list] = [[] for _ in names]
        for node, levels, head, size in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            on_way = levels - head  # chains that stand before this node
            if not seen:
                before, goes_on, seen = on_way, not head, True
            elif on_way < before:
                before, goes_on, stack = on_way, False, []
            else:
                del stack[on_way - before + goes_on :]
            for column, value in zip(out, (node, part, at, size, before, goes_on, [{"start": a, "end": b} for a, b in _merged(stack)]), strict=True):
                column.append(value)
            if head or not stack:
                stack.append((at, at + size))
            else:
                stack[-1] = (stack[-1][0], at + size)
            at += size
        yield _walked(out, names)
    if seen:
        yield _walked([[None], [part], [at], [0], [before], [goes_on], [[{"start": a, "end": b} for a, b in stack]]], names)


def _walked(out: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), SPANS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)


def prefix_tree(told: DataFrame) -> DataFrame:
    """From ``turns``: one row per node, (node, depth, conversations, offset, size, position, attends, written, loss).

    ``attends``: the ancestors' intervals of the emitted stream, in order. ``position``: the id of the node's first
    token. Sort by ``offset`` for the stream itself.
    """
    stands = F.min(F.struct("conv_id", "place"))  # the turn that stands for its node
    nodes = told.groupBy("node").agg(F.first("parent").alias("parent"), F.first("place").alias("depth"), F.first("written").alias("written"), F.first("position").alias("position"), F.first("loss").alias("loss"), F.count("*").alias("conversations"), stands.alias("stands"))
    nodes = cut(nodes, "nodes")
    alone = nodes.where("parent is not null").groupBy(F.col("parent").alias("node_before")).agg(F.count("*").alias("n"), F.first("node").alias("node")).where("n = 1").select("node", F.lit(False).alias("head"))
    kinds = cut(nodes.join(alone, "node", "left").select("node", F.coalesce("head", F.lit(True)).alias("head"), "stands"), "kinds")
    rows = told.select("conv_id", "place", "node").join(kinds, "node").select("conv_id", "place", "node", "head", F.struct("conv_id", "place").eqNullSafe(F.col("stands")).alias("first"))
    paths = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "node", "head", "first").mapInArrow(_paths, "node binary, path binary")
    order = nodes.select("node", "depth", F.length("written").cast("long").alias("size")).join(paths, "node").join(kinds.select("node", "head"), "node")
    order = order.repartitionByRange(task_count(told.sparkSession), "path", "depth").sortWithinPartitions("path", "depth")
    order = order.select("node", (F.length("path") / STEP).cast("int").alias("levels"), F.col("head").cast("int").alias("head"), "size")
    walked = cut(order.mapInArrow(_walk, "node binary, part int, start long, size long, before int, goes_on boolean, ancestors array<struct<start:long,end:long>>"), "walked")
    base, open_, starts = 0, [], []
    for end in sorted(walked.where("node is null").collect(), key=lambda r: r.part):  # a row for each task
        starts.append((end.part, base, open_))
        own = [(base + s.start, base + s.end) for s in end.ancestors]
        open_ = open_[: end.before]
        if end.goes_on and own:
            open_, own = [*open_[:-1], (open_[-1][0], own[0][1])], own[1:]
        open_ = open_ + own
        base += end.start
    carried = told.sparkSession.createDataFrame(starts, "part int, base long, open array<struct<start:long,end:long>>")
    moved = F.transform("ancestors", lambda s: F.struct((s["start"] + F.col("base")).alias("start"), (s["end"] + F.col("base")).alias("end")))
    placed = walked.where("node is not null").join(F.broadcast(carried), "part").select("node", (F.col("start") + F.col("base")).alias("offset"), "size", _join_touching(F.concat(F.slice("open", 1, F.col("before")), moved)).alias("attends"))
    return nodes.join(placed, "node").select("node", F.col("depth").cast("int").alias("depth"), "conversations", "offset", "size", "position", "attends", "written", "loss")


def tokens(tree: DataFrame) -> DataFrame:
    """(offset, token, position, loss) of every token of the stream: code points with their position ids."""
    told = tree.select("offset", "position", "loss", F.posexplode(F.split("written", "")).alias("i", "token")).where("token <> ''")
    return told.select((F.col("offset") + F.col("i")).alias("offset"), "token", (F.col("position") + F.col("i")).alias("position"), "loss")


def read_back(told: DataFrame, tree: DataFrame) -> DataFrame:
    """From the emitted stream, per conversation: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, position_sum).

    Of the conversations only the last node is used; what comes before it is read from the stream by the intervals that
    the node attends to. ``position_sum`` adds up the position ids of the first token of each turn.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "position_sum"]
        conv, open_ = None, False
        every, loss, n, m, size, positions = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return batch

        for batch in batches:
            for own, written, position in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if open_ and own != conv:
                    done.append((conv, n, every.hexdigest(), m, loss.hexdigest(), size, positions))
                    every, loss, n, m, size, positions = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
                conv, open_ = own, True
                for role, text in WRITTEN.findall(written):
                    role, text = unescape(role), unescape(text)
                    every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        loss.update(text.encode("utf-8", "surrogatepass"))
                        m += len(text)
                    n += 1
                size, positions = size + len(written), positions + position
            if len(done) > 1000:
                yield out()
        if open_:
            done.append((conv, n, every.hexdigest(), m, loss.hexdigest(), size, positions))
        if done:
            yield out()

    last = told.groupBy("conv_id").agg(F.max_by("node", "place").alias("node"))
    own = F.array(F.struct(F.col("offset").alias("start"), (F.col("offset") + F.col("size")).alias("end")))
    spans = last.join(tree.select("node", "offset", "size", "attends"), "node").select("conv_id", F.explode(F.concat("attends", own)).alias("span"))
    reach = F.explode(F.sequence(F.floor(F.col("span.start") / REACH), F.floor((F.col("span.end") - 1) / REACH)))
    asked = spans.select("conv_id", "span.start", "span.end", reach.alias("reach"))
    stream = tree.select(F.floor(F.col("offset") / REACH).alias("reach"), "offset", "written", "position")
    rows = asked.join(stream, "reach").where("offset >= start and offset < end")
    dealt = rows.select("conv_id", "offset", "written", "position").repartition("conv_id").sortWithinPartitions("conv_id", "offset").select("conv_id", "written", "position")
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, position_sum long")
