r"""Chat formatting as a prefix tree.

Each turn becomes a piece of text: a mark for its role, the text, and a closing mark. Marks are fixed strings; where a text holds one, a
backslash is put after its first character, and where it holds one with backslashes there, one more, so the original comes back.

Conversations that begin with the same turns share the nodes of these turns. All nodes are emitted once, in one stream ordered depth first:
a node stands before its descendants and these before its siblings. Orders are by path digests, in blocks of BLOCK turns so that no key grows with
a conversation: nodes deeper than BLOCK come after all shallower ones, grouped by the path of the block before. A node has

* ``start`` and ``size``: its place in the stream, in characters (code points);
* ``position``: the position id of its first character, that is what all its ancestors hold together, so ids go on along every path;
* ``attends``: the intervals of the stream that its ancestors in its block fill, merged where they touch; ``context``: the start of the last
  ancestor outside the block (null in the first one), whose own intervals go on from there;
* ``loss_from``, ``loss_to``: the part of the stream to learn from (texts of the assistant, without marks), null elsewhere.

``links`` says which node each turn of each conversation became. The stream's offsets are sums over sorted partitions; the driver sees one
number for each task. Reading back, a conversation is a sorted stream of rows in one task, because its digests are sequential; it
is never held whole.

Nulls: null roles and texts are empty, a null turn comes first, rows with a null conv_id are one conversation without an id. Ties in turn are
ordered by role, then by the first 100 characters and a digest of the text; repeated rows are turns of their own. An empty
table gives an empty result. Other columns are ignored. The id -2**63 is taken as null.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ..session import task_count
from .common import written
from .turns import HASH, NO_ID, ordered_turns, plain_turns

# The marks of the template.
OPEN_USER, CLOSE_USER = "[INST] ", " [/INST]"
OPEN_SYSTEM, CLOSE_SYSTEM = "<<SYS>>\n", "\n<</SYS>>\n\n"
OPEN_ROLE, CLOSE_NAME, CLOSE_ROLE = "[ROLE]", "[/ROLE]", "</s>"
LEARNED = "assistant"
BLOCK = 64

_MARK = r"(<)(\\*)(/?s>|</?SYS>>)|(\[)(\\*)(/?(?:INST|ROLE)\])"
_ESCAPED = re.compile(r"(<)\\(\\*)(/?s>|</?SYS>>)|(\[)\\(\\*)(/?(?:INST|ROLE)\])")
_SPAN = "struct<from:bigint,to:bigint>"


def escaped(column):
    return F.regexp_replace(column, F.lit(_MARK), F.lit(r"$1$4\\$2$5$3$6"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\4\2\5\3\6", text) if "\\" in text else text


def formatted(role, text):
    """The piece of one turn, and where in it the text begins and how long it is there."""
    inner = escaped(text)
    opening = F.when(role == "user", F.lit(OPEN_USER)).when(role == "system", F.lit(OPEN_SYSTEM)).otherwise(
        F.concat(F.lit(OPEN_ROLE), escaped(role), F.lit(CLOSE_NAME)))
    closing = F.when(role == "user", F.lit(CLOSE_USER)).when(role == "system", F.lit(CLOSE_SYSTEM)).otherwise(F.lit(CLOSE_ROLE))
    return F.concat(opening, inner, closing), F.char_length(opening), F.char_length(inner)


def parsed(piece: str):
    """(role, text) of a piece."""
    if piece.startswith(OPEN_USER):
        return "user", unescaped(piece[len(OPEN_USER):-len(CLOSE_USER)])
    if piece.startswith(OPEN_SYSTEM):
        return "system", unescaped(piece[len(OPEN_SYSTEM):-len(CLOSE_SYSTEM)])
    role, text = piece[len(OPEN_ROLE):-len(CLOSE_ROLE)].split(CLOSE_NAME, 1)
    return unescaped(role), unescaped(text)


def _offsets(rows, order):
    """Rows in the given order over all partitions, with ``start``: the sum of ``size`` of all rows before."""
    names = [*rows.columns, "part", "start"]

    def run(batches):
        from pyspark import TaskContext
        import numpy as np
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = np.cumsum(batch.column("size").to_numpy(zero_copy_only=False)) + total
            start = np.append(total, ends[:-1])[:batch.num_rows]
            total = int(ends[-1]) if batch.num_rows else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(start)], names=names)

    schema = ", ".join([f"`{n}` {t}" for n, t in rows.dtypes] + ["part bigint", "start bigint"])
    local = written(rows.repartitionByRange(task_count(rows), *order).sortWithinPartitions(*order).mapInArrow(run, schema), "chat-stream")
    totals = sorted(map(tuple, local.groupBy("part").agg(F.max(F.col("start") + F.col("size")).alias("n")).collect()))
    before, carry = 0, []
    for part, n in totals:
        carry.append((part, before))
        before += n
    carry = rows.sparkSession.createDataFrame(carry, "part bigint, before bigint")
    return local.join(F.broadcast(carry), "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def prefix_tree(conversations, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """(stream, links), both written: the nodes once each, and conv, turn number (from 1) and start of the node for every turn."""
    turns = plain_turns(conversations, conv_col, turn_col, role_col, text_col).withColumn("conv", F.coalesce("conv", F.lit(NO_ID)))
    piece, at, inner = formatted(F.col("role"), F.col("text"))
    turns = turns.select("*", piece.alias("piece"), at.cast("bigint").alias("at"), inner.cast("bigint").alias("inner"),
                         (F.col("t0") * (1 << 28) + F.col("t1")).alias("name")).drop("text").withColumn("size", F.char_length("piece").cast("bigint"))
    rows = ordered_turns(turns, ["size"], "chat-turns").withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    keys = rows.select("conv", "pos", *HASH, "block", "name", "p1", "p2")
    owned = keys.groupBy("pos", *HASH).agg(F.min("conv").alias("conv"))
    blocks = keys.groupBy("conv", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("names"), F.min(F.struct("pos", "p1", "p2")).alias("top"))
    nodes = rows.join(owned.select("conv", "pos"), ["conv", "pos"], "left_semi").join(blocks, ["conv", "block"])
    inside = (F.col("pos") - F.col("block") * BLOCK).cast("int")
    nodes = nodes.select(
        "block", F.col("top.p1").alias("r1"), F.col("top.p2").alias("r2"), F.slice("names.name", 1, inside).alias("way"), *HASH, "conv", "pos", "size",
        (F.col("sum_size") - F.col("size")).alias("position"), F.when(F.col("role") == LEARNED, F.col("at")).alias("at"), "inner", "piece")
    placed = written(_offsets(nodes, ["block", "r1", "r2", "way", *HASH]).drop("r1", "r2", "way"), "chat-nodes")
    links = written(keys.select("conv", "pos", *HASH, "block").join(placed.select("pos", *HASH, "start", "size"), ["pos", *HASH]).drop(*HASH), "chat-links")
    ways = links.groupBy("conv", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "size"))).alias("way"))
    outside = links.filter(F.col("pos") % BLOCK == 0).select("conv", (F.col("block") + 1).alias("block"), F.col("start").alias("context"))
    stream = placed.join(ways, ["conv", "block"]).join(outside, ["conv", "block"], "left")
    attends = F.expr(f"""aggregate(filter(way, w -> w.pos < pos), cast(array() AS array<{_SPAN}>), (a, w) -> CASE
        WHEN size(a) > 0 AND element_at(a, -1).to = w.start
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('from', element_at(a, -1).from, 'to', w.start + w.size)))
        ELSE concat(a, array(named_struct('from', w.start, 'to', w.start + w.size))) END)""")
    loss = F.col("start") + F.col("at")
    stream = stream.select("start", "size", F.col("pos").alias("depth"), "position", attends.alias("attends"), "context",
                           loss.alias("loss_from"), F.when(F.col("at").isNotNull(), loss + F.col("inner")).alias("loss_to"), "piece")
    return written(stream, "chat-tree"), links.select("conv", "pos", "start")


def read_back(stream, links):
    """What each conversation says, read from the stream: counts and digests."""
    def run(batches):
        conv, state = None, None
        for batch in batches:
            done = []
            for c, start, piece, low, high in zip(*[batch.column(x).to_pylist() for x in ("conv", "start", "piece", "loss_from", "loss_to")]):
                if state is None or c != conv:
                    done += [_row(conv, state)] if state else []
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parsed(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if low is not None:
                    learned = unescaped(piece[low - start:high - start])
                    state[2] += len(learned)
                    state[3].update(learned.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if done:
                yield _rows(done)
        if state:
            yield _rows([_row(conv, state)])

    text = stream.select("start", "piece", "loss_from", "loss_to")
    rows = links.join(text, "start").repartition(task_count(links), "conv").sortWithinPartitions("conv", "pos")
    return rows.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def _row(conv, state):
    n, turns, chars, loss, size = state
    return None if conv == NO_ID else conv, n, turns.hexdigest(), chars, loss.hexdigest(), size


def _rows(done):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)


def chat_digests(conversations):
    """Formats all conversations and reads them back."""
    return read_back(*prefix_tree(conversations))
