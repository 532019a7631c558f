"""Prefix trie of conversations as a z-fast trie.

Conversations that are equal from end to end are one sequence. A compacted node of the trie is a point where sequences end or part; its
edge covers the depths after the node above it (``p``) up to its own (``e``). It is found in a hash table under its handle: the hash of its
path cut at the two-fattest depth of (p, e]. Sequences are inserted in batches:

* each locates its exit node by fat binary search: probe the two-fattest depth of the open interval, go below the node that is there or above
  the depth where none is; as many rounds as the longest sequence has bits, each a lookup by hash. The exit node is the last node found
  or, if all of its edge is matched, the child under the sequence's next turn. Along the exit edge paths are compared by their
  hashes, which gives the depth ``x`` where the sequence leaves the trie, and the sequence that owns that point;
* those of one batch that leave at one place with the same turn are compared with each other by the hashes of their further paths;
  a sequence that leaves alone ships none of its turns;
* the hash table is made again from the points (owner, depth).

After the last batch every sequence knows how deep others share its path. Nodes down there are put together by hash; below, an edge is
expanded without a shuffle, as each node has one member. What a conversation saves below a node is the words between the node and the
point where it left the trie, so sums over members give saved_tokens and n_leaves with no walk over subtrees.

Paths are hashed as said in ``turns``; texts themselves are not moved. Digests of member lists are streamed from sorted pieces.

Nulls: null roles and texts are empty, a null turn comes first, rows without a conv_id belong to no conversation. Ties in turn are ordered by role,
then by the first 100 characters and a digest of the text; repeated rows are turns of their own. An empty table has no root. Other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import task_count
from .common import written
from .turns import HASH, LANES, ordered_turns, paths, plain_turns

SHARES = (0.125,)  # the first batch has this share of all sequences, the last one the rest
PIECE = 65_536  # characters of a member list that travel as one row
GAP = 4_096  # depths that one task orders at a time for one owner
_KEY = ["d", *HASH]


def _fattest(low, high):
    """The number of (low, high] that has the most trailing zero bits."""
    k = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, k), k)


def _node_table(placed, path):
    """All compacted nodes twice: under their handle (``at`` is f) and under the first turn of their edge (``at`` is p + 1; first); at, h1, h2,
    the node's depth e, and the sequence that owns its edge."""
    points = placed.filter("x >= 1").select(F.col("owner").alias("conv"), F.col("x").alias("e")).unionByName(
        placed.filter("x < m").select(F.col("rep").alias("conv"), F.col("m").alias("e"))).distinct().withColumn("gap", F.floor(F.col("e") / GAP))
    near = Window.partitionBy("conv", "gap").orderBy("e")
    far = points.groupBy("conv", "gap").agg(F.max("e").alias("top")).withColumn("before", F.lag("top").over(Window.partitionBy("conv").orderBy("gap")))
    above = (points.withColumn("near", F.lag("e").over(near)).join(far.select("conv", "gap", "before"), ["conv", "gap"])
             .join(placed.select(F.col("rep").alias("conv"), F.col("x").alias("from_x")), "conv"))
    nodes = above.select(F.col("conv").alias("owner"), "e", F.coalesce("near", "before", "from_x").alias("p"))
    named = nodes.select("owner", "e", F.explode(F.array(
        F.struct(_fattest(F.col("p"), F.col("e")).alias("at"), F.lit(False).alias("first")),
        F.struct((F.col("p") + 1).alias("at"), F.lit(True).alias("first")))).alias("name")).select("owner", "e", "name.*")
    return written(named.join(path.select(F.col("rep").alias("owner"), F.col("d").alias("at"), *HASH), ["owner", "at"]), "trie-nodes")


def _match(state, path):
    """The deepest place up to least(e, m) where a sequence and the owner of the edge it is on agree; they do up to ``x``."""
    edge = state.filter("x < least(e, m)").select("rep", "owner", "x", F.least("e", "m").alias("end"))
    along = edge.join(path, "rep").filter("d > x AND d <= end").select("rep", "owner", *_KEY)
    same = along.join(path.select(F.col("rep").alias("owner"), *_KEY), ["owner", *_KEY]).groupBy("rep").agg(F.max("d").alias("matched"))
    return written(state.join(same, "rep", "left").withColumn("x", F.coalesce("matched", "x")).drop("matched"), "trie-search")


def _locate(pending, nodes, path, longest):
    """rep, m, x, owner: how deep the trie has the path of each sequence, and who owns the edge it leaves."""
    state = pending.select("rep", "m", F.lit(0).cast("bigint").alias("low"), F.col("m").alias("high"), *[
        F.lit(None).cast("bigint").alias(c) for c in ("owner", "f", "e")])
    table = nodes.filter("NOT first").select(F.col("at").alias("probe"), *HASH, F.col("owner").alias("n_owner"), F.col("e").alias("n_e"))
    probes = path.select("rep", F.col("d").alias("probe"), *HASH)
    for _ in range(int(longest).bit_length()):
        state = state.withColumn("probe", F.when(F.col("low") < F.col("high"), _fattest(F.col("low"), F.col("high"))))
        seen = state.filter("probe IS NOT NULL").join(probes, ["rep", "probe"]).join(table, ["probe", *HASH], "left")
        hit = F.col("n_e").isNotNull()
        moved = seen.select(
            "rep", "m", F.when(hit, F.col("n_e")).otherwise(F.col("low")).alias("low"), F.when(hit, F.col("high")).otherwise(F.col("probe") - 1).alias("high"),
            F.coalesce("n_owner", "owner").alias("owner"), F.when(hit, F.col("probe")).otherwise(F.col("f")).alias("f"), F.coalesce("n_e", "e").alias("e"))
        state = written(moved.unionByName(state.filter("probe IS NULL").drop("probe")), "trie-search")
    state = _match(state.select("rep", "m", "owner", "e", F.coalesce("f", F.lit(0).cast("bigint")).alias("x")), path)
    through = state.filter("x = coalesce(e, 0) AND x < m").select("rep", "x").join(path, "rep").filter("d = x + 1").select("rep", *_KEY)
    children = nodes.filter("first").select(F.col("at").alias("d"), *HASH, F.col("owner").alias("c_owner"), F.col("e").alias("c_e"))
    entered = through.join(children, _KEY).select("rep", "c_owner", "c_e", F.col("d").alias("c_x"))
    state = state.join(entered, "rep", "left").select(
        "rep", "m", F.coalesce("c_owner", "owner").alias("owner"), F.coalesce("c_e", "e").alias("e"), F.coalesce("c_x", "x").alias("x"))
    return _match(state, path).select("rep", "m", "x", "owner")


def _insert(exits, path):
    """rep, m, x, owner with the sequences of the batch told apart from each other, too: the smallest id owns what is new to several."""
    first = exits.filter("x < m").select("rep", "x").join(path, "rep").filter("d = x + 1").select("rep", "x", *_KEY)
    crowd = first.groupBy(*_KEY).agg(F.count("*").alias("c")).filter("c > 1").drop("c")
    tails = first.join(crowd, _KEY, "left_semi").select("rep", "x").join(path, "rep").filter("d > x").select("rep", *_KEY)
    tails = written(tails, "trie-tails")
    shared = tails.groupBy(*_KEY).agg(F.min("rep").alias("lead"), F.count("*").alias("c")).filter("c > 1").drop("c")
    later = tails.join(shared, _KEY).filter("lead < rep").groupBy("rep").agg(F.max(F.struct("d", "lead")).alias("at"))
    out = exits.join(later, "rep", "left")
    return written(out.select("rep", "m", F.coalesce("at.d", "x").alias("x"), F.coalesce("at.lead", "owner").alias("owner")), "trie-placed")


def _member_lists(ends):
    """For each whole path (m, h1, h2): its smallest conversation, how many there are, and the digest of their ids in ascending order."""
    key = ["m", *HASH]
    order = [*key, "conv"]

    def pieces(batches):
        held = None
        for batch in batches:
            for m, a, b, c in zip(*[batch.column(x).to_pylist() for x in order]):
                if held and held[:3] == [m, a, b] and held[6] < PIECE:
                    held[4] += 1
                    held[5].append(str(c))
                    held[6] += len(held[5][-1]) + 1
                    continue
                if held:
                    yield _piece(held)
                held = [m, a, b, c, 1, [str(c)], len(str(c))]
        if held:
            yield _piece(held)

    def digests(batches):
        held = None
        for batch in batches:
            for m, a, b, c, n, text in zip(*[batch.column(x).to_pylist() for x in [*key, "first", "n", "text"]]):
                if held and held[:3] == [m, a, b]:
                    held[4] += n
                    held[5].update(b"," + text.encode())
                    continue
                if held:
                    yield _digest(held)
                held = [m, a, b, c, n, hashlib.sha256(text.encode())]
        if held:
            yield _digest(held)

    n = task_count(ends)
    parts = ends.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(
        pieces, "m bigint, h1 bigint, h2 bigint, first bigint, n bigint, text string")
    return parts.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(
        digests, "m bigint, h1 bigint, h2 bigint, rep bigint, k bigint, ends string")


def _piece(held):
    m, a, b, c, n, ids, _ = held
    return pa.RecordBatch.from_pydict({"m": [m], "h1": [a], "h2": [b], "first": [c], "n": [n], "text": [",".join(ids)]})


def _digest(held):
    m, a, b, c, n, sha = held
    return pa.RecordBatch.from_pydict({"m": [m], "h1": [a], "h2": [b], "rep": [c], "k": [n], "ends": [sha.hexdigest()]})


def rebuilt(turns, every=20, most=4):
    """Turns with each conversation's beginning taken from the one that opens its block of ids; conv, side, pos, digest, words; and all ids."""
    convs = turns.select("conv").distinct()
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    opener = F.col("conv") - F.col("conv") % every
    own = turns.filter((F.col("conv") == opener) | (F.col("pos") > borrowed)).withColumn("side", F.lit(1))
    takers = convs.filter(F.col("conv") != opener).select(F.col("conv").alias("taker"), opener.alias("conv"), borrowed.alias("borrowed"))
    given = turns.filter((F.col("conv") == opener) & (F.col("pos") < most)).join(takers, "conv").filter("pos <= borrowed").withColumn("conv", F.col("taker"))
    return own.unionByName(given.drop("taker", "borrowed").withColumn("side", F.lit(0))), convs


def trie(rows, convs, shares=SHARES):
    """The nodes. ``rows`` has conv, the columns given in ``turns.paths`` as d, h1, h2, p1, p2, and words, sum_words; ``convs`` all ids."""
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv", zero.alias("d"), *[zero.alias(c) for c in ("h1", "h2", "p1", "p2", "words", "sum_words")])
    every = written(rows.unionByName(root), "trie-paths")
    ends = every.groupBy("conv").agg(F.max(F.struct("d", *HASH, "sum_words")).alias("end")).select(
        "conv", F.col("end.d").alias("m"), "end.h1", "end.h2", F.col("end.sum_words").alias("all_words"))
    ends = written(ends, "trie-ends")
    sequences = written(_member_lists(ends).join(ends.select(F.col("conv").alias("rep"), "all_words"), "rep"), "trie-sequences")
    longest = sequences.agg(F.max("m").alias("m")).first()["m"] or 0
    path = written(every.withColumnRenamed("conv", "rep").join(sequences.select("rep"), "rep", "left_semi"), "trie-sequence-paths")
    bucket = F.pmod(F.xxhash64("rep"), F.lit(1000)) / 1000
    placed, low = None, 0.0
    for high in [*shares, 1.0]:
        batch = sequences.filter((bucket >= low) & (bucket < high)).select("rep", "m")
        if placed is None:
            exits = batch.select("rep", "m", zero.alias("x"), F.lit(None).cast("bigint").alias("owner"))
            placed = _insert(exits, path)
        else:
            placed = placed.unionByName(_insert(_locate(batch, _node_table(placed, path), path, longest), path))
        low = high
    return _nodes(sequences, placed, path)


def _nodes(sequences, placed, path):
    hung = placed.filter("owner IS NOT NULL").groupBy("owner").agg(F.max("x").alias("hung")).withColumnRenamed("owner", "rep")
    at_x = path.join(placed.select("rep", "x"), "rep").filter("d = x").select("rep", F.col("sum_words").alias("words_x"))
    info = sequences.select("rep", "k", "ends", "all_words").join(placed.select("rep", "m", "x"), "rep").join(hung, "rep", "left").join(at_x, "rep")
    below = F.coalesce("hung", F.lit(0))
    info = written(info.select(
        "rep", "m", "k", "x", "ends", "all_words", "words_x", ((F.col("x") < F.col("m")) & (below < F.col("m"))).cast("bigint").alias("leaf"),
        F.when(F.col("k") > 1, F.col("m")).otherwise(F.greatest("x", below)).alias("s")), "trie-sequence-info")
    full = path.join(info, "rep").withColumn("before", F.col("sum_words") - F.col("words"))
    saved = F.when(F.col("x") >= F.col("d"), F.col("words_x") - F.col("before")).otherwise(0) + (F.col("k") - 1) * (F.col("all_words") - F.col("before"))
    shared = full.filter("d <= s").groupBy(*_KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("k").alias("n_convs"),
        F.sum(((F.col("x") <= F.col("d")) & (F.col("d") < F.col("m"))).cast("bigint")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(saved).alias("saved_tokens"), F.max(F.when(F.col("d") == F.col("m"), F.col("ends"))).alias("ends_sha256"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    shared = written(shared.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")))
                     .withColumn("ends_sha256", F.coalesce("ends_sha256", none)), "trie-shared")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    alone = full.filter("d > s").select(
        *_KEY, F.col("rep").alias("conv_id"), one.alias("n_convs"), F.when(F.col("d") < F.col("m"), one).otherwise(zero).alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("d") == F.col("m"), F.col("ends")).otherwise(none).alias("ends_sha256"), "p1", "p2",
        (F.col("d") == F.col("s") + 1).alias("leaves_shared"))
    above = shared.select((F.col("d") + 1).alias("d"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deeper = shared.filter("d > 0").unionByName(alone.filter("leaves_shared").drop("leaves_shared")).join(above, ["d", "p1", "p2"])
    own = alone.filter("NOT leaves_shared").withColumn("parent_conv_id", F.col("conv_id"))
    top = shared.filter("d = 0").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    columns = ["conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return top.select(*columns).unionByName(deeper.select(*columns)).unionByName(own.select(*columns))


def prefix_trie(conversations, every=20, shares=SHARES):
    """Nodes of the trie of rebuilt conversations; ``every=1`` leaves conversations as they are."""
    turns = plain_turns(conversations).filter("conv IS NOT NULL")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words")
    turns = turns.select("*", words, *[F.col(t).alias(f"own_{t}") for t in LANES]).drop("text")
    ordered = ordered_turns(turns, purpose="trie-turns").select("conv", "pos", "words", *[F.col(f"own_{t}").alias(t) for t in LANES])
    mixed, convs = rebuilt(ordered, every)
    again = paths(mixed.withColumnRenamed("pos", "place"), [F.col("conv"), F.col("side"), F.col("place")], ["words"], "trie-rebuilt")
    rows = again.select("conv", F.col("pos").alias("d"), "h1", "h2", "p1", "p2", "words", "sum_words")
    return trie(rows, convs, shares)
