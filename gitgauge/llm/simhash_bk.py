"""Near duplicates by 64-bit SimHash, linked with BK-trees.

Fingerprints of equal texts are one node. Two fingerprints within ``radius`` 2 agree in at least two of four 16-bit blocks, so
every pair of blocks and their values names a shard, and any two linked fingerprints meet in one. A shard's distinct
fingerprints form a BK-tree: the children of a node are keyed by their integer Hamming distance to it, and a search follows only
edges within the radius of the distance at hand. A shard above ``SPLIT`` fingerprints is dealt again by three parts of the other
32 bits (two differing bits leave one part equal), which bounds it by 2**22 whatever the data. Inside a shard only links that
join two groups are given out, so a group of n copies costs n - 1 links and no link between groups is lost. Trees go where their
shard is; no tree or list of all fingerprints meets in the driver or in one task.

Null texts count as empty; a text without words has fingerprint 0 and is linked like any other. A null doc_id keeps its row and
its links but is never a component id unless a component has no other. Repeated rows repeat. An empty table gives an empty
result. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import plain_docs, tokens_of, written
from .components import components

SHINGLE = 3
RADIUS = 2
SPLIT = 20_000
_PAIRS = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def simhash(text: str, k=SHINGLE) -> int:
    """Unsigned fingerprint: bit i is set if it is set in over half of the XXH64 (seed 42) of the k-word shingles."""
    import xxhash
    words = tokens_of(text)
    if not words:
        return 0
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    data = memoryview(b" ".join(encoded))
    n = len(encoded)
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, n) + 1) - 1
    if n < k:
        starts, stops = [0], [len(data)]
    else:
        starts = [0, *(ends[:n - k] + 1).tolist()]
        stops = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(data[a:z], 42) for a, z in zip(starts, stops)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        bits = np.unpackbits(h[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs, k=SHINGLE, id_col="doc_id", text_col="text"):
    """doc_id, fp (the fingerprint as a signed 64-bit integer)."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            fp = np.array([simhash(t.as_py(), k) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp, pa.int64())], schema=schema)

    return plain_docs(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, fp bigint")


class BKTree:
    """Nodes are unsigned integers; ``children[i]`` maps a distance to the one child at that distance."""

    def __init__(self):
        self.values, self.children = [], []

    def near(self, value: int, radius: int) -> list[int]:
        """Indices of all nodes within the radius."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            i = stack.pop()
            d = (values[i] ^ value).bit_count()
            if d <= radius:
                found.append(i)
            below = children[i]
            if below:
                if len(below) <= 2 * radius + 1:
                    stack += [c for e, c in below.items() if d - radius <= e <= d + radius]
                else:
                    stack += [below[e] for e in range(d - radius, d + radius + 1) if e in below]
        return found

    def add(self, value: int) -> int:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0 if new else None
        while at is not None:
            d = (self.values[at] ^ value).bit_count()
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new
            at = below
        return new


def tree_links(values, radius=RADIUS):
    """Links (index, index) that join all groups of values within the radius, n - groups of them."""
    tree, root, links = BKTree(), [], []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for value in values:
        near = tree.near(value, radius)
        i = tree.add(value)
        root.append(i)
        for j in near:
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((i, j))
    return links


def _shards(fps):
    """key1 (pair of blocks), key2 (their 32 bits), fp for each of the six pairs."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    keys = [F.struct(F.lit(n).alias("pair"), (block[i] * 65536 + block[j]).alias("bits")) for n, (i, j) in enumerate(_PAIRS)]
    return fps.select("fp", F.inline(F.array(*keys)))


def _resplit(rows):
    """The other 32 bits of a large shard in three parts; ``part`` and ``sub`` are 0 for all other shards."""
    block = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    rest = F.lit(None)
    for n, pair in enumerate(_PAIRS):
        i, j = [x for x in range(4) if x not in pair]
        rest = F.when(F.col("pair") == n, block[i] * 65536 + block[j]).otherwise(rest)
    rest = rest.cast("bigint")
    parts = [(1, F.shiftright(rest, 21)), (2, F.shiftright(rest, 10).bitwiseAND(F.lit(0x7FF))), (3, rest.bitwiseAND(F.lit(0x3FF)))]
    return rows.select("fp", "pair", "bits", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), v.cast("bigint").alias("sub")) for p, v in parts])))


def fingerprint_links(fps, radius=RADIUS, split=SPLIT):
    """a, b: links that join all distinct fingerprints within the radius."""
    if radius > 2:
        raise ValueError("the shards are made for a radius of 2 or less")
    shards = _shards(fps.select("fp").distinct())
    counts = shards.groupBy("pair", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = written(shards.join(counts, ["pair", "bits"]), "shards")
    small = placed.filter(F.col("n") <= split).select("fp", "pair", "bits", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("sub"))
    keyed = small.unionByName(_resplit(placed.filter(F.col("n") > split)))

    def link(table: pa.Table) -> pa.Table:
        fp = np.sort(table.column("fp").to_numpy())
        pairs = tree_links(fp.view(np.uint64).tolist(), radius)
        a, b = np.array(pairs, np.int64).reshape(-1, 2).T
        return pa.table({"a": fp[a], "b": fp[b]})

    # shards of two, nearly all of them, need no tree and no Python
    two = keyed.groupBy("pair", "bits", "part", "sub").agg(F.count(F.lit(1)).alias("m"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    near = two.filter((F.col("m") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    more = keyed.join(two.filter("m > 2").select("pair", "bits", "part", "sub"), ["pair", "bits", "part", "sub"])
    return near.unionByName(more.groupBy("pair", "bits", "part", "sub").applyInArrow(link, "a bigint, b bigint")).distinct()


def near_duplicates(docs, k=SHINGLE, radius=RADIUS, id_col="doc_id", text_col="text"):
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row."""
    prints = written(fingerprints(docs, k, id_col, text_col), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(fingerprint_links(nodes, radius))
    labels = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labels.join(smallest, "component").select("fp", "component_id")
    # a fingerprint that a third of all rows share is a hot key; the small side is one row a fingerprint, so the join can be split
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
