"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are parted by size, class c holding items of up to 2**c shingles. For a class of upper size u a document is read as
windows of 2u shingles that start every u shingles, so an item that stands in a document stands whole in one window, whose
size bounds the Jaccard similarity from below (0.19 for a containment of 0.8) however long the document is. An item and a
window become candidates if one of ``HASHES`` minimum hashes agrees: a containment of 0.8 is missed with a chance of 0.0012. A
minimum can only agree in a window that holds the very shingle that gives it for the item, so windows without such a shingle
are not looked at; that leaves the result as it is. Candidates are verified word by word: the share of the item's distinct
shingles that stand in the whole document.

Items of fewer than ``k`` words have one shingle, all their words, and documents of fewer words likewise, so they match each
other only. Texts without words match nothing. Null texts count as empty; null ids are kept. Repeated items and documents give
repeated rows. Empty tables give an empty result. Other columns are ignored.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import parts_for, plain_docs, tokens_of, total_bytes

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 32
MAX_SENT_BYTES = 16_000_000  # text of items in one pass; more items are sent in several passes
MEMO_WORDS = 1_500_000
_TABLE_BITS = 22
_POWERS = [pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64) for j in range(64)]
_SEEDS = (np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
RESULT = pa.schema([
    ("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_contained", pa.int64()), ("n_shingles", pa.int64()),
    ("containment", pa.float64()), ("first_word", pa.int64())])
DDL = "doc_id bigint, item_id bigint, n_contained bigint, n_shingles bigint, containment double, first_word bigint"


def mixed(h):
    """HASHES values for each shingle hash, as (len(h), HASHES)."""
    x = np.asarray(h, np.uint64)[:, None] ^ _SEEDS[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of the k-word shingles of a list of words."""

    def __init__(self, k):
        self.k, self.memo = k, {}

    def __call__(self, words):
        import xxhash
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 11)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        if not k:
            return h
        out = np.full(len(h) - k + 1, k, np.uint64)
        for j in range(k):
            out += h[j:len(h) - k + 1 + j] * np.uint64(_POWERS[j])
        return out ^ (out >> np.uint64(29))


class Items:
    """The signatures of one pass of items, and what is needed to look up and verify them."""

    def __init__(self, items, k=SHINGLE):
        self.k, hasher = k, Hasher(k)
        self.sets, self.sizes = [], []
        self.ids = []
        by_shingle, signature = defaultdict(set), defaultdict(list)
        for item_id, text in items:
            words = tokens_of(text)
            if not words:
                continue
            n = len(self.ids)
            h = hasher(words)
            step = min(k, len(words))
            self.ids.append(item_id)
            self.sets.append({tuple(words[i:i + step]) for i in range(len(h))})
            self.sizes.append(1 << max(0, (len(h) - 1).bit_length()))
            values = mixed(h)
            for i, at in enumerate(values.argmin(axis=0).tolist()):
                signature[int(h[at])].append((n, i, int(values[at, i])))
            for x in h.tolist():
                by_shingle[x].add(n)
        self.signature = dict(signature)
        self.by_shingle = dict(by_shingle)
        self.hashes = np.array(sorted(by_shingle), np.uint64)
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True
        self.hasher = hasher

    def matches(self, text: str, threshold):
        """(item number, shingles contained, first word) of the items that a text contains."""
        words = tokens_of(text)
        if not words or not len(self.hashes):
            return
        h = self.hasher(words)
        at = np.flatnonzero(self.table[h >> np.uint64(64 - _TABLE_BITS)])
        if not len(at):
            return
        near = np.searchsorted(self.hashes, h[at])
        at = at[self.hashes[np.minimum(near, len(self.hashes) - 1)] == h[at]]
        if not len(at):
            return
        candidates = set()
        minima = {}
        for p in at.tolist():
            for n, i, value in self.signature.get(int(h[p]), ()):
                if n not in candidates:
                    u = self.sizes[n]
                    for w in {p // u, max(0, p // u - 1)}:
                        if (u, w) not in minima:
                            minima[u, w] = mixed(h[w * u:(w + 2) * u]).min(axis=0)
                        if int(minima[u, w][i]) == value:
                            candidates.add(n)
                            break
        if not candidates:
            return
        step = min(self.k, len(words))
        found = defaultdict(set)
        first = {}
        for p in at.tolist():
            shingle = tuple(words[p:p + step])
            for n in self.by_shingle[int(h[p])] & candidates:
                if shingle in self.sets[n]:
                    found[n].add(shingle)
                    first.setdefault(n, p)
        for n in sorted(found):
            if len(found[n]) >= threshold * len(self.sets[n]):
                yield n, len(found[n]), first[n]


def _passes(items, bound):
    """Lists of (item_id, text), each of bounded size: benchmarks larger than the bound take several passes."""
    n = parts_for(2 * total_bytes(items), bound)
    dealt = items.withColumn("_pass", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    for i in range(n):
        yield [(r["doc_id"], r["text"]) for r in dealt.filter(F.col("_pass") == i).select("doc_id", "text").collect()]


def contained_items(docs, benchmark, k=SHINGLE, threshold=THRESHOLD, id_col="doc_id", text_col="text", item_col="item_id",
                    item_text_col="text", max_sent_bytes=MAX_SENT_BYTES):
    """doc_id, item_id, n_contained, n_shingles, containment, first_word for each item that a document contains."""
    spark = docs.sparkSession
    docs = plain_docs(docs, id_col, text_col)
    out = None
    for items in _passes(plain_docs(benchmark, item_col, item_text_col), max_sent_bytes):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared):
            index = Items(shared.value, k)
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    for n, contained, first in index.matches(text.as_py(), threshold):
                        size = len(index.sets[n])
                        rows.append((doc_id, index.ids[n], contained, size, contained / size, first))
                columns = zip(*rows) if rows else [[] for _ in RESULT]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT)], schema=RESULT)

        found = docs.mapInArrow(run, DDL)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs, benchmark, **options):
    """The input without the documents that contain a test item; null doc_ids are never dropped."""
    id_col = options.get("id_col", "doc_id")
    hits = contained_items(docs, benchmark, **options).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hits, docs[id_col].cast("bigint") == F.col("_hit"), "left_anti")
