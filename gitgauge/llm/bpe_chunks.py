"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes says so, so equal passages of different documents give equal chunks
whatever stands before them. Chunks shared across documents are found by a grouped count of chunk hashes over all documents
and encoded once; a chunk's ids are trusted between its first and last white space only, and what meets at a joint is
encoded again, from the last white space before it to the first one after it, where both readings agree.

Nulls: a null text is an empty one (no ids, decoded text empty); a null doc_id stays null. Repeated rows give repeated rows.
An empty table gives an empty result. Other columns are ignored.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from . import words
from .common import plain_docs, slices

MEAN_CHUNK = 512  # bytes
SHARED_CHUNKS = 20_000  # most useful shared chunks that are encoded up front; a cache, results do not depend on it
MAX_SHARED_BYTES = 4_096  # longer chunks (texts without a cut) are left to the workers
MEMO_BYTES = 48_000_000  # chunks that one worker remembers
_SPACES = " \t\n\r"

RESULT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def cuts(data: bytes, mean=MEAN_CHUNK) -> list[int]:
    """Ends of the chunks of one UTF-8 text: content-defined, never inside a character, and the end itself."""
    n = len(data)
    if n <= 32:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h = (b.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    factor = 16777619
    for step in (1, 2, 4, 8):  # hash of 16 bytes from the hashes of two halves
        power = np.uint32(pow(factor, step, 1 << 32))
        h[step:] = h[step:] + power * h[:-step]
    at = np.flatnonzero((h[15:-1] >> np.uint32(7)) % np.uint32(mean) == 0) + 16
    at = at[(b[at] & 0xC0) != 0x80]
    return [*at.tolist(), n]


def chunks(text: str, mean=MEAN_CHUNK) -> list[str]:
    data = text.encode("utf-8", "surrogatepass")
    out, a = [], 0
    for z in cuts(data, mean):
        out.append(data[a:z].decode("utf-8", "surrogatepass"))
        a = z
    return out


def split_chunk(chunk: str):
    """(what stands before the first white space, the inner part, what stands after the last one); None inside if there is none."""
    first = min((i for i in map(chunk.find, _SPACES) if i >= 0), default=-1)
    if first < 0:
        return chunk, None, ""
    last = max(map(chunk.rfind, _SPACES))
    return chunk[:first], chunk[first:last], chunk[last + 1:]


class ChunkEncoder:
    """Encodes texts chunk by chunk; ``shared`` holds (inner text, ids) of chunks that were encoded before."""

    def __init__(self, path: str, shared=(), mean=MEAN_CHUNK):
        self.words, self.mean = words.encoder(path), mean
        self.memo = dict(shared)
        self.held = sum(len(k) + len(v) for k, v in self.memo.items())
        self.shared = self.memo.copy()
        self.shared_bytes = self.held

    def _inner(self, texts: set) -> dict:
        new = [t for t in texts if t not in self.memo]
        if self.held > MEMO_BYTES:
            self.memo, self.held = self.shared.copy(), self.shared_bytes
            new = [t for t in texts if t not in self.memo]
        for t, ids in zip(new, self.words.encode(new)):
            self.memo[t] = ids
            self.held += len(t) + len(ids)
        return self.memo

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.words.by_piece:  # no white space is safe, so a joint reaches from end to end
            return self.words.encode(texts)
        plans, inner, joints = [], set(), set()
        for text in texts:
            plan, open_joint = [], ""
            for chunk in chunks(text, self.mean):
                head, middle, tail = split_chunk(chunk)
                open_joint += head
                if middle is not None:
                    plan.append((open_joint, middle))
                    open_joint = tail
            plans.append((plan, open_joint))
            inner.update(m for _, m in plan)
            joints.update(j for j, _ in plan)
            joints.add(open_joint)
        middle_ids, joint_ids = self._inner(inner), self.words.learn(joints)
        return [b"".join([x for j, m in plan for x in (joint_ids[j], middle_ids[m])]) + joint_ids[last] for plan, last in plans]


def _hashes(mean):
    import xxhash
    schema = pa.schema([("hash", pa.int64()), ("size", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            seen = {}
            for text in batch.column("text").to_pylist():
                for chunk in chunks(text, mean):
                    middle = split_chunk(chunk)[1]
                    if middle:
                        key = xxhash.xxh64_intdigest(middle.encode("utf-8", "surrogatepass")) - (1 << 63)
                        size, n = seen.get(key, (len(middle), 0))
                        seen[key] = size, n + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.int64()), pa.array([v[0] for v in seen.values()], pa.int64()),
                 pa.array([v[1] for v in seen.values()], pa.int64())], schema=schema)

    return count, "hash bigint, size bigint, n bigint"


def shared_chunks(docs, tokenizer_path: str, mean=MEAN_CHUNK, limit=SHARED_CHUNKS):
    """(inner text, ids) of the chunks that save most, each encoded once; at most ``limit`` of bounded length.

    The counts cover all chunks of all documents. The limit bounds what is sent to the executors, nothing else.
    """
    import xxhash
    count, schema = _hashes(mean)
    best = (
        docs.select("text").mapInArrow(count, schema).groupBy("hash").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
        .filter((F.col("n") > 1) & (F.col("size") <= MAX_SHARED_BYTES))
        .orderBy((F.col("size") * (F.col("n") - 1)).desc(), "hash").limit(limit).select("hash").collect())
    wanted = frozenset(r["hash"] for r in best)
    if not wanted:
        return []

    def texts(batches):
        for batch in batches:
            found = {}
            for text in batch.column("text").to_pylist():
                for chunk in chunks(text, mean):
                    middle = split_chunk(chunk)[1]
                    if middle:
                        key = xxhash.xxh64_intdigest(middle.encode("utf-8", "surrogatepass")) - (1 << 63)
                        if key in wanted:
                            found[key] = middle
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.string())], names=["hash", "inner"])

    def encode(batches):
        for batch in batches:
            inner = batch.column("inner").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(inner, pa.string()), pa.array(words.encoder(tokenizer_path).encode(inner), pa.binary())], names=["inner", "ids"])

    once = docs.select("text").mapInArrow(texts, "hash bigint, inner string").groupBy("hash").agg(F.first("inner").alias("inner"))
    return [(r["inner"], bytes(r["ids"])) for r in once.select("inner").mapInArrow(encode, "inner string, ids binary").collect()]


def _apply(docs, tokenizer_path, mean, schema, ddl, columns):
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, tokenizer_path, mean))

    def run(batches):
        coder = ChunkEncoder(tokenizer_path, shared.value, mean)
        for whole in batches:
            for batch in slices(whole):
                ids = coder.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(columns(coder, ids), list(schema)[1:])]], schema=schema)

    return docs.mapInArrow(run, ddl)


def encode_and_decode(docs, tokenizer_path: str, mean=MEAN_CHUNK, id_col="doc_id", text_col="text"):
    """doc_id, ids (little-endian unsigned 32-bit) and the decoded text of every whole document."""
    def columns(coder, ids):
        return ids, [coder.words.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]

    return _apply(plain_docs(docs, id_col, text_col), tokenizer_path, mean, RESULT, "doc_id bigint, ids binary, decoded string", columns)


def encode_digests(docs, tokenizer_path: str, mean=MEAN_CHUNK, id_col="doc_id", text_col="text"):
    """As encode_and_decode, with a count and digests in place of ids and text, which then never leave the task."""
    def columns(coder, ids):
        decoded = [hashlib.sha256(coder.words.decode(np.frombuffer(i, "<u4").tolist()).encode()).hexdigest() for i in ids]
        return [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids], decoded

    return _apply(plain_docs(docs, id_col, text_col), tokenizer_path, mean, DIGEST,
                  "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", columns)
