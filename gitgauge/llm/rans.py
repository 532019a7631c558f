"""Token ids in files coded with a static range asymmetric numeral system (rANS).

One table of token frequencies, counted over all documents, serves every block. Blocks hold whole documents in ascending
doc_id order and are coded on their own, so any of them can be decoded without the others. Inside a block token i belongs to
lane i mod LANES; the lanes share one stream of 32-bit words. Every CHECKPOINT tokens the lane states and the place in the
stream are kept, so that one block can be decoded from several places at once. Payload and ids carry a crc32 each.

Files: Parquet as the container, one row a block, in a folder per table. Columns: file and block give the order, first_token
the number of ids before the block, doc_ids and counts the documents, n_tokens, lanes, marks (word offset of each
checkpoint), states (lane states at each), words (the stream), payload_crc32, ids_crc32. Frequencies lie beside them.

A null text has the end id only. A null doc_id sorts first. Equal doc_ids keep an order given by their text. An empty table
gives no blocks. Other columns are ignored.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..session import shared_dir
from . import words
from .common import parts_for, plain_docs, rows, slices, total_bytes

SCALE_BITS = 20
LANES = 2048
CHECKPOINT = 1 << 17
BLOCK_TOKENS = 1 << 18
PART_BYTES = 24_000_000  # text in one part of the order
_LOW = np.uint64(1 << 31)

PACKED = pa.schema([
    ("file", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("n_tokens", pa.int64()), ("ids", pa.binary())])
PACKED_DDL = "file int, block int, doc_ids array<bigint>, counts array<bigint>, n_tokens bigint, ids binary"
CODED = pa.schema([
    ("file", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("counts", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("lanes", pa.int32()), ("marks", pa.list_(pa.int64())),
    ("states", pa.binary()), ("words", pa.binary()), ("payload_crc32", pa.int64()), ("ids_crc32", pa.int64())])
CODED_DDL = ("file int, block int, first_token bigint, doc_ids array<bigint>, counts array<bigint>, n_tokens bigint, "
             "lanes int, marks array<bigint>, states binary, words binary, payload_crc32 bigint, ids_crc32 bigint")


def scaled(counts: dict[int, int], bits=SCALE_BITS):
    """(symbols, frequencies summing to 2**bits, starts); every counted symbol keeps a frequency of one at least."""
    symbols = np.array(sorted(counts), np.int64)
    n = np.array([counts[s] for s in symbols.tolist()], np.float64)
    if len(symbols) > 1 << bits:
        raise ValueError("more symbols than the scale has places")
    total = 1 << bits
    freq = np.maximum(1, np.floor(n / n.sum() * total)).astype(np.int64)
    spare = total - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if spare >= 0:
        freq[order[0]] += spare
    for i in order:  # takes what was rounded up from the most frequent ones
        if spare >= 0:
            break
        take = min(-spare, int(freq[i]) - 1, max(1, int(freq[i]) // 4))
        freq[i] -= take
        spare += take
    while spare < 0:
        i = int(np.argmax(freq))
        freq[i] -= 1
        spare += 1
    starts = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return symbols, freq, starts


class Table:
    def __init__(self, symbols, freq, starts, bits=SCALE_BITS):
        self.bits = np.uint64(bits)
        self.mask = np.uint64((1 << bits) - 1)
        self.symbols = np.asarray(symbols, np.uint32)
        self.freq, self.start = np.asarray(freq, np.uint64), np.asarray(starts, np.uint64)
        self.top = self.freq << np.uint64(63 - bits)
        self.place = np.zeros(int(self.symbols.max(initial=0)) + 1, np.uint32)  # ids are bounded by the vocabulary
        self.place[self.symbols] = np.arange(len(self.symbols), dtype=np.uint32)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), np.asarray(freq, np.int64))

    def encode(self, ids: np.ndarray, lanes=LANES, checkpoint=CHECKPOINT):
        """(words, marks, states): the stream in decoding order, and for each checkpoint its place there and the lane states."""
        n = len(ids)
        place = self.place[ids]
        state = np.full(lanes, _LOW, np.uint64)
        emitted, at_step = [], []
        every = max(1, checkpoint // lanes)
        steps = -(-n // lanes)
        for step in range(steps - 1, -1, -1):
            p = place[step * lanes:(step + 1) * lanes]
            x, f = state[:len(p)], self.freq[p]
            full = x >= self.top[p]
            emitted.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[:len(p)] = (q << self.bits) + (x - q * f) + self.start[p]
            if step % every == 0:
                at_step.append((len(emitted), state.copy()))
        lengths = np.cumsum([0] + [len(e) for e in reversed(emitted)])
        marks = [int(lengths[len(emitted) - k]) for k, _ in reversed(at_step)]
        states = b"".join(s.astype("<u8").tobytes() for _, s in reversed(at_step))
        return b"".join(e.tobytes() for e in reversed(emitted)), marks, states

    def decode(self, stream: bytes, marks, states: bytes, n: int, lanes=LANES, checkpoint=CHECKPOINT, only=None) -> np.ndarray:
        """The ids, or those of checkpoint ``only``; each checkpoint is decoded from its own state."""
        source = np.frombuffer(stream, "<u4").astype(np.uint64)
        saved = np.frombuffer(states, "<u8").reshape(-1, lanes)
        every = max(1, checkpoint // lanes) * lanes
        out = np.empty(n, np.uint32)
        low, high = (0, n) if only is None else (only * every, min(n, (only + 1) * every))
        for k in range(len(marks)) if only is None else (only,):
            state, at = saved[k].astype(np.uint64), marks[k]
            for i in range(k * every, min(n, (k + 1) * every), lanes):
                w = min(lanes, n - i)
                x = state[:w]
                slot = x & self.mask
                s = self.slots[slot]
                out[i:i + w] = self.symbols[s]
                x = self.freq[s] * (x >> self.bits) + slot - self.start[s]
                short = np.flatnonzero(x < _LOW)
                if len(short):
                    x[short] = (x[short] << np.uint64(32)) | source[at:at + len(short)]
                    at += len(short)
                state[:w] = x
        return out[low:high]


def _pack(tokenizer_path, end_id, block_tokens):
    from pyspark import TaskContext

    def run(batches):
        file, block = TaskContext.get().partitionId(), 0
        names, counts, pieces, held = [], [], [], 0

        def flush():
            return rows(PACKED, {"file": [file], "block": [block], "doc_ids": [names], "counts": [counts],
                                 "n_tokens": [held], "ids": [b"".join(pieces)]})

        end = int(end_id).to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole):
                found = words.encoder(tokenizer_path).encode_column(batch.column("text"))
                for name, ids in zip(batch.column("doc_id").to_pylist(), found):
                    n = len(ids) // 4 + 1
                    if names and held + n > block_tokens:
                        yield flush()
                        block, names, counts, pieces, held = block + 1, [], [], [], 0
                    names.append(name)
                    counts.append(n)
                    pieces += (ids, end)
                    held += n
        if names:
            yield flush()

    return run


def _narrow(ids: bytes) -> bytes:
    """The low and the high halves of the ids apart, which Parquet then compresses better."""
    return np.ascontiguousarray(np.frombuffer(ids, np.uint8).reshape(-1, 4).T).tobytes()


def _wide(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def write_files(docs, folder: str, tokenizer_path: str, end_id=1, id_col="doc_id", text_col="text", part_bytes=PART_BYTES,
                block_tokens=BLOCK_TOKENS, lanes=LANES, checkpoint=CHECKPOINT):
    """Writes the coded blocks and the frequency table below ``folder``, which all executors share."""
    spark = docs.sparkSession
    docs = plain_docs(docs, id_col, text_col)
    n = parts_for(total_bytes(docs), part_bytes)
    pack = _pack(tokenizer_path, end_id, block_tokens)

    def planes(batches):
        for batch in pack(batches):
            yield batch.set_column(5, "ids", pa.array([_narrow(batch.column("ids")[0].as_py())], pa.binary()))

    # the text breaks ties of equal doc_ids, so that a retried task deals the same blocks
    order = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    order.mapInArrow(planes, PACKED_DDL).write.option("compression", "zstd").parquet(f"{folder}/ids")
    packed = spark.read.schema(PACKED_DDL).parquet(f"{folder}/ids")

    def count(batches):
        for batch in batches:
            for ids in batch.column("ids"):
                symbols, freq = np.unique(_wide(ids.as_py()), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.int64()), pa.array(freq, pa.int64())], names=["id", "n"])

    # one row a token id and one row a file: both bounded by the vocabulary and the number of parts
    counts = {r["id"]: r["n"] for r in packed.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    sizes = packed.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["file"]):
        before[r["file"]], at = at, at + r["n"]
    symbols, freq, starts = scaled(counts) if counts else (np.zeros(0, np.int64),) * 3
    spark.createDataFrame(
        [(int(s), int(f), int(c)) for s, f, c in zip(symbols, freq, starts)], "id bigint, frequency bigint, start bigint",
    ).coalesce(1).write.parquet(f"{folder}/table")
    firsts = {}
    for r in packed.select("file", "block", "n_tokens").orderBy("file", "block").toLocalIterator():
        firsts[r["file"], r["block"]] = before[r["file"]]
        before[r["file"]] += r["n_tokens"]
    shared = spark.sparkContext.broadcast((symbols, freq, starts, firsts))

    def code(batches):
        *given, first = shared.value
        table = Table(*given)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                ids = _wide(r.pop("ids"))
                stream, marks, states = table.encode(ids, lanes, checkpoint)
                yield rows(CODED, {k: [v] for k, v in r.items()} | {
                    "first_token": [first[r["file"], r["block"]]], "lanes": [lanes], "marks": [marks], "states": [states],
                    "words": [stream], "payload_crc32": [zlib.crc32(stream, zlib.crc32(states))],
                    "ids_crc32": [zlib.crc32(ids.astype("<u4").tobytes())]})

    packed.mapInArrow(code, CODED_DDL).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_files(spark, folder: str, with_ids=True, checkpoint=CHECKPOINT):
    """Documents from the files alone: doc_id, start, n_tokens, ids_crc32, and ids if asked for. Damaged blocks raise an error."""
    table = spark.read.parquet(f"{folder}/table").orderBy("id").collect()  # one row a token id
    shared = spark.sparkContext.broadcast(tuple(np.array([r[c] for r in table], np.int64) for c in ("id", "frequency", "start")))
    schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(schema + ([("ids", pa.binary())] if with_ids else []))

    def read(batches):
        table = Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if zlib.crc32(r["words"], zlib.crc32(r["states"])) != r["payload_crc32"]:
                    raise ValueError(f"damaged payload in file {r['file']}, block {r['block']}")
                data = table.decode(r["words"], r["marks"], r["states"], r["n_tokens"], r["lanes"], checkpoint).astype("<u4").tobytes()
                if zlib.crc32(data) != r["ids_crc32"]:
                    raise ValueError(f"wrong ids in file {r['file']}, block {r['block']}")
                cut = np.concatenate([[0], np.cumsum(r["counts"])]).astype(np.int64)
                pieces = [data[4 * a:4 * z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist())]
                out = {"doc_id": r["doc_ids"], "start": (r["first_token"] + cut[:-1]).tolist(), "n_tokens": r["counts"],
                       "ids_crc32": [zlib.crc32(p) for p in pieces], "ids": pieces}
                yield rows(schema, out)

    ddl = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return spark.read.schema(CODED_DDL).parquet(f"{folder}/blocks").mapInArrow(read, ddl)


def token_files(docs, tokenizer_path: str, end_id=1, id_col="doc_id", text_col="text"):
    """Writes the files into a new shared folder and gives what they say of each document."""
    folder = shared_dir(docs.sparkSession, "rans")
    write_files(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_files(docs.sparkSession, folder, with_ids=False)
