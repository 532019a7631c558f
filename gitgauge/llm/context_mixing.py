"""LM scoring by logistic context mixing of context bit predictors.

A text is read as the UTF-8 bytes of its lower-cased form and an end byte, eight bits a byte, the highest first. Four predictors
look up the bit's probability by their context (the last 2, 3 or 5 bytes, or the word so far) and of the bits of this
byte that are known. A code is a context and the byte behind it; contexts are taken as they are (orders 2, 3 and 5) or by 55 bits of hash (the
word so far), so the number of codes grows with the corpus. Documents are dealt into blocks; a block counts its codes once and sends them,
sorted and packed, to the parts of all contexts. A part adds the blocks up and gives each block, in the order of its codes, the stretched
probabilities of the eight bits of each. No table passes through the driver and none is broadcast.
A mixer adds the stretched probabilities with weights that are gated by bit position and by how many of the contexts were ever seen, and
refines them adaptively after every bit. Gated starting weights are fitted, unrefined, on all bytes of all training documents, each half of
them against the counts of the other half, so that no document meets its own counts; blocks, which hold training documents of one half or
documents that do not train, fit side by side in ``ROUNDS`` steps or more, and their weights are averaged.
Then each block of ``BLOCK`` bytes goes on from there on its own. Blocks keep the contexts across their borders, so they are scored
side by side and a text of any length is scored whole. score is the sum of log10 probabilities of all bits.

The base score needs the exact count of every token: the distinct words of a block go, packed, to parts of all words, which add them up and
send the counts back to the block. No vocabulary is broadcast.

Null texts count as empty (only the end is scored). A null doc_id is in no fold: it is scored, as not held out, and trains nothing.
Repeated rows repeat and train as often. With no training rows all counts are zero and the predictors say one half. An empty table
gives an empty result. Other columns are ignored.
"""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..session import shuffles_freed
from .common import parts_for, plain_docs, rows, slices, tokens_of, total_bytes, training_fold, written

FOLDS, HELD_OUT = 7, 2
ORDERS = (2, 3, 5)
MODELS = len(ORDERS) + 1
LINES = 1 << 16  # of a table without keys, whose lines are found by hash
PAD = max(ORDERS)
_END = b"\xff"  # never a byte of UTF-8
BLOCK = 1_024
SLICE = 500_000  # text mixed at once
RATE = 0.003
GATES = MODELS + 1
ROUNDS = 8
PRIOR = 0.3
HELD_WORDS = 500_000  # distinct words that a task gathers likewise
HELD_KEYS = 1_000_000  # counts that a task gathers before it adds them up; four times as many distinct ones are sent on
BLOCK_BYTES = 12_000_000  # text of one block, or a little less
PART_BYTES = 12_000_000  # text behind the codes of one part
FIT, REST, OTHER = 0, 1, 2  # kinds of a block, its number modulo 3: a half of the training documents, the other half, no training
SCALE = 12.0  # stretched probabilities are kept as integers of 1/12
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = 0x100000001B3
_BOTH = np.array([0, GATES, 1, GATES + 1], np.int8)  # which halves were seen, as counts of both
_IS_SPACE = np.isin(np.arange(256), (0, 9, 10, 11, 12, 13, 32))


def joined(texts: list[str]):
    """Bytes of the texts in a row, each behind PAD zero bytes, so that no context reaches another text; starts and lengths.

    A zero byte of a text is the same byte as a padding one; that loosens a context, not a probability.
    """
    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    lengths = np.array([len(p) + 1 for p in parts], np.int64)
    gap = bytes(PAD)
    data = np.frombuffer(b"".join([x for p in parts for x in (gap, p, _END)]), np.uint8)
    return data, np.cumsum(lengths + PAD) - lengths, lengths


def _by_bytes(data, back=PAD):
    """The last ``back`` bytes before each byte, the one next to it lowest."""
    h, b = np.zeros(len(data), np.uint64), data.astype(np.uint64)
    for k in range(1, back + 1):
        h[k:] |= b[:-k] << np.uint64(8 * (k - 1))
    return h


def _by_word(data):
    """55 bits of hash of the word so far, and a mark."""
    # a difference of prefix sums of byte times a power of its place in the word
    space = _IS_SPACE[data]
    at = np.arange(len(data))
    begin = np.maximum.accumulate(np.where(space, at + 1, 0))
    place = np.maximum(at - begin, 0)
    term = (data.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(int(place.max(initial=0)) + 1, _WORD_BASE, np.uint64))[place]
    term[space] = 0
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term)])
    start = np.concatenate([[0], begin[:-1]]).astype(np.int64)
    h = (sums[at] - sums[start]) ^ np.uint64(77)
    h = (h ^ (h >> np.uint64(32))) * _MUL
    h ^= h >> np.uint64(29)
    return (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(9)) | np.uint64(1 << 55)


def contexts(data):
    """Keys of lines (MODELS, 2, n) for bytes of several texts in a row: 56 bits of context, then 0 or one more than the first four bits."""
    keys = np.empty((MODELS, 2, len(data)), np.uint64)
    for m, order in enumerate(ORDERS):
        keys[m, 0] = _by_bytes(data, order) | np.uint64(m << 8 * PAD)
    keys[-1, 0] = _by_word(data)
    keys <<= np.uint64(8)
    keys[:, 1] = keys[:, 0] | ((data >> 4).astype(np.uint64) + np.uint64(1))
    return keys


def _codes(data):
    """Codes of the longest order and of the word so far; the codes of the other orders follow from the former."""
    return tuple(h << np.uint64(8) | data for h in (_by_bytes(data) | np.uint64(len(ORDERS) - 1 << 8 * PAD), _by_word(data)))


def _shorter(codes, m):
    """Codes of order number m for codes of the longest order."""
    return (codes & np.uint64((1 << 8 * ORDERS[m] + 8) - 1)) | np.uint64(m << 8 * PAD + 8)


def _places(data, starts):
    """True for the bytes of texts, not for those between them."""
    at = np.ones(len(data), bool)
    at[(starts[:, None] - 1 - np.arange(PAD)[None, :]).ravel()] = False
    return at


def _summed(codes, counts):
    """Distinct codes in order, and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(codes) else counts


def _packed(numbers) -> bytes:
    """Unsigned integers by planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind):
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(data, n * size, "zstd"), np.uint8).reshape(size, n).T).view(kind).reshape(-1)


def _ordered(row):
    """The codes of a packed row."""
    return np.cumsum(_unpacked(row["codes"], row["size"], "<u8"), dtype=np.uint64)


def _parts(codes, parts):
    """Part of each code's context. Near codes, which pack well, are kept together: words by ranges of their hash, the others by their older bytes."""
    word = codes >> np.uint64(63) == 1
    ranges = ((codes & np.uint64((1 << 63) - 1)) >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)
    return np.where(word, ranges, ((codes >> np.uint64(24)) * _MUL >> np.uint64(24)) % np.uint64(parts))


COUNTS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("counts", pa.binary())])
COUNTS_DDL = "part bigint, block bigint, size bigint, codes binary, counts binary"


def _count(parts):
    """How often each byte followed a context of each model, of the texts of a block in a task: a row for every part of the contexts."""
    def rows_of(held):
        for block, own in held.items():
            codes, counts = _summed(np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own]))
            part = _parts(codes, parts)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else [0, len(order)]
            out = defaultdict(list)
            for i, (a, z) in enumerate(zip(cut, cut[1:])):
                if a < z:
                    c = codes[order[a:z]]
                    for k, v in zip(COUNTS.names, (i, block, len(c), _packed(np.diff(c, prepend=np.uint64(0))), _packed(counts[order[a:z]].astype("<u4")))):
                        out[k].append(v)
            yield rows(COUNTS, out)

    def run(batches):
        held, size, kept = defaultdict(list), 0, 0
        for whole in batches:
            for batch in slices(whole, chars=SLICE // 2):
                texts = defaultdict(list)
                for block, text in zip(batch.column("block").to_pylist(), batch.column("text").to_pylist()):
                    texts[block].append(text)
                for block, own in texts.items():
                    data, starts, _ = joined(own)
                    at = _places(data, starts)
                    (longest, n), (word, of_word) = (np.unique(c[at], return_counts=True) for c in _codes(data))
                    found = [(longest, n), (word, of_word), *(_summed(_shorter(longest, m), n) for m in range(len(ORDERS) - 1))]
                    if block not in held and held:  # rows come block by block
                        yield from rows_of(held)
                        held, size, kept = defaultdict(list), 0, 0
                    held[block].append((np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])))
                    size += len(held[block][-1][0])
                if size > kept + HELD_KEYS:
                    for own in held.values():
                        own[:] = [_summed(np.concatenate([c for c, _ in own]), np.concatenate([n for _, n in own]))]
                    size = kept = sum(len(own[0][0]) for own in held.values())
                    if kept > 4 * HELD_KEYS:
                        yield from rows_of(held)
                        held, size, kept = defaultdict(list), 0, 0
        yield from rows_of(held)

    return run


def code_counts(dealt, parts=1):
    """part, block, size, codes, counts of all texts of dealt (block, text), codes and counts packed."""
    return dealt.select("block", "text").sortWithinPartitions("block").mapInArrow(_count(parts), COUNTS_DDL)


def _added(given):
    """Distinct codes of the rows of a part, their counts in the training documents of either half, and the rows' codes by place."""
    each = [_ordered(r) for r in given]
    codes = np.unique(np.concatenate(each))
    n = np.zeros((2, len(codes)), np.int64)
    places = []
    for r, own in zip(given, each):
        places.append(np.searchsorted(codes, own))
        if r["block"] % 3 != OTHER:
            n[r["block"] % 3, places[-1]] += _unpacked(r["counts"], r["size"], "<u4")
    return codes, n, places


def _towards(codes, n):
    """Stretched probability of each bit of the codes to be what it is (8, and in place 8 if the lines of both halves of the byte were seen), in the precision of lines."""
    sums = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((len(codes), 9), np.int8)
    for bit in range(9):
        prefix = codes >> np.uint64(8 - bit)
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        ends = np.append(first[1:], len(codes))
        now = np.repeat(sums[ends] - sums[first], ends - first)
        if bit:
            s = np.log((now + PRIOR) / (before - now + PRIOR))
            out[:, bit - 1] = np.clip(np.rint(s * SCALE), -127, 127)
        if bit in (0, 4):
            out[:, 8] |= (now > 0) << (bit // 4)
        before = now
    return out


def block_codes(counts, of):
    """block, size, codes, lines: for every packed row its codes and what ``_towards`` says of them, by the counts that ``of(n, kind of block)`` picks."""
    def run(group: pa.Table) -> pa.Table:
        given = group.to_pylist()
        codes, n, places = _added(given)
        lines = {k: _towards(codes, of(n, k)) for k in {r["block"] % 3 for r in given}}
        return pa.table({"block": pa.array([r["block"] for r in given], pa.int64()), "size": pa.array([r["size"] for r in given], pa.int64()),
                         "codes": pa.array([r["codes"] for r in given], pa.binary()),
                         "lines": pa.array([_packed(lines[r["block"] % 3][p].view("V9")) for r, p in zip(given, places)], pa.binary())})

    return counts.groupBy("part").applyInArrow(run, "block bigint, size bigint, codes binary, lines binary")


def _tables(given: pa.Table):
    """Keys and table for a Mixer from the packed rows of a block."""
    given = given.select(["size", "codes", "lines"]).to_pylist()
    keys = np.concatenate([np.zeros(0, np.uint64), *(_ordered(r) for r in given)])
    lines = np.concatenate([np.zeros((0, 9), np.int8), *(_unpacked(r["lines"], r["size"], "V9").view(np.int8).reshape(-1, 9) for r in given)])
    # a block may have counted a code twice
    keys, first = np.unique(keys, return_index=True)
    return keys, lines[first]


def context_lines(docs):
    """key, line, fit_line, rest_line of every line seen in docs, a row each: stretched probabilities, 16 bytes a line. A line is a context and,
    for the second half of a byte, the first four bits, and has 16 places: a place is the node of the bits known within that half.

    The first counts all rows of docs; the second leaves out the rows marked ``fit``, the third all others: weights are fitted on the rows
    that a line has not counted.
    """
    def run(group: pa.Table) -> pa.Table:
        codes, n, _ = _added(group.to_pylist())
        high, low = codes >> np.uint64(4) & np.uint64(15), codes & np.uint64(15)
        keys = np.concatenate([codes >> np.uint64(8) << np.uint64(8), (codes >> np.uint64(8) << np.uint64(8)) + high + np.uint64(1)])
        key, at = np.unique(keys, return_inverse=True)
        leaf = [np.bincount(at * 16 + np.concatenate([high, low]).astype(np.int64), np.tile(x, 2), len(key) * 16) for x in (n.sum(axis=0), n[REST], n[FIT])]
        return pa.table({"key": pa.array(key.view(np.int64))} | {name: pa.array([x.tobytes() for x in _stretched(c).reshape(-1, 16)], pa.binary())
                                                                 for name, c in zip(("line", "fit_line", "rest_line"), leaf)})

    dealt = docs.select("text", F.when(F.col("fit"), FIT).otherwise(REST).cast("bigint").alias("block"))
    return code_counts(dealt).groupBy("part").applyInArrow(run, "key bigint, line binary, fit_line binary, rest_line binary")


def _stretched(n):
    """Counts of half bytes, 16 a line, to stretched probabilities of the bits at 15 nodes; place 0 tells if the line was seen."""
    leaf = n.reshape(-1, 16).astype(np.float64)
    out = np.zeros(leaf.shape, np.int8)
    level = leaf
    for node in (8, 4, 2, 1):
        pairs = level.reshape(len(leaf), -1, 2)
        s = np.log((pairs[:, :, 1] + PRIOR) / (pairs[:, :, 0] + PRIOR))
        out[:, node:2 * node] = np.clip(np.rint(s * SCALE), -127, 127)
        level = pairs.sum(axis=2)
    out[:, 0] = level[:, 0] > 0
    return out.ravel()


class Mixer:
    """Mixes fixed stretched probabilities with weights that start from ``gated`` (GATES, 8, MODELS).

    With ``keys`` the table is what ``_towards`` says of these codes, each once; any other code was never seen. Without keys it is of lines, which are found by hash.
    """

    def __init__(self, table, gated=None, keys=None):
        self.keys = None if keys is None else pd.Index(keys.view(np.int64))
        if keys is None:
            self.lines = np.ascontiguousarray(table).view("V16")
        else:
            table = np.concatenate([table, np.zeros((1, 9), np.int8)])
            self.bits, self.seen = np.ascontiguousarray(table[:, :8]).view("<u8").ravel(), table[:, 8].copy()
        self.gated = np.full((GATES, 8, MODELS), 0.35, np.float32) if gated is None else gated

    def by_line(self, data, at):
        """The stretched probabilities of the bits of the bytes at these places by model, as 8 bytes each, and which halves were seen."""
        lines = ((contexts(data) * _MUL >> np.uint64(20)) % np.uint64(len(self.lines))).astype(np.intp)
        lines, data = lines[:, :, at], data[at]
        for m in range(MODELS):
            out, seen = np.empty((len(data), 8), np.int8), np.zeros(len(data), np.int8)
            for half in (0, 1):
                own = self.lines[lines[m, half]].view(np.int8).reshape(-1, 16)
                seen |= (own[:, 0] > 0).astype(np.int8) << half
                node = np.ones(len(data), np.intp)
                for k in range(4 * half, 4 * half + 4):
                    bit = data >> (7 - k) & 1
                    s = own[np.arange(len(data)), node]
                    out[:, k] = np.where(bit, s, -s)
                    node = 2 * node + bit
            yield out.view("<u8").ravel(), seen

    def by_code(self, data, at):
        """As ``by_line``; a code that comes again is looked up once."""
        coded, tables = self._coded(data)
        at = [c.indices.to_numpy().take(at) for c in coded]
        for found, kind in tables:
            yield self.bits[found].take(at[kind]), self.seen[found].take(at[kind])

    def _coded(self, data):
        """The codes of the longest order and of words, each kind as a dictionary; rows of their entries for each model, and whose entries these are."""
        coded = [pa.array(c.view(np.int64)).dictionary_encode() for c in _codes(data)]
        longest, word = (c.dictionary.to_numpy() for c in coded)
        orders = [_shorter(longest.view(np.uint64), m).view(np.int64) for m in range(len(ORDERS) - 1)] + [longest]
        return coded, [(self.keys.get_indexer(c), 0) for c in orders] + [(self.keys.get_indexer(word), 1)]  # -1, the last row, was never seen

    def _stretch(self, found):
        """x (MODELS, n, 8), gate (n) from 8 bytes and halves seen by model: what the mixer is told of every bit, towards what the bit is."""
        x, gate = None, 0
        for m, (bits, seen) in enumerate(found):
            x = np.empty((MODELS, len(bits), 8), np.float32) if x is None else x
            np.multiply(bits.view(np.int8).reshape(-1, 8), np.float32(1 / SCALE), out=x[m])
            gate = gate + _BOTH.take(seen)
        return x, gate

    def _fixed(self, x, gate):
        """What the gated weights make of every bit (n, 8)."""
        first, second = np.divmod(np.arange(GATES * GATES), GATES)
        weights = np.concatenate([self.gated[first, :4], self.gated[second, 4:]], axis=1).transpose(2, 0, 1).copy()
        out = weights[0].take(gate, axis=0)
        out *= x[0]
        for m in range(1, MODELS):
            own = weights[m].take(gate, axis=0)
            own *= x[m]
            out += own
        return out

    def run(self, data, starts, lengths):
        """log10 probability of each text."""
        # blocks of all texts side by side, the longest first; step i of all blocks stands together
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(lengths)), blocks)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        size = np.minimum(BLOCK, lengths[owner] - part * BLOCK)
        order = np.argsort(-size, kind="stable")
        first, size, owner = (starts[owner] + part * BLOCK)[order], size[order], owner[order]
        steps = int(size[0]) if len(size) else 0
        width = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        lane = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        at = first[lane] + np.repeat(np.arange(steps), width)
        x, gate = self._stretch(self.by_line(data, at) if self.keys is None else self.by_code(data, at))
        fixed = self._fixed(x, gate)
        learnt = np.zeros((MODELS, len(size), 8), np.float32)  # on top of the gated weights, block by block
        a = 0
        for w in width.tolist():
            z = a + w
            now, d, dot = x[:, a:z], learnt[:, :w], fixed[a:z]
            moved = d * now
            dot += moved.sum(axis=0)
            err = np.exp(dot)
            err += 1
            np.divide(np.float32(RATE), err, out=err)
            np.multiply(err, now, out=moved)
            d += moved
            a = z
        # log of the logistic function of ``fixed``, by now the stretched probability of each bit to be what it is
        logp = (np.minimum(fixed, 0) - np.log(1 + np.exp(-np.abs(fixed)))).sum(axis=1, dtype=np.float64)
        return np.bincount(owner[lane], logp, len(lengths)) / np.log(10)

    def gradient(self, data, starts):
        """Gradient of the gated weights over all bytes of the texts, and the number of bits behind it. Bytes whose codes are the same stand together."""
        coded, tables = self._coded(data)
        longest, word = (c.indices.to_numpy().astype(np.int64)[_places(data, starts)] for c in coded)
        pairs, times = np.unique(longest * len(coded[1].dictionary) + word, return_counts=True)
        at = np.divmod(pairs, len(coded[1].dictionary))
        x, gate = self._stretch((self.bits[found].take(at[kind]), self.seen[found].take(at[kind])) for found, kind in tables)
        err = times[:, None].astype(np.float32) / (1 + np.exp(self._fixed(x, gate)))
        x *= err
        both = np.array([[np.bincount(gate, x[m, :, k], GATES * GATES) for m in range(MODELS)] for k in range(8)])
        both = both.transpose(2, 0, 1).reshape(GATES, GATES, 8, MODELS)
        seen = np.bincount(gate, times, GATES * GATES).reshape(GATES, GATES)
        moved = np.concatenate([both.sum(axis=1)[:, :4], both.sum(axis=0)[:, 4:]], axis=1)
        return moved, np.repeat(np.stack([seen.sum(axis=1), seen.sum(axis=0)], axis=1), 4, axis=1)


def _steps(texts, rounds):
    """The texts in lists of SLICE bytes or less (a longer text is alone), in ``rounds`` lists or more if there are as many texts."""
    most = min(SLICE, -(-sum(map(len, texts)) // rounds))
    out, size = [], 0
    for text in texts:
        if not out or size + len(text) > most:
            out.append([])
            size = 0
        out[-1].append(text)
        size += len(text)
    return out


def fit_weights(docs, counts, rounds=ROUNDS):
    """Gated weights from all of docs ``(block, text)``, each row once. A block takes steps over its texts against the counts of the other
    half; the weights of all blocks are averaged, each by the bits behind it."""
    begun = np.full((GATES, 8, MODELS), 0.35, np.float32)

    def step(given: pa.Table, group: pa.Table) -> pa.Table:
        keys, table = _tables(given)
        mixer = Mixer(table, begun, keys)
        square, bits = np.full(begun.shape, 1e-8), np.zeros(begun.shape[:2])
        for texts in _steps(sorted(group.column("text").to_pylist(), key=lambda t: (zlib.crc32(t.encode("utf-8", "surrogatepass")), t)), rounds):
            moved, seen = mixer.gradient(*joined(texts)[:2])
            g = moved / np.maximum(seen, 200)[:, :, None]
            square += g * g
            mixer.gated = (mixer.gated + 0.12 * g / np.sqrt(square)).astype(np.float32)
            bits += seen
        return pa.table({"weights": pa.array([mixer.gated.astype(np.float64).tobytes()], pa.binary()), "bits": pa.array([bits.tobytes()], pa.binary())})

    given = block_codes(counts.filter(F.col("block") % 3 != OTHER), lambda n, kind: n[REST if kind == FIT else FIT])
    fitted = given.groupBy("block").cogroup(docs.select("block", "text").groupBy("block")).applyInArrow(step, "weights binary, bits binary")

    def added(batches):
        total, bits = np.zeros(begun.shape), np.zeros(begun.shape[:2])
        for batch in batches:
            for w, b in zip(batch.column("weights").to_pylist(), batch.column("bits").to_pylist()):
                own = np.frombuffer(b).reshape(bits.shape)
                total += np.frombuffer(w).reshape(total.shape) * own[:, :, None]
                bits += own
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([bits.tobytes()], pa.binary())], names=["weights", "bits"])

    total, bits = np.zeros(begun.shape), np.zeros(begun.shape[:2])
    for r in fitted.mapInArrow(added, "weights binary, bits binary").collect():  # a few KB a task
        total += np.frombuffer(r["weights"]).reshape(total.shape)
        bits += np.frombuffer(r["bits"]).reshape(bits.shape)
    return np.where(bits[:, :, None] > 0, total / np.maximum(bits, 1)[:, :, None], begun).astype(np.float32)


WORDS = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
WORDS_DDL = "part bigint, block bigint, size bigint, words binary, counts binary"


def _count_words(parts):
    """Training count of each distinct word of the rows of a block in a task (0 for words of other rows): a row for every part of the words."""
    def rows_of(held):
        for block, own in held.items():
            by_part = defaultdict(list)
            for word in own:
                by_part[zlib.crc32(word.encode("utf-8", "surrogatepass")) % parts].append(word)
            out = defaultdict(list)
            for part, names in by_part.items():
                names.sort()  # what begins alike packs well
                n = np.fromiter(map(own.__getitem__, names), np.uint64, len(names))
                for k, v in zip(WORDS.names, (part, block, len(names), _zipped(names), _packed(n))):
                    out[k].append(v)
            if out:
                yield rows(WORDS, out)

    def run(batches):
        held = defaultdict(Counter)
        for whole in batches:
            for batch in slices(whole, chars=SLICE):
                for block, trains, text in zip(batch.column("block").to_pylist(), batch.column("trains").to_pylist(), batch.column("text").to_pylist()):
                    words = tokens_of(text)
                    if block not in held and held:
                        yield from rows_of(held)
                        held = defaultdict(Counter)
                    if trains:
                        held[block].update(words)
                    else:
                        held[block].update(dict.fromkeys(words, 0))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from rows_of(held)
                    held = defaultdict(Counter)
        yield from rows_of(held)

    return run


def _zipped(names):
    """Words, which hold no line feed, as one compressed value."""
    return zlib.compress("\n".join(names).encode("utf-8", "surrogatepass"), 1)


def _unzipped(data):
    return zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n")


def word_counts(dealt, parts=1):
    """block, words, size, counts, total, distinct: the words of a block with their counts in all training texts; total and distinct sum up to
    the number of words in training texts and of distinct ones."""
    def run(group: pa.Table) -> pa.Table:
        given = group.to_pylist()
        total = Counter()
        for r in given:
            total.update(dict(zip(_unzipped(r["words"]), _unpacked(r["counts"], r["size"], "<u8").tolist())))
        first = [0] * (len(given) - 1)
        return pa.table({k: pa.array([r[k] for r in given]) for k in ("block", "size", "words")} | {
            "counts": pa.array([_packed(np.fromiter(map(total.__getitem__, _unzipped(r["words"])), np.uint64, r["size"])) for r in given], pa.binary()),
            "total": pa.array([sum(total.values()), *first], pa.int64()), "distinct": pa.array([sum(n > 0 for n in total.values()), *first], pa.int64())})

    return dealt.select("block", "trains", "text").sortWithinPartitions("block").mapInArrow(_count_words(parts), WORDS_DDL).groupBy("part").applyInArrow(
        run, "block bigint, size bigint, words binary, counts binary, total bigint, distinct bigint")


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()),
    ("n_bytes", pa.int64()), ("score", pa.float64())])


def lm_score(docs, id_col="doc_id", text_col="text", folds=FOLDS, held_out=HELD_OUT):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    docs = plain_docs(docs, id_col, text_col)
    fold = training_fold("doc_id", folds)
    trains = F.coalesce(fold != held_out, F.lit(False))
    size = total_bytes(docs)
    kind = F.when(~trains, OTHER).when(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, FIT).otherwise(REST)
    n = parts_for(size, 2 * BLOCK_BYTES)
    # documents that do not train are fewer, so are their blocks
    block = F.pmod(F.xxhash64("doc_id", "text"), F.when(trains, n).otherwise(parts_for(n, 3))) * 3 + kind
    dealt = docs.select("doc_id", "text", trains.alias("trains"), F.coalesce(fold == held_out, F.lit(False)).alias("held_out"),
                        block.alias("block")).repartition(3 * n, "block")
    training = dealt.filter("trains")
    with shuffles_freed(docs.sparkSession):
        counts = written(code_counts(dealt, parts_for(size, PART_BYTES)), "counts")
        gated = fit_weights(training, counts)

    with shuffles_freed(docs.sparkSession):
        counted = written(word_counts(dealt, parts_for(size, PART_BYTES)), "words")
    total, distinct = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    ends = training.count()
    n_train, n_words = total + ends, distinct + (1 if ends else 0)

    def score(given: pa.Table, group: pa.Table) -> pa.Table:
        logs = {}
        for r in given.filter(pc.is_valid(given.column("words"))).to_pylist():
            logs.update(zip(_unzipped(r["words"]), np.log10(_unpacked(r["counts"], r["size"], "<u8") + 1.0).tolist()))
        packed = given.filter(pc.is_valid(given.column("codes")))
        keys, table = _tables(packed)
        mixer = Mixer(table, gated, keys)
        out = []
        for whole in group.combine_chunks().to_batches():
            for batch in slices(whole, chars=SLICE // 2):
                texts = batch.column("text").to_pylist()
                data, starts, lengths = joined(texts)
                own = [[logs[w] for w in tokens_of(t)] for t in texts]
                out.append(rows(RESULT, {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "n_tokens": [len(o) + 1 for o in own],
                    "n_known": [len(o) - o.count(0.0) + (ends > 0) for o in own], "log_counts": [float(np.sum(o)) + np.log10(ends + 1.0) for o in own],
                    "n_bytes": lengths, "score": mixer.run(data, starts, lengths)}))
        return pa.Table.from_batches(out, RESULT)

    given = counted.select("block", "size", "words", "counts").unionByName(block_codes(counts, lambda n, kind: n.sum(axis=0)), allowMissingColumns=True)
    scored = given.groupBy("block").cogroup(dealt.select("block", "doc_id", "text", "held_out").groupBy("block")).applyInArrow(
        score, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, log_counts double, n_bytes bigint, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * float(np.log10(n_train + n_words + 1))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
