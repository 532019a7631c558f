"""Line dedup by content-defined chunks of lines and by runs of lines of ``PASSAGE_WORDS`` words.

A text is cut into chunks of lines. A rolling hash over the hashes of the last two lines decides where a chunk ends, so an
inserted or lost line moves the boundaries near it only; a line of ``LONG_WORDS`` words or more is as long as several lines and
is a chunk by itself. Chunks of two lines or more, and long lines, are compared over all documents.

Chunks that reach over the start or end of a passage match nothing, so the shortest runs of lines that reach ``PASSAGE_WORDS`` words,
from each line on and up to each line, are compared as well. Every repeated run of so many words is a union of such runs,
however its lines are cut, so all of it is found. Runs of one and the same line over and over are no passage.

Chunks and runs meet by hash, and count as repeated only if their bytes agree. All occurrences but the first, by (doc_id, place), are
taken out of the text; an occurrence that overlaps the first one (a text that repeats itself at once) stays.

Null texts count as empty. A null doc_id comes before all others. Rows that agree in doc_id and text are one document and are
treated alike. Chunks whose hashes agree and whose bytes do not are left alone. An empty table gives an empty result. All
columns of the input are kept.
"""

import pyarrow as pa
from pyspark.sql import functions as F

from .common import written

LONG_WORDS = 25
MIN_WORDS = 10  # shorter chunks (blank or near-blank lines) are left alone
MEAN_LINES = 3
PASSAGE_WORDS = 50


def line_chunks(text: str, long_words=LONG_WORDS, mean=MEAN_LINES):
    """(lines of the text, list of (first line, end line, eligible))."""
    import xxhash
    lines = text.split("\n")
    out, start, last, words = [], 0, 0, 0

    def close(end):
        nonlocal start, words
        if end > start:
            filled = sum(1 for x in lines[start:end] if x.strip())
            out.append((start, end, words >= MIN_WORDS and filled > 1))
        start, words = end, 0

    for i, line in enumerate(lines):
        n = len(line.split())
        if n >= long_words:
            close(i)
            out.append((i, i + 1, True))
            start, last = i + 1, 0
            continue
        words += n
        own = xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))
        rolled = (last * 0x9E3779B97F4A7C15 + own) & 0xFFFFFFFFFFFFFFFF
        last = own
        if (rolled >> 20) % mean == 0:
            close(i + 1)
    close(len(lines))
    return lines, out


def passages(lines, words=PASSAGE_WORDS):
    """(first line, end line) of the shortest runs of two lines or more that reach so many words, from and up to each filled line."""
    filled = [(i, n) for i, n in enumerate(len(x.split()) for x in lines) if n]
    out, start, total = set(), 0, 0
    other = [len(filled)] * len(filled)  # the next filled line that is not the same line again
    for j in range(len(filled) - 2, -1, -1):
        other[j] = other[j + 1] if lines[filled[j][0]] == lines[filled[j + 1][0]] else j + 1
    up_to = 0
    for j, (i, n) in enumerate(filled):
        total += n
        while total - filled[start][1] >= words:  # lines start..j reach the words without their first one
            if up_to <= start < j and other[start] <= j:
                out.add((filled[start][0], i + 1))
            up_to = max(up_to, start + 1)
            total -= filled[start][1]
            start += 1
        if total >= words:
            if start < j and other[start] <= j:
                out.add((filled[start][0], i + 1))
            # the run from each line that first reaches the words here
            while up_to <= start:
                if up_to < j and other[up_to] <= j:
                    out.add((filled[up_to][0], i + 1))
                up_to += 1
    return out


def spans(text: str):
    """Sorted (first line, end line) of the chunks and passages of a text that are compared."""
    lines, found = line_chunks(text)
    return lines, sorted({(a, z) for a, z, eligible in found if eligible} | passages(lines))


def _hashes(lines, found):
    """(k1, k2) of each span."""
    import xxhash
    ends, data = [0], "\n".join(lines).encode("utf-8", "surrogatepass")
    for x in lines:
        ends.append(ends[-1] + 1 + (len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))))
    for a, z in found:
        own = data[ends[a]:ends[z] - 1]
        yield xxhash.xxh64_intdigest(own) - (1 << 63), xxhash.xxh64_intdigest(own, 7) - (1 << 63)


def _rows(located):
    """Hashes of all spans, with their places or without."""
    fields = [("k1", pa.int64()), ("k2", pa.int64())]
    schema = pa.schema(([("did", pa.int64()), ("dkey", pa.int64()), ("seq", pa.int32()), ("stop", pa.int32())] if located else []) + fields)

    def run(batches):
        for batch in batches:
            out = [[] for _ in schema]
            for did, dkey, text in zip(*(batch.column(c).to_pylist() for c in ("did", "dkey", "text"))):
                lines, found = spans(text)
                for (a, z), keys in zip(found, _hashes(lines, found)):
                    for column, value in zip(out, (did, dkey, a, z, *keys) if located else keys):
                        column.append(value)
                if len(out[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run, ("did bigint, dkey bigint, seq int, stop int, " if located else "") + "k1 bigint, k2 bigint"


def _bytes(batches):
    """did, dkey, seq, k1, k2, chunk of the places in ``at``."""
    schema = pa.schema([("did", pa.int64()), ("dkey", pa.int64()), ("seq", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.string())])
    for batch in batches:
        out = [[] for _ in schema]
        size = 0
        for did, dkey, text, at in zip(*(batch.column(c) for c in ("did", "dkey", "text", "at"))):
            lines, did, dkey = text.as_py().split("\n"), did.as_py(), dkey.as_py()
            for x in at.as_py():
                chunk = "\n".join(lines[x["seq"]:x["stop"]])
                size += len(chunk)
                for column, value in zip(out, (did, dkey, x["seq"], x["k1"], x["k2"], chunk)):
                    column.append(value)
            if size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                out, size = [[] for _ in schema], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)


def _keyed(docs, id_col, text_col):
    """did and dkey name a document; neither is null."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))), F.xxhash64(F.col(id_col).cast("bigint"), text), text


def occurrences(docs, id_col="doc_id", text_col="text"):
    """did, dkey, seq, stop, k1, k2: spans whose hashes stand in more than one place."""
    did, dkey, text = _keyed(docs, id_col, text_col)
    given = docs.select(did.alias("did"), dkey.alias("dkey"), text.alias("text"))
    again = given.mapInArrow(*_rows(False)).groupBy("k1", "k2").count().filter("count > 1").select("k1", "k2")
    # a span that stands in a third of all documents is a hot key of this join; one side has one row a key, so it can be split
    return given.mapInArrow(*_rows(True)).join(again, ["k1", "k2"])


def firsts(docs, found, id_col="doc_id", text_col="text"):
    """k1, k2, first (did, dkey, seq) of the spans in ``found`` whose bytes agree wherever their hashes do."""
    did, dkey, text = _keyed(docs, id_col, text_col)
    at = found.groupBy("did", "dkey").agg(F.collect_set(F.struct("seq", "stop", "k1", "k2")).alias("at"))  # at most three a line of one document
    # what repeats grows with the corpus, so it is never broadcast, however small it is here: the same plan at every size
    rows = docs.select(did.alias("did"), dkey.alias("dkey"), text.alias("text")).join(at.hint("merge"), ["did", "dkey"]).mapInArrow(
        _bytes, "did bigint, dkey bigint, seq int, k1 bigint, k2 bigint, chunk string")
    # the text itself is a grouping column: that is the byte comparison, and copies fold before the shuffle
    same = rows.groupBy("k1", "k2", "chunk").agg(F.min(F.struct("did", "dkey", "seq")).alias("first"))
    return same.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).filter("texts = 1").drop("texts")


def removals(found, first):
    """did, dkey, spans: the lines (seq, stop) that leave each document."""
    same = (F.col("first.did") == F.col("did")) & (F.col("first.dkey") == F.col("dkey"))
    gone = found.join(first, ["k1", "k2"]).filter(~(same & (F.col("seq") - F.col("first.seq") < F.col("stop") - F.col("seq"))))
    return gone.groupBy("did", "dkey").agg(F.collect_set(F.struct("seq", "stop")).alias("spans"))  # at most three a line of one document


def without(text: str, seqs) -> str:
    gone = set(seqs)
    lines, found = line_chunks(text)
    return "\n".join(x for a, z, _ in found if a not in gone for x in lines[a:z])


def without_lines(text: str, gone) -> str:
    lines = text.split("\n")
    out = {i for a, z in gone for i in range(a, z)}
    return "\n".join(x for i, x in enumerate(lines) if i not in out)


def runs_of(gone) -> int:
    """Number of unbroken runs of lines in spans."""
    n, end = 0, -1
    for a, z in sorted(gone):
        n += a > end
        end = max(end, z)
    return n


def line_dedup(docs, id_col="doc_id", text_col="text"):
    """The input with repeated passages taken out of its text, and n_removed, the number of unbroken runs of lines taken out."""
    found = written(occurrences(docs, id_col, text_col), "occurrences")
    gone = written(removals(found, firsts(docs, found, id_col, text_col)), "removals")
    did, dkey, _ = _keyed(docs, id_col, text_col)
    cut, runs = F.pandas_udf(_cut, "string"), F.pandas_udf(_runs, "int")
    d, k, s, n = ("_ld_did", "_ld_dkey", "_ld_spans", "n_removed")
    gone = gone.select(F.col("did").alias(d), F.col("dkey").alias(k), F.flatten(F.transform("spans", lambda x: F.array(x["seq"], x["stop"]))).alias(s))
    kept = [c for c in docs.columns if c != n]
    joined = docs.select(*kept).withColumns({"_ld_d": did, "_ld_k": dkey}).join(
        gone.hint("merge"), (F.col("_ld_d") == F.col(d)) & (F.col("_ld_k") == F.col(k)), "left")
    text = F.when(F.col(s).isNotNull(), cut(F.coalesce(F.col(text_col), F.lit("")), F.col(s))).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in kept], F.coalesce(runs(F.col(s)), F.lit(0)).alias(n))


def _pairs(flat):
    return [(int(a), int(z)) for a, z in zip(flat[::2], flat[1::2])]


def _cut(text, spans):
    return text.combine(spans, lambda t, s: t if s is None else without_lines(t, _pairs(s)))


def _runs(spans):
    return spans.map(lambda s: 0 if s is None else runs_of(_pairs(s)))
