"""Turns in order, with their places, running sums and hashes of the path up to them, without a task that holds a conversation.

Rows are dealt by range over all columns that order them, so a conversation of any length is spread over tasks. A task numbers and sums
what it has of each conversation. Only the last conversation of a task can go on in the next one, so one row of totals for each
task, gathered by the driver, is enough to put the parts together.

The hash of a path is a polynomial over the digests of its turns, modulo four primes (124 bits in two longs). It can be summed in
parts like a count, and equal paths have equal hashes whatever conversation they are in. Two different paths agree by chance with 2**-112 or
less; texts made to collide are not guarded against.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import task_count
from .common import written

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1442695041, 1664525013, 1812433253)
LANES = ["t0", "t1", "t2", "t3"]
HASH = ["h1", "h2"]
NO_ID = -(1 << 63)  # stands for a null conv_id where there has to be a number


def digest(*columns):
    """Four numbers of 28 bits from columns of text; lengths keep ("ab", "c") and ("a", "bc") apart."""
    parts = [x for c in columns for x in (F.octet_length(c).cast("string"), F.lit(":"), F.col(c))]
    sha = F.sha2(F.concat(*parts), 256)
    return [F.conv(F.substring(sha, 1 + 7 * i, 7), 16, 10).cast("bigint").alias(t) for i, t in enumerate(LANES)]


def plain_turns(conversations, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text"):
    """conv, turn, role, text and the digest of each turn; nulls in role and text are empty texts."""
    rows = conversations.select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.select("*", *digest("role", "text"), F.substring("text", 1, 100).alias("opening"))


def turn_order():
    """Order inside all conversations: by turn, null first; ties by role, the first 100 characters and a digest. Rows equal in all of it are equal."""
    return [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("opening"), *map(F.col, LANES), F.col("salt")]


def _powers(base, exponent, prime):
    """base ** exponent for an array of exponents."""
    out, square, e = np.ones(len(exponent), np.int64), base, exponent.copy()
    while e.any():
        odd = (e & 1).astype(bool)
        out[odd] = out[odd] * square % prime
        square, e = square * square % prime, e >> 1
    return out


def _scan(schema, sums):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        first = last = None
        state = np.zeros(1 + len(LANES) + len(sums), np.int64)  # of the conversation that the last batch ended in
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv").to_numpy(zero_copy_only=False)
            first = int(conv[0]) if first is None else first
            new = np.append(last is None or conv[0] != last, conv[1:] != conv[:-1])
            begin = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: goes on from the last batch
            goes_on = begin < 0

            def running(values, carry):
                total = np.cumsum(values)
                return total - np.where(begin > 0, total[begin - 1], 0) + np.where(goes_on, carry, 0)

            place = running(np.ones(n, np.int64), state[0])
            columns = {"part": np.full(n, part), "pos": place}
            for i, (lane, base, prime) in enumerate(zip(LANES, BASES, PRIMES)):
                term = batch.column(lane).to_numpy(zero_copy_only=False) * _powers(base, place, prime) % prime
                columns[f"sum_{lane}"] = running(term, state[1 + i]) % prime
                columns[lane] = term
            for i, c in enumerate(sums):
                columns[f"sum_{c}"] = running(batch.column(c).to_numpy(zero_copy_only=False), state[1 + len(LANES) + i])
            last = int(conv[-1])
            state = np.array([columns[c][-1] for c in ["pos", *[f"sum_{x}" for x in [*LANES, *sums]]]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name].astype(np.int64)) if f.name in columns else pa.nulls(n, f.type) if f.name == "first_conv" else batch.column(f.name)
                 for f in schema], schema=schema)
        if last is not None:
            names = ["pos", *[f"sum_{x}" for x in [*LANES, *sums]]]
            values = dict(zip(names, state.tolist())) | {"part": part, "conv": last, "first_conv": first}
            yield pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], f.type) for f in schema], schema=schema)

    return run


def _carries(ends, sums):
    """What each task's first conversation has before it, from one row of totals for each task."""
    out, before = [], None
    for r in sorted(ends, key=lambda r: r["part"]):
        if before and before["conv"] == r["first_conv"]:
            out.append((r["part"], r["first_conv"], before["pos"], *[pow(b, before["pos"], p) for b, p in zip(BASES, PRIMES)],
                        *[before[f"sum_{c}"] for c in [*LANES, *sums]]))
        if before and before["conv"] == r["first_conv"] == r["conv"]:  # the whole task lies inside one conversation
            n = before["pos"]
            joined = {"conv": r["conv"], "pos": n + r["pos"]}
            for lane, b, p in zip(LANES, BASES, PRIMES):
                joined[f"sum_{lane}"] = (before[f"sum_{lane}"] + pow(b, n, p) * r[f"sum_{lane}"]) % p
            before = joined | {f"sum_{c}": before[f"sum_{c}"] + r[f"sum_{c}"] for c in sums}
        else:
            before = r.asDict()
    return out


def paths(rows, order, sums=(), purpose="turn-paths"):
    """The rows with ``pos`` (from 1 in each ``conv``), the hash h1, h2 of the path up to and with the row, the hash p1, p2 of that before
    it, and ``sum_<column>`` for each column of ``sums``. ``rows`` has conv (never null), the four digest columns and whatever else."""
    spark, sums = rows.sparkSession, list(sums)
    added = [T.StructField(c, T.LongType()) for c in ["part", "pos", *[f"sum_{c}" for c in [*LANES, *sums]], "first_conv"]]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + added)
    from pyspark.sql.pandas.types import to_arrow_schema
    dealt = rows.repartitionByRange(task_count(rows), *order).sortWithinPartitions(*order)
    local = written(dealt.mapInArrow(_scan(to_arrow_schema(schema), sums), schema), purpose)
    ends = local.filter("first_conv IS NOT NULL").select("conv", "first_conv", "part", "pos", *[f"sum_{c}" for c in [*LANES, *sums]]).collect()
    names = ["part", "conv", "c_n", *[f"c_b{i}" for i in range(4)], *[f"c_{c}" for c in [*LANES, *sums]]]
    carry = spark.createDataFrame(_carries(ends, sums), ", ".join(f"{c} bigint" for c in names))
    out = local.filter("first_conv IS NULL").join(F.broadcast(carry), ["part", "conv"], "left")  # at most one row for each task
    zero = F.lit(0).cast("bigint")
    lane, term = {}, {}
    for i, (c, p) in enumerate(zip(LANES, PRIMES)):
        shift = F.coalesce(F.col(f"c_b{i}"), F.lit(1).cast("bigint"))
        lane[c] = (F.coalesce(F.col(f"c_{c}"), zero) + shift * F.col(f"sum_{c}")) % p
        term[c] = F.pmod(lane[c] - shift * F.col(c) % p, F.lit(p).cast("bigint"))

    def packed(x, name):
        return [(x[a] * (1 << 31) + x[b]).alias(f"{name}{i}") for i, (a, b) in enumerate((LANES[:2], LANES[2:]), 1)]

    kept = [c for c in rows.columns if c not in LANES]
    return out.select(*kept, (F.col("pos") + F.coalesce("c_n", zero)).alias("pos"), *packed(lane, "h"), *packed(term, "p"),
                      *[(F.col(f"sum_{c}") + F.coalesce(F.col(f"c_{c}"), zero)).alias(f"sum_{c}") for c in sums])


def ordered_turns(turns, sums=(), purpose="turns"):
    """paths of plain_turns (and any columns added to it), in the order of turn_order."""
    salted = turns.withColumn("salt", F.monotonically_increasing_id())
    return paths(salted, turn_order(), sums, purpose).drop("salt", "opening")
