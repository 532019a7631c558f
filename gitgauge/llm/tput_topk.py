"""Exact top-k by inner product with the three-phase uniform threshold algorithm.

Every vector is cut into ``PARTS`` slices of dimensions; the lists of a slice hold the inner products of that slice alone, and a
score is the sum over slices. Phase one: each slice gives its k best local scores of every query; the exact scores of those
vectors are looked up, and the k-th of them is a cutoff t that at least k vectors reach. Phase two: t is sent to all slices with the
queries, and each gives all local scores of t / PARTS or more; a vector that no slice gives has a score below t. Phase three: local
scores that are missing are looked up, sums are exact, and the k best are kept.

Queries and candidates meet in cells: a block of queries and a block of candidates, both of bounded size, and in phase one a slice, so a
query meets all rows and no task holds more than one cell. Phases two and three run in cells of all slices, where what is missing is at
hand: local scores above a share of the cutoff are many (their number grows with queries times rows) and never leave their cell, which
gives its k best sums of t or more for each query. Components are integers; products run in float64 while their sums stay below
2**53, and as Python integers beyond.

Vectors that are null, or hold a null or a component that is not finite, and null ids take no part. Vectors of unequal length are
read as if filled up with zeros; empty ones are all zeros. Rows that agree in id and vector count once; rows with a query's own id are
never its results, and of several vectors of one query id each is a query of its own, told apart by nothing, so ids should be unique.
Scores beyond 64 bits are held at the limits. An empty table gives an empty result. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import parts_for, written

PARTS = 2
QUERIES = 1_024  # in a cell
CANDIDATES = 8_192
LIMIT = 1 << 53
_KEY = ["part", "qb", "cb"]


def vectors(table, id_col="vec_id", vector_col="embedding", scale=64):
    """vec_id, v: usable rows with integer components, each row once. Components are held within 60 bits."""
    raw = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    bound = float(1 << 60)
    v = F.transform("x", lambda e: F.floor(F.least(F.greatest(e * float(scale), F.lit(-bound)), F.lit(bound))).cast("bigint"))
    return raw.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~bad).select("vec_id", v.alias("v")).dropDuplicates()


def _size(width, parts):
    """Dimensions of a slice."""
    return -(-max(1, width) // parts)


def _sliced(v, width, parts):
    size = _size(width, parts)
    return v.select("vec_id", F.posexplode(F.array(*[F.slice("v", p * size + 1, size) for p in range(parts)])).alias("part", "v"))


def _cells(candidates, queries, n_query, n_cand):
    """Rows of candidates and of queries, each copied to the cells where it meets the other kind."""
    own = F.xxhash64("vec_id")
    cand = candidates.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))).alias("qb"),
                             F.pmod(own, F.lit(n_cand)).cast("int").alias("cb"), F.lit(False).alias("query"))
    query = queries.select("*", F.pmod(own, F.lit(n_query)).cast("int").alias("qb"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_cand - 1))).alias("cb"), F.lit(True).alias("query"))
    return cand.unionByName(query, allowMissingColumns=True)


def matrix(column):
    """Rows of integers of one length (shorter ones filled up with zeros) and the largest absolute value."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(lists.offsets.to_numpy())
    width = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out, int(np.abs(out).max()) if out.size else 0


def products(q, c):
    """Exact inner products of all rows of two (matrix, largest value) pairs, as float64 or Python integers."""
    (a, ma), (b, mb) = q, c
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    if ma * mb * max(1, width) < LIMIT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def _clamp(values):
    return [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in values]


def _split(table: pa.Table):
    import pyarrow.compute as pc
    q = table.filter(table.column("query"))
    c = table.filter(pc.invert(table.column("query")))
    return q.column("vec_id").to_numpy(), q, c.column("vec_id").to_numpy(), c


PAIRS = "query_id bigint, vec_id bigint, part int, local bigint"


def _pairs(part, q, c, local):
    return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(c, pa.int64()), "part": pa.array([part] * len(q), pa.int32()),
                     "local": pa.array(_clamp(local) if isinstance(local, list) or local.dtype == object else local.astype(np.int64), pa.int64())})


def _cell_scores(table):
    """(part, query ids, candidate ids, row blocks of (first query, scores)); a query's own id never scores."""
    qi, q, ci, c = _split(table)
    part = table.column("part")[0].as_py()
    if not len(qi) or not len(ci):
        return part, qi, ci, []
    qm, cm = matrix(q.column("v")), matrix(c.column("v"))

    def blocks():
        for i in range(0, len(qi), 128):
            yield i, products((qm[0][i:i + 128], qm[1]), cm)

    return part, qi, ci, blocks()


def local_lists(cells, k):
    """Phase one: the k best local scores of each query in each cell, then in each slice."""
    def best(table: pa.Table) -> pa.Table:
        part, qi, ci, blocks = _cell_scores(table)
        out_q, out_c, out_s = [], [], []
        for first, s in blocks:
            for j, row in enumerate(s):
                other = np.flatnonzero(ci != qi[first + j])
                row = row[other]
                if len(row) > k:
                    kth = np.partition(row, len(row) - k)[len(row) - k]
                    sure, tied = np.flatnonzero(row > kth), np.flatnonzero(row == kth)
                    tied = tied[np.argsort(ci[other[tied]], kind="stable")][:k - len(sure)]
                    at = np.concatenate([sure, tied])
                else:
                    at = np.arange(len(row))
                out_q += [qi[first + j]] * len(at)
                out_c += ci[other[at]].tolist()
                out_s += row[at].tolist()
        return _pairs(part, out_q, out_c, out_s)

    order = Window.partitionBy("query_id", "part").orderBy(F.desc("local"), "vec_id")
    return cells.groupBy(*_KEY).applyInArrow(best, PAIRS).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def above_cutoff(cells, k, size, parts):
    """Phases two and three in cells of whole vectors: (query_id, vec_id, score), for each query and cell the k best sums of the query's cutoff
    or more among the vectors that some slice gives; a query without a cutoff takes all."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def enough(table: pa.Table) -> pa.Table:
        qi, q, ci, c = _split(table)
        if not len(qi) or not len(ci):
            return schema.empty_table()
        (a, ma), (b, mb) = matrix(q.column("v")), matrix(c.column("v"))
        cuts = q.column("cutoff").to_pylist()
        found = []
        for first in range(0, len(qi), 128):
            ids, cut = qi[first:first + 128], cuts[first:first + 128]
            local = [products((a[first:first + 128, x:x + size], ma), (b[:, x:x + size], mb)) for x in range(0, size * parts, size)]
            given = np.zeros(local[0].shape, bool)
            for s in local:
                # local * parts >= t in integers is local >= ceil(t / parts)
                low = np.array([-float("inf") if t is None else -(-t // parts) for t in cut], object if s.dtype == object else np.float64)
                given |= (s >= low[:, None]).astype(bool)
            i, j = np.nonzero(given & (ids[:, None] != ci[None, :]))
            exact = object if any(s.dtype == object for s in local) else np.int64
            score = sum(s[i, j].astype(np.int64).astype(exact) if s.dtype != object else s[i, j] for s in local)
            reach = np.flatnonzero(np.array([x is None for x in cut])[i] | (score >= np.array([x or 0 for x in cut], exact)[i]).astype(bool))
            i, j, score = i[reach], j[reach], score[reach]
            if exact is object:
                order = np.array(sorted(range(len(i)), key=lambda x: (i[x], -score[x], ci[j[x]])), np.int64)
            else:
                order = np.lexsort((ci[j], -score, i))
            i, j, score = i[order], j[order], score[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append(pa.table([pa.array(ids[i[best]], pa.int64()), pa.array(ci[j[best]], pa.int64()), pa.array(_clamp(score[best]), pa.int64())], schema=schema))
        return pa.concat_tables(found)

    return cells.groupBy("qb", "cb").applyInArrow(enough, "query_id bigint, vec_id bigint, score bigint")


def looked_up(cells, wanted, n_query, n_cand):
    """Local scores of (query_id, vec_id, part) wanted: pairs go to the cell that holds both slices."""
    asked = wanted.select(
        "part", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int").alias("qb"),
        F.pmod(F.xxhash64("vec_id"), F.lit(n_cand)).cast("int").alias("cb"), "query_id", "vec_id")

    def look(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return _pairs(0, [], [], [])
        qi, q, ci, c = _split(table)
        (a, ma), (b, mb) = matrix(q.column("v")), matrix(c.column("v"))
        width = min(a.shape[1], b.shape[1])
        qo, co = np.argsort(qi, kind="stable"), np.argsort(ci, kind="stable")
        aq, ac = asked.column("query_id").to_numpy(), asked.column("vec_id").to_numpy()
        out = []
        for i in range(0, len(aq), 65_536):
            x = a[qo[np.searchsorted(qi[qo], aq[i:i + 65_536])], :width]
            y = b[co[np.searchsorted(ci[co], ac[i:i + 65_536])], :width]
            if ma * mb * max(1, width) < LIMIT:
                out += np.einsum("ij,ij->i", x, y).tolist()
            else:
                out += _clamp((x.astype(object) * y.astype(object)).sum(axis=1))
        return _pairs(asked.column("part")[0].as_py(), aq, ac, out)

    return cells.groupBy(*_KEY).cogroup(asked.groupBy(*_KEY)).applyInArrow(look, PAIRS)


def top_k(table, queries, k=20, id_col="vec_id", vector_col="embedding", parts=PARTS, n_queries=QUERIES, n_candidates=CANDIDATES):
    """query_id, rank, vec_id, score: the k best other rows of each query; ``queries`` is a condition on vec_id."""
    v = written(vectors(table, id_col, vector_col), "vectors")
    total, asked, width = v.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(queries.cast("long")), F.lit(0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_query, n_cand = parts_for(asked, n_queries), parts_for(total, n_candidates)
    sliced = _sliced(v, width, parts)
    cells = _cells(sliced, sliced.filter(queries), n_query, n_cand)

    first = written(local_lists(cells, k), "lists")
    every = F.explode(F.array(*[F.lit(p) for p in range(parts)])).alias("part")
    pairs = first.select("query_id", "vec_id").distinct().select("query_id", "vec_id", every)
    missing = pairs.join(first, ["query_id", "vec_id", "part"], "left_anti")
    sums = first.unionByName(looked_up(cells, missing, n_query, n_cand)).groupBy("query_id", "vec_id").agg(F.sum("local").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = sums.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff"))

    told = _cells(v, v.filter(queries).join(cutoffs, "vec_id", "left"), n_query, n_cand)
    totals = above_cutoff(told, k, _size(width, parts), parts)
    return totals.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
