"""The newest n commits of each repository and their paths, kept as stream state.

One stateful operator sees commits and touches in any order. Its groups are (salt of the commit, salt of the path): the touches of a hot
repository or a hot commit are spread over groups, and a commit goes to the groups of all path salts, so each group knows the newest n
commits among those with its salt. A commit that is pushed out of them can never come back, so its paths leave the state. Paths
are held in chunks of limited size, which no task needs together. What a reader asks for, the newest n of all salts, is among the
newest n of each.

Spark hands rows to such an operator one by one, in Python. So before the shuffle each task packs rows of the same group into pieces, Arrow
streams of limited size, and a group works on whole pieces. The touches of a micro-batch wait until all its commits are known, in memory
and beyond ``HELD`` bytes in a temporary file of the worker; only those that nothing pushed out reach the state, where every commit costs
several calls.

State (RocksDB): ``newest`` repo -> commits, ``entries`` commit -> number of lists that hold it and of its chunks, ``chunks`` (commit, number)
-> paths. It grows with repositories * n and their paths, not with the history. Touches whose commit does not come in the same micro-batch wait
for it in the state; those that come after their commit was pushed out wait in vain, and are the only rows kept without use.
"""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CONF = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    # Spark measures a batch after each row to hold a limit in bytes, which costs more than all else here; paths are short and pieces small
    "spark.sql.execution.arrow.maxBytesPerBatch": str(2**31 - 1),
}
CHUNK = 1_000  # paths in one value of the state
PACKED = 100_000  # rows that a task packs together
PIECE = 8_192  # bytes of a piece, about
MERGED = 50_000  # commits that a group takes up before it looks for the newest of them
HELD = 32_000_000  # bytes of touches that a group holds in memory before they go to a file


def _age(c):
    return c[0] is not None, c[0], c[1]


def _plain(value):
    """A time of a zone as the state gives it back, without its zone."""
    return value.astimezone().replace(tzinfo=None) if getattr(value, "tzinfo", None) else value


def _distinct(tables):
    import pyarrow as pa
    rows = pa.concat_tables(tables)
    return rows.group_by(rows.column_names, use_threads=False).aggregate([])


def _packed(keys):
    """For mapInArrow: the keys, and all other columns of rows with the same keys as pieces."""
    def pieces(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, sort_keys=[(k, "ascending") for k in keys])).combine_chunks()
        salts = [table[k].to_numpy() for k in keys]
        first = np.flatnonzero(np.any([np.diff(s, prepend=-1) for s in salts], axis=0)).tolist()
        rows = table.drop_columns(keys)
        step = max(1, PIECE * rows.num_rows // max(1, rows.nbytes))
        starts, made = [], []
        for start, stop in zip(first, [*first[1:], table.num_rows]):
            for at in range(start, stop, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_table(rows.slice(at, min(step, stop - at)))
                starts.append(at)
                made.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([*[pa.array(s[starts]) for s in salts], pa.array(made, pa.binary())], [*keys, "piece"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED:
                yield pieces(held)
                held, n = [], 0
        if n:
            yield pieces(held)

    return run


class Held:
    """Tables in the order they came, beyond so many bytes in a file that goes with the object."""

    def __init__(self, most):
        self.most, self.tables, self.size, self.file, self.out = most, [], 0, None, None

    def add(self, table):
        self.tables.append(table)
        self.size += table.nbytes
        if self.size > self.most:
            self._write()

    def _write(self):
        import pyarrow as pa
        if not self.file:
            self.file = tempfile.TemporaryFile()
            self.out = pa.ipc.new_stream(self.file, self.tables[0].schema)
        for table in self.tables:
            self.out.write_table(table)
        self.tables, self.size = [], 0

    def parts(self, rows=PACKED):
        """All of it, about so many rows at a time."""
        import pyarrow as pa
        part, n = [], 0
        for table in self._all():
            part.append(table)
            n += table.num_rows
            if n >= rows:
                yield pa.concat_tables(part)
                part, n = [], 0
        if n:
            yield pa.concat_tables(part)

    def _all(self):
        import pyarrow as pa
        if self.file:
            self.out.close()
            self.file.seek(0)
            for batch in pa.ipc.open_stream(self.file):
                yield pa.Table.from_batches([batch])
            self.file.close()
        yield from self.tables


class NewestCommits(StatefulProcessor):
    """Handles rows ``(is_commit, piece)``: pieces of commits ``(repo, commit_id, ts)`` and of touches ``(commit_id, path)``. ``by_repo``: touches
    carry their repository."""

    def __init__(self, n, by_repo, kinds, held=HELD):
        self.n, self.by_repo, self.kinds, self.held = n, by_repo, kinds, held

    def init(self, handle):
        repo, commit, ts = self.kinds
        name = f"repo {repo}, commit_id {commit}" if self.by_repo else f"commit_id {commit}"
        self.newest = handle.getMapState("newest", f"repo {repo}", f"commits array<struct<ts:{ts},commit_id:{commit}>>")
        self.entries = handle.getMapState("entries", name, "refs int, n_chunks int")
        self.chunks = handle.getMapState("chunks", f"{name}, chunk int", "paths array<string>")

    def _name(self, repo, commit_id):
        return (repo, commit_id) if self.by_repo else (commit_id,)

    def handleInputRows(self, key, rows, timerValues):
        import pyarrow as pa
        names = ["repo", "commit_id"] if self.by_repo else ["commit_id"]
        commits, n_new, best, seen, waiting = [], 0, 0, [], Held(self.held)
        for batch in rows:
            for is_commit, piece in zip(batch["is_commit"], batch["piece"]):
                table = pa.ipc.open_stream(piece).read_all()
                if not is_commit:
                    waiting.add(table)
                    continue
                commits.append(table)
                seen.append(table.select(names))
                n_new += table.num_rows
                if n_new > max(MERGED, best):
                    commits, seen = [self._newest(commits)], [pa.concat_tables(seen).combine_chunks()]
                    n_new, best = 0, commits[0].num_rows
        change, fresh = {}, {}
        if seen:
            seen = pa.concat_tables(seen)
            for row in self._newest(commits).to_pylist():
                fresh.setdefault(row["repo"], set()).add((_plain(row["ts"]), row["commit_id"]))
        for repo, new in fresh.items():
            found = self.newest.getValue((repo,))
            old = {tuple(c) for c in found[0]} if found else set()
            best = sorted(old | new, key=_age)[-self.n:]
            for step, part in ((1, set(best) - old), (-1, old - set(best))):
                for _, commit_id in part:
                    name = self._name(repo, commit_id)
                    change[name] = change.get(name, 0) + step
            if set(best) != old:
                self.newest.updateValue((repo,), (best,))
        if not seen:
            for touches in waiting.parts():
                self._store(touches, names)
            return iter(())
        stored = self._table([tuple(name) for name in self.entries.keys()], seen.schema)
        for row in stored.join(seen, names, join_type="left semi", use_threads=False).to_pylist():
            change.setdefault(tuple(row[c] for c in names), 0)  # what this batch brought and pushed out again may have been waited for
        kept = [name for name, step in change.items() if self._settle(name, step)]
        gone = pa.concat_tables([seen, self._table(list(change), seen.schema)]).join(
            self._table(kept, seen.schema), names, join_type="left anti", use_threads=False)
        for touches in waiting.parts(max(PACKED, gone.num_rows)):
            self._store(touches.join(gone, names, join_type="left anti", use_threads=False), names)
        return iter(())

    @staticmethod
    def _table(found, schema):
        import pyarrow as pa
        columns = zip(*found) if found else [()] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def _newest(self, commits):
        """The newest n of each repository, each once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        rows = _distinct(commits)
        order = [("repo", "ascending"), ("ts", "ascending"), ("commit_id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start")).combine_chunks()
        repos = rows["repo"].combine_chunks().dictionary_encode().indices.to_numpy()
        last = np.append(np.flatnonzero(np.diff(repos)), len(repos) - 1)
        to_last = np.repeat(last, np.diff(last, prepend=-1)) - np.arange(len(repos))
        return rows.filter(pa.array(to_last < self.n))

    def _entry(self, name):
        found = self.entries.getValue(name)
        return tuple(found) if found else None

    def _store(self, touches, names):
        """Appends the paths of touches to the chunks of their commits."""
        rows = _distinct([touches]).sort_by([(c, "ascending") for c in (*names, "path")])
        found = {}
        for *name, path in zip(*[rows[c].to_pylist() for c in (*names, "path")]):
            found.setdefault(tuple(name), []).append(path)
        for name, new in found.items():
            refs, n = self._entry(name) or (0, 0)
            if n:
                last = self.chunks.getValue((*name, n - 1))[0]
                room = CHUNK - len(last)
                if room > 0:
                    self.chunks.updateValue((*name, n - 1), ([*last, *new[:room]],))
                    new = new[room:]
            for at in range(0, len(new), CHUNK):
                self.chunks.updateValue((*name, n), (new[at:at + CHUNK],))
                n += 1
            self.entries.updateValue(name, (refs, n))

    def _settle(self, name, step):
        """Books how many lists hold a commit; its chunks go with the last one. Is it held?"""
        found = self._entry(name)
        refs, n = found or (0, 0)
        refs += step
        if refs > 0:
            if step:
                self.entries.updateValue(name, (refs, n))
            return True
        for chunk in range(n):
            self.chunks.removeKey((*name, chunk))
        if found:
            self.entries.removeKey(name)
        return False


def follow(commits: DataFrame, touches: DataFrame, checkpoint: str, n=10, commit_salts=16, path_salts=2, held=HELD):
    """Runs the state over everything that is there and returns the query. Commits ``(repo, commit_id, ts)``, touches ``(commit_id, path)``, with
    or without repo, as the commits have it."""
    spark = commits.sparkSession
    kinds = dict(commits.dtypes)
    by_repo = "repo" in touches.columns
    spread = F.pmod(F.xxhash64("commit_id"), F.lit(commit_salts)).cast("int").alias("commit_salt")
    path_spread = F.pmod(F.xxhash64("path"), F.lit(path_salts)).cast("int").alias("path_salt")
    made = commits.filter("commit_id IS NOT NULL AND repo IS NOT NULL").select(spread, "repo", "commit_id", "ts").mapInArrow(
        _packed(["commit_salt"]), "commit_salt int, piece binary")
    names = ["repo", "commit_id"] if by_repo else ["commit_id"]
    named = touches.filter(" AND ".join(f"{c} IS NOT NULL" for c in (*names, "path"))).select(
        *[F.col(c).cast(kinds[c]).alias(c) for c in names], "path")
    moved = named.select(spread, path_spread, *names, "path").mapInArrow(
        _packed(["commit_salt", "path_salt"]), "commit_salt int, path_salt int, piece binary")
    both = made.select("commit_salt", F.explode(F.array(*map(F.lit, range(path_salts)))).alias("path_salt"), F.lit(True).alias("is_commit"), "piece").unionByName(
        moved.select("commit_salt", "path_salt", F.lit(False).alias("is_commit"), "piece"))
    state = both.groupBy("commit_salt", "path_salt").transformWithStateInPandas(
        NewestCommits(n, by_repo, (kinds["repo"], kinds["commit_id"], kinds["ts"]), held), "none int", "Append", "None")
    before = {key: spark.conf.get(key) for key in CONF}
    try:
        for key, value in CONF.items():
            spark.conf.set(key, value)
        query = state.writeStream.format("noop").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return query


def held_commits(spark, checkpoint: str) -> DataFrame:
    """``(repo, commit_id, ts)``: the newest n of each repository and salt."""
    rows = spark.read.format("statestore").option("stateVarName", "newest").load(checkpoint)
    return rows.select("user_map_key.repo", F.explode("user_map_value.commits").alias("c")).select("repo", "c.commit_id", "c.ts").distinct()


def held_touches(spark, checkpoint: str, names) -> DataFrame:
    """Paths of these commits, and of commits that have not come yet."""
    rows = spark.read.format("statestore").option("stateVarName", "chunks").load(checkpoint)
    return rows.select(*[f"user_map_key.{c}" for c in names], F.explode("user_map_value.paths").alias("path"))
