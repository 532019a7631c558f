import random
from datetime import datetime, timedelta

import pytest
from conftest import tuples

from gitgauge.operators import history
from gitgauge.streaming import jobs, newest

EVENTS = "repo string, commit_id bigint, ts timestamp_ntz, path string"


def feed(spark, frame, folder, schema, batches):
    """Stream that hands out one batch of rows per micro-batch; later calls add files to the same folder."""
    for rows in batches:
        frame(schema, *rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def history_rows(seed, commits=60):
    rnd, rows = random.Random(seed), []
    for i in range(commits):
        repo = "hot" if rnd.random() < 0.6 else rnd.choice("abc")
        ts = datetime(2024, 1, 1) + timedelta(minutes=rnd.randrange(30))
        paths = [f"f{n}.ts" for n in range(4) if rnd.random() < 0.6] or [None]
        rows += [(repo, i, ts, p) for p in paths]
    return rows


COMMITS, TOUCHES = "repo string, commit_id bigint, ts timestamp_ntz", "repo string, commit_id bigint, path string"


def hot(spark, frame, folder, out, batches):
    """Touches and commits arrive as two streams; touches of a batch may come long before their commit."""
    touches = feed(spark, frame, f"{folder}/touches", TOUCHES, [[(r[0], r[1], r[3]) for r in b if r[3]] for b in batches])
    commits = feed(spark, frame, f"{folder}/commits", COMMITS, [[r[:3] for r in b] for b in reversed(batches)])
    return jobs.stream_hot_files(commits, touches, out)


@pytest.mark.parametrize("seed", range(2))
def test_hot_files_in_any_order_of_arrival(spark, frame, tmp_path, seed):
    rows = history_rows(seed)
    all_rows = frame(EVENTS, *rows)
    commits = all_rows.select("repo", "commit_id", "ts").distinct()
    want = tuples(history.hot_files(commits, all_rows.filter("path is not null").select("repo", "commit_id", "path")))
    random.Random(seed).shuffle(rows)  # commits arrive late, and in pieces
    batches = [rows[i::5] + rows[:3] for i in range(5)]
    got = hot(spark, frame, str(tmp_path / "in"), str(tmp_path / "out"), batches)
    assert tuples(got) == want and want


def test_hot_files_go_on_after_a_stop(spark, frame, tmp_path):
    rows = history_rows(7)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hot(spark, frame, source, out, [rows[:40], rows[40:80]])
    got = hot(spark, frame, source, out, [rows[80:]])
    fresh = hot(spark, frame, str(tmp_path / "in2"), str(tmp_path / "out2"), [rows])
    assert tuples(got) == tuples(fresh) and tuples(got)


def test_hot_state_holds_the_newest_commits_and_reads_new_files_only(spark, frame, tmp_path):
    """Commits come newest first, then late ones; what is pushed out leaves the state with its paths, whatever came first."""
    n, t0 = 3, datetime(2024, 1, 1)
    rows = [("r" if i % 3 else "q", i, t0 + timedelta(minutes=i), f"f{i % 5}.ts") for i in range(120)]
    commits, touches, state = (str(tmp_path / x) for x in ("commits", "touches", "state"))
    seen = []
    for part in (rows[60:], rows[:60]):
        c = feed(spark, frame, commits, COMMITS, [[r[:3] for r in part]])
        t = feed(spark, frame, touches, TOUCHES, [[(r[0], r[1], r[3]) for r in part]])
        query = newest.follow(c, t, state, n, commit_salts=4, path_salts=2)
        seen.append(sum(p["numInputRows"] for p in query.recentProgress))
    assert seen == [120, 120]  # commits and touches of the part, not of the one before
    held = newest.held_commits(spark, state)
    assert held.count() <= 2 * n * 4
    best = sorted([(r[0], r[1]) for r in rows if r[0] == "r"])[-n:] + sorted(
        [(r[0], r[1]) for r in rows if r[0] == "q"])[-n:]
    assert set(best) <= set(tuples(held, "repo", "commit_id"))
    kept = tuples(newest.held_touches(spark, state, ["repo", "commit_id"]), "repo", "commit_id")
    assert set(best) <= set(kept) <= set(tuples(held, "repo", "commit_id"))


def test_hot_state_without_repo_nulls_and_pieces(spark, frame, tmp_path):
    """Touches without repo; a commit of more paths than one value of the state holds; rows without a name."""
    t0 = datetime(2024, 1, 1)
    many = [(1, f"p{i}.ts") for i in range(2 * newest.CHUNK + 7)]
    commits = feed(spark, frame, str(tmp_path / "c"), COMMITS, [[("r", 1, t0), ("r", 1, t0), (None, 2, t0), ("r", None, t0), ("r", 3, None)]])
    touches = feed(spark, frame, str(tmp_path / "t"), "commit_id bigint, path string", [many, many[:5] + [(1, None), (None, "x"), (3, "y")], [(9, "waits")]])
    newest.follow(commits, touches, str(tmp_path / "state"), 2)
    assert tuples(newest.held_commits(spark, str(tmp_path / "state")), "repo", "commit_id") == [("r", 1), ("r", 3)]
    held = newest.held_touches(spark, str(tmp_path / "state"), ["commit_id"])
    assert tuples(held.distinct()) == sorted([*many, (3, "y"), (9, "waits")], key=repr)


@pytest.mark.parametrize("by_repo", [False, True])
def test_hot_files_of_numbered_repositories_and_times(spark, frame, tmp_path, by_repo):
    """Numbers that a float cannot hold, next to rows that have none: touches without repo, commits without time."""
    far = (1 << 60) + 1
    made = [(far + i % 2, far + i, None if i < 4 else far + i // 4) for i in range(60)]
    touched = [(repo, commit, f"f{commit % 3}.ts") for repo, commit, _ in made] + [(None, far, "lost.ts")]
    schema, columns = "repo bigint, commit_id bigint, path string", ["repo", "commit_id", "path"] if by_repo else ["commit_id", "path"]
    rows = frame(schema, *touched[:None if by_repo else -1]).select(*columns)
    want = tuples(history.hot_files(frame("repo bigint, commit_id bigint, ts bigint", *made), rows, threshold=3))
    rows.coalesce(1).write.parquet(str(tmp_path / "t"))
    touches = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "t"))
    commits = feed(spark, frame, str(tmp_path / "c"), "repo bigint, commit_id bigint, ts bigint", [made])
    got = jobs.stream_hot_files(commits, touches, str(tmp_path / "out"), threshold=3)
    assert tuples(got) == want and {r[0] for r in want} == {far, far + 1}


class Kept(dict):
    """A map of the state that counts what is asked of it."""

    calls = 0

    def getValue(self, key):
        Kept.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        Kept.calls += 1
        self[key] = value

    def removeKey(self, key):
        Kept.calls += 1
        self.pop(key, None)


class Handle:
    def getMapState(self, *named):
        return Kept()


def pieces(is_commit, salts, table):
    import pandas as pd
    rows = table.select(table.column_names)
    for i, salt in enumerate(salts):
        rows = rows.add_column(i, salt, [[0] * table.num_rows])
    made = [p for b in newest._packed(salts)(iter(rows.to_batches(max_chunksize=1_000))) for p in b.column("piece").to_pylist()]
    return pd.DataFrame({"is_commit": is_commit, "piece": made})


@pytest.mark.parametrize("held", [1_000, newest.HELD])
def test_touches_of_commits_that_are_pushed_out_cost_no_state_calls(held):
    """All touches come before their commits in the micro-batch, more than a group holds in memory; a second one pushes out what the first left."""
    import pyarrow as pa
    n, many, processor = 3, 60_000, newest.NewestCommits(3, False, ("int", "bigint", "bigint"), held)
    processor.init(Handle())
    Kept.calls = 0
    for first in (0, many):
        ids = list(range(first, first + many))
        commits = pa.table({"repo": pa.array([i % 2 for i in ids], pa.int32()), "commit_id": ids, "ts": [None if i < 9 else i for i in ids]})
        touches = pa.table({"commit_id": [*ids, *ids, many * 9 + first], "path": [f"{i % 5}.ts" for i in ids] * 2 + ["waits"]})
        list(processor.handleInputRows((0, 0), iter([pieces(False, ["commit_salt", "path_salt"], touches), pieces(True, ["commit_salt"], commits)]), None))
        best = ids[-2 * n:]
        waits = {many * 9 + f: "waits" for f in (0, many) if f <= first}
        assert {c: set(paths) for (c, _), (paths,) in processor.chunks.items()} == {c: {f"{c % 5}.ts"} for c in best} | {c: {p} for c, p in waits.items()}
        assert processor.entries.keys() == {(c,) for c in [*best, *waits]}
        assert {c for (found,) in processor.newest.values() for _, c in found} == set(best)
    assert Kept.calls < 200


def test_hot_state_of_repeated_commits_with_zoned_times(spark, frame, tmp_path):
    """Commits that come again, in one micro-batch and in the next one, take one place each; what a group holds goes through a file."""
    t0, schema = datetime(2024, 1, 1), "repo string, commit_id string, ts timestamp"
    made = [("r", f"c{i:03}", t0 + timedelta(hours=i // 2) if i else None) for i in range(40)]
    touched = [("r", c, f"f{i % 3}.ts") for i, (_, c, _) in enumerate(made)]
    for part in ((20, 40), (0, 40)):
        commits = feed(spark, frame, str(tmp_path / "c"), schema, [[r for r in made[slice(*part)] for _ in range(4)]])
        touches = feed(spark, frame, str(tmp_path / "t"), "repo string, commit_id string, path string", [touched[slice(*part)]])
        newest.follow(commits, touches, str(tmp_path / "state"), 6, commit_salts=2, path_salts=1, held=10)
        held = tuples(newest.held_commits(spark, str(tmp_path / "state")))
        assert set(made[-6:]) <= set(held) and len(held) <= 12
        kept = newest.held_touches(spark, str(tmp_path / "state"), ["repo", "commit_id"]).distinct()
        assert tuples(kept) == sorted((r for r in touched if r[1] in {c for _, c, _ in held}), key=repr)


class Client:
    def generate(self, prompt, tier, max_tokens, temperature):
        if "broken" in prompt:
            raise ValueError("no")
        return "summary of " + prompt.split("File: ")[1].split("\n")[0], 5


def test_refresh(spark, frame, tmp_path):
    t = datetime(2024, 1, 1)
    schema = "repo string, commit_id bigint, ts timestamp_ntz"
    commits = [[("r", 1, t), ("r", 2, t + timedelta(hours=2))], [("r", 3, t + timedelta(hours=1)), ("r", 4, t), ("q", 5, t)]]
    contents = frame("commit_id bigint, path string, language string, content string",
                     (1, "a.ts", "TypeScript", "export 1"), (1, "b.md", "Markdown", "b one"), (2, "a.ts", "TypeScript", "export 2"),
                     (3, "a.ts", "TypeScript", "export 3"), (4, "docs.md", "Markdown", "only docs"),
                     (5, "bad.ts", "TypeScript", "broken"))
    stream = feed(spark, frame, str(tmp_path / "in"), schema, commits)
    summaries, log = jobs.stream_refresh(stream, contents, str(tmp_path / "out"))
    assert tuples(summaries, "repo", "path", "commit_id", "summary") == [
        ("q", "bad.ts", 5, "broken"), ("r", "a.ts", 2, "export 2"), ("r", "b.md", 1, "b one")]
    assert tuples(log, "commit_id", "status") == [(c, s) for c in (1, 2, 3, 5) for s in ("STARTED", "SUCCESS")]
    stream = feed(spark, frame, str(tmp_path / "in"), schema, [])
    summaries, log = jobs.stream_refresh(stream, contents, str(tmp_path / "out2"), Client)
    assert tuples(summaries, "path", "summary", "tokens", "error") == [
        ("a.ts", "summary of a.ts", 5, None), ("b.md", "summary of b.md", 5, None), ("bad.ts", None, 0, "ValueError: no")]
    assert ("q", "FAILED") in tuples(log, "repo", "status")


def test_alerts_once_ever(spark, frame, tmp_path):
    schema, doom, told = "repo string, seq bigint, line string", "t | Git: {} | DOOM | detected", "DOOM_SHOWN | Git: {}"
    batches = [[("r", i, doom.format("a")) for i in range(3)] + [("r", 3, told.format("z"))],
               [("r", 4, doom.format("a")), ("r", 5, doom.format("b")), ("r", 6, doom.format("z"))],
               [("q", 7, doom.format("a")), ("r", 8, told.format("b"))]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    got = jobs.stream_alert_once(feed(spark, frame, source, schema, batches), out)
    assert tuples(got) == [("q", "a"), ("r", "a"), ("r", "b")]  # z was shown before it was raised
    got = jobs.stream_alert_once(feed(spark, frame, source, schema, [[("r", 9, doom.format("a"))]]), out)
    assert tuples(got) == [("q", "a"), ("r", "a"), ("r", "b")]


def test_run_lifecycle(spark, frame, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda h: t0 + timedelta(hours=h)
    line = lambda h, commit, what: ("r", int(h * 10), at(h), f"{at(h):%Y-%m-%d %H:%M:%S} | Git: {commit} | {what}")
    batches = [
        [line(0, "a", "STARTED"), line(0.5, "b", "STARTED"), line(0.2, "a", "SUCCESS | 720s")],
        [line(1, "c", "STARTED"), line(2, "c", "FAILED | 3600s"), line(5, "d", "SUCCESS | 1s")],
        [line(40, "e", "STARTED")],
    ]
    stream = feed(spark, frame, str(tmp_path / "in"), "repo string, seq bigint, ts timestamp_ntz, line string", batches)
    got = jobs.stream_run_lifecycle(stream, spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert tuples(got, "commit_hash", "status", "seconds") == [
        ("a", "SUCCESS", 720), ("b", "TIMED_OUT", None), ("c", "FAILED", 3600), ("e", "OPEN", None)]
