from datetime import datetime

import pytest
from conftest import tuples

from gitgauge.operators import cache, health
from gitgauge.sources.doc_store import DocStore

DOCS = "repo string, doc_type string, content string, commit_hash string, saved_at timestamp_ntz, token_count bigint"
HEADS = "repo string, head_hash string"


def doc(kind, commit, minute, repo="r", content=None):
    return (repo, kind, content or f"{kind}@{commit}", commit, datetime(2024, 1, 1, 0, minute), 10)


def after(frame, old, new):
    return tuples(cache.doc_store_upsert(frame(DOCS, *old), frame(DOCS, *new)), "doc_type", "content", "commit_hash")


def test_same_hash_merges_by_type(frame):
    got = after(frame, [doc("context", "h1", 1)], [doc("patterns", "h1", 2), doc("context", "h1", 3, content="newer")])
    assert got == [("context", "newer", "h1"), ("patterns", "patterns@h1", "h1")]


def test_new_hash_wipes_the_other_types(frame):
    got = after(frame, [doc("context", "h1", 1), doc("patterns", "h1", 1)], [doc("context", "h2", 2)])
    assert got == [("context", "context@h2", "h2")]


def test_going_back_to_a_hash_does_not_bring_back_what_was_wiped(frame):
    got = after(frame, [doc("patterns", "h1", 1), doc("context", "h2", 2)], [doc("context", "h1", 3)])
    assert got == [("context", "context@h1", "h1")]


def test_repositories_are_apart(frame):
    assert len(after(frame, [doc("context", "h1", 1, "a")], [doc("context", "h2", 2, "b")])) == 2


@pytest.mark.parametrize("seed", range(3))
def test_upsert_against_replayed_saves(frame, seed):
    import random

    rnd = random.Random(seed)
    saves = [doc(rnd.choice(cache.REQUIRED_DOCS), rnd.choice(["h1", "h2"]), minute, rnd.choice("ab"), f"v{minute}")
             for minute in range(30)]
    state = {}
    for repo, kind, content, commit, *_ in saves:
        if state.get(repo, (None,))[0] != commit:
            state[repo] = (commit, {})
        state[repo][1][kind] = content
    want = sorted((r, k, c, h) for r, (h, docs) in state.items() for k, c in docs.items())
    got = cache.doc_store_upsert(frame(DOCS, *saves[:15]), frame(DOCS, *saves[15:]))
    assert tuples(got, "repo", "doc_type", "content", "commit_hash") == want


def test_validity(frame):
    docs = frame(DOCS, doc("context", "h1", 1, "a"), doc("context", "old", 1, "b"))
    heads = frame(HEADS, ("a", "h1"), ("b", "h1"), ("c", "h1"))
    assert tuples(cache.cache_validity(heads, docs), "repo", "cached_hash", "valid") == [
        ("a", "h1", True), ("b", "old", False), ("c", None, False)]


def test_full_set_and_missing_types(frame):
    docs = frame(DOCS, *[doc(k, "h1", 1, "a") for k in cache.REQUIRED_DOCS], doc("handoff", "h1", 1, "b"),
                 doc("patterns", "h1", 1, "b"), *[doc(k, "old", 1, "c") for k in cache.REQUIRED_DOCS])
    sets = cache.complete_doc_set(frame(HEADS, ("a", "h1"), ("b", "h1"), ("c", "h1")), docs)
    assert tuples(sets, "repo", "complete", "missing") == [
        ("a", True, ""), ("b", False, "context,dependency-map"), ("c", False, "context,dependency-map,patterns")]
    selected = frame("repo string, path string", ("a", "x"), ("b", "y"))
    assert tuples(cache.repos_to_build(selected, sets)) == [("b", "y")]


def test_incremental_plan(frame):
    selected = frame("repo string, path string, rank bigint", *[("r", p, i) for i, p in enumerate("abcde")])
    stored = frame("repo string, path string, summary string", ("r", "a", "A"), ("r", "b", "B"), ("r", "d", None), ("r", "e", ""),
                   ("r", "gone", "G"))
    changed = frame("repo string, path string", ("r", "b"), ("r", "b"), ("r", "other"))
    plan = cache.incremental_plan(selected, stored, changed)
    assert tuples(plan, "path", "action", "summary") == [
        ("a", "reuse", "A"), ("b", "summarise", None), ("c", "summarise", None), ("d", "summarise", None),
        ("e", "summarise", None)]
    fresh = frame("repo string, path string, summary string", ("r", "b", "B2"))
    assert tuples(cache.merged_summaries(plan, fresh), "path", "summary") == [("a", "A"), ("b", "B2")]


def test_context_is_served_stale_or_not_at_all(frame):
    docs = frame(DOCS, *[doc(k, "h1", 1, r) for k in cache.REQUIRED_DOCS for r in "ab"], doc("context", "h1", 1, "c"))
    heads = frame(HEADS, ("a", "h1"), ("b", "h2"), ("c", "h1"))
    alerts = frame("repo string, commit_count bigint, path string, line string", ("a", 5, "x", "x"), ("a", 4, "y", "y"), ("b", 4, "y", "y"))
    got = {r.repo: r for r in cache.load_context(heads, docs, alerts).collect()}
    assert got["a"].content == (
        "# Repository Context\n\ncontext@h1\n\n---\n\n# Dependency Map\n\ndependency-map@h1\n\n---\n\n# Patterns\n\npatterns@h1")
    assert (got["a"].stale, got["a"].alert, got["a"].alert_files) == (False, "files changed again and again in recent commits: 2", 2)
    assert (got["b"].from_cache, got["b"].stale, got["b"].alert_files) == (True, True, 1)
    assert (got["c"].from_cache, got["c"].content, got["c"].alert, got["c"].alert_files) == (False, None, None, 0)
    forced = cache.load_context(heads, docs, alerts, force_refresh=True).collect()
    assert all(r.content is None and not r.from_cache for r in forced)


def checks(frame, docs=(), lines=(), files=0, agent=(), now="2024-01-02 00:00:00"):
    state = health.repo_state(
        frame(HEADS, ("r", "h1")), frame(DOCS, *docs), frame("repo string, seq bigint, line string", *lines),
        frame("repo string, path string", *[("r", f"f{i}") for i in range(files)]),
        frame("repo string, path string, content string", *agent), "MARK")
    df = health.health_checks(state, now)
    (score,) = health.health_score(df).collect()
    got = {r.name: (r.status, r.message) for r in df.collect()}
    assert score.total == len(got) and score.passed == sum(s == "pass" for s, _ in got.values())
    assert score.any_fail == any(s == "fail" for s, _ in got.values()) == bool(score.exit_code)
    return got


def test_health_of_an_empty_repository(frame):
    got = checks(frame)
    assert {k: s for k, (s, _) in got.items()} == {
        "context_files": "fail", "cache_valid": "fail", "hook_log": "warn", "agent_file_claude-code": "warn",
        "agent_file_cursor": "warn", "agent_file_windsurf": "warn", "context_freshness": "fail", "file_scan_sanity": "warn"}


def test_health_of_a_good_repository(frame):
    agent = [("r", p, "x MARK y") for p in ("CLAUDE.md", ".cursorrules", ".windsurfrules")]
    got = checks(frame, [doc(k, "h1", 1) for k in cache.REQUIRED_DOCS], [("r", 1, "t | Git: h | SUCCESS | 1s")], 10, agent)
    assert {s for s, _ in got.values()} == {"pass"}
    assert got["context_freshness"][1] == "23 h since the last build" and got["context_files"][1] == "3 files"


def test_health_in_between(frame):
    got = checks(frame, [doc("context", "old", 0)], [("r", 1, "FAILED")], 501, [("r", "CLAUDE.md", "no")])
    assert got["context_files"] == ("warn", "dependency-map, patterns missing")
    assert got["cache_valid"][0] == got["hook_log"][0] == got["agent_file_claude-code"][0] == "warn"
    assert got["context_freshness"] == ("warn", "1 d since the last build")
    assert got["file_scan_sanity"][0] == "warn"
    assert checks(frame, files=9)["file_scan_sanity"] == ("warn", "only 9 files read")
    late = checks(frame, [doc("context", "h1", 0)], now="2024-01-08 00:00:00")
    assert late["context_freshness"] == ("fail", "7 d since the last build, rebuild due")


def test_doc_store_on_disk(spark, frame, tmp_path):
    store = DocStore(spark, str(tmp_path / "docs"), buckets=4)
    assert store.load().count() == 0
    saves = [doc("context", "h1", 1), doc("patterns", "h1", 2), doc("context", "h2", 3, "q"), doc("context", "h2", 4), doc("patterns", "h1", 5)]
    for save, n in zip(saves, (1, 2, 3, 2, 2)):
        store.save(frame(DOCS, save))
        assert store.load().count() == n
    assert tuples(store.load(), "repo", "doc_type", "commit_hash") == [("q", "context", "h2"), ("r", "patterns", "h1")]
    store.invalidate(frame("repo string", ("r",)), datetime(2024, 1, 1, 0, 6))
    assert tuples(store.load(), "repo") == [("q",)]
    store.save(frame(DOCS, doc("context", "h9", 9)))
    want = [("q", "h2"), ("r", "h9")]
    assert tuples(store.load(), "repo", "commit_hash") == want
    assert tuples(store.load(frame("repo string", ("r",))), "repo", "commit_hash") == [("r", "h9")]
    small = DocStore(spark, str(tmp_path / "small"), buckets=4)
    small.save(store.load())
    assert small.rows().count() == 2 < store.rows().count() and tuples(small.load(), "repo", "commit_hash") == want


def test_two_savers_lose_nothing(spark, frame, tmp_path):
    """Saves that overlap in time: each only adds files."""
    import threading

    stores = [DocStore(spark, str(tmp_path / "docs"), buckets=2) for _ in range(4)]
    frames = [frame(DOCS, *[doc("context", "h", i, f"r{i}-{j}") for j in range(5)]) for i in range(4)]
    threads = [threading.Thread(target=s.save, args=(f,)) for s, f in zip(stores, frames)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert stores[0].load().count() == 20


def test_a_read_of_few_repositories_touches_their_buckets_only(spark, frame, tmp_path):
    store = DocStore(spark, str(tmp_path / "docs"), buckets=16)
    store.save(frame(DOCS, *[doc("context", "h", 1, f"r{i}") for i in range(40)]))
    one = store.rows(frame("repo string", ("r7",)))
    assert tuples(one, "repo") == [("r7",)]
    scan = [n for n in one._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in n and "PartitionFilters" in n]
    assert scan and all("PartitionFilters: [" in n and "bucket" in n.split("PartitionFilters: [")[1].split("]")[0] for n in scan)


def test_no_text_enters_an_aggregate_with_a_sort(frame):
    """Winners are found by time and digest; only they are looked at again."""
    rows = frame(DOCS, doc("context", "h", 1), doc("context", "h", 2, content="b"), doc("context", "h", 2, content="b"), (None, "context", "n", "h", None, 1))
    got = cache.newest_content(rows, ["repo", "doc_type"])
    assert tuples(got, "repo", "content") == [("r", "b"), (None, "n")] or tuples(got, "repo", "content") == [(None, "n"), ("r", "b")]


def test_summaries_of_a_scanned_repository_are_replaced(frame):
    schema = "repo string, path string, summary string"
    store = frame(schema, ("a", "x", "1"), ("a", "y", "1"), ("b", "x", "1"))
    got = cache.summary_store_upsert(store, frame(schema, ("a", "x", "2"), ("c", "z", "2")))
    assert tuples(got) == [("a", "x", "2"), ("b", "x", "1"), ("c", "z", "2")]
