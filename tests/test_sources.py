import pytest
from conftest import tuples

from gitgauge.operators import scan
from gitgauge.plans import disk
from gitgauge.sources import ignore_rules, inventory, settings, specs


@pytest.fixture
def tree(tmp_path):
    for path, body in {
        "one/src/a.ts": "export a\n", "one/README.md": "# one", "one/.git/HEAD": "ref", "one/with space+plus.py": "x = 1",
        "one/src/__tests__/_x.ts": "t", "two/b.go": "package b", "two/deep/er/__init__.py": "c",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    (tmp_path / "two/bad.go").write_bytes(b"a\xffb")
    return str(tmp_path)


def test_listing(spark, tree):
    assert tuples(inventory.list_files(spark, tree), "repo", "path", "size") == [
        ("one", "README.md", 5), ("one", "src/__tests__/_x.ts", 1), ("one", "src/a.ts", 9), ("one", "with space+plus.py", 5),
        ("two", "b.go", 9), ("two", "bad.go", 3), ("two", "deep/er/__init__.py", 1)]
    assert ("one", ".git/HEAD") in tuples(inventory.list_files(spark, tree, include_hidden=True), "repo", "path")
    assert tuples(inventory.list_files(spark, tree + "/two", repo="x"), "repo", "path") == [
        ("x", "b.go"), ("x", "bad.go"), ("x", "deep/er/__init__.py")]


@pytest.mark.parametrize("levels", [0, 2, 5])
def test_listing_does_not_depend_on_how_it_is_cut(spark, tree, levels):
    assert tuples(inventory.list_files(spark, tree, levels=levels), "repo", "path") == tuples(
        inventory.list_files(spark, tree), "repo", "path")


def test_missing_and_empty_roots(spark, tmp_path):
    for read in (lambda r: inventory.list_files(spark, r).collect(), lambda r: inventory.walk(spark, r).collect()):
        with pytest.raises(Exception, match="no folder of repositories at"):
            read(str(tmp_path / "nowhere"))
        (tmp_path / "empty").mkdir(exist_ok=True)
        assert read(str(tmp_path / "empty")) == []


def test_hidden_folders_are_not_entered(spark, tree, tmp_path):
    """A folder that cannot be listed would be an error, so it is not even looked into."""
    entered = []
    real = inventory._children
    reader = inventory.RepoFilesReader({"path": tree, "levels": "0"})
    inventory._children = lambda system, folder: entered.append(folder) or real(system, folder)
    try:
        [list(reader.read(p)) for p in reader.partitions()]
    finally:
        inventory._children = real
    assert not [f for f in entered if ".git" in f] and any(f.endswith("__tests__") for f in entered)


def test_walk_prunes_and_agrees_with_the_rules(spark, tree, tmp_path):
    """Ignored and hidden folders are no part of any frontier; the result is that of the rules over a full listing."""
    for path, body in {"one/.gitignore": "node_modules/\n*.log\n!keep.log\n", "one/src/.gitignore": "gen\n!gen/x\n", "one/node_modules/deep/er/i.ts": "",
                       "one/src/gen/x": "", "one/a.log": "", "one/src/keep.log": "", "two/deep/.gitignore": "/er/*.py\n", "two/.x/y": ""}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(body)
    listed, real = [], inventory._listing
    inventory._listing = lambda folders, root, single_repo=False: listed.append(tuples(folders, "repo", "path")) or real(folders, root, single_repo)
    try:
        got = tuples(inventory.walk(spark, tree), "repo", "path")
    finally:
        inventory._listing = real
    assert got == [("one", "README.md"), ("one", "src/__tests__/_x.ts"), ("one", "src/a.ts"), ("one", "src/keep.log"), ("one", "with space+plus.py"),
                   ("two", "b.go"), ("two", "bad.go")]
    assert sorted(p for level in listed for _, p in level if p) == ["deep", "deep/er", "src", "src/__tests__"]
    every = inventory.list_files(spark, tree, include_hidden=True)
    rules = ignore_rules.ignore_files_of(inventory.read_content(every.filter("path like '%.gitignore'"), tree))
    assert got == tuples(ignore_rules.apply_ignore_files(inventory.list_files(spark, tree), rules), "repo", "path")
    assert tuples(inventory.walk(spark, tree + "/two", repo="x"), "repo", "path") == [("x", "b.go"), ("x", "bad.go")]


def test_ignore_files_from_disk(spark, tree, tmp_path):
    (tmp_path / "one/.gitignore").write_text("*.md\n")
    (tmp_path / "one/src/.gitignore").write_text("__tests__/\n")
    every = inventory.list_files(spark, tree, include_hidden=True)
    rules = ignore_rules.ignore_files_of(inventory.read_content(every.filter("path like '%.gitignore'"), tree))
    kept = ignore_rules.apply_ignore_files(inventory.list_files(spark, tree, repo=None), rules)
    assert [p for r, p in tuples(kept, "repo", "path") if r == "one"] == ["src/a.ts", "with space+plus.py"]


def test_scan_from_disk(spark, tree, tmp_path):
    (tmp_path / "one/.gitignore").write_text("*.md\nfoo[\nnode_modules/\n")
    (tmp_path / "one/src/.gitignore").write_text("gen/\n")
    for path in ("one/node_modules/k/i.ts", "one/src/gen/g.ts", "one/.cursorrules.md", "two/.hidden.go"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("hidden")
    got = tuples(disk.scan_disk(spark, tree), "repo", "path", "content")
    assert ("one", "src/a.ts") in tuples(disk.listed_files(spark, tree), "repo", "path") and ("two", "b.go", "package b") in got
    assert not [p for _, p, _ in got if "gen/" in p or "node_modules" in p or p.endswith(".md") or p.startswith(".")]
    more = tuples(disk.scan_disk(spark, tree, include_hidden=True), "repo", "path", "content")
    assert set(more) - set(got) == {("two", ".hidden.go", "hidden")}


def test_content_of_hidden_files_that_were_selected(frame):
    files = frame("repo string, path string, size bigint, content string", ("r", ".x.ts", 1, "x"), ("r", "a.ts", 1, "a"))
    assert tuples(scan.with_content(scan.adaptive_top_n(files), files), "path", "content") == [(".x.ts", "x"), ("a.ts", "a")]


def test_content_of_chosen_files(spark, frame, tree):
    chosen = frame("repo string, path string", ("one", "src/a.ts"), ("one", "with space+plus.py"), ("two", "bad.go"), ("two", "gone"))
    assert tuples(inventory.read_content(chosen, tree, partitions=2)) == [
        ("one", "src/a.ts", "export a\n"), ("one", "with space+plus.py", "x = 1"), ("two", "bad.go", "a\ufffdb"),
        ("two", "gone", None)]
    single = frame("repo string, path string", ("x", "b.go"))
    assert tuples(inventory.read_content(single, tree + "/two", single_repo=True), "content") == [("package b",)]


def test_batches_of_content_are_limited(frame, tree, monkeypatch):
    monkeypatch.setattr(inventory, "BATCH_BYTES", 1)
    chosen = frame("repo string, path string", ("one", "src/a.ts"), ("two", "b.go"), ("two", "gone"))
    assert len(tuples(inventory.read_content(chosen, tree, partitions=1))) == 3


def kept(frame, paths, **ignore):
    files = frame("repo string, path string", *[("r", p) for p in paths])
    rules = frame("repo string, folder string, content string", *[("r", k.replace("root", "").replace("__", "/"), v) for k, v in ignore.items()])
    return [p for _, p in tuples(ignore_rules.apply_ignore_files(files, rules))]


@pytest.mark.parametrize("rules,hidden", [
    ("node_modules/", ["node_modules/a.js", "web/node_modules/b.js"]),
    ("/dist", ["dist/x.js"]),
    ("*.log", ["a.log", "web/b.log"]),
    ("*.log\n!web/b.log", ["a.log"]),
    ("web/\n!web/b.log", ["web/b.log", "web/dist/y.js", "web/node_modules/b.js", "web/q.c"]),
    ("**/dist", ["dist/x.js", "web/dist/y.js"]),
    ("web/**/y.js", ["web/dist/y.js"]),
    ("web/*", ["web/b.log", "web/dist/y.js", "web/node_modules/b.js", "web/q.c"]),
    ("web/*.js", []),
    ("[ab].log", ["a.log", "web/b.log"]),
    ("?.c", ["web/q.c"]),
    ("# *.log\n\n   \n", []),
    ("a.log/", []),
    ("(a).log", []),
])
def test_ignore_rules(frame, rules, hidden):
    every = ["a.log", "dist/x.js", "main.c2", "node_modules/a.js", "web/b.log", "web/dist/y.js", "web/node_modules/b.js", "web/q.c"]
    assert kept(frame, every, root=rules) == [p for p in every if p not in hidden]


@pytest.mark.parametrize("rule,hidden", [
    ("foo[", []), ("[z-a]*.ts", []), ("[!]x", []), ("a\\", []), ("[]", []), ("[[a]x.ts", []), ("[?-a]", []), ("[a&&b]x.ts", []),
    ("\\q.c", ["q.c"]), ("\\*.md", ["*.md"]), ("[a-c]x.ts", ["ax.ts"]), ("[!a-c]x.ts", ["zx.ts"]), ("\\#a", ["#a"]), ("\\!a", ["!a"]), ("(a|b)+.js", ["(a|b)+.js"]),
])
def test_odd_rules_match_as_written_or_nothing(frame, rule, hidden):
    names = ["q.c", "*.md", "b.md", "ax.ts", "zx.ts", "#a", "!a", "foo[", "(a|b)+.js", "keep.log"]
    assert sorted(set(names) - set(kept(frame, names, root=rule))) == sorted(hidden)
    assert "keep.log" not in kept(frame, names, root=rule + "\n*.log")  # a bad rule leaves the others in force


@pytest.mark.parametrize("rule,paths,hidden", [
    ("name", ["name", "a/name", "a/name/x", "names", "xname"], ["name", "a/name", "a/name/x"]),
    ("**/name", ["name", "a/name", "a/b/name/x", "a/names"], ["name", "a/name", "a/b/name/x"]),
    ("/**/name", ["name", "a/name"], ["name", "a/name"]),
    ("*.test.ts", ["a.test.ts", "x/b.test.ts", "test.ts", ".test.ts", "a.ts"], ["a.test.ts", "x/b.test.ts", ".test.ts"]),
    ("*.", ["a.", "a.b"], ["a."]),
    ("a\\*b", ["a*b", "axb", "d/a*b"], ["a*b", "d/a*b"]),
    ("*.\\*", ["x.*", "x.y"], ["x.*"]),
    ("src/a.ts", ["src/a.ts", "x/src/a.ts", "src/a.ts/b"], ["src/a.ts", "src/a.ts/b"]),
    ("/a b", ["a b", "c/a b"], ["a b"]),
    ("n:x", ["n:x", "x"], ["n:x"]),
])
def test_rules_by_kind_hide_what_patterns_hide(frame, rule, paths, hidden):
    """Literal names, endings and whole paths are met by key, and give what the pattern of the rule gives."""
    left = kept(frame, paths, root=rule + "\n")
    assert sorted(set(paths) - set(left)) == sorted(hidden)


def test_deeper_ignore_files_win(frame):
    every = ["a.log", "web/a.log", "web/in/a.log", "web/in/b.log"]
    assert kept(frame, every, root="*.log", web="!a.log", web__in="a.log") == ["web/a.log"]


def test_settings_lines_and_quotes(frame):
    body = '# note\n\n A=1 \nB="two words"\nC=\'x\'\nbad line\n1D=no\nE="half\nF=\nA=2\nG="'
    files = frame("repo string, priority int, content string", ("r", 0, body))
    got = {k: v for _, k, v, _ in tuples(settings.settings_resolve(settings.settings_lines(files)))}
    assert got == {"A": "2", "B": "two words", "C": "x", "E": '"half'}


def test_settings_precedence_and_empty_values(frame):
    files = frame("repo string, priority int, content string", ("r", 2, "A=low\nB=low"), ("r", 0, "A=\nC=top"), ("r", 1, "A=mid"))
    assert tuples(settings.settings_resolve(settings.settings_lines(files))) == [
        ("r", "A", "mid", 1), ("r", "B", "low", 2), ("r", "C", "top", 0)]


def test_specs(frame):
    saved = frame("repo string, task string, content string, saved_at bigint", ("r", "Add X!", "old", 1), ("r", "add x", "new", 2),
                  ("q", "add x", "other", 1))
    registry = specs.spec_registry(saved)
    assert tuples(registry, "repo", "slug", "content", "saves") == [("q", "add-x", "other", 1), ("r", "add-x", "new", 2)]
    wanted = frame("repo string, task string", ("r", "ADD x?"), ("r", "add-x"), ("r", "nothing"))
    assert tuples(specs.spec_load(registry, wanted), "task", "content") == [("ADD x?", "new"), ("add-x", "new"), ("nothing", None)]
    files = frame("repo string, path string", ("r", "specs/a.md"), ("r", "specs/readme.txt"), ("r", "specs/b.md.json"), ("r", "x.md.md"))
    assert tuples(specs.spec_list(files), "slug") == [("a",), ("x.md",)]
