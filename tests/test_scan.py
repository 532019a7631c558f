from conftest import tuples
from pyspark.sql import functions as F

from gitgauge.functions import paths
from gitgauge.operators import scan


def scores(frame, *names):
    df = frame("path string", *[(n,) for n in names])
    df = df.withColumn("base", paths.basename()).withColumn("folder", paths.dirname())
    return {r.path: r.s for r in df.select("path", paths.relevance().alias("s")).collect()}


def test_path_parts(frame):
    df = frame("path string", ("a/b/c.test.ts",), (".bashrc",), ("Makefile",), ("x/.env.local",), ("a.",))
    got = {r.path: (r.b, r.d, r.e) for r in df.select(
        "path", paths.basename().alias("b"), paths.dirname().alias("d"), paths.extension().alias("e")).collect()}
    assert got == {
        "a/b/c.test.ts": ("c.test.ts", "a/b", ".ts"), ".bashrc": (".bashrc", ".", ""), "Makefile": ("Makefile", ".", ""),
        "x/.env.local": (".env.local", "x", ".local"), "a.": ("a.", ".", "."),
    }


def test_always_included_names(frame):
    s = scores(frame, "README.md", "README.mdx", "package.json", "docs/README.md", "sub/package.json", "Cargo.toml")
    assert s["README.md"] == s["README.mdx"] == s["package.json"] == s["Cargo.toml"] == 100
    assert s["docs/README.md"] == -1.5
    assert s["sub/package.json"] == 98.5


def test_business_words_count_once_and_ignore_case(frame):
    s = scores(frame, "x/AuthPayment.ts", "x/alphabet.ts", "x/plain.ts")
    assert s["x/AuthPayment.ts"] == s["x/alphabet.ts"] == 58.5
    assert s["x/plain.ts"] == -1.5


def test_valued_folders_need_a_parent(frame):
    s = scores(frame, "src/lib/x.ts", "lib/x.ts", "src/lib/components/x.ts")
    assert s["src/lib/x.ts"] == 37
    assert s["lib/x.ts"] == -1.5
    assert s["src/lib/components/x.ts"] == 40 - 4.5


def test_entry_points_config_and_tests(frame):
    s = scores(frame, "index.ts", "main.py", "server", "jest.config.js", "vite.setup.ts", "a.test.ts", "latest/a.ts",
               "__tests__/a.ts", "a/x.spec.ts")
    assert s["index.ts"] == s["main.py"] == s["server"] == 50
    assert s["jest.config.js"] == s["vite.setup.ts"] == 30
    assert s["a.test.ts"] == -10
    assert s["latest/a.ts"] == s["__tests__/a.ts"] == s["a/x.spec.ts"] == -11.5


def test_depth_costs_one_and_a_half_per_folder(frame):
    s = scores(frame, "index.ts", "a/index.ts", "a/b/c/index.ts")
    assert s["index.ts"] - s["a/index.ts"] == 1.5
    assert s["a/index.ts"] - s["a/b/c/index.ts"] == 3


def test_terms_add_up(frame):
    s = scores(frame, "src/services/index.test.ts")
    assert s["src/services/index.test.ts"] == 60 + 40 - 3 - 10


def test_filters(frame):
    df = frame("repo string, path string, size bigint", *[("r", p, 1) for p in (
        "a.ts", "a.TS", "go.mod", ".hidden/a.ts", "x/.env", "x/gitgauge/a.ts", "x/notgitgauge/a.ts", "LICENSE", "a.mjs")])
    kept = [p for (p,) in tuples(scan.file_inventory(df), "path")]
    assert kept == ["LICENSE", "a.TS", "a.mjs", "a.ts", "go.mod", "x/gitgauge/a.ts", "x/notgitgauge/a.ts"]
    assert len(tuples(scan.file_inventory(df, include_hidden=True))) == 9
    assert ("x/gitgauge/a.ts",) not in tuples(scan.ignore_filter(df), "path")
    assert ("x/notgitgauge/a.ts",) in tuples(scan.ignore_filter(df), "path")
    assert tuples(scan.supported_filter(scan.file_inventory(df)), "path") == [
        ("a.mjs",), ("a.ts",), ("go.mod",), ("x/gitgauge/a.ts",), ("x/notgitgauge/a.ts",)]


def test_supported_is_the_same_as_known_extension(frame):
    names = ["md", ".md", "a.md", "x/.md", "x/md", "a.b.ts", "a.", "a.TS", "ts.x", "x.md/y", "x.md/y.c", "..ts", "a/..ts"]
    df = frame("path string", *[(n,) for n in names])
    by_extension = paths.extension().isin(paths.SUPPORTED_EXTENSIONS) | paths.basename().isin(paths.ALWAYS_INCLUDE)
    assert tuples(df.filter(paths.is_supported())) == tuples(df.filter(by_extension))


def test_language_ignores_case(frame):
    df = frame("repo string, path string, size bigint", ("r", "a.TS", 3), ("r", "b.ts", 4), ("r", "c.zig", 5))
    assert tuples(scan.language_profile(df)) == [("r", "TypeScript", 2, 7), ("r", "Unknown", 1, 5)]


def cap_of(spark, n, max_files=100):
    files = spark.range(n).select(
        F.lit("r").alias("repo"), F.concat(F.lit("src/api/f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"),
        F.lit(1).cast("bigint").alias("size"))
    return scan.adaptive_top_n(files, max_files).count()


def test_caps_follow_the_listed_count(spark):
    expected = {80: 80, 500: 100, 501: 75, 1223: 183, 2000: 300, 2001: 120, 10_000: 120, 10_001: 150, 12_000: 150}
    assert {n: cap_of(spark, n) for n in expected} == expected
    assert cap_of(spark, 90, max_files=0) == 80
    assert cap_of(spark, 450, max_files=400) == 400


def test_cap_counts_unsupported_files_too(spark):
    files = spark.range(600).select(
        F.lit("r").alias("repo"), F.lit(1).cast("bigint").alias("size"),
        F.concat(F.lit("src/api/f"), "id", F.when(F.col("id") < 200, ".ts").otherwise(".bin")).alias("path"))
    assert scan.adaptive_top_n(files).count() == 90


def test_hot_repository_matches_brute_force(spark):
    """One repository holds most rows, many of equal score."""
    files = spark.range(30_000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 500).cast("string"))).alias("repo"),
        F.concat(F.element_at(F.array(F.lit("src/api/"), F.lit("x/"), F.lit("src/lib/")), (F.col("id") % 3 + 1).cast("int")),
                 F.lit("f"), F.col("id").cast("string"), F.lit(".ts")).alias("path"),
        F.lit(1).cast("bigint").alias("size"))
    got = {}
    for r in scan.adaptive_top_n(files).collect():
        got.setdefault(r.repo, []).append((r["rank"], r.path))
    plain, listed = {}, {}
    for r in files.collect():
        listed[r.repo] = listed.get(r.repo, 0) + 1
        score = 100 - 3 if "/api" in r.path else 40 - 3 if "/lib" in r.path else -1.5
        if score >= 0:
            plain.setdefault(r.repo, []).append((-score, r.path))
    for repo, rows in plain.items():
        n = listed[repo]
        cap = 150 if n > 10_000 else 120 if n > 2000 else int(n * 0.15) if n > 500 else 100
        assert sorted(got[repo]) == [(i + 1, p) for i, (_, p) in enumerate(sorted(rows)[:cap])]
    assert set(got) == set(plain)


def test_implementation_files(frame):
    rows = [("r", p, 1, "TypeScript", s, i) for i, (p, s) in enumerate([
        ("src/index.ts", 90.0), ("src/a.service.ts", 10.0), ("src/b.ts", 51.0), ("src/c.ts", 50.0), ("Package.json", 99.0)])]
    df = frame("repo string, path string, size bigint, language string, score double, rank bigint", *rows)
    assert tuples(scan.implementation_files(df), "path", "rank") == [("src/a.service.ts", 2), ("src/b.ts", 1)]
    assert tuples(scan.implementation_files(df, 1), "path") == [("src/b.ts",)]


def test_preview(frame):
    long = "a/" * 30 + "x.ts"
    rows = [("r", long if i == 1 else f"f{i}.ts", 256 * i, "TypeScript", float(-i), i) for i in range(1, 12)]
    df = frame("repo string, path string, size bigint, language string, score double, rank bigint", *rows)
    got = {r.row_no: (r.file, r.size_kb) for r in scan.preview_with_rest(df).collect()}
    assert got[1] == ("..." + long[-44:], "0.3") and got[2] == ("f2.ts", "0.5") and got[9] == ("... and 3 more files", "")
    assert len(scan.preview_with_rest(df.filter("rank <= 8")).collect()) == 8


def test_batches(frame):
    df = frame("repo string, path string, rank bigint", *[("r", f"f{i}", i) for i in range(1, 22)])
    assert [b for *_, b in sorted(tuples(scan.work_batches(df)), key=lambda r: r[2])] == [0] * 10 + [1] * 10 + [2]


def test_summary_without_head(frame):
    inv = frame("repo string, path string, size bigint", ("r", "a.ts", 1), ("r", "b", 1), ("q", "b", 1))
    heads = frame("repo string, head_hash string", ("q", "h"))
    got = tuples(scan.scan_summary(scan.selection_sizes(inv), heads, "2024-01-02 03:04:05"),
                 "repo", "total_files", "selected_files", "head_hash")
    assert got == [("q", 1, 0, "h"), ("r", 2, 1, "no-git")]


def test_sizes_are_those_of_the_selection(spark):
    files = spark.range(9000).select(
        F.concat(F.lit("r"), (F.sqrt("id") / 7).cast("int").cast("string")).alias("repo"), F.lit(1).cast("bigint").alias("size"),
        F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/api/f", "x/gitgauge/f", "x/y/f", "f")]), (F.col("id") % 4 + 1).cast("int")),
                 F.col("id").cast("string"), F.when(F.col("id") % 5 < 3, ".ts").otherwise(".bin")).alias("path"))
    chosen = scan.adaptive_top_n(files).groupBy("repo").count()
    sizes = scan.selection_sizes(files).filter("selected_files > 0").select("repo", "selected_files")
    assert tuples(chosen) == tuples(sizes)


def test_content_join_both_ways(frame, monkeypatch):
    files = frame("repo string, path string, size bigint, content string",
                  *[("r", f"src/api/f{i}.ts", 1, f"text {i}") for i in range(20)])
    selected = scan.adaptive_top_n(files.drop("content"), 5)
    small = tuples(scan.with_content(selected, files), "path", "content")
    monkeypatch.setattr(scan, "broadcast_if_bounded", lambda df, groups, k: df)
    assert tuples(scan.with_content(selected, files), "path", "content") == small and len(small) == 5
