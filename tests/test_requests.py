import pytest
from conftest import tuples
from pyspark.sql import functions as F

from gitgauge.operators import links, requests

FILES = "repo string, path string, language string, rank bigint, content string, summary string"


class Client:
    """Stands in for a model: answers from the prompt, fails for files called bad."""

    def generate(self, prompt, tier, max_tokens, temperature):
        assert (tier, max_tokens, temperature) == ("fast", 150, 0.3)
        if "File: bad" in prompt:
            raise RuntimeError("no answer")
        return f"{len(prompt)} characters", 7


def files(frame, *rows):
    return frame(FILES, *[("r", p, "TypeScript", i, c, None) for i, (p, c) in enumerate(rows, 1)])


def test_default_summaries(frame):
    df = files(frame, ("a.ts", "import x\nexport const a"), ("b.ts", "one  two\nthree " + "w " * 60), ("c.ts", ""), ("d.ts", None))
    got = {r.path: (r.summary, r.tokens) for r in requests.batch_summarize(df).collect()}
    assert got["a.ts"][0] == "export const a" and got["a.ts"][1] > 20
    assert got["b.ts"][0] == "one two three" + " w" * 47
    assert got["c.ts"] == (None, 0) and got["d.ts"] == (None, 0)


def test_client_answers_and_failures_stay_with_their_file(frame):
    df = files(frame, ("a.ts", "text"), ("bad.ts", "text"), ("c.ts", ""), ("d.ts", "text"))
    got = {r.path: r for r in requests.batch_summarize(df, Client, partitions=3).collect()}
    assert got["a.ts"].summary.endswith("characters") and got["a.ts"].tokens == 7 and got["a.ts"].error is None
    assert got["bad.ts"].summary is None and got["bad.ts"].error == "RuntimeError: no answer"
    assert (got["c.ts"].summary, got["c.ts"].tokens, got["c.ts"].error) == (None, 0, None)
    assert len(got) == 4


@pytest.mark.parametrize("tier,chars", [("brief", 3000), ("deep", 6000)])
def test_prompt_budget(frame, tier, chars):
    df = files(frame, ("a.ts", "x" * 7000), ("b.ts", "y"))
    long, short = (r.p for r in df.orderBy("path").select(requests.summary_prompt(tier).alias("p")).collect())
    assert "```typescript\n" + "x" * chars + " ...(truncated)\n```" in long and "truncated" not in short


def test_prompts_keep_rank_order(frame):
    df = frame(FILES, *[("r", f"f{i}.ts", "TypeScript", 50 - i, None, f"s{i}") for i in range(50)],
               ("r", "README.md", "Markdown", 0, None, None))
    (row,) = requests.prompt_assemble(df).collect()
    heads = [line for line in row.prompt.split("\n") if line.startswith("### ")]
    assert heads == ["### README.md (Markdown)"] + [f"### f{i}.ts (TypeScript)" for i in range(49, -1, -1)]
    assert "### README.md (Markdown)\nNo summary available\n\n### f49.ts" in row.prompt
    (dep,) = requests.prompt_assemble(df, "dependency-map").collect()
    assert dep.n_files == 50 and "README" not in dep.prompt and "### f0.ts\ns0" in dep.prompt


def test_messages(frame):
    df = frame("conv_id bigint, turn bigint, role string, text string", (1, 3, "system", "b"), (1, 0, "system", "a"),
               (1, 1, "user", "u"), (1, 2, "assistant", "v"), (2, 0, "user", "w"))
    assert tuples(requests.message_split(df)) == [
        (1, "message", 1, "user", "u"), (1, "message", 2, "assistant", "v"), (1, "system", 0, "system", "a"),
        (1, "system", 3, "system", "b"), (2, "message", 0, "user", "w")]


def test_fanout(frame):
    df = frame("repo string, language string, framework string, testing string, style string, anti_patterns string, notes string",
               ("r", "go", "gin", "std", "gofmt", " a ,b,  c d", "n"))
    rows = requests.request_fanout(df).collect()
    assert sorted((r.target, r.path, r.max_tokens) for r in rows) == [
        ("claude-code", "CLAUDE.md", 3000), ("cursor", ".cursorrules", 2500), ("windsurf", ".windsurfrules", 2500)]
    assert all("- Anti-patterns to avoid: a, b, c d\n" in r.prompt for r in rows)


def test_costs(spark, frame):
    usage = frame("repo string, doc_type string, tier string, tokens bigint", ("r", "context", "mid", 1_000_000),
                  ("r", "summary", "fast", 1_000_000))
    got = {(r.provider, r.repo, r.doc_type): (r.tokens, r.charged_usd, r.by_tier_usd)
           for r in requests.cost_rollup(usage, requests.price_table(spark)).collect()}
    assert got["anthropic", "r", None] == got["anthropic", None, None] == (2_000_000, 6.0, 3.25)
    assert got["openai", "r", "summary"] == (1_000_000, 2.5, 0.15)


def test_estimate(frame):
    sizes = frame("repo string, selected_files bigint", ("r", 23), ("empty", 0))
    got = {r.label: (r.tokens, r.buffered_tokens, r.usd) for r in requests.cost_estimate(sizes).collect()}
    assert got["file summaries"] == (11_500, 16_100, None) and got["context"] == (5000, 7000, None)
    assert got["total"] == (22_500, 31_500, 0.0675)


def test_relative_imports(frame):
    df = frame("s string, t string", ("src/a/b.ts", "./c"), ("src/a/b.ts", "../x.js"), ("b.ts", "../../y"), ("a/b.ts", "./d/../e"))
    assert [r.p for r in df.select(links.resolved_path("s", "t").alias("p")).collect()] == ["src/a/c", "src/x", "y", "a/e"]


def test_imports_packages_and_usage(frame):
    code = """import a from './lib'\nimport {b} from "@scope/kit/sub"\nconst c = require('lodash/fp')\nimport 'lodash'"""
    files = frame("source string, content string", ("src/m.ts", code), ("src/n.ts", "const x = require('lodash')"))
    raw = links.raw_links(files)
    relative = F.col("target").startswith(".")
    keyed = raw.withColumn("target_key", F.when(relative, links.resolved_path(F.col("source"), F.col("target"))).otherwise(F.col("target")))
    inventory = frame("target_key string, target_id string", ("src/lib", "src/lib.ts"))
    edges = links.link_edges(keyed, inventory)
    assert [(r.source, r.target_id) for r in edges.filter("target_id is not null").collect()] == [("src/m.ts", "src/lib.ts")]
    used = links.external_usage(edges, links.package_name("target"))
    assert tuples(used) == [("@scope/kit", "src/m.ts"), ("lodash", "src/m.ts"), ("lodash", "src/n.ts")]
    assert tuples(links.package_counts(used)) == [("@scope/kit", 1), ("lodash", 2)]


def test_popular_package_has_a_row_per_file(spark):
    edges = spark.range(12_000).select(
        F.format_string("f%05d.ts", "id").alias("source"), F.lit("react").alias("target"), F.lit(None).cast("string").alias("target_id"))
    used = links.external_usage(edges.unionByName(edges))
    assert used.count() == 12_000 and tuples(links.package_counts(used)) == [("react", 12_000)]


class Slow:
    """Notes how many calls are open at a time; fails on one prompt."""

    def __init__(self):
        import threading
        self.lock, self.open, self.most = threading.Lock(), 0, 0

    def generate(self, prompt, tier, max_tokens, temperature, system=None):
        import time
        with self.lock:
            self.open += 1
            self.most = max(self.most, self.open)
        time.sleep(0.05)
        with self.lock:
            self.open -= 1
        if prompt == "bad":
            raise ValueError("refused")
        return f"{prompt} {max_tokens} {system} {self.most}", 1


def test_model_calls_run_side_by_side(spark):
    rows = [(i, "bad" if i == 7 else f"p{i}", i if i % 2 else None, "be brief") for i in range(30)]
    asked = requests.ask_model(
        spark.createDataFrame(rows, "k int, prompt string, max_tokens int, system string"), ["k"], Slow, "fast", 150, 0.3, partitions=1, calls=5)
    got = {r.k: r for r in asked.collect()}
    assert got[7].error == "ValueError: refused" and got[7].answer is None and sum(r.error is not None for r in got.values()) == 1
    words = {k: r.answer.split(" ") for k, r in got.items() if k != 7}
    assert all(w[:4] == [f"p{k}", str(k if k % 2 else 150), "be", "brief"] for k, w in words.items())
    assert max(int(w[4]) for w in words.values()) == 5


def test_model_calls_are_dealt_over_tasks(spark):
    prompts = spark.range(20_000).selectExpr("id as k", "'p' as prompt")
    plan = requests.ask_model(prompts, ["k"], Slow, "fast", 150, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_failed_calls_are_told(spark, frame):
    from gitgauge.plans.context import build_context
    text = "export const a = 1;\n" * 20
    documents, summaries, costs, errors = build_context(
        frame("repo string, path string, size bigint, content string", ("r", "src/services/a.ts", 400, text)),
        frame("repo string, head_hash bigint", ("r", 1)), frame("repo string, doc_type string, content string, commit_hash bigint"),
        frame("repo string, path string, summary string"), frame("repo string, path string"), client_factory=Refusing)
    assert documents.count() == 0
    assert sorted((r.step, r.key, r.error) for r in errors.collect()) == [
        ("document", t, "ValueError: no") for t in ("context", "dependency-map", "patterns")] + [("summary", "src/services/a.ts", "ValueError: no")]


class Refusing:
    def generate(self, prompt, tier, max_tokens, temperature):
        raise ValueError("no")
