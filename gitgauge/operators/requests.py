"""Requests to a text model: prompts, batch summaries, message layout, costs.

The model itself is a parameter. Without one, a column expression makes the summaries, so every job runs offline.
"""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import task_count
from .scan import implementation_files, with_content

# --- fixed values -----------------------------------------------------------------------------------
# USD per million tokens
PRICES = [
    ("anthropic", "fast", 0.25), ("anthropic", "mid", 3.0), ("anthropic", "smart", 15.0),
    ("openai", "fast", 0.15), ("openai", "mid", 2.5), ("openai", "smart", 10.0),
]
# target, file, largest answer in tokens
TARGETS = [
    ("claude-code", "CLAUDE.md", 3000), ("cursor", ".cursorrules", 2500), ("windsurf", ".windsurfrules", 2500),
]
# characters of the file, answer tokens
TIERS = {"brief": (3000, 150), "deep": (6000, 500)}
# answer tokens of each document
DOC_BUDGETS = {"context": 4096, "dependency-map": 4000, "patterns": 4000, "handoff": 3000}
TOKENS_PER_FILE = 500
DOC_TOKENS = {"context": 5000, "dependency-map": 3000, "patterns": 3000}
DISPLAY_FACTOR = 1.4
NO_SUMMARY = "No summary available"
# --- end of fixed values ----------------------------------------------------------------------------

TIER_TASKS = {
    "brief": "In at most 50 words: what does this file export, and what is it responsible for?",
    "deep": "List the names this file exports, what it imports, and its purpose in one sentence.",
}
DOC_TASKS = {
    "context": "Write a guide that tells where in this repository each feature lives, with exact paths and names.",
    "dependency-map": "Draw how these modules use each other, and list the external packages with the files using them.",
    "patterns": "Show how code is written here, each pattern with an example taken from these files.",
}
TARGET_TASKS = {
    "claude-code": "Write CLAUDE.md for this stack as markdown: context, stack, code standards, testing, practices.",
    "cursor": "Write .cursorrules for this stack as plain text: context, stack, standards, testing, patterns.",
    "windsurf": "Write .windsurfrules for this stack: overview, stack, conventions, testing, patterns.",
}

# calls to a model that one task has open at a time
CALLS_AT_ONCE = 10


def summary_prompt(tier="brief"):
    """Prompt for one file from columns path, language, content: truncated smartly, then cut to the tier's budget."""
    chars, _ = TIERS[tier]
    cut = text.smart_truncated("content", language="language")
    return F.concat(
        F.lit(TIER_TASKS[tier] + "\n\nFile: "), "path", F.lit("\n\n```"), F.lower("language"), F.lit("\n"),
        text.budgeted(cut["content"], chars, already_cut=cut["truncated"]), F.lit("\n```\n"),
    )


def ask_model(prompts: DataFrame, keys, client_factory, tier, max_tokens, temperature, partitions=None, calls=CALLS_AT_ONCE) -> DataFrame:
    """Answer to each ``prompt`` as (keys, answer, tokens, error).

    Each task makes one client and calls ``client.generate(prompt, tier, max_tokens, temperature)``, which returns
    (text, tokens); up to ``calls`` of them run at once, so the client must be safe to share between threads, and answers keep the
    order of their prompts. A column ``max_tokens`` takes the place of the parameter row by row, and a column ``system`` is handed
    on under that name. A failed call fills ``error`` for its row and no other; a null prompt is not asked. The rows are dealt evenly
    over ``partitions`` tasks.
    """
    more = [c for c in ("max_tokens", "system") if c in prompts.columns and c not in keys]

    def call(batches):
        client = client_factory()

        def one(row):
            prompt, *given = row
            if prompt is None:
                return None, 0, None
            options = {"max_tokens": max_tokens} | {k: v for k, v in zip(more, given) if v is not None and v == v}
            options["max_tokens"] = int(options["max_tokens"])
            try:
                return (*client.generate(prompt, tier=tier, temperature=temperature, **options), None)
            except Exception as failure:  # one bad row must not fail the job
                return None, 0, f"{type(failure).__name__}: {failure}"

        with ThreadPoolExecutor(calls) as pool:
            for batch in batches:
                answers = list(pool.map(one, zip(batch["prompt"], *[batch[c] for c in more])))
                out = batch[keys].copy()
                for i, name in enumerate(("answer", "tokens", "error")):
                    out[name] = [a[i] for a in answers]
                yield out

    asked = prompts.select(*keys, "prompt", *more)
    asked = asked.repartition(partitions or task_count(asked), F.xxhash64(*keys))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name in keys]
    return asked.mapInPandas(call, ", ".join([*types, "answer string", "tokens bigint", "error string"]))


def batch_summarize(files: DataFrame, client_factory=None, tier="brief", partitions=None) -> DataFrame:
    """Summary of each file ``(repo, path, language, content)`` as (repo, path, summary, tokens, error).

    Without a client a column expression makes the summary and the tokens are those of the prompt. Empty or unreadable
    files get no summary and cost nothing.
    """
    prompts = files.select("repo", "path", "language", "content", summary_prompt(tier).alias("prompt"))
    readable = F.length("content") > 0
    if client_factory is None:
        return prompts.select(
            "repo", "path", text.default_summary("content", "language").alias("summary"),
            F.when(readable, text.token_estimate("prompt")).otherwise(F.lit(0)).cast("bigint").alias("tokens"),
            F.lit(None).cast("string").alias("error"),
        )
    asked = prompts.withColumn("prompt", F.when(readable, F.col("prompt")))
    answers = ask_model(asked, ["repo", "path"], client_factory, "fast", TIERS[tier][1], 0.3, partitions)
    return answers.withColumnRenamed("answer", "summary")


def write_documents(prompts: DataFrame, doc_type: str, client_factory=None, partitions=None) -> DataFrame:
    """Document of each repository from its prompt ``(repo, prompt)`` as (repo, doc_type, content, token_count, error).

    Without a client the document is the assembled prompt itself.
    """
    if client_factory is None:
        made = prompts.select("repo", F.col("prompt").alias("answer"), text.token_estimate("prompt").alias("tokens"),
                              F.lit(None).cast("string").alias("error"))
    else:
        made = ask_model(prompts, ["repo"], client_factory, "mid", DOC_BUDGETS[doc_type], 0.5, partitions)
    return made.select("repo", F.lit(doc_type).alias("doc_type"), F.col("answer").alias("content"),
                       F.col("tokens").alias("token_count"), "error")


def _prompts(blocks: DataFrame, task) -> DataFrame:
    """One prompt per repository from ranked blocks. The group is bounded by the cap of the selection."""
    items = F.sort_array(F.collect_list(F.struct("rank", "block")))
    joined = blocks.groupBy("repo").agg(items.alias("items"))
    body = F.array_join(F.col("items.block"), "\n\n")
    return joined.select("repo", F.size("items").cast("bigint").alias("n_files"),
                         F.concat(F.lit(task + "\n\n"), body).alias("prompt"))


def prompt_assemble(files: DataFrame, doc_type="context") -> DataFrame:
    """Prompt for the context or the dependency document from ``files(repo, path, language, rank, summary)``.

    The dependency prompt leaves out readme files and the language.
    """
    title = F.concat(F.lit("### "), "path")
    if doc_type == "dependency-map":
        files = files.filter(~F.lower("path").endswith("readme.md"))
    else:
        title = F.concat(title, F.lit(" ("), "language", F.lit(")"))
    told = F.when(F.length("summary") > 0, F.col("summary")).otherwise(F.lit(NO_SUMMARY))
    return _prompts(files.select("repo", "rank", F.concat(title, F.lit("\n"), told).alias("block")), DOC_TASKS[doc_type])


def pattern_prompt(selected: DataFrame, files: DataFrame, n=12, lines=200) -> DataFrame:
    """Prompt for the patterns document: code of the best implementation files instead of summaries."""
    code = with_content(implementation_files(selected, n), files, n).filter(F.length("content") > 0)
    block = F.concat(
        F.lit("### "), "path", F.lit(" ("), "language", F.lit(")\n```"), F.lower("language"), F.lit("\n"),
        text.head_excerpt("content", lines), F.lit("\n```"),
    )
    return _prompts(code.select("repo", "rank", block.alias("block")), DOC_TASKS["patterns"])


def message_split(messages: DataFrame) -> DataFrame:
    """Messages told apart by what a provider does with them: (conv_id, kind, pos, role, text), read in the order of pos.

    Kind ``system`` is what goes into the system text, joined by a blank line by whoever sends it; all others are kind
    ``message``. Row by row, so a conversation of any length is not shuffled.
    """
    kind = F.when(F.col("role") == "system", "system").otherwise("message")
    return messages.filter(F.col("role").isNotNull()).select("conv_id", kind.alias("kind"), F.col("turn").alias("pos"), "role", "text")


def request_fanout(stacks: DataFrame, targets=TARGETS) -> DataFrame:
    """One request per repository and agent target from
    ``stacks(repo, language, framework, testing, style, anti_patterns, notes)``; a row-wise explode, no join."""
    avoid = F.array_join(F.transform(F.split("anti_patterns", ","), text.trimmed), ", ")
    stack = F.concat(
        F.lit("- Language: "), "language", F.lit("\n- Framework: "), "framework", F.lit("\n- Testing: "), "testing",
        F.lit("\n- Style guide: "), "style", F.lit("\n- Anti-patterns to avoid: "), avoid,
        F.lit("\n- Architecture notes: "), "notes",
    )
    table = F.array(*[
        F.struct(F.lit(name).alias("target"), F.lit(path).alias("path"), F.lit(budget).cast("bigint").alias("max_tokens"),
                 F.lit(TARGET_TASKS[name]).alias("task"))
        for name, path, budget in targets
    ])
    return stacks.select("repo", stack.alias("stack"), F.explode(table).alias("t")).select(
        "repo", "t.target", "t.path", "t.max_tokens", F.concat("t.task", F.lit("\n\n"), "stack").alias("prompt")
    )


def spec_prompt(answers: DataFrame, validity: DataFrame, docs: DataFrame, lines=200) -> DataFrame:
    """Spec request from ``answers(repo, task, problem, approach, out_of_scope, done_criteria, risks)``; the first lines
    of the stored context are added only if it is valid for the head."""
    good = validity.filter("valid").select("repo", F.col("head_hash").alias("commit_hash"))
    context = docs.filter(F.col("doc_type") == "context").join(good, ["repo", "commit_hash"]).select(
        "repo", text.head_excerpt("content", lines, note=False).alias("context")
    )
    prompt = F.concat(
        F.lit("Write a spec for this task from the answers.\n\nTask: \""), "task", F.lit("\"\nRepo: "),
        F.col("repo").cast("string"), F.lit("\n\nProblem: "), "problem", F.lit("\nApproach: "), "approach",
        F.lit("\nOut of scope: "), "out_of_scope", F.lit("\nDone criteria: "), "done_criteria", F.lit("\nRisks: "), "risks",
        F.coalesce(F.concat(F.lit(f"\n\nContext (first {lines} lines):\n"), "context"), F.lit("")), F.lit("\n"),
    )
    return answers.join(context, "repo", "left").select(
        "repo", text.slug("task").alias("slug"), F.col("context").isNotNull().alias("has_context"), prompt.alias("prompt"),
        F.lit("fast").alias("tier"), F.lit(800).cast("bigint").alias("max_tokens"),
    )


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, "provider string, tier string, usd_per_million double")


def cost_rollup(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost of ``usage(repo, doc_type, tier, tokens)`` per provider, rolled up from document to repository to total.

    ``charged_usd`` prices every token at the mid tier, as the displayed cost does; ``by_tier_usd`` uses the real tier.
    The price table has six rows and is broadcast.
    """
    mid = prices.filter(F.col("tier") == "mid").select("provider", F.col("usd_per_million").alias("mid"))
    table = F.broadcast(prices.join(mid, "provider"))
    cost = lambda c: F.round(F.sum(F.col("tokens") / 1e6 * F.col(c)), 6)
    # fold to one row per (repo, doc_type, tier) before the rollup multiplies the rows
    folded = usage.groupBy("repo", "doc_type", "tier").agg(F.sum("tokens").alias("tokens"))
    return folded.join(table, "tier").rollup("provider", "repo", "doc_type").agg(
        F.sum("tokens").cast("bigint").alias("tokens"), cost("mid").alias("charged_usd"),
        cost("usd_per_million").alias("by_tier_usd"),
    ).filter(F.col("provider").isNotNull())


def cost_estimate(sizes: DataFrame, provider="anthropic") -> DataFrame:
    """Expected tokens by step for repositories ``(repo, selected_files)``, and the total with its price; ``buffered`` is
    what is displayed. Repositories without files are left out."""
    price = {(p, t): usd for p, t, usd in PRICES}[provider, "mid"]
    n = sizes.filter(F.col("selected_files") > 0).select("repo", F.col("selected_files").alias("n"))
    fixed = sum(DOC_TOKENS.values())
    step = lambda label, tokens: F.struct(F.lit(label).alias("label"), tokens.cast("bigint").alias("tokens"))
    steps = [step("file summaries", F.col("n") * TOKENS_PER_FILE)]
    steps += [step(label, F.lit(tokens)) for label, tokens in DOC_TOKENS.items()]
    steps += [step("total", F.col("n") * TOKENS_PER_FILE + fixed)]
    usd = F.col("s.tokens") / 1e6 * price
    return n.select("repo", "n", F.explode(F.array(*steps)).alias("s")).select(
        "repo", F.col("n").alias("files"), "s.label", "s.tokens",
        F.ceil(F.col("s.tokens") * F.lit(DISPLAY_FACTOR)).cast("bigint").alias("buffered_tokens"),
        F.when(F.col("s.label") == "total", F.round(usd, 6)).alias("usd"),
        F.when(F.col("s.label") == "total", F.round(usd * DISPLAY_FACTOR, 6)).alias("buffered_usd"),
    )
