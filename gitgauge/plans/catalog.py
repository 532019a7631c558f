"""The registered queries: each runs one operator over the whole given tables."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, cache, corpus, health, history, links, modules, requests, runlog, scan
from ..sources import ignore_rules, settings, specs
from . import disk, streams
from .context import build_context
from .views import Tables

NOW = "1998-12-31 12:00:00"
TOKEN_RULE = (r'token = "([^"]+)"', 1)
TOKEN_PREFIXES = [("digit", "2"), ("letter", "f")]
LINE_PREFIXES = ["The ", "De "]
IGNORE_TEXT = "# build output\ndocs/\n*.sol\n!a/b/c/d/e/f/contracts/Token1*.sol\nsrc/lib/**/*.test.ts\n"


def _selected(t):
    return scan.adaptive_top_n(scan.file_inventory(t.files()))


def _sizes(t):
    return scan.selection_sizes(scan.file_inventory(t.files()))


def _hot(t):
    return history.hot_files(t.commits(), t.coarse_rows())


def _history_text(t):
    """Each line item as a piece of history text: its path between blank lines, and the note beside it."""
    piece = F.concat(F.lit("\n  "), "path", F.lit(" \n\n"), "path", F.lit(".note.md\n"))
    return history.commit_touches(t.touch_rows().select("commit_id", piece.alias("files"))).distinct()


def _ignore_files(t):
    """One ignore file at the root of each repository and one in a folder."""
    langs = t.table("documents").select(F.col("lang").alias("repo")).distinct()
    found = F.array(
        F.struct(F.lit("").alias("folder"), F.lit(IGNORE_TEXT).alias("content")),
        F.struct(F.lit("src/components").alias("folder"), F.lit("*1.tsx\n").alias("content")),
    )
    return langs.select("repo", F.explode(found).alias("f")).select("repo", "f.folder", "f.content")


def _specs(t):
    lines = text.lines_of("text")
    return t.table("documents").select(
        F.col("lang").alias("repo"), F.element_at(lines, 1).alias("task"), F.element_at(lines, -1).alias("last_line"),
        F.col("text").alias("content"), F.col("doc_id").alias("saved_at"))


def _incremental(t):
    return cache.incremental_plan(_selected(t), t.summary_cache(), t.changed())


def _summarised(t):
    """Selected files with their stored summary."""
    return _selected(t).join(t.summary_cache(), ["repo", "path"], "left")


def _usage(t):
    tier = F.when(F.col("doc_type") == "patterns", "fast").when(F.col("doc_type") == "context", "smart").otherwise("mid")
    return t.docs().select("repo", "doc_type", tier.alias("tier"), F.col("token_count").alias("tokens"))


def _handoff(t):
    tree = t.working_tree()
    state = t.repos().join(history.heads(t.commits(), "branch"), "repo", "left").select(
        "repo", F.coalesce("branch", F.lit("unknown")).alias("branch"),
        F.when(F.col("branch") == "O", "close open orders").alias("goal"))
    modified = tree.filter(F.col("kind") != "committed").select("repo", "path").distinct()
    return history.session_handoff(state, modified, t.commits(), tree.select("repo", "kind", "seq", "line"), diff_chars=60)


def _stacks(t):
    name = F.col("s_name")
    return t.table("supplier").select(
        name.alias("repo"), F.lower(name).alias("language"), F.lit("spring").alias("framework"),
        F.lit("junit").alias("testing"), F.lit("plain").alias("style"),
        F.concat(F.lit(" globals ,"), name, F.lit(", deep nesting ")).alias("anti_patterns"), F.lit("layers").alias("notes"))


def _spec_requests(t):
    answers = t.table("nation").select(
        F.col("n_nationkey").alias("repo"), F.concat(F.lit("Fix: "), "n_name", F.lit(" (v2)")).alias("task"),
        F.concat("n_name", F.lit(" is slow")).alias("problem"), F.lit("cache it").alias("approach"),
        F.lit("rewrites").alias("out_of_scope"), F.lit("tests pass").alias("done_criteria"), F.lit("stale data").alias("risks"))
    heads = history.heads(t.commits())
    return requests.spec_prompt(answers, cache.cache_validity(heads, t.docs(ranks=(1,))), t.docs(ranks=(1,)))


def _edges(t):
    raw = links.raw_links(t.page_links(), 'href="([^"]+)"').withColumn("target_key", F.col("target"))
    return links.link_edges(raw, t.page_sections())


def _checks(t):
    state = health.repo_state(
        history.heads(t.commits()), cache.doc_store_upsert(t.docs(ranks=(2, 3)), t.docs(ranks=(1,))), t.run_log(),
        t.nation_summaries(), t.nation_agent_files(), "<!-- S -->")
    return health.health_checks(state, NOW)


def _pending(t, check_shown=True):
    heads = history.heads(t.commits(), "short_hash")
    return runlog.pending_alerts(t.run_log(), heads, _hot(t), check_shown)


def _context(t):
    stored = cache.doc_store_upsert(t.docs(ranks=(2, 3)), t.docs(ranks=(1,)))
    return cache.load_context(history.heads(t.commits()), stored, history.alert_text(_pending(t, False)))


def _summaries(t):
    return requests.batch_summarize(scan.with_content(_selected(t), t.files()))


def _build(t):
    documents, *_ = build_context(t.files(), t.file_heads(), t.file_docs(), t.summary_cache(), t.changed(), now=NOW)
    return documents


def _blocks(t):
    agents = blocks.agent_paths(t.nation_agent_files())
    return blocks.instruction_blocks(agents, history.heads(t.commits()), NOW[:10])


VIEW_QUERIES = {
    # sources and stores
    "file_inventory": lambda t: scan.file_inventory(t.files()),
    "ignore_filter": lambda t: scan.ignore_filter(t.files()).select("repo", "path"),
    "ignore_files": lambda t: ignore_rules.apply_ignore_files(scan.file_inventory(t.files()), _ignore_files(t)),
    "disk_listing": lambda t: disk.listed_files(t.spark, disk.tree_of(t, _ignore_files(t))).select("repo", "path", "size"),
    "disk_scan": lambda t: disk.scan_disk(t.spark, disk.tree_of(t, _ignore_files(t))).select("repo", "path", "score", "rank", "content"),
    "commit_touches": _history_text,
    "run_log_parse": lambda t: runlog.run_log_parse(t.run_log()),
    "settings_resolve": lambda t: settings.settings_resolve(t.settings()),
    "doc_store_upsert": lambda t: cache.doc_store_upsert(t.docs(ranks=(2, 3)), t.docs(ranks=(1,))),
    "spec_registry": lambda t: specs.spec_registry(_specs(t)),
    "spec_list": lambda t: specs.spec_list(scan.file_inventory(t.files())),
    "spec_load": lambda t: specs.spec_load(
        specs.spec_registry(_specs(t)),
        _specs(t).select("repo", F.col("last_line").alias("task")).distinct()),
    # projection, predicates, scores
    "language_profile": lambda t: scan.language_profile(scan.file_inventory(t.files())),
    "scan_summary": lambda t: scan.scan_summary(_sizes(t), t.file_heads(), NOW),
    "supported_filter": lambda t: scan.supported_filter(scan.file_inventory(t.files())).select("repo", "path"),
    "relevance_score": lambda t: scan.relevance_score(scan.file_inventory(t.files())).select("repo", "path", "score"),
    "implementation_files": lambda t: scan.implementation_files(_selected(t)).select("repo", "path", "score", "rank"),
    "source_change_gate": lambda t: history.source_change_gate(t.commits(), t.touch_rows()),
    # top-k and batches
    "adaptive_top_n": _selected,
    "last_n_commits": lambda t: history.last_n_commits(t.commits()).select("repo", "commit_id", "ts", "rank"),
    "tail_n": lambda t: runlog.tail_n(t.run_log()),
    "last_run_status": lambda t: runlog.last_run_status(
        t.run_log(), t.table("customer").select(F.col("c_custkey").alias("repo"))),
    "preview_with_rest": lambda t: scan.preview_with_rest(_selected(t)),
    "work_batches": lambda t: scan.work_batches(_selected(t)),
    # history
    "churn_exclude": lambda t: history.churn_exclude(t.touches()),
    "changed_in_head": lambda t: history.changed_in_head(t.commits(), t.touch_rows()),
    "changed_since": lambda t: history.changed_since(
        t.commits(), t.touch_rows(),
        history.heads(t.commits().filter("message = '1-URGENT'"), "ts").withColumnsRenamed(
            {"head_hash": "cached_hash", "ts": "cached_ts"})),
    "hot_files": _hot,
    "hot_summary": lambda t: history.hot_summary(_hot(t), t.repos()),
    "pending_alerts": _pending,
    "pending_alerts_stateless": lambda t: _pending(t, False),
    "alert_text": lambda t: history.alert_text(_hot(t)),
    "recent_commits_digest": lambda t: history.recent_commits_digest(t.commits()),
    "run_durations": lambda t: runlog.run_durations(t.run_log()),
    "run_success_rate": lambda t: runlog.run_success_rate(t.run_log()),
    "session_handoff": _handoff,
    # text
    "smart_truncate": lambda t: corpus.smart_truncate(t.docs_corpus(), 5, 20, 4, 3, LINE_PREFIXES),
    "export_lines": lambda t: corpus.export_lines(t.docs_corpus(), LINE_PREFIXES),
    "char_budget": lambda t: corpus.char_budget(t.docs_corpus()),
    "head_excerpt": lambda t: corpus.head_excerpt(t.docs_corpus(), 5),
    "token_estimate": lambda t: corpus.token_totals(t.docs_corpus()),
    "credential_scan": lambda t: corpus.credential_scan(t.docs_corpus(), TOKEN_RULE, TOKEN_PREFIXES),
    "credential_counts": lambda t: corpus.credential_counts(t.docs_corpus(), TOKEN_RULE, TOKEN_PREFIXES),
    "instruction_blocks": _blocks,
    "managed_block_upsert": lambda t: blocks.managed_block_upsert(t.agent_files(), t.blocks(), "<!-- S -->", "<!-- E -->"),
    "managed_block_remove": lambda t: blocks.managed_block_remove(t.agent_files(), "<!-- S -->", " the "),
    "reference_append": lambda t: blocks.reference_append(
        t.agent_files(), t.blocks().select("repo", "path", text.slug("block").alias("slug"))),
    # cache
    "cache_validity": lambda t: cache.cache_validity(history.heads(t.commits()), t.docs(ranks=(1,))),
    "complete_doc_set": lambda t: cache.complete_doc_set(history.heads(t.commits()), t.docs()),
    "incremental_plan": _incremental,
    "summary_store_upsert": lambda t: cache.summary_store_upsert(
        t.summary_cache(), _incremental(t).filter("repo in ('fr', 'de')").select("repo", "path", "summary")),
    "load_context": _context,
    "build_context": _build,
    # requests and costs
    "batch_summarize": lambda t: _summaries(t).drop("error"),
    "prompt_assemble": lambda t: requests.prompt_assemble(_summarised(t)),
    "prompt_dependency": lambda t: requests.prompt_assemble(_summarised(t), "dependency-map"),
    "prompt_patterns": lambda t: requests.pattern_prompt(_selected(t), t.files()),
    "message_split": lambda t: requests.message_split(t.table("conversations")),
    "request_fanout": lambda t: requests.request_fanout(_stacks(t)),
    "spec_prompt": _spec_requests,
    "cost_rollup": lambda t: requests.cost_rollup(_usage(t), requests.price_table(t.spark)),
    "cost_estimate": lambda t: requests.cost_estimate(_sizes(t)),
    # links
    "link_edges": _edges,
    "external_usage": lambda t: links.external_usage(_edges(t)),
    "package_counts": lambda t: links.package_counts(links.external_usage(_edges(t))),
    "module_graph": lambda t: modules.module_graph(t.code_files()),
    "module_packages": lambda t: modules.module_packages(modules.module_graph(t.code_files())),
    "module_users": lambda t: modules.module_users(modules.module_graph(t.code_files())),
    # health
    "health_checks": _checks,
    "health_score": lambda t: health.health_score(_checks(t)),
    # streams, run to the end of the given tables
    "stream_refresh": streams.stream_refresh,
    "stream_refresh_log": streams.stream_refresh_log,
    "stream_hot_files": streams.stream_hot_files,
    "stream_alert_once": streams.stream_alert_once,
    "stream_run_lifecycle": streams.stream_run_lifecycle,
}


def queries():
    def bind(build):
        return lambda spark, sf_dir: build(Tables(spark, sf_dir))

    return {name: bind(build) for name, build in VIEW_QUERIES.items()}
