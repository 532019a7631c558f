"""Stored documents and summaries: what is still valid, what must be made again.

``docs(repo, doc_type, content, commit_hash, saved_at, token_count)``; ``heads(repo, head_hash)``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .groups import top_k
from .history import ALERT_HEADER

REQUIRED_DOCS = ["context", "dependency-map", "patterns"]


def doc_store_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """State of the store after the new documents were saved one after another.

    A save under another commit hash discards every document of the old one; under the same hash it replaces the
    document of its type. So a repository keeps the documents of its last hash that were saved after any other hash.
    """
    return doc_store_fold(store.unionByName(new))


def doc_store_fold(both: DataFrame) -> DataFrame:
    """``doc_store_upsert`` over all saves in one frame, in the order of ``saved_at``."""
    saves = both.groupBy("repo", "commit_hash").agg(F.max("saved_at").alias("last"))
    two = top_k(saves, ["repo"], [F.desc("last"), F.desc("commit_hash")], 2, spread=["commit_hash"])
    current = two.groupBy("repo").agg(
        F.max(F.when(F.col("rank") == 1, F.col("commit_hash"))).alias("commit_hash"),
        F.max(F.when(F.col("rank") == 2, F.col("last"))).alias("wiped_at"),
    )
    kept = both.join(current, ["repo", "commit_hash"]).filter(
        F.col("wiped_at").isNull() | (F.col("saved_at") >= F.col("wiped_at"))
    )
    return newest_content(kept, ["repo", "commit_hash", "doc_type"]).select("repo", "doc_type", "content", "commit_hash", "saved_at", "token_count")


def newest_content(rows: DataFrame, keys, at="saved_at") -> DataFrame:
    """The newest row of each key (null is a key, too), ties by a digest of the content. Times and digests decide, so no text enters an
    aggregate; the texts are joined to the winners afterwards."""
    marked = rows.withColumn("_digest", F.xxhash64("content"))
    best = marked.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(F.struct(F.col(at).alias("at"), "_digest")).alias("_best"))
    same = [F.equal_null(k, f"_{k}") for k in keys] + [F.equal_null(at, "_best.at"), F.col("_digest") == F.col("_best._digest")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return marked.join(best, condition).select(*rows.columns).dropDuplicates(keys)


def summary_store_upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Summaries ``(repo, path, summary)`` after a save: a repository that was scanned again keeps none of its old ones."""
    scanned = new.select("repo").distinct()
    return store.join(scanned, "repo", "left_anti").unionByName(new)


def cached_hash(docs: DataFrame) -> DataFrame:
    newest = F.struct("saved_at", "commit_hash")
    return docs.groupBy("repo").agg(F.max(newest).alias("n")).select("repo", F.col("n.commit_hash").alias("cached_hash"))


def latest_docs(docs: DataFrame, *fields) -> DataFrame:
    """One row per repository: the aggregates ``fields`` over the documents of its newest hash, and ``cached_hash``.

    Folds per hash and then per repository, so the documents are read once and joined with nothing.
    """
    per_hash = docs.groupBy("repo", "commit_hash").agg(F.max("saved_at").alias("last"), *fields)
    names = [c for c in per_hash.columns if c not in ("repo", "commit_hash", "last")]
    newest = F.max_by(F.struct("commit_hash", *[F.col(f"`{c}`") for c in names]), F.struct("last", "commit_hash"))
    return per_hash.groupBy("repo").agg(newest.alias("d")).select(
        "repo", F.col("d.commit_hash").alias("cached_hash"), *[F.col(f"d.`{c}`").alias(c) for c in names])


def cache_validity(heads: DataFrame, docs: DataFrame) -> DataFrame:
    return heads.join(cached_hash(docs), "repo", "left").select(
        "repo", "head_hash", "cached_hash", F.equal_null("head_hash", "cached_hash").alias("valid")
    )


def complete_doc_set(heads: DataFrame, docs: DataFrame, required=REQUIRED_DOCS) -> DataFrame:
    """Hit only if every required document exists at the head hash; otherwise the missing ones are named."""
    have = (
        docs.filter(F.col("doc_type").isin(required))
        .groupBy("repo", F.col("commit_hash").alias("head_hash")).agg(F.collect_set("doc_type").alias("have"))
    )
    need = F.array(*[F.lit(r) for r in required])
    missing = F.when(F.col("have").isNull(), need).otherwise(F.array_except(need, "have"))
    return heads.join(have, ["repo", "head_hash"], "left").select(
        "repo", "head_hash", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing")
    )


def repos_to_build(selected: DataFrame, doc_sets: DataFrame) -> DataFrame:
    """Keeps the repositories without a full cache; comes before any content is read."""
    return selected.join(doc_sets.filter("complete").select("repo"), "repo", "left_anti")


def incremental_plan(selected: DataFrame, summaries: DataFrame, changed: DataFrame) -> DataFrame:
    """What to do for each selected file: reuse its summary, or summarise it because it changed or has none.

    An empty summary is none: it stands for a file that could not be read.
    """
    on = ["repo", "path"]
    redo = (F.coalesce(F.length("summary"), F.lit(0)) == 0) | F.col("touched").isNotNull()
    return (
        selected.join(summaries.select(*on, "summary"), on, "left")
        .join(changed.select(*on).distinct().withColumn("touched", F.lit(True)), on, "left")
        .select(*on, "rank", F.when(redo, "summarise").otherwise("reuse").alias("action"),
                F.when(~redo, F.col("summary")).alias("summary"))
    )


def merged_summaries(plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """Reused and new summaries together; files that left the selection are not in the plan and drop out."""
    return plan.filter("action = 'reuse'").select("repo", "path", "summary").unionByName(
        fresh.select("repo", "path", "summary")
    )


def load_context(heads: DataFrame, docs: DataFrame, alerts: DataFrame, force_refresh=False) -> DataFrame:
    """Combined text of the three documents per repository, whether it is stale, and the pending alert.

    Stored documents of any commit are served, with a stale flag when their hash is not the head; if one is missing the
    content is null and must be made. ``alerts`` is the output of ``alert_text``: an alert is announced by its header and
    the number of its files, and its lines are the rows of ``alerts``. Without one, alert is null.
    """
    pivot = latest_docs(docs, *[F.max(F.when(F.col("doc_type") == t, F.col("content"))).alias(t) for t in REQUIRED_DOCS])
    told = alerts.groupBy("repo").agg(F.count(F.lit(1)).alias("alert_files"))
    context, deps, patterns = (F.col(f"`{t}`") for t in REQUIRED_DOCS)
    combined = F.concat(
        F.lit("# Repository Context\n\n"), context, F.lit("\n\n---\n\n# Dependency Map\n\n"), deps,
        F.lit("\n\n---\n\n# Patterns\n\n"), patterns,
    )
    served = combined.isNotNull() & F.lit(not force_refresh)
    return heads.join(pivot, "repo", "left").join(told, "repo", "left").select(
        "repo", served.alias("from_cache"),
        (served & (F.col("cached_hash") != F.col("head_hash"))).alias("stale"),
        "cached_hash", F.col("head_hash").alias("current_hash"), F.when(served, combined).alias("content"),
        F.coalesce("alert_files", F.lit(0)).cast("bigint").alias("alert_files"),
        F.when(F.col("alert_files") > 0, F.format_string(ALERT_HEADER + ": %d", "alert_files")).alias("alert"),
    )
