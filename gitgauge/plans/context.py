"""The whole build of context documents, from listed files to stored documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cache, requests, scan
from ..operators.groups import broadcast_if_bounded
from ..session import written


def build_context(files: DataFrame, heads: DataFrame, docs: DataFrame, summaries: DataFrame, changed: DataFrame,
                  client_factory=None, max_files=100, use_cache=True, now="1970-01-01 00:00:00"):
    """New documents and summaries of all repositories that have no full set of documents at their head.

    ``files(repo, path, size, content)``; the other inputs are those of the cache operators. Repositories with a full cache
    leave before anything is ranked or read. Only files that changed or have no summary are summarised. Returns
    (documents, summaries, costs, errors); store the documents with ``doc_store_upsert``. Each failed call is a row
    (repo, step, key, error) of errors, its key a path or a document type; what failed is neither stored nor lost from sight.
    """
    todo = heads
    if use_cache:
        complete = cache.complete_doc_set(heads, docs).filter("complete").select("repo")
        todo = heads.join(complete, "repo", "left_anti")
    # without the mark Spark would deal the texts of all files by repository before it learns how few repositories there are
    due = todo.select("repo").distinct()
    files = files.join(broadcast_if_bounded(due, due, 1), "repo", "left_semi")
    # the selection and the summaries are small next to the files and are read several times: each is computed once
    selected = written(scan.adaptive_top_n(scan.file_inventory(files), max_files), "selection")
    on = ["repo", "path"]
    plan = cache.incremental_plan(selected, summaries, changed)
    redo = selected.join(plan.filter("action = 'summarise'").select(*on), on, "left_semi")
    fresh = requests.batch_summarize(scan.with_content(redo, files, max(scan.LARGEST_SHARE, max_files)), client_factory)
    known = plan.filter("action = 'reuse'").select(
        *on, "summary", F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("error")).unionByName(
        fresh.select(*on, "summary", "tokens", "error"))
    told = written(selected.join(known, on, "left"), "summaries")
    prompts = {
        "context": requests.prompt_assemble(told), "dependency-map": requests.prompt_assemble(told, "dependency-map"),
        "patterns": requests.pattern_prompt(selected, files),
    }
    made = None
    for doc_type, prompt in prompts.items():
        part = requests.write_documents(prompt, doc_type, client_factory)
        made = part if made is None else made.unionByName(part)
    if client_factory is not None:
        made = written(made, "documents")
    documents = made.filter(F.col("error").isNull()).join(todo.select("repo", F.col("head_hash").alias("commit_hash")), "repo").select(
        "repo", "doc_type", "content", "commit_hash", F.lit(now).cast("timestamp_ntz").alias("saved_at"), "token_count")
    spent = made.select("repo", "doc_type", F.lit("mid").alias("tier"), F.col("token_count").alias("tokens")).unionByName(
        told.select("repo", F.lit("summaries").alias("doc_type"), F.lit("fast").alias("tier"), "tokens"))
    costs = requests.cost_rollup(spent, requests.price_table(files.sparkSession))
    failed = told.select("repo", F.lit("summary").alias("step"), F.col("path").alias("key"), "error").unionByName(
        made.select("repo", F.lit("document").alias("step"), F.col("doc_type").alias("key"), "error"))
    return documents, told.select(*on, "summary"), costs, failed.filter(F.col("error").isNotNull())
