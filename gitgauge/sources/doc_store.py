"""Stores of documents and of file summaries on a shared file system, as Parquet that many may append to.

A save writes a folder of its own, cut by hash buckets of the repositories, and touches no other file, so savers never lose each other's rows
(Spark's committers do not stand two writers in one folder). What a save under a new commit hash wipes is settled when the store is
read, by the order of ``saved_at``; taking documents back is an appended row too. Reading repositories opens their buckets only. To
shrink a store, save what it loads to a new one.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cache

DOC_FIELDS = "doc_type string, content string, commit_hash {hash}, saved_at timestamp_ntz, token_count bigint"
BUCKET = "bucket"


class DocStore:
    """Documents ``(repo, doc_type, content, commit_hash, saved_at, token_count)`` by repository and type. A row without a doc_type and commit hash
    takes back all documents that its repository saved before it."""

    def __init__(self, spark: SparkSession, path: str, repo_type="string", hash_type="string", buckets=256):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = f"repo {repo_type}, " + DOC_FIELDS.format(hash=hash_type)
        self.columns = [c.split(" ")[0] for c in self.schema.split(", ")]

    def _bucket(self):
        return F.pmod(F.xxhash64("repo"), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _append(self, rows: DataFrame):
        rows.select(*self.columns, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/save={uuid.uuid4().hex}")

    def rows(self, repos: DataFrame = None) -> DataFrame:
        """All rows; with ``repos(repo)`` those of these repositories, read from their buckets alone."""
        try:
            found = self.spark.read.schema(f"{self.schema}, save string, {BUCKET} int").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.schema)
        if repos is not None:
            wanted = repos.select("repo", self._bucket()).distinct()
            opened = [r[BUCKET] for r in wanted.select(BUCKET).distinct().collect()]  # at most one row for each bucket
            found = found.filter(F.col(BUCKET).isin(opened)).join(wanted.select("repo"), "repo", "left_semi")
        return found.select(*self.columns)

    def load(self, repos: DataFrame = None) -> DataFrame:
        """The documents that count now."""
        every = self.rows(repos)
        taken = every.filter("doc_type IS NULL").groupBy("repo").agg(F.max("saved_at").alias("taken_at"))
        left = every.filter("doc_type IS NOT NULL").join(taken, "repo", "left").filter("taken_at IS NULL OR saved_at > taken_at")
        return cache.doc_store_fold(left.drop("taken_at"))

    def save(self, docs: DataFrame):
        self._append(docs)

    def invalidate(self, repos: DataFrame, at):
        """Drops all documents that the given repositories have saved up to the time ``at`` (a column or a datetime)."""
        when = (at if hasattr(at, "alias") else F.lit(at)).cast("timestamp_ntz")
        kinds = dict(self.spark.createDataFrame([], self.schema).dtypes)
        empty = [when.alias(c) if c == "saved_at" else F.lit(None).cast(kinds[c]).alias(c) for c in self.columns[1:]]
        self._append(repos.select("repo", *empty).distinct())
