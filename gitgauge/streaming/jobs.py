"""Jobs that follow commits and run logs as streams.

State is Spark's own: file sinks, keyed state on RocksDB, streaming aggregates and session windows. Where a micro-batch is handled by a function, its
rows go to the folder of its number, which a replayed batch overwrites; so a replay changes nothing. What a stream has
brought is settled when it is read, by the same operators as in batch, so the order of arrival does not matter.
"""

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import history, requests, runlog
from ..operators.groups import MAX_BROADCAST_ROWS
from . import newest


def run_available(stream: DataFrame, handler, checkpoint: str, mode="append"):
    """Runs ``handler(batch, batch_id)`` over everything that is there, then stops."""
    query = (
        stream.writeStream.foreachBatch(handler).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def sink_available(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Appends everything that is there to the file sink ``folder/name``, and returns all that is in it."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/{name}")
        .option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stored(stream.sparkSession, f"{folder}/{name}", stream.schema)


def stored(spark, folder: str, schema) -> DataFrame:
    """The rows below a folder; none if no batch was written yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def broadcast_if_few(batch: DataFrame) -> DataFrame:
    """Marks a micro-batch for broadcast if it is small."""
    return F.broadcast(batch) if batch.count() <= MAX_BROADCAST_ROWS else batch


def stream_hot_files(commits: DataFrame, touches: DataFrame, folder: str, n=10, threshold=4) -> DataFrame:
    """Follows commits ``(repo, commit_id, ts)`` and touches ``(commit_id, path)``, with or without repo, as two streams, and returns
    the hot files of all that has come. A touch may come before or after its commit. What is read back is the state of the newest n
    commits (``newest``), not the history. Rows with a null repo, commit_id or path name nothing and are left out; where touches have no
    repo, a commit id belongs to one repository."""
    spark, names = commits.sparkSession, history.touch_keys(touches)
    newest.follow(commits.select("repo", "commit_id", "ts"), touches.select(*names, "path"), f"{folder}/state", n)
    return history.hot_files(newest.held_commits(spark, f"{folder}/state"), newest.held_touches(spark, f"{folder}/state", names), n, threshold)


def _latest_summary(rows: DataFrame) -> DataFrame:
    """The summary of the newest commit of each file. Keys decide, and the texts of the winners alone are joined."""
    newest = rows.groupBy("repo", "path").agg(F.max(F.struct("ts", "commit_id")).alias("k")).select("repo", "path", "k.*")
    return rows.join(newest, ["repo", "path", "ts", "commit_id"]).dropDuplicates(["repo", "path"])


def stream_refresh(commits: DataFrame, contents: DataFrame, folder: str, client_factory=None):
    """Summarises the files of each new commit that changes source, and logs the runs.

    ``commits(repo, commit_id, ts)`` is the stream, ``contents(commit_id, path, language, content)``, with or without repo, the table its
    files are looked up in. Returns the current summaries (newest commit per file) and the run log. A file that the batch
    changes several times is summarised once. Commits are logged as STARTED before any work, and as SUCCESS or FAILED with
    the seconds since then afterwards. Texts are read for the files that are due only.
    """
    spark = commits.sparkSession
    typed = {f.name: f.dataType.simpleString() for f in commits.schema}
    ids = f"repo {typed['repo']}, commit_id {typed['commit_id']}, ts {typed['ts']}"
    made_schema = f"repo {typed['repo']}, path string, ts {typed['ts']}, commit_id {typed['commit_id']}, summary string, tokens bigint, error string"
    log_schema = ids + ", status string, seconds bigint"
    keys = history.touch_keys(contents)

    def handler(batch, batch_id):
        begun = time.monotonic()
        batch = batch.select("repo", "commit_id", "ts").distinct()
        touched = contents.select(*keys, "path").join(broadcast_if_few(batch), keys)
        gate = touched.groupBy("repo", "commit_id", "ts").agg(F.bool_or(paths.is_source()).alias("go")).filter("go")
        log = f"{folder}/log/batch={batch_id}"
        gate.select("repo", "commit_id", "ts", F.lit("STARTED").alias("status"), F.lit(None).cast("bigint").alias("seconds")).write.mode(
            "overwrite").parquet(f"{log}/step=start")
        due = spark.read.schema(log_schema).parquet(f"{log}/step=start").select("repo", "commit_id", "ts")
        newest = touched.join(due, ["repo", "commit_id", "ts"]).groupBy("repo", "path").agg(
            F.max(F.struct("ts", "commit_id")).alias("k")).select("repo", "path", "k.*")
        text = F.max(F.struct("language", "content")).alias("f")
        found = contents.join(newest, [*keys, "path"]).groupBy("repo", "path", "ts", "commit_id").agg(text).select(
            "repo", "path", "ts", "commit_id", "f.*")
        made = requests.batch_summarize(found.select("repo", "path", "language", "content"), client_factory)
        done = f"{folder}/summaries/batch={batch_id}"
        newest.join(made, ["repo", "path"]).select(
            "repo", "path", "ts", "commit_id", "summary", "tokens", "error").write.mode("overwrite").parquet(done)
        broken = spark.read.schema(made_schema).parquet(done).filter(F.col("error").isNotNull()).select("repo", "commit_id").distinct()
        ended = due.join(broken.withColumn("bad", F.lit(True)), ["repo", "commit_id"], "left")
        ended.select(
            "repo", "commit_id", "ts", F.when(F.col("bad").isNull(), "SUCCESS").otherwise("FAILED").alias("status"),
            F.lit(round(time.monotonic() - begun)).cast("bigint").alias("seconds")).write.mode("overwrite").parquet(f"{log}/step=end")

    run_available(commits, handler, f"{folder}/checkpoint")
    return _latest_summary(stored(spark, f"{folder}/summaries", made_schema)), stored(spark, f"{folder}/log", log_schema)


def stream_alert_once(lines: DataFrame, folder: str) -> DataFrame:
    """Alerts of a run log ``(repo, seq, line)``, each (repo, commit) once ever: those that were raised before any mark that they
    were shown. A streaming aggregate keeps two numbers per (repo, commit), folded before its shuffle."""
    typed = {f.name: f.dataType.simpleString() for f in lines.schema}
    first = lambda shown, name: F.min(F.when(F.col("shown") == shown, F.col("seq"))).alias(name)
    seen = runlog.marked_lines(lines, "seq").groupBy("repo", "commit_hash").agg(first(False, "raised"), first(True, "told"))

    def handler(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")

    run_available(seen, handler, f"{folder}/checkpoint", "update")
    marks = stored(lines.sparkSession, f"{folder}/marks", f"repo {typed['repo']}, commit_hash string, raised {typed['seq']}, told {typed['seq']}")
    settled = marks.groupBy("repo", "commit_hash").agg(F.min("raised").alias("raised"), F.min("told").alias("told"))
    return settled.filter("raised < told or (raised is not null and told is null)").select("repo", "commit_hash")


def _runs(timed: DataFrame, timeout) -> DataFrame:
    """Runs of lines ``(repo, seq, line, at)``, with the time of their last line; status is null without a finish."""
    parsed = runlog.parsed_with(timed, "at").filter(F.col("status").isin("STARTED", "SUCCESS", "FAILED"))
    done = F.col("status") != "STARTED"
    seconds = F.regexp_extract("detail", r"^(\d+)s$", 1).try_cast("bigint")
    end = F.struct(F.col("at").alias("at"), "seq", F.col("status").alias("status"), seconds.alias("seconds"))
    return (
        parsed.groupBy("repo", "commit_hash", F.session_window("at", timeout).alias("w"))
        .agg(F.min(F.when(~done, F.col("at"))).alias("started_at"), F.max(F.when(done, end)).alias("end"),
             F.max("at").alias("last"))
        .filter(F.col("started_at").isNotNull())
        .withColumn("end", F.when(F.col("end.at") >= F.col("started_at"), F.col("end")))
        .select(
            "repo", "commit_hash", "started_at", F.col("end.at").alias("finished_at"), F.col("end.status").alias("status"),
            F.col("end.seconds").alias("seconds"), "last")
    )


def _timed(lines: DataFrame) -> DataFrame:
    return lines.select("repo", "seq", "line", F.col("ts").cast("timestamp").alias("at"))


def open_runs(log: DataFrame, timeout="6 hours", delay="1 hour") -> DataFrame:
    """Runs of a log that a stream over all of it has not closed yet: OPEN, or the status of their finish.

    Only commits with a line behind the watermark less the timeout are looked at.
    """
    timed = _timed(log)
    last = F.date_trunc("millisecond", F.max("at")) - F.expr(f"interval {delay}")
    edge = F.lit(timed.agg(last.alias("edge")).first()["edge"]).cast("timestamp")
    keyed = runlog.parsed_with(timed, "at").filter(F.col("at") + F.expr(f"interval {timeout}") > edge)
    recent = keyed.select("repo", "commit_hash").distinct()
    near = timed.withColumn("commit_hash", F.regexp_extract("line", r"Git: (\S+)", 1)).join(recent, ["repo", "commit_hash"], "left_semi")
    # by the last line, not by the end of the window: Spark moves a filter on a window below its merge, where rows would be lost
    return _runs(near.drop("commit_hash"), timeout).filter(F.col("last") + F.expr(f"interval {timeout}") > edge).withColumn(
        "status", F.coalesce("status", F.lit("OPEN"))).drop("last")


def stream_run_lifecycle(lines: DataFrame, log: DataFrame, folder: str, timeout="6 hours", delay="1 hour") -> DataFrame:
    """Runs of a log stream ``(repo, seq, ts, line)``: a start is paired with the finish of its commit; a run that sees
    nothing for ``timeout`` is closed, as TIMED_OUT if it did not finish. ``log`` is the same log at rest: its runs that
    are not closed yet are added, as OPEN if they did not finish.

    A session window per (repo, commit) holds a few numbers per open run; rows are folded before the shuffle. A run is
    written once, when the watermark passes its end.
    """
    closed = _runs(_timed(lines).withWatermark("at", delay), timeout).withColumn("status", F.coalesce("status", F.lit("TIMED_OUT"))).drop("last")
    return sink_available(closed, folder, "runs").unionByName(open_runs(log, timeout, delay))
