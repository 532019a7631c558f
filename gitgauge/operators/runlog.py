"""Run log of background refreshes: ``run_log(repo, seq, line, ...)``, fields divided by a pipe."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .groups import top_k


def run_log_parse(lines: DataFrame) -> DataFrame:
    """Parsed lines of 2 to 5 fields; anything else is kept in ``raw``. Blank lines are dropped.

    2: status, hash; 3: time, hash, status; 4: adds a detail; 5: adds a cost before the detail.
    """
    return parsed_with(lines)


def parsed_with(lines: DataFrame, *keep) -> DataFrame:
    """``run_log_parse`` that also passes on the named input columns."""
    parts = F.transform(F.split("line", r"\|"), text.trimmed)
    at = lambda i: F.try_element_at("parts", F.lit(i))
    n = F.size("parts")
    stamp = F.try_to_timestamp(at(1)).cast("timestamp_ntz")
    short, long = n == 2, (n >= 3) & (n <= 5) & stamp.isNotNull()
    found = F.regexp_extract(at(2), r"^Git: (\S+)$", 1)
    known = (short | long) & (found != "")
    return (
        lines.filter(F.length(text.trimmed("line")) > 0).withColumn("parts", parts)
        .select(
            "repo", "seq", *keep,
            F.when(known & ~short, stamp).alias("logged_at"),
            F.when(known, found).alias("commit_hash"),
            F.when(known, F.when(short, at(1)).otherwise(at(3))).alias("status"),
            F.when(known & (n == 5), at(4)).alias("cost"),
            F.when(known & (n >= 4), F.when(n == 5, at(5)).otherwise(at(4))).alias("detail"),
            F.when(~known, F.col("line")).alias("raw"),
        )
    )


def tail_n(lines: DataFrame, n=10) -> DataFrame:
    """Last n lines of each repository, newest first, beside its count of lines."""
    kept = lines.filter(F.length(text.trimmed("line")) > 0).select("repo", "seq", "line")
    totals = kept.groupBy("repo").agg(F.count(F.lit(1)).alias("total"))
    newest = top_k(kept, ["repo"], [F.desc("seq")], n, spread=["seq"])
    return newest.join(totals, "repo").select("repo", "rank", "line", "total")


def last_run_status(lines: DataFrame, repos: DataFrame) -> DataFrame:
    """Status of the newest line: success or anything unknown passes, a failure or no log warns."""
    kept = lines.filter(F.length(text.trimmed("line")) > 0)
    last = kept.groupBy("repo").agg(F.max_by("line", "seq").alias("last"), F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n").isNull() | F.contains("last", F.lit("FAILED")) & ~F.contains("last", F.lit("SUCCESS")),
                   "warn").otherwise("pass")
    message = (
        F.when(F.col("n").isNull(), "no runs on record")
        .when(F.contains("last", F.lit("SUCCESS")),
              F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " run").otherwise(" runs"),
                       F.lit(" on record, newest succeeded")))
        .when(F.contains("last", F.lit("FAILED")), "newest run failed")
        .otherwise(F.concat(F.lit("log holds "), F.col("n").cast("string"), F.lit(" lines")))
    )
    return repos.join(last, "repo", "left").select(
        "repo", state.alias("status"), message.alias("message"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("entries"),
    )


def run_durations(lines: DataFrame) -> DataFrame:
    """One row per started run: first start, last finish of the same commit, and the seconds it reports.

    Lines that are no log lines fold into one group per repository, without a start, and drop out after the aggregate; a
    filter before it would be pushed down and parse every line twice.
    """
    log = run_log_parse(lines)
    done = F.col("status").isin("SUCCESS", "FAILED")
    seconds = F.regexp_extract("detail", r"^(\d+)s$", 1).try_cast("bigint")
    end = F.struct(F.col("logged_at").alias("at"), F.col("status").alias("status"), seconds.alias("seconds"))
    return (
        log.groupBy("repo", "commit_hash")
        .agg(
            F.min(F.when(F.col("status") == "STARTED", F.col("logged_at"))).alias("started_at"),
            F.max_by(F.when(done, end), F.when(done, F.struct("logged_at", "seq"))).alias("end"),
        )
        .filter(F.col("started_at").isNotNull())
        .withColumn("end", F.when(F.col("end.at") >= F.col("started_at"), F.col("end")))
        .select(
            "repo", "commit_hash", "started_at", F.col("end.at").alias("finished_at"),
            F.coalesce("end.status", F.lit("OPEN")).alias("status"), F.col("end.seconds").alias("seconds"),
        )
    )


def run_success_rate(lines: DataFrame) -> DataFrame:
    runs = run_durations(lines)
    good = F.count_if(F.col("status") == "SUCCESS")
    return runs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("runs"), good.alias("succeeded"),
        F.round(good / F.count(F.lit(1)), 6).alias("rate"), F.sum("seconds").cast("bigint").alias("seconds"),
    )


def marked_lines(lines: DataFrame, *more) -> DataFrame:
    """(repo, commit_hash, shown, ...) of each line that raises an alert or marks it as delivered."""
    raised = F.regexp_extract("line", r"\| Git: (\S+) \| DOOM \| detected", 1)
    shown = F.regexp_extract("line", r"DOOM_SHOWN \| Git: (\S+)", 1)
    return lines.select(
        "repo", F.when(raised != "", raised).otherwise(shown).alias("commit_hash"), (raised == "").alias("shown"), *more
    ).filter(F.col("commit_hash") != "")


def alert_marks(lines: DataFrame) -> DataFrame:
    """(repo, commit_hash, shown) for each alert that was raised or delivered."""
    return marked_lines(lines).distinct()


def pending_alerts(lines: DataFrame, heads: DataFrame, hot: DataFrame, check_shown=True) -> DataFrame:
    """Hot files of repositories whose head commit raised an alert that was not delivered yet.

    ``heads(repo, short_hash)``. Nothing is marked here: the caller marks what it delivers, so that a false alarm
    does not use up the mark. ``check_shown=False`` is the variant without memory.
    """
    marks = alert_marks(lines)
    on = ["repo", "short_hash"]
    raised = marks.filter(~F.col("shown")).select("repo", F.col("commit_hash").alias("short_hash"))
    due = heads.select(*on).join(raised, on, "left_semi")
    if check_shown:
        told = marks.filter("shown").select("repo", F.col("commit_hash").alias("short_hash"))
        due = due.join(told, on, "left_anti")
    return hot.join(due, "repo").select("repo", "short_hash", "path", "commit_count", "percentage")


def delivery_lines(alerts: DataFrame) -> DataFrame:
    """Log lines that mark alerts ``(repo, short_hash, ...)`` as delivered; append them once the alerts are out."""
    return alerts.select("repo", F.concat(F.lit("DOOM_SHOWN | Git: "), "short_hash").alias("line")).distinct()
