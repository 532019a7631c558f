"""The streaming queries: the given tables are read as streams to their end, the final state is returned."""

from pyspark.sql import functions as F

from ..functions import paths
from ..session import shared_dir
from ..streaming import jobs
from .views import Tables


class StreamTables(Tables):
    """Like ``Tables``, but the tables named in ``live`` are streams."""

    def __init__(self, spark, sf_dir, live):
        super().__init__(spark, sf_dir)
        self.live = live

    def table(self, name):
        still = super().table(name)
        if name not in self.live:
            return still
        # a glob, so that the table may be one file or a folder of files
        return self.spark.readStream.schema(still.schema).parquet(f"{self.dir}/{name}.parquet*")


def _refresh(t: Tables):
    commits = StreamTables(t.spark, t.dir, {"orders"}).commits().select("repo", "commit_id", "ts")
    contents = t.touch_rows("p_name").select(
        "commit_id", "path", paths.language().alias("language"),
        F.concat(F.lit("export const part = '"), "p_name", F.lit("'\nreturn part")).alias("content"))
    return jobs.stream_refresh(commits, contents, shared_dir(t.spark, "refresh"))


def stream_refresh(t: Tables):
    summaries, _ = _refresh(t)
    return summaries.select("repo", "path", "commit_id", "summary")


def stream_refresh_log(t: Tables):
    _, log = _refresh(t)
    return log.select("repo", "commit_id", "status")


def stream_hot_files(t: Tables):
    """Touches come as one stream, commits as another one, so that commits without files count too."""
    touches = StreamTables(t.spark, t.dir, {"lineitem"}).coarse_rows()
    commits = StreamTables(t.spark, t.dir, {"orders"}).commits()
    return jobs.stream_hot_files(commits, touches, shared_dir(t.spark, "hot"))


def stream_alert_once(t: Tables):
    lines = StreamTables(t.spark, t.dir, {"events"}).run_log().select("repo", "seq", "line")
    return jobs.stream_alert_once(lines, shared_dir(t.spark, "alerts"))


def stream_run_lifecycle(t: Tables):
    lines = StreamTables(t.spark, t.dir, {"events"}).run_log()
    runs = jobs.stream_run_lifecycle(lines, t.run_log(), shared_dir(t.spark, "runs"))
    ntz = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("started_at", "finished_at")]
    return runs.select("repo", "commit_hash", *ntz, "status", "seconds")
