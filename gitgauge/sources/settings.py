"""KEY=VALUE settings from several files, first file by priority wins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def settings_lines(files: DataFrame) -> DataFrame:
    """``files(repo, priority, content)`` to numbered lines."""
    return files.select("repo", "priority", F.posexplode(text.lines_of("content")).alias("line_no", "line"))


def settings_resolve(lines: DataFrame) -> DataFrame:
    """Value of each key per repository from ``lines(repo, priority, line_no, line)``.

    Comments, blank and malformed lines are skipped and paired quotes removed. In one file the last line of a key holds;
    an empty value counts as not set; of the files the lowest priority number wins, key by key.
    """
    pattern = r"^([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
    line = text.trimmed("line")
    value = text.trimmed(F.regexp_extract(line, pattern, 2))
    quoted = (value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'"))
    bare = F.when(quoted, F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0)))).otherwise(value)
    pairs = lines.select(
        "repo", "priority", "line_no", F.regexp_extract(line, pattern, 1).alias("key"), bare.alias("value")
    ).filter(F.length("key") > 0)
    per_file = pairs.groupBy("repo", "key", "priority").agg(F.max_by("value", "line_no").alias("value"))
    return (
        per_file.filter(F.length("value") > 0).groupBy("repo", "key")
        .agg(F.min(F.struct("priority", "value")).alias("first"))
        .select("repo", "key", "first.value", "first.priority")
    )
