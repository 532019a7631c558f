"""Registry of specs, keyed by the slug of their task."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators.cache import newest_content


def spec_registry(specs: DataFrame) -> DataFrame:
    """Latest spec per (repo, slug) from ``specs(repo, task, content, saved_at)``; a save replaces the older one."""
    keyed = specs.select("repo", text.slug("task").alias("slug"), "content", "saved_at")
    saves = keyed.groupBy(F.col("repo").alias("_repo"), F.col("slug").alias("_slug")).agg(F.count(F.lit(1)).alias("saves"))
    last = newest_content(keyed, ["repo", "slug"])
    return last.join(saves, F.equal_null("repo", "_repo") & F.equal_null("slug", "_slug")).select("repo", "slug", "content", "saved_at", "saves")


def spec_list(files: DataFrame) -> DataFrame:
    """Names of the markdown files, without their suffix."""
    base = paths.basename()
    names = files.filter(base.endswith(".md"))
    return names.select("repo", F.substr(base, F.lit(1), F.length(base) - 3).alias("slug"))


def spec_load(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """Spec for each ``wanted(repo, task)``, by task text or slug; null if there is none."""
    asked = wanted.withColumn("slug", text.slug("task"))
    return asked.join(registry.select("repo", "slug", "content"), ["repo", "slug"], "left").select(
        "repo", "task", "slug", "content"
    )
