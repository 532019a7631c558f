"""The scan of repositories on disk, from a folder to the text of the best files."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan
from ..session import shared_dir, written
from ..sources import inventory


def listed_files(spark: SparkSession, root: str, include_hidden=False, ignore_name=".gitignore") -> DataFrame:
    """Files below ``root`` (one folder per repository) that none of the ignore files found there hides, listed once.

    Ignore files are hidden files themselves and are read whatever ``include_hidden`` says.
    """
    return written(inventory.walk(spark, root, None, include_hidden, ignore_name), "listed")


def scan_disk(spark: SparkSession, root: str, max_files=100, **options) -> DataFrame:
    """Best files of each repository below ``root`` with their ``content``: the cap counts the files left by the ignore files, and
    only the selected files are opened. ``options`` are those of ``listed_files``."""
    best = scan.adaptive_top_n(listed_files(spark, root, **options), max_files)
    texts = written(inventory.read_content(best.select("repo", "path"), root), "content")  # files are opened once, whoever reads the result
    return best.join(texts, ["repo", "path"])


def tree_of(t, ignore_files: DataFrame) -> str:
    """The files of ``t.files()`` with their whole text as a tree of folders in the shared folder, ignore files among them."""
    root = shared_dir(t.spark, "tree")
    rules = ignore_files.select("repo", F.when(F.col("folder") == "", F.lit(".gitignore")).otherwise(F.concat("folder", F.lit("/.gitignore"))).alias("path"),
                                "content")
    inventory.write_tree(t.files().filter("repo IS NOT NULL").select("repo", "path", "content").unionByName(rules), root)
    return root
