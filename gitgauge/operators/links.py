"""Link graph: which file refers to which, and what lies outside the inventory."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# import ... from 'x', require('x'), from x import y
IMPORT_PATTERN = r"""(?m)(?:\bfrom\s+|\bimport\s+|\brequire\(\s*)['"]([^'"]+)['"]"""


def raw_links(files: DataFrame, pattern=IMPORT_PATTERN) -> DataFrame:
    """(source, target) as written, once each; the text is projected away before the shuffle of ``distinct``."""
    found = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    return files.select(F.col("source"), F.explode(F.array_distinct(found)).alias("target")).distinct()


def resolved_path(source, target):
    """Path a relative import points to, without extension: ``./`` and ``../`` are taken from the source's folder."""
    folder = F.regexp_replace(F.regexp_extract(source, r"^(.*)/[^/]*$", 1), r"^(?=.)", "/")
    steps = F.split(F.concat(folder, F.lit("/"), target), "/")
    walked = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, s)),
    )
    return F.regexp_replace(F.array_join(walked, "/"), r"\.(ts|tsx|js|jsx|mjs|cjs)$", "")


def link_edges(links: DataFrame, inventory: DataFrame) -> DataFrame:
    """Edges ``links(source, target, target_key)`` with the file they reach in ``inventory(target_key, target_id)``,
    null outside of it. The inventory holds each key once, so a popular target costs no pairs."""
    return links.join(inventory, "target_key", "left").select("source", "target", "target_key", "target_id")


def package_name(specifier):
    """Package of an import: the scope and name, or the first segment."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def external_usage(edges: DataFrame, package="target") -> DataFrame:
    """Targets outside the inventory with the files that use them: (package, source), once each.

    A row per use at every size; ``package_counts`` counts them.
    """
    named = F.col(package) if isinstance(package, str) else package
    return edges.filter(F.col("target_id").isNull()).select(named.alias("package"), "source").distinct()


def package_counts(usage: DataFrame) -> DataFrame:
    """Number of files that use each package."""
    return usage.groupBy("package").agg(F.count(F.lit(1)).alias("n_files"))
