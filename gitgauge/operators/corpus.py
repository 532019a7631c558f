"""Text preparation over a corpus ``(doc_id, repo, content)``; thin frames around the text expressions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text


def smart_truncate(docs: DataFrame, small=200, medium=500, keep_medium=150, keep_large=100,
                   prefixes=text.EXPORT_PREFIXES, language=None) -> DataFrame:
    cut = text.smart_truncated("content", small, medium, keep_medium, keep_large, prefixes, language)
    return docs.select("doc_id", cut.alias("t")).select("doc_id", "t.n_lines", "t.truncated", "t.content")


def export_lines(docs: DataFrame, prefixes=text.EXPORT_PREFIXES, language=None) -> DataFrame:
    """One row per exporting line, numbered in order."""
    found = text.exported(text.lines_of("content"), prefixes, language)
    return docs.select("doc_id", F.posexplode(found).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))


def char_budget(docs: DataFrame, n=3000, mark=text.CUT_MARK) -> DataFrame:
    return docs.select("doc_id", (F.length("content") > n).alias("cut"),
                       text.budgeted("content", n, mark).alias("content"))


def head_excerpt(docs: DataFrame, n=200, note=True) -> DataFrame:
    return docs.select("doc_id", text.head_excerpt("content", n, note).alias("content"))


def token_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("repo").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(text.token_estimate("content")).alias("tokens")
    )


KEY_PATTERN = (r"(sk-[A-Za-z0-9_-]{8,})", 1)


def _findings(pattern, group):
    return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))


def credential_scan(docs: DataFrame, rule=KEY_PATTERN, prefixes=text.KEY_PREFIXES) -> DataFrame:
    """Key-like strings per document, by owner, in both mask styles. The text never reaches a shuffle."""
    hits = docs.select("doc_id", "repo", F.explode(_findings(*rule)).alias("secret"))
    return hits.select(
        "doc_id", "repo", text.key_kind("secret", prefixes).alias("kind"),
        text.masked("secret").alias("masked"), text.masked_short("secret").alias("masked_short"),
    )


def credential_counts(docs: DataFrame, rule=KEY_PATTERN, prefixes=text.KEY_PREFIXES) -> DataFrame:
    """Findings and documents per repository and owner; each document is folded to its kinds before the shuffle."""
    kinds = F.transform(_findings(*rule), lambda s: text.key_kind(s, prefixes))
    per_doc = docs.select("repo", kinds.alias("kinds")).select(
        "repo", F.explode(F.array_distinct("kinds")).alias("kind"), "kinds"
    )
    n = F.size(F.filter("kinds", lambda k: k == F.col("kind")))
    return per_doc.select("repo", "kind", n.alias("n")).groupBy("repo", "kind").agg(
        F.sum("n").alias("findings"), F.count(F.lit(1)).alias("docs")
    )
