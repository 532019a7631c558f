"""Shapes the operators need, derived row by row from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.history import last_n_commits

PATH_SHAPES = [
    ("src/services/AuthService", ".ts"), ("src/m", "/index.ts"), ("m", "/package.json"), ("m", "/README.md"),
    ("src/lib/util", ".py"), ("src/lib/__tests__/util", ".test.ts"), ("jest", ".config.js"), ("docs/guide", ".md"),
    ("a/b/c/d/e/f/contracts/Token", ".sol"), ("src/components/Button", ".tsx"), ("src/orders/order", ".controller.ts"),
    (".git/objects/x", ".json"), ("src/latest/view", ".js"), ("pkg", "/alphabet.go"), ("hooks/post", ".ts"),
    ("Makefile", ""),
]


class Tables:
    """Tables of one scale factor, and the views made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        """Corpus of files; sixteen path shapes cover every score term, ignored folders and odd extensions."""
        heads, tails = (F.array(*[F.lit(x) for x in part]) for part in zip(*PATH_SHAPES))
        shape = (F.col("doc_id") % len(PATH_SHAPES) + 1).cast("int")
        return self.table("documents").select(
            F.col("doc_id").alias("file_id"), F.col("lang").alias("repo"),
            F.concat(F.element_at(heads, shape), F.col("doc_id").cast("string"), F.element_at(tails, shape)).alias("path"),
            F.col("text").alias("content"), F.col("n_chars").alias("size"),
        )

    def code_files(self) -> DataFrame:
        """``files`` whose texts begin with imports of files some ids on, of files of other shapes, and of packages."""
        d, at = F.col("file_id"), F.col("file_id") % len(PATH_SHAPES)

        def code(*parts):
            return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

        imports = (
            F.when(at == 0, code("import a from '../m", d + 1, "'\nimport { b } from \"../lib/util", d + 4, "\"\nimport express from 'express'\n",
                                 "export * from './AuthService", d + 16, ".js'\nimport type { C } from '@/components/Button", d + 9, "'\n"))
            .when(at == 4, code("from . import util", d + 16, ", util", d + 48, " as u\nimport os, src.lib.util", d + 32, " as far\nfrom numpy.linalg import norm\n"))
            .when(at == 9, code("const x = require('@scope/kit/sub')\nconst y = import('./Button", d + 16, "')\nimport 'node:fs'\n"))
            .when(at == 13, code("package p\nimport (\n\t\"fmt\"\n\talias \"github.com/org/mod/pkg\"\n)\nimport \"strings\"\n"))
            .otherwise(""))
        return self.files().select("repo", "path", F.concat(imports, F.coalesce("content", F.lit(""))).alias("content"))

    def docs_corpus(self) -> DataFrame:
        return self.table("documents").select("doc_id", F.col("lang").alias("repo"), F.col("text").alias("content"))

    def file_heads(self) -> DataFrame:
        """Head commit of each repository of ``files``: its newest document."""
        return self.table("documents").groupBy(F.col("lang").alias("repo")).agg(F.max("doc_id").alias("head_hash"))

    def commits(self) -> DataFrame:
        o, c = self.table("orders"), self.table("customer").select("c_custkey", "c_nationkey")
        day = F.date_format("o_orderdate", "dd")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("commit_id"), F.col("c_nationkey").alias("repo"), F.col("o_orderdate").alias("ts"),
            F.col("o_orderstatus").alias("branch"), F.col("o_orderpriority").alias("message"),
            F.lpad(day, 7, "0").alias("short_hash"),
        )

    def repos(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("repo"))

    def touch_rows(self, *extra) -> DataFrame:
        """(commit_id, path, ...) of every line item, fine paths."""
        return self._touched(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/")), *extra)

    def _touched(self, folder, *extra) -> DataFrame:
        li, p = self.table("lineitem"), self.table("part")
        end = (
            F.when(F.col("p_brand").endswith("1"), ".md").when(F.col("p_brand").endswith("2"), ".py").otherwise(".ts")
        )
        path = F.concat(folder, F.replace("p_brand", F.lit("#"), F.lit("_")), end)
        return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("commit_id"), path.alias("path"), *extra)

    def touches(self) -> DataFrame:
        return self.touch_rows().distinct()

    def coarse_rows(self) -> DataFrame:
        """(commit_id, path) of every line item with 25 paths, so that some are changed again and again."""
        return self._touched(F.lit("src/"))

    def run_log(self) -> DataFrame:
        ts = F.col("ts")
        stamp = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
        mark = F.concat(F.lit("Git: "), F.lpad(F.date_format(ts, "dd"), 7, "0"))
        secs = F.concat((F.col("event_id") % 60).cast("string"), F.lit("s"))
        kind, bar = F.col("event_type"), F.lit(" | ")
        line = (
            F.when(kind == "signup", F.concat(stamp, bar, mark, F.lit(" | STARTED")))
            .when(kind == "purchase", F.concat(stamp, bar, mark, F.lit(" | SUCCESS | "), secs))
            .when(kind == "error", F.concat(stamp, bar, mark, F.lit(" | FAILED | "), secs))
            .when(kind == "click", F.concat(stamp, bar, mark, F.lit(" | DOOM | detected")))
            .when(F.col("event_id") % 2 == 0, F.concat(F.lit("DOOM_SHOWN | "), mark))
            .otherwise(F.lit("garbled"))
        )
        return self.table("events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("repo"), "ts",
                                           line.alias("line"))

    def summary_cache(self) -> DataFrame:
        """Stored summaries of the labelled files; null where nothing could be read."""
        good = ~((F.col("quality") == 0) & (F.col("toxic") == 1))
        told = F.when(good, F.concat(F.lit("summary "), F.col("quality").cast("string"), F.col("toxic").cast("string")))
        labels = self.table("labels").select(F.col("doc_id").alias("file_id"), told.alias("summary"))
        return self.files().join(labels, "file_id").select("repo", "path", "summary")

    def file_docs(self) -> DataFrame:
        """Stored documents of the repositories of ``files``: the French one is complete at its head, the Spanish one of an
        old commit, the others have none."""
        kinds = F.array(F.lit("context"), F.lit("dependency-map"), F.lit("patterns"))
        commit = F.col("head_hash") - F.when(F.col("repo") == "es", 1).otherwise(0)
        return self.file_heads().filter(F.col("repo").isin("fr", "es")).select(
            "repo", F.explode(kinds).alias("doc_type"), F.lit("stored").alias("content"), commit.alias("commit_hash"))

    def changed(self) -> DataFrame:
        """Files that changed since the cached commit: those of one source."""
        d = self.table("documents").filter(F.col("source") == "src7").select(F.col("doc_id").alias("file_id"))
        return self.files().join(d, "file_id").select("repo", "path")

    def docs(self, ranks=(1, 2, 3)) -> DataFrame:
        """Stored documents of the newest commits; which ones depends on the commit's message."""
        types = (
            F.when(F.col("rank") == 2, F.array(F.lit("context"), F.lit("patterns")))
            .when(F.col("rank") == 3, F.array(F.lit("context")))
            .when(F.col("message").isin("1-URGENT", "5-LOW"),
                  F.array(F.lit("context"), F.lit("dependency-map"), F.lit("patterns")))
            .when(F.col("message") == "2-HIGH", F.array(F.lit("context"), F.lit("dependency-map")))
            .when(F.col("message") == "3-MEDIUM", F.array(F.lit("context")))
        )
        rows = last_n_commits(self.commits(), 3).filter(F.col("rank").isin(*ranks)).select(
            "repo", "commit_id", "ts", F.explode(types).alias("doc_type"))
        content = F.concat(F.lit("doc "), "doc_type", F.lit(" of repo "), F.col("repo").cast("string"), F.lit(" at "),
                           F.col("commit_id").cast("string"))
        return rows.select(
            "repo", "doc_type", content.alias("content"), F.col("commit_id").alias("commit_hash"),
            F.col("ts").alias("saved_at"),
            F.when(F.col("doc_type") == "context", 4096).otherwise(4000).cast("bigint").alias("token_count"),
        )

    def settings(self) -> DataFrame:
        e = F.col("event_id")
        line = (
            F.when(e % 11 == 0, F.concat(F.lit("# "), "event_type")).when(e % 13 == 0, F.lit("not a setting"))
            .otherwise(F.concat("event_type", F.lit('="'), (e % 100).cast("string"), F.lit('"')))
        )
        return self.table("events").select(F.col("user_id").alias("repo"), (e % 5).alias("priority"), e.alias("line_no"),
                                           line.alias("line"))

    def agent_files(self) -> DataFrame:
        """Agent files with a block in the middle, with a start mark only, without a block, or only a shebang."""
        lang = F.col("lang")
        content = (
            F.when(lang == "en", F.concat("text", F.lit("\n<!-- S -->\nold\n<!-- E -->\n\ntail "), "text"))
            .when(lang == "es", F.concat("text", F.lit("\n<!-- S -->old, no end marker")))
            .when(F.col("n_chars") < 500, F.lit("#!/bin/sh\n")).otherwise(F.col("text"))
        )
        return self.table("documents").select(
            F.col("doc_id").alias("repo"), F.lit("CLAUDE.md").alias("path"), content.alias("content"))

    def blocks(self) -> DataFrame:
        """A block for the file of every document, and one for a file that is absent."""
        block = F.concat(F.lit("<!-- S -->Git: "), F.col("doc_id").cast("string"), F.lit("<!-- E -->"))
        return self.table("documents").select(
            F.col("doc_id").alias("repo"), F.explode(F.array(F.lit("CLAUDE.md"), F.lit("AGENTS.md"))).alias("path"), block.alias("block"))

    def page_links(self) -> DataFrame:
        """(source, content) of the pages."""
        return self.table("pages").select(F.col("page_id").alias("source"), F.col("html").alias("content"))

    def page_sections(self) -> DataFrame:
        """Inventory of link targets: the first page of each section, keyed by the first segment of its address."""
        section = F.regexp_extract("url", "^https?://[^/]*(/[^/?#]*)", 1)
        return self.table("pages").groupBy(section.alias("target_key")).agg(F.min("page_id").alias("target_id"))

    def nation_summaries(self) -> DataFrame:
        """Summarised files of the repositories of ``commits``: one per customer of the nation."""
        return self.table("customer").select(F.col("c_nationkey").alias("repo"), F.col("c_name").alias("path"))

    def nation_agent_files(self) -> DataFrame:
        """Agent files of the same repositories; every region has other ones."""
        region, name = F.col("n_regionkey"), F.col("n_name")
        marked = F.concat(name, F.lit(" <!-- S -->x<!-- E -->"))
        found = F.array(
            F.struct(F.lit("CLAUDE.md").alias("path"), F.when(region < 3, marked).when(region == 3, name).alias("content")),
            F.struct(F.lit(".cursorrules").alias("path"), F.when(region > 1, marked).alias("content")),
            F.struct(F.lit(".windsurfrules").alias("path"), F.when(region == 0, name).alias("content")),
        )
        rows = self.table("nation").select(F.col("n_nationkey").alias("repo"), F.explode(found).alias("f"))
        return rows.select("repo", "f.path", "f.content").filter(F.col("content").isNotNull())

    def working_tree(self) -> DataFrame:
        """(repo, kind, seq, path, line): the line items of each head commit as lines of a diff."""
        head = last_n_commits(self.commits(), 1).select("repo", "commit_id")
        kind = F.when(F.col("l_returnflag") == "A", "staged").when(F.col("l_returnflag") == "N", "unstaged").otherwise("committed")
        rows = self.touch_rows(F.col("l_linenumber").cast("bigint").alias("seq"), kind.alias("kind"), "p_name")
        line = F.concat(F.lit("+++ b/"), "path", F.lit(" "), "p_name")
        return head.join(rows, "commit_id").select("repo", "kind", "seq", "path", line.alias("line"))
