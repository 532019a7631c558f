"""Managed blocks in files ``(repo, path, content)``: upsert, removal, appended references."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .requests import TARGETS

START, END = "<!-- gitgauge:begin -->", "<!-- gitgauge:end -->"
# --- fixed values -----------------------------------------------------------------------------------
LEGACY_CURSOR = ".cursor/rules"
SHEBANGS = ["", "#!/bin/sh", "#!/usr/bin/env sh"]
SPEC_RULE = "---\n\n"
SPEC_CALL = "**Active Spec:** Read `"
SPEC_PURPOSE = " before implementing this feature.\n"
# --- end of fixed values ----------------------------------------------------------------------------


def agent_paths(files: DataFrame, targets=TARGETS) -> DataFrame:
    """(repo, target, path) of the agents a repository is set up for, from its files including hidden ones.

    One agent has a new and an old place for its file; the old one is used only where there is no new one.
    """
    places = [(name, path, 0) for name, path, _ in targets] + [("cursor", LEGACY_CURSOR, 1)]
    known = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(p).alias("path"), F.lit(o).alias("age")) for t, p, o in places])
    hit = F.filter(known, lambda k: k.path == F.col("path"))
    found = files.select("repo", F.explode(hit).alias("k"))
    return found.groupBy("repo", F.col("k.target").alias("target")).agg(
        F.min_by("k.path", "k.age").alias("path"))


def instruction_blocks(agents: DataFrame, heads: DataFrame, today: str, start=START, end=END) -> DataFrame:
    """Block (with its marks) for each agent file: where the stored context lies and which commit it belongs to."""
    title = F.when(F.col("target") == "claude-code", "## Repository context").otherwise("# Repository context")
    commit = F.substring(F.col("head_hash").cast("string"), 1, 8)
    body = F.concat_ws(
        "\n", F.lit(start), title, F.lit(""),
        F.lit("Load the repository context at the start of every session: call `load_context`, or read"),
        *[F.lit(f"- .gitgauge/{name}.md") for name in ("context", "patterns", "dependency-map")],
        F.lit(""), F.concat(F.lit(f"Last updated: {today} | Git: "), commit), F.lit(end),
    )
    return agents.join(heads, "repo").select("repo", "path", body.alias("block"))


def managed_block_upsert(files: DataFrame, blocks: DataFrame, start=START, end=END) -> DataFrame:
    """Puts each block (with its marks) into its file and says what was done.

    No file: created. Start mark present: text up to the end mark behind it is replaced, up to the end of the text
    if that mark is missing. Else: appended after two newlines. Files without a block stay as they are.
    """
    joined = files.join(blocks, ["repo", "path"], "full_outer")
    before = F.substring_index("content", start, 1)
    rest = F.substr("content", F.length(before) + len(start) + 1)
    tail_at = F.instr(rest, end)
    tail = F.when(tail_at > 0, F.substr(rest, tail_at + len(end))).otherwise(F.lit(""))
    has_mark = F.contains("content", F.lit(start))
    content = (
        F.when(F.col("block").isNull(), F.col("content"))
        .when(F.col("content").isNull(), F.concat("block", F.lit("\n")))
        .when(has_mark, F.concat(before, "block", tail))
        .otherwise(F.concat("content", F.lit("\n\n"), "block", F.lit("\n")))
    )
    action = (
        F.when(F.col("block").isNull(), "kept").when(F.col("content").isNull(), "created").otherwise("updated")
    )
    return joined.select("repo", "path", action.alias("action"), content.alias("content"))


def managed_block_remove(files: DataFrame, mark=START, keep_word="husky") -> DataFrame:
    """Takes the managed section out of each file.

    A file with the mark and without ``keep_word`` is deleted. Otherwise lines go from a marked line through the next
    blank line, and a file that is then empty or only a shebang is deleted.

    Each line is written as one letter, a regex over the letters finds the sections, and the letters are laid beside the
    lines again; so a long file takes time in proportion to its lines.
    """
    kind = lambda line: F.when(F.contains(line, F.lit(mark)), "m").when(F.length(text.trimmed(line)) == 0, "b").otherwise("x")
    letters = F.array_join(F.transform("lines", kind), "")
    # a marked line, or a line that goes on from the one before unless that was blank
    dropped = F.split(F.regexp_replace(letters, r"m|(?<=[^b])\G(?!\A)[mxb]", "-"), "")
    left = F.zip_with("lines", dropped, lambda line, letter: F.when(letter != "-", line))
    cut = files.withColumn("lines", text.lines_of("content")).withColumn("left", text.trimmed(F.array_join(left, "\n")))
    whole = F.contains("content", F.lit(mark)) & ~F.contains("content", F.lit(keep_word))
    gone = whole | F.col("left").isin(SHEBANGS)
    return cut.select(
        "repo", "path", F.when(gone, "deleted").otherwise("rewritten").alias("action"),
        F.when(~gone, F.concat("left", F.lit("\n"))).alias("content"),
    )


def spec_reference(slug):
    """(needle, text) of the line that points an agent to a spec."""
    needle = F.concat(F.lit(SPEC_CALL + ".gitgauge/specs/"), slug, F.lit(".md`"))
    return needle, F.concat(F.lit(SPEC_RULE), needle, F.lit(SPEC_PURPOSE))


def reference_append(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Appends the spec references ``refs(repo, path, slug)`` that a file does not hold yet, in slug order.

    The separator depends on a trailing newline; a missing file is skipped. References are gathered per file because
    they all end up in its one text.
    """
    needle, line = spec_reference(F.col("slug"))
    wanted = refs.select("repo", "path", F.struct("slug", needle.alias("needle"), line.alias("line")).alias("ref"))
    wanted = wanted.groupBy("repo", "path").agg(F.sort_array(F.collect_set("ref")).alias("refs"))

    def append(content, ref):
        gap = F.when(content.endswith("\n"), F.lit("\n")).otherwise(F.lit("\n\n"))
        return F.when(F.contains(content, ref.needle), content).otherwise(F.concat(content, gap, ref.line))

    changed = F.aggregate("refs", F.col("content"), append)
    return files.join(wanted, ["repo", "path"]).select(
        "repo", "path", F.when(changed == F.col("content"), "kept").otherwise("updated").alias("action"),
        changed.alias("content"),
    )
