"""Shapes of the physical plans that the jobs rely on at scale."""

import re

import pytest

from gitgauge.operators import history
from gitgauge.plans.catalog import VIEW_QUERIES, queries


PLANS = {}


def plan(spark, sf_dir, name):
    if name not in PLANS:
        PLANS[name] = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return PLANS[name]


BATCH = [n for n in VIEW_QUERIES if not n.startswith("stream_")]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_and_no_cross_joins(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for node in ("EvalPython", "InPandas", "InArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


@pytest.mark.parametrize("name", BATCH)
def test_windows_are_cut_before_the_shuffle(spark, sf_dir, name):
    """No window ranks a whole group: each one sits on a group limit."""
    text = plan(spark, sf_dir, name)
    windows = len(re.findall(r"Window \[", text))
    assert windows == len(re.findall(r"WindowGroupLimit .*Final", text))


def test_ranking_reads_path_columns_only(spark, sf_dir):
    text = plan(spark, sf_dir, "adaptive_top_n")
    assert "text:string" not in text and "n_chars" in text


def test_big_sides_are_not_shuffled_when_the_other_is_proven_small(spark, sf_dir):
    text = plan(spark, sf_dir, "batch_summarize")
    assert re.search(r"BroadcastHashJoin \[repo#\d+, path#\d+\]", text)
    text = plan(spark, sf_dir, "hot_files")
    assert re.search(r"BroadcastHashJoin \[commit_id#\d+L\]", text) and "SortMergeJoin" not in text


def test_texts_are_not_dealt_by_repository(spark, sf_dir):
    """The whole build keeps the texts of repositories that are due where they are, however large the tables are."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = queries()["build_context"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[repo#\d+\], \[repo#\d+\], LeftSemi", text)
    assert re.search(r"BroadcastHashJoin \[repo#\d+\], \[repo#\d+\], LeftSemi", text)


def test_single_column_queries_read_single_columns(spark, sf_dir):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, sf_dir, "token_estimate")) == ["text:string,lang:string"]


def test_large_limits_are_cut_before_the_shuffle_too(frame):
    df = frame("repo string, kind string, seq bigint, line string", ("r", "staged", 1, "x"))
    text = history.diff_text(df, 8000)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"WindowGroupLimit .*Final", text)) == 2
