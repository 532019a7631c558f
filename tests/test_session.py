from types import SimpleNamespace

import pytest

from gitgauge.session import shared_dir, written


def fake(master, checkpoint=None, default=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, other: checkpoint),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: default))


def test_the_folder_of_the_cluster_is_used():
    assert shared_dir(fake("yarn", "hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert shared_dir(fake("yarn", None, "hdfs:///set"), "x").startswith("hdfs:///set/x-")


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        shared_dir(fake("spark://host:7077"), "x")
    assert "gitgauge-" in shared_dir(fake("local[2]"), "x")


def test_written_frames_are_computed_once(frame):
    df = frame("a int", (1,), (2,))
    again = written(df, "t")
    assert again.schema == df.schema and "ExistingRDD" not in again._jdf.queryExecution().executedPlan().toString()
    assert again.count() == 2
