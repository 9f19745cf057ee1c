"""Shared folder of the session, and replies with white space around them."""

from types import SimpleNamespace

import pytest

from clipweave.operators.highlights import parse_highlight
from clipweave.session import ensure_checkpoint_dir


def session(master, configured=None, current=None):
    held = [current]
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: held[0], setCheckpointDir=lambda d: held.__setitem__(0, d))
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: configured or default))


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "yarn", "spark://host:7077"])
def test_a_cluster_must_name_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session(master))
    assert ensure_checkpoint_dir(session(master, "hdfs:///shared")) == "hdfs:///shared"
    assert ensure_checkpoint_dir(session(master, "hdfs:///other", "hdfs:///used")) == "hdfs:///used"


def test_a_local_master_makes_its_own(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    assert ensure_checkpoint_dir(session("local[4]")).startswith(str(tmp_path))


def test_replies_are_stripped_of_any_white_space(spark):
    object_ = '{"start": "1", "content": "c", "end": "5"}'
    rows = [(1, f"\n[{object_}]\t"), (2, f"\t{object_}\u00a0\n"), (3, "\n"), (4, " \t ")]
    df = spark.createDataFrame(rows, "video_id long, response string")
    assert {r["video_id"]: r["status"] for r in parse_highlight(df).collect()} == {1: "ok", 2: "ok", 3: "empty", 4: "empty"}
