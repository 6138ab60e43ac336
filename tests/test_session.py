"""Where intermediates go."""

import os
import re

import pytest

from cohortloom import session
from cohortloom.operators import concepts
from cohortloom.plans import registry


def test_frames_are_written_to_the_named_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    frame = session.materialize(spark.range(5), "five")
    (new,) = set(os.listdir(folder)) - before
    assert new.startswith("five-") and frame.count() == 5


def test_scratch_removes_what_was_written_inside(spark):
    with session.scratch(spark) as folder:
        frame = session.materialize(spark.range(5), "five")
        assert frame.count() == 5 and os.listdir(folder)
    assert not os.path.exists(folder)
    session.materialize(spark.range(1), "after")


def test_shuffle_cleanup_is_on_for_the_write_only(spark):
    before = spark.conf.get(session.SHUFFLE_CLEANUP)
    assert session.materialize(spark.range(100).repartition(3, "id"), "dealt").count() == 100
    assert spark.conf.get(session.SHUFFLE_CLEANUP) == before


def test_shuffles_follow_the_input_and_not_a_fixed_number(spark, tmp_path, monkeypatch):
    """The join of lines and orders and the count of the days had the session's partitions at any size of the tables."""
    spark.range(300).selectExpr("id AS o_orderkey", "id % 2 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1, 51).selectExpr("id AS p_partkey", "int(id) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    lines = "id AS l_orderkey", "id % 50 + 1 AS l_partkey", "date_add(DATE '1995-01-01', int(id)) AS l_shipdate"
    spark.range(300).selectExpr(*lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    stored = sum(p.stat().st_size for name in ("lineitem", "orders") for p in (tmp_path / f"{name}.parquet").glob("*.parquet"))
    monkeypatch.setattr(session, "INPUT_TO_A_PARTITION", 100, raising=False)
    names = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in names}
    try:
        spark.conf.set(names[2], "-1")
        days = concepts.event_days(registry.Inputs(spark, str(tmp_path)).coded)
        plan = days._jdf.queryExecution().executedPlan().toString()
        found = {int(n) for n in re.findall(r"hashpartitioning\([^()]*, (\d+)\)", plan)}
        assert len(found) == 1 and found.pop() >= stored // 100 > 8
        assert days.count() == 300
        spark.conf.set(names[0], "100000")
        spark.conf.set(names[1], "5m")
        registry.Inputs(spark, str(tmp_path))
        assert [spark.conf.get(name) for name in names[:2]] == ["100000", "5m"]  # what the session names itself stays
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {}


def test_no_folder_is_chosen_for_a_cluster():
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        lone = Session(master)
        session.use_local_folder(lone)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(lone)
    assert session.shared_folder(Session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    single = session.use_local_folder(Session("local[4]"))
    assert os.path.isdir(session.shared_folder(single))
