from pathlib import Path
from types import SimpleNamespace

import pytest

from quernstone.plans import durable


def test_steps_go_to_the_shared_folder_and_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(durable, "shared_dir", lambda s: f"file://{tmp_path}")
    df = durable.written(spark.range(10).withColumnRenamed("id", "n"))
    assert df.count() == 10 and df.schema["n"].dataType.simpleString() == "bigint"
    assert len(list(Path(tmp_path).glob("step-*"))) == 1
    assert durable.remove_steps(spark) >= 1 and not list(Path(tmp_path).glob("step-*"))


def test_the_named_folder_or_one_of_our_own(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert durable.shared_dir(spark) == (named or durable.shared_dir(spark))
    assert named or Path(durable.shared_dir(spark)).is_dir()


def test_spread_adds_partitions_only_where_there_are_few(spark):
    assert durable.spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert durable.spread(spark.range(0, 10, 1, 4)).rdd.getNumPartitions() == 4


def test_a_cluster_must_name_a_shared_folder():
    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: named), sparkContext=SimpleNamespace(master=master), _jsparkSession=object())

    with pytest.raises(ValueError, match="checkpoint.dir"):
        durable.shared_dir(session("spark://host:7077", None))
    with pytest.raises(ValueError, match="checkpoint.dir"):
        durable.shared_dir(session("local-cluster[3,2,1000]", None))
    assert durable.shared_dir(session("spark://host:7077", "hdfs:///steps")) == "hdfs:///steps"
