"""Intermediate tables, and steps run side by side."""

import os
import threading
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from tradewind.session import configure, discard, materialize, scratch, shared_dir, shuffles_removed, side_by_side


def folder(df):
    return df.written_path.removeprefix("file:")


def test_discarded_table_is_gone_and_what_was_made_from_it_stays(spark):
    first = materialize(spark.range(10), "first")
    second = materialize(first.filter("id > 4"), "second")
    assert os.path.isdir(folder(first))
    discard(first)
    assert not os.path.exists(folder(first))
    assert second.count() == 5


class Session:
    """As much of a session as `shared_dir` reads."""

    def __init__(self, master, **settings):
        self.sparkContext = SimpleNamespace(master=master, applicationId="app-1")
        self.settings = {key.replace("_", "."): value for key, value in settings.items()}
        self.conf = SimpleNamespace(get=lambda key, default=None: self.settings.get(key, default), set=self.settings.__setitem__)


def test_shared_folder():
    named = Session("spark://host:1", spark_checkpoint_dir="hdfs:///shared/", spark_sql_warehouse_dir="file:/w")
    assert shared_dir(named) == "hdfs:///shared"
    local = Session("local[2]", spark_sql_warehouse_dir="file:/nowhere/warehouse")
    assert shared_dir(local) == "file:/nowhere/warehouse/tradewind-app-1" == shared_dir(local)
    with pytest.raises(RuntimeError):
        shared_dir(Session("spark://host:1", spark_sql_warehouse_dir="file:/w"))


def test_scratch_removes_the_tables_of_a_job_and_of_its_steps(spark):
    outside = materialize(spark.range(3), "outside")
    with scratch():
        inside = materialize(spark.range(4), "inside")
        steps = side_by_side(spark, "steps", [lambda n=n: materialize(spark.range(n), "step") for n in (1, 2, 3)])
        with scratch():
            deeper = materialize(spark.range(5), "deeper")
        assert not os.path.exists(folder(deeper)) and [s.count() for s in steps] == [1, 2, 3]
    assert not any(os.path.exists(folder(t)) for t in (inside, *steps))
    assert outside.count() == 3
    with pytest.raises(ZeroDivisionError), scratch():
        broken = materialize(spark.range(4), "broken")
        1 / 0
    assert not os.path.exists(folder(broken))


def test_shuffles_go_with_their_query(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    shuffled = lambda: {f for d in folders for f in Path(d.getPath()).rglob("shuffle_*.data")}
    setting, held = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", shuffled()
    before = spark.conf.get(setting, None)
    counts = spark.range(100_000).selectExpr("id % 9 k").groupBy("k").count()
    with shuffles_removed(spark):
        written = materialize(counts, "counts")
        with shuffles_removed(spark):
            assert counts.count() == 9
        again = materialize(counts, "counts")
    assert spark.conf.get(setting, None) == before
    until = time.time() + 20
    while shuffled() - held and time.time() < until:  # Spark removes them a moment later
        time.sleep(0.1)
    assert not shuffled() - held
    assert sorted(written.collect()) == sorted(again.collect()) == sorted(counts.collect())


def test_steps_run_side_by_side_in_groups_of_their_own(spark):
    together = threading.Barrier(3, timeout=60)
    context = spark.sparkContext

    def step(n):
        together.wait()  # passes only if three steps run at once
        return n, context.getLocalProperty("spark.jobGroup.id"), spark.range(n).count()

    found = side_by_side(spark, "test", [lambda n=n: step(n) for n in range(3)], at_once=3)
    assert [(n, count) for n, _, count in found] == [(0, 0), (1, 1), (2, 2)]
    assert len({group for _, group, _ in found}) == 3
    assert side_by_side(spark, "none", []) == []


def test_a_failed_step_stops_the_others(spark):
    begun = threading.Event()

    def slow():
        begun.set()
        return spark.range(1_000_000_000_000).selectExpr("sum(hash(id))").collect()

    def fails():
        begun.wait(60)
        raise LookupError("no")

    started = []
    with pytest.raises(LookupError):
        side_by_side(spark, "test", [slow, fails, lambda: started.append(1)], at_once=2)
    assert spark.range(3).count() == 3


def test_merged_partitions_stay_small_and_the_width_follows_the_input(spark):
    width, both = "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = {key: spark.conf.get(key) for key in (width, both)}
    try:
        configure(spark, 6 * 2**30)
        assert int(spark.conf.get(width)) == 384
        spark.conf.set(both, "false")  # as with fewer cores than the data needs tasks
        keys = spark.range(4_000_000, numPartitions=8).selectExpr("xxhash64(id) key").distinct()
        tasks = keys.rdd.getNumPartitions()
        assert 4 <= tasks < 384  # 32 MB of keys, merged, but not into one task
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
