import pytest

from tradewind.sources import Lakehouse
from tradewind.streaming import ingest_stream, open_csv_stream

COLUMNS = ["id", "text", "seen"]


@pytest.fixture
def arrivals(tmp_path):
    (tmp_path / "in").mkdir()

    def deliver(name, *lines):
        (tmp_path / "in" / name).write_text("\n".join(["id,text,seen", *lines]) + "\n")

    return deliver


def run(spark, tmp_path, **options):
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    stream = open_csv_stream(spark, f"file:{tmp_path}/in", COLUMNS, free_text=True, files_per_batch=1)
    ingest_stream(stream, lake, "reviews", ["id"], f"file:{tmp_path}/checkpoint", **options).awaitTermination()
    return lake


def held(lake):
    return sorted((r["id"], r["text"]) for r in lake.read("bronze", "reviews").collect())


def test_rerun_adds_nothing_and_new_files_add_unseen_keys(spark, tmp_path, arrivals):
    arrivals("a.csv", '1,"two\nlines",x', "2,b,x")
    lake = run(spark, tmp_path)
    assert held(lake) == [("1", "two\nlines"), ("2", "b")]
    assert held(run(spark, tmp_path)) == held(lake)
    arrivals("b.csv", "2,changed,x", "3,c,x")
    assert held(run(spark, tmp_path)) == [("1", "two\nlines"), ("2", "b"), ("3", "c")]


def test_replayed_files_add_nothing(spark, tmp_path, arrivals):
    arrivals("a.csv", "1,a,x")
    lake = run(spark, tmp_path)
    arrivals("copy of a.csv", "1,a,x")
    assert held(run(spark, tmp_path)) == held(lake)


def test_copies_within_the_delay_are_dropped_in_the_stream(spark, tmp_path, arrivals):
    arrivals("a.csv", "1,a,2018-01-01 00:00:00", "1,a again,2018-01-01 00:00:05", "2,b,2018-01-01 00:00:06")
    lake = run(spark, tmp_path, event_time="seen", max_delay="1 hour")
    assert sorted(r["id"] for r in lake.read("bronze", "reviews").collect()) == ["1", "2"]


def test_a_row_later_than_the_watermark_is_dropped_and_one_within_comes_in(spark, tmp_path, arrivals):
    arrivals("a.csv", "1,a,2018-01-10 00:00:00", "1,a,2018-01-10 00:00:00")
    run(spark, tmp_path, event_time="seen", max_delay="2 days")
    arrivals("b.csv", "2,within,2018-01-08 00:00:01", "3,too late,2018-01-08 00:00:00", "1,copy,2018-01-10 00:00:00", "4,new,2018-01-11 00:00:00")
    lake = run(spark, tmp_path, event_time="seen", max_delay="2 days")
    assert held(lake) == [("1", "a"), ("2", "within"), ("4", "new")]
    # Without an event time no row is too late: the key decides alone.
    late = Lakehouse(spark, f"file:{tmp_path}/all")
    stream = open_csv_stream(spark, f"file:{tmp_path}/in", COLUMNS, files_per_batch=1)
    ingest_stream(stream, late, "reviews", ["id"], f"file:{tmp_path}/all-checkpoint").awaitTermination()
    assert {i for i, _ in held(late)} == {"1", "2", "3", "4"}
