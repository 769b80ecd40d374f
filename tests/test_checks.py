import pytest

from tradewind.operators import CheckFailed, require_clean, run_checks


def test_counts_and_failure(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (2, None), (None, "y"), (None, "z")], "k int, v string")
    report = run_checks({"t": df}, {"t": {"not_null": ["k", "v"], "unique": ["k"]}})
    assert {r["check"]: r["failures"] for r in report.collect()} == {
        "not_null:t.k": 2,
        "not_null:t.v": 2,
        "unique:t.k": 1,
    }
    with pytest.raises(CheckFailed, match="unique:t.k=1"):
        require_clean(report)


def test_clean_and_empty(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    rules = {"t": {"not_null": ["k"], "unique": ["k"]}}
    require_clean(run_checks({"t": df}, rules))
    require_clean(run_checks({"t": df.limit(0)}, rules))
