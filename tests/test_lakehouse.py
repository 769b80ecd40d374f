import gzip

import pytest
from pyspark.sql import functions as F

from tradewind.operators import DuplicateKeys
from tradewind.sources import Lakehouse, as_variant, project, project_variant, query, read_csv


@pytest.fixture
def lake(spark, tmp_path):
    return Lakehouse(spark, f"file:{tmp_path}/lake")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def frame(spark, data, schema="k int, v string"):
    return spark.createDataFrame(data, schema)


def test_csv_with_line_breaks_and_doubled_quotes(spark, tmp_path):
    path = tmp_path / "reviews.csv"
    path.write_text('"id","text","note"\n"1","two\nlines","a"\n"2","said ""hi, all""","007"\n"3",,\n')
    got = read_csv(spark, f"file:{path}", free_text=True)
    assert got.dtypes == [("id", "string"), ("text", "string"), ("note", "string")]
    assert rows(got) == [("1", "two\nlines", "a"), ("2", 'said "hi, all"', "007"), ("3", None, None)]


def test_missing_table(lake):
    assert not lake.exists("silver", "t")
    with pytest.raises(FileNotFoundError):
        lake.read("silver", "t")
    assert lake.read_or_empty("silver", "t", "k int").count() == 0


def test_replace_reads_its_own_table_and_counts_rows(spark, lake):
    lake.replace("silver", "t", frame(spark, [(1, "a"), (2, "b")]))
    assert lake.row_counts == {"silver.t": 2}
    doubled = lake.read("silver", "t").withColumn("k", F.col("k") * 2)
    assert rows(lake.replace("silver", "t", doubled)) == [(2, "a"), (4, "b")]
    lake.replace("silver", "t", lake.read("silver", "t").select(F.col("k").alias("other")))
    assert lake.read("silver", "t").columns == ["other"]
    assert lake._versions("silver", "t") == [2, 3]


def test_half_written_version_is_ignored(spark, lake):
    lake.replace("silver", "t", frame(spark, [(1, "a")]))
    torn = lake._version_path("silver", "t", 2)
    frame(spark, [(9, "torn")]).write.parquet(torn)
    assert rows(lake.read("silver", "t")) == [(1, "a")]
    assert rows(lake.replace("silver", "t", frame(spark, [(3, "c")]))) == [(3, "c")]


def test_empty_tables_keep_their_columns(spark, lake):
    none = frame(spark, [])
    lake.append("bronze", "t", none)
    assert lake.read("bronze", "t").dtypes == [("k", "int"), ("v", "string")]
    assert lake.last_batch("bronze", "t") == 0
    assert lake.insert_new("bronze", "t", frame(spark, [(1, "a")]), ["k"]) == 1
    assert rows(lake.read("bronze", "t")) == [(1, "a")]
    lake.merge("mart", "t", none, ["k"], partition_by=["v"])
    lake.merge("mart", "t", frame(spark, [(1, "007")]), ["k"], partition_by=["v"])
    assert rows(lake.read("mart", "t")) == [(1, "007")]


def test_append_batches(spark, lake):
    assert lake.append("bronze", "t", frame(spark, [(1, "a")])) == 1
    assert lake.insert_new("bronze", "t", frame(spark, [(1, "x"), (2, "b")]), ["k"]) == 2
    assert rows(lake.read("bronze", "t")) == [(1, "a"), (2, "b")]
    assert rows(lake.read_since("bronze", "t", 1)) == [(2, "b", 2)]
    assert lake.last_batch("bronze", "t") == 2
    assert lake._versions("bronze", "t") == [1]


def test_append_with_other_columns(spark, lake):
    lake.append("bronze", "t", frame(spark, [(1, "a")]))
    lake.append("bronze", "t", spark.createDataFrame([(2,)], "k int"))
    lake.append("bronze", "t", frame(spark, [(3, "c", 1.5)], "k int, v string, extra double"))
    got = lake.read("bronze", "t").select("k", "v", "extra")
    assert rows(got) == [(1, "a", None), (2, None, None), (3, "c", 1.5)]
    assert lake.last_batch("bronze", "t") == 3


def test_merge_creates_then_updates(spark, lake):
    lake.merge("silver", "t", frame(spark, [(1, "a"), (2, "b")]), ["k"])
    assert rows(lake.merge("silver", "t", frame(spark, [(2, "B"), (3, "C")]), ["k"])) == [
        (1, "a"),
        (2, "B"),
        (3, "C"),
    ]


def test_merge_without_a_match_appends(spark, lake):
    lake.merge("silver", "t", frame(spark, [(1, "a"), (None, "n")]), ["k"])
    got = lake.merge("silver", "t", frame(spark, [(2, "b"), (None, "m")]), ["k"])
    assert rows(got) == sorted([(1, "a"), (None, "n"), (2, "b"), (None, "m")], key=repr)
    assert lake._versions("silver", "t") == [1]
    lake.merge("silver", "t", frame(spark, [(1, "A")]), ["k"])
    assert lake._versions("silver", "t") == [1, 2] and lake.read("silver", "t").count() == 4


def test_merge_refuses_repeated_keys(spark, lake):
    with pytest.raises(DuplicateKeys):
        lake.merge("silver", "t", frame(spark, [(1, "a"), (1, "b")]), ["k"])
    assert not lake.exists("silver", "t")


PART = "k int, v string, month int"


def files(lake, month):
    fs, path = lake._fs(f"{lake.location('mart', 't')}/month={month}")
    return sorted(s.getPath().getName() for s in fs.listStatus(path))


def test_partitioned_merge_touches_matched_partitions_only(spark, lake):
    first = frame(spark, [(1, "a", 1), (2, "b", 1), (3, "c", 2), (4, "d", 3)], PART)
    lake.merge("mart", "t", first, ["k"], partition_by=["month"])
    before = {m: files(lake, m) for m in (1, 2, 3)}
    change = frame(spark, [(2, "B", 1), (5, "e", 3), (6, "f", 4)], PART)
    got = lake.merge("mart", "t", change, ["k"], partition_by=["month"])
    assert rows(got) == [(1, "a", 1), (2, "B", 1), (3, "c", 2), (4, "d", 3), (5, "e", 3), (6, "f", 4)]
    assert files(lake, 1) != before[1]
    assert files(lake, 2) == before[2]
    # Month 3 has no matched key, but belongs to the same commit as month 1.
    assert not set(before[3]) & set(files(lake, 3))
    assert lake.row_counts["mart.t"] == 5  # the rows of months 1 and 3, and month 4
    assert lake._versions("mart", "t") == [1]


def test_partitioned_merge_of_a_row_that_changes_partition(spark, lake):
    lake.merge("mart", "t", frame(spark, [(1, "a", 1), (2, "b", 2)], PART), ["k"], partition_by=["month"])
    got = lake.merge("mart", "t", frame(spark, [(1, "moved", 2)], PART), ["k"], partition_by=["month"])
    assert rows(got) == [(1, "moved", 2), (2, "b", 2)]


def test_partitioned_merge_with_null_partition_and_key(spark, lake):
    lake.merge("mart", "t", frame(spark, [(None, "a", None), (2, "b", None)], PART), ["k"], partition_by=["month"])
    change = frame(spark, [(None, "A", None), (3, "c", None)], PART)
    got = lake.merge("mart", "t", change, ["k"], null_safe=True, partition_by=["month"])
    assert rows(got) == [(2, "b", None), (3, "c", None), (None, "A", None)]


def test_partitioned_merge_with_new_and_missing_columns(spark, lake):
    lake.merge("mart", "t", frame(spark, [(1, "a", 1), (2, "b", 2)], PART), ["k"], partition_by=["month"])
    wider = frame(spark, [(1, "A", 1, 5)], PART + ", extra int")
    lake.merge("mart", "t", wider, ["k"], partition_by=["month"])
    narrow = frame(spark, [(2, 2), (3, 3)], "k int, month int")
    got = lake.merge("mart", "t", narrow, ["k"], partition_by=["month"])
    assert rows(got.select("k", "v", "month", "extra")) == [(1, "A", 1, 5), (2, "b", 2, None), (3, None, 3, None)]


def test_variant_and_typed_projection(spark):
    df = spark.createDataFrame([("1", "2018-01-02", "x")], "id string, day string, n string")
    layout = {"id": "bigint", "day": "date", "n": "int", "absent": "string"}
    got = project_variant(as_variant(df), layout).first()
    assert (got["id"], str(got["day"]), got["n"], got["absent"]) == (1, "2018-01-02", None, None)
    assert project(df, {"n": "int", "id": "double"}).first().asDict() == {"n": None, "id": 1.0}


def test_query_lower_cases_names(spark):
    got = query(spark, "SELECT k AS Key, upper(v) AS VALUE FROM {t}", t=frame(spark, [(1, "a")]))
    assert got.columns == ["key", "value"] and rows(got) == [(1, "A")]
    kept = query(spark, "SELECT K FROM {t}", keep=True, t=frame(spark, [(1, "a")]))
    assert kept.is_cached and kept.columns == ["k"]
    kept.unpersist()


def test_wider_numbers_widen_the_table_and_other_types_are_refused(spark, tmp_path):
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    lake.merge("x", "t", spark.createDataFrame([(1, 1)], "k int, v int"), ["k"])
    got = lake.merge("x", "t", spark.createDataFrame([(2, 1 << 40)], "k int, v bigint"), ["k"])
    assert sorted(r["v"] for r in got.collect()) == [1, 1 << 40]
    with pytest.raises(TypeError, match="column v"):
        lake.merge("x", "t", spark.createDataFrame([(3, "a")], "k int, v string"), ["k"])


def test_replace_groups_drops_rows_that_have_no_successor(spark, tmp_path):
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    schema = "k int, p int, v int"
    lake.replace("x", "t", spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 1), (None, 3, 1)], schema), ["p"])
    groups = spark.createDataFrame([(1,), (None,)], "k int")
    lake.replace_groups("x", "t", groups, spark.createDataFrame([(1, 1, 9)], schema), ["p"])
    assert sorted(tuple(r) for r in lake.read("x", "t").select("k", "p", "v").collect()) == [(1, 1, 9), (2, 1, 1), (3, 2, 1)]


def bucket_files(lake, table="t"):
    """Files by bucket of a stored table."""
    fs, path = lake._fs(lake.location("silver", table))
    folders = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("key_bucket=")]
    return {f.getName(): sorted(s.getPath().getName() for s in fs.listStatus(f)) for f in folders}


def test_one_changed_row_rewrites_one_bucket(spark, lake):
    lake.merge("silver", "t", spark.range(400).selectExpr("cast(id as string) k", "1 v"), ["k"], bucket_by=["k"])
    assert lake.read("silver", "t").columns == ["k", "v"]
    before = bucket_files(lake)
    assert len(before) == lake.key_buckets == 16
    got = lake.merge("silver", "t", frame(spark, [("7", 5)], "k string, v int"), ["k"])
    after = bucket_files(lake)
    assert sum(before[b] != after[b] for b in before) == 1 and lake._versions("silver", "t") == [1]
    assert lake.row_counts["silver.t"] < 60  # the rows of that bucket
    assert got.count() == 400 and rows(got.filter("v != 1")) == [("7", 5)]
    assert rows(lake.read("silver", "t").filter("k = '7'")) == [("7", 5)]


def test_merge_into_buckets_reads_only_those(spark, lake):
    lake.replace("silver", "t", spark.range(100).selectExpr("id k", "1 v"), bucket_by=["k"])
    groups = spark.range(3, 4).toDF("k")
    plan = lake.read_groups("silver", "t", groups)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_bucket" in plan or "PartitionFilters: [(key_bucket" in plan, plan
    assert rows(lake.read_groups("silver", "t", groups)) == [(3, 1)]


def test_bucketed_merge_appends_unseen_rows(spark, lake):
    lake.merge("silver", "t", frame(spark, [(1, "a"), (None, "n")]), ["k"], null_safe=True, bucket_by=["k"])
    before = bucket_files(lake)
    lake.merge("silver", "t", frame(spark, [(2, "b")]), ["k"], null_safe=True)
    after = bucket_files(lake)
    assert all(set(before[b]) <= set(after[b]) for b in before)
    got = lake.merge("silver", "t", frame(spark, [(None, "N"), (1, "A")]), ["k"], null_safe=True)
    assert rows(got) == sorted([(1, "A"), (2, "b"), (None, "N")], key=repr)


def test_bucketed_merge_of_some_columns_and_of_other_columns(spark, lake):
    lake.merge("silver", "t", frame(spark, [(1, "a"), (2, "b")]), ["k"], bucket_by=["k"])
    got = lake.merge("silver", "t", frame(spark, [(2, "B", 1.5), (3, "C", 2.5)], "k int, v string, w double"), ["k"])
    assert rows(got.select("k", "v", "w")) == [(1, "a", None), (2, "B", 1.5), (3, "C", 2.5)]
    # A wider key type deals every row anew.
    wide = frame(spark, [(1 << 40, "big", 0.0), (1, "one", 0.0)], "k long, v string, w double")
    got = lake.merge("silver", "t", wide, ["k"])
    assert rows(got.select("k", "v")) == sorted([(1, "one"), (2, "B"), (3, "C"), (1 << 40, "big")], key=repr)
    got = lake.merge("silver", "t", frame(spark, [(3, "x", 9.0)], "k long, v string, w double"), ["k"], update_cols=["w"])
    assert rows(got.filter("k = 3").select("k", "v", "w")) == [(3, "C", 9.0)]
    assert len(bucket_files(lake)) > 1


def test_replace_groups_in_buckets(spark, lake):
    lake.replace("silver", "t", spark.range(200).selectExpr("cast(id as int) k", "cast(id % 2 as int) v"), bucket_by=["k"])
    before = bucket_files(lake)
    fresh = frame(spark, [(4, 9), (4, 10)], "k int, v int")
    got = lake.replace_groups("silver", "t", frame(spark, [(4,), (5,)], "k int"), fresh)
    after = bucket_files(lake)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert rows(got.filter("k in (4, 5)")) == [(4, 10), (4, 9)] and got.count() == 200
    # Groups that do not name the key reach every bucket.
    got = lake.replace_groups("silver", "t", frame(spark, [(1,)], "v int"), frame(spark, [], "k int, v int"))
    assert got.filter("v = 1").count() == 0 and got.count() == 101


def test_nothing_is_inserted_twice_without_a_whole_key(spark, lake):
    schema = "a int, b int, v string"
    first = [(1, None, "x"), (1, None, "x"), (None, None, "y"), (1, 2, "z")]
    lake.insert_new("bronze", "t", frame(spark, first, schema), ["a", "b"])
    lake.insert_new("bronze", "t", frame(spark, first, schema), ["a", "b"])
    assert rows(lake.read("bronze", "t")) == sorted(first, key=repr)
    lake.insert_new("bronze", "t", frame(spark, [(1, None, "new"), (1, 2, "known")], schema), ["a", "b"])
    assert rows(lake.read("bronze", "t")) == sorted([*first, (1, None, "new")], key=repr)


def test_files_are_compared_by_keys_and_give_the_same_rows(spark, lake, tmp_path):
    raw, plain = tmp_path / "raw", Lakehouse(spark, f"file:{tmp_path}/plain")
    raw.mkdir()

    def deliver(name, *lines):
        (raw / f"{name}.csv").write_text("\n".join(["k,v", *lines]) + "\n")

    def ingest():
        scan = read_csv(spark, f"file:{raw}")
        lake.insert_new("bronze", "t", scan, ["k"], from_files=True)
        plain.insert_new("bronze", "t", scan, ["k"])
        assert rows(lake.read("bronze", "t")) == rows(plain.read("bronze", "t"))
        return scan

    deliver("known", "1,a", "2,b", "2,copy")
    ingest()
    before = lake.read("bronze", "t")
    deliver("new", "3,c", "3,again")
    deliver("both", "1,x", "4,d")
    deliver("nameless", ",n", "5,e")
    deliver("empty")
    scan = read_csv(spark, f"file:{raw}")
    whole, mixed = lake._by_file(before, scan, ["k"], F.col("k").isNull())
    assert rows(whole) == [("3", "again"), ("3", "c")]
    assert {r["v"] for r in mixed.collect()} == {"x", "d", "n", "e"}
    ingest()
    assert {r["v"] for r in lake.read("bronze", "t").collect()} == {"a", "b", "copy", "c", "again", "d", "n", "e"}
    ingest()
    assert lake.row_counts["bronze.t"] == 0


def test_packed_text_counts_as_what_it_unpacks_to(lake, tmp_path):
    folder = tmp_path / "raw"
    (folder / "a.csv").mkdir(parents=True)
    (folder / "b.csv").write_text("x" * 100)
    packed = folder / "a.csv" / "part-0.csv.gz"
    packed.write_bytes(gzip.compress(b"k,v\n" * 100))
    assert lake.input_bytes(f"file:{folder}") == 100 + 4 * packed.stat().st_size


def test_a_partition_gets_few_files_however_many_tasks_write_it(spark, lake):
    months = (F.col("id") % 5).alias("month")
    rows = spark.range(0, 4_000, 1, 8).select("id", months)
    stored = lake.replace("gold", "t", rows, ["month"])
    assert len(stored.inputFiles()) == 5
    stored = lake.merge("gold", "t", rows.filter("id % 7 = 0").withColumn("more", F.lit(1)), ["id"], partition_by=["month"])
    assert len(stored.inputFiles()) == 5 and stored.count() == 4_000
    # Rows read from a table with these partitions lie together already, and are not moved again.
    copy = lake.replace("mart", "t", stored.filter("id % 2 = 0"), ["month"], gather=False)
    assert len(copy.inputFiles()) <= 10 and sorted(copy.collect()) == sorted(stored.filter("id % 2 = 0").collect())
