"""The whole refresh from CSV files, run again as more data arrives."""

import csv
from pathlib import Path

import pytest

from tests.compare import plan
from tradewind.operators import CheckFailed
from tradewind.plans import refresh
from tradewind.schemas import MART_KEYS, RAW_TABLES
from tradewind.session import shared_dir
from tradewind.sources import Lakehouse

HEADERS = {
    "orders": """order_id customer_id order_status order_purchase_timestamp order_approved_at
        order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date""",
    "order_items": "order_id order_item_id product_id seller_id shipping_limit_date price freight_value",
    "customers": "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state",
    "products": """product_id product_category_name product_name_lenght product_description_lenght
        product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm""",
    "sellers": "seller_id seller_zip_code_prefix seller_city seller_state",
    "order_payments": "order_id payment_sequential payment_type payment_installments payment_value",
    "order_reviews": """review_id order_id review_score review_comment_title review_comment_message
        review_creation_date review_answer_timestamp""",
    "geolocation": """geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city
        geolocation_state""",
    "category_translation": "product_category_name product_category_name_english",
}


def order(i, day, status="delivered"):
    delivered = f"{day} 20:00:00" if status == "delivered" else ""
    return (f"o{i}", f"c{i}", status, f"{day} 10:00:00", f"{day} 10:05:00", "", delivered, "2018-12-31 00:00:00")


def item(i, product="p1", price="10.0"):
    return (f"o{i}", "1", product, "s1", "2018-01-01 00:00:00", price, "1.0")


def customer(i):
    return (f"c{i}", f"u{i % 2}", "123", " Rio ", "rj")


def review(i, text="muito bom,\n\"gostei\" demais"):
    return (f"r{i}", f"o{i}", "5", "", text, f"2018-01-{i:02d} 00:00:00", "")


def base():
    return {
        "orders": [order(1, "2018-01-01"), order(2, "2018-01-02"), order(3, "2018-01-03", "shipped")],
        "order_items": [item(1), item(2, "p2"), item(3)],
        "customers": [customer(1), customer(2), customer(3)],
        "products": [("p1", "brinquedos", "1", "1", "1", "1", "1", "1", "1")],
        "sellers": [("s1", "1", "x", "sp")],
        "order_payments": [(f"o{i}", "1", "card", "1", "11.0") for i in (1, 2, 3)],
        "order_reviews": [review(1)],
        "geolocation": [("1", "-10", "-50", "x", "SP")],
        "category_translation": [("brinquedos", "toys")],
    }


def later():
    data = base()
    data["orders"] += [order(4, "2018-01-04", "shipped"), order(5, "2018-02-01"), order(6, "2017-12-31")]
    data["order_items"] += [item(4), item(5, "p2", "20.0"), item(6)]
    data["customers"] += [customer(5), customer(6)]
    data["products"] += [("p2", "casa", "1", "1", "1", "1", "1", "1", "1")]
    data["order_payments"] += [("o4", "1", "boleto", "1", "11.0"), ("o5", "1", "card", "2", "21.0")]
    data["order_reviews"] += [review(i) for i in (2, 4, 5)]
    data["geolocation"] += [("1", "-12", "-52", "x", "SP")]
    return data


def last():
    """The customer of order 4 and a translation arrive after everything else."""
    data = later()
    data["customers"] += [customer(4)]
    data["category_translation"] += [("Casa ", "home")]
    return data


def write(folder, data):
    folder.mkdir(exist_ok=True)
    for name, rows in data.items():
        with open(folder / f"{RAW_TABLES[name].stem}.csv", "w", newline="") as file:
            csv.writer(file, quoting=csv.QUOTE_ALL).writerows([HEADERS[name].split(), *rows])
    return f"file:{folder}"


def contents(lake, layer, table):
    df = lake.read(layer, table)
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


GOLD = ("fact_orders", "review_texts", "dim_products")


def test_three_deliveries_equal_one(spark, tmp_path):
    step, whole = (Lakehouse(spark, f"file:{tmp_path}/{name}") for name in ("step", "whole"))
    for data in (base(), later(), last()):
        raw_dir = write(tmp_path / "raw", data)
        report = refresh.refresh(spark, raw_dir, step.root, with_themes=False)
        assert set(report.checks.values()) == {0}
    refresh.refresh(spark, write(tmp_path / "raw2", last()), whole.root, with_themes=False)

    for table in GOLD:
        assert contents(step, "gold", table) == contents(whole, "gold", table), table
    for table in MART_KEYS:
        assert contents(step, "mart", table) == contents(whole, "mart", table), table

    facts = {r["order_id"]: r for r in step.read("gold", "fact_orders").collect()}
    assert facts["o4"]["customer_unique_id"] == "u0" and facts["o1"]["customer_state"] == "RJ"
    texts = {r["review_id"]: r for r in step.read("gold", "review_texts").collect()}
    assert texts["r2"]["category_en"] == "home" and '"gostei"' in texts["r1"]["text"]
    days = spark.table("agg_daily_sales").orderBy("order_date").collect()
    assert [(str(r["order_date"]), r["order_count"]) for r in days] == [
        ("2017-12-31", 1),
        ("2018-01-01", 1),
        ("2018-01-02", 1),
        ("2018-02-01", 1),
    ]


def test_late_rows_of_any_age_reach_all_marts(spark, tmp_path):
    step, whole = (Lakehouse(spark, f"file:{tmp_path}/{name}") for name in ("step", "whole"))
    data = base()
    data["orders"] = [order(1, "2017-01-05"), order(2, "2018-06-02"), order(3, "2017-01-05")]
    data["customers"] = [customer(1), customer(2), customer(3)]
    data["order_reviews"] = []
    data["category_translation"] = [("casa", "home")]

    def deliver(folder):
        return refresh.refresh(spark, write(tmp_path / folder, data), step.root, with_themes=False)

    deliver("raw")
    data["orders"] += [order(4, "2017-02-01")]
    data["order_items"] += [item(4, price="30.0")]
    data["customers"] += [customer(4)]
    data["order_payments"] += [("o4", "1", "card", "1", "31.0")]
    data["order_reviews"] += [review(1)]
    report = deliver("raw")
    assert report.row_counts["mart.agg_daily_sales"] == 2  # the other months are not written
    for last in (False, True):
        if last:
            data["category_translation"] += [("brinquedos", "toys")]
            deliver("raw")
        rebuilt = Lakehouse(spark, f"{whole.root}-{last}")
        refresh.refresh(spark, write(tmp_path / f"raw-{last}", data), rebuilt.root, with_themes=False)
        for table in MART_KEYS:
            assert contents(step, "mart", table) == contents(rebuilt, "mart", table), table


# Where a run dies: a function of a module.
DEATHS = [
    (refresh, "refine"),
    (refresh, "build_gold"),
    (refresh.silver, "places"),
    (refresh.gold, "dim_products"),
    (refresh.marts, "agg_category_sales"),
    (refresh.marts, "agg_seller_performance"),
    (refresh, "update_themes"),
]
STORED = [("silver", name) for name in (*refresh.CLEANERS, "geolocation_points")]
STORED += [("gold", name) for name in GOLD] + [("mart", name) for name in MART_KEYS]


@pytest.fixture(scope="module")
def expected(spark, tmp_path_factory):
    """All tables of one refresh over everything."""
    folder = tmp_path_factory.mktemp("whole")
    lake = Lakehouse(spark, f"file:{folder}/lake")
    refresh.refresh(spark, write(folder / "raw", last()), lake.root, with_themes=False)
    return {table: contents(lake, *table) for table in STORED}


@pytest.mark.parametrize("module, name", DEATHS, ids=lambda x: getattr(x, "__name__", str(x)))
def test_a_run_that_died_is_finished_by_the_next(spark, tmp_path, monkeypatch, expected, module, name):
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    refresh.refresh(spark, write(tmp_path / "raw", base()), lake.root, with_themes=False)
    raw_dir = write(tmp_path / "raw", last())
    with monkeypatch.context() as patched:
        patched.setattr(module, name, lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            refresh.refresh(spark, raw_dir, lake.root, restarts=1, candidates=[3])
    refresh.refresh(spark, raw_dir, lake.root, with_themes=False)
    for table in STORED:
        assert contents(lake, *table) == expected[table], table


def test_nothing_is_left_behind(spark, tmp_path):
    def left():
        folder = Path(shared_dir(spark).removeprefix("file:")) / "tradewind"
        return {p.name for p in folder.iterdir()} if folder.exists() else set()

    lake, before = Lakehouse(spark, f"file:{tmp_path}/lake"), left()
    for data in (base(), later(), last()):
        refresh.refresh(spark, write(tmp_path / "raw", data), lake.root, restarts=1, candidates=[3])
    assert left() == before


def test_new_points_are_taken_in_without_reading_the_others(spark, tmp_path, monkeypatch):
    step, whole = (Lakehouse(spark, f"file:{tmp_path}/{name}") for name in ("step", "whole"))
    points = [(str(z), str(-10 - i), "-50", city, "SP") for z in range(20) for i, city in enumerate(("x", "y", "y"))]
    data = base() | {"geolocation": points}
    refresh.refresh(spark, write(tmp_path / "raw", data), step.root, with_themes=False)
    read = []
    groups = Lakehouse.read_groups

    def noted(lake, layer, table, rows):
        found = groups(lake, layer, table, rows)
        read.append((table, found.count(), plan(found)))
        return found

    # A place gets a point, another one a copy under a padded code, a third is new.
    data["geolocation"] = points + [("3", "-20", "-50", "y", "SP"), ("00004", "-10", "-50", "x", "SP"), ("99", "-1", "-50", "z", "SP")]
    refresh.ingest(step, write(tmp_path / "raw", data))
    monkeypatch.setattr(Lakehouse, "read_groups", noted)
    monkeypatch.setattr(Lakehouse, "read", forbid(Lakehouse.read, ("bronze", "geolocation")))
    refresh.refine(step)
    assert [(table, n) for table, n, _ in read] == [("geolocation_points", 6)]
    assert "PartitionFilters: [" in read[0][2] and "key_bucket" in read[0][2]
    assert step.row_counts["silver.geolocation"] < 42
    monkeypatch.undo()
    refresh.refresh(spark, write(tmp_path / "raw2", data), whole.root, with_themes=False)
    assert contents(step, "silver", "geolocation") == contents(whole, "silver", "geolocation")
    assert len(contents(step, "silver", "geolocation")) == 41


def forbid(read, table):
    def checked(lake, *asked):
        assert asked != table
        return read(lake, *asked)

    return checked


def test_products_of_other_months_are_not_read(spark, tmp_path):
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    refresh.refresh(spark, write(tmp_path / "raw", later()), lake.root, with_themes=False)
    months = spark.createDataFrame([(2018, 2)], "order_year int, order_month int").collect()
    found = refresh.products_of_months(lake, months)
    assert [r["order_id"] for r in found.collect()] == ["o5"]
    filters = plan(found).split("PartitionFilters: ")[1].split("]")[0]
    assert "order_year" in filters and "order_month" in filters


def test_an_order_that_comes_after_its_items(spark, tmp_path):
    """Its products wait without a month and move to it, and the rest stays where it is."""
    step, whole = (Lakehouse(spark, f"file:{tmp_path}/{name}") for name in ("step", "whole"))
    data = later()
    orders, data["orders"] = data["orders"], data["orders"][:-2]
    refresh.refresh(spark, write(tmp_path / "raw", data), step.root, with_themes=False)
    data["orders"] = orders
    refresh.refresh(spark, write(tmp_path / "raw", data), step.root, with_themes=False)
    refresh.refresh(spark, write(tmp_path / "raw2", data), whole.root, with_themes=False)
    for table in GOLD:
        assert contents(step, "gold", table) == contents(whole, "gold", table), table
    for table in MART_KEYS:
        assert contents(step, "mart", table) == contents(whole, "mart", table), table


def test_many_touched_orders_are_not_picked_from_whole_tables(spark, tmp_path, monkeypatch):
    """Where most orders are touched and too many to broadcast, tables are built anew, with the same rows."""
    step, whole = (Lakehouse(spark, f"file:{tmp_path}/{name}") for name in ("step", "whole"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    refresh.refresh(spark, write(tmp_path / "raw", base()), step.root, with_themes=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with monkeypatch.context() as patched:
            patched.setattr(Lakehouse, "merge", forbid_gold(Lakehouse.merge))
            patched.setattr(refresh.marts, "agg_category_sales", lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                refresh.refresh(spark, write(tmp_path / "raw", later()), step.root, with_themes=False)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    refresh.refresh(spark, write(tmp_path / "raw", later()), step.root, with_themes=False)
    refresh.refresh(spark, write(tmp_path / "raw2", later()), whole.root, with_themes=False)
    for table in GOLD:
        assert contents(step, "gold", table) == contents(whole, "gold", table), table
    for table in MART_KEYS:
        assert contents(step, "mart", table) == contents(whole, "mart", table), table


def forbid_gold(merge):
    def checked(lake, layer, *args, **options):
        assert layer != "gold"
        return merge(lake, layer, *args, **options)

    return checked


def test_rerun_changes_nothing_and_rewrites_no_gold(spark, tmp_path):
    lake, raw_dir = Lakehouse(spark, f"file:{tmp_path}/lake"), write(tmp_path / "raw", base())
    refresh.refresh(spark, raw_dir, lake.root, with_themes=False)
    before = {t: contents(lake, "gold", t) for t in GOLD}
    report = refresh.refresh(spark, raw_dir, lake.root, with_themes=False)
    assert {t: contents(lake, "gold", t) for t in GOLD} == before
    assert not any(name.startswith("gold.") for name in report.row_counts)


def test_bronze_keeps_the_first_version_of_a_row(spark, tmp_path):
    lake, data = Lakehouse(spark, f"file:{tmp_path}/lake"), base()
    refresh.ingest(lake, write(tmp_path / "raw", data))
    data["orders"][2] = order(3, "2018-01-03")
    refresh.ingest(lake, write(tmp_path / "raw", data))
    status = {r["order_id"]: r["order_status"] for r in lake.read("bronze", "orders").collect()}
    assert status == {"o1": "delivered", "o2": "delivered", "o3": "shipped"}


def test_silver_catches_up_after_a_run_that_died(spark, tmp_path):
    lake = Lakehouse(spark, f"file:{tmp_path}/lake")
    refresh.refresh(spark, write(tmp_path / "raw", base()), lake.root, with_themes=False)
    refresh.ingest(lake, write(tmp_path / "raw", later()))  # and no further
    refresh.refresh(spark, write(tmp_path / "raw", last()), lake.root, with_themes=False)
    assert {r["order_id"] for r in lake.read("gold", "fact_orders").collect()} == {f"o{i}" for i in range(1, 7)}


def test_failed_check_stops_before_themes(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(refresh.MART_CHECKS, "dim_customers", {"not_null": ["avg_review_score"]})
    monkeypatch.setattr(refresh, "update_themes", lambda *a, **k: pytest.fail("themes ran"))
    with pytest.raises(CheckFailed, match="dim_customers.avg_review_score"):
        data = base()
        data["order_reviews"] = data["order_reviews"][:0]
        refresh.refresh(spark, write(tmp_path / "raw", data), f"file:{tmp_path}/lake")


def test_themes_are_stored_and_then_skipped(spark, tmp_path):
    lake, data = Lakehouse(spark, f"file:{tmp_path}/lake"), later()
    raw_dir = write(tmp_path / "raw", data)
    report = refresh.refresh(spark, raw_dir, lake.root, restarts=1)
    assert report.themes.k == 3
    assert report.backlog_before == {"total": 4, "processed": 0, "unprocessed": 4}
    assert report.backlog_after == {"total": 4, "processed": 4, "unprocessed": 0}
    assert {r["review_id"] for r in report.themes.samples.collect()} == {"r1", "r2", "r4", "r5"}
    assert {r["review_id"] for r in lake.read("mart", "review_clusters").collect()} == {"r1", "r2", "r4", "r5"}
    again = refresh.refresh(spark, raw_dir, lake.root, restarts=1)
    assert again.themes is None and again.backlog_before == again.backlog_after == report.backlog_after
    assert spark.table("review_clusters").count() == 4
