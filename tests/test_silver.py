"""Cleaning rules on raw text rows, each rule with rows that break it."""

import datetime as dt

from tradewind.plans import silver


def raw(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns.split()))


def as_dict(df, key):
    return {row[key]: row.asDict() for row in df.collect()}


ORDER_COLUMNS = """order_id customer_id order_status order_purchase_timestamp order_approved_at
    order_delivered_carrier_date order_delivered_customer_date order_estimated_delivery_date"""


def order(key, customer="c", status="delivered", placed="2018-01-05 10:00:00", approved="2018-01-05 11:00:00"):
    return (key, customer, status, placed, approved, None, "2018-01-09 00:00:00", "2018-01-20 00:00:00")


def test_orders(spark):
    rows = [
        order("ok"),
        order("null status", status=None),
        order("null customer", customer=None),
        order(None),
        order("approved early", approved="2018-01-05 09:59:59"),
        order("approved at once", approved="2018-01-05 10:00:00"),
        order("not approved", approved=None),
        order("bad approval", approved="soon"),
        order("bad purchase", placed="once"),
        order("bad copy", status=None),
        order("bad copy", customer="kept"),
        order("two copies", customer="b"),
        order("two copies", customer="a"),
    ]
    got = as_dict(silver.clean_orders(raw(spark, ORDER_COLUMNS, rows)), "order_id")
    assert set(got) == {"ok", "approved at once", "not approved", "bad approval", "bad copy", "two copies"}
    assert got["ok"]["order_purchase_timestamp"] == dt.datetime(2018, 1, 5, 10)
    assert got["bad approval"]["order_approved_at"] is None
    assert got["bad copy"]["customer_id"] == "kept"
    assert got["two copies"]["customer_id"] == "a"


def test_survivor_depends_on_neither_order_nor_partitioning(spark):
    rows = [order("k", customer=str(i % 7), status=f"s{i % 3}") for i in range(50)]
    forwards = silver.clean_orders(raw(spark, ORDER_COLUMNS, rows).repartition(7)).collect()
    backwards = silver.clean_orders(raw(spark, ORDER_COLUMNS, rows[::-1]).coalesce(1)).collect()
    assert forwards == backwards and len(forwards) == 1


def test_order_items(spark):
    columns = "order_id order_item_id product_id seller_id shipping_limit_date price freight_value"
    day = "2018-01-01 00:00:00"
    rows = [
        ("o", "1", "p", "s", day, "10.50", "0"),
        ("o", "2", "p", "s", day, "0", "1"),
        ("o", "3", "p", "s", day, "-1", "1"),
        ("o", "4", "p", "s", day, "1", "-0.01"),
        ("o", "5", "p", "s", day, "ten", "1"),
        ("o", "6", "p", "s", day, "1", None),
        ("o", "7", None, "s", day, "1", "1"),
        ("o", "8", "p", None, day, "1", "1"),
        ("o", "9", "p", "s", "whenever", "1", "1"),
        ("o", "1", "p", "s", day, "-5", "0"),
    ]
    got = as_dict(silver.clean_order_items(raw(spark, columns, rows)), "order_item_id")
    assert set(got) == {"1", "9"}
    assert got["1"]["price"] == 10.5 and got["1"]["freight_value"] == 0.0
    assert got["9"]["shipping_limit_date"] is None


def test_customers_and_sellers(spark):
    columns = "customer_id customer_unique_id customer_zip_code_prefix customer_city customer_state"
    rows = [
        ("a", "u", "123", "  São PAULO ", " sp"),
        ("b", "u", "123456", "x", "RJ "),
        ("c", None, "1", "x", "x"),
        (None, "u", "1", "x", "x"),
        ("d", "u", None, None, None),
    ]
    got = as_dict(silver.clean_customers(raw(spark, columns, rows)), "customer_id")
    assert set(got) == {"a", "b", "d"}
    assert (got["a"]["customer_zip_code_prefix"], got["a"]["customer_city"], got["a"]["customer_state"]) == (
        "00123",
        "são paulo",
        "SP",
    )
    assert got["b"]["customer_zip_code_prefix"] == "123456"
    assert got["d"]["customer_city"] is None

    sellers = raw(
        spark,
        "seller_id seller_zip_code_prefix seller_city seller_state",
        [("s", "9", " Rio ", "rj"), (None, "1", "x", "x"), ("s", "9", " Rio ", "rj")],
    )
    assert [tuple(r) for r in silver.clean_sellers(sellers).collect()] == [("s", "00009", "rio", "RJ")]


def test_products(spark):
    columns = """product_id product_category_name product_name_lenght product_description_lenght
        product_photos_qty product_weight_g product_length_cm product_height_cm product_width_cm"""
    rows = [
        ("a", None, "40", "200", "1", "0", "10", "x", "5.5"),
        ("b", "toys", "n/a", None, "2", "-3", None, "1", "1"),
        ("c", "toys", "1", "1", "1", "250.5", "1", "1", "1"),
        (None, "toys", "1", "1", "1", "1", "1", "1", "1"),
    ]
    got = as_dict(silver.clean_products(raw(spark, columns, rows)), "product_id")
    assert set(got) == {"a", "b", "c"}
    assert got["a"]["product_category_name"] == "unknown"
    assert got["a"]["product_weight_g"] is None and got["b"]["product_weight_g"] is None
    assert got["c"]["product_weight_g"] == 250.5
    assert got["a"]["product_height_cm"] is None and got["a"]["product_width_cm"] == 5.5
    assert got["a"]["product_name_lenght"] == 40 and got["b"]["product_name_lenght"] is None


def test_payments(spark):
    columns = "order_id payment_sequential payment_type payment_installments payment_value"
    rows = [
        ("o", "1", "card", "3", "10.0"),
        ("o", "2", "card", "1", "0"),
        ("o", "3", None, "1", "1"),
        (None, "1", "card", "1", "1"),
        ("o", "4", "card", "many", "2"),
        ("o", "5", "card", "1", "free"),
    ]
    got = as_dict(silver.clean_order_payments(raw(spark, columns, rows)), "payment_sequential")
    assert set(got) == {1, 4}
    assert got[1]["payment_installments"] == 3 and got[4]["payment_installments"] is None


def test_reviews(spark):
    columns = """review_id order_id review_score review_comment_title review_comment_message
        review_creation_date review_answer_timestamp"""
    day = "2018-01-01 00:00:00"
    rows = [
        ("ok", "o", "5", " fine ", " good \n", day, day),
        ("blank", "o", "1", "", "   ", day, "never"),
        ("zero", "o", "0", None, "x", day, day),
        ("six", "o", "6", None, "x", day, day),
        ("text", "o", "x", None, "x", day, day),
        ("null", "o", None, None, "x", day, day),
        ("no order", None, "3", None, "x", day, day),
    ]
    got = as_dict(silver.clean_order_reviews(raw(spark, columns, rows)), "review_id")
    assert set(got) == {"ok", "blank"}
    assert got["ok"]["review_comment_title"] == "fine" and got["ok"]["review_score"] == 5
    assert got["ok"]["has_comment"] and not got["blank"]["has_comment"]
    assert got["blank"]["review_comment_message"] is None and got["blank"]["review_comment_title"] is None


def test_geolocation(spark):
    columns = """geolocation_zip_code_prefix geolocation_lat geolocation_lng geolocation_city
        geolocation_state"""
    rows = [("1", lat, "-50", "x", "SP") for lat in ("-1", "-2", "-3", "-4", "-4")]
    rows += [
        ("1", "-35.1", "-50", "x", "SP"),
        ("1", "5.6", "-50", "x", "SP"),
        ("1", "-5", "-33.9", "x", "SP"),
        ("1", None, "-50", "x", "SP"),
        (None, "-5", "-50", "x", "SP"),
        ("2", "5.5", "-74", None, "SP"),
    ]
    got = as_dict(silver.clean_geolocation(raw(spark, columns, rows)), "geolocation_zip_code_prefix")
    assert set(got) == {"00001", "00002"}
    assert got["00001"]["geolocation_lat"] == -3.0  # lower median of four distinct points
    assert got["00002"]["geolocation_city"] is None and got["00002"]["geolocation_lng"] == -74.0


def test_category_translation(spark):
    columns = "product_category_name product_category_name_english"
    rows = [("Toys ", "TOYS"), ("toys", "play"), ("art", None), (None, "x"), ("beds", " Beds")]
    got = as_dict(silver.clean_category_translation(raw(spark, columns, rows)), "product_category_name")
    assert {k: v["product_category_name_english"] for k, v in got.items()} == {"toys": "play", "beds": "beds"}


def test_unnamed_columns_pass_through(spark):
    sellers = raw(
        spark, "seller_id seller_zip_code_prefix seller_city seller_state note", [("s", "1", "a", "b", "kept")]
    )
    assert silver.clean_sellers(sellers).first()["note"] == "kept"
