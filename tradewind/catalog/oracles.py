"""DuckDB SQL for the queries: shared sub-results as common table expressions, and one text per query."""

from __future__ import annotations

import re


def _first_row(source: str, keys: str, order: str) -> str:
    ordering = ", ".join(f"{c.strip()} NULLS LAST" for c in order.split(","))
    return f"""SELECT * EXCLUDE (pick) FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {ordering}) AS pick FROM ({source}) AS valid
    ) AS picked WHERE pick = 1"""


_SHARED: dict[str, str] = {
    # -- raw shapes
    "raw_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
            CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped' ELSE 'processing' END AS order_status,
            o_orderdate AS order_purchase_timestamp,
            CASE WHEN o_orderkey % 50 <> 0
                THEN o_orderdate + to_days(CAST(o_orderkey % 7 - 1 AS INTEGER)) END AS order_approved_at,
            CASE WHEN o_orderstatus = 'F'
                THEN o_orderdate + to_days(CAST(o_orderkey % 3 AS INTEGER)) END AS order_delivered_carrier_date,
            CASE WHEN o_orderstatus = 'F'
                THEN o_orderdate + to_days(CAST(o_orderkey % 30 AS INTEGER)) END AS order_delivered_customer_date,
            o_orderdate + to_days(20) AS order_estimated_delivery_date
        FROM orders""",
    "raw_order_items": """
        SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
            l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, l_extendedprice AS price,
            l_extendedprice * l_tax AS freight_value
        FROM lineitem""",
    "raw_order_payments": """
        SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential, l_returnflag AS payment_type,
            CAST(l_quantity AS INTEGER) AS payment_installments,
            l_extendedprice * (1 - l_discount) AS payment_value
        FROM lineitem""",
    "raw_customers": """
        SELECT c_custkey AS customer_id, CAST(floor(c_custkey / 2) AS BIGINT) AS customer_unique_id,
            CAST(c_nationkey AS VARCHAR) AS customer_zip_code_prefix,
            ' ' || c_mktsegment AS customer_city, lower(n_name) AS customer_state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "raw_sellers": """
        SELECT s_suppkey AS seller_id, CAST(s_nationkey AS VARCHAR) AS seller_zip_code_prefix,
            n_name || ' ' AS seller_city, lower(n_name) AS seller_state
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "raw_products": """
        SELECT p_partkey AS product_id, CASE WHEN p_partkey % 10 <> 0 THEN p_type END AS product_category_name,
            CAST(length(p_name) AS VARCHAR) AS product_name_lenght,
            CAST(length(p_type) AS VARCHAR) AS product_description_lenght,
            p_brand AS product_photos_qty, CAST(p_size - 5 AS VARCHAR) AS product_weight_g,
            CAST(p_size AS VARCHAR) AS product_length_cm, p_name AS product_height_cm,
            CAST(p_retailprice AS VARCHAR) AS product_width_cm
        FROM part""",
    "raw_category_translation": """
        SELECT ' ' || p_type AS product_category_name,
            CASE WHEN p_type <> 'PROMO' THEN p_type || '_EN ' END AS product_category_name_english
        FROM part""",
    "raw_order_reviews": """
        SELECT d.doc_id AS review_id, CAST(floor(d.doc_id / 2) AS BIGINT) AS order_id,
            1 + 2 * quality + 2 * (1 - toxic) AS review_score, lang AS review_comment_title,
            text AS review_comment_message,
            TIMESTAMP '1998-01-01' + to_hours(d.doc_id) AS review_creation_date,
            TIMESTAMP '1998-01-01' + to_hours(d.doc_id) + to_days(2) AS review_answer_timestamp
        FROM documents AS d LEFT JOIN labels AS s ON d.doc_id = s.doc_id""",
    "raw_geolocation": """
        SELECT CAST(c_nationkey AS VARCHAR) AS geolocation_zip_code_prefix,
            CAST(c_custkey % 50 - 40 AS DOUBLE) AS geolocation_lat,
            CAST(c_custkey % 50 - 80 AS DOUBLE) AS geolocation_lng,
            n_name AS geolocation_city, n_name AS geolocation_state
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "review_clusters": """
        SELECT CAST(vec_id AS VARCHAR) AS review_id,
            CAST(CAST(floor(vec_id / 2) AS BIGINT) AS VARCHAR) AS order_id,
            CAST(label AS INTEGER) AS cluster_id, 'theme ' || label AS cluster_label,
            'reviews of theme ' || label AS cluster_summary,
            CAST(embedding[1] AS DOUBLE) AS tsne_x, CAST(embedding[2] AS DOUBLE) AS tsne_y
        FROM embeddings""",
    # -- silver
    "silver_orders": _first_row(
        """SELECT * FROM raw_orders WHERE order_id IS NOT NULL AND customer_id IS NOT NULL
            AND order_status IS NOT NULL
            AND (order_approved_at IS NULL OR order_approved_at >= order_purchase_timestamp)""",
        "order_id",
        """customer_id, order_status, order_purchase_timestamp, order_approved_at,
            order_delivered_carrier_date, order_delivered_customer_date, order_estimated_delivery_date""",
    ),
    "silver_order_items": _first_row(
        """SELECT * FROM raw_order_items WHERE order_id IS NOT NULL AND product_id IS NOT NULL
            AND seller_id IS NOT NULL AND price > 0 AND freight_value >= 0""",
        "order_id, order_item_id",
        "product_id, seller_id, shipping_limit_date, price, freight_value",
    ),
    "silver_customers": _first_row(
        """SELECT customer_id, customer_unique_id, CASE WHEN length(customer_zip_code_prefix) < 5 THEN lpad(customer_zip_code_prefix, 5, '0') ELSE customer_zip_code_prefix END AS customer_zip_code_prefix,
            lower(trim(customer_city)) AS customer_city, upper(trim(customer_state)) AS customer_state
            FROM raw_customers WHERE customer_id IS NOT NULL AND customer_unique_id IS NOT NULL""",
        "customer_id",
        "customer_unique_id, customer_zip_code_prefix, customer_city, customer_state",
    ),
    "silver_sellers": _first_row(
        """SELECT seller_id, CASE WHEN length(seller_zip_code_prefix) < 5 THEN lpad(seller_zip_code_prefix, 5, '0') ELSE seller_zip_code_prefix END AS seller_zip_code_prefix,
            lower(trim(seller_city)) AS seller_city, upper(trim(seller_state)) AS seller_state
            FROM raw_sellers WHERE seller_id IS NOT NULL""",
        "seller_id",
        "seller_zip_code_prefix, seller_city, seller_state",
    ),
    "silver_products": _first_row(
        """SELECT product_id, coalesce(product_category_name, 'unknown') AS product_category_name,
            try_cast(product_name_lenght AS INTEGER) AS product_name_lenght,
            try_cast(product_description_lenght AS INTEGER) AS product_description_lenght,
            try_cast(product_photos_qty AS INTEGER) AS product_photos_qty,
            CASE WHEN try_cast(product_weight_g AS FLOAT) > 0
                THEN try_cast(product_weight_g AS FLOAT) END AS product_weight_g,
            try_cast(product_length_cm AS FLOAT) AS product_length_cm,
            try_cast(product_height_cm AS FLOAT) AS product_height_cm,
            try_cast(product_width_cm AS FLOAT) AS product_width_cm
            FROM raw_products WHERE product_id IS NOT NULL""",
        "product_id",
        "product_category_name",
    ),
    "silver_order_payments": _first_row(
        """SELECT * FROM raw_order_payments WHERE order_id IS NOT NULL AND payment_type IS NOT NULL
            AND payment_value > 0""",
        "order_id, payment_sequential",
        "payment_type, payment_installments, payment_value",
    ),
    "silver_order_reviews": _first_row(
        """SELECT review_id, order_id, review_score,
            nullif(trim(review_comment_title), '') AS review_comment_title,
            nullif(trim(review_comment_message), '') AS review_comment_message,
            review_creation_date, review_answer_timestamp,
            nullif(trim(review_comment_message), '') IS NOT NULL AS has_comment
            FROM raw_order_reviews WHERE review_id IS NOT NULL AND order_id IS NOT NULL
            AND review_score BETWEEN 1 AND 5""",
        "review_id",
        "order_id, review_score, review_comment_title, review_comment_message",
    ),
    "geolocation_points": _first_row(
        """SELECT CASE WHEN length(geolocation_zip_code_prefix) < 5 THEN lpad(geolocation_zip_code_prefix, 5, '0') ELSE geolocation_zip_code_prefix END AS geolocation_zip_code_prefix,
            geolocation_lat, geolocation_lng, geolocation_city, geolocation_state FROM raw_geolocation
            WHERE geolocation_zip_code_prefix IS NOT NULL AND geolocation_lat BETWEEN -35 AND 5.5
            AND geolocation_lng BETWEEN -74 AND -34""",
        "geolocation_zip_code_prefix, geolocation_lat, geolocation_lng",
        "geolocation_city, geolocation_state",
    ),
    "silver_geolocation": """
        SELECT geolocation_zip_code_prefix, geolocation_city, geolocation_state,
            quantile_disc(geolocation_lat, 0.5) AS geolocation_lat,
            quantile_disc(geolocation_lng, 0.5) AS geolocation_lng
        FROM geolocation_points GROUP BY ALL""",
    "silver_category_translation": _first_row(
        """SELECT lower(trim(product_category_name)) AS product_category_name,
            lower(trim(product_category_name_english)) AS product_category_name_english
            FROM raw_category_translation
            WHERE product_category_name IS NOT NULL AND product_category_name_english IS NOT NULL""",
        "product_category_name",
        "product_category_name_english",
    ),
    # -- gold
    "payments_per_order": """
        SELECT order_id, sum(payment_value) AS total_payment_value,
            arg_min(payment_type, payment_sequential) AS primary_payment_type,
            max(payment_installments) AS max_installments
        FROM silver_order_payments GROUP BY order_id""",
    "items_per_order": """
        SELECT order_id, sum(price) AS total_item_price, sum(freight_value) AS total_freight_value,
            count(order_item_id) AS item_count
        FROM silver_order_items GROUP BY order_id""",
    "latest_reviews": """
        SELECT order_id, review_score, has_comment FROM (
            SELECT *, row_number() OVER (PARTITION BY order_id
                ORDER BY review_creation_date DESC NULLS LAST, review_id) AS pick
            FROM silver_order_reviews) AS ranked WHERE pick = 1""",
    "orders_delivery": """
        SELECT *, coalesce(order_delivered_customer_date > order_estimated_delivery_date, false) AS is_delayed,
            CAST(datediff('day', order_purchase_timestamp, order_delivered_customer_date) AS INTEGER) AS delivery_days
        FROM silver_orders""",
    "fact_orders": """
        SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_state, c.customer_city, o.order_status,
            o.order_purchase_timestamp, CAST(o.order_purchase_timestamp AS DATE) AS order_date,
            CAST(year(o.order_purchase_timestamp) AS INTEGER) AS order_year,
            CAST(month(o.order_purchase_timestamp) AS INTEGER) AS order_month,
            o.order_delivered_customer_date, o.order_estimated_delivery_date, o.is_delayed, o.delivery_days,
            p.total_payment_value, p.primary_payment_type, p.max_installments,
            i.total_item_price, i.total_freight_value, i.item_count, r.review_score, r.has_comment
        FROM orders_delivery AS o
        LEFT JOIN silver_customers AS c ON o.customer_id = c.customer_id
        LEFT JOIN payments_per_order AS p ON o.order_id = p.order_id
        LEFT JOIN items_per_order AS i ON o.order_id = i.order_id
        LEFT JOIN latest_reviews AS r ON o.order_id = r.order_id""",
    "products_category": """
        SELECT p.product_id, p.product_category_name,
            coalesce(t.product_category_name_english, p.product_category_name) AS category_en
        FROM silver_products AS p LEFT JOIN silver_category_translation AS t
            ON lower(trim(p.product_category_name)) = t.product_category_name""",
    "category_per_order": """
        SELECT order_id, product_category_name, category_en FROM (
            SELECT i.order_id, c.product_category_name, c.category_en,
                row_number() OVER (PARTITION BY i.order_id ORDER BY i.order_item_id) AS pick
            FROM silver_order_items AS i LEFT JOIN products_category AS c ON i.product_id = c.product_id
        ) AS ranked WHERE pick = 1""",
    "review_texts": """
        SELECT r.review_id, r.order_id, r.review_score, r.review_comment_message AS text, r.review_comment_title,
            r.review_creation_date, o.order_status, CAST(o.order_purchase_timestamp AS DATE) AS order_date,
            c.product_category_name, c.category_en,
            CASE WHEN r.review_score >= 4 THEN 'positive' WHEN r.review_score = 3 THEN 'neutral'
                ELSE 'negative' END AS sentiment_label
        FROM silver_order_reviews AS r
        LEFT JOIN silver_orders AS o ON r.order_id = o.order_id
        LEFT JOIN category_per_order AS c ON r.order_id = c.order_id
        WHERE r.has_comment""",
    "dim_products": """
        SELECT i.order_id, i.product_id, sum(i.price) AS price, sum(i.freight_value) AS freight_value,
            any_value(c.product_category_name) AS product_category_name, any_value(c.category_en) AS category_en
        FROM silver_order_items AS i LEFT JOIN products_category AS c ON i.product_id = c.product_id
        GROUP BY i.order_id, i.product_id""",
    # -- staging
    "stg_fact_orders": """
        SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
            CAST(customer_unique_id AS VARCHAR) AS customer_unique_id, order_status, order_date, order_month,
            order_year, order_purchase_timestamp,
            CAST(order_estimated_delivery_date AS DATE) AS order_estimated_delivery_date,
            CAST(order_delivered_customer_date AS DATE) AS order_delivered_customer_date,
            delivery_days, is_delayed, total_item_price, total_freight_value, total_payment_value,
            primary_payment_type, max_installments, CAST(item_count AS INTEGER) AS item_count,
            CAST(review_score AS DOUBLE) AS review_score, has_comment, customer_state, customer_city
        FROM fact_orders""",
    "stg_dim_products": """
        SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(product_id AS VARCHAR) AS product_id,
            product_category_name, category_en, price, freight_value FROM dim_products""",
    "stg_reviews": """
        SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id, order_date,
            order_status, CAST(review_score AS DOUBLE) AS review_score, sentiment_label, text AS review_text,
            review_comment_title, review_creation_date, product_category_name, category_en
        FROM review_texts WHERE length(text) > 10""",
    # -- marts
    "fct_orders": """
        SELECT order_id, customer_id, customer_unique_id, order_status, order_date, order_month, order_year,
            delivery_days, is_delayed, total_item_price, total_freight_value, total_payment_value,
            primary_payment_type, max_installments, item_count, review_score, has_comment, customer_state,
            customer_city, order_purchase_timestamp AS purchased_at, total_payment_value AS product_revenue
        FROM stg_fact_orders WHERE order_status = 'delivered'""",
    "agg_daily_sales": """
        SELECT order_date, order_month, order_year, count(DISTINCT order_id) AS order_count,
            sum(product_revenue) AS revenue, sum(total_freight_value) AS freight_revenue,
            avg(review_score) AS avg_review_score,
            CAST(sum(CASE WHEN is_delayed THEN 1 ELSE 0 END) AS BIGINT) AS delayed_count
        FROM fct_orders GROUP BY 1, 2, 3""",
    "agg_category_sales": """
        SELECT o.order_month, o.order_year, p.category_en, p.product_category_name,
            count(DISTINCT o.order_id) AS order_count, sum(p.price) AS revenue,
            sum(p.freight_value) AS freight_total, avg(o.review_score) AS avg_review_score
        FROM fct_orders AS o JOIN stg_dim_products AS p ON o.order_id = p.order_id GROUP BY 1, 2, 3, 4""",
    "rfm": """
        SELECT order_id, customer_id, r, f,
            CASE WHEN r = 1 AND f = 3 THEN 'Champions' WHEN r = 1 THEN 'Recent' WHEN f = 3 THEN 'Loyal'
                ELSE 'Others' END AS rfm_segment
        FROM (SELECT order_id, customer_id,
                CAST(ntile(3) OVER (ORDER BY max(order_date) DESC NULLS FIRST, order_id, customer_id) AS INTEGER) AS r,
                CAST(ntile(3) OVER (ORDER BY count(*), order_id, customer_id) AS INTEGER) AS f
            FROM fct_orders GROUP BY order_id, customer_id) AS tiled""",
    # -- themes
    "theme_texts": """
        SELECT c.cluster_id, r.review_id, r.review_text, r.review_creation_date
        FROM stg_reviews AS r JOIN review_clusters AS c ON r.review_id = c.review_id""",
    "theme_words": r"""
        SELECT cluster_id, term, count(*) AS tf FROM (
            SELECT cluster_id, unnest(regexp_split_to_array(lower(review_text), '[^\p{L}]+')) AS term
            FROM theme_texts) AS words
        WHERE length(term) >= 3 GROUP BY ALL""",
    "embedding_places": """
        SELECT CAST(vec_id AS VARCHAR) AS review_id, CAST(label AS INTEGER) AS cluster_id,
            generate_subscripts(embedding, 1) AS place, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings""",
    "theme_centres": "SELECT cluster_id, place, avg(x) AS mean FROM embedding_places GROUP BY 1, 2",
    "theme_distances": """
        SELECT review_id, e.cluster_id, sqrt(sum((x - mean) * (x - mean))) AS distance
        FROM embedding_places AS e JOIN theme_centres AS c ON e.cluster_id = c.cluster_id AND e.place = c.place
        GROUP BY 1, 2""",
    "letter_counts": """
        SELECT review_id, CAST(p AS INTEGER) AS place,
            length(lower(review_text)) - length(replace(lower(review_text), chr(97 + p::INTEGER), '')) AS n
        FROM stg_reviews, range(26) AS r(p)""",
    "theme_terms": """
        SELECT cluster_id, term, score, position FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, term) AS INTEGER) AS position
            FROM (SELECT cluster_id, term,
                    tf * ln(1 + (SELECT sum(tf) / count(DISTINCT cluster_id) FROM theme_words)
                        / sum(tf) OVER (PARTITION BY term)) AS score
                FROM theme_words) AS scored
        ) AS ranked WHERE position <= 10""",
    # -- a stored state and a later delivery, overlapping by half a year
    "orders_before": """
        SELECT * REPLACE (CASE WHEN order_status = 'delivered' THEN 'processing' ELSE order_status END AS order_status)
        FROM raw_orders WHERE order_purchase_timestamp < TIMESTAMP '1999-01-01'""",
    "orders_delivery_file": """
        SELECT * FROM raw_orders WHERE order_purchase_timestamp >= TIMESTAMP '1998-07-01'""",
    "fct_before": "SELECT * FROM fct_orders WHERE order_date < DATE '2001-01-01'",
    "customers_before": """
        SELECT customer_unique_id, max(order_date) AS last_order_date FROM fct_before GROUP BY 1""",
    "customers_now": """
        SELECT customer_unique_id, arg_max(customer_state, order_date || order_id) AS customer_state,
            arg_max(customer_city, order_date || order_id) AS customer_city,
            count(DISTINCT order_id) AS order_count, sum(total_payment_value) AS lifetime_value,
            min(order_date) AS first_order_date, max(order_date) AS last_order_date,
            avg(review_score) AS avg_review_score,
            CAST(sum(CASE WHEN is_delayed THEN 1 ELSE 0 END) AS BIGINT) AS delayed_orders,
            CAST(datediff('day', min(order_date), max(order_date)) AS INTEGER) AS customer_tenure_days
        FROM fct_orders GROUP BY 1""",
}


def _with_shared(text: str, shared: dict[str, str] = _SHARED) -> str:
    """Put the shared sub-results `text` needs, and those they need, in front of it."""
    needed: list[str] = []

    def visit(body: str) -> None:
        for name in shared:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", body):
                visit(shared[name])
                needed.append(name)

    visit(text)
    if not needed:
        return text
    return "WITH " + ",\n".join(f"{name} AS ({shared[name]})" for name in needed) + "\n" + text


def _money(table: str, *columns: str) -> str:
    rounded = ", ".join(f"round({c}, 4) AS {c}" for c in columns)
    return f"SELECT * REPLACE ({rounded}) FROM {table}"


_FACT_MONEY = ("total_payment_value", "total_item_price", "total_freight_value")

_NEW_LABEL = "CASE WHEN CAST(review_id AS BIGINT) % 17 = 3 THEN 'theme 10' ELSE cluster_label END"

_K_CHOICE = """SELECT CAST(unnest(range(3, 16)) AS INTEGER) AS k, true AS in_range, true AS chosen_is_best,
    true AS no_higher FROM (SELECT count(*) FROM embeddings)"""

_TEXTS: dict[str, str] = {
    # -- sources and sinks
    "s1_csv_scan": """SELECT CAST(review_id AS VARCHAR) AS review_id, CAST(order_id AS VARCHAR) AS order_id,
        CAST(review_score AS VARCHAR) AS review_score, review_comment_title, review_comment_message
        FROM raw_order_reviews""",
    "s2_layer_scan": "SELECT * FROM silver_order_items",
    "s3_variant_scan": _money("stg_fact_orders", *_FACT_MONEY),
    "s3_variant_products": _money("stg_dim_products", "price", "freight_value"),
    "s3_variant_reviews": "SELECT * FROM stg_reviews",
    "s4_initial_load": """SELECT order_status, count(*) AS orders, (SELECT count(*) FROM raw_orders) AS written
        FROM raw_orders GROUP BY 1""",
    "s5_exists_branch": """SELECT order_id, order_status, order_purchase_timestamp FROM orders_delivery_file
        UNION ALL SELECT order_id, order_status, order_purchase_timestamp FROM orders_before
        WHERE order_id NOT IN (SELECT order_id FROM orders_delivery_file)""",
    "s6_schema_replacement": "SELECT order_id, order_status, customer_id % 10 AS customer_group FROM raw_orders",
    "s7_refresh_external": "SELECT order_id, order_status FROM raw_orders",
    "s8_merge_source": """SELECT coalesce(c.cluster_label, 'waiting') AS cluster_label, count(*) AS reviews
        FROM stg_reviews AS r LEFT JOIN review_clusters AS c ON r.review_id = c.review_id GROUP BY 1""",
    "s9_create_if_absent": "SELECT * FROM review_clusters",
    "s10_lower_case_query": """SELECT o_orderstatus AS status, count(*) AS orders, max(o_orderdate) AS newest
        FROM orders GROUP BY 1""",
    # -- merges
    "m1_insert_only": """SELECT * FROM orders_before UNION ALL
        SELECT * FROM orders_delivery_file WHERE order_id NOT IN (SELECT order_id FROM orders_before)""",
    "m2_upsert": """SELECT * FROM orders_delivery_file UNION ALL
        SELECT * FROM orders_before WHERE order_id NOT IN (SELECT order_id FROM orders_delivery_file)""",
    "m2_bucketed_merge": """SELECT * FROM orders_delivery_file UNION ALL
        SELECT * FROM orders_before WHERE order_id NOT IN (SELECT order_id FROM orders_delivery_file)""",
    "m3_partial_upsert": """SELECT coalesce(e.order_id, i.order_id) AS order_id,
        CASE WHEN e.order_id IS NULL THEN i.customer_id ELSE e.customer_id END AS customer_id,
        CASE WHEN i.order_id IS NULL THEN e.order_status ELSE i.order_status END AS order_status
        FROM (SELECT order_id, 0 - customer_id AS customer_id, order_status FROM orders_before) AS e
        FULL JOIN (SELECT * FROM orders_delivery_file) AS i ON e.order_id = i.order_id""",
    "m4_mart_merge": _money("agg_daily_sales", "revenue", "freight_revenue"),
    "m5_new_columns": """SELECT coalesce(e.order_id, i.order_id) AS order_id,
        CASE WHEN i.order_id IS NULL THEN e.order_status ELSE i.order_status END AS order_status,
        e.customer_id, i.order_delivered_customer_date
        FROM (SELECT * FROM orders_before) AS e FULL JOIN (SELECT * FROM orders_delivery_file) AS i
        ON e.order_id = i.order_id""",
    "m6_repeated_keys": """SELECT order_id, order_item_id, count(*) AS "count" FROM raw_order_items
        GROUP BY 1, 2 HAVING count(*) > 1""",
    # -- silver
    "c1_clean_orders": "SELECT * FROM silver_orders",
    "c2_clean_order_items": "SELECT * FROM silver_order_items",
    "c3_clean_customers": "SELECT * FROM silver_customers",
    "c4_clean_products": "SELECT * FROM silver_products",
    "c5_clean_sellers": "SELECT * FROM silver_sellers",
    "c6_clean_order_payments": "SELECT * FROM silver_order_payments",
    "c7_clean_order_reviews": "SELECT * FROM silver_order_reviews",
    "c8_clean_geolocation": "SELECT * FROM silver_geolocation",
    "c8_touched_places": "SELECT * FROM silver_geolocation",
    "c9_clean_category_translation": "SELECT * FROM silver_category_translation",
    # -- gold
    "g1_payments_per_order": _money("payments_per_order", "total_payment_value"),
    "g2_items_per_order": _money("items_per_order", "total_item_price", "total_freight_value"),
    "g3_latest_review_per_order": "SELECT * FROM latest_reviews",
    "g4_order_delivery": "SELECT order_id, is_delayed, delivery_days FROM orders_delivery",
    "g5_fact_orders": _money("fact_orders", *_FACT_MONEY),
    "g6_products_with_category": "SELECT * FROM products_category",
    "g7_category_per_order": "SELECT * FROM category_per_order",
    "g8_review_texts": "SELECT * FROM review_texts",
    "g9_dim_products": _money("dim_products", "price", "freight_value"),
    # -- staging and marts
    "w1_stg_fact_orders": _money("stg_fact_orders", *_FACT_MONEY),
    "w2_stg_dim_products": _money("stg_dim_products", "price", "freight_value"),
    "w3_stg_reviews": "SELECT * FROM stg_reviews",
    "w4_fct_orders": _money("fct_orders", *_FACT_MONEY, "product_revenue"),
    "w4i_fct_orders_strict": _money("fct_orders", *_FACT_MONEY, "product_revenue"),
    "w4i_fct_orders_lookback": _money("fct_orders", *_FACT_MONEY, "product_revenue"),
    "w5_dim_customers": """SELECT customer_unique_id, customer_state, customer_city,
        count(DISTINCT order_id) AS order_count, round(sum(total_payment_value), 4) AS lifetime_value,
        min(order_date) AS first_order_date, max(order_date) AS last_order_date,
        avg(review_score) AS avg_review_score,
        CAST(sum(CASE WHEN is_delayed THEN 1 ELSE 0 END) AS BIGINT) AS delayed_orders,
        CAST(datediff('day', min(order_date), max(order_date)) AS INTEGER) AS customer_tenure_days
        FROM fct_orders GROUP BY 1, 2, 3""",
    "w5i_touched_customers": """SELECT * REPLACE (round(lifetime_value, 4) AS lifetime_value) FROM customers_now
        WHERE last_order_date >= (SELECT max(last_order_date) FROM customers_before)""",
    "w5i_dim_customers": _money("customers_now", "lifetime_value"),
    "w6_agg_daily_sales": _money("agg_daily_sales", "revenue", "freight_revenue"),
    "w6i_agg_daily_sales": _money("agg_daily_sales", "revenue", "freight_revenue"),
    "w7_agg_category_sales": _money("agg_category_sales", "revenue", "freight_total"),
    "w7i_agg_category_sales": _money("agg_category_sales", "revenue", "freight_total"),
    "w4i_late": _money("fct_orders", *_FACT_MONEY, "product_revenue"),
    "w5i_late": _money("customers_now", "lifetime_value"),
    "w6i_late": _money("agg_daily_sales", "revenue", "freight_revenue"),
    "w7i_late": _money("agg_category_sales", "revenue", "freight_total"),
    "w8_agg_seller_performance": """SELECT category_en, product_category_name,
        CAST(sum(order_count) AS BIGINT) AS total_orders, round(sum(revenue), 4) AS total_revenue,
        round(avg(avg_review_score), 8) AS avg_review_score, count(DISTINCT order_month) AS active_months,
        round(sum(revenue) / nullif(count(DISTINCT order_month), 0), 4) AS avg_monthly_revenue
        FROM agg_category_sales GROUP BY 1, 2""",
    # -- dashboard
    "q1_monthly_revenue": """SELECT order_month, order_year, round(sum(revenue), 4) AS revenue,
        order_year || '-' || lpad(CAST(order_month AS VARCHAR), 2, '0') AS period
        FROM agg_daily_sales GROUP BY 1, 2 ORDER BY order_year, order_month""",
    "q2_top_categories": """SELECT category_en, round(sum(revenue), 4) AS total_revenue,
        CAST(sum(order_count) AS BIGINT) AS total_orders, round(avg(avg_review_score), 8) AS avg_score
        FROM agg_category_sales WHERE category_en IS NOT NULL GROUP BY 1
        ORDER BY sum(revenue) DESC NULLS FIRST, category_en LIMIT 15""",
    "q3_delay_by_state": """SELECT customer_state, count(DISTINCT order_id) AS order_count,
        round(avg(CASE WHEN is_delayed THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS delay_rate
        FROM fct_orders GROUP BY 1 ORDER BY order_count DESC NULLS FIRST, customer_state NULLS LAST LIMIT 10""",
    "q4_theme_scatter": """SELECT tsne_x, tsne_y, cluster_label, cluster_summary, category_en
        FROM review_clusters AS c JOIN stg_reviews AS r ON c.review_id = r.review_id""",
    "q5_theme_sizes": """SELECT cluster_label, cluster_summary, count(*) AS review_count
        FROM review_clusters GROUP BY 1, 2 ORDER BY review_count DESC, cluster_label""",
    "q6_rfm_segments": "SELECT * FROM rfm",
    "q6_rfm_customers": """SELECT customer_unique_id, r, f,
        CASE WHEN r = 1 AND f = 3 THEN 'Champions' WHEN r = 1 THEN 'Recent' WHEN f = 3 THEN 'Loyal'
            ELSE 'Others' END AS rfm_segment
        FROM (SELECT customer_unique_id,
            CAST(ntile(3) OVER (ORDER BY max(order_date) DESC NULLS FIRST, customer_unique_id NULLS LAST) AS INTEGER) AS r,
            CAST(ntile(3) OVER (ORDER BY count(*), customer_unique_id NULLS LAST) AS INTEGER) AS f
            FROM fct_orders GROUP BY 1) AS tiled""",
    "q7_segment_themes": """SELECT rfm_segment, cluster_label, count(*) AS cnt
        FROM review_clusters AS c JOIN rfm ON c.order_id = rfm.order_id GROUP BY 1, 2""",
    "q8_segment_theme_matrix": "SELECT rfm_segment, "
    + ", ".join(
        f"CAST(count(CASE WHEN {_NEW_LABEL} = 'theme {i}' THEN 1 END) AS BIGINT) AS \"theme {i}\"" for i in range(11)
    )
    + """ FROM review_clusters AS c JOIN rfm ON c.order_id = rfm.order_id
        WHERE CAST(review_id AS BIGINT) % 3 > 0 GROUP BY 1""",
    # -- relational building blocks
    "p1_keyed_dedupe": "SELECT * FROM silver_order_payments",
    "p2_null_row_drop": """SELECT product_id, product_category_name FROM raw_products
        WHERE product_category_name IS NOT NULL""",
    "p3_comparison_filter": """SELECT order_id, order_item_id, price, freight_value FROM raw_order_items
        WHERE price > 50000 AND freight_value >= 100 AND seller_id <> 7""",
    "p4_range_filter": """SELECT review_id, review_score FROM raw_order_reviews WHERE review_score BETWEEN 2 AND 4""",
    "p5_null_predicates": """SELECT order_status, count(*) AS orders FROM raw_orders
        WHERE order_approved_at IS NULL AND order_delivered_customer_date IS NOT NULL GROUP BY 1""",
    "p6_projection": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS total FROM orders""",
    "p7_derived_columns": """SELECT order_id, order_item_id, price + freight_value AS gross,
        price > 50000 AS expensive FROM raw_order_items""",
    "p8_named_subresults": """SELECT order_status, count(*) AS orders,
        count(*) * 1.0::DOUBLE / (SELECT count(*) FROM raw_orders) AS share FROM raw_orders GROUP BY 1""",
    "j1_left_join": """SELECT o.order_id, o.customer_id, c.customer_unique_id, c.customer_city
        FROM raw_orders AS o LEFT JOIN silver_customers AS c ON o.customer_id = c.customer_id""",
    "j2_inner_join": """SELECT o.order_id, i.product_id, i.price FROM silver_orders AS o
        JOIN silver_order_items AS i ON o.order_id = i.order_id""",
    "j3_anti_join": """SELECT review_id FROM stg_reviews
        WHERE review_id NOT IN (SELECT review_id FROM review_clusters)""",
    "j4_matched_count": """SELECT r.category_en, count(r.review_id) AS total, count(c.review_id) AS processed
        FROM stg_reviews AS r LEFT JOIN review_clusters AS c ON r.review_id = c.review_id GROUP BY 1""",
    "j5_one_row_cutoff": """SELECT order_id, order_purchase_timestamp FROM raw_orders
        WHERE order_purchase_timestamp >= (SELECT max(order_purchase_timestamp) - to_days(30) FROM raw_orders)""",
    "j6_merge_match": """SELECT CASE WHEN e.order_id IS NULL THEN 'inserted' WHEN i.order_id IS NULL THEN 'kept'
        ELSE 'updated' END AS outcome, count(*) AS orders
        FROM (SELECT order_id FROM orders_before) AS e FULL JOIN (SELECT order_id FROM orders_delivery_file) AS i
        ON e.order_id = i.order_id GROUP BY 1""",
    "a0_group_aggregates": """SELECT order_status, count(*) AS orders, count(order_approved_at) AS approved,
        min(order_purchase_timestamp) AS first_order, max(order_purchase_timestamp) AS last_order,
        CAST(sum(customer_id) AS BIGINT) AS id_sum, avg(customer_id) AS id_avg FROM raw_orders GROUP BY 1""",
    "a1_count_distinct": """SELECT order_status, count(DISTINCT customer_id) AS customers FROM raw_orders GROUP BY 1""",
    "a2_conditional_rate": """SELECT order_status,
        CAST(sum(CASE WHEN order_approved_at < order_purchase_timestamp THEN 1 ELSE 0 END) AS BIGINT) AS early,
        round(avg(CASE WHEN order_approved_at < order_purchase_timestamp THEN 1.0::DOUBLE ELSE 0 END) * 100, 1) AS early_rate
        FROM raw_orders GROUP BY 1""",
    "a2b_median": """SELECT seller_id, quantile_disc(price, 0.5) AS median_price FROM raw_order_items GROUP BY 1""",
    "a2c_first_value": "SELECT order_id, primary_payment_type FROM payments_per_order",
    "a2d_average_of_averages": """SELECT category_en, round(avg(avg_review_score), 8) AS mean_score,
        count(DISTINCT order_month) AS active_months FROM agg_category_sales GROUP BY 1""",
    "a3_global_ntile": """SELECT order_id, CAST(ntile(7) OVER (
        ORDER BY order_purchase_timestamp DESC NULLS FIRST, order_id) AS INTEGER) AS tile FROM raw_orders""",
    "a3_global_rank": """SELECT order_id, order_item_id, row_number() OVER (
        ORDER BY order_id, order_item_id) AS "rank" FROM silver_order_items""",
    "a4_top_one_per_group": """SELECT customer_id, order_id, order_purchase_timestamp FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_id
            ORDER BY order_purchase_timestamp DESC, order_id) AS pick FROM raw_orders) AS ranked WHERE pick = 1""",
    "a5_texts_per_cluster": """SELECT cluster_id, review_id, review_text, position FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id
            ORDER BY review_creation_date, review_id) AS INTEGER) AS position FROM theme_texts) AS ranked
        WHERE position <= 10""",
    "o1_order_by": """SELECT order_id, order_approved_at FROM raw_orders
        ORDER BY order_approved_at DESC NULLS LAST, order_id""",
    "o2_top_k": """SELECT order_id, order_item_id, price FROM silver_order_items
        ORDER BY price DESC, order_id, order_item_id LIMIT 1000""",
    "u1_union": """SELECT order_id, order_status, customer_id FROM orders_before
        UNION ALL SELECT order_id, order_status, NULL AS customer_id FROM orders_delivery_file""",
    # -- scalar functions
    "f1_trim_case": """SELECT customer_id, lower(trim(customer_city)) AS city, upper(trim(customer_state)) AS state
        FROM raw_customers""",
    "f2_zip_prefix": """SELECT o_orderkey, CASE WHEN length(CAST(o_orderkey * 37 AS VARCHAR)) < 5 THEN lpad(CAST(o_orderkey * 37 AS VARCHAR), 5, '0') ELSE CAST(o_orderkey * 37 AS VARCHAR) END AS zip FROM orders""",
    "f3_nullif": """SELECT conv_id, turn, nullif(trim(replace(text, 'a', ' ')), '') AS text,
        nullif(turn, 0) AS later_turn FROM conversations""",
    "f4_coalesce": """SELECT product_id, coalesce(product_category_name, 'unknown') AS category FROM raw_products""",
    "f5_case_when": """SELECT review_id, CASE WHEN review_score >= 4 THEN 'positive' WHEN review_score = 3 THEN 'neutral'
        ELSE 'negative' END AS sentiment, CASE WHEN review_score > 0 THEN review_score END AS valid_score
        FROM raw_order_reviews""",
    "f6_length": "SELECT doc_id, length(text) AS chars, length(text) > 10 AS long_enough FROM documents",
    "f7_safe_cast": """SELECT event_id, try_cast(event_type AS INTEGER) AS bad_int,
        try_cast(CAST(value AS VARCHAR) AS DOUBLE) AS value, try_cast(CAST(ts AS VARCHAR) AS TIMESTAMP) AS ts,
        try_cast(props AS TIMESTAMP) AS bad_ts FROM events""",
    "f8_variant_path": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
        CAST(NULL AS VARCHAR) AS missing FROM events""",
    "f9_date_parts": """SELECT event_id, CAST(ts AS DATE) AS day, CAST(year(ts) AS INTEGER) AS year,
        CAST(month(ts) AS INTEGER) AS month FROM events""",
    "f10_datediff": """SELECT order_id, CAST(datediff('day', order_purchase_timestamp, order_delivered_customer_date) AS INTEGER)
        AS days FROM raw_orders""",
    "f11_day_before": """SELECT order_id, CAST(order_purchase_timestamp - to_days(1) AS DATE) AS day_before FROM raw_orders""",
    "f12_arithmetic": """SELECT order_id, CAST(year(order_purchase_timestamp) * 100 + month(order_purchase_timestamp) AS INTEGER) AS yyyymm,
        CAST(year(order_purchase_timestamp) * 12 + month(order_purchase_timestamp) - 1 AS INTEGER) AS month_index,
        customer_id / nullif(order_id, 0) AS ratio FROM raw_orders""",
    "f13_round": "SELECT p_partkey, round(p_retailprice / 8, 1) AS eighth FROM part",
    "f14_period": """SELECT order_id, year(order_purchase_timestamp) || '-' ||
        lpad(CAST(month(order_purchase_timestamp) AS VARCHAR), 2, '0') AS period FROM raw_orders""",
    "f15_boolean_logic": """SELECT order_id, (order_approved_at IS NULL OR order_approved_at >= order_purchase_timestamp)
        AND NOT (order_status = 'processing') AS usable FROM raw_orders""",
    # -- themes
    "t1_backlog_counts": """SELECT count(r.review_id) AS total, count(c.review_id) AS processed,
        count(r.review_id) - count(c.review_id) AS unprocessed
        FROM stg_reviews AS r LEFT JOIN review_clusters AS c ON r.review_id = c.review_id""",
    "t2_next_batch": """SELECT review_id, order_id, review_score, review_text, review_creation_date FROM stg_reviews
        WHERE review_id NOT IN (SELECT review_id FROM review_clusters)
        ORDER BY review_creation_date NULLS LAST, review_id""",
    "t3_early_exit": """SELECT count(r.review_id) = count(c.review_id) AS nothing_to_do
        FROM stg_reviews AS r LEFT JOIN review_clusters AS c ON r.review_id = c.review_id""",
    "t4_embed_texts": "SELECT review_id, 1.0::DOUBLE AS norm, true AS same_for_same_words FROM stg_reviews",
    "t5_projection": """SELECT 'rows' AS "check", count(*) AS failures FROM embeddings
        UNION ALL SELECT unnest(['coordinates that are not the product with the axes', 'axes not orthonormal',
            'places where an axis is no eigenvector', 'two places vary more than the plane']), 0""",
    "t6_kmeans": """SELECT 'rows' AS "check", count(*) AS failures FROM embeddings
        UNION ALL SELECT 'clusters', 10
        UNION ALL SELECT unnest(['rows not in the nearest cluster', 'dearer than the given labels']), 0""",
    "t7_choose_k_sample": _K_CHOICE,
    "t7_choose_k_all_rows": _K_CHOICE,
    "t7_silhouette": """WITH points AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        sample AS (SELECT * FROM points ORDER BY md5('42:' || vec_id), vec_id LIMIT 300),
        means AS (
            SELECT s.vec_id, s.label, p.label = s.label AS own,
                sum(list_distance(s.v, p.v)) AS total, count(*) AS n
            FROM sample AS s, points AS p GROUP BY s.vec_id, s.label, p.label),
        told AS (
            SELECT vec_id, label, coalesce(max(CASE WHEN own AND n > 1 THEN total / (n - 1) END), 0) AS within,
                min(CASE WHEN NOT own THEN total / n END) AS nearest, max(CASE WHEN own THEN n END) AS size
            FROM means GROUP BY vec_id, label)
        SELECT vec_id AS review_id, CAST(label AS INTEGER) AS label, round(within, 5) AS within, round(nearest, 5) AS nearest,
            round(CASE WHEN size > 1 THEN (nearest - within) / greatest(nearest, within) ELSE 0 END, 5) AS silhouette
        FROM told""",
    "t9_assign_clusters": "SELECT vec_id AS review_id, true AS in_nearest FROM embeddings",
    "t10_nearest_texts": """SELECT cluster_id, review_id, review_text, position FROM (
            SELECT cluster_id, d.review_id, review_text,
                CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY distance, d.review_id) AS INTEGER) AS position
            FROM theme_distances AS d JOIN stg_reviews AS r ON r.review_id = d.review_id) AS ranked
        WHERE position <= 10""",
    "t14_review_themes": """SELECT review_id, order_id, cluster_label AS kept_label, true AS complete FROM review_clusters
        UNION ALL SELECT review_id, order_id, NULL, true FROM stg_reviews
        WHERE review_id NOT IN (SELECT review_id FROM review_clusters)""",
    "r3_encoder": """SELECT review_id, place,
        round(coalesce(n / nullif(sqrt(sum(n * n) OVER (PARTITION BY review_id)), 0), 0), 8) AS weight FROM letter_counts""",
    "t8_k_range": """SELECT unnest(range(3, least(15, greatest(3, count(*) // 20)) + 1)) AS k FROM embeddings""",
    "t10_representative_texts": """SELECT cluster_id, review_id, review_text, position FROM (
        SELECT *, CAST(row_number() OVER (PARTITION BY cluster_id
            ORDER BY review_creation_date NULLS LAST, review_id) AS INTEGER) AS position FROM theme_texts) AS ranked
        WHERE position <= 10""",
    "t11_cluster_terms": "SELECT * REPLACE (round(score, 6) AS score) FROM theme_terms",
    "t11_cluster_labels": """SELECT cluster_id,
        string_agg(CASE WHEN position <= 3 THEN term END, ' / ' ORDER BY position) AS cluster_label,
        string_agg(term, ', ' ORDER BY position) AS cluster_summary
        FROM theme_terms GROUP BY 1""",
    "t12_attach_labels": """SELECT c.review_id, c.cluster_id, l.cluster_label FROM review_clusters AS c LEFT JOIN (
        SELECT cluster_id, string_agg(CASE WHEN position = 1 THEN term END, '') AS cluster_label
        FROM theme_terms GROUP BY 1) AS l ON c.cluster_id = l.cluster_id""",
    "t13_write_back": """SELECT review_id, order_id, cluster_id + 100 AS cluster_id, cluster_label, cluster_summary,
        tsne_x, tsne_y FROM review_clusters""",
    # -- quality checks
    "d1_not_null": """SELECT 'not_null:raw_orders.order_id' AS "check",
            (SELECT count(*) FROM raw_orders WHERE order_id IS NULL) AS failures
        UNION ALL SELECT 'not_null:raw_orders.order_approved_at',
            (SELECT count(*) FROM raw_orders WHERE order_approved_at IS NULL)""",
    "d2_unique": """SELECT 'unique:raw_order_items.order_id' AS "check", count(*) AS failures FROM (
        SELECT order_id FROM raw_order_items WHERE order_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) AS repeated""",
    "d3_check_report": """SELECT 'not_null:fct_orders.order_id' AS "check",
            (SELECT count(*) FROM fct_orders WHERE order_id IS NULL) AS failures
        UNION ALL SELECT 'not_null:fct_orders.order_status',
            (SELECT count(*) FROM fct_orders WHERE order_status IS NULL)
        UNION ALL SELECT 'unique:fct_orders.order_id', (SELECT count(*) FROM (
            SELECT order_id FROM fct_orders GROUP BY 1 HAVING count(*) > 1) AS a)
        UNION ALL SELECT 'not_null:dim_customers.customer_unique_id',
            (SELECT count(*) FROM fct_orders WHERE customer_unique_id IS NULL)
        UNION ALL SELECT 'not_null:agg_daily_sales.order_date',
            (SELECT count(*) FROM agg_daily_sales WHERE order_date IS NULL)
        UNION ALL SELECT 'unique:agg_daily_sales.order_date', (SELECT count(*) FROM (
            SELECT order_date FROM agg_daily_sales GROUP BY 1 HAVING count(*) > 1) AS b)""",
    "d4_row_counts": """SELECT 'silver.' || t AS "table", n AS rows FROM (
        SELECT 'orders' AS t, count(*) AS n FROM silver_orders
        UNION ALL SELECT 'order_items', count(*) FROM silver_order_items
        UNION ALL SELECT 'customers', count(*) FROM silver_customers
        UNION ALL SELECT 'products', count(*) FROM silver_products
        UNION ALL SELECT 'sellers', count(*) FROM silver_sellers
        UNION ALL SELECT 'order_payments', count(*) FROM silver_order_payments
        UNION ALL SELECT 'order_reviews', count(*) FROM silver_order_reviews
        UNION ALL SELECT 'geolocation', count(*) FROM silver_geolocation
        UNION ALL SELECT 'category_translation', count(*) FROM silver_category_translation) AS counts""",
    # -- streaming and the whole refresh
    "r1_stream_ingest": """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
        order_status FROM orders_before UNION ALL
        SELECT CAST(order_id AS VARCHAR), CAST(customer_id AS VARCHAR), order_status FROM orders_delivery_file
        WHERE order_id NOT IN (SELECT order_id FROM orders_before)""",
    "r1_stream_watermark": """SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
        order_status, order_purchase_timestamp FROM orders_before WHERE order_id % 11 <> 0
        UNION ALL SELECT CAST(order_id AS VARCHAR), CAST(customer_id AS VARCHAR), order_status, order_purchase_timestamp
        FROM (SELECT * FROM orders_delivery_file UNION ALL SELECT * FROM orders_before WHERE order_id % 11 = 0
                AND order_id NOT IN (SELECT order_id FROM orders_delivery_file)) AS second
        WHERE order_id NOT IN (SELECT order_id FROM orders_before WHERE order_id % 11 <> 0)
            AND order_purchase_timestamp > (SELECT max(order_purchase_timestamp) - to_days(90)
                FROM orders_before WHERE order_id % 11 <> 0)""",
}

# In files every id is text, so copies of a key are told apart in the order of text.
_AS_TEXT = {
    "raw_orders": {"order_id", "customer_id"},
    "raw_order_items": {"order_id", "order_item_id", "product_id", "seller_id"},
    "raw_order_payments": {"order_id"},
    "raw_customers": {"customer_id", "customer_unique_id"},
    "raw_sellers": {"seller_id"},
    "raw_products": {"product_id"},
    "raw_order_reviews": {"review_id", "order_id"},
}

# What each stored table is summed by: where it stands in SQL, and the measure.
_REFRESH_SUMS = {
    "silver.orders": ("silver_orders", "datediff('day', DATE '1990-01-01', CAST(order_purchase_timestamp AS DATE))"),
    "silver.order_items": ("silver_order_items", "price + freight_value"),
    "silver.customers": ("silver_customers", "length(customer_city)"),
    "silver.products": ("silver_products", "product_name_lenght"),
    "silver.sellers": ("silver_sellers", "length(seller_city)"),
    "silver.order_payments": ("silver_order_payments", "payment_value"),
    "silver.order_reviews": ("silver_order_reviews", "review_score"),
    "silver.geolocation": ("silver_geolocation", "geolocation_lat + geolocation_lng"),
    "silver.geolocation_points": ("geolocation_points", "geolocation_lat + geolocation_lng"),
    "silver.category_translation": ("silver_category_translation", "length(product_category_name_english)"),
    "gold.fact_orders": ("fact_orders", "total_payment_value"),
    "gold.review_texts": ("review_texts", "length(text)"),
    "gold.dim_products": ("dim_products", "price"),
    "mart.fct_orders": ("fct_orders", "product_revenue"),
    "mart.dim_customers": ("(SELECT sum(total_payment_value) AS value FROM fct_orders GROUP BY customer_unique_id) AS d", "value"),
    "mart.agg_daily_sales": ("agg_daily_sales", "revenue"),
    "mart.agg_category_sales": ("agg_category_sales", "revenue"),
    "mart.agg_seller_performance": (
        "(SELECT sum(order_count) AS value FROM agg_category_sales GROUP BY category_en, product_category_name) AS p", "value"
    ),
    "mart.review_clusters": ("stg_reviews", "0"),
}


def _full_refresh(leaving_out: str = "") -> str:
    parts = [
        f"""SELECT '{table}' AS "table", count(*) AS rows, round(coalesce(CAST(sum({measure}) AS DOUBLE), 0), 2) AS total
            FROM {source}"""
        for table, (source, measure) in _REFRESH_SUMS.items()
        if table != leaving_out
    ]
    shared = dict(_SHARED)
    for name, ids in _AS_TEXT.items():
        replaced = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in sorted(ids))
        shared[name] = f"SELECT * REPLACE ({replaced}) FROM ({_SHARED[name]}) AS numbered"
    return _with_shared(" UNION ALL ".join(parts), shared)


def oracle_texts() -> dict[str, str]:
    return {name: _with_shared(text) for name, text in _TEXTS.items()} | {
        "r2_full_refresh": _full_refresh(),
        "r2_two_deliveries": _full_refresh(leaving_out="mart.review_clusters"),
    }
