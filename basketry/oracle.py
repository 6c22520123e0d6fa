"""SQL equivalents of the registered queries, for DuckDB on the same Parquet tables.

The statements spell the definitions out (DISTINCT counts, line-by-review joins, windows
over whole persons) instead of mirroring the reductions of the Spark plans, so the two
sides check each other. Decimal results are cast to DOUBLE on both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

_RAW = """
raw_customers AS (
    SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
           CAST(c_custkey - CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END AS VARCHAR)
               AS customer_unique_id,
           n_name AS customer_state
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
),
raw_orders AS (
    SELECT CAST(o_orderkey AS VARCHAR) AS order_id,
           CAST(o_custkey AS VARCHAR) AS customer_id,
           CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'P' THEN 'canceled'
                              WHEN 'O' THEN 'shipped' END AS order_status,
           o_orderdate AS purchased,
           CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate + INTERVAL 7 DAY END AS delivered_on
    FROM orders
),
raw_items AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
           l_linenumber AS order_item_id,
           CAST(l_partkey AS VARCHAR) AS product_id,
           CAST(l_suppkey AS VARCHAR) AS seller_id,
           CAST(l_extendedprice AS DECIMAL(10, 2)) AS price,
           CAST(l_quantity AS DECIMAL(10, 2)) AS freight
    FROM lineitem
),
raw_payments AS (
    SELECT CASE WHEN o_orderkey % 1000 <> 7 THEN CAST(o_orderkey AS VARCHAR) END AS order_id,
           o_orderpriority AS payment_type,
           CAST(o_totalprice AS DECIMAL(10, 2)) AS payment_value
    FROM orders
),
raw_reviews AS (
    SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
           CASE WHEN l_discount <> 0 THEN 1 + CAST(l_quantity AS INTEGER) % 5 END AS score
    FROM lineitem
),
raw_products AS (
    SELECT CAST(p_partkey AS VARCHAR) AS product_id,
           CASE WHEN p_size <> 50 THEN CAST(p_size AS VARCHAR) END AS category
    FROM part
),
raw_sellers AS (
    SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, n_name AS seller_state
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
),
raw_translation AS (
    SELECT CAST(n_nationkey AS VARCHAR) AS category, n_name AS english FROM nation
)"""

_FEATURES = """
shop_products AS (
    SELECT product_id, COALESCE(category, '{unknown}') AS category FROM raw_products
),
sold AS (
    SELECT customer_unique_id, customer_state, order_id, purchased, product_id, seller_id,
           price, price + freight AS paid
    FROM raw_items
    JOIN raw_orders USING (order_id)
    JOIN raw_customers USING (customer_id)
    WHERE order_status = 'delivered'
),
spend AS (
    SELECT customer_unique_id,
           COUNT(DISTINCT order_id) AS order_count,
           SUM(paid) AS total_value,
           CAST(SUM(paid) AS DOUBLE) / COUNT(paid) AS avg_item_value,
           MIN(purchased) AS first_purchase,
           MAX(purchased) AS last_purchase
    FROM sold GROUP BY customer_unique_id
),
rfm AS (
    SELECT customer_unique_id, order_count,
           DATE_DIFF('day', last_purchase, (SELECT MAX(purchased) FROM raw_orders))
               AS recency_days,
           total_value, avg_item_value
    FROM spend
),
baskets AS (
    SELECT customer_unique_id, order_id, purchased, SUM(paid) AS order_value
    FROM sold GROUP BY ALL
),
changes AS (
    SELECT *, LAG(order_value) OVER (PARTITION BY customer_unique_id
                                     ORDER BY purchased, order_id) AS previous_value
    FROM baskets
),
trend AS (
    SELECT customer_unique_id,
           CAST(SUM(order_value - previous_value) AS DOUBLE)
               / NULLIF(COUNT(order_value - previous_value), 0) AS basket_trend
    FROM changes GROUP BY customer_unique_id
),
satisfied AS (
    SELECT customer_unique_id,
           CAST(SUM(score) AS DOUBLE) / NULLIF(COUNT(score), 0) AS avg_review_score,
           100.0 * COUNT(*) FILTER (WHERE score <= 2) / COUNT(*) AS negative_review_pct
    FROM raw_reviews JOIN raw_orders USING (order_id) JOIN raw_customers USING (customer_id)
    GROUP BY customer_unique_id
),
varied AS (
    SELECT customer_unique_id, COUNT(DISTINCT category) AS category_count
    FROM sold JOIN shop_products USING (product_id)
    GROUP BY customer_unique_id
),
features AS (
    SELECT customer_unique_id, order_count, recency_days,
           CAST(total_value AS DOUBLE) AS total_value, avg_item_value,
           COALESCE(basket_trend, 0.0) AS basket_trend,
           COALESCE(avg_review_score, 0.0) AS avg_review_score,
           CAST(COALESCE(negative_review_pct, 0.0) AS DOUBLE) AS negative_review_pct,
           COALESCE(category_count, 0) AS category_count
    FROM rfm
    LEFT JOIN trend USING (customer_unique_id)
    LEFT JOIN satisfied USING (customer_unique_id)
    LEFT JOIN varied USING (customer_unique_id)
),
segmented AS (
    SELECT *,
           CASE
               WHEN recency_days < 90 AND order_count > 1 AND total_value > {high_value}
                   THEN 'Champion'
               WHEN recency_days < 90 AND (order_count > 1 OR total_value > {high_value})
                   THEN 'Fidele'
               WHEN recency_days < 90 THEN 'Nouveau'
               WHEN order_count > 1 THEN 'En danger'
               WHEN recency_days > 300 THEN 'Perdu'
               ELSE 'A risque'
           END AS segment
    FROM features
),
months AS (
    SELECT YEAR(purchased) AS year, CAST(DATE_TRUNC('month', purchased) AS TIMESTAMP) AS month,
           COUNT(*) AS item_line_count, SUM(paid) AS revenue
    FROM (SELECT purchased, price + freight AS paid
          FROM raw_orders JOIN raw_items USING (order_id)
          WHERE order_status = 'delivered')
    GROUP BY ALL
),
states AS (
    SELECT customer_state, COUNT(DISTINCT customer_unique_id) AS customer_count,
           CAST(SUM(paid) AS DOUBLE) / COUNT(paid) AS avg_item_value
    FROM sold GROUP BY customer_state
),
scores AS (
    SELECT score AS review_score, COUNT(*) AS review_count
    FROM raw_reviews WHERE score IS NOT NULL GROUP BY score
),
payments AS (
    SELECT payment_type, COUNT(*) AS payment_count, CAST(SUM(payment_value) AS DOUBLE) AS total_value
    FROM raw_payments GROUP BY payment_type
),
best_sellers AS (
    SELECT seller_id, seller_state, COUNT(DISTINCT order_id) AS order_count,
           SUM(price) AS revenue,
           CAST(SUM(score) AS DOUBLE) / NULLIF(COUNT(score), 0) AS avg_review_score
    FROM raw_items
    JOIN raw_orders USING (order_id)
    JOIN raw_sellers USING (seller_id)
    LEFT JOIN raw_reviews USING (order_id)
    WHERE order_status = 'delivered'
    GROUP BY seller_id, seller_state
    ORDER BY revenue DESC, seller_id LIMIT 10
),
categories AS (
    SELECT COALESCE(english, category) AS category,
           COUNT(DISTINCT order_id) AS order_count, CAST(SUM(price) AS DOUBLE) AS revenue
    FROM raw_items
    JOIN raw_orders USING (order_id)
    JOIN shop_products USING (product_id)
    LEFT JOIN raw_translation USING (category)
    WHERE order_status = 'delivered'
    GROUP BY 1
),
mean_score AS (
    SELECT CAST(SUM(review_score * review_count) AS DOUBLE) / SUM(review_count) AS mean_score
    FROM scores
)"""


def _kpi_row(months: str, days: int) -> str:
    return f"""
    SELECT (SELECT COALESCE(CAST(SUM(revenue) AS DOUBLE), 0) FROM ({months})) AS revenue,
           COUNT(*) AS customer_count,
           (SELECT COALESCE(CAST(SUM(item_line_count) AS BIGINT), 0) FROM ({months})) AS item_line_count,
           100.0::DOUBLE * COUNT(*) FILTER (WHERE recency_days > {days}) / COUNT(*) AS churn_pct,
           (SELECT mean_score FROM mean_score) AS mean_score
    FROM features"""


def _text(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _values(rows: Sequence[Sequence[object]]) -> str:
    return ", ".join(
        "(" + ", ".join(str(v) if isinstance(v, int) else _text(v) for v in row) + ")"
        for row in rows
    )


def statements(
    not_null: dict[str, list[str]],
    high_value: int,
    years: Sequence[int],
    no_years: Sequence[int],
    sample: int,
    view_columns: dict[str, str],
    payment_kind: str,
    unknown: str,
    actions: Sequence[Sequence[object]],
    anomalies: Sequence[Sequence[object]],
    customers: Sequence[str],
) -> dict[str, str]:
    chosen = ", ".join(map(str, years))
    in_years = f"SELECT * FROM months WHERE year IN ({chosen})"
    in_none = f"SELECT * FROM months WHERE year IN ({', '.join(map(str, no_years))})"
    published = ", ".join(f"{a} AS {b}" for a, b in view_columns.items())
    timeline = "SELECT year, month, item_line_count, CAST(revenue AS DOUBLE) AS revenue"
    features = {
        "basic_features": """
            SELECT customer_unique_id, order_count, CAST(total_value AS DOUBLE) AS total_value,
                   avg_item_value, first_purchase, last_purchase FROM spend""",
        "basic_features_preview": """
            SELECT customer_unique_id, order_count, CAST(total_value AS DOUBLE) AS total_value,
                   avg_item_value, first_purchase, last_purchase
            FROM spend ORDER BY customer_unique_id LIMIT 10""",
        "basket_changes": """
            SELECT customer_unique_id, order_id, purchased AS order_purchase_timestamp,
                   CAST(order_value AS DOUBLE) AS order_value,
                   CAST(previous_value AS DOUBLE) AS previous_value,
                   CAST(order_value - previous_value AS DOUBLE) AS basket_change
            FROM changes""",
        "customer_rank": """
            SELECT customer_unique_id, CAST(total_value AS DOUBLE) AS total_value,
                   RANK() OVER (ORDER BY total_value DESC) AS customer_rank FROM spend""",
        "rfm_base": """
            SELECT customer_unique_id, order_count, recency_days,
                   CAST(total_value AS DOUBLE) AS total_value, avg_item_value FROM rfm""",
        "basket_trend": "SELECT customer_unique_id, basket_trend FROM trend",
        "satisfaction": """
            SELECT customer_unique_id, avg_review_score,
                   CAST(negative_review_pct AS DOUBLE) AS negative_review_pct FROM satisfied""",
        "diversity": "SELECT customer_unique_id, category_count FROM varied",
        "customer_features": "SELECT * FROM features",
        "customer_features_first10": "SELECT * FROM features ORDER BY customer_unique_id LIMIT 10",
        "order_ledger": """
            SELECT o.order_id, order_status, COALESCE(line_count, 0) AS line_count,
                   CAST(value AS DOUBLE) AS order_value, CAST(paid AS DOUBLE) AS paid_value,
                   CAST(paid - value AS DOUBLE) AS difference, COALESCE(review_count, 0) AS review_count,
                   mean_score
            FROM raw_orders AS o
            LEFT JOIN (SELECT order_id, COUNT(*) AS line_count, SUM(price + freight) AS value
                       FROM raw_items GROUP BY order_id) USING (order_id)
            LEFT JOIN (SELECT order_id, SUM(payment_value) AS paid FROM raw_payments GROUP BY order_id)
            USING (order_id)
            LEFT JOIN (SELECT order_id, COUNT(*) AS review_count,
                              CAST(SUM(score) AS DOUBLE) / NULLIF(COUNT(score), 0) AS mean_score
                       FROM raw_reviews GROUP BY order_id) USING (order_id)""",
        "orders_lookup": f"""
            SELECT order_id, customer_id, order_status, purchased AS order_purchase_timestamp
            FROM raw_orders
            WHERE order_status = 'delivered' AND customer_id IN ({", ".join(map(_text, customers))})""",
        "customer_features_published": f"SELECT {published} FROM features",
        "monthly_timeline": f"{timeline} FROM months",
        "monthly_timeline_years": f"{timeline} FROM ({in_years})",
        "active_years": "SELECT DISTINCT year FROM months",
        "by_state": "SELECT * FROM states",
        "by_state_top": """
            SELECT * FROM states ORDER BY customer_count DESC, customer_state LIMIT 10""",
        "review_scores": """
            SELECT review_score, review_count,
                   100.0::DOUBLE * review_count / (SELECT SUM(review_count) FROM scores)
                       AS share_pct
            FROM scores""",
        "mean_review": "SELECT mean_score FROM mean_score",
        "payment_types": """
            SELECT payment_type, payment_count, total_value,
                   100.0::DOUBLE * payment_count / (SELECT SUM(payment_count) FROM payments)
                       AS share_pct
            FROM payments""",
        "payment_share": f"""
            SELECT payment_type, share_pct, FORMAT('{{:.0f}}%', share_pct) AS share_text
            FROM (SELECT {_text(payment_kind)} AS payment_type,
                         100.0::DOUBLE
                             * COUNT(*) FILTER (WHERE payment_type = {_text(payment_kind)})
                             / COUNT(*) AS share_pct
                  FROM raw_payments)""",
        "top_sellers": """
            SELECT seller_id, seller_state, order_count, CAST(revenue AS DOUBLE) AS revenue,
                   avg_review_score FROM best_sellers""",
        "seller_table": """
            SELECT CAST(ROW_NUMBER() OVER (ORDER BY revenue DESC, seller_id) AS INTEGER)
                       AS position,
                   seller_id[:10] || '...' AS seller, seller_state AS state,
                   order_count AS orders, FORMAT('R${:,.0f}', CAST(revenue AS DOUBLE)) AS revenue,
                   COALESCE(FORMAT('{:.2f}', avg_review_score), '-') AS score
            FROM best_sellers ORDER BY position LIMIT 8""",
        "top_categories": """
            SELECT * FROM categories ORDER BY order_count DESC, category LIMIT 15""",
        "top_categories_shown": """
            SELECT * FROM categories ORDER BY order_count DESC, category LIMIT 12""",
        "rfm_segment": "SELECT * FROM segmented",
        "segment_actions": f"""
            SELECT customer_unique_id, segment, criteria, action
            FROM segmented
            JOIN (VALUES {_values(actions)}) AS advice(segment, criteria, action)
            USING (segment)""",
        "churn_flag": "SELECT *, recency_days > 180 AS churned FROM features",
        "churn_rate": """
            SELECT COUNT(*) AS customer_count,
                   COUNT(*) FILTER (WHERE recency_days > 180) AS churned_count,
                   100.0::DOUBLE * COUNT(*) FILTER (WHERE recency_days > 180) / COUNT(*)
                       AS churn_pct
            FROM features""",
        "top_customers": """
            SELECT CAST(ROW_NUMBER() OVER (ORDER BY total_value DESC, customer_unique_id)
                        AS INTEGER) AS position,
                   customer_unique_id[:12] || '...' AS customer, segment,
                   order_count AS orders, total_value AS revenue, recency_days
            FROM segmented ORDER BY position LIMIT 8""",
        "rfm_sample": """
            SELECT customer_unique_id, recency_days, total_value, segment
            FROM segmented ORDER BY MD5(customer_unique_id || '42'), customer_unique_id
            LIMIT 5000""",
        "rfm_sample_small": f"""
            SELECT customer_unique_id, recency_days, total_value, segment
            FROM segmented ORDER BY MD5(customer_unique_id || '42'), customer_unique_id
            LIMIT {sample}""",
        "kpis_no_month": _kpi_row(in_none, 180),
        "kpis": _kpi_row("SELECT * FROM months", 180),
        "kpis_years": _kpi_row(in_years, 360),
        "kpi_labels": f"""
            SELECT FORMAT('R${{:.2f}}M', revenue / 1000000) AS revenue,
                   FORMAT('{{:,}}', customer_count) AS customers,
                   FORMAT('{{:,}}', item_line_count) AS orders,
                   FORMAT('{{:.1f}}%', churn_pct) AS churn,
                   FORMAT('{{:.2f}}', mean_score) AS mean_score
            FROM ({_kpi_row("SELECT * FROM months", 180)})""",
    }
    # A dashboard refresh gives the same rows as the reports alone.
    same = {
        "features": "customer_features", "timeline": "monthly_timeline", "states": "by_state",
        "sellers": "top_sellers", "categories": "top_categories", "kpis": "kpis",
    }
    features |= {f"dashboard_{frame}": features[name] for frame, name in same.items()}
    tables = {
        "customers": "raw_customers",
        "orders": "raw_orders",
        "order_items": "raw_items",
        "order_payments": "raw_payments",
        "order_reviews": "raw_reviews",
        "products": "raw_products",
        "sellers": "raw_sellers",
        "product_category_translation": "raw_translation",
    }
    short = {"product_category_name": "category"}

    def unique(table: str, key: str) -> str:
        column = short.get(key, key)
        return f"""
            SELECT {_text(table)} AS table_name, {_text(key)} AS key_column,
                   COUNT(*) AS violating_keys, CAST(COALESCE(SUM(n), 0) AS BIGINT) AS row_count
            FROM (SELECT {column}, COUNT(*) AS n FROM {tables[table]} GROUP BY {column})
            WHERE n > 1 OR {column} IS NULL"""

    def present(table: str, key: str) -> str:
        column = short.get(key, key)
        return f"""
            SELECT {_text(table)} AS table_name, {_text(key)} AS column_name,
                   COUNT(*) FILTER (WHERE {column} IS NULL) AS null_count
            FROM {tables[table]}"""

    def orphans(child: str, parent: str, key: str) -> str:
        column = short.get(key, key)
        return f"""
            SELECT {_text(f"{child}.{key} -> {parent}")} AS relation,
                   COUNT(DISTINCT {column}) AS orphan_keys, COUNT(*) AS row_count
            FROM {tables[child]} AS c
            WHERE {column} IS NOT NULL AND NOT EXISTS
                (SELECT 1 FROM {tables[parent]} AS p WHERE p.{column} = c.{column})"""

    union = "\nUNION ALL\n"
    checks = {
        "table_counts": union.join(
            f"SELECT {_text(name)} AS table_name, COUNT(*) AS row_count FROM {table}"
            for name, table in tables.items()
        ),
        "pk_violations": union.join(
            [
                unique("customers", "customer_id"),
                unique("orders", "order_id"),
                unique("products", "product_id"),
                unique("sellers", "seller_id"),
                unique("product_category_translation", "product_category_name"),
            ]
        ),
        "pk_violations_lines": """
            SELECT order_id, order_item_id, COUNT(*) AS row_count
            FROM raw_items GROUP BY order_id, order_item_id HAVING COUNT(*) > 1""",
        "null_violations": union.join(
            present(table, column) for table, columns in not_null.items() for column in columns
        ),
        "null_violations_products": """
            SELECT product_id FROM raw_products WHERE category IS NULL""",
        "fk_orphans": union.join(
            [
                orphans("orders", "customers", "customer_id"),
                orphans("order_items", "orders", "order_id"),
                orphans("order_items", "products", "product_id"),
                orphans("order_items", "sellers", "seller_id"),
                orphans("order_payments", "orders", "order_id"),
                orphans("order_reviews", "orders", "order_id"),
                orphans("products", "product_category_translation", "product_category_name"),
            ]
        ),
        "fk_orphans_categories": """
            SELECT category AS product_category_name, COUNT(*) AS row_count
            FROM raw_products
            WHERE category NOT IN (SELECT category FROM raw_translation)
            GROUP BY category""",
        "anomaly_report": f"""
            SELECT anomaly_id, anomaly, row_count, decision
            FROM (VALUES {_values(anomalies)}) AS known(anomaly_id, anomaly, decision)
            JOIN (SELECT 1 AS anomaly_id, COUNT(*) AS row_count FROM raw_orders
                  WHERE order_status = 'delivered' AND delivered_on IS NULL
                  UNION ALL
                  SELECT 2, COUNT(*) FROM raw_orders
                  WHERE order_status = 'canceled' AND delivered_on IS NOT NULL
                  UNION ALL
                  SELECT 3, COUNT(*) FROM raw_products WHERE category IS NULL
                  UNION ALL
                  SELECT 4, COUNT(*) FROM raw_orders
                  WHERE order_id NOT IN (SELECT order_id FROM raw_items)
                  UNION ALL
                  SELECT 5, COUNT(*) FROM raw_orders
                  WHERE order_id NOT IN (SELECT order_id FROM raw_payments WHERE order_id IS NOT NULL))
            USING (anomaly_id)""",
        "imported_orders": """
            SELECT order_id, customer_id, order_status, purchased AS order_purchase_timestamp,
                   delivered_on AS order_delivered_customer_date
            FROM raw_orders""",
        "imported_lines": """
            SELECT order_id, order_item_id, product_id, seller_id, CAST(price AS DOUBLE) AS price,
                   CAST(freight AS DOUBLE) AS freight_value
            FROM raw_items""",
        "load_rejections": """
            SELECT 'customers' AS "table", 'customer_unique_id' AS "column", 'NULL' AS problem,
                   COUNT(*) AS row_count
            FROM raw_customers WHERE CAST(customer_id AS BIGINT) % 7 = 0 HAVING COUNT(*) > 0
            UNION ALL
            SELECT 'orders', 'order_id', 'repeated key', 2 * COUNT(*)
            FROM raw_orders WHERE CAST(order_id AS BIGINT) % 6 = 0 HAVING COUNT(*) > 0""",
        "clean_orders": """
            SELECT order_id, order_status,
                   CASE WHEN order_status IS DISTINCT FROM 'canceled' THEN delivered_on END
                       AS order_delivered_customer_date
            FROM raw_orders""",
        "clean_products": f"""
            SELECT product_id, COALESCE(category, {_text(unknown)}) AS product_category_name
            FROM raw_products""",
    }
    blocks = _FEATURES.format(unknown=unknown, high_value=high_value)
    return {name: f"WITH {_RAW},{blocks}\n{sql}" for name, sql in features.items()} | {
        name: f"WITH {_RAW}\n{sql}" for name, sql in checks.items()
    }
