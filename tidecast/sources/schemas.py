"""Explicit schemas, so no scan ever infers types."""

# retail input tables (CSV, header row)
SALES = "Date DATE, Revenue DOUBLE, COGS DOUBLE"
INVENTORY = (
    "year INT, month INT, snapshot_date DATE, product_id STRING, stockout_flag INT, overstock_flag INT, "
    "fill_rate DOUBLE, days_of_supply DOUBLE, units_sold BIGINT, sell_through_rate DOUBLE"
)
WEB_TRAFFIC = (
    "date DATE, traffic_source STRING, sessions BIGINT, unique_visitors BIGINT, bounce_rate DOUBLE, "
    "avg_session_duration_sec DOUBLE"
)
PROMOTIONS = (
    "promo_id STRING, promo_name STRING, promo_type STRING, discount_value DOUBLE, start_date DATE, end_date DATE, "
    "applicable_category STRING, promo_channel STRING, stackable_flag INT, min_order_value INT"
)
ORDERS = "order_id STRING, order_date DATE, payment_method STRING, device_type STRING, order_source STRING"
ORDER_ITEMS = "order_id STRING, product_id STRING, quantity BIGINT, unit_price DOUBLE, discount_amount DOUBLE"
PRODUCTS = "product_id STRING, category STRING, cogs DOUBLE"
PAYMENTS = "order_id STRING, payment_value DOUBLE"
SUBMISSION = "Date DATE, Revenue DOUBLE, COGS DOUBLE"

CSV_TABLES = {
    "sales": SALES, "inventory": INVENTORY, "web_traffic": WEB_TRAFFIC, "promotions": PROMOTIONS,
    "orders": ORDERS, "order_items": ORDER_ITEMS, "products": PRODUCTS, "payments": PAYMENTS,
    "submission": SUBMISSION,
}

# supplied parquet tables
PARQUET_TABLES = {
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
                "l_shipdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}
