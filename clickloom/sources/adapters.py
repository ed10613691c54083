"""Click logs derived from the test tables.

``events_log``: each event is a click, a purchase event is a conversion; what the table lacks is a
fixed function of its ids. ``star_log``: lineitem joined with its order, customer, part and supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.sources.click_log import CLICK_LOG, prepare_log

FIRST_DAY = "2024-01-01"
STAR_FIRST_DAY = "1995-01-01"


# Column definitions over events with k = the number in props.
EVENT_COLUMNS = {
    "instance_id": "event_id",
    "item_id": "k",
    "item_category_list": "if(k % 2 = 0, concat_ws(';', '7', k % 7, k % 3), concat_ws(';', '7', k % 7))",
    "item_property_list": "concat_ws(';', k, k % 11, k % 13)",
    "item_brand_id": "k % 10",
    "item_city_id": "k % 5",
    "item_price_level": "least(floor(value / 10), 20)",
    "item_sales_level": "k % 12",
    "item_collected_level": "k % 13",
    "item_pv_level": "k % 15",
    "user_id": "user_id",
    "user_gender_id": "user_id % 3",
    "user_age_level": "user_id % 8",
    "user_occupation_id": "user_id % 4",
    "user_star_level": "user_id % 11",
    "context_id": "event_id",
    "context_timestamp": "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)",
    "context_page_id": "event_id % 20",
    "predict_category_property": "if(event_id % 20 = 0, '-1', concat(k % 7, ':', k, ',', k % 11, ';', user_id % 7, ':', k % 5))",
    "shop_id": "k % 25",
    "shop_review_num_level": "(k % 25) % 6",
    "shop_review_positive_rate": "(k % 25) / 25D",
    "shop_star_level": "(k % 25) % 4",
    "shop_score_service": "((k % 25) % 8) / 8D",
    "shop_score_delivery": "((k % 25) % 5) / 5D",
    "shop_score_description": "((k % 25) % 10) / 10D",
    "is_trade": "event_type = 'purchase'",
}


def raw_events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events = events.selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return events.selectExpr(
        *[f"CAST({EVENT_COLUMNS[f.name]} AS {f.dataType.simpleString()}) AS {f.name}" for f in CLICK_LOG.fields]
    )


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare_log(raw_events_log(spark, sf_dir), first_day=FIRST_DAY)


def star_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # orders meet their customers before the line items, of which there are several to an order
    orders = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        read("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    return joined.select(
        F.col("l_orderkey").alias("context_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        F.col("p_brand").alias("item_brand_id"),
        F.floor((F.col("p_retailprice") - 900) / 10).cast("int").alias("item_price_level"),
        F.col("p_size").alias("item_sales_level"),
        F.col("p_type").alias("cate_1"),
        F.col("l_suppkey").alias("shop_id"),
        F.col("s_nationkey").alias("shop_star_level"),
        F.col("c_mktsegment").alias("user_occupation_id"),
        F.col("c_nationkey").alias("user_age_level"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit(STAR_FIRST_DAY).cast("date")).alias("day_idx"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_trade"),
    )
