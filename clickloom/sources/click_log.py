"""The click log (27 columns, space-delimited text with a header) and the score files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import parsing, timing

_LONG, _INT, _DOUBLE, _TEXT = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

# The click-log columns in file order.
CLICK_LOG = T.StructType(
    [
        T.StructField("instance_id", _LONG),
        T.StructField("item_id", _LONG),
        T.StructField("item_category_list", _TEXT),
        T.StructField("item_property_list", _TEXT),
        T.StructField("item_brand_id", _LONG),
        T.StructField("item_city_id", _LONG),
        T.StructField("item_price_level", _INT),
        T.StructField("item_sales_level", _INT),
        T.StructField("item_collected_level", _INT),
        T.StructField("item_pv_level", _INT),
        T.StructField("user_id", _LONG),
        T.StructField("user_gender_id", _INT),
        T.StructField("user_age_level", _INT),
        T.StructField("user_occupation_id", _INT),
        T.StructField("user_star_level", _INT),
        T.StructField("context_id", _LONG),
        T.StructField("context_timestamp", _LONG),
        T.StructField("context_page_id", _INT),
        T.StructField("predict_category_property", _TEXT),
        T.StructField("shop_id", _LONG),
        T.StructField("shop_review_num_level", _INT),
        T.StructField("shop_review_positive_rate", _DOUBLE),
        T.StructField("shop_star_level", _INT),
        T.StructField("shop_score_service", _DOUBLE),
        T.StructField("shop_score_delivery", _DOUBLE),
        T.StructField("shop_score_description", _DOUBLE),
        T.StructField("is_trade", _INT),
    ]
)

SCORES = T.StructType([T.StructField("instance_id", _LONG), T.StructField("predicted_score", _DOUBLE)])


def read_click_log(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """Read a text log with a fixed schema; files of unlabelled rows end one column earlier. A header of other names is an error."""
    schema = CLICK_LOG if labelled else T.StructType(CLICK_LOG.fields[:-1])
    return spark.read.schema(schema).option("sep", " ").option("header", True).option("enforceSchema", False).csv(path)


@dataclass(frozen=True)
class Quarantined:
    """``good`` rows with the log's columns, and ``bad`` lines: file, line and reason. Every line but the headers is in one of them."""

    good: DataFrame
    bad: DataFrame


def read_or_quarantine(spark: SparkSession, path: str, labelled: bool = True) -> Quarantined:
    """Read a text log whose files may order their columns differently, and keep the lines that are no click.

    A file's header is its line made of the column names; each field goes to the column that the header puts in its place.
    A line is bad if its file has no header or more than one, if it has too few or too many fields, or if a field is not
    empty and no value of its column's type. Empty fields are null, and so is the label of an unlabelled log.
    """
    schema = CLICK_LOG if labelled else T.StructType(CLICK_LOG.fields[:-1])
    names = [f.name for f in schema.fields]
    fields = F.split("line", " ", -1)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).withColumn("fields", fields)
    is_header = F.array_sort("fields") == F.array(*map(F.lit, sorted(names)))
    headers = lines.where(is_header).groupBy("file").agg(F.collect_set("line").alias("headers"))
    # one header per file; its position list is what the lines need
    order = F.when(F.size("headers") == 1, F.transform(F.array(*map(F.lit, names)), lambda name: F.array_position(F.split(F.col("headers")[0], " "), name)))
    rows = lines.where(~is_header).join(headers.select("file", order.alias("order"), F.size("headers").alias("n_headers")), "file", "left")
    whole = F.col("order").isNotNull() & (F.size("fields") == len(names))
    values, wrong = [], []
    for i, field in enumerate(schema.fields):
        text = F.when(whole, F.get("fields", (F.get("order", F.lit(i)) - 1).cast("int")))
        text = F.when(text == '""', F.lit("")).when(text != "", text)
        value = text if field.dataType == _TEXT else text.try_cast(field.dataType)
        values.append(value.alias(field.name))
        if field.dataType != _TEXT:
            said = F.concat(F.lit(f"{field.name} is no {field.dataType.simpleString()}: "), text)
            wrong.append(F.when(text.isNotNull() & value.isNull(), said))
    reason = (
        F.when(F.col("n_headers").isNull(), F.lit("the file has no header"))
        .when(F.col("n_headers") > 1, F.lit("the file has several headers"))
        .when(F.col("line") == "", F.lit("empty line"))
        .when(~whole, F.concat(F.size("fields").cast("string"), F.lit(f" fields instead of {len(names)}")))
        .otherwise(F.coalesce(*wrong))
    )
    judged = rows.select("file", "line", F.struct(*values).alias("click"), reason.alias("reason"))
    return Quarantined(judged.where("reason is null").select("click.*"), judged.where("reason is not null").select("file", "line", "reason"))


def write_click_log(df: DataFrame, path: str) -> None:
    columns = [f.name for f in CLICK_LOG.fields if f.name in df.columns]
    df.select(*columns).write.mode("overwrite").option("sep", " ").option("header", True).csv(path)


def prepare_log(df: DataFrame, zone: str = "UTC", first_day: str = "2024-01-01") -> DataFrame:
    """Add ``cate_0..2``, ``pre_0..2``, ``ts``, ``day_idx``, ``day``, ``hour`` and ``minute``."""
    return df.withColumns(
        {**parsing.category_ids(), **parsing.predicted_ids(), **timing.time_parts(zone=zone, first_day=first_day)}
    )


def write_stage(df: DataFrame, path: str) -> None:
    """Write a prepared log by day, so that a reader of some days prunes the other folders.

    The rebalance hint gathers each day into few files and lets AQE split a day that is too large
    for one task.
    """
    df.hint("rebalance", "day_idx").write.mode("overwrite").partitionBy("day_idx").parquet(path)


def read_stage(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    fields = [f for f in schema.fields if f.name != "day_idx"] + [schema["day_idx"]]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    df.select("instance_id", "predicted_score").write.mode("overwrite").option("sep", " ").option("header", True).csv(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORES).option("sep", " ").option("header", True).csv(path)


def feature_catalog(df: DataFrame, exclude: frozenset[str] = frozenset()) -> DataFrame:
    """One row per column: position, name and how many rows have a value (``n_known``)."""
    names = [c for c in df.columns if c not in exclude]
    known = df.agg(*[F.count(c).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(c).alias("n_known")) for i, c in enumerate(names)])
    return known.select(F.inline(rows))
