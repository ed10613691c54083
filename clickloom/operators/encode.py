"""Codes and one-hot features from the values seen in training."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.session import written

#: Most values that the column form of :func:`one_hot` makes columns of.
MOST_VALUES = 1_000


def value_codes(train: DataFrame, column: str) -> DataFrame:
    """``value`` and ``code``: the distinct values of a column numbered from 0 in sorted order; null has none.

    The values are sorted by ranges over all tasks. The driver sees one count per range.
    """
    values = train.select(F.col(column).alias("value")).where("value is not null").distinct()
    placed = written(values.repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id()))
    before, offsets = 0, []
    for part, n in placed.groupBy("part").count().orderBy("part").collect():
        offsets.append((part, before))
        before += n
    known = train.sparkSession.createDataFrame(offsets, "part int, before long")
    place = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return placed.join(F.broadcast(known), "part").select("value", (F.col("before") + place).cast("long").alias("code"))


def with_codes(df: DataFrame, codes: DataFrame, column: str, out: str) -> DataFrame:
    """Adds the code of each row's value, null if training had no such value."""
    named = codes.select(F.col("value").alias(f"_{out}_value"), F.col("code").alias(out))
    return df.join(named, F.col(column) == F.col(f"_{out}_value"), "left").drop(f"_{out}_value")


def label_encode(train: DataFrame, other: DataFrame, columns: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """A column ``<column>_code`` for each column, on both tables."""
    for column in columns:
        codes = written(value_codes(train, column))
        train, other = (with_codes(df, codes, column, f"{column}_code") for df in (train, other))
    return train, other


def vocabulary(train: DataFrame, column: str, most: int = MOST_VALUES) -> list:
    """Sorted distinct values of a column; an error if it has more than ``most``."""
    rows = train.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} values: use the vector form")
    return sorted(row[0] for row in rows)


def one_hot_vectors(train: DataFrame, other: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """A sparse vector ``<column>_onehot`` with a place for each value seen in ``train``, on both tables; any other value is all zeros."""
    codes = written(value_codes(train, column))
    n = codes.count()
    place = f"_{column}_code"
    largest = train.sparkSession.createDataFrame([(float(n),)], f"`{place}` double")
    # the last place, that of unseen values, is dropped
    encoder = OneHotEncoder(inputCols=[place], outputCols=[f"{column}_onehot"], dropLast=True).fit(largest)

    def coded(df: DataFrame) -> DataFrame:
        return encoder.transform(with_codes(df, codes, column, place).fillna(n, [place])).drop(place)

    return coded(train), coded(other)


def one_hot(train: DataFrame, other: DataFrame, columns: Iterable[str], form: str = "vector", most: int = MOST_VALUES) -> tuple[DataFrame, DataFrame]:
    """The values seen in ``train``, on both tables; any other value is all zeros.

    In the ``vector`` form, which takes any number of values, each column gets a sparse vector ``<column>_onehot``. In the
    ``columns`` form it gets a 0/1 column ``<column><value>`` for each of at most ``most`` values.
    """
    if form not in ("vector", "columns"):
        raise ValueError(f"no such form: {form}")
    for column in columns:
        if form == "vector":
            train, other = one_hot_vectors(train, other, column)
            continue
        values = vocabulary(train, column, most)
        added = {f"{column}{value}": F.coalesce(F.col(column) == F.lit(value), F.lit(False)).cast("int") for value in values}
        train, other = train.withColumns(added), other.withColumns(added)
    return train, other
