"""Putting a log together: labels, union, duplicates, null fills and splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rates import LABEL
from clickloom.operators.filters import keep_members, split_members
from clickloom.operators.keyed import ROWS
from clickloom.session import written


def assemble_log(train: DataFrame, *unlabelled: DataFrame) -> DataFrame:
    """Union of a labelled log and any number of unlabelled ones, which get labels -1, -2, ..."""
    log = train
    for i, part in enumerate(unlabelled, start=1):
        log = log.unionByName(part.withColumn(LABEL, F.lit(-i)), allowMissingColumns=True)
    return log.withColumn(LABEL, F.coalesce(F.col(LABEL), F.lit(-1)).cast("int"))


_PRINT = "row_fingerprint"


def fingerprint(df: DataFrame) -> Column:
    """A hash of all columns of a row; equal rows have equal ones, nulls included."""
    return F.xxhash64(*df.columns)


def by_fingerprint(df: DataFrame, of_row: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose fingerprint occurs again, rows whose doesn't, and how often each fingerprint occurs (``n_rows``, written).

    Only fingerprints are grouped. Of the wide rows, those of the first kind alone ever need to be compared.
    """
    marked = df.withColumn(_PRINT, fingerprint(df) if of_row is None else of_row)
    counted = written(marked.groupBy(_PRINT).agg(F.count("*").alias(ROWS)))
    again, once = split_members(marked, counted.where(F.col(ROWS) > 1).select(_PRINT), _PRINT)
    return again.drop(_PRINT), once.drop(_PRINT), counted


def dedupe_log(df: DataFrame, of_row: Column | None = None) -> DataFrame:
    """Drop whole-row duplicates. Rows are compared as a whole only where their fingerprints meet; partial aggregation removes copies before the shuffle."""
    again, once, _ = by_fingerprint(df, of_row)
    return once.unionByName(again.dropDuplicates())


def fill_nulls(df: DataFrame, number: float = -1, text: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    subset = list(columns) if columns is not None else None
    filled = df.na.fill(number, subset=subset)
    return filled if text is None else filled.na.fill(text, subset=subset)


def feature_columns(df: DataFrame, exclude: Iterable[str]) -> list[str]:
    exclude = frozenset(exclude)
    return [c for c in df.columns if c not in exclude]


def split_history_current(df: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """Rows of earlier days and rows of the target day; on a staged log both prune partitions."""
    return df.where(F.col("day_idx") < target), df.where(F.col("day_idx") == target)


def recent_days(df: DataFrame, target: int, days: int = 9) -> DataFrame:
    return df.where(F.col("day_idx").between(target - days, target - 1))


def hour_split(df: DataFrame, last_train_hour: int = 7) -> tuple[DataFrame, DataFrame]:
    """Labelled rows up to an hour of the day, and those after it."""
    known = df.where(F.col(LABEL) >= 0)
    return known.where(F.col("hour") <= last_train_hour), known.where(F.col("hour") > last_train_hour)


def day_split(df: DataFrame, start: int, end: int) -> tuple[DataFrame, DataFrame]:
    """Days ``[start, end)`` and day ``end``."""
    day = F.col("day_idx")
    return df.where((day >= start) & (day < end)), df.where(day == end)


def label_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(LABEL) >= 0), df.where(F.col(LABEL) < 0)


def tagged(parts: Mapping[str, DataFrame], column: str = "part") -> DataFrame:
    """Union of named parts, each row with its part's name."""
    frames = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    return union


def keep_requested(df: DataFrame, requested: DataFrame, key: str = "instance_id") -> DataFrame:
    """The rows whose key is requested. Of many requested keys, a filter keeps most other rows out of the shuffle."""
    return keep_members(df, requested, key)
