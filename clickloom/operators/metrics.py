"""Score files, metrics and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rates import LABEL, buys, known_rows, ratio
from clickloom.operators import prepare

ID, SCORE = "instance_id", "predicted_score"
EDGE = 1e-15


def log_loss_term(label: Column, score: Column, edge: float = EDGE) -> Column:
    p = F.least(F.greatest(score, F.lit(edge)), F.lit(1 - edge))
    return -F.when(label == 1, F.ln(p)).otherwise(F.ln(1 - p))


def log_loss(df: DataFrame, label: str = LABEL, score: str = SCORE) -> DataFrame:
    known = F.col(label).isin(0, 1)
    return df.where(known).agg(F.avg(log_loss_term(F.col(label), F.col(score))).alias("log_loss"), F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = LABEL, predicted: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from one grouped count of (label, prediction). Rows without a known label don't count."""
    pairs = df.where(F.col(label) >= 0).groupBy(F.col(label).cast("int").alias("y"), F.col(predicted).cast("int").alias("z")).agg(F.count("*").alias("n"))
    # each pair adds to the support of its label and to the predictions of its prediction
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"), F.when(F.col("y") == F.col("z"), F.col("n")).otherwise(F.lit(0)).alias("hit")),
                F.struct(F.col("z").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit")),
            )
        )
    )
    total = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    zero = F.lit(0.0)
    precision = F.coalesce(ratio(F.col("hit"), F.col("predicted")), zero)
    recall = F.coalesce(ratio(F.col("hit"), F.col("support")), zero)
    return total.select(
        "label", precision.alias("precision"), recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(zero).alias("f1"),
        "support",
    )


def unique_scores(scores: DataFrame) -> DataFrame:
    """One score per id; the mean where an id occurs more than once, which does not depend on row order."""
    return scores.groupBy(ID).agg(F.avg(SCORE).alias(SCORE))


def attach_score(df: DataFrame, scores: DataFrame, name: str = SCORE) -> DataFrame:
    """Scores of an earlier model as a feature, joined by id without multiplying rows."""
    return df.join(unique_scores(scores).withColumnRenamed(SCORE, name), ID, "left")


def blend_scores(files: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of score files, matched by id."""
    weights = list(weights) if weights is not None else [1 / len(files)] * len(files)
    named = [unique_scores(f).withColumnRenamed(SCORE, f"score_{i}") for i, f in enumerate(files)]
    joined = reduce(lambda a, b: a.join(b, ID), named)
    blended = reduce(lambda a, b: a + b, [F.col(f"score_{i}") * w for i, w in enumerate(weights)])
    return joined.select(ID, blended.alias(SCORE))


def blend_sweep(df: DataFrame, one: str, two: str, label: str = LABEL, weights: Sequence[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """Log loss of ``w * one + (1 - w) * two`` for each weight, all in one aggregate over the rows."""
    y = F.col(label)
    losses = [F.avg(log_loss_term(y, F.col(one) * w + F.col(two) * (1 - w))).alias(f"w{i}") for i, w in enumerate(weights)]
    row = df.where(y.isin(0, 1)).agg(*losses)
    pairs = F.array(*[F.struct(F.lit(float(w)).alias("weight"), F.col(f"w{i}").alias("log_loss")) for i, w in enumerate(weights)])
    return row.select(F.inline(pairs))


def score_correlation(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pearson correlation and the two means of score files, matched by id."""
    a = unique_scores(one).withColumnRenamed(SCORE, "a")
    b = unique_scores(two).withColumnRenamed(SCORE, "b")
    return a.join(b, ID).agg(F.corr("a", "b").alias("correlation"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count("*").alias("n"))


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg(SCORE).alias("mean_score"), F.min(SCORE).alias("min_score"), F.max(SCORE).alias("max_score"), F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def cvr_by_minute(df: DataFrame, day: int, hour: int) -> DataFrame:
    """Clicks, buys and rate of each minute of one hour."""
    rows = df.where((F.col("day_idx") == day) & (F.col("hour") == hour))
    grouped = rows.groupBy("minute").agg(known_rows().alias("sum"), buys().alias("gm"))
    return grouped.withColumn("cvr", ratio(F.col("gm"), F.col("sum")))


def dominant_category(df: DataFrame, key: str = "item_id", category: str = "user_occupation_id") -> DataFrame:
    """The most frequent category per key and its count; the smallest one wins a tie."""
    pairs = df.groupBy(key, category).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(category).isNull().alias("none"), F.col(category).alias("c")))
    return pairs.groupBy(key).agg(best.alias("best")).select(key, (-F.col("best.n")).alias("max_count"), F.col("best.c").alias("dominant"))


def positive_means(df: DataFrame, key: str, columns: Sequence[str], label: str = LABEL) -> DataFrame:
    """Means of the columns over each key's buying rows, ``<key>_buy_<column>_mean``; null for a key that never bought."""
    bought = F.col(label) == 1
    return df.groupBy(key).agg(*[F.avg(F.when(bought, F.col(c))).alias(f"{key}_buy_{c}_mean") for c in columns])


def log_profile(df: DataFrame, of_row: Column | None = None) -> DataFrame:
    """Rows, rows without duplicates, columns and the time span.

    Rows are grouped by fingerprint, and compared as a whole only where fingerprints meet, so a log without duplicates moves no text.
    """
    again, _, counted = prepare.by_fingerprint(df, of_row)
    rows = counted.agg(F.coalesce(F.sum(prepare.ROWS), F.lit(0)).alias("n_rows"), F.count_if(F.col(prepare.ROWS) == 1).alias("n_once"))
    repeated = again.groupBy(*df.columns).agg(F.lit(1)).agg(F.count("*").alias("n_again"))
    span = df.agg(F.min("context_timestamp").alias("first_time"), F.max("context_timestamp").alias("last_time"))
    # one row each
    return rows.join(F.broadcast(repeated)).join(F.broadcast(span)).select(
        "n_rows", (F.col("n_once") + F.col("n_again")).alias("n_distinct"), F.lit(len(df.columns)).alias("n_columns"), "first_time", "last_time"
    )
