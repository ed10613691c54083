"""Fits on rows counted by their bins: the learner's own models, over fewer rows."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clickloom.operators import binned, metrics, model
from clickloom.operators.boosting import Booster
from clickloom.session import written

BOOSTER = Booster(rounds=5, depth=3, rate=0.3)
COLUMNS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """A column of few values, one of many, one with nulls, and repeated rows."""
    rng = np.random.default_rng(8)
    a, b, c = rng.integers(0, 6, 900), rng.normal(size=900).round(3), rng.integers(0, 50, 900)
    y = rng.random(900) < 1 / (1 + np.exp(-(0.7 * a - b - 1.5)))
    data = [(i, int(y[i]), int(a[i]), float(b[i]), None if c[i] == 7 else int(c[i])) for i in range(900)]
    return written(spark.createDataFrame([*data, *data[:200]], "instance_id long, is_trade int, a int, b double, c int").coalesce(2))


def plain_loss(train, test, columns):
    fitted = model.fit(train, columns, BOOSTER)
    found = fitted.transform(model.assembled(test, columns))
    return metrics.log_loss(found.select("is_trade", F.get(vector_to_array("probability"), F.lit(1)).alias(metrics.SCORE))).first()["log_loss"]


def test_bins_are_the_first_bound_not_below(spark):
    limits = [0.5, 1.0, 4.0, 9.0]
    x = [-3.0, 0.5, 0.7, 1.0, 2.0, 4.0, 4.5, 9.0, 10.0, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(binned.bin_of(F.col("x"), limits)).collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert binned.bounds(np.array([3.0, 1.0, 1.0, 2.0])) == [1.5, 2.5] and binned.bounds(np.array([2.0])) == []


def test_folds_have_the_losses_of_plain_fits(rows):
    got = model.cross_validate(rows, COLUMNS, BOOSTER, folds=3)
    fold = F.pmod(F.xxhash64("instance_id"), F.lit(3))
    want = [plain_loss(rows.where(fold != i), rows.where(fold == i), COLUMNS) for i in range(3)]
    assert np.allclose(got, want, atol=1e-9)


def test_scores_of_an_experiment_are_those_of_plain_fits(rows):
    train, test = rows.where("instance_id < 700"), rows.where("instance_id >= 700")
    boosters = [BOOSTER, Booster(rounds=4, depth=2, rate=0.2)]
    for got, booster in zip(model.score_files(train, test, COLUMNS, boosters), boosters):
        want = model.score(model.fit(train, COLUMNS, booster), test, COLUMNS)
        assert got.columns == want.columns
        both = got.join(want.select("instance_id", F.col("predicted_score").alias("want")), "instance_id").toPandas()
        assert len(both) == 200 and np.allclose(both.predicted_score, both.want, atol=1e-9)


def test_equal_rows_are_fitted_once(rows):
    trials = model.Trials.over(rows, rows, ["a"], BOOSTER)
    assert trials.train.count() <= 12
    assert abs(trials.loss(["a"]) - plain_loss(rows, rows, ["a"])) < 1e-9
    trials.done()


def test_drawn_rows_or_columns_and_vectors_are_not_counted_together(rows):
    for booster in (Booster(3, 2, 0.1, row_share=0.5), Booster(3, 2, 0.1, column_share=0.5), Booster(3, 2, 0.1, min_rows=4)):
        assert not binned.serves(model._classifier(booster), rows, COLUMNS)
    assert binned.serves(model._classifier(BOOSTER), rows, COLUMNS)
    assert not binned.serves(model._classifier(BOOSTER), model.assembled(rows, COLUMNS), ["features"])
