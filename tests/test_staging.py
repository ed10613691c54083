"""Logs that are derived once, and fits that run side by side or are looked up."""

import threading

import pytest
from pyspark.sql import functions as F

from clickloom.operators import model
from clickloom.operators.boosting import Booster
from clickloom.plans import catalogue, first_stage, rolling_stage
from clickloom.session import written

SF_DIR = "/root/testdata/sf0.001"
SMALL = Booster(rounds=3, depth=2, rate=0.3)


@pytest.fixture(scope="module")
def rows(spark):
    x = F.col("id")
    return written(spark.range(600).select(x.alias("instance_id"), ((x * 7 % 13) > (x % 5 + 4)).cast("int").alias("is_trade"), (x * 7 % 13).alias("a"), (x % 5).alias("b"), (x % 3).alias("c")))


def most_at_once(monkeypatch):
    """Counts fits that run at the same time; one waits a while for another."""
    fit, lock, running, most = model.GBTClassifier.fit, threading.Lock(), [0], [0]
    second = threading.Event()

    def counted(self, *args):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            if running[0] > 1:
                second.set()
        second.wait(20)
        try:
            return fit(self, *args)
        finally:
            with lock:
                running[0] -= 1

    monkeypatch.setattr(model.GBTClassifier, "fit", counted)
    return most


def test_folds_run_side_by_side_with_the_same_losses(rows, monkeypatch):
    one = model.cross_validate(rows, ["a", "b"], SMALL, folds=3, at_once=1)
    most = most_at_once(monkeypatch)
    assert model.cross_validate(rows, ["a", "b"], SMALL, folds=3) == one and most[0] > 1


def test_experiments_fit_side_by_side(rows, monkeypatch):
    most = most_at_once(monkeypatch)
    train, test = rows.where("instance_id < 400"), rows.where("instance_id >= 400")
    files = model.score_files(train, test, ["a", "b"], [SMALL, Booster(rounds=2, depth=1, rate=0.3)])
    assert most[0] == 2 and [file.count() for file in files] == [200, 200]


def test_a_tried_set_is_looked_up(rows, monkeypatch):
    trials = model.Trials.over(rows, rows, ["a", "b", "c"], SMALL)
    fits, fit = [], model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, *args: fits.append(1) or fit(self, *args))
    first = trials.losses([["a"], ["b"], ["a"]])
    assert trials.losses([["b"], ["a", "b"], ["a"]])[::2] == first[1::-1] and len(fits) == 3
    trials.done()


def test_models_get_the_columns_they_read_from_a_log_derived_once(spark, monkeypatch):
    wrote, write = [], catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, **how: wrote.append(df) or write(df, **how))
    table = catalogue.model_table(spark, SF_DIR)
    assert table.columns == ["instance_id", "is_trade", "day_idx", *catalogue.MODEL_COLUMNS]
    assert len(wrote) == 2 and not any("events.parquet" in file for file in wrote[1].inputFiles())


def test_star_counts_write_the_counted_keys_only(spark, monkeypatch):
    wrote, write = [], catalogue.written
    monkeypatch.setattr(catalogue, "written", lambda df, **how: wrote.append(df.columns) or write(df, **how))
    catalogue.QUERIES["star_count_by_key"](spark, SF_DIR)
    assert wrote == [["context_id", *catalogue._STAR_KEYS]]


@pytest.mark.parametrize("name, module, function", [("first_stage_features", first_stage, "features"), ("rate_table", first_stage, "rate_table"), ("transfer_score", first_stage, "transfer_scores"), ("rolling_scores", rolling_stage, "run")])
def test_stages_read_a_log_derived_once(spark, monkeypatch, name, module, function):
    class Seen(Exception):
        pass

    def seen(log, *_, **__):
        raise Seen(any("events.parquet" in file for file in log.inputFiles()))

    monkeypatch.setattr(module, function, seen)
    with pytest.raises(Seen) as found:
        catalogue.QUERIES[name](spark, SF_DIR)
    assert found.value.args == (False,)
