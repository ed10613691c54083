"""The experiment and the offline run: their figures are those of SQL over the scores they wrote."""

import duckdb
import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics, model
from clickloom.operators.boosting import Booster
from clickloom.plans import catalogue, final_stage, presets
from clickloom.sources.adapters import events_log

SF_DIR = "/root/testdata/sf0.001"
LOSS = "avg(-CASE WHEN is_trade = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"


@pytest.fixture(scope="module")
def table(spark):
    return catalogue.model_table(spark, SF_DIR)


def test_day_experiment_equals_sql_over_its_scores(spark, table):
    small = (Booster(rounds=3, depth=2, rate=0.1), Booster(rounds=2, depth=3, rate=0.3))
    scored = model.day_experiment(table, 0, 27, catalogue.MODEL_COLUMNS, small)
    rows = scored.toPandas()  # noqa: F841 - read by the SQL below
    want = table.where("day_idx = 27 and is_trade >= 0").count()
    assert len(rows) == want and set(rows.columns) == {"instance_id", "is_trade", "one", "two"}
    assert (rows["one"] - rows["two"]).abs().max() > 0.001
    got = {round(r["weight"], 1): r["log_loss"] for r in model.experiment_losses(scored).collect()}
    assert sorted(got) == [i / 10 for i in range(11)]
    for weight, loss in got.items():
        p = f"(one * {weight} + two * (1 - {weight}))"
        assert abs(duckdb.sql(f"SELECT {LOSS.format(p=p)} FROM rows").fetchall()[0][0] - loss) < 1e-9


@pytest.mark.parametrize("look_ahead", [True, False])
def test_offline_run(spark, look_ahead):
    log = events_log(spark, SF_DIR)
    run = final_stage.offline(log, 29, None, Booster(rounds=60, depth=3, rate=0.3), look_ahead=look_ahead, patience=3)
    rows = run.scores.toPandas()  # noqa: F841
    held_out = log.where((F.col("day_idx") == 29) & (F.col("hour") > 7) & (F.col("is_trade") >= 0))
    assert sorted(rows["instance_id"]) == sorted(r[0] for r in held_out.select("instance_id").collect())
    assert len(run.model.trees) < 60
    assert look_ahead == bool(presets.USES_FUTURE_WITHIN_DAY & set(run.columns))
    report = run.report().toPandas().set_index("label")
    assert abs(report["log_loss"].iloc[0] - duckdb.sql(f"SELECT {LOSS.format(p='predicted_score')} FROM rows").fetchall()[0][0]) < 1e-9
    assert abs(report["log_loss"].iloc[0] - run.model.losses[-1]) < 1e-9
    for label in report.index:
        n, hit, called = duckdb.sql(f"SELECT count(*) FILTER (is_trade = {label}), count(*) FILTER (is_trade = {label} AND prediction = {label}), count(*) FILTER (prediction = {label}) FROM rows").fetchall()[0]
        assert report.loc[label, "support"] == n and abs(report.loc[label, "recall"] - (hit / n if n else 0)) < 1e-12
        assert abs(report.loc[label, "precision"] - (hit / called if called else 0)) < 1e-12
    shares = run.importance().toPandas()
    assert set(shares["feature"]) == set(run.columns) and abs(shares["importance"].sum() - 1) < 1e-6


def test_published_boosters():
    # fixed values
    assert (presets.FINAL_BOOSTER.rounds, presets.FINAL_BOOSTER.depth, presets.FINAL_BOOSTER.rate) == (1397, 4, 0.02)
    assert (presets.TRANSFER_BOOSTER.rounds, presets.OFFLINE_BOOSTER.rounds, presets.ROLLING_BOOSTER.rounds) == (1304, 10_000, 100_000)
    assert (presets.ROLLING_BOOSTER.min_rows, presets.SMALL_BOOSTER.rounds, presets.SECOND_BOOSTER.rounds) == (100, 110, 97)
    assert metrics.EDGE == 1e-15
