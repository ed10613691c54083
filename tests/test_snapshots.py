"""A history that grows by days: the same features as a full rebuild, from the new day's folder and one snapshot."""

import json
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from clickloom.operators import history
from clickloom.operators.snapshots import HistoryStore
from clickloom.plans.catalogue import assembled, result, scratch
from clickloom.sources.click_log import read_stage, write_stage

SF_DIR = "/root/testdata/sf0.001"
KEYS = ["user_id", "item_id", ("user_id", "item_id"), "hour", ("user_occupation_id", "item_brand_id")]
MEANS = {"m_price": ("user_id", "item_price_level"), "m_age": ("item_id", "user_age_level")}
ATTRIBUTES = ["item_price_level", "user_age_level"]
SEEN = {"new_user": "user_id", "new_pair": ("user_id", "item_id")}


@pytest.fixture(scope="module")
def log(spark):
    return assembled(spark, SF_DIR).withColumn("item_brand_id", F.expr("if(instance_id % 9 = 0, null, item_brand_id)")).cache()


def features(store, now, day, days=None):
    df = store.cvr(now, day, KEYS, days, source=now)
    df = store.means(df, day, MEANS, days, source=now)
    return rows(store.first_appearance(df, day, SEEN, days, source=now))


def rebuilt(log, now, day, days=None):
    his = log.where(F.col("day_idx") < day) if days is None else log.where(F.col("day_idx").between(day - days, day - 1))
    df = history.history_means(his, history.history_cvr(his, now, KEYS), MEANS)
    return rows(history.first_appearance(his, df, SEEN))


def rows(df):
    return sorted(map(str, result(df).collect()))


def test_added_days_equal_a_full_rebuild(spark, log, request):
    store = HistoryStore(spark, scratch(spark), KEYS, ATTRIBUTES)
    now = log.where("day_idx = 0")
    assert features(store, now, 0) == rebuilt(log, now, 0)
    store.add(log.where("day_idx < 20"))
    for day in (20, 21, 23):
        store.add(log.where(F.col("day_idx") == day))
    assert store.days() == [*range(20), 20, 21, 23]
    kept = log.where("day_idx not in (22) and day_idx < 24")
    for day in (24, 23, 22, 21, 30, 7):
        now = log.where(F.col("day_idx") == min(day, 24))
        assert features(store, now, day) == rebuilt(kept, now, day), day
    now = log.where("day_idx = 24")
    assert features(store, now, 24, 9) == rebuilt(kept, now, 24, 9)
    # sizes are known, so that large keys are not broadcast
    assert store.before(24).sizes[("user_id",)] == kept.select("user_id").distinct().count()
    request.getfixturevalue("split_keys")
    assert features(store, now, 24) == rebuilt(kept, now, 24)


def test_a_new_day_reads_its_own_folder_and_one_snapshot(spark, log, tmp_path):
    write_stage(log.where("day_idx < 4"), str(tmp_path / "log"))
    staged = read_stage(spark, str(tmp_path / "log"), log.schema)
    folder = scratch(spark)
    store = HistoryStore(spark, folder, KEYS, ATTRIBUTES)
    for day in (0, 1, 2):
        store.add(staged.where(F.col("day_idx") == day))
    now = log.where("day_idx = 3")
    want = features(store, now, 3)
    again = HistoryStore(spark, scratch(spark), KEYS, ATTRIBUTES)
    again.add(staged.where("day_idx < 2"))
    # earlier clicks, and all but the last snapshot, can no longer be read
    for file in [*(tmp_path / "log" / "day_idx=0").glob("*.parquet"), *(tmp_path / "log" / "day_idx=1").glob("*.parquet"), *(Path(again.folder) / "daily").rglob("*.parquet")]:
        file.write_bytes(b"no parquet")
        crc = file.with_name(f".{file.name}.crc")
        crc.exists() and crc.write_bytes(b"")
    again.add(staged.where("day_idx = 2"))
    assert features(again, now, 3) == want


def test_an_addition_that_was_cut_off_leaves_no_trace(spark, log, monkeypatch):
    store = HistoryStore(spark, scratch(spark), KEYS, ATTRIBUTES)
    store.add(log.where("day_idx < 3"))
    now = log.where("day_idx = 4")
    with monkeypatch.context() as broken:
        broken.setattr("clickloom.operators.snapshots.json", SimpleNamespace(loads=json.loads, dumps=lambda line: 1 / 0))
        with pytest.raises(ZeroDivisionError):
            store.add(log.where("day_idx = 3"))
    assert store.days() == [0, 1, 2]
    store.add(log.where("day_idx = 3"))
    assert features(store, now, 4) == rebuilt(log, now, 4)
    with pytest.raises(ValueError, match="not later"):
        store.add(log.where("day_idx = 3"))
    with pytest.raises(ValueError, match="other key sets"):
        HistoryStore(spark, store.folder, ["item_id"]).days()
    store.add(log.limit(0))
    store.forget(4)
    assert features(store, now, 4) == rebuilt(log, now, 4) and len(list((Path(store.folder) / "snapshot").iterdir())) == 1
