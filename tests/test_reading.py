"""Bad lines are kept apart with a reason; duplicates are found by fingerprints, whole rows decide."""

import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics, prepare
from clickloom.sources import click_log
from clickloom.sources.adapters import events_log, raw_events_log

SF_DIR = "/root/testdata/sf0.001"
NAMES = [f.name for f in click_log.CLICK_LOG.fields]


def line(values, order=NAMES):
    return " ".join("" if values[n] is None else str(values[n]) for n in order)


@pytest.fixture(scope="module")
def clicks(spark):
    return [r.asDict() for r in raw_events_log(spark, SF_DIR).orderBy("instance_id").limit(120).collect()]


def test_reordered_headers_and_bad_lines(spark, tmp_path, clicks):
    rng = random.Random(2)
    good, bad = [], {}
    for number, part in enumerate((clicks[:40], clicks[40:80], clicks[80:])):
        order = list(NAMES)
        if number:
            rng.shuffle(order)
        lines = [" ".join(order)]
        for i, values in enumerate(part):
            values = dict(values)
            if i == 3:
                values["item_id"] = "x7"
                bad[line(values, order)] = "item_id is no bigint: x7"
            elif i == 5:
                values["shop_score_service"] = "1.5.2"
                bad[line(values, order)] = "shop_score_service is no double: 1.5.2"
            elif i == 7:
                values["item_id"] = None
                good.append(values)
            elif i == 9:
                lines.append(line(values, order) + " more")
                bad[lines[-1]] = "28 fields instead of 27"
                continue
            elif i == 11:
                lines.append("cut off")
                bad["cut off"] = "2 fields instead of 27"
                continue
            else:
                good.append(values)
            lines.append(line(values, order))
        (tmp_path / f"part-{number}.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "none.txt").write_text(line(clicks[0]) + "\n")
    (tmp_path / "two.txt").write_text("\n".join([" ".join(NAMES), line(clicks[1]), " ".join(reversed(NAMES)), line(clicks[2])]) + "\n")
    read = click_log.read_or_quarantine(spark, str(tmp_path))
    assert read.good.schema == click_log.CLICK_LOG
    assert sorted(map(str, (r.asDict() for r in read.good.collect()))) == sorted(map(str, good))
    found = [(r["file"].rsplit("/", 1)[1], r["line"], r["reason"]) for r in read.bad.collect()]
    assert {reason for file, _, reason in found if file == "none.txt"} == {"the file has no header"}
    assert [reason for file, _, reason in found if file == "two.txt"] == ["the file has several headers"] * 2
    assert {text: reason for file, text, reason in found if file.startswith("part")} == bad
    # every line but the headers is in one of the two
    lines = sum(len(file.read_text().splitlines()) for file in tmp_path.glob("*.txt")) - 5
    assert read.good.count() + read.bad.count() == lines == len(good) + len(found)


def test_what_was_written_reads_back(spark, tmp_path):
    log = raw_events_log(spark, SF_DIR)
    click_log.write_click_log(log, str(tmp_path / "log"))
    read = click_log.read_or_quarantine(spark, str(tmp_path / "log"))
    assert read.bad.count() == 0
    assert sorted(map(str, read.good.collect())) == sorted(map(str, click_log.read_click_log(spark, str(tmp_path / "log")).collect()))
    click_log.write_click_log(log.drop("is_trade"), str(tmp_path / "test"))
    assert click_log.read_or_quarantine(spark, str(tmp_path / "test"), labelled=False).good.count() == log.count()


@pytest.mark.parametrize("of_row", [None, "1L", "instance_id % 3"])
@pytest.mark.parametrize("broadcast_rows", ["0", "250000"])
def test_duplicates_by_fingerprint(spark, of_row, broadcast_rows):
    log = events_log(spark, SF_DIR).where("instance_id < 400")
    log = log.withColumn("item_brand_id", F.expr("if(instance_id % 9 = 0, null, item_brand_id)"))
    twice = log.unionByName(log.where("instance_id % 5 = 0")).unionByName(log.where("instance_id % 10 = 0"))
    of_row = None if of_row is None else F.expr(of_row)
    spark.conf.set("spark.clickloom.broadcastRows", broadcast_rows)
    try:
        # planted collisions: many different rows share a fingerprint
        kept = prepare.dedupe_log(twice, of_row)
        assert sorted(map(str, kept.collect())) == sorted(map(str, log.collect()))
        row = metrics.log_profile(twice, of_row).first()
        low, high = log.agg(F.min("context_timestamp"), F.max("context_timestamp")).first()
        assert tuple(row) == (twice.count(), log.count(), len(log.columns), low, high)
        assert metrics.log_profile(log.limit(0)).first()["n_rows"] == 0
    finally:
        spark.conf.unset("spark.clickloom.broadcastRows")


def test_no_text_moves_without_duplicates(spark):
    log = events_log(spark, SF_DIR)
    again, once, counted = prepare.by_fingerprint(log)
    assert again.count() == 0 and once.count() == log.count() == counted.count()
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
