"""Places in time: against brute force, with users cut into slices, and the plan's reads and shuffles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import ordered
from clickloom.plans import presets
from clickloom.sources.adapters import events_log
from clickloom.sources.click_log import write_stage

FAMILIES = {("user_id",): "u", ("user_id", "item_id"): "ui", ("user_id", "day_idx"): "ud", ("user_id", "day_idx", "shop"): "uds"}


def log(spark, seed=3, n=700):
    """A third of the clicks are one user's, with ties, empty minutes and nulls in every key."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = rng.choice(["hot"] * 4 + ["a", "b", "c", "d", "e", "f", "g", None])
        time = rng.choice([None, *[rng.randrange(0, 4000) // rng.choice([1, 7, 60]) for _ in range(30)]])
        rows.append((i, user, rng.choice([1, 2, 3, None]), rng.choice("xyz") if rng.random() < 0.9 else None, None if time is None else time // 1500, time))
    return rows, spark.createDataFrame(rows, "instance_id long, user_id string, item_id int, shop string, day_idx int, context_timestamp long").repartition(3)


def features(name):
    out = {**ordered.lowest_rank(f"{name}_rank", f"{name}_rest"), **ordered.average_rank(f"{name}_average"), **ordered.distinct_time_rank(f"{name}_times")}
    out |= {f"{name}_{what}": ordered.place(what) for what in ("here", "count", "first", "last", "previous", "next", "first_id", "last_id")}
    return out


def brute(rows, keys):
    columns = ["instance_id", "user_id", "item_id", "shop", "day_idx", "context_timestamp"]
    groups = {}
    for row in rows:
        row = dict(zip(columns, row))
        key = tuple(row[k] for k in keys)
        if None not in key and row["context_timestamp"] is not None:
            groups.setdefault(key, []).append((row["context_timestamp"], row["instance_id"]))
    out = {}
    for group in groups.values():
        times = sorted({t for t, _ in group})
        for t, i in group:
            same = [j for s, j in group if s == t]
            before = sum(s < t for s, _ in group)
            at = times.index(t)
            out[i] = (
                before + 1, len(group) - before - 1, before + (len(same) + 1) / 2, at + 1, len(same), len(group), times[0], times[-1],
                times[at - 1] if at else None, times[at + 1] if at + 1 < len(times) else None, min(same), max(same),
            )
    return out


@pytest.mark.parametrize("hot_rows", [3, 40, 2_000_000])
@pytest.mark.parametrize("broadcast_rows", [0, 250_000])
def test_places_against_brute_force(spark, hot_rows, broadcast_rows):
    rows, df = log(spark)
    spark.conf.set("spark.clickloom.broadcastRows", str(broadcast_rows))
    spark.conf.set("spark.clickloom.hotRows", str(hot_rows))
    try:
        named = {keys: features(name) for keys, name in FAMILIES.items()}
        # the rows to widen are some of those that the places are counted in
        got = ordered.place_families(df.where("instance_id % 5 <> 0"), named, source=df).collect()
    finally:
        spark.conf.unset("spark.clickloom.broadcastRows")
        spark.conf.unset("spark.clickloom.hotRows")
    assert sorted(r["instance_id"] for r in got) == [i for i in range(len(rows)) if i % 5]
    for keys, name in FAMILIES.items():
        want, names = brute(rows, keys), list(features(name))
        for r in got:
            have = tuple(r[c] for c in names)
            assert have == want.get(r["instance_id"], (None,) * 12), (keys, r["instance_id"])


def test_a_hot_user_is_cut_into_slices(spark):
    _, df = log(spark)
    tick = ordered.ticks(df, ("user_id", "item_id"), needed=["user_id"])
    n = tick.where("user_id = 'hot'").count()
    starts = {r["user_id"]: r["slice_starts"] for r in ordered._slice_starts(tick, ["user_id"], "context_timestamp", 100).collect()}
    assert set(starts) == {"hot"} and 1 < len(starts["hot"]) <= 2 * n / 100
    assert starts["hot"] == sorted(set(starts["hot"]))


def test_key_sets_without_a_common_column(spark):
    rows, df = log(spark, n=200)
    got = ordered.place_families(df, {("user_id",): ordered.lowest_rank("a"), ("shop",): ordered.lowest_rank("b")}).collect()
    for keys, name in ((("user_id",), "a"), (("shop",), "b")):
        want = brute(rows, keys)
        assert all(r[name] == (want[r["instance_id"]][0] if r["instance_id"] in want else None) for r in got)


def test_empty_log(spark):
    _, df = log(spark, n=5)
    assert ordered.place_families(df.limit(0), {("user_id",): features("u")}).collect() == []


def test_wide_rows_move_once(spark, tmp_path):
    """The ranks of four key sets: one read for the ticks, one of the wide rows, which go through one shuffle."""
    write_stage(events_log(spark, "/root/testdata/sf0.001"), str(tmp_path / "log"))
    staged = spark.read.parquet(str(tmp_path / "log"))
    families = {keys: ordered.lowest_rank(f"{name}_rank", f"{name}_rest_clk") for name, keys in presets.FINAL_RANKS.items()}
    spark.conf.set("spark.clickloom.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = ordered.place_families(staged, families)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.clickloom.broadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # one scan of the log in this plan (another one wrote the ticks), one of the ticks
    assert len(re.findall(r"FileScan parquet", plan)) == 2 and len(re.findall(re.escape(str(tmp_path / "log")), plan)) == 1
    # the wide rows, the ticks by user, the placed ticks
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 3
    assert plan.count("SortMergeJoin") == 1 and "instance_id" in df.columns
    wide = [line for line in plan.splitlines() if "item_property_list" in line and "Exchange" in line]
    assert len(wide) <= 1
    assert df.where(F.col("user_rank").isNull()).count() == 0
