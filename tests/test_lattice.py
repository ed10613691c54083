"""Key sets summed up from each other: the plan, and the same results as one pass over the log."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import counts, history, keyed
from clickloom.operators.keyed import keyed_stats, maximal, plan_lattice
from clickloom.plans import catalogue, presets
from clickloom.plans.rolling_stage import prepared
from clickloom.sources.adapters import events_log

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def large(spark):
    """Every log counts as too large to be expanded to many key sets."""
    spark.conf.set("spark.clickloom.expandBytes", "0")
    yield
    spark.conf.unset("spark.clickloom.expandBytes")


def test_roots_cover_all_sets_and_join_while_they_stay_small():
    values = {"user": 10**9, "item": 10**7, "hour": 24, "age": 8, "city": 100}
    sets = [("user", "hour"), ("user",), ("item",), ("age", "hour"), ("age", "city"), ("hour",), ("city",)]
    assert maximal(sets) == [("user", "hour"), ("item",), ("age", "hour"), ("age", "city")]
    roots = plan_lattice(sets, values, 10**13)
    # items with ages, hours and cities may make 10^7 * 25 * 9 * 101 keys, still below a tenth of the rows
    assert sorted(map(sorted, roots)) == [["age", "city", "hour", "item"], ["hour", "user"]]
    roots = plan_lattice(sets, values, 10**9)
    assert sorted(map(sorted, roots)) == [["age", "city", "hour"], ["hour", "user"], ["item"]]
    assert plan_lattice(sets, values, 10) == maximal(sets) and plan_lattice([], {}, 0) == []
    for rows in (1, 10**5, 10**9, 10**14):
        assert all(any(set(keys) <= set(root) for root in plan_lattice(sets, values, rows)) for keys in sets)


def test_passes_over_the_log_make_four_sets_at_most(spark, large, monkeypatch):
    plans = []
    write = keyed.written
    monkeypatch.setattr(keyed, "written", lambda df, **how: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, **how))
    log = prepared(events_log(spark, SF_DIR))
    stats = keyed_stats(log, presets.ROLLING_RATES.values(), seen=F.lit(1))
    assert set(stats.sizes) == set(presets.ROLLING_RATES.values()) and len(stats.lineage) > 3
    assert all(len(made) <= keyed.MOST_SETS for read, made in stats.lineage if read is None)
    for read, made in stats.lineage:
        assert read is None or all(set(keys) < set(read) for keys in made)
    # the second write holds the passes over the log: no Expand in it has more than four projections
    expands = [line for line in plans[1].splitlines() if "Expand [[" in line]
    assert expands and all(line.split("], [key_set")[0].count("], [") + 1 <= 2 * keyed.MOST_SETS for line in expands)
    assert "events.parquet" not in plans[1]
    # user alone comes from the smallest table that has the user
    parent = next(read for read, made in stats.lineage if ("user_id",) in made)
    assert parent is not None and stats.sizes[("user_id",)] <= min(stats.sizes[k] for k in stats.sizes if "user_id" in k)


def test_lattice_equals_one_pass(spark, request):
    log = events_log(spark, SF_DIR).withColumn("shop_id", F.expr("if(instance_id % 7 = 0, null, shop_id)"))
    sets = [("user_id", "hour"), "user_id", "item_id", ("item_id", "hour"), "hour", ("shop_id", "hour"), "shop_id", ("shop_id", "item_price_level")]
    within = {"run": "sum(n_rows) OVER (PARTITION BY {keys} ORDER BY hour)"}

    def rows(stats):
        return {keys: sorted(map(str, stats.of(keys).collect())) for keys in stats.sizes}

    plain = keyed_stats(log, sets, within, ("hour",), bought=F.col("is_trade"), shops=F.col("shop_id").isNotNull().cast("long"))
    request.getfixturevalue("large")
    lattice = keyed_stats(log, sets, within, ("hour",), bought=F.col("is_trade"), shops=F.col("shop_id").isNotNull().cast("long"))
    assert len(plain.lineage) == 1 and len(lattice.lineage) > 1
    assert rows(lattice) == rows(plain) and lattice.sizes == plain.sizes and lattice.values == plain.values


def test_features_do_not_depend_on_the_way(spark, request):
    log = events_log(spark, SF_DIR)
    his, now = log.where("day_idx < 29"), log.where("day_idx = 29")

    def made():
        df = counts.attach_counts(log, {**counts.day_hour_counts(presets.USER_LEVELS), **presets.FIRST_USER_COUNTS})
        df = history.asof_cvr(df, [*presets.FIRST_ITEM_RATE_KEYS, *presets.FIRST_PAIR_RATE_KEYS], source=log)
        means = history.history_means(his, now, {**presets.FINAL_MEANS, "hour_price_mean": ("hour", "item_price_level"), "shop_price_mean": ("shop_id", "item_price_level")})
        return [sorted(map(tuple, catalogue.result(frame).collect()), key=str) for frame in (df, means)]

    plain = made()
    request.getfixturevalue("large")
    assert made() == plain


def test_empty_log(spark, large):
    stats = keyed_stats(events_log(spark, SF_DIR).limit(0), presets.ROLLING_RATES["user"] and [("user_id", "hour"), "user_id", "hour", "item_id", "shop_id"])
    assert set(stats.sizes.values()) == {0} and stats.of("user_id").count() == 0


def test_counts_by_user_share_one_exchange(spark, request):
    log = events_log(spark, SF_DIR).withColumn("context_timestamp", F.expr("if(instance_id % 13 = 0, null, context_timestamp)")).withColumn("shop_id", F.expr("if(instance_id % 7 = 0, null, shop_id)"))
    some = {name: presets.FIRST_USER_COUNTS[name] for name in ("user_day_sum", "user_day_hour_minute_sum", "user_day_shop_sum")}
    named = {**presets.FINAL_USER_PAIRS, **some, "shop_all": "shop_id"}
    plain = sorted(map(str, catalogue.added(counts.attach_counts(log, named), log).collect()))
    request.getfixturevalue("large")
    request.getfixturevalue("split_keys")
    spark.conf.unset("spark.clickloom.hotRows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_user = counts.attach_counts(log, {**presets.FINAL_USER_PAIRS, **some})
        plan = by_user._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning") == 3
        # users cut into slices count the same
        spark.conf.set("spark.clickloom.hotRows", "3")
        assert sorted(map(str, catalogue.added(counts.attach_counts(log, named), log).collect())) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcasts_share_a_budget_of_bytes(spark):
    df = spark.range(1000).select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("id").alias("instance_id"))
    stats = keyed_stats(df, ["a", "b"])
    one = keyed.broadcast_size(stats.of("a"), 1000)
    spark.conf.set("spark.clickloom.broadcastBytes", str(int(one * 1.5)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = keyed.attach_each(df, keyed_stats(df, ["a", "b"]), {("a",): {"x": "n_rows"}, ("b",): {"y": "n_rows"}})
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 1 and plan.count("SortMergeJoin") == 1
        assert joined.where("x <> 1 or y <> 1").count() == 0
    finally:
        spark.conf.unset("spark.clickloom.broadcastBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
