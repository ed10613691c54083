"""Bloom filters: exact flags without a shuffle of the wide rows. Sketches: heat over days, and their error."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import filters, sketches
from clickloom.operators.keyed import ROWS  # noqa: F401
from clickloom.plans import presets
from clickloom.sources.adapters import events_log

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    """Known keys count as too many to broadcast; the strangers let through do not."""
    spark.conf.set("spark.clickloom.broadcastRows", "2000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.clickloom.broadcastRows")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tables(spark, known=40_000, rows=60_000):
    his = spark.range(known).select((F.col("id") * 3).alias("user_id"), F.concat(F.lit("i"), (F.col("id") % 11).cast("string")).alias("item"))
    i = F.col("id")
    now = spark.range(rows).select(
        i.alias("instance_id"), F.when(i % 3 == 0, F.lit(3)).when(i % 50 == 1, None).otherwise(i * 2).alias("user_id"),
        F.concat(F.lit("i"), (i % 11).cast("string")).alias("item"), F.lit("wide " * 5).alias("wide"),
    )
    return his, now


@pytest.mark.parametrize("keys", ["user_id", ("user_id", "item")])
def test_flag_equals_the_join(spark, no_broadcast, keys):
    his, now = tables(spark)
    names = [keys] if isinstance(keys, str) else list(keys)
    got = filters.flag_new(now, his, keys, "new")
    want = now.join(his.select(*names).distinct().withColumn("known", F.lit(1)), names, "left").select("instance_id", F.col("known").isNull().cast("int").alias("want"))
    both = got.join(want, "instance_id")
    assert both.count() == now.count() and both.where("new <> want").count() == 0
    assert 0 < got.where("new = 1").count() < now.count()
    # what is shuffled is narrow: the wide column is in no exchange of the plan
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan


def test_filter_lets_few_strangers_through(spark):
    his, _ = tables(spark, 100_000)
    words = filters.filter_words(100_000)
    table = filters.bloom_filter(his.select("user_id"), words)
    assert table.count() <= words
    strangers = spark.range(100_000).select((F.col("id") * 3 + 1).alias("user_id"))
    assert filters.maybe_in(strangers, table, "user_id", words).where("maybe_member").count() < 1500
    assert filters.maybe_in(his, table, "user_id", words).where("not maybe_member").count() == 0


@pytest.mark.parametrize("rows", [0, 2000, 250_000])
def test_a_small_history_and_too_many_strangers(spark, rows, monkeypatch):
    monkeypatch.setattr(filters, "WORDS_PER_KEY", 0.001)
    spark.conf.set("spark.clickloom.broadcastRows", str(rows))
    spark.conf.set("spark.clickloom.hotRows", "1000")
    try:
        his, now = tables(spark, 3000, 9000)
        got = {r["instance_id"]: r["new"] for r in filters.flag_new(now, his, "user_id", "new").select("instance_id", "new").collect()}
        known = {r[0] for r in his.select("user_id").collect()}
        assert got == {r[0]: int(r[1] not in known) for r in now.select("instance_id", "user_id").collect()}
        kept = filters.keep_members(now, his.unionByName(his), "user_id")
        assert sorted(r[0] for r in kept.select("instance_id").collect()) == sorted(i for i, new in got.items() if not new)
        none = filters.flag_new(now, his.limit(0), "user_id", "new")
        assert none.where("new = 0").count() == 0 and filters.keep_members(now.limit(0), his, "user_id").count() == 0
    finally:
        spark.conf.unset("spark.clickloom.broadcastRows")
        spark.conf.unset("spark.clickloom.hotRows")


def test_heat_over_any_days_from_sketches(spark):
    log = events_log(spark, SF_DIR)
    stored = sketches.day_sketches(log, presets.FINAL_HEAT)
    for first, last in ((0, 8), (12, 20), (20, 28), (29, 29), (50, 60)):
        days = log.where(F.col("day_idx").between(first, last))
        for name, (key, value) in presets.FINAL_HEAT.items():
            got = {r[key]: r[name] for r in sketches.heat_over(stored[(key,)], key, first, last).collect()}
            want = {r[0]: r[1] for r in days.groupBy(key).agg(F.countDistinct(value)).collect()}
            assert got == want, (name, first, last)
    now = log.where("day_idx = 29")
    out = sketches.attach_heat(now, stored, 20, 28)
    assert out.count() == now.count() and set(presets.FINAL_HEAT) <= set(out.columns)


def test_error_of_large_counts(spark):
    i = F.col("id")
    df = spark.range(900_000).select((i % 3).alias("k"), (i % 9).cast("int").alias("day_idx"), F.floor(i / 2).alias("v"))
    got = sketches.heat_over(sketches.day_sketches(df, {"n": ("k", "v")})[("k",)], "k", 0, 8).collect()
    want = {r[0]: r[1] for r in df.groupBy("k").agg(F.countDistinct("v")).collect()}
    assert len(got) == 3 and all(abs(r["n"] / want[r["k"]] - 1) < 4 * 0.0163 for r in got)


def test_empty_log(spark):
    stored = sketches.day_sketches(events_log(spark, SF_DIR).limit(0), {"n": ("user_id", "item_id")})
    assert sketches.heat_over(stored[("user_id",)], "user_id", 0, 9).collect() == []
