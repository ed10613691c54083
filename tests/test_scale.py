"""Hot keys: the split join gives the plain join's rows, and really splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.operators import counts, history, ordered
from clickloom.operators.keyed import attach, keyed_stats
from clickloom.sources import click_log
from plain_priors import digamma, solve_prior, trigamma


def skewed_log(spark):
    """900 rows, a third of them of user 0, which also repeats items and seconds."""
    i = F.col("id")
    return spark.range(900).select(
        i.alias("instance_id"),
        F.when(i % 3 == 0, F.lit(0)).otherwise(i % 41).cast("long").alias("user_id"),
        (i % 7).alias("item_id"),
        (i * 37 % 500).alias("context_timestamp"),
        (i % 5).cast("int").alias("day_idx"),
        (i % 11 == 0).cast("int").alias("is_trade"),
    )


def features(log):
    df = counts.attach_counts(log, {"n_user": "user_id", "n_pair": ("user_id", "item_id")})
    df = counts.attach_distinct(df, {"kinds": ("user_id", "item_id")}, source=log)
    df = ordered.place_features(df, "user_id", {**ordered.lowest_rank("rank", "rest"), **ordered.gaps()}, source=log)
    df = history.asof_cvr(df, ["user_id"], source=log)
    his, now = log.where("day_idx < 4"), df.where("day_idx = 4")
    return history.history_cvr(his, now, [("user_id", "item_id")])


def test_split_join_equals_plain_join(spark, request):
    log = skewed_log(spark)
    plain = sorted(map(tuple, features(log).collect()))
    request.getfixturevalue("split_keys")
    assert sorted(map(tuple, features(log).collect())) == plain
    assert len(plain) == log.where("day_idx = 4").count()


def test_hot_key_is_spread(spark, split_keys):
    log = skewed_log(spark)
    stats = keyed_stats(log, ["user_id"])
    assert stats.hot[("user_id",)] > 0
    joined = attach(log, stats.of("user_id"), "user_id", size=stats.sizes[("user_id",)], hot=stats.hot_keys("user_id"))
    # a stage keyed by user alone would hold all 314 rows of user 0 in one partition
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r[1] for r in joined.where("user_id = 0").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(sizes) > 1 and joined.count() == log.count()


def test_prior_fit_recovers_a_planted_prior():
    rng = np.random.default_rng(7)
    impressions = rng.integers(20, 400, 4000)
    conversions = rng.binomial(impressions, rng.beta(2.0, 40.0, 4000))
    histogram = {
        kind: tuple(a.astype(float) for a in np.unique(values, return_counts=True))
        for kind, values in {"I": impressions, "C": conversions, "M": impressions - conversions}.items()
    }
    prior = solve_prior(histogram)
    assert prior.converged and abs(prior.alpha - 2) < 0.15 and abs(prior.beta - 40) < 3
    slow = solve_prior(histogram, max_steps=20_000, compat=True)
    assert abs(slow.alpha - prior.alpha) < 1e-3 and abs(slow.beta - prior.beta) < 0.05


def test_prior_without_a_maximum():
    none = {"I": (np.array([5.0]), np.array([3.0])), "C": (np.array([0.0]), np.array([3.0])), "M": (np.array([5.0]), np.array([3.0]))}
    assert solve_prior(none).alpha is None and solve_prior(none).pooled == 0.0


def test_prior_of_keys_without_spread_is_the_pooled_rate():
    even = {"I": (np.array([10.0]), np.array([50.0])), "C": (np.array([2.0]), np.array([50.0])), "M": (np.array([8.0]), np.array([50.0]))}
    prior = solve_prior(even)
    # infinitely strong, or so strong that a key's own counts no longer matter
    rate = prior.pooled if prior.alpha is None else prior.alpha / (prior.alpha + prior.beta)
    assert abs(rate - 0.2) < 1e-6 and (prior.alpha is None or prior.alpha > 1e6)


def test_a_header_of_other_names_is_an_error(spark, tmp_path):
    names = [f.name for f in click_log.CLICK_LOG.fields]
    swapped = [{"user_id": "item_id", "item_id": "user_id"}.get(n, n) for n in names]
    for name, header in (("good", names), ("bad", swapped)):
        (tmp_path / name).write_text(" ".join(header) + "\n" + " ".join("1" for _ in names) + "\n")
    assert click_log.read_click_log(spark, str(tmp_path / "good")).count() == 1
    with pytest.raises(Exception, match="user_id"):
        click_log.read_click_log(spark, str(tmp_path / "bad")).collect()


def test_digamma_values():
    assert abs(digamma(1.0) + 0.5772156649015329) < 1e-11
    assert abs(digamma(0.5) + 1.9635100260214235) < 1e-11
    assert abs(trigamma(1.0) - np.pi**2 / 6) < 1e-9
