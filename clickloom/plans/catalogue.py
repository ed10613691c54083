"""The registered queries: every operator over the test tables' click logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions import parsing, timing
from clickloom.operators import counts, encode, history, metrics, model, ordered, prepare, priors, sketches, smoothing, snapshots
from clickloom.plans import final_stage, first_stage, presets, rolling_stage
from clickloom.session import shared_folder, written
from clickloom.sources import click_log
from clickloom.sources.adapters import events_log, raw_events_log, star_log

TARGET = 29
ROLLING_TARGETS = (20, 21, 22, 23, 24)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def result(df: DataFrame, columns: Iterable[str] | None = None, ids: Iterable[str] = ("instance_id",)) -> DataFrame:
    """Integers as bigint and doubles to six places, so that both engines give one form."""
    names = list(df.columns if columns is None else [*ids, *columns])
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in names:
        kind = kinds[name]
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append(f"round({name}, 6) AS {name}")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            out.append(f"date_format({name}, 'yyyy-MM-dd HH:mm:ss') AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)


def added(df: DataFrame, base: DataFrame) -> DataFrame:
    """The id and the columns that ``base`` lacks."""
    known = set(base.columns)
    return result(df, [c for c in df.columns if c not in known])


def by_hour(log: DataFrame) -> DataFrame:
    """Times cut to the hour, which makes many clicks simultaneous."""
    return log.withColumn("context_timestamp", F.col("context_timestamp") - F.pmod(F.col("context_timestamp"), F.lit(3600)))


def scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/clickloom/{uuid.uuid4().hex}"


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return prepare.split_history_current(events_log(spark, sf_dir), TARGET)


#: Derived columns that no feature of the first stage reads.
FIRST_UNREAD = ("item_category_list", "item_property_list", "cate_0", "cate_2", "pre_0", "pre_1", "pre_2", "ts", "day", "context_id", "context_page_id")


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    day = F.col("day_idx")
    return prepare.assemble_log(
        log.where(day < TARGET - 1), log.where(day == TARGET - 1).drop("is_trade"), log.where(day == TARGET).drop("is_trade")
    )


def scored(log: DataFrame) -> DataFrame:
    """Two fixed pseudo-scores per row and a class from the first."""
    row = F.col("instance_id")
    one, two = (row * 37 % 1000 + 0.5) / 1001, (row * 53 % 997 + 0.5) / 998
    return log.withColumns({"one": one, "two": two, "prediction": (one >= 0.5).cast("int")})


def score_file(log: DataFrame, which: str) -> DataFrame:
    return scored(log).select("instance_id", F.col(which).alias("predicted_score"))


# ---- sources and sinks -----------------------------------------------------------------------


@query
def read_click_log(spark, sf_dir):
    path = scratch(spark)
    click_log.write_click_log(raw_events_log(spark, sf_dir), path)
    return result(click_log.read_click_log(spark, path))


@query
def read_or_quarantine(spark, sf_dir):
    """A text log with its columns turned around and some fields broken: rows that read right, and lines kept apart, by reason."""
    path, broken = scratch(spark), F.col("instance_id") % 50
    log = raw_events_log(spark, sf_dir)
    texts = log.select(*[F.col(name).cast("string").alias(name) for name in log.columns[::-1]])
    texts = texts.withColumn("item_id", F.when(broken == 1, F.lit("none")).when(broken == 2, F.concat("item_id", F.lit(".5"))).otherwise(F.col("item_id")))
    texts.write.option("sep", " ").option("header", True).csv(path)
    read = click_log.read_or_quarantine(spark, path)
    good = read.good.groupBy("item_brand_id").agg(F.count("*").alias("n"), F.sum("item_id").alias("item_ids"))
    bad = read.bad.groupBy("reason").agg(F.count("*").alias("n"))
    good = good.select(F.lit("good").alias("kind"), F.col("item_brand_id").cast("string").alias("what"), "n", "item_ids")
    bad = bad.select(F.lit("bad").alias("kind"), F.col("reason").alias("what"), "n", F.lit(None).cast("bigint").alias("item_ids"))
    return result(good.unionByName(bad), ["kind", "what", "n", "item_ids"], ids=())


@query
def stage_roundtrip(spark, sf_dir):
    log, path = events_log(spark, sf_dir), scratch(spark)
    click_log.write_stage(log, path)
    staged = click_log.read_stage(spark, path, log.schema)
    return result(staged, ["day_idx", "hour", "user_id", "item_id", "cate_1", "is_trade"])


@query
def write_scores(spark, sf_dir):
    path = scratch(spark)
    click_log.write_scores(score_file(events_log(spark, sf_dir), "one"), path)
    return result(click_log.read_scores(spark, path))


@query
def feature_catalog(spark, sf_dir):
    return result(click_log.feature_catalog(raw_events_log(spark, sf_dir)))


@query
def log_profile(spark, sf_dir):
    return result(metrics.log_profile(raw_events_log(spark, sf_dir)))


# ---- parsing, time, assembly -----------------------------------------------------------------


@query
def parse_category(spark, sf_dir):
    return result(raw_events_log(spark, sf_dir).withColumns(parsing.category_ids()), ["cate_0", "cate_1", "cate_2"])


@query
def parse_predicted_category(spark, sf_dir):
    return result(raw_events_log(spark, sf_dir).withColumns(parsing.predicted_ids()), ["pre_0", "pre_1", "pre_2"])


@query
def parse_category_str(spark, sf_dir):
    parts = parsing.text_parts()
    return result(raw_events_log(spark, sf_dir).withColumns(parts), parts)


@query
def time_parts(spark, sf_dir):
    log = raw_events_log(spark, sf_dir).withColumns(timing.time_parts())
    china = {f"china_{name}": column for name, column in timing.time_parts(zone="Asia/Shanghai").items()}
    names = ["ts", "day_idx", "day", "hour", "minute"]
    return result(log.withColumns(china), [*names, *[f"china_{n}" for n in names]])


@query
def shift_day(spark, sf_dir):
    log = events_log(spark, sf_dir).withColumn("shifted", timing.shift_days("ts"))
    return result(log.withColumn("shifted_day", F.dayofmonth("shifted")), ["shifted", "shifted_day"])


@query
def time_buckets(spark, sf_dir):
    return result(events_log(spark, sf_dir).withColumns(timing.time_buckets()), ["hour_2", "hour_4", "hour_6", "hour_12"])


@query
def assemble_log(spark, sf_dir):
    return result(assembled(spark, sf_dir), ["day_idx", "is_trade"])


@query
def dedupe_log(spark, sf_dir):
    log = raw_events_log(spark, sf_dir)
    twice = log.unionByName(log.where(F.col("is_trade") == 1))
    return result(prepare.dedupe_log(twice), ["user_id", "item_id", "context_timestamp", "is_trade"])


@query
def fill_nulls(spark, sf_dir):
    his, now = split(spark, sf_dir)
    pair = history.history_cvr(his, now, [("user_id", "item_id")])
    names = ["user_id_item_id_sum", "user_id_item_id_buy", "user_id_item_id_cvr"]
    return result(prepare.fill_nulls(pair.select("instance_id", *names)), names)


@query
def feature_select_cols(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return result(log, prepare.feature_columns(log, presets.FINAL_EXCLUDED))


@query
def split_history_current(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return result(prepare.tagged({"history": his, "current": now}), ["part", "day_idx"])


@query
def temporal_split(spark, sf_dir):
    log = assembled(spark, sf_dir)
    early, late = prepare.hour_split(log)
    days, end = prepare.day_split(log, 20, 28)
    known, unknown = prepare.label_split(log)
    parts = {
        "hour_train": early, "hour_test": late, "day_train": days, "day_test": end,
        "recent": prepare.recent_days(log, TARGET), "labelled": known, "unlabelled": unknown,
    }
    return result(prepare.tagged(parts), ["part"])


@query
def semi_filter_scores(spark, sf_dir):
    log = assembled(spark, sf_dir)
    return result(prepare.keep_requested(score_file(log, "one"), log.where(F.col("is_trade") == -2)), ["predicted_score"])


# ---- counts ----------------------------------------------------------------------------------


@query
def count_by_key(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_counts(log, presets.FINAL_TOTALS), log)


@query
def count_by_pair(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_counts(log, presets.FINAL_USER_PAIRS), log)


@query
def count_by_bucket(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_bucket_counts(log, presets.FINAL_BUCKET_KEYS), log)


@query
def count_by_day_hour(spark, sf_dir):
    log = events_log(spark, sf_dir)
    named = counts.day_hour_counts([*presets.FIRST_ITEM_COUNT_KEYS, *presets.USER_LEVELS, *presets.SHOP_KEYS])
    return added(counts.attach_counts(log, {**named, **presets.FIRST_USER_COUNTS}), log)


@query
def count_cross(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_counts(log, counts.cross_counts(presets.USER_LEVELS, presets.ITEM_LEVELS)), log)


@query
def count_target(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_target_counts(log, presets.ROLLING_COUNTS), log)


@query
def heat_distinct(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_distinct(log, presets.FINAL_HEAT), log)


@query
def heat_days(spark, sf_dir):
    """Heat of the target day's rows over the nine days before it, from sketches kept by day."""
    log = events_log(spark, sf_dir)
    now = log.where(F.col("day_idx") == TARGET)
    return added(sketches.attach_heat(now, sketches.day_sketches(log, presets.FINAL_HEAT), TARGET - 9, TARGET - 1), now)


@query
def heat_distinct_daily(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(counts.attach_distinct(log, presets.FIRST_KINDS), log)


# ---- order in time ---------------------------------------------------------------------------


def _placed(spark, sf_dir, families, log=None):
    log = events_log(spark, sf_dir) if log is None else log
    return added(ordered.place_families(log, families), log)


USER_DAY = ("user_id", "day_idx")


@query
def click_gaps(spark, sf_dir):
    return _placed(spark, sf_dir, {USER_DAY: ordered.gaps()})


@query
def click_gaps_tied(spark, sf_dir):
    return _placed(spark, sf_dir, {USER_DAY: ordered.gaps()}, by_hour(events_log(spark, sf_dir)))


@query
def simultaneous_flag(spark, sf_dir):
    gaps = ordered.gaps(compat=False)
    return _placed(spark, sf_dir, {USER_DAY: {"if_czxtdj": gaps["if_czxtdj"]}}, by_hour(events_log(spark, sf_dir)))


@query
def first_last_gap(spark, sf_dir):
    features = {
        **ordered.since_first("user_day_first_time_cha"),
        **ordered.until_last("user_day_last_time_cha"),
        **ordered.duration("user_day_time_duration"),
    }
    return _placed(spark, sf_dir, {USER_DAY: features})


@query
def first_last_gap_item(spark, sf_dir):
    features = {**ordered.since_first("same_item_first_time_cha"), **ordered.until_last("same_item_last_time_cha")}
    return _placed(spark, sf_dir, {(*USER_DAY, "item_id"): features})


@query
def first_last_gap_category(spark, sf_dir):
    return _placed(spark, sf_dir, {(*USER_DAY, "cate_1"): ordered.since_first("same_cate_first_time_cha")})


@query
def first_last_gap_shop(spark, sf_dir):
    features = {**ordered.since_first("same_shop_first_time_cha"), **ordered.until_last("same_shop_last_time_cha")}
    return _placed(spark, sf_dir, {(*USER_DAY, "shop_id"): features})


@query
def first_last_flag(spark, sf_dir):
    return _placed(
        spark, sf_dir,
        {
            "user_id": {**ordered.is_first("if_user_first"), **ordered.is_last("if_user_last")},
            USER_DAY: {**ordered.is_first("if_user_day_first_look"), **ordered.is_last("if_user_day_last_look")},
        },
    )


@query
def first_last_flag_item(spark, sf_dir):
    return _placed(
        spark, sf_dir,
        {
            ("user_id", "item_id"): {**ordered.is_first("if_first"), **ordered.is_last("if_last")},
            (*USER_DAY, "item_id"): {**ordered.is_first("if_day_first"), **ordered.is_last("if_day_last")},
        },
    )


@query
def last_flag_shop(spark, sf_dir):
    return _placed(spark, sf_dir, {("user_id", "shop_id"): ordered.is_last("if_user_shop_last")})


@query
def first_minus_last_flag(spark, sf_dir):
    return _placed(
        spark, sf_dir,
        {
            (*USER_DAY, "item_id"): {**ordered.last_minus_first("last_click"), **ordered.is_first("first_click")},
            USER_DAY: ordered.is_last("all_last_click"),
        },
    )


@query
def click_rank(spark, sf_dir):
    families = {keys: ordered.lowest_rank(f"{name}_rank") for name, keys in presets.FINAL_RANKS.items()}
    return _placed(spark, sf_dir, families, by_hour(events_log(spark, sf_dir)))


@query
def remaining_clicks(spark, sf_dir):
    families = {keys: ordered.lowest_rank(f"{name}_rank", f"{name}_rest_clk") for name, keys in presets.FINAL_RANKS.items()}
    return _placed(spark, sf_dir, families)


@query
def click_avg_rank(spark, sf_dir):
    return _placed(spark, sf_dir, {USER_DAY: ordered.average_rank("today_time_rank")}, by_hour(events_log(spark, sf_dir)))


@query
def distinct_time_rank(spark, sf_dir):
    families = {keys: ordered.distinct_time_rank(f"{name}_time_rank") for name, keys in presets.FINAL_RANKS.items()}
    return _placed(spark, sf_dir, families, by_hour(events_log(spark, sf_dir)))


@query
def rank_ratio(spark, sf_dir):
    log = by_hour(events_log(spark, sf_dir))
    df = ordered.place_families(log, {"user_id": ordered.distinct_time_rank("time_rank"), ("user_id", "shop_id"): ordered.distinct_time_rank("shop_time_rank")})
    return added(ordered.rank_ratios(df, {"shop_count_user_click_rate": "shop_time_rank"}), log)


@query
def before_click_features(spark, sf_dir):
    log = by_hour(events_log(spark, sf_dir))
    return added(ordered.before_click_features(log), log)


@query
def prev_next_gap(spark, sf_dir):
    return _placed(spark, sf_dir, {"user_id": ordered.next_previous()})


@query
def prev_next_gap_item(spark, sf_dir):
    return _placed(spark, sf_dir, {("user_id", "item_id"): ordered.next_previous("item_", "item_time_rank")})


# ---- history ---------------------------------------------------------------------------------


@query
def history_cvr(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(history.history_cvr(his, now, presets.FINAL_HISTORY), now)


@query
def history_cvr_pair(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(history.history_cvr(his, now, presets.FINAL_HISTORY_PAIRS), now)


@query
def asof_cvr(spark, sf_dir):
    log = assembled(spark, sf_dir)
    return added(history.asof_cvr(log, [*presets.FIRST_ITEM_RATE_KEYS, *presets.FIRST_USER_RATE_KEYS], per_day=True), log)


@query
def asof_cvr_pair(spark, sf_dir):
    log = assembled(spark, sf_dir)
    return added(history.asof_cvr(log, presets.FIRST_PAIR_RATE_KEYS), log)


@query
def rolling_history_rate(spark, sf_dir):
    log = events_log(spark, sf_dir)
    named = {"user": ("user_id",), "item": ("item_id",), "item_hour": ("item_id", "hour"), "occup_brand": ("user_occupation_id", "item_brand_id")}
    return added(history.asof_rates(log, named, days=presets.ROLLING_DAYS), log)


@query
def rate_feature(spark, sf_dir):
    log = rolling_stage.prepared(events_log(spark, sf_dir))
    now = log.where(F.col("day_idx") == TARGET)
    return added(history.rate_features(prepare.recent_days(log, TARGET), now, presets.ROLLING_RATES), now)


@query
def incremental_history(spark, sf_dir):
    """History rates and means of the target day from a store that grew by days."""
    log = events_log(spark, sf_dir)
    now = log.where(F.col("day_idx") == TARGET)
    store = snapshots.HistoryStore(spark, scratch(spark), [*presets.FINAL_HISTORY, *presets.FINAL_HISTORY_PAIRS, "item_brand_id"], dict.fromkeys(a for _, a in presets.FINAL_MEANS.values()))
    store.add(log.where(F.col("day_idx") < TARGET - 2))
    for day in (TARGET - 2, TARGET - 1):
        store.add(log.where(F.col("day_idx") == day))
    df = store.cvr(now, TARGET, [*presets.FINAL_HISTORY, *presets.FINAL_HISTORY_PAIRS])
    return added(store.means(df, TARGET, presets.FINAL_MEANS, source=now), now)


@query
def history_mean(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(history.history_means(his, now, presets.FINAL_MEANS), now)


@query
def asof_mean(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(history.asof_means(log, {**presets.FIRST_MEANS, "user_id_item_price_level_mean": ("user_id", "item_price_level")}), log)


@query
def mean_deviation(spark, sf_dir):
    log = rolling_stage.prepared(events_log(spark, sf_dir))
    means = history.asof_means(log, presets.ROLLING_MEANS, days=presets.ROLLING_DAYS)
    return added(history.mean_deviations(means, presets.ROLLING_DEVIATIONS), log)


@query
def yesterday_activity(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return added(history.yesterday_activity(log, {"cate": ("user_id", "cate_1"), "shop": ("user_id", "shop_id")}), log)


@query
def first_appearance(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(history.first_appearance(his, now, {**presets.FIRST_SEEN, "pair_first_apper": ("user_id", "item_id")}), now)


# ---- smoothing -------------------------------------------------------------------------------


@query
def smoothed_cvr(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(smoothing.smoothed_cvr(his, now, ["item_id", "user_id", ("user_id", "item_id")]), now)


@query
def smoothed_cvr_asof(spark, sf_dir):
    log = events_log(spark, sf_dir)
    # day of month 19 is day index 18
    priors = {day - 1: prior for day, prior in smoothing.DAY_PRIORS.items()}
    return added(smoothing.smoothed_cvr_asof(log, ["item_id", "user_id"], priors), log)


@query
def prior_histogram(spark, sf_dir):
    return result(priors.count_histogram(events_log(spark, sf_dir), "user_id"))


@query
def fit_beta_prior(spark, sf_dir):
    log = events_log(spark, sf_dir)
    rows = []
    for key in ("item_id", "user_id"):
        prior = priors.fit_beta_prior(log, key)
        rows.append((key, prior.alpha, prior.beta, prior.converged))
    return spark.createDataFrame(rows, "key string, alpha double, beta double, converged boolean")


@query
def smoothed_cvr_fitted(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(smoothing.smoothed_cvr_fitted(his, now, "item_id"), now)


#: Key sets with a prior for each day, and the fixed-point steps of the queries that have a SQL form.
PRIOR_KEYS = ("item_id", "user_id", ("user_occupation_id", "item_brand_id"))
PRIOR_STEPS = 3


@query
def smoothed_cvr_fitted_steps(spark, sf_dir):
    """As ``smoothed_cvr_fitted``, with a few steps of the original's iteration from (1, 1)."""
    his, now = split(spark, sf_dir)
    return added(smoothing.smoothed_cvr_fitted(his, now, "item_id", max_steps=PRIOR_STEPS, compat=True), now)


@query
def day_priors(spark, sf_dir):
    """The prior of each key set for each day, fitted to the days before it."""
    return result(priors.day_priors(assembled(spark, sf_dir), PRIOR_KEYS), ["key_set", "day_idx", "alpha", "beta", "pooled", "converged"], ids=())


def _priors_by_steps(spark, sf_dir):
    return priors.day_priors(assembled(spark, sf_dir), PRIOR_KEYS, max_steps=PRIOR_STEPS, compat=True)


@query
def day_priors_steps(spark, sf_dir):
    return result(_priors_by_steps(spark, sf_dir), ["key_set", "day_idx", "alpha", "beta", "pooled", "steps"], ids=())


@query
def smoothed_cvr_by_day(spark, sf_dir):
    log = assembled(spark, sf_dir)
    return added(priors.smoothed_cvr_by_day(log, PRIOR_KEYS, _priors_by_steps(spark, sf_dir)), log)


# ---- encoding --------------------------------------------------------------------------------


@query
def category_match(spark, sf_dir):
    log = raw_events_log(spark, sf_dir).withColumns(parsing.text_parts())
    return result(log.withColumn("cate_is_in_pre_cate", parsing.category_match()), ["cate_is_in_pre_cate"])


@query
def property_overlap(spark, sf_dir):
    log = raw_events_log(spark, sf_dir).withColumn("pro_pre_rate", parsing.property_overlap())
    return result(log, ["pro_pre_rate"])


@query
def one_hot(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(encode.one_hot(his, now, presets.ROLLING_ONE_HOT, form="columns")[1], now)


@query
def label_encode(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(encode.label_encode(his, now, ["item_city_id", "item_property_list"])[1], now)


# ---- metrics and scores ----------------------------------------------------------------------


@query
def dominant_category(spark, sf_dir):
    return result(metrics.dominant_category(events_log(spark, sf_dir)))


@query
def positive_means(spark, sf_dir):
    return result(metrics.positive_means(events_log(spark, sf_dir), "item_id", ["user_age_level", "shop_score_service"]))


@query
def value_counts(spark, sf_dir):
    return result(metrics.value_counts(scored(events_log(spark, sf_dir)), "prediction"))


@query
def score_summary(spark, sf_dir):
    return result(metrics.score_summary(score_file(events_log(spark, sf_dir), "one")))


@query
def score_correlation(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return result(metrics.score_correlation(score_file(log, "one"), score_file(log, "two")))


@query
def cvr_by_minute(spark, sf_dir):
    return result(metrics.cvr_by_minute(events_log(spark, sf_dir), day=5, hour=23))


@query
def attach_transfer_score(spark, sf_dir):
    his, now = split(spark, sf_dir)
    # a score file in which some ids occur twice
    scores = score_file(now, "one").unionByName(score_file(now.where(F.col("item_id") % 3 == 0), "two"))
    return added(metrics.attach_score(now, scores), now)


@query
def blend_scores(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return result(metrics.blend_scores([score_file(log, "one"), score_file(log, "two")]))


@query
def blend_sweep(spark, sf_dir):
    return result(metrics.blend_sweep(scored(assembled(spark, sf_dir)), "one", "two"))


@query
def log_loss(spark, sf_dir):
    return result(metrics.log_loss(scored(assembled(spark, sf_dir)), score="one"))


@query
def classification_report(spark, sf_dir):
    return result(metrics.classification_report(scored(events_log(spark, sf_dir))))


# ---- whole feature tables --------------------------------------------------------------------


@query
def build_day_features(spark, sf_dir):
    table = rolling_stage.day_features(events_log(spark, sf_dir), ROLLING_TARGETS)
    base = set(rolling_stage.prepared(events_log(spark, sf_dir)).columns)
    return result(table, ["day_idx", *[c for c in table.columns if c not in base]])


@query
def final_stage_features(spark, sf_dir):
    his, now = split(spark, sf_dir)
    return added(final_stage.features(his, now, score_file(now, "one")), now)


@query
def first_stage_features(spark, sf_dir):
    # derived once, as every family of features reads it again
    log = written(events_log(spark, sf_dir).drop(*FIRST_UNREAD))
    return added(first_stage.features(log), log)


@query
def rate_table(spark, sf_dir):
    sets = [*presets.DUMP_ITEM_RATE_KEYS, *presets.FIRST_USER_RATE_KEYS, *presets.FIRST_SHOP_RATE_KEYS, *presets.FIRST_PAIR_RATE_KEYS]
    keys = dict.fromkeys(key for keys in sets for key in keys)
    log = written(assembled(spark, sf_dir).select("instance_id", "is_trade", "day_idx", *keys))
    return added(first_stage.rate_table(log), log)


# ---- the wide star log -----------------------------------------------------------------------

_STAR_KEYS = ("user_id", "item_id", "item_brand_id", "item_price_level", "shop_id", "shop_star_level")


@query
def star_count_by_key(spark, sf_dir):
    # the counted keys and the id only: the other columns would go through every exchange of the joins
    log = written(star_log(spark, sf_dir).select("context_id", *_STAR_KEYS))
    named = {**{f"{key}_all": key for key in _STAR_KEYS}, "user_id_shop_id_all": ("user_id", "shop_id")}
    df = counts.attach_counts(log, named, spread_by=("context_id",))
    return result(df, ["item_id", "shop_id", *named], ids=("context_id",))


@query
def star_asof_cvr(spark, sf_dir):
    keys = ["item_brand_id", "shop_id", ("user_occupation_id", "cate_1")]
    columns = ["item_brand_id", "shop_id", "user_occupation_id", "cate_1"]
    log = written(star_log(spark, sf_dir).select("context_id", "item_id", *columns, "day_idx", "is_trade"))
    df = history.asof_cvr(log, keys, spread_by=("context_id",))
    return result(df, ["item_id", "shop_id", "day_idx", *[c for c in df.columns if c not in log.columns]], ids=("context_id",))


# ---- models ----------------------------------------------------------------------------------

BOOSTER = presets.SMALL_BOOSTER
MODEL_COLUMNS = ["item_id_cvr", "user_id_cvr", "item_price_level", "item_sales_level", "user_age_level", "hour"]


def model_table(spark, sf_dir):
    """Labelled rows with as-of rates, over the whole log; the columns that models and their splits read.

    The log is derived once: as the source of the rates and as the rows that get them it would be parsed twice.
    """
    own = [c for c in MODEL_COLUMNS if not c.endswith("_cvr")]
    log = written(assembled(spark, sf_dir).select("instance_id", "is_trade", "day_idx", "item_id", "user_id", *own))
    return written(history.asof_cvr(log, ["item_id", "user_id"]).select("instance_id", "is_trade", "day_idx", *MODEL_COLUMNS))


@query
def train_score_gbt(spark, sf_dir):
    train, test = prepare.label_split(model_table(spark, sf_dir))
    return model.score(model.fit(train, MODEL_COLUMNS, BOOSTER), test, MODEL_COLUMNS)


@query
def train_early_stop(spark, sf_dir):
    known, test = prepare.label_split(model_table(spark, sf_dir))
    train, held_out = prepare.hour_split(known, 17)
    fitted = model.fit_early_stop(train, held_out, MODEL_COLUMNS, presets.OFFLINE_BOOSTER)
    return model.score(fitted, test, MODEL_COLUMNS)


@query
def train_refit(spark, sf_dir):
    known, test = prepare.label_split(model_table(spark, sf_dir))
    train, held_out = prepare.day_split(known, 0, 27)
    fitted, rounds = model.fit_refit(train, held_out, known, MODEL_COLUMNS, BOOSTER)
    return model.score(fitted, test, MODEL_COLUMNS).withColumn("rounds", F.lit(rounds))


@query
def transfer_score(spark, sf_dir):
    return first_stage.transfer_scores(written(assembled(spark, sf_dir)), TARGET, BOOSTER)


@query
def rolling_scores(spark, sf_dir):
    scores, rounds = rolling_stage.run(written(events_log(spark, sf_dir)), ROLLING_TARGETS)
    return scores.withColumn("rounds", F.lit(rounds))


@query
def cross_validate(spark, sf_dir):
    losses = model.cross_validate(model_table(spark, sf_dir), MODEL_COLUMNS, BOOSTER)
    return spark.createDataFrame(list(enumerate(losses)), "fold int, log_loss double")


@query
def feature_importance(spark, sf_dir):
    train, _ = prepare.label_split(model_table(spark, sf_dir))
    return model.importance(model.fit(train, MODEL_COLUMNS, BOOSTER), MODEL_COLUMNS, spark)


@query
def greedy_select(spark, sf_dir):
    known, _ = prepare.label_split(model_table(spark, sf_dir))
    train, test = prepare.day_split(known, 0, 27)
    chosen = model.greedy_select(train, test, MODEL_COLUMNS, presets.TRIAL_BOOSTER)
    return spark.createDataFrame(list(enumerate(chosen)), "position int, feature string")


@query
def blended_experiment(spark, sf_dir):
    train, test = prepare.label_split(model_table(spark, sf_dir))
    boosters = [BOOSTER, replace(BOOSTER, depth=3)]
    return model.run_experiment(train, test, MODEL_COLUMNS, boosters, [0.5, 0.5])


@query
def experiment_report(spark, sf_dir):
    """Two boosters on a day split: the log loss of each (weights 1 and 0) and of their blends."""
    scored = model.day_experiment(model_table(spark, sf_dir), 0, 27, MODEL_COLUMNS, (BOOSTER, presets.SECOND_BOOSTER))
    return result(model.experiment_losses(scored), ["weight", "log_loss"], ids=())


def offline_run(spark, sf_dir):
    log = events_log(spark, sf_dir)
    return final_stage.offline(log, TARGET, score_file(log.where(F.col("day_idx") == TARGET), "one"), look_ahead=False)


@query
def offline_report(spark, sf_dir):
    return result(offline_run(spark, sf_dir).report())


@query
def offline_importance(spark, sf_dir):
    return result(offline_run(spark, sf_dir).importance(), ["feature", "importance"], ids=())


@query
def final_stage_scores(spark, sf_dir):
    log = written(assembled(spark, sf_dir))
    transferred = written(first_stage.transfer_scores(log, TARGET, BOOSTER).select("instance_id", "predicted_score"))
    # half of the target day keeps its labels, as the final run trains on the day itself
    raw = events_log(spark, sf_dir).select("instance_id", F.col("is_trade").alias("known"))
    labelled = log.join(raw, "instance_id").withColumn(
        "is_trade", F.when((F.col("day_idx") == TARGET) & (F.col("hour") < 12), F.col("known")).otherwise(F.col("is_trade"))
    )
    return final_stage.run(labelled.drop("known"), TARGET, transferred, BOOSTER)
