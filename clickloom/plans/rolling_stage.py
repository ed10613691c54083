"""Rolling baseline: each target day against the nine days before it, with early stop and refit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import parsing
from clickloom.operators import counts, encode, history, model, ordered, prepare
from clickloom.plans import presets
from clickloom.session import written


def prepared(log: DataFrame) -> DataFrame:
    """Text parts in place of the two list columns; the numeric parts of the other runs are dropped."""
    numeric = ["cate_0", "cate_1", "cate_2", "pre_0", "pre_1", "pre_2"]
    return log.withColumns(parsing.text_parts()).drop("item_category_list", "item_property_list", *numeric)


def today_features(df: DataFrame, source: DataFrame) -> DataFrame:
    day = ("user_id", "day_idx")
    families = {
        day: {**ordered.average_rank("today_time_rank"), **ordered.is_last("all_last_click")},
        (*day, "item_id"): {**ordered.last_minus_first("last_click"), **ordered.is_first("first_click")},
    }
    df = ordered.place_families(df, families, source=source)
    return counts.attach_target_counts(df, presets.ROLLING_COUNTS, source=source)


def day_features(log: DataFrame, days: Sequence[int], window: int = presets.ROLLING_DAYS) -> DataFrame:
    """Features of the given days. One pass serves them all: range frames replace a loop over days."""
    # every family reads the log again, so its text parts are cut out once
    log = written(prepared(log))
    first, last = min(days), max(days)
    # the frames look back this far and no further, so older partitions are not read
    source = log.where(F.col("day_idx").between(first - window, last))
    df = ordered.place_features(log.where(F.col("day_idx").isin(*days)), "user_id", ordered.next_previous(), source=log)
    df = written(today_features(df, source))
    df = history.asof_means(df, presets.ROLLING_MEANS, days=window, source=source)
    df = history.mean_deviations(df, presets.ROLLING_DEVIATIONS)
    df = written(history.asof_first_appearance(df, presets.FIRST_SEEN, days=window, source=source))
    single = {name: keys for name, keys in presets.ROLLING_RATES.items() if len(keys) == 1}
    several = {name: keys for name, keys in presets.ROLLING_RATES.items() if len(keys) > 1}
    df = history.asof_rates(df, single, days=window, source=source)
    return history.asof_rates(written(df), several, days=window, source=source)


def run(log: DataFrame, days: Sequence[int], booster: model.Booster = presets.ROLLING_BOOSTER) -> tuple[DataFrame, int]:
    """Scores of the last day. The round count comes from holding out the day before it."""
    log = written(prepare.dedupe_log(log), partition_by="day_idx")
    table = written(prepare.fill_nulls(day_features(log, days)), partition_by="day_idx")
    *earlier, held_out, last = sorted(days)
    day = F.col("day_idx")
    train, test = encode.one_hot(table.where(day < last), table.where(day == last), presets.ROLLING_ONE_HOT, form="columns")
    train, _ = prepare.label_split(train)
    columns = prepare.feature_columns(train, presets.ROLLING_EXCLUDED)
    fitted, rounds = model.fit_refit(train.where(day < held_out), train.where(day == held_out), train, columns, booster)
    return model.score(fitted, test, columns), rounds
