"""Conversion rates and means over earlier days.

Two forms. The split form aggregates a history table and attaches it to the current day (``source`` is
that day's log where ``now`` has been widened since; it spares a second run of the wide plan). The as-of
form serves every day at once: the log is reduced to one row per (key, day), and a range frame over
the days ending at -1 gives each day the sum of what came before it. A row's own day is never in its
history, and test rows (labels -1 and -2) never count as outcomes.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.rates import LABEL, is_bought, is_known
from clickloom.operators.filters import flag_new
from clickloom.operators.keyed import ROWS, Budget, Keys, KeyedStats, Pack, as_keys, attach, attach_each, keyed_stats

DAY = "day_idx"
_ROW_KEY = ("instance_id",)
SEEN, BOUGHT = "n_known", "n_bought"


def key_name(keys: str | Keys) -> str:
    return "_".join(as_keys(keys))


def outcome_stats(his: DataFrame, key_sets: Iterable[str | Keys], **more: Column) -> KeyedStats:
    return keyed_stats(his, key_sets, **{SEEN: is_known(), BOUGHT: is_bought(), **more})


def _derived(df: DataFrame, features: Mapping[str, Column], drop: Iterable[str]) -> DataFrame:
    return df.withColumns(dict(features)).drop(*drop)


def _counted_rows(now: DataFrame, key_sets: Sequence[Keys], his: KeyedStats) -> KeyedStats | None:
    """Row counts of ``now`` by those key sets whose statistics are too large to broadcast."""
    large = [keys for keys in key_sets if his.sizes[keys] > his.limits.broadcast_rows]
    return keyed_stats(now, large) if large else None


def _attach_history(now: DataFrame, his: KeyedStats, features: Mapping[Keys, Mapping[str, str]], spread_by: Sequence[str], source: DataFrame | None = None) -> DataFrame:
    rows = _counted_rows(now if source is None else source, list(features), his)
    budget = Budget(his.limits)
    pack = Pack(now, [*(c for keys in features for c in keys), *spread_by])
    now, moved = pack.df, []
    for keys, named in features.items():
        moved = [*keys, *[c for c in moved if c not in keys]]
        hot = rows.hot_keys(keys) if rows is not None and keys in rows.hot else None
        now = attach(now, his.of(keys, **named), keys, size=his.sizes[keys], hot=hot, spread_by=spread_by, bound=his.limits, budget=budget)
    return pack.opened(now, moved)


def history_cvr(his: DataFrame, now: DataFrame, key_sets: Iterable[str | Keys], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """``<keys>_sum``, ``_buy`` and ``_cvr`` from the labelled history rows; null for unseen keys."""
    key_sets = [as_keys(k) for k in key_sets]
    return attach_cvr(outcome_stats(his.where(F.col(LABEL).isin(0, 1)), key_sets), now, key_sets, spread_by, source)


def attach_cvr(stats: KeyedStats, now: DataFrame, key_sets: Iterable[str | Keys], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """:func:`history_cvr` from aggregates that exist. A key seen only in unlabelled rows has no history."""
    key_sets = [as_keys(k) for k in key_sets]
    seen, bought = f"nullif({SEEN}, 0)", f"if({SEEN} > 0, {BOUGHT}, NULL)"
    named = {keys: {f"{key_name(keys)}_sum": seen, f"{key_name(keys)}_buy": bought} for keys in key_sets}
    now = _attach_history(now, stats, named, spread_by, source)
    rates = {}
    for keys in key_sets:
        name = key_name(keys)
        rates[f"{name}_cvr"] = F.expr(f"{name}_buy / nullif({name}_sum, 0)")
    return now.withColumns(rates)


def rate_features(his: DataFrame, now: DataFrame, named_keys: Mapping[str, str | Keys], fill: float = 1.0, spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """``<name>_count``, ``_sum`` and ``_rate``; an unseen key gets rate ``fill`` and counts 0."""
    his = his.where(F.col(LABEL).isin(0, 1))
    stats = outcome_stats(his, named_keys.values())
    features = {as_keys(keys): {f"{name}_count": SEEN, f"{name}_sum": BOUGHT} for name, keys in named_keys.items()}
    now = _attach_history(now, stats, features, spread_by, source)
    return now.withColumns(_filled_rates(named_keys, fill))


def _filled_rates(names: Iterable[str], fill: float) -> dict[str, Column]:
    columns: dict[str, Column] = {}
    for name in names:
        columns[f"{name}_rate"] = F.expr(f"coalesce({name}_sum / nullif({name}_count, 0), {fill}D)")
        columns[f"{name}_count"] = F.expr(f"coalesce({name}_count, 0)")
        columns[f"{name}_sum"] = F.expr(f"coalesce({name}_sum, 0)")
    return columns


def history_means(his: DataFrame, now: DataFrame, named: Mapping[str, tuple[str | Keys, str]], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """Mean of an attribute per key: a new column maps to (keys, attribute)."""
    attributes = dict.fromkeys(attribute for _, attribute in named.values())
    return attach_means(keyed_stats(his, [keys for keys, _ in named.values()], **attribute_totals(attributes)), now, named, spread_by, source)


def attribute_totals(attributes: Iterable[str]) -> dict[str, Column]:
    """Row values whose sums give the mean of each attribute."""
    return {f"t_{a}": F.col(a) for a in attributes} | {f"c_{a}": F.col(a).isNotNull().cast("bigint") for a in attributes}


def attach_means(stats: KeyedStats, now: DataFrame, named: Mapping[str, tuple[str | Keys, str]], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """:func:`history_means` from aggregates that exist."""
    features: dict[Keys, dict[str, str]] = {}
    for name, (keys, attribute) in named.items():
        features.setdefault(as_keys(keys), {})[name] = f"t_{attribute} / nullif(c_{attribute}, 0)"
    return _attach_history(now, stats, features, spread_by, source)


def mean_deviations(df: DataFrame, named: Mapping[str, tuple[str, str, str]]) -> DataFrame:
    """Difference from a mean and its absolute value: ``{stem: (difference, column, mean)}``."""
    columns: dict[str, Column] = {}
    for absolute, (difference, column, mean) in named.items():
        columns[difference] = F.col(column) - F.col(mean)
        columns[absolute] = F.abs(F.col(column) - F.col(mean))
    return df.withColumns(columns)


def first_appearance(his: DataFrame, now: DataFrame, named: Mapping[str, str], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """1 where the key's value never occurs in the history: a new column maps to a key."""
    return attach_first_appearance(keyed_stats(his, named.values()), now, named, spread_by, source)


def attach_first_appearance(stats: KeyedStats, now: DataFrame, named: Mapping[str, str], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """:func:`first_appearance` from aggregates that exist."""
    large = {name: key for name, key in named.items() if stats.sizes[as_keys(key)] > stats.limits.broadcast_rows}
    small = {name: key for name, key in named.items() if name not in large}
    now = _attach_history(now, stats, {as_keys(key): {name: ROWS} for name, key in small.items()}, spread_by, source)
    now = now.withColumns({name: F.col(name).isNull().cast("int") for name in small}) if small else now
    for name, key in large.items():
        # null keys of the history match nothing
        now = flag_new(now, stats.of(key, **{ROWS: ROWS}).dropna(subset=list(as_keys(key))), key, name, spread_by, stats.limits, stats.sizes[as_keys(key)])
    return now


# ---- as-of form ------------------------------------------------------------------------------


def _before(days: int | None) -> str:
    """The days before a row's own, all of them or the last ``days``: at most one row per day."""
    start = "UNBOUNDED" if days is None else str(days)
    return f"(PARTITION BY {{keys}} ORDER BY {DAY} RANGE BETWEEN {start} PRECEDING AND 1 PRECEDING)"


def attach_asof(
    df: DataFrame,
    key_sets: Iterable[str | Keys],
    daily: Mapping[str, Column],
    running: Mapping[str, str],
    days: int | None = None,
    prefix: str = "",
    spread_by: Sequence[str] = _ROW_KEY,
    source: DataFrame | None = None,
) -> tuple[DataFrame, list[Keys]]:
    """Attach running sums of daily aggregates over the days before each row's own.

    ``daily`` defines the row values summed up by (key, day); ``running`` maps a suffix to the one to sum,
    attached as ``<prefix><keys>_<suffix>``. ``days`` limits the frame to that many days back. The
    windows run over one row per key and day. ``source`` is the log that holds the history where
    ``df`` is only some days of it; it must hold those days as well.
    """
    key_sets = [as_keys(k) for k in key_sets]
    within = {f"run_{suffix}": f"sum({column}) OVER {_before(days)}" for suffix, column in running.items()}
    stats = keyed_stats(df if source is None else source, [(*keys, DAY) for keys in key_sets], within, (DAY,), **daily)
    named = {(*keys, DAY): {f"{prefix}{key_name(keys)}_{suffix}": f"run_{suffix}" for suffix in running} for keys in key_sets}
    df = attach_each(df, stats, named, spread_by=spread_by)
    return df, key_sets


def history_days(df: DataFrame) -> DataFrame:
    """For each day of the log, how many days with rows came before it. One row per day."""
    days = df.select(DAY).distinct()
    # one row per calendar day, so a single window partition stays tiny
    return days.select(DAY, (F.row_number().over(Window.orderBy(DAY)) - 1).alias("days_before"))


def asof_cvr(
    df: DataFrame,
    key_sets: Iterable[str | Keys],
    days: int | None = None,
    per_day: bool = False,
    spread_by: Sequence[str] = _ROW_KEY,
    source: DataFrame | None = None,
) -> DataFrame:
    """``<keys>_sum``, ``_buy`` and ``_cvr`` over all earlier days, or the last ``days`` ones.

    ``per_day`` divides ``_sum`` and ``_buy`` by the number of earlier days in the log.
    """
    source = df if source is None else source
    df, key_sets = attach_asof(df, key_sets, {SEEN: is_known(), BOUGHT: is_bought()}, {"sum": SEEN, "buy": BOUGHT}, days=days, spread_by=spread_by, source=source)
    columns: dict[str, Column] = {}
    if per_day:
        # one row per calendar day
        df = df.join(F.broadcast(history_days(source)), DAY, "left")
    for keys in key_sets:
        name = key_name(keys)
        columns[f"{name}_cvr"] = F.expr(f"{name}_buy / nullif({name}_sum, 0)")
        # a key whose earlier rows are all unlabelled has no history
        by_days = " / days_before" if per_day else ""
        columns[f"{name}_sum"] = F.expr(f"nullif({name}_sum, 0){by_days}")
        columns[f"{name}_buy"] = F.expr(f"CASE WHEN {name}_sum > 0 THEN {name}_buy{by_days} END")
    df = df.withColumns(columns)
    return df.drop("days_before") if per_day else df


def asof_rates(df: DataFrame, named_keys: Mapping[str, str | Keys], days: int = 9, fill: float = 1.0, spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """As :func:`rate_features`, for every day at once, over the ``days`` days before it."""
    df, _ = attach_asof(df, named_keys.values(), {SEEN: is_known(), BOUGHT: is_bought()}, {"seen": SEEN, "bought": BOUGHT}, days=days, prefix="h_", spread_by=spread_by, source=source)
    moved = {}
    for name, keys in named_keys.items():
        moved[f"h_{key_name(keys)}_seen"] = f"{name}_count"
        moved[f"h_{key_name(keys)}_bought"] = f"{name}_sum"
    return df.withColumnsRenamed(moved).withColumns(_filled_rates(named_keys, fill))


def asof_means(df: DataFrame, named: Mapping[str, tuple[str | Keys, str]], days: int | None = None, spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """Mean of an attribute per key over earlier days: a new column maps to (keys, attribute)."""
    attributes = list(dict.fromkeys(attribute for _, attribute in named.values()))
    daily: dict[str, Column] = {}
    for attribute in attributes:
        daily[f"t_{attribute}"] = F.col(attribute)
        daily[f"c_{attribute}"] = F.col(attribute).isNotNull().cast("bigint")
    before = _before(days)
    within = {f"m_{a}": f"sum(t_{a}) OVER {before} / nullif(sum(c_{a}) OVER {before}, 0)" for a in attributes}
    features: dict[Keys, dict[str, str]] = {}
    for name, (keys, attribute) in named.items():
        features.setdefault((*as_keys(keys), DAY), {})[name] = f"m_{attribute}"
    stats = keyed_stats(df if source is None else source, features, within, (DAY,), **daily)
    return attach_each(df, stats, features, spread_by=spread_by)


def asof_first_appearance(df: DataFrame, named: Mapping[str, str], days: int | None = None, spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """1 where the key's value has no row in the days before, for every day at once."""
    df, _ = attach_asof(df, named.values(), {}, {"before": ROWS}, days=days, prefix="h_", spread_by=spread_by, source=source)
    columns = {name: F.coalesce(F.col(f"h_{key}_before") == 0, F.lit(True)).cast("int") for name, key in named.items()}
    return _derived(df, columns, [f"h_{key}_before" for key in named.values()])


def yesterday_activity(df: DataFrame, named_keys: Mapping[str, str | Keys], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """``yes_<name>_count`` and ``yes_<name>_sum``: labelled clicks and buys of the key on the day before."""
    df, _ = attach_asof(df, named_keys.values(), {SEEN: is_known(), BOUGHT: is_bought()}, {"seen": SEEN, "bought": BOUGHT}, days=1, prefix="y_", spread_by=spread_by, source=source)
    moved = {}
    for name, keys in named_keys.items():
        moved[f"y_{key_name(keys)}_seen"] = f"yes_{name}_count"
        moved[f"y_{key_name(keys)}_bought"] = f"yes_{name}_sum"
    return df.withColumnsRenamed(moved)
