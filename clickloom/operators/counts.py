"""Click counts and distinct counts ("heat").

``source`` is the log to count in, where ``df`` has been widened since; it must hold the same clicks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import timing
from clickloom.operators import ordered
from clickloom.operators.keyed import ROWS, Keys, Pack, as_keys, attach, attach_each, keyed_stats
from clickloom.session import estimated_bytes, limits, written

_ROW_KEY = ("instance_id",)
_USER, _TIME = "user_id", "count_time"


def attach_counts(df: DataFrame, named_keys: Mapping[str, str | Keys], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """Clicks per key set, one column each: ``named_keys`` maps a new column to its keys.

    On a large log the key sets that contain a user are counted where the user's ticks lie: one exchange of the wide rows
    for all of them, where each would need its own as an aggregate that is too large to broadcast.
    """
    log = df if source is None else source
    columns = [*df.columns, *named_keys]
    rest = {name: as_keys(keys) for name, keys in named_keys.items()}
    by_user = {name: keys for name, keys in rest.items() if _USER in keys}
    if len(by_user) > 1 and ordered.TIME in log.columns and estimated_bytes(log) > limits(df.sparkSession).expand_bytes:
        families: dict[Keys, dict[str, Column]] = {}
        for name, keys in by_user.items():
            families.setdefault(keys, {})[name] = ordered.place("count")
        # a click without a time counts as well
        time = {_TIME: F.coalesce(F.col(ordered.TIME), F.lit(0))}
        df = ordered.place_families(df.withColumns(time), families, time=_TIME, spread_by=spread_by, source=log.withColumns(time)).drop(_TIME)
        rest = {name: keys for name, keys in rest.items() if name not in by_user}
    if not rest:
        return df.select(*columns)
    stats = keyed_stats(log, rest.values())
    features: dict[Keys, dict[str, str]] = {}
    for name, keys in rest.items():
        features.setdefault(keys, {})[name] = ROWS
    return attach_each(df, stats, features, spread_by=spread_by).select(*columns)


def attach_target_counts(df: DataFrame, named: Mapping[str, tuple[str | Keys, str]], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """Non-null values of a target per key set: a new column maps to (keys, target)."""
    targets = dict.fromkeys(target for _, target in named.values())
    stats = keyed_stats(df if source is None else source, [keys for keys, _ in named.values()], **{f"n_{t}": F.col(t).isNotNull().cast("bigint") for t in targets})
    features: dict[Keys, dict[str, str]] = {}
    for name, (keys, target) in named.items():
        features.setdefault(as_keys(keys), {})[name] = f"n_{target}"
    return attach_each(df, stats, features, spread_by=spread_by)


def bucket_name(key: str, bins: int) -> str:
    return f"{key}_hour_all" if bins == 1 else f"{key}_hour_{bins}_all"


def attach_bucket_counts(df: DataFrame, keys: Iterable[str], spread_by: Sequence[str] = _ROW_KEY, source: DataFrame | None = None) -> DataFrame:
    """Clicks per key and time-of-day bin of 60, 30, 15, 10 and 5 minutes.

    All bins nest in 5 minutes, so the log is aggregated once, at that grain. The coarser counts are
    window sums over it: 288 rows per key at most, however many clicks the key has.
    """
    keys = list(keys)
    df = df.withColumns(timing.time_buckets())
    source = df if source is None else source.withColumns(timing.time_buckets())
    units = ("hour", "hour_2", "hour_4", "hour_6", "hour_12")
    # an hour holds its bins whole, so partitioning each window by the hour as well changes nothing
    # but lets all of them share one shuffle
    within = {f"n_{bins}": f"sum({ROWS}) OVER (PARTITION BY {{keys}}, hour, hour_{bins})" for bins in (2, 4, 6)}
    within["n_1"] = f"sum({ROWS}) OVER (PARTITION BY {{keys}}, hour)"
    stats = keyed_stats(source, [(key, *units) for key in keys], within, units)
    pack = Pack(df, [*keys, units[-1], *spread_by])
    df, moved = pack.df, []
    for key in keys:
        moved = [key, units[-1], *[c for c in moved if c not in (key, units[-1])]]
        grain = (key, *units)
        named = {bucket_name(key, bins): f"n_{bins}" for bins in (1, 2, 4, 6)}
        rolled = stats.of(grain, **named, **{bucket_name(key, 12): ROWS}).drop(*units[:-1])
        hot = stats.hot_keys(grain)
        hot = None if hot is None else hot.select(key, "hour_12", ROWS)
        df = attach(df, rolled, (key, "hour_12"), size=stats.sizes[grain], hot=hot, spread_by=spread_by, bound=stats.limits)
    return pack.opened(df, moved)


def day_hour_counts(keys: Iterable[str]) -> dict[str, Keys]:
    named: dict[str, Keys] = {}
    for key in keys:
        named[f"{key}_day_sum"] = (key, "day_idx")
        named[f"{key}_day_hour_sum"] = (key, "day_idx", "hour")
    return named


def cross_counts(left: Iterable[str], right: Iterable[str]) -> dict[str, Keys]:
    right = list(right)
    return {f"{a}_day_{b}_sum": (a, "day_idx", b) for a in left for b in right}


def attach_distinct(
    df: DataFrame,
    named: Mapping[str, tuple[str | Keys, str]],
    spread_by: Sequence[str] = _ROW_KEY,
    source: DataFrame | None = None,
) -> DataFrame:
    """Distinct values per key set: a new column maps to (keys, counted column).

    Spark counts distinct values in two steps, by (keys, value) and then by keys, so a hot key is
    spread over its values before it is gathered.
    """
    by_keys: dict[Keys, dict[str, str]] = {}
    for name, (keys, value) in named.items():
        by_keys.setdefault(as_keys(keys), {})[name] = value
    for keys, counted in by_keys.items():
        stats = (df if source is None else source).groupBy(*keys).agg(
            F.count("*").alias(ROWS), *[F.countDistinct(value).alias(name) for name, value in counted.items()]
        )
        stats = written(stats)
        size = stats.count()
        df = attach(df, stats.drop(ROWS), keys, size=size, hot=stats.select(*keys, ROWS), spread_by=spread_by)
    return df
