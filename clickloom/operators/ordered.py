"""Features of a click's place in time among the clicks of its key.

A window over raw clicks would put a whole key into one task, which fails once a single user holds a
large share of the log. So the clicks are first counted into ticks: one row for each second and each
combination of all the keys that the wanted features use. The ticks are written once and dealt out by
the columns that all key sets have in common (the user). Every key set's windows then run over ticks
where they lie, without another shuffle, and one join carries all the features back to the clicks. So the
log is read twice and its wide rows move once, however many key sets there are.

A user with more than ``Limits.hot_rows`` ticks is cut into slices of time of about that size. Windows
run inside a slice; a small table of the slices' totals gives each one what came before and after it.

Clicks of one key in the same second are ordered by ``instance_id``; the log is expected to be free
of whole-row duplicates.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import timing
from clickloom.operators.keyed import ROWS, Keys, Pack, as_keys, attach
from clickloom.session import Limits, limits, written

TIME = "context_timestamp"
ROW_ID = "instance_id"
_PLACE = "place_"
_SLICE, _STARTS = "tick_slice", "slice_starts"
_MINUTE = 60


def ticks(df: DataFrame, keys: str | Keys, time: str = TIME, row_id: str = ROW_ID, needed: Sequence[str] | None = None) -> DataFrame:
    """Clicks per (keys, time), with the lowest and highest row id among them.

    Rows where a ``needed`` key (by default any) or the time is null form no tick.
    """
    keys = as_keys(keys)
    return df.dropna(subset=[*(keys if needed is None else needed), time]).groupBy(*keys, time).agg(
        F.count("*").alias(ROWS), F.min(row_id).alias("first_id"), F.max(row_id).alias("last_id")
    )


def _places(keys: Sequence[str], time: str) -> tuple[dict[str, Column], dict[str, Column]]:
    """Places among the ticks of the keys, of which several may share a time; the second ones need the first."""
    ordered = Window.partitionBy(*keys).orderBy(time)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier, same = ordered.rangeBetween(Window.unboundedPreceding, -1), ordered.rangeBetween(0, 0)
    first = {
        "here": F.sum(ROWS).over(same),
        "count": F.sum(ROWS).over(whole),
        "before": F.coalesce(F.sum(ROWS).over(earlier), F.lit(0)),
        "time_rank": F.dense_rank().over(ordered).cast("bigint"),
        "first": F.min(time).over(whole),
        "last": F.max(time).over(whole),
        "previous": F.max(time).over(earlier),
        "following": F.lead(time).over(ordered),
        "first_id": F.min("first_id").over(same),
        "last_id": F.max("last_id").over(same),
    }
    # of the ticks of one time the last one has the next time, the others have their own
    after = F.max(_PLACE + "following").over(same)
    return first, {"next": F.when(after > F.col(time), after)}


def place(name: str) -> Column:
    """One of the places that :func:`place_families` computes, for use in its features."""
    return F.col(_PLACE + name)


def _derived_places() -> dict[str, Column]:
    return {
        _PLACE + "rank": place("before") + 1,
        _PLACE + "rest": place("count") - place("before") - 1,
        _PLACE + "average_rank": place("before") + (place("here") + 1) / F.lit(2.0),
    }


_NAMES = ("here", "count", "before", "time_rank", "first", "last", "previous", "next", "first_id", "last_id")


def _placed(tick: DataFrame, families: Sequence[Keys], time: str, sliced: bool) -> DataFrame:
    """``tick`` with a column ``place_<name>_<i>`` for each place in the i-th family; null where one of its keys is null."""
    base = tick
    for i, keys in enumerate(families):
        first, second = _places([*keys, _SLICE] if sliced else keys, time)
        tick = tick.withColumns({_PLACE + name: column for name, column in first.items()})
        tick = tick.withColumns({_PLACE + name: column for name, column in second.items()})
        if sliced:
            tick = _carried(tick, base, keys, time)
        known = F.lit(True)
        for key in keys:
            known = known & F.col(key).isNotNull()
        tick = tick.withColumns({f"{_PLACE}{name}_{i}": F.when(known, place(name)) for name in _NAMES}).drop(*[_PLACE + name for name in (*_NAMES, "following")])
    return tick


def _carried(tick: DataFrame, base: DataFrame, keys: Keys, time: str) -> DataFrame:
    """Places within a slice become places within the whole key, by the totals of the key's other slices.

    The totals come from ``base``, the ticks as they were before any family, so that the plan grows by one join a family.
    """
    ordered = Window.partitionBy(*keys).orderBy(_SLICE)
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    # one row for each key and slice
    seconds = base.groupBy(*keys, _SLICE, time).agg(F.sum(ROWS).alias("n"))
    totals = seconds.groupBy(*keys, _SLICE).agg(F.sum("n").alias("n"), F.count("*").alias("times"), F.min(time).alias("low"), F.max(time).alias("high"))
    carried = totals.select(
        *keys, _SLICE,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("carried_before"), F.coalesce(F.sum("times").over(earlier), F.lit(0)).alias("carried_times"),
        F.sum("n").over(whole).alias("carried_count"), F.min("low").over(whole).alias("carried_first"), F.max("high").over(whole).alias("carried_last"),
        F.max("high").over(earlier).alias("carried_previous"), F.lead("low").over(ordered).alias("carried_next"),
    )
    # a key that is null has no places
    tick = tick.join(carried, [*keys, _SLICE], "left")
    return tick.withColumns(
        {
            _PLACE + "before": place("before") + F.col("carried_before"),
            _PLACE + "time_rank": place("time_rank") + F.col("carried_times"),
            _PLACE + "count": F.col("carried_count"),
            _PLACE + "first": F.col("carried_first"),
            _PLACE + "last": F.col("carried_last"),
            _PLACE + "previous": F.coalesce(place("previous"), F.col("carried_previous")),
            _PLACE + "next": F.coalesce(place("next"), F.col("carried_next")),
        }
    ).drop(*[c for c in carried.columns if c.startswith("carried_")])


def _slice_starts(tick: DataFrame, anchor: Sequence[str], time: str, hot_rows: int) -> DataFrame:
    """For each anchor with more than ``hot_rows`` ticks, the minutes at which its slices start.

    A slice ends with the minute in which it reaches ``hot_rows`` ticks, so there are at most 2 * rows / hot_rows starts.
    """
    minute = F.floor(F.col(time) / _MINUTE).cast("bigint").alias("minute")
    hot = tick.groupBy(*anchor).agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).drop("n")
    minutes = tick.join(F.broadcast(hot), list(anchor), "left_semi").groupBy(*anchor, minute).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*anchor).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1))
    numbered = minutes.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / hot_rows))
    starts = numbered.groupBy(*anchor, "part").agg(F.min("minute").alias("start"))
    return starts.groupBy(*anchor).agg(F.array_sort(F.collect_list("start")).alias(_STARTS))


def placed_ticks(tick: DataFrame, families: Sequence[Keys], anchor: Sequence[str], time: str, rows: int, bound: Limits) -> DataFrame:
    """All places of all families, on each of ``tick``'s ``rows`` rows."""
    anchor = list(anchor)
    if rows > bound.hot_rows:
        starts = written(_slice_starts(tick, anchor, time, bound.hot_rows))
        if not starts.isEmpty():
            sliced = tick.join(F.broadcast(starts), anchor)
            minute = F.floor(F.col(time) / _MINUTE)
            sliced = sliced.withColumn(_SLICE, F.size(F.filter(_STARTS, lambda start: start <= minute))).drop(_STARTS)
            cold = tick.join(F.broadcast(starts), anchor, "left_anti").repartition(*anchor)
            hot = _placed(written(sliced).repartition(*anchor, _SLICE), families, time, sliced=True).drop(_SLICE)
            return _placed(cold, families, time, sliced=False).unionByName(hot)
    return _placed(tick.repartition(*anchor), families, time, sliced=False)


def place_families(
    df: DataFrame,
    families: Mapping[str | Keys, Mapping[str, Column]],
    time: str = TIME,
    row_id: str = ROW_ID,
    spread_by: Sequence[str] = (ROW_ID,),
    source: DataFrame | None = None,
) -> DataFrame:
    """Attach ``features`` of several key sets, expressions over a click's places among the clicks of its keys.

    Places that no feature uses are pruned by Catalyst. A row whose key is null gets nulls.
    ``source`` is the log to place the clicks in, where ``df`` has been widened or filtered since;
    it must hold all clicks of ``df``. Key sets without a column in common are attached one by one.
    """
    families = {as_keys(keys): features for keys, features in families.items() if features}
    if not families:
        return df
    columns = list(dict.fromkeys(c for keys in families for c in keys))
    anchor = [c for c in columns if all(c in keys for keys in families)]
    if not anchor:
        for keys, features in families.items():
            df = place_families(df, {keys: features}, time, row_id, spread_by, source)
        return df
    bound = limits(df.sparkSession)
    tick = written(ticks(df if source is None else source, tuple(columns), time, row_id, needed=anchor))
    rows, most = tick.agg(F.count("*"), F.coalesce(F.max(ROWS), F.lit(0))).first()
    placed = placed_ticks(tick, list(families), anchor, time, rows, bound)
    grain = [*columns, time]
    wide = placed.select(*grain, *[c for c in placed.columns if c.startswith(_PLACE)])
    # only clicks of one second can make a tick hot
    hot = tick.where(F.col(ROWS) > bound.hot_rows).select(*grain, ROWS) if most > bound.hot_rows else None
    pack = Pack(df, [*grain, *spread_by])
    df = pack.opened(attach(pack.df, wide, grain, size=rows, hot=hot, spread_by=spread_by, bound=bound, null_safe=True))
    for i, features in enumerate(families.values()):
        df = df.withColumnsRenamed({f"{_PLACE}{name}_{i}": _PLACE + name for name in _NAMES})
        df = df.withColumns(_derived_places()).withColumns(dict(features))
        df = df.drop(*_derived_places(), *[_PLACE + name for name in _NAMES])
    return df


def place_features(
    df: DataFrame,
    keys: str | Keys,
    features: Mapping[str, Column],
    time: str = TIME,
    row_id: str = ROW_ID,
    spread_by: Sequence[str] = (ROW_ID,),
    source: DataFrame | None = None,
) -> DataFrame:
    """:func:`place_families` for one key set."""
    return place_families(df, {keys: features}, time, row_id, spread_by, source)


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


# ---- features over places --------------------------------------------------------------------


def gaps(compat: bool = True, time: str = TIME, row_id: str = ROW_ID) -> dict[str, Column]:
    """Seconds since the previous and until the next click, and a flag for simultaneous clicks.

    ``later_gap`` is plain seconds. With ``compat``, ``later_time_cha`` repeats the original's value:
    the wrapped seconds of a negative difference, negated (5 s give -86395, 0 s give 0).
    """
    here, row = F.col(time), F.col(row_id)
    former = F.when(place("first_id") == row, here - place("previous")).when(place("here") > 1, F.lit(0))
    later = F.when(place("last_id") == row, place("next") - here).when(place("here") > 1, F.lit(0))
    features = {
        "former_time_cha": former.cast("bigint"),
        "later_gap": later.cast("bigint"),
        "if_czxtdj": _flag(place("here") > 1),
    }
    if compat:
        features["later_time_cha"] = (-F.pmod(-later, F.lit(timing.DAY))).cast("bigint")
    return features


def since_first(name: str, time: str = TIME) -> dict[str, Column]:
    return {name: timing.day_seconds(F.col(time) - place("first"))}


def until_last(name: str, time: str = TIME) -> dict[str, Column]:
    return {name: timing.day_seconds(place("last") - F.col(time))}


def duration(name: str) -> dict[str, Column]:
    return {name: timing.day_seconds(place("last") - place("first"))}


def is_first(name: str, time: str = TIME) -> dict[str, Column]:
    """1 on every click in the key's first second."""
    return {name: _flag(F.col(time) == place("first"))}


def is_last(name: str, time: str = TIME) -> dict[str, Column]:
    return {name: _flag(F.col(time) == place("last"))}


def last_minus_first(name: str, time: str = TIME) -> dict[str, Column]:
    return {name: _flag(F.col(time) == place("last")) - _flag(F.col(time) == place("first"))}


def lowest_rank(rank: str, rest: str | None = None) -> dict[str, Column]:
    """Lowest rank of the click's time within its key, and the key's clicks less that rank."""
    features = {rank: place("rank")}
    if rest:
        features[rest] = place("rest")
    return features


def average_rank(name: str) -> dict[str, Column]:
    """Rank of the click's time, tied clicks sharing the mean of their ranks."""
    return {name: place("average_rank")}


def distinct_time_rank(name: str, rest: str | None = None) -> dict[str, Column]:
    """Rank over the key's distinct times, and the key's clicks less that rank."""
    features = {name: place("time_rank")}
    if rest:
        features[rest] = place("count") - place("time_rank")
    return features


def next_previous(prefix: str = "", rank: str = "time_rank", time: str = TIME) -> dict[str, Column]:
    """Days and seconds to the key's next distinct time (``_1``) and from its previous one (``_2``).

    Null before the first and after the last time; the rank is always set.
    """
    ahead, behind = place("next") - F.col(time), F.col(time) - place("previous")
    return {
        f"{prefix}days_1": timing.whole_days(ahead),
        f"{prefix}second_1": timing.day_seconds(ahead),
        f"{prefix}days_2": timing.whole_days(behind),
        f"{prefix}second_2": timing.day_seconds(behind),
        rank: place("time_rank"),
    }


# ---- compositions ----------------------------------------------------------------------------


def rank_ratios(df: DataFrame, named: Mapping[str, str], by: str = "time_rank") -> DataFrame:
    return df.withColumns({name: F.when(F.col(by) != 0, F.col(rank) / F.col(by)) for name, rank in named.items()})


def before_click_features(df: DataFrame, category: str = "cate_1") -> DataFrame:
    """Ranks over distinct times by user, and by user with category, shop, item and brand; what remains; rank ratios."""
    families = {("user_id",): distinct_time_rank("time_rank")}
    for label, key in {"cate": category, "shop": "shop_id", "item": "item_id", "brand": "item_brand_id"}.items():
        families[("user_id", key)] = distinct_time_rank(f"{label}_time_rank", f"{label}_count_rank_cha")
    return rank_ratios(place_families(df, families), {"shop_count_user_click_rate": "shop_time_rank", "cate_count_user_click_rate": "cate_time_rank"})
