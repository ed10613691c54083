"""Beta priors fitted to conversion counts, many at a time, with all sums on the executors.

A fit needs only how many keys have each number of impressions, conversions and misses. Such histograms, one for each
group (a key set and a day, say), are written once. Every step evaluates all groups that have not converged yet in one
aggregate over them, and hands the driver three sums for each kind of count; the step itself is arithmetic on those.

A prior by day is fitted to the days before it. A key's counts change only on days on which it has clicks, so a day's clicks
move some keys from one value of the histogram to another. The moves are summed up over the days, which gives every day's
histogram without counting any key twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from math import exp, isfinite, log, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.rates import LABEL, is_bought, is_known, smoothed
from clickloom.operators.history import BOUGHT, DAY, SEEN, attach_asof, key_name
from clickloom.operators.keyed import Keys, as_keys, keyed_stats
from clickloom.session import removed, written

GROUP = "prior_group"
KINDS = "ICM"
#: A prior that counts as more impressions than this times the largest key's is no different from the pooled rate.
STRONGEST = 1e6
_SHIFT = 6


@dataclass(frozen=True)
class Prior:
    alpha: float | None
    beta: float | None
    steps: int
    converged: bool
    #: The rate over all impressions, null without any. It stands in where there is no finite prior: without conversions or
    #: misses, or where keys differ no more than by chance and the prior would be infinitely strong.
    pooled: float | None = None


# ---- special functions as columns ------------------------------------------------------------


def _shifted(x: Column) -> tuple[Column, Column]:
    z = x + _SHIFT
    return z, 1 / (z * z)


def digamma(x: Column) -> Column:
    """Recurrence up to x + 6, then the asymptotic series; for x > 0."""
    z, w = _shifted(x)
    series = w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w * (1 / 240 - w / 132))))
    return F.ln(z) - 0.5 / z - series - reduce(lambda a, b: a + b, [1 / (x + k) for k in range(_SHIFT)])


def trigamma(x: Column) -> Column:
    z, w = _shifted(x)
    series = 1 / z + w / 2 + (w / z) * (1 / 6 - w * (1 / 30 - w * (1 / 42 - w * (1 / 30 - w * (5 / 66)))))
    return series + reduce(lambda a, b: a + b, [1 / ((x + k) * (x + k)) for k in range(_SHIFT)])


def log_gamma(x: Column) -> Column:
    z, w = _shifted(x)
    series = (1 / z) * (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188))))
    return (z - 0.5) * F.ln(z) - z + 0.5 * F.ln(F.lit(2 * pi)) + series - reduce(lambda a, b: a + b, [F.ln(x + k) for k in range(_SHIFT)])


# ---- histograms ------------------------------------------------------------------------------


def _kinds(i: str, c: str, keys: str) -> Column:
    return F.expr(f"array(struct('I' AS kind, {i} AS value, {keys} AS keys), struct('C' AS kind, {c} AS value, {keys} AS keys), struct('M' AS kind, ({i}) - ({c}) AS value, {keys} AS keys))")


def count_histogram(df: DataFrame, keys: str | Keys, label: str = LABEL) -> DataFrame:
    """How many keys have each number of impressions (I), conversions (C) and misses (M). A null key is none.

    The values of one kind are distinct and sum to at most the rows of the log, so there are at most
    sqrt(2 * rows) of them: about a million for 5e11 rows.
    """
    keys = as_keys(keys)
    known = df.where(F.col(label).isin(0, 1)).dropna(subset=list(keys))
    per_key = known.groupBy(*keys).agg(F.count("*").alias("i"), F.sum(is_bought(label)).alias("c"))
    return per_key.select(F.inline(_kinds("i", "c", "1L"))).groupBy("kind", "value").agg(F.sum("keys").alias("keys"))


def day_histograms(df: DataFrame, key_sets: Iterable[str | Keys]) -> DataFrame:
    """For each key set and each day of the log, the histograms of the days before it: key_set, day_idx, kind, value, keys.

    Values of 0 are left out; they weigh nothing in a fit. Days without history have no rows.
    """
    key_sets = [as_keys(k) for k in key_sets]
    up_to = "(PARTITION BY {keys} ORDER BY " + DAY + " RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    stats = keyed_stats(
        df, [(*keys, DAY) for keys in key_sets], {"i_after": f"sum({SEEN}) OVER {up_to}", "c_after": f"sum({BOUGHT}) OVER {up_to}"}, (DAY,), **{SEEN: is_known(), BOUGHT: is_bought()}
    )
    moves = []
    for keys in key_sets:
        moved = stats.of((*keys, DAY)).where(F.col(SEEN) > 0).dropna(subset=list(keys))
        both = F.concat(_kinds("i_after", "c_after", "1L"), _kinds(f"i_after - {SEEN}", f"c_after - {BOUGHT}", "-1L"))
        moves.append(moved.select(F.lit(key_name(keys)).alias("key_set"), (F.col(DAY) + 1).alias("since"), F.inline(both)))
    summed = reduce(DataFrame.unionByName, moves).where("value > 0").groupBy("key_set", "kind", "value", "since").agg(F.sum("keys").alias("keys"))
    ordered = Window.partitionBy("key_set", "kind", "value").orderBy("since")
    # one row per calendar day
    days = df.select(DAY).distinct()
    last = days.agg(F.max(DAY).alias("last_day"))
    held = summed.select(
        "key_set", "kind", "value", "since", F.sum("keys").over(ordered).alias("keys"), F.lead("since").over(ordered).alias("until")
    ).where("keys > 0")
    held = held.join(F.broadcast(last)).withColumn("until", F.least(F.col("until") - 1, F.col("last_day")))
    each = held.where("until >= since").select("key_set", F.explode(F.sequence("since", "until")).alias(DAY), "kind", "value", "keys")
    return each.join(F.broadcast(days), DAY, "left_semi")


# ---- fitting ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class _State:
    """A fit between two steps. ``origin`` is where the last step came from, with its likelihood; ``stride`` is how many
    fixed-point steps it made at once."""

    alpha: float
    beta: float
    steps: int = 0
    origin: tuple[float, float, float] | None = None
    stride: int = 1


def _start(moments: Mapping[str, tuple[float, float, float]]) -> tuple[float, float]:
    """The mean rate, and its mean square from pairs of impressions of one key. Moments are keys, sum and sum of v (v - 1)."""
    (n, shown, pairs), (_, bought, bought_pairs) = moments["I"], moments["C"]
    mean = bought / shown
    spread = bought_pairs / pairs - mean * mean if pairs else 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else 0.0
    if strength <= 0:
        strength = max(shown / max(n, 1.0), 2.0)
    return max(mean * strength, 1e-3), max((1 - mean) * strength, 1e-3)


def _evaluated(histograms: DataFrame, states: Mapping[str, _State]) -> dict[str, dict[str, tuple[float, float, float]]]:
    """For each group and kind: sums over keys of the differences of digamma, trigamma and log-gamma between value + parameter and parameter."""
    rows = [(group, s.alpha, s.beta) for group, s in states.items()]
    # one row per open fit
    params = F.broadcast(histograms.sparkSession.createDataFrame(rows, f"{GROUP} string, alpha double, beta double"))
    at = F.when(F.col("kind") == "C", F.col("alpha")).when(F.col("kind") == "M", F.col("beta")).otherwise(F.col("alpha") + F.col("beta"))
    placed = histograms.join(params, GROUP).withColumn("at", at).withColumn("moved", F.col("value") + F.col("at"))
    sums = [F.sum(F.col("keys") * (of(F.col("moved")) - of(F.col("at")))).alias(name) for name, of in (("gain", digamma), ("bend", trigamma), ("log_gain", log_gamma))]
    found: dict[str, dict[str, tuple[float, float, float]]] = {}
    for row in placed.groupBy(GROUP, "kind").agg(*sums).collect():
        found.setdefault(row[GROUP], {})[row["kind"]] = (row["gain"], row["bend"], row["log_gain"])
    return found


def _stepped(state: _State, sums: Mapping[str, tuple[float, float, float]], compat: bool) -> _State:
    (whole, wb, wl), (up, ub, ul), (down, db, dl) = (sums[kind] for kind in KINDS)
    a, b = state.alpha, state.beta
    likelihood = ul + dl - wl
    # sums of many terms differ in their last digits
    if state.origin and likelihood < state.origin[2] - 1e-11 * abs(state.origin[2]):
        # half the way, until it helps
        return _State(sqrt(a * state.origin[0]), sqrt(b * state.origin[1]), state.steps + 1, state.origin)
    fixed = (a * up / whole, b * down / whole)
    if compat:
        return _State(*fixed, state.steps + 1)
    # Newton's step for the logarithms of both, at most to e times or 1 / e of each
    f, g = a * (up - whole), b * (down - whole)
    faa, fbb, fab = a * a * (ub - wb) + f, b * b * (db - wb) + g, -a * b * wb
    det = faa * fbb - fab * fab
    if faa < 0 and det > 0:
        by = (-(f * fbb - g * fab) / det, -(g * faa - f * fab) / det)
        scale = min(1.0, 1.0 / max(abs(by[0]), abs(by[1]), 1e-300))
        return _State(a * exp(by[0] * scale), b * exp(by[1] * scale), state.steps + 1, (a, b, likelihood))
    # fixed-point steps creep towards a strong prior, so as long as they help, each makes the way of twice as many
    stride = 2 * state.stride
    far = (x * exp(min(max(stride * log(y / x), -5.0), 5.0)) for x, y in zip((a, b), fixed))
    return _State(*far, state.steps + 1, (a, b, likelihood), stride)


def solve_priors(histograms: DataFrame, max_steps: int = 200, epsilon: float = 1e-8, compat: bool = False) -> dict[str, Prior]:
    """Maximum-likelihood beta prior of every group of ``histograms`` (``prior_group``, kind, value, keys), a written table.

    Newton steps where the likelihood is concave, and else strides of several fixed-point steps at once; a step that lowers the
    likelihood is halved until it does not. ``compat`` uses fixed-point steps only, from (1, 1),
    ``max_steps`` of them at most. One job per step serves all groups.
    """
    value = F.col("value").cast("double")
    moments: dict[str, dict[str, tuple[float, float, float]]] = {}
    largest: dict[str, float] = {}
    sums = [F.sum("keys").alias("n"), F.sum(F.col("keys") * value).alias("s"), F.sum(F.col("keys") * value * (value - 1)).alias("q"), F.max(value).alias("most")]
    for row in histograms.groupBy(GROUP, "kind").agg(*sums).collect():
        moments.setdefault(row[GROUP], {})[row["kind"]] = (float(row["n"]), row["s"], row["q"])
        largest[row[GROUP]] = max(largest.get(row[GROUP], 0.0), row["most"])
    done: dict[str, Prior] = {}
    pooled: dict[str, float | None] = {}
    states: dict[str, _State] = {}
    for group, own in moments.items():
        shown, bought, missed = (own.get(kind, (0.0, 0.0, 0.0))[1] for kind in KINDS)
        pooled[group] = bought / shown if shown else None
        if not shown or not bought or not missed:
            # no impressions, no conversions or no misses: the likelihood has no finite maximum
            done[group] = Prior(None, None, 0, False, pooled[group])
        else:
            states[group] = _State(*((1.0, 1.0) if compat else _start(own)))
    while states:
        evaluated = _evaluated(histograms, states)
        for group, state in list(states.items()):
            new = _stepped(state, evaluated[group], compat)
            moved = max(abs(new.alpha - state.alpha), abs(new.beta - state.beta))
            if not isfinite(new.alpha + new.beta) or new.alpha + new.beta > STRONGEST * largest[group]:
                done[group] = Prior(None, None, new.steps, False, pooled[group])
            elif moved < epsilon * (1.0 if compat else max(1.0, state.alpha + state.beta)):
                done[group] = Prior(state.alpha, state.beta, new.steps, True, pooled[group])
            elif new.steps >= max_steps:
                done[group] = Prior(new.alpha, new.beta, new.steps, False, pooled[group])
            else:
                states[group] = new
                continue
            del states[group]
    return done


def fit_beta_prior(df: DataFrame, keys: str | Keys, max_steps: int = 200, epsilon: float = 1e-8, compat: bool = False) -> Prior:
    """The prior of one key over all labelled rows. Without any there is neither a prior nor a pooled rate."""
    histogram = written(count_histogram(df, keys).withColumn(GROUP, F.lit("all")))
    found = solve_priors(histogram, max_steps, epsilon, compat).get("all", Prior(None, None, 0, False))
    removed(histogram)
    return found


def day_priors(df: DataFrame, key_sets: Iterable[str | Keys], max_steps: int = 200, epsilon: float = 1e-8, compat: bool = False) -> DataFrame:
    """A row for each key set and day of the log that has history: key_set, day_idx, alpha, beta, pooled, steps and converged."""
    named = F.concat_ws("/", "key_set", F.col(DAY).cast("string"))
    histograms = written(day_histograms(df, key_sets).withColumn(GROUP, named))
    found = solve_priors(histograms, max_steps, epsilon, compat)
    removed(histograms)
    rows = []
    for group, prior in found.items():
        name, day = group.rsplit("/", 1)
        rows.append((name, int(day), prior.alpha, prior.beta, prior.pooled, prior.steps, prior.converged))
    return df.sparkSession.createDataFrame(sorted(rows), f"key_set string, {DAY} int, alpha double, beta double, pooled double, steps long, converged boolean")


def smoothed_cvr_by_day(df: DataFrame, key_sets: Iterable[str | Keys], priors: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """As-of ``<keys>_sum``, and ``<keys>_cvr`` smoothed by the prior of the key set and the row's day.

    Where a day has no finite prior, its pooled rate stands for all keys; a day without history gets nulls. A key without
    history gets the prior's mean.
    """
    df, key_sets = attach_asof(df, key_sets, {SEEN: is_known(), BOUGHT: is_bought()}, {"sum": SEEN, "buy": BOUGHT}, source=source)
    for keys in key_sets:
        name = key_name(keys)
        # one row per day
        own = F.broadcast(priors.where(F.col("key_set") == name).select(DAY, "alpha", "beta", "pooled"))
        rate = smoothed(F.col(f"{name}_buy"), F.col(f"{name}_sum"), F.col("alpha"), F.col("beta"))
        df = df.join(own, DAY, "left").withColumn(f"{name}_cvr", F.coalesce(rate, F.col("pooled"))).drop("alpha", "beta", "pooled")
        df = df.withColumn(f"{name}_sum", F.expr(f"nullif({name}_sum, 0)")).drop(f"{name}_buy")
    return df
