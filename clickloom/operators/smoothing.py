"""Smoothed conversion rates: fixed priors, priors by day, and priors fitted to the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rates import is_bought, is_known, smoothed
from clickloom.operators.history import BOUGHT, DAY, SEEN, attach_asof, history_cvr, key_name
from clickloom.operators.keyed import Keys, as_keys
from clickloom.operators.priors import fit_beta_prior

# The prior used for every key of the split form.
ALPHA, BETA = 0.547384009831, 45.8073433366

# The priors (alpha, beta) by day of month.
DAY_PRIORS = {
    19: (1.95940572653, 100.451129071),
    20: (1.77857883324, 93.2650068046),
    21: (1.72837335685, 93.4783071989),
    22: (1.74860144691, 94.809709777),
    23: (1.69324834815, 92.2935348426),
    24: (1.69798377038, 93.7414148792),
    25: (1.71664839346, 96.0191282133),
}


def smoothed_cvr(his: DataFrame, now: DataFrame, key_sets: Iterable[str | Keys], alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """``_sum``, ``_buy`` and a smoothed ``_cvr``; an unseen key gets the prior mean."""
    key_sets = [as_keys(k) for k in key_sets]
    now = history_cvr(his, now, key_sets)
    rates = {}
    for keys in key_sets:
        name = key_name(keys)
        rates[f"{name}_cvr"] = smoothed(F.col(f"{name}_buy"), F.col(f"{name}_sum"), alpha, beta)
    return now.withColumns(rates)


def prior_table(df: DataFrame, priors: Mapping[int, tuple[float, float]], column: str = DAY) -> DataFrame:
    """One row per day: the day and its alpha and beta. A handful of parameters, not data."""
    rows = [(int(day), float(a), float(b)) for day, (a, b) in priors.items()]
    return df.sparkSession.createDataFrame(rows, f"{column} int, alpha double, beta double")


def smoothed_cvr_asof(df: DataFrame, key_sets: Iterable[str | Keys], priors: Mapping[int, tuple[float, float]], first_day: int = 0) -> DataFrame:
    """As-of rates smoothed by the prior of the row's day, ``_sum`` as a mean per earlier day.

    The divisor is the number of calendar days since ``first_day``. Days without a prior keep null.
    """
    df, key_sets = attach_asof(df, key_sets, {SEEN: is_known(), BOUGHT: is_bought()}, {"sum": SEEN, "buy": BOUGHT})
    # one row per day that has a prior
    df = df.join(F.broadcast(prior_table(df, priors)), DAY, "left")
    columns = {}
    elapsed = F.col(DAY) - first_day
    for keys in key_sets:
        name = key_name(keys)
        seen, bought = F.col(f"{name}_sum"), F.col(f"{name}_buy")
        has_prior = F.col("alpha").isNotNull()
        columns[f"{name}_cvr"] = F.when(has_prior, smoothed(bought, seen, F.col("alpha"), F.col("beta")))
        columns[f"{name}_sum"] = F.when(has_prior & (seen > 0) & (elapsed > 0), seen / elapsed)
    return df.withColumns(columns).drop("alpha", "beta", *[f"{key_name(k)}_buy" for k in key_sets])


def smoothed_cvr_fitted(his: DataFrame, now: DataFrame, key: str | Keys, max_steps: int = 200, compat: bool = False) -> DataFrame:
    """``I``, ``C`` and ``<key>_buy_smooth`` with a prior fitted to the history; keys without spread all get the pooled rate."""
    prior = fit_beta_prior(his, key, max_steps=max_steps, compat=compat)
    name = key_name(key)
    now = history_cvr(his, now, [key])
    if prior.alpha is None:
        rate = F.lit(prior.pooled).cast("double")
    else:
        rate = smoothed(F.col(f"{name}_buy"), F.col(f"{name}_sum"), prior.alpha, prior.beta)
    return now.withColumn(f"{name}_buy_smooth", rate).withColumnsRenamed({f"{name}_sum": "I", f"{name}_buy": "C"}).drop(f"{name}_cvr")
