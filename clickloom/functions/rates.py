"""Labels and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = "is_trade"


def labelled(label: str = LABEL) -> Column:
    """True on rows with a known outcome; test rows carry -1 or -2."""
    return F.col(label).isin(0, 1)


def is_known(label: str = LABEL) -> Column:
    """1 on rows with a known outcome, 0 on the others."""
    return F.when(labelled(label), F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def is_bought(label: str = LABEL) -> Column:
    return F.when(F.col(label) == 1, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def known_rows(label: str = LABEL) -> Column:
    return F.count(F.when(labelled(label), F.lit(1)))


def buys(label: str = LABEL) -> Column:
    return F.coalesce(F.sum(is_bought(label)), F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where nothing was counted."""
    return F.when(bottom > 0, top / bottom)


def smoothed(bought: Column, seen: Column, alpha: Column | float, beta: Column | float) -> Column:
    alpha = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    beta = F.lit(beta) if not isinstance(beta, Column) else beta
    bought, seen = F.coalesce(bought, F.lit(0)), F.coalesce(seen, F.lit(0))
    # without any history this is the prior mean itself
    return (bought + alpha) / (seen + alpha + beta)
