"""Boosted trees on feature tables: fit, score, early stop, refit, cross-validate, select."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.rates import LABEL
from clickloom.operators import binned, metrics, prepare
from clickloom.operators.boosting import MARGIN, BoostedTrees, Booster, boost
from clickloom.operators.boosting import probability as of_margin
from clickloom.session import removed, written

FEATURES = "features"


def assembled(df: DataFrame, columns: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """Feature vector of ``columns``: numbers as doubles, nulls as -1, and vectors as they are."""
    kinds = dict(df.dtypes)
    kept = [c for c in dict.fromkeys([metrics.ID, LABEL, *keep]) if c in df.columns]
    doubles = [(F.col(c) if kinds[c] == "vector" else F.coalesce(F.col(c).cast("double"), F.lit(-1.0))).alias(f"f_{c}") for c in columns]
    vectors = VectorAssembler(inputCols=[f"f_{c}" for c in columns], outputCol=FEATURES)
    return vectors.transform(df.select(*kept, *doubles)).select(*kept, FEATURES)


def _classifier(booster: Booster) -> GBTClassifier:
    share = str(booster.column_share) if booster.column_share < 1 else "all"
    return GBTClassifier(
        featuresCol=FEATURES,
        labelCol=LABEL,
        maxIter=booster.rounds,
        maxDepth=booster.depth,
        stepSize=booster.rate,
        subsamplingRate=booster.row_share,
        featureSubsetStrategy=share,
        minInstancesPerNode=booster.min_rows,
        seed=booster.seed,
    )


def fit(train: DataFrame, columns: Sequence[str], booster: Booster) -> GBTClassificationModel:
    return _classifier(booster).fit(assembled(train, columns))


def fit_early_stop(train: DataFrame, held_out: DataFrame, columns: Sequence[str], booster: Booster, patience: int = 30, folder: str | None = None) -> BoostedTrees:
    """A model with as many trees as serve the held-out rows best, out of at most ``booster.rounds``.

    Boosting stops ``patience`` rounds after the best one, and its first trees are the model: nothing is fitted twice.
    With a ``folder`` the run resumes from its last chunk there.
    """
    return boost(assembled(train, columns), booster, assembled(held_out, columns), patience, folder=folder)


def fit_refit(train: DataFrame, held_out: DataFrame, everything: DataFrame, columns: Sequence[str], booster: Booster, patience: int = 30) -> tuple[BoostedTrees, int]:
    """Find the number of rounds on a held-out part, then fit all labelled rows with that many."""
    rounds = len(fit_early_stop(train, held_out, columns, booster, patience).trees)
    return boost(assembled(everything, columns), replace(booster, rounds=rounds)), rounds


def score(model: GBTClassificationModel | BoostedTrees, df: DataFrame, columns: Sequence[str], keep: Iterable[str] = ()) -> DataFrame:
    """``instance_id``, ``predicted_score`` (probability of a purchase) and the predicted class."""
    kept = [c for c in dict.fromkeys([metrics.ID, LABEL, *keep]) if c in df.columns]
    vectors = assembled(df, columns, keep)
    if isinstance(model, BoostedTrees):
        bought = of_margin(F.col(MARGIN))
        return model.margins(vectors).select(*kept, bought.alias(metrics.SCORE), (bought > 0.5).cast("int").alias("prediction"))
    scored = model.transform(vectors)
    probability = F.get(vector_to_array("probability"), F.lit(1))
    return scored.select(*kept, probability.alias(metrics.SCORE), F.col("prediction").cast("int").alias("prediction"))


def importance(model: GBTClassificationModel | BoostedTrees, columns: Sequence[str], spark, top: int | None = None) -> DataFrame:
    """Feature importances, largest first: one row per model column."""
    shares = model.importances() if isinstance(model, BoostedTrees) else model.featureImportances.toArray().tolist()
    pairs = sorted(zip(columns, shares), key=lambda pair: (-pair[1], pair[0]))
    return spark.createDataFrame(pairs[:top], "feature string, importance double").orderBy(F.desc("importance"), "feature")


def side_by_side(df: DataFrame, task: Callable, of: Iterable, at_once: int) -> list:
    """``task`` of each item, in order, ``at_once`` of them at a time as jobs of their own: short jobs leave cores idle."""
    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(inheritable_thread_target(df.sparkSession)(task), of))


def cross_validate(df: DataFrame, columns: Sequence[str], booster: Booster, folds: int = 5, at_once: int = 4) -> list[float]:
    """Log loss of each fold; a row's fold is a fixed function of its id. ``at_once`` folds are fitted side by side."""
    known, number = df.where(F.col(LABEL) >= 0), F.pmod(F.xxhash64(metrics.ID), F.lit(folds)).alias("fold")
    learner = _classifier(booster)
    if binned.serves(learner, df, columns):
        rows = written(binned.values(known, columns, [LABEL, number]).withColumn(binned.WEIGHT, F.lit(1)))

        def fold_loss(fold: int) -> float:
            train = rows.where(F.col("fold") != fold)
            bins = binned.Bins.of(train, columns)
            fitted = binned.fit(bins.placed(train, [LABEL, binned.WEIGHT]), columns, learner)
            return binned.loss(fitted, bins.placed(rows.where(F.col("fold") == fold), [LABEL, binned.WEIGHT]), columns)

        return side_by_side(rows, fold_loss, range(folds), at_once)
    vectors = written(assembled(known, columns).withColumn("fold", number))

    def loss(fold: int) -> float:
        model = learner.fit(vectors.where(F.col("fold") != fold))
        scored = model.transform(vectors.where(F.col("fold") == fold))
        scored = scored.select(LABEL, F.get(vector_to_array("probability"), F.lit(1)).alias(metrics.SCORE))
        return metrics.log_loss(scored).first()["log_loss"]

    return side_by_side(vectors, loss, range(folds), at_once)


@dataclass
class Trials:
    """Fits on subsets of columns, over vectors of all columns that are assembled and written once.

    ``at_once`` trials run side by side, each as jobs of its own; a trial's columns are sliced from the vectors.
    The loss of columns that were tried before is looked up. Where the learner lets rows be counted together, the tables
    hold bins instead of vectors, and a trial fits the combinations of its columns' bins.
    """

    train: DataFrame
    test: DataFrame
    columns: Sequence[str]
    booster: Booster
    at_once: int = 4
    known: dict[tuple[str, ...], float] = field(default_factory=dict)
    in_bins: bool = False

    @classmethod
    def over(cls, train: DataFrame, test: DataFrame, columns: Sequence[str], booster: Booster, at_once: int = 4) -> Trials:
        known = F.col(LABEL).isin(0, 1)
        if binned.serves(_classifier(booster), train, columns):
            rows, others = (binned.values(df.where(known), columns, [LABEL]).withColumn(binned.WEIGHT, F.lit(1)) for df in (train, test))
            rows = written(rows)
            bins = binned.Bins.of(rows, columns)
            placed = [binned.counted(bins.placed(df, [LABEL, binned.WEIGHT]), columns) for df in (rows, others)]
            removed(rows)
            return cls(*placed, list(columns), booster, at_once, in_bins=True)
        return cls(written(assembled(train.where(known), columns)), written(assembled(test.where(known), columns)), list(columns), booster, at_once)

    def loss(self, chosen: Sequence[str]) -> float:
        """Log loss on the test rows of a model of the chosen columns."""
        if self.in_bins:
            return binned.loss(binned.fit(self.train, chosen, _classifier(self.booster)), self.test, chosen)
        slicer = VectorSlicer(inputCol="every", outputCol=FEATURES, indices=[self.columns.index(c) for c in chosen])
        sliced = [slicer.transform(df.withColumnRenamed(FEATURES, "every")).drop("every") for df in (self.train, self.test)]
        scored = _classifier(self.booster).fit(sliced[0]).transform(sliced[1])
        bought = F.get(vector_to_array("probability"), F.lit(1))
        return metrics.log_loss(scored.select(LABEL, bought.alias(metrics.SCORE))).first()["log_loss"]

    def losses(self, sets: Sequence[Sequence[str]]) -> list[float]:
        tried = [tuple(chosen) for chosen in sets]
        new = [chosen for chosen in dict.fromkeys(tried) if chosen not in self.known]
        self.known.update(zip(new, side_by_side(self.train, self.loss, new, self.at_once)))
        return [self.known[chosen] for chosen in tried]

    def done(self) -> None:
        removed(self.train)
        removed(self.test)


def greedy_select(train: DataFrame, test: DataFrame, columns: Sequence[str], booster: Booster, passes: int = 10, min_gain: float = 0.00003, seed: int = 2018, at_once: int = 4) -> list[str]:
    """Random forward selection: a feature stays if it lowers the test log loss by more than ``min_gain``.

    Each pass starts over with an empty set, on the features no earlier pass accepted. Returns the
    accepted features in the order they were accepted. The next few features are tried side by side with what is chosen so
    far; after the first that is accepted the others are tried anew, so the result is that of one trial after another.
    """
    order = random.Random(seed)
    trials = Trials.over(train, test, columns, booster, at_once)
    accepted: list[str] = []
    for _ in range(passes):
        pool = [c for c in columns if c not in accepted]
        order.shuffle(pool)
        chosen: list[str] = []
        best, at = 1.0, 0
        while at < len(pool):
            tried = pool[at : at + at_once]
            found = trials.losses([[*chosen, column] for column in tried])
            for column, loss in zip(tried, found):
                at += 1
                if best - loss > min_gain:
                    chosen, best = [*chosen, column], loss
                    break
        if not chosen:
            break
        accepted.extend(chosen)
    trials.done()
    return accepted


def binned_score_files(train: DataFrame, test: DataFrame, columns: Sequence[str], boosters: Sequence[Booster], at_once: int = 2) -> list[DataFrame]:
    """:func:`score_files` of models that are fitted to rows counted by their bins."""
    rows = written(binned.values(train, columns, [LABEL]).withColumn(binned.WEIGHT, F.lit(1)))
    bins = binned.Bins.of(rows, columns)
    counted = binned.counted(bins.placed(rows, [LABEL, binned.WEIGHT]), columns)
    removed(rows)
    models = side_by_side(train, lambda booster: binned.fit(counted, columns, _classifier(booster)), boosters, at_once)
    removed(counted)
    kept = [c for c in dict.fromkeys([metrics.ID, LABEL]) if c in test.columns]
    placed = bins.placed(binned.values(test, columns, kept), kept)
    return [binned.scored(model, placed, columns).select(*kept, metrics.SCORE, F.col("prediction").cast("int").alias("prediction")) for model in models]


def score_files(train: DataFrame, test: DataFrame, columns: Sequence[str], boosters: Sequence[Booster], at_once: int = 2) -> list[DataFrame]:
    """One model per parameter set, fitted on ``train`` side by side, and its scores of ``test``."""
    if all(binned.serves(_classifier(booster), train, columns) for booster in boosters):
        return binned_score_files(train, test, columns, boosters, at_once)
    models = side_by_side(train, lambda booster: fit(train, columns, booster), boosters, at_once)
    return [score(model, test, columns) for model in models]


def run_experiment(train: DataFrame, test: DataFrame, columns: Sequence[str], boosters: Sequence[Booster], weights: Sequence[float] | None = None) -> DataFrame:
    """Fit one model per parameter set, score the test rows with each and blend the scores."""
    return metrics.blend_scores(score_files(train, test, columns, boosters), weights)


def day_experiment(df: DataFrame, start: int, end: int, columns: Sequence[str], boosters: tuple[Booster, Booster]) -> DataFrame:
    """Two models of days ``[start, end)`` on the labelled rows of day ``end``: id, label and both scores (``one``, ``two``), written."""
    train, test = prepare.day_split(prepare.label_split(df)[0], start, end)
    files = [metrics.unique_scores(file).withColumnRenamed(metrics.SCORE, name) for file, name in zip(score_files(train, test, columns, boosters), ("one", "two"))]
    return written(test.select(metrics.ID, LABEL).join(files[0], metrics.ID).join(files[1], metrics.ID))


def experiment_losses(scored: DataFrame, weights: Sequence[float] = tuple(i / 10 for i in range(1, 10))) -> DataFrame:
    """Log loss of each weight of the first score, from both alone (1 and 0) to all of ``weights``, in one pass."""
    return metrics.blend_sweep(scored, "one", "two", weights=[1.0, *weights, 0.0])
