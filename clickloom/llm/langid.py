"""Language of whole texts by averaged embeddings of hashed subwords under a linear softmax.

A text's features are its words and the runs of three and four bytes around its letters, lower-cased and hashed to a fixed
number of buckets. The mean of the features' embeddings goes through a linear layer with a softmax; embeddings and layer
are trained together by stochastic gradient descent, on short pieces of labelled texts. Labelled texts that the descent has
not seen, and short stretches of them, calibrate the result: a temperature that falls with the number of features makes
the softmax a probability, and the least probability at which the accepted ones are right often enough is the bound for
rejection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clickloom.llm.toxicity import is_held_out
from clickloom.llm.words import edges_of, hashed_runs, numbered, slices, small_batches, text_bytes
from clickloom.session import written

#: Hash bits of words, and of each length of byte runs; length of an embedding.
BITS, GRAMS, DIM = 15, (3, 4), 16
#: Labelled texts of each language that the model is fitted on at most, pieces of each of them at most, and letters of a piece.
TEXTS, PIECES, PIECE = 400, 48, 200
#: One of so many of these texts is kept from the descent, for the calibration.
CALIBRATE = 4
#: Letters of the stretches that the calibration takes from the middle of a text, besides the whole.
STRETCHES = (4, 8, 16, 32, 64, 128)
#: Share of accepted texts that may be wrong.
WRONG = 0.01

UNKNOWN = "und"
SPACE = (1 + len(GRAMS)) << BITS

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CODE = np.where(_LETTER, numbered(256, 31), np.uint64(0x9E3779B97F4A7C15))
_STEPS = numbered(max(GRAMS), 47) | np.uint64(1)


def lowered(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(text.cast(pa.large_string()).fill_null(""))


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of several texts, and the text of each; all that is no letter counts as one mark."""
    data, at = text_bytes(lowered(text))
    letter = _LETTER[data]
    owner = np.repeat(np.arange(len(text), dtype=np.int32), np.diff(at))
    begins, ends = edges_of(letter, at)
    buckets = [(hashed_runs(data, begins, ends) >> np.uint64(64 - BITS)).astype(np.int32)]
    owners = [owner[begins]]
    code, seen = _CODE[data], np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
    for number, size in enumerate(GRAMS, start=1):
        n = max(0, len(data) - size + 1)
        total = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            total += code[k : k + n] * _STEPS[k]
        # within one text, with at most one byte that is no letter
        whole = (seen[size:] - seen[:n] >= size - 1) & (owner[:n] == owner[size - 1 :])
        gram = (total[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        buckets.append(gram.astype(np.int32) + np.int32(number << BITS))
        owners.append(owner[:n][whole])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """``weights`` holds, for each language, what a feature adds to its logit: embedding times layer. ``sharpness`` is that of :func:`sharpened`."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    sharpness: tuple[float, float] = (0.0, 0.0)
    threshold: float = 0.0

    def logits(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of logits for each text, and its number of features, 1 at least."""
        feature, owner = features(text)
        count = np.maximum(np.bincount(owner, minlength=len(text)), 1)
        return np.stack([np.bincount(owner, weights=w[feature], minlength=len(text)) / count for w in self.weights], axis=1) + self.bias, count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(embedding: np.ndarray, layer: np.ndarray, bias: np.ndarray, feature: np.ndarray, owner: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Descent directions of the mean log loss of some pieces: a row for each feature occurrence's embedding, the layer, the bias; and the means."""
    count = np.maximum(np.bincount(owner, minlength=len(label)), 1)
    mean = np.stack([np.bincount(owner, weights=column[feature], minlength=len(label)) for column in embedding.T], axis=1) / count[:, None]
    pull = -softmax(mean @ layer + bias)
    pull[np.arange(len(label)), label] += 1
    pull /= len(label)
    return (pull @ layer.T / count[:, None])[owner], mean.T @ pull, pull.sum(axis=0), mean


def descend(pieces: pa.Array, label: np.ndarray, languages: int, epochs: int = 8, batch: int = 32, rate: float = 1.0, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias after ``epochs`` passes over the pieces in random order, with a rate that falls to zero.

    Every language counts the same, however many pieces it has. Embeddings take steps that are longer by the number of a piece's
    features, as the mean divides their slopes by it.
    """
    rng = np.random.default_rng(seed)
    feature, owner = features(pieces)
    order = np.argsort(owner, kind="stable")
    feature, first = feature[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(pieces)))])
    embedding = rng.normal(0, 1, (SPACE, DIM))
    layer, bias = np.zeros((DIM, languages)), np.zeros(languages)
    frequency = np.bincount(label, minlength=languages)
    share = 1.0 / np.maximum(frequency[label], 1)
    steps = epochs * -(-len(label) // batch)
    for step in range(steps):
        chosen = rng.choice(len(label), size=min(batch, len(label)), p=share / share.sum())
        length = first[chosen + 1] - first[chosen]
        at = np.repeat(first[chosen] - np.cumsum(length) + length, length) + np.arange(length.sum())
        own = np.repeat(np.arange(len(chosen)), length)
        now = rate * (1 - step / steps)
        g_embedding, g_layer, g_bias, _ = gradients(embedding, layer, bias, feature[at], own, label[chosen])
        np.add.at(embedding.reshape(-1), (feature[at][:, None].astype(np.int64) * DIM + np.arange(DIM)).reshape(-1), (now * max(1, len(at) // len(chosen)) * g_embedding).reshape(-1))
        layer += now * g_layer
        bias += now * g_bias
    return (embedding @ layer).T.astype(np.float32), bias


def sharpened(logits: np.ndarray, count: np.ndarray, sharpness: tuple[float, float]) -> np.ndarray:
    """Probabilities: the logits are divided by a temperature whose logarithm falls in line with that of the number of features."""
    return softmax(logits * np.exp(sharpness[0] + sharpness[1] * np.log(count))[:, None])


def calibrated(logits: np.ndarray, count: np.ndarray, label: np.ndarray, wrong: float = WRONG) -> tuple[tuple[float, float], float]:
    """The sharpness with the least log loss, and the least probability whose accepted texts are wrong in at most ``wrong`` of all cases.

    Without texts the temperature is 1 and nothing is rejected; if no bound will do, everything is (the bound is then above 1).
    """
    if not len(label):
        return (0.0, 0.0), 0.0
    here = np.arange(len(label))
    tried = [(float(a), float(b)) for a in np.linspace(-4, 4, 65) for b in np.linspace(0, 1, 11)]
    loss = [-np.mean(np.log(np.maximum(sharpened(logits, count, t)[here, label], 1e-9))) for t in tried]
    sharpness = tried[int(np.argmin(loss))]
    p = sharpened(logits, count, sharpness)
    score, right = p.max(axis=1), p.argmax(axis=1) == label
    order = np.argsort(-score, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(label) + 1)
    # texts of equal score are accepted together
    ends = np.append(score[order][1:] != score[order][:-1], True)
    good = np.flatnonzero((errors <= wrong) & ends)
    if not len(good):
        return sharpness, 1.1
    return sharpness, 0.0 if good[-1] == len(label) - 1 else float(score[order][good[-1]])


def _pieces(text: pa.Array) -> pa.Array:
    """Stretches of ``PIECE`` letters of each text; of a longer text ``PIECES`` of them, evenly spread over the whole."""
    out = []
    for whole in text.to_pylist():
        starts = list(range(0, len(whole or ""), PIECE))
        if len(starts) > PIECES:
            starts = [starts[i * len(starts) // PIECES] for i in range(PIECES)]
        out.append([whole[s : s + PIECE] for s in starts])
    return pa.array(out, pa.list_(pa.string()))


def _whole_and_stretches(text: pa.Array) -> pa.Array:
    return pa.array([[t, *(t[(len(t) - n) // 2 : (len(t) + n) // 2] for n in STRETCHES if n < len(t))] for t in text.to_pylist()], pa.list_(pa.string()))


def sample(docs: DataFrame, texts: int = TEXTS, text: str = "text", lang: str = "lang") -> DataFrame:
    """At most ``texts`` different texts of each language: ``lang``, ``text`` and ``part``, a number of the text below ``texts``.

    The text's hash deals it to a part; of each part the text with the least hash stays. Copies of a text count once.
    """
    number = F.xxhash64(text, F.lit(23))
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    known = known.withColumn("number", number).withColumn("part", F.pmod("number", F.lit(texts)).cast("int"))
    # one number for each part of each language
    least = written(known.groupBy("lang", "part").agg(F.min("number").alias("number")))
    return written(known.join(F.broadcast(least), ["lang", "part", "number"]).groupBy("lang", "part").agg(F.min("text").alias("text")))


def train(spark: SparkSession, docs: DataFrame, texts: int = TEXTS) -> Model | None:
    """Fit on a bounded sample of ``docs`` (columns ``doc_id``, ``text``, ``lang``) whose id is not held out.

    A language is any value of ``lang`` with a letter in one of its texts. Without one there is no model.
    """
    known = docs.where(~is_held_out()).where(_has_letter("text"))
    rows = sample(known, texts)
    fit = rows.where(F.col("part") % CALIBRATE != 0).select("lang", "part", arrow_udf(_pieces, "array<string>")("text").alias("pieces"))
    pieces = fit.select("lang", "part", F.posexplode("pieces").alias("at", "piece")).where(_has_letter("piece")).orderBy("lang", "part", "at").toArrow()
    languages = sorted(row["lang"] for row in rows.select("lang").distinct().collect())
    if not languages:
        return None
    number = {name: i for i, name in enumerate(languages)}
    label = np.array([number[name] for name in pieces.column("lang").to_pylist()], dtype=np.int64)
    if len(label):
        weights, bias = descend(pieces.column("piece").combine_chunks(), label, len(languages))
    else:
        weights, bias = np.zeros((len(languages), SPACE), np.float32), np.zeros(len(languages))
    model = Model(languages, weights, bias)
    parts = rows.where(F.col("part") % CALIBRATE == 0).select("lang", "part", arrow_udf(_whole_and_stretches, "array<string>")("text").alias("texts"))
    parts = parts.select("lang", "part", F.posexplode("texts").alias("at", "text")).where(_has_letter("text"))
    logits = arrow_udf(_by_slices(spark.sparkContext.broadcast(model), _logits), "struct<logits:array<double>,features:long>").asNondeterministic()
    found = parts.select("lang", "part", "at", logits("text").alias("own")).orderBy("lang", "part", "at").select("lang", "own.*").collect()
    z = np.array([row["logits"] for row in found]).reshape(len(found), len(languages))
    model.sharpness, model.threshold = calibrated(z, np.array([row["features"] for row in found]), np.array([number[row["lang"]] for row in found], dtype=np.int64))
    return model


def _has_letter(text: str) -> Column:
    return F.col(text).cast("string").rlike(r"\p{L}")


def _logits(text: pa.Array, model: Model) -> pa.Array:
    z, count = model.logits(text)
    lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32), pa.array(z.reshape(-1)))
    return pa.StructArray.from_arrays([lists, pa.array(count)], names=["logits", "features"])


def _predicted(text: pa.Array, model: Model) -> pa.Array:
    p = sharpened(*model.logits(text), model.sharpness)
    best, score = p.argmax(axis=1), p.max(axis=1)
    # null counts as a text without a letter
    known = pc.match_substring_regex(text, r"\p{L}").fill_null(False)
    lang = pc.if_else(known, pa.array(model.languages, pa.string()).take(pa.array(best)), UNKNOWN)
    score = pc.if_else(known, pa.array(score), 0.0)
    accepted = pc.and_(known, pc.greater_equal(score, model.threshold))
    return pa.StructArray.from_arrays([lang, score, accepted], names=["lang", "score", "accepted"])


def _by_slices(model, work: Callable[[pa.Array, Model], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    def run(text: pa.Array) -> pa.Array:
        parts = [work(part.column("text"), model.value) for part in slices(pa.record_batch([text], names=["text"]), "text")]
        return pa.concat_arrays(parts) if parts else work(text, model.value)

    return run


def language(spark: SparkSession, model: Model | None, text: str = "text") -> Column:
    """A struct of ``lang``, its ``score`` (probability, 0 to 1) and ``accepted``, whether the score is above the bound for rejection.

    The whole text is read. A null text, or one without a letter, is ``und`` with score 0, not accepted; so is every text without a model.
    """
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    column = arrow_udf(_by_slices(spark.sparkContext.broadcast(model), _predicted), "struct<lang:string,score:double,accepted:boolean>")
    return column.asNondeterministic()(F.col(text).cast("string"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``, one row per row; ``accepted`` is an extra column.

    Repeated rows get equal results. A null id counts as held out. An empty table gives an empty result.
    """
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = docs.select("doc_id", is_held_out().alias("held_out"), language(spark, train(spark, docs)).alias("own"))
    return found.select("doc_id", "held_out", F.col("own.lang").alias("lang_pred"), "own.score", "own.accepted")
