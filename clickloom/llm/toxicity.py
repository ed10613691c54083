"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic if one of its sentences is: P = 1 - prod(1 - p), the noisy-or of its sentences' scores.
Each p is a logistic model over the sentence's words and the runs of five bytes inside them, hashed to a fixed
number of weights. The likelihood of the documents' labels trains the weights, so no sentence needs a label.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clickloom.llm.words import _BYTE, edges_of, hashed_runs, numbered, slices, text_bytes
from clickloom.session import written

BITS = 18
GRAM = 5
#: Labelled texts of each class, and features of all of them together, that the model is fitted on.
SAMPLE = 2_000
FEATURES = 12_000_000
#: Standard deviations by which a feature must be over- or under-represented to get a weight.
CLEAR = 4.0

_WORDS = np.zeros(256, dtype=bool)
_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True
_STEPS = numbered(GRAM, 5) | np.uint64(1)

SCORED = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"


@dataclass
class Sentences:
    """Features and sentences of several texts. ``owner`` is the text of each sentence, ``start`` and ``end`` its code points."""

    feature: np.ndarray
    sentence: np.ndarray
    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences_of(column: pa.Array) -> Sentences:
    """Split at full stops, marks and line ends; a piece without a letter or digit is no sentence."""
    data, at = text_bytes(column)
    letter = _WORDS[data]
    begins, ends = edges_of(~_ENDS[data], at)
    inside = np.concatenate([[0], np.cumsum(letter)])
    full = inside[ends] > inside[begins]
    begins, ends = begins[full], ends[full]
    number = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(number, begins, 1)
    number = np.cumsum(number, dtype=np.int32)[:-1] - 1
    opened, closed = edges_of(letter, at)
    word = (hashed_runs(data, opened, closed) >> np.uint64(64 - BITS)).astype(np.int32)
    n = max(0, len(data) - GRAM + 1)
    total = np.zeros(n, dtype=np.uint64)
    codes = _BYTE[data]
    for k in range(GRAM):
        total += codes[k : k + n] * _STEPS[k]
    # five letters on end, in one sentence: sentences and texts end outside words or at a text's last byte
    whole = (inside[GRAM:] - inside[:n] == GRAM) & (number[:n] == number[GRAM - 1 :][:n])
    gram = ((total[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32) + (1 << BITS)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    owner = np.searchsorted(at, begins, side="right") - 1
    base = points[at[owner]]
    return Sentences(
        np.concatenate([word, gram]), np.concatenate([number[opened], number[:n][whole]]), owner, points[begins] - base, points[ends] - base
    )


@dataclass
class Model:
    """``weights`` of words, then of byte runs; ``bias`` of every sentence. Without weights nothing is toxic."""

    weights: np.ndarray | None
    bias: float = 0.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_bags(feature: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 100, rate: float = 0.2, decay: float = 1e-5) -> Model:
    """Maximise the weighted likelihood of the bags' labels by adaptive gradient steps.

    Only features whose frequency in toxic bags is ``CLEAR`` deviations off get a weight; it starts from
    the log-odds, between 0 and 1. The bias starts so low that a sentence without any of them is clean.
    """
    size = 2 << BITS
    seen = np.unique(owner[sentence].astype(np.int64) * size + feature)
    bags, seen = seen // size, seen % size
    toxic, every = np.bincount(seen, weights=label[bags], minlength=size), np.bincount(seen, minlength=size)
    share = label.mean()
    off = np.abs(toxic - every * share) / np.sqrt(np.maximum(every, 1) * share * (1 - share))
    clear = (off >= CLEAR) & (every >= 5)
    odds = np.log((toxic + 2) / (label.sum() + 4)) - np.log((every - toxic + 2) / ((1 - label).sum() + 4))
    w = np.where(clear, np.clip(odds, 0.0, 1.0), 0.0)
    feature, sentence = feature[clear[feature]], sentence[clear[feature]]
    b, squares, square_b = -6.0, np.full(size, 1e-6), 1e-6
    for _ in range(steps):
        z = b + np.bincount(sentence, weights=w[feature], minlength=len(owner))
        total = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(label))
        pull = np.where(label == 1, 1.0 / np.maximum(np.expm1(np.minimum(total, 60.0)), 1e-12), -1.0) * weight
        g = pull[owner] * _sigmoid(z)
        gw = np.bincount(feature, weights=g[sentence], minlength=size) - decay * len(label) * w
        squares += gw * gw
        square_b += g.sum() ** 2
        w += rate * gw / np.sqrt(squares)
        b += rate * g.sum() / np.sqrt(square_b)
    return Model(np.where(clear, w, 0.0).astype(np.float32), float(b))


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's digits, modulo 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample_features(text: pa.Array) -> pa.Array:
    rows = []
    for i in range(len(text)):
        own = sentences_of(text.slice(i, 1))
        rows.append({"feature": own.feature, "sentence": own.sentence, "sentences": len(own.owner)})
    return pa.array(rows, pa.struct([("feature", pa.list_(pa.int32())), ("sentence", pa.list_(pa.int32())), ("sentences", pa.int64())]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most ``sample`` labelled texts of each class, and no more of them than have ``features`` features.

    Held-out ids, null ids and labels other than 0 and 1 are not used; an id labelled both ways is toxic.
    Texts are picked by a hash of the id. Clean texts weigh as much more as they are more frequent.
    Without texts of both classes the model calls nothing toxic.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~is_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = [F.xxhash64("doc_id", F.lit(17)), "doc_id"]
    frequent = {row["toxic"]: row["count"] for row in known.groupBy("toxic").count().collect()}
    picked = known.where("toxic = 1").orderBy(*by_hash).limit(sample).unionByName(known.where("toxic = 0").orderBy(*by_hash).limit(sample))
    # at most two times `sample` ids
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    extract = arrow_udf(_sample_features, "struct<feature:array<int>,sentence:array<int>,sentences:long>").asNondeterministic()
    rows = written(texts.select("doc_id", "toxic", extract("text").alias("own")).select("doc_id", "toxic", "own.*"))
    sizes = rows.select("doc_id", "toxic", F.size("feature").alias("n")).where("n > 0").toPandas().sort_values(["doc_id", "n"])
    within = sizes[sizes["n"].cumsum() <= features] if sizes["n"].sum() > features else sizes
    chosen = docs.sparkSession.createDataFrame(within[["doc_id"]].drop_duplicates().astype("int64"), "doc_id long") if len(within) else None
    if chosen is None:
        return Model(None)
    bags = rows.where("size(feature) > 0").join(F.broadcast(chosen), "doc_id").orderBy("doc_id", F.hash("feature")).toArrow()
    label = bags["toxic"].to_numpy().astype(float)
    if not 0 < label.sum() < len(label):
        return Model(None)
    sentences = bags["sentences"].to_numpy()
    owner = np.repeat(np.arange(len(label)), sentences)
    lengths = pa.compute.list_value_length(bags["feature"]).to_numpy()
    sentence = pa.compute.list_flatten(bags["sentence"]).to_numpy() + np.repeat(np.cumsum(sentences) - sentences, lengths)
    clean_weight = max(1.0, frequent[0] / (len(label) - label.sum()) / (frequent[1] / label.sum()))
    return fit_bags(pa.compute.list_flatten(bags["feature"]).to_numpy(), sentence, owner, label, np.where(label == 1, 1.0, clean_weight))


def _scorer(model) -> Callable[[pa.Array], pa.Array]:
    def run(text: pa.Array) -> pa.Array:
        batch = pa.record_batch([text], names=["text"])
        parts = [_scored(part.column("text"), model.value) for part in slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else _scored(text, model.value)

    return run


def _scored(text: pa.Array, model: Model) -> pa.Array:
    own = sentences_of(text)
    n = len(own.owner)
    if model.weights is None:
        soft = np.zeros(n)
    else:
        soft = np.logaddexp(0, model.bias + np.bincount(own.sentence, weights=model.weights[own.feature], minlength=n))
    score = -np.expm1(-np.bincount(own.owner, weights=soft, minlength=len(text)))
    each = -np.expm1(-soft)
    bad = np.flatnonzero(each >= 0.5)
    ends = np.searchsorted(own.owner[bad], np.arange(len(text) + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays([pa.array(own.start[bad].astype(np.int32)), pa.array(own.end[bad].astype(np.int32)), pa.array(each[bad])], names=["start", "end", "score"])
    return pa.StructArray.from_arrays([pa.array(score), pa.ListArray.from_arrays(ends, spans)], names=["score", "sentences"])


def toxicity(spark: SparkSession, model: Model, text: str = "text") -> Column:
    """A struct of ``score`` (0 to 1) and the offending ``sentences`` (code points, end exclusive) of the whole text.

    A null or empty text, or one without letters and digits, has score 0 and no sentences.
    """
    return arrow_udf(_scorer(spark.sparkContext.broadcast(model)), SCORED).asNondeterministic()(F.col(text).cast("string"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", is_held_out().alias("held_out"), toxicity(spark, model).alias("tox"))
    return scored.select(
        "doc_id", "held_out", F.col("tox.score").alias("score"), (F.col("tox.score") >= 0.5).cast("int").alias("predicted"), F.col("tox.sentences").alias("sentences")
    )
