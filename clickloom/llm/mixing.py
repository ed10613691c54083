"""Mixing sources to target weights by weighted fair queueing.

Each source queues its shuffled documents, up to ``repeats`` times over. A document's virtual finish
time is the running total of its source's words over the source's target. All queues are sorted
together by that time and cut where the total budget is reached. A source's part of the mix is
thus the head of its queue, so the whole mix is described by one cut per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.session import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, order: Sequence[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """The sum of ``value`` over all rows up to each one in ``order``, of its ``group`` (a column of longs without nulls) if given.

    Rows are dealt out by ranges of the order, so that one hot group spans many tasks. Inside a range it
    is a window; the sums of the ranges before come from the driver, two numbers for each range at most.
    """
    keys = [group, *order] if group else list(order)
    named = df.withColumn("_group", F.col(group) if group else F.lit(0).cast("long"))
    placed = written(named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part", "_group").agg(F.sum(value).alias("total"))
    ends = placed.groupBy("_part").agg(F.min("_group").alias("low"), F.max("_group").alias("high"))
    # a range shares with its neighbours its first and its last group only
    rows = sums.join(ends, "_part").where("_group = low or _group = high").select("_part", "_group", "total").orderBy("_part", "_group").collect()
    before: dict[int, int] = {}
    offsets = []
    for part, own, total in rows:
        offsets.append((part, own, before.get(own, 0)))
        before[own] = before.get(own, 0) + total
    offsets = df.sparkSession.createDataFrame(offsets, "_part int, _group long, before long")
    upto = Window.partitionBy("_part", "_group").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # two rows per range at most
    whole = placed.join(F.broadcast(offsets), ["_part", "_group"], "left")
    return whole.withColumn(out, F.sum(value).over(upto) + F.coalesce("before", F.lit(0))).drop("_part", "_group", "before")


def _level(sources: DataFrame, budget: float, repeats: int) -> float:
    """Words per unit of weight for sources below their cap. Each step costs one sum over the sources; capped ones only become more."""
    level, capped = 0.0, -1
    while True:
        is_capped = F.lit(capped >= 0) & (F.col("source_size") * repeats <= F.col("weight") * level)
        n, taken, rest = sources.agg(
            F.count_if(is_capped), F.coalesce(F.sum(F.when(is_capped, F.col("source_size") * repeats)), F.lit(0)), F.coalesce(F.sum(F.when(~is_capped, F.col("weight"))), F.lit(0))
        ).first()
        if n == capped or not rest:
            return level if rest else float("inf")
        capped, level = n, (budget - taken) / rest


def _hash(repeat: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), repeat.cast("string")))


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, and its cut, the last (``last_repeat``, ``last_hash``) it takes.

    Sources are ordered by code point, null last; ``weights`` repeat along that order. Together they get
    ``share`` times all words; no source gets more than ``repeats`` times its own, the excess goes to
    the others by weight. A source without words has target 0 and takes nothing. The shuffle is
    a hash of the id, so reruns agree; rows of one id are taken together.
    """
    base = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    base = written(base)
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumns({"none": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    sources = running_sum(sources, ["none", "source"], "one", "place")
    in_turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = written(sources.select("place", "source", "source_size", in_turn.alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    level = _level(sources, budget, repeats)
    cap = (F.col("source_size") * repeats).cast("double")
    sources = sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))

    queued = base.where("size > 0").withColumnRenamed("source", "own_source").join(sources, F.col("own_source").eqNullSafe(F.col("source")))
    queued = queued.select("place", "target", "size", "doc_id", F.explode(F.array(*[F.lit(r) for r in range(repeats)])).alias("turn"))
    queued = queued.select("place", "target", "size", "turn", _hash(F.col("turn")).alias("hash"))
    queued = running_sum(queued, ["turn", "hash"], "size", "upto", group="place")
    queued = queued.withColumn("finish", F.col("upto") / F.col("target"))
    queued = running_sum(queued, ["finish", "place", "turn", "hash"], "size", "whole")
    cuts = queued.where(F.col("whole") <= budget).groupBy("place").agg(F.max(F.struct("turn", "hash")).alias("cut"))
    return written(
        sources.join(cuts, "place", "left").select("source", "source_size", "target", F.col("cut.turn").alias("last_repeat"), F.col("cut.hash").alias("last_hash"))
    )


def times_taken(repeats: int = REPEATS) -> Column:
    """How often the mix takes a row that has ``doc_id`` and its source's cut."""
    taken = [
        F.when((F.col("last_repeat") > r) | ((F.col("last_repeat") == r) & (_hash(F.lit(r)) <= F.col("last_hash"))), 1).otherwise(0) for r in range(repeats)
    ]
    return sum(taken[1:], taken[0])


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """The rows of the mix with all their columns: a row taken twice is there twice, one not taken is gone.

    ``docs`` has ``doc_id``, ``text``, ``source`` and any other columns, whatever their names.
    """
    plan = mix_plan(docs, weights, share, repeats)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), F.col("source").cast("string").alias("own_source"))
    joined = rows.join(plan, F.col("own_source").eqNullSafe(F.col("source")))
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times_taken(repeats)))).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", F.col("source").alias("own_source"), word_count("text").alias("size"))
    joined = rows.join(mix_plan(docs), F.col("own_source").eqNullSafe(F.col("source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times_taken()).cast("long").alias("taken"))


OP1_SQL = r"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
weighed AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sums),
sources AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM weighed),
total AS (SELECT 1.5::DOUBLE * sum(source_size)::DOUBLE AS budget FROM sources),
levels AS (SELECT s.*, 2 * source_size AS cap, (budget - coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level, 2.0 * source_size / weight AS ratio FROM sources s, total
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT min_by(level, (ratio, place)) AS level FROM levels WHERE cap > level * weight),
targets AS (SELECT place, source, source_size, least((2 * source_size)::DOUBLE, weight::DOUBLE * coalesce(chosen.level, 'inf'::DOUBLE)) AS target FROM sources, chosen),
queued AS (SELECT b.doc_id, b.size, t.place, t.target, turn, md5(coalesce(b.doc_id::VARCHAR, '') || ':' || turn) AS hash
  FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS v(turn) WHERE b.size > 0),
finished AS (SELECT *, sum(size) OVER (PARTITION BY place ORDER BY turn, hash ROWS UNBOUNDED PRECEDING)::DOUBLE / target AS finish FROM queued),
upto AS (SELECT *, sum(size) OVER (ORDER BY finish, place, turn, hash ROWS UNBOUNDED PRECEDING) AS whole FROM finished),
cuts AS (SELECT place, max((turn, hash)) AS cut FROM upto, total WHERE whole <= budget GROUP BY place)
SELECT b.doc_id AS doc_id, b.size AS size, t.source_size AS source_size, t.target AS target,
  CAST(b.size * ((c.cut IS NOT NULL AND (0, md5(coalesce(b.doc_id::VARCHAR, '') || ':0')) <= c.cut)::INT
    + (c.cut IS NOT NULL AND (1, md5(coalesce(b.doc_id::VARCHAR, '') || ':1')) <= c.cut)::INT) AS BIGINT) AS taken
FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN cuts c ON c.place = t.place
"""
