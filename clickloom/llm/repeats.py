"""Passages that repeat across documents, by a sparse suffix array.

Of all suffixes (the words from one position on) those at minimiser positions are kept: the position of the smallest
hash of 19 words among any 32 in a row. Any 50 words hold at least one, and equal passages hold the same ones.

1. Suffixes are grouped by their first 19 words; what stays in one document is dropped. The others
   get their surroundings: a hash of the 50 words that begin 0, 1 .. 31 words further left.
2. Equal suffixes with equal surroundings become one entry. Entries are sorted, and for every step to the left,
   sorted neighbours with equal 50 words from different documents match there. The
   steps that match say how far a passage reaches to the left and right of the suffix.
3. The reaches of all suffixes of a document are merged to its passages.

A prefix with very many different surroundings is not compared in one task: its entries are spread out, one row
per step, and pre-aggregated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.words import Words, _power, mixed, slices, words_of
from clickloom.session import written

WORDS = 50
PREFIX = 19
STEPS = WORDS - PREFIX + 1
#: Bits of the filter of repeated prefixes; full, it lets more suffixes through than needed.
FILTER_BITS = 1 << 25
#: Entries of one prefix compared in one task.
ENTRIES = 20_000

_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(hashes * _power(len(hashes), "up", _BASE)))
    return mixed((sums[size:] - sums[:-size]) * _power(len(hashes), "down", _UNBASE)[:n])


def _sliding(x: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The best of each ``size`` values in a row; ``size`` is a power of two."""
    step = 1
    while step < size:
        x = best(x[:-step], x[step:])
        step *= 2
    return x


def minimisers(words: Words, prefix: int = PREFIX, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions among all words, hash of the prefix there, and hashes of the windows that begin at each word (0: none in its text)."""
    h = rolled(words.hashes, prefix)
    size = prefix + steps - 1
    windows = np.zeros(len(words.hashes), dtype=np.uint64)
    if len(words.hashes) < size:
        return np.zeros(0, np.int64), h[:0], windows
    ends = np.repeat(words.first[1:], words.counts)
    inside = np.arange(len(words.hashes)) + size <= ends
    whole = np.flatnonzero(inside)
    windows[whole] = rolled(words.hashes, size)[whole] | np.uint64(1)
    least = np.where(inside[: len(h) - steps + 1], _sliding(h, steps, np.minimum), np.uint64(0))
    around = np.concatenate([np.zeros(steps - 1, np.uint64), least, np.zeros(steps - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(around, steps, np.maximum)[: len(h)] == h) & (h > 0))
    return chosen, h[chosen], windows


def _of_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        known = batch.filter(batch.column("doc_id").is_valid())
        for part in slices(known, "text"):
            words = words_of(part.column("text"))
            at, keys, windows = minimisers(words)
            owner = np.searchsorted(words.first, at, side="right") - 1
            yield part.column("doc_id").to_numpy()[owner], at, at - words.first[owner], keys, windows


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for docs, _, _, keys, _ in _of_slices(batches):
        yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(docs)], names=["key", "doc_id"])


def _cell(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(7)).astype(np.int64) % FILTER_BITS


def _suffixes(bitmap) -> Callable:
    """The suffixes that the filter lets through, with the hashes of the windows 0 .. 31 words further left (0: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, at, place, keys, windows in _of_slices(batches):
            cell = _cell(keys)
            keep = np.flatnonzero((bitmap.value[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1)
            docs, at, place, keys = docs[keep], at[keep], place[keep], keys[keep]
            for low in range(0, len(at), 50_000):
                some = slice(low, low + 50_000)
                start = at[some, None] - np.arange(STEPS)[None, :]
                around = np.where(np.arange(STEPS)[None, :] <= place[some, None], windows[np.maximum(start, 0)] >> np.uint64(32), 0).astype(np.uint32)
                same = mixed((around.astype(np.uint64) * _power(STEPS, "up", _BASE)).sum(axis=1, dtype=np.uint64))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * STEPS), len(around), [None, pa.py_buffer(np.ascontiguousarray(around))]).cast(pa.binary())
                columns = [pa.array(keys[some].view(np.int64)), pa.array(same.view(np.int64)), pa.array(docs[some]), pa.array(place[some]), packed]
                yield pa.record_batch(columns, names=["key", "same", "doc_id", "at", "around"])

    return run


def _matched(keys: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each entry and step, whether an equal neighbour there is in another document; entries are sorted by step's window."""
    hit = np.zeros(around.shape, dtype=bool)
    for step in range(around.shape[1]):
        own = np.flatnonzero(around[:, step])
        if not len(own):
            continue
        value = mixed(keys[own].view(np.uint64) ^ (around[own, step].astype(np.uint64) << np.uint64(5)))
        order = own[np.argsort(value, kind="stable")]
        value = np.sort(value, kind="stable")
        starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        several = np.minimum.reduceat(low[order], starts) != np.maximum.reduceat(high[order], starts)
        hit[order, step] = np.repeat(several, np.diff(np.append(starts, len(order))))
    return hit


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries arrive sorted by prefix; a batch and the prefix that goes on beyond it are in memory."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        held += [] if batch is None else [batch]
        if not held:
            return
        if batch is not None and len(held) > 1 and batch.column("key")[-1] == held[0].column("key")[-1]:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table["key"].to_numpy()
        cut = len(keys) if batch is None else int(np.searchsorted(keys, keys[-1]))
        held = table.slice(cut).combine_chunks().to_batches() if cut < len(keys) else []
        if not cut:
            continue
        table = table.slice(0, cut)
        around = np.frombuffer(b"".join(table["around"].to_pylist()), dtype=np.uint32).reshape(-1, STEPS)
        hit = _matched(keys[:cut], around, table["low"].to_numpy(), table["high"].to_numpy())
        some = np.flatnonzero(hit.any(axis=1))
        reach = [hit[some].argmax(axis=1), STEPS - 1 - hit[some, ::-1].argmax(axis=1)]
        yield pa.record_batch([pa.array(keys[some]), table["same"].combine_chunks().take(pa.array(some)), *map(pa.array, reach)], names=["key", "same", "near", "far"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        around = np.frombuffer(b"".join(batch.column("around").to_pylist()), dtype=np.uint32).reshape(-1, STEPS)
        row, step = np.nonzero(around)
        take = [batch.column(c).take(pa.array(row)) for c in ("key", "same", "low", "high")]
        yield pa.record_batch([*take, pa.array(step), pa.array(around[row, step].astype(np.int64))], names=["key", "same", "low", "high", "step", "window"])


def repeated_passages(docs: DataFrame, entries: int = ENTRIES) -> DataFrame:
    """``doc_id``, ``start_word``, ``end_word`` (exclusive), ``n_words`` of each passage of 50 words or more that another document has too.

    ``docs`` has ``doc_id`` and ``text``; words are runs without white space, A-Z as a-z. Every window of 50 words that
    also stands in a document of another id is covered, and overlapping or touching windows are
    one passage. Rows with a null id or without 50 words have no passages; rows of one id count as one document.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(_prefixes, "key long, doc_id long")
    keys = found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low != high")
    cell = F.pmod(F.shiftrightunsigned("key", 7), F.lit(FILTER_BITS)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(cell).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    # FILTER_BITS bits, whatever the number of prefixes
    bitmap = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for part, bits in zip(*maps.toArrow().to_pydict().values()):
        bitmap[(part - 1) * 4096 : part * 4096] = np.frombuffer(bits, dtype=np.uint8)
    suffixes = written(texts.mapInArrow(_suffixes(spark.sparkContext.broadcast(bitmap)), "key long, same long, doc_id long, at long, around binary"))

    places = suffixes.groupBy("key", "same").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("around").alias("around"))
    places = written(places)
    large = places.groupBy("key").count().where(F.col("count") > entries).select("key")
    some = places.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key", "around")
    reach = some.mapInArrow(_compared, "key long, same long, near long, far long")
    spread = places.join(large, "key", "left_semi").select("key", "same", "low", "high", "around")
    spread = spread.mapInArrow(_spread, "key long, same long, low long, high long, step long, window long")
    shared = spread.groupBy("key", "step", "window").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").drop("low", "high")
    more = spread.join(shared, ["key", "step", "window"]).groupBy("key", "same").agg(F.min("step").alias("near"), F.max("step").alias("far"))
    reach = reach.unionByName(more)

    spans = suffixes.select("key", "same", "doc_id", "at").join(reach, ["key", "same"])
    spans = spans.select("doc_id", (F.col("at") - F.col("far")).alias("start"), (F.col("at") - F.col("near") + WORDS).alias("end")).distinct()
    # a document has no more spans than words
    order = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    passage = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("passage", passage)
    merged = marked.groupBy("doc_id", "passage").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE doc_id IS NOT NULL AND len(w) >= 50)),
shared AS (SELECT g FROM windows GROUP BY g HAVING min(doc_id) <> max(doc_id)),
hits AS (SELECT DISTINCT doc_id, pos FROM windows SEMI JOIN shared USING (g)),
marked AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 50 THEN 0 ELSE 1 END AS new FROM hits WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grouped AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS passage FROM marked)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 AS end_word, max(pos) + 50 - min(pos) AS n_words FROM grouped GROUP BY doc_id, passage
"""
