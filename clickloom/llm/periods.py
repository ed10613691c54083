"""Periodic runs of words by a dictionary of basic factors.

A run is a longest stretch of words with smallest period q that holds q at least twice. The dictionary names, for every
power of two L, the factors of L words, so that equal factors have equal names. Within a run with L <= q < 2 L, the factor
at a word comes again q words later. The occurrences of a factor that follow one another at equal distances are one
arithmetic progression, and only few of them fit into 2 L words. So from each occurrence the first and the last members of
the progressions that begin within 2 L words propose periods, and one of these is q for some word of every run: two
progressions that a run of period q shifts onto each other have a first or a last member in common, or the run ends
between them. Each proposal is extended both ways by comparing names, longest factors first; equal runs are dropped.

All texts of a slice are worked on together. Names differ between texts, so no run crosses from one into another.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from clickloom.llm.words import slices, small_batches

#: Least words of a run.
LEAST = 12

RUNS = "struct<words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"

_NONE = np.iinfo(np.int64).max


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of several texts, one after another, and where those of each text begin (and the last one ends)."""
    parts = pc.ascii_split_whitespace(text.cast(pa.large_string()).fill_null(""))
    words, owner = pc.list_flatten(parts), pc.list_parent_indices(parts)
    # white space at an end of a text leaves an empty part
    full = pc.greater(pc.binary_length(words), 0)
    counts = np.bincount(owner.filter(full).to_numpy(zero_copy_only=False), minlength=len(text))
    return words.filter(full), np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Level:
    """Factors of ``length`` words: a name per word, negative where no other factor of the text is equal, and the places of the rest by name."""

    length: int
    name: np.ndarray
    places: np.ndarray


def _named(n: int, length: int, at: np.ndarray, key: np.ndarray) -> Level:
    """Name the factors that begin at ``at`` by ``key``; one that occurs once gets a name of its own."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    again = np.bincount(group, minlength=1)[group] > 1
    places, group = at[order[again]], group[again]
    name = -1 - np.arange(n, dtype=np.int64)
    name[places] = group
    return Level(length, name, places)


def basic_factors(ids: np.ndarray, first: np.ndarray) -> list[Level]:
    """Levels of 1, 2, 4, ... words, up to the last that holds equal factors."""
    n = len(ids)
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first))
    every = np.arange(n, dtype=np.int64)
    level = _named(n, 1, every, owner * (int(ids.max(initial=0)) + 1) + ids)
    levels = []
    while len(level.places):
        levels.append(level)
        step, name = level.length, level.name
        at = np.sort(level.places)
        at = at[at + step < n]
        at = at[name[at + step] >= 0]
        level = _named(n, 2 * step, at, name[at] * (n + 1) + name[at + step])
    return levels


def proposals(level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods from ``length`` to below twice that, by the progressions of equal factors."""
    places, bound = level.places, 2 * level.length
    gap = np.full(len(places), _NONE)
    names = level.name[places]
    gap[:-1] = np.where(names[1:] == names[:-1], places[1:] - places[:-1], _NONE)
    # the last place of the progression that begins with a gap
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    turns = np.append(turns, len(gap) - 1)
    last = turns[np.searchsorted(turns, np.arange(len(gap)))] + 1
    here = np.flatnonzero(gap < bound)
    now = here
    found_at, found = [], []
    while len(here):
        for member in (now + 1, last[now]):
            period = places[member] - places[here]
            fits = (period >= level.length) & (period < bound)
            found_at.append(places[here[fits]])
            found.append(period[fits])
        now = last[now]
        more = gap[now] < bound
        more[more] = places[now[more]] + gap[now[more]] - places[here[more]] < bound
        here, now = here[more], now[more]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found)


def _extended(levels: list[Level], at: np.ndarray, period: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word, and the word after the last, of the longest stretch around each place that keeps the period."""
    low, high = at.copy(), at.copy()
    for level in reversed(levels):
        length, name = level.length, level.name
        fits = high + period < n
        fits[fits] = name[high[fits]] == name[high[fits] + period[fits]]
        high[fits] += length
        fits = low >= length
        fits[fits] = name[low[fits] - length] == name[low[fits] - length + period[fits]]
        low[fits] -= length
    return low, high + period


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, lengths and periods of all runs of at least ``least`` words, by first word, then by period.

    ``ids`` are the words of all texts as numbers, those of text i at ``first[i]`` to ``first[i + 1]``.
    """
    n = len(ids)
    levels = basic_factors(ids, first)
    lows, highs, periods = [], [], []
    for level in levels:
        at, period = proposals(level)
        # of neighbouring places with one period, the first stands for all
        key = np.unique(period * (n + 1) + at)
        key = key[np.diff(key, prepend=-2) != 1]
        period, at = key // (n + 1), key % (n + 1)
        low, high = _extended(levels, at, period, n)
        long = high - low >= np.maximum(least, 2 * period)
        lows.append(low[long])
        highs.append(high[long])
        periods.append(period[long])
    if not lows:
        none = np.zeros(0, np.int64)
        return none, none, none
    low, high, period = np.concatenate(lows), np.concatenate(highs), np.concatenate(periods)
    # a run with a multiple of its period is the same stretch; the smallest period names it
    order = np.lexsort([period, high, low])
    low, high, period = low[order], high[order], period[order]
    new = np.ones(len(low), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    low, high, period = low[new], high[new], period[new]
    order = np.lexsort([period, low])
    return low[order], (high - low)[order], period[order]


def _runs_of_texts(text: pa.Array, least: int) -> pa.Array:
    words, first = split_words(text)
    n = len(words)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start, length, period = runs_of(ids, first, least)
    owner = np.searchsorted(first, start, side="right") - 1
    # words of a run after its first period are dropped
    edge = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    kept = np.cumsum(edge[:n]) == 0
    kept_before = np.concatenate([[0], np.cumsum(kept)])
    collapsed = pc.binary_join(pa.LargeListArray.from_arrays(kept_before[first], words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    fields = [pa.array(start - first[owner]), pa.array(length), pa.array(period)]
    each = pa.StructArray.from_arrays(fields, names=["start", "length", "period"])
    ends = np.searchsorted(owner, np.arange(len(text) + 1)).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(np.diff(first)), pa.ListArray.from_arrays(ends, each), collapsed.cast(pa.string())], names=["words", "runs", "collapsed"])


def periodic_runs(text: str | Column = "text", least: int = LEAST) -> Column:
    """A struct of the number of ``words``, all ``runs`` (by start, then period) and the ``collapsed`` text.

    The collapsed text holds the words that no run has after its first period, joined by one space. Texts are taken
    whole. A null or empty text, or one of white space only, has no words, no runs and an empty collapsed text.
    """

    def run(text: pa.Array) -> pa.Array:
        batch = pa.record_batch([text], names=["text"])
        parts = [_runs_of_texts(part.column("text"), least) for part in slices(batch, "text")]
        return pa.concat_arrays(parts) if parts else _runs_of_texts(text, least)

    column = F.col(text) if isinstance(text, str) else text
    return arrow_udf(run, RUNS).asNondeterministic()(column.cast("string"))


def _planted(text: pa.Array, number: pa.Array) -> pa.Array:
    out = []
    for whole, h in zip(text, number.to_pylist()):
        words = whole.as_buffer().to_pybytes().split() if h is not None and h % 10 == 0 and whole.is_valid else []
        if words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            cycle = words[a : a + p]
            tail = cycle * (-(-(n - a) // p))
            out.append(b" ".join(words[:a] + tail[: n - a]).decode())
        else:
            out.append(whole.as_py())
    return pa.array(out, pa.string())


def planted(text: str = "text", doc_id: str = "doc_id") -> Column:
    """The text, where the id's number picks it with its words from some word on made periodic. A null id picks no text."""
    number = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return arrow_udf(_planted, "string")(F.col(text).cast("string"), number)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text of ``documents``, one row per row.

    Equal rows give equal rows. Null, empty and white texts have no run: four nulls and the digests of no bytes. With a
    null id the text is taken as it is. Of runs with the greatest length the one with the smallest start, then period, counts.
    """
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", periodic_runs(planted()).alias("own")).select("doc_id", "own.runs", "own.collapsed")
    best = F.expr("array_min(transform(runs, x -> struct(-x.length AS less, x.start AS start, x.period AS period)))")
    lines = F.expr("concat_ws('', transform(runs, x -> concat(x.start, ',', x.length, ',', x.period, '\\n')))")
    out = own.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * -best.less div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
