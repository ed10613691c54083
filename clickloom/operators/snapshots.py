"""History that grows by days: daily aggregates, and running totals that a new day is added to.

A store keeps, for fixed key sets, the aggregates of each day (appended, never rewritten) and a snapshot of the
totals up to its last day. A new day reads that day's clicks and one snapshot, not the log. A day's features come from
the snapshot of the days before it, or, over the last few days, from these days' aggregates.

Every addition writes its days and its snapshot under new names and then appends one line to the store's ledger. Readers
follow the ledger, so an addition that was cut off leaves nothing that they see, and can simply be made again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.rates import is_bought, is_known
from clickloom.operators import history
from clickloom.operators.history import BOUGHT, DAY, SEEN, attribute_totals, key_name
from clickloom.operators.keyed import MOST_SETS, ROWS, Keys, KeyedStats, as_keys
from clickloom.session import exists, limits, listed, removed, written

_SET = "key_set"


@dataclass(frozen=True)
class _Line:
    """One addition: the days it added, where they and the totals up to its last day lie, and the totals' keys by key set."""

    days: list[int]
    daily: str
    snapshot: str
    sizes: dict[str, int]


class HistoryStore:
    """Outcome counts by ``key_sets``, and sums of ``attributes`` for their means, in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, key_sets: Iterable[str | Keys], attributes: Iterable[str] = ()):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.key_sets = [as_keys(k) for k in key_sets]
        self.columns = list(dict.fromkeys(c for keys in self.key_sets for c in keys))
        self.attributes = tuple(attributes)
        self.totals: dict[str, Column] = {SEEN: is_known(), BOUGHT: is_bought(), **attribute_totals(self.attributes)}

    # ---- the ledger --------------------------------------------------------------------------

    def _lines(self) -> list[_Line]:
        """One line per addition, oldest first: a few hundred bytes a day."""
        if not exists(self.spark, f"{self.folder}/ledger"):
            return []
        rows = self.spark.read.schema("number long, line string").parquet(f"{self.folder}/ledger").orderBy("number").collect()
        lines = [json.loads(row["line"]) for row in rows]
        for line in lines:
            if line["key_sets"] != list(map(list, self.key_sets)) or line["attributes"] != list(self.attributes):
                raise ValueError(f"{self.folder} holds other key sets: {line['key_sets']}, {line['attributes']}")
        return [_Line(line["days"], line["daily"], line["snapshot"], line["sizes"]) for line in lines]

    def days(self) -> list[int]:
        return [day for line in self._lines() for day in line.days]

    # ---- adding days -------------------------------------------------------------------------

    def _sums(self, again: bool) -> list[Column]:
        rows = F.sum(ROWS) if again else F.count("*")
        return [rows.alias(ROWS), *[F.sum(F.col(name) if again else column).alias(name) for name, column in self.totals.items()]]

    def _daily(self, df: DataFrame) -> DataFrame:
        """Aggregates by each key set and day, a few key sets to a pass."""
        frames = []
        for at in range(0, len(self.key_sets), MOST_SETS):
            sets = self.key_sets[at : at + MOST_SETS]
            ids = {sum(1 << (len(self.columns) - i) for i, c in enumerate(self.columns) if c not in keys): key_name(keys) for keys in sets}
            names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
            grouped = df.groupingSets([[*[F.col(c) for c in keys], F.col(DAY)] for keys in sets], *self.columns, DAY)
            frames.append(grouped.agg(names[F.grouping_id().cast("int")].alias(_SET), *self._sums(again=False)))
        return reduce(DataFrame.unionByName, frames)

    def add(self, df: DataFrame) -> None:
        """Add the clicks of one day, or of several, all later than those in the store. Only ``df`` and the last snapshot are read."""
        lines = self._lines()
        new = sorted(row[0] for row in df.select(DAY).distinct().collect())
        if not new:
            return
        last = max((day for line in lines for day in line.days), default=None)
        if new[0] is None or (last is not None and new[0] <= last):
            raise ValueError(f"day {new[0]} is not later than day {last} of the store")
        name = uuid.uuid4().hex
        daily = written(self._daily(df), partition_by=DAY, path=f"{self.folder}/daily/{name}")
        parts = [daily.drop(DAY)]
        if lines:
            parts.append(self._read(lines[-1].snapshot).select(*parts[0].columns))
        totals = reduce(DataFrame.unionByName, parts).groupBy(_SET, *self.columns).agg(*self._sums(again=True))
        snapshot = written(totals, partition_by=_SET, path=f"{self.folder}/snapshot/{name}")
        sizes = {row[_SET]: row["count"] for row in snapshot.groupBy(_SET).count().collect()}
        line = {"days": new, "daily": f"{self.folder}/daily/{name}", "snapshot": f"{self.folder}/snapshot/{name}", "sizes": sizes}
        line |= {"key_sets": self.key_sets, "attributes": self.attributes}
        self.spark.createDataFrame([(len(lines), json.dumps(line))], "number long, line string").coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def forget(self, before: int) -> None:
        """Remove the snapshots that only days before ``before`` would use, and what cut-off additions left. No addition may be running."""
        lines = self._lines()
        used = {line.daily for line in lines}
        used |= {line.snapshot for line, following in zip(lines, [*lines[1:], None]) if following is None or following.days[0] >= before}
        names = {path.rsplit("/", 1)[1] for path in used}
        for kind in ("daily", "snapshot"):
            for folder in listed(self.spark, f"{self.folder}/{kind}"):
                if folder.rsplit("/", 1)[1] not in names or (kind == "snapshot" and f"{self.folder}/{kind}/{folder.rsplit('/', 1)[1]}" not in used):
                    removed(folder, self.spark)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    # ---- reading -----------------------------------------------------------------------------

    def before(self, day: int, days: int | None = None) -> KeyedStats:
        """Totals of the days before ``day``, all of them or the last ``days``. Days that are not in the store count nothing."""
        lines = [line for line in self._lines() if line.days[0] < day]
        if days is None and (not lines or max(lines[-1].days) < day):
            if not lines:
                return self._stats(None, {})
            return self._stats(self._read(lines[-1].snapshot), lines[-1].sizes)
        # from the daily aggregates of a few days, or from those after the last snapshot that lies wholly before the day
        whole = [line for line in lines if max(line.days) < day] if days is None else []
        first = min((d for line in lines for d in line.days), default=day) if days is None else day - days
        since = max(whole[-1].days) + 1 if whole else first
        parts = [self._read(line.daily).where(F.col(DAY).between(since, day - 1)).drop(DAY) for line in lines if max(line.days) >= since]
        if whole:
            parts.append(self._read(whole[-1].snapshot))
        if not parts:
            return self._stats(None, {})
        columns = [_SET, *self.columns, ROWS, *self.totals]
        summed = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts]).groupBy(_SET, *self.columns).agg(*self._sums(again=True))
        table = written(summed, partition_by=_SET)
        return self._stats(table, {row[_SET]: row["count"] for row in table.groupBy(_SET).count().collect()})

    def _stats(self, table: DataFrame | None, sizes: Mapping[str, int]) -> KeyedStats:
        if table is None:
            fields = [f"CAST(NULL AS string) AS {_SET}", *[f"CAST(NULL AS string) AS {c}" for c in self.columns], *[f"CAST(NULL AS bigint) AS {c}" for c in (ROWS, *self.totals)]]
            table = self.spark.range(0).selectExpr(*fields)
        return KeyedStats(
            tables={keys: table for keys in self.key_sets}, set_ids={keys: f"'{key_name(keys)}'" for keys in self.key_sets},
            sizes={keys: sizes.get(key_name(keys), 0) for keys in self.key_sets}, hot={}, values=(ROWS, *self.totals), limits=limits(self.spark),
        )

    def cvr(self, now: DataFrame, day: int, key_sets: Iterable[str | Keys], days: int | None = None, source: DataFrame | None = None) -> DataFrame:
        """``<keys>_sum``, ``_buy`` and ``_cvr`` of the rows of ``day``, as :func:`history.history_cvr` over the days before it."""
        return history.attach_cvr(self.before(day, days), now, key_sets, source=source)

    def means(self, now: DataFrame, day: int, named: Mapping[str, tuple[str | Keys, str]], days: int | None = None, source: DataFrame | None = None) -> DataFrame:
        return history.attach_means(self.before(day, days), now, named, source=source)

    def first_appearance(self, now: DataFrame, day: int, named: Mapping[str, str], days: int | None = None, source: DataFrame | None = None) -> DataFrame:
        return history.attach_first_appearance(self.before(day, days), now, named, source=source)
