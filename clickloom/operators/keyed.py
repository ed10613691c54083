"""Aggregates by key, and joining them back to the rows.

Every feature of this kind is an aggregate by some key set, attached to each row by a left equi-join.
Four things keep that safe at scale:

* The aggregates of all key sets are computed together and written, with map-side partial sums, so a hot
  key is reduced before the shuffle. Up to ``MOST_SETS`` key sets, or any number over a small log, take
  one pass (``GROUPING SETS``). More of them take a lattice: a few root sets are counted from the log's
  key columns, at most ``MOST_SETS`` to a pass, and every other set is summed up from its smallest
  superset that is already written. See :func:`plan_lattice`.
* The aggregates' exact row counts are then known, and only an aggregate within
  ``Limits.broadcast_rows`` is broadcast.
* A larger one is joined by a shuffle, where a key with more than ``Limits.hot_rows`` rows is split:
  its rows get a salt, and its single aggregate row is repeated once per salt. AQE's own skew join
  can't do this here, because the aggregate below the join hides the shuffle it would have to split.
* What is aggregated are sums of row values, which can be summed up again; means are derived from them.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.session import Limits, estimated_bytes, limits, written

Keys = tuple[str, ...]

ROWS = "n_rows"
#: Key sets that one pass over a large log expands its rows to.
MOST_SETS = 4
#: A root set is made from several key sets only if it is sure to have at most this share of the log's rows.
ROOT_SHARE = 0.1
_SET = "key_set"
_SALT = "salt"
_PARTS = "salt_parts"


def as_keys(keys: str | Iterable[str]) -> Keys:
    return (keys,) if isinstance(keys, str) else tuple(keys)


@dataclass(frozen=True)
class KeyedStats:
    """Aggregates of several key sets in written tables, with the size of each.

    ``lineage`` names what each pass read (a key set, or None for the log) and the sets it made.
    """

    tables: Mapping[Keys, DataFrame]
    set_ids: Mapping[Keys, int]
    sizes: Mapping[Keys, int]
    hot: Mapping[Keys, int]
    values: tuple[str, ...]
    limits: Limits
    lineage: tuple[tuple[Keys | None, tuple[Keys, ...]], ...] = ()

    def of(self, keys: str | Iterable[str], **renamed: str) -> DataFrame:
        """Aggregates of one key set; ``renamed`` picks them as ``new_name=old_name``."""
        keys = as_keys(keys)
        picked = renamed or {v: v for v in self.values}
        return self.tables[keys].where(f"{_SET} = {self.set_ids[keys]}").selectExpr(
            *keys, *[f"{old} AS {new}" for new, old in picked.items()]
        )

    def hot_keys(self, keys: str | Iterable[str]) -> DataFrame | None:
        """Keys with more rows than a task should take, with their row counts; None if there are none."""
        keys = as_keys(keys)
        if not self.hot[keys]:
            return None
        return self.of(keys, **{ROWS: ROWS}).where(f"{ROWS} > {self.limits.hot_rows}")


# ---- the lattice of key sets -----------------------------------------------------------------


def maximal(sets: Iterable[Keys]) -> list[Keys]:
    """The sets that are in no other one."""
    sets = list(sets)
    return [keys for keys in sets if not any(set(keys) < set(other) for other in sets)]


def plan_lattice(sets: Sequence[Keys], values: Mapping[str, int], rows: int) -> list[Keys]:
    """The root sets to count from the log. Every set is one of them or in one of them.

    Roots start as the sets that are in no other one. Two roots become one, smallest first, as long as
    the product of their columns' ``values`` shows that the union has at most ``ROOT_SHARE`` of the ``rows``.
    """

    def bound(keys: Iterable[str]) -> int:
        return prod(values[c] + 1 for c in keys)

    roots = maximal(sets)
    while True:
        unions = [
            (bound(set(one) | set(two)), one, two) for i, one in enumerate(roots) for two in roots[:i]
        ]
        size, one, two = min(unions, default=(rows, (), ()))
        if not unions or size > rows * ROOT_SHARE:
            return roots
        union = tuple(dict.fromkeys((*one, *two)))
        roots = [keys for keys in roots if not set(keys) <= set(union)] + [union]


@dataclass
class _Pass:
    """Grouping one source by some key sets; ids of sets are the same over all passes."""

    columns: list[str]
    totals: Mapping[str, Column]
    within: Mapping[str, str]
    apart: Sequence[str]
    ids: dict[Keys, int] = field(default_factory=dict)

    def set_id(self, keys: Keys) -> int:
        # grouping_id() has one bit per column, first column highest, set where the column is left out
        return sum(1 << (len(self.columns) - 1 - i) for i, c in enumerate(self.columns) if c not in keys)

    def grouped(self, source: DataFrame, sets: Sequence[Keys], again: bool) -> DataFrame:
        """Row count and totals of each set; ``again`` sums up rows that are themselves such sums."""
        # a column that the source lacks is in none of the sets
        source = source.withColumns({c: F.lit(None).cast("string") for c in self.columns if c not in source.columns})
        rows = F.sum(ROWS) if again else F.count("*")
        return source.groupingSets([[F.col(c) for c in keys] for keys in sets], *self.columns).agg(
            F.grouping_id().cast("bigint").alias(_SET),
            rows.alias(ROWS),
            *[F.sum(F.col(name) if again else column).alias(name) for name, column in self.totals.items()],
        )

    def windowed(self, grouped: DataFrame) -> DataFrame:
        if not self.within:
            return grouped
        keys_text = ", ".join([_SET, *[c for c in self.columns if c not in self.apart]])
        return grouped.selectExpr("*", *[f"{text.format(keys=keys_text)} AS {name}" for name, text in self.within.items()])


def keyed_stats(
    df: DataFrame,
    key_sets: Iterable[str | Iterable[str]],
    within: Mapping[str, str] | None = None,
    apart: Sequence[str] = (),
    **totals: Column,
) -> KeyedStats:
    """Row count and ``totals`` (sums of row values, null values left out) for every key set.

    ``within`` adds expressions over the aggregated rows, windows among them, for all key sets in one
    shuffle. In their text ``{keys}`` stands for the key columns other than those named in ``apart``.
    """
    sets = list(dict.fromkeys(as_keys(k) for k in key_sets))
    columns = list(dict.fromkeys(c for keys in sets for c in keys))
    work = _Pass(columns, totals, within or {}, apart)
    ids = {keys: work.set_id(keys) for keys in sets}
    if len(set(ids.values())) != len(sets):
        raise ValueError("two key sets hold the same columns in a different order")
    bound = limits(df.sparkSession)
    levels: list[tuple[DataFrame, list[Keys]]] = []
    sizes: dict[Keys, int] = {}
    hot: dict[Keys, int] = {}
    lineage: list[tuple[Keys | None, tuple[Keys, ...]]] = []

    def add(grouped: DataFrame, made: list[Keys]) -> None:
        # rows of one set lie together, so reading one set skips the row groups of the others
        table = written(work.windowed(grouped), sort_by=_SET)
        levels.append((table, made))
        # one row per key set
        counted = {
            row[_SET]: row
            for row in table.groupBy(_SET)
            .agg(F.count("*").alias("keys"), F.count_if(F.col(ROWS) > bound.hot_rows).alias("hot"))
            .collect()
        }
        for keys in made:
            row = counted.get(work.set_id(keys))
            sizes[keys], hot[keys] = (row["keys"], row["hot"]) if row else (0, 0)

    def pass_over(source: DataFrame, read: Keys | None, made: Sequence[Keys]) -> DataFrame:
        lineage.append((read, tuple(made)))
        return work.grouped(source, made, again=read is not None)

    if len(sets) <= MOST_SETS or estimated_bytes(df) <= bound.expand_bytes:
        add(pass_over(df, None, sets), sets)
    else:
        # the keys and the summed values only, so that no pass repeats what made the log
        narrow = written(df.select(*columns, *[column.alias(name) for name, column in totals.items()]))
        work.totals = {name: F.col(name) for name in totals}
        row = narrow.agg(F.count("*"), *[F.approx_count_distinct(c) for c in columns]).first()
        roots = plan_lattice(sets, dict(zip(columns, row[1:])), row[0])
        passes = [roots[i : i + MOST_SETS] for i in range(0, len(roots), MOST_SETS)]
        add(reduce(DataFrame.unionByName, [pass_over(narrow, None, made) for made in passes]), roots)
        rest = [keys for keys in sets if work.set_id(keys) not in {work.set_id(root) for root in roots}]
        while rest:
            level = maximal(rest)
            rest = [keys for keys in rest if keys not in level]
            by_parent: dict[Keys, list[Keys]] = {}
            for keys in level:
                parent = min((p for p in sizes if set(keys) < set(p)), key=lambda p: (sizes[p], p))
                by_parent.setdefault(parent, []).append(keys)
            tables = {keys: table for table, made in levels for keys in made}
            sums = [ROWS, *totals]
            frames = [pass_over(tables[p].where(f"{_SET} = {work.set_id(p)}").select(*p, *sums), p, made) for p, made in by_parent.items()]
            kinds = dict(narrow.dtypes)
            frames = [frame.withColumns({c: F.col(c).cast(kinds[c]) for c in columns}) for frame in frames]
            add(reduce(DataFrame.unionByName, frames), level)
    tables = {work.set_id(keys): table for table, made in levels for keys in made}
    of_id = {work.set_id(keys): keys for keys in sizes}
    return KeyedStats(
        tables={keys: tables[i] for keys, i in ids.items()},
        set_ids=ids,
        sizes={keys: sizes[of_id[i]] for keys, i in ids.items()},
        hot={keys: hot[of_id[i]] for keys, i in ids.items()},
        values=(ROWS, *totals, *(within or ())),
        limits=bound,
        lineage=tuple(lineage),
    )


#: Bytes of a value in a broadcast row, for texts and for the rest, with what a hash table adds.
_TEXT_BYTES, _VALUE_BYTES, _ROW_BYTES = 40, 8, 32


def broadcast_size(stats: DataFrame, rows: int) -> int:
    """Bytes that so many rows of ``stats`` take in a broadcast, about."""
    kinds = [kind for _, kind in stats.dtypes]
    return rows * (_ROW_BYTES + sum(_TEXT_BYTES if kind == "string" else _VALUE_BYTES for kind in kinds))


class Budget:
    """What is left to broadcast for one family of features."""

    def __init__(self, bound: Limits):
        self.rows, self.left = bound.broadcast_rows, bound.broadcast_bytes

    def takes(self, stats: DataFrame, rows: int) -> bool:
        size = broadcast_size(stats, rows)
        if rows > self.rows or size > self.left:
            return False
        self.left -= size
        return True


def attach(
    df: DataFrame,
    stats: DataFrame,
    on: str | Iterable[str],
    *,
    size: int | None = None,
    hot: DataFrame | None = None,
    spread_by: Sequence[str] = ("instance_id",),
    bound: Limits | None = None,
    null_safe: bool = False,
    budget: Budget | None = None,
) -> DataFrame:
    """Left-join ``stats`` (one row per key) to ``df``. ``null_safe`` lets null keys meet; otherwise they match nothing.

    ``size`` is the counted number of rows of ``stats``, if known. ``hot`` lists keys of ``df`` with
    their row counts in ``n_rows``; it may be lazy, and may hold only keys above ``hot_rows``.
    ``spread_by`` names columns that tell the rows of one key apart.
    """
    on = list(as_keys(on))
    bound = bound or limits(df.sparkSession)
    if size is not None and (budget or Budget(bound)).takes(stats, size):
        return _joined(df, F.broadcast(stats), on, null_safe)
    if hot is None:
        return _joined(df, stats, on, null_safe)
    return _salted(df, stats, on, hot, bound.hot_rows, spread_by, null_safe)


#: So many columns that no join needs are carried through a chain of joins in arrays.
PACK_FROM = 20
_PACK = "packed_"


class Pack:
    """Columns that a chain of joins only carries along, put into one array for each of their types.

    Every join copies each column of its rows, and generates no code of its own for rows of more than
    ``spark.sql.codegen.maxFields`` columns. Arrays are copied whole, and count as one column.
    """

    def __init__(self, df: DataFrame, keep: Iterable[str]):
        keep = set(keep)
        kinds: dict[str, list[str]] = {}
        for name, kind in df.dtypes:
            if name not in keep:
                kinds.setdefault(kind, []).append(name)
        # metadata and types of a user's own stay with their columns
        plain = {f.name for f in df.schema.fields if not f.metadata and not isinstance(f.dataType, T.UserDefinedType)}
        groups = [[c for c in names if c in plain] for names in kinds.values()]
        groups = [names for names in groups if len(names) > 1]
        if sum(map(len, groups)) < PACK_FROM:
            groups = []
        self.places = {name: F.get(F.col(f"{_PACK}{i}"), F.lit(at)).alias(name) for i, names in enumerate(groups) for at, name in enumerate(names)}
        arrays = [F.array(*[F.col(c) for c in names]).alias(f"{_PACK}{i}") for i, names in enumerate(groups)]
        self.columns = df.columns
        self.df = df.select(*[c for c in df.columns if c not in self.places], *arrays) if groups else df

    def opened(self, df: DataFrame, moved: Iterable[str] = ()) -> DataFrame:
        """``df``, which the joins made, with the columns in their places; those ``moved`` to the front, as joins by name do."""
        if not self.places:
            return df
        moved = list(moved)
        first = [*moved, *[c for c in self.columns if c not in moved]]
        new = [c for c in df.columns if c not in self.columns and not c.startswith(_PACK)]
        return df.select(*[self.places.get(c, c) for c in first], *new)


def _joined(df: DataFrame, other: DataFrame, on: list[str], null_safe: bool) -> DataFrame:
    if not null_safe:
        return df.join(other, on, "left")
    named = {key: f"_other_{key}" for key in on}
    same = reduce(lambda a, b: a & b, [F.col(key).eqNullSafe(F.col(name)) for key, name in named.items()])
    return df.join(other.withColumnsRenamed(named), same, "left").drop(*named.values())


def _salted(df: DataFrame, stats: DataFrame, on: list[str], hot: DataFrame, hot_rows: int, spread_by: Sequence[str], null_safe: bool = False) -> DataFrame:
    # at most rows / hot_rows keys pass the filter, so this list is safe to broadcast
    parts = F.broadcast(
        hot.where(F.col(ROWS) > hot_rows).select(*on, F.ceil(F.col(ROWS) / hot_rows).cast("int").alias(_PARTS))
    )
    spread = F.xxhash64(*spread_by)
    no_key = F.lit(False)
    for key in () if null_safe else on:
        no_key = no_key | F.col(key).isNull()
    salt = (
        F.when(F.col(_PARTS).isNotNull(), F.pmod(spread, F.col(_PARTS)))
        # rows without a key match nothing; spread them as well
        .when(no_key, F.pmod(spread, F.lit(4096)))
        .otherwise(F.lit(0))
        .cast("int")
    )
    salted_rows = _joined(df, parts, on, null_safe).withColumn(_SALT, salt).drop(_PARTS)
    salted_stats = (
        _joined(stats, parts, on, null_safe)
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_PARTS), F.lit(1)) - 1)))
        .drop(_PARTS)
    )
    return _joined(salted_rows, salted_stats, [*on, _SALT], null_safe).drop(_SALT)


def attach_each(
    df: DataFrame,
    stats: KeyedStats,
    features: Mapping[str | Keys, Mapping[str, str]],
    *,
    rows: KeyedStats | None = None,
    spread_by: Sequence[str] = ("instance_id",),
) -> DataFrame:
    """Attach several key sets: ``features`` maps a key set to ``{new column: aggregate}``.

    ``rows`` holds the row counts of ``df`` by the same key sets, where ``stats`` was computed from
    another table; a shuffle join needs them to find its hot keys.
    """
    budget = Budget(stats.limits)
    pack = Pack(df, [*(c for keys in features for c in as_keys(keys)), *spread_by])
    df, moved = pack.df, []
    for keys, named in features.items():
        keys = as_keys(keys)
        moved = [*keys, *[c for c in moved if c not in keys]]
        counted = stats if rows is None else rows
        df = attach(
            df,
            stats.of(keys, **named),
            keys,
            size=stats.sizes[keys],
            hot=counted.hot_keys(keys) if keys in counted.hot else None,
            spread_by=spread_by,
            bound=stats.limits,
            budget=budget,
        )
    return pack.opened(df, moved)
