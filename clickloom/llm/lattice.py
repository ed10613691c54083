"""Near-duplicate vectors by lattice hashing.

Several tables of random projections take each vector to eight dimensions, where it is decoded to the nearest point
of the E8 lattice. A vector is stored under its own point and looked up under the nearest
neighbouring points too. Vectors that meet are compared by cosine.

Equal vectors are one class. Members of a cell are compared in blocks of bounded size. Pairs are counted,
not listed: a task returns per vector the number of its links and the smallest one it is tied to.
A pair that meets in several cells is counted in the first of them only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm.graph import components
from clickloom.llm.words import mixed, numbered
from clickloom.session import written

TABLES = 4
PROBES = 4
WIDTH = 1.7
#: Entries of a cell compared by one task; a larger cell is dealt out over pairs of blocks.
BLOCK = 2_048
COSINE = 0.9


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of +-1, or all of +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for x, y in product((1.0, -1.0), repeat=2):
            row = np.zeros(8)
            row[i], row[j] = x, y
            rows.append(row)
    rows += [np.array(signs) for signs in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in signs) % 2 == 0]
    return np.array(rows)


SHORTEST = _shortest()


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum: round, and if the sum is odd move the worst coordinate the other way."""
    point = np.rint(y)
    off = y - point
    odd = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(axis=1)
    point[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return point


def nearest_point(y: np.ndarray) -> np.ndarray:
    """The nearest point of E8 to each row of eight numbers."""
    even, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    closer = ((y - even) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], even, half)


_STEPS = numbered(10, 9) | np.uint64(1)


def _cell(points: np.ndarray, table: int, dims: int) -> np.ndarray:
    """A number of 64 bits for each lattice point of a table."""
    whole = np.rint(points * 2).astype(np.int64).view(np.uint64)
    salt = np.uint64((table * int(_STEPS[8]) + dims * int(_STEPS[9])) % (1 << 64))
    return mixed(salt + (whole * _STEPS[:8]).sum(axis=-1, dtype=np.uint64)).view(np.int64)


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors**2).sum(axis=1, keepdims=True))


def cells_of(vectors: np.ndarray, tables: int, probes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cell (n, tables) and neighbouring cells (n, tables, probes) of vectors of one length."""
    dims = vectors.shape[1]
    unit = _unit(vectors)
    own, near = [], []
    for table in range(tables):
        plane = np.random.Generator(np.random.PCG64([table, dims])).normal(size=(dims, 8)) / width
        y = unit @ plane
        point = nearest_point(y)
        order = np.argsort(-((y - point) @ SHORTEST.T), axis=1, kind="stable")[:, :probes]
        own.append(_cell(point, table, dims))
        near.append(_cell(point[:, None, :] + SHORTEST[order], table, dims))
    return np.stack(own, axis=1), np.stack(near, axis=1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32), np.ascontiguousarray(rows).ravel())


def _hashed(tables: int, probes: int, width: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.compute.list_value_length(batch.column("embedding")).to_numpy()
            for dims in np.unique(length):
                rows = batch.filter(pa.array(length == dims))
                vectors = rows.column("embedding").flatten().to_numpy().reshape(-1, int(dims))
                own, near = cells_of(vectors, tables, probes, width)
                yield pa.record_batch([rows.column("rep"), rows.column("m"), rows.column("embedding"), _lists(own), _lists(near.reshape(len(own), -1))], names=["rep", "m", "embedding", "own", "near"])

    return run


def _tied(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row reaches by a matrix of links."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i] = i
            front = linked[i] & (root < 0)
            while front.any():
                root[front] = i
                front = linked[front].any(axis=0) & (root < 0)
    return root


def _compared(table: pa.Table, probes: int, cosine: float) -> pa.RecordBatch | None:
    """Links among the entries of one bucket: (vector, links counted here, smallest vector tied to here)."""
    cell, which, block, other = (table[c][0].as_py() for c in ("cell", "t", "block", "other"))
    ids, home, side, m = (table[c].to_numpy() for c in ("rep", "home", "side", "m"))
    vectors = table["embedding"].combine_chunks()
    unit = _unit(vectors.flatten().to_numpy().reshape(len(vectors), -1))
    own = table["own"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    near = table["near"].combine_chunks().flatten().to_numpy().reshape(len(ids), own.shape[1], probes)
    links = np.zeros(len(ids), dtype=np.int64)
    linked = np.zeros((len(ids), len(ids)), dtype=bool)
    for at in range(0, len(ids), 256):
        rows = slice(at, at + 256)
        meet = (unit[rows] @ unit.T >= cosine) & (home[rows, None] | home[None, :]) & (ids[rows, None] < ids[None, :])
        if block != other:
            meet &= side[rows, None] != side[None, :]
        a, b = np.nonzero(meet)
        a += at
        linked[a, b] = linked[b, a] = True
        first = np.ones(len(a), dtype=bool)
        for t in range(which + 1):
            same = own[a, t] == own[b, t]
            to_b = (near[a, t] == own[b, t, None]).any(axis=1)
            to_a = (near[b, t] == own[a, t, None]).any(axis=1)
            if t < which:
                first &= ~(same | to_a | to_b)
            else:
                # of two cells in which each is a neighbour of the other, the one of the smaller id counts
                first &= same | (to_a & (own[a, t] == cell)) | (to_b & ~to_a & (own[b, t] == cell))
        np.add.at(links, a[first], m[b[first]])
        np.add.at(links, b[first], m[a[first]])
    some = linked.any(axis=1)
    if not some.any():
        return None
    order = np.argsort(ids, kind="stable")
    root = np.empty(len(ids), dtype=np.int64)
    root[order] = ids[order][_tied(linked[np.ix_(order, order)])]
    return pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["rep", "links", "root"])


def _bucket_links(probes: int, cosine: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive one after the other; one is in memory at a time, besides a batch."""
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([*held, *([] if batch is None else [batch])]) if held or batch is not None else None
            if table is None:
                return
            keys = np.stack([table[c].to_numpy() for c in ("cell", "block", "other")])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            ends = np.append(starts[1:], table.num_rows)
            last = None if batch is None else len(starts) - 1
            for x, y in zip(starts[:last], ends[:last]):
                found = _compared(table.slice(x, y - x), probes, cosine) if y - x > 1 else None
                if found is not None:
                    yield found
            held = [] if batch is None else table.slice(int(starts[-1])).to_batches()

    return run


def cosine_links(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` of every row of ``vectors`` (``vec_id``, ``embedding``).

    No pair below ``cosine`` is linked; a pair above it is missed if it meets in no table. Null and zero
    vectors and those with null or non-finite components have no links, nor do rows with a null id, whose component is null.
    Vectors of different lengths are not linked. Rows of one id are separate vectors that share their result of component;
    equal rows of one id link with each other.
    """
    number = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), number.alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where("vec_id is not null and embedding is not null").where(fine)
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    hashed = written(classes.mapInArrow(_hashed(tables, probes, width), "rep long, m long, embedding array<double>, own array<long>, near array<long>"))

    own = hashed.select("rep", F.posexplode("own").alias("t", "cell"), F.lit(True).alias("home"))
    near = hashed.select("rep", F.posexplode("near").alias("t", "cell"), F.lit(False).alias("home"))
    entries = own.unionByName(near.withColumn("t", F.floor(F.col("t") / probes).cast("int")))
    sizes = entries.groupBy("t", "cell").agg(F.count("*").alias("size"), F.count_if("home").alias("homes"), F.min("rep").alias("low"), F.max("rep").alias("high"))
    shared = sizes.where("homes > 0 and low != high").select("t", "cell", F.ceil(F.col("size") / block).alias("blocks"))
    dealt = entries.join(shared, ["t", "cell"]).withColumn("side", F.pmod(F.xxhash64("rep"), "blocks"))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("with", others).select("t", "cell", "rep", "home", "side", F.greatest("side", "with").alias("block"), F.least("side", "with").alias("other"))
    full = dealt.join(hashed, "rep").repartition("cell", "block", "other").sortWithinPartitions("cell", "block", "other")
    order = ["t", "cell", "block", "other", "side", "home", "rep", "m", "embedding", "own", "near"]
    found = written(full.select(*order).mapInArrow(_bucket_links(probes, cosine), "rep long, links long, root long"))

    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    tied = components(found.where("rep != root").select("rep", "root"))
    result = hashed.select("rep", "m", "embedding").join(counts, "rep", "left").join(tied, F.col("rep") == F.col("node"), "left")
    result = result.select(F.col("embedding").alias("same"), (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("comp"))
    usable = F.when(F.col("vec_id").isNotNull() & fine, F.col("embedding"))
    final = rows.select("vec_id", usable.alias("embedding")).join(result, F.col("embedding") == F.col("same"), "left")
    component = F.coalesce("comp", "vec_id")
    return final.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op9_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
