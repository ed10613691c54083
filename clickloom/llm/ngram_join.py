"""Similarity join on word shingles: trees of group counts propose pairs, exact set overlap decides.

The distinct shingles of a text are hashed into groups. The counts per group are a point, and the sum
of the coordinate minima of two points bounds the overlap of their sets from above.

1. One pass gives every text its set size, a signature of the set (equal sets become one class) and its
   point, and counts in how many texts each shingle occurs, by cells of hashes.
2. Two linked sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, in any fixed order;
   rarest first keeps common lines out. Texts meet in the bucket of such a shingle. A bucket that the
   counts show to be large is dealt out over pairs of blocks.
3. In each bucket the texts of about one size are first compared with one of them, the first by a hash of the
   id. This ties groups of copies together with few pairs.
4. Buckets that still hold more than one component get a tree over their points. It is joined with
   itself; pairs of nodes of one component, or whose bound is too low, are cut off. What is left is verified.

No link between different components is lost, and pairs inside a component are not enumerated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from clickloom.llm.graph import components
from clickloom.llm.words import mixed, shingle_sets, slices, words_of
from clickloom.session import written

SHINGLE = 5
GROUPS = 256
#: Cells of hashes in which occurrences of shingles are counted; only the order of shingles depends on them.
CELLS = 1 << 18
#: A bucket counted to hold more texts than this is dealt out over pairs of blocks of about this size.
BLOCK = 50_000
#: Bits of the filter that says which texts' sets must be fetched; full, it fetches more than needed.
FILTER_BITS = 1 << 22
LEAF = 32

#: 100 * overlap >= 80 * union, as overlap against the sum of the sizes.
OVERLAP, SIZES = 9, 4


def _described(shingle: int, cells: int) -> Callable:
    """Size, signature and point of each set; at the end of a partition, its counts of cells as one row.

    A point is one byte per group, the count in units rounded up, so that bounds stay bounds. The unit is 1
    unless a group holds more than 255 shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, dtype=np.int64)
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("point", pa.binary()), ("unit", pa.int64()), ("seen", pa.list_(pa.int32()))]
        )
        for batch in batches:
            for part in slices(batch, "text"):
                n, s1, s2, points, units, all_cells = [], [], [], [], [], []
                for own in shingle_sets(words_of(part.column("text")), shingle):
                    n.append(len(own))
                    s1.append(int(np.sum(own, dtype=np.uint64).view(np.int64)))
                    s2.append(int(np.sum(mixed(own), dtype=np.uint64).view(np.int64)))
                    count = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
                    units.append(max(1, -(-int(count.max()) // 255)))
                    points.append((-(-count // units[-1])).astype(np.uint8).tobytes())
                    all_cells.append((own % np.uint64(cells)).astype(np.int64))
                seen += np.bincount(np.concatenate(all_cells), minlength=cells)
                yield pa.record_batch([part.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2), pa.array(points, pa.binary()), pa.array(units), pa.nulls(len(n), schema.field("seen").type)], schema=schema)
        if seen.any():
            none = [pa.nulls(1, f.type) for f in schema][:-1]
            yield pa.record_batch([*none, pa.array([seen.astype(np.int32)], schema.field("seen").type)], schema=schema)

    return run


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def _entries(shingle: int, cells: int, block: int, counts) -> Callable:
    """The bucket of each of the rarest shingles of a text; one text of each set per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts.value
        usual = int(np.median(seen))
        met: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                out: list[tuple] = []
                for doc, own in zip(part.column("doc_id").to_pylist(), shingle_sets(words_of(part.column("text")), shingle)):
                    if doc is None or not len(own):
                        continue
                    signature = (int(np.sum(own, dtype=np.uint64)), int(np.sum(mixed(own), dtype=np.uint64)))
                    if signature in met:
                        continue
                    met.add(signature)
                    often = seen[(own % np.uint64(cells)).astype(np.int64)]
                    first = np.lexsort((own, often))[: prefix_length(len(own))]
                    blocks = np.maximum(1, -((usual - often[first]) // block))
                    token, dealt, place = own[first], np.zeros(len(first), dtype=np.int64), np.arange(len(first))
                    if blocks.max() > 1:
                        token, dealt = _over_blocks(token, blocks, doc)
                        place = np.repeat(place, blocks)
                    out.append((token, dealt, np.full(len(token), doc), np.full(len(token), len(own)), place))
                if out:
                    token, dealt, docs, sizes, places = (np.concatenate(x) for x in zip(*out))
                    yield pa.record_batch([pa.array(token.view(np.int64)), pa.array(dealt), pa.array(docs), pa.array((sizes << 32) | places)], names=["token", "block", "doc_id", "n_at"])

    return run


def _over_blocks(token: np.ndarray, blocks: np.ndarray, doc: int) -> tuple[np.ndarray, np.ndarray]:
    """A text in block b of k goes to the pairs (b, 0) .. (b, k - 1), so that any two texts meet in one."""
    tokens, dealt = [], []
    for t, k in zip(token, blocks.tolist()):
        b = int(mixed(np.array([doc ^ 0x2545F491], dtype=np.int64).view(np.uint64))[0]) % k
        for other in range(k):
            tokens.append(t)
            dealt.append(max(b, other) * (max(b, other) + 1) // 2 + min(b, other))
    return np.array(tokens, dtype=np.uint64), np.array(dealt, dtype=np.int64)


def _sets(shingle: int, bits: int, wanted) -> Callable:
    """The whole sets of the texts that the filter names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc_id").fill_null(0).to_numpy()
            bit = (mixed(docs.view(np.uint64)) % np.uint64(bits)).astype(np.int64)
            hit = (wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
            named = batch.filter(pa.array(hit.astype(bool) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            for part in slices(named, "text"):
                own = list(shingle_sets(words_of(part.column("text")), shingle))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                sets = pa.ListArray.from_arrays(ends, np.concatenate(own).view(np.int64))
                yield pa.record_batch([part.column("doc_id"), sets], names=["doc_id", "shingles"])

    return run


def _hit_bits(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.unique(mixed(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(bits))
            yield pa.record_batch([pa.array(bit.astype(np.int64))], names=["bit"])

    return run


class Tree:
    """Points packed into boxes of boxes, with the smallest size, the only component (-1: several) and the most that is left of each.

    A linked pair meets in the bucket of its first common shingle, where the overlap is at most what is left of each set
    from there on; so pairs may be cut off by that in every bucket.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray, left: np.ndarray):
        spread = np.argsort(-points.var(axis=0), kind="stable")[:2]
        self.order = np.lexsort((*points[:, spread].T, comps, sizes // np.maximum(1, sizes.max() // 64)))
        points, sizes, comps, left = points[self.order], sizes[self.order], comps[self.order], left[self.order]
        self.levels = [(points, sizes, comps, left)]
        while len(self.levels[-1][1]) > 1:
            points, sizes, comps, left = self.levels[-1]
            at = np.arange(0, len(sizes), LEAF)
            low = np.minimum.reduceat(comps, at)
            self.levels.append((np.maximum.reduceat(points, at), np.minimum.reduceat(sizes, at), np.where(low == np.maximum.reduceat(comps, at), low, -1), np.maximum.reduceat(left, at)))

    def joined(self, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components whose bound allows a link; at most ``most`` pairs of nodes are open at once."""
        top = len(self.levels) - 1
        work = [(top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while work:
            level, a, b = work.pop()
            points, sizes, comps, left = self.levels[level]
            keep = ((comps[a] != comps[b]) | (comps[a] < 0)) & ((a != b) | (level > 0))
            a, b = a[keep], b[keep]
            keep = OVERLAP * np.minimum(left[a], left[b]) >= SIZES * (sizes[a] + sizes[b])
            a, b = a[keep], b[keep]
            bound = np.minimum(points[a], points[b]).sum(axis=1)
            keep = OVERLAP * bound >= SIZES * (sizes[a] + sizes[b])
            a, b = a[keep], b[keep]
            if level == 0:
                if len(a):
                    yield self.order[a], self.order[b]
                continue
            below = len(self.levels[level - 1][1])
            for at in range(0, len(a), max(1, most // LEAF**2)):
                x, y = a[at : at + max(1, most // LEAF**2)], b[at : at + max(1, most // LEAF**2)]
                step = np.arange(LEAF)
                x = (x[:, None, None] * LEAF + step[None, :, None] + np.zeros((1, 1, LEAF), np.int64)).ravel()
                y = (y[:, None, None] * LEAF + step[None, None, :] + np.zeros((1, LEAF, 1), np.int64)).ravel()
                keep = (x < below) & (y < below) & (x <= y)
                work.append((level - 1, x[keep], y[keep]))


def _points(point: pa.Array, unit: pa.Array) -> np.ndarray:
    joined = b"".join(point.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, GROUPS).astype(np.int32) * unit.to_numpy()[:, None].astype(np.int32)


def _pairs_of(table: pa.RecordBatch | pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Surviving pairs of several whole buckets. Those that fit one leaf are joined together, by distance in the row order."""
    if isinstance(table, pa.Table):
        table = table.combine_chunks().to_batches()[0]
    ids, sizes, comps, at = (table.column(c).to_numpy() for c in ("rep", "n", "comp", "at"))
    left = sizes - at
    ends = np.append(starts[1:], table.num_rows)
    # at most this many points are spread out at a time
    for low in range(0, len(starts), 256):
        high = min(low + 256, len(starts))
        first, last = starts[low], ends[high - 1]
        some = table.slice(first, last - first)
        points = _points(some.column("point"), some.column("unit"))
        own_sizes, own_comps, own_ids, own_left = sizes[first:last], comps[first:last], ids[first:last], left[first:last]
        length = ends[low:high] - starts[low:high]
        bucket = np.repeat(np.arange(high - low), length)
        small = (length <= LEAF)[bucket]
        for step in range(1, LEAF):
            a = np.arange(len(own_ids) - step) if len(own_ids) > step else np.zeros(0, np.int64)
            a = a[small[a] & (bucket[a] == bucket[a + step]) & (own_comps[a] != own_comps[a + step])]
            a = a[OVERLAP * np.minimum(own_left[a], own_left[a + step]) >= SIZES * (own_sizes[a] + own_sizes[a + step])]
            if not len(a):
                continue
            bound = np.minimum(points[a], points[a + step]).sum(axis=1)
            a = a[OVERLAP * bound >= SIZES * (own_sizes[a] + own_sizes[a + step])]
            yield own_ids[a], own_ids[a + step]
        for k in np.flatnonzero(length > LEAF):
            x, y = starts[low + k] - first, ends[low + k] - first
            tree = Tree(points[x:y], own_sizes[x:y], np.unique(own_comps[x:y], return_inverse=True)[1], own_left[x:y])
            for a, b in tree.joined():
                yield own_ids[x:y][a], own_ids[x:y][b]


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets arrive one after the other, so no more than a batch and one bucket are in memory."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None and batch.num_rows == 0:
            continue
        if batch is not None:
            held.append(batch)
            newest = np.stack([batch.column("token").to_numpy(), batch.column("block").to_numpy()])
            if len(held) > 1 and (newest[:, -1] == [held[0].column("token")[-1].as_py(), held[0].column("block")[-1].as_py()]).all():
                continue
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        keys = np.stack([table.column("token").to_numpy(), table.column("block").to_numpy()])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        # the last bucket may go on in the next batch
        cut = table.num_rows if batch is None else int(starts[-1])
        held = table.slice(cut).combine_chunks().to_batches() if cut < table.num_rows else []
        if cut:
            found = [np.stack([np.minimum(a, b), np.maximum(a, b)]) for a, b in _pairs_of(table.slice(0, cut), starts[starts < cut]) if len(a)]
            if found:
                low, high = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.record_batch([pa.array(low), pa.array(high)], names=["a", "b"])


def _may_be_first(x: str, y: str):
    """Whether a pair whose first common shingle stands at these places can still overlap enough: what is left of both sets bounds it."""
    n = lambda c: F.shiftright(c, 32)
    left = lambda c: n(c) - F.shiftrightunsigned(F.shiftleft(c, 32), 32)
    return OVERLAP * F.least(left(x), left(y)) >= SIZES * (n(x) + n(y))


def _within_bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared = np.minimum(_points(batch.column("pa"), batch.column("ua")), _points(batch.column("pb"), batch.column("ub"))).sum(axis=1)
        n = batch.column("n").to_numpy()
        yield batch.select(["a", "b", "n"]).filter(pa.array(OVERLAP * shared >= SIZES * n))


def _bounded(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of classes, once each, whose points allow a link."""
    side = lambda name: reps.select(F.col("doc_id").alias(name), F.col("rep").alias(f"r{name}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where("ra != rb")
    pairs = pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    point = lambda name: reps.where("doc_id = rep").select(F.col("rep").alias(name), F.col("n").alias(f"n{name}"), F.col("point").alias(f"p{name}"), F.col("unit").alias(f"u{name}"))
    pairs = pairs.join(point("a"), "a").join(point("b"), "b").withColumn("n", F.col("na") + F.col("nb"))
    return pairs.select("a", "b", "n", "pa", "ua", "pb", "ub").mapInArrow(_within_bound, "a long, b long, n long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A filter of ids: FILTER_BITS bits, whatever their number."""
    bits = ids.mapInArrow(_hit_bits(FILTER_BITS), "bit long").distinct().toArrow()["bit"].to_numpy()
    bitmap = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    np.bitwise_or.at(bitmap, bits >> 3, (1 << (bits & 7)).astype(np.uint8))
    return bitmap


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose ``doc_id`` is one of ``ids`` (one column of longs). Only rows that a filter of the ids lets through are shuffled."""
    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(_bitmap(ids))

    def named(doc: pa.Array) -> pa.Array:
        bit = (mixed(doc.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) % np.uint64(FILTER_BITS)).astype(np.int64)
        return pa.array(((wanted.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(bool))

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = rows.withColumn("named", arrow_udf(named, "boolean").asNondeterministic()("id"))
    left = rows.where("named").join(ids.toDF("id"), "id", "left_anti")
    return rows.where("not named").select("row.*").unionByName(left.select("row.*"))


def _verified(spark: SparkSession, texts: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The pairs whose sets overlap enough. Sets are computed anew from the texts of the pairs' classes only."""
    pairs = written(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = spark.sparkContext.broadcast(_bitmap(ids))
    sets = texts.mapInArrow(_sets(shingle, FILTER_BITS, wanted), "doc_id long, shingles array<long>")
    sets = written(sets.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return both.where(OVERLAP * F.size(F.array_intersect("left", "right")) >= SIZES * F.col("n")).select("a", "b")


def _ids_of_several_sets(rows: DataFrame) -> DataFrame:
    """The ids whose rows differ in their sets."""
    ends = [end(c).alias(f"{name}_{c}") for c in ("n", "s1", "s2") for name, end in (("low", F.min), ("high", F.max))]
    by_id = rows.where("doc_id is not null").groupBy("doc_id").agg(*ends)
    return by_id.where("low_n <> high_n or low_s1 <> high_s1 or low_s2 <> high_s2").select("doc_id")


def _by_texts(texts: DataFrame, several: DataFrame, shingle: int, cells: int, block: int) -> DataFrame:
    """Components where an id may have several texts: each of these is a node of its own, tied to its id.

    Such a node's number is above all ids, so that no component is named by it. It is made of a hash of id and text; two
    nodes of one number, which m nodes have with a chance of about m * m / 2^62, would count as one.
    """
    several = written(several)
    top = texts.agg(F.max("doc_id")).first()[0]
    free = (1 << 63) - 2 - top
    # texts of the given ids only; a null text is an empty one
    node = F.lit(top + 1) + F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(free))
    marked = written(texts.join(several.withColumn("split", F.lit(True)), "doc_id", "left").withColumn("node", F.when(F.col("split"), node).otherwise(F.col("doc_id"))))
    own = written(jaccard_components(marked.select(F.col("node").alias("doc_id"), "text"), shingle, cells, block).withColumnRenamed("doc_id", "node"))
    ties = marked.where("split").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct()
    links = own.where("node is not null and node != component_id").select(F.col("component_id").alias("a"), F.col("node").alias("b")).distinct()
    final = components(written(links.unionByName(ties)))
    # a node has one text, so its repeated rows agree
    sizes = own.where("node is not null").select("node", "n_shingles").distinct()
    known = marked.select("doc_id", "node").join(sizes, "node").drop("node")
    known = known.join(final, F.col("doc_id") == F.col("node"), "left")
    nameless = own.where("node is null").select(F.col("node").alias("doc_id"), "n_shingles", F.col("component_id"))
    return known.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).unionByName(nameless)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row of ``docs`` (``doc_id``, ``text``).

    The component is the smallest id reached by links of similarity 0.8 or more, the row's own included.
    Null and empty texts have no shingles and no links. A null id takes no part: its component is null.
    Repeated rows stay, each with the same result; if texts of one id differ, the id is one node with the links of each.
    Extra columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    described = written(texts.mapInArrow(_described(shingle, cells), "doc_id long, n long, s1 long, s2 long, point binary, unit long, seen array<int>"))
    # one row per cell, a fixed number
    seen = described.where("seen is not null").select(F.posexplode("seen").alias("cell", "k")).groupBy("cell").agg(F.sum("k").alias("k")).toArrow()
    cell, times = seen["cell"].to_numpy(), seen["k"].to_numpy()
    counts = np.zeros(cells, dtype=np.int64 if times.max(initial=0) >= 1 << 31 else np.int32)
    counts[cell] = times
    rows = described.where("seen is null").drop("seen")
    several = _ids_of_several_sets(rows)
    if not several.isEmpty():
        return _by_texts(texts, several, shingle, cells, block)

    has_links = rows.where("n > 0 and doc_id is not null")
    classes = has_links.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    reps = written(has_links.join(classes, ["n", "s1", "s2"]).select("doc_id", "rep", "n", "point", "unit").distinct())

    # size and place in the prefix share a number, as there are very many of these rows
    found = texts.mapInArrow(_entries(shingle, cells, block, spark.sparkContext.broadcast(counts)), "token long, block long, doc_id long, n_at long")
    # texts of one size class, a power of 1.25, may be linked; classes and ids give every bucket the same order
    kind = F.floor(F.log(F.shiftright("n_at", 32).cast("double")) / math.log(1.25))
    whole = Window.partitionBy("token", "block").orderBy("kind", "doc_id")
    alike = Window.partitionBy("token", "block", "kind").orderBy("doc_id")
    met = found.withColumn("kind", kind).withColumns(
        {"before": F.lag("doc_id").over(whole), "after": F.lead("doc_id").over(whole), "leader": F.first("doc_id").over(alike), "leader_at": F.first("n_at").over(alike)}
    )
    met = written(met.where("before is not null or after is not null").select("token", "block", "doc_id", "n_at", "leader", "leader_at"))

    near = met.where("leader != doc_id").where(_may_be_first("n_at", "leader_at")).select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    same = reps.where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = written(_verified(spark, texts, _bounded(near, reps), shingle).unionByName(same))
    found_so_far = components(links)

    labelled = reps.join(found_so_far, F.col("rep") == F.col("node"), "left").select("doc_id", "rep", "n", "point", "unit", F.coalesce("component", "rep").alias("comp"))
    bucket = Window.partitionBy("token", "block")
    in_bucket = met.select("token", "block", "doc_id", "n_at").join(labelled.select("doc_id", "rep", "comp"), "doc_id")
    spread = in_bucket.withColumns({"low": F.min("comp").over(bucket), "high": F.max("comp").over(bucket)}).where("low != high")
    open_rows = spread.select("token", "block", "rep", F.shiftrightunsigned(F.shiftleft("n_at", 32), 32).alias("at")).distinct()
    points = labelled.where("doc_id = rep").select("rep", "n", "comp", "point", "unit")
    open_rows = written(open_rows.join(points, "rep").select("token", "block", "rep", "at", "n", "comp", "point", "unit"))
    dealt = open_rows.repartition("token", "block").sortWithinPartitions("token", "block")
    left_over = dealt.mapInArrow(_tree_pairs, "a long, b long").distinct()
    more = _verified(spark, texts, _bounded(left_over, reps), shingle)
    final = components(written(links.unionByName(more)))

    known = rows.join(final, F.col("doc_id") == F.col("node"), "left")
    return known.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each group of linked texts, one row of each id; rows with a null id stay."""
    groups = written(jaccard_components(docs))
    kept = without_ids(docs, groups.where("component_id != doc_id").select("doc_id").distinct())
    repeated = written(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi")
    order = Window.partitionBy("id").orderBy(F.col("row.text"))
    rows = again.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id")).withColumn("_turn", F.row_number().over(order))
    return without_ids(kept, repeated).unionByName(rows.where("_turn = 1").select("row.*"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(node, seen) AS (SELECT a, a FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.seen),
low AS (SELECT node, min(seen) AS low FROM reach GROUP BY node)
SELECT s.doc_id AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.low, s.doc_id)) AS component_id
FROM sets s LEFT JOIN low l ON l.node = s.doc_id
"""
