"""Alignment of two tokenizers' tokens by the bytes they stand for, and how often each pair of ids meets.

Both sides encode a text to ids; the bytes of the tokens, joined, are the text after one space. Inside a task all is
columnar: lists of ids are flattened with the index of their document, running sums of the tokens' sizes give each token's
end, and a hash join of both sides on (document, end) finds the ends they share, which cut the tokens into groups. A link
is a token of A and a token of B that share bytes.

How many documents hold a pair of ids linked needs the whole corpus. A task gathers documents into blocks of some bytes of
text. A block has one list of its distinct pairs, with the documents of the block that hold each, and its documents name
their pairs by the place in that list. Spark adds the blocks' counts by pair, hands each block the totals of its own list,
and the block's documents sum them up. So what is shuffled by pair is a row per block and pair, not one per document and pair.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from clickloom.llm.words import slices, small_batches
from clickloom.session import written

#: Vocabulary files of the two sides, on every machine.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BPE = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text in a block, which one task holds with its pairs; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes of text whose tokens are worked on at a time, about 100 times as much in arrays; a longer text is a slice of its own.
SLICE_BYTES = 1_000_000

# Fixed value: the word pattern of the byte-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space so long that the matcher of ``WORD_PATTERN`` would recurse too deep; the slower library takes such a text.
LONG_SPACE = re.compile(r"\s{20000}")


@dataclass
class Side:
    """One tokenizer: how it encodes texts that begin with the added space, and the bytes of each id."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: list[bytes]

    @cached_property
    def table(self) -> pa.Array:
        return pa.array(self.pieces, pa.large_binary())

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.array([len(piece) for piece in self.pieces], dtype=np.int64)

    def ids(self, texts: list[str]) -> pa.ListArray:
        return pa.array(self.encode(texts), pa.large_list(pa.int32()))


def _byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next letter after 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [byte for byte in range(256) if byte not in prints]
    return {**{chr(byte): byte for byte in prints}, **{chr(256 + i): byte for i, byte in enumerate(rest)}}


@lru_cache(maxsize=2)
def byte_level(path: str = BYTE_BPE) -> Side:
    """Byte-level pair merging by a vocabulary file. Special tokens are not used: their strings in a text are plain text."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {token["content"]: token["id"] for token in model["added_tokens"]}
    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pieces = [b""] * (1 + max([*ranks.values(), *special.values()]))
    for piece, i in {**{token.encode(): i for token, i in special.items()}, **ranks}.items():
        pieces[i] = piece
    # merges are numbered as the tokens they make, so the ids are the ranks of the merges
    fast = tiktoken.Encoding("byte_level", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow.encode(t, add_special_tokens=False).ids if LONG_SPACE.search(t) else fast.encode_ordinary(t) for t in texts]

    return Side(encode, pieces)


@lru_cache(maxsize=2)
def piece_level(path: str = PIECE_BPE) -> Side:
    """Pieces of a model file; the model puts the space before the text itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    pieces = [bytes([int(name[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", name) else name.replace("▁", " ").encode() for name in names]
    # the texts come with the space in front, which the model adds anew
    return Side(lambda texts: model.encode([t[1:] for t in texts], num_threads=1), pieces)


@dataclass(frozen=True)
class Tokenizers:
    """Where the two vocabularies lie; each worker loads them once."""

    a: str = BYTE_BPE
    b: str = PIECE_BPE

    def sides(self) -> tuple[Side, Side]:
        return byte_level(self.a), piece_level(self.b)


@dataclass
class Aligned:
    """Tokens of several texts. ``first_*`` tells where each text's tokens begin, ``cut_*`` marks the last token of a group."""

    a: np.ndarray
    b: np.ndarray
    first_a: np.ndarray
    first_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of tokens of A and of B that share bytes, every occurrence, by A, then by B."""
        last = np.searchsorted(self.end_b, self.end_a)
        begin = np.zeros(len(last), np.int64)
        begin[1:] = last[:-1] + self.cut_a[:-1]
        count = last - begin + 1
        at = np.repeat(np.arange(len(last)), count)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(count) - count - begin, count)


def _joined(side: Side, ids: pa.Array) -> memoryview:
    buffers = side.table.take(ids).buffers()
    ends = np.frombuffer(buffers[1], np.int64)
    return memoryview(buffers[2] or b"").cast("B")[ends[0] : ends[len(ids)]]


def _encoded(side: Side, texts: list[str]) -> tuple[pa.ListArray, np.ndarray]:
    """Lists of ids, and which texts the tokens' bytes give back."""
    lists = side.ids(texts)
    data, want = _joined(side, pc.list_flatten(lists)), [t.encode() for t in texts]
    if data == b"".join(want):
        sizes = np.add.reduceat(np.append(side.sizes[pc.list_flatten(lists).to_numpy()], 0), lists.offsets.to_numpy()[:-1]) if len(texts) else np.zeros(0, np.int64)
        same = sizes == [len(w) for w in want]
        if same.all():
            return lists, same
    return lists, np.array([b"".join(side.pieces[i] for i in own) == w for own, w in zip(lists.to_pylist(), want)], dtype=bool)


def align(text: pa.Array, sides: tuple[Side, Side]) -> Aligned:
    """Tokens, ends and groups of several texts. A text that is null or empty, or whose tokens' bytes on either side are not a space and the text, has no tokens."""
    used = [i for i, t in enumerate(text.to_pylist()) if t]
    texts = [" " + text[i].as_py() for i in used]
    (of_a, good_a), (of_b, good_b) = _encoded(sides[0], texts), _encoded(sides[1], texts)
    good = good_a & good_b
    if not good.all():
        of_a, of_b, used = of_a.filter(pa.array(good)), of_b.filter(pa.array(good)), [i for i, ok in zip(used, good) if ok]
    flat, first, ends, tables = [], [], [], []
    for side, lists in zip(sides, (of_a, of_b)):
        ids, document = pc.list_flatten(lists), pc.list_parent_indices(lists)
        counts = np.zeros(len(text), np.int64)
        counts[used] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        end = pc.cumulative_sum(pa.array(side.sizes[ids.to_numpy()])).to_numpy()
        # both sides' running sums agree at every text's end, so each is that of the texts before plus the end in its own text
        before = np.concatenate([[0], end])[(np.cumsum(counts) - counts)[used]]
        own = end - before[document.to_numpy()]
        tables.append(pa.table({"document": document, "end": own, f"at_{len(flat)}": np.arange(len(own))}))
        flat.append(ids.to_numpy())
        first.append(np.concatenate([[0], np.cumsum(counts)]))
        ends.append(end)
    shared = tables[0].join(tables[1], ["document", "end"], join_type="inner", use_threads=False)
    cuts = [np.zeros(len(ids), dtype=bool) for ids in flat]
    for i, cut in enumerate(cuts):
        cut[shared.column(f"at_{i}").to_numpy()] = True
    return Aligned(*flat, *first, *cuts, *ends)


# ---- groups as text ---------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _numerals(n: int) -> pa.Array:
    """Each id in decimal, followed by each of three marks."""
    return pa.array([f"{i}{mark}".encode() for i in range(n) for mark in ",|;"], pa.large_binary())


def _group_texts(own: Aligned, ids: int) -> tuple[memoryview, np.ndarray]:
    """The groups of all texts as ``a1,a2|b1;a3|b2,b3;``, and where each text's groups begin."""
    n_a, n_b = len(own.a), len(own.b)
    end_a, end_b = np.flatnonzero(own.cut_a) + 1, np.flatnonzero(own.cut_b) + 1
    group_a, group_b = np.cumsum(own.cut_a) - own.cut_a, np.cumsum(own.cut_b) - own.cut_b
    order = np.empty(n_a + n_b, dtype=np.int64)
    # a group's tokens of A stand before those of B, and both before the next group's
    order[np.arange(n_a) + np.concatenate([[0], end_b])[group_a]] = own.a.astype(np.int64) * 3 + own.cut_a
    order[np.arange(n_b) + end_a[group_b]] = own.b.astype(np.int64) * 3 + 2 * own.cut_b
    buffers = _numerals(ids).take(pa.array(order)).buffers()
    ends = np.frombuffer(buffers[1], np.int64)
    return memoryview(buffers[2] or b""), ends[own.first_a + own.first_b]


def _digests(own: Aligned, ids: int) -> list[str]:
    data, at = _group_texts(own, ids)
    return [hashlib.sha256(data[begin : end - 1]).hexdigest() if end > begin else "" for begin, end in zip(at[:-1].tolist(), at[1:].tolist())]


GROUPS = "struct<a:array<int>,b:array<int>,groups:array<struct<a:int,b:int,bytes:int>>>"


def _aligned_column(tokenizers: Tokenizers) -> Callable[[pa.Array], pa.Array]:
    def part(text: pa.Array) -> pa.Array:
        own = align(text, tokenizers.sides())
        end_a, end_b = np.flatnonzero(own.cut_a) + 1, np.flatnonzero(own.cut_b) + 1
        fields = [np.diff(end_a, prepend=0), np.diff(end_b, prepend=0), np.diff(own.end_a[end_a - 1], prepend=0)]
        each = pa.StructArray.from_arrays([pa.array(f.astype(np.int32)) for f in fields], names=["a", "b", "bytes"])
        lists = [
            pa.ListArray.from_arrays(own.first_a.astype(np.int32), pa.array(own.a)), pa.ListArray.from_arrays(own.first_b.astype(np.int32), pa.array(own.b)),
            pa.ListArray.from_arrays(np.searchsorted(end_a, own.first_a, side="right").astype(np.int32), each),
        ]
        return pa.StructArray.from_arrays(lists, names=["a", "b", "groups"])

    def run(text: pa.Array) -> pa.Array:
        parts = [part(batch.column("text")) for batch in slices(pa.record_batch([text], names=["text"]), "text", SLICE_BYTES)]
        return pa.concat_arrays(parts) if parts else part(text)

    return run


def aligned(text: str = "text", tokenizers: Tokenizers = Tokenizers()) -> Column:
    """A struct of both sides' ids and the ``groups``: how many tokens of A and of B, and how many bytes, each one holds.

    The bytes of a text begin with the added space. Texts without tokens (see :func:`align`) have empty lists.
    """
    return arrow_udf(_aligned_column(tokenizers), GROUPS).asNondeterministic()(F.col(text).cast("string"))


# ---- counts of pairs over the corpus ----------------------------------------------------------

_TOKENS = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _blocks(tokenizers: Tokenizers, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document, and for each block one with the list of its pairs and the documents that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tokenizers.sides()
        ids, width = max(len(s.pieces) for s in sides), len(sides[1].pieces)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[pa.RecordBatch, dict, pa.Table]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text", min(SLICE_BYTES, block_bytes)):
                own = align(part.column("text"), sides)
                at_a, at_b = own.links()
                document = np.searchsorted(own.first_a, np.arange(len(own.a)), side="right")[at_a] - 1
                pair = own.a[at_a].astype(np.int64) * width + own.b[at_b]
                links = pa.table({"document": document.astype(np.int32), "pair": pair})
                counted = links.group_by(["document", "pair"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                cut = np.concatenate([[0], np.cumsum(own.cut_a)])
                whole = {
                    "n_a": np.diff(own.first_a), "n_b": np.diff(own.first_b), "n_groups": np.diff(cut[own.first_a]),
                    "n_links": np.bincount(document, minlength=part.num_rows), "groups_sha256": _digests(own, ids),
                }
                held.append((part.drop_columns(["text"]), whole, counted))
                size += part.column("text").nbytes
                if size >= block_bytes:
                    yield from _block_rows(held, number)
                    held, size, number = [], 0, number + 1
        if held:
            yield from _block_rows(held, number)

    return run


def _block_rows(held: list[tuple[pa.RecordBatch, dict, pa.Table]], number: int) -> Iterator[pa.RecordBatch]:
    pairs = pa.concat_arrays([counted.column("pair").combine_chunks() for _, _, counted in held]).dictionary_encode()
    slots = pairs.indices
    documents = pa.table({"slot": slots}).group_by("slot", use_threads=False).aggregate([([], "count_all")]).sort_by("slot")
    none = pa.nulls(1, pa.list_(pa.int64()))
    begin = 0
    for rows, whole, counted in held:
        n, length = rows.num_rows, len(counted)
        document = counted.column("document").to_numpy()
        order = None if np.all(document[1:] >= document[:-1]) else np.argsort(document, kind="stable")
        own, times = slots.slice(begin, length), counted.column("count_all").combine_chunks().cast(pa.int32())
        if order is not None:
            own, times, document = own.take(pa.array(order)), times.take(pa.array(order)), document[order]
        ends = np.searchsorted(document, np.arange(n + 1)).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.array(np.full(n, number)), **{name: rows.column(name) for name in rows.schema.names}, **{name: pa.array(whole[name]) for name in _TOKENS},
                "slots": pa.ListArray.from_arrays(ends, own), "times": pa.ListArray.from_arrays(ends, times),
                "pairs": none.take(pa.array(np.zeros(n, np.int32))), "documents": none.take(pa.array(np.zeros(n, np.int32))),
            }
        )
        begin += length
    rows = held[0][0]
    one = np.zeros(1, np.int32)
    count = len(pairs.dictionary)
    yield pa.RecordBatch.from_pydict(
        {
            "block": pa.array([number]), **{field.name: pa.nulls(1, field.type) for field in rows.schema}, **{name: pa.nulls(1, pa.string() if name == _TOKENS[-1] else pa.int64()) for name in _TOKENS},
            "slots": pa.nulls(1, pa.list_(pa.int32())), "times": pa.nulls(1, pa.list_(pa.int32())),
            "pairs": pa.ListArray.from_arrays(np.append(one, count).astype(np.int32), pairs.dictionary),
            "documents": pa.ListArray.from_arrays(np.append(one, count).astype(np.int32), documents.column("count_all").combine_chunks()),
        }
    )


def _summed(names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Sums over each document's links, from the totals that its block's slots have."""

    def run(documents: pa.Table, totals: pa.Table) -> pa.Table:
        slot = totals.column("slot").to_numpy()
        count, best = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
        count[slot], best[slot] = totals.column("documents").to_numpy(), totals.column("is_best").to_numpy()
        documents = documents.combine_chunks()
        lists = documents.column("slots").combine_chunks()
        slots = pc.list_flatten(lists).to_numpy()
        times = pc.list_flatten(documents.column("times").combine_chunks()).to_numpy()
        owner = pc.list_parent_indices(lists).to_numpy()
        sums = {}
        for name, value in (("n_best", best), ("count_sum", count)):
            running = np.concatenate([[0], np.cumsum(value[slots] * times)])
            sums[name] = pa.array(np.diff(running[np.searchsorted(owner, np.arange(len(documents) + 1))]))
        return pa.table({**{name: documents.column(name) for name in names}, **sums})

    return run


@dataclass(frozen=True)
class Counted:
    """``blocks``: the written rows of documents and blocks; ``pairs``: a_id, b_id, pair, documents and is_best for each pair of ids."""

    blocks: DataFrame
    pairs: DataFrame
    names: list[str]

    def documents(self) -> DataFrame:
        """A row for each document, with its counts and the sums over its links."""
        slots = self.blocks.where("pairs IS NOT NULL").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("slot", "pair"))
        totals = slots.join(self.pairs.select("pair", "documents", F.col("is_best").cast("int").alias("is_best")), "pair").drop("pair")
        own = self.blocks.where("pairs IS NULL").select("block", *self.names, *_TOKENS, "slots", "times")
        kept = [*self.names, *_TOKENS]
        schema = T.StructType([own.schema[name] for name in kept] + [T.StructField(name, T.LongType()) for name in ("n_best", "count_sum")])
        return own.groupBy("block").cogroup(totals.groupBy("of_block")).applyInArrow(_summed(kept), schema)


def counted_pairs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizers: Tokenizers = Tokenizers(), block_bytes: int = BLOCK_BYTES) -> Counted:
    """Align every text of ``docs`` and count, for each linked pair of ids, the documents that hold it.

    A row is a document, also where ids or texts are repeated or null. ``keep`` names columns to carry along.
    """
    width = len(tokenizers.sides()[1].pieces)
    names = [f"own_{i}" for i in range(len(keep))]
    read = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [T.StructField("block", T.LongType()), *[T.StructField(n, read.schema[n].dataType) for n in names]]
        + [T.StructField(n, T.StringType() if n == _TOKENS[-1] else T.LongType()) for n in _TOKENS]
        + [T.StructField(n, T.ArrayType(T.IntegerType() if n in ("slots", "times") else T.LongType())) for n in ("slots", "times", "pairs", "documents")]
    )
    blocks = written(read.mapInArrow(_blocks(tokenizers, block_bytes), schema))
    lists = blocks.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "documents")))
    counted = written(
        lists.groupBy(F.col("pairs").alias("pair")).agg(F.sum("documents").alias("documents")).withColumn("a_id", F.expr(f"pair div {width}"))
    )
    # a row for each id of A at most
    highest = counted.groupBy("a_id").agg(F.max("documents").alias("highest"))
    pairs = counted.join(F.broadcast(highest), "a_id").select(
        "a_id", (F.col("pair") % width).alias("b_id"), "pair", "documents", (F.col("documents") == F.col("highest")).alias("is_best")
    )
    return Counted(blocks, pairs, names)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and pair counts of every text of ``documents``, one row per row.

    Repeated rows and ids are documents of their own. Null and empty texts, and texts that a side does not give back, have
    zeros and an empty digest. Of an empty table the result is empty.
    """
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = counted_pairs(docs)
    return counted.documents().select(F.col(counted.names[0]).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
