"""SentencePiece encoding and decoding: the best sequence of pieces by the sum of their log scores.

Spaces become the marker U+2581 and one is put in front of the text. Pieces are matched by a
double-array trie over UTF-8 bytes, from all positions of all distinct words of a slice at once, and the
Viterbi recurrence runs over the positions of these words side by side. A character without a piece costs
ten less than the worst piece and is written as byte pieces.

No piece holds a marker after another character, so the best path of a text is made of the best
paths of its words (a run of markers and what follows it); this is checked when a model is loaded.
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

from clickloom.llm.words import _power, mixed, numbered, slices, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN_COST = 10.0
#: Words of more bytes are encoded one by one.
LONG_WORD = 64

_MARK = np.frombuffer(MARKER.encode(), dtype=np.uint8)
_BYTE = numbered(256, 23)
_BASE = np.uint64(0x5851F42D4C957F2D)
_UNBASE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


@dataclass
class Pieces:
    """A vocabulary: the trie (``base``, ``check``, ``value``: the piece that ends at a node or -1), scores, and what decoding needs."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    scores: np.ndarray
    unknown: int
    byte_ids: np.ndarray
    lone: np.ndarray
    spelled: list[bytes]


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A child of node s by byte c is node base[s] + c, if check of that node is s. Node 0 is the root."""
    root: dict = {}
    for word, number in words.items():
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[-1] = number
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = bytearray(size)
    used[0] = 1
    free, todo = 1, [(root, 0)]
    for node, at in todo:
        value[at] = node.get(-1, -1)
        children = sorted(c for c in node if c >= 0)
        if not children:
            continue
        while used[free]:
            free += 1
        place = max(1, free - children[0])
        while True:
            if place + 256 >= len(used):
                more = len(used)
                used += bytes(more)
                base, check, value = np.append(base, np.zeros(more, np.int32)), np.append(check, np.full(more, -1, np.int32)), np.append(value, np.full(more, -1, np.int32))
            if not any(used[place + c] for c in children):
                break
            place = max(place + 1, used.find(0, place + children[0] + 1) - children[0])
        base[at] = place
        for c in children:
            used[place + c] = 1
            check[place + c] = at
            todo.append((node[c], place + c))
    return base, check, value


def pieces_from(names: list[str], scores: list[float], kinds: list[str], unknown: int) -> Pieces:
    """``kinds``: normal, byte or other; only normal pieces are matched. Raises ValueError for a marker inside a piece."""
    normal = [i for i, kind in enumerate(kinds) if kind == "normal"]
    if any(MARKER in names[i].lstrip(MARKER) for i in normal):
        raise ValueError("a piece spans several words")
    byte_ids = np.full(256, unknown, dtype=np.int32)
    spelled = [b""] * len(names)
    for i, kind in enumerate(kinds):
        if kind == "byte":
            byte_ids[int(names[i][3:5], 16)] = i
            spelled[i] = bytes([int(names[i][3:5], 16)])
        elif kind == "normal":
            spelled[i] = names[i].encode()
    scores = np.array(scores, dtype=np.float64)
    if len(normal) and scores[normal].min() < -1000:
        # a vocabulary whose scores are ranks; the log score of a rank by Zipf's law
        scores[normal] = -np.log1p(np.argsort(np.argsort(-scores[normal], kind="stable"), kind="stable"))
    lone = np.zeros(256, dtype=bool)
    lone[:128] = True
    for i in normal:
        if len(names[i]) > 1:
            lone[np.frombuffer(names[i].encode(), dtype=np.uint8)] = False
    # the unknown's score is the last of all
    scores = np.append(scores, (scores[normal].min() if normal else 0.0) - UNKNOWN_COST)
    return Pieces(*double_array({names[i].encode(): i for i in normal}), scores, unknown, byte_ids, lone, spelled)


def load(path: str = MODEL) -> Pieces:
    """Read a model file on the driver; tasks get the arrays, whose size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kind = lambda i: "byte" if model.is_byte(i) else "other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal"
    return pieces_from([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], [kind(i) for i in ids], model.unk_id())


def marked(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with markers for spaces and in front of each text that is not empty."""
    space = data == 0x20
    width = np.where(space, 3, 1)
    full = np.flatnonzero(at[1:] > at[:-1])
    width[at[full]] += 3
    ends = np.cumsum(width)
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    out[ends[~space] - 1] = data[~space]
    first = np.zeros(len(data), dtype=bool)
    first[at[full]] = True
    for k in range(3):
        out[ends[space] - 3 + k] = _MARK[k]
        out[(ends - width)[first] + k] = _MARK[k]
    return out, np.append(0, ends)[at]


def word_starts(data: np.ndarray, at: np.ndarray, lone: np.ndarray) -> np.ndarray:
    """Where words begin: at a marker after another character, and around bytes that only stand alone."""
    mark = np.zeros(len(data) + 3, dtype=bool)
    mark[3 : len(data) + 1] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2]) if len(data) > 2 else False
    begin = mark[3:] & ~mark[:-3]
    alone = lone[data]
    begin |= alone
    begin[1:] |= alone[:-1]
    begin[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begin)


def edges(data: np.ndarray, ends_of: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (start, end, piece) inside words; ``ends_of`` is the end of each byte's word. A lone character gets the unknown, -1."""
    head = (data & 0xC0) != 0x80
    start = np.flatnonzero(head)
    length = np.diff(np.append(start, len(data)))
    single = np.zeros(len(data), dtype=bool)
    begins, ends, ids = [], [], []
    node, live, depth = np.zeros(len(start), dtype=np.int64), start, 0
    while len(live):
        at = live + depth
        inside = at < ends_of[live]
        live, node, at = live[inside], node[inside], at[inside]
        child = pieces.base[node] + data[at].astype(np.int64)
        found = (pieces.check[child] == node) & (child > 0)
        live, node = live[found], child[found]
        depth += 1
        value = pieces.value[node]
        hit = value >= 0
        begins.append(live[hit])
        ends.append(live[hit] + depth)
        ids.append(value[hit])
    begin, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, ids))
    sizes = np.zeros(len(data) + 1, dtype=np.int64)
    sizes[start] = length
    single[begin[end - begin == sizes[begin]]] = True
    lost = start[~single[start]]
    return np.concatenate([begin, lost]), np.concatenate([end, lost + sizes[lost]]), np.concatenate([piece, np.full(len(lost), -1)])


def best_paths(data: np.ndarray, first: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best path of each word (``data[first[i]:first[i + 1]]``), and how many each has. Ties take the longer last piece."""
    lengths = np.diff(first)
    begin, end, piece = edges(data, np.repeat(first[1:], lengths), pieces)
    word = np.searchsorted(first, begin, side="right") - 1
    step = end - first[word]
    order = np.lexsort((begin, end, step))
    begin, end, piece, step = begin[order], end[order], piece[order], step[order]
    score = pieces.scores[piece]
    best, how = np.full(len(data) + 1, -np.inf), np.full(len(data) + 1, -1)
    origin = np.zeros(len(data) + 1)
    is_first = np.zeros(len(data) + 1, dtype=bool)
    is_first[first[:-1]] = True
    bounds = np.flatnonzero(np.append(True, step[1:] != step[:-1])) if len(step) else np.zeros(0, np.int64)
    for low, high in zip(bounds, np.append(bounds[1:], len(step))):
        b, e = begin[low:high], end[low:high]
        total = np.where(is_first[b], origin[b], best[b]) + score[low:high]
        groups = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
        top = np.maximum.reduceat(total, groups)
        size = np.diff(np.append(groups, len(e)))
        winner = np.minimum.reduceat(np.where(total == np.repeat(top, size), np.arange(low, high), high), groups)
        best[e[groups]], how[e[groups]] = top, winner
    steps, at, live = [], first[1:].copy(), np.arange(len(lengths))
    while len(live):
        edge = how[at[live]]
        steps.append((live, edge))
        at[live] = begin[edge]
        live = live[at[live] > first[live]]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    words, taken = (np.concatenate(x) for x in zip(*steps))
    back = np.concatenate([np.full(len(x[0]), -k) for k, x in enumerate(steps)])
    order = np.lexsort((back, words))
    words, taken = words[order], taken[order]
    many = np.where(piece[taken] >= 0, 1, end[taken] - begin[taken])
    flat = np.repeat(taken, many)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many)
    ids = np.where(piece[flat] >= 0, piece[flat], pieces.byte_ids[data[np.minimum(begin[flat] + within, len(data) - 1)]])
    return ids.astype(np.int32), np.bincount(words, weights=many, minlength=len(lengths)).astype(np.int64)


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The parts ``flat[first[i]:first[i] + size[i]]`` in a row."""
    ends = np.cumsum(size)
    return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def encode(text: pa.Array, pieces: Pieces) -> pa.ListArray:
    """Ids of the best path of each whole text; a null or empty text has none."""
    data, at = marked(*text_bytes(text))
    starts = word_starts(data, at, pieces.lone)
    sizes = np.diff(np.append(starts, len(data)))
    sums = np.append(np.uint64(0), np.cumsum(_BYTE[data] * _power(len(data), "up", _BASE)))
    keys = mixed((sums[starts + sizes] - sums[starts]) * _power(len(data) + 1, "down", _UNBASE)[starts]) + sizes.astype(np.uint64)
    _, some, which = np.unique(keys, return_index=True, return_inverse=True)
    counts, place = np.zeros(len(some), dtype=np.int64), np.zeros(len(some), dtype=np.int64)
    parts, total = [np.zeros(0, np.int32)], 0
    short = sizes[some] <= LONG_WORD
    for chosen in ([np.flatnonzero(short)] if short.any() else []) + [np.array([k]) for k in np.flatnonzero(~short)]:
        own = _gather(data, starts[some[chosen]], sizes[some[chosen]])
        found, counts[chosen] = best_paths(own, np.append(0, np.cumsum(sizes[some[chosen]])), pieces)
        place[chosen] = total + np.cumsum(counts[chosen]) - counts[chosen]
        parts.append(found)
        total += len(found)
    ids = np.concatenate(parts)
    flat = _gather(ids, place[which], counts[which])
    upto = np.append(0, np.cumsum(counts[which]))[np.searchsorted(starts, at)]
    return pa.ListArray.from_arrays(upto.astype(np.int32), pa.array(flat))


def decode(ids: pa.ListArray, pieces: Pieces) -> pa.Array:
    """The text of each list of ids: bytes joined, markers as spaces, the one in front removed. Invalid UTF-8 becomes U+FFFD; other ids are empty."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.array([*map(len, pieces.spelled), 0], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    flat = np.where((flat >= 0) & (flat < len(pieces.spelled)), flat, len(pieces.spelled))
    data = _gather(np.frombuffer(b"".join(pieces.spelled), dtype=np.uint8), first[flat], sizes[flat]).tobytes()
    lengths = pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy()
    ends = np.append(0, np.cumsum(sizes[flat]))[np.append(0, np.cumsum(lengths))].tolist()
    texts = [data[x:y].decode("utf-8", "replace").replace(MARKER, " ") for x, y in zip(ends, ends[1:])]
    return pa.array([text[1:] if text.startswith(" ") else text for text in texts], pa.string())


CODED = "struct<ids:array<int>,decoded:string>"


def _coder(pieces, decoded: bool) -> Callable[[pa.Array], pa.Array]:
    def run(text: pa.Array) -> pa.Array:
        batch = pa.record_batch([text], names=["text"])
        parts = []
        for part in slices(batch, "text"):
            ids = encode(part.column("text"), pieces.value)
            back = decode(ids, pieces.value) if decoded else pa.nulls(len(ids), pa.string())
            parts.append(pa.StructArray.from_arrays([ids, back], names=["ids", "decoded"]))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return run


def coded(spark: SparkSession, pieces: Pieces, text: str = "text", decoded: bool = True) -> Column:
    """A struct of the ``ids`` of the whole text and the text ``decoded`` from them (null if not asked for).

    Null and empty texts have no ids and decode to an empty text. A marker in a text decodes as a space; all else comes back as it was.
    """
    return arrow_udf(_coder(spark.sparkContext.broadcast(pieces), decoded), CODED).asNondeterministic()(F.col(text).cast("string"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = docs.select("doc_id", coded(spark, load()).alias("own"))
    return own.select("doc_id", F.size("own.ids").cast("long").alias("n_ids"), F.col("own.ids").alias("ids"), F.col("own.decoded").alias("decoded"))
