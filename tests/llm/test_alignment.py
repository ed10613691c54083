"""Alignment of two tokenizers against a plain one over whole documents, and on odd rows."""

import hashlib
import os
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clickloom.llm import alignment

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def _package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2]) + os.pathsep + spark.sparkContext.environment.get("PYTHONPATH", "")


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    # the letters of a byte-level vocabulary, byte by byte
    letter = {byte: a.encode(bytes([byte]).decode("latin-1"), add_special_tokens=False).tokens for byte in range(128)}
    letters = {tokens[0]: bytes([byte]) for byte, tokens in letter.items()}

    def bytes_a(token):
        out = b""
        for c in token:
            out += letters[c] if c in letters else bytes([ord(c)]) if ord(c) < 256 else bytes([high[ord(c) - 256]])
        return out

    high = [byte for byte in range(256) if not (33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte)]

    def bytes_b(piece):
        return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece[:3] == "<0x" else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        one, two = a.encode(" " + text, add_special_tokens=False), b.encode(text)
        left = [(i, bytes_a(t)) for i, t in zip(one.ids, one.tokens)]
        right = [(i, bytes_b(b.id_to_piece(i))) for i in two]
        if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            return [], []
        return left, right

    return tokens


def spans(tokens):
    at, out = 0, []
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def brute(rows, plain):
    links, parts = [], []
    for _, text in rows:
        a, b = map(spans, plain(text))
        links.append([(i, j) for i, s, e in a for j, s2, e2 in b if s < e2 and s2 < e])
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, begin = [], 0
        for end in ends:
            own = [",".join(str(i) for i, s, e in side if begin < e <= end) for side in (a, b)]
            groups.append("|".join(own))
            begin = end
        parts.append((len(a), len(b), groups))
    count = Counter(pair for own in links for pair in set(own))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    out = []
    for (doc_id, _), own, (n_a, n_b, groups) in zip(rows, links, parts):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), sha))
    return out


def rows():
    rng = random.Random(11)
    letters = "abcdefg ehr tion  ßéñ日本😀́\n\t,.'0123456789"
    made = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))) for i in range(60)]
    made += [(60, "the cat sat on the mat, isn't it"), (60, "the cat sat on the mat, isn't it"), (61, "the cat sat on the mat, isn't it")]
    made += [(62, None), (63, ""), (None, "the cat"), (None, None), (64, "marker ▁ here"), (65, "<|endoftext|> <s></s> <unk> <0x41>"), (66, " "), (67, "\x00\x1c ﻿")]
    return made


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 100])
def test_counts_against_brute_force(spark, tmp_path, plain, block):
    data = [(i, text, 1, 2, 3, "x") for i, text in rows()]
    docs = spark.createDataFrame(data, "doc_id long, text string, block int, pair int, slots int, documents string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(map(str, brute(rows(), plain)))
    if block == alignment.BLOCK_BYTES:
        got = alignment.op13_token_alignment(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert {kind for _, kind in got.dtypes[:-1]} == {"bigint"}
    else:
        counted = alignment.counted_pairs(spark.read.parquet(str(tmp_path / "documents.parquet")), keep=("doc_id", "block"), block_bytes=block)
        assert counted.blocks.where("pairs is not null").count() > 10
        got = counted.documents()
        assert got.select("own_1").distinct().collect() == [(1,)]
        got = got.select("own_0", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(str(tuple(row)) for row in got.collect()) == want


def test_whole_table_against_brute_force(spark, plain):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{SF_DIR}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    # brute force looks at all pairs of tokens: the shorter texts only, which leaves the counts to compare to them
    some = [(r["doc_id"], r["text"]) for r in table if len(r["text"]) < 1500]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = alignment.counted_pairs(docs).documents().collect()
    assert sorted(str(tuple(row[n] for n in ("own_0", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for row in got) == sorted(map(str, brute(some, plain)))
    assert alignment.op13_token_alignment(spark, SF_DIR).count() == len(table)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert alignment.op13_token_alignment(spark, str(tmp_path)).collect() == []


def test_long_space_goes_to_the_other_library(plain):
    sides = alignment.Tokenizers().sides()
    for text in ("a" + " " * 300_000 + "b", "\n" * 50_000, "x" * 300_000, " y" * 100_000):
        own = alignment.align(pa.array([text]), sides)
        a, b = plain(text)
        assert own.a.tolist() == [i for i, _ in a] and own.b.tolist() == [i for i, _ in b]
        assert own.cut_a[-1] and own.cut_b[-1] and len(own.links()[0]) == len(own.a) + len(own.b) - own.cut_a.sum()


def test_groups_of_the_operator(spark, plain):
    texts = [text for _, text in rows()]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", alignment.aligned().alias("own")).orderBy("i").collect()
    for row, text in zip(got, texts):
        a, b = plain(text)
        own = row["own"]
        assert own["a"] == [i for i, _ in a] and own["b"] == [i for i, _ in b]
        assert sum(g["a"] for g in own["groups"]) == len(a) and sum(g["b"] for g in own["groups"]) == len(b)
        at_a = at_b = 0
        for g in own["groups"]:
            left, right = b"".join(x for _, x in a[at_a : at_a + g["a"]]), b"".join(x for _, x in b[at_b : at_b + g["b"]])
            assert left == right and len(left) == g["bytes"]
            at_a, at_b = at_a + g["a"], at_b + g["b"]
