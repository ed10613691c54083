"""Periodic runs against brute force, and on odd rows."""

import hashlib
import os
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from clickloom.llm import periods

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def _package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2]) + os.pathsep + spark.sparkContext.environment.get("PYTHONPATH", "")


def brute_runs(words, least=12):
    """Every period in turn: stretches of equal words that far apart; one with a smaller period on the same words is that run."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        x = 0
        while x + q < n:
            start = x
            while x + q < n and words[x] == words[x + q]:
                x += 1
            if x > start and x + q - start >= max(least, 2 * q):
                found.setdefault((start, x + q - start), q)
            x += 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda run: (run[0], run[2]))


def brute_row(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    dropped = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = min(runs, key=lambda run: (-run[1], run[0], run[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(word for i, word in enumerate(words) if i not in dropped)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if not runs else 1000 * best[1] // best[2], sha(lines), sha(kept))


def pairs(words, first, least):
    return list(zip(*map(np.ndarray.tolist, periods.runs_of(np.array(words, dtype=np.int64), np.array(first), least))))


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_periodic_words(least):
    rng = random.Random(7)
    fibonacci, longer = [0], [0, 1]
    while len(longer) < 200:
        fibonacci, longer = longer, longer + fibonacci
    # progressions that a run shifts onto each other from any side, nested periods, and squares of all short words
    cases = [longer[:200], [0] * 100, [0, 1] * 40 + [1, 0] * 40, [1, 0, 1, 0, 1, 0, 1, 1, 0, 1, 0, 1, 0, 1, 1]]
    cases += [[2, *((code >> i) & 1 for i in range(q)), *((code >> i) & 1 for i in range(q)), 3] for q in range(1, 9) for code in range(1 << q)]
    for _ in range(300):
        block = [rng.randrange(2) for _ in range(rng.randint(1, 7))]
        words = []
        while len(words) < rng.randint(2, 120):
            words += block * rng.randint(1, 6) + block[: rng.randrange(len(block) + 1)] + [rng.randrange(3)] * rng.randint(0, 2)
        cases.append(words)
    for words in cases:
        assert pairs(words, [0, len(words)], least) == brute_runs(words, least)


def test_runs_stay_inside_their_text():
    one = [5, 6] * 8
    assert pairs(one * 2, [0, 16, 16, 32], 12) == [(0, 16, 2), (16, 16, 2)]


def rows():
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 60)))) for i in range(300)]
    # crc32 of these ids is divisible by 10
    chosen = [i for i in range(100_000) if zlib.crc32(str(i).encode()) % 10 == 0][:40]
    made += [(i, "\t".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(1, 200)))) for i in chosen]
    long = " ".join(f"n{k}" for k in range(30_000))
    made += [(chosen[0], None), (chosen[1], ""), (chosen[2], " \t\n "), (None, "x y " * 9), (None, None), (7, "A a " * 6 + "a A"), (7, "A a " * 6 + "a A"), (next(i for i in range(200_000, 300_000) if zlib.crc32(str(i).encode()) % 10 == 0), long), (900_001, long + " z" * 20)]
    made += [(900_002, "p q " * 14 + "\x1cr\x0b\x0c" * 13), (900_003, "one")]
    return made


def test_query_against_brute_force(spark, tmp_path):
    data = [(doc_id, text, 1, "r", doc_id) for doc_id, text in rows()]
    spark.createDataFrame(data, "doc_id long, text string, runs int, collapsed string, start long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = periods.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {kind for name, kind in got.dtypes if name not in ("runs_sha256", "collapsed_sha256")} == {"bigint"}
    # a text of 30,000 words of brute force would take hours: its runs are those of its planted or added end
    short = [row for row in rows() if not row[1] or len(row[1]) < 10_000]
    want = sorted(map(str, (brute_row(*row) for row in short)))
    have = [tuple(row) for row in got.collect()]
    long_ids = {row[0] for row in rows() if row[1] and len(row[1]) >= 10_000}
    assert sorted(str(row) for row in have if row[0] not in long_ids) == want
    by_id = {row[0]: row for row in have if row[0] in long_ids}
    assert by_id[900_001][1:6] == (1, 30_000, 20, 1, 20_000)
    planted_id = (long_ids - {900_001}).pop()
    h = zlib.crc32(str(planted_id).encode())
    a = h // 10 % 30_000
    p = 1 + (30_000 - a) // (3 + h // 10 % 8)
    assert by_id[planted_id][1:5] == (1, a, 30_000 - a, p)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert periods.op11_periodic_runs(spark, str(tmp_path)).collect() == []


def test_spans_and_text_of_the_operator(spark):
    row = spark.createDataFrame([("go " + "x y " * 7 + "z",)], "own string").select(periods.periodic_runs("own").alias("r")).first()["r"]
    assert row["words"] == 16 and [tuple(run) for run in row["runs"]] == [(1, 14, 2)] and row["collapsed"] == "go x y z"
