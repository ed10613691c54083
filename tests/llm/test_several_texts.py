"""Similarity join where rows of one id have different texts: the id is one node with the links of each."""

import itertools
import os
import random
from pathlib import Path

import pytest
from test_documents import shingles, words

from clickloom.llm import ngram_join


@pytest.fixture(scope="module", autouse=True)
def _package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2]) + os.pathsep + spark.sparkContext.environment.get("PYTHONPATH", "")


def brute(rows):
    sets = [(doc, shingles(text)) for doc, text in rows if doc is not None]
    low = {doc: doc for doc, _ in sets}
    changed = True
    while changed:
        changed = False
        for (a, x), (b, y) in itertools.combinations(sets, 2):
            if low[a] != low[b] and x & y and 100 * len(x & y) >= 80 * len(x | y):
                # the smallest id wins for all that have either
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = {doc: new if at == old else at for doc, at in low.items()}
                changed = True
    return sorted(((doc, len(shingles(text)), None if doc is None else low[doc]) for doc, text in rows), key=str)


def got(spark, rows):
    df = spark.createDataFrame([(doc, text, 1, 2) for doc, text in rows], "doc_id long, text string, node long, split long").repartition(3)
    return sorted((tuple(r) for r in ngram_join.jaccard_components(df).collect()), key=str)


def test_an_id_has_the_links_of_each_of_its_texts(spark):
    a, b = words("a", 60), words("b", 60)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x")]
    assert got(spark, rows) == [(1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1)] == brute(rows)


def test_ids_with_empty_null_and_repeated_texts(spark):
    a, b = words("a", 40), words("b", 40)
    rows = [(5, a), (5, ""), (5, None), (7, a + " z"), (7, a + " z"), (9, ""), (9, None), (None, a), (None, None), (2, b), (2, "short one"), (8, "short one"), (6, b)]
    assert got(spark, rows) == brute(rows)


def test_random_ids_against_brute_force(spark):
    rng = random.Random(4)
    bases = [words(f"t{k}_", 50) for k in range(12)]
    rows = []
    for _ in range(120):
        text = rng.choice(bases).split()
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = f"new{rng.randrange(1000)}"
        rows.append((rng.randrange(60), " ".join(text) if rng.random() < 0.8 else words(f"own{rng.randrange(10**6)}_", 20)))
    assert got(spark, rows) == brute(rows)
