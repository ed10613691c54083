"""Operators on documents: against brute force, and on nulls, empty and long texts, ties, repeats and clashing names."""

import itertools
import re
import zlib

import pytest

from clickloom.llm import mixing, ngram_join, pieces, pii, repeats, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", autouse=True)
def _package(spark):
    import os
    from pathlib import Path

    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2]) + os.pathsep + spark.sparkContext.environment.get("PYTHONPATH", "")


def words(text, n, start=0):
    return " ".join(f"{text}{k}" for k in range(start, start + n))


def odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    rows = [
        (1, words("a", 70), "s", 1, 2.0, "x"), (1, words("a", 70), "s", 1, 2.0, "x"), (2, words("a", 70) + " Z", None, 1, 2.0, None), (3, "", "s", 1, None, "x"),
        (4, None, "t", 1, 2.0, "x"), (None, words("a", 70), "t", 1, 2.0, "x"), (5, "b c", "t", 1, 2.0, "x"), (6, "B  c", "u", 1, 2.0, "x"), (7, words("long", 30_000), "u", 1, 2.0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, row int, target double, component string")


def empty(spark):
    return odd_rows(spark).limit(0)


def shingles(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def brute_components(rows):
    sets = {doc: shingles(text) for doc, text in rows}
    low = {doc: doc for doc in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]) and low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    return low


@pytest.mark.parametrize("block", [ngram_join.BLOCK, 3])
def test_jaccard_components_of_edited_copies(spark, block):
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        own = list(base)
        for j in range(k % 7):
            own[(k * 11 + j * 17) % 60] = f"x{k}y{j}"
        rows.append((k, " ".join(own)))
    rows += [(100 + k, words(f"other{k // 2}", 40 + k % 2)) for k in range(10)]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), cells=256, block=block).collect()
    expected = brute_components(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert {r.doc_id: r.n_shingles for r in got} == {doc: len(shingles(text)) for doc, text in rows}


def test_jaccard_odd_rows(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd_rows(spark)).collect()}
    assert got == {(1, 66, 1), (2, 67, 1), (3, 0, 3), (4, 0, 4), (None, 66, None), (5, 1, 5), (6, 1, 5), (7, 29_996, 7)}
    assert ngram_join.jaccard_components(empty(spark)).count() == 0
    kept = ngram_join.one_of_each(odd_rows(spark))
    assert kept.columns == odd_rows(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 7]


def test_tree_joins_what_leaves_would(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.integers(0, 3, (90, ngram_join.GROUPS)).astype(np.int32)
    points[45:] = np.maximum(0, points[:45] - (rng.random((45, ngram_join.GROUPS)) < 0.03))
    sizes, comps = points.sum(axis=1), np.arange(90) // 2
    tree = ngram_join.Tree(points, sizes, comps, sizes)
    got = {tuple(sorted(pair)) for a, b in tree.joined() for pair in zip(a.tolist(), b.tolist())}
    expected = {(i, j) for i, j in itertools.combinations(range(90), 2) if comps[i] != comps[j] and 9 * np.minimum(points[i], points[j]).sum() >= 4 * (sizes[i] + sizes[j])}
    assert got == expected and expected


@pytest.mark.parametrize("entries", [repeats.ENTRIES, 1])
def test_repeated_passages(spark, entries):
    shared = words("p", 60)
    rows = [(1, words("a", 30) + " " + shared), (2, words("b", 7) + " " + shared + " " + words("c", 5)), (3, words("d", 90)), (4, words("p", 49)), (5, words("q", 55) + " " + words("q", 55))]
    got = {(r.doc_id, r.start_word, r.end_word, r.n_words) for r in repeats.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), entries).collect()}
    assert got == {(1, 30, 90, 60), (2, 7, 67, 60)}


def test_repeated_passages_odd_rows(spark):
    got = {tuple(r) for r in repeats.repeated_passages(odd_rows(spark)).collect()}
    assert got == {(1, 0, 70, 70), (2, 0, 70, 70)}
    assert repeats.repeated_passages(empty(spark)).count() == 0


def test_mix_of_odd_rows(spark):
    docs = odd_rows(spark)
    plan = {r.source: r for r in mixing.mix_plan(docs).collect()}
    assert {s: r.source_size for s, r in plan.items()} == {"s": 140, "t": 72, "u": 30_002, None: 71}
    budget = 1.5 * sum(r.source_size for r in plan.values())
    assert sum(r.target for r in plan.values()) == pytest.approx(budget)
    assert all(r.target <= 2 * r.source_size for r in plan.values())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty(spark)).count() == 0


def test_mix_comes_near_its_targets_and_splits_a_hot_source(spark):
    rows = [(k, words("w", 5 + k % 20), "hot" if k % 3 else f"s{k % 5}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = {r.source: r for r in mixing.mix_plan(docs).collect()}
    taken = {s: 0 for s in plan}
    for r in mixing.mix(docs).collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - r.target) <= 60 for s, r in plan.items())


def test_toxicity_learns_from_labels_of_documents(spark):
    bad = ["nasty", "vile"]
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        own = [" ".join(f"word{(k * 7 + j * s) % 50}" for j in range(8)) for s in range(1, 5)]
        if toxic:
            own[k % 3] += f" {bad[k // 4 % 2]}"
        rows.append((k, ". ".join(own) + "."))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    held = [r for r in docs.select("doc_id", "text", toxicity.toxicity(spark, model).alias("t")).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.t.score >= 0.5) == (r.doc_id % 4 == 0) for r in held) >= 0.98 * len(held)
    for r in held:
        if r.doc_id % 4 == 0 and r.t.sentences:
            assert any(b in r.text[s.start : s.end] for s in r.t.sentences for b in bad)


def test_toxicity_odd_rows(spark):
    docs = odd_rows(spark)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scores = [r.t.score for r in docs.select(toxicity.toxicity(spark, model).alias("t")).collect()]
    assert scores == [0.0] * 9
    assert empty(spark).select(toxicity.toxicity(spark, model)).count() == 0


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] * (16 <= len(digits) <= 19 and pii.luhn(digits))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@pytest.mark.parametrize("text", [
    "", "a@b.c x", "é a.b@c-d.example.com, 1.2.3.4.5 and 999.1.1.1", "4041894974608795", "4041-8949 7460 8795 1", "+1 (988) 555-2485 or +12 34", "@@a@b@c.d.e 1.2.3", "00.1.2.003 + 5", "a@b a@b.c@d.e",
])
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_field_adds_what_the_patterns_drop(spark):
    rows = [(k, f"t 4041894974608795 x +1 (98{k % 10}) 555-24{k % 10}5 y 10.0.{k}.7 z a{k}@mail.example.com.") for k in range(60)]
    weights = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    text = "see 4041894974608795 12 and +1 (988) 555-2485 42.144.35.254 here"
    base, every = pii.all_spans(text, weights)
    assert base == [("ip", 46, 59)]
    assert every == [("ip", 46, 59), ("card", 4, 20), ("phone", 28, 45)]
    assert pii.masked_text(text, weights) == "see [CARD] 12 and [PHONE] [IP] here"
    assert pii.all_spans("plain words 12 and 1999-2004, item 123456", weights) == ([], [])


def test_personal_data_odd_rows(spark):
    assert pii.train(odd_rows(spark)) == {} and pii.train(empty(spark)) == {}
    got = odd_rows(spark).select(pii.personal_data(spark, {}).alias("p")).select("p.*").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0, "", "")]


TEXTS = ["", "Hello  world\n\tx é 你好", "   lead", "trail   ", "a" * 300 + " " + "你" * 50, "x\x00y\U0001f600", "one two two one", None]


def small_pieces():
    names = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *"▁ a l o w r d e h t n".split(), "▁w", "lo", "or", "▁on", "tw", "wo", "▁two", "▁▁", "aa", "aaa"]
    kinds = ["other", *["byte"] * 256, *["normal"] * (len(names) - 257)]
    return names, kinds, pieces.pieces_from(names, [-1.0 - (i * 7 % 13) / 3 for i in range(len(names))], kinds, 0)


def best_score(text, scores, worst):
    best = [0.0] + [float("-inf")] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + 8) + 1):
            s = scores.get(text[i:j], worst if j == i + 1 else None)
            if s is not None and best[i] + s > best[j]:
                best[j] = best[i] + s
    return best[-1]


def test_pieces_are_best_paths_and_come_back(spark):
    import pyarrow as pa

    names, kinds, own = small_pieces()
    scores = {names[i]: own.scores[i] for i in range(len(names)) if kinds[i] == "normal"}
    ids = pieces.encode(pa.array(TEXTS), own)
    assert pieces.decode(ids, own).to_pylist() == [t or "" for t in TEXTS]
    for text, found in zip(TEXTS, ids.to_pylist()):
        marked = "▁" + text.replace(" ", "▁") if text else ""
        unknown = sum(1 for c in marked if c not in scores)
        assert best_score(marked, scores, own.scores[-1]) == pytest.approx(sum(own.scores[i] for i in found if kinds[i] == "normal") + unknown * own.scores[-1])


def test_pieces_agree_with_the_library(spark):
    pytest.importorskip("sentencepiece")
    import pyarrow as pa
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    own = pieces.load()
    model = proto.ModelProto()
    model.ParseFromString(open(pieces.MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if piece.type == 1:
            piece.score = float(own.scores[i])
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    texts = [t for t in TEXTS if t and "\x00" not in t] + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    cost = lambda found: sum(own.scores[i] for i in found if not library.is_byte(i))
    for text, found in zip(texts, pieces.encode(pa.array(texts), own).to_pylist()):
        other = library.encode(text)
        assert found == other or cost(found) == pytest.approx(cost(other), rel=1e-5)
        assert library.decode(found) == text


def test_pieces_odd_rows(spark):
    own = small_pieces()[2]
    got = odd_rows(spark).select("text", pieces.coded(spark, own).alias("c")).collect()
    assert all(r.c.decoded == (r.text or "") for r in got)
    assert empty(spark).select(pieces.coded(spark, own)).count() == 0
