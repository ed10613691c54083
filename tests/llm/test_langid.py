"""Language model: slopes against differences, calibration, held-out accuracy, and odd rows."""

import os
import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from clickloom.llm import langid


@pytest.fixture(scope="module", autouse=True)
def _package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = str(Path(__file__).resolve().parents[2]) + os.pathsep + spark.sparkContext.environment.get("PYTHONPATH", "")


SYLLABLES = {"aa": "ka lo mi tu re sa", "bb": "schr ung ach ber ein tz", "cc": "ción ñe qué os la es"}


def text(lang, n, rng):
    own = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randint(1, 4))) for _ in range(n))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, own string").repartition(3).write.parquet(str(path / "documents.parquet"))


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    embedding, layer, bias = rng.normal(size=(6, 3)), rng.normal(size=(3, 4)), rng.normal(size=4)
    feature, owner, label = np.array([0, 1, 1, 4, 5, 2, 0]), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([3, 0, 2])

    def loss(embedding, layer, bias):
        mean = np.stack([embedding[feature[owner == i]].mean(axis=0) for i in range(3)])
        return -np.log(langid.softmax(mean @ layer + bias)[np.arange(3), label]).mean()

    rows, of_layer, of_bias, _ = langid.gradients(embedding, layer, bias, feature, owner, label)
    of_embedding = np.zeros_like(embedding)
    np.add.at(of_embedding, feature, rows)
    for which, got in enumerate((of_embedding, of_layer, of_bias)):
        for at in np.ndindex(got.shape):
            moved = [embedding.copy(), layer.copy(), bias.copy()]
            moved[which][at] += 1e-6
            assert abs(-(loss(*moved) - loss(embedding, layer, bias)) / 1e-6 - got[at]) < 1e-4


def test_features_of_texts_do_not_depend_on_their_neighbours():
    texts = ["Ärger über 12 Öl", "", "a", None, "x-y ß", "QUÉ ción"]
    feature, owner = langid.features(pa.array(texts))
    for i, t in enumerate(texts):
        alone, _ = langid.features(pa.array([t], pa.string()))
        assert sorted(feature[owner == i].tolist()) == sorted(alone.tolist())
    assert sorted(langid.features(pa.array(["qué CIÓN"]))[0].tolist()) == sorted(feature[owner == 5].tolist())
    assert len(langid.features(pa.array(["12 .", None, ""], pa.string()))[0]) == 0


def test_calibration_finds_sharpness_and_bound():
    rng = np.random.default_rng(2)
    true = rng.normal(0, 4, size=(4000, 3))
    label = np.array([rng.choice(3, p=p) for p in langid.softmax(true)])
    count = rng.integers(1, 1000, 4000)
    # logits that are too small by a factor that falls with the number of features
    (a, b), bound = langid.calibrated(true / np.exp(1.0 + 0.3 * np.log(count))[:, None], count, label)
    assert abs(a - 1) < 0.3 and abs(b - 0.3) < 0.11
    p = langid.softmax(true)
    accepted = langid.sharpened(true / np.exp(1.0 + 0.3 * np.log(count))[:, None], count, (a, b)).max(axis=1) >= bound
    assert 0.1 < accepted.mean() < 0.9 and (p.argmax(axis=1) != label)[accepted].mean() <= langid.WRONG
    assert langid.calibrated(np.zeros((0, 3)), np.zeros(0), np.zeros(0, int)) == ((0.0, 0.0), 0.0)
    assert langid.calibrated(np.array([[1.0, 0.0]]), np.array([3]), np.array([1]))[1] > 1


def test_query_on_held_out_and_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, text(lang, rng.randint(3, 80), rng), lang, 0.5, "x") for i, lang in enumerate(rng.choices("aa bb cc".split(), [8, 1, 1], k=900))]
    # a third of all rows is one text; some labels are wrong where the model must not look
    rows += [(2000 + i, "ka lo mi tu", "aa", None, None) for i in range(450)]
    wrong = [(i, t, "bb" if held_out(i) else lang, s, o) for i, t, lang, s, o in rows]
    odd = [(5000, None, "aa", 0.1, None), (5001, "", "aa", 0.1, "x"), (5002, "12 34 .", "zz", 0.1, "x"), (None, "ción ñe", None, None, None), (None, None, None, None, None)]
    odd += [(5003, "KALOMI TURE", None, 0.1, "x"), (5003, "KALOMI TURE", None, 0.1, "x"), (5004, text("cc", 60_000, rng), None, 0.1, "x"), (5005, "日", None, 0.1, "x")]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    table(spark, tmp_path / "a", rows + odd)
    table(spark, tmp_path / "b", wrong + odd)
    out = langid.op12_language(spark, str(tmp_path / "a"))
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(rows + odd)
    # held-out labels have no part in it
    assert got == sorted(map(tuple, langid.op12_language(spark, str(tmp_path / "b")).collect()), key=str)
    truth = {i: lang for i, _, lang, *_ in rows}
    far = [r for r in got if r[0] in truth and r[1]]
    assert all(r[1] == held_out(r[0]) for r in got if r[0] is not None)
    assert sum(r[2] == truth[r[0]] for r in far) > 0.98 * len(far) and all(0 <= r[3] <= 1 for r in got)
    by_id = {}
    for r in got:
        by_id.setdefault(r[0], []).append(r)
    for i in (5000, 5001, 5002):
        assert by_id[i][0][2:5] == ("und", 0.0, False)
    assert sorted(r[2] for r in by_id[None]) == ["cc", "und"] and all(r[1] for r in by_id[None])
    assert len(by_id[5003]) == 2 and by_id[5003][0] == by_id[5003][1] and by_id[5003][0][2] == "aa"
    assert by_id[5004][0][2] == "cc" and by_id[5005][0][2] in ("aa", "bb", "cc")
    # 'zz' has no text with a letter and is no language
    assert {r[2] for r in got} == {"aa", "bb", "cc", "und"}


def test_sample_counts_copies_once(spark):
    rows = [(i, "same text", "aa") for i in range(500)] + [(1000 + i, f"text {i}", "bb") for i in range(500)] + [(9, None, "aa"), (9, "x", None)]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), texts=40).collect()
    assert [r["text"] for r in got if r["lang"] == "aa"] == ["same text"] and len([r for r in got if r["lang"] == "bb"]) == 40


@pytest.mark.parametrize("labels", [None, "aa"])
def test_no_language_or_one(spark, tmp_path, labels):
    table(spark, tmp_path, [(i, f"word{i} ka", labels, 0.0, "x") for i in range(30)])
    got = langid.op12_language(spark, str(tmp_path)).collect()
    assert len(got) == 30 and {r["lang_pred"] for r in got} == {labels or "und"} and {r["score"] for r in got} == {1.0 if labels else 0.0}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    assert langid.op12_language(spark, str(tmp_path)).collect() == []
