"""Hand-written frames with known results."""

import pytest
from pyspark.sql import functions as F

from clickloom.functions import parsing, timing
from clickloom.operators import counts, encode, history, metrics, model, ordered, prepare, smoothing


def column(df, name, by="instance_id"):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(params=["broadcast", "split"])
def both_ways(request):
    if request.param == "split":
        request.getfixturevalue("split_keys")


def test_gaps_with_ties(clicks, both_ways):
    df = ordered.place_features(clicks([("a", 0), ("a", 5), ("a", 5), ("a", 9)]), ("user_id", "day_idx"), ordered.gaps())
    assert column(df, "former_time_cha") == [None, 5, 0, 4]
    assert column(df, "later_gap") == [5, 0, 4, None]
    assert column(df, "later_time_cha") == [-86395, 0, -86396, None]
    assert column(df, "if_czxtdj") == [0, 1, 1, 0]


def test_ranks_with_ties(clicks, both_ways):
    features = {**ordered.average_rank("avg"), **ordered.lowest_rank("low", "rest"), **ordered.distinct_time_rank("dense")}
    df = ordered.place_features(clicks([("a", 0), ("a", 5), ("a", 5), ("a", 9)]), "user_id", features)
    assert column(df, "avg") == [1, 2.5, 2.5, 4]
    assert column(df, "low") == [1, 2, 2, 4]
    assert column(df, "dense") == [1, 2, 2, 3]
    assert all(low + rest == 4 for low, rest in zip(column(df, "low"), column(df, "rest")))


def test_previous_and_next(clicks):
    df = ordered.place_features(clicks([("a", 0), ("a", 60), ("a", 90_000)]), "user_id", ordered.next_previous())
    assert column(df, "second_2") == [None, 60, 3540]
    assert column(df, "days_2") == [None, 0, 1]
    assert column(df, "second_1") == [60, 3540, None]
    assert column(df, "time_rank") == [1, 2, 3]


def test_null_keys_have_no_group(clicks, both_ways):
    log = clicks([("a", 1), (None, 2), (None, 3), ("b", 4)])
    assert column(counts.attach_counts(log, {"n": "user_id"}), "n") == [1, None, None, 1]
    assert column(ordered.place_features(log, "user_id", ordered.lowest_rank("r")), "r") == [1, None, None, 1]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(3, 29), (3, 30)], "hour int, minute int")
    assert [r[0] for r in df.select(timing.time_bucket(2)).collect()] == [6, 7]


def test_category_parts(spark):
    df = spark.createDataFrame([("7;8",), ("7",), ("7;8;9",), ("x",)], "item_category_list string")
    rows = df.select(*[c.alias(n) for n, c in parsing.category_ids().items()]).collect()
    assert [tuple(r) for r in rows] == [(7, 8, -1), (7, -1, -1), (7, 8, 9), (-1, -1, -1)]


def test_property_overlap(spark):
    rows = [("1;2;3", "9:1,2;8:4", 2 / 3), ("1;2", "-1", 0.0), ("-1", "9:1", 0.0), ("1;-1", "9:-1,1", 1.0), ("5", "9", 0.0)]
    df = spark.createDataFrame(rows, "item_property_list string, predict_category_property string, want double")
    assert all(abs(r[0] - r[1]) < 1e-12 for r in df.select(parsing.property_overlap(), "want").collect())


def test_wall_clock_of_a_named_zone(spark):
    df = spark.createDataFrame([(1_524_787_200,)], "context_timestamp long")
    row = df.select(*[c.alias(n) for n, c in timing.time_parts(zone="Asia/Shanghai", first_day="2018-04-01").items()]).first()
    assert (row["day_idx"], row["day"], row["hour"]) == (26, 27, 8)


@pytest.fixture
def days(spark):
    rows = [(0, "k", 0, 1), (1, "k", 1, 0), (2, "k", 1, 1), (3, "k", 2, 0), (4, "k", 2, -1), (5, "z", 2, 1)]
    return spark.createDataFrame(rows, "instance_id long, item_id string, day_idx int, is_trade int")


def test_asof_history(days, both_ways):
    df = history.asof_cvr(days, ["item_id"])
    assert column(df, "item_id_sum") == [None, 1, 1, 3, 3, None]
    assert column(df, "item_id_buy") == [None, 1, 1, 2, 2, None]


def test_per_day_divides_by_earlier_days(days):
    assert column(history.asof_cvr(days, ["item_id"], per_day=True), "item_id_sum") == [None, 1, 1, 1.5, 1.5, None]


def test_unlabelled_rows_are_not_history(spark, both_ways):
    his = spark.createDataFrame([("k", 0), ("k", 1), ("k", -1), ("q", -2)], "item_id string, is_trade int")
    now = spark.createDataFrame([(1, "k"), (2, "q"), (3, "new")], "instance_id long, item_id string")
    df = history.history_cvr(his, now, ["item_id"])
    assert column(df, "item_id_sum") == [2, None, None]
    assert column(df, "item_id_cvr") == [0.5, None, None]
    rates = history.rate_features(his, now, {"item": "item_id"})
    assert column(rates, "item_count") == [2, 0, 0]
    assert column(rates, "item_rate") == [0.5, 1.0, 1.0]


def test_history_ignores_the_future(days):
    full = {r["instance_id"]: r for r in history.asof_cvr(days, ["item_id"]).collect()}
    cut = history.asof_cvr(days.where("day_idx < 2"), ["item_id"]).collect()
    assert all(full[r["instance_id"]] == r for r in cut)


def test_smoothed_rate_lies_between_raw_and_prior(days):
    his, now = prepare.split_history_current(days, 2)
    for r in smoothing.smoothed_cvr(his, now, ["item_id"], 1.0, 9.0).collect():
        raw = r["item_id_buy"] / r["item_id_sum"] if r["item_id_sum"] else 0.1
        assert min(raw, 0.1) <= r["item_id_cvr"] <= max(raw, 0.1)


def test_labels_of_an_assembled_log(days):
    log = prepare.assemble_log(days, days.drop("is_trade"), days.drop("is_trade"))
    assert sorted(r[0] for r in log.select("is_trade").distinct().collect()) == [-2, -1, 0, 1]


def test_one_hot_uses_the_training_vocabulary(spark):
    train = spark.createDataFrame([(1, 2)], "instance_id long, g int")
    other = spark.createDataFrame([(2, 2), (3, 7)], "instance_id long, g int")
    _, coded = encode.one_hot(train, other, ["g"], form="columns")
    assert coded.columns == ["instance_id", "g", "g2"] and column(coded, "g2") == [1, 0]


def test_one_hot_of_many_values_is_a_sparse_vector(spark):
    train = spark.range(5_000).selectExpr("id AS instance_id", "concat('v', id % 2500) AS g")
    other = spark.createDataFrame([(1, "v0"), (2, "unseen"), (3, None)], "instance_id long, g string")
    first, coded = encode.one_hot(train, other, ["g"])
    assert first.count() == 5_000
    rows = {r.instance_id: r.g_onehot for r in coded.collect()}
    assert {v.size for v in rows.values()} == {2_500}
    assert rows[1].indices.tolist() == [0] and rows[2].numNonzeros() == rows[3].numNonzeros() == 0
    assert model.assembled(coded, ["instance_id", "g_onehot"]).first()["features"].size == 2_501


def test_label_codes_follow_the_order_of_the_values(spark):
    train = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "instance_id long, g string")
    other = spark.createDataFrame([(5, "b"), (6, "c"), (7, None)], "instance_id long, g string")
    first, coded = encode.label_encode(train, other, ["g"])
    assert {r.instance_id: r.g_code for r in first.collect()} == {1: 1, 2: 0, 3: None, 4: 1}
    assert {r.instance_id: r.g_code for r in coded.collect()} == {5: 1, 6: None, 7: None}


def test_dominant_category_of_texts_and_unlabelled_rows_in_the_report(spark):
    df = spark.createDataFrame([(1, "y"), (1, "x"), (2, "z"), (2, None), (2, None)], "item_id long, c string")
    got = {r.item_id: (r.max_count, r.dominant) for r in metrics.dominant_category(df, category="c").collect()}
    assert got == {1: (1, "x"), 2: (2, None)}
    scored = spark.createDataFrame([(1, 1), (0, 1), (-1, 1), (-2, 0)], "is_trade int, prediction int")
    assert {r.label: r.support for r in metrics.classification_report(scored).collect()} == {0: 1, 1: 1}


def test_transferred_score_keeps_the_rows(spark):
    df = spark.createDataFrame([(1,), (2,)], "instance_id long")
    scores = spark.createDataFrame([(1, 0.2), (1, 0.4)], "instance_id long, predicted_score double")
    got = column(metrics.attach_score(df, scores), "predicted_score")
    assert got[0] == pytest.approx(0.3) and got[1] is None


def test_log_loss_clips(spark):
    df = spark.createDataFrame([(1, 1.0), (0, 0.0), (1, 0.5), (-1, 0.9)], "is_trade int, predicted_score double")
    row = metrics.log_loss(df).first()
    assert row["n"] == 3 and row["log_loss"] == pytest.approx(0.2310490601866, abs=1e-9)
