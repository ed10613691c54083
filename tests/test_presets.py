"""The key lists, pinned: both the queries and their SQL are built from them."""

from clickloom.plans import presets


def test_final_stage_lists():
    assert presets.FINAL_BUCKET_KEYS == ("user_id", "item_id", "item_price_level", "item_sales_level", "user_occupation_id")
    assert [k.removesuffix("_all") for k in presets.FINAL_TOTALS] == [
        "item_id", "item_brand_id", "item_price_level", "item_sales_level", "user_id", "user_gender_id", "shop_id", "shop_review_num_level", "shop_star_level",
    ]
    assert sorted(k[1] for k in presets.FINAL_USER_PAIRS.values()) == ["item_brand_id", "item_id", "item_price_level", "item_sales_level", "shop_id"]
    assert sorted(presets.FINAL_HEAT.values()) == [("item_id", "user_id"), ("shop_id", "user_id"), ("user_id", "cate_1"), ("user_id", "item_brand_id"), ("user_id", "item_id")]
    assert sorted(presets.FINAL_RANKS.values()) == [("user_id",), ("user_id", "item_brand_id"), ("user_id", "item_id"), ("user_id", "shop_id")]
    assert [*presets.FINAL_HISTORY, *presets.FINAL_HISTORY_PAIRS] == [("item_id",), ("item_price_level",), ("item_sales_level",), ("user_id",), ("user_id", "item_id"), ("user_id", "cate_1")]
    assert len(presets.FINAL_MEANS) == 10 and len(presets.USES_FUTURE_WITHIN_DAY) == 14


def test_first_stage_lists():
    levels = ["item_price_level", "item_sales_level", "item_collected_level", "item_pv_level"]
    assert list(presets.FIRST_ITEM_COUNT_KEYS) == ["item_id", "item_brand_id", "item_city_id", *levels]
    assert [k[0] for k in presets.FIRST_ITEM_RATE_KEYS] == ["item_id", "item_brand_id", *levels, "hour"]
    assert [k[0] for k in presets.FIRST_USER_RATE_KEYS] == ["user_id", "user_gender_id", "user_age_level", "user_occupation_id", "user_star_level"]
    assert len(presets.FIRST_PAIR_RATE_KEYS) == 24 and len(set(presets.FIRST_PAIR_RATE_KEYS)) == 24
    assert len(presets.FIRST_SHOP_RATE_KEYS) == 7 and len(presets.FIRST_USER_COUNTS) == 9 and len(presets.FIRST_KINDS) == 4


def test_rolling_lists():
    assert len(presets.ROLLING_RATES) == 43 and len(set(presets.ROLLING_RATES.values())) == 43
    assert sum(len(keys) == 1 for keys in presets.ROLLING_RATES.values()) == 12 and sum("hour" in keys for keys in presets.ROLLING_RATES.values()) == 9
    assert sum("user_id" in keys for keys in presets.ROLLING_RATES.values()) == 12
    assert len(presets.ROLLING_COUNTS) == 7 and len(presets.ROLLING_MEANS) == 13 and len(presets.ROLLING_DEVIATIONS) == 8 and presets.ROLLING_DAYS == 9
    assert presets.ROLLING_ONE_HOT == ("user_gender_id", "user_occupation_id")
