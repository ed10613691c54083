"""Which keys each feature family runs on, as data."""

from __future__ import annotations

from clickloom.operators.boosting import Booster

USER_LEVELS = ("user_gender_id", "user_age_level", "user_occupation_id", "user_star_level")
ITEM_LEVELS = ("item_brand_id", "item_price_level", "item_sales_level", "item_collected_level", "item_pv_level")
SHOP_KEYS = ("shop_id", "shop_review_num_level", "shop_star_level")
SHOP_RATE_KEYS = (
    "shop_id", "shop_review_num_level", "shop_review_positive_rate", "shop_star_level",
    "shop_score_service", "shop_score_delivery", "shop_score_description",
)

# ---- final stage -----------------------------------------------------------------------------

FINAL_BUCKET_KEYS = ("user_id", "item_id", "item_price_level", "item_sales_level", "user_occupation_id")

FINAL_TOTALS = {
    f"{key}_all": key
    for key in (
        "item_id", "item_brand_id", "item_price_level", "item_sales_level", "user_id", "user_gender_id",
        "shop_id", "shop_review_num_level", "shop_star_level",
    )
}

FINAL_USER_PAIRS = {
    f"user_id_{key}_all": ("user_id", key)
    for key in ("item_id", "item_brand_id", "shop_id", "item_price_level", "item_sales_level")
}

FINAL_HEAT = {
    "user_item_kind": ("user_id", "item_id"),
    "user_cate_kind": ("user_id", "cate_1"),
    "user_brand_kind": ("user_id", "item_brand_id"),
    "item_user_kind": ("item_id", "user_id"),
    "shop_user_kind": ("shop_id", "user_id"),
}

FINAL_RANKS = {
    "user": ("user_id",),
    "user_item": ("user_id", "item_id"),
    "user_shop": ("user_id", "shop_id"),
    "user_brand": ("user_id", "item_brand_id"),
}

FINAL_HISTORY = (("item_id",), ("item_price_level",), ("item_sales_level",), ("user_id",))
FINAL_HISTORY_PAIRS = (("user_id", "item_id"), ("user_id", "cate_1"))

FINAL_MEANS = {
    f"{key}_{attribute}_mean": (key, attribute)
    for key, attributes in {
        "user_id": ("item_price_level", "item_sales_level", "item_collected_level", "item_pv_level", "shop_review_positive_rate"),
        "item_id": ("user_gender_id", "user_age_level", "user_star_level"),
        "item_brand_id": ("user_age_level", "user_star_level"),
    }.items()
    for attribute in attributes
}

FIRST_SEEN = {"user_first_apper": "user_id", "item_first_apper": "item_id"}

# columns that are not features of the final model
FINAL_EXCLUDED = frozenset(
    (
        "cate_0", "context_id", "context_timestamp", "ts", "day", "day_idx", "instance_id", "is_trade",
        "item_category_list", "item_property_list", "predict_category_property", "user_id", "pre_1",
        "property_0", "property_1", "property_2", "later_gap",
    )
)

# ---- first stage -----------------------------------------------------------------------------

FIRST_ITEM_COUNT_KEYS = ("item_id", "item_brand_id", "item_city_id", *ITEM_LEVELS[1:])
FIRST_ITEM_RATE_KEYS = (("item_id",), *((key,) for key in ITEM_LEVELS), ("hour",))
FIRST_USER_RATE_KEYS = (("user_id",), *((key,) for key in USER_LEVELS))
FIRST_PAIR_RATE_KEYS = tuple((user, item) for user in USER_LEVELS for item in ("cate_1", *ITEM_LEVELS))
FIRST_SHOP_RATE_KEYS = tuple((key,) for key in SHOP_RATE_KEYS)

FIRST_USER_COUNTS = {
    "user_day_sum": ("user_id", "day_idx"),
    "user_day_hour_sum": ("user_id", "day_idx", "hour"),
    "user_day_hour_minute_sum": ("user_id", "day_idx", "hour", "minute"),
    "user_day_item_sum": ("user_id", "day_idx", "item_id"),
    "user_day_hour_item_sum": ("user_id", "day_idx", "hour", "item_id"),
    "user_day_brand_sum": ("user_id", "day_idx", "item_brand_id"),
    "user_day_price_sum": ("user_id", "day_idx", "item_price_level"),
    "user_day_sales_sum": ("user_id", "day_idx", "item_sales_level"),
    "user_day_shop_sum": ("user_id", "day_idx", "shop_id"),
}

FIRST_KINDS = {
    "user_day_item_kind": (("user_id", "day_idx"), "item_id"),
    "user_day_brand_kind": (("user_id", "day_idx"), "item_brand_id"),
    "user_day_price_kind": (("user_id", "day_idx"), "item_price_level"),
    "user_day_que_sum": (("user_id", "day_idx"), "predict_category_property"),
}

FIRST_MEANS = {"item_id_user_age_level_mean": ("item_id", "user_age_level")}

FIRST_EXCLUDED = frozenset(
    (
        "cate_0", "context_id", "context_timestamp", "ts", "day", "day_idx", "instance_id", "is_trade",
        "item_category_list", "item_property_list", "predict_category_property", "user_id", "later_gap",
    )
)

# the rate-table dump: the same rates without the hour
DUMP_ITEM_RATE_KEYS = FIRST_ITEM_RATE_KEYS[:-1]

# ---- rolling baseline ------------------------------------------------------------------------

_USER_RATES = {
    "user": "user_id", "gender": "user_gender_id", "age": "user_age_level",
    "occupation": "user_occupation_id", "star": "user_star_level",
}

ROLLING_RATES: dict[str, tuple[str, ...]] = {}
for _name, _key in _USER_RATES.items():
    ROLLING_RATES[_name] = (_key,)
    ROLLING_RATES[f"{_name}_hour"] = (_key, "hour")
ROLLING_RATES |= {
    "item": ("item_id",),
    "item_hour": ("item_id", "hour"),
    "brand": ("item_brand_id",),
    "brand_hour": ("item_brand_id", "hour"),
    "brand_price": ("item_brand_id", "item_price_level"),
    "brand_city": ("item_brand_id", "item_city_id"),
    "price": ("item_price_level",),
    "item_city": ("item_id", "item_city_id"),
    "item_city_hour": ("item_id", "item_city_id", "hour"),
    "collected": ("item_collected_level",),
    "collected_brand": ("item_collected_level", "item_brand_id"),
    "sales": ("item_sales_level",),
    "page": ("context_page_id",),
    "review": ("shop_review_num_level",),
    "user_shop": ("user_id", "shop_id"),
    "user_star": ("user_id", "shop_star_level"),
    "occup_cate": ("user_occupation_id", "category_1"),
    "occup_brand": ("user_occupation_id", "item_brand_id"),
    "occup_city": ("user_occupation_id", "item_city_id"),
    "occup_price": ("user_occupation_id", "item_price_level"),
    "occup_collected": ("user_occupation_id", "item_collected_level"),
    "age_cate": ("user_age_level", "category_1"),
    "age_brand": ("user_age_level", "item_brand_id"),
    "age_price": ("user_age_level", "item_price_level"),
    "age_city": ("user_age_level", "item_city_id"),
    "user_item": ("user_id", "item_id"),
    "user_item_hour": ("user_id", "item_id", "hour"),
    "user_brand": ("user_id", "item_brand_id"),
    "user_price": ("user_id", "item_price_level"),
    "user_city": ("user_id", "item_city_id"),
    "user_pv": ("user_id", "item_pv_level"),
    "user_collected": ("user_id", "item_collected_level"),
    "user_category": ("user_id", "category_1"),
}

ROLLING_COUNTS = {
    "user_day_click_count": (("user_id", "day_idx"), "item_id"),
    "user_i_day_click_count": (("user_id", "day_idx", "item_id"), "is_trade"),
    "user_b_day_click_count": (("user_id", "day_idx", "item_brand_id"), "is_trade"),
    "user_s_day_click_count": (("user_id", "day_idx", "shop_id"), "is_trade"),
    "i_day_click_count": (("day_idx", "item_id"), "is_trade"),
    "b_day_click_count": (("day_idx", "item_brand_id"), "is_trade"),
    "s_day_click_count": (("day_idx", "shop_id"), "is_trade"),
}

ROLLING_MEANS = {
    "user_price_mean": ("user_id", "item_price_level"),
    "user_sales_mean": ("user_id", "item_sales_level"),
    "user_collectes_mean": ("user_id", "item_collected_level"),
    "user_pv_mean": ("user_id", "item_pv_level"),
    "user_review_mean": ("user_id", "shop_review_positive_rate"),
    "item_age_mean": ("item_id", "user_age_level"),
    "brand_age_mean": ("item_brand_id", "user_age_level"),
    "cate1_age_mean": ("category_1", "user_age_level"),
    "shop_age_mean": ("shop_id", "user_age_level"),
    "item_sex_mean": ("item_id", "user_gender_id"),
    "brand_sex_mean": ("item_brand_id", "user_gender_id"),
    "cate1_sex_mean": ("category_1", "user_gender_id"),
    "shop_sex_mean": ("shop_id", "user_gender_id"),
}

# absolute difference -> (difference, column, mean)
ROLLING_DEVIATIONS = {
    "item_age_abs": ("item_age_cha", "user_age_level", "item_age_mean"),
    "brand_age_abs": ("brand_age_cha", "user_age_level", "brand_age_mean"),
    "category_1_age_abs": ("category_1_age_cha", "user_age_level", "cate1_age_mean"),
    "shop_age_abs": ("shop_age_cha", "user_age_level", "shop_age_mean"),
    "item_price_abs": ("item_price_cha", "item_price_level", "user_price_mean"),
    "item_sales_abs": ("item_sales_cha", "item_sales_level", "user_sales_mean"),
    "item_collected_abs": ("item_collected_cha", "item_collected_level", "user_collectes_mean"),
    "item_pv_abs": ("item_pv_cha", "item_pv_level", "user_pv_mean"),
}

ROLLING_DAYS = 9
ROLLING_ONE_HOT = ("user_gender_id", "user_occupation_id")

ROLLING_EXCLUDED = frozenset(
    (
        "category_0", "category_1", "category_2", "user_id", "instance_id", "is_trade", "context_timestamp",
        "ts", "day", "day_idx", "user_gender_id", "user_occupation_id", "predict_category_0",
        "predict_category_1", "predict_category_2", "predict_category_property", "property_0", "property_1",
        "property_2",
    )
)

# features that look ahead within the row's own day, by design of the original
USES_FUTURE_WITHIN_DAY = frozenset(
    (
        "later_time_cha", "later_gap", "if_czxtdj", "user_day_last_time_cha", "user_day_time_duration",
        "same_item_last_time_cha", "same_shop_last_time_cha", "if_user_day_last_look", "if_last",
        "if_user_shop_last", "user_rest_clk", "user_item_rest_clk", "user_shop_rest_clk", "user_brand_rest_clk",
    )
)

# ---- boosters (fixed values) -----------------------------------------------------------------

FINAL_BOOSTER = Booster(rounds=1397, depth=4, rate=0.02, row_share=0.9, column_share=0.6)
TRANSFER_BOOSTER = Booster(rounds=1304, depth=5, rate=0.02, column_share=0.7)
OFFLINE_BOOSTER = Booster(rounds=10_000, depth=5, rate=0.02, row_share=0.8, column_share=0.9)
ROLLING_BOOSTER = Booster(rounds=100_000, depth=5, rate=0.02, column_share=0.7, min_rows=100)
SMALL_BOOSTER = Booster(rounds=110, depth=4, rate=0.1)
# the second model of the day experiment
SECOND_BOOSTER = Booster(rounds=97, depth=5, rate=0.1)
# one trial of the greedy selection: the defaults of the original's library
TRIAL_BOOSTER = Booster(rounds=100, depth=3, rate=0.1)
