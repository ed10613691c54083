"""The same queries as SQL over the raw tables, written independently of the Spark code.

Ordered features use plain windows over the clicks, as-of features a join on earlier days.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from clickloom.operators import smoothing
from clickloom.operators.counts import bucket_name, cross_counts, day_hour_counts
from clickloom.operators.history import key_name
from clickloom.operators.keyed import as_keys
from clickloom.plans import presets
from clickloom.plans.catalogue import PRIOR_KEYS, PRIOR_STEPS, ROLLING_TARGETS, TARGET
from clickloom.sources.click_log import CLICK_LOG

RAW = """
raw_log AS (
  SELECT event_id AS instance_id, k AS item_id,
    CASE WHEN k % 2 = 0 THEN '7;' || CAST(k % 7 AS VARCHAR) || ';' || CAST(k % 3 AS VARCHAR)
         ELSE '7;' || CAST(k % 7 AS VARCHAR) END AS item_category_list,
    CAST(k AS VARCHAR) || ';' || CAST(k % 11 AS VARCHAR) || ';' || CAST(k % 13 AS VARCHAR) AS item_property_list,
    k % 10 AS item_brand_id, k % 5 AS item_city_id,
    CAST(least(floor(value / 10), 20) AS INT) AS item_price_level,
    k % 12 AS item_sales_level, k % 13 AS item_collected_level, k % 15 AS item_pv_level,
    user_id, CAST(user_id % 3 AS INT) AS user_gender_id, CAST(user_id % 8 AS INT) AS user_age_level,
    CAST(user_id % 4 AS INT) AS user_occupation_id, CAST(user_id % 11 AS INT) AS user_star_level,
    event_id AS context_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS context_timestamp,
    CAST(event_id % 20 AS INT) AS context_page_id,
    CASE WHEN event_id % 20 = 0 THEN '-1'
         ELSE CAST(k % 7 AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ',' || CAST(k % 11 AS VARCHAR) || ';'
           || CAST(user_id % 7 AS VARCHAR) || ':' || CAST(k % 5 AS VARCHAR) END AS predict_category_property,
    k % 25 AS shop_id, (k % 25) % 6 AS shop_review_num_level, (k % 25) / 25.0::DOUBLE AS shop_review_positive_rate,
    (k % 25) % 4 AS shop_star_level, ((k % 25) % 8) / 8.0::DOUBLE AS shop_score_service,
    ((k % 25) % 5) / 5.0::DOUBLE AS shop_score_delivery, ((k % 25) % 10) / 10.0::DOUBLE AS shop_score_description,
    CAST(event_type = 'purchase' AS INT) AS is_trade
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""

LOG = RAW + """,
log AS MATERIALIZED (
  SELECT *, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day_idx,
    day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute,
    hour(ts) * 2 + minute(ts) // 30 AS hour_2, hour(ts) * 4 + minute(ts) // 15 AS hour_4,
    hour(ts) * 6 + minute(ts) // 10 AS hour_6, hour(ts) * 12 + minute(ts) // 5 AS hour_12,
    cate_1 AS category_1
  FROM (
    SELECT *, make_timestamp(context_timestamp * 1000000) AS ts,
      coalesce(try_cast(split_part(item_category_list, ';', 1) AS BIGINT), -1) AS cate_0,
      coalesce(try_cast(split_part(item_category_list, ';', 2) AS BIGINT), -1) AS cate_1,
      coalesce(try_cast(split_part(item_category_list, ';', 3) AS BIGINT), -1) AS cate_2,
      coalesce(try_cast(split_part(split_part(predict_category_property, ';', 1), ':', 1) AS BIGINT), -1) AS pre_0,
      coalesce(try_cast(split_part(split_part(predict_category_property, ';', 2), ':', 1) AS BIGINT), -1) AS pre_1,
      coalesce(try_cast(split_part(split_part(predict_category_property, ';', 3), ':', 1) AS BIGINT), -1) AS pre_2
    FROM raw_log
  )
)"""

HOURLY = LOG + """,
hourly AS MATERIALIZED (SELECT * REPLACE (context_timestamp - context_timestamp % 3600 AS context_timestamp) FROM log)"""

ASSEMBLED = LOG + f""",
assembled AS MATERIALIZED (
  SELECT * REPLACE (CASE day_idx WHEN {TARGET - 1} THEN -1 WHEN {TARGET} THEN -2 ELSE is_trade END AS is_trade) FROM log
)"""

SCORED = """,
scored AS (
  SELECT *, (instance_id * 37 % 1000 + 0.5::DOUBLE) / 1001 AS one, (instance_id * 53 % 997 + 0.5::DOUBLE) / 998 AS two
  FROM {source}
)"""

STAR = """
star AS MATERIALIZED (
  SELECT l_orderkey AS context_id, o_custkey AS user_id, l_partkey AS item_id, p_brand AS item_brand_id,
    CAST(floor((p_retailprice - 900) / 10) AS INT) AS item_price_level, p_size AS item_sales_level, p_type AS cate_1,
    l_suppkey AS shop_id, s_nationkey AS shop_star_level, c_mktsegment AS user_occupation_id, c_nationkey AS user_age_level,
    date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS day_idx, CAST(l_returnflag = 'R' AS INT) AS is_trade
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

DOUBLES = frozenset(f.name for f in CLICK_LOG.fields if f.dataType.typeName() == "double")
TEXTS = frozenset(f.name for f in CLICK_LOG.fields if f.dataType.typeName() == "string")


def big(expression: str, name: str | None = None) -> str:
    return f"CAST({expression} AS BIGINT) AS {name or expression}"


def real(expression: str, name: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) AS {name or expression}"


def plain(column: str) -> str:
    if column in TEXTS:
        return column
    return real(column) if column in DOUBLES else big(column)


def select(columns: Iterable[str], source: str, ctes: str = LOG, where: str = "") -> str:
    return f"WITH {ctes}\nSELECT {', '.join(columns)}\nFROM {source} {where}"


def counts(named: Mapping[str, Iterable[str]]) -> list[str]:
    return [big(f"count(*) OVER (PARTITION BY {', '.join(as_keys(keys))})", name) for name, keys in named.items()]


class Joins:
    """Collects one aggregate per key set, to be left-joined to the rows ``e``."""

    def __init__(self, rows: str, ctes: str = LOG, ids: Iterable[str] = ("instance_id",)):
        self.rows, self.ctes, self.ids = rows, ctes, list(ids)
        self.joins: list[str] = []
        self.columns: list[str] = []

    def join(self, keys: Iterable[str], aggregate: str) -> str:
        alias = f"j{len(self.joins)}"
        on = " AND ".join(f"e.{k} = {alias}.{k}" for k in as_keys(keys))
        self.joins.append(f"LEFT JOIN ({aggregate}) {alias} ON {on}")
        return alias

    def group(self, keys: Iterable[str], aggregates: str, source: str) -> str:
        by = ", ".join(as_keys(keys))
        return self.join(keys, f"SELECT {by}, {aggregates} FROM {source} GROUP BY {by}")

    def asof(self, keys: Iterable[str], daily: str, total: str, source: str, days: int | None = None) -> str:
        """Aggregates ``total`` of the daily rows ``d`` of earlier days; ``daily`` defines those rows."""
        keys = as_keys(keys)
        by = ", ".join(keys)
        same = " AND ".join(f"a.{k} = d.{k}" for k in keys)
        back = "" if days is None else f" AND d.day_idx >= a.day_idx - {days}"
        picked = ", ".join(f"a.{k}" for k in (*keys, "day_idx"))
        return self.join(
            (*keys, "day_idx"),
            f"SELECT {picked}, {total} FROM (SELECT DISTINCT {by}, day_idx FROM {source}) a "
            f"JOIN (SELECT {by}, day_idx, {daily} FROM {source} GROUP BY {by}, day_idx) d "
            f"ON {same} AND d.day_idx < a.day_idx{back} GROUP BY {picked}",
        )

    def sql(self, where: str = "") -> str:
        ids = [big(f"e.{i}", i) if i not in TEXTS else f"e.{i}" for i in self.ids]
        return f"WITH {self.ctes}\nSELECT {', '.join([*ids, *self.columns])}\nFROM {self.rows} e\n" + "\n".join(self.joins) + f"\n{where}"


OUTCOMES = "count(*) FILTER (is_trade IN (0, 1)) AS n, count(*) FILTER (is_trade = 1) AS b"
TOTALS = "CAST(sum(d.n) AS DOUBLE) AS n, CAST(sum(d.b) AS DOUBLE) AS b"


def add_history(joins: Joins, key_sets, source: str) -> None:
    for keys in key_sets:
        name, a = key_name(keys), joins.group(keys, OUTCOMES, source)
        joins.columns += [big(f"{a}.n", f"{name}_sum"), big(f"{a}.b", f"{name}_buy"), real(f"{a}.b / {a}.n", f"{name}_cvr")]


def add_asof(joins: Joins, key_sets, source: str, per_day: bool = False) -> None:
    days = ""
    if per_day:
        earlier = joins.join("day_idx", f"SELECT day_idx, row_number() OVER (ORDER BY day_idx) - 1 AS n FROM (SELECT DISTINCT day_idx FROM {source})")
        days = f"{earlier}.n"
    for keys in key_sets:
        name, a = key_name(keys), joins.asof(keys, OUTCOMES, TOTALS, source)
        if per_day:
            joins.columns += [
                real(f"CASE WHEN {a}.n > 0 THEN {a}.n / {days} END", f"{name}_sum"),
                real(f"CASE WHEN {a}.n > 0 THEN {a}.b / {days} END", f"{name}_buy"),
            ]
        else:
            joins.columns += [
                big(f"CASE WHEN {a}.n > 0 THEN {a}.n END", f"{name}_sum"),
                big(f"CASE WHEN {a}.n > 0 THEN {a}.b END", f"{name}_buy"),
            ]
        joins.columns.append(real(f"CASE WHEN {a}.n > 0 THEN {a}.b / {a}.n END", f"{name}_cvr"))


def add_rates(joins: Joins, named, alias_of) -> None:
    for name, keys in named.items():
        a = alias_of(keys)
        joins.columns += [
            big(f"coalesce({a}.n, 0)", f"{name}_count"),
            big(f"coalesce({a}.b, 0)", f"{name}_sum"),
            real(f"CASE WHEN {a}.n > 0 THEN CAST({a}.b AS DOUBLE) / {a}.n ELSE 1 END", f"{name}_rate"),
        ]


def add_asof_means(joins: Joins, named, source: str, days: int | None = None) -> dict[str, str]:
    values = {}
    for name, (keys, attribute) in named.items():
        a = joins.asof(keys, f"sum({attribute}) AS s, count({attribute}) AS c", "CAST(sum(d.s) AS DOUBLE) / sum(d.c) AS m", source, days)
        values[name] = f"{a}.m"
        joins.columns.append(real(f"{a}.m", name))
    return values


def add_means(joins: Joins, named, source: str) -> None:
    for name, (keys, attribute) in named.items():
        joins.columns.append(real(f"{joins.group(keys, f'avg({attribute}) AS m', source)}.m", name))


def add_deviations(joins: Joins, means: Mapping[str, str]) -> None:
    for absolute, (difference, column, mean) in presets.ROLLING_DEVIATIONS.items():
        joins.columns += [real(f"e.{column} - {means[mean]}", difference), real(f"abs(e.{column} - {means[mean]})", absolute)]


def add_first_seen(joins: Joins, named, source: str) -> None:
    for name, key in named.items():
        a = joins.group(key, "count(*) AS n", source)
        joins.columns.append(big(f"CASE WHEN {a}.n IS NULL THEN 1 ELSE 0 END", name))


def add_distinct(joins: Joins, named, source: str) -> None:
    for name, (keys, value) in named.items():
        joins.columns.append(big(f"{joins.group(keys, f'count(DISTINCT {value}) AS n', source)}.n", name))


T = "context_timestamp"


def over(*keys: str, order: str = "") -> str:
    return f"OVER (PARTITION BY {', '.join(keys)}{' ORDER BY ' + order if order else ''})"


def gaps(later_compat: bool = True) -> list[str]:
    w = over("user_id", "day_idx", order=f"{T}, instance_id")
    same = f"count(*) {over('user_id', 'day_idx', T)}"
    columns = [
        big(f"{T} - lag({T}) {w}", "former_time_cha"),
        big(f"lead({T}) {w} - {T}", "later_gap"),
        big(f"CASE WHEN {same} > 1 THEN 1 ELSE 0 END", "if_czxtdj"),
    ]
    if later_compat:
        gap = f"(lead({T}) {w} - {T})"
        columns.append(big(f"CASE WHEN {gap} = 0 THEN 0 ELSE {gap} - 86400 END", "later_time_cha"))
    return columns


def since(name: str, *keys: str) -> str:
    return big(f"({T} - min({T}) {over(*keys)}) % 86400", name)


def until(name: str, *keys: str) -> str:
    return big(f"(max({T}) {over(*keys)} - {T}) % 86400", name)


def span(name: str, *keys: str) -> str:
    return big(f"(max({T}) {over(*keys)} - min({T}) {over(*keys)}) % 86400", name)


def first_flag(name: str, *keys: str) -> str:
    return big(f"CASE WHEN {T} = min({T}) {over(*keys)} THEN 1 ELSE 0 END", name)


def last_flag(name: str, *keys: str) -> str:
    return big(f"CASE WHEN {T} = max({T}) {over(*keys)} THEN 1 ELSE 0 END", name)


def flag_difference(name: str, *keys: str) -> str:
    return big(f"(CASE WHEN {T} = max({T}) {over(*keys)} THEN 1 ELSE 0 END) - (CASE WHEN {T} = min({T}) {over(*keys)} THEN 1 ELSE 0 END)", name)


def ranks(rest: bool = False, dense: bool = False) -> list[str]:
    columns = []
    for name, keys in presets.FINAL_RANKS.items():
        w = over(*keys, order=T)
        if dense:
            columns.append(big(f"dense_rank() {w}", f"{name}_time_rank"))
            continue
        columns.append(big(f"rank() {w}", f"{name}_rank"))
        if rest:
            columns.append(big(f"count(*) {over(*keys)} - rank() {w}", f"{name}_rest_clk"))
    return columns


def prev_next(keys: Iterable[str], prefix: str = "", rank: str = "time_rank") -> list[str]:
    """Over the next and previous distinct time, found by a range frame that leaves out the row's own time."""
    by = f"PARTITION BY {', '.join(keys)} ORDER BY {T}"
    ahead = f"(min({T}) OVER ({by} RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - {T})"
    behind = f"({T} - max({T}) OVER ({by} RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
    return [
        big(f"{ahead} // 86400", f"{prefix}days_1"), big(f"{ahead} % 86400", f"{prefix}second_1"),
        big(f"{behind} // 86400", f"{prefix}days_2"), big(f"{behind} % 86400", f"{prefix}second_2"),
        big(f"dense_rank() OVER ({by})", rank),
    ]


def buckets(keys: Iterable[str]) -> list[str]:
    columns = []
    for key in keys:
        for bins in (1, 2, 4, 6, 12):
            unit = "hour" if bins == 1 else f"hour_{bins}"
            columns += counts({bucket_name(key, bins): (key, unit)})
    return columns


def final_ordered() -> list[str]:
    user, day, item = ("user_id",), ("user_id", "day_idx"), ("user_id", "day_idx", "item_id")
    return [
        *gaps(),
        since("user_day_first_time_cha", *day), until("user_day_last_time_cha", *day), span("user_day_time_duration", *day),
        since("same_item_first_time_cha", *item), until("same_item_last_time_cha", *item),
        first_flag("if_user_day_first_look", *user), last_flag("if_user_day_last_look", *user),
        first_flag("if_first", "user_id", "item_id"), last_flag("if_last", "user_id", "item_id"),
        last_flag("if_user_shop_last", "user_id", "shop_id"), *ranks(rest=True),
    ]


HISTORY = f"(SELECT * FROM log WHERE day_idx < {TARGET})"
KNOWN_HISTORY = f"(SELECT * FROM log WHERE day_idx < {TARGET} AND is_trade IN (0, 1))"
RECENT = f"(SELECT * FROM log WHERE day_idx BETWEEN {TARGET - 9} AND {TARGET - 1})"
NOW = f"(SELECT * FROM log WHERE day_idx = {TARGET})"


def final_stage_features() -> str:
    ctes = LOG + SCORED.format(source="log") + f""",
now AS MATERIALIZED (SELECT * FROM log WHERE day_idx = {TARGET}),
wide AS MATERIALIZED (SELECT instance_id, {', '.join(['hour_2', 'hour_4', 'hour_6', 'hour_12', *buckets(presets.FINAL_BUCKET_KEYS), *counts(presets.FINAL_TOTALS), *counts(presets.FINAL_USER_PAIRS), *final_ordered()])} FROM now)"""
    joins = Joins("now", ctes)
    w = joins.join("instance_id", "SELECT * FROM wide")
    joins.columns.append(f"{w}.* EXCLUDE (instance_id, hour_2, hour_4, hour_6, hour_12)")
    joins.columns += [big(f"{w}.{c}", c) for c in ("hour_2", "hour_4", "hour_6", "hour_12")]
    s = joins.join("instance_id", "SELECT instance_id, one FROM scored")
    joins.columns.append(real(f"{s}.one", "predicted_score"))
    add_history(joins, [*presets.FINAL_HISTORY, *presets.FINAL_HISTORY_PAIRS], KNOWN_HISTORY)
    add_first_seen(joins, presets.FIRST_SEEN, HISTORY)
    add_means(joins, presets.FINAL_MEANS, HISTORY)
    add_distinct(joins, presets.FINAL_HEAT, "now")
    return joins.sql()


def first_stage_features() -> str:
    day = ("user_id", "day_idx")
    item, cate, shop = (*day, "item_id"), (*day, "cate_1"), (*day, "shop_id")
    named = {
        **day_hour_counts([*presets.FIRST_ITEM_COUNT_KEYS, *presets.USER_LEVELS, *presets.SHOP_KEYS]),
        **presets.FIRST_USER_COUNTS, **cross_counts(presets.USER_LEVELS, presets.ITEM_LEVELS),
    }
    wide = [
        *counts(named), *gaps(),
        since("user_day_first_time_cha", *day), until("user_day_last_time_cha", *day), span("user_day_time_duration", *day),
        since("same_item_first_time_cha", *item), until("same_item_last_time_cha", *item),
        since("same_cate_first_time_cha", *cate),
        since("same_shop_first_time_cha", *shop), until("same_shop_last_time_cha", *shop),
        first_flag("if_user_day_first_look", *day), last_flag("if_user_day_last_look", *day),
        first_flag("if_first", *item), last_flag("if_last", *item),
    ]
    joins = Joins("log", LOG + f",\nwide AS (SELECT instance_id, {', '.join(wide)} FROM log)")
    w = joins.join("instance_id", "SELECT * FROM wide")
    joins.columns.append(f"{w}.* EXCLUDE (instance_id)")
    add_distinct(joins, presets.FIRST_KINDS, "log")
    add_asof(joins, [*presets.FIRST_ITEM_RATE_KEYS, *presets.FIRST_USER_RATE_KEYS, *presets.FIRST_PAIR_RATE_KEYS, *presets.FIRST_SHOP_RATE_KEYS], "log", per_day=True)
    add_asof_means(joins, presets.FIRST_MEANS, "log")
    return joins.sql()


def build_day_features() -> str:
    day = ("user_id", "day_idx")
    today = []
    for name, (keys, target) in presets.ROLLING_COUNTS.items():
        today.append(big(f"count({target}) {over(*keys)}", name))
    rank = f"(rank() {over(*day, order=T)} + (count(*) {over(*day, T)} - 1) / 2.0)"
    wide = [
        *prev_next(["user_id"]), *today, real(rank, "today_time_rank"), last_flag("all_last_click", *day),
        flag_difference("last_click", *day, "item_id"), first_flag("first_click", *day, "item_id"),
    ]
    joins = Joins("log", LOG + f",\nwide AS (SELECT instance_id, {', '.join(wide)} FROM log)", ids=("instance_id", "day_idx"))
    w = joins.join("instance_id", "SELECT * FROM wide")
    joins.columns.append(f"{w}.* EXCLUDE (instance_id)")
    add_deviations(joins, add_asof_means(joins, presets.ROLLING_MEANS, "log", 9))
    for name, key in presets.FIRST_SEEN.items():
        a = joins.asof(key, "count(*) AS n", "sum(d.n) AS n", "log", 9)
        joins.columns.append(big(f"CASE WHEN {a}.n IS NULL THEN 1 ELSE 0 END", name))
    add_rates(joins, presets.ROLLING_RATES, lambda keys: joins.asof(keys, OUTCOMES, TOTALS, "log", 9))
    return joins.sql(f"WHERE e.day_idx IN ({', '.join(map(str, ROLLING_TARGETS))})")


def fixed_steps(per_key: str, groups: Iterable[str], steps: int) -> str:
    """CTEs that end in ``fitted``: alpha, beta and the pooled rate of each group, after some fixed-point steps from (1, 1).

    ``per_key`` selects the groups with each key's impressions ``i`` and conversions ``c``. The difference of digamma between
    v + x and x is the sum of 1 / (x + j) over j < v.
    """
    by = ", ".join(groups)
    on = " AND ".join(["true", *[f"p.{g} = h.{g}" for g in groups]])
    picked = ", ".join([f"h.{g}" for g in groups])
    lead, trail = (f"{by}, " if by else ""), (f" GROUP BY {picked}" if by else "")

    def gain(value: str, at: str) -> str:
        return f"sum(h.n * coalesce(list_sum(list_transform(range({value}), lambda j: 1.0::DOUBLE / ({at} + j))), 0))"

    ctes = [
        f"per_key AS ({per_key})",
        f"hist AS MATERIALIZED (SELECT {lead}i, c, count(*) AS n FROM per_key GROUP BY {lead}i, c)",
        f"step_0 AS (SELECT {lead}1.0::DOUBLE AS a, 1.0::DOUBLE AS b, sum(n * c) / sum(n * i)::DOUBLE AS pooled, sum(n * c) > 0 AND sum(n * (i - c)) > 0 AS finite FROM hist{' GROUP BY ' + by if by else ''})",
    ]
    for k in range(steps):
        whole = gain("h.i", "p.a + p.b")
        ctes.append(
            f"step_{k + 1} AS MATERIALIZED (SELECT {picked + ', ' if by else ''}any_value(p.a) * {gain('h.c', 'p.a')} / {whole} AS a, any_value(p.b) * {gain('h.i - h.c', 'p.b')} / {whole} AS b, "
            f"any_value(p.pooled) AS pooled, any_value(p.finite) AS finite FROM hist h JOIN step_{k} p ON {on}{trail})"
        )
    ctes.append(f"fitted AS (SELECT {lead}CASE WHEN finite THEN a END AS alpha, CASE WHEN finite THEN b END AS beta, pooled, CASE WHEN finite THEN {steps} ELSE 0 END AS steps FROM step_{steps})")
    return ",\n".join(ctes)


def day_fits() -> str:
    """``fitted`` for each key set and day of the assembled log."""
    parts = []
    for keys in map(as_keys, PRIOR_KEYS):
        by = ", ".join(f"l.{k}" for k in keys)
        parts.append(
            f"SELECT '{key_name(keys)}' AS key_set, d.day_idx, count(*) AS i, count(*) FILTER (l.is_trade = 1) AS c FROM (SELECT DISTINCT day_idx FROM assembled) d "
            f"JOIN assembled l ON l.day_idx < d.day_idx AND l.is_trade IN (0, 1) GROUP BY d.day_idx, {by}"
        )
    return ASSEMBLED + ",\n" + fixed_steps("\nUNION ALL ".join(parts), ("key_set", "day_idx"), PRIOR_STEPS)


def smoothed_by_day() -> str:
    joins = Joins("assembled", day_fits())
    for keys in map(as_keys, PRIOR_KEYS):
        name, a = key_name(keys), joins.asof(keys, OUTCOMES, TOTALS, "assembled")
        f = joins.join("day_idx", f"SELECT * FROM fitted WHERE key_set = '{name}'")
        rate = f"(coalesce({a}.b, 0) + {f}.alpha) / (coalesce({a}.n, 0) + {f}.alpha + {f}.beta)"
        joins.columns += [big(f"nullif({a}.n, 0)", f"{name}_sum"), real(f"coalesce({rate}, {f}.pooled)", f"{name}_cvr")]
    return joins.sql()


def fitted_steps() -> str:
    per_key = f"SELECT count(*) AS i, count(*) FILTER (is_trade = 1) AS c FROM {KNOWN_HISTORY} GROUP BY item_id"
    joins = Joins(NOW, LOG + ",\n" + fixed_steps(per_key, (), PRIOR_STEPS))
    a = joins.group("item_id", OUTCOMES, KNOWN_HISTORY)
    rate = f"(coalesce({a}.b, 0) + f.alpha) / (coalesce({a}.n, 0) + f.alpha + f.beta)"
    joins.columns += [big(f"{a}.n", "I"), big(f"{a}.b", "C"), real(f"coalesce({rate}, f.pooled)", "item_id_buy_smooth")]
    joins.joins.append("CROSS JOIN fitted f")
    return joins.sql()


TEXT_PARTS = {
    **{f"category_{i}": f"split_part(item_category_list, ';', {i + 1})" for i in range(3)},
    **{f"property_{i}": f"split_part(item_property_list, ';', {i + 1})" for i in range(3)},
    **{f"predict_category_{i}": f"split_part(split_part(predict_category_property, ';', {i + 1}), ':', 1)" for i in range(3)},
}


def text_part(name: str) -> str:
    return f"CASE WHEN {TEXT_PARTS[name]} = '' THEN ' ' ELSE {TEXT_PARTS[name]} END AS {name}"


def statements() -> dict[str, str]:
    sql: dict[str, str] = {}
    raw_columns = [f.name for f in CLICK_LOG.fields]
    stamp = "strftime({}, '%Y-%m-%d %H:%M:%S')"

    # sources and sinks
    sql["read_click_log"] = select([plain(c) for c in raw_columns], "raw_log", RAW)
    sql["stage_roundtrip"] = select([plain(c) for c in ("instance_id", "day_idx", "hour", "user_id", "item_id", "cate_1", "is_trade")], "log")
    sql["write_scores"] = select(["instance_id", real("one", "predicted_score")], "scored", LOG + SCORED.format(source="log"))
    known = [f"SELECT CAST({i} AS BIGINT) AS position, '{name}' AS feature, CAST(count({name}) AS BIGINT) AS n_known FROM raw_log" for i, name in enumerate(raw_columns)]
    sql["feature_catalog"] = f"WITH {RAW}\n" + "\nUNION ALL ".join(known)
    sql["log_profile"] = select(
        [
            big("count(*)", "n_rows"), big("(SELECT count(*) FROM (SELECT DISTINCT * FROM raw_log))", "n_distinct"),
            big(str(len(raw_columns)), "n_columns"), big(f"min({T})", "first_time"), big(f"max({T})", "last_time"),
        ],
        "raw_log", RAW,
    )

    # parsing, time, assembly
    sql["parse_category"] = select([plain(c) for c in ("instance_id", "cate_0", "cate_1", "cate_2")], "log")
    sql["parse_predicted_category"] = select([plain(c) for c in ("instance_id", "pre_0", "pre_1", "pre_2")], "log")
    sql["parse_category_str"] = select(["instance_id", *[text_part(n) for n in TEXT_PARTS]], "raw_log", RAW)
    china = "(ts + INTERVAL 8 HOUR)"
    sql["time_parts"] = select(
        [
            "instance_id", f"{stamp.format('ts')} AS ts", *[big(c) for c in ("day_idx", "day", "hour", "minute")],
            f"{stamp.format(china)} AS china_ts", big(f"date_diff('day', DATE '2024-01-01', CAST({china} AS DATE))", "china_day_idx"),
            *[big(f"{part}({china})", f"china_{part}") for part in ("day", "hour", "minute")],
        ],
        "log",
    )
    shifted = "(ts + INTERVAL 1 DAY)"
    sql["shift_day"] = select(["instance_id", f"{stamp.format(shifted)} AS shifted", big(f"day({shifted})", "shifted_day")], "log")
    sql["time_buckets"] = select([big(c) for c in ("instance_id", "hour_2", "hour_4", "hour_6", "hour_12")], "log")
    sql["assemble_log"] = select([big(c) for c in ("instance_id", "day_idx", "is_trade")], "assembled", ASSEMBLED)
    sql["dedupe_log"] = select(
        [big(c) for c in ("instance_id", "user_id", "item_id", T, "is_trade")],
        "(SELECT * FROM raw_log UNION SELECT * FROM raw_log WHERE is_trade = 1)", RAW,
    )
    joins = Joins(NOW)
    a = joins.group(("user_id", "item_id"), OUTCOMES, KNOWN_HISTORY)
    joins.columns = [
        big(f"coalesce({a}.n, -1)", "user_id_item_id_sum"), big(f"coalesce({a}.b, -1)", "user_id_item_id_buy"),
        real(f"coalesce({a}.b / {a}.n, -1)", "user_id_item_id_cvr"),
    ]
    sql["fill_nulls"] = joins.sql()
    prepared = [*raw_columns, "cate_0", "cate_1", "cate_2", "pre_0", "pre_1", "pre_2", "hour", "minute"]
    kept = [c for c in prepared if c not in presets.FINAL_EXCLUDED]
    sql["feature_select_cols"] = select(["instance_id", *[plain(c) for c in kept]], "log")
    sql["split_history_current"] = select(
        ["instance_id", f"CASE WHEN day_idx < {TARGET} THEN 'history' ELSE 'current' END AS part", big("day_idx")], "log", where=f"WHERE day_idx <= {TARGET}"
    )
    parts = {
        "hour_train": "is_trade >= 0 AND hour <= 7", "hour_test": "is_trade >= 0 AND hour > 7",
        "day_train": "day_idx >= 20 AND day_idx < 28", "day_test": "day_idx = 28",
        "recent": f"day_idx BETWEEN {TARGET - 9} AND {TARGET - 1}", "labelled": "is_trade >= 0", "unlabelled": "is_trade < 0",
    }
    sql["temporal_split"] = f"WITH {ASSEMBLED}\n" + "\nUNION ALL ".join(
        f"SELECT instance_id, '{part}' AS part FROM assembled WHERE {condition}" for part, condition in parts.items()
    )
    sql["semi_filter_scores"] = select(
        ["instance_id", real("one", "predicted_score")], "scored", LOG + SCORED.format(source="log"), f"WHERE day_idx = {TARGET}"
    )

    # counts
    sql["count_by_key"] = select(["instance_id", *counts(presets.FINAL_TOTALS)], "log")
    sql["count_by_pair"] = select(["instance_id", *counts(presets.FINAL_USER_PAIRS)], "log")
    sql["count_by_bucket"] = select(
        ["instance_id", *[big(c) for c in ("hour_2", "hour_4", "hour_6", "hour_12")], *buckets(presets.FINAL_BUCKET_KEYS)], "log"
    )
    day_hour = {**day_hour_counts([*presets.FIRST_ITEM_COUNT_KEYS, *presets.USER_LEVELS, *presets.SHOP_KEYS]), **presets.FIRST_USER_COUNTS}
    sql["count_by_day_hour"] = select(["instance_id", *counts(day_hour)], "log")
    sql["count_cross"] = select(["instance_id", *counts(cross_counts(presets.USER_LEVELS, presets.ITEM_LEVELS))], "log")
    sql["count_target"] = select(
        ["instance_id", *[big(f"count({target}) {over(*keys)}", name) for name, (keys, target) in presets.ROLLING_COUNTS.items()]], "log"
    )
    for name, named in {"heat_distinct": presets.FINAL_HEAT, "heat_distinct_daily": presets.FIRST_KINDS}.items():
        joins = Joins("log")
        add_distinct(joins, named, "log")
        sql[name] = joins.sql()

    # order in time
    day, item = ("user_id", "day_idx"), ("user_id", "day_idx", "item_id")
    windows = {
        "click_gaps": gaps(),
        "first_last_gap": [since("user_day_first_time_cha", *day), until("user_day_last_time_cha", *day), span("user_day_time_duration", *day)],
        "first_last_gap_item": [since("same_item_first_time_cha", *item), until("same_item_last_time_cha", *item)],
        "first_last_gap_category": [since("same_cate_first_time_cha", *day, "cate_1")],
        "first_last_gap_shop": [since("same_shop_first_time_cha", *day, "shop_id"), until("same_shop_last_time_cha", *day, "shop_id")],
        "first_last_flag": [
            first_flag("if_user_first", "user_id"), last_flag("if_user_last", "user_id"),
            first_flag("if_user_day_first_look", *day), last_flag("if_user_day_last_look", *day),
        ],
        "first_last_flag_item": [
            first_flag("if_first", "user_id", "item_id"), last_flag("if_last", "user_id", "item_id"),
            first_flag("if_day_first", *item), last_flag("if_day_last", *item),
        ],
        "last_flag_shop": [last_flag("if_user_shop_last", "user_id", "shop_id")],
        "first_minus_last_flag": [flag_difference("last_click", *item), first_flag("first_click", *item), last_flag("all_last_click", *day)],
        "remaining_clicks": ranks(rest=True),
        "prev_next_gap": prev_next(["user_id"]),
        "prev_next_gap_item": prev_next(["user_id", "item_id"], "item_", "item_time_rank"),
    }
    for name, columns in windows.items():
        sql[name] = select(["instance_id", *columns], "log")

    def dense(*keys: str) -> str:
        return f"dense_rank() {over(*keys, order=T)}"

    before = [big(dense("user_id"), "time_rank")]
    for label, key in {"cate": "cate_1", "shop": "shop_id", "item": "item_id", "brand": "item_brand_id"}.items():
        before += [
            big(dense("user_id", key), f"{label}_time_rank"),
            big(f"count(*) {over('user_id', key)} - {dense('user_id', key)}", f"{label}_count_rank_cha"),
        ]
    shop_ratio = real(f"CAST({dense('user_id', 'shop_id')} AS DOUBLE) / {dense('user_id')}", "shop_count_user_click_rate")
    cate_ratio = real(f"CAST({dense('user_id', 'cate_1')} AS DOUBLE) / {dense('user_id')}", "cate_count_user_click_rate")
    tied = {
        "click_gaps_tied": gaps(),
        "simultaneous_flag": [gaps()[2]],
        "click_rank": ranks(),
        "click_avg_rank": [real(f"rank() {over(*day, order=T)} + (count(*) {over(*day, T)} - 1) / 2.0", "today_time_rank")],
        "distinct_time_rank": ranks(dense=True),
        "rank_ratio": [big(dense("user_id"), "time_rank"), big(dense("user_id", "shop_id"), "shop_time_rank"), shop_ratio],
        "before_click_features": [*before, shop_ratio, cate_ratio],
    }
    for name, columns in tied.items():
        sql[name] = select(["instance_id", *columns], "hourly", HOURLY)

    # history
    for name, key_sets in {"history_cvr": presets.FINAL_HISTORY, "history_cvr_pair": presets.FINAL_HISTORY_PAIRS}.items():
        joins = Joins(NOW)
        add_history(joins, key_sets, KNOWN_HISTORY)
        sql[name] = joins.sql()
    joins = Joins("assembled", ASSEMBLED)
    add_asof(joins, [*presets.FIRST_ITEM_RATE_KEYS, *presets.FIRST_USER_RATE_KEYS], "assembled", per_day=True)
    sql["asof_cvr"] = joins.sql()
    joins = Joins("assembled", ASSEMBLED)
    add_asof(joins, presets.FIRST_PAIR_RATE_KEYS, "assembled")
    sql["asof_cvr_pair"] = joins.sql()
    joins = Joins("log")
    rolling = {"user": ("user_id",), "item": ("item_id",), "item_hour": ("item_id", "hour"), "occup_brand": ("user_occupation_id", "item_brand_id")}
    add_rates(joins, rolling, lambda keys: joins.asof(keys, OUTCOMES, TOTALS, "log", 9))
    sql["rolling_history_rate"] = joins.sql()
    rates = Joins(NOW)
    add_rates(rates, presets.ROLLING_RATES, lambda keys: rates.group(keys, OUTCOMES, RECENT))
    sql["rate_feature"] = rates.sql()
    joins = Joins(NOW)
    add_means(joins, presets.FINAL_MEANS, HISTORY)
    sql["history_mean"] = joins.sql()
    joins = Joins("log")
    add_asof_means(joins, {**presets.FIRST_MEANS, "user_id_item_price_level_mean": ("user_id", "item_price_level")}, "log")
    sql["asof_mean"] = joins.sql()
    joins = Joins("log")
    add_deviations(joins, add_asof_means(joins, presets.ROLLING_MEANS, "log", 9))
    sql["mean_deviation"] = joins.sql()
    joins = Joins("log")
    for name, keys in {"cate": ("user_id", "cate_1"), "shop": ("user_id", "shop_id")}.items():
        a = joins.asof(keys, OUTCOMES, TOTALS, "log", 1)
        joins.columns += [big(f"{a}.n", f"yes_{name}_count"), big(f"{a}.b", f"yes_{name}_sum")]
    sql["yesterday_activity"] = joins.sql()
    joins = Joins(NOW)
    add_first_seen(joins, {**presets.FIRST_SEEN, "pair_first_apper": ("user_id", "item_id")}, HISTORY)
    sql["first_appearance"] = joins.sql()

    # smoothing
    joins = Joins(NOW)
    add_distinct(joins, presets.FINAL_HEAT, RECENT)
    sql["heat_days"] = joins.sql()
    broken = "CASE instance_id % 50 WHEN 1 THEN 'none' ELSE CAST(item_id AS VARCHAR) || '.5' END"
    sql["read_or_quarantine"] = (
        f"WITH {RAW}\nSELECT 'good' AS kind, CAST(item_brand_id AS VARCHAR) AS what, {big('count(*)', 'n')}, {big('sum(item_id)', 'item_ids')} FROM raw_log WHERE instance_id % 50 NOT IN (1, 2) GROUP BY item_brand_id "
        f"UNION ALL SELECT 'bad', 'item_id is no bigint: ' || {broken}, count(*), NULL FROM raw_log WHERE instance_id % 50 IN (1, 2) GROUP BY 2"
    )
    joins = Joins(NOW)
    add_history(joins, [*presets.FINAL_HISTORY, *presets.FINAL_HISTORY_PAIRS], KNOWN_HISTORY)
    add_means(joins, presets.FINAL_MEANS, HISTORY)
    sql["incremental_history"] = joins.sql()
    sql["smoothed_cvr_fitted_steps"] = fitted_steps()
    sql["day_priors_steps"] = f"WITH {day_fits()}\nSELECT key_set, {big('day_idx')}, {real('alpha')}, {real('beta')}, {real('pooled')}, {big('steps')} FROM fitted"
    sql["smoothed_cvr_by_day"] = smoothed_by_day()
    alpha, beta = smoothing.ALPHA, smoothing.BETA
    joins = Joins(NOW)
    for keys in ("item_id", "user_id", ("user_id", "item_id")):
        name, a = key_name(keys), joins.group(keys, OUTCOMES, KNOWN_HISTORY)
        joins.columns += [
            big(f"{a}.n", f"{name}_sum"), big(f"{a}.b", f"{name}_buy"),
            real(f"(coalesce({a}.b, 0) + {alpha}::DOUBLE) / (coalesce({a}.n, 0) + {alpha}::DOUBLE + {beta}::DOUBLE)", f"{name}_cvr"),
        ]
    sql["smoothed_cvr"] = joins.sql()
    priors = ", ".join(f"({d - 1}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for d, (a, b) in smoothing.DAY_PRIORS.items())
    joins = Joins("log", LOG + f",\npriors AS (SELECT * FROM (VALUES {priors}) v(day_idx, alpha, beta))")
    p = joins.join("day_idx", "SELECT * FROM priors")
    for key in ("item_id", "user_id"):
        a = joins.asof(key, OUTCOMES, TOTALS, "log")
        joins.columns += [
            real(f"CASE WHEN {p}.alpha IS NOT NULL AND {a}.n > 0 THEN {a}.n / e.day_idx END", f"{key}_sum"),
            real(f"(coalesce({a}.b, 0) + {p}.alpha) / (coalesce({a}.n, 0) + {p}.alpha + {p}.beta)", f"{key}_cvr"),
        ]
    sql["smoothed_cvr_asof"] = joins.sql()
    sql["prior_histogram"] = f"""WITH {LOG},
per_key AS (SELECT user_id, count(*) AS i, count(*) FILTER (is_trade = 1) AS c FROM log WHERE is_trade IN (0, 1) GROUP BY user_id)
SELECT kind, CAST(value AS BIGINT) AS value, CAST(count(*) AS BIGINT) AS keys FROM (
  SELECT 'I' AS kind, i AS value FROM per_key UNION ALL SELECT 'C', c FROM per_key UNION ALL SELECT 'M', i - c FROM per_key
) GROUP BY kind, value"""

    # encoding
    parts_of = {n: TEXT_PARTS[n] for n in TEXT_PARTS}
    first = parts_of["category_1"]
    match = " OR ".join(f"{first} = {parts_of[f'predict_category_{i}']}" for i in range(3))
    blank = "(" + f"{first} = '' AND " + "(" + " OR ".join(f"{parts_of[f'predict_category_{i}']} = ''" for i in range(3)) + "))"
    sql["category_match"] = select(["instance_id", big(f"CASE WHEN ({match}) OR {blank} THEN 1 ELSE 0 END", "cate_is_in_pre_cate")], "raw_log", RAW)
    sql["property_overlap"] = f"""WITH {RAW},
owned AS (SELECT DISTINCT instance_id, unnest(string_split(item_property_list, ';')) AS v FROM raw_log),
wanted AS (
  SELECT DISTINCT instance_id, unnest(string_split(split_part(part, ':', 2), ',')) AS v
  FROM (SELECT instance_id, unnest(string_split(predict_category_property, ';')) AS part FROM raw_log WHERE predict_category_property <> '-1')
),
hits AS (
  SELECT w.instance_id, count(*) AS n, count(o.v) AS h
  FROM (SELECT * FROM wanted WHERE v <> '-1' AND v <> '') w
  LEFT JOIN (SELECT * FROM owned WHERE v <> '-1') o ON o.instance_id = w.instance_id AND o.v = w.v GROUP BY w.instance_id
)
SELECT r.instance_id, round(coalesce(CAST(h AS DOUBLE) / n, 0), 6) AS pro_pre_rate FROM raw_log r LEFT JOIN hits USING (instance_id)"""
    hot = [big(f"CASE WHEN user_gender_id = {v} THEN 1 ELSE 0 END", f"user_gender_id{v}") for v in range(3)]
    hot += [big(f"CASE WHEN user_occupation_id = {v} THEN 1 ELSE 0 END", f"user_occupation_id{v}") for v in range(4)]
    sql["one_hot"] = select(["instance_id", *hot], NOW)

    sql["label_encode"] = f"""WITH {LOG},
cities AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT item_city_id AS v FROM log WHERE day_idx < {TARGET})),
lists AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT item_property_list AS v FROM log WHERE day_idx < {TARGET}))
SELECT instance_id, c.code AS item_city_id_code, l.code AS item_property_list_code FROM log
LEFT JOIN cities c ON c.v = item_city_id LEFT JOIN lists l ON l.v = item_property_list WHERE day_idx = {TARGET}"""

    # metrics and scores
    sql["positive_means"] = f"""WITH {LOG}
SELECT CAST(item_id AS BIGINT) AS item_id, round(avg(user_age_level) FILTER (is_trade = 1), 6) AS item_id_buy_user_age_level_mean,
  round(avg(shop_score_service) FILTER (is_trade = 1), 6) AS item_id_buy_shop_score_service_mean FROM log GROUP BY item_id"""
    log_scored, assembled_scored = LOG + SCORED.format(source="log"), ASSEMBLED + SCORED.format(source="assembled")
    sql["dominant_category"] = f"""WITH {LOG},
pairs AS (SELECT item_id, user_occupation_id AS c, count(*) AS n FROM log GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, c) AS r FROM pairs)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(n AS BIGINT) AS max_count, CAST(c AS BIGINT) AS dominant FROM ranked WHERE r = 1"""
    z = "CASE WHEN one >= 0.5 THEN 1 ELSE 0 END"
    sql["value_counts"] = f"WITH {log_scored}\nSELECT CAST({z} AS BIGINT) AS prediction, CAST(count(*) AS BIGINT) AS n FROM scored GROUP BY ALL"
    summary = [real(f"{f}(one)", f"{n}_score") for n, f in {"mean": "avg", "min": "min", "max": "max"}.items()]
    sql["score_summary"] = select([*summary, big("count(*)", "n")], "scored", log_scored)
    sql["score_correlation"] = select([real("corr(one, two)", "correlation"), real("avg(one)", "mean_a"), real("avg(two)", "mean_b"), big("count(*)", "n")], "scored", log_scored)
    sql["cvr_by_minute"] = f"""WITH {LOG}
SELECT CAST(minute AS BIGINT) AS minute, CAST(count(*) AS BIGINT) AS sum, CAST(sum(is_trade) AS BIGINT) AS gm,
  round(CAST(sum(is_trade) AS DOUBLE) / count(*), 6) AS cvr FROM log WHERE day_idx = 5 AND hour = 23 GROUP BY minute"""
    sql["attach_transfer_score"] = select(
        ["instance_id", real("CASE WHEN item_id % 3 = 0 THEN (one + two) / 2 ELSE one END", "predicted_score")], "scored", log_scored, f"WHERE day_idx = {TARGET}"
    )
    sql["blend_scores"] = select(["instance_id", real("one * 0.5 + two * 0.5", "predicted_score")], "scored", log_scored)
    p = "least(greatest({}, 1e-15), 1 - 1e-15)"
    loss = "-avg(CASE WHEN is_trade = 1 THEN ln({p}) ELSE ln(1 - {p}) END)"
    sql["blend_sweep"] = f"""WITH {assembled_scored}
SELECT round(w / 10.0::DOUBLE, 6) AS weight, round({loss.format(p=p.format("(one * (w / 10.0::DOUBLE) + two * (1 - w / 10.0::DOUBLE))"))}, 6) AS log_loss
FROM scored, range(1, 10) t(w) WHERE is_trade >= 0 GROUP BY w"""
    sql["log_loss"] = select([real(loss.format(p=p.format("one")), "log_loss"), big("count(*)", "n")], "scored", assembled_scored, "WHERE is_trade >= 0")
    sql["classification_report"] = f"""WITH {log_scored},
y AS (SELECT is_trade AS y, {z} AS z FROM scored),
c AS (SELECT v AS label, count(*) FILTER (y = v) AS support, count(*) FILTER (z = v) AS predicted, count(*) FILTER (y = v AND z = v) AS hit
      FROM y, (VALUES (0), (1)) t(v) GROUP BY v),
r AS (SELECT *, CAST(hit AS DOUBLE) / predicted AS p, CAST(hit AS DOUBLE) / support AS q FROM c)
SELECT CAST(label AS BIGINT) AS label, round(p, 6) AS precision, round(q, 6) AS recall, round(2 * p * q / (p + q), 6) AS f1, CAST(support AS BIGINT) AS support FROM r"""

    # whole feature tables
    sql["build_day_features"] = build_day_features()
    sql["final_stage_features"] = final_stage_features()
    sql["first_stage_features"] = first_stage_features()
    joins = Joins("assembled", ASSEMBLED)
    add_asof(joins, [*presets.DUMP_ITEM_RATE_KEYS, *presets.FIRST_USER_RATE_KEYS, *presets.FIRST_PAIR_RATE_KEYS, *presets.FIRST_SHOP_RATE_KEYS], "assembled", per_day=True)
    sql["rate_table"] = joins.sql()

    # the wide star log
    star_keys = ("user_id", "item_id", "item_brand_id", "item_price_level", "shop_id", "shop_star_level")
    named = {**{f"{key}_all": key for key in star_keys}, "user_id_shop_id_all": ("user_id", "shop_id")}
    sql["star_count_by_key"] = select(["context_id", "item_id", "shop_id", *counts(named)], "star", STAR)
    joins = Joins("star", STAR, ids=("context_id", "item_id", "shop_id", "day_idx"))
    add_asof(joins, ["item_brand_id", "shop_id", ("user_occupation_id", "cate_1")], "star")
    sql["star_asof_cvr"] = joins.sql()
    return sql
