"""Reference SQL for every checked query, runnable by DuckDB on the raw tables.

Each statement first derives the same canonical events (`ev`) from the
driver's tables as `sources.fixtures` does, then states the report the
straightforward way (COUNT DISTINCT, correlated subquery, window over users,
ROLLUP) so that the Spark plans, which are rewritten for scale, are checked
against an independent formulation. Rounding-sensitive averages use the same
exact formulation on both sides (integer basis points, DECIMAL sums).
"""

from __future__ import annotations

# Fixed values of the fixtures, stated here on their own and not taken from the
# engine: the draw compares four hex digits of a salted md5 with the cumulative
# weights x 65536, and the event maps are those of FIXTURES.md.
DRAW = """
       CASE WHEN substr(md5('country:' || CAST(event_id AS VARCHAR)), 1, 4) < '7333' THEN 'DE'
            WHEN substr(md5('country:' || CAST(event_id AS VARCHAR)), 1, 4) < 'b333' THEN 'NL'
            WHEN substr(md5('country:' || CAST(event_id AS VARCHAR)), 1, 4) < 'd99a' THEN 'BE' ELSE 'FR' END AS country,
       CASE WHEN substr(md5('device:' || CAST(event_id AS VARCHAR)), 1, 4) < '9eb8' THEN 'mobile'
            WHEN substr(md5('device:' || CAST(event_id AS VARCHAR)), 1, 4) < 'f0a4' THEN 'desktop' ELSE 'tablet' END AS device,
       CASE WHEN substr(md5('channel:' || CAST(event_id AS VARCHAR)), 1, 4) < '47ae' THEN 'organic_search'
            WHEN substr(md5('channel:' || CAST(event_id AS VARCHAR)), 1, 4) < '8000' THEN 'paid_social'
            WHEN substr(md5('channel:' || CAST(event_id AS VARCHAR)), 1, 4) < 'ae14' THEN 'email'
            WHEN substr(md5('channel:' || CAST(event_id AS VARCHAR)), 1, 4) < 'cccd' THEN 'direct'
            WHEN substr(md5('channel:' || CAST(event_id AS VARCHAR)), 1, 4) < 'eb85' THEN 'paid_search'
            ELSE 'influencer' END AS channel"""

CLICKSTREAM = f"""
SELECT event_id,
       ts AS event_time,
       CASE event_type WHEN 'view' THEN 'view' WHEN 'click' THEN 'view' WHEN 'signup' THEN 'cart'
                       WHEN 'purchase' THEN 'purchase' END AS event_type,
       CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 16 AS VARCHAR) AS user_id,{DRAW},
       CAST(value AS DECIMAL(18,2)) AS price
FROM events
WHERE event_type IN ('view', 'click', 'signup', 'purchase')
"""

# the selection of the filtered reports
SELECTED = f"SELECT * FROM ({CLICKSTREAM}) AS every_event WHERE country IN ('DE', 'NL') AND device IN ('mobile', 'tablet')"

ORDER_EVENTS = f"""
SELECT o_orderkey AS event_id,
       o_orderdate AS event_time,
       CASE o_orderstatus WHEN 'O' THEN 'view' WHEN 'P' THEN 'cart' WHEN 'F' THEN 'purchase' END AS event_type,
       CAST(o_custkey AS VARCHAR) AS user_id,
       r_name AS country,
       c_mktsegment AS device,
       o_orderpriority AS channel,
       CAST(o_totalprice AS DECIMAL(18,2)) AS price
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
WHERE o_orderstatus IN ('O', 'P', 'F')
"""

# ------------------------------------------------------------------ pieces
# Stage flags as BOOL_OR, distinct counts with FILTER: a different formulation
# from the Spark plans (MAX of CASE, flags summed), so each check compares two
# computations rather than one written twice.

def flag(t: str) -> str:
    return f"CAST(bool_or(event_type = '{t}') AS INTEGER)"


USERS = "COUNT(DISTINCT user_id)"
BUYERS = "COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'purchase')"


def pct(num: str, den: str, digits: int = 2) -> str:
    return f"ROUND(100.0::DOUBLE * ({num}) / NULLIF({den}, 0), {digits})"


def pct0(num: str, den: str, digits: int = 2) -> str:
    return f"COALESCE({pct(num, den, digits)}, 0.0::DOUBLE)"


def rate_div_first(num: str, den: str) -> str:
    return f"ROUND(({num}) / NULLIF({den}, 0) * 100.0::DOUBLE, 2)"


def mode_cte(name: str, dim: str) -> str:
    """(user_id, dim): the most frequent value per user, smallest on ties."""
    return f"""{name} AS (
    SELECT user_id, {dim} FROM (
        SELECT user_id, {dim}, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, {dim}) AS pick
        FROM (SELECT user_id, {dim}, COUNT(*) AS n FROM ev GROUP BY ALL)
    ) WHERE pick = 1)"""


PROFILE = f"""prof AS (
    SELECT user_id, {flag('view')} AS viewed, {flag('cart')} AS carted, {flag('purchase')} AS purchased
    FROM ev GROUP BY ALL)"""


def lenient_funnel(dim: str, extra: str = "") -> str:
    return f"""per_user AS (
    SELECT user_id, {dim}, {flag('view')} AS v, {flag('cart')} AS c, {flag('purchase')} AS p
    FROM ev GROUP BY ALL),
seg AS (
    SELECT {dim}, COUNT(*) AS total_users, SUM(v)::BIGINT AS viewers, SUM(c)::BIGINT AS carted,
           SUM(p)::BIGINT AS purchasers
    FROM per_user GROUP BY ALL)
SELECT {dim}, viewers, carted, purchasers,
       {pct('carted', 'viewers')} AS view_to_cart_pct,
       {pct('purchasers', 'carted')} AS cart_to_purchase_pct,
       {pct('purchasers', 'viewers')} AS overall_cvr_pct{extra}
FROM seg"""


def sequential_segment(dim: str | None) -> str:
    key = f"{dim}, " if dim else ""
    return f"""per_user AS (
    SELECT user_id, {key}{flag('cart')} AS c,
           CAST(bool_or(event_type = 'cart') AND bool_or(event_type = 'purchase') AS INTEGER) AS cp,
           COUNT(*) AS n
    FROM ev GROUP BY ALL),
s AS (
    SELECT {key}COUNT(*) AS viewers, SUM(c)::BIGINT AS carted, SUM(cp)::BIGINT AS purchasers,
           SUM(n)::BIGINT AS total_events
    FROM per_user{' GROUP BY ALL' if dim else ''})"""


def cells(min_sessions: int | None = None) -> str:
    keep = f" WHERE sessions >= {min_sessions}" if min_sessions else ""
    return f"""cell_counts AS (
    SELECT country, channel, {USERS} AS sessions, {BUYERS} AS purchasers FROM ev GROUP BY ALL),
cells AS (
    SELECT *, {pct('purchasers', 'sessions')} AS cvr_pct FROM cell_counts{keep})"""


USER_DEPTH = """depth AS (
    SELECT user_id, country, channel, device,
           COALESCE(MAX(list_position(['view', 'cart', 'purchase'], event_type)), 0) AS depth_score,
           COUNT(*) AS total_events
    FROM ev GROUP BY ALL)"""


def session_quality(limit: int | None) -> str:
    """Country average as a window AVG (NULL for a NULL country), rank as a window."""
    tail = f" LIMIT {limit}" if limit else ""
    return f"""{USER_DEPTH},
scored AS (
    SELECT *,
           CASE WHEN country IS NOT NULL THEN ROUND(AVG(depth_score) OVER (PARTITION BY country), 2) END AS avg_d,
           CAST(DENSE_RANK() OVER (PARTITION BY country ORDER BY depth_score DESC, total_events DESC) AS INTEGER)
               AS rk
    FROM depth)
SELECT user_id, country, channel, device, depth_score,
       ['unknown', 'view_only', 'carted_no_purchase', 'converted'][depth_score + 1] AS quality_label,
       total_events, avg_d AS country_avg_depth, ROUND(depth_score - avg_d, 2) AS vs_country_avg,
       rk AS rank_in_country
FROM scored
ORDER BY country NULLS FIRST, rk, user_id, channel, device{tail}"""


def weekly_trend() -> str:
    return f"""by_week AS (
    SELECT strftime(event_time, '%Y-%W') AS week, {USERS} AS sessions, {BUYERS} AS purchasers
    FROM ev WHERE event_time IS NOT NULL GROUP BY ALL),
rated AS (SELECT *, {pct('purchasers', 'sessions')} AS cvr_pct FROM by_week)
SELECT week, sessions, purchasers, cvr_pct,
       LAG(cvr_pct) OVER w AS prev_week_cvr,
       ROUND(cvr_pct - LAG(cvr_pct) OVER w, 2) AS wow_cvr_change_pp
FROM rated WINDOW w AS (ORDER BY week)"""


def cohort_retention() -> str:
    """Repeat purchase as EXISTS over the distinct purchase times."""
    return f"""buys AS (SELECT DISTINCT user_id, event_time FROM ev WHERE event_type = 'purchase'),
firsts AS (SELECT user_id, MIN(event_time) AS t0 FROM buys GROUP BY ALL),
flagged AS (
    SELECT strftime(t0, '%Y-%m') AS cohort_month,
           EXISTS (SELECT 1 FROM buys b WHERE b.user_id = f.user_id AND b.event_time > f.t0
                   AND b.event_time <= f.t0 + INTERVAL 60 DAY) AS again
    FROM firsts f)
SELECT cohort_month, COUNT(*) AS cohort_size, COUNT(*) FILTER (WHERE again) AS repeat_buyers,
       {pct('COUNT(*) FILTER (WHERE again)', 'COUNT(*)')} AS retention_60d_pct
FROM flagged GROUP BY ALL HAVING COUNT(*) >= 10"""


def order_value() -> str:
    return f"""per_buyer AS (
    SELECT user_id, country, COUNT(*) AS orders, SUM(price) AS spend
    FROM ev WHERE event_type = 'purchase' GROUP BY ALL)
SELECT country, COUNT(DISTINCT user_id) AS buyers,
       ROUND(AVG(orders), 2) AS avg_orders_per_buyer,
       ROUND(SUM(spend)::DOUBLE / NULLIF(COUNT(spend), 0), 2) AS avg_spend_per_buyer,
       ROUND(SUM(spend)::DOUBLE / NULLIF(SUM(orders), 0), 2) AS aov,
       {pct('COUNT(DISTINCT user_id) FILTER (WHERE orders > 1)', 'COUNT(DISTINCT user_id)')} AS repeat_buyer_rate_pct
FROM per_buyer GROUP BY ALL HAVING COUNT(DISTINCT user_id) >= 20"""


def channel_rank() -> str:
    return f"""{cells(50)}
SELECT country, channel, sessions, purchasers, cvr_pct,
       CAST(DENSE_RANK() OVER (PARTITION BY country ORDER BY cvr_pct DESC) AS INTEGER) AS rank_in_country
FROM cells"""


ROW_TYPE = "CASE GROUPING(channel, country) WHEN 0 THEN 'detail' WHEN 1 THEN 'channel_total' ELSE 'grand_total' END"


def rollup_report() -> str:
    """ROLLUP over the kept cells, summing their distinct counts."""
    return f"""{cells(30)}
SELECT CASE WHEN GROUPING(country) = 1 THEN 'ALL' ELSE country END AS country,
       CASE WHEN GROUPING(channel) = 1 THEN 'ALL' ELSE channel END AS channel,
       SUM(sessions)::BIGINT AS sessions, SUM(purchasers)::BIGINT AS purchasers,
       {pct('SUM(purchasers)', 'SUM(sessions)')} AS cvr_pct, {ROW_TYPE} AS row_type
FROM cells GROUP BY ROLLUP (channel, country)"""


def rollup_union() -> str:
    """The same rows as three UNION ALL branches (Spark's `rollup_union` is checked against this, its ROLLUP report against `rollup_report`)."""
    sums = f"SUM(sessions)::BIGINT AS sessions, SUM(purchasers)::BIGINT AS purchasers, {pct('SUM(purchasers)', 'SUM(sessions)')} AS cvr_pct"
    return f"""{cells(30)}
SELECT country, channel, sessions, purchasers, cvr_pct, 'detail' AS row_type FROM cells
UNION ALL SELECT 'ALL', channel, {sums}, 'channel_total' FROM cells GROUP BY channel
UNION ALL SELECT 'ALL', 'ALL', {sums}, 'grand_total' FROM cells"""


def hourly_abandonment() -> str:
    return f"""by_hour AS (
    SELECT CAST(hour(event_time) AS INTEGER) AS hour_of_day,
           COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'cart') AS cart_users,
           COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS purchase_users
    FROM ev WHERE event_time IS NOT NULL GROUP BY ALL)
SELECT hour_of_day, cart_users, purchase_users, cart_users - purchase_users AS abandoned,
       {pct('cart_users - purchase_users', 'cart_users')} AS abandonment_rate_pct,
       SUM(cart_users) OVER (ORDER BY hour_of_day ROWS UNBOUNDED PRECEDING)::BIGINT AS running_carts
FROM by_hour"""


def channel_vs_average() -> str:
    """Per-channel exact mean of the kept cells' rates, joined back."""
    return f"""{cells(50)},
means AS (
    SELECT channel,
           FLOOR((2 * SUM(ROUND(cvr_pct * 100)::BIGINT) + COUNT(*)) / (2.0::DOUBLE * COUNT(*))) / 100.0::DOUBLE AS m
    FROM cells GROUP BY ALL)
SELECT c.channel, c.country, c.sessions, c.cvr_pct AS country_cvr_pct, means.m AS channel_avg_cvr_pct,
       ROUND(c.cvr_pct - means.m, 2) AS vs_channel_avg_pp,
       CASE WHEN c.cvr_pct > means.m * 1.1::DOUBLE THEN 'outperforming'
            WHEN c.cvr_pct < means.m * 0.9::DOUBLE THEN 'underperforming'
            ELSE 'in_line' END AS performance_flag
FROM cells c JOIN means USING (channel)"""


def funnel_kpis() -> str:
    return f"""{sequential_segment(None)}
SELECT viewers, carted, purchasers, total_events,
       COALESCE(ROUND(100.0::DOUBLE * (1.0::DOUBLE - purchasers / NULLIF(carted, 0)), 1), 0.0::DOUBLE)
           AS cart_abandon_rate,
       {pct0('purchasers', 'viewers')} AS overall_cvr
FROM s"""


def funnel_stages() -> str:
    return f"""{sequential_segment(None)}
SELECT st.stage_order, st.stage, st.users, {pct0('st.users', 's.viewers', 1)} AS pct_of_initial
FROM s, LATERAL (VALUES (1, 'Viewed', s.viewers), (2, 'Added to Cart', s.carted), (3, 'Purchased', s.purchasers))
     AS st(stage_order, stage, users)"""


def seq_country() -> str:
    return f"""{sequential_segment('country')}
SELECT country, viewers, carted, purchasers,
       {pct0('carted', 'viewers')} AS view_to_cart_pct,
       {pct0('purchasers', 'carted')} AS cart_to_purchase_pct,
       {pct0('purchasers', 'viewers')} AS overall_cvr_pct
FROM s"""


def home_funnel(dim: str) -> str:
    return f"""{PROFILE},
{mode_cte('home', dim)},
counts AS (
    SELECT home.{dim}, SUM(viewed)::BIGINT AS viewers, SUM(carted)::BIGINT AS carted,
           SUM(purchased)::BIGINT AS purchasers
    FROM prof JOIN home USING (user_id) GROUP BY ALL)
SELECT {dim}, viewers, carted, purchasers,
       {rate_div_first('carted', 'viewers')} AS v2c_pct,
       {rate_div_first('purchasers', 'carted')} AS c2p_pct,
       {rate_div_first('purchasers', 'viewers')} AS overall_cvr
FROM counts"""


def home_channel_funnel() -> str:
    return f"""{PROFILE},
{mode_cte('home', 'channel')},
counts AS (
    SELECT home.channel, SUM(viewed)::BIGINT AS viewers, SUM(carted)::BIGINT AS carted,
           SUM(purchased)::BIGINT AS purchasers
    FROM prof JOIN home USING (user_id) GROUP BY ALL)
SELECT channel, viewers, carted, purchasers, {rate_div_first('purchasers', 'viewers')} AS overall_cvr
FROM counts"""


def channel_country_matrix(countries: tuple[str, ...]) -> str:
    cols = ",\n       ".join(f"MAX(cvr) FILTER (WHERE country = '{c}') AS \"{c}\"" for c in countries)
    return f"""{PROFILE},
{mode_cte('home_c', 'country')},
{mode_cte('home_ch', 'channel')},
grid AS (
    SELECT home_ch.channel, home_c.country,
           {rate_div_first('SUM(purchased)::BIGINT', 'SUM(viewed)::BIGINT')} AS cvr
    FROM prof JOIN home_c USING (user_id) JOIN home_ch USING (user_id)
    GROUP BY ALL)
SELECT channel,
       {cols}
FROM grid GROUP BY ALL"""


def channel_conversion_summary() -> str:
    return f"""{PROFILE},
{mode_cte('home', 'channel')}
SELECT channel, COUNT(*) AS users, SUM(purchased)::BIGINT AS converters,
       {rate_div_first('SUM(purchased)::BIGINT', 'COUNT(*)')} AS cvr
FROM prof JOIN home USING (user_id) GROUP BY ALL"""


def overall_funnel() -> str:
    return f"""{PROFILE},
t AS (SELECT SUM(viewed)::BIGINT AS viewers, SUM(carted)::BIGINT AS carted,
             SUM(purchased)::BIGINT AS purchasers FROM prof)
SELECT viewers, carted, purchasers,
       carted::DOUBLE / NULLIF(viewers, 0) AS v2c_rate,
       purchasers::DOUBLE / NULLIF(carted, 0) AS c2p_rate,
       purchasers::DOUBLE / NULLIF(viewers, 0) AS overall
FROM t"""


def quality_checks() -> str:
    n = [("row_count", "n_rows >= 100000", "n_rows")]
    n += [(f"has_{t}_events", f"n_{t} > 0", f"n_{t}") for t in ("view", "cart", "purchase")]
    n += [(f"{d}_present", f"nn_{d} > 0", f"nn_{d}") for d in ("country", "device", "channel")]
    n += [(f"{c}_no_nulls", f"null_{c} = 0", f"null_{c}") for c in ("event_time", "user_id")]
    aggs = ["COUNT(*) AS n_rows"]
    aggs += [f"COUNT(CASE WHEN event_type = '{t}' THEN 1 END) AS n_{t}" for t in ("view", "cart", "purchase")]
    aggs += [f"COUNT({d}) AS nn_{d}" for d in ("country", "device", "channel")]
    aggs += [f"COUNT(*) - COUNT({c}) AS null_{c}" for c in ("event_time", "user_id")]
    rows = "\nUNION ALL ".join(f"SELECT '{c}' AS check_name, {p} AS passed, {o} AS observed FROM a" for c, p, o in n)
    return f"a AS (SELECT {', '.join(aggs)} FROM ev)\n{rows}"


PROFILE_COLUMNS = ("event_time", "user_id", "event_type", "country", "device", "channel")
VALUE_COLUMNS = ("event_type", "country", "device", "channel")


def value_counts() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM ev" for c in VALUE_COLUMNS)
    return f"""SELECT column_name, value, COUNT(*) AS n FROM ({long}) WHERE value IS NOT NULL
GROUP BY column_name, value"""


def null_profile() -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS column_name, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count FROM ev"
        for c in PROFILE_COLUMNS)


def dataset_profile() -> str:
    nulls = " UNION ALL ".join(
        f"SELECT 'null_count' AS section, '{c}' AS column_name, CAST(NULL AS VARCHAR) AS value, "
        f"CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n FROM ev" for c in PROFILE_COLUMNS)
    fmt = "'%Y-%m-%d %H:%M:%S.%f'"
    return f"""vc AS ({value_counts()})
SELECT 'value_count' AS section, column_name, value, n FROM vc
UNION ALL {nulls}
UNION ALL SELECT 'min_time', 'event_time', strftime(MIN(event_time), {fmt}), CAST(NULL AS BIGINT) FROM ev
UNION ALL SELECT 'max_time', 'event_time', strftime(MAX(event_time), {fmt}), CAST(NULL AS BIGINT) FROM ev"""


EVENT_COLUMNS = "event_id, event_time, event_type, user_id, country, device, channel, CAST(price AS DOUBLE) AS price"


def event_sets() -> str:
    return f"""SELECT user_id,
       array_to_string(list_sort(list_distinct(list(event_type))), ',') AS event_set,
       bool_or(event_type = 'view') AS has_view,
       bool_or(event_type = 'cart') AS has_cart,
       bool_or(event_type = 'purchase') AS has_purchase,
       bool_or(event_type = 'cart') AND bool_or(event_type = 'purchase') AS sequential_purchase
FROM ev GROUP BY user_id"""


def user_mode_dims() -> str:
    return f"""{mode_cte('m1', 'country')},
{mode_cte('m2', 'device')},
{mode_cte('m3', 'channel')}
SELECT user_id, m1.country AS home_country, m2.device AS home_device, m3.channel AS home_channel
FROM m1 JOIN m2 USING (user_id) JOIN m3 USING (user_id)"""


def segment_cube() -> str:
    return f"""SELECT CASE WHEN GROUPING(country) = 1 THEN 'ALL' ELSE country END AS country,
       CASE WHEN GROUPING(channel) = 1 THEN 'ALL' ELSE channel END AS channel,
       {USERS} AS sessions, {BUYERS} AS purchasers, {pct(BUYERS, USERS)} AS cvr_pct, {ROW_TYPE} AS row_type
FROM ev GROUP BY ROLLUP (channel, country)"""


def depth_window() -> str:
    return f"""{USER_DEPTH},
t AS (SELECT country, depth_score, total_events, COUNT(*) AS users FROM depth GROUP BY ALL)
SELECT country, depth_score, total_events, users,
       CAST(DENSE_RANK() OVER (PARTITION BY country ORDER BY depth_score DESC, total_events DESC) AS INTEGER)
           AS rank_in_country
FROM t"""


def hourly_stream() -> str:
    """Every event-time hour with a cart or purchase, open ones included."""
    return f"""h AS (
    SELECT date_trunc('hour', event_time) AS hour_start,
           COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'cart') AS cart_users,
           COUNT(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS purchase_users
    FROM ev WHERE event_type IN ('cart', 'purchase') AND user_id IS NOT NULL AND event_time IS NOT NULL GROUP BY ALL)
SELECT hour_start, cart_users, purchase_users, cart_users - purchase_users AS abandoned,
       {pct('cart_users - purchase_users', 'cart_users')} AS abandonment_rate_pct
FROM h"""


def cart_abandoners() -> str:
    """Carts without a purchase from their instant to two hours later, that instant included."""
    return """buys AS (SELECT user_id, event_time AS bought FROM ev WHERE event_type = 'purchase')
SELECT event_id, user_id, event_time AS cart_time, country, device, channel,
       (SELECT MIN(bought) FROM buys b WHERE b.user_id = c.user_id AND b.bought >= c.event_time) AS next_purchase_time
FROM ev c
WHERE event_type = 'cart' AND NOT EXISTS (
    SELECT 1 FROM buys b WHERE b.user_id = c.user_id AND b.bought >= c.event_time
       AND b.bought <= c.event_time + INTERVAL 2 HOUR)"""


def time_to_purchase() -> str:
    quantiles = ",\n       ".join(f"quantile_disc(epoch_us(t1) - epoch_us(t0), 0.{p}) / 1000000.0::DOUBLE AS p{p}_s"
                                  for p in (25, 50, 75, 90))
    return f"""firsts AS (SELECT user_id, channel, MIN(event_time) AS t0 FROM ev WHERE event_type = 'view' GROUP BY ALL),
nexts AS (
    SELECT f.channel, f.user_id, f.t0, MIN(e.event_time) AS t1
    FROM firsts f JOIN ev e ON e.user_id = f.user_id AND e.channel = f.channel
     AND e.event_type = 'purchase' AND e.event_time >= f.t0
    GROUP BY ALL)
SELECT channel, COUNT(*) AS n, {quantiles},
       {pct('COUNT(*) FILTER (WHERE CAST(t0 AS DATE) = CAST(t1 AS DATE))', 'COUNT(*)')} AS same_day_pct
FROM nexts GROUP BY channel"""


def running_events_by_minute() -> str:
    return """minutes AS (
    SELECT CAST(date_trunc('minute', event_time) AS TIMESTAMP) AS minute, COUNT(*) AS events,
           COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases
    FROM ev WHERE event_time IS NOT NULL GROUP BY ALL)
SELECT minute, events, purchases, SUM(events) OVER up::BIGINT AS running_events,
       SUM(purchases) OVER up::BIGINT AS running_purchases,
       LAG(events) OVER up AS prev_events, LAG(minute) OVER up AS prev_minute
FROM minutes WINDOW up AS (ORDER BY minute)"""


def purchase_sequence() -> str:
    return """SELECT user_id, event_id, event_time, CAST(price * 100 AS BIGINT) AS cents,
       CAST(ROW_NUMBER() OVER up AS INTEGER) AS purchase_no,
       SUM(CAST(price * 100 AS BIGINT)) OVER up::BIGINT AS running_cents, LAG(event_time) OVER up AS prev_purchase_time
FROM ev WHERE event_type = 'purchase'
WINDOW up AS (PARTITION BY user_id ORDER BY event_time, event_id)"""


def top_users() -> str:
    return "SELECT user_id AS value, COUNT(*) AS n FROM ev GROUP BY user_id ORDER BY n DESC, value LIMIT 20"


def sketch_rollup() -> str:
    return f"""SELECT CASE WHEN GROUPING(country) = 1 THEN 'ALL' ELSE country END AS country,
       CASE WHEN GROUPING(channel) = 1 THEN 'ALL' ELSE channel END AS channel, {ROW_TYPE} AS row_type,
       {USERS} AS sessions, {BUYERS} AS purchasers, TRUE AS sessions_estimate_ok, TRUE AS purchasers_estimate_ok
FROM ev GROUP BY ROLLUP (channel, country)"""


# The damaged export: which column of a funnel event's line is spoilt, by its id.
# An event type that no funnel stage knows leaves the export before that, unless
# its line is broken.
DAMAGED = """
WITH raw AS (
    SELECT event_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS written,
           CASE event_type WHEN 'click' THEN 'view' WHEN 'signup' THEN 'cart' WHEN 'error' THEN 'remove_from_cart'
                           ELSE event_type END AS event_type,
           CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 16 AS VARCHAR) AS user_id, value,
           event_id % 83 = 0 OR event_id % 79 = 0 AS broken, event_id % 97 = 0 AS no_time, event_id % 89 = 0 AS no_price,
           event_id % 73 = 0 AS no_user
    FROM events),
funnel AS (SELECT * FROM raw WHERE NOT broken AND event_type IN ('view', 'cart', 'purchase')),
reasons AS (
    SELECT 'column_count' AS reason, event_id FROM raw WHERE broken
    UNION ALL SELECT 'event_time', event_id FROM funnel WHERE no_time
    UNION ALL SELECT 'user_id', event_id FROM funnel WHERE no_user
    UNION ALL SELECT 'price', event_id FROM funnel WHERE no_price)
"""


def _with(fixture: str, body: str) -> str:
    """WITH ev AS (<fixture>) followed by the body's own CTEs or its SELECT."""
    head = f"WITH ev AS ({fixture})"
    stripped = body.lstrip()
    if stripped.upper().startswith("SELECT"):
        return f"{head}\n{stripped}"
    return f"{head},\n{stripped}"


def _click(body: str) -> str:
    return _with(CLICKSTREAM, body)


def _orders(body: str) -> str:
    return _with(ORDER_EVENTS, body)


ORACLE_SQL: dict[str, str] = {
    "country_funnel": _click(lenient_funnel("country")),
    "channel_rank": _click(channel_rank()),
    "weekly_trend": _click(weekly_trend()),
    "device_funnel": _click(lenient_funnel(
        "device", ",\n       CASE WHEN total_users < 1000 THEN 'low_sample' ELSE 'ok' END AS sample_flag")),
    "cohort_retention": _click(cohort_retention()),
    "channel_country_rollup": _click(rollup_report()),
    "hourly_abandonment": _click(hourly_abandonment()),
    "order_value": _click(order_value()),
    "channel_vs_average": _click(channel_vs_average()),
    "session_quality": _click(session_quality(500)),
    "session_quality_full": _click(session_quality(None)),
    "funnel_kpis": _click(funnel_kpis()),
    "funnel_stages": _click(funnel_stages()),
    "country_funnel_seq": _click(seq_country()),
    "channel_cvr_seq": _click(f"""{sequential_segment('channel')}
SELECT channel, viewers AS sessions, purchasers AS purchases, {pct0('purchasers', 'viewers')} AS cvr_pct FROM s"""),
    "device_cvr_seq": _click(f"""{sequential_segment('device')}
SELECT device, {pct0('purchasers', 'viewers')} AS cvr_pct FROM s"""),
    "worst_market": _click(f"""{seq_country()} ORDER BY overall_cvr_pct, country LIMIT 1"""),
    "home_country_funnel": _click(home_funnel("country")),
    "home_device_funnel": _click(home_funnel("device")),
    "home_channel_funnel": _click(home_channel_funnel()),
    "channel_country_matrix": _click(channel_country_matrix(("BE", "DE", "FR", "NL"))),
    "channel_conversion_summary": _click(channel_conversion_summary()),
    "overall_funnel": _click(overall_funnel()),
    "quality_checks": _click(quality_checks()),
    "dataset_profile": _click(dataset_profile()),
    "value_counts": _click(value_counts()),
    "null_profile": _click(null_profile()),
    "canonical_events": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    "ingest_events": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    "adapt_auto": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    "sessions_approx": _click(f"""SELECT country, channel, {USERS} AS sessions, {BUYERS} AS purchasers,
       TRUE AS sessions_estimate_ok, TRUE AS purchasers_estimate_ok
FROM ev GROUP BY ALL"""),
    "country_funnel_seq_selected": _with(SELECTED, seq_country()),
    "funnel_kpis_selected": _with(SELECTED, funnel_kpis()),
    "channel_cvr_seq_selected": _with(SELECTED, f"""{sequential_segment('channel')}
SELECT channel, viewers AS sessions, purchasers AS purchases, {pct0('purchasers', 'viewers')} AS cvr_pct FROM s"""),
    "worst_market_selected": _with(SELECTED, f"""{seq_country()} ORDER BY overall_cvr_pct, country LIMIT 1"""),
    "adapt_multistore": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    # the retail export has no price column: NULL; its times are epoch milliseconds
    "adapt_retail": _click(
        "SELECT event_id, make_timestamp(epoch_us(event_time) // 1000 * 1000) AS event_time, event_type, user_id, "
        "country, device, channel, CAST(NULL AS DOUBLE) AS price FROM ev"),
    "adapt_heuristic": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    "csv_roundtrip": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    "table_roundtrip": _click(f"SELECT {EVENT_COLUMNS} FROM ev"),
    "assign_dims": f"SELECT event_id,{DRAW} FROM events",
    "parse_times": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS event_time_text, ts AS event_time FROM events",
    "preview_head": _click(f"SELECT {EVENT_COLUMNS} FROM ev ORDER BY event_time, event_id LIMIT 5"),
    "segment_filter": _click(f"SELECT {EVENT_COLUMNS} FROM ev WHERE country IN ('DE', 'NL') AND device IN ('mobile', 'tablet')"),
    "user_flags": _click(f"SELECT user_id, country, {flag('view')} AS did_view, {flag('cart')} AS did_cart, "
                         f"{flag('purchase')} AS did_purchase FROM ev GROUP BY ALL"),
    "event_sets": _click(event_sets()),
    "user_mode_dims": _click(user_mode_dims()),
    "distinct_vs_flags": _click(f"""SELECT country, channel, {USERS} AS sessions_distinct, {BUYERS} AS purchasers_distinct,
       {USERS} AS sessions_flags, {BUYERS} AS purchasers_flags
FROM ev GROUP BY ALL"""),
    "segment_cube": _click(segment_cube()),
    "rollup_union": _click(rollup_union()),
    "cohort_selfjoin": _click(cohort_retention()),
    "depth_correlated": _click(session_quality(None)),
    "depth_window": _click(depth_window()),
    "hourly_abandonment_stream": _click(hourly_stream()),
    "cart_abandoners_2h": _click(cart_abandoners()),
    "time_to_purchase": _click(time_to_purchase()),
    "running_events_by_minute": _click(running_events_by_minute()),
    "purchase_sequence": _click(purchase_sequence()),
    "top_users": _click(top_users()),
    "sessions_sketch_rollup": _click(sketch_rollup()),
    "ingest_rejects": f"{DAMAGED}SELECT reason, COUNT(*) AS n FROM reasons GROUP BY reason",
    "ingest_reject_rows": f"""{DAMAGED}, texts AS (
    SELECT *, CASE WHEN no_time THEN 'yesterday' ELSE written END AS t, CASE WHEN no_user THEN '' ELSE user_id END AS u,
           CASE WHEN no_price THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS p
    FROM raw)
SELECT reason, CASE WHEN broken
    THEN t || ',' || event_type || ',' || u || ',' || p || CASE WHEN event_id % 83 = 0 THEN '' ELSE ',' || event_id || ',surplus' END
    ELSE '{{"event_time":"' || t || '","event_type":"' || event_type || '",'
         || CASE WHEN no_user THEN '' ELSE '"user_id":"' || u || '",' END
         || '"price":"' || p || '","event_id":"' || event_id || '"}}' END AS record
FROM texts JOIN reasons USING (event_id)""",
    "ingest_damaged_events": f"""{DAMAGED}SELECT event_id, ts AS event_time, event_type, user_id,{DRAW},
       CASE WHEN NOT no_price THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS price
FROM funnel WHERE NOT no_time AND NOT no_user""",
    # order-based fixture
    "country_funnel_orders": _orders(lenient_funnel("country")),
    "channel_rank_orders": _orders(channel_rank()),
    "weekly_trend_orders": _orders(weekly_trend()),
    "cohort_retention_orders": _orders(cohort_retention()),
    "order_value_orders": _orders(order_value()),
    "device_funnel_orders": _orders(lenient_funnel(
        "device", ",\n       CASE WHEN total_users < 1000 THEN 'low_sample' ELSE 'ok' END AS sample_flag")),
    "channel_country_rollup_orders": _orders(rollup_report()),
    "channel_vs_average_orders": _orders(channel_vs_average()),
    "session_quality_orders": _orders(session_quality(500)),
    "country_funnel_seq_orders": _orders(seq_country()),
    "channel_cvr_seq_orders": _orders(f"""{sequential_segment('channel')}
SELECT channel, viewers AS sessions, purchasers AS purchases, {pct0('purchasers', 'viewers')} AS cvr_pct FROM s"""),
    "device_cvr_seq_orders": _orders(f"""{sequential_segment('device')}
SELECT device, {pct0('purchasers', 'viewers')} AS cvr_pct FROM s"""),
    "home_country_funnel_orders": _orders(home_funnel("country")),
    "channel_country_matrix_orders": _orders(channel_country_matrix(("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))),
    "cohort_selfjoin_orders": _orders(cohort_retention()),
    "cart_abandoners_2h_orders": _orders(cart_abandoners()),
    "time_to_purchase_orders": _orders(time_to_purchase()),
    "running_events_by_minute_orders": _orders(running_events_by_minute()),
    "purchase_sequence_orders": _orders(purchase_sequence()),
    "top_users_orders": _orders(top_users()),
}
