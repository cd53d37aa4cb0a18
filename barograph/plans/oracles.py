"""The registered queries in SQL, written independently of the operators.

Doubles are rounded to six places on both sides; ``+ 0.0`` removes the sign of
a rounded zero.
"""

from __future__ import annotations

from barograph.functions.wordlists import DEFAULT_LEXICON, STOP_WORDS, URGENCY_WORDS
from barograph.schemas import ALERT_TYPES, CATEGORY_OF_TYPE, TYPE_PHRASES
from barograph.sources.tables import DEFAULT_INSIGHTS

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
ORDER_TYPES = ["urgent", "high", "medium", "not_specified", "low"]


def r(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0"


def day(expression: str = "day") -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


EVENT_ALERTS = """alerts AS (
  SELECT event_id AS alert_id, ts AS issued_date, CAST(ts AS DATE) AS day, event_type AS type,
         'region_' || (user_id % 8) AS region, least(value / 491.0, 1.0) AS severity_score
  FROM events)"""

DOCUMENT_ALERTS = """alerts AS (
  SELECT doc_id AS alert_id, text, source AS region, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day,
         CAST(doc_id % 5 AS INTEGER) AS level
  FROM documents)"""


def gap_free(counts: str, keys: list[str], values: dict[str, str], name: str = "series") -> str:
    """CTE ``name``: every day between first and last of each key, with zeros."""
    k = "".join(f"{c}, " for c in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    on = " AND ".join([f"c.{c} = s.{c}" for c in keys] + ["c.day = s.day"])
    filled = ", ".join(f"coalesce(c.{v}, {zero}) AS {v}" for v, zero in values.items())
    return f"""{name} AS (
  SELECT {''.join(f's.{c}, ' for c in keys)}s.day, {filled}
  FROM (SELECT {k}CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT {k}min(day) AS lo, max(day) AS hi FROM {counts} {group})) s
  LEFT JOIN {counts} c ON {on})"""


def type_counts(types: list[str]) -> str:
    return ", ".join(f"count(*) FILTER (type = '{t}') AS {t}" for t in types)


def trends(keys: list[str], severity: bool = True) -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"({part}ORDER BY day"
    intensity = f"{r('total_alerts * severity_score')} AS alert_intensity," if severity else ""
    lag = f"lag(total_alerts) OVER {w})"
    return f"""{intensity}
  {r(f'avg(total_alerts) OVER {w} ROWS 6 PRECEDING)')} AS "7_day_avg",
  {r(f'avg(total_alerts) OVER {w} ROWS 29 PRECEDING)')} AS "30_day_avg",
  {r(f'CAST(total_alerts - {lag} AS DOUBLE) / nullif({lag}, 0) * 100')} AS day_over_day_change"""


def daily_of(alerts: str, keys: list[str], types: list[str], means: list[str] = ["severity_score"]) -> str:
    """CTEs ``counts`` and ``series`` over a CTE or table with day, type and the mean columns."""
    k = "".join(f"{c}, " for c in keys)
    group = ", ".join([*keys, "day"])
    mean = "".join(f", avg({m}) AS {m}" for m in means)
    kinds = f", {type_counts(types)}" if types else ""
    values = {"total_alerts": "0", **{m: "0.0" for m in means}, **{t: "0" for t in types}}
    counts = f"counts AS (SELECT {k}day, count(*) AS total_alerts{mean}{kinds} FROM {alerts} GROUP BY {group})"
    return f"{counts},\n{gap_free('counts', keys, values)}"


ORDER_COUNTS = "counts AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS total_alerts FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1)"
ORDER_DAILY = f"{ORDER_COUNTS},\n{gap_free('counts', [], {'total_alerts': '0'})}"
ORDER_TYPED = """typed AS (
  SELECT CAST(o_orderdate AS DATE) AS day, lower(replace(regexp_replace(o_orderpriority, '^.*-', ''), ' ', '_')) AS type,
         least(o_totalprice / 500000.0, 1.0) AS severity_score
  FROM orders)"""
NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM series)"

CLEAN = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), "
    r"'https?://\S+|www\.\S+', '', 'g'), '[^a-zA-Z\s.,!?]', ' ', 'g'), '\s+', ' ', 'g'))"
)
TOKENS = (
    f"list_filter(string_split_regex({CLEAN}, '[^a-z]+'), "
    f"lambda w: length(w) >= 3 AND NOT list_contains([{quoted(STOP_WORDS)}], w))"
)


def token_rows(columns: str, source: str = "documents") -> str:
    """CTE ``tok``: one row per token with its position."""
    return f"""lists AS (SELECT {columns}, {TOKENS} AS t FROM {source}),
tok AS (SELECT {columns}, unnest(t) AS token, unnest(range(len(t))) AS pos FROM lists)"""


LEXICON = "lexicon(word, polarity, subjectivity) AS (VALUES " + ", ".join(
    f"('{w}', CAST({p} AS DOUBLE), CAST({s} AS DOUBLE))" for w, (p, s) in DEFAULT_LEXICON.items()
) + ")"


def sentiment_rows(key: str, source: str = "documents") -> str:
    """CTE ``mood``: mean polarity and subjectivity of every text."""
    return f"""{LEXICON},
hits AS (
  SELECT w.{key}, avg(l.polarity) AS polarity, avg(l.subjectivity) AS subjectivity
  FROM (SELECT {key}, unnest(string_split_regex({CLEAN}, '[^a-z]+')) AS word FROM {source}) w
  JOIN lexicon l ON l.word = w.word GROUP BY 1),
mood AS (
  SELECT s.{key}, coalesce(h.polarity, 0.0) AS sentiment_score, coalesce(h.subjectivity, 0.0) AS subjectivity
  FROM {source} s LEFT JOIN hits h ON h.{key} = s.{key})"""


LABEL = """CASE WHEN sentiment_score > 0.3 THEN 'urgent_negative' WHEN sentiment_score > 0.1 THEN 'cautionary'
  WHEN sentiment_score > -0.1 THEN 'neutral' WHEN sentiment_score > -0.3 THEN 'concern' ELSE 'severe' END"""

SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD_COUNT = f"len(regexp_extract_all(text, '[^{SPACE}]+'))"
URGENCY = " + ".join(f"CAST(contains(lower(text), '{w}') AS BIGINT)" for w in URGENCY_WORDS)
EXCLAMATIONS = "CAST(length(text) - length(replace(text, '!', '')) AS BIGINT)"
UNICODE_WORDS = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}\p{Pc}]+')"


def classified(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '{'|'.join(p)}') THEN '{t}'" for t, p in TYPE_PHRASES.items())
    return f"CASE {cases} ELSE 'other' END"


def categorized(column: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in CATEGORY_OF_TYPE.items())
    return f"CASE {column} {cases} ELSE 'other' END"


PROCESSED = f"""{DOCUMENT_ALERTS},
{sentiment_rows('alert_id', 'alerts')},
measured AS (
  SELECT alert_id, text, day, region, {classified('text')} AS type, {WORD_COUNT} AS word_count, {URGENCY} AS urgency_keywords,
         {EXCLAMATIONS} AS exclamation_count, [1.0, 0.8, 0.5, 0.2, 0.1][level + 1] AS base
  FROM alerts),
processed AS (
  SELECT m.*, s.sentiment_score, {LABEL} AS sentiment_label,
         least(CAST(base AS DOUBLE) + abs(least(sentiment_score, 0.0)) * 0.5 + least(urgency_keywords * 0.1, 0.3)
               + least(exclamation_count * 0.05, 0.2), 1.0) AS severity_score
  FROM measured m JOIN mood s ON s.alert_id = m.alert_id)"""


def rolling(n: int) -> str:
    w = f"OVER (ORDER BY day ROWS {n - 1} PRECEDING)"
    return f"""{r(f'avg(total_alerts) {w}')} AS rolling_mean_{n}, {r(f'stddev_samp(total_alerts) {w}')} AS rolling_std_{n},
  min(total_alerts) {w} AS rolling_min_{n}, max(total_alerts) {w} AS rolling_max_{n}"""


def zscore(n: int) -> str:
    w = f"OVER (ORDER BY day ROWS {n - 1} PRECEDING)"
    std, mean = f"stddev_samp(total_alerts) {w}", f"avg(total_alerts) {w}"
    z = f"(total_alerts - {mean}) / CASE WHEN {std} = 0 THEN 1.0 ELSE {std} END"
    return f"{r(f'coalesce({std}, 0.0)')} AS rolling_std_{n}, {r(f'coalesce({z}, 0.0)')} AS z_score_{n}"


def lags(ks, default: str | None) -> str:
    last = f", {default}" if default else ""
    return ", ".join(f"lag(total_alerts, {k}{last}) OVER (ORDER BY day) AS lag_{k}" for k in ks)


def difference(k: int) -> str:
    before = f"lag(total_alerts, {k}) OVER (ORDER BY day)"
    return f"""total_alerts - {before} AS diff_{k},
  {r(f'CAST(total_alerts - {before} AS DOUBLE) / nullif({before}, 0)')} AS pct_change_{k}"""


def ema(alpha: float) -> str:
    weight = f"pow({1 - alpha}, a.rn - b.rn)"
    return f"{r(f'sum({weight} * b.total_alerts) / sum({weight})')} AS ema_{str(alpha).replace('.', '_')}"


def best_type(types: list[str]) -> str:
    """The first of the types with the highest sum."""
    cases = " ".join(f"WHEN {t} = greatest({', '.join(types)}) THEN '{t}'" for t in types)
    return f"CASE {cases} END"


def weekly(keys: str) -> str:
    return f"""{EVENT_ALERTS},
weeks AS (
  SELECT {keys}, count(*) FILTER (age BETWEEN 0 AND 6) AS this_week, count(*) FILTER (age BETWEEN 7 AND 13) AS last_week
  FROM (SELECT *, date_diff('day', day, (SELECT max(day) FROM alerts)) AS age FROM alerts) GROUP BY {keys})"""


BURST = "total_alerts - (rolling_mean + 2 * rolling_std) > 1e-9"


def burst_stats(keys: list[str], value: str = "total_alerts") -> str:
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    w = f"OVER ({part}ORDER BY day ROWS 6 PRECEDING)"
    return f"flagged AS (SELECT *, avg({value}) {w} AS rolling_mean, stddev_samp({value}) {w} AS rolling_std FROM series)"


def correlations(types: list[str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS type_a, '{b}' AS type_b, {r(f'corr({a}, {b})')} AS correlation FROM series" for a in types for b in types
    )
    return f"WITH {EVENT_ALERTS}, {daily_of('alerts', [], EVENT_TYPES)} {rows}"


def null_rows(names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, {r(f'(count(*) - count({c})) / count(*)')} AS null_ratio FROM j"
        for c in names
    )


def short_number(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} >= 1000000 THEN format('{{:.1f}}M', {x} / 1000000)
  WHEN {x} >= 1000 THEN format('{{:.1f}}K', {x} / 1000) WHEN {x} = 0 THEN '0' WHEN abs({x}) < 0.01 THEN format('{{:.2e}}', {x})
  WHEN abs({x}) < 1 THEN format('{{:.3f}}', {x}) WHEN abs({x}) < 100 THEN format('{{:.1f}}', {x}) ELSE format('{{:.0f}}', {x}) END"""


LOCATED = """located AS (
  SELECT o_totalprice, CAST(o_orderdate AS DATE) AS day, n_name AS region
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

PLACE = "(?:County|Parish|Borough)"
NAME = "[A-Z][a-z]+"


def stream_counts(keys: list[str], width: str, starts: str) -> str:
    """Counts of the windows closed by a watermark one day behind the latest event."""
    k = "".join(f"{c}, " for c in keys)
    return f"""WITH {EVENT_ALERTS},
placed AS (SELECT *, {starts} AS window_start FROM alerts)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start,
       strftime(window_start + INTERVAL {width}, '%Y-%m-%d %H:%M:%S') AS window_end, {k}count(*) AS total_alerts
FROM placed
GROUP BY ALL HAVING max(window_start) + INTERVAL {width} <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


ARRIVALS = f"""{EVENT_ALERTS},
arrivals AS (SELECT *, issued_date + to_hours(CASE WHEN alert_id % 100 = 99 THEN 288 WHEN alert_id % 10 = 9 THEN 44 WHEN alert_id % 10 > 6 THEN 20 ELSE 0 END) AS arrived FROM alerts)"""


def watermarks(arrivals: str) -> str:
    """CTEs ``sliced``, the slice of each arrival, and ``marks``, the watermark two days behind all earlier slices."""
    return f"""sliced AS (SELECT *, datediff('day', DATE '2024-01-01', CAST(arrived AS DATE)) // 14 AS slice FROM {arrivals}),
marks AS (SELECT s.slice, max(date_trunc('millisecond', a.issued_date)) - INTERVAL 2 DAY AS mark
  FROM (SELECT DISTINCT slice FROM sliced) s JOIN sliced a ON a.slice < s.slice GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    """SQL for every query that SQL can express on whole tables."""
    sql: dict[str, str] = {}
    event_daily = f"WITH {EVENT_ALERTS}, {daily_of('alerts', [], EVENT_TYPES)}"
    order_daily = f"WITH {ORDER_DAILY}"
    order_full = f"WITH {ORDER_TYPED}, {daily_of('typed', [], ORDER_TYPES)}"
    types = ", ".join(EVENT_TYPES)

    sql["daily_series"] = f"""{event_daily}
SELECT {day()} AS issued_date, total_alerts, {r('severity_score')} AS severity_score, {types}, {trends([])} FROM series"""
    sql["daily_type_pivot"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', ['region'], EVENT_TYPES, [])}
SELECT region, {day()} AS issued_date, total_alerts, {types} FROM series"""
    sql["daily_by_type_region"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', ['type', 'region'], [])}
SELECT type, region, {day()} AS issued_date, total_alerts, {r('severity_score')} AS severity_score, {trends(['type', 'region'])} FROM series"""
    sql["type_region_subtotals"] = f"""WITH {EVENT_ALERTS}
SELECT type, region, count(*) AS total_alerts, CAST(grouping(type, region) AS BIGINT) AS level FROM alerts GROUP BY CUBE (type, region)"""
    sql["gap_filled_orders"] = f"{order_daily} SELECT {day()} AS issued_date, total_alerts FROM series"
    sql["shipping_daily"] = f"""WITH lines AS (SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag AS type, l_discount / 0.11 AS severity_score FROM lineitem),
{daily_of('lines', [], ['A', 'N', 'R'])}
SELECT {day()} AS issued_date, total_alerts, {r('severity_score')} AS severity_score, A, N, R, {trends([])} FROM series"""

    sql["rolling_features"] = f"{order_daily} SELECT {day()} AS issued_date, total_alerts, {', '.join(rolling(n) for n in (3, 7, 14, 30))} FROM series"
    sql["lag_features"] = f"{order_daily} SELECT {day()} AS issued_date, total_alerts, {lags((1, 2, 3, 7), '0')} FROM series"
    sql["lag30_features"] = f"""{order_daily}
SELECT * FROM (SELECT {day()} AS issued_date, total_alerts, {lags(range(1, 31), None)} FROM series) WHERE lag_30 IS NOT NULL"""
    sql["diff_pct"] = f"{order_daily} SELECT {day()} AS issued_date, total_alerts, {difference(1)}, {difference(7)} FROM series"
    sql["zscores"] = f"{order_daily} SELECT {day()} AS issued_date, total_alerts, {zscore(7)}, {zscore(30)} FROM series"
    sql["ema_features"] = f"""{order_daily}, {NUMBERED}
SELECT {day('a.day')} AS issued_date, a.total_alerts, {', '.join(ema(x) for x in (0.1, 0.3, 0.5))}
FROM numbered a JOIN numbered b ON b.rn <= a.rn GROUP BY a.day, a.total_alerts"""
    sql["velocity"] = f"""{event_daily}
SELECT {day()} AS issued_date, total_alerts, total_alerts - lag(total_alerts) OVER w AS velocity,
  total_alerts - 2 * lag(total_alerts) OVER w + lag(total_alerts, 2) OVER w AS acceleration
FROM series WINDOW w AS (ORDER BY day)"""
    risk = """moved AS (SELECT *, coalesce(total_alerts - lag(total_alerts) OVER ({part} ORDER BY day), 0) AS v FROM series),
scored AS (
  SELECT *, coalesce(CAST(total_alerts AS DOUBLE) / nullif(max(total_alerts) OVER ({part}), 0), 0.0) AS volume_score,
         coalesce(CAST(abs(v) AS DOUBLE) / nullif(max(abs(v)) OVER ({part}), 0), 0.0) AS velocity_score FROM moved),
risk AS (SELECT *, (volume_score * 0.4 + severity_score * 0.4 + velocity_score * 0.2) * 100 AS risk_score FROM scored)"""
    sql["risk_score"] = f"""{event_daily}, {risk.format(part='')}
SELECT {day()} AS issued_date, {r('volume_score')} AS volume_score, {r('severity_score')} AS severity_norm,
  {r('velocity_score')} AS velocity_score, {r('risk_score')} AS risk_score FROM risk"""
    sql["risk_band"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', ['region'], [])}, {risk.format(part='PARTITION BY region')},
latest AS (SELECT region, max(day) AS day, arg_max(risk_score, day) AS risk_score FROM risk GROUP BY 1)
SELECT region, {day()} AS issued_date, {r('risk_score')} AS risk_score,
  CASE WHEN risk_score < 30 THEN 'low' WHEN risk_score < 60 THEN 'guarded' WHEN risk_score < 80 THEN 'elevated' ELSE 'critical' END AS band,
  risk_score >= 80 AS alarm, {r('risk_score - 50')} AS above_reference FROM latest"""
    sql["burst_days"] = f"""{event_daily}, {burst_stats([])}
SELECT {day()} AS issued_date, total_alerts, {r('rolling_mean')} AS rolling_mean, {r('rolling_std')} AS rolling_std,
  {r('rolling_mean + 2 * rolling_std')} AS burst_threshold, coalesce({BURST}, false) AS burst FROM flagged"""
    sql["burst_by_type"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', ['region', 'type'], [], [])}, {burst_stats(['region', 'type'])}
SELECT region, type, {day()} AS issued_date, total_alerts, {r('rolling_mean + 2 * rolling_std')} AS burst_threshold FROM flagged WHERE {BURST}"""
    sql["seasonal_decomposition"] = f"""{order_daily}, {NUMBERED},
centred AS (SELECT *, CASE WHEN rn > 3 AND rn <= n - 3 THEN avg(total_alerts) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS c FROM numbered),
lines AS (
  SELECT regr_slope(c, rn) FILTER (rn <= 10) AS s1, regr_intercept(c, rn) FILTER (rn <= 10) AS i1,
         regr_slope(c, rn) FILTER (rn BETWEEN n - 10 AND n - 4) AS s2, regr_intercept(c, rn) FILTER (rn BETWEEN n - 10 AND n - 4) AS i2
  FROM centred WHERE c IS NOT NULL),
trended AS (
  SELECT day, total_alerts, (rn - 1) % 7 AS phase,
         coalesce(c, CASE WHEN rn <= 3 THEN s1 * rn + i1 ELSE s2 * rn + i2 END) AS trend FROM centred, lines),
phases AS (SELECT phase, avg(total_alerts - trend) AS m FROM trended GROUP BY 1),
seasons AS (SELECT phase, m - (SELECT avg(m) FROM phases) AS seasonal FROM phases)
SELECT {day()} AS issued_date, {r('total_alerts')} AS observed, {r('trend')} AS trend, {r('seasonal')} AS seasonal,
  {r('total_alerts - trend - seasonal')} AS resid FROM trended JOIN seasons USING (phase)"""
    sql["yoy_comparison"] = f"""{order_daily},
ranked AS (SELECT *, dense_rank() OVER (ORDER BY year(day) DESC) AS k, count(*) OVER () AS n FROM series)
SELECT strftime(day, '%m-%d') AS month_day, {', '.join(f'max(total_alerts) FILTER (k = {i}) AS year_{i}' for i in (1, 2, 3))}
FROM ranked WHERE n >= 365 AND k <= 3 GROUP BY 1"""
    sql["previous_week"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', ['region'], [])}
SELECT region, {day()} AS issued_date, total_alerts
FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day DESC) AS k FROM series) WHERE k BETWEEN 8 AND 14"""
    sql["filled_prices"] = f"""WITH p AS (
  SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS x FROM orders GROUP BY 1)
SELECT {day()} AS issued_date, {r('''coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING),
  first_value(x IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS urgent_price FROM p"""

    sql["type_correlation"] = correlations(EVENT_TYPES)
    sql["type_share"] = " UNION ALL ".join(
        f"SELECT '{t}' AS type, count(*) FILTER (event_type = '{t}') AS total, {r(f'''count(*) FILTER (event_type = '{t}') / count(*)''')} AS share FROM events"
        for t in EVENT_TYPES
    )
    sql["top_regions"] = f"WITH {LOCATED} SELECT region, count(*) AS n FROM located GROUP BY 1 ORDER BY n DESC, region LIMIT 15"
    sql["kpis"] = f"""{event_daily},
k AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM series),
a AS (SELECT CAST(sum(total_alerts) AS BIGINT) AS total_alerts, avg(total_alerts) AS avg_daily, max(total_alerts) AS peak_daily,
        avg(total_alerts) FILTER (k <= 7) AS recent_avg,
        CASE WHEN count(*) >= 14 THEN avg(total_alerts) FILTER (k BETWEEN 8 AND 14) ELSE 0.0 END AS previous_avg FROM k)
SELECT total_alerts, {r('avg_daily')} AS avg_daily, peak_daily, {r('recent_avg')} AS recent_avg, {r('previous_avg')} AS previous_avg,
  {r('CASE WHEN previous_avg > 0 THEN (recent_avg - previous_avg) / previous_avg * 100 ELSE 0.0 END')} AS change_pct FROM a"""
    sql["dominant_type"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', ['region'], EVENT_TYPES)},
sums AS (
  SELECT region, {', '.join(f'CAST(sum({t}) AS BIGINT) AS {t}' for t in EVENT_TYPES)}
  FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY day DESC) AS k FROM series) WHERE k <= 7 GROUP BY 1)
SELECT region, {best_type(EVENT_TYPES)} AS type, greatest({types}) AS n FROM sums"""
    sql["week_over_week"] = f"""WITH {weekly('type, region')}
SELECT *, {r('CAST(this_week AS DOUBLE) / nullif(last_week, 0)')} AS ratio,
  coalesce(CAST(this_week AS DOUBLE) / nullif(last_week, 0) >= 2, false) AS doubled FROM weeks"""
    sql["week_change"] = f"""WITH {weekly('type, region')},
c AS (SELECT type, region, CASE WHEN last_week <> 0 THEN CAST(this_week - last_week AS DOUBLE) ELSE 0.0 END AS change,
        CASE WHEN last_week <> 0 THEN abs(CAST(this_week - last_week AS DOUBLE) / last_week * 100) ELSE 0.0 END AS percentage FROM weeks)
SELECT type, region, {r('change')} AS change, {r('percentage')} AS percentage,
  CASE WHEN change > 0 THEN 'increase' WHEN change < 0 THEN 'decrease' ELSE 'neutral' END AS direction, percentage > 10 AS significant FROM c"""
    joined = "WITH j AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"
    sql["null_report"] = f"{joined} {null_rows(['doc_id', 'text', 'lang', 'source', 'n_chars', 'quality', 'toxic'])}"
    checked = "CASE WHEN count(*) = 0 THEN 'empty' WHEN (count(*) - count({c})) / count(*) > 0.5 THEN 'mostly_null' ELSE 'ok' END"
    sql["validation"] = f"""{joined} {' UNION ALL '.join(f"SELECT '{c}' AS column_name, {checked.format(c=c)} AS status FROM j" for c in ('doc_id', 'text', 'quality'))}
UNION ALL SELECT 'issued_date' AS column_name, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'missing' END AS status FROM j"""
    sql["date_range"] = f"""SELECT count(*) AS total_records, {day('min(ts)')} AS "start", {day('max(ts)')} AS "end",
  CAST(floor((epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts)))) / 86400) AS BIGINT) AS days FROM events"""
    sql["type_counts"] = "SELECT event_type AS type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1"
    sql["monthly_avg"] = f"""{order_daily},
m AS (SELECT month(day) AS month, avg(total_alerts) AS month_avg FROM series GROUP BY 1)
SELECT CAST(month AS INTEGER) AS month, {r('month_avg')} AS month_avg, {r('avg(month_avg) OVER ()')} AS yearly_avg FROM m"""
    sql["modes"] = f"""WITH {EVENT_ALERTS}
(SELECT 'type' AS name, type AS value, count(*) AS n FROM alerts GROUP BY type ORDER BY n DESC, value LIMIT 1) UNION ALL
(SELECT 'region' AS name, region AS value, count(*) AS n FROM alerts GROUP BY region ORDER BY n DESC, value LIMIT 1) UNION ALL
SELECT 'severity_score' AS name, format('{{:.2f}}', avg(severity_score)) AS value, count(severity_score) AS n FROM alerts"""
    sql["metric_correlation"] = f"""WITH {LOCATED},
d AS (SELECT region, day, count(*) AS total, avg(least(o_totalprice / 500000.0, 1.0)) AS metric FROM located GROUP BY 1, 2)
SELECT region, {r('corr(total, metric)')} AS correlation, count(*) AS n_days FROM d GROUP BY 1"""

    sql["clean_text"] = f"SELECT doc_id, {CLEAN} AS cleaned_text FROM documents"
    sql["clean_turns"] = f"SELECT conv_id, turn, {CLEAN} AS cleaned_text FROM conversations"
    sql["text_metrics"] = rf"""SELECT doc_id, {WORD_COUNT} AS word_count, len(regexp_extract_all(text, '[^.{SPACE}][^.]*')) AS sentence_count,
  {r(f"coalesce(CAST(length(regexp_replace(text, '[{SPACE}]+', '', 'g')) AS DOUBLE) / nullif({WORD_COUNT}, 0), 0.0)")} AS avg_word_length,
  {EXCLAMATIONS} AS exclamation_count,
  len(list_filter({UNICODE_WORDS}, lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) AS all_caps_count,
  {URGENCY} AS urgency_keywords,
  len(list_filter({UNICODE_WORDS}, lambda w: regexp_full_match(w, '\p{{Nd}}+'))) AS numeric_count FROM documents"""
    ranked = """ranked AS (
  SELECT {k}, token, count(*) AS n, min(pos) AS first, row_number() OVER (PARTITION BY {k} ORDER BY count(*) DESC, min(pos)) AS rank FROM tok GROUP BY {k}, token),
top AS (SELECT {k}, string_agg(token, '|' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 5 GROUP BY 1)"""
    sql["keywords_topn"] = f"""WITH {token_rows('doc_id')}, {ranked.format(k='doc_id')}
SELECT doc_id, coalesce(keywords, '') AS keywords FROM documents LEFT JOIN top USING (doc_id)"""
    sql["keyword_counts"] = f"WITH {token_rows('doc_id')} SELECT token, count(*) AS n FROM tok GROUP BY 1"
    sql["keyword_counts_by_source"] = f"WITH {token_rows('source')} SELECT source, token, count(*) AS n FROM tok GROUP BY 1, 2"
    sql["tfidf_top"] = f"""WITH {token_rows('doc_id')},
tf AS (SELECT doc_id, token AS term, count(*) AS tf FROM tok GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT doc_id, tf.term, tf, df, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS tfidf FROM tf JOIN df ON tf.term = df.term),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(tfidf, 9) DESC, term) AS rank FROM s)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, term, tf, df, {r('tfidf')} AS tfidf FROM o WHERE rank <= 3"""
    sql["keyword_spikes"] = f"""WITH {DOCUMENT_ALERTS}, {token_rows('day', 'alerts')},
counts AS (SELECT token, day, count(*) AS total_alerts FROM tok GROUP BY 1, 2),
{gap_free('counts', ['token'], {'total_alerts': '0'})}, {burst_stats(['token'])}
SELECT token, {day()} AS issued_date, total_alerts,
  {r('(total_alerts - rolling_mean) / CASE WHEN rolling_std = 0 THEN 1.0 ELSE rolling_std END')} AS z_score_7 FROM flagged WHERE {BURST}"""
    found = [f"regexp_extract_all(text, '{p}', 1)" for p in (rf"(?i)in\s+({NAME}\s*{PLACE})", rf"(?i)for\s+({NAME}\s*{PLACE})", rf"(?i)({NAME}(?:\s+{NAME})*\s+{PLACE})")]
    unit = r"(?i)(\d+(?:\.\d+)?)\s*(mph|inches|in|feet|ft|°F|°C|degrees|percent|%)"
    times = [r"until\s+(\d{1,2}:\d{2}\s*(?:AM|PM|am|pm))", r"(\d{1,2}/\d{1,2}/\d{4})", r"(\d{4}\s*UTC)"]
    span = r"from\s+(\d{1,2}:\d{2})\s*to\s*(\d{1,2}:\d{2})"
    sql["entities"] = f"""SELECT doc_id, array_to_string(list_sort(list_distinct({' || '.join(found)})), '|') AS locations,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{unit}'),
    lambda m: regexp_extract(m, '{unit}', 1) || ' ' || regexp_extract(m, '{unit}', 2)))), '|') AS measurements,
  array_to_string(list_sort(list_distinct({' || '.join(f"regexp_extract_all(text, '{p}', 1)" for p in times)} ||
    list_transform(regexp_extract_all(text, '{span}'), lambda m: regexp_extract(m, '{span}', 1) || '-' || regexp_extract(m, '{span}', 2)))), '|') AS time_references
FROM documents"""
    sql["classify"] = f"SELECT doc_id, {classified('text')} AS type FROM documents"
    sql["category"] = f"WITH t AS (SELECT {classified('text')} AS type FROM documents) SELECT {categorized('type')} AS alert_category, count(*) AS n FROM t GROUP BY 1"
    mood = f"""WITH {sentiment_rows('doc_id')}
SELECT doc_id, {r('sentiment_score')} AS sentiment_score, {r('subjectivity')} AS subjectivity, {LABEL} AS sentiment_label FROM mood"""
    sql["lexicon_sentiment"] = mood
    sql["lexicon_sentiment_join"] = mood
    sql["processed_alerts"] = f"""WITH {PROCESSED}, {token_rows('alert_id', 'alerts')}, {ranked.format(k='alert_id')}
SELECT alert_id, type, {categorized('type')} AS alert_category, coalesce(keywords, '') AS keywords, {r('sentiment_score')} AS sentiment_score, sentiment_label,
  word_count, urgency_keywords, exclamation_count, {r('severity_score')} AS severity_score,
  CAST(isodow(day) - 1 AS INTEGER) AS day_of_week, CAST(weekofyear(day) AS INTEGER) AS week_of_year
FROM processed LEFT JOIN top USING (alert_id)"""
    sql["severity_score"] = f"WITH {PROCESSED} SELECT alert_id, {r('severity_score')} AS severity_score FROM processed"
    means = ["severity_score", "sentiment_score", "word_count"]
    sql["document_daily"] = f"""WITH {PROCESSED}, {daily_of('processed', [], ALERT_TYPES, means)}
SELECT {day()} AS issued_date, total_alerts, {', '.join(f'{r(m)} AS {m}' for m in means)}, {', '.join(ALERT_TYPES)}, {trends([])} FROM series"""
    parts = {"hour": "hour(ts)", "day_of_week": "isodow(ts) - 1", "day_of_year": "dayofyear(ts)", "week_of_year": "weekofyear(ts)", "month": "month(ts)", "year": "year(ts)"}
    sql["time_parts"] = f"SELECT event_id, {', '.join(f'CAST({e} AS INTEGER) AS {n}' for n, e in parts.items())} FROM events"
    numbers = {"day_of_week": "isodow(day) - 1", "day_of_month": "day(day)", "week_of_year": "weekofyear(day)", "month": "month(day)", "quarter": "quarter(day)", "year": "year(day)"}
    circle = {"day_of_week_sin": "sin(2 * pi() * (isodow(day) - 1) / 7)", "day_of_week_cos": "cos(2 * pi() * (isodow(day) - 1) / 7)",
              "month_sin": "sin(2 * pi() * month(day) / 12)", "month_cos": "cos(2 * pi() * month(day) / 12)"}
    sql["calendar_features"] = f"""{order_daily} SELECT {day()} AS issued_date,
  {', '.join(f'CAST({e} AS INTEGER) AS {n}' for n, e in numbers.items())}, {', '.join(f'{r(e)} AS {n}' for n, e in circle.items())} FROM series"""
    sql["parsed_dates"] = """SELECT o_orderkey, strftime(CASE WHEN o_orderkey % 3 = 1 THEN date_trunc('day', o_orderdate) ELSE o_orderdate END, '%Y-%m-%d %H:%M:%S') AS issued_date,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS effective_date FROM orders"""
    sql["number_formats"] = f"""SELECT p_partkey, {short_number('p_retailprice')} AS price, {short_number('(p_retailprice / 7000)')} AS small,
  {short_number('(p_retailprice * 7000)')} AS large FROM part"""

    sql["dedupe_keep_last"] = f"""SELECT user_id, event_type, {day()} AS day, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id, {r('value')} AS value
FROM (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"""
    sql["upsert_batches"] = f"""WITH {EVENT_ALERTS} SELECT alert_id, type, region,
  CASE WHEN type = 'error' THEN 1.0 ELSE {r('severity_score')} END AS severity_score, CAST(CASE WHEN type = 'error' THEN 1 ELSE 0 END AS BIGINT) AS batch_seq FROM alerts"""
    sql["recent_25"] = f"""WITH {EVENT_ALERTS} SELECT alert_id, strftime(issued_date, '%Y-%m-%d %H:%M') AS issued_date, type, region, {r('severity_score')} AS severity_score
FROM (SELECT * FROM alerts ORDER BY issued_date DESC, alert_id DESC LIMIT 25)"""
    sql["retention"] = """SELECT event_type AS type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS oldest FROM events
WHERE ts >= TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 7 DAY GROUP BY 1"""
    sql["freshness"] = f"""WITH t AS (
  SELECT 'events' AS table_name, max(ts) AS u FROM events UNION ALL SELECT 'orders', max(o_orderdate) FROM orders UNION ALL SELECT 'nothing', NULL),
a AS (SELECT *, (epoch(TIMESTAMP '2024-01-31 12:00:00') - epoch(date_trunc('second', u))) / 3600.0 AS age_hours FROM t)
SELECT table_name, strftime(u, '%Y-%m-%d %H:%M:%S') AS last_updated, {r('age_hours')} AS age_hours,
  CASE WHEN age_hours IS NULL THEN 'N/A' WHEN age_hours < 24 THEN 'fresh' WHEN age_hours < 72 THEN 'stale' ELSE 'outdated' END AS status FROM a"""
    sql["range_region_filter"] = f"""WITH {EVENT_ALERTS} SELECT alert_id, type, region, {r('severity_score')} AS severity_score FROM alerts
WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND type IN ('click', 'error') AND region IN ('region_1', 'region_2')"""

    sql["forecast_features"] = f"""{order_daily},
f AS (SELECT day, lead(total_alerts) OVER w AS label, lag(total_alerts, 30) OVER w AS l30 FROM series WINDOW w AS (ORDER BY day)),
k AS (SELECT *, row_number() OVER (ORDER BY day) AS rn, count(*) OVER () AS n FROM f WHERE label IS NOT NULL AND l30 IS NOT NULL)
SELECT 'total_alerts' AS target, rn > floor(n * 0.8) AS is_test, count(*) AS n, {day('min(day)')} AS first_day, {day('max(day)')} AS last_day,
  {r('avg(label)')} AS mean_label FROM k GROUP BY 2"""
    sql["insight_rules"] = f"""{order_full},
k AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM series),
a AS (SELECT avg(total_alerts) FILTER (k <= 7) AS now, CASE WHEN count(*) >= 14 THEN avg(total_alerts) FILTER (k BETWEEN 8 AND 14) ELSE 0.0 END AS prev FROM k),
s AS (SELECT {', '.join(f'sum({t}) AS {t}' for t in ORDER_TYPES)} FROM k WHERE k <= 7),
m AS (SELECT month(day) AS month, avg(total_alerts) AS avg, count(*) AS n FROM series GROUP BY 1),
y AS (SELECT max(avg) FILTER (month = 8) AS m, avg(avg) AS y, sum(n) AS n FROM m)
SELECT 1 AS seq, 'activity' AS rule, CASE
  WHEN now > prev * 1.5 AND prev > 0 THEN format('Alert activity has increased significantly in the past week (average {{:.1f}} alerts/day vs {{:.1f}} previously).', now, prev)
  WHEN now < prev * 0.7 AND prev > 0 THEN format('Alert activity has decreased in the past week (average {{:.1f}} alerts/day vs {{:.1f}} previously).', now, prev)
  ELSE format('Alert activity remains stable at around {{:.1f}} alerts per day.', now) END AS text FROM a
UNION ALL
SELECT 5, 'frequent_type', 'Most frequent alert type recently: ' || upper(t[1]) || t[2:] || ' alerts.' FROM (SELECT {best_type(ORDER_TYPES)} AS t FROM s)
UNION ALL
SELECT 6, 'season', format('Current month typically sees higher than average alert activity ({{:.1f}} vs yearly average {{:.1f}}).', m, y) FROM y WHERE n > 365 AND m > y * 1.3"""

    # The pages' only classed elements are plain ``div class="ad"`` blocks.
    sql["page_sections"] = f"""WITH blocks AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)) AS raw FROM pages),
texts AS (
  SELECT page_id, url, trim(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), E' \\t\\n\\r') AS text FROM blocks)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id) - 1 AS INTEGER) AS seq, left(text, 1000) AS text, url AS link
FROM texts WHERE length(text) > 20"""

    sql["page_alerts"] = f"""WITH items AS (SELECT url, unnest(regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>')) AS item FROM pages),
parts AS (SELECT url, regexp_extract(item, 'href="([^"]*)"', 1) AS href, regexp_extract(item, '>([^<]*)</a>', 1) AS raw FROM items),
read AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+') || href AS link,
  trim(replace(replace(replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), E' \t\n\r') AS title FROM parts)
SELECT sha256(title || '|2024-01-31 12:00:00|Unknown') AS alert_id, title, {classified('title')} AS type, 'Unknown' AS region, '2024-01-31 12:00:00' AS issued_date,
  '' AS effective_date, 'Unknown' AS severity, link FROM read"""
    sql["stream_hourly"] = stream_counts(["type", "region"], "1 HOUR", "date_trunc('hour', issued_date)")
    sql["stream_weekly"] = stream_counts(["type"], "7 DAY", "unnest(generate_series(CAST(day AS TIMESTAMP) - INTERVAL 6 DAY, CAST(day AS TIMESTAMP), INTERVAL 1 DAY))")
    sql["stream_bursts"] = f"""WITH {ARRIVALS}, {watermarks('arrivals')},
closed AS (SELECT s.* FROM sliced s LEFT JOIN marks USING (slice)
  WHERE (mark IS NULL OR CAST(day AS TIMESTAMP) + INTERVAL 1 DAY > mark)
    AND CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 2 DAY FROM events)),
{daily_of('closed', ['type', 'region'], [], [])}, {burst_stats(['type', 'region'])}
SELECT type, region, {day()} AS issued_date, total_alerts, {r('rolling_mean')} AS rolling_mean, {r('rolling_std')} AS rolling_std,
  {r('rolling_mean + 2 * rolling_std')} AS burst_threshold, coalesce({BURST}, false) AS burst FROM flagged"""
    sql["stream_late_alerts"] = f"""WITH {ARRIVALS},
sent AS (
  SELECT alert_id, type, issued_date, arrived, 1 AS sent FROM arrivals
  UNION ALL
  SELECT alert_id, type, CASE WHEN alert_id % 5 = 0 THEN issued_date ELSE issued_date + INTERVAL 10 DAY END, arrived + INTERVAL 15 DAY, 2
  FROM arrivals WHERE alert_id % 5 < 2), {watermarks('sent')},
judged AS (SELECT s.*, mark, mark IS NULL OR date_trunc('millisecond', issued_date) > mark AS in_time FROM sliced s LEFT JOIN marks USING (slice))
SELECT alert_id, strftime(a.issued_date, '%Y-%m-%d %H:%M:%S') AS issued_date, a.type, a.sent FROM judged a
WHERE in_time AND NOT EXISTS (
  FROM judged b WHERE b.alert_id = a.alert_id AND b.sent = 1 AND a.sent = 2 AND b.in_time AND b.issued_date + INTERVAL 2 DAY > a.mark)"""
    sql["stream_upserts"] = f"""WITH {ARRIVALS},
versions AS (
  SELECT alert_id, issued_date, type, region, severity_score, arrived FROM arrivals
  UNION ALL
  SELECT alert_id, issued_date + INTERVAL 3 DAY, 'corrected', region, severity_score, arrived + INTERVAL 15 DAY FROM arrivals WHERE alert_id % 6 = 0),
latest AS (SELECT *, CAST(issued_date AS DATE) AS day FROM versions QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY arrived DESC) = 1)
SELECT {day()} AS issued_date, region, count(*) AS total_alerts, {r('avg(severity_score)')} AS severity_score, {type_counts([*EVENT_TYPES, 'corrected'])}
FROM latest GROUP BY latest.day, region"""
    sql |= model_sql(order_daily, order_full)
    sql["stream_enriched"] = sql["processed_alerts"]
    defaults = ", ".join(f"({-i}, {quoted([t])})" for i, t in enumerate(DEFAULT_INSIGHTS, 1))
    sql["stored_insights"] = f"""SELECT CAST(row_number() OVER (ORDER BY seq) AS INTEGER) AS seq, text FROM ({sql['insight_rules']})
UNION ALL SELECT CAST(i AS INTEGER), t FROM (VALUES {defaults}) d(i, t)"""
    return sql


def model_sql(order_daily: str, order_full: str) -> dict[str, str]:
    """SQL of models with fixed or closed-form parameters and of what follows from flags and forecasts."""
    sql: dict[str, str] = {}
    names = ["total_alerts", "urgent", "high"]
    size = "(tree + place) % 5 + 1"
    sql["forest_scores"] = f"""{order_full.replace('WITH ', 'WITH RECURSIVE ', 1)},
bounds AS (SELECT {', '.join(f'CAST(min({c}) AS DOUBLE) AS lo{i}, CAST(max({c}) AS DOUBLE) AS hi{i}' for i, c in enumerate(names))} FROM series),
rows AS (SELECT day, [{', '.join(f'CAST({c} AS DOUBLE)' for c in names)}] AS x FROM series),
walk AS (
  SELECT day, x, tree, CAST(0 AS BIGINT) AS place, 0 AS steps FROM rows, range(12) t(tree)
  UNION ALL
  SELECT day, x, tree, 2 * place + CASE WHEN x[(tree + place) % 3 + 1] <= [lo0, lo1, lo2][(tree + place) % 3 + 1]
    + ([hi0, hi1, hi2][(tree + place) % 3 + 1] - [lo0, lo1, lo2][(tree + place) % 3 + 1]) * CAST((tree * 7 + place * 13) % 17 + 1 AS DOUBLE) / CAST(18 AS DOUBLE) THEN 1 ELSE 2 END, steps + 1
  FROM walk, bounds WHERE place < 7),
leaves AS (SELECT day, steps + CASE WHEN {size} > 2 THEN 2 * (ln({size} - 1) + 0.5772156649) - 2.0 * ({size} - 1) / ({size}) WHEN {size} = 2 THEN 1.0 ELSE 0.0 END AS path
  FROM walk WHERE place >= 7)
SELECT {day()} AS issued_date, {r('-pow(2.0, -avg(path) / (2 * (ln(7) + 0.5772156649) - 2.0 * 7 / 8))')} AS raw FROM leaves GROUP BY day"""

    targets = ["total_alerts", *ORDER_TYPES]
    long = " UNION ALL ".join(f"SELECT '{t}' AS target, day, CAST({t} AS DOUBLE) AS y FROM series" for t in targets)
    sql["cv_naive"] = f"""{order_full}, long AS ({long}),
counted AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY day) - 1 AS row, count(*) OVER (PARTITION BY target) AS n FROM long),
sized AS (SELECT *, least(5, n // 20) AS k, n // (least(5, n // 20) + 1) AS block FROM counted),
folds AS (SELECT *, (row - (n - k * block)) // block + 1 AS fold, n - k * block + (row - (n - k * block)) // block * block AS first FROM sized WHERE row >= n - k * block),
met AS (SELECT f.target, f.fold, f.y, abs(f.y - c.y) AS miss FROM folds f JOIN counted c ON c.target = f.target AND c.row = f.first - 7 + (f.row - f.first) % 7),
errors AS (SELECT target, fold, avg(miss) AS mae, sqrt(avg(miss * miss)) AS rmse, avg(CASE WHEN y <> 0 THEN miss / abs(y) END) * 100 AS mape FROM met GROUP BY 1, 2)
SELECT target, {r('avg(mae)')} AS mean_mae, {r('stddev_pop(mae)')} AS std_mae, {r('avg(rmse)')} AS mean_rmse, {r('stddev_pop(rmse)')} AS std_rmse,
  {r('avg(mape)')} AS mean_mape, CAST(count(*) AS INTEGER) AS n_folds FROM errors GROUP BY 1"""

    def least_squares(long: str, keys: str, cut: str = "") -> str:
        """CTEs ``long``, ``fitted`` (line over the last week's mean) and ``steps`` (seven days ahead)."""
        by = f"PARTITION BY {keys} ORDER BY day"
        return f"""long AS ({long}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY day DESC) AS k FROM long),
used AS (SELECT * EXCLUDE (k) FROM ranked {cut}),
pairs AS (SELECT *, avg(y) OVER ({by} ROWS 6 PRECEDING) AS m, lead(y) OVER ({by}) AS label, lag(y, 30) OVER ({by}) AS l30 FROM used),
fitted AS (SELECT {keys}, coalesce(regr_slope(label, m), 0.0) AS b, avg(label) - coalesce(regr_slope(label, m), 0.0) * avg(m) AS a,
  sqrt(greatest(var_pop(label) - coalesce(regr_slope(label, m), 0.0) * covar_pop(m, label), 0.0)) AS rmse
  FROM pairs WHERE label IS NOT NULL AND l30 IS NOT NULL GROUP BY {keys}),
steps AS (
  SELECT {keys}, a, b, rmse, max(day) AS day, list(y ORDER BY day)[-7:] AS last, CAST(NULL AS DOUBLE) AS forecast, 0 AS step FROM used JOIN fitted USING ({keys}) GROUP BY ALL
  UNION ALL
  SELECT {keys}, a, b, rmse, CAST(day + INTERVAL 1 DAY AS DATE), list_append(last[2:], greatest(a + b * list_avg(last), 0.0)), greatest(a + b * list_avg(last), 0.0), step + 1
  FROM steps WHERE step < 7)"""

    chosen = " UNION ALL ".join(f"SELECT '{t}' AS target, day, CAST({t} AS DOUBLE) AS y FROM series" for t in names)
    recursive = order_full.replace("WITH ", "WITH RECURSIVE ", 1)
    linear = f"{recursive}, {least_squares(chosen, 'target')}"
    spread = "1.96 * stddev_pop(forecast) OVER (PARTITION BY target)"
    sql["forecast_linear"] = f"""{linear}
SELECT {day()} AS date, target, {r('forecast')} AS forecast, {r(f'greatest(forecast - {spread}, 0)')} AS lower_bound, {r(f'forecast + {spread}')} AS upper_bound
FROM steps WHERE step > 0"""
    located = f"""WITH RECURSIVE located AS (SELECT CAST(o_orderdate AS DATE) AS day, n_name AS region FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
{daily_of('located', ['region'], [], [])}, {least_squares('SELECT region, day, CAST(total_alerts AS DOUBLE) AS y FROM series', 'region')}"""
    sql["forecast_linear_residual"] = f"""{located}
SELECT region, {day()} AS date, 'total_alerts' AS target, {r('forecast')} AS forecast, {r('greatest(forecast - 1.96 * rmse, 0)')} AS lower_bound, {r('forecast + 1.96 * rmse')} AS upper_bound
FROM steps WHERE step > 0"""
    weighed = "greatest(-4.0 + 0.5 * last[-7] + 0.25 * (last[-1] + last[-2] + last[-3]) / 3 + 0.5 * (last[-1] - last[-2]), 0.0)"
    alone = "1.96 * stddev_pop(forecast) OVER ()"
    sql["forecast_weighted"] = f"""{order_daily.replace('WITH ', 'WITH RECURSIVE ', 1)},
steps AS (
  SELECT max(day) AS day, list(CAST(total_alerts AS DOUBLE) ORDER BY day)[-8:] AS last, CAST(NULL AS DOUBLE) AS forecast, 0 AS step FROM series
  UNION ALL
  SELECT CAST(day + INTERVAL 1 DAY AS DATE), list_append(last, {weighed}), {weighed}, step + 1 FROM steps WHERE step < 7)
SELECT {day()} AS date, 'total_alerts' AS target, {r('forecast')} AS forecast, {r(f'greatest(forecast - {alone}, 0)')} AS lower_bound, {r(f'forecast + {alone}')} AS upper_bound
FROM steps WHERE step > 0"""
    sql["forecast_summary"] = f"""{linear}
SELECT {r('avg(forecast)')} AS avg_forecast, {r('max(forecast)')} AS max_forecast, {r('min(forecast)')} AS min_forecast FROM steps WHERE step > 0 AND target = 'total_alerts'"""
    sql["forecast_errors"] = f"""{recursive}, {least_squares(chosen, 'target', 'WHERE k > 7')},
met AS (SELECT s.day, s.target, s.forecast, l.y AS actual, abs(s.forecast - l.y) AS abs_error FROM steps s JOIN long l ON l.target = s.target AND l.day = s.day WHERE step > 0)
SELECT {day()} AS date, target, {r('forecast')} AS forecast, {r('actual')} AS actual, {r('abs_error')} AS abs_error, {r('avg(abs_error) OVER (PARTITION BY target)')} AS mae FROM met"""
    sql["placeholder_forecast"] = """SELECT strftime(CAST(max(o_orderdate) AS DATE) + CAST(i + 1 AS INTEGER), '%Y-%m-%d') AS date, 'total_alerts' AS target,
  CAST(20 AS DOUBLE) AS forecast, CAST(15 AS DOUBLE) AS lower_bound, CAST(25 AS DOUBLE) AS upper_bound FROM orders, range(7) t(i) GROUP BY i"""

    w = "OVER (ORDER BY day"
    lagged = [f"{r(f'coalesce(lag(total_alerts, {k}) {w}), 0)')} AS lag_{k}" for k in range(1, 31)]
    rolled = []
    for n in (3, 7, 14, 30):
        frame = f"{w} ROWS {n - 1} PRECEDING)"
        rolled += [f"{r(f'{f}(total_alerts) {frame}')} AS rolling_{name}_{n}" for f, name in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))]
    calendar = {
        "day_of_week": "isodow(day) - 1", "day_of_month": "day(day)", "week_of_year": "weekofyear(day)", "month": "month(day)", "quarter": "quarter(day)", "year": "year(day)",
        "day_of_week_sin": "sin(2 * pi() * (isodow(day) - 1) / 7)", "day_of_week_cos": "cos(2 * pi() * (isodow(day) - 1) / 7)",
        "month_sin": "sin(2 * pi() * month(day) / 12)", "month_cos": "cos(2 * pi() * month(day) / 12)",
    }
    changed = []
    for k in (1, 7):
        before = f"lag(total_alerts, {k}) {w})"
        changed += [f"{r(f'total_alerts - {before}')} AS diff_{k}", f"{r(f'coalesce(CAST(total_alerts - {before} AS DOUBLE) / nullif({before}, 0), 0)')} AS pct_change_{k}"]
    sql["forecast_values"] = f"""{order_daily}, {NUMBERED},
smooth AS (SELECT a.day, {', '.join(ema(x) for x in (0.1, 0.3, 0.5))} FROM numbered a JOIN numbered b ON b.rn <= a.rn GROUP BY a.day),
wide AS (SELECT day, rn, {r(f'lead(total_alerts) {w})')} AS label, {', '.join([*lagged, *rolled, *(f'{r(e)} AS {c}' for c, e in calendar.items()), *changed])} FROM numbered)
SELECT {day('wide.day')} AS issued_date, wide.* EXCLUDE (day, rn), smooth.* EXCLUDE (day) FROM wide JOIN smooth USING (day) WHERE rn > 30"""

    z30 = f"coalesce((total_alerts - avg(total_alerts) {w} ROWS 29 PRECEDING)) / CASE WHEN stddev_samp(total_alerts) {w} ROWS 29 PRECEDING) = 0 THEN 1.0 ELSE stddev_samp(total_alerts) {w} ROWS 29 PRECEDING) END, 0.0)"
    z7 = z30.replace("29", "6")
    parts = {"day_of_week": "isodow(day) - 1", "day_of_year": "dayofyear(day)", "month": "month(day)", "week_of_year": "weekofyear(day)"}
    trend = {
        "alert_intensity": "round(total_alerts * severity_score, 3)",
        "7_day_avg": f"avg(total_alerts) {w} ROWS 6 PRECEDING)",
        "30_day_avg": f"avg(total_alerts) {w} ROWS 29 PRECEDING)",
        "day_over_day_change": f"coalesce(CAST(total_alerts - lag(total_alerts) {w}) AS DOUBLE) / nullif(lag(total_alerts) {w}), 0) * 100, 0)",
        "rolling_std_7": f"coalesce(stddev_samp(total_alerts) {w} ROWS 6 PRECEDING), 0)",
        "rolling_std_30": f"coalesce(stddev_samp(total_alerts) {w} ROWS 29 PRECEDING), 0)",
        "z_score_7": z7,
        "z_score_30": z30,
    }
    plain = ["total_alerts", *ORDER_TYPES]
    values = [("severity_score", "round(severity_score, 3)"), *((c, c) for c in plain), *parts.items(), *trend.items(), *((f"lag_{k}", f"coalesce(lag(total_alerts, {k}) {w}), 0)") for k in (1, 2, 3, 7))]
    sql["anomaly_values"] = f"""{order_full} SELECT {day()} AS issued_date, {', '.join(f'{r(e)} AS "{c}"' for c, e in values)} FROM series"""

    flagged = f"""{order_full}, scored AS (SELECT *, avg(total_alerts) {w} ROWS 6 PRECEDING) AS mean7, (2 - abs({z30})) / 4 AS score FROM series),
flags AS (SELECT *, score < 0 AS hit, abs(score) AS confidence,
  CASE WHEN abs(score) <= 0.1 THEN 'low' WHEN abs(score) <= 0.3 THEN 'medium' WHEN abs(score) <= 0.5 THEN 'high' ELSE 'critical' END AS severity FROM scored)"""
    sql["flagged_table"] = f"""{flagged} SELECT {day()} AS "Date", total_alerts AS "Alert Count", severity AS "Severity Level", format('{{:.3f}}', confidence) AS "Confidence Score",
  CAST(list_position(['low', 'medium', 'high', 'critical'], severity) AS INTEGER) AS rank FROM flags WHERE hit"""
    sql["flagged_severe"] = f"{flagged} SELECT {day()} AS issued_date, total_alerts, severity AS anomaly_severity FROM flags WHERE hit AND severity <> 'low'"
    sql["flagged_breakdown"] = f"{flagged} SELECT severity AS anomaly_severity, count(*) AS n FROM flags WHERE hit GROUP BY 1"
    sql["flagged_summary"] = f"""{flagged} SELECT count(*) FILTER (hit) AS total_anomalies, count(*) AS total_days, {r('100.0 * count(*) FILTER (hit) / count(*)')} AS anomaly_rate,
  count(*) FILTER (hit AND severity IN ('high', 'critical')) AS high_severity FROM flags"""
    sql["flagged_timeline"] = f"""{flagged} SELECT {day()} AS issued_date, total_alerts, {r('mean7')} AS "7_day_avg", {r('round(severity_score * 100, 3)')} AS severity_index, hit AS is_anomaly,
  CASE WHEN hit THEN severity END AS anomaly_severity FROM flags"""
    deviation = "(total_alerts - mean7) / nullif(mean7, 0) * 100"
    best = f"greatest({', '.join(ORDER_TYPES)})"
    first = "CASE " + " ".join(f"WHEN {t} = {best} THEN '{t}'" for t in ORDER_TYPES) + " END"
    reasons = f"""list_filter([CASE WHEN abs({deviation}) > 50 THEN CASE WHEN {deviation} > 0 THEN 'Above' ELSE 'Below' END || ' 7-day average by ' || format('{{:.1f}}', abs({deviation})) || '%' END,
    CASE WHEN {best} > 0 THEN 'High number of ' || {first} || ' alerts' END,
    CASE WHEN severity_score > 0.7 THEN 'High average alert severity' END], lambda x: x IS NOT NULL)"""
    listed = f"reasoned AS (SELECT *, CASE WHEN len({reasons}) > 0 THEN {reasons} ELSE ['Statistical anomaly detected'] END AS why FROM flags WHERE hit)"
    sql["flagged_reasons"] = f"""{flagged}, {listed} SELECT {day()} AS date, total_alerts, severity, {r('confidence')} AS confidence, array_to_string(why, '|') AS reasons FROM reasoned"""
    sql["unscored_days"] = f"{order_daily} SELECT {day()} AS issued_date, total_alerts, 0.0::DOUBLE AS anomaly_score, false AS is_anomaly, 0.0::DOUBLE AS anomaly_confidence, 'low' AS anomaly_severity FROM series"
    sql["flagged_insights"] = f"""{flagged.replace('WITH ', 'WITH RECURSIVE ', 1)}, {least_squares(chosen, 'target')},
k AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS k FROM flags),
a AS (SELECT avg(total_alerts) FILTER (k <= 7) AS now, avg(total_alerts) FILTER (k BETWEEN 8 AND 14) AS prev,
  count(*) FILTER (k <= 30 AND hit) AS n, max(day) FILTER (k <= 30 AND hit) AS latest, count(*) FILTER (k <= 30 AND hit AND severity IN ('high', 'critical')) AS severe,
  (SELECT 1.5 * avg(forecast) FROM steps WHERE step > 0 AND target = 'total_alerts') AS ahead FROM k),
s AS (SELECT {', '.join(f'sum({t}) AS {t}' for t in ORDER_TYPES)} FROM k WHERE k <= 7),
m AS (SELECT month(day) AS month, avg(total_alerts) AS avg, count(*) AS n FROM series GROUP BY 1),
y AS (SELECT max(avg) FILTER (month = 8) AS m, avg(avg) AS y, sum(n) AS n FROM m),
found AS (
SELECT 1 AS seq, 'activity' AS rule, CASE
  WHEN now > prev * 1.5 AND prev > 0 THEN format('Alert activity has increased significantly in the past week (average {{:.1f}} alerts/day vs {{:.1f}} previously).', now, prev)
  WHEN now < prev * 0.7 AND prev > 0 THEN format('Alert activity has decreased in the past week (average {{:.1f}} alerts/day vs {{:.1f}} previously).', now, prev)
  ELSE format('Alert activity remains stable at around {{:.1f}} alerts per day.', now) END AS text FROM a
UNION ALL SELECT 2, 'anomalies', 'Detected ' || n || ' anomalous days in the past month, most recently on ' || strftime(latest, '%B %d') || '.' FROM a WHERE n > 0
UNION ALL SELECT 3, 'severe_anomalies', 'Found ' || severe || ' high-severity anomalies requiring attention.' FROM a WHERE severe > 0
UNION ALL SELECT 4, 'outlook', CASE WHEN ahead > now * 1.2 THEN 'Forecast predicts increased' ELSE 'Forecast predicts decreased' END
  || format(' alert activity in the coming week (average {{:.1f}} alerts/day expected).', ahead) FROM a WHERE ahead > now * 1.2 OR ahead < now * 0.8
UNION ALL SELECT 5, 'frequent_type', 'Most frequent alert type recently: ' || upper(t[1]) || t[2:] || ' alerts.' FROM (SELECT {best_type(ORDER_TYPES)} AS t FROM s)
UNION ALL SELECT 6, 'season', format('Current month typically sees higher than average alert activity ({{:.1f}} vs yearly average {{:.1f}}).', m, y) FROM y WHERE n > 365 AND m > y * 1.3)
SELECT * FROM found ORDER BY seq LIMIT 4"""
    sql["stored_findings"] = f"""{flagged.replace('WITH ', 'WITH RECURSIVE ', 1)}, {listed}, {least_squares(chosen, 'target')}
SELECT {day()} AS day, array_to_string(why, '; ') AS what, total_alerts FROM reasoned
UNION ALL SELECT {day()}, target, NULL FROM steps WHERE step > 0"""

    sql["alert_keys"] = "SELECT o_orderkey, sha256(o_orderpriority || '|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || o_custkey) AS key FROM orders"
    sql["built_texts"] = """SELECT o_orderkey, o_orderpriority || ' ' || CASE WHEN o_custkey % 3 > 0 THEN o_orderstatus ELSE '' END || ' ' || o_custkey AS text,
  o_orderpriority AS title FROM orders"""
    sql["stored_batches"] = f"""WITH {EVENT_ALERTS} SELECT alert_id, CASE WHEN type = 'error' THEN 'corrected' ELSE type END AS type, region,
  strftime(DATE '2024-02-01' + CAST(CASE WHEN type = 'error' THEN 2 ELSE alert_id % 2 END AS INTEGER), '%Y-%m-%d') AS ingest_date,
  CAST(CASE WHEN type = 'error' THEN 2 ELSE alert_id % 2 END AS BIGINT) AS batch_seq, CAST(CASE WHEN type = 'error' THEN 2 ELSE 1 END AS BIGINT) AS versions FROM alerts"""
    sql["stored_series"] = f"""WITH {EVENT_ALERTS}, {daily_of('alerts', [], EVENT_TYPES)},
trended AS (SELECT {day()} AS issued_date, total_alerts, {r('severity_score')} AS severity_score, {', '.join(EVENT_TYPES)}, {trends([])} FROM series)
SELECT * FROM trended, (VALUES ('alerts_daily'), ('dashboard_data')) c(copy)"""
    return sql
