"""The queries of ``__spark_entry__`` once more as SQL for DuckDB.

Written against the driver's tables only, with native as-of joins, range
frames and plain per-ticker windows, so it shares no method with the package.
"""

_POSITIVE = "('the', 'of', 'is')"
_NEGATIVE = "('and', 'to', 'that')"
_DAY_US = 86_400_000_000
_WIDTH_US = {
    "15m": 900_000_000,
    "1h": 3_600_000_000,
    "4h": 14_400_000_000,
    "24h": _DAY_US,
    "1d": _DAY_US,
}
_LABELS = ("15m", "1h", "4h", "24h")


def _interval(us: int) -> str:
    return f"INTERVAL {us} MICROSECONDS"


def _bucket(width: str, column: str = "timestamp") -> str:
    return f"time_bucket({_interval(_WIDTH_US[width])}, {column})"


def _posts(ticker: str) -> str:
    return f"""posts AS (
  SELECT CAST(event_id AS VARCHAR) AS id, CAST({ticker} AS VARCHAR) AS ticker, ts AS timestamp,
         CASE user_id % 3 WHEN 0 THEN 'reddit' WHEN 1 THEN 'news' ELSE 'twitter' END AS source,
         props AS text, k_score AS sentiment_score,
         (1 + k_score) / 2 * 0.8 AS positive, CAST(0.2 AS DOUBLE) AS neutral,
         (1 - k_score) / 2 * 0.8 AS negative
  FROM (SELECT *, (CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS DOUBLE) - 49.8317283::DOUBLE)
               / 50.0::DOUBLE AS k_score FROM events))"""


def _bars(interval: str, ticker: str) -> str:
    return f"""ticks AS (
  SELECT event_id, CAST({ticker} AS VARCHAR) AS ticker, ts AS timestamp,
         value + 100.0::DOUBLE AS price FROM events),
bars AS (
  SELECT ticker, {_bucket(interval)} AS timestamp,
         first(price ORDER BY t.timestamp, event_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY t.timestamp, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks t GROUP BY 1, 2)"""


def _buckets(width: str = "15m") -> str:
    return f"""buckets AS (
  SELECT ticker, {_bucket(width)} + {_interval(_WIDTH_US[width])} AS timestamp,
         avg(sentiment_score) AS avg_sentiment, count(sentiment_score) AS post_count,
         avg(positive) AS avg_positive, avg(negative) AS avg_negative
  FROM posts GROUP BY 1, 2 HAVING count(sentiment_score) > 0)"""


_ALIGNED = """aligned AS (
  SELECT b.*, coalesce(s.avg_sentiment, 0.0) AS avg_sentiment, coalesce(s.post_count, 0) AS post_count,
         s.avg_positive, s.avg_negative
  FROM bars b ASOF LEFT JOIN buckets s ON b.ticker = s.ticker AND b.timestamp > s.timestamp)"""


def _rolled(labels=_LABELS) -> str:
    means = ",\n         ".join(
        f"avg(avg_sentiment) OVER (PARTITION BY ticker ORDER BY timestamp RANGE BETWEEN "
        f"{_interval(_WIDTH_US[w] - 1)} PRECEDING AND CURRENT ROW) AS sentiment_roll_{w}"
        for w in labels
    )
    return f"rolled AS (\n  SELECT *, {means}\n  FROM aligned)"


def _signals(label: str) -> str:
    roll = f"sentiment_roll_{label}"
    before = f"lag({roll}) OVER (PARTITION BY ticker ORDER BY timestamp)"
    return f"""signals AS (
  SELECT *, coalesce({roll} > 0.4 AND {before} <= 0.4, false) AS entry_signal,
         coalesce({roll} < -0.2 AND {before} >= -0.2, false) AS exit_signal
  FROM rolled)"""


def _frame(interval: str, label: str, ticker: str = "event_type") -> str:
    return ",\n".join(
        [_posts(ticker), _bars(interval, ticker), _buckets(), _ALIGNED, _rolled(), _signals(label)]
    )


# Per bar: position, value as a running product in logs, benchmark, peak.
_EQUITY = """events_ AS (
  SELECT *, CASE WHEN entry_signal AND NOT exit_signal THEN 1
                 WHEN exit_signal AND NOT entry_signal THEN 0 END AS event FROM signals),
held AS (
  SELECT *, coalesce(last_value(event IGNORE NULLS) OVER upto, 0) AS position,
         lag(close) OVER (PARTITION BY ticker ORDER BY timestamp) AS close_was,
         first_value(close) OVER (PARTITION BY ticker ORDER BY timestamp) AS first_close
  FROM events_
  WINDOW upto AS (PARTITION BY ticker ORDER BY timestamp ROWS UNBOUNDED PRECEDING)),
traded AS (
  SELECT *, coalesce(lag(position) OVER (PARTITION BY ticker ORDER BY timestamp), 0) AS was FROM held),
factors AS (
  SELECT *, (CASE WHEN was = 1 THEN close / close_was ELSE 1.0::DOUBLE END)
          * (CASE WHEN position > was THEN 1.0::DOUBLE / 1.001 WHEN position < was THEN 0.999::DOUBLE
             ELSE 1.0::DOUBLE END) AS factor FROM traded),
equity AS (
  SELECT *, exp(sum(ln(factor)) OVER (PARTITION BY ticker ORDER BY timestamp ROWS UNBOUNDED PRECEDING))
            AS value FROM factors),
falls AS (
  SELECT *, value / greatest(1.0, max(value) OVER (PARTITION BY ticker ORDER BY timestamp
            ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM equity)"""

_SUMMARY = """gaps AS (
  SELECT ticker, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY ticker ORDER BY timestamp))
         AS gap FROM bars),
spacing AS (SELECT ticker, median(gap) AS spacing_us FROM gaps WHERE gap IS NOT NULL GROUP BY 1),
figures AS (
  SELECT ticker, count(*) AS n, last(value ORDER BY timestamp) - 1 AS total, min(drawdown) AS fall,
         avg(factor - 1) AS mean1, stddev_samp(factor - 1) AS sd1,
         last(close ORDER BY timestamp) / first(close ORDER BY timestamp) - 1 AS hold,
         avg(coalesce(close / close_was - 1, 0)) AS mean2,
         stddev_samp(coalesce(close / close_was - 1, 0)) AS sd2
  FROM falls GROUP BY 1),
rounded_ AS (
  SELECT f.ticker, CASE WHEN n >= 3 THEN 'ok' ELSE 'too_few_bars' END AS status, n AS n_bars,
         CASE WHEN n >= 3 THEN round(total * 100, 3) END AS total_return_pct,
         CASE WHEN n >= 3 AND sd1 > 0 THEN round(mean1 / sd1 * sqrt(365 * 86400000000.0 / spacing_us), 3) END
           AS sharpe_ratio,
         CASE WHEN n >= 3 THEN round(least(fall, 0) * 100, 3) END AS max_drawdown_pct,
         CASE WHEN n >= 3 THEN round(hold * 100, 3) END AS benchmark_total_return_pct,
         CASE WHEN n >= 3 AND sd2 > 0 THEN round(mean2 / sd2 * sqrt(365 * 86400000000.0 / spacing_us), 3) END
           AS benchmark_sharpe_ratio
  FROM figures f LEFT JOIN spacing USING (ticker))"""

_RESENT = """resent AS (
  SELECT id, ticker, timestamp + INTERVAL 1 DAY AS timestamp, -sentiment_score AS sentiment_score
  FROM posts WHERE ticker = 'click'
  UNION ALL SELECT 'v' || id, ticker, timestamp, sentiment_score FROM posts WHERE ticker = 'view')"""

_MERGED = f"""WITH {_posts("event_type")},
{_RESENT},
merged AS (
  SELECT id, ticker, timestamp, sentiment_score FROM resent
  UNION ALL SELECT id, ticker, timestamp, sentiment_score FROM posts
  WHERE id NOT IN (SELECT id FROM resent))
SELECT id, ticker, timestamp, round(sentiment_score, 6) AS sentiment_score FROM merged"""

_LATE_CUT = "event_id % 50 = 0"
_FIELDS = "id, ticker, timestamp, source, text"
_WIRE = (
    "'{\"id\":\"' || id || '\",\"ticker\":\"' || ticker || '\",\"timestamp\":\"' || "
    "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%fZ') || '\",\"source\":\"' || source || "
    "'\",\"text\":\"' || replace(text, '\"', '\\\"') || '\"}'"
)

_SUBSCRIPTIONS = """chats AS (
  SELECT user_id AS chat_id, arg_min(event_type, event_id) AS ticker, min(ts) AS subscribed_at,
         CASE user_id // 2 % 4 WHEN 0 THEN '15m' WHEN 1 THEN '1h' WHEN 2 THEN '4h' ELSE '24h' END AS label
  FROM events WHERE user_id % 2 = 0 GROUP BY 1)"""

_CROSSINGS = """crossings AS (
  SELECT ticker, timestamp, CASE WHEN entry_signal THEN 'entry' ELSE 'exit' END AS kind,
         CASE WHEN entry_signal THEN 0.4::DOUBLE ELSE -0.2::DOUBLE END AS threshold
  FROM signals WHERE entry_signal OR exit_signal)"""

_ALERT_BARS = {"15m": "15m", "1h": "1h", "4h": "1h", "24h": "1d"}


def _due(label: str) -> str:
    return f"""SELECT chat_id, ticker, timestamp, kind, threshold FROM (
WITH {_frame(_ALERT_BARS[label], label)},
{_SUBSCRIPTIONS},
{_CROSSINGS},
newest AS (
  SELECT ticker, max(timestamp) AS timestamp FROM signals
  WHERE timestamp <= TIMESTAMP '2024-01-16 12:00' GROUP BY 1)
SELECT chat_id, c.* FROM newest JOIN crossings c USING (ticker, timestamp) JOIN chats USING (ticker)
WHERE label = '{label}' AND timestamp >= subscribed_at)"""


def _history(label: str) -> str:
    return f"""SELECT chat_id, ticker, timestamp, kind, threshold FROM (
WITH {_frame(_ALERT_BARS[label], label)},
{_SUBSCRIPTIONS},
{_CROSSINGS}
SELECT chat_id, c.* FROM crossings c JOIN chats USING (ticker)
WHERE label = '{label}' AND timestamp >= subscribed_at)"""


_PROVIDER = f"""{_bars("15m", "event_type")},
provider AS (SELECT ticker, timestamp, open, high, low, close - 101.0::DOUBLE AS close, volume FROM bars)"""


def _scored(tokens: str) -> str:
    return f"""tokens AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, lang AS ticker,
         TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS timestamp, source, text,
         {tokens} AS words FROM documents),
logits AS (
  SELECT *, CAST(len(list_filter(words, lambda w: w IN {_POSITIVE})) AS DOUBLE) AS p,
         CAST(len(list_filter(words, lambda w: w IN {_NEGATIVE})) AS DOUBLE) AS n FROM tokens),
exps AS (
  SELECT *, exp(p - greatest(p, n, 0)) AS ep, exp(0 - greatest(p, n, 0)) AS eu,
         exp(n - greatest(p, n, 0)) AS en FROM logits),
scored AS (
  SELECT id, ticker, timestamp, source, text, ep / (ep + eu + en) AS positive, eu / (ep + eu + en) AS neutral,
         en / (ep + eu + en) AS negative, (ep - en) / (ep + eu + en) AS sentiment_score FROM exps)"""


_TOKENS = "regexp_extract_all(lower(text), '[a-z]+')"
_SCORE_OUT = """SELECT id, ticker, timestamp, source, round(positive, 6) AS positive, round(neutral, 6) AS neutral,
       round(negative, 6) AS negative, round(sentiment_score, 6) AS sentiment_score FROM scored"""

_BUCKET_OUT = """ticker, timestamp, round(avg_sentiment, 6) AS avg_sentiment, post_count,
       round(avg_positive, 6) AS avg_positive, round(avg_negative, 6) AS avg_negative"""
_BAR_OUT = """ticker, timestamp, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low,
       round(close, 6) AS close, round(volume, 6) AS volume"""
_ALIGNED_OUT = f"""{_BAR_OUT}, round(avg_sentiment, 6) AS avg_sentiment, post_count,
       round(avg_positive, 6) AS avg_positive, round(avg_negative, 6) AS avg_negative"""
_ROLL_OUT = ", ".join(f"round(sentiment_roll_{w}, 6) AS sentiment_roll_{w}" for w in _LABELS)


def _frame_query(interval: str, label: str, ticker: str = "event_type") -> str:
    return f"""WITH {_frame(interval, label, ticker)}
SELECT {_ALIGNED_OUT},
       {_ROLL_OUT}, entry_signal, exit_signal FROM signals"""


def _backtest_query(interval: str, label: str, ticker: str = "event_type") -> str:
    return f"""WITH {_frame(interval, label, ticker)},
{_EQUITY},
{_SUMMARY}
SELECT *, round(total_return_pct - benchmark_total_return_pct, 3) AS excess_return_points FROM rounded_"""


def _spacing_query(ticker: str) -> str:
    return f"""WITH {_bars("15m", ticker)},
gaps AS (
  SELECT ticker, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY ticker ORDER BY timestamp))
         AS gap FROM bars)
SELECT ticker, CAST(median(gap) AS DOUBLE) AS spacing_us FROM gaps WHERE gap IS NOT NULL GROUP BY 1"""


def _aligned_query(interval: str, ticker: str) -> str:
    return f"""WITH {_posts(ticker)},
{_bars(interval, ticker)},
{_buckets()},
{_ALIGNED}
SELECT {_ALIGNED_OUT} FROM aligned"""


def _bucket_query(width: str, where: str = "") -> str:
    return f"WITH {_posts('event_type')},\n{_buckets(width)}\nSELECT {_BUCKET_OUT} FROM buckets {where}"


def _bar_query(interval: str) -> str:
    return f"WITH {_bars(interval, 'event_type')}\nSELECT {_BAR_OUT} FROM bars"


def statements() -> dict[str, str]:
    posts = _posts("event_type")
    hourly = _frame("1h", "1h")
    quarterly = f"{_frame('15m', '15m')},\n{_EQUITY}"
    ranked = f"""WITH {_posts("user_id")},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC, id) AS rank FROM posts)"""
    scored = f"WITH {_scored(_TOKENS)}"
    due = " UNION ALL ".join(map(_due, _ALERT_BARS))
    return {
        "parse_posts": f"""WITH {posts}
SELECT * FROM (SELECT {_FIELDS} FROM posts JOIN events ON CAST(event_id AS VARCHAR) = id WHERE NOT {_LATE_CUT}
  UNION ALL SELECT NULL, NULL, NULL, NULL, NULL FROM events WHERE {_LATE_CUT})""",
        "validate_posts": f"""WITH {posts}
SELECT {_FIELDS} FROM posts JOIN events ON CAST(event_id AS VARCHAR) = id WHERE NOT {_LATE_CUT}""",
        "rejected_posts": f"""WITH {posts},
wire AS (SELECT {_WIRE} AS value FROM posts JOIN events ON CAST(event_id AS VARCHAR) = id WHERE {_LATE_CUT})
SELECT left(value, length(value) - 5) AS value, 'malformed' AS reason FROM wire""",
        "serialize_posts": f"WITH {posts}\nSELECT ticker AS key, {_WIRE} AS value FROM posts",
        "posts_by_date": f"""WITH {posts}
SELECT ticker, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS posts FROM posts GROUP BY 1, 2""",
        "dedupe_posts": _MERGED,
        "upsert_posts": _MERGED,
        "stored_posts": _MERGED,
        "compacted_posts": _MERGED,
        "label_posts": f"""WITH {posts}
SELECT id, round(sentiment_score, 6) AS sentiment_score,
       CASE WHEN sentiment_score > 0.2 THEN 'positive' WHEN sentiment_score < -0.2 THEN 'negative'
            ELSE 'neutral' END AS label FROM posts""",
        "normalize_ticker": f"""WITH {posts}
SELECT id, upper(ticker) AS ticker FROM posts WHERE ticker IN ('click', 'view', 'error', 'purchase')""",
        "tickers": f"WITH {_posts('user_id')}\nSELECT DISTINCT ticker FROM posts",
        "recent_posts": f"""{ranked}
SELECT ticker, id, timestamp, source, round(sentiment_score, 6) AS sentiment_score, rank
FROM ranked WHERE rank <= 50""",
        "recent_posts_one_ticker": f"""WITH {posts}
SELECT ticker, id, timestamp, source, round(sentiment_score, 6) AS sentiment_score
FROM posts WHERE ticker = 'click' ORDER BY timestamp DESC, id LIMIT 50""",
        "post_feed": f"""{scored},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC, id) AS rank FROM scored)
SELECT ticker, id,
       CASE WHEN sentiment_score > 0.2 THEN 'positive' WHEN sentiment_score < -0.2 THEN 'negative'
            ELSE 'neutral' END AS label,
       strftime(timestamp, '%Y-%m-%d %H:%M UTC') AS time, source,
       substring(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                 '"', '&quot;'), '''', '&#x27;'), 1, 200) AS text
FROM ranked WHERE rank <= 10""",
        "score_posts": f"{scored}\n{_SCORE_OUT}",
        "score_posts_udf": f"{scored}\n{_SCORE_OUT}",
        "ingest_stream": f"{scored}\n{_SCORE_OUT} WHERE CAST(id AS BIGINT) % 50 <> 0",
        "ohlcv_15m": _bar_query("15m"),
        "ohlcv_1h": _bar_query("1h"),
        "ohlcv_1d": _bar_query("1d"),
        "normalize_bars": f"""WITH {_PROVIDER},
wanted AS (SELECT * FROM provider WHERE close > 0 AND ticker IN ('click', 'view', 'error'))
SELECT {_BAR_OUT} FROM wanted
WHERE timestamp BETWEEN TIMESTAMP '2024-01-21' AND TIMESTAMP '2024-01-31'""",
        "rejected_bars": f"WITH {_PROVIDER}\nSELECT {_BAR_OUT} FROM provider WHERE NOT close > 0",
        "upsert_bars": f"""WITH {_bars("1h", "event_type")},
merged AS (
  SELECT ticker, timestamp, open, high, low, CASE WHEN ticker = 'click' THEN close + 1 ELSE close END AS close,
         volume FROM bars
  UNION ALL SELECT ticker, timestamp + INTERVAL 60 DAY, open, high, low, close, volume FROM bars
  WHERE ticker = 'view')
SELECT {_BAR_OUT} FROM merged""",
        "bar_spacing": _spacing_query("event_type"),
        "bar_spacing_users": _spacing_query("user_id"),
        "sentiment_15m": _bucket_query("15m"),
        "sentiment_1h": _bucket_query("1h"),
        "sentiment_24h": _bucket_query("24h"),
        "bucket_stream": _bucket_query(
            "15m", "WHERE timestamp <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
        ),
        "asof_align": _aligned_query("15m", "event_type"),
        "asof_align_users": _aligned_query("1h", "user_id"),
        "rolling_sentiment": f"""WITH {_frame("15m", "1h")}
SELECT ticker, timestamp, round(avg_sentiment, 6) AS avg_sentiment, {_ROLL_OUT} FROM rolled""",
        "signals": f"""WITH {_frame("15m", "15m")}
SELECT ticker, timestamp, round(avg_sentiment, 6) AS avg_sentiment,
       round(sentiment_roll_15m, 6) AS sentiment_roll_15m, entry_signal, exit_signal FROM signals""",
        "signal_frame": _frame_query("1h", "1h"),
        "signal_frame_15m": _frame_query("15m", "15m"),
        "signal_frame_24h": _frame_query("1d", "24h"),
        "signal_frame_users": _frame_query("1h", "4h", "user_id"),
        "asof_stored": _aligned_query("1h", "user_id"),
        "signal_frame_stored": _frame_query("1h", "4h", "user_id"),
        "latest_signal": f"""{_frame_query("1h", "1h")}
QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY timestamp DESC) = 1""",
        "chart_series": f"""WITH {hourly}
SELECT ticker, timestamp, round(close, 6) AS close, round(sentiment_roll_1h, 6) AS sentiment,
       CASE WHEN coalesce(sentiment_roll_1h, 0) >= 0 THEN 'up' ELSE 'down' END AS direction FROM signals""",
        "equity_curve": f"""WITH {quarterly}
SELECT ticker, timestamp, CAST(position AS INTEGER) AS position, round(value, 6) AS value,
       round(value - 1, 6) AS cumulative_return FROM falls""",
        "benchmark_curve": f"""WITH {_bars("15m", "event_type")}
SELECT ticker, timestamp, round(close, 6) AS close,
       round(close / first_value(close) OVER (PARTITION BY ticker ORDER BY timestamp) - 1, 6)
         AS benchmark_cumulative_return FROM bars""",
        "drawdown": f"WITH {quarterly}\nSELECT ticker, timestamp, round(drawdown, 6) AS drawdown FROM falls",
        "returns_series": f"""WITH {quarterly}
SELECT ticker, timestamp, round((value - 1) * 100, 4) AS strategy_pct,
       round((close / first_close - 1) * 100, 4) AS benchmark_pct FROM falls""",
        "backtest_summary": _backtest_query("1h", "1h"),
        "backtest_summary_15m": _backtest_query("15m", "15m"),
        "backtest_summary_users": _backtest_query("1h", "1h", "user_id"),
        "alerts": due,
        "alerts_new": f"SELECT * FROM ({due}) WHERE chat_id % 4 <> 0",
        "bucket_table": _bucket_query("15m"),
        "dedupe_stream": f"WITH {posts}\nSELECT id, ticker, timestamp, source FROM posts",
        "post_stream": f"""WITH {posts}
SELECT {_FIELDS} FROM posts JOIN events ON CAST(event_id AS VARCHAR) = id WHERE NOT {_LATE_CUT}""",
        "written_rows": f"""WITH {posts},
{_RESENT}
SELECT 0 AS batch_id, count(*) AS rows FROM posts UNION ALL SELECT 1, count(*) FROM resent""",
        "market_alerts": " UNION ALL ".join(map(_history, _ALERT_BARS)),
        "backtest_stream": _backtest_query("1h", "1h"),
        "dedupe_history": f"WITH {posts}\nSELECT id, ticker, timestamp, source FROM posts",
        "live_buckets": _bucket_query("15m"),
        "live_bars": _bar_query("15m"),
        "live_table": _MERGED,
        "alert_history": f"WITH {hourly},\n{_CROSSINGS}\nSELECT ticker, timestamp, kind, threshold FROM crossings",
        "alert_stream": f"""WITH {hourly},
{_SUBSCRIPTIONS},
{_CROSSINGS}
SELECT chat_id, ticker, timestamp, kind, threshold FROM crossings JOIN chats USING (ticker)
WHERE label = '1h' AND timestamp >= subscribed_at""",
    }
