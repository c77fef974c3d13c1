"""The registry: a query is a function of (spark, sf_dir) with, where SQL can say it, the SQL for the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}

#: Common table expressions for the market records of the star-schema tables.
TR = "tr AS (SELECT event_type AS instrument, ts, event_id AS seq, CAST(100 + value AS DECIMAL(18,6)) AS price, CAST(1 + CAST(json_extract(props, '$.k') AS BIGINT) AS DECIMAL(18,6)) AS size FROM events)"
FT = "ft AS (SELECT 'I' || (user_id % 5) AS instrument, ts, event_id AS seq, CAST(100 + value AS DECIMAL(18,6)) AS price, CAST(1 + CAST(json_extract(props, '$.k') AS BIGINT) AS DECIMAL(18,6)) AS size FROM events WHERE event_type IN ('click', 'purchase'))"
FQ = "fq AS (SELECT 'I' || (user_id % 5) AS instrument, ts, event_id AS seq, CAST(99.5 + value AS DECIMAL(18,6)) AS bid, CAST(100.5 + value AS DECIMAL(18,6)) AS ask FROM events WHERE event_type = 'view')"
BAR = TR + ", bar AS (SELECT instrument, date_trunc('hour', ts) AS open_ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close, CAST(sum(size) AS DECIMAL(18,6)) AS volume, count(*) AS n_trades, date_trunc('hour', ts) + INTERVAL 1 HOUR AS close_ts FROM tr GROUP BY ALL)"
SIDE = FT + ", " + FQ + """, q AS (SELECT ft.*, fq.bid, fq.ask, fq.ts AS qts, lag(ft.price) OVER (PARTITION BY ft.instrument ORDER BY ft.ts, ft.seq) AS prev
  FROM ft ASOF LEFT JOIN fq ON ft.instrument = fq.instrument AND ft.ts >= fq.ts),
cl0 AS (SELECT *, CASE WHEN qts IS NULL THEN 'no_quote_available' WHEN ts - qts > INTERVAL 2 HOUR THEN 'quote_stale' WHEN price >= ask THEN 'at_or_above_ask'
  WHEN price <= bid THEN 'at_or_below_bid' WHEN price > prev THEN 'tick_up' WHEN price < prev THEN 'tick_down' ELSE 'inside_spread' END AS reason FROM q),
cl AS (SELECT *, CASE WHEN reason IN ('at_or_above_ask', 'tick_up') THEN 'BUY' WHEN reason IN ('at_or_below_bid', 'tick_down') THEN 'SELL' ELSE 'UNKNOWN' END AS side FROM cl0)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def doubles(df, *names: str):
    """Decimals to doubles, for comparison across engines."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.col(n).cast("double") for n in names})


def dbl(*names: str) -> str:
    return ", ".join(f"{n}::DOUBLE AS {n}" for n in names)
