"""SQL for DuckDB that gives what each registered query should return.

Written from the meaning of each operator and on purpose in another way than the Spark
code: range joins where Spark uses running products, plain row pairs where Spark counts.
"""

from __future__ import annotations

import re

# Named subqueries over the test tables, in order of dependence.
VIEWS: dict[str, str] = {
    "industry": """
        SELECT * FROM (VALUES (1,'BANK'),(2,'REAL'),(3,'SEC'),(4,'FOOD'),(5,'OIL'),(6,'STEEL'),
            (7,'TECH'),(8,'RETAIL'),(9,'UTIL'),(10,'OTHER')) t(industry_key, icb_code)""",
    "all_ticks": """
        SELECT CAST(l_suppkey AS VARCHAR) AS ticker_id, CAST(l_shipdate AS DATE) AS trade_date,
            (l_orderkey * 8 + l_linenumber) * 64 + CAST(l_quantity AS BIGINT) AS trade_seq,
            l_extendedprice / l_quantity AS price, CAST(l_quantity AS BIGINT) AS quantity,
            CAST(round(l_extendedprice * 100) AS BIGINT) AS value_cents,
            CAST(round(l_tax * 100) AS BIGINT) AS room,
            l_linestatus AS direction, l_returnflag AS vendor
        FROM lineitem""",
    "ticks": "SELECT * FROM all_ticks",
    "vendor_bars": """
        SELECT ticker_id, trade_date, vendor,
            arg_min(price, trade_seq) AS "open", max(price) AS high, min(price) AS low,
            arg_max(price, trade_seq) AS "close", CAST(sum(quantity) AS BIGINT) AS volume,
            CAST(sum(value_cents) AS DOUBLE) / CAST(100 AS DOUBLE) AS turnover,
            CAST(sum(room) AS DOUBLE) AS room,
            CASE WHEN trade_date >= DATE '1998-07-01' THEN 2 ELSE 1 END AS _schema_version,
            '2002-01-01 ' || CASE vendor WHEN 'A' THEN '10' WHEN 'N' THEN '11' ELSE '12' END
                || ':00:00' AS _ingested_at
        FROM ticks GROUP BY ticker_id, trade_date, vendor""",
    "raw_bars": """
        SELECT ticker_id, trade_date, vendor, "open", high, low, "close", volume,
            CASE WHEN _schema_version = 2 THEN turnover END AS "value",
            CASE WHEN _schema_version = 2 THEN room END AS foreign_room,
            _schema_version, _ingested_at
        FROM vendor_bars""",
    "staged": """
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY ticker_id, trade_date ORDER BY _ingested_at DESC) AS rn FROM raw_bars)
        WHERE rn = 1""",
    "flow": """
        SELECT ticker_id, trade_date,
            CAST(sum(quantity) FILTER (direction = 'O') AS BIGINT) AS bv,
            CAST(sum(quantity) FILTER (direction = 'F') AS BIGINT) AS sv,
            CAST(sum(value_cents) FILTER (direction = 'O') AS BIGINT) AS bc,
            CAST(sum(value_cents) FILTER (direction = 'F') AS BIGINT) AS sc
        FROM ticks GROUP BY ticker_id, trade_date""",
    "fact_flow": """
        SELECT ticker_id, trade_date, coalesce(bv, 0) AS foreign_buy_vol,
            coalesce(sv, 0) AS foreign_sell_vol, coalesce(bc, 0) AS foreign_buy_value,
            coalesce(sc, 0) AS foreign_sell_value,
            coalesce(bc, 0) - coalesce(sc, 0) AS foreign_net_value
        FROM flow""",
    "tickers": """
        SELECT CAST(s_suppkey AS VARCHAR) AS ticker_id,
            'TK' || CAST(s_suppkey AS VARCHAR) AS ticker, s_name AS company_name,
            CASE r_regionkey % 3 WHEN 0 THEN 'HOSE' WHEN 1 THEN 'HNX' ELSE 'UPCOM' END AS exchange,
            icb_code AS icb_l1, n_name AS icb_l2, s_acctbal > 0 AS is_active,
            s_suppkey < 30 AS vn30, s_acctbal
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey
        JOIN industry ON industry_key = n_nationkey % 10 + 1""",
    "reloaded": """
        SELECT CASE WHEN s_acctbal >= 9000 THEN 'N' ELSE '' END || ticker_id AS ticker_id, ticker,
            company_name || CASE WHEN s_acctbal < 1000 THEN ' Holdings' ELSE '' END AS company_name,
            exchange, is_active
        FROM tickers""",
    "actions": """
        SELECT CAST(o_orderkey AS VARCHAR) AS action_id,
            CAST(CAST(floor(o_custkey / 15.0) AS BIGINT) AS VARCHAR) AS ticker_id,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'split' WHEN '2-HIGH' THEN 'stock_dividend'
                ELSE 'cash_dividend' END AS action_type,
            CAST(o_orderdate AS DATE) AS ex_date,
            (CASE o_orderpriority WHEN '1-URGENT' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)
                + CAST(CAST(round(o_totalprice * 100) AS BIGINT) % 100 + 1 AS DOUBLE)
                    / CAST(1000 AS DOUBLE) AS ratio,
            CAST(o_orderdate AS DATE) - 10 AS announced
        FROM orders""",
    "factors": """
        SELECT ticker_id, ex_date, announced,
            CASE action_type WHEN 'split' THEN ratio ELSE 1 + ratio END AS factor
        FROM actions WHERE action_type <> 'cash_dividend'""",
    "cumulative": """
        SELECT s.ticker_id, s.trade_date, product(f.factor) AS later
        FROM staged s JOIN factors f ON f.ticker_id = s.ticker_id AND f.ex_date > s.trade_date
        GROUP BY s.ticker_id, s.trade_date""",
    "fact": """
        SELECT s.*, s."close" / coalesce(c.later, 1) AS adj_close
        FROM staged s LEFT JOIN cumulative c USING (ticker_id, trade_date)""",
    "obt": """
        SELECT f.ticker_id, f.trade_date, f."close", f.adj_close, f.volume, f."value",
            f.foreign_room, w.foreign_net_value, t.ticker, t.company_name, t.exchange, t.icb_l1,
            t.icb_l2, t.vn30 AS is_vn30,
            (f."close" - lag(f."close") OVER s) / lag(f."close") OVER s * 100 AS pct_change_1d,
            (f."close" - lag(f."close", 5) OVER s) / lag(f."close", 5) OVER s * 100
                AS pct_change_5d,
            f.volume / avg(f.volume) OVER (PARTITION BY f.ticker_id ORDER BY f.trade_date
                ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS volume_vs_ma20_ratio
        FROM fact f LEFT JOIN fact_flow w USING (ticker_id, trade_date)
        LEFT JOIN tickers t ON t.ticker_id = f.ticker_id
        WINDOW s AS (PARTITION BY f.ticker_id ORDER BY f.trade_date)""",
    "obt_flagged": """
        SELECT *, CASE exchange WHEN 'HNX' THEN 10 WHEN 'UPCOM' THEN 15 ELSE 7 END AS limit_pct
        FROM obt""",
    "returns": """
        SELECT f.*, w.foreign_net_value AS net,
            row_number() OVER s AS rn,
            ("close" - lag("close") OVER s) / lag("close") OVER s AS r1,
            ("close" - lag("close", 5) OVER s) / lag("close", 5) OVER s AS r5
        FROM fact f LEFT JOIN fact_flow w USING (ticker_id, trade_date)
        WINDOW s AS (PARTITION BY ticker_id ORDER BY trade_date)""",
    "features": """
        SELECT ticker_id, trade_date, r5 AS f_ticker_return_5d,
            CASE WHEN rn >= 20 THEN stddev_samp(r1) OVER w20 END AS f_ticker_volatility_20d,
            ("close" - avg("close") OVER w20) / avg("close") OVER w20 AS f_ticker_ma20_gap,
            CASE WHEN sum(coalesce("value", 0)) OVER w10 > 0
                THEN CAST(sum(coalesce(net, 0)) OVER w10 AS DOUBLE)
                    / sum(coalesce("value", 0)) OVER w10 END AS f_ticker_foreign_net_ratio_10d
        FROM returns
        WINDOW w20 AS (PARTITION BY ticker_id ORDER BY trade_date
                ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
            w10 AS (PARTITION BY ticker_id ORDER BY trade_date
                ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    "intraday_by_day": """
        SELECT ticker_id, trade_date, CAST(sum(quantity) AS BIGINT) AS f_stream_volume_5m_daily,
            avg(room) AS f_stream_trade_count_30m_avg
        FROM ticks GROUP BY ticker_id, trade_date""",
    "labels": """
        SELECT ticker_id, trade_date, known, CAST(ahead > adj_close * 1.01::DOUBLE AS INTEGER) AS label
        FROM (SELECT ticker_id, trade_date, adj_close,
                lead(adj_close, 3) OVER (PARTITION BY ticker_id ORDER BY trade_date) AS ahead,
                lead(trade_date, 3) OVER (PARTITION BY ticker_id ORDER BY trade_date) AS known
            FROM fact)
        WHERE ahead IS NOT NULL""",
    # --- drift ---
    "dates": "SELECT DISTINCT trade_date FROM staged",
    "base_dates": """
        SELECT trade_date FROM dates WHERE trade_date < DATE '1999-01-01'
        ORDER BY trade_date DESC LIMIT 30""",
    "watch_dates": """
        SELECT trade_date FROM (SELECT trade_date, row_number() OVER (ORDER BY trade_date) AS n
            FROM dates WHERE trade_date >= DATE '1999-01-01') WHERE (n - 1) % 10 = 0""",
    "long": """
        SELECT trade_date, 'f_ticker_return_5d' AS feature_name, f_ticker_return_5d AS v FROM features
        UNION ALL SELECT trade_date, 'f_ticker_volatility_20d', f_ticker_volatility_20d FROM features
        UNION ALL SELECT trade_date, 'f_ticker_ma20_gap', f_ticker_ma20_gap FROM features""",
    "base_values": """
        SELECT feature_name, v FROM long WHERE v IS NOT NULL
            AND trade_date IN (SELECT trade_date FROM base_dates)
            AND (SELECT count(*) FROM base_dates) = 30 AND (SELECT count(*) FROM watch_dates) > 0""",
    "base_stats": """
        SELECT feature_name, min(v) AS lo, max(v) AS hi, count(*) AS n, avg(v) AS mean
        FROM base_values GROUP BY feature_name HAVING count(*) >= 10""",
    "day_values": """
        SELECT feature_name, trade_date, v FROM long WHERE v IS NOT NULL
            AND trade_date IN (SELECT trade_date FROM watch_dates)""",
    "day_stats": """
        SELECT d.feature_name, d.trade_date, count(*) AS n, avg(v) AS mean,
            any_value(b.n) AS bn, least(min(v), any_value(b.lo)) AS lo,
            greatest(max(v), any_value(b.hi)) AS hi
        FROM day_values d JOIN base_stats b USING (feature_name)
        GROUP BY d.feature_name, d.trade_date HAVING count(*) >= 10""",
    "bins": "SELECT unnest(range(10)) AS b",
    "edges": """
        SELECT feature_name, trade_date, n, bn, b,
            CASE WHEN b = 0 THEN CAST('-inf' AS DOUBLE) ELSE lo + b * ((hi - lo) / 10) END AS e0,
            CASE WHEN b = 9 THEN CAST('inf' AS DOUBLE) ELSE lo + (b + 1) * ((hi - lo) / 10) END AS e1
        FROM day_stats, bins""",
    "base_counts": """
        SELECT e.feature_name, e.trade_date, e.b, count(*) AS c FROM edges e
        JOIN base_values x ON x.feature_name = e.feature_name AND x.v >= e.e0 AND x.v < e.e1
        GROUP BY ALL""",
    "day_counts": """
        SELECT e.feature_name, e.trade_date, e.b, count(*) AS c FROM edges e
        JOIN day_values x ON x.feature_name = e.feature_name AND x.trade_date = e.trade_date
            AND x.v >= e.e0 AND x.v < e.e1
        GROUP BY ALL""",
    "shares": """
        SELECT e.feature_name, e.trade_date, any_value(e.n + e.bn) AS total,
            sum((coalesce(d.c, 0) / e.n - coalesce(x.c, 0) / e.bn)
                * ln((coalesce(d.c, 0) / e.n + 1e-6) / (coalesce(x.c, 0) / e.bn + 1e-6))) AS raw
        FROM edges e LEFT JOIN base_counts x USING (feature_name, trade_date, b)
        LEFT JOIN day_counts d USING (feature_name, trade_date, b)
        GROUP BY e.feature_name, e.trade_date""",
    "health": """
        SELECT (SELECT max(trade_date) FROM base_dates) AS monitoring_date, feature_name, mean,
            CAST(0 AS DOUBLE) AS psi FROM base_stats
        UNION ALL
        SELECT trade_date, feature_name, mean,
            CASE WHEN total < 20 THEN 0 ELSE greatest(raw, 0) END
        FROM day_stats JOIN shares USING (feature_name, trade_date)""",
    # --- events ---
    "once": """
        SELECT event_id AS n, CAST(event_id AS VARCHAR) AS event_id, user_id,
            CASE WHEN event_type IN ('purchase', 'click') THEN 'trade'
                WHEN event_type IN ('view', 'signup') THEN 'quote' ELSE 'index_update' END AS event_type,
            CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS ticker,
            event_type AS kind, ts, "value" AS v,
            CAST(regexp_extract(props, '([0-9]+)') AS BIGINT) AS k,
            CASE WHEN hour(ts) < 9 THEN 1 WHEN hour(ts) < 14 THEN 2 WHEN hour(ts) < 15 THEN 3 ELSE 4
                END AS session_key
        FROM events""",
    "deliveries": """
        SELECT *, n * 2 AS source_offset, k AS delay FROM once
        UNION ALL SELECT *, n * 2 + 1, k + 120 FROM once WHERE kind = 'purchase'""",
    "trades": """
        SELECT *, k + 1 AS quantity, v AS price FROM once WHERE event_type = 'trade' AND k <= 60""",
    "closed_at": """
        SELECT date_trunc('millisecond', max(ts)) - INTERVAL 60 SECOND AS bound FROM trades""",
    "tumbling": """
        SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
            time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
            CAST(sum(quantity) AS BIGINT) AS f_stream_volume_5m
        FROM trades GROUP BY ALL""",
    "sliding": """
        SELECT ticker, window_end, count(*) AS f_stream_trade_count_30m,
            arg_min(price, ts) AS first_price, arg_max(price, ts) AS last_price
        FROM (SELECT ticker, price, ts,
                unnest(generate_series(date_trunc('minute', ts) + INTERVAL 1 MINUTE,
                    date_trunc('minute', ts) + INTERVAL 30 MINUTE, INTERVAL 1 MINUTE)) AS window_end
            FROM trades)
        GROUP BY ticker, window_end""",
    # --- skew ---
    "amplified": """
        SELECT s.ticker_id, s.trade_date, CAST(round("close" * volume * 100) AS BIGINT) AS cents,
            CASE WHEN exchange = 'HOSE' THEN 'HOT' ELSE s.ticker_id END AS partition_key,
            CASE WHEN exchange = 'HOSE' THEN 8 ELSE 1 END AS repeats
        FROM staged s JOIN tickers t ON t.ticker_id = s.ticker_id""",
}


def _cut(text: str) -> str:
    """Write ``round(x, d)`` as the cut of doubles that the Spark side of a comparison uses."""
    while (at := text.find("round(")) >= 0:
        depth, end, comma = 1, at + 6, None
        while depth:
            c = text[end]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = end
            end += 1
        value = text[at + 6 : comma or end - 1]
        unit = "1" + "0" * int(text[comma + 1 : end - 1]) if comma else "1"
        text = f"{text[:at]}(floor(({value}) * {unit} + CAST(0.5003 AS DOUBLE)) / {unit}){text[end:]}"
    return text


def with_views(body: str) -> str:
    """Put the named subqueries that a statement needs in front of it."""
    names = list(VIEWS)
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in names:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(body)
    chain = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names if n in needed)
    return _cut(f"WITH {chain}\n{body}" if chain else body)


SQL: dict[str, str] = {}


def oracle(name: str, body: str) -> None:
    SQL[name] = with_views(body)


def _rules(contract: str, view: str, rules: list[tuple[str, str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{contract}' AS contract, '{rule}' AS rule, '{column}' AS column_name, "
        f"count(*) FILTER ({breaks}) AS rows FROM {view}"
        for rule, column, breaks in rules
    )


# --- contracts and shape ---------------------------------------------------------------

oracle(
    "harmonize_versions",
    'SELECT ticker_id, trade_date, vendor, "close", volume, "value", foreign_room, _schema_version FROM raw_bars',
)
oracle("dedup_latest", 'SELECT ticker_id, trade_date, vendor, "close", volume FROM staged')
oracle(
    "dedup_stats",
    """SELECT count(*) AS rows_before, (SELECT count(*) FROM staged) AS rows_after,
        count(*) - (SELECT count(*) FROM staged) AS rows_removed,
        round((count(*) - (SELECT count(*) FROM staged)) * 100 / count(*), 6) AS removed_pct
    FROM raw_bars""",
)
_FLAGS = {
    "_dq_price_positive": '"close" > 0',
    "_dq_high_ge_max": 'high >= greatest("open", "close")',
    "_dq_low_le_min": 'low <= least("open", "close")',
    "_dq_volume_nonneg": "volume >= 0",
}
_ALL_FLAGS = {**_FLAGS, "_dq_value_is_turnover": 'abs("value" - "close" * volume) <= 0.005'}
_JUDGED = {**_ALL_FLAGS, "all_rules": " AND ".join(f"({x})" for x in _ALL_FLAGS.values())}
oracle(
    "dq_flags",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS rule, count(*) FILTER ({x}) AS passed, "
        f"count(*) FILTER (NOT ({x})) AS failed, count(*) FILTER (({x}) IS NULL) AS undecided FROM staged"
        for name, x in _JUDGED.items()
    ),
)
oracle(
    "contract_gate",
    """SELECT 'raw_ohlcv_daily.v2' AS contract, 'missing_required' AS rule, c AS column_name,
        CAST(0 AS BIGINT) AS rows
    FROM (VALUES ('value'), ('foreign_room')) t(c)
    UNION ALL
    SELECT 'raw_ohlcv_daily.v' || v, 'unregistered', c, count(*)
    FROM raw_bars, (VALUES (1, 'value'), (1, 'foreign_room'), (1, 'vendor'), (2, 'vendor')) t(v, c)
    WHERE _schema_version = 2 GROUP BY v, c""",
)
oracle(
    "contract_rules",
    _rules(
        "raw_ohlcv_daily.v2",
        "raw_bars",
        [("not_null", "ticker_id", "ticker_id IS NULL"), ("not_null", "trade_date", "trade_date IS NULL")]
        + [
            r
            for c in ("open", "high", "low", "close")
            for r in (("not_null", c, f'"{c}" IS NULL'), ("exclusive_minimum", c, f'"{c}" <= 0'))
        ]
        + [
            r
            for c in ("volume", "value", "foreign_room")
            for r in (("not_null", c, f'"{c}" IS NULL'), ("minimum", c, f'"{c}" < 0'))
        ],
    )
    + "\nUNION ALL\n"
    + _rules(
        "tickers.v1",
        "tickers",
        [
            ("not_null", c, f"{c} IS NULL")
            for c in ("ticker_id", "ticker", "company_name", "exchange", "is_active", "vn30")
        ]
        + [("enum", "exchange", "exchange NOT IN ('HOSE', 'HNX', 'UPCOM')")],
    )
    + "\nUNION ALL\n"
    + _rules(
        "corporate_actions.v1",
        "actions",
        [
            ("not_null", c, f"{s} IS NULL")
            for c, s in (
                ("action_id", "action_id"),
                ("ticker_id", "ticker_id"),
                ("action_type", "action_type"),
                ("ex_date", "ex_date"),
                ("ratio", "ratio"),
                ("announced_ts", "announced"),
            )
        ]
        + [
            ("enum", "action_type", "action_type NOT IN ('cash_dividend', 'stock_dividend', 'split')"),
            ("exclusive_minimum", "ratio", "ratio <= 0"),
        ],
    ),
)
oracle(
    "ingest_metadata",
    """SELECT ticker_id, trade_date, volume, "value", _schema_version, 'batch-1' AS _batch_id,
        'landing/v' || _schema_version AS _source_path, true AS stamped FROM raw_bars""",
)
_PRICE_COLUMNS = (
    'ticker_id, trade_date, "open", high, low, "close", volume, "value", foreign_room, _schema_version'
)
oracle(
    "stage_daily_price",
    f"SELECT {_PRICE_COLUMNS}, " + ", ".join(f"{x} AS {n}" for n, x in _FLAGS.items()) + " FROM staged",
)
oracle(
    "stage_foreign_flow",
    """SELECT ticker_id, trade_date, b AS foreign_buy_vol, s AS foreign_sell_vol
    FROM (SELECT ticker_id, trade_date, vendor,
            CAST(sum(CASE WHEN direction = 'O' THEN quantity ELSE 0 END) AS BIGINT) AS b,
            CAST(sum(CASE WHEN direction = 'F' THEN quantity ELSE 0 END) AS BIGINT) AS s
        FROM ticks GROUP BY ALL)
    QUALIFY vendor = max(vendor) OVER (PARTITION BY ticker_id, trade_date)""",
)

# --- dimensions --------------------------------------------------------------------------

oracle(
    "dim_date",
    """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS calendar_date,
        dayname(d) AS day_of_week, CAST(month(d) AS INTEGER) AS "month",
        CAST(quarter(d) AS INTEGER) AS "quarter", CAST(year(d) AS INTEGER) AS "year",
        x.trade_date IS NOT NULL AS is_trading_day,
        CASE WHEN isodow(d) > 5 THEN 'weekend' WHEN x.trade_date IS NULL THEN 'market_holiday' END
            AS holiday_name
    FROM (SELECT CAST(unnest(generate_series(min(trade_date), max(trade_date), INTERVAL 1 DAY)) AS DATE) AS d
        FROM staged)
    LEFT JOIN dates x ON x.trade_date = d""",
)
oracle(
    "dim_static",
    """SELECT 'dim_industry' AS dimension, industry_key AS "key", icb_code AS code,
        (SELECT count(*) FROM tickers t WHERE t.icb_l1 = i.icb_code) AS rows FROM industry i
    UNION ALL SELECT 'dim_exchange', k, c, (SELECT count(*) FROM tickers t WHERE t.exchange = c)
    FROM (VALUES (1, 'HOSE'), (2, 'HNX'), (3, 'UPCOM')) x(k, c)
    UNION ALL SELECT 'dim_session', sk, c, (SELECT count(*) FROM once o WHERE o.session_key = y.sk)
    FROM (VALUES (1, 'ATO'), (2, 'CONTINUOUS'), (3, 'ATC'), (4, 'PUT_THROUGH')) y(sk, c)""",
)
oracle(
    "dim_ticker",
    """SELECT ticker_id, ticker, company_name, exchange,
        CASE WHEN is_active THEN 'active' ELSE 'inactive' END AS listing_status, icb_l1, icb_l2,
        vn30 AS is_vn30, TIMESTAMP '2002-01-02 00:00:00' AS valid_from_ts,
        CAST(NULL AS TIMESTAMP) AS valid_to_ts, true AS is_current
    FROM tickers WHERE ticker_id IN (SELECT ticker_id FROM staged)""",
)
oracle(
    "dim_ticker_without_reference",
    """SELECT ticker_id, ticker_id AS ticker, 'Unknown' AS company_name, 'HOSE' AS exchange,
        'active' AS listing_status, CAST(NULL AS VARCHAR) AS icb_l1, CAST(NULL AS VARCHAR) AS icb_l2,
        row_number() OVER (ORDER BY ticker_id) <= 30 AS is_vn30
    FROM (SELECT DISTINCT ticker_id FROM staged)""",
)
oracle(
    "scd2_merge",
    """SELECT o.ticker_id, o.company_name, o.exchange,
        CASE WHEN o.is_active THEN 'active' ELSE 'inactive' END AS listing_status,
        TIMESTAMP '2002-01-02 00:00:00' AS valid_from_ts,
        CASE WHEN n.company_name <> o.company_name THEN TIMESTAMP '2002-02-02 00:00:00' END AS valid_to_ts,
        coalesce(n.company_name = o.company_name, true) AS is_current
    FROM tickers o LEFT JOIN reloaded n ON n.ticker_id = o.ticker_id
    UNION ALL
    SELECT n.ticker_id, n.company_name, n.exchange,
        CASE WHEN n.is_active THEN 'active' ELSE 'inactive' END,
        TIMESTAMP '2002-02-02 00:00:00', NULL, true
    FROM reloaded n LEFT JOIN tickers o ON n.ticker_id = o.ticker_id
    WHERE o.ticker_id IS NULL OR n.company_name <> o.company_name""",
)

# --- facts -----------------------------------------------------------------------------------

oracle(
    "adj_close",
    'SELECT ticker_id, trade_date, "close", round(adj_close, 4) AS adj_close FROM fact',
)
oracle(
    "adj_close_asof",
    """SELECT s.ticker_id, s.trade_date, any_value(s."close") AS "close",
        round(any_value(s."close") / coalesce(product(f.factor), 1), 4) AS adj_close
    FROM staged s LEFT JOIN factors f ON f.ticker_id = s.ticker_id AND f.ex_date > s.trade_date
        AND f.announced <= s.trade_date
    GROUP BY s.ticker_id, s.trade_date""",
)
oracle(
    "fact_daily_price",
    f"""SELECT true AS has_ticker_key, CAST(strftime(trade_date, '%Y%m%d') AS INTEGER) AS date_key,
        {_PRICE_COLUMNS}, round(adj_close, 4) AS adj_close FROM fact""",
)
oracle("fact_foreign_flow", "SELECT * FROM fact_flow")
oracle(
    "fact_intraday",
    """SELECT 'T' || event_id AS trade_id, event_id, ticker AS ticker_id, CAST(ts AS DATE) AS trade_date,
        ts AS event_ts, ts + to_seconds(k) AS created_ts_parsed, price, quantity,
        price * quantity AS trade_value, CASE kind WHEN 'purchase' THEN 'buy' ELSE 'sell' END AS side,
        ticker IN (SELECT ticker_id FROM tickers) AS has_ticker_key,
        CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, session_key
    FROM trades""",
)
oracle(
    "fact_upsert",
    """SELECT ticker_id, trade_date, vendor, "close", volume FROM staged""",
)
oracle(
    "obt_daily",
    """SELECT ticker_id, trade_date, "close", round(adj_close, 4) AS adj_close,
        round(pct_change_1d, 4) AS pct_change_1d, round(pct_change_5d, 4) AS pct_change_5d, volume,
        round(volume_vs_ma20_ratio, 4) AS volume_vs_ma20_ratio, "value", foreign_room,
        foreign_net_value, abs(pct_change_1d) >= limit_pct AS price_limit_hit_flag,
        ticker, company_name, exchange, icb_l1, icb_l2, is_vn30
    FROM obt_flagged""",
)

# --- features and labels -----------------------------------------------------------------------

oracle(
    "feat_daily",
    """SELECT ticker_id, trade_date, CAST(trade_date AS TIMESTAMP) AS event_timestamp,
        round(f_ticker_return_5d, 4) AS f_ticker_return_5d,
        round(f_ticker_volatility_20d, 4) AS f_ticker_volatility_20d,
        round(f_ticker_ma20_gap, 4) AS f_ticker_ma20_gap,
        round(f_ticker_foreign_net_ratio_10d, 4) AS f_ticker_foreign_net_ratio_10d
    FROM features""",
)
oracle(
    "feat_unified",
    """SELECT ticker_id, trade_date, round(f_ticker_return_5d, 4) AS f_ticker_return_5d,
        f_stream_volume_5m_daily,
        round(f_stream_trade_count_30m_avg, 4) AS f_stream_trade_count_30m_avg
    FROM features LEFT JOIN intraday_by_day USING (ticker_id, trade_date)""",
)
oracle(
    "feature_latest",
    """SELECT ticker_id, CAST(trade_date AS TIMESTAMP) AS event_timestamp,
        CAST(_ingested_at AS TIMESTAMP) AS created_ts, "close" AS f_close FROM staged""",
)
_ASOF = """SELECT a.action_id, a.ticker_id, CAST(a.announced AS TIMESTAMP) AS announced_ts,
        CAST(s.trade_date AS TIMESTAMP) AS bar_ts, s."close", s.vendor
    FROM actions a LEFT JOIN staged s ON s.ticker_id = a.ticker_id AND s.trade_date <= a.announced
    QUALIFY row_number() OVER (PARTITION BY a.action_id ORDER BY s.trade_date DESC NULLS LAST) = 1"""
oracle("asof_join", _ASOF)
oracle(
    "asof_join_max_age",
    f"""SELECT action_id, CASE WHEN announced_ts - bar_ts <= INTERVAL 2 DAY THEN bar_ts END AS bar_ts,
        CASE WHEN announced_ts - bar_ts <= INTERVAL 2 DAY THEN "close" END AS "close"
    FROM ({_ASOF})""",
)
oracle(
    "asof_join_hot_key",
    """SELECT o_orderkey, o_orderstatus AS status, shipped, line, l_quantity
    FROM orders ASOF LEFT JOIN (
        SELECT l_linestatus, l_shipdate AS shipped, max(l_orderkey * 8 + l_linenumber) AS line,
            max_by(l_quantity, l_orderkey * 8 + l_linenumber) AS l_quantity
        FROM lineitem GROUP BY ALL) ON o_orderstatus = l_linestatus AND o_orderdate >= shipped""",
)
oracle(
    "label_future",
    """SELECT ticker_id, trade_date, CAST(trade_date AS TIMESTAMP) AS event_timestamp,
        CAST(known AS TIMESTAMP) + INTERVAL '15:10:00' AS created_ts, label FROM labels""",
)
oracle(
    "incremental_chain",
    """SELECT f.ticker_id, f.trade_date, f."close", round(f.adj_close, 4) AS adj_close,
        round(f_ticker_return_5d, 4) AS f_ticker_return_5d,
        round(f_ticker_volatility_20d, 4) AS f_ticker_volatility_20d,
        round(f_ticker_ma20_gap, 4) AS f_ticker_ma20_gap,
        round(f_ticker_foreign_net_ratio_10d, 4) AS f_ticker_foreign_net_ratio_10d, label
    FROM fact f LEFT JOIN features USING (ticker_id, trade_date)
    LEFT JOIN labels l ON l.ticker_id = f.ticker_id AND l.trade_date = f.trade_date""",
)
oracle(
    "bucketed_training",
    """SELECT o.ticker_id, o.trade_date, round(adj_close, 4) AS adj_close, round(pct_change_5d, 4) AS pct_change_5d,
        foreign_net_value, exchange, round(f_ticker_volatility_20d, 4) AS f_ticker_volatility_20d,
        round(f_ticker_foreign_net_ratio_10d, 4) AS f_ticker_foreign_net_ratio_10d, label
    FROM obt o JOIN features USING (ticker_id, trade_date)
    LEFT JOIN labels l ON l.ticker_id = o.ticker_id AND l.trade_date = o.trade_date""",
)
oracle(
    "incremental_reach",
    """SELECT * FROM (WITH changes AS (
        SELECT ticker_id, trade_date,
            trade_date > DATE '1998-10-15'
                OR (vendor = 'R' AND trade_date BETWEEN DATE '1995-03-01' AND DATE '1995-03-07') AS new,
            row_number() OVER (PARTITION BY ticker_id ORDER BY trade_date) AS n
        FROM staged),
    features_of AS (
        SELECT year(c.trade_date) AS y, bool_or(d.new) AS written
        FROM changes c JOIN changes d ON d.ticker_id = c.ticker_id AND d.n BETWEEN c.n - 20 AND c.n
        GROUP BY y),
    labels_of AS (
        SELECT year(c.trade_date) AS y, bool_or(d.new) AS written
        FROM changes c JOIN changes d ON d.ticker_id = c.ticker_id AND d.n BETWEEN c.n AND c.n + 3
        GROUP BY y)
    SELECT 'feat_ticker_daily' AS table_name, CAST(y AS VARCHAR) AS year, NOT written AS kept FROM features_of
    UNION ALL
    SELECT 'ml_ticker_label', CAST(y AS VARCHAR), NOT written FROM labels_of)""",
)
oracle(
    "label_balance",
    """SELECT count(*) AS total, count(*) FILTER (label = 1) AS positive,
        count(*) FILTER (label = 0) AS negative,
        round(count(*) FILTER (label = 1) * 100 / count(*), 6) AS positive_pct FROM labels""",
)
oracle(
    "training_set",
    """SELECT ticker_id, trade_date, CAST(known AS TIMESTAMP) + INTERVAL '15:10:00' AS created_ts, label,
        round(f_ticker_return_5d, 4) AS f_ticker_return_5d,
        round(f_ticker_volatility_20d, 4) AS f_ticker_volatility_20d,
        round(f_ticker_ma20_gap, 4) AS f_ticker_ma20_gap,
        round(f_ticker_foreign_net_ratio_10d, 4) AS f_ticker_foreign_net_ratio_10d,
        f_stream_volume_5m_daily
    FROM labels JOIN features USING (ticker_id, trade_date)
    LEFT JOIN intraday_by_day USING (ticker_id, trade_date)""",
)

# --- monitoring ----------------------------------------------------------------------------------

oracle(
    "psi",
    """SELECT 'o_totalprice' AS feature_name, "month",
        round(greatest(sum((a - e) * ln((a + 1e-6) / (e + 1e-6))), 0), 6) AS psi
    FROM (SELECT g."month", b,
            (SELECT count(*) FROM orders WHERE o_orderdate < DATE '1996-01-01'
                AND (b = 0 OR o_totalprice >= g.lo + b * ((g.hi - g.lo) / 10))
                AND (b = 9 OR o_totalprice < g.lo + (b + 1) * ((g.hi - g.lo) / 10))) / g.bn AS e,
            (SELECT count(*) FROM orders WHERE date_trunc('month', o_orderdate) = g."month"
                AND (b = 0 OR o_totalprice >= g.lo + b * ((g.hi - g.lo) / 10))
                AND (b = 9 OR o_totalprice < g.lo + (b + 1) * ((g.hi - g.lo) / 10))) / g.n AS a
        FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS "month", count(*) AS n,
                any_value(x.bn) AS bn,
                least(min(o_totalprice), any_value(x.lo)) AS lo,
                greatest(max(o_totalprice), any_value(x.hi)) AS hi
            FROM orders, (SELECT count(*) AS bn, min(o_totalprice) AS lo, max(o_totalprice) AS hi
                FROM orders WHERE o_orderdate < DATE '1996-01-01') x
            WHERE o_orderdate >= DATE '1996-01-01' GROUP BY 1) g, bins)
    GROUP BY "month" """,
)
oracle(
    "feature_health",
    """SELECT monitoring_date, feature_name, round(round(mean, 6), 4) AS mean_value,
        round(psi, 4) AS psi_vs_baseline, psi > 0.15 AS alert_flag FROM health""",
)
oracle(
    "drift_alerts",
    """SELECT DATE '2002-03-01' AS alert_date, feature_name, round(psi, 4) AS psi_value,
        'Volatility regime shift suspected; evaluate model performance' AS "action"
    FROM health WHERE psi > 0.15""",
)
oracle(
    "drift_report",
    """SELECT monitoring_date, feature_name, round(psi, 4) AS psi_vs_baseline,
        CASE WHEN round(psi, 4) < 0.05 THEN 'baseline' WHEN round(psi, 4) < 0.15 THEN 'detected'
            WHEN round(psi, 4) < 0.2 THEN 'strong' ELSE 'alert' END AS drift_status FROM health""",
)
oracle(
    "quality_profile",
    """SELECT unnest(['rows', 'distinct_keys', 'distinct_tickers', 'distinct_dates', 'version_1_rows',
            'version_2_rows', 'null_value_rows', 'null_room_rows', 'duplicate_rows', 'duplicate_pct',
            'group_volume_pct']) AS metric,
        unnest([r, k, t, d, v1, v2, nv, nr, r - k, round((r - k) * 100 / r, 4), round(g * 100 / vol, 4)]) AS "value"
    FROM (SELECT CAST(count(*) AS DOUBLE) AS r,
            count(DISTINCT ticker_id || '|' || CAST(trade_date AS VARCHAR)) AS k,
            count(DISTINCT ticker_id) AS t, count(DISTINCT trade_date) AS d,
            count(*) FILTER (_schema_version = 1) AS v1, count(*) FILTER (_schema_version = 2) AS v2,
            count(*) FILTER ("value" IS NULL) AS nv, count(*) FILTER (foreign_room IS NULL) AS nr,
            sum(volume) FILTER (ticker_id IN (SELECT ticker_id FROM tickers WHERE vn30)) AS g,
            sum(volume) AS vol
        FROM raw_bars)""",
)
oracle(
    "burst_profile",
    """SELECT unnest(['events', 'late_events', 'late_pct', 'duplicate_events', 'peak_per_minute',
            'average_per_minute', 'peak_to_average']) AS metric,
        unnest([n, late, round(late * 100 / n, 4), dup, peak, round(n / m, 4), round(peak * m / n, 4)]) AS "value"
    FROM (SELECT CAST(sum(c) AS DOUBLE) AS n, sum(l) AS late, count(*) AS m, max(c) AS peak,
            sum(c) - (SELECT count(*) FROM once) AS dup
        FROM (SELECT date_trunc('minute', ts) AS minute, count(*) AS c, count(*) FILTER (delay <> 0) AS l
            FROM deliveries GROUP BY 1))""",
)
oracle(
    "reconcile",
    """SELECT ticker_id, trade_date, q AS trade_quantity, s.volume, q = s.volume AS quantity_matches,
        lo >= s.low AND hi <= s.high AS prices_inside, last = s."close" AS last_is_close
    FROM (SELECT ticker_id, trade_date, CAST(sum(quantity) AS BIGINT) AS q, min(price) AS lo,
            max(price) AS hi, arg_max(price, trade_seq) AS last FROM ticks GROUP BY ALL)
    FULL JOIN staged s USING (ticker_id, trade_date)""",
)

# --- gates -----------------------------------------------------------------------------------------


def _gate(gate: str, subject: str, checked: str, failed: str, severity: str, source: str) -> str:
    bad = "failed" if severity == "fail" else "warning"
    return (
        f"SELECT '{gate}' AS gate, {subject} AS subject, CAST({checked} AS BIGINT) AS checked, "
        f"CAST({failed} AS BIGINT) AS failed, '{severity}' AS severity, "
        f"CASE WHEN {failed} > 0 THEN '{bad}' ELSE 'passed' END AS status FROM {source}"
    )


_GROUPS = "(SELECT count(*) AS c FROM {} GROUP BY ticker_id, trade_date)"
oracle(
    "gate_uniqueness",
    _gate("uniqueness", "'stg_daily_price'", "sum(c)", "count(*) FILTER (c > 1)", "fail", _GROUPS.format("staged"))
    + "\nUNION ALL\n"
    + _gate("uniqueness", "'raw_ohlcv_daily'", "sum(c)", "count(*) FILTER (c > 1)", "fail", _GROUPS.format("raw_bars")),
)
oracle(
    "gate_duplicates",
    f"""SELECT 'raw_ohlcv_daily' AS subject, CAST(sum(c) AS BIGINT) AS total,
        count(*) FILTER (c > 1) AS duplicate_groups,
        round(count(*) FILTER (c > 1) * 100 / sum(c), 6) AS rate_pct FROM {_GROUPS.format("raw_bars")}""",
)
oracle(
    "gate_nulls",
    "\nUNION ALL\n".join(
        _gate("nulls", f"'raw_ohlcv_daily.{c}'", "count(*)", f'count(*) FILTER ("{c}" IS NULL)', "fail", "raw_bars")
        for c in ("ticker_id", "trade_date", "close", "value", "foreign_room")
    ),
)
_KNOWN = "count(*) FILTER (k IS NULL OR k NOT IN (SELECT ticker_id FROM tickers))"
oracle(
    "gate_referential",
    _gate("referential", "'fact_daily_price'", "count(*)", _KNOWN, "fail", "(SELECT DISTINCT ticker_id AS k FROM staged)")
    + "\nUNION ALL\n"
    + _gate("referential", "'events'", "count(*)", _KNOWN, "fail", "(SELECT DISTINCT ticker AS k FROM once)"),
)
oracle(
    "referential_missing_keys",
    """SELECT DISTINCT ticker AS ticker_id FROM once
    WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker_id FROM tickers)""",
)
_CLOSED = "(isodow(d) > 5 OR strftime(d, '%m-%d') IN ('01-01', '04-30', '05-01', '09-02'))"
_SEEN = "(SELECT DISTINCT trade_date AS d FROM all_ticks)"
oracle(
    "gate_calendar",
    _gate("weekend", "'lineitem'", "count(*)", "count(*) FILTER (isodow(d) > 5)", "warn", _SEEN)
    + "\nUNION ALL\n"
    + _gate("closed_day_facts", "'lineitem'", "count(*)", f"count(*) FILTER ({_CLOSED})", "warn", _SEEN)
    + "\nUNION ALL\n"
    + _gate(
        "missing_trading_days",
        "'lineitem'",
        "count(*)",
        "count(*) FILTER (d NOT IN (SELECT trade_date FROM all_ticks))",
        "warn",
        f"""(SELECT d FROM (SELECT CAST(unnest(generate_series(min(trade_date), max(trade_date),
            INTERVAL 1 DAY)) AS DATE) AS d FROM all_ticks) WHERE NOT {_CLOSED})""",
    ),
)
oracle(
    "gate_domain",
    _gate(
        "domain",
        "'stg_daily_price'",
        "count(*)",
        "count(*) FILTER (NOT (" + " AND ".join(f"({x})" for x in _FLAGS.values()) + "))",
        "warn",
        "staged",
    ),
)
oracle(
    "gate_cardinality",
    """SELECT count(DISTINCT ticker_id) AS exact_keys, count(*) AS exact_pairs, true AS keys_agree,
        true AS pairs_agree FROM staged""",
)
oracle(
    "gate_price_limit",
    _gate(
        "price_limit",
        "exchange",
        "count(pct_change_1d)",
        "count(*) FILTER (abs(pct_change_1d) > limit_pct + 0.01)",
        "warn",
        "obt_flagged",
    )
    + " GROUP BY exchange",
)
oracle(
    "gate_scd2",
    _gate(
        "single_current",
        "'dim_ticker'",
        "count(*)",
        "0",
        "fail",
        "(SELECT ticker_id FROM tickers UNION SELECT ticker_id FROM reloaded)",
    ),
)
oracle(
    "gate_timestamps",
    "\nUNION ALL\n".join(
        _gate("nulls", f"'feat_ticker_daily.{c}'", "count(*)", "0", "fail", "staged")
        for c in ("event_timestamp", "created_ts")
    )
    + "\nUNION ALL\n"
    + _gate("time_order", "'ml_ticker_label'", "count(*)", "count(*) FILTER (known <= trade_date)", "fail", "labels"),
)
oracle(
    "gate_drift",
    _gate("drift", "'feature_health'", "count(*)", "count(*) FILTER (psi > 0.15)", "warn", "health"),
)

# --- reports and reshaping -----------------------------------------------------------------------------

oracle(
    "top_volume",
    """SELECT ticker_id, round(avg(volume), 0) AS avg_volume, round(avg("close"), 2) AS avg_close
    FROM staged WHERE trade_date >= DATE '1999-06-01' GROUP BY ticker_id
    ORDER BY avg_volume DESC, ticker_id LIMIT 10""",
)
oracle(
    "federated_join",
    """SELECT s.ticker_id, company_name, exchange, icb_l1, trade_date, "close", volume
    FROM staged s JOIN tickers t ON t.ticker_id = s.ticker_id
    WHERE trade_date = DATE '1998-07-15' AND is_active ORDER BY volume DESC, s.ticker_id LIMIT 20""",
)
oracle(
    "sector_performance",
    """SELECT icb_l1, count(DISTINCT s.ticker_id) AS ticker_count,
        round(avg(("close" - "open") / "open" * 100), 2) AS avg_daily_return_pct,
        CAST(sum(volume) AS BIGINT) AS total_volume
    FROM staged s JOIN tickers t ON t.ticker_id = s.ticker_id
    WHERE trade_date = DATE '1998-07-15' GROUP BY icb_l1""",
)
oracle(
    "top_movers",
    """SELECT ticker, company_name, exchange, icb_l1, trade_date, "close",
        round(pct_change_1d, 4) AS pct_change_1d, round(pct_change_5d, 4) AS pct_change_5d,
        round(volume_vs_ma20_ratio, 4) AS volume_vs_ma20_ratio,
        abs(pct_change_1d) >= limit_pct AS price_limit_hit_flag
    FROM obt_flagged o WHERE trade_date = DATE '1998-07-15' AND is_vn30
    ORDER BY o.pct_change_1d DESC NULLS LAST, ticker LIMIT 10""",
)
oracle(
    "dimension_rollup",
    """SELECT exchange, icb_l1, count(*) AS bars,
        CAST(sum(CAST(round("close" * volume * 100) AS BIGINT)) AS BIGINT) AS notional_cents
    FROM staged s JOIN tickers t ON t.ticker_id = s.ticker_id GROUP BY exchange, icb_l1""",
)
oracle(
    "share_rescale",
    """SELECT ticker_id, trade_date, vn30, nv AS volume,
        CASE WHEN "value" IS NOT NULL THEN round("close" * nv, 4) END AS "value"
    FROM (SELECT s.ticker_id, trade_date, vn30, "close", "value",
            CAST(CAST(volume AS HUGEINT) * CAST(sum(volume) OVER () AS HUGEINT) * CASE WHEN vn30 THEN 80 ELSE 20 END
                // (CAST(sum(volume) OVER (PARTITION BY vn30) AS HUGEINT) * 100) AS BIGINT) AS nv
        FROM staged s JOIN tickers t ON t.ticker_id = s.ticker_id)""",
)
_OPEN_DAYS = f"""(SELECT d, row_number() OVER (ORDER BY d) AS n
        FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2002-12-31', INTERVAL 1 DAY)) AS DATE) AS d)
        WHERE NOT {_CLOSED})"""
_ORDER_DAYS = "(SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS c FROM orders GROUP BY 1)"
oracle(
    "trading_calendar",
    f"""SELECT o.d AS calendar_date, a.d IS NOT NULL AS is_trading_day, b.d AS next_trading_day,
        o.c AS orders
    FROM {_ORDER_DAYS} o LEFT JOIN {_OPEN_DAYS} a ON a.d = o.d LEFT JOIN {_OPEN_DAYS} b ON b.n = a.n + 3""",
)
oracle(
    "next_trading_days",
    f"""SELECT o.d AS "day", o.c AS orders, CAST(row_number() OVER (PARTITION BY o.d ORDER BY a.d) - 1 AS INTEGER) AS day_no,
        a.d AS trading_day
    FROM {_ORDER_DAYS} o JOIN {_OPEN_DAYS} a ON a.d >= o.d AND a.d < o.d + 40
    QUALIFY day_no < 3""",
)
oracle(
    "lineage_closure",
    """SELECT 'customer:' || c_custkey AS node, 'nation:' || c_nationkey AS upstream, 1 AS depth FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 1 FROM supplier
    UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 1 FROM nation
    UNION ALL SELECT 'customer:' || c_custkey, 'region:' || n_regionkey, 2
        FROM customer JOIN nation ON n_nationkey = c_nationkey
    UNION ALL SELECT 'supplier:' || s_suppkey, 'region:' || n_regionkey, 2
        FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
oracle(
    "scalar_suite",
    """SELECT o_orderkey, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, dayname(d) AS day_name,
        CAST(month(d) AS INTEGER) AS "month", CAST(quarter(d) AS INTEGER) AS "quarter",
        CAST(year(d) AS INTEGER) AS "year", dayofweek(d) IN (0, 6) AS weekend, upper(o_orderstatus) AS status,
        CAST(length(o_orderpriority) AS INTEGER) AS priority_length,
        concat_ws('|', CAST(o_custkey AS VARCHAR), CAST(d AS VARCHAR)) AS composite,
        greatest(o_totalprice, 100000) AS at_least, least(o_totalprice, 100000) AS at_most,
        abs(250000 - o_totalprice) AS distance, round(exp(ln(o_totalprice)), 4) AS exp_log,
        o_custkey % 20 AS pmod20, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status_or_none,
        CAST(NULL AS DOUBLE) AS guarded,
        CASE WHEN o_orderkey % 30 < 5 THEN 'baseline' WHEN o_orderkey % 30 < 15 THEN 'detected'
            WHEN o_orderkey % 30 < 20 THEN 'strong' ELSE 'alert' END AS band
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)

# --- storage ----------------------------------------------------------------------------------------------

oracle(
    "landing_scan",
    """SELECT '2002-01-01' AS run_date, ticker_id, trade_date, _schema_version, "close", volume, "value",
        foreign_room FROM raw_bars
    UNION ALL
    SELECT '2002-01-02', ticker_id, trade_date, NULL, "close", volume, turnover, room
    FROM vendor_bars WHERE vendor = 'R'""",
)
oracle(
    "partitioned_roundtrip",
    """SELECT ticker_id, trade_date, volume, vendor,
        CAST(year(trade_date) * 100 + month(trade_date) AS INTEGER) AS trade_month
    FROM raw_bars WHERE vendor <> 'R' OR year(trade_date) = 1998
    QUALIFY row_number() OVER (PARTITION BY ticker_id, trade_date ORDER BY _ingested_at DESC) = 1""",
)
oracle(
    "csv_report",
    """SELECT CAST(year(trade_date) AS INTEGER) AS "year", count(*) AS bars,
        CAST(sum(volume) AS BIGINT) AS volume FROM staged GROUP BY 1""",
)
oracle(
    "ingest_layers",
    """SELECT 'raw_ohlcv_daily_v1' AS layer, 1 AS _schema_version, count(*) AS bars,
        CAST(sum(volume) AS BIGINT) AS volume, CAST(0 AS BIGINT) AS with_value
    FROM raw_bars WHERE _schema_version = 1
    UNION ALL
    SELECT 'raw_ohlcv_daily_v2', 2, count(*), CAST(sum(volume) AS BIGINT), count(turnover)
    FROM (SELECT volume, turnover FROM vendor_bars WHERE _schema_version = 2
        UNION ALL SELECT volume, turnover FROM vendor_bars WHERE vendor = 'R')""",
)
oracle(
    "maintained_fact",
    """SELECT ticker_id, trade_date, "close", volume, 199807 AS trade_month FROM staged
    WHERE trade_date BETWEEN DATE '1998-07-01' AND DATE '1998-07-31'""",
)
oracle(
    "compaction",
    """SELECT count(*) AS rows, CAST(sum(volume) AS BIGINT) AS volume,
        count(DISTINCT ticker_id) AS tickers, true AS fewer_files FROM raw_bars""",
)
oracle("zorder_cluster", 'SELECT ticker_id, trade_date, vendor, "close", volume FROM raw_bars')
oracle(
    "ops_run_log",
    """SELECT 'staging_2002-01-02T00:00:00' AS run_id, 'staging' AS pipeline,
        '2002-01-02T00:00:00' AS start_time, '2002-01-02T00:05:00' AS end_time, 'success' AS status,
        (SELECT count(*) FROM raw_bars) AS input_rows, (SELECT count(*) FROM staged) AS output_rows,
        CAST(NULL AS VARCHAR) AS error_summary
    UNION ALL
    SELECT 'serving_2002-01-02T00:06:00', 'serving', '2002-01-02T00:06:00', '2002-01-02T00:06:01',
        'failed', (SELECT count(*) FROM staged), NULL, 'target is read-only'""",
)
oracle(
    "replay_log",
    """SELECT CAST(ts AS DATE) AS event_date, CAST(hour(ts) AS INTEGER) AS event_hour, event_type,
        count(*) AS events, count(DISTINCT event_id) AS ids,
        CAST(sum(CASE WHEN event_type = 'trade' THEN k + 1 ELSE 0 END) AS BIGINT) AS quantity
    FROM deliveries GROUP BY ALL""",
)
oracle(
    "kafka_envelope",
    """SELECT coalesce(ticker, 'INDEX') AS "key", ts AS kafka_ts, event_id,
        CASE WHEN event_type = 'trade' THEN v END AS price FROM deliveries""",
)

# --- skew ----------------------------------------------------------------------------------------------------

oracle(
    "skew_profile",
    """SELECT CAST(sum(repeats) AS BIGINT) AS expanded_rows, count(DISTINCT ticker_id) AS ticker_count,
        CAST(coalesce(sum(repeats) FILTER (partition_key = 'HOT'), 0) AS BIGINT) AS hot_rows FROM amplified""",
)
oracle(
    "skew_agg",
    """SELECT partition_key, CAST(sum(repeats) AS BIGINT) AS event_count,
        CAST(sum(cents * repeats) AS BIGINT) AS total_cents
    FROM amplified GROUP BY partition_key ORDER BY event_count DESC, partition_key LIMIT 20""",
)
oracle(
    "skew_join",
    """SELECT partition_key, CAST(sum(repeats) AS BIGINT) AS event_count,
        CAST(sum(cents * repeats * CASE WHEN partition_key = 'HOT' THEN 3 ELSE 2 END) AS BIGINT)
            AS risk_adjusted_cents,
        CAST(sum(repeats) * 64 AS BIGINT) AS token_chars
    FROM amplified GROUP BY partition_key ORDER BY event_count DESC, partition_key LIMIT 20""",
)

# --- events -----------------------------------------------------------------------------------------------------

oracle(
    "json_parse",
    """SELECT source_offset, CASE WHEN kind <> 'error' THEN event_id END AS event_id,
        CASE WHEN kind <> 'error' THEN event_type END AS event_type,
        CASE WHEN event_type = 'trade' THEN v END AS price,
        CASE WHEN event_type = 'trade' THEN k + 1 END AS quantity,
        CASE WHEN event_type = 'quote' THEN v END AS bid_price,
        CASE WHEN event_type = 'quote' THEN k + 2 END AS ask_qty,
        CAST(NULL AS DOUBLE) AS index_value,
        CASE WHEN kind NOT IN ('error', 'click') THEN ts END AS event_ts,
        CASE kind WHEN 'error' THEN 'bad_json' WHEN 'click' THEN 'bad_event_time' END AS reason
    FROM deliveries""",
)
oracle("late_flag", "SELECT source_offset, event_id, delay > 60 AS _late_flag FROM deliveries")
_ROUTES = """SELECT CASE WHEN k > 60 THEN 'stg_events_quarantine' WHEN event_type = 'trade' THEN 'stg_trades'
        ELSE 'stg_quotes' END AS route, event_id, ts AS event_ts, ticker
    FROM once WHERE k > 60 OR event_type <> 'index_update'"""
oracle("event_routing", _ROUTES)
oracle(
    "sliding_momentum",
    "SELECT ticker, window_end, f_stream_trade_count_30m, first_price, last_price FROM sliding",
)
oracle(
    "session_activity",
    """SELECT ticker, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end,
        count(*) AS trades, CAST(sum(quantity) AS BIGINT) AS quantity
    FROM (SELECT *, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY ts) AS sid
        FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY ticker ORDER BY ts) >= INTERVAL 2 HOUR AS gap FROM trades))
    GROUP BY ticker, sid""",
)
oracle(
    "quarantine_replay",
    """SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
        time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
        CAST(sum(k + 1) AS BIGINT) AS f_stream_volume_5m
    FROM once WHERE event_type = 'trade' GROUP BY ALL""",
)
oracle(
    "stream_bronze",
    """SELECT source_offset, n % 4 AS source_partition, 'market_events' AS source_topic,
        coalesce(ticker, 'INDEX') AS kafka_key, ts + to_seconds(delay) AS kafka_ts FROM deliveries""",
)
oracle("stream_dedup", "SELECT event_id, event_type, ticker, k > 60 AS _late_flag FROM once")
oracle("stream_dedup_salted", "SELECT event_id, event_type, ticker FROM once")
oracle("stream_dedup_forever", "SELECT event_id, event_type, ticker FROM once")
oracle("stream_dedup_ttl", "SELECT event_id, event_type FROM once")
oracle("stream_fanout", _ROUTES)
oracle(
    "tumbling_volume",
    """SELECT ticker, window_start, window_end, f_stream_volume_5m FROM tumbling
    WHERE window_end <= (SELECT bound FROM closed_at)""",
)
oracle(
    "stream_features",
    """SELECT ticker AS ticker_id, window_end AS event_timestamp, f_stream_volume_5m,
        f_stream_trade_count_30m,
        CASE WHEN first_price > 0 THEN round((last_price - first_price) / first_price, 4) END
            AS f_stream_price_momentum_30m,
        CAST(f_stream_trade_count_30m > 1.5 AS INTEGER) AS f_stream_burst_flag
    FROM tumbling JOIN sliding USING (ticker, window_end)
    WHERE window_end <= (SELECT bound FROM closed_at)""",
)
oracle(
    "stream_update_upsert",
    """SELECT ticker, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end,
        CAST(sum(k + 1) AS BIGINT) AS f_stream_volume_5m
    FROM deliveries WHERE event_type = 'trade' GROUP BY ALL""",
)
oracle(
    "late_router",
    """SELECT source_offset, event_id, ts AS event_ts,
        kind = 'purchase' AND ts < (SELECT max(ts) FROM once WHERE kind <> 'purchase')
            - INTERVAL 120 SECOND AS late
    FROM deliveries""",
)
oracle(
    "stream_json_sink",
    """SELECT ticker, count(*) AS windows, CAST(sum(f_stream_volume_5m) AS BIGINT) AS volume
    FROM tumbling WHERE window_end <= (SELECT bound FROM closed_at) GROUP BY ticker""",
)
