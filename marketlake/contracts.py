"""Data contracts: which columns a table must and may have, and what each row must obey."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class FieldRule:
    """One declared column. ``kind`` is string, integer, number, boolean, date or date-time."""

    name: str
    kind: str
    nullable: bool = False
    required: bool = True
    minimum: float | None = None
    maximum: float | None = None
    above: float | None = None
    allowed: tuple = ()


@dataclass(frozen=True)
class Contract:
    name: str
    version: int
    fields: tuple[FieldRule, ...] = field(default_factory=tuple)

    @property
    def title(self) -> str:
        return f"{self.name}.v{self.version}"

    @property
    def required(self) -> list[str]:
        return [f.name for f in self.fields if f.required]

    @property
    def declared(self) -> set[str]:
        return {f.name for f in self.fields}


def from_json_schema(document: dict) -> Contract:
    """Build a contract from a JSON Schema document titled ``<name>.v<version>``."""
    name, _, version = document["title"].rpartition(".v")
    required = set(document.get("required", []))
    fields = []
    for column, rule in document.get("properties", {}).items():
        types = rule["type"] if isinstance(rule["type"], list) else [rule["type"]]
        base = next(t for t in types if t != "null")
        fields.append(
            FieldRule(
                column,
                rule.get("format", base) if base == "string" else base,
                nullable="null" in types,
                required=column in required,
                minimum=rule.get("minimum"),
                maximum=rule.get("maximum"),
                above=rule.get("exclusiveMinimum"),
                allowed=tuple(rule.get("enum", ())),
            )
        )
    return Contract(name, int(version), tuple(fields))


def load_contract(folder: str, name: str, version: int = 1) -> Contract:
    """Read ``<name>.v<version>.json`` from a folder of contract files."""
    return from_json_schema(
        json.loads((Path(folder) / f"{name}.v{version}.json").read_text(encoding="utf-8"))
    )


def _text(name, **kw):
    return FieldRule(name, "string", **kw)


def _int(name, **kw):
    return FieldRule(name, "integer", **kw)


def _num(name, **kw):
    return FieldRule(name, "number", **kw)


def _flag(name, **kw):
    return FieldRule(name, "boolean", **kw)


def _day(name, **kw):
    return FieldRule(name, "date", **kw)


def _time(name, **kw):
    return FieldRule(name, "date-time", **kw)


# --- fixed values: the registered contracts ---------------------------------------------

EXCHANGES = ("HOSE", "HNX", "UPCOM")
EVENT_TYPES = ("trade", "quote", "index_update")
ACTION_TYPES = ("cash_dividend", "stock_dividend", "split")

_PRICES = (
    _num("open", above=0),
    _num("high", above=0),
    _num("low", above=0),
    _num("close", above=0),
    _int("volume", minimum=0),
)
_PRICE_KEYS = (_text("ticker_id"), _day("trade_date"))
_EVENT_TAIL = (
    _int("source_offset", required=False),
    _time("kafka_ts", required=False),
    _time("_ingested_at", required=False),
)
_FEATURE_TIMES = (_time("event_timestamp"), _time("created_ts"))

RAW_OHLCV_V1 = Contract("raw_ohlcv_daily", 1, _PRICE_KEYS + _PRICES)
RAW_OHLCV_V2 = Contract(
    "raw_ohlcv_daily",
    2,
    RAW_OHLCV_V1.fields + (_num("value", minimum=0), _num("foreign_room", minimum=0)),
)
RAW_MARKET_EVENTS = Contract(
    "raw_market_events",
    1,
    (
        _text("payload_json"),
        _int("source_offset"),
        _int("source_partition"),
        _text("source_topic"),
        _time("kafka_ts", required=False),
        _text("kafka_key", required=False, nullable=True),
        _time("_ingested_at"),
    ),
)
STG_TRADES = Contract(
    "stg_trades",
    1,
    (
        _text("event_id"),
        _time("event_ts"),
        _time("created_ts_parsed", required=False),
        _text("session_type", required=False),
        _text("ticker"),
        _text("exchange", required=False),
        _num("price", above=0),
        _int("quantity", minimum=1),
        _text("side", required=False, allowed=("buy", "sell")),
        _text("trade_id"),
        *_EVENT_TAIL,
        _flag("_late_flag", required=False),
    ),
)
STG_QUOTES = Contract(
    "stg_quotes",
    1,
    (
        _text("event_id"),
        _time("event_ts"),
        _time("created_ts_parsed", required=False),
        _text("session_type", required=False),
        _text("ticker"),
        _text("exchange", required=False),
        _num("bid_price", above=0),
        _int("bid_qty", required=False, minimum=0),
        _num("ask_price", above=0),
        _int("ask_qty", required=False, minimum=0),
        *_EVENT_TAIL,
        _flag("_late_flag", required=False),
    ),
)
STG_QUARANTINE = Contract(
    "stg_events_quarantine",
    1,
    (
        _text("event_id"),
        _text("event_type", allowed=EVENT_TYPES),
        _time("event_ts"),
        _time("created_ts_parsed", required=False),
        _text("session_type", required=False),
        _text("ticker", required=False, nullable=True),
        _text("exchange", required=False),
        *_EVENT_TAIL,
    ),
)
DIM_TICKER = Contract(
    "dim_ticker",
    1,
    (
        _int("ticker_key"),
        _text("ticker_id"),
        _text("ticker"),
        _text("company_name"),
        _text("exchange", allowed=EXCHANGES),
        _text("listing_status", allowed=("active", "inactive")),
        _text("icb_l1", required=False, nullable=True),
        _text("icb_l2", required=False, nullable=True),
        _flag("is_vn30"),
        _time("valid_from_ts"),
        _time("valid_to_ts", required=False, nullable=True),
        _flag("is_current"),
    ),
)
FACT_DAILY_PRICE = Contract(
    "fact_daily_price",
    1,
    (
        _int("ticker_key", nullable=True),
        _int("date_key", nullable=True),
        *_PRICE_KEYS,
        *_PRICES,
        _num("value", required=False, nullable=True, minimum=0),
        _num("foreign_room", required=False, nullable=True, minimum=0),
        _int("_schema_version", required=False, allowed=(1, 2)),
        _num("adj_close", above=0),
        _time("created_ts"),
    ),
)
FEAT_TICKER_DAILY = Contract(
    "feat_ticker_daily",
    1,
    (
        *_PRICE_KEYS,
        *_FEATURE_TIMES,
        _num("f_ticker_return_5d", required=False, nullable=True),
        _num("f_ticker_volatility_20d", required=False, nullable=True),
        _num("f_ticker_ma20_gap", required=False, nullable=True),
        _num("f_ticker_foreign_net_ratio_10d", required=False, nullable=True),
    ),
)
FEAT_STREAM_INTRADAY = Contract(
    "feat_stream_intraday",
    1,
    (
        _text("ticker_id"),
        _time("event_timestamp"),
        _time("created_ts", required=False),
        _int("f_stream_volume_5m", required=False, minimum=0),
        _int("f_stream_trade_count_30m", required=False, minimum=0),
        _num("f_stream_price_momentum_30m", required=False),
        _int("f_stream_burst_flag", required=False, minimum=0, maximum=1),
    ),
)
# Rules of the relational reference tables.
TICKERS = Contract(
    "tickers",
    1,
    (
        _text("ticker_id"),
        _text("ticker"),
        _text("company_name"),
        _text("exchange", allowed=EXCHANGES),
        _text("icb_l1", required=False, nullable=True),
        _text("icb_l2", required=False, nullable=True),
        _flag("is_active", required=False),
        _flag("vn30", required=False),
    ),
)
CORPORATE_ACTIONS = Contract(
    "corporate_actions",
    1,
    (
        _text("action_id"),
        _text("ticker_id"),
        _text("action_type", allowed=ACTION_TYPES),
        _day("ex_date"),
        _num("ratio", above=0),
        _time("announced_ts", required=False),
    ),
)

REGISTRY = {
    c.title: c
    for c in (
        RAW_OHLCV_V1,
        RAW_OHLCV_V2,
        RAW_MARKET_EVENTS,
        STG_TRADES,
        STG_QUOTES,
        STG_QUARANTINE,
        DIM_TICKER,
        FACT_DAILY_PRICE,
        FEAT_TICKER_DAILY,
        FEAT_STREAM_INTRADAY,
        TICKERS,
        CORPORATE_ACTIONS,
    )
}
