import json

import pytest

from marketlake import contracts
from marketlake.contracts import REGISTRY, from_json_schema, load_contract
from marketlake.operators.contract import (
    ContractViolation,
    check_rows,
    check_structure,
    check_tables,
    enforce,
)

V1 = "ticker_id string, trade_date date, open double, high double, low double, close double, volume long"
ROW = ("A", "2025-01-02", 1.0, 2.0, 0.5, 1.5, 10)


def test_valid_frame_passes_unchanged(frame):
    df = frame(V1, [ROW])
    assert enforce(df, contracts.RAW_OHLCV_V1) is df
    assert check_structure(df, contracts.RAW_OHLCV_V1).count() == 0


def test_missing_required_column(frame):
    df = frame(V1, [ROW]).drop("close")
    with pytest.raises(ContractViolation, match="missing required"):
        enforce(df, contracts.RAW_OHLCV_V1)
    found = check_structure(df, contracts.RAW_OHLCV_V1).collect()
    assert [(r.rule, r.column_name) for r in found] == [("missing_required", "close")]


def test_unregistered_column_fails_only_with_data(frame):
    df = frame(V1 + ", extra double", [ROW + (None,), ROW + (None,)])
    enforce(df, contracts.RAW_OHLCV_V1)
    populated = frame(V1 + ", extra double", [ROW + (None,), ROW + (3.0,)])
    with pytest.raises(ContractViolation, match="unregistered"):
        enforce(populated, contracts.RAW_OHLCV_V1)
    found = check_structure(populated, contracts.RAW_OHLCV_V1).first()
    assert (found.rule, found.column_name, found.rows) == ("unregistered", "extra", 1)


def test_technical_columns_are_exempt(frame):
    df = frame(V1 + ", _batch_id string, schema_version int", [ROW + ("b", 1)])
    enforce(df, contracts.RAW_OHLCV_V1)


def test_row_rules(frame):
    rows = [
        ("A", "2025-01-02", 1.0, 2.0, 0.5, -1.5, 10),
        ("B", None, 0.0, 2.0, 0.5, 1.5, -1),
    ]
    counts = {
        (r.rule, r.column_name): r.rows
        for r in check_rows(frame(V1, rows), contracts.RAW_OHLCV_V1).collect()
    }
    assert counts["exclusive_minimum", "close"] == 1
    assert counts["exclusive_minimum", "open"] == 1
    assert counts["not_null", "trade_date"] == 1
    assert counts["minimum", "volume"] == 1
    assert counts["not_null", "ticker_id"] == 0


def test_enum_type_and_format_rules(frame):
    rows = [
        ("1", "A", "split", "2025-01-02", 2.0, "soon"),
        ("2", "A", "merger", "2025-01-02", 2.0, "2025-01-01 10:00:00"),
    ]
    df = frame(
        "action_id string, ticker_id string, action_type string, ex_date date, ratio double, "
        "announced_ts string",
        rows,
    )
    counts = {
        (r.rule, r.column_name): r.rows
        for r in check_rows(df, contracts.CORPORATE_ACTIONS).collect()
    }
    assert counts["enum", "action_type"] == 1
    assert counts["format", "announced_ts"] == 1
    wrong = df.withColumn("ratio", df.ratio.cast("string"))
    counts = {
        (r.rule, r.column_name): r.rows
        for r in check_rows(wrong, contracts.CORPORATE_ACTIONS).collect()
    }
    assert counts["type", "ratio"] == 2


def test_several_tables(frame):
    df = frame(V1, [ROW])
    found = check_tables([(df, contracts.RAW_OHLCV_V1), (df, contracts.RAW_OHLCV_V2)])
    assert {r.column_name for r in found.collect()} == {"value", "foreign_room"}


def test_contract_from_json_schema(tmp_path):
    document = {
        "title": "quotes.v3",
        "required": ["id"],
        "properties": {
            "id": {"type": "string"},
            "seen": {"type": ["string", "null"], "format": "date-time"},
            "size": {"type": "integer", "minimum": 0, "maximum": 9},
            "side": {"type": "string", "enum": ["buy", "sell"]},
            "price": {"type": "number", "exclusiveMinimum": 0},
        },
    }
    contract = from_json_schema(document)
    assert (contract.name, contract.version, contract.required) == ("quotes", 3, ["id"])
    rules = {f.name: f for f in contract.fields}
    assert rules["seen"].kind == "date-time" and rules["seen"].nullable
    assert (rules["size"].minimum, rules["size"].maximum) == (0, 9)
    assert rules["price"].above == 0 and rules["side"].allowed == ("buy", "sell")
    (tmp_path / "quotes.v3.json").write_text(json.dumps(document), encoding="utf-8")
    assert load_contract(str(tmp_path), "quotes", 3) == contract


def test_registered_contracts_are_complete():
    assert len(REGISTRY) == 12
    assert "value" in REGISTRY["raw_ohlcv_daily.v2"].required
    assert "value" not in REGISTRY["raw_ohlcv_daily.v1"].declared
