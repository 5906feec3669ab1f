"""Contract checks as DataFrames, and a gate that raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.contracts import Contract, FieldRule

VIOLATION_SCHEMA = "contract string, rule string, column_name string, rows bigint"

_KIND_TYPES = {
    "string": (T.StringType,),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "number": (T.IntegralType, T.FractionalType),
    "boolean": (T.BooleanType,),
    "date": (T.DateType, T.StringType),
    "date-time": (T.TimestampType, T.TimestampNTZType, T.StringType),
}


class ContractViolation(ValueError):
    """The table breaks its contract."""


def unexpected_columns(df: DataFrame, contract: Contract) -> list[str]:
    """Columns the contract does not know; technical ones are exempt."""
    return [
        c
        for c in df.columns
        if c not in contract.declared and not c.startswith("_") and c != "schema_version"
    ]


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [c for c in contract.required if c not in df.columns]


Check = tuple[str, str, str, Column]


def _counts_to_rows(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Count every check in one pass over the data and unpivot the single result row."""
    spark = df.sparkSession
    if not checks:
        return spark.createDataFrame([], VIOLATION_SCHEMA)
    counted = df.agg(*[F.count_if(check[3]).alias(f"c{i}") for i, check in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(
                F.lit(title).alias("contract"),
                F.lit(rule).alias("rule"),
                F.lit(column).alias("column_name"),
                F.col(f"c{i}").alias("rows"),
            )
            for i, (title, rule, column, _) in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows))


def _structure_of(df: DataFrame, contracts: list[Contract]) -> DataFrame:
    absent = [
        (contract.title, "missing_required", c, 0)
        for contract in contracts
        for c in missing_columns(df, contract)
    ]
    extra = [
        (contract.title, "unregistered", c, F.col(c).isNotNull())
        for contract in contracts
        for c in unexpected_columns(df, contract)
    ]
    missing = df.sparkSession.createDataFrame(absent, VIOLATION_SCHEMA)
    return missing.unionByName(_counts_to_rows(df, extra).filter("rows > 0"))


def check_structure(df: DataFrame, contract: Contract) -> DataFrame:
    """Structural findings: required columns that are absent, unknown columns with data.

    An unknown column that is NULL throughout passes, so a vendor may add a field
    ahead of time. All unknown columns are probed by one aggregate.
    """
    return _structure_of(df, [contract])


def enforce(df: DataFrame, contract: Contract) -> DataFrame:
    """Return ``df`` unchanged or raise when its structure breaks the contract."""
    missing = missing_columns(df, contract)
    if missing:
        raise ContractViolation(f"{contract.title}: missing required columns {sorted(missing)}")
    extra = unexpected_columns(df, contract) if contract.fields else []
    if extra:
        seen = df.agg(*[F.bool_or(F.col(c).isNotNull()).alias(c) for c in extra]).first()
        populated = [c for c in extra if seen[c]]
        if populated:
            raise ContractViolation(f"{contract.title}: unregistered columns {sorted(populated)}")
    return df


def _row_checks(rule: FieldRule, data_type: T.DataType) -> list[tuple[str, str, Column]]:
    c = F.col(rule.name)
    checks = []
    if not isinstance(data_type, _KIND_TYPES[rule.kind]):
        checks.append(("type", rule.name, c.isNotNull()))
        return checks
    if not rule.nullable:
        checks.append(("not_null", rule.name, c.isNull()))
    if rule.allowed:
        checks.append(("enum", rule.name, c.isNotNull() & ~c.isin(*rule.allowed)))
    if rule.minimum is not None:
        checks.append(("minimum", rule.name, c < rule.minimum))
    if rule.maximum is not None:
        checks.append(("maximum", rule.name, c > rule.maximum))
    if rule.above is not None:
        checks.append(("exclusive_minimum", rule.name, c <= rule.above))
    if isinstance(data_type, T.StringType) and rule.kind in ("date", "date-time"):
        parsed = c.try_cast("date") if rule.kind == "date" else c.try_cast("timestamp")
        checks.append(("format", rule.name, c.isNotNull() & parsed.isNull()))
    return checks


def _rules_of(df: DataFrame, contracts: list[Contract]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    checks = [
        (contract.title, *check)
        for contract in contracts
        for rule in contract.fields
        if rule.name in types
        for check in _row_checks(rule, types[rule.name])
    ]
    return _counts_to_rows(df, checks)


def check_rows(df: DataFrame, contract: Contract) -> DataFrame:
    """Row rules of the contract with the number of rows that break each one."""
    return _rules_of(df, [contract])


def check_tables(tables: list[tuple[DataFrame, Contract]], rows: bool = False) -> DataFrame:
    """Findings over a list of stored tables, stacked.

    A frame that is listed with several contracts is read once for all of them.
    """
    by_frame: dict[int, tuple[DataFrame, list[Contract]]] = {}
    for df, contract in tables:
        by_frame.setdefault(id(df), (df, []))[1].append(contract)
    check = _rules_of if rows else _structure_of
    return reduce(DataFrame.unionByName, [check(df, listed) for df, listed in by_frame.values()])
