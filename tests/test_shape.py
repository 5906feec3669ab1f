from pyspark.sql import functions as F

from marketlake.operators import shape
from tests.conftest import plan_of

BAR = "ticker_id string, trade_date date, close double, _ingested_at string"


def test_harmonise_adds_typed_nulls(frame):
    v1 = frame("k string, a int", [("x", 1)])
    v2 = frame("k string, a int, value double", [("y", 2, 3.0)])
    merged = shape.harmonise([v1, v2], {"value": "double", "room": "double"})
    assert dict(merged.dtypes)["room"] == "double"
    rows = {r.k: (r.a, r.value, r.room) for r in merged.collect()}
    assert rows == {"x": (1, None, None), "y": (2, 3.0, None)}


def test_latest_ingest_wins(frame):
    df = frame(
        BAR,
        [
            ("A", "2025-01-02", 1.0, "2025-01-02 10:00"),
            ("A", "2025-01-02", 2.0, "2025-01-02 11:00"),
            ("B", "2025-01-02", 3.0, "2025-01-02 09:00"),
        ],
    )
    out = shape.dedup_latest(df, ["ticker_id", "trade_date"], ["_ingested_at"])
    assert out.columns == df.columns
    assert {(r.ticker_id, r.close) for r in out.collect()} == {("A", 2.0), ("B", 3.0)}
    again = shape.dedup_latest(out, ["ticker_id", "trade_date"], ["_ingested_at"])
    assert sorted(again.collect()) == sorted(out.collect())


def test_dedup_limits_rows_before_the_shuffle(frame):
    df = frame(BAR, [("A", "2025-01-02", 1.0, "x")])
    plan = plan_of(shape.dedup_latest(df, ["ticker_id", "trade_date"], ["_ingested_at"]))
    assert "WindowGroupLimit" in plan
    assert plan.rindex("WindowGroupLimit") > plan.index("Exchange hashpartitioning")


def test_dedup_first(frame):
    df = frame("k string, n int", [("a", 2), ("a", 1), ("b", 5)])
    out = shape.dedup_first(df, ["k"], ["n"])
    assert {(r.k, r.n) for r in out.collect()} == {("a", 1), ("b", 5)}


def test_dedup_stats(frame):
    df = frame("k string", [("a",), ("a",), ("a",), ("b",)])
    row = shape.dedup_stats(df, ["k"]).first()
    assert tuple(row) == (4, 2, 2, 50.0)
    assert tuple(shape.dedup_stats(df.filter("false"), ["k"]).first()) == (0, 0, 0, 0.0)


def test_flags_are_kept_and_three_valued(frame):
    df = frame(
        "open double, high double, low double, close double, volume long",
        [(1.0, 2.0, 0.5, -1.0, 5), (1.0, 2.0, 0.5, 1.0, -5), (1.0, None, 0.5, 1.0, 5)],
    )
    flagged = shape.flag_rules(df, shape.bar_rules())
    assert flagged.count() == 3
    report = {
        r.rule: (r.passed, r.failed, r.undecided)
        for r in shape.rule_failures(flagged, list(shape.bar_rules())).collect()
    }
    assert report["_dq_price_positive"] == (2, 1, 0)
    assert report["_dq_volume_nonneg"] == (2, 1, 0)
    assert report["_dq_high_ge_max"] == (2, 0, 1)
    assert report["all_rules"] == (0, 2, 1)


def test_ingest_columns_leave_the_input_alone(frame):
    df = frame("k string", [("a",)])
    out = shape.add_ingest_columns(df, "b1", 2, "drop/x")
    row = out.first()
    assert (row.k, row._batch_id, row._schema_version, row._source_path) == ("a", "b1", 2, "drop/x")
    assert dict(out.dtypes)["_ingested_at"] == "string" and df.columns == ["k"]


def test_version_boundary(frame):
    df = frame("d date", [("2025-06-30",), ("2025-07-01",)])
    tagged = shape.tag_version(df, "d", "2025-07-01")
    assert [r._schema_version for r in tagged.orderBy("d").collect()] == [1, 2]


def test_upsert_replaces_changed_keys(frame):
    old = frame("k string, v int", [("a", 1), ("b", 2)])
    new = frame("k string, v int", [("b", 3), ("c", 4)])
    merged = shape.upsert(old, new, ["k"])
    assert {(r.k, r.v) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert sorted(shape.upsert(merged, new, ["k"]).collect()) == sorted(merged.collect())


def test_null_safe_change(frame):
    old = frame("k string, v string", [("a", None), ("b", "x"), ("c", None)])
    new = frame("k string, v string", [("a", None), ("b", None), ("c", "y")])
    changed = (
        old.alias("o")
        .join(new.alias("n"), F.col("o.k") == F.col("n.k"))
        .filter(shape.null_safe_change("o", "n", ["v"]))
    )
    assert {r[0] for r in changed.select("o.k").collect()} == {"b", "c"}


def test_ties_do_not_depend_on_the_order_of_rows(frame):
    rows = [("a", 1, 3.0), ("a", 1, 1.0), ("a", 0, 9.0), ("b", None, None), ("b", None, 2.0)]
    for order in (rows, rows[::-1]):
        df = frame("k string, t int, v double", order).repartition(3)
        assert {r.k: r.v for r in shape.dedup_latest(df, ["k"], ["t"]).collect()} == {"a": 3.0, "b": 2.0}
        assert {r.k: r.v for r in shape.dedup_first(df, ["k"], ["t"]).collect()} == {"a": 9.0, "b": 2.0}


def test_upsert_keeps_the_grain(frame):
    target = frame("k string, t int, v int", [("a", 0, 1), (None, 0, 2), ("c", 0, 3)])
    changes = frame("k string, t int, v int", [("a", 1, 4), ("a", 2, 5), (None, 1, 6), ("d", 1, 7)])
    out = {r.k: r.v for r in shape.upsert(target, changes, ["k"], ["t"]).collect()}
    assert out == {"a": 5, None: 6, "c": 3, "d": 7}
    assert shape.upsert(target, changes, ["k"], ["t"]).count() == 4
