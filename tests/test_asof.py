import random
from collections import Counter

import pytest

from marketlake.operators.asof import asof_join, depth_bounds

LEFT = "id int, k string, ts timestamp"
RIGHT = "k string, rt timestamp, made timestamp, v int"


def join(left, right, **kw):
    return asof_join(left, right, "k", "ts", "rt", "made", ["v"], **kw)


def test_latest_at_or_before_with_ties(frame):
    left = frame(
        LEFT,
        [
            (1, "a", "2025-01-02 10:00:00"),
            (2, "a", "2025-01-01 09:00:00"),
            (3, "b", "2025-06-01 00:00:00"),
            (4, None, "2025-06-01 00:00:00"),
            (5, "a", None),
        ],
    )
    right = frame(
        RIGHT,
        [
            ("a", "2025-01-02 10:00:00", "2025-01-03 00:00:00", 10),
            ("a", "2025-01-02 10:00:00", "2025-01-04 00:00:00", 11),
            ("a", "2025-01-02 10:00:01", "2025-01-03 00:00:00", 12),
            ("b", "2025-01-01 00:00:00", "2025-01-01 00:00:00", 20),
        ],
    )
    got = {r.id: r.v for r in join(left, right, slice_seconds=3600).collect()}
    assert got == {1: 11, 2: None, 3: 20, 4: None, 5: None}


def test_max_age(frame):
    left = frame(LEFT, [(1, "a", "2025-01-02 00:00:00"), (2, "a", "2025-01-05 00:00:00")])
    right = frame(RIGHT, [("a", "2025-01-01 00:00:00", "2025-01-01 00:00:00", 1)])
    got = {r.id: r.v for r in join(left, right, max_age_seconds=86400).collect()}
    assert got == {1: 1, 2: None}


@pytest.mark.parametrize("slice_seconds", [600, 7200, 10**9])
def test_matches_brute_force_with_a_hot_key(frame, slice_seconds):
    rng = random.Random(3)

    def stamp():
        return f"2025-01-01 {rng.randrange(24):02d}:{rng.randrange(60):02d}:00"

    def key():
        return "hot" if rng.random() < 0.7 else rng.choice("xyz")

    left = [(i, key(), stamp()) for i in range(150)]
    right = [(key(), stamp(), f"2025-01-02 00:00:{rng.randrange(60):02d}", i) for i in range(150)]
    want = {}
    for i, k, ts in left:
        best = max(((r[1], r[2], r[3]) for r in right if r[0] == k and r[1] <= ts), default=None)
        want[i] = best[2] if best else None
    df = join(frame(LEFT, left), frame(RIGHT, right), slice_seconds=slice_seconds)
    assert {r.id: r.v for r in df.collect()} == want


def test_missing_keys_match_nothing(frame):
    left = frame(LEFT, [(1, None, "2025-01-02 00:00:00"), (2, "a", "2025-01-02 00:00:00"), (3, None, None)])
    right = frame(RIGHT, [(None, "2025-01-01 00:00:00", "2025-01-01 00:00:00", 7)])
    assert {r.id: r.v for r in join(left, right).collect()} == {1: None, 2: None, 3: None}


def hot_rows(n=4000, seed=9):
    """Half of all rows have one key, most of them within one day."""
    rng = random.Random(seed)

    def stamp():
        day = 5 if rng.random() < 0.8 else rng.randrange(1, 28)
        return f"2025-01-{day:02d} {rng.randrange(24):02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"

    def key(i):
        return "hot" if i % 2 else f"k{rng.randrange(40)}"

    left = [(i, key(i), stamp()) for i in range(n)]
    right = [(key(i), stamp(), "2025-02-01 00:00:00", i) for i in range(n)]
    return left, right


def test_slices_of_equal_depth_give_the_same_rows(frame):
    left, right = hot_rows()
    left += [(-1, None, "2025-01-05 00:00:00"), (-2, "hot", None)]
    left, right = frame(LEFT, left), frame(RIGHT, right)
    bounds = depth_bounds(left, right, "k", "ts", "rt", cell_seconds=60, parts=32)
    assert [r.k for r in bounds.select("k").collect()] == ["hot"]
    even = join(left, right, slice_seconds=60, bounds=bounds)
    plain = join(left, right)
    assert sorted(map(tuple, even.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_slices_of_equal_depth_spread_a_hot_key(frame):
    left, right = (frame(schema, rows) for schema, rows in zip((LEFT, RIGHT), hot_rows(), strict=True))
    parts = 32
    (row,) = depth_bounds(left, right, "k", "ts", "rt", cell_seconds=60, parts=parts).collect()
    cells = [int(r.s) // 60 for r in left.filter("k = 'hot'").selectExpr("unix_timestamp(ts) s").collect()]
    cells += [int(r.s) // 60 for r in right.filter("k = 'hot'").selectExpr("unix_timestamp(rt) s").collect()]
    sizes = Counter(sum(b <= c for b in row["_bounds"]) for c in cells)
    assert len(sizes) == len(row["_bounds"]) + 1 < parts
    share = 8000 / parts
    assert max(sizes.values()) <= 1.2 * share


def test_each_side_is_planned_once_for_rows_and_once_for_summaries(spark, tmp_path):
    for name, n in (("l", 10), ("r", 20)):
        rows = spark.range(n).selectExpr("cast(id as string) k", "timestamp_seconds(id) t", "id m", "id v")
        rows.write.parquet(f"{tmp_path}/{name}")
    left, right = (spark.read.parquet(f"{tmp_path}/{name}") for name in "lr")
    right = right.withColumnRenamed("t", "rt").withColumnRenamed("m", "made")
    df = asof_join(left.withColumnRenamed("v", "w"), right, "k", "t", "rt", "made", ["v"])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [k#") == 4
