from marketlake.operators.scd2 import scd2_merge
from tests.conftest import plan_of

SCHEMA = "id string, name string, grp string"
T1, T2, T3 = "2025-01-01 00:00:00", "2025-02-01 00:00:00", "2025-03-01 00:00:00"


def merge(history, incoming, ts, tracked=("name", "grp")):
    return scd2_merge(history, incoming, "id", list(tracked), ts, "id_key")


def state(df):
    return {
        (r.id, r.name, r.grp, str(r.valid_from_ts), str(r.valid_to_ts), r.is_current)
        for r in df.collect()
    }


def test_first_load(frame):
    dim = merge(None, frame(SCHEMA, [("a", "A", "g")]), T1)
    assert state(dim) == {("a", "A", "g", T1, "None", True)}
    assert dim.first().id_key is not None


def test_no_change_adds_nothing(frame):
    load = frame(SCHEMA, [("a", "A", None), ("b", "B", "g")])
    dim = merge(None, load, T1)
    assert sorted(merge(dim, load, T2).collect()) == sorted(dim.collect())


def test_change_new_and_absent_keys(frame):
    dim = merge(None, frame(SCHEMA, [("a", "A", "g"), ("b", "B", "g")]), T1)
    dim = merge(dim, frame(SCHEMA, [("a", "A2", "g"), ("c", "C", "g")]), T2)
    assert state(dim) == {
        ("a", "A", "g", T1, T2, False),
        ("a", "A2", "g", T2, "None", True),
        ("b", "B", "g", T1, "None", True),
        ("c", "C", "g", T2, "None", True),
    }
    assert dim.select("id_key").distinct().count() == dim.count()


def test_null_counts_as_a_value(frame):
    dim = merge(None, frame(SCHEMA, [("a", "A", None)]), T1)
    dim = merge(dim, frame(SCHEMA, [("a", "A", "g")]), T2)
    assert dim.filter("is_current").first().grp == "g" and dim.count() == 2


def test_closed_versions_stay_closed(frame):
    dim = merge(None, frame(SCHEMA, [("a", "A", "g")]), T1)
    dim = merge(dim, frame(SCHEMA, [("a", "B", "g")]), T2)
    dim = merge(dim, frame(SCHEMA, [("a", "A", "g")]), T3)
    assert state(dim) == {
        ("a", "A", "g", T1, T2, False),
        ("a", "B", "g", T2, T3, False),
        ("a", "A", "g", T3, "None", True),
    }


def test_new_tracked_column_versions_old_rows_again(frame):
    dim = merge(None, frame(SCHEMA, [("a", "A", "g")]), T1, ["name"])
    dim = merge(dim, frame(SCHEMA, [("a", "A", "g")]), T2)
    assert dim.count() == 2
    assert dim.filter("is_current").first().grp == "g"


def test_repeated_and_missing_keys_in_a_load(frame):
    dim = merge(None, frame(SCHEMA, [("a", "A", "g"), ("a", "A", "g"), (None, "N", "g")]), T1)
    assert state(dim) == {("a", "A", "g", T1, "None", True)} and dim.count() == 1
    dim = merge(dim, frame(SCHEMA, [("a", "B", "g"), ("a", "C", "g"), ("b", "B", "g")]), T2)
    assert dim.count() == 3
    assert state(dim.filter("id = 'a'")) == {("a", "A", "g", T1, T2, False), ("a", "C", "g", T2, "None", True)}


def test_one_join(frame):
    history = merge(None, frame(SCHEMA, [("a", "A", "g")]), T1)
    plan = plan_of(merge(history, frame(SCHEMA, [("a", "B", "g")]), T2))
    assert plan.count("Join ") == 1
