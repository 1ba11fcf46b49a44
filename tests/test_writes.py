import random

import pytest
from pyspark.sql import functions as F

from revlake.operators import compact, txn, validate, visibility
from revlake.operators.compact import Policy, Segment, Task
from revlake.plans.schema import COMMANDS, LOG

from .test_reads import log


def kept(df):
    return sorted((bytes(r.key).decode(), r.revision) for r in df.collect())


def test_classes_of_incoming_entries(spark):
    current = visibility.latest_entries(log(spark, ("a", 10, "x"), ("b", 11, None)))
    new = log(spark, ("a", 11, "y"), ("a", 10, "x"), ("a", 10, "z"), ("a", 9, "x"), ("b", 10, "x"), ("b", 11, None), ("c", 1, "x"))
    found = sorted((bytes(r.key).decode(), r.revision, r.cls) for r in validate.classify(new, current).collect())
    assert found == [("a", 9, "stale"), ("a", 10, "conflict"), ("a", 10, "duplicate"), ("a", 11, "apply"), ("b", 10, "stale"), ("b", 11, "duplicate"), ("c", 1, "apply")]


def test_duplicate_keys_of_a_batch(spark):
    batch = log(spark, ("a", 1, "x"), ("a", 1, "y"), ("b", 1, "z"))
    assert [(bytes(r.key), r.n) for r in validate.duplicates(batch).collect()] == [(b"a", 2)]


def test_retention(spark):
    one = log(spark, ("k", 5, "5"), ("k", 3, "3"), ("k", 1, "1"))
    assert kept(compact.retain(one)) == [("k", 5)]
    assert kept(compact.retain(one, 4)) == [("k", 3), ("k", 5)]
    gone = log(spark, ("k", 5, None), ("k", 3, "3"))
    assert kept(compact.retain(gone, None, True)) == []
    assert kept(compact.retain(gone, None, False)) == [("k", 5)]
    assert kept(compact.retain(gone, 4, True)) == [("k", 3), ("k", 5)]
    assert kept(compact.retain(log(spark, ("k", 5, "5"), ("k", 3, None)), 4, True)) == [("k", 3), ("k", 5)]


def test_retention_keeps_every_open_view(spark):
    rng = random.Random(67890)
    entries = [(chr(97 + rng.randrange(8)), r, None if rng.random() < 0.3 else str(r)) for r in range(1, 200)]
    data = log(spark, *entries)
    for snapshot in (50, 120, 199):
        small = compact.retain(data, snapshot, True).checkpoint()
        for at in (snapshot, (snapshot + 199) // 2, None):
            seen = lambda d: sorted((bytes(r.key), bytes(r.value), r.revision) for r in visibility.visible(d, at).collect())
            assert seen(small) == seen(data)


def segment(path, level, low, high, size=100, order=0):
    return Segment(path, level, 1, size, low.encode(), high.encode(), 1, 1, "", order)


def test_planner():
    policy = Policy(level0_segments=2, base_size=100, growth=10, levels=4, target_size=100)
    assert compact.plan([segment("a", 0, "a", "b")], policy) == []
    l0 = [segment(f"s{i}", 0, "a", "c", order=i) for i in range(3)]
    near, far = segment("n", 1, "b", "d", 50), segment("f", 1, "x", "z", 20)
    first = compact.plan([*l0, near, far], policy)[0]
    assert first.level == 1 and {s.path for s in first.inputs} == {"s0", "s1", "n"} and not first.drop_deletions
    full = [segment("p", 1, "a", "b", 90), segment("q", 1, "c", "d", 90), segment("under", 2, "a", "a", 10)]
    (task,) = compact.plan(full, policy)
    assert [s.path for s in task.inputs] == ["q"] and task.level == 2
    last = [segment("p", 2, "a", "b", 900), segment("q", 2, "c", "d", 900)]
    assert compact.plan(last, policy, {2: b"a"})[0].inputs[0].path == "q" and compact.plan(last, policy)[0].drop_deletions
    assert compact.output_files(Task((segment("b", 1, "a", "b", 250),), 2, 1.0, False), policy) == 3
    small = [Segment(f"s{i}", 0, 400_000, 1000, b"a", b"z", 1, 1) for i in range(4)]
    assert compact.output_files(Task(tuple(small), 2, 1.0, False)) == 4  # few bytes, but more rows than one task should sort


def commands(spark, *items):
    rows = []
    for revision, conditions, operations in items:
        rows.append((revision, [(c.kind, c.key, c.value, c.revision) for c in conditions], [(o.key, o.value is None, o.value) for o in operations]))
    return spark.createDataFrame(rows, COMMANDS)


C, O = txn.Condition, txn.Operation


def outcomes(df):
    return dict(sorted((r.revision, r.applied) for r in df.collect()))


def test_conditions_on_one_view(spark):
    view = visibility.visible(log(spark, ("a", 3, "x"), ("b", 2, "y"), ("c", 4, None)))
    cases = [([C.exists("a")], True), ([C.exists("c")], False), ([C.missing("c"), C.missing("z")], True), ([C.value_equals("a", "x"), C.revision_equals("b", 2)], True)]
    cases += [([C.value_equals("a", "x"), C.revision_equals("b", 3)], False), ([C.value_equals("z", "x")], False), ([C.revision_equals("c", 4)], False), ([], True)]
    asked = spark.createDataFrame([(i, [(c.kind, c.key, c.value, c.revision) for c in cs]) for i, (cs, _) in enumerate(cases)], "id int, conditions array<struct<kind:string,key:binary,value:binary,revision:bigint>>")
    assert {r.id: r.holds for r in txn.evaluate(asked, view).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_multi_key_fold(spark):
    items = [
        (5, [C.exists("guard"), C.value_equals("guard", "expected"), C.revision_equals("guard", 2), C.missing("key")], [O.put("key", "1"), O.delete("guard")]),
        (6, [C.exists("guard")], [O.put("key", "2")]),
        (7, [C.value_equals("key", "1")], [O.put("other", "3")]),
        (9, [], [O.put("far", "x")]),
        (10, [C.revision_equals("far", 9)], [O.delete("far")]),
        (11, [C.exists("far")], [O.put("far", "y")]),
    ]
    start = visibility.visible(log(spark, ("guard", 2, "expected"), ("unused", 1, "x")))
    done = txn.fold(commands(spark, *items), start)
    assert outcomes(done) == {5: True, 6: False, 7: True, 9: True, 10: True, 11: False}
    left = visibility.visible(log(spark, ("guard", 2, "expected")).unionByName(txn.entries(commands(spark, *items), done)))
    assert sorted((bytes(r.key), bytes(r.value), r.revision) for r in left.collect()) == [(b"key", b"1", 5), (b"other", b"3", 7)]


def test_fold_with_null_conditions_and_operations(spark):
    rows = [(1, None, [("a", False, "x")]), (2, [("exists", "a", None, None)], [("b", False, "y")]), (3, None, None), (4, [("missing", "b", None, None)], [("c", False, "z")])]
    data = "revision bigint, conditions array<struct<kind:string,key:binary,value:binary,revision:bigint>>, operations array<struct<key:binary,deleted:boolean,value:binary>>"
    rows = [(r, c and [(k, key.encode(), v, n) for k, key, v, n in c], o and [(key.encode(), d, v.encode()) for key, d, v in o]) for r, c, o in rows]
    assert {r.revision: r.applied for r in txn.fold(spark.createDataFrame(rows, data)).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_single_key_fold_matches_a_serial_run(spark):
    rng, items, state, want = random.Random(5), [], {}, {}
    for revision in range(1, 120):
        key = f"k{rng.randrange(5)}"
        condition = rng.choice([C.exists(key), C.missing(key), C.value_equals(key, "1"), None])
        value = rng.choice([None, "1", "2"])
        items.append((revision, [condition] if condition else [], [O.put(key, value) if value else O.delete(key)]))
        now = state.get(key)
        want[revision] = condition is None or {"exists": now is not None, "missing": now is None, "value_equals": now == "1"}[condition.kind]
        if want[revision]:
            state.pop(key, None) if value is None else state.__setitem__(key, value)
    frame = commands(spark, *items)
    assert outcomes(txn.fold(frame, single_key=True)) == outcomes(txn.fold(frame)) == want


def test_replay_skips_what_was_applied(spark):
    items = [(i, [], [O.put("a", str(i))]) for i in (1, 2, 3)]
    first = log(spark, ("a", 1, "1"), ("a", 2, "2"))
    again = txn.replay(first, commands(spark, *items), 2)
    assert kept(again) == [("a", 1), ("a", 2), ("a", 3)]


def test_bad_batches():
    for bad in (lambda: txn.check_operations([]), lambda: txn.check_operations([O.put("a", "1"), O.delete("a")]), lambda: txn.Transaction([]), lambda: C.revision_equals("a", 0), lambda: O.put("a", None)):
        with pytest.raises(ValueError):
            bad()


def test_log_schema_is_fixed(spark):
    assert LOG.fieldNames() == ["key", "revision", "deleted", "value"]
    assert log(spark, ("a", 1, None)).where(F.col("value").isNull() & F.col("deleted")).count() == 1
