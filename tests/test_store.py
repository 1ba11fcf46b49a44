import random

import pytest
from pyspark.sql import functions as F

from revlake.__main__ import main
from revlake.errors import CorruptionError, InvalidRevisionError, RevisionExpiredError, StoreClosedError, StoreLockedError
from revlake.operators.compact import Policy
from revlake.operators.ranges import KeyRange
from revlake.operators.txn import Condition, Operation, Transaction
from revlake.plans.schema import LOG
from revlake.sources.files import Files
from revlake.sources.store import LOCAL, Store
from revlake.streaming.ingest import ingest

from .test_reads import log


def content(df):
    return {bytes(r.key).decode(): (bytes(r.value).decode(), r.revision) for r in df.collect()}


def test_put_get_delete_scan_and_reopen(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root) as s:
        assert s.put("a", "1") == 1 and s.put("b", "") == 2 and s.delete("zz") == 3
        assert s.write([Operation.put("c", "x"), Operation.delete("a")]) == 4
        assert s.get("a") is None and s.get("b") == (b"", 2) and s.get("c") == (b"x", 4)
        with pytest.raises(StoreLockedError):
            Store.open(spark, root)
        with s.read_view(2) as view:
            assert view.get("a") == (b"1", 1)
    with Store.open(spark, root, write=False) as s:
        assert content(s.scan()) == {"b": ("", 2), "c": ("x", 4)}
        assert [bytes(r.key) for r in s.scan("a", "c").collect()] == [b"b"] and s.scan(limit=1).count() == 1
        assert s.metadata().first().applied_through == 4
        with pytest.raises(StoreLockedError):
            s.put("x", "y")
    with pytest.raises(StoreClosedError):
        s.get("b")


def test_batches_are_all_or_nothing_and_idempotent(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.apply(log(spark, ("a", 10, "x"), ("b", 5, "y")))
        assert s.apply(log(spark, ("a", 10, "x"))) == {"duplicate": 1}
        for bad in [("a", 9, "x"), ("a", 10, "z")]:
            with pytest.raises(InvalidRevisionError):
                s.apply(log(spark, ("new", 11, "n"), bad))
        assert s.get("new") is None
        s.apply(log(spark, ("c", 7, "low")))  # revisions are judged per key
        assert s.manifest.applied_through == 10
        s.apply(log(spark, ("a", 11, None)))
        with pytest.raises(InvalidRevisionError):
            s.apply(log(spark, ("a", 10, "x")))
        with pytest.raises(ValueError):
            s.apply(log(spark, ("d", 20, "1"), ("d", 20, "2")))
        assert s.apply(spark.createDataFrame([], LOG)) == {}


def test_transactions(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        first = s.put("guard", "expected")
        ok = s.transact(Transaction([Operation.put("key", "v"), Operation.delete("guard")], [Condition.exists("guard"), Condition.value_equals("guard", "expected"), Condition.revision_equals("guard", first), Condition.missing("key")]))
        assert ok.applied and ok.revision == 2
        failed = s.transact(Transaction([Operation.put("key", "w")], [Condition.exists("guard")]))
        assert not failed.applied and failed.revision is None
        assert (s.manifest.applied_index, s.manifest.applied_through) == (3, 2)
        assert s.put("next", "x") == 4 and s.get("key") == (b"v", 2)


def test_views_survive_compaction_and_vacuum(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        for i in range(1, 4):
            s.apply(log(spark, ("a", i, str(i)), ("b", i, None if i == 3 else "x")))
        view = s.read_view(2)
        s.compact()
        s.vacuum()
        assert content(view.scan()) == {"a": ("2", 2), "b": ("x", 2)}
        view.close()
        s.compact()
        assert s.vacuum() > 0
        assert content(s.scan()) == {"a": ("3", 3)} and s.stats().first().entries == 1
        assert s.event_log().count() == 2
        with pytest.raises(StoreClosedError):
            view.get("a")


def two_versions(spark, s):
    for i in (1, 2, 3):
        s.apply(log(spark, ("a", i, str(i)), (f"k{i}", i, "x")))


def test_views_of_readers_elsewhere_are_protected(spark, tmp_path):
    """A reader's lease holds back the writer, which knows nothing else of it; without one, or after it, files go."""
    root = str(tmp_path / "s")
    with Store.open(spark, root) as s, Store.open(spark, root, write=False) as reader:
        two_versions(spark, s)
        view = reader.read_view(2)
        s.compact()
        s.vacuum()
        assert view.get("a") == (b"2", 2) and content(view.scan()) == {"a": ("2", 2), "k1": ("x", 1), "k2": ("x", 2)}
        with s.read_view(2) as own:  # compaction kept what the lease needs
            assert own.get("a") == (b"2", 2)
        view.renew()
        view.close()
        s.compact()
        assert s.vacuum() > 0 and not list((tmp_path / "s/_manifest").glob("lease-*"))
        short = Store.open(spark, root, write=False, lease_seconds=0.0)
        lost = short.read_view()
        s.put("z", "1")
        s.compact()
        s.vacuum()
        with pytest.raises(StoreClosedError):
            lost.get("a")


def test_frames_outlive_compaction_until_released(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        two_versions(spark, s)
        frame = s.scan()
        s.put("a", "new")
        s.compact()
        s.vacuum()
        assert content(frame)["a"] == ("3", 3) and content(s.scan())["a"] == ("new", 4)
        assert all(seg.rows < 6 for seg in s.manifest.segments)  # a frame needs its files, not old versions in new ones
        s.release()
        assert s.vacuum() > 0


def test_views_below_the_retained_revisions_are_refused(spark, tmp_path):
    root, copy = str(tmp_path / "s"), str(tmp_path / "c")
    with Store.open(spark, root) as s:
        two_versions(spark, s)
        with s.read_view(1) as view:
            assert view.get("a") == (b"1", 1)
        s.compact()
        for at in (0, 1, 2):
            with pytest.raises(RevisionExpiredError):
                s.read_view(at)
        with s.read_view(3) as view:
            assert view.get("a") == (b"3", 3)
        s.checkpoint(copy)
    with Store.from_checkpoint(spark, copy, str(tmp_path / "t")) as t, pytest.raises(RevisionExpiredError):
        t.read_view(2)


def test_backup_takes_the_newest_state(spark, tmp_path):
    root = str(tmp_path / "s")
    with Store.open(spark, root) as s, Store.open(spark, root, write=False) as stale:
        s.put("a", "1")
        assert stale.manifest.applied_index == 0
        stale.backup(str(tmp_path / "b"))
    with Store.restore_backup(spark, str(tmp_path / "b"), str(tmp_path / "t")) as t:
        assert content(t.scan()) == {"a": ("1", 1)}


def test_files_that_no_manifest_names(spark, tmp_path):
    """Unknown files are corruption; what a writer that died left under an intent is deleted."""
    root = tmp_path / "s"
    with Store.open(spark, str(root)) as s:
        s.put("a", "1")
        s.compact()  # the first segment is of an older manifest only
    (root / "data-left").mkdir()
    (root / "data-left/part-0.parquet").write_bytes(b"x")
    (root / "_manifest/intent-data-left").write_bytes(b"")
    with Store.open(spark, str(root), write=False) as s:
        assert content(s.scan()) == {"a": ("1", 1)} and (root / "data-left").exists()
    with Store.open(spark, str(root)) as s:
        assert not (root / "data-left").exists() and not (root / "_manifest/intent-data-left").exists()
    (root / "data-strange").mkdir()
    (root / "data-strange/part-0.parquet").write_bytes(b"x")
    with pytest.raises(CorruptionError):
        Store.open(spark, str(root))


def test_keys_read_only_the_files_they_can_be_in(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        for i, keys in enumerate(("ab", "cd", "ef", "gh"), 1):
            s.apply(log(spark, *((k, i, k) for k in keys)))
        with s.read_view() as view:
            literal, frame = view.multi_get(["c", "zz"]), view.multi_get(spark.createDataFrame([(b"e",), (b"f",)], "key binary"))
            assert len(literal.inputFiles()) == 1 == len(frame.inputFiles()) and "In(key" in literal._jdf.queryExecution().executedPlan().toString()
            assert {bytes(r.key): r.found for r in literal.collect()} == {b"c": True, b"zz": False} and frame.where("found").count() == 2
            assert view.multi_get([]).count() == 0 == view.multi_get(spark.createDataFrame([], "key binary")).count()


def test_checkpoints_are_copies_or_written_anew(spark, tmp_path, monkeypatch):
    """Copied files keep size, rows and fingerprint; without a file system on executors the entries are the same."""
    for how in ("copied", "anew"):
        if how == "anew":
            monkeypatch.setattr(Files, "portable", lambda self, path: None)
        with Store.open(spark, str(tmp_path / how)) as s:
            two_versions(spark, s)
            copy = s.checkpoint(str(tmp_path / f"{how}-copy"))
            facts = lambda m: sorted((x.level, x.size, x.rows, x.fingerprint) for x in m.segments)
            said = Store.read_checkpoint(spark, copy)
            assert (facts(said) == facts(s.manifest)) == (how == "copied")
            with Store.from_checkpoint(spark, copy, str(tmp_path / f"{how}-new")) as t:
                assert content(t.scan()) == content(s.scan()) and sum(x.rows for x in t.manifest.segments) == 6
                assert (facts(t.manifest) == facts(said)) or how == "anew"
                t.put("b", "x")
            with Store.open(spark, str(tmp_path / f"{how}-new")) as t:
                assert content(t.scan())["b"] == ("x", 4)


def test_counters(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        two_versions(spark, s)
        with pytest.raises(InvalidRevisionError):
            s.apply(log(spark, ("a", 1, "other")))
        s.checkpoint(str(tmp_path / "c"))
        s.restore(str(tmp_path / "c"))
        s.compact()
        r = s.stats().first()
        assert (r.proposals, r.failed_proposals, r.commits, r.rejected, r.checkpoints, r.restores, r.compactions, r.failed_compactions, r.active_compactions) == (4, 1, 3, 1, 1, 1, 1, 0, 0)
        assert r.last_restore_ms == r.restore_ms > 0 and [e.event for e in s.event_log().collect()] == ["checkpoint", "restore", "compaction"]


def test_due_compactions(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s"), Policy(level0_segments=2, base_size=1, levels=3)) as s:
        for i in range(1, 5):
            s.put(f"k{i % 2}", str(i))
        assert s.compact_due() > 0
        assert {seg.level for seg in s.manifest.segments} == {2}
        assert content(s.scan()) == {"k0": ("4", 4), "k1": ("3", 3)}


def test_checkpoint_restore_rewinds(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.apply(log(spark, ("a", 1, "1"), ("b", 2, "2")))
        copy = s.checkpoint(str(tmp_path / "c"))
        s.apply(log(spark, ("a", 5, None), ("c", 6, "3")))
        s.restore(copy)
        assert content(s.scan()) == {"a": ("1", 1), "b": ("2", 2)} and s.manifest.applied_through == 2
        s.apply(log(spark, ("a", 3, "again")))
        assert s.get("a") == (b"again", 3)
    with Store.from_checkpoint(spark, copy, str(tmp_path / "n")) as n:
        assert content(n.scan()) == {"a": ("1", 1), "b": ("2", 2)}
    with pytest.raises(ValueError):
        Store.from_checkpoint(spark, copy, str(tmp_path / "n"))


def test_corruption(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.apply(log(spark, ("a", 1, "1"), ("b", 2, "2")))
        copy = s.checkpoint(str(tmp_path / "c"))
        (part,) = (tmp_path / "c" / "level-0").glob("part-*.parquet")
        data = bytearray(part.read_bytes())
        data[10] ^= 0xFF
        part.write_bytes(bytes(data))
        for crc in (tmp_path / "c" / "level-0").glob(".*.crc"):
            crc.unlink()
        with pytest.raises(CorruptionError):
            s.restore(copy)
        assert content(s.scan()) == {"a": ("1", 1), "b": ("2", 2)}
        with pytest.raises(CorruptionError):
            s.restore(str(tmp_path / "nothing"))
    (part,) = (tmp_path / "s").glob("data-*/part-*.parquet")
    part.unlink()
    with pytest.raises(CorruptionError):
        Store.open(spark, str(tmp_path / "s"))
    (manifest,) = sorted((tmp_path / "s" / "_manifest").glob("v*"))[-1:]
    manifest.write_text(manifest.read_text()[:30])
    with pytest.raises(CorruptionError):
        Store.open(spark, str(tmp_path / "s"))


def test_cursor_is_read_once(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        s.apply(log(spark, ("a", 1, "1"), ("b", 2, "2")))
        with s.read_view(None, LOCAL) as view, view.cursor(KeyRange.at_least("a")) as cursor:
            assert [bytes(r.key) for r in cursor] == [b"a", b"b"]
            with pytest.raises(StoreClosedError):
                list(cursor)


def test_random_operations_against_a_dict(spark, tmp_path):
    rng, model, copies, root = random.Random(12345), {}, [], str(tmp_path / "s")
    s = Store.open(spark, root, Policy(level0_segments=3, base_size=2000, levels=3))
    for step in range(30):
        act = rng.random()
        key = bytes([rng.randrange(24)])
        if act < 0.45:
            value = bytes([step, key[0], step ^ key[0]])
            model[key] = (value, s.put(key, value))
        elif act < 0.65:
            s.delete(key)
            model.pop(key, None)
        elif act < 0.75:
            assert s.get(key) == model.get(key)
        elif act < 0.82:
            s.compact_due()
        elif act < 0.88:
            s.close()
            s = Store.open(spark, root, s.policy)
        elif act < 0.95 or not copies:
            copies.append((s.checkpoint(str(tmp_path / f"c{step}")), dict(model)))
        else:
            path, model = copies[-1]
            model = dict(model)
            s.restore(path)
    assert {bytes(r.key): (bytes(r.value), r.revision) for r in s.scan().collect()} == model
    s.close()


def test_streaming_ingestion_commits_each_batch_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        log(spark, (f"k{i}", i + 1, str(i))).coalesce(1).write.mode("append").parquet(source)
    with Store.open(spark, str(tmp_path / "s")) as s:
        stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(source)
        for _ in range(2):
            ingest(stream, s, "in", str(tmp_path / "cp")).awaitTermination()
        assert content(s.scan()) == {"k0": ("0", 1), "k1": ("1", 2), "k2": ("2", 3)}
        assert s.manifest.batches["in"] >= 1


def test_replay_stores_outcomes(spark, tmp_path):
    from .test_writes import C, O, commands

    with Store.open(spark, str(tmp_path / "s")) as s:
        items = commands(spark, (1, [], [O.put("a", "1")]), (2, [C.missing("a")], [O.put("a", "2")]), (3, [C.exists("a")], [O.put("b", "3")]))
        assert {r.revision: r.applied for r in s.replay(items).collect()} == {1: True, 2: False, 3: True}
        assert s.replay(items).count() == 0 and s.manifest.applied_index == 3
        assert content(s.scan()) == {"a": ("1", 1), "b": ("3", 3)}


def test_command_line(spark, tmp_path, capsys):
    root = str(tmp_path / "s")
    assert main([root, "kv", "put", "a", "1", "--json"], spark) == 0
    assert main([root, "kv", "get", "a"], spark) == 0 and main([root, "kv", "get", "b"], spark) == 1
    assert main([root, "cluster", "status"], spark) == 0 and main(["?"], spark) == 2
    assert "revision: 1" in capsys.readouterr().out


def test_large_write_frames(spark, tmp_path):
    with Store.open(spark, str(tmp_path / "s")) as s:
        rows = spark.range(2000).select(F.format_string("%05d", "id").cast("binary").alias("key"), F.lit(False).alias("deleted"), F.lit(b"x").alias("value"))
        assert s.write_frame(rows) == 1 and s.scan("00010", "00020").count() == 10
        with pytest.raises(ValueError):
            s.write_frame(rows.union(rows))


def test_no_task_writes_more_rows_than_the_target(spark, tmp_path):
    """Commits, compactions and restores deal their rows out by number, and the statistics of a commit's files are those of the commit."""
    log = spark.range(4000).selectExpr("CAST(lpad(id % 1000, 5, '0') AS BINARY) AS key", "id + 1 AS revision", "false AS deleted", "CAST(CAST(id AS STRING) AS BINARY) AS value")
    with Store.open(spark, str(tmp_path / "s"), Policy(target_rows=500)) as store:
        store.apply(log.where("revision <= 2000"))
        store.checkpoint(str(tmp_path / "c"))
        store.apply(log.where("revision > 2000"))
        rows = store.segments().collect()
        assert len(rows) > 6 and max(r["rows"] for r in rows) <= 1000
        assert {c: sum(r["rows"] for r in rows if r.commit == c) for c in {r.commit for r in rows}} == {0: 2000, 1: 2000}
        with store.read_view(2000) as view:
            store.compact()
            assert len(store.manifest.segments) > 6 and max(s.rows for s in store.manifest.segments) <= 1000
            assert view.scan().count() == 1000
        assert sorted((bytes(r.key), r.revision) for r in store.scan().collect()) == [(f"{k:05d}".encode(), 3001 + k) for k in range(1000)]
        store.restore(str(tmp_path / "c"))
        assert len(store.manifest.segments) > 2 and store.scan().count() == 1000
