"""Registered queries of the key-value engine, one for each operator over the test tables' logs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revlake.errors import InvalidRevisionError
from revlake.functions.keys import utf8
from revlake.operators import compact, txn, validate, visibility
from revlake.operators.compact import Policy
from revlake.operators.ranges import KeyRange
from revlake.plans.logs import events_log, orders_log, shown, table, top_revision
from revlake.plans.schema import CONDITION, OPERATIONS
from revlake.session import reach, shared_dir
from revlake.sources.store import Store

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def scan_all(spark, sf):
    return shown(visibility.scan(events_log(spark, sf)))


def _scan(name: str, keys: KeyRange, log=events_log, limit: int = 0):
    QUERIES[name] = lambda spark, sf: shown(visibility.scan(log(spark, sf), keys, None, limit))


query(scan_all)
_scan("scan_from", KeyRange.at_least("user/00000050"))
_scan("scan_until", KeyRange.until("user/00000050"))
_scan("scan_between", KeyRange.between("user/00000010", "user/00000020"))
_scan("scan_empty_range", KeyRange.between("user/00000010", "user/00000010"))
_scan("scan_prefix", KeyRange.prefix("cust/000000"), orders_log)
_scan("scan_limit", KeyRange(), events_log, 10)
_scan("scan_limit_unbounded", KeyRange(), events_log, 0)


@query
def get_point(spark: SparkSession, sf: str) -> DataFrame:
    return shown(visibility.get(events_log(spark, sf), "user/00000007"))


@query
def get_missing(spark: SparkSession, sf: str) -> DataFrame:
    return shown(visibility.get(events_log(spark, sf), "user/99999999"))


@query
def get_tombstoned(spark: SparkSession, sf: str) -> DataFrame:
    """Every key whose latest entry is a deletion is asked for, and found absent."""
    log = events_log(spark, sf)
    return shown(visibility.multi_get(log, visibility.latest_entries(log).where("deleted").select("key")))


@query
def multi_get(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh customer number up to past the last one."""
    wanted = table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("n"))
    return shown(visibility.multi_get(orders_log(spark, sf), wanted.select(utf8(F.concat(F.lit("cust/"), F.lpad(F.col("n").cast("string"), 8, "0"))).alias("key"))))


@query
def latest_entries(spark: SparkSession, sf: str) -> DataFrame:
    return shown(visibility.latest_entries(events_log(spark, sf)))


def _view_at(part: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        events, orders = events_log(spark, sf), orders_log(spark, sf)
        one = visibility.visible(events, top_revision(events) * part // 100)
        return shown(one.unionByName(visibility.visible(orders, top_revision(orders) * part // 100)))

    QUERIES[f"read_view_at_{part}"] = run


for _part in (25, 50, 75):
    _view_at(_part)


@query
def merge_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Four segments of the log, merged and read."""
    log = events_log(spark, sf)
    return shown(visibility.visible(visibility.merge(*(log.where(F.col("revision") % 4 == i) for i in range(4)))))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Ten consecutive events share a revision; the last one of each user counts."""
    rows = events_log(spark, sf).withColumn("batch", F.expr("(revision - 1) div 10 + 1"))
    best = rows.groupBy("key", "batch").agg(F.max_by(F.struct("deleted", "value"), "revision").alias("e"))
    return best.select("key", F.col("batch").alias("revision"), "e.deleted", "e.value")


@query
def apply_batch(spark: SparkSession, sf: str) -> DataFrame:
    """What is visible halfway: every batch entirely or not at all."""
    log = batches(spark, sf)
    return shown(visibility.visible(log, top_revision(log) // 2))


@query
def validate_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return validate.duplicates(table(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query
def validate_classify(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    changed = log.where("revision % 5 = 0").select("key", "revision", F.lit(False).alias("deleted"), F.concat(utf8(F.lit("x")), F.coalesce("value", utf8(F.lit("")))).alias("value"))
    current = visibility.latest_entries(log, top_revision(log) // 2)
    return shown(validate.classify(log.unionByName(changed), current)).select("k", "revision", "cls")


def _condition(kind: str, key: Column, value: Column | None = None, revision: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), (null if value is None else value).cast("binary").alias("value"), (null if revision is None else revision).cast("bigint").alias("revision"))


def _commands(log: DataFrame, conditions: Column) -> DataFrame:
    """One command per entry, with these conditions, on its own key."""
    operation = F.array(F.struct("key", "deleted", "value")).cast(f"array<{OPERATIONS.simpleString()}>")
    return log.select("revision", conditions.cast(f"array<{CONDITION.simpleString()}>").alias("conditions"), operation.alias("operations"))


@query
def txn_missing_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Sign-ups apply only to missing keys, errors delete, other events put."""
    reach(spark)
    log = events_log(spark, sf)
    signup = F.coalesce(F.col("value").startswith(utf8(F.lit("signup|"))), F.lit(False))
    conditions = F.when(signup, F.array(_condition(txn.MISSING, F.col("key")))).otherwise(F.array().cast(f"array<{CONDITION.simpleString()}>"))
    return txn.fold(_commands(log, conditions), single_key=True)


@query
def txn_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases apply only to existing keys, errors delete, other events put."""
    reach(spark)
    log = events_log(spark, sf)
    purchase = F.coalesce(F.col("value").startswith(utf8(F.lit("purchase|"))), F.lit(False))
    conditions = F.when(purchase, F.array(_condition(txn.EXISTS, F.col("key")))).otherwise(F.array().cast(f"array<{CONDITION.simpleString()}>"))
    return txn.fold(_commands(log, conditions), single_key=True)


@query
def txn_value_equals(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer's key starts as 1-URGENT; an order puts its priority only while the value is that."""
    reach(spark)
    log = orders_log(spark, sf)
    priority = table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("revision"), utf8("o_orderpriority").alias("p"))
    log = log.join(priority, "revision").select("key", "revision", F.lit(False).alias("deleted"), F.col("p").alias("value"))
    urgent = utf8(F.lit("1-URGENT"))
    start = log.select("key").distinct().select("key", urgent.alias("value"), F.lit(1).cast("bigint").alias("revision"))
    return txn.fold(_commands(log, F.array(_condition(txn.VALUE_EQUALS, F.col("key"), urgent))), start, single_key=True)


@query
def txn_revision_equals(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry of the second half is judged against the view at the half: does its key still have revision n, that of its entry before?"""
    log = events_log(spark, sf)
    half = top_revision(log) // 2
    before = F.lag("revision").over(visibility.Window.partitionBy("key").orderBy("revision"))
    asked = log.withColumn("before", before).where(F.col("revision") > half).where("before IS NOT NULL")
    asked = asked.select(F.col("revision").alias("id"), F.array(_condition(txn.REVISION_EQUALS, F.col("key"), None, F.col("before"))).alias("conditions"))
    return txn.evaluate(asked, visibility.visible(log, half))


@query
def txn_multi_condition(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of the second half, against the view at the half: the key exists, and the next user's key is missing."""
    log = events_log(spark, sf)
    half = top_revision(log) // 2
    users = table(spark, sf, "events").select((F.col("event_id") + 1).alias("revision"), F.col("user_id") + 1)
    users = users.toDF("revision", "next").select("revision", utf8(F.concat(F.lit("user/"), F.lpad(F.col("next").cast("string"), 8, "0"))).alias("other"))
    asked = log.where(F.col("revision") > half).join(users, "revision")
    asked = asked.select(F.col("revision").alias("id"), F.array(_condition(txn.EXISTS, F.col("key")), _condition(txn.MISSING, F.col("other"))).alias("conditions"))
    return txn.evaluate(asked, visibility.visible(log, half))


@query
def compact_latest(spark: SparkSession, sf: str) -> DataFrame:
    return shown(compact.retain(events_log(spark, sf)))


@query
def compact_gc(spark: SparkSession, sf: str) -> DataFrame:
    return shown(compact.retain(events_log(spark, sf), None, True))


@query
def compact_with_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    return shown(compact.retain(log, top_revision(log) // 2, True))


@query
def compact_preserves_views(spark: SparkSession, sf: str) -> DataFrame:
    """The views at the snapshot and at the end, read from the compacted log."""
    log = orders_log(spark, sf)
    half = top_revision(log) // 2
    kept = compact.retain(log, half, True)
    old = visibility.visible(kept, half).withColumn("at", F.lit("half"))
    return shown(old.unionByName(visibility.visible(kept).withColumn("at", F.lit("end"))))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query
def key_order_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by the bytes of its whole text, then by revision: the hex of the key and its place in the whole order.

    Ranges are sorted by themselves and written once, as another run would cut them elsewhere; a range's
    first place is the number of rows in those before it (one row for each range reaches the driver).
    """
    rows = table(spark, sf, "documents").select(F.encode("text", "UTF-8").alias("key"), (F.col("doc_id") + 1).alias("revision"), F.col("lang").alias("v"))
    ranges = rows.repartitionByRange("key", "revision").sortWithinPartitions("key", "revision")
    path = _folder(spark)
    ranges.select(F.hex("key").alias("k"), "revision", "v", F.monotonically_increasing_id().alias("slot")).write.parquet(path)
    slots = spark.read.parquet(path).withColumn("range", F.shiftright("slot", 33))
    first, at = [], 0
    for r in sorted(slots.groupBy("range").count().collect()):
        first.append((r["range"], at))
        at += r["count"]
    offsets = F.broadcast(spark.createDataFrame(first, "range bigint, first bigint"))
    place = F.col("first") + F.col("slot").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return slots.join(offsets, "range").select("k", "revision", "v", place.alias("place"))


QUERIES["key_order_bytes"] = key_order_whole


@query
def checkpoint_restore(spark: SparkSession, sf: str) -> DataFrame:
    """A store takes half of the log, is checkpointed, takes the rest, and is restored."""
    log, root = orders_log(spark, sf), _folder(spark)
    half = top_revision(log) // 2
    with Store.open(spark, f"{root}/live") as store:
        store.apply(log.where(F.col("revision") <= half))
        store.checkpoint(f"{root}/copy")
        store.apply(log.where(F.col("revision") > half))
        store.restore(f"{root}/copy")
        return shown(store.scan())


@query
def replay_idempotent(spark: SparkSession, sf: str) -> DataFrame:
    """All commands are replayed over a log that has the first half already; those are skipped."""
    reach(spark)
    log = events_log(spark, sf)
    half = top_revision(log) // 2
    commands = _commands(log, F.array().cast(f"array<{CONDITION.simpleString()}>"))
    return shown(visibility.visible(txn.replay(log.where(F.col("revision") <= half), commands, half)))


@query
def metadata_applied_through(spark: SparkSession, sf: str) -> DataFrame:
    with Store.open(spark, _folder(spark)) as store:
        store.apply(events_log(spark, sf))
        return store.metadata().select("applied_index", "applied_through")


@query
def segment_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Four commits by revision, with what the manifest holds of the segments of each."""
    log = events_log(spark, sf)
    part = top_revision(log) // 4 + 1
    with Store.open(spark, _folder(spark)) as store:
        for i in range(4):
            store.apply(log.where(F.expr(f"(revision - 1) div {part} = {i}")))
        rows = store.segments()
    ends = (F.min("low").alias("low"), F.max("high").alias("high"), F.min("min_revision").alias("min_revision"), F.max("max_revision").alias("max_revision"))
    rows = rows.groupBy("commit").agg(F.sum("rows").alias("rows"), *ends)
    return rows.select("rows", F.decode("low", "UTF-8").alias("low"), F.decode("high", "UTF-8").alias("high"), "min_revision", "max_revision")


def _filled(spark: SparkSession, sf: str, log: DataFrame, parts: int = 4) -> Store:
    """A new store that takes the log in several batches by revision."""
    store = Store.open(spark, f"{_folder(spark)}/live", Policy(level0_segments=2, base_size=1, levels=3))
    part = top_revision(log) // parts + 1
    for i in range(parts):
        store.apply(log.where(F.expr(f"(revision - 1) div {part} = {i}")))
    return store


@query
def store_put_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Single writes after the events: an overwrite, a new key, and deletions of an existing and of an unknown key."""
    with _filled(spark, sf, events_log(spark, sf), 1) as store:
        store.put("user/00000007", "set")
        store.put("zz/new", "")
        store.delete("user/00000008")
        store.delete("zz/unknown")
        return shown(store.scan())


@query
def store_write_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Two batches, each of one revision; the second comes as a frame that deletes every customer of segment BUILDING."""
    with _filled(spark, sf, orders_log(spark, sf), 1) as store:
        store.write([txn.Operation.put("cust/00000001", "one"), txn.Operation.put("zz/new", "two"), txn.Operation.delete("cust/00000002")])
        gone = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(utf8(F.concat(F.lit("cust/"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("key"))
        store.write_frame(gone.select("key", F.lit(True).alias("deleted"), F.lit(None).cast("binary").alias("value")))
        return shown(store.scan())


@query
def store_transact(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of transactions with each kind of condition: a failed one uses up its index and has no revision."""
    with _filled(spark, sf, events_log(spark, sf), 1) as store:
        put = lambda key: [txn.Operation.put(key, "x")]
        has, base = txn.Condition, store.manifest.applied_index
        asked = [
            (put("marker/1"), [has.exists("user/00000007")]),
            (put("marker/2"), [has.missing("user/99999999"), has.missing("marker/2")]),
            (put("marker/3"), [has.value_equals("marker/2", "x"), has.revision_equals("marker/2", base + 2)]),
            (put("marker/4"), [has.value_equals("marker/2", "y")]),
            (put("marker/5"), [has.revision_equals("marker/3", base + 2)]),
            ([txn.Operation.delete("marker/2")], []),
            (put("marker/6"), [has.exists("marker/2")]),
        ]
        done = [store.transact(txn.Transaction(*a)) for a in asked]
        return spark.createDataFrame([(i + 1, d.applied, d.revision) for i, d in enumerate(done)], "n int, applied boolean, revision bigint")


@query
def store_transact_state(spark: SparkSession, sf: str) -> DataFrame:
    """What is visible and where the log stands after a transaction that fails and one that applies."""
    with _filled(spark, sf, events_log(spark, sf), 1) as store:
        store.transact(txn.Transaction([txn.Operation.put("zz/a", "x")], [txn.Condition.exists("zz/b")]))
        store.transact(txn.Transaction([txn.Operation.put("zz/a", "y"), txn.Operation.delete("user/00000007")], [txn.Condition.missing("zz/a")]))
        return shown(store.scan()).crossJoin(store.metadata().select("applied_index", "applied_through"))


@query
def store_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A store that has the first half replays all commands: those after it are applied, earlier ones skipped."""
    log = events_log(spark, sf)
    half = top_revision(log) // 2
    with Store.open(spark, f"{_folder(spark)}/live") as store:
        store.apply(log.where(F.col("revision") <= half))
        store.replay(_commands(log, F.lit(None)), single_key=True)
        return shown(store.scan())


@query
def store_view_half(spark: SparkSession, sf: str) -> DataFrame:
    """A view of the store, whose log came in batches that share revisions, at the half."""
    log = batches(spark, sf)
    with _filled(spark, sf, log) as store, store.read_view(top_revision(log) // 2) as view:
        return shown(view.scan())


@query
def store_reader_view(spark: SparkSession, sf: str) -> DataFrame:
    """A reader's view at the half outlives the writer's compaction and vacuum; the end is as before, too."""
    log = orders_log(spark, sf)
    half = top_revision(log) // 2
    with _filled(spark, sf, log) as store, Store.open(spark, store.root, write=False) as reader:
        view = reader.read_view(half)
        store.compact()
        store.vacuum()
        old = shown(view.scan()).withColumn("at", F.lit("half"))
        return old.unionByName(shown(store.scan()).withColumn("at", F.lit("end")))


@query
def store_compact(spark: SparkSession, sf: str) -> DataFrame:
    """The entries that a full compaction without open views leaves in the segments."""
    with _filled(spark, sf, events_log(spark, sf)) as store:
        store.compact()
        with store.read_view() as view:
            return shown(view.log())


@query
def store_compact_due(spark: SparkSession, sf: str) -> DataFrame:
    """Planned compactions until none is due leave the visible entries as they were."""
    with _filled(spark, sf, events_log(spark, sf)) as store:
        if not store.compact_due():
            raise AssertionError("no compaction was due")
        return shown(store.scan())


@query
def store_multi_get(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh customer number, over several segments."""
    wanted = table(spark, sf, "customer").select((F.col("c_custkey") * 7).alias("n"))
    with _filled(spark, sf, orders_log(spark, sf)) as store, store.read_view() as view:
        return shown(view.multi_get(wanted.select(utf8(F.concat(F.lit("cust/"), F.lpad(F.col("n").cast("string"), 8, "0"))).alias("key"))))


@query
def store_scan_range(spark: SparkSession, sf: str) -> DataFrame:
    """A client's range with a limit, over several segments."""
    with _filled(spark, sf, orders_log(spark, sf)) as store:
        return shown(store.scan("cust/00000010", "cust/00000090", 25))


@query
def store_backup_restore(spark: SparkSession, sf: str) -> DataFrame:
    """A reader opened before the writes backs up the newest state, which becomes a store of its own."""
    log, root = events_log(spark, sf), _folder(spark)
    with Store.open(spark, f"{root}/live") as store, Store.open(spark, f"{root}/live", write=False) as reader:
        store.apply(log)
        reader.backup(f"{root}/backup")
    with Store.restore_backup(spark, f"{root}/backup", f"{root}/new") as new:
        return shown(new.scan())


@query
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Counters after four batches, a rejected one, a checkpoint and a restore."""
    log = events_log(spark, sf)
    with _filled(spark, sf, log) as store:
        try:
            store.apply(log.limit(1).select("key", "revision", F.lit(False).alias("deleted"), utf8(F.lit("other")).alias("value")))
        except InvalidRevisionError:
            pass
        copy = store.checkpoint(f"{store.root}-copy")
        store.restore(copy)
        return store.stats().select("entries", "commits", "rejected", "proposals", "failed_proposals", "checkpoints", "restores", "compactions", "failed_compactions", "active_compactions")
