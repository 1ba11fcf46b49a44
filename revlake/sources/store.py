"""A store: immutable Parquet segments, and manifests that publish sets of them atomically.

One writer holds the store (a lock file); readers pin a manifest, so a view never changes. A reader in
another process says so by a lease file, which the writer's compaction and vacuum honour until it is
given back or expires. All data moves through Spark jobs; the driver handles file statistics and
manifests only.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from revlake.errors import CorruptionError, InvalidRevisionError, RevisionExpiredError, StoreClosedError, StoreLockedError
from revlake.functions.keys import as_bytes
from revlake.operators import compact as compaction
from revlake.operators import txn, validate, visibility
from revlake.operators.compact import Policy, Segment
from revlake.operators.ranges import KeyRange
from revlake.plans.schema import LOG, check_log
from revlake.session import reach
from revlake.sources.files import Files
from revlake.sources.manifest import Manifest, measure, read_segments, write_segment

#: Literal keys that go into a scan's predicate.
MOST_LITERALS = 1000
#: Seconds for which a reader's lease, or the files of a frame that scan() gave, are kept.
LEASE_SECONDS = 24 * 3600
#: Consistency of a read: of the newest manifest, or of the one already loaded.
LINEARIZABLE, LOCAL = "linearizable", "local"


class ScanCursor:
    """Entries one by one, in key order; may be iterated once, and closed early."""

    def __init__(self, rows: DataFrame):
        self._rows, self._used, self._closed = rows, False, False

    def __iter__(self) -> Iterator[Row]:
        if self._used or self._closed:
            raise StoreClosedError("a cursor is read once")
        self._used = True
        for row in self._rows.toLocalIterator():
            if self._closed:
                return
            yield row

    def stream(self) -> DataFrame:
        return self._rows

    def close(self) -> None:
        self._closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class ReadView:
    """Reads of one pinned manifest at one revision; open views hold back compaction and file deletion.

    A view of a store opened for reading expires after the store's lease_seconds, unless renew() is called.
    """

    def __init__(self, store: Store, manifest: Manifest, revision: int, lease: str | None = None):
        self._store, self._manifest, self.revision, self._open, self._lease = store, manifest, revision, True, lease
        self._until = time.time() + store.lease_seconds
        store._views[id(self)] = self

    def _use(self) -> None:
        if not self._open:
            raise StoreClosedError("the view is closed")
        if self._lease and time.time() > self._until:
            self.close()
            raise StoreClosedError("the view's lease has expired")

    def renew(self) -> None:
        """Starts the lease anew."""
        self._use()
        if self._lease:
            self._store._lease(self._manifest.version, self.revision, self._lease)
        self._until = time.time() + self._store.lease_seconds

    def log(self, keys: KeyRange = KeyRange()) -> DataFrame:
        """The entries at or below the revision, from the files that the range can meet."""
        self._use()
        segments = self._manifest.pick(keys, self.revision)
        rows = read_segments(self._store.spark, self._store.root, segments).where(F.col("revision") <= self.revision)
        return rows if keys == KeyRange() else rows.where(keys.predicate())

    def get(self, key: bytes | str) -> tuple[bytes, int] | None:
        """Value and the revision of its last change, or None."""
        raw = as_bytes(key)
        row = visibility.get(self.log(KeyRange.between(raw, raw + b"\0")), raw).first()
        return (bytes(row.value), row.revision) if row.found else None

    def multi_get(self, keys: DataFrame | Iterable[bytes | str]) -> DataFrame:
        """One row per distinct key, from the files that a key can be in.

        Literal keys also go into the scan as a predicate, where row-group statistics and Bloom filters use them; of a
        DataFrame's keys the smallest and the greatest pick the files, and a semi-join cuts the rows down.
        """
        self._use()
        spark, root = self._store.spark, self._store.root
        if isinstance(keys, DataFrame):
            ends = keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
            wanted = KeyRange() if ends.low is None else KeyRange(bytes(ends.low), bytes(ends.high) + b"\0")
            return visibility.multi_get(self.log(wanted), keys)
        keys = sorted({as_bytes(k) for k in keys})
        rows = read_segments(spark, root, self._manifest.pick_keys(keys, self.revision)).where(F.col("revision") <= self.revision)
        return visibility.multi_get(rows.where(F.col("key").isin(keys)) if 0 < len(keys) <= MOST_LITERALS else rows, keys)

    def scan(self, keys: KeyRange = KeyRange(), limit: int = 0) -> DataFrame:
        return visibility.scan(self.log(keys), None, None, limit)

    def cursor(self, keys: KeyRange = KeyRange(), limit: int = 0) -> ScanCursor:
        return ScanCursor(self.scan(keys, limit))

    def close(self) -> None:
        self._open = False
        self._store._views.pop(id(self), None)
        if self._lease:
            self._store._files.delete(self._lease)
            self._lease = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Store:
    def __init__(self, spark: SparkSession, root: str, policy: Policy, writer: str | None, lease_seconds: float = LEASE_SECONDS):
        self.spark, self.root, self.policy, self.lease_seconds = reach(spark), root.rstrip("/"), policy, lease_seconds
        self._files, self._writer, self._views, self._closed = Files(spark), writer, {}, False
        self._frames: list[tuple[float, ReadView]] = []
        self._intents: list[str] = []
        self.counters, self.events, self._cursors = Counter(), [], {}
        self.manifest = self._load()

    # Opening and manifests

    @classmethod
    def open(cls, spark: SparkSession, root: str, policy: Policy = Policy(), write: bool = True, lease_seconds: float = LEASE_SECONDS) -> Store:
        """Opens a store, or makes an empty one; checks that manifest and folder agree in both directions.

        What a writer that died left unpublished is deleted by the next writer; it is known by its intent files.
        """
        files, root = Files(spark), root.rstrip("/")
        writer = uuid.uuid4().hex if write else None
        files.make(f"{root}/_manifest")
        if write and not files.create(f"{root}/_lock", writer):
            raise StoreLockedError(f"{root} has a writer; if it died, delete _lock")
        try:
            if not any(n.startswith("v") for n in files.names(f"{root}/_manifest")):
                if any(not n.startswith("_") for n in files.names(root)):
                    raise CorruptionError(f"{root} has data but no manifest")
                files.publish(f"{root}/_manifest/v{0:012d}.json", Manifest().to_json())
            store = cls(spark, root, policy, writer, lease_seconds)
            store._check_files()
            return store
        except BaseException:
            if write:
                files.delete(f"{root}/_lock")
            raise

    def close(self) -> None:
        if not self._closed:
            for view in list(self._views.values()):
                view.close()
            self._closed = True
            if self._writer:
                self._files.delete(f"{self.root}/_lock")

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _load(self) -> Manifest:
        names = [n for n in self._files.names(f"{self.root}/_manifest") if n.startswith("v")]
        if not names:
            raise CorruptionError("no manifest")
        return Manifest.from_json(self._files.read(f"{self.root}/_manifest/{names[-1]}"))

    def _manifests(self) -> list[str]:
        return [n for n in self._files.names(f"{self.root}/_manifest") if n.startswith("v")]

    def _check_files(self) -> None:
        """Every file of the newest manifest is there in its size, and every file there is of some manifest.

        Folders are listed before intents, and intents before manifests: a folder that a writer is filling has its
        intent, and one whose intent is gone has been published before the manifests are read.
        """
        found = {f: {n: size for n, size in self._files.sizes(f"{self.root}/{f}").items() if n.startswith("part-")} for f in self._files.names(self.root) if f.startswith("data-")}
        intents = [n.removeprefix("intent-") for n in self._files.names(f"{self.root}/_manifest") if n.startswith("intent-")]
        tracked, names = set(), self._manifests()
        for name in names[:-1]:
            try:
                tracked |= {s.path for s in Manifest.from_json(self._files.read(f"{self.root}/_manifest/{name}")).segments}
            except CorruptionError:
                raise
            except Exception:  # noqa: BLE001  the writer has deleted this version meanwhile
                continue
        self.manifest = self._load()
        tracked |= {s.path for s in self.manifest.segments}
        for s in self.manifest.segments:
            folder, name = s.path.split("/")
            if folder not in found:
                found[folder] = self._files.sizes(f"{self.root}/{folder}")
            if (size := found[folder].get(name)) != s.size:
                raise CorruptionError(f"{s.path} has {size} bytes; the manifest says {s.size}")
        for folder, parts in found.items():
            if folder in intents:
                if self._writer:
                    if not any(path.startswith(f"{folder}/") for path in tracked):
                        self._files.delete(f"{self.root}/{folder}")
                    self._files.delete(f"{self.root}/_manifest/intent-{folder}")
            elif (strange := [n for n in parts if f"{folder}/{n}" not in tracked]) and self._files.exists(f"{self.root}/{folder}/{strange[0]}"):
                raise CorruptionError(f"{folder}/{strange[0]} is in no manifest")

    def _use(self, write: bool = False) -> None:
        if self._closed:
            raise StoreClosedError(self.root)
        if write and not self._writer:
            raise StoreLockedError("opened for reading")

    def _publish(self, manifest: Manifest) -> None:
        if not self._files.publish(f"{self.root}/_manifest/v{manifest.version:012d}.json", manifest.to_json()):
            raise StoreLockedError(f"version {manifest.version} was published by another writer")
        self.manifest = manifest
        for folder in self._intents:
            self._files.delete(f"{self.root}/_manifest/intent-{folder}")
        self._intents.clear()

    def _add(self, log: DataFrame, level: int, files: int, order: int) -> tuple[Segment, ...]:
        folder = self._folder()
        write_segment(log, self.root, folder, files)
        made = measure(self.spark, self.root, folder, level, order)
        self._tidy(folder, {s.path for s in made})
        return made

    def _folder(self) -> str:
        """A new folder's name, under an intent that the publication of its files ends."""
        folder = f"data-{uuid.uuid4().hex}"
        self._files.create(f"{self.root}/_manifest/intent-{folder}", "")
        self._intents.append(folder)
        return folder

    def _tidy(self, folder: str, paths: set[str]) -> None:
        """Deletes the files without entries that Spark writes for empty partitions."""
        for name in self._files.names(f"{self.root}/{folder}"):
            if name.startswith("part-") and f"{folder}/{name}" not in paths:
                self._files.delete(f"{self.root}/{folder}/{name}")

    def _lease(self, version: int, revision: int, path: str | None = None) -> str:
        """Writes or renews a reader's lease: the version whose files and the revision whose entries it needs."""
        if path:
            self._files.delete(path)
        path = path or f"{self.root}/_manifest/lease-{uuid.uuid4().hex}"
        self._files.publish(path, json.dumps({"version": version, "revision": revision, "until": time.time() + self.lease_seconds}))
        return path

    def _leases(self) -> list[dict]:
        """The leases of readers in any process; expired ones are deleted."""
        out = []
        for name in self._files.names(f"{self.root}/_manifest"):
            if name.startswith("lease-"):
                path = f"{self.root}/_manifest/{name}"
                try:
                    lease = json.loads(self._files.read(path))
                except Exception:  # noqa: BLE001  its reader has given it back meanwhile
                    continue
                if lease["until"] < time.time():
                    self._files.delete(path)
                else:
                    out.append(lease)
        return out

    # Reads

    def read_view(self, at: int | None = None, consistency: str = LINEARIZABLE) -> ReadView:
        """Pins the newest (or the loaded) manifest, then takes its revision, or an earlier one that the caller names.

        An earlier one is refused where compaction has already dropped versions that it needs.
        """
        self._use()
        if consistency not in (LINEARIZABLE, LOCAL):
            raise ValueError(consistency)
        if consistency == LINEARIZABLE:
            self.manifest = self._load()
        self.counters["read_views"] += 1
        while True:
            manifest = self.manifest
            revision = manifest.applied_through if at is None else min(at, manifest.applied_through)
            if revision < manifest.retained_from:
                raise RevisionExpiredError(f"revisions below {manifest.retained_from} are not kept")
            if self._writer:  # the one process that deletes files knows its own views
                return ReadView(self, manifest, revision)
            lease = self._lease(manifest.version, revision)
            if self._files.exists(f"{self.root}/_manifest/v{manifest.version:012d}.json"):
                return ReadView(self, manifest, revision, lease)
            self._files.delete(lease)  # the version went before the lease was there
            self.manifest = self._load()

    def get(self, key: bytes | str, consistency: str = LINEARIZABLE) -> tuple[bytes, int] | None:
        with self.read_view(None, consistency) as view:
            return view.get(key)

    def scan(self, start: bytes | str | None = None, end: bytes | str | None = None, limit: int = 0, consistency: str = LINEARIZABLE) -> DataFrame:
        """Entries in key order; None and empty bounds are unbounded, a limit of 0 or less is none.

        The frame is lazy: its files are kept for lease_seconds, or until release() or close().
        """
        self._expire_frames()
        view = self.read_view(None, consistency)
        self._frames.append((time.time() + self.lease_seconds, view))
        return view.scan(KeyRange.from_request(start, end), limit)

    def _expire_frames(self) -> None:
        for until, view in list(self._frames):
            if until < time.time():
                view.close()
                self._frames.remove((until, view))

    def release(self) -> None:
        """Gives up the files of all frames that scan() gave."""
        for _, view in self._frames:
            view.close()
        self._frames.clear()

    # Writes

    def apply(self, log: DataFrame, applied_index: int | None = None, batch: tuple[str, int] | None = None) -> dict[str, int]:
        """Appends entries that carry revisions, all or none, and gives the count of each class.

        Within a revision a key occurs once. An entry is compared with its key's latest stored entry; a stale
        or conflicting one rejects the whole batch; exact duplicates are dropped. Entries of the batch need no
        comparison with each other, as key and revision tell them apart. An empty batch changes nothing.
        """
        self._use(write=True)
        self.counters["proposals"] += 1
        rows, judged, failed = check_log(log).persist(), None, True
        try:
            # One shuffle, of one row for each key and revision of a task, finds the bounds and what occurs twice.
            once = rows.groupBy("key", "revision").agg(F.count(F.lit(1)).alias("n"))
            bounds = once.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.max("revision").alias("top"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most")).first()
            if not bounds.n and applied_index is None and batch is None:
                failed = False
                return {}
            if bounds.n and bounds.most > 1:
                raise ValueError("a revision has one entry per key")
            known = self.manifest.pick(KeyRange(bytes(bounds.low), bytes(bounds.high) + b"\0")) if bounds.n else []
            if known:
                latest = read_segments(self.spark, self.root, known).join(rows.select("key").distinct(), "key", "left_semi")
                judged = validate.classify(rows, visibility.latest_entries(latest)).persist()
                counts = {r.cls: r["count"] for r in judged.groupBy("cls").count().collect()}
            else:
                counts = {validate.APPLY: bounds.n} if bounds.n else {}
            if bad := {k: counts[k] for k in (validate.STALE, validate.CONFLICT) if k in counts}:
                self.counters["rejected"] += 1
                raise InvalidRevisionError(f"nothing was written: {bad}")
            fresh = counts.get(validate.APPLY, 0)
            wanted = rows if judged is None else judged.where(F.col("cls") == validate.APPLY)
            added = self._add(wanted, 0, -(-fresh // self.policy.target_rows), self.manifest.next_order) if fresh else ()
            old = self.manifest
            self._publish(
                old.next(
                    segments=(*old.segments, *added),
                    applied_through=max(old.applied_through, bounds.top or 0) if fresh else old.applied_through,
                    applied_index=max(old.applied_index, bounds.top or 0, applied_index or 0),
                    next_order=old.next_order + 1,
                    batches=old.batches | ({batch[0]: batch[1]} if batch else {}),
                )
            )
            self.counters["commits"] += 1
            self.counters["entries"] += fresh
            failed = False
            return counts
        finally:
            self.counters["failed_proposals"] += failed
            rows.unpersist()
            if judged is not None:
                judged.unpersist()

    def _write(self, operations: list[txn.Operation]) -> int:
        revision = self.manifest.applied_index + 1
        rows = [(o.key, revision, o.value is None, o.value) for o in txn.check_operations(operations)]
        self.apply(self.spark.createDataFrame(rows, LOG))
        return revision

    def put(self, key: bytes | str, value: bytes | str) -> int:
        return self._write([txn.Operation.put(key, value)])

    def delete(self, key: bytes | str) -> int:
        """Writes a deletion and gives its revision, whether or not the key exists."""
        return self._write([txn.Operation.delete(key)])

    def write(self, operations: list[txn.Operation]) -> int:
        """All operations at one revision; none is an error, as is a key twice."""
        return self._write(operations)

    def write_frame(self, operations: DataFrame) -> int:
        """The same for a large batch: key, deleted, value."""
        self._use(write=True)
        if validate.duplicates(operations).limit(1).count() or operations.isEmpty():
            raise ValueError("a batch needs operations, one per key")
        revision = self.manifest.applied_index + 1
        self.apply(operations.select("key", F.lit(revision).cast("bigint").alias("revision"), "deleted", "value"))
        return revision

    def transact(self, transaction: txn.Transaction) -> txn.TransactionResult:
        """Checks the conditions on one view and then writes; a failed one uses up its index and writes nothing."""
        self._use(write=True)
        self.counters["transactions"] += 1
        with self.read_view(None, LOCAL) as view:
            keys = [c.key for c in transaction.conditions]
            asked = self.spark.createDataFrame([(0, [(c.kind, c.key, c.value, c.revision) for c in transaction.conditions])], "id int, conditions array<struct<kind:string,key:binary,value:binary,revision:bigint>>")
            seen = view.multi_get(keys).where("found") if keys else self.spark.createDataFrame([], "key binary, value binary, revision bigint")
            holds = txn.evaluate(asked, seen).first().holds
        if holds:
            return txn.TransactionResult(True, self._write(list(transaction.operations)))
        self.counters["failed_transactions"] += 1
        self._publish(self.manifest.next(applied_index=self.manifest.applied_index + 1))
        return txn.TransactionResult(False, None)

    def replay(self, commands: DataFrame, single_key: bool = False) -> DataFrame:
        """Applies the commands after applied_index in order; gives revision and applied for those."""
        self._use(write=True)
        fresh = commands.where(F.col("revision") > self.manifest.applied_index)
        with self.read_view(None, LOCAL) as view:
            outcomes = txn.fold(fresh, visibility.visible(view.log()), single_key).checkpoint()
        last = outcomes.agg(F.max("revision")).first()[0]
        if last is not None:
            self.apply(txn.entries(fresh, outcomes), applied_index=last)
        return outcomes

    # Compaction

    def oldest_snapshot(self) -> int | None:
        """The lowest revision of an open view here or of a reader's lease; frames of scan() need files only."""
        self._expire_frames()
        frames = {id(view) for _, view in self._frames}
        own = [v.revision for v in self._views.values() if id(v) not in frames]
        return min([*own, *(lease["revision"] for lease in self._leases())], default=None)

    def compact(self) -> None:
        """Merges all segments into the last level, keeping what open views need."""
        self._use(write=True)
        level = self.policy.levels - 1
        self._merge(compaction.Task(self.manifest.segments, level, 0.0, True))

    def compact_due(self) -> int:
        """Runs the planned compactions until none is due; gives their number."""
        self._use(write=True)
        done = 0
        while tasks := compaction.plan(self.manifest.segments, self.policy, self._cursors):
            for task in tasks:
                self._cursors[task.level - 1] = task.high
                self._merge(task)
                done += 1
        return done

    def _merge(self, task: compaction.Task) -> None:
        if not task.inputs:
            return
        began, old, oldest = time.time(), self.manifest, self.oldest_snapshot()
        self.counters["active_compactions"] += 1
        try:
            self._replace(task, old, oldest)
        except BaseException:
            self.counters["failed_compactions"] += 1
            raise
        finally:
            self.counters["active_compactions"] -= 1
        self.counters["compactions"] += 1
        self._event("compaction", began, inputs=len(task.inputs), outputs=len(self.manifest.segments) + len(task.inputs) - len(old.segments), level=task.level)

    def _replace(self, task: compaction.Task, old: Manifest, oldest: int | None) -> None:
        rows = compaction.retain(read_segments(self.spark, self.root, list(task.inputs)), oldest, task.drop_deletions)
        added = self._add(rows, task.level, compaction.output_files(task, self.policy), old.next_order)
        rest = tuple(s for s in old.segments if s not in task.inputs)
        floor = old.applied_through if oldest is None else min(oldest, old.applied_through)
        self._publish(old.next(segments=(*rest, *added), next_order=old.next_order + 1, retained_from=max(old.retained_from, floor)))

    def vacuum(self, keep_versions: int = 1) -> int:
        """Deletes old manifests and the files that no kept manifest, open view or lease needs; gives the number of files.

        Manifests go first and leases are read again after that: a reader whose version went before its lease was there
        takes a newer one. A folder is deleted at once when none of its files is needed."""
        self._use(write=True)
        self._expire_frames()
        names = self._manifests()
        leased = {f"v{lease['version']:012d}.json" for lease in self._leases()}
        for name in names[: -max(1, keep_versions)]:
            if name not in leased:
                self._files.delete(f"{self.root}/_manifest/{name}")
        self._leases()
        kept = [Manifest.from_json(self._files.read(f"{self.root}/_manifest/{n}")) for n in self._manifests()]
        needed = {s.path for m in (*kept, *(v._manifest for v in self._views.values())) for s in m.segments}
        gone = 0
        for folder in self._files.names(self.root):
            if folder.startswith("data-"):
                parts = [n for n in self._files.names(f"{self.root}/{folder}") if n.startswith("part-")]
                if unused := [n for n in parts if f"{folder}/{n}" not in needed]:
                    gone += len(unused)
                    for path in [f"{self.root}/{folder}"] if len(unused) == len(parts) else [f"{self.root}/{folder}/{n}" for n in unused]:
                        self._files.delete(path)
        return gone

    # Checkpoints

    def checkpoint(self, target: str) -> str:
        """A self-contained copy: every segment's file, and a manifest written last. Where executors cannot copy files, entries are written anew."""
        self._use()
        began, target = time.time(), target.rstrip("/")
        if self._files.exists(f"{target}/checkpoint.json"):
            raise ValueError(f"{target} has a checkpoint")
        made = self._copied(self.root, target, {s: f"level-{s.level}/{s.path.split('/')[1]}" for s in self.manifest.segments})
        if made is None:
            made = []
            for level in sorted({s.level for s in self.manifest.segments}):
                own = [s for s in self.manifest.segments if s.level == level]
                folder = f"level-{level}"
                write_segment(read_segments(self.spark, self.root, own), target, folder, max(1, sum(s.size for s in own) // self.policy.target_size, -(-sum(s.rows for s in own) // self.policy.target_rows)))
                made += measure(self.spark, target, folder, level, 0)
        self._files.publish(f"{target}/checkpoint.json", replace(self.manifest, segments=tuple(made)).to_json())
        self.counters["checkpoints"] += 1
        self._event("checkpoint", began, files=len(made))
        return target

    def backup(self, target: str) -> str:
        """A checkpoint of the newest published state, also from a store whose loaded manifest is older."""
        self._use()
        self.manifest = self._load()
        return self.checkpoint(target)

    def _copied(self, source: str, target: str, paths: dict[Segment, str]) -> list[Segment] | None:
        """The segments at their new paths after their files were copied, or None if executors cannot. They are immutable, so what the manifest says of them holds."""
        sizes = self._files.copy([(f"{source}/{s.path}", f"{target}/{path}") for s, path in paths.items()]) if paths else {}
        if sizes is None:
            return None
        for s, path in paths.items():
            if sizes[f"{target}/{path}"] != s.size:
                raise CorruptionError(f"{s.path} changed while it was copied")
        return [replace(s, path=path) for s, path in paths.items()]

    @staticmethod
    def read_checkpoint(spark: SparkSession, source: str) -> Manifest:
        """The checkpoint's manifest, after its files' sizes, rows and fingerprints were checked against it."""
        files, source = Files(spark), source.rstrip("/")
        if not files.exists(f"{source}/checkpoint.json"):
            raise CorruptionError(f"{source} has no checkpoint")
        said = Manifest.from_json(files.read(f"{source}/checkpoint.json"))
        listed = {folder: files.sizes(f"{source}/{folder}") for folder in {s.path.split("/")[0] for s in said.segments}}
        for s in said.segments:
            if (size := listed[s.path.split("/")[0]].get(s.path.split("/")[1])) != s.size:
                raise CorruptionError(f"{s.path} has {size} bytes; the checkpoint says {s.size}")
        for folder in sorted({s.path.split("/")[0] for s in said.segments}):
            try:
                found = measure(spark, source, folder, 0, 0)
            except Exception as e:
                raise CorruptionError(f"{folder} cannot be read: {str(e)[:200]}") from None
            facts = lambda s: (s.path, s.rows, s.fingerprint)
            if {facts(s) for s in found} != {facts(s) for s in said.segments if s.path.startswith(f"{folder}/")}:
                raise CorruptionError(f"{folder} does not hold the checkpoint's entries")
        return said

    def restore(self, source: str) -> None:
        """Replaces the state by a checkpoint's, whose revisions may lie lower. Nothing changes if it is broken."""
        self._use(write=True)
        source = source.rstrip("/")
        began, said, added = time.time(), self.read_checkpoint(self.spark, source), []
        folders = {f: self._folder() for f in sorted({s.path.split("/")[0] for s in said.segments})}
        copied = self._copied(source, self.root, {s: f"{folders[s.path.split('/')[0]]}/{s.path.split('/')[1]}" for s in said.segments})
        if copied is None:
            for level in sorted({s.level for s in said.segments}):
                own = [s for s in said.segments if s.level == level]
                added += self._add(read_segments(self.spark, source, own), level, len(own), self.manifest.next_order)
        else:
            added = copied
        self._publish(
            self.manifest.next(segments=tuple(added), applied_through=said.applied_through, applied_index=said.applied_index, next_order=self.manifest.next_order + 1, batches=said.batches, retained_from=said.retained_from)
        )
        self.counters["restores"] += 1
        self._event("restore", began, files=len(added))

    @classmethod
    def from_checkpoint(cls, spark: SparkSession, source: str, root: str, policy: Policy = Policy()) -> Store:
        """A new store with a checkpoint's state, in a folder that is empty or missing; cleaned up on failure."""
        files = Files(spark)
        if files.names(root):
            raise ValueError(f"{root} is not empty")
        store = None
        try:
            store = cls.open(spark, root, policy)
            store.restore(source)
            return store
        except BaseException:
            if store:
                store.close()
            files.delete(root)
            raise

    restore_backup = from_checkpoint

    # Facts

    def metadata(self) -> DataFrame:
        m = self.manifest
        return self.spark.createDataFrame([(m.version, m.applied_index, m.applied_through)], "version bigint, applied_index bigint, applied_through bigint")

    def segments(self) -> DataFrame:
        fields = "path string, level int, rows bigint, size bigint, low binary, high binary, min_revision bigint, max_revision bigint, fingerprint string, commit bigint"
        return self.spark.createDataFrame([(s.path, s.level, s.rows, s.size, s.low, s.high, s.min_revision, s.max_revision, s.fingerprint, s.order) for s in self.manifest.segments], fields)

    def stats(self) -> DataFrame:
        """One row of counters and sizes."""
        m = self.manifest
        row = {
            "segments": len(m.segments),
            "level0_segments": sum(s.level == 0 for s in m.segments),
            "entries": sum(s.rows for s in m.segments),
            "bytes": sum(s.size for s in m.segments),
            "open_views": len(self._views),
            **{k: self.counters[k] for k in ("proposals", "failed_proposals", "commits", "rejected", "transactions", "failed_transactions", "compactions", "failed_compactions", "active_compactions", "checkpoints", "restores", "read_views")},
        }
        for event in ("compaction", "checkpoint", "restore"):
            took = [e["ms"] for e in self.events if e["event"] == event]
            row |= {f"{event}_ms": int(sum(took)), f"last_{event}_ms": int(took[-1]) if took else 0}
        return self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} bigint" for k in row))

    def _event(self, event: str, began: float, **facts) -> None:
        self.events.append({"event": event, "ms": 1000 * (time.time() - began), **facts})

    def event_log(self) -> DataFrame:
        return self.spark.createDataFrame([(e["event"], float(e["ms"]), json.dumps(e, sort_keys=True)) for e in self.events], "event string, ms double, facts string")

    def status(self) -> DataFrame:
        """One row: this process is the only node; the commit of a manifest stands in for consensus."""
        m = self.manifest
        role = "leader" if self._writer else "reader"
        return self.spark.createDataFrame([("local", role, m.version, m.applied_index, m.applied_through)], "node_id string, role string, version bigint, applied_index bigint, applied_through bigint")

    def members(self) -> DataFrame:
        return self.spark.createDataFrame([("local", "voter", self.root)], "node_id string, role string, address string")
