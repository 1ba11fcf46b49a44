"""Conditional transactions: conditions on one view, and the serial fold of a log of commands."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlake.functions.keys import as_bytes
from revlake.operators.graph import components
from revlake.plans.schema import COMMANDS

EXISTS, MISSING, VALUE_EQUALS, REVISION_EQUALS = "exists", "missing", "value_equals", "revision_equals"


@dataclass(frozen=True)
class Condition:
    kind: str
    key: bytes
    value: bytes | None = None
    revision: int | None = None

    @classmethod
    def exists(cls, key: bytes | str) -> Condition:
        return cls(EXISTS, as_bytes(key))

    @classmethod
    def missing(cls, key: bytes | str) -> Condition:
        return cls(MISSING, as_bytes(key))

    @classmethod
    def value_equals(cls, key: bytes | str, value: bytes | str) -> Condition:
        return cls(VALUE_EQUALS, as_bytes(key), as_bytes(value))

    @classmethod
    def revision_equals(cls, key: bytes | str, revision: int) -> Condition:
        if revision <= 0:
            raise ValueError("an expected revision is above 0")
        return cls(REVISION_EQUALS, as_bytes(key), None, revision)


@dataclass(frozen=True)
class Operation:
    key: bytes
    value: bytes | None

    @classmethod
    def put(cls, key: bytes | str, value: bytes | str) -> Operation:
        if key is None or value is None:
            raise ValueError("a put needs a key and a value")
        return cls(as_bytes(key), as_bytes(value))

    @classmethod
    def delete(cls, key: bytes | str) -> Operation:
        if key is None:
            raise ValueError("a delete needs a key")
        return cls(as_bytes(key), None)


def check_operations(operations: list[Operation]) -> list[Operation]:
    """A batch is not empty and has one operation per key."""
    if not operations:
        raise ValueError("a batch needs an operation")
    if len({o.key for o in operations}) < len(operations):
        raise ValueError("a batch has one operation per key")
    return operations


@dataclass(frozen=True)
class Transaction:
    """Operations that apply if all conditions hold on the view before them; without conditions they always do."""

    operations: list[Operation]
    conditions: list[Condition] = field(default_factory=list)

    def __post_init__(self):
        check_operations(self.operations)


@dataclass(frozen=True)
class TransactionResult:
    """applied, and the revision of the writes (None for a failed transaction, which has no visible one)."""

    applied: bool
    revision: int | None


def evaluate(transactions: DataFrame, visible: DataFrame) -> DataFrame:
    """id and holds for transactions (id, conditions), each against the same view: the AND of its conditions.

    Value and revision conditions are false for an absent key; no conditions always hold.
    """
    rows = transactions.select("id", F.explode_outer("conditions").alias("c"))
    seen = visible.select(F.col("key").alias("_key"), F.col("value").alias("_value"), F.col("revision").alias("_revision"))
    rows = rows.join(seen, F.col("c.key") == F.col("_key"), "left")
    holds = (
        F.when(F.col("c").isNull(), True)
        .when(F.col("c.kind") == EXISTS, F.col("_key").isNotNull())
        .when(F.col("c.kind") == MISSING, F.col("_key").isNull())
        .when(F.col("c.kind") == VALUE_EQUALS, F.coalesce(F.col("_value") == F.col("c.value"), F.lit(False)))
        .when(F.col("c.kind") == REVISION_EQUALS, F.coalesce(F.col("_revision") == F.col("c.revision"), F.lit(False)))
        .otherwise(F.raise_error(F.concat(F.lit("unknown condition "), F.coalesce("c.kind", F.lit("null")))).cast("boolean"))
    )
    return rows.groupBy("id").agg(F.every(holds).alias("holds"))


def _holds(condition: dict, state: dict) -> bool:
    entry = state.get(condition["key"])
    match condition["kind"]:
        case "exists":
            return entry is not None
        case "missing":
            return entry is None
        case "value_equals":
            return entry is not None and entry[0] == condition["value"]
        case "revision_equals":
            return entry is not None and entry[1] == condition["revision"]
    raise ValueError(f"unknown condition {condition['kind']}")


def fold(commands: DataFrame, initial: DataFrame | None = None, single_key: bool = False) -> DataFrame:
    """revision and applied for every command, each judged on the state that the earlier applied ones leave.

    Commands that share keys, directly or by a chain, form a component, which is folded in revision
    order; single_key says that every command's conditions and operations are on one key, so that no
    components need to be found. A component's rows are sorted and streamed: a task holds the state of
    one component's keys, never its commands. initial is a view that the first commands see. Null conditions
    or operations count as none; a command without either is applied and changes nothing.
    """
    commands = commands.select(*(F.col(f.name).cast(f.dataType) for f in COMMANDS))
    listed = lambda name: F.coalesce(F.transform(name, lambda x: x["key"]), F.array().cast("array<binary>"))
    keys = F.array_distinct(F.concat(listed("conditions"), listed("operations")))
    if single_key:
        placed = commands.withColumn("component", F.col("operations")[0]["key"])
        of_key = None
    else:
        members = commands.select(F.col("revision").alias("group"), F.explode(keys).alias("member"))
        labels = components(members)
        placed = commands.join(labels.withColumnRenamed("group", "revision"), "revision", "left").withColumn("component", F.col("component").cast("string").cast("binary"))
        of_key = members.join(labels, "group").groupBy(F.col("member").alias("key")).agg(F.min("component").cast("string").cast("binary").alias("component"))
    if initial is not None:
        start = initial.select("key", "value", "revision")
        start = start.withColumn("component", F.col("key")) if of_key is None else start.join(of_key, "key")
        # What exists already is put unconditionally before all commands; its own revision goes along.
        put = F.array(F.struct("key", F.lit(False).alias("deleted"), "value"))
        start = start.select(F.col("revision").alias("at"), F.lit(0).cast("bigint").alias("revision"), F.array().cast(COMMANDS["conditions"].dataType).alias("conditions"), put.cast(COMMANDS["operations"].dataType).alias("operations"), "component")
        placed = placed.withColumn("at", F.col("revision")).unionByName(start)
    else:
        placed = placed.withColumn("at", F.col("revision"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, state = None, {}
        for batch in batches:
            out = ([], [])
            for row in batch.to_pylist():
                if row["component"] != component:
                    component, state = row["component"], {}
                applied = all(_holds(c, state) for c in row["conditions"] or ())
                if applied:
                    for o in row["operations"] or ():
                        if o["deleted"]:
                            state.pop(o["key"], None)
                        else:
                            state[o["key"]] = (o["value"], row["at"])
                if row["revision"] > 0:
                    out[0].append(row["revision"])
                    out[1].append(applied)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_())], ["revision", "applied"])

    ordered = placed.repartition("component").sortWithinPartitions("component", "revision")
    return ordered.select("component", "revision", "at", "conditions", "operations").mapInArrow(run, "revision bigint, applied boolean")


def entries(commands: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The log entries of the applied commands; a failed one leaves none, though its revision is used up."""
    rows = commands.join(outcomes.where("applied").select("revision"), "revision").select("revision", F.explode("operations").alias("o"))
    return rows.select("o.key", "revision", "o.deleted", F.when(~F.col("o.deleted"), F.col("o.value")).alias("value"))


def replay(log: DataFrame, commands: DataFrame, applied_index: int) -> DataFrame:
    """The log with the commands after applied_index folded in; earlier ones are skipped, not judged again."""
    from revlake.operators.visibility import visible

    fresh = commands.where(F.col("revision") > F.lit(applied_index))
    return log.unionByName(entries(fresh, fold(fresh, visible(log))))
