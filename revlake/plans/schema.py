"""Fixed schemas. Keys and values are bytes; an empty value differs from a deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The mutation log. value is null exactly if deleted.
LOG = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("revision", T.LongType()),
        T.StructField("deleted", T.BooleanType()),
        T.StructField("value", T.BinaryType()),
    ]
)
#: Writes without a revision: what a batch holds.
OPERATIONS = T.StructType([LOG["key"], LOG["deleted"], LOG["value"]])
CONDITION = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("revision", T.LongType()),
    ]
)
#: Commands in log order; a plain write has no conditions.
COMMANDS = T.StructType(
    [
        T.StructField("revision", T.LongType()),
        T.StructField("conditions", T.ArrayType(CONDITION)),
        T.StructField("operations", T.ArrayType(OPERATIONS)),
    ]
)


def check_log(log: DataFrame) -> DataFrame:
    """The log's four columns, in order and typed; a bad row fails the job that reads it.

    Revisions are positive, keys are not null, and a value is null exactly if the entry is a deletion.
    """
    sound = F.coalesce((F.col("revision") > 0) & F.col("key").isNotNull() & (F.col("deleted") == F.col("value").isNull()), F.lit(False))
    named = log.select(*(F.col(f.name).cast(f.dataType) for f in LOG))
    return named.withColumn("revision", F.when(sound, F.col("revision")).otherwise(F.raise_error(F.lit("not a log entry: key, positive revision and value or deletion are needed")).cast("bigint")))
