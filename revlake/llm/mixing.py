"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from revlake.llm.common import Workspace

#: Words: runs of anything but space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources by code point, repeating; words in the mix per word of input; most passes over a source.
WEIGHTS, SHARE, PASSES = (3, 1, 2), 1.5, 2
#: A source has about this many equal blocks, or one for each word if it has fewer: a target is met to this part of the source, and
#: the schedule's length follows the number of sources, not the corpus.
BLOCKS = 1 << 16
#: Slots and documents are ranked in pieces of about this many rows, whose sums are then added up.
SLOT_PIECE, DOC_PIECE = 4096, 128
_GOLDEN = (5**0.5 - 1) / 2


def sources(sized: DataFrame) -> DataFrame:
    """One row per source (null last): sid, source, source_size, weight and its target by water filling.

    Targets are in proportion to the weights; one above PASSES times its source's size stops there and
    the excess is shared among the others by weight until none is above.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "sid")
    one = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("sid", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * PASSES)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    all_words = F.sum("source_size").over(Window.partitionBy())
    rest = one.withColumn("words", all_words).withColumn("full", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)))
    rest = rest.withColumn("open", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    level = (SHARE * F.col("words") - F.coalesce("full", F.lit(0))) / F.col("open")
    rest = rest.withColumn("level", F.when(level <= F.col("ratio"), level))
    level = F.max("level").over(Window.partitionBy())
    target = F.least(F.coalesce(level * F.col("weight"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    block = F.greatest(F.lit(1), F.ceil(F.col("source_size") / BLOCKS)).cast("bigint")
    return (
        rest.withColumn("target", target)
        .withColumn("block", block)
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block")).cast("bigint"))
        .withColumn("slots", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(F.lit(0.0)))
        .select("sid", "source", "source_size", "weight", "target", "block", "blocks", "slots")
    )


def _prefix(rows: DataFrame, group: str, piece: str, value: Column, name: str) -> DataFrame:
    """Sum of value over the earlier pieces of each group: one row per group and piece."""
    sums = rows.groupBy(group, piece).agg(value.alias("_v"))
    before = Window.partitionBy(group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, piece, F.coalesce(F.sum("_v").over(before), F.lit(0)).cast("bigint").alias(name))


def schedule(spark: SparkSession, by_source: DataFrame, cells: int, slots: int) -> DataFrame:
    """slot, sid, rank: golden-ratio points mapped through the cumulative slot weights, ranked per source.

    The unit interval is cut into cells so that points find their source by an equality join.
    """
    upto = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("slots").over(Window.partitionBy())
    spans = (
        by_source.where("slots > 0")
        .withColumn("hi", F.least(F.sum("slots").over(upto) / whole, F.lit(1.0)))
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("sid")), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("sid").over(Window.orderBy("sid")).isNull(), F.lit(1.0)).otherwise(F.col("hi")))
        .select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    )
    low, high = 1 << 16, (_GOLDEN * (1 << 16)) % 1
    point = (F.expr(f"id div {low}") * F.lit(high) + (F.col("id") % low) * F.lit(_GOLDEN) + F.lit(0.5)) % 1.0
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * cells))
    placed = points.join(spans, "cell").where("x >= lo AND x < hi").select("slot", "sid", F.expr(f"slot div {SLOT_PIECE}").alias("piece"))
    inside = Window.partitionBy("sid", "piece").orderBy("slot")
    before = _prefix(placed, "sid", "piece", F.count(F.lit(1)), "before")
    ranked = placed.withColumn("n", F.row_number().over(inside)).join(before, ["sid", "piece"])
    return ranked.select("slot", "sid", (F.col("before") + F.col("n") - 1).alias("rank"))


def mix(docs: DataFrame, *keep: str, seed: int = 0) -> DataFrame:
    """Words that the mix takes of each document: doc_id, the columns in keep, size, source_size, target, taken.

    Each source's documents, in an order set by a hash of the id, the text and the seed, are cut into blocks of
    equal token counts (the last one shorter). Slot number r of a source takes its block r modulo the
    number of blocks, in at most PASSES passes, so that no document gives more than PASSES times its size.

    A null text has size 0; null sources form one source, ranked last; repeated rows and equal ids
    are documents of their own; documents without words take 0; an empty table gives no rows; columns in keep pass
    through, but those named as one of the result's own are left out; other columns are ignored. Reruns agree,
    however the rows are dealt out.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "mix")
    keep = [k for k in keep if k.lower() not in ("doc_id", "size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    kept = [F.col(k).alias(f"kept{i}") for i, k in enumerate(keep)]
    text = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("text").isNull(), F.lit(seed))
    rows = docs.select("doc_id", *kept, F.col("source"), size.alias("size"), text.alias("content"))
    rows = rows.withColumn("order", F.xxhash64("doc_id", "content")).withColumn("row", F.monotonically_increasing_id())
    sized = work.keep(rows, "sized")
    named = sized.select("source", "size", "doc_id", "order", "content", "row")
    by_source = work.keep(sources(named).coalesce(1), "sources")
    total = by_source.agg(F.count(F.lit(1)), F.sum("slots"), F.sum("source_size")).first()
    n_docs = named.count()
    if total[1]:
        slots, cells = max(1, round(total[1])), 1 << max(10, (4 * total[0]).bit_length())
        takes = schedule(spark, by_source, cells, slots).join(by_source.select("sid", "blocks"), "sid")
        takes = takes.where(F.col("rank") < PASSES * F.col("blocks")).groupBy("sid", (F.col("rank") % F.col("blocks")).alias("at")).agg(F.count(F.lit(1)).alias("times"))
        pieces = min(1 << 16, max(1, n_docs // DOC_PIECE))
        placed = named.where("size > 0").join(by_source, named.source.eqNullSafe(by_source.source)).select("row", "doc_id", "order", "content", "size", "sid", "block", F.pmod(F.xxhash64("order"), F.lit(pieces)).alias("piece"))
        inside = Window.partitionBy("sid", "piece").orderBy("order", "doc_id", "content", "row")  # rows that tie before the last are equal
        placed = placed.withColumn("end", F.sum("size").over(inside)).join(_prefix(placed, "sid", "piece", F.sum("size"), "before"), ["sid", "piece"])
        placed = placed.withColumn("end", F.col("before") + F.col("end")).withColumn("start", F.col("end") - F.col("size"))
        parts = placed.select("row", "sid", "block", "start", "end", F.explode(F.expr("sequence(start div block, (end - 1) div block)")).alias("at"))
        words = F.least("end", (F.col("at") + 1) * F.col("block")) - F.greatest("start", F.col("at") * F.col("block"))
        taken = parts.join(takes, ["sid", "at"]).groupBy("row").agg(F.sum(words * F.col("times")).alias("taken"))
        found = sized.join(taken, "row", "left")
    else:
        found = sized.withColumn("taken", F.lit(None).cast("bigint"))
    facts = by_source.select(F.col("source").alias("name"), "source_size", "target")
    result = found.join(facts, found["source"].eqNullSafe(facts["name"]))
    return result.select("doc_id", *(F.col(f"kept{i}").alias(k) for i, k in enumerate(keep)), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
