"""Connected components and candidate buckets, as DataFrame steps without any per-group collection."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlake.llm.common import Workspace

#: Members of a bucket that the second round compares with all its others (the first: one), and the factor from round to round.
LEADERS, GROWTH = 8, 16
#: Buckets of more members than this are split into narrower ones after the first round, where an operator has samples for that.
HOT = 32
#: Members of a bucket that one component has from which it counts as a crowd, and the pairs of such members with others that are too many to meet.
CROWD, MANY = 32, 100_000


class Closer(NamedTuple):
    """facts joins the facts that classes() has and further columns to rows with a node; near is a condition like its possible, which may read bucket, too."""

    facts: Callable[[DataFrame], DataFrame]
    near: Callable[[str], Column]


def components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """node and root (the smallest node of its component) for every node of the links a - b.

    Labels go to the smallest label of the neighbours and then to that label's own label, until
    nothing changes: a number of rounds in proportion to the logarithm of the longest path. Each
    round is a written table. A node with very many links is met only in joins that the adaptive
    planner can split and in sums that are combined before the shuffle.
    """
    edges = work.keep(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).where("x <> y").distinct(), f"{name}-edges")
    labels = work.keep(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("root")), f"{name}-0")
    step = 0
    while True:
        step += 1
        roots = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = labels.join(roots, "root").select("node", F.col("root").alias("was"), F.col("above").alias("root"))
        near = edges.join(jumped.select(F.col("node").alias("y"), "root"), "y").groupBy("x").agg(F.min("root").alias("m"))
        found = jumped.join(near, jumped.node == near.x).select("node", "was", F.least("root", "m").alias("root"))
        found = work.keep(found, f"{name}-{step}")
        changed = found.where("root <> was").limit(1).count()
        work.drop(f"{name}-{step - 1}")
        labels = found.select("node", "root")
        if not changed:
            return labels


def classes(
    work: Workspace,
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], DataFrame] | None = None,
    facts: DataFrame | None = None,
    possible: Callable[[str], Column] | None = None,
    small: int = 0,
    gather: Callable[[DataFrame], DataFrame] | None = None,
    closer: Closer | None = None,
) -> DataFrame:
    """node and root for the nodes that verified links join; nodes without links are left out.

    members holds bucket and node, each pair of the two once. Only pairs that share a bucket are verified, and a
    bucket's pairs are not all listed: each round compares a bucket's leaders with its other members of
    other components, then retires them. The first round's leader is the smallest node, found by a sum
    that is combined before the shuffle; later ones are drawn by a hash of the node whose limit follows
    from the bucket's size, so no bucket is ever ranked or gathered in one place. A bucket is done when
    its remaining members are in one component, so every pair of a bucket ends up either verified or
    inside one component: no link between components is lost, whatever the size. A group of copies is
    done after the first round or two; only members that are not similar need the later ones, whose
    leaders are GROWTH times as many. verify takes pairs a < b and returns those that are links. refine,
    if given, takes the members (bucket, node) of buckets that more than HOT members leave open after the
    first round and returns them in narrower buckets, in which similar members meet again. possible, if given,
    is a condition on columns of facts (one row a node) and on the same columns of a leader, under the prefix that
    it is called with; it may be false only for pairs that verify would not return. With small, members has the columns
    of facts, too: the first round then compares all pairs of the buckets of at most that many members, which are done
    with it, and possible applies in that round already; closer has a further condition for all later rounds, and adds the columns that
    it needs to facts; the second round's leaders are 256 times small, as possible is cheap.
    Where large components meet many other members, that round would list nearly all pairs of a group: with gather, which takes pairs
    and returns some of the links among them at little cost, a few leaders are tried before it, again and again while that
    leaves less than half of those pairs. This retires nobody, so that it only joins earlier what later rounds would join.
    """
    columns = [c for c in facts.columns if c != "node"] if facts is not None else []

    def opened(left: DataFrame, name: str) -> DataFrame | None:
        """bucket, node, root and n, the bucket's size, of the buckets that are not in one component."""
        now = left.withColumn("root", F.col("node"))
        if labels is not None:
            known = labels.select("node", F.col("root").alias("to"))
            now = left.join(known, "node", "left").select("bucket", "node", F.coalesce("to", "node").alias("root"))
        now = work.keep(now, f"now-{name}")
        open_ = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
        still = work.keep(now.join(open_.select("bucket", "n"), "bucket"), f"still-{name}")
        work.drop(f"now-{name}")
        return None if still.isEmpty() else still

    def drawn(leaders: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) * F.col("n") < F.lit(leaders << 30)

    def meet(still: DataFrame, draw: Column) -> DataFrame:
        """a < b: the leaders, with the members of other components in their buckets; two leaders of a bucket meet once."""
        if closer is not None:
            still = closer.facts(still)
        elif facts is not None:
            still = still.join(facts, "node")
        names = [c for c in still.columns if c not in ("bucket", "node", "n")]
        lead = still.where(draw).select("bucket", F.col("node").alias("leader"), *(F.col(c).alias(f"leader_{c}") for c in names))
        pairs = still.join(lead, "bucket").where("root <> leader_root").where(~draw | (F.col("leader") < F.col("node")))
        if possible is not None:
            pairs = pairs.where(possible("leader_"))
        if closer is not None:
            pairs = pairs.where(closer.near("leader_"))
        return pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    def joined(links: DataFrame, name: str) -> DataFrame | None:
        """The labels, with these links."""
        if links.isEmpty():
            return labels
        if labels is not None:
            links = links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
        return components(work, links, f"labels-{name}")

    def crowded(still: DataFrame) -> int:
        """Pairs of members of large components with the others of their buckets."""
        parts = still.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")).where(F.col("m") >= CROWD)
        return parts.agg(F.coalesce(F.sum(F.col("m") * (F.col("n") - F.col("m"))), F.lit(0))).first()[0]

    ends = (F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = work.keep(members.groupBy("bucket").agg(*ends).where("lo < hi").select("bucket", "lo", "n"), "shared")
    if small:
        left = work.keep(members.join(shared, "bucket"), "left-0")
        lead = left.where((F.col("n") <= small) | (F.col("node") == F.col("lo")))
        lead = lead.select("bucket", F.col("node").alias("leader"), *(F.col(c).alias(f"leader_{c}") for c in columns))
        pairs = left.join(lead, "bucket").where("leader < node").where(possible("leader_"))
        pairs = pairs.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        left = left.where((F.col("n") > small) & (F.col("node") != F.col("lo")))
    else:
        left = work.keep(members.join(shared, "bucket").where("node <> lo").drop("n"), "left-0")
        pairs = left.select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct()
    work.drop("shared")
    left, labels, step, leaders = left.select("bucket", "node"), None, 0, max(LEADERS, 256 * small)
    while True:
        pairs = work.keep(pairs, f"pairs-{step}")
        links = work.keep(verify(pairs), f"links-{step}")
        labels = joined(links, f"{step}")
        still = opened(left, f"{step}")
        if still is not None and step == 0 and refine is not None:
            narrow = refine(still.where(F.col("n") > HOT).select("bucket", "node"))
            still = opened(work.keep(still.where(F.col("n") <= HOT).select("bucket", "node").unionByName(narrow), "narrow"), "narrow")
        if still is None:
            return labels if labels is not None else left.select("node", F.col("node").alias("root")).limit(0)
        last, turn = crowded(still) if gather is not None and step == 0 else 0, 0
        while last > MANY:
            turn += 1
            met = work.keep(meet(still, drawn(LEADERS, -turn)), f"met-{turn}")
            found = joined(work.keep(gather(met), f"gathered-{turn}"), f"gathered-{turn}")
            work.drop(f"met-{turn}")
            if found is labels:
                break
            labels = found
            again = opened(left, f"gathered-{turn}")
            work.drop(f"still-gathered-{turn - 1}")
            if again is None:
                return labels
            still, before, last = again, last, crowded(again)
            if 2 * last > before:
                break
        draw = drawn(leaders, step)
        pairs = meet(still, draw)
        for table in (f"left-{step}", "narrow", f"pairs-{step}", f"still-{step - 1}"):
            work.drop(table)
        left = still.where(~draw).select("bucket", "node")
        step, leaders = step + 1, leaders * GROWTH
