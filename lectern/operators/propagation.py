"""What nodes can reach, summed up in a row a node: maxima pushed against the edges until nothing changes.

A value that only grows (a flag, a maximum) is the same for a node and all that lie on a cycle with it, and takes the
largest of what its successors have; so it can be pushed from node to node without telling who reaches whom. The work is
the edges times the rounds, not the pairs of nodes.

Long chains would take a round a step. If some rounds don't settle a graph, its nodes with one successor are folded: each
points at where its chain ends, with the maxima over what lies between, by doubling, in the logarithm of the chain's
length. Rounds are then needed for the nodes with several successors alone. Each round is one table in the shared folder;
only whether something changed comes to the driver.

Defined cases: an edge's end that isn't among the values counts as a node without any; a null value is none; self-loops and
parallel edges change nothing; nodes that are given twice have the larger values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def _largest(a: Column, b: Column) -> Column:
    return F.greatest(a, b)  # a null is passed over


def reach_max(values: DataFrame, edges: DataFrame, columns: list[str], rounds: int = 8) -> DataFrame:
    """(node_id, columns): the largest value of each column over all nodes that a node reaches along edges (src, dst),
    itself included. values: (node_id, columns). After so many rounds chains are folded."""
    links = written(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    none = [F.lit(None).cast(values.schema[c].dataType).alias(c) for c in columns]
    ends = links.select(F.explode(F.array("src", "dst")).alias("node_id"), *none)
    own = values.select("node_id", *columns).unionByName(ends).groupBy("node_id").agg(F.lit(True).alias("fresh"), *[F.max(c).alias(c) for c in columns])
    state, settled = _settled(written(own, "state"), links, columns, rounds)
    return state.select("node_id", *columns) if settled else _past_chains(state.drop("fresh"), links, columns)


def _past_chains(own: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """reach_max for values that are known of every node."""
    chains = _folded(own, links, columns)
    after = chains.select(F.col("node_id").alias("dst"), F.col("next"), "ended", *[F.col(c).alias(f"_{c}") for c in columns])
    # the other nodes' edges, past the chains: what lies on a chain goes to the node before it
    core = written(links.join(chains.select(F.col("node_id").alias("src")), "src", "left_anti").join(after, "dst", "left"), "core")
    passed = core.groupBy(F.col("src").alias("node_id")).agg(*[F.max(f"_{c}").alias(f"_{c}") for c in columns])
    state = own.join(chains.select("node_id"), "node_id", "left_anti").join(passed, "node_id", "left")
    state = state.select("node_id", F.lit(True).alias("fresh"), *[_largest(F.col(c), F.col(f"_{c}")).alias(c) for c in columns])
    steps = core.where("next IS NULL OR ended").select("src", F.coalesce("next", "dst").alias("dst")).where("src <> dst").distinct()
    settled, _ = _settled(written(state, "state"), written(steps, "steps"), columns)
    ahead = settled.select(F.col("node_id").alias("next"), *[F.col(c).alias(f"_{c}") for c in columns])
    closed = chains.where("NOT ended").select("node_id", *columns)
    open_ = chains.where("ended").join(ahead, "next", "left").select("node_id", *[_largest(F.col(c), F.col(f"_{c}")).alias(c) for c in columns])
    return settled.select("node_id", *columns).unionByName(open_).unionByName(closed)


def _folded(own: DataFrame, links: DataFrame, columns: list[str]) -> DataFrame:
    """(node_id, next, ended, columns) of the nodes with one successor: where the chain ends, and the maxima before it.

    ended is false where a chain leads into a cycle of such nodes: it goes round for good, and its maxima are all it has.
    """
    lone = links.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"), F.max("dst").alias("next")).where("n = 1").drop("n")
    chains = written(lone.join(own, "node_id").withColumn("ended", F.lit(False)), "chains")
    total, covered = chains.count(), 1
    while True:
        further = chains.select(F.col("node_id").alias("next"), F.col("next").alias("_next"), F.col("ended").alias("_ended"), *[F.col(c).alias(f"_{c}") for c in columns])
        # a node whose next one has several successors, or none, has reached the end
        moved = chains.where("NOT ended").join(further, "next", "left")
        moved = moved.select("node_id", F.coalesce("_next", "next").alias("next"), F.coalesce("_ended", F.lit(True)).alias("ended"), *[_largest(F.col(c), F.col(f"_{c}")).alias(c) for c in columns])
        chains = written(chains.where("ended").select("node_id", "next", "ended", *columns).unionByName(moved), "chains")
        covered *= 2
        if covered > total or chains.where("NOT ended").isEmpty():
            return chains


def _settled(state: DataFrame, steps: DataFrame, columns: list[str], rounds: int | None = None) -> tuple[DataFrame, bool]:
    """state after as many rounds as it takes, or rounds of them, and whether it is settled; a round takes up only what the
    one before changed."""
    while rounds is None or rounds > 0:
        fresh = state.where("fresh").select(F.col("node_id").alias("dst"), *columns)
        told = steps.join(fresh, "dst").groupBy(F.col("src").alias("node_id")).agg(*[F.max(c).alias(f"_{c}") for c in columns])
        grown = [F.col(f"_{c}").isNotNull() & (F.col(c).isNull() | (F.col(f"_{c}") > F.col(c))) for c in columns]
        fresh = F.coalesce(reduce(Column.__or__, grown), F.lit(False)).alias("fresh")
        state = written(state.join(told, "node_id", "left").select("node_id", fresh, *[_largest(F.col(c), F.col(f"_{c}")).alias(c) for c in columns]), "state")
        if state.where("fresh").isEmpty():
            return state, True
        rounds = rounds and rounds - 1
    return state, False
