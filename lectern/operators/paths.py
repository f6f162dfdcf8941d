"""Paths with a purpose: the strongest by confidence, all that lead to a target, and the first that a depth-first walk takes."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .graph import Graph, methodology_components
from .propagation import reach_max


def strongest_paths(edges: DataFrame, starts: DataFrame, default: float = 0.5, width: float = 1.0) -> DataFrame:
    """(start, node_id, strength, hops, via): of each start (node_id) and each node that it leads to, the path over edges
    (src, dst, confidence) whose confidences have the largest product; of equal ones the one with the fewest edges, then
    the smallest last node before it (via).

    Found by relaxation in buckets of the path's cost, the negative logarithm of its strength: only nodes of the cheapest
    bucket that isn't settled are followed, until it is, so a node is rarely followed over a path that isn't its best.
    A bucket is width wide. One join a round; one number a round comes to the driver.

    A null confidence counts as default; one of 0 or less is no edge, one above 1 counts as 1, so cycles never pay.
    """
    sure = F.least(F.coalesce("confidence", F.lit(default)), F.lit(1.0))
    steps = edges.select("src", "dst", sure.alias("step")).where("step > 0").groupBy("src", "dst").agg(F.max("step").alias("step"))
    steps = written(steps, "steps")
    start = starts.select(F.col("node_id").alias("start"), "node_id", F.lit(1.0).alias("strength"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via"))
    state = written(start.distinct().withColumn("fresh", F.lit(True)), "strengths")
    better = F.struct((-F.col("strength")).alias("cost"), "hops", "via", ~F.col("fresh"))
    while True:
        least = state.where("fresh").agg(F.max("strength")).first()[0]
        if least is None:
            return state.where("hops > 0").select("start", "node_id", "strength", "hops", "via")
        limit = min(math.exp(-width * (math.floor(-math.log(least) / width) + 1)), least * (1 - 1e-9))
        active = F.col("fresh") & (F.col("strength") > limit)
        ahead = state.where(active).join(steps, F.col("node_id") == F.col("src"))
        ahead = ahead.select("start", F.col("dst").alias("node_id"), (F.col("strength") * F.col("step")).alias("strength"), (F.col("hops") + 1).alias("hops"), F.col("node_id").alias("via"), F.lit(True).alias("fresh"))
        both = state.withColumn("fresh", F.col("fresh") & ~active).unionByName(ahead)
        # of a path that is as good as the one known the known one stays, and isn't followed again
        state = written(both.groupBy("start", "node_id").agg(F.min_by(F.struct("strength", "hops", "via", "fresh"), better).alias("best")).select("start", "node_id", "best.*"), "strengths")


def paths_between(edges: DataFrame, pairs: DataFrame, longest: int = 4) -> DataFrame:
    """(start, target, path array): the simple paths of 1 to longest edges from start to target, for each of the pairs.

    Searched from both ends: first back from the targets, for the edges that each target can be reached by and how far from
    it they end, then ahead from the starts, over these edges of the path's own target, as long as it can still get there
    with the edges that are left. So no path is held that comes to nothing but by meeting itself, and a node that many
    targets lie behind gives a path only the edges to its own.
    """
    steps = written(edges.select("src", "dst").where("src <> dst").distinct(), "steps")
    pairs = written(pairs.select("start", "target").where("start <> target").distinct(), "pairs")
    near = fresh = written(pairs.select("target", F.col("target").alias("node_id")).distinct(), "near")
    ways = None
    for away in range(longest):
        last = away == longest - 1  # an edge this far off is a path's first one
        used = steps.join(pairs.select(F.col("start").alias("src")).distinct(), "src", "left_semi") if last else steps
        back = fresh.join(used, F.col("node_id") == F.col("dst")).where("src <> target").select("target", "src", "dst", F.lit(away).alias("away"))
        back = written(back.join(pairs.withColumnRenamed("start", "src"), ["target", "src"], "left_semi") if last else back, "ways")
        ways = back if ways is None else ways.unionByName(back)
        if not last:
            fresh = written(back.select("target", F.col("src").alias("node_id")).distinct().join(near, ["target", "node_id"], "left_anti"), "near")
            near = near.unionByName(fresh)
    ahead = pairs.select("start", "target", F.array("start").alias("path"))
    out = None
    for n in range(1, longest + 1):
        left = ways.where(F.col("away") <= longest - n)
        grown = ahead.withColumn("src", F.element_at("path", -1)).join(left, ["target", "src"]).where(~F.array_contains("path", F.col("dst")))
        grown = written(grown.select("start", "target", F.concat("path", F.array("dst")).alias("path"), (F.col("away") == 0).alias("there")), "paths")
        there = grown.where("there").drop("there")
        out = there if out is None else out.unionByName(there)
        ahead = grown.where("NOT there").drop("there")
    return out


def paths_to(graph: Graph, start: str, target: str, longest: int = 4) -> DataFrame:
    """paths_between of one pair of nodes."""
    pair = graph.nodes.where(F.col("node_id") == target).select(F.lit(start).alias("start"), F.col("node_id").alias("target"))
    return paths_between(graph.edges, pair, longest)


def first_visits(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node_id, place, depth, parent): the nodes in the order in which a depth-first walk from the starts (node_id), by
    name, first meets them, over edges (src, dst, ord) by ord and dst; and from where, how deep.

    What is met first depends on what was met before, but only within nodes that are joined by edges, whatever their
    direction: each such component is walked in one task, on its edges alone. place counts within a component; roots come
    by name.
    """
    links = edges.select("src", "dst", "ord").where("src IS NOT NULL AND dst IS NOT NULL")
    ways = links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    names = starts.select("node_id").unionByName(links.select(F.explode(F.array("src", "dst")).alias("node_id"))).distinct()
    parts = written(reach_max(names.withColumn("component", F.col("node_id")), ways, ["component"]), "components")
    rows = links.join(parts.withColumnRenamed("node_id", "src"), "src").select("component", "src", "dst", "ord")
    begin = starts.select("node_id").distinct().join(parts, "node_id").select("component", F.lit(None).cast("string").alias("src"), F.col("node_id").alias("dst"), F.lit(None).cast("bigint").alias("ord"))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        is_start = rows["src"].isna()
        ahead: dict[str, list[str]] = {}
        for src, dst in rows[~is_start].sort_values(["ord", "dst"], kind="stable")[["src", "dst"]].itertuples(index=False):
            ahead.setdefault(src, []).append(dst)
        met: dict[str, tuple[int, str | None]] = {}
        for root in sorted(rows["dst"][is_start]):
            stack = [(root, 0, None)]
            while stack:
                node, depth, parent = stack.pop()
                if node not in met:
                    met[node] = (depth, parent)
                    stack += [(to, depth + 1, node) for to in reversed(ahead.get(node, ())) if to not in met]
        found = pd.DataFrame({"node_id": list(met), "place": range(len(met)), "depth": [d for d, _ in met.values()], "parent": [p for _, p in met.values()]})
        return found.astype({"node_id": object, "parent": object})

    return rows.unionByName(begin).groupBy("component").applyInPandas(walk, "node_id string, place int, depth int, parent string")


def first_visit_phases(graph: Graph) -> DataFrame:
    """(node_id, phase): as methodology_phases, but a node's phase is the depth at which a walk first meets it, not the
    least one."""
    flow = graph.edges_of("MethodologyFlow")
    starts = methodology_components(graph).join(flow.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    return first_visits(flow, starts).select("node_id", F.col("depth").alias("phase"))
