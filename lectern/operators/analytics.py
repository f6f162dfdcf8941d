"""Analyses of a document graph, each a DataFrame. Ties are broken by key, so that results don't depend on order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..sources.tables import written
from .graph import Graph, grown
from .numbering import numbered
from .propagation import reach_max


def _without(graph: Graph, nodes: DataFrame, *types: str) -> DataFrame:
    """The nodes without an outgoing edge of the types."""
    return nodes.join(graph.edges_of(*types).select(F.col("src").alias("node_id")), "node_id", "left_anti")


# --- centrality -------------------------------------------------------------------------------------------------------


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6, each: int = 5) -> DataFrame:
    """(node_id, score): every edge counts, parallel ones too; what reaches a node without outgoing edges is lost.

    A node that no edge points to has one score after every round, so what it gives is summed once (fed, a row a node). A
    node without outgoing edges gives nothing, so its score is worked out once, after the last round. The rounds go over
    the rest, the core. Edges from it are dealt out by source once and kept, so a round shuffles only the flows, summed by
    task first; a lost part is read again from the written table. Every few rounds the core's scores are written to the
    shared folder; then, and only then, the L1 change of all nodes' scores is looked at (tolerance None: never), from
    round 3 on, when only the core's scores move.
    """
    n = graph.nodes.count()
    parts = int(graph.nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, rest = (1.0 / n, (1 - damping) / n) if n else (0.0, 0.0)
    ids = graph.nodes.select("node_id")
    if not iterations:
        return ids.withColumn("score", F.lit(first))
    pointed = graph.edges.select(F.col("dst").alias("pointed")).distinct()
    marked = ids.join(pointed, F.col("node_id") == F.col("pointed"), "left").select(F.col("node_id").alias("src"), F.col("pointed").isNotNull().alias("live"))
    weighted = graph.edges.select("src", "dst").repartition("src").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k"))
    weighted = weighted.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy("src")))
    weighted = written(weighted.join(marked, "src").select("src", "dst", "share", "live"), "shares")
    fed = written(weighted.where("NOT live").groupBy("dst").agg(F.sum("share").alias("fed")), "fed")
    core = weighted.where("live").select(F.col("src").alias("node_id")).distinct()
    core = written(core.join(fed, F.col("node_id") == F.col("dst"), "left").select("node_id", F.coalesce("fed", F.lit(0.0)).alias("fed")), "core")
    inner = core.select(F.col("node_id").alias("end"))
    live = weighted.where("live").join(inner, F.col("dst") == F.col("end"), "left").select("src", "dst", "share", F.col("end").isNotNull().alias("inner"))
    live = live.repartition(parts, "src").persist()
    core = core.repartition(parts, "node_id").persist()

    def flow(edges: DataFrame, scores: DataFrame) -> DataFrame:
        return edges.join(scores, edges["src"] == scores["node_id"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("flow"))

    def score(fed: Column, given: float) -> Column:
        return F.lit(rest) + damping * (F.coalesce(fed, F.lit(0.0)) * given + F.coalesce("flow", F.lit(0.0)))

    before = scores = core.select("node_id", F.lit(first).alias("score"))
    alone = core.isEmpty()
    k = min(iterations, 2) if alone else 1  # without a core nothing moves after round 2
    while k < iterations and not alone:  # round k of all nodes goes by the core's scores of the round before
        if tolerance is not None and k >= 3 and k % each == 0:
            moved = scores.join(before.withColumnRenamed("score", "old"), "node_id").select("node_id", (F.col("score") - F.col("old")).alias("score"))
            if damping * (flow(live, moved).agg(F.sum(F.abs("flow"))).first()[0] or 0.0) < tolerance:
                break
        along = flow(live.where("inner"), scores)
        before, scores = scores, core.join(along, core["node_id"] == along["dst"], "left").select(core["node_id"], score(core["fed"], first if k == 1 else rest).alias("score"))
        k += 1
        if k % each == 0 or k == iterations or (tolerance is not None and (k + 1) % each == 0):
            scores = written(scores, "scores")
    along = written(flow(live, scores), "flow")
    live.unpersist()
    core.unpersist()
    whole = ids.join(fed, ids["node_id"] == fed["dst"], "left").join(along, ids["node_id"] == along["dst"], "left")
    return whole.select(ids["node_id"], score(fed["fed"], first if k == 1 else rest).alias("score"))


def ranked(graph: Graph, digits: int = 12, **options) -> DataFrame:
    """(node_id, score, place): nodes by importance; scores that agree in so many digits are ties, by node_id."""
    scores = pagerank(graph, **options).withColumn("score", F.round("score", digits))
    placed = numbered(scores, F.col("score").desc(), "node_id")
    return placed.select("node_id", "score", (F.col("index") + 1).alias("place"))


def bridging(graph: Graph, scores: DataFrame, cut: float = 0.5) -> DataFrame:
    """(node_id, score, types, degree, bridge): score times distinct neighbour types times degree over nodes, above cut."""
    n = graph.nodes.count()
    kind = graph.nodes.select(F.col("node_id").alias("other"), "node_type")
    ends = graph.edges.select(F.col("src").alias("node_id"), F.col("dst").alias("other")).unionByName(graph.edges.select(F.col("dst").alias("node_id"), F.col("src").alias("other")))
    around = ends.join(kind, "other").groupBy("node_id", "node_type").agg(F.count(F.lit(1)).alias("k")).groupBy("node_id").agg(F.count(F.lit(1)).alias("types"), F.sum("k").alias("degree"))
    out = scores.join(around, "node_id").withColumn("bridge", F.col("score") * F.col("types") * (F.col("degree") / F.lit(float(max(n, 1)))))
    return out.where(F.col("bridge") > cut)


# --- components -------------------------------------------------------------------------------------------------------


def strongly_connected(graph: Graph) -> DataFrame:
    """(node_id, component): the smallest node of the strongly connected component.

    Colouring: each open node takes the largest id that reaches it; a colour's own node, and what it is reached from
    within the colour, is a component. Nodes without an open edge in or out are alone and leave before each round.
    """
    edges = written(graph.edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    open_ = written(graph.nodes.select("node_id").distinct(), "scc")
    parts: list[DataFrame] = []
    while True:  # every round settles a component or sheds nodes
        inner = edges.join(open_.withColumnRenamed("node_id", "src"), "src", "left_semi").join(open_.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
        inner = written(inner, "scc")
        live = open_.join(inner.select(F.col("src").alias("node_id")), "node_id", "left_semi").join(inner.select(F.col("dst").alias("node_id")), "node_id", "left_semi")
        live = written(live, "scc")
        parts.append(open_.join(live, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component")))
        if live.isEmpty():
            break
        if live.count() < open_.count():
            open_, edges = live, inner
            continue
        colour = live.withColumn("colour", F.col("node_id"))
        while True:
            along = inner.join(colour, inner["src"] == colour["node_id"]).groupBy("dst").agg(F.max("colour").alias("seen"))
            after = written(colour.join(along, colour["node_id"] == along["dst"], "left").select("node_id", F.greatest("colour", F.coalesce("seen", "colour")).alias("colour")), "scc")
            moved = after.join(colour.withColumnRenamed("colour", "old"), "node_id").where("colour <> old").isEmpty()
            colour = after
            if moved:
                break
        same = inner.join(colour.select(F.col("node_id").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node_id").alias("dst"), F.col("colour").alias("b")), "dst").where("a = b")
        back = same.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        heads = colour.where("node_id = colour").select(F.col("colour"), "node_id")
        found = written(grown(heads, back, ["colour"]).select("node_id", "colour"), "scc")
        smallest = found.groupBy("colour").agg(F.min("node_id").alias("component"))
        parts.append(found.join(smallest, "colour").select("node_id", "component"))
        open_, edges = written(live.join(found, "node_id", "left_anti"), "scc"), inner
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- texts ------------------------------------------------------------------------------------------------------------


def topic_distribution(nodes: DataFrame) -> DataFrame:
    """(word, n, share) of the words of more than three bytes in texts, math and environments."""
    said = nodes.where(F.col("node_type").isin("Text", "Math", "Environment"))
    counted = said.select(F.explode(text.long_words(F.col("content"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("word", "n", (F.col("n") / counted.agg(F.sum("n")).scalar()).alias("share"))


def key_themes(graph: Graph) -> DataFrame:
    """(word, weight, contexts, score): words by weight of the nodes and edges they are in and by distinct contexts.

    A node's words count once, A-Z folded. Its weight is its type's times one factor for each outgoing edge of some types;
    its context is all its targets' contents. The heaviest word scores 1 before contexts.
    """
    factor = fixed.lookup(fixed.THEME_EDGE_WEIGHTS, F.col("edge_type"), F.lit(1.0))
    target = graph.nodes.select(F.col("node_id").alias("dst"), F.split(F.col("content"), " ", -1).alias("said"))
    # a context is all targets' words in order; two are equal if every place has the same word, so that the hashes of
    # (place, word) can be folded one by one and no source's contents ever stand in one row
    before = Window.partitionBy("src").orderBy("ord", "dst", "said").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("said").isNull(), 0).otherwise(F.size("said"))
    placed = graph.edges.join(target, "dst").withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")))
    fold = lambda seed: F.aggregate(F.transform("said", lambda w, i: F.xxhash64(F.lit(seed), F.col("at") + i, w)), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
    around = placed.select("src", factor.alias("factor"), fold(1).alias("h1"), fold(2).alias("h2")).groupBy("src")
    around = around.agg(F.exp(F.sum(F.log("factor"))).alias("factor"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    around = around.select(F.col("src").alias("node_id"), "factor", F.when(F.col("h1").isNotNull(), F.xxhash64("h1", "h2")).alias("context"))
    weight = fixed.lookup(fixed.THEME_NODE_WEIGHTS, F.col("node_type"), F.lit(1.0))
    said = graph.nodes.where(~F.col("node_type").isin("Math", "Command")).join(around, "node_id", "left")
    said = said.select((weight * F.coalesce("factor", F.lit(1.0))).alias("weight"), F.coalesce("context", F.lit(0).cast("long")).alias("context"), F.explode(F.array_distinct(text.long_words(text.ascii_lower(F.col("content"))))).alias("word"))
    # first by word and context, so that the distinct count needs no second copy of the rows
    by_context = said.groupBy("word", "context").agg(F.sum("weight").alias("weight"))
    summed = by_context.groupBy("word").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("contexts"))
    heaviest = summed.agg(F.max("weight")).scalar()
    return summed.select("word", "weight", "contexts", ((F.col("weight") / heaviest) * (1 + F.log(1 + F.col("contexts")))).alias("score"))


def concept_hierarchy(graph: Graph) -> DataFrame:
    """(concept, depends_on): contents joined by ConceptDependency or Definition, each pair once."""
    lifted = Graph(graph.nodes, graph.edges_of("ConceptDependency", "Definition")).both("content")
    return lifted.select(F.col("src_content").alias("concept"), F.col("dst_content").alias("depends_on")).distinct()


def similar_nodes(nodes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity): nodes whose word sets have a Jaccard similarity of the threshold or more.

    Exact, by prefixes: of each set the rarest words, so many that two similar sets share one; only nodes with a common
    word there are compared. Nodes of equal content stand for one another while pairs are sought.
    """
    own = nodes.select("node_id", F.array_sort(F.array_distinct(text.words(text.ascii_lower(F.col("content"))))).alias("set")).where("size(set) > 0")
    groups = own.groupBy("set").agg(F.min("node_id").alias("rep"))
    groups = written(groups.withColumn("n", F.size("set")), "sets")
    words = groups.select("rep", "n", F.explode("set").alias("word"))
    often = words.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("often", "word"))
    prefix = words.join(often, "word").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = prefix.select("word", F.col("rep").alias("a"), F.col("n").alias("na"))
    right = prefix.select("word", F.col("rep").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, "word").where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("a", "b").distinct()
    sets = groups.select("rep", "set")
    scored = pairs.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb")), "b")
    return scored.select("a", "b", text.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)


def equal_nodes(nodes: DataFrame) -> DataFrame:
    """(node_id, rep): the node that stands for all of one word set in similar_nodes."""
    own = nodes.select("node_id", F.array_sort(F.array_distinct(text.words(text.ascii_lower(F.col("content"))))).alias("set")).where("size(set) > 0")
    reps = own.groupBy("set").agg(F.min("node_id").alias("rep"))
    return own.join(reps, "set").select("node_id", "rep")


# --- structure --------------------------------------------------------------------------------------------------------


def contributions(graph: Graph) -> DataFrame:
    """Targets of MainContribution, one row an edge."""
    return Graph(graph.nodes, graph.edges_of("MainContribution")).targets("node_type", "content").select("src", F.col("dst").alias("node_id"), F.col("dst_content").alias("content"))


def supporting_evidence(graph: Graph) -> DataFrame:
    """Targets of ResultSupports and EvidenceSupport, one row an edge."""
    return Graph(graph.nodes, graph.edges_of("ResultSupports", "EvidenceSupport")).targets("content").select("src", "edge_type", F.col("dst").alias("node_id"), F.col("dst_content").alias("content"))


def methodology_sections(graph: Graph) -> DataFrame:
    return graph.of_type("Section").where(text.contains_any(text.ascii_lower(F.col("content")), fixed.METHOD_SECTION))


def critical_assumptions(graph: Graph) -> DataFrame:
    """Targets of Assumption edges from texts, math and environments."""
    from_texts = Graph(graph.nodes, graph.edges_of("Assumption")).both("node_type", "content").where(F.col("src_node_type").isin("Text", "Math", "Environment"))
    return from_texts.select("src", F.col("dst").alias("node_id"), F.col("dst_content").alias("content"))


# --- citations --------------------------------------------------------------------------------------------------------


def citation_counts(graph: Graph) -> DataFrame:
    return graph.of_type("Citation").groupBy(F.col("content").alias("citation")).agg(F.count(F.lit(1)).alias("n"))


def top_citations(graph: Graph, k: int = 10) -> DataFrame:
    return citation_counts(graph).orderBy(F.col("n").desc(), "citation").limit(k)


def citation_contexts(graph: Graph) -> DataFrame:
    """(citation, context): contents of the texts that point to a citation, one row an edge."""
    joined = graph.both("node_type", "content").where("dst_node_type = 'Citation' AND src_node_type = 'Text'")
    return joined.select(F.col("dst_content").alias("citation"), F.col("src_content").alias("context"))


def citations_by_year(graph: Graph) -> DataFrame:
    """(year, citation): the distinct citations of each first year named in them."""
    dated = graph.of_type("Citation").select(text.year(F.col("content")).alias("y"), F.col("content").alias("citation")).where("y <> ''")
    return dated.select(F.col("y").cast("int").alias("year"), "citation").distinct()


# --- gaps and checks --------------------------------------------------------------------------------------------------


def research_gaps(graph: Graph) -> DataFrame:
    """(gap): explicit ones by Limitation and FutureWork, and sections without validation or comparison."""
    explicit = Graph(graph.nodes, graph.edges_of("Limitation", "FutureWork")).targets("content").select(F.concat(F.lit("Explicit gap: "), "dst_content").alias("gap"))
    section = graph.of_type("Section")
    missing = lambda kind, said: _without(graph, section, kind).select(F.concat(F.lit(said), "content").alias("gap"))
    return explicit.unionByName(missing("ValidationMethod", "Missing validation for section: ")).unionByName(missing("ComparisonLink", "Missing comparison analysis for: "))


def logical_gaps(graph: Graph) -> DataFrame:
    """(gap): nodes that have the first edge of a pair and not the second, and sections that claim without support."""
    kinds = graph.edges.groupBy(F.col("src").alias("node_id")).agg(F.collect_set("edge_type").alias("kinds"))
    having = graph.nodes.join(kinds, "node_id")
    out = None
    for first, second, said in fixed.LOGICAL_PAIRS:
        open_ = having.where(F.array_contains("kinds", first) & ~F.array_contains("kinds", second))
        rows = open_.select(F.concat(F.lit(f"{said} in: "), "content").alias("gap"))
        out = rows if out is None else out.unionByName(rows)
    return out.unionByName(unsupported_claims(graph).select(F.concat(F.lit("Unsupported claim in section: "), "content").alias("gap")))


def unsupported_claims(graph: Graph) -> DataFrame:
    """Sections with a claim edge and no support edge."""
    claiming = graph.of_type("Section").join(graph.edges_of(*fixed.CLAIM_EDGES).select(F.col("src").alias("node_id")), "node_id", "left_semi")
    return _without(graph, claiming, "EvidenceSupport", "ResultSupports")


def methodology_completeness(graph: Graph) -> DataFrame:
    """(node_id, missing): sections on method, a row for each edge type they should have and don't; null if complete."""
    section = graph.of_type("Section").where(text.contains_any(text.ascii_lower(F.col("content")), fixed.COMPLETE_METHOD_SECTION)).select("node_id")
    kinds = graph.edges_of(*fixed.METHODOLOGY_NEEDS).groupBy(F.col("src").alias("node_id")).agg(F.collect_set("edge_type").alias("kinds"))
    need = F.array(*map(F.lit, fixed.METHODOLOGY_NEEDS))
    missing = F.array_except(need, F.coalesce("kinds", F.array().cast("array<string>")))
    return section.join(kinds, "node_id", "left").select("node_id", F.explode_outer(missing).alias("missing"))


def evidence_chains(graph: Graph, labels: int = 4) -> DataFrame:
    """(claim, evidence, results, validation, linked): whether what a claim leads to holds each kind of evidence edge.

    linked: everything in the claim's closure can be reached from it by EvidenceSupport alone.

    Flags are pushed from node to node, a row a node, whatever the number of claims (reach_max). So are the largest of
    some random labels, over all evidence edges and over EvidenceSupport alone: where two of a claim's differ, its
    closures do, and it isn't linked. A claim that meets no other edge than EvidenceSupport on its way is linked. Only
    the claims that neither decides are followed one by one.
    """
    evidence, hashes = fixed.EVIDENCE_EDGES, [f"label{i}" for i in range(labels)]
    flags = [F.max((F.col("edge_type") == kind).cast("int")).alias(kind) for kind in evidence]
    pairs = written(graph.edges_of(*evidence).groupBy("src", "dst").agg(*flags), "evidence")
    claims = graph.edges_of(*fixed.CLAIM_EDGES).select(F.col("src").alias("claim")).distinct()
    # both graphs in one go, their nodes told apart by a letter: all edges, and EvidenceSupport alone
    none = lambda *names: [F.lit(None).cast("int").alias(c) for c in names]
    node = lambda tag, end, *values: F.struct(F.concat(F.lit(tag), end).alias("node_id"), *values, *[F.xxhash64(end, F.lit(i)).alias(h) for i, h in enumerate(hashes)])
    beside = F.when((F.col("EvidenceSupport") == 0) & (F.col("src") != F.col("dst")), 1).alias("beside")
    of_all, of_direct = [F.col(k) for k in evidence] + none("beside"), none(*evidence) + [beside]
    both = F.array(node("a", "src", *of_all), node("d", "src", *of_direct), *[node(tag, "dst", *none(*evidence, "beside")) for tag in "ad"])
    link = lambda tag: F.struct(F.concat(F.lit(tag), "src").alias("src"), F.concat(F.lit(tag), "dst").alias("dst"))
    links = pairs.select(F.explode(F.array_compact(F.array(link("a"), F.when(F.col("EvidenceSupport") == 1, link("d"))))).alias("link")).select("link.*")
    reached = reach_max(pairs.select(F.explode(both).alias("node")).select("node.*"), links, [*evidence, "beside", *hashes])
    of = lambda tag: reached.where(F.col("node_id").startswith(tag)).withColumn("claim", F.substring("node_id", 2, 1 << 30))
    some_of = of("d").select("claim", "beside", *[F.col(h).alias(f"own_{h}") for h in hashes])
    differ = reduce(Column.__or__, [F.col(h) != F.col(f"own_{h}") for h in hashes])
    linked = F.when(F.col("beside").isNull(), True).when(differ, False)
    has = lambda kind: F.coalesce(F.col(kind) == 1, F.lit(False))
    judged = claims.join(of("a").drop("beside", "node_id"), "claim", "left").join(some_of, "claim", "left")
    judged = written(judged.select("claim", has("EvidenceSupport").alias("evidence"), has("ResultSupports").alias("results"), has("ValidationMethod").alias("validation"), linked.alias("linked")), "judged")
    open_ = judged.where("linked IS NULL").select("claim", F.col("claim").alias("node_id"))
    if open_.isEmpty():
        return judged
    closure = grown(open_, pairs, ["claim"]).select("claim", "node_id")
    direct = grown(open_, pairs.where("EvidenceSupport = 1"), ["claim"]).select("claim", "node_id")
    lost = closure.join(direct, ["claim", "node_id"], "left_anti").select("claim", F.lit(True).alias("lost")).distinct()
    return judged.join(lost, "claim", "left").select("claim", "evidence", "results", "validation", F.coalesce("linked", F.col("lost").isNull()).alias("linked"))


# --- relations that follow from the edges -----------------------------------------------------------------------------


def contradictions(graph: Graph) -> DataFrame:
    """(a, b): pairs joined by a CounterArgument edge, either way, once."""
    return graph.edges_of("CounterArgument").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def all_paths(graph: Graph, starts: DataFrame, longest: int = 4) -> DataFrame:
    """(start, path array): simple paths of 1 to longest edges from starts (node_id)."""
    steps = graph.edges.select("src", "dst").distinct()
    ahead = starts.select(F.col("node_id").alias("start"), F.array("node_id").alias("path"))
    out = None
    for _ in range(longest):
        ahead = ahead.join(steps, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        ahead = written(ahead.select("start", F.concat("path", F.array("dst")).alias("path")), "paths")
        out = ahead if out is None else out.unionByName(ahead)
    return out


def related_concepts(edges: DataFrame, concept: str, least: float = 0.5) -> DataFrame:
    """Neighbours of a concept over edges (src, dst, edge_type, confidence) of enough confidence, either way."""
    sure = edges.where(F.col("confidence") >= least)
    out = sure.where(F.col("src") == concept).select(F.col("dst").alias("node_id"), "edge_type", "confidence")
    return out.unionByName(sure.where(F.col("dst") == concept).select(F.col("src").alias("node_id"), "edge_type", "confidence"))


def related_to_each(edges: DataFrame, concepts: DataFrame, least: float = 0.5) -> DataFrame:
    """(concept, node_id, edge_type, confidence): related_concepts of each concept (concept)."""
    sure = edges.where(F.col("confidence") >= least)
    out = sure.select(F.col("src").alias("concept"), F.col("dst").alias("node_id"), "edge_type", "confidence")
    both = out.unionByName(sure.select(F.col("dst").alias("concept"), F.col("src").alias("node_id"), "edge_type", "confidence"))
    return both.join(concepts.select("concept").distinct(), "concept", "left_semi")


def methodology_flow(graph: Graph, starts: DataFrame) -> DataFrame:
    """(start, node_id, depth): what follows each start (node_id) over MethodologyFlow."""
    return grown(starts.select(F.col("node_id").alias("start"), "node_id"), graph.edges_of("MethodologyFlow"), ["start"])


def supporting_nodes(graph: Graph, claims: DataFrame) -> DataFrame:
    """(claim, node_id, depth, strength): evidence a claim (node_id) leads to; strength halves with each step."""
    found = grown(claims.select(F.col("node_id").alias("claim"), "node_id"), graph.edges_of(*fixed.EVIDENCE_EDGES), ["claim"])
    return found.where("depth > 0").withColumn("strength", F.pow(F.lit(0.5), F.col("depth")))


def relationship_strength(edges: DataFrame) -> DataFrame:
    """(a, b, strength): summed confidence of the edges between two nodes, either way."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("confidence").alias("strength"))


def edge_count(graph: Graph) -> DataFrame:
    """(nodes, edges)."""
    return graph.nodes.agg(F.count(F.lit(1)).alias("nodes")).select("nodes", graph.edges.agg(F.count(F.lit(1))).scalar().alias("edges"))
