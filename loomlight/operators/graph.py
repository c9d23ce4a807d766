"""Graph operators over edges (src, pred, dst, w).

Loops are joins of a frontier or a vector of node values with the edges; each round is cut, so plans
stay short and lost executors cost no round twice. Loops end by counting, never by collecting nodes.
Frontiers join by shuffles that AQE splits where a node has very many edges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlight.operators.common import cut, sized


def build(triples: DataFrame, s: str = "s", p: str = "p", o: str = "o_id", qualifiers: str = "qualifiers") -> DataFrame:
    """Edges from triples; those with an empty part go, the weight is $.weight of the qualifiers, 1 by default."""
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    weight = F.coalesce(F.get_json_object(qualifiers, "$.weight").cast("double"), F.lit(1.0))
    return triples.where(full(s) & full(p) & full(o)).select(F.col(s).alias("src"), F.col(p).alias("pred"), F.col(o).alias("dst"), weight.alias("w"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def degrees(edges: DataFrame, by_pred: bool = False) -> DataFrame:
    """node, degree (out-edges, repeated ones too), with pred if asked."""
    keys = [F.col("src").alias("node")] + ([F.col("pred")] if by_pred else [])
    return edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("degree"))


def match(edges: DataFrame, src: str | None = None, pred: str | None = None, dst: str | None = None) -> DataFrame:
    """Edges with the parts that are given."""
    for name, value in (("src", src), ("pred", pred), ("dst", dst)):
        edges = edges if value is None else edges.where(F.col(name) == value)
    return edges


def adjacency(edges: DataFrame) -> DataFrame:
    """src and its targets, sorted and joined by commas."""
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets"))


def interned(edges: DataFrame) -> DataFrame:
    """node, id: dense numbers from 0 in order of the nodes. Ranges are counted, then numbered side by side; the driver gets one count for each."""
    ranged = cut(nodes(edges).repartitionByRange("node").select("node", F.spark_partition_id().alias("part")))
    first, starts = 0, []
    for row in sorted(ranged.groupBy("part").count().collect()):
        starts.append((row.part, first))
        first += row["count"]
    offsets = ranged.sparkSession.createDataFrame(starts, "part int, first long")
    within = F.row_number().over(Window.partitionBy("part").orderBy("node"))
    return ranged.join(F.broadcast(offsets), "part").select("node", (F.col("first") + within - 1).alias("id"))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """Edges to walk along: at, to and the edge itself."""
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "pred", "dst", "w")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "src", "pred", "dst", "w")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def bfs(edges: DataFrame, seeds: DataFrame, hops: int, preds: list[list[str]] | None = None, direction: str = "out", targets: DataFrame | None = None) -> DataFrame:
    """Every edge met from the seeds (node), once, with the hop of its first meeting (step).

    preds: for each hop the predicates allowed, empty for all. targets (node): where edges may lead.
    An edge to a node without an edge of the next hop's predicates is dropped before the last hop.
    """
    walk = _steps(edges, direction)
    frontier = cut(seeds.select("node").distinct())
    seen, met = frontier, []
    for hop in range(hops):
        allowed = preds[hop] if preds and hop < len(preds) else []
        step = walk.where(F.col("pred").isin(allowed)) if allowed else walk
        step = step.join(frontier, step["at"] == frontier["node"], "left_semi")
        if targets is not None:
            step = step.join(targets.select(F.col("node").alias("to")).distinct(), "to", "left_semi")
        following = preds[hop + 1] if preds and hop + 1 < len(preds) else []
        if following and hop + 1 < hops:
            step = step.join(walk.where(F.col("pred").isin(following)).select(F.col("at").alias("to")).distinct(), "to", "left_semi")
        step = cut(step.withColumn("step", F.lit(hop + 1)))
        met.append(step)
        frontier = cut(step.select(F.col("to").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    every = reduce(lambda a, b: a.unionByName(b), met)
    return every.groupBy("src", "pred", "dst", "w").agg(F.min("step").alias("step"))


def khop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", most: int | None = None) -> DataFrame:
    """node, hop: nodes within so many hops and their least distance; the first `most` by distance and id, if given."""
    walk = _steps(edges, direction).select("at", "to").distinct()
    frontier = cut(seeds.select("node").distinct())
    levels = [frontier.withColumn("hop", F.lit(0))]
    seen = frontier
    for hop in range(1, hops + 1):
        reached = walk.join(frontier, walk["at"] == frontier["node"], "left_semi").select(F.col("to").alias("node")).distinct()
        frontier = cut(reached.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
    out = reduce(lambda a, b: a.union(b), levels)
    return out if most is None else out.orderBy("hop", "node").limit(most)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """khop along edges in both directions."""
    return khop(edges, seeds, depth, "both", most)


def induced(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes chosen (node)."""
    keep = chosen.select("node").distinct()
    return edges.join(keep, edges["src"] == keep["node"], "left_semi").join(keep, edges["dst"] == keep["node"], "left_semi")


def documents_of(entities: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """doc_id, entities: documents of the nodes chosen with how many of them each has; the first k by id."""
    found = entities.join(chosen.select(F.col("node").alias("entity")).distinct(), "entity", "left_semi")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities")).orderBy("doc_id").limit(k)


def shortest_paths(edges: DataFrame, src: str, dst: str, hops: int, preds: list[str] | None = None, direction: str = "out") -> DataFrame:
    """All shortest paths between two nodes within so many hops: path (nodes), rels, length; of several predicates between two nodes the least is named. One path of no hops if src is dst.

    Levels of both ends first cut the edges to those on a shortest path; only these are strung together.
    """
    spark = edges.sparkSession
    allowed = edges.where(F.col("pred").isin(preds)) if preds else edges
    walk = cut(_steps(allowed, direction).groupBy("at", "to").agg(F.min("pred").alias("pred")))
    plain = walk.select(F.col("at").alias("src"), "pred", F.col("to").alias("dst"), F.lit(1.0).alias("w"))
    from_src = cut(khop(plain, spark.createDataFrame([(src,)], "node string"), hops, "out"))
    to_dst = khop(plain, spark.createDataFrame([(dst,)], "node string"), hops, "in").withColumnRenamed("hop", "left")
    end = from_src.where(F.col("node") == dst).first()
    start = spark.createDataFrame([([src], [], 0)], "path array<string>, rels array<string>, length int")
    if src == dst:
        return start
    if end is None:
        return start.limit(0)
    on_path = cut(from_src.join(to_dst, "node").where(F.col("hop") + F.col("left") == end.hop))
    paths = start.withColumn("at", F.lit(src))
    for n in range(1, end.hop + 1):
        level = on_path.where(F.col("hop") == n).select(F.col("node").alias("to"))
        step = walk.join(sized(cut(level), 48), "to", "left_semi")
        paths = paths.join(step, "at").select(F.concat("path", F.array("to")).alias("path"), F.concat("rels", F.array("pred")).alias("rels"), F.lit(n).alias("length"), F.col("to").alias("at"))
    return paths.drop("at")


def dijkstra(edges: DataFrame, src: str, most: float | None = None, direction: str = "out") -> DataFrame:
    """node, cost, parent, pred: cheapest ways from a node, by relaxing until nothing improves. Weights of zero or less count 1; costs beyond `most` are cut; ties go to the smaller parent."""
    walk = _steps(edges, direction).withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0)).select("at", "to", "pred", "w")
    best = cut(edges.sparkSession.createDataFrame([(src, 0.0, None, None)], "node string, cost double, parent string, pred string"))
    active = best
    while True:
        offers = walk.join(active.select(F.col("node").alias("at"), "cost"), "at").select(F.col("to").alias("node"), (F.col("cost") + F.col("w")).alias("cost"), F.col("at").alias("parent"), "pred")
        offers = offers if most is None else offers.where(F.col("cost") <= most)
        offers = offers.groupBy("node").agg(F.min(F.struct("cost", "parent", "pred")).alias("o")).select("node", "o.*")
        held = best.select("node", F.col("cost").alias("old"), F.col("parent").alias("old_parent"))
        better = offers.join(held, "node", "left").where(F.col("old").isNull() | (F.col("cost") < F.col("old")) | ((F.col("cost") == F.col("old")) & (F.col("parent") < F.col("old_parent"))))
        active = cut(better.select("node", "cost", "parent", "pred"))
        if active.isEmpty():
            break
        best = cut(best.join(active, "node", "left_anti").unionByName(active))
    return best


def pagerank(edges: DataFrame, alpha: float = 0.85, rounds: int = 20, seeds: DataFrame | None = None, tolerance: float | None = 1e-4, dangling: bool = True) -> DataFrame:
    """node, score by power iteration.

    Without seeds every node with out-edges starts at 1/N, and each round all nodes that had a score
    before it get (1 - alpha) / N; with seeds (node) these share the start and all teleports.
    A node without out-edges keeps (1 - alpha) of its score (dangling), or loses it. Scores don't
    sum to 1. Stops when no score moves by the tolerance after the second round.
    """
    out = cut(edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    shares = cut(edges.join(out, "src").groupBy("src", "dst").agg((F.count(F.lit(1)) / F.first("degree")).alias("share")))
    start = out.select(F.col("src").alias("node")) if seeds is None else seeds.select("node").distinct()
    start = cut(start)
    n = start.count()
    if not n:
        return edges.select(F.col("src").alias("node"), F.lit(0.0).alias("score")).limit(0)
    ranks = cut(start.select("node", F.lit(1.0 / n).alias("score")))
    teleport = start.select("node", F.lit((1 - alpha) / n).alias("score"))
    for i in range(rounds):
        moved = ranks.join(shares, ranks["node"] == shares["src"]).select(F.col("dst").alias("node"), (alpha * F.col("score") * F.col("share")).alias("score"))
        more = teleport if seeds is not None else ranks.select("node", F.lit((1 - alpha) / n).alias("score"))
        if dangling:
            stuck = ranks.join(out, ranks["node"] == out["src"], "left_anti").select("node", ((1 - alpha) * F.col("score")).alias("score"))
            more = more.union(stuck)
        new = cut(moved.union(more).groupBy("node").agg(F.sum("score").alias("score")))
        if tolerance is not None and i >= 2:
            gap = new.join(ranks.withColumnRenamed("score", "old"), "node", "left").agg(F.max(F.abs(F.col("score") - F.coalesce("old", F.lit(0.0))))).first()[0]
            if gap < tolerance:
                return new
        ranks = new
    return ranks


def local_pagerank(edges: DataFrame, seed: str, alpha: float = 0.85, rounds: int = 20, hops: int = 2, most: int = 5000) -> DataFrame:
    """node, score: personalised PageRank within the ball around a seed; what leaves at nodes without out-edges is lost."""
    one = edges.sparkSession.createDataFrame([(seed,)], "node string")
    ball = cut(khop(edges, one, hops, "out", most).select("node"))
    scores = pagerank(cut(induced(edges, ball)), alpha, rounds, one, None, dangling=False)
    return ball.join(scores, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node, component: the least node that edges in either direction reach.

    Besides neighbours' labels each node takes its label's label, so the rounds grow with the
    logarithm of a component's width rather than with the width.
    """
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a != b").distinct())
    labels = cut(nodes(edges).select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        offered = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "label")
        jumped = labels.select("node", F.col("label").alias("via")).join(labels.select(F.col("node").alias("via"), "label"), "via").select("node", "label")
        # a root hears of the least label its members have seen
        raised = both.join(labels, both["b"] == labels["node"]).select("a", F.col("label").alias("low")).join(labels.select(F.col("node").alias("a"), F.col("label").alias("root")), "a").select(F.col("root").alias("node"), F.col("low").alias("label"))
        new = cut(labels.union(offered).union(jumped).union(raised).groupBy("node").agg(F.min("label").alias("label")))
        changed = new.join(labels.withColumnRenamed("label", "old"), "node").where("label != old")
        done = changed.isEmpty()
        labels = new
        if done:
            break
    return labels.withColumnRenamed("label", "component")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """node, community: each round every node takes the most frequent label of its neighbours in both directions, repeated edges counted, ties to the least label."""
    both = cut(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    labels = cut(nodes(edges).select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        votes = both.join(labels, both["b"] == labels["node"]).groupBy("a", "label").agg(F.sum("n").alias("votes"))
        chosen = votes.groupBy("a").agg(F.min(F.struct((-F.col("votes")).alias("v"), "label")).alias("c")).select(F.col("a").alias("node"), F.col("c.label").alias("label"))
        labels, before = cut(chosen), labels
        if labels.join(before.withColumnRenamed("label", "old"), "node").where("label != old").isEmpty():
            break
    return labels.withColumnRenamed("label", "community")


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int, preds: list[str] | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with their hop, edges between them) around the seeds that have an edge."""
    used = edges.where(F.col("pred").isin(preds)) if preds else edges
    rooted = seeds.select("node").distinct().join(nodes(used), "node", "left_semi")
    near = cut(khop(used, rooted, hops, "out", most))
    return near, induced(used, near)


def ranked_subgraph(edges: DataFrame, seeds: DataFrame, alpha: float = 0.15, eps: float = 1e-5, k: int = 50, hops: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores, nodes, edges): the k best nodes by personalised PageRank with at least eps of the best score, and the graph around them, 2k nodes at most."""
    scores = pagerank(edges, 1 - alpha, 50, seeds)
    top = scores.agg((eps * F.max("score")).alias("least"))
    kept = cut(scores.crossJoin(F.broadcast(top)).where("score >= least").drop("least").orderBy(F.desc("score"), "node").limit(k))  # one row
    return (kept, *subgraph(edges, kept, hops, most=2 * k))


def random_walks(edges: DataFrame, starts: DataFrame, walks: int, length: int, seed: int = 7) -> DataFrame:
    """walk, step, node: each start (node) walks `walks` times along out-edges until a node without any. The choice is a hash of seed, walk and step, so runs agree."""
    listed = cut(edges.select("src", "dst").distinct().withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1))
    degree = cut(listed.groupBy("src").agg(F.count(F.lit(1)).alias("degree")))
    at = starts.select("node").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("n"), "node")
    at = cut(at.select(F.concat_ws("#", "node", F.col("n").cast("string")).alias("walk"), F.lit(0).alias("step"), "node"))
    out = [at]
    for step in range(1, length + 1):
        pick = F.pmod(F.xxhash64(F.lit(seed), "walk", F.lit(step)), F.col("degree"))
        at = at.join(degree, at["node"] == degree["src"]).select("walk", "node", pick.cast("int").alias("i"))
        at = cut(at.join(listed, (at["node"] == listed["src"]) & (at["i"] == listed["i"])).select("walk", F.lit(step).alias("step"), F.col("dst").alias("node")))
        if at.isEmpty():
            break
        out.append(at)
    return reduce(lambda a, b: a.union(b), out)


def statistics(edges: DataFrame) -> DataFrame:
    """One row: edges, sources, nodes, predicates."""
    counts = edges.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("pred").alias("predicates"))
    return counts.crossJoin(F.broadcast(nodes(edges).agg(F.count(F.lit(1)).alias("nodes"))))  # one row


def broken(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with an end that isn't among the known nodes (node)."""
    have = known.select("node").distinct()
    lost = lambda end: edges.join(have, edges[end] == have["node"], "left_anti")
    return lost("src").unionByName(lost("dst").join(have, F.col("src") == have["node"], "left_semi"))


def backtrack(best: DataFrame, dst: str) -> list[tuple[str, str | None, float]]:
    """The way to a node from dijkstra's parents, as (node, pred, cost) from the start on; empty if there is none.

    Each round doubles the ancestors known of every node on the way's frontier: pointers jump, so
    that a way of n nodes takes log n joins. Only the way itself reaches the driver.
    """
    jump = best.select("node", F.col("parent").alias("up"))
    way = cut(best.where(F.col("node") == dst).select("node"))
    while True:
        found = cut(way.join(jump, "node").where("up is not null").select(F.col("up").alias("node")).union(way).distinct())
        if found.count() == way.count():
            break
        via = jump.select(F.col("node").alias("up"), F.col("up").alias("further"))
        way, jump = found, cut(jump.join(via, "up", "left").select("node", F.col("further").alias("up")))
    return [(r.node, r.pred, r.cost) for r in best.join(way, "node", "left_semi").orderBy("cost", F.col("parent").isNotNull()).collect()]


def by_label(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Edges whose target has a label (labels: node, label)."""
    wanted = labels.where(F.col("label") == label).select(F.col("node").alias("dst")).distinct()
    return edges.join(wanted, "dst", "left_semi")


def weight_of(edges: DataFrame, default: Column | float = 1.0) -> DataFrame:
    """edges with weights that are missing filled in."""
    return edges.withColumn("w", F.coalesce("w", default if isinstance(default, Column) else F.lit(default)))


def adjacency_from(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """src, pred, targets of the nodes within so many hops of the seeds."""
    near = khop(edges, seeds, hops)
    some = edges.join(near.select(F.col("node").alias("src")), "src", "left_semi")
    return some.groupBy("src", "pred").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("targets"))


def with_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and new ones; of the same src, pred and dst the new one."""
    return without_edges(edges, new).unionByName(new.select("src", "pred", "dst", "w").dropDuplicates(["src", "pred", "dst"]))


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "pred", "dst").distinct(), ["src", "pred", "dst"], "left_anti").select("src", "pred", "dst", "w")
