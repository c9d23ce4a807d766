"""Queries over the graph of customers, suppliers, nations, regions and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.operators import graph as G
from loomlight.operators.common import rounded
from loomlight.sources.tables import PART_EDGES_SQL, STAR_EDGES_SQL, star_edges, table


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node string")


def kg_edges(spark, sf):
    """Edges from triples with JSON qualifiers; empty parts go, weights are read from JSON."""
    e = star_edges(spark, sf)
    triples = e.select(
        F.col("src").alias("s"),
        F.when(F.col("w") == 7, "").otherwise(F.col("pred")).alias("p"),
        F.col("dst").alias("o_id"),
        F.when(F.col("w") > 2, F.concat(F.lit('{"weight": '), F.col("w").cast("string"), F.lit("}"))).alias("qualifiers"),
    )
    return G.build(triples)


def kg_degree(spark, sf):
    return G.degrees(star_edges(spark, sf), by_pred=True)


def kg_match(spark, sf):
    return G.match(star_edges(spark, sf, parts=True), pred="supplied_by", dst="s1")


def kg_adjacency(spark, sf):
    return G.adjacency(star_edges(spark, sf, parts=True))


def kg_intern(spark, sf):
    return G.interned(star_edges(spark, sf))


def kg_stats(spark, sf):
    return G.statistics(star_edges(spark, sf, parts=True))


def kg_fk_check(spark, sf):
    e = star_edges(spark, sf)
    known = G.nodes(e).where("node not in ('n3', 'n4', 'r1') and node not like 'c1%'")
    return G.broken(e, known).select("src", "pred", "dst")


def bfs_edges(spark, sf):
    return G.bfs(star_edges(spark, sf, parts=True), _seeds(spark, "p1", "p2"), 3).select("src", "pred", "dst", "step")


def bfs_predicates(spark, sf):
    """Suppliers of a part, then their nations, only those with a region."""
    return G.bfs(star_edges(spark, sf, parts=True), _seeds(spark, "p1", "c1"), 2, preds=[["supplied_by"], ["in_nation"]]).select("src", "pred", "dst", "step")


def khop(spark, sf):
    return G.khop(star_edges(spark, sf, parts=True), _seeds(spark, "p1", "c5"), 3)


def neighbourhood(spark, sf):
    return G.neighbourhood(star_edges(spark, sf), _seeds(spark, "s1"), 2)


def induced_edges(spark, sf):
    e = star_edges(spark, sf)
    return G.induced(e, G.nodes(e).where("node like 'n%' or node like 'r%' or node like 'c1%'")).select("src", "pred", "dst")


def subgraph(spark, sf):
    """Nodes with their hop, number of edges among them and their label."""
    e = star_edges(spark, sf, parts=True)
    near, inside = G.subgraph(e, _seeds(spark, "p3", "nowhere"), 3)
    out = inside.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("edges"))
    return near.join(out, "node", "left").select("node", "hop", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), F.substring("node", 1, 1).alias("label"))


def entity_docs(spark, sf):
    e = star_edges(spark, sf)
    entities = G.nodes(e).where("node like 'c%'").select(F.col("node").alias("entity"), F.pmod(F.substring("node", 2, 9).cast("long"), F.lit(40)).alias("doc_id"))
    return G.documents_of(entities, G.neighbourhood(e, _seeds(spark, "n4"), 1), 10)


def shortest_path(spark, sf):
    found = G.shortest_paths(star_edges(spark, sf, parts=True), "p1", "r1", 5)
    return found.select(F.array_join("path", ">").alias("path"), F.array_join("rels", ">").alias("rels"), "length")


def dijkstra(spark, sf):
    return G.dijkstra(star_edges(spark, sf, parts=True), "p1", most=12.0)


def pagerank(spark, sf):
    return G.pagerank(star_edges(spark, sf), rounds=4, tolerance=None).select("node", rounded("score", 9).alias("score"))


def ppr(spark, sf):
    return G.pagerank(star_edges(spark, sf, parts=True), rounds=4, seeds=_seeds(spark, "p1", "c1"), tolerance=None).select("node", rounded("score", 9).alias("score"))


def ppr_local(spark, sf):
    return G.local_pagerank(star_edges(spark, sf, parts=True), "p1", rounds=3).select("node", rounded("score", 9).alias("score"))


def ppr_subgraph(spark, sf):
    _, near, _ = G.ranked_subgraph(star_edges(spark, sf, parts=True), _seeds(spark, "p1", "c1"), k=10, hops=2)
    return near


def wcc(spark, sf):
    return G.components(star_edges(spark, sf))


def cdlp(spark, sf):
    return G.label_propagation(star_edges(spark, sf), rounds=3)


def random_walk(spark, sf):
    return G.random_walks(star_edges(spark, sf, parts=True), _seeds(spark, "p1", "p2", "c1"), 4, 5)


QUERIES = {f.__name__: f for f in (kg_edges, kg_degree, kg_match, kg_adjacency, kg_intern, kg_stats, kg_fk_check, bfs_edges, bfs_predicates, khop, neighbourhood, induced_edges, subgraph, entity_docs, shortest_path, dijkstra, pagerank, ppr, ppr_local, ppr_subgraph, wcc, cdlp, random_walk)}

_STAR, _PARTS = f"edges AS ({STAR_EDGES_SQL})", f"edges AS ({PART_EDGES_SQL})"
_REACH = """reach AS (SELECT unnest([{seeds}]) AS node, 0 AS hop UNION SELECT e.dst, reach.hop + 1 FROM reach JOIN edges e ON e.src = reach.node WHERE reach.hop < {hops}),
near AS (SELECT node, min(hop) AS hop FROM reach GROUP BY node)"""


def _rank_sql(rounds: int, start: str, teleport: str, edges: str = "edges", dangling: bool = True) -> str:
    steps = [f"deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM {edges} GROUP BY src)", f"r0 AS MATERIALIZED ({start})"]
    for i in range(rounds):
        stuck = f"UNION ALL SELECT node, 0.15 * score FROM r{i} WHERE node NOT IN (SELECT src FROM deg)" if dangling else ""
        steps.append(f"""r{i + 1} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (
  SELECT e.dst AS node, 0.85 * r.score / d.degree AS score FROM r{i} r JOIN {edges} e ON e.src = r.node JOIN deg d ON d.src = e.src
  UNION ALL {teleport.format(i=i)} {stuck}) GROUP BY node)""")
    return ",\n".join(steps)


def _cdlp_sql(rounds: int) -> str:
    steps = ["both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)", "l0 AS MATERIALIZED (SELECT DISTINCT a AS node, a AS label FROM both_ways)"]
    for i in range(rounds):
        steps.append(f"""l{i + 1} AS MATERIALIZED (SELECT node, label FROM (SELECT w.a AS node, l.label, count(*) AS n FROM both_ways w JOIN l{i} l ON l.node = w.b GROUP BY w.a, l.label)
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY n DESC, label) = 1)""")
    return ",\n".join(steps)


ORACLE_SQL = {
    "kg_edges": f"WITH {_STAR} SELECT src, pred, dst, CASE WHEN w > 2 THEN w ELSE 1.0 END AS w FROM edges WHERE w <> 7",
    "kg_degree": f"WITH {_STAR} SELECT src AS node, pred, count(*) AS degree FROM edges GROUP BY src, pred",
    "kg_match": f"WITH {_PARTS} SELECT src, pred, dst, w FROM edges WHERE pred = 'supplied_by' AND dst = 's1'",
    "kg_adjacency": f"WITH {_PARTS} SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS targets FROM edges GROUP BY src",
    "kg_intern": f"WITH {_STAR}, n AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges) SELECT node, row_number() OVER (ORDER BY node) - 1 AS id FROM n",
    "kg_stats": f"""WITH {_PARTS} SELECT count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT pred) AS predicates,
  (SELECT count(*) FROM (SELECT src FROM edges UNION SELECT dst FROM edges)) AS nodes FROM edges""",
    "kg_fk_check": f"""WITH {_STAR}, lost AS (SELECT n FROM (SELECT src AS n FROM edges UNION SELECT dst FROM edges) WHERE n IN ('n3', 'n4', 'r1') OR n LIKE 'c1%')
SELECT src, pred, dst FROM edges WHERE src IN (SELECT n FROM lost) OR dst IN (SELECT n FROM lost)""",
    "bfs_edges": f"""WITH RECURSIVE {_PARTS}, {_REACH.format(seeds="'p1', 'p2'", hops=2)}
SELECT src, pred, dst, CAST(hop + 1 AS INTEGER) AS step FROM edges JOIN near ON near.node = edges.src""",
    "bfs_predicates": f"""WITH {_PARTS}, one AS (SELECT * FROM edges WHERE src IN ('p1', 'c1') AND pred = 'supplied_by' AND dst IN (SELECT src FROM edges WHERE pred = 'in_nation'))
SELECT src, pred, dst, 1 AS step FROM one UNION SELECT e.src, e.pred, e.dst, 2 FROM edges e WHERE e.pred = 'in_nation' AND e.src IN (SELECT dst FROM one)""",
    "khop": f"WITH RECURSIVE {_PARTS}, {_REACH.format(seeds=chr(39) + 'p1' + chr(39) + ', ' + chr(39) + 'c5' + chr(39), hops=3)} SELECT node, CAST(hop AS INTEGER) AS hop FROM near",
    "neighbourhood": f"""WITH RECURSIVE one_way AS ({STAR_EDGES_SQL}), edges AS (SELECT src, dst FROM one_way UNION SELECT dst, src FROM one_way),
{_REACH.format(seeds="'s1'", hops=2)} SELECT node, CAST(hop AS INTEGER) AS hop FROM near""",
    "induced_edges": f"""WITH {_STAR} SELECT src, pred, dst FROM edges WHERE (src LIKE 'n%' OR src LIKE 'r%' OR src LIKE 'c1%') AND (dst LIKE 'n%' OR dst LIKE 'r%' OR dst LIKE 'c1%')""",
    "subgraph": f"""WITH RECURSIVE {_PARTS}, {_REACH.format(seeds="'p3'", hops=3)}, inside AS (SELECT src, count(*) AS n FROM edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near) GROUP BY src)
SELECT node, CAST(hop AS INTEGER) AS hop, coalesce(n, 0) AS edges, left(node, 1) AS label FROM near LEFT JOIN inside ON inside.src = near.node""",
    "entity_docs": "SELECT c_custkey % 40 AS doc_id, count(*) AS entities FROM customer WHERE c_nationkey = 4 GROUP BY 1 ORDER BY 1 LIMIT 10",
    "shortest_path": f"""WITH RECURSIVE {_PARTS}, walk AS (SELECT ['p1'] AS path, CAST([] AS VARCHAR[]) AS rels, 'p1' AS here, 0 AS length
  UNION ALL SELECT list_append(walk.path, e.dst), list_append(walk.rels, e.pred), e.dst, walk.length + 1 FROM walk JOIN edges e ON e.src = walk.here WHERE walk.length < 5 AND NOT list_contains(walk.path, e.dst))
SELECT array_to_string(path, '>') AS path, array_to_string(rels, '>') AS rels, CAST(length AS INTEGER) AS length FROM walk WHERE here = 'r1' AND length = (SELECT min(length) FROM walk WHERE here = 'r1')""",
    "dijkstra": f"""WITH RECURSIVE {_PARTS}, walk AS (SELECT 'p1' AS node, CAST(0 AS DOUBLE) AS cost, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS pred
  UNION SELECT e.dst, walk.cost + e.w, e.src, e.pred FROM walk JOIN edges e ON e.src = walk.node WHERE walk.cost + e.w <= 12)
SELECT node, cost, parent, pred FROM walk QUALIFY row_number() OVER (PARTITION BY node ORDER BY cost, parent, pred) = 1""",
    "pagerank": f"""WITH {_STAR}, {_rank_sql(4, 'SELECT DISTINCT src AS node, 1.0 / (SELECT count(*) FROM deg) AS score FROM edges', 'SELECT node, 0.15 / (SELECT count(*) FROM deg) FROM r{i}')}
SELECT node, round(score, 9) AS score FROM r4""",
    "ppr": f"""WITH {_PARTS}, {_rank_sql(4, "SELECT unnest(['p1', 'c1']) AS node, CAST(0.5 AS DOUBLE) AS score", "SELECT unnest(['p1', 'c1']), CAST(0.075 AS DOUBLE)")}
SELECT node, round(score, 9) AS score FROM r4""",
    "ppr_local": f"""WITH RECURSIVE {_PARTS}, {_REACH.format(seeds="'p1'", hops=2)}, inner_edges AS MATERIALIZED (SELECT * FROM edges WHERE src IN (SELECT node FROM near) AND dst IN (SELECT node FROM near)),
{_rank_sql(3, "SELECT 'p1' AS node, CAST(1.0 AS DOUBLE) AS score", "SELECT 'p1', CAST(0.15 AS DOUBLE)", "inner_edges", False)}
SELECT near.node, round(coalesce(score, 0), 9) AS score FROM near LEFT JOIN r3 ON r3.node = near.node""",
    "wcc": f"""WITH RECURSIVE {_STAR}, ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
reach AS (SELECT a AS node, a AS other FROM ways UNION SELECT reach.node, ways.b FROM reach JOIN ways ON ways.a = reach.other) SELECT node, min(other) AS component FROM reach GROUP BY node""",
    "cdlp": f"WITH {_STAR}, {_cdlp_sql(3)} SELECT node, label AS community FROM l3",
}
