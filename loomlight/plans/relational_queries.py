"""Queries over events and the star schema: joins, aggregates, windows, set operations, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlight.functions import text as X
from loomlight.operators import evaluation as E
from loomlight.operators import serving as S
from loomlight.operators.common import rounded, sized, top_k
from loomlight.sources.tables import events, table


def join_inner(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = c.join(sized(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), rounded(F.sum("c_acctbal"), 2).alias("balance"))


def join_left(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    return d.join(l, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.max("doc_id").alias("last"))


def join_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def join_not_in(spark, sf):
    """Null-safe NOT IN: parts that nobody ordered in quantity 50."""
    taken = table(spark, sf, "lineitem").where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return table(spark, sf, "part").select("p_partkey").join(taken, "p_partkey", "left_anti")


def join_semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


def join_cross(spark, sf):
    n = table(spark, sf, "nation").select("n_name")
    return n.crossJoin(F.broadcast(table(spark, sf, "region").select("r_name")))  # a fixed number of regions


def join_pairs(spark, sf):
    """Pairs of suppliers of one part."""
    s = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return s.alias("a").join(s.alias("b"), F.expr("a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey")).select(F.col("a.l_partkey").alias("part"), F.col("a.l_suppkey").alias("one"), F.col("b.l_suppkey").alias("other"))


def join_range(spark, sf):
    """Words of a document within ten places of each other: a band join on blocks of ten places."""
    w = table(spark, sf, "benchmark").select("item_id", F.posexplode(X.tokens("text")).alias("pos", "word")).where("length(word) > 6")
    a = w.withColumn("block", F.explode(F.array(F.floor(F.col("pos") / 10), F.floor(F.col("pos") / 10) + 1)))
    b = w.select(F.col("item_id").alias("i"), F.col("pos").alias("q"), F.col("word").alias("other"), F.floor(F.col("pos") / 10).alias("block"))
    pairs = a.join(b, (a["item_id"] == b["i"]) & (a["block"] == b["block"]) & (F.col("q") > F.col("pos")) & (F.col("q") <= F.col("pos") + 10))
    return pairs.select("item_id", "pos", "word", "other", rounded(1 / (F.col("q") - F.col("pos") + 1)).alias("strength"))


def join_full(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers")).where("k > 3")
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers")).where("k < 20")
    return a.join(b, "k", "full").select("k", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def agg_usage(spark, sf):
    e = events(spark, sf)
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("types"), F.max("ts").cast("string").alias("last"))


def agg_request_metrics(spark, sf):
    return S.request_metrics(events(spark, sf), by=("event_type",))


def agg_top_endpoints(spark, sf):
    return top_k(events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), 10, F.desc("n"), "user_id")


def agg_conditional(spark, sf):
    return S.cache_counts(events(spark, sf), "ts", F.lit("2024-01-15 00:00:00").cast("timestamp"))


def agg_percentile_array(spark, sf):
    return E.percentile_by_place(events(spark, sf), "event_type", "value", 0.9).select("event_type", "disc", rounded("cont").alias("cont"))


def agg_percentile_std(spark, sf):
    found = E.latency(events(spark, sf), "event_type", "value")
    return found.select("event_type", *(rounded(c).alias(c) for c in found.columns[1:]))


def agg_quality(spark, sf):
    found = E.describe(events(spark, sf), "event_type", "value")
    return found.select("event_type", "n", *(rounded(c).alias(c) for c in ("mean", "sd", "se")))


def agg_outliers(spark, sf):
    return E.outliers(events(spark, sf), "event_type", "value").select("event_id", "event_type", "value")


def bootstrap_ci(spark, sf):
    found = E.bootstrap(events(spark, sf), "event_type", "value", "event_id")
    return found.select("event_type", rounded("low").alias("low"), rounded("high").alias("high"))


def effect_size(spark, sf):
    found = E.compare_two(events(spark, sf), "event_type", "value", "view", "purchase", with_p=False)
    return found.select(*(rounded(c).alias(c) for c in ("mean_a", "mean_b", "cohens_d", "t")), "df")


def t_stat(spark, sf):
    found = E.paired_t(table(spark, sf, "lineitem"), "l_discount", "l_tax", with_p=False)
    return found.select(rounded("t").alias("t"), "n")


def mann_whitney(spark, sf):
    return E.mann_whitney(events(spark, sf), "event_type", "value", "view", "click", with_p=False).select(rounded("u").alias("u"), "n_a", "n_b")


def anova_f(spark, sf):
    return E.anova(events(spark, sf), "event_type", "value", with_p=False).select(rounded("f").alias("f"), "df_between", "df_within", rounded("eta_squared").alias("eta_squared"))


def bh_adjust(spark, sf):
    tests = table(spark, sf, "part").select(F.col("p_partkey").alias("test"), (F.pmod(F.col("p_partkey") * 37, F.lit(97)) / 970).alias("p"))
    return E.adjusted(tests).select("test", *(rounded(c).alias(c) for c in ("p", "bonferroni", "bh")), "significant")


def _scores(spark, sf):
    """Users as systems, event types as metrics."""
    names = {"view": "faithfulness", "click": "context_recall", "purchase": "answer_correctness", "signup": "answer_relevancy", "error": "context_precision"}
    metric = F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("event_type"))
    return events(spark, sf).groupBy(F.col("user_id").alias("system"), metric.alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


def metric_rank(spark, sf):
    return E.metric_ranks(_scores(spark, sf)).select("system", "metric", "value", "rank")


def metric_best(spark, sf):
    return E.best_per_metric(_scores(spark, sf))


def metric_overall(spark, sf):
    return E.overall(_scores(spark, sf)).select("system", rounded("overall").alias("overall"))


def batch_metrics(spark, sf):
    b = events(spark, sf).select((F.pmod("event_id", F.lit(10))).alias("documents"), F.pmod("event_id", F.lit(7)).alias("entities"), (F.col("event_type") == "error").alias("failed"), F.col("value").alias("ms"))
    found = S.batch_metrics(b)
    return found.withColumn("mean_ms", rounded("mean_ms"))


def ema(spark, sf):
    found = S.moving_average(events(spark, sf), "user_id", (F.col("event_type") == "error").cast("double"), ["ts", "event_id"])
    return found.select("user_id", rounded("average").alias("average"), S.status_of(rounded("average")).alias("status"))


def health_rollup(spark, sf):
    e = events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    status = e.select("user_id", F.when(F.col("n") < 5, "unavailable").when(F.col("n") < 10, "degraded").otherwise("healthy").alias("status"))
    return S.rolled_up(status, ("user_id",))


def latency_nearest_rank(spark, sf):
    return E.nearest_rank(events(spark, sf), "event_type", "value").select("event_type", "n", rounded("mean").alias("mean"), "p95", "p99")


def win_sliding_count(spark, sf):
    return S.sliding_count(events(spark, sf), "user_id", 3600).select("event_id", "in_window")


def win_rank(spark, sf):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.row_number().over(w).alias("rank")).where("rank <= 3")


def win_lead(spark, sf):
    """Shared words of neighbouring sentences over the smaller of their word sets."""
    s = table(spark, sf, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("n", "s")).withColumn("w", F.array_distinct(X.tokens("s")))
    pairs = s.withColumn("next", F.lead("w").over(Window.partitionBy("doc_id").orderBy("n"))).where("size(w) > 0 and size(next) > 0")
    return pairs.select("doc_id", "n", rounded(F.size(F.array_intersect("w", "next")) / F.least(F.size("w"), F.size("next"))).alias("overlap"))


def greedy_batches(spark, sf):
    items = table(spark, sf, "documents").select("doc_id", "source", X.token_estimate("text").alias("tokens"))
    return S.token_batches(items, "source", "tokens", "doc_id").select("doc_id", "batch")


def rate_limited(spark, sf):
    return S.rate_limit(events(spark, sf), "user_id", 2, 7200).select("event_id", "admitted")


def session_counts(spark, sf):
    return S.sessions(events(spark, sf), "user_id", "30 minutes").groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


def tumbling_hours(spark, sf):
    e = events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value")).alias("total"))
    return e.select(F.col("w.start").cast("string").alias("hour"), "event_type", "n", "total")


def set_union(spark, sf):
    a, b = table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    return a.union(b).distinct()


def set_union_all(spark, sf):
    a, b = table(spark, sf, "region").select(F.col("r_name").alias("name")), table(spark, sf, "nation").select(F.col("n_name").alias("name"))
    return a.unionByName(b)


def set_difference(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


def set_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


def best_duplicate(spark, sf):
    """Of each name the part with the highest price, then the least key."""
    best = F.min(F.struct((-F.col("p_retailprice")).alias("p"), "p_partkey"))
    return table(spark, sf, "part").groupBy("p_name").agg(best.alias("b")).select("p_name", F.col("b.p_partkey").alias("p_partkey"), (-F.col("b.p")).alias("price"))


QUERIES = {
    f.__name__: f
    for f in (
        join_inner, join_left, join_anti, join_not_in, join_semi, join_cross, join_pairs, join_range, join_full, agg_usage, agg_request_metrics, agg_top_endpoints, agg_conditional, agg_percentile_array,
        agg_percentile_std, agg_quality, agg_outliers, bootstrap_ci, effect_size, t_stat, mann_whitney, anova_f, bh_adjust, metric_rank, metric_best, metric_overall, batch_metrics, ema, health_rollup,
        latency_nearest_rank, win_sliding_count, win_rank, win_lead, greedy_batches, rate_limited, session_counts, tumbling_hours, set_union, set_union_all, set_difference, set_intersect, best_duplicate,
    )
}

_TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', chr(92) || '1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: s <> '')".replace("chr(92) || '1' || chr(1)", r"'\1' || chr(1)")
_METRICS = """scores AS (SELECT user_id AS system, CASE event_type WHEN 'view' THEN 'faithfulness' WHEN 'click' THEN 'context_recall' WHEN 'purchase' THEN 'answer_correctness' WHEN 'signup' THEN 'answer_relevancy' ELSE 'context_precision' END AS metric,
  round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"""
_SORTED = "s AS (SELECT event_type, list_sort(list(value)) AS a FROM events GROUP BY event_type)"

ORACLE_SQL = {
    "join_inner": "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT source, count(*) AS n, count(quality) AS labelled, max(d.doc_id) AS last FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY source",
    "join_anti": "SELECT doc_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL",
    "join_not_in": "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_pairs": "WITH s AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT a.l_partkey AS part, a.l_suppkey AS one, b.l_suppkey AS other FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey",
    "join_range": f"""WITH t AS (SELECT item_id, {_TOKENS.format('text')} AS w FROM benchmark), p AS (SELECT item_id, CAST(i - 1 AS INTEGER) AS pos, w[i] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(i) WHERE length(w[i]) > 6)
SELECT a.item_id, a.pos, a.word, b.word AS other, round(1 / (b.pos - a.pos + 1), 6) AS strength FROM p a JOIN p b ON a.item_id = b.item_id AND b.pos > a.pos AND b.pos <= a.pos + 10""",
    "join_full": """SELECT coalesce(a.k, b.k) AS k, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey > 3 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey < 20 GROUP BY 1) b ON a.k = b.k""",
    "agg_usage": "SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS types, CAST(max(ts) AS VARCHAR) AS last FROM events GROUP BY user_id",
    "agg_request_metrics": "SELECT event_type, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 2) AS error_rate, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type",
    "agg_top_endpoints": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "agg_conditional": "SELECT count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2024-01-15') AS active, count(*) FILTER (ts <= TIMESTAMP '2024-01-15') AS expired FROM events",
    "agg_percentile_array": f"""WITH {_SORTED}, p AS (SELECT *, len(a) * 0.9 AS x, least(CAST(floor(len(a) * 0.9) AS BIGINT), len(a) - 1) AS lo FROM s)
SELECT event_type, a[lo + 1] AS disc, round(a[lo + 1] + (x - floor(x)) * (a[least(lo + 2, len(a))] - a[lo + 1]), 6) AS cont FROM p""",
    "agg_percentile_std": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most FROM events GROUP BY event_type",
    "agg_quality": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(stddev_samp(value) / sqrt(count(value)), 6) AS se FROM events GROUP BY event_type",
    "agg_outliers": """SELECT event_id, e.event_type, value FROM events e JOIN (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY event_type HAVING count(*) >= 4) q ON e.event_type = q.event_type
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""",
    "effect_size": """WITH s AS (SELECT count(value) FILTER (event_type = 'view') AS n0, avg(value) FILTER (event_type = 'view') AS m0, var_samp(value) FILTER (event_type = 'view') AS v0,
  count(value) FILTER (event_type = 'purchase') AS n1, avg(value) FILTER (event_type = 'purchase') AS m1, var_samp(value) FILTER (event_type = 'purchase') AS v1 FROM events), p AS (SELECT *, sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) AS sp FROM s)
SELECT round(m0, 6) AS mean_a, round(m1, 6) AS mean_b, round((m0 - m1) / sp, 6) AS cohens_d, round((m0 - m1) / (sp * sqrt(1 / n0 + 1 / n1)), 6) AS t, n0 + n1 - 2 AS df FROM p""",
    "t_stat": "SELECT round(avg(l_discount - l_tax) / (stddev_samp(l_discount - l_tax) / sqrt(count(*))), 6) AS t, count(*) AS n FROM lineitem",
    "mann_whitney": """WITH c AS (SELECT value AS v, count(*) FILTER (event_type = 'view') AS x, count(*) FILTER (event_type = 'click') AS y FROM events WHERE event_type IN ('view', 'click') GROUP BY value)
SELECT round(sum(x * (coalesce(below, 0) + y / 2)), 6) AS u, CAST(sum(x) AS BIGINT) AS n_a, CAST(sum(y) AS BIGINT) AS n_b FROM (SELECT *, sum(y) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM c)""",
    "anova_f": """WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) * (count(*) - 1) AS ss FROM events GROUP BY event_type), t AS (SELECT count(*) AS k, sum(n) AS n, sum(ss) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b FROM g)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within, round(b / (b + w), 6) AS eta_squared FROM t""",
    "bh_adjust": """WITH t AS (SELECT p_partkey AS test, p_partkey * 37 % 97 / 970 AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, test) AS r, least(1.0, p * count(*) OVER ()) AS bf FROM t),
h AS (SELECT *, least(1.0, min(r) OVER (ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)) AS bh FROM r) SELECT test, round(p, 6) AS p, round(bf, 6) AS bonferroni, round(bh, 6) AS bh, bh <= 0.05 AS significant FROM h""",
    "metric_rank": f"WITH {_METRICS} SELECT system, metric, value, CAST(rank() OVER (PARTITION BY metric ORDER BY value DESC) AS INTEGER) AS rank FROM scores",
    "metric_best": f"WITH {_METRICS} SELECT metric, system AS best, value FROM scores QUALIFY row_number() OVER (PARTITION BY metric ORDER BY value DESC, system) = 1",
    "metric_overall": f"""WITH {_METRICS}, w AS (SELECT *, CASE metric WHEN 'faithfulness' THEN 0.25 WHEN 'answer_relevancy' THEN 0.20 WHEN 'context_precision' THEN 0.15 WHEN 'context_recall' THEN 0.15 WHEN 'answer_correctness' THEN 0.20 END AS w FROM scores)
SELECT system, round(sum(w * value) / sum(w), 6) AS overall FROM w GROUP BY system""",
    "batch_metrics": """SELECT count(*) AS batches, count(*) FILTER (event_type = 'error') AS failures, CAST(sum(event_id % 10) FILTER (event_type <> 'error') AS BIGINT) AS documents, CAST(sum(event_id % 7) FILTER (event_type <> 'error') AS BIGINT) AS entities,
  round(avg(value) FILTER (event_type <> 'error'), 6) AS mean_ms, count(*) FILTER (event_type <> 'error' AND event_id % 7 = 0) AS without_entities FROM events""",
    "ema": """WITH o AS (SELECT user_id, list(CASE event_type WHEN 'error' THEN CAST(1 AS DOUBLE) ELSE 0 END ORDER BY ts, event_id) AS a FROM events GROUP BY user_id), r AS (SELECT user_id, round(list_reduce(a, lambda s, x: 0.1 * x + 0.9 * s), 6) AS average FROM o)
SELECT user_id, average, CASE WHEN average > 0.1 THEN 'degraded' ELSE 'healthy' END AS status FROM r""",
    "health_rollup": """WITH e AS (SELECT user_id, CASE WHEN count(*) < 5 THEN 2 WHEN count(*) < 10 THEN 1 ELSE 0 END AS s FROM events GROUP BY user_id, event_type) SELECT user_id, ['healthy', 'degraded', 'unavailable'][max(s) + 1] AS status FROM e GROUP BY user_id""",
    "latency_nearest_rank": f"WITH {_SORTED} SELECT event_type, len(a) AS n, round(list_avg(a), 6) AS mean, a[least(CAST(floor(len(a) * 0.95) AS BIGINT), len(a) - 1) + 1] AS p95, a[least(CAST(floor(len(a) * 0.99) AS BIGINT), len(a) - 1) + 1] AS p99 FROM s",
    "win_sliding_count": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events",
    "win_rank": "SELECT c_custkey, c_nationkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer QUALIFY rank <= 3",
    "win_lead": f"""WITH d AS (SELECT doc_id, {_SENTENCES} AS s FROM documents), p AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, list_distinct({_TOKENS.format('s[i]')}) AS w FROM d, unnest(range(1, len(s) + 1)) AS u(i)),
x AS (SELECT *, lead(w) OVER (PARTITION BY doc_id ORDER BY n) AS nx FROM p) SELECT doc_id, n, round(len(list_intersect(w, nx)) / least(len(w), len(nx)), 6) AS overlap FROM x WHERE len(w) > 0 AND len(nx) > 0""",
    "greedy_batches": """WITH RECURSIVE i AS (SELECT doc_id, source, CAST(ceil(length(text) / 4) AS BIGINT) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
g AS (SELECT doc_id, source, n, CAST(0 AS BIGINT) AS batch, t AS used FROM i WHERE n = 1
  UNION ALL SELECT i.doc_id, i.source, i.n, CASE WHEN g.used > 0 AND g.used + i.t > 8192 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.used > 0 AND g.used + i.t > 8192 THEN i.t ELSE g.used + i.t END FROM g JOIN i ON i.source = g.source AND i.n = g.n + 1)
SELECT doc_id, batch FROM g""",
    "rate_limited": """WITH RECURSIVE i AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
g AS (SELECT event_id, user_id, n, true AS admitted, [ts] AS held FROM i WHERE n = 1
  UNION ALL SELECT i.event_id, i.user_id, i.n, len(list_filter(g.held, lambda h: h > i.ts - INTERVAL 7200 SECONDS)) < 2,
    CASE WHEN len(list_filter(g.held, lambda h: h > i.ts - INTERVAL 7200 SECONDS)) < 2 THEN list_append(list_filter(g.held, lambda h: h > i.ts - INTERVAL 7200 SECONDS), i.ts) ELSE g.held END FROM g JOIN i ON i.user_id = g.user_id AND i.n = g.n + 1)
SELECT event_id, admitted FROM g""",
    "session_counts": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o),
c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
    "tumbling_hours": "SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_union_all": "SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation",
    "set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "best_duplicate": "SELECT p_name, p_partkey, p_retailprice AS price FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1",
}
