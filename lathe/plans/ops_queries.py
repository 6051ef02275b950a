"""Queries over metrics, costs, events, breakers, snapshots and webhooks; and the text scans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import events as ev
from ..operators import breaker, metrics, persist, validate
from ..sources import webhook
from ..sources.store import Store, scratch
from .dialect import frame, table

c = F.col
NOW = "2024-01-31 00:00:00"
#: Buckets of the stores that queries write.
BUCKETS = 8


def _recent(d, seconds: int) -> str:
    return f"ts >= {d.seconds_before(chr(39) + NOW + chr(39), seconds)}"


@frame("metrics_window_summary", lambda d: f"""
SELECT query_type, count(ms) AS n, round(sum(ms), 4) AS total, round(avg(ms), 4) AS mean, min(ms) AS low, max(ms) AS high, {d.arg_max('ms', 'event_id')} AS latest FROM query_metrics WHERE {_recent(d, 864000)} GROUP BY query_type""", "query_metrics")
def metrics_window_summary(spark, sf_dir):
    recent = table(spark, sf_dir, "query_metrics").where(f"ts >= TIMESTAMP_NTZ'{NOW}' - INTERVAL '864000' SECOND")
    return metrics.summary(recent, ["query_type"], "ms", ["event_id"])


@frame("perf_overall", lambda d: """
SELECT count(*) AS total, count(*) FILTER (failed) AS errors, count(*) FILTER (cache_hit) AS hits, round(avg(ms), 4) AS mean, list_sort(list(ms))[CAST(floor(count(ms) * 0.95E0) AS INT) + 1] AS p95, list_sort(list(ms))[CAST(floor(count(ms) * 0.99E0) AS INT) + 1] AS p99, round(count(*) FILTER (failed)::DOUBLE / count(*) * 100, 4) AS error_rate FROM query_metrics""", "query_metrics")
def perf_overall(spark, sf_dir):
    return metrics.overall(table(spark, sf_dir, "query_metrics"), "ms", "failed", "cache_hit")


@frame("perf_by_type", lambda d: f"""
SELECT query_type, {d.nth_sorted('ms', 'floor(count(ms) * 0.5E0)')} AS p50, {d.nth_sorted('ms', 'floor(count(ms) * 0.95E0)')} AS p95, {d.nth_sorted('ms', 'floor(count(ms) * 0.99E0)')} AS p99 FROM query_metrics GROUP BY query_type""", "query_metrics")
def perf_by_type(spark, sf_dir):
    return metrics.exact_percentile(table(spark, sf_dir, "query_metrics"), ["query_type"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@frame("perf_slowest", lambda d: f"SELECT event_id, query_type, ms FROM query_metrics WHERE {_recent(d, 864000)} ORDER BY ms DESC, event_id LIMIT 10", "query_metrics")
def perf_slowest(spark, sf_dir):
    recent = table(spark, sf_dir, "query_metrics").where(f"ts >= TIMESTAMP_NTZ'{NOW}' - INTERVAL '864000' SECOND")
    return recent.orderBy(c("ms").desc(), "event_id").limit(10).select("event_id", "query_type", "ms")


@frame("kpis", lambda d: "SELECT user_id % 10 AS team, round(CAST(sum(CASE WHEN failed THEN 0 ELSE 1 END) AS DOUBLE) / count(*) * 100, 2) AS success, round(avg(ms), 2) AS mean_ms, round(sum(ms) / count(DISTINCT user_id), 4) AS per_user FROM query_metrics GROUP BY user_id % 10", "query_metrics")
def kpis(spark, sf_dir):
    rows = table(spark, sf_dir, "query_metrics").withColumn("team", c("user_id") % 10)
    return rows.groupBy("team").agg(F.round(F.sum((~c("failed")).cast("double")) / F.count(F.lit(1)) * 100, 2).alias("success"), F.round(F.avg("ms"), 2).alias("mean_ms"), F.round(F.sum("ms") / F.count_distinct("user_id"), 4).alias("per_user"))


@frame("alerts", lambda d: """
WITH t AS (SELECT user_id, count(*) FILTER (failed) AS errors, count(*) AS requests, max(ms) / 1000 AS cost, avg(ms) / 4 AS latency FROM query_metrics GROUP BY user_id)
SELECT user_id, 'high_error_rate' AS alert, 'error' AS severity, round(errors::DOUBLE / requests, 6) AS value, errors::DOUBLE / requests > 0.05 AS triggered FROM t
UNION ALL SELECT user_id, 'cost_budget_warning', 'warning', round(cost / 0.30E0, 6), cost / 0.30E0 > 0.8 FROM t UNION ALL SELECT user_id, 'high_latency', 'warning', round(latency, 6), latency > 30 FROM t""".replace("WITH t AS", ", t AS").replace(", t AS", "SELECT * FROM (WITH t AS", 1) + ") z", "query_metrics")
def alerts(spark, sf_dir):
    totals = table(spark, sf_dir, "query_metrics").groupBy("user_id").agg(F.sum(c("failed").cast("long")).alias("errors"), F.count(F.lit(1)).alias("requests"), (F.max("ms") / 1000).alias("cost"), (F.avg("ms") / 4).alias("latency"))
    return metrics.alerts(totals, ["user_id"]).withColumn("value", F.round("value", 6))


@frame("service_rates", lambda d: "SELECT query_type, round(avg(CASE WHEN cache_hit THEN 1.0E0 ELSE 0.0E0 END), 6) AS hit_rate, round(avg(CASE WHEN failed THEN 1.0E0 ELSE 0.0E0 END), 6) AS failure_rate FROM query_metrics GROUP BY query_type", "query_metrics")
def service_rates(spark, sf_dir):
    rate = lambda x: F.round(F.avg(c(x).cast("double")), 6)
    return table(spark, sf_dir, "query_metrics").groupBy("query_type").agg(rate("cache_hit").alias("hit_rate"), rate("failed").alias("failure_rate"))


@frame("pool_timing_avg", lambda d: "SELECT query_type, round(avg(ms), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY ts DESC, event_id DESC) AS r FROM query_metrics) x WHERE r <= 100 GROUP BY query_type", "query_metrics")
def pool_timing_avg(spark, sf_dir):
    return metrics.last_mean(table(spark, sf_dir, "query_metrics"), "query_type", ["ts", "event_id"], "ms", 100)


@frame("bounded_history", lambda d: "SELECT event_id, query_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS r FROM query_metrics) x WHERE r <= 500", "query_metrics")
def bounded_history(spark, sf_dir):
    return table(spark, sf_dir, "query_metrics").orderBy(c("ts").desc(), c("event_id").desc()).limit(500).select("event_id", "query_type")


@frame("health_rollup", lambda d: "SELECT CASE max(s) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall, sum(CASE WHEN s > 0 THEN 1 ELSE 0 END) AS affected FROM (SELECT query_type, CASE WHEN avg(ms) > 150 THEN 2 WHEN avg(ms) > 100 THEN 1 ELSE 0 END AS s FROM query_metrics GROUP BY query_type) x", "query_metrics")
def health_rollup(spark, sf_dir):
    return metrics.rollup(table(spark, sf_dir, "query_metrics").groupBy("query_type").agg(F.avg("ms").alias("v")), "v", 100, 150, ("healthy", "degraded", "unhealthy"))


@frame("alert_transitions", lambda d: """
SELECT user_id, event_id, CASE WHEN failed THEN 'triggered' ELSE 'resolved' END AS transition FROM (SELECT *, coalesce(lag(failed) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS before FROM query_metrics) x WHERE failed <> before""", "query_metrics")
def alert_transitions(spark, sf_dir):
    return metrics.transitions(table(spark, sf_dir, "query_metrics"), "user_id", ["ts", "event_id"], "failed").select("user_id", "event_id", "transition")


MODELS = (("claude", "claude-3-5-sonnet-20241022"), ("claude", "claude-3-opus-20240229"), ("gemini", "gemini-1.5-flash"), ("gemini", "gemini-1.5-pro"), ("gemini", "gemini-2.0-flash-exp"), ("other", "unknown"))


@frame("llm_cost", lambda d: """
SELECT provider, model, requests, input_tokens, output_tokens, round((input_tokens * CASE model WHEN 'claude-3-opus-20240229' THEN 15 WHEN 'gemini-1.5-flash' THEN 0.075 WHEN 'gemini-1.5-pro' THEN 1.25 WHEN 'gemini-2.0-flash-exp' THEN 0 ELSE 3 END
  + output_tokens * CASE model WHEN 'claude-3-opus-20240229' THEN 75 WHEN 'gemini-1.5-flash' THEN 0.3 WHEN 'gemini-1.5-pro' THEN 5 WHEN 'gemini-2.0-flash-exp' THEN 0 ELSE 15 END)::DOUBLE / 1000000, 4) AS cost FROM (
  SELECT CASE WHEN conv_id % 6 < 2 THEN 'claude' WHEN conv_id % 6 < 5 THEN 'gemini' ELSE 'other' END AS provider, CASE conv_id % 6 WHEN 0 THEN 'claude-3-5-sonnet-20241022' WHEN 1 THEN 'claude-3-opus-20240229' WHEN 2 THEN 'gemini-1.5-flash' WHEN 3 THEN 'gemini-1.5-pro' WHEN 4 THEN 'gemini-2.0-flash-exp' ELSE 'unknown' END AS model,
    count(*) AS requests, sum(CASE WHEN role = 'assistant' THEN 0 ELSE coalesce(length(text), 0) // 4 END)::BIGINT AS input_tokens, sum(CASE WHEN role = 'assistant' THEN coalesce(length(text), 0) // 4 ELSE 0 END)::BIGINT AS output_tokens FROM conversations GROUP BY ALL) x""")
def llm_cost(spark, sf_dir):
    from ..functions.scalar import token_estimate

    names = F.element_at(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in MODELS]), (c("conv_id") % 6 + 1).cast("int"))
    tokens, answer = F.coalesce(token_estimate(c("text")), F.lit(0)), c("role") == "assistant"
    usage = table(spark, sf_dir, "conversations").select(names.alias("m"), F.when(answer, 0).otherwise(tokens).alias("input_tokens"), F.when(answer, tokens).otherwise(0).alias("output_tokens")).select("m.*", "input_tokens", "output_tokens")
    return metrics.costs(usage)


@frame("validate_events", lambda d: """
SELECT event_id, concat_ws(', ', CASE WHEN event_type NOT IN ('workflow_started', 'workflow_completed') THEN 'unknown event type' END, CASE WHEN event_id % 5 = 0 THEN 'unknown workflow type' END, CASE WHEN sequence % 10 = 0 THEN 'sequence' END) AS problems FROM workflow_events""", "workflow_events")
def validate_events(spark, sf_dir):
    rows = table(spark, sf_dir, "workflow_events").withColumn("workflow_type", F.when(c("event_id") % 5 == 0, "odd").otherwise("pr_review")).withColumn("sequence", F.when(c("sequence") % 10 == 0, 0).otherwise(c("sequence")))
    return rows.select("event_id", F.array_join(validate.event_problems(), ", ").alias("problems"))


@frame("event_sequence", lambda d: "SELECT workflow_id, event_id, sequence FROM workflow_events", "workflow_events")
def event_sequence(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("wf-"), c("user_id").cast("string")).alias("workflow_id"), "ts", "event_id")
    return ev.sequenced(events, "workflow_id", ["ts", "event_id"]).select("workflow_id", "event_id", "sequence")


@frame("events_since", lambda d: "SELECT workflow_id, event_id, sequence FROM (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY sequence) AS r FROM workflow_events WHERE sequence > 10) x WHERE r <= 50", "workflow_events")
def events_since(spark, sf_dir):
    return ev.since(table(spark, sf_dir, "workflow_events"), "workflow_id", 10, 50).select("workflow_id", "event_id", "sequence")


@frame("events_until_terminal", lambda d: "SELECT workflow_id, event_id, sequence FROM (SELECT *, min(CASE WHEN event_type IN ('workflow_completed', 'workflow_failed') THEN sequence END) OVER (PARTITION BY workflow_id) AS e FROM workflow_events) x WHERE e IS NULL OR sequence <= e", "workflow_events")
def events_until_terminal(spark, sf_dir):
    return ev.until_terminal(table(spark, sf_dir, "workflow_events"), "workflow_id").select("workflow_id", "event_id", "sequence")


@frame("event_latest_sequence", lambda d: "SELECT workflow_id, coalesce(max(sequence), 0) + 1 AS next_sequence FROM workflow_events GROUP BY workflow_id", "workflow_events")
def event_latest_sequence(spark, sf_dir):
    return table(spark, sf_dir, "workflow_events").groupBy("workflow_id").agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("next_sequence"))


def _breaker_sql(decay: bool):
    fewer = "greatest(failures - 1, 0)" if decay else "0"
    return lambda d: f"""
WITH RECURSIVE k AS (SELECT user_id, failed, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM (SELECT user_id, event_type IN ('error', 'view') AS failed, ts, event_id FROM events) e),
f AS (SELECT user_id, CAST(0 AS BIGINT) AS r, 'closed' AS state, 0 AS failures, 0 AS good, CAST(0 AS BIGINT) AS opened, 0 AS trips FROM (SELECT DISTINCT user_id FROM k) u
  UNION ALL SELECT user_id, r, CASE WHEN waiting THEN state WHEN opens THEN 'open' WHEN trial AND good2 >= 2 THEN 'closed' WHEN trial THEN 'half_open' ELSE 'closed' END,
    CASE WHEN waiting THEN failures WHEN opens OR (NOT trial AND failed) THEN failures + 1 WHEN trial AND good2 >= 2 THEN 0 WHEN trial THEN failures ELSE {fewer} END, CASE WHEN waiting THEN good WHEN trial AND NOT opens AND good2 < 2 THEN good2 ELSE 0 END,
    CASE WHEN NOT waiting AND opens THEN t ELSE opened END, CASE WHEN NOT waiting AND opens THEN trips + 1 ELSE trips END
  FROM (SELECT *, (trial AND failed) OR (NOT trial AND failed AND failures + 1 >= 3) AS opens, CASE WHEN state = 'half_open' THEN good ELSE 0 END + 1 AS good2 FROM (
    SELECT k.user_id, k.r, k.failed, k.t, f.state, f.failures, f.good, f.opened, f.trips, f.state = 'open' AND k.t - f.opened < 40000 AS waiting, f.state = 'half_open' OR (f.state = 'open' AND k.t - f.opened >= 40000) AS trial FROM f JOIN k ON k.user_id = f.user_id AND k.r = f.r + 1) a) b)
SELECT user_id, state, CAST(failures AS BIGINT) AS failures, CAST(trips AS BIGINT) AS trips FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY r DESC) AS last FROM f) x WHERE last = 1"""


def _calls(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", c("event_type").isin("error", "view").alias("failed"), F.floor(F.unix_timestamp(c("ts").cast("timestamp"))).cast("long").alias("at"))


@frame("breaker_consecutive", _breaker_sql(False))
def breaker_consecutive(spark, sf_dir):
    return breaker.breaker(_calls(spark, sf_dir), "user_id", ["ts", "event_id"], "failed", "at", threshold=3, wait=40_000, successes=2)


@frame("breaker_decay", _breaker_sql(True))
def breaker_decay(spark, sf_dir):
    return breaker.breaker(_calls(spark, sf_dir), "user_id", ["ts", "event_id"], "failed", "at", threshold=3, wait=40_000, successes=2, decay=True)


@frame("breaker_rollup", lambda d: "SELECT CASE max(CASE WHEN errors > 20 THEN 2 WHEN errors > 10 THEN 1 ELSE 0 END) WHEN 2 THEN 'open' WHEN 1 THEN 'half_open' ELSE 'closed' END AS worst, CAST(sum(errors) AS BIGINT) AS failures, count(*) AS breakers FROM (SELECT user_id, sum(CASE WHEN failed THEN 1 ELSE 0 END) AS errors FROM query_metrics GROUP BY user_id) x", "query_metrics")
def breaker_rollup(spark, sf_dir):
    errors = table(spark, sf_dir, "query_metrics").groupBy("user_id").agg(F.sum(c("failed").cast("long")).alias("errors"))
    worst = metrics.rollup(errors, "errors", 10, 20, ("closed", "half_open", "open")).select(c("overall").alias("worst"))
    return worst.crossJoin(errors.agg(F.sum("errors").alias("failures"), F.count(F.lit(1)).alias("breakers")))


@frame("snapshot_latest", lambda d: f"SELECT o_custkey AS repo_id, o_orderkey AS snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {d.t('orders')}) x WHERE r = 1")
def snapshot_latest(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(c("o_custkey").alias("repo_id"), c("o_orderkey").alias("snapshot_id"), "o_orderdate")
    return rows.groupBy("repo_id").agg(F.max_by("snapshot_id", F.struct("o_orderdate", "snapshot_id")).alias("snapshot_id"))


@frame("indexing_decision", lambda d: """
SELECT c_custkey AS repo_id, CASE WHEN c_custkey % 10 = 0 THEN 'forced' WHEN c_acctbal < 0 THEN 'sha_resolution_failed' WHEN s.o_custkey IS NULL OR s.latest % 5 = 0 THEN 'no_previous_snapshot' WHEN s.latest % 2 = c_custkey % 2 THEN 'sha_unchanged' ELSE 'sha_changed' END AS reason
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey) s ON s.o_custkey = c_custkey""")
def indexing_decision(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("repository_id")).agg(F.max("o_orderkey").alias("latest"))
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("repository_id"), F.when(c("c_acctbal") >= 0, c("c_custkey") % 2).alias("head"), (c("c_custkey") % 10 == 0).alias("forced")).join(orders, "repository_id", "left")
    stored = F.when(c("latest") % 5 != 0, c("latest") % 2)
    return rows.select(c("repository_id").alias("repo_id"), persist.indexing_reason(c("forced"), c("head"), c("latest").isNotNull(), stored).alias("reason"))


def _reviews(spark, sf_dir, kind: int):
    """Orders as reviews of a customer's pull requests: those before 1996 are stored, later ones new."""
    from .dialect import Dialect

    return spark.sql(_reviews_sql(Dialect(sf_dir), kind)).withColumnRenamed("moment", "at")


def _reviews_sql(d, kind: int) -> str:
    return f"SELECT o_custkey AS repository_id, o_orderkey % 3 AS pr_number, 'sha' || CAST(o_orderkey AS STRING) AS head_sha, 'base' || CAST(o_orderkey % 5 AS STRING) AS base_sha, o_orderkey AS moment FROM {d.t('orders')} WHERE o_orderkey % 4 {'=' if kind == 0 else '<>'} 0"


@frame("pr_upsert", lambda d: f"""
WITH old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repository_id, pr_number ORDER BY moment) AS r FROM ({_reviews_sql(d, 0)}) x) y WHERE r = 1),
new AS (SELECT *, row_number() OVER (PARTITION BY repository_id, pr_number ORDER BY moment DESC) AS r FROM ({_reviews_sql(d, 1)}) x)
SELECT coalesce(o.repository_id, n.repository_id) AS repository_id, coalesce(o.pr_number, n.pr_number) AS pr_number, CASE WHEN o.moment IS NULL THEN 'PR #' || CAST(n.pr_number AS STRING) ELSE 'Stored' END AS title, coalesce(n.head_sha, o.head_sha) AS head_sha, coalesce(n.base_sha, o.base_sha) AS base_sha,
  CASE WHEN o.moment IS NULL THEN 'open' ELSE 'closed' END AS state, coalesce(n.moment, o.moment) AS updated_at FROM old o FULL JOIN (SELECT * FROM new WHERE r = 1) n ON n.repository_id = o.repository_id AND n.pr_number = o.pr_number""")
def pr_upsert(spark, sf_dir):
    first = F.row_number().over(Window.partitionBy("repository_id", "pr_number").orderBy("at"))
    old = _reviews(spark, sf_dir, 0).withColumn("r", first).where("r = 1")
    stored = old.select("repository_id", "pr_number", F.lit("Stored").alias("title"), "head_sha", "base_sha", F.lit("closed").alias("state"), c("at").alias("updated_at"))
    pulls = Store(spark, scratch(spark, "pulls"), ["repository_id", "pr_number"], BUCKETS)
    pulls.append(stored, "first")
    for _ in range(2):  # the second time it is there already
        pulls.change(_reviews(spark, sf_dir, 1), persist.pull_requests, "reviews")
    return pulls.read()


@frame("review_run_status", lambda d: """
SELECT o_orderkey AS run_id, coalesce(ok, false) AS published, CASE WHEN ok IS NULL THEN 'pending' WHEN ok THEN 'published' ELSE 'failed' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, bool_or(l_returnflag <> 'R') AS ok FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1) l ON l_orderkey = o_orderkey""")
def review_run_status(spark, sf_dir):
    runs = persist.runs_started(spark.createDataFrame([], "run_id long, published boolean, status string"), table(spark, sf_dir, "orders").select(c("o_orderkey").alias("run_id")))
    outcomes = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 != 0").select(c("l_orderkey").alias("run_id"), (c("l_returnflag") != "R").alias("ok"))
    stored = Store(spark, scratch(spark, "runs"), ["run_id"], BUCKETS)
    stored.append(runs, "started")
    stored.change(outcomes, persist.runs_published, "published")
    return stored.read().select("run_id", "published", "status")


@frame("snapshot_append", lambda d: """
SELECT c.c_custkey AS repository_id, count(o.o_orderkey) + CASE WHEN c.c_custkey % 2 = 0 THEN 1 ELSE 0 END AS snapshots, CASE WHEN count(o.o_orderkey) > 0 THEN CAST(max(o.o_orderdate) AS STRING) WHEN c.c_custkey % 2 = 0 THEN '1990-01-01 00:00:00' END AS last_indexed_at
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def snapshot_append(spark, sf_dir):
    at = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    repositories = table(spark, sf_dir, "customer").select(c("c_custkey").alias("repository_id"), F.when(c("c_custkey") % 2 == 0, at).alias("last_indexed_at"))
    snapshots = repositories.where("last_indexed_at IS NOT NULL").select("repository_id", F.lit("s0").alias("snapshot_id"), F.lit(None).cast("string").alias("commit_sha"), c("last_indexed_at").alias("created_at"))
    indexed = table(spark, sf_dir, "orders").select(c("o_custkey").alias("repository_id"), F.concat(F.lit("s"), c("o_orderkey").cast("string")).alias("snapshot_id"), F.lit("abc").alias("commit_sha"), c("o_orderdate").cast("timestamp_ntz").alias("at"))
    more, left = persist.snapshots_added(snapshots, repositories, indexed)
    counts = more.groupBy("repository_id").agg(F.count(F.lit(1)).alias("snapshots"))
    return left.join(counts, "repository_id", "left").select("repository_id", F.coalesce("snapshots", F.lit(0)).alias("snapshots"), F.date_format("last_indexed_at", "yyyy-MM-dd HH:mm:ss").alias("last_indexed_at"))


@frame("findings_append", lambda d: """
SELECT f.ord, CASE WHEN f.ord % 4 <> 0 AND h.path IS NOT NULL THEN CAST(h.new_start + count(p.idx) AS BIGINT) WHEN f.ord % 3 = 0 THEN 7 ELSE 0 END AS line_number, f.category AS finding_type, CASE f.severity WHEN 'blocker' THEN 'CRITICAL' ELSE upper(f.severity) END AS severity
FROM findings f LEFT JOIN hunks h ON h.doc_id = f.ord AND h.hunk = f.ord % 2 LEFT JOIN patch_lines p ON p.path = h.path AND p.hunk = h.hunk AND p.mark <> '-' AND p.idx < f.ord % 9 GROUP BY f.ord, f.category, f.severity, h.path, h.new_start""", "findings", "hunks", "patch_lines")
def findings_append(spark, sf_dir):
    lines = table(spark, sf_dir, "patch_lines").groupBy("path", "hunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat("mark", "content").alias("line")))), lambda x: x["line"]).alias("lines"))
    hunks = table(spark, sf_dir, "hunks").join(lines, ["path", "hunk"]).select(F.concat_ws("-", c("doc_id").cast("string"), c("hunk").cast("string")).alias("hunk_id"), "new_start", "lines", c("hunk").alias("place"))
    found = table(spark, sf_dir, "findings").select("ord", F.lit("run").alias("run_id"), "file_path", F.concat_ws("-", c("ord").cast("string"), (c("ord") % 2).cast("string")).alias("hunk_id"), F.when(c("ord") % 4 != 0, c("ord") % 9).alias("line_in_hunk"), F.when(c("ord") % 3 == 0, 7).alias("line_number"), "severity", "category", "message", F.lit(None).cast("string").alias("suggested_fix"))
    stored = Store(spark, scratch(spark, "findings"), ["ord"], BUCKETS)
    for _ in range(2):
        stored.append(persist.findings_stored(found, hunks), "run")
    return stored.read().select("ord", "line_number", "finding_type", "severity")


@frame("installation_upsert", lambda d: """
SELECT n_nationkey AS installation_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE max(s_name) END AS account, CASE WHEN count(s_suppkey) > 0 THEN max(s_suppkey) WHEN n_nationkey % 2 = 0 THEN 0 END AS updated_at
FROM nation LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier) q) s ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING n_nationkey % 2 = 0 OR count(s_suppkey) > 0""".replace("max(s_name)", "min(CASE WHEN r = 1 THEN s_name END)"))
def installation_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(c("n_nationkey").cast("long").alias("installation_id"), c("n_name").alias("account"), F.lit(0).cast("long").alias("updated_at"))
    created = table(spark, sf_dir, "supplier").select(c("s_nationkey").cast("long").alias("installation_id"), c("s_name").alias("account"), c("s_suppkey").alias("updated_at"))
    kept = Store(spark, scratch(spark, "installations"), ["installation_id"], BUCKETS)
    kept.append(stored, "first")
    kept.change(created, persist.installations, "created")
    return kept.read()


@frame("webhook_routing", lambda d: "SELECT event_id, CASE WHEN event_id % 7 IN (3, 5) THEN 'rejected' WHEN event_id % 4 = 0 THEN 'review' WHEN event_id % 8 = 1 THEN 'installation' WHEN event_id % 4 = 2 THEN 'index' ELSE 'ignored' END AS route FROM events")
def webhook_routing(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ("pull_request", "installation", "push", "odd"))), (c("event_id") % 4 + 1).cast("int"))
    action = F.when(c("event_id") % 4 == 0, "opened").when(c("event_id") % 4 == 1, F.when(c("event_id") % 8 == 1, "created").otherwise("renamed")).otherwise("")
    good = F.concat(F.lit("sha256="), webhook.hmac_sha256(c("props"), b"key"))
    rows = events.select("event_id", kind.alias("event"), action.alias("action"), c("props").alias("payload"), F.when(c("event_id") % 7 == 3, "sha256=00").when(c("event_id") % 7 == 5, None).otherwise(good).alias("signature"))
    return webhook.routed(rows, b"key").select("event_id", "route")


@frame("webhook_rejections", lambda d: """
SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_id % 4 = 2 THEN 'unsupported action' WHEN event_id % 7 = 3 OR event_id % 9 = 4 OR (user_id = 0 AND event_id % 25 <= 22) THEN 'missing fields' WHEN event_id % 5 = 1 THEN 'fork' WHEN event_id % 25 > 22 OR c_custkey IS NULL THEN 'unknown repository' ELSE 'accepted' END AS outcome,
  CASE WHEN NOT (event_id % 4 = 2 OR event_id % 7 = 3 OR event_id % 9 = 4 OR event_id % 5 = 1 OR event_id % 25 > 22) AND c_custkey IS NOT NULL THEN c_custkey END AS repo_id
FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) k ON c_custkey = user_id""")
def webhook_rejections(spark, sf_dir):
    """Deliveries about pull requests: of forks, without a field, of repositories that nobody has indexed; and those that lead to a review."""
    id_, text = c("event_id"), lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    head = F.when(id_ % 5 == 1, F.lit("fork/x")).otherwise("o/x")
    payload = F.concat(
        F.lit('{"action": "'), F.when(id_ % 4 == 2, "closed").otherwise("opened"), F.lit('", "pull_request": {"number": '), F.when(id_ % 9 == 4, "0").otherwise("7"), F.lit(', "head": {"sha": '), F.when(id_ % 7 == 3, "null").otherwise('"ab"'), F.lit(', "repo": {"full_name": '), text(head),
        F.lit('}}, "base": {"sha": "cd", "repo": {"full_name": "o/x"}}}, "repository": {"id": '), F.when(id_ % 25 > 22, "-1").otherwise(c("user_id").cast("string")), F.lit(', "full_name": "o/x"}, "installation": {"id": 5}}'),
    )
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 != 0").select(c("c_custkey").alias("github_repo_id"), c("c_custkey").alias("repo_id"))
    return webhook.review_requests(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")), known).select("event_id", "outcome", "repo_id")


@frame("webhook_validation", lambda d: "SELECT event_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AS valid, CASE WHEN event_id % 2 = 0 THEN 'dev' ELSE 'main' END AS branch, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'o/' || CAST(user_id AS STRING) END AS full_name FROM events")
def webhook_validation(spark, sf_dir):
    id_, name = c("event_id").cast("string"), c("user_id").cast("string")
    payload = F.concat(F.lit('{"repository": {"id": '), F.when(c("event_id") % 3 == 0, '"x"').otherwise(id_), F.lit(', "full_name": "'), F.when(c("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("o/"), name)), F.lit('"'), F.when(c("event_id") % 2 == 0, ', "default_branch": "dev"').otherwise(""), F.lit('}, "installation": {"id": 1}}'))
    return table(spark, sf_dir, "events").select("event_id", webhook.repository_of(payload).alias("r")).select("event_id", "r.valid", "r.branch", "r.full_name")


@frame("date_cutoffs", lambda d: f"SELECT event_id, ts >= {d.seconds_before(chr(39) + NOW + chr(39), 604800)} AS in_week, ts >= {d.seconds_before(chr(39) + NOW + chr(39), 86400)} AS in_day FROM {d.t('events')}")
def date_cutoffs(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", metrics.within(c("ts"), now, 604_800).alias("in_week"), metrics.within(c("ts"), now, 86_400).alias("in_day"))


@frame("fs_files_lines", lambda d: "SELECT doc_id, n, length(content) AS width FROM doc_lines", "doc_lines")
def fs_files_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", (c("n") + 1).cast("long").alias("n"), F.length("line").alias("width"))


@frame("fs_text_files", lambda d: f"SELECT node_id, path FROM kg_texts WHERE {d.matches('path', '[.](md|txt|rst|markdown)$')}", "kg_texts")
def fs_text_files(spark, sf_dir):
    from ..sources import tree

    return tree.text_files(table(spark, sf_dir, "kg_texts")).select("node_id", "path")


@frame("fs_incremental", lambda d: "SELECT path, 'found' AS outcome FROM kg_files WHERE kind = 'file' AND path IN (SELECT path FROM changed_lines) UNION ALL SELECT 'gone.py', 'failed'", "kg_files", "changed_lines")
def fs_incremental(spark, sf_dir):
    from ..sources import tree

    changed = table(spark, sf_dir, "changed_lines").select("path").distinct().union(spark.createDataFrame([("gone.py",)], "path string"))
    return tree.incremental(table(spark, sf_dir, "kg_files").where("kind = 'file'").select("path"), changed)


