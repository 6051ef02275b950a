"""Queries that need Python: text chunks, name similarity, boundaries, repairs and spreading; and the streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, names, report, text
from ..sources import sinks
from ..sources.store import Store, scratch
from ..streaming import events as streams
from .dialect import frame, table

c = F.col
#: Buckets of the stores that queries write.
BUCKETS = 8

CHUNK_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS start_at, CASE WHEN n <= 1000 THEN n ELSE {cut0} END AS reach FROM t
  UNION ALL SELECT doc_id, chunk + 1, start_at, {cut} FROM (SELECT t.doc_id, t.text, t.n, s.chunk, s.reach - 200 AS start_at FROM s JOIN t ON t.doc_id = s.doc_id WHERE t.n > 1000 AND s.reach - 200 > 0 AND s.reach - 200 < t.n) x
), r AS (SELECT s.doc_id, chunk, start_at AS "begin", least(reach, n) AS "end", text FROM s JOIN t ON t.doc_id = s.doc_id),
chunks AS (SELECT doc_id, chunk, "begin", "end", CAST(len(substr(text, "begin" + 1, "end" - "begin")) - len(replace(substr(text, "begin" + 1, "end" - "begin"), chr(10), '')) AS BIGINT) AS lines FROM r)
"""
WINDOW = "reverse(substr(text, {b} + 801, 200))"


def _cut(b: str) -> str:
    w = WINDOW.format(b=b)
    return f"CASE WHEN {b} + 1000 >= n THEN {b} + 1000 WHEN instr({w}, chr(10)) > 0 THEN {b} + 1001 - instr({w}, chr(10)) WHEN instr({w}, ' ') > 0 THEN {b} + 1001 - instr({w}, ' ') ELSE {b} + 1000 END"


_CHUNKS = CHUNK_SQL.format(cut0=_cut("0"), cut=_cut("start_at"))


@frame("text_chunks", lambda d: _CHUNKS + 'SELECT doc_id, chunk, "begin", "end", lines FROM chunks')
def text_chunks(spark, sf_dir):
    return text.text_chunks(table(spark, sf_dir, "documents"))


@frame("next_chunk_edges", lambda d: _CHUNKS + "SELECT doc_id, chunk AS src, next_chunk AS dst FROM (SELECT doc_id, chunk, lead(chunk) OVER (PARTITION BY doc_id ORDER BY chunk) AS next_chunk FROM chunks) x WHERE next_chunk IS NOT NULL")
def next_chunk_edges(spark, sf_dir):
    return text.linked_chunks(text.text_chunks(table(spark, sf_dir, "documents"))).where("next_chunk IS NOT NULL").select("doc_id", c("chunk").alias("src"), c("next_chunk").alias("dst"))


@frame("chunk_line_offsets", lambda d: _CHUNKS + "SELECT doc_id, chunk, CAST(coalesce(sum(lines) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS first_line FROM chunks")
def chunk_line_offsets(spark, sf_dir):
    return text.linked_chunks(text.text_chunks(table(spark, sf_dir, "documents"))).select("doc_id", "chunk", "first_line")


@frame("rank_name_similarity")
def rank_name_similarity(spark, sf_dir):
    symbols = table(spark, sf_dir, "kg_symbols").select("node_id", "name")
    return names.best_name_similarity(symbols, table(spark, sf_dir, "seeds").select("name")).select("node_id", F.round("similarity", 6).alias("similarity"))


@frame("snippet_truncate_boundary")
def snippet_truncate_boundary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.boundary_truncated("text", F.lit(2000)).alias("snippet"))


@frame("json_repair_literal")
def json_repair_literal(spark, sf_dir):
    return table(spark, sf_dir, "llm_responses").select("conv_id", "turn", text.json_repaired("raw").alias("body"))


@frame("anchor_spread")
def anchor_spread(spark, sf_dir):
    """Findings of every document, four in each of two hunks, of which some want one line."""
    four = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")
    found = table(spark, sf_dir, "findings").select("ord", four).select((c("ord") * 8 + c("k")).alias("ord"), c("ord").alias("doc_id"), (c("k") % 2).cast("long").alias("hunk"), ((c("ord") + F.floor(c("k") / 4)) % 7).alias("line"))
    hunks = table(spark, sf_dir, "hunks").select("doc_id", "hunk", c("path").alias("file"), "n_lines")
    return text.spread(found.join(hunks, ["doc_id", "hunk"]).select("file", "hunk", "ord", "line", "n_lines"))


def _payload_sql(d) -> str:
    line = "'[' || upper(severity) || '] **' || title || '**' || chr(10) || chr(10) || '*Category: ' || category || '*' || chr(10) || chr(10) || message || chr(10) || chr(10) || '*Confidence: ' || printf('%.0f', coalesce(confidence, 0) * 100) || '%*'"
    section = "'#### [' || upper(severity) || '] ' || title || chr(10) || '**File:** `' || file_path || '`' || chr(10) || '*Severity: ' || severity || ' | Category: ' || category || '*' || chr(10) || chr(10) || message || chr(10) || chr(10) || '*Confidence: ' || printf('%.0f', coalesce(confidence, 0) * 100) || '%*' || chr(10)"
    return f"""
SELECT * FROM (WITH f AS (SELECT *, row_number() OVER (PARTITION BY file_path, anchored ORDER BY CASE severity WHEN 'blocker' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, coalesce(confidence, 0) DESC, ord) AS r FROM findings WHERE message IS NOT NULL),
g AS (SELECT file_path, count(*) AS total, string_agg({section}, chr(10) ORDER BY r) FILTER (NOT anchored AND r <= 10) AS extra, list({{'path': file_path, 'position': ord % 9 + 1, 'body': {line}}} ORDER BY r) FILTER (anchored AND r <= 20) AS comments FROM f GROUP BY file_path)
SELECT file_path, 'sha-' || file_path AS commit_id, 'COMMENT' AS event, '## Summary' || chr(10) || chr(10) || total || ' findings' || chr(10) || CASE WHEN extra IS NOT NULL THEN chr(10) || '## Additional Findings' || chr(10) || chr(10) || '*The following findings could not be anchored to specific diff locations:*' || chr(10) || chr(10) || extra ELSE '' END AS body,
  coalesce(len(comments), 0)::BIGINT AS comments, comments[1].position::BIGINT AS first_position, comments[1].body AS first_body FROM g) x"""


@frame("review_payload_json", _payload_sql, "findings")
def review_payload_json(spark, sf_dir):
    """Payloads of one review for each file, written to a store under a token, then again under the same, and parsed back from the JSON that it holds."""
    found = table(spark, sf_dir, "findings").where("message IS NOT NULL").select("*", c("file_path").alias("review"), F.when(c("anchored"), c("ord") % 9 + 1).alias("position"), F.lit("").alias("suggested_fix"))
    reviews = found.groupBy("review").agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" findings")).alias("summary")).withColumn("commit_id", F.concat(F.lit("sha-"), c("review")))
    store = Store(spark, scratch(spark, "reviews"), ["review"], BUCKETS)
    for _ in range(2):
        store.append(report.payloads(reviews, found, ["review"], 20, 10), "publish")
    read = F.from_json("payload", "commit_id string, body string, event string, comments array<struct<path: string, position: long, body: string>>").alias("p")
    first = F.try_element_at("p.comments", F.lit(1))
    return store.read().select("review", read).select(c("review").alias("file_path"), "p.commit_id", "p.event", "p.body", F.size("p.comments").cast("long").alias("comments"), first["position"].alias("first_position"), first["body"].alias("first_body"))


@frame("metrics_json", lambda d: """
SELECT query_type, count(*) AS n, sum(CASE WHEN failed THEN 1 ELSE 0 END)::BIGINT AS failures, round(avg(ms), 2) AS mean, round(min(ms), 2) AS least, round(max(ms), 2) AS most FROM query_metrics GROUP BY query_type""", "query_metrics")
def metrics_json(spark, sf_dir):
    """The figures of each kind of query as JSON, written once under a token and parsed back."""
    store = Store(spark, scratch(spark, "metrics"), ["query_type"], BUCKETS)
    for _ in range(2):
        store.append(metrics.exported(table(spark, sf_dir, "query_metrics"), "query_type"), "export")
    return store.read().select("query_type", F.from_json("metrics", "n long, failures long, mean double, least double, most double").alias("m")).select("query_type", "m.*")


@frame("stream_event_sequence", lambda d: "SELECT 'wf-' || CAST(user_id AS STRING) AS workflow_id, count(*) AS last_sequence FROM events GROUP BY user_id")
def stream_event_sequence(spark, sf_dir):
    store = Store(spark, scratch(spark, "sequences"), ["workflow_id"], BUCKETS)
    return sinks.upserted_to(streams.next_sequences(streams.event_stream(spark, sf_dir)), store, scratch(spark, "checkpoint"))


@frame("stream_metrics_window", lambda d: "SELECT CAST(time_bucket(INTERVAL '5 minutes', ts) AS STRING) AS start_at, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_metrics_window(spark, sf_dir):
    store = Store(spark, scratch(spark, "windows"), ["start_at", "event_type"], BUCKETS)
    return sinks.upserted_to(streams.windowed(streams.event_stream(spark, sf_dir)), store, scratch(spark, "checkpoint")).select(F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"), "event_type", "n", F.round("total", 4).alias("total"))


def _folders(spark) -> tuple[str, str]:
    """Folders for a stream's rows and its checkpoint, below the one that the cluster shares."""
    name = scratch(spark, "stream")
    return f"{name}/rows", f"{name}/checkpoint"


@frame("stream_event_tail", lambda d: """
SELECT workflow_id, count(*) AS delivered, max(sequence) AS last_sequence FROM (SELECT *, min(CASE WHEN event_type = 'workflow_completed' THEN sequence END) OVER (PARTITION BY workflow_id) AS e FROM workflow_events) x WHERE e IS NULL OR sequence <= e GROUP BY workflow_id""", "workflow_events")
def stream_event_tail(spark, sf_dir):
    tail = streams.written(streams.appended(streams.event_stream(spark, sf_dir), until_end=True), *_folders(spark))
    return tail.groupBy("workflow_id").agg(F.count(F.lit(1)).alias("delivered"), F.max("sequence").alias("last_sequence"))


@frame("stream_event_append", lambda d: "SELECT workflow_id, event_id, sequence FROM workflow_events", "workflow_events")
def stream_event_append(spark, sf_dir):
    return streams.written(streams.appended(streams.event_stream(spark, sf_dir)), *_folders(spark)).select("workflow_id", "event_id", "sequence")


def _frames_sql(d):
    return """
SELECT workflow_id, sequence, 'event: activity' || chr(10) || 'id: ' || sequence || chr(10) || 'data: {"workflow_id":"' || workflow_id || '","sequence_number":' || sequence || ',"event_type":"' || event_type || '","event_id":' || event_id || '}' || chr(10) || chr(10)
  || CASE WHEN event_type = 'workflow_completed' THEN 'event: close' || chr(10) || 'data: {"reason":"workflow_completed"}' || chr(10) || chr(10) ELSE '' END AS frame FROM workflow_events"""


@frame("event_frames", _frames_sql, "workflow_events")
def event_frames(spark, sf_dir):
    return streams.frames(table(spark, sf_dir, "workflow_events"))


@frame("stream_event_frames", lambda d: f"SELECT workflow_id, sequence FROM ({_frames_sql(d)}) f", "workflow_events")
def stream_event_frames(spark, sf_dir):
    """Frames of a stream in a store that takes each batch once, also when all batches come again."""
    store = Store(spark, scratch(spark, "frames"), ["workflow_id", "sequence"], BUCKETS)
    for _ in range(2):  # the second time from a new checkpoint, so every batch is repeated with its number
        sinks.appended_to(streams.frames(streams.appended(streams.event_stream(spark, sf_dir))), store, scratch(spark, "checkpoint"))
    return store.read().select("workflow_id", "sequence")


@frame("stream_heartbeat_frames", lambda d: """
SELECT workflow_id, CAST(ts AS STRING) AS after, CAST(floor((floor(epoch(next)) - floor(epoch(ts)) - 1) / 30) AS BIGINT) AS beats FROM (SELECT *, lead(ts) OVER (PARTITION BY workflow_id ORDER BY ts) AS next FROM workflow_events) x WHERE floor((floor(epoch(next)) - floor(epoch(ts)) - 1) / 30) >= 1""", "workflow_events")
def stream_heartbeat_frames(spark, sf_dir):
    return streams.heartbeats(table(spark, sf_dir, "workflow_events").select("workflow_id", "ts")).select("workflow_id", F.col("after").cast("timestamp_ntz").cast("string").alias("after"), "beats")
