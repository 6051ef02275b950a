"""Streams that are alive: heartbeats of idle workflows, pages, clients that come back, batches that are repeated, deliveries sent twice."""

import json
import time

import pytest
from pyspark.sql import functions as F

from lathe.operators import report
from lathe.sources import sinks, webhook
from lathe.sources.store import Store
from lathe.streaming import live

EVENTS = "workflow_id string, sequence long, event_type string, event_id long"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live.PROVIDER)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run_until(query, done, seconds=150):
    end = time.time() + seconds
    try:
        while time.time() < end and not done():
            assert query.exception() is None, query.exception()
            time.sleep(0.5)
        return done()
    finally:
        query.stop()


def test_an_idle_workflow_beats_and_a_client_resumes_in_mid_page(rocks, tmp_path):
    spark, (source, out, check) = rocks, (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    rows = [("wf-a", n, "activity_completed", 1000 + n) for n in range(1, 31)] + [("wf-b", 1, "activity_started", 1), ("wf-b", 2, "workflow_completed", 2), ("wf-b", 3, "activity_started", 3)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(source)
    cursors = spark.createDataFrame([("wf-a", 7)], "workflow_id string, last_event_id long")
    store = Store(spark, f"file://{out}", ["workflow_id", "sequence", "kind"], 2)

    def start():
        stream = spark.readStream.schema(EVENTS).parquet(source)
        frames = live.live_tail(stream, cursors, page=10, poll=100, beat=1500)
        return frames.writeStream.foreachBatch(sinks.append_batch(store, "tail")).option("checkpointLocation", check).outputMode("append").trigger(processingTime="1 second").start()

    def seen(kind):
        return sorted((r.workflow_id, r.sequence) for r in store.read().where(F.col("kind") == kind).collect()) if store.versions() else []

    # Stopped after a page; the rest comes after a restart from the same checkpoint.
    assert run_until(start(), lambda: len(seen("activity")) >= 12)
    assert run_until(start(), lambda: len(seen("activity")) >= 25 and len(seen("heartbeat")) >= 2)
    assert seen("activity") == [("wf-a", n) for n in range(8, 31)] + [("wf-b", 1), ("wf-b", 2)]
    assert seen("close") == [("wf-b", 2)] and set(seen("heartbeat")) == {("wf-a", 30)}
    frame = store.read().where("workflow_id = 'wf-a' AND sequence = 8 AND kind = 'activity'").first().frame
    assert frame.startswith("event: activity\nid: 8\ndata: ") and json.loads(frame.split("data: ")[1])["event_id"] == 1008


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "x", 1), ("b", 1, "y", 2)], EVENTS)
    store = Store(spark, f"file://{tmp_path}/s", ["workflow_id"], 2)
    each = sinks.append_batch(store, "q")
    each(rows, 0)
    each(rows, 0)
    each(rows.limit(1), 1)
    assert store.read().count() == 3 and store.manifest()["tokens"] == {"q-0": 1, "q-1": 2}
    groups = Store(spark, f"file://{tmp_path}/g", ["workflow_id"], 2)
    each = sinks.upsert_batch(groups, "q")
    each(rows, 0)
    each(rows.where("workflow_id = 'a'").withColumn("sequence", F.lit(5).cast("long")), 1)
    each(rows, 0)
    assert sorted((r.workflow_id, r.sequence) for r in groups.read().collect()) == [("a", 5), ("b", 1)]


def test_deliveries_sent_twice_come_once(spark, tmp_path):
    schema = "delivery_id string, at timestamp, payload string"
    rows = [("1", "2024-01-01 00:00:00", "a"), ("2", "2024-01-01 00:01:00", "b"), ("1", "2024-01-01 00:02:00", "a")]
    frame = spark.createDataFrame(rows, "delivery_id string, at string, payload string").withColumn("at", F.col("at").cast("timestamp"))
    for k in range(2):
        frame.coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = webhook.unique_deliveries(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in"))
    store = Store(spark, f"file://{tmp_path}/s", ["delivery_id"], 2)
    got = sinks.appended_to(stream, store, f"{tmp_path}/check")
    assert sorted((r.delivery_id, r.payload) for r in got.collect()) == [("1", "a"), ("2", "b")]


def test_review_requests_by_outcome(spark):
    def payload(action="opened", number=3, head="a", repo=7, fork="o/x", installation=1):
        return json.dumps({"action": action, "pull_request": {"number": number, "head": {"sha": head, "repo": {"full_name": fork}}, "base": {"sha": "b", "repo": {"full_name": "o/x"}}}, "repository": {"id": repo, "full_name": "o/x"}, "installation": {"id": installation} if installation else {}})

    rows = [payload(), payload(action="closed"), payload(number=None), payload(head=""), payload(fork="me/x"), payload(repo=8), payload(installation=None), "no json", None, payload("reopened")]
    known = spark.createDataFrame([(7, 70), (7, 71)], "github_repo_id long, repo_id long")
    got = webhook.review_requests(spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "i int, payload string"), known).orderBy("i").collect()
    assert [r.outcome for r in got] == ["accepted", "unsupported action", "missing fields", "missing fields", "fork", "unknown repository", "missing fields", "unsupported action", "unsupported action", "accepted"]
    assert [(r.repo_id, r.pr_number, r.head_sha, r.base_sha) for r in got[:2]] == [(70, 3, "a", "b"), (None, None, None, None)]


def test_payload_of_a_review(spark):
    found = [("r", 1, "f.py", "high", "T", "Message", "x = 1", "bug", 0.9, 4), ("r", 2, "f.py", "low", "U", "Other", "plain", "style", None, None), ("r", 3, "g.py", "blocker", "V", "", "", "bug", 0.5, 9)]
    findings = spark.createDataFrame(found, "review string, ord long, file_path string, severity string, title string, message string, suggested_fix string, category string, confidence double, position long")
    reviews = spark.createDataFrame([("r", "sha", "Sum."), ("s", "sha2", "None.")], "review string, commit_id string, summary string")
    got = {r.review: json.loads(r.payload) for r in report.payloads(reviews, findings, ["review"], 1, 5).collect()}
    assert got["s"] == {"commit_id": "sha2", "body": "## Summary\n\nNone.\n", "event": "COMMENT", "comments": []}
    assert got["r"]["comments"] == [{"path": "g.py", "position": 9, "body": "[BLOCKER] **V**\n\n*Category: bug*\n\n*Confidence: 50%*"}]
    assert got["r"]["body"].endswith("#### [LOW] U\n**File:** `f.py`\n*Severity: low | Category: style*\n\nOther\n\n**Suggested Fix:**\nplain\n\n*Confidence: 0%*\n")
