"""Streaming jobs over the given tables, run to the end and compared with the batch answer."""

import uuid

from pyspark.sql import functions as F

from lakesearch.catalog.bindings import DOCS, FEEDBACK, hashed_documents, table, with_
from lakesearch.catalog.measures import KEYED, UPSERTS, WALK
from lakesearch.catalog.registry import query
from lakesearch.catalog.tables import RECONCILED, VERSIONS, numbered_versions
from lakesearch.session import materialise, shared_dir
from lakesearch.sources import files
from lakesearch.streaming import changes, feedback, keyed_state, reconcile, tables


def folder(spark):
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def stream(spark, sf, name):
    """A given table as a file stream."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


def feedback_stream(spark, sf):
    kind = F.col("event_type")
    return stream(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("experience_id"), F.col("ts").cast("timestamp").alias("occurred_at"),
        F.when(kind == "purchase", "success").when(kind == "error", "failure").otherwise("neutral").alias("outcome"),
    )


def finish(spark, rows, path, keys, mode="update"):
    tables.run_to_end(tables.write_updates(rows, path, f"{path}-checkpoint", mode))
    return tables.latest(spark, path, keys, rows.schema)


@query("z01_feedback_counters", with_(FEEDBACK, "SELECT experience_id, count(*) AS usage_count, count(*) FILTER (WHERE outcome = 'success') AS success_count, count(*) FILTER (WHERE outcome = 'failure') AS failure_count FROM feedback GROUP BY experience_id"))
def feedback_counters(spark, sf):
    events = feedback_stream(spark, sf)
    return finish(spark, feedback.counters(events.unionByName(events.where("outcome = 'success'"))), folder(spark), ["experience_id"])


@query("z07_windowed_rates", with_(FEEDBACK, "SELECT date_trunc('hour', occurred_at) AS window_start, experience_id, count(*) AS events, round(avg((outcome = 'failure')::INT), 6) AS failure_rate FROM feedback GROUP BY ALL"))
def windowed_rates(spark, sf):
    rows = feedback.windowed_rates(feedback_stream(spark, sf), "experience_id")
    out = finish(spark, rows, folder(spark), ["window_start", "experience_id"])
    return out.select("window_start", "experience_id", "events", F.round("failure_rate", 6).alias("failure_rate"))


@query(
    "z07_sliding_rates",
    with_(FEEDBACK, "SELECT date_trunc('hour', occurred_at) - INTERVAL (h) HOUR AS window_start, outcome, count(*) AS events FROM feedback, (SELECT unnest([0, 1, 2, 3]) AS h) GROUP BY ALL"),
)
def sliding_rates(spark, sf):
    rows = feedback.windowed_rates(feedback_stream(spark, sf), "outcome", "4 hours", "1 hour")
    return finish(spark, rows, folder(spark), ["window_start", "outcome"]).select("window_start", "outcome", "events")


@query("z06_lifecycle", with_(WALK.replace("status AS now FROM items", "'candidate' AS now FROM (SELECT DISTINCT user_id AS experience_id FROM events)"), "SELECT experience_id, seq, before AS from_status, now AS to_status FROM walk WHERE before IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def lifecycle(spark, sf):
    kind = F.col("event_type")
    target = F.when(kind == "signup", "pending").when(kind == "purchase", "proven").when(kind == "error", "deprecated").when(kind == "view", "archived").otherwise("candidate")
    rows = keyed_state.lifecycle(stream(spark, sf, "events").select(F.col("user_id").alias("experience_id"), target.alias("target"), F.col("event_id").alias("seq")))
    path = folder(spark)
    tables.run_to_end(tables.write_updates(rows, path, f"{path}-checkpoint", "append", keyed=True))
    return spark.read.schema(rows.schema).parquet(f"{path}/batch=*")


@query("v05_reconcile_stream", with_(VERSIONS, RECONCILED, "SELECT version_id, status, document_id FROM reconciled"))
def reconcile_stream(spark, sf):
    """Versions and job outcomes as two streams; what has been closed when both have ended."""
    path, priority = folder(spark), F.col("o_orderpriority")
    orders, held = table(spark, sf, "orders"), materialise(numbered_versions(spark, sf), "stream-versions")
    held.join(orders.select(F.col("o_orderkey").alias("version_id"), F.col("o_orderdate").cast("timestamp").alias("created_at")), "version_id").write.parquet(f"{path}/versions")
    status = F.when(priority == "1-URGENT", "succeeded").when(priority == "2-HIGH", "deduplicated").when(priority == "3-MEDIUM", "running").when(priority == "5-LOW", "cancelled").otherwise("failed")
    jobs = orders.select(F.col("o_orderkey").alias("ingest_job_id"), status.alias("job_status"), (F.col("o_orderkey") + 5).alias("document_id"), F.timestamp_add("HOUR", F.lit(5), F.col("o_orderdate").cast("timestamp")).alias("ended_at"))
    jobs.write.parquet(f"{path}/jobs")
    read = lambda name: spark.readStream.schema(spark.read.parquet(f"{path}/{name}").schema).parquet(f"{path}/{name}")
    rows = reconcile.closings(read("versions"), read("jobs"))
    tables.run_to_end(tables.write_updates(rows, f"{path}/out", f"{path}-checkpoint", "append"))
    return reconcile.closed(held, spark.read.schema(rows.schema).parquet(f"{path}/out/batch=*")).select("version_id", "status", "document_id")


@query("z03_keyed_requests", KEYED)
def keyed_requests(spark, sf):
    requests = stream(spark, sf, "events").select(
        F.col("event_type").alias("actor"), F.col("user_id").alias("key"), F.when(F.col("value") > 30, "a").otherwise("b").alias("request_hash"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"),
    )
    rows = keyed_state.keyed_requests(requests, 2 * 86400)
    path = folder(spark)
    tables.run_to_end(tables.write_updates(rows, path, f"{path}-checkpoint", "append", keyed=True))
    return spark.read.schema(rows.schema).parquet(f"{path}/batch=*").select("seq", "outcome")


@query(
    "z02_upsert_stream",
    with_(UPSERTS, "SELECT source_system, external_id, max(revision) AS source_revision, arg_max(fp, (revision, -epoch_us(ts), -event_id)) AS fingerprint FROM ups GROUP BY ALL"),
)
def upsert_stream(spark, sf):
    rows = stream(spark, sf, "events").select(
        F.col("event_type").alias("source_system"), F.col("user_id").alias("external_id"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("source_revision"),
        F.md5(F.floor(F.col("value") / 40).cast("string")).alias("fingerprint"), "ts", "event_id",
    )
    path = folder(spark)
    running = changes.upsert_stream(rows, path, f"{path}-checkpoint", F.date_trunc("DAY", "ts"), [("ts", "timestamp"), ("event_id", "bigint")])
    tables.run_to_end(running)
    newest = max(p["batchId"] for p in running.recentProgress if p["numInputRows"])
    return spark.read.parquet(f"{path}/snapshot-{newest}")


@query("z04_new_pages", with_(DOCS, "SELECT kb_id, content_hash, min(document_id) AS page_id FROM docs GROUP BY kb_id, content_hash"))
def new_pages(spark, sf):
    rows = stream(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("kb_id"), F.lit("u").alias("url_hash"), F.sha2("text", 256).alias("content_hash"))
    path = folder(spark)
    tables.run_to_end(changes.new_pages(rows, path, f"{path}-checkpoint"))
    return spark.read.parquet(f"{path}/batch=*").select("kb_id", "content_hash", "page_id")


@query("z05_sync_stream")
def sync_stream(spark, sf):
    found = files.scan_stream(spark, sf, "*.parquet")
    items = found.select(F.lit("root").alias("kb_id"), F.concat(F.lit("sync://root/"), F.regexp_extract("path", r"([^/]+)$", 1)).alias("source_uri"), "content_hash")
    snapshot = hashed_documents(spark, sf).select("kb_id", "source_uri", "content_hash", "status")
    path = folder(spark)
    tables.run_to_end(changes.sync_stream(items, snapshot, path, f"{path}-checkpoint"))
    return spark.read.parquet(f"{path}/actions/batch=*").select("source_uri", "action")


@query("z08_command_stream", "SELECT CASE WHEN event_type = 'error' THEN 'not_json' WHEN event_type = 'click' THEN 'schema_version' WHEN event_type = 'view' THEN 'event_type' ELSE 'good' END AS result, count(*) AS messages FROM events GROUP BY 1")
def command_stream(spark, sf):
    kind = F.col("event_type")
    good = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), F.when(kind == "view", "unknown").otherwise("crawler.run").alias("event_type"), F.col("user_id").cast("string").alias("aggregate_id"),
        F.when(kind == "click", 2).otherwise(1).alias("schema_version"),
    ))
    messages = stream(spark, sf, "events").select(F.encode(F.when(kind == "error", "{broken").otherwise(good), "UTF-8").alias("body"))
    path = folder(spark)
    tables.run_to_end(changes.route_commands(messages, path, f"{path}-checkpoint"))
    done = spark.read.parquet(f"{path}/commands/batch=*").select(F.lit("good").alias("result"))
    dead = spark.read.parquet(f"{path}/dead/batch=*").select(F.col("problem").alias("result"))
    return done.unionByName(dead).groupBy("result").agg(F.count("*").alias("messages"))
