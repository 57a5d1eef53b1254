"""Collected pages: extraction, cleaning, routing, review and run reports."""

from pyspark.sql import functions as F

from lakesearch.catalog.bindings import DOCS, documents, table, with_
from lakesearch.catalog.registry import query
from lakesearch.catalog.scalars import NORMAL_URL
from lakesearch.catalog.tables import ts
from lakesearch.operators import cleaning, review
from lakesearch.sources import html


@query("s12_html_pages")
def html_pages(spark, sf):
    return html.extract_pages(table(spark, sf, "pages"))


@query(
    "s13_site_links",
    rf"""WITH b AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hrefs, url FROM pages),
      l AS (SELECT page_id, origin, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS position FROM b),
      n AS (SELECT page_id, CASE WHEN regexp_matches(href, '^https?://') THEN href ELSE origin || href END AS link, origin, position FROM l),
      m AS (SELECT page_id, regexp_replace(link, '#.*$', '') AS link, position FROM n WHERE starts_with(link, origin || '/') UNION ALL SELECT page_id, {NORMAL_URL}, 0 FROM pages),
      k AS (SELECT page_id, link, min(position) AS position FROM m GROUP BY ALL)
      SELECT page_id, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS rank FROM k) WHERE rank <= 5""",
)
def site_links(spark, sf):
    return html.site_links(table(spark, sf, "pages"), 5).select("page_id", "link")


# Documents as collected Markdown pages with something for every cleaning rule.
def raw_pages(spark, sf):
    kb, source = F.col("kb_id"), F.col("source")
    front = F.when(kb == "fr", F.lit("---\ntitle: x\n---\n")).otherwise("")
    tail = (
        F.when(kb == "de", "  \n\n\n\n![pic](a.png) see hxxps://evil[.]example/x and hxxp://b\r\n")
        .when(source == "src4", "\n<b>bold</b> [link](http://a/b)\n|---|:---:|\nend").otherwise("")
    )
    url = F.when(source == "src4", F.concat(F.lit("https://cheatsheets.OWASP.org/"), F.col("document_id").cast("string"))).otherwise(F.replace("source_uri", F.lit("sync://"), F.lit("https://")))
    return documents(spark, sf).select(
        F.col("document_id").alias("page_id"), "kb_id", url.alias("url"), "title", F.concat(front, "text", tail).alias("markdown"),
        F.create_map(F.lit("status"), F.when(source == "src6", "Reserved").otherwise(F.lit("")), F.lit("crawler_incremental"), (kb == "es").cast("string"), F.lit("artifact_filename"), F.lit(None).cast("string")).alias("metadata"),
        source.alias("source_id"),
    )


CLEANED = r"""raw AS (SELECT document_id AS page_id, kb_id, source, title, source_uri,
    CASE WHEN kb_id = 'fr' THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '' END || text ||
    CASE WHEN kb_id = 'de' THEN '  ' || chr(10) || chr(10) || chr(10) || chr(10) || '![pic](a.png) see hxxps://evil[.]example/x and hxxp://b' || chr(13) || chr(10)
         WHEN source = 'src4' THEN chr(10) || '<b>bold</b> [link](http://a/b)' || chr(10) || '|---|:---:|' || chr(10) || 'end' ELSE '' END AS t0 FROM docs),
c1 AS (SELECT *, CASE WHEN kb_id = 'fr' THEN substr(t0, 18) ELSE t0 END AS t1 FROM raw),
c2 AS (SELECT *, regexp_replace(replace(replace(replace(t1, 'hxxps://', 'https://'), 'hxxp://', 'http://'), '[.]', '.'), '!\[[^\]]*\]\([^)]*\)', '', 'g') AS t2 FROM c1),
c3 AS (SELECT *, CASE WHEN source = 'src4' THEN regexp_replace(regexp_replace(regexp_replace(t2, '<[^>]+>', '', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$', '', 'g') ELSE t2 END AS t3 FROM c2),
c4 AS (SELECT *, trim(regexp_replace(regexp_replace(replace(t3, chr(13) || chr(10), chr(10)), '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS cleaned FROM c3),
cleaned AS (SELECT *, length(regexp_replace(regexp_replace(cleaned, '[#>*_`|~\[\](){}\-=:]+', '', 'g'), '\s+', '', 'g')) AS meaningful, sha256(cleaned) AS content_hash FROM c4),
judged AS (SELECT *, CASE WHEN source = 'src6' THEN 'Source record status is RESERVED' WHEN meaningful < 80 THEN 'Content has ' || meaningful || ' meaningful characters; minimum is 80' END AS rejected_reason FROM cleaned)"""


@query(
    "v09_cleaning",
    with_(DOCS, CLEANED, """SELECT page_id, content_hash, meaningful AS meaningful_chars, rejected_reason,
      array_to_string(list_filter([CASE WHEN t0 <> t1 THEN 'front_matter' END, CASE WHEN kb_id = 'de' THEN 'defanged_https,defanged_http' END, CASE WHEN contains(t1, '[.]') THEN 'defanged_dots' END,
        CASE WHEN kb_id = 'de' THEN 'markdown_images' END, CASE WHEN source = 'src4' AND regexp_matches(t2, '<[^>]+>') THEN 'html_tags' END,
        CASE WHEN source = 'src4' AND kb_id <> 'de' THEN 'markdown_links,table_separators' END, CASE WHEN t3 <> cleaned THEN 'whitespace' END], lambda x: x IS NOT NULL), ',') AS changes FROM judged"""),
)
def clean_pages(spark, sf):
    out = cleaning.clean(raw_pages(spark, sf))
    return out.select("page_id", "content_hash", F.col("meaningful_chars").cast("bigint").alias("meaningful_chars"), "rejected_reason", F.array_join("changes", ",").alias("changes"))


@query("v10_source_family", with_(DOCS, "SELECT document_id AS page_id, source = 'src4' OR kb_id = 'es' AS owasp FROM docs"))
def source_family(spark, sf):
    adapter = F.when(F.col("kb_id") == "es", "OWASP")
    return raw_pages(spark, sf).select("page_id", cleaning.is_owasp(F.col("url"), adapter).alias("owasp"))


def routed(spark, sf):
    pages = cleaning.clean(raw_pages(spark, sf)).withColumn("url_hash", F.sha2("url", 256)).withColumn("seen_at", F.lit(1))
    known = pages.where(F.col("source_id").isin("src1", "src2")).select("source_id", "url_hash", "content_hash")
    return review.route_pages(pages, known, require_review=True)


ROUTED = "routed AS (SELECT *, CASE WHEN rejected_reason IS NOT NULL THEN 'rejected' WHEN source IN ('src1', 'src2') THEN 'unchanged' ELSE 'pending_review' END AS status FROM judged)"


@query("v11_page_routing", with_(DOCS, CLEANED, ROUTED, "SELECT page_id, status FROM routed"))
def page_routing(spark, sf):
    return routed(spark, sf).select("page_id", "status")


@query("v11_url_records", with_(DOCS, CLEANED, ROUTED, "SELECT kb_id, content_hash, status AS last_status, rejected_reason AS error FROM routed"))
def url_records(spark, sf):
    return review.url_records(routed(spark, sf)).select("kb_id", "content_hash", "last_status", "error")


@query(
    "v12_review_items",
    with_(DOCS, CLEANED, ROUTED, "SELECT page_id, left(cleaned, 800) AS content_preview, length(cleaned) AS content_chars, content_hash, CASE WHEN kb_id = 'es' THEN 'keep_new' ELSE 'manual' END AS conflict_policy FROM routed WHERE status = 'pending_review'"),
)
def review_items(spark, sf):
    out = review.review_items(routed(spark, sf))
    return out.select("page_id", "content_preview", F.col("content_chars").cast("bigint").alias("content_chars"), "content_hash", "conflict_policy")


@query(
    "a10_progress_counters",
    with_(DOCS, CLEANED, ROUTED, """SELECT source AS job_id, count(*) AS discovered, count(*) AS fetched, count(*) FILTER (WHERE status = 'pending_review') AS cleaned, count(*) FILTER (WHERE status = 'rejected') AS rejected,
      count(*) FILTER (WHERE status = 'unchanged') AS duplicates, 0 AS skipped, 0 AS failed, 0 AS not_modified, 0 AS queued_for_ingest, count(*) FILTER (WHERE status = 'pending_review') AS pending_review FROM routed GROUP BY source"""),
)
def progress_counters(spark, sf):
    events = routed(spark, sf).select(F.col("source_id").alias("job_id"), F.col("status").alias("event"))
    return review.progress_counters(events)


@query(
    "a10_last_errors",
    """SELECT user_id % 7 AS job_id, string_agg(event_id, ',' ORDER BY event_id) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) AS n FROM events WHERE event_type = 'error') WHERE n <= 100 GROUP BY user_id % 7""",
)
def last_errors(spark, sf):
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 7).alias("job_id"), "event_id", F.col("event_id").cast("string").alias("url"), F.col("props").alias("error"), F.when(F.col("event_type") == "error", "failed").otherwise("skipped").alias("event"),
    )
    out = review.last_errors(events, ["event_id"])
    return out.select("job_id", F.array_join(F.transform("errors", lambda e: e["url"]), ",").alias("errors"))


@query(
    "v18_run_outcome",
    """SELECT user_id AS job_id, CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') = 0 AND count(*) FILTER (WHERE event_type = 'signup') = 0 AND count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'failed' ELSE 'succeeded' END AS outcome FROM events GROUP BY user_id""",
)
def run_outcome(spark, sf):
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "queued_for_ingest").when(kind == "signup", "pending_review").when(kind == "error", "failed").otherwise("skipped")
    counts = review.progress_counters(table(spark, sf, "events").select(F.col("user_id").alias("job_id"), event.alias("event")))
    return counts.select("job_id", review.run_outcome(F.col("queued_for_ingest"), F.col("pending_review"), F.col("failed")).alias("outcome"))


# Orders as review items of customers' jobs; events are the reviewers' actions on them.
def items(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("job_id"),
        F.when(status == "F", F.when(priority <= "2-HIGH", "approved").otherwise("rejected")).when(status == "P", "processing").otherwise("pending").alias("status"),
        F.when(priority != "4-NOT SPECIFIED", "agent").otherwise("human").alias("reviewer"), F.when(priority >= "3-MEDIUM", "reject").alias("agent_decision"),
        (F.col("o_totalprice") > 50000).alias("content_available"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("content_expires_at"), (F.col("o_totalprice") > 400000).alias("cleanup_pending"),
    )


ITEMS = """items AS (SELECT o_orderkey AS item_id, o_custkey AS job_id, CASE WHEN o_orderstatus = 'F' THEN (CASE WHEN o_orderpriority <= '2-HIGH' THEN 'approved' ELSE 'rejected' END) WHEN o_orderstatus = 'P' THEN 'processing' ELSE 'pending' END AS status,
   o_orderpriority AS pr, o_totalprice > 50000 AS available, o_orderdate AS expires, o_totalprice > 400000 AS cleanup FROM orders)"""


@query("a09_review_counters", with_(ITEMS, """SELECT job_id, count(*) FILTER (WHERE status IN ('pending', 'processing')) AS pending, count(*) FILTER (WHERE status = 'approved') AS approved, count(*) FILTER (WHERE status = 'rejected') AS rejected,
   CASE WHEN count(*) FILTER (WHERE status IN ('pending', 'processing')) > 0 THEN 'pending' ELSE 'completed' END AS review_status FROM items GROUP BY job_id"""))
def review_counters(spark, sf):
    return review.review_counters(items(spark, sf))


@query(
    "v13_review_decision",
    """SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice > 400000 THEN 'failed' WHEN o_orderstatus = 'F' AND o_totalprice < 280000 THEN 'manual_review' WHEN o_orderstatus = 'F' THEN 'approve' ELSE 'reject' END AS decision,
        CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' OR o_totalprice > 400000 THEN NULL WHEN o_orderstatus = 'F' AND o_totalprice < 280000 THEN '模型置信度不足，转人工复核：' || o_orderpriority ELSE o_orderpriority END AS reason FROM orders""",
)
def review_decision(spark, sf):
    status = F.col("o_orderstatus")
    answer = F.concat(
        F.lit('```json\n{"decision": "'), F.when(status == "F", "Approve").when(status == "O", "reject").otherwise("maybe"), F.lit('", "reason": "'),
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")), F.lit('", "confidence": '), (F.col("o_totalprice") / 400000).cast("string"), F.lit("}\n```"),
    )
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), review.review_decision(answer).alias("d")).select("item_id", "d.decision", "d.reason")


@query(
    "v14_review_transition",
    with_(ITEMS, """last AS (SELECT event_id % 1000 + user_id AS item_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS decided, arg_max(value > 50, (ts, event_id)) AS human FROM events WHERE event_type IN ('click', 'view') GROUP BY 1)""",
          """SELECT item_id, CASE WHEN status NOT IN ('pending', 'processing') OR kind IS NULL THEN status WHEN kind = 'click' THEN 'approved' ELSE 'rejected' END AS status,
      CASE WHEN status IN ('pending', 'processing') AND kind = 'view' AND NOT human THEN decided + INTERVAL 30 DAY END AS content_expires_at,
      CASE WHEN status IN ('pending', 'processing') AND kind = 'view' THEN NOT human ELSE true END AS content_available FROM items LEFT JOIN last USING (item_id)"""),
)
def review_transition(spark, sf):
    events = table(spark, sf, "events").where(F.col("event_type").isin("click", "view"))
    actions = events.select(
        (F.col("event_id") % 1000 + F.col("user_id")).alias("item_id"), F.when(F.col("event_type") == "click", "approve").otherwise("reject").alias("action"),
        F.when(F.col("value") > 50, "someone").alias("reviewer"), F.col("ts").alias("decided_at"), F.col("event_id").alias("seq"),
    )
    return review.apply_reviews(items(spark, sf).select("item_id", "status"), actions).select("item_id", "status", "content_expires_at", "content_available")


@query("v15_expired_contents", with_(ITEMS, "SELECT item_id FROM items WHERE status = 'rejected' AND pr IN ('3-MEDIUM', '5-LOW') AND (cleanup OR (available AND expires <= TIMESTAMP '1998-01-01'))"))
def expired_contents(spark, sf):
    return review.expired_contents(items(spark, sf), ts("1998-01-01 00:00:00")).select("item_id")


@query("v15_content_available", with_(ITEMS, "SELECT item_id, CASE WHEN status = 'rejected' THEN available AND expires > TIMESTAMP '1998-01-01' ELSE true END AS readable FROM items"))
def content_available(spark, sf):
    readable = review.content_available(F.col("status"), F.col("content_available"), F.col("content_expires_at"), ts("1998-01-01 00:00:00"))
    return items(spark, sf).select("item_id", readable.alias("readable"))


@query(
    "v16_deletion_plan",
    """SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'blocked' ELSE 'delete_document' END AS action, c_custkey::VARCHAR AS target FROM customer WHERE c_nationkey = 7
       UNION ALL SELECT 'cancel_job', o_orderkey::VARCHAR FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 AND o_orderstatus = 'O'
       UNION ALL SELECT 'cancel_run', s_suppkey::VARCHAR FROM supplier WHERE s_nationkey = 7 AND s_acctbal > 0
       UNION ALL SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'drop_content' ELSE 'close_review' END, o_orderkey::VARCHAR FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 7 AND (o_orderpriority = '1-URGENT' OR (o_orderpriority = '5-LOW' AND o_totalprice > 50000))""",
)
def deletion_plan(spark, sf):
    owned = table(spark, sf, "customer").select(F.col("c_custkey"), F.col("c_nationkey").cast("string").alias("kb_id"), "c_mktsegment")
    docs = owned.select("kb_id", F.col("c_custkey").alias("document_id"), F.when(F.col("c_mktsegment") == "BUILDING", "superseeding").otherwise("ready").alias("status"))
    held = table(spark, sf, "orders").join(owned, F.col("o_custkey") == F.col("c_custkey"))
    jobs = held.select("kb_id", F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("status"))
    runs = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("kb_id"), F.col("s_suppkey").alias("run_id"), F.when(F.col("s_acctbal") > 0, "paused").otherwise("succeeded").alias("status"))
    priority = F.col("o_orderpriority")
    reviews = held.select("kb_id", F.col("o_orderkey").alias("item_id"), F.when(priority == "1-URGENT", "pending").when(priority == "5-LOW", "rejected").otherwise("approved").alias("status"), (F.col("o_totalprice") > 50000).alias("content_available"))
    return review.deletion_plan("7", docs, jobs, runs, reviews)


@query(
    "v19_merge_progress",
    """SELECT coalesce(c.c_custkey, o.item) AS item_id, coalesce(c_mktsegment, 'new') AS status, coalesce(c_name, pr) AS title FROM customer c
       FULL JOIN (SELECT 2 * o_custkey AS item, min(o_orderpriority) AS pr FROM orders GROUP BY o_custkey) o ON o.item = c.c_custkey""",
)
def merge_progress(spark, sf):
    current = table(spark, sf, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_mktsegment").alias("status"), F.col("c_name").alias("title"))
    incoming = table(spark, sf, "orders").groupBy((2 * F.col("o_custkey")).alias("item_id")).agg(F.lit("new").alias("status"), F.min("o_orderpriority").alias("title"))
    return review.merge_progress(current, incoming)
