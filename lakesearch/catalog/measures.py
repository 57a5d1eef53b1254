"""Evaluation, evidence, data quality and experience queries over the given tables."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from lakesearch.catalog.bindings import CHUNKS, DOCS, FEEDBACK, GOLD, QUERIES_CTE, chunks, documents, feedback, gold, plain_chunks, queries, table, with_
from lakesearch.catalog.registry import query
from lakesearch.catalog.retrieval import BM, BM_SCORES, INDEX, few_hits, keyword_hits, topk_sql
from lakesearch.catalog.tables import ts
from lakesearch.operators import evaluation, evidence, experience, keyword, maintenance, quality, quantiles
from lakesearch.session import materialise, shared_dir

# ---------------------------------------------------------------- retrieval quality

HITS = (CHUNKS, QUERIES_CTE, INDEX, BM, BM_SCORES, topk_sql("bm_scores", "hits", 10), GOLD)
METRICS = """keyed AS (SELECT query_id, rank, CAST(split_part(chunk_id, '-', 1) AS BIGINT) AS key FROM hits),
wanted AS (SELECT query_id, document_id AS key, document_id = min(document_id) OVER (PARTITION BY query_id) AS required FROM gold),
m AS (SELECT w.query_id, count(DISTINCT w.key) AS n_gold, count(DISTINCT w.key) FILTER (WHERE required) AS n_required FROM wanted w GROUP BY w.query_id),
x AS (SELECT k.query_id, min(rank) AS fr, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 3), 0) AS d3, coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS d10,
   count(DISTINCT k.key) FILTER (WHERE rank <= 10 AND required) AS f10, count(DISTINCT k.key) FILTER (WHERE rank <= 1 AND required) AS f1 FROM keyed k JOIN wanted w USING (query_id, key) GROUP BY k.query_id),
metrics AS (SELECT query_id, coalesce(1.0 / fr, 0) AS rr, coalesce((fr <= 1)::INT, 0) AS hit_1, coalesce((fr <= 10)::INT, 0) AS hit_10, coalesce(f1::DOUBLE / n_required, 0) AS recall_1, coalesce(f10::DOUBLE / n_required, 0) AS recall_10,
   coalesce(d3 / list_sum(list_transform(range(1, least(n_gold, 3) + 1), lambda r: 1 / log2(r + 1))), 0) AS ndcg_3,
   coalesce(d10 / list_sum(list_transform(range(1, least(n_gold, 10) + 1), lambda r: 1 / log2(r + 1))), 0) AS ndcg_10 FROM m LEFT JOIN x USING (query_id))"""


def metrics(spark, sf):
    hits = materialise(keyword_hits(spark, sf, 10), "keyword-hits").select("query_id", "rank", F.split_part("chunk_id", F.lit("-"), F.lit(1)).cast("bigint").alias("key"))
    found = materialise(gold(spark, sf), "gold")
    first = found.groupBy("query_id").agg(F.min("document_id").alias("first"))
    wanted = found.join(first, "query_id").select("query_id", F.col("document_id").alias("key"), (F.col("document_id") == F.col("first")).alias("required"))
    return evaluation.query_metrics(hits, wanted)


@query("a01_query_metrics", with_(*HITS, METRICS, "SELECT query_id, round(rr, 6) AS reciprocal_rank, hit_1, hit_10, round(recall_1, 6) AS recall_1, round(recall_10, 6) AS recall_10, round(ndcg_3, 6) AS ndcg_3, round(ndcg_10, 6) AS ndcg_10 FROM metrics"))
def query_metrics(spark, sf):
    names = ("reciprocal_rank", "hit_1", "hit_10", "recall_1", "recall_10", "ndcg_3", "ndcg_10")
    return metrics(spark, sf).select("query_id", *[F.round(n, 6).alias(n) for n in names])


def reports(spark, sf):
    scored = metrics(spark, sf).withColumn("answerable", F.lit(True))
    return queries(spark, sf).join(scored, "query_id", "left").select(
        "query_id", F.coalesce("answerable", F.lit(False)).alias("answerable"), (F.length("query") > 330).alias("failed"), F.contains("query", F.lit(",")).alias("degraded"),
        F.when(F.length("query") < 200, "short").otherwise("long").alias("slice"), *[c for c in scored.columns if c not in ("query_id", "answerable")],
    )


SUMMARY = """rep AS (SELECT q.query_id, m.query_id IS NOT NULL AS answerable, length(query) > 330 AS failed, contains(query, ',') AS degraded, CASE WHEN length(query) < 200 THEN 'short' ELSE 'long' END AS slice, m.* EXCLUDE (query_id) FROM queries q LEFT JOIN metrics m USING (query_id))"""


@query(
    "a02_retrieval_summary",
    with_(*HITS, METRICS, SUMMARY, """SELECT count(*) AS queries, count(*) FILTER (WHERE answerable) AS answerable_queries, round(avg(hit_1) FILTER (WHERE answerable), 6) AS hit_1, round(avg(recall_10) FILTER (WHERE answerable), 6) AS recall_10,
      round(avg(rr) FILTER (WHERE answerable), 6) AS mrr, round(avg(ndcg_10) FILTER (WHERE answerable), 6) AS ndcg_10, count(*) FILTER (WHERE degraded) AS degraded_queries, round(avg(failed::INT), 6) AS failure_rate FROM rep"""),
)
def retrieval_summary(spark, sf):
    out = evaluation.retrieval_summary(reports(spark, sf))
    return out.select("queries", "answerable_queries", *[F.round(c, 6).alias(c) for c in ("hit_1", "recall_10", "mrr", "ndcg_10")], "degraded_queries", F.round("failure_rate", 6).alias("failure_rate"))


@query(
    "a06_sliced_report",
    with_(*HITS, METRICS, SUMMARY, "SELECT slice, answerable, count(*) AS queries, round(avg(coalesce(ndcg_10, 0)), 6) AS ndcg_10 FROM rep GROUP BY ROLLUP (slice, answerable)"),
)
def sliced_report(spark, sf):
    out = evaluation.sliced(reports(spark, sf), ["slice", "answerable"], {"ndcg_10": F.coalesce("ndcg_10", F.lit(0.0))})
    return out.select("slice", "answerable", "queries", F.round("ndcg_10", 6).alias("ndcg_10"))


@query("a03_percentile", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def percentile(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "events"), "value", 0.95, ("event_type",)).select("event_type", F.col("percentile").alias("p95"))


@query("a03_percentile_range", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events WHERE ts::DATE BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' GROUP BY event_type")
def percentile_range(spark, sf):
    """From stored counts by day: which bucket holds the value; only its rows are read again."""
    events, day = table(spark, sf, "events"), F.to_date("ts")
    path = f"{shared_dir(spark)}/quantile-counts-{uuid.uuid4().hex}"
    quantiles.append_counts(events, path, 0, day, "value", ("event_type",))
    found = quantiles.nearest_rank(events, quantiles.stored_counts(spark, path), 0.95, dt.date(2024, 1, 10), dt.date(2024, 1, 20), day, "value", ("event_type",))
    return found.select("event_type", F.col("percentile").alias("p95"))


@query("a03_percentile_total", "SELECT quantile_disc(l_extendedprice, 0.5) AS median FROM lineitem")
def percentile_total(spark, sf):
    return evaluation.nearest_rank(table(spark, sf, "lineitem"), "l_extendedprice", 0.5).select(F.col("percentile").alias("median"))


# Orders as answers: status and priority shape the answer, lines are the citations, large
# quantities the gold.
def answers(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey").cast("string"))).alias("cited"),
        F.collect_set(F.when(F.col("l_quantity") > 40, F.col("l_partkey").cast("string"))).alias("gold"),
        F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_partkey").cast("string"))).alias("acceptable"),
    )
    day = F.date_format("o_orderdate", "yyyy 年 M 月 d 日")
    return table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("query_id")).select(
        "query_id", (F.size("gold") > 0).alias("answerable"), F.when(F.col("o_orderstatus") == "P", "insufficient_evidence").otherwise("answered").alias("status"),
        F.concat(F.lit("On "), day, F.lit(" with "), "o_orderpriority").alias("answer"),
        F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("1-Urgent")).alias("must_include"), "cited", "gold", "acceptable",
        (F.col("o_totalprice") > 20000).alias("request_ok"), F.floor(F.col("o_totalprice")).alias("total_tokens"), (F.col("o_orderpriority") == "2-HIGH").alias("degraded"),
    )


ANSWERS = """sets AS (SELECT l_orderkey AS query_id, list(DISTINCT l_partkey) FILTER (WHERE l_returnflag = 'R') AS cited, list(DISTINCT l_partkey) FILTER (WHERE l_quantity > 40) AS gold, list(DISTINCT l_partkey) FILTER (WHERE l_quantity > 25) AS acceptable FROM lineitem GROUP BY l_orderkey),
scored AS (SELECT query_id, coalesce(len(gold), 0) > 0 AS answerable, CASE WHEN o_orderstatus = 'P' THEN 'insufficient_evidence' ELSE 'answered' END AS status, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.5 END AS facts,
   CASE WHEN coalesce(len(cited), 0) = 0 THEN 0 ELSE len(list_intersect(cited, coalesce(acceptable, []))) / len(cited) END AS cp, len(list_intersect(coalesce(cited, []), gold)) / len(gold) AS cr,
   o_totalprice > 20000 AS ok, floor(o_totalprice) AS tokens, o_orderpriority = '2-HIGH' AS degraded FROM sets JOIN orders ON o_orderkey = query_id),
judged AS (SELECT *, answerable = (status = 'answered') AS correct FROM scored)"""


@query("a04_answer_metrics", with_(ANSWERS, "SELECT query_id, correct AS status_correct, CASE WHEN answerable THEN facts END AS fact_recall, CASE WHEN answerable THEN round(cp, 6) END AS citation_precision, CASE WHEN answerable THEN round(cr, 6) END AS citation_recall FROM judged"))
def answer_metrics(spark, sf):
    out = evaluation.answer_metrics(answers(spark, sf))
    return out.select("query_id", "status_correct", "fact_recall", F.round("citation_precision", 6).alias("citation_precision"), F.round("citation_recall", 6).alias("citation_recall"))


@query(
    "a05_answer_summary",
    with_(ANSWERS, """SELECT count(*) AS queries, count(*) FILTER (WHERE ok) AS successful_queries, round(avg(correct::INT) FILTER (WHERE ok AND answerable), 6) AS answer_rate_on_answerable, round(avg(correct::INT) FILTER (WHERE ok AND NOT answerable), 6) AS refusal_accuracy,
      round(avg(facts) FILTER (WHERE ok AND answerable), 6) AS required_fact_recall, round(avg(cp) FILTER (WHERE ok AND answerable), 6) AS citation_precision, round(avg(cr) FILTER (WHERE ok AND answerable), 6) AS citation_recall,
      round(avg(tokens) FILTER (WHERE ok), 6) AS mean_total_tokens, count(*) FILTER (WHERE ok AND degraded) AS degraded_queries FROM judged"""),
)
def answer_summary(spark, sf):
    rows = answers(spark, sf)
    extra = rows.select("query_id", "request_ok", "total_tokens", "degraded")
    out = evaluation.answer_summary(evaluation.answer_metrics(rows).join(extra, "query_id"))
    rounded = ("answer_rate_on_answerable", "refusal_accuracy", "required_fact_recall", "citation_precision", "citation_recall", "mean_total_tokens")
    return out.select("queries", "successful_queries", *[F.round(c, 6).alias(c) for c in rounded], "degraded_queries")


@query(
    "a07_dataset_statistics",
    """SELECT CASE WHEN GROUPING(a) = 0 THEN 'answerable' WHEN GROUPING(c) = 0 THEN 'category' ELSE 'difficulty' END AS dimension, coalesce(a, c, d) AS value, count(*) AS questions
       FROM (SELECT (p_size > 25)::VARCHAR AS a, p_brand AS c, p_type AS d FROM part) GROUP BY GROUPING SETS ((a), (c), (d))""",
)
def dataset_statistics(spark, sf):
    return evaluation.dataset_statistics(table(spark, sf, "part").select((F.col("p_size") > 25).alias("answerable"), F.col("p_brand").alias("category"), F.col("p_type").alias("difficulty")))


@query("a14_usage_totals", "SELECT user_id AS batch_id, sum(length(event_type)) AS prompt_tokens, sum(length(props)) AS total_tokens FROM events GROUP BY user_id")
def usage_totals(spark, sf):
    usage = table(spark, sf, "events").select(F.col("user_id").alias("batch_id"), F.length("event_type").alias("prompt_tokens"), F.length("props").alias("total_tokens"))
    return evaluation.usage_totals(usage, "batch_id")


@query("g08_answer_usage", "SELECT l_orderkey AS query_id, sum(l_linenumber) AS prompt_tokens, sum(CAST(l_quantity AS BIGINT)) AS total_tokens FROM lineitem GROUP BY l_orderkey")
def answer_usage(spark, sf):
    usage = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("prompt_tokens"), F.col("l_quantity").cast("bigint").alias("total_tokens"))
    return evaluation.usage_totals(usage, "query_id")


# ---------------------------------------------------------------- evidence and answers


def evidence_hits(spark, sf):
    hits = few_hits(keyword_hits(spark, sf, 10), "keyword-hits")
    return hits.join(plain_chunks(spark, sf), "chunk_id").select(
        "query_id", "rank", "chunk_id", "document_id", "source_uri", "original_filename", "chunk_index", F.lit(None).cast("int").alias("page_no"), "text"
    )


@query("g01_context_packing")
def context_packing(spark, sf):
    return evidence.pack_context(evidence_hits(spark, sf), 1500)


@query(
    "g02_evidence_json",
    with_(*HITS, """SELECT query_id, md5('[' || string_agg('{"citation_id":' || rank || ',"source":{"chunk_id":"' || chunk_id || '","document_id":' || document_id || ',"source_uri":"' || source_uri || '","original_filename":"' || original_filename
      || '","chunk_index":' || chunk_index || ',"page_no":null},"content":' || to_json(text) || ',"truncated":false}', ',' ORDER BY rank) || ']') AS context_hash FROM hits JOIN chunks USING (chunk_id) GROUP BY query_id"""),
)
def evidence_json(spark, sf):
    rows = evidence_hits(spark, sf).withColumns({"citation_id": F.col("rank"), "truncated": F.lit(False)})
    return evidence.serialize_evidence(rows).select("query_id", F.md5("context").alias("context_hash"))


# Turns as model answers: length decides what is wrong with them.
def model_answers(spark, sf):
    n = F.length("text") % 5
    ids = F.when(n == 0, "[1,1]").when(n == 1, "[2,1]").when(n == 2, "[]").otherwise("[1]")
    status = F.when(F.col("role") == "user", "insufficient_evidence").when(n == 4, "maybe").otherwise("answered")
    tail = F.when(n == 1, " as in [1]").when(n == 3, " [1] and [1][7]").otherwise("")
    body = F.to_json(F.struct(status.alias("status"), F.concat(F.lit(" see"), tail).alias("answer")))
    content = F.concat(F.lit("```JSON\n"), F.regexp_replace(body, r"\}$", ""), F.lit(', "citation_ids": '), ids, F.lit("}\n```"))
    return table(spark, sf, "conversations").select("conv_id", "turn", evidence.parse_answer(content).alias("p")).select("conv_id", "turn", "p.*")


PARSED = """parsed AS (SELECT conv_id, turn, n, NOT (n = 0 OR (n = 4 AND role <> 'user')) AS valid, CASE WHEN role = 'user' THEN 'insufficient_evidence' WHEN n = 4 THEN 'maybe' ELSE 'answered' END AS status,
   'see' || CASE n WHEN 1 THEN ' as in [1]' WHEN 3 THEN ' [1] and [1][7]' ELSE '' END AS answer FROM (SELECT *, length(text) % 5 AS n FROM conversations))"""


@query("g03_parse_answer", with_(PARSED, "SELECT conv_id, turn, valid, status, answer FROM parsed"))
def parse_answer(spark, sf):
    return model_answers(spark, sf).select("conv_id", "turn", "valid", "status", "answer")


@query(
    "g04_rendered_answer",
    with_(PARSED, "SELECT conv_id, turn, CASE WHEN status = 'answered' AND n = 2 THEN NULL WHEN status = 'answered' AND n = 1 THEN answer || ' [2]' ELSE answer END AS rendered FROM parsed WHERE valid"),
)
def rendered_answer(spark, sf):
    shown = evidence.rendered_answer(F.col("status"), F.col("answer"), F.col("citation_ids"), F.array(F.lit(1), F.lit(2)))
    return model_answers(spark, sf).where("valid").select("conv_id", "turn", shown.alias("rendered"))


@query(
    "g05_citation_problem",
    with_(PARSED, "SELECT conv_id, turn, CASE WHEN n IN (1, 3) THEN 'declared_mismatch' WHEN status = 'insufficient_evidence' THEN NULL ELSE 'no_citation' END AS problem FROM parsed"),
)
def citation_problem(spark, sf):
    problem = evidence.citation_problem(F.col("status"), F.col("answer"), F.coalesce("citation_ids", F.array().cast("array<int>")), F.array(F.lit(1), F.lit(2)))
    return model_answers(spark, sf).select("conv_id", "turn", problem.alias("problem"))


@query(
    "g06_cited_evidence",
    """WITH a AS (SELECT l_orderkey AS query_id, list(DISTINCT l_linenumber ORDER BY l_linenumber DESC) AS ids FROM lineitem WHERE l_quantity > 20 GROUP BY l_orderkey),
       e AS (SELECT l_orderkey AS query_id, l_linenumber AS citation_id, max(l_partkey) AS part FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
       m AS (SELECT query_id, unnest(ids) AS citation_id, generate_subscripts(ids, 1) - 1 AS mention FROM a) SELECT query_id, mention, citation_id, part FROM m JOIN e USING (query_id, citation_id)""",
)
def cited_evidence(spark, sf):
    lines = table(spark, sf, "lineitem")
    said = lines.where("l_quantity > 20").groupBy(F.col("l_orderkey").alias("query_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_set("l_linenumber"), asc=False), lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("] then"))), " ").alias("answer")
    )
    held = lines.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("citation_id")).agg(F.max("l_partkey").alias("part"))
    return evidence.cited_evidence(said, held).select("query_id", "mention", "citation_id", "part")


# ---------------------------------------------------------------- data quality


@query("q04_located_once", with_(GOLD, "SELECT item_id AS query_id, count(g.document_id) AS places, count(g.document_id) = 1 AS located FROM benchmark LEFT JOIN gold g ON g.query_id = item_id GROUP BY item_id"))
def located_once(spark, sf):
    return quality.located_once(gold(spark, sf), queries(spark, sf), "query_id")


@query(
    "q01_row_rules",
    """SELECT o_orderkey, reason FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_custkey < 10 THEN 'source_revision' END, CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'workflow_type' END,
         CASE WHEN o_orderpriority = '2-HIGH' THEN 'scope_mismatch' END, CASE WHEN o_orderstatus = 'P' THEN 'visibility' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 100000 THEN 'workspace_id' END], lambda x: x IS NOT NULL)) AS reason FROM orders)""",
)
def row_rules(spark, sf):
    status, priority, key = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    workflow = F.when(priority == "1-URGENT", "penetration").when(priority.isin("2-HIGH", "5-LOW"), "alert-triage").otherwise(priority)
    rows = table(spark, sf, "orders").select(
        "o_orderkey", key.alias("external_id"), F.lit("erp").alias("source_system"), F.when(F.col("o_custkey") < 10, 0).otherwise(3).alias("source_revision"), workflow.alias("workflow_type"),
        F.when(priority == "2-HIGH", "penetration").otherwise(workflow).alias("knowledge_scope"), F.lit("fix").alias("experience_type"),
        F.when(status == "F", "workspace").when(status == "O", "global").otherwise("team").alias("visibility"), F.when((status == "F") & (F.col("o_totalprice") >= 100000), "ws").alias("workspace_id"),
        F.create_map(F.lit("k"), key).alias("conditions"), F.lit("a").alias("action_summary"), F.lit("b").alias("outcome_summary"),
    )
    return quality.violations(rows, quality.experience_rules(), "o_orderkey")


@query(
    "q02_dataset_violations",
    """WITH ids AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) FILTER (WHERE l_returnflag = 'R') AS e, list(DISTINCT l_partkey) FILTER (WHERE l_returnflag <> 'A') AS a FROM lineitem GROUP BY l_orderkey),
       q AS (SELECT o_orderkey::VARCHAR AS item, coalesce(e, []) AS e, coalesce(a, []) AS a, o_orderstatus <> 'P' AS answerable, CASE WHEN o_orderpriority = '5-LOW' THEN 'other' ELSE 'dev' END AS split FROM orders JOIN ids ON l_orderkey = o_orderkey)
       SELECT item, 'repeated_evidence' AS reason FROM q WHERE len(list_distinct(e)) <> len(e)
       UNION ALL SELECT item, 'answerable_mismatch' FROM q WHERE answerable <> (len(e) > 0)
       UNION ALL SELECT item, 'unanswerable_with_evidence' FROM q WHERE NOT answerable AND len(a) > 0
       UNION ALL SELECT item, 'split' FROM q WHERE split = 'other'
       UNION ALL SELECT DISTINCT item, 'unknown_evidence' FROM (SELECT item, unnest(list_concat(e, a)) AS p FROM q) WHERE p NOT IN (SELECT p_partkey FROM part WHERE p_size < 45)
       UNION ALL SELECT p_brand, 'duplicate_file' FROM part GROUP BY p_brand HAVING count(*) > 1""",
)
def dataset_violations(spark, sf):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    ids = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == "R", line))), lambda s: s["l_partkey"]).alias("evidence_ids"),
        F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("l_partkey"))).alias("acceptable_ids"),
    )
    asked = table(spark, sf, "orders").join(ids, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("query_id"), "evidence_ids", "acceptable_ids", (F.col("o_orderstatus") != "P").alias("answerable"), F.when(F.col("o_orderpriority") == "5-LOW", "other").otherwise("dev").alias("split")
    )
    parts = table(spark, sf, "part")
    return quality.dataset_violations(asked, parts.where("p_size < 45").select(F.col("p_partkey").alias("evidence_id")), parts.select(F.col("p_brand").alias("filename")))


@query(
    "q03_reference_integrity",
    "SELECT 'customers' AS \"table\", count(*) FILTER (WHERE c_acctbal < 0) AS missing, count(*) FILTER (WHERE c_acctbal >= 0 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)) AS orphaned FROM customer",
)
def reference_integrity(spark, sf):
    rows = table(spark, sf, "customer").select(F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("kb_id"))
    kbs = table(spark, sf, "nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("kb_id"))
    return quality.reference_integrity(rows, kbs, "customers")


@query(
    "q05_query_checks",
    r"""WITH q AS (SELECT doc_id AS query_id, CASE WHEN source = 'src1' THEN text || ' CVE-2024-1234' ELSE text END AS t FROM documents), n AS (SELECT *, lower(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS k FROM q)
       SELECT query_id, contains(t, 'CVE-2024-1234') AS leaks, count(*) OVER (PARTITION BY k) > 1 AS repeated FROM n""",
)
def query_checks(spark, sf):
    text = F.when(F.col("source") == "src1", F.concat("text", F.lit(" CVE-2024-1234"))).otherwise(F.col("text"))
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), text.alias("query"))
    return quality.query_checks(rows, r"(?i)\b(?:CVE-\d{4}-\d{4,}|CWE-\d+|CAPEC-\d+)\b")


@query(
    "q06_corpus_selection",
    with_(DOCS, """k AS (SELECT document_id, content_hash, source || kb_id || length(text) AS i, document_id = min(document_id) OVER (PARTITION BY source || kb_id || length(text)) AS first_id FROM docs),
      c AS (SELECT content_hash, min(document_id) AS d FROM k WHERE first_id GROUP BY content_hash)""",
          "SELECT document_id, CASE WHEN NOT first_id THEN 'duplicate_identifier' WHEN d <> document_id THEN 'duplicate_content' END AS excluded FROM k LEFT JOIN c USING (content_hash)"),
)
def corpus_selection(spark, sf):
    identifier = F.concat("source", "kb_id", F.length("text").cast("string"))
    return quality.corpus_selection(documents(spark, sf), identifier, F.col("content_hash"), F.lit(0))


# ---------------------------------------------------------------- experience


def upserts(spark, sf):
    """Events as upserts: type and user name the item, ``k`` is the revision, a value band the content."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("source_system"), F.col("user_id").alias("external_id"), (F.get_json_object("props", "$.k").cast("int") % 7).alias("source_revision"),
        F.md5(F.floor(F.col("value") / 40).cast("string")).alias("fingerprint"), "ts", "event_id",
    )
    return rows


def stored_items(spark, sf):
    day = ts("2024-01-12 00:00:00")
    early = upserts(spark, sf).where(F.col("ts") < day)
    return early.groupBy("source_system", "external_id").agg(F.max_by(F.struct("source_revision", "fingerprint"), F.struct("source_revision", -F.col("event_id"))).alias("s")).select("source_system", "external_id", "s.*")


UPSERTS = """ups AS (SELECT event_type AS source_system, user_id AS external_id, CAST(json_extract_string(props, '$.k') AS INT) % 7 AS revision, md5(floor(value / 40)::BIGINT::VARCHAR) AS fp, ts, event_id FROM events),
stored AS (SELECT source_system, external_id, max(revision) AS r, arg_max(fp, (revision, -event_id)) AS f FROM ups WHERE ts < TIMESTAMP '2024-01-12' GROUP BY ALL),
late AS (SELECT u.*, r, f, max((revision, -epoch_us(ts), -event_id, fp)) OVER (PARTITION BY source_system, external_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ups u LEFT JOIN stored USING (source_system, external_id) WHERE ts >= TIMESTAMP '2024-01-12'),
outc AS (SELECT *, CASE WHEN r IS NOT NULL AND (b IS NULL OR r >= b[1]) THEN r ELSE b[1] END AS cr, CASE WHEN r IS NOT NULL AND (b IS NULL OR r >= b[1]) THEN f ELSE b[4] END AS cf FROM late),
outcomes AS (SELECT *, CASE WHEN cr IS NULL THEN 'created' WHEN revision > cr THEN 'updated' WHEN revision < cr THEN 'stale' WHEN fp = cf THEN 'unchanged' ELSE 'conflict' END AS outcome FROM outc)"""


def outcomes(spark, sf):
    late = upserts(spark, sf).where(F.col("ts") >= ts("2024-01-12 00:00:00"))
    return experience.upsert_outcomes(late, stored_items(spark, sf), F.date_trunc("DAY", "ts"), [("ts", "timestamp"), ("event_id", "bigint")])


@query("e01_upsert_outcomes", with_(UPSERTS, "SELECT event_id, outcome FROM outcomes"))
def upsert_outcomes(spark, sf):
    return outcomes(spark, sf).select("event_id", "outcome")


@query(
    "e01_merged_items",
    with_(UPSERTS, """everything AS (SELECT source_system, external_id, r AS revision, f AS fp FROM stored UNION ALL SELECT source_system, external_id, revision, fp FROM outcomes WHERE outcome IN ('created', 'updated'))""",
          "SELECT source_system, external_id, max(revision) AS source_revision, arg_max(fp, revision) AS fingerprint FROM everything GROUP BY ALL"),
)
def merged_items(spark, sf):
    return experience.merged_items(stored_items(spark, sf), outcomes(spark, sf))


@query(
    "e02_fingerprint",
    """SELECT count(*) AS contents, sum(n) AS items FROM (SELECT o_orderpriority, o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL)""",
)
def content_fingerprint(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("action_summary"), F.col("o_orderstatus").alias("phase"),
        F.when(F.col("o_totalprice") > 200000, F.create_map(F.lit("b"), F.lit("x"), F.lit("a"), F.col("o_custkey").cast("string"))).otherwise(F.create_map(F.lit("a"), F.col("o_custkey").cast("string"), F.lit("b"), F.lit("x"))).alias("conditions"),
    )
    prints = rows.select(experience.fingerprint(rows.columns).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return prints.agg(F.count("*").alias("contents"), F.sum("n").alias("items"))


def experience_items(spark, sf):
    """Customers as experiences."""
    segment, balance, nation = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_nationkey")
    conditions = F.when(balance < 0, F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("segment"), segment, F.lit("nation"), nation.cast("string")))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("experience_id"), F.col("c_name").alias("external_id"), F.lit("experience").alias("kb_id"), (nation + 1).alias("source_revision"),
        F.when(segment == "BUILDING", "proven").when(segment == "MACHINERY", "pending").when(segment == "HOUSEHOLD", "deprecated").otherwise("candidate").alias("status"),
        F.when(balance > 3000, "index_pending").otherwise("indexed").alias("index_status"), F.timestamp_add("DAY", nation, ts("2024-01-01 00:00:00")).alias("expires_at"),
        F.timestamp_add("HOUR", nation, ts("2024-01-01 00:00:00")).alias("updated_at"), F.when(nation > 20, "workspace").otherwise("global").alias("visibility"),
        F.when(balance > 5000, "ws-1").otherwise("ws-2").alias("workspace_id"), F.when(balance < 4000, "pentest").otherwise("audit").alias("workflow_type"),
        experience.search_text(conditions, F.lit("did"), F.col("c_name"), segment).alias("search_text"),
    )


ITEMS = """items AS (SELECT c_custkey AS experience_id, c_name, c_nationkey, c_acctbal, CASE c_mktsegment WHEN 'BUILDING' THEN 'proven' WHEN 'MACHINERY' THEN 'pending' WHEN 'HOUSEHOLD' THEN 'deprecated' ELSE 'candidate' END AS status,
  'Experience type: ' || c_mktsegment || chr(10) || 'Conditions: ' || CASE WHEN c_acctbal < 0 THEN '(none)' ELSE 'nation: ' || c_nationkey || '; segment: ' || c_mktsegment END || chr(10) || 'Action: did' || chr(10) || 'Outcome: ' || c_name AS search_text FROM customer)"""


@query("e03_search_text", with_(ITEMS, "SELECT experience_id, search_text FROM items"))
def search_text(spark, sf):
    return experience_items(spark, sf).select("experience_id", "search_text")


@query(
    "e04_transition_allowed",
    with_(ITEMS, """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN status = 'candidate' WHEN o_orderpriority = '2-HIGH' THEN status IN ('candidate', 'pending') WHEN o_orderpriority = '3-MEDIUM' THEN status IN ('candidate', 'pending', 'proven') WHEN o_orderpriority = '5-LOW' THEN status = 'deprecated' ELSE false END AS allowed FROM orders JOIN items ON experience_id = o_custkey"""),
)
def transition_allowed(spark, sf):
    priority = F.col("o_orderpriority")
    target = F.when(priority == "1-URGENT", "pending").when(priority == "2-HIGH", "proven").when(priority == "3-MEDIUM", "deprecated").when(priority == "5-LOW", "archived").otherwise("candidate")
    joined = table(spark, sf, "orders").join(experience_items(spark, sf), F.col("o_custkey") == F.col("experience_id"))
    return joined.select("o_orderkey", experience.transition_allowed(F.col("status"), target).alias("allowed"))


def transitions(spark, sf):
    kind = F.col("event_type")
    target = F.when(kind == "signup", "pending").when(kind == "purchase", "proven").when(kind == "error", "deprecated").when(kind == "view", "archived").otherwise("candidate")
    requests = table(spark, sf, "events").select(F.col("user_id").alias("experience_id"), target.alias("target"), F.col("event_id").alias("seq"))
    return experience.apply_transitions(experience_items(spark, sf).select("experience_id", "status"), requests)


WALK = """reqs AS (SELECT user_id AS experience_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'proven' WHEN 'error' THEN 'deprecated' WHEN 'view' THEN 'archived' ELSE 'candidate' END AS target FROM events),
walk AS (SELECT experience_id, CAST(-1 AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS before, status AS now FROM items
  UNION ALL SELECT w.experience_id, r.seq, w.now, r.target FROM walk w JOIN reqs r ON r.experience_id = w.experience_id AND r.seq = (SELECT min(x.seq) FROM reqs x WHERE x.experience_id = w.experience_id AND x.seq > w.seq AND
    (w.now, x.target) IN (('candidate', 'pending'), ('candidate', 'proven'), ('pending', 'proven'), ('candidate', 'deprecated'), ('pending', 'deprecated'), ('proven', 'deprecated'), ('deprecated', 'archived'))))"""


@query("e05_transition_history", with_(ITEMS, WALK, "SELECT experience_id, seq, before AS from_status, now AS to_status FROM walk WHERE before IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def transition_history(spark, sf):
    return transitions(spark, sf)[1].select("experience_id", "seq", "from_status", "to_status")


@query("e05_item_states", with_(ITEMS, WALK, "SELECT experience_id, arg_max(now, seq) AS status, coalesce(bool_or(before IS NOT NULL AND (before = 'proven' OR now = 'proven')), false) AS index_pending FROM walk GROUP BY experience_id").replace("WITH ", "WITH RECURSIVE ", 1))
def item_states(spark, sf):
    return transitions(spark, sf)[0]


@query("e06_expired_items", with_(ITEMS, "SELECT experience_id, 'deprecated' AS status FROM items WHERE status = 'proven' AND c_nationkey <= 9"))
def expired_items(spark, sf):
    return experience.expire(experience_items(spark, sf), ts("2024-01-10 00:00:00"))[0].select("experience_id", "status")


@query("w08_expiry_batch", with_(ITEMS, "SELECT experience_id FROM items WHERE status = 'proven' AND c_nationkey <= 9 ORDER BY c_nationkey, experience_id LIMIT 25"))
def expiry_batch(spark, sf):
    return experience.expire(experience_items(spark, sf), ts("2024-01-10 00:00:00"), 25)[1].select("experience_id")


@query("e08_row_visibility", with_(ITEMS, "SELECT experience_id FROM items WHERE (c_nationkey <= 20 OR c_acctbal > 5000) AND c_acctbal < 4000"))
def row_visibility(spark, sf):
    return experience_items(spark, sf).where(experience.visible("ws-1", ["pentest"])).select("experience_id")


@query("e09_pending_projections", with_(ITEMS, "SELECT experience_id, CASE WHEN status = 'proven' THEN 'index' ELSE 'remove' END AS action, CASE WHEN status = 'proven' THEN 'indexed' ELSE 'not_indexed' END AS next_index_status FROM items WHERE c_acctbal > 3000"))
def pending_projections(spark, sf):
    return experience.pending_projections(experience_items(spark, sf)).select("experience_id", "action", "next_index_status")


@query(
    "k09_experience_projection",
    with_(ITEMS, r"SELECT experience_id AS document_id, sha256(search_text) AS content_hash, 'Experience ' || c_name AS title, c_nationkey + 1 AS doc_version, len(regexp_extract_all(search_text, '\S+')) AS token_count FROM items WHERE status = 'proven'"),
)
def experience_projection(spark, sf):
    docs, rows = maintenance.experience_projection(experience_items(spark, sf), "model", 64)
    return docs.join(rows.select("document_id", "token_count"), "document_id").select("document_id", "content_hash", "title", "doc_version", "token_count")


def redelivered(spark, sf):
    """All feedback, with successes delivered twice, the second time in another wording for high values."""
    rows = feedback(spark, sf).withColumn("notes", F.lit("n"))
    again = rows.where(F.col("outcome") == "success").withColumn("notes", F.when(F.col("value") > 50, "m").otherwise("n"))
    return rows.unionByName(again)


@query("a11_feedback_counters", with_(FEEDBACK, "SELECT experience_id, count(*) AS usage_count, count(*) FILTER (WHERE outcome = 'success') AS success_count, count(*) FILTER (WHERE outcome = 'failure') AS failure_count FROM feedback GROUP BY experience_id"))
def feedback_counters(spark, sf):
    return experience.feedback_counters(redelivered(spark, sf))


@query("e07_feedback_conflicts", with_(FEEDBACK, "SELECT event_id, 2 AS contents FROM feedback WHERE outcome = 'success' AND value > 50"))
def feedback_conflicts(spark, sf):
    return experience.feedback_conflicts(redelivered(spark, sf), ["experience_id", "outcome", "notes", "occurred_at"])


KEYED = """WITH RECURSIVE req AS (SELECT event_type AS actor, user_id AS key, CASE WHEN value > 30 THEN 'a' ELSE 'b' END AS h, ts AS t, event_id AS seq FROM events),
       opens AS (SELECT actor, key, min((t, seq)) AS o FROM req GROUP BY ALL UNION ALL SELECT actor, key, nxt FROM (SELECT o.actor, o.key, (SELECT min((r.t, r.seq)) FROM req r WHERE r.actor = o.actor AND r.key = o.key AND r.t > o.o[1] + INTERVAL 2 DAY) AS nxt FROM opens o) WHERE nxt IS NOT NULL),
       w AS (SELECT r.seq, r.h, max(o) AS o FROM req r JOIN opens o ON o.actor = r.actor AND o.key = r.key AND o.o <= (r.t, r.seq) GROUP BY r.seq, r.h)
       SELECT w.seq, CASE WHEN w.o[2] = w.seq THEN 'first' WHEN r.h = w.h THEN 'replay' ELSE 'conflict' END AS outcome FROM w JOIN req r ON r.seq = w.o[2]"""


@query(
    "e10_request_outcomes",
    KEYED,
)
def request_outcomes(spark, sf):
    requests = table(spark, sf, "events").select(
        F.col("event_type").alias("actor"), F.col("user_id").alias("key"), F.when(F.col("value") > 30, "a").otherwise("b").alias("request_hash"), F.col("ts").alias("at"), F.col("event_id").alias("seq")
    )
    return experience.request_outcomes(requests, 2 * 86400).select("seq", "outcome")
