"""Data checks: containment of evidence, integrity of evaluation sets and references."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.operators.containment import contained

def containing_documents(passages: DataFrame, docs: DataFrame, passage_key: str, doc_key: str) -> DataFrame:
    """Exact (passage, document) pairs where the document's text contains the passage, whatever its length."""
    found = contained(passages, docs.select(doc_key, "text"), "text", "text", [doc_key])
    return passages.select(passage_key, "text").join(found, "text").select(passage_key, doc_key)


def violations(rows: DataFrame, rules: dict, key: str) -> DataFrame:
    """One row per key and broken rule. ``rules`` maps a reason to the condition that must hold."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules.items()]))
    return rows.select(key, F.explode(broken).alias("reason"))


def split_valid(rows: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with their reasons."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(reason)) for reason, ok in rules.items()]))
    checked = rows.withColumn("reasons", broken)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)


# Closed vocabularies of experience rows.
WORKFLOWS = ("penetration", "alert-triage")
OUTCOMES = ("success", "failure", "neutral")
EVIDENCE_LEVELS = ("reported", "observed", "verified")


def _text(name: str, most: int, required: bool = True) -> Column:
    size = F.length(name).between(1, most)
    return F.coalesce(size, F.lit(False)) if required else F.col(name).isNull() | size


def experience_rules() -> dict:
    """Rules an experience upsert must meet."""
    private = F.col("visibility") == "workspace"
    return {
        "external_id": _text("external_id", 128),
        "source_system": _text("source_system", 64),
        "source_revision": F.col("source_revision") >= 1,
        "workflow_type": F.col("workflow_type").isin(*WORKFLOWS),
        "scope_mismatch": F.col("workflow_type") == F.col("knowledge_scope"),
        "experience_type": _text("experience_type", 64),
        "visibility": F.col("visibility").isin("global", "workspace"),
        "workspace_id": F.when(private, _text("workspace_id", 128)).otherwise(F.col("workspace_id").isNull()),
        "conditions": F.size("conditions") <= 50,
        "action_summary": _text("action_summary", 8000),
        "outcome_summary": _text("outcome_summary", 8000),
    }


def feedback_rules() -> dict:
    """Rules a feedback event must meet."""
    return {
        "event_id": _text("event_id", 128), "experience_id": _text("experience_id", 128), "task_id": _text("task_id", 128),
        "workflow_type": F.col("workflow_type").isin(*WORKFLOWS), "outcome": F.col("outcome").isin(*OUTCOMES),
        "evidence_level": F.col("evidence_level").isin(*EVIDENCE_LEVELS), "notes": F.col("notes").isNull() | (F.length("notes") <= 2000),
    }


def duplicate_keys(rows: DataFrame, key: str, reason: str) -> DataFrame:
    return rows.groupBy(F.col(key).cast("string").alias("item")).agg(F.count("*").alias("n")).where("n > 1").select("item", F.lit(reason).alias("reason"))


def dataset_violations(questions: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Everything wrong with an evaluation set, one row per item and reason.

    ``questions``: query_id, answerable, split, evidence_ids, acceptable_ids;
    ``evidence``: evidence_id; ``documents``: filename.
    """
    unknown = (
        questions.select(F.col("query_id").cast("string").alias("item"), F.explode(F.array_union("evidence_ids", "acceptable_ids")).alias("evidence_id"))
        .join(evidence.select("evidence_id"), "evidence_id", "left_anti").select("item", F.lit("unknown_evidence").alias("reason")).distinct()
    )
    has = F.size("evidence_ids") > 0
    rules = {
        "repeated_evidence": (F.size(F.array_distinct("evidence_ids")) == F.size("evidence_ids")) & (F.size(F.array_distinct("acceptable_ids")) == F.size("acceptable_ids")),
        "required_not_acceptable": F.size(F.array_except("evidence_ids", "acceptable_ids")) == 0,
        "answerable_mismatch": F.col("answerable") == has,
        "unanswerable_with_evidence": F.col("answerable") | (F.size("acceptable_ids") == 0),
        "split": F.col("split").isin("dev", "test"),
    }
    broken = violations(questions, rules, "query_id").select(F.col("query_id").cast("string").alias("item"), "reason")
    return (
        unknown.unionByName(broken).unionByName(duplicate_keys(questions, "query_id", "duplicate_query"))
        .unionByName(duplicate_keys(evidence, "evidence_id", "duplicate_evidence")).unionByName(duplicate_keys(documents, "filename", "duplicate_file"))
    )


def reference_integrity(rows: DataFrame, kbs: DataFrame, label: str) -> DataFrame:
    """How many rows have no collection and how many name one that does not exist."""
    known = kbs.select("kb_id", F.lit(True).alias("_known"))
    return rows.join(known, "kb_id", "left").agg(
        F.lit(label).alias("table"), F.count_if(F.col("kb_id").isNull()).alias("missing"), F.count_if(F.col("kb_id").isNotNull() & F.col("_known").isNull()).alias("orphaned"),
    )


def located_once(found: DataFrame, passages: DataFrame, key: str) -> DataFrame:
    """How often each passage was found and whether it was exactly once."""
    counts = found.groupBy(key).agg(F.count("*").alias("places"))
    return passages.select(key).join(counts, key, "left").select(key, F.coalesce("places", F.lit(0)).alias("places"), (F.coalesce("places", F.lit(0)) == 1).alias("located"))


def query_checks(queries: DataFrame, pattern: str) -> DataFrame:
    """Queries that leak an identifier or repeat another query's normalised text."""
    normal = F.lower(F.regexp_replace("query", r"[^\p{L}\p{N}]", ""))
    rows = queries.select("query_id", F.sha2(normal, 256).alias("normal"), F.col("query").rlike(pattern).alias("leaks"))
    repeated = rows.groupBy("normal").agg(F.count("*").alias("n")).where("n > 1").select("normal", F.lit(True).alias("repeated"))
    return rows.join(repeated, "normal", "left").select("query_id", "leaks", F.coalesce("repeated", F.lit(False)).alias("repeated"))


def corpus_selection(docs: DataFrame, identifier: Column, content: Column, order: Column) -> DataFrame:
    """Documents kept for evaluation: the first per identifier, then the first per content."""
    keyed = docs.select("document_id", identifier.alias("i"), content.alias("c"), order.alias("o"))
    first_id = keyed.groupBy("i").agg(F.min(F.struct("o", "document_id"))["document_id"].alias("document_id")).select("document_id", F.lit(True).alias("id_first"))
    marked = keyed.join(first_id, "document_id", "left").withColumn("id_first", F.coalesce("id_first", F.lit(False)))
    first_content = marked.where("id_first").groupBy("c").agg(F.min(F.struct("o", "document_id"))["document_id"].alias("document_id")).select("document_id", F.lit(True).alias("content_first"))
    return marked.join(first_content, "document_id", "left").select(
        "document_id", F.when(~F.col("id_first"), "duplicate_identifier").when(F.col("content_first").isNull(), "duplicate_content").alias("excluded")
    )
