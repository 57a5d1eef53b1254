"""Query intent rules and retrieval budgets."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.text import collapse_spaces, json_block

# Wording that decides the intent, tried in this order.
ENUMERATION_ACTION = r"(有哪些|包括哪些|包含哪些|列出|罗列|枚举|逐条|全部|所有|分别|各自|一览)"
ENUMERATION_TARGET = r"(条款|规定|要求|措施|责任|义务|职责|类型|类别|步骤|阶段|方面|内容|条件)"
ENUMERATION_ALONE = ("全部", "所有", "逐条")
COMPREHENSIVE = r"(概括|总结|综述|整体|全面|主要内容|如何理解|从哪些方面|有何影响)"
MULTI_EVIDENCE = (
    r"(分别|两个|两种|三种|多个|各自|对比|比较|区别|相同吗|哪个.{0,30}哪个|从.{0,30}到.{0,30}(链|过程)|攻击链|不是一回事|"
    r"以及|及其|和.{0,30}(关系|差异|日期|公告))"
)
FOCUSED = r"(是什么|为什么|多少|多久|何时|什么时候|哪一号|谁负责|是否|能否|怎么修复)"

# Budgets by intent.
BUDGETS = {
    #                top_k, vector, keyword, per document, rerank, context, radius
    "focused": (10, 30, 30, 3, 10, 8, 0),
    "comprehensive": (15, 40, 40, 5, 25, 12, 1),
    "enumeration": (20, 80, 80, 10, 50, 20, 2),
}
BUDGET_FIELDS = (
    "top_k", "vector_top_k", "keyword_top_k", "max_chunks_per_document", "rerank_candidate_top_k", "context_max_chunks", "adjacent_chunk_radius",
)
DEFAULT_CONTEXT_CHUNKS = 8
COVERAGE_WARNING = "结果来自相关性检索，不能保证覆盖知识库中的全部条款或项目。"
REWRITE_MAX_CHARS = 500


def rule_intent(query: Column) -> Column:
    """Struct of mode, source, confidence, scope and target.

    Wording rules decide; other queries are focused with confidence 0.5.
    """
    q = collapse_spaces(query)
    action = F.regexp_extract(q, ENUMERATION_ACTION, 1)
    target = F.nullif(F.regexp_extract(q, ENUMERATION_TARGET, 1), F.lit(""))
    nothing = F.lit(None).cast("string")

    def intent(mode, source, confidence, scope, what):
        return F.struct(
            F.lit(mode).alias("mode"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"),
            F.lit(scope).alias("scope"), what.alias("target"),
        )

    return (
        F.when((action != "") & (target.isNotNull() | action.isin(*ENUMERATION_ALONE)), intent("enumeration", "rule", 0.95, "exhaustive", target))
        .when(q.rlike(COMPREHENSIVE) | q.rlike(MULTI_EVIDENCE), intent("comprehensive", "rule", 0.9, "broad", nothing))
        .when(q.rlike(FOCUSED), intent("focused", "rule", 0.9, "local", nothing))
        .otherwise(intent("focused", "fallback", 0.5, "local", nothing))
    )


def plan_intent(query: Column, requested: Column, enabled: bool = True) -> Column:
    """Intent of a query when a mode may have been asked for explicitly."""
    def fixed(mode, source, scope):
        return F.struct(
            mode.alias("mode"), F.lit(source).alias("source"), F.lit(1.0).alias("confidence"), scope.alias("scope"),
            F.lit(None).cast("string").alias("target"),
        )

    if not enabled:
        return fixed(F.lit("focused"), "disabled", F.lit("local"))
    asked = F.coalesce(requested, F.lit("auto"))
    scope = F.when(asked == "enumeration", "exhaustive").otherwise("broad")
    return F.when(asked != "auto", fixed(asked, "explicit", scope)).otherwise(rule_intent(query))


def with_budget(planned: DataFrame, overrides=("top_k", "vector_top_k", "keyword_top_k", "max_chunks_per_document")) -> DataFrame:
    """Add the budget columns of each row's ``mode``.

    Columns named ``asked_<field>`` override a field where they are not null.
    """
    def budget(position: int) -> Column:
        value = F.lit(None).cast("int")
        for mode, numbers in BUDGETS.items():
            value = F.when(F.col("mode") == mode, F.lit(numbers[position])).otherwise(value)
        return value

    columns = {}
    for position, field in enumerate(BUDGET_FIELDS):
        value = budget(position)
        asked = f"asked_{field}"
        columns[field] = F.coalesce(F.col(asked), value) if field in overrides and asked in planned.columns else value
    columns["rerank_candidate_top_k"] = F.greatest(columns["rerank_candidate_top_k"], columns["top_k"])
    columns["context_max_chunks"] = F.greatest(F.lit(DEFAULT_CONTEXT_CHUNKS), columns["context_max_chunks"])
    enumeration = F.col("mode") == "enumeration"
    return planned.withColumns(columns).withColumns({
        "coverage_status": F.when(enumeration, "partial").otherwise("not_applicable"),
        "coverage_warning": F.when(enumeration, F.lit(COVERAGE_WARNING)),
    })


def safe_rewrites(rewrites: Column, limit: int) -> Column:
    """Distinct non-blank rewrites with collapsed blanks, cut to 500 characters, first ``limit``."""
    tidy = F.transform(F.coalesce(rewrites, F.array().cast("array<string>")), lambda r: F.substring(collapse_spaces(r), 1, REWRITE_MAX_CHARS))
    return F.slice(F.array_distinct(F.filter(tidy, lambda r: r.isNotNull() & (r != ""))), 1, limit)


MODEL_INTENT = "intent string, scope string, confidence double, target string, semantic_queries array<string>, keyword_queries array<string>"


def parse_model_intent(content: Column, max_queries: int = 3, min_confidence: float = 0.5) -> Column:
    """Checked intent from a model's JSON answer; ``valid`` is false for a refused one."""
    payload = F.from_json(json_block(content), MODEL_INTENT)
    scope = F.coalesce(F.nullif(payload["scope"], F.lit("")), F.lit("local"))
    confidence = F.coalesce(payload["confidence"], F.lit(0.0))
    valid = (
        payload["intent"].isin("focused", "comprehensive", "enumeration") & scope.isin("local", "broad", "exhaustive") & confidence.between(0.0, 1.0)
    )
    return F.struct(
        F.coalesce(valid, F.lit(False)).alias("valid"), payload["intent"].alias("mode"), scope.alias("scope"), confidence.alias("confidence"),
        F.nullif(F.substring(F.trim(payload["target"]), 1, 200), F.lit("")).alias("target"),
        safe_rewrites(payload["semantic_queries"], max_queries).alias("semantic_queries"),
        safe_rewrites(payload["keyword_queries"], max_queries).alias("keyword_queries"),
    )
