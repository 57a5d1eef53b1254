"""Cleaning of collected pages with a log of the rules that changed something."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.ids import content_hash
from lakesearch.functions.text import meaningful_length, strip
from lakesearch.functions.urls import host
from lakesearch.operators.filters import rejection_reason

MIN_CONTENT_CHARS = 80
CLEANER_VERSION = "page-cleaner-v1"

# The rules in order (name, pattern, replacement).
GENERAL_RULES = (
    ("control_characters", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""),
    ("front_matter", r"(?s)\A---\s*\n.*?\n---\s*(?:\n|\z)", ""),
    ("defanged_https", r"(?U)\bhxxps://", "https://"),
    ("defanged_http", r"(?U)\bhxxp://", "http://"),
    ("defanged_dots", r"\[\.\]", "."),
    ("markdown_images", r"!\[[^\]]*\]\([^)]*\)", ""),
)
OWASP_RULES = (
    ("html_tags", r"<[^>]+>", ""),
    ("markdown_links", r"\[([^\]]+)\]\([^)]*\)", "$1"),
    ("table_separators", r"(?dm)^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$", ""),
)


def is_owasp(url: Column, adapter: Column) -> Column:
    name = host(url)
    return (F.lower(F.coalesce(adapter, F.lit(""))) == "owasp") | (name == "owasp.org") | F.endswith(name, F.lit(".owasp.org"))


def tidy_lines(text: Column) -> Column:
    unix = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(unix, r"(?dm)[ \t]+$", ""), r"\n{3,}", "\n\n"))


def clean(pages: DataFrame, min_content_chars: int = MIN_CONTENT_CHARS) -> DataFrame:
    """Cleaned text, hash, change log and rejection reason of every page.

    ``pages``: url, markdown, metadata (map). Adds cleaned, content_hash,
    changes, meaningful_chars and rejected_reason (null for a good page).
    """
    adapter = F.col("metadata")["source_adapter"]
    out = pages.withColumns({"_owasp": is_owasp(F.col("url"), adapter), "_t0": F.col("markdown")})
    steps = [(name, p, r, None) for name, p, r in GENERAL_RULES] + [(name, p, r, F.col("_owasp")) for name, p, r in OWASP_RULES]
    changes, before = [], "_t0"
    for number, (name, pattern, replacement, condition) in enumerate(steps, start=1):
        after = f"_t{number}"
        value = F.regexp_replace(before, pattern, replacement)
        out = out.withColumn(after, value if condition is None else F.when(condition, value).otherwise(F.col(before)))
        changes.append(F.when(F.col(before) != F.col(after), F.lit(name)))
        before = after
    out = out.withColumn("cleaned", tidy_lines(F.col(before)))
    changes.append(F.when(F.col(before) != F.col("cleaned"), F.lit("whitespace")))
    out = out.withColumns({"changes": F.array_compact(F.array(*changes)), "meaningful_chars": meaningful_length(F.col("cleaned"))})
    minimum = max(int(min_content_chars), 0)
    short = F.when(
        F.col("meaningful_chars") < minimum,
        F.concat(F.lit("Content has "), F.col("meaningful_chars").cast("string"), F.lit(f" meaningful characters; minimum is {minimum}")),
    )
    return out.select(
        *pages.columns, "cleaned", content_hash(F.col("cleaned")).alias("content_hash"), "changes", "meaningful_chars",
        F.coalesce(rejection_reason(F.col("metadata")), short).alias("rejected_reason"),
    )
