"""Layout-parser item lists to page-marked text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.text import strip

# Text-bearing fields in the order they are written.
TEXT_FIELDS = ("text", "table_body", "latex")
CAPTION_FIELDS = ("img_caption", "img_footnote", "table_caption", "table_footnote")
ITEM = "page_idx string, " + ", ".join(f"{f} string" for f in TEXT_FIELDS + CAPTION_FIELDS)


def item_text(item: Column) -> Column:
    """Distinct texts of an item; a caption may be one text or a list."""
    def texts(field: str) -> Column:
        value = item[field]
        listed = F.from_json(value, "array<string>")
        given = F.when(F.startswith(F.ltrim(value), F.lit("[")) & listed.isNotNull(), listed) if field in CAPTION_FIELDS else F.lit(None).cast("array<string>")
        return F.coalesce(given, F.array(value))

    every = F.transform(F.concat(*[texts(f) for f in TEXT_FIELDS + CAPTION_FIELDS]), lambda t: strip(F.coalesce(t, F.lit(""))))
    return F.array_join(F.array_distinct(F.filter(every, lambda t: t != "")), "\n\n")


def page_text(lists: DataFrame, key: str = "document_id", column: str = "items") -> DataFrame:
    """One page-marked text per document from a JSON list of items."""
    rows = lists.select(key, F.posexplode(F.from_json(column, f"array<struct<{ITEM.replace(' string', ':string')}>>")).alias("position", "item"))
    numbered = rows.select(key, "position", F.when(F.col("item.page_idx").rlike(r"^\d+$"), F.col("item.page_idx").cast("int") + 1).alias("page_no"), item_text(F.col("item")).alias("text"))
    usable = numbered.where(F.col("page_no").isNotNull() & (F.col("text") != ""))
    per_page = usable.groupBy(key, "page_no").agg(F.sort_array(F.collect_list(F.struct("position", "text"))).alias("parts"))
    body = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n\n"))
    return per_page.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("page_no", body.alias("body")))).alias("pages")).select(
        key, F.array_join(F.transform("pages", lambda p: p["body"]), "\n\n").alias("text")
    )
