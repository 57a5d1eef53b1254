"""Pages, chunks and OCR corrections of extracted texts."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakesearch.functions.ids import chunk_id
from lakesearch.operators.running import running
from lakesearch.session import materialise

# Page marker, headings and separators in order of preference.
PAGE_MARKER = r"(?:^|\n)--- Page (\d+) ---\n"
HAN_NUMBER = r"[一二三四五六七八九十百千万零〇两\d]+"
CHAPTER = rf"第\s*({HAN_NUMBER})\s*章"
ARTICLE = rf"第\s*({HAN_NUMBER})\s*条"
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", "，", " ", "")
TARGET_TOKENS, OVERLAP_TOKENS = 384, 64

ROWS_PER_BUCKET = 4096


def pages(docs: DataFrame, keys: tuple = ("document_id",)) -> DataFrame:
    """One row per page in order: text before the first marker has no page number."""
    numbers = F.regexp_extract_all("text", F.lit(PAGE_MARKER), F.lit(1))
    bodies = F.split("text", PAGE_MARKER)
    both = F.arrays_zip(F.concat(F.array(F.lit(None).cast("string")), numbers).alias("number"), bodies.alias("body"))
    rest = [c for c in docs.columns if c != "text" and c not in keys]
    out = docs.select(*keys, *rest, F.posexplode(both).alias("page_position", "p"))
    return out.select(*keys, *rest, "page_position", F.col("p.number").cast("int").alias("page_no"), F.col("p.body").alias("text")).where(
        F.regexp_replace("text", r"(?U)\s+", "") != ""
    )


def legal_structure(chunks: DataFrame, keys: tuple = ("document_id",)) -> DataFrame:
    """Chapter and article in force at each chunk; a new chapter ends the article before it."""
    chapter = F.nullif(F.regexp_extract("text", CHAPTER, 1), F.lit(""))
    article = F.nullif(F.regexp_extract("text", ARTICLE, 1), F.lit(""))
    at = F.col("chunk_index")
    values = {
        "_chapter": ("last", F.when(chapter.isNotNull(), F.struct(at.alias("at"), chapter.alias("no")))),
        "_article": ("last", F.when(article.isNotNull(), F.struct(at.alias("at"), article.alias("no")))),
    }
    out = running(chunks, list(keys), F.floor(at / ROWS_PER_BUCKET), ["chunk_index"], values)
    in_force = F.col("_article.at") >= F.coalesce("_chapter.at", F.lit(0))
    return out.withColumns({
        "chapter_no": F.col("_chapter.no"), "article_no": F.when(in_force, F.col("_article.no")),
        "content_type": F.when(in_force & F.col("_article.no").isNotNull(), "legal_article"),
    }).drop("_chapter", "_article")


def split_text(text: str, count: Callable[[str], int], target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, separators: tuple = SEPARATORS) -> list[str]:
    """Pieces of at most ``target`` tokens that break at the strongest separator present.

    A separator stays at the start of the piece after it. Neighbouring pieces
    are packed up to the target, and a new piece repeats up to ``overlap``
    tokens from the end of the one before.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, weaker = separators[level], separators[level + 1:]
    if mark:
        head, *tail = text.split(mark)
        units = [u for u in [head, *(mark + t for t in tail)] if u]
    else:
        units = list(text)
    out, run = [], []
    for unit in units:
        size = count(unit)
        if size < target:
            run.append((unit, size))
            continue
        out += _pack(run, target, overlap)
        run = []
        out += split_text(unit, count, target, overlap, weaker) if weaker else [unit]
    return out + _pack(run, target, overlap)


def _pack(units: list, target: int, overlap: int) -> list[str]:
    pieces, start, total = [], 0, 0
    for end, (_, size) in enumerate(units):
        if total + size > target and end > start:
            pieces.append("".join(u for u, _ in units[start:end]).strip())
            while start < end and (total > overlap or (total + size > target and total > 0)):
                total -= units[start][1]
                start += 1
        total += size
    pieces.append("".join(u for u, _ in units[start:]).strip())
    return [p for p in pieces if p]


def default_count(text: str) -> int:
    return max(1, len(text) // 4)


def chunk_documents(docs: DataFrame, count: Callable[[str], int] = default_count, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, key: str = "document_id") -> DataFrame:
    """Chunks of documents: page-aware, numbered, with the legal headings in force.

    Pages are separate rows, so the parts of a long document are split in
    parallel and no chunk crosses a page.
    """
    kind = docs.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = [split_text(t.strip(), count, target, overlap) for t in batch["text"]]
            out = batch.assign(text=pieces).explode("text")
            out["piece"] = out.groupby(level=0).cumcount()
            out["token_count"] = [count(t) for t in out["text"]]
            yield out

    schema = f"{key} {kind}, page_position int, page_no int, text string, piece int, token_count int"
    parts = pages(docs.select(key, "text"), (key,)).select(key, "page_position", "page_no", "text").mapInPandas(split, schema)
    parts = materialise(parts, "chunk-parts")  # read for the sizes and for the rows, split once
    # The pieces of a page are counted first, so numbering needs only the page list of a document.
    sizes = parts.groupBy(key, "page_position").agg(F.count("*").alias("n"))
    first = Window.partitionBy(key).orderBy("page_position").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "page_position", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("offset"))
    numbered = parts.join(offsets, [key, "page_position"]).withColumn("chunk_index", (F.col("offset") + F.col("piece")).cast("int"))
    rows = numbered.select(key, "chunk_index", "text", "page_no", F.col("page_no").cast("string").alias("page_span"), "token_count")
    return legal_structure(rows, (key,))


def chunk_rows(chunks: DataFrame, model: str, dimension: int, provider: str, profile: Column | None = None, kb: Column | None = None, tokenizer: str = "chars/4", target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Stored chunk rows with ids, model columns and merged metadata."""
    none = F.lit(None).cast("string")
    written = F.create_map(
        F.lit("page_no"), F.col("page_no").cast("string"), F.lit("page_span"), F.col("page_span"), F.lit("chunk_tokenizer_model"), F.lit(tokenizer),
        F.lit("chunk_target_tokens"), F.lit(str(target)), F.lit("chunk_overlap_tokens"), F.lit(str(overlap)), F.lit("chapter_no"), F.col("chapter_no"),
        F.lit("article_no"), F.col("article_no"), F.lit("content_type"), F.col("content_type"), F.lit("embedding_provider"), F.lit(provider),
        F.lit("embedding_profile"), profile if profile is not None else none, F.lit("knowledge_base_id"), kb if kb is not None else none,
    )
    return chunks.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"), "document_id", "chunk_index", "text", "token_count", "page_no",
        F.lit(model).alias("embedding_model"), F.lit(dimension).alias("embedding_dim"), F.map_filter(written, lambda k, v: v.isNotNull()).alias("metadata"), F.lit("active").alias("chunk_status"),
    )


def effective_regions(regions: DataFrame) -> DataFrame:
    """Text in force of every OCR region: the correction when there is one."""
    text = F.when(F.col("status") == "corrected", F.col("corrected_text")).otherwise(F.col("ocr_text"))
    return regions.withColumn("text", F.coalesce(text, F.lit("")))


def merge_ocr(docs: DataFrame, regions: DataFrame, key: str = "document_id") -> DataFrame:
    """Texts rebuilt from the text layer and the OCR regions.

    ``docs``: key, text; ``regions``: key, page_no, sequence, text. Region texts
    follow the page's own text in sequence; regions without a page come last;
    pages without text are dropped. A text without pages is kept only when no
    region names a page.
    """
    tidy = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    in_order = lambda: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "text"))), lambda s: s["text"]), "\n\n")
    numbers = F.regexp_extract_all("text", F.lit(PAGE_MARKER), F.lit(1))
    listed = docs.select(key, F.posexplode(F.arrays_zip(numbers.alias("n"), F.slice(F.split("text", PAGE_MARKER), F.lit(2), F.greatest(F.size(numbers), F.lit(1))).alias("b"))).alias("p", "z"))
    base = listed.where(F.col("z.n").isNotNull()).groupBy(key, F.col("z.n").cast("int").alias("page_no")).agg(tidy(F.max_by("z.b", "p")).alias("body"))
    found = regions.withColumn("text", tidy(F.coalesce("text", F.lit("")))).where("text != ''")
    paged = found.where(F.col("page_no") > 0).groupBy(key, "page_no").agg(in_order().alias("ocr"))
    loose = found.where(F.col("page_no").isNull() | (F.col("page_no") <= 0)).groupBy(key).agg(in_order().alias("tail"))
    empty = lambda c: F.nullif(c, F.lit(""))
    both = base.join(paged, [key, "page_no"], "full").withColumn("body", F.concat_ws("\n\n", empty(F.col("body")), F.col("ocr")))
    shown = F.when(F.col("body") != "", F.struct("page_no", F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.col("body")).alias("t")))
    per_document = both.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda s: s["t"]), "\n\n").alias("paged"))
    out = docs.select(key, "text").join(per_document, key, "left").join(loose, key, "left")
    head = F.when(F.col("paged").isNotNull(), empty(F.col("paged"))).otherwise(empty(tidy(F.coalesce("text", F.lit("")))))
    return out.select(key, tidy(F.concat_ws("\n\n", head, F.col("tail"))).alias("text"))


def republish(docs: DataFrame, regions: DataFrame, count: Callable[[str], int] = default_count) -> DataFrame:
    """Chunks of the documents that have corrected regions, from their rebuilt texts."""
    touched = regions.where(F.col("status") == "corrected").select("document_id").distinct()
    affected = docs.join(touched, "document_id", "left_semi")
    return chunk_documents(merge_ocr(affected, effective_regions(regions).join(touched, "document_id", "left_semi")), count)
