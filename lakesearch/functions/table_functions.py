"""Hooks for SQL: the chunk table functions and a pluggable token counter."""

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lakesearch.operators.chunking import ARTICLE, CHAPTER, OVERLAP_TOKENS, TARGET_TOKENS, default_count, split_text

MADE = (
    ("chunk_index", T.IntegerType()), ("text", T.StringType()), ("token_count", T.IntegerType()),
    ("chapter_no", T.StringType()), ("article_no", T.StringType()), ("content_type", T.StringType()),
)
_CHAPTER, _ARTICLE = re.compile(CHAPTER, re.ASCII), re.compile(ARTICLE, re.ASCII)


def register_chunk_function(spark: SparkSession, name: str = "chunk_text", count: Callable[[str], int] = default_count, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS) -> None:
    """Register ``name(text)`` as a table function giving position, text and token count."""

    @F.udtf(returnType="position int, chunk string, token_count int")
    class Chunks:
        def eval(self, text: str):
            for position, piece in enumerate(split_text((text or "").strip(), count, target, overlap)):
                yield position, piece, count(piece)

    spark.udtf.register(name, Chunks)


def register_chunk_table(spark: SparkSession, name: str = "chunk_table", count: Callable[[str], int] = default_count) -> None:
    """Register a table function that chunks a whole table of pages and keeps its columns.

    ``SELECT * FROM name(TABLE(pages) PARTITION BY document_id ORDER BY (page_position), 'text')``: a partition is a document, its
    rows are the pages in order. The result has every column of the table but the text column, and chunk_index (over the
    document), text, token_count, chapter_no, article_no and content_type. Further arguments are the target and the overlap in
    tokens. Pages are read one after the other; what is kept between them is a number and the headings in force.
    """

    @F.udtf
    class ChunkTable:
        def __init__(self):
            self.index, self.chapter, self.article = 0, None, None

        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument, target: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument must be TABLE(...)")
            if not isinstance(text.value, str) or text.value not in rows.dataType.fieldNames():
                raise ValueError("the second argument must name a column of the table")
            made = [T.StructField(n, k) for n, k in MADE]
            clash = {f.name.lower() for f in rows.dataType if f.name != text.value} & {n for n, _ in MADE}
            if clash:
                raise ValueError(f"columns of the table clash with the result: {sorted(clash)}")
            return AnalyzeResult(schema=T.StructType([f for f in rows.dataType if f.name != text.value] + made))

        def eval(self, row: T.Row, text: str, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS):
            kept = [v for k, v in row.asDict().items() if k != text]
            for piece in split_text((row[text] or "").strip(), count, target, overlap):
                if found := _CHAPTER.search(piece):
                    self.chapter = (self.index, found[1])
                if found := _ARTICLE.search(piece):
                    self.article = (self.index, found[1])
                in_force = self.article and self.article[0] >= (self.chapter[0] if self.chapter else 0)
                article = self.article[1] if in_force else None
                yield (*kept, self.index, piece, count(piece), self.chapter and self.chapter[1], article, "legal_article" if article else None)
                self.index += 1

    spark.udtf.register(name, ChunkTable)


def token_counter(count: Callable[[str], int]):
    """A vectorised column function from a plain token counter."""

    @F.pandas_udf("int")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: count(t or "")).astype("int32")

    return counted
