"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is a run of consecutive words of a benchmark item; its tokens are the shingles of a few words inside it. Shingles are
counted over all documents and ordered by rarity. A document can only hold a window if it holds all of its shingles, so the
first shingle in that order (the prefix that containment needs) is the only one that is joined. The place of the shingle in the
window says where the window would have to begin in the document: length and position bounds drop what would stick out, and what
is left is compared word by word over a stretch as long as the window.

Both passes over the documents stay in one stage each: words are an array, positions are exploded against it and looked up in a
broadcast table whose size is counted. Item sets beyond that size are joined by a shuffle of (shingle, document, position).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakesearch.llm.rows import materialise
from lakesearch.session import broadcast_within

WINDOW, SHINGLE = 10, 3
#: Rows of item shingles or windows sent to all tasks; more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, window: int, id_column: str, text: str) -> DataFrame:
    """words (array), len, item_ids (of the items that hold the window, as sorted strings)."""
    words = items.select(F.col(f"`{id_column}`").cast("string").alias("item_id"), words_of(F.col(f"`{text}`")).alias("w")).where("size(w) > 0")
    cut = words.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1)))).alias("i"))
    runs = cut.select("item_id", F.slice("w", F.col("i"), F.lit(window)).alias("words"))
    found = runs.groupBy("words").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return found.select("words", F.size("words").alias("len"), "item_ids")


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """``windows`` with one row a shingle: span (words of a shingle), at (its place in the window), token (hash)."""
    span = F.least(F.lit(shingle), F.col("len"))
    placed = windows.select("*", span.alias("span")).select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("span"))).alias("at"))
    return placed.select("*", _token_of(F.col("words"), F.col("at"), shingle).alias("token"))


def _token_of(words: Column, at: Column, shingle: int, span: Column | None = None) -> Column:
    """Hash of up to ``shingle`` words from position ``at``; the number of words is part of it."""
    span = F.col("span") if span is None else span
    parts = [F.when(span > k, F.get(words, at + k)) for k in range(shingle)]
    return F.xxhash64(span, *parts)


def document_tokens(rows: DataFrame, spans: list[int], shingle: int) -> DataFrame:
    """``rows`` (w and more) with one row for each position and span, and one of position -1 that keeps the document: p, span, token."""
    placed = rows.select("*", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("p"))
    if len(spans) == 1:
        spread = placed.select("*", F.lit(spans[0]).alias("span"))
    else:
        spread = placed.select("*", F.explode(F.when(F.col("p") < 0, F.array(F.lit(0))).otherwise(F.array(*map(F.lit, spans)))).alias("span"))
    inside = (F.col("p") >= 0) & (F.col("p") + F.col("span") <= F.size("w"))
    return spread.where((F.col("p") < 0) | inside).select("*", F.when(F.col("p") >= 0, _token_of(F.col("w"), F.col("p"), shingle)).alias("token"))


def rarest_shingles(rows: DataFrame, windows: DataFrame, spans: list[int], shingle: int, most: int) -> DataFrame:
    """The prefix of each window: its rarest shingle over all documents (ties: by hash, then place)."""
    shingles = materialise(window_shingles(windows, shingle), "leak-shingles")
    wanted, _ = broadcast_within(shingles.select("token").distinct(), most)
    counts = document_tokens(rows.select("w"), spans, shingle).where("p >= 0").select("token").join(wanted, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ordered = shingles.join(counts, "token", "left").select("words", "len", "item_ids", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at").alias("x"))
    first = ordered.groupBy("words", "len").agg(F.min("x").alias("x"), F.first("item_ids").alias("item_ids"))
    # a window whose rarest shingle is nowhere is nowhere itself
    return first.where("x.n > 0").select("words", "len", "item_ids", F.col("x.at").alias("at"), F.col("x.token").alias("token"))


def occurrences(rows: DataFrame, prefixes: DataFrame, spans: list[int], shingle: int, most: int) -> DataFrame:
    """row, doc_id, n_words, begin, len, item_ids: where windows occur, and a row without a window (begin null) for each document."""
    begin, hit = F.col("p") - F.col("at"), F.col("token").isNotNull() & F.col("words").isNotNull()
    fits = (begin >= 0) & (begin + F.col("len") <= F.col("n_words"))
    same = F.slice("w", begin + 1, F.col("len")) == F.col("words")
    table, small = broadcast_within(prefixes, most)
    if small:
        found = document_tokens(rows, spans, shingle).join(table, "token", "left").where((F.col("p") < 0) | (hit & fits)).where((F.col("p") < 0) | same)
        return found.select("row", "doc_id", "n_words", F.when(F.col("p") >= 0, begin).alias("begin"), "len", "item_ids")
    # many windows: only hashes and positions are shuffled, and the words of documents with candidates are fetched afterwards
    rows = materialise(rows, "leak-words")
    may = document_tokens(rows.select("row", "n_words", "w"), spans, shingle).where("p >= 0").select("row", "n_words", "p", "token").join(prefixes, "token").where(fits)
    may = materialise(may.select("row", begin.alias("begin"), "len", "words", "item_ids"), "leak-candidates")
    held = rows.select("row", "w").join(may, "row").where(F.slice("w", F.col("begin") + 1, F.col("len")) == F.col("words")).select("row", "begin", "len", "item_ids")
    return rows.select("row", "doc_id", "n_words").join(held, "row", "left").unionByName(rows.select("row", "doc_id", "n_words", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("array<string>").alias("item_ids")))


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans for every row of ``docs``: words that lie in an occurrence of a window of an item.

    Words: see ``words_of``. An item of fewer words than ``window`` is one window, one without words has none. ``item_ids`` are
    sorted strings; an item with a null id still hits words but isn't named. ``spans`` (begin, end) are the maximal runs of hit
    words, counted from 0. Null and empty documents have no words and a row of zeros; repeated rows get a row each; other columns
    aren't looked at. Without items no word is hit; an empty ``docs`` gives no rows.
    """
    windows = materialise(item_windows(items, window, item_id, item_text), "leak-windows")
    spans = sorted(r[0] for r in windows.select(F.least(F.lit(shingle), F.col("len"))).distinct().collect()) or [shingle]  # shingle values at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").alias("doc_id"), words_of(F.col(f"`{text}`")).alias("w"))
    rows = rows.select("*", F.size("w").alias("n_words"))
    prefixes = materialise(rarest_shingles(rows, windows, spans, shingle, most), "leak-prefixes")
    found = occurrences(rows, prefixes, spans, shingle, most)
    by_row = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("begin").isNotNull(), F.struct("begin", (F.col("begin") + F.col("len")).alias("end"))))).alias("runs"),
        F.collect_set(F.when(F.col("begin").isNotNull(), F.col("item_ids"))).alias("ids"),
    )
    named = F.array_sort(F.array_distinct(F.flatten("ids")))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda x: F.sequence(x["begin"], x["end"] - 1)))))
    first = F.filter("covered", lambda x, i: (i == 0) | (F.get("covered", i - 1) < x - 1))
    last = F.filter("covered", lambda x, i: (i == F.size("covered") - 1) | (F.get("covered", i + 1) > x + 1))
    spans_of = F.zip_with(first, F.transform(last, lambda x: x + 1), lambda a, b: F.struct(a.alias("begin"), b.alias("end")))
    hit = by_row.select("doc_id", F.col("n_words").cast("long").alias("n_words"), named.alias("item_ids"), covered.alias("covered"))
    return hit.select("doc_id", "n_words", F.size("covered").cast("long").alias("n_hit"), "item_ids", spans_of.alias("spans"))
