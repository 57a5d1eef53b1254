"""Word tokens for keyword search and token counts for chunk sizes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is one Han character or a run of other letters and digits. ASCII is tried first, and the slow script
# test only from U+2E80 on, where the Han script begins: the same tokens as of \p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+.
HAN = r"[\x{2E80}-\x{10FFFF}&&\p{IsHan}]"
TOKEN = rf"[a-z0-9[\p{{L}}\p{{N}}&&[^{HAN}]]]+|{HAN}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def approximate_token_count(text: Column) -> Column:
    """One token per four characters, never less than one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def offline_keyword_score(text: Column, query: Column) -> Column:
    """Repeatable keyword score for runs without an index.

    0.3 per distinct query word found, a hash-derived part below 0.5 and 0.1;
    0 when no word is found.
    """
    words = F.array_distinct(
        F.filter(F.split(F.lower(query), r"(?U)\s+"), lambda w: w != "")
    )
    lowered = F.lower(text)
    hits = F.size(F.filter(words, lambda w: F.contains(lowered, w)))
    return F.when(hits > 0, score_of_hits(hits, text, query)).otherwise(F.lit(0.0))


def score_of_hits(hits: Column, text: Column, query: Column) -> Column:
    """The same score when the number of found words is known and not 0."""
    digest = F.sha2(F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("00")), F.encode(query, "UTF-8")), 256)
    return score_of_seed(hits, F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100)


def score_of_seed(hits: Column, seed: Column) -> Column:
    """The same score when the hash-derived number (0 to 99) is known too."""
    return hits * 0.3 + seed / 200.0 + 0.1
