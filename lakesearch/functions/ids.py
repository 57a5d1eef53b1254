"""Deterministic identifiers and hashes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The RFC 4122 URL name space.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version 5 UUID of a name, as text, without a Python worker."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def chunk_id(document_id: Column, chunk_index: Column, prefix: str = "lakesearch") -> Column:
    return uuid5(F.concat(F.lit(f"{prefix}:document:"), document_id.cast("string"), F.lit(":chunk:"), chunk_index.cast("string")))


def document_id(job_id: Column, prefix: str = "lakesearch") -> Column:
    return uuid5(F.concat(F.lit(f"{prefix}:ingest:"), job_id.cast("string"), F.lit(":document")))


def experience_chunk_id(experience_id: Column, prefix: str = "lakesearch") -> Column:
    return uuid5(F.concat(F.lit(f"{prefix}:experience-chunk:"), experience_id.cast("string")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
