"""Closed vocabularies, defaults and timestamps."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesearch.functions.text import strip

# Closed vocabularies of the data model.
SOURCE_TYPES = ("document", "experience", "playbook")
VISIBILITIES = ("global", "workspace")
EFFECTIVENESS = ("unknown", "promising", "effective", "ineffective")

# MIME type by file extension.
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".txt": "text/plain", ".log": "text/plain", ".text": "text/plain",
    ".md": "text/markdown", ".markdown": "text/markdown",
    ".csv": "text/csv", ".json": "application/json",
    ".html": "text/html", ".htm": "text/html",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp",
    ".gif": "image/gif", ".bmp": "image/bmp", ".tif": "image/tiff", ".tiff": "image/tiff",
}

# Old names of embedding profiles.
PROFILE_ALIASES = {
    "qwen3.7-text-embedding-native-2560": "qwen3.7-text-embedding-2560",
    "text-embedding-v4-native-2048": "text-embedding-v4-2048",
}


def one_of(value: Column, allowed, default) -> Column:
    """The value when allowed, else the default."""
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def optional_string(value: Column) -> Column:
    return F.nullif(value.cast("string"), F.lit(""))


def source_type(value: Column, fallback: Column) -> Column:
    return one_of(F.coalesce(optional_string(value), fallback), SOURCE_TYPES, "document")


def visibility(value: Column) -> Column:
    return one_of(value, VISIBILITIES, "global")


def effectiveness(value: Column) -> Column:
    return F.when(value.isNotNull(), one_of(value, EFFECTIVENESS, "unknown"))


def conflict_policy(value: Column) -> Column:
    """``manual`` or ``keep_new``; null stands for a refused value."""
    policy = F.lower(strip(F.coalesce(F.nullif(value, F.lit("")), F.lit("manual"))))
    return F.when(policy.isin("manual", "keep_new"), policy)


def iso_timestamp(value: Column) -> Column:
    """ISO-8601 text as a UTC timestamp; null when it cannot be read."""
    text = F.regexp_replace(strip(value), r"Z$", "+00:00")
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?([+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(text))


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=[^/])(\.[^./]+)$", 1))


def mime_by_extension(name: Column) -> Column:
    table = F.create_map(*[F.lit(v) for v in chain.from_iterable(MIME_BY_EXTENSION.items())])
    return table[extension(name)]


def embedding_profile(value: Column) -> Column:
    name = strip(F.coalesce(F.nullif(value, F.lit("")), F.lit("configured")))
    for old, new in PROFILE_ALIASES.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    return name


def minimum_vector_score(model: Column, dimension: Column) -> Column:
    """Calibrated acceptance threshold by model family and dimension."""
    name = F.lower(strip(model))
    return (
        F.when(F.contains(name, F.lit("qwen3.7-text-embedding")), F.when(dimension >= 2560, 0.575).otherwise(0.60))
        .when(F.contains(name, F.lit("qwen3-embedding")), F.lit(0.52))
        .when(F.contains(name, F.lit("bge-m3")), F.lit(0.575))
        .when(F.contains(name, F.lit("text-embedding-v4")), F.when(dimension >= 2048, 0.575).otherwise(0.58))
        .otherwise(F.lit(0.50))
    )
