"""Security identifiers: extraction, typing and the index field bundle."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesearch.functions.text import alias_list, heading_title, strip

# Identifier shapes and the type each family stands for.
_SEPARATOR = r"(?:\s*[-_:]\s*|\s+)"
IDENTIFIER = (
    rf"(?iU)(?<![A-Z0-9])(?:CVE{_SEPARATOR}\d{{4}}\s*[-_:]\s*\d{{4,}}|(?:CWE|CAPEC){_SEPARATOR}\d{{1,7}})(?!\d)"
)
ENTITY_TYPES = {"CVE": "vulnerability", "CWE": "weakness", "CAPEC": "attack_pattern"}

# Metadata keys read, in order of preference.
PRIMARY_KEYS = ("entity_id", "normalized_identifier", "canonical_id", "document_identifier")
TITLE_KEYS = ("title", "name", "document_title")
ALIAS_KEYS = ("aliases", "alias")


def _canonical(found: Column) -> Column:
    compact = F.regexp_replace(F.upper(found), r"(?U)\s*[-_:]\s*|\s+", "-")
    return compact


def entity_ids(*texts: Column) -> Column:
    """Distinct canonical identifiers in order of first mention over all texts."""
    lists = [
        F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), _canonical)
        for text in texts
    ]
    return F.array_distinct(F.concat(*lists))


def entity_type(entity_id: Column) -> Column:
    prefix = F.split_part(entity_id, F.lit("-"), F.lit(1))
    kind = F.lit(None).cast("string")
    for family, name in ENTITY_TYPES.items():
        kind = F.when(prefix == family, F.lit(name)).otherwise(kind)
    return kind


def file_stem(name: Column) -> Column:
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")
    return F.nullif(stem, F.lit(""))


def entity_fields(text: Column, filename: Column, metadata: Column) -> Column:
    """Struct of the identifier and title fields both indexes share.

    ``metadata`` is a map of strings; a title there wins over a heading, which
    wins over the file stem.
    """
    given = F.coalesce(*[metadata[key] for key in TITLE_KEYS])
    title = F.coalesce(
        F.nullif(strip(given), F.lit("")), heading_title(text), file_stem(filename)
    )
    ids = F.array_distinct(
        F.concat(
            entity_ids(*[metadata[key] for key in PRIMARY_KEYS]),
            entity_ids(filename),
            entity_ids(title),
            entity_ids(text),
        )
    )
    primary = F.get(ids, F.lit(0))
    aliases = F.array_distinct(F.concat(*[alias_list(metadata[key]) for key in ALIAS_KEYS], ids))
    kinds = F.array_distinct(F.array_compact(F.transform(ids, entity_type)))
    return F.struct(
        primary.alias("entity_id"),
        entity_type(primary).alias("entity_type"),
        ids.alias("entity_ids"),
        kinds.alias("entity_types"),
        title.alias("title"),
        aliases.alias("aliases"),
    )


def match_priority(primary_id: Column, ids: Column, wanted: Column) -> Column:
    """2 for the primary identifier, 1 for any other named one, else 0."""
    return (
        F.when(F.coalesce(F.array_contains(wanted, primary_id), F.lit(False)), F.lit(2))
        .when(F.coalesce(F.arrays_overlap(ids, wanted), F.lit(False)), F.lit(1))
        .otherwise(F.lit(0))
    )
