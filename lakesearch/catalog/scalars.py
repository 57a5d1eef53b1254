"""Scalar functions over the given tables."""

from pyspark.sql import functions as F

from lakesearch.catalog.bindings import DOCS, documents, table, with_
from lakesearch.catalog.registry import query
from lakesearch.functions import coerce, entities, ids, text, urls
from lakesearch.functions.tokens import approximate_token_count

# SQL twin of urls.normalize_url for a column named url.
NORMAL_URL = r"""
  lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))
  || CASE WHEN regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) END
  || CASE WHEN len(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid','gclid','mc_cid','mc_eid'))) > 0
     THEN '?' || array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
            lambda p: p <> '' AND NOT starts_with(lower(split_part(p, '=', 1)), 'utm_') AND lower(split_part(p, '=', 1)) NOT IN ('fbclid','gclid','mc_cid','mc_eid')), '&')
     ELSE '' END"""


@query("x01_normalize_url", f"SELECT page_id, {NORMAL_URL} AS normal_url FROM pages")
def normalize_url(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normal_url"))


@query(
    "x02_clean_text",
    r"""SELECT doc_id, sha256(trim(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)),
          lambda l: trim(regexp_replace(l, '[ \t]+', ' ', 'g'))), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10))) AS clean_hash
        FROM documents""",
)
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.content_hash(text.clean_text(F.col("text"))).alias("clean_hash"))


@query(
    "x03_truncate_marked",
    """SELECT doc_id, CASE WHEN length(text) > 400 THEN rtrim(left(text, 400), ' ' || chr(10)) || chr(10) || chr(10) || '…[truncated]' ELSE text END AS body
       FROM documents""",
)
def truncate_marked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate_marked(F.col("text"), 400).alias("body"))


# The texts hold no identifiers, so some are written in front of them, derived from the key.
def _tagged(col="text"):
    key = F.col("doc_id")
    return F.concat(
        F.lit("see cve_2024-"), (key + 1000).cast("string"), F.lit(", CWE: "), (key % 900 + 1).cast("string"),
        F.lit("; capec "), (key % 500 + 1).cast("string"), F.lit(" and CVE-2024-"), (key + 1000).cast("string"), F.lit(". "), col,
    )


TAGGED = "'see cve_2024-' || (doc_id + 1000) || ', CWE: ' || (doc_id % 900 + 1) || '; capec ' || (doc_id % 500 + 1) || ' and CVE-2024-' || (doc_id + 1000) || '. ' || text"
ENTITY_LIST = r"""list_transform(regexp_extract_all(t, '(?i)\b(?:CVE(?:\s*[-_:]\s*|\s+)\d{4}\s*[-_:]\s*\d{4,}|(?:CWE|CAPEC)(?:\s*[-_:]\s*|\s+)\d{1,7})\b'),
      lambda m: regexp_replace(upper(m), '\s*[-_:]\s*|\s+', '-', 'g'))"""
ENTITY_IDS = f"list_filter({ENTITY_LIST}, lambda x, i: list_position({ENTITY_LIST}, x) = i)"
ENTITY_KIND = "CASE split_part(e, '-', 1) WHEN 'CVE' THEN 'vulnerability' WHEN 'CWE' THEN 'weakness' WHEN 'CAPEC' THEN 'attack_pattern' END"


@query(
    "x04_entity_ids",
    f"SELECT doc_id, array_to_string({ENTITY_IDS}, ',') AS entity_ids FROM (SELECT doc_id, {TAGGED} AS t FROM documents)",
)
def entity_ids(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(entities.entity_ids(_tagged()), ",").alias("entity_ids"))


@query(
    "x05_entity_type",
    f"""SELECT kind, count(*) AS n FROM (SELECT {ENTITY_KIND} AS kind FROM
        (SELECT unnest({ENTITY_IDS}) AS e FROM (SELECT doc_id, {TAGGED} AS t FROM documents))) GROUP BY kind""",
)
def entity_type(spark, sf):
    docs = table(spark, sf, "documents")
    found = docs.select(F.explode(entities.entity_ids(_tagged())).alias("entity_id"))
    return found.groupBy(entities.entity_type(F.col("entity_id")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "x06_entity_fields",
    f"""SELECT doc_id, 'CVE-2024-' || (doc_id + 1000) AS entity_id, 'vulnerability' AS entity_type,
          'CVE-2024-' || (doc_id + 1000) || ',CWE-' || (doc_id % 900 + 1) || ',CAPEC-' || (doc_id % 500 + 1) AS entity_ids,
          'vulnerability,weakness,attack_pattern' AS entity_types,
          CASE WHEN lang = 'en' THEN 'Note ' || doc_id ELSE 'CVE-2024-' || (doc_id + 1000) END AS title,
          'src ' || source || ',known,' || 'CVE-2024-' || (doc_id + 1000) || ',CWE-' || (doc_id % 900 + 1) || ',CAPEC-' || (doc_id % 500 + 1) AS aliases
        FROM documents""",
)
def entity_fields(spark, sf):
    docs = table(spark, sf, "documents")
    metadata = F.create_map(
        F.lit("title"), F.when(F.col("lang") == "en", F.concat(F.lit("Note "), F.col("doc_id").cast("string"))),
        F.lit("aliases"), F.concat(F.lit("src "), "source", F.lit(" , known,")),
    )
    name = F.concat(F.lit("CVE-2024-"), (F.col("doc_id") + 1000).cast("string"), F.lit(".md"))
    out = docs.select("doc_id", entities.entity_fields(_tagged(), name, metadata).alias("f"))
    return out.select(
        "doc_id", "f.entity_id", "f.entity_type", F.array_join("f.entity_ids", ",").alias("entity_ids"),
        F.array_join("f.entity_types", ",").alias("entity_types"), "f.title", F.array_join("f.aliases", ",").alias("aliases"),
    )


@query(
    "x07_heading_title",
    r"""SELECT doc_id, nullif(trim(regexp_extract('intro' || chr(10) || '## ' || text, '(?m)^\s{0,3}#{1,6}\s+(.+?)\s*#*\s*$', 1)), '') AS title FROM documents""",
)
def heading_title(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.heading_title(F.concat(F.lit("intro\n## "), "text")).alias("title")
    )


@query(
    "x08_alias_list",
    "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, ','), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> ''), '|') AS aliases FROM documents",
)
def alias_list(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.alias_list(F.col("text")), "|").alias("aliases"))


@query(
    "x09_redact_secrets",
    r"""SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{12,}', 'Bearer [REDACTED]', 'g'),
          '(?i)\b(api[_-]?key|access[_-]?token|password|passwd|secret)\s*[:=]\s*([^\s,;]+)', '\1=[REDACTED]', 'g') AS redacted
        FROM (SELECT doc_id, replace(text, ' token = ', ' access_token = ') || ' Bearer abcdef' || (1000000 + doc_id) AS t FROM documents)""",
)
def redact_secrets(spark, sf):
    t = F.concat(
        F.replace(F.col("text"), F.lit(" token = "), F.lit(" access_token = ")),
        F.lit(" Bearer abcdef"), (F.col("doc_id") + 1000000).cast("string"),
    )
    return table(spark, sf, "documents").select("doc_id", text.redact_secrets(t).alias("redacted"))


@query(
    "x10_safe_error",
    r"""SELECT doc_id, CASE WHEN regexp_matches(lower(t), 'api_key|authorization|bearer |sk-|password') THEN 'OCR provider error (details redacted)' ELSE left(t, 200) END AS message
        FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""",
)
def safe_error(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.safe_error(F.col("text")).alias("message"))


@query(
    "x11_bullet_text",
    "SELECT doc_id, '- lang: ' || lang || chr(10) || '- source: ' || source AS bullets FROM documents",
)
def bullet_text(spark, sf):
    fields = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("none"), F.lit(None).cast("string"), F.lit("source"), F.concat(F.lit(" "), "source", F.lit(" ")),
    )
    return table(spark, sf, "documents").select("doc_id", text.bullet_text(fields).alias("bullets"))


@query(
    "x12_canonical_markdown",
    with_(DOCS, """SELECT document_id, sha256('# ' || title || chr(10) || chr(10) || '> 来源：' || source_uri || chr(10) || chr(10) || trim(text, ' ' || chr(10))) AS page_hash FROM docs"""),
)
def canonical_markdown(spark, sf):
    # as in the SQL, a blank document keeps the blank lines below its source line
    page = text.page_markdown(F.col("title"), F.col("source_uri"), F.col("text"))
    return documents(spark, sf).select("document_id", ids.content_hash(page).alias("page_hash"))


@query(
    "x14_normalized_query",
    r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS query FROM conversations",
)
def normalized_query(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.collapse_spaces(F.col("text")).alias("query"))


@query(
    "x15_mime_by_extension",
    r"""SELECT page_id, CASE lower(regexp_extract(url, '[^/](\.[^./?#]+)$', 1)) WHEN '.html' THEN 'text/html' WHEN '.htm' THEN 'text/html' WHEN '.pdf' THEN 'application/pdf'
          WHEN '.txt' THEN 'text/plain' WHEN '.md' THEN 'text/markdown' WHEN '.json' THEN 'application/json' WHEN '.csv' THEN 'text/csv' END AS mime FROM pages""",
)
def mime_by_extension(spark, sf):
    return table(spark, sf, "pages").select("page_id", coerce.mime_by_extension(F.col("url")).alias("mime"))


@query(
    "x16_json_block",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, length(props) AS block_length FROM events""",
)
def json_block(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    block = text.json_block(fenced)
    return table(spark, sf, "events").select(
        "event_id", F.from_json(block, "k bigint")["k"].alias("k"), F.length(block).cast("bigint").alias("block_length")
    )


@query(
    "x17_iso_timestamp",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE date_trunc('second', ts) - CASE WHEN event_type = 'view' THEN INTERVAL 8 HOUR ELSE INTERVAL 0 HOUR END END AS at FROM events""",
)
def iso_timestamp(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("about "), stamp))
        .when(F.col("event_type") == "view", F.concat(stamp, F.lit("+08:00")))
        .when(F.col("event_type") == "click", F.concat(stamp, F.lit("Z")))
        .otherwise(stamp)
    )
    return table(spark, sf, "events").select("event_id", coerce.iso_timestamp(given).alias("at"))


@query(
    "x18_vocabulary",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'experience' ELSE 'document' END AS source_type,
          CASE WHEN o_orderstatus = 'O' THEN 'workspace' ELSE 'global' END AS visibility,
          CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'effective' ELSE 'unknown' END AS effectiveness
       FROM orders""",
)
def vocabulary(spark, sf):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    none = F.lit(None).cast("string")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        coerce.source_type(F.when(status == "F", "experience").otherwise(""), priority).alias("source_type"),
        coerce.visibility(F.when(status == "O", "workspace").otherwise(priority)).alias("visibility"),
        coerce.effectiveness(F.when(status == "P", none).when(priority == "1-URGENT", "effective").otherwise(priority)).alias("effectiveness"),
    )


@query(
    "x19_minimum_vector_score",
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' OR p_brand LIKE 'Brand#1%' THEN 'qwen3.7-text-embedding-2560' ELSE p_brand END AS profile,
          CASE WHEN p_brand LIKE 'Brand#1%' THEN (CASE WHEN p_size * 100 >= 2560 THEN 0.575 ELSE 0.6 END) WHEN p_brand LIKE 'Brand#2%' THEN 0.52
               WHEN p_brand LIKE 'Brand#3%' THEN (CASE WHEN p_size * 100 >= 2048 THEN 0.575 ELSE 0.58 END) ELSE 0.5 END AS min_score
       FROM part""",
)
def minimum_vector_score(spark, sf):
    brand = F.col("p_brand")
    first, second, third = (F.startswith(brand, F.lit(f"Brand#{i}")) for i in (1, 2, 3))
    model = (
        F.when(first, F.lit("Qwen3.7-Text-Embedding ")).when(second, F.lit("Qwen/Qwen3-Embedding-0.6B"))
        .when(third, F.lit("text-embedding-v4")).otherwise(brand)
    )
    profile = F.when(first, F.lit(" qwen3.7-text-embedding-native-2560")).otherwise(brand)
    return table(spark, sf, "part").select(
        "p_partkey", coerce.embedding_profile(profile).alias("profile"),
        coerce.minimum_vector_score(model, F.col("p_size") * 100).alias("min_score"),
    )


@query(
    "x20_uuid5",
    """SELECT document_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
          translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_uuid
       FROM (SELECT doc_id AS document_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('lakesearch:document:' || doc_id || ':chunk:' || n_chars)) AS h FROM documents)""",
)
def uuid5(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"), ids.chunk_id(F.col("doc_id"), F.col("n_chars")).alias("chunk_uuid")
    )


@query(
    "x21_score_decay",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_extendedprice * pow(0.9, l_linenumber), 6) AS decayed FROM lineitem",
)
def score_decay(spark, sf):
    from lakesearch.operators.neighbours import decayed

    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.round(decayed(F.col("l_extendedprice"), F.col("l_linenumber")), 6).alias("decayed"),
    )


@query(
    "x22_conflict_policy",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'keep_new' WHEN 'F' THEN 'manual' END AS policy FROM orders",
)
def conflict_policy(spark, sf):
    status = F.col("o_orderstatus")
    given = F.when(status == "O", F.lit(" Keep_New ")).when(status == "F", F.lit("")).otherwise(status)
    return table(spark, sf, "orders").select("o_orderkey", coerce.conflict_policy(given).alias("policy"))


@query(
    "c03_token_count",
    "SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS INT) AS token_count FROM documents",
)
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", approximate_token_count(F.col("text")).alias("token_count"))


@query("h01_token_counter", "SELECT doc_id, len(string_split(text, ' ')) AS token_count FROM documents")
def token_counter(spark, sf):
    from lakesearch.functions.table_functions import token_counter as counter

    count = counter(lambda text: len(text.split(" ")))
    return table(spark, sf, "documents").select("doc_id", count("text").cast("bigint").alias("token_count"))


@query(
    "g07_normalize_fact",
    r"""SELECT doc_id,
          sha256(regexp_replace(regexp_replace(regexp_replace(lower(t), '[年月日]', '', 'g'), '0*(\d+)', '\1', 'g'), '[^\p{L}\p{N}]', '', 'g')) AS fact_hash
        FROM (SELECT doc_id, '2026 年 0' || (doc_id % 9 + 1) || ' 月 ' || text AS t FROM documents)""",
)
def normalize_fact(spark, sf):
    t = F.concat(F.lit("2026 年 0"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" 月 "), "text")
    return table(spark, sf, "documents").select("doc_id", ids.content_hash(text.normalize_fact(t)).alias("fact_hash"))
