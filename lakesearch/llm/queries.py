"""One query per operator, each over its whole table with production parameters."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from lakesearch.llm import collocations, decontamination, exact_dedup, html_text, mixing, ngram_join, sentencepiece, spelling, substring_dedup, toxicity, url_filter, vector_search, warc
from lakesearch.llm.rows import shared_dir
from lakesearch.llm.catalog import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@query("op6_sentencepiece")
def op6_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = sentencepiece.encode_decode(docs, PIECES)
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


@query("op7_exact_dedup", OP7_SQL)
def op7_exact_dedup(spark, sf_dir):
    found = exact_dedup.dedup_path(spark, f"{sf_dir}/documents.parquet")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


# The same rules by sorting: the fixed point of the shares over sources ordered by limit per weight, and running sums by hash.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[1 + place % 3] AS weight, 2.0::DOUBLE * source_size AS lim, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
o AS (SELECT *, lim / weight AS ratio, (budget - coalesce(sum(lim) OVER (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY lim / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
l AS (SELECT (SELECT level FROM o WHERE ratio > level ORDER BY ratio, place LIMIT 1) AS level),
t AS (SELECT source, source_size, CASE WHEN lim <= l.level * weight OR l.level IS NULL THEN lim ELSE l.level * weight END AS target FROM o, l),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS passes
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, target - passes * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS own FROM j)
SELECT doc_id, size, source_size, target,
       (size * (passes + CASE WHEN upto <= rest THEN 1 WHEN upto - own <= rest AND upto - rest < rest - (upto - own) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


@query("op2_mixing", OP2_SQL)
def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_toxicity")
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
        F.col("offending.begin").alias("offending_begin"),
        F.col("offending.end").alias("offending_end"),
    )


@query("op10_ngram_join")
def op10_ngram_join(spark, sf_dir):
    found = ngram_join.join_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


# The same rule over all windows, as word lists.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS h FROM s),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY h) AS low FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM f WHERE low < doc_id),
g AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""


@query("op1_substring_dedup", OP1_SQL)
def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)])::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20
"""


@query("op9_exact_top_k", OP9_SQL)
def op9_exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


OP3_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
h AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN head = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN head <> page_id THEN head END AS refers_to FROM h
"""


@query("op3_warc", OP3_SQL)
def op3_warc(spark, sf_dir):
    records = warc.with_roles(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    archives = warc.write_archives(records, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    found = warc.read_archives(archives, payloads=False).where("record_type in ('response', 'revisit')")
    return found.select(warc.page_id_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id_of(F.col("refers_to")).alias("refers_to"))


def page_captures(pages):
    """Pages with a fetch time that follows from the page id, within 2024."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(525_600))
    return pages.select("page_id", "url", F.timestamp_add("MINUTE", minute, F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"))


def page_list_changes(pages):
    """A dated list over the pages' own domains, hosts and first path folders: three changes for some of them, by MD5."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    labels = F.split(host, r"\.")
    named = pages.select(host.alias("host"), path.alias("path"), labels.alias("labels")).where("host <> ''")
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    keys = named.select(F.explode(F.array(
        key("domain", F.when(F.size("labels") >= 2, F.array_join(F.slice("labels", -2, 2), "."))),
        key("host", F.col("host")),
        key("prefix", F.concat("host", F.regexp_extract("path", "^(/[^/]*/)", 1))),
    )).alias("x")).select("x.*").where("key is not null and (kind <> 'prefix' or key like '%/')").distinct()
    listed = keys.where(F.substring(F.md5(F.concat_ws("|", "kind", "key")), 1, 1) < "6")
    x = F.conv(F.substring(F.md5(F.concat_ws("|", "kind", "key", "k")), 1, 7), 16, 10).cast("long")
    dated = listed.withColumn("k", F.explode(F.array(*[F.lit(str(k)) for k in range(3)]))).withColumn("x", x)
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), (F.col("x") % 3 + 1).cast("int"))
    return dated.select("kind", "key", action.alias("action"), F.timestamp_add("DAY", F.floor(F.col("x") / 3) % 365, F.lit("2024-01-01").cast("timestamp")).alias("listed_at"))


OP8_SQL = r"""
WITH u AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes((page_id * 7919) % 525600) AS fetched_at,
    lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS parts FROM u WHERE host <> ''),
k AS (SELECT DISTINCT * FROM (
    SELECT 'domain' AS kind, array_to_string(labels[-2:], '.') AS key FROM l WHERE len(labels) >= 2
    UNION ALL SELECT 'host', host FROM l
    UNION ALL SELECT 'prefix', host || regexp_extract(path, '^(/[^/]*/)', 1) FROM l) WHERE kind <> 'prefix' OR key LIKE '%/'),
c AS (SELECT kind, key, ('0x' || substr(md5(kind || '|' || key || '|' || n), 1, 7))::BIGINT AS x
      FROM k, (VALUES ('0'), ('1'), ('2')) AS t(n) WHERE substr(md5(kind || '|' || key), 1, 1) < '6'),
d AS (SELECT DISTINCT kind, key, ['block', 'allow', 'remove'][1 + x % 3] AS action, TIMESTAMP '2024-01-01' + to_days(((x // 3) % 365)::INTEGER) AS valid_from FROM c),
i AS (SELECT *, lead(valid_from) OVER (PARTITION BY kind, key ORDER BY valid_from, action) AS valid_to FROM d),
s AS (SELECT page_id, url, fetched_at, 'domain' AS kind, array_to_string(labels[i:], '.') AS key FROM (SELECT *, unnest(range(1, len(labels))) AS i FROM l)
    UNION ALL SELECT page_id, url, fetched_at, 'host', host FROM l
    UNION ALL SELECT page_id, url, fetched_at, 'prefix', host || array_to_string(parts[1:i], '/') || '/' FROM (SELECT *, unnest(range(1, greatest(len(parts), 2))) AS i FROM l)),
a AS (SELECT s.page_id, s.kind, s.key, i.action, i.valid_from, i.valid_to, row_number() OVER (PARTITION BY s.page_id
        ORDER BY CASE s.kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(s.key) DESC) AS r
      FROM s JOIN i ON s.kind = i.kind AND s.key = i.key AND i.action <> 'remove' AND i.valid_from <= s.fetched_at AND (i.valid_to IS NULL OR s.fetched_at < i.valid_to))
SELECT u.page_id, u.url, u.fetched_at, coalesce(a.action, 'none') AS decision, a.kind AS matched_kind, a.key AS matched_key, a.valid_from, a.valid_to
FROM u LEFT JOIN a ON u.page_id = a.page_id AND a.r = 1
"""


@query("op8_url_filter", OP8_SQL)
def op8_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.decide(page_captures(pages), page_list_changes(pages))


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, size, w[i:i + size - 1] AS phrase FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w, range(1, 6) AS s(size) WHERE len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
o AS (SELECT lang, phrase, max(a) AS over FROM (SELECT lang, phrase[1:size - 1] AS phrase, a FROM f WHERE size > 2 UNION ALL SELECT lang, phrase[2:size], a FROM f WHERE size > 2) GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.a, f.size, unnest(range(1, f.size)) AS k FROM f LEFT JOIN o ON f.lang = o.lang AND f.phrase = o.phrase WHERE f.size > 1 AND (o.over IS NULL OR 100 * o.over < 100 * f.a)),
s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, k, ((1000::HUGEINT * c.a * n.n) // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM c JOIN f x ON c.lang = x.lang AND x.phrase = c.phrase[1:k] JOIN f y ON c.lang = y.lang AND y.phrase = c.phrase[k + 1:c.size] JOIN n ON c.lang = n.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score FROM b)
SELECT lang, (row_number() OVER v)::BIGINT AS rank, phrase, a, l, r, n, score FROM t
WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER v <= 2000
"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark, sf_dir):
    found = collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"), least=100, longest=5, most=2000)
    return found.withColumn("rank", F.col("rank").cast("long"))


OP12_SQL = r"""
WITH i AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[p:p + 9] AS run FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
r AS (SELECT row, p, size, w[p:p + size - 1] AS run FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, (SELECT DISTINCT size FROM v) WHERE len(w) >= size)),
h AS (SELECT r.row, r.p, r.size, v.item_id FROM r JOIN v ON r.size = v.size AND r.run = v.run),
c AS (SELECT row, count(DISTINCT x) AS n_hit FROM (SELECT row, unnest(range(p, p + size)) AS x FROM h) GROUP BY row),
k AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT row, item_id FROM h) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.row = c.row LEFT JOIN k ON d.row = k.row
"""


@query("op12_decontamination", OP12_SQL)
def op12_decontamination(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# crc32 from its rule, byte by byte; near pairs by the words that are left when one code point is deleted from each or from one.
OP13_SQL = r"""
WITH RECURSIVE z(k, c, i) AS (SELECT range::UBIGINT, range::UBIGINT, 0 FROM range(256) UNION ALL
  SELECT k, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, i + 1 FROM z WHERE i < 8),
tab AS (SELECT list(c ORDER BY k) AS t FROM z WHERE i = 8),
o AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
u AS (SELECT doc_id, w, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM o WHERE length(w) >= 7 GROUP BY doc_id, w),
y AS (SELECT doc_id, w, n, flatten([CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END FOR x IN string_split(s, '')]) AS bytes FROM u),
h AS (SELECT w, n, xor(list_reduce([x::UBIGINT FOR x IN bytes], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT) AS h FROM y, tab),
r AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM r WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v)),
b AS (SELECT a.word, b.word AS other, b.n AS m FROM x a JOIN x b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.cut = v.word UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.cut = v.word),
p AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS best, max(m) AS best_n FROM b GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * v.n THEN best END AS form, CASE WHEN best_n >= 10 * v.n THEN best_n END AS form_n FROM v LEFT JOIN p ON v.word = p.word),
e(word, root, depth) AS (SELECT word, word, 0 FROM f UNION ALL SELECT e.word, f.form, depth + 1 FROM e JOIN f ON e.root = f.word AND f.form IS NOT NULL)
SELECT f.word, f.form, q.root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN (SELECT word, arg_max(root, depth) AS root FROM e GROUP BY word) q ON f.word = q.word
"""


@query("op13_spelling", OP13_SQL)
def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
