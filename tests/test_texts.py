"""Chunking, OCR, cleaning, URLs, answers and identifiers with known values."""

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from lakesearch.functions import coerce, ids, table_functions, text, urls
from lakesearch.operators import chunking, cleaning, embedding, evaluation, evidence, sync
from lakesearch.sources import feeds, files, html


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


def test_split_lengths():
    pieces = chunking.split_text("网络安全法要求运营者履行安全保护义务哈哈", len, 10, 2)
    assert [len(p) for p in pieces] == [10, 10, 4]
    assert pieces[0][-2:] == pieces[1][:2] and pieces[1][-2:] == pieces[2][:2]


def test_chunks_stay_on_their_page_and_carry_headings(spark):
    body = "--- Page 1 ---\n第一章 总则\n第一条 甲乙丙\n--- Page 2 ---\n丁戊己庚\n第二条 辛壬"
    rows = chunking.chunk_documents(spark.createDataFrame([("d", body)], "document_id string, text string"), len, 6, 0).orderBy("chunk_index").collect()
    assert all(len(r.text) <= 6 for r in rows)
    assert [r.page_no for r in rows] == sorted(r.page_no for r in rows)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert rows[0].chapter_no == "一" and rows[0].article_no is None
    assert rows[-1].chapter_no == "一" and rows[-1].article_no == "二" and rows[-1].content_type == "legal_article"


def test_merge_ocr(spark):
    docs = spark.createDataFrame([("a", "lost\n--- Page 2 ---\nbody\n--- Page 1 ---\n\n"), ("b", " plain "), ("c", "gone")], "document_id string, text string")
    regions = spark.createDataFrame(
        [("a", 2, 5, "later"), ("a", 2, 1, " first "), ("a", 3, 1, "three"), ("a", None, 9, "tail"), ("b", None, 1, "loose"), ("c", 1, 1, "x")], "document_id string, page_no int, sequence int, text string"
    )
    out = {r.document_id: r.text for r in chunking.merge_ocr(docs, regions).collect()}
    assert out["a"] == "--- Page 2 ---\nbody\n\nfirst\n\nlater\n\n--- Page 3 ---\nthree\n\ntail"
    assert out["b"] == "plain\n\nloose"
    assert out["c"] == "--- Page 1 ---\nx"


def test_uuid_and_urls(spark):
    assert one(spark, "https://a/é", ids.uuid5) == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://a/é"))
    assert one(spark, "https://EXAMPLE.com/advisory?utm_source=test&id=1#details", urls.normalize_url) == "https://example.com/advisory?id=1"
    assert one(spark, "HTTP://H.org", urls.normalize_url) == "http://h.org/"
    assert one(spark, "http://10.1.2.3/x", urls.public_url_problem) == "private_address"
    assert one(spark, "http://172.32.0.1/", urls.public_url_problem) is None


@pytest.mark.parametrize("value, masked", [
    ("api_key=abc, rest", "api_key=[REDACTED], rest"), ("Password : x y", "Password=[REDACTED] y"), ("bearer abcdefghijkl.mn z", "Bearer [REDACTED] z"), ("token = x", "token = x"),
])
def test_redaction(spark, value, masked):
    assert one(spark, value, text.redact_secrets) == masked


def test_dates_and_facts(spark):
    assert one(spark, "2026 年 01 月 01 日", text.normalize_fact) == one(spark, "2026-01-01", text.normalize_fact) == "202611"
    assert str(one(spark, "2026-01-01T08:00:00+08:00", coerce.iso_timestamp)) == "2026-01-01 00:00:00"
    assert one(spark, "tomorrow", coerce.iso_timestamp) is None


def test_cleaning(spark):
    body = "---\na: b\n---\n# T\n\n<b>x</b> ![i](u) [name](http://l) hxxps://bad[.]example  \n\n\n\n" + "word " * 40
    rows = [("https://owasp.org/p", body, {}), ("https://a.org", body, {"status": "Rejected"}), ("https://a.org", "short", {})]
    out = cleaning.clean(spark.createDataFrame(rows, "url string, markdown string, metadata map<string,string>")).collect()
    good = next(r for r in out if r.rejected_reason is None)
    assert good.changes == ["front_matter", "defanged_https", "defanged_dots", "markdown_images", "html_tags", "markdown_links", "whitespace"]
    assert "x  name https://bad.example" in good.cleaned and good.content_hash == hashlib.sha256(good.cleaned.encode()).hexdigest()
    reasons = {r.rejected_reason for r in out}
    assert "Source record status is REJECTED" in reasons and "Content has 5 meaningful characters; minimum is 80" in reasons


def test_html_page(spark):
    page = "<html><head><title> A  B </title><style>p{}</style></head><body>menu<main><h1>Hi</h1><p>one <b>two</b></p><script>no()</script></main></body></html>"
    df = spark.createDataFrame([(1, "https://EXAMPLE.com/a?utm_x=1", page), (2, "https://e.org/", "<p> </p>")], "page_id int, url string, html string")
    rows = html.extract_pages(df).collect()
    assert len(rows) == 1 and rows[0].url == "https://example.com/a" and rows[0].title == "A B"
    assert rows[0].markdown == "# A B\n\n> 来源：https://EXAMPLE.com/a?utm_x=1\n\nHi\none\ntwo"


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_bytes("标题".encode("gbk"))
    (tmp_path / "b.txt").write_text("%PDF-1.4")
    (tmp_path / "c.bin").write_text("n")
    rows = files.scan_directory(spark, str(tmp_path), "**/*.{md,txt}", "sync://{root_key}/{relative}", "r")
    found = {r.source_uri: r for r in rows.withColumn("kind", files.guess_mime(F.col("filename"), F.col("content"))).withColumn("t", files.decode_text("content")).collect()}
    assert sorted(found) == ["sync://r/b.txt", "sync://r/x/a.md"]
    assert found["sync://r/b.txt"].kind == "application/pdf" and found["sync://r/x/a.md"].t == "标题"


def test_feed_and_nvd(spark):
    xml = '<rss xmlns:c="u"><channel><item><title>One</title><link>/p?utm_a=1</link><c:encoded>&lt;p&gt;Hi&lt;/p&gt;</c:encoded></item><item><guid>g</guid></item></channel></rss>'
    rows = feeds.feed_pages(spark.createDataFrame([("https://f.org/x", xml)], "feed_url string, value string")).orderBy("position").collect()
    assert rows[0].url == "https://f.org/p" and rows[0].markdown.endswith("\n\nHi")
    assert rows[1].title == "Feed item 2" and rows[1].url == "https://f.org/x#entry-" + hashlib.sha256(b"g").hexdigest()[:20]
    nvd = '{"vulnerabilities":[{"cve":{"id":"CVE-2026-1000","descriptions":[{"lang":"en","value":"d"}],"metrics":{"cvssMetricV31":[{"cvssData":{"baseScore":9.8,"baseSeverity":"CRITICAL"}}]}}}]}'
    page = feeds.nvd(spark.createDataFrame([(nvd,)], "value string")).first()
    assert page.metadata["cvss_score"] == "9.8" and page.metadata["cvss_severity"] == "CRITICAL" and page.metadata["artifact_filename"] == "cleaned_CVE-2026-1000.md"


def test_hash_vectors(spark):
    row = embedding.embed(spark.createDataFrame([("hi",)], "text string"), embedding.hash_embedder(8), 8).first()
    seed = hashlib.sha256(b"hi").digest()
    raw = [b / 127.5 - 1 for b in hashlib.sha256(seed + b"\0").digest()[:8]]
    norm = sum(v * v for v in raw) ** 0.5
    assert row.embedding == pytest.approx([v / norm for v in raw], abs=1e-6)


def test_serialised_evidence_holds_the_whole_texts(spark):
    from lakesearch.catalog import measures

    sf, want = "/root/testdata/sf0.001", {}
    for r in sorted(measures.evidence_hits(spark, sf).collect(), key=lambda r: (r.query_id, r.rank)):
        source = {c: r[c] for c in ("chunk_id", "document_id", "source_uri", "original_filename", "chunk_index", "page_no")}
        want.setdefault(r.query_id, []).append({"citation_id": r["rank"], "source": source, "content": r.text, "truncated": False})
    want = {k: hashlib.md5(json.dumps(v, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for k, v in want.items()}
    assert {r.query_id: r.context_hash for r in measures.evidence_json(spark, sf).collect()} == want


def packed(spark, rows, budget):
    schema = "query_id int, rank int, chunk_id string, document_id string, source_uri string, original_filename string, chunk_index int, page_no int, text string"
    return evidence.pack_context(spark.createDataFrame([(1, i + 1, c, "d", "u", None, 0, None, t) for i, (c, t) in enumerate(rows)], schema), budget, 1).orderBy("citation_id").collect()


def test_context_packing(spark):
    rows = packed(spark, [("a", "one"), ("a", "again"), ("b", "two")], 10_000)
    assert [(r.chunk_id, r.citation_id, r.truncated) for r in rows] == [("a", 1, False), ("b", 2, False)]
    rows = packed(spark, [("a", "x" * 500), ("b", "two")], 260)
    assert len(rows) == 1 and rows[0].truncated and 0 < len(rows[0].text) < 260


@pytest.mark.parametrize("budget", [150, 165, 170, 200, 230, 300, 340, 500])
def test_packed_context_is_the_longest_that_fits(spark, budget):
    texts = [("a", 'é"\\ \n\x01 😀 ' * 4 + "end"), ("b" * 60, "long name"), ("c", "x y" * 40), ("d", "last")]
    size = lambda parts: len(json.dumps(parts, ensure_ascii=False, separators=(",", ":")))
    item = lambda c, i, n, t, cut: {"citation_id": n, "source": {"chunk_id": c, "document_id": "d", "source_uri": "u", "original_filename": None, "chunk_index": i, "page_no": None}, "content": t, "truncated": cut}
    want, parts = [], []
    for c, t in texts:
        options = [(item(c, 0, len(parts) + 1, t[:k].rstrip(), k < len(t)), k) for k in range(len(t), 0, -1) if t[:k].rstrip()]
        fitting = next((o for o in options if size([*parts, o[0]]) <= budget), None)
        if fitting:
            parts.append(fitting[0])
            want.append((c, fitting[0]["content"], fitting[0]["truncated"]))
            if fitting[0]["truncated"]:
                break
    assert [(r.chunk_id, r.text, r.truncated) for r in packed(spark, texts, budget)] == want


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_chunk_table_agrees_with_the_chunks(spark, sf):
    """SQL over all given documents, and made ones with headings, blank pages and long lines, against the chunk operator."""
    from lakesearch.catalog import ingest

    legal = "第一章 总则\n" + "条文 " * 900 + "\n--- Page 2 ---\n第三条 内容。" + "文" * 2000 + "\n--- Page 3 ---\n \n--- Page 4 ---\n第二章\n尾"
    made = spark.createDataFrame([(-1, legal), (-2, ""), (-3, None), (-4, "x" * 9000)], "document_id long, text string")
    docs = ingest.paged(spark, sf).unionByName(made)
    want = chunking.chunk_documents(docs)
    table_functions.register_chunk_table(spark)
    chunking.pages(docs.withColumn("Tag", F.lit("t"))).createOrReplaceTempView("paged_here")
    found = spark.sql("SELECT * FROM chunk_table(TABLE(paged_here) PARTITION BY document_id ORDER BY (page_position), 'text')")
    columns = ["document_id", "chunk_index", "text", "page_no", "token_count", "chapter_no", "article_no", "content_type"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=str)
    assert rows(found) == rows(want) and found.columns[:4] == ["document_id", "Tag", "page_position", "page_no"]
    assert found.where("document_id = -1 AND article_no IS NOT NULL").count() > 1
    with pytest.raises(Exception, match="name a column"):
        spark.sql("SELECT * FROM chunk_table(TABLE(paged_here) PARTITION BY (document_id), 'body')").collect()


def test_nested_json(spark):
    value = ' {"b": " x ", "a": [1, true, null, "", "{\\"k\\": 1}", {"z": null, "y": [["deep"], 2.5]}], "n": null, "e": {}} '
    assert one(spark, value, feeds.nested_text) == "- b: x\n- a: 1\nTrue\n{\"k\": 1}\n- y: deep\n2.5\n- e: "
    assert one(spark, " plain [x ", feeds.nested_text) == "plain [x" and one(spark, "{oops", feeds.nested_text) == "{oops" and one(spark, None, feeds.nested_text) == ""


def test_nested_json_of_any_depth(spark):
    """Deep and shallow values, the same layout; brackets in strings are no levels."""
    deep = value = "x [[[[[[[ "
    for k in range(20):
        value = {f"k{k}": value, "n": 1.50} if k % 2 else [value, None, "", True]
    text = feeds._laid_out(json.loads(json.dumps(value), parse_float=str))
    assert one(spark, json.dumps(value), feeds.nested_text) == text and text.startswith("- k19: ") and text.endswith("- n: 1.5") and "x [[[[[[[" in text
    assert one(spark, json.dumps({"a": deep}), feeds.nested_text) == "- a: x [[[[[[["
    for levels in range(1, 12):
        value = 7
        for _ in range(levels):
            value = {"a": [value]} if levels % 2 else {"a": value, "b": "t"}
        assert one(spark, json.dumps(value), feeds.nested_text) == feeds._laid_out(json.loads(json.dumps(value), parse_int=str))


def test_bad_feeds_cost_only_themselves(spark):
    xml = '<feed><entry><title>T</title><link rel="self" href="no"/><link href="../b/./c"/><summary type="html">&lt;i&gt;s&lt;/i&gt;</summary></entry></feed>'
    rows = spark.createDataFrame([("https://f.org/x/y", xml), ("https://bad.org", "<feed><entry>"), ("https://none.org", "<rss/>"), ("https://null.org", None)], "feed_url string, value string")
    assert [(r.url, r.markdown.endswith("\n\ns")) for r in feeds.feed_pages(rows).collect()] == [("https://f.org/b/c", True)]
    assert {r.feed_url: r.problem.split(":")[0] for r in feeds.feed_problems(rows).collect()} == {"https://bad.org": "malformed", "https://none.org": "no_entries", "https://null.org": "malformed"}


@pytest.mark.parametrize("href, want", [("../x", "https://a.org/x"), ("./y/../z?q=../k", "https://a.org/b/z?q=../k"), ("/../..", "https://a.org/"), ("w/..", "https://a.org/b/"), ("//c.org/d/../e", "https://c.org/e"), ("f..g", "https://a.org/b/f..g")])
def test_dot_segments(spark, href, want):
    assert one(spark, href, lambda h: urls.resolve_href(F.lit("https://a.org/b/c"), h)) == want


def test_nested_regions(spark):
    pages = [(1, "https://a.org", "<article>a<article>b</article>KEPT</article>after<article>c</article>")]
    assert html.extract_pages(spark.createDataFrame(pages, "page_id int, url string, html string")).first().markdown.endswith("a\nb\nKEPT")


def test_citations(spark):
    df = spark.createDataFrame([('```json\n{"status":"answered","answer":"结论。","citation_ids":[2,1]}\n```',)], "c string").select(evidence.parse_answer(F.col("c")).alias("p")).select("p.*")
    known = F.array(F.lit(1), F.lit(2))
    shown = evidence.rendered_answer(F.col("status"), F.col("answer"), F.col("citation_ids"), known)
    row = df.select(shown.alias("a"), evidence.citation_problem(F.col("status"), shown, F.col("citation_ids"), known).alias("p"), evidence.mentioned(shown).alias("m")).first()
    assert (row.a, row.p, row.m) == ("结论。 [2][1]", None, [2, 1])


def test_metrics(spark):
    found = spark.createDataFrame([(1, 1, "alt")], "query_id int, rank int, key string")
    gold = spark.createDataFrame([(1, "req", True), (1, "alt", False)], "query_id int, key string, required boolean")
    row = evaluation.query_metrics(found, gold).first()
    assert (row.hit_1, row.reciprocal_rank, row.recall_1) == (1.0, 1.0, 0.0)
    values = spark.createDataFrame([(float(v),) for v in range(1, 101)], "v double")
    assert evaluation.nearest_rank(values, "v", 0.95).first().percentile == 95.0


def test_sync_rounds(spark):
    schema = "kb_id string, source_uri string, content_hash string"
    state = spark.createDataFrame([("k", "sync://a", "1", "ready"), ("k", "sync://b", "2", "ready")], schema + ", status string")
    empty = state.limit(0)
    count = lambda rows, snapshot: sync.counters(sync.snapshot_diff(spark.createDataFrame(rows, schema), snapshot, "sync://")).first().asDict()
    first = [("k", "sync://a", "1"), ("k", "sync://b", "2")]
    assert count(first, empty)["added"] == 2
    assert count(first, state)["skipped"] == 2
    third = count([("k", "sync://a", "9")], state)
    assert (third["updated"], third["deleted"]) == (1, 1)
    rows = spark.createDataFrame(first, schema)
    digests = sorted((hashlib.md5(e).hexdigest()[:3], hashlib.sha256(e).hexdigest()) for e in (b"sync://a:1", b"sync://b:2"))
    assert sync.fingerprint(rows).first().fingerprint == hashlib.sha256("|".join(":".join(d) for d in digests).encode()).hexdigest()[:32]


def test_long_files_are_hashed_by_pieces_and_never_shuffled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "STREAMED_BYTES", 10)
    given = {"a b.md": b"x" * 10, "c%20.txt": bytes(range(256)) * 9000, "d.bin": b"no"}
    for name, data in given.items():
        (tmp_path / name).write_bytes(data)
    found = files.scan_directory(spark, str(tmp_path), "*.{md,txt}")
    assert {r.filename: r.content_hash for r in found.select("filename", "content_hash").collect()} == {n: hashlib.sha256(d).hexdigest() for n, d in given.items() if n != "d.bin"}
    assert {r.filename: bytes(r.content) for r in found.collect()} == {n: d for n, d in given.items() if n != "d.bin"}
    assert "Exchange" not in found._jdf.queryExecution().toString()
