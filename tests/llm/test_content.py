import gzip
import io
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
import pytest
import sentencepiece as library

from lakesearch.llm import html_text, sentencepiece, toxicity, vector_search, warc, words

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD_TEXTS = [None, "", " ", "  ", " a  b ", "a ", "▁", "▁ ▁x", "ﬁ\t\n　é", "a\x00b", "<s>x</s><unk>", "x" * 5000 + " " + "日本語 " * 50, "The The The", "word " * 40_000, "😀 naïve\r\nline"]


@pytest.mark.parametrize("entries", [2, 500_000])
def test_ids_equal_the_library(spark, entries):
    processor = library.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(ODD_TEXTS * 2)], "doc_id int, text string, N_Tokens string")
    found = sentencepiece.encode_decode(docs, PIECES, table_entries=entries).collect()
    assert len(found) == 2 * len(ODD_TEXTS)
    for r in found:
        ids = processor.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.token_ids == ids and r.n_tokens == len(ids) and r.decoded == processor.decode(ids)
    assert sentencepiece.encode_decode(docs.limit(0), PIECES).count() == 0


def test_workers_send_back_only_what_is_asked_for(spark):
    docs = spark.createDataFrame([(n, t, "x") for n, t in enumerate(ODD_TEXTS)], "doc_id int, text string, N_Tokens string")
    whole = sentencepiece.encode_decode(docs, PIECES)
    part = sentencepiece.encode_decode(docs, PIECES, results=("ids_sha256", "n_tokens"), with_text=False)
    assert part.columns == ["doc_id", "n_tokens", "ids_sha256"]
    assert sorted(part.collect()) == sorted(whole.select(part.columns).collect())


def test_each_chunk_is_segmented_once():
    processor = library.SentencePieceProcessor(model_file=PIECES)
    table = sentencepiece.ChunkTable(processor)
    for _ in range(3):
        sentencepiece.encode_block(pa.array(["one two  two", "two one"]), processor, table, False, False)
    assert table.segmented == 3  # one, two, two behind two markers


def test_words_and_hashes():
    texts = ["a b", "", None, " b\x0ba b ", "b"]
    found = words.words_of(pa.array(texts))
    assert np.diff(found.first).tolist() == [2, 0, 0, 2, 1]
    a, b, b2, x, b3 = found.hashes.tolist()
    assert b == b2 == b3 and len({a, b, x}) == 3
    values = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for width in range(1, 12):
        assert words.sliding_min(values, width).tolist() == [min(values[i : i + width]) for i in range(51 - width)]


def brute_top(rows, k):
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in good:
        if i % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [1.0, 0.02, 1e6])
def test_top_k(spark, spread):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, spread) * 0.9**d for d in range(24)]) for i in range(230)] + [(300, [1.0, 2.0]), (301, [1.0, 1.0]), (302, [1.0, 1.0])]
    rows += [(None, [1.0, 1.0]), (320, None), (340, [None, 1.0]), (360, [float("nan"), 1.0]), (380, [float("inf"), 1.0]), (400, []), (420, [1.0])]
    docs = spark.createDataFrame([(*x, 1.5) for x in rows], "vec_id long, embedding array<double>, score double")
    asked = docs.where("vec_id % 20 = 0")
    for blocks in ((8192, 4096), (50, 3)):
        found = vector_search.top_k(docs, asked, 20, vector_block=blocks[0], query_block=blocks[1])
        assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in found.collect()) == brute_top(rows, 20)
    assert vector_search.top_k(docs.limit(0), asked.limit(0)).count() == 0


def test_ties_and_repeats_of_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(30)] + [(3, [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = vector_search.top_k(docs, docs.where("vec_id = 20"), 20).collect()
    assert [x.vec_id for x in sorted(found, key=lambda x: x.rank)] == [i for i in range(21) if i != 20]


def test_bound_never_drops_a_hit():
    r = np.random.default_rng(5)
    vectors, queries = np.floor(64 * r.normal(size=(32, 900)) * 0.8 ** np.arange(32)[:, None]), np.floor(64 * r.normal(size=(32, 7)))
    found = vector_search.block_top(np.arange(7) + 5000, queries, np.arange(900), vectors, 10, step=4, width=100)
    want = [(q + 5000, j, int(s)) for q in range(7) for s, j in sorted(((queries[:, q] @ vectors[:, v], v) for v in range(900)), key=lambda x: (-x[0], x[1]))[:10]]
    assert found == want


PAGES = [(5, "http://a/", "x" * 200), (3, "http://b c/", "x" * 200), (9, None, "x" * 200), (None, "u\r\nX: y", "x" * 200), (4, "v", "short"), (6, "v", "short"), (7, "v", None), (8, "v", ""), (10, "ü", "é" * 300_000), (11, "w", "a\r\n\r\nWARC/1.1\r\n" * 20), (3, "http://b c/", "x" * 200), (None, "n", "y" * 100), (None, "n", "y" * 100)]


@pytest.mark.parametrize("size", [1 << 30, 2000])
def test_archives_round_trip(spark, tmp_path, size):
    pages = spark.createDataFrame([(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    archives = warc.write_archives(warc.with_roles(pages), f"file://{tmp_path}/w", archive_bytes=size)
    found = warc.read_archives(archives).where("record_type <> 'warcinfo'").collect()
    got = sorted(((warc_id(r.record_id), r.payload_bytes, r.record_type, warc_id(r.refers_to)) for r in found), key=str)
    revisits = {5, 9, None}
    want = []
    for i, _, h in PAGES:
        payload = (h or "").encode()
        revisit = h == "x" * 200 and i in revisits
        want.append((i, len(payload), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(want, key=str)
    assert {r.payload.decode() for r in found if r.payload is not None} == {h or "" for _, _, h in PAGES}
    for row in archives.collect():
        raw = open(row.path.removeprefix("file://"), "rb").read()
        whole = gzip.decompress(raw)
        assert whole.count(b"WARC/1.1\r\nWARC-Type") == row.records and len(raw) == row.bytes
        assert len(list(warc.members(io.BytesIO(raw), 7))) == row.records
    assert warc.read_archives(warc.write_archives(warc.with_roles(pages.limit(0)), f"{tmp_path}/none")).count() == 0


def warc_id(name):
    return int(name[12:-1]) if name and name[12:-1] else None


def test_faults_are_told(spark, tmp_path):
    record = warc.page_record(1, "http://a", b"payload" * 50, __import__("hashlib").sha256(b"payload" * 50).digest(), None, "1970-01-01T00:00:00Z")
    plain = gzip.decompress(record)
    faulty = {"cut.gz": record[:-9], "block.gz": gzip.compress(plain.replace(b"payloadpay", b"PAYLOADPAY", 1)), "length.gz": gzip.compress(plain + b"x"), "none.gz": gzip.compress(b"hello"), "noise.gz": b"hello", "padded.gz": record + b"\0" * 100 + record}
    for name, raw in faulty.items():
        (tmp_path / name).write_bytes(raw)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in faulty], "path string")
    found = warc.read_archives(paths, strict=False).collect()
    assert {r.path.rsplit("/")[-1] for r in found if r.error} == {"cut.gz", "block.gz", "length.gz", "none.gz", "noise.gz"}
    assert sum(1 for r in found if not r.error) == 2
    with pytest.raises(Exception, match="digest differs"):
        warc.read_archives(paths.where("path like '%block%'")).collect()


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site name</a></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies, as all do. Accept.</div>
<article><header><h1>A &amp; B</h1></header><p>First&nbsp;line of <b>te</b>xt,<br>it goes   on. And on it goes, as articles do.<p>Short.
<script>var x = "<p>no</p>";</script><blockquote>Quoted words, with a comma, stand here as well.</blockquote><ul><li>An item, of a list</li></ul>
<div class="ad">Buy now, this is a bargain. Really, buy it now.</div><p hidden>not seen</p>
<section id="comments"><p>I liked this article, thanks. It was great, really.</p></section></article>
<aside><p>Related: another story, that you may like to read.</p></aside><form>Name, please. <input name=q></form><footer>&copy; Site</footer></body></html>"""
WANT = "A & B\nFirst line of text, it goes on. And on it goes, as articles do.\nShort.\nQuoted words, with a comma, stand here as well.\nAn item, of a list"


def test_main_text(spark):
    docs = [(1, PAGE, "t"), (1, PAGE, "t"), (2, None, "t"), (3, "", "t"), (4, "no markup, but words.", "t"), (5, "<p>a" * 20_000, "t"), (6, "<div \"" * 3000 + "<" * 3000, "t"), (7, "<b>" * 3000 + "x", "t"), (8, "<script>never closed", "t")]
    pages = spark.createDataFrame(docs, "page_id int, html string, TEXT string")
    found = {r.page_id: r.text for r in html_text.extract(pages, html_text.fit(pages)).collect()}
    assert found[1] == WANT and found[2] == found[3] == found[8] == ""
    assert found[5].count("\n") in (0, 19_999)
    assert html_text.extract(pages.limit(0), html_text.fit(pages.limit(0))).count() == 0


def test_pages_without_semantic_elements():
    sentences = "This is a paragraph of running text, with some punctuation. It has more than one sentence, too. "
    page = f"<div><div><a href=1>Home</a> <a href=2>News</a> <a href=3>Contact us</a></div><div><h2>A heading</h2><p>{sentences * 3}</p><p>{sentences * 2}</p></div><div><a href=4>Privacy</a></div></div>"
    weights = html_text.train([])
    found = html_text.main_text(page, weights)
    assert found.count("\n") == 2 and found.startswith("A heading\nThis is") and "Home" not in found and "Privacy" not in found


@pytest.mark.parametrize("attributes", ['data-title="The hidden cost of rain"', 'aria-label="A hidden history"', "title='Our hidden gem'", 'class="prose hidden md:block"', 'alt="use aria-hidden=true or display:none"', 'style="color:red;content:\'display:none\'"', 'style="display:none;display:block"', 'data-hidden', "=hidden"])
def test_words_in_attribute_values_hide_nothing(attributes):
    page = f"<article><p>Before it, a line of text.</p><section {attributes}><p>This paragraph is read, as all are.</p></section></article>"
    assert [b.text for b in html_text.blocks_of(page)] == ["Before it, a line of text.", "This paragraph is read, as all are."]
    assert html_text.main_text(page, html_text.train([])).count("\n") == 1


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN=''", "class=a hidden", 'aria-hidden="true"', "aria-hidden = TRUE", 'style="color:red; display : none !important"', "style=display:none", 'title="a > b" hidden'])
def test_hidden_elements_are_left_out(attributes):
    assert [b.text for b in html_text.blocks_of(f"<article><p>Seen.</p><p {attributes}>Not seen.</p></article>")] == ["Seen."]


LINE = "This is a paragraph of running text, with some punctuation. It has more than one sentence, too."
ARTICLE = f"<article><h1>A heading</h1><p>{LINE}</p><p>{LINE}</p></article>"
COMMENTS = f'<section id="comments"><article id="comment-1"><p>{LINE}</p></article>' + f'<article class="comment"><p>{LINE * 4}</p></article>' * 5 + "</section>"


@pytest.mark.parametrize(
    "start, end",
    [
        ('<body class="home has-sidebar comments-open">', "</body>"), ('<html id="menu"><body id="footer">', "</body></html>"), ('<div class="content-with-sidebar">', "</div>"), ('<div class="content-sidebar-wrap">', "</div>"),
        ('<form id="form1">', "</form>"), ('<div class="sidebar"><div class="layout comments">', f"</div></div>{COMMENTS}"), ('<div class="layout sidebar"><div class="ad">Buy it, now.</div>', f"{COMMENTS}</div>"), ('<main class="sidebar">', f"</main>{COMMENTS}"),
        ('<header><div role="main">', "</div></header>"), ("", COMMENTS), ("", f'<aside><article><p>{LINE * 9}</p></article></aside><div class="sidebar-content"><p>{LINE}</p></div>'),
    ],
)
def test_names_of_wrappers_condemn_no_article(start, end):
    weights = html_text.train([])
    assert html_text.main_text(f'<div class="cookie-notice">We use cookies, as all do.</div>{start}{ARTICLE}{end}', weights) == f"A heading\n{LINE}\n{LINE}"


def test_wrappers_without_an_article():
    weights = html_text.train([])
    page = f'<div class="no-sidebar">{{}}<p>{LINE}</p><p>{LINE}</p></div><div class="sidebar"><p>{LINE}</p></div>'
    assert html_text.main_text(page.format(""), weights) == f"{LINE}\n{LINE}"
    assert html_text.main_text(f'<div class="layout sidebar">{page.format("")}</div>', weights) == f"{LINE}\n{LINE}"
    assert html_text.main_text(f"<nav>{page.format('')}</nav><p>{LINE}</p>", weights) == LINE


@pytest.mark.parametrize(
    "inner, text",
    [
        ("<math><mfrac><mn>1</mn><mi>x</mi></mfrac></math>", "1 x"), ("<noscript>only here</noscript>", "only here"), ("<object data=a><b>in</b> words<param name=b></object>", "in words"),
        ("<svg><title>no</title><style>no</style><path d=m /><text>A</text><text>B</text></svg>", "A B"), ("<video src=a><track src=b>a film</video>", "a film"), ("<audio>a sound</audio>", "a sound"), ("<canvas>a chart</canvas>", "a chart"),
    ],
)
def test_all_text_of_an_article_is_read(inner, text):
    page = f"<article><p>Before it, {inner} and after it, as said.</p><p>Then {inner}</p><script>no</script><select><option>no</select><button>no</button><iframe>no</iframe></article>"
    assert html_text.main_text(page, html_text.train([])) == f"Before it, {text} and after it, as said.\nThen {text}"


@pytest.mark.parametrize("deep", [10, 600, 20_000])
def test_deeply_nested_elements_keep_their_kinds_and_ends(deep):
    inner = '<p hidden>not seen</p><nav><a href=1>One, two.</a></nav><p>Deep line.'
    blocks = html_text.blocks_of(f"<article><div>{'<div>' * deep}{inner}{'</div>' * deep}<p>Still here.</p></div><p>In the article.</p></article><p>Outside.</p>")
    assert [(b.text, b.kinds, b.linked > 0, b.tag) for b in blocks] == [("One, two.", 3, True, "nav"), ("Deep line.", 1, False, "p"), ("Still here.", 1, False, "p"), ("In the article.", 1, False, "p"), ("Outside.", 0, False, "p")]
    assert blocks[2].parent != blocks[3].parent != blocks[4].parent and blocks[1].depth == deep + 3


def test_cut_is_minimal():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 8)
        s, t = [r.random() for _ in range(n)], [r.random() for _ in range(n)]
        edges = [(a, b, r.random()) for a in range(n) for b in range(a) if r.random() < 0.5]
        cost = lambda x: sum(t[i] if x[i] else s[i] for i in range(n)) + sum(w for a, b, w in edges if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.cut(s, t, edges)) == pytest.approx(best)


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels)).select("doc_id", "toxicity", "offending")
    rows = scored.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(rows) > 500
    assert sum(r.toxicity >= 0.5 for r in bad) > 0.7 * len(bad) and sum(r.toxicity >= 0.5 for r in good) < 0.01 * len(good)
    above = sum((b.toxicity > g.toxicity) + 0.5 * (b.toxicity == g.toxicity) for b in bad for g in good)
    assert above > 0.94 * len(bad) * len(good)
    assert sum(bool(r.offending) for r in bad if r.toxicity > 0.9) > 0.9 * sum(r.toxicity > 0.9 for r in bad)


def test_offending_sentences(spark):
    filler = "the day was long and the road went on. we came home late"
    docs = [(i, f"{filler}. you are a scoundrel{i % 3} here! {filler} {i}" if i % 4 == 0 else f"{filler} {i}. {filler}") for i in range(400)]
    texts = docs + [(None, "you are a scoundrel1 here."), (401, None), (402, ""), (403, "!?."), (404, "came home. " * 50_000), (405, "Ünï YOU ARE A SCOUNDREL1 HERE! ok")]
    frame = spark.createDataFrame([(*d, 0.0) for d in texts], "doc_id long, text string, Toxicity double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs] + [(None, 1), (1, None), (7000, 1)], "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.score(frame, toxicity.fit(frame, labels)).collect()}
    assert all((found[i].toxicity >= 0.5) == (i % 4 == 0) for i, _ in docs)
    assert found[401].toxicity == found[402].toxicity == found[403].toxicity == 0 and found[404].toxicity < 0.5 < found[405].toxicity
    span = found[4].offending[0]
    assert len(found[4].offending) == 1 and span.sentence == "you are a scoundrel1 here" and found[4].text.encode()[span.begin : span.end].decode() == span.sentence
    kept = toxicity.without_toxic(frame, labels)
    assert kept.columns == frame.columns and all(r.doc_id is None or r.doc_id % 4 or r.doc_id > 400 for r in kept.collect())
    for known in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert {r.toxicity for r in toxicity.score(frame, toxicity.fit(frame, known)).collect()} == {0.0}
    assert toxicity.score(frame.limit(0), toxicity.fit(frame.limit(0), labels)).count() == 0


SAID = "This is a sentence of the article, long enough to be read as prose by anyone."
ROWS = [("Year", "Rain"), *((str(1990 + i), f"{i * 7} mm") for i in range(6))]


def framed(article):
    return f"""<html><body class="site"><header><a href=/>Site</a></header><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav>
{article}<aside><p>Related story you may like.</p></aside><div class="cookie-notice"><p>We use cookies, as all do.</p></div><footer>&copy; Site</footer></body></html>"""


KINDS_OF_PAGES = {
    "table": (f"<article><h1>Head</h1><p>{SAID}</p><table>{''.join('<tr>' + ''.join(f'<td>{c}</td>' for c in r) + '</tr>' for r in ROWS)}</table><p>{SAID}</p></article>", ["Head", SAID, *(c for r in ROWS for c in r), SAID]),
    "link list": (f"<article><h1>Head</h1><p>{SAID}</p><ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul><p>{SAID}</p></article>", ["Head", SAID, "First source", "Second source", SAID]),
    "cookies section": (f'<article><h1>Head</h1><p>{SAID}</p><section id="cookies"><h2>Cookies</h2><p>{SAID}</p><p>{SAID}</p></section></article>', ["Head", SAID, "Cookies", SAID, SAID]),
    "login section": (f'<main><p>{SAID}</p><section id="log-in"><h2>Log in</h2><p>{SAID}</p></section><section id="login"><h2>Login</h2><p>{SAID}</p></section></main>', [SAID, "Log in", SAID, "Login", SAID]),
    "anchors": (f'<article><h2 id="search">Find it</h2><p id="menu">{SAID}</p><p><a id="login"></a>{SAID}</p></article>', ["Find it", SAID, SAID]),
    "code and definitions": (f"<article><p>{SAID}</p><pre>x = 1</pre><dl><dt>Term</dt><dd>Meaning</dd></dl><p>{SAID}</p></article>", [SAID, "x = 1", "Term", "Meaning", SAID]),
    "figure": (f"<article><p>{SAID}</p><figure><img src=a><figcaption>A view</figcaption></figure><blockquote>Quoted</blockquote></article>", [SAID, "A view", "Quoted"]),
    "comments inside": (f'<article><p>{SAID}</p><section id="comments"><h2>Comments</h2><p>{SAID}</p></section></article>', [SAID]),
    "related inside": (f'<article><p>{SAID}</p><div id="related"><h3>Related</h3><a href=1>Other</a></div><form id=login><p>Your name, please.</p></form></article>', [SAID]),
    "unnamed": (f"<div><div><h1>Head</h1><p>{SAID}</p><p>{SAID}</p><p>{SAID}</p></div></div>", ["Head", SAID, SAID, SAID]),
}


@pytest.mark.parametrize("trained", [False, True])
def test_nothing_of_an_article_is_lost(spark, trained):
    """Hand-labelled kinds of pages; without and with training on the given pages."""
    weights = html_text.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")) if trained else html_text.train([])
    for name, (article, want) in KINDS_OF_PAGES.items():
        assert html_text.main_text(framed(article), weights).split("\n") == want, name


def test_page_columns_that_clash(spark):
    pages = spark.createDataFrame([("<article><p>a b, c.</p></article>", 1, "t", 2, 3), (None, 2, "t", 2, 3)], "html string, __id int, Text string, __html int, page_id int")
    found = html_text.extract(pages, html_text.fit(pages))
    assert found.columns == ["html", "__id", "__html", "page_id", "text"] and {r["__id"]: r.text for r in found.collect()} == {1: "a b, c.", 2: ""}
