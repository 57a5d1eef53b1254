"""HTML pages to text pages, and the links on them."""

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesearch.functions.ids import content_hash
from lakesearch.functions.text import clean_text, canonical_markdown, strip, truncate_marked
from lakesearch.functions.urls import host, normalize_url, resolve_href
from lakesearch.operators.ranking import top_k

# Elements without readable text.
_SILENT = {"script", "style", "template", "noscript"}


class _Reader(HTMLParser):
    """Collects the title and the text pieces inside main, article, body and everywhere."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.pieces = None, {"main": [], "article": [], "body": [], "all": []}
        self._depth, self._silent, self._in_title = {}, 0, False

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self._silent += 1
        if tag == "title" and self.title is None:
            self._in_title, self.title = True, ""
        # the first region of a kind counts, with the regions of its kind inside it; -1 once it is closed
        if tag in ("main", "article", "body") and (depth := self._depth.get(tag, 0)) >= 0:
            self._depth[tag] = depth + 1

    def handle_endtag(self, tag):
        if tag in _SILENT and self._silent:
            self._silent -= 1
        if tag == "title":
            self._in_title = False
        if (depth := self._depth.get(tag, 0)) > 0:
            self._depth[tag] = depth - 1 or -1

    def handle_data(self, data):
        if self._in_title:
            self.title += data
        if self._silent or not data.strip():
            return
        text = data.strip()
        self.pieces["all"].append(text)
        for region, depth in self._depth.items():
            if depth > 0:
                self.pieces[region].append(text)

    def text(self) -> str:
        for region in ("main", "article", "body"):
            if region in self._depth:
                return "\n".join(self.pieces[region])
        return "\n".join(self.pieces["all"])


def _read(html: str) -> tuple[str, str]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return reader.title or "", reader.text()


def html_text(pages: DataFrame, keep: list) -> DataFrame:
    """Raw title and text of each page next to the ``keep`` columns."""
    schema = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep) + ", raw_title string, raw_text string"

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [_read(h) for h in batch.pop("html")]
            yield batch.assign(raw_title=[p[0] for p in parsed], raw_text=[p[1] for p in parsed])

    return pages.select(*keep, "html").mapInPandas(parse, schema)


def extract_pages(pages: DataFrame, key: str = "page_id", max_chars: int = 0) -> DataFrame:
    """Canonical pages: normalised URL, title, Markdown and its hash; pages without text are left out.

    Only parsing runs in Python; tidying, titles and hashes are expressions.
    """
    body = truncate_marked(clean_text(F.col("raw_text")), max_chars)
    tidy = html_text(pages, [key, "url"]).select(key, F.col("url").alias("source_url"), clean_text(F.col("raw_title")).alias("t"), body.alias("body")).where("body != ''")
    title = F.coalesce(F.nullif("t", F.lit("")), F.nullif(host(F.col("source_url")), F.lit("")), F.col("source_url"))
    page = tidy.withColumn("title", title).withColumn("markdown", canonical_markdown(F.col("title"), F.col("source_url"), F.col("body")))
    return page.select(
        key, normalize_url(F.col("source_url")).alias("url"), F.substring("title", 1, 512).alias("title"), "markdown", content_hash(F.col("markdown")).alias("content_hash"),
    )


def site_links(pages: DataFrame, limit: int, key: str = "page_id") -> DataFrame:
    """Distinct links to the page's own host in order of appearance, the page itself first."""
    base = normalize_url(F.col("url"))
    hrefs = F.regexp_extract_all("html", F.lit(r"(?i)<a\b[^>]*?\shref\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    # Links are resolved inside the array, so that the host test below reads finished values.
    based = pages.select(key, base.alias("base"), host(base).alias("site"), F.transform(hrefs, strip).alias("hrefs"))
    resolved = F.transform("hrefs", lambda h: normalize_url(resolve_href(F.col("base"), h)))
    linked = based.select(key, "site", F.concat(F.array("base"), resolved).alias("links"))
    marked = F.transform("links", lambda u: F.struct(u.alias("link"), (u.rlike("^https?:") & (host(u) == F.col("site"))).alias("same")))
    listed = linked.select(key, F.posexplode(marked).alias("position", "l")).where("l.same")
    first = listed.groupBy(key, F.col("l.link").alias("link")).agg(F.min("position").alias("position"))
    return top_k(first, limit, [F.col("position")], [key])
