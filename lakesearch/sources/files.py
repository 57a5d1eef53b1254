"""Files and inline items as rows with bytes, hash, address and type."""

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakesearch.functions.coerce import mime_by_extension
from lakesearch.functions.ids import content_hash
from lakesearch.functions.text import strip

# Largest accepted corpus document and JSON text.
MAX_CORPUS_BYTES, MAX_JSON_CHARS = 5_000_000, 200_000
#: Files beyond this size are hashed by pieces, not from a column of their bytes.
STREAMED_BYTES, PIECE_BYTES = 32 << 20, 1 << 20
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
#: The same, or front matter that nothing follows.
ENDING_FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*(?:\n|\z)"


def expand_braces(pattern: str) -> list[str]:
    """``*.{md,txt}`` as separate globs."""
    head, brace, rest = pattern.partition("{")
    body, closing, tail = rest.partition("}")
    if not (brace and closing):
        return [pattern]
    return [f"{head}{choice}{tail}" for choice in body.split(",") if choice]


@F.pandas_udf(T.StringType())
def streamed_hash(paths: pd.Series) -> pd.Series:
    """SHA-256 of files under ``file:``, read a piece at a time."""

    def digest(path: str) -> str:
        done = hashlib.sha256()
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as file:
            while piece := file.read(PIECE_BYTES):
                done.update(piece)
        return done.hexdigest()

    return paths.map(digest)


def is_local(spark: SparkSession, root: str) -> bool:
    """Whether a folder's files can be opened under ``file:``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"


def scan_stream(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path and content_hash of the files that arrive in a folder. Local files of any size are hashed by pieces; other file systems
    give whole contents only, of 2 GB at most."""
    found = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern).load(root)
    return found.select("path", (streamed_hash("path") if is_local(spark, root) else F.sha2("content", 256)).alias("content_hash"))


def scan_directory(spark: SparkSession, root: str, pattern: str = "**/*", uri_template: str = "sync://{root_key}/{relative}", root_key: str = "root") -> DataFrame:
    """Files below a folder: address, name, bytes, hash and type, each file once.

    The last segment of every alternative of ``pattern`` filters file names;
    sub-folders are always searched.
    """
    # several alternatives are one glob, so that no file is listed twice
    globs = sorted({glob.rsplit("/", 1)[-1] for glob in expand_braces(pattern)})
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}").load(root)
    # content stays with the scan: it isn't read for long files unless it is asked for, and never shuffled
    if is_local(spark, root):
        # a bare comparison of the length is pushed down to the scan
        rows = found.where(F.col("length") <= STREAMED_BYTES).withColumn("content_hash", F.sha2("content", 256))
        rows = rows.unionByName(found.where(F.col("length") > STREAMED_BYTES).withColumn("content_hash", streamed_hash("path")))
    else:  # other file systems give whole contents only
        rows = found.withColumn("content_hash", F.sha2("content", 256))
    plain_root = F.lit(root.rstrip("/").removeprefix("file:"))
    path = F.regexp_replace("path", r"^file:/+", "/")
    relative = F.regexp_replace(F.substring(path, F.length(plain_root) + 1, F.length(path)), r"^/+", "")
    head, _, tail = uri_template.replace("{root_key}", root_key).partition("{relative}")
    name = F.regexp_extract("relative", r"([^/]+)$", 1)
    return rows.withColumn("relative", relative).select(
        F.concat(F.lit(head), "relative", F.lit(tail)).alias("source_uri"), name.alias("filename"), "content", "content_hash", mime_by_extension(name).alias("mime"), "relative",
    )


def inline_items(items: DataFrame) -> DataFrame:
    """Items carrying base64 content: source_uri, filename, content_b64[, mime]."""
    declared = F.col("mime") if "mime" in items.columns else F.lit(None).cast("string")
    content = F.unbase64("content_b64")
    return items.withColumns({"content": content, "mime": F.coalesce(declared, mime_by_extension(F.col("filename")))}).withColumn(
        "content_hash", F.sha2("content", 256)
    ).drop("content_b64")


def corpus(files: DataFrame, category: str | None = None, offset: int = 0, limit: int | None = None, empty: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Markdown files by category as pages, and the refused ones with a reason.

    ``files``: relative, content. The first path segment is the category; paging
    follows the case-folded path, and refused files use up their place. Files
    that ``empty`` marks are refused as empty, by default those of white space only.
    """
    rows = files.where(F.col("relative").contains("/")).withColumn("category", F.split_part("relative", F.lit("/"), F.lit(1)))
    if category:
        rows = rows.where(F.col("category") == category)
    page = rows.orderBy(F.lower("relative"), "relative").offset(offset)
    page = page.limit(limit) if limit is not None else page
    text = F.try_validate_utf8(F.col("content").cast("string"))
    read = page.withColumn("raw", text).withColumn("markdown", strip(F.col("raw")))
    url = F.concat(F.lit("legacy-corpus:///"), F.replace(F.url_encode("relative"), F.lit("%2F"), F.lit("/")))
    url = F.replace(url, F.lit("+"), F.lit("%20"))
    reason = (
        F.when(F.octet_length("content") > MAX_CORPUS_BYTES, "too_large").when(F.col("raw").isNull(), "not_utf8")
        .when(F.col("markdown") == "" if empty is None else empty, "empty")
    )
    judged = read.withColumns({"url": url, "reason": reason})
    name = F.regexp_extract("relative", r"([^/]+)$", 1)
    heading = F.nullif(strip(F.regexp_extract("markdown", r"(?m)^#\s+(.+?)\s*$", 1)), F.lit(""))
    good = judged.where("reason IS NULL").select(
        "url", F.substring(F.coalesce(heading, F.regexp_replace(name, r"\.[^.]*$", "")), 1, 512).alias("title"), "markdown",
        content_hash(F.col("markdown")).alias("content_hash"), "category", name.alias("artifact_filename"), "relative",
    )
    return good, judged.where("reason IS NOT NULL").select("url", "reason")


def categories(files: DataFrame) -> DataFrame:
    """Number of files per category."""
    return files.groupBy("category").agg(F.count("*").alias("files"))


def guess_mime(filename: Column, content: Column) -> Column:
    """Type by signature, then by a look at the text, then by extension."""
    def starts(*signatures):
        test = F.lit(False)
        for signature in signatures:
            test = test | F.startswith(content, F.unhex(F.lit(signature)))
        return test

    webp = starts("52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250")
    first = F.regexp_extract(F.hex(F.substring(content, 1, 64)), r"^(?:09|0A|0B|0C|0D|20)*(7B|5B)", 1)
    head = F.lower(F.decode(F.substring(content, 1, 2000), "ISO-8859-1"))
    # Signatures in hexadecimal and their types.
    return (
        F.when(starts("255044462D"), "application/pdf").when(starts("89504E470D0A1A0A"), "image/png").when(starts("FFD8FF"), "image/jpeg")
        .when(starts("474946383761", "474946383961"), "image/gif").when(starts("424D"), "image/bmp").when(webp, "image/webp")
        .when(first != "", "application/json").when(F.contains(head, F.lit("<html")), "text/html")
        .otherwise(F.coalesce(mime_by_extension(filename), F.lit("application/octet-stream")))
    )


# Types with an extractor.
SUPPORTED_MIME = (
    "application/json", "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/xhtml+xml",
    "image/bmp", "image/gif", "image/jpeg", "image/png", "image/tiff", "image/webp", "text/csv", "text/html", "text/markdown", "text/plain", "text/x-markdown",
)


def route_mime(filename: Column, content: Column, declared: Column) -> Column:
    """Type used for extraction: the guess when supported, else the declared one; null when neither is."""
    guess = guess_mime(filename, content)
    return F.when(guess.isin(*SUPPORTED_MIME), guess).when(declared.isin(*SUPPORTED_MIME), declared)


def _decode(data: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-8", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


@F.pandas_udf(T.StringType())
def decode_text(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Text of bytes in the first encoding that fits."""
    for part in contents:
        yield part.map(_decode)


@F.pandas_udf(T.BooleanType())
def valid_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield part.map(_is_json)


def extract_text(files: DataFrame, front_matter: str = FRONT_MATTER) -> DataFrame:
    """Text-family files as text with front matter, title and truncation handled.

    ``files``: filename, mime, content. Adds text, front_matter, truncated and a
    problem (``empty``, ``invalid_json``) that is null for a good file.
    ``front_matter``: what is taken as such in Markdown, with its content as the
    first group.
    """
    from lakesearch.sources.html import html_text

    decoded = files.withColumn("raw", decode_text("content"))
    is_html = F.col("mime").isin("text/html", "application/xhtml+xml")
    markdown = F.col("mime").isin("text/markdown", "text/x-markdown")
    keep = [c for c in files.columns if c != "content"]
    plain = decoded.where(~is_html).select(*keep, strip(F.col("raw")).alias("body"), F.lit("").alias("title"))
    pages = html_text(decoded.where(is_html).withColumnRenamed("raw", "html"), keep).select(*keep, F.col("raw_text").alias("body"), strip(F.col("raw_title")).alias("title"))
    both = plain.unionByName(pages)
    front = F.nullif(F.regexp_extract("body", front_matter, 1), F.lit(""))
    titled = F.when((F.col("title") != "") & ~F.contains("body", "title"), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    is_json = F.col("mime") == "application/json"
    long = is_json & (F.length("body") > MAX_JSON_CHARS)
    text = (
        F.when(markdown, strip(F.regexp_replace("body", front_matter, "")))
        .when(long, F.concat(F.substring("body", 1, MAX_JSON_CHARS), F.lit("\n...[truncated]"))).otherwise(strip(titled))
    )
    problem = F.when(is_json & ~valid_json("body"), "invalid_json").when(F.col("text") == "", "empty")
    out = both.withColumns({"text": text, "front_matter": F.when(markdown, strip(front)), "truncated": long})
    return out.withColumn("problem", problem).select(*keep, "text", "title", "front_matter", "truncated", "problem")
