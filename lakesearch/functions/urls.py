"""URL and source-URI expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesearch.functions.text import strip

# Query parameters dropped from the de-duplication key.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")

# Schemes a stable source URI may use, and its length bound.
SOURCE_SCHEMES = (
    "http", "https", "crawler", "legacy-corpus", "file", "upload", "sync", "nvd", "cve", "attack", "kev",
)
SOURCE_URI_MAX = 2048

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def host(url: Column) -> Column:
    """Lower-cased host without credentials and port."""
    authority = F.regexp_replace(url_part(url, 2), r"^.*@", "")
    bare = F.regexp_replace(authority, r":\d*$", "")
    return F.lower(F.regexp_replace(bare, r"^\[|\]$", ""))


def normalize_url(url: Column) -> Column:
    """Stable key: scheme and host lower case, no fragment, no tracking parameters."""
    value = strip(F.coalesce(url, F.lit("")))
    # Each part is decorated by one replacement, which leaves an empty part empty.
    scheme = F.regexp_replace(F.lower(url_part(value, 1)), "^(.+)$", "$1:")
    authority = F.regexp_replace(F.lower(url_part(value, 2)), "^(.+)$", "//$1")
    path = F.regexp_replace(url_part(value, 3), "^$", "/")

    def kept(part: Column) -> Column:
        key = F.lower(F.split_part(part, F.lit("="), F.lit(1)))
        tracked = key.isin(*TRACKING_KEYS) | F.startswith(key, F.lit(TRACKING_PREFIX))
        return (part != "") & ~tracked

    query = F.array_join(F.filter(F.split(url_part(value, 4), "&"), kept), "&")
    return F.concat(scheme, authority, path, F.regexp_replace(query, "^(.+)$", r"?$1"))


def fold_dots(url: Column) -> Column:
    """``url`` without ``.`` and ``..`` segments in its path; those above the top are dropped."""
    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", shorter).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    path = url_part(url, 3)
    parts = F.split(path, "/")
    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    ended = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    rest = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    front = F.concat(F.regexp_replace(url_part(url, 1), "^(.+)$", "$1:"), F.regexp_replace(url_part(url, 2), "^(.+)$", "//$1"))
    return F.when(F.startswith(path, F.lit("/")) & path.rlike(r"/\.\.?(/|$)"), F.concat(front, F.array_join(ended, "/"), rest)).otherwise(url)


def resolve_href(base: Column, href: Column) -> Column:
    """Absolute form of a link found on ``base``."""
    return fold_dots(_joined(base, href))


def _joined(base: Column, href: Column) -> Column:
    origin = F.concat(url_part(base, 1), F.lit("://"), url_part(base, 2))
    folder = F.regexp_extract(url_part(base, 3), r"^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(url_part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, href))
        .when(href.rlike(r"^[?#]"), F.concat(origin, url_part(base, 3), href))
        .otherwise(F.concat(origin, folder, href))
    )


def source_uri_problem(uri: Column) -> Column:
    """Reason a stable source URI is refused, null when it is good."""
    value = strip(F.coalesce(uri, F.lit("")))
    segments = F.split(F.translate(value, "\\", "/"), "/")
    scheme = F.lower(F.regexp_extract(value, r"^([a-zA-Z][a-zA-Z0-9+.\-]*)://", 1))
    return (
        F.when(value == "", F.lit("empty"))
        .when(F.length(value) > SOURCE_URI_MAX, F.lit("too_long"))
        .when(F.array_contains(segments, ".."), F.lit("path_traversal"))
        .when(scheme == "", F.lit("no_scheme"))
        .when(~scheme.isin(*SOURCE_SCHEMES), F.lit("scheme_not_allowed"))
    )


def _ipv4_number(address: Column) -> Column:
    octets = F.transform(F.split(address, r"\."), lambda o: o.try_cast("bigint"))
    return F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o)


# IPv4 blocks that are not public (network, prefix length).
NON_PUBLIC_BLOCKS = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
)


def public_url_problem(url: Column) -> Column:
    """Lexical reason a URL must not be fetched, null when it may be."""
    value = strip(F.coalesce(url, F.lit("")))
    name = host(value)
    number = _ipv4_number(name)
    private = F.lit(False)
    for network, bits in NON_PUBLIC_BLOCKS:
        low = sum(int(o) << (24 - 8 * i) for i, o in enumerate(network.split(".")))
        private = private | number.between(low, low + (1 << (32 - bits)) - 1)
    port = F.regexp_extract(url_part(value, 2), r":(\d+)$", 1)
    return (
        F.when(~F.lower(url_part(value, 1)).isin("http", "https"), F.lit("scheme"))
        .when(name == "", F.lit("no_host"))
        .when(F.contains(url_part(value, 2), F.lit("@")), F.lit("credentials"))
        .when((port != "") & (port.try_cast("bigint") > 65535), F.lit("port"))
        .when(name.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & private, F.lit("private_address"))
        .when(name.isin("::1", "::") | name.rlike(r"^(fe[89ab]|f[cd]|ff)[0-9a-f]*:"), F.lit("private_address"))
    )
