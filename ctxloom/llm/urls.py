"""URL filters in DataFrame functions alone (operator 4).

Rules come first: a rule `host/path` fits its host and all subdomains of URLs
whose path starts with its path; the longest rule wins.  Every other URL is
looked up in a list of canonical URLs: a blocked Bloom filter - one 64-bit word
per block, four bits per listed URL, all in the block its hash names - passes
possible hits to an exact hash join, which removes false positives.  URLs that
the filter rules out are never shuffled, however long the list.

The filter has BITS bits per listed URL, stored as rows of ROW words.  Its size
follows from the length of the list, which is counted first; it is broadcast in
pieces of at most PIECE_ROWS rows (about 12 MB), one after another.  Executors
hold about 3 bytes of it for each listed URL.

Canonical form: scheme, fragment, a leading `www.` and tracking parameters
(utm_*, ref) go, the host is lower-cased, a final slash goes.

Defined cases: a null URL, or one without `://`, has empty host and path, fits
no rule, and is never listed; repeated rows give repeated results; an empty list
allows everything that no rule blocks.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BITS = 16
ROW = 16  # words of the filter in one row
PIECE_ROWS = 1 << 16  # rows of the filter in one broadcast
INLINE_RULES = 200  # more rules are joined by host suffix

# The rules of the query, (action, rule).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
# Site names whose pages make up the query's list of URLs.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with host, path and canonical (null where there is no host)."""
    rest = F.coalesce(after_scheme(F.col(url)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)((utm_[^=&]*|ref)=[^&]*)(?=&|$)", "$1"), r"^&+|&+$|(?<=&)&+", "")
    canonical = F.concat(F.regexp_replace(lower_ascii(host), r"^www\.", ""), F.regexp_replace(path, r"/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return urls.select("*", lower_ascii(host).alias("host"), path.alias("path"), F.when(host != "", canonical).alias("canonical"))


def _ordered(rules) -> list[tuple[str, str, str, str]]:
    """(action, rule, host, path), longest first; equally long ones by action and text, so ties are settled alike everywhere."""
    parts = [(action, rule, *rule.partition("/")[::2]) for action, rule in rules]
    return sorted(((a, r, h.lower(), f"/{p}") for a, r, h, p in parts), key=lambda x: (-len(x[1]), x[0], x[1]))


def with_rules(urls: DataFrame, rules) -> DataFrame:
    """urls (host, path) with rule and action of the longest rule that fits, null where none does."""
    ordered = _ordered(rules)
    if not ordered:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("action"))
    if len(ordered) <= INLINE_RULES:
        fits = [F.when((F.endswith(F.concat(F.lit("."), F.col("host")), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p)), F.struct(F.lit(r).alias("rule"), F.lit(a).alias("action"))) for a, r, h, p in ordered]
        return urls.select("*", F.coalesce(*fits).alias("fit")).select("*", "fit.rule", "fit.action").drop("fit")
    spark = urls.sparkSession
    known = spark.createDataFrame([(k, *x) for k, x in enumerate(ordered)], "place int, action string, rule string, rule_host string, rule_path string")
    numbered = staged(urls.withColumn("row", F.monotonically_increasing_id()), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    near = numbered.select("row", "path", F.explode(suffixes).alias("rule_host")).join(known, "rule_host").where("startswith(path, rule_path)")
    best = near.groupBy("row").agg(F.min(F.struct("place", "rule", "action")).alias("fit"))
    return numbered.join(best, "row", "left").select(*urls.columns, "fit.rule", "fit.action")


def _block_and_mask(key: Column, blocks: int) -> tuple[Column, Column]:
    """The block of a key and its four bits there."""
    spread = F.xxhash64(key, F.lit(7))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return F.pmod(F.xxhash64(key), F.lit(blocks)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def bloom_rows(listed: DataFrame, blocks: int) -> DataFrame:
    """(filter_row, words): the filter of listed (canonical), ROW words in a row; rows of zeros are left out."""
    block, mask = _block_and_mask(F.col("canonical"), blocks)
    placed = listed.select(F.floor(block / ROW).alias("filter_row"), F.pmod(block, F.lit(ROW)).alias("place"), mask.alias("mask"))
    words = F.array(*[F.coalesce(F.bit_or(F.when(F.col("place") == k, F.col("mask"))), F.lit(0).cast("long")) for k in range(ROW)])
    return placed.groupBy("filter_row").agg(words.alias("words"))


def possible_hits(urls: DataFrame, rows: DataFrame, blocks: int, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """urls with maybe_listed: whether the filter (its rows are read once for each piece) has all bits of the canonical URL."""
    block, mask = _block_and_mask(F.col("canonical"), blocks)
    marked = urls.select("*", F.floor(block / ROW).alias("filter_row"), (F.pmod(block, F.lit(ROW)) + 1).cast("int").alias("place"), mask.alias("mask"), F.lit(0).cast("long").alias("word"))
    pieces = math.ceil(blocks / ROW / piece_rows)
    for k in range(pieces):
        piece = rows if pieces == 1 else rows.where(F.col("filter_row").between(k * piece_rows, (k + 1) * piece_rows - 1))
        found = F.coalesce(F.element_at("words", F.col("place")), F.col("word"))
        marked = marked.join(F.broadcast(piece), "filter_row", "left").select(*urls.columns, "filter_row", "place", "mask", found.alias("word"))
    hit = F.coalesce(F.col("canonical").isNotNull() & (F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")), F.lit(False))
    return marked.select(*urls.columns, hit.alias("maybe_listed"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every page; listed is a table of canonical URLs."""
    known = listed.select("canonical").where("canonical IS NOT NULL").distinct()
    n = known.count()
    urls = with_rules(with_parts(pages.select("page_id", "url")), rules)
    if not n:
        return urls.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(False).alias("listed"))
    blocks = math.ceil(n * BITS / 64)
    rows = bloom_rows(known, blocks)
    marked = possible_hits(urls, rows if blocks <= ROW * PIECE_ROWS else staged(rows, "filter"), blocks)
    ruled_out = marked.where("NOT maybe_listed").select("page_id", "host", "path", "rule", "action", F.lit(False).alias("listed"))
    exact = marked.where("maybe_listed").join(known.withColumn("hit", F.lit(True)), "canonical", "left")
    exact = exact.select("page_id", "host", "path", "rule", "action", F.coalesce("hit", F.lit(False)).alias("listed"))
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return ruled_out.unionByName(exact).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")


def sites_list(pages: DataFrame, sites=LISTED_SITES) -> DataFrame:
    """The query's list: canonical URLs of the pages of the named sites."""
    names = "|".join(s.replace("-", "\\-") for s in sites)
    return with_parts(pages.select("url")).where(F.col("host").rlike(rf"(^|\.)({names})\.[^.]+\.[^.]+$")).select("canonical").distinct()


def url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, staged(sites_list(pages), "listed"))


def _oracle() -> str:
    """The same rows in DuckDB: exact look-up in place of the filter."""
    ordered = _ordered(RULES)
    fits = lambda h, p: f"ends_with('.' || host, '.{h}') AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{r}'" for _, r, h, p in ordered)
    action = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, _, h, p in ordered)
    names = "|".join(LISTED_SITES)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw, coalesce(rest, '') AS rest FROM rest),
tails AS (SELECT page_id, raw, substr(rest, length(raw) + 1) AS tail FROM parts),
split AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^?#]*') AS path,
  array_to_string(list_filter(string_split(regexp_extract(tail, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|ref)=')), '&') AS query FROM tails),
urls AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM split),
listed AS (SELECT DISTINCT canonical FROM urls WHERE regexp_matches(host, '(^|\\.)({names})\\.[^.]+\\.[^.]+$')),
judged AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {action} END AS action, coalesce(canonical IN (SELECT canonical FROM listed), false) AS listed FROM urls)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM judged
"""


ORACLE = _oracle()
