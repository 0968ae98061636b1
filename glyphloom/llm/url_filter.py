"""URL filters: site rules, and a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 256-bit blocks, built by one bit_or aggregation. Each URL's key is
tested against one block (one hash join on the block number); the few that pass go on to an
exact hash join with the listed URLs, which removes the false positives. All of it is
DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Bits of the filter for each listed URL; with 8 bits set a key, some 0.1 % of others pass.
BITS_PER_URL = 16
WORDS, WORD_BITS = 4, 64
#: A filter of up to so many blocks (48 bytes each as rows) is broadcast, a larger one joined by shuffle.
BROADCAST_BLOCKS = 1 << 18
#: An exact list of up to so many urls (some 100 bytes each) is sent to the tasks.
BROADCAST_KEYS = 100_000
#: Copies of a longer exact list that the possible hits are spread over, so that one URL which a third of
#: all pages share does not end in one task.
SALTS = 32
_SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without leading www. and default port, path without a last slash, query without tracking keys, no fragment.

    Null if there is no host. The scheme is left out: http and https are one page.
    """
    host = F.regexp_replace(F.regexp_replace(url_host(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)")))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_match(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule string or null, its verdict or null) of the longest rule that fits.

    A rule fits its host and all subdomains if the path starts with the rule's. ``rules`` is a short
    hand-written list: it becomes one expression, tried from the longest on; of equally long ones the first in order.
    No rule fits a null host or path.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = verdict = None
    for what, h, p in ordered:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    null = F.lit(None).cast("string")
    return (null, null) if rule is None else (rule, verdict)


def _bits(key: Column) -> list[Column]:
    """The block's words with the key's bits set: two bits in each of the four words."""
    low = F.xxhash64(key, F.lit(7)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    spot = [F.pmod(F.shiftright(low * F.lit(s).cast("long"), 16), F.lit(WORD_BITS)).cast("int") for s in _SALT]
    one = F.lit(1).cast("long")
    return [_shl(one, spot[2 * w]).bitwiseOR(_shl(one, spot[2 * w + 1])) for w in range(WORDS)]


def _shl(one: Column, by: Column) -> Column:
    return F.call_function("shiftleft", one, by)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("long"))


def build_filter(keys: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(table (__block, __w0..__w3), number of blocks) of the distinct column ``key`` of any type. Blocks without a key are left out."""
    blocks = 1
    while blocks * WORDS * WORD_BITS < n_keys * BITS_PER_URL:
        blocks *= 2
    words = _bits(F.col("key"))
    rows = keys.select(_block(F.col("key"), blocks).alias("__block"), *[w.alias(f"__w{i}") for i, w in enumerate(words)])
    return rows.groupBy("__block").agg(*[F.bit_or(f"__w{i}").alias(f"__w{i}") for i in range(WORDS)]), blocks


def probe(rows: DataFrame, key_col: str, table: DataFrame, blocks: int) -> DataFrame:
    """rows with a column ``__possible``: false where the filter is sure that the key is not in it, and for null keys.

    The table is sent to the tasks up to BROADCAST_BLOCKS blocks, joined by shuffle beyond.
    """
    names, key = rows.columns, F.col(key_col)
    words = _bits(key)
    possible = key.isNotNull() & F.col("__w0").isNotNull()
    for i in range(WORDS):
        possible = possible & (F.coalesce(F.col(f"__w{i}"), F.lit(0)).bitwiseAND(words[i]) == words[i])
    hashed = rows.withColumn("__block", F.when(key.isNotNull(), _block(key, blocks)))
    side = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    return hashed.join(side, "__block", "left").select(*names, F.coalesce(possible, F.lit(False)).alias("__possible"))


def listed_flag(rows: DataFrame, listed: DataFrame, url_col: str, id_col: str) -> DataFrame:
    """rows with a column ``is_listed``: whether the canonical URL is one of ``listed``'s (column ``url``).

    Rows without a canonical URL are not listed; nulls, repeats and any spelling in ``listed`` are fine, and an
    empty list lists nothing. What the filter turns away (nearly all) never moves. What passes is joined exactly: with
    the list itself where the rows lie, up to BROADCAST_KEYS urls; beyond, in a branch of its own, spread over SALTS
    copies of the list by a hash of the id. Columns of rows may have any names but such as begin with two underscores.
    """
    keys = listed.select(canonical_url(F.col("url")).alias("key")).where("key is not null").distinct()
    n = keys.count()
    names = rows.columns
    keys = keys.select(F.col("key").alias("__listed"))
    probed = probe(rows.withColumn("__key", canonical_url(F.col(url_col))), "__key", *build_filter(keys.select(F.col("__listed").alias("key")), n))
    flag = F.col("__listed").isNotNull().alias("is_listed")
    if n <= BROADCAST_KEYS:
        asked = probed.withColumn("__key", F.when(F.col("__possible"), F.col("__key")))
        return asked.join(F.broadcast(keys), F.col("__key") == F.col("__listed"), "left").select(*names, flag)
    turned_away = probed.where("not __possible").select(*names, F.lit(False).alias("is_listed"))
    salted = keys.select("__listed", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__copy"))
    may = probed.where("__possible").withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int"))
    exact = may.join(salted, (F.col("__key") == F.col("__listed")) & (F.col("__salt") == F.col("__copy")), "left")
    return turned_away.unionByName(exact.select(*names, flag))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, is_listed) for every row of pages.

    A rule that fits decides; else a listed URL is blocked and any other allowed. Null or odd URLs have empty
    host and path, fit no rule and are allowed. Equal rows are judged alike, each on its own.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    flagged = listed_flag(rows, listed, "url", "id").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    rule, verdict = rule_match(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("is_listed"), "block").otherwise("allow")
    return flagged.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "is_listed")
