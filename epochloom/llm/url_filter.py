"""URL filter: rules for hosts and paths, and a list of canonical URLs behind a blocked Bloom filter.

A listed URL sets one bit in each of the eight 32-bit words of one block. The blocks are built by a grouped
``bit_or`` and broadcast: their number is capped (``max_blocks``), so the filter stays small however long the
list is; a fuller filter only lets more rows through. Rows with all eight bits set are possible hits; they alone
are shuffled, to an exact join with the list, which removes the false positives. Everything else stays in place.

Rules come first: a rule fits its host and all subdomains, if the URL's path starts with the rule's; the
longest wins (then the one with the longer host, then the first in order). Rules are a parameter of at most a few
hundred entries. A URL that no rule fits is blocked if it is listed and allowed if not.

Defined cases: a null URL, or one without ``://``, has empty host and path, is not listed and is allowed; an
empty list allows all; repeated rows and null page ids are kept; URLs of any length are handled whole; an empty
table gives an empty result; further columns are ignored.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Action, host and path of each rule of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Odd multipliers that place one bit in each word of a block.
SALTS = (1203114875, 1150766481, 2284105051, 2729912477, 1884591559, 770785867, 2667333959, 1550580529)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that name the way to a page, not the page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


@dataclass(frozen=True)
class Params:
    bits_per_url: int = 12
    #: 65,536 blocks of 32 bytes are 2 MB.
    max_blocks: int = 1 << 16


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, ``m.`` and default port, path without closing slashes, sorted telling parameters."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^(www\.|m\.)+", ""), r"(:80|:443)$", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(host, path, tail)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``(rule, action)``; null where none fits."""
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k][1] + rules[k][2]), -len(rules[k][1]), k))
    none = F.lit(None).cast("string")
    rule, action = none, none
    for k in reversed(order):
        act, rhost, rpath = rules[k]
        fits = ((host == rhost) | host.endswith(f".{rhost}")) & path.startswith(rpath)
        rule = F.when(fits, F.lit(rhost + rpath)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _place(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bit(key: Column, salt: int) -> Column:
    """One of 32 bits, from a second hash of the key."""
    drawn = F.pmod(F.xxhash64(key, F.lit("word")), F.lit(1 << 31)) * F.lit(salt)
    return F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(drawn, 40).bitwiseAND(31).cast("int"))


def blocked_bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7`` of the keys in ``listed.key``; at most ``blocks`` rows."""
    return listed.select(
        _place(F.col("key"), blocks).alias("block"), *[_bit(F.col("key"), s).alias(f"w{k}") for k, s in enumerate(SALTS)]
    ).groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(len(SALTS))])


def judge(
    pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple = RULES,
    params: Params = Params(),
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of every page; ``listed`` has a column ``url``."""
    keys = listed.select(canonical(F.col("url")).alias("key")).filter("key <> ''").distinct()
    count = keys.count()
    blocks = max(1, min(params.max_blocks, count * params.bits_per_url // 256 + 1))
    bloom = blocked_bloom(keys, blocks)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("key")
    )
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("action", action)
    set_ = None
    for k, salt in enumerate(SALTS):
        bit = _bit(F.col("key"), salt)
        here = F.col(f"w{k}").bitwiseAND(bit) != 0
        set_ = here if set_ is None else set_ & here
    # the filter has at most max_blocks rows, so it may be broadcast
    probed = rows.withColumn("block", _place(F.col("key"), blocks)).join(F.broadcast(bloom), "block", "left").withColumn(
        "possible", F.coalesce(set_, F.lit(False))
    ).select("page_id", "host", "path", "rule", "action", "key", "possible")
    exact = keys.withColumn("hit", F.lit(True))
    hits = probed.filter("possible").join(exact, "key", "left").select(
        "page_id", "host", "path", "rule", "action", F.coalesce("hit", F.lit(False)).alias("listed")
    )
    others = probed.filter("not possible").select("page_id", "host", "path", "rule", "action", F.lit(False).alias("listed"))
    own = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return hits.unionByName(others).select(
        "page_id", "host", "path", "rule", F.coalesce("action", own).alias("verdict"), "listed"
    )
