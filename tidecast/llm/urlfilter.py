"""URL filters: rules on host and path, and a list of canonical URLs behind a blocked Bloom filter.

A listed URL's key falls in one block of 256 bits and sets one bit in each of the block's eight lanes; blocks are
aggregated by Spark (a bitwise OR of four longs each) and broadcast, ``MAX_BLOCKS`` of them at most (32 MB of bits), so
that a filter has a size bound whatever the list's. A list that outgrows it only lets more URLs through to the next step.
Possible hits, and nothing else, are then joined by hash with the list itself on the canonical URL, which takes out the
filter's false positives; a hot URL is a skewed side of that join, which Spark deals out anew.

A rule is (action, host, path): it fits its host and all subdomains where the URL's path starts with the rule's, and the
longest (host and path together, then host) that fits decides. URLs without a fitting rule are blocked if listed.

Canonical form: no scheme, A-Z of the host lowered and a leading ``www.`` dropped, no trailing slashes on the path, no
fragment, parameters in order without empty and tracking ones.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and is never listed, so it is
allowed; equal URLs are judged alike, each row is returned; an empty list blocks nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that only say where a visitor came from, beside all that begin with ``utm_``.
TRACKING = ("ref", "gclid", "fbclid")
BITS_PER_KEY = 12
BLOCK_BITS = 256
MAX_BLOCKS = 1 << 20
_WORDS = 4

Rule = tuple[str, str, str]


def _rest(url: Column) -> Column:
    """What follows the first ``://``, else empty."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The canonical form; null without ``://`` or host."""
    host, path = host_of(url), path_of(url)
    asked = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.filter(asked, lambda p: (p != "") & ~p.startswith("utm_") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    bare = F.when(host.startswith("www."), F.substring(host, F.lit(5), F.length(host))).otherwise(host)
    return F.when(bare != "", F.concat(bare, F.rtrim(path, F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name (host and path) and action of the longest rule that fits, else nulls."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def _lane_bits(key: Column) -> list[Column]:
    """The bit that the key sets in each of eight lanes of 32, as four longs."""
    lanes = F.xxhash64(key, F.lit("lanes"))
    bit = lambda lane: F.shiftrightunsigned(lanes, 5 * lane).bitwiseAND(F.lit(31)).cast("int")
    one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at)
    return [one(bit(2 * w)).bitwiseOR(one(bit(2 * w + 1) + 32)) for w in range(_WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocks_for(keys: int, max_blocks: int = MAX_BLOCKS) -> int:
    return min(max_blocks, max(1, math.ceil(keys * BITS_PER_KEY / BLOCK_BITS)))


def bloom_blocks(listed: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """block, w0 to w3: the filter's blocks that hold a key."""
    bits = listed.select(_block(F.col(key), blocks).alias("block"), *(c.alias(f"w{w}") for w, c in enumerate(_lane_bits(F.col(key)))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(_WORDS)))


def possible(rows: DataFrame, bloom: DataFrame, blocks: int, key: str = "canonical") -> DataFrame:
    """``rows`` with ``possible``: whether the filter may hold their key."""
    in_block = F.broadcast(bloom.withColumnRenamed("block", "bloom_block"))
    met = rows.join(in_block, _block(F.col(key), blocks) == F.col("bloom_block"), "left")
    every = F.lit(True)
    for w, bits in enumerate(_lane_bits(F.col(key))):
        every = every & (F.col(f"w{w}").bitwiseAND(bits) == bits)
    return met.withColumn("possible", F.coalesce(F.col(key).isNotNull() & every, F.lit(False))).drop("bloom_block", *(f"w{w}" for w in range(_WORDS)))


def judge(pages: DataFrame, listed: DataFrame, rules: list[Rule] = (), url: str = "url", keep: tuple[str, ...] = ("page_id",), max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The ``keep`` columns, host, path, canonical, rule, listed, verdict (allow or block) of each row.

    ``listed``: one column of canonical URLs. ``rules`` stand in the query as expressions, so they are for some hundreds;
    what is long belongs in the list.
    """
    name = listed.columns[0]
    keys = cut_lineage(listed.select(F.col(f"`{name}`").alias("key")).where("key is not null").distinct())
    blocks = blocks_for(keys.count(), max_blocks)
    at = F.col(f"`{url}`")
    parsed = pages.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in keep)).alias("row"), host_of(at).alias("host"), path_of(at).alias("path"), canonical(at).alias("canonical"))
    rule, action = fitting_rule(F.col("host"), F.col("path"), list(rules))
    marked = possible(parsed.withColumns({"rule": rule, "action": action}), bloom_blocks(keys, blocks, "key"), blocks)
    hits = marked.where("possible").join(keys.hint("shuffle_hash"), F.col("canonical") == F.col("key"), "left").withColumn("listed", F.col("key").isNotNull()).drop("key")
    every = hits.unionByName(marked.where("not possible").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("action", F.when(F.col("listed"), "block").otherwise("allow"))
    return every.select(*(F.col("row").getField(c).alias(c) for c in keep), "host", "path", "canonical", "rule", "listed", verdict.alias("verdict"))
