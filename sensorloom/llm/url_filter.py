"""URL filters by a Bloom filter cascade, in built-in functions only.

Level 0 encodes the listed keys. Level 1 encodes the keys of the corpus that aren't listed but pass
level 0, level 2 the listed keys that pass level 1, and so on until a level lets nothing false
through. Over the keys from which it was built the cascade then answers exactly, and a URL is judged
by bit tests on a few literals, without a join.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Most listed keys and bits of a level: a level is a literal of 16 MB at most that goes to every task. A
#: longer list is refused, not cut.
MAX_LISTED = 2_000_000
MAX_BITS = 1 << 27

#: The rules: (action, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Listed hosts; with their subdomains they are blocked where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int


def url_host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All `host path-prefix` keys that could be listed: at most `labels` last labels, prefixes of the listed lengths.

    The space between both parts is in no host of a list, so different pairs give different keys.
    """
    hosts = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(1, labels + 1)], host))
    # A prefix shorter than asked for is no new key: it has a length that is asked for, or none listed.
    prefixes = F.array_distinct(F.array(*[F.substring(path, 1, n) for n in lengths]))
    return F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit(" "), p))))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(bits)) for i in range(hashes)]


def _passes(key: Column, level: int, made: Level) -> Column:
    if not made.words:
        return F.lit(False)
    array = F.from_json(F.lit(json.dumps(made.words)), "array<bigint>")  # one literal, folded when the query is planned
    test = F.lit(True)
    for at in _positions(key, level, made.bits, made.hashes):
        test = test & (F.getbit(array[(at / 64).cast("int")], (at % 64).cast("int")) == 1)
    return test


def _level(keys: DataFrame, level: int, n: int, rate: float) -> Level:
    """The filter of n keys with about the given rate of false positives. Its bits are gathered, not the keys."""
    if n == 0:
        return Level((), 64, 1)
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = 64 * math.ceil(max(64, n * hashes / math.log(2)) / 64)
    if bits > MAX_BITS:
        raise ValueError(f"a level of {n} keys needs {bits} bits; at most {MAX_BITS} are sent to tasks")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at"))
    rows = at.groupBy((F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("v")).collect()
    words = dict(map(tuple, rows))
    return Level(tuple(words.get(w, 0) for w in range(bits // 64)), bits, hashes)


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Level]:
    """Levels for the listed keys, exact over every key of the universe (both: one column, key; null keys are left out).

    Only bit words reach the driver. Their number follows the list: the first rate is chosen from the
    counts of both sets so that about as many false positives stay as there are listed keys.
    """
    listed = listed.filter(F.col("key").isNotNull()).distinct()
    n_listed = listed.limit(MAX_LISTED + 1).count()
    if n_listed > MAX_LISTED:
        raise ValueError(f"over {MAX_LISTED} listed keys")
    others = staged(universe.filter(F.col("key").isNotNull()).distinct().join(F.broadcast(listed), "key", "left_anti"))
    n_others = others.count()
    levels = [_level(listed, 0, n_listed, min(0.5, max(1, n_listed) / (math.sqrt(2) * max(1, n_others))))]
    # From here on both sets are about as large as the list.
    inside, outside = listed, staged(others.filter(_passes(F.col("key"), 0, levels[0])))
    while (n := outside.count()) > 0:
        levels.append(made := _level(outside, len(levels), n, 0.5))
        inside, outside = outside, staged(inside.filter(_passes(F.col("key"), len(levels) - 1, made)))
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the universe is listed: the first level that it fails decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        answer = F.when(~_passes(key, i, levels[i]), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def judge_urls(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    (ties: the longer host). Where none fits, a host under a listed one is blocked and all others
    are allowed. Null URLs and those without :// have an empty host and path, which no rule fits.
    Rows that repeat are judged each, and an empty table gives no rows; columns other than page_id and
    url are not read.
    """
    spark = pages.sparkSession
    rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[2]))
    labels = max([1 + h.count(".") for _, h, _ in rules] + [1 + h.count(".") for h in blocked_hosts], default=1)
    lengths = sorted({len(p) for _, _, p in rules} | {0})
    # Keys are tagged by list: one cascade answers for the blocking and allowing rules and for the hosts.
    listed = [(f"{a} {h} {p}",) for a, h, p in rules] + [(f"host {h} ",) for h in blocked_hosts]
    parts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    keyed = parts.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths))
    tags = F.array(F.lit("block "), F.lit("allow "), F.lit("host "))
    tagged = lambda keys: F.flatten(F.transform(tags, lambda t: F.transform(keys, lambda k: F.concat(t, k))))
    universe = keyed.select(F.explode("keys").alias("k")).distinct().select(F.explode(F.transform(tags, lambda t: F.concat(t, F.col("k")))).alias("key"))
    levels = build_cascade(universe, spark.createDataFrame(listed or [(None,)], "key string"))
    hits = keyed.select("page_id", "host", "path", F.filter(tagged(F.col("keys")), lambda k: is_listed(k, levels)).alias("hits"))
    fits = [F.when(F.array_contains("hits", f"{a} {h} {p}"), F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("verdict"))) for a, h, p in rules]
    under = F.exists("hits", lambda k: k.startswith("host "))
    best = F.coalesce(*fits, F.struct(F.lit(None).cast("string").alias("rule"), F.when(under, F.lit("block")).otherwise(F.lit("allow")).alias("verdict")))
    return hits.select("page_id", "host", "path", best["rule"].alias("rule"), best["verdict"].alias("verdict"))


def oracle_sql(rules=RULES, blocked_hosts=BLOCKED_HOSTS) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = [(f"('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}')", h + p, a) for a, h, p in ordered]
    under = " OR ".join(f"('.' || host) LIKE '%.{h}'" for h in blocked_hosts)
    return f"""
    WITH parts AS (
      SELECT page_id,
             translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
      FROM pages)
    SELECT page_id, host, path,
           CASE {' '.join(f"WHEN {t} THEN '{r}'" for t, r, _ in fits)} END AS rule,
           CASE {' '.join(f"WHEN {t} THEN '{a}'" for t, _, a in fits)} WHEN {under} THEN 'block' ELSE 'allow' END AS verdict
    FROM parts"""
