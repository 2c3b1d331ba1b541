"""URL rules answered by a cascade of Bloom filters, in DataFrame functions only.

A rule names a host and a path. The keys a URL can be listed under are its host suffixes
joined with its path prefixes, so the question per key is plain membership: is it listed?

Level 1 of the cascade holds the listed keys. The keys of the corpus that pass it without
being listed are level 2; the listed keys that pass level 2 are level 3; and so on until a
level has nothing left to correct. As the levels were built against every key of the
corpus, membership of those keys is exact, and a lookup is a few bit tests: no join.

Level 1 gets a false positive rate of about listed / unlisted keys, so level 2 is about as
large as the list and the cascade takes about 1.44 log2(unlisted / listed) bits for each
listed key: it grows with the list, and only with the logarithm of the corpus. It travels
in the plan as a literal, so its bits are bounded by ``max_bits`` and a longer list is
refused instead of being carried to every task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlake.session import pinned


@dataclass(frozen=True)
class Rule:
    """``action`` is block or allow; ``host`` fits itself and its subdomains."""

    action: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host.lower() + self.path


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: tuple[int, ...]

    def passes(self, key: Column) -> Column:
        words = F.array(*[F.lit(w).cast("long") for w in self.words])
        return reduce(
            lambda a, b: a & b,
            (
                F.getbit(F.element_at(words, (at / 64).cast("int") + 1), (at % 64).cast("int")) == 1
                for at in positions(key, self.seed, self.bits, self.hashes)
            ),
        )


def positions(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    """Double hashing: the i-th place is h1 + i * h2, with h2 cut to 31 bits.

    Every level has its own seed: keys that collide in one level part in the next.
    """
    first = F.xxhash64(F.lit(seed), key)
    second = F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 33)
    return [F.pmod(F.shiftrightunsigned(first, 2) + i * second, F.lit(bits)) for i in range(hashes)]


def build_level(keys: DataFrame, seed: int, count: int, rate: float, max_bits: int) -> Level:
    """Bloom filter over column ``key``: bits are or-ed by word before anything moves."""
    hashes = max(1, round(-math.log2(rate)))
    bits = max(64, math.ceil(count * hashes / math.log(2) / 64) * 64)
    if bits > max_bits:
        raise ValueError(f"{bits} filter bits are over max_bits={max_bits}: shorten the list")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), seed, bits, hashes))).alias("at"))
    words = [0] * (bits // 64)
    for row in (
        at.groupBy((F.col("at") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("mask"))
        .collect()
    ):
        words[row.word] = row["mask"]
    return Level(seed, bits, hashes, tuple(words))


def build_cascade(
    listed: DataFrame, corpus_keys: DataFrame, max_bits: int = 1 << 27, max_levels: int = 64
) -> list[Level]:
    """Levels over distinct ``listed`` keys, exact for every key of ``corpus_keys``.

    Two passes over the corpus: an approximate count, which only sizes level 1, and the
    false positives of level 1. Later levels see nothing but those. An empty list gives
    no level, and nothing is then listed.
    """
    members = listed.count()
    if not members:
        return []
    universe = corpus_keys.select(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, members / max(universe, 1))
    levels = [build_level(listed, 1, members, rate, max_bits)]
    passing = corpus_keys.where(levels[0].passes(F.col("key"))).select("key", F.lit(0).alias("listed"))
    # a key of the list must not count as a false positive: its flag outlives the grouping
    false = (
        passing.unionByName(listed.select("key", F.lit(1).alias("listed")))
        .groupBy("key").agg(F.max("listed").alias("listed")).where("listed = 0").select("key")
    )
    inside, outside = listed, pinned(false)
    for _ in range(max_levels):
        count = outside.count()
        if not count:
            return levels
        levels.append(build_level(outside, len(levels) + 1, count, 0.5, max_bits))
        inside, outside = outside, pinned(inside.where(levels[-1].passes(F.col("key"))))
    raise RuntimeError("the cascade does not end: two keys share all their hashes")


def is_listed(levels: list[Level], key: Column) -> Column:
    """Alternate levels: the first one that says no decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels), 0, -1):
        answer = F.when(~levels[depth - 1].passes(key), F.lit(depth % 2 == 0)).otherwise(answer)
    return answer


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) by the text alone; a null or a url without ``://`` has neither."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys a url may be listed under, for the host depths and path lengths in use."""
    keys = []
    for depth, size in sorted({(r.host.count(".") + 1, len(r.path)) for r in rules}):
        suffix = F.substring_index(host, ".", -depth)
        fits = (F.length(path) >= size) & (F.size(F.split(host, r"\.")) >= depth) & (host != "")
        keys.append(F.when(fits, F.concat(suffix, F.substring(path, 1, size))))
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def judge_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow",
    max_bits: int = 1 << 27,
) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    The longest listed key of a url is its rule and decides the verdict (of two keys of
    one length, the later in text order); with none listed the filter's answer stands:
    not blocked, ``default``. Two cascades serve: one tells listed keys from all other
    keys of the corpus, one tells blocked from allowed among the listed ones. A null url
    has an empty host and path and no rule; repeated urls are judged alike; an empty
    table or an empty list of rules needs no filter. Columns of the same names in
    ``pages`` are replaced.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col(url))
    named = pages.withColumns({"host": host, "path": path})
    keys = candidate_keys(F.col("host"), F.col("path"), rules)
    by_action = {a: sorted({r.key for r in rules if r.action == a}) for a in ("block", "allow")}
    both = set(by_action["block"]) & set(by_action["allow"])
    if both:
        raise ValueError(f"both blocked and allowed: {sorted(both)[:3]}")

    def frame(values: list[str]) -> DataFrame:
        # literals of the plan: a frame of Python rows would pass through a Python worker
        return spark.range(1).select(F.explode(F.array(*map(F.lit, values)).cast("array<string>")).alias("key"))

    listed = frame(by_action["block"] + by_action["allow"])
    universe = named.select(F.explode(keys).alias("key"))
    levels = build_cascade(listed, universe, max_bits)
    blocked = build_cascade(frame(by_action["block"]), listed, max_bits)
    longest = F.array_max(
        F.transform(
            F.filter(keys, lambda k: is_listed(levels, k)),
            lambda k: F.struct(F.length(k).alias("size"), k.alias("key")),
        )
    )
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).otherwise(
        F.when(is_listed(blocked, F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    )
    return named.withColumn("rule", longest["key"]).withColumn("verdict", verdict)
