"""URL rules by a cascade of Bloom filters, with DataFrame functions only.

The listed keys are rules (host and path, such as example.net/en/). The universe is the set of keys that the corpus's URLs can
match: for each URL the suffixes of its host that have a listed number of labels, with the prefixes of its path that have a listed length. Level 1 of the
cascade encodes the listed keys that occur in the universe; level 2 the unlisted keys of the universe that level 1 lets through;
level 3 the listed keys that level 2 lets through, and so on until a level lets nothing wrong through. A key of the
universe is listed exactly if the first level that refuses it has an even number, so membership is exact and judging a URL needs no
join: a level is one binary literal inside the expression. Each verdict has a cascade of its own, so a rule's verdict is a question of membership, too.

Scale: the universe is one distinct aggregation (hot hosts collapse before the shuffle); each further level only looks at the false
positives of the one before, a fraction that FALSE_RATE sets. What goes to the driver and into the plan is the filters' bits, which
the number of listed keys bounds, checked against MAX_BITS. A longer list is cut into shards, each with its own cascade. Building a cascade
compares the universe with the list, which is broadcast up to BROADCAST_KEYS keys.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages

FALSE_RATE = 0.01
#: The most bits of a filter; a longer list takes several cascades.
MAX_BITS = 1 << 22
BROADCAST_KEYS = 1_000_000
#: The production rules: (key, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def url_host(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; empty without ://."""
    at = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end to the next of ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every rule key that can fit: host suffixes of the listed numbers of labels, with path prefixes of the listed lengths."""
    own = F.length(host) - F.length(F.replace(host, F.lit("."))) + 1
    listed = lambda numbers, most: F.filter(F.array(*(F.lit(n) for n in numbers)), lambda n: n <= most)
    hosts = F.transform(listed(labels, own), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    prefixes = F.transform(listed(lengths, F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


class Filter:
    """One Bloom filter: the bits of a key are those of one 64-bit hash for each probe."""

    def __init__(self, keys: DataFrame, count: int, level: int):
        bits = max(64, 1 << math.ceil(math.log2(max(1, count) * -math.log(FALSE_RATE) / math.log(2) ** 2)))
        self.bits, self.probes, self.level = bits, max(1, round(bits / max(1, count) * math.log(2))), level
        self.probes = min(self.probes, 16)
        at = keys.select(F.explode(F.array(*self._places(F.col("key")))).alias("at"))
        words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v"))
        table = {r["w"]: r["v"] for r in words.collect()}  # at most bits / 64 rows
        words = (table.get(i, 0) for i in range(bits // 64))
        self.bytes = b"".join(w.to_bytes(8, "little", signed=True) for w in words)

    def _places(self, key: Column) -> list[Column]:
        return [F.shiftrightunsigned(F.xxhash64(key, F.lit(self.level), F.lit(i)), 1) % self.bits for i in range(self.probes)]

    def holds(self, key: Column) -> Column:
        byte = lambda at: F.conv(F.hex(F.substring(F.lit(self.bytes), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        bit = lambda at: F.getbit(byte(at), at.bitwiseAND(F.lit(7)).cast("int")) == 1
        return reduce(lambda a, b: a & b, (bit(at) for at in self._places(key)))


class Cascade:
    """Exact membership of the universe's keys in a list, as an expression."""

    def __init__(self, spark: SparkSession, universe: DataFrame, listed: list[str]):
        """universe: a staged table with the distinct column key."""
        self.levels: list[Filter] = []
        wanted = spark.createDataFrame([(k,) for k in listed], "key string")
        wanted = F.broadcast(wanted) if len(listed) <= BROADCAST_KEYS else wanted
        inside = universe.join(wanted, "key", "left_semi").select("key")
        # The list is driver-side configuration, so its members in the universe are bounded by it.
        inside = spark.createDataFrame(inside.collect(), "key string")
        outside = universe.join(wanted, "key", "left_anti").select("key")
        while count := inside.count():
            level = Filter(inside, count, len(self.levels) + 1)
            self.levels.append(level)
            inside, outside = outside.where(level.holds(F.col("key"))), inside
            if len(self.levels) > 60:
                raise RuntimeError("two keys of the universe share all hashes")

    def holds(self, key: Column) -> Column:
        """True for a listed key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules=RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.

    A rule fits its host and all subdomains where the path starts with the rule's path; the longest rule that fits decides, else
    rule is null and verdict is default. A null URL, or one without ://, has an empty host and path, which no rule fits. Repeated rows stay,
    other columns are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    verdicts = {f"{k.partition('/')[0]}\n/{k.partition('/')[2]}": v for k, v in rules}
    labels = sorted({k.partition("\n")[0].count(".") + 1 for k in verdicts})
    lengths = sorted({len(k.partition("\n")[2]) for k in verdicts})
    url = F.col(url_col).cast("string")
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), labels, lengths)
    stages = Stages(spark)
    short = parts.select("host", F.substring("path", 1, max(lengths)).alias("path")).distinct()
    universe = stages.keep(short.select(F.explode(keys).alias("key")).distinct(), "universe")
    per_shard = max(1, int(MAX_BITS * math.log(2) ** 2 / -math.log(FALSE_RATE) / 2))
    cascades: dict[str, list[Cascade]] = {}
    for verdict in sorted(set(verdicts.values())):
        names = sorted(k for k, v in verdicts.items() if v == verdict)
        cascades[verdict] = [Cascade(spark, universe, names[i : i + per_shard]) for i in range(0, len(names), per_shard)]
    stages.clear()
    rule_of = lambda k: F.coalesce(*(F.when(c.holds(k), F.lit(v)) for v, some in cascades.items() for c in some))
    known = F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), rule_of(k).alias("verdict")))
    judged = parts.withColumn("found", F.array_max(F.filter(known, lambda x: x["verdict"].isNotNull())))
    rule = F.replace(F.col("found.key"), F.lit("\n"), F.lit(""))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
