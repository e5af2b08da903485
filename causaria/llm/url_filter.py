"""URL filters by a Bloom filter cascade.

Level 0 is a Bloom filter of the listed keys. Over the complete universe of
keys, some that aren't listed pass it by mistake: level 1 encodes those, level
2 the listed keys that level 1 holds by mistake, and so on, until a level makes
no mistake. A key of the universe is listed exactly if the first level that
doesn't hold it has an odd number. Membership thus needs no join: a first
cascade knows the listed names among all domains, a second one the hosts that
are in such a domain among all hosts.

The universe is dealt into shards by hash, and each shard builds a cascade of
its own in one task: one shuffle of distinct keys, whatever the levels.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, staged

#: Keys that one shard's task builds its cascade from, about.
SHARD_KEYS = 250_000
#: False positives of each level; lower first, as level 0 faces the whole universe.
FIRST_RATE, NEXT_RATE = 0.01, 0.5
#: Bytes of filters that may be broadcast; beyond it, keys meet their shard's filter by a cogroup.
BROADCAST_BYTES = 32_000_000
MAX_LEVELS = 64

#: The production rules: (verdict, host, path). The longest that fits decides.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The production list, as far as it is kept here: these names at these domains. A host is listed if it, or a domain it is in, is.
LISTED_NAMES = ("spam-farm", "cheap-pills", "casino-win", "free-money")
LISTED_AT = ("example.com", "example.net", "example.org", "net", "com")
#: Rows that meet one shard's filter in one task, about, where filters aren't broadcast.
SHARD_ROWS = 200_000


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; '' where url is null or has no ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as text, verdict) of the longest rule that fits; nulls where none does. Equal lengths: the first in order."""
    name = verdict = None
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith("." + h)) & path_.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(v)) if verdict is None else verdict.when(fits, F.lit(v))
    return name, verdict


def fingerprints(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, worked out in the JVM; together they stand for the key."""
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit("b"))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Bloom:
    def __init__(self, level: int, hashes: int, bits: np.ndarray):
        self.level, self.hashes, self.bits = level, hashes, bits

    def _at(self, a: np.ndarray, b: np.ndarray):
        m, one, two = np.uint64(len(self.bits) * 8), _mix(a, 2 * self.level + 1), _mix(b, 2 * self.level + 2) | np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(self.hashes):
                yield (one + np.uint64(k) * two) % m

    @classmethod
    def of(cls, level: int, rate: float, a: np.ndarray, b: np.ndarray) -> Bloom:
        bits = max(8, int(np.ceil(-len(a) * np.log(rate) / np.log(2) ** 2 / 8)))
        out = cls(level, max(1, round(-np.log2(rate))), np.zeros(bits, np.uint8))
        for at in out._at(a, b):
            np.bitwise_or.at(out.bits, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8))
        return out

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in self._at(a, b):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


class Cascade:
    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> Cascade:
        inside, outside = (a[listed], b[listed]), (a[~listed], b[~listed])
        levels: list[Bloom] = []
        while len(inside[0]):
            if len(levels) >= MAX_LEVELS:
                raise ValueError("two keys of the universe have the same fingerprints: the list can't be encoded")
            f = Bloom.of(len(levels), FIRST_RATE if not levels else NEXT_RATE, *inside)
            levels.append(f)
            wrong = f.holds(*outside)
            inside, outside = (outside[0][wrong], outside[1][wrong]), inside
        return cls(levels)

    def listed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(a), bool), np.arange(len(a))
        for f in self.levels:
            held = f.holds(a[open_], b[open_])
            out[open_[~held]] = f.level % 2 == 1
            open_ = open_[held]
        out[open_] = len(self.levels) % 2 == 1
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<II", f.hashes, len(f.bits)) + f.bits.tobytes() for f in self.levels)

    @classmethod
    def load(cls, data: bytes) -> Cascade:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for k in range(n):
            hashes, size = struct.unpack_from("<II", data, at)
            levels.append(Bloom(k, hashes, np.frombuffer(data, np.uint8, size, at + 8)))
            at += 8 + size
        return cls(levels)


def _build(pdf):
    import pandas as pd

    f = Cascade.build(pdf["a"].to_numpy().view(np.uint64), pdf["b"].to_numpy().view(np.uint64), pdf["listed"].to_numpy())
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [f.dump()]})


def build(universe: DataFrame) -> tuple[DataFrame, int]:
    """(key string, listed boolean), all keys there are -> (shard, filter) rows, and the number of shards.

    A key given more than once is listed if any row says so; null keys and
    flags are left out. An empty universe gives no filters.
    """
    a, b = fingerprints(F.col("key"))
    keys = staged(universe.where("key IS NOT NULL AND listed IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")).select(a.alias("a"), b.alias("b"), "listed"))
    shards = max(1, -(-keys.count() // SHARD_KEYS))
    return staged(keys.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(_build, "shard int, filter binary")), shards


def _look_up(filters, shards: int):
    def run(batches):
        import pyarrow as pa

        cascades = {s: Cascade.load(data) for s, data in filters.value.items()}
        for batch in batches:
            a, b = (batch.column(batch.num_columns - 2 + i).to_numpy(zero_copy_only=False) for i in (0, 1))
            at, found = a % shards, np.zeros(len(a), bool)
            for s in np.unique(at):
                if int(s) in cascades:
                    own = at == s
                    found[own] = cascades[int(s)].listed(a[own].view(np.uint64), b[own].view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(found)], [*batch.schema.names[:-2], "listed"])

    return run


def _look_up_shard(left, right):
    import pandas as pd

    found = Cascade.load(right["filter"].iloc[0]).listed(left["a"].to_numpy().view(np.uint64), left["b"].to_numpy().view(np.uint64)) if len(right) and len(left) else np.zeros(len(left), bool)
    return pd.concat([left.drop(columns=["shard", "salt", "a", "b"]), pd.Series(found, index=left.index, name="listed")], axis=1)


def member(df: DataFrame, key: Column, filters: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """df with a column listed: whether the row's key (one of the universe's) is listed.

    The filters are broadcast if their measured size allows it. Beyond that,
    rows and filters meet by shard, each shard's rows dealt to as many tasks as
    the fullest shard needs at shard_rows a task: a hot key is spread over them.
    """
    a, b = fingerprints(key)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "listed boolean"])
    keyed = df.select("*", a.alias("a"), b.alias("b"))
    if (filters.agg(F.sum(F.length("filter"))).first()[0] or 0) <= broadcast_bytes:
        sent = df.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in filters.collect()})
        return keyed.mapInArrow(_look_up(sent, shards), schema)
    keyed = keyed.withColumn("shard", F.pmod("a", F.lit(shards)).cast("int"))
    fullest = keyed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    salts = max(1, -(-fullest // shard_rows))
    keyed = keyed.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    dealt = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.groupBy("shard", "salt").cogroup(dealt.groupBy("shard", "salt")).applyInPandas(_look_up_shard, schema)


def domains(names=LISTED_NAMES, at=LISTED_AT) -> list[str]:
    """Each name at each domain."""
    return [f"{n}.{d}" for n in names for d in at]


def within(host_: Column, longest: int) -> Column:
    """The host, if it has at most so many characters, and the domains it is in that do: a host's end is looked at, however long it is."""
    end = F.right(host_, F.lit(longest + 1))
    dots = F.filter(F.sequence(F.lit(1), F.length(end)), lambda i: F.substring(end, i, F.lit(1)) == ".")
    above = F.transform(dots, lambda i: F.substring(end, i + 1, F.length(end)))
    return F.when(F.length(host_) == 0, F.array().cast("array<string>")).when(F.length(host_) <= longest, F.array_append(above, host_)).otherwise(above)


def flagged(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) for each host: whether it, or a domain it is in, is among listed's keys.

    By a cascade of its own, without a join: its level 0 holds the listed
    names, its universe is they and all domains that hosts are in. A domain
    longer than the longest listed name can't be listed and isn't made.
    """
    known = listed.select(F.col(listed.columns[0]).cast("string").alias("key")).where("key <> ''")
    longest = known.agg(F.max(F.length("key"))).first()[0] or 0
    hosts = staged(hosts.where("key IS NOT NULL").select("key"))
    inside = hosts.select("key", F.explode(within(F.col("key"), longest)).alias("domain"))
    names = inside.select(F.col("domain").alias("key"), F.lit(False).alias("listed")).unionByName(known.withColumn("listed", F.lit(True)))
    found = member(inside, F.col("domain"), *build(names)).select("key", "listed")
    return found.unionByName(hosts.withColumn("listed", F.lit(False))).groupBy("key").agg(F.max("listed").alias("listed"))


def judge(pages: DataFrame, rules=RULES, listed: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed for every row of pages.

    verdict is the longest fitting rule's; where none fits, block if the host
    is listed, by the cascade over all hosts of pages, and else allow. listed
    is a table of any size whose first column has host names in lower case; a
    host is listed if it or a domain it is in is there (the production list if
    None); nulls, empty and repeated names count for nothing. A null url, or
    one without ://, has empty host and path, no rule, and is allowed.
    Repeated rows repeat; an empty table gives none; other columns are not read.
    """
    if listed is None:
        listed = pages.sparkSession.createDataFrame([(x,) for x in domains()], "key string")
    h, p = host(F.col("url")), path(F.col("url"))
    rows = only(pages, "page_id", "url").select("page_id", h.alias("host"), p.alias("path"))
    filters, shards = build(flagged(rows.select(F.col("host").alias("key")).distinct(), listed))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    found = member(rows, F.col("host"), filters, shards)
    return found.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
