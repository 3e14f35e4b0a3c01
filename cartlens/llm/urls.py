"""URL rules by a cascade of Bloom filters: exact membership of keys without a join.

A key is a host suffix with a path prefix that ends in a slash (`example.net/en/`), or a bare host suffix. The key
universe is every key that some URL of the corpus yields. Level 0 of a cascade holds the listed keys of the universe;
level 1 holds the unlisted keys that level 0 lets through; level 2 the listed ones that level 1 lets through, and so on
until a level lets nothing wrong through. A key of the universe is listed if the first level that denies it has an odd
number, or if none denies it and the number of levels is odd. So every answer for these URLs is exact, whatever the
filters' error rates. Levels are built by DataFrame aggregation from tables that Spark holds; only filter bits reach
the driver and the executors, and a cascade beyond MAX_FILTER_BYTES is refused.

Null URLs and URLs without `://` have an empty host and path, fit no rule and get the default verdict.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.arrays import mix, with_columns
from cartlens.llm.frames import schema_with, set_aside
from cartlens.session import stage

#: Bits per key of level 0 and of the later levels.
FIRST_BITS = 16
LATER_BITS = 4
MAX_LEVELS = 64
MAX_FILTER_BYTES = 64 << 20


@dataclass
class Level:
    bits: np.ndarray
    n_bits: int
    n_hashes: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for p in probes(hashes, self.n_bits, self.n_hashes):
            out &= (self.bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


@dataclass
class Cascade:
    levels: list[Level] = field(default_factory=list)

    def lists(self, hashes: np.ndarray) -> np.ndarray:
        """Whether keys of the universe are listed, from their 64-bit hashes."""
        out = np.full(len(hashes), len(self.levels) % 2 == 1)
        undecided = np.arange(len(hashes))
        for i, level in enumerate(self.levels):
            passes = level.has(mix(hashes[undecided] + np.uint64(i)))
            out[undecided[~passes]] = i % 2 == 1
            undecided = undecided[passes]
        return out


def probes(hashes: np.ndarray, n_bits: int, n_hashes: int) -> Iterator[np.ndarray]:
    step = mix(hashes) | np.uint64(1)
    for i in range(n_hashes):
        yield (hashes + np.uint64(i) * step) % np.uint64(n_bits)


def build_level(keys: DataFrame, number: int) -> Level | None:
    """The filter of a set of distinct key hashes (column h), or None when it is empty."""
    n = keys.count()
    if n == 0:
        return None
    per_key = FIRST_BITS if number == 0 else LATER_BITS
    n_bits = 64 * math.ceil(max(64, n * per_key) / 64)
    n_hashes = max(1, round(per_key * math.log(2)))
    if n_bits // 8 > MAX_FILTER_BYTES:
        raise ValueError(f"{n} keys need a filter of {n_bits // 8} bytes; the bound is {MAX_FILTER_BYTES}")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix(batch.column("h").to_numpy().view(np.uint64) + np.uint64(number))
            at = np.concatenate(list(probes(h, n_bits, n_hashes)))
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))],
                ["word", "bit"],
            )

    rows = keys.mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Level(bits, n_bits, n_hashes)


def build_cascade(universe: DataFrame, listed: DataFrame) -> Cascade:
    """universe, listed: distinct key hashes (column h), listed a part of the universe."""
    wanted, other = listed, universe.join(listed, "h", "left_anti")
    cascade = Cascade()
    for number in range(MAX_LEVELS):
        level = build_level(wanted, number)
        if level is None:
            return cascade
        cascade.levels.append(level)

        def passing(batches: Iterator[pa.RecordBatch], level=level, number=number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column("h").to_numpy()
                yield batch.filter(pa.array(level.has(mix(h.view(np.uint64) + np.uint64(number)))))

        wanted, other = stage(other.mapInArrow(passing, "h long"), "url-level"), wanted
    raise ValueError(f"the cascade did not end within {MAX_LEVELS} levels; two keys share a hash")


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#`, with A-Z in lower case."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?` or `#`."""
    rest = _rest(url)
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    behind = F.substr(rest, F.length(host) + 1)
    return F.coalesce(F.substring_index(F.substring_index(behind, "?", 1), "#", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def keys_of(host: Column, path: Column, depth: int) -> Column:
    """All keys of a URL: each host suffix bare, and with each path prefix of up to `depth` slashes."""
    labels = F.split(host, "[.]", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    slashes = F.least(F.lit(depth), F.size(F.split(path, "/", -1)) - 1)
    heads = F.transform(
        F.sequence(F.lit(1), slashes), lambda i: F.concat(F.array_join(F.slice(F.split(path, "/", -1), F.lit(1), i), "/"), F.lit("/"))
    )
    heads = F.when(F.startswith(path, F.lit("/")) & (slashes > 0), heads).otherwise(F.array().cast("array<string>"))
    ends = F.concat(F.array(F.lit("")), heads)
    return F.when(host != "", F.flatten(F.transform(suffixes, lambda s: F.transform(ends, lambda e: F.concat(s, e))))).otherwise(
        F.array().cast("array<string>")
    )


def judge(
    pages: DataFrame,
    rules: dict[str, str],
    blocked_hosts: list[str],
    default: str = "allow",
    url_col: str = "url",
) -> DataFrame:
    """Add host, path, rule and verdict.

    rules: key with a path to verdict; of the rules that fit a URL the longest wins and gives the verdict. blocked_hosts:
    bare hosts whose URLs, subdomains included, are blocked where no rule fits.
    """
    spark = pages.sparkSession
    pages, restore = set_aside(pages, "_keys", "_hashes")
    if any("/" not in r or not r.endswith("/") for r in rules):
        raise ValueError("a rule is a host and a path that ends in a slash")
    depth = max([1, *(r.count("/") for r in rules)])
    parted = pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))})
    keyed = parted.withColumn("_keys", keys_of(F.col("host"), F.col("path"), depth))
    universe = stage(keyed.select(F.explode("_keys").alias("k")).distinct().select(F.xxhash64("k").alias("h")).distinct(), "url-keys")
    lists = {**{v: [r for r in rules if rules[r] == v] for v in sorted(set(rules.values()))}, "hosts": blocked_hosts}
    cascades = {}
    for name, keys in lists.items():
        listed = spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k").alias("h")).distinct()
        cascades[name] = build_cascade(universe, universe.join(listed, "h", "left_semi"))
    verdicts = sorted(set(rules.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column("_keys"), batch.column("_hashes")
            flat = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            texts = keys.flatten()
            row = np.repeat(np.arange(len(batch)), np.asarray(keys.value_lengths().fill_null(0)))
            rule: list[str | None] = [None] * len(batch)
            verdict = [default] * len(batch)
            for at in np.flatnonzero(cascades["hosts"].lists(flat)):
                verdict[row[at]] = "block"
            length = [-1] * len(batch)
            for name in verdicts:
                for at in np.flatnonzero(cascades[name].lists(flat)):
                    key, i = texts[int(at)].as_py(), row[at]
                    if len(key) > length[i]:
                        rule[i], verdict[i], length[i] = key, name, len(key)
            yield with_columns(batch, {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())})

    hashed = keyed.withColumn("_hashes", F.transform("_keys", lambda k: F.xxhash64(k)))
    out = schema_with(hashed, [("rule", T.StringType()), ("verdict", T.StringType())])
    return restore(hashed.mapInArrow(run, out).drop("_keys", "_hashes"))
