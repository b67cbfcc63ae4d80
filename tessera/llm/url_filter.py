"""URL rules by a sort-merge range join.

A host's labels in reverse, each followed by a full stop, are its key, so that a host and all
its subdomains share a prefix and a rule's host becomes an interval of keys. Pages are
range-partitioned and sorted by key; a sweep over the sorted keys opens a rule's interval when
it begins and closes it when a key leaves it. Open intervals nest, so they form a stack of
active rules; a page is tested for the path prefixes of those on the stack only.

A rule is (host, path, verdict). It fits its host and all subdomains if the url's path starts
with its path. Of several that fit, the longest host and path together wins, then the longer
host; of rules equal in both, allow wins. Rules are sent to all tasks in blocks of at most
BLOCK rules; the best of each block goes on to the next.

Null urls and urls without `://` have an empty host and path; no rule fits an empty host.
Repeated rows are judged alike. A host and path that very many rows share are spread over
partitions by page_id, which is part of the range key.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import common as C

BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCKED = "allow", "block"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: str) -> str:
    """The labels in reverse; an empty host has the empty key."""
    return "".join(f"{x}." for x in reversed(host.split("."))) if host else ""


class Sweep:
    """Rules in key order and the stack of those whose interval holds the present key."""

    def __init__(self, rules: list[Rule]) -> None:
        by: dict[str, dict[str, str]] = {}
        for r in rules:
            if r.host:
                own = by.setdefault(key_of(r.host.translate(str.maketrans(UPPER, LOWER))), {})
                own[r.path] = ALLOW if ALLOW in (r.verdict, own.get(r.path)) else r.verdict
        #: Of each key, the paths, longest first.
        self.rules = [(k, sorted(p.items(), key=lambda x: (-len(x[0]), x[0]))) for k, p in sorted(by.items(), key=lambda x: x[0].encode())]
        self.keys = [k.encode() for k, _ in self.rules]
        self.start()

    def start(self) -> None:
        self.at, self.stack, self.last = 0, [], b""

    def to(self, key: str) -> None:
        """Move on to key; keys must ascend."""
        k = key.encode()
        if k < self.last:
            self.start()
        self.last = k
        while self.stack and not k.startswith(self.stack[-1][0]):
            self.stack.pop()
        while self.at < len(self.keys) and self.keys[self.at] <= k:
            if k.startswith(self.keys[self.at]):
                while self.stack and not self.keys[self.at].startswith(self.stack[-1][0]):
                    self.stack.pop()
                self.stack.append((self.keys[self.at], *self.rules[self.at]))
            self.at += 1

    def best(self, path: str) -> tuple[int, int, str, str] | None:
        """(length, host length, rule, verdict) of the winner for the present key."""
        out = None
        for raw, key, paths in self.stack:
            for p, verdict in paths:
                if path.startswith(p):
                    host = ".".join(reversed(key[:-1].split(".")))
                    found = (len(host) + len(p), len(host), host + p, verdict)
                    out = found if out is None or found[:2] > out[:2] else out
                    break
        return out


def judged(pages: DataFrame, rules: list[Rule], default: str = ALLOW, most: int = BLOCK) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url)."""
    spark = pages.sparkSession
    C.small_batches(spark)
    url = F.col("url").cast("string")
    out = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    labels = F.reverse(F.split("host", r"\.", -1))
    key = F.when(F.col("host") == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "."), F.lit(".")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = out.withColumn("key", key).repartitionByRange(n, "key", "path", "page_id").sortWithinPartitions("key", "path", "page_id")
    out = out.withColumns({"rank": F.lit(-1), "near": F.lit(-1), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    shape = ", ".join(f"`{c}` {t}" for c, t in out.dtypes)
    for a in range(0, max(len(rules), 1), most):
        block = rules[a : a + most]

        def run(batches: Iterator[pa.RecordBatch], block: list[Rule] = block) -> Iterator[pa.RecordBatch]:
            sweep = Sweep(block)
            for b in batches:
                got = {c: b.column(c).to_pylist() for c in ("key", "path", "rank", "near", "rule", "verdict")}
                for i, (k, p) in enumerate(zip(got["key"], got["path"], strict=True)):
                    sweep.to(k)
                    best = sweep.best(p)
                    if best and (best[:2] > (got["rank"][i], got["near"][i]) or best[:2] == (got["rank"][i], got["near"][i]) and best[3] == ALLOW):
                        got["rank"][i], got["near"][i], got["rule"][i], got["verdict"][i] = best
                cols = [pa.array(got[c], f.type) if c in got else b.column(c) for c, f in zip(b.schema.names, b.schema, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

        out = out.mapInArrow(run, shape)
    return out.select("page_id", "host", "path", "rule", "verdict")
