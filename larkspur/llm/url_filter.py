"""Allow and block lists for urls: a trie over reversed host labels, then path segments; the longest match decides."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

#: Rules that a broadcast trie may hold (under 500 MB of a worker's memory); longer lists are joined by key instead.
MAX_TRIE_RULES = 1_000_000
#: The key under which a host's node holds its paths: no label of a host, empty ones included, equals it.
PATHS = ("paths",)
#: What a url gets that no rule fits.
DEFAULT = "allow"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (ASCII lower case) and path; both empty for null and for a url without '://'."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((k for c in "?#" if (k := rest.find(c)) >= 0), default=len(rest))
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if not host.isascii() else host.lower()
    return lower, rest[:stop]


class Trie:
    """Nodes are dicts: host labels from the right, then path segments from the left under the key PATHS.

    A rule's path that does not end in '/' may end inside a segment; its rest is kept at the node above it.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root: dict = {}
        for r in sorted(rules, key=lambda r: (r.host, r.path, r.verdict != "block")):
            node = self.root
            for label in reversed(r.host.split(".")) if r.host else ():
                node = node.setdefault(label, {})
            node = node.setdefault(PATHS, {})
            *whole, rest = r.path.split("/")
            for seg in whole:
                node = node.setdefault(seg, {})
            # a null key: rules that end here, by what is left of their path; block wins over allow of the same place
            node.setdefault(None, {}).setdefault(rest, r)

    def find(self, host: str, path: str) -> Rule | None:
        """The longest rule: the one with most of the host, among those the one with most of the path."""
        best, node = None, self.root
        segments = path.split("/")
        labels = host.split(".") if host else []
        for k in range(len(labels) + 1):
            if under := node.get(PATHS):
                best = self._path(under, segments) or best
            if k == len(labels) or (node := node.get(labels[-1 - k])) is None:
                break
        return best

    @staticmethod
    def _path(node: dict, segments: list[str]) -> Rule | None:
        best = None
        for k, seg in enumerate(segments):
            if ends := node.get(None):
                fits = [rest for rest in ends if "/".join(segments[k:]).startswith(rest)]
                if fits:
                    best = ends[max(fits, key=len)]
            if k == len(segments) - 1 or (node := node.get(seg)) is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """(key, host, path, rule, verdict), one row per input row.

    Null or unparsable urls have an empty host and path and get the default verdict unless a rule without host and path
    exists.  The trie is broadcast up to MAX_TRIE_RULES; longer lists go to filter_urls_joined(), which gives the same rows.
    Repeated rows and repeated keys give rows of their own, an empty table gives none, and other columns, whatever their
    names, aren't read.
    """
    if len(rules) > MAX_TRIE_RULES:
        spark = pages.sparkSession
        return filter_urls_joined(pages, spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string"), url, key, default)
    ship(pages.sparkSession)
    kind = dict(pages.dtypes)[key]
    held = pages.sparkSession.sparkContext.broadcast([Rule(*r) for r in rules])
    made: list[Trie] = []

    def judge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Trie(held.value))
        find = made[0].find
        for b in it:
            parts = [url_parts(u) for u in b.column(1).to_pylist()]
            found = [find(h, p) for h, p in parts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([r and r.name for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())], ["key", "host", "path", "rule", "verdict"])

    return pages.select(F.col(key), F.col(url)).mapInArrow(judge, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


def filter_urls_joined(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = DEFAULT) -> DataFrame:
    """The same for lists of any length: distinct hosts and paths meet the rules in a join.

    A rule is keyed by its host and its path up to the last '/'.  Each distinct (host, path) asks for the suffixes of its host
    and the prefixes of its path that end there, and learns how long the rules of that place are; then it asks for its own
    prefixes of those lengths, and the longest that exists is kept.  So many rules of one place cost a url their different
    lengths at most.  Hot hosts are asked for once.
    """
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    parts = pages.select(F.col(key), rest.alias("r")).select(
        key,
        F.translate(F.regexp_extract("r", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("r", r"^[^/?#]*(/[^?#]*)?", 1).alias("path"),
    )
    asked = parts.select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    hosts = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")), F.array(F.lit("")))
    paths = F.concat(F.array(F.lit("")), F.filter(F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.when(k < F.size(segments), F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/")))), lambda x: x.isNotNull()))
    keys = asked.withColumn("rh", F.explode(F.array_distinct(hosts))).withColumn("rp", F.explode(F.array_distinct(paths)))
    stem = F.regexp_extract("path", r"(?s)^(.*/)?", 1)
    # of rules for the same place, block wins
    known = rules.groupBy("host", "path").agg(F.max("verdict").alias("v")).select(F.col("host").alias("rh"), stem.alias("rp"), F.col("path").alias("rule_path"), "v")
    lengths = known.groupBy("rh", "rp").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    tried = keys.join(lengths, ["rh", "rp"]).withColumn("n", F.explode("lengths")).where(F.length("path") >= F.col("n"))
    fit = tried.withColumn("rule_path", F.substring("path", F.lit(1), F.col("n"))).join(known.drop("rp"), ["rh", "rule_path"])
    best = fit.groupBy("host", "path").agg(F.max(F.struct(F.when(F.col("rh") == "", 0).otherwise(F.size(F.split("rh", r"\."))).alias("a"), F.length("rule_path").alias("b"), "rh", "rule_path", "v")).alias("m"))
    return parts.join(best, ["host", "path"], "left").select(key, "host", "path", F.concat("m.rh", "m.rule_path").alias("rule"), F.coalesce("m.v", F.lit(default)).alias("verdict"))
