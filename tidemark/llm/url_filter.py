"""URL filter: a trie over reversed host labels and path segments, broadcast, longest match first.

Results for unusual input: a null url, or one without ``://``, has an empty host and path and so
fits no rule; an empty table gives an empty table; repeated rows are judged alike; columns of the
input that are called like a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower

#: Rules up to this many are broadcast as a trie (about 200 bytes each); more are joined by host.
BROADCAST_RULES = 200_000

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    """Fits ``host`` and all its subdomains where the path starts with ``path`` (empty: any path)."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


class _Node:
    """A host label or path segment. ``paths`` hangs the path trie below a host; ``ends`` maps the
    last, possibly partial segment of a rule to that rule."""

    __slots__ = ("children", "ends", "paths", "whole")

    def __init__(self):
        self.children: dict[str, _Node] = {}
        self.ends: dict[str, Rule] = {}
        self.paths: _Node | None = None
        self.whole: Rule | None = None


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root = _Node()
        for rule in rules:
            self._add(rule)

    def _add(self, rule: Rule) -> None:
        node = self.root
        for label in reversed(rule.host.split(".")):
            node = node.children.setdefault(label, _Node())
        if not rule.path:
            node.whole = self._stronger(node.whole, rule)
        elif rule.path.startswith("/"):
            node.paths = step = node.paths or _Node()
            *inner, last = rule.path[1:].split("/")
            for segment in inner:
                step = step.children.setdefault(segment, _Node())
            step.ends[last] = self._stronger(step.ends.get(last), rule)

    @staticmethod
    def _stronger(old: Rule | None, new: Rule) -> Rule:
        """Of two entries for the same host and path, the blocking one."""
        return new if old is None or new.verdict == BLOCK else old

    def match(self, host: str, path: str) -> Rule | None:
        """The rule with the most host labels that fits, and of those the one with the longest path."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.children.get(label)
            if node is None:
                break
            found = self._deepest(node, path) or found
        return found

    @staticmethod
    def _deepest(node: _Node, path: str) -> Rule | None:
        found, step = node.whole, node.paths
        if step is None or not path.startswith("/"):
            return found
        for segment in path[1:].split("/"):
            if step.ends:
                fits = [rule for end, rule in step.ends.items() if segment.startswith(end)] if len(step.ends) <= len(segment) else [step.ends[segment[:n]] for n in range(len(segment) + 1) if segment[:n] in step.ends]
                found = max(fits, key=lambda rule: len(rule.path), default=found)
            step = step.children.get(segment)
            if step is None:
                break
        return found


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``; a url without ``://`` has neither."""
    after = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.coalesce(ascii_lower(F.regexp_extract(after, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return pages.withColumns({"host": host, "path": path})


def filter_urls(pages: DataFrame, rules: list[Rule], url: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the winning rule, or null) and verdict.

    A page that no rule fits gets ``default``. Every row is judged on its own, so there is no shuffle.
    """
    out = with_host_and_path(pages, url)
    if len(rules) > BROADCAST_RULES:
        return _by_join(out, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        found = [match(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [r and r.name for r in found], "verdict": [r.verdict if r else default for r in found]}, dtype=object)

    kept = [c for c in out.columns if c.lower() not in ("rule", "verdict")]
    return out.select(*(F.col(f"`{c}`") for c in kept), judge("host", "path").alias("__judged")).select(*(F.col(f"`{c}`") for c in kept), "__judged.rule", "__judged.verdict")


def _by_join(pages: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    """The same verdicts for rule lists too long to broadcast: each url's host suffixes are joined with the rules."""
    spark = pages.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "r_host string, r_path string, r_verdict string")
    kept = [c for c in pages.columns if c.lower() not in ("rule", "verdict")]
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = pages.select("host", "path").distinct()
    best = F.max(F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.col("r_verdict").alias("verdict"), F.concat("r_host", "r_path").alias("rule")))
    judged = (
        urls.withColumn("r_host", F.explode(suffixes))
        .join(table, "r_host")
        .where(F.expr("startswith(path, r_path)"))
        .groupBy("host", "path").agg(best.alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return pages.select(*(F.col(f"`{c}`") for c in kept)).join(judged, ["host", "path"], "left").select(*(F.col(f"`{c}`") for c in kept), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
