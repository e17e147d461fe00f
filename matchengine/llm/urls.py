"""URL filter: a trie over reversed host labels and path segments.

Every URL walks down the trie once: first over its host labels from the right,
then over its path segments, remembering the last rule that fitted, so the most
specific of the allow and block entries wins.  The plan is map-only.  A trie of at
most ``MAX_RULES`` rules is broadcast; the levels of a larger one are joined
instead: the suffixes of each distinct host to the rules' hosts, then the path's
beginnings of the lengths that such a host has to its rules.  The result is equal.

Defined results: a null URL, or one without ``://``, has the empty host and
path, fits no rule and gets the default verdict.  Of two rules that fit, the
one with more host labels wins, then the one with the longer path, then block.
Repeated rows are judged alike; an empty table gives an empty table; only the
two named input columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 100_000
URL = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
FOLD = {c: c + 32 for c in range(65, 91)}
RESULT = "host string, path string, rule string, verdict string"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass
class _Node:
    down: dict[str, _Node] = field(default_factory=dict)
    #: Rules that end inside the next segment: by length, then by its prefix.
    tails: dict[int, dict[str, UrlRule]] = field(default_factory=dict)
    paths: _Node | None = None


class UrlTrie:
    def __init__(self, rules: list[UrlRule]):
        self.root = _Node()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.down.setdefault(label, _Node())
            node.paths = node.paths or _Node()
            node = node.paths
            *whole, tail = rule.path.split("/")
            for segment in whole:
                node = node.down.setdefault(segment, _Node())
            known = node.tails.setdefault(len(tail), {})
            if tail not in known or rule.verdict == "block":
                known[tail] = rule

    @staticmethod
    def _along(node: _Node, segments: list[str]) -> UrlRule | None:
        best = None
        for segment in segments:
            for size in sorted(node.tails):
                best = node.tails[size].get(segment[:size]) or best if size <= len(segment) else best
            node = node.down.get(segment)
            if node is None:
                break
        return best

    def judge(self, url: str | None) -> tuple[str, str, UrlRule | None]:
        found = URL.search(url) if url else None
        if not found:
            return "", "", None
        host, path = found[1].translate(FOLD), found[2]
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node.down.get(label)
            if node is None:
                break
            if node.paths:
                best = self._along(node.paths, segments) or best
        return host, path, best


def _joined(pages: DataFrame, rules: list[UrlRule], url: str, carry: list[str], default: str) -> DataFrame:
    """The verdicts by joins over the levels of the trie."""
    spark = pages.sparkSession
    known = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rhost string, rpath string, verdict string")
    known = known.groupBy("rhost", "rpath").agg(F.max("verdict").alias("verdict"))
    lengths = known.groupBy("rhost").agg(F.collect_set(F.length("rpath")).alias("sizes"))
    part = lambda k: F.coalesce(F.regexp_extract(F.col(f"`{url}`"), r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    named = pages.select(*[F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(carry)], F.translate(part(1), "".join(map(chr, FOLD)), "".join(map(chr, FOLD.values()))).alias("host"), part(2).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(k.alias("from"), F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("rhost")))
    walked = named.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s.*")
    begun = walked.join(lengths, "rhost").select("host", "path", "from", "rhost", F.explode("sizes").alias("size")).where(F.col("size") <= F.length("path"))
    fits = begun.withColumn("rpath", F.substring("path", F.lit(1), F.col("size"))).join(known, ["rhost", "rpath"])
    best = fits.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rhost", "rpath").alias("rule"), "verdict"), F.struct("from", (-F.col("size")).alias("size"))).alias("best"))
    judged = named.join(best, ["host", "path"], "left")
    return judged.select(*[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)], "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[UrlRule], *, url: str = "url", keep: list[str] | None = None, default: str = "allow") -> DataFrame:
    """``keep`` columns of ``pages`` with host, path, rule and verdict."""
    for rule in rules:
        if rule.verdict not in ("allow", "block"):
            raise ValueError(f"verdict {rule.verdict!r} is neither allow nor block")
    if len(rules) > MAX_RULES:
        return _joined(pages, rules, url, keep or [], default)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(RESULT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = [trie.value.judge(u) for u in urls]
            yield pd.DataFrame({
                "host": [r[0] for r in rows],
                "path": [r[1] for r in rows],
                "rule": pd.Series([r[2].text if r[2] else None for r in rows], dtype=object),
                "verdict": [r[2].verdict if r[2] else default for r in rows],
            })

    columns = [F.col(f"`{c}`") for c in keep or []]
    return pages.select(*columns, judge(F.col(f"`{url}`")).alias("judged")).select(*columns, "judged.*")
