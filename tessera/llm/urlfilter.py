"""Allow and block lists over URLs: a trie of reversed host labels, then path segments."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): the rule fits the host and its subdomains where the url's path starts with the path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: Above this many characters of rules the list is refused: it is broadcast whole.
MAX_RULE_CHARS = 64_000_000

_HOST_END = re.compile("[/?#]")
_PATH_END = re.compile("[?#]")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url; both empty for null or without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = _HOST_END.search(rest)
    cut = end.start() if end else len(rest)
    path = _PATH_END.split(rest[cut:], maxsplit=1)[0]
    return rest[:cut].translate(_LOWER), path


class Trie:
    """Rules by host label from the right, then by path segment.

    A node is a dict of children; ``None`` holds the host's path trie and, in
    path tries, the key ``True`` holds the rule that ends at the node after a
    whole segment, with ``False`` for rules that end inside a segment.
    """

    def __init__(self, rules: tuple[tuple[str, str, str], ...]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(("", segment), {})
            ends = node.setdefault(False, {}) if last else node
            key = last if last else True
            # of an allow and a block entry for the same place, block holds
            if key not in ends or verdict == "block":
                ends[key] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """The fitting rule with the most host labels, then the longest path."""
        node, tries = self.root, []
        for label in reversed(host.split(".")) if host else ():
            node = node.get(label)
            if node is None:
                break
            if None in node:
                tries.append(node[None])
        segments = path.split("/")
        for top in reversed(tries):
            if found := self._longest(top, segments):
                return found
        return None

    @staticmethod
    def _longest(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for depth, segment in enumerate(segments):
            if True in node:
                best = node[True]
            starts = [p for p in node.get(False, ()) if segment.startswith(p)]
            if starts:
                best = node[False][max(starts, key=len)]
            if depth == len(segments) - 1:
                break
            node = node.get(("", segment))
            if node is None:
                break
        return best


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    default: str = "allow",
    url: str = "url",
) -> DataFrame:
    """Add host, path, rule and verdict to every row.

    The rule with the most host labels wins, then the one with the longest
    path; an allow and a block entry for the same place count as block.  Urls
    that no rule fits get ``default`` and a null rule; so do null urls and
    those without ``://``, whose host and path are empty.  Rows keep their
    number and order within a partition: no shuffle, and a host that holds a
    third of the rows costs nothing extra.  The rule list is broadcast; one
    over ``MAX_RULE_CHARS`` is refused.  Input columns called host, path, rule
    or verdict are replaced.
    """
    size = sum(len(h) + len(p) for _, h, p in rules)
    if size > MAX_RULE_CHARS:
        raise ValueError(f"rules hold {size} characters; at most {MAX_RULE_CHARS} are broadcast")
    shared = pages.sparkSession.sparkContext.broadcast(tuple(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(shared.value)
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                verdict, rule = trie.match(host, path) or (default, None)
                rows.append((host, path, rule, verdict))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    added = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in added]
    out = pages.select(*kept, judged(F.col(url)).alias("__judged"))
    return out.select(*kept, *(F.col(f"__judged.{c}").alias(c) for c in added))
