"""URL allow and block rules in a trie over reversed host labels, then path segments.

The trie is built on the driver from the rule list (at most ``MAX_RULES``, the proven
bound of what is broadcast) and walked once per URL: down the host from its last label,
at each label down the path. The longest rule that fits wins; of an allow and a block
entry with the same text the block entry wins.
"""
from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

MAX_RULES = 1_000_000
_TO_LOWER = str.maketrans(UPPER, LOWER)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    if slash < 0:
        return rest.translate(_TO_LOWER), ""
    return rest[:slash].translate(_TO_LOWER), rest[slash:]


class RuleTrie:
    """host label (reversed) → … → path segment → … ; a rule ends in the start of a segment."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        n = 0
        for verdict, rule in rules:
            n += 1
            if n > MAX_RULES:
                raise ValueError(f"over {MAX_RULES} rules: split the list by top-level domain")
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            host, slash, path = rule.partition("/")
            host = host.translate(_TO_LOWER)
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, start = path.split("/") if slash else [None]
            node = node.setdefault("/", {"any": {}, "to": {}})
            if start is None:  # no path: every path fits, the empty one too
                entries, key = node["any"], ""
            else:
                for segment in whole:
                    node = node["to"].setdefault(segment, {"any": {}, "to": {}})
                entries, key = node.setdefault("starts", {}), start
            if entries.get(key, ("", "allow"))[1] == "allow":
                entries[key] = (host + slash + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best = None
        node, segments = self.root, path[1:].split("/") if path[:1] == "/" else None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            here = node.get("/")
            if here is None:
                continue
            found = list(here["any"].values())
            for segment in segments or ():
                for start, entry in here.get("starts", {}).items():
                    if segment.startswith(start):
                        found.append(entry)
                here = here["to"].get(segment)
                if here is None:
                    break
            for entry in found:
                if best is None or len(entry[0]) > len(best[0]):
                    best = entry
        return best


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str]], id_col: str = "page_id",
               url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (null when none fits), verdict.

    A null url, or one without ``://``, has an empty host and path and gets ``default``,
    as has a url that no rule fits. Only the id and url columns are read; no shuffle.
    """
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("host string, path string, rule string, verdict string")
    def judge(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for url in urls:
            host, path = split_url(url)
            rule, verdict = trie.value.match(host, path) or (None, default)
            rows.append((host, path, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    return (df.select(F.col(f"`{id_col}`").alias("page_id"), judge(F.col(f"`{url_col}`")).alias("j"))
            .select("page_id", "j.host", "j.path", "j.rule", "j.verdict"))
