"""URL filter: a trie over reversed host labels, then path segments, sent to all tasks.

A rule such as ``example.org/en/1`` holds for its host and every subdomain and for
paths that start with its path. Of the rules that fit, the one with the most host
labels wins, then the one with the longest path; an allow rule and a block rule
compete on equal terms. Where none fits, ``default`` decides.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, written

_END_OF_HOST = re.compile(r"[/?#]")
_END_OF_PATH = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for urls without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = _END_OF_HOST.split(rest, maxsplit=1)[0]
    return ascii_lower(host), _END_OF_PATH.split(rest[len(host) :], maxsplit=1)[0]


class _PathNode:
    __slots__ = ("ends", "longest", "next")

    def __init__(self):
        self.next: dict[str, _PathNode] = {}  # by whole segment
        self.ends: dict[str, tuple[str, str, tuple[int, int]]] = {}  # rules whose last segment is such a start of the url's
        self.longest = 0


class _HostNode:
    __slots__ = ("next", "paths")

    def __init__(self):
        self.next: dict[str, _HostNode] = {}
        self.paths: _PathNode | None = None


class UrlTrie:
    """rules: (verdict, host, path). The same host and path given twice: the last one counts."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = _HostNode()
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"verdict {verdict!r} is neither allow nor block")
            node = self.root
            for label in reversed(ascii_lower(host).split(".")):
                node = node.next.setdefault(label, _HostNode())
            node.paths = at = node.paths or _PathNode()
            *whole, last = path.split("/")
            for segment in whole:
                at = at.next.setdefault(segment, _PathNode())
            at.ends[last] = (host + path, verdict, (host.count(".") + 1, len(path)))
            at.longest = max(at.longest, len(last))

    @staticmethod
    def _in_path(at: _PathNode | None, segments: list[str]) -> tuple[str, str, tuple[int, int]] | None:
        best = None
        for segment in segments:
            if at is None:
                break
            for n in range(min(len(segment), at.longest), -1, -1):
                if (hit := at.ends.get(segment[:n])) is not None:
                    best = hit  # a deeper segment means a longer path
                    break
            at = at.next.get(segment)
        return best

    def match(self, host: str, path: str) -> tuple[str, str, tuple[int, int]] | None:
        """(rule, verdict, (its host labels, its path's length)) of the longest rule that fits, or None."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.next.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._in_path(node.paths, segments) or best
        return best


def rule_blocks(rules: Iterable[tuple[str, str, str]], most: int) -> Iterator[list[tuple[str, str, str]]]:
    """Rules in their order, in blocks of at most so many bytes of Python strings, or of one rule."""
    block, size = [], 0
    for rule in rules:
        own = sum(sys.getsizeof(x) for x in rule)
        if block and size + own > most:
            yield block
            block, size = [], 0
        block.append(rule)
        size += own
    yield block


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_rule_bytes: int = 64_000_000,
) -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule (null where none fits), verdict.

    Rules are broadcast in blocks of at most ``max_rule_bytes``. One block is one pass over the urls;
    with more, each pass keeps the longest rule so far, and its result is written, so that a task
    holds one block's trie at a time. Of a host and path given twice the last verdict counts.

    Null and malformed urls have an empty host and path and so the default verdict; very long
    ones are judged whole. Without rules the default decides. Empty tables give no rows; other
    columns are ignored, whatever their names; repeated rows are judged each.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType.simpleString()
    best = "rule string, verdict string, labels int, length int"
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in best.split(", ")))

    def keep_longest(sent):
        def run(batches):
            trie = UrlTrie(sent.value)
            for batch in batches:
                out = []
                for url, *so_far in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                    hit = trie.match(*split_url(url))
                    # of equal rules, the later one
                    longer = hit is not None and (so_far[0] is None or hit[2] >= tuple(so_far[2:]))
                    out.append((*hit[:2], *hit[2]) if longer else so_far)
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], ["id", "url", "rule", "verdict", "labels", "length"])

        return run

    def finish(batches):
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            verdicts = batch.column(3).fill_null(default)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([p[k] for p in parts], pa.string()) for k in (0, 1)), batch.column(2), verdicts], [id_col, "host", "path", "rule", "verdict"])

    blocks = rule_blocks(rules, max_rule_bytes)
    block, before = next(blocks), None
    while (following := next(blocks, None)) is not None:
        rows = written(rows.mapInArrow(keep_longest(spark.sparkContext.broadcast(block)), f"id {kind}, url string, {best}"), "urls")
        if before is not None:
            discard(before)
        block, before = following, rows
    last = keep_longest(spark.sparkContext.broadcast(block))
    return rows.mapInArrow(lambda batches: finish(last(batches)), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
