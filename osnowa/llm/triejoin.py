"""Strings within one edit of each other (insertion, deletion, replacement, swap of neighbours), by a sharded trie join.

Two strings one edit apart share either what stands before the middle or what stands behind it. Every string goes into the
shards of both parts; a shard's strings form a trie, which is traversed for each of them by a Levenshtein automaton.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sketch import rows_by_key

_END = ""


def build(strings: list[str]) -> dict:
    """A trie of nested dicts; a string ends where the empty key holds it."""
    root: dict = {}
    for s in strings:
        node = root
        for c in s:
            node = node.setdefault(c, {})
        node[_END] = s
    return root


def within(trie: dict, s: str, most: int = 1) -> set[str]:
    """The trie's strings within ``most`` edits of ``s``: the automaton's states are (node, characters read, edits left)."""
    out: set[str] = set()
    n = len(s)

    def run(node: dict, i: int, left: int) -> None:
        while True:
            if left:
                for c, child in node.items():
                    if c == _END:
                        continue
                    run(child, i, left - 1)  # a character more
                    if i < n and c != s[i]:
                        run(child, i + 1, left - 1)  # another character
                        if i + 1 < n and c == s[i + 1] and s[i] in child:
                            run(child[s[i]], i + 2, left - 1)  # two swapped
                if i < n:
                    run(node, i + 1, left - 1)  # a character less
            if i == n:
                if _END in node:
                    out.add(node[_END])
                return
            if s[i] not in node:
                return
            node, i = node[s[i]], i + 1

    run(trie, 0, most)
    return out


def near_strings(strings: DataFrame, column: str, recorded: str | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of distinct values of ``column`` one edit apart. Nulls and empty values take part in none.

    With ``recorded``, a boolean column, only pairs that hold a recorded value: only those form the tries, all are looked up.
    """
    s = F.col("s")
    n = F.length(s)

    def shard(length, tag: int):
        half = F.floor(length / 2).cast("int")
        before = F.concat_ws("\u0001", F.lit(f"p{tag}"), length, F.substring(s, F.lit(1), F.greatest(half - 1, F.lit(0))))
        behind = F.concat_ws("\u0001", F.lit(f"s{tag}"), length, F.expr("right(s, 0)") if tag < 0 else F.substring(s, n - (length - half) + 1, length - half))
        return [before, behind]

    flag = F.col(recorded) if recorded else F.lit(True)
    distinct = strings.select(F.col(column).alias("s"), flag.alias("r")).where(n > 0).groupBy("s").agg(F.max("r").alias("r"))
    # as the shorter (or equal) string of a pair, and as the longer one
    keys = [*shard(n, 0), *[F.when(n > 1, k) for k in shard(n - 1, 0)]]
    shards = distinct.select("s", "r", F.explode(F.array(*keys)).alias("k")).where("k IS NOT NULL").select("s", "r", F.xxhash64("k").alias("key"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in rows_by_key(batches, "key"):
            keys, names, base = g["key"].to_numpy(), g["s"].to_pylist(), g["r"].to_numpy(zero_copy_only=False)
            pairs: set[tuple[str, str]] = set()
            i = 0
            while i < len(names):
                j = i + 1
                while j < len(names) and keys[j] == keys[i]:
                    j += 1
                if j - i > 1 and base[i:j].any():
                    trie = build([names[k] for k in range(i, j) if base[k]])
                    for x in names[i:j]:
                        pairs.update((min(x, y), max(x, y)) for y in within(trie, x) if x != y)
                i = j
            if pairs:
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in pairs]), "b": pa.array([b for _, b in pairs])})

    return shards.repartition("key").sortWithinPartitions("key").select("key", "s", "r").mapInArrow(join, "a string, b string").distinct()
