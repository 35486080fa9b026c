"""Sizes in tokens, and fixed-capacity containers filled with documents of balanced cost."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sketch import few

#: Where the vocabulary files of public tokenizers are; a parameter of every function that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary's texts are cut into pieces before merging.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Tokens of a shard, about: what one task packs.
SHARD_TOKENS = 2_000_000
#: Cost of a document of n tokens: LINEAR * n + n * n / QUADRATIC_SPAN, the share of attention growing with its length.
LINEAR, QUADRATIC_SPAN = 1.0, 2048.0
#: About the longest run of characters given to the tokenizer at once.
RUN = 100_000

_loaded: dict = {}


def encoding(folder: str = TOKENIZERS, name: str = VOCABULARY):
    """The byte-level BPE encoding of a vocabulary file, loaded once per process."""
    import tiktoken

    path = os.path.join(folder, name)
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


#: Between two signs that are no white space a single blank always begins a piece: a cut before it changes no piece.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def _runs(text: str) -> list[str]:
    """A long text in runs of about RUN characters whose token counts add up to the whole text's; where no safe cut follows, the
    rest is one run."""
    out, i = [], 0
    while len(text) - i > RUN:
        cut_ = _SAFE.search(text, i + RUN // 2)
        if cut_ is None:
            break
        out.append(text[i : cut_.start()])
        i = cut_.start()
    return [*out, text[i:]]


def token_counts(docs: DataFrame, id_column: str, text: str = "text", keep: tuple[str, ...] = (), folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """(id, tokens, *keep): sizes of whole texts; null and empty texts have 0 tokens."""
    kept = [F.col(id_column).alias("id"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text")]
    slim = docs.select(*kept)
    fields = [f for f in slim.schema.fields if f.name != "text"]
    from pyspark.sql.types import LongType, StructField, StructType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(r)) for r in _runs(t)) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b[f.name] for f in fields], pa.array(n, pa.int64())], [*[f.name for f in fields], "tokens"])

    out = slim.mapInArrow(count, StructType([*fields, StructField("tokens", LongType())]))
    return out.select("id", "tokens", *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)])


def cost(n: np.ndarray) -> np.ndarray:
    return LINEAR * n + n.astype(np.float64) ** 2 / QUADRATIC_SPAN


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each size (none above capacity): descending sizes, each to the cheapest container with room.

    As many containers as the sum needs at least are open from the start; one is added when a size fits in none. Ties go to
    the first. Sizes must be positive.
    """
    order = np.argsort(-sizes, kind="stable")
    k = max(1, int(-(-sizes.sum() // capacity))) if len(sizes) else 0
    room = np.full(len(sizes) + k, capacity, dtype=np.int64)
    spent = np.zeros(len(sizes) + k)
    out = np.empty(len(sizes), dtype=np.int64)
    price = cost(sizes)
    for i in order:
        fits = np.where(room[:k] >= sizes[i], spent[:k], np.inf)
        j = int(fits.argmin()) if k else 0
        if not k or fits[j] == np.inf:
            j, k = k, k + 1
        out[i] = j
        room[j] -= sizes[i]
        spent[j] += price[i]
    return out


def pack(sizes: DataFrame, capacities: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(size_name, container, id, part, tokens): every document of ``sizes`` (id, tokens) in a container of each capacity
    of ``capacities`` (size_name, capacity).

    A document is cut only if it is longer than the capacity: into full pieces, each a container of its own, and a last piece
    that is packed like any other (part counts from 0). Documents of 0 or null tokens are in no container. Containers hold at
    most the capacity. The work is sharded by a hash of the document, so no task holds more than about ``shard_tokens``;
    every shard leaves at most a few containers partly empty. Capacities that are null or below 1 are left out.
    """
    slim = cut(sizes.where("tokens > 0").select("id", "tokens"))
    total = slim.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, -(-int(total) // shard_tokens))
    caps = F.broadcast(few(capacities.where("capacity >= 1 AND size_name IS NOT NULL").select("size_name", F.col("capacity").cast("bigint").alias("capacity")).distinct()))
    each = slim.crossJoin(caps)  # a handful of capacities
    full = F.floor(F.col("tokens") / F.col("capacity")).cast("bigint")
    whole = (
        each.where("tokens >= capacity").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)))
        .select("size_name", F.concat_ws("-", F.lit("full"), "id", "part").alias("container"), "id", F.col("part").cast("int").alias("part"), F.col("capacity").alias("tokens"))
    )
    rest = each.select(
        "size_name", "capacity", "id", full.cast("int").alias("part"), F.pmod("tokens", "capacity").alias("tokens"),
        F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"),
    ).where("tokens > 0")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "part"], kind="stable")
        at = assign(pdf["tokens"].to_numpy(), int(pdf["capacity"].iloc[0]))
        shard = int(pdf["shard"].iloc[0])
        return pd.DataFrame({
            "size_name": pdf["size_name"], "container": [f"{shard}-{c}" for c in at], "id": pdf["id"], "part": pdf["part"], "tokens": pdf["tokens"],
        })

    kind = slim.schema["id"].dataType.simpleString()
    packed = rest.groupBy("size_name", "shard").applyInPandas(fill, f"size_name string, container string, id {kind}, part int, tokens bigint")
    return whole.union(packed)


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per capacity: containers, pieces, tokens, the share of room left free, and the spread of cost over the fuller containers."""
    price = F.lit(LINEAR) * F.col("tokens") + F.col("tokens") * F.col("tokens") / F.lit(QUADRATIC_SPAN)
    each = packed.groupBy("size_name", "container").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.sum(price).alias("cost")
    )
    caps = few(capacities.select("size_name", F.col("capacity").cast("bigint").alias("capacity")).distinct())
    return (
        each.join(F.broadcast(caps), "size_name").groupBy("size_name", "capacity")
        .agg(
            F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"),
            F.round(1 - F.sum("tokens") / (F.count(F.lit(1)) * F.first("capacity")), 6).alias("free_share"),
            F.max("tokens").alias("fullest"), F.round(F.stddev_pop("cost") / F.avg("cost"), 4).alias("cost_spread"),
        )
    )
