"""Similarity joins over sets of hashed n-grams, exact, without a nested loop.

Postings are pruned by the prefix filter: a pair of similarity above t shares one of the rarest size - ceil(t size) + 1 elements
of each set. What the postings leave (see :mod:`.postings`) is verified on the sets themselves. Sets are never written out: they
are computed for the frequencies, for the postings, and for the rows of candidate pairs. Blocks, where given, are hashed into
the elements.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .postings import candidates_in_parts, verified


def gram_sets(df: DataFrame, row: str, grams: Column, block: list[str] | None = None) -> DataFrame:
    """(row, block columns, grams as sorted hashes); a row without grams has an empty or null array."""
    hashed = F.sort_array(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))))
    return df.select(F.col(row).alias("row"), *(block or []), hashed.alias("grams"))


def jaccard_pairs(sets: DataFrame, threshold: float, block: list[str] | None = None, strict: bool = True, other: DataFrame | None = None, common: int = 1) -> DataFrame:
    """(a, b, shared, similarity) of pairs of rows with similarity above (or, if not strict, at least) the threshold.

    Within one table a < b; with ``other``, a comes from ``sets`` and b from ``other``. Rows are numbered by whole numbers. Rows
    without grams are in no pair, nor are rows with a null in a block column. ``common`` is the least number of grams to share.
    """
    block = block or []
    hashed = F.xxhash64(*block) if block else F.lit(0).cast("bigint")

    def side(s: DataFrame, i: int) -> DataFrame:
        if s.schema["row"].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
            raise ValueError("rows are numbered by whole numbers")
        s = s.dropna(subset=["row", *block])
        return s.select(F.col("row").cast("bigint").alias("row"), F.lit(i).alias("side"), hashed.alias("block"), "grams")

    every = side(sets, 0) if other is None else side(sets, 0).union(side(other, 1))
    near, parts, freq = candidates_in_parts(every, threshold, other is not None, common=common)
    near = cut(near)
    few = side(sets.where(_in(near, ["a", "b"] if other is None else ["a"])("row")), 0)
    few = few if other is None else few.union(side(other.where(_in(near, ["b"])("row")), 1))
    scored = verified(near, few, other is not None, parts, freq).where(F.col("shared") >= common)
    scored = scored.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity"))
    return scored.where(F.col("similarity") > threshold if strict else F.col("similarity") >= threshold)


def with_sets(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the grams of both rows as ga and gb; of other rows no grams are computed, or next to none."""

    either = _in(pairs, ["a", "b"]) if left is right else None
    wanted = {c: either or _in(pairs, [c]) for c in ("a", "b")}

    def pick(s: DataFrame, c: str) -> DataFrame:
        return s.where(wanted[c]("row")).select(F.col("row").alias(c), F.col("grams").alias(f"g{c}"))

    return pairs.join(pick(left, "a"), "a").join(pick(right, "b"), "b")


def _in(df: DataFrame, columns: list[str], bits: int = 24):
    """A filter column function: True for every value of the columns and, by a bit set of fixed size, for few others."""
    bucket = lambda c: F.shiftrightunsigned(F.xxhash64(F.col(c).cast("bigint")), 64 - bits)
    at = df.select(F.explode(F.array(*map(bucket, columns))).alias("x")).select((F.col("x") + 1).alias("x"))
    rows = at.groupBy(F.expr("bitmap_bucket_number(x)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("m")).collect()
    held = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in rows:
        held[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["m"], dtype=np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def check(x: pd.Series) -> pd.Series:
        at = x.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: check(bucket(c))


def drop_common(sets: DataFrame, share: float) -> DataFrame:
    """Sets without the elements that more than ``share`` of the rows hold."""
    sets = cut(sets.where("size(grams) > 0"))
    total = sets.count()
    hot = sets.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > share * total).select("g")
    exploded = sets.drop("grams").join(sets.select("row", F.explode("grams").alias("g")).join(hot, "g", "left_anti"), "row")
    keys = [c for c in sets.columns if c != "grams"]
    return cut(exploded.groupBy(*keys).agg(F.array_sort(F.collect_list("g")).alias("grams")))


def key_overlap(left: DataFrame, lrow: str, lkeys: Column, right: DataFrame, rrow: str, rkeys: Column) -> DataFrame:
    """(a, b) of rows that share any key."""
    a = left.select(F.col(lrow).alias("a"), F.explode(lkeys).alias("k"))
    b = right.select(F.col(rrow).alias("b"), F.explode(rkeys).alias("k"))
    return a.join(b, "k").where("k IS NOT NULL").select("a", "b").distinct()


def literal_leak(source: Column, answer: Column, least_source: int = 12, least_chunk: int = 12, n: int = 6, least_run: int = 25) -> Column:
    """Whether a line or sentence of the answer, or a run of n of its words, stands literally in the source."""
    from ..functions.text import norm_text, squeeze, words

    src = norm_text(source)
    chunks = F.filter(F.transform(F.split(answer, r"\n|(?<=[.!?]) "), lambda c: norm_text(c)), lambda c: F.length(c) >= least_chunk)
    w = words(norm_text(answer), r"[^ ]+")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    long = F.filter(runs, lambda r: F.length(r) >= least_run)
    hit = F.exists(chunks, lambda c: F.contains(src, c)) | (F.exists(long, lambda r: F.contains(src, r)) & (F.size(w) >= n))
    del squeeze
    return F.coalesce(hit & (F.length(src) >= least_source), F.lit(False))


def shared_run(left: DataFrame, lrow: str, ltext: Column, right: DataFrame, rrow: str, rtext: Column, n: int = 6) -> DataFrame:
    """(a, b, runs): pairs of texts that share runs of n words; each side's runs are hashed and joined."""
    from ..functions.text import word_ngrams

    a = gram_sets(left, lrow, word_ngrams(ltext, n)).select(F.col("row").alias("a"), F.explode("grams").alias("g"))
    b = gram_sets(right, rrow, word_ngrams(rtext, n)).select(F.col("row").alias("b"), F.explode("grams").alias("g"))
    return a.join(b, "g").groupBy("a", "b").agg(F.count(F.lit(1)).alias("runs"))


def stem_share(answer_stems: Column, source_stems: Column) -> Column:
    """Share of the answer's stems, repeated ones too, that the source has; 0 for an answer without stems."""
    known = F.size(F.filter(answer_stems, lambda x: F.array_contains(source_stems, x)))
    return F.when(F.size(answer_stems) > 0, known / F.size(answer_stems)).otherwise(0.0)
