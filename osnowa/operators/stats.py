"""Resampling: draws are hashes of (seed, repetition, row), so results repeat and need no generator state.

A row's weight in a repetition is a Poisson number of mean 1, as in the usual bootstrap of large tables: every batch adds up its
own weighted sums for all repetitions, and only these sums are shuffled, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import mix64
from .windows import nth_percentile

#: Probabilities that a Poisson number of mean 1 is at most 0, 1, 2, ...
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate(([1.0], np.arange(1.0, 20.0)))))
#: Weights drawn at a time, per batch.
_CELLS = 1 << 20


def _weighted_sums(items: DataFrame, value: str, stratum: str | None, reps: int, seed: int) -> DataFrame:
    """(stratum, rep, s, w): sums of weighted values and of weights; repeated rows are weighed apart."""
    rows = items.where(F.col(value).isNotNull()).groupBy(
        F.xxhash64(F.lit(seed), *items.columns).alias("h"), (F.col(stratum).cast("string") if stratum else F.lit("")).alias("g"), F.col(value).cast("double").alias("v")
    ).agg(F.count(F.lit(1)).alias("c"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1), "c"))).select("g", "v", F.xxhash64("h", "i").alias("h"))
    salts = mix64(np.arange(1, reps + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, v = b["h"].to_numpy().view(np.uint64), b["v"].to_numpy()
            names, code = np.unique(np.array(b["g"].to_pylist(), dtype=object).astype(str), return_inverse=True) if stratum else (np.array([""]), np.zeros(len(h), dtype=np.int64))
            s, w = np.zeros((len(names), reps)), np.zeros((len(names), reps))
            step = max(1, _CELLS // max(reps, 1))
            for i in range(0, len(h), step):
                x = mix64(h[i : i + step, None] ^ salts[None, :])
                n = np.searchsorted(_POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right").astype(float)
                np.add.at(w, code[i : i + step], n)
                np.add.at(s, code[i : i + step], n * v[i : i + step, None])
            at = np.repeat(np.arange(len(names)), reps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at].tolist(), pa.string()), pa.array(np.tile(np.arange(reps), len(names)).astype(np.int32)), pa.array(s.ravel()), pa.array(w.ravel())], ["g", "rep", "s", "w"]
            )

    return rows.mapInArrow(draw, "g string, rep int, s double, w double").groupBy("g", "rep").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def bootstrap_mean(items: DataFrame, value: str, reps: int, seed: int = 3) -> DataFrame:
    """(n, mean, low, high): mean of the items and the 2.5 and 97.5 % order statistics of resampled means. Null values do not
    count; no items give n 0 and nulls."""
    means = _weighted_sums(items, value, None, reps, seed).where("w > 0").agg(F.collect_list(F.col("s") / F.col("w")).alias("ms"))
    known = items.agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return known.crossJoin(means).select(  # one row each
        "n", "mean", F.when(F.size("ms") > 0, nth_percentile(F.col("ms"), 0.025)).alias("low"), F.when(F.size("ms") > 0, nth_percentile(F.col("ms"), 0.975)).alias("high")
    )


def paired_bootstrap(before: DataFrame, after: DataFrame, key: list[str], value: str, reps: int = 2000, seed: int = 3) -> DataFrame:
    """(n, mean, low, high) of the differences of items that both have."""
    b, a = before.select(*key, F.col(value).alias("_b")), after.select(*key, F.col(value).alias("_a"))
    return bootstrap_mean(b.join(a, key).select(*key, (F.col("_a") - F.col("_b")).cast("double").alias("d")), "d", reps, seed)


def stratified_bootstrap(items: DataFrame, stratum: str, value: str, reps: int, seed: int = 3) -> DataFrame:
    """(reps, mean, low, high) of the sum over strata of resampled stratum means times their sizes."""
    sizes = items.where(F.col(value).isNotNull()).groupBy(F.col(stratum).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    sums = _weighted_sums(items, value, stratum, reps, seed).where("w > 0").join(sizes, "g").groupBy("rep").agg(F.sum(F.col("s") / F.col("w") * F.col("n")).alias("x"))
    got = sums.agg(F.collect_list("x").alias("xs"), F.avg("x").alias("mean"), F.count(F.lit(1)).alias("reps"))
    return got.select("reps", "mean", nth_percentile(F.col("xs"), 0.025).alias("low"), nth_percentile(F.col("xs"), 0.975).alias("high"))


def vote_simulation(samples: DataFrame, item: str, right: str, k: int, reps: int, seed: int = 3) -> DataFrame:
    """(item, single, voted): share right of one sample, and of a majority of ``k`` drawn without replacement (ties count half)."""
    pools = samples.groupBy(item).agg(F.sort_array(F.collect_list(F.col(right).cast("int"))).alias("xs")).where(F.size("xs") >= k)
    runs = pools.crossJoin(samples.sparkSession.range(reps).withColumnRenamed("id", "rep"))
    mixed = F.array_sort(F.transform("xs", lambda x, i: F.struct(F.xxhash64(F.lit(seed), F.col("rep"), F.col(item), i).alias("h"), x.alias("x"))))
    won = F.aggregate(F.slice(mixed, 1, k), F.lit(0), lambda a, s: a + s.getField("x"))
    vote = F.when(won * 2 > k, 1.0).when(won * 2 == k, 0.5).otherwise(0.0)
    return runs.groupBy(item).agg(
        F.round(F.avg(F.aggregate("xs", F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size("xs"))), 6).alias("single"), F.round(F.avg(vote), 6).alias("voted")
    )
