"""Sources mixed to target weights by balanced sampling.

Every source gets the same multiple of its target: the largest total that no source's repeat limit forbids. A record of a
source is used floor(f) times and once more with probability f - floor(f), where f is the source's factor. Which records get the
extra use is drawn by the cube method: probabilities move within the null space of the constraints (number of records and number
of tokens) until they are 0 or 1. The flight runs in shards; each leaves at most two records undecided, whose probabilities
go on to a second flight per source, and what that leaves, two records at most, is a landing problem solved outright: of the
draws that keep both probabilities the one that keeps the number of records best.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .sketch import few

#: Records of a shard, about.
SHARD_ROWS = 50_000
_EPS = 1e-9


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all but at most two are 0 or 1, their sum and the token total are what they were."""
    p = p.astype(np.float64).copy()
    t = tokens.astype(np.float64)
    open_ = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    rng.shuffle(open_)
    open_.sort(key=lambda i: t[i])  # large ones first, from the end: what is left to landing is small
    draws = rng.random(len(open_) + 8)
    held: list[int] = []
    n = 0
    while open_ or len(held) == 3:
        while open_ and len(held) < 3:
            held.append(open_.pop())
        if len(held) < 3:
            break
        a, b, c = held
        u = (t[c] - t[b], t[a] - t[c], t[b] - t[a])
        if abs(u[0]) + abs(u[1]) + abs(u[2]) < _EPS:
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(held, u) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(held, u) if x)
        step = up if draws[n % len(draws)] * (up + down) < down else -down
        n += 1
        for i, x in zip(held, u):
            p[i] += step * x
        held = [i for i in held if _EPS < p[i] < 1 - _EPS]
    p[p <= _EPS] = 0.0
    p[p >= 1 - _EPS] = 1.0
    return p


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for the two records at most that a flight leaves open: each is drawn with its probability, and of all such draws the
    one whose number of records stays next to the sum of the probabilities."""
    out = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 1:
        out[open_[0]] = float(rng.random() < p[open_[0]])
    elif len(open_) == 2:
        a, b = open_
        x, both = rng.random(), max(p[a] + p[b] - 1, 0.0)
        out[a] = float(x < p[a])
        out[b] = float(x < both or p[a] <= x < p[a] + p[b] - both)
    return out


def _seed(*parts) -> np.random.Generator:
    import xxhash

    return np.random.default_rng(xxhash.xxh64_intdigest("|".join(map(str, parts))))


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 5, total: float | None = None, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Sample (id, source, tokens, copies >= 1) of ``sizes`` (id, tokens, source), and a report.

    ``targets``: source, share of the total size in tokens, max_repeats. Report: source, share, reached (share of the drawn
    tokens), tokens, records, available (tokens), factor, repeats (most uses of a record), short (target tokens that the repeat
    limit leaves unmet; 0 unless ``total`` asks for more than the limits allow). Sources without a target, null sources, and
    records of 0 tokens are not drawn. A target source without records is reported with 0 and does not bound the total.
    """
    spark = sizes.sparkSession
    targets = few(targets.select("source", "share", "max_repeats"))
    goal = {r["source"]: r for r in targets.where("source IS NOT NULL AND share > 0").collect()}
    slim = cut(sizes.where("tokens > 0 AND source IS NOT NULL").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi").select("id", "source", "tokens"))
    held = {r["source"]: (r["n"], r["t"]) for r in slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).collect()}
    weight = sum(float(g["share"]) for s, g in goal.items() if s in held) or 1.0
    share = {s: float(g["share"]) / weight for s, g in goal.items() if s in held}
    most = min((held[s][1] * max(int(goal[s]["max_repeats"] or 1), 0) / share[s] for s in share), default=0.0)
    size = most if total is None else total
    factor = {s: min(size * share[s] / held[s][1], float(goal[s]["max_repeats"] or 1)) for s in share}
    table = spark.createDataFrame(
        [(s, float(np.floor(f + _EPS)), float(max(f - np.floor(f + _EPS), 0.0)), max(1, -(-held[s][0] // shard_rows))) for s, f in factor.items()],
        "source string, base double, extra double, shards bigint",
    )
    units = slim.join(F.broadcast(table), "source").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")))
    kind = slim.schema["id"].dataType.simpleString()
    shape = f"id {kind}, source string, tokens bigint, base double, p double"

    def first(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        p = flight(pdf["extra"].to_numpy(), pdf["tokens"].to_numpy(), _seed(seed, *key))
        return pdf[["id", "source", "tokens", "base"]].assign(p=p)

    def last(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
        rng = _seed(seed, "landing", *key)
        p = flight(pdf["p"].to_numpy(), pdf["tokens"].to_numpy(), rng)
        p = landing(p, rng)
        return pdf[["id", "source", "tokens", "base"]].assign(p=p)

    flown = cut(units.groupBy("source", "shard").applyInPandas(first, shape))
    landed = flown.where("p > 0 AND p < 1").groupBy("source").applyInPandas(last, shape)
    drawn = cut(
        flown.where("p = 0 OR p = 1").union(landed)
        .select("id", "source", "tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0")
    )
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("repeats"))
    plan = spark.createDataFrame(
        [(s, float(g["share"]), held.get(s, (0, 0))[1], factor.get(s, 0.0), max(0.0, size * share.get(s, 0.0) - factor.get(s, 0.0) * held.get(s, (0, 0))[1])) for s, g in goal.items()],
        "source string, share double, available bigint, factor double, short double",
    )
    every = drawn.agg(F.sum(F.col("tokens") * F.col("copies")).alias("every"))
    report = plan.join(got, "source", "left").crossJoin(every).select(
        "source", "share", F.coalesce(F.col("tokens") / F.col("every"), F.lit(0.0)).alias("reached"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("records", F.lit(0)).alias("records"), "available", "factor", F.coalesce("repeats", F.lit(0)).alias("repeats"), "short",
    )
    return drawn, report
