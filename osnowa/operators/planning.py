"""Plans of work: shares over crossed targets, deficits with work in flight, products minus what is done."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(parts: list[dict], n: int, targets: dict[str, dict[str, int]], least: int = 0) -> dict[str, int]:
    """How many of ``n`` go to each part (a dict with 'name' and one category per dimension of ``targets``).

    Every part gets ``least`` (less if they do not fit), then one at a time goes to the part whose categories lack most: first those that lack in
    more of the dimensions in order, then the larger lacks, then the part with fewer, then the earlier. The list of parts is a
    dimension table, so this runs on the driver; a step costs as much as there are parts.
    """
    if not parts:
        return {}
    least = min(least, n // len(parts))
    counts = {p["name"]: least for p in parts}
    have = {d: Counter() for d in targets}
    for p in parts:
        for d in targets:
            have[d][p[d]] += least
    for _ in range(n - least * len(parts)):
        def lack(p: dict) -> list[int]:
            return [targets[d].get(p[d], 0) - have[d][p[d]] for d in targets]

        best = max(range(len(parts)), key=lambda i: ([int(x > 0) for x in lack(parts[i])], lack(parts[i]), -counts[parts[i]["name"]], -i))
        counts[parts[best]["name"]] += 1
        for d in targets:
            have[d][parts[best][d]] += 1
    return counts


def deficits(targets: DataFrame, key: str, wanted: str, done: DataFrame, in_flight: DataFrame | None = None) -> DataFrame:
    """(key, wanted, have, lack): what is wanted less what is done and, if given, what is under way; keys without a target are left
    out, nothing lacks less than 0."""
    have = done.select(key) if in_flight is None else done.select(key).unionByName(in_flight.select(key))
    counted = have.groupBy(key).agg(F.count(F.lit(1)).alias("have"))
    joined = targets.select(key, wanted).join(counted, key, "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return joined.select(key, F.col(wanted).alias("wanted"), "have", F.greatest(F.col(wanted) - F.col("have"), F.lit(0)).alias("lack"))


def most_lacking(lacks: DataFrame, key: str, k: int) -> DataFrame:
    """(key, lack, rank) of the ``k`` keys that lack most, the first by name of equals; none that lacks nothing."""
    top = lacks.where("lack > 0").orderBy(F.col("lack").desc(), key).limit(k)
    return top.select(key, "lack", F.row_number().over(Window.orderBy(F.col("lack").desc(), F.col(key))).alias("rank"))


def work_list(dims: list[DataFrame], done: DataFrame | None = None) -> DataFrame:
    """All combinations of the rows of small dimension tables that are not done yet."""
    out = dims[0]
    for d in dims[1:]:
        out = out.crossJoin(d)
    return out if done is None else out.join(done.select(*out.columns).distinct(), out.columns, "left_anti")


def jobs(lacks: DataFrame, lack: Column, size: int) -> DataFrame:
    """Every row once for each job of ``size`` it needs, numbered from 1 in ``job``; rows that lack nothing give none."""
    return lacks.withColumn("_jobs", F.ceil(lack / size).cast("int")).where("_jobs > 0").withColumn("job", F.explode(F.sequence(F.lit(1), "_jobs"))).drop("_jobs")
