"""Ordered operators: first of a key, running totals, chunks, apportionment, votes.

Totals over a whole table in order are computed in two steps, so no task holds the table: rows are range-partitioned by the
order, partition sums (one number per partition) give each partition its start, a window within the partition does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def first_of(df: DataFrame, key: list[str] | list[Column], order: list, name: str = "_rn") -> DataFrame:
    """The first row of each key in order; a null key is a key like any other. Ties are decided by the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) == 1).drop(name)


def top_k(df: DataFrame, key: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def in_order(df: DataFrame, order: list[str], value: Column | None = None, position: str = "position", before: str = "before") -> DataFrame:
    """``df`` with each row's position (from 1) and the sum of ``value`` over all rows before it, in a total order.

    ``order`` must be unique together. Null values count as 0.
    """
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()).withColumn("_v", F.coalesce(value, F.lit(0)) if value is not None else F.lit(0)))
    sums = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.sum("_v").alias("s")).orderBy("_p").collect()
    starts, n, s = [], 0, 0
    for r in sums:  # one row per partition
        starts.append((r["_p"], n, s))
        n, s = n + r["n"], s + r["s"]
    fractional = ranged.schema["_v"].dataType.simpleString() in ("double", "float")
    rows = [(p, n, float(s) if fractional else int(s)) for p, n, s in starts or [(0, 0, 0)]]
    at = spark.createDataFrame(rows, f"_p int, _n bigint, _s {'double' if fractional else 'bigint'}")
    w = Window.partitionBy("_p").orderBy(*order)
    inside = F.coalesce(F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        ranged.join(F.broadcast(at), "_p").withColumn(position, F.row_number().over(w) + F.col("_n")).withColumn(before, inside + F.col("_s"))
        .drop("_p", "_n", "_s", "_v")
    )


def ranked(df: DataFrame, by: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """``df`` with each row's rank (from 1) in its group and the group's size; no task holds a group.

    ``order`` must be unique within a group. Rows are range-partitioned by group and order, ranked within each part, and moved up
    by the sizes of the group's earlier parts. A null group is a group like any other.
    """
    parted = cut(df.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_p", F.spark_partition_id()))
    counts = parted.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    at = counts.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_q"), F.sum("_n").over(group).alias(size),
        F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"),
    )
    same = F.col("_p") == F.col("_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    inside = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order))
    return parted.withColumn("_r", inside).join(at, same).withColumn(rank, F.col("_r") + F.col("_b")).drop("_p", "_q", "_r", "_b", *[f"_k{i}" for i in range(len(by))])


def within_cap(df: DataFrame, order: list[str], size: Column, cap: float, exempt: Column | None = None) -> DataFrame:
    """Rows whose predecessors' sizes sum to less than ``cap``; exempt rows are kept and do not count."""
    counted = size if exempt is None else F.when(exempt, 0).otherwise(size)
    keep = F.col("before") < cap
    return in_order(df, order, counted).where(keep if exempt is None else keep | exempt)


def forward_fill(df: DataFrame, value: str, key: list[str], order: list, unknown: str = "?") -> DataFrame:
    """Unknown or null values take the last known one before them within ``key``; leading ones stay unknown."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value) != unknown, F.col(value))
    return df.withColumn(value, F.coalesce(F.last(known, ignorenulls=True).over(w), F.lit(unknown)))


def chunk_starts(n: Column, size: int, step: int) -> Column:
    """Starts (from 0) of overlapping chunks of ``size`` every ``step``, ending with the first that reaches the end; none for 0."""
    every = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    return F.when(n > 0, F.filter(every, lambda i: (i == 0) | (i - step + size < n))).otherwise(F.array().cast("array<int>"))


def batches(df: DataFrame, key: list[str], order: list, size: int, value: str) -> DataFrame:
    """Fixed batches of ``size`` values in order within ``key``: (key, batch, values)."""
    w = Window.partitionBy(*key).orderBy(*order)
    numbered = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("batch", F.floor(F.col("_i") / size))
    return numbered.groupBy(*key, "batch").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", value))), lambda x: x[value]).alias("values"))


def last_n(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def numbered_ids(df: DataFrame, kind: str, order: list, width: int = 5, name: str = "new_id") -> DataFrame:
    """Adds an id of the kind and a running number of at least ``width`` digits within it."""
    number = F.col("_rank").cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return ranked(df, [kind], order, "_rank", "_size").withColumn(name, F.concat_ws("-", F.col(kind), padded)).drop("_rank", "_size")


def one_each_then_fill(df: DataFrame, bucket: str, order: list[str], k: int) -> DataFrame:
    """``k`` rows: the first of every bucket before any bucket's second."""
    first = df.groupBy(bucket).agg(F.min(F.struct(*order)).alias("_f"))
    joined = df.alias("_d").join(first.alias("_e"), F.col(f"_d.{bucket}").eqNullSafe(F.col(f"_e.{bucket}"))).select("_d.*", "_f")
    return joined.withColumn("_more", (F.struct(*order) != F.col("_f")).cast("int")).orderBy("_more", *order).limit(k).drop("_more", "_f")


def round_robin(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``turn``: the i-th row of every group comes before any (i+1)-th; sort by (turn, group)."""
    return ranked(df, [group], order, "turn", "_size").drop("_size")


def cyclic(position: Column, slots: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, slots)), (F.pmod(position - 1, F.lit(len(slots))) + 1).cast("int"))


def largest_remainder(weights: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Whole shares of ``total``: rounded down, the rest to the largest remainders, then weights, then keys. One row per key."""
    every = weights.select(F.sum(weight).alias("_all"))
    raw = weights.crossJoin(F.broadcast(every)).withColumn("_raw", F.col(weight) * total / F.col("_all")).withColumn("_int", F.floor("_raw"))
    w = Window.orderBy(F.round(F.col("_raw") - F.col("_int"), 9).desc(), F.col(weight).desc(), F.col(key))
    rest = F.lit(total) - F.sum("_int").over(Window.partitionBy())
    return raw.withColumn("seats", F.col("_int") + (F.row_number().over(w) <= rest).cast("bigint")).select(key, weight, "seats")


def plurality(votes: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """(key, value, votes) of the most frequent non-null value; of equals the one that comes first. No votes: no row."""
    counted = votes.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    best = counted.groupBy(*key).agg(F.max(F.struct("votes", (-F.col("_first")).alias("f"), value)).alias("b"))
    return best.select(*key, F.col(f"b.{value}").alias(value), F.col("b.votes").alias("votes"))


def nth_percentile(values: Column, q: float) -> Column:
    """The element at int(q * (n - 1)) of the sorted array."""
    return F.element_at(F.sort_array(values), (F.floor((F.size(values) - 1) * q) + 1).cast("int"))


def segments(df: DataFrame, header: Column, key: list[str], order: list) -> DataFrame:
    """Adds ``segment``: how many header rows stand at or before a row; rows before the first header have 0."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("segment", F.sum(header.cast("bigint")).over(w))


def clear_winner(scores: DataFrame, key: list[str], label: str, score: str, least: float = 3, factor: float = 2, plus: float = 1) -> DataFrame:
    """The best label of each key if its score is at least ``least`` and ``factor`` times the second's plus ``plus``, else null."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(label))
    two = scores.withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy(*key).agg(
        F.max(F.when(F.col("_r") == 1, F.col(label))).alias(label), F.max(F.when(F.col("_r") == 1, F.col(score))).alias("best"),
        F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(score))), F.lit(0)).alias("second"),
    )
    return two.withColumn(label, F.when((F.col("best") >= least) & (F.col("best") >= F.col("second") * factor + plus), F.col(label)))
