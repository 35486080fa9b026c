"""Splits that keep related records together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import cut
from .components import components

#: Bits of the component hash that order the assignment; the running totals over these buckets go to the driver.
ORDER_BITS = 12


def bundle_name(name: Column) -> Column:
    """Canonical form of a written bundle name: lower-case prefix, a dash, the number without leading zeros.

    Any run of dashes, slashes, underscores, dots or white space separates prefix and number. Without a separator the last
    eight digits are the number, or, where fewer follow the letters, all of them. Anything else stays as it is, trimmed and
    lower-case. Null and blank give null.
    """
    low = F.lower(F.trim(F.regexp_replace(name, r"[\s ​]+", " ")))
    apart = F.regexp_replace(low, r"[\s\-‐‑‒–—―−_/.:#]+", "-")
    parted = r"^-?([\p{L}][\p{L}\p{N}]*)-0*(\d+)-?$"
    packed = r"^([\p{L}][\p{L}\p{N}]*?)0*(\d{8})$"
    plain = r"^([\p{L}]+)0*(\d+)$"
    whole = r"^([\p{L}][\p{L}\p{N}]*?)(\d{8})$"

    def build(pattern: str) -> Column:
        number = F.regexp_replace(F.regexp_extract(apart, pattern, 2), r"^0+(?=\d)", "")
        return F.concat(F.regexp_extract(apart, pattern, 1), F.lit("-"), number)

    del packed
    return (
        F.when(F.length(F.coalesce(apart, F.lit(""))) == 0, F.lit(None).cast("string"))
        .when(apart.rlike(parted), build(parted))
        .when(apart.rlike(whole), build(whole))
        .when(apart.rlike(plain), build(plain))
        .otherwise(apart)
    )


def bundle_of_id(name: Column) -> Column:
    """The bundle an item id names: the id without its running number. Null and blank ids name none."""
    return bundle_name(F.regexp_replace(F.trim(name), r"[\s\-‐‑‒–—―−_/.:#]+\d+$", ""))


def related_sets(items: DataFrame, row: str, names: list[Column]) -> DataFrame:
    """(row, set_row) of every record: records sharing a name, directly or through others, have one set.

    ``set_row`` is the set's least row. A record without any name is its own set. Rows with a null ``row`` are left out;
    a repeated row is returned once. Columns of ``items`` other than those used may have any names.
    """
    slim = items.select(F.col(row).cast("bigint").alias("row"), *[n.alias(f"n{i}") for i, n in enumerate(names)])
    slim = slim.where("row IS NOT NULL")
    cols = [f"n{i}" for i in range(len(names))]
    pairs = None
    for a, b in zip(cols, cols[1:]):
        e = slim.where(f"{a} <> {b}").select(F.col(a).alias("u"), F.col(b).alias("v"))
        pairs = e if pairs is None else pairs.union(e)
    if len(cols) > 2:  # a gap in the middle must not part the outer names
        pairs = pairs.union(slim.where(f"{cols[0]} <> {cols[-1]}").select(F.col(cols[0]).alias("u"), F.col(cols[-1]).alias("v")))
    keyed = slim.select("row", F.coalesce(*cols, F.concat(F.lit("\u0001row "), F.col("row"))).alias("node"))
    if pairs is None:
        named = keyed.select("row", F.col("node").alias("part"))
    else:
        named = keyed.join(components(pairs), "node", "left").select("row", F.coalesce("component", "node").alias("part"))
    named = cut(named.distinct())
    first = named.groupBy("part").agg(F.min("row").alias("set_row"))
    return named.join(first, "part").groupBy("row").agg(F.min("set_row").alias("set_row"))


def torn_sets(items: DataFrame, row: str, names: list[Column], split: str) -> DataFrame:
    """(row, set_row) of all records of sets that hold more than one non-null split; a blank split counts as null."""
    sets = cut(related_sets(items, row, names))
    given = items.select(F.col(row).cast("bigint").alias("row"), F.nullif(F.trim(F.col(split)), F.lit("")).alias("split"))
    torn = (
        sets.join(given, "row").groupBy("set_row")
        .agg(F.min("split").alias("least"), F.max("split").alias("most")).where("least <> most").select("set_row")
    )
    return sets.join(torn, "set_row", "left_semi")


def assign_splits(sets: DataFrame, shares: dict[str, float], seed: int = 7) -> DataFrame:
    """(row, set_row, split): whole sets in hash order fill the splits up to their share of all rows.

    The hash order is cut where the running total of rows passes a share. Totals are taken per hash bucket (2^ORDER_BITS
    values, the only thing collected), the order within a bucket by a window over its sets, so no task sees all sets.
    Shares are scaled to sum to 1. A set larger than a share goes whole to the split its first row falls into.
    """
    spark = sets.sparkSession
    order = F.xxhash64(F.lit(seed), F.col("set_row"))
    sizes = (
        sets.groupBy("set_row").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", order).withColumn("bucket", F.shiftrightunsigned("h", 64 - ORDER_BITS).cast("int"))
    )
    totals = {r["bucket"]: r["n"] for r in sizes.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    start, total = {}, 0
    for b in sorted(totals):
        start[b], total = total, total + totals[b]
    begin = spark.createDataFrame([(b, s) for b, s in start.items()], "bucket int, start bigint")
    w = Window.partitionBy("bucket").orderBy("h", "set_row").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("n").over(w), F.lit(0))
    scale, edge, rule = sum(shares.values()), 0.0, None
    for name, share in shares.items():
        edge += share / scale * total
        hit = F.col("at") < edge
        rule = F.when(hit, name) if rule is None else rule.when(hit, name)
    placed = sizes.join(F.broadcast(begin), "bucket").withColumn("at", middle)
    placed = placed.select("set_row", rule.otherwise(list(shares)[-1]).alias("split"))
    return sets.join(placed, "set_row").select("row", "set_row", "split")
