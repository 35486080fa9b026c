"""Aggregations: counts with labels, margins, layered grades, paired differences, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labelled(column: Column, empty: str = "—") -> Column:
    """Null and blank as a label."""
    return F.coalesce(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit(empty))


def count_share(df: DataFrame, key: Column, name: str = "label") -> DataFrame:
    """(label, n, share): counts and their share of all rows."""
    counted = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole != 0, part / whole).otherwise(0.0)


def override(layers: list[DataFrame], key: list[str]) -> DataFrame:
    """Layers of one shape merged by key; a later layer's row replaces an earlier one's. Adds ``layer``, its number."""
    every = None
    for i, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(i))
        every = part if every is None else every.unionByName(part)
    w = Window.partitionBy(*key).orderBy(F.col("layer").desc())
    return every.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_fallbacks(facts: DataFrame, dims: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """The value of the first dimension table (frame, key columns) that has the row's keys; null if none has."""
    out = facts
    for i, (dim, keys) in enumerate(dims):
        slim = dim.groupBy(*keys).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(slim, keys, "left")
    return out.withColumn(value, F.coalesce(*[F.col(f"_v{i}") for i in range(len(dims))])).drop(*[f"_v{i}" for i in range(len(dims))])


def pivot_totals(df: DataFrame, row: str, column: str, values: list[str], measure: Column, total: str = "total") -> DataFrame:
    """One row per ``row`` and one of all, a column per value and one of all; missing cells are 0."""
    cells = [F.coalesce(F.sum(F.when(F.col(column) == v, measure)), F.lit(0)).alias(str(v)) for v in values]
    return df.rollup(row).agg(*cells, F.coalesce(F.sum(measure), F.lit(0)).alias(total)).withColumn(row, F.coalesce(F.col(row), F.lit(total)))


def crosstab(df: DataFrame, a: str, b: str, measure: Column, total: str = "total") -> DataFrame:
    """(a, b, value) with margins under the label ``total``; null values of a or b are labelled before."""
    keyed = df.withColumn(a, labelled(F.col(a))).withColumn(b, labelled(F.col(b)))
    cube = keyed.cube(a, b).agg(F.grouping(a).alias("_ga"), F.grouping(b).alias("_gb"), measure.alias("value"))
    return cube.select(F.when(F.col("_ga") == 1, total).otherwise(F.col(a)).alias(a), F.when(F.col("_gb") == 1, total).otherwise(F.col(b)).alias(b), "value")


def all_or_nothing(df: DataFrame, key: list[str], points: str, most: str) -> DataFrame:
    """(key, points, most, complete): sums only where every row has points, else 0 and 0."""
    whole = F.count(F.lit(1)) == F.count(points)
    return df.groupBy(*key).agg(
        F.when(whole, F.sum(points)).otherwise(0).alias("points"), F.when(whole, F.sum(most)).otherwise(0).alias("most"), whole.alias("complete")
    )


def graded(df: DataFrame, key: list[str], points: str, most: str) -> DataFrame:
    """(key, points, most, missing): the maximum counts also where points are missing."""
    return df.groupBy(*key).agg(
        F.coalesce(F.sum(points), F.lit(0)).alias("points"), F.sum(most).alias("most"), (F.count(F.lit(1)) - F.count(points)).alias("missing")
    )


def paired(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(n, better, worse, mean_delta) of rows both frames have."""
    b, a = before.select(*key, F.col(value).alias("_b")), after.select(*key, F.col(value).alias("_a"))
    d = F.col("_a") - F.col("_b")
    return b.join(a, key).agg(
        F.count(F.lit(1)).alias("n"), F.sum((d > 0).cast("bigint")).alias("better"), F.sum((d < 0).cast("bigint")).alias("worse"), F.round(F.avg(d), 6).alias("mean_delta")
    )


def before_after(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, delta) counts over the keys of either."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("after"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return b.join(a, key, "full").select(key, z("before").alias("before"), z("after").alias("after"), (z("after") - z("before")).alias("delta"))


def coverage(dim: DataFrame, dkey: str, facts: DataFrame, fkey: str) -> DataFrame:
    """(key, n, kind): every key of the dimension with its rows, 0 if none, and keys only the facts have ('extra')."""
    counted = facts.groupBy(F.col(fkey).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    base = dim.select(F.col(dkey).alias("key")).distinct().withColumn("_in", F.lit(1))
    joined = base.join(counted, "key", "full")
    kind = F.when(F.col("_in").isNull(), "extra").when(F.col("n").isNull(), "empty").otherwise("covered")
    return joined.select("key", F.coalesce("n", F.lit(0)).alias("n"), kind.alias("kind"))


def spread(df: DataFrame, item: str, group: str, value: str, low: float, apart: float) -> DataFrame:
    """(item, least, most, kind) of items all groups do badly on, or on which groups differ much."""
    each = df.groupBy(item, group).agg(F.avg(value).alias("v")).groupBy(item).agg(F.round(F.min("v"), 6).alias("least"), F.round(F.max("v"), 6).alias("most"))
    kind = F.when(F.col("most") <= low, "all_low").when(F.col("most") - F.col("least") >= apart, "apart")
    return each.withColumn("kind", kind).where("kind IS NOT NULL")


def allocate(df: DataFrame, key: list[str], part: str, lost: str) -> Column:
    """Each part's share of what the key lost."""
    return ratio(F.col(part) * F.col(lost), F.sum(part).over(Window.partitionBy(*key)))


def contract_errors(given: DataFrame, gid: str, asked: DataFrame, aid: str) -> DataFrame:
    """(id, error): ids nobody asked for, asked ids that are missing, ids given more than once."""
    g, a = given.select(F.col(gid).alias("id")), asked.select(F.col(aid).alias("id")).distinct()
    unknown = g.distinct().join(a, "id", "left_anti").withColumn("error", F.lit("unknown"))
    missing = a.join(g.distinct(), "id", "left_anti").withColumn("error", F.lit("missing"))
    twice = g.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("error"))
    return unknown.union(missing).union(twice)


def in_ranges(df: DataFrame, value: Column, ranges: DataFrame) -> DataFrame:
    """Joins half-open ranges (low, high, label): low <= value < high. The table of ranges is small by nature and broadcast if
    it has at most a thousand rows; a longer one is joined as it is."""
    few = ranges.limit(1001).count() <= 1000
    r = F.broadcast(ranges) if few else ranges
    return df.withColumn("_x", value).join(r, (F.col("_x") >= F.col("low")) & (F.col("_x") < F.col("high")), "left").drop("_x", "low", "high")


def inflation(df: DataFrame, label: str, base: str, tokens: Column, chars: Column) -> DataFrame:
    """(label, per_kchar, inflation): tokens per thousand characters, and how many per cent more than the label ``base`` has."""
    counted = df.groupBy(label).agg((F.sum(tokens) / F.sum(chars)).alias("r"))
    of_base = F.max(F.when(F.col(label) == base, F.col("r"))).over(Window.partitionBy())
    return counted.select(label, F.round(F.col("r") * 1000.0, 6).alias("per_kchar"), F.round((F.col("r") / of_base - 1) * 100.0, 6).alias("inflation"))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    head = df.columns
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *["| " + " | ".join(cell(r[c]) for c in head) + " |" for r in rows]]) + "\n"
