"""Grades in layers and runs: inheritance, means over repetitions, losses by dimension and error, conditional rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ancestors


def valid_points(points: Column, filtered: Column | None = None) -> Column:
    """Points as a number: null where they are missing, no number, or the row is filtered."""
    value = points.try_cast("double")
    return value if filtered is None else F.when(~F.coalesce(filtered, F.lit(False)), value)


def inherited(runs: DataFrame, keeps: DataFrame, rows: DataFrame) -> DataFrame:
    """(run, item, owner, distance, other columns of rows): the row that counts for each item of each run.

    ``runs`` (run, base): the run another one is merged from, or null. ``keeps`` (run, item): items a run with a base answers itself;
    the others come from its base, and so on to the first run of the chain, whose rows all count. ``rows`` (run, item, ...) are
    unique by run and item. An item that its owner has no row for is left out.
    """
    own = runs.select("run", "base").where("run IS NOT NULL").distinct()
    chain = ancestors(own.select(F.col("run").alias("node"), F.col("base").alias("parent"))).select(F.col("node").alias("run"), F.col("ancestor").alias("owner"), "distance")
    first = own.join(own.select(F.col("run").alias("base")), "base", "left_anti").select(F.col("run").alias("owner"))
    kept = keeps.select(F.col("run").alias("owner"), "item").distinct().join(first, "owner", "left_anti")
    every = rows.select(F.col("run").alias("owner"), "item").join(first, "owner")
    claims = chain.join(kept.unionByName(every), "owner").groupBy("run", "item").agg(F.min(F.struct("distance", "owner")).alias("c"))
    return claims.select("run", "item", "c.owner", "c.distance").join(rows.withColumnRenamed("run", "owner"), ["owner", "item"])


def points_by(df: DataFrame, by: list[str], points: Column, most: Column) -> DataFrame:
    """(by, points, most, n): sums over rows with valid points only; the others count neither for points nor for the maximum."""
    graded = df.withColumn("_p", points).where("_p IS NOT NULL")
    return graded.groupBy(*by).agg(F.sum("_p").alias("points"), F.sum(most).alias("most"), F.count(F.lit(1)).alias("n"))


def item_means(df: DataFrame, by: list[str], points: Column, most: Column) -> DataFrame:
    """(by, n, mean, lost): the mean over an item's repetitions and what it lacks of the maximum."""
    graded = df.withColumn("_p", points).where("_p IS NOT NULL")
    return graded.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_p").alias("mean"), (F.max(most) - F.avg("_p")).alias("lost"))


def mean_errors(df: DataFrame, by: list[str], errors: str) -> DataFrame:
    """(by, error, lost): a map of losses by error averaged over an item's repetitions, repetitions without the error counting 0."""
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    summed = df.select(*by, F.explode(errors).alias("error", "_x")).groupBy(*by, "error").agg(F.sum("_x").alias("_s"))
    return summed.join(n, by).select(*by, "error", (F.col("_s") / F.col("_n")).alias("lost"))


def group_score(means: DataFrame, by: list[str], mean: str, most: str) -> DataFrame:
    """(by, got, most, share) of item means."""
    return means.groupBy(*by).agg(F.sum(mean).alias("got"), F.sum(most).alias("most")).withColumn("share", F.when(F.col("most") != 0, F.col("got") / F.col("most")).otherwise(0.0))


def most_frequent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value): the most frequent non-null value, the least of equals."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.col("_n").desc(), F.col(value))
    return counted.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, value)


def loss_by(df: DataFrame, by: list[str], dimension: Column, lost: Column, most: Column) -> DataFrame:
    """(by, category, lost, most): losses by a dimension, null categories as '?'."""
    return df.groupBy(*by, F.coalesce(dimension, F.lit("?")).alias("category")).agg(F.sum(lost).alias("lost"), F.sum(most).alias("most"))


def top_error(errors: DataFrame, by: list[str]) -> DataFrame:
    """(by, error): the error that costs an item most, the first by name of equals."""
    w = Window.partitionBy(*by).orderBy(F.col("lost").desc(), "error")
    return errors.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*by, "error")


def conditional_rates(df: DataFrame, by: list[str], given: Column, then: Column) -> DataFrame:
    """(by, n, rate, rate_given, rate_else): how often ``then`` holds at all, where ``given`` holds, and where it does not; null
    where there is no such row."""
    hit = F.when(then, 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("rate"), F.avg(F.when(given, hit)).alias("rate_given"), F.avg(F.when(~F.coalesce(given, F.lit(False)), hit)).alias("rate_else"))


def rate_matrix(df: DataFrame, axes: list[str], within: str, hit: Column, total: str = "total") -> DataFrame:
    """(axes, within, n, rate): the rate in every cell of the axes by ``within``, and over all of it under the label ``total``."""
    columns = [F.col(a) for a in axes]
    sets = df.groupingSets([[*columns, F.col(within)], columns], *columns, F.col(within)).agg(
        F.grouping(within).alias("_g"), F.count(F.lit(1)).alias("n"), F.avg(F.when(hit, 1.0).otherwise(0.0)).alias("rate")
    )
    return sets.select(*axes, F.when(F.col("_g") == 1, total).otherwise(F.col(within)).alias(within), "n", "rate")


def disagreements(df: DataFrame, item: str, a: Column, b: Column) -> DataFrame:
    """(item, a, b) of rows on which two judges differ; one null and one not is a difference, two nulls are none."""
    return df.select(item, a.alias("a"), b.alias("b")).where(~F.col("a").eqNullSafe(F.col("b")))


def ratio_agreement(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """(by, n, agreement, sum_a, sum_b) of rows both judged."""
    both = df.withColumn("_a", a).withColumn("_b", b).where("_a IS NOT NULL AND _b IS NOT NULL")
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_a") == F.col("_b"), 1.0).otherwise(0.0)).alias("agreement"), F.sum("_a").alias("sum_a"), F.sum("_b").alias("sum_b")
    )
