"""Keep-first deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WORD
from ..session import cut
from .similarity import _in
from .windows import first_of


def exact(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key; rows with a null or blank key are dropped."""
    keyed = df.withColumn("_key", key).where("length(trim(_key)) > 0")
    return first_of(keyed, ["_key"], order).drop("_key")


def across(tables: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of several tables of one shape, the first occurrence of a key staying; earlier tables go first."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("source_rank", F.lit(i))
        every = t if every is None else every.unionByName(t)
    return first_of(every.where(F.length(F.trim(key)) > 0), [key], ["source_rank", order])


def not_in(df: DataFrame, key: Column, seen: DataFrame, seen_key: Column) -> DataFrame:
    """Rows whose key ``seen`` does not hold; null keys stay."""
    return df.withColumn("_k", key).join(seen.select(seen_key.alias("_k")).where("_k IS NOT NULL").distinct(), "_k", "left_anti").drop("_k")


def copies_apart(df: DataFrame, row: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``df`` without later copies of a text, and the rows (``row``) of all later copies; case makes no difference.

    The first row is the least ``row``, which is unique. Few copies may stay in ``df``: what goes is told by a bit set of fixed size. A
    text without words is a copy of none. Both keep-first rules drop every later copy: its first row, or an earlier row that drops
    that one, is as similar to it. So they need pairs of the rows left only.
    """
    low = F.lower(text)
    own = df.where(low.rlike(WORD)).where(F.col(row).isNotNull())
    firsts = cut(own.groupBy(F.unhex(F.sha2(low, 256)).alias("_k")).agg(F.min(row).alias(row)).select(row))
    return df.where(_in(firsts, [row], 26)(row)), own.select(row).join(firsts, row, "left_anti")


def greedy_first(rows: DataFrame, row: str, pairs: DataFrame) -> DataFrame:
    """Rows a keep-first pass would keep: in order of ``row``, a row is dropped if it is similar to an earlier KEPT row.

    ``pairs`` (a, b), a < b. The kept rows are the lexicographically first maximal independent set of the similarity graph. Each
    round keeps every open row that has no open earlier neighbour and drops those rows' neighbours; edges shrink, so rounds are as
    many as the longest chain of open rows, not as many as rows.
    """
    open_ = cut(pairs.select("a", "b").where("a < b").distinct())
    dropped: DataFrame | None = None
    while open_.take(1):
        heads = open_.select(F.col("a").alias("r")).distinct().join(open_.select(F.col("b").alias("r")).distinct(), "r", "left_anti")
        gone = cut(open_.join(heads.withColumnRenamed("r", "a"), "a", "left_semi").select(F.col("b").alias("r")).distinct())
        dropped = gone if dropped is None else dropped.union(gone)
        left = open_.join(gone.withColumnRenamed("r", "a"), "a", "left_anti").join(gone.withColumnRenamed("r", "b"), "b", "left_anti")
        kept = heads.withColumnRenamed("r", "a")
        open_ = cut(left.join(kept, "a", "left_anti"))
    return rows if dropped is None else rows.join(dropped.withColumnRenamed("r", row), row, "left_anti")


def drop_if_any_earlier(rows: DataFrame, row: str, pairs: DataFrame) -> DataFrame:
    """Rows with no similar earlier row at all, kept or not."""
    return rows.join(pairs.select(F.col("b").alias(row)).distinct(), row, "left_anti")


def profile(df: DataFrame, text: str, pair: list[str]) -> DataFrame:
    """(rows, empty, repeated_text, repeated_pair)"""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) == 0, 1).otherwise(0)).cast("bigint").alias("empty"),
        (F.count(text) - F.countDistinct(text)).alias("repeated_text"),
        (F.count(F.lit(1)) - F.countDistinct(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in pair]))).alias("repeated_pair"),
    )


def by_first_words(df: DataFrame, title: str, n: int, order: list) -> DataFrame:
    """One row per beginning of the title."""
    key = F.array_join(F.slice(F.split(F.lower(F.trim(F.col(title))), r"\s+"), 1, n), " ")
    return exact(df, key, order)


def top_without_repeats(hits: DataFrame, query: str, caption: str, score: str, row: str, k: int) -> DataFrame:
    """The best k hits of a query with different captions."""
    best = Window.partitionBy(query, caption).orderBy(F.col(score).desc(), F.col(row))
    rank = Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(row))
    once = hits.withColumn("_c", F.row_number().over(best)).where("_c = 1").drop("_c")
    return once.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def greedy_among(rows: DataFrame, key: str, pairs: DataFrame, takes_part) -> DataFrame:
    """:func:`greedy_first` among the rows for which ``takes_part`` holds; the others are always kept and never block."""
    part = rows.where(F.coalesce(takes_part, F.lit(False))).select(key)
    inside = pairs.join(part.withColumnRenamed(key, "a"), "a", "left_semi").join(part.withColumnRenamed(key, "b"), "b", "left_semi")
    kept = greedy_first(part, key, inside)
    return rows.where(~F.coalesce(takes_part, F.lit(False))).select(key).union(kept.select(key))


def blocked_by_rejected(rows: DataFrame, key: str, pairs: DataFrame, reason: str, no_block: list[str]) -> DataFrame:
    """Rows without a similar earlier one; rejected rows block too, except those rejected for one of the reasons of ``no_block``."""
    blocks = rows.where(~F.coalesce(F.col(reason), F.lit("")).isin(no_block)).select(F.col(key).alias("a"))
    return drop_if_any_earlier(rows.select(key), key, pairs.join(blocks, "a", "left_semi"))
