"""Lexical and dense retrieval, rank fusion and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .windows import top_k


def postings(docs: DataFrame, row: str, terms: Column) -> DataFrame:
    """(row, term, tf, dl) of each distinct term of a document; ``terms`` may hold repeats."""
    flat = cut(docs.select(F.col(row).alias("row"), terms.alias("t")).where(F.size("t") > 0))
    dl = F.size("t").cast("bigint").alias("dl")
    return flat.select("row", dl, F.explode("t").alias("term")).groupBy("row", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(queries: DataFrame, qrow: str, qterms: Column, posts: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, most_terms: int | None = None) -> DataFrame:
    """(query, row, score, rank): documents that share a term with the query, by BM25; equal scores put the larger row first.

    Query terms count once. Only postings of query terms are touched. With distinct terms per document tf is 1 throughout.
    """
    docs = posts.select("row", "dl").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))
    once = F.array_distinct(qterms)
    q = queries.select(F.col(qrow).alias("query"), F.explode(F.slice(once, 1, most_terms) if most_terms else once).alias("term"))
    idf = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(q.select("term").distinct(), "term", "left_semi")
    hit = q.join(posts, "term").join(idf, "term").crossJoin(F.broadcast(docs))  # one row of totals
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    scored = hit.groupBy("query", "row").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return top_k(scored, ["query"], [F.col("score").desc(), F.col("row").desc()], k)


def save_index(posts: DataFrame, path: str) -> None:
    """Writes postings sorted by term, so a reader skips to its terms, with document frequencies, and the totals, last: an index
    without totals is not finished. An existing index is an error."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    posts.join(df, "term").repartition("term").sortWithinPartitions("term").write.mode("errorifexists").parquet(f"{path}/postings")
    totals = posts.select("row", "dl").distinct().agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"))
    totals.coalesce(1).write.mode("errorifexists").parquet(f"{path}/totals")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, totals) of a finished index; an unfinished one is an error."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/totals")


def bm25_indexed(queries: DataFrame, qrow: str, qterms: Column, index: tuple[DataFrame, DataFrame], k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """:func:`bm25` over a saved index: nothing is counted anew."""
    posts, totals = index
    q = queries.select(F.col(qrow).alias("query"), F.explode(F.array_distinct(qterms)).alias("term"))
    hit = q.join(posts, "term").crossJoin(F.broadcast(totals))  # one row of totals
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avg")))
    scored = hit.groupBy("query", "row").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    return top_k(scored, ["query"], [F.col("score").desc(), F.col("row").desc()], k)


def save_vectors(df: DataFrame, row: str, vector: str, path: str, keep: tuple[str, ...] = ()) -> None:
    """Writes vectors of length 1 with their rows and further columns; null and zero vectors are left out."""
    norm = F.sqrt(F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    unit = df.where(F.col(vector).isNotNull()).withColumn("_n", norm).where("_n > 0")
    unit.select(F.col(row), *keep, F.transform(vector, lambda x: (x / F.col("_n")).cast("float")).alias(vector)).write.mode("errorifexists").parquet(path)


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def cosine_top_k(queries: DataFrame, corpus: DataFrame, row: str, vector: str, k: int, block: int = 4096, caption: str | None = None, least: float | None = None) -> DataFrame:
    """(query, row, score, rank) by exact cosine; a vector is not its own neighbour; zero vectors score 0.

    Queries travel in blocks: every corpus batch is multiplied with every block, only the best k per query and batch leave it.
    With ``caption``, a corpus column, they are the best k of different captions of the batch, with the caption as a column, so
    the best of different captions overall are among them, and ranks count all that left a batch. ``least`` is a least score.
    """
    q = queries.select(F.col(row).alias("q"), F.col(vector).cast("array<float>").alias("v")).where("q IS NOT NULL AND v IS NOT NULL")
    groups = q.withColumn("g", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // block)))))
    blocks = groups.groupBy("g").agg(F.collect_list("q").alias("qs"), F.flatten(F.collect_list("v")).alias("vs"))
    mark = F.col(caption) if caption else F.lit(None).cast("int")
    c = corpus.select(F.col(row).alias("r"), F.col(vector).cast("array<float>").alias("v"), mark.alias("m")).where("r IS NOT NULL AND v IS NOT NULL")

    packed = c.withColumn("p", F.pmod(F.xxhash64("r"), F.lit(max(1, -(-corpus.count() // block))))).groupBy("p").agg(
        F.collect_list("r").alias("rs"), F.flatten(F.collect_list("v")).alias("rv"), F.collect_list(F.struct("m")).alias("ms")
    )  # blocks of bounded size on either side; the product of blocks is the work itself

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for qs, vs, rs, rv, ms in zip(f["qs"], f["vs"], f["rs"], f["rv"], f["ms"]):
                a, b_ = unit(np.asarray(vs, dtype=np.float64).reshape(len(qs), -1)), unit(np.asarray(rv, dtype=np.float64).reshape(len(rs), -1))
                s = a @ b_.T
                s[np.asarray(qs)[:, None] == np.asarray(rs)[None, :]] = -np.inf
                if least is not None:
                    s[s < least] = -np.inf
                marks = np.array([x["m"] for x in ms], dtype=object)
                if caption:  # of each caption the best row, the least of equals
                    by = np.argsort(np.asarray(rs))
                    code = pd.factorize(marks[by], use_na_sentinel=False)[0]
                    of = [by[code == g] for g in range(code.max() + 1)]
                    best_of = np.stack([g[s[:, g].argmax(axis=1)] for g in of], axis=1)
                    top = np.take_along_axis(s, best_of, 1)
                    order = np.lexsort((np.asarray(rs)[best_of], -top), axis=1)[:, :k]
                    at = np.take_along_axis(best_of, order, 1)
                    out.append(pd.DataFrame({
                        "query": np.repeat(qs, at.shape[1]), "row": np.asarray(rs)[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel(), "m": marks[at].ravel(),
                    }))
                    continue
                m = min(k, s.shape[1])
                at = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out.append(pd.DataFrame({"query": np.repeat(qs, m), "row": np.asarray(rs)[at].ravel(), "score": np.take_along_axis(s, at, 1).ravel()}))
            got = pd.concat(out)
            yield got[np.isfinite(got["score"])]

    if caption:
        kind = corpus.schema[caption].dataType.simpleString()
        found = blocks.crossJoin(packed).mapInPandas(best, f"query bigint, row bigint, score double, m {kind}").withColumnRenamed("m", caption)
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), "row")
        return found.withColumn("rank", F.row_number().over(w))
    found = blocks.crossJoin(packed).mapInPandas(best, "query bigint, row bigint, score double")
    return top_k(found, ["query"], [F.col("score").desc(), F.col("row")], k)


def fuse(rankings: list[DataFrame], k: int, c: int = 60, depth: int = 20) -> DataFrame:
    """(query, row, score, rank) by reciprocal rank over the first ``depth`` of each ranking (query, row, rank).

    Equal scores keep the order of the first ranking they appear in.
    """
    every = None
    for i, r in enumerate(rankings):
        part = r.where(F.col("rank") <= depth).select("query", "row", "rank", F.lit(i).alias("list"))
        every = part if every is None else every.union(part)
    scored = every.groupBy("query", "row").agg(
        F.round(F.sum(1.0 / (c + F.col("rank"))), 12).alias("score"), F.min(F.struct("list", "rank")).alias("first")
    )
    return top_k(scored, ["query"], [F.col("score").desc(), F.col("first"), F.col("row")], k).drop("first")


def recall_at(found: DataFrame, gold: DataFrame, ks: list[int]) -> DataFrame:
    """(k, queries, recall): share of queries with a relevant row among the first k. Queries without gold are left out."""
    asked = gold.select("query").distinct()
    first = found.join(gold.select("query", "row").distinct(), ["query", "row"]).groupBy("query").agg(F.min("rank").alias("rank"))
    each = asked.join(first, "query", "left").withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    hit = F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("int")
    return each.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(hit), 6).alias("recall"))


def rarest_terms(posts: DataFrame, query_terms: DataFrame, n: int) -> DataFrame:
    """(query, term, rank): the n rarest known terms of each query (query, term)."""
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return top_k(query_terms.distinct().join(df, "term"), ["query"], [F.col("df"), F.col("term")], n).select("query", "term", "rank")


def own_terms(terms: DataFrame, label: str, term: str) -> DataFrame:
    """(label, term) of terms that only one label has."""
    once = terms.select(label, term).distinct()
    return once.join(once.groupBy(term).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(term), term, "left_semi")


def union_top(rankings: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """Several corpora's rankings, the first n of each, with the corpus name."""
    out = None
    for name, r, n in rankings:
        part = r.where(F.col("rank") <= n).select(F.lit(name).alias("corpus"), "query", "row", "rank")
        out = part if out is None else out.union(part)
    return out


__all__ = ["postings", "bm25", "cosine_top_k", "fuse", "recall_at", "rarest_terms", "own_terms", "union_top", "save_index", "open_index", "bm25_indexed", "save_vectors", "open_vectors"]
