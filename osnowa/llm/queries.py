"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..session import cut
from . import leaks, mixing, neardup, overlap, packing, people, quota, residue, splits
from .components import components

SPLIT_SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}


KINDS = ("timeline", "kompendium")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    """Both tables' texts (kind, row, text): timeline's title and text, kompendium's text."""
    t = table(spark, folder, "timeline").select(
        F.lit(0).alias("kind"), F.col("row_id").alias("row"), F.concat_ws(" ", "title", "text").alias("text")
    )
    k = table(spark, folder, "kompendium").select(F.lit(1).alias("kind"), F.col("row_id").alias("row"), "text")
    return t.union(k)


def _tab(column: str = "kind"):
    return F.element_at(F.array(*map(F.lit, KINDS)), F.col(column) + 1).alias("tab")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of rows of one table that tell the same text."""
    members, links = neardup.similar_classes(_texts(spark, folder))
    return neardup.row_pairs(members, links).select(_tab(), "row_a", "row_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per text: its group (least row of all texts linked directly or through others) and its number of links."""
    members, links = neardup.similar_classes(_texts(spark, folder))
    members = cut(members)
    name = lambda c: F.concat_ws(":", F.col("kind"), F.lpad(F.col(c).cast("string"), 19, "0"))
    parts = components(links.select(name("a").alias("u"), name("b").alias("v")))
    least = F.element_at(F.split("component", ":"), 2).cast("bigint")
    degree = links.select("kind", F.explode(F.array("a", "b")).alias("rep")).groupBy("kind", "rep").agg(F.count(F.lit(1)).alias("links"))
    return (
        members.join(degree, ["kind", "rep"], "left").withColumn("node", name("rep")).join(parts, "node", "left")
        .select(_tab(), F.col("row").alias("row_id"), F.coalesce(least, "rep").alias("group_row"), (F.coalesce("links", F.lit(0)) + (F.col("size") > 1).cast("int")).alias("links"))
    )


def _item_names() -> list:
    return [splits.bundle_name(F.col("group_id")), splits.bundle_of_id(F.col("id"))]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of sets of related items that the delivered split tears apart."""
    items = table(spark, folder, "synthetic_items").select("row_id", "id", "group_id", "split")
    return splits.torn_sets(items, "row_id", _item_names(), "split").select(F.col("row").alias("row_id"), "set_row")


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    """A new split of all items that keeps each set together."""
    items = table(spark, folder, "synthetic_items").select("row_id", "id", "group_id")
    sets = cut(splits.related_sets(items, "row_id", _item_names()))
    return splits.assign_splits(sets, SPLIT_SHARES).select(F.col("row").alias("row_id"), "set_row", "split")


def _sides(spark: SparkSession, folder: str) -> DataFrame:
    split = F.col("split")
    return table(spark, folder, "synthetic_items").select(
        F.col("row_id").alias("row"), F.when(split == "train", 0).when(split.isin("val", "test"), 1).alias("side"),
        F.concat_ws(" ", "question", "model_answer").alias("main"), F.col("source_text").alias("extra"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of items on both sides of the split that are the same or nearly the same."""
    members, links = overlap.cross_split_classes(_sides(spark, folder))
    return overlap.row_links(members, links).select(
        F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b")
    )


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping evaluation rows and pairs per split and source."""
    members, links = overlap.cross_split_classes(_sides(spark, folder))
    labels = table(spark, folder, "synthetic_items").select(F.col("row_id").alias("row"), "split", F.col("source_doc").alias("source"))
    return overlap.overlap_report(members, links, labels)


def _corpus(spark: SparkSession, folder: str) -> DataFrame:
    t = table(spark, folder, "timeline").select(F.lit(0).alias("kind"), F.col("row_id").alias("row"), "text")
    return t.union(table(spark, folder, "kompendium").select(F.lit(1).alias("kind"), F.col("row_id").alias("row"), "text"))


def _exam(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "exam").select(F.col("row_id").alias("row"), F.col("question").alias("text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold a passage of an exam question."""
    found = leaks.leaks(_corpus(spark, folder), _exam(spark, folder))
    return found.select(_tab(), F.col("row").alias("row_id"), F.col("test_row").alias("exam_row"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked exam items with the number of records that give them away."""
    return leaks.leak_report(leaks.leaks(_corpus(spark, folder), _exam(spark, folder))).withColumnRenamed("test_row", "exam_row")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with template residue, filler, an error message or a script notice."""
    return residue.residue(table(spark, folder, "documents")).select("doc_id")


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """The documents without any of it."""
    return residue.without_residue(table(spark, folder, "documents")).select("doc_id", "text", "lang", "source")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every further record of a person, and every mention under a spelling no record has."""
    persons = table(spark, folder, "persons").select(F.col("row_id").alias("row"), "name", "years", "text")
    timeline = table(spark, folder, "timeline").select(F.col("row_id").alias("row"), "year", F.posexplode("persons").alias("p", "name"))
    return people.variants(persons, timeline.select("row", (F.col("p") + 1).alias("pos"), "name", "year"))


def _quota(spark: SparkSession, folder: str):
    items = table(spark, folder, "e5_items").select("id", "subtype", "difficulty", "section")
    return quota.quota_sample(items, "id", ["subtype", "difficulty", "section"], table(spark, folder, "e5_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Categories with fewer items than their target or floor asks for."""
    return _quota(spark, folder)[1].where("short > 0").select("dim", "category")


def p6_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The sample itself."""
    return _quota(spark, folder)[0]


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Available, wanted and drawn items of every target category."""
    return _quota(spark, folder)[1]


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return packing.token_counts(table(spark, folder, "documents"), "doc_id", keep=("source",))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in a container of each capacity."""
    packed = packing.pack(_sizes(spark, folder), table(spark, folder, "pack_sizes"))
    return packed.withColumnRenamed("id", "doc_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, free room and cost spread per capacity."""
    sizes = table(spark, folder, "pack_sizes")
    return packing.packing_report(packing.pack(_sizes(spark, folder), sizes), sizes)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn so that sources have their shares, with the number of uses."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))[0].withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """Target and reached shares of the sources."""
    return mixing.mix(_sizes(spark, folder), table(spark, folder, "mix_targets"))[1]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_splits": p2_splits,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_sample": p6_sample,
    "p6_report": p6_report,
    "p7_packed": p7_packed,
    "p7_report": p7_report,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_kept": p9_kept,
}

_KEY = r"trim(regexp_replace(translate(lower({0}), 'ąćęłńóśźż', 'acelnoszz'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_HEAD = r"upper(regexp_extract({0}, '^\s*([IVXLCDMivxlcdm]+)\s*(?:\.|$)', 1))"
_UNMET = rf"""i AS (SELECT id, subtype, difficulty, section FROM e5_items WHERE trim(coalesce(id, '')) <> ''), s AS (SELECT count(DISTINCT id) // 5 AS s FROM i),
 v AS (SELECT DISTINCT 'subtype' AS dim, id, subtype AS v FROM i UNION SELECT 'difficulty', id, difficulty FROM i UNION SELECT 'section', id, section FROM i),
 t AS (SELECT dim, category, share, min_rows, {_KEY.format('category')} AS k, {_HEAD.format('category')} AS h FROM e5_targets),
 d AS (SELECT DISTINCT dim, v, {_KEY.format('v')} AS k, {_HEAD.format('v')} AS h FROM v WHERE v IS NOT NULL),
 p AS (SELECT *, CASE WHEN regexp_matches(v, '(?:…|\.\.\.)\s*$') THEN k WHEN length(k) >= 24 THEN substring(k, 1, 24) END AS p FROM d),
 c AS (SELECT dim, v, coalesce((SELECT min(category) FROM t WHERE t.dim = p.dim AND t.k = p.k), (SELECT min(category) FROM t WHERE t.dim = p.dim AND t.h = p.h AND p.h <> '' HAVING count(*) = 1),
 (SELECT min(category) FROM t WHERE t.dim = p.dim AND starts_with(t.k, p.p) AND p.p <> '' HAVING count(*) = 1)) AS category FROM p),
 a AS (SELECT c.dim, c.category, count(DISTINCT v.id) AS n FROM v JOIN c ON c.dim = v.dim AND c.v = v.v WHERE c.category IS NOT NULL GROUP BY 1, 2),
 u AS (SELECT t.dim, t.category, coalesce(n, 0) AS n, greatest(min_rows, ceil(CAST(share AS DECIMAL(18, 9)) * s)) AS wanted FROM t LEFT JOIN a ON a.dim = t.dim AND a.category = t.category CROSS JOIN s)"""

#: The size of the mixed and the packed documents is a matter of draws and order; counts that hold in any case have SQL.
SQL: dict[str, str] = {"p6_found": f"WITH {_UNMET} SELECT dim, category FROM u WHERE n < wanted"}
