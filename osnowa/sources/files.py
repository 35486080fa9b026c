"""Sources and sinks: lenient and strict JSON lines, path-derived columns, versioned and split outputs."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.windows import first_of, in_order


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; blank and malformed lines are skipped, a missing path gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_keyed(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """JSON lines that must parse; of rows with one key the last by ``order`` stays."""
    return first_of(spark.read.schema(schema).option("mode", "FAILFAST").json(path), [key], [F.col(order).desc()])


def ids_of(df: DataFrame, key: str) -> DataFrame:
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def read_document(spark: SparkSession, path: str, schema: str, lists: list[str]) -> DataFrame:
    """Whole-file JSON documents with a list under the first of several names that is there, one row per element."""
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    held = [c for c in lists if c in doc.columns]
    return doc.select(F.explode_outer(F.coalesce(*held)).alias("item")).select("item.*")


def read_items(spark: SparkSession, path: str, item: str, lists: list[str], aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Items of whole-file JSON documents: a list under the first of several names that is there, or a bare list. ``item`` is the
    schema of an item; ``aliases`` names older fields (part of the schema) that stand in where a field is null."""
    whole = spark.read.text(path, wholetext=True)
    named = F.from_json("value", "struct<" + ", ".join(f"{c}: array<struct<{item}>>" for c in lists) + ">")
    bare = F.when(F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("["), F.from_json("value", f"array<struct<{item}>>"))
    rows = whole.select(F.explode(F.coalesce(bare, *[named[c] for c in lists])).alias("i")).select("i.*")
    for field, others in (aliases or {}).items():
        rows = rows.withColumn(field, F.coalesce(field, *others)).drop(*others)
    return rows


def validated(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df``, failing when it is read if a row breaks a rule; a null condition is a breach."""
    for name, rule in rules.items():
        df = df.where(F.assert_true(F.coalesce(rule, F.lit(False)), f"broken: {name}").isNull())
    return df


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(question, passage_id) of a CSV of judged passages whose ``relevant`` says true in any spelling."""
    said = read_csv(spark, path, "question string, passage_id string, relevant string")
    return said.where(F.lower(F.trim("relevant")).isin("true", "1")).select("question", "passage_id").distinct()


def first_rows(spark: SparkSession, path: str, columns: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of a parquet table, only the columns asked for."""
    return spark.read.parquet(path).select(*columns).limit(n)


def read_texts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(text): a field of JSON lines; a line that is no JSON or lacks the field counts as it stands, blank lines do not."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.coalesce(F.get_json_object("value", f"$.{field}"), "value").alias("text"))


def first_existing(spark: SparkSession, paths: list[str], schema: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """JSON lines of the first path that exists (a checked version before the raw one), without some columns; no rows if none does."""
    path = next((p for p in paths if _exists(spark, p)), paths[-1])
    return read_jsonl(spark, path, schema).drop(*drop)


def changed_since(df: DataFrame, since: str) -> DataFrame:
    """Rows of files that changed after a time (timestamp text)."""
    return df.select("*", F.col("_metadata.file_modification_time").alias("changed_at")).where(F.col("changed_at") > F.lit(since).cast("timestamp"))


def page_links(pages: DataFrame, url: str, html: str, prefix: str | None = None) -> DataFrame:
    """(src, dst): distinct links of pages, relative ones completed, fragments cut off, to addresses that begin with ``prefix``."""
    raw = F.explode(F.regexp_extract_all(html, F.lit(r"""(?i)<a\s[^>]*href=["']([^"'#]+)"""), 1))
    host = F.regexp_extract("src", r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace("src", r"[^/]*$", "")
    full = F.when(F.col("l").rlike("^https?://"), F.col("l")).when(F.col("l").startswith("/"), F.concat(host, "l")).otherwise(F.concat(folder, "l"))
    out = pages.select(F.col(url).alias("src"), raw.alias("l")).select("src", full.alias("dst")).distinct()
    return out if prefix is None else out.where(F.col("dst").startswith(prefix))


def with_path_columns(df: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """Columns from groups of a pattern in each row's file path."""
    path = F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def map_rows(df: DataFrame, column: str, value_schema: str, key: str = "id") -> DataFrame:
    """JSON text of a map of structs as rows (key, fields)."""
    parsed = df.withColumn("_m", F.from_json(column, f"map<string, struct<{value_schema}>>"))
    others = [c for c in df.columns if c != column]
    return parsed.select(*others, F.explode("_m").alias(key, "_v")).select(*others, key, "_v.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).csv(path)


def within_bytes(lines: DataFrame, order: list[str], text: str, limit: int) -> DataFrame:
    """Lines in order up to and including the one that crosses ``limit`` bytes of UTF-8."""
    return in_order(lines, order, F.octet_length(text)).where(F.col("before") < limit)


def union_files(frames: dict[str, DataFrame], origin: str = "origin") -> DataFrame:
    """All frames together, missing columns null, ``origin`` defaulting to the frame's name."""
    out = None
    for name, df in frames.items():
        have = F.col(origin) if origin in df.columns else F.lit(None).cast("string")
        part = df.withColumn(origin, F.coalesce(have, F.lit(name)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def release(df: DataFrame, path: str) -> None:
    """A versioned output that is never overwritten: an existing one is an error."""
    df.write.mode("errorifexists").parquet(path)


def write_facts(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_accepted(df: DataFrame, reason: Column, path: str, fine: str = "keep") -> None:
    """Accepted and rejected rows in two outputs, the rejected ones with their reason."""
    tagged = df.withColumn("reason", reason)
    tagged.where(F.col("reason") == fine).drop("reason").write.mode("overwrite").parquet(os.path.join(path, "accepted"))
    tagged.where(F.col("reason") != fine).write.mode("overwrite").parquet(os.path.join(path, "rejected"))


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A sorted list of values as text lines."""
    df.select(F.col(column).cast("string").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_run(answers: DataFrame, debug: DataFrame, asked: DataFrame, key: str, path: str) -> DataFrame:
    """Answers, debug rows and a summary of a run in one folder; nothing is written unless every id asked is answered once. Returns
    the summary (n, empty)."""
    assert_complete(answers, asked, key)
    text_columns = [c for c, k in answers.dtypes if k == "string" and c != key]
    blank = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in text_columns]).isNull() if text_columns else F.lit(False)
    meta = answers.agg(F.count(F.lit(1)).alias("n"), F.sum(blank.cast("bigint")).alias("empty"))
    answers.write.mode("overwrite").json(os.path.join(path, "answers"))
    debug.write.mode("overwrite").json(os.path.join(path, "debug"))
    meta.write.mode("overwrite").json(os.path.join(path, "meta"))
    return answers.sparkSession.read.json(os.path.join(path, "meta"))


def write_with_manifest(df: DataFrame, path: str, by: list[str], sizes: dict[str, Column]) -> DataFrame:
    """Rows partitioned by columns, and a manifest (by, rows, sums of sizes) beside them; returns the manifest."""
    write_split(df, os.path.join(path, "rows"), by)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sizes.items()]
    df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), *sums).write.mode("overwrite").parquet(os.path.join(path, "manifest"))
    return df.sparkSession.read.parquet(os.path.join(path, "manifest"))


def packs(items: DataFrame, pack: str, order: list[str]) -> DataFrame:
    """(pack, json): the items of a pack, which is a sheet of bounded length, as one JSON document in order."""
    fields = [c for c in items.columns if c != pack]
    one = F.struct(*order, F.struct(*fields).alias("item"))
    rows = F.transform(F.array_sort(F.collect_list(one)), lambda x: x["item"])
    return items.groupBy(pack).agg(F.to_json(F.struct(rows.alias("items"))).alias("json"))


def assert_complete(done: DataFrame, asked: DataFrame, key: str) -> None:
    """Fails unless both have the same ids."""
    if asked.select(key).exceptAll(done.select(key)).take(1) or done.select(key).exceptAll(asked.select(key)).take(1):
        raise ValueError("ids differ")
