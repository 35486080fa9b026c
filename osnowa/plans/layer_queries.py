"""Catalogue: grade layers, losses, conditional rates, plans of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layers, planning
from .registry import Tables, query

#: Items as graded rows: the prompt version is the run, the source kind the set.
_GRADED = "SELECT row_id, id, section, type, subtype, source_kind, prompt_version AS run, CASE WHEN NOT coalesce(leak, false) THEN verify.judge_points::DOUBLE END AS p, verify.judge_max::DOUBLE AS m FROM e5_items"


def _graded(t: Tables) -> DataFrame:
    points = layers.valid_points(F.col("verify.judge_points"), F.col("leak"))
    return t.e5_items.select("row_id", "id", "section", "type", "subtype", "source_kind", F.col("prompt_version").alias("run"), points.alias("p"), F.col("verify.judge_max").cast("double").alias("m"))


@query(f"SELECT type, sum(p) AS points, sum(m) AS most, count(*) AS n FROM ({_GRADED}) WHERE p IS NOT NULL GROUP BY type")
def points_of_graded(t: Tables) -> DataFrame:
    return layers.points_by(_graded(t), ["type"], F.col("p"), F.col("m"))


@query(f"SELECT id, count(*) AS n, round(avg(p), 6) AS mean, round(max(m) - avg(p), 6) AS lost FROM ({_GRADED}) WHERE p IS NOT NULL GROUP BY id")
def means_over_repeats(t: Tables) -> DataFrame:
    return layers.item_means(_graded(t), ["id"], F.col("p"), F.col("m")).select("id", "n", F.round("mean", 6).alias("mean"), F.round("lost", 6).alias("lost"))


_MEANS = f"i AS (SELECT source_kind, id, any_value(section) AS section, avg(p) AS mean, max(m) AS most FROM ({_GRADED}) WHERE p IS NOT NULL GROUP BY source_kind, id)"


@query(f"WITH {_MEANS} SELECT source_kind, round(sum(mean), 6) AS got, sum(most) AS most, round(sum(mean) / sum(most), 6) AS share FROM i GROUP BY source_kind")
def group_scores(t: Tables) -> DataFrame:
    means = layers.item_means(_graded(t), ["source_kind", "id"], F.col("p"), F.col("m")).withColumn("most", F.col("mean") + F.col("lost"))
    s = layers.group_score(means, ["source_kind"], "mean", "most")
    return s.select("source_kind", F.round("got", 6).alias("got"), F.round("most", 6).alias("most"), F.round("share", 6).alias("share"))


@query(f"""WITH g AS ({_GRADED}), i AS (SELECT id, avg(p) AS mean, max(m) AS most FROM g WHERE p IS NOT NULL GROUP BY id), c AS (SELECT id, section, count(*) AS n FROM g WHERE section IS NOT NULL GROUP BY 1, 2),
 d AS (SELECT id, section FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, section) AS r FROM c) WHERE r = 1)
 SELECT coalesce(section, '?') AS category, round(sum(most - mean), 6) AS lost, sum(most) AS most FROM i LEFT JOIN d USING (id) GROUP BY 1""")
def loss_by_section(t: Tables) -> DataFrame:
    g = _graded(t)
    means = layers.item_means(g, ["id"], F.col("p"), F.col("m")).join(layers.most_frequent(g, ["id"], "section"), "id", "left")
    lost = layers.loss_by(means, [], F.col("section"), F.col("lost"), F.col("lost") + F.col("mean"))
    return lost.select("category", F.round("lost", 6).alias("lost"), F.round("most", 6).alias("most"))


_ERRORS = f"""e AS (SELECT id, unnest([{{'error': 'form', 'x': CASE WHEN type LIKE 'closed%' THEN m - p ELSE 0 END}}, {{'error': 'content', 'x': CASE WHEN type LIKE 'closed%' THEN 0 ELSE m - p END}}]) AS e FROM ({_GRADED}) WHERE p IS NOT NULL AND type IS NOT NULL),
 n AS (SELECT id, count(*) AS n FROM ({_GRADED}) WHERE p IS NOT NULL AND type IS NOT NULL GROUP BY id), v AS (SELECT id, e.error AS error, sum(e.x) / any_value(n) AS lost FROM e JOIN n USING (id) GROUP BY 1, 2)"""


def _errors(t: Tables) -> DataFrame:
    lost = F.col("m") - F.col("p")
    closed = F.col("type").like("closed%")
    vector = F.create_map(F.lit("form"), F.when(closed, lost).otherwise(0.0), F.lit("content"), F.when(closed, 0.0).otherwise(lost))
    return layers.mean_errors(_graded(t).where("p IS NOT NULL AND type IS NOT NULL").withColumn("e", vector), ["id"], "e")


@query(f"WITH {_ERRORS} SELECT id, error, round(lost, 6) AS lost FROM v")
def mean_error_vectors(t: Tables) -> DataFrame:
    return _errors(t).select("id", "error", F.round("lost", 6).alias("lost"))


@query(f"WITH {_ERRORS} SELECT id, error FROM (SELECT id, error, row_number() OVER (PARTITION BY id ORDER BY lost DESC, error) AS r FROM v) WHERE r = 1")
def dearest_error(t: Tables) -> DataFrame:
    return layers.top_error(_errors(t), ["id"])


_CHAIN = "r(run, base) AS (VALUES ('dokument', NULL), ('opracowanie', 'dokument'), ('tabela', 'opracowanie'), ('ilustracja', 'opracowanie'))"


@query(f"""WITH RECURSIVE {_CHAIN}, x AS (SELECT source_kind AS run, subtype AS item, min(row_id) AS row_id FROM e5_items WHERE source_kind IS NOT NULL AND subtype IS NOT NULL GROUP BY 1, 2),
 k AS (SELECT run, item FROM x WHERE starts_with(item, 'closed') OR run = 'tabela' AND item = 'podaj'),
 c(run, owner, base, distance) AS (SELECT run, run, base, 0 FROM r UNION ALL SELECT c.run, r.run, r.base, distance + 1 FROM c JOIN r ON r.run = c.base),
 q AS (SELECT c.run, k.item, distance, owner FROM c JOIN k ON k.run = c.owner WHERE c.base IS NOT NULL UNION ALL SELECT c.run, x.item, distance, owner FROM c JOIN x ON x.run = c.owner WHERE c.base IS NULL),
 m AS (SELECT run, item, distance, owner FROM (SELECT *, row_number() OVER (PARTITION BY run, item ORDER BY distance, owner) AS n FROM q) WHERE n = 1)
 SELECT m.run, m.item, m.owner, m.distance::INT AS distance, x.row_id FROM m JOIN x ON x.run = m.owner AND x.item = m.item""")
def inherited_rows(t: Tables) -> DataFrame:
    runs = t.spark.createDataFrame([("dokument", None), ("opracowanie", "dokument"), ("tabela", "opracowanie"), ("ilustracja", "opracowanie")], "run string, base string")
    rows = t.e5_items.where("source_kind IS NOT NULL AND subtype IS NOT NULL").groupBy(F.col("source_kind").alias("run"), F.col("subtype").alias("item")).agg(F.min("row_id").alias("row_id"))
    keeps = rows.where("startswith(item, 'closed') OR (run = 'tabela' AND item = 'podaj')").select("run", "item")
    return layers.inherited(runs, keeps, rows).select("run", "item", "owner", "distance", "row_id")


@query("""SELECT source_kind, count(*) AS n, round(avg(CASE WHEN verified THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(CASE WHEN verify.match THEN CASE WHEN verified THEN 1.0 ELSE 0.0 END END), 6) AS rate_given,
 round(avg(CASE WHEN NOT coalesce(verify.match, false) THEN CASE WHEN verified THEN 1.0 ELSE 0.0 END END), 6) AS rate_else FROM e5_items GROUP BY source_kind""")
def rescue_rates(t: Tables) -> DataFrame:
    r = layers.conditional_rates(t.e5_items, ["source_kind"], F.col("verify.match"), F.coalesce("verified", F.lit(False)))
    return r.select("source_kind", "n", *[F.round(c, 6).alias(c) for c in ("rate", "rate_given", "rate_else")])


@query("""SELECT prompt_version, source_kind, CASE WHEN grouping(scope) = 1 THEN 'total' ELSE scope END AS scope, count(*) AS n, round(avg(CASE WHEN verified THEN 1.0 ELSE 0.0 END), 6) AS rate FROM e5_items
 GROUP BY GROUPING SETS ((prompt_version, source_kind, scope), (prompt_version, source_kind))""")
def method_variant_rates(t: Tables) -> DataFrame:
    m = layers.rate_matrix(t.e5_items, ["prompt_version", "source_kind"], "scope", F.coalesce("verified", F.lit(False)))
    return m.select("prompt_version", "source_kind", "scope", "n", F.round("rate", 6).alias("rate"))


@query("SELECT row_id, verify.judge_points AS a, max_points AS b FROM e5_items WHERE verify.judge_points IS DISTINCT FROM max_points")
def disagreement_list(t: Tables) -> DataFrame:
    return layers.disagreements(t.e5_items, "row_id", F.col("verify.judge_points"), F.col("max_points"))


@query("""SELECT prompt_version, count(*) AS n, round(avg(CASE WHEN verify.judge_points = max_points THEN 1.0 ELSE 0.0 END), 6) AS agreement, sum(verify.judge_points)::BIGINT AS sum_a, sum(max_points)::BIGINT AS sum_b FROM e5_items
 WHERE verify.judge_points IS NOT NULL AND max_points IS NOT NULL GROUP BY prompt_version""")
def agreement_sums(t: Tables) -> DataFrame:
    return layers.ratio_agreement(t.e5_items, ["prompt_version"], F.col("verify.judge_points"), F.col("max_points")).withColumn("agreement", F.round("agreement", 6))


@query("SELECT coalesce(nullif(trim(origin), ''), '?') || '/' || coalesce(nullif(trim(type), ''), '?') AS kind, count(*) AS n FROM synthetic_items GROUP BY 1")
def origin_type_counts(t: Tables) -> DataFrame:
    part = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("?"))
    return t.synthetic_items.groupBy(F.concat_ws("/", part("origin"), part("type")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT i.id, i.source_kind, i.p, e.question FROM (SELECT id, source_kind, max(verify.judge_points) AS p FROM e5_items WHERE subtype = 'essay' GROUP BY 1, 2) i JOIN (SELECT id, min(question) AS question FROM e5_items GROUP BY id) e USING (id)""")
def item_dump(t: Tables) -> DataFrame:
    best = t.e5_items.where("subtype = 'essay'").groupBy("id", "source_kind").agg(F.max("verify.judge_points").alias("p"))
    return best.join(t.e5_items.groupBy("id").agg(F.min("question").alias("question")), "id").select("id", "source_kind", "p", "question")


@query("""SELECT event_id, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1)::BIGINT AS before FROM events""")
def running_kind_counts(t: Tables) -> DataFrame:
    from ..operators.windows import ranked

    return ranked(t.events.select("event_id", "event_type"), ["event_type"], ["event_id"]).select("event_id", (F.col("rank") - 1).alias("before"))


# --- plans of work ------------------------------------------------------------------------------------------------------------
_LACK = "l AS (SELECT g.category AS section, g.min_rows * 4 AS wanted, count(k.row_id) AS have FROM (SELECT * FROM e5_targets WHERE dim = 'section') g LEFT JOIN kompendium k ON k.section = g.category GROUP BY 1, 2)"


def _lacks(t: Tables) -> DataFrame:
    wanted = t.e5_targets.where("dim = 'section'").select(F.col("category").alias("section"), (F.col("min_rows") * 4).alias("wanted"))
    return planning.deficits(wanted, "section", "wanted", t.kompendium.where("section IS NOT NULL"))


@query(f"WITH {_LACK} SELECT section, wanted, have, greatest(wanted - have, 0) AS lack FROM l")
def section_deficits(t: Tables) -> DataFrame:
    return _lacks(t)


@query(f"WITH {_LACK}, d AS (SELECT section, greatest(wanted - have, 0) AS lack FROM l) SELECT section, lack, row_number() OVER (ORDER BY lack DESC, section) AS rank FROM d WHERE lack > 0 ORDER BY lack DESC, section LIMIT 10")
def most_lacking_sections(t: Tables) -> DataFrame:
    return planning.most_lacking(_lacks(t), "section", 10)


@query(f"WITH {_LACK}, d AS (SELECT section, greatest(wanted - have, 0) AS lack FROM l) SELECT section, unnest(range(1, ceil(lack / 15)::BIGINT + 1)) AS job FROM d WHERE lack > 0")
def section_jobs(t: Tables) -> DataFrame:
    return planning.jobs(_lacks(t), F.col("lack"), 15).select("section", F.col("job").cast("bigint").alias("job"))


@query("""SELECT s.category AS section, d.category AS difficulty FROM e5_targets s, e5_targets d WHERE s.dim = 'section' AND d.dim = 'difficulty' EXCEPT SELECT DISTINCT section, difficulty FROM e5_items""")
def work_left(t: Tables) -> DataFrame:
    dim = lambda d: t.e5_targets.where(F.col("dim") == d).select(F.col("category").alias(d)).distinct()
    return planning.work_list([dim("section"), dim("difficulty")], t.e5_items)
