"""Catalogue: aggregations, joins, set operations, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import reports, windows
from .registry import Tables, query


# --- aggregations -------------------------------------------------------------------------------------------------------------
@query("""SELECT coalesce(nullif(trim(source), ''), '—') AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1""")
def count_share(t: Tables) -> DataFrame:
    return reports.count_share(t.documents, reports.labelled(F.col("source")))


PRICES = {"view": 0.1, "click": 0.5, "purchase": 2.0, "signup": 1.0, "error": 0.0}


@query("""WITH p(event_type, price) AS (VALUES ('view', 0.1::DOUBLE), ('click', 0.5), ('purchase', 2.0), ('signup', 1.0), ('error', 0.0))
 SELECT coalesce(event_type, 'total') AS stage, count(*) AS calls, round(sum(value * price / 1e6 * 1.2), 6) AS usd FROM events JOIN p USING (event_type) GROUP BY ROLLUP (event_type)""")
def cost_rollup(t: Tables) -> DataFrame:
    prices = t.spark.createDataFrame(list(PRICES.items()), "event_type string, price double")
    priced = t.events.join(F.broadcast(prices), "event_type")
    spent = priced.rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value") * F.col("price") / 1e6 * 1.2), 6).alias("usd"))
    return spent.select(F.coalesce("event_type", F.lit("total")).alias("stage"), "calls", "usd")


@query("""SELECT source_doc, count(*) AS n, sum(CASE WHEN verified THEN 1 ELSE 0 END)::BIGINT AS accepted, round(sum(CASE WHEN verified THEN 1 ELSE 0 END) / count(*), 6) AS rate FROM synthetic_items GROUP BY source_doc""")
def accept_rates(t: Tables) -> DataFrame:
    ok = F.sum(F.when(F.col("verified"), 1).otherwise(0))
    return t.synthetic_items.groupBy("source_doc").agg(F.count(F.lit(1)).alias("n"), ok.alias("accepted"), F.round(reports.ratio(ok, F.count(F.lit(1))), 6).alias("rate"))


@query("""SELECT coalesce(l_returnflag, 'total') AS l_returnflag, coalesce(round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2), 0) AS "F",
 coalesce(round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2), 0) AS "O", round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag)""")
def pivot_totals(t: Tables) -> DataFrame:
    p = reports.pivot_totals(t.lineitem, "l_returnflag", "l_linestatus", ["F", "O"], F.col("l_quantity"))
    return p.select("l_returnflag", *[F.round(c, 2).alias(c) for c in ("F", "O", "total")])


@query("""SELECT CASE WHEN grouping(type) = 1 THEN 'total' ELSE type END AS type, CASE WHEN grouping(split) = 1 THEN 'total' ELSE split END AS split, count(*) AS value
 FROM (SELECT coalesce(nullif(trim(type), ''), '—') AS type, coalesce(nullif(trim(split), ''), '—') AS split FROM synthetic_items) GROUP BY CUBE (type, split)""")
def crosstab_margins(t: Tables) -> DataFrame:
    return reports.crosstab(t.synthetic_items, "type", "split", F.count(F.lit(1)))


@query("""SELECT o_orderstatus, coalesce(o_orderpriority, 'total') AS priority, round(avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))""")
def hit_matrix(t: Tables) -> DataFrame:
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    hit = F.avg(F.when(F.col("o_totalprice") > 200000, 1.0).otherwise(0.0))
    sets = t.orders.groupingSets([[status, priority], [status]], status, priority).agg(F.round(hit, 6).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
    return sets.select("o_orderstatus", F.coalesce("o_orderpriority", F.lit("total")).alias("priority"), "hit_rate", "n")


@query("""WITH a AS (SELECT row_id, verify.judge_points AS points FROM e5_items WHERE verify.judge_points IS NOT NULL), b AS (SELECT row_id, max_points AS points FROM e5_items WHERE verified AND NOT leak)
 SELECT row_id, points, 1 AS layer FROM b UNION ALL SELECT row_id, points, 0 FROM a WHERE row_id NOT IN (SELECT row_id FROM b)""")
def override_merge(t: Tables) -> DataFrame:
    auto = t.e5_items.select("row_id", F.col("verify.judge_points").alias("points")).where("points IS NOT NULL")
    judge = t.e5_items.where("verified AND NOT leak").select("row_id", F.col("max_points").alias("points"))
    return reports.override([auto, judge], ["row_id"])


@query("""SELECT section, CASE WHEN count(*) = count(verify.judge_points) THEN sum(verify.judge_points) ELSE 0 END::BIGINT AS points,
 CASE WHEN count(*) = count(verify.judge_points) THEN sum(verify.judge_max) ELSE 0 END::BIGINT AS most, count(*) = count(verify.judge_points) AS complete FROM e5_items GROUP BY section""")
def need_all_totals(t: Tables) -> DataFrame:
    items = t.e5_items.select("section", F.col("verify.judge_points").alias("p"), F.col("verify.judge_max").alias("m"))
    return reports.all_or_nothing(items, ["section"], "p", "m")


@query("""SELECT type, coalesce(sum(verify.judge_points), 0)::BIGINT AS points, sum(max_points)::BIGINT AS most, count(*) - count(verify.judge_points) AS missing FROM e5_items GROUP BY type""")
def graded_totals(t: Tables) -> DataFrame:
    return reports.graded(t.e5_items.select("type", "max_points", F.col("verify.judge_points").alias("p")), ["type"], "p", "max_points")


@query("""WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2), a AS (SELECT * FROM o WHERE y = 1996), b AS (SELECT * FROM o WHERE y = 1997)
 SELECT count(*) AS n, sum(CASE WHEN b.v > a.v THEN 1 ELSE 0 END)::BIGINT AS better, sum(CASE WHEN b.v < a.v THEN 1 ELSE 0 END)::BIGINT AS worse, round(avg(b.v - a.v), 6) AS mean_delta FROM a JOIN b USING (o_custkey)""")
def paired_deltas(t: Tables) -> DataFrame:
    by = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return reports.paired(by.where("y = 1996"), by.where("y = 1997"), ["o_custkey"], "v")


@query("""WITH f AS (SELECT c_nationkey AS key, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1)
 SELECT coalesce(n_nationkey, key) AS key, coalesce(n, 0) AS n, CASE WHEN n_nationkey IS NULL THEN 'extra' WHEN n IS NULL THEN 'empty' ELSE 'covered' END AS kind FROM nation FULL JOIN f ON key = n_nationkey""")
def coverage_with_zeros(t: Tables) -> DataFrame:
    return reports.coverage(t.nation, "n_nationkey", t.customer.where("c_acctbal > 9900"), "c_nationkey")


@query("""WITH b AS (SELECT section, count(*) AS n FROM kompendium GROUP BY 1), a AS (SELECT section, count(*) AS n FROM timeline GROUP BY 1)
 SELECT coalesce(b.section, a.section) AS section, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM b FULL JOIN a ON a.section = b.section
 WHERE coalesce(b.section, a.section) IS NOT NULL""")
def before_after_table(t: Tables) -> DataFrame:
    return reports.before_after(t.kompendium.where("section IS NOT NULL"), t.timeline.where("section IS NOT NULL"), "section")


@query("""SELECT l_partkey, round(avg(l_discount), 6) AS mean, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3 ORDER BY round(avg(l_discount), 6), l_partkey LIMIT 20""")
def hardest_items(t: Tables) -> DataFrame:
    each = t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_discount"), 6).alias("mean"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    return each.orderBy("mean", "l_partkey").limit(20)


@query("""SELECT event_type, count(*) AS n, sum(CASE WHEN value > 20 THEN 1 ELSE 0 END)::BIGINT AS n_high, round(median(value), 6) AS median, round(median(value) FILTER (WHERE value > 20), 6) AS median_high FROM events GROUP BY 1""")
def run_stats_median(t: Tables) -> DataFrame:
    high = F.col("value") > 20
    return t.events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(high, 1).otherwise(0)).alias("n_high"), F.round(F.median("value"), 6).alias("median"),
        F.round(F.median(F.when(high, F.col("value"))), 6).alias("median_high"),
    )


@query("""SELECT source, (sum(length(text)) // count(*))::BIGINT AS mean_chars FROM documents WHERE text IS NOT NULL GROUP BY source""")
def mean_len_int_div(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").groupBy("source").agg(F.expr("sum(length(text)) DIV count(1)").alias("mean_chars"))


@query("""WITH e AS (SELECT l_suppkey, l_returnflag, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, round(min(v), 6) AS least, round(max(v), 6) AS most FROM e GROUP BY 1)
 SELECT l_suppkey, least, most, CASE WHEN most <= 0.05 THEN 'all_low' ELSE 'apart' END AS kind FROM s WHERE most <= 0.05 OR most - least >= 0.005""")
def range_spread(t: Tables) -> DataFrame:
    return reports.spread(t.lineitem, "l_suppkey", "l_returnflag", "l_discount", 0.05, 0.005)


@query("""SELECT split_part(id, '-', 1) || '-' || split_part(id, '-', 2) AS bundle, string_agg(type, ',' ORDER BY row_id) AS types FROM synthetic_items WHERE type IS NOT NULL GROUP BY 1""")
def group_concat(t: Tables) -> DataFrame:
    bundle = F.concat_ws("-", F.split_part("id", F.lit("-"), F.lit(1)), F.split_part("id", F.lit("-"), F.lit(2)))
    kept = t.synthetic_items.where("type IS NOT NULL").groupBy(bundle.alias("bundle"))
    return kept.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_id", "type"))), lambda x: x["type"]), ",").alias("types"))


@query("""SELECT section, epoch FROM (SELECT section, epoch, row_number() OVER (PARTITION BY section ORDER BY count(*) DESC, epoch) AS rn FROM timeline WHERE epoch IS NOT NULL AND section IS NOT NULL GROUP BY 1, 2) WHERE rn = 1""")
def mode_per_group(t: Tables) -> DataFrame:
    counted = t.timeline.where("epoch IS NOT NULL AND section IS NOT NULL").groupBy("section", "epoch").agg(F.count(F.lit(1)).alias("n"))
    return windows.top_k(counted, ["section"], [F.col("n").desc(), F.col("epoch")], 1).select("section", "epoch")


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN sum(l_quantity) OVER (PARTITION BY l_orderkey) <> 0 THEN l_quantity * 10.0 / sum(l_quantity) OVER (PARTITION BY l_orderkey) ELSE 0.0 END, 6) AS part FROM lineitem""")
def loss_allocation(t: Tables) -> DataFrame:
    l = t.lineitem.withColumn("lost", F.lit(10.0))  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", F.round(reports.allocate(l, ["l_orderkey"], "l_quantity", "lost"), 6).alias("part"))


@query("""SELECT source_kind, count(*) AS n, round(avg(CASE WHEN verify.match = verified THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM e5_items WHERE verify.match IS NOT NULL AND verified IS NOT NULL GROUP BY 1""")
def agreement_rate(t: Tables) -> DataFrame:
    both = t.e5_items.select("source_kind", F.col("verify.match").alias("m"), "verified").where("m IS NOT NULL AND verified IS NOT NULL")
    return both.groupBy("source_kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("m") == F.col("verified"), 1.0).otherwise(0.0)), 6).alias("agreement"))


@query("""SELECT l_shipmode_ AS flag, min(v) AS least, list_sort(list(v))[len(list(v)) // 2 + 1] AS upper_median, max(v) AS most FROM (SELECT l_returnflag AS l_shipmode_, l_extendedprice AS v FROM lineitem) GROUP BY 1""")
def upper_median(t: Tables) -> DataFrame:
    # the element in the middle by rank; three groups hold the whole table, so ranks go by parts of a group
    v = t.lineitem.select("l_returnflag", F.col("l_extendedprice").alias("v"), "l_orderkey", "l_linenumber")
    r = windows.ranked(v, ["l_returnflag"], ["v", "l_orderkey", "l_linenumber"])
    return r.groupBy(F.col("l_returnflag").alias("flag")).agg(F.min("v").alias("least"), F.max(F.when(F.expr("rank = size DIV 2 + 1"), F.col("v"))).alias("upper_median"), F.max("v").alias("most"))


@query(r"""WITH w AS (SELECT CASE WHEN lower(lang) = 'pl' THEN 1.0 WHEN lower(lang) = 'en' THEN 0.25 ELSE 0.0 END::DOUBLE AS k, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents)
 SELECT token, count(*) AS n, round(sum(k), 2) AS weighted FROM w GROUP BY token ORDER BY weighted DESC, token LIMIT 200""")
def weighted_tokens(t: Tables) -> DataFrame:
    k = F.when(F.lower("lang") == "pl", 1.0).when(F.lower("lang") == "en", 0.25).otherwise(0.0)
    w = t.documents.select(k.alias("k"), F.explode(text.words(F.col("text"))).alias("token"))
    return w.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("k"), 2).alias("weighted")).orderBy(F.col("weighted").desc(), "token").limit(200)


@query(r"""WITH c AS (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS token FROM documents) GROUP BY 1) SELECT count(*) AS tokens, sum(n)::BIGINT AS occurrences, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END)::BIGINT AS once FROM c""")
def token_histogram(t: Tables) -> DataFrame:
    c = t.documents.select(F.explode(text.words(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("occurrences"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"))


@query("""SELECT count(*) > 100 AS enough, avg(CASE WHEN verified THEN 1.0 ELSE 0.0 END) > 0.5 AS verified, count(DISTINCT section) > 5 AS spread,
 count(*) > 100 AND avg(CASE WHEN verified THEN 1.0 ELSE 0.0 END) > 0.5 AND count(DISTINCT section) > 5 AS passed FROM e5_items""")
def gate(t: Tables) -> DataFrame:
    checks = t.e5_items.agg((F.count(F.lit(1)) > 100).alias("enough"), (F.avg(F.when(F.col("verified"), 1.0).otherwise(0.0)) > 0.5).alias("verified"), (F.countDistinct("section") > 5).alias("spread"))
    return checks.withColumn("passed", F.col("enough") & F.col("verified") & F.col("spread"))


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN verify_note IS NULL OR verify_note = '' THEN '—' WHEN starts_with(verify_note, 'format') OR strpos(substring(verify_note, 1, 40), 'format') > 0 THEN 'format'
 WHEN strpos(lower(verify_note), 'leak') > 0 THEN 'leak' ELSE 'other' END AS reason FROM synthetic_items) GROUP BY 1""")
def reason_buckets(t: Tables) -> DataFrame:
    note = F.col("verify_note")
    r = F.when(note.isNull() | (note == ""), "—").when(note.startswith("format") | F.substring(note, 1, 40).contains("format"), "format").when(F.lower(note).contains("leak"), "leak").otherwise("other")
    return t.synthetic_items.groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT id, count(DISTINCT model_answer) = 1 AS unanimous, count(*) AS n, count(*) - count(model_answer) AS unread FROM synthetic_items WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1""")
def unanimity(t: Tables) -> DataFrame:
    return t.synthetic_items.where("id IS NOT NULL").groupBy("id").agg(
        (F.countDistinct("model_answer") == 1).alias("unanimous"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("model_answer")).alias("unread")
    ).where("n > 1")


# --- joins --------------------------------------------------------------------------------------------------------------------
@query("""WITH a AS (SELECT section, subtopic, min(title) AS v FROM kompendium GROUP BY 1, 2), b AS (SELECT subtopic, min(title) AS v FROM kompendium GROUP BY 1), c AS (SELECT section, min(title) AS v FROM kompendium GROUP BY 1)
 SELECT s.row_id, coalesce(a.v, b.v, c.v) AS title FROM synthetic_items s LEFT JOIN a ON a.section = s.section AND a.subtopic = s.subtopic LEFT JOIN b ON b.subtopic = s.subtopic LEFT JOIN c ON c.section = s.section""")
def fallback_lookup(t: Tables) -> DataFrame:
    k = t.kompendium
    facts = t.synthetic_items.select("row_id", "section", "subtopic")
    return reports.with_fallbacks(facts, [(k, ["section", "subtopic"]), (k, ["subtopic"]), (k, ["section"])], "title").select("row_id", "title")


@query("""SELECT s.row_id, coalesce(k.points, 0)::BIGINT AS points, k.row_id IS NULL AS missing FROM synthetic_items s LEFT JOIN (SELECT row_id, max_points AS points FROM e5_items WHERE verified) k ON k.row_id = s.row_id""")
def answers_left_join(t: Tables) -> DataFrame:
    graded = t.e5_items.where("verified").select(F.col("row_id").alias("r"), F.col("max_points").alias("points"))
    joined = t.synthetic_items.join(graded, F.col("row_id") == F.col("r"), "left")
    return joined.select("row_id", F.coalesce("points", F.lit(0)).cast("bigint").alias("points"), F.col("r").isNull().alias("missing"))


EPOCHS = [(-5000, 476, "antiquity"), (476, 1492, "medieval"), (1492, 1815, "early modern"), (1815, 1914, "nineteenth"), (1914, 1946, "wars"), (1946, 3000, "recent")]


@query("""WITH r(low, high, label) AS (VALUES (-5000, 476, 'antiquity'), (476, 1492, 'medieval'), (1492, 1815, 'early modern'), (1815, 1914, 'nineteenth'), (1914, 1946, 'wars'), (1946, 3000, 'recent'))
 SELECT row_id, label FROM timeline LEFT JOIN r ON year >= low AND year < high""")
def year_to_epoch(t: Tables) -> DataFrame:
    ranges = t.spark.createDataFrame(EPOCHS, "low int, high int, label string")
    return reports.in_ranges(t.timeline.select("row_id", "year"), F.col("year"), ranges).select("row_id", "label")


@query(r"""WITH y AS (SELECT doc_id, unnest(regexp_extract_all(text, '([0-9]{3,4}) r\.', 1))::INT AS y FROM documents), r(low, high, label) AS (VALUES (-5000, 476, 'antiquity'), (476, 1492, 'medieval'),
 (1492, 1815, 'early modern'), (1815, 1914, 'nineteenth'), (1914, 1946, 'wars'), (1946, 3000, 'recent')), m AS (SELECT doc_id, median(y) AS y FROM y GROUP BY 1) SELECT doc_id, label FROM m JOIN r ON y >= low AND y < high""")
def epoch_of_documents(t: Tables) -> DataFrame:
    ranges = t.spark.createDataFrame(EPOCHS, "low int, high int, label string")
    years = t.documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"([0-9]{3,4}) r\."), 1)).alias("y")).select("doc_id", F.col("y").cast("int").alias("y"))
    return reports.in_ranges(years.groupBy("doc_id").agg(F.median("y").alias("y")), F.col("y"), ranges).where("label IS NOT NULL").select("doc_id", "label")


@query("""WITH g AS (SELECT id FROM synthetic_items WHERE split = 'train'), a AS (SELECT DISTINCT id FROM synthetic_items WHERE verified)
 SELECT DISTINCT id, 'unknown' AS error FROM g WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT id, 'missing' FROM a WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'duplicate' FROM g GROUP BY id HAVING count(*) > 1""")
def contract_errors(t: Tables) -> DataFrame:
    s = t.synthetic_items
    return reports.contract_errors(s.where("split = 'train'"), "id", s.where("verified"), "id")


@query(r"""WITH a AS (SELECT row_id, id, trim(regexp_replace(model_answer, '\s+', ' ', 'g')) AS a, verified FROM synthetic_items WHERE model_answer IS NOT NULL),
 g AS (SELECT id, a, min(row_id) AS src FROM a WHERE verified GROUP BY 1, 2) SELECT a.row_id, g.src AS reused_from FROM a JOIN g ON g.id = a.id AND g.a = a.a WHERE NOT coalesce(a.verified, false) AND g.src <> a.row_id""")
def content_reuse(t: Tables) -> DataFrame:
    a = t.synthetic_items.where("model_answer IS NOT NULL").select("row_id", "id", text.squeeze(F.col("model_answer")).alias("a"), F.coalesce("verified", F.lit(False)).alias("v"))
    done = a.where("v").groupBy("id", "a").agg(F.min("row_id").alias("reused_from"))
    return a.where("NOT v").join(done, ["id", "a"]).where("reused_from <> row_id").select("row_id", "reused_from")


@query("""SELECT n_nationkey, s.mktsegment FROM nation CROSS JOIN (SELECT DISTINCT c_mktsegment AS mktsegment FROM customer) s WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = s.mktsegment AND c_acctbal > 5000)""")
def missing_combinations(t: Tables) -> DataFrame:
    seg = t.customer.select(F.col("c_mktsegment").alias("mktsegment")).distinct()
    done = t.customer.where("c_acctbal > 5000").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("mktsegment")).distinct()
    return t.nation.select("n_nationkey").crossJoin(seg).join(done, ["n_nationkey", "mktsegment"], "left_anti")  # two dimensions


@query("""SELECT section FROM (SELECT section FROM timeline UNION SELECT section FROM kompendium) EXCEPT SELECT section FROM e5_items""")
def union_except(t: Tables) -> DataFrame:
    return t.timeline.select("section").union(t.kompendium.select("section")).distinct().exceptAll(t.e5_items.select("section").distinct())


@query("""SELECT section FROM timeline INTERSECT SELECT section FROM kompendium""")
def section_intersection(t: Tables) -> DataFrame:
    return t.timeline.select("section").intersect(t.kompendium.select("section"))


@query("""SELECT row_id FROM synthetic_items WHERE section IN (SELECT section FROM exam_sections) """.replace("exam_sections", "(SELECT section FROM kompendium WHERE words > 150)"))
def semi_join_sections(t: Tables) -> DataFrame:
    return t.synthetic_items.join(t.kompendium.where("words > 150").select("section").distinct(), "section", "left_semi").select("row_id")


# --- windows ------------------------------------------------------------------------------------------------------------------
@query("""SELECT event_id, coalesce(last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '?') AS state FROM events""")
def forward_fill(t: Tables) -> DataFrame:
    known = t.events.withColumn("state", F.when(F.col("event_type") == "error", "?").otherwise(F.col("event_type")))
    return windows.forward_fill(known, "state", ["user_id"], ["ts", "event_id"]).select("event_id", "state")


@query("""SELECT doc_id FROM (SELECT doc_id, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before < 200000""")
def running_cap_exclusive(t: Tables) -> DataFrame:
    return windows.within_cap(t.documents.select("doc_id", F.length("text").cast("bigint").alias("n")), ["doc_id"], F.col("n"), 200_000).select("doc_id")


@query("""SELECT event_id FROM (SELECT event_id, sum(value) OVER (ORDER BY event_id) AS s FROM events) WHERE s <= 50000 + 1e-6""")
def budget_running_sum(t: Tables) -> DataFrame:
    ran = windows.in_order(t.events.select("event_id", "value"), ["event_id"], F.col("value"))
    return ran.where("before + value <= 50000 + 1e-6").select("event_id")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events""")
def total_order_numbers(t: Tables) -> DataFrame:
    return windows.in_order(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "position")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, l, unnest(range(0, len(l), 3)) AS i FROM l)
 SELECT doc_id, i::BIGINT AS start, array_to_string(list_slice(l, i + 1, i + 5), chr(10)) AS chunk FROM s WHERE i = 0 OR i - 3 + 5 < len(l)""")
def overlap_chunks(t: Tables) -> DataFrame:
    l = t.documents.where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))  # noqa: E741
    s = l.select("doc_id", "l", F.explode(windows.chunk_starts(F.size("l"), 5, 3)).alias("i"))
    return s.select("doc_id", F.col("i").cast("bigint").alias("start"), F.array_join(F.slice("l", F.col("i") + 1, F.lit(5)), "\n").alias("chunk"))


@query("""SELECT user_id, batch, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids FROM (SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25)::BIGINT AS batch FROM events) GROUP BY 1, 2""")
def fixed_batches(t: Tables) -> DataFrame:
    b = windows.batches(t.events, ["user_id"], ["event_id"], 25, "event_id")
    return b.select("user_id", "batch", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn <= 4""")
def last_n_per_user(t: Tables) -> DataFrame:
    return windows.last_n(t.events.select("user_id", "event_id"), ["user_id"], ["event_id"], 4)


@query("""SELECT row_id, type || '-' || lpad((row_number() OVER (PARTITION BY type ORDER BY row_id))::VARCHAR, 5, '0') AS new_id FROM e5_items WHERE type IS NOT NULL""")
def numbered_ids(t: Tables) -> DataFrame:
    return windows.numbered_ids(t.e5_items.where("type IS NOT NULL"), "type", ["row_id"]).select("row_id", "new_id")


@query("""SELECT row_id, row_number() OVER (PARTITION BY section ORDER BY row_id) AS turn FROM kompendium""")
def round_robin_turns(t: Tables) -> DataFrame:
    return windows.round_robin(t.kompendium, "section", ["row_id"]).select("row_id", F.col("turn").cast("bigint").alias("turn"))


@query("""SELECT doc_id, ['a','b','c','d','e'][((row_number() OVER (ORDER BY doc_id) - 1) % 5 + 1)::INT] AS slot FROM documents""")
def cyclic_slots(t: Tables) -> DataFrame:
    return windows.in_order(t.documents.select("doc_id"), ["doc_id"]).select("doc_id", windows.cyclic(F.col("position"), list("abcde")).alias("slot"))


@query("""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY section ORDER BY row_id) > 1 AS more FROM e5_items) ORDER BY more, row_id LIMIT 60""")
def one_each_then_fill(t: Tables) -> DataFrame:
    return windows.one_each_then_fill(t.e5_items.select("row_id", "section"), "section", ["row_id"], 60).select("row_id")


@query("""WITH w AS (SELECT n_nationkey AS k, (n_nationkey % 7 + 1)::DOUBLE AS w FROM nation), r AS (SELECT k, w, w * 100 / sum(w) OVER () AS raw FROM w),
 x AS (SELECT k, w, floor(raw)::BIGINT AS f, row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, w DESC, k) AS rn FROM r) SELECT k, w, f + CASE WHEN rn <= 100 - (SELECT sum(f) FROM x) THEN 1 ELSE 0 END AS seats FROM x""")
def largest_remainder(t: Tables) -> DataFrame:
    weights = t.nation.select(F.col("n_nationkey").alias("k"), (F.col("n_nationkey") % 7 + 1).cast("double").alias("w"))
    return windows.largest_remainder(weights, "k", "w", 100)


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 3 = 1""")
def every_third(t: Tables) -> DataFrame:
    return windows.in_order(t.documents.select("doc_id"), ["doc_id"]).where("pmod(position - 1, 3) = 1").select("doc_id")


@query("""SELECT user_id, list_sort(list(value))[floor((count(*) - 1) * 0.975)::INT + 1] AS p FROM events GROUP BY 1""")
def nth_percentile(t: Tables) -> DataFrame:
    r = windows.ranked(t.events.select("user_id", "value", "event_id"), ["user_id"], ["value", "event_id"])
    return r.where("rank = floor((size - 1) * 0.975D) + 1").select("user_id", F.col("value").alias("p"))


@query("""SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(*) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1""")
def plurality_vote(t: Tables) -> DataFrame:
    return windows.plurality(t.events, ["user_id"], "event_type", "event_id")


@query("""SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment FROM events""")
def header_segments(t: Tables) -> DataFrame:
    return windows.segments(t.events, F.col("event_type") == "signup", ["user_id"], ["ts", "event_id"]).select("event_id", "segment")


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS rn FROM c),
 b AS (SELECT user_id, max(CASE WHEN rn = 1 THEN event_type END) AS event_type, max(CASE WHEN rn = 1 THEN n END) AS best, coalesce(max(CASE WHEN rn = 2 THEN n END), 0) AS second FROM r GROUP BY 1)
 SELECT user_id, CASE WHEN best >= 3 AND best >= 1.2 * second + 1 THEN event_type END AS event_type, best, second FROM b""")
def clear_winner(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return windows.clear_winner(c, ["user_id"], "event_type", "n", 3, 1.2, 1)


@query("""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id::VARCHAR), doc_id) AS rn, count(*) OVER () AS n FROM documents) WHERE rn <= greatest(1, floor(n * 0.03))""")
def hash_order_split(t: Tables) -> DataFrame:
    h = t.documents.select("doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("h"))
    n = max(1, int(t.documents.count() * 0.03))
    return windows.in_order(h, ["h", "doc_id"]).where(F.col("position") <= n).select("doc_id")


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def windowed_counts(t: Tables) -> DataFrame:
    from ..streaming.incremental import windowed_counts as counts

    return counts(t.events, "ts", "event_type", "1 hour", "10 minutes")


@query("""SELECT row_id, year, title FROM timeline WHERE year IS NOT NULL ORDER BY year DESC, row_id LIMIT 50""")
def multi_key_top(t: Tables) -> DataFrame:
    return t.timeline.where("year IS NOT NULL").select("row_id", "year", "title").orderBy(F.col("year").desc(), "row_id").limit(50)


@query("""SELECT section, arg_max(row_id, (words, -row_id)) AS row_id FROM kompendium WHERE words IS NOT NULL AND section IS NOT NULL GROUP BY section""")
def argmax_tuple(t: Tables) -> DataFrame:
    k = t.kompendium.where("words IS NOT NULL AND section IS NOT NULL")
    return k.groupBy("section").agg(F.max_by("row_id", F.struct("words", (-F.col("row_id")).alias("r"))).alias("row_id"))
