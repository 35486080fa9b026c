"""Catalogue: routing, guarded merges, spatial and positional joins, conversation and array shapes, stratified draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval, shapes, windows
from .registry import Tables, query
from .retrieval_queries import _BM25, _TERMS, _bm25
from .text_queries import STOP

_STOP = "['" + "','".join(STOP) + "']"


@query("""SELECT doc_id, trim(split_part(text, 'assistant:', 1)) AS prompt, trim(split_part(text, 'assistant:', 2)) AS completion FROM documents WHERE len(string_split(text, 'assistant:')) = 2""")
def conversation_split(t: Tables) -> DataFrame:
    chat = t.documents.select("doc_id", F.split("text", "assistant:").alias("p")).where(F.size("p") == 2)
    return chat.select("doc_id", F.trim(F.col("p")[0]).alias("prompt"), F.trim(F.col("p")[1]).alias("completion"))


RULES = [(1, "closed", None, "short"), (2, None, "Polska", "local"), (3, "open", None, "long"), (4, None, None, "rest")]


@query("""WITH r(ord, kind, scope, route) AS (VALUES (1, 'closed', NULL, 'short'), (2, NULL, 'Polska', 'local'), (3, 'open', NULL, 'long'), (4, NULL, NULL, 'rest'))
 SELECT row_id, route FROM (SELECT row_id, route, row_number() OVER (PARTITION BY row_id ORDER BY ord) AS rn FROM e5_items JOIN r ON (r.kind IS NULL OR starts_with(type, r.kind)) AND (r.scope IS NULL OR e5_items.scope = r.scope)) WHERE rn = 1""")
def route_match(t: Tables) -> DataFrame:
    return shapes.first_route(t.e5_items, {"kind": ("type", "prefix"), "scope": ("scope", "equal")}, RULES, ["kind", "scope"]).select("row_id", "route")


@query("""SELECT row_id FROM kompendium WHERE strpos(section, 'wojn') > 0 OR strpos(section, 'Wielk') > 0 OR strpos(section, 'unii') > 0""")
def substring_any(t: Tables) -> DataFrame:
    return t.kompendium.where(shapes.contains_any(F.col("section"), ["wojn", "Wielk", "unii"])).select("row_id")


@query("""SELECT row_id FROM e5_items e WHERE NOT EXISTS (SELECT 1 FROM (VALUES ('closed_tf', 'dokument'), ('open', 'ilustracja')) x(a, b) WHERE e.type = a AND e.source_kind = b)""")
def exclusion_list(t: Tables) -> DataFrame:
    out = t.spark.createDataFrame([("closed_tf", "dokument"), ("open", "ilustracja")], "type string, source_kind string")
    return t.e5_items.join(F.broadcast(out), ["type", "source_kind"], "left_anti").select("row_id")


@query("""WITH o AS (SELECT exam || ':' || id AS k, solution FROM exam WHERE max_points = 2) SELECT e.row_id, coalesce(o.solution, e.model_answer) AS answer FROM exam e LEFT JOIN o ON o.k = e.exam || ':' || e.id""")
def sparse_override(t: Tables) -> DataFrame:
    key = F.concat_ws(":", "exam", "id")
    over = t.exam.where("max_points = 2").select(key.alias("k"), F.col("solution").alias("s"))
    return t.exam.withColumn("k", key).join(over, "k", "left").select("row_id", F.coalesce("s", "model_answer").alias("answer"))


@query("""SELECT row_id, CASE WHEN leak THEN verify.judge_points ELSE max_points END AS chosen, greatest(verify.judge_points, max_points) AS best FROM e5_items WHERE verify IS NOT NULL""")
def value_choice(t: Tables) -> DataFrame:
    j = F.col("verify.judge_points")
    return t.e5_items.where("verify IS NOT NULL").select("row_id", F.when(F.col("leak"), j).otherwise(F.col("max_points")).alias("chosen"), F.greatest(j, "max_points").alias("best"))


@query("""SELECT coalesce(a.row_id, b.row_id) AS row_id, coalesce(b.p, a.p) AS p FROM (SELECT row_id, verify.judge_points AS p FROM e5_items WHERE verify.judge_points IS NOT NULL) a
 FULL JOIN (SELECT row_id, CASE WHEN verified THEN max_points END AS p FROM e5_items WHERE leak IS NOT NULL) b ON a.row_id = b.row_id""")
def guarded_merge(t: Tables) -> DataFrame:
    a = t.e5_items.select("row_id", F.col("verify.judge_points").alias("p")).where("p IS NOT NULL")
    b = t.e5_items.where("leak IS NOT NULL").select("row_id", F.when(F.col("verified"), F.col("max_points")).alias("p"))
    return shapes.merge_known(a, b, ["row_id"], "p")


@query(r"""SELECT row_id FROM timeline WHERE title IS NOT NULL AND text IS NOT NULL AND list_has_any(list_transform(regexp_extract_all(lower(title), '[\p{L}\p{N}_]{5,}'), lambda x: substring(x, 1, 6)),
 list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{5,}'), lambda x: substring(x, 1, 6)))""")
def stems_overlap(t: Tables) -> DataFrame:
    s = lambda c: F.transform(text.words(F.col(c), r"[\p{L}\p{N}_]{5,}"), lambda w: F.substring(w, 1, 6))
    return t.timeline.where("title IS NOT NULL AND text IS NOT NULL").where(F.arrays_overlap(s("title"), s("text"))).select("row_id")


@query("""WITH b AS (SELECT p_partkey AS block, (p_partkey * 13 % 1000)::DOUBLE AS x, (p_size * 20)::DOUBLE AS y FROM part), i AS (SELECT s_suppkey AS box, (s_suppkey * 7 % 1000)::DOUBLE AS x, (s_nationkey * 40)::DOUBLE AS y FROM supplier)
 SELECT box, count(*) AS blocks, min(block) AS first_block FROM i JOIN b ON b.x BETWEEN i.x - 150 AND i.x + 150 AND b.y BETWEEN i.y - 140 AND i.y + 70 GROUP BY box""")
def spatial_range_join(t: Tables) -> DataFrame:
    blocks = t.part.select(F.col("p_partkey").alias("block"), (F.col("p_partkey") * 13 % 1000).cast("double").alias("x"), (F.col("p_size") * 20).cast("double").alias("y"))
    boxes = t.supplier.select(F.col("s_suppkey").alias("box"), (F.col("s_suppkey") * 7 % 1000).cast("double").alias("x"), (F.col("s_nationkey") * 40).cast("double").alias("y"))
    return shapes.counts_within_box(boxes, blocks, "box", "block", dx=150, up=140, down=70)


@query("""WITH g AS (SELECT DISTINCT section FROM timeline WHERE section IS NOT NULL AND section NOT IN (SELECT section FROM kompendium WHERE section IS NOT NULL)),
 s AS (SELECT section, 8 - count(*) AS need FROM kompendium WHERE section IS NOT NULL GROUP BY section HAVING count(*) < 8)
 SELECT section, 'gap' AS kind, 8 AS need FROM g UNION ALL SELECT section, 'supplement', need FROM s WHERE NOT EXISTS (SELECT 1 FROM g)""")
def gaps_or_supplement(t: Tables) -> DataFrame:
    have = t.kompendium.where("section IS NOT NULL")
    gaps = t.timeline.where("section IS NOT NULL").select("section").distinct().join(have.select("section").distinct(), "section", "left_anti")
    more = have.groupBy("section").agg((F.lit(8) - F.count(F.lit(1))).alias("need")).where("need > 0")
    return shapes.first_or_else(gaps.select("section", F.lit("gap").alias("kind"), F.lit(8).cast("bigint").alias("need")), more.select("section", F.lit("supplement").alias("kind"), "need"))


@query("""WITH w AS (SELECT row_id, (row_number() OVER (PARTITION BY section ORDER BY row_id) - 1) AS i, section FROM kompendium WHERE section IS NOT NULL), v AS (SELECT section, i, 'ok' AS verdict FROM w WHERE i % 3 = 0)
 SELECT w.row_id, coalesce(v.verdict, 'unchecked') AS verdict FROM w LEFT JOIN v ON v.section = w.section AND v.i = w.i""")
def positional_verdicts(t: Tables) -> DataFrame:
    w = t.kompendium.where("section IS NOT NULL").select("row_id", "section", (F.row_number().over(Window.partitionBy("section").orderBy("row_id")) - 1).alias("i"))
    v = w.where("i % 3 = 0").select("section", "i", F.lit("ok").alias("verdict"))
    return w.join(v, ["section", "i"], "left").select("row_id", F.coalesce("verdict", F.lit("unchecked")).alias("verdict"))


@query("""SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey, round(c_acctbal / 100) ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1""")
def rounded_dedup(t: Tables) -> DataFrame:
    keyed = t.customer.select("c_custkey", "c_nationkey", F.round(F.col("c_acctbal") / 100).alias("r"))
    return windows.first_of(keyed, ["c_nationkey", "r"], ["c_custkey"]).select("c_custkey")


@query("""SELECT level, count(*) AS n, count(DISTINCT row_id) AS items FROM (SELECT row_id, split_part(unnest(kb_facts), ' – ', 2) AS level FROM e5_items) GROUP BY level""")
def nested_histogram(t: Tables) -> DataFrame:
    facts = t.e5_items.select("row_id", F.explode("kb_facts").alias("f")).select("row_id", F.split_part("f", F.lit(" – "), F.lit(2)).alias("level"))
    return facts.groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_id").alias("items"))


@query(r"""WITH r AS (SELECT row_id, regexp_extract_all(rubric, '([0-9]+) pkt – ([^.]+)', 1) AS p, regexp_extract_all(rubric, '([0-9]+) pkt – ([^.]+)', 2) AS d FROM exam WHERE rubric IS NOT NULL)
 SELECT row_id, unnest(range(0, len(p)))::INT AS pos, unnest(p)::INT AS points, unnest(d) AS rule FROM r""")
def rubric_sections(t: Tables) -> DataFrame:
    pattern = F.lit("([0-9]+) pkt – ([^.]+)")
    both = F.arrays_zip(F.regexp_extract_all("rubric", pattern, 1).alias("p"), F.regexp_extract_all("rubric", pattern, 2).alias("d"))
    r = t.exam.where("rubric IS NOT NULL").select("row_id", F.posexplode(both).alias("pos", "x"))
    return r.select("row_id", "pos", F.col("x.p").cast("int").alias("points"), F.col("x.d").alias("rule"))


@query("""SELECT row_id, title || CASE WHEN date_text IS NOT NULL AND strpos(title, date_text) = 0 THEN ', ' || date_text ELSE '' END || CASE WHEN epoch IS NOT NULL AND strpos(title, epoch) = 0 THEN ', ' || epoch ELSE '' END AS caption FROM timeline WHERE title IS NOT NULL""")
def captions(t: Tables) -> DataFrame:
    return t.timeline.where("title IS NOT NULL").select("row_id", shapes.caption(F.col("title"), [F.col("date_text"), F.col("epoch")]).alias("caption"))


@query(r"""SELECT doc_id, regexp_matches(lower(text), 'obraz|ilustracj|fotografi|map[aęiy]|rycin') AS image FROM documents WHERE text IS NOT NULL""")
def image_mentions(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.lower("text").rlike("obraz|ilustracj|fotografi|map[aęiy]|rycin").alias("image"))


@query("""SELECT doc_id, CASE WHEN strpos(text, 'Menu | Dzieje | Szukaj') > 0 THEN substring(text, 1, strpos(text, 'Menu | Dzieje | Szukaj') + 21) || ' [x]' || substring(text, strpos(text, 'Menu | Dzieje | Szukaj') + 22) ELSE text || chr(10) || '[x]' END AS text
 FROM documents WHERE text IS NOT NULL""")
def block_inserted(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", shapes.insert_after(F.col("text"), "Menu | Dzieje | Szukaj", " [x]", "\n[x]").alias("text"))


@query("""SELECT row_id, array_to_string(list_concat(list_slice(kb_facts, 1, (row_id % (len(kb_facts) + 1))::INT), ['GOLD'], list_slice(kb_facts, (row_id % (len(kb_facts) + 1))::INT + 1, len(kb_facts))), ' | ') AS context FROM e5_items WHERE kb_facts IS NOT NULL""")
def gold_inserted(t: Tables) -> DataFrame:
    at = (F.col("row_id") % (F.size("kb_facts") + 1) + 1).cast("int")
    return t.e5_items.where("kb_facts IS NOT NULL").select("row_id", F.array_join(F.array_insert("kb_facts", at, F.lit("GOLD")), " | ").alias("context"))


@query("""SELECT row_id, array_to_string(list_sort(list_transform(list_filter(map_entries(key), lambda e: e.value <> 'F'), lambda e: e.key || '=' || e.value)), ',') AS kept FROM exam WHERE key IS NOT NULL""")
def map_filtered(t: Tables) -> DataFrame:
    kept = F.map_filter("key", lambda k, v: v != "F")
    return t.exam.where("key IS NOT NULL").select("row_id", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("kept"))


@query(f"""WITH {_BM25}, h AS (SELECT k.query, k.rank, (SELECT bool_and(strpos(lower(d.text), x) > 0) FROM (SELECT unnest(list_slice(list_distinct_ordered, 1, 2)) AS x)) AS hit FROM k JOIN kompendium d ON d.row_id = k.row
 JOIN (SELECT row_id, list_transform(list_filter(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 7), lambda x: substring(x, 1, 6)) AS list_distinct_ordered FROM exam) e ON e.row_id = k.query
 WHERE k.rank <= 3 AND len(e.list_distinct_ordered) >= 2) SELECT query, bool_or(coalesce(hit, false)) AS hit FROM h GROUP BY query""")
def hit_test(t: Tables) -> DataFrame:
    terms = F.transform(F.filter(text.words(F.col("question")), lambda w: F.length(w) >= 7), lambda w: F.substring(w, 1, 6))
    asked = t.exam.select(F.col("row_id").alias("query"), terms.alias("k")).where(F.size("k") >= 2)
    notes = t.kompendium.select(F.col("row_id").alias("row"), F.lower("text").alias("x"))
    both = _bm25(t, 3).join(asked, "query").join(notes, "row")
    hit = F.forall(F.slice("k", 1, 2), lambda w: F.contains(F.col("x"), w))
    return both.groupBy("query").agg(F.max(F.coalesce(hit, F.lit(False))).alias("hit"))


@query(f"""WITH {_BM25}, c AS (SELECT query, round(sum(score), 6) AS cover FROM k WHERE rank <= 3 GROUP BY query) SELECT type, arg_max(query, (round(cover, 4), -query)) AS query FROM c JOIN exam ON row_id = query GROUP BY type""")
def best_covered_item(t: Tables) -> DataFrame:
    cover = _bm25(t, 3).groupBy("query").agg(F.round(F.sum("score"), 6).alias("cover")).join(t.exam.select(F.col("row_id").alias("query"), "type"), "query")
    return cover.groupBy("type").agg(F.max_by("query", F.struct(F.round("cover", 4), (-F.col("query")).alias("q"))).alias("query"))


_TOPICS = _BM25.replace(_BM25[_BM25.index(" q AS (") : _BM25.index(", s AS (")], " e AS (SELECT row_id, regexp_extract_all(question, '(?m)^[0-9]+\\. (.+)$', 1) AS t FROM exam WHERE type = 'essay'), y AS (SELECT row_id * 100 + i - 1 AS query, t[i] AS topic FROM (SELECT row_id, t, unnest(range(1, len(t) + 1)) AS i FROM e)), q AS (SELECT query, unnest(" + _TERMS.format("topic") + ") AS term FROM y)")


@query(f"WITH {_TOPICS} SELECT query, row, round(score, 6) AS score, rank FROM k WHERE rank <= 4")
def topics_retrieved(t: Tables) -> DataFrame:
    """One query per numbered topic of an essay item, the first four notes each."""
    topics = t.exam.where("type = 'essay'").select("row_id", F.posexplode(F.regexp_extract_all("question", F.lit(r"(?m)^[0-9]+\. (.+)$"), 1)).alias("pos", "topic"))
    asked = topics.select((F.col("row_id") * 100 + F.col("pos")).alias("query"), "topic")
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    posts = retrieval.postings(t.kompendium, "row_id", text.distinct_terms(both, STOP))
    found = retrieval.bm25(asked, "query", text.distinct_terms(F.col("topic"), STOP), posts, 4)
    return found.select("query", "row", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH e AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS second, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
 SELECT user_id, CASE WHEN event_type = second THEN 2 ELSE 5 END AS draws FROM e WHERE rn = 1""")
def adaptive_draws(t: Tables) -> DataFrame:
    from ..streaming.incremental import draws_needed

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = t.events.select("user_id", "event_type", F.lead("event_type").over(w).alias("second"), F.row_number().over(w).alias("rn")).where("rn = 1")
    return first.select("user_id", draws_needed("event_type", "second", 5).alias("draws"))


@query("""SELECT row_id FROM exam WHERE type LIKE 'closed%' UNION ALL SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('11:' || row_id::VARCHAR), row_id) AS rn FROM exam WHERE type NOT LIKE 'closed%') WHERE rn <= 40""")
def stratified_probe(t: Tables) -> DataFrame:
    closed = t.exam.where("type LIKE 'closed%'").select("row_id")
    rest = t.exam.where("type NOT LIKE 'closed%'").select("row_id", F.md5(F.concat(F.lit("11:"), F.col("row_id").cast("string"))).alias("h"))
    return closed.union(rest.orderBy("h", "row_id").limit(40).select("row_id"))


@query("""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY section ORDER BY md5('5:' || row_id::VARCHAR), row_id) AS rn, count(*) OVER (PARTITION BY section) AS n FROM kompendium) WHERE rn <= n // 10""")
def held_out_tenth(t: Tables) -> DataFrame:
    h = F.md5(F.concat(F.lit("5:"), F.col("row_id").cast("string")))
    k = t.kompendium.select("row_id", "section", h.alias("h"))
    return windows.ranked(k, ["section"], ["h", "row_id"]).where("rank <= size DIV 10").select("row_id")


SPECS = ["a=T1:b:x=r1,r2;y=r3", "c=T2::x=r4"]


@query("""WITH s(spec) AS (VALUES ('a=T1:b:x=r1,r2;y=r3'), ('c=T2::x=r4')), p AS (SELECT split_part(spec, '=', 1) AS name, substring(spec, strpos(spec, '=') + 1) AS rest FROM s),
 d AS (SELECT name, split_part(rest, ':', 1) AS track, split_part(rest, ':', 2) AS vs, unnest(string_split(split_part(rest, ':', 3), ';')) AS d FROM p)
 SELECT name, track, nullif(vs, '') AS vs, split_part(d, '=', 1) AS dataset, unnest(string_split(split_part(d, '=', 2), ',')) AS run FROM d""")
def group_specs(t: Tables) -> DataFrame:
    return shapes.parse_specs(t.spark.createDataFrame([(s,) for s in SPECS], "spec string"), "spec")


@query("""SELECT event_id, CASE WHEN json_valid(props) THEN 'json' ELSE 'text' END AS kind FROM events WHERE props IS NOT NULL""")
def literal_kinds(t: Tables) -> DataFrame:
    return t.events.where("props IS NOT NULL").select("event_id", F.when(F.try_parse_json("props").isNotNull(), "json").otherwise("text").alias("kind"))


@query("""SELECT row_id, CASE WHEN question IS NULL OR trim(question) = '' THEN 'empty' ELSE 'keep' END AS reason, coalesce(nullif(trim(source_text), ''), nullif(trim(question), ''), nullif(trim(rubric), '')) AS first_text FROM synthetic_items""")
def first_non_empty(t: Tables) -> DataFrame:
    fields = [F.nullif(F.trim(c), F.lit("")) for c in ("source_text", "question", "rubric")]
    empty = F.coalesce(F.length(F.trim("question")), F.lit(0)) == 0
    return t.synthetic_items.select("row_id", F.when(empty, "empty").otherwise("keep").alias("reason"), F.coalesce(*fields).alias("first_text"))
