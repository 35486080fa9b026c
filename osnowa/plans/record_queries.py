"""Catalogue: records and cards, filters, exemptions in dedup, saved index, topic detection."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import answers, text
from ..operators import dedup, retrieval, similarity, windows
from ..session import cut, shared_folder
from .registry import Tables, query
from .retrieval_queries import _BM25, _posts
from .text_queries import STOP, W


# --- dedup with exemptions ----------------------------------------------------------------------------------------------------
_QPAIRS = rf"""w AS (SELECT row_id, origin, verified, regexp_extract_all(lower(question), '{W}') AS w FROM synthetic_items),
 s AS (SELECT row_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), chr(1)))) AS g FROM w WHERE len(w) > 0),
 e AS (SELECT row_id, len(g) AS n, unnest(g) AS g FROM s),
 pairs AS MATERIALIZED (SELECT a.row_id AS a, b.row_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM e a JOIN e b ON a.g = b.g AND a.row_id < b.row_id GROUP BY a.row_id, b.row_id HAVING j > 0.6)"""


def _question_pairs(t: Tables) -> DataFrame:
    return cut(similarity.jaccard_pairs(similarity.gram_sets(t.synthetic_items, "row_id", text.word_ngrams(F.col("question"), 4)), 0.6).select("a", "b"))


@query(f"""WITH {_QPAIRS} SELECT row_id FROM synthetic_items WHERE row_id NOT IN (SELECT b FROM pairs JOIN synthetic_items x ON x.row_id = pairs.a WHERE coalesce(verify_note, '') <> 'poprawiono')""")
def blocked_unless_corrected(t: Tables) -> DataFrame:
    rows = t.synthetic_items.select("row_id", "verify_note")
    return dedup.blocked_by_rejected(rows, "row_id", _question_pairs(t), "verify_note", ["poprawiono"]).select("row_id")


@query()
def kept_with_exempt_origin(t: Tables) -> DataFrame:
    """Verified items stay and never block; among the others the first of similar questions stays. Compared with brute force."""
    return dedup.greedy_among(t.synthetic_items, "row_id", _question_pairs(t), ~F.coalesce(F.col("verified"), F.lit(False)))


@query("""SELECT tab, row_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o, row_id) AS rn FROM (SELECT 0 AS o, 'persons' AS tab, row_id, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS k FROM persons
 UNION ALL SELECT 1, 'timeline', row_id, trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', ' ', 'g')) FROM timeline) WHERE k <> '') WHERE rn = 1""")
def unseen_names(t: Tables) -> DataFrame:
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    both = t.persons.select(F.lit(0).alias("o"), F.lit("persons").alias("tab"), "row_id", key("name").alias("k")).union(t.timeline.select(F.lit(1), F.lit("timeline"), "row_id", key("title")))
    return windows.first_of(both.where("k <> ''"), ["k"], ["o", "row_id"]).select("tab", "row_id")


@query(r"""WITH n AS (SELECT row_id, list_distinct(list_transform(regexp_extract_all(name, '\p{Lu}\p{Ll}{2,}'), lambda w: lower(substring(w, 1, 6)))) AS p FROM persons WHERE name IS NOT NULL),
 x AS (SELECT row_id, unnest(p) AS s FROM n), k AS (SELECT row_id, unnest(list_distinct(list_transform(regexp_extract_all(title, '\p{Lu}\p{Ll}{2,}'), lambda w: lower(substring(w, 1, 6))))) AS s FROM kompendium WHERE title IS NOT NULL)
 SELECT x.row_id AS a, k.row_id AS b, count(*) AS shared FROM x JOIN k USING (s) GROUP BY 1, 2""")
def notes_sharing_names(t: Tables) -> DataFrame:
    """Pairs of a person and a note that share a stem of a capitalised word; without one the pair is not looked at."""
    stems = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\p{Lu}\p{Ll}{2,})"), 1), lambda w: F.lower(F.substring(w, 1, 6))))
    a = cut(t.persons.where("name IS NOT NULL").select(F.col("row_id").alias("a"), stems("name").alias("s"))).select("a", F.explode("s").alias("s"))
    b = cut(t.kompendium.where("title IS NOT NULL").select(F.col("row_id").alias("b"), stems("title").alias("s"))).select("b", F.explode("s").alias("s"))
    return a.join(b, "s").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))


# --- retrieval ----------------------------------------------------------------------------------------------------------------
@query(f"WITH {_BM25} SELECT query, row, round(score, 6) AS score, rank FROM k WHERE rank <= 5")
def bm25_saved_index(t: Tables) -> DataFrame:
    """The postings are written once with their frequencies and totals, opened again and only read."""
    path = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    retrieval.save_index(_posts(t), path)
    got = retrieval.bm25_indexed(t.exam, "row_id", text.distinct_terms(F.col("question"), STOP), retrieval.open_index(t.spark, path), 5)
    return got.select("query", "row", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query("""WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS row, embedding::DOUBLE[] AS b FROM embeddings),
 r AS (SELECT query, row, list_cosine_similarity(a, b) AS score FROM q JOIN c ON query <> row) SELECT query, row FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS rank FROM r WHERE score >= 0.2) WHERE rank <= 5""")
def knn_above_floor(t: Tables) -> DataFrame:
    return retrieval.cosine_top_k(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 5, least=0.2).select("query", "row")


@query(r"""WITH s AS (SELECT section, substring(w, 1, 6) AS term FROM (SELECT section, unnest(regexp_extract_all(lower(title || ' ' || coalesce(subtopic, '')), '[\p{L}\p{N}_]+')) AS w FROM kompendium WHERE section IS NOT NULL AND title IS NOT NULL) WHERE length(w) >= 4),
 u AS (SELECT term, min(section) AS section FROM s GROUP BY term HAVING count(DISTINCT section) = 1),
 d AS (SELECT doc_id, substring(w, 1, 6) AS term, least(count(*), 5) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY 1, 2),
 c AS (SELECT doc_id, section, sum(n) AS score FROM d JOIN u USING (term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, section) AS rn FROM c),
 b AS (SELECT doc_id, max(CASE WHEN rn = 1 THEN section END) AS section, max(CASE WHEN rn = 1 THEN score END)::BIGINT AS best, coalesce(max(CASE WHEN rn = 2 THEN score END), 0)::BIGINT AS second FROM r GROUP BY 1)
 SELECT doc_id, CASE WHEN best >= 3 AND best >= 2 * second + 1 THEN section END AS section, best, second FROM b""")
def detected_topics(t: Tables) -> DataFrame:
    """The section of a document by words that only one section's titles have, each counted five times at most, if it wins clearly."""
    words = lambda df, key, said: cut(df.select(key, text.words(said).alias("w"))).select(key, F.explode("w").alias("w")).where(F.length("w") >= 4).select(key, F.substring("w", 1, 6).alias("term"))
    notes = t.kompendium.where("section IS NOT NULL AND title IS NOT NULL")
    own = retrieval.own_terms(words(notes, "section", F.concat_ws(" ", "title", F.coalesce("subtopic", F.lit("")))), "section", "term")
    said = words(t.documents, "doc_id", F.col("text")).groupBy("doc_id", "term").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("n"))
    scores = said.join(own, "term").groupBy("doc_id", "section").agg(F.sum("n").alias("score"))
    return windows.clear_winner(scores, ["doc_id"], "section", "score", 3, 2, 1)


@query(f"""WITH {_BM25}, c AS (SELECT query, sum(score) AS kb FROM k WHERE rank <= 3 GROUP BY query), m AS (SELECT e.row_id AS query, e.type, max_points + 2 * kb / max(kb) OVER (PARTITION BY type) AS mixed FROM c JOIN exam e ON e.row_id = c.query)
 SELECT type, arg_max(query, (round(mixed, 6), -query)) AS query FROM m GROUP BY type""")
def best_mixed_item(t: Tables) -> DataFrame:
    """Of each type the item with the highest points plus twice its coverage relative to the type's best."""
    found = retrieval.bm25(t.exam, "row_id", text.distinct_terms(F.col("question"), STOP), _posts(t), 3).groupBy("query").agg(F.sum("score").alias("kb"))
    both = found.join(t.exam.select(F.col("row_id").alias("query"), "type", "max_points"), "query")
    mixed = both.withColumn("mixed", F.col("max_points") + 2 * F.col("kb") / F.max("kb").over(Window.partitionBy("type")))
    return mixed.groupBy("type").agg(F.max_by("query", F.struct(F.round("mixed", 6), (-F.col("query")).alias("q"))).alias("query"))


# --- records, cards, lists ----------------------------------------------------------------------------------------------------
@query(r"""SELECT row_id, 'top-' || lpad((row_number() OVER (ORDER BY row_id))::VARCHAR, 5, '0') AS topic FROM (SELECT row_id, row_number() OVER (PARTITION BY lower(trim(coalesce(subtopic, '')) || '|' || trim(text)) ORDER BY row_id) AS rn FROM kompendium WHERE length(trim(text)) >= 40) WHERE rn = 1""")
def saved_topics(t: Tables) -> DataFrame:
    key = F.lower(F.concat(F.trim(F.coalesce("subtopic", F.lit(""))), F.lit("|"), F.trim("text")))
    once = windows.first_of(t.kompendium.where("length(trim(text)) >= 40").select("row_id", key.alias("k")), ["k"], ["row_id"])
    number = F.col("position").cast("string")
    return windows.in_order(once.select("row_id"), ["row_id"]).select("row_id", F.concat(F.lit("top-"), F.when(F.length(number) < 5, F.lpad(number, 5, "0")).otherwise(number)).alias("topic"))


@query(r"""SELECT row_id, '**' || coalesce(title, '?') || '** (' || coalesce(section, '—') || ', ' || coalesce(words::VARCHAR, '?') || '): ' || substring(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 120) AS card FROM kompendium""")
def note_cards(t: Tables) -> DataFrame:
    c = lambda x, other: F.coalesce(F.col(x).cast("string"), F.lit(other))
    body = F.substring(text.squeeze(c("text", "")), 1, 120)
    return t.kompendium.select("row_id", F.concat(F.lit("**"), c("title", "?"), F.lit("** ("), c("section", "—"), F.lit(", "), c("words", "?"), F.lit("): "), body).alias("card"))


@query("""SELECT row_id, array_to_string(list_sort(list_transform(map_entries(key), lambda e: e.key || ':' || CASE WHEN strpos(chr(10) || model_answer || chr(10), chr(10) || e.key || ': ' || e.value || chr(10)) > 0 OR model_answer = e.value THEN 'OK' ELSE '-' END)), ',') AS vector
 FROM exam WHERE key IS NOT NULL AND model_answer IS NOT NULL""")
def part_vectors(t: Tables) -> DataFrame:
    framed = F.concat(F.lit("\n"), "model_answer", F.lit("\n"))
    right = lambda e: F.contains(framed, F.concat(F.lit("\n"), e["key"], F.lit(": "), e["value"], F.lit("\n"))) | (F.col("model_answer") == e["value"])
    parts = F.array_sort(F.transform(F.map_entries("key"), lambda e: F.concat(e["key"], F.lit(":"), F.when(right(e), "OK").otherwise("-"))))
    return t.exam.where("key IS NOT NULL AND model_answer IS NOT NULL").select("row_id", F.array_join(parts, ",").alias("vector"))


@query("""SELECT doc_id FROM documents WHERE title IS NOT NULL AND NOT regexp_matches(title, '(^|[^0-9])1[0-9]{3}([^0-9]|$)') AND NOT regexp_matches(lower(title), 'pożar|wojn')""")
def excluded_by_pattern(t: Tables) -> DataFrame:
    title = F.col("title")
    return t.documents.where(title.isNotNull() & ~title.rlike("(^|[^0-9])1[0-9]{3}([^0-9]|$)") & ~F.lower(title).rlike("pożar|wojn")).select("doc_id")


@query("""SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand, p_size // 5 ORDER BY p_partkey) AS rn FROM part WHERE p_size >= 10 AND p_retailprice * p_size >= 5000) WHERE rn = 1""")
def large_boxes(t: Tables) -> DataFrame:
    big = t.part.where("p_size >= 10 AND p_retailprice * p_size >= 5000").select("p_partkey", "p_brand", F.expr("p_size DIV 5").alias("s"))
    return windows.first_of(big, ["p_brand", "s"], ["p_partkey"]).select("p_partkey")


@query("""SELECT row_id FROM (SELECT row_id, subtype, row_number() OVER (PARTITION BY subtype = 'essay' ORDER BY md5('13:' || row_id::VARCHAR), row_id) AS rn FROM e5_items WHERE verified AND NOT leak AND subtype IS NOT NULL) WHERE rn <= CASE WHEN subtype = 'essay' THEN 24 ELSE 380 END""")
def calibration_draw(t: Tables) -> DataFrame:
    """380 checked items in hash order and 24 essays: a draw of fixed size."""
    h = F.md5(F.concat(F.lit("13:"), F.col("row_id").cast("string")))
    fit = t.e5_items.where("verified AND NOT leak AND subtype IS NOT NULL").select("row_id", (F.col("subtype") == "essay").alias("essay"), h.alias("h"))
    draw = lambda essay, n: fit.where(F.col("essay") == essay).orderBy("h", "row_id").limit(n).select("row_id")
    return draw(False, 380).union(draw(True, 24))


@query("""SELECT row_id, len(list_distinct(map_keys(key))) = len(map_keys(key)) AND len(list_filter(map_keys(key), lambda k: NOT list_contains(['1','2','3','4','5','6','A','B','C','D','E','F'], k))) = 0 AS exact FROM exam WHERE key IS NOT NULL""")
def exact_key_sets(t: Tables) -> DataFrame:
    known = F.array(*[F.lit(x) for x in "123456ABCDEF"])
    keys = F.map_keys("key")
    return t.exam.where("key IS NOT NULL").select("row_id", ((F.size(F.array_distinct(keys)) == F.size(keys)) & (F.size(F.array_except(keys, known)) == 0)).alias("exact"))


@query(r"""SELECT section, string_agg(x, ' ' ORDER BY row_id) AS notes FROM (SELECT section, row_id, substring(text, 1, 300) AS x, row_number() OVER (PARTITION BY section ORDER BY row_id) AS rn FROM kompendium WHERE section IS NOT NULL AND text IS NOT NULL) WHERE rn <= 20 GROUP BY section""")
def section_notes(t: Tables) -> DataFrame:
    """The first twenty notes of a section, 300 characters each: a context block of bounded length."""
    rows = windows.top_k(t.kompendium.where("section IS NOT NULL AND text IS NOT NULL").select("section", "row_id", F.substring("text", 1, 300).alias("x")), ["section"], ["row_id"], 20)
    return rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", "x"))), lambda p: p["x"]), " ").alias("notes"))


@query("""SELECT exam, to_json({'n': count(*), 'points': sum(max_points)})::VARCHAR AS json FROM exam GROUP BY exam""")
def sheet_summaries(t: Tables) -> DataFrame:
    return t.exam.groupBy("exam").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"), F.sum("max_points").alias("points"))).alias("json"))


@query()
def sheet_packs(t: Tables) -> DataFrame:
    """A sheet's items as one JSON document in order; sheets are of bounded length."""
    from ..sources.files import packs

    return packs(t.exam.select("exam", "row_id", "id", "max_points", "question"), "exam", ["row_id"])


@query(r"""WITH a AS (SELECT row_id, lower(question) AS a, CASE WHEN type LIKE 'open%' THEN 1 ELSE 0 END AS o FROM exam WHERE question IS NOT NULL) SELECT row_id, (strpos(a, 'rozstrzygnięcie:') > 0)::INT + (strpos(a, 'uzasadnienie:') > 0)::INT AS labels FROM a""")
def labels_asked(t: Tables) -> DataFrame:
    low = F.lower("question")
    has = lambda x: F.contains(low, F.lit(x)).cast("int")
    return t.exam.where("question IS NOT NULL").select("row_id", (has("rozstrzygnięcie:") + has("uzasadnienie:")).alias("labels"))


@query()
def labels_filled(t: Tables) -> DataFrame:
    """How many labels of a two-part answer the model answer fills; checked by hand-derived cases."""
    template = F.lit("Rozstrzygnięcie:\nUzasadnienie:")
    return t.exam.where("model_answer IS NOT NULL").select("row_id", answers.filled(template, F.col("model_answer")).alias("filled"))
