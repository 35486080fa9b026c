"""Catalogue: deduplication and similarity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, similarity
from ..session import cut
from .registry import Tables, query

W = r"[\p{L}\p{N}_]+"


@query(r"""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY trim(regexp_replace(lower(text), '\s+', ' ', 'g')) ORDER BY doc_id) AS rn
 FROM documents WHERE length(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) > 0) WHERE rn = 1""")
def exact_dedup_keep_first(t: Tables) -> DataFrame:
    return dedup.exact(t.documents.select("doc_id", "source", "text"), text.squeeze(F.lower("text")), ["doc_id"]).select("doc_id", "source")


@query("""SELECT count(*) AS n_rows, sum(CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 1 ELSE 0 END)::BIGINT AS empty, count(text) - count(DISTINCT text) AS repeated_text,
 count(*) - count(DISTINCT coalesce(title, '') || chr(1) || coalesce(section, '')) AS repeated_pair FROM documents""")
def dup_profile(t: Tables) -> DataFrame:
    return dedup.profile(t.documents, "text", ["title", "section"])


_GRAMS = rf"""w AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w FROM documents),
 s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), chr(1)))) AS g FROM w WHERE len(w) > 0),
 e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
 pairs AS MATERIALIZED (SELECT a, b, shared, shared / (na + nb - shared) AS similarity FROM p WHERE shared / (na + nb - shared) > 0.35)"""


def _doc_pairs(docs: DataFrame) -> DataFrame:
    return similarity.jaccard_pairs(similarity.gram_sets(docs, "doc_id", text.word_ngrams(F.col("text"), 4)), 0.35)


def _greedy_kept(t: Tables, rows: DataFrame) -> DataFrame:
    few, copies = dedup.copies_apart(t.documents, "doc_id", "text")
    return dedup.greedy_first(rows.join(copies, "doc_id", "left_anti"), "doc_id", _doc_pairs(few))


@query(f"WITH {_GRAMS} SELECT a, b, shared, round(similarity, 9) AS similarity FROM pairs")
def jaccard_pairs_corpus(t: Tables) -> DataFrame:
    return _doc_pairs(t.documents).withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH RECURSIVE {_GRAMS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM s),
 walk(i, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT o.i, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE pairs.b = o.doc_id AND list_contains(kept, pairs.a)) THEN kept
 ELSE list_append(kept, o.doc_id) END FROM walk JOIN o ON o.i = walk.i + 1) SELECT unnest(kept) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM o)""")
def greedy_neardup_kept(t: Tables) -> DataFrame:
    rows = t.documents.where(F.size(text.words(F.col("text"))) > 0).select("doc_id")
    return _greedy_kept(t, rows)


@query(f"WITH {_GRAMS} SELECT doc_id FROM s WHERE doc_id NOT IN (SELECT b FROM pairs)")
def rejected_also_block(t: Tables) -> DataFrame:
    rows = t.documents.where(F.size(text.words(F.col("text"))) > 0).select("doc_id")
    few, copies = dedup.copies_apart(t.documents, "doc_id", "text")
    return dedup.drop_if_any_earlier(rows, "doc_id", _doc_pairs(few).select("b").union(copies))


@query(f"""WITH {_GRAMS}, kept AS (SELECT doc_id FROM s WHERE doc_id NOT IN (SELECT b FROM pairs)) SELECT coalesce(nullif(trim(lang), ''), '—') AS lang, count(*) AS n
 FROM kept JOIN documents USING (doc_id) GROUP BY 1""")
def kept_by_language(t: Tables) -> DataFrame:
    from ..operators.reports import labelled

    return rejected_also_block(t).join(t.documents.select("doc_id", "lang"), "doc_id").groupBy(labelled(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


def flagship_dedup_counts(t: Tables) -> DataFrame:
    """Exact 4-gram similarity join of whole documents, keep-first dedup, counts per language."""
    from ..operators.reports import labelled

    kept = _greedy_kept(t, t.documents.select("doc_id", "lang"))
    return kept.groupBy(labelled(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


query()(flagship_dedup_counts)  # SQL over whole documents takes minutes; tests compare it with brute force


@query(rf"""WITH w AS (SELECT row_id, 0 AS k, regexp_extract_all(lower(question), '{W}') AS w FROM synthetic_items UNION ALL SELECT row_id, 1, regexp_extract_all(lower(question), '{W}') FROM exam),
 s AS (SELECT row_id, k, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), chr(1)))) AS g FROM w WHERE len(w) > 0),
 e AS (SELECT row_id, k, len(g) AS n, unnest(g) AS g FROM s),
 p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.g = b.g AND a.k = 0 AND b.k = 1 GROUP BY 1, 2)
 SELECT a, b, shared, round(shared / (na + nb - shared), 9) AS similarity FROM p WHERE shared / (na + nb - shared) > 0.2""")
def jaccard_pairs_eval(t: Tables) -> DataFrame:
    left = similarity.gram_sets(t.synthetic_items, "row_id", text.word_ngrams(F.col("question"), 4))
    right = similarity.gram_sets(t.exam, "row_id", text.word_ngrams(F.col("question"), 4))
    return similarity.jaccard_pairs(left, 0.2, other=right).withColumn("similarity", F.round("similarity", 9))


@query(rf"""WITH w AS (SELECT row_id, regexp_extract_all(lower(question), '{W}') AS q, regexp_extract_all(lower(model_answer), '{W}') AS a FROM synthetic_items),
 s AS (SELECT row_id, list_distinct(list_transform(range(1, greatest(len(q) - 3, 1) + 1), lambda i: array_to_string(list_slice(q, i, i + 3), chr(1)))) AS q,
 CASE WHEN len(a) = 0 OR a IS NULL THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(a) - 3, 1) + 1), lambda i: array_to_string(list_slice(a, i, i + 3), chr(1)))) END AS a FROM w WHERE len(q) > 0),
 e AS (SELECT row_id, len(q) AS n, unnest(q) AS g FROM s),
 p AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS shared, count(*) / (any_value(x.n) + any_value(y.n) - count(*)) AS qj FROM e x JOIN e y ON x.g = y.g AND x.row_id < y.row_id GROUP BY 1, 2),
 j AS (SELECT p.*, CASE WHEN len(u.a) = 0 OR len(v.a) = 0 THEN 0.0 ELSE len(list_intersect(u.a, v.a)) / (len(u.a) + len(v.a) - len(list_intersect(u.a, v.a))) END AS aj
 FROM p JOIN s u ON u.row_id = p.a JOIN s v ON v.row_id = p.b WHERE qj > 0.28)
 SELECT a, b, shared FROM j WHERE (qj > 0.35 AND shared >= 6) OR (aj > 0.35 AND shared >= 4)""")
def jaccard_two_rule_pairs(t: Tables) -> DataFrame:
    q = cut(similarity.jaccard_pairs(similarity.gram_sets(t.synthetic_items, "row_id", text.word_ngrams(F.col("question"), 4)), 0.28, common=4))
    answers = similarity.gram_sets(t.synthetic_items, "row_id", text.word_ngrams(F.col("model_answer"), 4))
    sure = "similarity > 0.35 AND shared >= 6"  # these need no look at the answers
    scored = similarity.with_sets(q.where(f"NOT ({sure})"), answers, answers).where(text.jaccard(F.col("ga"), F.col("gb")) > 0.35)
    return q.where(sure).select("a", "b", "shared").union(scored.select("a", "b", "shared"))


@query(r"""WITH s AS (SELECT row_id, section, type, group_id, list_distinct(regexp_extract_all(lower(question), '[\p{L}\p{N}_]{4,}')) AS w FROM e5_items WHERE section IS NOT NULL AND type IS NOT NULL),
 x AS (SELECT row_id, section, type, group_id, unnest(w) AS g FROM s), n AS (SELECT count(*) AS n FROM s WHERE len(w) > 0),
 f AS (SELECT g FROM x GROUP BY g HAVING count(*) > 0.02 * (SELECT n FROM n)), y AS (SELECT x.*, count(*) OVER (PARTITION BY row_id) AS n FROM x WHERE g NOT IN (SELECT g FROM f)),
 p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS shared, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j, any_value(a.group_id) AS ga, any_value(b.group_id) AS gb
 FROM y a JOIN y b ON a.g = b.g AND a.section = b.section AND a.type = b.type AND a.row_id < b.row_id GROUP BY 1, 2)
 SELECT a, b, shared, round(j, 9) AS similarity FROM p WHERE j >= 0.4 AND coalesce(ga, '') <> coalesce(gb, '')""")
def blocked_neardup_pairs(t: Tables) -> DataFrame:
    items = t.e5_items.where("section IS NOT NULL AND type IS NOT NULL")
    sets = similarity.drop_common(similarity.gram_sets(items, "row_id", text.long_words(F.col("question")), ["section", "type"]), 0.02)
    pairs = similarity.jaccard_pairs(sets, 0.4, ["section", "type"], strict=False)
    g = lambda c: items.select(F.col("row_id").alias(c), F.coalesce("group_id", F.lit("")).alias(f"g{c}"))
    return pairs.join(g("a"), "a").join(g("b"), "b").where("ga <> gb").select("a", "b", "shared", F.round("similarity", 9).alias("similarity"))


@query(r"""WITH s AS (SELECT row_id, year, list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda x: length(x) > 3), lambda x: substring(x, 1, 5))) AS w
 FROM timeline WHERE year IS NOT NULL), x AS (SELECT row_id, year, len(w) AS n, unnest(w) AS g FROM s),
 p AS (SELECT a.row_id AS a, b.row_id AS b, count(*) AS shared, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS j FROM x a JOIN x b ON a.g = b.g AND a.year = b.year AND a.row_id < b.row_id GROUP BY 1, 2)
 SELECT a, b, shared, round(j, 9) AS similarity FROM p WHERE j >= 0.35""")
def year_block_neardup(t: Tables) -> DataFrame:
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    stems = F.array_distinct(F.transform(F.filter(text.words(both), lambda w: F.length(w) > 3), lambda w: F.substring(w, 1, 5)))
    sets = similarity.gram_sets(t.timeline.where("year IS NOT NULL"), "row_id", stems, ["year"])
    return similarity.jaccard_pairs(sets, 0.35, ["year"], strict=False).withColumn("similarity", F.round("similarity", 9))


@query(r"""WITH k AS (SELECT row_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(name), '\p{L}+'), lambda x: length(x) >= 9))) AS k FROM persons),
 m AS (SELECT row_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(title), '\p{L}+'), lambda x: length(x) >= 9))) AS k FROM timeline)
 SELECT DISTINCT k.row_id AS a, m.row_id AS b FROM k JOIN m USING (k)""")
def name_key_overlap(t: Tables) -> DataFrame:
    keys = lambda c: F.array_distinct(F.filter(text.words(F.col(c), r"\p{L}+"), lambda w: F.length(w) >= 9))
    return similarity.key_overlap(t.persons, "row_id", keys("name"), t.timeline, "row_id", keys("title"))


@query("""WITH a AS (SELECT 0 AS source_rank, row_id, title AS key FROM persons UNION ALL SELECT 1, row_id, title FROM kompendium UNION ALL SELECT 2, row_id, title FROM timeline)
 SELECT source_rank, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(key)) ORDER BY source_rank, row_id) AS rn FROM a WHERE length(trim(key)) > 0) WHERE rn = 1 GROUP BY source_rank""")
def priority_unique_titles(t: Tables) -> DataFrame:
    part = lambda d: d.select("row_id", F.lower(F.trim("title")).alias("key"))
    once = dedup.across([part(t.persons), part(t.kompendium), part(t.timeline)], "key", "row_id")
    return once.groupBy("source_rank").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT row_id FROM timeline WHERE title IS NULL OR lower(trim(title)) NOT IN (SELECT lower(trim(title)) FROM kompendium WHERE title IS NOT NULL)""")
def title_anti(t: Tables) -> DataFrame:
    return dedup.not_in(t.timeline, F.lower(F.trim("title")), t.kompendium, F.lower(F.trim("title"))).select("row_id")


@query(r"""WITH e AS (SELECT DISTINCT trim(substring(trim(regexp_replace(lower(question), '[^\p{L}\p{N}_]+', ' ', 'g')), 1, 120)) AS k FROM exam WHERE question IS NOT NULL)
 SELECT row_id FROM synthetic_items WHERE question IS NULL OR trim(substring(trim(regexp_replace(lower(question), '[^\p{L}\p{N}_]+', ' ', 'g')), 1, 120)) NOT IN (SELECT k FROM e)""")
def contamination_prefix_anti(t: Tables) -> DataFrame:
    return dedup.not_in(t.synthetic_items, text.norm_prefix(F.col("question")), t.exam, text.norm_prefix(F.col("question"))).select("row_id")


@query(r"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY array_to_string(list_slice(regexp_split_to_array(lower(trim(title)), '\s+'), 1, 3), ' ') ORDER BY row_id) AS rn
 FROM kompendium WHERE length(trim(title)) > 0) WHERE rn = 1""")
def first_words_dedup(t: Tables) -> DataFrame:
    return dedup.by_first_words(t.kompendium.select("row_id", "title"), "title", 3, ["row_id"]).select("row_id")


@query(rf"""WITH k AS (SELECT row_id, regexp_extract_all(lower(text), '{W}') AS w FROM kompendium), e AS (SELECT row_id, regexp_extract_all(lower(question), '{W}') AS w FROM exam),
 kg AS (SELECT row_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 5, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 5), chr(1))))) AS g FROM k WHERE len(w) > 0),
 eg AS (SELECT row_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 5, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 5), chr(1))))) AS g FROM e WHERE len(w) > 0)
 SELECT kg.row_id AS a, eg.row_id AS b, count(*) AS runs FROM kg JOIN eg USING (g) GROUP BY 1, 2""")
def shared_runs(t: Tables) -> DataFrame:
    return similarity.shared_run(t.kompendium, "row_id", F.col("text"), t.exam, "row_id", F.col("question"), 6)


@query(r"""WITH w AS (SELECT row_id, list_transform(list_filter(regexp_extract_all(lower(model_answer), '\p{L}+'), lambda x: length(x) >= 5), lambda x: substring(x, 1, 6)) AS a,
 list_transform(list_filter(regexp_extract_all(lower(source_text), '\p{L}+'), lambda x: length(x) >= 5), lambda x: substring(x, 1, 6)) AS s FROM synthetic_items WHERE model_answer IS NOT NULL AND source_text IS NOT NULL)
 SELECT row_id, round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: list_contains(s, x))) / len(a) ELSE 0.0 END, 9) AS share FROM w""")
def leak_terms_ratio(t: Tables) -> DataFrame:
    items = t.synthetic_items.where("model_answer IS NOT NULL AND source_text IS NOT NULL")
    share = similarity.stem_share(text.content_stems(F.col("model_answer"), ["\u0001"]), text.content_stems(F.col("source_text"), ["\u0001"]))
    return items.select("row_id", F.round(share, 9).alias("share"))


_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[–—−]', '-', 'g'), '\\[obraz:[^\\]]*\\]', ' ', 'g'), '[^0-9a-ząćęłńóśźż -]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH a AS (SELECT row_id, {_NORM.format('source_text')} AS src, string_split(regexp_replace(model_answer, '([.!?]) ', '\\1' || chr(10), 'g'), chr(10)) AS c, regexp_extract_all({_NORM.format('model_answer')}, '[^ ]+') AS w FROM synthetic_items),
 b AS (SELECT row_id, src, w, list_filter(list_transform(c, lambda x: {_NORM.format('x')}), lambda x: length(x) >= 12) AS c, list_filter(list_transform(range(1, greatest(len(w) - 5, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 5), ' ')), lambda x: length(x) >= 25) AS r FROM a)
 SELECT row_id, coalesce((len(list_filter(c, lambda x: strpos(src, x) > 0)) > 0 OR (len(list_filter(r, lambda x: strpos(src, x) > 0)) > 0 AND len(w) >= 6)) AND length(src) >= 12, false) AS leak FROM b""")
def literal_leak(t: Tables) -> DataFrame:
    return t.synthetic_items.select("row_id", similarity.literal_leak(F.col("source_text"), F.col("model_answer")).alias("leak"))
