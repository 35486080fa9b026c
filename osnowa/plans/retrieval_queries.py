"""Catalogue: retrieval, graphs, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dedup, graph, retrieval, stats
from .registry import Tables, query
from .text_queries import STOP

_STOP = "['" + "','".join(STOP) + "']"
_TERMS = (
    "list_distinct(list_transform(list_filter(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3 AND NOT list_contains("
    + _STOP + ", x)), lambda x: substring(x, 1, 6)))"
)
_COUNTS = r"""w2 AS (SELECT row_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: substring(x, 1, 6)) AS t FROM kompendium), x2 AS (SELECT row_id, len(t) AS dl, unnest(t) AS term FROM w2 WHERE len(t) > 0),
 p2 AS (SELECT row_id, dl, term, count(*) AS tf FROM x2 GROUP BY 1, 2, 3), q2 AS (SELECT DISTINCT row_id AS query, unnest(list_transform(regexp_extract_all(lower(question), '[\p{L}\p{N}_]+'), lambda x: substring(x, 1, 6))) AS term FROM exam),
 s2 AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT row_id, dl FROM p2)), f2 AS (SELECT term, count(*) AS df FROM p2 GROUP BY 1),
 r2 AS (SELECT query, row_id AS row, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q2 JOIN p2 USING (term) JOIN f2 USING (term) CROSS JOIN s2 GROUP BY 1, 2),
 k2 AS (SELECT query, row, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, row DESC) AS rank FROM r2)"""
_BM25 = f"""d AS (SELECT row_id, {_TERMS.format("coalesce(title, '') || ' ' || coalesce(text, '')")} AS t FROM kompendium), p AS (SELECT row_id, len(t) AS dl, unnest(t) AS term FROM d WHERE len(t) > 0),
 q AS (SELECT row_id AS query, unnest({_TERMS.format('question')}) AS term FROM exam), s AS (SELECT count(*) AS n, avg(dl) AS a FROM (SELECT DISTINCT row_id, dl FROM p)),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 r AS (SELECT query, row_id AS row, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / a))), 9) AS score FROM q JOIN p USING (term) JOIN f USING (term) CROSS JOIN s GROUP BY 1, 2),
 k AS (SELECT query, row, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, row DESC) AS rank FROM r)"""


def _posts(t: Tables) -> DataFrame:
    both = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    return retrieval.postings(t.kompendium, "row_id", text.distinct_terms(both, STOP))


def _bm25(t: Tables, k: int) -> DataFrame:
    return retrieval.bm25(t.exam, "row_id", text.distinct_terms(F.col("question"), STOP), _posts(t), k)


@query(f"WITH {_BM25} SELECT query, row, round(score, 6) AS score, rank FROM k WHERE rank <= 10")
def bm25_distinct_terms(t: Tables) -> DataFrame:
    return _bm25(t, 10).select("query", "row", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _by_counts(t: Tables, k: int) -> DataFrame:
    posts = retrieval.postings(t.kompendium, "row_id", text.stems(F.col("text")))
    return retrieval.bm25(t.exam, "row_id", text.stems(F.col("question")), posts, k, k1=1.2)


@query(f"WITH {_COUNTS} SELECT query, row, round(score, 6) AS score, rank FROM k2 WHERE rank <= 10")
def bm25_term_counts(t: Tables) -> DataFrame:
    return _by_counts(t, 10).select("query", "row", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _dense(t: Tables, k: int) -> DataFrame:
    return retrieval.cosine_top_k(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", k)


_COS = """q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS a FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id AS row, embedding::DOUBLE[] AS b, label FROM embeddings),
 r AS (SELECT query, row, label, list_cosine_similarity(a, b) AS score FROM q JOIN c ON query <> row)"""


@query(f"WITH {_COS} SELECT query, row, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS rank FROM r) WHERE rank <= 10")
def dense_cosine_topk(t: Tables) -> DataFrame:
    return _dense(t, 10).select("query", "row", F.round("score", 5).alias("score"))


@query(f"""WITH {_COS}, o AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, row) AS c FROM r)
 SELECT query, row, rank FROM (SELECT query, row, row_number() OVER (PARTITION BY query ORDER BY score DESC, row) AS rank FROM o WHERE c = 1) WHERE rank <= 3""")
def knn_distinct_captions(t: Tables) -> DataFrame:
    hits = retrieval.cosine_top_k(t.embeddings.where("vec_id % 20 = 0"), t.embeddings, "vec_id", "embedding", 3, caption="label").drop("rank")
    best = dedup.top_without_repeats(hits, "query", "label", "score", "row", 3)
    return best.select("query", "row", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_BM25}, {_COUNTS}, u AS (SELECT query, row, rank, 0 AS l FROM k WHERE rank <= 20 UNION ALL SELECT query, row, rank, 1 FROM k2 WHERE rank <= 20),
 z AS (SELECT query, row, round(sum(1.0 / (60 + rank)), 12) AS score, min((l, rank)) AS f FROM u GROUP BY 1, 2)
 SELECT query, row, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, f, row) AS rank FROM z) WHERE rank <= 10""")
def reciprocal_rank_fusion(t: Tables) -> DataFrame:
    return retrieval.fuse([_bm25(t, 20), _by_counts(t, 20)], 10).select("query", "row", F.round("score", 9).alias("score"))


@query(f"""WITH {_BM25}, g AS (SELECT e.row_id AS query, k.row_id AS row FROM exam e JOIN kompendium k ON strpos(lower(k.text), lower(substring(e.question, strpos(e.question, ':') + 2, 30))) > 0 WHERE strpos(e.question, ':') > 0),
 h AS (SELECT g.query, min(k.rank) AS rank FROM g LEFT JOIN k ON k.query = g.query AND k.row = g.row AND k.rank <= 50 GROUP BY 1)
 SELECT c.k::INT AS k, count(*) AS queries, round(avg(CASE WHEN rank <= c.k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM h CROSS JOIN (VALUES (1), (5), (10), (20), (50)) c(k) GROUP BY 1""")
def recall_at_k(t: Tables) -> DataFrame:
    # gold: notes that quote the thirty characters after the colon; every run of that length is looked up by equality
    at = F.instr("question", ":")
    asked = t.exam.where(at > 0).select(F.col("row_id").alias("query"), F.lower(F.substring("question", at + 2, F.lit(30))).alias("key"))
    # the key is shorter where the question ends: one run length per length of key, thirty at most
    lengths = [r["n"] for r in asked.select(F.length("key").alias("n")).where("n > 0").distinct().collect()]
    low = F.lower("text")
    cuts = F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("n")
    notes = t.kompendium.where("text IS NOT NULL").select(F.col("row_id").alias("row"), low.alias("x"), cuts)
    starts = F.sequence(F.lit(1), F.greatest(F.length("x") - F.col("n") + 1, F.lit(1)))
    runs = notes.select("row", F.explode(F.transform(starts, lambda i: F.substring(F.col("x"), i, F.col("n")))).alias("key"))
    gold = asked.join(runs, "key").select("query", "row").distinct()
    return retrieval.recall_at(_bm25(t, 50), gold, [1, 5, 10, 20, 50])


@query(f"""WITH {_BM25} SELECT query, term, rank FROM (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY df, term) AS rank FROM (SELECT DISTINCT query, term FROM q) JOIN f USING (term)) WHERE rank <= 6""")
def rarest_query_terms(t: Tables) -> DataFrame:
    terms = t.exam.select(F.col("row_id").alias("query"), F.explode(text.distinct_terms(F.col("question"), STOP)).alias("term"))
    return retrieval.rarest_terms(_posts(t), terms, 6).select("query", "term", F.col("rank").cast("bigint").alias("rank"))


@query(r"""WITH x AS (SELECT DISTINCT section, unnest(regexp_extract_all(lower(title), '\p{L}+')) AS term FROM kompendium WHERE section IS NOT NULL)
 SELECT section, term FROM x WHERE term IN (SELECT term FROM x GROUP BY term HAVING count(*) = 1)""")
def terms_of_one_section(t: Tables) -> DataFrame:
    x = t.kompendium.where("section IS NOT NULL").select("section", F.explode(text.words(F.col("title"), r"\p{L}+")).alias("term"))
    return retrieval.own_terms(x, "section", "term")


# --- graphs -------------------------------------------------------------------------------------------------------------------
def _edges(t: Tables) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return t.nation.select(k.alias("src"), F.explode(F.array(k * 2 % 25, k * 3 % 25)).alias("dst"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey::BIGINT AS src, unnest([n_nationkey * 2 % 25, n_nationkey * 3 % 25])::BIGINT AS dst FROM nation),
 w(node, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM w GROUP BY node""")
def bounded_reach(t: Tables) -> DataFrame:
    return graph.reach(_edges(t), t.spark.createDataFrame([(1,)], "node bigint"), 3)


@query(r"""WITH RECURSIVE w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS w FROM part), m AS (SELECT DISTINCT substring(w, 1, i::INT - 1) AS l, substring(w, i::INT, 1) AS r FROM (SELECT w, unnest(range(2, length(w) + 1)) AS i FROM w)),
 c(token) AS (SELECT w FROM w WHERE w < 'm' UNION SELECT unnest([l, r]) FROM c JOIN m ON token = l || r) SELECT DISTINCT token FROM c""")
def merge_closure(t: Tables) -> DataFrame:
    w = t.part.select(F.explode(text.words(F.col("p_name"), "[a-z]+")).alias("w")).distinct()
    cut_at = w.select("w", F.explode(F.sequence(F.lit(2), F.length("w"))).alias("i")).where("i <= length(w) AND length(w) > 1")
    merges = cut_at.select(F.substring("w", F.lit(1), F.col("i") - 1).alias("left_part"), F.substring("w", F.col("i"), F.lit(1)).alias("right_part")).distinct()
    return graph.merge_closure(w.where("w < 'm'").select(F.col("w").alias("token")), merges)


@query("""WITH RECURSIVE p AS (SELECT n_nationkey::BIGINT AS node, CASE WHEN n_nationkey > 0 THEN (n_nationkey // 2)::BIGINT END AS parent FROM nation),
 a(node, ancestor, distance) AS (SELECT node, node, 0 FROM p UNION ALL SELECT a.node, p.parent, distance + 1 FROM a JOIN p ON p.node = a.ancestor WHERE p.parent IS NOT NULL) SELECT node, ancestor, distance::INT AS distance FROM a""")
def run_ancestors(t: Tables) -> DataFrame:
    k = F.col("n_nationkey").cast("bigint")
    return graph.ancestors(t.nation.select(k.alias("node"), F.when(k > 0, F.floor(k / 2)).alias("parent")))


@query("""SELECT token, (row_number() OVER (ORDER BY old_id) - 1)::BIGINT AS new_id FROM (SELECT p_partkey AS old_id, p_name || p_partkey::VARCHAR AS token FROM part WHERE p_size > 25)""")
def remapped_ids(t: Tables) -> DataFrame:
    kept = t.part.where("p_size > 25").select(F.col("p_partkey").alias("old_id"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("token"))
    return graph.new_ids(kept, "old_id").select("token", "new_id")


# --- resampling: checked by tests, not by SQL ----------------------------------------------------------------------------------
@query()
def paired_bootstrap_interval(t: Tables) -> DataFrame:
    by = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.avg("o_totalprice").alias("v"))
    return stats.paired_bootstrap(by.where("y = 1996"), by.where("y = 1997"), ["o_custkey"], "v", 200)


@query()
def vote_simulation(t: Tables) -> DataFrame:
    return stats.vote_simulation(t.events.select("user_id", (F.col("value") > 20).alias("right")), "user_id", "right", 5, 50)
