"""Catalogue: text expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing, text
from .registry import Tables, query

W = r"[\p{L}\p{N}_]+"
#: Stop words of the query-term definitions, a parameter of them.
STOP = ["oraz", "przez", "jest", "jako", "który", "która", "które", "the", "and", "und", "der", "die"]
_STOP = "['" + "','".join(STOP) + "']"


@query(rf"""SELECT doc_id, len(regexp_extract_all(text, '{W}'))::BIGINT AS n_words, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS n_tokens,
 len(regexp_extract_all(text, '\p{{L}}+'))::BIGINT AS n_letter_words FROM documents""")
def word_counts_three_ways(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select(
        "doc_id", text.count_words(x).alias("n_words"), text.count_tokens(x).alias("n_tokens"), text.count_letter_words(x).alias("n_letter_words")
    )


@query(r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(text, '[#*_`>]', '', 'g'), '(?m)^\s*[-+]\s+', '', 'g'), '[^\s]+'))::BIGINT AS n_words
 FROM documents""")
def markdown_word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.count_markdown_words(F.col("text")).alias("n_words"))


@query(r"""SELECT doc_id, trim(substring(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')), 1, 120)) AS key FROM documents""")
def norm_prefix_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.norm_prefix(F.col("text")).alias("key"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[–—−]', '-', 'g'), '\[obraz:[^\]]*\]', ' ', 'g'),
 '[^0-9a-ząćęłńóśźż -]', ' ', 'g'), '\s+', ' ', 'g'))) AS h FROM documents""")
def norm_text_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.norm_text(F.col("text"))).alias("h"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(title), '{W}') AS w FROM documents WHERE title IS NOT NULL),
 g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), chr(1)))) END AS g FROM w)
 SELECT doc_id, len(g)::BIGINT AS n_grams, list_min(g) AS first_gram FROM g""")
def ngram4_sets(t: Tables) -> DataFrame:
    g = t.documents.where("title IS NOT NULL").select("doc_id", text.word_ngrams(F.col("title"), 4).alias("g"))
    return g.select("doc_id", F.size("g").cast("bigint").alias("n_grams"), F.array_min("g").alias("first_gram"))


@query(r"""SELECT doc_id, trim(list_last(string_split(regexp_replace(text, '(?s)<think>.*?</think>', '', 'g'), '</think>'))) AS answer
 FROM documents""")
def strip_think(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.strip_think(F.col("text")).alias("answer"))


@query(r"""SELECT doc_id, substring(regexp_replace(text, '(?:sk|fh|pk)[-_][A-Za-z0-9_-]{8,}', '[secret]', 'g'), 1, 400) AS masked FROM documents""")
def secret_mask(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.mask_secrets(F.col("text")).alias("masked"))


@query(r"""SELECT doc_id, substring(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text,
 '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
 '\s+', ' ', 'g')), 1, 2000) AS clean FROM documents""")
def html_clean(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.html_clean(F.col("text")).alias("clean"))


@query(r"""SELECT source, count(*) AS n, sum(CASE WHEN regexp_matches(text, 'Ã.|Å.|â€') THEN 1 ELSE 0 END)::BIGINT AS mojibake,
 sum(CASE WHEN regexp_matches(text, '<\|[^|>]{1,40}\|>|</?s>|\[/?INST\]') THEN 1 ELSE 0 END)::BIGINT AS special_token,
 sum(CASE WHEN regexp_matches(text, '(?m)^#{1,4} |\*\*[^*\n]+\*\*') THEN 1 ELSE 0 END)::BIGINT AS markup FROM documents GROUP BY source""")
def leak_token_flags(t: Tables) -> DataFrame:
    flags = text.leak_flags(F.col("text"))
    named = [F.sum(F.when(flags[k], 1).otherwise(0)).alias(k) for k in ("mojibake", "special_token", "markup")]
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *named)


@query(r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\s]+')) AS w FROM documents),
 c AS (SELECT CASE WHEN regexp_matches(w, '[一-鿿぀-ヿ가-힯]') THEN 'cjk' WHEN regexp_matches(w, '[Ѐ-ӿ]') THEN 'cyrillic'
 WHEN regexp_matches(w, '[؀-ۿ]') THEN 'arabic' WHEN regexp_matches(w, '[Ͱ-Ͽ]') THEN 'greek' WHEN regexp_matches(w, '[ąćęłńśźżĄĆĘŁŃŚŹŻ]') THEN 'polish'
 WHEN regexp_matches(w, '[A-Za-zÀ-ɏ]') THEN 'latin' WHEN regexp_matches(w, '[0-9]') THEN 'digits' ELSE 'other' END AS script FROM w)
 SELECT script, count(*) AS n FROM c GROUP BY script""")
def script_histogram(t: Tables) -> DataFrame:
    w = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\s]+)"), 1)).alias("w"))
    return w.groupBy(text.script_class(F.col("w")).alias("script")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(\p{L})-\n(\p{Ll})', '\1\2', 'g'), '([^\n])\n([^\n])', '\1 \2', 'g')) AS h FROM documents""")
def dehyphenated_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.dehyphenate(F.col("text"))).alias("h"))


NOISE = [r"^Menu \|", r"^Strona [0-9]+ z [0-9]+", "^Stopka"]


@query(r"""SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '(?:^Menu \|)|(?:^Strona [0-9]+ z [0-9]+)|(?:^Stopka)')), chr(10)) AS kept
 FROM documents""")
def page_noise_removed(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.drop_lines(F.col("text"), NOISE).alias("kept"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
 k AS (SELECT doc_id, l, list_transform(l, lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS k FROM l)
 SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(k, k[i]) = i), chr(10)) AS kept FROM k""")
def lines_deduplicated(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", text.dedup_lines(F.col("text")).alias("kept"))


@query(r"""WITH h AS (SELECT doc_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 40), ' ') AS head FROM documents WHERE text IS NOT NULL),
 f AS (SELECT doc_id, head, regexp_extract(head, '(?s)^(.*[.!?…])(?:\s|$)', 1) AS f FROM h) SELECT doc_id, CASE WHEN length(f) > 0 THEN f ELSE head END AS trimmed FROM f""")
def sentence_trim(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", text.trim_sentences(F.col("text"), 40).alias("trimmed"))


@query(f"""SELECT doc_id, lower(translate(title, '{text.MARKED}', '{text.FOLDED}')) AS folded FROM documents""")
def folded_titles(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.fold(F.col("title")).alias("folded"))


@query(rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}') AS w, regexp_extract_all(lower(text), '\p{{L}}+') AS l FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, len(list_distinct(list_transform(list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)), lambda x: substring(x, 1, 6))))::BIGINT AS distinct_terms,
 len(w)::BIGINT AS stems, len(list_distinct(list_filter(w, lambda x: length(x) >= 4)))::BIGINT AS long_words,
 len(list_filter(l, lambda x: length(x) >= 5 AND NOT list_contains({_STOP}, x)))::BIGINT AS content_stems FROM w""")
def tokeniser_sizes(t: Tables) -> DataFrame:
    x = F.col("text")
    size = lambda c: F.size(c).cast("bigint")
    return t.documents.where("text IS NOT NULL").select(
        "doc_id", size(text.distinct_terms(x, STOP)).alias("distinct_terms"), size(text.stems(x)).alias("stems"),
        size(text.long_words(x)).alias("long_words"), size(text.content_stems(x, STOP)).alias("content_stems"),
    )


@query(r"""WITH h AS (SELECT doc_id, md5(':' || doc_id::VARCHAR) AS h FROM documents)
 SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 8), lambda i: ('0x' || substring(h, i * 4 + 1, 4))::BIGINT)), lambda a, x: (a * 36 + x) % 100)::BIGINT AS bucket FROM h""")
def md5_bucket_split(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.md5_bucket(F.col("doc_id")).alias("bucket"))


@query()
def crc32_exam_number(t: Tables) -> DataFrame:
    return t.exam.select("row_id", text.exam_number(F.col("exam")).alias("number"))


@query(r"""SELECT split_part(section, '.', 1) AS roman, count(*) AS n FROM e5_items WHERE section IS NOT NULL GROUP BY 1""")
def roman_sections(t: Tables) -> DataFrame:
    return t.e5_items.where("section IS NOT NULL").groupBy(text.roman_head(F.col("section")).alias("roman")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT source, count(*) AS n, sum(CASE WHEN regexp_matches(text, '[0-9]{3,4} r\.|p\.n\.e\.') THEN 1 ELSE 0 END)::BIGINT AS dated FROM documents GROUP BY source""")
def dated_documents(t: Tables) -> DataFrame:
    dated = F.col("text").rlike(r"[0-9]{3,4} r\.|p\.n\.e\.")
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(dated, 1).otherwise(0)).alias("dated"))


@query(rf"""SELECT lang, sum(len(regexp_extract_all(text, '{W}')))::BIGINT AS words, sum(length(text))::BIGINT AS chars,
 round(1000.0 * sum(len(regexp_extract_all(text, '{W}'))) / sum(length(text)), 6) AS words_per_kchar FROM documents WHERE text IS NOT NULL GROUP BY lang""")
def words_per_kchar(t: Tables) -> DataFrame:
    d = t.documents.where("text IS NOT NULL").select("lang", text.count_words(F.col("text")).alias("w"), F.length("text").cast("bigint").alias("c"))
    return d.groupBy("lang").agg(F.sum("w").alias("words"), F.sum("c").alias("chars"), F.round(1000.0 * F.sum("w") / F.sum("c"), 6).alias("words_per_kchar"))


@query(r"""WITH k AS (SELECT row_id, type, max_points, map_entries(key) AS k, regexp_extract_all(model_answer, '(?m)^\s*([0-9A-Za-z]{1,2})\s*[.:)]\s*([A-Za-z0-9])\s*$', 1) AS a,
 regexp_extract_all(model_answer, '(?m)^\s*([0-9A-Za-z]{1,2})\s*[.:)]\s*([A-Za-z0-9])\s*$', 2) AS b FROM exam WHERE key IS NOT NULL AND model_answer IS NOT NULL),
 r AS (SELECT row_id, max_points AS most, len(k) AS of_, len(list_filter(k, lambda e: list_position(list_transform(a, lambda x: upper(x)), e.key) > 0
 AND upper(b[list_position(list_transform(a, lambda x: upper(x)), e.key)]) = e.value)) AS r FROM k)
 SELECT row_id, r::BIGINT AS right_parts, CASE WHEN most = 1 THEN CASE WHEN r = of_ THEN 1 ELSE 0 END WHEN of_ = 3 AND most = 2 THEN CASE r WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END
 WHEN most = of_ THEN r ELSE floor(most * r / of_) END::BIGINT AS points FROM r""")
def closed_answers_scored(t: Tables) -> DataFrame:
    e = t.exam.where("key IS NOT NULL AND model_answer IS NOT NULL")
    got = parsing.right_parts(F.col("key"), parsing.closed_parts(F.col("model_answer")))
    return e.select(
        "row_id", got.cast("bigint").alias("right_parts"), parsing.score(got, F.size("key"), F.col("max_points")).cast("bigint").alias("points")
    )


@query("""WITH g AS (SELECT r.range AS n_ok, n.range AS n, m.range AS most FROM range(0, 6) r, range(1, 6) n, range(1, 5) m WHERE r.range <= n.range)
 SELECT n_ok::BIGINT AS n_ok, n::BIGINT AS n, most::BIGINT AS most, CASE WHEN most = 1 THEN CASE WHEN n_ok = n THEN 1 ELSE 0 END WHEN n = 3 AND most = 2 THEN CASE n_ok WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END
 WHEN most = n THEN n_ok ELSE floor(most * n_ok / n) END::BIGINT AS points FROM g""")
def partial_credit_score(t: Tables) -> DataFrame:
    grid = t.spark.range(6).withColumnRenamed("id", "n_ok").crossJoin(t.spark.range(1, 6).withColumnRenamed("id", "n")).crossJoin(t.spark.range(1, 5).withColumnRenamed("id", "most"))
    return grid.where("n_ok <= n").withColumn("points", parsing.score(F.col("n_ok"), F.col("n"), F.col("most")).cast("bigint"))


@query(r"""SELECT doc_id, trim(split_part(title, ':', 1)) AS head, CASE WHEN strpos(title, ':') > 0 THEN trim(substring(title, strpos(title, ':') + 1)) ELSE '' END AS rest FROM documents WHERE title IS NOT NULL""")
def title_parts(t: Tables) -> DataFrame:
    at = F.instr("title", ":")
    rest = F.when(at > 0, F.trim(F.substring("title", at + 1, F.length("title")))).otherwise("")
    return t.documents.where("title IS NOT NULL").select("doc_id", F.trim(F.substring_index("title", ":", 1)).alias("head"), rest.alias("rest"))


@query(r"""SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events""")
def json_field(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(r"""SELECT row_id, CASE WHEN question IS NULL OR trim(question) = '' THEN 'empty' WHEN verified IS NOT TRUE THEN 'unverified' WHEN needs_image THEN 'image'
 WHEN len(regexp_extract_all(model_answer, '[^\s]+')) < 3 THEN 'short' ELSE 'keep' END AS reason FROM synthetic_items""")
def first_failing_reason(t: Tables) -> DataFrame:
    rules = {
        "empty": F.col("question").isNull() | (F.trim("question") == ""), "unverified": ~F.coalesce(F.col("verified"), F.lit(False)), "image": F.col("needs_image"),
        "short": text.count_tokens(F.col("model_answer")) < 3,
    }
    return t.synthetic_items.select("row_id", parsing.first_reason(rules).alias("reason"))


@query(r"""SELECT row_id, CASE WHEN type LIKE 'closed%' THEN 'closed' WHEN regexp_matches(lower(question), '^(wymień|podaj)') THEN 'list' WHEN regexp_matches(lower(question), 'uzasadnij|argument') THEN 'argue'
 WHEN regexp_matches(lower(question), '^wyjaśnij') THEN 'explain' ELSE 'other' END AS kind FROM synthetic_items WHERE question IS NOT NULL AND type IS NOT NULL""")
def rule_cascade(t: Tables) -> DataFrame:
    q = F.lower("question")
    rules = {"closed": F.col("type").like("closed%"), "list": q.rlike("^(wymień|podaj)"), "argue": q.rlike("uzasadnij|argument"), "explain": q.rlike("^wyjaśnij")}
    return t.synthetic_items.where("question IS NOT NULL AND type IS NOT NULL").select("row_id", parsing.first_reason(rules, "other").alias("kind"))


@query(r"""SELECT row_id, question || CASE WHEN source_text IS NULL OR trim(source_text) = '' THEN '' ELSE chr(10) || 'Źródło: ' || source_text END || chr(10) || coalesce(answer_format, '') AS prompt
 FROM synthetic_items WHERE question IS NOT NULL""")
def prompt_blocks(t: Tables) -> DataFrame:
    source = F.when(F.length(F.trim("source_text")) > 0, F.concat(F.lit("\nŹródło: "), F.col("source_text"))).otherwise("")
    return t.synthetic_items.where("question IS NOT NULL").select("row_id", F.concat("question", source, F.lit("\n"), F.coalesce("answer_format", F.lit(""))).alias("prompt"))


@query(r"""SELECT row_id, len(kb_facts)::BIGINT AS n_facts, array_to_string(list_slice(kb_facts, 1, 2), '; ') AS head FROM e5_items WHERE kb_facts IS NOT NULL""")
def fact_lists(t: Tables) -> DataFrame:
    return t.e5_items.where("kb_facts IS NOT NULL").select("row_id", F.size("kb_facts").cast("bigint").alias("n_facts"), F.array_join(F.slice("kb_facts", 1, 2), "; ").alias("head"))


# --- normalisers, dates, names ------------------------------------------------------------------------------------------------
@query(r"""SELECT row_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[–—−]', '-', 'g'), '[^0-9a-ząćęłńóśźż -]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM persons WHERE name IS NOT NULL""")
def normal_names(t: Tables) -> DataFrame:
    return t.persons.where("name IS NOT NULL").select("row_id", text.norm_name(F.col("name")).alias("name"))


_CITED = "(?:Za|Na podstawie|Źródło)\\s*:[^\\n]{0,250}|(?:" + "|".join(text.PRINT_CITIES) + ")[\\s,]*(?:[0-9]{4}(?:[–-][0-9]{2,4})?)?|s\\.\\s*[0-9]+(?:[–-][0-9]+)?|t\\.\\s*[IVX0-9]+|https?://[^\\s]+|dostęp[^\\n]{0,40}"


@query(f"""SELECT doc_id, md5(regexp_replace(text, '{_CITED}', ' ', 'g')) AS h, CASE WHEN regexp_matches(regexp_replace(text, '{_CITED}', ' ', 'g'), '(?i)unii|sejm|szlacht') THEN 'home' ELSE 'abroad' END AS scope FROM documents WHERE text IS NOT NULL""")
def scopes_without_citations(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.where("text IS NOT NULL").select("doc_id", F.md5(text.strip_citations(x)).alias("h"), text.scope_of(x, ["unii", "sejm", "szlacht"], "home", "abroad").alias("scope"))


@query(r"""WITH x AS (SELECT row_id, trim(regexp_replace(regexp_replace(title, '-\s+([a-ząćęłńóśźż])', '\1', 'g'), '\s+', ' ', 'g')) AS x FROM timeline WHERE title IS NOT NULL)
 SELECT row_id, CASE WHEN length(x) < 60 THEN translate(x, '[]', '') ELSE translate(x, '[]', '()') END AS title FROM x""")
def tidy_titles(t: Tables) -> DataFrame:
    return t.timeline.where("title IS NOT NULL").select("row_id", text.tidy(F.col("title")).alias("title"))


@query(r"""WITH p AS (SELECT row_id, list_filter(string_split(regexp_replace(text, '([.!?…])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS s FROM kompendium WHERE text IS NOT NULL),
 k AS (SELECT row_id, s, list_transform(s, lambda x: trim(regexp_replace(lower(x), '[^\p{L}\p{N}_]+', ' ', 'g'))) AS k FROM p) SELECT row_id, array_to_string(list_filter(s, lambda x, i: list_position(k, k[i]) = i), ' ') AS kept FROM k""")
def sentences_deduplicated(t: Tables) -> DataFrame:
    return t.kompendium.where("text IS NOT NULL").select("row_id", text.dedup_sentences(F.col("text")).alias("kept"))


@query(rf"""SELECT row_id, array_to_string(list_slice(list_transform(list_filter(regexp_extract_all(lower(question), '{W}'), lambda x: length(x) >= 4 AND NOT list_contains({_STOP}, x)), lambda x: substring(x, 1, 5)), 1, 3), ' ') AS terms FROM exam WHERE question IS NOT NULL""")
def first_key_terms(t: Tables) -> DataFrame:
    return t.exam.where("question IS NOT NULL").select("row_id", F.array_join(text.key_terms(F.col("question"), STOP), " ").alias("terms"))


@query(r"""WITH x AS (SELECT row_id, question, list_distinct(regexp_extract_all(question, '(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)', 1)) AS r FROM exam WHERE question IS NOT NULL) SELECT row_id, len(r)::BIGINT AS runs FROM x""")
def entity_runs(t: Tables) -> DataFrame:
    runs = F.array_distinct(F.regexp_extract_all("question", F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"), 1))
    return t.exam.where("question IS NOT NULL").select("row_id", F.size(runs).cast("bigint").alias("runs"))


@query()
def entity_queries(t: Tables) -> DataFrame:
    return t.exam.where("question IS NOT NULL").select("row_id", text.entity_query(F.col("question")).alias("query"))


@query(rf"""WITH l AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(?:Za|Na podstawie|Źródło)\s*:|(?:{"|".join(text.PRINT_CITIES)})[\s,]+[0-9]{{4}}')), chr(10)) AS x FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(lower(regexp_replace(x, 'https?://[^\s]+', ' ', 'g')), '{W}'), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)), lambda x: substring(x, 1, 6))))::BIGINT AS terms FROM l""")
def terms_of_uncited_lines(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.size(text.cited_terms(F.col("text"), STOP)).cast("bigint").alias("terms"))


@query()
def years_of_entries(t: Tables) -> DataFrame:
    """Years in the texts with those before our era and centuries, and their median; the pattern needs look-ahead, so no SQL."""
    x = F.col("text")
    return t.timeline.where("text IS NOT NULL").select("row_id", F.array_join(F.transform(text.years_in(x), lambda y: y.cast("string")), ",").alias("years"), text.median_year(x, KEYWORD_YEARS).alias("median"))


#: Word stems of an age and a year that stands for it.
KEYWORD_YEARS = [("starożyt|faraon|polis", 0), ("średniow|krucj|rycer|feudal", 1100), ("szlacht|sejmik|reformac|oświeceni", 1650), ("zabor|powstani", 1860), ("okupac|wojn.{1,12} światow", 1930)]


@query(r"""SELECT row_id, md5('k:' || id) AS m, sha256('k:' || id) AS s2 FROM persons WHERE id IS NOT NULL""")
def content_keys(t: Tables) -> DataFrame:
    key = F.concat(F.lit("k:"), F.col("id"))
    return t.persons.where("id IS NOT NULL").select("row_id", F.md5(key).alias("m"), F.sha2(key, 256).alias("s2"))


@query(r"""WITH t AS (SELECT category, trim(regexp_replace(translate(lower(category), 'ąćęłńóśźż', 'acelnoszz'), '[^\p{L}\p{N}]+', ' ', 'g')) AS k, upper(regexp_extract(category, '^\s*([IVXLCDMivxlcdm]+)\s*(?:\.|$)', 1)) AS h FROM e5_targets WHERE dim = 'section'),
 s AS (SELECT DISTINCT section, trim(regexp_replace(translate(lower(section), 'ąćęłńóśźż', 'acelnoszz'), '[^\p{L}\p{N}]+', ' ', 'g')) AS k, upper(regexp_extract(section, '^\s*([IVXLCDMivxlcdm]+)\s*(?:\.|$)', 1)) AS h FROM e5_items WHERE section IS NOT NULL),
 p AS (SELECT *, CASE WHEN regexp_matches(section, '(?:…|\.\.\.)\s*$') THEN k WHEN length(k) >= 24 THEN substring(k, 1, 24) END AS p FROM s),
 c AS (SELECT section, coalesce((SELECT min(category) FROM t WHERE t.k = p.k), (SELECT min(category) FROM t WHERE t.h = p.h AND p.h <> '' HAVING count(*) = 1), (SELECT min(category) FROM t WHERE starts_with(t.k, p.p) AND p.p <> '' HAVING count(*) = 1)) AS canonical FROM p)
 SELECT row_id, canonical FROM e5_items LEFT JOIN c USING (section)""")
def canonical_sections(t: Tables) -> DataFrame:
    from ..functions.names import canonical

    known = [r["category"] for r in t.e5_targets.where("dim = 'section'").orderBy("category").collect()]  # the fixed list of categories
    return t.e5_items.select("row_id", canonical(F.col("section"), known).alias("canonical"))


@query(rf"""WITH w AS (SELECT source, len(regexp_extract_all(text, '{W}')) AS w, length(text) AS c, CASE WHEN source = 'passages' THEN 1 ELSE 0 END AS base FROM documents WHERE text IS NOT NULL),
 b AS (SELECT sum(w) / sum(c) AS r FROM w WHERE base = 1) SELECT source, round(1000.0 * sum(w) / sum(c), 6) AS per_kchar, round(100.0 * (sum(w) / sum(c) / (SELECT r FROM b) - 1), 6) AS inflation FROM w GROUP BY source""")
def token_inflation(t: Tables) -> DataFrame:
    from ..operators.reports import inflation

    d = t.documents.where("text IS NOT NULL").select("source", text.count_words(F.col("text")).alias("w"), F.length("text").cast("bigint").alias("c"))
    return inflation(d, "source", "passages", F.col("w"), F.col("c"))


@query(r"""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE strpos(text, '[Obraz:') > 0), p AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: strpos(x, '[Obraz:') > 0), true) AS i FROM x),
 a AS (SELECT doc_id, list_filter(list_transform(CASE WHEN i > 1 THEN list_slice(l, greatest(i - 6, 1), i - 1) ELSE [] END, lambda x: trim(x)), lambda x: length(x) >= 3) AS a FROM p) SELECT doc_id, coalesce(a[-1], '') AS title FROM a""")
def titles_above_images(t: Tables) -> DataFrame:
    return t.documents.where(F.contains("text", F.lit("[Obraz:"))).select("doc_id", text.nearest_above(F.col("text"), "[Obraz:").alias("title"))


@query(r"""WITH p AS (SELECT row_id, regexp_split_to_array(text, '\n\s*\n') AS p FROM kompendium WHERE text IS NOT NULL) SELECT row_id, array_to_string(CASE WHEN len(p) > 1 THEN list_concat(list_slice(p, 1, len(p) - 1), ['[note]'], [p[-1]]) ELSE list_append(p, '[note]') END, chr(10) || chr(10)) AS text FROM p""")
def paragraph_inserted(t: Tables) -> DataFrame:
    return t.kompendium.where("text IS NOT NULL").select("row_id", text.before_last_paragraph(F.col("text"), F.lit("[note]")).alias("text"))


@query("""SELECT section, string_agg('=== ' || row_id || ' ===' || chr(10) || title, chr(10) || chr(10) ORDER BY row_id) AS block FROM (SELECT section, row_id, title, row_number() OVER (PARTITION BY section ORDER BY row_id) AS rn FROM kompendium WHERE section IS NOT NULL AND title IS NOT NULL) WHERE rn <= 20 GROUP BY section""")
def page_blocks(t: Tables) -> DataFrame:
    """The first twenty notes of a section under headers, in order."""
    from ..operators import windows

    rows = windows.top_k(t.kompendium.where("section IS NOT NULL AND title IS NOT NULL").select("section", "row_id", "title"), ["section"], ["row_id"], 20)
    part = F.struct("row_id", F.concat(F.lit("=== "), F.col("row_id").cast("string"), F.lit(" ===\n"), "title").alias("x"))
    return rows.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "\n\n").alias("block"))
