"""Catalogue: answers of items, rewritten, checked, parsed and graded; validation of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers, parsing, text
from .registry import Tables, query

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_LINES = "list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_PATTERNS = {"closed_tf": r"^([0-9]+)\s*[.):-]\s*([PpFf])", "closed_multi": r"^([0-9]+)\s*[.):-]\s*([A-Fa-f])", "closed_match": r"^([A-Fa-f])\s*[.):-]\s*(.+)$"}


def _normal_sql(kind: str, said: str) -> str:
    """SQL of the normal form of a closed answer."""
    out = [rf"WHEN {kind} = 'closed_choice' THEN upper(CASE WHEN regexp_extract({said}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Fa-f])(?:[^\p{{L}}\p{{N}}_]|$)', 1) <> '' THEN regexp_extract({said}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Fa-f])(?:[^\p{{L}}\p{{N}}_]|$)', 1) ELSE {_STRIP.format(said)} END)"]
    for k, p in _PATTERNS.items():
        value = f"regexp_extract(x, '{p}', 2)" if k == "closed_match" else f"upper(regexp_extract(x, '{p}', 2))"
        squeezed = f"list_transform({_LINES.format(said)}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')))"
        out.append(f"WHEN {kind} = '{k}' THEN array_to_string(list_transform(list_filter({squeezed}, lambda x: regexp_matches(x, '{p}')), lambda x: regexp_replace(upper(regexp_extract(x, '{p}', 1)), '^0+([0-9])', '\\1') || ': ' || trim({value})), chr(10))")
    return "CASE " + " ".join(out) + f" ELSE {_STRIP.format(said)} END"


_MESSY = "regexp_replace(model_answer, ': ', ') ', 'g')"


@query(f"SELECT row_id, {_normal_sql('type', _MESSY)} AS normal FROM e5_items WHERE model_answer IS NOT NULL AND type IS NOT NULL")
def normal_closed_answers(t: Tables) -> DataFrame:
    items = t.e5_items.where("model_answer IS NOT NULL AND type IS NOT NULL")
    return items.select("row_id", answers.normal_closed(F.col("type"), F.regexp_replace("model_answer", ": ", ") ")).alias("normal"))


@query(rf"""WITH a AS (SELECT row_id, type, {_STRIP.format("coalesce(model_answer, '')")} AS s, {_normal_sql('type', "coalesce(model_answer, '')")} AS n FROM synthetic_items WHERE type IS NOT NULL),
 l AS (SELECT *, {_LINES.format('n')} AS l FROM a)
 SELECT row_id, s <> '' AND CASE WHEN type = 'closed_choice' THEN regexp_matches(n, '^[A-F]$') WHEN type = 'closed_tf' THEN len(l) >= 2 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[0-9]+: [PF]$'))) = 0
 WHEN type = 'closed_multi' THEN len(l) >= 2 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[0-9]+: [A-F]$'))) = 0 WHEN type = 'closed_match' THEN len(l) >= 2 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[A-F]: [^\s].*$'))) = 0
 WHEN type = 'open' THEN length(s) >= 2 AND NOT regexp_matches(lower(s), '\salbo\s') AND strpos(s, ' / ') = 0 WHEN type = 'essay' THEN starts_with(s, 'Temat nr') AND len(regexp_split_to_array(s, '\s+')) >= 300 ELSE false END AS valid FROM l""")
def valid_answers(t: Tables) -> DataFrame:
    return t.synthetic_items.where("type IS NOT NULL").select("row_id", answers.valid_answer(F.col("type"), F.col("model_answer")).alias("valid"))


@query(rf"""WITH n AS (SELECT row_id, type, greatest(len({_LINES.format('model_answer')}), 1) AS n FROM e5_items WHERE type IS NOT NULL)
 SELECT row_id, CASE WHEN type = 'closed_tf' THEN array_to_string(list_transform(range(1, n + 1), lambda i: i::VARCHAR || ': ' || CASE WHEN i % 2 = 1 THEN 'P' ELSE 'F' END), chr(10))
 WHEN type = 'closed_match' THEN array_to_string(list_transform(range(1, n + 1), lambda i: substring('ABCDEF', i::INT, 1) || ': 1'), chr(10)) WHEN type = 'closed_multi' THEN array_to_string(list_transform(range(1, n + 1), lambda i: i::VARCHAR || ': A'), chr(10))
 WHEN type = 'closed_choice' THEN 'A' WHEN type = 'essay' THEN 'Numer tematu i wypracowanie.' ELSE 'Pełne zdania po polsku.' END AS format FROM n""")
def answer_formats(t: Tables) -> DataFrame:
    return t.e5_items.where("type IS NOT NULL").select("row_id", answers.format_of(F.col("type"), F.col("model_answer")).alias("format"))


_TAILS = {"closed_tf": r"\s*[.):–-]*\s*[:–-]?\s*([PF])(?:[^\p{L}\p{N}_]|$)", "closed_multi": r"\s*[.):–-]*\s*[:–-]?\s*\(?([A-F])(?:[^\p{L}\p{N}_]|$)", "closed_match": r"\s*[.):–-]*\s*[:–→-]\s*([^\n]+)"}
_SAID = "regexp_replace('Odpowiedź' || chr(10) || regexp_replace(model_answer, ': ', ' – ', 'g'), 'P$', 'Prawda')"


def _fitted_sql(k: str) -> str:
    said = r"regexp_replace(regexp_replace(s, '(?i)fałsz\p{L}*', 'F', 'g'), '(?i)prawd\p{L}*', 'P', 'g')" if k == "closed_tf" else "s"
    value = rf"regexp_replace(regexp_extract({said}, '(?m)(?:^|\s)\Q' || key || '\E{_TAILS[k]}', 1), '^\s+|\s+$', '', 'g')"
    if k == "closed_match":
        value = f"CASE WHEN numeric AND regexp_extract({value}, '([0-9]+)', 1) <> '' THEN regexp_extract({value}, '([0-9]+)', 1) ELSE {value} END"
    rows = f"list_transform(keys, lambda key: {value})"
    return f"CASE WHEN len(keys) > 0 AND NOT list_contains({rows}, '') THEN array_to_string(list_transform(keys, lambda key: key || ': ' || {value}), chr(10)) ELSE {_STRIP.format('raw')} END"


@query(rf"""WITH a AS (SELECT row_id, type, {_SAID} AS raw, regexp_replace({_SAID}, '[*_`#]', '', 'g') AS s, {_LINES.format('answer_format')} AS f FROM e5_items WHERE type LIKE 'closed%' AND model_answer IS NOT NULL AND answer_format IS NOT NULL),
 k AS (SELECT *, list_transform(f, lambda x: {_STRIP.format("split_part(x, ':', 1)")}) AS keys, regexp_matches({_STRIP.format("string_split(f[1], ':')[-1]")}, '^[0-9]+$') AS numeric FROM a)
 SELECT row_id, CASE WHEN type = 'closed_choice' THEN coalesce(regexp_extract_all(s, '(?:^|[\s(])([A-F])(?:[).:\s]|$)', 1)[-1], {_STRIP.format('raw')}) WHEN type = 'closed_tf' THEN {_fitted_sql('closed_tf')}
 WHEN type = 'closed_multi' THEN {_fitted_sql('closed_multi')} WHEN type = 'closed_match' THEN {_fitted_sql('closed_match')} ELSE {_STRIP.format('raw')} END AS answer FROM k""")
def fitted_answers(t: Tables) -> DataFrame:
    items = t.e5_items.where("type LIKE 'closed%' AND model_answer IS NOT NULL AND answer_format IS NOT NULL")
    said = F.regexp_replace(F.concat(F.lit("Odpowiedź\n"), F.regexp_replace("model_answer", ": ", " – ")), "P$", "Prawda")
    return items.select("row_id", answers.fitted(F.col("type"), F.col("answer_format"), said).alias("answer"))


@query(r"""WITH k AS (SELECT row_id, type, max_points AS most, map_entries(key) AS k, model_answer AS a FROM exam WHERE key IS NOT NULL AND type IN ('closed_tf', 'closed_multi')),
 v AS (SELECT *, list_transform(k, lambda e: regexp_extract(upper(a), CASE WHEN type = 'closed_tf' THEN '(?m)(?:^|\s)\Q' || e.key || '\E\s*[.):–-]*\s*[–:-]?\s*\(?([PF])(?:[^\p{L}\p{N}_]|$)' ELSE '(?m)^\s*\Q' || e.key || '\E\s*[.):–-]*\s*[:–-]?\s*\(?([A-F])(?:[^\p{L}\p{N}_]|$)' END, 1)) AS v FROM k),
 r AS (SELECT row_id, most, len(k) AS n, list_contains(v, '') AS unclear, len(list_filter(k, lambda e, i: e.value = v[i])) AS ok FROM v WHERE a IS NOT NULL)
 SELECT row_id, CASE WHEN unclear THEN NULL WHEN most = 1 THEN CASE WHEN ok = n THEN 1 ELSE 0 END WHEN n = 3 AND most = 2 THEN CASE ok WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END WHEN most = n THEN ok ELSE floor(most * ok / n) END::BIGINT AS points FROM r""")
def graded_free_answers(t: Tables) -> DataFrame:
    e = t.exam.where("key IS NOT NULL AND type IN ('closed_tf', 'closed_multi') AND model_answer IS NOT NULL")
    return e.select("row_id", answers.graded(F.col("type"), F.col("key"), F.col("max_points"), F.col("model_answer"), F.col("question")).cast("bigint").alias("points"))


@query(rf"""WITH s AS (SELECT row_id, {_LINES.format('solution')} AS l FROM exam WHERE solution IS NOT NULL AND type LIKE 'closed%')
 SELECT row_id, CASE WHEN len(l) = 1 AND regexp_matches(l[1], '^[A-F]\.?$') THEN '1=' || substring(l[1], 1, 1) WHEN len(l) BETWEEN 2 AND 6 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^([0-9]{{1,2}}|[A-F])\s*[.:)–-]\s*([^\s].*)$'))) = 0
 THEN array_to_string(list_sort(list_transform(l, lambda x: regexp_extract(x, '^([0-9]{{1,2}}|[A-F])\s*[.:)–-]\s*([^\s].*)$', 1) || '=' || regexp_extract(x, '^([0-9]{{1,2}}|[A-F])\s*[.:)–-]\s*([^\s].*)$', 2))), ',') END AS key FROM s""")
def keys_from_solutions(t: Tables) -> DataFrame:
    closed = t.exam.where("solution IS NOT NULL AND type LIKE 'closed%'").select("row_id", answers.key_of(F.col("solution")).alias("k"))
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("k"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return closed.select("row_id", pairs.alias("key"))


@query("""SELECT row_id, CASE WHEN len(list_filter(map_values(key), lambda v: v NOT IN ('P', 'F'))) = 0 THEN 'closed_tf' WHEN len(list_filter(map_keys(key), lambda k: NOT regexp_matches(k, '^\\p{L}+$'))) = 0 THEN 'closed_match' ELSE 'closed_choice' END AS kind FROM exam WHERE key IS NOT NULL""")
def kinds_from_keys(t: Tables) -> DataFrame:
    return t.exam.where("key IS NOT NULL").select("row_id", answers.key_kind(F.col("key")).alias("kind"))


@query()
def answer_contents(t: Tables) -> DataFrame:
    """What closed answers say in words; checked by hand-derived cases."""
    return t.exam.where("question IS NOT NULL").select("row_id", answers.answer_content(F.col("type"), F.col("question"), F.col("model_answer")).alias("said"))


_FOLD = f"lower(translate({{0}}, '{text.MARKED}', '{text.FOLDED}'))"
_PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(' ' || regexp_replace(" + _FOLD + ", '[\\[\\]()*_.,;:\"„”'']', ' ', 'g') || ' ', '\\s+', '  ', 'g'), ' (?:zakon|dynastia|fragment|krol|cesarz) ', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT row_id, {_PLAIN.format('title')} AS a, {_PLAIN.format("coalesce(section, '')")} AS b FROM timeline WHERE title IS NOT NULL),
 s AS (SELECT row_id, a, b, list_transform(list_filter(string_split(a, ' '), lambda w: length(w) >= 4), lambda w: substring(w, 1, 5)) AS x, list_transform(list_filter(string_split(b, ' '), lambda w: length(w) >= 4), lambda w: substring(w, 1, 5)) AS y,
 list_sort(list_distinct(list_filter(string_split(a, ' '), lambda w: regexp_matches(w, '^[ivxl]+$')))) AS ra, list_sort(list_distinct(list_filter(string_split(b, ' '), lambda w: regexp_matches(w, '^[ivxl]+$')))) AS rb FROM p)
 SELECT row_id, b <> '' AND (a = b OR (ra = rb AND len(y) > 0 AND len(list_filter(y, lambda t: NOT list_contains(x, t))) = 0)) AS alike FROM s""")
def lenient_matches(t: Tables) -> DataFrame:
    named = t.timeline.where("title IS NOT NULL")
    return named.select("row_id", answers.alike(F.col("title"), F.coalesce("section", F.lit(""))).alias("alike"))


# --- record validation --------------------------------------------------------------------------------------------------------
@query(r"""WITH w AS (SELECT *, len(regexp_extract_all(source_text, '[\p{L}\p{N}_]+')) AS n FROM e5_items)
 SELECT row_id, CASE WHEN source_text IS NULL OR trim(source_text) = '' THEN 'no source' WHEN source_kind = 'ilustracja' AND strpos(source_text, '[Obraz:') = 0 THEN 'no image marker'
 WHEN source_kind = 'ilustracja' THEN 'ok' WHEN strpos(source_text, '[Obraz:') > 0 THEN 'image in text' WHEN source_kind = 'tabela' AND strpos(source_text, '|') = 0 THEN 'no table'
 WHEN source_kind = 'tabela' AND n NOT BETWEEN 15 AND 240 THEN 'table length' WHEN coalesce(source_kind, '') <> 'tabela' AND n NOT BETWEEN 40 AND 240 THEN 'source length' ELSE 'ok' END AS problem FROM w""")
def source_problems(t: Tables) -> DataFrame:
    kind, source, n = F.col("source_kind"), F.col("source_text"), text.count_words(F.col("source_text"))
    marker = F.contains(source, F.lit("[Obraz:"))
    rules = {
        "no source": F.coalesce(F.trim(source), F.lit("")) == "", "no image marker": (kind == "ilustracja") & ~marker, "ok": kind == "ilustracja", "image in text": marker,
        "no table": (kind == "tabela") & ~F.contains(source, F.lit("|")), "table length": (kind == "tabela") & ~n.between(15, 240), "source length": (F.coalesce(kind, F.lit("")) != "tabela") & ~n.between(40, 240),
    }
    return t.e5_items.select("row_id", parsing.first_reason(rules, "ok").alias("problem"))


@query(r"""SELECT row_id, CASE WHEN question IS NULL OR trim(question) = '' THEN 'question' WHEN type IS NULL THEN 'type' WHEN len(regexp_extract_all(rationale, '[\p{L}\p{N}_]+')) NOT BETWEEN 80 AND 400 OR rationale IS NULL THEN 'rationale'
 WHEN kb_facts IS NULL OR len(list_filter(kb_facts, lambda x: trim(x) <> '')) NOT BETWEEN 3 AND 5 THEN 'facts' WHEN leak THEN 'leak' ELSE 'ok' END AS gate FROM e5_items""")
def gate_chain(t: Tables) -> DataFrame:
    facts = F.size(F.filter("kb_facts", lambda x: F.trim(x) != ""))
    rules = {
        "question": F.coalesce(F.trim("question"), F.lit("")) == "", "type": F.col("type").isNull(), "rationale": F.col("rationale").isNull() | ~text.count_words(F.col("rationale")).between(80, 400),
        "facts": F.col("kb_facts").isNull() | ~facts.between(3, 5), "leak": F.col("leak"),
    }
    return t.e5_items.select("row_id", parsing.first_reason(rules, "ok").alias("gate"))


@query(r"""SELECT 'timeline' AS tab, row_id FROM timeline WHERE length(trim(text)) >= 40 AND (year IS NOT NULL OR regexp_matches(text, '[0-9]{3,4} r\.|p\.n\.e\.')) UNION ALL SELECT 'persons', row_id FROM persons WHERE length(trim(text)) >= 40 AND trim(name) <> ''
 UNION ALL SELECT 'kompendium', row_id FROM kompendium WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) BETWEEN 20 AND 420 AND section IS NOT NULL""")
def valid_notes(t: Tables) -> DataFrame:
    long = F.length(F.trim("text")) >= 40
    dated = F.col("year").isNotNull() | F.col("text").rlike(r"[0-9]{3,4} r\.|p\.n\.e\.")
    pick = lambda name, df: df.select(F.lit(name).alias("tab"), "row_id")
    return pick("timeline", t.timeline.where(long & dated)).union(pick("persons", t.persons.where(long & (F.trim("name") != "")))).union(
        pick("kompendium", t.kompendium.where(text.count_words(F.col("text")).between(20, 420) & F.col("section").isNotNull()))
    )


@query(r"""SELECT row_id, trim(regexp_replace(question, '\s+', ' ', 'g')) AS question, least(3, greatest(1, coalesce(max_points, 1))) AS points, coalesce(nullif(split_part(id, '.', 1), ''), '?') AS task,
 coalesce(len(images) > 0, false) OR regexp_matches(lower(question), 'ilustracj|fotograf|rycin|map[aęy]|plakat') AS image FROM exam WHERE question IS NOT NULL AND trim(question) <> ''""")
def built_records(t: Tables) -> DataFrame:
    image = F.coalesce(F.size("images") > 0, F.lit(False)) | F.lower("question").rlike("ilustracj|fotograf|rycin|map[aęy]|plakat")
    return t.exam.where("question IS NOT NULL AND trim(question) <> ''").select(
        "row_id", text.squeeze(F.col("question")).alias("question"), F.least(F.lit(3), F.greatest(F.lit(1), F.coalesce("max_points", F.lit(1)))).alias("points"),
        F.coalesce(F.nullif(F.split_part("id", F.lit("."), F.lit(1)), F.lit("")), F.lit("?")).alias("task"), image.alias("image"),
    )


LABELS = ["Rozstrzygnięcie", "Uzasadnienie", "Podobieństwo", "Różnica", "Przyczyna", "Skutek"]


@query(r"""WITH l AS (SELECT row_id, list_filter(list_transform(string_split(solution, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM exam WHERE solution IS NOT NULL AND starts_with(solution, 'Rozstrzygnięcie:') AND len(string_split(solution, chr(10))) = 2)
 SELECT row_id, trim(regexp_extract(l[1], '^Rozstrzygnięcie:\s*(.*)$', 1)) AS ruling, trim(regexp_extract(l[2], '^Uzasadnienie:\s*(.*)$', 1)) AS grounds FROM l WHERE starts_with(l[2], 'Uzasadnienie:')""")
def solution_sections(t: Tables) -> DataFrame:
    two = F.col("solution").startswith("Rozstrzygnięcie:") & (F.size(F.split("solution", "\n")) == 2) & F.col("solution").rlike(r"\n\s*Uzasadnienie:")
    s = t.exam.where(two).select("row_id", parsing.labelled_sections(F.col("solution"), LABELS).alias("s"))
    body = lambda name: F.try_element_at(F.filter("s", lambda x: x["label"] == name), F.lit(1))["body"]
    return s.select("row_id", body("Rozstrzygnięcie").alias("ruling"), body("Uzasadnienie").alias("grounds"))


REASONS = [("incomplete", "niepełn|brak", "błędn"), ("fact", "błąd|nieprawd", None)]


@query("""SELECT row_id, CASE WHEN coalesce(verify.judge_max - verify.judge_points, 0) <= 0 THEN NULL WHEN trim(coalesce(verify.blind_answer, '')) = '' THEN 'no answer' WHEN type LIKE 'closed%' THEN 'form' WHEN regexp_matches(rationale, '(?i)niepełn|brak') AND NOT regexp_matches(rationale, '(?i)błędn') THEN 'incomplete'
 WHEN regexp_matches(rationale, '(?i)błąd|nieprawd') THEN 'fact' ELSE 'reasoning' END AS error FROM e5_items WHERE type IS NOT NULL AND rationale IS NOT NULL""")
def error_kinds(t: Tables) -> DataFrame:
    lost = F.col("verify.judge_max") - F.col("verify.judge_points")
    kind = parsing.error_kind(lost, F.col("type").like("closed%"), F.col("verify.blind_answer"), F.col("rationale"), REASONS, "reasoning")
    return t.e5_items.where("type IS NOT NULL AND rationale IS NOT NULL").select("row_id", kind.alias("error"))
