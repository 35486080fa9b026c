"""Answers in the format of their item: rewriting, parsing, lenient comparison, grading with 'not clear' as null.

Everything is an expression; patterns that depend on a row's keys are columns. Patterns keep to what Java and RE2 share, so the
same text stands in the SQL counterparts. Words of a language are parameters with defaults.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import right_parts, score
from .text import fold, let, squeeze

#: A letter A to F that stands alone.
ALONE = r"(?:^|[^\p{L}\p{N}_])([A-Fa-f])(?:[^\p{L}\p{N}_]|$)"
#: A numbered or lettered line of each kind of closed answer: its key and its value.
LINES = {
    "closed_tf": r"^([0-9]+)\s*[.):-]\s*([PpFf])", "closed_multi": r"^([0-9]+)\s*[.):-]\s*([A-Fa-f])", "closed_match": r"^([A-Fa-f])\s*[.):-]\s*(.+)$",
}
#: What a whole normal answer of each kind looks like, line by line.
SHAPES = {"closed_tf": r"^[0-9]+: [PF]$", "closed_multi": r"^[0-9]+: [A-F]$", "closed_match": r"^[A-F]: [^\s].*$"}
#: What an answer format asks for where it is not a pattern.
FORMATS = {"closed_choice": "A", "essay": "Numer tematu i wypracowanie.", "open": "Pełne zdania po polsku."}


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The trimmed lines of a text that are not blank; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: strip(x)), lambda x: x != "")


def of_kind(kind: Column, cases: dict[str, Column], other: Column) -> Column:
    """The case of a kind of item."""
    out = None
    for k, c in cases.items():
        out = F.when(kind == k, c) if out is None else out.when(kind == k, c)
    return other if out is None else out.otherwise(other)


def _normal_lines(kind: str, pattern: str, text: Column) -> Column:
    """The lines of a kind: numbers lose leading zeros; letters of keys and of single values are capitals, names stay as they are."""

    def line(x: Column) -> Column:
        value = strip(F.regexp_extract(x, pattern, 2))
        key = F.regexp_replace(F.upper(F.regexp_extract(x, pattern, 1)), "^0+([0-9])", "$1")
        return F.concat(key, F.lit(": "), value if kind == "closed_match" else F.upper(value))

    found = F.filter(F.transform(lines(text), lambda x: squeeze(x)), lambda x: x.rlike(pattern))
    return F.array_join(F.transform(found, line), "\n")


def normal_closed(kind: Column, text: Column) -> Column:
    """A closed answer in normal form: the first letter that stands alone, or ``key: value`` lines in the order written."""
    letter = F.regexp_extract(text, ALONE, 1)
    cases = {"closed_choice": F.upper(F.when(letter != "", letter).otherwise(strip(text)))}
    cases |= {k: _normal_lines(k, pattern, text) for k, pattern in LINES.items()}
    return of_kind(kind, cases, strip(text))


def has_alternatives(text: Column) -> Column:
    """Whether an answer offers more than one wording."""
    return F.lower(text).rlike(r"\salbo\s") | F.contains(text, F.lit(" / "))


def one_wording(text: Column, labels: list[str]) -> Column:
    """An answer with one wording: numbers around a slash become a range, what follows a free-standing slash goes up to the next
    sign, and labels such as 'example answer:' go too. One pass takes all wordings of a chain, so nothing is left to repeat."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9])\s*/\s*([0-9])", "$1–$2")
    x = F.regexp_replace(x, r"\s+/\s+[^,.;:\n]{1,90}", "")
    x = F.regexp_replace(x, "(?i)(?:" + "|".join(labels) + r"):?\s*", "")
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def valid_answer(kind: Column, text: Column, essay_start: str = "Temat nr", essay_words: int = 300) -> Column:
    """Whether an answer has the shape of its kind; blank and null answers have none."""
    said = strip(F.coalesce(text, F.lit("")))
    normal = normal_closed(kind, said)
    cases = {"closed_choice": normal.rlike("^[A-F]$")}
    whole = lambda shape: (F.size(lines(normal)) >= 2) & F.forall(lines(normal), lambda x: x.rlike(shape))
    cases |= {k: whole(shape) for k, shape in SHAPES.items()}
    cases["open"] = (F.length(said) >= 2) & ~has_alternatives(said)
    cases["essay"] = F.startswith(said, F.lit(essay_start)) & (F.size(F.split(said, r"\s+")) >= essay_words)
    return (said != "") & of_kind(kind, cases, F.lit(False))


def format_of(kind: Column, text: Column, other: dict[str, str] = FORMATS) -> Column:
    """The answer format a model answer of so many lines asks for."""
    n = F.greatest(F.size(lines(text)), F.lit(1))
    each = lambda f: F.array_join(F.transform(F.sequence(F.lit(1), n), f), "\n")
    letters = F.array(*map(F.lit, "ABCDEF"))
    cases = {
        "closed_tf": each(lambda i: F.concat_ws(": ", i.cast("string"), F.when(i % 2 == 1, "P").otherwise("F"))),
        "closed_match": each(lambda i: F.concat(F.try_element_at(letters, i), F.lit(": 1"))), "closed_multi": each(lambda i: F.concat(i.cast("string"), F.lit(": A"))),
    }
    return of_kind(kind, cases | {k: F.lit(v) for k, v in other.items() if k != "open"}, F.lit(other["open"]))


def format_keys(fmt: Column) -> Column:
    """The keys of a format's ``key: value`` lines."""
    return F.transform(lines(fmt), lambda x: strip(F.substring_index(x, ":", 1)))


def _found(text: Column, *pattern: Column | str, group: int = 1) -> Column:
    """The group of the first match of a pattern made of columns and strings; '' if there is none."""
    whole = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pattern])
    return F.call_function("regexp_extract", text, whole, F.lit(group))


def _quoted(k: Column) -> Column:
    return F.concat(F.lit(r"\Q"), k, F.lit(r"\E"))


def fitted(kind: Column, fmt: Column, text: Column) -> Column:
    """A free answer rewritten to the syntax of its format; as it stands where a key of the format is not found.

    Of a choice the last letter that stands alone counts. Where the format's values are numbers, a matching is cut to its number.
    """
    bare = F.regexp_replace(text, "[*_`#]", "")
    letters = F.regexp_extract_all(bare, F.lit(r"(?:^|[\s(])([A-F])(?:[).:\s]|$)"), 1)
    spelled = F.regexp_replace(F.regexp_replace(bare, r"(?i)fałsz\p{L}*", "F"), r"(?i)prawd\p{L}*", "P")
    tails = {"closed_tf": r"\s*[.):–-]*\s*[:–-]?\s*([PF])(?:[^\p{L}\p{N}_]|$)", "closed_multi": r"\s*[.):–-]*\s*[:–-]?\s*\(?([A-F])(?:[^\p{L}\p{N}_]|$)", "closed_match": r"\s*[.):–-]*\s*[:–→-]\s*([^\n]+)"}
    numeric = strip(F.substring_index(F.element_at(lines(fmt), 1), ":", -1)).rlike("^[0-9]+$")
    cases = {"closed_choice": F.coalesce(F.try_element_at(letters, F.lit(-1)), strip(text))}

    def rewritten(k: str, tail: str) -> Column:
        said = spelled if k == "closed_tf" else bare

        def pick(key: Column) -> Column:
            value = strip(_found(said, r"(?m)(?:^|\s)", _quoted(key), tail))
            number = F.regexp_extract(value, "([0-9]+)", 1)
            return F.when(numeric & (number != ""), number).otherwise(value) if k == "closed_match" else value

        rows = F.transform(format_keys(fmt), lambda key: F.struct(key.alias("k"), pick(key).alias("v")))
        joined = lambda r: F.array_join(F.transform(r, lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n")
        return let(rows, lambda r: F.when((F.size(r) > 0) & F.forall(r, lambda x: x["v"] != ""), joined(r)).otherwise(strip(text)))

    cases |= {k: rewritten(k, tail) for k, tail in tails.items()}
    return of_kind(kind, cases, strip(text))


def parts(kind: Column, fmt: Column, answer: Column) -> Column:
    """map<key, value> of an answer that has every key of its format, else null; a choice has the key ''."""
    pairs = F.transform(F.filter(lines(answer), lambda x: F.instr(x, ":") > 1), lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("k"), strip(F.regexp_replace(x, r"^[^:]*:", "")).alias("v")))
    value = lambda key: F.element_at(F.filter(pairs, lambda p: (p["k"] == key) & (p["v"] != "")), -1)["v"]
    keys = format_keys(fmt)
    has = lambda key: F.exists(pairs, lambda p: (p["k"] == key) & (p["v"] != ""))
    letter = F.when(strip(answer).rlike("^[A-F]$"), F.create_map(F.lit(""), strip(answer)))
    return F.when(kind == "closed_choice", letter).when((F.size(keys) > 0) & F.forall(keys, has), F.map_from_arrays(keys, F.transform(keys, value)))


def only_digits(values: Column) -> Column:
    """Whether some value of a map has no letter, where names were asked for."""
    return F.exists(F.map_values(values), lambda v: ~v.rlike(r"\p{L}"))


def normal_grading(text: Column) -> Column:
    """Lower case without emphasis signs; compatibility forms of letters, digits, signs and ligatures as the plain ones."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    plain = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    x = F.translate(F.coalesce(text, F.lit("")), wide + "   ²³¹ªº", plain + "   231ao")
    for lig, two in {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "…": "...", "½": "1⁄2", "™": "tm", "℃": "°c"}.items():
        x = F.replace(x, F.lit(lig), F.lit(two))
    return F.regexp_replace(F.lower(x), r"[*_`#]", "")


def chosen(answer: Column, question: Column, said: str = "odpowied[źz]") -> Column:
    """The letter chosen in a free answer: the only one after a word for 'answer', else the only one that stands as a label, else
    the only option of the question whose text the answer holds. Null where none or several remain."""
    a = normal_grading(answer)
    explicit = F.array_distinct(F.regexp_extract_all(a, F.lit(said + r"[^:\n]{0,20}:\s*\(?([a-f])(?:[^\p{L}\p{N}_]|$)"), 1))
    marked = F.array_distinct(F.regexp_extract_all(a, F.lit(r"(?m)(?:^|[\s(\[])([a-f])(?:[.)\]:]|\s*$|\s+[–-])"), 1))
    options = F.filter(lines(question), lambda x: x.rlike(r"^[A-F]\.\s+"))
    texts = F.transform(options, lambda x: F.struct(F.substring(x, 1, 1).alias("k"), strip(F.regexp_replace(F.regexp_replace(x, r"^[A-F]\.\s+", ""), r"\.\s*$", "")).alias("v")))
    hits = F.filter(texts, lambda o: (F.length(o["v"]) > 4) & F.contains(a, normal_grading(o["v"])))
    one = lambda xs: F.when(F.size(xs) == 1, F.upper(F.try_element_at(xs, F.lit(1))))
    return F.coalesce(one(explicit), one(marked), F.when(F.size(hits) == 1, F.try_element_at(hits, F.lit(1))["k"]))


def matched(answer: Column, key: Column) -> Column:
    """map<key, value> of a matching read from a free answer against the key: the number said, or the key's own value where one of
    its wordings ('/' between them, brackets optional) is said; '?' where a key is not answered, 'WRONG' for another answer."""
    a = normal_grading(answer)
    segment = lambda k: strip(_found(a, r"(?m)(?:^|\s)", _quoted(F.lower(k)), r"\s*[.):–-]*\s*[:–→>-]\s*([^\n]+)"))
    number = lambda k: _found(a, r"(?m)(?:^|\s)", _quoted(F.lower(k)), r"\s*[.):–-]*\s*[:–→>-]*\s*([0-9])")

    def wordings(v: Column) -> Column:
        each = F.split(v, "/")
        both = F.concat(F.transform(each, lambda x: F.regexp_replace(x, r"[\[\]]", "")), F.transform(each, lambda x: F.regexp_replace(x, r"\[[^\]]*\]", "")))
        return F.filter(F.transform(both, lambda x: strip(normal_grading(x))), lambda x: x != "")

    def read(k: Column, v: Column) -> Column:
        named = F.when(segment(k) == "", "?").when(F.exists(wordings(v), lambda w: F.contains(segment(k), w)), v).otherwise("WRONG")
        return F.when(v.rlike("^[0-9]+$"), F.when(number(k) != "", number(k)).otherwise("?")).otherwise(named)

    return F.transform_values(key, read)


def graded(kind: Column, key: Column, most: Column, answer: Column, question: Column) -> Column:
    """Points of a closed answer, null where it is not clear what was answered or there is no key."""
    n = F.size(key)
    tf = F.regexp_replace(F.regexp_replace(answer, r"(?i)fałsz\p{L}*|false", "F"), r"(?i)prawd\p{L}*|true", "P")
    said = lambda k: _found(F.upper(tf), r"(?m)(?:^|\s)", _quoted(k), r"\s*[.):–-]*\s*[–:-]?\s*\(?([PF])(?:[^\p{L}\p{N}_]|$)")
    truths = F.transform_values(key, lambda k, v: said(k))
    all_said = F.forall(F.map_values(truths), lambda v: v != "")
    pairs = matched(answer, key)
    clear = ~F.exists(F.map_values(pairs), lambda v: v == "?")
    multi = F.transform_values(key, lambda k, v: _found(F.upper(answer), r"(?m)^\s*", _quoted(k), r"\s*[.):–-]*\s*[:–-]?\s*\(?([A-F])(?:[^\p{L}\p{N}_]|$)"))
    letter = F.when(n == 1, F.create_map(F.element_at(F.map_keys(key), 1), chosen(answer, question))).otherwise(multi)
    known = F.forall(F.map_values(letter), lambda v: F.coalesce(v != "", F.lit(False)))
    points = lambda got: score(right_parts(key, got), n, most)
    return F.when(kind == "closed_tf", F.when(all_said, points(truths))).when(kind == "closed_match", F.when(clear, points(pairs))).otherwise(F.when(known, points(letter)))


#: Nouns that do not tell names apart, and names that mean the same.
STOP_NOUNS = ["zakon", "dynastia", "fragment", "krol", "cesarz"]
SYNONYMS = {
    "usa": "stany zjednoczone", "stany zjednoczone ameryki": "stany zjednoczone", "anjou": "andegawenowie", "rzeczpospolita obojga narodow": "polska", "rzeczpospolita": "polska",
}


def plain_name(text: Column, stop: list[str] = STOP_NOUNS, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """A name for comparison: without marks, signs and general nouns, in lower case, a synonym as the name it stands for."""
    x = F.concat(F.lit(" "), F.regexp_replace(fold(text), r"[\[\]()*_.,;:\"„”']", " "), F.lit(" "))
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", "  "), " (?:" + "|".join(stop) + ") ", " ") if stop else x
    x = squeeze(x)
    table = F.create_map(*[F.lit(v) for kv in synonyms.items() for v in kv]) if synonyms else F.create_map(F.lit(""), F.lit(""))
    return F.coalesce(F.try_element_at(table, x), x)


def alike(answer: Column, key: Column, stem: int = 5, least: int = 4) -> Column:
    """Whether an answer means one of the key's wordings: the same plain name, or all stems of the key's longer words in it, where
    both hold the same Roman numerals."""
    a = plain_name(answer)
    numerals = lambda x: F.array_sort(F.array_distinct(F.filter(F.split(x, " "), lambda w: w.rlike("^[ivxl]+$"))))
    long = lambda x: F.transform(F.filter(F.split(x, " "), lambda w: F.length(w) >= least), lambda w: F.substring(w, 1, stem))

    def one(k: Column) -> Column:
        held = (F.size(long(k)) > 0) & F.forall(long(k), lambda t: F.array_contains(long(a), t))
        return (k != "") & ((a == k) | ((numerals(a) == numerals(k)) & held))

    return F.coalesce(F.exists(F.transform(F.split(key, "/"), lambda x: plain_name(x)), one), F.lit(False))


def option_text(letter: Column, question: Column) -> Column:
    """The text of the option with that letter or number in a question; '' if there is none."""
    return F.coalesce(strip(_found(question, r"(?m)^\s*", _quoted(letter), r"[.):]\s*([^\n]+)")), F.lit(""))


def answer_content(kind: Column, question: Column, answer: Column) -> Column:
    """What a closed answer says in words: the texts of the options, of the true statements, of both sides of a matching; the answer
    itself where the question holds no such texts, and for other kinds."""
    rows = lines(normal_closed(kind, answer))
    left, right = lambda x: F.substring_index(x, ":", 1), lambda x: strip(F.substring_index(x, ":", -1))
    joined = lambda xs: F.array_join(F.filter(xs, lambda x: x != ""), " ")
    cases = {
        "closed_choice": option_text(normal_closed(kind, answer), question),
        "closed_tf": joined(F.transform(F.filter(rows, lambda x: F.endswith(x, F.lit("P"))), lambda x: option_text(left(x), question))),
        "closed_multi": joined(F.transform(rows, lambda x: option_text(right(x), question))),
        "closed_match": joined(F.flatten(F.transform(rows, lambda x: F.array(option_text(left(x), question), option_text(right(x), question))))),
    }
    said = of_kind(kind, cases, F.lit(""))
    return F.when(said != "", said).otherwise(F.coalesce(answer, F.lit("")))


def key_of(solution: Column) -> Column:
    """map<part, value> of a solution that is a key: one letter, a row of P and F, or ``part: value`` lines; null for running text."""
    rows = lines(solution)
    rows = F.when((F.size(rows) == 1) & F.contains(solution, F.lit(",")), F.filter(F.transform(F.split(solution, ","), lambda x: strip(x)), lambda x: x != "")).otherwise(rows)
    pair = r"^([0-9]{1,2}|[A-F])\s*[.:)–-]\s*([^\s].*)$"
    compact = F.regexp_replace(F.element_at(rows, 1), r"[\s,]", "")
    letters = F.split(compact, "")
    return let(rows, lambda r: F.when(F.size(r) == 0, None)
               .when((F.size(r) == 1) & F.element_at(r, 1).rlike(r"^[A-F]\.?$"), F.create_map(F.lit("1"), F.substring(F.element_at(r, 1), 1, 1)))
               .when((F.size(r) == 1) & compact.rlike("^[PF]{2,}$"), F.map_from_arrays(F.transform(letters, lambda x, i: (i + 1).cast("string")), letters))
               .when(F.forall(r, lambda x: x.rlike(pair)) & (F.size(F.array_distinct(F.transform(r, lambda x: F.regexp_extract(x, pair, 1)))) == F.size(r)) & (F.size(r) <= 6),
                     F.map_from_arrays(F.transform(r, lambda x: F.regexp_extract(x, pair, 1)), F.transform(r, lambda x: strip(F.regexp_extract(x, pair, 2))))))


def key_kind(key: Column) -> Column:
    """The kind of item a key belongs to."""
    return F.when(F.forall(F.map_values(key), lambda v: v.isin("P", "F")), "closed_tf").when(F.forall(F.map_keys(key), lambda k: k.rlike(r"^\p{L}+$")), "closed_match").otherwise("closed_choice")


def filled(template: Column, answer: Column) -> Column:
    """How many labels of a template (``label:`` lines) stand in the answer in order with at least two signs of content after them."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    labels = F.filter(F.transform(lines(template), lambda x: F.lower(x)), lambda x: F.endswith(x, F.lit(":")))
    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("n"))

    def step(s: Column, label: Column) -> Column:
        found = F.call_function("locate", label, low, s["at"])
        after = found + F.length(label)
        rest = F.call_function("substring", low, after)
        upto = F.aggregate(labels, rest, lambda r, other: F.call_function("substring_index", r, other, F.lit(1)))
        content = F.length(F.regexp_replace(upto, r"[\s:•*–-]", "")) >= 2
        return F.when(found > 0, F.struct(after.alias("at"), (s["n"] + content.cast("int")).alias("n"))).otherwise(s)

    return F.aggregate(labels, start, step)["n"]
