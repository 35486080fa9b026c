"""Text expressions: everything here returns a Column and stays inside the JVM.

Word characters are always ``[\\p{L}\\p{N}_]``: bare ``\\w`` is ASCII in Java. A null text gives null, an empty one an empty result,
unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Letters with marks and what they fold to.
MARKED = "ąćęłńóśźżáàâäãåéèêëíìîïöôòõúùûüçñýÿĄĆĘŁŃÓŚŹŻÁÀÂÄÃÅÉÈÊËÍÌÎÏÖÔÒÕÚÙÛÜÇÑÝ"
FOLDED = "acelnoszzaaaaaaeeeeiiiioooouuuucnyyACELNOSZZAAAAAAEEEEIIIIOOOOUUUUCNY"


def words(text: Column, pattern: str = WORD, lower: bool = True) -> Column:
    """All words in order, repeated ones too."""
    return F.regexp_extract_all(F.lower(text) if lower else text, F.lit(f"({pattern})"), 1)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value bound to a lambda variable, so it is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def word_ngrams(text: Column, n: int = 4) -> Column:
    """The set of runs of n words; a text of fewer words is one run of all of them; no words, no runs."""

    def runs(w: Column) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), "\u0001"))
        return F.when(w.isNull(), None).when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(long))

    return let(words(text), runs)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; 0 where either is empty or null."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when((F.size(F.coalesce(a, F.array())) == 0) | (F.size(F.coalesce(b, F.array())) == 0), F.lit(0.0)).otherwise(both / every)


def count_words(text: Column) -> Column:
    return F.size(words(text, lower=False)).cast("bigint")


def count_tokens(text: Column) -> Column:
    """Runs between white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([^\s]+)"), 1)).cast("bigint")


def count_letter_words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), 1)).cast("bigint")


def count_markdown_words(text: Column) -> Column:
    """White-space tokens after markup signs and list bullets are taken out."""
    bare = F.regexp_replace(text, r"[#*_`>]", "")
    return count_tokens(F.regexp_replace(bare, r"(?m)^\s*[-+]\s+", ""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def norm_text(text: Column) -> Column:
    """Lower case, one kind of dash, without image markers, only letters, digits and dashes, single blanks."""
    x = F.regexp_replace(F.lower(text), r"[–—−]", "-")
    x = F.regexp_replace(x, r"\[obraz:[^\]]*\]", " ")
    return squeeze(F.regexp_replace(x, r"[^0-9a-ząćęłńóśźż -]", " "))


def norm_prefix(text: Column, length: int = 120, keep_underscore: bool = True) -> Column:
    """Beginning of the text as a comparison key: lower case, other signs to blanks, first ``length`` characters."""
    drop = r"[^\p{L}\p{N}_]+" if keep_underscore else r"[^\p{L}\p{N}]+"
    return F.trim(F.substring(F.trim(F.regexp_replace(F.lower(text), drop, " ")), 1, length))


def fold(text: Column) -> Column:
    """Letters without marks, lower case."""
    return F.lower(F.translate(text, MARKED, FOLDED))


def strip_think(text: Column) -> Column:
    """Without <think> blocks; a lone closing tag drops what stands before it."""
    x = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return F.trim(F.substring_index(x, "</think>", -1))


def clean_answer(text: Column) -> Column:
    """An answer without <think> blocks and bold signs; of a text with a lone closing tag what stands behind the last one, or before
    it if nothing does."""
    x = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)<think>.*?</think>", "")
    tail, head = F.substring_index(x, "</think>", -1), F.regexp_replace(x, r"(?s)</think>[^<]*$", "")
    kept = F.when(F.contains(x, F.lit("</think>")) & (F.trim(F.regexp_replace(tail, r"\s+", " ")) == ""), head).otherwise(tail)
    return F.regexp_replace(F.regexp_replace(kept, r"\*\*([^\n]+?)\*\*", "$1"), r"^\s+|\s+$", "")


def norm_name(text: Column) -> Column:
    """:func:`norm_text` for names: nothing is taken out but signs."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(text), r"[–—−]", "-"), r"[^0-9a-ząćęłńóśźż -]", " "))


#: Cities that stand before the year of a printed source, and words that open a citation.
PRINT_CITIES = [
    "Warszawa", "Kraków", "Wrocław", "Poznań", "Lublin", "Łódź", "Gdańsk", "Katowice", "Toruń", "Olsztyn", "Białystok", "Rzeszów", "Kielce", "Opole", "Londyn", "Paryż", "Berlin",
    "Wiedeń", "Oxford", "London", "Paris", "New York", "Bydgoszcz", "Częstochowa",
]
CITED_BY = ["Za", "Na podstawie", "Źródło"]


def strip_citations(text: Column, cities: list[str] = PRINT_CITIES, openers: list[str] = CITED_BY) -> Column:
    """Blanks in place of citations: from an opener and colon to the line's end, a city with the year of print, page and volume
    numbers, links, dates of access."""
    parts = [
        r"(?:" + "|".join(openers) + r")\s*:[^\n]{0,250}", r"(?:" + "|".join(cities) + r")[\s,]*(?:[0-9]{4}(?:[–-][0-9]{2,4})?)?", r"s\.\s*[0-9]+(?:[–-][0-9]+)?", r"t\.\s*[IVX0-9]+",
        r"https?://[^\s]+", r"dostęp[^\n]{0,40}",
    ]
    return F.regexp_replace(text, "|".join(parts), " ")


def scope_of(text: Column, local: list[str], name: str, other: str, cities: list[str] = PRINT_CITIES) -> Column:
    """``name`` if one of the words of ``local`` stands in the text outside citations, whatever the case, else ``other``."""
    return F.when(strip_citations(text, cities).rlike("(?i)" + "|".join(local)), name).otherwise(other)


def tidy(text: Column, short: int = 60) -> Column:
    """A wrapped text on one line: broken words joined, single blanks; brackets are dropped from short texts and round in long ones."""
    x = squeeze(F.regexp_replace(text, r"-\s+([a-ząćęłńóśźż])", "$1"))
    return F.when(F.length(x) < short, F.translate(x, "[]", "")).otherwise(F.translate(x, "[]", "()"))


def dedup_sentences(text: Column) -> Column:
    """Sentences whose letters and digits repeat an earlier one's are dropped; the first stays as it is."""
    key = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " "))
    pieces = F.filter(F.split(F.regexp_replace(text, r"([.!?…])\s+", "$1\n"), "\n"), lambda x: F.trim(x) != "")

    def keep(xs: Column) -> Column:
        keys = F.transform(xs, key)
        return F.filter(xs, lambda x, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)

    return F.array_join(let(pieces, keep), " ")


def strip_emphasis(text: Column) -> Column:
    return F.regexp_replace(text, r"[*_`#]", "")


def mask_secrets(text: Column, keep: int = 400) -> Column:
    """Keys and tokens replaced by a mark, then the first ``keep`` characters."""
    x = F.regexp_replace(text, r"(?:sk|fh|pk)[-_][A-Za-z0-9_-]{8,}", "[secret]")
    return F.substring(x, 1, keep)


def strip_links(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"https?://[^\s]+", " "), r"\[[0-9]{1,3}\]", " "))


#: Entities that are put back.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_clean(text: Column, keep: int = 2000) -> Column:
    x = F.regexp_replace(F.regexp_replace(text, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]+>", " ")
    for entity, sign in ENTITIES.items():
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.substring(squeeze(x), 1, keep)


def dehyphenate(text: Column) -> Column:
    """Words broken at a line end joined, single line breaks turned to blanks, blank lines kept."""
    x = F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
    return F.regexp_replace(x, r"([^\n])\n([^\n])", "$1 $2")


def drop_lines(text: Column, patterns: list[str]) -> Column:
    """Without the lines that match any of the patterns."""
    bad = "|".join(f"(?:{p})" for p in patterns)
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(bad)), "\n")


def dedup_lines(text: Column) -> Column:
    """Lines whose letters and digits repeat an earlier line's are dropped; the first stays as it is."""
    key = lambda line: F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}_]+", " "))

    def keep(lines: Column) -> Column:
        keys = F.transform(lines, key)
        return F.filter(lines, lambda line, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)

    return F.array_join(let(F.split(text, "\n"), keep), "\n")


def split_at_verb(text: Column, verbs: list[str]) -> tuple[Column, Column]:
    """(lines before the first line that begins with one of the verbs, that line and all after it). Without one: ('', text)."""
    lines = F.split(text, "\n")
    begins = F.array_position(F.transform(lines, lambda x: F.trim(x).rlike("^(?:" + "|".join(verbs) + r")(?![\p{L}])")), True).cast("int")
    before = F.when(begins > 1, F.array_join(F.slice(lines, F.lit(1), begins - 1), "\n")).otherwise("")
    after = F.when(begins > 0, F.array_join(F.slice(lines, F.greatest(begins, F.lit(1)), F.size(lines)), "\n")).otherwise(text)
    return before, after


def trim_sentences(text: Column, most: int) -> Column:
    """The first ``most`` white-space tokens, cut back to the last full sentence in them if there is one."""
    head = F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, most), " ")
    full = F.regexp_extract(head, r"(?s)^(.*[.!?…])(?:\s|$)", 1)
    return F.when(F.length(full) > 0, full).otherwise(head)


def keeps_most(old: Column, new: Column, share: float = 0.5, longer: int = 60) -> Column:
    """Whether an edit is small: enough of the old words stay, and the length is within half and ``longer`` characters more."""
    kept = F.size(F.array_intersect(F.array_distinct(words(old)), words(new)))
    every = F.size(F.array_distinct(words(old)))
    return (kept >= every * share) & (F.length(new) >= F.length(old) * 0.5) & (F.length(new) <= F.length(old) + longer)


def apply_fixes(text: Column, fixes: Column) -> Column:
    """Literal replacements in order; ``fixes`` is an array of structs (old, new)."""
    return F.aggregate(fixes, text, lambda t, f: F.replace(t, f.getField("old"), f.getField("new")))


def drop_alternatives(text: Column) -> Column:
    """Of words with slashes between them the first stays, however many there are; digits around a slash become a range."""
    x = F.regexp_replace(text, r"(\d)\s*/\s*(\d)", "$1–$2")
    return F.regexp_replace(x, r"([\p{L}\p{N}]+)(?: / [\p{L}\p{N}]+)+", "$1")


def leak_flags(text: Column) -> dict[str, Column]:
    """Signs of broken output: mojibake, special tokens, markup, English prose of some length."""
    english = F.size(F.regexp_extract_all(F.lower(text), F.lit(r"(?<![\p{L}])(the|and|of|with|was|were|that)(?![\p{L}])"), 1))
    return {
        "mojibake": text.rlike("Ã.|Å.|â€"),
        "special_token": text.rlike(r"<\|[^|>]{1,40}\|>|</?s>|\[/?INST\]"),
        "markup": text.rlike(r"(?m)^#{1,4} |\*\*[^*\n]+\*\*"),
        "english": (english >= 5) & (F.length(text) >= 200),
    }


def script_class(text: Column) -> Column:
    """Script of a string's letters: the first of the classes it holds, else 'other'."""
    return (
        F.when(text.rlike(r"[一-鿿぀-ヿ가-힯]"), "cjk").when(text.rlike(r"[Ѐ-ӿ]"), "cyrillic")
        .when(text.rlike(r"[؀-ۿ]"), "arabic").when(text.rlike(r"[Ͱ-Ͽ]"), "greek")
        .when(text.rlike(r"[ąćęłńśźżĄĆĘŁŃŚŹŻ]"), "polish").when(text.rlike(r"[A-Za-zÀ-ɏ]"), "latin")
        .when(text.rlike(r"[0-9]"), "digits").otherwise("other")
    )


def divergence(a: Column, b: Column) -> Column:
    """How many characters two strings have in common from the start."""
    least = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(least, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0)).cast("bigint")


# --- stems and query terms: each its own definition ---------------------------------------------------------------------------
def distinct_terms(text: Column, stop: list[str], stem: int = 6, least: int = 3) -> Column:
    """Order-preserving distinct stems of the words of at least ``least`` characters that are no stop words, links dropped."""
    kept = F.filter(words(F.regexp_replace(text, r"https?://[^\s]+", " ")), lambda w: (F.length(w) >= least) & ~F.array_contains(F.array(*map(F.lit, stop)), w))
    return F.array_distinct(F.transform(kept, lambda w: F.substring(w, 1, stem)))


def stems(text: Column, size: int = 6) -> Column:
    return F.transform(words(text), lambda w: F.substring(w, 1, size))


def long_words(text: Column, least: int = 4) -> Column:
    return F.array_distinct(words(text, r"[\p{L}\p{N}_]{" + str(least) + ",}"))


def content_stems(text: Column, stop: list[str], least: int = 5, size: int = 6) -> Column:
    """Stems of the letters-only words of ``least`` letters or more, repeated ones too."""
    kept = F.filter(words(text, r"\p{L}+"), lambda w: (F.length(w) >= least) & ~F.array_contains(F.array(*map(F.lit, stop)), w))
    return F.transform(kept, lambda w: F.substring(w, 1, size))


def proper_stems(text: Column, size: int = 6, general: list[str] | None = None) -> Column:
    """Stems of capitalised words that do not begin a sentence and are no ``general`` words (in lower case)."""
    found = F.regexp_extract_all(text, F.lit(r"(?<=[\p{Ll}\p{N},;] )(\p{Lu}\p{Ll}{2,})"), 1)
    if general:
        found = F.filter(found, lambda w: ~F.lower(w).isin(general))
    return F.array_distinct(F.transform(found, lambda w: F.lower(F.substring(w, 1, size))))


def cited_terms(text: Column, stop: list[str], cities: list[str] = PRINT_CITIES, openers: list[str] = CITED_BY, stem: int = 6, least: int = 3) -> Column:
    """:func:`distinct_terms` of the lines that are no citations: lines that begin with an opener and colon, or hold a city before a
    year, are dropped whole."""
    bad = r"^\s*(?:" + "|".join(openers) + r")\s*:|(?:" + "|".join(cities) + r")[\s,]+[0-9]{4}"
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(bad)), "\n")
    return distinct_terms(kept, stop, stem, least)


def key_terms(text: Column, stop: list[str], n: int = 3, least: int = 4, size: int = 5) -> Column:
    """Stems of the first ``n`` words of at least ``least`` characters that are no stop words."""
    kept = F.filter(words(text), lambda w: (F.length(w) >= least) & ~F.array_contains(F.array(*map(F.lit, stop)), w))
    return F.slice(F.transform(kept, lambda w: F.substring(w, 1, size)), 1, n)


def entity_query(text: Column) -> Column:
    """A query from a question: its runs of capitalised words, its years, then the question itself."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*)"), 1)
    years = F.regexp_extract_all(text, F.lit(r"(?:^|[^0-9])([0-9]{3,4})(?:[^0-9]|$)"), 1)
    return squeeze(F.concat_ws(" ", F.array_distinct(runs), F.array_distinct(years), text))


# --- dates and keys -----------------------------------------------------------------------------------------------------------
#: Roman numerals of centuries, and what stands behind a number that is no year.
CENTURIES = "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI".split()
NO_YEAR = ["zł", "km", "osób", "tys", "mln", "%"]


def years_in(text: Column, units: list[str] = NO_YEAR, first: int = 1000, last: int = 2025) -> Column:
    """Years in a text: numbers from ``first`` to ``last`` without one of the units behind them, then-numbers of any size before our
    era as negative years, then centuries in Roman numerals by their middle."""
    number = r"(?<![\p{L}\p{N}_])([0-9]{1,4})(?![0-9\p{L}_])\s*+(?:r\.|roku|rok)?+\s*+(p\.\s?n\.\s?e\.)?+(?!\s*+(?:" + "|".join(units) + "))"
    numbers, eras = F.regexp_extract_all(text, F.lit(number), 1), F.regexp_extract_all(text, F.lit(number), 2)
    both = F.transform(numbers, lambda x, i: F.when(F.get(eras, i) != "", -x.cast("int")).when(x.cast("int").between(first, last), x.cast("int")))
    romans = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])([IVX]{1,5})\s*(?:[–-])?\s*(?:[IVX]{1,5}\s*)?w(?:iek\p{L}*|\.)"), 1)
    table = F.create_map(*[F.lit(v) for i, c in enumerate(CENTURIES) for v in (c, i * 100 + 50)])
    return F.array_compact(F.concat(both, F.transform(romans, lambda r: F.try_element_at(table, r))))


def median_year(text: Column, keywords: list[tuple[str, int]] = (), **kinds) -> Column:
    """The median of the years in a text without its citations; if there are none, that of the years of the keyword patterns that it
    meets; null if it meets none."""
    hits = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(y)) for p, y in keywords])) if keywords else F.array().cast("array<int>")

    def middle(xs: Column) -> Column:
        return let(F.sort_array(xs), lambda s: F.when(F.size(s) > 0, (F.element_at(s, F.floor((F.size(s) + 1) / 2).cast("int")) + F.element_at(s, F.floor(F.size(s) / 2 + 1).cast("int"))) / 2))

    return F.coalesce(middle(years_in(strip_citations(text), **kinds)), middle(hits))


def stable_number(text: Column, below: int = 100_000_000) -> Column:
    """A number below ``below`` that depends on the text alone."""
    return F.pmod(F.xxhash64(text), F.lit(below))


def nearest_above(text: Column, marker: str, back: int = 6, least: int = 3) -> Column:
    """The nearest non-blank line of at least ``least`` characters among the ``back`` lines above the first line that holds the marker;
    '' if there is none."""

    def pick(rows: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(rows, lambda x: F.contains(x, F.lit(marker))), True), F.lit(0)).cast("int")
        above = F.slice(rows, F.greatest(at - back, F.lit(1)), F.greatest(F.least(at - 1, F.lit(back)), F.lit(0)))
        long = F.filter(F.transform(above, lambda x: F.trim(x)), lambda x: F.length(x) >= least)
        return F.coalesce(F.try_element_at(long, F.lit(-1)), F.lit(""))

    return let(F.split(text, "\n"), pick)


def before_last_paragraph(text: Column, paragraph: Column) -> Column:
    """The text with a paragraph put in before its last one; of a text of one paragraph, behind it."""

    def put(ps: Column) -> Column:
        n = F.size(ps)
        return F.array_join(F.when(n > 1, F.concat(F.slice(ps, F.lit(1), n - 1), F.array(paragraph), F.slice(ps, n, F.lit(1)))).otherwise(F.concat(ps, F.array(paragraph))), "\n\n")

    return let(F.split(text, r"\n\s*\n"), put)


def has_date(text: Column) -> Column:
    return text.rlike(r"(?<![0-9])[0-9]{3,4} r\.|[IVX]+ w(?:ieku|\.)|p\.n\.e\.")


def md5_bucket(key: Column, modulus: int = 100, salt: str = "") -> Column:
    """The md5 of ``salt:key`` as a number modulo ``modulus``, folded over eight chunks of four hex digits' pairs."""
    h = F.md5(F.concat(F.lit(f"{salt}:"), key.cast("string")))
    step = (16**4) % modulus
    chunks = F.sequence(F.lit(0), F.lit(7))
    return F.aggregate(chunks, F.lit(0).cast("bigint"), lambda acc, i: F.pmod(acc * step + F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"), F.lit(modulus)))


def exam_number(name: Column, of: int = 25) -> Column:
    """The number a name ends in, else its CRC-32 modulo ``of`` plus 1."""
    tail = F.regexp_extract(name, r"([0-9]+)$", 1)
    return F.when(F.length(tail) > 0, F.try_to_number(tail, F.lit("999999999")).cast("bigint")).otherwise(F.crc32(name) % of + 1)


def roman_head(section: Column) -> Column:
    """What stands before the first full stop."""
    return F.split_part(section, F.lit("."), F.lit(1))
