"""Template residue, filler, error messages and script notices in place of content.

Placeholders have one grammar per delimiter. Fenced and inline code is taken out first. In lines that explain templates (they
name the thing they show) placeholders do not count, unless the line holds more fields than words; all other rules see the full
text. Messages count only as whole statements: at the start of a line or sentence and ended by its end, so the same words inside
a sentence of real content do not count. A message is a thing and its failure in either order, mock text is told by the endings
of its words and by repetition, and empty outlines by lines that only name a part of a document.

One scan, no shuffle. The rules' literals, some two hundred, are looked for together by one Aho-Corasick automaton over an Arrow
batch's texts, and a pattern runs on a text only if the text holds one of its literals. Native expressions run every pattern
over every text instead: measured at sf0.1 they took about ten times as long.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# --- fixed values: wordings, in lower case -----------------------------------------------------------------------------------
#: Notes that something is still to be written, as a whole statement or in brackets.
TODO_NOTES = ["do napisania", "do uzupełnienia", "brak treści", "pusty rekord", "to be written", "to be done", "no content"]
#: Markers of unfinished work, in capitals.
TODO_MARKS = ["TODO", "FIXME", "TBD"]
#: Words that open an instruction in brackets.
FILL_IN = ["wstaw", "tu wpisać", "tu wpisz", "wpisz", "uzupełnij", "insert", "enter", "your", "hier einfügen"]
#: What a form asks to do, and with what.
ASK = ["dodaj", "wpisz", "wstaw", "uzupełnij", "add", "enter", "insert", "type"]
ASKED = ["opis", "treść", "tekst", "tytuł", "nazwę", "datę", "description", "text", "title", "content", "name", "date"]
#: Promises of content.
PROMISES = [
    "tu pojawi się", "w tym miejscu znajdzie się", "w tym miejscu pojawi się", "wkrótce dodamy", "redakcja przygotowuje",
    "kliknij, aby dodać", "click to add", "coming soon", "content goes here", "hier entsteht",
]
#: Names of the parts of a document, of which an empty outline consists.
PARTS = [
    "nagłówek", "śródtytuł", "tytuł", "podtytuł", "akapit", "punkt", "podpunkt", "rozdział", "sekcja", "heading", "subheading",
    "title", "paragraph", "point", "section", "überschrift", "absatz", "abschnitt",
]
#: Words of the best known mock text.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim "
    "veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate "
    "velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa officia deserunt mollit "
    "anim est laborum"
).split()
#: Endings of Latin words that are rare in the languages of real content.
LATIN_ENDINGS = ["us", "um", "is", "or", "it", "at", "et", "am", "ix", "ur", "unt", "ae"]
#: Filler phrases, alone or repeated.
FILLER = [
    "tekst przykładowy", "przykładowy tekst", "treść zastępcza", "akapit próbny", "tekst zastępczy", "sample text", "dummy text", "placeholder text",
    "beispieltext", "blindtext",
]
#: What can fail, how it is said to fail, and words that may stand between and around.
THINGS = [
    r"stron[aęy]", r"adres\w*", r"zas[oó]b\w*", r"plik\w*", r"katalog\w*", r"usług[aię]", r"serwer\w*", r"serwis\w*", r"sesj[aię]", r"dostęp\w*", r"uprawnień",
    r"zapyta[nń]\w*", r"żąda[nń]\w*", r"oczekiwani\w+", r"odpowied[zź]\w*", r"baz[aęy] danych", r"model\w*", r"połączeni\w+", r"page", r"service", r"resource",
    r"file", r"session", r"access", r"permission", r"requests?", r"gateway", r"connection", r"server", r"database", r"seite", r"dienst", r"zugriff", r"sitzung", r"datei",
]
FAILS = [
    r"nie ma(?:sz)?", r"nie znaleziono", r"nie istnieje", r"nie odpowiada", r"nie zwróci[łl]\w*", r"niedostępn\w+", r"wygas[łl]\w*", r"odmow[ay]", r"odmówiono", r"brak",
    r"przekroczono", r"zbyt wiele", r"mógł zostać", r"zmieniony", r"usunięty", r"denied", r"forbidden", r"not found", r"unavailable", r"expired", r"timed? ?out", r"failed",
    r"too many", r"nicht verfügbar", r"nicht gefunden", r"verweigert", r"abgelaufen", r"fehlgeschlagen",
]
BETWEEN = [
    r"żądan\w+", r"podan\w+", r"wybran\w+", r"taki\w+", r"takiej", r"tej", r"tego", r"do", r"z", r"na", r"albo", r"lub", r"chwilowo", r"tymczasowo", r"czas(?:u|owo)?", r"limit(?:u)?", r"twojego", r"adresu",
    r"serwera", r"the", r"this", r"requested", r"temporarily", r"is", r"was", r"your", r"die", r"der", r"diese", r"ist", r"zur zeit",
]
#: What is said beside an error.
BESIDE = [
    r"coś poszło nie tak", r"something went wrong", r"etwas ist schiefgelaufen", r"trwają prace serwisowe", r"spróbuj(?:cie)? ponownie(?: \w+){0,3}", r"(?:please )?try again later",
    r"bitte versuchen sie es später(?: erneut)?", r"skontaktuj się z administratorem", r"wróć na stronę główną(?: \w+){0,4}", r"zaloguj się, aby kontynuować",
    r"identyfikator zgłoszenia:\s*[0-9a-f]{6,}", r"traceback(?: \(most recent call last\))?:?[^\n.]{0,60}", r"file \"[^\"\n]+\", line \d+[^\n]{0,40}",
    r"(?:key|value|type|index|runtime|attribute|syntax|name|zerodivision|io|os)error:?[^\n.]{0,60}",
]
#: What scripting, cookies or a browser are asked for with.
SCRIPT = r"(?:java ?script|\bjs\b|skrypt(?:y|ów|u|om)?\b|\bscripting\b|\bscripts\b|pliki cookie|plików cookie|\bcookies?\b|przeglądark[aięąo]\p{L}*|\bbrowser\b)"
NEEDED = (
    r"(?:wymaga|włącz(?:yć|onej|ona|one)?\b|wyłączon|nie uruchomi|nie działa|nie obsługuje|obsług[iaęą]\b|zaktualizuj|zmień|"
    r"(?:does not|doesn.t|won.t|will not) work|enable|switch .{0,30}\bon\b|turn .{0,30}\bon\b|without|required|requires|disabled|"
    r"muss|müssen|aktivier|unterstützt)"
)
HUMAN = r"sprawdzamy, czy jesteś człowiekiem|(?:checking|verify) (?:that |if )?you are (?:a )?human"
#: Words that show that a line explains templates.
EXPLAINS = r"szablon\p{L}*|template\p{L}*|składni\p{L}*|syntax|placeholder\p{L}*|zmienn\p{L}+ w nawias\p{L}*|jinja|mustache|handlebars|vorlagensyntax"


@dataclass
class Rule:
    """A pattern, and literals one of which every text that meets it holds."""

    pattern: str
    literals: tuple[str, ...]


def _or(options: list[str]) -> str:
    return "(?:" + "|".join(options) + ")"


NAME = r"[\p{L}_][\p{L}\p{N}_ .-]{0,40}"
#: A grammar per delimiter of unfilled fields.
PLACEHOLDERS = {
    "double_brace": Rule(r"\{\{[^{}\n]{1,60}\}\}", ("{{",)),
    "dollar_brace": Rule(r"\$\{[^{}\n]{1,60}\}", ("${",)),
    "statement": Rule(r"\{%[^{}%\n]{1,60}%\}", ("{%",)),
    "script_tag": Rule(r"<%[^%\n]{1,60}%>", ("<%",)),
    "double_bracket": Rule(r"\[\[" + NAME + r"\]\]", ("[[",)),
    "double_angle": Rule(r"<<\s*" + NAME + r">>|«[\p{Ll}_]{2,40}»", ("<<", "«")),
    "at_signs": Rule(r"@@" + NAME + r"@@", ("@@",)),
    "hash_name": Rule(r"(?<![#\p{L}\p{N}])#[\p{Lu}_]{3,40}#", ("#",)),
    "percent_name": Rule(r"(?<![%\p{L}\p{N}])%[\p{Lu}_]{3,40}%", ("%",)),
    "printf_name": Rule(r"%\([\p{L}_]{1,40}\)[sdifr]", ("%(",)),
    "brace_name": Rule(r"(?<![{$%\p{L}])\{[\p{Ll}][\p{Ll}\p{N}_]{1,40}\}(?!\})", ("{",)),
    "angle_name": Rule(r"<(?!/?think>)(?:[\p{Ll}]+(?:_[\p{Ll}]+)*|[\p{Lu}]{2,}(?:[_ ][\p{Lu}]+)*)>", ("<",)),
    "bracket_name": Rule(r"\[[\p{Lu}]{3,}(?:[_ ][\p{Lu}]+)*\]", ("[",)),
    "colon_name": Rule(r"(?<![\p{L}\p{N}:]):[\p{Ll}]{2,}(?:_[\p{Ll}]+)*:(?![\p{L}\p{N}:/])", (" :", "\n:", "(:")),
    "crossed_name": Rule(r"\bXXX\b[ \t]*[\p{L}_ ]{2,40}\bXXX\b|(?m)^[ \t]*(?:[\p{L} ]{1,30}:)?[ \t]*XXX[ \t]*$", ("XXX",)),
    "date_mask": Rule(
        r"\b(?:DD|dd)[./-](?:MM|mm)[./-](?:RRRR|YYYY|rrrr|yyyy)\b|\b(?:RRRR|YYYY)\s?[–-]\s?(?:RRRR|YYYY|MM)\b", ("RRRR", "YYYY", "rrrr", "yyyy")
    ),
    "question_marks": Rule(r"(?<!\?)\?{3,}", ("???",)),
    "value_leak": Rule(r"(?<![\p{L}\p{N}])(?:undefined|\[object Object\]|NaN)(?![\p{L}\p{N}])", ("undefined", "[object", "NaN")),
    "fill_in": Rule(r"(?iu)\[\s*" + _or(FILL_IN) + r"\b[^\]\n]{0,60}\]", ("[",)),
    "todo_note": Rule(r"(?iu)\([^()\n]{0,40}\bdo uzupełnienia\)", ("uzupełnienia)", "UZUPEŁNIENIA)")),
    "todo_mark": Rule(r"\b" + _or(TODO_MARKS) + r"\b(?!\p{L})", tuple(TODO_MARKS)),
}
#: The grammars whose delimiters enclose a name: these are weighed against the words of an explaining line.
FIELDS = [
    "double_brace", "dollar_brace", "statement", "script_tag", "double_bracket", "double_angle", "at_signs", "hash_name", "percent_name", "printf_name", "brace_name",
    "angle_name", "bracket_name", "colon_name",
]
#: Element names of markup that a lone angle bracket may hold in real text.
MARKUP = "br|p|b|i|u|em|hr|li|ul|ol|td|tr|th|div|span|table|strong|sub|sup|code|pre|html|body|head|img|a"

#: Where a statement begins; texts in lower case are given a line break in front, so there always is such a sign.
_START = r"[\n.!?…:;|]\s*"
_STOP = r"(?=\s*(?:[.!…?]|\n|$|[–—-]\s)|\s*$)"


def _statement(options: list[str]) -> str:
    return _START + _or(options) + _STOP


_GAP = r"(?: " + _or(BETWEEN) + r"){0,4} "
_THING, _FAIL = r"\b" + _or(THINGS) + r"(?!\p{L})", r"\b" + _or(FAILS) + r"(?!\p{L})"
_AROUND = r"(?:(?: " + _or(BETWEEN + THINGS + FAILS) + r"(?!\p{L})){0,4})(?:\s*\([^()\n]{1,40}\))?"
ERRORS = [
    r"(?:błąd|error|fehler|http|status|kod błędu)\s*:?\s*[1-5]\d\d(?:\s*[:–—-]\s*[^\n.]{0,60})?",
    r"(?:[45]\d\d\s*[–—:-]\s*)?(?:" + _or(BETWEEN) + " ){0,2}" + _or([_THING + _GAP + _FAIL, _FAIL + _GAP + _THING]) + _AROUND,
    r"[45]\d\d\s*[–—:-]\s*" + _or(FAILS) + _AROUND,
    *BESIDE,
]
_LATIN_WORD = r"[a-z]{4,}+(?<=" + "|".join(LATIN_ENDINGS) + r")(?![\p{L}\p{N}])"
_NEAR = r"[^\n.!?]{0,60}"
#: What a failure is told by: FAILS and BESIDE hold one of these.
ERROR_LITERALS = (
    "nie ma", "znaleziono", "nie istnieje", "nie odpowiada", "nie zwróci", "niedostępn", "wygas", "odmow", "odmówi", "brak", "przekroczono", "zbyt wiele", "mógł zostać", "zmieniony",
    "usunięty", "denied", "forbidden", "not found", "unavailable", "expired", "time out", "timeout", "timed out", "timedout", "failed", "too many", "nicht verfügbar", "nicht gefunden", "verweigert",
    "abgelaufen", "fehlgeschlagen", "poszło nie tak", "went wrong", "schiefgelaufen", "prace serwisowe", "spróbuj", "try again", "später", "z administratorem", "stronę główną", "zaloguj",
    "zgłoszenia:", "traceback", "file \"", "error", "błąd", "fehler", "http", "status", "kod błędu",
)
#: A sentence that asks for scripts, cookies or another browser.
NOTICE = r"\b(?:switch|turn) (?:java ?script|scripting|scripts|cookies) on\b|" + SCRIPT + _NEAR + NEEDED + "|" + NEEDED + _NEAR + SCRIPT
_PART = r"(?:" + "|".join(PARTS) + r") \d{1,3}[.:]?"
#: Rules on the text in lower case, with a line break in front of it.
SAID = {
    "lorem": Rule(r"\b(?:" + _or(LOREM) + r"\b[\s,.;:]*){6,}", ("lorem", "ipsum", "dolor", "consectetur")),
    "filler": Rule(_statement(FILLER) + r"|\b(" + "|".join(FILLER) + r")\b(?:[\s,.;]+\1\b)+", tuple(FILLER)),
    "symbols": Rule(
        r"(?:^|\s)(?:x{8,}|[*]{8,}|-{8,}|[.]{12,}|#{8,})\s+\p{Ll}{2,}|(?<!\p{L})x{8,}(?!\p{L})", ("x" * 8, "*" * 8, "-" * 8, "." * 12, "#" * 8)
    ),
    "keyboard": Rule(r"\b(?:qwerty|asdf(?:gh)?)\b", ("qwerty", "asdf")),
    "outline": Rule(r"(?m)^" + _PART + r"\n(?:[^\n]{0,30}\n" + _PART + r"$|\p{L}{1,20} ?(?:…|\.\.\.)$)", tuple(f"\n{p} " for p in PARTS)),
    "todo_statement": Rule(_START + r"(?:[*x#-]{8,}\s*)?" + _or(TODO_NOTES) + _STOP, tuple(TODO_NOTES)),
    "promise": Rule(_START + _or(PROMISES) + r"(?![\p{L}\p{N}])", tuple(PROMISES)),
    "form_prompt": Rule(_statement([_or(ASK) + " " + _or(ASKED)]), tuple(f"{a} {b}" for a in ASK for b in ASKED)),
    "error": Rule(_statement(ERRORS), ERROR_LITERALS),
    "script_notice": Rule(
        NOTICE,
        ("javascript", "java script", " js", "cookie", "przeglądark", "browser", "obsługi skryptów", "wyłączone skrypty", "scripting", "switch scripts", "turn scripts", "włącz skrypty"),
    ),
    "human_check": Rule(HUMAN, ("jesteś człowiekiem", "you are")),
}
#: Four words with Latin endings and at most one other word between two of them.
MOCK_LATIN = r"[\s,.;(]" + _LATIN_WORD + r"(?:[ ,]++(?:[a-z]++[ ,]++)??" + _LATIN_WORD + r"){3,}"
#: A word or pair of words three times in a row.
REPEATED = r"(?<![\p{L}\p{N}])([\p{L}\p{N}]{3,}+(?: [\p{L}\p{N}]{3,}+)?)(?:[ ,;.]+\1(?![\p{L}\p{N}])){2,}"
#: Literals of lines that explain templates.
EXPLAIN_LITERALS = ("szablon", "template", "składni", "syntax", "placeholder", "zmienn", "jinja", "mustache", "handlebars")


@functools.lru_cache(maxsize=1)
def _automaton():
    """All literals of the lower-case rules, each with the names of its rules."""
    import ahocorasick

    names: dict[str, set] = {}
    for rule, literals in [*((k, r.literals) for k, r in SAID.items()), ("explains", EXPLAIN_LITERALS)]:
        for x in literals:
            names.setdefault(x, set()).add(rule)
    for ending in LATIN_ENDINGS:
        for sign in " ,.":
            names.setdefault(ending + sign, set()).add("mock_latin")
    out = ahocorasick.Automaton()
    for x, rules in names.items():
        out.add_word(x, frozenset(rules))
    out.make_automaton()
    return out


@functools.lru_cache(maxsize=None)
def _compiled(pattern: str):
    return regex.compile(pattern)


def _has(pattern: str, text: str) -> bool:
    return _compiled(pattern).search(text) is not None


def content(text: str) -> str:
    """The text without closed fences and inline code."""
    return regex.sub(r"`[^`\n]{1,200}`", " ", regex.sub(r"(?s)```.*?```", "\n", text)) if "`" in text else text


def _dense(line: str) -> bool:
    """Whether a line holds more fields than words, whatever the delimiters."""
    any_field = _compiled("|".join(f"(?:{PLACEHOLDERS[k].pattern})" for k in FIELDS))
    return len(any_field.findall(line)) > len(regex.findall(r"[\p{L}\p{N}]+", any_field.sub(" ", line)))


def kinds(text: str | None) -> list[str]:
    """The names of the rules a text meets; none for null and empty texts."""
    if not text:
        return []
    said = content(text)
    low = "\n" + said.lower()
    held: set[str] = set()
    endings = 0
    for _, rules in _automaton().iter(low):
        if "mock_latin" in rules:
            endings += 1
        held |= rules
    plain = said
    if "explains" in held:
        explains = r"(?i)\b(?:" + EXPLAINS + r")\b"
        plain = "\n".join(x for x in said.split("\n") if not _has(explains, x) or _dense(x))
    if "<" in plain:
        plain = _compiled(r"</?(?:" + MARKUP + r")\s*/?>").sub(" ", plain)
    out = [k for k, r in PLACEHOLDERS.items() if any(x in plain for x in r.literals) and _has(r.pattern, plain)]
    out += [k for k, r in SAID.items() if k in held and _has(r.pattern, low)]
    if endings > 3 and _has(MOCK_LATIN, low):
        out.append("mock_latin")
    ws = low.replace(",", " ").replace(";", " ").replace(".", " ").split()
    if (any(map(eq, ws, ws[1:])) or any(map(eq, ws, ws[2:]))) and _has(REPEATED, low):
        out.append("repeated")
    return out


def residue(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, kinds): every row whose text holds residue, with the names of the rules it meets. Copies count as rows of their
    own; rows with a null or empty text never count; a null id is kept. Other columns, whatever their names, are ignored."""
    slim = docs.select(id_column, text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [kinds(x) for x in b.column(1).to_pylist()]
            at = [i for i, k in enumerate(got) if k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([got[i] for i in at], pa.list_(pa.string()))], [id_column, "kinds"])

    return slim.mapInArrow(find, StructType([slim.schema[0], StructField("kinds", ArrayType(StringType()))]))


def without_residue(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that meet no rule, all columns as they are; rows with a null or empty text stay."""
    at = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([not kinds(x) for x in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
