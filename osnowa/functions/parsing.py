"""Answers read from text: maps of parts, partial credit. All as expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def closed_parts(text: Column) -> Column:
    """map<part, value> of lines like ``1: A`` or ``B. 3``; the first line of a part wins; none gives an empty map."""
    line = r"(?m)^\s*([0-9A-Za-z]{1,2})\s*[.:)]\s*([A-Za-z0-9])\s*$"
    keys, values = F.regexp_extract_all(text, F.lit(line), 1), F.regexp_extract_all(text, F.lit(line), 2)
    upper = F.transform(keys, lambda k: F.upper(k))
    first = F.filter(F.sequence(F.lit(1), F.greatest(F.size(upper), F.lit(1))), lambda i: F.array_position(upper, F.get(upper, i - 1)) == i)
    return F.map_from_arrays(F.transform(first, lambda i: F.get(upper, i - 1)), F.transform(first, lambda i: F.upper(F.get(values, i - 1))))


def choice(text: Column, last: bool = False) -> Column:
    """The first (or last) single letter A-F that stands alone, else null."""
    found = F.regexp_extract_all(F.upper(text), F.lit(r"(?<![\p{L}\p{N}])([A-F])(?![\p{L}\p{N}])"), 1)
    return F.try_element_at(found, F.lit(-1 if last else 1))


def true_false(text: Column, n: int) -> Column:
    """Array of n letters P or F: numbered lines if they give n, else the last n letters that stand alone; null if too few."""
    numbered = F.regexp_extract_all(F.upper(text), F.lit(r"(?m)^\s*[0-9]+\s*[.:)]\s*([PF])\s*$"), 1)
    alone = F.regexp_extract_all(F.upper(text), F.lit(r"(?<![\p{L}\p{N}])([PF])(?![\p{L}\p{N}])"), 1)
    return F.when(F.size(numbered) == n, numbered).when(F.size(alone) >= n, F.slice(alone, -n, n))


def right_parts(key: Column, answer: Column) -> Column:
    """How many parts of the key map the answer map has with the same value."""
    return F.size(F.filter(F.map_keys(key), lambda k: F.try_element_at(answer, k) == F.element_at(key, k)))


def score(right: Column, of: Column, most: Column) -> Column:
    """Points for ``right`` of ``of`` parts: all or nothing for one point, 3 parts for two points give 2, 1, 0, 0; as many points
    as parts give one each; else the whole part of the share."""
    return (
        F.when(most == 1, (right == of).cast("int"))
        .when((of == 3) & (most == 2), F.when(right == 3, 2).when(right == 2, 1).otherwise(0))
        .when(most == of, right).otherwise(F.floor(most * right / of).cast("int"))
    )


def first_alternative(text: Column) -> Column:
    return F.trim(F.substring_index(text, "/", 1))


def wanted_count(text: Column) -> Column:
    """The number a question asks for, written as a word or digit; 1 if none is."""
    words = {"dwa": 2, "dwie": 2, "dwóch": 2, "trzy": 3, "trzech": 3, "cztery": 4, "czterech": 4}
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    said = F.regexp_extract(F.lower(text), r"(?<![\p{L}])(dwa|dwie|dwóch|trzy|trzech|cztery|czterech)(?![\p{L}])", 1)
    return F.coalesce(F.try_element_at(table, said), F.lit(1))


def loose_json(text: Column) -> Column:
    """The first {...} of a text without reasoning and code fences, as JSON text; null if it does not parse."""
    from .text import strip_think

    bare = F.regexp_replace(strip_think(text), r"```[a-z]*", "")
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(found).isNotNull() & (F.length(found) > 0), found)


def first_reason(rules: dict[str, Column], fine: str = "keep") -> Column:
    """The name of the first rule that holds; null conditions do not hold."""
    out = None
    for name, c in rules.items():
        hit = F.coalesce(c, F.lit(False))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(fine) if out is None else out.otherwise(fine)


def clamp(x: Column, low: int, high: int) -> Column:
    """A number within bounds; what is no number gives the lower bound."""
    return F.least(F.greatest(F.coalesce(F.expr("null") if x is None else x.try_cast("int"), F.lit(low)), F.lit(low)), F.lit(high))


def string_leaves(json_text: Column) -> Column:
    """All string values in a JSON text, in order of appearance, names left out, escapes resolved; null for what is no JSON."""

    def leaves(x) -> list:
        if isinstance(x, str):
            return [x]
        return [y for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()) for y in leaves(v)]

    def parse(x):
        try:
            return leaves(json.loads(x))
        except (TypeError, ValueError):
            return None

    def of_batch(texts: pd.Series) -> pd.Series:
        return texts.map(parse)

    return F.pandas_udf(of_batch, "array<string>")(json_text)


def listed(text: Column, most: int = 5) -> Column:
    """A list from a JSON list or from the lines of a text, without bullets and blanks, ``most`` at most; null gives none."""
    as_json = F.from_json(text, "array<string>")
    by_line = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\s•*-]+|\s+$", ""))
    return F.slice(F.filter(F.coalesce(F.when(F.ltrim(text).startswith("["), as_json), by_line), lambda x: F.coalesce(F.trim(x), F.lit("")) != ""), 1, most)


def labelled_sections(text: Column, labels: list[str], example: str = "Przykład") -> Column:
    """array<struct<label, body>> of a solution: a line that begins with one of the labels and a colon opens a section, as does a line that
    begins with the word for 'example', under the section's label or none. Of the wordings a section gives, one per bullet or
    example, only the first is kept, its lines joined. Text before the first label has the label ''. Null gives no sections."""
    opens = re.compile(r"^(" + "|".join(labels) + r")\s*[:–-]\s*(.*)$", re.I)
    shows = re.compile(r"^" + example + r"\w*\s+\w+\s*:?\s*(.*)$", re.I)

    def sections(body: str | None) -> list[tuple[str, str]]:
        out: list[list] = []  # label, wordings
        for line in filter(None, map(str.strip, (body or "").splitlines())):
            named, shown = opens.match(line), shows.match(line)
            if named:
                out.append([named.group(1), [[]]])
                line = named.group(2)
            elif shown:
                if not out or any(out[-1][1][-1]):
                    out.append([out[-1][0] if out else "", [[]]])
                line = shown.group(1)
            elif not out:
                out.append(["", [[]]])
            if line[:1] in "•–" and line[:1]:
                if any(out[-1][1][-1]):
                    out[-1][1].append([])
                line = line[1:].strip()
            if line:
                out[-1][1][-1].append(line)
        kept: dict[str, str] = {}
        for label, wordings in out:
            first = next((w for w in wordings if w), None)
            if first:
                kept.setdefault(label, " ".join(first))
        return list(kept.items())

    def of_batch(texts: pd.Series) -> pd.DataFrame:
        return texts.map(lambda x: [{"label": a, "body": b} for a, b in sections(x)])

    of_batch.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of_batch, "array<struct<label string, body string>>")(text)


def error_kind(lost: Column, automatic: Column, answer: Column, reason: Column, rules: list[tuple[str, str, str | None]], other: str) -> Column:
    """Why points were lost: null if none were, 'no answer' for a blank one, 'form' where a machine graded and the answer was lenient to
    the key, else the first rule (name, pattern, pattern that must not occur) the judge's reason meets, else ``other``."""
    out = F.when(F.coalesce(lost, F.lit(0.0)) <= 0, None).when(F.coalesce(F.trim(answer), F.lit("")) == "", "no answer").when(automatic, "form")
    for name, pattern, without in rules:
        hit = reason.rlike("(?i)" + pattern)
        out = out.when(hit if without is None else hit & ~reason.rlike("(?i)" + without), name)
    return out.otherwise(other)
