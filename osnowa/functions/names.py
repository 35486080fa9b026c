"""Names of categories in any spelling, and which of the known ones they mean."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Polish letters and the letters they are compared as.
FOLD_FROM, FOLD_TO = "ąćęłńóśźż", "acelnoszz"
#: A Roman numeral that stands for the whole name: alone, or before the first full stop.
NUMERAL = r"^\s*([IVXLCDMivxlcdm]+)\s*(?:\.|$)"
#: A name cut short shows it by its end, or agrees with a category in this many characters.
CUT, START = r"(?:…|\.\.\.)\s*$", 24


def category_key(value: Column) -> Column:
    """A category without regard to case, diacritics, punctuation and spacing; null and blank give null."""
    key = F.trim(F.regexp_replace(F.translate(F.lower(value), FOLD_FROM, FOLD_TO), r"[^\p{L}\p{N}]+", " "))
    return F.when(F.length(key) > 0, key)


def key_of(name: str) -> str:
    """:func:`category_key` of a category's own name."""
    return re.sub(r"[\W_]+", " ", name.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))).strip()


def canonical(value: Column, categories: list[str]) -> Column:
    """The category a written value means, null if none or several: the same name whatever its case, diacritics and
    punctuation; else the only one with its leading Roman numeral; else, of a name cut short or of at least START characters,
    the only one that begins alike. Null and blank values mean none; of two categories with one key the first counts.
    """
    keys: dict[str, str] = {}
    heads: dict[str, set] = defaultdict(set)
    for c in categories:
        key = key_of(c)
        if key:
            keys.setdefault(key, c)
            if re.match(NUMERAL, c):
                heads[re.match(NUMERAL, c).group(1).upper()].add(c)
    if not keys:
        return F.lit(None).cast("string")
    pairs = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    key, out = category_key(value), []
    out.append(F.element_at(pairs(keys), key))
    single = {h: next(iter(c)) for h, c in heads.items() if len(c) == 1}
    if single:
        head = F.upper(F.regexp_extract(value, NUMERAL, 1))
        out.append(F.element_at(pairs(single), F.when(head != "", head)))
    start = F.when(value.rlike(CUT), key).when(F.length(key) >= START, F.substring(key, 1, START))
    alike = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in keys.items()]), lambda x: F.startswith(x["k"], start))
    out.append(F.when((F.length(start) > 0) & (F.size(alike) == 1), F.try_element_at(alike, F.lit(1))["c"]))
    return F.coalesce(*out)
