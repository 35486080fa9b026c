"""Variant spellings of names typed by people, linked to one record per person.

A written form is read into a family-name stem, given names and a gender: titles, epithets and places are dropped, digits put
for letters by scanning are put back, given names are looked up among first names, their short forms and their genitives. Where
several parts may be the family name, each of them gives a reading. Family-name stems one edit apart are found by a trie join.
Forms are then compared in every order of their parts: given names, in either order, may be equal, abbreviated or missing, and
the years of life must agree as far as known. A reading by another part than the longest counts only where no longer one fits.

Forms, not rows, are joined, and joins run on family name and a bucket of years, so a family with many members or a person
mentioned in a third of all entries stays spread.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut
from .components import components
from .triejoin import build, near_strings, within

# --- fixed values: first names with their short forms, titles -----------------------------------------------------------------
FIRST_NAMES = """
adam: adas; agata: agatka; agnieszka: agnisia aga; aleksander: olek alek; aleksandra: ola olka; alicja: ala; andrzej: jedrzej
jedrek andrzejek; anna: ania anka hania; antoni: antek antos tolek; barbara: basia baska; bartlomiej: bartek bartus; bernard: benek; boleslaw: bolek;
cecylia: cesia; celina: cela; dominik: domek; dorota: dorotka dosia; edmund: mundek; edward: edek edzio; elzbieta: ela elka bietka;
emilia: emilka; ewa: ewka; feliks: felek; franciszek: franek franus; franciszka: frania franka; genowefa: genia; grzegorz: grzesiek grzes; halina: halinka;
helena: hela helenka; henryk: heniek; hieronim: hirek; ignacy: ignas ignac; irena: irka; jadwiga: jadzia jaga; jakub: kuba kubus; jan: jas
janek jasiek; janina: janka; jerzy: jurek; joanna: joasia asia; jozef: jozek ziutek jozio; julian: julek; karol: karolek; katarzyna: kasia kaska; kazimierz: kazik kazio;
konstanty: kostek; krystyna: krysia kryska; krzysztof: krzysiek krzys; leon: leonek; leopold: poldek leo; ludwik: ludek lutek; ludwika: ludka ludwisia; lukasz: lukaszek;
maciej: maciek macius; magdalena: magda magdusia; malgorzata: gosia malgosia; marcin: marcinek; marek: mareczek; maria: marysia mania marynia; mateusz: mateuszek; michal: michas
misiek; mikolaj: mikolajek miki; natalia: natalka; pawel: pawelek; piotr: piotrek piotrus; rafal: rafalek; regina: renia reginka; roman: romek romus; stanislaw: stach stas staszek;
stefan: stefek; szymon: szymek szymus; tadeusz: tadek; teodor: teos teodorek; teresa: tereska; tomasz: tomek tomus; urszula: ula ulka; waclaw: wacek; walenty: walek; wanda: wandzia
wandeczka; wiktor: wiktorek; wincenty: wicek; wladyslaw: wladek; wlodzimierz: wlodek; wojciech: wojtek wojtus; zbigniew: zbyszek; zofia: zosia zoska; zygmunt: zyga zygmus
"""
TITLES = set(
    "hr ks dr prof gen bp abp kard s br o sw plk kpt mjr por ppor inz mgr hrabia ksiadz doktor profesor general biskup arcybiskup kardynal siostra brat ojciec wojewoda "
    "kanclerz poslanka posel ksieni opat opatka ksiaze ksiezna krol krolowa hetman marszalek kasztelan starosta pulkownik kapitan major pani pan lord sir".split()
)
EPITHETS = {"zwany", "zwana", "zw", "alias", "vel", "przydomek"}
PLACES = {"z", "ze", "von", "de", "od"}
POLISH = str.maketrans("ąćęłńóśźżĄĆĘŁŃÓŚŹŻ", "acelnoszzACELNOSZZ")
SCANNED = str.maketrans({"0": "o", "1": "l", "5": "s", "8": "b"})
#: Letter pairs and the letter they are scanned from.
SCANNED_PAIRS = {"rn": "m", "vv": "w", "ii": "u"}
FORM = "sur string, g1 string, f1 boolean, g2 string, f2 boolean, sex string"


def _genitives(name: str) -> list[str]:
    if name.endswith("ia") or name.endswith("ja"):
        return [name[:-1] + "i", name[:-1]]
    if name.endswith(("ga", "ka")):
        return [name[:-1] + "i"]
    if name.endswith("a"):
        return [name[:-1] + "y"]
    if name.endswith(("i", "y")):
        return [name + "ego", name[:-1] + "ego"]
    if name.endswith("ek"):
        return [name[:-2] + "ka", name + "a"]
    if name.endswith("iec"):
        return [name[:-3] + "ca"]
    return [name + "a", name + "u"]


@functools.lru_cache(maxsize=1)
def lexicon() -> tuple[dict[str, str], dict]:
    """Folded spelling -> first name, for full names, short forms and genitives; and a trie of all of them."""
    known: dict[str, str] = {}
    for entry in FIRST_NAMES.replace("\n", " ").split(";"):
        name, _, short = entry.strip().partition(":")
        forms = [name.strip(), *short.split()]
        for f in forms:
            known.setdefault(f, forms[0])
    for f, name in list(known.items()):
        for g in _genitives(f):
            known.setdefault(g, name)
    return known, build(list(known))


@functools.lru_cache(maxsize=200_000)
def first_name(token: str) -> str | None:
    known, trie = lexicon()
    if token in known:
        return known[token]
    if len(token) >= 4:
        near = {known[x] for x in within(trie, token) if len(x) >= 4}
        if len(near) == 1:
            return near.pop()
        # of several, the one whose own full spelling is near
        full = [n for n in near if n in within(trie, token)]
        if len(full) == 1:
            return full[0]
        if scanned(token) != token:
            return first_name(scanned(token))
    return None


#: Endings of family names -> (stem ending, gender); longest first, applied to folded names.
ENDINGS = [
    ("kiego", "k", "m"), ("kiemu", "k", "m"), ("kiej", "k", "f"), ("kim", "k", "m"), ("ki", "k", "m"), ("ka", "k", "f"),
    ("owicza", "owicz", "gen"), ("owiczowi", "owicz", "gen"), ("owiczem", "owicz", "gen"), ("aka", "ak", "gen"), ("akowi", "ak", "gen"),
    ("akiem", "ak", "gen"), ("uka", "uk", "gen"), ("ukowi", "uk", "gen"), ("ukiem", "uk", "gen"), ("icza", "icz", "gen"),
]
#: First names of women that are also a genitive of a man's.
GENITIVE_OF = {"franciszka": "franciszek", "ludwika": "ludwik", "aleksandra": "aleksander"}


def scanned(token: str) -> str:
    """Pairs of letters that scanning puts for one are put back, in clean names too, so both sides agree."""
    for pair, one in SCANNED_PAIRS.items():
        token = token.replace(pair, one)
    return token


def family(token: str) -> tuple[str, str]:
    """Stem and gender of a folded family name; a final vowel, which gender and case change, is no part of the stem."""
    token = scanned(token)
    for end, stem, sex in sorted(ENDINGS, key=lambda e: -len(e[0])):
        if token.endswith(end) and len(token) > len(end) + 2:
            return token[: -len(end)] + stem, sex
    return (token[:-1], "") if len(token) > 5 and token[-1] in "aiy" else (token, "")


Reading = tuple[str | None, str, bool, str, bool, str]


def read(name: str) -> Reading:
    """The first of :func:`readings`."""
    return readings(name)[0]


@functools.lru_cache(maxsize=200_000)
def readings(name: str) -> tuple[Reading, ...]:
    """(family stem, first given name, whether it is full, second, whether it is full, gender) of a written name, once for each
    part that may be the family name: parts that are no first names, or all if there are no others, the longest first.

    A name without a family name (blank, titles only) has one reading with a null stem.
    """
    s = name.translate(POLISH).lower()
    s = re.sub(r"(?<=[a-z])[0158]|[0158](?=[a-z])", lambda m: m.group(0).translate(SCANNED), s)
    tokens = re.findall(r"[^\W\d_]+\.?|,", s)
    parts = []
    for t in tokens:  # epithets and places run to the end
        bare = t.rstrip(".")
        if bare in EPITHETS or (bare in PLACES and "." not in t and len([p for p in parts if len(p) > 2]) >= 2):
            break
        parts.append(t)
    while parts and parts[0].rstrip(".") in TITLES and sum(len(p.rstrip(".")) > 1 for p in parts) > 1 and not (
        len(parts[0]) == 2 and parts[0].endswith(".") and len([p for p in parts if p != ","]) == 2
    ):
        parts.pop(0)
    if "," in parts:  # family name first
        k = parts.index(",")
        parts = [*[p for p in parts[k + 1 :] if p != ","], *parts[:k]]
    words = [p for p in parts if p != ","]
    full = [w for w in words if not w.endswith(".") and len(w) > 2]
    if not full:
        full = [w for w in words if len(w.rstrip(".")) > 3]
    options = [w for w in full if first_name(w) is None] or full
    if not options:
        return ((None, "", False, "", False, ""),)
    return tuple(dict.fromkeys(_reading(words, sur) for sur in sorted(options, key=lambda w: (-len(w), w))))


def _reading(words: list[str], sur: str) -> Reading:
    """The name with the part ``sur`` as the family name; the others are given names."""
    given, rest = [], []
    for w in words:
        if w is sur:
            continue
        bare = w.rstrip(".")
        if w.endswith(".") or len(bare) <= 1:
            given.append((bare, False))
        else:
            known = first_name(bare)
            (given if known else rest).append((known, True) if known else (bare, True))
    given = (given or rest)[:2]
    stem, sex = family(sur.rstrip("."))
    if sex == "gen" or (sex == "m" and sur.endswith(("ego", "emu", "kim"))):  # the whole name is declined
        given = [(GENITIVE_OF.get(g, g), f) for g, f in given]
        sex = "m"
    (g1, f1), (g2, f2) = [*given, ("", False), ("", False)][:2]
    return stem, g1, f1, g2, f2, sex


def with_forms(df: DataFrame, name: str, every: bool = False) -> DataFrame:
    """``df`` with the reading of column ``name`` appended; with ``every``, a row for each reading, numbered in ``nth``."""
    form = StructType.fromDDL(FORM + (", nth int" if every else ""))
    kept, shape = df.columns, StructType([*df.schema, *form])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, got = [], []
            for i, x in enumerate(b[name].to_pylist()):
                all_ = readings(x) if x else ((None, "", False, "", False, ""),)
                for k, r in enumerate(all_ if every else all_[:1]):
                    of.append(i)
                    got.append((*r, k))
            cols = [pa.array([g[i] for g in got], pa.int32() if i == 6 else pa.bool_() if i in (2, 4) else pa.string()) for i in range(len(form))]
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b[c].take(take) for c in kept], *cols], shape.names)

    return df.mapInArrow(parse, shape)


def life(years: Column) -> tuple[Column, Column]:
    """Years of birth and death of a written life span; BCE negative; a part that is not given is null."""
    y = F.lower(F.coalesce(years, F.lit("")))
    numbers = F.regexp_extract_all(y, F.lit(r"(\d{1,4})"), 1)
    bce_all = y.rlike(r"\d\s*p\.?\s*n\.?\s*e\.?[^\d]*$") & ~y.rlike(r"(?<!p\.)(?<!p\. )n\.\s*e\.\s*$")
    bce_first = y.rlike(r"\d\s*p\.?\s*n\.?\s*e\.?\s*[-–—/]")
    first = F.try_element_at(numbers, F.lit(1)).cast("int")
    second = F.try_element_at(numbers, F.lit(2)).cast("int")
    only_death = y.rlike(r"^\s*(\?|zm\.|†)") & second.isNull()
    birth = F.when(only_death, None).otherwise(F.when(bce_all | bce_first, -first).otherwise(first))
    death = F.when(only_death, F.when(bce_all, -first).otherwise(first)).otherwise(F.when(bce_all, -second).otherwise(second))
    return birth.alias("birth"), death.alias("death")


def _begins(full: Column, short: Column) -> Column:
    return F.startswith(full, short)


def _given(a: str, b: str) -> Column:
    """Whether given names agree, in the order written or, where both have two, swapped: both full and equal, or one the
    beginning of the other, or one missing."""

    def agree(k: str, m: str) -> Column:
        x, y, fx, fy = F.col(f"{a}.g{k}"), F.col(f"{b}.g{m}"), F.col(f"{a}.f{k}"), F.col(f"{b}.f{m}")
        return F.when(fx & fy, x == y).when(~fx, _begins(y, x) | (y == "")).otherwise(_begins(x, y) | (x == ""))

    two = (F.col(f"{a}.g2") != "") & (F.col(f"{b}.g2") != "")
    return (agree("1", "1") & agree("2", "2")) | (two & agree("1", "2") & agree("2", "1"))


def _initials(df: DataFrame, known: bool) -> DataFrame:
    """``df`` once for each initial under which given names that agree meet: those of records (``known``) under both initials
    and under '*', others under the first initial and under none, or under '*' if they have none."""
    i1, i2 = F.substring("g1", 1, 1), F.substring("g2", 1, 1)
    keys = F.array(i1, F.when(i2 != "", i2), F.lit("*")) if known else F.when(i1 == "", F.array(F.lit("*"))).otherwise(F.array(i1, F.lit("")))
    return df.withColumn("initial", F.explode(F.array_distinct(F.array_compact(keys))))


def _same_sex(a: str, b: str) -> Column:
    x, y = F.col(f"{a}.sex"), F.col(f"{b}.sex")
    return (x == "") | (y == "") | (x == y)


def _close(a: str, b: str, slack: int) -> Column:
    near = lambda c: F.coalesce(F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) <= slack, F.lit(True))
    return near("birth") & near("death")


def persons_read(persons: DataFrame) -> DataFrame:
    """Person records (row, name, years, text) with every reading of the name (``nth`` 0 is the first), birth and death, and
    ``said``, the years in the text of a record that has neither."""
    birth, death = life(F.col("years"))
    base = persons.select(F.col("row").cast("bigint").alias("row"), "name", birth, death, F.col("text").alias("text")).where("row IS NOT NULL")
    ty = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?<!\d)(\d{3,4}) (?:p\.n\.e\. )?r\."), 1), lambda x: x.cast("int"))
    base = base.withColumn("said", F.when(F.col("birth").isNull() & F.col("death").isNull(), ty)).drop("text")
    return cut(with_forms(base, "name", every=True))


def neighbours_of(read_: DataFrame, seen: DataFrame) -> DataFrame:
    """(sur, other): family stems of records or mentions, and the recorded stems equal or one edit apart; one trie join for both."""
    recorded = read_.where("sur IS NOT NULL").select("sur").distinct()
    every = recorded.withColumn("known", F.lit(True)).union(seen.select("sur", F.lit(False)))
    near = near_strings(every, "sur", "known").select(F.explode(F.array(F.struct(F.col("a").alias("sur"), F.col("b").alias("other")), F.struct(F.col("b").alias("sur"), F.col("a").alias("other")))).alias("p"))
    near = near.select("p.*").join(recorded.withColumnRenamed("sur", "other"), "other", "left_semi").select("sur", "other")
    return cut(near.union(recorded.select("sur", F.col("sur").alias("other"))))


def persons_linked(every: DataFrame, neighbours: DataFrame, slack: int = 3, bucket: int = 16) -> tuple[DataFrame, DataFrame]:
    """(members, forms) of person records as :func:`persons_read` gives them.

    members: row, person (least row), name. forms: what mentions are compared with: every reading (sur, given names, sex, nth), birth, death, person.
    Records whose years agree within ``slack`` and whose names agree are one person, through others too. A record without
    years joins the only person its name fits, or, of several, the one in whose life most of the years of its text lie (of
    these one of the same family stem, of these the least). Records without a readable name stand alone.
    """
    read_ = every.where("nth = 0").drop("nth")
    known = ["sur", "g1", "f1", "g2", "f2", "sex", "birth", "death"]
    forms = cut(read_.where("sur IS NOT NULL").groupBy(*known).agg(F.min("row").alias("id")))
    dated = forms.where("birth IS NOT NULL OR death IS NOT NULL").withColumn("at", F.coalesce("birth", F.col("death") - 50))
    # years agree within the slack, so births stand in the same or a neighbouring bucket; where only a death is known, the birth
    # may lie in any bucket of the 110 years before
    low, high = F.coalesce("birth", F.col("death") - 110), F.coalesce("birth", "death")
    left = dated.withColumn("slot", F.explode(F.sequence(F.floor((low - bucket) / bucket), F.floor((high + bucket) / bucket)))).alias("a")
    right = dated.withColumn("slot", F.floor(F.col("at") / bucket))
    right = right.join(neighbours.withColumnRenamed("sur", "own"), right.sur == F.col("own")).alias("b")
    edges = (
        left.join(right, (F.col("a.sur") == F.col("b.other")) & (F.col("a.slot") == F.col("b.slot")))
        .where((F.col("a.id") != F.col("b.id")) & _given("a", "b") & _same_sex("a", "b") & _close("a", "b", slack))
        .select(F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    )
    parts = components(edges)
    dated_persons = cut(
        dated.drop("at").join(parts, dated.id == parts.node, "left").select(*known, "id", F.coalesce("component", "id").alias("person"))
    )
    undated = forms.where("birth IS NULL AND death IS NULL")
    loose = _initials(undated, False).join(neighbours.withColumnRenamed("sur", "own"), undated.sur == F.col("own")).alias("a")
    fits = (
        loose.join(_initials(dated_persons, True).alias("b"), (F.col("a.other") == F.col("b.sur")) & (F.col("a.initial") == F.col("b.initial")))
        .where(_given("a", "b") & _same_sex("a", "b"))
        .groupBy(F.col("a.id").alias("id"), F.col("b.person").alias("person"))
        .agg(F.min("b.birth").alias("birth"), F.max("b.death").alias("death"), F.max((F.col("a.sur") == F.col("b.sur")).cast("int")).alias("same"))
    )
    fits = cut(fits)
    single = fits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("person").alias("only")).where("n = 1").select("id", "only")
    # rows, not forms, where the text must decide
    rows = read_.where("sur IS NOT NULL AND birth IS NULL AND death IS NULL")
    same_form = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in known[:6]]
    cond = same_form[0]
    for c in same_form[1:]:
        cond = cond & c
    lone = rows.alias("r").join(undated.alias("f"), cond).select("r.row", "r.said", "f.id")
    inside = F.size(F.filter("said", lambda y: (F.abs(y) >= F.least(F.abs("birth"), F.abs("death")) - 5) & (F.abs(y) <= F.greatest(F.abs("birth"), F.abs("death")) + 5)))
    told = (
        lone.join(fits, "id").withColumn("hits", inside).where("hits > 0").groupBy("row")
        .agg((-F.max(F.struct("hits", F.col("same"), (-F.col("person")).alias("least")))["least"]).alias("told"))
    )
    chosen = (
        lone.join(single, "id", "left").join(told, "row", "left")
        .select("row", F.coalesce("only", "told").alias("person"), "id")
    )
    # without any dated person of the name, records of one undated form belong together
    free = chosen.join(fits.select("id").distinct(), "id", "left_anti").select("row", F.col("id").alias("person"))
    of_dated = read_.where("sur IS NOT NULL AND (birth IS NOT NULL OR death IS NOT NULL)").alias("r")
    cond = F.lit(True)
    for c in known:
        cond = cond & F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}"))
    placed = of_dated.join(dated_persons.alias("d"), (F.col("r.sur") == F.col("d.sur")) & cond).select("r.row", "d.person")
    placed = placed.union(chosen.where("person IS NOT NULL").select("row", "person")).union(free)
    members = read_.join(placed.groupBy("row").agg(F.min("person").alias("person")), "row", "left").select(
        "row", F.coalesce("person", "row").alias("person"), "name", *known
    )
    least = members.groupBy("person").agg(F.min("row").alias("first"))
    members = cut(members.join(least, "person").drop("person").withColumnRenamed("first", "person"))
    # a person's life as the records give it, for forms that lack it
    span = members.groupBy("person").agg(F.min("birth").alias("b"), F.max("death").alias("d"))
    all_forms = (
        every.where("sur IS NOT NULL").select("row", "nth", *known[:6]).join(members.select("row", "person"), "row")
        .groupBy("person", *known[:6]).agg(F.min("nth").alias("nth")).join(span, "person")
        .select(*known[:6], "nth", F.col("b").alias("birth"), F.col("d").alias("death"), "person")
    )
    return members.select("row", "person", "name"), cut(all_forms)


def mentions_read(mentions: DataFrame) -> DataFrame:
    """Distinct mentions (name, year) with every reading of the name; a name is read once whatever its years."""
    names = mentions.where("name IS NOT NULL").groupBy("name").agg(
        F.collect_set(F.col("year").cast("int")).alias("years"), F.max(F.col("year").isNull()).alias("undated")
    )
    seen = with_forms(names, "name", every=True).where("sur IS NOT NULL")
    years = F.when(F.col("undated"), F.array_append("years", F.lit(None).cast("int"))).otherwise(F.col("years"))
    return cut(seen.withColumn("year", F.explode(years)).drop("years", "undated"))


def mentions_linked(seen: DataFrame, forms: DataFrame, neighbours: DataFrame, slack: int = 12, slot: int = 64) -> DataFrame:
    """(name, year, person) of mentions as :func:`mentions_read` gives them: the person recorded under a fitting form and alive,
    or nearly, in that year. Of several, by the longer family name, the one with the same family stem, alive in the year, with the
    fuller given names, the least row.
    """
    low = F.coalesce("birth", F.col("death") - 100) - slack
    high = F.coalesce("death", F.col("birth") + 100) + slack
    lives = forms.withColumn("low", low).withColumn("high", high)
    slots = F.when(F.col("low").isNotNull(), F.sequence(F.floor(F.col("low") / slot), F.floor(F.col("high") / slot))).otherwise(F.array(F.lit(None).cast("bigint")))
    lives = lives.withColumn("slot", F.explode(slots))
    named = seen.join(neighbours, "sur").withColumn("slot", F.floor(F.col("year") / slot))
    a, b = named.alias("a"), lives.alias("b")
    fit = _given("a", "b") & _same_sex("a", "b")
    in_time = a.join(b, (F.col("a.other") == F.col("b.sur")) & (F.col("a.slot") == F.col("b.slot"))).where(
        fit & F.col("a.year").between(F.col("b.low"), F.col("b.high"))
    )
    # where one side has no years the name must do; such forms are few, a life is taken once
    once = _initials(lives.where("slot IS NULL OR slot = floor(low / {0})".format(slot)), True)
    pick = ["a.name", "a.year", "a.nth + b.nth AS nth", "a.sur", "b.sur AS bsur", "b.person", "b.birth", "b.death", "a.g1", "b.g1 AS bg1", "a.g2", "b.g2 AS bg2"]
    found = in_time.selectExpr(*pick)
    for x, y in ((named.where("year IS NULL"), once), (named.where("year IS NOT NULL"), once.where("low IS NULL"))):
        met = _initials(x, False).alias("a").join(y.alias("b"), (F.col("a.other") == F.col("b.sur")) & (F.col("a.initial") == F.col("b.initial")))
        found = found.union(met.where(fit).selectExpr(*pick))
    rank = F.struct(
        (-F.col("nth")).alias("reading"), (F.col("sur") == F.col("bsur")).cast("int").alias("same"),
        F.coalesce(F.col("year").between(F.col("birth"), F.col("death")), F.lit(False)).cast("int").alias("alive"),
        (F.col("g1") == F.col("bg1")).cast("int").alias("given"), (F.col("g2") == F.col("bg2")).cast("int").alias("second"),
        (-F.col("person")).alias("least"),
    )
    return found.groupBy("name", "year").agg((-F.max(rank).getField("least")).alias("person"))


def variants(persons: DataFrame, mentions: DataFrame) -> DataFrame:
    """(src, src_row, pos, person_row): records of a person other than its first, and mentions (row, pos, name, year) of
    recorded persons under a spelling none of their records has. Null and blank names refer to nobody."""
    read_, seen = persons_read(persons), mentions_read(mentions)
    neighbours = neighbours_of(read_, seen)
    members, forms = persons_linked(read_, neighbours)
    records = members.where("row <> person").select(F.lit("persons").alias("src"), F.col("row").alias("src_row"), F.lit(0).alias("pos"), F.col("person").alias("person_row"))
    linked = mentions_linked(seen, forms, neighbours)
    spelled = members.select("person", "name").distinct()
    unlike = cut(linked.join(spelled, ["person", "name"], "left_anti"))
    m = mentions.select("row", "pos", "name", F.col("year").cast("int").alias("year")).alias("m")
    told = m.join(unlike.alias("u"), (F.col("m.name") == F.col("u.name")) & F.col("m.year").eqNullSafe(F.col("u.year"))).select(
        F.lit("timeline").alias("src"), F.col("m.row").alias("src_row"), F.col("m.pos").alias("pos"), F.col("u.person").alias("person_row")
    )
    return records.union(told)


__all__ = ["variants", "persons_linked", "mentions_linked", "read", "life", "first_name", "family"]
