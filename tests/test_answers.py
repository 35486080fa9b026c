"""Answer parsing and grading: cases derived by hand."""

import pytest
from pyspark.sql import functions as F

from osnowa.functions import answers


def value(spark, column, **fields):
    names = list(fields)
    schema = ", ".join(f"{n} {'map<string,string>' if isinstance(v, dict) or (v is None and n in ("k",) and "kind" in fields) else 'int' if isinstance(v, int) else 'string'}" for n, v in fields.items())
    return spark.createDataFrame([tuple(fields[n] for n in names)], schema).select(column.alias("x")).first()["x"]


C = F.col


@pytest.mark.parametrize("kind,text,want", [
    ("closed_choice", "odp. b, bo", "B"), ("closed_choice", "brak", "BRAK"), ("closed_tf", " 01) p\nuwaga\n2 - F", "1: P\n2: F"), ("closed_multi", "1: a\n2. C", "1: A\n2: C"),
    ("closed_match", "a)  Jan  Nowak\nB: 2", "A: Jan Nowak\nB: 2"), ("open", " tekst ", "tekst"), ("closed_tf", "", ""), ("closed_tf", None, ""),
])
def test_normal_closed(spark, kind, text, want):
    assert value(spark, answers.normal_closed(C("k"), C("t")), k=kind, t=text) == want


@pytest.mark.parametrize("kind,text,want", [
    ("closed_choice", "C", True), ("closed_tf", "1: P\n2: F", True), ("closed_tf", "1: P", False), ("closed_match", "A: 1\nB: x", True), ("open", "tak albo nie", False), ("open", "a / b", False),
    ("open", "zdanie", True), ("essay", "Temat nr 1 " + "słowo " * 300, True), ("essay", "Temat nr 1 krótko", False), ("open", None, False), ("inny", "x", False),
])
def test_valid_answer(spark, kind, text, want):
    assert value(spark, answers.valid_answer(C("k"), C("t")), k=kind, t=text) is want


def test_one_wording(spark):
    assert value(spark, answers.one_wording(C("t"), ["przykładowa odpowiedź"]), t="Przykładowa odpowiedź: król / książę / wódz, w 1410 / 1411") == "król, w 1410–1411"


@pytest.mark.parametrize("kind,fmt,text,want", [
    ("closed_choice", "A", "Nie A, tylko **C**.", "C"), ("closed_choice", "A", "nie wiem", "nie wiem"), ("closed_tf", "1: P\n2: F", "1. prawda\n2) Fałsz", "1: P\n2: F"),
    ("closed_match", "A: 1\nB: 1", "A – numer 3\nB → 2", "A: 3\nB: 2"), ("closed_match", "A: x\nB: x", "A: Jan\nB - Ewa", "A: Jan\nB: Ewa"), ("closed_multi", "1: A\n2: A", "1: (B)\n", "1: (B)"),
])
def test_fitted(spark, kind, fmt, text, want):
    assert value(spark, answers.fitted(C("k"), C("f"), C("t")), k=kind, f=fmt, t=text) == want


def test_parts(spark):
    p = lambda k, f, t: value(spark, answers.parts(C("k"), C("f"), C("t")), k=k, f=f, t=t)
    assert p("closed_match", "A: 1\nB: 1", "A: 2\nB: Jan: II") == {"A": "2", "B": "Jan: II"}
    assert p("closed_match", "A: 1\nB: 1", "A: 2") is None and p("closed_choice", "A", " D ") == {"": "D"} and p("closed_choice", "A", "x") is None


@pytest.mark.parametrize("answer,want", [
    ("Odpowiedź: C", "C"), ("wybieram b) bo", "B"), ("A. albo B.", None), ("Sądzę, że to Traktat pokojowy", "B"), ("", None), (None, None),
])
def test_chosen(spark, answer, want):
    assert value(spark, answers.chosen(C("a"), C("q")), a=answer, q="Wybierz\nA. Umowa handlowa\nB. Traktat pokojowy.\nC. Unia") == want


def test_matched_and_graded(spark):
    key = {"A": "2", "B": "Jan [III] Sobieski/Sobieski"}
    assert value(spark, answers.matched(C("t"), C("k")), t="A: fragment 2? 2\nB – król Jan Sobieski", k=key)["B"] == key["B"]
    assert value(spark, answers.matched(C("t"), C("k")), t="A: 2\nB: Batory", k=key) == {"A": "2", "B": "WRONG"}
    assert value(spark, answers.matched(C("t"), C("k")), t="A: 2", k=key) == {"A": "2", "B": "?"}
    g = lambda kind, key, most, t, q="": value(spark, answers.graded(C("kind"), C("k"), C("m"), C("t"), C("q")), kind=kind, k=key, m=most, t=t, q=q)
    assert g("closed_tf", {"1": "P", "2": "F", "3": "P"}, 2, "1. Prawda\n2. Fałsz\n3. F") == 1
    assert g("closed_tf", {"1": "P", "2": "F"}, 2, "1. P") is None
    assert g("closed_match", {"A": "2", "B": "1"}, 2, "A: 2\nB: 3") == 1 and g("closed_match", {"A": "2", "B": "1"}, 2, "A: 2") is None
    assert g("closed_choice", {"1": "B"}, 1, "b)") == 1 and g("closed_choice", {"1": "B"}, 1, "A) czy B)") is None
    assert g("closed_multi", {"1": "B", "2": "C"}, 2, "1: B\n2. D") == 1 and g("closed_tf", None, 1, "P") is None


@pytest.mark.parametrize("a,k,want", [
    ("król Władysław Łokietek", "Wladyslaw Lokietek", True), ("USA", "Stany Zjednoczone Ameryki", True), ("Henryk IV", "Henryk III", False), ("Andegawenów", "Anjou/Andegaweni", True), ("", "x", False),
])
def test_alike(spark, a, k, want):
    assert value(spark, answers.alike(C("a"), C("k")), a=a, k=k) is want


def test_contents_and_keys(spark):
    q = "Oceń.\n1. Pierwsze zdanie.\n2. Drugie zdanie.\nA. Jeden\nB. Dwa"
    say = lambda k, a: value(spark, answers.answer_content(C("k"), C("q"), C("a")), k=k, q=q, a=a)
    assert say("closed_tf", "1: F\n2: P") == "Drugie zdanie." and say("closed_choice", "B") == "Dwa" and say("closed_match", "A: 2") == "Jeden Drugie zdanie." and say("open", "x") == "x"
    key = lambda s: value(spark, answers.key_of(C("s")), s=s)
    assert key("A: 2\nB: Jan") == {"A": "2", "B": "Jan"} and key("C.") == {"1": "C"} and key("PFP") == {"1": "P", "2": "F", "3": "P"} and key("Zdanie o czymś.") is None and key("") is None and key(None) is None
    kind = lambda m: value(spark, answers.key_kind(C("m")), m=m)
    assert [kind({"1": "P"}), kind({"A": "1"}), kind({"1": "A"})] == ["closed_tf", "closed_match", "closed_choice"]


def test_filled(spark):
    f = lambda t, a: value(spark, answers.filled(C("t"), C("a")), t=t, a=a)
    assert f("Wydarzenie 1.:\nWydarzenie 2.:", "Wydarzenie 1.: unia\nWydarzenie 2.: -") == 1 and f("Nazwa:\nRok:", "Rok: 1410") == 1 and f("Nazwa:", None) == 0


def test_labelled_sections(spark):
    from osnowa.functions import parsing

    s = lambda x: [tuple(r) for r in value(spark, parsing.labelled_sections(C("t"), ["Podobieństwo", "Różnica"]), t=x)]
    assert s("Podobieństwo:\nPrzykładowe rozwiązania:\n• oba leżą\nnad rzeką\n• inne\nRóżnica: wiek") == [("Podobieństwo", "oba leżą nad rzeką"), ("Różnica", "wiek")]
    assert s("tekst bez etykiet") == [("", "tekst bez etykiet")] and s(None) == [] and s("") == []
    k = lambda lost, auto, a, r: value(spark, parsing.error_kind(C("l").cast("double"), C("auto") == 1, C("a"), C("r"), [("x", "błęd", "nie")], "rest"), l=lost, auto=auto, a=a, r=r)
    assert [k("0", 0, "a", "r"), k("1", 0, " ", "r"), k("1", 1, "a", "r"), k("1", 0, "a", "Błędna"), k("1", 0, "a", "nie błędna")] == [None, "no answer", "form", "x", "rest"]
