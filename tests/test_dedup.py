"""The flagship's steps against a plain loop."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from osnowa.functions import text
from osnowa.operators import dedup, shapes, similarity
from osnowa.plans import dedup_queries


def grams(s):
    import re

    w = re.findall(r"\w+", (s or "").lower())
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def test_flagship_steps_match_a_loop(spark):
    base = "ala ma kota a kot ma mleko i jest bardzo zadowolony z zycia"
    docs = [base, base + " dzis", "dzis " + base + " wczoraj i jutro", "cos zupelnie innego niz wszystko inne tutaj", "", None, base.replace("mleko", "wode"), "dzis " + base + " wczoraj i pojutrze"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, t string")
    pairs = similarity.jaccard_pairs(similarity.gram_sets(df, "doc_id", text.word_ngrams(F.col("t"), 4)), 0.35)
    got = sorted(r["doc_id"] for r in dedup.greedy_first(df, "doc_id", pairs).collect())
    kept = []
    for i, d in enumerate(docs):
        a = grams(d)
        if not any(a and grams(docs[j]) and len(a & grams(docs[j])) / len(a | grams(docs[j])) > 0.35 for j in kept):
            kept.append(i)
    assert got == kept


def test_sentences_and_deficits(spark):
    s = spark.createDataFrame([("W 1410 r. Jagiełło wygrał. Potem odpoczął! Ks. Jan T. Nowak pisał.",), (None,)], "t string")
    got = [r["x"] for r in s.select(shapes.sentences(F.col("t")).alias("x")).collect()]
    assert got[0] == ["W 1410 r. Jagiełło wygrał.", "Potem odpoczął!", "Ks. Jan T. Nowak pisał."] and got[1] is None
    assert shapes.fill_deficits({"a": 4, "b": 2}, {"a": 1}, 4) == {"a": 2, "b": 2}
    assert shapes.fill_deficits({}, {}, 3) == {}


def test_command_wording_is_no_contamination(spark):
    command = "Wyjaśnij znaczenie faktu opisanego w źródle: "
    exam = spark.createDataFrame([(command + "Kanał służy załodze.",), (None,)], "question string")
    items = spark.createDataFrame([(1, command + "Poseł przywozi układ."), (2, command.upper() + "kanał, służy załodze"), (3, None)], "row_id bigint, question string")
    t = SimpleNamespace(synthetic_items=items, exam=exam)
    assert {r["row_id"] for r in dedup_queries.contamination_prefix_anti(t).collect()} == {1, 3}


def test_document_queries_cover_all_sources(spark):
    base = "ala ma kota a kot ma mleko i jest bardzo zadowolony z zycia"
    texts = [base, base + " dzis", "dzis " + base + " wczoraj i jutro", "cos zupelnie innego niz wszystko inne tutaj", "", None, base.replace("mleko", "wode"), "dzis " + base + " wczoraj i pojutrze"]
    sources = ["crawl", "terms", "chats", "essays", "terms", "crawl", "persons", "passages"]
    rows = [(i, x, s, "pl" if i % 2 else None) for i, (x, s) in enumerate(zip(texts, sources))]
    t = SimpleNamespace(documents=spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string"))
    g = [grams(x) for x in texts]
    near = {(i, j) for i in range(8) for j in range(i + 1, 8) if g[i] and g[j] and len(g[i] & g[j]) / len(g[i] | g[j]) > 0.35}
    assert {(r["a"], r["b"]) for r in dedup_queries.jaccard_pairs_corpus(t).collect()} == near
    kept = []
    for i in range(8):
        if g[i] and not any((j, i) in near for j in kept):
            kept.append(i)
    assert sorted(r["doc_id"] for r in dedup_queries.greedy_neardup_kept(t).collect()) == kept
    clear = [i for i in range(8) if g[i] and not any(b == i for _, b in near)]
    assert sorted(r["doc_id"] for r in dedup_queries.rejected_also_block(t).collect()) == clear
    got = {r["lang"]: r["n"] for r in dedup_queries.kept_by_language(t).collect()}
    assert got == {k: n for k, n in (("pl", sum(i % 2 for i in clear)), ("—", sum(1 - i % 2 for i in clear))) if n}


def test_later_copies_are_in_no_pairs(spark, monkeypatch):
    base = "ala ma kota a kot ma mleko i jest bardzo zadowolony z zycia"
    texts = [base + " dzis", base, "dzis " + base, base.upper(), "", None, "...", "...", "krotki"] + ["Krotki", base, base + " dzis", "cos zupelnie innego niz wszystko inne"] * 30
    t = SimpleNamespace(documents=spark.createDataFrame([(900 - 7 * i, x, "pl" if i % 2 else None) for i, x in enumerate(texts)], "doc_id bigint, text string, lang string"))
    compared = []
    pairs = similarity.jaccard_pairs
    monkeypatch.setattr(similarity, "jaccard_pairs", lambda sets, *x, **y: compared.append(sets.count()) or pairs(sets, *x, **y))
    rows = sorted((900 - 7 * i, grams(x), i % 2) for i, x in enumerate(texts))
    like = lambda a, b: bool(a and b) and len(a & b) / len(a | b) > 0.35
    clear = [x for i, x in enumerate(rows) if x[1] and not any(like(y[1], x[1]) for y in rows[:i])]
    assert sorted(r["doc_id"] for r in dedup_queries.rejected_also_block(t).collect()) == [x[0] for x in clear]
    got = {r["lang"]: r["n"] for r in dedup_queries.kept_by_language(t).collect()}
    assert got == {k: n for k, n in (("pl", sum(x[2] for x in clear)), ("—", sum(1 - x[2] for x in clear))) if n}
    kept = []
    for x in rows:
        if not any(like(y[1], x[1]) for y in kept):
            kept.append(x)
    assert sorted(r["doc_id"] for r in dedup_queries.greedy_neardup_kept(t).collect()) == [x[0] for x in kept if x[1]]
    got = {r["lang"]: r["n"] for r in dedup_queries.flagship_dedup_counts(t).collect()}
    assert got == {"pl": sum(x[2] for x in kept), "—": sum(1 - x[2] for x in kept)}
    assert max(compared) <= 5
