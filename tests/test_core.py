"""Hand-derived cases of the core operators."""

import pytest
from pyspark.sql import functions as F

from osnowa.functions import names, parsing, text
from osnowa.functions.bags import as_set, words
from osnowa.operators import dedup, graph, reports, retrieval, similarity, stats, windows
from osnowa.sources import files
from osnowa.streaming import incremental


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_word_ngrams(spark):
    g = text.word_ngrams(F.col("t"), 4)
    assert one(spark, g, t="a b c") == ["a\u0001b\u0001c"]
    assert one(spark, g, t="") == []
    assert one(spark, g, t=None) is None
    assert len(one(spark, g, t="a b c d e d")) == 3


def test_jaccard_of_empty_sets(spark):
    j = text.jaccard(F.array().cast("array<string>"), F.array(F.lit("x")))
    assert one(spark, j, t="") == 0.0


@pytest.mark.parametrize("ok,n,most,points", [(3, 3, 2, 2), (2, 3, 2, 1), (1, 3, 2, 0), (1, 2, 1, 0), (2, 2, 1, 1), (1, 2, 2, 1), (3, 4, 2, 1)])
def test_score(spark, ok, n, most, points):
    assert spark.range(1).select(parsing.score(F.lit(ok), F.lit(n), F.lit(most)).alias("x")).first()["x"] == points


def test_years_and_dates(spark):
    assert one(spark, text.years_in(F.col("t"), ["talar"]), t="W 1410 r. i 1525 talarów, 2031, 966") == [1410]
    assert one(spark, text.years_in(F.col("t")), t="W 44 r. p.n.e. i 1500 zł, 1683 roku, XVII–XVIII w., 12345") == [-44, 1683, 1650]
    assert one(spark, text.has_date(F.col("t")), t="w XIX wieku") is True


def test_text_helpers(spark):
    assert one(spark, text.dedup_lines(F.col("t")), t="Ala\nkot\nALA!\nkot.") == "Ala\nkot"
    assert one(spark, text.drop_alternatives(F.col("t")), t="a / b / c d") == "a d"
    assert one(spark, text.strip_think(F.col("t")), t="<think>x</think> y") == "y"
    assert one(spark, text.divergence(F.lit("abcd"), F.lit("abxd")), t="") == 2
    assert one(spark, text.proper_stems(F.col("t")), t="Król Kazimierz wjechał, Wisła wylała") == ["kazimi", "wisła"]
    before, after = text.split_at_verb(F.col("t"), ["Podaj", "Wyjaśnij"])
    assert one(spark, before, t="Źródło\nWyjaśnij to.\nX") == "Źródło"
    assert one(spark, after, t="Źródło\nWyjaśnij to.\nX") == "Wyjaśnij to.\nX"


def test_md5_bucket_is_the_number_modulo(spark):
    import hashlib

    got = one(spark, text.md5_bucket(F.col("t"), 100, "s"), t="abc")
    assert got == int(hashlib.md5(b"s:abc").hexdigest(), 16) % 100


def test_parsing(spark):
    assert one(spark, parsing.choice(F.col("t")), t="Odpowiedź: B, nie C") == "B"
    assert one(spark, parsing.choice(F.col("t"), last=True), t="Odpowiedź: B, nie C") == "C"
    assert one(spark, parsing.true_false(F.col("t"), 3), t="1. P\n2. F\n3. P") == ["P", "F", "P"]
    assert one(spark, parsing.true_false(F.col("t"), 3), t="P F") is None
    assert one(spark, parsing.closed_parts(F.col("t")), t="1: a\n2: B\n1: C") == {"1": "A", "2": "B"}
    assert one(spark, parsing.loose_json(F.col("t")), t='<think>q</think>```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, parsing.loose_json(F.col("t")), t="none") is None


def test_greedy_first_compares_with_kept_only(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "r bigint")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint")
    assert sorted(r["r"] for r in dedup.greedy_first(rows, "r", pairs).collect()) == [1, 3]
    assert [r["r"] for r in dedup.drop_if_any_earlier(rows, "r", pairs).collect()] == [1]


def test_jaccard_pairs_match_brute_force(spark):
    import itertools

    docs = [(i, " ".join(w)) for i, w in enumerate(["a b c d", "a b c e", "x y z", "a b c d e", "", "x y"])]
    df = spark.createDataFrame([*docs, (99, None)], "r bigint, t string")
    sets = similarity.gram_sets(df, "r", text.words(F.col("t")))
    got = {(r["a"], r["b"]) for r in similarity.jaccard_pairs(sets, 0.5).collect()}
    want = set()
    for (i, a), (j, b) in itertools.combinations(docs, 2):
        x, y = set(a.split()), set(b.split())
        if x and y and len(x & y) / len(x | y) > 0.5:
            want.add((i, j))
    assert got == want


def test_windows(spark):
    df = spark.createDataFrame([(1, "?"), (2, "x"), (3, "?"), (4, "y")], "i int, e string").withColumn("k", F.lit(1))
    assert [r["e"] for r in windows.forward_fill(df, "e", ["k"], ["i"]).orderBy("i").collect()] == ["?", "x", "x", "y"]
    cap = spark.createDataFrame([(1, 4), (2, 4), (3, 4)], "i int, n int")
    assert sorted(r["i"] for r in windows.within_cap(cap, ["i"], F.col("n"), 5).collect()) == [1, 2]
    starts = spark.createDataFrame([(7,), (5,), (0,)], "n int").select(windows.chunk_starts(F.col("n"), 5, 3).alias("s"))
    assert [r["s"] for r in starts.collect()] == [[0, 3], [0], []]
    votes = spark.createDataFrame([("q", "B", 1), ("q", "A", 2), ("q", "A", 3), ("q", "B", 4), ("p", None, 1), ("p", "A", 2)], "q string, v string, i int")
    assert {(r["q"], r["v"]) for r in windows.plurality(votes, ["q"], "v", "i").collect()} == {("q", "B"), ("p", "A")}
    seats = windows.largest_remainder(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, w double"), "k", "w", 10)
    assert sorted((r["k"], r["seats"]) for r in seats.collect()) == [("a", 4), ("b", 3), ("c", 3)]


def test_total_order_over_partitions(spark):
    df = spark.range(1000).repartition(7).withColumn("v", F.lit(2))
    got = windows.in_order(df, ["id"], F.col("v")).where("position <> id + 1 OR before <> id * 2").count()
    assert got == 0
    assert windows.in_order(spark.range(0), ["id"]).count() == 0


def test_text_normalisers(spark):
    t = F.col("t")
    assert one(spark, text.clean_answer(t), t="<think>x</think>**Tak**, bo") == "Tak, bo"
    assert one(spark, text.clean_answer(t), t="szkic</think> Odp") == "Odp" and one(spark, text.clean_answer(t), t="całość</think>  ") == "całość"
    assert one(spark, text.strip_citations(t), t="Fakt. Źródło: Kronika, Kraków 1901\nDalej s. 12").split() == ["Fakt.", "Dalej"]
    assert one(spark, text.scope_of(t, ["Polsk"], "a", "b"), t="Na podstawie: Historia Polski\nRzym") == "b" and one(spark, text.scope_of(t, ["Polsk"], "a", "b"), t="polski król") == "a"
    assert one(spark, text.tidy(t), t="prze-\nniesienie [x]") == "przeniesienie x" and "(x)" in one(spark, text.tidy(t), t="słowo " * 20 + "[x]")
    assert one(spark, text.dedup_sentences(t), t="Ala ma kota. ALA MA KOTA! Pies.") == "Ala ma kota. Pies."
    assert one(spark, text.key_terms(t, ["oraz"]), t="Jaki oraz wielki pożar miasta wybuchł") == ["jaki", "wielk", "pożar"]
    assert one(spark, text.entity_query(t), t="kiedy Jan Sobieski wygrał w 1683 roku") == "Jan Sobieski 1683 kiedy Jan Sobieski wygrał w 1683 roku"
    assert one(spark, text.cited_terms(t, []), t="Za: Kronika dawna\nMury miejskie\nDruk, Kraków 1901") == ["mury", "miejsk"]
    assert one(spark, text.median_year(t), t="W 1410 r. i 1600 r.") == 1505.0 and one(spark, text.median_year(t, [("rycer", 1100)]), t="bitwa rycerska") == 1100.0 and one(spark, text.median_year(t), t="nic") is None
    assert one(spark, text.nearest_above(t, "[Obraz"), t="Tytuł ryciny\n\n[Obraz: a]") == "Tytuł ryciny" and one(spark, text.nearest_above(t, "[Obraz"), t="[Obraz: a]") == ""
    assert one(spark, text.before_last_paragraph(t, F.lit("N")), t="a\n\nb\n\nc") == "a\n\nb\n\nN\n\nc" and one(spark, text.before_last_paragraph(t, F.lit("N")), t="a") == "a\n\nN"
    assert one(spark, parsing.string_leaves(t), t='{"a": ["x", {"b": "y\\n"}], "c": 1}') == ["x", "y\n"] and one(spark, parsing.string_leaves(t), t="x") is None
    assert one(spark, parsing.listed(t), t='["a", " ", "b"]') == ["a", "b"] and one(spark, parsing.listed(t), t="- a\n\n• b") == ["a", "b"] and one(spark, parsing.listed(t), t=None) == []
    assert one(spark, names.canonical(t, ["I. Osady", "II. Miasta"]), t="ii") == "II. Miasta" and one(spark, names.canonical(t, ["I. Osady"]), t="x") is None


def test_reports(spark):
    a = spark.createDataFrame([("x", 1)], "id string, p int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "id string, p int")
    assert sorted((r["id"], r["p"]) for r in reports.override([a, b], ["id"]).collect()) == [("x", 2), ("y", 3)]
    given = spark.createDataFrame([("a",), ("a",), ("z",)], "g string")
    asked = spark.createDataFrame([("a",), ("b",)], "q string")
    assert {tuple(r) for r in reports.contract_errors(given, "g", asked, "q").collect()} == {("z", "unknown"), ("b", "missing"), ("a", "duplicate")}
    assert reports.markdown(a).splitlines()[2] == "| x | 1 |"


def test_fusion_and_recall(spark):
    r = lambda xs: spark.createDataFrame([(1, ord(x), i + 1) for i, x in enumerate(xs)], "query int, row int, rank int")
    got = {chr(x["row"]): x["score"] for x in retrieval.fuse([r("ab"), r("bc")], 3).collect()}
    assert got == pytest.approx({"b": 1 / 61 + 1 / 62, "a": 1 / 61, "c": 1 / 62})
    gold = spark.createDataFrame([(1, ord("b"))], "query int, row int")
    assert {x["k"]: x["recall"] for x in retrieval.recall_at(r("ab"), gold, [1, 2]).collect()} == {1: 0.0, 2: 1.0}


def test_bm25_ties_and_distinct_terms(spark):
    docs = spark.createDataFrame([(1, "Ala Ala kot"), (2, "kot Ala"), (3, "pies"), (4, None), (5, "")], "r bigint, t string")
    posts = retrieval.postings(docs, "r", text.distinct_terms(F.col("t"), []))
    assert posts.where("r = 1" if "r" in posts.columns else "row = 1").count() == 2
    q = spark.createDataFrame([(7, "kot")], "q bigint, t string")
    assert [x["row"] for x in retrieval.bm25(q, "q", text.distinct_terms(F.col("t"), []), posts, 5).orderBy("rank").collect()] == [2, 1]


def test_graph(spark):
    merges = spark.createDataFrame([("a", "b"), ("ab", "c"), ("x", "y")], "left_part string, right_part string")
    kept = spark.createDataFrame([("abc",)], "token string")
    assert {r["token"] for r in graph.merge_closure(kept, merges).collect()} == {"abc", "ab", "a", "b", "c"}
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 12.0, 0.0, 20.0, 10.0), (1, 100.0, 0.0, 110.0, 10.0)], "p int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(tuple(r)[1:] for r in graph.merge_boxes(boxes, ["p"]).collect()) == [(0.0, 0.0, 20.0, 10.0), (100.0, 0.0, 110.0, 10.0)]


def test_bootstrap(spark):
    df = spark.range(200).select((F.col("id") % 10).cast("double").alias("v"))
    r = stats.bootstrap_mean(df, "v", 300).first()
    assert r["n"] == 200 and r["mean"] == pytest.approx(4.5) and r["low"] < 4.5 < r["high"] and r["high"] - r["low"] < 1.2


def test_stratified_bootstrap(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), (F.col("id") % 5).cast("double").alias("v"))
    r = stats.stratified_bootstrap(df, "g", "v", 200).first()
    assert r["reps"] == 200 and r["low"] < 600 < r["high"] and r["mean"] == pytest.approx(600, abs=15)
    assert stats.bootstrap_mean(df.limit(0), "v", 10).first()["n"] == 0
    a, b = stats.bootstrap_mean(df, "v", 50).first(), stats.bootstrap_mean(df.repartition(7), "v", 50).first()
    assert a["low"] == pytest.approx(b["low"]) and a["high"] == pytest.approx(b["high"])


def test_depths_beyond_any_cap(spark):
    chain = spark.range(1, 200).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    far = graph.ancestors(chain.union(spark.createDataFrame([(0, None)], "node bigint, parent bigint"))).where("node = 199")
    assert far.count() == 200 and far.agg(F.max("distance")).first()[0] == 199
    loop = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "node bigint, parent bigint")
    assert {tuple(r) for r in graph.ancestors(loop).where("node = 3").collect()} == {(3, 3, 0), (3, 1, 1), (3, 2, 2)}
    merges = spark.createDataFrame([("a" * i, "a") for i in range(1, 90)], "left_part string, right_part string")
    assert graph.merge_closure(spark.createDataFrame([("a" * 90,)], "token string"), merges).count() == 90


def test_ranks_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("hot")).alias("g"), F.col("id").alias("i"))
    r = windows.ranked(df.repartition(5), ["g"], ["i"]).groupBy("g").agg(F.max("rank").alias("m"), F.countDistinct("rank").alias("d"), F.max("size").alias("s")).collect()
    assert all(x["m"] == x["d"] == x["s"] for x in r) and sorted(x["m"] for x in r) == [667, 1333]
    assert windows.ranked(df.limit(0), ["g"], ["i"]).count() == 0


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "x", "o": 1}\n\n{bad\n{"id": "x", "o": 2}\n')
    assert files.read_jsonl(spark, str(p), "id string, o int").count() == 2
    assert files.read_jsonl(spark, str(tmp_path / "none*.jsonl"), "id string").count() == 0
    q = tmp_path / "b.jsonl"
    q.write_text('{"id": "x", "o": 1}\n{"id": "x", "o": 2}\n')
    assert files.read_keyed(spark, str(q), "id string, o int", "id", "o").first()["o"] == 2
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "cc")], "i int, t string")
    assert files.within_bytes(df, ["i"], "t", 3).count() == 2
    files.release(df, str(tmp_path / "v1"))
    with pytest.raises(Exception):
        files.release(df, str(tmp_path / "v1"))
    m = spark.createDataFrame([('{"a": {"points": 1.5}}',)], "j string")
    assert files.map_rows(m, "j", "points: double").first().asDict() == {"id": "a", "points": 1.5}
    files.write_accepted(df, F.when(F.col("i") > 1, "keep").otherwise("small"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/rejected")).first()["reason"] == "small"


def test_stream_resumes(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"id": 1}\n')
    stream = lambda: incremental.file_stream(spark, str(src), "id int")
    each = lambda batch, n: batch.write.mode("append").parquet(out)
    incremental.drain(stream(), each, str(tmp_path / "cp"))
    (src / "2.json").write_text('{"id": 2}\n')
    incremental.drain(stream(), each, str(tmp_path / "cp"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_bags_fold_and_count():
    h, t = words(["Łódź łódź, lodz", None, "", "abc", "Źaba żaba"])
    assert len(h) == 5 and (h[0] == h[1] == h[2]) and list(t) == [0, 0, 0, 4, 4]
    e, _ = as_set(h, t)
    assert len(set(e.tolist())) == 4 or len(set(e.tolist())) == 5
