"""Sources, sinks, saved indexes and streaming waves on small files."""

import json

import pytest
from pyspark.sql import functions as F

from osnowa.operators import dedup, layers, planning, retrieval
from osnowa.sources import files
from osnowa.streaming import incremental


def test_items_under_any_name(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [{"id": "1", "max_points": 2}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"id": "2", "points": 3}]}))
    (tmp_path / "c.json").write_text(json.dumps([{"id": "3", "max_points": 1}]))
    got = files.read_items(spark, str(tmp_path), "id string, max_points int, points int", ["items", "questions"], {"max_points": ["points"]})
    assert sorted(tuple(r) for r in got.collect()) == [("1", 2), ("2", 3), ("3", 1)]


def test_rules_are_enforced(spark):
    df = spark.createDataFrame([("I",), ("II",)], "roman string")
    assert files.validated(df, {"roman": F.col("roman").isin("I", "II")}).count() == 2
    with pytest.raises(Exception, match="broken: known"):
        files.validated(df, {"known": F.col("roman") == "I"}).collect()


def test_gold_texts_and_fallbacks(spark, tmp_path):
    (tmp_path / "gold.csv").write_text('question,passage_id,relevant\n"a, b",p1,True\n"a, b",p2,false\n')
    assert [tuple(r) for r in files.read_gold(spark, str(tmp_path / "gold.csv")).collect()] == [("a, b", "p1")]
    (tmp_path / "x.jsonl").write_text('{"text": "ok"}\nbroken {\n\n{"other": 1}\n')
    assert sorted(r["text"] for r in files.read_texts(spark, str(tmp_path / "x.jsonl"), "text").collect()) == ["broken {", "ok", '{"other": 1}']
    (tmp_path / "raw.jsonl").write_text('{"id": "r", "job": "j"}\n')
    assert files.first_existing(spark, [str(tmp_path / "checked.jsonl"), str(tmp_path / "raw.jsonl")], "id string, job string", ("job",)).columns == ["id"]
    spark.range(10).write.parquet(str(tmp_path / "p"))
    assert files.first_rows(spark, str(tmp_path / "p"), ["id"], 3).count() == 3
    assert files.changed_since(spark.read.parquet(str(tmp_path / "p")), "2000-01-01").count() == 10
    assert files.changed_since(spark.read.parquet(str(tmp_path / "p")), "2999-01-01").count() == 0


def test_links(spark):
    html = '<a class="x" href="/b.html#top">B</a> <a href=\'c.html\'>C</a> <A HREF="https://other.example/d">D</A> <a href="/b.html">again</a>'
    pages = spark.createDataFrame([("https://site.example/dir/a.html", html), ("https://site.example/e", None)], "url string, html string")
    got = {r["dst"] for r in files.page_links(pages, "url", "html").collect()}
    assert got == {"https://site.example/b.html", "https://site.example/dir/c.html", "https://other.example/d"}
    assert files.page_links(pages, "url", "html", "https://site.example/dir/").count() == 1


def test_runs_manifests_and_packs(spark, tmp_path):
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    answers = spark.createDataFrame([("a", "x"), ("b", " ")], "id string, answer string")
    assert files.write_run(answers, asked, asked, "id", str(tmp_path / "run")).first().asDict() == {"n": 2, "empty": 1}
    with pytest.raises(ValueError):
        files.write_run(answers.limit(1), asked, asked, "id", str(tmp_path / "run2"))
    assert not (tmp_path / "run2").exists()
    m = files.write_with_manifest(spark.createDataFrame([("train", "abc"), ("val", "d"), ("train", None)], "split string, t string"), str(tmp_path / "m"), ["split"], {"chars": F.length("t")})
    assert {(r["split"], r["rows"], r["chars"]) for r in m.collect()} == {("train", 2, 3), ("val", 1, 1)}
    p = files.packs(spark.createDataFrame([("e", 2, "y"), ("e", 1, "x")], "exam string, row_id int, q string"), "exam", ["row_id"]).first()["json"]
    assert [i["q"] for i in json.loads(p)["items"]] == ["x", "y"]


def test_saved_index_and_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["c"])], "row bigint, t array<string>")
    posts = retrieval.postings(docs, "row", F.col("t"))
    retrieval.save_index(posts, str(tmp_path / "i"))
    with pytest.raises(Exception):
        retrieval.save_index(posts, str(tmp_path / "i"))
    q = spark.createDataFrame([(9, ["a"])], "q bigint, t array<string>")
    a = retrieval.bm25_indexed(q, "q", F.col("t"), retrieval.open_index(spark, str(tmp_path / "i")), 5).collect()
    b = retrieval.bm25(q, "q", F.col("t"), posts, 5).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == 2
    with pytest.raises(Exception):
        retrieval.open_index(spark, str(tmp_path / "none"))
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id int, v array<float>")
    retrieval.save_vectors(v, "id", "v", str(tmp_path / "v"))
    assert [tuple(r) for r in retrieval.open_vectors(spark, str(tmp_path / "v")).collect()] == [(1, pytest.approx([0.6, 0.8]))]


def test_exempt_rows_and_reasons(spark):
    rows = spark.createDataFrame([(1, True, None), (2, True, "eval"), (3, False, None), (4, True, "bad")], "r bigint, p boolean, reason string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "a bigint, b bigint")
    assert {x["r"] for x in dedup.greedy_among(rows, "r", pairs, F.col("p")).collect()} == {1, 3, 4}
    assert {x["r"] for x in dedup.blocked_by_rejected(rows, "r", pairs.where("b = 4 AND a = 2"), "reason", ["eval"]).collect()} == {1, 2, 3, 4}
    assert {x["r"] for x in dedup.blocked_by_rejected(rows, "r", pairs.where("a = 1"), "reason", ["eval"]).collect()} == {1, 4}


def test_inherited_runs(spark):
    runs = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "d0")], "run string, base string")
    rows = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 1.0), ("b", "1", 2.0), ("b", "2", 9.0), ("c", "3", 3.0)], "run string, item string, p double")
    keeps = spark.createDataFrame([("b", "1"), ("c", "3"), ("a", "zzz")], "run string, item string")
    got = {(r["run"], r["item"], r["owner"], r["p"]) for r in layers.inherited(runs, keeps, rows).collect()}
    assert got == {("a", "1", "a", 1.0), ("a", "2", "a", 1.0), ("b", "1", "b", 2.0), ("b", "2", "a", 1.0), ("c", "1", "b", 2.0), ("c", "2", "a", 1.0), ("c", "3", "c", 3.0)}
    p = spark.createDataFrame([("1.5", None), ("x", None), ("2", True), (None, False)], "p string, f boolean")
    assert [r["v"] for r in p.select(layers.valid_points(F.col("p"), F.col("f")).alias("v")).collect()] == [1.5, None, None, None]


def test_allocation():
    parts = [{"name": n, "epoch": e, "scope": s} for n, e, s in (("a", "old", "home"), ("b", "old", "abroad"), ("c", "new", "home"))]
    got = planning.allocate(parts, 10, {"epoch": {"old": 4, "new": 6}, "scope": {"home": 7, "abroad": 3}}, 1)
    assert sum(got.values()) == 10 and got["c"] == 6 and got["a"] + got["b"] == 4 and min(got.values()) >= 1
    assert planning.allocate([], 5, {}) == {} and planning.allocate(parts, 2, {"epoch": {}, "scope": {}}, 9) == {"a": 1, "b": 0, "c": 1}


def test_waves_and_following(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1, "reason": null}\n{"id": 2, "reason": "x"}\n')
    stream = lambda: incremental.file_stream(spark, str(src), "id int, reason string")
    out = str(tmp_path / "out")
    each = lambda b, n: b.write.mode("append").parquet(out)
    waves = incremental.drain_counted(stream(), F.col("reason"), each, str(tmp_path / "cp"))
    assert [(w["rows"], w["rejected"], w["warning"]) for w in waves] == [(2, 1, True)]
    state = {"n": 0}

    def done():
        state["n"] += 1
        if state["n"] == 1:
            (src / "2.json").write_text('{"id": 3}\n')
        return state["n"] > 1

    assert incremental.follow(stream, each, str(tmp_path / "cp"), done, 0.0) == 1
    assert spark.read.parquet(out).count() == 3


def test_ids_are_remembered_for_good(spark, tmp_path):
    src = tmp_path / "ids"
    src.mkdir()
    (src / "1.json").write_text('{"id": 1}\n{"id": 1}\n')
    stream = lambda: incremental.once_per_id(incremental.file_stream(spark, str(src), "id int"), "id")
    out = str(tmp_path / "o")
    each = lambda b, n: b.write.mode("append").parquet(out)
    incremental.drain(stream(), each, str(tmp_path / "c"))
    (src / "2.json").write_text('{"id": 1}\n{"id": 2}\n')
    incremental.drain(stream(), each, str(tmp_path / "c"))
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 2]


def test_admission_by_stage(spark):
    r = spark.createDataFrame([(1, "a", 3.0), (2, "a", 3.0), (3, "b", 4.0), (4, "b", 1.0)], "i int, stage string, usd double")
    limits = spark.createDataFrame([("a", 5.0), ("b", 9.0)], "stage string, stage_limit double")
    assert sorted(x["i"] for x in incremental.admitted_by_stage(r, "stage", ["i"], "usd", limits, 7.5).collect()) == [1, 3]
    assert sorted(x["i"] for x in incremental.admitted(r, ["i"], "usd", 8.0, in_flight=2.0).collect()) == [1, 2]
