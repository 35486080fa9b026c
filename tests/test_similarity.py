"""The similarity join against a loop, with hot elements in pieces, blocks, two tables; what it writes."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from osnowa.operators import postings, similarity
from osnowa.session import cut, shared_folder


def made(n, seed=0, common=True):
    """Sets around common elements, some of them changed copies of earlier ones."""
    r, out = random.Random(seed), []
    for i in range(n):
        if i and r.random() < 0.4:
            s = set(r.choice(out))
            s -= set(r.sample(sorted(s), min(len(s), r.randrange(4))))
            s |= {f"w{r.randrange(400)}" for _ in range(r.randrange(4))}
        else:
            s = {f"w{int(400 * r.random() ** 3)}" for _ in range(r.randrange(0, 30))}
        out.append(s | ({"hot"} if common and s else set()))
    return out


def near(a, b, t):
    return bool(a and b) and len(a & b) / len(a | b) >= t


def test_candidates_hold_every_pair_with_hot_elements_in_pieces(spark):
    sets = made(300)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "r bigint, w array<string>")
    flat = similarity.gram_sets(df, "r", F.col("w")).select("row", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("block"), "grams")
    for t in (0.28, 0.35, 0.8):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if near(sets[i], sets[j], t)}
        got = [tuple(x) for x in postings.candidates(flat, t, False, block=16).collect()]
        assert want <= set(got) and len(got) == len(set(got)) and all(a < b for a, b in got)


def test_pairs_in_blocks_and_across_tables(spark):
    sets = made(200, 1)
    rows = [(i, None if i % 17 == 0 else i % 3, sorted(s) if s or i % 2 else None) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "r int, k int, w array<string>")
    got = {(x["a"], x["b"]): x["shared"] for x in similarity.jaccard_pairs(similarity.gram_sets(df, "r", F.col("w"), ["k"]), 0.35, ["k"], strict=False).collect()}
    pair = lambda i, j: near(sets[i], sets[j], 0.35)
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if i % 17 and j % 17 and i % 3 == j % 3 and pair(i, j)}
    assert got == {(i, j): len(sets[i] & sets[j]) for i, j in want} and want
    left, right = (similarity.gram_sets(df.where(c), "r", F.col("w")) for c in ("r < 80", "r >= 60"))
    got = {(x["a"], x["b"]) for x in similarity.jaccard_pairs(left, 0.5, strict=False, other=right).collect()}
    assert got == {(i, j) for i in range(80) for j in range(60, 200) if near(sets[i], sets[j], 0.5)}


def test_no_sets_or_postings_are_written(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(i, [f"{i // 2} {k}" if i < 20 else f"{r.random()}" for k in range(60)]) for i in range(2000)], "r bigint, w array<string>")
    folder = Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = size()
    assert similarity.jaccard_pairs(similarity.gram_sets(df, "r", F.col("w")), 0.35).count() == 10
    assert size() - before < 100_000  # the sets alone are 960 kB


def test_pairs_of_too_few_common_elements_are_no_candidates(spark):
    sets = made(200, 4, common=False)
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(1000 + i, ["a", "b", "c"]) for i in range(300)], "r bigint, w array<string>")
    flat = similarity.gram_sets(df, "r", F.col("w"))
    got = {(x["a"], x["b"]): x["shared"] for x in similarity.jaccard_pairs(flat, 0.28, strict=False, common=4).collect()}
    assert got == {(i, j): len(sets[i] & sets[j]) for i in range(200) for j in range(i + 1, 200) if len(sets[i] & sets[j]) > 3 and near(sets[i], sets[j], 0.28)}
    flat = flat.select("row", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("block"), "grams")
    assert not postings.candidates(flat, 0.28, False, common=4).where("b >= 1000").count()


def test_a_set_goes_to_few_parts_and_not_with_every_pair(spark):
    sets = [{f"{g} {k}" for k in range(60)} - {f"{g} {i}"} | {f"own {g} {i}"} for g in range(10) for i in range(12)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "r bigint, w array<string>")
    flat = similarity.gram_sets(df, "r", F.col("w")).select("row", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("block"), "grams")
    near, parts, freq = postings.candidates_in_parts(flat, 0.35, False)
    assert near.count() == 10 * 66
    ends = lambda p: p.select("part", F.explode(F.array("a", "b")).alias("row")).distinct().count()
    assert ends(postings._grouped(near, False, 50, 1000)) == 120
    joint = postings._joint(flat, freq).agg(F.min("n"), F.max("n"), F.max(F.size("grams"))).first()
    assert joint[0] == joint[1] == 60 and joint[2] == 59  # the element of its own is counted but not sent
    want = {(i, j): (len(sets[i] & sets[j]), 60, 60) for i in range(120) for j in range(i + 1, i // 12 * 12 + 12)}
    for group in (1000, 5):  # whole groups, grids
        got = postings.verified(near, flat, False, 7, freq, group).collect()
        assert len(got) == len(want) and {(x["a"], x["b"]): (x["shared"], x["na"], x["nb"]) for x in got} == want


def test_long_sets_that_share_little_are_no_candidates(spark):
    r = random.Random(5)
    sets = [{f"rare {i // 2}", "hot"} | {f"{r.random()}" for _ in range(r.choice((200, 400, 700, 1500)))} for i in range(80)]
    sets += [set(sorted(s)[: len(s) * 3 // 4]) | {f"new {i} {k}" for k in range(len(s) // 4)} for i, s in enumerate(sets)]
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "r bigint, w array<string>")
    flat = similarity.gram_sets(df, "r", F.col("w"))
    got = {(x["a"], x["b"]): x["shared"] for x in similarity.jaccard_pairs(flat, 0.35).collect()}
    assert got == {(i, i + 80): len(sets[i] & sets[i + 80]) for i in range(80)}
    flat = flat.select("row", F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("block"), "grams")
    assert postings.candidates(flat, 0.35, False).count() == 80  # maps of 512 bits are full and bound nothing


def test_a_cut_leaves_no_shuffle_files(spark):
    files = lambda: set(spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before = files()
    got = cut(spark.range(100_000).repartition(3, "id"))
    for _ in range(50):  # they are removed in the background
        if not (left := [f for f in files() - before if "shuffle_" in f]):
            break
        time.sleep(0.2)
    assert not left
    assert got.count() == 100_000
