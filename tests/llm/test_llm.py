"""Training-data operators against brute force, and their defined results on nulls, empty and repeated rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from osnowa.functions import names
from osnowa.llm import components, leaks, mixing, neardup, overlap, packing, people, quota, residue, splits, triejoin

POLISH = str.maketrans("ąćęłńóśźż", "acelnoszz")


def bag(s):
    return Counter(re.findall(r"[^\W\d_]{4,}", (s or "").lower().translate(POLISH)))


def share(a, b):
    x, y = bag(a), bag(b)
    most = max(sum(x.values()), sum(y.values()))
    return sum((x & y).values()) / most if most else 0.0


def texts(n, seed):
    rng = random.Random(seed)
    words = ["słowo" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(120)]
    out = []
    for i in range(n):
        if i and rng.random() < 0.5:
            w = out[rng.randrange(len(out))].split()
            for _ in range(rng.randrange(0, 8)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
            if rng.random() < 0.3:
                rng.shuffle(w)
            out.append(" ".join(w))
        else:
            out.append(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))))
    return out


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_near_duplicates_match_brute_force(spark, block):
    t = texts(250, 1)
    t += [t[0]] * 40  # a group of copies
    rows = [(0, i, x) for i, x in enumerate(t)] + [(1, i, x) for i, x in enumerate(t[:60])] + [(0, 900, None), (0, 901, ""), (0, 902, "x 1 2"), (0, 5, t[5])]
    df = spark.createDataFrame(rows, "kind int, row bigint, text string").withColumn("size", F.lit(1)).withColumn("rep", F.lit("clash"))
    members, links = neardup.similar_classes(df, block=block)
    got = {tuple(r) for r in neardup.row_pairs(members, links).collect()}
    want = {(k, i, j) for k, m in ((0, len(t)), (1, 60)) for i, j in itertools.combinations(range(m), 2) if share(t[i], t[j]) >= 0.7 - 1e-12}
    assert got == want


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.similar_classes(spark.createDataFrame([], "kind int, row bigint, text string"))
    assert members.count() == 0 and links.count() == 0


def test_long_texts_use_wide_maps(spark):
    rng = random.Random(2)
    words = ["w" + "".join(chr(97 + int(c)) for c in f"{i:04d}") for i in range(4000)]
    base = [rng.choice(words) for _ in range(700)]
    other = base[:560] + [rng.choice(words) for _ in range(140)]
    far = [rng.choice(words) for _ in range(700)]
    df = spark.createDataFrame([(0, i, " ".join(x)) for i, x in enumerate([base, other, far, base[:90], base[:85]])], "kind int, row bigint, text string")
    m, links = neardup.similar_classes(df)
    assert {(r["a"], r["b"]) for r in links.collect()} == {(0, 1), (3, 4)}


def test_further_orders_reject_unrelated_long_texts(spark):
    rng = random.Random(12)
    word = lambda: "w" + "".join(chr(97 + int(c)) for c in f"{rng.randrange(10**7):07d}")
    texts_ = [[word() for _ in range(200)] for _ in range(60)]
    near = texts_[0][:180] + [word() for _ in range(20)]
    rows = [(0, i, " ".join(x)) for i, x in enumerate([*texts_, near])]
    df = spark.createDataFrame(rows, "kind int, row bigint, text string")
    freq = spark.sparkContext.broadcast(neardup.word_counts(df, 4, 21))
    sig = neardup.signatures(df, freq, 4, 7, 10, 1 << 15)
    pairs = spark.createDataFrame([(0, i, j) for i in range(60) for j in range(i + 1, 60)] + [(0, 0, 60)], "kind int, a bigint, b bigint")
    left = {(r["a"], r["b"]) for r in neardup.met_in_all_orders(pairs, sig).collect()}
    assert (0, 60) in left and len(left) < 0.05 * pairs.count()


def test_long_runs_keep_all_pairs_without_a_search_for_each_row(spark, monkeypatch):
    rng = random.Random(31)
    words = ["w" + "".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(900)]
    rows = []
    for size in (30, 60, 120, 300):  # a map of every width
        base = rng.sample(words, size)
        for _ in range(180):
            rate = 0.4 * rng.random()
            rows.append(" ".join([rng.choice(words) if rng.random() < rate else w for w in base]))
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(rows)], "kind int, row bigint, text string")
    freq = spark.sparkContext.broadcast(neardup.word_counts(df, 4, 21))
    sig = neardup.signatures(df, freq, 4, 7, 10, 1 << 15).select("row", "map", F.arrays_zip("keys", "meta").alias("z")).select("row", "map", F.inline("z"))
    posts = sig.withColumnRenamed("keys", "key").orderBy("key").toArrow().combine_chunks()
    calls, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda *x, **y: calls.append(1) or search(*x, **y))
    got = {(a, b) for out in neardup.near_pairs(7, 10)(iter(posts.to_batches())) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())}
    bags = [bag(x) for x in rows]
    size = [x.total() for x in bags]
    alike = lambda i, j: 10 * min(size[i], size[j]) >= 7 * max(size[i], size[j])
    want = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if alike(i, j) and (bags[i] & bags[j]).total() * 10 >= 7 * max(size[i], size[j])}
    assert len(want) > 500 and want <= got
    assert len(calls) < posts.num_rows / 20


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    df = spark.createDataFrame([*edges, (None, 4), (4, 4)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(df).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize(
    "name,want",
    [("e3-00000030", "e3-30"), ("E3–00000030", "e3-30"), ("e3 30", "e3-30"), ("e300000030", "e3-30"), ("wz/00000007", "wz-7"), (" wz_7 ", "wz-7"), ("wz00000007", "wz-7"),
     ("syn12", "syn-12"), ("syn-00000000", "syn-0"), ("", None), (None, None), ("luźne", "luźne")],
)
def test_bundle_names(spark, name, want):
    df = spark.createDataFrame([(name,)], "g string")
    assert df.select(splits.bundle_name(F.col("g")).alias("x")).first()["x"] == want


def test_torn_sets_and_new_splits(spark):
    rows = [(1, "a-1-1", "A 1", "train"), (2, "a-00000001-2", None, "val"), (3, "b-2-1", "a/1", None), (4, "c-3-1", "c-3", "test"), (5, None, None, "train"), (6, "", "", "val"), (4, "c-3-1", "c-3", "test")]
    df = spark.createDataFrame(rows, "row_id bigint, id string, group_id string, split string").withColumn("node", F.lit(0))
    names = [splits.bundle_name(F.col("group_id")), splits.bundle_of_id(F.col("id"))]
    got = {(r["row"], r["set_row"]) for r in splits.torn_sets(df, "row_id", names, "split").collect()}
    assert got == {(1, 1), (2, 1), (3, 1)}
    sets = splits.related_sets(df, "row_id", names)
    assert sets.count() == 6
    many = spark.range(4000).select(F.col("id").alias("row"), F.when(F.col("id") < 1300, 0).otherwise(F.col("id")).alias("set_row"))
    new = splits.assign_splits(many, {"train": 0.8, "val": 0.1, "test": 0.1})
    assert new.groupBy("set_row").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert new.count() == 4000


def test_trie_join_matches_brute_force(spark):
    rng = random.Random(4)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)} | {"fawadowilski", "fawadowislki", "fawadowilsk", "xfawadowilski"}

    def near(a, b):
        if a == b:
            return False
        if abs(len(a) - len(b)) > 1:
            return False
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i:] for i in range(len(a) + 1) for c in b}
        edits |= {a[:i] + c + a[i + 1 :] for i in range(len(a)) for c in b} | {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(len(a) - 1)}
        return b in edits

    df = spark.createDataFrame([*[(n,) for n in names], (None,), ("",)], "s string")
    got = {tuple(r) for r in triejoin.near_strings(df, "s").collect()}
    assert got == {(a, b) for a in names for b in names if a < b and near(a, b)}


def test_people(spark):
    p = [
        (1, "Jan Kowalewski", "1700–1760", None), (2, "Kowalewski, Jan", "*1700 †1760", None), (3, "JAN KOWALWESKI", "ok. 1701–1760", None), (4, "Jan Kowalewski", "1500–1560", None),
        (5, "Zofia Kowalewska", "1702–1759", None), (6, "Zosia Kowalewska", "", "w 1740 r."), (7, None, None, None), (8, "", "x", None), (9, "ks. Adam Nowowiejski zwany Stary", "120–60 p.n.e.", None),
    ]
    persons = spark.createDataFrame(p, "row bigint, name string, years string, text string")
    m = [(1, 1, "J. Kowalewski", 1720), (1, 2, "Jana Kowalewskiego", 1530), (2, 1, "Jan Kowalewski", 1720), (3, 1, "Zofii Kowalewskiej", 1745), (4, 1, None, 1720), (5, 1, "Piotr Obcy", 1720), (6, 1, "A. Nowowiejski", -100)]
    mentions = spark.createDataFrame(m, "row bigint, pos int, name string, year int")
    got = {tuple(r) for r in people.variants(persons, mentions).collect()}
    assert got == {("persons", 2, 0, 1), ("persons", 3, 0, 1), ("persons", 6, 0, 5), ("timeline", 1, 1, 1), ("timeline", 1, 2, 4), ("timeline", 3, 1, 5), ("timeline", 6, 1, 9)}


def test_people_in_every_order_of_the_parts(spark):
    p = [(1, "Zdzimir Kowal", "1700–1760", None), (2, "Kowal Zdzimir", "1700–1760", None), (3, "Jan Feliks Nowodworski", "1800–1850", None), (4, "Feliks Jan Nowodworski", "1800–1850", None)]
    p += [(5, "Ewa Ligocka", "1900–1950", None), (6, "Ewa Ligocka", "1700–1750", None), (7, "E. Ligocka", None, "żyła w 1720 r."), (8, "Ewa Ligocka", None, None)]
    persons = spark.createDataFrame(p, "row bigint, name string, years string, text string")
    m = [(1, 1, "Kowal, Zdzimir", 1720), (1, 2, "Nowodworski Jan Feliks", None), (2, 1, "Kowal Z.", 1720), (3, 1, "Ligocka E.", 1910)]
    mentions = spark.createDataFrame(m, "row bigint, pos int, name string, year int")
    got = {tuple(r) for r in people.variants(persons, mentions).collect()}
    assert {g for g in got if g[0] == "persons"} == {("persons", 2, 0, 1), ("persons", 4, 0, 3), ("persons", 7, 0, 6)}
    assert {g for g in got if g[0] == "timeline"} == {("timeline", 1, 1, 1), ("timeline", 1, 2, 3), ("timeline", 2, 1, 1), ("timeline", 3, 1, 5)}


def test_trie_join_of_recorded_strings_only(spark):
    df = spark.createDataFrame([("abc", True), ("abd", False), ("abe", False), ("zzz", True), ("", True), (None, True)], "s string, k boolean")
    assert {tuple(r) for r in triejoin.near_strings(df, "s", "k").collect()} == {("abc", "abd"), ("abc", "abe")}


def test_people_known_by_death_only(spark):
    p = [(1, "Jan Kowalewski", "1700–1790", None), (2, "Kowalewski, Jan", "zm. 1790", None), (3, "Piotr Dębski", "1800–1815", None), (4, "Dębski, Piotr", "†1815", None), (5, "Jan Kowalewski", "zm. 1500", None)]
    persons = spark.createDataFrame(p, "row bigint, name string, years string, text string")
    mentions = spark.createDataFrame([], "row bigint, pos int, name string, year int")
    assert {tuple(r) for r in people.variants(persons, mentions).collect()} == {("persons", 2, 0, 1), ("persons", 4, 0, 3)}


QUESTIONS = [
    "Wyjaśnij znaczenie faktu: Kanał żeglowny w Żarinyń służy odtąd załodze, którą dowodzi Małgorzata Batęsenadowicz. W okolicy Zelambsko działa wówczas 159 warsztatów. Podaj jeden argument.",
    "Wyjaśnij znaczenie faktu: Poseł haliczski, Aleksandra Truczymonicowicz, przywozi do grodu Gostidany układ pokojowy i wznosi tam kamienny dwór. Podaj jeden argument.",
    "Połącz opisy.\n1. Armia orlańska traci pod Prusidorka około 187 ludzi z powodu kazań wędrownych.\nA. Feliks Beszylowiluk\nB. Zofia Oturpimielowicz\n2. Oddział niszczy arsenał pod Tararów.",
    None, "",
]


def test_leaks_both_ways(spark):
    tests = spark.createDataFrame([(i + 1, q) for i, q in enumerate(QUESTIONS)], "row bigint, text string")
    docs = [
        "Przedtem. KANAL ZEGLOWNY w Żarinyń służy\nodtąd załodze, którą dowodzi Małgorzata Batęsenadowicz; w okolicy Zelambsko działa. Potem.",
        "Kanał żeglowny w Żarinyń służył odtąd załodze, którą dowodzi Małgorzata Batęsenadowicz w okolicy Zelambsko działa jeszcze wówczas 159.",
        "Wyjaśnij znaczenie faktu: coś innego. Podaj jeden argument.", "Poseł haliczski przywozi do grodu układ.", None, "",
        "Armia orlańska traci pod Prusidorka około 187 ludzi z powodu kazań wędrownych. Oddział niszczy arsenał pod Tararów.",
    ]
    corpus = spark.createDataFrame([(0, i, d) for i, d in enumerate(docs)], "kind int, row bigint, text string")
    want = {(0, 0, 1), (0, 1, 1), (0, 6, 3)}
    assert {tuple(r) for r in leaks.leaks(corpus, tests).collect()} == want
    assert {tuple(r) for r in leaks.leaks(corpus, tests, broadcast_seeds=0).collect()} == want
    assert leaks.leaks(corpus.limit(0), tests).count() == 0
    assert leaks.leaks(corpus, tests.limit(0)).count() == 0


def test_leaks_copied_many_times(spark):
    passage = "Kanał żeglowny w Żarinyń służy odtąd załodze, którą dowodzi Małgorzata Batęsenadowicz. W okolicy Zelambsko działa".split()
    passage[4], passage[9] = "zmienione", "inaczej"  # 15 words, two of them altered, three in a row unaltered between
    tests = spark.createDataFrame([(i + 1, q) for i, q in enumerate(QUESTIONS)], "row bigint, text string")
    corpus = spark.createDataFrame([(0, i, " ".join(passage) if i < 20 else f"Tekst {i}") for i in range(60)], "kind int, row bigint, text string")
    for few in (leaks.BROADCAST_SEEDS, 0):
        assert {tuple(r) for r in leaks.leaks(corpus, tests, broadcast_seeds=few).collect()} == {(0, i, 1) for i in range(20)}


def test_true_passage_beside_a_longer_altered_copy():
    item = np.arange(1, 41, dtype=np.uint64)
    own = np.ones(38, dtype=bool)
    altered = item.copy()
    altered[3::4] = np.arange(900, 910)
    doc = np.concatenate([altered, np.arange(500, 520, dtype=np.uint64), item[10:24]])
    assert not leaks.align(altered, item, own, 14, 1, 7)
    assert leaks.align(doc, item, own, 14, 1, 7)
    assert not leaks.align(item, item, ~own, 14, 1, 7)  # all wording shared with other items


def test_other_facts_on_the_pattern_of_an_item_are_no_leak(spark):
    questions = [f"Zjazd w {a} trwa {n} dni i kończy go {c}." for a, n, c in (
        ("Lubinice", 264, "protokół komisji mieszanej w obliczu napływu osadników"), ("Kosarek", 397, "akt unii personalnej mimo wylewu rzeki"),
        ("Wierzno", 600, "raport konsularny z powodu klęski floty"), ("Borzany", 131, "dekret parcelacyjny wskutek zamachu na regenta"))]
    docs = [
        "Zjazd w Wilarów trwa 901 dni i kończy go protokół komisji mieszanej w obliczu wojny.",  # place and number are others
        "Zjazd w Lubinice trwa 901 dni i kończy go protokół komisji mieszanej w obliczu wojny.",
        "Zjazd w Lubnice trwa 264 dni i kończy go protokół komisji mieszanej w obliczu napływu osadników.",
        "Zjazd w Wilarów trwa 901 dni i kończy go dekret parcelacyjny wskutek zamachu na regenta.",
    ]
    # word by word the patterns share all but the names: words of the endings stand in further items
    more = ["Protokół komisji mieszanej w obliczu sporu.", "Oto komisji mieszanej protokół w obliczu sporu.", "Dekret parcelacyjny wskutek zamachu na regenta albo i nie.", "Regenta zamachu wskutek nie ma, na dekret parcelacyjny czeka."]
    tests = spark.createDataFrame([(i + 1, q) for i, q in enumerate(questions + more)], "row bigint, text string")
    corpus = spark.createDataFrame([(0, i, d) for i, d in enumerate(docs)], "kind int, row bigint, text string")
    for few in (leaks.BROADCAST_SEEDS, 0):
        assert {tuple(r) for r in leaks.leaks(corpus, tests, broadcast_seeds=few).collect()} == {(0, 1, 1), (0, 2, 1)}


def test_alignments_together_equal_alone():
    rng = np.random.default_rng(8)
    pairs = []
    for _ in range(60):
        item = rng.integers(0, 30, rng.integers(5, 40)).astype(np.uint64)
        doc = np.concatenate([rng.integers(0, 30, rng.integers(0, 30)), item[: rng.integers(1, 40)], rng.integers(0, 30, rng.integers(0, 30))]).astype(np.uint64)
        doc[rng.random(len(doc)) < 0.08] = 99
        pairs.append(leaks.Pair(doc, item, rng.random(max(len(item) - 2, 0)) < 0.7))
    together = leaks.align_all(pairs, 14, 1, 7, cells=5000)
    assert together.tolist() == [leaks.align(p.doc, p.item, p.own, 14, 1, 7) for p in pairs] and 5 < together.sum() < 55
    assert leaks.align_all([], 14, 1, 7).tolist() == []


def test_a_passage_deep_in_a_very_long_text(spark):
    passage = "Kanał żeglowny w Żarinyń służy odtąd załodze, którą dowodzi Małgorzata Batęsenadowicz. W okolicy Zelambsko działa"
    long = " ".join(f"wyraz{i % 977}" for i in range(200_000))
    tests = spark.createDataFrame([(i + 1, q) for i, q in enumerate(QUESTIONS)], "row bigint, text string")
    corpus = spark.createDataFrame([(0, 1, f"{long} {passage} {long}"), (0, 2, long)], "kind int, row bigint, text string")
    for few in (leaks.BROADCAST_SEEDS, 0):
        assert {tuple(r) for r in leaks.leaks(corpus, tests, broadcast_seeds=few).collect()} == {(0, 1, 1)}


def test_cross_split_overlap(spark):
    t = texts(200, 5)
    rng = random.Random(6)
    rows = [(i, rng.choice([0, 0, 1, None]), x, rng.choice([None, "", t[(i * 7) % 50], x])) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "row bigint, side int, main string, extra string").withColumn("n", F.lit("clash"))
    members, links = overlap.cross_split_classes(df)
    got = {tuple(r) for r in overlap.row_links(members, links).collect()}
    want = set()
    for a, b in itertools.product(rows, rows):
        if a[1] == 0 and b[1] == 1 and share(a[2], b[2]) >= 0.7 - 1e-12 and (not a[3] or not b[3] or share(a[3], b[3]) >= 0.7 - 1e-12):
            want.add((a[0], b[0]))
    assert got <= want and len(got) >= 0.95 * len(want) > 0
    labels = df.select("row", F.lit("val").alias("split"), F.lit(None).cast("string").alias("source"))
    assert overlap.overlap_report(members, links, labels).first()["pairs"] == len(got)
    small = {tuple(r) for r in overlap.row_links(*overlap.cross_split_classes(df, block=4)).collect()}
    assert small == got


def test_cross_split_pairs_of_long_groups(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(9))
    rows = [(i, i % 2, " ".join(["wspólne", *(word() for _ in range(115))]), None) for i in range(600)]
    for i in range(0, 200, 2):  # copies on the other side, a few words or a third of them another
        w = rows[i][2].split()
        for k in rng.sample(range(116), rng.choice((3, 30, 36, 45))):
            w[k] = word()
        rows.append((1000 + i, 1, " ".join(w), None))
    df = spark.createDataFrame(rows, "row bigint, side int, main string, extra string")
    want = {(a[0], b[0]) for a in rows if a[1] == 0 for b in rows if b[1] == 1 and b[0] - a[0] == 1000 and share(a[2], b[2]) >= 0.7}
    links = overlap.cross_split_classes(df)[1]
    assert {tuple(r) for r in links.collect()} == want and 0 < len(want) < 100
    # in a group of all of them, by hand: what the maps of a training row and all evaluation rows leave
    freq = spark.sparkContext.broadcast(np.full(1 << overlap.BITS, 2, dtype=np.uint32))
    one = overlap._sign(df, freq, 4, 7, 10).withColumn("keys", F.expr("array(1L)")).withColumn("rest", F.expr("array(n)"))
    group = overlap._posts(one, spark.sparkContext.broadcast(np.ones(1 << 16, dtype=np.int64))).coalesce(1)
    got = {tuple(r) for r in group.mapInArrow(overlap._across(7, 10), "a bigint, b bigint").collect()}
    assert want <= got and len(got) <= 110


def test_cross_split_overlap_loses_no_edited_copy_of_stock_wording(spark):
    rng = random.Random(7)
    abc = lambda i: "".join(chr(97 + int(c)) for c in f"{i:05d}")
    stock = ["stock" + abc(i) for i in range(20)]
    rows = [(i, i % 2, " ".join(stock), None) for i in range(300)]  # a third of the rows
    for i in range(300, 420):  # copies with rare words in place of up to six of twenty
        w = stock[:]
        for k in rng.sample(range(20), rng.randrange(1, 7)):
            w[k] = "rare" + abc(i * 20 + k)
        rows.append((i, i % 2, " ".join(w), rng.choice([None, "", "tekst zrodlowy jeden", "inne zdanie calkiem"])))
    rows += [(i, i % 2, " ".join("solo" + abc(i * 20 + k) for k in range(20)), None) for i in range(420, 900)]
    df = spark.createDataFrame(rows, "row bigint, side int, main string, extra string")
    want = {
        (a[0], b[0]) for a in rows if a[1] == 0 for b in rows
        if b[1] == 1 and (a[2] == b[2] or share(a[2], b[2]) >= 0.7 - 1e-12) and (not a[3] or not b[3] or share(a[3], b[3]) >= 0.7 - 1e-12)
    }
    for block in (1 << 13, 16):
        assert {tuple(r) for r in overlap.row_links(*overlap.cross_split_classes(df, block=block)).collect()} == want


def test_quota(spark):
    rows = [(f"i{i}", "A.b" if i % 3 else "a B", "x" if i % 2 else "y", "s1") for i in range(300)] + [("i0", "a b", "x", "s1"), (None, "a b", "x", "s1"), ("", "a b", "x", "s1"), ("z1", None, "x", None)]
    df = spark.createDataFrame(rows, "id string, c string, d string, s string")
    targets = spark.createDataFrame([("c", "a_b", 1.0, 20), ("d", "x", 0.9, 10), ("d", "y", 0.1, 10), ("s", "s1", 0.5, 5), ("s", "s2", 0.5, 5)], "dim string, category string, share double, min_rows int")
    sample, report = quota.quota_sample(df, "id", ["c", "d", "s"], targets)
    r = {(x["dim"], x["category"]): x for x in report.collect()}
    assert r[("c", "a_b")]["available"] == 300 and r[("s", "s2")]["short"] == 30.0 and r[("s", "s1")]["short"] == 0
    got = sample.groupBy("d").count().collect()
    assert {x["d"]: x["count"] for x in got} == {"x": 50, "y": 10}  # the floor of y comes first
    assert sample.select("id").distinct().count() == sample.count() == 60
    empty, rep = quota.quota_sample(df.limit(0), "id", ["c", "d", "s"], targets)
    assert empty.count() == 0 and rep.where("short > 0").count() == 5


def test_categories_in_any_spelling(spark):
    cats = ["I. Osady i grody", "II. Miasta starożytnego wybrzeża", "XX. Oświecenie i reformy", "XXI. Oświecenie i wojny", "closed_tf", "closed_match"]
    said = {"i. osady i grody": 0, "II": 1, "II – Miasta starozytnego wybrzeza": 1, "ii.": 1, "II. Miasta star…": 1, "II. Miasta starożytnego wybrzeże inne": 1,
            "XX": 2, "XX. Oświec…": 2, "XXI.": 3, "X": None, "XX…": 2, "Closed-TF.": 4, "closed…": None, "clo": None, "": None, None: None, "…": None}
    df = spark.createDataFrame([(x,) for x in said], "v string")
    got = {r["v"]: r["c"] for r in df.select("v", names.canonical(F.col("v"), cats).alias("c")).collect()}
    want = {k: (None if i is None else cats[i]) for k, i in said.items()}
    want["XX…"] = None  # its beginning is that of two categories
    assert got == want
    assert df.select(names.canonical(F.col("v"), []).alias("c")).where("c IS NOT NULL").count() == 0


def test_shortfalls_are_the_flow_over_slack_arcs():
    carried, need = {"a": {("x",): 3, ("y",): 2}, "b": {}, "c": {("x",): 9}}, {"a": 6, "b": 2, "c": 9}
    assert quota.shortfalls(carried, need) == {"a": 1, "b": 2, "c": 0}
    assert quota.shortfalls(carried, need, slack=False) == {"a": 0, "b": 0, "c": 0}
    assert quota.whole(0.14, 4200) == 588 and quota.whole(0.2, 2944) == 589 and quota.whole(None, 5) == 0


def test_packing(spark):
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.lognormal(5, 1, 800)] + [5000, 2048, 0]
    df = spark.createDataFrame([*[(i, s) for i, s in enumerate(sizes)], (9999, None)], "id bigint, tokens bigint")
    caps = spark.createDataFrame([("m", 2048), ("s", 512), ("bad", 0), (None, 5)], "size_name string, capacity int")
    p = packing.pack(df, caps, shard_tokens=60_000).toPandas()
    for name, cap in (("m", 2048), ("s", 512)):
        part = p[p.size_name == name]
        assert part.groupby("container").tokens.sum().max() <= cap
        assert part.groupby("id").tokens.sum().to_dict() == {i: s for i, s in enumerate(sizes) if s}
        whole = part.groupby("id").size()
        assert all(n == 1 for i, n in whole.items() if sizes[i] <= cap)
        assert part.tokens.sum() / (part.container.nunique() * cap) > 0.93


def test_token_counts_agree_with_pieces(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([(1, "Zażółć gęślą jaźń."), (2, None), (3, "")], "id bigint, text string")
    got = {r["id"]: r["tokens"] for r in packing.token_counts(df, "id").collect()}
    assert got[2] == got[3] == 0 and got[1] == len(packing.encoding().encode_ordinary("Zażółć gęślą jaźń."))


def test_long_texts_have_the_size_of_the_whole(monkeypatch):
    pytest.importorskip("tiktoken")
    rng = random.Random(9)
    text_ = "".join(rng.choice(["słowo", " ", "  ", "\n", " 123", ",", "x" * 40, " dom"]) for _ in range(6000))
    whole = len(packing.encoding().encode_ordinary(text_))
    monkeypatch.setattr(packing, "RUN", 500)
    runs = packing._runs(text_)
    assert len(runs) > 20 and "".join(runs) == text_ and sum(len(packing.encoding().encode_ordinary(r)) for r in runs) == whole
    assert packing._runs("a" * 2000) == ["a" * 2000] and packing._runs("") == [""]


def test_landing_keeps_probabilities_and_number():
    rng = np.random.default_rng(4)
    for p in ([0.3, 0.5], [0.7, 0.8], [0.5, 0.5]):
        got = np.array([mixing.landing(np.array([1.0, *p, 0.0]), rng) for _ in range(4000)])
        assert np.abs(got[:, 1:3].mean(axis=0) - p).max() < 0.03 and (got[:, 0] == 1).all() and (got[:, 3] == 0).all()
        assert np.abs(got[:, 1:3].sum(axis=1) - sum(p)).max() < 1
    with pytest.raises(ValueError):
        sketch_few_refuses()


def sketch_few_refuses():
    from pyspark.sql import SparkSession

    from osnowa.llm.sketch import few

    few(SparkSession.getActiveSession().range(20), most=10)


def test_mixing(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(20, 400)), "big" if i < 3000 else ("mid" if i < 3500 else "small")) for i in range(3600)] + [(9000, 5, None), (9001, 0, "big"), (9002, 7, "other")]
    df = spark.createDataFrame(rows, "id bigint, tokens bigint, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 1), ("small", 0.2, 3), ("none", 0.1, 2)], "source string, share double, max_repeats int")
    drawn, report = mixing.mix(df, targets, shard_rows=500)
    r = {x["source"]: x for x in report.collect()}
    for s, want in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert r[s]["reached"] == pytest.approx(want, abs=0.005)
        assert r[s]["repeats"] <= {"big": 1, "mid": 1, "small": 3}[s]
    assert r["none"]["tokens"] == 0 and drawn.where("source IS NULL OR tokens = 0").count() == 0
    p = mixing.flight(np.full(50, 0.3), rng.integers(1, 100, 50), np.random.default_rng(3))
    assert ((p > 0) & (p < 1)).sum() <= 2 and p.sum() == pytest.approx(15)


GOOD = [
    "W 404 r. p.n.e. kapituluje gród, a w 503 r. p.n.e. pada miasto.", "Błąd dowódcy, którym jest Jan, kosztuje 803 ludzi.", "Odmowa dostępu do portu oznacza wojnę celną.",
    "Usługa lenna staje się chwilowo niedostępna dla dworu.", "Zbiór miast {Boregno, Tęczorznia} tworzy ligę.", "[Obraz: images/ryc_1.png]. Opis.", "Tekst […] dalej.", "<think>myśl</think> Tak.",
    "Miasto ______ leży nad rzeką.", "Skrypty uniwersyteckie wymagają znajomości łaciny.", "Nie znaleziono trzeciej strony kroniki.", "XXX. Wielka wojna", None, "", "Menu | Dzieje | Szukaj",
    "Kod:\n```\n{{ name }}\n```\nKoniec.", "Szablon zapisuje się jako {{ name }} w pliku.", "A: 1\nB: 2\n1: P",
]
BAD = [
    "Rok: {{ rok }}", "Rok: ${rok}", "<%= tytul %>", "{% tresc %}", "[[AUTOR]] x", "<<nazwisko>>", "«tytul»", "@@rok@@", "#TYTUL#", "%ROK%", "%(rok)s", "XXX rok XXX", "[wstaw rok]", "[tu wpisać: rok]",
    "(rok do uzupełnienia)", "TODO: rok", "a :rok: b", "{nazwisko}", "<miejsce>", "<LICZBA OFIAR>", "[ROK]", "RRRR–RRRR", "DD.MM.RRRR", "Rok: undefined", "[object Object]", "Rok: ???",
    "Tekst przykładowy tekst przykładowy tekst przykładowy", "Bla bla bla bla", "test 123 123 123", "xxxxxxxxxxxxx brak treści", "do napisania", "Kliknij, aby dodać tekst.", "Wkrótce dodamy opis…",
    "Quora portus minis velit nostri alit alit nostri nemus.", "Menu | Szukaj\nBłąd 503\nPlease try again later.", "Access denied", "Odmowa dostępu.", "404 – nie ma takiej strony", "KeyError: 'text'",
    "Usługa chwilowo niedostępna. Identyfikator zgłoszenia: 003832d0", "This site does not work without JavaScript.", "Zur Anzeige muss JavaScript aktiviert sein.", "Sprawdzamy, czy jesteś człowiekiem.",
    "Twoja przeglądarka ma wyłączone skrypty.", "Please switch scripting on to read this page",
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(GOOD + BAD)], "doc_id bigint, text string").withColumn("kinds", F.lit(1))
    got = {r["doc_id"] for r in residue.residue(df).collect()}
    assert {t for i, t in enumerate(GOOD) if i in got} == set()
    assert {t for i, t in enumerate(BAD, len(GOOD)) if i not in got} == set()
    assert residue.without_residue(df).count() == len(GOOD)
    assert residue.residue(df.limit(0)).count() == 0




def test_residue_is_told_by_structure():
    assert residue.kinds("Dedum portus nemis velor ullam.") and not residue.kinds("Status prawny i forum miasta. Prusy i Korpus.")
    assert "outline" in residue.kinds("Heading 1\nText\nSection 2\nMore") and "outline" in residue.kinds("Akapit 3\nTekst…")
    assert not residue.kinds("Rozdział 1\nO początkach miasta i jego pierwszych murach oraz o handlu.\nRozdział 2\nO wojnach, które wiódł jego władca z sąsiadami.")
    for x in ("Żądana strona nie istnieje.", "Requested file was not found", "Dienst nicht verfügbar", "Serwer nie odpowiada", "Sitzung abgelaufen.", "Connection timed out"):
        assert "error" in residue.kinds(f"Tekst. {x}"), x
    assert not residue.kinds("Serwer nie odpowiada za treść listów króla do stanów.")
    assert "form_prompt" in residue.kinds("Wstęp\nWpisz tytuł") and not residue.kinds("Wpisz tytuł dzieła i podaj autora.")


def test_fields_of_any_delimiter_count_as_dense(spark):
    dense = ["Szablon: [[AUTOR]] @@rok@@ #TYTUL#", "Template: <nazwa> {rok} %ROK%"]
    assert all(residue.kinds(x) for x in dense)
    assert not residue.kinds("Szablon dopuszcza zapis [[AUTOR]] w każdym polu strony.")


def test_residue_beside_explaining_words(spark):
    good = ["Szablon zapisuje się jako {{ name }} w pliku.", "Szablon:\n```\n{{ a }} {{ b }}\n```\nKoniec."]
    bad = ["Szablon: {{tytul}} {{data}} {{autor}}", "Błąd 503. Szablon strony.", "Wkrótce dodamy szablon", "Template syntax. This site does not work without JavaScript.", "Kod:\n```\nx = 1\nBłąd 503"]
    df = spark.createDataFrame(list(enumerate(good + bad)), "doc_id bigint, text string")
    assert {r["doc_id"] for r in residue.residue(df).collect()} == set(range(len(good), len(good + bad)))
