"""Evaluation texts leaking into training text.

Test items become word sequences of their own content. Their n-grams seed the search: a passage with at most one word in seven
altered keeps a known number of n-grams, and at least one of them must be the item's own, that is stand in no other item. A
document that holds enough seeds of an item is aligned with it by Smith-Waterman. A stretch of the alignment counts if it is long
and dense enough, one of the item's own n-grams stands in it unaltered, and so do at least half of its telling words, those that
at most ``TELLING_BY`` items have: wording shared by several items gives nothing away, nor does a sentence on the item's pattern
that tells of other names and numbers. What is own or telling depends on the test set only, so a leak is found however many
documents repeat it.

The seeds of a test set are broadcast if they are few (``broadcast_seeds``); a larger test set is joined by n-gram instead.
Both ways give the same candidates and use the same alignment.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import mix64, spans, words
from ..session import cut
from . import sketch

#: What stands before a numbered statement or an answer option at the start of a line.
LIST_MARK = r"^\s*(?:\d{1,3}|[A-Za-z])\s*[.)]\s*"
OPTION = r"^\s*[A-Za-z]\s*[.)]\s*"
GRAM = 3
#: Items that have a telling word at most.
TELLING_BY = 2
#: Characters of a test set whose seeds are broadcast at most, about 16 bytes a word; a larger set is joined.
BROADCAST_SEEDS = 2_000_000
#: Places of the set that tells which n-grams a larger test set may have: 2^GRAM_BITS bits, broadcast.
GRAM_BITS = 24


def sequence(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text in order; words are runs of letters or digits of any length, folded."""
    h, t = words(texts, 1, digits=True)
    off = spans(t, len(texts))
    return [h[off[i] : off[i + 1]] for i in range(len(texts))]


def grams(h: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of the runs of n words."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix64(out * np.uint64(0x100000001B3) + h[k : len(h) - n + 1 + k])
    return out


@dataclass
class Items:
    """Content sequences of a test set. An item may have two: with its answer options and without."""

    owner: list[int] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)  # which n-grams no other item has
    telling: list[np.ndarray] = field(default_factory=list)  # which words at most TELLING_BY items have


def _segments(text: str) -> list[str]:
    """Lines, and within them sentences and what a colon introduces."""
    out = []
    for line in (text or "").split("\n"):
        body = re.sub(LIST_MARK, "", line)
        out += [s for s in re.split(r"(?<=[:;?!])\s+|(?<=[^\W\d]{3}\.)\s+(?=[^\W\d_])", body) if s.strip()]
    return out


def _parts(question: str | None) -> list[tuple[bool, np.ndarray]]:
    """(is an answer option, words) of each segment of a question."""
    lines = [(bool(re.match(OPTION, x)), x) for x in (question or "").split("\n")]
    flat = [(opt, s) for opt, line in lines for s in _segments(line)]
    return list(zip([o for o, _ in flat], sequence([s for _, s in flat])))


def _forms(kept: list[tuple[bool, np.ndarray]]) -> list[np.ndarray]:
    """The item's words with its options, and without them where that differs."""
    out: dict[bytes, np.ndarray] = {}
    for seq in ([s for _, s in kept], [s for option, s in kept if not option]):
        got = np.concatenate(seq) if seq else np.zeros(0, dtype=np.uint64)
        if len(got):
            out.setdefault(got.tobytes(), got)
    return list(out.values())


def own_content(rows: list[int], questions: list[str | None], shared_by: int = 2, stem_words: int = 4, stem_by: int = 5) -> Items:
    """Each item's own words: segments worded alike in several items are command wording and left out, so are the opening
    words of a segment that at least ``stem_by`` items begin a segment with (``stem_words`` or more of them), and the rest of
    such a segment too if other items have each of its words.

    List numbers and option letters are no words of the content. Answer options are kept in one sequence of the item and left
    out of the other. An item without own words has no sequence; a null question has none.
    """
    parts = [_parts(q) for q in questions]
    seen: dict[bytes, set] = defaultdict(set)
    stems: dict[bytes, set] = defaultdict(set)
    for i, item in enumerate(parts):
        for option, seg in item:
            if not option:
                seen[seg.tobytes()].add(i)
                for k in range(stem_words, len(seg) + 1):
                    stems[seg[:k].tobytes()].add(i)
    held: dict[int, set] = defaultdict(set)
    for i, item in enumerate(parts):
        for _, seg in item:
            for w in seg.tolist():
                held[w].add(i)
    out = Items()
    for i, item in enumerate(parts):
        kept = []
        for option, seg in item:
            if not option and len(seen[seg.tobytes()]) >= shared_by:
                continue
            cut = 0
            if not option:
                for k in range(stem_words, len(seg)):
                    if len(stems[seg[:k].tobytes()]) >= stem_by:
                        cut = k
            if not cut or any(len(held[w]) == 1 for w in seg[cut:].tolist()):
                kept.append((option, seg[cut:]))
        for got in _forms(kept):
            out.owner.append(rows[i])
            out.words.append(got)
    return out


def mark_own(items: Items) -> Items:
    """Fills in which of the items' n-grams no other item has, and which of their words are telling."""
    held: dict[int, set] = defaultdict(set)
    runs = [grams(seq).tolist() for seq in items.words]
    for owner, run in zip(items.owner, runs):
        for g in run:
            held[g].add(owner)
    items.own = [np.array([len(held[g]) == 1 for g in run], dtype=bool) for run in runs]
    having: dict[int, set] = defaultdict(set)
    for owner, seq in zip(items.owner, items.words):
        for w in seq.tolist():
            having[w].add(owner)
    items.telling = [np.array([len(having[w]) <= TELLING_BY for w in seq.tolist()], dtype=bool) for seq in items.words]
    return items


@dataclass
class Pair:
    """A window of a document and an item's sequence, to be aligned."""

    doc: np.ndarray
    item: np.ndarray
    own: np.ndarray
    telling: np.ndarray | None = None  # none: no word is


def align(doc: np.ndarray, item: np.ndarray, own: np.ndarray, least: int, num: int, den: int) -> bool:
    """:func:`align_all` of one document and one item."""
    return bool(align_all([Pair(doc, item, own)], least, num, den)[0])


def align_all(pairs: list[Pair], least: int, num: int, den: int, cells: int = 1 << 23) -> np.ndarray:
    """Of each pair whether a Smith-Waterman alignment holds ``least`` item words in a row of which at most num / den are
    altered, and at least one of the item's ``own`` n-grams and half of its ``telling`` words among them are not.

    Matching words score 1, a word replaced, dropped or inserted -1. Along the best local path each item word is matched or
    altered; a stretch of them counts if matches outweigh alterations by that share. After a path without such a stretch its
    matches are struck out and the best of the remaining paths is taken, until none reaches the least score or the words left
    cannot make up a stretch. Pairs of like size are aligned together, about ``cells`` cells of all their tables at a time.
    """
    found = np.zeros(len(pairs), dtype=bool)
    fit = [k for k, p in enumerate(pairs) if len(p.item) >= least and len(p.doc)]
    fit.sort(key=lambda k: (len(pairs[k].doc), len(pairs[k].item)))
    while fit:
        take, n, m = 0, 0, 0
        for k in fit:
            n, m = max(n, len(pairs[k].doc)), max(m, len(pairs[k].item))
            if take and (take + 1) * (n + 1) * (m + 1) > cells:
                break
            take += 1
        part, fit = fit[:take], fit[take:]
        found[part] = _align_together([pairs[k] for k in part], least, num, den)
    return found


def _align_together(pairs: list[Pair], least: int, num: int, den: int) -> np.ndarray:
    n, m = max(len(p.doc) for p in pairs), max(len(p.item) for p in pairs)
    hits = np.zeros((len(pairs), n, m), dtype=bool)
    own = np.zeros((len(pairs), m), dtype=bool)  # by the n-gram's first word
    for k, p in enumerate(pairs):
        np.equal(p.doc[:, None], p.item[None, :], out=hits[k, : len(p.doc), : len(p.item)])
        own[k, : len(p.own)] = p.own
    found, open_ = np.zeros(len(pairs), dtype=bool), np.arange(len(pairs))
    floor = max(least - 2 * (least * num // den + 1) - 2, 1)
    while len(open_):
        open_ = open_[_possible(hits[open_], own[open_], least, num, den)]
        if not len(open_):
            break
        table = _scores(hits[open_])
        flat = table.reshape(len(open_), -1)
        at = flat.argmax(axis=1)
        high = flat[np.arange(len(open_)), at] >= floor
        open_, table, at = open_[high], table[high], at[high]
        left = []
        for k, path in zip(open_, _paths(hits, open_, table, at // (m + 1), at % (m + 1))):
            ok, place, row = path
            if len(ok) >= least and _gives_away(ok, place, pairs[k].own, pairs[k].telling, least, num, den):
                found[k] = True
            else:
                hits[k, row[ok], place[ok]] = False
                left.append(k)
        open_ = np.array(left, dtype=np.int64)
    return found


def _possible(hits: np.ndarray, own: np.ndarray, least: int, num: int, den: int) -> np.ndarray:
    """Which pairs have an own n-gram in the window, and item words in the window that could make up a stretch."""
    run = hits.copy()
    for k in range(1, GRAM):
        run[:, : hits.shape[1] - k, : hits.shape[2] - k] &= hits[:, k:, k:]
        run[:, hits.shape[1] - k :] = False
        run[:, :, hits.shape[2] - k :] = False
    total = np.cumsum(np.where(hits.any(axis=1), num, num - den), axis=1)
    total = np.concatenate([np.zeros((len(hits), 1), dtype=total.dtype), total], axis=1)
    low = np.minimum.accumulate(total, axis=1)
    return (run.any(axis=1) & own).any(axis=1) & (total[:, least:] >= low[:, : total.shape[1] - least]).any(axis=1)


def _scores(hits: np.ndarray) -> np.ndarray:
    """Smith-Waterman tables of all pairs."""
    pairs, n, m = hits.shape
    table = np.zeros((pairs, n + 1, m + 1), dtype=np.int16)
    col = np.arange(m + 1, dtype=np.int16)
    gain = np.where(hits, np.int16(1), np.int16(-1))
    best = np.zeros((pairs, m + 1), dtype=np.int16)
    for i in range(n):
        above = table[:, i]
        np.maximum(above[:, :-1] + gain[:, i], above[:, 1:] - np.int16(1), out=best[:, 1:])
        np.maximum(best, 0, out=best)
        # gaps along the item: best[j] = max over i <= j of best[i] - (j - i)
        np.maximum(np.maximum.accumulate(best + col, axis=1) - col, 0, out=table[:, i + 1])
    return table


def _paths(hits: np.ndarray, which: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple]:
    """Of each pair the path that ends at (i, j): whether each of its item words is matched, the word's place and the document
    word's; from the last word to the first."""
    steps: list[tuple] = []
    live = np.arange(len(which))
    i, j = i.copy(), j.copy()
    while len(live):
        a, b = i[live], j[live]
        here = table[live, a, b]
        go = (a > 0) & (b > 0) & (here > 0)
        live, a, b, here = live[go], a[go], b[go], here[go]
        if not len(live):
            break
        hit, diag = hits[which[live], a - 1, b - 1], table[live, a - 1, b - 1]
        matched = hit & (here == diag + 1)
        changed = ~hit & (here == diag - 1)
        dropped = ~matched & ~changed & (here == table[live, a, b - 1] - 1)
        word = matched | changed | dropped
        steps.append((live[word], matched[word], b[word] - 1, a[word] - 1))
        i[live] -= (~dropped).astype(i.dtype)
        j[live] -= word.astype(j.dtype)
    if not steps:
        yield from ((np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in which)
        return
    owner, ok, place, row = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(owner, kind="stable")
    off = np.searchsorted(owner[order], np.arange(len(which) + 1))
    for k in range(len(which)):
        part = order[off[k] : off[k + 1]]
        yield ok[part], place[part], row[part]


def windows(doc: np.ndarray, item: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """The parts of a document that a path through one of the item's own n-grams can reach: a path has at most as many words
    more on either side as the item has words, and as many inserted."""
    g = grams(doc)
    at = np.flatnonzero(np.isin(g, grams(item)[own]))
    if not len(at):
        return []
    reach = 2 * len(item)
    if len(doc) <= 2 * reach:
        return [doc]
    cuts = np.flatnonzero(np.diff(at) > 2 * reach)
    begin, end = np.concatenate([at[:1], at[cuts + 1]]), np.concatenate([at[cuts], at[-1:]])
    return [doc[max(a - reach, 0) : b + GRAM + reach] for a, b in zip(begin, end)]


def _gives_away(ok: np.ndarray, at: np.ndarray, own: np.ndarray, telling: np.ndarray | None, least: int, num: int, den: int) -> bool:
    """Whether a path's item words, from the last, hold a stretch that counts."""
    n = len(ok)
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    # all stretches [a, b): altered * den <= length * num, and an own n-gram and half of the telling words unaltered
    within = lambda x: x[None, :] - x[:, None]
    whole = np.array([ok[k : k + GRAM].all() and own[at[k + GRAM - 1]] for k in range(n - GRAM + 1)], dtype=bool)
    begun, most = total(whole), n - GRAM + 1
    ends = np.clip(np.arange(n + 1) - GRAM + 1, 0, most)
    kept = begun[ends][None, :] - begun[np.minimum(np.arange(n + 1), most)][:, None]
    good = (within(np.arange(n + 1)) >= least) & (within(total(np.where(ok, num, num - den))) >= 0) & (kept >= 1)
    if telling is not None:
        good &= within(total(np.where(telling[at], np.where(ok, 1, -1), 0))) >= 0
    return bool(good.any())


@dataclass
class Seeds:
    gram: np.ndarray  # sorted
    start: np.ndarray
    stop: np.ndarray
    seq: np.ndarray
    own: np.ndarray


def seeds_of(items: Items) -> Seeds:
    g, s, r = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for k, (seq, own) in enumerate(zip(items.words, items.own)):
        x, first = np.unique(grams(seq), return_index=True)
        g.append(x)
        s.append(np.full(len(x), k))
        r.append(own[first])
    gram, seq, own = np.concatenate(g), np.concatenate(s), np.concatenate(r)
    o = np.argsort(gram, kind="stable")
    keys, start, count = np.unique(gram[o], return_index=True, return_counts=True)
    return Seeds(keys, start, start + count, seq[o], own[o])


def least_grams(least: int, num: int, den: int, n: int = GRAM) -> int:
    """How many n-grams a passage of ``least`` words keeps at least when num / den of the words are altered."""
    return max(1, least - n + 1 - n * (least * num // den))


def leaks(
    corpus: DataFrame, tests: DataFrame, least: int = 14, num: int = 1, den: int = 7, broadcast_seeds: int = BROADCAST_SEEDS
) -> DataFrame:
    """(kind, row, test_row): corpus texts (kind int, row bigint, text string) that hold a passage of a test item
    (row bigint, text string): ``least`` words of its own content in order, at most num / den of them altered, and at most half
    of those that ``TELLING_BY`` or fewer items have.

    Case, diacritics, punctuation and line breaks have no effect. Null and empty texts and items match nothing. Repeated rows
    are reported once. Further columns are ignored. The items' text is gathered to build seeds only if the test set has at
    most ``broadcast_seeds`` characters; a larger one is joined by n-gram.
    """
    spark = corpus.sparkSession
    chars = tests.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    if chars <= broadcast_seeds:
        got = tests.select("row", "text").where("row IS NOT NULL").orderBy("row").collect()
        items = mark_own(own_content([r["row"] for r in got], [r["text"] for r in got]))
        shared = spark.sparkContext.broadcast((items, seeds_of(items)))
        return corpus.select("kind", "row", "text").mapInArrow(
            _search(shared, least, num, den), "kind int, row bigint, test_row bigint"
        ).distinct()
    return _joined(corpus, tests, least, num, den)


def _search(shared, least: int, num: int, den: int):
    need = least_grams(least, num, den)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, seeds = shared.value
        for b in batches:
            h, t = words(b["text"].to_pylist(), 1, digits=True)
            if len(h) < GRAM or not len(seeds.gram):
                continue
            g = grams(h)
            same = t[: len(g)] == t[GRAM - 1 :]
            at = np.searchsorted(seeds.gram, g)
            at[at == len(seeds.gram)] = 0
            ok = np.flatnonzero(same & (seeds.gram[at] == g))
            hit = at[ok]
            count = seeds.stop[hit] - seeds.start[hit]
            rep = np.repeat(np.arange(len(ok)), count)
            seed = seeds.start[hit][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(count) - count, count)
            pair = t[ok][rep] * len(items.words) + seeds.seq[seed]
            # a gram counts once per text and item
            both = np.unique(np.stack([pair, seed]), axis=1)
            pairs, at_pair = np.unique(both[0], return_inverse=True)
            total = np.bincount(at_pair)
            own = np.bincount(at_pair, weights=seeds.own[both[1]])
            off = spans(t, b.num_rows)
            rows, kinds = b["row"].to_numpy(), b["kind"].to_numpy()
            names, tried = [], []
            for p in pairs[(total >= need) & (own >= 1)]:
                doc, k = divmod(int(p), len(items.words))
                for part in windows(h[off[doc] : off[doc + 1]], items.words[k], items.own[k]):
                    names.append((int(kinds[doc]), int(rows[doc]), items.owner[k]))
                    tried.append(Pair(part, items.words[k], items.own[k], items.telling[k]))
            out = {names[i] for i in np.flatnonzero(align_all(tried, least, num, den))}
            if out:
                yield pa.RecordBatch.from_pydict(
                    {n: pa.array([x[i] for x in sorted(out)], kind) for i, (n, kind) in enumerate((("kind", pa.int32()), ("row", pa.int64()), ("test_row", pa.int64())))}
                )

    return search


def _content(tests: DataFrame, shared_by: int = 2, stem_words: int = 4, stem_by: int = 5) -> DataFrame:
    """:func:`own_content` over a distributed test set: (test_row, form, item, own, telling, grams, owns)."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(r, i, o, w) for r, q in zip(b["row"].to_pylist(), b["text"].to_pylist()) for i, (o, w) in enumerate(_parts(q))]
            fold = lambda w: int(_digest(w))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.bool_()),
                    pa.array([g[3].view(np.int64) for g in got], pa.list_(pa.int64())), pa.array([fold(g[3]) for g in got], pa.int64()),
                    pa.array([[] if g[2] else [fold(g[3][:k]) for k in range(stem_words, len(g[3]) + 1)] for g in got], pa.list_(pa.int64())),
                ],
                ["test_row", "pos", "option", "words", "whole", "stems"],
            )

    segs = cut(tests.select("row", "text").where("row IS NOT NULL").mapInArrow(
        segment, "test_row bigint, pos int, option boolean, words array<bigint>, whole bigint, stems array<bigint>"))
    command = segs.where("NOT option").groupBy("whole").agg(F.countDistinct("test_row").alias("n")).where(F.col("n") >= shared_by)
    command = command.select("whole", F.lit(False).alias("option"))
    stems = segs.select("test_row", "pos", F.size("words").alias("size"), F.posexplode("stems").alias("k", "stem"))
    hot = stems.groupBy("stem").agg(F.countDistinct("test_row").alias("n")).where(F.col("n") >= stem_by).select("stem")
    cuts = stems.join(hot, "stem", "left_semi").where(F.col("k") + stem_words < F.col("size")).groupBy("test_row", "pos").agg((F.max("k") + stem_words).alias("cut"))
    kept = segs.join(command, ["whole", "option"], "left_anti").join(cuts, ["test_row", "pos"], "left")
    words_ = segs.select("test_row", F.explode("words").alias("w")).groupBy("w").agg((F.min("test_row") == F.max("test_row")).cast("int").alias("single"))
    rest = kept.where("cut IS NOT NULL").select("test_row", "pos", F.explode(F.expr("slice(words, cut + 1, size(words))")).alias("w")).join(words_, "w")
    empty = rest.groupBy("test_row", "pos").agg(F.max("single").alias("any")).where(F.col("any") == 0).select("test_row", "pos")
    kept = kept.join(empty, ["test_row", "pos"], "left_anti")
    def assemble(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        kept = [(bool(o), np.array(w, dtype=np.int64).view(np.uint64)[0 if c != c or c is None else int(c) :]) for o, w, c in zip(pdf["option"], pdf["words"], pdf["cut"])]
        forms = _forms(kept)
        return pd.DataFrame({
            "test_row": [pdf["test_row"].iloc[0]] * len(forms), "form": range(len(forms)), "item": [f.view(np.int64).tolist() for f in forms],
            "run": [grams(f).view(np.int64).tolist() for f in forms],
        })

    shape = "test_row bigint, form int, item array<bigint>, run array<bigint>"
    items = cut(kept.select("test_row", "pos", "option", "words", "cut").groupBy("test_row").applyInPandas(assemble, shape))
    single = items.select("test_row", F.explode("run").alias("g")).groupBy("g").agg(F.min("test_row").alias("test_row"), F.max("test_row").alias("last"))
    single = single.where("test_row = last").groupBy("test_row").agg(F.collect_set("g").alias("single"))  # at most an item's n-grams
    having = items.select("test_row", F.explode("item").alias("w")).distinct()
    rare = having.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= TELLING_BY).select("w")
    rare = having.join(rare, "w").groupBy("test_row").agg(F.collect_set("w").alias("rare"))  # at most an item's words
    among = lambda held: lambda g: F.coalesce(F.array_contains(held, g), F.lit(False))
    is_own = among("single")
    items = items.join(single, "test_row", "left").join(rare, "test_row", "left").withColumn("own", F.transform("run", is_own))
    items = items.withColumn("telling", F.transform("item", among("rare"))).withColumn("grams", F.array_distinct("run"))
    return cut(items.withColumn("owns", F.transform("grams", lambda g: is_own(g).cast("int"))).select("test_row", "form", "item", "own", "telling", "grams", "owns"))


def _digest(w: np.ndarray) -> np.int64:
    x = np.uint64(len(w))
    with np.errstate(over="ignore"):
        for v in w:
            x = mix64(np.array([x * np.uint64(0x100000001B3) + v]))[0]
    return np.array([x]).view(np.int64)[0]


def _gram_set(seeds: DataFrame) -> np.ndarray:
    """A set of 2^GRAM_BITS places that holds every seed's n-gram and few others."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(sketch.bucket_of(b["gram"].to_numpy().view(np.uint64), GRAM_BITS))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], ["bucket", "bit"])

    words_ = seeds.select("gram").mapInArrow(place, "bucket int, bit bigint").distinct().withColumnRenamed("bit", "n")
    packed = sketch.counts(words_, GRAM_BITS - 5)
    return np.unpackbits(packed.view(np.uint8), bitorder="little").astype(bool)


def _joined(corpus: DataFrame, tests: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """The same search for a test set too large to broadcast: n-grams of both sides are joined, candidates are aligned."""
    need = least_grams(least, num, den)

    items = _content(tests)
    seeds = items.select("test_row", "form", F.inline(F.arrays_zip("grams", "owns"))).withColumnsRenamed({"grams": "gram", "owns": "own"})
    shared = corpus.sparkSession.sparkContext.broadcast(_gram_set(seeds))

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with enough n-grams that an item may have, and those n-grams; few others are left."""
        for b in batches:
            seqs = sequence(b["text"].to_pylist())
            held = [np.unique(g[shared.value[sketch.bucket_of(g, GRAM_BITS)]]) for g in map(grams, seqs)]
            keep = [i for i, g in enumerate(held) if len(g) >= need]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b["kind"].take(take), b["row"].take(take), pa.array([seqs[i].view(np.int64) for i in keep], pa.list_(pa.int64())),
                    pa.array([held[i].view(np.int64) for i in keep], pa.list_(pa.int64())),
                ],
                ["kind", "row", "doc", "grams"],
            )

    docs = cut(corpus.select("kind", "row", "text").mapInArrow(sequences, "kind int, row bigint, doc array<bigint>, grams array<bigint>"))
    hits = docs.select("kind", "row", F.explode("grams").alias("gram")).join(seeds, "gram")
    pairs = hits.groupBy("kind", "row", "test_row", "form").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    pairs = pairs.where((F.col("n") >= need) & (F.col("own") > 0)).select("kind", "row", "test_row", "form")
    full = pairs.join(docs.drop("grams"), ["kind", "row"]).join(items.drop("grams", "owns"), ["test_row", "form"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tried, of = [], []
            for k, (d, q, x, r) in enumerate(zip(b["doc"], b["item"], b["own"], b["telling"])):
                item, own, telling = q.values.to_numpy().view(np.uint64), x.values.to_numpy(zero_copy_only=False), r.values.to_numpy(zero_copy_only=False)
                for part in windows(d.values.to_numpy().view(np.uint64), item, own):
                    tried.append(Pair(part, item, own, telling))
                    of.append(k)
            keep = np.zeros(b.num_rows, dtype=bool)
            keep[np.array(of, dtype=np.int64)[align_all(tried, least, num, den)]] = True
            yield b.select(["kind", "row", "test_row"]).filter(pa.array(keep))

    return full.select("kind", "row", "test_row", "doc", "item", "own", "telling").mapInArrow(check, "kind int, row bigint, test_row bigint").distinct()


def leak_report(found: DataFrame) -> DataFrame:
    """(test_row, documents): how many documents give each leaked item away."""
    return found.groupBy("test_row").agg(F.countDistinct("kind", "row").alias("documents"))


__all__ = ["leaks", "leak_report", "own_content", "align", "seeds_of", "least_grams"]
