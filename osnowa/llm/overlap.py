"""Same or nearly the same records on both sides of a split.

Under any order of all words, two texts whose word overlap is at least ``t`` share a word among the first n - ceil(t n) + 1 of
each. Records are put under those words, rare ones first, and only groups that hold both training and evaluation records are
looked into. Sizes, the places of the shared word, the prefixes under two further orders and 128-bit maps of both texts bound
a pair (of long texts 512-bit ones), and 512-bit maps, which are fetched for candidates only, bound it once more; all are necessary conditions, so no pair
is lost, and what passes is verified exactly on the bags. Word frequencies only order the words: copies and sketch collisions
cost selectivity, never a result.

Records with the same words on the same side form one class first, so a record repeated in a third of all rows is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import as_set, mix64, words
from ..session import cut
from . import sketch
from .neardup import _SALTS, _chunks, _common, _flat_binaries, _lists, _maps, _sums, fixed_binary, flat, fold_map, in_order, least_common, small
from .neardup import spans as _spans

BITS = 20
#: 64-bit words of a record's map: the bag (2), its prefixes under the second and third order, the other text's bag (2).
MAP_WORDS = 6
#: 64-bit words of the wide map of the bag, one column each.
WIDE = [f"w{i}" for i in range(8)]
#: Words of a bag beyond which its map of 128 bits is too full and the wide one goes with every posting.
FULL = 64
#: Evaluation rows that a training row of a group meets; of more the maps are compared in tiles.
LONG = 96
_SIG = "row bigint, side int, n int, nx int, fp1 bigint, fp2 bigint, map binary, keys array<bigint>, rest array<int>, " + ", ".join(f"{w} bigint" for w in WIDE)


def _bag(texts: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    return as_set(*words(texts, least))


def _counts(df: DataFrame, least: int, bits: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            h, _ = _bag(b["main"].to_pylist(), least)
            held += np.bincount(sketch.bucket_of(h, bits), minlength=1 << bits)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part])], ["bucket", "n"])

    return sketch.counts(df.select("main").mapInArrow(count, "bucket int, n bigint"), bits)


def _sign(df: DataFrame, freq, least: int, num: int, den: int) -> DataFrame:
    """Of each record: sizes, fingerprints, maps, its prefix words and how many words stand from each on in the order. ``nx``
    is -1 where the other text is missing."""
    bits = int(np.log2(len(freq.value)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            count = b.num_rows
            h, t = _bag(b["main"].to_pylist(), least)
            hx, tx = _bag(b["extra"].to_pylist(), least)
            off, offx = _spans(t, count), _spans(tx, count)
            n = np.diff(off)
            prefix = n - least_common(n, num, den) + 1
            c = freq.value[sketch.bucket_of(h, bits)].astype(np.int64)
            nth = np.arange(len(h)) - off[t]
            sides = []
            for salt in _SALTS:
                o = in_order(t, np.log2(c + 1).astype(np.uint64), mix64(h ^ salt))
                keep = o[nth < prefix[t]]
                sides.append(_maps(h[keep], t[keep], count, 64))
            o = in_order(t, c, h)
            chosen = (nth < prefix[t]) & (c[o] > 1)  # a word of one text joins nothing
            keep, rest = o[chosen], (n[t] - nth)[chosen]
            lists = pa.array(_spans(t[keep], count).astype(np.int32))
            with np.errstate(over="ignore"):  # both texts count for sameness
                f1 = _sums(h, off) + _sums(mix64(hx + np.uint64(3)), offx)
                f2 = _sums(mix64(h + np.uint64(1)), off) + _sums(mix64(hx + np.uint64(5)), offx)
            wide = _maps(h, t, count, 64 * len(WIDE))
            maps = np.hstack([fold_map(wide, 128), *sides, _maps(hx, tx, count, 128)])
            missing = b["extra"].is_null().to_numpy(zero_copy_only=False)
            # a missing text is asked for nothing, one without words is: they are no copies of each other
            f1 = f1 + missing.astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    b["row"], b["side"], pa.array(n.astype(np.int32)), pa.array(np.where(missing, -1, np.diff(offx)).astype(np.int32)),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([m.tobytes() for m in maps], pa.binary()),
                    pa.ListArray.from_arrays(lists, pa.array(h[keep].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(rest.astype(np.int32))),
                    *[pa.array(np.ascontiguousarray(w).view(np.int64)) for w in wide.T],
                ],
                ["row", "side", "n", "nx", "fp1", "fp2", "map", "keys", "rest", *WIDE],
            )

    return df.select("row", "side", "main", "extra").mapInArrow(sign, _SIG)


def _grids(sig: DataFrame, block: int, bits: int = 16) -> np.ndarray:
    """Into how many parts either side of a bucket is cut, by hash of the bucket: 1, or more where many rows fall together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=np.int64)
        for b in batches:
            keys = b["keys"].flatten().to_numpy().view(np.uint64)
            held += np.bincount(sketch.bucket_of(keys, bits), minlength=1 << bits)
        at = np.flatnonzero(held)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(held[at])], ["bucket", "n"])

    held = sketch.counts(sig.select("keys").mapInArrow(count, "bucket int, n bigint"), bits).astype(np.int64)
    return 1 + np.maximum(held - np.median(held).astype(np.int64), 0) // block


def _posts(sig: DataFrame, grids) -> DataFrame:
    """One row per record and prefix word; a bucket of g parts becomes a grid of g x g groups that pair every part with every
    part."""
    bits = int(np.log2(len(grids.value)))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b["keys"]
            keys = lists.flatten().to_numpy().view(np.uint64)
            at = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            grid = grids.value[sketch.bucket_of(keys, bits)]
            row = b["row"].to_numpy()[at]
            mine = (mix64(row.astype(np.uint64) ^ keys) % grid.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(keys)), grid)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(grid) - grid, grid)
            train = b["side"].to_numpy()[at][rep] == 0
            cell = np.where(train, mine[rep] * 65536 + other, other * 65536 + mine[rep]).astype(np.uint64)
            with np.errstate(over="ignore"):
                key = np.where(grid[rep] == 1, keys[rep], mix64(keys[rep] + (cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
            take = pa.array(at[rep])
            wide = np.stack([b[w].to_numpy() for w in WIDE], axis=1)
            full = pa.array([m.tobytes() if n > FULL else b"" for m, n in zip(wide, b["n"].to_pylist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*[b[c].take(take) for c in ("row", "side", "n", "nx", "map")], full.take(take), b["rest"].flatten().take(pa.array(rep)), pa.array(key.view(np.int64))],
                ["row", "side", "n", "nx", "map", "wide", "rest", "key"],
            )

    return sig.select("row", "side", "n", "nx", "map", "keys", "rest", *WIDE).mapInArrow(
        post, "row bigint, side int, n int, nx int, map binary, wide binary, rest int, key bigint"
    )


def _across(num: int, den: int):
    """Within the rows of one word: pairs of one row of either side that can reach the overlap."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sketch.rows_by_key(batches, "key"):
            group = np.cumsum(np.concatenate(([0], np.diff(g["key"].to_numpy()) != 0)))
            place = ((group * 2 + g["side"].to_numpy()) << 25) | g["n"].to_numpy().astype(np.int64)
            order = np.argsort(place, kind="stable")
            g, group, place = g.take(pa.array(order)), group[order], place[order]
            row, n, nx = g["row"].to_numpy(), g["n"].to_numpy().astype(np.int64), g["nx"].to_numpy().astype(np.int64)
            side, rest = g["side"].to_numpy(), g["rest"].to_numpy().astype(np.int64)
            maps = [np.ascontiguousarray(m) for m in fixed_binary(g["map"], MAP_WORDS).T]
            # each train row meets the group's evaluation rows of a size it can reach. Where this is the first word in common,
            # the words from here on are all the two can share
            eval_ = (group * 2 + 1) << 25
            begin = np.searchsorted(place, eval_ | least_common(n, num, den))
            end = np.searchsorted(place, eval_ | (rest * den // num), side="right")
            count = np.where(side == 0, np.maximum(end - begin, 0), 0)
            stop = np.searchsorted(place, eval_)
            wide, size = _flat_binaries(g["wide"], np.uint64)
            wide, full, nth = wide.reshape(-1, len(WIDE)), size > 0, np.cumsum(size > 0) - 1
            got = []

            def passed(i: np.ndarray, j: np.ndarray) -> None:
                far = n[i] + n[j] - 2 * least_common(np.maximum(n[i], n[j]), num, den)
                apart = np.bitwise_count(maps[0][i] ^ maps[0][j]) + np.bitwise_count(maps[1][i] ^ maps[1][j])
                ok = (apart <= far) & (rest[j] * den >= n[i] * num) & (maps[2][i] & maps[2][j] != 0) & (maps[3][i] & maps[3][j] != 0)
                i, j, far = i[ok], j[ok], far[ok]
                both, ok = np.flatnonzero(full[i] & full[j]), np.ones(len(i), dtype=bool)
                for k in range(0, len(both), 1 << 17):
                    p = both[k : k + (1 << 17)]
                    ok[p] = np.bitwise_count(wide[nth[i[p]]] ^ wide[nth[j[p]]]).sum(axis=1, dtype=np.int64) <= far[p]
                i, j = i[ok], j[ok]
                apart = np.bitwise_count(maps[4][i] ^ maps[4][j]).astype(np.int64) + np.bitwise_count(maps[5][i] ^ maps[5][j])
                ok = (nx[i] < 0) | (nx[j] < 0) | (apart <= nx[i] + nx[j] - 2 * least_common(np.maximum(nx[i], nx[j]), num, den))
                got.append(np.stack([row[i[ok]], row[j[ok]]]))

            long = count > LONG
            for lo, hi in _chunks(np.where(long, 0, count), 1 << 20):
                c = np.where(long[lo:hi], 0, count[lo:hi])
                i = np.repeat(np.arange(lo, hi), c)
                passed(i, begin[i] + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c))
            # long runs: tiles of train rows against all that one of them meets, the bound taken for the largest and the smallest
            at = np.flatnonzero(long)
            while len(at):
                i0 = at[0]
                tile = at[: np.searchsorted(at, min(i0 + 64, stop[i0]))]
                at, i1, last = at[len(tile) :], tile[-1] + 1, end[tile].max()
                for j0 in range(begin[tile].min(), last, 4096):
                    to = slice(j0, min(j0 + 4096, last))
                    far = n[to] + n[i1 - 1] - 2 * least_common(np.maximum(n[to], n[i0]), num, den)
                    apart = np.bitwise_count(maps[0][i0:i1, None] ^ maps[0][None, to])
                    apart += np.bitwise_count(maps[1][i0:i1, None] ^ maps[1][None, to])
                    i, j = np.nonzero(apart <= np.clip(far, 0, 128).astype(np.uint8))
                    i, j = i + i0, j + j0
                    ok = long[i] & (j >= begin[i]) & (j < end[i])
                    passed(i[ok], j[ok])
            got = np.unique(np.concatenate(got, axis=1), axis=1) if got else np.zeros((2, 0), np.int64)
            if got.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], ["a", "b"])

    return pairs


def cross_split_classes(
    records: DataFrame, num: int = 7, den: int = 10, least: int = 4, block: int = 1 << 13
) -> tuple[DataFrame, DataFrame]:
    """Members (row, rep, side) and links (a, b) across the split, of records (row bigint, side int, main, extra string).

    ``side`` is 0 for training and 1 for evaluation; other and null sides take no part. A link joins a training and an
    evaluation class whose ``main`` texts have a word overlap of at least num / den and whose ``extra`` texts have too,
    which is not asked for where either is missing (null or blank). Records whose main text has no words are left out. Rows
    of one side with the same words are one class. Further columns are ignored. A bucket of more than about ``block``
    rows is cut into a grid of groups.
    """
    spark = records.sparkSession
    data = records.select(
        F.col("row").cast("bigint").alias("row"), F.col("side").cast("int").alias("side"), "main",
        F.when(F.length(F.trim("extra")) > 0, F.col("extra")).alias("extra"),
    ).where("row IS NOT NULL AND side IN (0, 1)")
    freq = spark.sparkContext.broadcast(_counts(data, least, BITS))
    sig = cut(_sign(data, freq, least, num, den).where("n > 0"))
    classes = cut(sig.groupBy("side", "fp1", "fp2").agg(F.min("row").alias("rep")))
    members = sig.select("row", "side", "fp1", "fp2").join(classes, ["side", "fp1", "fp2"]).select("row", "side", "rep").distinct()
    slim = sig.join(classes.select("side", F.col("rep").alias("row")), ["side", "row"], "left_semi")
    posts = _posts(slim, spark.sparkContext.broadcast(_grids(slim, block)))
    found = (
        posts.repartition("key").sortWithinPartitions("key")
        .mapInArrow(_across(num, den), "a bigint, b bigint").distinct()
    )
    return members, cut(_verified(cut(_bounded(found, slim, num, den)), data, least, num, den))


def _bounded(pairs: DataFrame, sig: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose wide maps differ in no more bits than the overlap allows."""
    pick = lambda c: sig.select(F.col("row").alias(c), F.col("n").alias(f"n{c}"), *[F.col(w).alias(f"{w}{c}") for w in WIDE])
    both = pairs.join(pick("a"), "a").join(pick("b"), "b")
    apart = sum((F.bit_count(F.col(f"{w}a").bitwiseXOR(F.col(f"{w}b"))) for w in WIDE), F.lit(0))
    larger = F.greatest("na", "nb")
    return both.where(apart <= F.col("na") + F.col("nb") - 2 * F.ceil(larger * num / den)).select("a", "b")


def _verified(pairs: DataFrame, data: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """The pairs that do reach the overlap; the words of a record are taken once, however many pairs it stands in."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    wanted = sketch.in_members(pairs.sparkSession, sketch.members(ids, "id"))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            lists = [_lists(h.view(np.int64), t, b.num_rows, pa.int64()) for h, t in (_bag(b[c].to_pylist(), least) for c in ("main", "extra"))]
            yield pa.RecordBatch.from_arrays([b["row"], *lists, b["extra"].is_null()], ["row", "m", "x", "none"])

    few = data.select("row", "main", "extra").where(wanted(F.col("row"))).mapInArrow(bag, "row bigint, m array<bigint>, x array<bigint>, none boolean")
    pick = lambda c: few.select(F.col("row").alias(c), *[F.col(k).alias(k + c) for k in ("m", "x", "none")])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            common, larger = _common(*flat(b["ma"]), *flat(b["mb"]))
            ok = (common * den >= larger * num) & (larger > 0)
            common, larger = _common(*flat(b["xa"]), *flat(b["xb"]))
            missing = b["nonea"].to_numpy(zero_copy_only=False) | b["noneb"].to_numpy(zero_copy_only=False)
            ok &= missing | (common * den >= larger * num)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    both = pairs.join(pick("a"), "a").join(pick("b"), "b").select("a", "b", "ma", "mb", "xa", "xb", "nonea", "noneb")
    return both.mapInArrow(check, "a bigint, b bigint")


def row_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """(train_row, eval_row): every pair of rows of two linked classes."""
    a = members.where("side = 0").select(F.col("rep").alias("a"), F.col("row").alias("train_row"))
    b = members.where("side = 1").select(F.col("rep").alias("b"), F.col("row").alias("eval_row"))
    return links.join(a, "a").join(b, "b").select("train_row", "eval_row")


def overlap_report(members: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts per evaluation split and source from classes, without expanding pairs.

    ``labels`` has (row, split, source). Columns: split, source, leaked_rows (evaluation rows with a training partner), and
    pairs (of rows, a product of class sizes). Null source counts as ''.
    """
    sizes = members.groupBy("rep", "side").agg(F.count(F.lit(1)).alias("n"))
    train = sizes.where("side = 0").select(F.col("rep").alias("a"), "n")
    partners = links.join(train, "a").groupBy("b").agg(F.sum("n").alias("partners"))
    leaked = members.where("side = 1").join(partners, F.col("rep") == F.col("b")).select("row", "partners")
    return (
        leaked.join(labels, "row").groupBy("split", F.coalesce("source", F.lit("")).alias("source"))
        .agg(F.count(F.lit(1)).alias("leaked_rows"), F.sum("partners").alias("pairs"))
    )
