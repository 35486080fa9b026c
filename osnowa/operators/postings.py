"""Candidate pairs of similar sets from postings in packed arrays.

Postings of the prefix elements go to a few parts by hash of the element, packed as plain arrays; a row's size and bit map are
sent once to each part that has an element of it, not with every posting. Within a part all pairs of rows of one element are
bounded by sizes, by the places of the element in both rows, and by the maps. All are necessary conditions, so no pair is lost.
Frequencies are a sketch of fixed size and only order the elements; collisions cost selectivity, never a result.

Pairs are verified in groups of rows that hang together: a set goes once to each group, not with every pair, and without the
elements that no other row has.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import mix64
from ..session import cut, shuffles_removed

#: Buckets of the frequency sketch (powers of two): of all, and of one chunk on its way to the driver.
BITS, CHUNK = 24, 16
#: Bits of a row's map (powers of two): the least that are four times its elements, or the last. A fuller map bounds nothing.
LEVELS = np.array([512, 1024, 2048, 4096, 16384])
WORDS = LEVELS // 64
#: Grams of both tables per part, about.
PART = 1 << 22
#: Pairs of a group that is verified in one piece, about.
GROUP = 1 << 17
_ROW = np.dtype([("row", "<i8"), ("n", "<u4"), ("side", "u1")])
_POST = np.dtype([("key", "<u4"), ("nth", "<u2"), ("at", "<u2")])


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all rows, made different by block, and the size of each row."""
    grams = b["grams"]
    n = np.diff(grams.offsets.to_numpy())
    h = grams.flatten().to_numpy().view(np.uint64)
    return mix64(h ^ np.repeat(b["block"].to_numpy().view(np.uint64), n)), n.astype(np.int64)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1 << 13) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _frequencies(sets: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of grams by the first bits of their hash (those from 64 on by their logarithm, at most 255), and of all grams."""
    low = np.uint64(64 - BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << BITS, dtype=np.uint32)
        for b in batches:
            h, _ = _flat(b)
            at, n = np.unique((h >> low).astype(np.uint32), return_counts=True)
            held[at] += n.astype(np.uint32)
        for i in range(0, 1 << BITS, 1 << CHUNK):
            part = held[i : i + (1 << CHUNK)]
            at = np.flatnonzero(part)
            if len(at):
                data = [at.astype("<u2").tobytes(), np.minimum(part[at], 255).astype("u1").tobytes()]
                big = at[part[at] >= 255]
                data += [big.astype("<u2").tobytes(), part[big].astype("<u4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([i >> CHUNK], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], ["chunk", "at", "n", "big", "many"])

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << CHUNK, dtype=np.int64)
        for at, n, big, many in zip(pdf["at"], pdf["n"], pdf["big"], pdf["many"]):
            n = np.frombuffer(n, "u1").astype(np.int64)
            n[n == 255] = np.frombuffer(many, "<u4")
            out[np.frombuffer(at, "<u2")] += n
        return pd.DataFrame({"chunk": [key[0]], "total": [int(out.sum())], "data": [_level(out).tobytes()]})

    with shuffles_removed(sets.sparkSession):
        rows = sets.mapInArrow(count, "chunk int, at binary, n binary, big binary, many binary").groupBy("chunk").applyInPandas(add, "chunk int, total bigint, data binary").collect()
    out = np.zeros(1 << BITS, dtype=np.uint8)
    for r in rows:
        out[r["chunk"] << CHUNK : (r["chunk"] + 1) << CHUNK] = np.frombuffer(r["data"], dtype=np.uint8)
    return out, sum(r["total"] for r in rows)


def _level(n: np.ndarray) -> np.ndarray:
    high = 64 + 8 * (np.log2(np.maximum(n, 64)) - 6)
    return np.where(n < 64, n, np.minimum(high, 255)).astype(np.uint8)


def _most(level: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    up = np.ceil(2.0 ** ((level.astype(np.float64) - 63) / 8 + 6))
    return np.where(level < 64, level, up).astype(np.int64)


def _squeezed(x: np.ndarray) -> bytes:
    """An array in few bytes: the first bytes of all values, the second and so on, compressed, behind the number of values."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unsqueezed(packed: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed[8:], n * size), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).reshape(-1).view(kind)


def _level_of(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS[:-1] // 4, n)


def _maps(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The maps of all rows, each as wide as its level, one after the other."""
    level, first = _level_of(n), np.cumsum(n) - n
    width = WORDS[level]
    out, begin = np.zeros(width.sum(), dtype=np.uint64), np.cumsum(width) - width
    for k, bits in enumerate(LEVELS):
        own = np.flatnonzero(level == k)
        for lo in range(0, len(own), (1 << 23) // bits):
            r = own[lo : lo + (1 << 23) // bits]
            at = _runs(first[r], n[r])
            held = np.zeros((len(r), bits), dtype=np.uint8)
            held[np.repeat(np.arange(len(r)), n[r]), (h[at] & np.uint64(bits - 1)).astype(np.int64)] = 1
            out[begin[r][:, None] + np.arange(WORDS[k])] = np.packbits(held, axis=1).view("<u8")
    return out


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of runs of n from ``begin`` on."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


class _Folded:
    """Maps of rows at every level up to their own: a wide map laid over itself is the narrower one."""

    def __init__(self, n: np.ndarray, maps: np.ndarray):
        self.level = _level_of(n)
        width = WORDS[self.level]
        begin = np.cumsum(width) - width
        self.at, self.maps = [], []
        for k, words in enumerate(WORDS):
            has = self.level >= k
            self.at.append(np.cumsum(has) - 1)
            held = np.zeros((int(has.sum()), words), dtype=np.uint64)
            for up in range(k, len(WORDS)):
                own = np.flatnonzero(self.level == up)
                for lo in range(0, len(own), (1 << 20) // WORDS[up]):
                    r = own[lo : lo + (1 << 20) // WORDS[up]]
                    wide = maps[begin[r][:, None] + np.arange(WORDS[up])].reshape(len(r), -1, words)
                    held[self.at[k][r]] = np.bitwise_or.reduce(wide, axis=1)
            self.maps.append(held)
        self.narrow = np.ascontiguousarray(self.maps[0].T)

    def within(self, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which pairs differ in at most ``far`` bits, by place."""
        left, apart = np.arange(len(i)), np.zeros(len(i), dtype=np.int64)
        for w in range(0, len(self.narrow), 2):
            apart += np.bitwise_count(self.narrow[w][i] ^ self.narrow[w][j])
            apart += np.bitwise_count(self.narrow[w + 1][i] ^ self.narrow[w + 1][j])
            ok = apart <= far
            i, j, far, apart, left = i[ok], j[ok], far[ok], apart[ok], left[ok]
        both, ok = np.minimum(self.level[i], self.level[j]), np.ones(len(i), dtype=bool)
        for k in range(1, len(WORDS)):
            own = np.flatnonzero(both == k)
            for lo in range(0, len(own), (1 << 20) // WORDS[k]):
                p = own[lo : lo + (1 << 20) // WORDS[k]]
                x = self.maps[k][self.at[k][i[p]]] ^ self.maps[k][self.at[k][j[p]]]
                ok[p] = np.bitwise_count(x).sum(axis=1, dtype=np.int64) <= far[p]
        return left[ok]


def _packed(sets: DataFrame, freq, share: Fraction, common: int, parts: int, block: int) -> DataFrame:
    """(part, rows, maps, posts): packed postings of one batch for one part.

    Elements are ordered by frequency; one that a single row has joins nothing. An element of more than about ``block`` rows is
    cut into pieces, and each pair of pieces is a group of its own.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            h, n = _flat(b)
            t = np.repeat(np.arange(len(n)), n)
            level = freq.value[(h >> np.uint64(64 - BITS)).astype(np.int64)]
            # text, frequency and 40 bits of the hash in one number; those equal in all stay in the order of the set
            o = np.argsort((t.astype(np.uint64) << np.uint64(48)) | (level.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), kind="stable")
            nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            prefix = n - np.maximum(-(-n * share.numerator // share.denominator), common) + 1
            keep = (nth < prefix[t]) & (level[o] > 1)
            key, at, nth, pieces = h[o][keep], t[keep], nth[keep], 1 + (_most(level[o][keep]) - 1) // block
            rows = np.zeros(len(n), dtype=_ROW)
            rows["row"], rows["n"], rows["side"] = b["row"].to_numpy(), n, b["side"].to_numpy()
            maps, width = _maps(h, n), WORDS[_level_of(n)]
            first = np.cumsum(width) - width
            if (pieces > 1).any():
                mine = (mix64(rows["row"][at].view(np.uint64) ^ key) % pieces.astype(np.uint64)).astype(np.int64)
                rep = np.repeat(np.arange(len(key)), pieces)
                other = np.arange(len(rep)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                low, high = np.minimum(mine[rep], other), np.maximum(mine[rep], other)
                with np.errstate(over="ignore"):
                    cell = mix64(key[rep] + (low * (1 << 20) + high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                key, at, nth = np.where(pieces[rep] > 1, cell, key[rep]), at[rep], nth[rep]
            key = mix64(key)
            part = (key % np.uint64(parts)).astype(np.int64)
            posts = np.zeros(len(key), dtype=_POST)
            posts["key"], posts["nth"] = key >> np.uint64(32), np.minimum(nth, 65535)
            order = np.argsort(part, kind="stable")
            bound = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                mine = order[bound[p] : bound[p + 1]]
                if len(mine):
                    used, where = np.unique(at[mine], return_inverse=True)
                    out = posts[mine]
                    out["at"] = where
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([_squeezed(x)]) for x in (rows[used], maps[_runs(first[used], width[used])], out)]], ["part", "rows", "maps", "posts"])

    return sets.mapInArrow(pack, "part int, rows binary, maps binary, posts binary")


def _pairs_of(rows: np.ndarray, maps: _Folded, posts: np.ndarray, at: np.ndarray, share: Fraction, common: int, two: bool) -> np.ndarray:
    """(a, b) of the rows of a part that may be similar; within one table in order of the row."""
    num, den = share.numerator, share.denominator
    n_of = rows["n"].astype(np.int64)
    order = np.argsort((posts["key"].astype(np.uint64) << np.uint64(32)) | n_of[at].astype(np.uint64))
    key, at, nth = posts["key"][order], at[order], posts["nth"][order]
    n = n_of[at]
    same = np.cumsum(np.concatenate(([0], np.diff(key) != 0)))
    place, rest = (same << 32) | n, n - nth
    # of two rows the one that stands later is the larger; where this is their first common element, both have at most the
    # elements from here on in common
    here = np.arange(len(n))
    begin = np.searchsorted(place, (same << 32) | -(-n * num // den))
    most = np.minimum(rest * (num + den) // num - n, n)
    end = np.minimum(np.searchsorted(place, (same << 32) + np.maximum(most, 0), side="right"), here)
    count = np.maximum(end - begin, 0)
    done = np.cumsum(count)
    got, lo = [np.zeros((2, 0), np.int64)], 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + (1 << 20), side="right")))
        c = count[lo:hi]
        j = np.repeat(here[lo:hi], c)
        i = np.arange(len(j)) + np.repeat(begin[lo:hi] - np.cumsum(c) + c, c)
        size = n[i] + n[j]
        least = np.maximum((size * num + num + den - 1) // (num + den), common)
        ok = rest[i] >= least
        if two:
            ok &= rows["side"][at[i]] != rows["side"][at[j]]
        i, j, far = at[i[ok]], at[j[ok]], (size - 2 * least)[ok]
        ok = maps.within(i, j, far)
        i, j = i[ok], j[ok]
        a, b = rows["row"][i], rows["row"][j]
        if two:
            first = rows["side"][i] == 0
            a, b = np.where(first, a, b), np.where(first, b, a)
        else:
            a, b = np.minimum(a, b), np.maximum(a, b)
            a, b = a[a != b], b[a != b]
        if len(a):
            got.append(np.unique(np.stack([a, b]), axis=1))
        lo = hi
    return np.unique(np.concatenate(got, axis=1), axis=1)


def candidates(sets: DataFrame, threshold: float, two: bool, block: int = 1 << 15, common: int = 1) -> DataFrame:
    """:func:`candidates_in_parts` alone."""
    return candidates_in_parts(sets, threshold, two, block, common)[0]


def candidates_in_parts(sets: DataFrame, threshold: float, two: bool, block: int = 1 << 15, common: int = 1) -> tuple[DataFrame, int, Broadcast]:
    """Distinct (a, b) of rows of ``sets`` (row, side, block, grams) that may reach the threshold with ``common`` elements, no pair that does left out.

    Within one table a < b; with ``two`` tables a is of side 0, b of side 1. ``block`` is a hash of what both must agree in.
    With it come the number of parts among which the sets are shared out, and the elements' frequencies.
    """
    spark = sets.sparkSession
    share = Fraction(str(threshold))
    levels, total = _frequencies(sets)
    freq = spark.sparkContext.broadcast(levels)
    parts = max(spark.sparkContext.defaultParallelism, -(-total // PART))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for p, *x in zip(*(b[c].to_pylist() for c in ("part", "rows", "maps", "posts"))):
                held.setdefault(p, []).append(x)
        while held:
            got = [[_unsqueezed(y, kind) for y, kind in zip(x, (_ROW, np.uint64, _POST))] for x in held.popitem()[1]]
            shift = np.cumsum([0] + [len(r) for r, _, _ in got])[:-1]
            at = np.concatenate([x["at"].astype(np.int64) + s for (_, _, x), s in zip(got, shift)])
            rows, maps, posts = (np.concatenate(x) for x in zip(*got))
            del got
            maps = _Folded(rows["n"].astype(np.int64), maps)
            a, b = _pairs_of(rows, maps, posts, at, share, common, two)
            for i in range(0, len(a), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[i : i + (1 << 16)]), pa.array(b[i : i + (1 << 16)])], ["a", "b"])

    packed = _packed(sets, freq, share, common, parts, block)
    return packed.repartitionById(parts, "part").mapInArrow(meet, "a bigint, b bigint").distinct(), parts, freq


def _grouped(near: DataFrame, two: bool, parts: int, group: int, rounds: int = 3) -> DataFrame:
    """(part, a, b): the pairs shared out so that rows that hang together over a few pairs mostly meet in one part. A group of
    more than ``group`` pairs is cut into a grid of parts."""
    pairs = near.select("a", "b", F.col("a").alias("head"))
    for _ in range(rounds):
        end = lambda c, k: pairs.select(F.col(c).alias("row"), F.lit(k if two else 0).alias("side"), "head")
        least = end("a", 0).union(end("b", 1)).groupBy("row", "side").agg(F.min("head").alias("least"))
        of = lambda c, k: least.where(F.col("side") == (k if two else 0)).select(F.col("row").alias(c), F.col("least").alias(f"h{c}"))
        pairs = cut(pairs.join(of("a", 0), "a").join(of("b", 1), "b").select("a", "b", F.least("ha", "hb").alias("head")))
    hot = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group)  # one row for every ``group`` pairs at most
    grid = F.ceil(F.sqrt(F.coalesce("n", F.lit(1)) / group))
    cell = lambda c: F.pmod(F.xxhash64(c), grid)
    part = F.pmod(F.xxhash64("head", cell("a"), cell("b")), F.lit(parts)).cast("int")
    return cut(pairs.join(F.broadcast(hot), "head", "left").select(part.alias("part"), "a", "b"))


def _shared(flat: np.ndarray, begin: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many elements the sets i and j of each pair have in common; sets are runs of ``flat``."""
    out = np.zeros(len(i), dtype=np.int64)
    done, lo = np.cumsum(n[i] + n[j]), 0
    while lo < len(i):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + (1 << 21), side="right")))
        runs = np.stack([i[lo:hi], j[lo:hi]], axis=1).ravel()
        m = n[runs]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m - begin[runs], m)
        h, pair = flat[at], np.repeat(np.arange(len(runs)) >> 1, m)
        order = np.argsort(h, kind="stable")  # equal elements stay in order of the pair
        h, pair = h[order], pair[order]
        out[lo:hi] = np.bincount(pair[1:][(h[1:] == h[:-1]) & (pair[1:] == pair[:-1])], minlength=hi - lo)
        lo = hi
    return out


def _joint(sets: DataFrame, freq) -> DataFrame:
    """(row, side, n, grams): the size of each set and its elements that another row may have."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _small(batches):
            h, n = _flat(b)
            ok = freq.value[(h >> np.uint64(64 - BITS)).astype(np.int64)] > 1
            left = np.concatenate(([0], np.cumsum(ok)))[np.concatenate(([0], np.cumsum(n)))]
            grams = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), b["grams"].flatten().filter(pa.array(ok)))
            yield pa.RecordBatch.from_arrays([b["row"], b["side"], pa.array(n), grams], ["row", "side", "n", "grams"])

    return sets.mapInArrow(keep, "row bigint, side int, n bigint, grams array<bigint>")


def verified(near: DataFrame, sets: DataFrame, two: bool, parts: int, freq, group: int = GROUP) -> DataFrame:
    """(a, b, shared, na, nb) of pairs: sizes of both sets and of what they share. ``sets`` as for :func:`candidates`, at least
    those of the rows in pairs."""
    pairs = _grouped(near, two, parts, group)
    ends = [pairs.select("part", F.col(c).alias("row"), F.lit(k if two else 0).alias("side")) for k, c in enumerate(("a", "b"))]
    held = _joint(sets, freq).join(ends[0].union(ends[1]).distinct(), ["row", "side"])
    every = held.select("part", "side", "row", "n", "grams").union(
        pairs.select("part", F.lit(2), "a", "b", F.lit(None).cast("array<bigint>"))  # b in place of the size
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            part, side = b["part"].to_numpy(), b["side"].to_numpy()
            for p in np.unique(part):
                for kind in (0, 1):  # sets, pairs
                    held.setdefault(int(p), ([], []))[kind].append(b.filter(pa.array((part == p) & ((side == 2) == kind))))
        while held:
            t, ab = map(pa.Table.from_batches, held.popitem()[1])
            n, flat = (np.concatenate(x) for x in zip(*((np.diff(g.offsets.to_numpy()).astype(np.int64), g.flatten().to_numpy()) for g in t["grams"].chunks)))
            # sets in order of side and row
            side, row, size = (t[c].to_numpy() for c in ("side", "row", "n"))
            del t
            order, split = np.lexsort((row, side)), int((side == 0).sum())
            n, begin, row, size = n[order], (np.cumsum(n) - n)[order], row[order], size[order]
            low, high = row[:split], row[split:] if two else row
            a, b = ab["row"].to_numpy(), ab["n"].to_numpy()
            i, j = np.searchsorted(low, a), np.searchsorted(high, b) + (split if two else 0)
            shared = _shared(flat, begin, n, i, j)
            for k in range(0, len(a), 1 << 16):
                c = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[c]) for x in (a, b, shared, size[i], size[j])], ["a", "b", "shared", "na", "nb"])

    return every.repartitionById(parts, "part").mapInArrow(compare, "a bigint, b bigint, shared bigint, na bigint, nb bigint")
