"""Near-duplicate texts by prefix filters under several global word orders.

The word overlap of two texts is the size of their common bag over the size of the larger bag. If it is at least ``t``,
then under ANY order of all words the two prefixes of length n - ceil(t n) + 1 share a word. Candidates must share a prefix
word under a first order, which sorts words from rare to frequent and gives the join keys, and prefix words under a second
and under a third order too (:func:`met_in_all_orders`). Within a group sizes, the place of the shared word and a bit map of the
whole bag bound a pair first. All filters are necessary conditions, so nothing similar is lost; what passes is verified on the
bags.

Word frequencies come from a count sketch over all texts (2^BITS buckets, broadcast, fixed size). Any function of the word
is a valid order, so a collision in the sketch costs selectivity, never a result. Texts with the same bag are one class with
one representative before any pair is formed. A word that more than ``block`` texts carry is cut into blocks of about that
many texts and each pair of blocks is a group of its own, so no group is unbounded and none is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bags import as_set, mix64, spans, words
from ..session import cut
from . import sketch

#: Buckets of the word-frequency sketch: 2^BITS counters of four bytes.
BITS = 21
#: Texts in a group of one word, about; more are cut into blocks.
BLOCK = 1 << 15
#: Bits of a bag's map, by the number of its words: up to LEVEL_WORDS[i] words LEVELS[i] bits, beyond all of them the last.
LEVELS = [128, 256, 512, 2048]
LEVEL_WORDS = [48, 80, 256]
#: Rows and columns of a tile of long runs.
TILE = (64, 1024)
_SALTS = [np.uint64(0x51ED270B9C4D3A77), np.uint64(0xA24BAED4963EE407)]
_SIG = "kind int, row bigint, n int, fp1 bigint, fp2 bigint, map binary, pre2 binary, pre3 binary, keys array<bigint>, meta array<bigint>"


def bag_sets(texts: list, kinds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bags of the texts as sets of hashes, apart for each kind of text."""
    h, t = words(texts, least)
    h = mix64(h ^ (kinds[t].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    return as_set(h, t)


def word_counts(df: DataFrame, least: int, bits: int) -> np.ndarray:
    """In how many texts (kind, text) each bucket's words stand, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits, dtype=np.int32)
        for b in batches:
            h, _ = bag_sets(b["text"].to_pylist(), b["kind"].to_numpy(), least)
            held += np.bincount(sketch.bucket_of(h, bits), minlength=1 << bits).astype(np.int32)
        at = np.flatnonzero(held)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part].astype(np.int64))], ["bucket", "n"])

    return sketch.counts(df.select("kind", "text").mapInArrow(count, "bucket int, n bigint"), bits)


def least_common(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """ceil(num / den * n)"""
    return (n * num + den - 1) // den


def small(batches: Iterator[pa.RecordBatch], most: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` rows."""
    for b in batches:
        for i in range(0, b.num_rows, most):
            yield b.slice(i, most)


def in_order(text: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Positions sorted by text (under 2^14 of them), rank (up to 2^18, then alike) and hash (32 bits): one sort of one word."""
    rank = np.minimum(rank, (1 << 18) - 1).astype(np.uint64)
    return np.argsort((text.astype(np.uint64) << np.uint64(50)) | (rank << np.uint64(32)) | (h >> np.uint64(32)))


def _maps(h: np.ndarray, t: np.ndarray, count: int, bits: int) -> np.ndarray:
    """A bit map of ``bits`` bits of each text's elements."""
    out = np.zeros((count, bits // 64), dtype=np.uint64)
    b = (mix64(h + np.uint64(bits)) % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, (t, b >> 6), np.uint64(1) << (b & 63).astype(np.uint64))
    return out


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = np.concatenate(([np.uint64(0)], np.cumsum(x, dtype=np.uint64)))
        return total[off[1:]] - total[off[:-1]]


def _lists(values: np.ndarray, text: np.ndarray, count: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(spans(text, count).astype(np.int32)), pa.array(values, kind))


def _binaries(values: np.ndarray, text: np.ndarray, count: int) -> pa.Array:
    """Values sorted by text as one binary per text."""
    off = (spans(text, count) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), count, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _flat_binaries(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of :func:`_binaries`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[off[0] : off[-1]] if len(column) and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    return data.view(kind), np.diff(off) // size


def signatures(df: DataFrame, freq, least: int, num: int, den: int, block: int) -> DataFrame:
    """Of each text: bag size, fingerprint, bit maps, and its join keys (block pairs of its prefix words)."""
    bits = int(np.log2(len(freq.value)))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            count = b.num_rows
            rows = b["row"].to_numpy()
            h, t = bag_sets(b["text"].to_pylist(), b["kind"].to_numpy(), least)
            off = spans(t, count)
            n = np.diff(off)
            prefix = n - least_common(n, num, den) + 1
            c = freq.value[sketch.bucket_of(h, bits)].astype(np.int64)
            nth = np.arange(len(h)) - off[t]
            bag = _maps(h, t, count, LEVELS[-1])
            level = np.searchsorted(LEVEL_WORDS, n)
            prefixes = []
            for salt in _SALTS:  # second and third order: rarity classes, each shuffled anew
                o = in_order(t, np.log2(c + 1).astype(np.uint64), mix64(h ^ salt))
                keep = o[nth < prefix[t]]
                prefixes.append(_binaries((h[keep] >> np.uint64(48)).astype(np.uint16), t[keep], count))
            folded = [fold_map(bag, w) for w in LEVELS]
            maps = [folded[k][r].tobytes() for r, k in enumerate(level)]
            o = in_order(t, c, h)
            chosen = (nth < prefix[t]) & (c[o] > 1)  # a word of one text joins nothing
            keep, before = o[chosen], nth[chosen]
            kh, kt, kc = h[keep], t[keep], c[keep]
            blocks = (kc + block - 1) // block
            mine = (mix64(rows[kt].astype(np.uint64) ^ kh) % blocks.astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(kh)), blocks)
            other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            lo, hi = np.minimum(mine[rep], other), np.maximum(mine[rep], other)
            with np.errstate(over="ignore"):
                keys = mix64(kh[rep] + (lo * 65536 + hi).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            # in one word: kind, bag size, how many of the text's words stand before this one in the order, and the part:
            # 0 is compared with all of the group, 1 and 2 only with the other
            part = np.where(lo == hi, 0, np.where(mine[rep] == lo, 1, 2))
            at = kt[rep]
            meta = (b["kind"].to_numpy().astype(np.int64)[at] << 52) | (n[at] << 27) | (before[rep] << 2) | part
            yield pa.RecordBatch.from_arrays(
                [
                    b["kind"], b["row"], pa.array(n.astype(np.int32)),
                    pa.array(_sums(h, off).view(np.int64)), pa.array(_sums(mix64(h + np.uint64(1)), off).view(np.int64)),
                    pa.array(maps, pa.binary()), *prefixes,
                    _lists(keys.view(np.int64), kt[rep], count, pa.int64()), _lists(meta, kt[rep], count, pa.int64()),
                ],
                ["kind", "row", "n", "fp1", "fp2", "map", "pre2", "pre3", "keys", "meta"],
            )

    return df.select("kind", "row", "text").mapInArrow(sign, _SIG)


def _chunks(counts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose counts add up to about ``most``."""
    total = np.cumsum(counts)
    i = 0
    while i < len(counts):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + most, side="right"))
        j = max(j, i + 1)
        yield i, j
        i = j


def fixed_binary(column, width: int) -> np.ndarray:
    """A binary column whose values all hold ``width`` 64-bit words, as a matrix, without a Python object per value."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[column.offset * width * 8 :][: len(column) * width * 8].view(np.uint64).reshape(len(column), width)


def fold_map(maps: np.ndarray, bits: int) -> np.ndarray:
    """Bit maps made narrower by laying their parts over each other; what two maps differ in can only become less."""
    return np.bitwise_or.reduce(maps.reshape(len(maps), -1, bits // 64), axis=1)


def decode_maps(column) -> tuple[np.ndarray, list[np.ndarray]]:
    """(width level of each row, bag maps of all rows at each level's width).

    A row's map at a level wider than its own is left 0; it is compared only at its own level or a narrower one.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    level = np.searchsorted([w // 8 for w in LEVELS], np.diff(offsets))
    folded = [np.zeros((len(column), w // 64), dtype=np.uint64) for w in LEVELS]
    for k, w in enumerate(LEVELS):
        at = np.flatnonzero(level == k)
        if not len(at):
            continue
        raw = data[offsets[at][:, None] + np.arange(w // 8)].view(np.uint64)
        for narrower in range(k + 1):
            folded[narrower][at] = fold_map(raw, LEVELS[narrower])
    return level, folded


def near_pairs(num: int, den: int):
    """Within the rows of one key, sorted by key: the pairs that pass all filters."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffers = [np.empty(TILE[0] * TILE[1], dtype=kind) for kind in (np.uint64, np.uint8, np.uint8, np.uint16)]
        for g in sketch.rows_by_key(batches, "key"):
            meta = g["meta"].to_numpy()
            group = np.cumsum(np.concatenate(([0], np.diff(g["key"].to_numpy()) != 0)))
            # by group, size and place: the sort on the way here was by key alone, which Spark does by radix
            order = np.lexsort((meta & ((1 << 52) - 1), group))
            g = g.take(pa.array(order))
            key, row, meta = g["key"].to_numpy(), g["row"].to_numpy(), meta[order]
            kind, n, rest, part = meta >> 52, (meta >> 27) & ((1 << 25) - 1), (meta >> 2) & ((1 << 25) - 1), meta & 3
            rest = n - rest
            level, folded = decode_maps(g["map"])
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            end = np.repeat(np.append(at[1:], len(key)), np.diff(np.append(at, len(key))))
            me = np.arange(len(key))
            # sizes rise within a key. Where this is the first word in common, the smaller text's words from here on are all it
            # can still share: a text of more than rest * den / num words cannot follow
            place = (group[order] << 25) | n
            lim = np.minimum(np.searchsorted(place, (group[order] << 25) | np.minimum(rest * den // num, (1 << 25) - 1), side="right"), end)
            count = lim - me - 1
            # a pair passes if its maps differ in at most n_i + spare_j bits
            spare = n - 2 * least_common(n, num, den)
            columns = [[np.ascontiguousarray(m[:, k]) for k in range(m.shape[1])] for m in folded]
            long = count > 96
            got = []

            def passed(i: np.ndarray, j: np.ndarray) -> None:
                ok = (n[j] * num <= rest[i] * den) & ((part[i] == 0) | (part[i] != part[j])) & (kind[i] == kind[j])
                i, j = i[ok], j[ok]
                ok = np.ones(len(i), dtype=bool)
                for k, m in enumerate(folded):
                    at = np.flatnonzero(level[i] == k)
                    if len(at):
                        apart = np.bitwise_count(m[i[at]] ^ m[j[at]]).sum(axis=1, dtype=np.int64)
                        ok[at] &= apart <= spare[j[at]] + n[i[at]]
                i, j = i[ok], j[ok]
                got.append(np.stack([kind[i], np.minimum(row[i], row[j]), np.maximum(row[i], row[j])]))

            for lo, hi in _chunks(np.where(long, 0, count), 1 << 20):
                c = np.where(long[lo:hi], 0, count[lo:hi])
                i = np.repeat(np.arange(lo, hi), c)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
                narrow = columns[0]
                apart = np.bitwise_count(narrow[0][i] ^ narrow[0][j]) + np.bitwise_count(narrow[1][i] ^ narrow[1][j])
                ok = apart <= spare[j] + n[i]
                passed(i[ok], j[ok])
            # long runs: tiles of rows against the slice that can follow any of them, the bound taken for the largest.
            # Four words are counted in a byte: only 256 wraps, which lets a pair through to passed() and loses none
            at = np.flatnonzero(long)
            while len(at):
                i0 = at[0]
                tile = at[: np.searchsorted(at, min(i0 + TILE[0], end[i0]))]
                tile = tile[: np.searchsorted(level[tile], level[i0], side="right")]
                at = at[len(tile) :]
                i1, last = tile[-1] + 1, lim[tile].max()
                words_ = columns[level[i0]]
                for j0 in range(i0 + 1, last, TILE[1]):
                    s = slice(j0, min(j0 + TILE[1], last))
                    shape = (i1 - i0, s.stop - j0)
                    x, bits, four, apart = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in buffers)
                    for k, w in enumerate(words_):
                        np.bitwise_xor(w[i0:i1, None], w[None, s], out=x)
                        np.bitwise_count(x, out=bits if k % 4 else four)
                        if k % 4:
                            np.add(four, bits, out=four)
                        if k % 4 == 3 and len(words_) > 4:
                            np.add(apart if k > 3 else 0, four, out=apart)
                    apart = apart if len(words_) > 4 else four
                    bound = np.clip(spare[s] + n[i1 - 1], 0, np.iinfo(apart.dtype).max).astype(apart.dtype)
                    i, j = np.divmod(np.flatnonzero(np.less_equal(apart, bound[None, :], out=bits.view(bool))), shape[1])
                    i, j = i + i0, j + j0
                    ok = (j > i) & (j < lim[i]) & long[i]
                    passed(i[ok], j[ok])
            got = np.unique(np.concatenate(got, axis=1), axis=1) if got else np.zeros((3, 0), np.int64)
            if got.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(got[0].astype(np.int32)), pa.array(got[1]), pa.array(got[2])], ["kind", "a", "b"])

    return pairs


def _common(ha: np.ndarray, na: np.ndarray, hb: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(size of the common bag, size of the larger bag) of each pair, from flat arrays of set elements with their lengths. One sort of (pair, 48 bits of the hash) in a word, so at most
    2^16 pairs at once."""
    assert len(na) <= 1 << 16
    pair = np.repeat(np.concatenate([np.arange(len(na)), np.arange(len(nb))]), np.concatenate([na, nb])).astype(np.uint64)
    x = (pair << np.uint64(48)) | (np.concatenate([ha, hb]) >> np.uint64(16))
    x.sort()
    twice = x[1:][x[1:] == x[:-1]] >> np.uint64(48)
    return np.bincount(twice.astype(np.int64), minlength=len(na)), np.maximum(na, nb)


def _meet(a, b) -> np.ndarray:
    """Which pairs of prefixes (16 bits of each word) have a value in common."""
    (va, na), (vb, nb) = _flat_binaries(a, np.uint16), _flat_binaries(b, np.uint16)
    once = lambda v, n: np.unique((np.repeat(np.arange(len(n)), n).astype(np.uint64) << np.uint64(16)) | v)
    x = np.concatenate([once(va, na), once(vb, nb)])
    x.sort()
    out = np.zeros(len(na), dtype=bool)
    out[(x[1:][x[1:] == x[:-1]] >> np.uint64(16)).astype(np.int64)] = True
    return out


def met_in_all_orders(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs (kind, a, b) whose prefixes meet under the second and the third order too."""
    ids = pairs.select("kind", F.explode(F.array("a", "b")).alias("row")).select(F.struct("kind", "row").alias("id"))
    sig = sig.where(sketch.in_members(pairs.sparkSession, sketch.members(ids, "id"))(F.struct("kind", "row")))
    pick = lambda c: sig.select("kind", F.col("row").alias(c), F.col("pre2").alias(f"p2{c}"), F.col("pre3").alias(f"p3{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield b.select(["kind", "a", "b"]).filter(pa.array(_meet(b["p2a"], b["p2b"]) & _meet(b["p3a"], b["p3b"])))

    both = pairs.join(pick("a"), ["kind", "a"]).join(pick("b"), ["kind", "b"]).select("kind", "a", "b", "p2a", "p2b", "p3a", "p3b")
    return both.mapInArrow(check, "kind int, a bigint, b bigint")


def bags(df: DataFrame, least: int) -> DataFrame:
    """(kind, row, bag) of texts; the bag as a set of hashes."""

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, t = bag_sets(b["text"].to_pylist(), b["kind"].to_numpy(), least)
            yield pa.RecordBatch.from_arrays([b["kind"], b["row"], _lists(h.view(np.int64), t, b.num_rows, pa.int64())], ["kind", "row", "bag"])

    return df.select("kind", "row", "text").mapInArrow(bag, "kind int, row bigint, bag array<bigint>")


def flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column."""
    return lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())


def verified(pairs: DataFrame, texts: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """The pairs (kind, a, b) whose texts do reach the overlap. Only bags of texts that occur in a pair are moved."""
    spark = pairs.sparkSession
    ids = pairs.select("kind", F.explode(F.array("a", "b")).alias("row")).select(F.struct("kind", "row").alias("id"))
    wanted = sketch.in_members(spark, sketch.members(ids, "id"))
    few = bags(texts.where(wanted(F.struct("kind", "row"))), least)
    one = pairs.join(few.select("kind", F.col("row").alias("a"), F.col("bag").alias("ba")), ["kind", "a"])
    two = one.join(few.select("kind", F.col("row").alias("b"), F.col("bag").alias("bb")), ["kind", "b"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            common, larger = _common(*flat(b["ba"]), *flat(b["bb"]))
            yield b.select(["kind", "a", "b"]).filter(pa.array((common * den >= larger * num) & (larger > 0)))

    return two.select("kind", "a", "b", "ba", "bb").mapInArrow(check, "kind int, a bigint, b bigint")


def similar_classes(
    texts: DataFrame, num: int = 7, den: int = 10, least: int = 4, bits: int = BITS, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """Members (kind, row, rep) and links (kind, a, b) between representatives of texts (kind int, row bigint, text string).

    Rows with the same bag of words share the representative, their least row. A link joins two representatives whose word
    overlap is at least num / den; words are runs of at least ``least`` letters, without regard to case and Polish
    diacritics. Null and empty texts, and texts without words, are in no class. Repeated (kind, row) count once. Further
    columns are ignored. An empty table gives two empty results.
    """
    spark = texts.sparkSession
    freq = spark.sparkContext.broadcast(word_counts(texts, least, bits))
    sig = cut(signatures(texts, freq, least, num, den, block).where("n > 0"))
    classes = cut(
        sig.groupBy("kind", "fp1", "fp2")
        .agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"))
    )
    reps = classes.select(F.col("kind"), F.col("rep").alias("row"))
    posts = (
        sig.join(reps, ["kind", "row"], "left_semi")
        .select("row", "map", F.arrays_zip("keys", "meta").alias("z")).select("row", "map", F.inline("z")).withColumnRenamed("keys", "key")
    )
    found = (
        posts.repartition("key").sortWithinPartitions("key")
        .mapInArrow(near_pairs(num, den), "kind int, a bigint, b bigint").distinct()
    )
    links = cut(verified(cut(met_in_all_orders(cut(found), sig)).distinct(), texts, least, num, den))
    members = sig.select("kind", "row", "fp1", "fp2").join(classes, ["kind", "fp1", "fp2"]).select("kind", "row", "rep", "size")
    return members.distinct(), links


def row_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, row_a, row_b): every pair of rows of one class or of two linked classes, the smaller row first.

    The result is as long as the pairs are many; classes stay the compact form. A large class is spread by the adaptive
    skew join, because no row is gathered.
    """
    own = members.where("size > 1").select("kind", F.col("rep").alias("a"), F.col("rep").alias("b")).distinct()
    joined = links.unionByName(own)
    ma = members.select("kind", F.col("rep").alias("a"), F.col("row").alias("ra"))
    mb = members.select("kind", F.col("rep").alias("b"), F.col("row").alias("rb"))
    return (
        joined.join(ma, ["kind", "a"]).join(mb, ["kind", "b"]).where("a <> b OR ra < rb")
        .select("kind", F.least("ra", "rb").alias("row_a"), F.greatest("ra", "rb").alias("row_b"))
    )
