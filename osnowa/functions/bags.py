"""Word bags in NumPy: a whole Arrow batch of texts becomes one flat array of word hashes.

Built-in expressions can tokenise too, but every later step here (occurrence numbers, global orders, prefixes) works on
arrays within a row, which Spark evaluates with interpreted lambdas. One Arrow transfer per batch and vectorised passes
over code points cost a fraction of that.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: Polish letters and the letters they are compared as.
POLISH = dict(zip("ąćęłńóśźż", "acelnoszz"))
_DENSE = 0x3000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _fold_char(code: int, digits: bool) -> int:
    c = chr(code)
    if c.isalpha():
        low = c.lower()[0]
        return ord(POLISH.get(low, low))
    if digits and (c.isdigit() or c.isnumeric()):
        return code
    return 0


@functools.lru_cache(maxsize=2)
def _table(digits: bool) -> np.ndarray:
    return np.array([_fold_char(c, digits) for c in range(_DENSE)], dtype=np.uint32)


def fold(texts: list[str | None], digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of all texts in one array, 0 where a word ends, and where each text begins (one more than texts).

    Texts are composed (NFC) first if any of them holds a combining mark, so both spellings of a letter agree.
    """
    texts = [t or "" for t in texts]
    joined = "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if ((codes >= 0x300) & (codes < 0x370)).any():
        texts = [unicodedata.normalize("NFC", t) for t in texts]
        codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begin = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    far = codes >= _DENSE
    out = _table(digits)[np.where(far, 0, codes)]
    if far.any():
        rare, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([_fold_char(int(c), digits) for c in rare], dtype=np.uint32)[at]
    return out, begin


def words(texts: list[str | None], least: int = 4, digits: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, text number of each word), in order of appearance; words shorter than ``least`` are left out.

    With ``digits`` a word is a run of letters and digits, else of letters only. Null and empty texts have no words.
    """
    codes, begin = fold(texts, digits)
    inside = np.concatenate(([0], (codes != 0).view(np.int8), [0]))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = ends - starts >= least
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    # a word's hash: the scrambled sum of its code points, each weighted by its place in the word
    with np.errstate(over="ignore"):
        lengths = ends - starts
        begins = np.cumsum(lengths) - lengths
        nth = np.arange(lengths.sum()) - np.repeat(begins, lengths)
        flat = nth + np.repeat(starts, lengths)
        powers = _powers(int(lengths.max()))
        value = (codes[flat].astype(np.uint64) + np.uint64(1)) * powers[nth]
        total = np.add.reduceat(value, begins)
    return mix64(total), np.searchsorted(begin, starts, side="right") - 1


@functools.lru_cache(maxsize=8)
def _powers_to(n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * 0x9E3779B97F4A7C15 % (1 << 64)
    return out


def _powers(n: int) -> np.ndarray:
    size = 64
    while size < n:
        size *= 2
    return _powers_to(size)


def as_set(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns bags into sets: the k-th occurrence of a word within its text becomes its own element. Sorted by text."""
    if len(text) and int(text.max()) < 1 << 14:  # one sort of one word: text and 50 bits of the hash
        order = np.argsort((text.astype(np.uint64) << np.uint64(50)) | (hashes >> np.uint64(14)))
    else:
        order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    if not len(h):
        return h, t
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
    at = np.flatnonzero(new)
    nth = np.arange(len(h)) - np.repeat(at, np.diff(np.concatenate((at, [len(h)]))))
    with np.errstate(over="ignore"):
        out = np.where(nth == 0, h, mix64(h + nth.astype(np.uint64) * _MIX))
    return out, t


def spans(text: np.ndarray, count: int) -> np.ndarray:
    """Offsets of each of ``count`` texts in an array sorted by text number."""
    return np.searchsorted(text, np.arange(count + 1))
