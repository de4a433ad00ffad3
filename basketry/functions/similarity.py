"""Fuzzy similarity of texts: Indel ratio by bit-parallel LCS, partial and token-sort ratios.

The kernels take a whole Arrow batch: each pair, or each window of a pair, is a
lane of 64-bit words, and one step takes a character of all lanes at once. Built-in
functions can fold an LCS too (one bit a character, one lambda step a character),
but that took 262 us a pair of product names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The similarities that a score needs, of (ingredient, description, combined text, keyword).
SCORES = ("ratio", "partial", "sorted_desc", "sorted_combined", "sorted_keyword")
#: Lanes that are stepped together, and words of their match masks.
LANES, MASK_WORDS = 1 << 14, 1 << 21


class Texts:
    """Distinct texts as numbers of letters, side by side."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.cumsum(self.size) - self.size
        letters, own = np.unique(codes, return_inverse=True)
        self.none = len(letters)  # the number of no letter
        self.codes = np.append(own.astype(np.int64), self.none)

    def at(self, text: np.ndarray, place: np.ndarray | int, end: np.ndarray) -> np.ndarray:
        """The letters at a place of each text, none from ``end`` on."""
        place = np.broadcast_to(place, text.shape)
        return self.codes[np.where(place < end, self.first[text] + place, len(self.codes) - 1)]

    def words_sorted(self) -> tuple[Texts, np.ndarray]:
        """The texts with their words in order, and where each one is among them."""
        made: dict[str, int] = {}
        place = np.array([made.setdefault(" ".join(sorted(t.split())), len(made)) for t in self.texts], np.int64)
        return Texts(list(made)), place

    def reversed(self) -> Texts:
        return Texts([t[::-1] for t in self.texts])


def _masks(texts: Texts, own: np.ndarray, words: int) -> np.ndarray:
    """For each text and letter the bits of its places."""
    out = np.zeros((len(own), texts.none + 1, words), np.uint64)
    lane = np.arange(len(own))
    for place in range(int(texts.size[own].max(initial=0))):
        out[lane, texts.at(own, place, texts.size[own]), place >> 6] |= np.uint64(1 << (place & 63))
    out[:, texts.none] = 0
    return out


def _zeros(state: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~state).sum(1, dtype=np.int64)


def _step(state: np.ndarray, hit: np.ndarray) -> None:
    """One character of all lanes: bits of matched places fall to zero, with carries from word to word."""
    carry = None
    for w in range(state.shape[1]):
        s = state[:, w]
        u = s & hit[:, w]
        t = s + u
        over = t < s
        if carry is not None:
            t2 = t + carry
            over |= t2 < t
            t = t2
        state[:, w] = t | (s - u)
        carry = over.astype(np.uint64)


def _lanes(texts: Texts, small: np.ndarray, large: np.ndarray, begin: np.ndarray, steps: np.ndarray, best: np.ndarray | None = None) -> np.ndarray:
    """LCS of each ``small`` text with ``steps`` letters of its ``large`` one from ``begin`` on.

    With ``best`` every lane also raises its entry there to the best ratio of
    ``small`` with any beginning of those letters.
    """
    out = np.zeros(len(small), np.int64)
    words = (texts.size[small] + 63) // 64
    order = np.lexsort((steps, words))
    at = 0
    while at < len(order):
        w = max(1, int(words[order[at]]))
        to = min(at + max(1, min(LANES, MASK_WORDS // (w * (texts.none + 1)))), int(np.searchsorted(words[order], words[order[at]], "right")))
        mine = order[at:to]
        own, lane = np.unique(small[mine], return_inverse=True)
        masks = _masks(texts, own, w)
        state = np.full((len(mine), w), np.iinfo(np.uint64).max, np.uint64)
        n, b, e = texts.size[small[mine]], begin[mine], begin[mine] + steps[mine]
        for j in range(int(steps[mine].max(initial=0))):
            _step(state, masks[lane, texts.at(large[mine], b + j, e)])
            if best is not None:
                real = j < steps[mine]
                best[mine[real]] = np.maximum(best[mine[real]], 200.0 * _zeros(state[real]) / (j + 1 + n[real]))
        out[mine] = _zeros(state)
        at = to
    return out


def _ordered(texts: Texts, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    swap = texts.size[a] > texts.size[b]
    return np.where(swap, b, a), np.where(swap, a, b)


def _once(a: np.ndarray, b: np.ndarray, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The score of each distinct pair, for all pairs."""
    pairs, place = np.unique(np.stack((a, b)), axis=1, return_inverse=True)
    return score(pairs[0], pairs[1])[place.ravel()]


def indel(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Normalised Indel similarity, 0 to 100. Equal texts are alike (100), an empty text is unlike any other (0)."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = _ordered(texts, a, b)
        same = _lanes(texts, small, large, np.zeros(len(a), np.int64), texts.size[large])
        total = texts.size[a] + texts.size[b]
        return np.where(a == b, 100.0, 200.0 * same / np.maximum(total, 1))

    return _once(a, b, score)


def partial(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best ratio of the shorter text with any window of its length, or shorter end window, of the longer.

    Windows at the beginning are the steps of one lane, those at the end the steps
    of one lane of the reversed texts; every window in between is a lane.
    """

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = _ordered(texts, a, b)
        n, m = texts.size[small], texts.size[large]
        zero = np.zeros(len(small), np.int64)
        best = np.zeros(len(small))
        _lanes(texts, small, large, zero, n, best)
        _lanes(texts.reversed(), small, large, zero, n, best)
        inner = np.maximum(m - n - 1, 0)  # windows that touch neither end
        pair = np.repeat(np.arange(len(small)), inner)
        begin = np.arange(len(pair)) - np.repeat(np.cumsum(inner) - inner, inner) + 1
        for at in range(0, len(pair), 1 << 20):
            p, i = pair[at : at + (1 << 20)], begin[at : at + (1 << 20)]
            same = _lanes(texts, small[p], large[p], i, n[p])
            np.maximum.at(best, p, 200.0 * same / np.maximum(2 * n[p], 1))
        return np.where(n == 0, np.where(m == 0, 100.0, 0.0), best)

    return _once(a, b, score)


def _interned(columns: tuple[pa.Array, ...]) -> tuple[Texts, list[np.ndarray], np.ndarray]:
    """The distinct texts of columns, the numbers of each column's, and the rows that are null in none."""
    coded = pa.chunked_array([c.cast(pa.large_string()) for c in columns]).combine_chunks().dictionary_encode()
    number = coded.indices.fill_null(0).to_numpy().astype(np.int64)
    known = np.asarray(coded.indices.is_valid())
    n = len(columns[0])
    texts = Texts(coded.dictionary.to_pylist() or [""])
    return texts, [number[i * n : (i + 1) * n] for i in range(len(columns))], known.reshape(len(columns), n).all(0)


def _pairwise(score: Callable[[Texts, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column, Column], Column]:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for columns in batches:
            texts, (a, b), known = _interned(columns)
            yield pa.array(score(texts, a, b), pa.float64(), mask=~known)

    return lambda a, b: F.arrow_udf(run, "double")(a, b)


def sorted_indel(texts: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    own, place = texts.words_sorted()
    return indel(own, place[a], place[b])


def ratio(a: Column, b: Column) -> Column:
    """Indel similarity of two texts; null if one is null."""
    return _pairwise(indel)(a, b)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Indel similarity of the texts' words in order."""
    return _pairwise(sorted_indel)(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _pairwise(partial)(a, b)


def _five(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for columns in batches:
        texts, (ing, desc, combined, keyword), _ = _interned(columns)
        own, place = texts.words_sorted()
        i, d, c, k = (place[x] for x in (ing, desc, combined, keyword))
        keyworded = np.where(texts.size[keyword] > 0, indel(own, i, k), 0.0)
        values = (indel(texts, ing, desc), partial(texts, ing, desc), indel(own, i, d), indel(own, i, c), keyworded)
        yield pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in values], names=list(SCORES))


def scores(ing: Column, desc: Column, combined: Column, keyword: Column) -> Column:
    """All of ``SCORES`` as one struct, so that each text goes to Python once; an empty keyword is unlike anything (0)."""
    return F.arrow_udf(_five, "struct<" + ",".join(f"{n}:double" for n in SCORES) + ">")(ing, desc, combined, keyword)
