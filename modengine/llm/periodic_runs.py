"""Periodic runs in texts, found by block convolution.

A run is a maximal stretch of words that repeats with a smallest period q, at
least ``times`` periods and ``min_words`` words long. At every dyadic scale b the
words are cut into blocks of b. A run whose period lies in [b, 2b) holds a whole
block within its first 2b - 1 words, and the block occurs again q words further
on. So every block is laid over its following window at all distances of the
scale at once: the sum of squared differences at a distance is
``sum(w^2) + sum(p^2) - 2 sum(w p)``, and the last term is a correlation, taken for
all blocks of a scale together by a number-theoretic transform modulo a prime
that the sums cannot reach. Sums are exact whole numbers; zero means no mismatch.
Periods below the smallest scale are found by its blocks at distances from 1.

The distances found seed extensions, unless a fingerprint shows that the text
around the block can't hold a run of that period: wherever the words of the
document agree with those so many words on, a stretch is as long as that
agreement, on both sides of the block. Of equal stretches the smallest period
stays.

Documents are independent, so nothing is shuffled; a task holds the words of at
most ``CHUNK`` words' worth of whole documents at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import free_names, once

PRIME, ROOT = 2013265921, 31  # 15 * 2^27 + 1 and a generator of its units
CHUNK = 200_000  # words
CELLS = 1 << 19  # numbers in one batch of transforms


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 … base^(n-1) modulo the prime, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, PRIME))
        more = min(have, n - have)
        out[have:have + more] = out[:more] * step % np.uint64(PRIME)
        have += more
    return out


class Transform:
    """The number-theoretic transform of rows of length ``size``, a power of two."""

    def __init__(self, size: int):
        self.size = size
        root = pow(ROOT, (PRIME - 1) // size, PRIME)
        self.forward = _powers(root, size // 2)
        self.back = _powers(pow(root, PRIME - 2, PRIME), size // 2)
        self.scale = np.uint64(pow(size, PRIME - 2, PRIME))

    def _decimate(self, rows: np.ndarray, powers: np.ndarray) -> np.ndarray:
        """Sums and twisted differences of halves: natural order in, bit-reversed out."""
        q, width = np.uint64(PRIME), self.size // 2
        while width:
            pairs = rows.reshape(len(rows), -1, 2, width)
            low, high = pairs[:, :, 0], pairs[:, :, 1]
            twisted = (low + q - high) * powers[::self.size // 2 // width] % q
            total = low + high
            pairs[:, :, 0] = np.where(total >= q, total - q, total)
            pairs[:, :, 1] = twisted
            width //= 2
        return rows

    def _restore(self, rows: np.ndarray, powers: np.ndarray) -> np.ndarray:
        """The steps of ``_decimate`` backwards: bit-reversed in, natural order out."""
        q, width = np.uint64(PRIME), 1
        while width < self.size:
            pairs = rows.reshape(len(rows), -1, 2, width)
            low, high = pairs[:, :, 0].copy(), pairs[:, :, 1] * powers[::self.size // 2 // width] % q
            total = low + high
            pairs[:, :, 0] = np.where(total >= q, total - q, total)
            pairs[:, :, 1] = np.where(low >= high, low - high, low + q - high)
            width *= 2
        return rows * self.scale % q

    def correlate(self, windows: np.ndarray, patterns: np.ndarray) -> np.ndarray:
        """sum over k of patterns[k] * windows[j + k], for every j that does not wrap."""
        turned = np.zeros_like(patterns)
        turned[:, 0], turned[:, 1:] = patterns[:, 0], patterns[:, :0:-1]
        product = self._decimate(windows.copy(), self.forward) * self._decimate(turned, self.forward) % np.uint64(PRIME)
        return self._restore(product, self.back)


_TRANSFORMS: dict[int, Transform] = {}


def transform(size: int) -> Transform:
    if size not in _TRANSFORMS:
        _TRANSFORMS[size] = Transform(size)
    return _TRANSFORMS[size]


def zero_mismatches(ids: np.ndarray, starts: np.ndarray, b: int, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of every occurrence of the blocks ``ids[s:s + b]`` at
    distances from ``nearest`` up to 2b - 1. Words enter as residues small enough
    that a sum of squares stays below the prime; equal residues of different
    words only cost an extension that finds nothing."""
    small = int(((PRIME - 1) // b) ** 0.5)
    values = (ids % small).astype(np.uint64)
    n_far = 2 * b - nearest  # distances
    size = 1 << (n_far + b - 2).bit_length()
    values = np.concatenate([values, np.zeros(size + 2 * b, dtype=np.uint64)])
    squares = np.concatenate([[0], np.cumsum(values.astype(np.int64) ** 2)])
    ntt, per = transform(size), max(1, CELLS // size)
    found_s, found_d = [], []
    for at in range(0, len(starts), per):
        part = starts[at:at + per]
        windows = values[part[:, None] + nearest + np.arange(size)]
        patterns = np.zeros((len(part), size), dtype=np.uint64)
        patterns[:, :b] = values[part[:, None] + np.arange(b)]
        windows[:, n_far + b - 1:] = 0
        cross = ntt.correlate(windows, patterns)[:, :n_far].astype(np.int64)
        first = part[:, None] + nearest + np.arange(n_far)
        own = squares[part + b] - squares[part]
        zero = squares[first + b] - squares[first] + own[:, None] == 2 * cross
        row, far = np.nonzero(zero)
        found_s.append(part[row])
        found_d.append(far + nearest)
    if not found_s:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(found_s), np.concatenate(found_d)


def _next_same(ids: np.ndarray) -> np.ndarray:
    """Distance from every word to its next occurrence; very far if there is none."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), np.iinfo(np.int64).max, dtype=np.int64)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _first_scale(min_words: int, times: int) -> int:
    """The largest power of two b for which any run of a period up to b holds a
    whole aligned block and its next occurrence: min_words >= 3b - 1."""
    b = 1
    while 2 * b * 3 - 1 <= min_words:
        b *= 2
    return b


def _fingerprints(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of ids[i] * base^i modulo the prime, and the powers: they tell in
    one step that two long stretches differ."""
    powers = _powers(7_919_017, len(ids) + 1)
    terms = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(PRIME) * powers[:-1] % np.uint64(PRIME)
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)]) % np.uint64(PRIME), powers


def find_runs(docs: list[np.ndarray], min_words: int = 24, times: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every document, given as arrays of
    word numbers, sorted by start and period."""
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    out: list[dict] = [{} for _ in docs]
    if not len(docs) or not ends[-1]:
        return [[] for _ in docs]
    # Word numbers of different documents never meet.
    top = max((int(d.max()) for d in docs if len(d)), default=0) + 1
    of_doc = np.repeat(np.arange(len(docs)), lengths)
    ids = np.concatenate(docs).astype(np.int64) + of_doc * top
    hop = _next_same(ids)
    prints, powers = _fingerprints(ids)
    covered = np.zeros(len(ids), dtype=np.int64)  # end of the runs found so far that hold a word
    longest = int(lengths.max())
    b, nearest = _first_scale(min_words, times), 1
    while nearest * times <= longest and longest >= min_words:
        blocks = np.concatenate([np.arange(s, e - b + 1, b) for s, e in zip(begins, ends) if e - s >= min_words])
        # A block occurs within the scale only if each of its words does.
        far = np.concatenate([[0], np.cumsum(hop >= 2 * b)])
        blocks = blocks[far[blocks + b] == far[blocks]]
        s, d = zero_mismatches(ids, blocks, b, nearest)
        # The first block of a run starts at most b - 1 words into it, and as much as
        # the run still has to hold from there on must agree. What happens inside a
        # run of a smaller period only repeats that period's multiples.
        need = np.maximum(np.maximum(min_words, times * d) - d - b + 1, b)
        fits = (s + d + need <= ends[of_doc[s]]) & (s + d + b > covered[s])
        s, d, need = s[fits], d[fits], need[fits]
        q = np.uint64(PRIME)
        here, there = prints[s + need] + q - prints[s], prints[s + d + need] + q - prints[s + d]
        alike = here % q * powers[d] % q == there % q
        for doc, far in np.unique(np.stack([of_doc[s[alike]], d[alike]], axis=1), axis=0).tolist():
            words = ids[begins[doc]:ends[doc]]
            agree = np.flatnonzero(np.diff(np.concatenate([[False], words[:-far] == words[far:], [False]]).astype(np.int8)))
            for start, stop in zip(agree[::2].tolist(), agree[1::2].tolist()):
                length = stop - start + far
                if length >= max(min_words, times * far):
                    key = start, length
                    out[doc][key] = min(far, out[doc].get(key, far))
                    at = begins[doc] + start
                    np.maximum(covered[at:at + length], at + length, out=covered[at:at + length])
        nearest = 2 * b
        b *= 2
    return [sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2])) for found in out]


def repeated(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words that some run holds after its first period."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the most periods; of equals the first, then the shortest period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def _found(texts: list[str | None], min_words: int, times: int) -> Iterator[tuple]:
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    numbers = []
    for w in words:
        known: dict[bytes, int] = {}
        numbers.append(np.fromiter((known.setdefault(x, len(known)) for x in w), dtype=np.int64, count=len(w)))
    for w, runs in zip(words, find_runs(numbers, min_words, times)):
        kept = [w[i] for i in np.flatnonzero(~repeated(len(w), runs))] if runs else w
        best = strongest(runs)
        yield (
            [{"start": s, "length": n, "period": q} for s, n, q in runs],
            None if best is None else dict(zip(("start", "length", "period"), best)), b" ".join(kept).decode("utf-8", "surrogatepass"),
        )


def periodic_runs(
    docs: DataFrame, text_col: str = "text", min_words: int = 24, times: int = 3, runs: str = "runs", best: str = "best_run",
    collapsed: str = "collapsed",
) -> DataFrame:
    """Adds ``runs``, an array of (start, length, period) over the words of the whole
    text, sorted by start and period; ``best_run``, the one of most periods (of
    equals the first, then the shortest period; null if there is none); and
    ``collapsed``, the words joined by one space without those that a run holds
    after its first period.

    Words are runs without ASCII white space. A null or empty text has no words
    and no runs; its collapsed text is empty. Every row is treated by itself, also
    rows that repeat. Names that the table has already get underscores before them.
    ``times`` is at least 3: fewer repetitions would not hold a whole block twice.
    """
    if times < 3 or min_words < 2:
        raise ValueError("runs need at least three periods and two words")
    run = "struct<start:long,length:long,period:long>"

    @F.pandas_udf(f"runs array<{run}>, best {run}, collapsed string")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows, group, size = [], [], 0
            for text in part:
                group.append(text)
                size += len(text or "") // 5
                if size >= CHUNK:
                    rows.extend(_found(group, min_words, times))
                    group, size = [], 0
            rows.extend(_found(group, min_words, times))
            yield pd.DataFrame(rows, columns=["runs", "best", "collapsed"])

    names = free_names(docs, [runs, best, collapsed, "found_runs"])
    out = once(docs, **{names[3]: found(F.col(text_col))})
    return out.select(*docs.columns, *[F.col(f"{names[3]}.{f}").alias(n) for f, n in zip(("runs", "best", "collapsed"), names)])
