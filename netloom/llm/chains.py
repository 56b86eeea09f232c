"""Fuzzy repeated passages by collinear chaining.

Seeds are word k-mers, thinned to the minimisers of windows. Each occurrence of a shared seed is matched first with the seed's
first document alone. Seeds that lie in no passage then are linked with a later one of their document, and meet all earlier documents that hold
the same link; of a link at very many places, its holders' surroundings are compared with one another. A document's matches with another are chained in order with gap costs, by a Fenwick tree
of best scores; chains are extended and aligned word by word, and those long and similar enough are passages.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import BASE, BASE_INV, DOC_BITS, BitFilter, discard, first_smallest, mix64, passed, powers, release, shuffle_partitions, steps, stored, text_steps, word_hashes

#: Words in a seed; seeds in a window, of which the smallest is taken.
WORDS, WINDOW = 5, 8
#: The least words of a passage on either side, and the least share of its words that are aligned.
PASSAGE, SIMILARITY = 50, 0.75
#: Cost of a word in a gap of a chain, counted on both sides; words to either side of a chain that alignment may add, and by how
#: many more on one text than on the other.
GAP, MARGIN, BAND = 0.1, 45, 4
SEED_BITS = 26
#: How many words later a seed's link may lie; short common lines hold no link.
LINK = (12, 36)
#: Of a link at more places, kinds of surroundings are compared, in blocks of about so many, so that no task holds them all.
MANY, MEETING = 64, 2_048
#: Words over which a strand's places may begin; its surroundings are so much longer.
STRAND = 256
#: Words that are compared at a time, by a hash.
EIGHT = 8


def find_seeds(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, word, hash) of the seeds of texts of ``least`` words or more."""
    for x, y in steps(texts):
        h, bounds = word_hashes([t.lower() for t in texts[x:y]])
        n, width = np.diff(bounds), WORDS + WINDOW - 1
        if len(h) < width:
            continue
        rolled = np.zeros(len(h) - WORDS + 1, np.uint64)
        for j in range(WORDS):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - WORDS + 1 + j]
        rolled = mix64(rolled)
        doc = np.repeat(np.arange(y - x), n)[: len(h) - width + 1]
        inside = (np.arange(len(doc)) + width <= bounds[1:][doc]) & (n[doc] >= max(least, width))
        at = np.unique(first_smallest(rolled, WINDOW)[inside])
        of = np.searchsorted(bounds, at, side="right") - 1
        yield of + x, at - bounds[of], rolled[at]


def links(doc: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For seeds in order, the hash of each with that seed of smallest hash that lies LINK words later in its document, and how many words; 0 and 0 if there is none."""
    best, key, ahead = np.full(len(h), ~np.uint64(0)), np.zeros(len(h), np.uint64), np.zeros(len(h), np.int64)
    mixed = mix64(h ^ np.uint64(0x9E6C63D0676A9A99))
    for n in range(1, LINK[1] + 1):
        if n >= len(h):
            break
        apart = at[n:] - at[:-n]
        i = np.flatnonzero((doc[n:] == doc[:-n]) & (apart >= LINK[0]) & (apart <= LINK[1]) & (mixed[n:] < best[:-n]))
        best[i], ahead[i] = mixed[i + n], apart[i]
        key[i] = mix64(h[i] * np.uint64(0x9E3779B97F4A7C15) + mixed[i + n])
    return key, ahead


def best_chains(a: np.ndarray, b: np.ndarray, weight: float = WORDS, gap: float = GAP) -> list[np.ndarray]:
    """Chains of matches (a[i], b[i]), ascending in both, as index lists, none sharing a match; the best first.

    A chain scores ``weight`` for each match less ``gap`` for each word by which its matches are apart, on both sides. With matches in order of
    a, the best predecessor has the greatest score plus gap * (a + b) among smaller b, a prefix maximum, which the Fenwick tree keeps."""
    order = np.lexsort((-b, a))
    a, b = a[order], b[order]
    if len(a) and (np.diff(a - b) == 0).all() and (np.diff(a) > 0).all() and (np.diff(a) * 2 * gap < weight).all():
        return [order]  # one diagonal without a costly gap
    ranks = (np.searchsorted(np.unique(b), b) + 1).tolist()
    size = max(ranks, default=0)
    tree = [(-np.inf, -1)] * (size + 1)
    score, before = [], []
    for i, (p, q, r) in enumerate(zip(a.tolist(), b.tolist(), ranks, strict=True)):
        best, j = -np.inf, r - 1
        from_ = -1
        while j > 0:
            if tree[j][0] > best:
                best, from_ = tree[j]
            j -= j & -j
        shift = gap * (p + q)
        gain = best - shift
        if gain > 0 and a[from_] < p:
            score.append(weight + gain)
            before.append(from_)
        else:
            score.append(weight)
            before.append(-1)
        value, j = (score[-1] + shift, i), r
        while j <= size:
            if tree[j][0] < value[0]:
                tree[j] = value
            j += j & -j
    used, out = np.zeros(len(a), bool), []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(order[chain[::-1]])
    return out


def aligned_words(a: list[int], b: list[int]) -> int:
    """Words of the longest common subsequence, by bit-parallel dynamic programming."""
    # Equal words at either end are in one of them.
    n = min(len(a), len(b))
    x = next((i for i, (v, w) in enumerate(zip(a, b, strict=False)) if v != w), n)
    y = next((i for i, (v, w) in enumerate(zip(reversed(a), reversed(b), strict=False)) if v != w), n)
    y = min(y, n - x)
    a, b = a[x : len(a) - y], b[x : len(b) - y]
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        m = v & where.get(w, 0)
        if m:
            v = ((v + m) | (v - m)) & full
    return x + y + len(a) - v.bit_count()


def fit_passage(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> tuple[int, int, int, int]:
    """The chain's ends a0:a1 and b0:b1 moved outward over equal words, and over single changed words that two equal ones follow."""
    while a0 > 0 and b0 > 0:
        if a[a0 - 1] == b[b0 - 1]:
            a0, b0 = a0 - 1, b0 - 1
        elif a0 > 2 and b0 > 2 and a[a0 - 3 : a0 - 1] == b[b0 - 3 : b0 - 1]:
            a0, b0 = a0 - 3, b0 - 3
        else:
            break
    while a1 < len(a) and b1 < len(b):
        if a[a1] == b[b1]:
            a1, b1 = a1 + 1, b1 + 1
        elif a[a1 + 1 : a1 + 3] == b[b1 + 1 : b1 + 3] and len(a) - a1 > 2 and len(b) - b1 > 2:
            a1, b1 = a1 + 3, b1 + 3
        else:
            break
    return a0, a1, b0, b1


def common_lengths(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a's and b's beginnings may end: (words of a, words of b, length of their longest common subsequence), at nothing or two equal words, within BAND."""
    same = np.zeros((len(a) + 1, len(b) + 1), bool)
    same[0, 0] = True
    same[1:, 1:] = np.equal.outer(np.array(a, np.int64), np.array(b, np.int64))
    twice = same.copy()  # one equal word may be chance
    twice[1:, 1:] &= same[:-1, :-1]
    x, y = np.nonzero(twice)
    near = np.abs(x - y) <= BAND
    x, y = x[near], y[near]
    # As in aligned_words: after y words of b, a bit is 0 where one more word of a makes the subsequence longer.
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    after = [v]
    for w in b:
        m = v & where.get(w, 0)
        v = ((v + m) | (v - m)) & full
        after.append(v)
    return x, y, np.array([i - (after[j] & (1 << i) - 1).bit_count() for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)


def align_ends(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, words: int, similarity: float) -> tuple[int, int, int, int] | None:
    """The chain's ends moved outward to runs of equal words, at most MARGIN words and BAND apart, so that ``words`` words or more on either side are similar
    enough, by the largest surplus of aligned words; None if they can't be."""
    core = aligned_words(a[a0:a1], b[b0:b1])
    before = a[max(a0 - MARGIN, 0) : a0][::-1], b[max(b0 - MARGIN, 0) : b0][::-1]
    after = a[a1 : a1 + MARGIN], b[b1 : b1 + MARGIN]
    # The tables below take long, and can't give more than this.
    if core + aligned_words(*before) + aligned_words(*after) < similarity * words - 1e-9:
        return None
    x, y, left = common_lengths(*before)
    z, w, right = common_lengths(*after)
    n_a, n_b = a1 - a0 + x[:, None] + z, b1 - b0 + y[:, None] + w
    over = core + left[:, None] + right - similarity * np.maximum(n_a, n_b)
    over = np.where(np.minimum(n_a, n_b) >= words, over, -np.inf)
    i, j = np.unravel_index(over.argmax(), over.shape)
    return (a0 - int(x[i]), a1 + int(z[j]), b0 - int(y[i]), b1 + int(w[j])) if over[i, j] >= -1e-9 else None


def passage(a: list[int], b: list[int], ends: tuple[int, int, int, int] | None, words: int, similarity: float) -> tuple[int, int, int, int, int] | None:
    """The ends with the number of aligned words, if that is a passage."""
    if ends is None or min(ends[1] - ends[0], ends[3] - ends[2]) < words:
        return None
    x, y = a[ends[0] : ends[1]], b[ends[2] : ends[3]]
    n = len(x) if x == y else aligned_words(x, y)
    return (*ends, n) if n >= similarity * max(len(x), len(y)) else None


def aligned_passage(a: list[int], b: list[int], core: tuple[int, int, int, int], words: int, similarity: float) -> tuple[int, int, int, int, int] | None:
    """The passage around a chain whose ends are ``core``, if there is one."""
    # Ends over equal words are sharper; where they don't do, changed words are aligned, of which there are no more than both sides hold.
    found = passage(a, b, fit_passage(a, b, *core), words, similarity)
    if found is None and (Counter(a) & Counter(b)).total() >= similarity * words:
        found = passage(a, b, align_ends(a, b, *core, words, similarity), words, similarity)
    return found


class Holders:
    """Which of several rows hold an item; items that a single row holds are left out."""

    def __init__(self, row: np.ndarray, item: np.ndarray, n: int) -> None:
        self.n = n
        _, item, count = np.unique(item, return_inverse=True, return_counts=True)
        some = np.flatnonzero(count[item] > 1)
        self.item, self.place = item[some], some  # in the rows' order
        held = np.unique(self.item * n + row[some])  # once for each item and row
        self.rows = held % n
        self.end = np.searchsorted(held, (np.arange(len(count)) + 1) * n)
        self.start = np.searchsorted(held, np.arange(len(count)) * n)

    def counts(self, lo: int, hi: int) -> np.ndarray:
        """How many different items at places lo to hi each row holds."""
        x, y = np.searchsorted(self.place, (lo, hi))
        parts = [self.rows[self.start[k] : self.end[k]] for k in set(self.item[x:y].tolist())]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)

    def held(self, lo: int, hi: int) -> np.ndarray:
        """Whether rows (the second index) hold the items at places lo to hi (the first)."""
        x, y = np.searchsorted(self.place, (lo, hi))
        items, of = np.unique(self.item[x:y], return_inverse=True)
        each = np.zeros((len(items), self.n), bool)
        for i, k in enumerate(items.tolist()):
            each[i, self.rows[self.start[k] : self.end[k]]] = True
        out = np.zeros((hi - lo, self.n), bool)
        out[self.place[x:y] - lo] = each[of]
        return out


def pairs_of(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Pairs of neighbouring words; a text's last word has no neighbour."""
    v = values.astype(np.int64)
    twos = np.append(v[:-1] << 32 | v[1:] & 0xFFFFFFFF, 0)
    twos[bounds[1:] - 1] = -1 - bounds[1:]
    return twos


def nth_words(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Words of texts, of which a word's second occurrence is another."""
    order = np.lexsort((values, of))
    new = np.append(True, (np.diff(of[order]) != 0) | (np.diff(values[order]) != 0))
    nth = np.empty(len(order), np.int64)
    nth[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    return values.astype(np.int64) << 16 | nth


def same_words(v: np.ndarray) -> np.ndarray:
    """How many equal words begin at each place."""
    ends = np.append(np.flatnonzero(np.diff(v) != 0), len(v) - 1) + 1
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(v))


def runs(v: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """How many equal words lie from each place on by ``step``, and a hash of the EIGHT words there (0 where fewer are left)."""
    v = v if step > 0 else v[::-1]
    same, eight, n = same_words(v), np.zeros(len(v), np.uint64), max(len(v) - EIGHT + 1, 0)
    for k in range(EIGHT):
        eight[:n] = mix64(eight[:n] + v[k : k + n].astype(np.uint64) + np.uint64(1))
    return (same, eight) if step > 0 else (same[::-1], eight[::-1])


def fit_lengths(v: np.ndarray, p: np.ndarray, q: np.ndarray, most: np.ndarray, step: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """How far ``fit_passage`` moves one end: over the words of ``v`` at p and q and on by ``step``, of which there are ``most``; ``known`` are the ``runs``."""
    same, eight = known or runs(v, step)
    out = np.zeros(len(p), np.int64)
    rows = np.flatnonzero(most > 0)
    while len(rows):
        k, left = out[rows], most[rows] - out[rows]
        x, y = p[rows] + step * k, q[rows] + step * k
        on = v[x] == v[y]
        x, y, few = x[on], y[on], left[on]
        more = np.minimum(np.minimum(same[x], same[y]), few)
        out[rows[on]] += np.where((few >= EIGHT) & (eight[x] == eight[y]), np.maximum(more, EIGHT), more)
        changed = np.flatnonzero(~on & (left > 2))
        x, y = (c[rows[changed]] + step * (k[changed] + 1) for c in (p, q))
        changed = changed[(v[x] == v[y]) & (v[x + step] == v[y + step])]
        out[rows[changed]] += 3
        on[changed] = True
        rows = rows[on]
        rows = rows[out[rows] < most[rows]]
    return out


def span_hashes(v: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """What gives hashes of the words from some places to others."""
    sums = np.append(np.uint64(0), np.cumsum(mix64(v.astype(np.uint64)) * powers(BASE, len(v)), dtype=np.uint64))
    back = powers(BASE_INV, len(v) + 1)
    return lambda x, y: mix64((sums[y] - sums[x]) * back[x]) + (y - x).astype(np.uint64)


def row_hashes(*columns: np.ndarray) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = mix64(out + c.astype(np.uint64) + np.uint64(1))
    return out


def windows(hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of texts, and behind the last, a number for the up to MARGIN words before it and one for those from it on, equal for equal words (of equal ``span_hashes``); at
    a bound between two texts, the words before it are those of the first."""
    k = np.arange(bounds[-1] + 1)
    before = np.maximum(k - MARGIN, bounds[np.maximum(np.searchsorted(bounds, k, side="left") - 1, 0)])
    behind = np.minimum(k + MARGIN, bounds[np.minimum(np.searchsorted(bounds, k, side="right"), len(bounds) - 1)])
    return tuple(np.unique(hashes(x, y), return_inverse=True)[1] for x, y in ((before, k), (k, behind)))


def end_lengths(twos: np.ndarray, p: np.ndarray, q: np.ndarray, p_most: np.ndarray, q_most: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether ``align_ends`` can add each number of words (0 to MARGIN) from p on by ``step``, which is up to two equal words, at most BAND apart; and the most from q on."""
    n = np.arange(1, MARGIN)[None, :]  # two words end with the n-th and the next
    m = np.arange(1 - BAND, MARGIN + BAND)[None, :]
    first = step * n if step < 0 else n - 1  # where they are, in the text's order
    second = step * m if step < 0 else m - 1
    x = np.where(n < p_most[:, None], twos[np.clip(p[:, None] + first, 0, len(twos) - 1)], -(1 << 62))
    y = np.where((m > 0) & (m < np.minimum(q_most, MARGIN)[:, None]), twos[np.clip(q[:, None] + second, 0, len(twos) - 1)], -(1 << 61))
    can = np.zeros((len(p), MARGIN + 1), bool)
    can[:, 0] = True
    can[:, 1] = (p_most > 0) & (q_most > 0) & (twos[p - (step > 0)] == twos[q - (step > 0)])  # with the core's own word
    most = can[:, 1].astype(np.int64)
    for s in range(2 * BAND + 1):
        same = x == y[:, s : s + n.shape[1]]
        can[:, 2:] |= same
        last = (same * (n + 1)).max(axis=1)
        most = np.maximum(most, np.where(last > 0, last + s - BAND, 0))
    return can, most


def best_surplus(before: np.ndarray, after: np.ndarray, held_before: np.ndarray, held_after: np.ndarray, core: np.ndarray, words: int, similarity: float) -> np.ndarray:
    """At most how many words more than ``similarity`` asks for can be aligned in ``words`` words or more around cores, with ends that are possible, if a word is aligned
    wherever the other text holds it."""
    n = np.arange(MARGIN + 1)
    left, right = (np.where(can, np.pad(np.cumsum(held, axis=1), ((0, 0), (1, 0))) - similarity * n, -np.inf) for can, held in ((before, held_before), (after, held_after)))
    right = np.maximum.accumulate(right[:, ::-1], axis=1)[:, ::-1]  # with so many words or more
    need = np.maximum(words - core[:, None] - n[None, :], 0)
    both = np.where(need <= MARGIN, left + np.take_along_axis(right, np.minimum(need, MARGIN), axis=1), -np.inf)
    return both.max(axis=1) + (1 - similarity) * core


def end_table(v: np.ndarray, p: np.ndarray, q: np.ndarray, p_most: np.ndarray, q_most: np.ndarray, step: int) -> tuple[np.ndarray]:
    """For many pairs at once what ``common_lengths`` gives for the words from p and q on by ``step``: for each pair and each number of words of the first (0 to MARGIN)
    the longest common subsequence, whatever the number of words of the second; less than 0 where no alignment may end."""
    k, r = np.arange(MARGIN)[:, None], len(p)
    a = np.where(k < p_most, v[np.clip(p + step * k, 0, len(v) - 1)].astype(np.int64), -(1 << 62))
    b = np.where(k < q_most, v[np.clip(q + step * k, 0, len(v) - 1)].astype(np.int64), -(1 << 61))
    out = np.full((MARGIN + 1, r), -1, np.int8)
    out[0] = 0
    row, before = np.zeros((MARGIN + 1, r), np.int8), np.zeros((MARGIN + 1, r), bool)
    before[0] = True
    for i in range(MARGIN):
        same = b == a[i]
        row[1:] = np.maximum(row[1:], row[:-1] + same)
        for j in range(2, MARGIN + 1):
            np.maximum(row[j], row[j - 1], out=row[j])
        x, y = max(i - BAND, 0), min(i + BAND + 1, MARGIN)
        out[i + 1] = np.where(same[x:y] & before[x:y], row[x + 1 : y + 1], -1).max(axis=0)
        before[0], before[1:] = False, same
    return (out.T,)


def alignable(left: np.ndarray, right: np.ndarray, core: np.ndarray, aligned: np.ndarray, words: int, similarity: float) -> np.ndarray:
    """Around which cores ``align_ends`` may find a passage; around the others it finds none. ``left``, ``right``: their ``end_table``; ``core``: how many words of the first text they
    have, of which at most ``aligned`` are aligned."""
    n = np.arange(MARGIN + 1)[:, None]
    left, right = (np.where(t < 0, -np.inf, t - similarity * n) for t in (left, right))
    right = np.maximum.accumulate(right[::-1], axis=0)[::-1]  # with so many words or more
    need = np.maximum(words - core - n, 0)
    both = np.where(need <= MARGIN, left + np.take_along_axis(right, np.minimum(need, MARGIN), axis=0), -np.inf)
    return both.max(axis=0) + aligned - similarity * core >= -1e-9


def by_pairs(f: Callable[..., tuple[np.ndarray, ...]], args: tuple, pairs: np.ndarray, most: int = 2_048) -> Callable[[np.ndarray], tuple[np.ndarray, ...]]:
    """``f`` of words, four numbers for each row and a step gives arrays with an entry for each row, equal for rows of equal ``pairs``: it is asked once for each pair, ``most``
    at a time; gives the entries of any rows."""
    _, first, of = np.unique(pairs, return_index=True, return_inverse=True)
    parts = [f(args[0], *(c[first[i : i + most]] for c in args[1:5]), args[5]) for i in range(0, len(first), most)]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return lambda r: tuple(c[of[r]] for c in columns)


def outermost(start: np.ndarray, end: np.ndarray, words: int) -> list[int]:
    """Spans in which every run of ``words`` words lies whole that lies whole in any of them; of equal ones the first."""
    order = np.lexsort((-end, start))
    order = order[np.append(True, end[order][1:] > np.maximum.accumulate(end[order])[:-1])[: len(order)]]  # in no other
    start, end, kept, i = start[order], end[order], [], 0
    while i < len(order):
        kept.append(int(order[i]))
        i = max(int(np.searchsorted(start, end[i] - words + 1, side="right")) - 1, i + 1)
    return kept


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of ``words`` words or more that a document shares with an earlier one (of smaller id), exact or changed: the id, ``source_id``,
    ``start``, ``end``, ``source_start``, ``source_end`` (in words parted by ASCII white space), ``aligned`` and ``similarity``, the words
    aligned in order against the longer side. An exact copy of a longer text is a passage of its first copy.

    A passage may also repeat an earlier one of its own document (``source_id`` is the id then), ``words`` words or more after it.

    A pair needs two seeds, which are unchanged runs of words, so passages of many changes may be missed: of passages with random substitutions
    99 % were found in a simulation at 60 words and a similarity of 0.9, and fewer near 0.75 (figures in the README).
    A passage that lies whole in passages with the first holders of its seeds has rows for those alone; any other is looked for in all earlier documents
    that hold one of its links, at every place. Of a link at more than MANY places, all holders' surroundings are aligned, MARGIN words to
    either side, and a document has rows for so many of the passages that every run of ``words`` words of one lies whole in one of them.
    Documents that share nothing have no row. Null ids, null and empty texts and texts of fewer words take no part; rows that share an id count
    as one document. Whole texts; A-Z count as a-z. An empty table gives no rows. Other columns are not read."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, texts in text_steps(batch.column(1)):
                for doc, at, h in find_seeds(texts, words):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(doc + x)), pa.array(at.astype(np.int32))], names=["h", "id", "at"])

    # A seed takes part if another document holds it, or its own does once more.
    shared = rows.mapInArrow(seeds, f"h long, id {kind}, at int").groupBy("h").agg(F.min("id").alias("source"), F.count("*").alias("n")).where("n > 1").select("h", "source")
    shared, p1 = stored(shared, "seeds")
    known = BitFilter(shared.select("h"), SEED_BITS)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, texts in text_steps(batch.column(1)):
                for doc, at, h in find_seeds(texts, words):
                    i = np.flatnonzero(known.has(h))
                    doc, at, h = doc[i], at[i], h[i]
                    key, ahead = links(doc, at, h)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(pa.array(doc + x)), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ahead.astype(np.int16))], names=["h", "id", "at", "link", "ahead"])

    found, p2 = stored(rows.mapInArrow(occurrences, f"h long, id {kind}, at int, link long, ahead short").join(shared, "h"), "occurrences")
    known.free()
    release(spark)
    # Written first, so that Spark can split the join's skewed seeds: it can't if one side comes from an aggregation.
    sources, p3 = stored(found.where("id = source").groupBy("h").agg(F.min("at").alias("b")), "sources")
    matches = found.join(sources, "h").where((F.col("id") != F.col("source")) | (F.col("at") - F.col("b") >= words)).select("id", "source", F.struct(F.col("at").alias("a"), "b").alias("m"))
    paths: list[str] = []
    result = _verified(spark, rows, kind, matches, words, similarity, paths)
    # The first holders of a seed needn't hold the passage around it. Links that lie in no passage with them meet every earlier holder, at every place.
    spans = result.groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    lies = lambda at: F.exists("spans", lambda x: (at >= x["start"]) & (at + WORDS <= x["end"]))
    inside = lies(F.col("at")) & lies(F.col("at") + F.col("ahead"))
    linked = found.where("ahead > 0").select("link", "id", "at", "ahead")
    linked = linked.join(spans, "id", "left").select("link", "id", "at", "ahead", (F.col("spans").isNull() | ~inside).alias("asks"))
    linked, p4 = stored(linked, "linked")
    per_link = linked.groupBy("link").agg(F.count("*").alias("n"), F.max("asks").alias("asked")).where("n > 1 and asked")
    per_link, p5 = stored(per_link.select("link", (F.col("n") > MANY).alias("many")), "links")
    holders, p6 = stored(linked.join(per_link, "link"), "holders")
    asking = holders.where("asks and not many").select("link", "id", "at", "ahead")
    asked = holders.where("not many").select("link", F.col("id").alias("source"), F.col("at").alias("b"), F.col("ahead").alias("on"))
    every = asking.join(asked, "link").where(_earlier(words))
    some, p7 = stored(_meeting(spark, rows, kind, holders.where("many").select("link", "id", "at", "ahead", "asks"), words, similarity, paths), "meeting")
    columns = ["id", "source", "at", "ahead", "b", "on"]
    # Of a strand's places, one for ten words.
    along = F.explode(F.expr("sequence(0, (times - 1) * gap, gap * int(ceil(10 / greatest(gap, 1))))"))
    some_places = some.withColumn("along", along).withColumn("at", F.col("at") + F.col("along")).withColumn("b", F.col("b") + F.col("along"))
    again = every.select(*columns).union(some_places.select(*columns))
    ends = F.array(F.struct(F.col("at").alias("a"), "b"), F.struct((F.col("at") + F.col("ahead")).alias("a"), (F.col("b") + F.col("on")).alias("b")))
    again = again.select("id", "source", F.explode(ends).alias("m"))
    more = _verified(spark, rows, kind, again, words, similarity, paths)
    # What was found around a single link stays if no longer chain of the same two documents has it.
    longer = more.groupBy("id", "source_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    alone = some.withColumnRenamed("source", "source_id").join(longer, ["id", "source_id"], "left")
    alone = alone.where(F.col("spans").isNull() | ~F.exists("spans", lambda x: (x["start"] <= F.col("start")) & (x["end"] >= F.col("end"))))
    result, _ = stored(result.union(more).union(alone.select(*more.columns)).distinct(), "all_passages")
    discard(spark, p1, p2, p3, p4, p5, p6, p7, *paths)
    return result.withColumnRenamed("id", id_col)


def _earlier(words: int):
    """Whether what is asked comes before what asks."""
    return (F.col("source") < F.col("id")) | ((F.col("source") == F.col("id")) & (F.col("at") - F.col("b") >= words))


def strands(holders: DataFrame) -> DataFrame:
    """Places (link, id, at, ahead, asks) of links -> (link, id, at, ahead, asks, gap, n): places in equal small steps, as in a text that says the
    same again and again, are one strand of n places, gap words apart, the first at ``at``; a place by itself is a strand with a gap of 0."""
    order = Window.partitionBy("link", "id").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    # In steps of WORDS at most, the words from a strand's first place to its last are all held by seeds.
    steps_of = holders.withColumn("step", F.col("at") - before("at")).withColumn("apart", F.coalesce((F.col("step") > WORDS) | (F.col("ahead") != before("ahead")) | (F.col("asks") != before("asks")), F.lit(True)))
    new = F.col("apart") | ((F.col("step") != before("step")) & ~before("apart"))
    numbered = steps_of.withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("strand", F.sum("new").over(order))
    numbered = numbered.withColumn("part", F.floor((F.col("at") - F.min("at").over(Window.partitionBy("link", "id", "strand"))) / STRAND))
    out = numbered.groupBy("link", "id", "strand", "part").agg(F.min("at").alias("at"), F.max("at").alias("last"), F.count("*").cast("int").alias("n"), F.min("ahead").alias("ahead"), F.min("asks").alias("asks"))
    return out.select("link", "id", "at", "ahead", "asks", F.when(F.col("n") > 1, (F.col("last") - F.col("at")) / (F.col("n") - 1)).otherwise(0).cast("int").alias("gap"), "n")


def ways(n: int, gap: int, n_y: np.ndarray, gap_y: np.ndarray, every: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In which ways a strand may lie on others: (other strand, place of the strand, of the other) at which both begin. If ``every`` is more than 1, one place of so many, and where both end."""
    few = lambda n: -(-n // every)
    y = np.repeat(np.arange(len(n_y)), few(n_y))
    j = (np.arange(len(y)) - np.repeat(np.cumsum(few(n_y)) - few(n_y), few(n_y))) * every
    i = np.zeros(len(y), np.int64)
    if n > 1:
        other = np.flatnonzero((j == 0) | (gap_y[y] != gap))
        more = np.arange(every, n, every)
        ends = np.flatnonzero((gap_y == gap) & (n_y < n)) if every > 1 else np.zeros(0, np.int64)
        y, j, i = np.concatenate((y, np.repeat(y[other], len(more)), ends)), np.concatenate((j, np.repeat(j[other], len(more)), ends * 0)), np.concatenate((i, np.tile(more, len(other)), (n - n_y)[ends]))
    return y, i, j


def meet(t: pa.Table, words: int, similarity: float) -> list[tuple]:
    """The passages of all pairs of strands of a link: (row, row of the source, word of the first place aligned, of the source's, places, start, end, source's start and end, aligned),
    words counted from the strands' first places.

    Two strands may lie on one another in as many ways as a first place may meet a place of the other; where their gaps differ, in as many as there are pairs of places."""
    ids, last_id, last_at = (t.column(c).to_pylist() for c in ("id", "last_id", "last_at"))
    if not any(last is not None for last in last_id):
        return []
    at, ahead, off, gap, n, own = (t.column(c).to_numpy().astype(np.int64) for c in ("at", "ahead", "off", "gap", "n", "own"))
    lists = t.column("w").chunk(0)
    v = lists.flatten().to_numpy()
    size, alone = pc.list_value_length(lists).to_numpy().astype(np.int64), t.column("i")[0] == t.column("j")[0]
    bounds, of = np.append(0, np.cumsum(size)), np.repeat(np.arange(len(size)), size)
    twos = pairs_of(v, bounds)
    # Made when first asked for: few rows may ask for little.
    words_of, nth_of, twos_of = (cache(lambda items=items: Holders(of, items(), len(size))) for items in (lambda: v, lambda: nth_words(v, of), lambda: twos))
    onward, backward = runs(v, 1), runs(v, -1)
    hashes_of = cache(lambda: span_hashes(v))
    windows_of = cache(lambda: windows(hashes_of(), bounds))
    w = cache(lambda k: v[bounds[k] : bounds[k + 1]].tolist())

    def beyond(x: int, start: int, end: int) -> np.ndarray:
        """Rows that x may be aligned with from before ``start``, or to behind ``end``: to two equal words."""
        return twos_of().counts(bounds[x], bounds[x] + start) + twos_of().counts(bounds[x] + end - 1, bounds[x + 1]) > 0

    out: list[tuple] = []
    for x in (x for x, last in enumerate(last_id) if last is not None):
        earlier, same = bisect_left(ids, ids[x]), bisect_right(ids, ids[x])
        last_earlier, last_same = bisect_left(ids, last_id[x]), bisect_right(ids, last_id[x])
        # A kind lies whole on itself, so later ones give nothing new to those of it that come after them.
        some = np.arange(x + 1 if size[x] >= words else 0)
        if not alone:
            some = some[own[some] != own[x]]
        spans: list[tuple[int, int]] = []

        def inside(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            """Whether every run of ``words`` words of a passage lies in one that is known."""
            new = np.ones(size[x] + 1, np.int64)
            for s, e in spans:
                new[s : e - words + 1] = 0
            new = np.append(0, np.cumsum(new))
            return new[np.maximum(end - words + 1, start)] == new[start]

        def add(r: int, found: tuple[int, int, int, int, int]) -> None:
            s, e, bs, be, aligned = found
            spans.append((s, e))
            k = int(y[r])
            out.append((x, k, int(i[r] * gap[x]), int(j[r] * gap[k]), int(times[r]), s - int(off[x]), e - int(off[x]), bs - int(off[k]), be - int(off[k]), aligned))

        # Of long strands a few ways to lie on one another first, since what they give mostly leaves nothing new to the others.
        for every in (STRAND, 8, 1) if n[x] > 1 and n[some].sum() > 2 * len(some) and n[some].sum() + n[x] * len(some) > 1_024 else (1,):
            # No alignment has more words than both hold, and only two equal words end a passage, beyond what is known or, at a single place, the link.
            many = n[some].sum() > 512  # of few, all are looked at sooner
            known = spans or ([(int(off[x]), int(off[x] + ahead[x]) + WORDS)] if n[x] == 1 and ahead[x] + WORDS < words else [])
            can = np.logical_and.reduce([beyond(x, *span) for span in known]) if known and many else np.ones(len(size), bool)
            if every == 1 and many and can[some].any():
                can &= nth_of().counts(bounds[x], bounds[x + 1]) >= similarity * words - 1e-9
            some = some[can[some] | (some == x)]  # what a kind alone holds isn't counted
            y, i, j = ways(n[x], gap[x], n[some], gap[some], every)
            y = some[y]
            apart = at[x] + i * gap[x] - at[y] - j * gap[y]
            always = (y < earlier) | ((y < same) & (apart >= words))
            later = (y < last_earlier) | ((y < last_same) & (apart + last_at[x] - at[x] >= words))
            times = np.where(gap[y] == gap[x], np.minimum(n[x] - i, n[y] - j), 1)
            a0, b0 = off[x] + i * gap[x], off[y] + j * gap[y]
            a1, b1 = a0 + (times - 1) * gap[x] + ahead[x] + WORDS, b0 + (times - 1) * gap[x] + ahead[y] + WORDS
            new = ~inside(a0 - np.minimum(a0, b0 + BAND), a1 + np.minimum(size[x] - a1, size[y] - b1 + BAND))
            rows = np.flatnonzero((always | later if every == 1 else always) & new)
            y, i, j, apart, always, times, a0, a1, b0, b1 = (c[rows] for c in (y, i, j, apart, always, times, a0, a1, b0, b1))
            left = fit_lengths(v, bounds[x] + a0 - 1, bounds[y] + b0 - 1, np.minimum(a0, b0), -1, backward)
            long = np.minimum(a1 - a0, b1 - b0) + left >= words
            rows = np.flatnonzero(~(long & inside(a0 - left, a1 + np.minimum(size[x] - a1, size[y] - b1))))
            y, i, j, apart, always, times, a0, a1, b0, b1, left = (c[rows] for c in (y, i, j, apart, always, times, a0, a1, b0, b1, left))
            p, q, u, z = bounds[x] + a0 - 1, bounds[y] + b0 - 1, bounds[x] + a1, bounds[y] + b1
            right = fit_lengths(v, u, z, np.minimum(size[x] - a1, size[y] - b1), 1, onward)
            start, end = a0 - left, a1 + right
            fits = np.minimum(a1 - a0, b1 - b0) + left + right >= words
            # Sources that come before all of the kind: of ends over equal words, so many that they hold what all do.
            able, judged, wrong = np.flatnonzero(always & fits & ~inside(start, end)), {}, np.zeros(len(y), bool)
            equal = None
            if len(able) > 16:
                # Of rows that align the same words the first is judged for all.
                key = row_hashes(start[able], end[able], hashes_of()(bounds[y[able]] + b0[able] - left[able], bounds[y[able]] + b1[able] + right[able]))
                _, one, like = np.unique(key, return_index=True, return_inverse=True)
                equal, able = (able, able[one][like]), able[np.sort(one)]
            while len(able):
                kept = able[outermost(start[able], end[able], words)].tolist()
                for r in kept:
                    if r not in judged:
                        k = y[r]
                        judged[r] = passage(w(x), w(int(k)), (int(start[r]), int(end[r]), int(b0[r] - left[r]), int(b1[r] + right[r])), words, similarity)
                if all(judged[r] for r in kept):
                    for r in kept:
                        add(r, judged[r])
                    break
                wrong[[r for r in kept if judged[r] is None]] = True
                able = able[~wrong[able]]
            if equal:
                wrong[equal[0]] = wrong[equal[1]]
        # Ends over changed words, and sources that come before some of the kind: one after the other.
        rest = ~fits | wrong | ~always
        rest[rest] = ~(fits & ~wrong & inside(start, end))[rest]
        bare = np.flatnonzero(rest & (~fits | wrong))
        if len(bare):
            # What is known by now leaves fewer.
            known = spans or known
            can = np.logical_and.reduce([beyond(x, *span) for span in known]) if known else np.ones(len(size), bool)
            if can[y[bare]].any():
                can &= nth_of().counts(bounds[x], bounds[x + 1]) >= similarity * words - 1e-9
            rest[bare[~can[y[bare]]]] = False
            bare = bare[can[y[bare]]]
            held = words_of().held(bounds[x], bounds[x + 1]) if len(bare) else None
            if len(bare):
                # Many rows have equal words around cores of equal sizes: one speaks for them, and what is known of each two surroundings is found once.
                before_of, after_of = windows_of()
                held_core = np.append(np.zeros((1, len(size)), np.int16), np.cumsum(held, axis=0, dtype=np.int16), axis=0)
                aligned = np.minimum(b1[bare] - b0[bare], held_core[a1[bare], y[bare]] - held_core[a0[bare], y[bare]])
                key = row_hashes(before_of[p[bare] + 1], before_of[q[bare] + 1], after_of[u[bare]], after_of[z[bare]], (a1 - a0)[bare], (b1 - b0)[bare], aligned)
                _, one, like = np.unique(key, return_index=True, return_inverse=True)
                r, aligned, core = bare[one], aligned[one], (a1 - a0)[bare[one]]
                sides = before_of[p[r] + 1] * len(before_of) + before_of[q[r] + 1], after_of[u[r]] * len(after_of) + after_of[z[r]]
                left_of = (v, p[r], q[r], a0[r], b0[r], -1), sides[0]
                right_of = (v, u[r], z[r], size[x] - a1[r], size[y[r]] - b1[r], 1), sides[1]
                ends = [by_pairs(end_lengths, (twos, *args[1:]), side) for args, side in (left_of, right_of)]
                fit, reach = np.zeros(len(r), bool), [np.zeros(len(r), np.int64) for _ in range(2)]
                k, n_words = np.arange(MARGIN)[None, :], np.arange(MARGIN + 1)
                for c in range(0, len(r), 2_048):
                    g = np.arange(c, min(c + 2_048, len(r)))
                    (before, before_y), (after, after_y) = (f(g) for f in ends)
                    held_before = held[np.maximum(a0[r[g]][:, None] - 1 - k, 0), y[r[g]][:, None]]
                    held_after = held[np.minimum(a1[r[g]][:, None] + k, size[x] - 1), y[r[g]][:, None]]
                    reach[0][g], reach[1][g] = (before * n_words).max(axis=1), (after * n_words).max(axis=1)
                    fit[g] = best_surplus(before, after, held_before, held_after, core[g], words, similarity) >= -1e-9
                    fit[g] &= (reach[0][g] + core[g] + reach[1][g] >= words) & (b1[r[g]] - b0[r[g]] + before_y + after_y >= words)
                start[bare], end[bare] = a0[bare] - reach[0][like], a1[bare] + reach[1][like]
                rest[bare] = fit[like] & ~inside(start[bare], end[bare])
                some_like = np.unique(like[rest[bare]])
                some_like = some_like if len(some_like) > 16 else some_like[:0]  # few are aligned sooner
                tables = [by_pairs(end_table, (args[0], *(c[some_like] for c in args[1:5]), args[5]), side[some_like]) for args, side in (left_of, right_of) if len(some_like)]
                for c in range(0, len(some_like), 2_048):
                    g = np.arange(c, min(c + 2_048, len(some_like)))
                    (left_t,), (right_t,) = (f(g) for f in tables)
                    fit[some_like[g]] = alignable(left_t.T, right_t.T, core[some_like[g]], aligned[some_like[g]], words, similarity)
                rest[bare] &= fit[like]
        order = np.flatnonzero(rest)
        # Those before all in any order, then the others from the first on.
        order = order[np.lexsort((apart[order] * -1, y[order], np.where(always[order], start[order] - end[order], 0), ~always[order]))]
        while len(order):
            r, order = int(order[0]), order[1:]
            k = int(y[r])
            found = aligned_passage(w(x), w(int(k)), (int(a0[r]), int(a1[r]), int(b0[r]), int(b1[r])), words, similarity)
            if found and not inside(np.array([found[0]]), np.array([found[1]]))[0]:
                add(r, found)
                order = order[~inside(start[order], end[order])]
    return out


def _meeting(spark: SparkSession, rows: DataFrame, kind: str, holders: DataFrame, words: int, similarity: float, paths: list[str]) -> DataFrame:
    """The passages of all pairs of holders (link, id, at, ahead, asks) of a link, as far as MARGIN words around it, with the link's places (at, ahead, b, on, and how
    many times and at what gap both hold it from there on); those whose runs of ``words`` words all lie in others may be left out. Holders are strands; those with equal
    surroundings are one kind, for which its first speaks. Kinds are dealt into blocks by a hash, and each two blocks of a link meet in one task."""
    units, p0 = stored(strands(holders), "strands")
    end = F.col("at") + (F.col("n") - 1) * F.col("gap") + F.col("ahead") + WORDS
    part, p1 = _slices(spark, rows, kind, units.select(F.col("id").alias("key"), F.col("at").alias("s"), end.alias("e")).distinct())
    around = units.withColumn("e", end).join(part.toDF("id", "at", "e", "first", "w"), ["id", "at", "e"]).withColumn("off", F.col("at") - F.col("first"))
    shape = ["ahead", "off", "gap", "n"]
    around, p2 = stored(around.withColumn("sort", F.xxhash64(*shape, "w")).select("link", "sort", "id", "at", "asks", *shape, "w"), "around")
    place = F.struct("id", "at")
    kinds = around.groupBy("link", "sort").agg(F.min(F.struct("id", "at", *shape, "w")).alias("x"), F.max(F.when(F.col("asks"), place)).alias("last"))
    kinds, p3 = stored(kinds.select("link", "sort", "x.*", F.col("last.id").alias("last_id"), F.col("last.at").alias("last_at")), "kinds")
    sizes = kinds.groupBy("link").agg(F.ceil(F.count("*") / F.lit(float(MEETING))).alias("blocks"))
    sizes, p4 = stored(sizes, "sizes")
    own = F.pmod("sort", "blocks")
    pairs = kinds.join(sizes, "link").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = pairs.select("link", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sort", "id", "at", *shape, "w", "last_id", "last_at")

    def met_of(t: pa.Table) -> pa.Table:
        t = t.sort_by([("id", "ascending"), ("at", "ascending")]).combine_chunks()
        out = meet(t, words, similarity)
        x, y, *numbers = (np.array(c, np.int64) for c in (zip(*out, strict=True) if out else [[]] * 10))
        shift, along, times, start, end, source_start, source_end, aligned = numbers
        at = t.column("at").to_numpy()[y]
        share = aligned / np.maximum(end - start, source_end - source_start)
        columns = [t.column(c).take(pa.array(k)) for c, k in (("link", x), ("sort", x), ("id", y))]
        ints = (pa.array(c.astype(np.int32)) for c in (shift, at + along, times, start, end, at + source_start, at + source_end, aligned))
        names = ["link", "sort", "source", "shift", "b", "times", "start", "end", "source_start", "source_end", "aligned", "similarity", "on"]
        return pa.Table.from_arrays([*columns, *ints, pa.array(share, pa.float64()), t.column("ahead").take(pa.array(y))], names=names)

    schema = f"link long, sort long, source {kind}, shift int, b int, times int, start int, end int, source_start int, source_end int, aligned int, similarity double, on short"
    met, p5 = stored(pairs.repartition(shuffle_partitions(spark), "link", "i", "j").groupBy("link", "i", "j").applyInArrow(met_of, schema), "met")
    # Blocks don't know of each other's: what lies in a passage with an earlier row goes.
    row = F.struct("source", "b", "on", "shift", "times", "start", "end", "source_start", "source_end", "aligned", "similarity")
    wider = "filter(m, r -> not exists(m, q -> struct(q.source, q.b - q.shift) < struct(r.source, r.b - r.shift) and q.start <= r.start and q.end >= r.end))"
    met = met.groupBy("link", "sort").agg(F.collect_list(row).alias("m")).select("link", "sort", F.explode(F.expr(wider)).alias("r")).select("link", "sort", "r.*")
    paths += [p0, p1, p2, p3, p4, p5]
    here = around.where("asks").select("link", "sort", "id", "at", "ahead", "gap").join(met, ["link", "sort"])
    here = here.withColumn("start", F.col("at") + F.col("start")).withColumn("end", F.col("at") + F.col("end")).withColumn("at", F.col("at") + F.col("shift"))
    here = here.where(_earlier(words)).drop("link", "sort", "shift")

    def widest(t: pa.Table) -> pa.Table:
        t = t.sort_by([("source", "ascending"), ("b", "ascending")])
        return t.take(pa.array(outermost(t.column("start").to_numpy(), t.column("end").to_numpy(), words), pa.int64()))

    return here.groupBy("id").applyInArrow(widest, here.schema)


def _slices(spark: SparkSession, rows: DataFrame, kind: str, asked: DataFrame) -> tuple[DataFrame, str]:
    """Parts (key, s, e) of documents with MARGIN words to either side: with the first word's place and the words' hashes; and the path they are written to."""
    # Many documents may ask for the same part of one, which is cut out once.
    by_doc = asked.groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("asks"))
    keyed = rows.select(F.xxhash64("id").alias("k"), "id", "text")
    known = BitFilter(asked.select(F.xxhash64("key").alias("k")), DOC_BITS)
    texts = passed(keyed, known, True).select("id", "text").join(by_doc.withColumnRenamed("key", "id"), "id")

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            per, flat = np.diff(lists.offsets.to_numpy()), lists.flatten()
            s, e = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            ends = np.cumsum(per)
            for x, y, t in text_steps(batch.column(1)):
                h, bounds = word_hashes([v.lower() for v in t])
                low = (h >> np.uint64(33)).astype(np.int32)
                some = slice(ends[x] - per[x], ends[y - 1])
                doc = np.repeat(np.arange(y - x), per[x:y])
                a = np.maximum(bounds[doc] + s[some] - MARGIN, bounds[doc])
                z = np.minimum(bounds[doc] + e[some] + MARGIN, bounds[doc + 1])
                for i in range(0, len(doc), 5_000):
                    j = slice(i, i + 5_000)
                    w = pa.array([low[p:q] for p, q in zip(a[j], z[j], strict=True)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[j] + x)), pa.array(s[some][j]), pa.array(e[some][j]), pa.array((a - bounds[doc])[j].astype(np.int32)), w], names=["key", "s", "e", "first", "w"])

    part = texts.select("id", "text", "asks").mapInArrow(slices, f"key {kind}, s int, e int, first int, w array<int>")
    part, path = stored(part, "slices")
    known.free()
    release(spark)
    return part, path


def _verified(spark: SparkSession, rows: DataFrame, kind: str, matches: DataFrame, words: int, similarity: float, paths: list[str]) -> DataFrame:
    """The passages of matches (id, source, m: struct of the words a and b where they lie); what is written meanwhile is added to ``paths``."""
    pairs = matches.groupBy("id", "source").agg(F.collect_set("m").alias("m")).where(F.size("m") > 1)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values
            a, b = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out = []
            for i in range(batch.num_rows):
                s = slice(bounds[i], bounds[i + 1])
                for n, c in enumerate(best_chains(a[s], b[s])):
                    x, y = a[s][c], b[s][c]
                    if len(c) > 1 and x[-1] - x[0] + WORDS + 2 * MARGIN >= words and y[-1] - y[0] + WORDS + 2 * MARGIN >= words:
                        out.append((i, n, x[0], x[-1] + WORDS, y[0], y[-1] + WORDS))
            if out:
                i, *rest = (np.array(v) for v in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i)), *(pa.array(v.astype(np.int32)) for v in rest)], names=["id", "source", "n", "a0", "a1", "b0", "b1"])

    chains, p3 = stored(pairs.mapInArrow(chain, f"id {kind}, source {kind}, n int, a0 int, a1 int, b0 int, b1 int"), "chains")
    release(spark)
    asked = chains.select(F.col("id").alias("key"), F.col("a0").alias("s"), F.col("a1").alias("e")).union(chains.select("source", "b0", "b1")).distinct()
    part, p4 = _slices(spark, rows, kind, asked)
    left = part.toDF("id", "a0", "a1", "fa", "wa")
    right = part.toDF("source", "b0", "b1", "fb", "wb")
    both = chains.join(left, ["id", "a0", "a1"]).join(right, ["source", "b0", "b1"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (a0, a1, b0, b1, fa, wa, fb, wb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a0", "a1", "b0", "b1", "fa", "wa", "fb", "wb")), strict=True)):
                found = aligned_passage(wa, wb, (a0 - fa, a1 - fa, b0 - fb, b1 - fb), words, similarity)
                if found:
                    a0, a1, b0, b1, n = found
                    out.append((i, a0 + fa, a1 + fa, b0 + fb, b1 + fb, n, n / max(a1 - a0, b1 - b0)))
            if out:
                i, *rest, share = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(i)), batch.column("source").take(pa.array(i)), *(pa.array(v, pa.int32()) for v in rest), pa.array(share)], names=["id", "source_id", "start", "end", "source_start", "source_end", "aligned", "similarity"])

    result = both.mapInArrow(align, f"id {kind}, source_id {kind}, start int, end int, source_start int, source_end int, aligned int, similarity double").distinct()
    result, path = stored(result, "passages")
    discard(spark, p3, p4)
    paths.append(path)
    return result
