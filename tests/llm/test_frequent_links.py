import random

import numpy as np
import pyarrow as pa

from netloom.llm import chains
from netloom.llm.chains import repeated_passages


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, w, first):
    """Every fourth word is another, so that no run of five words stays."""
    return [f"x{rng.randrange(10**6)}" if i % 4 == first else x for i, x in enumerate(w)]


def pairs_around_a_line(rng, n):
    """Documents around one line; each two neighbours share more than the line, and nothing but the line unbroken."""
    line, docs = words(rng, 34), []
    for _ in range(n):
        a, b = words(rng, 16), words(rng, 16)
        docs += [words(rng, 30) + a + line + b + words(rng, 30), words(rng, 20) + changed(rng, a, 3) + line + changed(rng, b, 0) + words(rng, 40)]
    return line, docs


def test_all_holders_of_a_very_frequent_link_meet(spark, monkeypatch):
    for meeting in (chains.MEETING, 16):
        monkeypatch.setattr(chains, "MEETING", meeting)
        docs = pairs_around_a_line(random.Random(3), 60)[1]
        got = repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect()
        assert {(r.doc_id, r.source_id) for r in got} >= {(i + 1, i) for i in range(0, 120, 2)}
        assert all(r.source_id < r.doc_id and r.end - r.start >= 50 and r.similarity >= 0.75 for r in got)


def test_a_link_is_looked_for_at_every_place(spark):
    rng = random.Random(4)
    line, (x, y) = pairs_around_a_line(rng, 1)
    text = words(rng, 60) + line + words(rng, 60) + x + words(rng, 60) + line + words(rng, 60)
    (r,) = repeated_passages(spark.createDataFrame([(1, " ".join(text)), (2, " ".join(y))], "doc_id long, text string")).collect()
    assert (r.doc_id, r.source_id) == (2, 1) and 150 <= r.source_start and r.source_end <= 300


def test_places_in_equal_steps_are_one_strand(spark):
    places = [(1, 7, a, 12, True) for a in (3, 4, 5, 6, 20, 23, 26, 90)] + [(1, 8, 5, 12, True), (1, 8, 6, 13, True), (2, 7, 7, 12, False)]
    got = chains.strands(spark.createDataFrame(places, "link long, id long, at int, ahead short, asks boolean")).collect()
    assert sorted((r.link, r.id, r.at, r.gap, r.n) for r in got) == [(1, 7, 3, 1, 4), (1, 7, 20, 3, 3), (1, 7, 90, 0, 1), (1, 8, 5, 0, 1), (1, 8, 6, 0, 1), (2, 7, 7, 0, 1)]
    long = chains.strands(spark.createDataFrame([(1, 7, a, 12, True) for a in range(3 * chains.STRAND)], "link long, id long, at int, ahead short, asks boolean"))
    assert sorted((r.at, r.n) for r in long.collect()) == [(i * chains.STRAND, chains.STRAND) for i in range(3)]


def test_runs_of_one_word_are_found_whole_wherever_they_lie(spark):
    rng = random.Random(5)
    docs = [words(rng, 20) + ["spam"] * rng.randrange(60, 400) + words(rng, 20) for _ in range(12)]
    got = repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")).collect()
    held = [{p for r in got if r.doc_id == i for p in range(r.start, r.end - 49)} for i in range(len(docs))]
    assert all(held[i] >= set(range(20, len(t) - 69)) for i, t in enumerate(docs[1:], 1))
    assert all((r.source_id, r.source_start + 49) < (r.doc_id, r.start) for r in got)


def test_bounds_of_ends_hold_for_every_alignment():
    rng, tried = random.Random(6), 0
    one = lambda n: np.array([n])
    for _ in range(1500):
        a, b = ([rng.randrange(rng.choice((2, 3, 6))) for _ in range(rng.randrange(20, 80))] for _ in range(2))
        a0, b0 = rng.randrange(5, len(a) - 8), rng.randrange(1, len(b) - 8)
        b[b0 : b0 + 5] = a[a0 : a0 + 5]
        core, v, at = (a0, a0 + 5, b0, b0 + 5), np.array(a + b, np.int32), len(a)
        before, after = (one(a0 - 1), one(at + b0 - 1), one(a0), one(b0), -1), (one(a0 + 5), one(at + b0 + 5), one(len(a) - a0 - 5), one(len(b) - b0 - 5), 1)
        more = [int(chains.fit_lengths(v, p, q, np.minimum(n, m), step)[0]) for p, q, n, m, step in (before, after)]
        assert chains.fit_passage(a, b, *core) == (a0 - more[0], a0 + 5 + more[1], b0 - more[0], b0 + 5 + more[1])
        found = chains.align_ends(a, b, *core, 20, 0.75)
        if not found:
            continue
        tried += 1
        twos = chains.pairs_of(v, np.array([0, at, at + len(b)]))
        (can_before, most_before), (can_after, most_after) = chains.end_lengths(twos, *before), chains.end_lengths(twos, *after)
        assert can_before[0, a0 - found[0]] and can_after[0, found[1] - a0 - 5] and most_before[0] >= b0 - found[2] and most_after[0] >= found[3] - b0 - 5
        held, k = np.isin(a, b), np.arange(chains.MARGIN)
        best = chains.best_surplus(can_before, can_after, held[np.maximum(a0 - 1 - k, 0)][None], held[np.minimum(a0 + 5 + k, at - 1)][None], one(5), 20, 0.75)[0]
        assert best >= chains.aligned_words(a[found[0] : found[1]], b[found[2] : found[3]]) - 0.75 * max(found[1] - found[0], found[3] - found[2]) - 1e-9
    assert tried > 50


def strands_of_a_pair(rng, sizes, kinds_of_words=40):
    """What ``meet`` reads of documents that say two words again and again, sizes of them times, between other words."""
    rows = []
    for i, n in enumerate(sizes):
        sides = [[rng.randrange(2, kinds_of_words) for _ in range(chains.MARGIN)] for _ in range(2)]
        rows.append({"id": i, "at": 100, "ahead": 12, "off": chains.MARGIN, "gap": 2, "n": n - 8, "own": 0, "i": 0, "j": 0, "last_id": i, "last_at": 100, "w": sides[0] + [0, 1] * n + sides[1]})
    kinds = [("id", pa.int64()), *((c, pa.int32()) for c in ("at", "ahead", "off", "gap", "n", "last_at")), *((c, pa.int64()) for c in ("own", "i", "j", "last_id")), ("w", pa.list_(pa.int32()))]
    return pa.Table.from_pylist(rows, schema=pa.schema(kinds))


def test_strands_that_meet_cover_what_all_ways_do():
    t = strands_of_a_pair(random.Random(7), (20, 31, 26, 40, 33, 12, 60, 11, 60))
    got = {(x, p + chains.MARGIN) for x, _, _, _, _, start, end, *_ in chains.meet(t, 50, 0.75) for p in range(start, end - 49)}
    want, rows = set(), t.to_pylist()
    for x, a in enumerate(rows):
        for b in rows[:x]:
            for i, j in [(0, j) for j in range(b["n"])] + [(i, 0) for i in range(1, a["n"])]:
                length = (min(a["n"] - i, b["n"] - j) - 1) * 2 + 12 + chains.WORDS
                a0, b0 = chains.MARGIN + 2 * i, chains.MARGIN + 2 * j
                if found := chains.aligned_passage(a["w"], b["w"], (a0, a0 + length, b0, b0 + length), 50, 0.75):
                    want |= {(x, p) for p in range(found[0], found[1] - 49)}
    assert got >= want and len(want) > 100


def test_few_ways_in_which_strands_may_meet_are_looked_at(monkeypatch):
    rng, looked = random.Random(8), []
    fit = chains.fit_lengths
    monkeypatch.setattr(chains, "fit_lengths", lambda v, p, *more: looked.append(len(p)) or fit(v, p, *more))
    t = strands_of_a_pair(rng, [rng.randrange(100, 130) for _ in range(60)], 10**6)
    assert {x for x, *_ in chains.meet(t, 50, 0.75)} == set(range(60))  # the first repeats itself
    assert sum(looked) < 60 * 60 * 20  # all ways are about 200 for each two


def test_ends_that_cannot_be_aligned_are_ruled_out_together():
    rng, rows = random.Random(9), []
    for _ in range(400):
        kinds = rng.choice((2, 3, 6, 20))
        a, b = ([rng.randrange(kinds) for _ in range(rng.randrange(20, 140))] for _ in range(2))
        a0, b0 = rng.randrange(len(a) - 8), rng.randrange(len(b) - 8)
        b[b0 : b0 + 5] = a[a0 : a0 + 5]
        rows.append((a, b, a0, b0, chains.align_ends(a, b, a0, a0 + 5, b0, b0 + 5, 50, 0.75) is not None))
    v = np.array([w for a, b, *_ in rows for w in a + b], np.int32)
    at = np.cumsum([0] + [len(a) + len(b) for a, b, *_ in rows])[:-1]
    n_a, n_b, a0, b0 = (np.array(c) for c in zip(*((len(a), len(b), x, y) for a, b, x, y, _ in rows), strict=True))
    p, q = at + a0, at + n_a + b0
    left, right = chains.end_table(v, p - 1, q - 1, a0, b0, -1)[0].T, chains.end_table(v, p + 5, q + 5, n_a - a0 - 5, n_b - b0 - 5, 1)[0].T
    can, found = chains.alignable(left, right, np.full(len(rows), 5), np.full(len(rows), 5), 50, 0.75), np.array([r[-1] for r in rows])
    assert can[found].all() and found.sum() > 20 and can.sum() < 2 * found.sum()
