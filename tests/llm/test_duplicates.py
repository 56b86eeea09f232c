import random

import numpy as np
import pytest

from netloom.llm import minhash, suffixes
from netloom.llm.chains import aligned_words, best_chains, repeated_passages
from netloom.llm.components import connected_components
from netloom.llm.minhash import near_duplicates
from netloom.llm.suffixes import remove_repeats


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()) + str(rng.randint(0, 60)) for _ in range(n)]


def texts_of(seed: int) -> list[tuple]:
    """Families of near copies of different degrees, exact copies, short and odd texts."""
    rng, rows = random.Random(seed), []
    for _ in range(6):
        base = words(rng, rng.randint(30, 90))
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words(rng, 3))
            rows.append(" ".join(copy))
    rows += [rows[0], rows[0].upper(), rows[1].replace(" ", "\n\t"), None, "", "   ", "one", "one two", "ONE two", "a b c d e", "ünï cödé wörds hère nöw x"]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


def shingle_set(t):
    import re

    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j])
            if i < j and n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), min(x for x in sets if find(x) == find(i))) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1])
def test_near_duplicates_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(minhash, "CELL_BLOCK", 4)
    rows = texts_of(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' id", "0 n", "0 key")
    got = near_duplicates(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_second_round_alone_equals_brute_force(spark):
    """Without the first round's links, the cells must find every component."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.concatenate((rng.choice(base, k := int(rng.integers(48, 59)), replace=False), rng.integers(0, 1 << 40, 60 - k)))) for _ in range(40)]
    values, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
    every = np.arange(40)
    links = minhash._links_of(every, every, sizes, values, every[:20], every[20:], 75)
    links += minhash._links_of(every, every, sizes, values, every[:20], every[:20], 75) + minhash._links_of(every, every, sizes, values, every[20:], every[20:], 75)

    def parts(pairs):
        root = list(range(40))
        for _ in range(40):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    true = [(i, j) for i in range(40) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 75 * len(set(sets[i]) | set(sets[j]))]
    assert true and parts(links) == parts(true)


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, percent=50)


def test_min_max_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64) for n in (600, 100, 100))
    flat = np.concatenate((np.sort(np.r_[both, a]), np.sort(np.r_[both, b])))
    sig = minhash.signatures(flat, np.array([0, 700, 1400]))
    assert abs((sig[0] == sig[1]).mean() - 600 / 800) < 0.1


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(5, 9), (9, 7), (1, 1), (100, 90), (90, 95)] + [(200, i) for i in range(201, 260)]
    got = {r.v: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {5: 5, 9: 5, 7: 5, 90: 90, 95: 90, 100: 90} | {i: 200 for i in range(200, 260)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length):
    from collections import Counter

    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("crowd", [16_384, 2])
def test_repeats_equal_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "SORTED", 20_000)
    monkeypatch.setattr(suffixes, "SUFFIXES", 1_000)
    rng, length = random.Random(1), 100
    shared = [" ".join(words(rng, 40)) for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [" ".join(words(rng, rng.randint(0, 30))) for _ in range(3)]
        if i % 2:
            s = rng.choice(shared)
            at = rng.randint(0, len(s) // 2)
            parts.insert(1, s[at : at + rng.randint(60, 260)])
        rows.append((i, " ".join(parts)))
    rows += [(50, "é" * 300), (51, "ab" * 400), (52, None), (53, ""), (54, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (55, "x" * 99), (56, "x" * 100), (57, "x" * 101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 spans", "2 key", "3 kept")
    got = remove_repeats(df, length=length).collect()
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in got) == sorted((str(i), k) for (i, _), k in zip(rows, brute_repeats(rows, length)))
    for r in got:
        assert r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept)
    assert remove_repeats(df.limit(0), length=length).count() == 0


def test_radix_equals_brute_force():
    from collections import Counter

    rng = random.Random(1)
    raw = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    start, group = np.array([rng.randrange(2900) for _ in range(600)]), np.array([rng.randrange(3) for _ in range(600)])
    for length in (8, 9, 13, 24):
        windows = [(g, raw[s : s + length].tobytes()) for g, s in zip(group, start)]
        seen = Counter(windows)
        assert suffixes.radix(raw, start, group, length).tolist() == [seen[w] > 1 for w in windows]


def test_long_text_in_pieces(spark, monkeypatch):
    rng, length = random.Random(9), 100
    text = " ".join(words(rng, 900))
    rows = [(1, text + text[500:900]), (2, text[2000:2400])]
    a = list(suffixes.find_anchors([t.encode() for _, t in rows], length, 40))
    monkeypatch.setattr(suffixes, "PIECE", 700)
    b = list(suffixes.find_anchors([t.encode() for _, t in rows], length, 40))
    cover = lambda x: {(d, p) for k in x for d, at, lo, hi in zip(k.doc, k.at, k.low, k.high) for p in range(at - hi, at - lo + 1)}
    assert cover(a) == cover(b) == {(d, p) for d, (_, t) in enumerate(rows) for p in range(len(t) - length + 1)}


@pytest.mark.parametrize("text", ["a b c", "a", "a b c d e"])
def test_a_single_short_document(spark, text):
    assert [len(x) for x in minhash.shingles([text.encode()])] == [1, 2]
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(df).collect()] == [(1, 1, True)]


def test_chains_and_alignment():
    rng = random.Random(2)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(50):
        a, b = ([rng.randint(0, 6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert aligned_words(a, b) == lcs(a, b)
        n = rng.randint(1, 25)
        x, y = np.array([rng.randint(0, 40) for _ in range(n)]), np.array([rng.randint(0, 40) for _ in range(n)])
        chains = best_chains(x, y)
        assert sorted(i for c in chains for i in c) == list(range(n))
        for c in chains:
            assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()
        # The best chain's score is the best there is.
        order = sorted(range(n), key=lambda i: (x[i], y[i]))
        best = {}
        for i in order:
            best[i] = 5 + max([0, *(best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i])])
        score = lambda c: 5 * len(c) - 0.1 * sum((x[b] - x[a]) + (y[b] - y[a]) for a, b in zip(c, c[1:]))
        assert score(list(chains[0])) == pytest.approx(max(best.values()))


def test_passages(spark):
    rng = random.Random(5)
    passage = words(rng, 80)
    changed = list(passage)
    for i in range(7, 80, 12):
        changed[i] = "changed" + str(i)
    texts = [words(rng, 60) + passage + words(rng, 30), words(rng, 20) + changed + words(rng, 40), words(rng, 150), passage[:30] + words(rng, 60), passage]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9, " ".join(texts[2])), (10, None), (11, ""), (None, " ".join(passage))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "2 source")
    got = {(r.doc_id, r.source_id): r for r in repeated_passages(df).collect()}
    assert set(got) == {(1, 0), (4, 0), (9, 2)}
    one = got[(1, 0)]
    assert abs(one.start - 20) <= 3 and abs(one.end - 100) <= 3 and one.similarity >= 0.75 and got[(9, 2)].similarity == 1
    assert repeated_passages(df.limit(0)).count() == 0


def test_passage_whose_pieces_are_in_earlier_documents(spark):
    rng = random.Random(8)
    p = words(rng, 60)
    docs = {1: words(rng, 60) + p[:45], 2: p[15:] + words(rng, 60), 3: p[:45] + words(rng, 60), 4: words(rng, 60) + p[15:], 5: words(rng, 30) + p, 9: p + words(rng, 40)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id long, text string")
    got = [(r.doc_id, r.source_id, r.start, r.end, r.source_start, r.source_end) for r in repeated_passages(df).collect()]
    assert got == [(9, 5, 0, 60, 30, 90)]
    again = spark.createDataFrame([(1, " ".join(p[:30] + words(rng, 60) + p)), (2, " ".join(p))], "doc_id long, text string")
    assert [(r.doc_id, r.source_id, r.source_start, r.source_end) for r in repeated_passages(again).collect()] == [(2, 1, 90, 150)]


def test_passages_of_many_changes(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        p = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        q = list(p)
        for i in rng.sample(range(60), 9):
            q[i] = f"x{rng.randrange(10**6)}"
        noise = [[f"n{rng.randrange(10**6)}" for _ in range(50)] for _ in range(4)]
        rows += [(2 * k, " ".join(noise[0] + p + noise[1])), (2 * k + 1, " ".join(noise[2] + q + noise[3]))]
    got = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.source_id == r.doc_id - 1 and r.end - r.start >= 50 and r.similarity >= 0.75 for r in got)
    assert len({r.doc_id for r in got}) >= 36
