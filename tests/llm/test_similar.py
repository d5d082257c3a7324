"""The pipeline's near-dedup stage against brute force over planted near copies."""

import random

import numpy as np

import corpus_pipeline
from lantern.llm import similar


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    pick = random.Random(7)
    words = lambda n: [f"w{pick.randrange(5000)}" for _ in range(n)]
    licence = " ".join(words(30))
    texts = [" ".join(words(pick.randrange(80, 200))) + " " + licence for _ in range(120)]
    for base in texts[:100]:
        for _ in range(3):
            copy = base.split()
            for at in pick.sample(range(len(copy)), pick.randrange(1, 6)):
                copy[at] = f"x{pick.randrange(10**6)}"
            texts.append(" ".join(copy))
    for n in (1020, 1800, 2060, 4100):  # long texts, about the sizes at which the parity bits double
        base = words(n)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            copy = base[: n - pick.randrange(40)]
            for at in pick.sample(range(len(copy)), int(n * share)):
                copy[at] = f"x{pick.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), "", " ", "one two", "One  two", licence]
    pick.shuffle(texts)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    edited = 0
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                edited += sets[a] != sets[b]
                low, high = sorted((find(a), find(b)))
                root[high] = low
    assert edited > 50
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert got == [i for i in range(len(texts)) if find(i) == i]


def test_parity_bits_never_differ_in_more_places_than_the_sets():
    draw = np.random.default_rng(3)
    for n in (1, 5, 60, 400, 3000, 20_000):
        for edits in (0, 1, n // 20, n // 9):
            x = np.unique(draw.integers(0, 1 << 64, n, np.uint64))
            y = np.unique(np.concatenate((x[edits:], draw.integers(0, 1 << 64, edits, np.uint64))))
            wide = [similar.parity(x), similar.parity(y)]
            for bits in (wide, [similar.folded(b) for b in wide]):
                if len(bits[0]) == len(bits[1]):
                    assert np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum() <= len(np.setxor1d(x, y))
            assert 64 * len(wide[0]) >= len(x) and len(similar.folded(wide[0])) == similar.PARITY_LONGS


def test_all_parity_bits_leave_every_pair_that_reaches_the_coefficient(spark):
    draw = np.random.default_rng(5)
    sets, near = [], set()
    for n in (40, 1000, 1024, 1100, 2040, 2300, 4090, 8300):
        base = draw.integers(0, 1 << 64, n, np.uint64)
        for cut, added in ((0, 0), (n // 10, 0), (n // 5, 0), (0, n // 4), (n // 18, n // 18), (n // 2, n // 2)):
            sets.append(np.unique(np.concatenate((base[cut:], draw.integers(0, 1 << 64, added, np.uint64)))))
    pairs = [(a, b) for b in range(len(sets)) for a in range(b)]
    for a, b in pairs:
        both = len(np.intersect1d(sets[a], sets[b]))
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            near.add((a, b))
    points = spark.createDataFrame([(i, len(x), similar.parity(x).tolist()) for i, x in enumerate(sets)], "sig long, n long, wide array<long>")
    left = {(r["a"], r["b"]) for r in similar._widely_alike(spark.createDataFrame(pairs, "a long, b long"), points).collect()}
    assert len(near) > 40 and near <= left and len(left) < len(pairs) // 4
