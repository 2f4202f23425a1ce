"""The pipeline's near-duplicate stage against brute force on pairs of similarity 0.8 to 0.95."""

import random

import corpus_pipeline
from hourgrain.llm import near
from tests.llm.test_text import EDGES, documents, groups


def brute_set(text):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[i:] for i in range(5)))) if len(words) >= 5 else {tuple(words)} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_copies(rng, n, first):
    """n texts, each followed by a copy with some words replaced."""
    rows = []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = list(words)
        for at in rng.sample(range(300), rng.randint(1, 9)):
            copy[at] = "Edited"
        rows += [(first + 2 * i, " ".join(words)), (first + 2 * i + 1, " ".join(copy))]
    return rows


def test_near_stage_equals_brute_force(spark):
    rng = random.Random(3)
    rows = edited_copies(rng, 150, 100)
    sets = {i: brute_set(t) for i, t in rows}
    near_pairs = [(a, a + 1) for a in range(100, 400, 2) if jaccard(sets[a], sets[a + 1]) >= 0.8]
    assert sum(0.8 <= jaccard(sets[a], sets[b]) <= 0.95 for a, b in near_pairs) > 60 and len(near_pairs) < 150
    want = groups(list(sets), near_pairs)
    left = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, *rows), "").collect()}
    assert left == set(want.values())


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(200):  # more than SMALL nodes in a bucket, each one edit from the common text
        own = list(words)
        own[rng.randrange(400)] = f"edit{i}"
        rows.append((i + 10, " ".join(own)))
    assert {r["component_id"] for r in near.near_duplicates(documents(spark, *rows)).collect()} == {10}


def family(rng, size, pairs, unlike):
    """Texts of one template, each pair below the threshold, and ``pairs`` copies of some that are above it."""
    template = [f"w{rng.randrange(5000)}" for _ in range(400)]
    rows = []
    for i in range(size):
        own = list(template)
        for k, at in enumerate(rng.sample(range(2, 398, 6), unlike)):
            own[at] = f"own{i}x{k}"
        rows.append(own)
    for i in range(pairs):
        copy = list(rows[i])
        for at in rng.sample(range(400), rng.choice((2, 5, 8))):
            copy[at] = f"copy{i}"
        rows.append(copy)
    return [(i + 10, " ".join(words)) for i, words in enumerate(rows)]


def test_near_duplicates_in_a_family_below_the_threshold(spark):
    rows = family(random.Random(9), 150, 60, 6)
    sets = {i: brute_set(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.8]
    alike = [jaccard(sets[a], sets[b]) for a in range(10, 60) for b in range(a + 1, 60)]
    assert 0.65 < sum(alike) / len(alike) < 0.8 and len(pairs) >= 60 and sum(jaccard(sets[i + 10], sets[i + 160]) >= 0.8 for i in range(60)) == 60
    want = groups(list(sets), pairs)
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(documents(spark, *rows)).collect()}
    assert got == want


def test_near_duplicates_edges(spark):
    rows = [tuple(r) for r in near.near_duplicates(documents(spark, *EDGES)).collect()]
    assert sorted(rows, key=str) == sorted([(1, 1), (2, 1), (None, 3), (3, 3), (3, 3), (4, 4), (5, 5)], key=str)
    assert near.near_duplicates(documents(spark, *EDGES).limit(0)).count() == 0


def test_simhash_proposes_pairs_of_its_own(spark, monkeypatch):
    rng = random.Random(7)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(5000)}" for _ in range(2000)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    monkeypatch.setattr(near, "candidates", lambda met: met.select("node", "node").toDF("a", "b").limit(0))  # no band proposes any
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(documents(spark, *rows)).collect()}
    prints = {i: near.simhash.majority(near.shingles(t, 5)) for i, t in rows}
    close = [i for i in range(0, 40, 2) if bin((prints[i] ^ prints[i + 1]) & (1 << 64) - 1).count("1") <= 2]
    assert len(close) > 10 and all(got[i] == got[i + 1] == i for i in close)
