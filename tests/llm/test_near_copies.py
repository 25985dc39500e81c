import random
from itertools import combinations

import numpy as np
import pytest

from clausewright.llm import near_copies as n
from clausewright.llm.base import Words

WORDS = [f"w{k}" for k in range(3000)]


def corpus(seed, size=120):
    rng = random.Random(seed)
    texts = []
    for k in range(size):
        base = [rng.choice(WORDS) for _ in range(rng.randint(20, 60))]
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(copy)
    return [" ".join(t) for t in texts]


def truth(texts, similar=0.7):
    make = Words()
    sets = {}
    for k, t in enumerate(texts):
        w = make(t)
        if len(w) >= 20:
            sets[k] = set(zip(w, w[1:], w[2:]))
    return {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])}


def pairs(links, members):
    rows = [(r.id, r.row_id) for r in members.collect()]
    by = {}
    for i, r in rows:
        by.setdefault(i, []).append(r)
    out = {tuple(sorted(p)) for ids in by.values() for p in combinations(set(ids), 2)}
    return out | {tuple(sorted((x, y))) for link in links.collect() for x in by[link.a] for y in by[link.b]}


@pytest.mark.parametrize("block", [n.BLOCK, 2])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(n, "BLOCK", block)
    texts = corpus(1)
    rows = spark.createDataFrame([("f", k, t, "x") for k, t in enumerate(texts)] + [("f", 0, texts[0], "again"), ("f", 9001, None, "x"), ("f", 9002, "", "x"), ("f", 9003, "too few words", "x")], "field string, row_id bigint, text string, class string")
    links, members = n.near_copies(rows)
    assert pairs(links, members) == truth(texts)
    assert {r.row_id for r in members.collect()} == set(range(len(texts)))


def test_fields_are_kept_apart(spark):
    text = " ".join(WORDS[:40])
    links, members = n.near_copies(spark.createDataFrame([("a", 1, text), ("b", 2, text)], "field string, row_id bigint, text string"))
    assert links.count() == 0 and members.select("id").distinct().count() == 2


def test_trie_against_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, (90, 2), dtype=np.uint64)
    flipped = base.copy()
    flipped[np.arange(90), rng.integers(0, 2, 90)] ^= np.uint64(1) << rng.integers(0, 63, 90, dtype=np.uint64)
    far = base[:60].copy()
    far[:, 1] ^= np.uint64((1 << 36) - 1)
    far[:30, 1] ^= np.uint64(1)
    sketches = np.concatenate([base, flipped, np.repeat(base[:1], 70, axis=0), far])
    ids = np.arange(len(sketches))
    count = lambda a, b: int(np.bitwise_count(sketches[a] ^ sketches[b]).sum())
    near = {(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if count(a, b) <= n.BUDGET}
    assert len({count(a, 250 + a) for a in range(60)}) == 2
    for leaf in (1, 8, 64):
        found = [tuple(sorted(p)) for p in n.trie_join(ids, sketches, leaf=leaf)]
        assert set(found) == near and len(found) == len(near)
        split = [tuple(sorted(p)) for p in n.trie_join(ids, sketches, split=60, leaf=leaf)]
        assert set(split) == {p for p in near if (p[0] < 60) != (p[1] < 60)} and len(split) == len(set(split))


@pytest.mark.parametrize("salted", [True, False])
def test_a_band_of_fifty_thousand_rows(spark, monkeypatch, salted):
    """All pairs within the budget come out, whether the band is salted from the start or cut as it streams by."""
    monkeypatch.setattr(n, "MOST_HOT", 20_000 if salted else 10)
    monkeypatch.setattr(n, "SAMPLE", 5_000)
    rng = np.random.default_rng(7)
    sketches = rng.integers(-(2**63), 2**63, (50_000, 2), dtype=np.int64)
    near = rng.choice(25_000, 2_000, replace=False)
    sketches[near + 25_000] = sketches[near] ^ 7
    rows = spark.createDataFrame([(k, high, low, [5, 100 + k]) for k, (high, low) in enumerate(sketches.tolist())] * 1 + [(0, *sketches[0].tolist(), [5, 100])], "id bigint, high bigint, low bigint, bands array<bigint>").repartition(8)
    assert (n._hot(rows, n.F.explode("bands"), n.SAMPLE, n.MOST_HOT) is not None) == salted
    bits, truth = sketches.view(np.uint64), set()
    for at in range(0, 50_000, 500):
        part = bits[at : at + 500]
        x, y = np.nonzero(np.bitwise_count(part[:, None, 0] ^ bits[None, at:, 0]) + np.bitwise_count(part[:, None, 1] ^ bits[None, at:, 1]) <= n.BUDGET)
        truth |= {(at + int(i), at + int(k)) for i, k in zip(x, y, strict=True) if i < k}
    assert {tuple(r) for r in n.candidate_pairs(rows).collect()} == truth and len(truth) >= 2_000


def test_large_classes_are_expanded_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 7)
    members = spark.createDataFrame([("f", k, 1) for k in range(40)] + [("f", 100 + k, 2) for k in range(20)] + [("f", 200, 3)], "field string, row_id bigint, id bigint")
    links = spark.createDataFrame([(1, 2, 0.8), (2, 3, 0.8)], "a bigint, b bigint, share double")
    of = {1: range(40), 2: range(100, 120), 3: [200]}
    want = {tuple(sorted(p)) for g in of.values() for p in combinations(g, 2)} | {(x, y) for a, b in ((1, 2), (2, 3)) for x in of[a] for y in of[b]}
    got = [(r.id_a, r.id_b) for r in n.expanded(links, members).collect()]
    assert set(got) == want and len(got) == len(want)


def test_groups(spark):
    texts = corpus(2, 30)
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "field string, row_id bigint, text string")
    label = {r.row_id: r.group_id for r in n.groups(*n.near_copies(rows)).collect()}
    parent = {k: k for k in label}
    for a, b in truth(texts):
        a, b = (next(iter_root(parent, x)) for x in (a, b))
        parent[a] = b
    roots = {k: next(iter_root(parent, k)) for k in label}
    assert len({(roots[k], label[k]) for k in label}) == len(set(roots.values())) == len(set(label.values()))


def iter_root(parent, x):
    while parent[x] != x:
        x = parent[x]
    yield x


def test_no_rows(spark):
    links, members = n.near_copies(spark.createDataFrame([], "field string, row_id bigint, text string"))
    assert links.count() == members.count() == n.groups(links, members).count() == 0


def test_a_row_with_several_texts_gives_each_class_its_own_set(spark):
    """Each row_id has two texts, and each text a near copy in another row."""
    rng = random.Random(4)
    data = []
    for k in range(20):
        for half in (0, 1):
            words = [rng.choice(WORDS) for _ in range(60)]
            data += [("f", k, " ".join(words)), ("f", 1_000 + 2 * k + half, " ".join([*words[:-1], "other"]))]
    links, members = n.near_copies(spark.createDataFrame(data, "field string, row_id bigint, text string"))
    row = {}
    for r in members.collect():
        row.setdefault(r.id, r.row_id)
    assert {tuple(sorted((row[r.a], row[r.b]))) for r in links.collect()} == {(k, 1_000 + 2 * k + half) for k in range(20) for half in (0, 1)}
