import random

from clausewright.llm.base import Words
from clausewright.llm.leaks import leaks, tiles

SCHEMA = ("doc_id bigint, text string, item_id string", "item_id bigint, text string, doc_id string")


def brute(docs, items, least):
    make = Words()
    runs = lambda t: {tuple(w[k : k + least]) for w in [make(t or "")] for k in range(len(w) - least + 1)}
    held = {i: runs(t) for i, t in items}
    return {(d, i) for d, t in docs for i in held if held[i] & runs(t)}


def test_against_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(3, 30)))) for k in range(12)]
    docs = []
    for k in range(80):
        body = rng.choices(words, k=rng.randint(0, 30))
        item = rng.choice(items)[1].split()
        at = rng.randrange(len(item))
        docs.append((k, " ".join([*body, *item[at : at + rng.randint(1, 14)], *rng.choices(words, k=3)])))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    for blocks in (1_000_000, 20):
        got = leaks(spark.createDataFrame([(d, t, "x") for d, t in docs], SCHEMA[0]), spark.createDataFrame([(i, t, "y") for i, t in [*items, (99, None)]], SCHEMA[1]), 6, block_words=blocks)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items, 6)
        assert got.count() == got.select("doc_id", "item_id").distinct().count()


def test_reordered_passages_are_covered(spark):
    first, second = [f"a{k}" for k in range(15)], [f"b{k}" for k in range(15)]
    docs = spark.createDataFrame([(1, " ".join([*second, "between", *first]))], "doc_id bigint, text string")
    row = leaks(docs, spark.createDataFrame([(7, " ".join(first + second))], "item_id bigint, text string")).head()
    assert (row.longest, row.tiles, row.covered, row.coverage) == (15, 2, 30, 1.0)


def test_tiles_do_not_overlap():
    assert tiles([(10, 0, 0), (8, 4, 20)], 3) == [(10, 0, 0)]
    assert tiles([(10, 0, 0), (8, 5, 20)], 3) == [(10, 0, 0), (3, 10, 25)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, item_id bigint, text string")
    assert leaks(none, none).count() == 0
