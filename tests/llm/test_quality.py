import pickle
import random

import numpy as np
import pytest

from clausewright.llm import quality as q
from clausewright.session import checkpoint_dir

PROSE = "The Supplier shall keep all records of the warehouse for ten years. Each party may ask for a copy of the ledger, and the cost of it is shared. "
LIST = "\n".join(f"* the item number {k} of lot {k * 7}" for k in range(12))
TABLE = "Qty | Amount | Ref\n" + "\n".join(f"{k * 7} | {k * 91} | YA-{k}" for k in range(12))
rng = random.Random(5)
MASHED = " ".join("".join(rng.choices("qzxjkvwpgh", k=rng.randint(3, 9))) for _ in range(60))
SCRAMBLED = " ".join("".join(rng.sample(w, len(w))) for w in (PROSE * 3).split())
HEX = "\n".join(f"{k * 16:08x}  " + " ".join(f"{rng.randrange(256):02x}" for _ in range(16)) for k in range(12))



def prose(seed):
    """Different sentences each time, so nothing is repeated."""
    pick = random.Random(seed)
    who, does = ["The Supplier", "Each party", "The treasurer", "A carrier", "The tenant"], ["shall keep", "may ask for", "has to return", "will insure", "must store"]
    what, when = ["all records of the warehouse", "a copy of the ledger", "the keys to the yard", "any goods left over", "the signed statement"], ["for ten years", "before the quarter ends", "at its own cost", "in writing", "without delay"]
    return " ".join(f"{pick.choice(who)} {pick.choice(does)} {pick.choice(what)} numbered {pick.randint(10, 9999)} {pick.choice(when)}." for _ in range(8))


KINDS = {
    1: (prose(1), "prose"), 2: (LIST, "list"), 3: (TABLE, "table"), 4: (MASHED, "junk"), 5: (SCRAMBLED, "junk"), 6: (HEX, "junk"), 7: ("@#$%^&*" * 20, "junk"), 8: ("Home\nNext\nPrev\nHelp\n" * 9, "junk"), 9: (PROSE[:68] * 12, "junk"),
    10: (PROSE + "\n\n" + LIST, "list"), 11: (prose(2) + "\n\n" + LIST[:200], "prose"), 12: ("保管全部图纸。直至款项结清。双方确认货物已验收。", "prose"), 13: ("a;b;c\n1;2;3\n4;5;6\n7;8;9", "table"), 14: ("Short note.", "prose"),
    15: ("The Supplier shall keep all records of the\nwarehouse for ten years. Each party may ask\nfor a copy of the ledger, and the cost of it\nis shared.", "prose"),
}


def frame(spark):
    rows = [(i, t, "x") for i, (t, _) in KINDS.items()] + [(100 + k, prose(100 + k), "x") for k in range(80)] + [(20, None, "x"), (21, "", "x"), (22, " \n ", "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, kind string")


def test_kinds(spark):
    got = {r.doc_id: r for r in q.statistics(frame(spark)).collect()}
    assert {i: got[i].kind for i in KINDS} == {i: kind for i, (_, kind) in KINDS.items()}
    assert got[20].kind is None and got[20].n_words is None and got[21].kind == got[22].kind == "blank" and got[21].n_words == 0
    assert got[14].n_words == 2 and got[14].mean_word_length == 4.5 and got[14].ended_lines == 1.0


def test_chunks_do_not_change_the_outcome(spark):
    whole = sorted(map(str, q.statistics(frame(spark)).collect()))
    for chunk, spread in ((37, q.SPREAD), (300, q.SPREAD), (90, 400), (q.CHUNK, 150)):
        assert sorted(map(str, q.statistics(frame(spark), chunk, spread).collect())) == whole


@pytest.mark.parametrize("seed", range(60))
def test_merging_is_associative(seed, monkeypatch):
    monkeypatch.setattr(q, "LINE", 40)
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "\n", "\n\n", "* item\n", "1 | 2\n", "a;b;c\n", "the of and to in a is that ", ". ", "qzx vkj wpq ", "12 34\n", "保管图纸。", "short line\n", "Home\n", " "]) for _ in range(rng.randint(1, 90)))
    counts = np.ones(27**3)
    for triple in q._triples(PROSE * 50):
        counts[triple] += 40
    measure = q.Measure(q.Letters(counts))
    parts = [q.part(run, measure) for run in q.chunks(text, rng.randint(1, 60))]

    def fold(parts):
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts = [*parts[:k], q.merge(parts[k], parts[k + 1], measure), *parts[k + 2 :]]
        return parts[0]

    closed = q.outcome(q.whole(text, measure, 10**6), measure)
    assert q.outcome(fold(list(parts)), measure) == q.outcome(fold(list(parts)), measure) == q.outcome(q.tree(list(parts), measure), measure) == closed


@pytest.mark.parametrize("seed", range(20))
def test_parts_have_the_units_of_the_whole(seed, monkeypatch):
    monkeypatch.setattr(q, "LINE", 30)
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "\n", "  ", "End. ", "x" * 17, "。", "\n\n"]) for _ in range(rng.randint(1, 120)))
    units, begun, got = list(q.units(text)), False, []
    for run in q.chunks(text, rng.randint(1, 90)):
        broken = not run[-1].final
        got += q.units("".join(u.text + "\n" * u.final for u in run).removesuffix("\n"), begun, broken)
        begun = broken
    assert got == units


def test_states_are_bounded():
    """Neither many lines without a blank one nor one endless line make the state of a part grow."""
    measure = q.Measure(q.Letters(np.ones(27**3)))
    sizes = [len(pickle.dumps(q.tree([q.part(run, measure) for run in q.chunks(unit * n)], measure))) for unit in ("an item of the list\n", "no end in sight, ", "x") for n in (2_000, 100_000)]
    assert max(sizes) < 4_000


def test_millions_of_characters_without_a_blank_line(spark):
    """The outcome is the same for every size of chunks and parts, with more than 50,000 distinct segments."""
    sentences = [s + "." for k in range(9_000) for s in prose(k).split(". ")]
    line = " ".join(sentences)
    texts = {1: "\n".join(sentences * 2), 2: line, 3: "\n".join(sentences[:9_000] * 3), 4: line[:400_000] + " Nothing is owed." * 60_000, 5: "\n".join(f"{('bolts', 'steel pipes', 'a set of valves')[k % 3]} {k}" for k in range(90_000))}
    rows = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4).cache()
    assert len(set(sentences)) > 50_000 and len(texts[1]) > 6_000_000
    got = [sorted(map(str, q.statistics(rows, *sizes).collect())) for sizes in ((500, 1 << 19), (4_096, 1 << 22), (60_000, 1 << 30), (1 << 30, 1 << 30))]
    assert got[0] == got[1] == got[2] == got[3]
    assert [kind for line in got[0] for kind in ("prose", "junk", "list") if f"kind='{kind}'" in line] == ["prose", "prose", "junk", "junk", "list"]


def test_no_rows(spark):
    assert q.statistics(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_passage_repeated_in_a_very_long_document_counts_whatever_stands_beside_it(spark):
    """Every passage in turn, so that no luck with its hash makes the outcome right."""
    other = [f"note {k} kept" for k in range(9_000)]
    texts = {}
    for k in range(6):
        lines = other + [f"{PROSE.split('.')[0]} in yard {k}"] * 16_000
        random.Random(k).shuffle(lines)
        texts[k] = ". ".join(lines)
    got = {r.doc_id: r for r in q.statistics(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert {r.kind for r in got.values()} == {"junk"}
    for k, text in texts.items():
        assert len(text) > q.SPREAD / 2 and got[k].junk_share == pytest.approx(q.repeats(text).share)


def junk(text, measure):
    counts = q.whole(text, measure).counts
    return counts["junk"] / counts["chars"]


def test_mashed_lines_between_lines_of_digits_are_junk():
    sound = np.zeros((27, 27, 27))
    for triple in q._triples(PROSE * 50):
        sound.reshape(-1)[triple] += 1
    assert junk("10 20 30\n" + MASHED + "\n40 50 60", q.Measure(q.Letters(sound))) > 0.9


def test_short_segments_count_and_points_inside_numbers_do_not_cut():
    assert q.repeats("ok. " * 9) == (9, 1, 1.0) and q.repeats("好。" * 9) == (9, 1, 1.0)
    assert q.repeats("It costs 1.5 or 2.5 at most.").total == 1


def test_segments_across_parts_count(spark, monkeypatch):
    monkeypatch.setattr(q, "LINE", 50)
    text = "ok.\n" * 40 + "\n" + "The sum is 1.5 here. " * 30
    whole = q.repeats(text)
    for spread in (7, 90):
        spark.sparkContext.setCheckpointDir(str(checkpoint_dir(spark)))
        got = q.repeats_of(q.handed_out(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), spread)).first()
        assert (got.total, got.distinct) == whole[:2] and got.share == pytest.approx(whole.share)
