import pytest

from clausewright.llm import personal as p

GIVEN = ["Mirelle", "Odrin", "Vanya", "Kasdan"]
TRAIN = [f"The Operator acts through its director Mr. {g} K. Wenthorn, reachable at {g.lower()}.w@mail.orlven.example or +44 7700 90010{k} on working days." for k, g in enumerate(GIVEN)]
TRAIN += [t.replace("The Operator", f"The Operator of lot {n}") for t in TRAIN for n in range(4)]
CASES = {
    "Signed by Odrin de Grivold in the presence of Vanya S. T. Caldesh, holder of PAN CDTXZ1918N, at the office.": [("name", "Odrin de Grivold"), ("name", "Vanya S. T. Caldesh"), ("idno", "CDTXZ1918N")],
    "Payroll queries on Kasdan Yarlow (UID 0645-0766-5500) go to yarlow+legal [at] druby [dot] test only.": [("name", "Kasdan Yarlow"), ("idno", "0645-0766-5500"), ("email", "yarlow+legal [at] druby [dot] test")],
    "In an emergency call (020) 7946 0953 and ask for Mirelle van Quenby of the desk.": [("phone", "(020) 7946 0953"), ("name", "Mirelle van Quenby")],
    "Notices go to Plot No. 107, Sector 6, Fenhalli - 066982, marked for Mrs. Vanya Eskrand and no one else.": [("address", "Plot No. 107, Sector 6, Fenhalli - 066982"), ("name", "Vanya Eskrand")],
    "Zustellungen gehen an Lumrandstraße 14, 00817 Orlburg, z. Hd. Odrin K. Chaudrel.": [("address", "Lumrandstraße 14, 00817 Orlburg"), ("name", "Odrin K. Chaudrel")],
    "Tout avis est adressé au 62 bis, rue de Zelnesh, 00509 Calville, sans délai.": [("address", "62 bis, rue de Zelnesh, 00509 Calville")],
    "साक्षी ओरसा क्वेनबी का voter card ZQX0889088 दर्ज है। दूरभाष ०१५५-५०२२४२० पर।": [("name", "ओरसा क्वेनबी"), ("idno", "ZQX0889088"), ("phone", "०१५५-५०२२४२०")],
    "Si‍gned by Od​rin Grivold i​n the presence of no one.": [("name", "Od​rin Grivold")],
    "write to kasdan-c at cormore dot test please": [("email", "kasdan-c at cormore dot test")],
}
NONE = [
    "As held in Odrin v. Vanya, the mark is void.", "Interest runs @ 4.5% a month on invoice 26-44-5500.", "Part numbers 15-55-090 and 77-00-920 apply.", "The Orldor Road depot stays shut.",
    "Odrin Grivold & Sons Limited shall pay 19,07,000 by 13/05/2029.", "ग्राहक डॉ. समिति के मत से संख्या 42184", "see www.example.com for more", "", "lives at the mill",
]


@pytest.fixture(scope="module")
def detect():
    return p.Detector(*p.fit(TRAIN + [t for t in CASES]))


@pytest.mark.parametrize("text", list(CASES))
def test_mentions(detect, text):
    assert [(kind, text[a:b]) for kind, a, b in detect(text)] == CASES[text]


@pytest.mark.parametrize("text", NONE)
def test_no_mention(detect, text):
    assert detect(text) == []


def test_table(spark):
    texts = [*TRAIN, *CASES, "", None]
    rows = spark.createDataFrame([("f", k, t, "x") for k, t in enumerate(texts)] + [("f", 0, TRAIN[0], "again")], "field string, row_id bigint, text string, kind string")
    got = p.mentions(rows).collect()
    assert len(got) == len(set(got)) and {r.row_id for r in got} == set(range(len(texts) - 2))
    masked = {r.row_id: r.text for r in p.masked(rows).collect()}
    assert masked[0] == "The Operator acts through its director Mr. [NAME], reachable at [EMAIL] or [PHONE] on working days."
    assert masked[len(texts) - 1] is None and masked[len(texts) - 2] == ""
    assert p.mentions(rows.limit(0)).count() == 0


def test_expectation_maximisation_separates():
    import numpy as np

    good, bad = [(1, 1, 1, 1, 1, 0, 0)] * 50, [(1, 0, 0, 1, 0, 1, 1)] * 50
    chance = p.estimate(np.array(good + bad))
    assert chance[:50].min() > 0.9 and chance[50:].max() < 0.1
    none = np.full((100, 3), -1)
    w, own = p.classifier(np.array(good + bad), none, chance, np.ones(100))
    assert ((p.design(np.array(good + bad)) @ w > 0) == (chance > 0.5)).all() and not own.any()
    # With the same votes all over, its own features tell what the labelers cannot.
    same, seen = np.ones((100, 7), dtype=int), np.array([[1, 9, 9]] * 50 + [[2, 9, 9]] * 50)
    w, own = p.classifier(same, seen, np.repeat([0.9, 0.1], 50), np.ones(100))
    score = p.design(same) @ w + own[seen].sum(axis=1)
    assert (score[:50] > 0).all() and (score[50:] < 0).all()


def test_names_are_learned_from_all_texts(spark, monkeypatch):
    """A given name that has its cues in texts outside the sample, and in short ones, is known everywhere."""
    monkeypatch.setattr(p, "bounded_sample", lambda rows, size: TRAIN)
    cues = ["Attn: Tobrin Askellan", "Mr. Tobrin Askellan of the mill", "The deed was Signed by Tobrin Q. Askellan on a day that all the parties to the lease had agreed on before."]
    bare = "Any notice may be left with Tobrin Askellan at the gate of the yard."
    rows = spark.createDataFrame([("f", k, t) for k, t in enumerate([*TRAIN, *cues, bare, bare, cues[0]])], "field string, row_id bigint, text string")
    given, last, *_ = p.corpus_gazetteer(rows)
    assert "Tobrin" in given and "Askellan" in last
    assert p.corpus_gazetteer(rows.where(~rows.text.startswith("Mr. T")))[0] == frozenset(GIVEN)
    got = [(r.kind, r.start_at) for r in p.mentions(rows).collect() if r.row_id == len(TRAIN) + len(cues)]
    assert got == [("name", bare.index("Tobrin"))]
    assert "[NAME] at the gate" in {r.row_id: r.text for r in p.masked(rows).collect()}[len(TRAIN) + len(cues)]


HELD_WAYS = ["Crescent", "Mews", "Wharf", "Parade"]
HELD_GIVEN = ["Ilvane", "Tobrin", "Selka", "Marrod"]
HELD_FIRMS = ["Tanneries", "Foundries", "Granaries"]


def test_streets_firms_and_names_that_are_in_no_list(spark):
    """All are learned from the corpus by their context; the mentions that are scored stand in other wording."""
    cities = ["Orlburg", "Calville", "Fenhalli", "Silport", "Brindor"]
    known = [f"The tenant Mr. {g} Askellan resides at {n + 3} {c} {w}, {c} - 4000{n} and {n}2, and the deed of lot {n} stays there." for w, g in zip(HELD_WAYS, HELD_GIVEN, strict=True) for n, c in enumerate(cities)]
    known += [f"The lessor {c} {f} Limited keeps all records of lot {n} at its own cost for the whole of the term." for f in HELD_FIRMS for n, c in enumerate(cities)]
    known += [f"Within {n + 10} Business Days of the notice the lessee of lot {n} shall pay all of it to the lessor without any delay." for n in range(30)]
    want, none = {}, []
    for k, (w, g) in enumerate(zip(HELD_WAYS, HELD_GIVEN, strict=True)):
        for city in ("Elmwick", "Rosbrook"):
            text = f"Any notice is left with {g} {city}son at {k + 20} {city} {w}."
            want[text] = {("name", text.index(g)), ("address", text.index(f"{k + 20} {city}"))}
    none += [f"The yard of {g} {f} stays shut on 14 Working Days of the year." for g, f in zip(HELD_GIVEN, HELD_FIRMS, strict=False)]
    texts = [*known, *TRAIN, *want, *none]
    got = {}
    for r in p.mentions(spark.createDataFrame([("f", k, t) for k, t in enumerate(texts)], "field string, row_id bigint, text string")).collect():
        got.setdefault(texts[r.row_id], set()).add((r.kind, r.start_at))
    right = sum(len(got.get(t, set()) & m) for t, m in want.items())
    found = sum(len(got.get(t, set())) for t in [*want, *none])
    assert 2 * right / (found + sum(map(len, want.values()))) >= 0.9
