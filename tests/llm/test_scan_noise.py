import pytest

from clausewright.llm import scan_noise as n

SENTENCES = [
    "The disclosing party shall return all training material within thirty days of the notice.",
    "Each statement of account shall be signed by the treasurer before the quarter ends.",
    "The warehouse manager keeps proof of delivery for every instalment under the licence.",
    "Any drawing marked confidential remains with the operator until the account is settled.",
]
CLEAN = [" ".join(SENTENCES[k % 4 :] + SENTENCES[: k % 4]) for k in range(24)]
NOISY = {
    1: ("clean_text", "The disclosing party shall return all trainin9 material.", {"misread"}),
    2: ("clean_text", "Each s+atement of account shall be signed.", {"misread"}),
    3: ("page_text", "The warehouse manager keeps proof of deli-\nvery for every instalment.", {"hyphen"}),
    4: ("page_text", "LEASE DEED - Holley Foods Limited\nAny drawing marked confidential remains.\nii", {"header", "page_no"}),
    5: ("page_text", "Any drawing marked confidential.\nNOR-652/2030 / NORNESH STUDIOS LLP / [2/2]", {"header", "page_no"}),
    6: ("clean_text", "LEASE DEED\n\nAny drawing is marked.\nPage 2 of 9\nThe warehouse manager keeps proof.", {"page_no"}),
    7: ("page_text", "The clrawing is signecl by the rnanager.", {"misread"}),
}
SOUND = {
    10: ("page_text", "LEASE DEED\nThe warehouse manager keeps proof of delivery."),
    11: ("clean_text", "LEASE DEED\n\nThe code is QX-12 and the sum 5,000.\n\nAuthorised Signatory"),
    12: ("page_text", ""),
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [("clean_text", 100 + k, t, "x") for k, t in enumerate(CLEAN)]
    data += [(f, i, t, "x") for i, (f, t, _) in NOISY.items()] + [(f, i, t, "x") for i, (f, t) in SOUND.items()]
    data += [("page_text", 20, None, "x"), ("clean_text", 1, NOISY[1][1], "again")]
    return spark.createDataFrame(data, "field string, row_id bigint, text string, kind string").cache()


def test_kinds(rows):
    got = {}
    for r in n.noise(rows).collect():
        got.setdefault(r.row_id, set()).add(r.kind)
    assert got == {i: kinds for i, (_, _, kinds) in NOISY.items()}


def test_repair(rows):
    got = {r.row_id: r.text for r in n.repair(rows).collect()}
    assert set(got) == set(NOISY)
    assert got[1] == "The disclosing party shall return all training material."
    assert got[2] == "Each statement of account shall be signed."
    assert got[3] == "The warehouse manager keeps proof of delivery for every instalment."
    assert got[4] == "Any drawing marked confidential remains."
    assert got[6] == "LEASE DEED\n\nAny drawing is marked. The warehouse manager keeps proof."
    assert got[7] == "The drawing is signed by the manager."


def test_no_rows(rows):
    assert n.noise(rows.limit(0)).count() == 0


@pytest.mark.parametrize("line", ["p. 2", "- 3 -", "Pg 4", "7 | P a g e", "[1/3]", "xii", "Page 2 of 29", "14"])
def test_page_numbers(line):
    assert n.furniture(line) == (False, True)


@pytest.mark.parametrize("line", ["The sum is 14", "proof for 88 days.", "For Holley Foods Limited", "Authorised Signatory", "2. PAYMENT"])
def test_other_lines(line):
    assert n.furniture(line) == (False, False)


@pytest.mark.parametrize("times", [1, 40, 4_000])
def test_a_corpus_of_many_times_the_size_is_judged_alike(times):
    words = {w: 40 for t in CLEAN for w in map(n.core, t.split())}
    shares = {**words, "shall": 70_000, "sball": 44, "disclosure": 900, "disclosnre": 9, "pre": 50}
    counts = {w: c * times for w, c in shares.items()}
    editor = n.Editor(counts, {"op:replace": 1.0, "r:10": 1.0}, n.LEAST_COUNT * times)
    assert [editor(w) for w in ("sball", "pre-disclosnre", "Shall", "warehouse")] == ["shall", "pre-disclosure", None, None]


def test_rare_words_count_exactly(spark, monkeypatch):
    """Below the broadcast share a word's own count is looked up: met so often beside its neighbour it is no misreading."""
    monkeypatch.setattr(n, "LEAST_SHARE", 3e-3)
    data = [("clean_text", 100 + k, t) for k, t in enumerate(CLEAN * 4)]
    data += [("clean_text", 1_000 + k, "Each drawirg is kept.") for k in range(8)] + [("clean_text", 2_000, "The trainin9 material.")]
    rows = spark.createDataFrame(data, "field string, row_id bigint, text string")
    counts, least, rare = n.word_counts(rows)
    assert least > n.LEAST_COUNT and "drawirg" not in counts and dict(rare.collect())["drawirg"] == 8
    seen = n.Editor(counts, n.train(counts, least), least, {"drawirg": 8})
    assert seen.unsure("drawirg") <= {"drawirg"} and list(seen.edits("drawirg")) == []
    assert {(r.row_id, r.kind) for r in n.noise(rows).collect()} == {(2_000, "misread")}
    assert {r.row_id for r in n.repair(rows).collect()} == {2_000}


def test_compounds_keep_the_hyphen_they_are_broken_at():
    words = {w: 40 for t in CLEAN for w in map(n.core, t.split())}
    counts = {**words, "long-term": 300, "third-party": 200, "well-known": 90, "per-seat": 80, "non-disclosure": 60, "long": 500, "term": 900, "third": 70, "party": 800, "well": 30, "known": 40, "seat": 50, "non": 9, "per": 700}
    for times in (1, 1_000):
        scaled = {w: c * times for w, c in counts.items()}
        editor = n.Editor(scaled, n.train(scaled, n.LEAST_COUNT * times), n.LEAST_COUNT * times)
        assert editor.rejoined("a long-\nterm plan") == ("a long-term plan", False)
        assert editor.rejoined("any third-\n party or well-\nknown one") == ("any third-party or well-known one", False)
        assert editor.rejoined("the deli-\nvery and the treas-\nurer") == ("the delivery and the treasurer", True)
        assert editor.rejoined("an unheard-of zorbli-\nnated word")[0] == "an unheard-of zorblinated word"


def test_headers_of_unknown_form_are_learned(spark):
    """Headers that no known form describes come again on the pages of a document; they are found there, and where a
    document shows its header once."""
    import random

    rng, rows = random.Random(3), []
    for d in range(60):
        head = f"~ {rng.choice(['Mill', 'Yard', 'Dock'])} {rng.choice(['north', 'south'])} copy ~"
        count = 1 if d >= 50 else 4
        for no in range(1, count + 1):
            body = "\n".join(rng.sample([line for s in SENTENCES for line in (s[: len(s) // 2], s[len(s) // 2 :])], 7))
            rows.append(("page_text", 1_000 * d + no, f"{head}\n{body}\nFolio {no}" if no > 1 or count == 1 else f"{body}\nFolio {no}", d, no))
    frame = spark.createDataFrame(rows, "field string, row_id bigint, text string, document bigint, page_no int")
    assert n.furniture(rows[1][2].split("\n")[0]) == (False, False) == n.furniture("Folio 3")
    found = {}
    for r in n.noise(frame).collect():
        found.setdefault(r.kind, set()).add(r.row_id)
    heads = {r[1] for r in rows if r[2].startswith("~")}
    assert len(found["header"] & heads) >= 0.95 * len(heads) and len(found["header"] - heads) <= 3
    assert len(found["page_no"]) >= 0.95 * len(rows)
    repaired = {r.row_id: r.text for r in n.repair(frame).collect()}
    assert "~" not in repaired[59_001] and "Folio" not in repaired[59_001]
