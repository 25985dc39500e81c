import unicodedata

from clausewright.llm import lookalikes as k

FOUND = {
    1: ("Ｔｈｉｓ is wide", {"width"}),
    2: ("the oﬃce and 𝐦𝐚𝐲", {"width"}),
    3: ("facadȩ and é", {"combining"}),
    4: ("in​vis­ible", {"invisible"}),
    5: ("no break", {"space"}),
    6: ("the nоminated pаrty", {"lookalike"}),
    7: ("dе​lιver ３ times", {"lookalike", "invisible", "width"}),
}
NONE = {10: "The mark “Велгейт” and “Τάρνος”", 11: "采购方，应当（保管）。", 12: "Vis-Ã\xa0-vis the faÃ§ade", 13: "dГ©lai et Г\xa0 la", 14: "plain ASCII", 15: "für Rücksprache § 4", 16: "", 17: "प्रत्येक पक्ष", 18: "à¤\xadà¥‚ x"}


def frame(spark):
    rows = [("f", i, t, "x") for i, (t, _) in FOUND.items()] + [("f", i, t, "x") for i, t in NONE.items()] + [("f", 20, None, "x"), ("f", 1, FOUND[1][0], "again")]
    return spark.createDataFrame(rows, "field string, row_id bigint, text string, kind string")


def test_kinds(spark):
    got = {}
    rows = k.kinds(frame(spark)).collect()
    for r in rows:
        got.setdefault(r.row_id, set()).add(r.kind)
    assert got == {i: kinds for i, (_, kinds) in FOUND.items()} and len(rows) == len(set(rows))


def test_equal_looking_texts_become_equal(spark):
    got = {}
    for r in k.unified(frame(spark)).collect():
        got.setdefault(r.row_id, []).append(r.text)
    assert got[1] == ["This is wide"] * 2 and got[2] == ["the office and may"] and got[3] == ["façade and é"][:0] + [unicodedata.normalize("NFC", FOUND[3][0])]
    assert got[4] == ["invisible"] and got[5] == ["no break"] and got[6] == ["the nominated party"] and got[7] == ["deliver 3 times"]
    assert got[10] == [NONE[10]] and got[11] == [NONE[11]] and got[16] == [""] and got[20] == [None]


def test_marks_in_any_order(spark):
    rows = spark.createDataFrame([("f", 1, "q̣́ x"), ("f", 2, "q̣́ x"), ("f", 3, "ệ"), ("f", 4, "ệ")], "field string, row_id bigint, text string")
    got = {r.row_id: r.text for r in k.unified(rows).collect()}
    assert got[1] == got[2] and got[3] == got[4] == "ệ"


def test_long_text_and_no_rows(spark):
    rows = spark.createDataFrame([("f", 1, "ab​cd " * 20_000)], "field string, row_id bigint, text string")
    assert [(r.row_id, r.kind) for r in k.kinds(rows).collect()] == [(1, "invisible")]
    assert k.kinds(rows.limit(0)).count() == 0 and k.unified(rows.limit(0)).count() == 0
