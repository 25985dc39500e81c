import random

import pytest

from clausewright.llm import sentence_bounds as s

SUBJECTS = ["The Supplier", "The Client", "Each party", "Any delay", "The Operator"]
ENDS = ["at Grinagar", "within 30 days", "in line with the manual", "at the rate fixed in Schedule 7", "before noon"]


def training():
    rng = random.Random(1)
    out = []
    for _ in range(400):
        a = f"{rng.choice(SUBJECTS)} shall pay Acme Pvt. Ltd. the sum set out in Sec. {rng.randint(1, 9)} {rng.choice(ENDS)}."
        b = f"{rng.choice(SUBJECTS)} shall tell Mr. Tamrel K. Yarlow of no. {rng.randint(1, 99)} {rng.choice(ENDS)}."
        c = f"{rng.choice(SUBJECTS)} keeps all records {rng.choice(ENDS)}."
        word = "".join(rng.choices("aeioulmnrst", k=rng.randint(2, 8)))
        d = f"{rng.choice(SUBJECTS)} wrote, “Nothing is owed. Nothing is {word}.” and left the {word}."
        e = f"{rng.choice(SUBJECTS)} shall see to it that nobody enters the {word}."
        w = f"双方确认“货物已验收。款项{rng.randint(1, 9)}已付清。”的表述并付款。"
        out.append(f"{d}\n\n{e}\n\n{w}\n\n{rng.randint(1, 9)}. PAYMENT\n\n{a}\n\n{b} {c}\n\n{c}\n\n服务商应当保管全部图纸{rng.randint(1, 9)}年。\n\nผู้ซื้อต้องชำระเงินงวดที่{rng.randint(1, 99)}โดยออกค่าใช้จ่ายเอง\n\nप्रत्येक पक्ष अभिलेख {rng.randint(1, 9)} सौंपेगा।")
    return out


@pytest.fixture(scope="module")
def tagger():
    return s.fit(training())


@pytest.mark.parametrize(
    "units",
    [
        ["The Supplier shall pay Acme Pvt. Ltd. at once.", "Each party keeps records."],
        ["The Client shall tell Mr. Tamrel K. Yarlow of it before noon.", "Any delay ends it."],
        ['The Supplier replied, "We cannot accept lot 40. It arrived wet!" and returned it.', "The Client paid."],
        ["The notice must read: “No claim is admitted. All rights stay reserved.” and be sent.", "The Client paid."],
        ["服务商应当保管全部图纸。", "委托方应当付款！", "双方确认“货物已验收。款项已付清。”的表述并付款。"],
        ["ผู้ซื้อต้องชำระเงินงวดที่12โดยออกค่าใช้จ่ายเอง", "ผู้ซื้อต้องชำระเงินงวดที่45โดยออกค่าใช้จ่ายเอง"],
        ["The Supplier shall pay 19.51 per cent of it within 82 days.", "The Client shall not."],
    ],
)
def test_sentences(tagger, units):
    joint = "" if units[0][0] > "一" else " "
    text = joint.join(units)
    assert [text[a:b] for a, b in s.sentences(text, tagger)] == units


def test_blank_lines_end_units_and_line_breaks_do_not(tagger):
    text = "  1. PAYMENT TERMS\n\nThe Supplier pays\nat once.  \n \n  By Tamrel\n\n\n"
    assert [text[a:b] for a, b in s.sentences(text, tagger)] == ["1. PAYMENT TERMS", "The Supplier pays\nat once.", "By Tamrel"]


def test_held_out_accuracy(tagger):
    rng = random.Random(99)
    right = found = wanted = 0
    for text in training()[:5]:
        assert list(s.sentences(text, tagger)) == sorted(s.sentences(text, tagger))
    for _ in range(300):
        units = [f"{rng.choice(SUBJECTS)} shall pay Acme Pvt. Ltd. under Sec. {rng.randint(1, 9)} {rng.choice(ENDS)}." for _ in range(4)]
        text = " ".join(units)
        got = {text[a:b] for a, b in s.sentences(text, tagger)}
        right, found, wanted = right + len(got & set(units)), found + len(got), wanted + len(set(units))
    assert right / found > 0.97 and right / wanted > 0.97


def test_table(spark):
    rows = spark.createDataFrame([(1, "The Supplier pays. The Client pays.", 5), (1, "The Supplier pays. The Client pays.", 6), (2, None, 5), (3, " \n ", 5), (4, "x" * 50_000, 5)], "contract_id bigint, text string, sent_start int")
    got = sorted((r.contract_id, r.sent_start, r.sent_end) for r in s.split_sentences(rows).collect())
    assert got[-1] == (4, 0, 50_000) and {g[0] for g in got} == {1, 4} and len(got) == len(set(got))
    assert s.split_sentences(rows.limit(0)).count() == 0


CHINESE = (["服务商", "委托方", "托管机构", "受让人", "任何一方"], ["应当保管全部图纸", "应当在四十日内付款", "不得向第三方披露样品", "经书面同意后转让货物", "可以抽查仓库记录"], ["直至款项结清", "并承担全部费用", "以附件为准", "不另行通知"])
THAI = (["ผู้ซื้อ", "ผู้ขาย", "คู่สัญญาแต่ละฝ่าย", "ผู้ให้เช่า"], ["ต้องชำระเงินงวดสุดท้าย", "ต้องส่งคืนตัวอย่างสินค้า", "จะตรวจสอบแบบแปลน", "อาจโอนสิทธิการใช้"], ["โดยออกค่าใช้จ่ายเอง", "ภายในสามสิบวัน", "ตามภาคผนวก", "เว้นแต่มีเหตุสุดวิสัย"])


@pytest.mark.parametrize(("parts", "end"), [(CHINESE, "。"), (THAI, "")])
def test_scripts_without_spaces_and_marks(parts, end):
    """Sentences of held-out combinations, joined without anything between them."""
    every = [a + b + c for a in parts[0] for b in parts[1] for c in parts[2]]
    random.Random(6).shuffle(every)
    seen, held = every[: len(every) // 2], every[len(every) // 2 :]
    tagger = s.fit(["\n\n".join(x + end for x in seen[k : k + 4]) for k in range(0, len(seen), 4)])
    rng, right, found, wanted = random.Random(8), 0, 0, 0
    for _ in range(60):
        units = rng.sample(held, 4)
        text, at, want = "".join(units), 0, set()
        for unit in units:
            want.add((at, at + len(unit)))
            at += len(unit)
        got = set(s.sentences(text, tagger))
        right, found, wanted = right + len(got & want), found + len(got), wanted + len(want)
    assert 2 * right / (found + wanted) >= 0.9


def test_statistics_cover_all_texts(spark, monkeypatch):
    """An abbreviation that no sampled text holds is known from the others."""
    sample = training()
    others = [f"The Client shall ask Qrv. Tamrel {k} of the desk about the sum and then pay it before noon." for k in range(60)]
    monkeypatch.setattr(s, "bounded_sample", lambda rows, size: sample)
    rows = spark.createDataFrame(list(enumerate([*sample, *others, *others])), "contract_id bigint, text string")
    ends, starts = s.corpus_counts(rows)
    assert ends["qrv"] == (0, 60) and starts["Tamrel"][1] == s.met([*sample, *others])[1]["Tamrel"][1]
    got = {(r.contract_id, r.sent_start, r.sent_end) for r in s.split_sentences(rows).collect() if r.contract_id >= len(sample)}
    assert got == {(len(sample) + k, 0, len(t)) for k, t in enumerate([*others, *others])}
    old = s.fit(sample)
    assert any(len(list(s.sentences(t, old))) > 1 for t in others)
