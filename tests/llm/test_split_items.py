import random
import re

import pytest

from clausewright.llm import split_items as s
from clausewright.llm.split_items import pieces, split_items


def brute(text, limit=1200, least=600, overlap=150):
    """The rule as it is stated, position by position."""
    start, number, out = 0, 1, []
    while text:
        if len(text) - start <= limit:
            return [*out, (number, start, len(text))]
        window = range(start + limit, start + least, -1)
        end = next((p for p in window if text[p - 2 : p] == "\n\n"), None)
        end = end or next((p for p in window if text[p - 1] in "。！？।۔" or text[p - 1] in ".?!;" and text[p : p + 1] in (" ", "\n") and text[p : p + 1]), None)
        end = end or next((p for p in window if text[p - 1] in " \n"), None) or start + limit
        out.append((number, start, end))
        start, number = end - overlap, number + 1
    return out


@pytest.mark.parametrize("seed", range(60))
def test_against_brute_force(seed):
    rng = random.Random(seed)
    letters = rng.choice(["abc", "abc  ", "abc .;?!\n", "字。！ab", "ab\n\n. ", "a"])
    text = "".join(rng.choice(letters) for _ in range(rng.randint(1, 400)))
    assert list(pieces(text, 60, 30, 8)) == brute(text, 60, 30, 8)


def test_overlap_must_leave_an_advance():
    with pytest.raises(ValueError):
        list(pieces("x" * 100, 60, 30, 30))


def test_table(spark):
    rows = spark.createDataFrame([(1, "x" * 2000, 7), (1, "x" * 2000, 8), (2, None, 7), (3, "", 7), (4, "short", 7)], "id bigint, text string, piece_no int")
    got = sorted((r.id, r.piece_no, r.piece_start, r.piece_end) for r in split_items(rows, "id", "text").collect())
    assert got == [(1, 1, 0, 1200), (1, 2, 1050, 2000)]
    assert split_items(rows.limit(0), "id", "text").count() == 0
    assert re.fullmatch(r"bigint", dict(split_items(rows, "id", "text").dtypes)["id"])


def test_structure_is_cut_before_its_parts():
    """Sections by headings first, then blocks and list items, and only then sentences."""
    body = "The party keeps the ledger and pays for it. " * 16
    text = f"# One\n{body}\n\n## A\n{body}\n# Two\n" + "".join(f"- item {k} of the list\n" for k in range(40)) + "<ul><li>x</li></ul>" + body
    got = [(a, b) for _, a, b in s.pieces(text, 1200, 300, 0, s.STRUCTURE)]
    assert "".join(text[a:b] for a, b in got) == text and all(b - a <= 1200 for a, b in got)
    assert text[got[1][0] :].startswith("## A") and text[got[2][0] :].startswith("# Two")
    assert text[got[3][0] - 5 : got[3][0]] in ("</ul>", "list\n")
