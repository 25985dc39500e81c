"""Problem 7: one form for texts that look the same but differ in their characters.

To find the kinds, words that hold a character of the mapping are exploded to positioned code points and joined with
broadcast tables of decompositions and look-alikes (their size is bounded by Unicode, not by the data). To bring texts
to one form the same tables are broadcast and looked up where the text is, so no text is shuffled: each distinct word is
taken apart to code points, these are replaced and decomposed, marks ordered by combining class, clusters recomposed,
and the string rebuilt. Words without such characters stay as they are and never leave the scan's stage.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import MEMO_LIMIT, flat_map, text_fields
from clausewright.llm.encoding import LOST, STRICT, Repair, suspects

#: Letters of Cyrillic, Greek, Armenian, Cherokee and Coptic, and the Latin letters they look like. The other
#: letters of these scripts look like no Latin letter and stay.
LOOKALIKES = dict(zip(
    "АВЕЅІЈКМНОРСТХУҮаесԁһіјорԛѕսԝхуѵүӏԌЬҺԚԜ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορτυϲχγͿϳϹϺϻ" "ՕՍԼՏօոսցյգհզ"
    "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏴ" "ꭰꭱꭲꭺꭻꭼꮃꮇꮋꮓꮢꮩꮪꮮꮯꮲꮶ" "ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲓⲕⲟⲣⲥⲭ",
    "ABESIJKMHOPCTXYYaecdhijopqsuwxyvylGbhQW" "ABEZHIKMNOPTYXaikvoptucxyJjCMm" "OULSonugjqhq"
    "DRTiyAJEWMHYGZbRWSVSLCPKdB" "DRTAJEWMHZRVSLCPK" "ABEHIKMNOPCTYXikopcx",
    strict=True,
))
#: Characters without width.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯﻿\U000e0001-\U000e007f"
#: Spaces other than the ordinary one.
SPACES = "   -   　"
#: Ranges of letters of other scripts that may stand in a Latin word.
OTHER = "Ͱ-ϿЀ-ԯԱ-ևᎠ-ᏽᲀ-ᲈⲀ-⳿ꭰ-ꮿ"
#: Ranges that hold every character of the mapping, and few others: a cheap test in the scan's stage.
COARSE = r"[\u00a0\u00ad\u0300-\u052f\u0531-\u0587\u061c\u0653-\u0655\u093c\u09be\u09d7\u0b3e\u0b56\u0b57\u0bbe\u0bd7\u0c56\u0cc2\u0cd5\u0cd6\u0d3e\u0d57\u0dca\u0dcf\u0ddf\u102e\u115f\u1160\u13a0-\u13fd\u1680\u17b4\u17b5\u180b-\u180f\u1b35\u1c80-\u1c88\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2102-\u214e\u2c80-\u2cff\u3000\u3099\u309a\uab70-\uabbf\ufb00-\ufb4f\ufe00-\ufe0f\ufeff\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\x{11099}-\x{1193f}\x{1d400}-\x{1d7ff}\x{1ee00}-\x{1eebb}\x{1fbf0}-\x{1fbf9}\x{e0001}-\x{e007f}]"
LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"


def _expanded(ranges: str) -> Iterator[str]:
    at = 0
    while at < len(ranges):
        if ranges[at + 1 : at + 2] == "-":
            yield from map(chr, range(ord(ranges[at]), ord(ranges[at + 2]) + 1))
            at += 3
        else:
            yield ranges[at]
            at += 1


def _class(characters: list[str]) -> str:
    """A character class for Java and Python from sorted characters, as ranges."""
    out, codes = [], sorted(map(ord, characters))
    start = last = codes[0]
    name = lambda c: f"\\x{{{c:x}}}"
    for code in [*codes[1:], None]:
        if code is not None and code == last + 1:
            last = code
            continue
        out.append(name(start) if start == last else f"{name(start)}-{name(last)}")
        start = last = code
    return "".join(out)


@functools.cache
def tables() -> tuple[list[tuple[str, str, str | None]], list[tuple[str, str, int]], list[tuple[str, str]]]:
    """(character, form, kind) to replace; (character, decomposition, class) of every mark and accented letter; (decomposed, composed)."""
    replace: list[tuple[str, str, str | None]] = [(ch, "", "invisible") for ch in _expanded(INVISIBLE)]
    replace += [(ch, " ", "space") for ch in _expanded(SPACES)]
    parts, whole = [], []
    for code in range(0xA0, 0x30000):
        ch = chr(code)
        decomposition = unicodedata.decomposition(ch)
        if unicodedata.combining(ch):
            parts.append((ch, unicodedata.normalize("NFD", ch), unicodedata.combining(ch)))
        if not decomposition:
            continue
        if decomposition[0] != "<":
            if not "가" <= ch <= "힣" and unicodedata.normalize("NFC", ch) == ch:
                nfd = unicodedata.normalize("NFD", ch)
                whole.append((nfd, ch))
                if not unicodedata.combining(ch):
                    parts.append((ch, nfd, 0))
        elif unicodedata.category(ch)[0] == "L" or unicodedata.category(ch) == "Nd":
            tag, form = decomposition.split()[0], unicodedata.normalize("NFKC", ch)
            if tag in ("<wide>", "<font>") or tag == "<compat>" and len(form) > 1 and "LIGATURE" in unicodedata.name(ch, ""):
                replace.append((ch, form, "width"))
    return replace, parts, whole


@functools.cache
def patterns() -> dict[str, str]:
    """Java patterns: which texts and words hold anything of the mapping."""
    replace, parts, whole = tables()
    pairs = [w for w, _ in whole if unicodedata.category(w[0])[0] == "L"]
    marks = _class(sorted({w[-1] for w in pairs}))
    one = _class([ch for ch, _, _ in replace])
    hidden = _class(list(_expanded(INVISIBLE)))
    look = f"[{LATIN}][{hidden}]*[{OTHER}]|[{OTHER}][{hidden}]*[{LATIN}]"
    inner = rf"\p{{L}}\p{{M}}\p{{N}}{hidden}"
    return {"one": f"[{one}]", "combining": rf"\p{{L}}[{hidden}]*[{marks}]", "lookalike": look, "any": rf"[{one}]|\p{{L}}[{marks}]|{look}", "inner": inner}


def _python(pattern: str) -> str:
    """A Java pattern's code points as Python writes them."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)


def words(rows: DataFrame, mask: bool) -> DataFrame:
    """(field, row_id, piece_no, piece) of the words that hold something of the mapping.

    With `mask` each garbled run (problem 1) counts as so many U+FFFD: what only stems from a wrong encoding is no case.
    """

    def make() -> Callable:
        import regex

        repair, p = Repair(None, STRICT), patterns()
        wanted, inner = regex.compile(_python(p["any"])), regex.compile(_python(f"[{p['inner']}]"))

        def doubtful(run: str) -> bool:
            return LOST in run or any("\x80" <= ch < "\xa0" for ch in run) or len(run) > 4 and all(ch <= "\xff" for ch in run) or bool(len(run) > 1 and repair.changes(run, "", ""))

        def each(field: str, row_id: int, text: str) -> Iterator[tuple]:
            if mask:
                kept, past = [], 0
                for start, end in suspects(text):
                    if doubtful(text[start:end]):
                        kept += (text[past:start], LOST * (end - start))
                        past = end
                text = "".join([*kept, text[past:]]) if kept else text
            last = 0
            for m in wanted.finditer(text):
                start, end = m.span()
                if start < last:
                    continue
                if inner.match(text, start):
                    while start > last and inner.match(text, start - 1):
                        start -= 1
                    while end < len(text) and inner.match(text, end):
                        end += 1
                last = end
                yield field, row_id, start, text[start:end]

        return each

    return flat_map(rows.where(F.col("text").rlike(COARSE)), make, "field string, row_id bigint, piece_no int, piece string", ["field", "row_id", "text"])


def kinds(rows: DataFrame) -> DataFrame:
    """(field, row_id, kind), each once, of (field, row_id, text).

    Null and empty texts hold no case; repeated rows count once; other columns are not carried.
    """
    spark, p = rows.sparkSession, patterns()
    replace, _, whole = tables()
    mapping = spark.createDataFrame([(ch, kind) for ch, _, kind in replace], "ch string, kind string")
    pairs = spark.createDataFrame(sorted({(w[0], w[1]) for w, _ in whole if len(w) == 2 and unicodedata.category(w[0])[0] == "L"} | {(unicodedata.normalize("NFC", w[:-1]), w[-1]) for w, _ in whole if len(w) > 2}), "before string, ch string").withColumn("accent", F.lit("combining"))
    found = words(rows.select("field", "row_id", "text").where(F.col("text").isNotNull()), mask=True)
    exploded = found.select("field", "row_id", F.col("piece").rlike(p["lookalike"]).alias("mixed"), F.regexp_extract_all("piece", F.lit(r"(?s)(.)"), 1).alias("chars")).select("field", "row_id", "mixed", "chars", F.posexplode("chars").alias("pos", "ch"))
    placed = exploded.withColumn("before", F.when(F.col("pos") > 0, F.element_at("chars", F.col("pos")))).drop("chars")
    joined = placed.join(F.broadcast(mapping), "ch", "left").join(F.broadcast(pairs), ["before", "ch"], "left")
    letter = F.when(F.col("mixed") & F.col("ch").rlike(f"[{OTHER}]"), F.lit("lookalike"))
    return joined.select("field", "row_id", F.explode(F.array_compact(F.array("kind", "accent", letter))).alias("kind")).distinct()


class Form:
    """Rebuilds words in one form."""

    def __init__(self) -> None:
        import regex

        replace, parts, whole = tables()
        self.form = {ch: to for ch, to, _ in replace}
        self.split, self.classes, self.whole = {ch: nfd for ch, nfd, _ in parts}, {ch: c for ch, _, c in parts if c}, dict(whole)
        self.mixed, self.memo = regex.compile(_python(patterns()["lookalike"])), {}

    def __call__(self, word: str) -> str:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO_LIMIT:
                self.memo.clear()
            got = self.memo[word] = self.rebuilt(word)
        return got

    def rebuilt(self, word: str) -> str:
        latin = LOOKALIKES if self.mixed.search(word) else {}
        marks: list[str] = []
        for ch in word:
            for to in self.form.get(ch, latin.get(ch, ch)):
                marks += self.split.get(to, to)
        clusters: list[list[str]] = []
        for mark in marks:
            if clusters and mark in self.classes:
                clusters[-1].append(mark)
            else:
                clusters.append([mark])
        out = []
        for first, *rest in clusters:
            ordered = first + "".join(sorted(rest, key=self.classes.get))
            # The longest beginning that one character stands for; marks that do not join it follow.
            size = next((k for k in range(len(ordered), 1, -1) if ordered[:k] in self.whole), 0)
            out.append(self.whole[ordered[:size]] + ordered[size:] if size else ordered)
        return "".join(out)


def unified(rows: DataFrame) -> DataFrame:
    """(field, row_id, text) with every text in one form; rows, repeated ones too, are kept one to one, null stays null.

    Look-alikes are replaced only inside words with Latin letters. Texts without anything of the mapping pass through;
    very long texts are rebuilt word by word. One scan, nothing is shuffled, and other columns are not carried.
    """

    def make() -> Callable:
        import regex

        p, form = patterns(), Form()
        coarse, wanted, inner = regex.compile(_python(COARSE)), regex.compile(_python(p["any"])), regex.compile(_python(f"[{p['inner']}]+"))
        before = regex.compile(_python(f"[{p['inner']}]+$"))

        def each(field: str, row_id: int, text: str | None) -> list:
            if text is None or text.isascii() or not coarse.search(text):
                return [(field, row_id, text)]
            out, last = [], 0
            for m in wanted.finditer(text):
                start, end = m.span()
                if start < last:
                    continue
                if inner.match(text, start):
                    if (head := text[last:start]) and (lead := before.search(head, max(0, len(head) - 400))):
                        start = last + lead.start()
                    end = inner.match(text, end).end() if inner.match(text, end) else end
                out += [text[last:start], form(text[start:end])]
                last = end
            return [(field, row_id, "".join([*out, text[last:]]))]

        return each

    return flat_map(rows, make, "field string, row_id bigint, text string", ["field", "row_id", "text"])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contract texts and pages with the kinds of odd characters they hold."""
    return kinds(text_fields(spark, folder, ["clean_text", "page_text"]))


def p7_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Contract texts and pages in one form."""
    return unified(text_fields(spark, folder, ["clean_text", "page_text"]))


def p7_residue(spark: SparkSession, folder: str) -> DataFrame:
    """(field, texts, left): how many texts there are, and in how many characters without width, odd spaces, full-width or
    styled letters are left after they were brought to one form."""
    left = F.count_if(F.col("text").rlike(patterns()["one"]))
    return p7_unified(spark, folder).groupBy("field").agg(F.count("*").alias("texts"), left.alias("left"))
