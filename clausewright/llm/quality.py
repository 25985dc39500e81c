"""Problem 10: text statistics per document, and whether it is prose.

Every document is cut into chunks of whole lines (a line beyond `LINE` characters into stretches); each chunk gives a
partial result of bounded size: counts of the blocks, the pieces between blank lines, that lie wholly inside it, and as
boundary state the features of the unfinished block at either end. The features add up, so neighbours merge by adding the
two halves of the block between them, in any grouping; the partial results of a document are merged as a tree. A document
of one chunk is a tree of one leaf. Documents beyond `SPREAD` characters are handed out to several tasks, by the same
chunks and the same merging, and their repeated segments are summed by a groupBy; the others need no shuffle.
Ratios and rule outcomes are derived from the merged counts.
"""

from __future__ import annotations

import functools
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import MEMO_LIMIT, flat_map
from clausewright.session import checkpoint_dir
from clausewright.sources.tables import table

#: Characters of a chunk, and of the longest stretch that is judged as one line.
CHUNK, LINE = 4_096, 4_096
#: Documents beyond so many characters are handed out in parts of this size. A matter of work in a task, not of results.
SPREAD = 1 << 20
#: Partial results merged by one call.
FAN = 16
#: Widths of lines above this count as this in the features of a block.
WIDEST = 1_024
#: Mean log probability of a letter below which words have no meaning: between shuffled letters and sound text.
SENSELESS = -2.75

#: Common words of the corpus' languages that are written with spaces.
COMMON = frozenset(
    "the of and to in a is that for on by with as be shall any all at or not this from an which it are may under "
    "der die das und zu den von mit für auf ist im dem nicht des eine ein wird oder bei "
    "le la les de des du et à en un une est pour par sur dans au ou que qui "
    "el los las y del en un una que por con se para su al o es "
    "के का की से में को और है पर ने यदि "
    "في من على إلى أن عن مع هذا التي أو "
    "کے کی کا سے میں کو اور ہے پر نے یا".split()
)
#: Lines that belong to a page's frame, not to its text.
FURNITURE = frozenset("home next prev previous login log in logout sign in search help terms share print upload download menu contact about privacy back to top cookie settings my library site map subscribe".split()) | {"back to top", "cookie settings", "my library", "sign in", "log in", "site map"}

_MARK = re.compile(r"\s*(?:[-–—*•·◦▪‣●○►»+]|\[[ xX✓]?\]|[☐☑✓✔]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\(?[ivxlc]{1,5}[.)])[\s　]+\S")
_HEX = re.compile(r"(?:[0-9a-fA-F]{2}[ :]){6,}|^[0-9a-fA-F]{6,8}[: ]\s+[0-9a-fA-F]{2,}")
_GAP = re.compile(r"\S(?: {3,}|\s*\t\s*|\s*\.{4,}\s*)(?=\S)|\t")
_SEGMENT = re.compile(r"[.?!;।。！？۔]+(?=\s|$)|[।。！？]+|\s[>|»·•](?=\s|$)")  # within a line
_MARKS = re.compile(r"[^\w\s\u0300-\u036f\u0600-\u0eff]|_")
_LATIN = re.compile("[A-Za-z]")
_BLANK = re.compile(r"\n[ \t\r　]*\n\s*")
_LETTER = np.full(0x250, 27, dtype=np.uint8)
for _c in range(26):
    _LETTER[ord("a") + _c] = _LETTER[ord("A") + _c] = _c
for _c, _to in (("àáâãäåāăą", "a"), ("çćč", "c"), ("èéêëēę", "e"), ("ìíîïī", "i"), ("ñń", "n"), ("òóôõöøō", "o"), ("ùúûüū", "u"), ("ýÿ", "y"), ("ß", "s")):
    for _x in _c + _c.upper():
        if ord(_x[0]) < 0x250:
            _LETTER[ord(_x[0])] = ord(_to) - ord("a")
_END = 26  # beside a word
_NUMBER = {chr(code): int(number) for code, number in enumerate(_LETTER) if number < 26}


def _triples(text: str) -> np.ndarray:
    """Numbers of the letter triples inside words of Latin letters, a word's ends included; other characters are 27 and end the run."""
    codes = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marks = _LETTER[np.minimum(codes, 0x24F)].astype(np.int32)
    marks = np.where(marks == 27, _END, marks)
    kept = marks[:-2] * 729 + marks[1:-1] * 27 + marks[2:]
    return kept[(marks[1:-1] != _END) & ((marks[:-2] != _END) | (marks[2:] != _END))]


class Letters:
    """P(letter | two before), smoothed, over the corpus."""

    UNIT = 1_000_000

    def __init__(self, counts: np.ndarray) -> None:
        table_ = counts.reshape(27, 27, 27).astype(np.float64)
        single = (table_.sum(axis=(0, 1)) + 1) / (table_.sum() + 27)
        # Whole numbers, so that sums are the same in any order.
        self.log = np.rint(self.UNIT * np.log((table_ + 20 * single) / (table_.sum(axis=2, keepdims=True) + 20))).astype(np.int64).reshape(-1)


def train(documents: DataFrame) -> tuple[Letters, int]:
    """Counts of letter triples over all documents, at most 19,683 numbers per task and for the driver; and how many
    characters the longest document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, longest = np.zeros(27**3, dtype=np.int64), 0
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t]
            longest = max(longest, *map(len, texts), 0)
            for at in range(0, len(texts), 256):
                counts += np.bincount(_triples(" ".join(texts[at : at + 256])), minlength=27**3)
        met = np.flatnonzero(counts)
        slots, n = [-1, *met.tolist()], [longest, *counts[met].tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(n, pa.int64())], names=["slot", "n"])

    counts, longest = np.zeros(27**3), 0
    for row in documents.select("text").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect():
        if row["slot"] < 0:
            longest = row["most"]
        else:
            counts[row["slot"]] = row["n"]
    return Letters(counts), longest


_STOPS = ".?!。！？।۔"
_ENDED = _STOPS + ":;”\"'»…"
_INSIDE = re.compile(r"[.?!] [A-ZÀ-Þ]|[।۔] ?\S|[。！？]\S")
_WIDE = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_DIGIT = re.compile(r"\d")
_BARE = re.compile(r";(?=\S|$)")
_COMMA = re.compile(r",(?=[^\s\d]|\"|$)")
_TRIM = ".,;:!?()[]\"'“”‘’«»。、，！？।۔"


class Line(NamedTuple):
    """What a block needs to know of a line."""

    size: int
    cells: int
    odd: bool  # signs, codes or furniture
    worded: bool  # hardly any digits
    marked: bool
    stop: bool
    inside: bool
    wide: bool
    first: int  # length of its first word
    log: int
    letters: int
    latin: bool


class Rest:
    """Features of the lines of a block that are no table row and no junk by themselves."""

    __slots__ = ("chars", "first", "gap", "gaps", "inside", "junk", "last", "latin", "letters", "log", "marked", "n", "short", "stops", "table", "wide", "widths")

    def __init__(self) -> None:
        self.n = self.chars = self.short = self.marked = self.stops = self.inside = self.wide = self.log = self.letters = self.table = self.junk = 0
        self.latin = False
        #: Widths of all lines but the first; what a line and the next line's first word need, but for the first pair.
        self.widths: dict[int, int] = {}
        self.gaps: dict[int, int] = {}
        self.first = self.last = self.gap = None

    @classmethod
    def of(cls, lines: list[Line]) -> Rest:
        """The features of some lines at once."""
        out = cls()
        out.n = len(lines)
        for line in lines:
            size = line.size
            out.chars += size
            out.short += size if size < 160 else 0
            out.marked += line.marked
            out.stops += line.stop
            out.inside += line.inside
            out.wide += line.wide
            out.log += line.log
            out.letters += line.letters
            out.latin |= line.latin
        if lines:
            out.first, out.last = ((line.size, line.first, line.stop) for line in (lines[0], lines[-1]))
        if out.n > 1:
            joints = [min(line.size + 1 + after.first, WIDEST) for line, after in zip(lines, lines[1:], strict=False)]
            out.gap, out.gaps, out.widths = joints[0], Counter(joints[1:]), Counter([min(line.size, WIDEST) for line in lines[1:]])
        return out

    def add(self, line: Line, table_row: bool, skip: bool) -> None:
        """`skip`: the line is taken for text although it may look like a table row or junk."""
        if not skip and (table_row or line.odd):
            if table_row:
                self.table += line.size
            else:
                self.junk += line.size
            return
        self.merge(Rest.of([line]))

    def merge(self, other: Rest) -> None:
        """This one followed by `other`."""
        self.table += other.table
        self.junk += other.junk
        if not other.n:
            return
        if not self.n:
            for name in ("n", "chars", "short", "marked", "stops", "inside", "wide", "log", "letters", "latin", "first", "last", "gap"):
                setattr(self, name, getattr(other, name))
            self.widths, self.gaps = dict(other.widths), dict(other.gaps)
            return
        joint = min(self.last[0] + 1 + other.first[1], WIDEST)
        if self.n == 1:
            self.gap = joint
        else:
            self.gaps[joint] = self.gaps.get(joint, 0) + 1
        width = min(other.first[0], WIDEST)
        self.widths[width] = self.widths.get(width, 0) + 1
        for own, more in ((self.gaps, other.gaps), (self.widths, other.widths)):
            for value, k in more.items():
                own[value] = own.get(value, 0) + k
        if other.n > 1:
            self.gaps[other.gap] = self.gaps.get(other.gap, 0) + 1
        self.last = other.last
        for name in ("n", "chars", "short", "marked", "stops", "inside", "wide", "log", "letters"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.latin |= other.latin

    def wrapped(self) -> bool:
        """Whether the lines are one text broken at a width: hardly any next word would have fitted, sentences end inside
        lines, or only the last line ends one. A title may stand above."""
        if self.inside > 0.2 * self.n or self.stops == 1 and self.last[2]:
            return True
        n, gaps, width = self.n - 1, self.gaps, max(self.widths)
        if self.n <= 3:
            n, gaps, width = self.n, Counter(self.gaps) + Counter([self.gap]), max(width, min(self.first[0], WIDEST))
        return sum(k for v, k in gaps.items() if v > width - 1) >= 0.65 * (n - 1)

    def even(self) -> bool:
        """The same for scripts without spaces: most lines but the last are as long as the longest."""
        widths = Counter(self.widths) + Counter([min(self.first[0], WIDEST)])
        longest = max(widths)
        if longest <= 24:
            return False
        full = sum(k for v, k in widths.items() if v >= longest - 2) - (min(self.last[0], WIDEST) >= longest - 2)
        return full > 0.6 * (self.n - 1)

    def listed(self) -> bool:
        """Whether the lines are short items."""
        wide = self.wide > 0.5 * self.n
        return self.n >= 3 and self.chars / self.n < (36 if wide else 62) and self.stops <= 0.4 * self.n and not (self.even() if wide else self.wrapped())


class Block:
    """Features of the lines between two blank lines, or of some of them; bounded, whatever the number of lines.

    Whether an inner line is a table row depends on its neighbours' cells, so the first line and the last stay pending
    until the block is known to begin or end with them. Rows are counted twice: with all lines looked at, and with lines
    of words taken for text, which holds if the block's letters turn out to have no meaning.
    """

    __slots__ = ("before", "common", "first", "last", "latin", "letters", "log", "looked", "n", "second", "taken", "words")

    def __init__(self) -> None:
        self.n = self.words = self.common = self.log = self.letters = 0
        self.latin = False
        self.looked, self.taken = Rest(), Rest()  # of the lines between the first and the last
        self.first: Line | None = None
        self.last: Line | None = None
        self.second = self.before = 0  # cells of the second line and of the one before the last

    def one(self, line: Line, words: int, common: int) -> Block:
        self.n, self.words, self.common, self.log, self.letters, self.latin = 1, words, common, line.log, line.letters, line.latin
        self.first = self.last = line
        return self

    def inner(self, line: Line, before: int, after: int) -> None:
        row = line.cells > 1 and line.cells in (before, after)
        self.looked.add(line, row, False)
        self.taken.add(line, row, line.worded)

    def merge(self, other: Block) -> Block:
        """This one followed by `other`, as a new block."""
        out = Block()
        if not self.n or not other.n:
            whole = self if self.n else other
            for name in self.__slots__:
                setattr(out, name, getattr(whole, name))
            out.looked, out.taken = Rest(), Rest()
            out.looked.merge(whole.looked)
            out.taken.merge(whole.taken)
            return out
        out.n, out.words, out.common, out.log, out.letters = (getattr(self, k) + getattr(other, k) for k in ("n", "words", "common", "log", "letters"))
        out.latin = self.latin or other.latin
        out.looked.merge(self.looked)
        out.taken.merge(self.taken)
        if self.n > 1:
            out.inner(self.last, self.before, other.first.cells)
        if other.n > 1:
            out.inner(other.first, self.last.cells, other.second)
            out.looked.merge(other.looked)
            out.taken.merge(other.taken)
        out.first, out.last = self.first, other.last
        out.second = self.second if self.n > 1 else other.first.cells
        out.before = other.before if other.n > 1 else self.last.cells
        return out


class Measure:
    """Counts of blocks, the pieces between blank lines."""

    NAMES = ("chars", "list", "table", "junk", "words", "word_chars", "common", "symbols", "visible", "lines", "ended")

    def __init__(self, letters: Letters) -> None:
        self.letters, self.memo, self.logs, self.by_triple = letters, {}, {}, letters.log.tolist()

    def token(self, raw: str) -> tuple[int, int, int]:
        """(letters of the word, whether it is a common one, marks) of a token."""
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        word = raw.strip(_TRIM).lower()
        got = len(word), int(word in COMMON), len(_MARKS.findall(raw))
        if len(raw) < 64:
            self.memo[raw] = got
        return got

    def meaning(self, line: str) -> tuple[int, int]:
        """(log probability, number) of the line's letters."""
        logs, log, n = self.logs, 0, 0
        for raw in line.split():
            got = logs.get(raw)
            if got is None:
                if len(logs) > MEMO_LIMIT:
                    logs.clear()
                got = self.triples(raw)
                if len(raw) < 64:
                    logs[raw] = got
            log += got[0]
            n += got[1]
        return log, n

    def triples(self, raw: str) -> tuple[int, int]:
        """The same of one token."""
        if len(raw) > 30:
            kept = _triples(raw)
            return int(self.letters.log[kept].sum()), len(kept)
        before, here, log, n = _END, _END, 0, 0
        for ch in (*raw, " "):
            after = _NUMBER.get(ch, _END)
            if here != _END and (before != _END or after != _END):
                log += self.by_triple[before * 729 + here * 27 + after]
                n += 1
            before, here = here, after
        return log, n

    def counted(self, line: str, size: int, final: bool, out: Counter) -> tuple[int, int, int, int]:
        """Adds the line's plain counts to `out`; (words, common words, visible characters, length of the longest token)."""
        known, words, letters, common, marks, longest = self.memo, 0, 0, 0, 0, 0
        tokens = line.split()
        for raw in tokens:
            try:
                a, b, c = known[raw]
            except KeyError:
                a, b, c = self.token(raw)
            if a:
                words += 1
                letters += a
                common += b
            marks += c
            if len(raw) > longest:
                longest = len(raw)
        visible = sum(map(len, tokens))
        out["words"] += words
        out["word_chars"] += letters
        out["common"] += common
        out["symbols"] += marks
        out["visible"] += visible
        out["chars"] += size
        if final:
            out["lines"] += 1
            out["ended"] += line.rstrip()[-1:] in _ENDED
        return words, common, marks > 0.55 * visible, longest

    @staticmethod
    def odd(line: str, stripped: str, signs: bool, longest: int) -> bool:
        if signs or longest >= 32 and longest > 0.75 * len(stripped) and stripped.isascii():
            return True
        return len(stripped) < 20 and stripped.lower() in FURNITURE or stripped[0] == "©" or bool(_DIGIT.search(stripped) and _HEX.search(line))

    @staticmethod
    def cells(line: str) -> int:
        """Cells of a line that looks like a row: by bars, tabs, wide gaps, leaders or semicolons without a space after."""
        if "|" in line and (line.count("|") > 1 or " | " in line):
            return line.strip().strip("|").count("|") + 1
        if "   " in line or "\t" in line or "...." in line:
            n = len(_GAP.findall(line))
            if n and ("\t" in line or n > 1 or ". ...." in line or " ...." in line):
                return n + 1 if "...." not in line else 2
        if ";" in line and "; " not in line and (bare := len(_BARE.findall(line))) > 1:
            return bare + 1
        commas = len(_COMMA.findall(line)) if "," in line and ", " not in line else 0
        return commas + 1 if commas > 1 else 1

    def line(self, line: str, size: int, signs: bool, longest: int, meant: bool, few: bool = False) -> Line:
        """The features of a line; with `meant` its letters need no look, with `few` lines in the block their form needs none."""
        stripped = line.strip()
        tokens = stripped.split(None, 1)
        return Line(
            size, self.cells(line), self.odd(line, stripped, signs, longest), not _DIGIT.search(stripped) or sum(map(str.isdigit, stripped)) < 0.1 * size,
            size < 160 and bool(_MARK.match(line)), stripped[-1] in _STOPS, not few and bool(_INSIDE.search(stripped)), not few and bool(_WIDE.search(stripped)),
            len(tokens[0]), *((0, 0) if meant else self.meaning(stripped)), not meant and bool(_LATIN.search(stripped)),
        )

    def open(self, units: list[Unit], out: Counter) -> Block:
        """The features of the lines of a block that may go on beyond them; their plain counts are added to `out`."""
        block = Block()
        for text, size, final in units:
            words, common, signs, longest = self.counted(text, size, final, out)
            if size and not text.isspace():
                block = block.merge(Block().one(self.line(text, size, signs, longest, False), words, common))
        return block

    def closed(self, units: list[Unit], out: Counter) -> None:
        """Adds the counts of a whole block to `out`."""
        counted = [(text, size, *self.counted(text, size, final, out)) for text, size, final in units]
        words, common = sum(c[2] for c in counted), sum(c[3] for c in counted)
        meant = words > 7 and common > words / 4
        if len(counted) == 1 and meant:
            text, size, _, _, signs, longest = counted[0]
            stripped = text.strip()
            if self.cells(text) > 1:
                out["table"] += size
            elif self.odd(text, stripped, signs, longest):
                out["junk"] += size
            elif size < 160 and _MARK.match(text):
                out["list"] += size
            return
        lines = [self.line(text, size, signs, longest, meant, len(counted) < 3) for text, size, _, _, signs, longest in counted if not text.isspace()]
        block = Rest.of(lines) if not meant else None
        senseless = not meant and self.senseless(block)
        last, rest, table_chars, junk_chars = len(lines) - 1, [], 0, 0
        for k, line in enumerate(lines):
            if senseless and line.worded or line.cells < 2 and not line.odd:
                rest.append(line)
            elif line.cells > 1 and (k in (0, last) or line.cells in (lines[k - 1].cells, lines[k + 1].cells)):
                table_chars += line.size
            elif line.odd:
                junk_chars += line.size
            else:
                rest.append(line)
        of = block if block and len(rest) == len(lines) else Rest.of(rest)
        of.table, of.junk = table_chars, junk_chars
        self.judged(of, len(lines), meant, senseless, out)

    @staticmethod
    def senseless(of: Block | Rest) -> bool:
        return of.latin and of.letters >= 40 and of.log < SENSELESS * Letters.UNIT * of.letters

    def settle(self, block: Block, out: Counter) -> None:
        """Adds the block's characters by kind, now that it is whole."""
        if not block.n:
            return
        # Where every fourth word is a common one the letters need no look.
        sound = block.words > 7 and block.common > block.words / 4
        senseless = not sound and self.senseless(block)
        rest, inner = Rest(), block.taken if senseless else block.looked
        for line in (block.first, None, block.last) if block.n > 1 else (block.first,):
            if line is None:
                rest.merge(inner)
            else:
                rest.add(line, line.cells > 1, senseless and line.worded)
        self.judged(rest, block.n, sound, senseless, out)

    def judged(self, rest: Rest, n: int, sound: bool, senseless: bool, out: Counter) -> None:
        """Adds the characters of a block of `n` lines, of which `rest` is left."""
        out["table"] += rest.table
        out["junk"] += rest.junk
        if not rest.n:
            return
        # Tables and furniture may have hidden what the other lines are.
        if senseless if rest.n == n else not sound and self.senseless(rest):
            out["junk"] += rest.chars
        elif rest.marked >= 0.5 * rest.n and (rest.marked > 1 or rest.n == 1):
            out["list"] += rest.short
        elif rest.listed():
            out["list"] += rest.chars


class Unit(NamedTuple):
    """A line, or a stretch of one beyond `LINE` characters; final if a line ends with it."""

    text: str
    size: int
    final: bool


def units(text: str, begun: bool = False, broken: bool = False) -> Iterator[Unit]:
    """The units of a text; `begun` if it starts inside a line, `broken` if it ends inside one.

    A stretch ends after the last sentence, else after the last space within `LINE` characters of its start, else there,
    so cutting goes on alike wherever it begins anew.
    """
    lines = text.split("\n")
    for k, line in enumerate(lines):
        inside, unfinished = begun and k == 0, broken and k == len(lines) - 1
        if len(line) <= LINE and not inside and not unfinished:
            yield Unit(line, len(line.strip()), True)
            continue
        at, past = 0, len(line)
        if not inside:
            at += len(line) - len(line.lstrip())
        if not unfinished:
            past = max(at, len(line.rstrip()))
        if at == past and not inside:
            yield Unit("", 0, True)
        while at < past:
            end = past
            if past - at > LINE or unfinished:
                high = min(past, at + LINE)
                end = max((m.end() for m in _SEGMENT.finditer(line, at, high)), default=0) or line.rfind(" ", at, high) + 1 or high
            yield Unit(line[at:end], end - at, end == past and not unfinished)
            at = end


def chunks(text: str, size: int = CHUNK, begun: bool = False, broken: bool = False) -> Iterator[list[Unit]]:
    """Runs of units of at most `size` characters in all, but at least one unit; together they are the units of the text."""
    run, held = [], 0
    for unit in units(text, begun, broken):
        if run and held + len(unit.text) > size:
            yield run
            run, held = [], 0
        run.append(unit)
        held += len(unit.text) + 1
    if run:
        yield run


def _hash(segment: str) -> int:
    return xxhash.xxh3_64_intdigest(segment.encode("utf-8", "surrogatepass")) - (1 << 63)


class Partial:
    """Counts of whole blocks between two unfinished ones; without a blank line all is `head` and `tail` is null."""

    def __init__(self, head: Block | None = None, tail: Block | None = None, counts: Counter | None = None) -> None:
        self.head, self.tail, self.counts = head or Block(), tail, counts if counts is not None else Counter()


def segments(lines: Iterable[str]) -> Counter[str]:
    return Counter(s for line in lines for piece in _SEGMENT.split(line) if (s := piece.strip()))


class Repeats(NamedTuple):
    """All and distinct segments of a document, and which share of their characters is in those met more than twice."""

    total: int = 0
    distinct: int = 0
    share: float = 0.0


NO_REPEATS = Repeats()


def repeats(text: str) -> Repeats:
    counts = segments(unit.text for unit in units(text))
    size = sum(n * len(s) for s, n in counts.items())
    return Repeats(sum(counts.values()), len(counts), sum(n * len(s) for s, n in counts.items() if n > 2) / max(1, size))


def blocks(run: Iterable[Unit]) -> list[list[Unit]]:
    """The units between blank lines; the first group and the last may be empty."""
    out: list[list[Unit]] = [[]]
    for unit in run:
        if unit.size or not unit.final:
            out[-1].append(unit)
        elif out[-1] or len(out) == 1:
            out.append([])
    return out


def part(run: list[Unit], measure: Measure) -> Partial:
    """The partial result of a chunk."""
    groups, counts = blocks(run), Counter()
    head = measure.open(groups[0], counts)
    for group in groups[1:-1]:
        measure.closed(group, counts)
    return Partial(head, measure.open(groups[-1], counts) if len(groups) > 1 else None, counts)


def merge(a: Partial, b: Partial, measure: Measure) -> Partial:
    """The partial result of two neighbouring chunks; the block across their border is closed if both its ends are known."""
    counts = a.counts + b.counts
    if a.tail is None:
        return Partial(a.head.merge(b.head), b.tail, counts)
    middle = a.tail.merge(b.head)
    if b.tail is None:
        return Partial(a.head, middle, counts)
    measure.settle(middle, counts)
    return Partial(a.head, b.tail, counts)


def tree(parts: list[Partial], measure: Measure) -> Partial:
    """Neighbours merged level by level, `FAN` at a time."""
    while len(parts) > 1:
        parts = [functools.reduce(lambda a, b: merge(a, b, measure), parts[k : k + FAN]) for k in range(0, len(parts), FAN)]
    return parts[0] if parts else Partial()


def whole(text: str, measure: Measure, size: int = CHUNK) -> Partial:
    """The partial result of a text: that of its chunks, merged. Of a single chunk all blocks are whole."""
    if len(text) > size:
        return tree([part(run, measure) for run in chunks(text, size)], measure)
    out = Partial(tail=Block())
    for group in blocks(units(text)):
        if group:
            measure.closed(group, out.counts)
    return out


#: The columns of the statistics.
STATISTICS = (
    "n_chars bigint, n_lines bigint, n_ended bigint, n_words bigint, n_common bigint, mean_word_length double, symbol_ratio double, ended_lines double, common_words double, "
    "list_share double, table_share double, junk_share double, kind string"
)


def outcome(p: Partial, measure: Measure, repeated: Repeats = NO_REPEATS) -> tuple:
    """Ratios, and the kind: prose, or what most of the rest is if that rest is more than half of the characters."""
    c = Counter(p.counts)
    for end in (p.head, p.tail or Block()):
        measure.settle(end, c)
    chars = c["chars"]
    if not chars:
        return 0, 0, 0, 0, 0, None, None, None, None, 0.0, 0.0, 0.0, "blank"
    shares = {k: c[k] / chars for k in ("list", "table", "junk")}
    if repeated.total >= 4 and repeated.distinct <= 0.4 * repeated.total and repeated.share > 0.5 and shares["table"] < 0.5:
        shares = {"list": 0.0, "table": shares["table"], "junk": max(shares["junk"], min(1.0 - shares["table"], repeated.share))}
    kind = max(shares, key=lambda k: shares[k]) if sum(shares.values()) > 0.5 else "prose"
    words = c["words"]
    return (
        chars, c["lines"], c["ended"], words, c["common"], c["word_chars"] / words if words else None, c["symbols"] / max(1, c["visible"]), c["ended"] / max(1, c["lines"]),
        c["common"] / words if words else None, shares["list"], shares["table"], shares["junk"], kind,
    )


def repeats_of(pieces: DataFrame) -> DataFrame:
    """(row, total, distinct, share): the Repeats of each document handed out as (row, text, begun, broken), all its
    segments counted. A task adds up its own first; the rest is one sum per document and segment."""

    def each(row: int, text: str, begun: bool, broken: bool) -> Iterator[tuple]:
        for segment, n in segments(unit.text for unit in units(text, begun, broken)).items():
            yield row, _hash(segment), n, len(segment)

    counts = flat_map(pieces, lambda: each, "row bigint, key bigint, n bigint, size bigint", ["row", "text", "begun", "broken"])
    summed = counts.groupBy("row", "key").agg(F.sum("n").alias("n"), F.max("size").alias("size"))
    sizes = F.col("n") * F.col("size")
    return summed.groupBy("row").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), (F.coalesce(F.sum(F.when(F.col("n") > 2, sizes)), F.lit(0)) / F.greatest(F.lit(1), F.sum(sizes))).alias("share"))


def handed_out(long: DataFrame, spread: int) -> DataFrame:
    """(row, doc_id, at, text, begun, broken): documents as parts of about `spread` characters that end with a unit, cut in one pass."""

    def each(row: int, doc_id: int, text: str) -> Iterator[tuple]:
        text = text.replace("\r", "")
        begun = False
        for at, run in enumerate(chunks(text, spread)):
            broken = not run[-1].final
            yield row, doc_id, at, "".join(u.text + "\n" * u.final for u in run).removesuffix("\n"), begun, broken
            begun = broken

    numbered = long.withColumn("row", F.monotonically_increasing_id())
    return flat_map(numbered, lambda: each, "row bigint, doc_id bigint, at int, text string, begun boolean, broken boolean", ["row", "doc_id", "text"]).checkpoint()


def statistics(documents: DataFrame, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(doc_id, statistics) of every row of (doc_id, text).

    A null text gives null statistics and no kind, an empty or blank one zero characters and the kind `blank`. Repeated
    rows are kept. Every document is cut into chunks of `chunk` characters and merged as a tree; those beyond `spread`
    characters by several tasks. Neither size changes a result. Other columns are not carried.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text")
    letters, longest = train(rows)
    shared = spark.sparkContext.broadcast(letters.log)

    def ready() -> Measure:
        letters = Letters.__new__(Letters)
        letters.log = shared.value
        return Measure(letters)

    def at_once() -> Callable:
        measure = ready()

        def each(doc_id: int, text: str | None) -> list:
            if text is None:
                return [(doc_id, *[None] * 13)]
            text = text.replace("\r", "")
            return [(doc_id, *outcome(whole(text, measure, chunk), measure, repeats(text)))]

        return each

    schema = f"doc_id bigint, {STATISTICS}"
    if longest <= spread:
        return flat_map(rows, at_once, schema, ["doc_id", "text"])
    short = flat_map(rows.where(F.coalesce(F.length("text"), F.lit(0)) <= spread), at_once, schema, ["doc_id", "text"])

    def first() -> Callable:
        measure = ready()

        def each(row: int, doc_id: int, at: int, text: str, begun: bool, broken: bool) -> list:
            parts = [part(run, measure) for run in chunks(text, chunk, begun, broken)]
            return [(row, doc_id, at, pickle.dumps(tree(parts, measure)))]

        return each

    def joined() -> Callable:
        measure = ready()

        def each(row: int, doc_id: int, at: int, parts: list) -> list:
            return [(row, doc_id, at, pickle.dumps(tree([pickle.loads(p["state"]) for p in sorted(parts, key=lambda p: p["at"])], measure)))]

        return each

    def last() -> Callable:
        measure = ready()
        return lambda doc_id, state, total, distinct, share: [(doc_id, *outcome(pickle.loads(state), measure, Repeats(total or 0, distinct or 0, share or 0.0)))]

    level = "row bigint, doc_id bigint, at int, state binary"
    checkpoint_dir(spark)
    pieces = handed_out(rows.where(F.length("text") > spread), spread).repartition("row", "at")
    parts = flat_map(pieces, first, level, ["row", "doc_id", "at", "text", "begun", "broken"])
    count = -(-2 * longest // spread)  # a part holds more than half of `spread` with its neighbour
    while count > 1:
        grouped = parts.groupBy("row", "doc_id", F.floor(F.col("at") / FAN).cast("int").alias("at")).agg(F.collect_list(F.struct("at", "state")).alias("parts"))
        parts, count = flat_map(grouped, joined, level, ["row", "doc_id", "at", "parts"]), -(-count // FAN)
    counted = parts.join(repeats_of(pieces), "row", "left")
    return short.unionByName(flat_map(counted, last, schema, ["doc_id", "state", "total", "distinct", "share"]))


def p10_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document."""
    return statistics(table(spark, folder, "documents"))


def p10_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The plain counts of every document that isn't null."""
    counted = statistics(table(spark, folder, "documents")).where(F.col("kind").isNotNull())
    return counted.select("doc_id", "n_chars", "n_lines", "n_ended", "n_words", "n_common")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are mostly a list, a table or junk."""
    return statistics(table(spark, folder, "documents")).where(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind").distinct()
