"""Problem 5: noise in text from scanned pages, reported by kind and repaired into continuous paragraphs.

Words are judged against the counts of all words of the corpus. An averaged perceptron edits words: for a word that is
rare beside one it could have been, it scores the operations (replace, insert, delete) that lead there from its
characters, their neighbours and both counts; `keep` is the zero point. It is trained on sound words and on copies of
them with typical recognition errors. At a line end it scores the operations join (the hyphen goes) and keep (a
compound broken at its own hyphen), by the counts of both forms and of the parts; it is trained on sound words and
compounds that are cut. Page furniture is told by a perceptron over lines: their place on the page, shape, words and
surroundings. It learns from lines at the edge of pages that come again on other pages of the document or hold the
page's own number, and from known forms; lines inside pages are the others.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import FIELDS, MEMO_LIMIT, flat_map
from clausewright.session import checkpoint_dir
from clausewright.sources.tables import table

#: Words with fewer than this share of all words are left out of the broadcast counts, so that they hold at most a
#: million words at any size of the corpus. They can't be what an odd word stands for; how often they occur themselves
#: is looked up by a join.
LEAST_SHARE = 1e-6
#: Below this count a word says nothing, however small the corpus.
LEAST_COUNT = 4
#: A sound word must be so many times as frequent as the odd one.
TIMES = 20

#: What was read, and what may have stood there.
CONFUSED = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("!", "i"), ("!", "l"), ("+", "t"), ("|", "l"), ("|", "i"), ("$", "s"), ("@", "a"), ("€", "e"), ("(", "c"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("]", "j"), ("£", "e"),
    ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("h", "li"), ("h", "ti"), ("li", "h"), ("ti", "n"), ("ri", "n"), ("n", "ri"), ("nn", "m"), ("ii", "u"), ("u", "ii"), ("tl", "d"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"), ("o", "c"), ("c", "o"), ("f", "t"), ("t", "f"), ("a", "o"), ("o", "a"), ("n", "u"), ("u", "n"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"), ("s", "a"), ("in", "m"), ("m", "in"), ("iii", "m"), ("fi", "h"), ("ln", "m"), ("lc", "k"), ("k", "lc"), ("ll", "u"), ("j", "i"), ("ä", "a"), ("a", "ä"), ("u", "ü"), ("o", "ö"), ("é", "e"), ("e", "é"), ("è", "e"), ("ß", "b"), ("b", "ß"),
)
_TRUE: dict[str, list[str]] = {}
for _seen, _true in CONFUSED:
    _TRUE.setdefault(_seen, []).append(_true)
_SEEN = re.compile("|".join(sorted(map(re.escape, _TRUE), key=len, reverse=True)))

_TRIM = ".,;:?()[]{}\"'“”‘’„«»…–—*"
_WORDLIKE = re.compile(r"[a-zà-öø-ÿœœß0-9!+|$@€£(\]]*[a-zà-öø-ÿœß][a-zà-öø-ÿœß0-9!+|$@€£(\]]*")
_SOUND = re.compile(r"[a-zà-öø-ÿœß]+(?:['’-][a-zà-öø-ÿœß]+)*")
#: A word cut at a line end: hyphen, line break, and a letter on either side.
CUT = re.compile(r"(?<=[^\W\d_])[-‐][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_BEFORE, _AFTER = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*$"), re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")


def core(raw: str) -> str:
    return raw.strip(_TRIM).lower()


class Editor:
    """Judges words by the counts of the corpus and the perceptron's weights.

    `least` is the least count of a word in `counts`. All tests of counts are relative to it or to another word's count,
    so a corpus of many times the size with the same shares is judged alike. `rare` has exact counts of words below it.
    """

    def __init__(self, counts: dict[str, int], weights: dict[str, float], least: float = LEAST_COUNT, rare: dict[str, int] | None = None) -> None:
        self.deferred = False
        self.counts, self.weights, self.least, self.rare, self.memo, self.cuts = counts, weights, least, rare or {}, {}, {}

    def count(self, word: str) -> int:
        return self.counts.get(word) or self.rare.get(word, 0)

    def edits(self, word: str, whole: str = "", own: int | None = None) -> Iterator[tuple[str, tuple[str, ...]]]:
        """(result, features) of one or two operations that lead to a word far more frequent than this one.

        A part of a compound is as frequent as the compound at least. In training a damaged word's count is given.
        """
        own = max(self.count(word), self.count(whole)) if own is None else own
        firsts = list(self.steps(word))
        for result, at, seen, true in firsts:
            if (n := self.counts.get(result, 0)) >= max(2 * self.least, TIMES * own) or self.known_parts(result, own):
                yield result, self.features(word, result, at, seen, true, own, n, 1)
        if len(word) > 4 and own < self.least:
            for between, _, _, _ in firsts:
                for result, at, seen, true in self.steps(between):
                    if result != word and (n := self.counts.get(result, 0)) >= max(8 * self.least, TIMES * own):
                        yield result, self.features(word, result, at, seen, true, own, n, 2)

    def known_parts(self, result: str, own: int) -> bool:
        parts = re.split("['’-]", result)
        return len(parts) > 1 and own < self.least and all(self.counts.get(p, 0) >= max(2 * self.least, TIMES * own) or len(p) < 2 for p in parts)

    @staticmethod
    def steps(word: str) -> Iterator[tuple[str, int, str, str]]:
        for at in range(len(word)):
            for size in (1, 2, 3):
                for true in _TRUE.get(word[at : at + size], ()):
                    if at + size <= len(word):
                        yield word[:at] + true + word[at + size :], at, word[at : at + size], true

    def features(self, word: str, result: str, at: int, seen: str, true: str, own: int, n: int, steps: int) -> tuple[str, ...]:
        unit = self.least / LEAST_COUNT
        ratio = int(math.log2((n / unit + 1) / (own / unit + 1)))
        own = int(own / unit) if own >= self.least else 0
        op = "replace" if len(seen) == len(true) else "insert" if len(seen) < len(true) else "delete"
        left, right = word[at - 1 : at] or "^", word[at + len(seen) : at + len(seen) + 1] or "$"
        odd = not seen.isalpha()
        return (f"op:{op}", f"p:{seen}>{true}", f"r:{min(ratio, 12)}", f"o:{odd}", f"or:{odd}{min(ratio, 12)}", f"l:{left}{seen}", f"g:{seen}{right}", f"n:{min(len(word), 8)}", f"own:{min(own, 5)}", f"st:{steps}{odd}")

    def joint(self, left: str, right: str, hidden: bool = False) -> tuple[str, ...]:
        """Features of joining the parts of a word cut at its hyphen; with `hidden` the forms count as never met."""
        unit = self.least / LEAST_COUNT
        met = lambda word: self.counts.get(word, 0) / unit
        whole, compound = (0.0, 0.0) if hidden else (met(left + right), met(f"{left}-{right}"))
        ratio = round(math.log2((whole + 0.5) / (compound + 0.5)))
        parts = f"{met(left) >= LEAST_COUNT}{met(right) >= LEAST_COUNT}"
        seen = f"{whole > 0}{compound > 0}"
        return ("j:", f"j:r{max(-6, min(6, ratio))}", f"j:s{seen}", f"j:p{parts}", f"j:sp{seen}{parts}", f"j:n{min(len(left), 4)}{min(len(right), 4)}")

    def joins(self, left: str, right: str) -> bool:
        """Whether parts cut at a line end are one word without the hyphen; the zero point is to keep it."""
        key = left + "\n" + right
        got = self.cuts.get(key)
        if got is None:
            if len(self.cuts) > MEMO_LIMIT:
                self.cuts.clear()
            features = self.joint(left.lower(), right.lower())
            # Weights that were fitted without any word to cut say nothing: then a hyphen at a line end is taken for a cut.
            got = self.cuts[key] = features[0] not in self.weights or sum(self.weights.get(f, 0.0) for f in features) > 0
        return got

    def rejoined(self, text: str) -> tuple[str, bool]:
        """The text with words joined over line ends, and whether any was cut in two (and not only broken at its own hyphen)."""
        out, last, cut = [], 0, False
        for m in CUT.finditer(text):
            left, right = _BEFORE.search(text[max(last, m.start() - 60) : m.start()]), _AFTER.match(text, m.end(), m.end() + 60)
            whole = self.joins(left.group(), right.group()) if left and right else True
            cut |= whole
            out += [text[last : m.start()], "" if whole else "-"]
            last = m.end()
        return "".join([*out, text[last:]]), cut

    def __call__(self, raw: str) -> str | tuple[str, ...] | None:
        """What the raw token should read; null to keep it. While judgements are `deferred`, the rare words on whose counts
        one depends."""
        try:
            return self.memo[raw]
        except KeyError:
            pass
        if len(self.memo) > MEMO_LIMIT:
            self.memo.clear()
        got = self.memo[raw] = (self.deferred and tuple(sorted(self.unsure(raw)))) or self.judge(raw)
        return got

    @staticmethod
    def parts(raw: str, word: str) -> list[str]:
        """The parts of a compound and what is between them; none of an address or a code."""
        return [] if len(word) < 3 or "@" in raw and "." in raw or "/" in word or re.search(r"\d\d", word) else re.split("(['’-])", word)

    @staticmethod
    def judged(part: str) -> bool:
        return len(part) > 2 and bool(_WORDLIKE.fullmatch(part)) and sum(map(str.isdigit, part)) <= max(1, len(part) // 3)

    def unsure(self, raw: str) -> set[str]:
        """The words below the least count on whose exact counts the judgement of the raw token depends."""
        word = core(raw)
        if word in self.counts and "-" not in word and "'" not in word and "’" not in word:
            return set()
        hit = [part for part in self.parts(raw, word) if self.judged(part) and (part not in self.counts or word not in self.counts) and next(self.edits(part, word), None)]
        return {w for w in (word, *hit) if w not in self.counts and _SOUND.fullmatch(w)} if hit else set()

    def judge(self, raw: str) -> str | None:
        word = core(raw)
        parts = self.parts(raw, word)
        for k, part in enumerate(parts):
            if not self.judged(part):
                continue
            best, result = 0.0, None
            for to, features in self.edits(part, word):
                score = sum(self.weights.get(f, 0.0) for f in features)
                if score > best:
                    best, result = score, to
            if result:
                parts[k] = result
                fixed = "".join(parts)
                lead = len(raw) - len(raw.lstrip(_TRIM))
                body = raw[lead : lead + len(word)]
                fixed = fixed.upper() if body.isupper() and len(body) > 1 else fixed[0].upper() + fixed[1:] if body[:1].isupper() else fixed
                return raw[:lead] + fixed + raw[lead + len(word) :]
        return None


def train(counts: dict[str, int], least: float = LEAST_COUNT, seed: int = 11, words: int = 6_000, rounds: int = 4) -> dict[str, float]:
    """Weights from the sound words of the counts: undamaged words must be kept, damaged copies led back."""
    rng = random.Random(seed)
    pool = sorted((w for w, n in counts.items() if len(w) > 3 and n >= 2 * least and w.isalpha()), key=lambda w: (-counts[w], w))[: 4 * words]
    weights: Counter[str] = Counter()
    total: Counter[str] = Counter()
    editor, step = Editor(counts, weights, least), 1
    damage: dict[str, list[str]] = {}
    for seen, true in CONFUSED[: 22 + 22]:
        damage.setdefault(true, []).append(seen)
    samples = []
    for word in rng.sample(pool, min(words, len(pool))):
        spots = [(k, size, seen) for k in range(len(word)) for size in (1, 2) for seen in damage.get(word[k : k + size], ())]
        # A word beside one so much more frequent may be a misreading itself.
        if not any(counts.get(to, 0) >= TIMES**2 * counts[word] for to, _, _, _ in editor.steps(word)):
            samples.append((word, None, None))
        # Misreadings recur in proportion to the corpus, so damaged copies of frequent words are met often as well.
        for k, size, seen in rng.sample(spots, min(4, len(spots))) if counts[word] >= 2 * TIMES * least else ():
            bad = word[:k] + seen + word[k + size :]
            if bad not in counts:
                samples.append((bad, word, int(least * (counts[word] / (TIMES * least)) ** rng.random())))
        if spots:
            k, size, seen = rng.choice(spots)
            bad = word[:k] + seen + word[k + size :]
            if bad not in counts:
                samples.append((bad, word, 0))
        # Rare sound words (names and the like) stand for themselves.
    rare = sorted(w for w, n in counts.items() if n < 4 * least and len(w) > 3 and w.isalpha())
    samples += [(w, None, None) for w in rng.sample(rare, min(words // 2, len(rare)))]
    described = [(goal, list(editor.edits(word, own=own))) for word, goal, own in samples]
    described = [(goal, edits) for goal, edits in described if edits]
    # Words cut anywhere are to be joined, compounds broken at their own hyphen to be kept, whether their form is met elsewhere or not.
    compounds = sorted((w for w, n in counts.items() if w.count("-") == 1 and n >= 2 * least and min(map(len, w.split("-"))) > 1), key=lambda w: (-counts[w], w))[: 4 * words]
    for word in rng.sample(pool, min(words, len(pool))):
        if len(word) > 4:
            at = rng.randint(2, len(word) - 2)
            described.append(("join", [("join", editor.joint(word[:at], word[at:], rng.random() < 0.3))]))
    for word in rng.sample(compounds, min(words, len(compounds))):
        described.append((None, [("join", editor.joint(*word.split("-"), rng.random() < 0.3))]))
    for _ in range(rounds):
        rng.shuffle(described)
        for goal, edits in described:
            best, chosen = 0.0, None
            for to, features in edits:
                score = sum(weights[f] for f in features)
                if score > best:
                    best, chosen = score, (to, features)
            if (chosen[0] if chosen else None) != goal:
                if goal:
                    right = next((f for to, f in edits if to == goal), ())
                    for f in right:
                        weights[f] += 1
                        total[f] += step
                if chosen:
                    for f in chosen[1]:
                        weights[f] -= 1
                        total[f] -= step
            step += 1
    return {f: w - total[f] / step for f, w in weights.items() if w or total[f]}


_NUMBER = r"(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})"
#: Forms of page numbers.
PAGE_NO = re.compile(rf"(?:[-–—]\s*{_NUMBER}\s*[-–—]|\[\s*{_NUMBER}\s*/\s*{_NUMBER}\s*\]|(?:page|pg|p|seite|s|página|pág|पृष्ठ|صفحة|第)\.?\s*{_NUMBER}(?:\s*(?:of|/|von|de|sur)\s*{_NUMBER})?\.?|{_NUMBER}\s*\|\s*p\s?a\s?g\s?e|{_NUMBER}\s*(?:of|/)\s*{_NUMBER}|{_NUMBER})", re.IGNORECASE)
_TAIL = re.compile(rf"(?P<head>.{{6,}}?)(?:\s+[|/·•–-]\s+|\s{{2,}}|\t)(?P<no>{PAGE_NO.pattern})$", re.IGNORECASE)
_LEAD = re.compile(rf"(?P<no>{PAGE_NO.pattern})(?:\s+[|/·•–-]\s+|\s{{2,}}|\t)(?P<head>.{{6,}})$", re.IGNORECASE)
_FIRM = r"(?:limited|ltd\.?|llp|llc|inc\.?|corporation|company|partnership|foundation|trust|society)"
#: Forms of running headers: a reference, a title with a firm, a title with the kind of copy.
HEADER = re.compile(rf"(?:ref\.?\s+)?[A-Z0]{{2,5}}-\d{{2,5}}/\d{{2,4}}\b.*|[^.:;?!\d]{{4,60}}\s[-–—|/]\s.{{3,60}}{_FIRM}|[^.:;?!\d]{{4,60}}\([^()]* copy\)", re.IGNORECASE)


def furniture(line: str) -> tuple[bool, bool]:
    """(is a header, holds a page number) by a line's form."""
    line = line.strip()
    if not line or len(line) > 110:
        return False, False
    if PAGE_NO.fullmatch(line):
        return False, True
    for pattern in (_TAIL, _LEAD):
        if (m := pattern.fullmatch(line)) and HEADER.fullmatch(m.group("head").strip()):
            return True, True
    return bool(HEADER.fullmatch(line)), False


class Placed(NamedTuple):
    """A line that may be furniture: where it stands, and what stands around it."""

    start: int
    end: int
    line: str
    place: str
    before: str  # the last character of the line above: a stop, another, or none
    after: str  # the first character of the line below: a small letter, another, or none


#: Longest line that may be furniture.
LONGEST = 111
_ROMAN = re.compile(r"\b[ivxlc]{1,7}\b|\b[IVXLC]{1,7}\b")


def placed(field: str, text: str, inner: bool = False) -> list[Placed]:
    """The lines that may be furniture: on a page its two first and two last lines are `top` or `bottom`, others `inner`, left out unless
    asked for; in a clean text, whose pages are joined, every line but the first is `clean`."""
    full, at = [], 0
    for line in text.split("\n"):
        if line.strip():
            full.append((at, at + len(line), line))
        at += len(line) + 1
    out, last = [], len(full) - 1
    for k, (a, b, line) in enumerate(full):
        if len(line) > LONGEST or field != "page_text" and not k:
            continue
        place = "clean" if field != "page_text" else "top" if k < 2 else "bottom" if k > last - 2 else "inner"
        if place == "inner" and not inner:
            continue
        before = ("none" if not k else "stop" if full[k - 1][2].rstrip()[-1] in ".;:!?।。" else "open") + ("+" if k and text[full[k - 1][1] : a].count("\n") > 1 else "")
        after = "none" if k == last else "small" if full[k + 1][2].lstrip()[0].islower() else "other"
        out.append(Placed(a, b, line, place, before, after + ("+" if k < last and text[b : full[k + 1][0]].count("\n") > 1 else "")))
    return out


def masked(line: str) -> str:
    """The line with numbers alike."""
    return _ROMAN.sub("#", re.sub(r"\d+", "#", " ".join(line.split())))


class Furniture:
    """Tells headers and page numbers from lines of text by an averaged perceptron for either kind."""

    KINDS = ("header", "page_no")
    #: Each feature has a range of buckets of its own, first the coarse ones.
    COARSE, FINE, RANGE = 7, 10, 1 << 10
    BUCKETS = (COARSE + FINE) * RANGE

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = weights or {}
        #: The most that the fine features can add.
        ranges = range(self.COARSE * self.RANGE, self.BUCKETS, self.RANGE)
        self.reach = {kind: sum(max(0.0, max(w[at : at + self.RANGE])) for at in ranges) for kind, w in self.weights.items()}
        self.memo: dict[tuple, tuple[bool, bool]] = {}
        self.looks: dict[tuple, dict[str, float]] = {}

    @classmethod
    def look(cls, p: Placed) -> tuple:
        """What most lines are already told by: place, length, first and last character, surroundings, number of spaces."""
        line = p.line.strip()
        kind = lambda ch: "a" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch
        return p.place, len(line) // 8, kind(line[0]), kind(line[-1]), p.before, p.after, min(line.count(" "), 12)

    @classmethod
    def coarse(cls, p: Placed) -> tuple[int, ...]:
        place, size, first, last, before, after, spaces = cls.look(p)
        return cls.buckets(0, place, str(size), first + place, f"{last}{size // 3}", first + last + after, before + after, str(spaces))

    @classmethod
    def fine(cls, p: Placed) -> tuple[int, ...]:
        line = masked(p.line)
        words = line.split()
        form = "".join("01"[known] for known in furniture(p.line))  # a known form is a feature like the others
        shape = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", line))
        bare = re.sub(r"[^#\W]+", "", line).replace(" ", "")
        return cls.buckets(cls.COARSE, shape[:20], line.lower()[:24], bare[:12], words[0].lower(), words[-1].lower(), " ".join(words[-2:]).lower(), f"{line.count('#')}{bare[:4]}{min(len(words), 5)}", f"{line.isupper()}{'#' in line}", form, form + p.place)

    @classmethod
    def buckets(cls, first: int, *named: str) -> tuple[int, ...]:
        return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) % cls.RANGE + k * cls.RANGE for k, f in enumerate(named, first))

    def __call__(self, p: Placed) -> tuple[bool, bool]:
        """(is a header, holds a page number)."""
        if not self.weights:
            return furniture(p.line)
        look = self.look(p)
        open_ = self.looks.get(look)
        if open_ is None:
            coarse = self.coarse(p)
            open_ = self.looks[look] = {kind: score for kind, w in self.weights.items() if (score := sum(w[f] for f in coarse)) + self.reach[kind] > 0}
        if not open_:
            return False, False
        key = (masked(p.line), p.place, p.before, p.after)
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > MEMO_LIMIT:
                self.memo.clear()
            fine = self.fine(p)
            got = self.memo[key] = tuple(kind in open_ and open_[kind] + sum(self.weights[kind][f] for f in fine) > 0 for kind in self.KINDS)
        return got

    @classmethod
    def fit(cls, samples: list[tuple[Placed, bool, bool]], seed: int = 7, rounds: int = 8) -> Furniture:
        """From lines and whether each is a header and holds a page number. With few examples of either kind, or of plain
        lines, the known forms decide."""
        weights, rng = {}, random.Random(seed)
        described = [(cls.coarse(p) + cls.fine(p), labels) for p, *labels in samples]
        for k, kind in enumerate(cls.KINDS):
            examples = sum(labels[k] for _, labels in described)
            if min(examples, len(described) - examples) < LEAST_EXAMPLES:
                return cls()
            w, total, step, order = [0.0] * cls.BUCKETS, [0.0] * cls.BUCKETS, 1, list(described)
            for _ in range(rounds):
                rng.shuffle(order)
                for features, labels in order:
                    score, sign = sum(w[f] for f in features), 1.0 if labels[k] else -1.0
                    if score * sign <= 0.5:
                        for f in features:
                            w[f] += sign
                            total[f] += sign * step
                    step += 1
            weights[kind] = [a - b / step for a, b in zip(w, total, strict=True)]
        return cls(weights)


#: About so many lines the furniture model is fitted on, of documents chosen by their hash; inner lines are thinned.
TRAINING_LINES, THINNED = 12_000, 12
#: With fewer examples of a kind than this the known forms decide.
LEAST_EXAMPLES = 30


def labelled(lines: list[tuple]) -> list[tuple[Placed, bool, bool]]:
    """Weak labels of (document, page_no, Placed fields): a header comes again at the edge of another page of its document, a
    page number is alone on its line and that of the page; lines of known forms are either, as far as they stand alone."""
    pages: dict[int, set] = defaultdict(set)
    seen: dict[tuple, set] = defaultdict(set)
    for document, page_no, *fields in lines:
        p = Placed(*fields)
        pages[document].add(page_no)
        if p.place in ("top", "bottom") and len(p.line.strip()) > 6:
            seen[document, p.place, p.line.strip()].add(page_no)
    # A line that comes again by chance, as short ends of common sentences do, mostly stands once in a document.
    held: dict[tuple, list[int]] = defaultdict(lambda: [0, 0])
    for (document, place, line), on in seen.items():
        if len(pages[document]) > 2:
            held[place, line][0] += len(on) > 1 and 2 * len(on) >= len(pages[document])
            held[place, line][1] += 1
    out = []
    for document, page_no, *fields in lines:
        p = Placed(*fields)
        head, number = furniture(p.line)
        times, of = held.get((p.place, p.line.strip()), (0, 0))
        again = len(seen.get((document, p.place, p.line.strip()), ())) > 1 and 2 * times > of and not number
        own = p.place in ("top", "bottom") and page_no is not None and len(p.line.strip()) < 14 and str(page_no) in re.findall(r"\d+", p.line) and not re.search(r"[A-Za-z]{6}", p.line)
        title = p.place == "top" and p.before.startswith("none") and p.line.strip().isupper() and page_no in (None, 1)
        out.append((p, (head or again) and not title, number or own))
    return out


def learned(rows: DataFrame, most: int = TRAINING_LINES) -> Furniture:
    """The furniture model from lines of (field, row_id, text, document, page_no)."""

    def each(field: str, text: str, document: int, page_no: int | None) -> Iterator[tuple]:
        for p in placed(field, text, inner=True):
            if p.place in ("top", "bottom") or any(furniture(p.line)) or zlib.crc32(p.line.encode("utf-8", "surrogatepass")) % THINNED == 0:
                yield document, page_no, *p

    schema = "document bigint, page_no int, start int, end int, line string, place string, before string, after string"
    documents = max(1, rows.select("document").distinct().count())
    share = min(1 << 30, -(-((most // 8) << 30) // documents))
    chosen = rows.where(F.pmod(F.xxhash64("document"), F.lit(1 << 30)) < share)
    lines = flat_map(chosen, lambda: each, schema, ["field", "text", "document", "page_no"]).distinct()
    got = (tuple(r) for r in lines.orderBy(F.xxhash64("document"), *lines.columns).limit(2 * most).collect())
    return Furniture.fit(labelled(sorted(got, key=repr)))


def found_furniture(field: str, text: str, model: Furniture) -> list[tuple[Placed, bool, bool]]:
    """The lines that are furniture. On a page only its edge is; the title at the head of a page is none."""
    out = []
    for p in placed(field, text):
        head, number = model(p)
        if head and not p.start and field == "page_text" and p.line.strip().isupper() and not number and "#" not in masked(p.line):
            head = False
        if head or number:
            out.append((p, head, number))
    return out


def kinds(field: str, text: str, editor: Editor, model: Furniture) -> tuple[set[str], dict[str, tuple[str, ...]]]:
    """The kinds of noise, and tokens whose judgement was deferred with the words it depends on; none if a misread word is sure."""
    joined, cut = editor.rejoined(text)
    found = {"hyphen"} if cut else set()
    doubtful: dict[str, tuple[str, ...]] = {}
    for _, head, number in found_furniture(field, text, model):
        if head:
            found.add("header")
        if number:
            found.add("page_no")
    memo = editor.memo
    for raw in joined.split():
        try:
            got = memo[raw]
        except KeyError:
            got = editor(raw)
        if got is None:
            continue
        if type(got) is tuple:
            doubtful[raw] = got
        else:
            found.add("misread")
            return found, {}
    return found, doubtful


def repaired(field: str, text: str, editor: Editor, model: Furniture) -> str:
    """The text without furniture, with cut words joined, misread words restored, and lines of a paragraph joined."""
    drop = [(p.start, p.end) for p, _, _ in found_furniture(field, text, model)]
    out, last = [], 0
    for a, b in drop:
        out.append(text[last:a])
        last = b + 1
    body, _ = editor.rejoined("".join([*out, text[last:]]))
    body = re.sub(r"\S+", lambda m: editor(m.group()) or m.group(), body)
    return re.sub(r"[ \t]*(?<!\n)\n(?!\s*\n)[ \t]*", " ", body).strip()


def word_counts(rows: DataFrame) -> tuple[dict[str, int], float, DataFrame | None]:
    """How often each word occurs in all rows, but for rare words; the least count of the others; and (word, n) of the
    rare words that were met LEAST_COUNT times, if there are any (see LEAST_SHARE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for raw, n in counts.items():
                if _SOUND.fullmatch(word := core(raw)):
                    words[word] += n
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(text.split())
            if len(counts) > MEMO_LIMIT:
                yield flush()
        yield flush()

    sums = rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).checkpoint()
    total = sums.agg(F.sum("n")).first()[0] or 0
    least = max(LEAST_COUNT, LEAST_SHARE * total)
    rare = sums.where(F.col("n") < least) if least > LEAST_COUNT else None
    return dict(sums.where(F.col("n") >= least).toPandas().itertuples(index=False, name=None)), least, rare


def _ready(rows: DataFrame) -> tuple[DataFrame, Callable[[], tuple[Editor, Furniture]], DataFrame | None]:
    """The rows, what makes editor and line model in a task, and the counts of rare words if there are any."""
    spark = rows.sparkSession
    checkpoint_dir(spark)
    rows = rows.select("field", "row_id", "text", *(c for c in ("document", "page_no") if c in rows.columns)).where(F.col("text").isNotNull())
    for name, kind, value in (("document", "bigint", F.col("row_id")), ("page_no", "int", F.lit(None))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value.cast(kind))
    counts, least, rare = word_counts(rows)
    shared = spark.sparkContext.broadcast(((counts, train(counts, least), least), learned(rows).weights))
    return rows, lambda: (Editor(*shared.value[0]), Furniture(shared.value[1])), rare


def _told(editor: Editor, words: list | None) -> None:
    """Makes counts of rare words known. Whatever holds a doubtful word brings its count along, so what was judged before stays right."""
    if words:
        if len(editor.rare) > MEMO_LIMIT:
            editor.rare.clear()
        editor.rare.update((w["word"], w["n"]) for w in words)


def noise(rows: DataFrame) -> DataFrame:
    """(field, row_id, kind) of every kind of scan noise in (field, row_id, text), and if given (document, page_no).

    Null, empty and blank texts hold none; repeated rows count once; very long texts are read once, line by line and word
    by word. Tokens whose judgement depends on rare words are judged apart, once their counts are joined; texts are not
    shuffled. Other columns are not carried.
    """
    rows, ready, rare = _ready(rows)

    def first() -> Callable:
        editor, model = ready()
        editor.deferred = rare_words

        def each(field: str, row_id: int, text: str) -> Iterator[tuple]:
            found, doubtful = kinds(field, text, editor, model)
            yield from ((field, row_id, kind, None, None) for kind in sorted(found))
            yield from ((field, row_id, None, raw, word) for raw, words in doubtful.items() for word in words)

        return each

    def second() -> Callable:
        editor, _ = ready()

        def each(field: str, row_id: int, raw: str, words: list) -> list:
            _told(editor, words)
            return [(field, row_id, "misread")] if editor.judge(raw) is not None else []

        return each

    rare_words = rare is not None
    made = flat_map(rows, first, "field string, row_id bigint, kind string, raw string, word string", ["field", "row_id", "text"])
    schema = "field string, row_id bigint, kind string"
    if rare is None:
        return made.select("field", "row_id", "kind").distinct()
    made = made.distinct().checkpoint()
    doubtful = made.where(F.col("raw").isNotNull()).join(rare.hint("merge"), "word", "left")
    gathered = doubtful.groupBy("field", "row_id", "raw").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("word", "n"))).alias("words"))
    judged = flat_map(gathered, second, schema, ["field", "row_id", "raw", "words"])
    return made.where(F.col("kind").isNotNull()).select("field", "row_id", "kind").unionByName(judged).distinct()


def repair(rows: DataFrame) -> DataFrame:
    """(field, row_id, text) of the rows with noise, as continuous paragraphs.

    Where judgements depend on rare words, their counts are joined to the texts that hold them. Otherwise as `noise`.
    """
    rows, ready, rare = _ready(rows)
    schema = "field string, row_id bigint, text string"

    def mended(field: str, row_id: int, text: str, editor: Editor, model: Furniture) -> list:
        return [(field, row_id, repaired(field, text, editor, model))] if kinds(field, text, editor, model)[0] else []

    if rare is None:

        def plain() -> Callable:
            editor, model = ready()
            return lambda field, row_id, text: mended(field, row_id, text, editor, model)

        return flat_map(rows, plain, schema, ["field", "row_id", "text"]).distinct()

    def unsure() -> Callable:
        (editor, _), known = ready(), {}

        def each(field: str, row_id: int, text: str) -> Iterator[tuple]:
            for raw in set(editor.rejoined(text)[0].split()):
                if (words := known.get(raw)) is None:
                    if len(known) > MEMO_LIMIT:
                        known.clear()
                    words = known[raw] = editor.unsure(raw)
                yield from ((field, row_id, word) for word in words)

        return each

    def exact() -> Callable:
        editor, model = ready()

        def each(field: str, row_id: int, text: str, words: list | None) -> list:
            _told(editor, words)
            return mended(field, row_id, text, editor, model)

        return each

    words = flat_map(rows, unsure, "field string, row_id bigint, word string", ["field", "row_id", "text"]).distinct()
    words = words.join(rare.hint("merge"), "word").groupBy("field", "row_id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    met = rows.join(words.hint("merge"), ["field", "row_id"], "left")
    return flat_map(met, exact, schema, ["field", "row_id", "text", "words"]).distinct()


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for field in ("clean_text", "page_text"):
        name, key, column = FIELDS[field]
        page = F.col("page_no") if field == "page_text" else F.lit(None)
        parts.append(table(spark, folder, name).select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_id"), F.col(column).alias("text"), F.col("contract_id").alias("document"), page.cast("int").alias("page_no")))
    return parts[0].unionByName(parts[1])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Contract texts and pages with the kinds of scan noise they hold."""
    return noise(_texts(spark, folder))


def p5_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The same records as continuous paragraphs."""
    return repair(_texts(spark, folder))
