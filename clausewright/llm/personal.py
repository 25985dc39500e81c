"""Problem 2: personal information inside free text, located and replaced by typed placeholders.

Candidate spans come from wide patterns and a gazetteer of given names that is learned from the whole corpus by context. On
each candidate labelers vote (format, gazetteer, title before it, cue words around it, firm or case or code beside it);
expectation-maximisation estimates how reliable each labeler is and how likely each candidate is a mention; with those
probabilities as targets a logistic span classifier is trained, on the votes and on features of its own (shape and
letters of the span, words beside it, place), which decides on all candidates. Before matching, a text
is brought to plain characters with a map back to its own positions, so disguised mentions are found as well.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import bounded_sample, flat_map, text_fields
from clausewright.llm.encoding import LOST, PAGES, bytes_as
from clausewright.llm.lookalikes import INVISIBLE, LOOKALIKES, SPACES, _expanded

#: The bound of what the classifier is fitted on; the texts are chosen by their hash.
TRAINING_TEXTS = 12_000
#: A given name enters the gazetteer when it was met so often after a title or cue.
LEAST_MET = 3

_HIDDEN = frozenset(_expanded(INVISIBLE))
_BLANKS = frozenset(_expanded(SPACES))
_ODD = re.compile("[" + "".join(sorted(map(re.escape, {ch for ch in (*_HIDDEN, *_BLANKS) if ch <= "\uffff"}))) + "０-９Ａ-Ｚａ-ｚﬀ-ﬆ̀-ͯͰ-ϿЀ-ԯԱ-֏]")
_STYLED = re.compile("[\U0001d400-\U0001d7ff]")
#: Characters that never change, as runs; any other alone.
_STRETCH = re.compile("(?P<same>[\x00-\x9f\xa1-\xac\xae-\u02ff\u0900-\u109f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff]+)|.", re.DOTALL)


def plain(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and the position of each in the text; no map if nothing changed."""
    if text.isascii() or not (_ODD.search(text) or _STYLED.search(text)):
        return text, None
    flat, back = [], []
    for m in _STRETCH.finditer(text):
        at, end = m.span()
        if m.lastgroup:  # characters that stay as they are
            flat += (text[at : end - 1], text[end - 1])
            back += range(at, end)
            continue
        ch = text[at]
        if ch in _HIDDEN:
            continue
        form = ch
        if ch in _BLANKS:
            form = " "
        elif "̀" <= ch <= "ͯ" and flat:
            joined = unicodedata.normalize("NFC", flat[-1] + ch)
            if len(joined) == 1:
                flat[-1] = joined
            continue
        elif ch in LOOKALIKES and (flat and flat[-1].isascii() and flat[-1].isalpha() or text[end : end + 1].isascii() and text[end : end + 1].isalpha()):
            form = LOOKALIKES[ch]
        elif ch > "˿" and unicodedata.decomposition(ch)[:6] in ("<wide>", "<font>", "<compa"):
            form = unicodedata.normalize("NFKC", ch)
        flat.append(form)
        back += [at] * len(form)
    return "".join(flat), back


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    votes: tuple[int, ...]


#: Titles and cues before a name, per script.
TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Smt|Shri|Sri|Kum|Adv|Mme|Mlle|Me|M|Sr|Sra|Srta|D|Dña|Hr|Fr)\.?|Herrn?|Frau|Mx\.?"
_TITLED = re.compile(rf"(?<![\w.])(?:{TITLES})\s+$")
_CUED = re.compile(r"(?:[Ss]igned by|presence of|[Ss]ignatory:|[Nn]ame:|\bBy:?|ask for|marked for|Attn\.?:?|queries on|help of|z\. Hd\.|atención de|attention de|attn|addressed to|care of|contact|zeichnet|if|from|and|with|of)\s+$")
_HINDI_TITLE = re.compile(r"(?:श्रीमती|श्री|सुश्री|डॉ\.|साक्षी|एडवोकेट|प्रो\.)\s+([ऀ-ॣ०-ॿ]+)\s+([ऀ-ॣ०-ॿ]+)")
_OTHER_TITLE = re.compile(r"(?:السيدة|السيد|الأستاذ|جناب|محترمہ|محترم)\s+([؀-ۿ]{2,})\s+([؀-ۿ]{2,})|([一-鿿]{2,4}?)(?:先生|女士|小姐)|([一-鿿]{1,4}[ 　]?[぀-ヿ一-鿿]{1,4})(?:氏|様|さん)(?=[はがをにとのへ、。])|(?:นางสาว|นาย|นาง)([฀-๏]{2,})\s([฀-๏]{2,})")
#: Words of a name after a Hindi title that show it is none (a committee, an office).
_HINDI_NONE = frozenset("समिति के की का विभाग कार्यालय मंडल".split())
#: Legal forms of firms.
_LEGAL = r"(?:Private Limited|Pvt\.? Ltd|Limited|Ltd|LLP|LLC|Inc|Corporation|Company|Partnership|Trust|Foundation|Society)"
#: Words after a name that show that it is no person's.
_THING = r"(?:Area|brand|marks?\b|works\b|plant|licence|depot|programme|Road|Street|Avenue|Lane)"
_LEGAL_AFTER = re.compile(rf"[\w .]*?(?:&|and)?\s*\w*\s*(?:{_LEGAL}|{_THING})")
#: The word before a legal form; a kind of firm if it is met so often.
_LEGAL_WORD, _LEGAL_WHOLE = re.compile(r"[PLICTFS](?<=\s.)[a-zL][a-zPC]"), re.compile(rf"{_LEGAL}\b")
_BUSINESS = re.compile(r"([A-Z][a-z]+)\s+$")
_PART = r"[A-ZÀ-Þ][a-zà-öø-ÿœ]+(?:['’-][A-ZÀ-Þ][a-zà-öø-ÿœ]+)?"
_REST = rf"(?:\s+(?:[A-Z]\.\s*)+|\s+(?:van|de|von|del|da|bin|al)(?:\s+(?:der|la|den))?)?\s*{_PART}"
_SURNAME = re.compile(rf"(?:\s+(?:[A-ZÀ-Þ]\.\s?)+|\s+(?:van|de|von|del|da|bin|al)(?:\s+(?:der|la|den))?)?\s+(?P<last>{_PART}|[A-ZÀ-Þ]{{3,}})(?![\w@])")
# Patterns that run over whole texts begin with one class, which lets the search skip ahead.
_GIVEN = re.compile(r"[A-ZÀ-Þ](?<![\w.@+-].)[A-Za-zÀ-ÿ]+(?=\s+(?:[A-ZÀ-Þ]|van |de |von |del |da |bin |al ))")
_TITLED_NAME = re.compile(rf"(?<![\w.])(?:{TITLES}|Signatory:|Name:|ask for|presence of|Signed by|queries on|Attn:)\s+({_PART})(?=(?:\s+(?:[A-Z]\.\s*)+|\s+(?:van|de|von)\s+|\s+){_PART})")

_LOCAL = r"[A-Za-z0-9](?:[A-Za-z0-9._+%-]*[A-Za-z0-9])?"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?|\s+at\s+)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+)"
_SIGN, _MAILBOX, _HOST = re.compile(_AT, re.IGNORECASE), re.compile(_LOCAL + "$"), re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.IGNORECASE)
_AT_SIGN = re.compile(r"[@\[({aA](?:(?<=@)|(?<=[\[({])\s?[aA][tT]\s?[\])}]|(?<=\s.)[tT](?=[ \n]+[A-Za-z0-9-]+(?:\.[A-Za-z]|[ \n]dot[ \n])))")

_DIGITS = re.compile(r"[0-9०-९٠-٩۰-۹][0-9०-९٠-٩۰-۹ ().\-\n]{5,}[0-9०-९٠-٩۰-۹]")
#: Written forms of telephone numbers, and of numbers of identity documents.
PHONES = re.compile(
    r"\+\d{1,3}[ .\-\n]?\(\d{2,4}\)[ .\-\n]?\d{3,4}[ .\-\n]?\d{3,4}|\+\d{1,3}(?:[ .\-\n]?\d{2,7}){1,5}|\(0?\d{2,4}\)[ \n]?\d{3,4}[ \-\n]?\d{3,4}|00\d{1,3}(?:[ \-\n]\d{2,7}){2,4}|0\d{2,4}[ \-\n]\d{6,8}|\d{3}[.\-]\d{3}[.\-]\d{4}|[6-9]\d{4}[ \-]?\d{5}"
)
IDS = re.compile(r"\d{4}[ \-\n]?\d{4}[ \-\n]?\d{4}|\d{3}-\d{2}-\d{4}")
LETTERED = re.compile(r"[A-Z](?<![\w/-].)(?:[A-Z]{4}\d{4}[A-Z]|\d{7}|[A-Z]{2}\d{7}|[A-Z]-?\d{2}[ \n]?\d{11})(?![\w/-])")
_ID_CUE = re.compile(r"(?:aadhaar|aadhar|uid|pan|passport|licen[cs]e|voter|social security|ssn|tax|identity|id card|document|no\.?|number|card|holder of|produced|का)[\s:#(.]*(?:no\.?|number)?[\s:#(.]*$", re.IGNORECASE)
_PHONE_CUE = re.compile(r"(?:tel|telefon|teléfono|téléphone|phone|call|line|mobile|fax|joignable au|दूरभाष|फोन|الهاتف|فون|电话|電話|โทรศัพท์|or|on|at|is)[\s.:]*(?:is|is:)?\s*$", re.IGNORECASE)
_CODE_CUE = re.compile(r"(?:invoice|part numbers?|batch code(?: is)?|reference(?: is)?|ref\.? no\.?|lot|and|annexure|schedule|grade|संख्या|مرجع|حوالہ)[\s:]*$", re.IGNORECASE)

#: The sharp s, written out, or read by a wrong code page once.
_SHARP = "|".join(["ß", "ss", LOST, *sorted({re.escape(bytes_as("ß".encode(), page)) for page in PAGES}), "脽"])
_CITY = r"[A-ZÀ-Þ][a-zà-öø-ÿ]+(?:[ -][A-ZÀ-Þ][a-zà-öø-ÿ]+)?"
#: Words that end the name of a street; others are learned from addresses that name a town as well.
_WAY = r"(?:Salai|Rasta|Road|Street|Avenue|Lane|Marg|Path|Cross|Quay|Drive|Way|Close|Row|Nagar|Chowk|Gali|Boulevard|Square|Court|Terrace)"
ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt\.?|Unit|Suite)\s+(?:No\.?\s*)?\d+[A-Z]?,\s+{_PART}\s+(?:Heights|Towers?|Apartments|Residency|Court|House)"
    rf"|(?:Door|Plot|House|Shop)\s+No\.?\s*\d[\d/-]*[A-Z]?,\s+(?:\d+(?:st|nd|rd|th)\s+(?:Cross|Main|Block|Street)|Sector\s+\d+|{_PART}(?:\s+{_PART})?)"
    rf"|H\.?\s?No\.?\s*\d[\d/-]*[A-Z]?,\s+{_PART}(?:\s+{_WAY})?"
    rf"|\d+[A-Z]?(?:[/-]\d+)*,?\s+{_PART}(?:\s+{_PART})?\s+{_WAY}(?=[,\s.;)]|$)"
    rf"|\d+(?:\s+(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|quai|impasse|allée)\s+(?:de la |de l['’]|des |du |de |d['’])?{_PART}"
    rf"|(?:Calle|Avenida|Plaza|Paseo|Camino|Carrera)\s+(?:de (?:la |los |las )?|del )?{_PART},?\s+(?:n\.º\s*)?\d+"
    rf"|[A-ZÀ-Þ][a-zà-öø-ÿ]+(?:stra(?:{_SHARP})e|weg|platz|gasse|allee|damm)\s+\d+[a-z]?)"
)
#: A number and a name of several words, whatever the last one is.
_NUMBERED = re.compile(rf"[0-9](?<![/.,\d-].)\d{{0,3}}[A-Z]?(?:[/-]\d+)*,?\s+{_PART}(?:\s+{_PART})?\s+(?P<way>[A-Z][a-z]{{2,}})(?P<town>,\s+{_CITY}(?:\s+-?\s*\d{{3}}\s?\d{{3}}|,\s+\d{{5}})?)?(?=[,\s.;)]|$)")
_ADDRESS_START = re.compile(r"[FAUSDPHC](?:(?:lat|pt|nit|uite|oor|lot|ouse|hop|\.\s?No|No|alle|venida|laza|aseo|amino|arrera)(?=[.\s]))|[0-9](?<![/.,0-9-].)[0-9A-Z/-]*(?:\s+(?:bis|ter))?,?\s+(?=[A-Zra-c])")
_STREET_END = re.compile(rf"[swpgad](?:tra(?:{_SHARP})e|eg|latz|asse|llee|amm)\s+\d")
_PLACE_CUE = re.compile(r"(?:\bat|\bof|address(?:ed)?(?: is| to)?|reside[sd]?(?: at)?|residing at|resident of|house|home|live[sd]?(?: at)?)[\s:]*$", re.IGNORECASE)
_HINDI = re.compile("[ऀ-ॿ]")
_SCRIPTS = re.compile("[؀-ۿ一-鿿฀-๿]")

KINDS = ("name", "email", "phone", "idno", "address")
#: Votes of a candidate, in order: format, gazetteer, title, cue, second word known, against it, code beside it.
LABELERS = ("format", "gazetteer", "title", "cue", "company", "against", "code")


class Known(NamedTuple):
    """What is learned by context from all texts: given names, last names, given names in Devanagari, kinds of firms,
    words that end street names."""

    given: frozenset[str] = frozenset()
    surnames: frozenset[str] = frozenset()
    hindi: frozenset[str] = frozenset()
    firms: frozenset[str] = frozenset()
    ways: frozenset[str] = frozenset()


class Finder:
    """Yields the candidates of a text with the labelers' votes."""

    def __init__(self, known: Known) -> None:
        self.given, self.surnames, self.hindi, self.ways, self.firms = known.given, known.surnames, known.hindi, known.ways, known.firms - known.surnames
        business = "|".join(map(re.escape, sorted(known.firms)))
        self.firm_after = re.compile(rf"{_LEGAL_AFTER.pattern}|[\w .]*?(?:&|and)?\s*\w*\s*(?:{business})") if business else _LEGAL_AFTER

    def spans(self, text: str) -> Iterator[Span]:
        yield from self.emails(text)
        yield from self.numbers(text)
        yield from self.addresses(text)
        yield from self.names(text)

    def emails(self, text: str) -> Iterator[Span]:
        for hit in _AT_SIGN.finditer(text):
            low = hit.start() - 1 if hit.start() and text[hit.start() - 1].isspace() else hit.start()
            sign = _SIGN.match(text, low)
            local = _MAILBOX.search(text[max(0, low - 64) : low])
            host = _HOST.match(text, sign.end()) if sign and local else None
            if not host or not re.search(r"[A-Za-z]{2,}$", host.group()) or re.match(r"\s?(?:@|[\[({]\s?at\b)", text[host.end() : host.end() + 6]):
                continue
            worded = sign.group().strip().lower() == "at"
            mailbox = bool(re.search(r"[._+\d-]", local.group())) or not worded
            against = worded and not mailbox and "dot" not in host.group().lower()
            yield Span("email", max(0, low - 64) + local.start(), host.end(), (1, int(mailbox), 0, int(not worded), 0, int(against), 0))

    def numbers(self, text: str) -> Iterator[Span]:
        for hit in _DIGITS.finditer(text):
            start, end = hit.span()
            if start and (text[start - 1].isdigit() or text[start - 1] in "/" or text[start - 1].isalpha() and text[start - 1].isascii()):
                continue
            while start and text[start - 1] in "+(":
                start -= 1
            chunk = text[start:end]
            if not chunk.isascii():
                chunk = "".join(str(unicodedata.digit(c)) if c.isdigit() else c for c in chunk)
            before = text[max(0, start - 34) : start]
            m = IDS.match(chunk)
            if m and not chunk[m.end() : m.end() + 1].isdigit() and not before.endswith("-"):
                whole = m.end() == len(chunk) or not re.match(r"[-.]\d", chunk[m.end() :])
                yield Span("idno", start, start + m.end(), (int(whole), 0, 0, int(bool(_ID_CUE.search(before))), 0, int(bool(_PHONE_CUE.search(before)) and not _ID_CUE.search(before)), int(bool(_CODE_CUE.search(before)))))
                continue
            m = PHONES.match(chunk)
            if m and not chunk[m.end() : m.end() + 1].isdigit() and 7 <= sum(map(str.isdigit, m.group())) <= 15 and not re.match(r"[-.]\d", chunk[m.end() :]):
                yield Span("phone", start, start + m.end(), (int(chunk[:1] in "+(0" or "." in m.group()), 0, 0, int(bool(_PHONE_CUE.search(before))), 0, 0, int(bool(re.search(r"(?:invoice|batch code is|part numbers?|reference is)\s$", before)))))
        for m in LETTERED.finditer(text):
            before = text[max(0, m.start() - 34) : m.start()]
            yield Span("idno", *m.span(), (1, 0, 0, int(bool(_ID_CUE.search(before))), 0, 0, int(bool(re.search(r"(?:batch code is|reference is|invoice)\s$", before)))))

    def addresses(self, text: str) -> Iterator[Span]:
        starts, last = [hit.start() for hit in _ADDRESS_START.finditer(text)], 0
        for hit in _STREET_END.finditer(text):
            at = hit.start()
            while at and text[at - 1].isalpha():
                at -= 1
            starts.append(at)
        for start in sorted(starts):
            m = ADDRESS.match(text, start) if start >= last else None
            if not m:
                continue
            tail = re.match(rf"(?:,\s+(?:{_PART}\s+{_WAY}|{_PART}\s+Layout|Sector\s+\d+))*(?:,\s+\d{{5}}\s+{_CITY}|,\s+{_CITY}(?:\s+-?\s*\d{{3}}\s?\d{{3}})?)?", text[m.end() :])
            end = m.end() + (tail.end() if tail else 0)
            last = end
            yield Span("address", m.start(), end, (1, int(end > m.end()), 0, 1, 0, int(bool(re.match(r"\s+(?:depot|plant|works|office)\b", text[end:]))), 0))
        for m in _NUMBERED.finditer(text):
            if (way := m.group("way")) in self.ways or m.group("town"):
                cue = bool(_PLACE_CUE.search(text[max(0, m.start() - 24) : m.start()]))
                yield Span("address", *m.span(), (int(way in self.ways), int(bool(m.group("town"))), 0, int(cue), 0, int(not cue and way not in self.ways), 0))

    def names(self, text: str) -> Iterator[Span]:
        given, surnames = self.given, self.surnames
        for m in _GIVEN.finditer(text):
            word = m.group()
            known = word in given or word.isupper() and word.capitalize() in given
            before = text[max(0, m.start() - 24) : m.start()]
            titled = bool(_TITLED.search(before))
            if not known and not titled:
                continue
            rest = _SURNAME.match(text, m.end())
            if not rest:
                continue
            last = rest.group("last")
            after = text[rest.end() : rest.end() + 40]
            firm = bool(self.firm_after.match(after)) and not re.match(r"\s*[,.;()]", after) and bool(re.match(r"\s+(?:&|[A-Z])", after)) or bool(re.match(r"\s*&", after)) or before.endswith("& ") or bool(re.match(r"\s+(?:LLP|Ltd|Limited|Inc|Trust|brand|marks?)\b", after))
            firm = firm or last in self.firms
            case = bool(re.search(r"\bv\.?\s$", before)) or bool(re.match(r"\s+v\.?\s", after))
            yield Span("name", m.start(), rest.end(), (1, int(known), int(titled), int(bool(_CUED.search(before))), int(last in surnames or last.capitalize() in surnames), int(firm or case), 0))
        if text.isascii():
            return
        if _HINDI.search(text):
            for m in _HINDI_TITLE.finditer(text):
                none = m.group(1) in _HINDI_NONE or m.group(2) in _HINDI_NONE
                yield Span("name", m.start(1), m.end(2), (1, int(m.group(1) in self.hindi), 1, 1, 0, int(none), 0))
        for m in _OTHER_TITLE.finditer(text) if _SCRIPTS.search(text) else ():
            group = next(k for k, g in enumerate(m.groups(), 1) if g)
            yield Span("name", m.start(group), m.end(group + 1) if m.lastindex and m.lastindex > group else m.end(group), (1, 0, 1, 1, 0, 0, 0))


def introduced(text: str) -> Iterator[tuple[str, str]]:
    """("given" or "hindi", name) of each name in the plain text that stands after a title or cue, ("firm", word) of each
    word before a legal form, ("way", word) of each last word of a street before a town."""
    for m in _LEGAL_WORD.finditer(text):
        if _LEGAL_WHOLE.match(text, m.start()) and (before := _BUSINESS.search(text[max(0, m.start() - 30) : m.start()])):
            yield "firm", before.group(1)
    for m in _NUMBERED.finditer(text):
        if m.group("town") and _PLACE_CUE.search(text[max(0, m.start() - 24) : m.start()]):
            yield "way", m.group("way")
    for m in _TITLED_NAME.finditer(text):
        yield "given", m.group(1)
    if not text.isascii() and _HINDI.search(text):
        for m in _HINDI_TITLE.finditer(text):
            if m.group(1) not in _HINDI_NONE and m.group(2) not in _HINDI_NONE:
                yield "hindi", m.group(1)


def followers(text: str, given: frozenset[str]) -> Iterator[tuple[str, str]]:
    """("last", name) of each last name in the plain text that follows a known given name."""
    for m in _GIVEN.finditer(text):
        if m.group() in given and (rest := _SURNAME.match(text, m.end())):
            yield "last", rest.group("last")


def gazetteer(texts: list[str]) -> Known:
    """What is known from these texts alone."""
    names = Counter(name for text in texts for name in introduced(text))
    often = {kind: frozenset(w for (k, w), n in names.items() if k == kind and n >= LEAST_MET) for kind in ("given", "hindi", "firm", "way")}
    last = Counter(w for text in texts for _, w in followers(text, often["given"]))
    return Known(often["given"], frozenset(w for w, n in last.items() if n >= LEAST_MET), often["hindi"], often["firm"] - often["given"], often["way"])


def corpus_gazetteer(rows: DataFrame) -> Known:
    """The same over all texts of (text), each distinct text once. Only words met LEAST_MET times reach the driver."""
    hashed = rows.select("text", F.xxhash64("text").alias("key"))

    def names(find: Callable[[str], Iterator[tuple[str, str]]]) -> dict[str, frozenset[str]]:
        def each(text: str, key: int) -> Iterator[tuple]:
            return ((key, kind, name, n) for (kind, name), n in Counter(find(plain(text)[0])).items())

        found = flat_map(hashed, lambda: each, "key bigint, kind string, name string, n bigint", ["text", "key"]).distinct()
        often: dict[str, set[str]] = {}
        for kind, name in found.groupBy("kind", "name").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_MET).select("kind", "name").collect():
            often.setdefault(kind, set()).add(name)
        return {kind: frozenset(group) for kind, group in often.items()}

    none: frozenset[str] = frozenset()
    first = names(introduced)
    given = first.get("given", none)
    last = names(lambda text: followers(text, given)) if given else {}
    return Known(given, last.get("last", none), first.get("hindi", none), first.get("firm", none) - given, first.get("way", none))


def estimate(votes: np.ndarray, rounds: int = 30) -> np.ndarray:
    """P(mention) of each candidate by expectation-maximisation over the labelers' reliabilities.

    Labelers vote independently given the truth; the first guess is the share of votes for less those against.
    """
    signs = np.array([1, 1, 1, 1, 1, -1, -1])
    p = np.clip(0.5 + 0.2 * (votes * signs).sum(axis=1), 0.02, 0.98)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 0.01, 0.99)
        yes = np.clip((p @ votes + 1) / (p.sum() + 2), 1e-3, 1 - 1e-3)
        no = np.clip(((1 - p) @ votes + 1) / ((1 - p).sum() + 2), 1e-3, 1 - 1e-3)
        # A labeler for a mention may not come out as evidence against it, nor the reverse.
        yes = np.where(signs > 0, np.maximum(yes, no), np.minimum(yes, no))
        score = np.log(prior / (1 - prior)) + votes @ np.log(yes / no) + (1 - votes) @ np.log((1 - yes) / (1 - no))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p


#: Buckets of the classifier's hashed features, and on how many candidates of a kind it is fitted at most.
BUCKETS, CANDIDATES = 1 << 13, 8_000
#: How many features of its own a span has.
OWN = 12
_SHAPES = ((re.compile(r"[A-ZÀ-Þ]+"), "A"), (re.compile(r"[a-zà-öø-ÿœ]+"), "a"), (re.compile(r"\d+"), "0"), (re.compile(r"\s+"), " "))


def shape(text: str) -> str:
    for pattern, to in _SHAPES:
        text = pattern.sub(to, text)
    return text


def features(text: str, span: Span) -> tuple[int, ...]:
    """Buckets of what the span and its surroundings look like: its shape, the letters its words begin and end with, the
    words beside it, its length and place in the line. None of it is a labeler's vote."""
    body, before, after = text[span.start : span.end], text[max(0, span.start - 40) : span.start], text[span.end : span.end + 24]
    ahead = re.sub(r"\d", "0", before.lower()).split()
    behind = re.sub(r"\d", "0", after).split()
    words = body.split() or [""]
    named = (
        f"s{shape(body)[:24]}", f"n{min(len(body) // 4, 9)}", f"w{min(len(words), 6)}", f"b{ahead[-1] if ahead else ''}", f"c{' '.join(ahead[-2:])}", f"t{before[-1:]}",
        f"a{behind[0].lower() if behind else ''}", f"d{shape(behind[0]) if behind else ''}", f"e{after[:1]}", f"x{words[0][-3:].lower()}", f"y{words[-1][-3:].lower()}", f"l{not before or before.rstrip(' ')[-1:] in chr(10)}",
    )
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in named)


def classifier(votes: np.ndarray, seen: np.ndarray, p: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a logistic regression on votes, their pairs and a constant, and on the buckets of `seen` (-1 is none), fitted to the probabilities."""
    x, total = design(votes), weight.sum()
    w, own = np.zeros(x.shape[1]), np.zeros(BUCKETS + 1)
    for _ in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(x @ w + own[seen].sum(axis=1), -30, 30))) - p) / total
        w -= rate * (x.T @ error + 1e-4 * w)
        own -= rate * (np.bincount((seen % (BUCKETS + 1)).ravel(), np.repeat(error, seen.shape[1]), BUCKETS + 1) + 1e-3 * own)
        own[-1] = 0.0
    return w, own


#: Candidates against which a labeler speaks, each counted as so many candidates that are no mention when the classifier
#: is fitted, so that a labeler that never spoke in the sample still has a say.
PRIOR = ((1, 1, 0, 0, 0, 1, 0), (1, 0, 0, 0, 0, 1, 0), (1, 1, 1, 1, 0, 1, 0), (1, 0, 1, 1, 0, 1, 0), (1, 0, 0, 0, 0, 0, 1), (1, 0, 0, 1, 0, 0, 1))
PRIOR_WEIGHT = 12


def design(votes: np.ndarray) -> np.ndarray:
    pairs = [votes[:, i] * votes[:, k] for i in range(votes.shape[1]) for k in range(i)]
    return np.column_stack([np.ones(len(votes)), votes, *pairs]).astype(float)


def fit(texts: list[str], known: Known | None = None) -> tuple[Known, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """What is known (if it isn't given, from these texts), and the classifiers fitted on the texts."""
    simple = [plain(t)[0] for t in texts]
    known = known or gazetteer(simple)
    finder = Finder(known)
    found: dict[str, list[tuple[tuple[int, ...], tuple[int, ...]]]] = {kind: [] for kind in KINDS}
    for text in simple:
        for span in finder.spans(text):
            if len(found[span.kind]) < CANDIDATES:
                found[span.kind].append((span.votes, features(text, span)))
    weights = {}
    for kind, rows in found.items():
        if len(rows) >= 5:
            votes, seen = np.array([v for v, _ in rows]), np.array([f for _, f in rows])
            prior = np.array(PRIOR)
            chance = np.concatenate([estimate(votes), np.full(len(prior), 0.03)])
            weights[kind] = classifier(np.concatenate([votes, prior]), np.concatenate([seen, np.full((len(prior), seen.shape[1]), -1)]), chance, np.concatenate([np.ones(len(rows)), np.full(len(prior), float(PRIOR_WEIGHT))]))
        else:  # too few candidates to learn from: votes for count against votes against
            weights[kind] = np.array([-0.5, 0.6, 0.6, 0.6, 0.6, 0.6, -3.0, -3.0, *[0.0] * 21]), np.zeros(BUCKETS + 1)
    return known, weights


class Detector:
    def __init__(self, known: Known, weights: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.finder, self.memo = Finder(known), {}
        self.weights = {kind: (w, own.tolist()) for kind, (w, own) in weights.items()}
        #: The least and the most that a span's own features can add; where the votes decide alone they need no look.
        self.reach = {kind: (np.sort(own)[:OWN].clip(max=0).sum(), np.sort(own)[-OWN:].clip(min=0).sum()) for kind, (_, own) in weights.items()}

    def accepted(self, text: str, span: Span) -> bool:
        key = (span.kind, span.votes)
        w, own = self.weights[span.kind]
        got = self.memo.get(key)
        if got is None:
            got = self.memo[key] = float(design(np.array([span.votes]))[0] @ w)
        low, high = self.reach[span.kind]
        return got + low > 0 or got + high > 0 and got + sum(own[f] for f in features(text, span)) > 0

    def __call__(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the mentions in the text as it is; of overlapping ones the earlier and longer stays."""
        body, back = plain(text)
        found = sorted((s.start, -s.end, s.kind) for s in self.finder.spans(body) if self.accepted(body, s))
        out, last = [], 0
        for start, end, kind in found:
            if start >= last:
                last = -end
                out.append((kind, back[start] if back else start, back[-end - 1] + 1 if back else -end))
        return out


def _detectors(rows: DataFrame, training: int) -> Callable[[], Detector]:
    # Names are counted over all texts. The sample is for the classifier; short texts (entities) would fill it.
    shared = rows.sparkSession.sparkContext.broadcast(fit(sorted(bounded_sample(rows.where(F.length("text") > 80), training)), corpus_gazetteer(rows)))
    return lambda: Detector(*shared.value)


def mentions(rows: DataFrame, training: int = TRAINING_TEXTS) -> DataFrame:
    """(field, row_id, kind, start_at, end_at) of every mention in (field, row_id, text), each once.

    Null and empty texts hold none. A text that was delivered several times counts once; a row_id with several texts has
    the mentions of all. Very long texts are scanned once. Other columns are not carried.
    """
    rows = rows.select("field", "row_id", "text").where(F.col("text").isNotNull())
    ready = _detectors(rows, training)

    def make() -> Callable:
        detect = ready()
        return lambda field, row_id, text: ((field, row_id, kind, a, b) for kind, a, b in detect(text))

    return flat_map(rows, make, "field string, row_id bigint, kind string, start_at int, end_at int", ["field", "row_id", "text"]).distinct()


def masked(rows: DataFrame, training: int = TRAINING_TEXTS) -> DataFrame:
    """(field, row_id, text) of all rows, every mention replaced by its kind in brackets; null stays null."""
    rows = rows.select("field", "row_id", "text")
    ready = _detectors(rows.where(F.col("text").isNotNull()), training)

    def make() -> Callable:
        detect = ready()

        def each(field: str, row_id: int, text: str | None) -> list:
            if text is not None:
                out, last = [], 0
                for kind, a, b in detect(text):
                    out += [text[last:a], f"[{kind.upper()}]"]
                    last = b
                text = "".join([*out, text[last:]])
            return [(field, row_id, text)]

        return each

    return flat_map(rows, make, "field string, row_id bigint, text string", ["field", "row_id", "text"])


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return text_fields(spark, folder, ["clean_text", "clause_text", "entity_text"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every mention of a person's data in contract texts, clauses and entities."""
    return mentions(_texts(spark, folder)).select("field", "row_id", "kind", "start_at").distinct()


def p2_masked(spark: SparkSession, folder: str) -> DataFrame:
    """The same texts with placeholders."""
    return masked(_texts(spark, folder))
