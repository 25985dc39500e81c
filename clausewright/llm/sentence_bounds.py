"""Problem 4: sentences of texts in any language and script.

Positions are tagged as boundary or inside by linear-chain models with Viterbi decoding. Where a paragraph has marks, only
positions after closing punctuation (and spaces before letters of a script without sentence punctuation) can be
boundaries, all others are inside. In paragraphs of scripts written without spaces that have none of these, every
character may begin a sentence: a model of the characters around it, trained on sentences joined without their
punctuation and spaces, tags them all. The features of the first come from two unsupervised
statistics of all texts - how often a token with a period ends a paragraph, how often a word starts one - and
from the surroundings: letter classes, quotations, brackets, distances. Weights are learned by an averaged perceptron
on paragraphs joined at known boundaries; for scripts without periods the joints carry no punctuation.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import MEMO_LIMIT, bounded_sample, flat_map
from clausewright.llm.encoding import BACK, LOST, bytes_as
from clausewright.session import checkpoint_dir
from clausewright.sources.tables import table

#: The bound of the training texts, by their hash; a parameter. Splitting itself covers every text.
TRAINING_TEXTS = 1_500
#: A word met less often is `rare`, whatever its share.
LEAST_MET = 8
#: So is one with less than this share of all, so that at most a million words of either kind are broadcast at any size.
LEAST_SHARE = 1e-6

_SPACELESS = "฀-๿຀-໿က-႟ក-៿"
_WIDE = "぀-ヿ㐀-鿿豈-﫿"
_CLOSERS = "”’\"'»“」』）)\\]】》〉"
_BREAK = re.compile(r"\n[^\S\n]*\n\s*")


def garbled(marks: str) -> list[str]:
    """What the marks became where UTF-8 was read by a wrong code page, once or (by the commonest page) twice; longest first."""
    once = {bytes_as(mark.encode(), page) for mark in marks for page in BACK}
    twice = {bytes_as(bytes_as(mark.encode(), "cp1252").encode(), "cp1252") for mark in marks}
    wide = {mark.encode().ljust(4, b"\0").decode("gbk", "ignore").rstrip("\0") for mark in marks}
    return sorted({g for g in once | twice | wide if len(g) > 1}, key=lambda g: (-len(g), g))


_OPENED, _CLOSED = garbled("“„«"), garbled("”»")
_ENDED = "|".join(map(re.escape, garbled("”’»")))
_CANDIDATE = re.compile(
    rf"[.?!…][.?!…]*[{_CLOSERS}]*(?:{_ENDED}|{LOST})?(?=\s|[{_SPACELESS}]|$)"
    rf"|[。！？।۔؟]+[{_CLOSERS}]*"
    rf"|(?<=\S)(?=\s+[{_SPACELESS}])"
)
_WORD = re.compile(r"\s*([^\s.,;:?!]*)")
#: How quotation marks open and close, those read by a wrong code page included.
_MARKS = re.compile(rf"(?P<open>[“„«「『《]|(?<![^\s(])‘|{'|'.join(map(re.escape, _OPENED))})|(?P<close>[”»」』》]|{'|'.join(map(re.escape, _CLOSED))})|(?P<both>\"|{LOST})")
_OPENING = "“„«「『‘\"" + LOST + "".join(sorted({g[0] for g in _OPENED}))


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of quoted passages, marks included; a mark without its partner quotes nothing."""
    spans, opened = [], None
    for m in _MARKS.finditer(text):
        kind = m.lastgroup
        if kind == "both":
            before = text[m.start() - 1] if m.start() else " "
            after = text[m.end()] if m.end() < len(text) else " "
            if m.group() == LOST and before.isalpha() and after.isalpha():
                continue
            kind = "close" if opened is not None and not (before.isspace() and not after.isspace()) else "open"
        if m.group() == "“" and opened is not None and text[opened] == "„":
            kind = "close"
        if kind == "open":
            opened = m.start() if opened is None else opened
        elif opened is not None:
            spans.append((opened, m.end()))
            opened = None
    return spans


def letter_class(ch: str) -> str:
    if not ch:
        return "end"
    if ch.isupper():
        return "upper"
    if ch.islower():
        return "lower"
    if ch.isdigit():
        return "digit"
    if ch.isalpha() or ch > "⺀":
        return "letter"
    if ch in "([":
        return "bracket"
    if ch in _OPENING:
        return "opening"
    return "mark"


def bucket(share: float, n: int) -> str:
    return "rare" if n < LEAST_MET else "0" if share < 0.02 else "1" if share < 0.1 else "2" if share < 0.25 else "3"


class Tagger:
    """The statistics, the weights, and Viterbi decoding."""

    def __init__(self, ends: dict[str, tuple[int, int]], starts: dict[str, tuple[int, int]], weights: dict[str, float], breaks: Breaks | None = None) -> None:
        self.ends, self.starts, self.weights, self.breaks = ends, starts, weights, breaks or Breaks()
        self.memo: dict[tuple, tuple[str, ...]] = {}

    def features(self, text: str) -> list[tuple[int, tuple[str, ...]]]:
        """(position after the candidate's marks, features) of every candidate inside the text, its end left out."""
        quoted = quotations(text) if _MARKS.search(text) else []
        out, last = [], 0
        for m in _CANDIDATE.finditer(text):
            start, end = m.span()
            if end >= len(text) or not text[end:].strip():
                break
            ahead = text[max(last, start - 40) : start]
            token = ahead.split()[-1] if ahead and not ahead[-1].isspace() else ""
            word = _WORD.match(text, end)
            after = word.group(1)
            following = after[:1] or (text[word.end() : word.end() + 1])
            if any(a < start and end < b for a, b in quoted):
                continue  # a quoted passage doesn't end the sentence around it
            closing = any(end == b for a, b in quoted)
            key = (m.group()[:1], token, after if following.isupper() else following, closing, start - last < 12, last == 0 and start < 6)
            got = self.memo.get(key)
            if got is None:
                if len(self.memo) > MEMO_LIMIT:
                    self.memo.clear()
                got = self.memo[key] = self.described(*key)
            out.append((end, got))
            last = end
        return out

    def described(self, mark: str, token: str, after: str, closing: bool, close: bool, first: bool) -> tuple[str, ...]:
        bare = token.strip("([{“„\"'‘«-–—")
        kind = letter_class(after[:1])
        if mark in "。！？।۔؟" or not mark:
            return (f"m:{mark or 'gap'}", f"mc:{closing}", f"ml:{mark or 'gap'}{kind}", f"cl:{closing}{kind}")
        share, n = self.ends.get(bare.lower(), (0, 0))
        begun, seen = self.starts.get(after, (0, 0))
        end = bucket(share / n if n else 0, n)
        start = bucket(begun / seen if seen else 0, seen)
        shape = "initial" if len(bare) == 1 and bare.isupper() else "number" if bare.isdigit() else "dotted" if "." in bare else "short" if len(bare) < 4 else "long"
        return (
            f"m:{mark}", f"k:{kind}", f"e:{end}", f"s:{start}", f"h:{shape}", f"ek:{end}{kind}", f"es:{end}{start}", f"hk:{shape}{kind}", f"hs:{shape}{start}",
            f"c:{closing}{kind}", f"mk:{mark}{kind}", f"f:{first}{shape}", f"d:{close}", f"dh:{close}{shape}",
        )

    def tag(self, text: str) -> list[int]:
        """The positions of the boundaries inside the text."""
        candidates = self.features(text)
        if not candidates:
            return self.breaks.tag(text) if self.breaks.applies(text) else []
        return self.chosen(candidates)

    def chosen(self, candidates: list[tuple[int, tuple[str, ...]]]) -> list[int]:
        """The positions of those candidates that are boundaries."""
        weights = self.weights
        scores = [sum(weights.get(f, 0.0) for f in features) for _, features in candidates]
        return [end for (end, _), state in zip(candidates, viterbi(scores, weights.get("t:10", 0.0), weights.get("t:11", 0.0)), strict=True) if state]


def viterbi(scores: list[float], stay: float, turn: float) -> list[int]:
    """The likeliest states: 1 is a boundary, which scores what its features do, 0 inside, the zero point; `stay` and
    `turn` are added for a boundary after an inside and after a boundary."""
    path, best = [], (0.0, 0.0)
    for score in scores:
        into = (best[0], best[1]), (best[0] + score + stay, best[1] + score + turn)
        path.append(tuple(int(b > a) for a, b in into))
        best = tuple(max(pair) for pair in into)
    state, out = int(best[1] > best[0]), []
    for back in reversed(path):
        out.append(state)
        state = back[state]
    return out[::-1]


class Breaks:
    """Tags every character of a text without marks and spaces as the first of a sentence or not."""

    #: Characters to either side that are looked at; a text shorter than this many is one unit.
    REACH, LEAST = 4, 24
    CONTINUOUS = re.compile(f"[{_SPACELESS}{_WIDE}]")
    MARK = re.compile(r"[^\w\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]|_")

    def __init__(self, weights: dict[str, float] | None = None) -> None:
        self.weights = {} if weights is None else weights

    def applies(self, text: str) -> bool:
        return bool(self.weights) and len(text) >= self.LEAST and len(self.CONTINUOUS.findall(text)) > 0.8 * len(text) and not self.MARK.search(text)

    @classmethod
    def features(cls, text: str) -> list[tuple[str, ...]]:
        """Of each position from 1 on; digits are alike."""
        plain, out = re.sub(r"\d", "0", text), []
        for i in range(1, len(plain)):
            left, right = plain[max(0, i - cls.REACH) : i], plain[i : i + cls.REACH]
            out.append(("b", *("l" + left[-k:] for k in range(1, len(left) + 1)), *("r" + right[:k] for k in range(1, len(right) + 1)), f"x{left[-1:]}{right[:1]}", f"y{left[-2:]}|{right[:2]}"))
        return out

    def states(self, features: list[tuple[str, ...]]) -> list[int]:
        get = self.weights.get
        return viterbi([sum(get(f, 0.0) for f in each) for each in features], get("t:10", 0.0), get("t:11", 0.0))

    def tag(self, text: str) -> list[int]:
        return [i for i, state in enumerate(self.states(self.features(text)), 1) if state]

    @classmethod
    def fit(cls, sentences: list[str], units: list[str], rng: random.Random, joins: int = 900, rounds: int = 3) -> Breaks:
        """From sentences, joined without punctuation and spaces, and from units that hold no boundary."""
        bare = sorted({b for s in sentences if len(b := cls.MARK.sub("", s)) > 3})
        samples: list[tuple[list[tuple[str, ...]], list[int]]] = []
        for _ in range(min(joins, 4 * len(bare)) if len(bare) > 1 else 0):
            text, borders = "", set()
            for body in rng.sample(bare, min(len(bare), rng.randint(2, 5))):
                borders.add(len(text))
                text += body
            samples.append((cls.features(text), [int(i in borders) for i in range(1, len(text))]))
        samples += [(cls.features(b), [0] * (len(b) - 1)) for b in rng.sample(units, min(len(units), joins // 3)) if len(b) > 1]
        out = cls(weights := Counter())
        total: Counter[str] = Counter()
        step = 1
        for _ in range(rounds):
            rng.shuffle(samples)
            for features, states in samples:
                found = out.states(features)
                if found != states:
                    for tags, sign in ((states, 1.0), (found, -1.0)):
                        before = 0
                        for tag, other, each in zip(tags, found if sign > 0 else states, features, strict=True):
                            if tag:
                                for f in (*(each if not other else ()), f"t:1{before}"):
                                    weights[f] += sign
                                    total[f] += sign * step
                            before = tag
                step += 1
        return cls({f: w - total[f] / step for f, w in weights.items() if w or total[f]})


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces between blank lines, without white space around."""
    last = 0
    for m in [*_BREAK.finditer(text), None]:
        low, high = last, m.start() if m else len(text)
        while low < high and text[low].isspace():
            low += 1
        while high > low and text[high - 1].isspace():
            high -= 1
        if low < high:
            yield low, high
        last = m.end() if m else len(text)


def sentences(text: str, tagger: Tagger) -> Iterator[tuple[int, int]]:
    """(start, end) of every sentence."""
    for low, high in paragraphs(text):
        body, start = text[low:high], 0
        for end in [*tagger.tag(body), len(body)]:
            first, past = start, end
            while first < past and body[first].isspace():
                first += 1
            while past > first and body[past - 1].isspace():
                past -= 1
            if first < past:
                yield low + first, low + past
            start = end


Counts = dict[str, tuple[int, int]]


def met(texts: Iterable[str]) -> tuple[Counts, Counts]:
    """How often each token with a period ends a paragraph of the texts, and each capital word starts a sentence, of how many."""
    ends: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    starts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for body in (text[a:b] for text in texts for a, b in paragraphs(text)):
        words = body.split()
        if len(words) < 6:
            continue
        for k, raw in enumerate(words):
            if raw[-1] == "." and len(raw) > 1:
                entry = ends[raw[:-1].strip("([{“„\"'‘«-–—").lower()]
                entry[1] += 1
                entry[0] += k == len(words) - 1
            bare = raw.strip(".,;:?!")
            if bare and bare[0].isupper():
                entry = starts[bare]
                entry[1] += 1
                entry[0] += k == 0 or words[k - 1][-1] in ".?!" and k > 2
    return {k: tuple(v) for k, v in ends.items()}, {k: tuple(v) for k, v in starts.items()}


def corpus_counts(rows: DataFrame) -> tuple[Counts, Counts]:
    """The same over all distinct texts of (text); rare words (LEAST_MET, LEAST_SHARE), which are all alike, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[dict, dict] = {}, {}

        def flush() -> pa.RecordBatch:
            out = [(which == 1, word, hits, n) for which, counts in enumerate(sums) for word, (hits, n) in counts.items()]
            for counts in sums:
                counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.bool_(), pa.string(), pa.int64(), pa.int64()))], names=["start", "word", "hits", "n"])

        for batch in batches:
            for counts, more in zip(sums, met(batch.column(0).to_pylist()), strict=True):
                for word, (hits, n) in more.items():
                    known = counts.get(word, (0, 0))
                    counts[word] = known[0] + hits, known[1] + n
            if sum(map(len, sums)) > MEMO_LIMIT:
                yield flush()
        yield flush()

    parts = rows.select("text").distinct().mapInArrow(run, "start boolean, word string, hits bigint, n bigint")
    ends: Counts = {}
    starts: Counts = {}
    checkpoint_dir(rows.sparkSession)
    sums = parts.groupBy("start", "word").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_MET).checkpoint()
    least = LEAST_SHARE * (sums.groupBy("start").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0)
    for start, word, hits, n in sums.where(F.col("n") >= least).select("start", "word", "hits", "n").collect():
        (starts if start else ends)[word] = hits, n
    return ends, starts


def fit(texts: list[str], seed: int = 3, rounds: int = 3, counts: tuple[Counts, Counts] | None = None) -> Tagger:
    """The tagger from plain texts: statistics first (of these texts if no other counts are given), then the perceptron on joined paragraphs."""
    bodies = [text[a:b] for text in texts for a, b in paragraphs(text)]
    tagger = Tagger(*(counts or met(texts)), {})
    rng = random.Random(seed)

    def certain(body: str) -> bool | None:
        """Whether a paragraph is surely a single sentence: nothing inside it can be a boundary."""
        for _, features in tagger.features(body):
            named = set(features)
            if any(f in named for f in ("f:Truenumber", "f:Trueinitial", "f:Trueshort", "k:lower", "k:digit", "k:mark", "k:bracket", "e:0", "cl:Trueletter")):
                continue
            return False
        return True

    singles: dict[str, list[str]] = defaultdict(list)
    for body in bodies:
        if len(body) > 25 and certain(body):
            last = body[-1]
            script = "spaceless" if re.search(f"[{_SPACELESS}]", body) else "wide" if "⺀" < last else "plain"
            if script == "spaceless" or last in ".?!。！？।۔؟”\"":
                singles[script].append(body)
    samples: list[tuple[str, set[int]]] = []
    for script, pool in singles.items():
        for _ in range(min(2_500, 3 * len(pool))):
            text, borders = "", set()
            for body in rng.sample(pool, min(len(pool), rng.randint(2, 5))):
                if text:
                    borders.add(len(text))
                    text += "" if script == "wide" else " "
                text += body
            samples.append((text, borders))
    # An enumerator at the head of a paragraph belongs to what follows, in titles as in items.
    heads = [body for body in bodies if re.match(r"\(?\w{1,4}[.)]\s", body) and certain(body)]
    samples += [(body, set()) for body in rng.sample(heads, min(len(heads), 1_500))]
    weights: Counter[str] = Counter()
    total: Counter[str] = Counter()
    step = 1
    tagger.weights = weights
    described = [(tagger.features(text), borders) for text, borders in samples]
    for _ in range(rounds):
        rng.shuffle(described)
        for candidates, borders in described:
            found = set(tagger.chosen(candidates))
            if found != borders & {end for end, _ in candidates}:
                for tags, sign in ((borders, 1.0), (found, -1.0)):
                    before = 0
                    for end, features in candidates:
                        tag = int(end in tags)
                        if tag:
                            for f in (*features, f"t:1{before}"):
                                weights[f] += sign
                                total[f] += sign * step
                        before = tag
            step += 1
    tagger.weights = {f: w - total[f] / step for f, w in weights.items()}
    tagger.memo.clear()
    continuous = [body for body in bodies if len(Breaks.CONTINUOUS.findall(body)) > 0.8 * len(body)]
    known = [body[a:b] for body in continuous for a, b in sentences(body, tagger)]
    titles = [body for body in continuous if not tagger.features(body) and body[-1] not in "。！？" and len(body) < Breaks.LEAST]
    tagger.breaks = Breaks.fit(known, titles, rng)
    return tagger


def split_sentences(documents: DataFrame, training: int = TRAINING_TEXTS) -> DataFrame:
    """(contract_id, sent_start, sent_end) of every text of (contract_id, text).

    Null, empty and blank texts have no sentence. Repeated rows give their sentences once. A text is split paragraph by
    paragraph, so very long texts cost in proportion to their length. Other columns are not carried. The
    statistics cover every text; the perceptron is fitted on about `training` texts, chosen by hash.
    """
    rows = documents.select("contract_id", "text").where(F.col("text").isNotNull())
    tagger = fit(sorted(bounded_sample(rows, training)), counts=corpus_counts(rows))
    shared = rows.sparkSession.sparkContext.broadcast((tagger.ends, tagger.starts, tagger.weights, tagger.breaks))

    def make() -> Callable:
        own = Tagger(*shared.value)
        return lambda contract_id, text: ((contract_id, a, b) for a, b in sentences(text, own))

    return flat_map(rows, make, "contract_id bigint, sent_start int, sent_end int", ["contract_id", "text"]).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The sentences of the contracts that are no scans."""
    contracts = table(spark, folder, "contract_docs").where(F.coalesce("media_type", F.lit("")) != "image/tiff")
    return split_sentences(contracts.select("contract_id", F.col("clean_text").alias("text")))
