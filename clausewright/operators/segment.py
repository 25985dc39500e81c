"""Paragraphs, sentences and clauses with their character spans, and the pages they lie on."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import fixed, text
from clausewright.functions.arrow import flat_map

_GAP = re.compile(r"\n[ \t\n\x0b\f\r]*\n")
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:Pvt|Ltd|Rs|No|Nos|Mr|Mrs|Ms|Dr|Smt|Art|Sec|Cl|St|v|vs|viz|etc|i\.e|e\.g|approx|[A-Z])\.$")
_END = re.compile(r"[.?!]+[\"'”’)\]]*(?=\s)|[。！？।۔]+")


def paragraph_ranges(body: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the non-empty pieces between blank lines."""
    at = 0
    for gap in _GAP.finditer(body):
        if gap.start() > at:
            yield at, gap.start()
        at = gap.end()
    if at < len(body):
        yield at, len(body)


def paragraphs(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, para_no from 1, span_start, span_end). Null and empty texts give none; repeated rows give theirs each."""

    def make() -> Callable:
        return lambda doc, t: ((doc, n, a, b) for n, (a, b) in enumerate(paragraph_ranges(t or ""), 1))

    return flat_map(documents.select(F.col(key).alias("key"), F.col(body).alias("body")), make, f"key {_kind(documents, key)}, para_no int, span_start int, span_end int", ["key", "body"]).withColumnRenamed("key", key)


def sentence_ranges(body: str) -> Iterator[tuple[int, int]]:
    """(start, end) of sentences by closing marks, not after common abbreviations; a blank line ends one."""
    for low, high in paragraph_ranges(body):
        at = low
        for m in [*_END.finditer(body, low, high), None]:
            end = m.end() if m else high
            if m and (_ABBREVIATION.search(body[max(at, m.start() - 12) : m.start() + 1]) or re.match(r"\s+[a-z0-9(]", body[end : end + 4])):
                continue
            start, past = at, end
            while start < past and body[start] in fixed.STRIP:
                start += 1
            while past > start and body[past - 1] in fixed.STRIP:
                past -= 1
            if start < past:
                yield start, past
            at = end


def sentences(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, sent_idx from 0, text, span_start, span_end) by a plain rule; blank pieces are dropped."""

    def make() -> Callable:
        return lambda doc, t: ((doc, n, t[a:b], a, b) for n, (a, b) in enumerate(sentence_ranges(t or "")))

    return flat_map(documents.select(F.col(key).alias("key"), F.col(body).alias("body")), make, f"key {_kind(documents, key)}, sent_idx int, text string, span_start int, span_end int", ["key", "body"]).withColumnRenamed("key", key)


def segment(documents: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, clause_no, clause_id, type, text, span_start, span_end).

    A heading opens a clause that reaches to the last paragraph before the next heading. What stands before the first
    heading is `clause-0` of type PREAMBLE if it has at least 80 characters from its first visible one. Without any
    heading each paragraph of at least 40 characters is a `para-n`. Blank texts give none. The text is stripped, the
    span is not. One document is handled at a time in the scan's stage; nothing is shuffled.
    """

    def make() -> Callable:
        import regex

        # The full stop is part of the first alternative only, as the pattern of the normaliser has it too.
        heading = regex.compile(rf"(?:{fixed.ENUMERATOR})[ \t\n\x0b\f\r]+{fixed.TITLE}")

        def each(doc, t: str | None) -> Iterator[tuple]:
            if not t or not t.strip(fixed.STRIP):
                return
            ranges = list(paragraph_ranges(t))
            stripped = [t[a:b].strip(fixed.STRIP) for a, b in ranges]
            heads = [k for k, p in enumerate(stripped) if heading.fullmatch(p)]
            if not heads:
                kept = [(r, p) for r, p in zip(ranges, stripped, strict=True) if len(p) >= fixed.LEAST_PARAGRAPH]
                for n, ((a, b), p) in enumerate(kept, 1):
                    yield doc, n, f"para-{n}", fixed.UNCLASSIFIED, p, a, b
                return
            if heads[0]:
                first, end = len(t) - len(t.lstrip(fixed.STRIP)), ranges[heads[0] - 1][1]
                if end - first >= fixed.LEAST_PREAMBLE:
                    yield doc, 0, "clause-0", fixed.PREAMBLE, t[first:end].strip(fixed.STRIP), first, end
            for n, (k, after) in enumerate(zip(heads, [*heads[1:], len(ranges)], strict=True), 1):
                a, b = ranges[k][0], ranges[after - 1][1]
                yield doc, n, f"clause-{n}", fixed.UNCLASSIFIED, t[a:b].strip(fixed.STRIP), a, b

        return each

    schema = f"key {_kind(documents, key)}, clause_no int, clause_id string, type string, text string, span_start int, span_end int"
    return flat_map(documents.select(F.col(key).alias("key"), F.col(body).alias("body")), make, schema, ["key", "body"]).withColumnRenamed("key", key)


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def page_starts(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_no, text, start_at): each page normalised, and where it begins when pages are joined by a blank line.

    pages: (key, page_no, text). Offsets are those before the joined text is stripped at its ends. Null pages count as
    empty. A page delivered several times must be reduced before.
    """
    ready = pages.select(key, "page_no", text.normalize(F.col("text")).alias("text"))
    before = Window.partitionBy(key).orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    return ready.select("*", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int").alias("start_at"))


def join_pages(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text): the normalised pages joined by blank lines in page order, stripped."""
    ordered = pages.select(key, "page_no", text.normalize(F.col("text")).alias("text")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    return ordered.select(key, text.strip(F.array_join(F.transform("p", lambda p: p["text"]), "\n\n")).alias("text"))


def page_of(spans: DataFrame, starts: DataFrame, key: str = "doc_id", at: str = "span_start") -> DataFrame:
    """spans with `page`: the page with the greatest start not beyond the offset; at least the first page, 0 if the document has none.

    An as-of join: equi on the document; pages are gathered to one sorted array per document, so each span meets one row.
    """
    each = starts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start_at", "page_no"))).alias("starts"))
    reached = F.filter("starts", lambda s: s["start_at"] <= F.col(at))
    page = F.when(F.col("starts").isNull(), 0).when(F.size(reached) > 0, F.element_at(reached, -1)["page_no"]).otherwise(F.element_at("starts", 1)["page_no"])
    return spans.join(each, key, "left").withColumn("page", page).drop("starts")


def page_by_sentence(spans: DataFrame, sentences: DataFrame, key: str = "doc_id", at: str = "span_start") -> DataFrame:
    """spans with `page`: that of the sentence (key, span_start, page) which holds the offset, else of the last one that
    starts before it; 0 if there is none. An as-of join on the document, by one sorted array per document."""
    each = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("span_start").alias("start_at"), F.col("page").alias("page_no")))).alias("starts"))
    reached = F.filter("starts", lambda s: s["start_at"] <= F.col(at))
    page = F.when(F.coalesce(F.size(reached), F.lit(0)) > 0, F.element_at(reached, -1)["page_no"]).otherwise(0)
    return spans.join(each, key, "left").withColumn("page", page).drop("starts")
