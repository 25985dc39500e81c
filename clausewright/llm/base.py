"""What the text operators share: the named text fields, batch mapping, and word making."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions.arrow import flat_map
from clausewright.sources.tables import table

__all__ = ["FIELDS", "MEMO_LIMIT", "Words", "bounded_sample", "clean_word", "flat_map", "text_field", "text_fields"]

#: field -> (table, key, text column)
FIELDS = {
    "clean_text": ("contract_docs", "contract_id", "clean_text"),
    "page_text": ("page_texts", "page_uid", "text"),
    "clause_text": ("clauses", "clause_uid", "text"),
    "entity_text": ("entities", "entity_uid", "text"),
}

#: Above this many entries a worker's memo of repeated words is emptied; it never changes a result.
MEMO_LIMIT = 400_000


def text_field(spark: SparkSession, folder: str, field: str, keep: Iterable[str] = ()) -> DataFrame:
    """(field, row_id, text, *keep) of one field; null texts hold no case and are left out."""
    name, key, column = FIELDS[field]
    rows = table(spark, folder, name)
    return rows.select(F.lit(field).alias("field"), F.col(key).cast("bigint").alias("row_id"), F.col(column).alias("text"), *keep).where(F.col("text").isNotNull())


def text_fields(spark: SparkSession, folder: str, fields: Iterable[str]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, (text_field(spark, folder, f) for f in fields))


def bounded_sample(rows: DataFrame, size: int, longest: int = 50_000) -> list[str]:
    """About `size` distinct texts of (text), chosen by their hash, at most twice as many; all of them if there are fewer.

    For fitting models only. Texts beyond `longest` characters are not used for it, so the sample is bounded in bytes too. The share to keep follows from the number of rows, so each task sends its part and not a
    full sample of its own.
    """
    rows = rows.where(F.length("text") <= longest)
    total = rows.count()
    share = min(1 << 30, -(-(size << 30) // max(1, total)))
    return [r[0] for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share).select("text").distinct().limit(2 * size).collect()]


def _kept(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LMN"


def clean_word(raw: str) -> str:
    """Lower case, without the characters at both ends that are no letter, mark or number."""
    word = raw.lower()
    start, end = 0, len(word)
    while start < end and not _kept(word[start]):
        start += 1
    while end > start and not _kept(word[end - 1]):
        end -= 1
    return word[start:end]


class Words:
    """Makes the words of a text; remembers what each raw token became."""

    def __init__(self, value: Callable[[str], object] | None = None) -> None:
        self.value = value or (lambda word: word)
        self.memo: dict[str, object] = {}

    def __call__(self, text: str) -> list:
        """The values of the text's words in order; tokens without any letter, mark or number are dropped."""
        memo = self.memo
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        out = []
        for raw in text.split():
            try:
                got = memo[raw]
            except KeyError:
                word = clean_word(raw)
                got = memo[raw] = self.value(word) if word else None
            if got is not None:
                out.append(got)
        return out
