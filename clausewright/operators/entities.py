"""Entities by an ordered list of patterns over whole texts, with exact spans."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions.arrow import flat_map


def _party(value: str) -> str | None:
    """A party's name without lead and tail; null if it is none."""
    value = re.sub(fixed.PARTY_LEAD, "", value, count=1, flags=re.IGNORECASE | re.ASCII).strip(fixed.STRIP)
    value = re.sub(fixed.PARTY_TAIL, "", value, count=1, flags=re.IGNORECASE | re.ASCII).strip(fixed.STRIP)
    few = len(re.split(r"[ \t\n\x0b\f\r]+", value)) <= fixed.LONGEST_PARTY_WORDS
    return value if few and value.lower() not in fixed.NOT_A_PARTY and "\n" not in value and any(map(str.islower, value)) else None


def entities(documents: DataFrame, key: str = "doc_id", body: str = "text", rules: tuple = fixed.ENTITY_RULES) -> DataFrame:
    """(key, entity_no, entity_type, text, span_start, span_end, confidence) of each document.

    Rules run one after the other over the whole text; of equal texts of one type (letter case aside) the first stays.
    The span is that of the match, also where a party's name was trimmed. Null and empty texts hold none; matches longer
    than 120 characters are left out. Each document is read once in the scan's stage; nothing is shuffled.
    """

    def make() -> Callable:
        compiled = [(kind, re.compile(pattern, re.ASCII | (re.IGNORECASE if loose else 0)), group) for kind, pattern, group, loose in rules]

        def each(doc, t: str | None) -> Iterator[tuple]:
            seen: set[tuple[str, str]] = set()
            for kind, pattern, group in compiled:
                for m in pattern.finditer(t or ""):
                    value = m.group(group).strip(fixed.STRIP) if m.group(group) else ""
                    if not value or len(value) > fixed.LONGEST_ENTITY:
                        continue
                    if kind == "PARTY":
                        value = _party(value)
                    if value is None or (kind, value.lower()) in seen:
                        continue
                    seen.add((kind, value.lower()))
                    yield doc, len(seen), kind, value, m.start(group), m.end(group), 1.0

        return each

    schema = f"key {documents.schema[key].dataType.simpleString()}, entity_no int, entity_type string, text string, span_start int, span_end int, confidence double"
    return flat_map(documents.select(F.col(key).alias("key"), F.col(body).alias("body")), make, schema, ["key", "body"]).withColumnRenamed("key", key)
