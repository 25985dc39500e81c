"""Problem 3: cutting oversized texts at natural boundaries, with an overlap.

The text is parsed into a tree. Its levels are given: by default text > paragraphs > sentences > words > characters, as the
problem states its cuts; `STRUCTURE` puts sections by headings, markup blocks and list items above them. Sibling subtrees
are merged from the left while the piece stays within the limit; a node that fits is never parsed, and only one that by
itself does not fit is descended into. A piece must be longer than `least`
characters, so a level offers a cut only if one of its node ends lies in the window (start + least, start + limit];
otherwise the next level of the straddling node is parsed.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import flat_map, text_field

Levels = tuple[re.Pattern[str], ...]
#: Where a node of each level ends.
LEVELS: Levels = (
    re.compile(r"(?<=\n\n)"),
    re.compile(r"(?<=[。！？।۔])|(?<=[.?!;])(?=[ \n])"),
    re.compile(r"(?<=[ \n])"),
)
_HEADING = r"(?:#{1,6} |<h[1-6][ >]|(?:ARTICLE|SECTION|CLAUSE|Article|Section|Chapter) [\dIVXLC]+|\d{1,2}(?:\.\d{1,2})*\.? [A-Z][A-Z ,&'/-]{2,70}$)"
_ITEM = r"(?:[-*•–] |\(?(?:[a-z]|[ivx]{1,4}|\d{1,3})[.)] |<(?:li|tr)[ >])"
#: The same below sections by headings of any depth, blocks of markup, and items of lists.
STRUCTURE: Levels = (
    re.compile(rf"^(?=# |<h1[ >]|(?:ARTICLE|SECTION|Chapter) [\dIVXLC]+)", re.MULTILINE),
    re.compile(rf"^(?={_HEADING})", re.MULTILINE),
    re.compile(r"(?<=</ul>)|(?<=</ol>)|(?<=</table>)|(?<=</section>)|(?<=</div>)|(?<=</p>)|(?<=\n\n)"),
    re.compile(rf"^(?=[ \t]*{_ITEM})", re.MULTILINE),
    *LEVELS[1:],
)


class Node:
    """A stretch of the text at one level of the tree; its children are parsed when first asked for."""

    def __init__(self, text: str, start: int, end: int, level: int, levels: Levels = LEVELS) -> None:
        self.text, self.start, self.end, self.level, self.levels = text, start, end, level, levels
        self._ends: list[int] | None = None
        self._child: tuple[int, Node] | None = None

    def ends(self) -> list[int]:
        """The ends of the children, in order; the node's own end is the last."""
        if self._ends is None:
            inner = [m.start() for m in self.levels[self.level].finditer(self.text, self.start, self.end) if self.start < m.start() < self.end] if self.level < len(self.levels) else []
            self._ends = [*inner, self.end]
        return self._ends

    def child(self, position: int) -> Node:
        """The child that holds the character at `position`; the one asked for last is kept, so the next piece finds it parsed."""
        ends = self.ends()
        k = bisect_right(ends, position)
        if self._child is None or self._child[0] != k:
            self._child = k, Node(self.text, ends[k - 1] if k else self.start, ends[k], self.level + 1, self.levels)
        return self._child[1]


def pack(root: Node, start: int, limit: int, least: int) -> int:
    """The end of the piece that begins at `start`: whole children first, the straddling child only if none ends in the window."""
    low, high = start + least, start + limit
    node = root
    while node.level < len(node.levels):
        ends = node.ends()
        k = bisect_right(ends, high)
        if k and ends[k - 1] > low:
            return ends[k - 1]
        node = node.child(high) if high < node.end else Node(node.text, node.start, node.end, node.level + 1, node.levels)
    return high


def pieces(text: str, limit: int = 1200, least: int = 600, overlap: int = 150, levels: Levels = LEVELS) -> Iterator[tuple[int, int, int]]:
    """(number from 1, start, end) of each piece; a text within the limit is one piece, an empty one none."""
    if not 0 <= overlap < least < limit:
        raise ValueError("overlap < least < limit is needed, or pieces would not advance")
    root, start, number = Node(text, 0, len(text), 0, levels), 0, 1
    while text:
        if len(text) - start <= limit:
            yield number, start, len(text)
            return
        end = pack(root, start, limit, least)
        yield number, start, end
        start, number = end - overlap, number + 1


def split_items(rows: DataFrame, key: str, text: str, limit: int = 1200, least: int = 600, overlap: int = 150, levels: Levels = LEVELS) -> DataFrame:
    """(key, piece_no, piece_start, piece_end) of every text longer than `limit`.

    Null, empty and fitting texts give no rows (they need no cut). Repeated rows give their pieces once. Other
    columns of the input, whatever their names, are not carried. The length test runs in the scan's stage, so only
    oversized texts reach Python; each text is cut on its own, so nothing is shuffled but the small result.
    """

    def make() -> Callable:
        return lambda row_id, body: ((row_id, *piece) for piece in pieces(body, limit, least, overlap, levels))

    long = rows.select(F.col(key).alias("row_id"), F.col(text).alias("body")).where(F.length("body") > limit)
    kind = rows.schema[key].dataType.simpleString()
    return flat_map(long, make, f"row_id {kind}, piece_no int, piece_start int, piece_end int", ["row_id", "body"]).distinct().withColumnRenamed("row_id", key)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every clause text of more than 1,200 characters."""
    return split_items(text_field(spark, folder, "clause_text").withColumnRenamed("row_id", "clause_uid"), "clause_uid", "text")
