"""Problem 9: test items whose passages appear in the documents, by greedy string tiling.

Seeds are runs of `LEAST` words hashed by a rolling (Karp-Rabin) hash; the items' seeds form a table that is sent to the
tasks up to a bounded size, and are joined by shuffle beyond it. In a document, words that no item has cut the search short; seeds that meet are
extended to maximal matches, and the longest matches that do not overlap are marked one after the other (tiles), so
passages in another order are found as well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import Words, flat_map
from clausewright.sources.tables import table

LEAST = 12
#: Words of the items that are sent to the tasks (some 100 MB in a worker); the seeds of larger sets are joined by shuffle.
BLOCK_WORDS = 1_000_000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class Index:
    """Item words as numbers, and the places of each seed."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int) -> None:
        self.least, self.numbers = least, {}
        self.items: dict[int, np.ndarray] = {}
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for key, words in items:
            row = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.uint64)
            self.items[key] = row
            for at, seed in enumerate(self.seeds(row).tolist()):
                self.places[seed].append((key, at))
        self.known = np.array(sorted(self.places), dtype=np.uint64)

    def seeds(self, row: np.ndarray) -> np.ndarray:
        """The hash of each run of `least` words."""
        n = len(row) - self.least + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        out = np.zeros(n, dtype=np.uint64)
        for k in range(self.least):
            out = out * np.uint64(_BASE) + row[k : k + n]
        return out

    def meets(self, row: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """item -> maximal matches (length, place in the row, place in the item); row holds 0 where no item has the word."""
        if len(row) < self.least or not len(self.known):
            return {}
        seeds = self.seeds(row)
        gaps = np.concatenate([[0], np.cumsum(row == 0)])
        hits = np.flatnonzero((gaps[self.least :] == gaps[: len(seeds)]) & (self.known[np.minimum(np.searchsorted(self.known, seeds), len(self.known) - 1)] == seeds))
        found: dict[int, dict[tuple[int, int], tuple[int, int, int]]] = defaultdict(dict)
        for at in hits.tolist():
            for key, place in self.places[int(seeds[at])]:
                item = self.items[key]
                if not np.array_equal(row[at : at + self.least], item[place : place + self.least]):
                    continue
                line = (at - place, place)
                last = found[key].get((at - place, -1))
                if last and last[2] + last[0] >= place + self.least:
                    continue  # inside the match that was extended before
                n = self.least
                while at + n < len(row) and place + n < len(item) and row[at + n] == item[place + n]:
                    n += 1
                found[key][line] = found[key][(at - place, -1)] = (n, at, place)
        return {key: sorted({m for m in each.values()}, reverse=True) for key, each in found.items()}


def tiles(matches: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Matches marked longest first; of a match that overlaps marked words, what is left is tried again if long enough."""
    import heapq

    heap = [(-n, a, b) for n, a, b in matches]
    heapq.heapify(heap)
    marked: list[tuple[int, int, int]] = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        clash = next(((m, x, y) for m, x, y in marked if a < x + m and x < a + n or b < y + m and y < b + n), None)
        if clash is None:
            marked.append((n, a, b))
            continue
        m, x, y = clash
        cut = [(a, x), (x + m, a + n)] if a < x + m and x < a + n else [(a, a + y - b), (a + y + m - b, a + n)]
        for low, high in cut:
            low, high = max(low, a), min(high, a + n)
            if high - low >= least and high - low < n:
                heapq.heappush(heap, (low - high, low, b + low - a))
    return sorted(marked, reverse=True)


COLUMNS = "doc_id bigint, item_id bigint, longest int, tiles int, covered int, coverage double"


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, coverage: float = 0.0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, longest, tiles, covered, coverage): documents that share a run of at least `least` words with an item.

    covered counts the item's words under tiles, coverage is its share; pairs below the wished coverage are left out.
    Null and empty texts, and items of fewer than `least` words, take no part. Repeated documents give their rows once.
    Items of at most `block_words` words are sent to the tasks as a table of seeds, so documents are not shuffled; of more
    items the seeds are joined by shuffle, and only the texts of pairs that share one are brought together. Both give the same rows.
    documents: (doc_id, text); items: (item_id, text); other columns are not carried.
    """
    spark = documents.sparkSession
    words = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    # A word and the space after it take two characters at least, but rarely less than three.
    if (words.agg(F.sum(F.length("text"))).first()[0] or 0) > 3 * block_words:
        return _by_join(documents, words, least, coverage)
    make_words = Words()
    rows = spark.sparkContext.broadcast([(r[0], make_words(r[1])) for r in words.toLocalIterator()])

    def make() -> Callable:
        index = Index(rows.value, least)
        to_words = Words(lambda word: index.numbers.get(word, 0))
        return lambda doc_id, text: _tiled(doc_id, np.array(to_words(text), dtype=np.uint64), index, coverage) if text else ()

    return flat_map(documents, make, COLUMNS, ["doc_id", "text"]).distinct()


def _tiled(doc_id: int, row: np.ndarray, index: Index, coverage: float) -> Iterator[tuple]:
    for key, matches in index.meets(row).items():
        marked = tiles(matches, index.least)
        covered, size = sum(n for n, _, _ in marked), len(index.items[key])
        if covered >= coverage * size:
            yield doc_id, key, matches[0][0], len(marked), covered, covered / size


def _by_join(documents: DataFrame, items: DataFrame, least: int, coverage: float) -> DataFrame:
    """The same by a join of seeds: the rolling hashes of all runs, each once per text."""

    def seeds() -> Callable:
        import xxhash

        numbers, shape = Words(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))), Index([], least)
        return lambda key, text: ((key, seed) for seed in np.unique(shape.seeds(np.array(numbers(text), dtype=np.uint64))).astype(np.int64).tolist()) if text else ()

    def of(rows: DataFrame, key: str) -> DataFrame:
        return flat_map(rows.select(F.col(key).alias("key"), "text"), seeds, "key bigint, seed bigint", ["key", "text"]).withColumnRenamed("key", key)

    documents = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    pairs = of(documents, "doc_id").join(of(items, "item_id").hint("merge"), "seed").select("doc_id", "item_id").distinct()
    met = documents.join(pairs.hint("merge"), "doc_id").join(items.withColumnRenamed("text", "item").hint("merge"), "item_id")

    def make() -> Callable:
        split = Words()

        def each(doc_id: int, text: str, item_id: int, item: str) -> Iterator[tuple]:
            index = Index([(item_id, split(item))], least)
            return _tiled(doc_id, np.array([index.numbers.get(w, 0) for w in split(text)], dtype=np.uint64), index, coverage)

        return each

    return flat_map(met, make, COLUMNS, ["doc_id", "text", "item_id", "item"]).distinct()


def p9_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and items with a common run, the words of the item under tiles and their share."""
    return leaks(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "eval_items").select("item_id", "text"))


def p9_longest(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the longest common run of words."""
    return p9_tiles(spark, folder).select("doc_id", "item_id", "longest").distinct()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain at least 12 consecutive words of an item."""
    return p9_tiles(spark, folder).select("doc_id", "item_id").distinct()
