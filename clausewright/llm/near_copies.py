"""Problem 6: groups of texts that share most of their content.

Every text becomes the set of its runs of three (or `width`) words. Texts with the same set form one class; from here on
one row per class is handled, so copies never multiply the work. A class gets a sketch of 128 one-bit minhashes and
`BANDS` band keys of `BAND_ROWS` minhashes, few enough that a band key only routes: rows of one key are joined with each
other by a binary trie over their sketches. Pairs of trie nodes are walked down together, the differing bits add up, and
a pair of nodes is given up as soon as the error budget is exceeded. Survivors are checked exactly on their sets.

Why it holds at scale: a pair at the threshold is missed with probability (1 - 0.7**3)**16 = 0.1 %, at a similarity of
0.8 with 1e-5. Band keys that hold a large share of the rows are told from a sample beforehand and salted: their rows go
to blocks by hash, and every pair of blocks is a unit of its own. Other keys beyond `BLOCK` rows are cut into blocks as
they stream by. So no task and no driver ever holds an unbounded group, and no pair of a group is left out. The plan is
the same at every size; nothing but the list of salted keys is broadcast, and it has at most `MOST_HOT` entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import MEMO_LIMIT, Words, text_field
from clausewright.session import checkpoint_dir

WIDTH, LEAST_WORDS, SIMILAR = 3, 20, 0.7
BANDS, BAND_ROWS = 16, 3
#: Bits of the sketch, and how many of them may differ: at a similarity of 0.7 a bit differs with probability 0.15,
#: so the budget lies four standard deviations above the mean.
BITS, BUDGET = 128, 35
#: Rows of a band key, or members of a class, that are joined at a time.
BLOCK = 4_096
#: Keys that are salted are told from so many rows, and there are at most so many of them: one must hold more than this
#: part of all rows. It bears on the spread of the work, not on results.
SAMPLE, MOST_HOT = 200_000, 20_000
#: Bytes of a hashed run: of two runs of a pair's sets, different ones fall together with probability 1e-12.
RUN_BYTES = 5

_rng = np.random.default_rng(20250101)
_MULTIPLY = (_rng.integers(0, 2**32, BANDS * BAND_ROWS + BITS, dtype=np.uint32) | np.uint32(1))[:, None]
_XOR = _rng.integers(0, 2**32, BANDS * BAND_ROWS + BITS, dtype=np.uint32)[:, None]
_MIX = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sets:
    """Makes the sorted set of hashed word runs of a text."""

    def __init__(self, width: int = WIDTH, least: int = LEAST_WORDS) -> None:
        import xxhash

        self.words, self.width, self.least = Words(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))), width, least

    def __call__(self, text: str) -> np.ndarray | None:
        """Null if the text has fewer than `least` words (or too few for one run)."""
        words = np.array(self.words(text), dtype=np.uint64)
        if len(words) < max(self.least, self.width):
            return None
        runs = words[: len(words) - self.width + 1].copy()
        for k in range(1, self.width):
            runs = mixed(runs) + words[k : len(words) - self.width + 1 + k]
        return np.unique(mixed(runs) >> np.uint64(64 - 8 * RUN_BYTES))


def minhashes(runs: np.ndarray, step: int = 2048) -> np.ndarray:
    """The least value of the set under each hash function; long sets are handled in steps."""
    short = runs.astype(np.uint32)
    least = None
    for at in range(0, len(short), step):
        part = (((short[at : at + step] ^ _XOR) * _MULTIPLY)).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return least


def sketch_and_bands(runs: np.ndarray, salt: int = 0) -> tuple[int, int, list[int]]:
    """The two halves of the sketch and the band keys; texts of different salts share no band."""
    least = minhashes(runs)
    bits = (least[BANDS * BAND_ROWS :] * np.uint32(0x9E3779B1)) >> np.uint32(31)
    high, low = np.packbits(bits.astype(np.uint8)).view(">i8").tolist()
    keys = (least[: BANDS * BAND_ROWS].astype(np.uint64) * _MIX).reshape(BANDS, BAND_ROWS).sum(axis=1) + _BAND + np.uint64(salt)
    return high, low, mixed(keys).astype(np.int64).tolist()


def trie_join(ids: np.ndarray, sketches: np.ndarray, split: int = 0, budget: int = BUDGET, leaf: int = 64) -> list[tuple[int, int]]:
    """Pairs of rows (of the first `split` with the others, or of all with each other if 0) whose sketches differ in at most `budget` bits.

    sketches: two 64-bit numbers a row. Nodes of the trie are ranges of the sorted sketches. A pair of nodes carries the
    errors of its prefix; where a node has at most `leaf` rows, the rows are compared bit-parallel.
    """
    pairs: list[tuple[int, int]] = []

    def ordered(i: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((s[:, 1], s[:, 0]))
        return i[order], s[order]

    def compare(li: np.ndarray, ls: np.ndarray, ri: np.ndarray, rs: np.ndarray, same: bool) -> None:
        near = np.bitwise_count(ls[:, None, 0] ^ rs[None, :, 0]) + np.bitwise_count(ls[:, None, 1] ^ rs[None, :, 1]) <= budget
        if same:
            near = np.triu(near, 1)
        x, y = np.nonzero(near)
        pairs.extend(zip(li[x].tolist(), ri[y].tolist(), strict=True))

    def half(sketches: np.ndarray, low: int, high: int, depth: int) -> int:
        """Where the bit at `depth` turns to one among rows that agree in all bits before it."""
        word = sketches[:, depth >> 6]
        bit = np.uint64(1) << np.uint64(63 - (depth & 63))
        return low + int(np.searchsorted(word[low:high] & bit, bit))

    def walk(li: np.ndarray, ls: np.ndarray, ri: np.ndarray, rs: np.ndarray, same: bool) -> None:
        stack = [(0, len(li), 0, len(ri), 0, 0, same)]
        while stack:
            la, lb, ra, rb, depth, errors, same = stack.pop()
            if la == lb or ra == rb or errors > budget:
                continue
            if lb - la <= leaf or rb - ra <= leaf or depth == BITS:
                for at in range(la, lb, 512):  # a leaf of equal sketches may be wide
                    end = min(at + 512, lb)
                    if same:
                        compare(li[at:end], ls[at:end], li[at:end], ls[at:end], True)
                    for other in range(end if same else ra, rb, 4_096):
                        past = min(other + 4_096, rb)
                        compare(li[at:end], ls[at:end], ri[other:past], rs[other:past], False)
                continue
            lm, rm = half(ls, la, lb, depth), half(rs, ra, rb, depth)
            stack.append((la, lm, ra, rm, depth + 1, errors, same))
            stack.append((lm, lb, rm, rb, depth + 1, errors, same))
            stack.append((la, lm, rm, rb, depth + 1, errors + 1, False))
            if not same:
                stack.append((lm, lb, ra, rm, depth + 1, errors + 1, False))

    if split:
        walk(*ordered(ids[:split], sketches[:split]), *ordered(ids[split:], sketches[split:]), False)
    else:
        i, s = ordered(ids, sketches)
        walk(i, s, i, s, True)
    return pairs


def _class(field: str, runs: bytes) -> int:
    """The id of a set's class."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(field.encode() + b"\0" + runs, digest_size=8).digest(), "little", signed=True)


def packed(runs: np.ndarray) -> bytes:
    return np.ascontiguousarray(runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :RUN_BYTES]).tobytes()


def unpacked(runs: bytes) -> np.ndarray:
    wide = np.zeros((len(runs) // RUN_BYTES, 8), dtype=np.uint8)
    wide[:, :RUN_BYTES] = np.frombuffer(runs, dtype=np.uint8).reshape(-1, RUN_BYTES)
    return wide.view("<u8").reshape(-1)


def _bands(rows: DataFrame) -> DataFrame:
    """(field, row_id, id, high, low, bands) of the rows that have enough words; a task gives sketch and bands of a class
    once, later members have nulls."""
    import zlib

    schema = "field string, row_id bigint, id bigint, high bigint, low bigint, bands array<bigint>"
    out = pa.schema([("field", pa.string()), ("row_id", pa.int64()), ("id", pa.int64()), ("high", pa.int64()), ("low", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, seen = Sets(), set()
        for batch in batches:
            made = []
            for field, row_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                runs = make(text)
                if runs is None:
                    continue
                key = _class(field, packed(runs))
                if key in seen:
                    made.append((field, row_id, key, None, None, None))
                    continue
                if len(seen) > MEMO_LIMIT:
                    seen.clear()
                seen.add(key)
                made.append((field, row_id, key, *sketch_and_bands(runs, zlib.crc32(field.encode()))))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*made, strict=True), out, strict=True)], schema=out)

    return rows.select("field", "row_id", "text").mapInArrow(run, schema)


#: A result of the first join: a pair (block is null), or a member of a band key with more than BLOCK rows.
_JOINED = "band bigint, block int, a bigint, b bigint, c bigint"


def _sketches(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.stack([high, low], axis=1).view(np.uint64)


def _join_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, id, high, low) sorted by band and id: pairs of each band, or the rows again, numbered in blocks, where a band has more than BLOCK.

    A class that several tasks sent stands once. Holds at most one batch and BLOCK rows.
    """
    schema = pa.schema([("band", pa.int64()), ("block", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])

    def pairs_of(found: list[tuple[int, list]]) -> pa.RecordBatch:
        bands = np.repeat([k for k, _ in found], [len(p) for _, p in found])
        a, b = zip(*(x for _, p in found for x in p), strict=True)
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(bands, pa.int64()), none.cast(pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), none], schema=schema)

    def members(ids: np.ndarray, sketches: np.ndarray, band: int, block: int) -> pa.RecordBatch:
        signed = sketches.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), band)), pa.array(np.full(len(ids), block, dtype=np.int32)), pa.array(ids), pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy())], schema=schema)

    open_band, held, block, last = None, [], 0, None  # rows of the band that is not over: list of (ids, sketches)

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, sketches = (np.concatenate(x) for x in zip(*held, strict=True))
        if block:
            yield members(ids, sketches, open_band, block)
        elif len(ids) > 1 and (pairs := trie_join(ids, sketches)):
            yield pairs_of([(open_band, pairs)])

    for batch in batches:
        band, ids, high, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        fresh = np.ones(len(band), dtype=bool)
        fresh[1:] = (band[1:] != band[:-1]) | (ids[1:] != ids[:-1])
        if len(band):
            fresh[0] = last != (int(band[0]), int(ids[0]))
            last = int(band[-1]), int(ids[-1])
        band, ids, sketches = band[fresh], ids[fresh], _sketches(high, low)[fresh]
        if not len(band):
            continue
        edges = [0, *(np.flatnonzero(band[1:] != band[:-1]) + 1).tolist(), len(band)]
        found: list[tuple[int, list]] = []
        for start, end in zip(edges, edges[1:], strict=False):
            if band[start] != open_band:
                yield from close()
                open_band, held, block = int(band[start]), [], 0
                if end < len(band):  # whole in this batch
                    if end - start == 1:
                        continue
                    if end - start <= BLOCK:
                        if pairs := trie_join(ids[start:end], sketches[start:end]):
                            found.append((open_band, pairs))
                        continue
            for at in range(start, end, BLOCK):
                held.append((ids[at : min(at + BLOCK, end)], sketches[at : min(at + BLOCK, end)]))
                while sum(len(x) for x, _ in held) > BLOCK:
                    i, s = (np.concatenate(x) for x in zip(*held, strict=True))
                    yield members(i[:BLOCK], s[:BLOCK], open_band, block)
                    held, block = [(i[BLOCK:], s[BLOCK:])], block + 1
        if found:
            yield pairs_of(found)
        # the last band of a batch stays open
    yield from close()


def _join_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, id, high, low) sorted by cell: pairs of the two blocks of each cell (of one block with itself where side is 2)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    open_cell, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        side, ids, sketches = (np.concatenate(x) for x in zip(*held, strict=True))
        _, once = np.unique(ids, return_index=True)  # a class is in one block only
        side, ids, sketches = side[once], ids[once], sketches[once]
        order = np.argsort(side, kind="stable")
        left = int((side == 0).sum())
        if (side == 2).all():
            pairs = trie_join(ids, sketches)
        else:
            pairs = trie_join(ids[order], sketches[order], split=left) if 0 < left < len(ids) else []
        if pairs:
            a, b = zip(*pairs, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=schema)

    for batch in batches:
        cell, side, ids, high, low = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        if not len(cell):
            continue
        sketches = _sketches(high, low)
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        for start, end in zip(edges, edges[1:], strict=False):
            if cell[start] != open_cell:
                yield from close()
                open_cell, held = int(cell[start]), []
            held.append((side[start:end], ids[start:end], sketches[start:end]))
    yield from close()


def _cells(members: DataFrame, key: str) -> DataFrame:
    """Each row of (key, block, blocks, ...) once for every pair of blocks that its own takes part in: (cell, side, ...)."""
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumn("cell", F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))).withColumn("side", F.when(F.col("block") < F.col("other"), 0).otherwise(F.when(F.col("block") > F.col("other"), 1).otherwise(2)))


def _hot(rows: DataFrame, keys: Column, sample: int, most: int) -> DataFrame | None:
    """(key, blocks) of at most `most` keys that hold more than a `most`-th of all keys of (id, ...) rows, with the number
    of blocks they need; told from about `sample` rows chosen by id. Null if there are none."""
    total = rows.count()
    part = max(1, total // sample)
    chosen = rows.where(F.pmod("id", F.lit(part)) == 0) if part > 1 else rows
    counts = chosen.select(keys.alias("key")).groupBy("key").agg((F.count("*") * part).alias("n"))
    least = max(BLOCK, total * BANDS // most)
    hot = counts.where(F.col("n") > least).select("key", F.ceil(F.col("n") / BLOCK).cast("int")).collect()
    return rows.sparkSession.createDataFrame(hot, "key bigint, blocks int") if hot else None


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """(a, b), a < b, each pair once: rows (id, high, low, bands) that share a band key and whose sketches are within the budget."""
    hot = _hot(rows, F.explode("bands"), SAMPLE, MOST_HOT)
    banded = rows.select(F.explode("bands").alias("band"), "id", "high", "low")
    usual = banded.join(F.broadcast(hot), F.col("band") == F.col("key"), "left_anti") if hot else banded
    joined = usual.repartition("band").sortWithinPartitions("band", "id").mapInArrow(_join_sorted, _JOINED).checkpoint()
    members = joined.where(F.col("block").isNotNull())
    blocks = members.groupBy("band").agg((F.max("block") + 1).alias("blocks"))
    large = members.join(blocks.hint("merge"), "band").select("band", "block", "blocks", F.col("a").alias("id"), F.col("b").alias("high"), F.col("c").alias("low"))
    if hot:
        salted = banded.join(F.broadcast(hot), F.col("band") == F.col("key")).select("band", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "blocks", "id", "high", "low")
        large = large.unionByName(salted)
    cells = _cells(large, "band").select("cell", "side", "id", "high", "low")
    more = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_join_cells, "a bigint, b bigint")
    pairs = joined.where(F.col("block").isNull()).select("a", "b").unionByName(more)
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets(rows: DataFrame) -> DataFrame:
    """(id, runs) with the set as bytes, of the rows of (id, field, text) whose set is that of the class `id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Sets()
        for batch in batches:
            made = [(i, runs) for i, field, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (got := make(text)) is not None and _class(field, runs := packed(got)) == i]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.binary()))], names=["id", "runs"])

    return rows.select("id", "field", "text").mapInArrow(run, "id bigint, runs binary")


def _similar(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, share = [], [], []
            for i, k, x, y in zip(*(batch.column(n).to_pylist() for n in range(4)), strict=True):
                x, y = unpacked(x), unpacked(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similar * (either := len(x) + len(y) - both) - 1e-9:
                    a.append(i)
                    b.append(k)
                    share.append(both / either)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(share, pa.float64())], names=["a", "b", "share"])

    return run


def near_copies(rows: DataFrame, similar: float = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """Links between classes and the members of the classes.

    rows: (field, row_id, text). Returns links (a, b, share) between class ids, a < b, and members (field, row_id, id):
    one row per distinct (field, row_id) with at least `LEAST_WORDS` words; copies share an id. Null texts and texts
    with fewer words take no part. If a row_id has several texts, it is a member of each one's class. Rows of
    different fields are never linked. Other columns are not carried.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    rows = rows.select("field", "row_id", "text").where(F.col("text").isNotNull())
    banded = _bands(rows).checkpoint()
    members = banded.select("field", "row_id", "id").distinct()
    pairs = candidate_pairs(banded.where(F.col("bands").isNotNull()).select("id", "high", "low", "bands")).checkpoint()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sources = banded.join(wanted.hint("merge"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("field", "row_id")).alias("s")).select("id", F.col("s.field").alias("field"), F.col("s.row_id").alias("row_id"))
    # A row_id may have several texts; the id tells which belongs to the class.
    sets = _sets(rows.join(sources.hint("merge"), ["field", "row_id"]).select("id", "field", "text")).groupBy("id").agg(F.first("runs").alias("runs"))
    of = lambda side: sets.select(F.col("id").alias(side), F.col("runs").alias(f"{side}_runs")).hint("merge")
    links = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_runs", "b_runs").mapInArrow(_similar(similar), "a bigint, b bigint, share double")
    return links, members


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(field, row_id, group_id, links): the connected groups; group_id is the least class id of the group, links the number of other classes a row's class is linked with.

    Labels spread to the least label of the neighbourhood, then labels are followed once more each round; every round is
    written to the checkpoint folder. Rounds grow with the logarithm of the longest chain.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    labels = both.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("label"))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        root = step.select(F.col("id").alias("next"), F.col("next").alias("far"))
        step = step.join(root, "next", "left").select("id", "label", F.least("next", F.coalesce("far", "next")).alias("next")).checkpoint()
        if step.where("next <> label").isEmpty():
            break
        labels = step.select("id", F.col("next").alias("label"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("links"))
    return (
        members.join(labels, "id", "left").join(degree, "id", "left")
        .select("field", "row_id", F.coalesce("label", "id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return text_field(spark, folder, "clean_text").unionByName(text_field(spark, folder, "clause_text"))


def expanded(links: DataFrame, members: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b: the links as pairs of rows, and the pairs of rows within each class.

    Members of a large class are put into blocks by hash, and every pair of blocks is a unit of its own.
    """
    total = members.count()
    sizes = members.groupBy("id").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > max(BLOCK, total // MOST_HOT)).select("id", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))  # at most MOST_HOT
    blocks = F.coalesce("blocks", F.lit(1))
    sized = members.join(F.broadcast(large), "id", "left").select("id", "field", "row_id", blocks.alias("blocks"))
    placed = sized.withColumn("block", F.pmod(F.xxhash64("row_id"), "blocks").cast("int"))
    several = sizes.where("n > 1").select("id")
    inside = _cells(placed.join(several.hint("merge"), "id", "left_semi"), "id").select("cell", "side", "field", "row_id")
    left = inside.where("side <> 1").select("cell", F.col("field"), F.col("row_id").alias("x"), F.col("side").alias("x_side"))
    right = inside.where("side <> 0").select("cell", F.col("row_id").alias("y"))
    within = left.join(right.hint("merge"), "cell").where("x_side = 0 or x < y").select("field", "x", "y")

    def side(name: str) -> DataFrame:
        return placed.select(F.col("id").alias(name), F.col("block").alias(f"{name}_block"), F.col("field").alias(f"{name}_field"), F.col("row_id").alias(f"{name}_row")).hint("merge")

    cut = links.select("a", "b")
    for name in ("a", "b"):
        of = F.broadcast(large.select(F.col("id").alias(name), F.col("blocks").alias(f"{name}_blocks")))
        cut = cut.join(of, name, "left").withColumn(f"{name}_block", F.explode(F.sequence(F.lit(0), F.coalesce(f"{name}_blocks", F.lit(1)) - 1)))
    across = cut.join(side("a"), ["a", "a_block"]).join(side("b"), ["b", "b_block"]).select(F.col("a_field").alias("field"), F.col("a_row").alias("x"), F.col("b_row").alias("y"))
    pairs = across.unionByName(within).where("x <> y")
    return pairs.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of contracts, and of clauses, that share at least 0.7 of their word triples."""
    return expanded(*near_copies(_texts(spark, folder)))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every contract and clause text of at least 20 words, and its number of linked classes."""
    return groups(*near_copies(_texts(spark, folder)))


def p6_first(spark: SparkSession, folder: str) -> DataFrame:
    """The least row_id of the group of every text of at least 20 words."""
    rows = p6_groups(spark, folder).select("field", "row_id", "group_id")
    least = rows.groupBy("field", "group_id").agg(F.min("row_id").alias("first_id"))
    return rows.join(least.hint("merge"), ["field", "group_id"]).groupBy("field", "row_id").agg(F.min("first_id").alias("first_id"))
