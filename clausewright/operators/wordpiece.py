"""Word pieces by greedy longest match over a given vocabulary, as numbers for an encoder."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions.arrow import flat_map

CLS, SEP, UNKNOWN = "[CLS]", "[SEP]", "[UNK]"
LEAST_VOCABULARY, LONGEST_WORD = 100, 100
#: The most pieces of a text, whatever a model could take.
MOST_PIECES = 256

_models: dict[str, object] = {}


def sequence_limit(metadata: dict | None) -> int:
    """How many pieces a model is given: its own limit if it names one, but never more than MOST_PIECES."""
    own = (metadata or {}).get("max_length")
    return min(MOST_PIECES, int(own)) if own else MOST_PIECES


def shared(name: str, make: Callable[[], object]) -> object:
    """One model per worker process: made when first asked for, kept for the tasks that follow."""
    if name not in _models:
        _models[name] = make()
    return _models[name]


def pooled(states: list[list[list[float]]], masks: list[list[int]]) -> list[list[float]]:
    """The mean of each text's states where its mask is not zero, of length one; zeros if all is masked."""
    import numpy as np

    out = []
    for rows, mask in zip(states, masks, strict=True):
        kept = np.asarray(rows, dtype=np.float64)[np.asarray(mask, dtype=bool)]
        mean = kept.mean(axis=0) if len(kept) else np.zeros(len(rows[0]) if rows else 0)
        length = np.linalg.norm(mean)
        out.append((mean / length if length else mean).tolist())
    return out


def _mark(ch: str) -> bool:
    return ch.isascii() and not ch.isalnum() and not ch.isspace() and ch.isprintable() or unicodedata.category(ch)[0] == "P"


def basic_tokens(body: str) -> list[str]:
    """Lower-case tokens without accents; control characters drop out, punctuation stands alone."""
    plain = unicodedata.normalize("NFD", body.lower())
    out = []
    for ch in plain:
        kind = unicodedata.category(ch)
        if kind == "Mn" or kind[0] == "C" and ch not in "\t\n\r":
            continue
        out.append(f" {ch} " if _mark(ch) else ch)
    return "".join(out).split()


def pieces(token: str, vocabulary: dict[str, int]) -> list[str]:
    """Longest known pieces from the left, later ones with ##; the whole word is unknown if any part is."""
    if len(token) > LONGEST_WORD:
        return [UNKNOWN]
    out, at = [], 0
    while at < len(token):
        end = next((e for e in range(len(token), at, -1) if ("##" if at else "") + token[at:e] in vocabulary), 0)
        if not end:
            return [UNKNOWN]
        out.append(("##" if at else "") + token[at:end])
        at = end
    return out


def encode(rows: DataFrame, key: str, body: str, vocabulary: dict[str, int], most: int = MOST_PIECES) -> DataFrame:
    """(key, ids, mask, types): between [CLS] and [SEP], cut to `most`; null counts as empty."""
    if len(vocabulary) < LEAST_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(vocabulary)} pieces is no vocabulary")
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def make() -> Callable:
        known, memo = shared.value, {}

        def each(row, t: str | None):
            tokens = []
            for token in basic_tokens(t or ""):
                if token not in memo and len(memo) < 200_000:
                    memo[token] = pieces(token, known)
                tokens += memo.get(token) or pieces(token, known)
            ids = [known[CLS], *(known[p] for p in tokens[: most - 2]), known[SEP]]
            yield row, ids, [1] * len(ids), [0] * len(ids)

        return each

    schema = f"key {rows.schema[key].dataType.simpleString()}, ids array<bigint>, mask array<bigint>, types array<bigint>"
    return flat_map(rows.select(F.col(key).alias("key"), F.col(body).alias("body")), make, schema, ["key", "body"]).withColumnRenamed("key", key)


def embed(rows: DataFrame, body: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32) -> DataFrame:
    """rows with `embedding` of length one from a given encoder; each distinct text is encoded once, by a model that is
    made once per task. Null texts get no vector."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder()
        for part in batches:
            texts, out = part.column(0).to_pylist(), []
            for at in range(0, len(texts), batch):
                for vector in model(texts[at : at + batch]):
                    length = sum(x * x for x in vector) ** 0.5 or 1.0
                    out.append([x / length for x in vector])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float32()))], names=["_text", "embedding"])

    distinct = rows.where(F.col(body).isNotNull()).select(F.col(body).alias("_text")).distinct()
    return rows.join(distinct.mapInArrow(run, "_text string, embedding array<float>"), rows[body] == F.col("_text"), "left").drop("_text")
