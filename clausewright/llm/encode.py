"""Problem 8: the token ids of every text by a public tokenizer, their characters, and the way back.

The libraries do the encoding, over Arrow batches. Ids of recurring stretches are remembered where the vocabulary cuts a
text by the byte-level pattern and changes nothing before, so that ids of cuts can be joined; others get whole texts.
Places of tokens come from the byte-to-character mapping; decoding reverses the byte table.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm.base import MEMO_LIMIT
from clausewright.sources.tables import table

#: Where the public vocabulary files lie; a parameter of every function here.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")

#: Fixed value: the pattern by which a byte-level vocabulary of this kind cuts a text before merging.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Stretches longer than this are encoded each time and not remembered.
REMEMBER = 80


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load(path: str):
    """The tokenizer of a JSON file, with special tokens' strings treated as ordinary text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class Library:
    """A public vocabulary behind one face: `encode` a text, the bytes of each id (null where ids don't stand for bytes)."""

    def __init__(self, path: str) -> None:
        self.joins = False  # whether the ids of the pattern's cuts can be joined
        self.bytes: dict[int, bytes] | None = None
        if path.endswith(".json"):
            import json

            tokenizer = load(path)
            with open(path, encoding="utf-8") as file:
                parts = json.load(file)
            first = parts.get("pre_tokenizer") or {}
            plain = parts.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space")
            special = all(token.get("special") for token in parts.get("added_tokens", []))
            self.joins = bool(plain and first.get("use_regex", True) and special)
            if plain:
                back = {c: b for b, c in byte_table().items()}
                self.bytes = {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in tokenizer.get_vocab().items()}
            self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
            self.decode = lambda ids: tokenizer.decode(ids, skip_special_tokens=False)
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            own = tiktoken.Encoding(os.path.basename(path), pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
            self.bytes = {rank: token for token, rank in ranks.items()}
            self.encode = own.encode_ordinary
        elif path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: pieces.encode(text, num_threads=1)
            self.decode = pieces.decode
        else:
            raise ValueError(f"no library reads {path}")
        if self.bytes is not None:
            self.decode = lambda ids: b"".join(self.bytes[i] for i in ids).decode("utf-8", "replace")


class Encoder:
    """Encodes a text by the library, remembering the ids of stretches that recur where they can be joined.

    Merges never cross a cut of the pattern, so ids of cuts can be joined. A single space between two characters that
    are no white space always begins a cut; texts whose white space is of that kind (or has no space beside it) are
    taken apart at their spaces first, which spares most runs of the pattern. Other texts go through the pattern.
    """

    def __init__(self, path: str) -> None:
        import regex

        self.library, self.cuts = Library(path), regex.compile(CUT)
        self.stretches: dict[str, list[int]] = {}
        self.heads: dict[str, list[int]] = {}

    def stretch(self, text: str) -> list[int]:
        """Ids of a stretch by its cuts; the library encodes each cut that isn't known yet."""
        known, ids = self.heads, []
        for cut in self.cuts.findall(text):
            got = known.get(cut)
            if got is None:
                got = self.library.encode(cut)
                if len(cut) <= REMEMBER:
                    known[cut] = got
            ids += got
        return ids

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.library.joins:
            return self.library.encode(text)
        if len(self.stretches) > MEMO_LIMIT:
            self.stretches.clear()
        if len(self.heads) > MEMO_LIMIT:
            self.heads.clear()
        known, parts = self.stretches, text.split(" ")
        if not parts[0] or parts[0][-1].isspace():
            return self.stretch(text)
        ids = self.stretch(parts[0])
        for part in parts[1:]:
            try:
                ids += known[part]
            except KeyError:
                if not part or part[0].isspace() or part[-1].isspace():  # never remembered, so always seen here
                    return self.stretch(text)
                got = self.stretch(" " + part)
                if len(part) <= REMEMBER:
                    known[part] = got
                ids += got
        return ids


def encode(rows: DataFrame, key: str, text: str, name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row by the vocabulary file `name`; null and empty texts have an empty list.

    Repeated rows are kept as they are. Works on Arrow batches without a shuffle; the library splits each text with
    its own pattern, so a very long text needs memory in proportion to its own length only.
    """
    path, kind = os.path.join(folder, name), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        for batch in batches:
            ids = pa.array([encoder(text) for text in batch.column("body").to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), ids], names=["row_id", "ids"])

    picked = rows.select(F.col(key).alias("row_id"), F.col(text).alias("body"))
    return picked.mapInArrow(run, f"row_id {kind}, ids array<int>").withColumnRenamed("row_id", key)


def offsets(text: str, tokens: list[bytes]) -> list[tuple[int, int]]:
    """(first, past the last) character of each token by its bytes: a token that begins or ends inside a character's
    bytes still covers that character."""
    owner = [k for k, ch in enumerate(text) for _ in range(1 if ch < "\x80" else 2 if ch < "\u0800" else 3 if ch < "\U00010000" else 4)]
    spans, at = [], 0
    for token in tokens:
        size = len(token)
        spans.append((owner[at], owner[at + size - 1] + 1) if size else (owner[at - 1] + 1 if at else 0,) * 2)
        at += size
    return spans


def located(rows: DataFrame, key: str, text: str, name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids, starts, ends): the ids of every row with the characters each covers; empty lists for null and empty texts.

    Only vocabularies whose ids stand for bytes have such places; others raise ValueError. Rows are kept as they are.
    """
    path, kind = os.path.join(folder, name), rows.schema[key].dataType.simpleString()
    if Library(path).bytes is None:
        raise ValueError(f"the ids of {name} do not stand for bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(path)
        of = encoder.library.bytes
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            ids = [encoder(body) for body in bodies]
            spans = [offsets(body or "", [of[i] for i in each]) for body, each in zip(bodies, ids, strict=True)]
            lists = (pa.array(values, type=pa.list_(pa.int32())) for values in (ids, [[a for a, _ in s] for s in spans], [[b for _, b in s] for s in spans]))
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *lists], names=["row_id", "ids", "starts", "ends"])

    picked = rows.select(F.col(key).alias("row_id"), F.col(text).alias("body"))
    return picked.mapInArrow(run, f"row_id {kind}, ids array<int>, starts array<int>, ends array<int>").withColumnRenamed("row_id", key)


def decode(rows: DataFrame, key: str, ids: str = "ids", name: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) from ids. Where ids stand for bytes, the bytes of all tokens are joined before they are read as UTF-8,
    so characters split between tokens come back whole; bytes that form no character give U+FFFD. Others are left to
    the library, and what a vocabulary dropped stays lost. Null ids give null, an empty list an empty text."""
    path, kind = os.path.join(folder, name), rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Library(path)
        for batch in batches:
            texts = [None if each is None else library.decode(each) if each else "" for each in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(texts, type=pa.string())], names=["row_id", "text"])

    picked = rows.select(F.col(key).alias("row_id"), F.col(ids).alias("ids"))
    return picked.mapInArrow(run, f"row_id {kind}, text string").withColumnRenamed("row_id", key)


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encode(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text, made from its ids."""
    return decode(p8_ids(spark, folder), "doc_id")


def p8_covered(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, covered, disordered): how many characters the tokens of every document cover, and whether any begins before the one ahead."""
    spans = located(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text")
    last = F.aggregate(F.arrays_zip("starts", "ends"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), lambda s, x: F.struct(F.greatest(s["at"], x["ends"]).alias("at"), (s["n"] + F.greatest(F.lit(0), x["ends"] - F.greatest(x["starts"], s["at"]))).alias("n")))
    return spans.select("doc_id", last["n"].alias("covered"), (F.array_sort("starts") != F.col("starts")).alias("disordered"))
