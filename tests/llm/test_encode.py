import os
import random

import pytest
from pyspark.sql import functions as F

from clausewright.llm import encode as e

FILE = os.path.join(e.TOKENIZERS, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no public vocabulary here")
ODD = ["", " ", "  a  b", "a\n b", "can't stop", "中文。テスト", "สวัสดี", "😀👩‍👩‍👧", "<|endoftext|>", "é é", "tab\tend ", "x" * 5000, "12 34567", " ", "\x00\x01"]


def test_stretches_equal_the_library():
    encoder, tokenizer, rng = e.Encoder(FILE), e.load(FILE), random.Random(4)
    parts = [" ", "  ", "\n", " \n", "a", "Bc", "'s", "12", "é", "\t", ".", "中", "　", "<|endoftext|>"]
    for text in [*ODD, *("".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000))]:
        assert encoder(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark):
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*ODD, None])], "id bigint, text string, ids string")
    encoded = e.encode(rows, "id", "text")
    got = {r.id: r.ids for r in encoded.collect()}
    assert got[0] == [] and got[len(ODD)] == []
    back = {r.id: r.text for r in e.decode(encoded, "id").collect()}
    assert all(back[k] == t for k, t in enumerate(ODD)) and back[len(ODD)] == ""
    nothing = encoded.select("id", F.lit(None).cast("array<int>").alias("ids"))
    assert e.decode(nothing, "id").head().text is None


def test_offsets_cover_split_characters():
    library = e.Library(FILE)
    for text in ("naïve 😀!", "中a"):
        tokens = [library.bytes[i] for i in library.encode(text)]
        spans = e.offsets(text, tokens)
        assert len(spans) == len(tokens) and spans[0][0] == 0 and spans[-1][1] == len(text)
        assert all(a < b for a, b in spans)


FILES = sorted(f for f in os.listdir(e.TOKENIZERS) if f.endswith((".json", ".tiktoken", ".model"))) if os.path.isdir(e.TOKENIZERS) else []
MORE = [*ODD[1:], "café délai", "cafe\u0301 de\u0301lai", "ﬁne ＡＢ", "A  B\n\nC", "O'Neil'S 3,5 ½"]


def straight(name):
    """The library itself, as its own description uses it."""
    path = os.path.join(e.TOKENIZERS, name)
    if name.endswith(".json"):
        tokenizer = e.load(path)
        return lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=e.CUT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@pytest.mark.parametrize("name", FILES)
def test_every_vocabulary_equals_its_library(spark, name):
    texts = [*MORE, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.ids for r in e.encode(rows, "id", "text", name).collect()}
    direct = straight(name)
    assert [got[k] for k in range(len(texts))] == [direct(t) if t else [] for t in texts]
    back = {r.id: r.text for r in e.decode(e.encode(rows, "id", "text", name), "id", name=name).collect()}
    assert back[len(MORE)] == "" and all(back[k] == t for k, t in enumerate(MORE) if e.Library(os.path.join(e.TOKENIZERS, name)).bytes)


def test_places_of_tokens(spark):
    rows = spark.createDataFrame(list(enumerate([*MORE, "", None])), "id int, text string")
    for r in e.located(rows, "id", "text").collect():
        text = [*MORE, "", None][r.id] or ""
        assert len(r.starts) == len(r.ends) == len(r.ids) and (r.starts[0], r.ends[-1]) == (0, len(text)) if text else not r.ids
        assert all(b <= c + 1 for b, c in zip(r.starts[1:], r.ends, strict=False))
    with pytest.raises(ValueError):
        e.located(rows, "id", "text", "word_bpe_49k.json")
