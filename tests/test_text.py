import pytest
from pyspark.sql import functions as F

from clausewright.functions import text, vectors


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("o")).head()[0]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (None, ""),
        ("", ""),
        ("a\r\nb", "a b"),
        ("in-\nvoice due", "invoice due"),
        ("one\n\n\n\ntwo", "one\n\ntwo"),
        ("a  \t b", "a b"),
        ("x y z", "x y z"),
        ("intro\n7. PAYMENT TERMS\nThe fee\nis due.", "intro\n\n7. PAYMENT TERMS\n\nThe fee is due."),
        ("　 ends  ", "ends"),
    ],
)
def test_normalize(spark, raw, clean):
    assert one(spark, raw, text.normalize) == clean


@pytest.mark.parametrize(("raw", "label"), [(None, "Unclassified"), (" ", "Unclassified"), ("unclassified", "Unclassified"), ("NON_COMPETE", "Non compete")])
def test_clause_label(spark, raw, label):
    assert one(spark, raw, text.clause_label) == label


def test_other_labels(spark):
    assert one(spark, None, text.entity_label) == "Other"
    assert one(spark, "one-sided-exit", text.category_label) == "One sided exit"
    assert one(spark, "HIGH", text.severity_label) == "High" and one(spark, None, text.severity_label) == "Unrated"
    assert one(spark, "BM25", text.method_label) == "keyword match" and one(spark, None, text.method_label) == "matched"


@pytest.mark.parametrize(("raw", "out"), [(None, ""), ("short", "short"), ("aaaa bbbb cccc", "aaaa bbbb…"), ("abcdefghijklmno", "abcdefghij…"), ("a\x00b", "a b")])
def test_truncate(spark, raw, out):
    assert one(spark, raw, lambda c: text.truncate(c, 10)) == out
    assert one(spark, raw, lambda c: text.truncate(c, 0)) == ""


def test_first_sentence(spark):
    assert one(spark, "Short. But the cut needs thirty characters. Rest.", text.first_sentence) == "Short. But the cut needs thirty characters. Rest."
    assert one(spark, "This first sentence is quite long enough. Rest.", text.first_sentence) == "This first sentence is quite long enough."
    assert one(spark, "x" * 300, text.first_sentence) == "x" * 197 + "..."


def test_terms(spark):
    assert one(spark, "The fees, THE fees and Straße 7 x", text.terms) == ["fees", "fees", "straße"]


def test_slice_is_held_within_the_text(spark):
    row = spark.createDataFrame([("a😀bc", 1, 99)], "t string, a int, b int").select(text.slice_text(F.col("t"), F.col("a"), F.col("b")).alias("o")).head()
    assert row[0] == "😀bc"


@pytest.mark.parametrize(
    ("candidate", "ok"),
    [
        ("The clause asks for notice of 30 days before either side ends it, see section 12.", True),
        ("The clause asks for notice of 45 days before either side ends it, see section 12.", False),
        ("The clause asks for notice of 30 days before either side ends it, see section 13.", False),
        ("Too short.", False),
    ],
)
def test_supported(spark, candidate, ok):
    rows = spark.createDataFrame([(candidate, "Notice of 30 days, section 12", "Section 12", "note")], "c string, s string, a string, n string")
    assert rows.select(text.supported(F.col("c"), F.col("s"), F.col("a"), F.col("n")).alias("o")).head()[0] is ok


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    out = row.select(vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.norm(F.col("a")).alias("n"), vectors.unit(F.col("z")).alias("z"), vectors.dot(F.col("a"), F.array(F.lit(1.0))).alias("bad")).head()
    assert (out.d, out.n, out.z, out.bad) == (11.0, 5.0, [0.0, 0.0], None)
