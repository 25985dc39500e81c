"""Notes on clauses from templates, each with a citation, and the check of rephrased notes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.functions import fixed, text

INSTRUCTION = "Say the note in plain words for a reader without training in law, in two or three sentences. Use only what the clause and the notes on provisions say: add no name, date, sum, period or section number, and give no verdict."


def explainers(clauses: DataFrame, notes: DataFrame, key: list[str], kind: str = "assigned_type") -> DataFrame:
    """(key, headline, body, citations) of clauses (with text) whose type has a note in (type, body); other types get none."""
    joined = clauses.join(notes.select(F.col("type").alias(kind), F.col("body").alias("_note")), kind)
    cited = F.array(F.struct(F.lit("clause").alias("kind"), F.col("text").alias("wording")))
    return joined.select(*key, F.concat(F.lit(fixed.EXPLAINS), text.humanise(F.col(kind))).alias("headline"), F.col("_note").alias("body"), cited.alias("citations"))


def flag_notes(flagged: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    """(key, headline, body, citations) of flags (key, severity, category, rationale, text).

    The best match (key, rank, act, provision, summary) of the clause is cited beside the clause itself; without one the
    clause alone is. Every note has at least one citation.
    """
    best = matches.where("rank = 1").select(*key, "act", "provision", "summary")
    joined = flagged.join(best, key, "left")
    prefix = F.coalesce(*(F.when(F.col("severity") == s, p) for s, p in fixed.NOTE_PREFIX.items()), F.lit(""))
    law = F.concat(F.lit("Related law - "), F.col("act"), F.lit(", "), F.col("provision"), F.lit(": "), text.first_sentence(F.col("summary")))
    clause = F.struct(F.lit("clause").alias("kind"), F.col("text").alias("wording"))
    statute = F.when(F.col("act").isNotNull(), F.struct(F.lit("statute").alias("kind"), F.col("summary").alias("wording")))
    return joined.select(*key, F.concat(prefix, text.humanise(F.col("category"))).alias("headline"), F.concat_ws(" ", "rationale", law).alias("body"), F.array_compact(F.array(clause, statute)).alias("citations"))


def document_notes(flagged: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """(key, headline, body, citations) of a document's own flags (key, severity, category, rationale): each cites the
    document's first clause (key, text); documents without clauses have no notes, and none names a provision."""
    none = first.sparkSession.createDataFrame([], f"{key} {first.schema[key].dataType.simpleString()}, rank int, act string, provision string, summary string")
    return flag_notes(flagged.join(first.select(key, "text"), key), none, [key])


def prompts(notes: DataFrame) -> DataFrame:
    """notes (clause, body, provisions ARRAY<STRING>, ...) with what a rephrasing stage is given: `prompt`, and for the
    check of its answer `allowed` (the notes on provisions) and `source` (all it may draw on).

    Clause, note and each provision's note are cut to their budgets. Null texts count as empty.
    """
    cut = lambda body, most: F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, most), F.lit(" ...")))
    held = F.coalesce("provisions", F.array().cast("array<string>"))
    allowed = F.array_join(F.transform(held, lambda p: cut(p, fixed.REPHRASE_STATUTE)), "\n")
    clause, body = (F.coalesce(F.col(c), F.lit("")) for c in ("clause", "body"))
    prompt = F.concat_ws("\n", F.lit(INSTRUCTION), F.lit("Clause:"), cut(clause, fixed.REPHRASE_CLAUSE), F.lit("Note:"), cut(body, fixed.REPHRASE_NOTE), F.lit("Provisions:"), F.when(allowed == "", "(none)").otherwise(allowed))
    return notes.withColumns({"prompt": prompt, "allowed": allowed, "source": F.concat_ws(" ", clause, body, allowed)})


def rephrased(notes: DataFrame, rephrase: Callable[[DataFrame], DataFrame], key: list[str]) -> DataFrame:
    """notes (key, body, source, allowed) with the body a given stage proposes as (key, candidate), where it invents nothing; else the body as it was."""
    proposed = notes.join(rephrase(notes), key, "left")
    kept = F.coalesce(text.supported(F.col("candidate"), F.col("source"), F.col("allowed"), F.col("body")), F.lit(False))
    return proposed.withColumn("body", F.when(kept, F.col("candidate")).otherwise(F.col("body"))).withColumn("accepted", kept).drop("candidate")
