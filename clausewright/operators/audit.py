"""Counterfactual audit: whether exchanging a word changes what an analysis says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variants(cases: DataFrame) -> DataFrame:
    """(name, variant, text): the base text (variant null) and one text per substitution, all its occurrences replaced.

    cases: (name, base_text, substitutions MAP). Null or empty maps give the base text only.
    """
    base = cases.select("name", F.lit(None).cast("string").alias("variant"), F.col("base_text").alias("text"))
    changed = cases.select("name", "base_text", F.explode("substitutions").alias("old", "new")).select("name", F.concat_ws(" -> ", "old", "new").alias("variant"), F.replace("base_text", "old", "new").alias("text"))
    return base.unionByName(changed)


def all_at_once(cases: DataFrame) -> DataFrame:
    """(name, text) with all substitutions made, in the order of their keys."""
    entries = F.array_sort(F.map_entries("substitutions"))
    return cases.select("name", F.aggregate(entries, F.col("base_text"), lambda t, e: F.replace(t, e["key"], e["value"])).alias("text"))


def audit(cases: DataFrame, signal: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(name, variant, added, removed, stable): the signals of each variant against those of its base.

    `signal` makes (name, variant, signal) rows from (name, variant, text); base and variants run in one job.
    """
    texts = variants(cases)
    sets = signal(texts).groupBy("name", "variant").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    given = sets.select(F.col("name").alias("_name"), F.col("variant").alias("_variant"), "signals")
    none = F.array().cast("array<string>")
    every = texts.select("name", "variant").join(given, (F.col("name") == F.col("_name")) & F.col("variant").eqNullSafe(F.col("_variant")), "left").select("name", "variant", F.coalesce("signals", none).alias("signals"))
    base = every.where("variant is null").select("name", F.col("signals").alias("base"))
    joined = every.where("variant is not null").join(base, "name")
    added, removed = F.array_sort(F.array_except("signals", "base")), F.array_sort(F.array_except("base", "signals"))
    return joined.select("name", "variant", added.alias("added"), removed.alias("removed"), ((F.size(added) == 0) & (F.size(removed) == 0)).alias("stable"))


def report(results: DataFrame) -> DataFrame:
    """(name, line) for each case: STABLE, or CHANGED with its changed variants in order."""
    shown = F.when(~F.col("stable"), F.concat(F.col("variant"), F.lit(" +["), F.array_join("added", ", "), F.lit("] -["), F.array_join("removed", ", "), F.lit("]")))
    each = results.groupBy("name").agg(F.bool_and("stable").alias("stable"), F.array_sort(F.collect_list(shown)).alias("changes"))
    return each.select("name", F.concat(F.col("name"), F.lit(": "), F.when(F.col("stable"), "STABLE").otherwise(F.concat(F.lit("CHANGED "), F.array_join("changes", "; ")))).alias("line"))


def signals(texts: DataFrame, typed: Callable[[DataFrame], DataFrame], flagged: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(name, variant, signal): the types of the clauses of each text, but for the unclassified, and the categories of the
    flags on its clauses. What is said of a document as a whole is no signal.

    texts: (name, variant, text). typed adds assigned_type to its clauses (name, variant, text, type), flagged makes
    (name, variant, category) of them.
    """
    from clausewright.functions import fixed
    from clausewright.operators import segment

    keyed = texts.withColumn("doc", F.struct("name", "variant")).withColumn("doc", F.to_json("doc"))
    clauses = typed(segment.segment(keyed, "doc").join(keyed.select("doc", "name", "variant"), "doc"))
    found = clauses.where(F.col("assigned_type") != fixed.UNCLASSIFIED).select("name", "variant", F.concat(F.lit("clause:"), F.col("assigned_type")).alias("signal"))
    if flagged:
        found = found.unionByName(flagged(clauses).select("name", "variant", F.concat(F.lit("risk:"), F.col("category")).alias("signal")))
    return found


def summary(results: DataFrame) -> DataFrame:
    """(stable, total, all_stable, line): how many cases no exchange changed."""
    each = results.groupBy("name").agg(F.bool_and("stable").alias("stable"))
    counted = each.agg(F.count_if("stable").alias("stable"), F.count("*").alias("total"))
    return counted.select("stable", "total", (F.col("stable") == F.col("total")).alias("all_stable"), F.concat(F.col("stable").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" cases stable")).alias("line"))
