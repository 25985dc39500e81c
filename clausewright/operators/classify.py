"""Clause types by weighted cues, by nearest centroid, and by both."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import fixed, vectors
from clausewright.operators import retrieval

Cues = dict[str, list[tuple[str, float]]]
_SIGNS = set(".*{}[]()|\\^$?+")


def found(lowered: Column, cue: str) -> Column:
    """Whether a cue occurs; plain cues need no pattern. Word limits are those of ASCII."""
    if not set(cue) & _SIGNS:
        return F.contains(lowered, F.lit(cue))
    return lowered.rlike(cue.replace("\\bparties\\b", "(?<![A-Za-z0-9_])parties(?![A-Za-z0-9_])"))


def cue_scores(body: Column, cues: Cues = fixed.CUES) -> Column:
    """An array of (less, ord, type) of the types that score in a lower-case text, best first; less is the score below zero; ties keep the declared order."""
    scores = []
    for order, (kind, weighted) in enumerate(cues.items()):
        total = functools.reduce(operator.add, (F.when(found(body, cue), float(weight)).otherwise(0.0) for cue, weight in weighted))
        scores.append(F.struct((-total).alias("less"), F.lit(order).alias("ord"), F.lit(kind).alias("type")))
    return F.array_sort(F.filter(F.array(*scores), lambda s: s["less"] < 0))


def classify_by_cues(clauses: DataFrame, body: str = "text", given: str | None = "type", cues: Cues = fixed.CUES) -> DataFrame:
    """clauses with assigned_type, confidence, runner_up and method.

    A best score below 1.5 leaves the clause UNCLASSIFIED with confidence 0 and the best as runner-up; else confidence is
    the score by 6, at most 1. A found type replaces the given one; otherwise PREAMBLE stays. Null texts score nothing.
    """
    # A generator's result is computed once; a mere column would be inlined, and scored anew, wherever it is used.
    once = lambda rows, name, value: rows.select("*", F.explode(F.array(value)).alias(name))
    lowered = once(clauses, "_lowered", F.lower(F.coalesce(F.col(body), F.lit(""))))
    ranked = once(lowered, "_ranked", cue_scores(F.col("_lowered"), cues)).drop("_lowered")
    best, second = F.try_element_at("_ranked", F.lit(1)), F.try_element_at("_ranked", F.lit(2))
    typed = best.isNotNull() & (-best["less"] >= fixed.CUE_LEAST)
    kept = F.when(F.col(given) == fixed.PREAMBLE, fixed.PREAMBLE).otherwise(fixed.UNCLASSIFIED) if given else F.lit(fixed.UNCLASSIFIED)
    return (
        ranked.withColumn("assigned_type", F.when(typed, best["type"]).otherwise(kept))
        .withColumn("confidence", F.when(typed, F.least(F.lit(1.0), -best["less"] / fixed.CUE_FULL)).otherwise(0.0))
        .withColumn("runner_up", F.when(typed, second["type"]).otherwise(best["type"]))
        .withColumn("method", F.lit("keyword"))
        .drop("_ranked")
    )


def centroids(seeds: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centroid): the mean vector of each label, of length one. Null vectors and labels take no part.

    Means are pre-aggregated by position, so a label with most of the rows is no hot group.
    """
    parts = seeds.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).alias("label"), F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    gathered = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("mean"))
    return gathered.select("label", vectors.unit(F.col("mean")).alias("centroid"))


#: So many labels are held against the items at a time.
BLOCK_LABELS = 10_000


def nearest_centroid(items: DataFrame, centres: DataFrame, key: str, vector: str = "embedding", least: float = fixed.CENTROID_LEAST, margin: float = fixed.CENTROID_MARGIN) -> DataFrame:
    """(key, best, score, confidence, runner_up, second_score, accepted): the two nearest centroids of each item.

    The labels are the stated set that every item is held against, in blocks that are broadcast one by one; of each
    block an item keeps its two best. Accepted are scores of at least `least` that lead by `margin`; confidence is the
    score, but not below zero, accepted or not. Ties go to the lesser label.
    """
    blocks = max(1, -(-centres.count() // BLOCK_LABELS))
    items = items.where(F.col(vector).isNotNull()).select(key, vector)

    def two_best(block: DataFrame) -> DataFrame:
        held = block.agg(F.collect_list(F.struct("label", "centroid")).alias("centres"))
        scores = F.transform("centres", lambda c: F.struct((-vectors.dot(F.col(vector), c["centroid"])).alias("less"), c["label"].alias("label")))
        return items.join(F.broadcast(held)).select(key, F.slice(F.array_sort(scores), 1, 2).alias("r"))

    parts = [two_best(centres.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == n) if blocks > 1 else centres) for n in range(blocks)]
    scored = parts[0]
    if blocks > 1:
        scored = functools.reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.slice(F.array_sort(F.flatten(F.collect_list("r"))), 1, 2).alias("r"))
    best, second = F.try_element_at("r", F.lit(1)), F.try_element_at("r", F.lit(2))
    score, lead = -best["less"], F.coalesce(-best["less"] + second["less"], F.lit(float("inf")))
    return scored.select(key, best["label"].alias("best"), score.alias("score"), F.greatest(F.lit(0.0), score).alias("confidence"), second["label"].alias("runner_up"), (-second["less"]).alias("second_score"), ((score >= least) & (lead >= margin)).alias("accepted"))


def ensemble(cosines: DataFrame, keywords: DataFrame, key: str) -> DataFrame:
    """(key, assigned_type, confidence, runner_up) from (key, type, cosine) and (key, type, score).

    0.6 of the cosine and 0.4 of the keyword score by the item's greatest keyword score; types without a cosine are not
    ranked. Below 0.42 the item is UNCLASSIFIED, the best as runner-up. Ties go to the type that is first by name.
    """
    most = keywords.groupBy(key).agg(F.max("score").alias("most"))
    joined = cosines.join(keywords, [key, "type"], "left").join(most, key, "left")
    value = fixed.ENSEMBLE_COSINE * F.col("cosine") + fixed.ENSEMBLE_KEYWORD * F.coalesce(F.col("score"), F.lit(0.0)) / F.coalesce("most", F.lit(1.0))
    ranked = joined.select(key, "type", value.alias("value")).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("value"), "type"))).where("rank <= 2")
    top = ranked.groupBy(key).agg(F.max(F.when(F.col("rank") == 1, F.col("type"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("rank") == 2, F.col("type"))).alias("second"))
    sure = F.col("value") >= fixed.ENSEMBLE_LEAST
    return top.select(key, F.when(sure, F.col("first")).otherwise(fixed.UNCLASSIFIED).alias("assigned_type"), F.greatest(F.lit(0.0), F.col("value")).alias("confidence"), F.when(sure, F.col("second")).otherwise(F.col("first")).alias("runner_up"))


def classify_by_both(clauses: DataFrame, key: str, encoder: Callable[[DataFrame, str, str], DataFrame], seeds: DataFrame, body: str = "text", given: str | None = "type", cues: Cues = fixed.CUES) -> DataFrame:
    """clauses with assigned_type, confidence, runner_up and method by cues and by vectors together.

    seeds: (label, text), phrases of each type, whose mean vectors are the types' centroids. encoder(rows, key, text) makes
    (key, embedding). A found type replaces the given one; otherwise PREAMBLE stays. Null texts count as empty.
    """
    told = clauses.select(key, F.coalesce(F.col(body), F.lit("")).alias("text"))
    held = centroids(encoder(seeds.select("label", "text"), "label", "text")).select(F.col("label").alias("ord"), F.col("centroid").alias("embedding"))
    cosines = retrieval.cosine_scores(encoder(told, key, "text"), held, key).select(key, F.col("ord").alias("type"), F.col("score").alias("cosine"))
    keywords = told.select(key, F.explode(cue_scores(F.lower("text"), cues)).alias("s")).select(key, F.col("s.type").alias("type"), (-F.col("s.less")).alias("score"))
    joined = clauses.join(ensemble(cosines, keywords, key), key, "left").withColumn("method", F.lit("ensemble"))
    none = F.coalesce("assigned_type", F.lit(fixed.UNCLASSIFIED)) == fixed.UNCLASSIFIED
    kept = F.when(F.col(given) == fixed.PREAMBLE, fixed.PREAMBLE).otherwise(fixed.UNCLASSIFIED) if given else F.lit(fixed.UNCLASSIFIED)
    return joined.withColumn("assigned_type", F.when(none, kept).otherwise(F.col("assigned_type"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def backend(with_vectors: bool) -> str:
    """The label of the way clauses are classified."""
    return "inlegalbert+keyword" if with_vectors else "keyword-only"
