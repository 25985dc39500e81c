"""Rules over typed clauses: predicates that raise flags, and required types that are missing. The rules are given."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A flag for clauses of `type` (any if null) whose text meets `pattern` and not `unless`."""

    type: str | None
    pattern: str | None
    unless: str | None
    severity: str
    category: str


#: A rule that no clause meets.
NEVER = Rule("", None, None, "LOW", "none")


def greatest_number(body: Column, pattern: str) -> Column:
    """The greatest of the numbers in group 1 of all matches; 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit(pattern), 1), lambda n: n.try_cast("int"))), F.lit(0))


def flags(clauses: DataFrame, rules: list[Rule], key: list[str], kind: str = "assigned_type", body: str = "text") -> DataFrame:
    """(key, severity, category) of each rule that holds for a clause. Rules run as column expressions in one pass."""
    made = []
    for rule in rules:
        holds = F.lit(True)
        if rule.type is not None:
            holds = holds & (F.col(kind) == rule.type)
        if rule.pattern:
            holds = holds & F.col(body).rlike(f"(?i){rule.pattern}")
        if rule.unless:
            holds = holds & ~F.col(body).rlike(f"(?i){rule.unless}")
        made.append(F.when(holds, F.struct(F.lit(rule.severity).alias("severity"), F.lit(rule.category).alias("category"))))
    return clauses.select(*key, F.explode(F.array_compact(F.array(*made))).alias("flag")).select(*key, "flag.severity", "flag.category")


def missing_types(clauses: DataFrame, required: list[tuple[str, str, str]], document: str, kind: str = "assigned_type") -> DataFrame:
    """(document, type, severity, category) of each required type a document with clauses lacks.

    Types are gathered to one small set per document (at most the declared types), so no document is a hot group.
    """
    present = clauses.groupBy(document).agg(F.collect_set(F.when(F.col(kind).isin(*[t for t, _, _ in required]), F.col(kind))).alias("present"))
    wanted = F.array(*(F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(c).alias("category")) for t, s, c in required))
    return present.select(document, F.explode(F.filter(wanted, lambda w: ~F.array_contains("present", w["type"]))).alias("m")).select(document, "m.*")


def within(points: DataFrame, spans: DataFrame, document: str, at: str = "at") -> DataFrame:
    """Points joined with the spans (document, span_start, span_end) that hold them: an equi join on the document and a range in it."""
    return points.join(spans, (points[document] == spans[document]) & (points[at] >= spans["span_start"]) & (points[at] < spans["span_end"])).drop(spans[document])


def top_severity(spark: SparkSession, flagged: DataFrame, document: str) -> DataFrame:
    """(document, severity): the highest of its flags."""
    rank = F.when(F.col("severity") == "HIGH", 2).when(F.col("severity") == "MEDIUM", 1).otherwise(0)
    return flagged.groupBy(document).agg(F.max_by("severity", rank).alias("severity"))


def first_clauses(clauses: DataFrame, document: str, order: str = "span_start") -> DataFrame:
    """The first clause of each document, all its columns together; what a document's own flags cite."""
    rest = [c for c in clauses.columns if c != document]
    return clauses.groupBy(document).agg(F.min_by(F.struct(*rest), F.struct(order, F.xxhash64(*rest))).alias("c")).select(document, "c.*")


def counts(clauses: DataFrame, flagged: DataFrame, found: DataFrame, document: str) -> DataFrame:
    """(document, clause_count, risk_count, entity_count): documents that have any of them; each is counted before the join."""
    def of(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(document).agg(F.count("*").alias(name))

    joined = of(clauses, "clause_count").join(of(flagged, "risk_count"), document, "full").join(of(found, "entity_count"), document, "full")
    return joined.select(document, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("clause_count", "risk_count", "entity_count")))


def united(of_clauses: DataFrame, of_documents: DataFrame, document: str, columns: list[str]) -> DataFrame:
    """(document, scope, columns): what was said of clauses, then what was said of the document as a whole."""
    return of_clauses.select(document, F.lit("clause").alias("scope"), *columns).unionByName(of_documents.select(document, F.lit("document").alias("scope"), *columns))
