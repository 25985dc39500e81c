"""Sinks: one JSON document and one plain text per analysed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewright.functions import fixed, text
from clausewright.operators.pipeline import Analysis

DISCLAIMER = "This is an aid to reading, not legal advice."


def _gathered(rows: DataFrame, key: str, name: str, order: list[str], **fields: Column | str) -> DataFrame:
    """(key, name): the rows of each key as an array of structs in order; a report's unit is its document."""
    struct = F.struct(F.struct(*order).alias("_order"), F.struct(*((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items())).alias("_row"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(struct)), lambda r: r["_row"]).alias(name))


def _parts(result: Analysis, provisions: DataFrame | None) -> DataFrame:
    """Clauses with their flags, provisions and notes gathered."""
    parts = result.clauses
    parts = parts.join(_gathered(result.flags, "clause_key", "riskFlags", ["category"], severity="severity", category="category"), "clause_key", "left")
    if result.matches is not None and provisions is not None:
        rows = result.matches.join(provisions.select("ord", "act", "provision", "heading", F.when(text.strip(F.coalesce("bare_act", F.lit(""))) != "", F.col("bare_act")).alias("bare_act")), "ord")
        parts = parts.join(_gathered(rows, "clause_key", "groundedIn", ["rank"], act="act", provision="provision", heading="heading", score=F.round("score", 4), method="method", bareAct="bare_act"), "clause_key", "left")
    else:
        parts = parts.withColumn("groundedIn", F.lit(None).cast("array<struct<act:string,provision:string,heading:string,score:double,method:string,bareAct:string>>"))
    return parts.join(_gathered(result.notes, "clause_key", "advice", ["headline", "body"], headline="headline", body="body", citations="citations"), "clause_key", "left")


def json_reports(result: Analysis, provisions: DataFrame | None = None) -> DataFrame:
    """(key, json): disclaimer, document, backends, stageMillis, counts, entities, the document's own flags and notes, and
    its clauses in order with flags, provisions and notes that cite. Null fields are left out. Flags and the document's
    notes are written without citations.

    Children are gathered per document, which is what a report is; documents are the unit of distribution.
    """
    key = result.key
    found = _gathered(result.entities, key, "entities", ["span_start", "entity_no"], type="entity_type", text="text", start="span_start", end="span_end", page="page", confidence="confidence")
    parts = _gathered(_parts(result, provisions), key, "clauses", ["span_start", "clause_no"], clause_id="clause_id", type="assigned_type", confidence=F.round("confidence", 4), runnerUp="runner_up", page="page", text="text", riskFlags="riskFlags", groundedIn="groundedIn", advice="advice")
    flags = _gathered(result.document_flags, key, "documentRiskFlags", ["category"], severity="severity", category="category")
    advice = _gathered(result.document_notes, key, "documentAdvice", ["headline", "body"], headline="headline", body="body")
    joined = result.documents.join(result.counts(), key, "left")
    for rows in (found, flags, advice, parts):
        joined = joined.join(rows, key, "left")
    about = F.struct(F.col(key).alias("id"), *[c for c in result.documents.columns if c not in (key, "text")], F.length("text").alias("char_count"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("clause_count", "risk_count", "entity_count")))
    fixed_part = (F.struct(*(F.lit(v).alias(k) for k, v in given.items())) for given in (result.backends, result.stage_millis))
    whole = F.struct(F.lit(DISCLAIMER).alias("disclaimer"), about.alias("document"), next(fixed_part).alias("backends"), next(fixed_part).alias("stageMillis"), "entities", "documentRiskFlags", "documentAdvice", "clauses")
    return joined.select(key, F.to_json(whole, {"pretty": "true"}).alias("json"))


def one_line(body: Column, budget: int) -> Column:
    """The text on one line, cut to the budget with dots."""
    flat = text.strip(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(flat) <= budget, flat).otherwise(F.concat(F.substring(flat, 1, budget - 3), F.lit("...")))


def key_terms(entities: DataFrame, key: str = "doc_id", most: int = 6) -> DataFrame:
    """(key, entity_type, terms): the first distinct texts of each type, in order, joined by `; `."""
    ordered = entities.where(F.col("entity_type").isNotNull() & F.col("text").isNotNull()).groupBy(key, "entity_type", "text").agg(F.min(F.struct("span_start", "entity_no")).alias("first"))
    gathered = ordered.groupBy(key, "entity_type").agg(F.array_sort(F.collect_list(F.struct("first", "text"))).alias("all"))
    return gathered.select(key, "entity_type", F.array_join(F.slice(F.transform("all", lambda e: e["text"]), 1, most), "; ").alias("terms"))


def text_reports(result: Analysis, provisions: DataFrame | None = None) -> DataFrame:
    """(key, report): a header with sizes, backends and timings, key terms, notes on the whole document, and each clause
    with its type, confidence, page, beginning, flags, provisions and notes."""
    key = result.key
    terms = key_terms(result.entities, key).groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), text.entity_label(F.col("entity_type")), F.lit(": "), F.col("terms")))), "\n").alias("terms"))
    flag = lambda f: F.concat(F.lit("    (!) "), text.severity_label(f["severity"]), F.lit(" "), f["category"])
    note = lambda n: F.concat(F.lit("    - "), n["headline"], F.lit("\n      "), one_line(n["body"], 500))
    law = lambda g: F.concat_ws(" ", g["act"], g["provision"], F.concat(F.lit("["), F.format_number(g["score"], 2), F.lit("]")))
    lines = lambda rows, each: F.when(F.size(rows) > 0, F.array_join(F.transform(rows, each), "\n"))
    sure = F.when(F.col("confidence") > 0, F.concat(F.lit(" ("), F.format_number("confidence", 2), F.lit(", "), F.col("method"), F.lit(")"))).otherwise("") if "method" in result.clauses.columns else F.lit("")
    block = F.concat_ws(
        "\n", F.concat(F.lit("["), F.col("clause_id"), F.lit("]  "), text.clause_label(F.col("assigned_type")), sure, F.lit("  p."), F.col("page").cast("string")),
        F.concat(F.lit("    "), one_line(F.col("text"), 300)), lines(F.col("riskFlags"), flag), F.when(F.size("groundedIn") > 0, F.concat(F.lit("    grounded in: "), F.array_join(F.transform("groundedIn", law), "; "))), lines(F.col("advice"), note),
    )
    made = _parts(result, provisions)
    typed = ~F.col("assigned_type").isin(fixed.UNCLASSIFIED, fixed.PREAMBLE)
    parts = made.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", "clause_no", block.alias("block")))), lambda c: c["block"]), "\n").alias("parts"),
        F.count_if(typed).alias("typed"), F.count_if(F.size("riskFlags") > 0).alias("risky"),
    )
    flags = _gathered(result.document_flags, key, "documentRiskFlags", ["category"], severity="severity", category="category")
    advice = _gathered(result.document_notes, key, "documentAdvice", ["headline", "body"], headline="headline", body="body")
    joined = result.documents
    for rows in (result.counts(), terms, flags, advice, parts):
        joined = joined.join(rows, key, "left")
    header = F.concat(F.lit("document "), F.col(key).cast("string"), F.lit("  characters: "), F.length("text").cast("string"), F.lit("  clauses: "), F.coalesce("clause_count", F.lit(0)).cast("string"), F.lit("  flags: "), F.coalesce("risk_count", F.lit(0)).cast("string"), F.lit("  entities: "), F.coalesce("entity_count", F.lit(0)).cast("string"))
    about = (F.lit(f"{name}: " + "  ".join(f"{k}={v}{unit}" for k, v in given.items())) for name, given, unit in (("backends", result.backends, ""), ("timings", result.stage_millis, "ms")))
    whole = F.when(F.size("documentRiskFlags") > 0, F.concat_ws("\n", F.lit("WHOLE-DOCUMENT NOTES"), lines(F.col("documentRiskFlags"), flag), lines(F.col("documentAdvice"), note)))
    counted = F.concat(F.lit("CLAUSES  ("), F.coalesce("typed", F.lit(0)).cast("string"), F.lit(" classified, "), F.coalesce("risky", F.lit(0)).cast("string"), F.lit(" with flags)"))
    return joined.select(key, F.concat_ws("\n", header, *about, F.lit("KEY TERMS"), F.coalesce("terms", F.lit("  none")), whole, counted, F.coalesce("parts", F.lit("  none")), F.lit(DISCLAIMER)).alias("report"))
