"""The whole analysis as one lazy bundle of DataFrames over many documents."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewright.operators import classify, entities, notes, retrieval, rules, segment

STAGES = ("ingestion", "extraction", "grounding", "advisory")
Stage = Callable[..., DataFrame]


@dataclass
class Analysis:
    """What the stages made; nothing runs before a sink asks for rows."""

    documents: DataFrame
    clauses: DataFrame
    entities: DataFrame
    matches: DataFrame | None
    flags: DataFrame
    document_flags: DataFrame
    notes: DataFrame
    document_notes: DataFrame
    backends: dict[str, str]
    key: str
    stage_millis: dict[str, int] = field(default_factory=dict)

    def counts(self) -> DataFrame:
        """Clauses, flags and entities of each document."""
        return rules.counts(self.clauses, self.all_flags(), self.entities, self.key)

    def all_flags(self) -> DataFrame:
        return rules.united(self.flags, self.document_flags, self.key, ["severity", "category"])

    def all_notes(self) -> DataFrame:
        return rules.united(self.notes, self.document_notes, self.key, ["headline", "body", "citations"])


def analyse(
    pages: DataFrame, provisions: DataFrame | None = None, key: str = "doc_id", listener: Callable[[str], None] | None = None, *,
    flagging: list[rules.Rule] | None = None, required: list[tuple[str, str, str]] | None = None, explanations: DataFrame | None = None,
    splitter: Stage | None = None, classifier: Stage | None = None, extractor: Stage | None = None, retriever: Stage | None = None, rephrase: Stage | None = None, encoder: Stage | None = None, seeds: DataFrame | None = None,
) -> Analysis:
    """Pages (key, page_no, text) to documents, typed clauses with their pages, entities, supporting provisions, flags and notes.

    flagging, required and explanations (type, body) are given; without them there are no flags or explaining notes. Any
    stage may be replaced: splitter(documents, key) makes sentences, classifier(clauses) adds assigned_type, confidence
    and runner_up, extractor(documents, key) makes entities, retriever(clauses, provisions, key, type) makes (clause_key, rank, ord, score, method),
    rephrase(notes) proposes (clause_key, headline, candidate) from `prompt`. encoder(rows, key, text) makes (key, embedding): provisions
    are then ranked by keywords and vectors together, and with seeds (label, text) clauses are typed by both.

    A listener hears of each planned stage in order; what it raises is logged and otherwise ignored. The millis are those
    of planning: rows are made when a sink asks for them.
    """
    millis: dict[str, int] = {}
    began = time.time()

    def done(stage: str) -> None:
        nonlocal began
        millis[stage] = int((time.time() - began) * 1000)
        began = time.time()
        if listener:
            try:
                listener(stage)
            except Exception:
                logging.getLogger(__name__).warning("a stage listener failed at %s", stage, exc_info=True)

    starts = segment.page_starts(pages, key).select(key, "page_no", "start_at")
    documents = segment.join_pages(pages, key)
    sentences = segment.page_of((splitter or segment.sentences)(documents, key), starts, key)
    done("ingestion")
    parts = segment.page_by_sentence(segment.segment(documents, key), sentences, key).withColumn("clause_key", F.concat_ws("/", F.col(key).cast("string"), "clause_id"))
    both = classifier is None and encoder is not None and seeds is not None
    clauses = classify.classify_by_both(parts, "clause_key", encoder, seeds) if both else (classifier or classify.classify_by_cues)(parts)
    found = segment.page_by_sentence((extractor or entities.entities)(documents, key), sentences, key)
    flagged = rules.flags(clauses, flagging or [rules.NEVER], [key, "clause_key"])
    missing = rules.missing_types(clauses, required or [], key) if required else documents.where("false").select(key, *(F.lit(None).cast("string").alias(c) for c in ("type", "severity", "category")))
    done("extraction")
    matches, method = None, "none"
    if provisions is not None:
        corpus = provisions.select("ord", "clause_types", retrieval.search_text(F.col("heading"), F.col("summary"), F.col("bare_act"), F.col("topics")).alias("search_text"))
        queries = clauses.select("clause_key", F.col("assigned_type").alias("kind"), "text")
        method = "given" if retriever else "hybrid" if encoder else "bm25"
        if retriever:
            matches = retriever(queries, provisions, "clause_key", "kind")
        else:
            by_vectors = retrieval.cosine_scores(encoder(queries, "clause_key", "text"), encoder(corpus, "ord", "search_text"), "clause_key") if encoder else None
            matches = retrieval.ground(queries, corpus, retrieval.bm25(queries, corpus, "clause_key"), "clause_key", "kind", by_vectors)
    done("grounding")
    reasons = F.concat(F.lit("Found by the rule "), F.col("category"), F.lit("."))
    held = clauses.select("clause_key", "text")
    told = flagged.join(held, "clause_key").withColumn("rationale", reasons)
    if matches is not None:
        best = matches.where("rank = 1").join(provisions.select("ord", "act", "provision", "summary"), "ord").select("clause_key", "rank", "act", "provision", "summary")
    else:
        best = clauses.where("false").select("clause_key", F.lit(1).alias("rank"), *(F.lit(None).cast("string").alias(c) for c in ("act", "provision", "summary")))
    made = notes.flag_notes(told, best, ["clause_key"])
    if explanations is not None:
        made = notes.explainers(clauses, explanations, ["clause_key"]).unionByName(made)
    if rephrase:
        law = best.groupBy("clause_key").agg(F.collect_list(F.concat_ws(", ", "act", "provision", "summary")).alias("provisions"))
        asked = notes.prompts(made.join(held.withColumnRenamed("text", "clause"), "clause_key").join(law, "clause_key", "left"))
        made = notes.rephrased(asked, rephrase, ["clause_key", "headline"]).select("clause_key", "headline", "body", "citations")
    made = made.join(clauses.select(key, "clause_key"), "clause_key").select(key, "clause_key", "headline", "body", "citations")
    of_document = notes.document_notes(missing.withColumn("rationale", reasons), rules.first_clauses(clauses.select(key, "span_start", "text"), key), key)
    done("advisory")
    backends = {"extraction": "given" if classifier else classify.backend(both), "grounding": method, "advisory": "rephrased" if rephrase else "templates"}
    return Analysis(documents, clauses, found, matches, flagged, missing, made, of_document, backends, key, millis)
