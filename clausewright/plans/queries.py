"""The queries over the data folder, one per operator of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausewright.functions import fixed, text
from clausewright.functions import vectors as V
from clausewright.operators import audit, classify, entities, library, notes, pipeline, retrieval, rules, segment, wordpiece
from clausewright.sources import files, reports
from clausewright.sources.tables import spread, table

#: Letters whose counts stand in for an encoder's vector.
LETTERS = "aehinorstd"
#: Rules and required types of the example queries; the engine itself has none built in.
RULES = [
    rules.Rule("RENEWAL", r"automatically|each anniversary", None, "LOW", "renews-by-itself"),
    rules.Rule("TERMINATION", r"for convenience", r"each party", "MEDIUM", "one-sided-exit"),
    rules.Rule(None, r"whether or not a dispute", None, "HIGH", "despite-a-dispute"),
]
REQUIRED = [("GOVERNING_LAW", "MEDIUM", "no-governing-law"), ("CONFIDENTIALITY", "LOW", "no-confidentiality")]
#: Notes that explain some clause types.
EXPLANATIONS = [("INDEMNITY", "One side makes good a loss of the other."), ("PAYMENT", "It says what is paid, when and how."), ("TERMINATION", "It says how the contract can end early.")]
CASES = [
    ("exchange-of-names", "1. SCOPE\nTarnby Foods Limited engages Morven Logistics LLP for the scope of services in each order.\n\nPayment of each invoice falls due in thirty days.", {"Tarnby": "Bellow", "Morven": "Quenby"}),
    ("exchange-of-meaning", "The Supplier shall indemnify and hold harmless the Client against all claims.", {"indemnify and hold harmless": "inform", "Client": "Buyer"}),
    ("exchange-of-people", "2. NOTICES\nMs. Ilvane Askellan is told in writing of each notice under this agreement, by registered post, before it takes effect.", {"Ms.": "Mr.", "Ilvane": "Rahim", "Askellan": "Okafor"}),
    ("firm-llp", "3. INDEMNITY\nYarlow Mills Private Limited shall indemnify and hold harmless the buyer against each claim of a third party.", {"Private Limited": "LLP"}),
    ("firm-trust", "4. CONFIDENTIALITY\nThe Dovrin Trust keeps all confidential and non-public information of the other side for five years.", {"Trust": "Inc."}),
    ("firm-town", "5. JURISDICTION\nThe courts at Silport shall have exclusive jurisdiction over Marthar Agro Corporation, whether or not a dispute is pending.", {"Silport": "Calville", "Corporation": "Company"}),
]


def contracts(spark: SparkSession, folder: str) -> DataFrame:
    """(contract_id, text) of every delivery. Work on the texts runs in the scan's stage; what repeated deliveries give
    is reduced in the results, so that whole texts are not shuffled only to find repetitions."""
    return spread(table(spark, folder, "contract_docs").select("contract_id", F.col("clean_text").alias("text")).where(F.col("text").isNotNull()))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_texts").select("contract_id", "page_no", "text").distinct()


def clauses(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per clause, the latest delivery; only the named columns are read and shuffled (all if none are named)."""
    named = columns or ("contract_id", "clause_type", "text", "span_start", "span_end")
    rows = table(spark, folder, "clauses").select("clause_uid", *named, "loaded_at")
    return library.latest(rows, ["clause_uid"], "loaded_at")


def normalized_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_texts").select("page_uid", text.normalize(F.col("text")).alias("text")).distinct()


def page_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return segment.page_starts(pages(spark, folder), "contract_id").select("contract_id", "page_no", "start_at")


def joined_pages(spark: SparkSession, folder: str) -> DataFrame:
    return segment.join_pages(pages(spark, folder), "contract_id")


def clause_pages(spark: SparkSession, folder: str) -> DataFrame:
    starts = segment.page_starts(pages(spark, folder), "contract_id")
    return segment.page_of(clauses(spark, folder, "contract_id", "span_start"), starts, "contract_id").select("clause_uid", "page")


def paragraph_spans(spark: SparkSession, folder: str) -> DataFrame:
    return segment.paragraphs(contracts(spark, folder), "contract_id").distinct()


def clause_segments(spark: SparkSession, folder: str) -> DataFrame:
    return segment.segment(contracts(spark, folder), "contract_id").drop("clause_no").distinct()


def rule_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return segment.sentences(contracts(spark, folder), "contract_id").distinct()


def classified_clauses(spark: SparkSession, folder: str) -> DataFrame:
    typed = classify.classify_by_cues(clauses(spark, folder, "text").withColumn("type", F.lit(fixed.UNCLASSIFIED)))
    return typed.select("clause_uid", "assigned_type", F.round("confidence", 6).alias("confidence"), "runner_up")


def segmented_and_classified(spark: SparkSession, folder: str) -> DataFrame:
    """The flagship: contract text to clauses to types, in the scan's stage."""
    typed = classify.classify_by_cues(segment.segment(contracts(spark, folder), "contract_id"))
    return typed.select("contract_id", "clause_id", "assigned_type", F.round("confidence", 6).alias("confidence"), "runner_up").distinct()


def extracted_entities(spark: SparkSession, folder: str) -> DataFrame:
    return entities.entities(contracts(spark, folder), "contract_id").distinct()


#: Rules that SQL can repeat (no lookahead in its patterns).
PLAIN_RULES = tuple(r for r in fixed.ENTITY_RULES if "(?=" not in r[1])


def entity_values(spark: SparkSession, folder: str) -> DataFrame:
    return entities.entities(contracts(spark, folder), "contract_id", rules=PLAIN_RULES).select("contract_id", "entity_type", "text").distinct()


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "provisions")
    return rows.select("ord", "clause_types", retrieval.search_text(F.col("heading"), F.col("summary"), F.col("bare_act"), F.col("topics")).alias("search_text"))


def bm25_scores(spark: SparkSession, folder: str) -> DataFrame:
    scores = retrieval.bm25(clauses(spark, folder, "text").where(F.col("text").isNotNull()), corpus(spark, folder), "clause_uid")
    return scores.select("clause_uid", "ord", F.round("score", 6).alias("score"))


def grounded_clauses(spark: SparkSession, folder: str) -> DataFrame:
    rows, held = clauses(spark, folder, "clause_type", "text"), corpus(spark, folder)
    scores = retrieval.bm25(rows.where(F.col("text").isNotNull()), held, "clause_uid")
    return retrieval.ground(rows, held, scores, "clause_uid", "clause_type").select("clause_uid", "rank", "ord", F.round("score", 6).alias("score"), "method")


def label_centroids(spark: SparkSession, folder: str) -> DataFrame:
    centres = classify.centroids(table(spark, folder, "embeddings"))
    return centres.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def nearest_labels(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    near = classify.nearest_centroid(vectors, classify.centroids(vectors), "vec_id")
    return near.select("vec_id", "best", F.round("score", 6).alias("score"), "runner_up", F.round("second_score", 6).alias("second_score"), "accepted")


def vector_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Every twentieth vector against all vectors: the three nearest others. The queries are the stated set; each of them
    meets the vectors in blocks and keeps its eight best, itself included, before anything is shuffled."""
    vectors = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("v")).where(F.col("v").isNotNull())
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("ord"), F.col("v").alias("embedding"))
    near = retrieval.best_matches(vectors.select(F.col("vec_id"), F.col("v").alias("embedding")), queries, "vec_id", most=8)
    ranked = near.where("ord <> vec_id").withColumn("score", F.round("score", 6)).withColumn("rank", F.row_number().over(Window.partitionBy("ord").orderBy(F.desc("score"), "vec_id")))
    return ranked.where("rank <= 3").select(F.col("ord").alias("query_id"), "rank", "vec_id", "score")


def text_vectors(rows: DataFrame, key: str, body: str = "text") -> DataFrame:
    """(key, embedding) by a stand-in for an encoder: the counts of some letters, of length one."""
    lowered = F.lower(F.coalesce(F.col(body), F.lit("")))
    counts = F.array(*((F.length(lowered) - F.length(F.replace(lowered, F.lit(c), F.lit("")))).cast("double") for c in LETTERS))
    return rows.select(key, V.unit(counts).alias("embedding"))


def provision_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return text_vectors(corpus(spark, folder), "ord", "search_text")


def vector_scores(spark: SparkSession, folder: str) -> DataFrame:
    """The five provisions whose vectors are nearest to each clause's."""
    rows = clauses(spark, folder, "text").where(F.col("text").isNotNull())
    scores = retrieval.cosine_scores(text_vectors(rows, "clause_uid"), provision_vectors(spark, folder), "clause_uid")
    rounded = scores.select("clause_uid", "ord", F.round("score", 6).alias("score"))
    ranked = rounded.withColumn("rank", F.row_number().over(Window.partitionBy("clause_uid").orderBy(F.desc("score"), "ord")))
    return ranked.where("rank <= 5").select("clause_uid", "rank", "ord", "score")


def hybrid_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Provisions by keywords, vectors and tags together."""
    rows, held = clauses(spark, folder, "clause_type", "text"), corpus(spark, folder)
    told = rows.where(F.col("text").isNotNull())
    by_vectors = retrieval.cosine_scores(text_vectors(told, "clause_uid"), provision_vectors(spark, folder), "clause_uid")
    found = retrieval.ground(rows, held, retrieval.bm25(told, held, "clause_uid"), "clause_uid", "clause_type", by_vectors)
    return found.select("clause_uid", "rank", "ord", F.round("score", 6).alias("score"), "method")


def ensemble_types(spark: SparkSession, folder: str) -> DataFrame:
    """Clause types by the cosine to the mean vector of each type's cues and by the cues' scores."""
    rows = clauses(spark, folder, "text").where(F.col("text").isNotNull())
    cues = spark.createDataFrame([(kind, cue) for kind, weighted in fixed.CUES.items() for cue, _ in weighted], "label string, text string")
    centres = classify.centroids(text_vectors(cues, "label"))
    held = centres.select(F.col("label").alias("ord"), F.col("centroid").alias("embedding"))
    cosines = retrieval.cosine_scores(text_vectors(rows, "clause_uid"), held, "clause_uid").select("clause_uid", F.col("ord").alias("type"), F.round("score", 9).alias("cosine"))
    keywords = rows.select("clause_uid", F.explode(classify.cue_scores(F.lower("text"))).alias("s")).select("clause_uid", F.col("s.type").alias("type"), (-F.col("s.less")).alias("score"))
    return classify.ensemble(cosines, keywords, "clause_uid").withColumn("confidence", F.round("confidence", 6))


def clause_flags(spark: SparkSession, folder: str) -> DataFrame:
    return rules.flags(clauses(spark, folder, "clause_type", "text"), RULES, ["clause_uid"], "clause_type")


def clause_notes(spark: SparkSession, folder: str) -> DataFrame:
    """A note for each flag, with the best provision of the clause."""
    rows = clauses(spark, folder, "clause_type", "text")
    flagged = rules.flags(rows, RULES, ["clause_uid"], "clause_type").join(rows.select("clause_uid", "text"), "clause_uid").withColumn("rationale", F.concat(F.lit("Found by the rule "), F.col("category"), F.lit(".")))
    held = table(spark, folder, "provisions").select("ord", "act", "provision", "summary")
    made = notes.flag_notes(flagged, grounded_clauses(spark, folder).join(held, "ord"), ["clause_uid"])
    return made.select("clause_uid", "headline", "body", F.size("citations").alias("citations"))


def missing_clause_types(spark: SparkSession, folder: str) -> DataFrame:
    return rules.missing_types(clauses(spark, folder, "contract_id", "clause_type"), REQUIRED, "contract_id", "clause_type")


def contract_severity(spark: SparkSession, folder: str) -> DataFrame:
    return rules.top_severity(spark, rules.flags(clauses(spark, folder, "contract_id", "clause_type", "text"), RULES, ["contract_id"], "clause_type"), "contract_id")


def notice_days(spark: SparkSession, folder: str) -> DataFrame:
    """The longest period in days that each clause names."""
    rows = clauses(spark, folder, "text").where(F.col("text").isNotNull())
    return rows.select("clause_uid", rules.greatest_number(F.col("text"), r"(?i)(\d{1,3})\s*(?:\(\d{1,3}\)\s*)?days").alias("days"))


def sentences_in_clauses(spark: SparkSession, folder: str) -> DataFrame:
    points = table(spark, folder, "sentences").select("sent_uid", "contract_id", F.col("span_start").alias("at")).distinct()
    spans = clauses(spark, folder, "contract_id", "span_start", "span_end").drop("loaded_at")
    return rules.within(points, spans, "contract_id").select("sent_uid", "clause_uid").distinct()


def library_entries(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "library_entries").select("id", "display_name", "analyzed_at_epoch_millis", "clause_count", "risk_count", "entity_count", "highest_severity", "content_hash")
    return rows.distinct()


def library_listed(spark: SparkSession, folder: str) -> DataFrame:
    return library.listed(library_entries(spark, folder)).select("id", "display_name", "analyzed_at_epoch_millis")


def library_search(spark: SparkSession, folder: str) -> DataFrame:
    return library.search(library_entries(spark, folder), "Agreement").select("id", "display_name")


def library_newest(spark: SparkSession, folder: str) -> DataFrame:
    return library.newest_by_hash(library_entries(spark, folder))


def unseen_contracts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "contract_docs").select("contract_id", "content_hash").distinct()
    return library.unseen(rows, library_entries(spark, folder))


def content_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Contracts by the hash of their text: how many share it, and the least id."""
    hashed = contracts(spark, folder).select("contract_id", library.content_hash(F.encode("text", "UTF-8")).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count_distinct("contract_id").alias("copies"), F.min("contract_id").alias("first_id"))


def latest_clauses(spark: SparkSession, folder: str) -> DataFrame:
    return clauses(spark, folder, "clause_type").select("clause_uid", "clause_type", F.unix_micros("loaded_at").alias("loaded_micros"))


def clause_display(spark: SparkSession, folder: str) -> DataFrame:
    body = F.col("text")
    return clauses(spark, folder, "clause_type", "text").select("clause_uid", text.clause_label(F.col("clause_type")).alias("label"), text.truncate(body, 120).alias("short"), text.first_sentence(body).alias("first_sentence"))


def entity_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities")
    return rows.groupBy(text.entity_label(F.col("entity_type")).alias("label")).agg(F.count_distinct("entity_uid").alias("n"))


def supported_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each provision's summary invents nothing beside the next provision's wording."""
    rows = table(spark, folder, "provisions")
    other = rows.select((F.col("ord") + 1).alias("ord"), F.concat_ws(" ", "summary", "bare_act").alias("source"))
    own = F.concat_ws(" ", "summary", "bare_act")
    joined = rows.join(other, "ord")
    return joined.select("ord", text.supported(F.col("summary"), own, F.col("provision"), F.col("heading")).alias("by_itself"), text.supported(F.col("summary"), F.col("source"), F.col("provision"), F.col("heading")).alias("by_other"))


def counterfactual_audit(spark: SparkSession, folder: str) -> DataFrame:
    cases = spark.createDataFrame(CASES, "name string, base_text string, substitutions map<string,string>")
    typed = lambda texts: classify.classify_by_cues(texts, given=None).where(F.col("assigned_type") != fixed.UNCLASSIFIED).select("name", "variant", F.concat(F.lit("clause:"), F.col("assigned_type")).alias("signal"))
    found = audit.audit(cases, typed)
    return found.select("name", "variant", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "stable")


def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How many cases stay as they are under each exchange, flags included."""
    cases = spark.createDataFrame(CASES, "name string, base_text string, substitutions map<string,string>")
    flagged = lambda c: rules.flags(c, RULES, ["name", "variant"])
    return audit.summary(audit.audit(cases, lambda texts: audit.signals(texts, classify.classify_by_cues, flagged)))


def contract_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").select("contract_id", "entity_type", "text", "span_start", F.col("entity_uid").alias("entity_no"))
    return reports.key_terms(rows, "contract_id")


def upload_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "contract_docs").select("contract_id", "source_path", F.length("clean_text").alias("size")).distinct()
    return rows.select("contract_id", files.media_type(F.coalesce("source_path", F.lit(""))).alias("media_type"), files.reason(F.col("source_path"), F.col("size")).alias("reason")).distinct()


def sentence_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page that each stored sentence begins on."""
    rows = table(spark, folder, "sentences").select("sent_uid", "contract_id", "span_start").distinct()
    starts = segment.page_starts(pages(spark, folder), "contract_id")
    return segment.page_of(rows, starts, "contract_id").select("sent_uid", "page")


def clause_sentence_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The page of each clause by the sentence it begins in."""
    rows = table(spark, folder, "sentences").select("sent_uid", "contract_id", "span_start").distinct()
    told = segment.page_of(rows, segment.page_starts(pages(spark, folder), "contract_id"), "contract_id")
    return segment.page_by_sentence(clauses(spark, folder, "contract_id", "span_start"), told, "contract_id").select("clause_uid", "page")


def explanations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EXPLANATIONS, "type string, body string")


def explained_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """The note that explains each clause of a known type."""
    made = notes.explainers(clauses(spark, folder, "clause_type", "text").where(F.col("text").isNotNull()), explanations(spark), ["clause_uid"], "clause_type")
    return made.select("clause_uid", "headline", "body", F.col("citations")[0]["wording"].alias("cited"))


def document_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes on what a contract as a whole lacks, citing its first clause."""
    rows = clauses(spark, folder)
    missing = rules.missing_types(rows, REQUIRED, "contract_id", "clause_type").withColumn("rationale", F.concat(F.lit("Found by the rule "), F.col("category"), F.lit(".")))
    first = rules.first_clauses(rows.select("contract_id", "span_start", "clause_uid", "text"), "contract_id", "clause_uid")
    return notes.document_notes(missing, first, "contract_id").select("contract_id", "headline", "body", F.col("citations")[0]["wording"].alias("cited"))


def rephrase_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """What a rephrasing stage would be given for each flag, and what its answer is checked against."""
    rows = clauses(spark, folder, "clause_type", "text")
    flagged = rules.flags(rows, RULES, ["clause_uid"], "clause_type").join(rows.select("clause_uid", F.col("text").alias("clause")), "clause_uid")
    law = table(spark, folder, "provisions").select("ord", F.concat(F.col("act"), F.lit(", "), F.col("provision"), F.lit(": "), F.col("summary")).alias("law"))
    best = grounded_clauses(spark, folder).where("rank = 1").join(law, "ord").select("clause_uid", F.array("law").alias("provisions"))
    asked = notes.prompts(flagged.withColumn("body", F.concat(F.lit("Found by the rule "), F.col("category"), F.lit("."))).join(best, "clause_uid", "left"))
    return asked.select("clause_uid", "category", F.length("prompt").alias("prompt_length"), "allowed", "source")


def contract_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Clauses, flags and entities of each contract."""
    rows = clauses(spark, folder)
    found = library.latest(table(spark, folder, "entities").select("entity_uid", "contract_id", "loaded_at"), ["entity_uid"], "loaded_at")
    return rules.counts(rows, rules.flags(rows, RULES, ["contract_id"], "clause_type"), found, "contract_id")


def contract_flags(spark: SparkSession, folder: str) -> DataFrame:
    """What was found in clauses, and what the contract as a whole lacks."""
    rows = clauses(spark, folder)
    return rules.united(rules.flags(rows, RULES, ["contract_id"], "clause_type"), rules.missing_types(rows, REQUIRED, "contract_id", "clause_type"), "contract_id", ["severity", "category"]).distinct()


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Display labels of the flags of each clause."""
    flagged = rules.flags(clauses(spark, folder, "clause_type", "text"), RULES, ["clause_uid"], "clause_type")
    return flagged.select("clause_uid", "category", text.category_label(F.col("category")).alias("category_label"), text.severity_label(F.col("severity")).alias("severity_label"))


def match_labels(spark: SparkSession, folder: str) -> DataFrame:
    found = grounded_clauses(spark, folder).unionByName(hybrid_grounding(spark, folder))
    return found.groupBy(text.method_label(F.col("method")).alias("label")).agg(F.count("*").alias("n"))


def confidence_hints(spark: SparkSession, folder: str) -> DataFrame:
    """Confidences as they are shown: within 0 and 1, low ones marked."""
    rows = library.latest(table(spark, folder, "entities").select("entity_uid", "confidence", "loaded_at"), ["entity_uid"], "loaded_at")
    return rows.select("entity_uid", text.clamped(F.col("confidence")).alias("shown"), text.is_low(F.col("confidence")).alias("low"))


def library_found_of(spark: SparkSession, folder: str) -> DataFrame:
    """How many entries a search finds, of how many."""
    return library.found_of(library_entries(spark, folder), "Agreement")


def masked_means(spark: SparkSession, folder: str) -> DataFrame:
    """Mean vectors of the letters of each provision's heading, blanks masked out."""
    rows = table(spark, folder, "provisions").select("ord", F.split(F.lower("heading"), "").alias("letters")).withColumn("letters", F.filter("letters", lambda c: c != ""))
    each = rows.select("ord", F.transform("letters", lambda c: F.array(F.ascii(c).cast("double"), F.lit(1.0))).alias("states"), F.transform("letters", lambda c: (c != " ").cast("int")).alias("mask"))
    return each.select("ord", F.round(V.masked_mean(F.col("states"), F.col("mask"))[0], 6).alias("x"), F.round(V.masked_mean(F.col("states"), F.col("mask"))[1], 6).alias("y"))


def vocabulary(most: int = 400) -> dict[str, int]:
    """A small vocabulary: the words of the fixed values, letters, and letters that go on."""
    words = [w for weighted in fixed.CUES.values() for cue, _ in weighted for w in cue.split() if w.isalpha()] + list(fixed.STOP_WORDS)
    letters = [chr(c) for c in range(97, 123)]
    every = [wordpiece.CLS, wordpiece.SEP, wordpiece.UNKNOWN, *dict.fromkeys([*words, *letters, *("##" + c for c in letters), "."])]
    return {piece: n for n, piece in enumerate(every[:most])}


def word_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The word pieces of every document by a small vocabulary, cut to 256."""
    return wordpiece.encode(table(spark, folder, "documents"), "doc_id", "text", vocabulary()).select("doc_id", "ids")


def known_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each cue word, with the letters that follow where the word is not known."""
    rows = spark.createDataFrame([(kind, w) for kind in fixed.CLAUSE_TYPES for w in kind.lower().split("_")], "kind string, word string").distinct()
    back = {n: piece for piece, n in vocabulary().items()}
    named = F.create_map(*[F.lit(x) for pair in back.items() for x in pair])
    ids = wordpiece.encode(rows.select("word").distinct(), "word", "word", vocabulary())
    return ids.select("word", F.array_join(F.transform("ids", lambda i: named[i.cast("int")]), " ").alias("pieces"))


def analysis(spark: SparkSession, folder: str) -> pipeline.Analysis:
    """The whole pipeline over the pages."""
    return pipeline.analyse(pages(spark, folder), table(spark, folder, "provisions"), "contract_id", flagging=RULES, required=REQUIRED, explanations=explanations(spark))


def json_documents(spark: SparkSession, folder: str) -> DataFrame:
    return reports.json_reports(analysis(spark, folder), table(spark, folder, "provisions"))


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    return reports.text_reports(analysis(spark, folder), table(spark, folder, "provisions"))


def json_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What the JSON documents say of each contract, read back from them."""
    kinds = "document struct<char_count:int, clause_count:int, risk_count:int, entity_count:int>, backends map<string,string>, documentRiskFlags array<struct<category:string>>, documentAdvice array<struct<headline:string>>, clauses array<struct<clause_id:string, type:string, page:int, riskFlags:array<struct<category:string>>, groundedIn:array<struct<act:string>>, advice:array<struct<headline:string, citations:array<struct<kind:string>>>>>>"
    read = json_documents(spark, folder).select("contract_id", F.from_json("json", kinds).alias("j"))
    none = lambda rows: F.coalesce(F.size(rows), F.lit(0))
    each = F.col("j.clauses")
    return read.select(
        "contract_id", "j.document.char_count", "j.document.clause_count", "j.document.risk_count", F.array_join(F.transform(each, lambda c: F.concat_ws(":", c["clause_id"], c["type"])), ",").alias("clauses"),
        F.array_join(F.transform("j.documentRiskFlags", lambda f: f["category"]), ",").alias("lacking"), none(F.col("j.documentAdvice")).alias("document_notes"),
        F.aggregate(F.coalesce(each, F.array().cast("array<struct<clause_id:string,type:string,page:int,riskFlags:array<struct<category:string>>,groundedIn:array<struct<act:string>>,advice:array<struct<headline:string,citations:array<struct<kind:string>>>>>>")), F.lit(0), lambda s, c: s + F.coalesce(F.size(c["advice"]), F.lit(0))).alias("notes"), F.col("j.backends")["grounding"].alias("grounding"),
    )


def text_heads(spark: SparkSession, folder: str) -> DataFrame:
    """The heads of the clauses in the text documents."""
    return text_documents(spark, folder).select("contract_id", F.array_join(F.regexp_extract_all("report", F.lit(r"(?m)^\[([a-z]+-\d+)\]  "), 1), ",").alias("clauses"), F.regexp_extract("report", r"CLAUSES  \((\d+) classified", 1).cast("int").alias("classified"))


QUERIES = {
    "segmented_and_classified": segmented_and_classified,
    "normalized_pages": normalized_pages,
    "page_offsets": page_offsets,
    "joined_pages": joined_pages,
    "clause_pages": clause_pages,
    "paragraph_spans": paragraph_spans,
    "clause_segments": clause_segments,
    "rule_sentences": rule_sentences,
    "classified_clauses": classified_clauses,
    "extracted_entities": extracted_entities,
    "entity_values": entity_values,
    "bm25_scores": bm25_scores,
    "grounded_clauses": grounded_clauses,
    "label_centroids": label_centroids,
    "nearest_labels": nearest_labels,
    "vector_matches": vector_matches,
    "ensemble_types": ensemble_types,
    "vector_scores": vector_scores,
    "hybrid_grounding": hybrid_grounding,
    "clause_flags": clause_flags,
    "clause_notes": clause_notes,
    "missing_clause_types": missing_clause_types,
    "contract_severity": contract_severity,
    "notice_days": notice_days,
    "sentences_in_clauses": sentences_in_clauses,
    "library_listed": library_listed,
    "library_search": library_search,
    "library_newest": library_newest,
    "unseen_contracts": unseen_contracts,
    "content_copies": content_copies,
    "latest_clauses": latest_clauses,
    "clause_display": clause_display,
    "entity_labels": entity_labels,
    "supported_notes": supported_notes,
    "counterfactual_audit": counterfactual_audit,
    "audit_summary": audit_summary,
    "contract_terms": contract_terms,
    "upload_reasons": upload_reasons,
    "sentence_pages": sentence_pages,
    "clause_sentence_pages": clause_sentence_pages,
    "explained_clauses": explained_clauses,
    "document_notes": document_notes,
    "rephrase_prompts": rephrase_prompts,
    "contract_counts": contract_counts,
    "contract_flags": contract_flags,
    "labels": labels,
    "match_labels": match_labels,
    "confidence_hints": confidence_hints,
    "library_found_of": library_found_of,
    "masked_means": masked_means,
    "word_pieces": word_pieces,
    "known_pieces": known_pieces,
    "json_fields": json_fields,
    "text_heads": text_heads,
    "json_documents": json_documents,
    "text_documents": text_documents,
}
