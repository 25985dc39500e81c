import json

import pytest
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.operators import audit, classify, entities, library, notes, pipeline, retrieval, rules, segment, wordpiece
from clausewright.sources import files, reports

TEXT = "Preamble " * 12 + "\n\n1. PAYMENT TERMS\n\nEach invoice is payable within 30 days.\n\n2. INDEMNITY\n\nThe Supplier shall indemnify and hold harmless the Client."


def docs(spark, *texts):
    return spark.createDataFrame([(n, t, "extra") for n, t in enumerate(texts)], "doc_id int, text string, key string")


def test_segment(spark):
    rows = segment.segment(docs(spark, TEXT, None, "", "  \n ", "no heading here but a paragraph that is long enough to keep\n\nshort")).collect()
    assert [(r.doc_id, r.clause_id, r.type) for r in rows] == [(0, "clause-0", "PREAMBLE"), (0, "clause-1", "UNCLASSIFIED"), (0, "clause-2", "UNCLASSIFIED"), (4, "para-1", "UNCLASSIFIED")]
    for r in rows[:3]:
        assert TEXT[r.span_start : r.span_end].strip() == r.text


def test_title_case_is_no_heading(spark):
    assert segment.segment(docs(spark, "1. Indemnity\n\nThe Supplier shall indemnify the Client for all of it.")).first().clause_id == "para-1"


def test_paragraphs_and_sentences(spark):
    body = "Acme Pvt. Ltd. pays. It pays Rs. 5 now!\n \nEnd"
    spans = [(r.span_start, r.span_end) for r in segment.paragraphs(docs(spark, body)).collect()]
    assert [body[a:b] for a, b in spans] == ["Acme Pvt. Ltd. pays. It pays Rs. 5 now!", "End"]
    assert [r.text for r in segment.sentences(docs(spark, body)).collect()] == ["Acme Pvt. Ltd. pays.", "It pays Rs. 5 now!", "End"]


def test_pages(spark):
    pages = spark.createDataFrame([(1, 2, "b" * 150), (1, 1, "a" * 98), (1, 3, None)], "doc_id int, page_no int, text string")
    starts = segment.page_starts(pages)
    assert sorted((r.page_no, r.start_at) for r in starts.collect()) == [(1, 0), (2, 100), (3, 252)]
    spans = spark.createDataFrame([(1, at) for at in (0, 99, 100, 251, 252, 999)] + [(2, 5)], "doc_id int, span_start int")
    got = {(r.doc_id, r.span_start): r.page for r in segment.page_of(spans, starts).collect()}
    assert got == {(1, 0): 1, (1, 99): 1, (1, 100): 2, (1, 251): 2, (1, 252): 3, (1, 999): 3, (2, 5): 0}
    assert segment.join_pages(pages).head().text == "a" * 98 + "\n\n" + "b" * 150


def test_classify(spark):
    rows = spark.createDataFrame([(1, "we indemnify", "X"), (2, "fees", "PREAMBLE"), (3, "entire agreement; amendment", "X"), (4, None, "X"), (5, "gst", "X")], "id int, text string, type string")
    got = {r.id: (r.assigned_type, r.confidence, r.runner_up) for r in classify.classify_by_cues(rows).collect()}
    assert got[1] == ("INDEMNITY", 0.5, None)
    assert got[2] == ("PAYMENT", 2 / 6, None)
    assert got[3] == ("ENTIRE_AGREEMENT", 0.5, "AMENDMENT")
    assert got[4] == ("UNCLASSIFIED", 0.0, None)
    assert got[5] == ("UNCLASSIFIED", 0.0, "PAYMENT")


def test_preamble_stays_if_nothing_is_found(spark):
    assert classify.classify_by_cues(spark.createDataFrame([("x", "PREAMBLE")], "text string, type string")).head().assigned_type == "PREAMBLE"


@pytest.mark.parametrize("block", [10_000, 1])
def test_centroids(spark, monkeypatch, block):
    monkeypatch.setattr(classify, "BLOCK_LABELS", block)
    seeds = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), (None, [1.0, 1.0]), ("b", None)], "label string, embedding array<float>")
    centres = classify.centroids(seeds)
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.7071, 0.7071]), (3, None)], "id int, embedding array<float>")
    got = {r.id: (r.best, r.runner_up, r.accepted) for r in classify.nearest_centroid(items, centres, "id").collect()}
    assert got == {1: ("a", "b", True), 2: ("a", "b", False)}


def test_ensemble(spark):
    cosines = spark.createDataFrame([(1, "A", 0.9), (1, "B", 0.2), (2, "A", 0.3)], "id int, type string, cosine double")
    keywords = spark.createDataFrame([(1, "B", 3.0)], "id int, type string, score double")
    got = {r.id: (r.assigned_type, round(r.confidence, 3), r.runner_up) for r in classify.ensemble(cosines, keywords, "id").collect()}
    assert got == {1: ("A", 0.54, "B"), 2: ("UNCLASSIFIED", 0.18, "A")}


def test_entities(spark):
    body = 'between Acme Foods Private Limited ("Supplier") and for Bolt LLP. Fee: INR 4,00,000. Rupees Five Lakh. On 1 April 2025. governed by the laws of India. courts at Pune shall have exclusive jurisdiction. 30 days prior written notice. (“x”) INR 4,00,000'
    rows = entities.entities(docs(spark, body, None)).collect()
    got = {(r.entity_type, r.text) for r in rows}
    assert {("PARTY", "Supplier"), ("PARTY", "Acme Foods Private Limited"), ("PARTY", "Bolt LLP"), ("MONETARY_VALUE", "INR 4,00,000"), ("MONETARY_VALUE", "Rupees F"), ("EFFECTIVE_DATE", "1 April 2025"), ("GOVERNING_LAW", "India"), ("JURISDICTION", "Pune"), ("NOTICE_PERIOD", "30 days prior written notice")} >= got
    assert len(got) == len(rows) >= 8


def test_grounding(spark):
    corpus = spark.createDataFrame([(0, ["INDEMNITY"], "indemnity loss promise"), (1, [], "interest on payment"), (2, ["INDEMNITY"], "nothing shared")], "ord int, clause_types array<string>, search_text string")
    clauses = spark.createDataFrame([("a", "INDEMNITY", "a promise of indemnity"), ("b", None, "interest payment interest"), ("c", "UNCLASSIFIED", "unknown words"), ("d", "INDEMNITY", " ")], "k string, type string, text string")
    got = [(r.k, r["rank"], r.ord, round(r.score, 2)) for r in retrieval.ground(clauses, corpus, retrieval.bm25(clauses, corpus, "k"), "k").orderBy("k", "rank").collect()]
    assert got == [("a", 1, 0, 1.0), ("a", 2, 2, 0.55), ("b", 1, 1, 0.75)]


@pytest.mark.parametrize("block", [10_000, 1])
def test_hybrid_grounding(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "BLOCK_PROVISIONS", block)
    corpus = spark.createDataFrame([(0, [], "alpha beta", [1.0, 0.0]), (1, ["X"], "gamma", [0.0, 1.0])], "ord int, clause_types array<string>, search_text string, embedding array<float>")
    clauses = spark.createDataFrame([("a", "X", "alpha", [0.0, 1.0])], "k string, type string, text string, embedding array<float>")
    near = retrieval.cosine_scores(clauses, corpus, "k")
    got = retrieval.ground(clauses, corpus, retrieval.bm25(clauses, corpus, "k"), "k", vectors_scores=near)
    assert [(r.ord, round(r.score, 2), r.method) for r in got.orderBy("rank").collect()] == [(1, 0.85, "hybrid"), (0, 0.45, "hybrid")]


def test_rules(spark):
    clauses = spark.createDataFrame([(1, "a", "TERMINATION", "for convenience"), (1, "b", "TERMINATION", "for convenience by each party"), (2, "c", "X", "no limit, 45 (45) days or 9 days")], "doc int, id string, assigned_type string, text string")
    made = rules.flags(clauses, [rules.Rule("TERMINATION", "for CONVENIENCE", "each party", "MEDIUM", "exit")], ["doc", "id"])
    assert [(r.id, r.category) for r in made.collect()] == [("a", "exit")]
    missing = rules.missing_types(clauses, [("X", "LOW", "no-x"), ("Y", "HIGH", "no-y")], "doc")
    assert sorted((r.doc, r.category) for r in missing.collect()) == [(1, "no-x"), (1, "no-y"), (2, "no-y")]
    assert {r.doc: r.severity for r in rules.top_severity(spark, missing, "doc").collect()} == {1: "HIGH", 2: "HIGH"}
    days = clauses.select("id", rules.greatest_number(F.col("text"), r"(\d+) days").alias("n")).collect()
    assert {r.id: r.n for r in days} == {"a": 0, "b": 0, "c": 9}


def test_notes_always_cite(spark):
    flagged = spark.createDataFrame([(1, "HIGH", "no-cap", "There is no cap.", "clause text"), (2, "LOW", "x", "Why.", "t")], "id int, severity string, category string, rationale string, text string")
    matches = spark.createDataFrame([(1, 1, "Act", "Section 1", "Summary.")], "id int, rank int, act string, provision string, summary string")
    got = {r.id: r for r in notes.flag_notes(flagged, matches, ["id"]).collect()}
    assert got[1].headline == "High-priority point: No cap" and len(got[1].citations) == 2 and "Related law - Act, Section 1: Summary." in got[1].body
    assert len(got[2].citations) == 1


def test_rephrasing_falls_back(spark):
    rows = spark.createDataFrame([(1, "The note as it was.", "30 days", "Section 2")], "id int, body string, source string, allowed string")
    bad = notes.rephrased(rows, lambda n: n.select("id", F.lit("It now says that 99 days are needed for a notice of any kind.").alias("candidate")), ["id"]).head()
    assert bad.body == "The note as it was." and not bad.accepted


def test_audit(spark):
    cases = spark.createDataFrame([("n", "we indemnify Asha", {"Asha": "Ravi", "indemnify": "thank"}), ("none", "x", None)], "name string, base_text string, substitutions map<string,string>")
    signal = lambda t: classify.classify_by_cues(t, given=None).where("assigned_type <> 'UNCLASSIFIED'").select("name", "variant", F.col("assigned_type").alias("signal"))
    results = audit.audit(cases, signal)
    assert {r.variant: (r.stable, r.removed) for r in results.collect()} == {"Asha -> Ravi": (True, []), "indemnify -> thank": (False, ["INDEMNITY"])}
    assert "CHANGED" in audit.report(results).head().line
    assert {r.name: r.text for r in audit.all_at_once(cases).collect()}["n"] == "we thank Ravi"


def test_library(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path / "lib"))
    assert lib.read() is None and not lib.delete("x") and lib.resubmit("h", 1) is None
    rows = spark.createDataFrame([("a", "Lease", 1, "h1"), ("b", "Loan", 2, "h1"), ("c", "Other", 3, None)], "id string, display_name string, analyzed_at_epoch_millis long, content_hash string")
    lib.save(rows)
    lib.save(rows.where("id = 'a'").withColumn("display_name", F.lit("Lease 2")))
    assert [r.id for r in library.listed(lib.read()).collect()] == ["c", "b", "a"]
    assert [r.id for r in library.search(lib.read(), " LEASE ").collect()] == ["a"] and library.search(lib.read(), None).count() == 3
    assert [(r.content_hash, r.id) for r in library.newest_by_hash(lib.read()).collect()] == [("h1", "b")]
    assert lib.resubmit("h1", 9) == "b" and lib.touch("a", 10) and not lib.touch("../a", 1)
    assert library.listed(lib.read()).first().id == "a" and lib.load("../x") is None and lib.load("a").count() == 1
    assert lib.delete("a") and not lib.delete("a") and lib.read().count() == 2
    lib.save(rows.where("id = 'a'"))
    assert lib.read().count() == 3 and lib.load("a").head().display_name == "Lease"
    before = sorted((r.id, r.display_name, r.analyzed_at_epoch_millis) for r in lib.read().collect())
    lib.compact()
    assert sorted((r.id, r.display_name, r.analyzed_at_epoch_millis) for r in lib.read().collect()) == before and len(lib._parts("entries")) == 1
    assert library.found_of(lib.read(), "lease").head().line == "1 of 3"
    seen = library.unseen(spark.createDataFrame([("h1",), ("h2",), (None,)], "content_hash string"), lib.read())
    assert sorted(str(r[0]) for r in seen.collect()) == ["None", "h2"]


def test_two_writers_lose_nothing(spark, tmp_path):
    one, two = (library.Library(spark, str(tmp_path / "lib")) for _ in range(2))
    row = lambda id_: spark.createDataFrame([(id_, id_, 1, None)], "id string, display_name string, analyzed_at_epoch_millis long, content_hash string")
    one.save(row("a"))
    seen = one.read()
    two.save(row("b"))
    one.save(row("c"))
    assert seen.count() == 1 and {r.id for r in two.read().collect()} == {"a", "b", "c"}


def test_results_and_sources_of_the_library(spark, tmp_path):
    lib = library.Library(spark, str(tmp_path / "lib"))
    pages = spark.createDataFrame([("f", 1, TEXT)], "doc_id string, page_no int, text string")
    result = pipeline.analyse(pages, key="doc_id")
    entries = result.counts().select(F.col("doc_id").alias("id"), F.lit("Lease").alias("display_name"), F.lit(5).cast("long").alias("analyzed_at_epoch_millis"), F.lit("h").alias("content_hash"), "clause_count", "risk_count", "entity_count")
    lib.save(entries)
    lib.save(reports.json_reports(result).withColumnRenamed("doc_id", "id"), "results")
    lib.save(spark.createDataFrame([("f", bytearray(b"bytes"), "txt")], "id string, content binary, source_extension string"), "sources")
    assert lib.load("f").head().clause_count == 3 and json.loads(lib.load("f", "results").head().json)["clauses"] and bytes(lib.load("f", "sources").head().content) == b"bytes"
    assert lib.delete("f") and all(lib.load("f", name).count() == 0 for name in library.TABLES)



def test_latest(spark):
    rows = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 1)], "id int, v string, at int")
    assert sorted((r.id, r.v) for r in library.latest(rows, ["id"], "at").collect()) == [(1, "new"), (2, None)]


def test_uploads_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(None, 1), ("a.pdf", None), ("a.EXE", 5), ("a.txt", 0), ("a.docx", fixed.UPLOAD_BYTES + 1), ("a.PDF", 7)], "p string, n long")
    got = [r[0] for r in rows.select(files.reason(F.col("p"), F.col("n"))).collect()]
    assert [bool(x) for x in got] == [True, True, True, True, True, False]
    import zipfile

    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "x.bin").write_text("??")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.error) for r in files.pages(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("plain text", None) and got["b.docx"] == ("one\ntwo", None)
    assert got["x.bin"][1]
    empty = spark.createDataFrame([("e.txt", bytearray(), "text/plain"), ("n.txt", None, "text/plain")], "path string, content binary, media_type string")
    assert all(r.error and r.text is None for r in files.pages(empty).collect())


def small_pdf(pages, packed=True, extra=b""):
    """A PDF file with one content stream a page; the first font has a table of its own."""
    import zlib

    table = b"1 beginbfchar <41> <0042> endbfchar 1 beginbfrange <61> <63> <0078> endbfrange"
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count 2 /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * k) for k in range(len(pages))) + b"] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>", 5: b"<< /Type /Font /ToUnicode 7 0 R >>", 6: b"<< /Type /Font >>"}
    streams = {7: table} | {11 + 2 * k: body for k, body in enumerate(pages)}
    for k in range(len(pages)):
        objects[10 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * k)
    for n, body in streams.items():
        data = zlib.compress(body) if packed else body
        objects[n] = b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if packed else b"") + data + b"\nendstream"
    return b"%PDF-1.4\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (n, body) for n, body in sorted(objects.items())) + b"\ntrailer << /Root 1 0 R " + extra + b">>\n%%EOF"


@pytest.mark.parametrize("packed", [True, False])
def test_pdf_pages(spark, packed):
    from clausewright.sources import pdf

    pages = [rb"BT /F2 12 Tf 72 700 Td (1. PAYMENT) Tj 0 -14 Td [(Each inv) 20 (oice\) is due) -300 (now \(soon\)\056)] TJ ET", rb"BT /F1 9 Tf (A) Tj <616263> Tj T* /F2 9 Tf (caf\351) Tj ET"]
    content = small_pdf(pages, packed)
    assert pdf.read(content) == ["1. PAYMENT\nEach invoice) is due now (soon).", "Bxyz\ncafé"]
    rows = spark.createDataFrame([("a.pdf", bytearray(content), "application/pdf"), ("b.pdf", bytearray(small_pdf(pages, packed, b"/Encrypt 9 0 R ")), "application/pdf"), ("c.pdf", bytearray(b"%PDF-1.4 nothing"), "application/pdf"), ("d.pdf", bytearray(b"no pdf"), "application/pdf")], "path string, content binary, media_type string")
    got = {(r.path, r.page_no): (r.text, r.error) for r in files.pages(rows).collect()}
    assert got["a.pdf", 2] == ("Bxyz\ncafé", None) and "encrypted" in got["b.pdf", None][1] and "no page" in got["c.pdf", None][1] and got["d.pdf", None][1]
    assert {r.text for r in files.pages(rows.where("path = 'a.pdf'"), lambda c: ["given"]).collect()} == {"given"}


def test_kinds_by_content(spark):
    import io
    import zipfile

    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", "<x/>")
    rows = [(1, b"%PDF-1.7 x"), (2, packed.getvalue()), (3, b"<!DOCTYPE html><html>"), (4, "schön".encode()), (5, b"\x00\x01\xff"), (6, None), (7, b"")]
    got = {r.id: r.kind for r in spark.createDataFrame([(k, bytearray(c) if c is not None else None) for k, c in rows], "id int, content binary").select("id", files.sniffed(F.col("content")).alias("kind")).collect()}
    assert got == {1: "application/pdf", 2: files.MEDIA_TYPES["docx"], 3: "text/html", 4: "text/plain", 5: "application/octet-stream", 6: "application/octet-stream", 7: "application/octet-stream"}


def test_rule_assets(spark, tmp_path):
    (tmp_path / "cues.json").write_text(json.dumps({"B": [["x y", 2], ["z"]], "A": [["q", 1.5]]}))
    (tmp_path / "notes.json").write_text(json.dumps({"A": "about a"}))
    (tmp_path / "seeds.json").write_text(json.dumps({"A": ["one", "two"]}))
    (tmp_path / "cases.json").write_text(json.dumps([{"name": "n", "base_text": "t", "substitutions": {"a": "b"}}]))
    cues = files.cues(str(tmp_path / "cues.json"))
    assert list(cues) == ["B", "A"] and cues["B"] == [("x y", 2.0), ("z", 1.0)]
    assert [tuple(r) for r in files.explanations(spark, str(tmp_path / "notes.json")).collect()] == [("A", "about a")]
    assert [tuple(r) for r in files.seeds(spark, str(tmp_path / "seeds.json")).collect()] == [("A", "one"), ("A", "two")]
    assert files.cases(spark, str(tmp_path / "cases.json")).head().substitutions == {"a": "b"}
    typed = classify.classify_by_cues(docs(spark, "x y and q"), given=None, cues=cues).head()
    assert typed.assigned_type == "B" and typed.runner_up == "A"


def test_audit_runner(tmp_path, capsys, spark):
    from clausewright.__main__ import main

    (tmp_path / "same.json").write_text(json.dumps([{"name": "names", "base_text": "1. INDEMNITY\n\nAsha shall indemnify Ravi.", "substitutions": {"Asha": "Meera"}}]))
    assert main(["--audit", str(tmp_path / "same.json")]) == 0 and "1/1 cases stable" in capsys.readouterr().out
    (tmp_path / "other.json").write_text(json.dumps([{"name": "words", "base_text": "We shall indemnify you against each loss that the goods may cause.", "substitutions": {"indemnify": "thank"}}]))
    assert main(["--audit", str(tmp_path / "other.json")]) == 1 and "CHANGED" in capsys.readouterr().out


def test_provisions_source(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"authority": "root", "provisions": [{"corpus_id": "x-1", "act": "Act", "provision": "S 1", "heading": "H", "text": "T", "bare_act": " ", "topics": ["t"]}]}))
    row = files.provisions(spark, str(tmp_path / "p.json")).head()
    assert (row.summary, row.bare_act, row.authority, row.clause_types) == ("T", None, "root", [])


def test_pipeline_and_reports(spark):
    pages = spark.createDataFrame([(1, 1, TEXT), (2, 1, None)], "doc_id int, page_no int, text string")
    provisions = PROVISION(spark)
    heard = []

    def listener(stage):
        heard.append(stage)
        raise RuntimeError("a bad listener")

    result = pipeline.analyse(pages, provisions, listener=listener)
    assert heard == list(pipeline.STAGES) == list(result.stage_millis)
    assert {r.assigned_type for r in result.clauses.collect()} == {"PREAMBLE", "PAYMENT", "INDEMNITY"}
    assert result.matches.count() == 1
    report = json.loads(reports.json_reports(result, PROVISION(spark)).where("doc_id = 1").head().json)
    assert [c["clause_id"] for c in report["clauses"]] == ["clause-0", "clause-1", "clause-2"] and report["disclaimer"]
    assert report["backends"] == {"extraction": "keyword-only", "grounding": "bm25", "advisory": "templates"} and set(report["stageMillis"]) == set(pipeline.STAGES)
    assert report["document"]["clause_count"] == 3 and "[clause-2]  Indemnity (" in reports.text_reports(result).where("doc_id = 1").head().report


def PROVISION(spark):
    return spark.createDataFrame([(0, ["INDEMNITY"], "Act", "S 1", "Indemnity", "A promise to save from loss.", None, ["indemnity"])], "ord int, clause_types array<string>, act string, provision string, heading string, summary string, bare_act string, topics array<string>")


def test_pipeline_with_rules_notes_and_given_stages(spark):
    pages = spark.createDataFrame([(1, 1, TEXT), (2, 1, None)], "doc_id int, page_no int, text string")
    told = spark.createDataFrame([("INDEMNITY", "One side makes good a loss.")], "type string, body string")
    propose = lambda n: n.select("clause_key", "headline", F.concat(F.lit("In plain words, "), F.lower("body"), F.lit(" This is no advice.")).alias("candidate"))
    result = pipeline.analyse(pages, PROVISION(spark), flagging=[rules.Rule("INDEMNITY", "indemnif", None, "HIGH", "open-ended")], required=[("GOVERNING_LAW", "LOW", "no-law")], explanations=told)
    assert {(r.scope, r.category) for r in result.all_flags().collect()} == {("clause", "open-ended"), ("document", "no-law")}
    made = result.all_notes().collect()
    assert {(r.scope, r.headline) for r in made} == {("clause", "What this clause does: Indemnity"), ("clause", "High-priority point: Open ended"), ("document", "Minor note: No law")}
    assert all(r.citations for r in made) and {len(r.citations) for r in made if "High" in r.headline} == {2}
    assert [tuple(r) for r in result.counts().collect()] == [(1, 3, 2, result.entities.count())]
    report = json.loads(reports.json_reports(result, PROVISION(spark)).where("doc_id = 1").head().json)
    clause = report["clauses"][2]
    assert clause["riskFlags"] == [{"severity": "HIGH", "category": "open-ended"}] and clause["groundedIn"][0]["act"] == "Act" and "bareAct" not in clause["groundedIn"][0]
    assert len(clause["advice"]) == 2 and report["documentRiskFlags"][0]["category"] == "no-law" and report["documentAdvice"][0] == {"headline": "Minor note: No law", "body": "Found by the rule no-law."}
    shown = reports.text_reports(result, PROVISION(spark)).where("doc_id = 1").head().report
    assert all(part in shown for part in ("KEY TERMS", "WHOLE-DOCUMENT NOTES", "(!) High open-ended", "grounded in: Act S 1 [", "CLAUSES  (2 classified, 1 with flags)"))
    assert "WHOLE-DOCUMENT" not in reports.text_reports(result).where("doc_id = 2").head().report
    given = pipeline.analyse(
        pages, PROVISION(spark), classifier=lambda c: c.select("*", F.lit("NOTICES").alias("assigned_type"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("runner_up")),
        extractor=lambda d, key: entities.entities(d, key).where("false"), retriever=lambda q, p, key, kind: q.select(key, F.lit(1).alias("rank"), F.lit(0).alias("ord"), F.lit(0.5).alias("score"), F.lit("given").alias("method")), rephrase=propose, explanations=spark.createDataFrame([("NOTICES", "How one side tells the other.")], "type string, body string"),
    )
    assert {r.assigned_type for r in given.clauses.collect()} == {"NOTICES"} and given.entities.count() == 0 and given.matches.count() == 3
    assert given.backends == {"extraction": "given", "grounding": "given", "advisory": "rephrased"}
    assert {r.body for r in given.notes.collect()} == {"In plain words, how one side tells the other. This is no advice."}
    hybrid = pipeline.analyse(pages, PROVISION(spark), encoder=lambda rows, key, body: rows.select(key, F.array(F.length(body).cast("double"), F.lit(1.0)).alias("embedding")))
    assert {r.method for r in hybrid.matches.collect()} == {"hybrid"} and hybrid.backends["extraction"] == "keyword-only"


def test_types_by_cues_and_vectors(spark):
    pages = spark.createDataFrame([(1, 1, TEXT)], "doc_id int, page_no int, text string")
    words = ("invoice", "indemnif", "notice")
    encoder = lambda rows, key, body: rows.select(key, F.array(*(F.regexp_count(F.lower(body), F.lit(w)).cast("double") for w in words)).alias("embedding"))
    seeds = spark.createDataFrame([("PAYMENT", "each invoice"), ("PAYMENT", "an invoice"), ("INDEMNITY", "to indemnify"), ("NOTICES", "a notice")], "label string, text string")
    result = pipeline.analyse(pages, encoder=encoder, seeds=seeds)
    got = {r.clause_id: (r.assigned_type, round(r.confidence, 2), r.method) for r in result.clauses.collect()}
    assert got == {"clause-0": ("PREAMBLE", 0.0, "ensemble"), "clause-1": ("PAYMENT", 1.0, "ensemble"), "clause-2": ("INDEMNITY", 1.0, "ensemble")}
    assert result.backends["extraction"] == "inlegalbert+keyword"


def test_prompts_are_cut(spark):
    rows = spark.createDataFrame([(1, "c" * 900, "n" * 600, ["p" * 300]), (2, None, None, None)], "id int, clause string, body string, provisions array<string>")
    got = {r.id: r for r in notes.prompts(rows).collect()}
    assert "c" * 700 + " ..." in got[1].prompt and "n" * 500 + " ..." in got[1].prompt and got[1].allowed == "p" * 180 + " ..." and "(none)" in got[2].prompt and got[2].allowed == ""


def test_pages_by_sentences(spark):
    spans = spark.createDataFrame([(1, 0), (1, 5), (1, 99), (2, 3)], "doc_id int, span_start int")
    told = spark.createDataFrame([(1, 4, 1), (1, 50, 3)], "doc_id int, span_start int, page int")
    assert [(r.span_start, r.page) for r in segment.page_by_sentence(spans, told).orderBy("doc_id", "span_start").collect()] == [(0, 0), (5, 1), (99, 3), (3, 0)]


def test_masked_mean(spark):
    from clausewright.functions import vectors

    rows = spark.createDataFrame([(1, [[3.0, 4.0], [9.0, 9.0]], [1, 0]), (2, [[1.0, 1.0]], [0]), (3, None, None)], "id int, s array<array<double>>, m array<int>")
    assert [r[0] for r in rows.orderBy("id").select(vectors.masked_mean(F.col("s"), F.col("m"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_key_terms(spark):
    rows = spark.createDataFrame([(1, "PARTY", f"p{n}", n, n) for n in range(9)] + [(1, "PARTY", "p0", 99, 99), (1, None, "x", 0, 0)], "doc_id int, entity_type string, text string, span_start int, entity_no int")
    assert reports.key_terms(rows).head().terms == "p0; p1; p2; p3; p4; p5"


def test_wordpiece(spark):
    words = ["[CLS]", "[SEP]", "[UNK]", "non", "-", "compete", "cafe", "##s"] + [f"w{n}" for n in range(100)]
    vocabulary = {w: n for n, w in enumerate(words)}
    rows = spark.createDataFrame([(1, "Non-compete"), (2, "Cafés zzz"), (3, None)], "id int, t string")
    got = {r.id: r.ids for r in wordpiece.encode(rows, "id", "t", vocabulary).collect()}
    assert got == {1: [0, 3, 4, 5, 1], 2: [0, 6, 7, 2, 1], 3: [0, 1]}
    vectors = wordpiece.embed(rows, "t", lambda: lambda texts: [[3.0, 4.0] for _ in texts]).collect()
    assert {r.id: r.embedding and [round(x, 3) for x in r.embedding] for r in vectors} == {1: [0.6, 0.8], 2: [0.6, 0.8], 3: None}


def test_pooling_and_limits():
    assert wordpiece.pooled([[[3.0, 4.0], [9.0, 9.0]], [[1.0, 1.0]]], [[1, 0], [0]]) == [[0.6, 0.8], [0.0, 0.0]]
    assert [wordpiece.sequence_limit(m) for m in (None, {}, {"max_length": 128}, {"max_length": 512})] == [256, 256, 128, 256]
    made = []
    assert wordpiece.shared("one", lambda: made.append(1) or "m") == wordpiece.shared("one", lambda: made.append(1)) == "m" and made == [1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id int, text string, type string, embedding array<float>, label string")
    assert segment.segment(none).count() == entities.entities(none).count() == segment.sentences(none).count() == 0
    assert classify.classify_by_cues(none).count() == classify.centroids(none).count() == 0
