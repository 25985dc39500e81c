"""Word lists, patterns and constants that results depend on."""

from __future__ import annotations

#: Clause types in their declared order.
CLAUSE_TYPES = (
    "INDEMNITY", "LIMITATION_OF_LIABILITY", "TERMINATION", "RENEWAL", "PAYMENT", "CONFIDENTIALITY", "GOVERNING_LAW", "DISPUTE_RESOLUTION", "ARBITRATION", "JURISDICTION", "FORCE_MAJEURE",
    "INTELLECTUAL_PROPERTY", "DATA_PROTECTION", "NON_COMPETE", "NON_SOLICITATION", "WARRANTY", "ASSIGNMENT", "NOTICES", "ENTIRE_AGREEMENT", "AMENDMENT", "SEVERABILITY", "SCOPE_OF_WORK", "PARTIES",
)
UNCLASSIFIED, PREAMBLE = "UNCLASSIFIED", "PREAMBLE"

#: Cues of each clause type with their weights; the order breaks ties.
CUES: dict[str, list[tuple[str, float]]] = {
    "INDEMNITY": [("indemnif", 3), ("hold harmless", 3), ("defend", 1)],
    "LIMITATION_OF_LIABILITY": [("limitation of liability", 3), ("aggregate liability", 3), ("in no event shall", 2), ("consequential damages", 2), ("liability .* shall not exceed", 3)],
    "TERMINATION": [("terminat", 3), ("for convenience", 2), ("material breach", 2), ("uncured", 1)],
    "RENEWAL": [("renew", 3), ("automatically renew", 3), ("successive", 1), ("non-renewal", 2), ("initial term", 1)],
    "PAYMENT": [("invoice", 2), ("fees", 2), ("payable within", 3), ("interest at", 2), ("per month", 1), ("gst", 1), ("payment", 2)],
    "CONFIDENTIALITY": [("confidential", 3), ("non-public information", 2), ("receiving party", 1), ("disclos", 1)],
    "GOVERNING_LAW": [("governed by", 3), ("laws of india", 3), ("construed in accordance", 2), ("governing law", 3)],
    "DISPUTE_RESOLUTION": [("dispute resolution", 3), ("good faith negotiation", 2), ("escalat", 1), ("mediation", 2)],
    "ARBITRATION": [("arbitrat", 3), ("arbitration and conciliation act", 3), ("sole arbitrator", 2), ("seat .* arbitration", 2), ("arbitral tribunal", 2)],
    "JURISDICTION": [("jurisdiction", 3), ("courts at", 2), ("exclusive jurisdiction", 3), ("submit to the .* courts", 2)],
    "FORCE_MAJEURE": [("force majeure", 3), ("beyond its reasonable control", 3), ("acts of god", 2), ("epidemic", 1)],
    "INTELLECTUAL_PROPERTY": [("intellectual property", 3), ("right, title and interest", 2), ("deliverables shall vest", 2), ("background intellectual property", 2), ("know-how", 1)],
    "DATA_PROTECTION": [("data protection", 3), ("personal data", 3), ("digital personal data protection act", 3), ("data principal", 2), ("technical and organisational measures", 2)],
    "NON_COMPETE": [("non-compete", 3), ("compet", 2), ("shall not engage in any business", 3), ("competing business", 3)],
    "NON_SOLICITATION": [("solicit", 3), ("entice away", 2), ("not solicit .* employee", 3)],
    "WARRANTY": [("warrant", 3), ("represents and warrants", 3), ("workmanlike manner", 2), ("implied are excluded", 2)],
    "ASSIGNMENT": [("assign", 3), ("transfer this agreement", 2), ("prior written consent", 1), ("purported assignment", 2)],
    "NOTICES": [("notice under this agreement", 3), ("in writing and delivered", 2), ("registered post", 2), ("deemed received", 2), ("address for notices", 3)],
    "ENTIRE_AGREEMENT": [("entire agreement", 3), ("supersedes all prior", 3), ("whole agreement", 2)],
    "AMENDMENT": [("amendment", 3), ("variation of this agreement", 2), ("in writing and signed by both", 3), ("change order", 2)],
    "SEVERABILITY": [("severab", 3), ("invalid or unenforceable", 3), ("remaining provisions shall continue", 3)],
    "SCOPE_OF_WORK": [("scope of services", 3), ("scope of work", 3), ("statement of work", 2), ("deliverables", 1), ("acceptance criteria", 2)],
    "PARTIES": [("this .{0,40}agreement is (made|entered into)", 3), ("between .{1,60} and .{1,60}\\(", 2), ("registered office", 2), ("incorporated under", 2), ("principal place of business", 2), ("hereinafter (referred to as|called)", 2), ("\\bparties\\b.{0,20}as follows", 1)],
}
CUE_LEAST, CUE_FULL = 1.5, 6.0

#: Nearest centroid and ensemble.
CENTROID_LEAST, CENTROID_MARGIN = 0.55, 0.015
ENSEMBLE_COSINE, ENSEMBLE_KEYWORD, ENSEMBLE_LEAST = 0.6, 0.4, 0.42

#: Retrieval.
STOP_WORDS = ("the", "a", "an", "of", "to", "in", "or", "and", "any", "is", "are", "be", "by", "for", "on", "as", "at", "it", "its", "that", "this", "which", "with", "such", "shall", "may", "not", "no", "if", "from", "under", "other", "than", "party", "parties", "agreement")
BM25_K1, BM25_B = 1.2, 0.75
FUSION = {"bm25": (0.75, 0.0), "hybrid": (0.45, 0.30)}
TAG_BONUS, MATCH_LEAST, TOP_K = 0.55, 0.30, 3

#: White space that stripping removes (the no-break spaces are not among it), as a class for Java and RE2.
BLANK = r"[\t-\r\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
#: The same for Python.
STRIP = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
ENUMERATOR = r"(?:\d{1,2}(?:\.\d{1,2}){0,3}\.?)|(?:\((?:[a-z]|[ivx]{1,4}|\d{1,2})\))|(?:ARTICLE|SECTION|CLAUSE)\s+(?:[IVXLC]{1,6}|\d{1,2})"
TITLE = r"\p{Lu}[\p{Lu}0-9 ,&()/'\-]{2,70}"
LEAST_PREAMBLE, LEAST_PARAGRAPH = 80, 40

MONTHS = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Entity rules in order: type, pattern, group, whether letter case is ignored.
ENTITY_RULES = (
    ("PARTY", r"\(\"([A-Z][A-Za-z .&'-]{1,60}?)\"\)", 1, False),
    ("PARTY", r"\b([A-Z][A-Za-z.&'-]+(?:\s+[A-Z][A-Za-z.&'-]+){0,5}\s+(?:Private\s+Limited|Pvt\.?\s*Ltd\.?|Limited|Ltd\.?|LLP|LLC|Inc\.?|Corporation|Company|Partnership|Trust|Foundation|Society))\b", 1, False),
    ("MONETARY_VALUE", r"(?:(?:INR|Rs\.?|₹)\s?[0-9][0-9,]*(?:\.[0-9]+)?|Rupees\s+[A-Za-z ]+?(?:\s+only|\s+lakh[s]?|\s+crore[s]?)?)", 0, False),
    ("EFFECTIVE_DATE", rf"\b(?:[0-3]?\d(?:st|nd|rd|th)?\s+{MONTHS}\s+\d{{4}}|{MONTHS}\s+[0-3]?\d,\s+\d{{4}}|[0-3]?\d[/-][01]?\d[/-]\d{{2,4}})\b", 0, False),
    ("GOVERNING_LAW", r"governed by (?:and construed in accordance with )?the laws (?:of|in force in) ([A-Z][A-Za-z ]+?)(?=[.,;]| and| whose)", 1, True),
    ("JURISDICTION", r"(?:courts?|tribunals?)\s+(?:at|of|in|within)\s+([A-Z][A-Za-z ]+?)\s+shall have (?:exclusive\s+)?jurisdiction", 1, True),
    ("JURISDICTION", r"seat (?:and venue )?of arbitration shall be ([A-Z][A-Za-z ]+?)(?=[.,; ]|and)", 1, True),
    ("NOTICE_PERIOD", r"(?:(?:at least\s+)?(?:\d{1,3}|thirty|sixty|ninety|fifteen|forty-five|one hundred and eighty)\s*(?:\(\d{1,3}\)\s*)?days?[’'\s]*(?:prior\s+)?(?:written\s+)?notice)", 0, True),
)
NOT_A_PARTY = ("agreement", "the agreement", "this agreement", "effective date", "term", "services", "deliverables", "confidential information", "parties", "party", "company", "client", "service provider", "vendor", "buyer", "seller", "consultant", "employee", "employer")
PARTY_LEAD = r"^(?:for|by|between|name|title|director|designated partner|authorised signatory|per|witness)\s+"
PARTY_TAIL = r"\s+(?:name|title|for)\s+.*$"
LONGEST_ENTITY, LONGEST_PARTY_WORDS = 120, 8

#: What stands before the headline of a note that explains a clause, and of a note on a flag of each severity.
EXPLAINS = "What this clause does: "
NOTE_PREFIX = {"HIGH": "High-priority point: ", "MEDIUM": "Worth checking: ", "LOW": "Minor note: "}
#: Characters of the clause, of the note and of each provision's note that a rephrasing stage is given.
REPHRASE_CLAUSE, REPHRASE_NOTE, REPHRASE_STATUTE = 700, 500, 180
#: Confidence below this is shown as low.
LOW_CONFIDENCE = 0.6

SEVERITIES = ("LOW", "MEDIUM", "HIGH")
UPLOAD_EXTENSIONS = ("docx", "pdf", "txt")
UPLOAD_BYTES = 25 * 1024 * 1024
