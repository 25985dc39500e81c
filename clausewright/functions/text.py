"""Column expressions over text. All stay in the JVM and return null for null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewright.functions import fixed


def strip(text: Column) -> Column:
    """Without white space at both ends; no-break spaces stay."""
    return F.regexp_replace(text, f"^{fixed.BLANK}+|{fixed.BLANK}+$", "")


def normalize(text: Column) -> Column:
    """Ten rewrites in fixed order: line ends, no-break spaces, words cut at line ends, blanks at line ends, headings set
    apart, blank lines, wrapped lines joined, runs of blanks, blank lines again, ends. Null and empty give an empty text."""
    steps = (
        (r"\r\n?", "\n"),
        (r"[\u00A0\u2007\u202F]", " "),
        (r"(\p{L})-\n(\p{L})", "$1$2"),
        (r"[ \t]+\n", "\n"),
        (rf"(?m)^[ \t]{{0,6}}({fixed.ENUMERATOR})[ \t]+({fixed.TITLE})[ \t]*$", "\n\n$1 $2\n\n"),
        (r"\n{3,}", "\n\n"),
        (r"(?<!\n)\n(?!\n)", " "),
        (r"[ \t]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    )
    out = F.coalesce(text, F.lit(""))
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def humanise(raw: Column) -> Column:
    """UPPER_SNAKE or kebab to `Sentence case`; a text of separators only stays as it is."""
    spaced = F.lower(F.trim(F.translate(raw, "_-", "  ")))
    return F.when(spaced == "", raw).otherwise(F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000)))


def clause_label(raw: Column) -> Column:
    """Null, blank and UNCLASSIFIED give `Unclassified`."""
    return F.when(raw.isNull() | (strip(raw) == "") | (F.upper(raw) == fixed.UNCLASSIFIED), "Unclassified").otherwise(humanise(raw))


def entity_label(raw: Column) -> Column:
    return F.when(raw.isNull() | (strip(raw) == ""), "Other").otherwise(humanise(raw))


def category_label(raw: Column) -> Column:
    return F.when(raw.isNull() | (strip(raw) == ""), "Flagged clause").otherwise(humanise(raw))


def severity_label(raw: Column) -> Column:
    return F.when(raw.isin(*fixed.SEVERITIES), humanise(raw)).otherwise("Unrated")


def method_label(raw: Column) -> Column:
    known = {"inlegalbert": "semantic match", "bm25": "keyword match", "hybrid": "combined match"}
    out = F.when(raw.isNull(), "matched")
    for method, label in known.items():
        out = out.when(F.lower(raw) == method, label)
    return out.otherwise(F.lower(humanise(raw)))


def sanitise(text: Column) -> Column:
    """Control characters become spaces; null gives an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", " ")


def truncate(text: Column, budget: int) -> Column:
    """At most `budget` characters and an ellipsis, cut at the last space if that keeps four fifths of the budget."""
    if budget <= 0:
        return F.lit("")
    clean = strip(sanitise(text))
    head = F.substring(clean, 1, budget + 1)
    # Position (from 0) of the last space among the first budget + 1 characters; -1 if there is none.
    space = F.when(F.instr(head, " ") == 0, -1).otherwise(budget + 1 - F.instr(F.reverse(head), " "))
    cut = F.when(space < budget * 0.8, budget).otherwise(space)
    shortened = F.concat(F.regexp_replace(F.substring(clean, F.lit(1), cut), f"{fixed.BLANK}+$", ""), F.lit("…"))
    return F.when(F.length(clean) <= budget, clean).otherwise(shortened)


def first_sentence(text: Column) -> Column:
    """Up to the first `. ` beyond the thirtieth character; else the text, cut to 197 and dots beyond 200."""
    at = F.instr(text, ". ")
    return F.when(at > 31, F.substring(text, F.lit(1), at)).when(F.length(text) <= 200, text).otherwise(F.concat(F.substring(text, 1, 197), F.lit("...")))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, longer than one, without stop words, in order; repeated terms stay."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{Nd}]+)"), 1)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*fixed.STOP_WORDS))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """The characters from start (from 0) up to end, both held within the text."""
    low, high = F.least(F.greatest(start, F.lit(0)), F.length(text)), F.least(F.greatest(end, F.lit(0)), F.length(text))
    return F.substring(text, low + 1, F.greatest(high - low, F.lit(0)))


def supported(text: Column, source: Column, allowed: Column, note: Column) -> Column:
    """Whether a rephrased text invents nothing: its length is in bounds, each section it names is among the allowed
    ones, and each number of two or more digits occurs in the source, as written or by its digits."""
    sections = F.regexp_extract_all(text, F.lit(r"(?i)(?<![A-Za-z0-9_])(section\s+\d+[A-Za-z]?)"), 1)
    numbers = F.regexp_extract_all(text, F.lit(r"(\d[\d,./-]*)"), 1)
    lowered = F.lower(source)
    spaced = F.regexp_replace(lowered, r"[^\d]", " ")
    digits = lambda n: F.regexp_replace(n, r"[^\d]", "")
    limit = F.greatest(F.lit(700), F.floor(F.length(note) * 3 / 2) + 200)
    return (
        (F.length(text) >= 40)
        & (F.length(text) <= limit)
        & F.forall(sections, lambda s: F.contains(F.lower(allowed), F.lower(s)))
        & F.forall(numbers, lambda n: (F.length(digits(n)) < 2) | F.contains(lowered, F.lower(n)) | F.contains(spaced, digits(n)))
    )


def clamped(confidence: Column) -> Column:
    """A confidence as a bar shows it: within 0 and 1; null counts as 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(confidence, F.lit(0.0))))


def is_low(confidence: Column) -> Column:
    """Whether a confidence is marked as low; null is."""
    return F.coalesce(confidence, F.lit(0.0)) < fixed.LOW_CONFIDENCE
