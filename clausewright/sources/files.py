"""Reading uploaded files: guards, media types, plain text, DOCX, pages by a given reader, and provisions."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import fixed
from clausewright.functions.arrow import flat_map
from clausewright.sources import pdf as small_pdf

#: Media types by extension.
MEDIA_TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "html": "text/html", "htm": "text/html"}
LONGEST_TEXT, MOST_PAGES = 15_000_000, 3_000
Pages = Callable[[bytes], list[str]]


def extension(path: Column) -> Column:
    """The lower-case extension of a path; empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def media_type(path: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for end, kind in MEDIA_TYPES.items():
        out = out.when(extension(path) == end, kind)
    return out.otherwise("application/octet-stream")


def sniffed(content: Column) -> Column:
    """The media type by what the bytes begin with: PDF, a packed DOCX, HTML, or text if they are UTF-8 without zero
    bytes; null, empty and other contents are octet streams."""
    head = F.lower(F.ltrim(F.substring(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), 1, 512)))
    whole = F.decode(content, "ISO-8859-1")
    return (
        F.when(content.isNull() | (F.length(content) == 0), "application/octet-stream")
        .when(head.startswith("%pdf-"), MEDIA_TYPES["pdf"])
        .when(head.startswith("pk") & F.contains(whole, F.lit("word/document.xml")), MEDIA_TYPES["docx"])
        .when(head.rlike(r"^(?:<!doctype html|<html)"), MEDIA_TYPES["html"])
        .when(F.is_valid_utf8(content.cast("string")) & ~F.contains(whole, F.lit("\0")), MEDIA_TYPES["txt"])
        .otherwise("application/octet-stream")
    )


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, media_type) of the files under a path, the type by the name, else by the content; the
    source itself leaves empty files out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    by_name, by_content = media_type(F.col("path")), sniffed(F.col("content"))
    # That bytes are text says little about a file that is named otherwise.
    told = (by_content != MEDIA_TYPES["txt"]) | (extension(F.col("path")) == "")
    return files.select("path", "length", "content", F.when((by_name == "application/octet-stream") & told, by_content).otherwise(by_name).alias("media_type"))


def reason(path: Column, size: Column, is_file: Column | None = None) -> Column:
    """Why an upload is refused, the first reason in this order; null if it is accepted."""
    file = F.lit(True) if is_file is None else is_file
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "No file was given.")
        .when(size.isNull(), "The file could not be found.")
        .when(~file, "A folder cannot be analysed.")
        .when(~extension(path).isin(*fixed.UPLOAD_EXTENSIONS), "This type of file is not supported.")
        .when(size == 0, "The file is empty.")
        .when(size > fixed.UPLOAD_BYTES, "The file is larger than 25 MB.")
    )


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, one to a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        root = ElementTree.fromstring(packed.read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = []
    for paragraph in root.iter(f"{space}p"):
        parts = {f"{space}t": lambda e: e.text or "", f"{space}tab": lambda e: "\t", f"{space}br": lambda e: "\n"}
        lines.append("".join(parts[e.tag](e) for e in paragraph.iter() if e.tag in parts))
    return "\n".join(lines)


def pages(files: DataFrame, pdf: Pages | None = None) -> DataFrame:
    """(path, media_type, page_no, text, error) of the files (path, content, media_type).

    Text is read as UTF-8 and is one page, as DOCX is (by its file name). PDF pages come from the given reader, else from
    the small one of this package, which refuses encrypted files. Empty and
    null contents, unknown types, texts beyond 15,000,000 characters, files without a page, and files the reader fails on
    come out as a row with an error; pages beyond 3,000 are dropped by the format's rule.
    """

    def make() -> Callable:
        def texts(path: str, content: bytes, kind: str) -> list[str]:
            if path.lower().endswith(".docx") or kind == MEDIA_TYPES["docx"]:
                return [docx_text(content)]
            if kind.startswith("text/"):
                return [content.decode("utf-8", "replace")]
            if kind == "application/pdf":
                return (pdf or small_pdf.read)(content)[:MOST_PAGES]
            raise ValueError(f"Unsupported document type: {kind}")

        def each(path: str, content: bytes | None, kind: str) -> Iterator[tuple]:
            try:
                if not content:
                    raise ValueError("The file is empty")
                found = texts(path or "", content, kind or "application/octet-stream")
                if not found or sum(map(len, found)) > LONGEST_TEXT:
                    raise ValueError("The file has no page" if not found else "The text is too long")
            except Exception as problem:  # a broken file must not end the job
                yield path, kind, None, None, str(problem)[:200]
                return
            for n, text in enumerate(found, 1):
                yield path, kind, n, text, None

        return each

    return flat_map(files, make, "path string, media_type string, page_no int, text string, error string", ["path", "content", "media_type"])


def provisions(spark: SparkSession, path: str, authority: str = "https://www.indiacode.nic.in") -> DataFrame:
    """(ord, corpus_id, act, provision, heading, summary, bare_act, authority, topics, clause_types) of a JSON corpus
    {authority, provisions: [...]}; a summary falls back to `text`, an authority to the corpus' and then to the given one."""
    fields = "corpus_id string, act string, provision string, heading string, summary string, text string, bare_act string, authority string, topics array<string>, clause_types array<string>"
    root = spark.read.schema(f"authority string, provisions array<struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>>").option("multiLine", "true").json(path)
    rows = root.select(F.col("authority").alias("root"), F.posexplode("provisions").alias("ord", "p"))
    empty = F.array().cast("array<string>")
    return rows.select("ord", "p.corpus_id", "p.act", "p.provision", "p.heading", F.coalesce("p.summary", "p.text").alias("summary"), F.when(F.trim("p.bare_act") != "", F.col("p.bare_act")).alias("bare_act"), F.coalesce("p.authority", "root", F.lit(authority)).alias("authority"), F.coalesce("p.topics", empty).alias("topics"), F.coalesce("p.clause_types", empty).alias("clause_types"))


def cues(path: str) -> dict[str, list[tuple[str, float]]]:
    """The cues of a JSON object {type: [[pattern, weight], ...]} in its order; a weight left out is 1."""
    with open(path, encoding="utf-8") as file:
        return {kind: [(pattern, float(weight[0]) if weight else 1.0) for pattern, *weight in rows] for kind, rows in json.load(file).items()}


def _by_type(spark: SparkSession, path: str, value: str) -> DataFrame:
    read = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("type", "value"))
    return read.where(F.col("value").isNotNull())


def explanations(spark: SparkSession, path: str) -> DataFrame:
    """(type, body) of a JSON object {type: note}."""
    return _by_type(spark, path, "string").select("type", F.col("value").alias("body"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(label, text) of a JSON object {type: [phrase, ...]}."""
    return _by_type(spark, path, "array<string>").select(F.col("type").alias("label"), F.explode("value").alias("text"))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(name, base_text, substitutions) of a JSON list of audit cases."""
    return spark.read.schema("name string, base_text string, substitutions map<string,string>").option("multiLine", "true").json(path)
