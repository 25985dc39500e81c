"""Analyses the documents under a path: `python -m clausewright PATH [--json] [--provisions FILE] [--out FOLDER]`, or audits cases."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def main(args: list[str] | None = None) -> int:
    """0 if all went well, 1 if a document could not be read, 2 for wrong arguments."""
    parser = argparse.ArgumentParser(prog="clausewright", description=__doc__)
    parser.add_argument("path", nargs="?")
    parser.add_argument("--json", action="store_true", help="one JSON document each instead of plain text")
    parser.add_argument("--provisions", help="a JSON corpus of provisions to rank for each clause")
    parser.add_argument("--explanations", help="a JSON object of notes by clause type")
    parser.add_argument("--out", help="write the reports under this folder instead of printing them")
    parser.add_argument("--threads", default="*", help="local threads")
    parser.add_argument("--models", help="the folder of model files")
    parser.add_argument("--no-model", action="store_true", help="do without a model even where one lies")
    parser.add_argument("--audit", metavar="CASES", help="audit a JSON list of cases; 1 if an exchange of words changes an analysis")
    parser.add_argument("--check", action="store_true", help="say which optional libraries are there")
    try:
        given = parser.parse_args(args)
    except SystemExit as end:
        return int(end.code or 0) and 2
    if given.check:
        from clausewright.runtime import probe

        from clausewright.runtime import model_file, model_folder

        print("\n".join(f"{k}: {v}" for k, v in probe().items()))
        print(f"model: {None if given.no_model else model_file(model_folder(given.models))}")
        return 0
    if given.audit:
        return _audit(given.audit, given.threads)
    if not given.path:
        parser.print_usage(sys.stderr)
        return 2
    from clausewright.session import local_session
    from clausewright.sources import files

    spark = local_session(given.threads)
    # Every file is parsed once; errors and each of the report's parts read the parsed pages.
    read = files.pages(files.read_files(spark, given.path)).persist()
    try:
        return _analysed(spark, read, given)
    finally:
        read.unpersist()


def _analysed(spark: SparkSession, read: DataFrame, given: argparse.Namespace) -> int:
    """Writes or prints the reports; 1 if a document could not be read."""
    from clausewright.operators.pipeline import analyse
    from clausewright.sources import files, reports

    bad = 0
    for path, error in read.where("error is not null").select("path", "error").toLocalIterator():
        print(f"{path}: {error}", file=sys.stderr)
        bad += 1
    pages = read.where("error is null").select(F.col("path").alias("doc_id"), "page_no", "text")
    law = files.provisions(spark, given.provisions) if given.provisions else None
    told = files.explanations(spark, given.explanations) if given.explanations else None
    result = analyse(pages, law, explanations=told)
    made = (reports.json_reports if given.json else reports.text_reports)(result, law)
    if given.out:
        made.write.mode("overwrite").json(given.out)
    else:
        for row in made.toLocalIterator():
            print(row[1])
    return int(bool(bad))


def _audit(path: str, threads: str) -> int:
    """Prints how many cases are stable and what changed; 1 if any did."""
    from clausewright.operators import audit, classify
    from clausewright.session import local_session
    from clausewright.sources import files

    results = audit.audit(files.cases(local_session(threads), path), lambda texts: audit.signals(texts, classify.classify_by_cues)).persist()
    total = audit.summary(results).head()
    print(total["line"])
    for row in audit.report(results).orderBy("name").toLocalIterator():
        print(row["line"])
    results.unpersist()
    return int(not total["all_stable"])


if __name__ == "__main__":
    sys.exit(main())
