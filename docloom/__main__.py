"""Command line: python -m docloom VERB, a thin layer over the package's functions; files are read and written through Spark."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import formats
from .operators import conformity, fields, placeholders
from .plans import mapping, normalize
from .sources import docx, docx_files

VERSION = "0.3"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return docx.scan_folder(spark, path)


def _write(files: DataFrame, folder: str) -> None:
    """Files by name into a table of path and content: one row a document, so that no driver holds them."""
    files.write.mode("overwrite").parquet(folder)


def _show(rows: DataFrame | list[dict]) -> None:
    for r in rows if isinstance(rows, list) else (x.asDict(recursive=True) for x in rows.toLocalIterator()):
        print(json.dumps(r, ensure_ascii=False, default=str))


def extract(spark: SparkSession, args: argparse.Namespace) -> int:
    _show(docx.document_text(docx.read_blocks(_files(spark, args.path))))
    return 0


def list_formats(spark: SparkSession, args: argparse.Namespace) -> int:
    _show(formats.catalogue(spark).orderBy("name"))
    return 0


def run_normalize(spark: SparkSession, args: argparse.Namespace) -> int:
    """golds: a JSON-lines file of gold_no, text; examples: one of field, example_no, example. Prints the tiers, writes mapping and rendered texts."""
    docs = docx.document_text(docx.read_blocks(_files(spark, args.sources))).where("error IS NULL").select(F.xxhash64("path").alias("doc_id"), "path", "text")
    template = docx.document_text(docx.read_blocks(_files(spark, args.template))).first()["text"]
    batch = normalize.normalize(docs, template, spark.read.schema("gold_no int, text string").json(args.golds), spark.read.schema("field string, example_no int, example string").json(args.examples))
    names = docs.select("doc_id", "path")
    batch.rendered.join(names, "doc_id").write.mode("overwrite").parquet(f"{args.out}/rendered")
    batch.mapping.join(names, "doc_id").write.mode("overwrite").parquet(f"{args.out}/mapping")
    _show(batch.report().orderBy("tier"))
    return 0


def run_map_sections(spark: SparkSession, args: argparse.Namespace) -> int:
    template = bytes(_files(spark, args.template).first()["content"])
    done = mapping.map_sections(spark, template, _files(spark, args.sources), args.today, args.similarity, not args.no_tables)
    _write(done.files, f"{args.out}/files")
    _show(done.report)
    return 0 if done.files.where("error IS NOT NULL").count() == 0 else 1


def run_conformity(spark: SparkSession, args: argparse.Namespace) -> int:
    """The structural and technical dimensions of candidates against a template; exit code 1 where one doesn't conform."""
    read = lambda path: docx.read_blocks(_files(spark, path)).withColumnRenamed("path", "doc_id")
    template, candidates = read(args.template), read(args.candidates)
    metrics = conformity.fingerprint(mapping.file_fingerprint(template)).select("metric", "n")
    failures = conformity.structural_failures(metrics, conformity.fingerprint(mapping.file_fingerprint(candidates)))
    texts = docx.document_text(candidates.withColumnRenamed("doc_id", "path")).where("error IS NULL").select(F.col("path").alias("doc_id"), "text")
    left = placeholders.orphan_summary(texts)
    technical = left.select("doc_id", F.lit("technical").alias("dimension"), F.lit("orphan_placeholders").alias("field_or_excerpt"), F.lit("0").alias("expected"), F.col("n_orphans").cast("string").alias("actual"), F.lit("critical").alias("severity"),
                            F.concat(F.lit("unsubstituted tokens: "), "tokens").alias("note"))
    failures = conformity.severity_filter(failures.unionByName(technical), args.least)
    skipped = {d: "not asked for on the command line" for d in ("text", "visual", "design")}
    verdict = conformity.verdicts(conformity.dimension_scores(texts, failures, ["structural", "technical"], skipped), threshold=args.threshold)
    _show(verdict.orderBy("doc_id"))
    return int(verdict.where("NOT conforms").count() > 0)


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="docloom", description="Extract, fill and check collections of Word documents on Spark.")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version", help="print the version")
    verbs.add_parser("list-formats", help="the formats that come with the package").set_defaults(run=list_formats)
    p = verbs.add_parser("extract", help="texts of the documents in a folder")
    p.add_argument("path")
    p.set_defaults(run=extract)
    p = verbs.add_parser("normalize", help="fields by patterns from labelled examples, and filled templates")
    for name in ("template", "sources", "golds", "examples", "out"):
        p.add_argument(name)
    p.set_defaults(run=run_normalize)
    p = verbs.add_parser("map-sections", help="a filled copy of a template for each source")
    for name in ("template", "sources", "out"):
        p.add_argument(name)
    p.add_argument("--today", required=True, help="date of the migration, as it is to be written")
    p.add_argument("--similarity", choices=mapping.MODES, default="auto")
    p.add_argument("--no-tables", action="store_true")
    p.set_defaults(run=run_map_sections)
    p = verbs.add_parser("conformity", help="structure and left-over placeholders of candidates against a template")
    for name in ("template", "candidates"):
        p.add_argument(name)
    p.add_argument("--threshold", type=float, default=conformity.THRESHOLD)
    p.add_argument("--least", choices=sorted(conformity.SEVERITIES), default="warning")
    p.set_defaults(run=run_conformity)
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    if args.verb == "version":
        print(VERSION)
        return 0
    spark = SparkSession.builder.appName(f"docloom {args.verb}").getOrCreate()
    return args.run(spark, args)


if __name__ == "__main__":
    sys.exit(main())
