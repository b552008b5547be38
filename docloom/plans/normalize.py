"""The batch: template and labelled examples in, extracted and rendered documents with confidence tiers out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fields, placeholders, security


@dataclass(frozen=True)
class Batch:
    mapping: DataFrame
    tiers: DataFrame
    rendered: DataFrame
    patterns: list[fields.FieldPattern]

    def report(self) -> DataFrame:
        """Count of documents by tier, all four tiers."""
        return fields.tier_counts(self.tiers)


def template_fields(template: DataFrame) -> list[tuple[str, str]]:
    """(name, token) of a template's placeholders, in order. template: one row, doc_id and text."""
    return [(r["name"], r["token"]) for r in placeholders.placeholder_scan(template).orderBy("field_no").collect()]  # a template's fields


def normalize(documents: DataFrame, template_text: str, golds: DataFrame, examples: DataFrame, answers: DataFrame | None = None,
              discrepancies: DataFrame | None = None, local_only: bool = False) -> Batch:
    """documents: doc_id, text. Patterns are inferred once, on tiny data, and then applied in one narrow projection over all documents."""
    security.require_local(local_only, answers)
    spark = documents.sparkSession
    wanted = template_fields(spark.createDataFrame([(0, template_text)], "doc_id long, text string"))
    patterns = fields.infer_patterns(golds, examples)
    known = {p.field: p.pattern for p in patterns}
    wide = fields.extract_wide(documents, {n: known.get(n, fields.NEVER) for n, _ in wanted})
    names = [n for n, _ in wanted]
    mapping = fields.mapping_long(wide, names, answers)
    filled = mapping.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("field", "value")))).alias("_v"))
    rendered = fields.render(template_text, filled.select("doc_id", *[F.element_at("_v", F.lit(n)).alias(n) for n in names]), {t: n for n, t in wanted})
    return Batch(mapping, fields.tier_by_doc(mapping, names, discrepancies), rendered, patterns)
