"""Conformity: failures by dimension, dimension scores, the weighted score and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validators import FIELD_VALIDATORS
from .placeholders import orphan_summary

#: Default weights and threshold, severities, and how many critical failures bring a dimension to 0.
WEIGHTS = {"text": 0.30, "structural": 0.20, "visual": 0.15, "design": 0.15, "technical": 0.20}
THRESHOLD = 0.85
SEVERITIES = {"info": 0, "warning": 1, "critical": 2}
MOST_FAILURES = {"text": 5.0}
METRIC_LIMITS = {"headings": 1, "tables_count": 0, "table_cells_total": 4, "sections_count": 0, "list_paragraphs": 2}

FAILURE = ("doc_id", "dimension", "field_or_excerpt", "expected", "actual", "severity", "note")


def severity_rank(c: Column) -> Column:
    return F.when(c == "info", 0).when(c == "critical", 2).otherwise(1)


def severity_filter(rows: DataFrame, least: str = "warning") -> DataFrame:
    """Rows at or above a severity; unknown severities count as warnings."""
    return rows.where(severity_rank(F.col("severity")) >= SEVERITIES.get(least, 1))


def technical_failures(mapping: DataFrame, schema: list[tuple[str, str, bool]], rendered: DataFrame | None = None) -> DataFrame:
    """mapping: doc_id, field, value, source. schema: (field, type, required). Required fields missing, values that their type's validator rejects, tokens left over."""
    required = [f for f, _, r in schema if r]
    value = F.coalesce("value", F.lit(""))
    row = lambda expected, actual, note: F.struct(F.lit(expected).alias("expected"), actual.alias("actual"), F.lit(note).alias("note"))
    bad = F.when(F.col("field").isin(required) & ((F.col("source") == "missing") | (value == "")), row("filled", F.lit("missing"), "required field not extracted"))
    for field, kind, _ in schema:  # a field has one type, and what is empty is not judged by it
        if kind in FIELD_VALIDATORS:
            bad = bad.when((F.col("field") == field) & (value != "") & ~FIELD_VALIDATORS[kind](F.col("value")), row(f"valid {kind}", F.col("value"), "format validator rejected value"))
    out = mapping.select("doc_id", F.col("field").alias("field_or_excerpt"), bad.alias("_b")).where("_b IS NOT NULL").select("doc_id", "field_or_excerpt", "_b.*")
    if rendered is not None:
        left = orphan_summary(rendered)
        out = out.unionByName(left.select("doc_id", F.lit("orphan_placeholders").alias("field_or_excerpt"), F.lit("0").alias("expected"), F.col("n_orphans").cast("string").alias("actual"),
                                          F.concat(F.lit("unsubstituted tokens: "), F.col("tokens")).alias("note")))
    return out.withColumn("dimension", F.lit("technical")).withColumn("severity", F.lit("critical")).select(*FAILURE)


def fingerprints(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, level (null: no heading), is_list, is_table, cells. A row a document: doc_id, metrics (metric, n).

    Blocks are read once; where they are dealt by document, nothing is moved."""
    by = blocks.groupBy("doc_id", "level").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_table").alias("_t"), F.coalesce(F.sum("cells"), F.lit(0)).alias("_c"), F.count_if("is_list").alias("_l"))
    heads = F.collect_list(F.when(F.col("level").isNotNull(), F.struct(F.concat(F.lit("headings_h"), F.col("level")).alias("metric"), F.col("_n").alias("n"))))
    whole = by.groupBy("doc_id").agg(heads.alias("_heads"), F.sum("_t").alias("tables_count"), F.sum("_c").alias("table_cells_total"), F.coalesce(F.sum(F.when(F.col("level").isNotNull(), F.col("_n"))), F.lit(0)).alias("sections_count"),
                                     F.sum("_l").alias("list_paragraphs"))
    totals = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("n")) for m in ("tables_count", "table_cells_total", "sections_count", "list_paragraphs")])
    return whole.select("doc_id", F.concat("_heads", totals).alias("metrics"))


def fingerprint(blocks: DataFrame) -> DataFrame:
    """The same in long form: doc_id, metric, n."""
    return fingerprints(blocks).select("doc_id", F.explode("metrics").alias("_m")).select("doc_id", "_m.metric", "_m.n")


def structural_failures(template: DataFrame, candidates: DataFrame) -> DataFrame:
    """template: metric, n. candidates: doc_id, metric, n, or a row a document as fingerprints gives it. A full outer comparison for each document; what either lacks counts as 0.

    A document's metrics lie in one row, and what of the template isn't among them is put to them, so that only rows that differ leave the task."""
    wanted = template.where("metric IS NOT NULL").agg(F.map_from_entries(F.collect_list(F.struct("metric", "n"))).alias("_w"))  # one row, as long as the template
    own = candidates if "metrics" in candidates.columns else candidates.groupBy("doc_id").agg(F.collect_list(F.struct("metric", "n")).alias("metrics"))
    row = lambda metric, e, a: F.struct(metric.alias("metric"), F.coalesce(e, F.lit(0)).cast("long").alias("_e"), F.coalesce(a, F.lit(0)).cast("long").alias("_a"))
    known = F.transform("metrics", lambda m: row(m["metric"], F.element_at("_w", m["metric"]), m["n"]))
    lacking = F.transform(F.array_except(F.map_keys("_w"), F.transform("metrics", lambda m: m["metric"])), lambda w: row(w, F.element_at("_w", w), F.lit(0)))
    both = own.crossJoin(F.broadcast(wanted)).select("doc_id", F.explode(F.concat(known, lacking)).alias("_o")).select("doc_id", "_o.metric", "_o._e", "_o._a").where("_e <> _a")
    limit = F.lit(METRIC_LIMITS["headings"])
    for name, n in METRIC_LIMITS.items():
        limit = F.when(F.col("metric") == name, n).otherwise(limit)
    far = F.abs(F.col("_e") - F.col("_a"))
    return both.select("doc_id", F.lit("structural").alias("dimension"), F.col("metric").alias("field_or_excerpt"), F.col("_e").cast("string").alias("expected"),
                       F.col("_a").cast("string").alias("actual"), F.when(far > limit, "critical").otherwise("warning").alias("severity"), F.concat(F.lit("count differs by "), far).alias("note"))


def text_failures(discrepancies: DataFrame) -> DataFrame:
    """Discrepancies of a text comparison as failures; information is left out."""
    return discrepancies.where("severity <> 'info'").select("doc_id", F.lit("text").alias("dimension"), "field_or_excerpt", F.col("source_value").alias("expected"),
                                                            F.col("output_value").alias("actual"), "severity", "note")


def visual_failures(template: dict, candidates: DataFrame) -> DataFrame:
    """template: density, headings, tables, placeholders of a layout. candidates: doc_id and the same columns."""
    off = F.abs(F.col("density") - template["density"])
    cases = [(off > 0.10, "overall_density", F.when(off >= 0.20, "critical").otherwise("warning"), "density"),
             (F.abs(F.col("headings") - template["headings"]) > 1, "headings", F.lit("warning"), "headings"),
             (F.abs(F.col("tables") - template["tables"]) > 1, "tables", F.lit("warning"), "tables"),
             (F.col("placeholders") > template["placeholders"] + 2, "placeholders", F.lit("critical"), "placeholders")]
    rows = F.array(*[F.when(c, F.struct(F.lit(n).alias("f"), s.alias("s"), F.lit(str(template[k])).alias("e"), F.col(k).cast("string").alias("a"))) for c, n, s, k in cases])
    return candidates.select("doc_id", F.explode(F.array_compact(rows)).alias("x")).select("doc_id", F.lit("visual").alias("dimension"), F.col("x.f").alias("field_or_excerpt"),
                                                                                        F.col("x.e").alias("expected"), F.col("x.a").alias("actual"), F.col("x.s").alias("severity"), F.lit("layout differs").alias("note"))


def dimension_scores(docs: DataFrame, failures: DataFrame, evaluated: list[str], skipped: dict[str, str] | None = None) -> DataFrame:
    """For each document and dimension its score, 1 - (critical + 0.4 * others) / most, within 0 and 1. skipped (dimension, reason) score 1."""
    skipped, critical = skipped or {}, F.coalesce(F.col("severity") == "critical", F.lit(False))
    named = docs.sparkSession.createDataFrame([(d, d in skipped, skipped.get(d), MOST_FAILURES.get(d, 4.0)) for d in [*evaluated, *skipped]],
                                              "dimension string, skipped boolean, skip_reason string, _most double")
    dims = list(dict.fromkeys([*evaluated, *skipped])) or [""]
    # a row a document, with two counts for each dimension
    told = failures.groupBy("doc_id").agg(*[F.count_if((F.col("dimension") == d) & c).alias(f"_{k}{i}") for i, d in enumerate(dims) for k, c in (("c", critical), ("o", ~critical))])
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.coalesce(f"_c{i}", F.lit(0)).alias("c"), F.coalesce(f"_o{i}", F.lit(0)).alias("o")) for i, d in enumerate(dims)])
    both = docs.select("doc_id").distinct().join(told, "doc_id", "left").select("doc_id", F.explode(each).alias("_x")).join(F.broadcast(named), F.col("_x.d") == F.col("dimension"))  # five dimensions at most
    weight = (10 * F.col("_x.c") + 4 * F.col("_x.o")) / 10
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - weight / F.col("_most")))
    return both.select("doc_id", "dimension", F.when(F.col("skipped"), 1.0).otherwise(score).alias("score"), "skipped", "skip_reason", F.col("_x.c").alias("n_critical"))


def verdicts(scores: DataFrame, weights: dict[str, float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (weights normalised over the dimensions there are, to four places), n_critical, conforms. Needs a dimension that was evaluated and no critical failure."""
    w = F.lit(0.0)
    for name, value in (weights or WEIGHTS).items():
        w = F.when(F.col("dimension") == name, value).otherwise(w)
    by = scores.withColumn("_w", w).groupBy("doc_id").agg(F.sum(F.col("score") * F.col("_w")).alias("_s"), F.sum("_w").alias("_all"), F.sum("n_critical").alias("_c"), F.count_if(~F.col("skipped")).alias("_n"))
    score = F.when(F.col("_all") > 0, F.round(F.col("_s") / F.col("_all"), 4)).otherwise(0.0)
    critical = F.col("_c") + F.when(F.col("_n") == 0, 1).otherwise(0)
    return by.select("doc_id", score.alias("score"), critical.alias("n_critical"), ((score >= threshold) & (critical == 0)).alias("conforms"))


def field_status(mapping: DataFrame) -> DataFrame:
    """mapping: field, type, required, value and more. Adds status: ok, missing (required), absent (optional), invalid (its type's validator rejects it)."""
    wrong = F.lit(False)
    for kind, valid in FIELD_VALIDATORS.items():
        wrong = F.when(F.col("type") == kind, ~valid(F.col("value"))).otherwise(wrong)
    return mapping.withColumn("status", F.when(F.col("value").isNull(), F.when(F.col("required"), "missing").otherwise("absent")).when(wrong, "invalid").otherwise("ok"))


def format_verdicts(docs: DataFrame, statuses: DataFrame, formats: list[dict], key: str = "doc_id") -> DataFrame:
    """docs: key, name, text; statuses: key, status, a row a field. Each document judged by the weights and the threshold of its format, as load_format gives it:
    key, name, n_critical (fields missing or invalid), n_headings_missing, score, passed.

    The technical dimension falls by one field's share for each critical field, the structural one by one heading's share for each required
    heading that no line of the text is. Weights count as far as these two have them; formats of weight 0 in both don't pass. A null text has no lines."""
    rows = [(f["name"], f["threshold"], f["weights"]["structural"], f["weights"]["technical"], f["required_headings"], max(1, len(f["fields"]))) for f in formats]
    terms = docs.sparkSession.createDataFrame(rows, "_n string, _threshold double, _ws double, _wt double, _required array<string>, _fields int")
    critical = statuses.groupBy(F.col(key).alias("_k")).agg(F.count_if(F.col("status").isin("missing", "invalid")).alias("_critical"))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    met = docs.join(F.broadcast(terms), F.col("name") == F.col("_n")).select(key, "name", "_threshold", "_ws", "_wt", "_fields", F.size("_required").alias("_all"),
                                                                          F.size(F.array_except("_required", lines)).cast("long").alias("n_headings_missing"))
    met = met.join(critical, F.col(key) == F.col("_k"), "left").withColumn("n_critical", F.coalesce("_critical", F.lit(0)))
    technical = F.greatest(F.lit(0.0), 1 - F.col("n_critical") / F.col("_fields"))
    structural = F.when(F.col("_all") > 0, 1 - F.col("n_headings_missing") / F.col("_all")).otherwise(1.0)
    weight = F.col("_ws") + F.col("_wt")
    score = F.when(weight > 0, F.round((F.col("_ws") * structural + F.col("_wt") * technical) / weight, 3)).otherwise(0.0)
    return met.withColumn("score", score).select(key, "name", "n_critical", "n_headings_missing", "score", ((F.col("score") >= F.col("_threshold")) & (F.col("n_critical") == 0) & (weight > 0)).alias("passed"))
