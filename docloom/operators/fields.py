"""Field extraction: patterns from labelled examples, regex extraction, mapping, summary and confidence tiers."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted, strip
from ..sources.staging import staged

#: Value shapes in the order in which they are tried, how many labels a pattern takes, and shapes that need no label.
SHAPES = (
    ("iso_date", r"\d{4}-\d{2}-\d{2}"), ("br_date", r"\d{2}/\d{2}/\d{4}"), ("doc_code", r"[A-Z]+-\d+(?:-\d+)*"), ("cpf", r"\d{3}\.\d{3}\.\d{3}-\d{2}"),
    ("cep", r"\d{5}-\d{3}"), ("uf", r"[A-Z]{2}"), ("decimal_br", r"\d{1,3}(?:\.\d{3})*,\d{2}"), ("integer", r"\d+"), ("version", r"\d+\.\d+(?:\.\d+)?"),
    ("fullname", r"[A-Z][a-z]+(?:[ \t]+(?:da|de|do|dos|das|e|von|van)?[ \t]*[A-Z][a-z]+)+"),
    ("month_year_pt", r"(?i:janeiro|fevereiro|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)/\d{4}"),
)
FREE = ("freetext", r"[^\n]+")
MAX_LABELS = 6
LABEL_REACH, LABEL_LENGTH = 60, 50
DISTINCTIVE = ("cpf", "iso_date", "cep", "uf")
NEVER = r"(?!.*)"
TIERS = ("high", "medium", "low", "error")


@dataclass(frozen=True)
class FieldPattern:
    field: str
    labels: tuple[str, ...]
    shape: str
    pattern: str
    coverage: float


def example_labels(golds: DataFrame, examples: DataFrame) -> DataFrame:
    """golds: gold_no, text. examples: field, example_no, example. The label before each example's first labelled place: field, label, example_no, gold_no.

    Example i is looked for in gold text i, or in all where there is none of that number."""
    met = own = examples.join(golds, F.col("example_no") == F.col("gold_no"))
    spare = examples.join(golds.select("gold_no"), F.col("example_no") == F.col("gold_no"), "left_anti")
    if not spare.isEmpty():  # more examples than gold texts: each is looked for in all of them, wherever these lie
        met = own.unionByName(golds.crossJoin(F.broadcast(spare)).select(*own.columns))
    literal = F.replace("example", F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    met = met.withColumn("_p", F.concat(F.lit(r"(?s)^.*?:\s*\Q"), literal, F.lit(r"\E(?=\s|$|[.,;)])")))
    upto = F.array(F.expr("regexp_extract(text, _p, 0)"))
    before = F.transform(upto, lambda u: F.right(F.substring(u, F.lit(1), F.char_length(u) - F.char_length("example")), F.lit(LABEL_REACH)))
    line = lambda b: F.substring(b, F.lit(1), F.char_length(b) - F.char_length(F.substring_index(b, ":", -1)) - 1)
    label = F.transform(before, lambda b: strip(F.substring_index(F.substring_index(line(b), "\n", -1), "\r", -1)))
    found = met.select("field", F.explode_outer(label).alias("label"), "example_no", "gold_no")  # a generator, so that the text is searched once and not again in each condition
    return found.where(f"label <> '' AND char_length(label) <= {LABEL_LENGTH}")


def label_rank(labels: DataFrame, top: int = MAX_LABELS) -> DataFrame:
    """The most frequent labels of each field, the first seen on ties: field, label, n, rank."""
    seen = labels.groupBy("field", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("example_no", "gold_no")).alias("_at"))
    return seen.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "_at"))).where(F.col("rank") <= top).drop("_at")


def shape_detection(examples: DataFrame) -> DataFrame:
    """The first shape that all of a field's examples have: field, shape, n_examples."""
    fits = [F.bool_and(F.col("example").rlike(f"^(?:{p})\\z")).alias(f"_{i}") for i, (_, p) in enumerate(SHAPES)]
    found = examples.groupBy("field").agg(F.count(F.lit(1)).alias("n_examples"), *fits)
    shape = F.lit(FREE[0])
    for i, (name, _) in reversed(list(enumerate(SHAPES))):
        shape = F.when(F.col(f"_{i}"), name).otherwise(shape)
    return found.select("field", shape.alias("shape"), "n_examples")


def infer_patterns(golds: DataFrame, examples: DataFrame) -> list[FieldPattern]:
    """A pattern for each field. Statistics are DataFrames; the patterns, a few a template, are put together on the driver."""
    fragments = dict((*SHAPES, FREE))
    labels: dict[str, list[str]] = {}
    for r in label_rank(example_labels(golds, examples)).orderBy("field", "rank").collect():
        labels.setdefault(r["field"], []).append(r["label"])
    made = []
    for r in shape_detection(examples).orderBy("field").collect():
        own, part = labels.get(r["field"], []), fragments[r["shape"]]
        if own:
            pattern = f"(?i)(?:{'|'.join(quoted(x) for x in own)}):\\s*({part})"
        else:
            pattern = f"(?i)({part})" if r["shape"] in DISTINCTIVE else NEVER
        made.append((r["field"], tuple(own), r["shape"], pattern))
    covered = {r["field"]: r["coverage"] for r in pattern_coverage(golds, examples, {f: p for f, _, _, p in made if p != NEVER}).collect()}
    return [FieldPattern(f, own, shape, p, covered.get(f, 0.0)) for f, own, shape, p in made]


def pattern_coverage(golds: DataFrame, examples: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Share of a field's examples that its pattern finds in some gold text, to three places: field, coverage."""
    if not patterns:
        return examples.select("field").distinct().withColumn("coverage", F.lit(0.0))
    named = lambda f: lambda v: F.struct(F.lit(f).alias("_f"), strip(v).alias("_v"))
    hits = golds.select(F.explode(F.concat(*[F.transform(F.regexp_extract_all("text", F.lit(p), 1), named(f)) for f, p in patterns.items()])).alias("h")).select("h.*")
    met = examples.join(hits.distinct(), (F.col("field") == F.col("_f")) & (strip(F.col("example")) == F.col("_v")), "left")
    return met.groupBy("field").agg(F.round(F.avg(F.when(F.col("_v").isNotNull(), 1.0).otherwise(0.0)), 3).alias("coverage"))


def infer_formats(golds: DataFrame, examples: DataFrame) -> dict[str, list[FieldPattern]]:
    """The patterns of each format, all formats in the same passes. golds: name, format_no, example_no, text; examples: name, format_no, example_no, field, example.

    Fields go by format and name, texts by one number over all formats."""
    per = examples.agg(F.max("example_no")).collect()[0][0]  # one number
    if per is None:
        return {}
    number = (F.col("format_no") * (per + 1) + F.col("example_no")).cast("int")
    keyed = examples.select(F.concat_ws("/", "name", "field").alias("field"), number.alias("example_no"), "example")
    out: dict[str, list[FieldPattern]] = {}
    for found in infer_patterns(golds.select(number.alias("gold_no"), "text"), keyed):
        name, _, field = found.field.partition("/")
        out.setdefault(name, []).append(replace(found, field=field))
    return out


def extract_formats(docs: DataFrame, patterns: dict[str, list[FieldPattern]]) -> DataFrame:
    """docs: name, text and more. A row for each field of a document's format instead of text: field, value (null where the pattern finds none). Documents of other formats give no rows.

    One pass over the documents; each is only searched for the fields of its own format."""
    value = lambda p: F.nullif(strip(F.regexp_extract("text", p.pattern, 1)), F.lit(""))
    found = F.lit(None).cast("array<struct<field:string,value:string>>")
    for name, own in patterns.items():
        found = F.when(F.col("name") == name, F.array(*[F.struct(F.lit(p.field).alias("field"), value(p).alias("value")) for p in own])).otherwise(found)
    kept = [c for c in docs.columns if c not in ("text", "field", "value")]
    return docs.select(*kept, F.explode(found).alias("_f")).select(*kept, "_f.field", "_f.value")


def extract_wide(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """docs with a column for each field: the first match's group, stripped; null where there is none or it is empty. One narrow projection."""
    return docs.withColumns({f: F.nullif(strip(F.regexp_extract("text", p, 1)), F.lit("")) for f, p in patterns.items()})


def mapping_long(wide: DataFrame, fields: list[str], answers: DataFrame | None = None) -> DataFrame:
    """doc_id, field, value, source, confidence. Fields that the patterns missed take the answer (doc_id, field, answer, answer_confidence), if any."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("_m")
    rows = wide.select("doc_id", each).select("doc_id", "_m.field", "_m.value")
    if answers is None:
        return rows.select("doc_id", "field", "value", F.when(F.col("value").isNull(), "missing").otherwise("regex").alias("source"),
                           F.when(F.col("value").isNull(), 0.0).otherwise(1.0).alias("confidence"))
    missed = rows.where("value IS NULL").drop("value").join(answers, ["doc_id", "field"], "left")
    given = F.nullif(strip(F.col("answer")), F.lit(""))
    filled = missed.select("doc_id", "field", given.alias("value"), F.when(given.isNull(), "missing").otherwise("llm").alias("source"),
                           F.when(given.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("answer_confidence", F.lit(0.0))))).alias("confidence"))
    return rows.where("value IS NOT NULL").select("doc_id", "field", "value", F.lit("regex").alias("source"), F.lit(1.0).alias("confidence")).unionByName(filled)


def mapping_summary(mapping: DataFrame) -> DataFrame:
    of = lambda s: F.count_if(F.col("source") == s).alias(f"n_{s}")
    return mapping.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), of("regex"), of("llm"), of("missing"), F.round(F.avg("confidence"), 3).alias("average_confidence"))


def tier_by_doc(mapping: DataFrame, required: list[str], discrepancies: DataFrame | None = None, docs: DataFrame | None = None, errors: DataFrame | None = None) -> DataFrame:
    """doc_id, tier: low with a required field missing or a critical discrepancy, medium with a provider's value or a warning, else high.

    docs: all documents; those without a field to map are low. errors: documents that broke; their tier is error."""
    by = mapping.groupBy("doc_id").agg(F.bool_or((F.col("source") == "missing") & F.col("field").isin(required)).alias("_low"), F.bool_or(F.col("source") == "llm").alias("_mid"))
    if docs is not None:
        by = docs.select("doc_id").distinct().join(by, "doc_id", "left").withColumn("_low", F.coalesce("_low", F.lit(True)))
    if discrepancies is not None:
        bad = discrepancies.groupBy("doc_id").agg(F.bool_or(F.col("severity") == "critical").alias("_crit"), F.bool_or(F.col("severity") == "warning").alias("_warn"))
        by = by.join(bad, "doc_id", "left")
    else:
        by = by.withColumn("_crit", F.lit(False)).withColumn("_warn", F.lit(False))
    tier = F.when(F.col("_low") | F.coalesce("_crit", F.lit(False)), "low").when(F.col("_mid") | F.coalesce("_warn", F.lit(False)), "medium").otherwise("high")
    if errors is None:
        return by.select("doc_id", tier.alias("tier"))
    by = by.join(errors.select("doc_id", F.lit(True).alias("_broke")).distinct(), "doc_id", "full")
    return by.select("doc_id", F.when(F.col("_broke"), "error").otherwise(tier).alias("tier"))


def tier_counts(tiers: DataFrame) -> DataFrame:
    """n for each of the four tiers, 0 where there is none."""
    named = tiers.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    return named.join(tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("_n")), "tier", "left").select("tier", F.coalesce("_n", F.lit(0)).alias("n"))


def render(template: str, wide: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """doc_id, text: the template with each token by its field's value, missing ones by nothing."""
    from ..functions.text import replace_tokens

    return wide.select("doc_id", replace_tokens(F.lit(template), {t: F.col(f) for t, f in tokens.items()}).alias("text"))


def confidence(tokens_filled: Column, tokens: Column, sections_filled: Column, sections: Column) -> Column:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(1.0)
    return F.round(0.6 * share(tokens_filled, tokens) + 0.4 * share(sections_filled, sections), 3)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


#: Classes of characters from the finest to the coarsest level: a run of each is one step of a value, any other character stands for itself.
LEVELS = (("fine", (("d", "[0-9]", r"\d"), ("u", "[A-ZÀ-ÖØ-Þ]", "[A-ZÀ-ÖØ-Þ]"), ("l", "[a-zß-öø-ÿ]", "[a-zß-öø-ÿ]"), ("s", "[ ]", " "))),
          ("letters", (("d", "[0-9]", r"\d"), ("w", "[A-Za-zÀ-ÖØ-öø-ÿ]", "[A-Za-zÀ-ÖØ-öø-ÿ]"), ("s", "[ ]", " "))),
          ("words", (("w", "[0-9A-Za-zÀ-ÖØ-öø-ÿ]", "[0-9A-Za-zÀ-ÖØ-öø-ÿ]"), ("s", "[ ]", " "))))
LONGEST_EXAMPLE = 30


def pattern_synthesis(examples: DataFrame) -> DataFrame:
    """The narrowest pattern that all examples of a field have in common: field, level, pattern, n_examples, specific.

    examples: field, example. At each level an example is a row of runs of one class; the finest level at which all examples of a field have the same row gives the pattern: per run its
    text where all agree, else the class with the least and greatest length. Where no level fits, an example is longer than 30 characters or holds a line break, the level is 'free' and the
    pattern a whole line. specific: the pattern holds digits or punctuation, so that it can be looked for without a label. Null examples don't count.

    All examples of a field are held against one of them, run by run, so that only numbers are aggregated: a task keeps a row for each field, level and place, however many examples it reads."""
    rows = examples.where("example IS NOT NULL").select("field", "example", F.xxhash64("example").alias("_h"))
    wide = (F.char_length("example") > LONGEST_EXAMPLE) | F.contains("example", F.lit("\n")) | (F.col("example") == "")
    whole = staged(rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_examples"), F.bool_or(wide).alias("_wide"), F.min("_h").alias("_least")))
    narrow = whole.where("NOT _wide").select("field", F.col("_least").alias("_h"))  # the others' runs don't matter
    one = rows.join(F.broadcast(narrow), ["field", "_h"]).select("field", "example").distinct().groupBy("field").agg(F.min("example").alias("example"))

    def runs(depth: int) -> Column:
        return F.regexp_extract_all("example", F.lit("(" + "|".join(f"{c}+" for _, c, _ in LEVELS[depth][1]) + "|(?s:.))"), 1)

    def kind(x: Column) -> Column:
        found = x
        for depth, (_, classes) in enumerate(LEVELS):
            for key, c, _ in reversed(classes):
                found = F.when((F.col("_depth") == depth) & x.rlike(f"^{c}"), key).otherwise(found)
        return found

    levels = range(len(LEVELS))
    steps = one.select("field", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), runs(d).alias("r")) for d in levels])).alias("_l"))
    steps = staged(steps.select("field", F.col("_l.d").alias("_depth"), F.posexplode("_l.r").alias("_at", "_x")).withColumn("_k", kind(F.col("_x"))))  # a row for each run of one example a field
    of = steps.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("_depth", "_at", "_x", "_k"))).alias("_s"))
    of = of.select("field", *[F.expr(f"filter(_s, x -> x._depth = {d})").alias(f"_s{d}") for d in levels])
    each = rows.join(F.broadcast(of), "field").select("field", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), runs(d).alias("r"), F.col(f"_s{d}").alias("s")) for d in levels])).alias("_l"))
    each = each.select("field", F.col("_l.d").alias("_depth"), F.col("_l.s").alias("_s"), (F.size("_l.r") == F.size("_l.s")).alias("_long"), F.posexplode("_l.r").alias("_at", "_v")).withColumn("_o", F.get("_s", F.col("_at")))
    same = F.col("_v") == F.col("_o._x")
    by = each.groupBy("field", "_depth", "_at").agg(F.bool_and(F.col("_long") & (same | (kind(F.col("_v")) == F.col("_o._k")))).alias("_ok"), F.bool_and(same).alias("_same"),
                                                   F.min(F.char_length("_v")).alias("_a"), F.max(F.char_length("_v")).alias("_b"))
    known = F.create_map(*[v for depth, (_, classes) in enumerate(LEVELS) for key, _, c in classes for v in (F.lit(f"{depth}{key}"), F.lit(c))])
    often = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "").when(F.col("_a") == F.col("_b"), F.format_string("{%d}", "_a")).otherwise(F.format_string("{%d,%d}", "_a", "_b"))
    escaped = F.regexp_replace("_x", r"([^\p{L}\p{N} ])", r"\\$1")
    part = F.when(F.col("_same"), escaped).otherwise(F.concat(F.element_at(known, F.concat("_depth", "_k")), often))
    fits = steps.join(by, ["field", "_depth", "_at"]).groupBy("_depth", "field").agg(F.bool_and("_ok").alias("_ok"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", part.alias("p")))), lambda x: x["p"]), "").alias("pattern"),
                                                                                    F.max((F.col("_k") == "d") | F.col("_k").rlike(r"^[^\p{L}\p{N}\s]$")).alias("specific"))
    best = fits.where("_ok").groupBy("field").agg(F.min(F.struct("_depth", "pattern", "specific")).alias("b"))
    met = whole.join(best, "field", "left")
    narrow = F.col("b").isNotNull() & ~F.col("_wide")
    level = F.get(F.array(*[F.lit(n) for n, _ in LEVELS]), F.col("b._depth"))
    return met.select("field", F.when(narrow, level).otherwise("free").alias("level"), F.when(narrow, F.col("b.pattern")).otherwise(FREE[1]).alias("pattern"), "n_examples", F.coalesce(narrow & F.col("b.specific"), F.lit(False)).alias("specific"))


def has_class(pattern: Column) -> Column:
    """Whether a pattern generalises at all: it holds a class of characters."""
    return pattern.rlike(r"\\[dws]|(?<!\\)\[[^\]]+\]")


def has_anchor(pattern: Column) -> Column:
    """Whether a pattern holds what sets it apart from words: digits or escaped punctuation."""
    return pattern.rlike(r"\\[-./()_:;,]|\\d")
