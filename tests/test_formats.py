import pytest
from pyspark.sql import functions as F

from docloom.functions import formats, validators
from docloom.operators import conformity, fields


@pytest.fixture(scope="module")
def patterns(spark):
    return fields.infer_formats(formats.golds(spark), formats.examples(spark))


def test_examples_are_in_their_gold_texts(spark):
    """Three texts a format, three different examples a field, each in the text of its number."""
    rows = formats.examples(spark).join(formats.golds(spark).drop("format_no"), ["name", "example_no"]).collect()
    assert len(rows) == 3 * len(formats.field_rows()) and all(f"{r['label']}: {r['example']}" in r["text"].split("\n") for r in rows)
    assert len({(r["name"], r["field"], r["example"]) for r in rows}) == len(rows)
    for r in rows:
        assert all(h in r["text"].split("\n") for h in formats.load_format(r["name"])["required_headings"])


def test_examples_are_valid(spark):
    df = formats.examples(spark)
    for kind in ("cpf", "iso_date"):
        assert df.where(F.col("type") == kind).select(F.bool_and(validators.FIELD_VALIDATORS[kind](F.col("example")))).collect()[0][0]


def test_no_label_ends_in_another():
    for name in formats.list_formats():
        own = [x.lower() for x in formats.labels(formats.load_format(name)["fields"]).values()]
        assert len(set(own)) == len(own) and not [(a, b) for a in own for b in own if a != b and a.endswith(b)]


def test_patterns_give_the_planted_values(spark, patterns):
    """Each format's patterns read back, from each of its gold texts, what was planted there and nothing else."""
    assert {n: sorted(p.field for p in own) for n, own in patterns.items()} == {n: sorted(f for f, _, _ in formats.load_format(n)["fields"]) for n in formats.list_formats()}
    assert all(p.coverage == 1.0 for own in patterns.values() for p in own)
    found = fields.extract_formats(formats.golds(spark), patterns)
    want = formats.examples(spark).select("name", "format_no", "example_no", "field", F.col("example").alias("value"))
    assert found.exceptAll(want.select(*found.columns)).count() == 0 and found.count() == want.count()


def test_format_of_ones_own(spark):
    """It is listed, inferred from and judged like the others; bad ones are refused."""
    formats.register("recibo", "Recibo", "-", 0.8, (0, 1, 0, 0, 1), ("RECIBO",), (("VALOR", "decimal_br", True), ("DATA", "iso_date", False)))
    try:
        assert "recibo" in formats.list_formats() and formats.load_format("recibo")["title"] == "Recibo"
        found = fields.infer_formats(formats.golds(spark, ["recibo"]), formats.examples(spark, ["recibo"]))
        docs = spark.createDataFrame([(1, "recibo", "RECIBO\nValor: 10,50\nData: 2026-01-02"), (2, "recibo", "Valor: ??\nData: 2026-02-30"), (3, "recibo", ""), (4, "recibo", None), (5, "other", "x"), (6, None, "x")], "doc_id int, name string, text string")
        rows = spark.createDataFrame(formats.field_rows(["recibo"]), formats.FIELD_SCHEMA)
        states = conformity.field_status(fields.extract_formats(docs, found).join(rows, ["name", "field"]))
        assert {(r["doc_id"], r["field"]): (r["value"], r["status"]) for r in states.collect()} == {
            (1, "VALOR"): ("10,50", "ok"), (1, "DATA"): ("2026-01-02", "ok"), (2, "VALOR"): (None, "missing"), (2, "DATA"): ("2026-02-30", "invalid"),
            (3, "VALOR"): (None, "missing"), (3, "DATA"): (None, "absent"), (4, "VALOR"): (None, "missing"), (4, "DATA"): (None, "absent")}
        got = {r["doc_id"]: tuple(r)[2:] for r in conformity.format_verdicts(docs, states, [formats.load_format("recibo")]).collect()}
        assert got == {1: (0, 0, 1.0, True), 2: (2, 1, 0.0, False), 3: (1, 1, 0.25, False), 4: (1, 1, 0.25, False)}
    finally:
        formats.unregister("recibo")
    with pytest.raises(formats.FormatNotFound):
        formats.load_format("recibo")
    for bad in (dict(weights=(0, 0, 0, 0, 0)), dict(fields=()), dict(fields=(("A", "colour", True),)), dict(threshold=2), dict(fields=(("A", "cpf", True), ("A", "cpf", True)))):
        with pytest.raises(ValueError):
            formats.register(**(dict(name="x", title="x", spec="x", threshold=0.5, weights=(1, 1, 1, 1, 1), headings=(), fields=(("A", "cpf", True),)) | bad))


def test_no_documents(spark, patterns):
    none = spark.createDataFrame([], "doc_id int, name string, text string, field string")
    assert fields.extract_formats(none, patterns).count() == 0
    assert fields.infer_formats(formats.golds(spark, ["nr13"]).limit(0), formats.examples(spark, ["nr13"]).limit(0)) == {}
