import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import text, validators
from docloom.operators import fields, placeholders


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


@pytest.mark.parametrize(("validator", "good", "bad"), [
    (validators.valid_cpf, ["529.982.247-25", "52998224725"], ["111.111.111-11", "529.982.247-24", "1", "", None]),
    (validators.valid_iso_date, ["2026-01-15", " 2026-01-15 ", "20260115", "2026-W03-4", "2026W034", "2020-W53"], ["2026-1-5", "2026-02-30", "2026-W54", "2021-W53", "31/01/2026", "", None]),
    (validators.valid_br_date, ["28/02/2026", " 01/01/1999 "], ["31/02/2026", "1/1/2026", "2026-01-01", None]),
    (validators.valid_email, ["a.b+c@x.org", "José@ex.com.br"], ["a@b", "@x.org", None]),
    (validators.valid_phone_br, ["(81) 99999-1234", "8133331234"], ["999-1234", None]),
    (validators.valid_cep, ["12345-678", "12345678"], ["1234-567", None]),
    (validators.valid_state, ["sp", " RJ "], ["XX", "", None]),
])
def test_validators(spark, validator, good, bad):
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [r[0] for r in df.select(validator(F.col("v"))).collect()] == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(("kind", "good", "bad"), [("name", "Ana", "01/02/2026"), ("phone", "(81) 99999-1234", "Ana"), ("version", "1.0.2", "v1"), ("free", "x", ""), ("date", "01/02/2026", "2026-02-01")])
def test_column_types(spark, kind, good, bad):
    df = spark.createDataFrame([(good, kind), (bad, kind)], "v string, k string")
    assert [r[0] for r in df.select(validators.valid_for_column(F.col("v"), F.col("k"))).collect()] == [True, False]


def test_replaced_values_are_not_looked_at_again(spark):
    rows = [("{{A}} and {{B}} and {{AB}}",), ("",), ("no token",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(text.replace_tokens(F.col("t"), {"{{A}}": F.lit("{{B}}$1\\"), "{{B}}": F.lit("b"), "{{AB}}": F.lit(None).cast("string")})).collect()
    assert [r[0] for r in out][:3] == ["{{B}}$1\\ and b and ", "", "no token"]


def test_heading_keys(spark):
    df = spark.createDataFrame([("Definições e siglas",), ("  3. Ação/Reação ",), ("",)], "t string")
    assert [r[0] for r in df.select(text.heading_key(F.col("t"))).collect()] == ["DEFINICOES E SIGLAS", "3 ACAO REACAO", ""]


def test_placeholder_kinds_and_first_occurrences(spark):
    docs = spark.createDataFrame([(1, "Código: {{X}} e {{ X }} {Y} [Z] <<W>> __V__ ___ e ____"), (2, "nada"), (3, None)], "doc_id long, text string")
    rows = placeholders.placeholder_scan(docs).orderBy("field_no").collect()
    assert [(r.kind, r.name) for r in rows] == [("mustache", "X"), ("chevron", "W"), ("named_blank", "V"), ("brace", "Y"), ("bracket", "Z"), ("anon_blank", "BLANK_1"), ("anon_blank", "BLANK_2")]
    assert rows[0].start == 8 and rows[0].context_before == "Código:" and rows[0].token == "{{X}}"


def test_patterns_from_examples(spark):
    golds = spark.createDataFrame([(i, f"LAUDO\nCodigo: AB-{i}\nCliente: Empresa {i}\nCPF 529.982.247-2{i}\n") for i in range(3)], "gold_no int, text string")
    examples = spark.createDataFrame([("codigo", i, f"AB-{i}") for i in range(3)] + [("cliente", i, f"Empresa {i}") for i in range(3)] + [("cpf", i, f"529.982.247-2{i}") for i in range(3)]
                                     + [("outro", 0, "nowhere")], "field string, example_no int, example string")
    found = {p.field: p for p in fields.infer_patterns(golds, examples)}
    assert found["codigo"].labels == ("Codigo",) and found["codigo"].shape == "doc_code" and found["codigo"].coverage == 1.0
    assert found["cliente"].shape == "freetext" and found["cliente"].coverage == 1.0
    assert found["cpf"].labels == () and found["cpf"].coverage == 1.0
    assert found["outro"].pattern == fields.NEVER and found["outro"].coverage == 0.0
    assert re.search(found["codigo"].pattern, "codigo:  ZZ-99")[1] == "ZZ-99"


def test_mapping_tiers_and_summary(spark):
    docs = spark.createDataFrame([(1, "Codigo: A-1\nData: 2026-01-01"), (2, "Codigo: A-2"), (3, ""), (4, None)], "doc_id long, text string")
    wide = fields.extract_wide(docs, {"codigo": r"Codigo: (\S+)", "data": r"Data: (\S+)"})
    answers = spark.createDataFrame([(2, "data", "2026-02-02", 0.8), (3, "codigo", " ", 0.9)], "doc_id long, field string, answer string, answer_confidence double")
    mapping = fields.mapping_long(wide, ["codigo", "data"], answers)
    assert dict(values(fields.tier_by_doc(mapping, ["codigo", "data"]), "doc_id", "tier")) == {1: "high", 2: "medium", 3: "low", 4: "low"}
    summary = {r.doc_id: r for r in fields.mapping_summary(mapping).collect()}
    assert (summary[2].n_regex, summary[2].n_llm, summary[2].n_missing, summary[2].average_confidence) == (1, 1, 0, 0.9)
    counts = dict(values(fields.tier_counts(fields.tier_by_doc(mapping, ["codigo"])), "tier", "n"))
    assert sum(counts.values()) == 4 and counts["error"] == 0


def test_an_example_with_a_text_of_its_number_is_only_looked_for_there(spark):
    golds = spark.createDataFrame([(0, "Outro: abc\n"), (1000, "Nome: abc\n")], "gold_no int, text string")  # numbers with a gap
    examples = spark.createDataFrame([("nome", 1000, "abc"), ("nome", 7, "abc")], "field string, example_no int, example string")
    got = sorted((r.label, r.example_no, r.gold_no) for r in fields.example_labels(golds, examples).collect())
    assert got == [("Nome", 7, 1000), ("Nome", 1000, 1000), ("Outro", 7, 0)]
