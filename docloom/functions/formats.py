"""Catalogue of document formats: what each asks for, and how its dimensions weigh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name, specification, threshold, weights (text, structural, visual, design, technical), required headings, fields (name, type, required).
FORMATS = (
    ("abnt_artigo", "ABNT NBR 6022:2018", 0.85, (0.3, 0.25, 0.1, 0.1, 0.25), ("Resumo", "Abstract", "Introducao", "Conclusao", "Referencias"), (
      ("TITULO", "freetext", True),
      ("AUTORES", "freetext", True),
      ("RESUMO", "freetext", True),
      ("PALAVRAS_CHAVE", "freetext", True),
      ("ABSTRACT", "freetext", True),
      ("KEYWORDS", "freetext", True),
      ("INTRODUCAO", "freetext", True),
      ("REFERENCIAS", "freetext", True))),
    ("abnt_referencia", "ABNT NBR 6023:2018", 0.9, (0.4, 0.1, 0.05, 0.05, 0.4), ("REFERENCIAS",), (
      ("AUTOR", "freetext", True),
      ("TITULO", "freetext", True),
      ("EDICAO", "freetext", False),
      ("LOCAL", "freetext", True),
      ("EDITORA", "freetext", True),
      ("ANO", "integer", True),
      ("PAGINAS", "freetext", False))),
    ("abnt_relatorio_tecnico", "ABNT NBR 10719:2015", 0.85, (0.3, 0.25, 0.1, 0.1, 0.25), ("RESUMO", "OBJETIVO", "METODOLOGIA", "RESULTADOS", "CONCLUSAO", "REFERENCIAS"), (
      ("TITULO", "freetext", True),
      ("AUTORES", "freetext", True),
      ("INSTITUICAO", "freetext", True),
      ("RELATORIO_N", "doc_code", True),
      ("DATA", "iso_date", True),
      ("LOCAL", "freetext", True),
      ("RESUMO", "freetext", True),
      ("PALAVRAS_CHAVE", "freetext", True),
      ("OBJETIVO", "freetext", True),
      ("CONCLUSAO", "freetext", True))),
    ("abnt_tcc", "ABNT NBR 14724:2024", 0.85, (0.25, 0.3, 0.1, 0.1, 0.25), ("RESUMO", "ABSTRACT", "SUMARIO", "INTRODUCAO", "CONCLUSAO", "REFERENCIAS"), (
      ("TITULO", "freetext", True),
      ("AUTOR", "fullname", True),
      ("ORIENTADOR", "fullname", True),
      ("INSTITUICAO", "freetext", True),
      ("CURSO", "freetext", True),
      ("ANO", "integer", True),
      ("LOCAL", "freetext", True),
      ("RESUMO", "freetext", True),
      ("ABSTRACT", "freetext", True),
      ("PALAVRAS_CHAVE", "freetext", True),
      ("KEYWORDS", "freetext", True))),
    ("ata_reuniao", "generico", 0.85, (0.35, 0.2, 0.05, 0.05, 0.35), ("PARTICIPANTES", "PAUTA", "DELIBERACOES"), (
      ("ATA_NUMERO", "doc_code", True),
      ("DATA", "iso_date", True),
      ("HORA_INICIO", "freetext", True),
      ("HORA_FIM", "freetext", True),
      ("LOCAL", "freetext", True),
      ("ASSUNTO", "freetext", True),
      ("PARTICIPANTES", "freetext", True),
      ("PAUTA", "freetext", True),
      ("DELIBERACOES", "freetext", True),
      ("PROXIMA_REUNIAO", "iso_date", False))),
    ("contrato_simples", "generico", 0.85, (0.3, 0.2, 0.05, 0.05, 0.4), ("OBJETO", "VALOR", "VIGENCIA", "FORO"), (
      ("TITULO_CONTRATO", "freetext", True),
      ("CONTRATANTE", "freetext", True),
      ("CNPJ_CONTRATANTE", "freetext", True),
      ("CONTRATADA", "freetext", True),
      ("CNPJ_CONTRATADA", "freetext", True),
      ("OBJETO", "freetext", True),
      ("VALOR", "decimal_br", True),
      ("VIGENCIA", "freetext", True),
      ("FORO", "freetext", True),
      ("DATA_ASSINATURA", "iso_date", True))),
    ("laudo_nr12", "NR-12 (Portaria MTE)", 0.9, (0.2, 0.25, 0.05, 0.05, 0.45), ("IDENTIFICACAO", "EQUIPAMENTO", "INSPECAO", "CONCLUSAO"), (
      ("EMPRESA", "freetext", True),
      ("CNPJ_EMPRESA", "freetext", True),
      ("ENDERECO", "freetext", True),
      ("EQUIPAMENTO", "freetext", True),
      ("TAG_EQUIPAMENTO", "doc_code", True),
      ("FABRICANTE", "freetext", True),
      ("NS_EQUIPAMENTO", "doc_code", True),
      ("DATA_INSPECAO", "iso_date", True),
      ("RESPONSAVEL", "fullname", True),
      ("CREA", "doc_code", True),
      ("CONCLUSAO", "freetext", True))),
    ("nr13", "NR-13 (Portaria MTE)", 0.9, (0.2, 0.25, 0.05, 0.05, 0.45), ("IDENTIFICACAO", "EQUIPAMENTO", "INSPECAO", "CONCLUSAO"), (
      ("EMPRESA", "freetext", True),
      ("CNPJ_EMPRESA", "freetext", True),
      ("CATEGORIA", "freetext", True),
      ("CALDEIRA_TAG", "doc_code", True),
      ("PRESSAO_OPERACAO", "freetext", True),
      ("PMTA", "freetext", True),
      ("DATA_INSPECAO", "iso_date", True),
      ("PROXIMA_INSPECAO", "iso_date", True),
      ("RESPONSAVEL", "fullname", True),
      ("CREA", "doc_code", True),
      ("CONCLUSAO", "freetext", True))),
    ("nr35", "NR-35 (Portaria MTE)", 0.9, (0.2, 0.2, 0.05, 0.05, 0.5), ("IDENTIFICACAO", "LOCAL", "EQUIPE", "RISCO", "ASSINATURAS"), (
      ("EMPRESA", "freetext", True),
      ("PT_NUMERO", "doc_code", True),
      ("DATA_EMISSAO", "iso_date", True),
      ("VALIDADE", "freetext", True),
      ("LOCAL_TRABALHO", "freetext", True),
      ("ALTURA", "freetext", True),
      ("DESCRICAO_TAREFA", "freetext", True),
      ("EXECUTANTE", "fullname", True),
      ("MATRICULA", "doc_code", True),
      ("SUPERVISOR", "fullname", True),
      ("TREINAMENTO_VALIDO_ATE", "iso_date", True))),
    ("procuracao_simples", "generico", 0.9, (0.25, 0.15, 0.05, 0.05, 0.5), ("PODERES", "PRAZO"), (
      ("OUTORGANTE", "fullname", True),
      ("CPF_OUTORGANTE", "cpf", True),
      ("RG_OUTORGANTE", "freetext", True),
      ("ENDERECO_OUTORGANTE", "freetext", True),
      ("OUTORGADO", "fullname", True),
      ("CPF_OUTORGADO", "cpf", True),
      ("PODERES", "freetext", True),
      ("PRAZO", "freetext", True),
      ("LOCAL", "freetext", True),
      ("DATA", "iso_date", True))),
)


#: Titles of the formats that come with the package, by name.
TITLES = {"abnt_artigo": "Artigo em periódico", "abnt_referencia": "Referência bibliográfica", "abnt_relatorio_tecnico": "Relatório técnico", "abnt_tcc": "Trabalho de conclusão de curso",
          "ata_reuniao": "Ata de reunião", "contrato_simples": "Contrato simples", "laudo_nr12": "Laudo de máquina", "nr13": "Inspeção de caldeira", "nr35": "Trabalho em altura", "procuracao_simples": "Procuração simples"}
#: What a value of each type looks like.
HINTS = {"iso_date": "yyyy-MM-dd", "cpf": "000.000.000-00", "decimal_br": "1.234,56", "integer": "digits", "doc_code": "AB-2026-0001", "fullname": "first and last names", "freetext": "one line"}
#: Gold texts of a format, and so examples of a field.
GOLDS = 3
_OWN: dict[str, tuple] = {}


class FormatNotFound(KeyError):
    """No format has that name."""


def register(name: str, title: str, spec: str, threshold: float, weights: tuple[float, ...], headings: tuple[str, ...], fields: tuple[tuple[str, str, bool], ...]) -> None:
    """Add a format of one's own for this session, or replace one: it is listed, loaded and inferred from like the others.

    weights: text, structural, visual, design, technical, from 0 on and not all 0; fields: name, type, required."""
    if len(weights) != 5 or min(weights) < 0 or not sum(weights):
        raise ValueError(f"{name}: five weights from 0 on, not all 0")
    if not fields or len({f for f, _, _ in fields}) < len(fields):
        raise ValueError(f"{name}: fields of different names, one at least")
    if unknown := {t for _, t, _ in fields} - HINTS.keys():
        raise ValueError(f"{name}: no field types: {', '.join(sorted(unknown))}")
    if not 0 <= threshold <= 1:
        raise ValueError(f"{name}: a threshold from 0 to 1")
    _OWN[name] = (title, (name, spec, float(threshold), tuple(map(float, weights)), tuple(headings), tuple(fields)))


def unregister(name: str) -> None:
    _OWN.pop(name, None)


def list_formats() -> list[str]:
    return sorted({f[0] for f in FORMATS} | _OWN.keys())


def load_format(name: str) -> dict:
    """The format's parts: fields as (name, type, required)."""
    title, found = _OWN.get(name) or (TITLES.get(name), next((f for f in FORMATS if f[0] == name), None))
    if found is None:
        raise FormatNotFound(f"{name}: there are {', '.join(list_formats())}")
    n, spec, threshold, weights, headings, fields = found
    return {"name": n, "title": title, "spec": spec, "threshold": threshold, "weights": dict(zip(("text", "structural", "visual", "design", "technical"), weights, strict=True)),
            "required_headings": list(headings), "fields": list(fields)}


def labels(fields: list[tuple[str, str, bool]]) -> dict[str, str]:
    """The label of each field in a text. A field that is a detail of another one ends in its name and is written after it, so that no label ends in another."""
    names, out = {f for f, _, _ in fields}, {}
    for f in names:
        first, _, last = f.rpartition("_")
        out[f] = f"{last.capitalize()} ({first.replace('_', ' ').lower()})" if first and last in names else f.replace("_", " ").capitalize()
    return out


def field_rows(names: list[str] | None = None) -> list[tuple]:
    """For each field: name of the format, its number among them, number of the field, field, type, required, label, code (the letters its codes begin with), hint."""
    out = []
    for i, name in enumerate(names or list_formats()):
        fields = load_format(name)["fields"]
        label = labels(fields)
        out += [(name, i, j, f, t, required, label[f], "".join(w[0] for w in f.split("_")), HINTS[t]) for j, (f, t, required) in enumerate(fields)]
    return out


def _padded(number: str, width: int) -> str:
    return f"lpad(CAST({number} AS STRING), {width}, '0')"


def value_sql(n: str) -> str:
    """SQL, the same in Spark and DuckDB: the value number n (SQL of a whole number from 0 on) of a field with columns type, label, code."""
    given = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(("Ana", "Bruno", "Carla", "Davi", "Elisa")))
    family = " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(("Alves", "Barros", "Costa", "Duarte", "Esteves", "Freitas", "Gomes")))
    nine = f"CAST(100000001 + ({n} * 7919) % 800000000 AS STRING)"
    digits = [f"CAST(substring({nine}, {i}, 1) AS INT)" for i in range(1, 10)]
    check = lambda of: "((" + " + ".join(f"{d} * {len(of) + 1 - i}" for i, d in enumerate(of)) + ") * 10 % 11 % 10)"
    one = check(digits)
    cpf = f"concat(substring({nine}, 1, 3), '.', substring({nine}, 4, 3), '.', substring({nine}, 7, 3), '-', CAST({one} AS STRING), CAST({check([*digits, one])} AS STRING))"
    return (f"CASE type WHEN 'iso_date' THEN concat(CAST(2010 + {n} % 17 AS STRING), '-', {_padded(f'1 + {n} % 12', 2)}, '-', {_padded(f'1 + {n} % 28', 2)})"
            f" WHEN 'integer' THEN CAST(1990 + {n} % 40 AS STRING) WHEN 'decimal_br' THEN concat(CAST(1 + {n} % 900 AS STRING), '.', {_padded(f'{n} % 1000', 3)}, ',50')"
            f" WHEN 'doc_code' THEN concat(code, '-', CAST(2020 + {n} % 7 AS STRING), '-', {_padded(n, 9)}) WHEN 'cpf' THEN {cpf}"
            f" WHEN 'fullname' THEN concat(CASE {n} % 5 {given} END, ' ', CASE {n} % 7 {family} END) ELSE concat(label, ' numero ', CAST({n} AS STRING)) END")


FIELD_SCHEMA = "name string, format_no int, field_no int, field string, type string, required boolean, label string, code string, hint string"


def examples(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Three examples of each field, by the rule of its type, all different within a format: the columns of field_rows, example_no, example."""
    rows = spark.createDataFrame(field_rows(names), FIELD_SCHEMA).crossJoin(spark.range(GOLDS).select(F.col("id").cast("int").alias("example_no")))  # a catalogue times 3
    return rows.withColumn("example", F.expr(value_sql("(example_no + 3 * field_no + format_no)")))


def texts(values: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """One text for each of keys (which hold name): the format's required headings, then a line for each value of values (keys, field_no, label, value) that isn't null."""
    heads = values.sparkSession.createDataFrame([(n, "\n".join(load_format(n)["required_headings"])) for n in names or list_formats()], "_n string, _heads string")
    line = F.when(F.col("value").isNotNull(), F.struct("field_no", F.concat("label", F.lit(": "), "value").alias("line")))
    made = values.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    return made.join(F.broadcast(heads), F.col("name") == F.col("_n")).select(*keys, F.concat_ws("\n", "_heads", F.transform("_lines", lambda x: x["line"])).alias("text"))


def golds(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Three texts of each format, the examples in them: name, format_no, example_no, text."""
    return texts(examples(spark, names).withColumnRenamed("example", "value"), ["name", "format_no", "example_no"], names)


def catalogue(spark: SparkSession) -> DataFrame:
    """A row for each format: name, spec, threshold, n_fields, n_required, n_headings."""
    rows = [(f["name"], f["spec"], f["threshold"], len(f["fields"]), sum(r for _, _, r in f["fields"]), len(f["required_headings"])) for f in map(load_format, list_formats())]
    return spark.createDataFrame(rows, "name string, spec string, threshold double, n_fields int, n_required int, n_headings int")
