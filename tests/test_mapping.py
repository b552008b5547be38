"""Rules-mode mapping of files, inventories, fingerprints, the visual dimension and the command line."""

import json

import pytest

from docloom import __main__ as cli
from docloom.operators import conformity
from docloom.plans import mapping
from docloom.sources import docx
from test_files import W, file_of, files, p, table

HEADER = f"<w:hdr {W}>{p('XXXX')}{p('Rev. 00')}{p('Data:')}</w:hdr>"
TEMPLATE = file_of(p("CAPA") + p("1. OBJETIVO") + p("") + p("2. APLICACAO") + p("") + p("3. ANEXOS GERAIS") + p("") + p("resta ____") + table(["Rev", "Data", "Alteração"], ["", "", ""]), header1=HEADER)


def source(scope, history=True):
    body = p("1. FINALIDADE") + p("Definir tudo") + p(f"2. {scope}") + p("Vale sempre") + p("3. OUTRA COISA QUALQUER") + p("nada")
    rows = [["Versão", "Data", "Alteração", "Autor"], ["00", "01/02/2020", "Emissão", "Ana"], ["", "", "", ""]]
    return file_of(body + (table(*rows) if history else ""), header1=f"<w:hdr {W}>{p('IT.PRO.', 'URE.', '01.0007')}{p('Ver.: 3')}</w:hdr>")


def texts(content, kind="paragraph", part="body"):
    return [b["text"] for b in docx.blocks_of("x", content) if b["kind"] == kind and b["part"] == part]


def test_rules_mode(spark):
    done = mapping.map_sections(spark, TEMPLATE, files(spark, a=source("ESCOPO"), b=source("ZZZ YYY", history=False), c=b"broken"), "2024-06-01")
    made = {r.path: r for r in done.files.collect()}
    a, b = bytes(made["a"].content), bytes(made["b"].content)
    assert made["c"].content is None and made["c"].error.startswith("BadZipFile")
    assert texts(a) == ["CAPA", "1. OBJETIVO", "Definir tudo", "2. APLICACAO", "Vale sempre", "3. ANEXOS GERAIS", "", "resta ____"] and texts(b)[4] == ""
    assert texts(a, "cell") == ["Rev", "Data", "Alteração", "00", "01/02/2020", "Emissão (Ana)", "01", "2024-06-01", "Migração para o novo modelo padrão."]
    assert texts(b, "cell")[3:] == ["00", "2024-06-01", "Emissão inicial"]
    assert texts(a, part="header1") == ["IT.PRO.URE.01.0007", "Rev. 03", "Data: 2024-06-01"]
    report = {r.path: r for r in done.report.collect()}
    assert report["a"].mapped == ["FINALIDADE", "ESCOPO"] and report["a"].unmapped == ["OUTRA COISA QUALQUER"] and report["a"].unfilled == ["ANEXOS GERAIS"] and report["a"].tables_filled == 1 and report["a"].orphan_paragraphs == ["resta ____"]
    assert report["b"].unfilled == ["APLICACAO", "ANEXOS GERAIS"] and report["c"].error and report["c"].mapped == [] and report["c"].unfilled == ["OBJETIVO", "APLICACAO", "ANEXOS GERAIS"]
    with pytest.raises(ValueError, match="unknown similarity"):
        mapping.map_sections(spark, TEMPLATE, files(spark, a=source("X Y Z")), "2024-06-01", similarity="magic")
    with pytest.raises(ValueError, match="can't be read"):
        mapping.map_sections(spark, b"no", files(spark, a=source("X Y Z")), "2024-06-01")


def test_choice_of_matches(spark):
    found = spark.createDataFrame([(1, 1, "FINALIDADE"), (1, 2, "COISA NOVA"), (2, 1, "COISA NOVA")], "doc_id long, seq int, name string")
    targets = ["OBJETIVO", "NOVIDADES"]
    pick = lambda df: {(r.doc_id, r.seq): (r.target_name, r.method) for r in df.collect()}
    vectors = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0]), (2, 1, [0.1, 0.9])], "doc_id long, seq int, vector array<double>")
    aims = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.0, 2.0])], "target_id int, vector array<double>")
    by_words = {(1, 1): ("OBJETIVO", "synonym"), (1, 2): (None, "miss"), (2, 1): (None, "miss")}
    by_vectors = {(1, 1): ("OBJETIVO", "embedding"), (1, 2): ("NOVIDADES", "embedding"), (2, 1): ("NOVIDADES", "embedding")}
    assert pick(mapping.choose(found, targets)) == pick(mapping.choose(found, targets, "llm")) == pick(mapping.choose(found, targets, "string", vectors, aims)) == by_words
    assert pick(mapping.choose(found, targets, "embeddings", vectors, aims)) == pick(mapping.choose(found, targets, "auto", vectors, aims)) == by_vectors
    answers = spark.createDataFrame([("COISA NOVA", "NOVIDADES", 0.7), ("COISA NOVA", "NOWHERE", 0.9)], "name string, target_name string, score double")
    assert pick(mapping.choose(found, targets, "llm", answers=answers)) == {(1, 1): (None, "miss"), (1, 2): ("NOVIDADES", "llm"), (2, 1): ("NOVIDADES", "llm")}


def test_inventory_and_fingerprint(spark):
    control = "<w:sdt><w:sdtPr><w:date/></w:sdtPr><w:sdtContent><w:tc>" + p("texto") + "</w:tc></w:sdtContent></w:sdt>"
    body = p("TITULO GERAL") + p("") + p("texto", style="ListBullet") + f"<w:tbl><w:tr><w:tc>{p('Nome:')}</w:tc>{control}</w:tr></w:tbl>" + p("Parte", style="Heading 2") + p("item", num=(1, 0))
    blocks = docx.read_blocks(files(spark, a=file_of(body, header1=f"<w:hdr {W}>{p('{{CODIGO}}')}{p('')}</w:hdr>", footer2=f"<w:ftr {W}>{p('fim')}</w:ftr>"), b=b"broken")).withColumnRenamed("path", "doc_id")
    got = [(r.slot_id, r.location, r.kind, r.fillable) for r in mapping.slot_inventory(blocks).orderBy("seq").collect()]
    assert got == [("body_para_0", "body", "data", False), ("body_para_1", "body", "empty", True), ("body_para_2", "body", "data", False), ("body_para_3", "body", "data", False), ("body_para_4", "body", "data", False), ("cell_t0_r0_c0", "cell", "label_value", True),
                   ("cell_t0_r0_c1", "cell", "placeholder", True), ("header_para_word_header1_p0", "header", "placeholder", True), ("footer_para_word_footer2_p0", "footer", "data", False)]
    metrics = {r.metric: r.n for r in conformity.fingerprint(mapping.file_fingerprint(blocks)).collect()}
    assert metrics == {"headings_h2": 1, "tables_count": 1, "table_cells_total": 2, "sections_count": 1, "list_paragraphs": 2}


def test_visual_dimension(spark):
    grid = lambda *docs: spark.createDataFrame([(d, 1, r, line) for d, lines in docs for r, line in enumerate(lines)], "doc_id long, page int, row int, line string")
    template = ["█████     ", "          ", "text      "]
    got = {(r.doc_id, r.field_or_excerpt): r.severity for r in mapping.visual_dimension(grid((0, template)), grid((1, template), (2, ["██████████"] * 3))).collect()}
    assert got == {(2, "overall_density"): "critical"}
    with pytest.raises(ValueError, match="no grid"):
        mapping.visual_dimension(grid((0, template)).limit(0), grid((1, template)))


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(source("ESCOPO"))
    (tmp_path / "template.docx").write_bytes(TEMPLATE)
    lines = lambda: [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    assert cli.main(["list-formats"]) == 0 and len(lines()) == 10
    assert cli.main(["extract", str(tmp_path / "in")]) == 0 and "Definir tudo" in lines()[0]["text"]
    assert cli.main(["map-sections", str(tmp_path / "template.docx"), str(tmp_path / "in"), str(tmp_path / "out"), "--today", "2024-06-01"]) == 0
    assert lines()[0]["mapped"] == ["FINALIDADE", "ESCOPO"] and spark.read.parquet(str(tmp_path / "out/files")).count() == 1
    assert cli.main(["conformity", str(tmp_path / "template.docx"), str(tmp_path / "template.docx")]) == 1  # a blank is left over
    assert lines()[0]["n_critical"] == 1
    golds, examples = tmp_path / "golds.json", tmp_path / "examples.json"
    golds.write_text("\n".join(json.dumps({"gold_no": i, "text": f"Codigo: AB-{i}"}) for i in range(2)))
    examples.write_text("\n".join(json.dumps({"field": "CODIGO", "example_no": i, "example": f"AB-{i}"}) for i in range(2)))
    (tmp_path / "t.docx").write_bytes(file_of(p("Codigo: {{CODIGO}}")))
    (tmp_path / "in2").mkdir()
    (tmp_path / "in2" / "x.docx").write_bytes(file_of(p("Codigo: ZZ-9")))
    assert cli.main(["normalize", str(tmp_path / "t.docx"), str(tmp_path / "in2"), str(golds), str(examples), str(tmp_path / "n")]) == 0
    assert {r["tier"]: r["n"] for r in lines()}["high"] == 1 and [r.text for r in spark.read.parquet(str(tmp_path / "n/rendered")).collect()] == ["Codigo: ZZ-9"]
    with pytest.raises(SystemExit):
        cli.main(["nonsense"])
