"""Slots, placeholders, headers and plans on small templates."""

from pyspark.sql import functions as F

from docloom.operators import headers, layout, numbering, rendering, slots


def paragraphs(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx int, text string")


def test_kinds(spark):
    cases = {"": "empty", "  ": "empty", "{{X}}": "placeholder", "[FOO]": "placeholder", "Nome: ____": "label_value", "Nome:": "label_value", "Descrever o processo": "instruction", "Descreverei": "data",
             "1. OBJETIVO: (Descrição clara)": "heading_with_hint", "1. OBJETIVO": "heading", "Chefe da Divisão X": "placeholder", "O paciente fez raio X": "data", "XXXX": "placeholder", "texto": "data", "a......": "placeholder"}
    rows = spark.createDataFrame([(k,) for k in cases], "text string").select("text", slots.kind_of(F.col("text")).alias("kind"))
    assert {r.text: r.kind for r in rows.collect()} == cases


def test_empty_paragraphs_under_headings(spark):
    got = {r.idx: r for r in slots.body_slots(paragraphs(spark, "TITULO DO DOCUMENTO", *[""] * 19, "OBJETIVO GERAL", "", "", "texto", "", "Contatos:", "", "Lista:", "Listar os nomes", None)).collect()}
    assert not any(got[i].fillable for i in range(0, 21)) and got[21].fillable and got[22].fillable and not got[24].fillable
    assert got[25].kind == "heading" and not got[25].fillable and got[27].kind == "heading" and got[28].fillable
    assert got[22].context == "OBJETIVO GERAL" and got[0].context == "" and got[29].kind == "empty"
    assert slots.body_slots(paragraphs(spark, "x").limit(0)).count() == 0


def test_cells_and_tables(spark):
    rows = [(1, 0, r, c, t) for r, line in enumerate([["Nome", "Fone"], ["Ana", ""], ["", ""], [None, " "]]) for c, t in enumerate(line)]
    cells = spark.createDataFrame(rows, "doc_id long, table_no int, row int, col int, text string")
    got = {(r.row, r.col): r for r in slots.cell_slots(cells, cells).collect()}
    assert got[1, 1].context == 'column="Fone" | Ana' and got[0, 0].context == "Fone" and got[1, 1].fillable and not got[1, 0].fillable
    table = slots.empty_tables(cells).collect()[0]
    assert (list(table.headers), list(table.sub_headers), table.empty_rows) == (["Nome", "Fone"], ["Ana", ""], 2)
    fills = spark.createDataFrame([(1, 0, 2, 0, "novo"), (1, 0, 9, 9, "fora")], "doc_id long, table_no int, row int, col int, new_text string")
    filled = {(r.row, r.col): r.text for r in rendering.cell_fills(cells, fills).collect()}
    assert filled[2, 0] == filled[2, 1] == "novo" and filled[1, 0] == "Ana" and filled[3, 0] is None


def test_placeholders_in_templates(spark):
    got = [(r.kind, r.token) for r in slots.template_placeholders(paragraphs(spark, "Rev. 00 (TITULO) {{A}} <<B c>> <nome do setor> 00/00/00 §§§ ......... ___", "Elaborado:", "AXXXB", None, "")).collect()]
    assert sorted(got) == sorted([("revision", "Rev. 00"), ("parens", "TITULO"), ("curly", "{{A}}"), ("double_angle", "<<B c>>"), ("angle", "<nome do setor>"), ("repeated", "00/00/00"), ("symbol_run", "§§§"),
                                  ("dot_leader", "........."), ("underscore", "___"), ("label_empty", "Elaborado:")])


def test_header_metadata(spark):
    texts = ["IT.PRO.", "URE.", "01.0005", "PARTIDA DA ÁREA DE SÍNTESE", "Ver.: 1", "Aprovadores: Ana Souza Fl. 1/3"]
    runs = spark.createDataFrame([(1, "word/header1.xml", i, i, t) for i, t in enumerate(texts)] + [(2, "word/header1.xml", 0, 0, "nada")], "doc_id long, part string, run_no int, paragraph int, text string")
    cells = spark.createDataFrame([(1, 0, r, c, t) for r, line in enumerate([["Data", "Autor", "Alteração"], ["", "", ""], ["01/02/2020", "Ana", "Emissão"]]) for c, t in enumerate(line)],
                                  "doc_id long, table_no int, row int, col int, text string")
    got = {r.doc_id: r for r in headers.header_metadata(runs, cells).collect()}
    assert (got[1].document_code, got[1].title, got[1].version, got[1].approver, got[1].author, got[1].source_date) == ("IT.PRO.URE.01.0005", "PARTIDA DA ÁREA DE SÍNTESE", "01", "Ana Souza", "Ana", "01/02/2020")
    assert got[2].document_code is None and got[2].title is None and got[2].author is None
    subs = {r.doc_id: [tuple(s) for s in r.subs] for r in headers.substitutions(headers.header_metadata(runs, cells), "2024-01-01").collect()}
    assert subs[2] == [("Data:", "Data: 2024-01-01")] and [p for p, _ in subs[1]] == ["XXXX", "Rev. 00", "Elaborado:", "Aprovado:", "Data:", "TITULO"]
    history = [(r.rev, r.date, r.change) for r in headers.history_rows(cells).collect()]
    assert history == [(0, "01/02/2020", "Emissão (Ana)")]
    spec = headers.history_spec(headers.history_rows(cells), runs, "2024-01-01").orderBy("doc_id", "rev").collect()
    assert [(r.doc_id, r.rev, r.change) for r in spec] == [(1, "00", "Emissão (Ana)"), (1, "01", headers.MIGRATION), (2, "00", headers.FIRST_ISSUE)]


def test_sections_and_rewrites(spark):
    sections = spark.createDataFrame([("ANEXOS", "um\n\n- dois\n1. três"), ("DEFINICOES", "Loop teste: x\nesta linha tem muitas palavras: y"), ("OBJETIVO", "a: b"), ("ANEXOS", None)], "name string, content string")
    assert [r.content for r in rendering.section_clean_up(sections).collect()] == ["• um\n\n- dois\n1. três", "Loop teste – x\nesta linha tem muitas palavras: y", "a: b", None]
    blocks = paragraphs(spark, " troca ", "fica", None)
    new = spark.createDataFrame([(1, "troca", "nova")], "doc_id long, match_text string, replacement_text string")
    assert [r.text for r in rendering.paragraph_rewrites(blocks, new).orderBy("idx").collect()] == ["nova", "fica", None]


def test_long_counts_and_bands(spark):
    def plain(n):
        out = ""
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
        return out

    numbers = [1, 26, 27, 702, 703, 18278, 18279, 475254, 475255, 2**31 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", numbering.letters(F.col("n")).alias("s")).collect()
    assert all(r.s == plain(r.n) for r in rows)
    filled = [5, 5, 5, 5, 1, 5, 5, 5, 5, 5, 9, 9, 9, 9, 9, 9, 9, 9]
    grid = spark.createDataFrame([(1, 1, i, "█" * n + " " * (10 - n)) for i, n in enumerate(filled)], "doc_id long, page int, row int, line string")
    assert sorted(tuple(r) for r in layout.layout_table_bands(grid).select("row_start", "row_end").collect()) == [(0, 3), (5, 9), (10, 17)]
