"""Word files in and out, numbering, sections, merged cells, tokens across runs, layouts and plans on small inputs."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import layout, numbering, rendering, sections, tables
from docloom.sources import docx, docx_files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def file_of(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def p(*runs, style=None, num=None):
    inner = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num[1]}"/><w:numId w:val="{num[0]}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{inner}</w:pPr>" + "".join(f"<w:r><w:rPr><w:i/></w:rPr><w:t>{t}</w:t></w:r>" for t in runs) + "</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" if isinstance(c, str) else f'<w:tc><w:tcPr><w:gridSpan w:val="{c[1]}"/>{c[2]}</w:tcPr>{p(c[0])}</w:tc>' for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def greedy_tables(lines, least=5):
    """The edges of each column, then bands from left to right, as plain loops."""
    found = []
    for c in range(max(map(len, lines), default=0)):
        runs, start = [], None
        for r in range(len(lines) + 1):
            edge = r < len(lines) and c < len(lines[r]) and lines[r][c] in "█▓▒░"
            if edge and start is None:
                start = r
            elif not edge and start is not None:
                runs.append((r - start, -start))
                start = None
        if runs and max(runs)[0] >= least:
            n, s = max(runs)
            found.append((-s, -s + n - 1))
    bands = []
    for a, b in found:
        for band in bands:
            if max(band[0], a) <= min(band[1], b):
                band[:] = [max(band[0], a), min(band[1], b), band[2] + 1]
                break
        else:
            bands.append([a, b, 1])
    return sorted(tuple(x) for x in bands if x[2] >= 2 and x[1] - x[0] + 1 >= least)


def test_sparse_tables(spark):
    rng = random.Random(4)
    pages = {}
    for k in range(60):
        lines = [[rng.choice("  ░▒") if rng.random() < 0.15 else " " for _ in range(20)] for _ in range(rng.randrange(0, 25))]
        for _ in range(rng.randrange(6)):
            c, a = rng.randrange(20), rng.randrange(20)
            for r in range(a, min(len(lines), a + rng.randrange(3, 12))):
                lines[r][c] = rng.choice("█▓▒")
        pages[k] = ["".join(x).rstrip() if k % 2 else "".join(x) for x in lines]
    grid = spark.createDataFrame([(k // 2, k % 2, r, line) for k, x in pages.items() for r, line in enumerate(x)] + [(99, 0, 0, None)], "doc_id long, page int, row int, line string")
    got = {}
    for r in layout.layout_sparse_tables(grid).collect():
        got.setdefault((r.doc_id, r.page), []).append((r.row_start, r.row_end, r.columns))
    assert {k: sorted(v) for k, v in got.items()} == {(k // 2, k % 2): t for k, x in pages.items() if (t := greedy_tables(x))}
    assert layout.layout_sparse_tables(grid.limit(0)).count() == 0
    assert {r.columns for r in layout.layout_sparse_tables(grid, dense=True).collect()} <= {2, 3, 4, 5, 6}


def test_breaks_and_densities(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 2, None]), rng.choice([1, 2]), rng.choice([*range(12), None]), rng.choice([None, "", " " * 20, "\n█ ", "█▓" * 10, "█" + " " * 19, "█" + " " * 18, "▒░ x\u00e9\U0001F600"])) for _ in range(400)]  # rows come again, keys and lines are missing
    grid = spark.createDataFrame(rows, "doc_id long, page int, row int, line string")
    share = lambda x: sum(c in "█▓" for c in x) / len(x) if x else 0.0
    assert [r.d for r in grid.select(layout.density(F.col("line")).alias("d")).collect()] == [share(x) for *_, x in rows]
    runs = {}
    for key in {x[:2] for x in rows}:
        thin = sorted(r for *k, r, x in rows if tuple(k) == key and r is not None and share(x) <= layout.BREAK_DENSITY)
        for n, r in enumerate(thin):
            runs.setdefault((*key, r - n), []).append(r)
    breaks = layout.layout_breaks(grid)
    assert sorted(map(str, map(tuple, breaks.collect()))) == sorted(str((*k[:2], min(v), max(v))) for k, v in runs.items() if max(v) > min(v))
    assert layout.layout_breaks(grid.limit(0)).count() == 0
    # a line that is made from others is made once for each row, and characters are counted without a pattern
    plan = layout.layout_breaks(grid.withColumn("line", F.concat("line", F.lit("~")))).union(breaks)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("~") == 1 and "regexp" not in plan and "Window" not in plan


def test_features_and_summaries(spark):
    page = ["████████  ", "          ", "          ", " █   █    ", " █   █    ", " █   █    ", " █   █    ", " █   █    ", "  ░░░░    "]
    pages = layout.page_features(spark.createDataFrame([(1, n, r, line) for n in (1, 2) for r, line in enumerate(page)] + [(2, 1, 0, "")], "doc_id long, page int, row int, line string"))
    one = pages.where("doc_id = 1 AND page = 2").collect()[0]
    assert [(h.row, h.width_ratio) for h in one.headings] == [(0, 0.8)] and [tuple(t) for t in one.tables] == [(3, 7, 2)] and [tuple(b) for b in one.breaks] == [(1, 2)]
    assert [tuple(m) for m in one.placeholders] == [(0, 0, "████████"), (8, 2, "░░░░")]
    docs = layout.document_features(pages)
    text = {r.doc_id: r.summary for r in layout.document_summary(docs).collect()}
    assert text[1] == "Document: 2 pages, avg density=0.20\nTotals — headings=2 tables=2 section_breaks=2 placeholders=4\n\nPage 1: H=1 T=1 S=1 P=2 d=0.20\nPage 2: H=1 T=1 S=1 P=2 d=0.20"
    assert text[2].endswith("Page 1: H=0 T=0 S=0 P=0 d=0.00")
    assert '"totals":{"headings":2,"tables":2,"section_breaks":2,"placeholders":4}' in {r.doc_id: r.summary for r in layout.document_summary(docs, "json").collect()}[1]
    assert layout.page_summary_text(pages).where("doc_id = 1 AND page = 1").collect()[0].summary == (
        "Grid: 9x10, density=0.20\nHeadings detected: 1\n  row=  0 density=0.80 width=0.80\nTables detected: 1\n  rows 3-7\nSection breaks: 1\n  row=1 blank_rows=2\nPlaceholders: 2\n  row=0 col=0 pattern='████████'\n  row=8 col=2 pattern='░░░░'")
    with pytest.raises(ValueError, match="unknown format"):
        layout.document_summary(docs, "xml")


NUMBERING = f"""<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="bullet"/><w:lvlText w:val="x"/></w:lvl></w:abstractNum>
<w:abstractNum w:abstractNumId="5"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum>
<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride><w:lvlOverride w:ilvl="1"><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/><w:lvlText w:val="%2)"/></w:lvl></w:lvlOverride></w:num>
<w:num w:numId="3"><w:abstractNumId w:val="9"/></w:num><w:num w:numId="4"><w:abstractNumId w:val="5"/></w:num></w:numbering>"""


def test_numbering_and_sections_of_files(spark):
    body = (p("antes") + p("Objetivo geral", num=(1, 0)) + p("") + p("Item um", num=(4, 0)) + p("Item dois", num=(4, 0)) + p("Sub", num=(1, 1)) + p("ESCOPO DO TRABALHO", num=(1, 0)) + p("Item novo", num=(4, 0))
            + p("De novo", num=(2, 0)) + p("letra", num=(2, 1)) + p("sem lista", num=(3, 0)))
    some = files(spark, a=file_of(body, numbering=NUMBERING), b=file_of(p("1. TITULO") + p("texto", num=(1, 0))), c=b"broken")
    levels = numbering.numbering_levels(*docx.read_numbering(some))
    assert sorted(tuple(r)[1:] for r in levels.collect()) == [(1, 0, "decimal", "%1.", 1), (1, 1, "bullet", "x", 1), (2, 0, "decimal", "%1.", 7), (2, 1, "lowerLetter", "%2)", 1), (4, 0, "bullet", "", 1)]
    profile = docx_files.profile_source(spark, some)
    got = [(r.path, r.name, r.raw_heading, r.number, r.level, r.content) for r in profile.sections.orderBy("path", "seq").collect()]
    assert got == [("a", "OBJETIVO GERAL", "1. Objetivo geral", "1", 1, "a. Item um\nb. Item dois\n• Sub"), ("a", "ESCOPO DO TRABALHO", "2. ESCOPO DO TRABALHO", None, 1, "a. Item novo"), ("a", "DE NOVO", "7. De novo", "7", 1, "a) letra\nsem lista"),
                   ("b", "TITULO", "1. TITULO", "1", 1, "texto")]
    assert docx_files.profile_source(spark, profile) is profile
    assert [r.text for r in docx_files.profile_source(spark, file_of(p("so um"))).paragraphs.collect()] == ["so um"]
    assert docx_files.profile_source(spark, io.BytesIO(file_of(p("1. X Y Z")))).sections.count() == 1
    with pytest.raises(TypeError, match="int"):
        docx_files.profile_source(spark, 3)


def test_target_sections_of_blocks(spark):
    rows = [(1, 0, "antes", None, False), (1, 1, "Qualquer", "Heading 2", False), (1, 2, "", None, False), (1, 3, None, None, False), (1, 4, "Em Negrito", None, True), (2, 0, "nada", None, False)]
    got = sections.target_sections(spark.createDataFrame(rows, "doc_id long, idx int, text string, style string, is_bold boolean")).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.name, r.level, r.heading_idx, r.content_idx) for r in got] == [(1, "QUALQUER", 2, 1, [2, 3]), (1, "EM NEGRITO", 1, 4, [])]


def test_merged_cells_of_files(spark):
    restart, on = '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    content = file_of(p("a") + table([("x", 2, restart), "y"], [("", 2, on), ("z", 3, "")], [("", 2, on), "w"], [("", 1, on), ("v", 1, restart)]) + p("b") + table(["q"]))
    blocks = docx.read_blocks(files(spark, a=content)).withColumnRenamed("path", "doc_id")
    assert [(r.text, r.anchor) for r in blocks.where("kind = 'paragraph'").orderBy("idx").collect()] == [("a", 0), ("b", 1)] and {r.table_no: r.anchor for r in blocks.where("kind = 'cell'").collect()} == {0: 1, 1: 2}
    seen = tables.visual_cells(blocks.where("kind = 'cell' AND table_no = 0").withColumnRenamed("col", "cell_no"))
    assert sorted((r.row, r.cell_no, r.col, r.span, r.continued, r.text) for r in seen.collect()) == [
        (0, 0, 0, 2, False, "x"), (0, 1, 2, 1, False, "y"), (1, 0, 0, 2, True, "x"), (1, 1, 2, 3, False, "z"), (2, 0, 0, 2, True, "x"), (2, 1, 2, 1, False, "w"), (3, 0, 0, 1, True, "x"), (3, 1, 1, 1, False, "v")]
    at = spark.createDataFrame([("a", 0, 0, 1), ("a", 0, 1, 1), ("a", 0, 1, 4), ("a", 0, 1, 5), ("a", 9, 0, 0)], "doc_id string, table_no int, row int, col int")
    assert {(r.table_no, r.row, r.col): (r.cell_no, r.text) for r in tables.cells_at(seen, at).collect()} == {(0, 0, 1): (0, "x"), (0, 1, 1): (None, None), (0, 1, 4): (1, "z"), (0, 1, 5): (None, None), (9, 0, 0): (None, None)}


def test_flags_of_cells(spark):
    control = "<w:sdt><w:sdtPr><w:dropDownList/></w:sdtPr><w:sdtContent><w:tc>" + p("c") + "</w:tc></w:sdtContent></w:sdt>"
    content = file_of(f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc>{control}<w:tc><w:p><w:r><w:drawing/></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:sdt><w:sdtPr/><w:sdtContent><w:r><w:t>s</w:t></w:r></w:sdtContent></w:sdt></w:p>")
    got = sorted((r.kind, r.col or 0, r.text, r.control, r.drawing) for r in docx.read_blocks(files(spark, a=content)).collect())
    assert got == [("cell", 0, "a", None, False), ("cell", 1, "c", "dropdown", False), ("cell", 2, "", None, True), ("paragraph", 0, "s", "unknown", False)]


def test_tokens_across_runs(spark):
    values = {"{{A}}": "1 {{B}}", "{{B}}": None, "{{AB}}": "<&>", "XX": "yy"}
    cases = [["{{A}}"], ["{{", "A}}"], ["x{{A", "}}y{{B}}", "z"], ["{", "{", "A", "B", "}", "}"], ["a", None, "X", "", "X", "b"], ["XX{{A", "}}XX"], ["XXX", "X"], [""], ["{{A}", "} {{AB", "}}", "{{A}}"]]
    rows = [(1, "p", i, n, t) for i, runs in enumerate(cases) for n, t in enumerate(runs)]
    frame = spark.createDataFrame(rows, "doc_id long, part string, paragraph int, run_no int, text string")
    got = {}
    for r in rendering.replace_in_runs(frame, {k: F.lit(v) for k, v in values.items()}).orderBy("paragraph", "run_no").collect():
        got.setdefault(r.paragraph, []).append(r.text)
    want = [docx.fill_texts([t or "" for t in runs], {k: v or "" for k, v in values.items()}) for runs in cases]
    assert [got[i] for i in range(len(cases))] == want
    assert want[1:7] == [["1 {{B}}", ""], ["x1 {{B}}", "y", "z"], ["<&>", "", "", "", "", ""], ["a", "", "yy", "", "", "b"], ["yy1 {{B}}", "yy"], ["yyyy", ""]]
    filled = docx.fill_document(file_of(p("bold {{CO", "DIGO}}", " end")), {"{{CODIGO}}": "Z & <b>"})
    texts = re.findall(r"<w:r>(.*?)</w:r>", zipfile.ZipFile(io.BytesIO(filled)).read("word/document.xml").decode())
    assert [re.sub(r".*<w:t[^>]*>(.*)</w:t>|.*<w:t[^>]*/>", r"\1", t) for t in texts] == ["bold Z &amp; &lt;b&gt;", "", " end"] and all("<w:i" in t for t in texts)


def test_sections_rendered(spark):
    texts = ["1. UM DOIS", "", "", "", "fim", "2. TRES QUATRO", "cheio", "3. CINCO SEIS", " ", "", "1. UM DOIS", "", ""]
    blocks = spark.createDataFrame([(d, i, t) for d in (1, 2) for i, t in enumerate(texts)] + [(3, 0, None)], "doc_id long, idx int, text string")
    content = spark.createDataFrame([(1, "UM DOIS", " a \n\nb"), (1, "TRES QUATRO", "no room"), (1, "CINCO SEIS", "1.1 X"), (1, "ELSEWHERE", "x"), (2, "CINCO SEIS", "  \n "), (3, "UM", None)], "doc_id long, target_name string, content string")
    got = {}
    for r in rendering.render_sections(blocks, content).orderBy("doc_id", "idx").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.kind))
    assert got[1] == [("1. UM DOIS", None), ("", None), ("fim", None), ("2. TRES QUATRO", None), ("cheio", None), ("3. CINCO SEIS", None), ("1.1 X", "subheading"), ("1. UM DOIS", None), ("a", "body"), ("b", "body"), ("", None)]
    assert [t for t, _ in got[2]] == ["1. UM DOIS", "", "fim", "2. TRES QUATRO", "cheio", "3. CINCO SEIS", " ", "1. UM DOIS", ""] and got[3] == [("", None)]


def test_plan_on_files(spark):
    body = p("CAPA {{COD", "IGO}}") + p("1. OBJETIVO") + p("") + p("") + p("{{CODIGO}} e ____") + p("Assinado por X") + table(["Nome", "Cargo"], ["", ""], ["Z", "Z"]) + p("2. FIM DE TUDO")
    header = f"<w:hdr {W}>{p('Rev XX', ' de XX XX')}{p('b')}</w:hdr>"
    some = files(spark, a=file_of(body, header1=header), b=file_of(p("sem plano")), c=b"broken")
    plan = [("a", "section", 0, "OBJETIVO", "1.1 Um\nNota: dois", None, None, None, None), ("a", "header", 0, "XX", "09", None, None, None, None), ("a", "header", 1, "{{CODIGO}}", "K-1", None, None, None, None),
            ("a", "header", 2, "____", "never", None, None, None, None), ("a", "rewrite", 0, " Assinado por X ", "Assinado por Ana", None, None, None, None), ("a", "rewrite", 1, "Assinado por Ana", "Assinado por Bia", None, None, None, None),
            ("a", "record", 0, None, None, 0, None, None, {"Nome": "Ana", "Cargo": "chefe"}), ("a", "record", 1, None, None, 0, None, None, {"Nome": "Bia"}), ("a", "cell", 0, None, "m", 0, 2, 1, None), ("a", "cell", 1, None, "q", 0, 99, 0, None),
            ("a", "slot", 0, "cell_t0_r2_c0", "slot wins", None, None, None, None), ("a", "slot", 1, "header_para_word_header1_p1", "B", None, None, None, None), ("a", "slot", 2, "nonsense", "x", None, None, None, None), ("zz", "rewrite", 0, "x", "y", None, None, None, None)]
    plan = spark.createDataFrame(plan, "doc_id string, kind string, seq int, key string, value string, table_no int, row int, col int, rec map<string,string>")
    blocks = docx.read_blocks(some).withColumnRenamed("path", "doc_id")
    done = {r.path: (None if r.content is None else bytes(r.content), r.error) for r in docx_files.apply_plans(some, docx_files.plan_edits(blocks, plan)).collect()}
    assert done["b"][0] == bytes(some.where("path = 'b'").collect()[0].content) and done["c"] == (b"broken", None)
    back = docx.blocks_of("a", done["a"][0])
    assert [b["text"] for b in back if b["part"] == "body" and b["kind"] == "paragraph"] == ["CAPA K-1", "1. OBJETIVO", "1.1 Um", "Nota: dois", "", "K-1 e ____", "Assinado por Bia", "2. FIM DE TUDO"]
    assert [b["text"] for b in back if b["kind"] == "cell"] == ["Nome", "Cargo", "Ana", "chefe", "slot wins", "m", "Bia", ""]
    assert [b["text"] for b in back if b["part"] == "header1"] == ["Rev 09 de 09 XX", "B"]
    xml = zipfile.ZipFile(io.BytesIO(done["a"][0])).read("word/document.xml").decode()
    assert re.search(r'w:before="240".*?<w:b ?/>.*?1\.1 Um', xml) and "ns0:" not in xml
    edits = docx_files.plan_edits(blocks, plan.limit(0))
    assert edits.count() == 0 and docx_files.apply_plans(some, edits).where("error IS NULL").count() == 3
    broken = docx_files.plan_edits(blocks, plan.where("kind = 'rewrite'").withColumn("doc_id", F.lit("c")))
    assert docx_files.apply_plans(some, broken).where("path = 'c' AND content IS NULL AND error LIKE 'BadZipFile%'").count() == 1


def test_documents_round_trip(spark):
    rows = [(7, 0, "um & dois <x>", None, 1, 0, True), (7, 1, None, "Heading 1", None, None, None), (8, 0, "só", None, None, None, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, idx int, text string, style string, num_id int, ilvl int, is_bold boolean")
    cells = spark.createDataFrame([(7, 0, 0, 0, "a\nb", 2, "restart", 1), (7, 0, 1, 0, None, 2, "continue", 1), (9, 0, 0, 0, "only a table", None, None, None)], "doc_id long, table_no int, row int, col int, text string, span int, vmerge string, anchor int")
    made = docx_files.build_documents(blocks, cells)
    got = {(r.path, r.kind, r.idx if r.kind == "paragraph" else r.row): r for r in docx.read_blocks(made).collect()}
    assert got["7.docx", "paragraph", 0].text == "um & dois <x>" and got["7.docx", "paragraph", 0].is_bold and got["7.docx", "paragraph", 0].num_id == 1 and got["7.docx", "paragraph", 1].style == "Heading 1"
    assert (got["7.docx", "cell", 0].text, got["7.docx", "cell", 0].span, got["7.docx", "cell", 0].vmerge, got["7.docx", "cell", 0].anchor) == ("a\nb", 2, "restart", 1) and got["7.docx", "cell", 1].vmerge_cont
    assert got["9.docx", "cell", 0].text == "only a table" and len(got) == 6


def test_files_are_built_in_streams_and_read_once(spark):
    blocks = spark.createDataFrame([(d, i, f"texto {i} & \"{d}\"", 'Title "x" & <y>', 1, 0) for d in range(150) for i in (1, 0)], "doc_id long, idx int, text string, style string, num_id int, ilvl int")
    cells = spark.createDataFrame([(d, 0, 0, 0, str(d), 1) for d in range(150)], "doc_id long, table_no int, row int, col int, text string, anchor int")
    nums = spark.createDataFrame([(d, 1, 0) for d in range(150)], "doc_id long, num_id int, abstract_id int")
    abstracts = spark.createDataFrame([(d, 0, 0, "decimal", '%1 "<&', 2) for d in range(150)], "doc_id long, abstract_id int, ilvl int, num_fmt string, lvl_text string, start int")
    made = docx_files.build_documents(blocks, cells, None, (nums, abstracts, nums.limit(0).selectExpr("doc_id", "num_id", "0 AS ilvl", "'' AS num_fmt", "'' AS lvl_text", "1 AS start")))
    assert "FlatMapGroupsInArrow" not in made._jdf.queryExecution().toString()  # no exchange with Python for each document
    levels = numbering.numbering_levels(*docx.read_numbering(made))
    assert "MapInArrow" not in levels._jdf.queryExecution().toString()  # what was read is staged
    assert {(r.num_id, r.num_fmt, r.lvl_text, r.start) for r in levels.collect()} == {(1, "decimal", '%1 "<&', 2)} and levels.count() == 150
    got = docx.read_blocks(made).collect()
    assert len(got) == 450 and {r.style for r in got if r.kind == "paragraph"} == {'Title "x" & <y>'} and {r.anchor for r in got if r.kind == "cell"} == {1}
    only = docx.read_blocks(made, "cell").collect()
    assert sorted((r.path, r.idx, r.text) for r in only) == sorted((r.path, r.idx, r.text) for r in got if r.kind == "cell")


def test_parts_are_parsed_once(monkeypatch):
    content = docx_files._package([("paragraph", None, i, None, None, f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>") for i, t in enumerate(("ab", "{{X}}"))])
    empty = dict.fromkeys([c for c, _ in docx_files._EDIT_COLUMNS])
    with monkeypatch.context() as m:
        m.setattr(docx.ElementTree, "fromstring", None)  # a part is parsed as its namespaces are read, and not again
        made = docx_files.apply_edits(content, [empty | {"step": 4, "op": "body", "key": "{{X}}", "text": "v"}])
    assert [b["text"] for b in docx.blocks_of("f", made)] == ["ab", "v"]


def test_parts_are_written_in_one_walk():
    other = 'xmlns:o="urn:o" xmlns:xml="http://www.w3.org/XML/1998/namespace"'
    for xml in (f'<w:document xmlns:w="{docx.W[1:-1]}" {other}><w:body><w:p o:a="1 &lt;&quot;&#10;&#9;&amp;" b="é"><o:x/>tail &amp; &lt;<w:t xml:space="preserve"> a &gt; b </w:t><w:t/></w:p></w:body></w:document>', "<a/>", '<a xmlns="urn:q"><b> </b></a>'):
        root = docx.ElementTree.fromstring(xml)
        assert docx.written(root) == docx.ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True)


def test_edits_are_taken_by_field_and_rewrites_read_texts_once(monkeypatch):
    import pyarrow as pa

    one = dict.fromkeys([c for c, _ in docx_files._EDIT_COLUMNS[1:]])
    rows = [None, [], [one | {"step": 5, "op": "rewrite", "seq": i, "key": k, "text": f"t{i}"} for i, k in enumerate(("none", " b ", "t1", "inner"))], None, [one]]
    kinds = pa.struct([(c, pa.int32() if t == "int" else pa.string()) for c, t in docx_files._EDIT_COLUMNS[1:]])
    column = pa.array(rows, pa.list_(kinds))
    assert docx_files.edits_of(column) == rows and docx_files.edits_of(column[2:]) == rows[2:]
    xml = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in "abc") + "<w:p><w:r><w:t>b</w:t></w:r><w:r><w:p><w:r><w:t/></w:r></w:p></w:r></w:p>"
    content, calls, read = docx_files._package([("paragraph", None, 0, None, None, xml)]), [], docx_files._text
    monkeypatch.setattr(docx_files, "_text", lambda p: calls.append(p) or read(p))
    made = docx_files.apply_edits(content, rows[2][:1] * 3)
    assert made and len(calls) == 5  # three rewrites that find nothing
    assert [b["text"] for b in docx.blocks_of("f", docx_files.apply_edits(content, rows[2]))] == ["a", "t2", "c", "t2"]
