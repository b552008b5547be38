import io
import zipfile

from pyspark.sql import functions as F

from docloom.plans.normalize import normalize
from docloom.sources import docx
from docloom.streaming import intake

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_docx(paragraphs, rows=(), header=None):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cells = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = "".join(x if x.startswith("<w:p>") else p(x) for x in paragraphs) + (f"<w:tbl>{cells}</w:tbl>" if rows else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if header:
            z.writestr("word/header1.xml", f"<w:hdr {NS}>{p(header)}</w:hdr>")
    return out.getvalue()


def test_docx_round_trip(spark, tmp_path):
    split = "<w:p><w:r><w:t>Codigo: {{CO</w:t></w:r><w:r><w:t>DIGO}}</w:t></w:r></w:p>"
    template = make_docx(["LAUDO", split, ""], [("{{CODIGO}}", "x")], "Rev {{CODIGO}}")
    (tmp_path / "a.docx").write_bytes(make_docx(["Um", " ", "Dois"], [("c1", "c2")], "cabecalho"))
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("no")
    blocks = docx.read_blocks(docx.scan_folder(spark, str(tmp_path))).cache()
    assert blocks.where("error IS NOT NULL").count() == 1 and blocks.where("part = 'header1'").collect()[0].text == "cabecalho"
    assert sorted((r.text or "", bool(r.error)) for r in docx.document_text(blocks).collect()) == [("", True), ("Um\nDois\nc1 | c2", False)]
    values = spark.createDataFrame([(1, {"{{CODIGO}}": "A&B<1>"})], "doc_id long, values map<string,string>")
    content = bytes(docx.render_documents(values, template).collect()[0].content)
    got = [b["text"] for b in docx.blocks_of("x", content)]
    assert got == ["LAUDO", "Codigo: A&B<1>", "", "A&B<1>", "x", "Rev A&B<1>"]


def test_batch(spark):
    gold = spark.createDataFrame([(i, f"Codigo: ABC-00{i}\nData: 2026-0{i + 1}-15\nCliente: Empresa {'AB'[i]}") for i in range(2)], "gold_no int, text string")
    examples = spark.createDataFrame([("CODIGO", i, f"ABC-00{i}") for i in range(2)] + [("DATA", i, f"2026-0{i + 1}-15") for i in range(2)] + [("CLIENTE", i, f"Empresa {'AB'[i]}") for i in range(2)],
                                     "field string, example_no int, example string")
    docs = spark.createDataFrame([(1, "Codigo: XYZ-7\nData: 2025-12-31\nCliente: Cia Beta\n"), (2, "Codigo: XYZ-8")], "doc_id long, text string")
    batch = normalize(docs, "LAUDO\nCodigo: {{CODIGO}}\nData: {{DATA}}\nCliente: {{CLIENTE}}", gold, examples)
    assert dict(batch.tiers.collect()) == {1: "high", 2: "low"}
    text = dict(batch.rendered.collect())
    assert text[1] == "LAUDO\nCodigo: XYZ-7\nData: 2025-12-31\nCliente: Cia Beta" and text[2] == "LAUDO\nCodigo: XYZ-8\nData: \nCliente: "
    assert {r.tier: r.n for r in batch.report().collect()} == {"high": 1, "medium": 0, "low": 1, "error": 0}


def test_streaming_intake(spark, tmp_path):
    rows = [(i, f"Codigo: A-{i}" if i % 2 else "nada", f"2026-01-01 0{i}:00:00") for i in range(6)] + [(6, "Codigo: A-1", "2026-01-01 01:05:00")]
    spark.createDataFrame(rows, "doc_id long, text string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    docs = intake.extracted(intake.arriving(spark, str(tmp_path / "in")), {"codigo": r"Codigo: (\S+)"}, ["codigo"])
    for name, df in (("tiers", intake.tier_windows(docs)), ("audit", intake.audit_stream(docs, "extracted"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("tiers").agg(F.sum("n")).collect()[0][0] >= 4
    assert spark.table("audit").count() == 4
