import io
import zipfile

from factloom.plans.ask import ask, search_facts
from factloom.plans.planner import NumericConstraint, numeric_constraints, plan_question
from factloom.sources import files, jobs
from factloom.sources.tables import fact_rows, load
from factloom.streaming import outbox
from factloom.operators.catalog import enqueue

SF = "/root/testdata/sf0.001"


def test_csv_and_markdown():
    assert files.parse_csv("﻿material;value\nVT6;980\nX;nan\n".encode()) == [("table_row", "", "material: VT6 | value: 980"), ("table_row", "", "material: X")]
    got = files.parse_text(b"# Head\nfirst\nline\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nlast")
    assert got == [("paragraph", "Head", "first line"), ("table_row", "Head", "a: 1 | b: 2"), ("paragraph", "Head", "last")]


def test_xlsx():
    sheet = lambda rows: f"<worksheet xmlns='x'><sheetData>{rows}</sheetData></worksheet>"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook xmlns='x' xmlns:r='y'><sheets><sheet name='One' r:id='a'/><sheet name='Two' r:id='b'/><sheet name='Lost' r:id='c'/></sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships><Relationship Id='a' Target='worksheets/s2.xml'/><Relationship Id='b' Target='/xl/worksheets/s1.xml'/></Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst xmlns='x'><si><t>material</t></si><si><r><t>V</t></r><r><t>T6</t></r></si></sst>")
        z.writestr("xl/worksheets/s2.xml", sheet("<row/><row><c r='A1' t='s'><v>0</v></c><c r='C1' t='inlineStr'><is><t>value</t></is></c></row><row><c r='A2' t='s'><v>1</v></c><c r='C2'><v>980</v></c></row>"))
        z.writestr("xl/worksheets/s1.xml", sheet(""))
    assert files.parse("a.xlsx", buffer.getvalue()) == [("table_row", "One", "material: VT6 | value: 980")]
    assert files.parse("a.xlsx", b"PK")[0][0] == "failed"


def test_html_drops_navigation():
    got = files.parse_html(b"<title>T</title><nav><li>no</li></nav><h1>H</h1><p>x <b>y</b></p><script>no()</script><table><tr><th>a</th></tr><tr><td>1</td></tr></table><img src='i.png' alt='z'><footer><p>no</p></footer>")
    assert [(k, t) for k, _, t in got] == [("title", "T"), ("heading", "H"), ("paragraph", "x y"), ("table_row", "a: 1"), ("image", "Image: url: i.png | alt: z")]


def test_office_files_through_spark(spark, tmp_path):
    w = 'xmlns:w="http://w"'
    doc = f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    slide = '<p:sld xmlns:p="http://p" xmlns:a="http://a"><p:sp><a:t>Hello</a:t></p:sp></p:sld>'
    for name, inner, text in (("a.docx", "word/document.xml", doc), ("b.pptx", "ppt/slides/slide1.xml", slide)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr(inner, text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/c.txt").write_text(" ".join(f"w{i}" for i in range(900)))
    (tmp_path / "d.xyz").write_text("?")
    (tmp_path / "e.docx").write_bytes(b"broken")
    (tmp_path / ".hidden.txt").write_text("no")
    blocks = files.read_blocks(spark, str(tmp_path))
    got = {(r["path"].rpartition("/")[2], r["kind"], r["section"], r["text"]) for r in blocks.collect() if not r["path"].endswith(("c.txt", "e.docx"))}
    assert got == {("a.docx", "heading", "Head", "Head"), ("a.docx", "paragraph", "Head", "Body"), ("a.docx", "table_row", "Head", "a: 1"), ("b.pptx", "paragraph", "Slide 1", "Hello"), ("d.xyz", "unsupported", "", "")}
    assert [r["kind"] for r in blocks.collect() if r["path"].endswith("e.docx")] == ["failed"]
    assert [len(r["text"].split()) for r in files.chunks(blocks).orderBy("part").collect() if r["path"].endswith("c.txt")] == [400, 400, 200]


def test_outbox_stream_equals_batch(spark, tmp_path):
    events = load(spark, SF, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    stream = outbox.read_events(spark, str(tmp_path / "in"), schema)
    outbox.run_outbox(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    outbox.run_outbox(stream, str(tmp_path / "out"), str(tmp_path / "cp"))  # nothing new: the checkpoint knows the files
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch")]) == 3
    outbox.compact(spark, str(tmp_path / "out"), str(tmp_path / "compact"))
    of = lambda frame: sorted((r["user_id"], r["event_type"], r["event_id"], r["payload"], r["status"], r["version"]) for r in frame.collect())
    assert of(outbox.newest(spark, str(tmp_path / "out"))) == of(outbox.newest(spark, str(tmp_path / "compact"))) == of(enqueue(events))


def test_stream_windows_and_dedupe(spark, tmp_path):
    events = load(spark, SF, "events")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = events.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for name, frame, mode in (("w", outbox.windowed, "complete"), ("d", outbox.deduplicated, "append")):
        query = frame(outbox.read_events(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()
    assert spark.sql("SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM d)").first()[0] == events.select("user_id", "event_type").distinct().count()


def test_planner():
    c = plan_question("What strength has VT6 after annealing, at least 900 MPa, in Russia over the last 5 years?", 2024)
    assert not c.exact and c.materials == ("ВТ6",) and c.numeric == (NumericConstraint(">=", 900.0, None, "MPa"),) and (c.start_year, c.end_year) == (2020, 2024) and c.geographies == ("Россия",)
    assert plan_question("What strength has VT6 after annealing?", 2024).exact
    for asked in ("What strength have VT6 and copper after annealing?", "Review the strength of VT6 after annealing", "What strength has VT6 after annealing in Russia?", "What strength had VT6 after annealing in 2019?"):
        assert not plan_question(asked, 2024).exact
    assert plan_question("Nitrogen in nickel", 2024).materials == ("никель",)
    assert numeric_constraints("200–300 мг/л, 5 % и ≤ 7,5 г/т") == (NumericConstraint("range", 200.0, 300.0, "мг/л"), NumericConstraint("<=", None, 7.5, "г/т"), NumericConstraint("=", 5.0, 5.0, "%"))


def test_numeric_asks(spark):
    from pyspark.sql import functions as F

    from factloom.plans.questions import numeric_asks

    asked = {
        1: "сульфаты не более 300 мг/л",
        2: "сухой остаток от 200 до 300 мг/дм3 и хлориды < 5,5 мг/л",
        3: "flow velocity at least 2 m/s",
        4: "nothing is asked at 5 MPa",
        5: "strength above 900 mpa",
        6: "расход 0,5 м/с",
    }
    frame = spark.createDataFrame(list(asked.items()), "id int, text string").select("id", F.explode(numeric_asks(F.lower("text"))).alias("a")).select("id", "a.*")
    got = {tuple(r) for r in frame.collect()}
    assert got == {
        (1, "сульфаты", "<=", 300.0, None, None, "mg/L"),
        (2, "сухой остаток", "range", None, 200.0, 300.0, "mg/L"),
        (2, "хлориды", "<", 5.5, None, None, "mg/L"),
        (3, "скорость потока", ">=", 2.0, None, None, "m/s"),
        (5, "прочность", ">", 900.0, None, None, "MPa"),
        (6, "скорость потока", "=", 0.5, None, None, "m/s"),
    }


def test_repaired_text(spark):
    from pyspark.sql import functions as F

    from factloom.operators.answers import repaired

    texts = {
        "strength of 980 M P a": "strength of 980 MPa", "980\n МПа, 150 H V": "980 MPa, 150 HV", "an-\n nealing": "annealing", "В Т 6, ВТ - 6 и BT6": "В Т 6, ВТ6 и VT6", "7075 – T 6 and Ti 6Al 4V": "7075-T6 and Ti-6Al-4V",
        "77 k si  of  HVAC": "77 ksi of HVAC", "12\n%": "12 %", "": "",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", repaired(F.col("text")).alias("r"))
    assert {r["text"]: r["r"] for r in frame.collect()} == texts


def test_urls(spark):
    from pyspark.sql import functions as F

    from factloom.operators.profile import url_verdict

    urls = {
        "http://example.com/a": "ok", "https://user@8.8.8.8:80/x": "ok", "ftp://example.com": "scheme", "http://": "host", "http://intranet/": "private", "http://server/": "dotless",
        "http://foo.localhost": "private", "http://localhost.localdomain./": "private", "http://100.64.0.1": "private", "http://224.0.0.1": "private", "http://0x7f.0.0.1": "private",
        "http://2130706433/": "private", "http://0177.0.0.1/": "private", "http://127.1/": "private", "http://[::1]/": "private", "http://[2606:4700::1111]/": "ok", "http://[fe80::1]/": "private", "http://a@10.0.0.1@x.com/": "ok",
    }
    frame = spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_verdict(F.col("url")).alias("v"))
    assert {r["url"]: r["v"] for r in frame.collect()} == urls


def test_cascade(spark):
    rows, docs = fact_rows(spark, SF), load(spark, SF, "documents")
    assert search_facts(rows, "Brand#11", "R", None)[0] == "exact_facts_found"
    assert search_facts(rows, "Nothing", "R", None)[0] == "relaxed_facts_found"
    assert search_facts(rows, "Nothing", None, None, docs, "the license?")[0] == "chunks_only_no_structured_facts"
    assert search_facts(rows, "Nothing", None, None)[0] == "no_relevant_sources"


def test_ask(spark):
    rows, docs = fact_rows(spark, SF), load(spark, SF, "documents")
    resolve = lambda q: ("Brand#11" if "brand 11" in q.lower() else None, "R" if " regime r" in q.lower() else None, None)
    answer = ask(rows, docs, "What is known of Brand 11 under regime R?", 2024, resolve=resolve)
    assert (answer.route, answer.status) == ("typed_facts", "exact_facts_found") and all("Brand#11 under R" in r["answer"] for r in answer.rows.collect())
    assert ask(rows, docs, "hm?", 2024).route == "clarify"
    assert ask(rows, docs, "Which materials are in the inventory?", 2024).rows.count() == rows.select("material").distinct().count()
    assert ask(rows, docs, "Who has the license of this?", 2024).route == "retrieval"


def test_ingestion_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("# Head\none two")
    (tmp_path / "in/b.xyz").write_text("?")
    jobs.ingest_new(spark, folder, out, checkpoint)
    (tmp_path / "in/c.csv").write_text("a,b\n1,2\n")
    jobs.ingest_new(spark, folder, out, checkpoint)
    read = lambda t: spark.read.parquet(f"{out}/{t}")
    assert sorted((r["path"].rpartition("/")[2], r["batch"]) for r in read("documents").collect()) == [("a.txt", 0), ("b.xyz", 0), ("c.csv", 1)]
    assert {r["text"] for r in read("chunks").collect()} == {"one two", "a: 1 | b: 2"}
    assert {(r["path"].rpartition("/")[2], r["status"]) for r in spark.read.json(f"{out}/audit").collect()} == {("a.txt", "parsed"), ("b.xyz", "unsupported"), ("c.csv", "parsed")}
    jobs.ingest(spark, folder, out + "2")
    assert spark.read.parquet(out + "2/documents").count() == 3


def test_figures_have_their_caption():
    html = b"<h1>H</h1><figure><img src='a' alt='b'><figcaption> the  caption </figcaption><img src='c'></figure><img src='d'><figure><img src='e'><figcaption>open</figure><p>x</p>"
    images = [t for k, _, t in files.parse_html(html) if k == "image"]
    assert images == ["Image: url: a | alt: b | caption: the caption", "Image: url: c | alt:  | caption: the caption", "Image: url: d | alt: ", "Image: url: e | alt:  | caption: open"]


def test_assembly_of_chunks(spark):
    long = " ".join(f"w{i}" for i in range(500))
    blocks = [
        (1, 0, "image", "S", "Image: url: a"), (1, 1, "paragraph", "S", long), (1, 2, "table_row", "S", "a: 1"), (1, 3, "image", "S", "Image: url: a"), (1, 4, "image", "T", "Image: url: a"),
        (1, 5, "paragraph", "T", "  \n "), (1, 6, "heading", "T", "end"), (1, 7, "table_row", "T", "a: 2"), (2, 0, "failed", "", "broken"), (3, 0, "paragraph", None, None), (4, 0, "paragraph", "", "kept"),
    ]
    frame = spark.createDataFrame(blocks, "id int, ordinal int, kind string, section string, text string").repartition(3)
    fallback = spark.createDataFrame([(2, "raw  text"), (3, " "), (4, "not needed"), (5, None)], "id int, text string")
    rows = sorted((r["id"], r["ordinal"], r["kind"], r["section"], r["token_count"], r["text"]) for r in files.assemble(frame, ["id"], fallback).collect())
    w = long.split()
    assert rows == [
        (1, 0, "table_row", "S", 2, "a: 1"), (1, 1, "table_row", "T", 2, "a: 2"), (1, 2, "paragraph", "S", 400, " ".join(w[:400])), (1, 3, "paragraph", "S", 150, " ".join(w[350:])), (1, 4, "heading", "T", 1, "end"),
        (1, 5, "image", "S", 3, "Image: url: a"), (1, 6, "image", "T", 3, "Image: url: a"), (2, 0, "paragraph", "", 2, "raw  text"), (4, 0, "paragraph", "", 1, "kept"),
    ]
    assert files.assemble(frame.where("false"), ["id"], fallback.where("false")).collect() == []
