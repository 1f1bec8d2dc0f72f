"""Files made here, read back: DOCX and XLSX from their XML, SQLite and CSV glossaries, caches."""

from __future__ import annotations

import sqlite3
import zipfile

import pytest

from lexiloom.operators import engines
from lexiloom.sources import glossaries, office, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def run(text: str) -> str:
    return f"<w:r><w:t>{text}</w:t></w:r>"


def para(text: str, props: str = "") -> str:
    return f"<w:p><w:pPr>{props}</w:pPr>{run(text)}</w:p>"


def cell(text: str, props: str = "") -> str:
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{para(text)}</w:tc>"


def pack(path, files: dict[str, str]) -> None:  # noqa: ANN001
    with zipfile.ZipFile(path, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):  # noqa: ANN001, ANN201
    at = tmp_path_factory.mktemp("office")
    box = f'<w:p><w:r><w:pict><w:txbxContent>{para("in box")}{para(" ")}{para("second")}</w:txbxContent></w:pict></w:r>{run("around")}</w:p>'
    link = f'<w:p>{run("a")}<w:hyperlink>{run("b")}</w:hyperlink><w:r><w:tab/><w:t>c</w:t><w:br/><w:t>d</w:t></w:r></w:p>'
    table = (
        f'<w:tbl><w:tr>{cell("wide", "<w:gridSpan w:val=" + chr(34) + "2" + chr(34) + "/>")}{cell("tall", "<w:vMerge w:val=" + chr(34) + "restart" + chr(34) + "/>")}</w:tr>'
        f'<w:tr>{cell("x")}{cell("")}{cell("", "<w:vMerge/>")}</w:tr></w:tbl>'
    )
    section = lambda ids: "<w:sectPr>" + "".join(f'<w:{p}Reference w:type="{t}" r:id="{i}"/>' for p, t, i in ids) + "</w:sectPr>"
    first, last = section([("header", "default", "h1"), ("footer", "first", "f1")]), section([("header", "first", "h2")])
    body = para("Title", '<w:pStyle w:val="H1"/><w:outlineLvl w:val="0"/>') + para("") + box + link + table + f"<w:p><w:pPr>{first}</w:pPr></w:p>" + last
    part = lambda tag, text: f"<w:{tag} {W}>{para(text)}{para(' ')}</w:{tag}>"
    pack(at / "a.docx", {
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/_rels/document.xml.rels": '<Relationships><Relationship Id="h1" Target="header1.xml"/><Relationship Id="h2" Target="/word/header2.xml"/><Relationship Id="f1" Target="footer1.xml"/></Relationships>',
        "word/header1.xml": part("hdr", "top"), "word/header2.xml": part("hdr", "first top"), "word/footer1.xml": part("ftr", "foot"),
    })
    pack(at / "empty.docx", {"word/document.xml": f"<w:document {W}><w:body/></w:document>"})
    (at / "~$a.docx").write_bytes(b"lock")
    strings = "".join(f"<si><t>{s}</t></si>" for s in ("英文术语", "中文译法", "处理方式", "heart", "心", "brand", "keep"))
    s = lambda ref, i: f'<c r="{ref}" t="s"><v>{i}</v></c>'
    rows = (
        f'<row r="1">{s("A1", 0)}{s("B1", 1)}{s("D1", 2)}</row><row r="2">{s("A2", 3)}{s("B2", 4)}</row>'
        f'<row r="4">{s("A4", 5)}<c r="B4" t="inlineStr"><is><t>b</t></is></c>{s("D4", 6)}</row><row r="5"><c r="B5"><v>2.5</v></c></row>'
    )
    pack(at / "g.xlsx", {
        "xl/workbook.xml": f'<workbook {X}><sheets><sheet name="Z" r:id="r1"/><sheet name="A" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/one.xml"/><Relationship Id="r2" Target="worksheets/two.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {X}>{strings}</sst>",
        "xl/worksheets/one.xml": f"<worksheet {X}><sheetData>{rows}</sheetData></worksheet>",
        "xl/worksheets/two.xml": f'<worksheet {X}><sheetData><row><c><v>7</v></c></row></sheetData></worksheet>',
    })
    with sqlite3.connect(at / "g.db") as db:
        db.execute('CREATE TABLE "my terms" (id int, source text, zh text, domain text)')
        db.executemany('INSERT INTO "my terms" VALUES (?, ?, ?, ?)', [(1, "lung", "肺", None), (2, " ", "x", "d"), (3, "vein ", "静脉", "医学")])
        db.execute("CREATE TABLE other (a int, b int)")
    db.close()
    (at / "g.csv").write_text("a,b,c\nliver,肝,医学\n,x,\n", encoding="utf-8")
    return str(at)


def rows(d) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r)[1:] for r in d.collect()), key=repr)


def test_docx(spark, folder):  # noqa: ANN001, ANN201
    assert sorted(tuple(r)[1:] for r in office.docx_paragraphs(spark, folder).collect()) == [
        (1, "Title", "heading 1", 0, False), (2, "", "Normal", -1, False), (3, "around", "Normal", -1, False), (4, "ab\tc\nd", "Normal", -1, False), (5, "", "Normal", -1, False),
        (6, "wide", "TABLE_CELL", -1, True), (7, "wide", "TABLE_CELL", -1, True), (8, "tall", "TABLE_CELL", -1, True), (9, "x", "TABLE_CELL", -1, True), (10, "tall", "TABLE_CELL", -1, True),
    ]
    assert rows(office.docx_tables(spark, folder)) == [(0, 0, 0, "wide", 2), (0, 0, 1, "wide", 2), (0, 0, 2, "tall", 1), (0, 1, 0, "x", 1), (0, 1, 1, "", 1), (0, 1, 2, "tall", 1)]
    assert rows(office.docx_headers_footers(spark, folder)) == [("footer", 1, "first", "foot"), ("header", 1, "default", "top"), ("header", 2, "first", "first top")]
    assert rows(office.docx_text_boxes(spark, folder)) == [(0, 0, "in box"), (0, 2, "second")]
    assert readers.office_files(spark, folder, "docx").count() == 10


def test_xlsx_and_glossaries(spark, folder):  # noqa: ANN001, ANN201
    want = [(0, "Z", 1, ["英文术语", "中文译法", None, "处理方式"]), (0, "Z", 2, ["heart", "心"]), (0, "Z", 4, ["brand", "b", None, "keep"]), (0, "Z", 5, [None, "2.5"]), (1, "A", 1, ["7"])]
    assert rows(office.xlsx_rows(spark, folder)) == want
    assert [r[1:3] for r in sorted(map(tuple, readers.office_files(spark, folder, "xlsx").collect()))] == [(1, "英文术语 | 中文译法 |  | 处理方式"), (2, "heart | 心"), (3, "brand | b |  | keep"), (4, " | 2.5"), (5, "7")]
    assert rows(glossaries.glossary_xlsx(spark, folder)) == [("heart", "心", "通用")]
    assert rows(glossaries.glossary_sqlite(spark, folder)) == [("lung", "肺", "通用"), ("vein", "静脉", "医学")]
    assert [tuple(r) for r in readers.glossary_csv(spark, f"{folder}/g.csv").collect()] == [("liver", "肝", "医学")]
    assert [r.path.rsplit("/", 1)[1] for r in glossaries.scan_glossaries(spark, folder).collect()] == ["g.xlsx", "g.csv", "g.db"]
    files = spark.createDataFrame([("p", "client_glossary.json"), ("p", "client_terms.json"), ("q", "x.json"), ("r", "_术语要求.xlsx")], "folder string, name string")
    assert rows(glossaries.client_file(files)) == [("_术语要求.xlsx",), ("client_terms.json",)]


def test_broken_office_file(spark, tmp_path):  # noqa: ANN001, ANN201
    (tmp_path / "x.docx").write_bytes(b"no archive")
    assert office.docx_paragraphs(spark, str(tmp_path), skip_broken=True).count() == 0
    with pytest.raises(Exception, match="no readable docx file"):
        office.docx_paragraphs(spark, str(tmp_path)).count()


def test_client_shapes(spark):  # noqa: ANN001, ANN201
    texts = [(1, '{"terms": {"A b": "x", "a  B": {"target": "y", "note": "n"}}}'), (2, '[{"en": "B", "zh": "乙"}, {"src": "C", "target": ""}]'), (3, '{"project": "p", "D": "丁", "E": {"k": 1}}'), (4, "no json"), (5, None), (6, "[]")]
    got = readers.client_glossary_json(spark.createDataFrame(texts, "id int, value string"), key=["id"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a  B", "y", "n"), (2, "B", "乙", ""), (3, "D", "丁", "")]


def test_engines_and_cache(spark, tmp_path):  # noqa: ANN001, ANN201
    path = str(tmp_path / "cache")
    texts = spark.createDataFrame([("one",), ("two",), ("one",), (None,)], "text string")
    engine = engines.Engine("upper", str.upper)
    once = engines.translate_through(texts, engines.load_cache(spark, path), engine)
    assert sorted(map(tuple, once.collect())) == [("one", "ONE", False), ("two", "TWO", False)]
    engines.save_cache(engines.cache_rows(once, engine), path)
    other = engines.Engine("upper", lambda t: "new " + t)
    said = lambda e, **kw: sorted(r.translation for r in engines.translate_through(texts, engines.load_cache(spark, path), e, **kw).collect())
    assert said(other) == ["ONE", "TWO"]  # from the cache
    assert said(other, ignore_cache=True) == said(other.having(tone="polite")) == ["new one", "new two"]
    engines.save_cache(engines.cache_rows(engines.translate_through(texts, engines.load_cache(spark, path), other, ignore_cache=True), other), path)
    assert said(engine) == ["new one", "new two"]  # the last row counts
    same = engines.translate_through(texts, engines.load_cache(spark, path), engines.Engine("same", lambda t: t))
    assert engines.cache_rows(same, engine).count() == 2 and engines.cache_rows(same, engine, keep_unchanged=False).count() == 0

    known = engines.Engines("upper")
    known.register(engine)
    known.register(engines.Engine("off", str.lower, is_available=lambda: False))
    assert known.get().name == "upper" and known.available() == ["upper"]
    with pytest.raises(RuntimeError):
        known.switch("off")
    with pytest.raises(KeyError):
        known.get("none")
    with pytest.raises(ValueError):
        engines.Engine("x" * 20, str.upper)


def test_term_search_offline(spark):  # noqa: ANN001, ANN201
    terms = spark.createDataFrame([("a",), ("a",), (None,)], "term string")
    answers = spark.createDataFrame([("a", 1, "x", "mesh", "high")], "term string, priority int, candidate string, source_type string, confidence string")
    assert [tuple(r) for r in engines.search_terms(terms, answers, offline=True).collect()] == [("a", "", "manual", "low")]
    assert [tuple(r) for r in engines.search_terms(terms, answers).collect()] == [("a", "x", "mesh", "high")]
