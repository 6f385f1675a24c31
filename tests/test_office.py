"""Office files of known text, and damaged ones."""

import io
import zipfile

import pytest

from corpusmith.sources import office, readers

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
ODF = 'xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"'


def files(members: dict[str, str]):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def relations(*targets):
    return "<Relationships>" + "".join(f'<Relationship Id="rId{k}" Target="{t}"/>' for k, t in enumerate(targets, 1)) + "</Relationships>"


def para(text, props=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def docx(body):
    return files({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


SHEET = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>c|d</t></is></c></row><row r="2"><c r="B2"><f>1+1</f><v>2</v></c><c r="C2" t="b"><v>1</v></c></row><row r="3"/></sheetData></worksheet>'
DOCX = docx(
    para("Title", '<w:pStyle w:val="Heading 2"/>') + para("a &amp; b") + para("  ") + para("one", '<w:tabs><w:tab w:pos="9"/></w:tabs><w:numPr/>')
    + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t> y</w:t><w:br/></w:r><w:del><w:r><w:delText>gone</w:delText><w:t>gone</w:t></w:r></w:del><w:r><w:t>z</w:t></w:r></w:p>"
    + "<w:tbl><w:tr><w:tc>" + para("h1") + "</w:tc><w:tc>" + para("h2") + "</w:tc></w:tr><w:tr><w:tc>" + para("p") + para("q") + "</w:tc><w:tc/></w:tr></w:tbl>" + para("end")
)
XLSX = files({"xl/workbook.xml": f'<workbook {R}><sheets><sheet name="Sales" sheetId="7" r:id="rId2"/><sheet name="Void" sheetId="8" r:id="rId9"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": relations("none.xml", "worksheets/s.xml"), "xl/worksheets/s.xml": SHEET, "xl/sharedStrings.xml": "<sst><si><r><t>sh</t></r><r><t>ared</t></r><rPh><t>no</t></rPh></si></sst>"})
PPTX = files({
    "ppt/presentation.xml": f'<p:presentation xmlns:p="p" {R}><p:sldIdLst><p:sldId id="256" r:id="rId2"/><p:sldId id="257" r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": relations("slides/b.xml", "/ppt/slides/a.xml"),
    "ppt/slides/a.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:t>First</a:t></a:r></a:p></p:sp><p:sp><a:p><a:r><a:t>body</a:t></a:r><a:br/><a:r><a:t>more</a:t></a:r></a:p></p:sp></p:sld>',
    "ppt/slides/b.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>second</a:t></a:r></a:p></p:sp></p:sld>',
})
ODT = files({"content.xml": f'<office:document-content {ODF}><office:body><office:text><text:h text:outline-level="3">Head</text:h><text:p>a\n  <text:span>b</text:span><text:s text:c="2"/>c<text:tab/>d<office:annotation><text:p>no</text:p></office:annotation></text:p><text:list><text:list-item><text:p>item</text:p></text:list-item></text:list></office:text></office:body></office:document-content>'})
ODS = files({"content.xml": f'<office:document-content {ODF}><office:body><office:spreadsheet><table:table table:name="S1"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"><text:p>v</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"/></table:table-row><table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="16384"/></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>'})
ODP = files({"content.xml": f'<office:document-content {ODF}><office:body><office:presentation><draw:page draw:name="page1"><text:p>hello</text:p></draw:page></office:presentation></office:body></office:document-content>'})
EPUB = files({"META-INF/container.xml": '<container><rootfiles><rootfile full-path="OEBPS/c.opf"/></rootfiles></container>', "OEBPS/c.opf": '<package><manifest><item id="b" href="b%20b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="x"/></spine></package>', "OEBPS/a.xhtml": "<html><head><title>t</title></head><body><p>last</p></body></html>", "OEBPS/b b.xhtml": "<html><body><h1>Chapter</h1><p>text &amp; more</p></body></html>"})
RTF = rb"{\rtf1\ansi\ansicpg1252\uc1{\fonttbl{\f0 Arial;}}{\*\generator x;}\pard\outlinelevel0 Head\par\pard caf\'e9 \u8364?uro \{x\} \u-10179?\u-8704?" + b"\r\n" + rb"more\line next\par{\pict 00ff}\trowd\pard\intbl a\cell b\cell\row\pard\intbl c\cell\cell\row\pard end}"


@pytest.mark.parametrize("content, want", [
    (DOCX, "## Title\n\na & b\n\n- one\n\nx\t y\nz\n\n| h1 | h2 |\n| --- | --- |\n| p q |  |\n\nend"),
    (XLSX, "## Sales\n\n| shared |  | c\\|d |\n| --- | --- | --- |\n|  | 2 | TRUE |"),
    (PPTX, "## First\n\nbody\nmore\n\nsecond"),
    (ODT, "### Head\n\na b  c\td\n\n- item"),
    (ODS, "## S1\n\n| v | v |\n| --- | --- |\n| v | v |"),
    (ODP, "## page1\n\nhello"),
    (RTF, "# Head\n\ncafé €uro {x} 😀more\nnext\n\n| a | b |\n| --- | --- |\n| c |  |\n\nend"),
    (docx(""), ""),
    (docx(para("word " * 300_000)), "word " * 300_000),
])
def test_texts(content, want):
    assert office.read(content) == (want, None, None)


def test_nested_boxes_and_tables():
    box = "<w:p><w:r><w:t>out </w:t></w:r><w:txbxContent>" + para("in") + "</w:txbxContent><w:r><w:t>side</w:t></w:r></w:p>"
    inner = "<w:tbl><w:tr><w:tc>" + para("deep") + "</w:tc></w:tr></w:tbl>"
    text, _, _ = office.read(docx(box + "<w:tbl><w:tr><w:tc>" + para("cell") + inner + "</w:tc></w:tr></w:tbl>"))
    assert text.startswith("in\n\nout side\n\n| cell") and "deep" in text


def test_damage(monkeypatch):
    entities = files({"word/document.xml": '<!DOCTYPE d [<!ENTITY a "aaaa">]><d>&a;</d>'})
    broken = files({"word/document.xml": "<w:document"})
    for content in (DOCX[: len(DOCX) // 2], b"", b"PK\x03\x04", entities, broken, files({"a": "b"}), RTF[:-1], RTF[:1] + b"x" + RTF[1:], files({"xl/workbook.xml": XLSX.decode("latin-1")})):
        text, html, reason = office.read(content)
        assert text is None and html is None and reason
    monkeypatch.setattr(office, "MOST_UNPACKED", 10_000)
    assert office.read(docx(para("x" * 20_000)))[2] == "Damaged: unpacks to too much"


def test_parse(spark):
    junk = b"\x00\x01" + b"readable words of a damaged file, long enough" + b"\xff"
    rows = [("a.docx", DOCX), ("b.epub", EPUB), ("c", RTF), ("d.docx", junk), ("e.docx", b"\x00\x01"), ("f.xls", XLSX), ("g.md", "caf\xe9".encode("latin-1")), ("h.odt", None), ("i", DOCX)]
    frame = spark.createDataFrame(rows, "path string, content binary")
    good, bad = readers.parse(frame, latin=True)
    got = {r.path: r for r in good.collect()}
    assert got["a.docx"].text == office.read(DOCX)[0] == got["i"].text and got["a.docx"].confidence == 0.98 and got["a.docx"].warning is None
    assert got["b.epub"].text.startswith("# Chapter\n")
    assert "text & more" in got["b.epub"].text and got["b.epub"].text.endswith("last") and "<" not in got["b.epub"].text
    assert got["c"].format == "rtf" and got["c"].text.startswith("# Head") and got["f.xls"].text.startswith("## Sales")
    assert got["d.docx"].confidence == 0.4 and got["d.docx"].warning.startswith("salvaged printable text; BadZipFile") and "readable words" in got["d.docx"].text
    assert got["g.md"].text == "café"
    assert readers.parse(frame)[0].where("path = 'g.md'").first().text == "caf�"
    assert {r.path: r.reason for r in bad.collect()}["e.docx"] == "no text"
