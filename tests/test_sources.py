"""Scan and parsers on files made here."""

import io
import os
import zipfile
import zlib

import pytest

from papyrine.errors import ParseError, ScanError
from papyrine.sources import parsers as P
from papyrine.sources.scan import scan_directory

OPTIONS = P.ParseOptions()


def refused(name, data, options=OPTIONS):
    with pytest.raises(ParseError) as e:
        P.parse(name, data, options)
    return e.value.kind


def test_plain_text():
    assert P.parse("Song.MD", "\ufeffLa la\tlà\n".encode(), OPTIONS) == "La la\tlà\n"
    assert P.parse("x.cpp", b"int main() {}", OPTIONS) == "int main() {}"
    assert refused("latin.txt", "naïve".encode("latin-1")) == "parse_utf8_invalid"
    assert refused("long.txt", b"12345678", P.ParseOptions(max_input=7)) == "parse_file_too_large"
    assert refused("photo.jpg", b"") == refused("README", b"") == refused(".md", b"") == "parse_format_unsupported"
    for limit in ("max_input", "max_output", "max_json_depth", "max_pdf_stream", "max_docx_entry"):
        with pytest.raises(ParseError):
            P.ParseOptions(**{limit: 0}).check()


def test_json(spark):
    text = '{"birds": [{"name": "wren", "eggs": [5, 6]}], "note": null}'
    assert P.parse("birds.json", text.encode(), OPTIONS) == text
    assert [P.json_depth(x) for x in ("wren", [], {"k": 1}, [[[]], {}])] == [0, 1, 1, 3]
    assert refused("cut.json", text.encode()[:-1]) == refused("inf.json", b"[Infinity]") == "parse_json_invalid"
    deep = b"[" * 33 + b"]" * 33
    assert refused("deep.json", deep) == "parse_json_depth_exceeded" and P.parse("deep.json", deep[1:-1], OPTIONS)
    assert refused("deeper.json", b"[" * 100_000) in ("parse_json_depth_exceeded", "parse_json_invalid")
    rows = spark.createDataFrame([(text,), ("7",), ("NaN",), ("[",), (None,)], "props string")
    assert [r[0] for r in rows.select(P.json_depths("props")).collect()] == [4, 0, None, None, None]


def test_html():
    page = """<!doctype html><title>not shown</title><style>p {color: red}</style>
    <h1>River   birds</h1><p>The <i>king</i>fisher &mdash; small &amp; blue<br>dives<noscript>no</noscript>
    <ul><li>heron<li>dipper</ul><script>var a = "<p>no</p>"</script><table><tr><td>one<td>two</table>"""
    assert P.parse("p.htm", page.encode(), OPTIONS) == "River birds\nThe kingfisher — small & blue\ndives\nheron\ndipper\none\ntwo"
    assert P.parse("empty.html", b"", OPTIONS) == ""
    assert refused("p.html", page.encode(), P.ParseOptions(max_output=10)) == "parse_output_too_large"


def document(xml, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, xml)
    return out.getvalue()


def test_docx():
    body = "".join(f"<w:p>{x}</w:p>" for x in ("<w:r><w:t>Dear reader, </w:t></w:r>", "", "<w:t>rain &lt; snow</w:t><w:cr/><w:t><![CDATA[a & b]]></w:t><w:tab/><w:t>end  </w:t>", ""))
    xml = f'<w:document xmlns:w="{P.WORD[1:-1]}"><w:body>{body}</w:body></w:document>'
    assert P.parse("letter.docx", document(xml), OPTIONS) == "Dear reader,\n\nrain < snow\na & b\tend"
    assert refused("letter.docx", document(xml), P.ParseOptions(max_docx_entry=50)) == "parse_docx_entry_too_large"
    assert refused("letter.docx", document(xml, "other.xml")) == "parse_docx_document_missing"
    assert refused("letter.docx", document("<w:p>")) == refused("letter.docx", document("<!DOCTYPE x><x/>")) == "parse_docx_xml_invalid"
    assert refused("letter.docx", document(xml)[:-30]) == "parse_docx_archive_invalid"


def stream(content, head=b"", packed=True):
    data = zlib.compress(content) if packed else content
    return b"<<%s%s>>\nstream\n%s\nendstream" % (head, b"/Filter /FlateDecode" if packed else b"", data)


def pdf(objects, tail=b""):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + tail


def test_pdf_of_latin_text():
    objects = {
        9: b"<</Type /Pages /Kids [3 0 R 8 0 R] /Count 3>>",
        3: b"<</Type /Pages /Parent 9 0 R /Kids [2 0 R 5 0 R]>>",
        2: b"<</Type /Page /Parent 3 0 R /Contents 1 0 R>>",
        1: stream(b"BT /F1 9 Tf 10 700 Td (Larks \\(brown\\) sing) Tj 0 -12 Td [(at d) 20 (awn) -300 (daily)] TJ ET"),
        5: b"<</Type /Page /Parent 3 0 R /Contents [6 0 R 7 0 R]>>",
        6: stream(b"BT <4F 77 6c73> Tj ET", packed=False),
        7: stream(b"BT (hunt \\145arly) Tj T* (or late) Tj ET"),
        8: b"<</Type /Page /Parent 9 0 R /Contents 4 0 R>>",
        4: stream(b"q 1 0 0 1 0 0 cm Q"),
    }
    assert P.parse("larks.pdf", pdf(objects), OPTIONS) == "Larks (brown) sing\nat dawn daily\n\nOwls\nhunt early\nor late"
    assert refused("larks.pdf", pdf(objects), P.ParseOptions(max_pdf_stream=20)) == "parse_pdf_content_too_large"
    assert refused("larks.pdf", pdf(objects), P.ParseOptions(max_output=20)) == "parse_output_too_large"
    assert refused("larks.pdf", pdf({1: b"<<>>"})) == refused("larks.pdf", pdf(objects, b"trailer <</Encrypt 1 0 R>>")) == "parse_pdf_parser_failed"
    assert refused("larks.pdf", b"no") == "parse_pdf_invalid"


def test_pdf_of_object_streams_and_mapped_fonts():
    inner = {11: b"<</Type /Pages /Kids [12 0 R] /Resources <</Font <</G0 13 0 R /G1 14 0 R>>>>>>", 12: b"<</Type /Page /Parent 11 0 R /Contents 20 0 R>>", 13: b"<</Type /Font /ToUnicode 21 0 R>>", 14: b"<</Type /Font /ToUnicode 22 0 R>>"}
    heads, bodies = [], b""
    for n, o in inner.items():
        heads.append(b"%d %d" % (n, len(bodies)))
        bodies += o + b" "
    head = b" ".join(heads) + b" "
    two = b"begincodespacerange <0000> <FFFF> endcodespacerange beginbfchar <0001> <03B1> <0002> <D83DDC26> endbfchar beginbfrange <0010> <0012> <0062> <0020> <0021> [<0066 0069> <0021>] endbfrange"
    one = b"begincodespacerange <00> <FF> endcodespacerange beginbfrange <41> <5A> <0061> endbfrange"
    objects = {
        10: stream(head + bodies, b"/Type /ObjStm /N 4 /First %d " % len(head)),
        20: stream(b"BT /G0 1 Tf <000100100011> Tj <00120020> Tj /G1 1 Tf 0 -1 Td (WREN) Tj /G0 1 Tf 5 0 Td <00020021> Tj ET"),
        21: stream(two.replace(b"0066 0069", b"00660069")),
        22: stream(one),
    }
    assert P.parse("coded.pdf", pdf(objects), OPTIONS) == "αbcdfi\nwren 🐦!"


@pytest.fixture
def tree(tmp_path):
    top = tmp_path / "top"
    for name in ("a/b/c", "a/hidden", "loop"):
        (top / name).mkdir(parents=True)
    (top / "one.md").write_text("1")
    (top / "a" / "b" / "c" / "two.TXT").write_text("22")
    (top / "a" / "hidden" / "three.md").write_text("333")
    os.mkfifo(top / "a" / "pipe")
    os.symlink(top / "one.md", top / "loop" / "link.md")
    os.symlink(top / "a", top / "loop" / "again")
    os.symlink(top / "nowhere", top / "loop" / "broken")
    return top


def scanned(spark, top, **more):
    return sorted((os.path.relpath(r["path_display"], top), r["status"], r["reason"]) for r in scan_directory(spark, str(top), **more).collect())


def test_scan(spark, tree, monkeypatch):
    found = scanned(spark, tree, ignored=[f"{tree}/a/hidden/"])
    assert found == [
        ("a/b/c/two.TXT", "file", None),
        ("a/hidden", "skipped", "ignored_path"),
        ("a/pipe", "skipped", "unsupported_file_type"),
        ("loop/again", "skipped", "symbolic_link"),
        ("loop/broken", "skipped", "symbolic_link"),
        ("loop/link.md", "skipped", "symbolic_link"),
        ("one.md", "file", None),
    ]
    sizes = {r["file_name"]: (r["size_bytes"], r["modified_at"] is not None) for r in scan_directory(spark, str(tree)).filter("status = 'file'").collect()}
    assert sizes == {"one.md": (1, True), "two.TXT": (2, True), "three.md": (3, True)}
    assert scanned(spark, tree, ignored=[str(tree)]) == []


def test_followed_links_are_visited_once(spark, tree):
    found = scanned(spark, tree, follow_symlinks=True)
    assert [x for x in found if x[2]] == [("a/pipe", "skipped", "unsupported_file_type"), ("loop/again", "skipped", "already_visited_directory"), ("loop/broken", "failed", "scan_read_entry_metadata")]
    assert sum(x[0].endswith("two.TXT") for x in found) == 1 and ("loop/link.md", "file", None) in found


def test_roots(spark, tree):
    os.symlink(tree, f"{tree}-link")
    for root, kind in ((f"{tree}-link", "scan_root_symlink"), (f"{tree}/one.md", "scan_root_invalid"), (f"{tree}/none", "scan_root_invalid")):
        with pytest.raises(Exception, match=kind):
            scan_directory(spark, root).collect()
    assert ScanError("x").kind == "x"


def test_parse_files(spark):
    rows = [("/x/a.md", 3, b"abc"), ("/x/b.md", 2, b"\xff\xfe"), ("/x/c.bin", 1, b"c"), ("/x/d.json", 2, b"{}"), ("/x/e.pdf", 1, b"e"), ("/x/f.txt", 99, b"f")]
    got = {r["title"]: (r["status"], r["body"], r["kind"]) for r in P.parse_files(spark.createDataFrame(rows, "path string, length long, content binary"), P.ParseOptions(max_input=50)).collect()}
    assert got == {"a.md": ("ok", "abc", None), "b.md": ("failed", None, "parse_utf8_invalid"), "c.bin": ("skipped", None, "parse_format_unsupported"), "d.json": ("ok", "{}", None), "e.pdf": ("failed", None, "parse_pdf_invalid"), "f.txt": ("failed", None, "parse_file_too_large")}
