"""Parsers from file bytes to text, and their use on a DataFrame of files."""

from __future__ import annotations

import codecs
import io
import json
import re
import zipfile
import zlib
from dataclasses import dataclass
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.errors import ParseError
from papyrine.functions.text import extension, file_name
from papyrine.schema import MAX_DOCX_ENTRY_BYTES, MAX_INPUT_BYTES, MAX_JSON_DEPTH, MAX_OUTPUT_BYTES, MAX_PDF_STREAM_BYTES

#: Extensions of the plain-text parser, of the others, and elements without visible text.
TEXT_EXTENSIONS = {"txt", "md", "py", "rs", "js", "ts", "java", "cpp"}
OTHER_EXTENSIONS = {"json", "html", "htm", "docx", "pdf"}
HIDDEN = {"script", "style", "noscript", "template", "title", "head"}
BLOCKS = {"address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul"}
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@dataclass(frozen=True)
class ParseOptions:
    max_input: int = MAX_INPUT_BYTES
    max_output: int = MAX_OUTPUT_BYTES
    max_pdf_stream: int = MAX_PDF_STREAM_BYTES
    max_docx_entry: int = MAX_DOCX_ENTRY_BYTES
    max_json_depth: int = MAX_JSON_DEPTH

    def check(self) -> ParseOptions:
        if min(self.max_input, self.max_output, self.max_pdf_stream, self.max_docx_entry, self.max_json_depth) < 1:
            raise ParseError("parse_size_limit_invalid")
        return self


def decode_text(data: bytes) -> str:
    """Strict UTF-8 without one leading byte-order mark."""
    try:
        return data.removeprefix(codecs.BOM_UTF8).decode("utf-8")
    except UnicodeDecodeError:
        raise ParseError("parse_utf8_invalid") from None


def json_depth(value) -> int:
    """0 for a scalar; each array or object adds one. Walks without recursion."""
    deepest, todo = 0, [(value, 0)]
    while todo:
        node, depth = todo.pop()
        if isinstance(node, (dict, list)):
            depth += 1
            todo += [(x, depth) for x in (node.values() if isinstance(node, dict) else node)]
        deepest = max(deepest, depth)
    return deepest


def parse_json(data: bytes, max_depth: int) -> str:
    text = decode_text(data)

    def refuse(_: str):
        raise ValueError

    try:
        value = json.loads(text, parse_constant=refuse)
    except RecursionError:
        raise ParseError("parse_json_depth_exceeded") from None
    except ValueError:
        raise ParseError("parse_json_invalid") from None
    if json_depth(value) > max_depth:
        raise ParseError("parse_json_depth_exceeded")
    return text


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN and tag != "head":
            self.hidden.append(tag)
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.hidden and tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
        elif tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def parse_html(data: bytes, max_output: int) -> str:
    """Visible text, a line for each block, white space in a line as one blank."""
    page = _Visible()
    page.feed(decode_text(data))
    page.close()
    lines = (re.sub(r" +", " ", x).strip() for x in "".join(page.out).split("\n"))
    text = "\n".join(x for x in lines if x)
    if len(text.encode()) > max_output:
        raise ParseError("parse_output_too_large")
    return text


def parse_docx(data: bytes, max_entry: int, max_output: int) -> str:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, ValueError):
        raise ParseError("parse_docx_archive_invalid") from None
    try:
        info = archive.getinfo("word/document.xml")
    except KeyError:
        raise ParseError("parse_docx_document_missing") from None
    try:
        with archive.open(info) as f:
            xml = f.read(max_entry + 1)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError):
        raise ParseError("parse_docx_archive_invalid") from None
    if len(xml) > max_entry:
        raise ParseError("parse_docx_entry_too_large")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ParseError("parse_docx_xml_invalid")
    out: list[str] = []
    try:
        for event, node in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
            if event == "end" and node.tag == f"{WORD}t":
                out.append(node.text or "")
            elif event == "end" and node.tag == f"{WORD}p":
                out.append("\n")
            elif event == "start" and node.tag in (f"{WORD}br", f"{WORD}cr"):
                out.append("\n")
            elif event == "start" and node.tag == f"{WORD}tab":
                out.append("\t")
    except ElementTree.ParseError:
        raise ParseError("parse_docx_xml_invalid") from None
    text = "\n".join(x.rstrip() for x in "".join(out).split("\n")).rstrip("\n")
    if len(text.encode()) > max_output:
        raise ParseError("parse_output_too_large")
    return text


_PDF_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s/<>()\[\]{}%]+|[-+]?\d*\.?\d+|[A-Za-z*'\"]+|\[|\]", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_REF = rb"(\d+)\s+\d+\s+R"
#: Thousandths of an em by which a text is moved on that count as a blank.
PDF_GAP = 200


@dataclass
class _Font:
    """How a font's codes are read: bytes of a code, and the text of those that are mapped."""

    size: int = 1
    texts: dict[int, str] | None = None

    def read(self, data: bytes) -> str:
        if self.texts is None:
            return data.decode("cp1252", "replace")
        codes = (int.from_bytes(data[i : i + self.size], "big") for i in range(0, len(data), self.size))
        return "".join(self.texts.get(c, "") for c in codes)


class _Pdf:
    """The objects of a file, those in object streams included, read by number."""

    def __init__(self, data: bytes, max_stream: int):
        self.max_stream = max_stream
        self.objects = {int(m[1]): m[3] for m in _PDF_OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        count, first = (re.search(rb"/%s\s+(\d+)" % key, body) for key in (b"N", b"First"))
        content = self.stream(body)
        if not (count and first and content):
            return
        head = [int(x) for x in content[: int(first[1])].split()[: 2 * int(count[1])]]
        starts = [int(first[1]) + at for at in head[1::2]]
        for number, start, end in zip(head[::2], starts, [*starts[1:], len(content)], strict=True):
            self.objects.setdefault(number, content[start:end])

    def stream(self, body: bytes) -> bytes:
        """The bytes of an object's stream; b"" without one or with a filter that is not known."""
        found = _PDF_STREAM.search(body)
        if not found:
            return b""
        head, raw = body[: found.start()], found[1]
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if filters not in ([], [b"FlateDecode"]):
            return b""
        if filters:
            try:
                raw = zlib.decompressobj().decompress(raw, self.max_stream + 1)
            except zlib.error:
                raise ParseError("parse_pdf_invalid") from None
        if len(raw) > self.max_stream:
            raise ParseError("parse_pdf_content_too_large")
        return raw

    def value(self, body: bytes, key: bytes) -> bytes:
        """The value of a key: a dictionary, an array, or what a reference names."""
        found = re.search(rb"/%s(?![A-Za-z])\s*" % key, body)
        if not found:
            return b""
        rest = body[found.end() :]
        if ref := re.match(_REF, rest):
            return self.objects.get(int(ref[1]), b"")
        if rest.startswith(b"<<"):
            depth = 0
            for m in re.finditer(rb"<<|>>", rest):
                depth += 1 if m[0] == b"<<" else -1
                if not depth:
                    return rest[: m.end()]
        if rest.startswith(b"["):
            return rest[: rest.find(b"]") + 1]
        return re.match(rb"/?[^\s/<>\[\]]*", rest)[0]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in order: from the root down the tree, or by number where there is no root."""
        is_page = lambda body: re.search(rb"/Type\s*/Page\b(?!s)", body)
        roots = [body for _, body in sorted(self.objects.items()) if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body]
        out, seen = [], set()
        todo = [(body, b"") for body in reversed(roots)]
        while todo:
            body, above = todo.pop()
            resources = self.value(body, b"Resources") or above
            if is_page(body):
                out.append((body, resources))
                continue
            kids = [int(x) for x in re.findall(_REF, self.value(body, b"Kids"))]
            fresh = [k for k in kids if k not in seen]
            seen.update(fresh)
            todo += [(self.objects[k], resources) for k in reversed(fresh) if k in self.objects]
        return out or [(body, self.value(body, b"Resources")) for _, body in sorted(self.objects.items()) if is_page(body)]

    def fonts(self, resources: bytes) -> dict[bytes, _Font]:
        names = re.findall(rb"/([^\s/<>\[\]()]+)\s+" + _REF, self.value(resources, b"Font"))
        return {name: self.font(self.objects.get(int(number), b"")) for name, number in names}

    def font(self, body: bytes) -> _Font:
        """A font with a table from codes to text, or one of Latin text."""
        table = self.stream(self.value(body, b"ToUnicode"))
        if not table:
            return _Font()
        spaces = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", table)
        texts: dict[int, str] = {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
            for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                texts[int(code, 16)] = text(to)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
            for low, high, to, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
                codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF) + 1)
                ends = [text(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", several)] if several else [text(to)[:-1] + chr(ord(text(to)[-1]) + i) for i in range(len(codes))]
                texts.update(zip(codes, ends, strict=False))
        return _Font(len(spaces[1]) // 2 if spaces else 1, texts)

    def text(self, page: bytes, resources: bytes) -> str:
        contents = self.value(page, b"Contents")
        if contents.startswith(b"["):
            data = b"\n".join(self.stream(self.objects.get(int(n), b"")) for n in re.findall(_REF, contents))
        else:
            data = self.stream(contents)
        fonts, font = self.fonts(resources), _Font()
        out, operands, inside = "", [], False
        for m in _PDF_TOKEN.finditer(data):
            token = m[0]
            if token[:1] in b"(</[]" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
                operands.append(token)
                continue
            if token == b"Tf" and len(operands) > 1:
                font = fonts.get(operands[-2][1:], _Font())
            elif token in (b"Td", b"TD", b"T*", b"'", b'"', b"Tm", b"ET") and out and not out.endswith("\n"):
                # A line moved to its own height is a new one; one moved along goes on after a blank.
                along = token in (b"Td", b"TD") and len(operands) > 1 and float(operands[-1]) == 0
                out += " " if along else "\n"
            inside = (inside or token == b"BT") and token != b"ET"
            if inside and token in (b"Tj", b"TJ", b"'", b'"'):
                for x in operands:
                    if x[:1] in b"(<" and x[:2] != b"<<":
                        out += font.read(_pdf_string(x))
                    elif token == b"TJ" and x[:1] not in b"/[]<>" and float(x) <= -PDF_GAP and out and not out.endswith((" ", "\n")):
                        out += " "
            operands = []
        return out


def _pdf_string(token: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(e: re.Match) -> bytes:
        if e[1][:1].isdigit():
            return bytes([int(e[1], 8) & 255])
        return b"" if e[1] in (b"\n", b"\r\n") else _PDF_ESCAPES.get(e[1], e[1])

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


def parse_pdf(data: bytes, max_stream: int, max_output: int) -> str:
    """Text of PDF files: pages in order, trimmed, empty pages dropped, a blank line between. Knows object
    streams, Flate streams, and fonts with a table to Unicode or of Latin text; nothing is decrypted."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ParseError("parse_pdf_invalid")
    try:
        pdf = _Pdf(data, max_stream)
        pages = pdf.pages()
        if not pages or re.search(rb"/Encrypt\b", data):
            raise ParseError("parse_pdf_parser_failed")
        texts = (pdf.text(*page).strip() for page in pages)
        result = "\n\n".join(t for t in texts if t)
    except (ValueError, IndexError, OverflowError):
        raise ParseError("parse_pdf_parser_failed") from None
    if len(result.encode("utf-8", "surrogatepass")) > max_output:
        raise ParseError("parse_output_too_large")
    return result


def parse(name: str, data: bytes, options: ParseOptions) -> str:
    """Text of a file by its extension (any case)."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
    if len(data) > options.max_input:
        raise ParseError("parse_file_too_large")
    if ext in TEXT_EXTENSIONS:
        return decode_text(data)
    if ext == "json":
        return parse_json(data, options.max_json_depth)
    if ext in ("html", "htm"):
        return parse_html(data, options.max_output)
    if ext == "docx":
        return parse_docx(data, options.max_docx_entry, options.max_output)
    if ext == "pdf":
        return parse_pdf(data, options.max_pdf_stream, options.max_output)
    raise ParseError("parse_format_unsupported")


def parse_files(files: DataFrame, options: ParseOptions | None = None) -> DataFrame:
    """path, title, body, status (ok, skipped or failed) and kind of files given as (path, length,
    content). Unsupported formats are skipped and files too large fail before their bytes are read
    further; plain text is decoded by Spark itself, other formats in Arrow batches."""
    options = (options or ParseOptions()).check()
    name = file_name(F.col("path"))
    named = files.select("path", "length", "content", name.alias("title"), extension(name).alias("ext"))
    large = F.col("length") > options.max_input
    supported = F.coalesce(F.col("ext").isin(*TEXT_EXTENSIONS, *OTHER_EXTENSIONS), F.lit(False))
    bad = named.filter(~supported | large).select("path", "title", F.lit(None).cast("string").alias("body"), F.when(~supported, "skipped").otherwise("failed").alias("status"), F.when(~supported, "parse_format_unsupported").otherwise("parse_file_too_large").alias("kind"))
    good = named.filter(supported & ~large)
    text = good.filter(F.col("ext").isin(*TEXT_EXTENSIONS))
    body = F.regexp_replace(F.col("content").cast("string"), "^\\x{FEFF}", "")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    plain = text.select("path", "title", F.when(valid, body).alias("body"), F.when(valid, "ok").otherwise("failed").alias("status"), F.when(~valid, "parse_utf8_invalid").alias("kind"))

    @F.pandas_udf("body string, kind string")
    def other(names: pd.Series, contents: pd.Series) -> pd.DataFrame:
        rows = []
        for n, c in zip(names, contents, strict=True):
            try:
                rows.append((parse(n, bytes(c), options), None))
            except ParseError as e:
                rows.append((None, e.kind))
        return pd.DataFrame(rows, columns=["body", "kind"])

    rich = good.filter(~F.col("ext").isin(*TEXT_EXTENSIONS)).withColumn("r", other("title", "content")).select("path", "title", "r.body", F.when(F.col("r.kind").isNull(), "ok").otherwise("failed").alias("status"), "r.kind")
    return bad.unionByName(plain).unionByName(rich)


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Visible text of HTML strings; null where it cannot be parsed."""

    def one(html: str | None) -> str | None:
        try:
            return None if html is None else parse_html(html.encode(), MAX_OUTPUT_BYTES)
        except ParseError:
            return None

    return pages.map(one)


@F.pandas_udf(T.IntegerType())
def json_depths(texts: pd.Series) -> pd.Series:
    """Depth of JSON strings; null where invalid, as NaN and the infinities are."""

    def refuse(_: str):
        raise ValueError

    def one(text: str | None) -> int | None:
        try:
            return None if text is None else json_depth(json.loads(text, parse_constant=refuse))
        except (ValueError, RecursionError):
            return None

    return texts.map(one).astype("Int32")
