"""Small files of each format, as the queries of formats read them. Workers import this, so nothing here is a column."""

from __future__ import annotations

import io
import json
import struct
import zipfile

from ..operators import enrich


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def zigzag(n: int) -> bytes:
    n, out = n << 1 if n >= 0 else (-n << 1) - 1, b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def avro_file(n: int, text: str) -> bytes:
    block = lambda b: zigzag(len(b)) + b
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "n", "type": "long"}, {"name": "s", "type": ["null", "string"]}]}).encode()
    record = zigzag(n - 500) + zigzag(1) + block(text.encode())
    return b"Obj\x01" + zigzag(1) + block(b"avro.schema") + block(schema) + zigzag(0) + b"s" * 16 + zigzag(2) + block(record + zigzag(n) + zigzag(0)) + b"s" * 16


def xlsx_file(n: int, text: str) -> bytes:
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'
    sheet = f'<row r="1">{cell("A1", "name")}{cell("B1", "n")}</row><row r="2">{cell("A2", text)}{cell("B2", n)}</row><row r="4">{cell("B4", n / 2)}</row>'
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return zipped({
        "xl/workbook.xml": f'<workbook xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships><Relationship Id="rId1" Type="{r}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{sheet}</sheetData></worksheet>",
    })


def docx_file(n: int, text: str) -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table_ = f"<w:tbl><w:tr><w:tc>{p(n)}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    return zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{p(text)}{p("second " + str(n))}{table_}</w:body></w:document>'})


def pptx_file(n: int, text: str) -> bytes:
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *shapes: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{"".join(map(shape, shapes))}</p:spTree></p:cSld></p:sld>'
    return zipped({
        "ppt/presentation.xml": '<p:presentation xmlns:p="p"/>',
        "ppt/slides/slide10.xml": slide(f"last {n}"), "ppt/slides/slide2.xml": slide(text, f"body {n}"),
    })


def archive_file(n: int, text: str) -> bytes:
    return zipped({"a/one.txt": text, "__MACOSX/x": "x", "../out": "x", "two.txt.gz": ""}) if n % 2 else zipped({"in.txt": f"{n}"})


def wav_file(n: int, text: str) -> bytes:
    body = bytes((n % 7) * 8000)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(body)) + body


def stub(prompt: str, text: str) -> str:
    if text.startswith("error"):
        raise enrich.Declined("no")
    return json.dumps({"title": text.upper(), "language": "xx", "n": len(text), "_hidden": 1, "kind": "new"})
