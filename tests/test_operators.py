"""Operators that SQL can't express: golden cases, round trips and invariants on our own fixtures."""

import gzip
import io
import json
import math
import random
import struct
import tarfile
import uuid
import wave
import zipfile
import zlib
from datetime import datetime, timezone

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.functions.blake3 import blake3_hex
from sievework.functions.mime import glob_to_regex
from sievework.operators import archives, audio, binary_records, chunker, csv, enrich, html, json_records, markdown, office, pdf
from sievework.plans import catalog
from sievework.plans.pipeline import Pipeline, PipelineError, build, builtin_pipelines, inject
from sievework.sources import url


def test_blake3_vectors():
    data = bytes(i % 251 for i in range(3000))
    assert blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3_hex(data[:1]) == "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213"
    assert len({blake3_hex(data[:n]) for n in (1023, 1024, 1025, 2048, 2049, 3000)}) == 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "é.", "it. ", "!", "\n", "\n\n", " ", "日本語", "longerword", "x? "]), max_size=120), st.sampled_from(["fixed", "sentence", "paragraph"]), st.integers(8, 60), st.integers(0, 7))
def test_chunks_lose_nothing(parts, strategy, size, overlap):
    text = "".join(parts)
    made = chunker.chunk(text, chunker.ChunkConfig(strategy, size, overlap, 4))
    assert all(made) and all(len(c) <= size + 4 + 2 for c in made)
    if overlap == 0:
        squeezed = lambda x: "".join(x.split())
        assert squeezed("".join(made)) == squeezed(text)


def test_chunk_rules():
    assert chunker.sentences("One. Two!? Three... Four\nfive") == ["One.", "Two!?", "Three...", "Four", "five"]
    assert chunker.paragraphs("a\nb\n \n\nc") == ["a\nb", "c"]
    assert chunker.tail("hello big world", 7) == "world"
    assert chunker.pack(["aaaa", "bbbb", "cc"], " ", 9, 4, 0) == ["aaaa bbbb", "bbbb cc"]
    assert chunker.pack(["aaaa bbbb", "cc"], " ", 9, 0, 3) == ["aaaa bbbb cc"]
    for bad in ({"chunk_size": 0}, {"overlap": 512}, {"x": 1}, {"strategy": "no"}):
        with pytest.raises(ValueError):
            chunker.ChunkConfig.parse(bad)


def test_csv():
    assert [csv.sniff(t) for t in ("a;b\n1;2\n", "a\tb\n1\t2", '"x,y"|b\n1|2', "only words", "one, two, x\na, b\n")] == [";", "\t", "|", ",", ","]
    assert csv.column_names(["a", "", "a", "_row", "col_2"], 6) == ["a", "col_2_2", "a_2", "_row", "col_2", "col_6"]
    assert [csv.typed(x) for x in ("7", "007", "-1.5", "1e5", "TRUE", "+1", "18446744073709551616")] == [7, "007", -1.5, "1e5", True, "+1", "18446744073709551616"]
    got = csv.rows("name,age,score\nAnn,31,1.5\n,,\nBob,,2\n", id_column="name")
    assert [(d["row"], d["id"], d["content"], json.loads(d["fields"])) for d in got] == [(1, "Ann", "Ann 31 1.5", {"_row": 1, "name": "Ann", "age": 31, "score": 1.5}), (3, "Bob", "Bob 2", {"_row": 3, "name": "Bob", "score": 2})]
    assert csv.decode("é".encode("cp1252")) == "é" and csv.decode(b"\xef\xbb\xbfx") == "x" and csv.decode("é".encode("utf-16-le"), forced="utf-16-le") == "é"
    many = csv.column_names(["h"] * 3000, 3000)
    assert len(set(many)) == 3000


def test_json():
    config = json_records.FlattenConfig(title_field="name")
    d = json_records.document({"id": 7, "name": "N", "a.b": 1, "a": {"b": 2, "c": {}}, "t": ["x", "y"]}, "_0", config)
    assert (d["id"], d["title"], json.loads(d["fields"])) == ("7", "N", {"a.b": 2, "a.b_2": 1, "a.c": {}, "t": ["x", "y"]}) and d["content"] == "x y"
    assert json_records.parse('{"a":1}\n\n{"items":[1,2]}', json_records.FlattenConfig()) == [{"a": 1}, {"items": [1, 2]}]
    assert json_records.roots({"x": {"y": [1, 2]}}, "/x/y") == [1, 2]
    with pytest.raises(json_records.InvalidInput):
        json_records.roots({"x": 1}, "/x")
    with pytest.raises(json_records.InvalidInput):
        json_records.check_limits([1, 2, 3], most_rows=2)


def test_html():
    page = """<!doctype html><html lang="fr-FR"><head><title> A  b </title><meta name="Description" content="d"><style>x</style></head><body><header><h1>no</h1></header><nav><a href="/n">n</a></nav>
    <main><h1>Head</h1><p>One <b>two</b><p>three<br>four<ul><li>i<li>j</ul><table><tr><td>c1<td>c2<tr><td>c3</table><a href=" /x "> link</a><a href="/x">l</a><script>bad()</script></main><footer>f</footer></body></html>"""
    got = html.extract(page)
    assert got == {"title": "A b", "content": "Head\nOne two\nthree\nfour\ni\nj\nc1\tc2\nc3\nlinkl", "language": "fr-FR", "description": "d", "links": ["/x"]}
    assert html.extract("<p> </p>") is None and html.extract(None) is None
    assert html.extract("plain &amp; text")["content"] == "plain & text"
    assert html.decode_html("é".encode("latin-1"), "iso-8859-1") == "é"
    assert html.extract("<div>" * 5000 + "deep")["content"] == "deep"


def test_markdown():
    got = markdown.markdown_documents(b"---\ntitle: T\ntags: [a]\n---\nintro *em* [l](u)\n\n# One\n- a\n  1. b\n- [x] c\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n```\n# code\n```\n# Two\nend <b>x</b>\n")
    assert [(d["suffix"], d["title"], d["content"]) for d in got] == [("_s1", "T", "intro em l"), ("_s2", "One", "- a\n  1. b\n- [x] c\n\nh\ti\n1\t2\n\n# code"), ("_s3", "Two", "end x")]
    assert json.loads(got[0]["fields"]) == {"tags": ["a"]}


def zipped(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


REL = '<Relationships xmlns="r">{}</Relationships>'


def test_xlsx():
    sheet = '<worksheet xmlns="m"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="XFD1" t="inlineStr"><is><t>last</t></is></c></row><row r="1048576"><c r="A1048576"><v>3</v></c><c r="XFD1048576"><v>1.5</v></c></row></sheetData></worksheet>'
    book = zipped({
        "xl/workbook.xml": '<workbook xmlns="m" xmlns:r="q"><sheets><sheet name="S 1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": REL.format('<Relationship Id="rId1" Type="x/worksheet" Target="worksheets/sheet1.xml"/>'),
        "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": '<sst xmlns="m"><si><t>first</t></si></sst>',
    })
    (d,) = office.xlsx_documents(book)
    assert d["suffix"] == "_S_1_r1048576" and json.loads(d["fields"]) == {"_row": 1048576, "first": 3, "last": 1.5} and d["section"] == "S 1"
    assert [json.loads(x["fields"])["_row"] for x in office.xlsx_documents(book, has_headers=False)] == [1, 1048576]
    assert office.xlsx_documents(book, mode="sheet")[0]["content"] == "first\tlast\n3\t1.5"


def test_docx_and_pptx():
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = "<w:tbl><w:tr><w:tc>" + p("a") + "</w:tc><w:tc>" + p("b") + "</w:tc></w:tr><w:tr><w:tc>" + p("") + "</w:tc></w:tr></w:tbl>"
    doc = zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{p("My title", "Title")}{p("x")}{p("H", "Heading1")}{p("y")}{table}</w:body></w:document>'})
    assert office.docx_documents(doc) == [{"title": "My title", "content": "x\n\nH\n\ny\n\na\tb"}]
    assert [(d["suffix"], d["content"]) for d in office.docx_documents(doc, split_on_headings=True)] == [("_s1", "x"), ("_s2", "y\n\na\tb")]
    sp = lambda t, k: f'<p:sp><p:nvPr><p:ph type="{k}"/></p:nvPr><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>'
    slide = lambda *s: f'<p:sld xmlns:p="p" xmlns:a="a">{"".join(s)}</p:sld>'
    deck = zipped({
        "ppt/slides/slide10.xml": slide(sp("ten", "body")), "ppt/slides/slide2.xml": slide(sp("body", "body"), sp("Two", "title"), sp("9", "sldNum")),
        "ppt/slides/_rels/slide2.xml.rels": REL.format('<Relationship Id="r" Type="x/notesSlide" Target="../notesSlides/n1.xml"/>'), "ppt/notesSlides/n1.xml": slide(sp("note", "body")),
    })
    assert [(d["suffix"], d["title"], d["content"], json.loads(d["fields"])) for d in office.pptx_documents(deck)] == [("_s1", "Two", "body\nTwo", {"notes": "note"}), ("_s2", "ten", "ten", {})]
    with pytest.raises(office.InvalidInput):
        office.docx_documents(b"no zip")


def test_msgpack():
    data = bytes([0x82, 0xA1]) + b"a" + bytes([0x93, 1, 0xFF, 0xC0, 1, 0xC4, 2]) + b"hi"
    assert binary_records.msgpack_records(data) == [{"a": [1, -1, None], "1": "aGk="}]
    assert binary_records.msgpack_records(bytes([1, 2])) == [1, 2]
    assert binary_records.msgpack_value(binary_records.Reader(bytes([0xD6, 0xFF]) + struct.pack(">I", 0))) == "1970-01-01T00:00:00Z"
    assert binary_records.msgpack_value(binary_records.Reader(bytes([0xCB]) + struct.pack(">d", math.inf))) is None
    with pytest.raises(binary_records.InvalidInput):
        binary_records.msgpack_records(bytes([0xA5]) + b"ab")


@pytest.mark.parametrize("codec", ["null", "deflate", "snappy"])
def test_avro(codec):
    def zigzag(n):
        n = n << 1 ^ n >> 63
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    text = lambda b: zigzag(len(b)) + b
    schema = {"type": "record", "name": "R", "fields": [{"name": "n", "type": "long"}, {"name": "s", "type": ["null", "string"]}, {"name": "d", "type": {"type": "bytes", "logicalType": "decimal", "scale": 2}}, {"name": "t", "type": {"type": "long", "logicalType": "timestamp-millis"}}, {"name": "a", "type": {"type": "array", "items": "int"}}]}
    row = zigzag(-3) + zigzag(1) + text(b"x") + text((-12345).to_bytes(3, "big", signed=True)) + zigzag(1500) + zigzag(2) + zigzag(1) + zigzag(2) + zigzag(0)
    body = row * 2
    packed = {"null": body, "deflate": zlib.compress(body)[2:-4], "snappy": bytes([len(body), (len(row) - 1) << 2]) + row + bytes([(len(row) - 1) << 2 | 2, len(row), 0]) + b"crc4"}[codec]
    sync = b"s" * 16
    data = b"Obj\x01" + zigzag(2) + text(b"avro.schema") + text(json.dumps(schema).encode()) + text(b"avro.codec") + text(codec.encode()) + zigzag(0) + sync + zigzag(2) + text(packed) + sync
    assert binary_records.avro_records(data) == [{"n": -3, "s": "x", "d": "-123.45", "t": "1970-01-01T00:00:01.5Z", "a": [1, 2]}] * 2


def test_archives():
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        for name, body in (("d/a.txt", b"A"), ("../up", b"x"), ("._b", b"n")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    data = zipped({"in.tar.gz": gzip.compress(tar.getvalue()), "x.docx": zipped({"word/document.xml": "w"}), "big": b"z" * 100, "__MACOSX/q": b"q"})
    got = {f["path"]: (f["status"], f["reason"]) for f in archives.walk(data, "o.zip", archives.Limits(max_file_bytes=50_000))}
    assert got["x.docx"] == ("file", None) and got["big"] == ("file", None) and "__MACOSX/q" not in got
    assert [v for k, v in got.items() if k.endswith("a.txt")] == [("file", None)] and ("skipped", "unsafe path") in got.values()
    assert {f["reason"] for f in archives.walk(data, "o.zip", archives.Limits(max_depth=1))} == {None, "nested too deeply"}
    with pytest.raises(archives.ArchiveError):
        archives.walk(data, "o.zip", archives.Limits(max_files=1))
    with pytest.raises(archives.ArchiveError):
        archives.walk(b"text", "t")


def test_pdf():
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(wor) -20 (ld) -300 (end)] TJ ET")
    data = b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R 5 0 R]>>endobj 3 0 obj<</Type/Page/Contents 4 0 R>>endobj 4 0 obj<</Filter/FlateDecode>>stream\n" + stream + b"\nendstream endobj 5 0 obj<</Type/Page>>endobj"
    assert pdf.pdf_documents(data) == [{"suffix": "_p1", "content": "Hello (you)\nworld end", "page": 1}]
    with pytest.raises(pdf.InvalidInput):
        pdf.pdf_documents(b"no")


def wav(seconds=1.0, rate=8000, channels=2) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        t = np.arange(int(seconds * rate))
        w.writeframes(np.repeat((np.sin(t / 20) * 8000).astype("<i2"), channels).tobytes())
    return out.getvalue()


def test_audio():
    data = wav()
    assert audio.duration(data) == 1.0 and audio.duration(b"x") is None
    pieces = audio.windows(data, 10_044)
    assert sum(audio.duration(p) for _, p in pieces) == pytest.approx(1.0) and pieces[1][0] == pytest.approx(2500 / 8000)
    assert audio.duration(audio.resample(data)) == pytest.approx(1.0, abs=0.001)
    got = audio.transcribe(data, lambda p: [{"start": 0.0, "end": 0.1, "text": " hi "}], segment_documents=True, max_bytes=20_000)
    assert [d["suffix"] for d in got] == ["_t0", "_t1"] and got[1]["content"] == "hi"
    with pytest.raises(ValueError):
        audio.transcribe(data, None)


def test_enrich():
    doc = {"title": None, "language": "en", "fields": {"topic": "old"}}
    reply = '```json\n{"title": "T", "language": "fr", "topic": "new", "_geo": 1, "x": null}\n```'
    assert enrich.apply_reply(doc, reply) == {"title": "T", "language": "en", "fields": {"topic": "old", "x": None}}
    assert enrich.apply_reply(doc, reply, enrich.EnrichConfig(merge_strategy="replace", allow_reserved=("_geo",)))["fields"] == {"topic": "new", "_geo": 1, "x": None}
    assert enrich.apply_reply(doc, "no json")["fields"]["llm_raw"] == "no json"
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise enrich.Retryable("429")
        return "ok"

    assert enrich.with_retry(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3
    assert enrich.answer_fields({"a": {"kind": "yesno"}}, {"a": {"confidence": 0.7}}) == {"a": True, "a_confidence": 0.7}
    with pytest.raises(ValueError):
        enrich.answer_fields({"a": {"kind": "yesno"}}, {})
    assert enrich.caption_document('{"caption": "c", "text_in_image": "t", "_x": 1}') == {"content": "c", "fields": {"ocr_text": "t"}}


def test_pipelines():
    assert len(builtin_pipelines()) == 15 and all(p.order() for p in builtin_pipelines())
    p = Pipeline.parse({"uid": "u", "steps": [{"id": "a", "plugin": "x"}, {"id": "b", "plugin": "x", "depends_on": ["a"]}, {"id": "c", "plugin": "x", "depends_on": ["a"]}, {"id": "d", "plugin": "index_sink", "depends_on": ["c", "b"], "config": {"index": "i"}}]})
    assert p.order() == ["a", "b", "c", "d"] and p.ready({"a"}) == ["b", "c"] and p.fixed_index() == "i"
    bad = {
        "Empty": [], "DuplicateStep": [{"id": "a", "plugin": "x"}] * 2, "UnknownDependency": [{"id": "a", "plugin": "x", "depends_on": ["z"]}],
        "Cycle": [{"id": "a", "plugin": "x", "depends_on": ["b"]}, {"id": "b", "plugin": "x", "depends_on": ["a"]}], "FanOutArity": [{"id": "a", "plugin": "x", "fan_out": "$"}],
        "FanOutPath": [{"id": "a", "plugin": "x"}, {"id": "b", "plugin": "x", "fan_out": "$.x"}], "PruneWithFanOut": [{"id": "a", "plugin": "x"}, {"id": "b", "plugin": "index_sink", "fan_out": "$.documents", "config": {"prune": True}}],
    }
    for kind, steps in bad.items():
        with pytest.raises(PipelineError) as e:
            Pipeline.parse({"uid": "u", "steps": [dict(s) for s in steps]}).order()
        assert e.value.kind == kind
    assert inject({"host": "h", "index": " "}, {"host": "r", "index": "i"}) == {"host": "r", "index": "i"}


def test_run_builtin_pipeline(spark):
    blobs = spark.createDataFrame([(bytearray(b"<title>T</title><p>Some text."), "text/html", "p.html", None, None), (bytearray(b"<p> </p>"), "text/html", "q.html", None, None)], "data binary, mime string, filename string, origin string, charset string")
    html_pipeline = next(p for p in builtin_pipelines() if p.uid == "builtin.html")
    rows = build(html_pipeline, blobs, catalog.OPERATORS)["index"].collect()
    assert [(r["id"], r["content"], r["parent_id"]) for r in rows] == [("p_0", "Some text.", "p")]
    with pytest.raises(NotImplementedError):
        build(next(p for p in builtin_pipelines() if p.uid == "builtin.audio"), blobs, catalog.OPERATORS)


def test_sources():
    at = datetime(2026, 3, 1, 0, 30, tzinfo=timezone.utc)
    assert url.render("x/{{ date-1d:%Y-%m-%d }}/{{date:%H}}?t={{ timestamp }}", at, "Europe/Paris") == f"x/2026-02-28/01?t={int(at.timestamp())}"
    for bad in ("{{ day }}", "{{ date:%", "{{ date+1w:%Y }}"):
        with pytest.raises(url.TemplateError):
            url.render(bad, at)
    assert url.host_allowed("a.example.org", ["*.example.org"]) and not url.host_allowed("10.0.0.1") and not url.host_allowed("localhost")
    assert url.object_allowed("s3://b/k", ["b"]) and not url.object_allowed("s3://c/k", ["b"])
    assert url.file_job_id(uuid.UUID(int=1), 2) == url.file_job_id(uuid.UUID(int=1), 2) != url.file_job_id(uuid.UUID(int=1), 3)


def test_glob_many_stars():
    import re

    assert not re.match(glob_to_regex("*a" * 12 + "b"), "a" * 300)
    assert re.match(glob_to_regex("*.P?F"), "x.pdf")


def test_index_is_idempotent(spark, tmp_path):
    from sievework.operators import index

    make = lambda rows: spark.createDataFrame(rows, "id string, parent_id string, chunk_total int, v string, seq long")
    path = str(tmp_path / "index")
    index.write_index(spark, make([("p_0", "p", 2, "a", 1), ("p_1", "p", 2, "b", 2), ("q_0", "q", 1, "c", 3)]), path)
    again = make([("p_0", "p", 1, "new", 4)])
    for _ in range(2):
        index.write_index(spark, again, path, prune_stale=True)
        assert sorted((r["id"], r["v"]) for r in index.read_index(spark, path).collect()) == [("p_0", "new"), ("q_0", "c")]


def test_sampled_ids_are_stable(spark):
    from pyspark.sql import functions as F

    from sievework.functions import ids

    rows = spark.createDataFrame([("报告.pdf",), ("a/" + "x" * 600 + ".txt",), ("/",), (None,)], "f string").select(ids.filename_id_stem(F.col("f"))).collect()
    assert rows[0][0] == f"___{blake3_hex('报告'.encode())[:12]}" and len(rows[1][0]) == 400 and rows[2][0] is None and rows[3][0] is None
    random.seed(0)
