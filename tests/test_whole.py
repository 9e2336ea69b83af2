"""Queries and operators on the whole of their input, where the SQL compares a part or there is none."""

import io
import json
from datetime import date, datetime, timezone
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from sievework.operators import index, parquet
from sievework.plans import catalog

QUERIES = entry.queries()


def test_index_json_holds_the_whole_text(spark, tmp_path):
    deep = "x" * 60 + ' "quoted" \\ \n\t\r\b\f \x00\x01\x1f\x7f </é😀 > end'
    rows = [(1, deep, "en", "s"), (2, deep * 200, None, 'a"b'), (3, "", "de", None), (4, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["j"] for r in QUERIES["to_index_json_whole"](spark, str(tmp_path)).collect()}
    for k, text, lang, source in rows:
        want = {"id": str(k), "content": text, "source": source, "_meta": {"language": lang} if lang else None}
        assert json.dumps(json.loads(got[k])) == json.dumps({x: v for x, v in want.items() if v is not None})


def test_titles_of_all_pages(spark, tmp_path):
    body = "<body><main><p>text</p></main></body>"
    pages = [("<title>A &amp; B &lt;c&gt; &eacute;&#8212;</title>", "A & B <c> é—"), ("<title> two\n words </title>", "two words"), ("<title></title>", None), ("<title> \n </title>", None), ("", None)]
    spark.createDataFrame([(k, f"http://h/{k}", f"<html><head>{head}</head>{body}</html>") for k, (head, _) in enumerate(pages)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["title"] for r in QUERIES["html_title_all"](spark, str(tmp_path)).collect()}
    assert {k: v or None for k, v in got.items()} == dict(enumerate(t for _, t in pages))


def file_of(table: pa.Table, **options) -> bytes:
    out = io.BytesIO()
    pq.write_table(table, out, **options)
    return out.getvalue()


TABLE = pa.table(
    {
        "n": pa.array([1, None, 3], pa.int64()),
        "s": ["x", "y", None],
        "d": pa.array([Decimal("1.50"), None, Decimal("-2.25")], pa.decimal128(15, 2)),
        "w": pa.array([Decimal("12345678901234567890.1234567890"), None, Decimal("0.5")], pa.decimal128(30, 10)),
        "f": pa.array([0.1, float("nan"), None], pa.float32()),
        "t": pa.array([datetime(2020, 1, 2, 3, 4, 5, 60000), None, datetime(2020, 1, 2)], pa.timestamp("us")),
        "z": pa.array([datetime(2020, 1, 2, tzinfo=timezone.utc), None, None], pa.timestamp("ms", "Europe/Paris")),
        "day": pa.array([date(1969, 12, 31), None, None]),
        "b": pa.array([b"\x00\xff", None, None]),
        "o": pa.array([{"p": 1, "q": {"r": None, "u": "v"}}, None, {"p": None, "q": None}]),
        "l": pa.array([[1, None], [], None], pa.list_(pa.int64())),
        "m": pa.array([[("k", 1), ("j", None)], None, []], pa.map_(pa.string(), pa.int64())),
        "c": pa.array(["u", "u", None]).dictionary_encode(),
    }
)
FIRST = {"n": 1, "s": "x", "d": 1.5, "w": "12345678901234567890.1234567890", "f": 0.1, "t": "2020-01-02T03:04:05.060", "z": "2020-01-02T01:00:00+01:00", "day": "1969-12-31", "b": "00ff", "o": {"p": 1, "q": {"u": "v"}}, "l": [1, None], "m": {"k": 1}, "c": "u"}


@pytest.mark.parametrize("batch", [1, 2, 1024])
def test_parquet_records(batch):
    data = file_of(TABLE, row_group_size=2)
    rows = parquet.parquet_records(data, batch_size=batch)
    assert rows == [FIRST, {"s": "y", "f": None, "l": [], "c": "u"}, {"n": 3, "d": -2.25, "w": "0.5000000000", "t": "2020-01-02T00:00:00", "o": {}, "m": {}}]
    assert parquet.parquet_records(data, max_rows=2, batch_size=batch) == rows[:2]
    assert parquet.parquet_records(data, columns=["o.q", "n"], max_rows=1) == [{"n": 1, "o": {"q": {"u": "v"}}}]


def test_parquet_errors(monkeypatch):
    data = file_of(TABLE)
    for config in ({"columns": ["none"]}, {"columns": []}, {"max_rows": 0}, {"batch_size": 0}):
        with pytest.raises(ValueError, match="invalid config"):
            parquet.parquet_records(data, **config)
    for bad in (b"", b"PAR1", data[:-1], b"PAR1" + b"\0" * 20 + b"PAR1", data[:4] + b"\0" * 8 + data[-4:]):
        with pytest.raises(ValueError, match="invalid input"):
            parquet.parquet_records(bad)
    monkeypatch.setattr(parquet.json_records, "MAX_ROWS", 2)
    with pytest.raises(ValueError, match="nothing is cut off"):
        parquet.parquet_records(data)
    assert len(parquet.parquet_records(data, max_rows=2)) == 2


def test_parquet_operator(spark):
    data = file_of(pa.table({"id": ["a b", None], "name": ["N", "M"], "k": [1, 2]}))
    blobs = spark.createDataFrame([(data, "application/vnd.apache.parquet", "set.parquet", None, None)], "data binary, mime string, filename string, origin string, charset string")
    got = [(r["id"], r["title"], r["content"], r["fields"]) for r in catalog.OPERATORS["parquet_parser"](blobs, {"title_field": "name"}).collect()]
    assert got == [("a_b", "N", "", '{"k":1}'), ("set_r2", "M", "", '{"k":2}')]


def test_parquet_query_reads_all_columns(spark, tmp_path):
    pq.write_table(pa.table({"c_custkey": [1], "c_name": ["x"], "c_nationkey": [2], "c_acctbal": [1.25], "c_mktsegment": [None]}), f"{tmp_path}/customer.parquet")
    (row,) = QUERIES["parquet_parse_all"](spark, str(tmp_path)).collect()
    assert (row["id"], json.loads(row["fields"])) == ("customer_r1", {"c_custkey": 1, "c_name": "x", "c_nationkey": 2, "c_acctbal": 1.25})


def test_reflatten_operator(spark):
    docs = spark.createDataFrame([("u", "T", "C", '{"a":{"b":1},"x":"y"}', 5), ("w", None, "", '{"id":"n w","x":"y"}', 6), ("v", None, "C", None, 7)], "id string, title string, content string, fields string, page int")
    got = [tuple(r) for r in catalog.OPERATORS["json_flattener"](docs, {}).collect()]
    assert got == [("u", "T", "C", '{"a.b":1,"x":"y"}', 5), ("n_w", None, "y", '{"x":"y"}', 6), ("v", None, "C", "{}", 7)]


def test_json_flatten_keeps_the_events_number(spark, tmp_path):
    pq.write_table(pa.table({"event_id": [7, 8], "props": ['{"k": 1}', '{"k": 2}']}), f"{tmp_path}/events.parquet")
    got = sorted(tuple(r[c] for c in ("id", "event_id", "k", "content")) for r in QUERIES["json_flatten"](spark, str(tmp_path)).collect())
    assert got == [("ev7_0", 7, 1, ""), ("ev8_0", 8, 2, "")]


def test_pipelines_from_files_to_the_index(spark, tmp_path):
    from sievework.plans import catalog, pipeline
    from sievework.queries import files

    see, hear = (lambda data: '{"caption": "a cat", "kind": "photo"}'), (lambda data: [{"start": 0.0, "end": 1.0, "text": "hello"}])
    operators = catalog.with_clients(transcribe=hear, see=see, answer=lambda q, text: {k: {"value": "x", "confidence": 0.9} for k in q})
    blobs = {
        "builtin.csv": ("a.csv", b"name,n\nx,1\ny,2\n"), "builtin.json": ("b.json", b'[{"id": 1, "t": "x"}]'), "builtin.html": ("c.html", b"<title>T</title><main><p>some text</p></main>"), "builtin.text": ("d.txt", b"plain text"),
        "builtin.markdown": ("e.md", b"# One\n\ntext\n"), "builtin.image": ("f.png", b"\x89PNG"), "builtin.audio": ("g.wav", files.wav_file(1, "")), "builtin.xlsx": ("h.xlsx", files.xlsx_file(3, "x")),
    }
    built = {p.uid: p for p in pipeline.builtin_pipelines()}
    checked = 0
    for uid, (name, data) in blobs.items():
        if uid not in built:
            continue
        steps = [{"id": s.id, "plugin": s.plugin, "depends_on": list(s.depends_on), "config": s.config | ({"path": str(tmp_path / uid)} if s.plugin == "index_sink" else {})} for s in built[uid].steps]
        p = pipeline.Pipeline.parse({"uid": uid, "steps": steps})
        source = spark.createDataFrame([(data, None, name, None, None)], "data binary, mime string, filename string, origin string, charset string")
        seen = []
        for _ in range(2):  # again changes nothing
            pipeline.build(p, source, operators)[p.order()[-1]].collect()
            seen.append(sorted(map(str, index.read_index(spark, str(tmp_path / uid)).collect())))
        assert seen[0] == seen[1] and seen[0], uid
        checked += 1
    assert checked >= 6
    for p in built.values():  # every built-in pipeline names operators that there are
        assert all(s.plugin in operators for s in p.steps)
    asked = operators["jev_enricher"](spark.createDataFrame([("t", "c", '{"a":1}')], "title string, content string, fields string"), {"questions": {"q": {"kind": "choice", "options": ["x", "y"]}}}).first()
    assert asked["fields"] == '{"a":1,"q":"x","q_confidence":0.9}'


def test_oversized_documents_stop_the_sink(spark, tmp_path):
    from sievework.operators import sink

    docs = spark.createDataFrame([("a", "x" * 50)], "id string, content string")
    with pytest.raises(sink.OversizedDocument):
        sink.run(docs, {"path": str(tmp_path / "i"), "max_batch_bytes": 40})
    assert not (tmp_path / "i").exists()


def test_newer_deliveries_and_fnv():
    from sievework.functions import ids

    assert [ids.fnv1a64(x) for x in ("", "a", "foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]


@pytest.mark.parametrize(("last", "age"), [("01.499999", 2505600), ("01.5", 2505601), ("02.5", 2505601), ("02.500001", 2505602), ("02", 2505601)])
def test_the_age_of_the_oldest_event_is_that_of_the_sql(spark, tmp_path, last, age):
    import duckdb

    moments = f"(1::BIGINT, TIMESTAMP '2024-01-01 00:00:01.9', 'error'), (2, TIMESTAMP '2024-01-30 00:00:{last}', 'view')"
    duck = duckdb.connect()
    duck.sql(f"COPY (SELECT * FROM (VALUES {moments}) t(event_id, ts, event_type)) TO '{tmp_path}/events.parquet'")
    duck.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in QUERIES["outbox_stats"](spark, str(tmp_path)).collect()]
    assert got == [(1, age)] == duck.sql(entry.oracle_sql()["outbox_stats"]).fetchall()


def test_parquet_queries_read_files_beyond_the_operators_limits(spark, tmp_path):
    from sievework.operators import json_records

    n = json_records.MAX_ROWS + 1
    pq.write_table(pa.table({"c_custkey": pa.array(range(n)), "c_name": pa.repeat("x", n), "c_nationkey": pa.repeat(2, n)}), f"{tmp_path}/customer.parquet")
    made = QUERIES["parquet_parse_all"](spark, str(tmp_path))
    last = made.where(made["id"] == f"customer_r{n}").first()
    assert (made.count(), json.loads(last["fields"])["c_custkey"]) == (n, n - 1)
    assert QUERIES["parquet_parse"](spark, str(tmp_path)).where("fields is not null").count() == n


def test_parquet_queries_give_the_operators_rows(spark, tmp_path):
    from sievework.operators.documents import read_blobs

    pq.write_table(pa.table({"c_custkey": [1, 2], "c_name": ["x", None], "c_nationkey": [2, None], "c_acctbal": [1.25, -0.5], "c_mktsegment": [None, "m"]}), f"{tmp_path}/customer.parquet")
    want = catalog.OPERATORS["parquet_parser"](read_blobs(spark, f"{tmp_path}/customer.parquet"), {})
    got = QUERIES["parquet_parse_all"](spark, str(tmp_path))
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_pages_are_read_once_and_chunks_leave_their_list(spark, tmp_path):
    """Two Python stages of pickled batches, and no row of a chunk holds the other chunks."""
    spark.createDataFrame([(1, "u", "<title>T</title><main><p>" + "A sentence of words. " * 100 + "</p></main>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = QUERIES["html_pipeline"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == plan.count("EvalPython") == 2
    (generate,) = (line for line in plan.splitlines() if "Generate" in line)
    assert "parts" not in generate.split("[", 1)[1]
    got = [json.loads(r["json"]) for r in made.collect()]
    assert [d["id"] for d in sorted(got, key=lambda d: d["_meta"]["chunk_index"])] == [f"page_1_{k}" for k in range(len(got))]
    assert len(got) > 3 and {d["_meta"]["chunk_total"] for d in got} == {len(got)}


def test_ids_of_chunks_at_the_limit(spark):
    from pyspark.sql import functions as F

    from sievework.functions import ids
    from sievework.operators import chunker

    docs = spark.createDataFrame([("a" * n, "One sentence here. " * 60, "own") for n in (498, 499, 500, 508, 509, 510, 511)], "id string, content string, tag string")
    made = chunker.chunk_documents(docs, chunker.ChunkConfig(chunk_size=60, overlap=0))
    want = made.select("id", ids.suffixed_id(F.col("parent_id"), F.concat(F.lit("_"), F.col("chunk_index").cast("string"))).alias("want"), "tag").collect()
    assert len(want) > 7 * 11 and all(r["id"] == r["want"] and len(r["id"]) <= 511 and r["tag"] == "own" for r in want)
