"""Runs of pipelines with their step results, and the index that they write to."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import index, sink, usage
from sievework.plans.catalog import MANIFESTS, OPERATORS, STEPS
from sievework.plans.pipeline import Pipeline
from sievework.plans.run import execute

BLOBS = "job_id string, data binary, mime string, filename string, origin string, charset string"


def blobs(spark, *files):
    return spark.createDataFrame([(job, data, None, name, None, charset) for job, name, data, charset in files], BLOBS).repartition(2)


def pipeline(*steps):
    return Pipeline.parse({"uid": "p", "steps": [{"id": i, "plugin": p} | more for i, p, more in steps]})


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_one_bad_file_of_three(spark, tmp_path):
    files = blobs(spark, ("a", "a.csv", b"n,t\n1,x\n2,y\n", None), ("b", "b.csv", b"k,v\n1,2\n", None), ("c", "c.csv", b"n,t\n", None))
    p = pipeline(("parse", "csv_parser", {"config": {"id_column": "n"}}), ("cut", "chunker", {}), ("index", "index_sink", {"config": {"path": str(tmp_path / "index")}}))
    ran = execute(p, files, STEPS, MANIFESTS)
    results = ran.results()
    assert rows(results, "job_id", "step_id", "status", "documents_out", "branches") == [
        ("a", "cut", "succeeded", 2, 1), ("a", "index", "succeeded", 2, 1), ("a", "parse", "succeeded", 2, 1), ("b", "parse", "failed", 0, 1),
        ("c", "cut", "succeeded", 0, 1), ("c", "index", "succeeded", 0, 1), ("c", "parse", "succeeded", 0, 1),
    ]
    (bad,) = [r for r in results.collect() if r["status"] == "failed"]
    assert bad["error"].startswith("invalid config: csv_parser: id_column names an unknown column 'n'") and bad["input_bytes"] == 0  # what a failed branch consumed is not told
    assert ran.totals == {"rows": 2, "errors": 1, "input_bytes": ran.totals["input_bytes"]} and ran.totals["input_bytes"] > 0
    assert rows(index.read_index(spark, str(tmp_path / "index")), "id", "content") == [("1_0", "1 x"), ("2_0", "2 y")]
    assert rows(ran.jobs(), "job_id", "status") == [("a", "succeeded"), ("b", "failed"), ("c", "succeeded")]
    # what a run left is what metering takes
    jobs = ran.jobs().select("job_id", *(F.lit("x").alias(c) for c in ("workflow_id", "project_id", "region", "pipeline_uid", "index_name", "task_queue", "input_mime")), F.lit(0).alias("pipeline_builtin"), "status", F.lit(1).cast("long").alias("input_bytes"), F.current_timestamp().alias("started_at"), F.current_timestamp().alias("finished_at"), "error")
    events = {r["event_id"]: r for r in usage.events_for_jobs(results, jobs).collect()}
    assert len(events) == 7 + 3 and events["b:parse:1"]["error_kind"] == events["b:job"]["error_kind"] == "invalid_config"
    assert events["b:job"]["error"].startswith("step parse (csv_parser) failed: invalid config") and events["a:job"]["documents_out"] == 2


def test_data_goes_through_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(rows_, config):
        def see(x):
            calls.add(1)
            return x

        return STEPS["csv_parser"](rows_.withColumn("filename", F.udf(see, "string")("filename")), config)

    ran = execute(pipeline(("parse", "csv_parser", {}), ("left", "chunker", {"depends_on": ["parse"]}), ("right", "index_sink", {"depends_on": ["parse"]})), blobs(spark, ("a", "a.csv", b"n\n1\n2\n", None)), STEPS | {"csv_parser": count})
    assert ran.results().count() == 3 and ran.output("left").count() == ran.output("right").count() == 2 and ran.branches().count() == 3
    assert calls.value == 1


def test_a_failing_branch_fails_its_step_and_keeps_the_others(spark):
    docs = spark.createDataFrame([("j", f"d{n:04}", None, "bad" if n == 700 else "word " * 3, "{}") for n in range(1200)] + [("k", "x", None, "fine", "{}")], "job_id string, id string, title string, content string, fields string").coalesce(1)
    script = {"set": {"title": "upper(content)"}, "valid": "content <> 'bad'"}
    p = pipeline(("in", "document_script", {"config": {"keep": "true"}}), ("script", "document_script", {"fan_out": "$.documents", "config": script}), ("next", "chunker", {}))
    ran = execute(p, docs, STEPS, MANIFESTS)
    got = {(r["job_id"], r["step_id"]): r for r in ran.results().collect()}
    failed = got["j", "script"]
    assert (failed["status"], failed["branches"], failed["documents_out"]) == ("failed", 400, 0)  # groups of three
    assert failed["error"] == "1 of 400 branches failed; first error: invalid input: the script failed for a document"
    kept = {r["step_id"]: r for r in ran.outcomes().where("job_id = 'j'").collect()}["script"]
    assert kept["documents"] == 1197 and kept["input_bytes"] > 1197 * 256
    assert ("j", "next") not in got and (got["k", "script"]["branches"], got["k", "next"]["documents_out"]) == (1, 1)
    assert rows(ran.output("next"), "job_id", "id", "title") == [("k", "x_0", "FINE")]


def test_many_goes_on_by_branch(spark):
    docs = spark.createDataFrame([("j", f"d{n}", None, "one", "{}") for n in range(6)], "job_id string, id string, title string, content string, fields string").coalesce(1)
    p = pipeline(("in", "document_script", {"config": {"keep": "true"}}), ("a", "chunker", {"fan_out": "$.documents"}), ("b", "chunker", {"fan_out": "$.many"}), ("c", "chunker", {"fan_out": "$"}))
    got = {r["step_id"]: (r["branches"], r["documents_out"]) for r in execute(p, docs, STEPS, MANIFESTS).results().collect()}
    assert got == {"in": (1, 6), "a": (6, 6), "b": (6, 6), "c": (1, 6)}


def test_bad_configuration_fails_the_jobs(spark):
    ran = execute(pipeline(("parse", "csv_parser", {"config": {"nope": 1}})), blobs(spark, ("a", "a.csv", b"n\n1\n", None)), STEPS)
    (r,) = ran.results().collect()
    assert r["status"] == "failed" and r["error"].startswith("invalid config: csv_parser: unknown nope")


def test_archives_and_text(spark):
    import io
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("x.txt", "hello there")
        z.writestr("y.txt", b"\xff\xfe\xfa bad")
    p = pipeline(("open", "archive_expander", {}), ("cut", "chunker", {}))
    ran = execute(p, blobs(spark, ("good", "a.zip", made.getvalue(), None), ("none", "b.zip", b"no zip", None)), STEPS, MANIFESTS)
    got = {(r["job_id"], r["step_id"]): (r["status"], r["documents_out"], r["error"]) for r in ran.results().collect()}
    assert got["good", "open"] == ("succeeded", 2, None) and got["none", "open"][0] == "failed" and ("none", "cut") not in got
    assert got["good", "cut"][0] == "failed" and got["good", "cut"][2].startswith("invalid input: not valid utf-8 text")


# the registry


def extract(spark, name, data, config=None, charset=None):
    return OPERATORS[name](blobs(spark, ("j", "people.csv", data, charset)).drop("job_id"), config or {})


def test_records_keep_their_ids(spark):
    config = {"id_column": "sku", "content_columns": ["t"]}
    first = rows(extract(spark, "csv_parser", b"sku,t\nA 1,Hat\nB-2,Shoe\n", config), "id", "content", "fields")
    assert first == [("A_1", "Hat", '{"_row":1,"sku":"A 1","t":"Hat"}'), ("B-2", "Shoe", '{"_row":2,"sku":"B-2","t":"Shoe"}')]
    moved = rows(extract(spark, "csv_parser", b"sku,t\nB-2,Shoe\n,Cap\nA 1,Hat\n", config), "id", "content")
    assert moved == [("A_1", "Hat"), ("B-2", "Shoe"), ("people_r2", "Cap")]
    assert rows(extract(spark, "json_flattener", b'[{"id": "x1", "t": "a"}, {"id": 7}, {"t": "b"}]'), "id") == [("7",), ("people_2",), ("x1",)]
    assert rows(extract(spark, "json_flattener", b'{"items": [{"k": {"u": "z z"}}]}', {"id_field": "k.u"}), "id") == [("z_z",)]


@pytest.mark.parametrize(
    ("name", "config", "message"),
    [
        ("csv_parser", {"id_column": "nope"}, "unknown column 'nope'"),
        ("csv_parser", {"content_columns": ["a", "z"]}, "content_columns names an unknown column 'z'"),
        ("csv_parser", {"has_headers": False, "id_column": "a"}, "positional name"),
        ("csv_parser", {"max_rows": 0}, "max_rows"),
        ("csv_parser", {"delimiter": "ab"}, "delimiter"),
        *((n, {"unknown_key": 1}, "unknown") for n in ("csv_parser", "json_flattener", "html_extractor", "archive_expander", "video_audio_extractor", "markdown_extractor", "pdf_extractor", "index_sink")),
    ],
)
def test_bad_settings(spark, name, config, message):
    with pytest.raises(Exception, match="invalid config") as e:
        extract(spark, name, b"a,b\n1,2\n", config).collect()
    assert message in str(e.value)


def test_positional_columns_and_row_numbers(spark):
    assert rows(extract(spark, "csv_parser", b"1,x\n2,y\n", {"has_headers": False, "id_column": "col_2"}), "id") == [("x",), ("y",)]
    assert rows(extract(spark, "csv_parser", b"_row,v\n99,x\n"), "fields") == [('{"_row":99,"_row_2":1,"v":"x"}',)]


def test_html_keeps_language_description_and_links(spark):
    page = '<html lang="fr-FR"><head><title>T</title><meta name="Description" content="about"></head><body><main><p>café <a href="/x">l</a></p></main></body></html>'
    (r,) = extract(spark, "html_extractor", page.encode("latin-1"), {"extract_links": True}, "latin-1").collect()
    assert (r["title"], r["content"], r["language"], json.loads(r["fields"])) == ("T", "café l", "fr-FR", {"description": "about", "links": ["/x"]})
    (r,) = extract(spark, "html_extractor", page.encode(), {"include_meta_description": False}).collect()
    assert r["fields"] is None and r["language"] == "fr-FR"
    stored = json.loads(OPERATORS["index_sink"](extract(spark, "html_extractor", page.encode()), {}).first()["json"])
    assert stored["_meta"]["language"] == "fr-FR"


def test_text_that_is_none(spark):
    with pytest.raises(Exception, match="invalid input: not valid utf-8 text"):
        OPERATORS["chunker"](blobs(spark, ("j", "a.txt", b"\xff\xff", None)).drop("job_id"), {}).collect()


# the index


def made(spark, *rows_):
    return spark.createDataFrame(list(rows_), "id string, parent_id string, chunk_total int, v string, seq long")


def files(path):
    return {p.name for p in path.iterdir()}


def test_upserts_write_their_own_rows_alone(spark, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(spark, made(spark, *((f"a{n}", None, None, "old", n) for n in range(20_000))), path)
    before = sum(f.stat().st_size for f in (tmp_path / "i").rglob("*.parquet"))
    index.write_index(spark, made(spark, ("a5", None, None, "new", 1), ("b", None, None, "x", 1)), path)
    after = sum(f.stat().st_size for f in (tmp_path / "i").rglob("*.parquet"))
    assert after - before < 0.1 * before
    got = {r["id"]: r["v"] for r in index.read_index(spark, path).collect()}
    assert len(got) == 20_001 and got["a5"] == "new" and got["b"] == "x" and got["a6"] == "old"
    assert index.read_index(spark, path, 1).where("id = 'a5'").first()["v"] == "old"


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index.write_index(spark, made(spark, ("a", None, None, "old", 1)), path)
    with monkeypatch.context() as m:
        m.setattr(index, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            index.write_index(spark, made(spark, ("a", None, None, "half", 1)), path)
    assert rows(index.read_index(spark, path), "id", "v") == [("a", "old")]
    index.write_index(spark, made(spark, ("b", None, None, "x", 1)), path)
    assert rows(index.read_index(spark, path), "id", "v") == [("a", "old"), ("b", "x")]
    assert index.vacuum(spark, path, 1) == 1 and rows(index.read_index(spark, path), "id") == [("a",), ("b",)]


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(spark, made(spark, ("a", None, None, "1", 1)), path)
    version, found = index.runs(spark, path)
    index.commit(spark, path, version, found)
    with pytest.raises(index.Conflict):
        index.commit(spark, path, version, found)
    stale, calls = index.runs, []

    def late(spark_, path_, v=None):  # the first look is at a version that another writer has followed
        calls.append(1)
        return (version, found) if len(calls) == 1 else stale(spark_, path_, v)

    index.runs = late
    try:
        index.write_index(spark, made(spark, ("b", None, None, "2", 1)), path)
    finally:
        index.runs = stale
    assert rows(index.read_index(spark, path), "id") == [("a",), ("b",)]


def test_compaction_and_tombstones(spark, tmp_path):
    path = str(tmp_path / "i")
    index.write_index(spark, made(spark, ("p_0", "p", 3, "a", 1), ("p_1", "p", 3, "b", 2), ("p_2", "p", 3, "c", 3)), path)
    index.write_index(spark, made(spark, ("p_0", "p", 1, "new", 4)), path, prune_stale=True)
    assert rows(index.read_index(spark, path), "id", "v") == [("p_0", "new")]
    for n in range(12):
        index.write_index(spark, made(spark, (f"q{n % 5}", None, None, str(n), n)), path)
        assert len(index.runs(spark, path)[1]) < 2 * index.MERGE
    assert rows(index.read_index(spark, path), "id", "v") == [("p_0", "new"), ("q0", "10"), ("q1", "11"), ("q2", "7"), ("q3", "8"), ("q4", "9")]
    index.vacuum(spark, path, 1)
    assert rows(index.read_index(spark, path), "id") == [("p_0",), *((f"q{n}",) for n in range(5))]


def test_runs_that_are_due():
    runs = lambda *n: [index.Run(str(k), x, "") for k, x in enumerate(n)]
    assert index.due(runs(1, 1, 1)) is None and index.due(runs(1, 1, 1, 1)) == (0, 4)
    assert index.due(runs(1, 1, 1, 1, 10**6)) == (0, 4) and index.due(runs(10**6, 1, 1)) is None
    assert index.due(runs(1, 10**6, 10**6, 10**6, 10**6)) == (0, 5)


def test_sink_step(spark, tmp_path):
    docs = spark.createDataFrame([("a", "t", "x"), ("b", "t", "y")], "id string, title string, content string")
    got = OPERATORS["index_sink"](docs, {"path": str(tmp_path / "i")})
    assert rows(got, "id", "content") == [("a", "x"), ("b", "y")]
    with pytest.raises(sink.OversizedDocument):
        OPERATORS["index_sink"](docs, {"path": str(tmp_path / "i"), "max_batch_bytes": 10})
