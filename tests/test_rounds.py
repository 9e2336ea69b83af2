"""Fetching, schedules, scripts, manifests and filters on small cases."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sievework.functions.blake3 import blake3_hex
from sievework.operators import script, sink, usage
from sievework.plans.catalog import MANIFESTS, OPERATORS
from sievework.plans.pipeline import Pipeline, PipelineError, build, merge_total
from sievework.sources import fetch, schedule

NOON = datetime(2024, 3, 1, 12)


def test_blake3_of_many_chunks():
    data = bytes(k % 251 for k in range(31744))
    assert blake3_hex(data) == "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47"


def _client(*answers):
    seen, left = [], list(answers)

    def call(method, url, headers):
        seen.append((url, headers))
        return left.pop(0)

    return call, seen


def test_fetch_follows_redirects_and_keeps_credentials_home():
    call, seen = _client((302, {"location": "https://b.example.org/x.csv"}, []), (200, {"content-type": "text/csv; charset=latin1", "etag": "e"}, [b"a", b"b"]))
    got = fetch.fetch_one(call, "https://a.example.org/{{ date:%Y }}.csv", NOON, credentials={"authorization": "k"}, headers={"x": "1"}, allowed=["*.example.org"])
    assert (got["outcome"], got["data"], got["mime"], got["charset"], got["etag"], got["filename"]) == ("items", b"ab", "text/csv", "latin1", "e", "2024.csv")
    assert seen == [("https://a.example.org/2024.csv", {"x": "1", "authorization": "k"}), ("https://b.example.org/x.csv", {"x": "1"})]
    again, _ = _client((200, {}, [b"ab"]))
    assert fetch.fetch_one(again, "https://a.example.org/1", NOON, state={"hash": got["hash"]}, allowed=["a.example.org"])["outcome"] == "unchanged"


@pytest.mark.parametrize(
    "answers, transient",
    [
        ([(302, {"location": "http://127.0.0.1/"}, [])], False),
        ([(301, {"location": "/again"}, [])] * 9, True),
        ([(302, {}, [])], True),
        ([(404, {}, [])], False),
        ([(429, {}, [])], True),
        ([(500, {}, [])], True),
        ([(200, {}, [b"x" * 9, b"y" * 9])], False),
    ],
)
def test_fetch_failures(answers, transient):
    got = fetch.fetch_one(_client(*answers)[0], "https://a.example.org/", NOON, allowed=["a.example.org"], most=10)
    assert (got["outcome"], got["transient"], got["data"]) == ("failed", transient, None)


def test_cron_times():
    day = lambda *a: datetime(2024, *a)
    assert schedule.times("0 12 * * SUN", "UTC", day(3, 1), day(3, 11)) == [day(3, 3, 12), day(3, 10, 12)]
    assert schedule.times("0 12 * * 7", "UTC", day(3, 1), day(3, 4)) == [day(3, 3, 12)]
    assert schedule.times("30 2 * * *", "Europe/Berlin", day(3, 30), day(4, 1, 12)) == [day(3, 30, 1, 30), day(4, 1, 0, 30)]  # the clock leaves out 2:30 on the 31st
    assert schedule.times("50/5 0 29 2 *", "UTC", day(1, 1), day(12, 31)) == [day(2, 29, 0, 50), day(2, 29, 0, 55)]
    for bad in ("* * * *", "60 * * * *", "*/0 * * * *", "5-3 * * * *", "x * * * *", "*-3 * * * *", "", "1,,2 * * * *"):
        with pytest.raises(schedule.CronError):
            schedule.parse(bad)
    with pytest.raises(schedule.CronError):
        schedule.times("* * * * *", "Mars/Base", NOON, NOON)


@pytest.mark.parametrize(
    "config, words",
    [
        ({"set": {"title": "repeat(title, 1000)"}}, "cannot call repeat"),
        ({"set": {"title": "concat(replace(content, 'a', content), '')"}}, "quoted texts"),
        ({"set": {"title": "(" * 65 + "1" + ")" * 65}}, "nested deeper"),
        ({"set": {"title": "'" + "x" * 20000 + "'"}}, "longer than"),
        ({"set": {"title": "(select 1)"}}, "no query"),
        ({"set": {"filename": "'x'"}}, "cannot be written"),
        ({"set": {"title": "1"}, "max_ops": 0}, "max_ops must be"),
        ({"set": {"title": "1"}, "timeout_ms": 0}, "timeout_ms must be"),
        ({"set": {"title": "1"}, "loops": 2}, "unknown loops"),
        ({}, "not be empty"),
    ],
)
def test_script_limits(spark, config, words):
    docs = spark.createDataFrame([("a", "t", "c", "f")], "id string, title string, content string, filename string")
    with pytest.raises(script.ScriptError, match=words):
        script.run_config(docs, config)


def test_script_step(spark):
    docs = spark.createDataFrame([("a", "t(", None), ("b", None, "x" * 3000)], "id string, title string, content string")
    made = script.run_config(docs, {"set": {"id": "concat(id, '!')", "title": "replace(title, '(', ')')"}, "drop": ["content"]})
    assert [tuple(r) for r in made.orderBy("id").collect()] == [("a_", "t)"), ("b_", None)]
    grown = {"set": {"content": "replace(content, 'x', '" + "y" * 300 + "')"}}
    sizes = lambda mode: sorted((r["id"], len(r["content"] or "")) for r in script.run_config(docs, grown | {"on_error": mode}).collect())
    assert sizes("keep") == [("a", 0), ("b", 3000)] and sizes("skip") == [("a", 0)]
    with pytest.raises(Exception, match="script failed"):
        sizes("fail")


def _steps(*steps):
    return Pipeline.parse({"uid": "p", "steps": [dict(zip(("id", "plugin", "depends_on", "fan_out"), s, strict=False)) for s in steps]})


def test_what_steps_take(spark):
    blob = spark.createDataFrame([(b"a,b\n1,2\n", None, "f.csv", None, None)], "data binary, mime string, filename string, origin string, charset string")
    good = _steps(("one", "csv_parser"), ("two", "csv_parser", ["one"]))
    with pytest.raises(PipelineError, match="csv_parser accepts bytes but received documents"):
        build(good, blob, OPERATORS, MANIFESTS)
    with pytest.raises(PipelineError, match="fan out"):
        build(_steps(("audio", "video_audio_extractor"), ("two", "chunker", ["audio"], "$.documents")), blob, OPERATORS, MANIFESTS)
    done = build(_steps(("one", "csv_parser"), ("two", "document_script", ["one"], "$.documents"), ("three", "index_sink", ["one", "two"])), blob, OPERATORS | {"document_script": lambda df, config: df}, MANIFESTS)
    assert done["three"].count() == 2


def test_merge_total():
    p = _steps(("a", "x"), ("b", "x", ["a"]), ("c", "x", ["a", "b"]), ("d", "x", ["a", "b", "c"]))
    assert [merge_total(p, s) for s in "abcd"] == [3, 3, 3, None]


def test_filters_keep_parents_whole(spark):
    rows = [(0, 1, "p", "1"), (0, 2, "q", "2"), (0, 3, "p", "3"), (0, 4, "r\\", "4"), (0, 5, "s", "5\\"), (0, 6, "s", "6"), (0, 7, None, "7"), (1, 8, 't"', "8")]
    got = sink.prune_filters(spark.createDataFrame(rows, "part int, seq int, parent_id string, id string"), most=1)
    assert {(r["part"], r["n"], r["filter"]) for r in got.collect()} == {
        (0, 0, '_meta.parent_id IN ["p"] AND NOT id IN ["1", "3"]'),
        (0, 1, '_meta.parent_id IN ["q"] AND NOT id IN ["2"]'),
        (1, 0, '_meta.parent_id IN ["t\\""] AND NOT id IN ["8"]'),
    }


def test_usage_table_drifts(spark, tmp_path):
    path = f"file://{tmp_path}/usage"
    row = lambda sql: spark.range(1).selectExpr("'p' AS project_id", "timestamp'2024-01-05' AS ts", "'e' AS event_id", *sql)
    usage.write_usage(row(["1 AS n"]), path)
    usage.write_usage(row(["2 AS n", "'x' AS extra"]), path)
    assert sorted((r["n"], r["extra"]) for r in usage.read_usage(spark, path).collect()) == [(1, None), (2, "x")]
    with pytest.raises(ValueError, match="column n is int in the table, not string"):
        usage.write_usage(row(["'3' AS n"]), path)


@pytest.mark.parametrize("per", [None, ["g"]])
@pytest.mark.parametrize("order", ["v", "s"])
def test_fan_out_as_by_row_numbers(spark, per, order):
    rows = spark.range(0, 1000).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE CASE WHEN id < 700 THEN 5 ELSE id * 31 % 97 END END AS v", "CASE WHEN id % 5 > 0 THEN id % 3 END AS g", "cast(id % 11 AS string) AS s")
    got = {r["id"]: r["branch"] for r in usage.fan_out(rows, [order, "id"], 30, per).collect()}
    groups: dict = {}
    for r in rows.collect():
        groups.setdefault(r["g"] if per else None, []).append(r)
    for members in groups.values():
        members.sort(key=lambda r: (r[order] is not None, r[order] if r[order] is not None else 0, r["id"]))
        size = -(-len(members) // 30)
        assert [got[r["id"]] for r in members] == [k // size for k in range(len(members))]
    assert len(got) == 1000 and usage.fan_out(rows.where(F.lit(False)), [order, "id"], 30, per).count() == 0
