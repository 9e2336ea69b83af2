"""Files cut into splits at any byte against the parse of their whole texts."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.operators import csv, csv_scan, json_records

TEXT = 'k;name;note\n1;Ann;"two\nlines; and ""more"""\n\n2;Bob;plain\r\n;;\n3;"Zoë\n\n\nx";\n4;日本;"a;b"\n'


def whole(text, stem, **config):
    return sorted((d["id"] or f"{stem}_r{d['row']}", d["content"], json.loads(d["fields"])) for d in csv.rows(text, **config))


def scanned(spark, path, **config):
    return sorted((r["id"], r["content"], json.loads(r["fields"])) for r in csv_scan.scan_csv(spark, str(path), **config).collect())


@pytest.fixture
def splits(spark):
    def of(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield of
    for key in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{key}")


@pytest.mark.parametrize("size", [9, 40, 1000])
def test_splits_at_any_byte(spark, tmp_path, splits, size):
    (tmp_path / "my file.csv").write_bytes(TEXT.encode())
    splits(size)
    assert csv_scan.lines_of(spark, str(tmp_path)).select("split").distinct().count() >= (2 if size < 100 else 1)
    assert scanned(spark, tmp_path) == whole(TEXT, "my_file")


def test_settings_and_several_files(spark, tmp_path, splits):
    splits(60)
    (tmp_path / "a.csv").write_text("id,v\nx 1,5\n,6\n")
    (tmp_path / "b.csv").write_text("id|v\n" + "".join(f"y{n}|{n}\n" for n in range(40)))
    want = whole((tmp_path / "a.csv").read_text(), "a", id_column="id") + whole((tmp_path / "b.csv").read_text(), "b", id_column="id")
    assert scanned(spark, tmp_path, id_column="id") == sorted((i.replace(" ", "_"), c, f) for i, c, f in want)
    assert len(scanned(spark, tmp_path / "b.csv", max_rows=7)) == 7
    assert scanned(spark, tmp_path / "a.csv", has_headers=False) == whole((tmp_path / "a.csv").read_text(), "a", has_headers=False)
    with pytest.raises(Exception, match="unknown column 'nope'"):
        scanned(spark, tmp_path / "a.csv", id_column="nope")
    (tmp_path / "c.csv").write_text('a,b\n1,"open\n2,3\n')
    with pytest.raises(Exception, match="quotes that never close"):
        scanned(spark, tmp_path / "c.csv")


def test_ndjson(spark, tmp_path, splits):
    splits(300)
    text = "".join(json.dumps({"id": f"i {n}" if n % 3 else None, "t": f"text {n}"}) + ("\n\n" if n % 5 == 0 else "\r\n") for n in range(60))
    (tmp_path / "e.ndjson").write_bytes(text.encode())
    got = sorted(tuple(r) for r in csv_scan.scan_ndjson(spark, str(tmp_path / "e.ndjson")).collect())
    blobs = spark.createDataFrame([("e", text)], "stem string, data string")
    want = sorted(tuple(r) for r in json_records.flatten_payloads(blobs).select("id", "title", "content", "fields").collect())
    assert got == want and len(got) == 60
    assert csv_scan.scan_ndjson(spark, str(tmp_path / "e.ndjson")).where(F.col("id") == "e_0").count() == 1
