"""Parquet by Spark's scan against the operator on whole files."""

import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sievework.operators import parquet, parquet_scan
from sievework.operators.json_records import InvalidConfig

from test_whole import TABLE

PLAIN = TABLE.drop_columns(["z"])  # a zone's name is not the file's


def by_bytes(path, **config):
    made = parquet.parquet_documents(path.read_bytes(), **config)
    return [(d["id"] or path.stem + d["suffix"], d["title"], d["content"], json.loads(d["fields"])) for d in made]


def by_scan(spark, path, **config):
    found = parquet_scan.scan(spark, str(path), **config).collect()
    return sorted(((r["id"], r["title"], r["content"], json.loads(r["fields"])) for r in found), key=lambda x: x[0])


@pytest.mark.parametrize("config", [{}, {"columns": ["s", "o", "n"]}, {"id_field": "s"}, {"title_field": "s", "content_fields": ("w", "n")}, {"max_depth": 1}, {"max_rows": 2}])
def test_rows_of_both(spark, tmp_path, config):
    path = tmp_path / "some file.parquet"
    pq.write_table(PLAIN, path, row_group_size=1)
    want = by_bytes(path, **config)
    got = by_scan(spark, path, **config)
    clean = lambda rows: sorted((i.replace(" ", "_"), t, c, f) for i, t, c, f in rows)
    assert [x[:3] for x in clean(got)] == [x[:3] for x in clean(want)]
    assert [x[3] for x in clean(got)] == [x[3] for x in clean(want)]


def test_many_splits_and_pruning(spark, tmp_path):
    path = tmp_path / "big.parquet"
    pq.write_table(pa.table({"k": pa.array(range(5000)), "t": ["x" * 50] * 5000, "unused": [1.5] * 5000}), path, row_group_size=100)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        made = parquet_scan.scan(spark, str(path), columns=["k", "t"])
        assert made.rdd.getNumPartitions() > 4
        plan = made._jdf.queryExecution().toString()
        assert "ReadSchema: struct<k:bigint,t:string," in plan and "unused" not in plan.split("== Physical Plan ==")[1] and "Python" not in plan
        ids = {r["id"]: json.loads(r["fields"])["k"] for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == {f"big_r{k + 1}": k for k in range(5000)}


def test_settings(spark, tmp_path):
    pq.write_table(PLAIN, tmp_path / "a.parquet")
    for config in ({"columns": ["nope"]}, {"columns": []}, {"max_rows": 0}):
        with pytest.raises(InvalidConfig, match="invalid config"):
            parquet_scan.scan(spark, str(tmp_path / "a.parquet"), **config)
    assert parquet_scan.scan(spark, str(tmp_path / "a.parquet")).where(F.col("id") == "a_r1").count() == 1
