"""CSV and NDJSON files to documents by splits: no task reads a whole file.

Spark deals a file's lines out by splits. Each split counts its quotes and records; sums over the splits before tell whether a split
begins inside a quoted cell and with which record, so every record gets the number that a parse of the whole file would give it.
Lines of one record come together again, and records are parsed with their file's header and delimiter.

For UTF-8 files with line feeds whose quotes stand around whole cells, as writers write them. A file whose quotes do not balance is an
error; so are the settings that are errors in the whole parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ids import id_stem, sanitize_id
from . import csv
from .json_records import DOCUMENTS, FlattenConfig, document, parse
from .tables import stage

_UPTO = (Window.unboundedPreceding, Window.currentRow)


def _running(lines: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of value over a file's lines up to each: within splits, and over the splits before."""
    marked = lines.withColumn("_v", value.cast("long"))
    splits = marked.groupBy("file", "split").agg(F.sum("_v").alias("_n"))
    before = splits.select(F.col("file").alias("_f"), F.col("split").alias("_s"), (F.sum("_n").over(Window.partitionBy("file").orderBy("split").rowsBetween(*_UPTO)) - F.col("_n")).alias("_before"))  # a row a split
    within = F.sum("_v").over(Window.partitionBy("file", "split").orderBy("at").rowsBetween(*_UPTO))
    joined = marked.withColumn("_within", within).join(before, (F.col("file") == F.col("_f")) & (F.col("split") == F.col("_s")))
    return joined.withColumn(name, F.col("_within") + F.col("_before")).drop("_v", "_within", "_f", "_s", "_before")


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """file, split, at (order in the split), line."""
    read = spark.read.option("lineSep", "\n").text(path)
    return stage(read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")), "lines")


def records_of(lines: DataFrame) -> DataFrame:
    """file, n (from 0), text of each record: lines whose quotes are open take the next line along. Blank records count as none."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counted = _running(lines, quotes, "quotes").withColumn("_own", quotes)
    inside = (F.col("quotes") - F.col("_own")) % 2 == 1
    text = F.regexp_replace("line", "\r$", "")
    starts = ~inside & (text != "")
    marked = _running(counted.withColumn("_starts", starts), F.col("_starts").cast("int"), "record").where(inside | F.col("_starts"))
    whole = marked.groupBy("file", (F.col("record") - 1).alias("n")).agg(F.array_sort(F.collect_list(F.struct("split", "at", "line"))).alias("l"), F.sum("_own").alias("_q"))
    joined = F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), "\r$", "")
    odd = F.concat(F.lit("invalid input: quotes that never close in "), "file")
    return whole.select("file", "n", F.when(F.col("_q") % 2 == 1, F.raise_error(odd).cast("string")).otherwise(joined).alias("text"))


def _stem(file: Column) -> Column:
    return id_stem(F.url_decode(F.replace(F.element_at(F.split(file, "/"), -1), F.lit("+"), F.lit("%2B"))), F.lit(None).cast("string"))


def scan_csv(spark: SparkSession, path: str, **config) -> DataFrame:
    """id, content, fields, row of the records of the files at path, as csv.parse_csv() gives of their whole texts. config as there."""
    found = stage(records_of(lines_of(spark, path)), "records")
    sample = found.where(F.col("n") < csv.SAMPLE_RECORDS).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("l"))  # at most that many a file
    head = sample.select(F.col("file").alias("_f"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("sample"), F.when(F.lit(config.get("has_headers", True)), F.col("l")[0]["text"]).alias("header"))
    mark = F.lit(config["delimiter"]) if config.get("delimiter") else F.udf(csv.sniff, "string", useArrow=True)("sample")
    heads = head.select("_f", mark.alias("mark"), "header")
    first = 1 if config.get("has_headers", True) else 0
    rows = found.where(F.col("n") >= first).join(heads, F.col("file") == F.col("_f"))
    if config.get("max_rows"):
        rows = rows.where(F.col("n") < config["max_rows"] + first)
    own = {k: v for k, v in config.items() if k not in ("delimiter", "max_rows")}

    @F.udf(csv.ROWS, useArrow=True)
    def parsed(header, text, mark):
        return csv.rows(text if header is None else f"{header}\n{text}", delimiter=mark, **own)

    each = rows.select("file", (F.col("n") - first + 1).cast("int").alias("row"), F.explode(parsed("header", "text", "mark")).alias("d"))
    # a record parsed alone is the first of its file: its number is put right
    number = F.regexp_replace("d.fields", r'("_row(?:_\d+)?"):1(?=[,}])', F.concat(F.lit("$1:"), F.col("row").cast("string")))
    return each.select(F.coalesce(sanitize_id(F.col("d.id")), F.concat(_stem(F.col("file")), F.lit("_r"), F.col("row").cast("string"))).alias("id"), F.col("d.content").alias("content"), number.alias("fields"), "row")


def scan_ndjson(spark: SparkSession, path: str, config: FlattenConfig = FlattenConfig()) -> DataFrame:
    """id, title, content, fields of each line's record; ids are the id field's or else `<stem>_<n>`."""
    lines = lines_of(spark, path)
    said = F.trim(F.regexp_replace("line", "\r$", "")) != ""
    numbered = _running(lines.withColumn("_said", said), F.col("_said").cast("int"), "k").where("_said")

    @F.udf(DOCUMENTS, useArrow=True)
    def made(line):
        found = [document(r, "", config) for r in parse(line, config)]
        return [{k: d[k] for k in ("id", "title", "content", "fields")} for d in found]

    each = numbered.select("file", (F.col("k") - 1).alias("n"), F.explode(made("line")).alias("d"))
    return each.select(F.coalesce(F.when(F.col("d.id").isNotNull(), sanitize_id(F.col("d.id"))), F.concat(_stem(F.col("file")), F.lit("_"), F.col("n").cast("string"))).alias("id"), "d.title", "d.content", "d.fields")
