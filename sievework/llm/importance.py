"""Target-distribution importance resampling in Spark SQL functions alone.

Texts become hashed n-gram features. Grouped counts of the raw and the target texts give every bucket a gain, the
logarithm of how much likelier the target is to hold it. The gain table (one row a bucket, BUCKETS rows at most, so
its broadcast is bounded by a parameter) joins the exploded features, whose gains are summed by document. Gumbel noise
from a hash of doc_id makes the best scores a draw without replacement. Ranks come from a distributed sort: rows are
dealt by ranges of their order, sorted within partitions, and each partition adds the count of those before it.

Defined results: null and empty texts have no features and weight 0; a null doc_id stands as the empty text in the hash
and comes last among equal scores; rows that share a doc_id are scored and ranked each; equal scores and ids go by
features, then by place in the table; an empty table gives an empty result, an empty target table gives gains from its zero counts;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, settled, stage

# Letters that are lowered, and what stands between words before and after that.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

BUCKETS = 10_000
#: Words in a feature: runs of 1 to this many.
NGRAM = 1
#: Words that a drawn document has at least, and the share of such documents that is drawn, in percent.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024


def _lowered(word: Column) -> Column:
    """A-Z lowered and no other letter; ASCII words take the short way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def features(table: DataFrame, keep: list[str], ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """keep, n_words and `bucket`, one row for each feature; a text without any has one row whose bucket is null."""
    words = table.select(*keep, F.array_remove(F.split(F.coalesce("text", F.lit("")), SEPARATORS), "").alias("ws"))
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("ws") - n + 1), lambda i: F.array_join(F.slice("ws", i, n), " "))
    longer = [F.when(F.size("ws") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in range(2, ngram + 1)]
    each = words.select(*keep, F.size("ws").alias("n_words"), F.explode_outer(F.concat("ws", *longer) if longer else F.col("ws")).alias("w"))
    return each.select(*keep, "n_words", (F.crc32(_lowered(F.col("w"))) % buckets).cast("int").alias("bucket"))


def gains(docs: DataFrame, target: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """bucket and gain (long), `buckets` rows."""
    each = features(docs.select("text", F.lit(False).alias("t")), ["t"], ngram, buckets).unionAll(features(target.select("text", F.lit(True).alias("t")), ["t"], ngram, buckets))
    held = each.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.when(~F.col("t"), 1)).alias("s"), F.count(F.when(F.col("t"), 1)).alias("n"))
    held = stage(held, "gain-counts")
    total = held.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    d = lambda x: (F.coalesce(x, F.lit(0)) + 1).cast("double")
    ratio = d(F.col("n")) * F.lit(float(total["s"] + buckets)) / (d(F.col("s")) * F.lit(float(total["n"] + buckets)))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(held, "bucket", "left").select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, ngram: int = NGRAM, buckets: int = BUCKETS) -> DataFrame:
    """place, doc_id, n_features, weight, n_words: a row for each of docs."""
    placed = docs.select(F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    summed = features(placed, ["place", "doc_id"], ngram, buckets).join(F.broadcast(gain), "bucket", "left")
    sums = [F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")]
    return summed.groupBy("place").agg(*sums)


def _noise(doc_id: Column, seed: int) -> Column:
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `rank` from 1: a range-partitioned sort, whose partitions add the counts of those before them."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    dealt = stage(dealt, "ranked")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.join(F.broadcast(before), "part").withColumn("rank", within + F.col("before")).drop("part", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngram: int = NGRAM, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank: a row for each of docs; documents that are not drawn have a null rank."""
    found = weights(docs, stage(gains(docs, target, ngram, buckets), "gains"), ngram, buckets)
    scored = stage(found.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed)), "scored")
    able = scored.where(F.col("n_words") >= least_words)
    draw = percent * able.count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("place").asc()]
    drawn = ranked(able, order).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op11", lambda: resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


# CRC-32 of a word's UTF-8 bytes, of distinct words alone: the table of its 256 steps comes from the polynomial.
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(hex(encode(w))) // 2), lambda i: ('0x' || substr(hex(encode(w)), 2 * i::INT + 1, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"""
OP11_SQL = rf"""WITH RECURSIVE bits AS (SELECT range AS b, 0 AS k, range::BIGINT AS c FROM range(256) UNION ALL SELECT b, k + 1, {_STEP} FROM bits WHERE k < 8),
 steps AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
 t AS (SELECT doc_id AS id, false AS target, coalesce(text, '') AS text FROM documents UNION ALL SELECT item_id, true, coalesce(text, '') FROM benchmark),
 each AS (SELECT id, target, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM t),
 crc AS (SELECT w, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT w FROM each), steps),
 f AS (SELECT id, target, bucket FROM each JOIN crc USING (w)),
 sums AS (SELECT count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS n FROM f),
 g AS (SELECT bucket, floor(1000 * ln((count(*) FILTER (target) + 1)::DOUBLE * (any_value(sums.s) + 10000)::DOUBLE / ((count(*) FILTER (NOT target) + 1)::DOUBLE * (any_value(sums.n) + 10000)::DOUBLE)))::BIGINT AS gain FROM f, sums GROUP BY bucket),
 d AS (SELECT id, count(*) AS n, sum(gain)::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE NOT target GROUP BY id),
 s AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM documents LEFT JOIN d ON doc_id = id),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS able FROM s)
 SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * able // 100 THEN k END::BIGINT AS rank FROM r"""
