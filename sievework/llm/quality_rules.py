"""Quality rules with adaptive thresholds.

Every document gets four ratios. A mergeable quantile sketch (log buckets of relative width 2 %,
merged by adding counts) is kept per language and source; the thresholds come from its quartiles
and replace fixed cutoffs; documents are then joined with the thresholds of their group.

Defined results: null text is empty (no words: fails the base rule); null lang or source is a group of
its own; a group with fewer than MIN_DOCS documents uses its language's sketch, and a language with
fewer the whole corpus's; ties and repeated rows are counted and kept row by row; an empty table gives
an empty result; other columns pass through unchanged.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .common import ASCII_SPACE, read_table, settled, stage, temp_name, utf8

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
BASE_TYPE = T.StructType([T.StructField(x, T.LongType()) for x in BASE])

#: Relative width of a sketch bucket.
GAMMA = 1.02
#: Documents that a group needs for thresholds of its own.
MIN_DOCS = 200
#: Fences in quartile ranges beyond the quartiles.
FENCE = 6.0
#: ratio -> (numerator, least quartile range, whether low values fail too).
RATIOS = {
    "word_length": ("word_chars", 0.5, True),
    "symbols": ("n_symbols", 0.02, False),
    "dup_lines": ("n_dup_lines", 0.01, False),
    "repeats": ("n_repeat_words", 0.05, False),
}
#: Threshold rows up to which the join broadcasts them; beyond, Spark shuffles (AQE splits hot groups).
BROADCAST_ROWS = 100_000


def repeat_words(words: list) -> int:
    """Words in 3-word windows that the text holds twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = end = 0
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered += i + 3 - max(end, i)
            end = i + 3
    return covered


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    words, text = raw.split(), raw.decode()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - sum(map(text.count, ASCII_SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


@arrow_udf(BASE_TYPE)
def base_udf(text: pa.Array) -> pa.Array:
    columns = list(zip(*map(base_counts, utf8(text)), strict=True)) or [()] * len(BASE)
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in columns], names=list(BASE))


def _ratio(base: Column, name: str) -> Column:
    return F.try_divide(base[RATIOS[name][0]], base["n_words"])


def base_failed(base: Column) -> Column:
    return (base["n_words"] < 50) | (100 * base["n_repeat_words"] > 50 * base["n_words"])


def _bucket(x: Column) -> Column:
    """Log bucket of a value of 0 or more; -1000000 holds zero."""
    return F.when(x > 0, F.ceil(F.log(x) / F.log(F.lit(GAMMA))).cast("int")).otherwise(F.lit(-1_000_000))


def sketches(features: DataFrame) -> DataFrame:
    """features: lang, source, base. One row per group, ratio and bucket. Sums of `n` merge two sketches."""
    ok = features.where(features["base.n_words"] > 0)
    each = F.array(*(F.struct(F.lit(k).alias("ratio"), _bucket(_ratio(F.col("base"), k)).alias("bucket")) for k in RATIOS))
    return ok.select("lang", "source", F.explode(each).alias("x")).groupBy("lang", "source", "x.ratio", "x.bucket").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "ratio")
    ranked = merged.withColumns({"upto": F.sum("n").over(group.orderBy("bucket")), "total": F.sum("n").over(group)})
    value = F.when(F.col("bucket") == -1_000_000, F.lit(0.0)).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return ranked.groupBy(*keys, "ratio").agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("docs"))


def thresholds(features: DataFrame) -> DataFrame:
    """Per lang and source: a map from ratio to its lower and upper fence, by the finest sketch with MIN_DOCS documents."""
    sketch = stage(sketches(features), "quality-sketch")
    own, by_lang, overall = (_quartiles(sketch, keys) for keys in (["lang", "source"], ["lang"], []))
    rename = lambda df, p: df.select(*[c for c in df.columns if c not in ("q1", "q3", "docs")], *(F.col(c).alias(f"{p}_{c}") for c in ("q1", "q3", "docs")))
    o, g, w = rename(own, "o"), rename(by_lang, "g").withColumnsRenamed({"lang": "g_lang", "ratio": "g_ratio"}), rename(overall, "w").withColumnRenamed("ratio", "w_ratio")
    all_ = o.join(g, o["lang"].eqNullSafe(g["g_lang"]) & (o["ratio"] == g["g_ratio"])).join(w, o["ratio"] == w["w_ratio"])
    pick = lambda c: F.when(F.col("o_docs") >= MIN_DOCS, F.col(f"o_{c}")).when(F.col("g_docs") >= MIN_DOCS, F.col(f"g_{c}")).otherwise(F.col(f"w_{c}"))
    least = F.create_map(*(F.lit(y) for k, (_, x, _) in RATIOS.items() for y in (k, x)))
    low = F.create_map(*(F.lit(y) for k, (_, _, x) in RATIOS.items() for y in (k, x)))
    q = all_.select("lang", "source", "ratio", pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("ratio")])
    fences = q.select("lang", "source", "ratio", F.struct(F.when(low[F.col("ratio")], F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high")).alias("fence"))
    return fences.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("ratio", "fence"))).alias("fences"))


def _join(df: DataFrame, lang: str, source: str, found: DataFrame, fences: str) -> DataFrame:
    found = stage(found, "quality-thresholds")
    right = found.select(F.col("lang").alias(f"{fences}_l"), F.col("source").alias(f"{fences}_s"), F.col("fences").alias(fences))
    if found.count() <= BROADCAST_ROWS:
        right = F.broadcast(right)
    joined = df.join(right, df[lang].eqNullSafe(right[f"{fences}_l"]) & df[source].eqNullSafe(right[f"{fences}_s"]), "left")
    return joined.drop(f"{fences}_l", f"{fences}_s")


def _verdict(base: Column, fences: Column) -> Column:
    ok = ~base_failed(base)
    for name, (_, _, both) in RATIOS.items():
        fence = fences[name]
        ok &= F.coalesce(_ratio(base, name) <= fence["high"], F.lit(True))
        if both:
            ok &= F.coalesce(_ratio(base, name) >= fence["low"], F.lit(True))
    return ok


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, kept: one row for each row of docs."""
    features = stage(docs.select("doc_id", "lang", "source", base_udf("text").alias("base")), "quality-features")
    joined = _join(features, "lang", "source", thresholds(features), "fences")
    return joined.select(
        "doc_id", "lang", "source", *(F.col("base")[x].alias(x) for x in BASE), base_failed(F.col("base")).alias("base_failed"), _verdict(F.col("base"), F.col("fences")).alias("kept")
    )


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass the base rule and their group's thresholds, with all their columns."""
    base, fences = temp_name("base"), temp_name("fences")
    scored = stage(docs.withColumn(base, base_udf("text")), "quality-scored")  # the texts once more, so that they are read through once
    found = thresholds(scored.select("lang", "source", F.col(base).alias("base")))
    judged = _join(scored, "lang", "source", found, fences)
    return judged.where(_verdict(F.col(base), F.col(fences))).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(spark, "op5", lambda: score_quality(read_table(spark, sf_dir, "documents")).drop("lang", "source"))
