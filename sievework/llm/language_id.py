"""Language ID: nearest centroid over normalised TF-IDF n-gram vectors.

Texts become counts of byte n-grams (1 to 3 bytes, A-Z lowered) hashed to DIMS buckets; TF is logarithmic, IDF
comes from the training rows, vectors have length 1. Each language has CENTROIDS centroids from spherical
k-means; a text gets the language of the centroid with the largest cosine. A text whose cosine is below what
all but REJECTED of its centroid's training rows reach is flagged as rejected.

Training rows: labelled rows whose crc32 of the doc_id as text is not 2 modulo 4, at most PER_LANGUAGE a
language (those with the smallest hash of the text: the documented bound of the sample). Whole texts are used.

Defined results: null text, empty text and text without a letter are `und` with score 0; so is everything when
no row is labelled; rows with a null label are never learned from; rows with a null doc_id are not held out; repeated rows get equal predictions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from .common import read_table, slices, utf8

DIMS = 4096
CENTROIDS = 3
PER_LANGUAGE = 400
ROUNDS = 12
REJECTED = 0.01
SEED = 7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def counts(raw: bytes) -> np.ndarray:
    """n-gram counts in DIMS buckets."""
    b = _LOWER[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    two = b[:-1] | b[1:] << np.uint32(8)
    grams = np.concatenate([b, two | np.uint32(1 << 24), (two[:-1] | b[2:] << np.uint32(16)) | np.uint32(2 << 24)])
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMS)


def vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, x in enumerate(texts):
        if x:
            out[i] = np.log1p(counts(x))
    return unit(out * idf)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(raw: bytes) -> bool:
    return any(map(str.isalpha, raw.decode()))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """Counts of the training rows: lang, bucket indexes and counts."""
    fit = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # copies count once, so that a text with many of them takes one place
    hashed = fit.select("lang", F.xxhash64("text").alias("h")).distinct().withColumn("size", F.length(F.bin("h")))
    # hashes by their number of binary digits: the shortest that together hold enough are few rows, whatever the language's size
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    enough = hashed.groupBy("lang", "size").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(upto, F.lit(0)))
    near = hashed.join(F.broadcast(enough.where(F.col("before") < per_language).select("lang", "size")), ["lang", "size"])  # 64 rows a language at most
    order = Window.partitionBy("lang").orderBy("size", "h")
    last = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language).groupBy("lang").agg(F.max(F.struct("size", "h")).alias("last"))
    size = F.length(F.bin(F.xxhash64("text")))
    chosen = fit.join(F.broadcast(last), "lang").where(F.struct(size.alias("size"), F.xxhash64("text").alias("h")) <= F.col("last"))
    chosen = chosen.dropDuplicates(["lang", "text"]).select("lang", "text")

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [(lang, np.flatnonzero(c := counts(x)), c) for lang, x in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True) if x and has_letter(x)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2][r[1]] for r in rows], pa.list_(pa.int32()))], names=["lang", "at", "n"]
                )

    return chosen.mapInArrow(count, "lang string, at array<int>, n array<int>")


def clusters(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (centroids, each row's)."""
    centroids = [x[rng.integers(len(x))]]
    while len(centroids) < min(k, len(x)):
        centroids.append(x[np.argmin(np.max(x @ np.array(centroids).T, axis=1))])  # the row farthest from all
    c = np.array(centroids)
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        c = unit(np.array([x[own == i].sum(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c, np.argmax(x @ c.T, axis=1)


class Model:
    """idf; one row a centroid: its vector, language and least cosine."""

    def __init__(self, rows: list, k: int = CENTROIDS, seed: int = SEED):
        rows = sorted(rows, key=lambda r: (r["lang"], list(r["at"]), list(r["n"])))
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, r in enumerate(rows):
            x[i, list(r["at"])] = np.log1p(np.asarray(list(r["n"]), np.float32))
        self.idf = (np.log((1 + len(rows)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
        x, langs = unit(x * self.idf), np.array([r["lang"] for r in rows], object)
        rng, found = np.random.default_rng(seed), []
        for lang in sorted(set(langs)):
            own = x[langs == lang]
            c, at = clusters(own, k, rng)
            found += [(c[i], lang, float(np.quantile(own[at == i] @ c[i], REJECTED)) if (at == i).any() else 1.0) for i in range(len(c))]
        self.centroids = np.array([f[0] for f in found], np.float32).reshape(-1, DIMS)
        self.langs = [f[1] for f in found]
        self.least = np.array([f[2] for f in found], np.float32)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        known = [bool(self.langs) and has_letter(x) for x in texts]
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        return [(self.langs[b], float(s), bool(s < self.least[b])) if ok else ("und", 0.0, True) for ok, b, s in zip(known, best, score, strict=True)]


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Gathers at most per_language rows of at most DIMS counts for each language on the driver."""
    return Model(sample(docs, per_language).collect())


PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def predictor(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @arrow_udf(PREDICTION)
    def predict(text: pa.Array) -> pa.Array:
        texts, found, at = utf8(text), [], 0
        while at < len(texts):
            found += shared.value.predict(texts[at : at + 256])
            at += 256
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)], names=PREDICTION.names)

    return predict


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected: one row for each row of docs."""
    predict = predictor(docs.sparkSession, model or train(docs))
    found = docs.select("doc_id", held_out().alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
