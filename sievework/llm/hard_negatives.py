"""Hard-negative mining over product-quantised vectors with rigorous bounds.

Vectors become integers. Each stretch of WIDTH components has a codebook; a row stores its codes and, for each stretch,
the norm of what the code leaves over. An anchor's lookup tables give every row an approximate score, and by
Cauchy-Schwarz the true score lies within the sum of products of the anchor's and the residuals' norms. Rows whose interval
cannot reach the window, or the best scores found so far, are passed over for certain; the others are scored exactly with
integers. So the result is that of scoring all pairs, at every size.

Anchors and rows are dealt to the cells of a grid of bounded groups of anchors by bounded groups of rows; a cell sends on
the best few rows of each anchor and window. First come the positives (same label, no bound on the score), then the
negatives of each positive's window.

Codebooks are k-means on the SAMPLE rows with the smallest hash (fewer for very long vectors); all rows are coded.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part; components beyond
2**24 in size after scaling count as that (sums stay exact in 64 bits); vectors of different lengths score over the shorter
one; empty vectors score 0; every row counts, so copies of an anchor are other rows and a repeated anchor gives its
rows again; rows with a null vec_id are no anchors and come last among equal scores; equal scores and ids go by
place in the table; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, settled, stage

SCALE = 256
#: Components in a stretch, codes of a stretch, training rows, rounds of k-means.
WIDTH, CODES, SAMPLE, ROUNDS = 2, 256, 4096, 8
#: Numbers that the training sample holds at most.
SAMPLE_NUMBERS = 1 << 22
#: Rows and anchors of a cell at most (about); rows of a cell at least, where there are enough.
CELL_ROWS, CELL_ANCHORS, LEAST_CELL_ROWS = 32768, 4096, 2048
#: Rows scored at once, and bytes of lookup tables at once.
CHUNK, TABLE_BYTES = 4096, 1 << 24
POSITIVES, NEGATIVES = 5, 5
#: Percent of the positive's score that a negative has at least and at most.
LOW, HIGH = 80, 100
LARGEST = 1 << 24
NONE = -(1 << 62)


def usable(vectors: DataFrame) -> DataFrame:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad))


def integers(lists: pa.ListArray, dims: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), a row a list, with zeros behind short ones."""
    out = np.zeros((len(lists), dims), np.int64)
    n = np.diff(lists.offsets.to_numpy())
    flat = np.clip(np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), -LARGEST, LARGEST)
    out[np.repeat(np.arange(len(lists)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def stretches(x: np.ndarray) -> np.ndarray:
    """(rows, stretches, WIDTH), zeros behind."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH))).reshape(len(x), -1, WIDTH)


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book * book).sum(1) - 2 * x @ book.T).argmin(1)


def codebooks(sample: np.ndarray, seed: int = 11) -> np.ndarray:
    """(stretches, CODES, WIDTH); unused codes are zero."""
    x, rng = stretches(sample.astype(np.float64)), np.random.default_rng(seed)
    books = np.zeros((x.shape[1], CODES, WIDTH))
    for book, v in zip(books, x.swapaxes(0, 1), strict=True):
        start = np.unique(v, axis=0)
        k = min(CODES, len(start))
        book[:k] = start[rng.choice(len(start), k, replace=False)]
        for _ in range(ROUNDS if k == CODES else 0):
            own = nearest(v, book)
            n = np.bincount(own, minlength=CODES)
            sums = np.stack([np.bincount(own, v[:, d], CODES) for d in range(WIDTH)], 1)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
    return books


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, stretches) and norms of the residuals, rounded up."""
    parts = stretches(x.astype(np.float64))
    codes = np.stack([nearest(parts[:, m], b) for m, b in enumerate(books)], 1).astype(np.uint8) if len(books) else np.zeros((len(x), 0), np.uint8)
    left = parts - books[np.arange(len(books)), codes]
    return codes, np.nextafter(np.sqrt((left * left).sum(2)).astype(np.float32), np.float32(np.inf))


def prepare(vectors: DataFrame, is_anchor: Column, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Staged rows (place, vec_id, label, anchor, vec, codes, norms; arrays as bytes) and the codebooks."""
    rows = usable(vectors).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding", F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    most = min(SAMPLE, max(CODES, SAMPLE_NUMBERS // max(1, dims)))
    taken = rows.select("embedding", F.xxhash64("embedding", "vec_id").alias("h")).orderBy("h").limit(most).toArrow()
    books = codebooks(integers(taken.column("embedding").combine_chunks(), dims, scale)) if taken.num_rows else np.zeros((0, CODES, WIDTH))

    def code(batches):
        for batch in batches:
            x = integers(batch.column("embedding"), dims, scale)
            codes, norms = encode(x, books)
            packed = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (x.astype(np.int32), codes, norms)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "anchor")), *packed], names=["vec_id", "label", "anchor", "vec", "codes", "norms"])

    coded = rows.mapInArrow(code, "vec_id long, label long, anchor boolean, vec binary, codes binary, norms binary")
    return stage(coded.withColumn("place", F.monotonically_increasing_id()), "coded"), books


def unpack(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    x = column.combine_chunks().to_pylist()
    return np.frombuffer(b"".join(x), kind).reshape(len(x), len(x[0]) // np.dtype(kind).itemsize if x else 0)


class Best:
    """The best rows so far of each (anchor, window): score, then id, then place."""

    def __init__(self, anchors: int, windows: int, most: int):
        self.windows, self.most = windows, most
        self.kept = np.zeros((4, 0), np.int64)  # slot (anchor * windows + window), score, id, place
        self.floor = np.full((anchors, windows), NONE)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        x = np.concatenate([self.kept, np.stack([slot, score, ids, place])], 1)
        x = x[:, np.lexsort((x[3], x[2], -x[1], x[0]))]
        start = np.flatnonzero(np.diff(x[0], prepend=-1))
        rank = np.arange(x.shape[1]) - np.repeat(start, np.diff(start, append=x.shape[1]))
        self.kept = x[:, rank < self.most]
        full = x[:, rank == self.most - 1]
        self.floor.reshape(-1)[full[0]] = full[1]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, NONE where there are fewer columns."""
    if values.shape[1] < k:
        return np.full(len(values), float(NONE))
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def cell(books: np.ndarray, same: bool, most: int) -> Callable:
    """The best rows of a cell for each anchor's windows (low and high, both included), of the anchor's label or of all others."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            get = lambda t, c: t.column(c).combine_chunks().fill_null(1 << 62).to_numpy()
            at = np.argsort(get(anchors, "place"), kind="stable")
            a_vec, a_label, a_place = unpack(anchors.column("vec"), np.int32).astype(np.int64)[at], get(anchors, "label")[at], get(anchors, "place")[at]
            low, high = (np.array(anchors.column(c).to_pylist(), np.int64)[at].reshape(len(at), -1) for c in ("low", "high"))
            vec, codes, norms = (unpack(rows.column(c), k) for c, k in (("vec", np.int32), ("codes", np.uint8), ("norms", np.float32)))
            label, place, ids = get(rows, "label"), get(rows, "place"), get(rows, "vec_id")
            step = max(1, TABLE_BYTES // max(1, books.shape[0] * CODES * 8))
            for i in range(0, len(at), step):
                s = slice(i, i + step)
                parts = stretches(a_vec[s].astype(np.float64))
                table, reach = np.einsum("amw,mkw->mak", parts, books), np.sqrt((parts * parts).sum(2))
                best = Best(len(parts), low.shape[1], most)
                for j in range(0, len(ids), CHUNK):
                    r = slice(j, j + CHUNK)
                    near = np.zeros((len(parts), len(ids[r])))
                    for m in range(len(books)):
                        near += table[m][:, codes[r, m]]
                    bound = reach @ norms[r].astype(np.float64).T
                    bound += 1e-9 * (np.abs(near) + bound) + 1e-6  # rounding of the sums
                    able = (a_label[s, None] == label[None, r]) == same
                    able &= a_place[s, None] != place[None, r]
                    upper, lower = np.where(able, near + bound, NONE), np.where(able, near - bound, NONE)
                    wanted = np.zeros_like(able)
                    for w in range(low.shape[1]):
                        lo, hi = low[s, w, None], high[s, w, None]
                        sure = kth(np.where((lower >= lo) & (upper <= hi), lower, NONE), most)
                        wanted |= (upper >= np.maximum(lo, np.maximum(best.floor[:, w], sure)[:, None])) & (lower <= hi)
                    ai, ri = np.nonzero(wanted & able)
                    for c in range(0, len(ai), 1 << 17):
                        x, y = ai[c : c + (1 << 17)], ri[c : c + (1 << 17)] + j
                        score = np.einsum("nd,nd->n", a_vec[s][x], vec[y].astype(np.int64))
                        hit, w = np.nonzero((score[:, None] >= low[s][x]) & (score[:, None] <= high[s][x]))
                        best.add(x[hit] * low.shape[1] + w, score[hit], ids[y[hit]], place[y[hit]])
                slot, score, who, where = best.kept
                found.append(np.stack([a_place[s][slot // low.shape[1]], slot % low.shape[1], score, who, where]))
        x = np.concatenate(found, 1) if found else np.zeros((5, 0), np.int64)
        who = pa.array(x[3], mask=x[3] == 1 << 62)
        return pa.Table.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2]), who, pa.array(x[4])], names=["anchor", "win", "score", "found", "at"])

    return run


def search(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, books: np.ndarray, same: bool, most: int) -> DataFrame:
    """anchors: place, label, vec, low, high (arrays, an entry a window). Returns anchor, win, rank, score, found (vec_id), at (place)."""
    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    across = -(-max(1, n_rows) // min(CELL_ROWS, max(LEAST_CELL_ROWS, n_rows // tasks)))
    down = -(-max(1, n_anchors) // CELL_ANCHORS)
    own = lambda n: F.pmod(F.xxhash64("place"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.withColumns({"down": own(down), "across": each(across)}).withColumn("cell", F.col("down") * across + F.col("across"))
    right = rows.select("place", "vec_id", "label", "vec", "codes", "norms").withColumns({"across": own(across), "down": each(down)}).withColumn("cell", F.col("down") * across + F.col("across"))
    left, right = left.select("cell", "place", "label", "vec", "low", "high"), right.drop("across", "down")
    got = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(cell(books, same, most), "anchor long, win long, score long, found long, at long")
    order = Window.partitionBy("anchor", "win").orderBy(F.col("score").desc(), F.col("found").asc_nulls_last(), "at")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE) -> DataFrame:
    """vectors: vec_id, label, embedding. Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, and places."""
    rows, books = prepare(vectors, is_anchor, scale)
    counts = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("a")).first()
    anchors = stage(rows.where("anchor").select("place", "vec_id", "label", "vec"), "anchors")
    everything = F.array(F.lit(NONE)), F.array(F.lit(-NONE))
    found = stage(search(anchors.select("place", "label", "vec", everything[0].alias("low"), everything[1].alias("high")), rows, counts["a"], counts["n"], books, True, positives), "positives")
    # at most `positives` rows an anchor
    listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "found", "at"))).alias("p"))
    ends = listed.select(
        F.col("anchor").alias("place"),
        F.concat(F.transform("p", lambda x: _ceil_div(x["score"] * low)), F.array_repeat(F.lit(1).cast("long"), positives - F.size("p"))).alias("low"),
        F.concat(F.transform("p", lambda x: _floor_div(x["score"] * high)), F.array_repeat(F.lit(0).cast("long"), positives - F.size("p"))).alias("high"),
    )
    windows = stage(anchors.join(ends, "place").select("place", "label", "vec", "low", "high"), "windows")
    got = search(windows, rows, counts["a"], counts["n"], books, False, negatives)
    of = found.select(F.col("anchor"), (F.col("rank") - 1).cast("long").alias("win"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    both = got.join(of, ["anchor", "win"]).join(named, "anchor")
    return both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _floor_div(x: Column) -> Column:
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def _ceil_div(x: Column) -> Column:
    return -_floor_div(-x)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return settled(spark, "op13", lambda: mine(table.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0))


OP13_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.vec_id AS a, r.vec_id AS r, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
 p AS (SELECT a, r AS p, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, r) <= 5),
 n AS (SELECT p.a, p, ps, s.r AS n, score AS ns, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, s.r) AS k FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * ps <= 100 * score AND 100 * score <= 100 * ps)
 SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE k <= 5"""
