"""Importance resampling, the language model and hard negatives against brute force, on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import hard_negatives, importance, language_model

DOCS = "doc_id long, text string, place int, rank string, words int"
ODD = [None, "", " \n\t", "A B c", "É été 日本 x9", "same same same " * 30, "w" * 3000, "long " + "tail word " * 4000, "a1-b2_c3", "x\x00y", "\x1c \x1d"]


def corpus() -> list:
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["The", "été", "x"]
    texts = [" ".join(words[i] for i in np.minimum(rng.zipf(1.4, rng.integers(1, 120)) - 1, len(words) - 1)) for _ in range(70)]
    return ODD + texts + texts[:5]


def table(spark, texts: list, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(k, t, 7, "r", 1) for k, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def lowered(t) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# op11


def drawn(rows: list, target: list, ngram: int, least: int = 20, percent: int = 10) -> list:
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(features(x)[1])
    for x in target:
        t.update(features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000))))
    out = []
    for k, x in rows:
        n, f = features(x)
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


@pytest.mark.parametrize("ngram", [1, 3])
def test_resampling(spark, ngram):
    texts = corpus()
    ids = [None if k % 17 == 3 else k // 2 for k in range(len(texts))]  # null and repeated ids
    target = ["w1 w2 the été", None, "W1 w7"]
    got = importance.resample(table(spark, texts, ids), table(spark, target), ngram=ngram)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(list(zip(ids, texts, strict=True)), target, ngram)


def test_resampling_empty(spark):
    none = table(spark, ["x"]).where("false")
    assert importance.resample(none, table(spark, ["a"])).collect() == []
    texts = corpus()
    assert sorted(map(tuple, importance.resample(table(spark, texts), none).collect()), key=str) == drawn(list(enumerate(texts)), [], 1)


def test_ranks_of_many_ties(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), "id").repartition(9)
    got = {r["id"]: r["rank"] for r in importance.ranked(rows, [F.col("k").desc(), F.col("id").asc()]).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [*range(1, 5000, 2), *range(0, 5000, 2)] and sorted(got.values()) == [*range(1, 5001)]


def test_resampling_plan_has_no_python(spark):
    plan = importance.resample(table(spark, corpus()), table(spark, ["a b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# op12


def tokens(t) -> list:
    return [*lowered(t).encode().split(), b""]


def base(rows: list) -> list:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by the definition."""
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    c = Counter(w for k, t in rows if not out(k) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return [(k, out(k), len(x := tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for k, t in rows]


def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def test_base_scores(spark):
    texts = corpus()
    ids = [None if k % 29 == 3 else k for k in range(len(texts))]
    got = sorted(map(tuple, language_model.score_texts(table(spark, texts, ids), held()).collect()), key=str)
    want = sorted(base(list(zip(ids, texts, strict=True))), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert all(g[6] < 0 for g in got)


def test_model_beats_base_and_is_a_distribution(spark):
    """Held-out texts of a first-order source are likelier by pairs; the probabilities behind one context add up to 1."""
    rng = np.random.default_rng(0)
    step = rng.dirichlet(np.full(30, 0.05), 30)

    def say(n):
        at, out = 0, []
        for _ in range(n):
            at = rng.choice(30, p=step[at])
            out.append(f"v{at}")
        return " ".join(out)

    texts = [say(60) for _ in range(150)]
    got = language_model.score_texts(table(spark, texts), held()).toPandas()
    out = got[got.held_out]
    assert out.score.sum() > 0.7 * out.base_score.sum()  # perplexity well below that of single words
    # probabilities of texts of one and two words give those of every step but for a factor of each word, which leaves eigenvalues as they are
    words = [*sorted({w for t in texts for w in t.split()}), "unknown"]
    probes = ["", *words, *(f"{x} {y}" for x in words for y in words)]
    rows = table(spark, [*texts, *probes], [*range(len(texts)), *range(10_000, 10_000 + len(probes))])
    score = {probes[r["doc_id"] - 10_000]: 10 ** r["score"] for r in language_model.score_texts(rows, F.col("doc_id") >= 10_000).where("held_out").collect()}
    step = np.ones((len(words) + 1, len(words) + 1))
    step[0, 0] = score[""]
    for i, x in enumerate(words, 1):
        step[i, 0] = score[x]
        step[i, 1:] = [score[f"{x} {y}"] / score[y] for y in words]
    assert abs(np.abs(np.linalg.eigvals(step)).max() - 1) < 1e-9


def test_equal_texts_equal_scores_and_reruns(spark):
    texts = corpus()
    one, two = (language_model.score_texts(table(spark, texts), held()).orderBy("doc_id").collect() for _ in range(2))
    assert one == two
    by = defaultdict(set)
    for r in one:
        by[texts[r["doc_id"]] or ""].add(round(r["score"], 9))
    assert all(len(x) == 1 for x in by.values())


def test_nothing_to_learn(spark):
    got = language_model.score_texts(table(spark, ["a b", None]), F.lit(True)).orderBy("n_tokens").collect()
    assert [tuple(r)[1:6] for r in got] == [(True, 1, 0, 0, 0.0), (True, 3, 0, 0, 0.0)]
    assert language_model.score_texts(table(spark, ["x"]).where("false"), held()).collect() == []


def posterior(customers: list, pull: list, discount: float) -> dict:
    """Of each pair alone: the exact chance of its numbers of tables, by generalised Stirling numbers."""
    out = []
    for c, a in zip(customers, pull, strict=True):
        s = {(1, 1): 1.0}
        for n in range(1, c):
            for t in range(1, n + 2):
                s[n + 1, t] = s.get((n, t - 1), 0.0) + (n - t * discount) * s.get((n, t), 0.0)
        weight = np.array([s[c, t] * a**t for t in range(1, c + 1)])
        out.append(weight / weight.sum())
    return out


def test_gibbs_seats_follow_the_posterior():
    customers, pull, discount = [7, 4, 2], [1.3, 0.4, 2.0], 0.6
    copies = 3000
    c, a = np.repeat(customers, copies), np.repeat(pull, copies).astype(float)
    tables, sizes = language_model.first_seats(c, a)
    rng = np.random.default_rng(5)
    for _ in range(6):
        tables, sizes = language_model.reseat(c, a, tables, sizes, discount, rng)
        assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all() and (sizes > 0).all()
    for i, want in enumerate(posterior(customers, pull, discount)):
        found = np.bincount(tables[i * copies : (i + 1) * copies], minlength=customers[i] + 1)[1:] / copies
        assert np.abs(found - want).max() < 0.035


def test_all_customers_are_reseated():
    """Three rounds, as the model does, bring pairs of any number of customers from their first seats to their posterior."""
    copies = 2000
    for customers, pull, discount in ((400, 3.0, 0.6), (400, 60.0, 0.75), (40, 0.7, 0.9), (17, 0.5, 0.6)):
        c, a = np.full(copies, customers), np.full(copies, pull)
        tables, sizes = language_model.first_seats(c, a)
        rng = np.random.default_rng(6)
        for _ in range(3):
            tables, sizes = language_model.reseat(c, a, tables, sizes, discount, rng)
            assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all() and (sizes > 0).all()
        logs = np.full(customers + 1, -np.inf)  # of the generalised Stirling numbers
        logs[1] = 0
        with np.errstate(all="ignore"):
            for n in range(1, customers):
                logs = np.logaddexp(np.concatenate([[-np.inf], logs[:-1]]), logs + np.log(np.maximum(n - discount * np.arange(customers + 1), 0)))
        want = np.exp(logs[1:] + np.arange(1, customers + 1) * np.log(pull) - np.max(logs[1:] + np.arange(1, customers + 1) * np.log(pull)))
        found = np.bincount(tables, minlength=customers + 1)[1:] / copies
        assert np.abs(found - want / want.sum()).max() < 0.04


def test_hot_word_spreads():
    """Pairs behind a hot word go to many parts, others by their word alone."""
    words = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64))
    row = {"sizes": np.array([1], np.int64).tobytes(), "tokens": np.array([0], np.int32).tobytes(), "words": words.tobytes(), "held": [False]}
    x = language_model.Slice(row)
    w, u = np.repeat([3, 4], 500), np.tile(np.arange(500), 2)
    got = x.parts(w, u, 16, words[3:4])
    assert len({p for p, at in got if (w[at] == 3).any()}) == 16 and len({p for p, at in got if (w[at] == 4).any()}) == 1
    assert sorted(np.concatenate([at for _, at in got])) == [*range(1000)]


# op13


def mined(rows: list, anchors, positives: int = 5, negatives: int = 5) -> list:
    kept = []
    for k, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        kept.append((k, [math.floor(256 * float(np.float32(x))) for x in e], label))
    out = []
    order = lambda s, j: (-s, kept[j][0] is None, kept[j][0] or 0)
    for i, (k, v, label) in enumerate(kept):
        if not anchors(k):
            continue
        score = {j: sum(a * b for a, b in zip(v, x[1], strict=False)) for j, x in enumerate(kept)}
        same = sorted((order(s, j), j) for j, s in score.items() if j != i and kept[j][2] == label)[:positives]
        for _, p in same:
            ok = sorted((order(s, j), j) for j, s in score.items() if kept[j][2] != label and 80 * score[p] <= 100 * s <= 100 * score[p])[:negatives]
            out += [(k, kept[p][0], r + 1, kept[j][0], score[p], score[j]) for r, (_, j) in enumerate(ok)]
    return sorted(out, key=str)


VECTORS = "vec_id long, embedding array<float>, label int, place string, cell int"
TENTH = lambda k: k is not None and k % 10 == 0


def vectors(n: int, dims: int = 6, seed: int = 2) -> list:
    rng = np.random.default_rng(seed)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=dims)], int(rng.integers(0, 4))) for k in range(n)]
    rows += [(n + 1, None, 1), (n + 2, [], 2), (n + 3, [1.0, None, 2.0], 1), (n + 4, [float("nan")] * dims, 1), (n + 5, [float("inf")] + [0.0] * (dims - 1), 1), (n + 6, [1.0] * dims, None), (None, [0.5] * dims, 1), (n + 7, [1.0] * 2, 3), (n + 8, [2.0] * (dims + 3), 0)]
    return rows + [(n + 20 + k, rows[0][1], (rows[0][2] + k) % 4) for k in range(40)]  # one vector many times


def mine(spark, rows: list):
    got = hard_negatives.mine(spark.createDataFrame([(*r, "p", 1) for r in rows], VECTORS).repartition(3), F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()), key=str)


def test_hard_negatives(spark):
    rows = vectors(300)
    got = mine(spark, rows)
    assert got == mined(rows, TENTH) and len(got) > 300


def test_hard_negatives_many_cells(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "CHUNK", 16)
    rows = vectors(200, 5, 9)
    assert mine(spark, rows) == mined(rows, TENTH)


def test_repeated_rows_and_few(spark):
    one = [(10, [1.0, 2.0], 1), (10, [1.0, 2.0], 1), (11, [1.0, 1.9], 2), (11, [1.0, 1.9], 2), (12, [0.0, 0.0], 2)]
    assert mine(spark, one) == mined(one, TENTH)
    assert mine(spark, one[:1]) == [] and mine(spark, []) == []
    assert mine(spark, [(10, [], 1), (11, [], 1), (12, [], 2)]) == [(10, 11, 1, 12, 0, 0)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(3000, 16)) / 4).astype(np.int64)
    books = hard_negatives.codebooks(x)
    codes, norms = hard_negatives.encode(x, books)
    near = np.zeros((5, len(x)))
    parts = hard_negatives.stretches(x[:5].astype(float))
    for m in range(len(books)):
        near += (parts[:, m] @ books[m].T)[:, codes[:, m]]
    bound = np.sqrt((parts**2).sum(2)) @ norms.T
    exact = x[:5] @ x.T
    assert (np.abs(exact - near) <= bound + 1e-6).all()
    assert np.median(bound) < 0.25 * np.abs(exact).max()


def test_large_components(spark):
    rows = [(10, [1e30, 1.0], 1), (11, [1e5, -1e30], 1), (12, [3e4, 1.0], 2)]
    assert isinstance(mine(spark, rows), list)


@pytest.mark.parametrize(("name", "module"), [("OP11_SQL", importance), ("OP13_SQL", hard_negatives)])
def test_sql_parses(name, module):
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR); CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INT)")
    assert c.sql(getattr(module, name)).fetchall() == []
