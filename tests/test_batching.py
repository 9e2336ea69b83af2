"""Greedy batches over blocks against the plain loop; histories over ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.operators import batching, control, sink
from sievework.operators.batching import Rule


def greedy(sizes, rule):
    out, batch, items, size = [], 0, 0, rule.base
    for n in sizes:
        if items and (items == rule.max_items or size + n + rule.sep > rule.max_size):
            batch, items, size = batch + 1, 0, rule.base
        size += n + (rule.sep if items else 0)
        items += 1
        out.append(batch)
    return out


@pytest.mark.parametrize("seed", range(60))
def test_blocks_cut_as_the_loop_does(seed):
    rng = random.Random(seed)
    rule = Rule(rng.randint(1, 12), rng.randint(5, 60), rng.choice([0, 2]), rng.choice([0, 1]))
    sizes = [rng.choice([0, 1, 3, rng.randint(0, 40), 70]) for _ in range(rng.randint(0, 120))]
    cuts = sorted(rng.randint(0, len(sizes)) for _ in range(rng.randint(0, 12)))
    blocks = [np.array(sizes[a:b], np.int64) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]
    starts = batching.beginnings(rule, [batching.summary(rule, b) for b in blocks])
    got = [int(x) for b, s in zip(blocks, starts, strict=True) for x in batching.numbers(rule, b, *s)]
    assert got == greedy(sizes, rule)


def test_one_list_over_many_tasks(spark):
    rng = random.Random(3)
    rows = [(part, k, rng.randint(1, 300)) for part in (1, 1, 1, 2, None) for k in [rng.randrange(10**9) for _ in range(4000)]]
    df = spark.createDataFrame(rows, "part int, seq long, size int").repartition(7)
    got = {}
    for r in sink.plan_batches(df, 50, 5000).collect():
        got.setdefault(r["part"], []).append((r["seq"], r["size"], r["batch"]))
    for part in (1, 2, None):
        want = sorted((s, n) for p, s, n in rows if p == part)
        assert [x[2] for x in sorted(got[part])] == greedy([n for _, n in want], Rule(50, 5000, 2, 1))
    with pytest.raises(Exception, match="fits in no batch"):
        sink.plan_batches(df, 50, 200).collect()
    assert sink.plan_batches(df.where("false")).count() == 0


def test_transitions_of_one_long_history(spark):
    rng = random.Random(5)
    runs = [(None if rng.random() < 0.1 else 1 if rng.random() < 0.9 else 2, k, k // 3, rng.choice(["failed", "ok", "skipped"])) for k in range(6000)]
    df = spark.createDataFrame(runs, "source_id int, run_id long, started_at long, outcome string").repartition(5)
    want, last = [], {}
    for source, run, _, outcome in runs:
        failed, before = outcome == "failed", last.get(source, False)
        if failed != before:
            want.append((run, "failing" if failed else "ok"))
        last[source] = failed
    assert sorted((r["run_id"], r["transition"]) for r in control.status_transition(df).collect()) == want
    assert control.status_transition(df.where(F.lit(False))).count() == 0
