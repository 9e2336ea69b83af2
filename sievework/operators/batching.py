"""Greedy batches of an ordered list, cut at a number and a size, over lists of any length.

A list is dealt to blocks by ranges of its order. A block does not know how full the batch is that is open where it begins, but
its first cut lies within its first max_items rows, so it tells for each of these what would come of a cut there: how
full its last batch is left, and how many it cuts. These summaries, in order, give every block its true beginning; then
all blocks cut at once. No task holds a whole list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import dealt


class Rule:
    """A batch has max_items rows and max_size in size at most: base, the rows' sizes, and sep between any two. A row alone may be larger."""

    def __init__(self, max_items: int, max_size: int, base: int = 0, sep: int = 0):
        self.max_items, self.max_size, self.base, self.sep = max_items, max_size, base, sep

    def sums(self, sizes: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(sizes + self.sep)])

    def next_cuts(self, sums: np.ndarray) -> np.ndarray:
        """For a batch that begins at each row, where the next one begins (or the end)."""
        n, at = len(sums) - 1, np.arange(len(sums) - 1)
        full = np.searchsorted(sums, self.max_size - self.base + self.sep + sums[:-1], "right") - 1
        return np.minimum(np.maximum(at + 1, np.minimum(at + self.max_items, full)), n)

    def fits(self, sums: np.ndarray, items: int, size: int) -> int:
        """Rows from the first that an open batch of so many items and such a size still takes."""
        return max(0, min(self.max_items - items, int(np.searchsorted(sums, self.max_size - size, "right")) - 1)) if items else 0

    def left_open(self, sums: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and size of a batch from `start` to the end."""
        return len(sums) - 1 - start, self.base - self.sep + sums[-1] - sums[start]


def summary(rule: Rule, sizes: np.ndarray) -> dict:
    sums = rule.sums(sizes)
    head = min(len(sizes), rule.max_items)
    cuts = rule.next_cuts(sums)
    at = last = np.arange(head)
    count = np.ones(head, np.int64)
    while (at := np.append(cuts, len(sizes))[last]).min(initial=len(sizes)) < len(sizes):
        more = at < len(sizes)
        last, count = np.where(more, at, last), count + more
    items, size = rule.left_open(sums, last)
    return {"n": len(sizes), "total": int(sums[-1]), "head": sums[: head + 1], "items": items, "size": size, "cuts": count}


def beginnings(rule: Rule, blocks: list[dict]) -> list[tuple[int, int, int]]:
    """Of blocks in order: items and size of the batch open where each begins, and the batches begun before."""
    items, size, begun, out = 0, rule.base, 0, []
    for b in blocks:
        out.append((items, size, begun))
        e = rule.fits(b["head"], items, size)
        if b["n"] == 0:
            continue
        if items and e >= b["n"]:
            items, size = items + b["n"], size + b["total"]
        else:
            items, size, begun = int(b["items"][e]), int(b["size"][e]), begun + int(b["cuts"][e])
    return out


def numbers(rule: Rule, sizes: np.ndarray, items: int, size: int, begun: int) -> np.ndarray:
    """The batch of each row of a block."""
    sums, out = rule.sums(sizes), np.full(len(sizes), begun - 1, np.int64)
    cuts, at = rule.next_cuts(sums), rule.fits(sums, items, size)
    starts = []
    while at < len(sizes):
        starts.append(at)
        at = int(cuts[at])
    out[starts] = 1
    keep = starts[0] if starts else len(sizes)
    out[keep:] = begun - 1 + np.cumsum(np.isin(np.arange(keep, len(sizes)), starts))
    return out


def batched(rows: DataFrame, rule: Rule, group: str, order: str, size: str, name: str = "batch") -> DataFrame:
    """rows with their batch (from 0) in the list of their group, in order."""
    blocks = dealt(rows, [group, order])

    def sizes_of(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
        by = table.column(order).combine_chunks()
        at = pa.compute.sort_indices(by)
        return table.column(size).combine_chunks().take(at).to_numpy(zero_copy_only=False).astype(np.int64), at

    def summed(table: pa.Table) -> pa.Table:
        found = summary(rule, sizes_of(table)[0])
        packed = {k: [v.astype(np.int64).tobytes()] if isinstance(v, np.ndarray) else [v] for k, v in found.items()}
        return pa.table({"__g": table.column(group).slice(0, 1), "__p": table.column("__part").slice(0, 1), **{k: pa.array(v, pa.binary() if isinstance(v[0], bytes) else pa.int64()) for k, v in packed.items()}})

    kind = T.StructType([T.StructField("__g", rows.schema[group].dataType), T.StructField("__p", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "total")), *(T.StructField(c, T.BinaryType()) for c in ("head", "items", "size", "cuts"))])
    summaries = blocks.select(group, order, size, "__part").groupBy(group, "__part").applyInArrow(summed, kind)

    def begin(table: pa.Table) -> pa.Table:
        table = table.sort_by("__p")
        found = [{k: np.frombuffer(v, np.int64) if isinstance(v, bytes) else v for k, v in r.items() if k != "__g"} for r in table.to_pylist()]
        states = np.array(beginnings(rule, found), np.int64).reshape(-1, 3)
        return pa.table({"__g": table.column("__g"), "__p": table.column("__p"), **{c: pa.array(states[:, k]) for k, c in enumerate(("items", "size", "begun"))}})

    state = T.StructType([*kind.fields[:2], *(T.StructField(c, T.LongType()) for c in ("items", "size", "begun"))])
    starts = summaries.groupBy("__g").applyInArrow(begin, state)  # a row of at most max_items entries for each block of a list
    told = blocks.join(starts.select("__g", "__p", F.struct("items", "size", "begun").alias("__start")), blocks[group].eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))).drop("__g", "__p")

    def cut(table: pa.Table) -> pa.Table:
        sizes, at = sizes_of(table)
        start = table.column("__start")[0].as_py()
        out = table.take(at).drop_columns(["__part", "__start"])
        return out.append_column(name, pa.array(numbers(rule, sizes, start["items"], start["size"], start["begun"])))

    return told.groupBy(group, "__part").applyInArrow(cut, T.StructType([*rows.schema.fields, T.StructField(name, T.LongType())]))
