"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

Every preceding word has a restaurant whose customers are the words that follow it; all these restaurants share one parent,
that of single words, whose parent is the uniform choice among known words and one unknown. A restaurant's table sends one
customer to the parent. Seatings are sampled by Gibbs: a customer leaves their table and takes an old one by its size
less the discount, or a new one by the restaurant's strength and the parent's probability of the word. Predictive
probabilities are averaged over the samples and give each text's log10 probability, and so its perplexity.

Spark rounds, none of which holds a whole table in one place:
1. Batches of texts (about 8 MB each) become word numbers, once. Training words are counted by their 64-bit hash.
2. Each batch sends its distinct pairs, packed, to parts dealt by the hash of the second word (of both words, if the second
   is one of the at most HOT words that hold a share of 1/HOT of all, so that no key holds a part). Parts add counts up.
3. In each of SAMPLES rounds the parts ask for the parent's probability and the tables of each context that they need,
   reseat customers, and their new tables are added up by word. Parts work at once: within a round a part sees the others' seats
   of the round before, the usual parallel form of the sampler. A round reseats as many random customers of a pair as it has,
   up to SCAN, one after another; all customers of a pair with more are reseated together, TRIES times (reseat_all()).
   Both leave the posterior as it is. Pairs seen once have one table for certain.
4. Parts answer batches, words answer batches, and batches add up their documents.

A document begins and ends with one boundary symbol, which is a context at the start and a token at the end. The discounts are
n1 / (n1 + 2 n2) from the counts of pairs (words) with one and two customers; STRENGTH is fixed.

Defined results: null text is empty and has the end alone; held_out is null-safe (null: not held out); repeated rows count each
time and get equal scores; an empty table gives an empty result; with nothing to learn from, all tokens are unknown; other
columns are not read. Reruns draw the same seats.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, mix64, read_table, settled, slices, stage

SAMPLES, SCAN, TRIES, STRENGTH = 3, 16, 6, 1.0
#: Tokens that a part gets (about).
PART_TOKENS = 1 << 21
HOT = 256
#: Pairs reseated at once.
CHUNK = 1 << 16
SEED = 12
BOUNDARY = np.uint64(xxhash.xxh64_intdigest(b""))


def pack(x: np.ndarray) -> bytes:
    """Numbers, the like bytes of all together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def packed(raw: bytes) -> bool:
    """Whether pack() made it (by the mark that begins its frames); else it is the numbers as they are."""
    return raw[:4] == b"\x28\xb5\x2f\xfd"


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    if not packed(raw):
        return np.frombuffer(raw, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def rising(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0).astype(np.int64))


def unrising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw)) if packed(raw) else unpack(raw)


BATCH = "batch long, n_tokens long, doc_id array<long>, held array<boolean>, sizes binary, tokens binary, words binary"


def numbered(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list]:
    """Tokens of each text, all tokens as numbers of words, the words; the empty word is the boundary that ends each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, "")))
    found = lists.flatten().dictionary_encode()
    words, at = found.dictionary.to_pylist(), found.indices.to_numpy()
    blank = words.index("") if "" in words else len(words)
    if blank == len(words):
        words.append("")
    full = at != blank
    sizes = 1 + np.bincount(np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[full], minlength=len(lists))
    tokens = np.full(sizes.sum(), blank, np.int32)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(sizes) - 1] = False
    tokens[inner] = at[full]
    return sizes, tokens, words


def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a slice of documents: tokens as numbers of the slice's words, which go by their hash; each document ends with the boundary."""
    at = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in slices(whole, "text"):
            sizes, tokens, found = numbered(batch.column("text"))
            words = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
            order = np.argsort(words)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            row = {"batch": [at], "doc_id": [batch.column("doc_id").to_pylist()], "held": [batch.column("held").to_pylist()]}
            row |= {"sizes": [pack(sizes)], "n_tokens": [len(tokens)], "tokens": [pack(rank[tokens])], "words": [rising(signed(words[order]))]}
            at += 1
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("batch", pa.int64()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), *((c, pa.binary()) for c in ("sizes", "tokens", "words"))]))


class Slice:
    """A row of tokenise(), read back. pairs are word * words + context, in rising order; `of` is each token's pair."""

    def __init__(self, row: dict):
        self.sizes, self.tokens, self.words = unpack(row["sizes"]), unpack(row["tokens"], np.int32), unrising(row["words"]).view(np.uint64)
        self.held = np.array(row["held"], bool)
        self.trained = np.repeat(~self.held, self.sizes)

    def pair(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        end = np.searchsorted(self.words, BOUNDARY)
        before = np.concatenate([[end], self.tokens[:-1]])
        pairs, of = np.unique(self.tokens * np.int64(len(self.words)) + before, return_inverse=True)
        return pairs // len(self.words), pairs % len(self.words), of

    def parts(self, w: np.ndarray, u: np.ndarray, parts: int, hot: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(part, its pairs in rising order) of every part that gets any."""
        by = self.words[w]
        spread = np.isin(self.words, hot)[w]
        by[spread] ^= mix64(self.words[u[spread]])
        part = (mix64(by) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.flatnonzero(np.diff(part[order])) + 1
        return [(int(part[x[0]]), x) for x in np.split(order, cut) if len(x)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def record(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in fields], names=[n for n, _ in fields])


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def shares(h: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, its words' places) of words by hash."""
    part = (mix64(h ^ BOUNDARY) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return [(int(part[x[0]]), x) for x in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(x)]


# Seats


def pick(weight: np.ndarray, start: np.ndarray, end: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A slot of each stretch, by weight."""
    upto = np.cumsum(weight)
    low, high = upto[start] - weight[start], upto[end - 1]
    at = np.searchsorted(upto, np.minimum(low + rng.random(len(start)) * (high - low), np.nextafter(high, -np.inf)), "right")
    return np.clip(at, start, end - 1)


def first_seats(customers: np.ndarray, pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each pair (about as many as are expected without a discount) and the sizes of all: one large, the others of one."""
    tables = np.clip(1 + np.floor(pull * np.log((pull + customers) / (pull + 1))), 1, customers).astype(np.int64)
    sizes = np.ones(tables.sum(), np.int64)
    sizes[np.cumsum(tables) - tables] = customers - tables + 1
    return tables, sizes


def reseat(customers: np.ndarray, pull: np.ndarray, tables: np.ndarray, sizes: np.ndarray, discount: float, rng: np.random.Generator, scan: int = SCAN) -> tuple[np.ndarray, np.ndarray]:
    """All pairs, by falling customers (two at least), once: reseat_all() of those with over `scan` customers, then a Gibbs scan of the others.

    pull: strength of the restaurant times the parent's probability of the word.
    """
    many = int(np.searchsorted(-customers, -scan, "left"))
    cut, out, done = int(tables[:many].sum()), [], 0
    for i in range(0, many, CHUNK):
        at = slice(i, min(many, i + CHUNK))
        end = done + int(tables[at].sum())
        out.append(reseat_all(customers[at], pull[at], tables[at], sizes[done:end], discount, rng))
        done = end
    out.append(reseat_each(customers[many:], pull[many:], tables[many:], sizes[cut:], discount, rng))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def reseat_each(customers: np.ndarray, pull: np.ndarray, tables: np.ndarray, sizes: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A Gibbs scan over pairs by falling customers: each gives up as many random customers as it has, one after another, who sit down again."""
    if len(customers) == 0:
        return tables, sizes
    out, done = [], 0
    for i in range(0, len(customers), CHUNK):
        c, a, t = (x[i : i + CHUNK] for x in (customers, pull, tables))
        end = np.cumsum(c)
        start = end - c
        slots = np.zeros(end[-1], np.int64)
        slots[np.repeat(start - (np.cumsum(t) - t), t) + np.arange(t.sum())] = sizes[done : done + t.sum()]
        done += t.sum()
        for k in range(int(c[0])):
            m = int(np.searchsorted(-c, -k, "left"))  # pairs with over k customers
            s, b, e = slots[: end[m - 1]], start[:m], end[:m]
            s[pick(s.astype(np.float64), b, e, rng)] -= 1
            weight = np.where(s > 0, s - discount, 0.0)
            total = np.add.reduceat(weight, b)
            new = rng.random(m) * (total + a[:m]) >= total
            free = np.minimum.reduceat(np.where(s == 0, np.arange(len(s)), len(s)), b)
            s[np.where(new, free, pick(weight, b, e, rng))] += 1
        out.append((np.add.reduceat((slots > 0).astype(np.int64), start), slots[slots > 0]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def log_gamma(z: np.ndarray) -> np.ndarray:
    """Of positive numbers; small ones are first raised by eight."""
    z, shift = np.asarray(z, np.float64), np.zeros(np.shape(z))
    small = z < 8
    if small.any():
        x = z[small]
        shift[small] = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
        z = np.where(small, z + 8, z)
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z - shift


def tilt(customers: np.ndarray, pull: np.ndarray, discount: float) -> np.ndarray:
    """log(1 - x) for the x at which tables of reseat_all() hold as many customers as there are, on average."""
    low, high = np.full(len(customers), -80.0), np.zeros(len(customers))
    for _ in range(50):
        mid = (low + high) / 2
        x = -np.expm1(mid)
        over = pull * x * np.exp((discount - 1) * mid) + 1 + (1 - discount) * x * np.exp(-mid) > customers
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    return high


def drawn_sizes(keep: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """For each log x in `keep` a size s with chance in proportion to x**s d (1-d)(2-d)...(s-1-d) / s!: geometric with a beta chance, thinned."""
    out, left = np.zeros(len(keep), np.int64), np.arange(len(keep))
    while len(left):
        p = rng.beta(discount, 1 - discount, len(left))
        with np.errstate(divide="ignore"):
            more = np.floor(np.log1p(-rng.random(len(left))) / np.log1p(-np.minimum(np.maximum(p, 1e-300), 1 - 1e-16)))
        ok = np.log1p(-rng.random(len(left))) <= more * keep[left]
        ok &= more < 1 << 62
        out[left[ok]] = 1 + more[ok].astype(np.int64)
        left = left[~ok]
    return out


def reseat_all(customers: np.ndarray, pull: np.ndarray, tables: np.ndarray, sizes: np.ndarray, discount: float, rng: np.random.Generator, tries: int = TRIES) -> tuple[np.ndarray, np.ndarray]:
    """All customers of each pair leave and sit down anew together, `tries` times, at a cost that goes by tables and not by customers.

    The posterior of the sizes (c customers in all) is that of a Poisson number of tables, of mean pull / d, with independent sizes s of chance
    p(s) = d (1-d)(2-d)...(s-1-d) / s!, given that they add up to c. One customer's table is set apart, so its size has the weight s p(s) and
    follows from the others', which are drawn outright (all with a factor x**s, which the sum c makes no difference to). New
    seats are taken with the chance min(1, new weight / old weight) of Metropolis, none if the others hold c or more.
    """
    n = len(customers)
    log_u = tilt(customers, pull, discount)
    log_x = np.log(-np.expm1(log_u))
    mean = pull / discount * -np.expm1(discount * log_u)
    weight = lambda s: log_gamma(s - discount) - log_gamma(s) + s * log_x
    of = np.repeat(np.arange(n), tables)
    for _ in range(tries):
        # the table of a random customer
        end = np.cumsum(sizes)
        first = end[np.cumsum(tables) - 1] - customers
        apart = sizes[np.searchsorted(end, first + rng.integers(0, customers), "right")]
        others = rng.poisson(mean)
        some = np.repeat(np.arange(n), others)
        fresh = drawn_sizes(log_x[some], discount, rng)
        rest = customers - np.bincount(some, fresh, n).astype(np.int64)
        fits = rest > 0
        take = fits & (np.log1p(-rng.random(n)) <= weight(np.maximum(rest, 1)) - weight(apart))
        own = np.flatnonzero(take)
        kept, came = ~take[of], take[some]
        of, sizes = np.concatenate([of[kept], own, some[came]]), np.concatenate([sizes[kept], rest[own], fresh[came]])
        order = np.argsort(of, kind="stable")
        of, sizes = of[order], sizes[order]
        tables = np.where(take, others + 1, tables)
    return tables, sizes


# Parts

STATE = "kind string, part long, batch long, words binary, contexts binary, w binary, u binary, n binary, once long, twice long"


def sent_pairs(parts: int, hot: np.ndarray):
    schema = "part long, batch long, words binary, contexts binary, pairs binary, n binary"

    def send(batches):
        for row in rows_of(batches):
            x = Slice(row)
            w, u, of = x.pair()
            n = np.bincount(of, x.trained, len(w)).astype(np.int64)
            for part, at in x.parts(w, u, parts, hot):
                ws, wi = np.unique(w[at], return_inverse=True)
                us, ui = np.unique(u[at], return_inverse=True)
                yield record(schema, part=[part], batch=[row["batch"]], words=[rising(signed(x.words[ws]))], contexts=[rising(signed(x.words[us]))], pairs=[rising(wi * len(us) + ui)], n=[pack(n[at])])

    return send, schema


def counted(table: pa.Table) -> pa.Table:
    """A part's pairs with their counts in training, in a row without batch; and of each batch which of them it asked for."""
    rows = sorted(table.to_pylist(), key=lambda r: r["batch"])
    ws, us = ([unrising(r[c]).view(np.uint64) for r in rows] for c in ("words", "contexts"))
    words, contexts = np.unique(np.concatenate(ws)), np.unique(np.concatenate(us))
    keys = []
    for r, a, b in zip(rows, ws, us, strict=True):
        pairs = unrising(r["pairs"])
        keys.append(np.searchsorted(words, a)[pairs // len(b)] * np.int64(len(contexts)) + np.searchsorted(contexts, b)[pairs % len(b)])
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(of, np.concatenate([unpack(r["n"]) for r in rows])).astype(np.int64)
    part, out = rows[0]["part"], []
    none = {"words": [None], "contexts": [None], "w": [None], "u": [None], "n": [None], "once": [None], "twice": [None]}
    out.append(record(STATE, kind=["state"], part=[part], batch=[None], words=[pack(words)], contexts=[pack(contexts)], w=[rising(key // len(contexts))], u=[pack(key % len(contexts))], n=[pack(n)], once=[int((n == 1).sum())], twice=[int((n == 2).sum())]))
    at = 0
    for r, k in zip(rows, keys, strict=True):
        out.append(record(STATE, **none | {"kind": ["place"], "part": [part], "batch": [r["batch"]], "n": [rising(of[at : at + len(k)])]}))
        at += len(k)
    return pa.Table.from_batches(out)


class Part:
    """A part's pairs; `many` are those of two customers and more, by falling count."""

    def __init__(self, row: dict):
        self.words, self.contexts = unpack(row["words"], np.uint64), unpack(row["contexts"], np.uint64)
        self.w, self.u, self.n = unrising(row["w"]), unpack(row["u"]), unpack(row["n"])
        at = np.flatnonzero(self.n > 1)
        self.many = at[np.argsort(-self.n[at], kind="stable")]

    def asks(self) -> np.ndarray:
        return np.unique(np.concatenate([self.words[np.unique(self.w[self.many])], self.contexts[np.unique(self.u[self.many])]]))


SEATS = "kind string, part long, tables binary, sizes binary, total binary, h binary, served binary, opened binary"


def by_kind(table: pa.Table) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for row in table.to_pylist():
        out.setdefault(row["kind"], []).append(row)
    return out


def none_of(schema: str) -> pa.RecordBatch:
    return record(schema, **{c.split()[0]: [] for c in schema.split(", ")})


def sampled(parts: int, discount: float, strength: float, turn: int, base: float, sent: float, root_discount: float):
    """One round of a part: its state, its seats so far, and what the parent restaurant says, by share of words."""

    def run(table: pa.Table) -> pa.Table:
        rows = by_kind(table)
        (state,), before = rows["state"], rows.get("seats", [None])[0]
        p = Part(state)
        h, at = p.asks(), p.many
        prob, tables_of = np.zeros(len(h)), np.zeros(len(h))
        by_share = {r["share"]: r for r in rows.get("told", [])}
        for share, where in shares(h, parts):
            served, tables_of[where], root = (unpack(by_share[share][c]) for c in ("served", "tables", "root"))
            prob[where] = (served - root_discount * root + base) / sent
        w, u = np.searchsorted(h, p.words)[p.w[at]], np.searchsorted(h, p.contexts)[p.u[at]]
        pull = (strength + discount * tables_of[u]) * prob[w]
        tables, sizes = (unpack(before["tables"]), unpack(before["sizes"])) if before else first_seats(p.n[at], pull)
        tables, sizes = reseat(p.n[at], pull, tables, sizes, discount, np.random.default_rng([SEED, turn, state["part"]]))
        total = tables + (unpack(before["total"]) if before else 0)
        more = [np.bincount(x, tables - 1, len(h)).astype(np.int64) for x in (w, u)]
        return pa.Table.from_batches([record(SEATS, kind=["seats"], part=[state["part"]], tables=[pack(tables)], sizes=[pack(sizes)], total=[pack(total)], h=[pack(h)], served=[pack(more[0])], opened=[pack(more[1])])])

    return run


# Words: shares of them by hash, a row each


ASK = "kind string, share long, asker long, h binary"
SUMS = "kind string, share long, h binary, served binary, tables binary"
WORDS = "kind string, share long, h binary, c binary, total long, number long"
ROUND = "kind string, share long, turn long, served binary, tables binary, root binary, once long, twice long, sent long, opened long"


def words_of(parts: int):
    def send(batches):
        for row in rows_of(batches):
            x = Slice(row)
            n = np.bincount(x.tokens[x.trained], minlength=len(x.words)).astype(np.int64)
            h, n = x.words[n > 0], n[n > 0]
            for share, at in shares(h, parts):
                yield record("share long, h binary, n binary", share=[share], h=[rising(signed(h[at]))], n=[pack(n[at])])

    return send


def merged(tables: list[dict], columns: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of several rows, each once, and the sums of their columns."""
    h, of = np.unique(np.concatenate([unrising(r["h"]).view(np.uint64) for r in tables]), return_inverse=True)
    return h, [np.bincount(of, np.concatenate([unpack(r[c]) for r in tables])).astype(np.int64) for c in columns]


def counted_words(table: pa.Table) -> pa.Table:
    h, (n,) = merged(table.to_pylist(), ["n"])
    return pa.Table.from_batches([record(WORDS, kind=["words"], share=table.column("share").to_pylist()[:1], h=[rising(signed(h))], c=[pack(n)], total=[int(n.sum())], number=[len(n)])])


def hot_words(n_tokens: int):
    def run(batches):
        for row in rows_of(batches):
            yield record("h long", h=unrising(row["h"])[unpack(row["c"]) * HOT > n_tokens])

    return run


def types_of(parts: int):
    """For each word of a part: the restaurants that serve it, and the words that its own restaurant serves."""

    def send(batches):
        for row in rows_of(batches):
            p = Part(row)
            seen = p.n > 0
            h = np.unique(np.concatenate([p.words, p.contexts]))
            served, tables = (np.bincount(np.searchsorted(h, own)[at[seen]], minlength=len(h)) for own, at in ((p.words, p.w), (p.contexts, p.u)))
            yield from sums(h, served, tables, parts)

    return send


def sums(h: np.ndarray, served: np.ndarray, tables: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    some = (served > 0) | (tables > 0)
    h, served, tables = h[some], served[some], tables[some]
    for share, at in shares(h, parts):
        yield record(SUMS, kind=["sums"], share=[share], h=[rising(signed(h[at]))], served=[pack(served[at])], tables=[pack(tables[at])])


def extra_tables(parts: int):
    def send(batches):
        for row in rows_of(batches):
            yield from sums(unpack(row["h"], np.uint64), unpack(row["served"]), unpack(row["opened"]), parts)

    return send


def asked(parts: int, of_part: bool):
    """Which words a part (its pairs of two customers and more) or a batch (all) needs to know about."""

    def send(batches):
        for row in rows_of(batches):
            h = Part(row).asks() if of_part else unrising(row["words"]).view(np.uint64)
            for share, at in shares(h, parts):
                yield record(ASK, kind=["ask"], share=[share], asker=[row["part" if of_part else "batch"]], h=[rising(signed(h[at]))])

    return send


def parent_round(n_words: int, discount: float, strength: float, turn: int):
    """A share of the parent restaurant: customers by word (one a table below) and tables, sampled but in round 0, where each word has one."""

    def run(table: pa.Table) -> pa.Table:
        rows = by_kind(table)
        if "words" not in rows:
            return pa.Table.from_batches([none_of(ROUND)])
        (row,), first, more = rows["words"], rows.get("round", [None])[0], rows.get("sums", [])
        h = unrising(row["h"]).view(np.uint64)
        served, tables = (unpack(first[c]).copy() if first else np.zeros(len(h), np.int64) for c in ("served", "tables"))
        if more:
            at, extra = merged(more, ["served", "tables"])
            where = np.searchsorted(h, at)
            served[where] += extra[0]
            tables[where] += extra[1]
        root = np.minimum(served, 1)
        if turn:
            at = np.flatnonzero(served > 1)
            at = at[np.argsort(-served[at], kind="stable")]
            pull = np.full(len(at), (strength + discount * n_words) / (n_words + 1))
            root[at] = reseat(served[at], pull, *first_seats(served[at], pull), discount, np.random.default_rng([SEED, turn, row["share"], 1]))[0]
        counts = {"once": [int((served == 1).sum())], "twice": [int((served == 2).sum())], "sent": [int(served.sum())], "opened": [int(root.sum())]}
        return pa.Table.from_batches([record(ROUND, kind=["round"], share=[row["share"]], turn=[turn], served=[pack(served)], tables=[pack(tables)], root=[pack(root)], **counts)])

    return run


TOLD = "kind string, asker long, share long, turn long, c binary, served binary, tables binary, root binary, known binary"


def told(table: pa.Table) -> pa.Table:
    """A share's answers to those that ask, for each round that came with it: values of known words, in the order asked; `known` has their places."""
    rows, out = by_kind(table), [none_of(TOLD)]
    for row in rows.get("words", []):
        h, c = unrising(row["h"]).view(np.uint64), unpack(row["c"])
        rounds = [(r["turn"], {k: unpack(r[k]) for k in ("served", "tables", "root")}) for r in rows["round"]]
        for r in rows.get("ask", []):
            at = unrising(r["h"]).view(np.uint64)
            place = np.minimum(np.searchsorted(h, at), len(h) - 1)
            known = np.flatnonzero(h[place] == at)
            place = place[known]
            for n, (turn, values) in enumerate(rounds):
                same = {"c": [None if n else pack(c[place])], "known": [None if n else rising(known)]}
                out.append(record(TOLD, kind=["told"], asker=[r["asker"]], share=[row["share"]], turn=[turn], **same, **{k: [pack(v[place])] for k, v in values.items()}))
    return pa.Table.from_batches(out)


# Answers


ANSWER = "kind string, batch long, share long, n binary, t binary"


def pair_answers(samples: int):
    def run(table: pa.Table) -> pa.Table:
        rows = by_kind(table)
        (state,), (seats,) = rows["state"], rows["seats"]
        p = Part(state)
        mean = np.minimum(p.n, 1).astype(np.float64)
        mean[p.many] = unpack(seats["total"]) / samples
        out = []
        for r in rows["place"]:
            at = unrising(r["n"])
            out.append(record(ANSWER, kind=["pairs"], batch=[r["batch"]], share=[state["part"]], n=[pack(p.n[at])], t=[pack(mean[at])]))
        return pa.Table.from_batches(out)

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Model:
    """What scores a batch: sizes, discounts, and of each sample (mass of an unknown word, customers of the parent)."""

    def __init__(self, parts: int, hot: np.ndarray, n_tokens: int, n_words: int, discount: float, root_discount: float, strength: float):
        self.parts, self.hot, self.n_tokens, self.n_words = parts, hot, n_tokens, n_words
        self.discount, self.root_discount, self.strength = discount, root_discount, strength
        self.samples: list[tuple[float, float]] = []

    def score(self, table: pa.Table) -> pa.Table:
        columns = {c.split()[0]: [] for c in SCORES.split(", ")}
        rows = by_kind(table)
        for row in rows.get("batch", []):
            x = Slice(row)
            count = np.zeros(len(x.words), np.int64)
            prob = [np.full(len(count), base / sent) for base, sent in self.samples]
            back = [np.ones(len(count)) for _ in self.samples]
            by_share = dict(shares(x.words, self.parts))
            at = {}
            for r in sorted(rows.get("told", []), key=lambda r: r["known"] is None):
                if r["known"] is not None:
                    at[r["share"]] = known = by_share[r["share"]][unrising(r["known"])]
                    count[known] = unpack(r["c"])
                known, turn = at[r["share"]], r["turn"] - 1
                base, sent = self.samples[turn]
                prob[turn][known] = (unpack(r["served"]) - self.root_discount * unpack(r["root"]) + base) / sent
                back[turn][known] = (self.strength + self.discount * unpack(r["tables"])) / (self.strength + count[known])
            w, u, of = x.pair()
            n, t = np.zeros(len(w), np.int64), np.zeros(len(w))
            pairs = {r["share"]: r for r in rows.get("pairs", [])}
            for part, where in x.parts(w, u, self.parts, self.hot):
                n[where], t[where] = unpack(pairs[part]["n"]), unpack(pairs[part]["t"], np.float64)
            chance = (n - self.discount * t) / (self.strength + count[u]) + sum(b[u] * p[w] for b, p in zip(back, prob, strict=True)) / len(prob)
            base = np.log10((count + 1) / (self.n_tokens + self.n_words + 1))
            start = np.cumsum(x.sizes) - x.sizes
            columns["doc_id"] += row["doc_id"]
            columns["held_out"] += row["held"]
            columns["n_tokens"] += x.sizes.tolist()
            columns["n_known"] += np.add.reduceat((count > 0)[x.tokens].astype(np.int64), start).tolist()
            columns["train_tokens"] += [self.n_tokens] * len(start)
            columns["base_score"] += np.add.reduceat(base[x.tokens], start).tolist()
            columns["score"] += np.add.reduceat(np.log10(chance)[of], start).tolist()
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "base_score": pa.float64(), "score": pa.float64()}
        return pa.Table.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def score_texts(docs: DataFrame, held_out: Column, samples: int = SAMPLES, strength: float = STRENGTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each of docs; those held out are not learned from."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    batches = stage(rows.mapInArrow(tokenise, BATCH), "batches")

    def total(df: DataFrame, *names: str) -> list[int]:
        return list(df.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names)).first())

    (all_tokens,) = total(batches, "n_tokens")
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-all_tokens // PART_TOKENS))

    def meet(key: str, run, schema: str, *tables: DataFrame) -> DataFrame:
        """run() over all rows of a key together. Rows are few and large, so partitions are not put together by their bytes."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).repartition(parts, key).groupBy(key).applyInArrow(run, schema)

    words = stage(meet("share", counted_words, WORDS, batches.mapInArrow(words_of(parts), "share long, h binary, n binary")), "words", free=True)
    n_tokens, n_words = total(words, "total", "number")
    hot = np.array([r["h"] for r in words.mapInArrow(hot_words(n_tokens), "h long").collect()], np.int64).view(np.uint64)  # under HOT words

    send, schema = sent_pairs(parts, hot)
    gathered = stage(meet("part", counted, STATE, batches.mapInArrow(send, schema)), "parts", free=True)
    state, places = gathered.where("kind = 'state'").drop("batch"), gathered.where("kind = 'place'").select("kind", "part", "batch", "n")
    discount = _discount(*total(state, "once", "twice"))

    model = Model(parts, hot, n_tokens, n_words, discount, 0.5, strength)
    rounds: list[DataFrame] = []
    seats = None
    for turn in range(samples + 1):
        if turn:
            answers = meet("share", told, TOLD, words, rounds[-1], state.mapInArrow(asked(parts, True), ASK)).withColumnRenamed("asker", "part").select("kind", "part", "share", "served", "tables", "root")
            held = state.select("kind", "part", "words", "contexts", "w", "u", "n")
            run = sampled(parts, discount, strength, turn, base, sent, model.root_discount)
            before, seats = seats, stage(meet("part", run, SEATS, held, answers, *([seats.select("kind", "part", "tables", "sizes", "total")] if seats is not None else [])), "seats", free=True)
            if before is not None:
                drop(before)
            rounds.append(meet("share", parent_round(n_words, model.root_discount, strength, turn), ROUND, words, rounds[0], seats.mapInArrow(extra_tables(parts), SUMS)))
        else:
            rounds.append(meet("share", parent_round(n_words, 0.5, strength, turn), ROUND, words, state.mapInArrow(types_of(parts), SUMS)))
        rounds[-1] = stage(rounds[-1], "round", free=True)
        if not turn:
            model.root_discount = _discount(*total(rounds[0], "once", "twice"))
        served, opened = total(rounds[-1], "sent", "opened")
        base, sent = (strength + model.root_discount * opened) / (n_words + 1), strength + served
        if turn:
            model.samples.append((base, sent))

    of_pairs = stage(meet("part", pair_answers(samples), ANSWER, state.select("kind", "part", "words", "contexts", "w", "u", "n"), seats.select("kind", "part", "total"), places), "pairs", free=True)
    drop(gathered)
    drop(seats)
    of_words = meet("share", told, TOLD, words, *rounds[1:], batches.mapInArrow(asked(parts, False), ASK)).withColumnRenamed("asker", "batch")
    return meet("batch", lambda t: model.score(t), SCORES, batches.withColumn("kind", F.lit("batch")), of_words, of_pairs)


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return settled(spark, "op12", lambda: score_texts(read_table(spark, sf_dir, "documents"), held_out))
