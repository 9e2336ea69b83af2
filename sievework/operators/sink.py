"""The index: idempotent upserts, pruning of stale children, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batching import Rule, batched
from .documents import carried, strict
from .index import read_index, write_index
from .json_records import InvalidConfig

#: Documents and bytes in a batch at most.
MAX_DOCS, MAX_BYTES = 1000, 50 << 20


class OversizedDocument(ValueError):
    pass


def index_json(id_: Column, title: Column, content: Column, fields: dict[str, Column], meta: Column | None = None) -> Column:
    """A document as the index holds it: id, title, content, its fields, and _meta where there is any. Null values are left out."""
    parts = {"id": id_, "title": fields.get("title", title), "content": content} | {k: v for k, v in fields.items() if k not in ("id", "content", "_meta", "title")}
    if meta is not None:
        parts["_meta"] = F.when(F.to_json(meta) != "{}", meta)
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """stored and new rows by key; a new row replaces, and of new rows with one key the last."""
    latest = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in (key, order)]), order).alias("r")).select(key, "r.*")
    return stored.join(latest.select(key), key, "left_anti").select(*latest.columns).unionByName(latest)


def complete_parents(docs: DataFrame) -> DataFrame:
    """docs: id, parent_id, chunk_total. Parents of which the run has every chunk (or that state no total)."""
    n, low, high = F.count_distinct("id"), F.min("chunk_total"), F.max("chunk_total")
    agreed = (F.count("chunk_total") == 0) | ((low == high) & (F.count("chunk_total") == F.count("*")) & (n == high))
    return docs.where("parent_id is not null").groupBy("parent_id").agg(agreed.alias("complete")).where("complete").select("parent_id")


def prune(stored: DataFrame, run: DataFrame) -> DataFrame:
    """Stored rows that go: children of the run's complete parents that the run does not have."""
    return stored.join(complete_parents(run), "parent_id", "left_semi").join(run.select("id"), "id", "left_anti")


def plan_batches(sized: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, group: str = "part") -> DataFrame:
    """sized: part, seq, size. Adds batch: cut before the document that would exceed max_docs or max_bytes (with brackets and commas).

    Each part is cut by itself, in order of seq; a document over max_bytes alone is an error.
    """
    large = F.concat(F.lit("a document of "), F.col("size").cast("string"), F.lit(f" bytes fits in no batch of {max_bytes}"))
    fits = F.when(F.col("size") + 2 > max_bytes, F.raise_error(large).cast("boolean")).otherwise(F.lit(True))
    return batched(sized.where(fits), Rule(max_docs, max_bytes, 2, 1), group, "seq", "size")


#: Ids that a filter lists at most.
IDS_PER_FILTER = 1000


def _quoted(c: Column) -> Column:
    """A filter's string; null where a backslash could change what it means."""
    return F.when(~F.contains(c, F.lit("\\")), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"')))


def prune_filters(children: DataFrame, key: str = "id", most: int = IDS_PER_FILTER, group: str = "part") -> DataFrame:
    """children: part, seq, parent_id, id. The filters (part, n, filter) by which a service deletes stale children of these parents.

    Parents go into a filter in the order in which they came, until it would list more than `most` ids; a parent is never
    split, so one with more has a filter of its own. A parent with an id that cannot be written safely is left out.
    prune() does the same as a join where the index is a table.
    """
    rows = children.where("parent_id is not null").select(group, "seq", _quoted(F.col("parent_id")).alias("p"), F.coalesce("parent_id", F.lit("")).alias("raw"), _quoted(F.col("id")).alias("i"))
    safe = (F.count("i") == F.count("*")) & (F.count("p") == F.count("*"))
    parents = rows.groupBy(group, "raw").agg(F.first("p").alias("p"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "i"))), lambda x: x["i"]).alias("ids"), F.min("seq").alias("seq"), safe.alias("safe")).where("safe")
    sized = parents.select(group, "seq", "p", "ids", F.size("ids").alias("size"))
    numbered = batched(sized, Rule(most, most), group, "seq", "size", "n").withColumn("n", F.col("n").cast("int"))
    one = numbered.groupBy(group, "n").agg(F.array_sort(F.collect_list(F.struct("seq", "p", "ids"))).alias("x"))
    listed = lambda c: F.array_join(c, ", ")
    text = F.concat(F.lit("_meta.parent_id IN ["), listed(F.transform("x", lambda r: r["p"])), F.lit(f"] AND NOT {key} IN ["), listed(F.flatten(F.transform("x", lambda r: r["ids"]))), F.lit("]"))
    return one.select(group, "n", text.alias("filter"))


def confirmed(plan: DataFrame, checkpoint: DataFrame, tasks: DataFrame) -> DataFrame:
    """The leading batches of each step's plan that need not be sent again.

    plan: step, batch, start, end, destination, documents; checkpoint (of the last attempt): step, batch, start, end, task,
    enqueued_ms, destination, documents; tasks (what the service has): task, destination, enqueued_ms. destination and
    documents are fingerprints. The first batch that is not confirmed ends it, so that batches keep their order.
    """
    same = ["step", "batch", "start", "end", "destination", "documents"]
    sent = checkpoint.select(*same, "task", "enqueued_ms").join(tasks.select("task", "destination", "enqueued_ms"), ["task", "destination", "enqueued_ms"], "left_semi")
    known = plan.join(sent.select(*same, "task"), same, "left")
    first = known.groupBy("step").agg(F.min(F.when(F.col("task").isNull(), F.col("batch"))).alias("from"))
    return known.join(first, "step").where(F.col("from").isNull() | (F.col("batch") < F.col("from"))).select("step", "batch", "task")


#: What an index row has beside its id; other columns of documents stay out.
_ROW = ("title", "content", "fields", "section", "page", "language", "parent_id", "chunk_index", "chunk_total", "filename", "mime")


# What the sink's configuration may hold beside the path of a Parquet index.
KEYS = {"path", "host", "api_key", "index", "primary_key", "prune", "max_docs_per_batch", "max_batch_bytes", "auto_create_index", "wait_for_task", "task_timeout_secs"}


def _checked(config: dict) -> None:
    if unknown := sorted(set(config) - KEYS):
        raise InvalidConfig(f"invalid config: index_sink: unknown {', '.join(unknown)}")


def formed(docs: DataFrame, config: dict) -> DataFrame:
    """Metered rows: documents as index rows, with the JSON that a batch carries. A document over max_batch_bytes is an error; nothing is written."""
    _checked(config)
    most = int(config.get("max_batch_bytes", MAX_BYTES))
    meta = [c for c in ("section", "page", "language", "parent_id", "chunk_index", "chunk_total", "filename", "mime") if c in docs.columns]
    none = F.lit(None).cast("string")
    json = index_json(F.col("id"), F.col("title") if "title" in docs.columns else none, F.col("content"), {}, F.struct(*meta) if meta else None)
    rows = docs.select("id", *(c for c in _ROW if c in docs.columns), F.when(F.col("id").isNotNull(), json).alias("json"), *carried(docs))
    large = F.octet_length("json") + 2 > most
    error = F.when(large, F.concat(F.lit("invalid input: document "), F.col("id"), F.lit(f" cannot be sent in any batch of {most} bytes")))
    return rows.withColumns({"_n": F.when(F.col("id").isNotNull() & ~large, F.lit(0)), "_error": error, "_ms": F.lit(0.0)})


def store(rows: DataFrame, config: dict) -> None:
    """Upserts formed rows into the index at the configured path; of rows with one id the last chunk's stays."""
    for c, kind in (("parent_id", "string"), ("chunk_total", "int"), ("chunk_index", "int")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    last = rows.withColumn("seq", F.coalesce(F.col("chunk_index"), F.lit(0)).cast("long"))
    write_index(rows.sparkSession, last, config["path"], prune_stale=bool(config.get("prune", False)))


def run(docs: DataFrame, config: dict) -> DataFrame:
    """The sink step of a pipeline over plain rows. config: path (of the index; without one the rows are only formed), prune, max_batch_bytes.

    With a path, documents are upserted there and the rows that the index then has for them come back. A document over
    max_batch_bytes is an error before anything is written.
    """
    rows, path = formed(docs, config), config.get("path")
    if not path:
        return strict(rows)
    too_large = rows.where(F.col("_error").isNotNull()).select("id").head(1)
    if too_large:
        raise OversizedDocument(f"document {too_large[0]['id']} fits in no batch of {config.get('max_batch_bytes', MAX_BYTES)} bytes")
    store(strict(rows), config)
    return read_index(docs.sparkSession, path).join(docs.select("id").distinct(), "id", "left_semi")
