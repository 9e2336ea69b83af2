"""Running a pipeline over many jobs at once, with what every step did to every job.

Rows carry what metering needs, so the data goes through the steps once: a trace of entries (step, branch, documents, bytes,
time, units, error), which the first of the rows that a row becomes takes along, and a row that is nothing any more stays
as a tombstone with its trace. A bad file is such a tombstone: it fails its job's step and no other job's. The
ends of the pipeline are written as one table; results and outputs are read from it.

A fan-out over documents needs their places in the job, and a plan cannot name its own rows' places: it writes its input once
and numbers it by a distributed sort.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import rounds, sink, usage
from ..operators.tables import numbered, stage
from .pipeline import Manifest, Operator, Pipeline, PipelineError, Step

#: Fixed value: branches of a step at most.
MOST_BRANCHES = 500
_ENTRY = "array<struct<step:string,branch:int,documents:long,input_bytes:long,duration_ms:double,pages:long,images:long,llm_requests:long,external_requests:long,error:string,place:array<long>>>"
# Operators whose documents are pages (slides, sheets), and what a call of those that ask a service counts as.
_PAGED = ("pdf_extractor", "pptx_extractor", "xlsx_extractor")
_CALLS = {"image_captioner": ("images", "llm_requests"), "llm_enricher": ("llm_requests",), "jev_enricher": ("external_requests",), "whisper_transcriber": ("external_requests",)}
_COUNTED = ("pages", "images", "llm_requests", "external_requests")


@dataclass
class Ran:
    """What a run left: `table` has the rows of the pipeline's ends (column _end), tombstones among them."""

    pipeline: Pipeline
    table: DataFrame
    totals: dict = field(default_factory=dict)

    def branches(self) -> DataFrame:
        """job_id, step, branch, ok, error, documents, duration_ms, input_bytes and units: a row for each branch that a step ran as."""
        each = self.table.select(F.col("_job").alias("job_id"), F.explode("_trace").alias("e")).select("job_id", "e.*")
        sums = [F.sum(c).alias(c) for c in ("documents", "input_bytes", *_COUNTED)]
        error = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("place")))
        return each.groupBy("job_id", "step", "branch").agg(error.alias("error"), *sums, F.round(F.sum("duration_ms")).cast("long").alias("duration_ms")).withColumn("ok", F.col("error").isNull())

    def outcomes(self) -> DataFrame:
        """job_id, round, n, step_id, plugin, status, documents, message, metered, branches, duration_ms, input_bytes and units, of all steps of all jobs."""
        places = _rounds(self.pipeline)
        steps = F.array(*(F.struct(F.lit(places[s.id][0]).alias("round"), F.lit(places[s.id][1]).alias("n"), F.lit(s.id).alias("step"), F.lit(s.plugin).alias("plugin"), F.lit(s.fan_out is not None).alias("fanned")) for s in self.pipeline.steps))
        jobs = self.table.select(F.col("_job").alias("job_id")).distinct().select("job_id", F.explode(steps).alias("s")).select("job_id", "s.*")
        counted = ["documents", "duration_ms", "input_bytes", *_COUNTED]
        # a step without fan-out is one branch, whose error is the step's own
        found = usage.fan_in(self.branches(), counted, ("job_id", "step")).join(self.branches().groupBy("job_id", "step").agg(F.min("error").alias("only")), ["job_id", "step"])
        all_ = jobs.join(found, ["job_id", "step"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        message = F.when(F.col("fanned"), F.col("error")).otherwise(F.col("only"))
        ran = F.coalesce(F.col("branches"), F.lit(0))
        return all_.select(
            "job_id", "round", "n", F.col("step").alias("step_id"), "plugin", F.coalesce("outcome", F.lit("succeeded")).alias("status"), message.alias("message"), F.lit(True).alias("metered"),
            F.when(F.col("fanned"), ran).otherwise(F.lit(1)).cast("int").alias("branches"), *map(zero, counted),
        )

    def ends(self) -> DataFrame:
        """job_id, round, outcome, error: of each job that did not succeed, the round that ended it."""
        stopped = rounds.round_ends(self.outcomes()).where(F.col("outcome").isNotNull())
        return stopped.groupBy("job_id").agg(F.min_by(F.struct("round", "outcome", "error"), "round").alias("s")).select("job_id", "s.*")

    def results(self) -> DataFrame:
        """The rows of each job's record, as events_for_jobs takes them: job_id, step_no, step_id, plugin, status, branches, duration_ms, input_bytes, documents_out, units, error.

        A job has rows up to the round that ended it.
        """
        ends = self.ends().select("job_id", F.col("round").alias("last"))
        reached = self.outcomes().join(ends, "job_id", "left").where(F.col("last").isNull() | (F.col("round") <= F.col("last"))).drop("last")
        kept = rounds.settled(reached)
        with_units = kept.join(reached.select("job_id", "step_id", "branches", "duration_ms", "input_bytes", *_COUNTED), ["job_id", "step_id"])
        none = {u: F.lit(0).cast("double" if u == "audio_seconds" else "long") for u in usage.UNITS}
        units = [(F.col(u) if u in _COUNTED else none[u]).alias(u) for u in usage.UNITS]
        return with_units.select("job_id", (F.col("round") * 1000 + F.col("place")).alias("step_no"), "step_id", "plugin", "status", "branches", "duration_ms", "input_bytes", F.col("documents").alias("documents_out"), *units, "error")

    def jobs(self) -> DataFrame:
        """job_id, status, error: of each job."""
        every = self.table.select(F.col("_job").alias("job_id")).distinct().join(self.ends(), "job_id", "left")
        return every.select("job_id", F.coalesce("outcome", F.lit("succeeded")).alias("status"), "error")

    def output(self, step: str) -> DataFrame:
        """What an end of the pipeline gave to the jobs that succeeded, with their job_id."""
        rows = self.table.where((F.col("_end") == step) & F.col("_live")).join(self.ends().select(F.col("job_id").alias("_job")), "_job", "left_anti")
        return rows.withColumn("job_id", F.col("_job")).drop(*(c for c in rows.columns if c.startswith("_")))


def _rounds(pipeline: Pipeline) -> dict[str, tuple[int, int]]:
    """Of each step its round and its place among the round's steps."""
    out: dict[str, tuple[int, int]] = {}
    while len(out) < len(pipeline.steps):
        turn = 1 + max((r for r, _ in out.values()), default=-1)
        out |= {step: (turn, n) for n, step in enumerate(pipeline.ready(set(out)))}
    return out


def _size(rows: DataFrame) -> Column:
    return usage.blob_size(F.col("data")) if "data" in rows.columns else usage.approx_size(rows)


def _branched(rows: DataFrame, path: str) -> DataFrame:
    """rows with _branch: 0 for `$`, the branch that made it for `$.many`, contiguous groups of a job's documents for `$.documents`."""
    if path == "$":
        return rows.withColumn("_branch", F.lit(0))
    if path == "$.many":
        return rows.withColumn("_branch", F.coalesce("_branch", F.lit(0)))
    # tombstones come behind the documents, so that they take no place among them
    placed = numbered(rows.withColumn("_dead", ~F.col("_live")), ["_job", "_dead"], ["_place"])
    return placed.withColumn("_branch", F.when(F.col("_live"), F.floor(F.col("rank") / F.ceil(F.col("total") / MOST_BRANCHES)).cast("int"))).drop("rank", "total", "_dead")


def _stepped(step: Step, rows: DataFrame, operator: Operator) -> DataFrame:
    """One step over rows with _job, _place, _branch, _live and _trace; each row that was live gets an entry of this step."""
    bytes_ = F.when(F.col("_live"), _size(rows)).cast("long")
    rows = rows.withColumns({"_bytes": bytes_, "_was": F.col("_live")})
    try:
        made = operator(rows, step.config)
    except (ValueError, NotImplementedError) as e:  # a bad configuration fails every job that comes here
        if not str(e).startswith("invalid "):
            raise
        made = rows.withColumns({"_n": F.lit(None).cast("int"), "_error": F.when(F.col("_was"), F.lit(str(e))), "_ms": F.lit(0.0)})
    first, live = F.coalesce(F.col("_n"), F.lit(0)) == 0, F.col("_n").isNotNull()
    once = lambda c: F.when(first, c).otherwise(F.lit(0))
    one = live.cast("long")
    units = {c: F.lit(0) for c in _COUNTED}
    if step.plugin in _PAGED:
        units["pages"] = one
    units |= {c: once(F.lit(1)) for c in _CALLS.get(step.plugin, ())}
    place = F.concat("_place", F.array(F.coalesce(F.col("_n"), F.lit(0)).cast("long")))
    entry = F.struct(
        F.lit(step.id).alias("step"), F.col("_branch").cast("int").alias("branch"), one.alias("documents"), once(F.coalesce(F.col("_bytes"), F.lit(0))).cast("long").alias("input_bytes"), once(F.coalesce(F.col("_ms"), F.lit(0.0))).cast("double").alias("duration_ms"),
        *(units[c].cast("long").alias(c) for c in _COUNTED), F.when(first, F.col("_error")).alias("error"), place.alias("place"),
    )
    none = F.array().cast(_ENTRY)
    trace = F.concat(F.when(first, F.col("_trace")).otherwise(none), F.when(F.col("_was"), F.array(entry).cast(_ENTRY)).otherwise(none))
    return made.withColumns({"_trace": trace, "_place": place, "_live": live}).drop("_n", "_error", "_ms", "_bytes", "_was")


def execute(pipeline: Pipeline, source: DataFrame, operators: dict[str, Operator], manifests: dict[str, Manifest] | None = None, job: str | None = "job_id", order: str | None = None) -> Ran:
    """Runs the steps over the source's jobs (column `job`, or all rows as one job). operators are over metered rows, as catalog.STEPS.

    order: an integer column by which a job's rows go (else by their place in the source).
    Index sinks with a path store what the jobs that succeeded gave them. Several inputs are a union; a step that several others
    follow gives its trace to the first of them alone.
    """
    known = F.col(job).cast("string") if job and job in source.columns else F.lit("job")
    start = {"_job": known, "_place": F.array(F.col(order).cast("long") if order else F.monotonically_increasing_id()), "_branch": F.lit(None).cast("int"), "_live": F.lit(True), "_trace": F.array().cast(_ENTRY)}
    base = stage(source.withColumns(start), "source")
    done: dict[str, DataFrame] = {}
    taken: set[str] = set()
    gives: dict[str, str] = {}
    by_id = {s.id: s for s in pipeline.steps}

    def take(name: str | None) -> DataFrame:
        rows, key = (done[name], name) if name else (base, "")
        if key in taken:
            return rows.where("_live").withColumn("_trace", F.array().cast(_ENTRY))
        taken.add(key)
        return rows

    followers = {d for s in pipeline.steps for d in s.depends_on}
    for name in pipeline.order():
        step = by_id[name]
        if step.plugin not in operators:
            raise PipelineError("UnknownPlugin", f"unknown plugin {step.plugin}")
        kinds = [gives[d] for d in step.depends_on] or ["bytes" if "data" in base.columns else "documents"]
        manifest = (manifests or {}).get(step.plugin)
        if step.fan_out == "$.documents" and kinds[0] == "bytes":
            raise PipelineError("InvalidInput", f"{name}: bytes have no documents to fan out")
        if manifest:
            manifest.check("documents" if step.fan_out == "$.documents" else "many" if len(kinds) > 1 else kinds[0])
        gives[name] = "many" if step.fan_out else manifest.produces if manifest else "documents"
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(take, step.depends_on or [None]))
        rows = _branched(rows, step.fan_out) if step.fan_out else rows.withColumn("_branch", F.lit(None).cast("int"))
        out = _stepped(step, rows, operators[step.plugin])
        if sum(name in s.depends_on for s in pipeline.steps) > 1:
            out = stage(out, "step")
        done[name] = out
    ends = [done[s.id].withColumn("_end", F.lit(s.id)) for s in pipeline.steps if s.id not in followers]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ends)
    seen = Observation()
    failed = F.exists("_trace", lambda e: e["error"].isNotNull())
    watched = whole.observe(seen, F.count_if("_live").alias("rows"), F.count_if(failed).alias("errors"), F.coalesce(F.sum(F.aggregate("_trace", F.lit(0).cast("long"), lambda a, e: a + e["input_bytes"])), F.lit(0)).alias("input_bytes"))
    ran = Ran(pipeline, stage(watched, "ends"), {})
    ran.totals = dict(seen.get)
    for step in pipeline.steps:
        if step.plugin == "index_sink" and step.config.get("path") and step.id not in followers:
            sink.store(ran.output(step.id).drop("job_id"), step.config)
    return ran
