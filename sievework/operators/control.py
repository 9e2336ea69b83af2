"""Control-plane relations: jobs, sources, runs, pipelines, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .index import append
from .tables import dealt

TERMINAL = ["succeeded", "failed", "cancelled"]


def status_rank(status: Column) -> Column:
    return F.when(status == "queued", 0).when(status == "running", 1).otherwise(2)


def jobs_list(jobs: DataFrame, tenant: str | None = None, status: str | None = None, pipeline: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of jobs, newest first; filters that are not given hold for all."""
    for column, value in (("tenant_id", tenant), ("status", status), ("pipeline_uid", pipeline)):
        if value is not None:
            jobs = jobs.where(F.col(column) == value)
    return jobs.orderBy(F.col("started_at").desc(), "job_id").offset(offset).limit(limit)


def capped_count(jobs: DataFrame, cap: int) -> DataFrame:
    """The number of rows, counting no further than cap."""
    return jobs.limit(cap).agg(F.count("*").alias("total"))


def job_upsert(writes: DataFrame) -> DataFrame:
    """writes: job_id, seq, status, current_step, error, source_id, ... Inserts of each job folded in order of seq.

    The status never goes back: of the writes with the highest rank, the last one gives status, step, error and start;
    the last write that has one gives source_id.
    """
    order = F.struct(status_rank(F.col("status")), "seq")
    furthest = F.max_by(F.struct("status", "current_step", "error", "started_at"), order)
    latest = F.max_by(F.struct("pipeline_uid", "tenant_id"), "seq")
    source = F.max_by("source_id", F.when(F.col("source_id").isNotNull(), F.col("seq")))
    return writes.groupBy("job_id").agg(furthest.alias("f"), latest.alias("l"), source.alias("source_id")).select("job_id", "l.*", "f.*", "source_id")


def job_patch(jobs: DataFrame, patches: DataFrame) -> DataFrame:
    """patches: job_id and new values, null for as it is. A status that ranks below the stored one is stale and leaves status, step and error."""
    p = patches.select("job_id", *(F.col(c).alias(f"n_{c}") for c in ("status", "current_step", "error", "index_name")))
    both = jobs.join(p, "job_id", "left")
    stale = F.coalesce(F.when(F.col("n_status").isNotNull(), status_rank(F.col("n_status"))) < status_rank(F.col("status")), F.lit(False))
    new = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c))
    step = F.when(F.col("n_status") == "succeeded", F.lit(None).cast("string")).otherwise(new("current_step"))
    values = {"status": F.when(stale, F.col("status")).otherwise(new("status")), "current_step": F.when(stale, F.col("current_step")).otherwise(step), "error": F.when(stale, F.col("error")).otherwise(new("error")), "index_name": new("index_name")}
    return both.select(*(values.get(c, F.col(c)).alias(c) for c in jobs.columns))


def _without_children(jobs: DataFrame, children: DataFrame) -> DataFrame:
    return jobs.join(children.select(F.col("parent_job_id").alias("job_id")), "job_id", "left_anti")


def blob_sweep_claim(jobs: DataFrame, now: Column, ttl_days: int, lease_secs: int, limit: int) -> DataFrame:
    """Ended jobs whose blobs are due: not deleted, not leased, no child at work; oldest first."""
    due = jobs.where(
        F.col("status").isin(TERMINAL) & F.col("blobs_deleted_at").isNull() & (F.col("updated_at") < now - F.expr(f"INTERVAL {ttl_days} DAYS")) & (F.col("blobs_claimed_at").isNull() | (F.col("blobs_claimed_at") < now - F.expr(f"INTERVAL {lease_secs} SECONDS")))
    )
    return _without_children(due, jobs.where(~F.col("status").isin(TERMINAL) & F.col("parent_job_id").isNotNull())).orderBy("updated_at", "job_id").limit(limit)


def retention_jobs(jobs: DataFrame, before: Column) -> DataFrame:
    """Ended jobs from before a time that no job names as its parent."""
    return _without_children(jobs.where(F.col("status").isin(TERMINAL) & (F.col("started_at") < before)), jobs.where("parent_job_id is not null"))


def retention_runs(runs: DataFrame, before: Column) -> DataFrame:
    """Runs of sources from before a time."""
    return runs.where(F.col("started_at") < before)


def failure_streak(runs: DataFrame, window: int = 1000) -> DataFrame:
    """runs: source_id, run_id, started_at, outcome. Failed runs in a row at each source's newest end."""
    w = Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    numbered = runs.select("source_id", "outcome", F.row_number().over(w).alias("k")).where(F.col("k") <= window)
    first_other = F.min(F.when(F.col("outcome") != "failed", F.col("k")))
    return numbered.groupBy("source_id").agg((F.coalesce(first_other, F.count("*") + 1) - 1).alias("streak"))


def status_transition(runs: DataFrame) -> DataFrame:
    """Runs with which a source began to fail or recovered.

    A source's history is cut into ranges, each of which knows how the one before it ended, so no task walks a whole history.
    """
    order = ["started_at", "run_id"]
    rows = dealt(runs.withColumn("_failed", F.col("outcome") == "failed"), ["source_id", *order])
    ends = rows.groupBy(F.col("source_id").alias("_s"), F.col("__part").alias("_p")).agg(F.max_by("_failed", F.struct(*order)).alias("_end"))
    carried = ends.select("_s", "_p", F.lag("_end").over(Window.partitionBy("_s").orderBy("_p")).alias("_carried"))  # a row a range
    told = rows.join(carried, F.col("source_id").eqNullSafe(F.col("_s")) & (F.col("__part") == F.col("_p")))
    within = Window.partitionBy("source_id", "__part").orderBy(*order)
    failed, before = F.col("_failed"), F.coalesce(F.lag("_failed").over(within), F.col("_carried"), F.lit(False))
    found = told.withColumn("transition", F.when(failed & ~before, F.lit("failing")).when(~failed & before, F.lit("ok")))
    return found.where("transition is not null").select(*runs.columns, "transition")


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs of each source, 1 to 500."""
    w = Window.partitionBy("source_id").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(1, min(limit, 500)))


def shadowed_lookup(pipelines: DataFrame, tenant: str) -> DataFrame:
    """For each uid the tenant's own pipeline, else the global one."""
    seen = pipelines.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))
    return seen.groupBy("uid").agg(F.min_by(F.struct("tenant_id", "version"), F.col("tenant_id").isNull()).alias("p")).select("uid", "p.*")


def visible(pipelines: DataFrame, tenant: str) -> DataFrame:
    """A tenant's and all global pipelines, without global ones that the tenant has under the same uid."""
    own = pipelines.where(F.col("tenant_id") == tenant)
    return own.unionByName(pipelines.where("tenant_id is null").join(own.select("uid"), "uid", "left_anti").select(*pipelines.columns))


def listed(pipelines: DataFrame, tenant: str) -> DataFrame:
    """A tenant's pipelines, then all global ones, shadowed or not, each by uid."""
    return pipelines.where(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant)).orderBy(F.col("tenant_id").isNull(), "uid")


def pipeline_cascade(sources: DataFrame, pipelines: DataFrame, uid: str) -> DataFrame:
    """Sources to archive when the global pipeline goes: those of tenants that have none of their own under its uid."""
    own = pipelines.where((F.col("uid") == uid) & F.col("tenant_id").isNotNull()).select("tenant_id")
    return sources.where(F.col("pipeline_uid") == uid).join(own, "tenant_id", "left_anti")


def connection_used_by(pipelines: DataFrame, connection: str) -> DataFrame:
    """pipelines: uid, steps (array of plugin and connection). Those with a step that names the connection."""
    return pipelines.where(F.exists("steps", lambda s: s["connection"] == connection)).select("uid")


def unknown_plugins(steps: DataFrame, known: DataFrame) -> DataFrame:
    return steps.select("plugin").distinct().join(known.select("plugin"), "plugin", "left_anti")


def pipeline_upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The table after writing `new` (uid, tenant_id): versions count up by uid and tenant."""
    key = lambda df: df.withColumn("t", F.coalesce("tenant_id", F.lit("")))
    s, n = key(stored), key(new)
    put = n.join(s.select("uid", "t", F.col("version").alias("old")), ["uid", "t"], "left").select("uid", "tenant_id", (F.coalesce("old", F.lit(0)) + 1).alias("version"))
    return put.unionByName(s.join(n.select("uid", "t"), ["uid", "t"], "left_anti").select("uid", "tenant_id", "version"))


def source_patch(sources: DataFrame, patches: DataFrame) -> DataFrame:
    """A patch's values, null for as it is; index_name and fetch_auth also become null where set_index or set_auth says so.

    What was learned of the content (etag, last_modified, hash) holds for one location, pipeline, time zone, index and
    credential: where a patch really changes one of them, it is forgotten.
    """
    forced = {"index_name": "set_index", "fetch_auth": "set_auth"}
    given = [c for c in patches.columns if c != "source_id"]
    both = sources.join(patches.select("source_id", *(F.col(c).alias(f"n_{c}") for c in given)), "source_id", "left")
    new, changed = {}, F.lit(False)
    for c in sources.columns:
        if c in forced and c in given:
            writes = F.coalesce(F.col(f"n_{forced[c]}"), F.lit(False))
            new[c] = F.when(writes, F.col(f"n_{c}")).otherwise(F.col(c))
        elif c in given:
            new[c] = F.coalesce(F.col(f"n_{c}"), F.col(c))
        if c in new and c in ("pipeline_uid", "location", "timezone", *forced):
            changed |= ~new[c].eqNullSafe(F.col(c))
    learned = {c: F.when(~changed, F.col(c)) for c in ("etag", "last_modified", "hash") if c in sources.columns}
    return both.select(*((new | learned).get(c, F.col(c)).alias(c) for c in sources.columns))


def run_upsert(writes: DataFrame) -> DataFrame:
    """writes: run_id, seq, started_at, outcome, items. The last write of each run, with its first start."""
    return writes.groupBy("run_id").agg(F.min_by("started_at", "seq").alias("started_at"), F.max_by(F.struct("outcome", "items"), "seq").alias("r")).select("run_id", "started_at", "r.*")


def run_outcome(jobs: DataFrame) -> DataFrame:
    """jobs: run_id, n, ok, error, one row a job; ok is null in the only row of a run whose source had nothing new.

    Each run: ingested, failed or unchanged, the items that went in, and what failed first.
    """
    failed, total = F.count_if(~F.col("ok")), F.count("*")
    first = F.min_by(F.when(~F.col("ok"), F.col("error")), F.when(~F.col("ok"), F.col("n")))
    others = F.when(failed > 1, F.lit(" (see the jobs for the others)")).otherwise(F.lit(""))
    text = F.when(total == 1, first).otherwise(F.concat(failed.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" jobs failed; first: "), first, others))
    outcome = F.when(F.count("ok") == 0, F.lit("unchanged")).when(failed > 0, F.lit("failed")).otherwise(F.lit("ingested"))
    return jobs.groupBy("run_id").agg(outcome.alias("outcome"), F.count_if(F.col("ok")).alias("items"), F.when(failed > 0, text).alias("error"))


def archive_outcome(files: DataFrame) -> DataFrame:
    """files: job_id, n, path, status (null in the only row of an empty archive), error. An archive's counts and why it failed, if it did.

    Files that were skipped are not among those handled.
    """
    count = lambda s: F.count_if(F.col("status") == s)
    ok, failed, skipped = count("succeeded"), count("failed"), count("skipped")
    first = F.min_by(F.when(F.col("status") == "failed", F.concat("path", F.lit(": "), "error")), F.when(F.col("status") == "failed", F.col("n")))
    # The texts of messages.
    message = F.concat(failed.cast("string"), F.lit(" of "), (ok + failed).cast("string"), F.lit(" files failed; first: "), first)
    nothing = F.when(skipped == 0, F.lit("the archive holds no files")).otherwise(F.concat(F.lit("none of the archive's files could be ingested ("), skipped.cast("string"), F.lit(" skipped; see progress.archive.skipped)")))
    return files.groupBy("job_id").agg(ok.alias("succeeded"), failed.alias("failed"), skipped.alias("skipped"), F.when(failed > 0, message).when(ok == 0, nothing).alias("error"))


def outbox_lease(events: DataFrame, now: Column, limit: int, lease_secs: int) -> DataFrame:
    """The outbox after a claim: the claimed events are due again only when the lease has run out; `claimed` marks them."""
    mine = outbox_claim(events, now, limit).select("id", F.lit(True).alias("claimed"))
    after = F.when(F.col("claimed"), now + F.expr(f"INTERVAL {lease_secs} SECONDS")).otherwise(F.col("next_attempt_at"))
    leased = events.join(F.broadcast(mine), "id", "left")  # at most `limit` rows
    return leased.withColumns({"next_attempt_at": after, "claimed": F.coalesce("claimed", F.lit(False))})


def outbox_claim(events: DataFrame, now: Column, limit: int) -> DataFrame:
    """Undelivered events that are due, oldest first."""
    return events.where(F.col("delivered_at").isNull() & (F.col("next_attempt_at") <= now)).orderBy("created_at", "id").limit(limit)


def claim(events: DataFrame, path: str, owner: str, now: Column, limit: int, lease_secs: int) -> DataFrame:
    """Claims up to `limit` due events for a worker: id, owner, until. The claims are a versioned table at path, so that of
    workers at one time none gets an event that another holds; a lease that ran out may be claimed again.
    """
    spark = events.sparkSession

    def mine(held: DataFrame | None) -> DataFrame:
        free = events if held is None else events.join(held.where(F.col("until") > now).select(F.col("id").cast(events.schema["id"].dataType)), "id", "left_anti")
        return outbox_claim(free, now, limit).select(F.col("id").cast("string").alias("id"), F.lit(owner).alias("owner"), (now + F.expr(f"INTERVAL {lease_secs} SECONDS")).alias("until"))

    return append(spark, path, mine)


def outbox_insert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored events and those new ones whose id is not there yet; of new ones with one id, the first (by seq)."""
    first = new.groupBy("id").agg(F.min_by("payload", "seq").alias("payload"))
    return stored.select("id", "payload").unionByName(first.join(stored.select("id"), "id", "left_anti"))


def outbox_stats(events: DataFrame, now: Column) -> DataFrame:
    """Undelivered events and the age of the oldest: from its whole second to the second that is nearest to now (of two, the even one)."""
    open_ = events.where("delivered_at is null")
    second = F.date_part(F.lit("SECOND"), now)
    nearest = F.unix_timestamp(now) + (F.bround(second) - F.floor(second)).cast("long")
    return open_.agg(F.count("*").alias("pending"), (nearest - F.unix_timestamp(F.min("created_at"))).alias("oldest_secs"))


def outbox_drop(events: DataFrame, now: Column) -> DataFrame:
    """What stays: no skipped event after a day, none undelivered after seven, none delivered seven days ago."""
    old = lambda c, span: F.coalesce(F.col(c) < now - F.expr(f"INTERVAL {span}"), F.lit(False))
    gone = (F.col("skipped") & old("created_at", "24 HOURS")) | (F.col("delivered_at").isNull() & old("created_at", "7 DAYS")) | old("delivered_at", "7 DAYS")
    return events.where(~gone)


def outbox_backoff(attempts: Column, jitter: Column | float = 1.0) -> Column:
    """Seconds until the next attempt."""
    return F.least(F.pow(F.lit(2.0), F.least(attempts + 1, F.lit(9))), F.lit(300.0)) * jitter


def retry_delay(retry: Column, base: float, most: float, jitter: Column | float = 1.0) -> Column:
    """Seconds before the n-th retry (from 1); jitter from 0 to 1."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), retry - 1), F.lit(most)) * (0.5 + 0.5 * jitter)
