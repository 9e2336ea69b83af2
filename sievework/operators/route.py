"""Routing content to pipelines: the best matching rule of each blob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime as M
from ..plans.builtin import BUILTIN

RULES = "uid string, tenant_id string, builtin boolean, content_type string, filename_pattern string, ord int"
#: Triggers up to which the rule table is broadcast whole; one pipeline has a few.
MOST_RULES = 100_000


def builtin_rules(spark: SparkSession) -> DataFrame:
    """One row for each content type of each built-in pipeline, in order."""
    return spark.createDataFrame([(uid, None, True, t, None, n) for n, (uid, (types, _)) in enumerate(BUILTIN.items()) for t in types], RULES)


def trigger_matches(content_type: Column, pattern: Column, mime: Column, filename: Column) -> Column:
    """By type (wildcards and other spellings too), and by filename where there is a pattern; nothing if there is neither."""
    by_type = M.mime_matches(M.canonical_content_type(content_type), M.canonical_content_type(mime))
    by_name = F.coalesce(M.glob_match(pattern, filename), F.lit(False))
    return F.when(pattern.isNull(), F.coalesce(by_type, F.lit(False))).otherwise(by_name & F.coalesce(by_type, F.lit(True)))


def trigger_names_type(content_types: Column, mime: Column) -> Column:
    return F.exists(content_types, lambda t: M.canonical_content_type(t) == M.canonical_content_type(mime))


def _prepared(rules: DataFrame) -> DataFrame:
    """rank (less is better), key (a canonical type, `type/*` or `*`), tenant_id, and of filename patterns: regex, head and tail (literal, lower case)."""
    named = F.col("filename_pattern").isNotNull()
    kind = M.canonical_content_type(F.col("content_type"))
    key = F.when(kind.isin("*", "*/*") | (kind.isNull() & named), F.lit("*")).otherwise(kind)
    tier = F.when(F.col("tenant_id").isNotNull(), 0).when(~F.col("builtin"), 1).otherwise(2)
    rank = F.struct(tier.alias("tier"), (~named).alias("plain"), "ord", "uid")
    edge = lambda rx: F.lower(F.regexp_extract("filename_pattern", rx, 0))
    return rules.select(rank.alias("rank"), key.alias("key"), F.col("tenant_id").alias("for"), M.glob_regex(F.col("filename_pattern")).alias("regex"), edge(r"^[^*?]*").alias("head"), edge(r"[^*?]*$").alias("tail")).where("key is not null")


def route(blobs: DataFrame, rules: DataFrame, tenant: Column | None = None) -> DataFrame:
    """blobs: blob_id, mime, filename (and tenant). blob_id and the uid of its pipeline; blobs without one go.

    Of the rules that match and that the tenant may see: the tenant's before global before built-in ones, those with a filename
    pattern first, then in order. Rules meet the distinct (content type, tenant) pairs of the blobs by equality of keys, so
    each is worked out once; a blob then tests only the patterns that its type leaves, those whose literal ends fit first.
    """
    if rules.count() > MOST_RULES:
        raise ValueError(f"invalid config: over {MOST_RULES} routing rules")
    who = tenant if tenant is not None else F.lit(None).cast("string")
    seen = blobs.select("blob_id", "mime", M.base_name(F.col("filename")).alias("name"), (F.octet_length("filename") <= 1024).alias("short"), who.alias("who"))
    kind = M.canonical_content_type(F.col("mime"))
    whole = F.when(F.contains(kind, F.lit("/")), F.concat(F.split_part(kind, F.lit("/"), F.lit(1)), F.lit("/*")))
    keys = F.array_compact(F.array(F.lit("*"), kind, whole))
    kinds = seen.select("mime", "who").distinct().withColumn("key", F.explode(keys))
    fitting = kinds.join(F.broadcast(_prepared(rules)), "key").where(F.col("for").isNull() | (F.col("for") == F.col("who")))  # at most MOST_RULES rows
    pattern = F.when(F.col("regex").isNotNull(), F.struct("rank", "regex", "head", "tail"))
    best = fitting.groupBy("mime", "who").agg(F.min(F.when(F.col("regex").isNull(), F.col("rank"))).alias("plain"), F.array_sort(F.collect_list(pattern)).alias("named"))
    best = best.select(F.col("mime").alias("m"), F.col("who").alias("w"), "plain", "named")
    low = F.lower("name")
    fits = lambda r: F.col("short") & F.startswith(low, r["head"]) & F.endswith(low, r["tail"]) & F.regexp_like(F.col("name"), r["regex"])
    joined = seen.join(best, F.col("mime").eqNullSafe(F.col("m")) & F.col("who").eqNullSafe(F.col("w")))
    first = F.when(F.size("named") > 0, F.get(F.filter("named", fits), F.lit(0))["rank"])
    return joined.select("blob_id", F.least(first, F.col("plain"))["uid"].alias("uid")).where("uid is not null")


def archive_plan(mime: Column, names_type: Column, forced: Column) -> Column:
    """`pipeline` for archives whose routed pipeline names their very type, else `expand`; other content goes to its pipeline."""
    archive = M.is_archive(M.canonical_content_type(mime))
    return F.when(archive & ~(names_type & ~forced), F.lit("expand")).otherwise(F.lit("pipeline"))
