"""Error messages to kinds and reasons: ordered rules, the first that holds wins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds with the phrases that name them, in order.
ERROR_KINDS = {
    "timeout": ["timeout", "timed out", "deadline exceeded", "elapsed"],
    "cancelled": ["cancel"],
    "invalid_config": ["invalid config", "invalidconfig", "not set", "missing config", "unknown plugin"],
    "auth": ["unauthorized", "forbidden", "http 401", "http 403", "api key", "api_key", "credential", "authentication"],
    "invalid_input": ["invalid input", "invalidinput", "unsupported", "malformed", "corrupt", "cannot parse", "parse error", "decode"],
    "upstream": ["upstream", "rate limit", "too many requests", "http 5", "502", "503", "504", "connection", "connect", "dns", "refused", "unavailable"],
}


#: The plugin that writes to the destination, and the destination's name in messages.
SINK, DESTINATION = "index_sink", "search index"


def _has(text: Column, *phrases: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def _first(rules: list[tuple[Column, str]], other: Column | str) -> Column:
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for test, value in rules[1:]:
        out = out.when(test, F.lit(value))
    return out.otherwise(other)


def once(value: Column, rule: Callable[[Column], Column]) -> Column:
    """rule(value), where value is computed once a row however often the rule names it: a CASE's branches share nothing otherwise."""
    return F.transform(F.array(value), rule)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lowered and no other letter; ASCII texts take the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def classify_error(message: Column) -> Column:
    rule = lambda m: _first([(~F.rlike(m, F.lit(r"(?U)\S")), ""), *((_has(m, *phrases), kind) for kind, phrases in ERROR_KINDS.items())], F.lit("internal"))
    return once(ascii_lower(message), rule)


def error_kind(status: Column, message: Column) -> Column:
    return F.when(status == "cancelled", F.lit("cancelled")).otherwise(classify_error(F.coalesce(message, F.lit(""))))


def failure_reason(plugin: Column, message: Column, sink: str = SINK, destination: str = DESTINATION) -> Column:
    """The reason code of a failed step. sink: the plugin that writes to the destination of this name."""
    return once(F.lower(message), lambda m: _failure_reason(plugin, m, sink, destination))


def _failure_reason(plugin: Column, m: Column, sink: str, destination: str) -> Column:
    # The phrases of each reason, in order.
    at_sink = plugin.eqNullSafe(F.lit(sink)) | _has(m, destination, sink)
    rules = [
        (_has(m, "invalid config: ") | m.startswith("invalid pipeline "), "invalid_config"),
        (_has(m, "invalid input: "), "invalid_input"),
        (_has(m, "no lab credits", "insufficient_credits", "source run refused"), "insufficient_credits"),
        (_has(m, "gateway budget is exhausted"), "gateway_budget_exhausted"),
        (_has(m, "has no gateway in the lab", "(no_gateway)", "(token_required)", "serves no lab gateway target without"), "no_gateway"),
        (at_sink & _has(m, "authentication failed", "check the api key", "http 401", "http 403"), "destination_auth"),
        (at_sink & _has(m, f"network error talking to {destination}", f"timed out waiting for {destination}", "unexpected http 5"), "destination_unreachable"),
        (at_sink & ((_has(m, f"{destination} task") & _has(m, "failed")) | _has(m, f"{destination} returned [", "auto_create_index is false", "cannot be sent in any batch")), "destination_rejected"),
        (at_sink & _has(m, "connection ") & _has(m, " not found"), "invalid_config"),
    ]
    return _first(rules, F.lit("internal"))


def source_failure_reason(message: Column) -> Column:
    """The reason code of a failed source run; a rejected fetch tells by its HTTP status."""
    return once(F.lower(message), _source_failure_reason)


def _source_failure_reason(m: Column) -> Column:
    status = F.regexp_extract(m, r"(?s)fetch rejected: .*status ([0-9]{3})", 1)
    fetched = F.when(status.isin("401", "403"), F.lit("source_auth")).when(status.isin("404", "410"), F.lit("source_not_found")).when(status == "402", F.lit("insufficient_credits")).otherwise(F.lit("internal"))
    return (
        F.when(_has(m, "no lab credits", "source run refused"), F.lit("insufficient_credits"))
        .when(_has(m, "fetch rejected: "), fetched)
        .when(_has(m, "fetch: ", "dns: "), F.lit("source_unreachable"))
        .when(m.startswith("job ") | _has(m, " jobs failed; first: "), _failure_reason(F.lit(None).cast("string"), m, SINK, DESTINATION))
        .otherwise(F.lit("internal"))
    )


def http_failure_class(status: Column) -> Column:
    """Whether a call that failed with this HTTP status is worth another attempt."""
    return F.when((status == 429) | status.between(500, 599), F.lit("retryable")).otherwise(F.lit("permanent"))
