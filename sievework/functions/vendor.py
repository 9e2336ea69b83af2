"""Model vendors by the host of a base URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public API hosts and the provider names that stand before model ids.
VENDORS = {"api.openai.com": "openai", "api.typesafe.ai": "typesafe", "api.anthropic.com": "anthropic", "api.mistral.ai": "mistral", "api.groq.com": "groq", "api.together.xyz": "together", "api.perplexity.ai": "perplexity"}


def host_of(url: Column) -> Column:
    """Host without scheme, credentials, port and path, lower case."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(url), r"^(?:[^/?#]*?://)?(?:[^/?#]*@)?([^/?#:@]*)", 1)), F.lit(""))


def vendor_of_url(url: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in VENDORS.items() for x in pair))[host_of(url)]


def direct_model(url: Column, model: Column) -> Column:
    """The model without `<provider>/` where that provider is the vendor behind the URL."""
    bare = F.regexp_replace(model, "^[^/]*/", "")
    own = F.lower(F.split_part(model, F.lit("/"), F.lit(1))) == vendor_of_url(url)
    return F.when(F.coalesce(own, F.lit(False)) & F.contains(model, F.lit("/")) & (bare != ""), bare).otherwise(model)
