"""Enriching documents with an injected model client: prompts, replies, typed questions, retries.

There is no client without a network; enrich() fails clearly unless one is given.
"""

from __future__ import annotations

import json
import random
import re
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .documents import said, strict


class Retryable(Exception):
    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


class Declined(Exception):
    """The model gave no answer: content_filter, refusal or empty."""


@dataclass(frozen=True)
class EnrichConfig:
    prompt: str = ""
    max_concurrent: int = 8
    max_input_chars: int = 12_000
    merge_strategy: str = "merge"
    allow_reserved: tuple[str, ...] = field(default=())
    on_refusal: str = "keep"

    def __post_init__(self):
        if self.merge_strategy not in ("merge", "replace") or self.on_refusal not in ("keep", "fail"):
            raise ValueError("invalid config: merge_strategy or on_refusal")


def parse_object(reply: str) -> dict | None:
    text = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```[A-Za-z0-9_+-]*[ \t]*\n?", "", reply))
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def apply_reply(doc: dict, reply: str, config: EnrichConfig = EnrichConfig()) -> dict:
    """doc: title, language, fields (a dict). The reply's object merged: what is there stays, or is replaced."""
    doc = doc | {"fields": dict(doc.get("fields") or {})}
    found = parse_object(reply)
    if found is None:
        doc["fields"]["llm_raw"] = reply
        return doc
    replace = config.merge_strategy == "replace"
    for key, value in found.items():
        if key in ("title", "language"):
            if isinstance(value, str) and (replace or doc.get(key) is None):
                doc[key] = value
        elif not key.startswith("_") or key in config.allow_reserved:
            if replace or key not in doc["fields"]:
                doc["fields"][key] = value
    return doc


def caption_document(reply: str, allow_reserved: tuple[str, ...] = ()) -> dict:
    """A vision model's reply as a document: caption is the content, text_in_image a field, the rest fields."""
    found = parse_object(reply)
    if found is None:
        return {"content": reply, "fields": {}}
    fields = {("ocr_text" if k == "text_in_image" else k): v for k, v in found.items() if k != "caption" and (not k.startswith("_") or k in allow_reserved)}
    return {"content": str(found.get("caption") or ""), "fields": fields}


def answer_fields(questions: dict[str, dict], answers: dict[str, dict]) -> dict:
    """questions: key -> kind (choice with options, yesno with threshold, score with levels). Fields with confidences; a missing answer fails."""
    out = {}
    for key, q in questions.items():
        if key not in answers:
            raise ValueError(f"upstream: no answer for {key}")
        a = answers[key]
        if q["kind"] == "choice":
            if not 2 <= len(q["options"]) <= 255 or a["value"] not in q["options"]:
                raise ValueError(f"upstream: {a['value']!r} is none of the options of {key}")
            out[key] = a["value"]
        elif q["kind"] == "yesno":
            out[key] = a["confidence"] >= q.get("threshold", 0.5)
        else:
            if not 2 <= q["levels"] <= 10:
                raise ValueError(f"invalid config: levels of {key}")
            out[key] = a["value"]
        out[f"{key}_confidence"] = a["confidence"]
    return out


def with_retry(call: Callable[[], str], attempts: int = 4, base: float = 1.0, most: float = 20.0, total: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> str:
    spent = 0.0
    for k in range(1, attempts + 1):
        try:
            return call()
        except Retryable as e:
            wait = e.after if e.after is not None and e.after <= most else min(base * 2 ** (k - 1), most) * (0.5 + 0.5 * random.random())
            if k == attempts or spent + wait > total or (e.after is not None and e.after > most):
                raise
            spent += wait
            sleep(wait)
    raise AssertionError


ENRICHED = T.StructType([T.StructField(x, T.StringType()) for x in ("title", "language", "fields", "error")])


def enriched(docs: DataFrame, client: Callable[[str, str], str] | None, config: EnrichConfig = EnrichConfig(), live: str = "content") -> DataFrame:
    """Metered rows: docs (title, content, language, fields as JSON, ...) with what a client, (prompt, text) -> reply, makes of them. Several calls at a time in a task; order and other columns stay."""
    if client is None:
        raise ValueError("invalid config: no model client is set")

    def one(title, content, language, fields):
        doc = {"title": title, "language": language, "fields": json.loads(fields or "{}")}
        if content is None:
            return {"title": title, "language": language, "fields": fields, "error": None}
        try:
            doc = apply_reply(doc, with_retry(lambda: client(config.prompt, (content or "")[: config.max_input_chars])), config)
        except Declined as e:
            if config.on_refusal == "fail":
                return {"title": title, "language": language, "fields": fields, "error": said(e)}
            doc["fields"]["llm_declined"] = str(e)
        except Exception as e:  # noqa: BLE001  a document's error is its row's
            return {"title": title, "language": language, "fields": fields, "error": said(e)}
        return {"title": doc["title"], "language": doc["language"], "fields": json.dumps(doc["fields"], ensure_ascii=False, separators=(",", ":"), sort_keys=True), "error": None}

    @F.pandas_udf(ENRICHED)
    def run(title: pd.Series, content: pd.Series, language: pd.Series, fields: pd.Series) -> pd.DataFrame:

        with ThreadPoolExecutor(config.max_concurrent) as pool:
            return pd.DataFrame(list(pool.map(one, title, content, language, fields)), columns=ENRICHED.names)

    made = docs.withColumn("_made", run("title", "content", "language", "fields")).select(*[F.col(f"_made.{c}").alias(c) if c in ENRICHED.names else c for c in docs.columns], F.col("_made.error").alias("_error"))
    return _by_error(made, live)


def _by_error(made: DataFrame, live: str) -> DataFrame:
    return made.withColumns({"_n": F.when(F.col(live).isNotNull() & F.col("_error").isNull(), F.lit(0)), "_ms": F.lit(0.0)})


def enrich(docs: DataFrame, client: Callable[[str, str], str] | None, config: EnrichConfig = EnrichConfig()) -> DataFrame:
    """enriched() as plain documents; those without content stay as they are."""
    return strict(enriched(docs.withColumn("_live", F.lit(True)), client, config, "_live")).drop("_live")


def resume(docs: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Documents that an earlier attempt has no answer for."""
    return docs.join(done.select(*key).distinct(), key, "left_anti")


def answered(docs: DataFrame, client: Callable[[dict, str], dict], questions: dict[str, dict], most_chars: int = 48_000, live: str = "content") -> DataFrame:
    """Metered rows: docs (title, content, fields as JSON, ...) with a typed answer to each question, and its confidence, among the fields; what is there stays."""

    @F.udf("fields string, error string", useArrow=True)
    def run(live, state, fields):
        if live is None:
            return fields, None
        try:
            made = answer_fields(questions, json.loads(with_retry(lambda: json.dumps(client(questions, state or "")))))
        except Exception as e:  # noqa: BLE001  a document's error is its row's
            return fields, said(e)
        return json.dumps(made | json.loads(fields or "{}"), ensure_ascii=False, separators=(",", ":"), sort_keys=True), None

    made = docs.withColumn("_made", run(F.col(live).cast("string"), state_for(docs, most_chars), "fields"))
    return _by_error(made.select(*(F.col("_made.fields").alias(c) if c == "fields" else c for c in docs.columns), F.col("_made.error").alias("_error")), live)


def answer(docs: DataFrame, client: Callable[[dict, str], dict], questions: dict[str, dict], most_chars: int = 48_000) -> DataFrame:
    """answered() as plain documents."""
    return strict(answered(docs.withColumn("_live", F.lit(True)), client, questions, most_chars, "_live")).drop("_live")


def state_for(docs: DataFrame, most_chars: int = 48_000) -> Column:
    """What a model is shown of a document: title and content with a blank line between, the first `most_chars` characters."""
    title = F.nullif(F.trim("title"), F.lit("")) if "title" in docs.columns else F.lit(None).cast("string")
    return F.left(F.concat_ws("\n\n", title, "content"), F.lit(most_chars))
