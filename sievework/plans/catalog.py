"""The operator registry: names, what they take and give, and why some are not available here.

STEPS has every operator over metered rows (see operators/documents.py), as runs use them; OPERATORS has the same over
plain rows, where an error fails the query.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import fields as fields_of

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import archives, audio, binary_records, chunker, csv, enrich, html, json_records, markdown, office, parquet, pdf, script, sink
from ..operators.documents import extracted, metered, strict
from ..operators.json_records import InvalidConfig
from .pipeline import Manifest, Operator


def check_keys(name: str, config: dict, known: set[str]) -> None:
    if unknown := sorted(set(config) - known):
        raise InvalidConfig(f"invalid config: {name}: unknown {', '.join(unknown)} (known: {', '.join(sorted(known))})")


def _keys(function: Callable, *own: str) -> set[str]:
    return {k for k, p in inspect.signature(function).parameters.items() if p.default is not p.empty and k not in own}


def _bytes(name: str, kernel: Callable[..., list[dict]], known: set[str] | None = None, charset: bool = False) -> Operator:
    """An extractor: kernel(data, **config), or kernel(data, charset, **config)."""
    known = known or _keys(kernel, "charset")

    def run(rows: DataFrame, config: dict) -> DataFrame:
        check_keys(name, config, known)
        return extracted(rows, lambda data, declared: kernel(data, declared, **config) if charset else kernel(data, **config))

    return run


def _csv(rows: DataFrame, config: dict) -> DataFrame:
    check_keys("csv_parser", config, {"encoding", *_keys(csv.rows)})
    for key in ("max_rows",):
        if config.get(key) is not None and int(config[key]) < 1:
            raise InvalidConfig(f"invalid config: csv_parser: {key} must be at least 1")
    mark = config.get("delimiter")
    if mark is not None and (len(mark) != 1 or ord(mark) > 127):
        raise InvalidConfig(f"invalid config: csv_parser: delimiter must be one ASCII character, not {mark!r}")
    return extracted(rows, lambda data, declared: csv.documents(data, declared, **config))


def _flatten(rows: DataFrame, config: dict) -> DataFrame:
    check_keys("json_flattener", config, {f.name for f in fields_of(json_records.FlattenConfig)})
    settings = json_records.FlattenConfig(**config)
    if not settings.id_field:
        raise InvalidConfig("invalid config: json_flattener: id_field must not be empty")
    return extracted(rows, lambda data, _: json_records.documents(data, settings)) if "data" in rows.columns else json_records.reflattened(rows, settings)


def _chunk(rows: DataFrame, config: dict) -> DataFrame:
    settings = chunker.ChunkConfig.parse(config)
    if "data" in rows.columns:  # raw text
        rows = extracted(rows, lambda data, _: [{"content": data.decode()}])
    return chunker.chunked(rows, settings)


def _script(rows: DataFrame, config: dict) -> DataFrame:
    return script.configured(rows, config, F.col("id").isNotNull() if "id" in rows.columns else None)


def _resampled(rows: DataFrame, config: dict) -> DataFrame:
    check_keys("video_audio_extractor", config, {"sample_rate", "mono"})
    wav = F.udf(lambda d: audio.resample(bytes(d), config.get("sample_rate", 16000), config.get("mono", True)) if d is not None else None, "binary", useArrow=True)
    return metered(rows.withColumn("data", wav("data")), "data")


def _expanded(rows: DataFrame, config: dict) -> DataFrame:
    return archives.expanded(rows, _limits(config))


def _limits(config: dict) -> archives.Limits:
    check_keys("archive_expander", config, {f.name for f in fields_of(archives.Limits)})
    return archives.Limits(**config)


def _missing(name: str, why: str) -> Operator:
    def run(rows: DataFrame, config: dict) -> DataFrame:
        raise NotImplementedError(f"invalid config: {name} is not available: {why}")

    return run


def _plain(step: Operator) -> Operator:
    return lambda df, config: strict(step(df, config))


STEPS: dict[str, Operator] = {
    "pdf_extractor": _bytes("pdf_extractor", pdf.pdf_documents),
    "docx_extractor": _bytes("docx_extractor", office.docx_documents),
    "xlsx_extractor": _bytes("xlsx_extractor", office.xlsx_documents),
    "pptx_extractor": _bytes("pptx_extractor", office.pptx_documents),
    "html_extractor": _bytes("html_extractor", html.documents, charset=True),
    "markdown_extractor": _bytes("markdown_extractor", markdown.markdown_documents),
    "csv_parser": _csv,
    "json_flattener": _flatten,
    "msgpack_parser": _bytes("msgpack_parser", binary_records.msgpack_documents),
    "parquet_parser": _bytes("parquet_parser", parquet.parquet_documents, {*_keys(parquet.parquet_documents), *(f.name for f in fields_of(json_records.FlattenConfig))}),
    "avro_parser": _bytes("avro_parser", binary_records.avro_documents),
    "chunker": _chunk,
    "video_audio_extractor": _resampled,
    "archive_expander": _expanded,
    "document_script": _script,
    "index_sink": sink.formed,
    "whisper_transcriber": _missing("whisper_transcriber", "no transcription client is set"),
    "image_captioner": _missing("image_captioner", "no vision client is set"),
    "llm_enricher": _missing("llm_enricher", "no model client is set"),
    "jev_enricher": _missing("jev_enricher", "no model client is set"),
    "ocr": _missing("ocr", "an external operator"),
    "s3_downloader": _missing("s3_downloader", "an external operator"),
}
#: Over plain rows the sink writes, and an archive's skipped files are told too.
_OWN = {"index_sink": sink.run, "archive_expander": lambda df, config: archives.expand(df, _limits(config))}
OPERATORS: dict[str, Operator] = {name: _plain(step) for name, step in STEPS.items()} | _OWN


def steps_with_clients(transcribe=None, complete=None, see=None, answer=None) -> dict[str, Operator]:
    """STEPS with clients for the operators that call a service.

    transcribe: sound -> segments; complete: (prompt, text) -> reply; see: image -> reply; answer: (questions, text) -> answers.
    """
    out = dict(STEPS)
    if transcribe:
        out["whisper_transcriber"] = lambda rows, config: extracted(rows, lambda data, _: audio.transcribe(data, transcribe, **config))
    if complete:
        out["llm_enricher"] = lambda rows, config: enrich.enriched(rows, complete, enrich.EnrichConfig(**config))
    if see:
        out["image_captioner"] = lambda rows, config: extracted(rows, lambda data, _: [_captioned(see(data), config)])
    if answer:
        out["jev_enricher"] = lambda rows, config: enrich.answered(rows, answer, config["questions"])
    return out


def with_clients(transcribe=None, complete=None, see=None, answer=None) -> dict[str, Operator]:
    """The same over plain rows."""
    return {name: _plain(step) for name, step in steps_with_clients(transcribe, complete, see, answer).items()} | _OWN


def _captioned(reply: str, config: dict) -> dict:
    doc = enrich.caption_document(reply, tuple(config.get("allow_reserved", ())))
    return {"content": doc["content"], "fields": json_records.dumps(doc["fields"])}


_DOCS = ("documents", "many")
# What the operators take where it is not bytes alone, and what they give where it is not documents.
_TAKES = {"chunker": (*_DOCS, "bytes"), "json_flattener": ("bytes", *_DOCS), "document_script": _DOCS, "llm_enricher": _DOCS, "jev_enricher": _DOCS, "index_sink": (*_DOCS, "empty")}
_GIVES = {"video_audio_extractor": "bytes", "archive_expander": "bytes", "s3_downloader": "bytes", "index_sink": "empty"}
MANIFESTS = {name: Manifest(name, _TAKES.get(name, ("bytes",)), _GIVES.get(name, "documents")) for name in OPERATORS}
