"""The built-in pipelines."""

from __future__ import annotations

from ..functions import mime as M

_CHUNK = {"id": "chunk", "plugin": "chunker", "config": {"strategy": "sentence", "chunk_size": 512, "overlap": 64}}
_INDEX = {"id": "index", "plugin": "index_sink", "timeout_secs": 1800}


def _extract(plugin: str, id_: str = "extract", timeout: int = 300) -> dict:
    return {"id": id_, "plugin": plugin, "timeout_secs": timeout}


# Pipelines in order, with the content types that they take and their steps.
BUILTIN: dict[str, tuple[list[str], list[dict]]] = {
    "builtin.pdf": ([M.PDF], [_extract("pdf_extractor"), _CHUNK, _INDEX]),
    "builtin.word": ([M.DOCX, M.DOC], [_extract("docx_extractor"), _CHUNK, _INDEX]),
    "builtin.excel": ([M.XLSX, M.XLS], [_extract("xlsx_extractor"), _INDEX]),
    "builtin.powerpoint": ([M.PPTX], [_extract("pptx_extractor"), _INDEX]),
    "builtin.html": ([M.HTML], [_extract("html_extractor"), _CHUNK, _INDEX]),
    "builtin.text": ([M.TEXT], [_CHUNK, _INDEX]),
    "builtin.markdown": ([M.MARKDOWN, "text/x-markdown"], [_extract("markdown_extractor"), _INDEX]),
    "builtin.csv": ([M.CSV], [_extract("csv_parser"), _INDEX]),
    "builtin.json": ([M.JSON, M.NDJSON], [_extract("json_flattener"), _INDEX]),
    "builtin.parquet": ([M.PARQUET], [_extract("parquet_parser"), _INDEX]),
    "builtin.avro": ([M.AVRO], [_extract("avro_parser"), _INDEX]),
    "builtin.msgpack": ([M.MSGPACK], [_extract("msgpack_parser"), _INDEX]),
    "builtin.image": (["image/jpeg", "image/png", "image/webp", "image/gif"], [_extract("image_captioner", "caption", 600), _INDEX]),
    "builtin.audio": (["audio/mpeg", "audio/wav", "audio/ogg", "audio/mp4", "audio/flac"], [_extract("whisper_transcriber", "transcribe", 3600), _INDEX]),
    "builtin.video": (["video/mp4", "video/quicktime", "video/webm", "video/x-matroska"], [_extract("video_audio_extractor", "extract_audio", 1800), _extract("whisper_transcriber", "transcribe", 3600), _INDEX]),
}
