"""Markdown to documents, one a section."""

from __future__ import annotations

import json
import re

import yaml

_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM = re.compile(r"( *)(?:([-*+])|(\d{1,9})[.)])[ \t]+(.*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ROW = re.compile(r" *\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|? *$")
_INLINE = [
    (re.compile(r"!\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[\^([^\]]+)\]:?"), r"[\1]"), (re.compile(r"\[([^\]]+)\](?:\([^)]*\)|\[[^\]]*\])"), r"\1"), (re.compile(r"<(https?://[^>]+)>"), r"\1"), (re.compile(r"</?[A-Za-z!][^>]*>"), ""),
    (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![\w*])[*_](?=\S)(.+?)(?<=\S)[*_](?![\w*])"), r"\1"), (re.compile(r"~~(.+?)~~"), r"\1"), (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"),
]


def inline(text: str) -> str:
    """Text without markup; code spans stay as they are."""
    parts = re.split(r"(`+)(.+?)\1", text)
    out = []
    for k in range(0, len(parts), 3):
        plain = parts[k]
        for pattern, put in _INLINE:
            plain = pattern.sub(put, plain)
        out += [plain, parts[k + 2].strip() if k + 2 < len(parts) else ""]
    return "".join(out)


def front_matter(text: str) -> tuple[dict | None, str]:
    m = re.match(r"\ufeff?---[ \t]*\r?\n(.*?)(?:^|(?<=\n))(?:---|\.\.\.)[ \t]*(?:\r?\n|\Z)", text, re.S)
    if m:
        try:
            found = yaml.safe_load(m[1])
        except yaml.YAMLError:
            found = None
        if isinstance(found, dict):
            return json.loads(json.dumps(found, default=str)), text[m.end() :]
    return None, text


def _cells(line: str) -> str:
    return "\t".join(inline(c.strip()) for c in re.split(r"(?<!\\)\|", line.strip().strip("|")))


def sections(text: str, level: int) -> list[tuple[str | None, list[str]]]:
    """(heading, lines) of what stands under headings of the level or higher."""
    out: list[tuple[str | None, list[str]]] = [(None, [])]
    fence, lines, counts = "", text.replace("\r\n", "\n").split("\n"), {}
    for n, line in enumerate(lines):
        put = out[-1][1].append
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
            else:
                put(line)
        elif mark:
            fence = mark[1]
        elif (h := _HEADING.match(line)) or (n + 1 < len(lines) and line.strip() and not _ITEM.match(line) and re.fullmatch(r" {0,3}(=+|-+)[ \t]*", lines[n + 1]) and "|" not in line):
            depth, title = (len(h[1]), inline(h[2] or "").strip()) if h else (1 if "=" in lines[n + 1] else 2, inline(line).strip())
            if depth <= level:
                out.append((title, []))
            else:
                put(title)
            if not h:
                lines[n + 1] = ""
        elif _RULE.match(line):
            put("")
        elif m := _ITEM.match(line):
            depth = len(m[1]) // 2
            counts = {k: v for k, v in counts.items() if k <= depth}
            if m[3]:
                counts[depth] = counts.get(depth, int(m[3]) - 1) + 1
            body = re.sub(r"^\[([ xX])\][ \t]+", lambda b: f"[{b[1].lower()}] ", m[4])
            put("  " * depth + (f"{counts[depth]}. " if m[3] else "- ") + inline(body))
        elif "|" in line and (_ROW.match(line) and "-" in line):
            continue
        elif line.strip().startswith("|"):
            put(_cells(line))
        elif re.match(r" {0,3}<(?:[A-Za-z!/])", line) and re.match(r" {0,3}<[^>]*>\s*$", line):
            put("")
        else:
            put(inline(re.sub(r"^( {0,3}> ?)+", "", line)) if not line.startswith("    ") else line)
            if not line.strip():
                counts = {}
    return out


def squeeze(lines: list[str]) -> str:
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in lines)).strip("\n")


def markdown_documents(data: bytes, split_on_headings: bool = True, heading_level: int = 1, use_front_matter: bool = True) -> list[dict]:
    meta, text = front_matter(data.decode("utf-8", "replace")) if use_front_matter else (None, data.decode("utf-8", "replace"))
    meta = meta or {}
    title = meta.pop("title", None)
    found = [(h, squeeze(s)) for h, s in sections(text, heading_level if split_on_headings else 0)]
    found = [(h, s) for h, s in found if h or s]
    fields = json.dumps(meta, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
    return [{"suffix": f"_s{n}" if split_on_headings else "", "title": h or (str(title) if title is not None else None), "content": s, "fields": fields, "section": h} for n, (h, s) in enumerate(found, 1)]
