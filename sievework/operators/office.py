"""Spreadsheets, word-processing files and slides (Office Open XML): zip members walked as XML."""

from __future__ import annotations

import datetime
import io
import json
import posixpath
import re
import zipfile
from xml.etree import ElementTree

from .csv import column_names

#: Uncompressed bytes of one part and of all parts read.
MOST_PART, MOST_TOTAL = 64 << 20, 256 << 20


class InvalidInput(ValueError):
    pass


class Parts:
    """A zip's members, within the limits."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise InvalidInput(f"invalid input: {e}") from None
        self.read = 0
        self.names = set(self.zip.namelist())

    def xml(self, name: str):
        size = self.zip.getinfo(name).file_size
        self.read += size
        if size > MOST_PART or self.read > MOST_TOTAL:
            raise InvalidInput(f"invalid input: {name} is too large when unpacked")
        return ElementTree.fromstring(self.zip.read(name))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target) of a part."""
        name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
        if name not in self.names:
            return {}
        base = posixpath.dirname(part)
        return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join("" if r.get("Target", "").startswith("/") else base, r.get("Target", "").lstrip("/")))) for r in self.xml(name)}


def local(e) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def attribute(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def dumps(fields: dict) -> str:
    return json.dumps(fields, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


# spreadsheets

_DATES = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}  # fixed values: built-in date formats


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _text(e) -> str:
    return "".join(t.text or "" for t in e.iter() if local(t) == "t")


def _date_styles(parts: Parts) -> set[int]:
    if "xl/styles.xml" not in parts.names:
        return set()
    root = parts.xml("xl/styles.xml")
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if local(f) == "numFmt"}
    is_date = lambda k: k in _DATES or bool(re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(k, "")).lower()))
    cells = next((x for x in root if local(x) == "cellXfs"), [])
    return {n for n, xf in enumerate(cells) if is_date(int(xf.get("numFmtId", "0")))}


def _value(cell, shared: list[str], dates: set[int]):
    kind, raw = cell.get("t"), next((v.text or "" for v in cell if local(v) == "v"), "")
    if kind == "inlineStr":
        return _text(cell).strip() or None
    if kind == "s":
        return shared[int(raw)].strip() or None
    if kind == "e" or raw == "":
        return None
    if kind == "b":
        return raw == "1"
    if kind == "str":
        return raw.strip() or None
    number = float(raw)
    if int(cell.get("s", "0")) in dates:
        return (datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(number * 86400))).strftime("%Y-%m-%dT%H:%M:%S")
    return int(number) if number.is_integer() and abs(number) < 1 << 53 else number


def _shown(value) -> str:
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def xlsx_documents(data: bytes, mode: str = "row", has_headers: bool = True, sheets: list[str] | None = None, max_rows: int | None = None) -> list[dict]:
    """One document a row (or a sheet); blank rows count towards max_rows; only cells that are there are held."""
    parts = Parts(data)
    shared = [_text(s) for s in parts.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in parts.names else []
    dates, out = _date_styles(parts), []
    targets = parts.relations("xl/workbook.xml")
    book = [s for s in parts.xml("xl/workbook.xml").iter() if local(s) == "sheet"]
    for n, sheet in enumerate(book, 1):
        name = sheet.get("name", "")
        part = targets.get(attribute(sheet, "id"), ("", ""))[1]
        if (sheets is not None and name not in sheets) or part not in parts.names:
            continue
        rows: dict[int, dict[int, object]] = {}
        at = 0
        for row in (r for r in parts.xml(part).iter() if local(r) == "row"):
            at = int(row.get("r", at + 1))
            column = -1
            for cell in (c for c in row if local(c) == "c"):
                column = _column(cell.get("r")) if cell.get("r") else column + 1
                value = _value(cell, shared, dates)
                if value is not None:
                    rows.setdefault(at, {})[column] = value
        if not rows:
            continue
        top, used = min(rows), sorted({c for r in rows.values() for c in r})
        heads = rows.pop(top) if has_headers else {}
        unique = column_names([_shown(heads[c]) if c in heads else f"col_{c + 1}" for c in used], len(used))
        names = dict(zip(used, unique, strict=True))
        last = top + (max_rows or 1 << 40) - (0 if has_headers else 1)
        body = {r: cells for r, cells in sorted(rows.items()) if r <= last}
        safe = re.sub("[^A-Za-z0-9_-]", "_", name)
        if mode == "sheet":
            lines = ["\t".join(_shown(cells.get(c, "")) for c in used) for cells in ([heads] if heads else []) + list(body.values())]
            out.append({"suffix": f"_{safe}", "title": name, "content": "\n".join(lines), "fields": dumps({"_rows": len(body)}), "section": name, "page": n})
            continue
        for r, cells in body.items():
            fields = {names[c]: v for c, v in sorted(cells.items())} | {"_row": r}
            out.append({"suffix": f"_{safe}_r{r}", "content": " ".join(_shown(v) for _, v in sorted(cells.items())), "fields": dumps(fields), "section": name, "page": n})
    return out


# word processing


def _run_text(paragraph) -> str:
    shown = {"t": lambda e: e.text or "", "tab": lambda _: "\t", "br": lambda _: "\n", "cr": lambda _: "\n"}
    return "".join(shown[local(e)](e) for e in paragraph.iter() if local(e) in shown).strip()


def _style(paragraph) -> str:
    return next((attribute(e, "val") or "" for e in paragraph.iter() if local(e) == "pStyle"), "")


def _table(table) -> str:
    rows = []
    for row in (r for r in table if local(r) == "tr"):
        cells = [" ".join(filter(None, (_table(x) if local(x) == "tbl" else _run_text(x) for x in cell if local(x) in ("p", "tbl")))) for cell in row if local(cell) == "tc"]
        if any(cells):
            rows.append("\t".join(cells))
    return "\n".join(rows)


def docx_documents(data: bytes, split_on_headings: bool = False) -> list[dict]:
    """Paragraphs and tables parted by blank lines; a paragraph of style Title is the title; or a document a heading."""
    parts = Parts(data)
    if "word/document.xml" not in parts.names:
        raise InvalidInput("invalid input: no word/document.xml")
    body = next(e for e in parts.xml("word/document.xml") if local(e) == "body")
    title, sections = None, [(None, [])]
    for e in body:
        text = _run_text(e) if local(e) == "p" else _table(e) if local(e) == "tbl" else ""
        style = _style(e) if local(e) == "p" else ""
        if not text:
            continue
        if style == "Title" and title is None:
            title = text
        elif split_on_headings and style.lower().startswith("heading"):
            sections.append((text, []))
        else:
            sections[-1][1].append(text)
    if not split_on_headings:
        content = "\n\n".join(t for _, s in sections for t in s)
        return [{"title": title, "content": content}] if content or title else []
    made = [(h, "\n\n".join(s)) for h, s in sections if h or s]
    return [{"suffix": f"_s{n}", "title": h or title, "content": s, "section": h} for n, (h, s) in enumerate(made, 1)]


# slides

_CHROME = {"dt", "ftr", "sldNum", "hdr"}


def _shapes(root) -> list[tuple[str, str]]:
    """(placeholder kind, text) of every shape with text, tables as lines of cells."""
    out = []
    for shape in (s for s in root.iter() if local(s) in ("sp", "graphicFrame")):
        kind = next((e.get("type", "") for e in shape.iter() if local(e) == "ph"), "")
        if local(shape) == "graphicFrame":
            lines = ["\t".join(" ".join(_run_text(p) for p in c.iter() if local(p) == "p") for c in r if local(c) == "tc") for r in shape.iter() if local(r) == "tr"]
        else:
            lines = [_run_text(p) for p in shape.iter() if local(p) == "p"]
        text = "\n".join(filter(str.strip, lines))
        if text and kind not in _CHROME:
            out.append((kind, text))
    return out


def pptx_documents(data: bytes, per_slide: bool = True, include_notes: bool = True, notes_in_content: bool = False, skip_empty_slides: bool = True, max_slides: int | None = None) -> list[dict]:
    """Slides in the order of their numbers; page furniture goes; the title is the title shape's, else the first line."""
    parts, made = Parts(data), []
    slides = sorted((int(m[1]), m[0]) for m in (re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n) for n in parts.names) if m)[:max_slides]
    for n, (_, name) in enumerate(slides, 1):
        shapes = _shapes(parts.xml(name))
        text = "\n".join(t for _, t in shapes)
        notes = ""
        if include_notes:
            for kind, target in parts.relations(name).values():
                if kind == "notesSlide" and target in parts.names:
                    notes = "\n".join(t for k, t in _shapes(parts.xml(target)) if k != "sldImg")
        if skip_empty_slides and not text and not notes:
            continue
        title = next((t for k, t in shapes if k in ("title", "ctrTitle")), text.split("\n", 1)[0]) or None
        content = "\n\n".join(filter(None, [text, notes if notes_in_content else ""]))
        made.append({"suffix": f"_s{n}", "title": title, "content": content, "fields": dumps({"notes": notes} if notes else {}), "page": n})
    if per_slide:
        return made
    return [{"title": made[0]["title"], "content": "\n\n".join(d["content"] for d in made), "fields": dumps({"slides": len(made)})}] if made else []
