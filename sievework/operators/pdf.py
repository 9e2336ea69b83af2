"""Text of simple PDF files: pages in order, text-showing operators of their content streams.

Covers flate and uncompressed streams, object streams, and fonts with a ToUnicode map or Latin codes; scanned pages have no text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?[0-9.]+|[A-Za-z'\"*]+")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class InvalidInput(ValueError):
    pass


class File:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise InvalidInput("invalid input: not a PDF")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise InvalidInput("invalid input: the PDF is encrypted")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body.split(b"stream", 1)[0]:
                packed, first = self.stream(body), int(re.search(rb"/First\s+(\d+)", body)[1])
                heads = list(map(int, packed[:first].split()))
                for k, (number, at) in enumerate(zip(heads[::2], heads[1::2], strict=False)):
                    end = heads[2 * k + 3] if 2 * k + 3 < len(heads) else len(packed) - first
                    self.objects.setdefault(number, packed[first + at : first + end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.match(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]

    def refer(self, body: bytes, key: str) -> list[int]:
        m = re.search(rb"/" + key.encode() + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REFERENCE.findall(m[1])] if m else []

    def pages(self) -> list[bytes]:
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        out, todo, seen = [], self.refer(root, "Pages") if root else [], set()
        while todo:
            n = todo.pop(0)
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            if re.search(rb"/Type\s*/Pages\b", body):
                todo[:0] = self.refer(body, "Kids")
            elif body:
                out.append(body)
        return out

    def fonts(self, page: bytes) -> dict[bytes, dict[bytes, str]]:
        """Font name -> codes of its ToUnicode map."""
        body = page
        for n in self.refer(page, "Resources"):
            body += self.objects.get(n, b"")
        for n in self.refer(body, "Font"):
            body += self.objects.get(n, b"")
        out = {}
        for name, n in re.findall(rb"/([A-Za-z0-9_.+-]+)\s+(\d+)\s+\d+\s+R", body):
            for u in self.refer(self.objects.get(int(n), b""), "ToUnicode"):
                out[name] = to_unicode(self.stream(self.objects.get(u, b"")))
        return out


def to_unicode(cmap: bytes) -> dict[bytes, str]:
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            start = text(c)
            out |= {k.to_bytes(len(a) // 2, "big"): start[:-1] + chr(ord(start[-1]) + k - int(a, 16)) for k in range(int(a, 16), int(b, 16) + 1)}
    return out


def literal(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else b"" if m[1].endswith(b"\n") else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def page_text(content: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    out, stack, codes = [], [], {}

    def show(token: bytes) -> str:
        raw = literal(token)
        if not codes:
            return raw.decode("cp1252", "replace")
        width = len(next(iter(codes)))
        return "".join(codes.get(raw[k : k + width], "") for k in range(0, len(raw), width))

    for token in _TOKEN.findall(content):
        if token in (b"Tj", b"'", b'"', b"TJ"):
            if token in (b"'", b'"'):
                out.append("\n")
            for t in stack:
                if t[:1] in b"(<":
                    out.append(show(t))
                elif token == b"TJ" and re.fullmatch(rb"-[0-9.]+", t) and float(t) < -180:
                    out.append(" ")
        elif token == b"Tf" and len(stack) > 1:
            codes = fonts.get(stack[-2][1:], {})
        elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]) != 0) or token == b"Tm":
            out.append("\n")
        if re.match(rb"[A-Za-z'\"]", token):
            stack = []
        else:
            stack.append(token)
    lines = [" ".join(x.split()) for x in re.split("[\n\f]", "".join(out))]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


def pdf_documents(data: bytes, per_page: bool = True, max_pages: int | None = None) -> list[dict]:
    """A document a page with text; or one with all pages. Stops quietly at a page that can't be read."""
    file, texts = File(data), []
    for page in file.pages()[:max_pages]:
        try:
            content = b"\n".join(file.stream(file.objects[n]) for n in file.refer(page, "Contents"))
        except (KeyError, zlib.error):
            break
        texts.append(page_text(content, file.fonts(page)))
    if not per_page:
        whole = "\n\n".join(filter(None, texts))
        return [{"content": whole}] if whole else []
    return [{"suffix": f"_p{n}", "content": t, "page": n} for n, t in enumerate(texts, 1) if t]
